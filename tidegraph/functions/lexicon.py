"""The default scorer: word counts over the whole text, as column expressions.

It stands in where no model is plugged in. ``lexicon_sentiment`` and ``lexicon_toxicity``
are the same rules as a plain callable, for use through the plug-in path.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

POSITIVE = ("danke", "gern", "gerne", "gut", "beste", "schön", "toll", "wunderbar", "love", "great", "good", "happy")
NEGATIVE = ("angst", "furchtbar", "hass", "leider", "schlecht", "schlimm", "traurig", "bad", "hate", "awful", "sad", "wrong",
            "disgusting", "pathetic", "worthless")
TOXIC = ("abschaum", "dumm", "idiot", "idioten", "lügner", "maul", "clown", "disgusting", "garbage", "loser", "moron", "pathetic", "stupid", "worthless")

# Labels of the two classifications.
SENTIMENT_LABELS = ("positive", "neutral", "negative")
TOXICITY_LABELS = ("non-toxic", "neutral", "toxic")


def _pattern(words: tuple[str, ...]) -> str:
    return r"(?<!\p{L})(?:" + "|".join(words) + r")(?!\p{L})"


def hits(text: Column, words: tuple[str, ...]) -> Column:
    """Occurrences of the words in the lower-cased text, between non-letters."""
    return F.regexp_count(F.lower(text), F.lit(_pattern(words)))


def sentiment(text: Column) -> Column:
    """``struct(label, score)``: the side with more words, surer the wider the lead."""
    good, bad = hits(text, POSITIVE), hits(text, NEGATIVE)
    label = F.when(good > bad, "positive").when(bad > good, "negative").otherwise("neutral")
    lead = F.abs(good - bad) / (good + bad + 1)
    score = F.when(good == bad, 0.5 + 0.5 / (good + bad + 1)).otherwise(0.5 + 0.5 * lead)
    return F.struct(label.alias("label"), score.alias("score"))


def toxicity(text: Column) -> Column:
    """``struct(label, score)``: toxic with one word, surer with more."""
    bad = hits(text, TOXIC)
    return F.struct(F.when(bad > 0, "toxic").otherwise("non-toxic").alias("label"),
                    F.when(bad > 0, 1 - 0.5 / (bad + 1)).otherwise(F.lit(1.0)).alias("score"))


def _count(texts: list[str], words: tuple[str, ...]) -> list[int]:
    letter = r"[^\W\d_]"
    found = re.compile(rf"(?<!{letter})(?:" + "|".join(words) + rf")(?!{letter})")
    return [len(found.findall(text.lower())) for text in texts]


def lexicon_sentiment(texts: list[str]) -> list[tuple[str, float]]:
    pairs = zip(_count(texts, POSITIVE), _count(texts, NEGATIVE))
    return [("neutral", 0.5 + 0.5 / (p + n + 1)) if p == n
            else ("positive" if p > n else "negative", 0.5 + 0.5 * abs(p - n) / (p + n + 1)) for p, n in pairs]


def lexicon_toxicity(texts: list[str]) -> list[tuple[str, float]]:
    return [("toxic", 1 - 0.5 / (n + 1)) if n else ("non-toxic", 1.0) for n in _count(texts, TOXIC)]
