"""Hashtag categories: pluggable classifier, taxonomy check, join back."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..session import width
from ..functions.taxonomy import CATEGORIES, FALLBACK_CATEGORY, FALLBACK_CONFIDENCE, KEYWORDS, UNCATEGORIZED

# Attempts per hashtag and bounds of the wait between them, in seconds.
ATTEMPTS, FIRST_WAIT, LONGEST_WAIT = 5, 1, 60
REPLY = "struct<categories:array<string>,confidence:double>"

Classifier = Callable[[str], tuple[str, int, int]]
"""A hashtag to (JSON reply, prompt tokens, completion tokens)."""


def top_hashtags(hashtags: DataFrame, n: int | None = None) -> DataFrame:
    """Hashtags by falling number of politician users; the first ``n`` if given."""
    ordered = hashtags.orderBy(F.desc("politician_users"), "hashtag")
    return ordered.limit(n) if n else ordered


def keyword_reply(hashtag: str) -> tuple[str, int, int]:
    """Default classifier: categories of the keywords a hashtag contains, in the order of the taxonomy."""
    found = {category for word, category in KEYWORDS if word in hashtag.lower()}
    categories = [c for c in CATEGORIES if c in found] or [UNCATEGORIZED]
    return json.dumps({"categories": categories, "confidence": 1.0 if found else 0.0}), len(hashtag), len(categories)


def by_keywords(hashtags: DataFrame) -> DataFrame:
    """``keyword_reply`` for all distinct hashtags as one expression: what it replies, without a call per hashtag."""
    named = hashtags.select("hashtag").where(F.col("hashtag").isNotNull()).distinct()
    tag = F.lower("hashtag")
    words = {c: [w for w, category in KEYWORDS if category == c] for c in CATEGORIES}
    hits = [F.when(reduce(Column.__or__, [F.contains(tag, F.lit(w)) for w in words[c]]), c) for c in CATEGORIES if words[c]]
    found = F.array_compact(F.array(*hits))
    known = F.size(found) > 0
    categories = F.when(known, found).otherwise(F.array(F.lit(UNCATEGORIZED)))
    return named.select("hashtag", F.length("hashtag").cast("long").alias("prompt_tokens"), F.size(categories).cast("long").alias("completion_tokens"),
                        categories.alias("categories"), F.when(known, 1.0).otherwise(0.0).alias("confidence"))


def classify(hashtags: DataFrame, make: Callable[[], Classifier] | None = None, tasks: int | None = None,
             attempts: int = ATTEMPTS, first_wait: float = FIRST_WAIT, longest_wait: float = LONGEST_WAIT) -> DataFrame:
    """``categories``, ``confidence`` and token counts of each distinct hashtag.

    Without ``make`` the keywords decide. A classifier is made once per task, and the hashtags are dealt over ``tasks``
    (the session's shuffle partitions), so that a slow service is asked from all of them. A call that fails is tried again with growing
    waits; one that fails every time yields the fallback.
    """
    if make is None:
        return by_keywords(hashtags)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = make()

        def answer(hashtag: str) -> tuple[str | None, int, int]:
            for attempt in range(attempts):
                try:
                    return ask(hashtag)
                except Exception:
                    if attempt + 1 < attempts:
                        time.sleep(min(longest_wait, first_wait * 2 ** attempt))
            return None, 0, 0

        for frame in frames:
            yield frame.assign(**dict(zip(("reply", "prompt_tokens", "completion_tokens"),
                                          zip(*[answer(h) for h in frame["hashtag"]])))) if len(frame) else \
                frame.assign(reply=None, prompt_tokens=0, completion_tokens=0)

    named = hashtags.select("hashtag").where(F.col("hashtag").isNotNull()).distinct()
    replies = named.repartition(tasks or width(hashtags.sparkSession), "hashtag").mapInPandas(
        run, "hashtag string, reply string, prompt_tokens bigint, completion_tokens bigint")
    return parse_reply(replies)


def parse_reply(replies: DataFrame) -> DataFrame:
    """Read the JSON ``reply``; what is missing or broken becomes the fallback."""
    parsed = F.from_json("reply", REPLY, {"mode": "PERMISSIVE"})
    rest = [c for c in replies.columns if c != "reply"]
    return replies.withColumn("parsed", parsed).select(
        *rest,
        F.coalesce("parsed.categories", F.array(F.lit(FALLBACK_CATEGORY))).alias("categories"),
        F.coalesce("parsed.confidence", F.lit(FALLBACK_CONFIDENCE)).alias("confidence"))


def legal_categories(categories: Column) -> Column:
    """The legal ones among the categories, or the catch-all if there are none."""
    legal = F.array_intersect(categories, F.array(*[F.lit(c) for c in CATEGORIES]))
    return F.when(F.size(legal) > 0, legal).otherwise(F.array(F.lit(UNCATEGORIZED)))


def joined_categories(categories: Column) -> Column:
    return F.array_join(categories, ";")


def attach(hashtags: DataFrame, classified: DataFrame) -> DataFrame:
    """Left join of the classification, one row of it per hashtag."""
    right = classified.select("hashtag", joined_categories(F.col("categories")).alias("categories"), "confidence")
    return hashtags.join(right, "hashtag", "left")


def token_usage(classified: DataFrame) -> DataFrame:
    return classified.agg(F.sum("prompt_tokens").alias("total_input_tokens"),
                          F.sum("completion_tokens").alias("total_output_tokens"))
