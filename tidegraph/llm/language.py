"""Language identification by interpolated Kneser-Ney character models, one per language."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from ..functions.skew import with_small
from .common import CACHE_WORDS, over_texts, structs

ORDER = 4
FIT_DOCS = 400
"""Labelled documents of least hash per language that the models are fitted on, and half as many for calibration."""
UNSEEN = 1.0 / 50_000
"""Probability of a character that no model has seen, the floor of the lowest order."""
LONG = 400
"""Letters from which on the spread of the entropy no longer shrinks in the calibration."""
SLACK = 4.0
"""A text is rejected beyond so many times the calibrated spread."""
LEAST_SPREAD = 3.0
"""Spread assumed at least, so that few held-back texts do not make the rejection strict."""
SURE = 16
"""Letters that count towards the score; more would drive every score to 0 or 1."""
UNDETERMINED = "und"

_LETTERS = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    return _LETTERS.findall(text.lower())


def letters(word: str) -> str:
    """The letters of a word: what is a digit or number by another name is not one."""
    return word if word.isalpha() else "".join(c for c in word if c.isalpha())


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words, each with ``ORDER - 1`` start marks (1) and an end mark (2), and the places scored."""
    text = "".join("\x01" * (ORDER - 1) + w + "\x02" for w in words)
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    return codes, np.flatnonzero(codes != 1)


def _grams(codes: np.ndarray, at: np.ndarray, order: int) -> np.ndarray:
    """Hash of the ``order`` characters that end at each place."""
    out = np.zeros(len(at), np.uint64)
    for k in range(order - 1, -1, -1):
        out = (out ^ codes[at - k]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def fit(words: list[str], counts: np.ndarray) -> list[tuple[np.ndarray, ...]]:
    """For each order from 1: sorted hashes of grams with discounted shares, and of contexts with what is left for lower orders.

    The highest order discounts counts; each lower one discounts the number of different characters seen in front.
    """
    codes, at = _codes(words)
    lengths = np.array([len(w) + 1 for w in words])
    weights = np.repeat(counts, lengths).astype(np.float64)
    grams = [_grams(codes, at, k) for k in range(1, ORDER + 1)]
    contexts = [np.zeros(len(at), np.uint64), *[_grams(codes, at - 1, k) for k in range(1, ORDER)]]
    tables = []
    for k in range(ORDER):
        if k == ORDER - 1:
            keys, first, inverse = np.unique(grams[k], return_index=True, return_inverse=True)
            n = np.bincount(inverse, weights)
        else:
            # One entry for each longer gram: its distinct first characters are what counts.
            _, longer = np.unique(grams[k + 1], return_index=True)
            keys, first, inverse = np.unique(grams[k][longer], return_index=True, return_inverse=True)
            n, first = np.bincount(inverse).astype(np.float64), longer[first]
        ones, twos = (n == 1).sum(), (n == 2).sum()
        discount = min(0.9, max(0.1, ones / (ones + 2 * twos))) if ones + twos else 0.5
        context_of = contexts[k][first]
        known, place = np.unique(context_of, return_inverse=True)
        total, kinds = np.bincount(place, n), np.bincount(place)
        tables.append((keys, (np.maximum(n - discount, 0) / total[place]).astype(np.float32), known, (discount * kinds / total).astype(np.float32)))
    return tables


class Models:
    """The tables of all languages side by side: one sorted hash array per order, one column per language."""

    def __init__(self, fitted: dict[str, list[tuple[np.ndarray, ...]]]):
        self.languages = sorted(fitted)
        self.tables = []
        for k in range(ORDER if fitted else 0):
            own = [fitted[name][k] for name in self.languages]
            grams, contexts = (np.unique(np.concatenate([t[j] for t in own])) for j in (0, 2))
            share, left = np.zeros((len(grams), len(own)), np.float32), np.ones((len(contexts), len(own)), np.float32)
            for j, t in enumerate(own):
                share[np.searchsorted(grams, t[0]), j] = t[1]
                left[np.searchsorted(contexts, t[2]), j] = t[3]
            self.tables.append((grams, share, contexts, left))

    @staticmethod
    def _find(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, missing: float) -> np.ndarray:
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        out = values[at]
        out[keys[at] != wanted] = missing
        return out

    def log_probabilities(self, words: list[str]) -> np.ndarray:
        """Natural log probability of each word, end mark included, in each language."""
        codes, at = _codes(words)
        p = np.full((len(at), len(self.languages)), UNSEEN, np.float32)
        for k, (grams, share, contexts, left) in enumerate(self.tables):
            context = np.zeros(len(at), np.uint64) if k == 0 else _grams(codes, at - 1, k)
            p *= self._find(contexts, left, context, 1.0)
            p += self._find(grams, share, _grams(codes, at, k + 1), 0.0)
        starts = np.cumsum([0, *[len(w) + 1 for w in words[:-1]]])
        return np.add.reduceat(np.log(p), starts, axis=0)


class WordScores:
    """Log probabilities of distinct words, each computed once, as rows of one growing array."""

    def __init__(self, models: Models):
        self.models, self.places = models, {}
        self.rows, self.sizes = np.zeros((0, len(models.languages)), np.float32), np.zeros(0, np.int32)

    def learn(self, words: set[str]) -> None:
        if len(self.places) > CACHE_WORDS:
            self.__init__(self.models)
        new = sorted(w for w in words if w not in self.places)
        for i in range(0, len(new), 20_000):
            part = new[i : i + 20_000]
            spelled = [letters(w) for w in part]
            sizes = np.array([len(w) + 1 if w else 0 for w in spelled], np.int32)
            rows = np.zeros((len(part), len(self.models.languages)), np.float32)
            if sizes.any():
                rows[sizes > 0] = self.models.log_probabilities([w for w in spelled if w])
            self.places.update(zip(part, range(len(self.sizes), len(self.sizes) + len(part))))
            self.rows, self.sizes = np.concatenate([self.rows, rows]), np.concatenate([self.sizes, sizes])

    def texts(self, bodies: list) -> tuple[np.ndarray, np.ndarray]:
        """Per text, length-normalised cross-entropy in nats for each language, and the number of characters predicted."""
        entropy, sizes = np.zeros((len(bodies), len(self.models.languages))), np.zeros(len(bodies), np.int64)
        for lo in range(0, len(bodies), 500):
            split = [words_of(b.decode()) if b else [] for b in bodies[lo : lo + 500]]
            self.learn(set().union(*split))
            for i, words in enumerate(split, lo):
                if words:
                    at = np.fromiter(map(self.places.__getitem__, words), np.int64, len(words))
                    sizes[i] = self.sizes[at].sum()
                    entropy[i] = -self.rows[at].sum(axis=0, dtype=np.float64) / max(1, sizes[i])
        return entropy, sizes


def fit_models(labelled: DataFrame, text: str = "text", lang: str = "lang", id_col: str = "doc_id", fit_docs: int = FIT_DOCS) -> Models:
    """Models of all languages in ``labelled``, each from its ``fit_docs`` rows of least hash, fitted in one task per language."""
    sample = _least(labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()), text, lang, id_col, fit_docs)

    def train(rows):
        import pandas as pd

        words, counts = np.unique(np.array([w for t in rows["_text"] for w in map(letters, words_of(t)) if w], object), return_counts=True)
        if not len(words):
            return pd.DataFrame({"lang": [], "tables": []})
        parts = [x.tobytes() for table in fit(list(words), counts) for x in table]
        return pd.DataFrame({"lang": [rows["_lang"].iloc[0]], "tables": [parts]})

    fitted = {}
    for r in sample.groupBy("_lang").applyInPandas(train, "lang string, tables array<binary>").collect():
        kinds = (np.uint64, np.float32, np.uint64, np.float32)
        arrays = [np.frombuffer(x, kinds[i % 4]) for i, x in enumerate(r["tables"])]
        fitted[r["lang"]] = [tuple(arrays[4 * k : 4 * k + 4]) for k in range(ORDER)]
    return Models(fitted)


def _least(df: DataFrame, text: str, lang: str, id_col: str, n: int) -> DataFrame:
    """The ``n`` rows of least hash of each language; ranks are taken on hashes alone, texts are read for the chosen rows only."""
    hashed = df.select(F.col(lang).alias("_lang"), F.xxhash64(id_col, text).alias("_hash"), F.col(text).alias("_text"))
    ranked = hashed.select("_lang", "_hash").withColumn("_n", F.row_number().over(Window.partitionBy("_lang").orderBy("_hash"))).where(F.col("_n") <= n)
    cuts = ranked.groupBy("_lang").agg(F.max("_hash").alias("_cut"))
    return with_small(hashed, cuts, ["_lang"]).where(F.col("_hash") <= F.col("_cut")).drop("_cut")


class Identifier:
    """Models with, per language, the usual entropy and the spread beyond which a text is rejected."""

    def __init__(self, models: Models, usual: dict[str, tuple[float, float]]):
        self.models = models
        self.usual = np.array([usual.get(x, (0.0, np.inf)) for x in models.languages]).reshape(-1, 2)


def train_identifier(labelled: DataFrame, held_back: DataFrame, text: str = "text", lang: str = "lang", id_col: str = "doc_id",
                     fit_docs: int = FIT_DOCS) -> Identifier:
    """Fit on ``labelled``, calibrate the rejection on ``held_back`` (same columns, other rows).

    For each language, over the held-back texts found to be in it: the mean entropy of a character, and the 99th
    percentile of a text's excess over it times the root of its length (at most ``LONG``).
    """
    models = fit_models(labelled, text, lang, id_col, fit_docs)
    sample = _least(held_back.where(F.col(lang).isNotNull() & F.col(text).isNotNull()), text, lang, id_col, fit_docs // 2)
    found = _judged(sample, "_text", Identifier(models, {})).where(F.col("result.n_letters") > 0).select(
        F.col("row._lang").alias("truth"), "result.lang", "result.entropy", F.least("result.n_letters", F.lit(LONG)).alias("n"))
    right = found.where(F.col("truth") == F.col("lang"))
    mean = right.groupBy("lang").agg((F.sum(F.col("entropy") * F.col("n")) / F.sum("n")).alias("mean"))
    spread = (F.col("entropy") - F.col("mean")) * F.sqrt("n")
    rows = right.join(mean, "lang").groupBy("lang", "mean").agg(F.percentile(spread, 0.99).alias("spread")).collect()
    return Identifier(models, {r["lang"]: (r["mean"], max(r["spread"], LEAST_SPREAD)) for r in rows})


FOUND = T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("entropy", T.DoubleType()),
                      T.StructField("n_letters", T.LongType()), T.StructField("rejected", T.BooleanType())])


def _judged(docs: DataFrame, text: str, identifier: Identifier, keep: list[str] | None = None) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(identifier)

    def make():
        models, usual = shared.value.models, shared.value.usual
        if not models.languages:
            nothing = lambda n, kind: pa.nulls(n, kind)
            return lambda bodies: structs(lang=pa.array([UNDETERMINED] * len(bodies)), score=pa.array([0.0] * len(bodies)),
                                          entropy=nothing(len(bodies), pa.float64()), n_letters=pa.array([0] * len(bodies), pa.int64()),
                                          rejected=pa.array([True] * len(bodies)))
        scores, names = WordScores(models), np.array(models.languages, object)

        def work(bodies):
            entropy, sizes = scores.texts(bodies)
            best = entropy.argmin(axis=1)
            least = entropy[np.arange(len(bodies)), best]
            weight = np.exp(-(entropy - least[:, None]) * np.minimum(sizes, SURE)[:, None])
            none = sizes == 0
            excess = (least - usual[best, 0]) * np.sqrt(np.minimum(sizes, LONG))
            return structs(lang=pa.array(np.where(none, UNDETERMINED, names[best]), pa.string()),
                           score=pa.array(np.where(none, 0.0, 1 / weight.sum(axis=1))),
                           entropy=pa.array(least, pa.float64(), mask=none), n_letters=pa.array(sizes, pa.int64()),
                           rejected=pa.array(none | (excess > SLACK * usual[best, 1])))
        return work

    return over_texts(docs, text, FOUND, make, keep)


def identify(docs: DataFrame, identifier: Identifier, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``row`` and ``result``: language of lowest entropy, score, entropy per character, letters and whether it is rejected.

    Only the text is used. A null text, or one without a letter, is ``und`` with score 0 and rejected. The score is the
    posterior of the language under equal priors from at most ``SURE`` characters. Ties go to the first language by name.
    Without any labelled row every text is ``und``. Repeated rows get the same result; nothing is moved.
    """
    return _judged(docs, text, identifier, keep)


def trained_on(docs: DataFrame, id_col: str = "doc_id") -> Identifier:
    """The identifier of the contract: crc32(id) mod 3 is 0 for the models, 2 for the calibration, never 1."""
    from .common import crc_part

    rest = crc_part(id_col, 3)
    return train_identifier(docs.where(rest == 0), docs.where(rest == 2), id_col=id_col)


def accepted(docs: DataFrame, identifier: Identifier, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not rejected, with their columns."""
    return identify(docs, identifier, text).where(~F.col("result.rejected")).select("row.*")
