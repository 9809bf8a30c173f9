"""Removal of passages that occur before: a relative Lempel-Ziv parse of every document against all indexed blocks.

Reference blocks are the whole corpus, indexed by content-defined anchors: of any ``WINDOW`` consecutive words, the run of
``GRAM`` words with the least hash. Equal windows have equal anchors, so a window whose anchor is found only once in the index
starts no factor, and the parse of a document looks only at windows with a repeated anchor. These are compared in full
(128 bits over their words) with the earliest occurrence, the ones at factor boundaries like all others; windows that
follow each other and are found earlier make up a factor, and factors of at least ``WINDOW`` words are duplicate spans.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import settle
from .common import rolled, space_words, word_hashes

WINDOW = 20
GRAM = 6

RESULT = "n_words long, spans array<struct<start:long,end:long>>, kept string"


_PLACE = np.uint64((1 << 20) - 1)


def anchors_of(hashes: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Anchor of every window, by the window's first word: its place (the first of equal ones), and the hash of its words."""
    if len(hashes) < window:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    grams = rolled(hashes, gram)
    span = window - gram + 1
    if len(grams) > int(_PLACE):
        at = np.lib.stride_tricks.sliding_window_view(grams, span).argmin(axis=1) + np.arange(len(grams) - span + 1)
        return at, grams[at]
    # The place stands in the low bits, so the least is the first of equal ones; minima of wider spans come from two narrower.
    least, width = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64), 1
    while width * 2 <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < span:
        least = np.minimum(least[: width - span], least[span - width :])
    at = (least & _PLACE).astype(np.int64)
    return at, grams[at]


def _keyed(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """Key of a document: its id, and 32 bits of its text in case an id occurs with several texts."""
    body = F.col(text).cast("binary")
    return docs.select(F.col(id_col).cast("long").alias("id"), F.shiftrightunsigned(F.xxhash64(body), 33).alias("tie"), body.alias("body"))


def _anchors(keyed: DataFrame, window: int) -> DataFrame:
    """``hash`` of each distinct anchor of a document, and at how many places it is one."""
    def run(batches):
        for batch in batches:
            hashes, counts, sizes = [], [], []
            for body in batch.column(2).to_pylist():
                at, grams = anchors_of(word_hashes(body), window)
                places = np.flatnonzero(np.diff(at, prepend=-1))
                keys, n = np.unique(grams[places], return_counts=True)
                hashes.append(keys)
                counts.append(n)
                sizes.append(len(keys))
            at = pa.array(np.repeat(np.arange(batch.num_rows), sizes))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(np.concatenate(hashes).view(np.int64)),
                                              pa.array(np.concatenate(counts).astype(np.int64))], names=["id", "tie", "hash", "n"])

    return keyed.mapInArrow(run, "id long, tie long, hash long, n long")


def _indexed(flagged: np.ndarray | None, body: bytes | None, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes, and the first words of the windows whose anchor is repeated somewhere."""
    if flagged is None:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    hashes = word_hashes(body)
    at, grams = anchors_of(hashes, window)
    # Windows next to each other mostly have the same anchor, which is looked up once.
    turns = np.flatnonzero(np.diff(at, prepend=-1))
    hit = np.isin(grams[turns].view(np.int64), flagged)
    return hashes, np.flatnonzero(np.repeat(hit, np.diff(turns, append=len(at))))


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """``id``, ``n_words``, ``spans`` (first word and end of each duplicate span) and ``kept``, the other words joined by spaces.

    A word goes when a window over it has the same words as a window that starts earlier: in a document of smaller id
    (null is smallest), or before it in the same one. Windows are judged on the input. Null texts have no words; texts
    shorter than a window keep all; rows of one id with different texts follow each other in a fixed order and
    identical rows count as one document and get the same result; an empty table gives an empty one; other columns are not used.
    """
    keyed = _keyed(docs, id_col, text)
    anchors = _anchors(keyed, window)
    index = settle(anchors.groupBy("hash").agg(F.sum("n").alias("n")).where(F.col("n") > 1).select("hash"), "index")
    flags = settle(_anchors(keyed, window).drop("n").join(index, "hash", "left_semi").groupBy("id", "tie")
                   .agg(F.collect_set("hash").alias("flags")), "flags")
    parsed = keyed.join(flags, keyed["id"].eqNullSafe(flags["id"]) & (keyed["tie"] == flags["tie"]), "left").select(
        keyed["id"], keyed["tie"], "body", "flags")

    def windows(batches):
        for batch in batches:
            first, second, places, sizes = [], [], [], []
            flags_ = batch.column(3)
            for i, body in enumerate(batch.column(2).to_pylist()):
                flagged = flags_[i].values.to_numpy() if flags_[i].is_valid else None
                hashes, at = _indexed(flagged, body, window)
                sizes.append(len(at))
                if len(at):
                    first.append(rolled(hashes, window, 1)[at])
                    second.append(rolled(hashes, window, 2)[at])
                    places.append(at)
            if not first:
                continue
            row = pa.array(np.repeat(np.arange(batch.num_rows), sizes))
            place = (batch.column(1).take(row).to_numpy() << 32) + np.concatenate(places)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(first).view(np.int64)), pa.array(np.concatenate(second).view(np.int64)),
                                              batch.column(0).take(row), pa.array(place)], names=["k1", "k2", "id", "place"])

    found = parsed.where(F.col("flags").isNotNull()).mapInArrow(windows, "k1 long, k2 long, id long, place long")
    # Null ids come first: a struct with a null in front is the least.
    first = found.groupBy("k1", "k2").agg(F.min(F.struct("id", "place")).alias("first")).select(
        F.col("first.id").alias("id"), F.shiftright("first.place", 32).alias("tie"), F.col("first.place").bitwiseAND(0xFFFFFFFF).cast("int").alias("at"))
    firsts = first.groupBy("id", "tie").agg(F.collect_list("at").alias("firsts"))
    whole = parsed.join(firsts, parsed["id"].eqNullSafe(firsts["id"]) & (parsed["tie"] == firsts["tie"]), "left").select(
        parsed["id"], "body", "flags", "firsts")

    def cut(batches):
        for batch in batches:
            flags_, firsts_ = batch.column(2), batch.column(3)
            n_words, spans, kept = [], [], []
            for i, body in enumerate(batch.column(1).to_pylist()):
                words = space_words(body)
                _, at = _indexed(flags_[i].values.to_numpy() if flags_[i].is_valid else None, body, window)
                if firsts_[i].is_valid:
                    at = np.setdiff1d(at, firsts_[i].values.to_numpy(), assume_unique=True)
                n_words.append(len(words))
                if not len(at):
                    spans.append([])
                    kept.append(b" ".join(words).decode())
                    continue
                change = np.zeros(len(words) + 1, np.int64)
                np.add.at(change, at, 1)
                np.add.at(change, at + window, -1)
                gone = np.cumsum(change[:-1]) > 0
                edges = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0)).tolist()
                spans.append([{"start": a, "end": b} for a, b in zip(edges[0::2], edges[1::2])])
                kept.append(b" ".join([w for w, x in zip(words, gone.tolist()) if not x]).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(spans, SPANS), pa.array(kept, pa.string())],
                                             names=["id", "n_words", "spans", "kept"])

    return whole.mapInArrow(cut, f"id long, {RESULT}")


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
