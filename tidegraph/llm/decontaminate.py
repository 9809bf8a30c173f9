"""Benchmark decontamination: Wu-Manber multi-pattern search over words."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F, types as T

from ..session import settle
from .common import alnum_words, flat, over_texts, structs, stored

BLOCK_WINDOWS = 200_000
"""Windows searched for in one pass, which bounds what is broadcast; more windows mean more passes, not fewer windows."""

FOUND = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(T.LongType())),
                      T.StructField("items", T.ArrayType(T.StringType()))])
VERDICT = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
                        T.StructField("items", T.ArrayType(T.StringType())), T.StructField("contaminated", T.BooleanType())])


class WuManber:
    """Search for word sequences of one length.

    The table of shifts tells by the last block (two words, or one for length 1) how far the window
    can move without passing an occurrence. At shift 0 the bucket of that block, further keyed by
    the first word, selects the patterns to compare word by word.
    """

    def __init__(self, patterns: list[tuple[list[bytes], int]]):
        self.length = len(patterns[0][0])
        self.block = min(2, self.length)
        self.far = self.length - self.block + 1
        self.shift: dict[tuple, int] = {}
        self.buckets: dict[tuple, dict[bytes, list]] = defaultdict(lambda: defaultdict(list))
        for words, number in patterns:
            for end in range(self.block, self.length + 1):
                key = tuple(words[end - self.block : end])
                self.shift[key] = min(self.shift.get(key, self.far), self.length - end)
            self.buckets[tuple(words[-self.block :])][words[0]].append((words, number))

    def search(self, words: list[bytes]):
        """First word and pattern number of every occurrence."""
        length, far, get, n = self.length, self.far, self.shift.get, len(words)
        at = length - 1
        while at < n:
            key = (words[at - 1], words[at]) if length > 1 else (words[at],)
            step = get(key, far)
            if step:
                at += step
                continue
            first = at - length + 1
            for pattern, number in self.buckets[key].get(words[first], ()):
                if words[first : at + 1] == pattern:
                    yield first, number
            at += 1


def windows_of(items: DataFrame, item_id: str = "item_id", text: str = "text", window: int = 13) -> DataFrame:
    """Distinct windows with the ids of the items they come from: columns ``words`` (joined by a space) and ``items``.

    An item with fewer words than ``window`` is one window; one without words has none.
    """
    result = T.StructType([T.StructField("words", T.ArrayType(T.BinaryType()))])

    def make():
        def work(bodies):
            out = []
            for body in bodies:
                words = alnum_words(body)
                out.append([b" ".join(words[i : i + window]) for i in range(max(1, len(words) - window + 1))] if words else [])
            return structs(words=pa.array(out, pa.list_(pa.binary())))
        return work

    each = over_texts(items.select(F.col(item_id).cast("string").alias("id"), F.col(text).alias("text")), "text", result, make)
    return (each.select(F.explode("result.words").alias("words"), F.col("row.id").alias("id"))
            .groupBy("words").agg(F.sort_array(F.collect_set("id")).alias("items")))


def covered(spans: list[int]) -> int:
    """Words inside any of the spans, given as flat pairs of start and end in order of the start."""
    total, until = 0, -1
    for start, end in zip(spans[0::2], spans[1::2]):
        total += max(0, end - max(start, until))
        until = max(until, end)
    return total


def _pass(df: DataFrame, shared: Broadcast, last: bool, share: int) -> DataFrame:
    """Search every text for one block of windows and add the finds to those of the passes before."""
    row = df.schema["row"]
    schema = T.StructType([row, T.StructField("result", VERDICT)] if last else [row, df.schema["text"], T.StructField("found", FOUND)])

    def run(batches):
        by_length = defaultdict(list)
        for number, (words, _) in enumerate(shared.value):
            by_length[len(words)].append((words, number))
        engines, items = [WuManber(group) for group in by_length.values()], [x for _, x in shared.value]
        for batch in batches:
            n_words, spans, names = [], [], []
            before = batch.column(2).to_pylist() if batch.num_columns > 2 else [None] * batch.num_rows
            for body, old in zip(batch.column(1).to_pylist(), before):
                words, ends, found = alnum_words(body), {}, set()
                for first, end in zip(old["spans"][0::2], old["spans"][1::2]) if old else ():
                    ends[first] = end
                for engine in engines:
                    for first, number in engine.search(words):
                        ends[first] = max(ends.get(first, 0), first + engine.length)
                        found.add(number)
                n_words.append(len(words))
                spans.append([x for first in sorted(ends) for x in (first, ends[first])])
                names.append(sorted(set(old["items"] if old else ()).union(*[items[k] for k in found])))
            words_, names_ = pa.array(n_words, pa.int64()), pa.array(names, pa.list_(pa.string()))
            if last:
                hit = np.array([covered(x) for x in spans], np.int64)
                dirty = (hit > 0) & (share * hit >= np.array(n_words, np.int64))
                out = structs(n_words=words_, n_hit=pa.array(hit), items=names_, contaminated=pa.array(dirty))
                yield pa.RecordBatch.from_arrays([batch.column(0), out], names=["row", "result"])
            else:
                out = structs(n_words=words_, spans=pa.array(spans, pa.list_(pa.int64())), items=names_)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), out], names=["row", "text", "found"])

    return df.mapInArrow(run, schema)


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
                  window: int = 13, share: int = 20, keep: list[str] | None = None, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """The columns of ``docs`` (or those in ``keep``) with ``n_words``, ``n_hit``, ``items`` and ``contaminated``.

    A word inside any occurrence of a window is hit; ``items`` are the ids (as text, sorted) of the items whose
    windows occur. A document is contaminated with a hit and ``share * n_hit >= n_words``. Null or empty texts have
    no words and are clean; an empty benchmark hits nothing; repeated rows are judged one by one; columns of ``docs``
    with the names of results are replaced. An item without an id makes hits as the others do and is in no list. Documents are
    never moved: each block of windows is one narrow pass, and of several passes all but the last write the texts with their finds.
    """
    windows = settle(windows_of(benchmark, item_id, item_text, window), "windows")
    blocks = max(1, -(-windows.count() // block_windows))
    block = F.pmod(F.xxhash64("words"), F.lit(blocks))
    df = docs.select(F.struct(*(keep or docs.columns)).alias("row"), F.col(text).cast("binary").alias("text"))
    for k in range(blocks):
        rows = windows.where(block == k).collect()
        shared = docs.sparkSession.sparkContext.broadcast([(bytes(r["words"]).split(b" "), list(r["items"])) for r in rows])
        df = _pass(df, shared, k == blocks - 1, share)
        if k < blocks - 1:
            # Each pass is a job of its own, so a task has the engines of one block and the driver one block of windows.
            df = stored(df, "pass")
            shared.destroy()
    return flat(df)


def decontaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with their columns only."""
    whole = docs.select(F.struct("*").alias("document"), F.col(text).alias("body"))
    return contamination(whole, benchmark, "body", keep=["document"], **options).where(~F.col("contaminated")).select("document.*")
