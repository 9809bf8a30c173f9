"""Brown class-based bigrams: P(word | word before) = P(class | class before) * P(word | class).

The corpus is coded once, block by block, as numbers into the block's own dictionary. Every word has its own class, assigned
by exchange clustering over all training tokens, until the likelihood gains no more than ``TOLERANCE``. Words are spread
over parts by hash. A sweep reads the blocks once: it counts the class bigrams and sends each part the neighbour classes of
the words that may move, added up within the block; the part adds up the blocks, moves its words by the bigrams of the whole
corpus, which every task sends ahead of its words, and sends the classes back. Blocks lie in buckets, so they never
move, and no task holds the whole vocabulary. Counts of words are exact and stay in Spark: every block's dictionary is
joined with the vocabulary and gets its counts back.
"""

from __future__ import annotations

import math
import uuid
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from ..session import scratch_path, settle, width
from .common import space_words, stored

CLASSES = 16
"""Word classes; one more holds the end of a text."""
END = CLASSES
TOLERANCE = 1e-3
"""Nats per training token; the exchange ends when two sweeps in a row, a turn of each half of the words, gain no more."""
PART_WORDS = 50_000
"""Words in a part of the vocabulary, about; their counts are laid out at the same time. Parts are as many as the words need."""
BLOCK_DOCS = 4000
ALPHA = 0.5
"""Added to every class transition."""
DELTA = 0.1
"""Added to every word count, and the share of unseen words, as in the base model."""
WIDE = CLASSES + 1

Halves = tuple[DataFrame | None, DataFrame | None]
"""Tables of the classes of words of even and of odd keys: ``block`` and ``classes``, one byte a word in the order of the keys."""

BLOCK = "block long, ids array<long>, has_id array<boolean>, held array<boolean>, sizes array<int>, codes binary, keys binary, words array<binary>, seen array<int>"


def coded(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per block of documents: ids, lengths, token codes, the block's words, their keys and their counts in training texts."""
    return _coded(docs, held_out, id_col, text)[0]


def _coded(docs: DataFrame, held_out: Column, id_col: str, text: str) -> tuple[DataFrame, str]:
    """``coded`` and the name of the table it is in."""
    def run(batches):
        task, number = TaskContext.get().partitionId(), 0
        pack = zstandard.ZstdCompressor(level=3).compress
        for whole in batches:
            for lo in range(0, whole.num_rows, BLOCK_DOCS):
                batch = whole.slice(lo, BLOCK_DOCS)
                ids, held, bodies = (batch.column(k).to_pylist() for k in range(3))
                parts = [pa.array(space_words(b.lower() if b else None), pa.binary()) for b in bodies]
                sizes, found = np.array([len(p) for p in parts], np.int32), pa.concat_arrays(parts).dictionary_encode()
                # Words in the order of their keys: those of a part of the vocabulary stand together.
                keys = _buckets(found.dictionary.to_pylist())
                order = np.argsort(keys)
                rank = np.empty(len(order), np.uint32)
                rank[order] = np.arange(len(order), dtype=np.uint32)
                codes = rank[found.indices.to_numpy()]
                seen = np.bincount(codes[np.repeat(~np.array(held, bool), sizes)], minlength=len(keys)).astype(np.int32)
                row = [pa.array([(task << 32) + number]), _one([i or 0 for i in ids], pa.int64()), _one([i is not None for i in ids], pa.bool_()),
                       _one(held, pa.bool_()), _one(sizes, pa.int32()), pa.array([pack(_planes(codes))]), pa.array([keys[order].tobytes()]),
                       _one(found.dictionary.take(pa.array(order)), pa.binary()), _one(seen, pa.int32())]
                number += 1
                yield pa.RecordBatch.from_arrays(row, schema=BLOCK_ARROW)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), held_out.alias("held"), F.col(text).cast("binary").alias("body"))
    return _in_buckets(rows.mapInArrow(run, BLOCK))


def _in_buckets(blocks: DataFrame) -> tuple[DataFrame, str]:
    """``blocks`` written once, in buckets by number: joins by block shuffle the other side only."""
    spark, name = blocks.sparkSession, f"tidegraph_blocks_{uuid.uuid4().hex}"
    (blocks.write.bucketBy(width(spark), "block").format("parquet").option("compression", "zstd")
     .option("path", scratch_path(spark, "blocks")).saveAsTable(name))
    return spark.table(name), name


BLOCK_ARROW = pa.schema([("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("has_id", pa.list_(pa.bool_())), ("held", pa.list_(pa.bool_())),
                         ("sizes", pa.list_(pa.int32())), ("codes", pa.binary()), ("keys", pa.binary()),
                         ("words", pa.list_(pa.binary())), ("seen", pa.list_(pa.int32()))])


def _one(values, kind: pa.DataType) -> pa.ListArray:
    """A column of one row that holds ``values``."""
    values = values if isinstance(values, pa.Array) else pa.array(values, kind)
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _planes(codes: np.ndarray) -> bytes:
    return np.ascontiguousarray(codes.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _codes(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(4, -1).T).view("<u4").ravel()


def _buckets(words: list[bytes]) -> np.ndarray:
    """The 64-bit key of every word."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def _rows(batches, *columns: str):
    """Row by row, so that the Python objects of one block are there at a time."""
    for batch in batches:
        of = [batch.column(c) for c in columns]
        for k in range(batch.num_rows):
            yield [c[k].as_py() for c in of]


def vocabulary(blocks: DataFrame) -> DataFrame:
    """``word`` and ``n``, its count in the training texts; words of held-out texts only have 0."""
    each = blocks.select(F.explode(F.arrays_zip("words", "seen")).alias("e")).select("e.words", "e.seen")
    return settle(each.groupBy(F.col("words").alias("word")).agg(F.sum("seen").alias("n")), "vocabulary")


def _sequence(sizes: list[int], values: np.ndarray, end) -> tuple[np.ndarray, np.ndarray]:
    """Values of all texts one after the other with ``end`` behind each, and the place of each end."""
    ends = np.cumsum(np.array(sizes, np.int64) + 1) - 1
    out = np.full(len(values) + len(sizes), end, values.dtype)
    mask = np.ones(len(out), bool)
    mask[ends] = False
    out[mask] = values
    return out, ends


def _classed(blocks: DataFrame, classes: Halves) -> DataFrame:
    """``blocks`` with the packed classes of their words of even and of odd keys; null before the first sweep."""
    for name, half in zip(("even", "odd"), classes):
        if half is None:
            blocks = blocks.withColumn(name, F.lit(None).cast("binary"))
        else:
            blocks = blocks.join(half.select("block", F.col("classes").alias(name)).hint("shuffle_hash"), "block", "left")
    return blocks


def _own_classes(keys: np.ndarray, start: np.ndarray, *halves: bytes | None) -> np.ndarray:
    """Classes of a block's words; ``start`` has the keys of the words that are alone in their class at first."""
    out = np.full(len(keys), CLASSES - 1, np.uint8)
    for c, key in enumerate(start):
        out[keys == key] = c
    for parity, packed in enumerate(halves):
        if packed is not None:
            out[keys % np.uint64(2) == parity] = np.frombuffer(packed, np.uint8)
    return out


def _training(held: list[bool], sizes: list[int], codes: bytes, end: int) -> np.ndarray:
    """Codes of the training texts of a block one after the other with ``end`` behind each."""
    keep = np.repeat(~np.array(held, bool), np.array(sizes, np.int64))
    return _sequence([n for n, h in zip(sizes, held) if not h], _codes(codes)[keep], end)[0].astype(np.int64)


def _cells(row: np.ndarray, own: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """How often each row's word has each class to its left and right: places in a table of 2 * WIDE columns, and counts.

    Tokens whose ``row`` is negative are only neighbours.
    """
    before, after, word = np.concatenate([[END], own[:-1]]), np.append(own[1:], END), np.flatnonzero(row >= 0)
    places = row[word] * (2 * WIDE)
    places = np.concatenate([places + before[word], places + WIDE + after[word]])
    if rows * 2 * WIDE > 8 * len(places) + (1 << 20):
        return np.unique(places, return_counts=True)
    table = np.bincount(places, minlength=1)
    found = np.flatnonzero(table)
    return found, table[found]


SENT = "dest int, part int, block long, parity int, keys binary, old binary, sizes binary, cells binary, n binary"
SENT_ARROW = pa.schema([("dest", pa.int32()), ("part", pa.int32()), ("block", pa.int64()), ("parity", pa.int32()),
                        *((c, pa.binary()) for c in ("keys", "old", "sizes", "cells", "n"))])


def _neighbours(classed: DataFrame, start: np.ndarray, tasks: int, parts: int, turn: int) -> DataFrame:
    """Per block and part of the vocabulary: the movable words' keys and classes, and their neighbours' classes in the block, counted.

    Part -1 has the class bigrams of all that a task has read, once for each of the ``tasks`` that move words.
    """
    shared = classed.sparkSession.sparkContext.broadcast(start)

    def count(batches):
        pairs = np.zeros(WIDE * WIDE, np.int64)
        for block, held, sizes, codes, packed, even, odd in _rows(batches, "block", "held", "sizes", "codes", "keys", "even", "odd"):
            keys = np.frombuffer(packed, np.uint64)
            old = _own_classes(keys, shared.value, even, odd)
            at = _training(held, sizes, codes, len(keys))
            own = np.append(old, np.uint8(END))[at].astype(np.int64)
            if len(own):
                pairs += np.bincount(np.concatenate([[END], own[:-1]]) * WIDE + own, minlength=WIDE * WIDE)
            # In the first sweep all may move: nearly all start in one class.
            for parity in (0, 1) if turn == 0 else (turn % 2,):
                mine = np.flatnonzero(keys % np.uint64(2) == parity)
                if not len(mine):
                    continue
                number = np.full(len(keys) + 1, -1, np.int64)
                number[mine] = np.arange(len(mine))
                places, n = _cells(number[at], own, len(mine))
                each = np.bincount(places // (2 * WIDE), minlength=len(mine)).astype(np.uint8)
                cells, n = (places % (2 * WIDE)).astype(np.uint8), n.astype("<u4")
                own_keys, own_old = keys[mine], old[mine]
                part = ((own_keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
                first = np.flatnonzero(np.diff(part, prepend=-1))
                bounds, upto = np.append(first, len(mine)), np.concatenate([[0], np.cumsum(each, dtype=np.int64)])
                rows = [(int(part[lo]) * tasks // parts, int(part[lo]), block, parity, own_keys[lo:hi].tobytes(), own_old[lo:hi].tobytes(), each[lo:hi].tobytes(),
                         cells[upto[lo] : upto[hi]].tobytes(), n[upto[lo] : upto[hi]].tobytes()) for lo, hi in zip(bounds[:-1], bounds[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), SENT_ARROW)], schema=SENT_ARROW)
        if pairs.any():
            whole = [(dest, -1, 0, 0, b"", b"", b"", pairs.tobytes(), b"") for dest in range(tasks)]
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*whole), SENT_ARROW)], schema=SENT_ARROW)

    return classed.select("block", "held", "sizes", "codes", "keys", "even", "odd").mapInArrow(count, SENT)


def transitions(pairs: np.ndarray) -> np.ndarray:
    """Natural log of P(class | class before); rows are the class before."""
    return np.log((pairs + ALPHA) / (pairs.sum(axis=1, keepdims=True) + ALPHA * WIDE))


def exchange(counts: np.ndarray, classes: np.ndarray, pairs: np.ndarray, movable: np.ndarray) -> np.ndarray:
    """New classes of some words: each movable one goes where the training texts become most likely, the others fixed."""
    log_p, sizes = transitions(pairs), np.log(pairs.sum(axis=0)[:CLASSES] + 1.0)
    left, right = counts[:, :WIDE].astype(np.float64), counts[:, WIDE:].astype(np.float64)
    gain = left @ log_p[:, :CLASSES] + right @ log_p[:CLASSES].T - left.sum(axis=1, keepdims=True) * sizes
    best = gain.argmax(axis=1).astype(np.uint8)
    better = gain.max(axis=1) > gain[np.arange(len(classes)), classes] + 1e-9
    return np.where(movable & better & (left.sum(axis=1) > 0), best, classes).astype(np.uint8)


def likelihood(pairs: np.ndarray) -> float:
    """Log likelihood of the training texts in nats, but for the part that is the same whatever the classes."""
    total = lambda n: float((n * np.log(np.maximum(n, 1))).sum())
    return total(pairs) - total(pairs.sum(axis=0)) - total(pairs.sum(axis=1))


PAIRS, USED = -2, -1
"""Numbers of blocks whose ``classes`` are the class bigrams, and by how many training words each class has changed."""


def _moved_part(rows: list, pairs: np.ndarray) -> pa.RecordBatch:
    """New classes of the words of one part, for every block, and the change in the number of training words per class."""
    keys, old, sizes, cells, n = (np.frombuffer(b"".join(r[k] for r in rows), kind)
                                  for k, kind in ((4, np.uint64), (5, np.uint8), (6, np.uint8), (7, np.uint8), (8, "<u4")))
    words, first, where = np.unique(keys, return_index=True, return_inverse=True)
    of = np.repeat(where, sizes)
    order = np.argsort(of, kind="stable")
    of, cells, n = of[order], cells[order], n[order]
    classes, used = old[first], np.zeros(CLASSES, np.int64)
    for lo in range(0, len(words), PART_WORDS):
        hi = min(lo + PART_WORDS, len(words))
        a, b = np.searchsorted(of, [lo, hi])
        counts = np.bincount((of[a:b] - lo) * (2 * WIDE) + cells[a:b], n[a:b], (hi - lo) * 2 * WIDE).reshape(-1, 2 * WIDE)
        before, trained = classes[lo:hi].copy(), counts[:, :WIDE].sum(axis=1) > 0
        classes[lo:hi] = exchange(counts, before, pairs, np.ones(hi - lo, bool))
        used += np.bincount(classes[lo:hi][trained], minlength=CLASSES) - np.bincount(before[trained], minlength=CLASSES)
    back, at, out = classes[where].tobytes(), 0, [(USED, rows[0][1], 0, used.tobytes())]
    for r in rows:
        out.append((r[2], r[1], r[3], back[at : at + len(r[5])]))
        at += len(r[5])
    return _sent_back(out)


def _sent_back(rows: list) -> pa.RecordBatch:
    block, part, parity, packed = zip(*rows)
    return pa.RecordBatch.from_pydict({"block": pa.array(block, pa.int64()), "part": pa.array(part, pa.int32()), "parity": pa.array(parity, pa.int32()),
                                       "classes": pa.array(packed, pa.binary())})


def _sweep(classed: DataFrame, start: np.ndarray, parts: int, turn: int) -> DataFrame:
    """``block``, ``parity`` and the new ``classes`` of the block's words of such keys, with the rows PAIRS and USED."""
    tasks = min(width(classed.sparkSession), parts)

    def move(batches):
        dest, part, pairs, rows = None, None, None, []
        for row in _rows(batches, *SENT_ARROW.names):
            if row[1] != part and rows:
                yield _moved_part(rows, pairs)
                rows = []
            if row[0] != dest:
                dest, pairs = row[0], np.zeros((WIDE, WIDE), np.int64)
            if row[1] == -1:
                pairs += np.frombuffer(row[7], np.int64).reshape(WIDE, WIDE)
            else:
                if part == -1:
                    yield _sent_back([(PAIRS, dest, 0, pairs.tobytes())])
                rows.append(row)
            part = row[1]
        if rows:
            yield _moved_part(rows, pairs)
        elif part == -1:
            yield _sent_back([(PAIRS, dest, 0, pairs.tobytes())])

    def gather(rows):
        import pandas as pd

        block, packed = rows["block"].iloc[0], list(rows.sort_values("part")["classes"])
        if block == USED:
            whole = sum(np.frombuffer(x, np.int64) for x in packed).tobytes()
        else:
            whole = packed[0] if block == PAIRS else b"".join(packed)
        return pd.DataFrame({"block": [block], "parity": [rows["parity"].iloc[0]], "classes": [whole]})

    # Parts come one after the other, the bigrams ahead of them, so a task holds one part at a time.
    sent = _neighbours(classed, start, tasks, parts, turn).repartition(tasks, "dest").sortWithinPartitions("dest", "part")
    back = sent.mapInArrow(move, "block long, part int, parity int, classes binary")
    return stored(back.groupBy("block", "parity").applyInPandas(gather, "block long, parity int, classes binary"), "classes")


def _counts_in(sweep: DataFrame, block: int, size: int) -> np.ndarray:
    row = sweep.where(F.col("block") == block).first()
    return np.frombuffer(row["classes"], np.int64) if row else np.zeros(size, np.int64)


def _class_bigrams(sweep: DataFrame) -> np.ndarray:
    """Class bigrams of the training texts under the classes that the sweep has started from."""
    return _counts_in(sweep, PAIRS, WIDE * WIDE).reshape(WIDE, WIDE)


def cluster(blocks: DataFrame, vocab: DataFrame, tolerance: float = TOLERANCE) -> tuple[Halves, np.ndarray, np.ndarray, np.ndarray]:
    """Classes of every block's words, the class bigrams under them, training words per class, and the keys it starts with.

    It starts with each of the most frequent words (one fewer than classes) alone and all others together (no table of
    classes), sweeps while that pays, and returns the most likely classes it has seen.
    """
    top = vocab.where(F.col("n") > 0).orderBy(F.desc("n"), "word").limit(CLASSES - 1).collect()
    start = _buckets([bytes(r["word"]) for r in top])
    used = np.zeros(CLASSES, np.int64)
    used[: len(top)] = 1
    used[CLASSES - 1] = vocab.where(F.col("n") > 0).count() - len(top)
    parts = max(1, -(-vocab.count() // PART_WORDS))
    classes, turn, flat, best, most = (None, None), 0, 0, None, 0.0
    while True:
        sweep = _sweep(_classed(blocks, classes), start, parts, turn)
        pairs = _class_bigrams(sweep)
        now = likelihood(pairs)
        if best is not None:
            flat = 0 if now - most > tolerance * pairs.sum() else flat + 1
        if best is None or now > most:
            best, most = (classes, pairs, used), now
        if flat == 2:
            return *best, start
        used = used + _counts_in(sweep, USED, CLASSES)
        moved = [sweep.where((F.col("block") >= 0) & (F.col("parity") == parity)) for parity in (0, 1)]
        classes = tuple(moved[p] if turn == 0 or turn % 2 == p else classes[p] for p in (0, 1))
        turn += 1


class WordClasses:
    """``table`` has every word's ``key`` and ``class``. Indexing by key is for looking at small models: it collects the table."""

    def __init__(self, table: DataFrame):
        self.table, self._found = table, None

    def __getitem__(self, key) -> int:
        if self._found is None:
            self._found = {r["key"] % (1 << 64): r["class"] for r in self.table.collect()}
        return self._found[int(key)]


def _word_classes(classed: DataFrame, start: np.ndarray) -> WordClasses:
    def run(batches):
        for packed, even, odd in _rows(batches, "keys", "even", "odd"):
            keys = np.frombuffer(packed, np.uint64)
            yield pa.RecordBatch.from_pydict({"key": pa.array(keys.view(np.int64)), "class": pa.array(_own_classes(keys, start, even, odd).astype(np.int32))})

    return WordClasses(classed.select("keys", "even", "odd").mapInArrow(run, "key long, class int").distinct())


class Model(NamedTuple):
    """The classes of words, by block and by word, and what scoring needs besides them, whose size does not depend on the corpus."""

    classes: WordClasses | None
    classed: DataFrame | None
    pairs: np.ndarray
    class_words: np.ndarray
    class_tokens: np.ndarray
    tokens: int
    distinct: int
    texts: int
    start: np.ndarray


def fit(blocks: DataFrame, vocab: DataFrame, tolerance: float = TOLERANCE) -> Model:
    classes, pairs, used, start = cluster(blocks, vocab, tolerance)
    classed, class_tokens, texts = _classed(blocks, classes), pairs.sum(axis=0), int(pairs[:, END].sum())
    class_words = np.append(used, int(texts > 0))
    return Model(_word_classes(classed, start), classed, pairs, class_words, class_tokens, int(class_tokens.sum()), int(class_words.sum()), texts, start)


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def scores(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text: str = "text", tolerance: float = TOLERANCE) -> DataFrame:
    """Learn from the texts that are not held out and score every whole text.

    A-Z is lower-cased, words are runs of non-space, and an end follows every text and counts as a token. ``base_score`` is the
    log10 probability under smoothed word counts, ``score`` under the class model; ``n_known`` counts tokens seen in
    training. Null texts are empty and consist of their end. A null ``held_out`` is training. Repeated rows count and
    are scored as often as they occur. Without training texts every probability is the smoothing's.
    """
    blocks, table = _coded(docs, F.coalesce(held_out, F.lit(False)), id_col, text)
    vocab = vocabulary(blocks)
    model = fit(blocks, vocab, tolerance)
    entries = blocks.select("block", F.posexplode("words").alias("at", "word"))
    known = entries.join(vocab, "word").select("block", "at", "n")

    def gather(rows):
        import pandas as pd

        counts = np.zeros(len(rows), np.int64)
        counts[rows["at"]] = rows["n"]
        return pd.DataFrame({"block": [rows["block"].iloc[0]], "counts": [counts.tobytes()]})

    counts = known.groupBy("block").applyInPandas(gather, "block long, counts binary")
    shared = docs.sparkSession.sparkContext.broadcast(model._replace(classes=None, classed=None))

    def score(batches):
        m = shared.value
        step = transitions(m.pairs) / math.log(10)
        empty = np.zeros(0, np.int64)
        for ids, has_id, held, sizes, packed, keys, even, odd, blob in _rows(
                batches, "ids", "has_id", "held", "sizes", "codes", "keys", "even", "odd", "counts"):
            keys = np.frombuffer(keys, np.uint64)
            codes = _codes(packed)
            n = np.frombuffer(blob, np.int64)[codes] if blob else empty
            at, ends = _sequence(sizes, codes, len(keys))
            n, _ = _sequence(sizes, n, m.texts)
            own = np.append(_own_classes(keys, m.start, even, odd), np.uint8(END))[at]
            before = np.concatenate([[END], own[:-1]])
            starts = np.concatenate([[0], ends[:-1] + 1])
            base = np.log10((n + DELTA) / (m.tokens + DELTA * (m.distinct + 1)))
            emit = np.log10((n + DELTA) / (m.class_tokens + DELTA * (m.class_words + 1))[own])
            total = lambda x: np.add.reduceat(x, starts)
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array(ids, pa.int64(), mask=~np.array(has_id, bool)), "held_out": pa.array(held, pa.bool_()),
                "n_tokens": pa.array(np.array(sizes, np.int64) + 1), "n_known": pa.array(total((n > 0).astype(np.int64))),
                "train_tokens": pa.array(np.full(len(ids), m.tokens, np.int64)), "base_score": pa.array(total(base)),
                "score": pa.array(total(step[before, own] + emit))})

    out = stored(model.classed.select("block", "ids", "has_id", "held", "sizes", "codes", "keys", "even", "odd")
                 .join(counts.hint("shuffle_hash"), "block", "left").drop("block").mapInArrow(score, SCORES), "scores")
    docs.sparkSession.sql(f"DROP TABLE {table}")
    return out
