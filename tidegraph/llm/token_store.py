"""Token ids in a binary store: every document compressed on its own with one shared zstandard dictionary.

Layout of a store (a folder of Parquet tables):

* ``dictionary``: one row, ``sha256`` and ``dictionary`` (empty bytes where there was too little to train on)
* ``shards``: one row per shard of consecutive documents in ascending order of the id: ``part``, ``shard``, ``first_id``,
  ``last_id``, ``n_docs``, ``dictionary_sha256``, ``index`` and ``data``.

``data`` holds the frames of the documents one after the other; ``index`` is an array of records
(doc_id int64, has_id int64, start int64, n_tokens int64, offset int64, length int64), little endian, so a
document is read by slicing one frame. Ids in a frame are little-endian unsigned 32-bit integers, end id included,
stored byte plane by byte plane (all lowest bytes first), which zstandard compresses better.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..session import settle, width
from .common import CACHE_WORDS, flat, over_texts, structs

DICTIONARY_DOCS = 300
"""Documents (of least hash) whose ids train the dictionary; a fit on a bounded sample that changes sizes, never ids."""
DICTIONARY_CHARS = 20_000
"""Longest text in that sample."""
DICTIONARY_BYTES = 64 * 1024
SHARD_BYTES = 1 << 20
"""Compressed bytes after which a shard is closed; a single longer document makes a longer shard."""

RECORD = np.dtype([("doc_id", "<i8"), ("has_id", "<i8"), ("start", "<i8"), ("n_tokens", "<i8"), ("offset", "<i8"), ("length", "<i8")])
SHARD = "part int, shard int, first_id long, last_id long, n_docs long, dictionary_sha256 string, index binary, data binary"


class ChunkIds(dict):
    """Ids of every distinct run of non-space bytes as packed uint32, each encoded once by the tokenizer.

    White space is dropped by the tokenizer's own splitting and no token or special token holds any, so
    the ids of a text are those of its runs one after the other. A run that is a word of Latin letters with
    ASCII punctuation behind it splits further at that place, and the word goes to the tokenizer's
    BPE model in lower case with its UTF-8 bytes spelled as the byte-level splitter spells them; this holds for tokenizers that
    lower-case and split letters from punctuation, which is checked on a sample of words when the tokenizer is loaded.
    """

    def __init__(self, tokenizer_json: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer, self.words, self.tails = Tokenizer.from_str(tokenizer_json), {}, {}
        self.model = self.tokenizer.model
        probes = ["Straße,", "École.", "the", "The;", "ñandú!?", "Übergrößen).", "a", "XYZ:", "don,", "s,", "Œuvre.", "İz.", "US$", "AT&", "é%%%", "les&&&", "C#,"]
        self.by_word = all(self._split(x) in (None, self._whole(x)) for x in probes)

    def _whole(self, run: str) -> bytes:
        return _packed(self.tokenizer.encode(run, add_special_tokens=False).ids)

    def _split(self, run: str) -> bytes | None:
        """Ids of a Latin word with punctuation behind it; None for any other run."""
        word = run.rstrip(TAIL)
        plain = word.isascii()
        if not word.isalpha() or not plain and (max(word) > LATIN or "\u0130" in word):
            return None
        tail, word = run[len(word) :], word.lower()
        if tail and tail not in self.tails:
            self.tails[tail] = self._whole(tail)
        ids = self._word(word, plain)
        return ids + self.tails[tail] if tail else ids

    def _word(self, word: str, plain: bool) -> bytes:
        ids = self.words.get(word)
        if ids is None:
            if len(self.words) >= 2 * CACHE_WORDS:
                self.words.clear()
            spelled = word if plain else word.encode().decode("latin-1").translate(BYTE_LEVEL)
            ids = self.words[word] = _packed([t.id for t in self.model.tokenize(spelled)])
        return ids

    def __missing__(self, run: bytes) -> bytes:
        if self.by_word and run.isalpha():
            # Of bytes, only ASCII letters are letters.
            ids = self._word(run.lower().decode("ascii"), True)
        else:
            text = run.decode()
            ids = self._split(text) if self.by_word else None
            if ids is None:
                ids = self._whole(text)
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[run] = ids
        return ids

    def of(self, bodies: list) -> list[bytes]:
        return [b"".join(map(self.__getitem__, body.split())) if body else b"" for body in bodies]


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


TAIL = ".,;:!?)]}\"-/|*&%$#"
LATIN = "\u024f"
# How the byte-level splitter spells bytes: printable ones as themselves, the others from U+0100 on, in order.
_PLAIN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_LEVEL = {b: 0x100 + i for i, b in enumerate(b for b in range(256) if b not in _PLAIN)}


def planes(ids: bytes) -> bytes:
    return np.ascontiguousarray(np.frombuffer(ids, np.uint8).reshape(-1, 4).T).tobytes()


def unplanes(data: bytes) -> bytes:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).tobytes()


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if data else None


def train_dictionary(docs: DataFrame, tokenizer_json: str, id_col: str, text: str) -> bytes:
    """A dictionary from the ids of at most ``DICTIONARY_DOCS`` documents; empty where they are too few."""
    fit = docs.where(F.length(text).between(1, DICTIONARY_CHARS)).select(F.xxhash64(id_col).alias("_h"), F.col(text).alias("_t"))
    # The cut is found on the hashes alone, so that only the texts of the sample come to the driver.
    cut = fit.select("_h").orderBy("_h").limit(DICTIONARY_DOCS).agg(F.max("_h")).first()[0]
    sample = fit.where(F.col("_h") <= cut).limit(2 * DICTIONARY_DOCS).collect() if cut is not None else []
    sample = sorted(r["_t"] for r in sample)
    ids = [planes(x) for x in ChunkIds(tokenizer_json).of([x.encode() for x in sample])]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, ids).as_bytes()
    except zstandard.ZstdError:
        return b""


def write_store(docs: DataFrame, path: str, tokenizer_json: str, end_id: int, id_col: str = "doc_id", text: str = "text",
                shard_bytes: int = SHARD_BYTES) -> None:
    """Encode every whole text, append ``end_id`` and write the store to ``path``.

    Null texts are empty and hold the end id only. Ids are in ascending order, null ids first; rows of equal id keep
    an order by their frames. An empty table makes a store without shards. Columns other than the two are not used.
    """
    spark = docs.sparkSession
    dictionary = train_dictionary(docs, tokenizer_json, id_col, text)
    name = hashlib.sha256(dictionary).hexdigest()
    spark.createDataFrame([(name, dictionary)], "sha256 string, dictionary binary").coalesce(1).write.parquet(f"{path}/dictionary")
    shared = spark.sparkContext.broadcast((tokenizer_json, dictionary))
    end = np.array([end_id], "<u4").tobytes()

    def make():
        chunks = ChunkIds(shared.value[0])
        pack = zstandard.ZstdCompressor(level=3, dict_data=_dictionary(shared.value[1]), write_checksum=False).compress

        def work(bodies):
            ids = [x + end for x in chunks.of(bodies)]
            return structs(n_tokens=pa.array([len(x) // 4 for x in ids], pa.int64()),
                           frame=pa.array([pack(planes(x)) for x in ids], pa.binary()))
        return work

    kind = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("frame", T.BinaryType())])
    frames = settle(flat(over_texts(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text")), "text", kind, make,
                                    keep=["id"])), "frames")
    parts = 4 * width(spark)
    cuts = sorted({int(x) for x in (frames.approxQuantile("id", [k / parts for k in range(1, parts)], 0.2 / parts) or [])})
    # The part of an id is the number of cuts at or below it; null ids are in the first.
    frames = frames.withColumn("part", _part(F.col("id"), cuts))
    totals = {r["part"]: r["n"] for r in frames.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()}
    before, starts = 0, {}
    for part in sorted(totals):
        starts[part] = before
        before += totals[part]

    def shards(batches):
        part, number, start, records, data, at = None, 0, 0, [], [], 0

        def close():
            index = np.array(records, RECORD)
            ids = index["doc_id"][index["has_id"] == 1]
            lo, hi = (int(ids[0]), int(ids[-1])) if len(ids) else (None, None)
            return pa.RecordBatch.from_pylist([{"part": part, "shard": number, "first_id": lo, "last_id": hi, "n_docs": len(records),
                                                "dictionary_sha256": name, "index": index.tobytes(), "data": b"".join(data)}], schema=SHARD_ARROW)

        for batch in batches:
            for p, i, n, frame in zip(*[batch.column(k).to_pylist() for k in range(4)]):
                if p != part or at >= shard_bytes:
                    if records:
                        yield close()
                    number, start = (0, starts[p]) if p != part else (number + 1, start)
                    part, records, data, at = p, [], [], 0
                records.append((i or 0, i is not None, start, n, at, len(frame)))
                data.append(frame)
                at += len(frame)
                start += n
        if records:
            yield close()

    ordered = (frames.select("part", "id", "n_tokens", "frame").repartition(max(1, len(cuts) + 1), "part")
               .sortWithinPartitions("part", F.col("id").asc_nulls_first(), "frame"))
    ordered.mapInArrow(shards, SHARD).write.parquet(f"{path}/shards")


SHARD_ARROW = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("first_id", pa.int64()), ("last_id", pa.int64()), ("n_docs", pa.int64()),
                         ("dictionary_sha256", pa.string()), ("index", pa.binary()), ("data", pa.binary())])


def _part(value: Column, cuts: list[int]) -> Column:
    if not cuts:
        return F.lit(0)
    known = F.array(*[F.lit(x).cast("long") for x in cuts])
    return F.when(value.isNull(), 0).otherwise(F.size(F.filter(known, lambda x: x <= value)))


def read_store(spark: SparkSession, path: str, result: str, digest, ids: list[int] | None = None) -> DataFrame:
    """``doc_id``, ``start``, ``n_tokens`` and what ``digest`` makes of the ids of each document (little-endian uint32 bytes).

    With ``ids`` only shards that can hold them are read, and only their frames are decompressed.
    """
    shards = spark.read.parquet(f"{path}/shards")
    if ids is not None:
        hits = F.lit(False)
        for x in ids:
            hits = hits | F.lit(x).between(F.col("first_id"), F.col("last_id"))
        shards = shards.where(hits)
    known = {r["sha256"]: bytes(r["dictionary"]) for r in spark.read.parquet(f"{path}/dictionary").collect()}
    wanted = None if ids is None else np.array(sorted(ids), np.int64)
    names = [x.strip().split(" ")[0] for x in result.split(",")]

    def read(batches):
        for batch in batches:
            for sha, index, data in zip(*[batch.column(k).to_pylist() for k in range(3)]):
                unpack = zstandard.ZstdDecompressor(dict_data=_dictionary(known[sha])).decompress
                records = np.frombuffer(index, RECORD)
                if wanted is not None:
                    records = records[(records["has_id"] == 1) & np.isin(records["doc_id"], wanted)]
                if not len(records):
                    continue
                made = [digest(unplanes(unpack(data[o : o + n]))) for o, n in zip(records["offset"].tolist(), records["length"].tolist())]
                ids_ = pa.array(records["doc_id"], pa.int64(), mask=records["has_id"] == 0)
                yield pa.RecordBatch.from_arrays([ids_, pa.array(records["start"]), pa.array(records["n_tokens"]), pa.array(made)],
                                                 names=["doc_id", "start", "n_tokens", *names])

    return shards.select("dictionary_sha256", "index", "data").mapInArrow(read, f"doc_id long, start long, n_tokens long, {result}")


def crc(ids: bytes) -> int:
    return zlib.crc32(ids)


def id_list(ids: bytes) -> list[int]:
    return np.frombuffer(ids, "<u4").astype(np.int64).tolist()
