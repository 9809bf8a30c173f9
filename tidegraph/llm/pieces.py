"""SentencePiece encoding and decoding by a table of distinct chunks."""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from .common import CACHE_WORDS, over_texts, structs

MARK = "▁"
_CHUNK = re.compile(f"{MARK}+[^{MARK}]*")

CODED = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType()))])


class ChunkTable(dict):
    """Ids of every distinct marked word, each segmented once by the library.

    Valid when no piece has a marker behind another character and the normaliser leaves texts as they are
    (both are checked on the model): then no merge crosses from a word into the next marker, and the ids of
    a text are those of its chunks (markers, then a word) joined by position. Every text begins with a marker,
    since the library puts one in front; a chunk is encoded without its first marker for the same reason.
    Models of another kind are encoded text by text.
    """

    def __init__(self, model: bytes):
        import sentencepiece

        super().__init__()
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = self.library.get_piece_size()
        pieces = [self.library.id_to_piece(i) for i in range(size)]
        odd = [p for i, p in enumerate(pieces) if not (self.library.is_control(i) or self.library.is_unknown(i) or self.library.is_byte(i))
               and MARK in p.lstrip(MARK)]
        probes = ["  a  b ", "ﬁ　x ", "\n\t", " "]
        plain = all(self.library.normalize(p) == (MARK + p).replace(" ", MARK) for p in probes)
        self.by_chunk = not odd and plain and not any(self.library.is_unused(i) for i in range(size))
        self.end = self.library.eos_id()
        self.lone = self.library.piece_to_id(MARK)

    def __missing__(self, chunk: str) -> tuple[int, ...]:
        if len(self) >= CACHE_WORDS:
            self.clear()
        ids = [self.lone] if chunk == MARK else self.library.encode(chunk[1:], num_threads=1)
        value = self[chunk] = tuple(ids)
        return value

    def encode(self, text: str) -> list[int]:
        if not text or not self.by_chunk:
            return [*self.library.encode(text, num_threads=1), self.end]
        ids: list[int] = []
        for chunk in map(self.__getitem__, _CHUNK.findall((MARK + text).replace(" ", MARK))):
            ids += chunk
        ids.append(self.end)
        return ids


def encoded(docs: DataFrame, model: bytes, text: str = "text", keep: list[str] | None = None, decode: bool = False) -> DataFrame:
    """``row`` and ``result.ids`` (with the end id) of every whole text, and ``result.decoded`` if asked for.

    Null texts are empty: the end id only, decoded to nothing. The model is a file of fixed size, sent once to each executor.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = T.StructType([*CODED.fields, *([T.StructField("decoded", T.StringType())] if decode else [])])

    def make():
        table = ChunkTable(shared.value)

        def work(bodies):
            ids = [table.encode(body.decode() if body else "") for body in bodies]
            out = {"ids": pa.array(ids, pa.list_(pa.int32()))}
            if decode:
                out["decoded"] = pa.array([table.library.decode(x) for x in ids], pa.string())
            return structs(**out)
        return work

    return over_texts(docs, text, kind, make, keep)


DIGEST = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()),
                       T.StructField("decoded_sha256", T.StringType())])


def digests(docs: DataFrame, model: bytes, text: str = "text", keep: list[str] | None = None, with_ids: bool = False) -> DataFrame:
    """Lengths and digests of ids and decoded texts, made where the ids are, so ids need not leave the task unless asked for."""
    kind = T.StructType([*CODED.fields, *DIGEST.fields]) if with_ids else DIGEST
    shared = docs.sparkSession.sparkContext.broadcast(model)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()

    def make():
        table = ChunkTable(shared.value)

        def work(bodies):
            ids = [table.encode(body.decode() if body else "") for body in bodies]
            more = {"ids": pa.array(ids, pa.list_(pa.int32()))} if with_ids else {}
            return structs(**more, n_tokens=pa.array(map(len, ids), pa.int64()),
                           ids_sha256=pa.array([sha(" ".join(map(str, x))) for x in ids]),
                           decoded_sha256=pa.array([sha(table.library.decode(x)) for x in ids]))
        return work

    return over_texts(docs, text, kind, make, keep)
