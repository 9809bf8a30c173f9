"""What the text operators share: batches of whole texts through Python, words, and small frames."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..session import scratch_path

CACHE_WORDS = 200_000
"""Distinct words that a Python worker remembers before it starts anew; a bound on memory, not on what is processed."""

TEXTS_AT_ONCE = 500
"""Texts whose Python objects are held at the same time; larger batches are worked on in slices."""

_FOLD = bytes(range(256)).lower()
_WORD_BYTES = frozenset(b"0123456789abcdefghijklmnopqrstuvwxyz") | set(range(0x80, 0x100))
_ALNUM = bytes(_FOLD[b] if _FOLD[b] in _WORD_BYTES else 0x20 for b in range(256))


def over_texts(docs: DataFrame, text: str, result: T.StructType, make: Callable[[], Callable[[list], pa.StructArray]],
               keep: list[str] | None = None) -> DataFrame:
    """Columns ``row`` (all columns of ``docs``, or those in ``keep``) and ``result``, computed batch by batch without moving rows.

    ``make`` is called once per task and returns a function from UTF-8 texts (None for null) to one
    struct per text. Spark bounds a batch by bytes and rows, so memory does not grow with the table.
    The input columns stay inside ``row``, so none can clash with those of the operator.
    """
    carried = docs.select(*keep) if keep else docs
    schema = T.StructType([T.StructField("row", carried.schema), T.StructField("result", result)])

    def run(batches):
        work = make()
        for whole in batches:
            for lo in range(0, whole.num_rows, TEXTS_AT_ONCE):
                batch = whole.slice(lo, TEXTS_AT_ONCE)
                yield pa.RecordBatch.from_arrays([batch.column(0), work(batch.column(1).to_pylist())], names=["row", "result"])

    return docs.select(F.struct(*carried.columns).alias("row"), F.col(text).cast("binary").alias("body")).mapInArrow(run, schema)


def flat(df: DataFrame, *names: str) -> DataFrame:
    """The input columns in front, then the result's; of equal names the result's stays."""
    kept, made = df.schema["row"].dataType.names, list(names) or df.schema["result"].dataType.names
    taken = {x.lower() for x in made}
    return df.select(*[F.col(f"row.`{c}`") for c in kept if c.lower() not in taken], *[F.col(f"result.`{c}`") for c in made])


def structs(**columns) -> pa.StructArray:
    return pa.StructArray.from_arrays(list(columns.values()), names=list(columns))


def space_words(body: bytes | None) -> list[bytes]:
    """Maximal runs of anything but space and the controls 9 to 13."""
    return body.split() if body else []


def alnum_words(body: bytes | None) -> list[bytes]:
    """Maximal runs of ASCII letters, ASCII digits and non-ASCII characters, A-Z lower-cased."""
    return body.translate(_ALNUM).split() if body else []


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_PIECE = 1 << 19
_SPACE = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))
_BYTE = mixed(np.arange(1, 257, dtype=np.uint64))
_STEP = 0xD1342543DE82EF95
_POWERS, _INVERSES = (np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(_PIECE, x, np.uint64))])
                      for x in (np.uint64(_STEP), np.uint64(pow(_STEP, -1, 1 << 64))))


def word_hashes(body: bytes | None) -> np.ndarray:
    """A 64-bit hash of every word of ``space_words``, in order, without making the words.

    Sums of hashed bytes times powers run over a piece of the text; a word's hash is the difference of two of them, shifted
    to its start. Pieces end between words, so memory is bounded; a word longer than a piece is hashed by itself.
    """
    out, at = [], 0
    body = body or b""
    while at < len(body):
        piece = body[at : at + _PIECE]
        if at + len(piece) < len(body) and not _SPACE[body[at + len(piece)]]:
            cut = max(piece.rfind(x) for x in (b" ", b"\t", b"\n", b"\r", b"\x0b", b"\x0c"))
            if cut < 0:
                word = body[at:].split(None, 1)[0]
                out.append(np.array([xxhash.xxh3_64_intdigest(word)], np.uint64))
                at += len(word)
                continue
            piece = piece[: cut + 1]
        at += len(piece)
        codes = np.frombuffer(piece, np.uint8)
        space = np.concatenate([[True], _SPACE[codes], [True]])
        change = np.flatnonzero(space[1:] != space[:-1])
        starts, ends = change[0::2], change[1::2]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[codes] * _POWERS[: len(codes)])])
        out.append(mixed((sums[ends] - sums[starts]) * _INVERSES[starts] + (ends - starts).astype(np.uint64)))
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def rolled(hashes: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of every ``n`` consecutive words, by position of the first; runs are put together from halves."""
    size = len(hashes) - n + 1
    if size < 1:
        return np.empty(0, np.uint64)
    part, length, out, done = mixed(hashes + np.uint64(0x9E3779B97F4A7C15 * (seed + 1) % (1 << 64))), 1, None, 0
    while True:
        if n & length:
            own = part[done : done + size]
            out, done = own if out is None else mixed(out * np.uint64(0xD1342543DE82EF95) + own), done + length
        if length * 2 > n:
            return out
        part = mixed(part[:-length] * np.uint64(0xD1342543DE82EF95) + part[length:])
        length *= 2


def crc_part(id_column: str | Column, parts: int) -> Column:
    """crc32 of an id written as text, modulo ``parts``; null ids count as empty text."""
    column = F.col(id_column) if isinstance(id_column, str) else id_column
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % parts


def lists(values: list, kind: pa.DataType) -> pa.ListArray:
    return pa.array(values, pa.list_(kind))


def stored(df: DataFrame, label: str) -> DataFrame:
    """``settle`` with the denser compression, for tables that hold texts or packed numbers."""
    path = scratch_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
