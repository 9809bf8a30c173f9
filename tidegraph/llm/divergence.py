"""How far the sources of a language differ in their words, by a quadtree over the matrix of sources and terms.

The terms a language keeps are dealt to column blocks. A block of the matrix (sources by terms) is held as a K-squared
tree: every level halves rows and columns and has one bit per quadrant that holds a count. Two row ranges are traversed
jointly over the same columns. Where both quadrants are empty nothing below them is looked at: every term there has each
source's probability of an unseen term, so the quadrant is priced by its number of columns. Only leaves with a count in one
of the two rows are compared term by term. Columns that no block shows to a pair of row tiles are priced at the end in
the same way, by their number. All numbers are whole.

Rows go in tiles of ``TILE`` sources and columns in blocks of about ``BLOCK_CELLS`` counts, so a task's matrix is bounded
whatever the numbers of sources and terms are, and blocks are made by a hash of the term, so none is hot.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.skew import top_rows, with_small
from ..session import settle
from .common import stored

MIN_DOCS = 3
TOP_TERMS = 200
SCALE = 1_000_000_000
TILE = 64
BLOCK_CELLS = 1 << 16
TERMS_HELD = 300_000
"""Distinct (source, term) pairs that a task adds up before it sends them on; a bound on memory."""
START_LEVEL = 10
"""Quadrants are traversed in strips of 2 ** START_LEVEL columns, which bounds the pairs of quadrants held at a time."""

_TERM_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def terms_of(body: bytes | None) -> list[bytes]:
    """Maximal runs of ASCII letters and non-ASCII characters, A-Z lower-cased."""
    return body.translate(_TERM_BYTES).split() if body else []


def term_counts(docs: DataFrame) -> DataFrame:
    """``lang``, ``source``, ``term``, its occurrences ``n`` and the documents ``docs`` that have it, added up within each task."""
    def run(batches):
        counts, seen, held = defaultdict(Counter), defaultdict(Counter), 0

        def sent():
            for (lang, source), n in counts.items():
                of = seen[lang, source]
                yield pa.RecordBatch.from_arrays([
                    pa.array([lang] * len(n), pa.string()), pa.array([source] * len(n), pa.string()),
                    pa.array(list(n), pa.binary()).cast(pa.string()), pa.array(list(n.values()), pa.int64()),
                    pa.array([of[t] for t in n], pa.int64())], schema=_COUNTS)
            counts.clear()
            seen.clear()

        for batch in batches:
            for lang, source, body in zip(*(batch.column(k).to_pylist() for k in range(3))):
                terms = terms_of(body)
                of = counts[lang, source]
                held -= len(of)
                of.update(terms)
                held += len(of)
                seen[lang, source].update(set(terms))
                if held > TERMS_HELD:
                    yield from sent()
                    held = 0
        yield from sent()

    return docs.mapInArrow(run, "lang string, source string, term string, n long, docs long")


def _share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / (total + terms)); decimals keep the product exact."""
    product = F.lit(SCALE).cast("decimal(10,0)") * (F.coalesce(count, F.lit(0)) + 1).cast("decimal(20,0)")
    return F.lit(1).cast("long") + F.call_function("div", product, (total + terms).cast("decimal(20,0)"))


def _distance(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def distances(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def quadtree(filled: np.ndarray) -> list[np.ndarray]:
    """Bits of every level, leaves first: whether a square of side 2 ** level has a filled cell. Sides are powers of two."""
    levels = [filled]
    while max(levels[-1].shape) > 1:
        top = levels[-1]
        if top.shape[0] > 1:
            top = top[0::2] | top[1::2]
        if top.shape[1] > 1:
            top = top[:, 0::2] | top[:, 1::2]
        levels.append(top)
    return levels


def _spread(totals: np.ndarray, rows: int) -> np.ndarray:
    return np.repeat(np.repeat(totals, rows // len(totals), axis=0), rows // len(totals), axis=1)


def traverse(shares: np.ndarray, filled: np.ndarray, unseen: np.ndarray, cross: int = 0) -> np.ndarray:
    """Sums of ``distances(row g, row h)`` over the columns, for all ordered pairs of rows.

    ``shares`` has the probabilities (rows and columns padded to powers of two), ``filled`` where there is a count, and
    ``unseen`` each row's probability elsewhere. With ``cross`` only pairs of a row before it and one from it on count.
    """
    rows, columns = filled.shape
    levels = quadtree(filled)
    forth, back = np.zeros(rows * rows, np.int64), np.zeros(rows * rows, np.int64)
    empty = np.zeros((rows, rows), np.int64)
    top = max(min(START_LEVEL, len(levels) - 1), rows.bit_length() - 1)
    for strip in range(max(1, columns >> top)):
        a = b = np.zeros(1, np.int64)
        c = np.full(1, strip, np.int64)
        for level in range(top, -1, -1):
            if cross and 1 << level == cross:
                keep = (a == 0) & (b == 1)
                a, b, c = a[keep], b[keep], c[keep]
            bits = levels[min(level, len(levels) - 1)]
            wide, side = bits.shape[1], max(1, rows >> level)
            some = bits[a, np.minimum(c, wide - 1)] | bits[b, np.minimum(c, wide - 1)]
            # A quadrant may be wider than the matrix when there are more rows than columns.
            if not some.all():
                none = ~some
                found = np.bincount(a[none] * side + b[none], minlength=side * side).reshape(side, side)
                empty += _spread(found * min(1 << level, columns), rows)
                a, b, c = a[some], b[some], c[some]
            if not level:
                break
            halves_r, halves_c = (2 if rows >= 1 << level else 1), (2 if columns >= 1 << level else 1)
            parts = []
            for x in range(halves_r):
                for y in range(halves_r):
                    # Of a range with itself, the pair (second half, first half) is that of (first, second).
                    rest = slice(None) if x <= y else a != b
                    for z in range(halves_c):
                        parts.append((a[rest] * halves_r + x, b[rest] * halves_r + y, c[rest] * halves_c + z))
            a, b, c = (np.concatenate([p[k] for p in parts]) for k in range(3))
        apart = a != b
        a, b, c = a[apart], b[apart], c[apart]
        p, q = shares[a, c], shares[b, c]
        np.add.at(forth, a * rows + b, distances(p, q))
        np.add.at(back, a * rows + b, distances(q, p))
    p0, q0 = unseen[:, None], unseen[None, :]
    upper = forth.reshape(rows, rows) + empty * distances(p0, q0)
    lower = back.reshape(rows, rows) + empty * distances(q0, p0)
    wanted = np.triu(np.ones((rows, rows), bool), 1)
    if cross:
        wanted[:cross, :cross] = wanted[cross:, cross:] = False
    return np.where(wanted, upper, 0) + np.where(wanted, lower, 0).T


def _power(n: int) -> int:
    return 1 << max(0, n - 1).bit_length()


PRICED = "lang string, g int, h int, value long, columns long"


def price_block(key, cells):
    """One block of columns for one pair of row tiles: ``value`` of each ordered pair of sources over the block's columns.

    Rows without a column hold a source's probability of an unseen term; the others one count each.
    """
    import pandas as pd

    lang, x, y = key[0], int(key[1]), int(key[2])
    head, cells = cells[cells["col"].isna()], cells[cells["col"].notna()]
    if cells.empty:
        return pd.DataFrame({"lang": np.empty(0, object), **{c: np.empty(0, np.int64) for c in ("g", "h", "value", "columns")}})
    half = TILE if x != y else 0
    place = lambda g: g - x * TILE if x == y else np.where(g // TILE == x, g - x * TILE, g - y * TILE + TILE)
    own = head["g"].to_numpy(np.int64)
    rows = 2 * TILE if half else _power(len(own))
    unseen = np.ones(rows, np.int64)
    unseen[place(own)] = head["p"].to_numpy(np.int64)
    row, (_, col) = place(cells["g"].to_numpy(np.int64)), np.unique(cells["col"].to_numpy(np.int64), return_inverse=True)
    columns = int(col.max()) + 1
    # Terms of the same sources stand together, so that empty quadrants are large.
    by_row = np.zeros((columns, rows), bool)
    by_row[col, row] = True
    order = np.lexsort(by_row.T)
    rank = np.empty(columns, np.int64)
    rank[order] = np.arange(columns)
    filled = np.zeros((rows, _power(columns)), bool)
    filled[row, rank[col]] = True
    shares = np.repeat(unseen[:, None], filled.shape[1], axis=1)
    shares[row, rank[col]] = cells["p"].to_numpy(np.int64)
    value = traverse(shares, filled, unseen, half)
    # Columns that only fill up the last power of two are empty everywhere; they are taken off again.
    extra = filled.shape[1] - columns
    value -= extra * distances(unseen[:, None], unseen[None, :])
    ids, at = np.sort(own), place(np.sort(own))
    g, h = np.meshgrid(np.arange(len(ids)), np.arange(len(ids)), indexing="ij")
    wanted = (g != h) & ((ids[g] // TILE != ids[h] // TILE) if half else True)
    g, h = g[wanted], h[wanted]
    return pd.DataFrame({"lang": lang, "g": ids[g].astype(np.int32), "h": ids[h].astype(np.int32), "value": value[at[g], at[h]], "columns": columns})


def kept_terms(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """``lang``, ``source``, ``term``, ``n``, the language's count ``lang_n`` and a number ``col`` of every kept term."""
    each = term_counts(docs).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")
    whole = each.withColumn("id", F.monotonically_increasing_id()).select(
        "lang", "source", "term", "n", "id", F.sum("docs").over(term).alias("docs"), F.sum("n").over(term).alias("lang_n"), F.min("id").over(term).alias("col"))
    return stored(whole.where(F.col("docs") >= min_docs).select("lang", "source", "term", "n", "lang_n", "col", (F.col("id") == F.col("col")).alias("first")), "terms")


def grouped(docs: DataFrame, kept: DataFrame, block_cells: int = BLOCK_CELLS) -> DataFrame:
    """One row per (language, source): number ``g`` within the language, counts, and the language's terms, counts and blocks."""
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("cells"), F.sum(F.col("first").cast("long")).alias("firsts"))
    all_groups = docs.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").na.fill(0, ["total", "cells", "firsts"])
    lang = Window.partitionBy("lang")
    out = all_groups.select(
        "lang", "source", "total", (F.row_number().over(lang.orderBy("source")) - 1).alias("g"), F.count(F.lit(1)).over(lang).alias("sources"),
        F.sum("firsts").over(lang).alias("terms"), F.sum("total").over(lang).alias("lang_total"), F.sum("cells").over(lang).alias("cells"))
    nothing = _share(F.lit(0), F.col("total"), F.col("terms"))
    return settle(out.withColumn("tile", F.floor(F.col("g") / TILE).cast("int"))
                  .withColumn("tiles", F.ceil(F.col("sources") / TILE).cast("int"))
                  .withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("cells") / block_cells)).cast("int"))
                  .withColumn("unseen", F.when(F.col("terms") > 0, nothing)), "groups")


def _tile_pairs() -> Column:
    """All pairs of tiles that a row of ``tile`` has a part in."""
    each = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1),
                       lambda t: F.struct(F.least(t, F.col("tile")).alias("x"), F.greatest(t, F.col("tile")).alias("y")))
    return F.inline(each)


def pair_values(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """``lang``, ``source``, ``item`` (every other source of the language) and ``value``, summed over all kept terms."""
    small = groups.where("terms > 0")
    cells = with_small(kept.select("lang", "source", "term", "n", "col"), small, ["lang", "source"])
    block = F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int").alias("block")
    counted = cells.select("lang", "tile", "tiles", block, "col", "g", _share(F.col("n"), F.col("total"), F.col("terms")).alias("p"))
    heads = small.select("lang", "tile", "tiles", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
                         F.lit(None).cast("long").alias("col"), "g", F.col("unseen").alias("p"))
    dealt = counted.unionByName(heads).select("lang", _tile_pairs(), "block", "col", "g", "p")
    priced = dealt.groupBy("lang", "x", "y", "block").applyInPandas(price_block, PRICED)
    sums = priced.groupBy("lang", "g", "h").agg(F.sum("value").alias("priced"), F.sum("columns").alias("columns"))
    sides = groups.select("lang", "source", "g", "terms", F.col("unseen").alias("p"))
    pairs = sides.join(sides.select("lang", F.col("source").alias("item"), F.col("g").alias("h"), F.col("p").alias("q")), "lang")
    rest = (F.col("terms") - F.coalesce("columns", F.lit(0))) * F.coalesce(_distance(F.col("p"), F.col("q")), F.lit(0))
    return (pairs.where(F.col("g") != F.col("h")).join(sums, ["lang", "g", "h"], "left")
            .select("lang", "source", "item", (F.coalesce("priced", F.lit(0)) + rest).cast("long").alias("value")))


def term_values(kept: DataFrame, groups: DataFrame, top: int = TOP_TERMS) -> DataFrame:
    """``lang``, ``source``, ``item``, ``value`` and ``rank`` of the terms that a source uses more than its language."""
    p, q = _share(F.col("n"), F.col("total"), F.col("terms")), _share(F.col("lang_n"), F.col("lang_total"), F.col("terms"))
    shares = with_small(kept, groups, ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q"))
    valued = shares.where("p > q").select("lang", "source", "item", _distance(F.col("p"), F.col("q")).alias("value"))
    return top_rows(valued, ["lang", "source"], [F.desc("value"), F.asc("item")], top).withColumnRenamed("position", "rank")


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = MIN_DOCS, top: int = TOP_TERMS,
          block_cells: int = BLOCK_CELLS) -> DataFrame:
    """``lang``, ``source``, ``part``, ``item``, ``value``, ``rank`` for every (language, source) of ``docs``.

    Part ``pair`` compares a source with each other one of its language over all terms found in ``min_docs`` documents of
    the language; part ``term`` lists the ``top`` terms by which it stands out from the language. Null text, language and source
    count as ''. A source without terms has the probabilities of unseen terms; a language without kept terms has
    pairs of value 0 and no term. Repeated rows count as documents of their own. Equal values rank by item, bytewise.
    Other columns are not looked at. An empty table gives no rows.
    """
    read = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name) for c, name in ((lang, "lang"), (source, "source"))],
                       F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("body"))
    kept = kept_terms(read, min_docs)
    groups = grouped(read, kept, block_cells)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    pairs = pair_values(kept, groups).withColumn("rank", F.row_number().over(order))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return (pairs.withColumn("part", F.lit("pair")).select(columns)
            .unionByName(term_values(kept, groups, top).withColumn("part", F.lit("term")).select(columns)))
