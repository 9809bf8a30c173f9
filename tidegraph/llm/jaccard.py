"""Exact Jaccard join of word n-gram sets, given as connected components, by skipping over set relations.

*Blocks by position.* The hash space is cut at fixed positions into slightly more blocks than the greatest number of elements
two linked sets of a size class can differ in, so two linked sets have a block with the same elements. The index has one
list per block content: everything outside equal blocks is skipped. With ``spare`` blocks more, two linked sets have that many
equal blocks more, so every set may leave out its ``spare`` most common ones (of all orders that sets agree on, one by
frequency leaves out the passages that unrelated texts share) and the last of the equal blocks is still in both.

*Answers derived from similar sets.* The sets of a list are not compared with each other but with one pivot, the set that
shares most lists. A set linked to the pivot takes over its component. What is left are sets not linked to their
pivot; for them the differences from the pivot, already computed, are all that is looked at: two sets of one pivot differ in
``|X| + |Y| - 2 |X n Y|`` elements, X and Y being their differences. An index over the rarest of these differences, with skipping
by position, length and component, finds the remaining links. Copies of one set are one set throughout.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import settle
from .common import mixed, rolled, stored, word_hashes

PERCENT = 90
SHINGLE = 3
CLASS_GROWTH = 1.4
SPARE = 0.002
"""Blocks that a set may leave out, as a share of the elements two linked sets can differ in. Similarities near 0.9 have large
blocks, which unrelated sets hardly share; lower ones need more."""

KEYS_AT_ONCE = 200_000
BROADCAST_IDS = 500_000
"""Ids, or pairs of them, sent to all executors at most; more are joined by a shuffle."""

SETS = "id long, sid long, n long"


def set_of(hashes: np.ndarray, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the n-grams; a shorter text is one n-gram, no words are none."""
    if not len(hashes):
        return np.empty(0, np.uint64)
    size = min(shingle, len(hashes))
    return np.unique(rolled(hashes, size, size))


def _bounds(limit: int = 1 << 40) -> list[int]:
    out, x = [1], 1.0
    while out[-1] < limit:
        x *= CLASS_GROWTH
        if int(np.ceil(x)) > out[-1]:
            out.append(int(np.ceil(x)))
    return out


BOUNDS = _bounds()


def blocks(elements: np.ndarray, percent: int = PERCENT, spare: float = SPARE) -> list[tuple[np.ndarray, int]]:
    """Keys of the set's blocks and how many of them, the most common, may be left out, for each size class of the set.

    Two different sets that are linked share one key after that. A set whose size may be linked across the upper bound of its
    size class is also indexed in the next classes; the lowest three bits of a key tell them apart. A class has as
    many blocks as its sets can differ in, plus one, plus the spare ones. Empty blocks count as the most common: a set with more
    of them than spare blocks indexes them too and leaves out none, another indexes none and leaves out so many less.
    """
    n, out = len(elements), []
    at = bisect_right(BOUNDS, n) - 1
    for c in range(at, len(BOUNDS) - 1):
        if c > at and n * 100 < percent * BOUNDS[c]:
            break
        differ = 2 * (BOUNDS[c + 1] - 1) * (100 - percent) // (100 + percent)
        if not differ:
            continue
        extra = 1 + int(differ * spare)
        k = differ + 1 + extra
        block = ((mixed(elements ^ np.uint64(0xA5A5A5A5)) >> np.uint64(32)) * np.uint64(k) >> np.uint64(32)).astype(np.int64)
        sums, filled = np.zeros(k, np.uint64), np.bincount(block, minlength=k) > 0
        np.add.at(sums, block, mixed(elements + np.uint64(0x5EED)))
        keys = mixed(sums + mixed(np.arange(k, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(c + 1)))
        keys = (keys & np.uint64(2**64 - 8)) | np.uint64(c & 7)
        empty = int((~filled).sum())
        out.append((keys, 0) if empty > extra else (keys[filled], extra - empty))
    return out


def block_keys(elements: np.ndarray, percent: int = PERCENT, spare: float = SPARE) -> np.ndarray:
    """All keys of ``blocks``."""
    return np.concatenate([np.empty(0, np.uint64), *[keys for keys, _ in blocks(elements, percent, spare)]])


def _sets(docs: DataFrame, shingle: int) -> DataFrame:
    """Size and hash of every set."""
    def run(batches):
        for batch in batches:
            sids, sizes = [], []
            for body in batch.column(1).to_pylist():
                elements = set_of(word_hashes(body.lower() if body else None), shingle)
                sids.append(xxhash.xxh3_64_intdigest(elements.tobytes()) - (1 << 63))
                sizes.append(len(elements))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sids, pa.int64()), pa.array(sizes, pa.int64())], names=["id", "sid", "n"])

    return stored(docs.mapInArrow(run, SETS), "sets")


def _indexed(docs: DataFrame, percent: int, shingle: int, spare: float) -> DataFrame:
    """``sid``, ``key`` and ``leave`` (keys its class may leave out) of every block; a task sends the keys of equal sets once.

    The keys are many times the ids: they are shuffled once, and not stored.
    """
    def run(batches):
        sent, sids, keys, leave, held = set(), [], [], [], 0

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(sids)), pa.array(np.concatenate(keys).view(np.int64)),
                                               pa.array(np.concatenate(leave))], names=["sid", "key", "leave"])

        for batch in batches:
            for body in batch.column(1).to_pylist():
                elements = set_of(word_hashes(body.lower() if body else None), shingle)
                sid = xxhash.xxh3_64_intdigest(elements.tobytes()) - (1 << 63)
                if sid in sent:
                    continue
                if len(sent) > 1_000_000:
                    sent.clear()
                sent.add(sid)
                for own, most in blocks(elements, percent, spare):
                    sids.append(np.full(len(own), sid, np.int64))
                    keys.append(own)
                    leave.append(np.full(len(own), most, np.int32))
                    held += len(own)
                if held > KEYS_AT_ONCE:
                    yield flush()
                    sids, keys, leave, held = [], [], [], 0
        if held:
            yield flush()

    return docs.mapInArrow(run, "sid long, key long, leave int")


def _contents(docs: DataFrame, wanted: DataFrame, shingle: int, repeated_rows: bool) -> DataFrame:
    """``sid``, ``n`` and ``elements`` (packed) of the sets in ``wanted`` (``id`` of one document, ``sid``).

    Sets come up twice only with ``repeated_rows``, when a wanted document is there more than once.
    """
    few = wanted.count() <= BROADCAST_IDS
    chosen = docs.join(F.broadcast(wanted) if few else wanted, docs["id"].eqNullSafe(wanted["id"])).select(wanted["sid"], "body")

    def run(batches):
        for batch in batches:
            rows = []
            for sid, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                elements = set_of(word_hashes(body.lower() if body else None), shingle)
                # Another text of the same id has another set.
                if xxhash.xxh3_64_intdigest(elements.tobytes()) - (1 << 63) == sid:
                    rows.append((sid, len(elements), elements.tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
                                                  pa.array([r[2] for r in rows], pa.binary())], names=["sid", "n", "elements"])

    found = chosen.mapInArrow(run, "sid long, n long, elements binary")
    return stored(found.dropDuplicates(["sid"]) if repeated_rows else found, "contents")


def _compared(pairs: DataFrame, contents: DataFrame, percent: int) -> DataFrame:
    """For each member of a pivot: sizes, whether they are linked, and, if the pivot has ``many``, the elements in which they differ."""
    own = contents.join(F.broadcast(pairs) if pairs.count() <= BROADCAST_IDS else pairs, "sid")
    pivot = contents.select(F.col("sid").alias("pivot"), F.col("elements").alias("of_pivot"))

    def run(batches):
        for batch in batches:
            linked, more = [], []
            for many, a, b in zip(*[batch.column(k).to_pylist() for k in (3, 4, 5)]):
                a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                differ = np.setxor1d(a, b, assume_unique=True)
                linked.append((100 - percent) * (len(a) + len(b)) >= (100 + percent) * len(differ))
                more.append(differ.view(np.int64) if many else [])
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(linked), pa.array(more, pa.list_(pa.int64()))],
                                             names=["pivot", "sid", "n", "many", "linked", "more"])

    return stored(own.join(pivot, "pivot").select("pivot", "sid", "n", "many", "elements", "of_pivot")
                  .mapInArrow(run, "pivot long, sid long, n long, many boolean, linked boolean, more array<long>"), "compared")


def star_components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root``, its component's least node, for all nodes of ``edges`` (``a``, ``b``) but the roots.

    Alternating large and small stars: every round hangs nodes closer to the least one they know of; rounds are
    about the logarithm of the longest path, and their rows are no more than the edges.
    """
    edges = settle(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where(F.col("a") != F.col("b")).distinct())
    mark = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(low, "a").select(F.explode(F.array(F.struct("a", "m"), F.struct(F.col("b").alias("a"), "m"))).alias("e"))
                 .select("e.a", F.col("e.m").alias("b")).where(F.col("a") != F.col("b")).distinct())
        edges, before = settle(small, "stars"), mark
        mark = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if mark == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _labelled(df: DataFrame, roots: DataFrame) -> DataFrame:
    return df.join(roots.withColumnsRenamed({"node": "sid", "root": "_root"}), "sid", "left").withColumn(
        "label", F.coalesce("_root", "sid")).drop("_root")


def _differ_at_most(a: Column, b: Column, percent: int) -> Column:
    return F.floor((a + b) * (100 - percent) / (100 + percent))


def _apart(compared: DataFrame, percent: int) -> list[DataFrame]:
    """Links between sets of one pivot of which one at least is not linked to it, as frames of ``a``, ``b``."""
    # A set alone with its pivot has been compared with all it met.
    rest = compared.where(F.col("many") & ~F.col("linked")).select("pivot").distinct()
    family = compared.join(rest, "pivot", "left_semi")
    each = family.select("pivot", "sid", "n", "linked", F.size("more").alias("d"), F.explode("more").alias("x"))
    shared = each.groupBy("pivot", "x").agg(F.count(F.lit(1)).alias("f")).where(F.col("f") > 1)
    order = Window.partitionBy("pivot", "sid").orderBy("f", "x")
    met = each.join(shared, ["pivot", "x"]).withColumn("i", F.row_number().over(order))
    # Differences found nowhere else come first in the order, so the shared ones stand behind them.
    met = met.withColumn("i", F.col("i") + F.col("d") - F.count(F.lit(1)).over(Window.partitionBy("pivot", "sid")))
    share = (100 - percent) / (100 + percent)
    as_far = F.col("d") - F.greatest(F.lit(1), F.ceil(F.col("d") * (1 - share) / 2) - 1) + 1
    probe = F.col("d") - F.greatest(F.lit(1), F.col("d") - F.floor(F.col("n") * (1 + 100 / percent) * share)) + 1
    entries = settle(met.withColumn("probes", ~F.col("linked") & (F.col("i") <= probe)).withColumn("listed", F.col("i") <= as_far)
                     .where("probes or listed").drop("f", "linked"), "entries")

    def verified(candidates: DataFrame) -> DataFrame:
        more = compared.select("pivot", "sid", "n", "more")
        one, two = (more.withColumnsRenamed({"sid": s, "n": f"n_{s}", "more": f"more_{s}"}) for s in "ab")
        both = candidates.join(one, ["pivot", "a"]).join(two, ["pivot", "b"])
        differ = F.size("more_a") + F.size("more_b") - 2 * F.size(F.array_intersect("more_a", "more_b"))
        return settle(both.where((100 - percent) * (F.col("n_a") + F.col("n_b")) >= (100 + percent) * differ).select("a", "b").distinct(), "links")

    key = ["pivot", "x"]
    direct = compared.where("linked").select(F.col("pivot").alias("a"), F.col("sid").alias("b"))
    found = [direct]

    def mixed_lists() -> DataFrame:
        """Lists whose sets are not all in one component yet, and in which some set asks."""
        roots = star_components(_union(found))
        named = settle(_labelled(entries, roots), "named")
        lists = named.groupBy(*key).agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.max("probes").alias("asks")).where("lo < hi and asks")
        return named.join(lists.select(*key), key, "left_semi")

    # First each list's sets against the one found in most lists, then whatever that has left apart.
    named = mixed_lists()
    weight = named.groupBy("pivot", "sid").agg(F.count(F.lit(1)).alias("w"))
    centre = named.join(weight, ["pivot", "sid"]).groupBy(*key).agg(F.max(F.struct("w", "sid"))["sid"].alias("c"))
    star = named.join(centre, key).where(F.col("sid") != F.col("c")).select(
        "pivot", F.least("sid", "c").alias("a"), F.greatest("sid", "c").alias("b")).distinct()
    found.append(verified(star))

    named = mixed_lists()
    ask = named.where("probes").select(*key, F.struct("sid", "n", "d", "i", "label").alias("p"))
    listed = named.where("listed").select(*key, F.struct("sid", "n", "d", "i", "label").alias("q"))
    reach = _differ_at_most(F.col("p.n"), F.col("q.n"), percent)
    need = F.ceil((F.col("p.d") + F.col("q.d") - reach) / 2)
    fits = ((F.col("p.label") != F.col("q.label")) & (F.abs(F.col("p.n") - F.col("q.n")) <= reach)
            & (1 + F.least(F.col("p.d") - F.col("p.i"), F.col("q.d") - F.col("q.i")) >= need))
    pairs = ask.join(listed, key).where(fits).select("pivot", F.least("p.sid", "q.sid").alias("a"), F.greatest("p.sid", "q.sid").alias("b")).distinct()
    found.append(verified(pairs))
    return found


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def linked_components(docs: DataFrame, id_col: str = "doc_id", text: str = "text", percent: int = PERCENT, shingle: int = SHINGLE,
                      spare: float = SPARE) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id``, the least id reachable by links, for every row.

    A-Z is lower-cased, words are runs of non-space. Two sets are linked when 100 times their intersection is at least
    ``percent`` times their union. Null texts and texts without words are linked with nothing; equal texts are linked,
    rows of one id are judged by their own texts, null ids count as no id (the component of null ids only is null).
    """
    body = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).cast("binary").alias("body"))
    sets = _sets(body, shingle)
    nodes = settle(sets.where("n > 0").groupBy("sid").agg(F.min("id").alias("id"), F.first("n").alias("n")), "nodes")
    each = _indexed(body, percent, shingle, spare)
    # Keys found once, most of them, are out after a count; those of copies of one set are out after the next. Keys and sets go
    # through one shuffle: counted apart from the sets, the keys would take its disk space twice.
    repeated = F.count(F.lit(1)).over(Window.partitionBy("key"))
    found = settle(each.withColumn("c", repeated).where("c > 1").select("sid", "key", "leave").distinct(), "found")
    others = found.groupBy("key").agg((F.count(F.lit(1)) - 1).alias("others")).where("others > 0")
    common = Window.partitionBy("sid", F.col("key").bitwiseAND(F.lit(7))).orderBy(F.desc("others"), "key")
    lists = settle(found.join(others, "key").withColumn("place", F.row_number().over(common)).where("place > leave").select("sid", "key"), "lists")
    others = lists.groupBy("key").agg((F.count(F.lit(1)) - 1).alias("others")).where("others > 0")
    weight = lists.join(others, "key").groupBy("sid").agg(F.sum("others").alias("w"))
    pivots = lists.join(weight, "sid").groupBy("key").agg(F.max(F.struct("w", "sid"))["sid"].alias("pivot"))
    pairs = settle(lists.join(pivots, "key").where(F.col("sid") != F.col("pivot")).select("pivot", "sid").distinct(), "pairs")
    # Lengths alone rule a link out; such a pair only matters where the pivot has other sets.
    sized = pairs.join(pairs.groupBy("pivot").agg((F.count(F.lit(1)) > 1).alias("many")), "pivot").join(
        nodes.select("sid", F.col("n").alias("a")), "sid").join(nodes.select(F.col("sid").alias("pivot"), F.col("n").alias("b")), "pivot")
    near = 100 * F.least("a", "b") >= percent * F.greatest("a", "b")
    pairs = settle(sized.where(F.col("many") | near).select("pivot", "sid", "many"), "pairs")
    members = pairs.select("sid").unionByName(pairs.select(F.col("pivot").alias("sid"))).distinct()
    wanted = settle(nodes.join(members, "sid", "left_semi").select("sid", "id"), "members")
    rows = sets.where("n > 0").groupBy("sid", "id").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    again = not rows.join(wanted, (rows["sid"] == wanted["sid"]) & rows["id"].eqNullSafe(wanted["id"]), "left_semi").isEmpty()
    compared = _compared(pairs, _contents(body, wanted, shingle, again), percent)
    roots = star_components(_union(_apart(compared, percent)))
    rooted = _labelled(nodes, roots)
    least = rooted.groupBy("label").agg(F.min("id").alias("component"))
    named = settle(rooted.join(least, "label").select("sid", "component"), "components")
    return (sets.select("id", "sid", "n").join(named, "sid", "left")
            .select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"),
                    F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id")).alias("component_id")))


def representatives(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` whose id is the least of their component; rows of no id and rows without words stay."""
    found = linked_components(docs, id_col, text, **options)
    # A document of several rows stays when one of its texts is the first of its component.
    kept = settle(found.where(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct(), "kept")
    gone = found.select("doc_id").where(F.col("doc_id").isNotNull()).distinct().join(kept, "doc_id", "left_anti")
    gone = settle(gone, "gone")
    away = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    return docs.join(away.withColumnRenamed("doc_id", id_col), id_col, "left_anti").select(docs.columns)
