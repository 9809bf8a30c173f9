"""A Merkle tree over every row of a dataset, source by source, that stores only some of its levels.

Leaves and every ``stride``-th level above them are written (the checkpoints). A checkpoint's nodes are cut into aligned
subtrees of ``3 ** stride`` nodes; the way up makes a subtree's inner nodes in memory and keeps its top alone. The way
down, from the root, takes one checkpoint after the other: each subtree makes its inner nodes again from the stored ones,
gives every node the siblings on its way to the subtree's top, in front of those from there to the root, and
forgets the inner nodes. A subtree is at most ``3 ** stride`` rows, so neither a large source nor a large number of sources
comes together in one task; positions within a source come from range partitions and their sizes.
"""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.skew import ranked
from .common import stored

ARITY = 3
STRIDE = 6
"""Levels from one checkpoint to the next."""
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_HEX = 64

NODES = "key string, i long, n long, node string"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(*fields: Column) -> Column:
    """Hash of the fields, each with its length in bytes in front; '-' stands for null."""
    def field(c: Column) -> Column:
        value = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))
    return F.sha2(F.concat(*map(field, fields)), 256)


def levels_of(nodes: list[str], levels: int) -> list[list[str]]:
    """The given nodes and the ``levels`` levels above them; each run of ARITY nodes has its hash above it."""
    out = [nodes]
    for _ in range(levels):
        low = out[-1]
        out.append([digest("".join(low[k : k + ARITY])) for k in range(0, len(low), ARITY)])
    return out


def depth(n: int) -> int:
    """Levels above ``n`` nodes."""
    out = 0
    while n > 1:
        n, out = -(-n // ARITY), out + 1
    return out


def siblings(levels: list[list[str]], k: int) -> str:
    """Way from node ``k`` to the top: per level the number of siblings to its left, of those to its right, and their hashes."""
    out = []
    for level in levels[:-1]:
        first = k - k % ARITY
        run = level[first : first + ARITY]
        at = k - first
        out.append(f"{at}{len(run) - at - 1}{''.join(run[:at])}{''.join(run[at + 1:])}")
        k //= ARITY
    return "".join(out)


def along(way: str):
    """(hashes to the left, hashes to the right) level by level."""
    at = 0
    while at < len(way):
        left, right = int(way[at]) * _HEX, int(way[at + 1]) * _HEX
        yield way[at + 2 : at + 2 + left], way[at + 2 + left : at + 2 + left + right]
        at += 2 + left + right


def proof_hash(way: str) -> str:
    return digest("".join(left + right for left, right in along(way)))


def fold(leaf: str, way: str) -> str:
    """The root that follows from a leaf and its siblings."""
    return reduce(lambda node, sides: digest(sides[0] + node + sides[1]), along(way), leaf)


def _block(stride: int) -> Column:
    """The aligned subtree that a node is in."""
    return F.call_function("div", F.col("i"), F.lit(ARITY ** stride)).alias("block")


def _regrown(nodes, stride: int) -> list[list[str]]:
    """The levels of one aligned subtree, made from its stored nodes."""
    return levels_of(list(nodes["node"]), min(stride, depth(int(nodes["n"].iloc[0]))))


def checkpoints(nodes: DataFrame, stride: int = STRIDE) -> list[DataFrame]:
    """The stored levels of the trees of all keys, from ``nodes`` (``key``, position ``i``, ``n`` nodes of the key, ``node``)."""
    def top(key, rows):
        import pandas as pd

        levels = _regrown(rows.sort_values("i"), stride)
        n = -(-int(rows["n"].iloc[0]) // ARITY ** (len(levels) - 1))
        return pd.DataFrame({"key": [key[0]], "i": [int(key[1])], "n": [n], "node": levels[-1]})

    out = [nodes]
    while not out[-1].where("n > 1").isEmpty():
        groups = out[-1].where("n > 1").select("key", "i", "n", "node").groupBy("key", _block(stride))
        out.append(stored(groups.applyInPandas(top, NODES), "checkpoint"))
    return out


def tops(levels: list[DataFrame]) -> DataFrame:
    """``key`` and the ``node`` that its tree ends in."""
    return reduce(DataFrame.unionByName, [level.where("n = 1").select("key", "node") for level in levels])


PROOFS = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def ways_down(levels: list[DataFrame], start: DataFrame, stride: int = STRIDE) -> DataFrame:
    """``key``, ``i`` and ``way`` to the root of every node of the first of ``levels``.

    ``start`` has the ``way`` of each key's top. Trees that end at a lower checkpoint join there.
    """
    def below(key, nodes, above):
        import pandas as pd

        nodes = nodes.sort_values("i")
        levels, rest = _regrown(nodes, stride), above["way"].iloc[0]
        return pd.DataFrame({"key": key[0], "i": nodes["i"], "way": [siblings(levels, k) + rest for k in range(len(nodes))]})

    ways = None
    for level in reversed(levels):
        own = level.where("n = 1").select("key", "i").join(start, "key").select("key", "i", "way")
        if ways is not None:
            groups = level.where("n > 1").select("key", "i", "n", "node").groupBy("key", _block(stride))
            more = groups.cogroup(ways.select(F.col("key").alias("k"), F.col("i").alias("b"), "way").groupBy("k", "b"))
            own = own.unionByName(more.applyInPandas(below, "key string, i long, way string"))
        ways = stored(own, "ways")
    return ways


def proofs(leaves: DataFrame, above: DataFrame, stride: int = STRIDE) -> DataFrame:
    """What the proof of every leaf comes to; ways are made subtree by subtree and not kept.

    ``above`` has, per key ``k`` and subtree ``b``, the ``way`` of its top, and ``subroot`` and ``root``.
    """
    def proved(key, nodes, above):
        import pandas as pd

        nodes = nodes.sort_values("i")
        levels, rest, root = _regrown(nodes, stride), above["way"].iloc[0], above["root"].iloc[0]
        ways = [siblings(levels, k) + rest for k in range(len(nodes))]
        folded = [fold(t if isinstance(t, str) else n, w) for t, n, w in zip(nodes["tampered"], nodes["node"], ways)]
        return pd.DataFrame({"doc_id": nodes["doc_id"].astype("Int64"), "leaf": nodes["node"], "subroot": above["subroot"].iloc[0], "root": root,
                             "proof_sha256": [proof_hash(w) for w in ways], "folded_root": folded, "verified": [f == root for f in folded]})

    below = leaves.select("key", "i", "n", "node", "doc_id", "tampered").groupBy("key", _block(stride))
    return below.cogroup(above.groupBy("k", "b")).applyInPandas(proved, PROOFS)


def source_key(source: Column) -> Column:
    """A key that sorts null first and then bytewise, and is never null."""
    return F.coalesce(F.concat(F.lit("v"), source), F.lit("-"))


def manifest(docs: DataFrame, tampered_text: Column | None = None, tampered_when: Column | None = None, stride: int = STRIDE) -> DataFrame:
    """``doc_id``, ``leaf``, ``subroot``, ``root``, ``proof_sha256``, ``folded_root``, ``verified`` for every row of ``docs``.

    The columns named in FIELDS make the leaf. Rows of one source follow each other by ``doc_id`` (null first, equal
    ids by leaf), sources bytewise with null first. ``folded_root`` follows from the original siblings and the leaf, made with
    ``tampered_text`` where ``tampered_when`` holds, and is compared with ``root``. A lone row is its source's subroot, a lone
    subroot the root; its proof is the hash of nothing. Repeated rows are leaves of their own. An empty table has no
    rows. Further columns take no part.
    """
    fields = [F.col(c) for c in FIELDS]
    leaf = leaf_of(*fields)
    other = F.lit(None).cast("string")
    if tampered_text is not None:
        other = F.when(F.coalesce(tampered_when, F.lit(False)), leaf_of(*[tampered_text if c == "text" else F.col(c) for c in FIELDS]))
    rows = stored(docs.select(source_key(F.col("source").cast("string")).alias("key"), F.col("doc_id").cast("long").alias("doc_id"),
                              leaf.alias("node"), other.alias("tampered")), "leaves")
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    placed = ranked(rows, ["key"], [F.asc("doc_id"), F.asc("node")], "i", group_rows=0)
    leaves = stored(placed.join(sizes, "key").select("key", (F.col("i") - 1).alias("i"), "n", "node", "doc_id", "tampered"), "leaves")
    trees = checkpoints(leaves, stride)

    # The sources' subroots are the leaves of one more tree.
    subroots = stored(tops(trees).withColumn("all", F.lit("")), "subroots")
    n = subroots.count()
    order = ranked(subroots, ["all"], [F.asc("key")], "i", group_rows=0)
    sources = stored(order.select(F.col("all").alias("key"), (F.col("i") - 1).alias("i"), F.lit(n).cast("long").alias("n"), "node", F.col("key").alias("source")), "sources")
    over = checkpoints(sources, stride)
    root = tops(over).select(F.col("node").alias("root"))
    upper = ways_down(over, tops(over).select("key", F.lit("").alias("way")), stride)
    ends = (sources.join(upper, ["key", "i"]).join(root.withColumn("key", F.lit("")), "key")
            .select(F.col("source").alias("key"), F.col("node").alias("subroot"), "way", "root"))
    ends = stored(ends, "ends")

    above = leaves.where("n = 1").select("key").join(ends, "key").select("key", F.lit(0).cast("long").alias("i"), "way")
    if len(trees) > 1:
        above = above.unionByName(ways_down(trees[1:], ends.select("key", "way"), stride))
    above = above.join(ends.select("key", "subroot", "root"), "key").select(F.col("key").alias("k"), F.col("i").alias("b"), "way", "subroot", "root")
    return proofs(leaves, above, stride)
