"""Shortest paths from chosen sources, closeness, path statistics and betweenness.

Graphs that one task holds are searched there, piece by piece. Otherwise distances grow as a log: a round adds only the rows it found or improved, as one more
folder of the log, so the whole state is never rewritten.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, functions as F

from ..functions.skew import with_small
from ..session import scratch_path, settle
from . import whole
from .build import K, GraphSet, Links
from .components import component_count, weak_components
from .sampling import sample_nodes

N = [*K, "node_id"]
P = ["origin", "node_id"]
CLOSENESS, BETWEENNESS = "node_id string, closeness double", "node_id string, betweenness double"


class _Log:
    """Rows appended round by round to one folder of the shared root."""

    def __init__(self, first: DataFrame, label: str):
        self.path, self.schema, self.round = scratch_path(first.sparkSession, label), first.schema, 0
        self.spark = first.sparkSession
        self.add(first)

    def add(self, rows: DataFrame) -> None:
        """Write one round; it is then found under ``latest``, and ``going`` tells whether it has rows."""
        self.round += 1
        seen = Observation()
        rows.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(f"{self.path}/round={self.round:05d}")
        self.going = (seen.get.get("rows") or 0) > 0

    @property
    def latest(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/round={self.round:05d}")

    def since(self, first: int = 1) -> DataFrame:
        rounds = [f"{self.path}/round={r:05d}" for r in range(first, self.round + 1)]
        return self.spark.read.schema(self.schema).parquet(*rounds)


def distances(links: Links, origins: DataFrame, weighted: bool = False) -> DataFrame:
    """``distance`` from every origin to each node it reaches, itself at 0; all nodes by number.

    Weights must be positive.
    """
    step = F.col("weight").cast("double") if weighted else F.lit(1.0)
    log = _Log(origins.select(F.col("node_id").alias("origin"), "node_id", F.lit(0.0).alias("distance")), "paths")
    while log.going:
        offered = (links.send(log.latest).groupBy("origin", F.col("other").alias("node_id"))
                   .agg(F.min(F.col("distance") + step).alias("distance")))
        known = log.since().groupBy(*P).agg(F.min("distance").alias("best"))
        better = offered.join(known, P, "left").where(F.col("best").isNull() | (F.col("distance") < F.col("best")))
        log.add(better.select(*P, "distance"))
    return log.since().groupBy(*P).agg(F.min("distance").alias("distance"))


def sampled_hops(g: GraphSet, components: DataFrame, seed: int = 42, sized_by_graph: bool = False, counted: bool = False) -> DataFrame:
    """Hop distances from sampled nodes of the largest weak component, or how many ``paths`` have each length if ``counted``.

    Paths from inside a weak component stay inside it, so no subgraph is needed.
    """
    from .components import largest_component_nodes
    inside = settle(largest_component_nodes(components))
    origins = sample_nodes(inside, seed, sized_by=g.nodes if sized_by_graph else None)
    if counted:
        return g.in_tasks(whole.hop_counts, "shortest_path_length bigint, paths bigint", lambda big: _hops(big, origins).groupBy(
            *K, "shortest_path_length").agg(F.count(F.lit(1)).alias("paths")), origins=origins)
    return g.in_tasks(whole.hops, "source string, target string, shortest_path_length bigint", lambda big: _hops(big, origins), origins=origins)


def _hops(g: GraphSet, origins: DataFrame) -> DataFrame:
    hops = distances(g.out_links, g.numbers_of(origins.select(*N)))
    return g.named(hops, "origin").select(*K, F.col("origin").alias("source"), F.col("node_id").alias("target"),
                                          F.col("distance").cast("bigint").alias("shortest_path_length"))


def _in_batches(nodes: DataFrame, batches: int, run: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Union of ``run`` over disjoint parts of the origins; bounds the state held at a time, not the result."""
    if batches == 1:
        return run(nodes)
    part = F.pmod(F.xxhash64("node_id"), F.lit(batches))
    result = None
    for i in range(batches):
        piece = settle(run(nodes.where(part == i)))
        result = piece if result is None else result.unionByName(piece)
    return result


def path_stats(g: GraphSet, components: DataFrame | None = None, batches: int = 1) -> DataFrame:
    """Mean and maximum of all weighted distances, a node's own 0 included, for weakly connected graphs."""
    return g.in_tasks(whole.path_stats, "average_path_length double, diameter double", lambda big: _path_stats(big, components, batches),
                      per_graph=True)


def _path_stats(g: GraphSet, components: DataFrame | None, batches: int) -> DataFrame:
    components = components if components is not None else weak_components(g)
    connected = settle(component_count(components).where("is_weakly_connected").join(g.graphs, K).select("gid"))
    nodes = settle(g.join_month(g.ids, connected))
    part = _in_batches(nodes, batches, lambda some: distances(g.out_links, some, weighted=True).join(
        g.ids.withColumnRenamed("node_id", "origin"), "origin").groupBy("gid").agg(
        F.sum("distance").alias("total"), F.count(F.lit(1)).alias("paths"), F.max("distance").alias("longest")))
    stats = part.groupBy("gid").agg((F.sum("total") / F.sum("paths")).alias("average_path_length"),
                                    F.max("longest").alias("diameter"))
    return g.by_graph(stats, "right")


def closeness(g: GraphSet, weighted: bool = False, nodes: DataFrame | None = None, batches: int = 1) -> DataFrame:
    """Inward closeness with the share of the graph that reaches the node as factor.

    Distances run against the arcs from each node asked for.
    """
    if nodes is not None:
        return _closeness(g, weighted, nodes, batches)
    return g.in_tasks(whole.closeness, CLOSENESS, lambda big: _closeness(big, weighted, None, batches), weighted)


def _closeness(g: GraphSet, weighted: bool, nodes: DataFrame | None, batches: int) -> DataFrame:
    asked = g.ids if nodes is None else g.numbers_of(nodes.select(*N))
    size = g.ids.groupBy("gid").agg(F.count(F.lit(1)).alias("n"))
    sums = _in_batches(asked, batches, lambda some: distances(g.in_links, some, weighted).groupBy(
        F.col("origin").alias("node_id")).agg(F.count(F.lit(1)).alias("reach"), F.sum("distance").alias("total")))
    r, n = F.col("reach") - 1, F.col("n") - 1
    value = F.when((F.col("total") > 0) & (n > 0), r / F.col("total") * (r / n)).otherwise(0.0)
    return g.named(g.join_month(sums.join(g.ids, "node_id"), size).select("node_id", value.alias("closeness")))


def pivots_of(g: GraphSet, seed: int | None = 42) -> DataFrame:
    """The nodes that betweenness searches from: a sample, or without ``seed`` all."""
    if seed is None:
        size = g.nodes.groupBy(*K).agg(F.count(F.lit(1)).alias("n"), F.count(F.lit(1)).alias("k"))
        return g.once(("pivots", seed), lambda: with_small(g.nodes, size, K))
    return g.once(("pivots", seed), lambda: sample_nodes(g.nodes, seed))


def betweenness(g: GraphSet, weighted: bool = True, seed: int | None = 42) -> DataFrame:
    """Share of shortest paths through each node, from sampled pivots, scaled to all nodes; without ``seed`` from all nodes, which is exact.

    The arcs on shortest paths form one acyclic graph per pivot. Path counts are summed
    over path lengths going forward, dependencies over path lengths going back
    (Brandes, 2001), in rounds each one join and one aggregation over all pivots of all months.
    """
    def found() -> DataFrame:
        pivots = pivots_of(g, seed)
        return g.in_tasks(whole.betweenness, BETWEENNESS, lambda big: _betweenness(big, weighted, pivots), weighted,
                          origins=pivots)

    return g.once(("betweenness", weighted, seed), found if seed is not None else lambda: _exact_betweenness(g, weighted))


def _exact_betweenness(g: GraphSet, weighted: bool) -> DataFrame:
    """``betweenness`` from all nodes, with the searches of a graph in shares of bounded work."""
    parts = g.in_shares(whole.dependencies, "node_id string, amount double", lambda big: big.named(
        big.ids.select("node_id").join(_through(big, weighted, pivots_of(big, None)), "node_id", "left").na.fill(0.0, ["amount"])), weighted)
    sums = settle(parts.groupBy(*N).agg(F.sum("amount").alias("amount")))
    n = F.col("n")
    scale = F.when(n > 2, 1 / ((n - 1.0) * (n - 2.0))).otherwise(1.0)
    return with_small(sums, sums.groupBy(*K).agg(F.count(F.lit(1)).alias("n")), K).select(*N, (F.col("amount") * scale).alias("betweenness"))


def _through(g: GraphSet, weighted: bool, pivots: DataFrame) -> DataFrame:
    """Sum of the shares of shortest paths from ``pivots`` through each node that lies inside some, by number."""
    step = F.col("weight").cast("double") if weighted else F.lit(1.0)
    found = settle(distances(g.out_links, g.numbers_of(pivots.select(*N)), weighted))
    ahead = found.select("origin", F.col("node_id").alias("other"), F.col("distance").alias("reached"))
    tight = settle(g.out_links.send(found).where(F.col("node_id") != F.col("other"))
                   .select(*P, "other", (F.col("distance") + step).alias("reached"))
                   .join(ahead, ["origin", "other", "reached"]).select(*P, "other"))
    counts = _Log(found.where(F.col("node_id") == F.col("origin")).select(*P, F.lit(1.0).alias("paths")), "paths-count")
    while counts.going:
        counts.add(tight.join(counts.latest, P).groupBy("origin", F.col("other").alias("node_id")).agg(F.sum("paths").alias("paths")))
    paths = settle(counts.since().groupBy(*P).agg(F.sum("paths").alias("paths")))
    onward = paths.select("origin", F.col("node_id").alias("other"), F.col("paths").alias("paths_other"))
    shares = settle(tight.join(paths, P).join(onward, ["origin", "other"])
                    .select(*P, "other", (F.col("paths") / F.col("paths_other")).alias("share")))
    passed = _Log(found.select(*P, F.lit(1.0).alias("amount")), "paths-dependency")
    while passed.going:
        later = passed.latest.select("origin", F.col("node_id").alias("other"), "amount")
        passed.add(shares.join(later, ["origin", "other"]).groupBy(*P).agg(F.sum(F.col("share") * F.col("amount")).alias("amount")))
    # The first round holds the constant 1 of each node, which is no dependency.
    return passed.since(2).where(F.col("node_id") != F.col("origin")).groupBy("node_id").agg(F.sum("amount").alias("amount"))


def _betweenness(g: GraphSet, weighted: bool, pivots: DataFrame) -> DataFrame:
    through = _through(g, weighted, pivots)
    size = pivots.groupBy(*K).agg(F.first("n").alias("n"), F.first("k").alias("k")).join(g.graphs, K).select("gid", "n", "k")
    n, k = F.col("n"), F.col("k")
    scale = F.when(n > 2, n / (k * (n - 1.0) * (n - 2.0))).otherwise(1.0)
    return g.named(g.join_month(g.ids, size).join(through, "node_id", "left")
                   .select("node_id", (F.coalesce("amount", F.lit(0.0)) * scale).alias("betweenness")))
