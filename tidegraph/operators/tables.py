"""The tables users read: node metrics, network metrics, politicians, parties, monthly summary."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, functions as F, types as T

from .. import schemas
from ..functions.scalars import display_name, row_id
from ..functions.skew import top_rows
from ..session import settle
from ..sources import writers
from . import blocks, community, components, kcore, local, pagerank, paths, whole
from .build import K, GraphSet
from .sampling import sample_nodes

N = [*K, "node_id"]


def _by_month(first: DataFrame, *rest: DataFrame) -> DataFrame:
    """Left joins of frames with one row per graph and month, each written first: as one plan they would be planned again after every stage."""
    return reduce(lambda left, right: left.join(settle(right, "metric"), K, "left"), rest, first)


def node_metrics(g: GraphSet, with_closeness: bool = False, seed: int | None = 42) -> DataFrame:
    """All node metrics, keyed by graph, month and node; a metric a node lacks is 0. Betweenness is exact without ``seed``."""
    totals = g.once("node totals", lambda: local.node_totals(g.arcs))
    nodes = g.once("names", lambda: totals.na.drop(subset=K).select(*N))
    near = [(whole.closeness, paths.CLOSENESS, (True,))] if with_closeness else []
    between = [(whole.betweenness, paths.BETWEENNESS, (True,))] if seed is not None else []
    g.solve_together((whole.pagerank, pagerank.FIELDS, pagerank.SETTINGS), *between, (whole.triad_counts, local.TRIADS, ()),
                     (whole.cores, kcore.FIELDS, ()), *near, origins=paths.pivots_of(g, seed) if between else None)
    parts = [pagerank.pagerank(g).select(*N, "pagerank"),
             local.degrees(g.arcs, totals).select(*N, F.col("weighted_in_degree").cast("double").alias("degree_in"),
                                          F.col("weighted_out_degree").cast("double").alias("degree_out")),
             paths.betweenness(g, seed=seed),
             local.clustering(g).select(*N, "clustering", F.col("triangles").cast("bigint")),
             kcore.core_numbers(g).select(*N, F.col("core_number").cast("bigint")),
             local.node_flow(g.arcs, totals)]
    if with_closeness:
        parts.append(g.once("weighted closeness", lambda: paths.closeness(g, weighted=True)))
    table = reduce(lambda left, right: left.join(right, N, "left"), parts, nodes)
    numbers = [c for c in table.columns if c not in N]
    return table.na.fill(0, numbers).withColumn("row_id", row_id(F.col("month_start"), F.col("node_id")))


def network_metrics(g: GraphSet, partition: DataFrame | None = None, scc: DataFrame | None = None) -> DataFrame:
    """One row of metrics per graph and month; each metric stands on its own."""
    size = settle(local.sizes(g.arcs))
    partition = partition if partition is not None else community.louvain(g)
    strong = [(whole.strong, components.STRONG, ())] if scc is None else []
    g.solve_together((whole.triad_counts, local.TRIADS, ()), (whole.assortativity, local.ASSORTATIVITY, ()), (whole.cores, kcore.FIELDS, ()),
                     (whole.rich_club, local.RICH_CLUB, ()), *strong)
    scc = scc if scc is not None else components.strong_components(g)
    flow = local.node_flow(g.arcs)
    table = _by_month(
        size, local.density(size), components.strong_component_count(scc), local.transitivity(g),
        community.modularity(g, partition), community.community_count(partition),
        local.assortativity_of(g),
        local.network_toxicity(g.arcs).select(*K, "network_avg_toxicity"),
        local.node_toxicity_stats(flow), kcore.core_summary(kcore.core_numbers(g)), local.rich_club(g),
        local.average_clustering(local.clustering(g)).select(*K, "average_clustering"))
    return table.withColumn("table_name", F.col("graph_id")).withColumn("row_id", row_id(F.col("month_start"), F.col("graph_id")))


def all_networks(tables: dict[str, DataFrame]) -> DataFrame:
    """Edges of several network tables as one frame; all are then computed in the same job."""
    named = [edges.withColumn("graph_id", F.lit(name)).select(*schemas.EDGES.names) for name, edges in tables.items()]
    return reduce(DataFrame.unionByName, named)


def store_node_metrics(g: GraphSet, folder: str, seed: int = 42) -> None:
    """Node metrics of all sources, stored by source and month: one source's table is one folder ``graph_id=…``."""
    _store(node_metrics(g, seed=seed), schemas.NODE_METRICS, folder)


def store_network_metrics(g: GraphSet, folder: str, partition: DataFrame | None = None) -> None:
    """Network metrics of all sources, stored as the node metrics are; Louvain's communities are used without ``partition``."""
    _store(network_metrics(g, partition), schemas.NETWORK_METRICS, folder)


def _store(table: DataFrame, schema: T.StructType, folder: str) -> None:
    rows = writers.conform(table, schemas.of_sources(schema)).hint("rebalance", *K)
    rows.write.partitionBy(*K).option("partitionOverwriteMode", "static").mode("overwrite").parquet(folder)


def store_networks(sources: dict[str, DataFrame], path: str, partition: Callable[[DataFrame], DataFrame] | None = None,
                   seed: int = 42) -> tuple[str, str]:
    """Node metrics and network metrics of several edge tables, stored under ``path``; returns the two folders.

    All sources and months are computed in the same jobs. ``partition`` gives the communities of a node set.
    """
    folders = f"{path}/node_metrics", f"{path}/network_metrics"
    with GraphSet(all_networks(sources)) as g:
        store_node_metrics(g, folders[0], seed)
        store_network_metrics(g, folders[1], partition(g.nodes) if partition else None)
    return folders


def politician_nodes(nodes: DataFrame, politicians: DataFrame) -> DataFrame:
    """Politicians that occur in a month's graph, with name and party."""
    named = politicians.select(F.col("twitter_handle").alias("node_id"), "official_name", "party")
    return nodes.join(named, "node_id").withColumn("category", F.lit("politician"))


def top_others(nodes: DataFrame, politicians: DataFrame, n: int = 1000) -> DataFrame:
    """The ``n`` nodes of highest PageRank that are not politicians."""
    others = nodes.join(politicians.select(F.col("twitter_handle").alias("node_id")), "node_id", "left_anti")
    return (top_rows(others, K, [F.desc("pagerank"), F.col("node_id")], n).drop("position")
            .withColumn("official_name", F.lit(None).cast("string")).withColumn("party", F.lit(None).cast("string"))
            .withColumn("category", F.lit("top_pagerank")))


def politician_metrics(nodes: DataFrame, politicians: DataFrame, n: int = 1000) -> DataFrame:
    """Metrics of politicians and of the top other accounts."""
    both = politician_nodes(nodes, politicians).unionByName(top_others(nodes, politicians, n))
    return both.select(
        *K, F.col("node_id").alias("twitter_handle"), "official_name", "party", "category", "pagerank",
        F.col("degree_in").alias("in_degree"), F.col("degree_out").alias("out_degree"), "betweenness",
        F.col("clustering").alias("clustering_coefficient"),
        F.col("toxicity_sent").alias("sent_toxicity"), F.col("toxicity_received").alias("received_toxicity"),
        F.col("toxicity_sent_avg").alias("avg_sent_toxicity"), F.col("toxicity_received_avg").alias("avg_received_toxicity"),
        F.col("interactions_total").alias("total_interactions"))


def party_rollup(rows: DataFrame) -> DataFrame:
    """Per month and party, politicians only: mean and sample deviation of positions, sums of flows."""
    means = [c for c in ("pagerank", "closeness_centrality", "in_degree", "out_degree", "betweenness",
                         "clustering_coefficient") if c in rows.columns]
    sums = [c for c in ("sent_toxicity", "received_toxicity", "total_interactions") if c in rows.columns]
    return rows.where(F.col("category") == "politician").groupBy(*K, "party").agg(
        *[f(c).alias(f"{c}_{name}") for c in means for f, name in ((F.avg, "mean"), (F.stddev_samp, "std"))],
        *[F.sum(c).alias(f"{c}_sum") for c in sums])


def centrality_table(g: GraphSet, seed: int | None = 42) -> DataFrame:
    """PageRank and betweenness over unweighted paths, exact without ``seed``."""
    return pagerank.pagerank(g).select(*N, "pagerank").join(paths.betweenness(g, weighted=False, seed=seed), N)


def time_summary(g: GraphSet, partition: DataFrame | None = None, seed: int = 42) -> DataFrame:
    """Base and advanced metrics, one row per graph and month."""
    size, degree = settle(local.sizes(g.arcs)), settle(local.degrees(g.arcs))
    weak = components.weak_components(g)
    partition = partition if partition is not None else community.louvain(g, loops=True)
    return _by_month(
        size, local.density(size),
        local.average_clustering(local.clustering(g)).select(
            *K, F.col("average_clustering_directed").alias("avg_clustering")),
        components.component_count(weak).select(*K, "num_components"),
        components.largest_component(weak).select(*K, "largest_component_size"), local.degree_summary(degree),
        local.assortativity_of(g).withColumnRenamed("assortativity", "degree_assortativity"),
        local.reciprocity(g.arcs), kcore.core_summary(kcore.core_numbers(g)),
        blocks.removal_impact(g, sample_nodes(g.nodes, seed)), local.rich_club_density(g),
        components.cycle_edge_ratio(g, components.strong_components(g)), community.modularity(g, partition, loops=True))


def period_metrics(g: GraphSet, partition: DataFrame | None = None) -> DataFrame:
    """The smaller set for graphs of any period, such as weeks, with path lengths."""
    size, weak = settle(local.sizes(g.arcs)), components.weak_components(g)
    partition = partition if partition is not None else community.louvain(g, loops=True)
    return _by_month(
        size, local.density(size), components.strong_component_count(components.strong_components(g)),
        local.transitivity(g), local.assortativity_of(g),
        paths.path_stats(g, weak), community.modularity(g, partition, loops=True), community.community_count(partition))


def weekly_edges(rows: DataFrame, graph_id: str = "weekly") -> DataFrame:
    """``Source, Target, Weight, Week`` rows as edges; the week takes the place of the month."""
    return rows.select(F.lit(graph_id).alias("graph_id"), F.to_date("Week").alias("month_start"),
                       F.col("Source").alias("source"), F.col("Target").alias("target"),
                       F.col("Weight").cast("bigint").alias("weight"), F.lit(0.0).alias("sum_toxicity"),
                       F.lit(0.0).alias("avg_toxicity"))


def party_accounts(nodes: DataFrame, accounts: list[str], start: str, end: str) -> DataFrame:
    """Toxicity sent and received by chosen accounts from ``start`` up to, not including, ``end``."""
    day = F.col("month_start")
    return (nodes.where(F.col("node_id").isin(accounts) & (day >= F.lit(start).cast("date")) & (day < F.lit(end).cast("date")))
            .select("graph_id", day.cast("string").alias("month_start_str"), "node_id", "toxicity_sent_avg", "toxicity_received_avg")
            .orderBy("graph_id", "month_start_str", "node_id"))


def axis_max(rows: DataFrame) -> DataFrame:
    """Common upper end of both axes, with a margin of 5%."""
    return rows.agg((F.greatest(F.max("toxicity_sent_avg"), F.max("toxicity_received_avg")) * 1.05).alias("axis_max"))


def party_toxicity(nodes: DataFrame, names: dict[str, str], start: str, end: str) -> DataFrame:
    """The accounts' series with display names and the common axis end."""
    rows = party_accounts(nodes, list(names), start, end)
    return rows.join(F.broadcast(axis_max(rows))).select(
        "graph_id", F.to_date("month_start_str").alias("month_start"), display_name(F.col("node_id"), names).alias("party"),
        "toxicity_sent_avg", "toxicity_received_avg", "axis_max")


def edge_table(arcs: DataFrame) -> DataFrame:
    """Arcs with their mean toxicity, 0 where it is missing."""
    return arcs.select(*K, "source", "target", "weight", F.coalesce("avg_toxicity", F.lit(0.0)).alias("toxicity"))


def run_span(edges: DataFrame) -> DataFrame:
    """Months processed per table, the first and the last."""
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return edges.groupBy(F.col("graph_id").alias("table_name")).agg(
        F.count_distinct("month_start").alias("total_months_processed"),
        day(F.min("month_start")).alias("first_month"), day(F.max("month_start")).alias("last_month"))
