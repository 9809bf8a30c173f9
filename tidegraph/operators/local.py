"""Metrics that need only joins and aggregations: sizes, flows, degrees, clustering, rich club."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.scalars import correlation, exact_sum, safe_ratio
from ..functions.skew import exact_quantile, hot_join, with_small
from ..session import settle
from . import whole
from .build import K, GraphSet, induced

TRIADS = ", ".join(["node_id string", *[f"{c} bigint" for c in (
    "triangles", "directed_triangles", "transitive_triples", "neighbours", "arcs", "mutual")]])
ASSORTATIVITY, RICH_CLUB = "assortativity double", "rich_club_coefficient double"


def sizes(arcs: DataFrame) -> DataFrame:
    """Node and arc counts per graph and month."""
    seen = arcs.select(*K, F.explode(F.array("source", "target")).alias("node_id")).distinct()
    nodes = seen.groupBy(*K).agg(F.count(F.lit(1)).alias("nodes"))
    return nodes.join(arcs.groupBy(*K).agg(F.count(F.lit(1)).alias("edges")), K)


def density(size: DataFrame) -> DataFrame:
    """Arcs over possible arcs; 0 for fewer than two nodes."""
    n = F.col("nodes")
    return size.select(*K, F.when(n > 1, F.try_divide(F.col("edges"), n * (n - 1))).otherwise(0.0).alias("density"))


def network_toxicity(arcs: DataFrame) -> DataFrame:
    totals = arcs.groupBy(*K).agg(F.sum("weight").alias("total_interactions"),
                                  exact_sum("sum_toxicity").alias("total_toxicity"))
    return totals.withColumn("network_avg_toxicity", safe_ratio(F.col("total_toxicity"), F.col("total_interactions")))


def _ends(arcs: DataFrame) -> DataFrame:
    """Each arc seen from its two ends, as a row with what that end sent or received."""
    none, zero = F.lit(0).cast("bigint"), F.lit(0.0)
    sent = F.struct(F.col("source").alias("node_id"), F.col("weight").alias("w_out"), none.alias("w_in"),
                    F.col("sum_toxicity").alias("t_out"), zero.alias("t_in"), F.lit(1).alias("n_out"),
                    F.lit(0).alias("n_in"))
    received = F.struct(F.col("target").alias("node_id"), none.alias("w_out"), F.col("weight").alias("w_in"),
                        zero.alias("t_out"), F.col("sum_toxicity").alias("t_in"), F.lit(0).alias("n_out"),
                        F.lit(1).alias("n_in"))
    return arcs.select(*K, F.inline(F.array(sent, received)))


def node_totals(arcs: DataFrame) -> DataFrame:
    """What ``node_flow`` and ``degrees`` read, in one pass over the arcs."""
    return _ends(arcs).groupBy(*K, "node_id").agg(
        F.sum("w_out").alias("w_out"), F.sum("w_in").alias("w_in"), exact_sum("t_out").alias("t_out"), exact_sum("t_in").alias("t_in"),
        F.sum("n_in").alias("n_in"), F.sum("n_out").alias("n_out"), F.count(F.lit(1)).alias("n"))


def node_flow(arcs: DataFrame, totals: DataFrame | None = None) -> DataFrame:
    """Interactions and toxicity sent and received per node, in one pass over the arcs, or from their ``totals``."""
    flow = totals if totals is not None else _ends(arcs).groupBy(*K, "node_id").agg(
        F.sum("w_out").alias("w_out"), F.sum("w_in").alias("w_in"), exact_sum("t_out").alias("t_out"), exact_sum("t_in").alias("t_in"))
    flow = flow.select(
        *K, "node_id", F.col("w_out").alias("interactions_sent"), F.col("w_in").alias("interactions_received"),
        F.col("t_out").alias("toxicity_sent"), F.col("t_in").alias("toxicity_received"))
    return flow.select(
        *K, "node_id", "interactions_sent", "interactions_received",
        (F.col("interactions_sent") + F.col("interactions_received")).alias("interactions_total"),
        "toxicity_sent", "toxicity_received",
        safe_ratio(F.col("toxicity_sent"), F.col("interactions_sent")).alias("toxicity_sent_avg"),
        safe_ratio(F.col("toxicity_received"), F.col("interactions_received")).alias("toxicity_received_avg"))


def degrees(arcs: DataFrame, totals: DataFrame | None = None) -> DataFrame:
    """In, out, total and weighted degrees; a self-loop counts once on each side."""
    degree = totals if totals is not None else _ends(arcs).groupBy(*K, "node_id").agg(
        F.sum("n_in").alias("n_in"), F.sum("n_out").alias("n_out"), F.count(F.lit(1)).alias("n"),
        F.sum("w_in").alias("w_in"), F.sum("w_out").alias("w_out"))
    return degree.select(*K, "node_id", F.col("n_in").alias("in_degree"), F.col("n_out").alias("out_degree"), F.col("n").alias("total_degree"),
                         F.col("w_in").alias("weighted_in_degree"), F.col("w_out").alias("weighted_out_degree"))


def node_toxicity_stats(flow: DataFrame) -> DataFrame:
    """Median, highest and lowest average toxicity sent, over all nodes."""
    flow = settle(flow.select(*K, "toxicity_sent_avg"))
    ends = flow.groupBy(*K).agg(F.max("toxicity_sent_avg").alias("max_node_toxicity"),
                                F.min("toxicity_sent_avg").alias("min_node_toxicity"))
    return exact_quantile(flow, K, "toxicity_sent_avg", 0.5, "median_node_toxicity").join(ends, K)


def degree_summary(degree: DataFrame) -> DataFrame:
    return degree.groupBy(*K).agg(F.avg("total_degree").alias("avg_degree"), F.max("total_degree").alias("max_degree"))


def reciprocity(arcs: DataFrame) -> DataFrame:
    """Share of arcs whose reverse exists; a self-loop does not count as one."""
    both = arcs.where(F.col("source") != F.col("target")).groupBy(
        *K, F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")
    ).agg(F.count(F.lit(1)).alias("ways")).groupBy(*K).agg(F.sum(F.when(F.col("ways") == 2, 2).otherwise(0)).alias("back"))
    total = arcs.groupBy(*K).agg(F.count(F.lit(1)).alias("arcs"))
    return total.join(both, K, "left").select(
        *K, (F.coalesce("back", F.lit(0)) / F.col("arcs")).alias("reciprocity"))


def assortativity(arcs: DataFrame, degree: DataFrame) -> DataFrame:
    """Correlation over arcs of the source's out-degree with the target's in-degree."""
    rows = arcs.count()
    joined = hot_join(arcs.select(*K, "source", "target"),
                      degree.select(*K, F.col("node_id").alias("source"), "out_degree"), [*K, "source"], rows=rows)
    joined = hot_join(joined, degree.select(*K, F.col("node_id").alias("target"), "in_degree"), [*K, "target"], rows=rows)
    return joined.groupBy(*K).agg(
        correlation(F.col("out_degree").cast("double"), F.col("in_degree").cast("double")).alias("assortativity"))


def assortativity_of(g: GraphSet) -> DataFrame:
    """``assortativity`` of each graph, in one task where one holds it."""
    return g.in_tasks(whole.assortativity, ASSORTATIVITY, lambda big: assortativity(big.arcs, degrees(big.arcs)))


def rich_club(g: GraphSet) -> DataFrame:
    """Mean over d = 0, 1, … of the density among nodes of degree above d, while two such nodes remain.

    Pairs are undirected without self-loops. Both histograms are by degree, whose
    distinct values in one graph are fewer than twice the root of its pairs, so the
    suffix sums run over small groups. Nodes of degree 0 are above no d.
    """
    return g.in_tasks(whole.rich_club, RICH_CLUB, _rich_club)


def _rich_club(g: GraphSet) -> DataFrame:
    degree = pair_degrees(g).select("gid", "node_id", F.col("neighbours").alias("degree"))
    low = g.simple_pairs.select("gid", "a", "b")
    for end in ("a", "b"):
        one = degree.select(F.col("node_id").alias(end), F.col("degree").alias(f"d{end}"))
        low = hot_join(low, one, [end], rows=g.arc_rows, slot_rows=g.slot_rows)
    by_pair = low.groupBy("gid", F.least("da", "db").alias("degree")).agg(F.count(F.lit(1)).alias("links"))
    by_node = degree.groupBy("gid", "degree").agg(F.count(F.lit(1)).alias("members"))
    falling = Window.partitionBy("gid").orderBy(F.desc("degree"))
    # Between two degrees that occur, the set of richer nodes is the same for every d.
    steps = by_node.join(by_pair, ["gid", "degree"], "left").select(
        "gid", F.sum("members").over(falling).alias("n"),
        F.sum(F.coalesce("links", F.lit(0))).over(falling).alias("e"),
        (F.col("degree") - F.coalesce(F.lead("degree").over(falling), F.lit(0))).alias("run"))
    coefficient = 2 * F.col("e") / (F.col("n") * (F.col("n") - 1))
    return g.by_graph(steps.where(F.col("n") > 1).groupBy("gid").agg(
        (F.sum(F.col("run") * coefficient) / F.sum("run")).alias("rich_club_coefficient")))


def rich_club_density(g: GraphSet, q: float = 0.9) -> DataFrame:
    """Density among the nodes whose total degree reaches the ``q`` quantile."""
    return g.in_tasks(whole.rich_club_density, "rich_club_density double", lambda big: _rich_club_density(big.arcs, settle(degrees(big.arcs)), q), q)


def _rich_club_density(arcs: DataFrame, degree: DataFrame, q: float) -> DataFrame:
    cut = exact_quantile(degree, K, "total_degree", q, "cut")
    rich = settle(with_small(degree, cut, K).where(F.col("total_degree") >= F.col("cut")).select(*K, "node_id"))
    nodes = rich.groupBy(*K).agg(F.count(F.lit(1)).alias("nodes"))
    edges = induced(arcs, rich).groupBy(*K).agg(F.count(F.lit(1)).alias("edges"))
    size = nodes.join(edges, K, "left").na.fill(0, ["edges"])
    return density(size).withColumnRenamed("density", "rich_club_density")


def triads(g: GraphSet) -> DataFrame:
    """Triangle counts per node: ``triangles``, their directed weight and transitive triples.

    Pairs are directed from lower to higher (degree, id), which leaves at most the root
    of twice the pairs as out-neighbours of any node. Each pair (u, v) intersects the two
    neighbour lists: no wedge is ever emitted, only closed triangles are. Lists are kept
    by arc direction, so the same four intersections serve the directed measures.
    """
    return g.once("triads", lambda: _triads(g))


def _triads(g: GraphSet) -> DataFrame:
    pairs, rows = g.simple_pairs, g.arc_rows
    degree = pair_degrees(g).select("node_id", F.col("neighbours").alias("degree"))
    for end in ("a", "b"):
        pairs = hot_join(pairs, degree.select(F.col("node_id").alias(end), F.col("degree").alias(f"d{end}")),
                         [end], rows=rows, slot_rows=g.slot_rows)
    upward = (F.col("da") < F.col("db")) | ((F.col("da") == F.col("db")) & (F.col("a") < F.col("b")))
    pairs = settle(pairs.select(
        "gid", F.when(upward, F.col("a")).otherwise(F.col("b")).alias("u"),
        F.when(upward, F.col("b")).otherwise(F.col("a")).alias("v"),
        F.when(upward, F.col("forward")).otherwise(F.col("backward")).alias("f"),
        F.when(upward, F.col("backward")).otherwise(F.col("forward")).alias("b")))
    lists = settle(pairs.groupBy("u").agg(
        F.collect_list("v").alias("all"),
        F.collect_list(F.when(F.col("f") == 1, F.col("v"))).alias("to"),
        F.collect_list(F.when(F.col("b") == 1, F.col("v"))).alias("from")))

    def named(end: str) -> DataFrame:
        return lists.select(F.col("u").alias(end), *[F.col(c).alias(f"{end}_{c}") for c in ("all", "to", "from")])

    # A hub is an upper end of many pairs; its own list is short, and it is copied to each slot.
    closed = hot_join(pairs, named("v"), ["v"], rows=rows, slot_rows=g.slot_rows)
    closed = closed.join(named("u"), "u")
    cross = {(i, j): F.array_intersect(f"u_{i}", f"v_{j}") for i in ("to", "from") for j in ("to", "from")}
    closed = (closed.withColumn("third", F.array_intersect("u_all", "v_all")).where(F.size("third") > 0)
              .select("gid", "u", "v", "f", "b", "third", cross["to", "to"].alias("tt"), cross["to", "from"].alias("tf"),
                      cross["from", "to"].alias("ft"), cross["from", "from"].alias("ff")))
    ways = F.col("f") + F.col("b")
    each = F.concat("tt", "tf", "ft", "ff")
    triples = (F.col("f") * (F.size("tt") + F.size("tf") + F.size("ff"))
               + F.col("b") * (F.size("tt") + F.size("ft") + F.size("ff")))
    count, none = F.size("third"), F.lit(0)

    def row(node, n, directed, transitive):
        return F.struct(node.alias("node_id"), n.cast("bigint").alias("n"), directed.cast("bigint").alias("directed"),
                        transitive.cast("bigint").alias("transitive"))

    sides = F.array(row(F.col("u"), count, ways * F.size(each), triples), row(F.col("v"), count, ways * F.size(each), none))
    thirds = F.transform("third", lambda w: row(w, F.lit(1), none, none))
    weighted = F.transform(each, lambda w: row(w, none, ways, none))
    return (closed.select("gid", F.inline(F.concat(sides, thirds, weighted)))
            .groupBy("gid", "node_id").agg(F.sum("n").alias("triangles"), (2 * F.sum("directed")).alias("directed_triangles"),
                                        F.sum("transitive").alias("transitive_triples")))


def pair_degrees(g: GraphSet) -> DataFrame:
    """Neighbours, arcs and two-way neighbours per node number, self-loops left out."""
    ways = (F.col("forward") + F.col("backward")).alias("ways")
    return g.once("pair degrees", lambda: (
        g.simple_pairs.select("gid", F.explode(F.array("a", "b")).alias("node_id"), ways).groupBy("gid", "node_id").agg(
            F.count(F.lit(1)).alias("neighbours"), F.sum("ways").alias("arcs"),
            F.sum(F.when(F.col("ways") == 2, 1).otherwise(0)).alias("mutual"))))


def triad_table(g: GraphSet) -> DataFrame:
    """Triad counts and pair degrees of every node, by name."""
    counts = ("triangles", "directed_triangles", "transitive_triples", "neighbours", "arcs", "mutual")

    def joined(big: GraphSet) -> DataFrame:
        return big.named(big.ids.join(pair_degrees(big).drop("gid"), "node_id", "left")
                         .join(triads(big).drop("gid"), "node_id", "left").na.fill(0).select("node_id", *counts))

    return g.once("triad table", lambda: g.in_tasks(
        whole.triad_counts, TRIADS, joined))


def clustering(g: GraphSet) -> DataFrame:
    """Triangles with undirected and directed clustering for every node."""
    d, t, two = F.col("neighbours"), F.col("arcs"), F.col("mutual")
    return triad_table(g).select(
        *K, "node_id", "triangles",
        safe_ratio(2.0 * F.col("triangles"), d * (d - 1)).alias("clustering"),
        safe_ratio(F.col("directed_triangles").cast("double"), 2 * (t * (t - 1) - 2 * two)).alias("clustering_directed"))


def average_clustering(node_clustering: DataFrame) -> DataFrame:
    return node_clustering.groupBy(*K).agg(F.avg("clustering").alias("average_clustering"),
                                           F.avg("clustering_directed").alias("average_clustering_directed"))


def transitivity(g: GraphSet) -> DataFrame:
    """Closed successor pairs over all successor pairs; 0 without a closed one."""
    arcs = g.arcs.select(*K, "source", (F.col("source") != F.col("target")).cast("bigint").alias("way"))
    out = arcs.groupBy(*K, "source").agg(F.sum("way").alias("d"))
    possible = out.groupBy(*K).agg(F.sum(F.col("d") * (F.col("d") - 1)).alias("possible"))
    closed = triad_table(g).groupBy(*K).agg(F.sum("transitive_triples").alias("closed"))
    return possible.join(closed, K, "left").select(*K, safe_ratio(F.coalesce("closed", F.lit(0)).cast("double"), F.col("possible")).alias("transitivity"))


def label_ends(arcs: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """Attach a node label to both ends: ``source_<label>`` and ``target_<label>``."""
    rows = arcs.count()
    for end in ("source", "target"):
        one = labels.select(*K, F.col("node_id").alias(end), F.col(label).alias(f"{end}_{label}"))
        arcs = hot_join(arcs, one, [*K, end], rows=rows)
    return arcs
