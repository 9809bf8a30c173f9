"""Queries on graph construction, graph metrics, distributions and composite tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.skew import top_rows
from ..operators import blocks, build, community, components, distributions, kcore, local, pagerank, paths, sampling, tables
from ..operators.build import K, GraphSet
from ..session import scratch_path, settle
from .. import schemas
from ..sources import readers, writers
from . import fixtures
from .registry import DEGREES, FLOW, NODES, PAIRS, POLITICIANS, SIZES, STRONG, WEAK, query, rounded, with_edges

N = [*K, "node_id"]
SAME = "USING (graph_id, month_start)"


_shared: dict[tuple[str, str], GraphSet] = {}


def graphs(spark: SparkSession, sf: str) -> GraphSet:
    """The graphs of all months; queries of one application share what is computed on them."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _shared:
        _shared[key] = GraphSet(fixtures.edges(spark, sf))
    return _shared[key]


def forget() -> None:
    """Let the next query compute everything anew, as the benchmark does."""
    for g in _shared.values():
        g.close()
    _shared.clear()


def node_table(g: GraphSet) -> DataFrame:
    return g.once("node table", lambda: tables.node_metrics(g))


def arcs_of(spark: SparkSession, sf: str) -> DataFrame:
    return build.simple_arcs(fixtures.edges(spark, sf))


def lettered(nodes: DataFrame) -> DataFrame:
    """A partition that SQL can state: by the last digit of the node id."""
    return nodes.select(*N, F.substring("node_id", -1, 1).alias("community"))


# Construction -----------------------------------------------------------------------------------------------------

@query("g_build", with_edges("""SELECT graph_id, CAST(date_trunc('month', month_start) AS DATE) AS month_start, source, target, kept.weight AS weight,
  kept.sum_toxicity AS sum_toxicity, kept.avg_toxicity AS avg_toxicity FROM (SELECT graph_id, date_trunc('month', month_start) AS month_start, source, target,
  min({'weight': weight, 'sum_toxicity': sum_toxicity, 'avg_toxicity': avg_toxicity}) AS kept FROM edges GROUP BY 1, 2, 3, 4)""", grain="week"))
def g_build(spark, sf):
    weekly = fixtures.derive_edges(spark, sf, "week")
    return build.simple_arcs(weekly.withColumn("month_start", F.to_date(F.date_trunc("month", "month_start"))))


@query("g_undirected", with_edges("""SELECT graph_id, month_start, least(source, target) AS a, greatest(source, target) AS b, max(weight) AS weight,
  CAST(max(CASE WHEN source <= target THEN 1 ELSE 0 END) AS INTEGER) AS forward, CAST(max(CASE WHEN source >= target THEN 1 ELSE 0 END) AS INTEGER) AS backward FROM edges GROUP BY 1, 2, 3, 4"""))
def g_undirected(spark, sf):
    return build.undirected_pairs(arcs_of(spark, sf), loops=True)


@query("g_drop_selfloops", with_edges("SELECT graph_id, month_start, a, b, weight FROM pairs", extra=PAIRS))
def g_drop_selfloops(spark, sf):
    return build.drop_selfloops(build.undirected_pairs(arcs_of(spark, sf), loops=True)).select(*K, "a", "b", "weight")


@query("g_induced", with_edges("""SELECT e.* FROM edges e WHERE source IN (SELECT twitter_handle FROM politicians) AND target IN (SELECT twitter_handle FROM politicians)""", extra=POLITICIANS))
def g_induced(spark, sf):
    g = graphs(spark, sf)
    return build.induced(g.arcs, tables.politician_nodes(g.nodes, fixtures.politicians(spark, sf)).select(*N))


LARGEST = """component_size AS (SELECT graph_id, month_start, component, count(*) AS size FROM weak GROUP BY 1, 2, 3),
largest AS (SELECT graph_id, month_start, component, size FROM (SELECT *, row_number() OVER (PARTITION BY graph_id, month_start ORDER BY size DESC, component) AS place FROM component_size) WHERE place = 1)"""


@query("g_largest_wcc", with_edges(f"""SELECT e.* FROM edges e JOIN weak w ON w.graph_id = e.graph_id AND w.month_start = e.month_start AND w.node_id = e.source
  JOIN largest l ON l.graph_id = e.graph_id AND l.month_start = e.month_start AND l.component = w.component""", extra=f"{WEAK}, {LARGEST}"))
def g_largest_wcc(spark, sf):
    with graphs(spark, sf) as g:
        return settle(components.largest_subgraph(g, components.weak_components(g)))


# Local metrics ----------------------------------------------------------------------------------------------------

@query("g_size", with_edges("SELECT * FROM size", extra=SIZES))
def g_size(spark, sf):
    return local.sizes(arcs_of(spark, sf))


@query("g_density", with_edges("SELECT graph_id, month_start, round(CASE WHEN nodes > 1 THEN CAST(edges AS DOUBLE) / (nodes * (nodes - 1)) ELSE 0 END, 6) AS density FROM size", extra=SIZES))
def g_density(spark, sf):
    return rounded(local.density(local.sizes(arcs_of(spark, sf))))


@query("g_degrees", with_edges("SELECT * FROM degrees", extra=DEGREES))
def g_degrees(spark, sf):
    return local.degrees(arcs_of(spark, sf))


@query("a_degree_summary", with_edges("SELECT graph_id, month_start, round(avg(total_degree), 6) AS avg_degree, max(total_degree) AS max_degree FROM degrees GROUP BY 1, 2", extra=DEGREES))
def a_degree_summary(spark, sf):
    return rounded(local.degree_summary(local.degrees(arcs_of(spark, sf))))


@query("g_reciprocity", with_edges("""SELECT graph_id, month_start, round(avg(CASE WHEN source <> target AND EXISTS (SELECT 1 FROM edges r WHERE r.graph_id = e.graph_id
  AND r.month_start = e.month_start AND r.source = e.target AND r.target = e.source) THEN 1.0 ELSE 0.0 END), 6) AS reciprocity FROM edges e GROUP BY 1, 2"""))
def g_reciprocity(spark, sf):
    return rounded(local.reciprocity(arcs_of(spark, sf)))


@query("g_assortativity", with_edges("""SELECT graph_id, month_start, CASE WHEN stddev_pop(o.out_degree) * stddev_pop(i.in_degree) > 0 THEN round(corr(o.out_degree, i.in_degree), 6) + 0.0 END AS assortativity
  FROM edges e JOIN degrees o ON o.graph_id = e.graph_id AND o.month_start = e.month_start AND o.node_id = e.source
  JOIN degrees i ON i.graph_id = e.graph_id AND i.month_start = e.month_start AND i.node_id = e.target GROUP BY e.graph_id, e.month_start""".replace(
      "SELECT graph_id, month_start", "SELECT e.graph_id, e.month_start"), extra=DEGREES))
def g_assortativity(spark, sf):
    return rounded(local.assortativity_of(graphs(spark, sf)))


TRIANGLES = f"""{NODES}, {PAIRS},
closed AS (SELECT x.graph_id, x.month_start, x.node_id, x.ways * y.ways * p.ways AS ways FROM linked x
  JOIN linked y ON y.graph_id = x.graph_id AND y.month_start = x.month_start AND y.node_id = x.node_id AND x.other < y.other
  JOIN pairs p ON p.graph_id = x.graph_id AND p.month_start = x.month_start AND p.a = x.other AND p.b = y.other),
triangle AS (SELECT graph_id, month_start, node_id, count(*) AS t, sum(ways) AS directed FROM closed GROUP BY 1, 2, 3),
neighbour AS (SELECT graph_id, month_start, node_id, count(*) AS d, sum(ways) AS total, count(*) FILTER (ways = 2) AS mutual FROM linked GROUP BY 1, 2, 3),
clustered AS (SELECT n.graph_id, n.month_start, n.node_id, coalesce(t, 0) AS triangles,
  CASE WHEN d > 1 THEN 2.0::DOUBLE * coalesce(t, 0) / (d * (d - 1)) ELSE 0 END AS clustering,
  CASE WHEN coalesce(directed, 0) > 0 THEN CAST(directed AS DOUBLE) / (total * (total - 1) - 2 * mutual) ELSE 0 END AS clustering_directed
  FROM nodes n LEFT JOIN triangle r ON r.graph_id = n.graph_id AND r.month_start = n.month_start AND r.node_id = n.node_id
  LEFT JOIN neighbour b ON b.graph_id = n.graph_id AND b.month_start = n.month_start AND b.node_id = n.node_id)"""


def clustered(spark: SparkSession, sf: str) -> DataFrame:
    return local.clustering(graphs(spark, sf))


@query("g_triangles", with_edges("SELECT graph_id, month_start, node_id, triangles FROM clustered", extra=TRIANGLES))
def g_triangles(spark, sf):
    return clustered(spark, sf).select(*N, "triangles")


@query("g_clustering", with_edges("SELECT graph_id, month_start, node_id, round(clustering, 6) AS clustering FROM clustered", extra=TRIANGLES))
def g_clustering(spark, sf):
    return rounded(clustered(spark, sf).select(*N, "clustering"))


@query("g_clustering_directed", with_edges("SELECT graph_id, month_start, node_id, round(clustering_directed, 6) AS clustering_directed FROM clustered", extra=TRIANGLES))
def g_clustering_directed(spark, sf):
    return rounded(clustered(spark, sf).select(*N, "clustering_directed"))


@query("g_avg_clustering", with_edges("""SELECT graph_id, month_start, round(avg(clustering), 6) AS average_clustering,
  round(avg(clustering_directed), 6) AS average_clustering_directed FROM clustered GROUP BY 1, 2""", extra=TRIANGLES))
def g_avg_clustering(spark, sf):
    return rounded(local.average_clustering(clustered(spark, sf)))


TRANSITIVITY = """arc AS (SELECT graph_id, month_start, source, target FROM edges WHERE source <> target),
triple AS (SELECT x.graph_id, x.month_start, count(*) AS closed FROM arc x
  JOIN arc y ON y.graph_id = x.graph_id AND y.month_start = x.month_start AND y.source = x.source AND y.target <> x.target
  JOIN arc z ON z.graph_id = x.graph_id AND z.month_start = x.month_start AND z.source = x.target AND z.target = y.target GROUP BY 1, 2),
fan AS (SELECT graph_id, month_start, sum(d * (d - 1)) AS possible FROM (SELECT graph_id, month_start, source, count(*) AS d FROM arc GROUP BY 1, 2, 3) GROUP BY 1, 2),
transit AS (SELECT m.graph_id, m.month_start, CASE WHEN coalesce(closed, 0) > 0 THEN CAST(closed AS DOUBLE) / possible ELSE 0 END AS transitivity
  FROM (SELECT DISTINCT graph_id, month_start FROM edges) m LEFT JOIN triple t ON t.graph_id = m.graph_id AND t.month_start = m.month_start
  LEFT JOIN fan f ON f.graph_id = m.graph_id AND f.month_start = m.month_start)"""


@query("g_transitivity", with_edges("SELECT graph_id, month_start, round(transitivity, 6) AS transitivity FROM transit", extra=TRANSITIVITY))
def g_transitivity(spark, sf):
    g = graphs(spark, sf)
    return rounded(local.transitivity(g))


RICH = f"""{PAIRS}, neighbour AS (SELECT graph_id, month_start, node_id, count(*) AS d FROM linked GROUP BY 1, 2, 3),
low AS (SELECT p.graph_id, p.month_start, least(x.d, y.d) AS d FROM pairs p
  JOIN neighbour x ON x.graph_id = p.graph_id AND x.month_start = p.month_start AND x.node_id = p.a
  JOIN neighbour y ON y.graph_id = p.graph_id AND y.month_start = p.month_start AND y.node_id = p.b),
levels AS (SELECT graph_id, month_start, unnest(range(max(d))) AS d FROM neighbour GROUP BY 1, 2),
rich_nodes AS (SELECT l.graph_id, l.month_start, l.d, count(*) AS n FROM levels l JOIN neighbour x ON x.graph_id = l.graph_id AND x.month_start = l.month_start AND x.d > l.d GROUP BY 1, 2, 3),
rich_pairs AS (SELECT l.graph_id, l.month_start, l.d, count(*) AS e FROM levels l JOIN low x ON x.graph_id = l.graph_id AND x.month_start = l.month_start AND x.d > l.d GROUP BY 1, 2, 3),
rich AS (SELECT graph_id, month_start, avg(2.0::DOUBLE * coalesce(e, 0) / (n * (n - 1))) AS rich_club_coefficient
  FROM rich_nodes LEFT JOIN rich_pairs USING (graph_id, month_start, d) WHERE n > 1 GROUP BY 1, 2)"""


@query("g_rich_club", with_edges("SELECT graph_id, month_start, round(rich_club_coefficient, 6) AS rich_club_coefficient FROM rich", extra=RICH))
def g_rich_club(spark, sf):
    return rounded(local.rich_club(graphs(spark, sf)))


@query("g_rich_club_density", with_edges("""SELECT n.graph_id, n.month_start, round(CASE WHEN n > 1 THEN CAST(coalesce(e, 0) AS DOUBLE) / (n * (n - 1)) ELSE 0 END, 6) AS rich_club_density
  FROM (SELECT graph_id, month_start, count(*) AS n FROM chosen GROUP BY 1, 2) n LEFT JOIN
  (SELECT e.graph_id, e.month_start, count(*) AS e FROM edges e JOIN chosen s ON s.graph_id = e.graph_id AND s.month_start = e.month_start AND s.node_id = e.source
   JOIN chosen t ON t.graph_id = e.graph_id AND t.month_start = e.month_start AND t.node_id = e.target GROUP BY 1, 2) k ON k.graph_id = n.graph_id AND k.month_start = n.month_start""",
    extra=f"""{DEGREES}, cut AS (SELECT graph_id, month_start, quantile_cont(total_degree, 0.9) AS c FROM degrees GROUP BY 1, 2),
    chosen AS (SELECT graph_id, month_start, node_id FROM degrees JOIN cut {SAME} WHERE total_degree >= c)"""))
def g_rich_club_density(spark, sf):
    return rounded(local.rich_club_density(graphs(spark, sf)))


LETTERED = f"{NODES}, {PAIRS}, parted AS (SELECT graph_id, month_start, node_id, right(node_id, 1) AS community FROM nodes)"


SCORED = f"""{LETTERED},
  part_side AS (SELECT graph_id, month_start, right(a, 1) AS community, CASE WHEN right(a, 1) = right(b, 1) THEN weight ELSE 0 END AS inside, weight AS ends FROM pairs
    UNION ALL SELECT graph_id, month_start, right(b, 1), 0, weight FROM pairs),
  part_sum AS (SELECT graph_id, month_start, community, CAST(sum(inside) AS DOUBLE) AS inside, CAST(sum(ends) AS DOUBLE) AS ends FROM part_side GROUP BY 1, 2, 3),
  part_total AS (SELECT graph_id, month_start, sum(ends) / 2 AS m FROM part_sum GROUP BY 1, 2)"""


@query("g_modularity", with_edges("""SELECT m.graph_id, m.month_start, round(q, 6) + 0.0 AS modularity FROM (SELECT DISTINCT graph_id, month_start FROM nodes) m LEFT JOIN
  (SELECT graph_id, month_start, sum(inside / m - pow(ends / (2 * m), 2)) AS q FROM part_sum JOIN part_total USING (graph_id, month_start) GROUP BY 1, 2) s
  ON s.graph_id = m.graph_id AND s.month_start = m.month_start""", extra=SCORED))
def g_modularity(spark, sf):
    g = graphs(spark, sf)
    return rounded(community.modularity(g, lettered(g.nodes)))


@query("g_community_summary", with_edges("""SELECT p.graph_id, p.month_start, p.community, p.size, coalesce(c.inside, 0) AS internal_edges, coalesce(c.leaving, 0) AS external_edges
  FROM (SELECT graph_id, month_start, community, count(*) AS size FROM parted GROUP BY 1, 2, 3) p LEFT JOIN
  (SELECT graph_id, month_start, right(source, 1) AS community, count(*) FILTER (right(source, 1) = right(target, 1)) AS inside,
   count(*) FILTER (right(source, 1) <> right(target, 1)) AS leaving FROM edges GROUP BY 1, 2, 3) c
  ON c.graph_id = p.graph_id AND c.month_start = p.month_start AND c.community = p.community""", extra=LETTERED))
def g_community_summary(spark, sf):
    g = graphs(spark, sf)
    return community.community_summary(g, lettered(g.nodes))


@query("a_community_toxicity", with_edges("""SELECT graph_id, month_start, round(max(t), 6) AS max_community_toxicity, round(min(t), 6) AS min_community_toxicity FROM
  (SELECT graph_id, month_start, right(node_id, 1) AS community, avg(toxicity_sent_avg) AS t FROM flow GROUP BY 1, 2, 3) GROUP BY 1, 2""", extra=FLOW))
def a_community_toxicity(spark, sf):
    arcs = arcs_of(spark, sf)
    toxicity = community.community_toxicity(local.node_flow(arcs), lettered(build.node_set(arcs)))
    return rounded(community.community_toxicity_range(toxicity))


# Components -------------------------------------------------------------------------------------------------------

@query("g_wcc", with_edges("SELECT * FROM weak", extra=WEAK))
def g_wcc(spark, sf):
    with graphs(spark, sf) as g:
        return components.weak_components(g)


@query("g_wcc_table", with_edges("""SELECT s.graph_id, s.month_start, s.component, s.size, round(CASE WHEN size > 1 THEN CAST(coalesce(edges, 0) AS DOUBLE) / (size * (size - 1)) ELSE 0 END, 6) AS density
  FROM component_size s LEFT JOIN (SELECT e.graph_id, e.month_start, component, count(*) AS edges FROM edges e
  JOIN weak w ON w.graph_id = e.graph_id AND w.month_start = e.month_start AND w.node_id = e.source GROUP BY 1, 2, 3) k
  ON k.graph_id = s.graph_id AND k.month_start = s.month_start AND k.component = s.component""", extra=f"{WEAK}, {LARGEST}"))
def g_wcc_table(spark, sf):
    with graphs(spark, sf) as g:
        return rounded(components.component_table(g, components.weak_components(g)))


@query("g_is_weakly_connected", with_edges("""SELECT graph_id, month_start, count(DISTINCT component) AS num_components, count(DISTINCT component) = 1 AS is_weakly_connected FROM weak GROUP BY 1, 2""", extra=WEAK))
def g_is_weakly_connected(spark, sf):
    with graphs(spark, sf) as g:
        return components.component_count(components.weak_components(g))


@query("g_scc", with_edges("SELECT * FROM strong", extra=STRONG))
def g_scc(spark, sf):
    with graphs(spark, sf) as g:
        return components.strong_components(g)


@query("g_scc_count", with_edges("SELECT graph_id, month_start, count(DISTINCT scc) AS connected_components FROM strong GROUP BY 1, 2", extra=STRONG))
def g_scc_count(spark, sf):
    with graphs(spark, sf) as g:
        return components.strong_component_count(components.strong_components(g))


@query("g_cycle_edge_ratio", with_edges("""SELECT e.graph_id, e.month_start, round(avg(CASE WHEN s.scc = t.scc THEN 1.0 ELSE 0.0 END), 6) AS cycle_edge_ratio FROM edges e
  JOIN strong s ON s.graph_id = e.graph_id AND s.month_start = e.month_start AND s.node_id = e.source
  JOIN strong t ON t.graph_id = e.graph_id AND t.month_start = e.month_start AND t.node_id = e.target GROUP BY 1, 2""", extra=STRONG))
def g_cycle_edge_ratio(spark, sf):
    with graphs(spark, sf) as g:
        return rounded(components.cycle_edge_ratio(g, components.strong_components(g)))


# Other fixpoints --------------------------------------------------------------------------------------------------

RANKS = f"""{SIZES},
sent AS (SELECT graph_id, month_start, source AS node_id, CAST(sum(weight) AS DOUBLE) AS out FROM edges GROUP BY 1, 2, 3),
base AS (SELECT n.graph_id, n.month_start, n.node_id, s.nodes AS n, o.out FROM nodes n JOIN size s ON s.graph_id = n.graph_id AND s.month_start = n.month_start
  LEFT JOIN sent o ON o.graph_id = n.graph_id AND o.month_start = n.month_start AND o.node_id = n.node_id),
ranks(i, graph_id, month_start, node_id, x, moved) AS (
  SELECT 0, graph_id, month_start, node_id, 1.0::DOUBLE / n, CAST(n AS DOUBLE) FROM base
  UNION ALL
  SELECT i + 1, graph_id, month_start, node_id, x, sum(abs(x - was)) OVER (PARTITION BY graph_id, month_start) FROM (
    SELECT i, graph_id, month_start, node_id, sum(x) AS x, sum(was) AS was FROM (
      SELECT r.i, e.graph_id, e.month_start, e.target AS node_id, 0.85 * r.x * e.weight / b.out AS x, 0.0::DOUBLE AS was FROM ranks r
        JOIN base b ON b.graph_id = r.graph_id AND b.month_start = r.month_start AND b.node_id = r.node_id
        JOIN edges e ON e.graph_id = r.graph_id AND e.month_start = r.month_start AND e.source = r.node_id WHERE r.moved >= b.n * 1e-6::DOUBLE
      UNION ALL
      SELECT r.i, b.graph_id, b.month_start, b.node_id, (0.85 * d.loose + 0.15) / b.n, r.x FROM ranks r
        JOIN base b ON b.graph_id = r.graph_id AND b.month_start = r.month_start AND b.node_id = r.node_id JOIN
        (SELECT r.graph_id, r.month_start, sum(CASE WHEN b.out IS NULL THEN r.x ELSE 0 END) AS loose FROM ranks r
           JOIN base b ON b.graph_id = r.graph_id AND b.month_start = r.month_start AND b.node_id = r.node_id GROUP BY 1, 2) d
        ON d.graph_id = b.graph_id AND d.month_start = b.month_start WHERE r.moved >= b.n * 1e-6::DOUBLE)
    GROUP BY 1, 2, 3, 4)),
pagerank AS (SELECT r.graph_id, r.month_start, r.node_id, r.x AS pagerank FROM ranks r
  JOIN (SELECT graph_id, month_start, max(i) AS i FROM ranks GROUP BY 1, 2) l ON l.graph_id = r.graph_id AND l.month_start = r.month_start AND l.i = r.i)"""


def ranks(spark: SparkSession, sf: str) -> DataFrame:
    with graphs(spark, sf) as g:
        return pagerank.pagerank(g).select(*N, "pagerank")


RANK_ROWS = with_edges("SELECT graph_id, month_start, node_id, round(pagerank, 6) AS pagerank FROM pagerank", extra=RANKS)


@query("g_pagerank", RANK_ROWS)
def g_pagerank(spark, sf):
    return rounded(ranks(spark, sf))


@query("g_pagerank_converged", RANK_ROWS.replace("AS pagerank FROM pagerank", "AS pagerank, true AS converged FROM pagerank"))
def g_pagerank_converged(spark, sf):
    with graphs(spark, sf) as g:
        return rounded(pagerank.pagerank(g))


@query("w_pagerank_rank", with_edges("""SELECT * FROM (SELECT graph_id, month_start, node_id, round(pagerank, 9) AS pagerank,
  row_number() OVER (PARTITION BY graph_id, month_start ORDER BY round(pagerank, 9) DESC, node_id) AS position FROM pagerank) WHERE position <= 1000""", extra=RANKS))
def w_pagerank_rank(spark, sf):
    return top_rows(rounded(ranks(spark, sf), 9), K, [F.desc("pagerank"), F.col("node_id")], 1000)


CORES = f"""{NODES}, {PAIRS},
core(i, graph_id, month_start, node_id, est) AS (
  SELECT 0, graph_id, month_start, node_id, count(*) FROM linked GROUP BY 2, 3, 4
  UNION ALL
  SELECT i + 1, graph_id, month_start, node_id, max(least(v, c)) FROM (
    SELECT i, graph_id, month_start, node_id, v, row_number() OVER (PARTITION BY graph_id, month_start, node_id ORDER BY v DESC) AS c FROM (
      SELECT n.i, b.graph_id, b.month_start, b.node_id, least(n.est, o.est) AS v FROM linked b
        JOIN core n ON n.graph_id = b.graph_id AND n.month_start = b.month_start AND n.node_id = b.other
        JOIN core o ON o.graph_id = b.graph_id AND o.month_start = b.month_start AND o.node_id = b.node_id))
  WHERE i < 40 GROUP BY 1, 2, 3, 4),
cores AS (SELECT n.graph_id, n.month_start, n.node_id, coalesce(est, 0) AS core_number FROM nodes n
  LEFT JOIN (SELECT * FROM core WHERE i = 40) c ON c.graph_id = n.graph_id AND c.month_start = n.month_start AND c.node_id = n.node_id)"""


@query("g_core_number", with_edges("SELECT * FROM cores", extra=CORES))
def g_core_number(spark, sf):
    with graphs(spark, sf) as g:
        return kcore.core_numbers(g)


@query("g_core_summary", with_edges("SELECT graph_id, month_start, max(core_number) AS max_core_number, round(avg(core_number), 6) AS avg_core_number FROM cores GROUP BY 1, 2", extra=CORES))
def g_core_summary(spark, sf):
    with graphs(spark, sf) as g:
        return rounded(kcore.core_summary(kcore.core_numbers(g)))


def _drawn(source: str) -> str:
    """The sampled nodes of ``source`` in SQL."""
    return f"""drawn AS (SELECT graph_id, month_start, node_id, n, least(n, 1000, greatest(50, CAST(floor(0.02 * n) AS BIGINT))) AS k FROM
  (SELECT *, count(*) OVER (PARTITION BY graph_id, month_start) AS n, row_number() OVER (PARTITION BY graph_id, month_start ORDER BY md5('42' || node_id), node_id) AS place FROM {source})
  WHERE place <= least(n, 1000, greatest(50, floor(0.02 * n))))"""


INSIDE = f"inside AS (SELECT w.graph_id, w.month_start, w.node_id FROM weak w JOIN largest l ON l.graph_id = w.graph_id AND l.month_start = w.month_start AND l.component = w.component)"


def _hops(origins: str, source: str = "source", target: str = "target") -> str:
    """Breadth-first levels in SQL: a node is kept at the first level that reaches it."""
    return f"""hop(graph_id, month_start, origin, node_id, d) AS (
  SELECT graph_id, month_start, node_id, node_id, 0 FROM {origins}
  UNION
  SELECT h.graph_id, h.month_start, h.origin, e.{target}, h.d + 1 FROM hop h
    JOIN edges e ON e.graph_id = h.graph_id AND e.month_start = h.month_start AND e.{source} = h.node_id
    WHERE NOT EXISTS (SELECT 1 FROM recurring.hop r WHERE r.graph_id = h.graph_id AND r.month_start = h.month_start AND r.origin = h.origin AND r.node_id = e.{target}))"""


def _keyed(origins: str, step: str, source: str = "source", target: str = "target") -> str:
    """Shortest distances in SQL, the best so far kept per (graph, month, origin, node)."""
    return f"""best(graph_id, month_start, origin, node_id, d) USING KEY (graph_id, month_start, origin, node_id) AS (
  SELECT graph_id, month_start, node_id, node_id, 0::BIGINT FROM {origins}
  UNION
  SELECT c.graph_id, c.month_start, c.origin, c.node_id, c.d FROM (
    SELECT h.graph_id, h.month_start, h.origin, e.{target} AS node_id, min(h.d + {step}) AS d FROM best h
      JOIN edges e ON e.graph_id = h.graph_id AND e.month_start = h.month_start AND e.{source} = h.node_id GROUP BY 1, 2, 3, 4) c
    LEFT JOIN recurring.best r ON r.graph_id = c.graph_id AND r.month_start = c.month_start AND r.origin = c.origin AND r.node_id = c.node_id
    WHERE r.d IS NULL OR c.d < r.d)"""


@query("g_sssp_hops", with_edges("SELECT graph_id, month_start, origin AS source, node_id AS target, d AS shortest_path_length FROM best",
                                 extra=f"{WEAK}, {LARGEST}, {INSIDE}, {_drawn('inside')}, {_keyed('drawn', '1')}"))
def g_sssp_hops(spark, sf):
    with graphs(spark, sf) as g:
        return paths.sampled_hops(g, components.weak_components(g))


@query("g_path_stats", with_edges("""SELECT m.graph_id, m.month_start, round(avg(d), 6) AS average_path_length, CAST(max(d) AS DOUBLE) AS diameter
  FROM (SELECT DISTINCT graph_id, month_start FROM nodes) m LEFT JOIN best b ON b.graph_id = m.graph_id AND b.month_start = m.month_start GROUP BY 1, 2""",
    extra=f"""{WEAK}, one AS (SELECT graph_id, month_start FROM weak GROUP BY 1, 2 HAVING count(DISTINCT component) = 1),
    origins AS (SELECT n.* FROM nodes n JOIN one {SAME}), {_keyed('origins', 'e.weight')}"""))
def g_path_stats(spark, sf):
    with graphs(spark, sf) as g:
        return rounded(paths.path_stats(g))


def _closeness_sql(step: str) -> str:
    return with_edges("""SELECT b.graph_id, b.month_start, b.origin AS node_id,
  round(CASE WHEN sum(d) > 0 THEN (count(*) - 1) / CAST(sum(d) AS DOUBLE) * (count(*) - 1) / (any_value(s.nodes) - 1) ELSE 0 END, 6) AS closeness
  FROM best b JOIN size s ON s.graph_id = b.graph_id AND s.month_start = b.month_start GROUP BY 1, 2, 3""",
                      extra=f"{SIZES}, {_keyed('nodes', step, 'target', 'source')}")


@query("g_closeness", _closeness_sql("1"))
def g_closeness(spark, sf):
    with graphs(spark, sf) as g:
        return rounded(settle(paths.closeness(g)))


@query("g_closeness_weighted", _closeness_sql("e.weight"))
def g_closeness_weighted(spark, sf):
    with graphs(spark, sf) as g:
        return rounded(settle(paths.closeness(g, weighted=True)))


BETWEEN = f"""{NODES}, {_drawn('nodes')}, {_keyed('drawn', 'e.weight')},
tight AS (SELECT x.graph_id, x.month_start, x.origin, x.node_id, y.node_id AS other FROM best x
  JOIN edges e ON e.graph_id = x.graph_id AND e.month_start = x.month_start AND e.source = x.node_id AND e.target <> e.source
  JOIN best y ON y.graph_id = x.graph_id AND y.month_start = x.month_start AND y.origin = x.origin AND y.node_id = e.target AND y.d = x.d + e.weight),
counted(i, graph_id, month_start, origin, node_id, c) AS (
  SELECT 0, graph_id, month_start, node_id, node_id, 1.0::DOUBLE FROM drawn
  UNION ALL SELECT i + 1, t.graph_id, t.month_start, t.origin, t.other, sum(c) FROM counted p
    JOIN tight t ON t.graph_id = p.graph_id AND t.month_start = p.month_start AND t.origin = p.origin AND t.node_id = p.node_id GROUP BY 1, 2, 3, 4, 5),
sigma AS (SELECT graph_id, month_start, origin, node_id, sum(c) AS s FROM counted GROUP BY 1, 2, 3, 4),
shares AS (SELECT t.*, a.s / b.s AS share FROM tight t
  JOIN sigma a ON a.graph_id = t.graph_id AND a.month_start = t.month_start AND a.origin = t.origin AND a.node_id = t.node_id
  JOIN sigma b ON b.graph_id = t.graph_id AND b.month_start = t.month_start AND b.origin = t.origin AND b.node_id = t.other),
depend(i, graph_id, month_start, origin, node_id, a) AS (
  SELECT 0, graph_id, month_start, origin, node_id, 1.0::DOUBLE FROM best
  UNION ALL SELECT i + 1, t.graph_id, t.month_start, t.origin, t.node_id, sum(share * a) FROM depend p
    JOIN shares t ON t.graph_id = p.graph_id AND t.month_start = p.month_start AND t.origin = p.origin AND t.other = p.node_id GROUP BY 1, 2, 3, 4, 5),
passed AS (SELECT graph_id, month_start, node_id, sum(a) AS a FROM depend WHERE i > 0 AND node_id <> origin GROUP BY 1, 2, 3),
scale AS (SELECT graph_id, month_start, CASE WHEN any_value(n) > 2 THEN any_value(n) / (any_value(k) * (any_value(n) - 1.0::DOUBLE) * (any_value(n) - 2)) ELSE 1 END AS f FROM drawn GROUP BY 1, 2),
between_ness AS (SELECT n.graph_id, n.month_start, n.node_id, coalesce(p.a, 0) * f AS betweenness FROM nodes n
  JOIN scale s ON s.graph_id = n.graph_id AND s.month_start = n.month_start
  LEFT JOIN passed p ON p.graph_id = n.graph_id AND p.month_start = n.month_start AND p.node_id = n.node_id)"""


def exact(sql: str) -> str:
    """``sql`` with paths from all nodes in place of the drawn ones."""
    every = "count(*) OVER (PARTITION BY graph_id, month_start)"
    return sql.replace(_drawn("nodes"), f"drawn AS (SELECT graph_id, month_start, node_id, {every} AS n, {every} AS k FROM nodes)")


@query("g_betweenness", with_edges("SELECT graph_id, month_start, node_id, round(betweenness, 6) AS betweenness FROM between_ness", extra=BETWEEN))
def g_betweenness(spark, sf):
    with graphs(spark, sf) as g:
        return rounded(settle(paths.betweenness(g)))


@query("g_betweenness_hops", with_edges("SELECT graph_id, month_start, node_id, round(betweenness, 6) AS betweenness FROM between_ness",
                                        extra=BETWEEN.replace("h.d + e.weight", "h.d + 1").replace("x.d + e.weight", "x.d + 1")))
def g_betweenness_hops(spark, sf):
    with graphs(spark, sf) as g:
        return rounded(settle(paths.betweenness(g, weighted=False)))


@query("g_louvain")
def g_louvain(spark, sf):
    with graphs(spark, sf) as g:
        return settle(community.louvain(g))


REMOVED = """cut(graph_id, month_start, gone, node_id, label) USING KEY (graph_id, month_start, gone, node_id) AS (
  SELECT t.graph_id, t.month_start, t.gone, n.node_id, n.node_id FROM
    (SELECT graph_id, month_start, node_id AS gone FROM drawn UNION ALL SELECT DISTINCT graph_id, month_start, '' FROM nodes) t
    JOIN nodes n ON n.graph_id = t.graph_id AND n.month_start = t.month_start AND n.node_id <> t.gone
  UNION
  SELECT c.graph_id, c.month_start, c.gone, c.node_id, c.label FROM (
    SELECT h.graph_id, h.month_start, h.gone, l.other AS node_id, min(h.label) AS label FROM cut h
      JOIN linked l ON l.graph_id = h.graph_id AND l.month_start = h.month_start AND l.node_id = h.node_id AND l.other <> h.gone GROUP BY 1, 2, 3, 4) c
    JOIN recurring.cut r ON r.graph_id = c.graph_id AND r.month_start = c.month_start AND r.gone = c.gone AND r.node_id = c.node_id
    WHERE c.label < r.label),
left_over AS (SELECT graph_id, month_start, gone, max(size) AS size FROM
  (SELECT graph_id, month_start, gone, label, count(*) AS size FROM cut GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3),
drops AS (SELECT d.graph_id, d.month_start, d.node_id, 1 - coalesce(c.size, 0) / CAST(w.size AS DOUBLE) AS drop FROM drawn d
  JOIN left_over w ON w.graph_id = d.graph_id AND w.month_start = d.month_start AND w.gone = ''
  LEFT JOIN left_over c ON c.graph_id = d.graph_id AND c.month_start = d.month_start AND c.gone = d.node_id)"""


@query("g_removal_impact", with_edges("""SELECT graph_id, month_start, round(avg(drop), 6) AS avg_node_removal_impact, round(max(drop), 6) AS max_node_removal_impact
  FROM drops GROUP BY 1, 2""", extra=f"{NODES}, {PAIRS}, {_drawn('nodes')}, {REMOVED}"))
def g_removal_impact(spark, sf):
    """Every drawn node is deleted in SQL and the components are searched anew; here one search serves all nodes."""
    with graphs(spark, sf) as g:
        return rounded(settle(blocks.removal_impact(g, sampling.sample_nodes(g.nodes))))


# Distributions ----------------------------------------------------------------------------------------------------

def _histogram_sql(values: str, name: str, log: bool = False, bins: int = 50) -> str:
    """SQL for one histogram over ``values`` (graph_id, month_start, x)."""
    count, x = (bins - 1, "log10(x)") if log else (bins, "CAST(x AS DOUBLE)")
    lo, hi = ("min(x)", "max(x)") if log else ("CASE WHEN min(x) = max(x) THEN min(x) - 0.5::DOUBLE ELSE min(x) END",
                                               "CASE WHEN min(x) = max(x) THEN max(x) + 0.5::DOUBLE ELSE max(x) END")
    edge = (lambda e: f"pow(10.0::DOUBLE, lo + wide * {e})") if log else (lambda e: f"lo + wide * {e}")
    return f"""SELECT f.graph_id, f.month_start, '{name}' AS name, f.bin, round({edge('f.bin')}, 6) AS low, round({edge('(f.bin + 1)')}, 6) AS high, coalesce(c.n, 0) AS count FROM
  (SELECT graph_id, month_start, lo, (hi - lo) / {count} AS wide, CAST(unnest(range({count})) AS INTEGER) AS bin FROM
    (SELECT graph_id, month_start, {lo} AS lo, {hi} AS hi FROM (SELECT graph_id, month_start, {x} AS x FROM {values} {'WHERE x > 0' if log else ''}) GROUP BY 1, 2)) f
  LEFT JOIN (SELECT v.graph_id, v.month_start, CAST(least({count - 1}, greatest(0, CASE WHEN hi > lo THEN floor((v.x - lo) / ((hi - lo) / {count})) ELSE {count - 1} END)) AS INTEGER) AS bin, count(*) AS n
    FROM (SELECT graph_id, month_start, {x} AS x FROM {values} {'WHERE x > 0' if log else ''}) v
    JOIN (SELECT graph_id, month_start, {lo} AS lo, {hi} AS hi FROM (SELECT graph_id, month_start, {x} AS x FROM {values} {'WHERE x > 0' if log else ''}) GROUP BY 1, 2) r
    ON r.graph_id = v.graph_id AND r.month_start = v.month_start GROUP BY 1, 2, 3) c ON c.graph_id = f.graph_id AND c.month_start = f.month_start AND c.bin = f.bin"""


def _degree_values(kind: str) -> str:
    return f"(SELECT graph_id, month_start, {kind}_degree AS x FROM degrees)"


@query("h_linear", with_edges(_histogram_sql(_degree_values("total"), "total_degree_hist"), extra=DEGREES))
def h_linear(spark, sf):
    return rounded(distributions.histogram(local.degrees(arcs_of(spark, sf)), "total_degree", "total_degree_hist"))


@query("h_log", with_edges(_histogram_sql(_degree_values("total"), "total_degree_hist_log", log=True), extra=DEGREES))
def h_log(spark, sf):
    return rounded(distributions.histogram(local.degrees(arcs_of(spark, sf)), "total_degree", "total_degree_hist_log", log=True))


@query("h_degree", with_edges(" UNION ALL ".join(
    _histogram_sql(_degree_values(kind), f"{kind}_degree_hist{'_log' if log else ''}", log)
    for kind in ("in", "out", "total") for log in (False, True)), extra=DEGREES))
def h_degree(spark, sf):
    return rounded(distributions.degree_histograms(settle(local.degrees(arcs_of(spark, sf)))))


WEIGHTS = "(SELECT graph_id, month_start, weight AS x FROM edges)"


@query("h_edge_weight", with_edges(_histogram_sql(WEIGHTS, "edge_weight_hist") + " UNION ALL " + _histogram_sql(WEIGHTS, "edge_weight_hist_log", log=True)))
def h_edge_weight(spark, sf):
    return rounded(distributions.weight_histograms(arcs_of(spark, sf)))


@query("h_clustering", with_edges(_histogram_sql("(SELECT graph_id, month_start, round(clustering_directed, 9) AS x FROM clustered)", "clustering_hist"), extra=TRIANGLES))
def h_clustering(spark, sf):
    values = rounded(clustered(spark, sf).select(*K, "clustering_directed"), 9)
    return rounded(distributions.histogram(settle(values), "clustering_directed", "clustering_hist"))


@query("h_path_length", with_edges(_histogram_sql("(SELECT graph_id, month_start, d AS x FROM best)", "path_length_hist"),
                                   extra=f"{WEAK}, {LARGEST}, {INSIDE}, {_drawn('inside').replace('(0.02 * n)', '(0.02 * basis)').replace('count(*) OVER (PARTITION BY graph_id, month_start) AS n', 'count(*) OVER (PARTITION BY graph_id, month_start) AS n, (SELECT count(*) FROM nodes z WHERE z.graph_id = inside.graph_id AND z.month_start = inside.month_start) AS basis')}, {_keyed('drawn', '1')}"))
def h_path_length(spark, sf):
    with graphs(spark, sf) as g:
        hops = settle(paths.sampled_hops(g, components.weak_components(g), sized_by_graph=True, counted=True))
        return rounded(distributions.histogram(hops, "shortest_path_length", "path_length_hist", count="paths"))


@query("h_structs", with_edges(f"""SELECT graph_id, month_start, name, to_json(list(count ORDER BY bin)) AS counts FROM ({_histogram_sql(WEIGHTS, "edge_weight_hist")}) GROUP BY 1, 2, 3"""))
def h_structs(spark, sf):
    """Histograms as ``{counts, bin_edges}``, written to JSON and read again."""
    path = scratch_path(spark, "histograms")
    writers.write_json(distributions.as_structs(distributions.histogram(arcs_of(spark, sf), "weight", "edge_weight_hist")), path)
    rows = spark.read.schema("graph_id string, month_start date, name string, histogram struct<counts:array<bigint>,bin_edges:array<double>>").json(path)
    return rows.select(*K, "name", F.to_json("histogram.counts").alias("counts"))


# Composite tables -------------------------------------------------------------------------------------------------

NODE_ROWS = ", ".join([FLOW, DEGREES, BETWEEN, TRIANGLES.replace(f"{NODES}, ", ""), CORES.replace(f"{NODES}, {PAIRS},", ""),
                       RANKS.replace(f"{NODES},", "")]) + """,
node_rows AS (SELECT strftime(f.month_start, '%Y-%m') || '_' || f.node_id AS row_id, f.graph_id, f.month_start, f.node_id, p.pagerank,
  CAST(d.weighted_in_degree AS DOUBLE) AS degree_in, CAST(d.weighted_out_degree AS DOUBLE) AS degree_out, b.betweenness, c.clustering, c.triangles,
  k.core_number, f.interactions_sent, f.interactions_received, f.interactions_total, f.toxicity_sent, f.toxicity_received, f.toxicity_sent_avg, f.toxicity_received_avg
  FROM flow f JOIN degrees d USING (graph_id, month_start, node_id) JOIN between_ness b USING (graph_id, month_start, node_id)
  JOIN clustered c USING (graph_id, month_start, node_id) JOIN cores k USING (graph_id, month_start, node_id)
  JOIN pagerank p USING (graph_id, month_start, node_id))"""

NODE_SELECT = """SELECT row_id, graph_id, month_start, node_id, round(pagerank, 6) AS pagerank, degree_in, degree_out, round(betweenness, 6) AS betweenness,
  round(clustering, 6) AS clustering, triangles, core_number, interactions_sent, interactions_received, interactions_total,
  round(toxicity_sent, 6) AS toxicity_sent, round(toxicity_received, 6) AS toxicity_received,
  round(toxicity_sent_avg, 6) AS toxicity_sent_avg, round(toxicity_received_avg, 6) AS toxicity_received_avg"""


@query("m_node_metrics", with_edges(f"{NODE_SELECT} FROM node_rows", extra=exact(NODE_ROWS)))
def m_node_metrics(spark, sf):
    """Betweenness is exact, from all nodes; the tables of politicians and parties and of several sources draw pivots."""
    with graphs(spark, sf) as g:
        return rounded(g.once("exact node table", lambda: tables.node_metrics(g, seed=None)))


@query("m_node_table")
def m_node_table(spark, sf):
    """The declared 17 columns, closeness besides, stored and read again."""
    path = scratch_path(spark, "node-metrics")
    with graphs(spark, sf) as g:
        table = tables.node_metrics(g, with_closeness=True)
        schema = schemas.NODE_METRICS.jsonValue()
        wanted = type(schemas.NODE_METRICS).fromJson(schema).add("graph_id", "string").add("closeness", "double")
        writers.replace_table(table, path, wanted)
    return rounded(spark.read.schema(wanted).parquet(path))


NETWORK = f"""SELECT s.graph_id, s.month_start, s.graph_id AS table_name, strftime(s.month_start, '%Y-%m') || '_' || s.graph_id AS row_id, s.nodes, s.edges,
  round(CASE WHEN s.nodes > 1 THEN CAST(s.edges AS DOUBLE) / (s.nodes * (s.nodes - 1)) ELSE 0 END, 6) AS density, c.connected_components,
  round(t.transitivity, 6) AS transitivity, CASE WHEN a.v THEN round(a.r, 6) + 0.0 END AS assortativity, round(x.network_avg_toxicity, 6) AS network_avg_toxicity,
  round(f.median_node_toxicity, 6) AS median_node_toxicity, round(f.max_node_toxicity, 6) AS max_node_toxicity, round(f.min_node_toxicity, 6) AS min_node_toxicity,
  round(q.modularity, 6) + 0.0 AS modularity, p.modularity_classes, k.max_core_number, round(k.avg_core_number, 6) AS avg_core_number,
  round(r.rich_club_coefficient, 6) AS rich_club_coefficient, round(l.average_clustering, 6) AS average_clustering
  FROM size s LEFT JOIN (SELECT graph_id, month_start, count(DISTINCT scc) AS connected_components FROM strong GROUP BY 1, 2) c {SAME}
  LEFT JOIN transit t {SAME}
  LEFT JOIN (SELECT e.graph_id, e.month_start, stddev_pop(o.out_degree) * stddev_pop(i.in_degree) > 0 AS v, corr(o.out_degree, i.in_degree) AS r FROM edges e
    JOIN degrees o ON o.graph_id = e.graph_id AND o.month_start = e.month_start AND o.node_id = e.source
    JOIN degrees i ON i.graph_id = e.graph_id AND i.month_start = e.month_start AND i.node_id = e.target GROUP BY 1, 2) a {SAME}
  LEFT JOIN (SELECT graph_id, month_start, sum(sum_toxicity) / sum(weight) AS network_avg_toxicity FROM edges GROUP BY 1, 2) x {SAME}
  LEFT JOIN (SELECT graph_id, month_start, median(toxicity_sent_avg) AS median_node_toxicity, max(toxicity_sent_avg) AS max_node_toxicity,
    min(toxicity_sent_avg) AS min_node_toxicity FROM flow GROUP BY 1, 2) f {SAME}
  LEFT JOIN (SELECT graph_id, month_start, sum(inside) / any_value(m) - sum(ends * ends) / (4 * any_value(m) * any_value(m)) AS modularity
    FROM part_sum JOIN part_total {SAME} GROUP BY 1, 2) q {SAME}
  LEFT JOIN (SELECT graph_id, month_start, count(DISTINCT community) AS modularity_classes FROM parted GROUP BY 1, 2) p {SAME}
  LEFT JOIN (SELECT graph_id, month_start, max(core_number) AS max_core_number, avg(core_number) AS avg_core_number FROM cores GROUP BY 1, 2) k {SAME}
  LEFT JOIN rich r {SAME}
  LEFT JOIN (SELECT graph_id, month_start, avg(clustering) AS average_clustering FROM clustered GROUP BY 1, 2) l {SAME}"""


def _once(*blocks: str) -> str:
    """Join CTE lists, leaving out the shared ones that a later list repeats."""
    text = ", ".join(blocks)
    for shared in (NODES, PAIRS):
        first = text.find(shared)
        if first >= 0:
            head, tail = text[:first + len(shared)], text[first + len(shared):]
            text = head + tail.replace(f"{shared}, ", "").replace(f"{shared},", "")
    return text


@query("m_network_metrics", with_edges(NETWORK, extra=_once(
    SIZES, STRONG, TRANSITIVITY, DEGREES, FLOW, CORES, RICH.replace("neighbour", "rich_neighbour"), TRIANGLES, SCORED)))
def m_network_metrics(spark, sf):
    """All columns, under a partition that SQL can state; ``m_network_table`` has those of Louvain's."""
    with graphs(spark, sf) as g:
        return rounded(settle(tables.network_metrics(g, partition=lettered(g.nodes))))


@query("m_network_table")
def m_network_table(spark, sf):
    path = scratch_path(spark, "network-metrics")
    with graphs(spark, sf) as g:
        writers.replace_table(tables.network_metrics(g), path, schemas.NETWORK_METRICS)
    return rounded(spark.read.schema(schemas.NETWORK_METRICS).parquet(path))


@query("m_all_networks", with_edges(f"SELECT graph_id || '_network' AS graph_id, month_start, nodes, edges FROM size", extra=SIZES))
def m_all_networks(spark, sf):
    edges = fixtures.edges(spark, sf)
    named = {f"{name}_network": edges.where(F.col("graph_id") == name) for name in ("supplier", "part")}
    return local.sizes(build.simple_arcs(tables.all_networks(named)))


def _sources(spark: SparkSession, sf: str) -> GraphSet:
    """Two sources, each a table of its own, as graphs of one set."""
    edges = fixtures.edges(spark, sf)
    return GraphSet(tables.all_networks({f"{name}_network": edges.where(F.col("graph_id") == name) for name in ("supplier", "part")}))


@query("m_all_node_tables", with_edges(f"SELECT * REPLACE (graph_id || '_network' AS graph_id) FROM ({NODE_SELECT} FROM node_rows)", extra=NODE_ROWS))
def m_all_node_tables(spark, sf):
    path = scratch_path(spark, "all-nodes")
    with _sources(spark, sf) as g:
        tables.store_node_metrics(g, path)
    return rounded(spark.read.schema(schemas.of_sources(schemas.NODE_METRICS)).parquet(path))


@query("m_all_network_tables", with_edges(f"""SELECT * EXCLUDE (max_node_toxicity, min_node_toxicity)
  REPLACE (graph_id || '_network' AS graph_id, table_name || '_network' AS table_name, row_id || '_network' AS row_id) FROM ({NETWORK})""", extra=_once(
    SIZES, STRONG, TRANSITIVITY, DEGREES, FLOW, CORES, RICH.replace("neighbour", "rich_neighbour"), TRIANGLES, SCORED)))
def m_all_network_tables(spark, sf):
    """Stored and read again, under a partition that SQL can state."""
    path = scratch_path(spark, "all-networks")
    with _sources(spark, sf) as g:
        tables.store_network_metrics(g, path, lettered(g.nodes))
    return rounded(spark.read.schema(schemas.of_sources(schemas.NETWORK_METRICS)).parquet(path))


POLITICIAN_ROWS = f"""{NODE_ROWS}, {POLITICIANS},
chosen AS (SELECT r.*, official_name, party, 'politician' AS category FROM node_rows r JOIN politicians ON node_id = twitter_handle
  UNION ALL SELECT * EXCLUDE (place), NULL, NULL, 'top_pagerank' FROM
    (SELECT *, row_number() OVER (PARTITION BY graph_id, month_start ORDER BY pagerank DESC, node_id) AS place FROM node_rows
     WHERE node_id NOT IN (SELECT twitter_handle FROM politicians)) WHERE place <= 1000)"""


@query("m_politician_metrics", with_edges("""SELECT graph_id, month_start, node_id AS twitter_handle, official_name, party, category, round(pagerank, 6) AS pagerank,
  degree_in AS in_degree, degree_out AS out_degree, round(betweenness, 6) AS betweenness, round(clustering, 6) AS clustering_coefficient,
  round(toxicity_sent, 6) AS sent_toxicity, round(toxicity_received, 6) AS received_toxicity, round(toxicity_sent_avg, 6) AS avg_sent_toxicity,
  round(toxicity_received_avg, 6) AS avg_received_toxicity, interactions_total AS total_interactions FROM chosen""", extra=POLITICIAN_ROWS))
def m_politician_metrics(spark, sf):
    with graphs(spark, sf) as g:
        return rounded(tables.politician_metrics(node_table(g), fixtures.politicians(spark, sf)))


@query("m_party_metrics", with_edges("""SELECT graph_id, month_start, party, round(avg(pagerank), 6) AS pagerank_mean, round(stddev_samp(pagerank), 6) AS pagerank_std, round(avg(degree_in), 6) AS in_degree_mean, round(stddev_samp(degree_in), 6) AS in_degree_std, round(avg(degree_out), 6) AS out_degree_mean, round(stddev_samp(degree_out), 6) AS out_degree_std, round(avg(betweenness), 6) AS betweenness_mean, round(stddev_samp(betweenness), 6) AS betweenness_std, round(avg(clustering), 6) AS clustering_coefficient_mean, round(stddev_samp(clustering), 6) AS clustering_coefficient_std,
  round(sum(toxicity_sent), 6) AS sent_toxicity_sum, round(sum(toxicity_received), 6) AS received_toxicity_sum, CAST(sum(interactions_total) AS BIGINT) AS total_interactions_sum
  FROM chosen WHERE category = 'politician' GROUP BY 1, 2, 3""", extra=POLITICIAN_ROWS))
def m_party_metrics(spark, sf):
    with graphs(spark, sf) as g:
        rows = tables.politician_metrics(node_table(g), fixtures.politicians(spark, sf))
        return rounded(tables.party_rollup(rows))


@query("m_time_summary")
def m_time_summary(spark, sf):
    with graphs(spark, sf) as g:
        return rounded(settle(tables.time_summary(g)))


@query("m_weekly_graph")
def m_weekly_graph(spark, sf):
    """Weekly edges by way of one ``Source, Target, Weight, Week`` CSV per graph."""
    weekly, edges = settle(fixtures.derive_edges(spark, sf, "week")), []
    for graph in ("supplier", "part"):
        path = scratch_path(spark, "weekly-csv")
        writers.write_csv(weekly.where(F.col("graph_id") == graph).select(
            F.col("source").alias("Source"), F.col("target").alias("Target"), F.col("weight").alias("Weight"),
            F.col("month_start").cast("string").alias("Week")), path)
        edges.append(tables.weekly_edges(readers.read_csv(spark, path, schemas.WEEKLY_EDGES), graph))
    with GraphSet(edges[0].unionByName(edges[1])) as g:
        return rounded(settle(tables.period_metrics(g)))


@query("m_party_toxicity", with_edges("""SELECT graph_id, month_start, CASE node_id WHEN '1' THEN 'CDU' WHEN '2' THEN 'SPD' WHEN '3' THEN 'CSU' WHEN '4' THEN 'FDP' ELSE 'Die Grünen' END AS party,
  round(toxicity_sent_avg, 6) AS toxicity_sent_avg, round(toxicity_received_avg, 6) AS toxicity_received_avg,
  (SELECT round(greatest(max(toxicity_sent_avg), max(toxicity_received_avg)) * 1.05, 6) FROM chosen) AS axis_max FROM chosen""",
    extra=f"""{FLOW}, chosen AS (SELECT * FROM flow WHERE node_id IN ('1', '2', '3', '4', '5') AND month_start >= DATE '1997-01-01' AND month_start < DATE '1998-01-01')"""))
def m_party_toxicity(spark, sf):
    from .tabular import ACCOUNTS
    # Only arcs that touch the accounts in that year are read.
    chosen = [*ACCOUNTS]
    day = F.col("month_start")
    near = arcs_of(spark, sf).where((day >= F.lit("1997-01-01").cast("date")) & (day < F.lit("1998-01-01").cast("date"))
                                    & (F.col("source").isin(chosen) | F.col("target").isin(chosen)))
    return rounded(tables.party_toxicity(settle(local.node_flow(near).where(F.col("node_id").isin(chosen))), ACCOUNTS, "1997-01-01", "1998-01-01"))


@query("m_centrality_table", with_edges("""SELECT graph_id, month_start, node_id, round(pagerank, 6) AS pagerank, round(betweenness, 6) AS betweenness
  FROM pagerank JOIN between_ness USING (graph_id, month_start, node_id)""",
    extra=exact(RANKS + ", " + BETWEEN.replace(f"{NODES}, ", "").replace("h.d + e.weight", "h.d + 1").replace("x.d + e.weight", "x.d + 1"))))
def m_centrality_table(spark, sf):
    with graphs(spark, sf) as g:
        return rounded(settle(tables.centrality_table(g, seed=None)))


@query("j_top_nonpoliticians", with_edges("""SELECT graph_id, month_start, node_id, pagerank, 'top_pagerank' AS category FROM
  (SELECT graph_id, month_start, node_id, round(pagerank, 9) AS pagerank,
     row_number() OVER (PARTITION BY graph_id, month_start ORDER BY round(pagerank, 9) DESC, node_id) AS place
   FROM pagerank WHERE node_id NOT IN (SELECT twitter_handle FROM politicians)) WHERE place <= 1000""", extra=f"{RANKS}, {POLITICIANS}"))
def j_top_nonpoliticians(spark, sf):
    return tables.top_others(rounded(ranks(spark, sf), 9), fixtures.politicians(spark, sf)).select(*N, "pagerank", "category")


@query("s_nodes_of_interest", with_edges("""SELECT graph_id, month_start, node_id FROM nodes JOIN politicians ON node_id = twitter_handle
  UNION SELECT graph_id, month_start, node_id FROM (SELECT *, row_number() OVER (PARTITION BY graph_id, month_start ORDER BY round(pagerank, 9) DESC, node_id) AS place
    FROM pagerank) WHERE place <= 1000""", extra=f"{RANKS}, {POLITICIANS}"))
def s_nodes_of_interest(spark, sf):
    nodes = rounded(ranks(spark, sf), 9)
    top = top_rows(nodes, K, [F.desc("pagerank"), F.col("node_id")], 1000).select(*N)
    return tables.politician_nodes(nodes, fixtures.politicians(spark, sf)).select(*N).union(top).distinct()
