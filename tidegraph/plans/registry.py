"""Named queries over the given tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(run: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return run
    return add


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles to ``places`` digits, since sums depend on their order."""
    return df.select(*[F.round(F.col(f.name), places).alias(f.name) if f.dataType.simpleString() == "double" else F.col(f.name)
                       for f in df.schema])


def with_edges(body: str, grain: str = "month", extra: str = "") -> str:
    """SQL over the CTE ``edges``; ``extra`` holds further CTEs."""
    more = f", {extra}" if extra else ""
    return f"""WITH RECURSIVE steps AS (
  SELECT CAST(date_trunc('{grain}', o_orderdate) AS DATE) AS month_start, l_suppkey, l_partkey, l_discount AS tox,
         lead(l_suppkey) OVER w AS next_supp, lead(l_partkey) OVER w AS next_part
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_discount, l_tax, l_shipdate)),
both_ends AS (
  SELECT 'supplier' AS graph_id, month_start, CAST(l_suppkey AS VARCHAR) AS source, CAST(next_supp AS VARCHAR) AS target, tox FROM steps WHERE next_supp IS NOT NULL
  UNION ALL
  SELECT 'part', month_start, CAST(l_partkey AS VARCHAR), CAST(next_part AS VARCHAR), tox FROM steps WHERE next_part IS NOT NULL),
edges AS (
  SELECT graph_id, month_start, source, target, count(*) AS weight, round(sum(tox), 6) AS sum_toxicity, round(avg(tox), 6) AS avg_toxicity
  FROM both_ends GROUP BY graph_id, month_start, source, target){more}
{body}"""


TWEETS = """tweets AS (
  SELECT CAST(doc_id AS VARCHAR) AS tweet_id, CAST(doc_id % 97 AS VARCHAR) AS user_id,
         TIMESTAMP '2021-01-01' + to_hours(CAST(doc_id * 7 AS INTEGER)) AS recorded_at, text FROM documents)"""

POLITICIANS = """politicians AS (
  SELECT CAST(s_suppkey AS VARCHAR) AS twitter_handle, s_name AS official_name, n_name AS party
  FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 4 = 0)"""

HASHTAGS = """tagged AS (
  SELECT 'k' || (props->>'k') AS hashtag, user_id AS usr FROM events
  UNION ALL SELECT lower(n_name), c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT lower(c_mktsegment), c_custkey FROM customer),
hashtags AS (SELECT hashtag, count(DISTINCT usr) AS politician_users FROM tagged WHERE hashtag IS NOT NULL GROUP BY hashtag)"""

FLOW = """ends AS (
  SELECT graph_id, month_start, source AS node_id, weight AS w_out, 0 AS w_in, CAST(sum_toxicity AS DECIMAL(38,12)) AS t_out, CAST(0 AS DECIMAL(38,12)) AS t_in FROM edges
  UNION ALL SELECT graph_id, month_start, target, 0, weight, CAST(0 AS DECIMAL(38,12)), CAST(sum_toxicity AS DECIMAL(38,12)) FROM edges),
flow AS (
  SELECT graph_id, month_start, node_id, CAST(sum(w_out) AS BIGINT) AS interactions_sent, CAST(sum(w_in) AS BIGINT) AS interactions_received,
         CAST(sum(w_out) + sum(w_in) AS BIGINT) AS interactions_total, CAST(sum(t_out) AS DOUBLE) AS toxicity_sent, CAST(sum(t_in) AS DOUBLE) AS toxicity_received,
         CASE WHEN sum(w_out) > 0 THEN CAST(sum(t_out) AS DOUBLE) / sum(w_out) ELSE 0 END AS toxicity_sent_avg,
         CASE WHEN sum(w_in) > 0 THEN CAST(sum(t_in) AS DOUBLE) / sum(w_in) ELSE 0 END AS toxicity_received_avg
  FROM ends GROUP BY graph_id, month_start, node_id)"""

DEGREES = """degree_ends AS (
  SELECT graph_id, month_start, source AS node_id, 1 AS n_out, 0 AS n_in, weight AS w_out, 0 AS w_in FROM edges
  UNION ALL SELECT graph_id, month_start, target, 0, 1, 0, weight FROM edges),
degrees AS (
  SELECT graph_id, month_start, node_id, CAST(sum(n_in) AS BIGINT) AS in_degree, CAST(sum(n_out) AS BIGINT) AS out_degree,
         count(*) AS total_degree, CAST(sum(w_in) AS BIGINT) AS weighted_in_degree, CAST(sum(w_out) AS BIGINT) AS weighted_out_degree
  FROM degree_ends GROUP BY graph_id, month_start, node_id)"""

NODES = """nodes AS (SELECT graph_id, month_start, source AS node_id FROM edges UNION SELECT graph_id, month_start, target FROM edges)"""

SIZES = f"""{NODES},
size AS (
  SELECT n.graph_id, n.month_start, n.nodes, e.edges FROM
    (SELECT graph_id, month_start, count(*) AS nodes FROM nodes GROUP BY 1, 2) n
    JOIN (SELECT graph_id, month_start, count(*) AS edges FROM edges GROUP BY 1, 2) e USING (graph_id, month_start))"""

PAIRS = """pairs AS (
  SELECT graph_id, month_start, least(source, target) AS a, greatest(source, target) AS b, max(weight) AS weight, count(*) AS ways
  FROM edges WHERE source <> target GROUP BY 1, 2, 3, 4),
linked AS (SELECT graph_id, month_start, a AS node_id, b AS other, ways FROM pairs
  UNION ALL SELECT graph_id, month_start, b, a, ways FROM pairs)"""

WEAK = f"""{NODES}, {PAIRS},
spread(graph_id, month_start, node_id, label) AS (
  SELECT graph_id, month_start, node_id, node_id FROM nodes
  UNION SELECT s.graph_id, s.month_start, b.other, s.label FROM spread s
    JOIN linked b ON b.graph_id = s.graph_id AND b.month_start = s.month_start AND b.node_id = s.node_id),
weak AS (SELECT graph_id, month_start, node_id, min(label) AS component FROM spread GROUP BY 1, 2, 3)"""

STRONG = f"""{NODES},
reach(graph_id, month_start, a, b) AS (
  SELECT graph_id, month_start, node_id, node_id FROM nodes
  UNION SELECT r.graph_id, r.month_start, r.a, e.target FROM reach r
    JOIN edges e ON e.graph_id = r.graph_id AND e.month_start = r.month_start AND e.source = r.b),
strong AS (
  SELECT f.graph_id, f.month_start, f.a AS node_id, min(f.b) AS scc FROM reach f
    JOIN reach r ON r.graph_id = f.graph_id AND r.month_start = f.month_start AND r.a = f.b AND r.b = f.a GROUP BY 1, 2, 3)"""
