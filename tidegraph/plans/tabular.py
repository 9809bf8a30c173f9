"""Queries on sources, sinks, projections, joins, aggregations, sorting and text."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import schemas
from ..functions import lexicon, scalars, taxonomy
from ..functions.skew import top_rows
from ..operators import build, evaluation, hashtags as tags, local, scoring, tables
from ..operators.build import K
from ..session import scratch_path, settle
from ..sources import readers, writers
from ..streaming import incremental
from . import fixtures
from .registry import FLOW, HASHTAGS, NODES, POLITICIANS, TWEETS, query, rounded, with_edges

ALL_EDGES = with_edges("SELECT * FROM edges")


# Sources and sinks ------------------------------------------------------------------------------------------------

@query("scan_edges", ALL_EDGES)
def scan_edges(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "scan-edges")
    writers.replace_table(fixtures.edges(spark, sf), path, schemas.EDGES)
    return readers.read_edges(spark, path)


@query("scan_months", with_edges("SELECT DISTINCT month_start FROM edges"))
def scan_months(spark, sf):
    return readers.months(fixtures.edges(spark, sf))


@query("scan_tweets", f"WITH {TWEETS} SELECT * FROM tweets")
def scan_tweets(spark, sf):
    path = scratch_path(spark, "tweets")
    fixtures.tweets(spark, sf).write.parquet(path)
    return readers.read_tweets(spark, path)


@query("run_sql", with_edges("SELECT graph_id, month_start, sum(weight)::BIGINT AS interactions FROM edges GROUP BY 1, 2"))
def run_sql(spark, sf):
    fixtures.edges(spark, sf).createOrReplaceTempView("network_edges")
    return readers.run_sql(
        spark, "SELECT graph_id, month_start, sum(weight) AS interactions FROM network_edges GROUP BY ALL")


HASHTAG_ROWS = f"WITH {HASHTAGS} SELECT * FROM hashtags"


@query("scan_csv", HASHTAG_ROWS)
def scan_csv(spark, sf):
    path = scratch_path(spark, "csv")
    writers.write_csv(fixtures.hashtags(spark, sf), path)
    return readers.read_csv(spark, path, schemas.HASHTAGS)


def evaluation_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled documents; the quality label stands for the sentiment."""
    labels = fixtures.table(spark, sf, "labels")
    return fixtures.table(spark, sf, "documents").join(labels, "doc_id").select(
        "text", F.when(F.col("quality") == 1, "neutral").otherwise("negative").alias("sentiment"),
        F.when(F.col("toxic") == 1, "toxic").otherwise("non-toxic").alias("toxicity_label"))


EVALUATION = """evaluation AS (
  SELECT text, CASE WHEN quality = 1 THEN 'neutral' ELSE 'negative' END AS sentiment,
         CASE WHEN toxic = 1 THEN 'toxic' ELSE 'non-toxic' END AS toxicity_label
  FROM documents JOIN labels USING (doc_id))"""


@query("scan_json_array", f"WITH {EVALUATION} SELECT * FROM evaluation")
def scan_json_array(spark, sf):
    path, rows = scratch_path(spark, "json-array"), evaluation_rows(spark, sf)
    files = max(1, rows.count() // 500)
    part = F.pmod(F.xxhash64("text", F.monotonically_increasing_id()), F.lit(files)).alias("part")
    (rows.select(part, F.struct(*rows.columns).alias("row")).groupBy("part")
     .agg(F.to_json(F.collect_list("row")).alias("value")).write.partitionBy("part").text(path))
    return readers.read_json_array(spark, path, schemas.EVALUATION).select(*rows.columns)


@query("sink_replace", ALL_EDGES)
def sink_replace(spark, sf):
    path, edges = scratch_path(spark, "replace"), fixtures.edges(spark, sf)
    writers.replace_table(edges.withColumn("weight", F.col("weight") + 1), path, schemas.EDGES)
    writers.replace_table(edges, path, schemas.EDGES)
    return readers.read_edges(spark, path)


@query("sink_append", ALL_EDGES)
def sink_append(spark, sf):
    path, edges = scratch_path(spark, "append"), fixtures.edges(spark, sf)
    for graph in ("supplier", "part"):
        writers.append_table(edges.where(F.col("graph_id") == graph), path, schemas.EDGES)
    return readers.read_edges(spark, path)


@query("sink_truncate", with_edges("""SELECT graph_id, month_start, source, target,
  CASE WHEN month_start >= DATE '1998-01-01' THEN weight * 10 ELSE weight END AS weight, sum_toxicity, avg_toxicity FROM edges"""))
def sink_truncate(spark, sf):
    path, edges = scratch_path(spark, "refresh"), fixtures.edges(spark, sf)
    writers.replace_table(edges, path, schemas.EDGES)
    late = edges.where(F.col("month_start") >= F.lit(dt.date(1998, 1, 1)))
    writers.refresh_months(late.withColumn("weight", F.col("weight") * 10), path, schemas.EDGES)
    return readers.read_edges(spark, path)


@query("sink_csv", ALL_EDGES)
def sink_csv(spark, sf):
    path = scratch_path(spark, "edges-csv")
    writers.write_csv(fixtures.edges(spark, sf), path)
    return readers.read_csv(spark, path, schemas.EDGES)


@query("sink_csv_quoted", f"""WITH {HASHTAGS} SELECT '"' || hashtag || '"' AS hashtag,
  '"' || CAST(politician_users AS VARCHAR) || '"' AS politician_users FROM hashtags""")
def sink_csv_quoted(spark, sf):
    path = scratch_path(spark, "quoted")
    writers.write_csv(fixtures.hashtags(spark, sf), path, quote_all=True)
    return spark.read.schema("hashtag string, politician_users string").csv(path, header=True, quote="")


@query("sink_json", with_edges("""SELECT graph_id, month_start, CAST(sum(weight) AS BIGINT) AS total_interactions,
  round(sum(sum_toxicity), 6) AS total_toxicity, round(sum(sum_toxicity) / sum(weight), 6) AS network_avg_toxicity FROM edges GROUP BY 1, 2"""))
def sink_json(spark, sf):
    path, totals = scratch_path(spark, "json"), local.network_toxicity(fixtures.edges(spark, sf))
    writers.write_json(totals, path)
    return rounded(spark.read.schema(totals.schema).json(path))


# Projections and filters ------------------------------------------------------------------------------------------

@query("f_nonblank", r"""WITH pieces AS (SELECT doc_id, unnest(regexp_split_to_array(text, '[.\n]')) AS text FROM documents)
SELECT doc_id, count(*) AS pieces FROM pieces
WHERE regexp_matches(text, '[^\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]') GROUP BY doc_id""")
def f_nonblank(spark, sf):
    pieces = fixtures.table(spark, sf, "documents").select("doc_id", F.explode(F.split("text", r"[.\n]")).alias("text"))
    return pieces.where(scalars.not_blank(F.col("text"))).groupBy("doc_id").agg(F.count(F.lit(1)).alias("pieces"))


@query("f_month_eq", with_edges("SELECT * FROM edges WHERE month_start = DATE '1996-03-01'"))
def f_month_eq(spark, sf):
    path = scratch_path(spark, "month-edges")
    writers.replace_table(fixtures.edges(spark, sf), path, schemas.EDGES)
    return readers.read_edges(spark, path, dt.date(1996, 3, 1))


# Suppliers 1 to 5 stand for the five party accounts, 1997 for the year shown.
ACCOUNTS = {"1": "CDU", "2": "SPD", "3": "CSU", "4": "FDP", "5": "Die Grünen"}
PARTY_ROWS = """chosen AS (SELECT graph_id, month_start, node_id, toxicity_sent_avg, toxicity_received_avg FROM flow
  WHERE node_id IN ('1', '2', '3', '4', '5') AND month_start >= DATE '1997-01-01' AND month_start < DATE '1998-01-01')"""
PARTY_CASE = """CASE node_id WHEN '1' THEN 'CDU' WHEN '2' THEN 'SPD' WHEN '3' THEN 'CSU' WHEN '4' THEN 'FDP' WHEN '5' THEN 'Die Grünen' ELSE node_id END"""


@query("f_party_2021", with_edges("""SELECT graph_id, CAST(month_start AS VARCHAR) AS month_start_str, node_id,
  round(toxicity_sent_avg, 6) AS toxicity_sent_avg, round(toxicity_received_avg, 6) AS toxicity_received_avg FROM chosen""", extra=f"{FLOW}, {PARTY_ROWS}"))
def f_party_2021(spark, sf):
    flow = local.node_flow(fixtures.edges(spark, sf))
    return rounded(tables.party_accounts(flow, list(ACCOUNTS), "1997-01-01", "1998-01-01"))


@query("p_party_name", with_edges(f"SELECT graph_id, month_start, node_id, {PARTY_CASE} AS party FROM nodes", extra=NODES))
def p_party_name(spark, sf):
    nodes = build.node_set(fixtures.edges(spark, sf))
    return nodes.withColumn("party", scalars.display_name(F.col("node_id"), ACCOUNTS))


@query("p_month_parse", f"""WITH {TWEETS} SELECT tweet_id, CAST(recorded_at AS DATE) AS day, strftime(recorded_at, '%Y-%m') AS month,
  strftime(recorded_at, '%Y-%m-%dT%H:%M:%S') AS iso, strftime(recorded_at, '%Y-%m-%d %H:%M:%S') AS parsed FROM tweets""")
def p_month_parse(spark, sf):
    at = F.col("recorded_at")
    text = F.date_format(at, "yyyy-MM-dd HH:mm:ss")
    return fixtures.tweets(spark, sf).select(
        "tweet_id", F.to_date(at).alias("day"), scalars.month_label(at).alias("month"),
        F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss").alias("iso"),
        F.date_format(F.to_timestamp(text), "yyyy-MM-dd HH:mm:ss").alias("parsed"))


@query("p_row_id", with_edges("SELECT graph_id, strftime(month_start, '%Y-%m') || '_' || node_id AS row_id FROM nodes", extra=NODES))
def p_row_id(spark, sf):
    return build.node_set(fixtures.edges(spark, sf)).select("graph_id", scalars.row_id(F.col("month_start"), F.col("node_id")).alias("row_id"))


@query("p_safe_ratio", with_edges("""SELECT graph_id, month_start, node_id,
  round(CASE WHEN interactions_received > 0 THEN CAST(interactions_sent AS DOUBLE) / interactions_received ELSE 0 END, 6) AS ratio FROM flow""", extra=FLOW))
def p_safe_ratio(spark, sf):
    flow = local.node_flow(fixtures.edges(spark, sf))
    ratio = scalars.safe_ratio(F.col("interactions_sent"), F.col("interactions_received"))
    return rounded(flow.select(*K, "node_id", ratio.alias("ratio")))


def _count_sql(words: tuple[str, ...]) -> str:
    return f"len(list_filter(words, lambda x: x IN ({', '.join(repr(w) for w in words)})))"


SCORES = rf"""{TWEETS},
counted AS (SELECT tweet_id, user_id, recorded_at, text, {_count_sql(lexicon.POSITIVE)} AS p, {_count_sql(lexicon.NEGATIVE)} AS n,
  {_count_sql(lexicon.TOXIC)} AS t FROM (SELECT *, regexp_split_to_array(lower(text), '[^\p{{L}}]+') AS words FROM tweets)),
labelled AS (SELECT *, CASE WHEN p > n THEN 'positive' WHEN n > p THEN 'negative' ELSE 'neutral' END AS sentiment,
  CASE WHEN p = n THEN 0.5 + 0.5 / (p + n + 1) ELSE 0.5 + 0.5 * abs(p - n) / (p + n + 1) END AS score FROM counted),
scored AS (SELECT tweet_id, user_id, recorded_at, text, sentiment,
  CAST(CASE WHEN sentiment = 'positive' THEN score ELSE 1 - score END AS DOUBLE) AS positive_probability,
  CAST(CASE WHEN sentiment = 'neutral' THEN score ELSE 1 - score END AS DOUBLE) AS neutral_probability,
  CAST(CASE WHEN sentiment = 'negative' THEN score ELSE 1 - score END AS DOUBLE) AS negative_probability,
  CASE WHEN t > 0 THEN 'toxic' ELSE 'non-toxic' END AS toxicity_label,
  CAST(CASE WHEN t > 0 THEN 1 - 0.5 / (t + 1) ELSE 1.0 END AS DOUBLE) AS toxicity_score FROM labelled)"""
SCORED_ROWS = f"""WITH {SCORES} SELECT tweet_id, user_id, recorded_at, text, sentiment, round(positive_probability, 6) AS positive_probability,
  round(neutral_probability, 6) AS neutral_probability, round(negative_probability, 6) AS negative_probability,
  toxicity_label, round(toxicity_score, 6) AS toxicity_score FROM scored"""


@query("p_probabilities", f"""WITH {SCORES} SELECT tweet_id, round(positive_probability, 6) AS positive_probability,
  round(neutral_probability, 6) AS neutral_probability, round(negative_probability, 6) AS negative_probability FROM scored""")
def p_probabilities(spark, sf):
    scored = scoring.score_by_lexicon(fixtures.tweets(spark, sf))
    return rounded(scored.select("tweet_id", *[f"{name}_probability" for name in lexicon.SENTIMENT_LABELS]))


KEYWORD_ROWS = ", ".join(f"('{word}', '{category}', {taxonomy.CATEGORIES.index(category)})" for word, category in taxonomy.KEYWORDS)
CLASSIFIED = f"""{HASHTAGS}, keywords(word, category, place) AS (VALUES {KEYWORD_ROWS}),
matched AS (SELECT DISTINCT hashtag, category, place FROM hashtags JOIN keywords ON contains(hashtag, word)),
classified AS (SELECT h.hashtag, coalesce(string_agg(category, ';' ORDER BY place), '{taxonomy.UNCATEGORIZED}') AS categories,
  CASE WHEN count(category) > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS confidence FROM hashtags h LEFT JOIN matched m ON m.hashtag = h.hashtag GROUP BY h.hashtag)"""


@query("p_categories_join", f"WITH {CLASSIFIED} SELECT hashtag, categories FROM classified")
def p_categories_join(spark, sf):
    classified = tags.classify(fixtures.hashtags(spark, sf))
    return classified.select("hashtag", tags.joined_categories(F.col("categories")).alias("categories"))


@query("p_json_default", """SELECT event_id, CASE WHEN event_type = 'error' THEN 'Other' WHEN event_type = 'signup' THEN 'Other' ELSE 'Weather;' || event_type END AS categories,
  CASE WHEN event_type IN ('error', 'view') THEN 0.0::DOUBLE ELSE round(value, 6) END AS confidence FROM events""")
def p_json_default(spark, sf):
    kind, value = F.col("event_type"), F.round("value", 6)
    reply = (F.when(kind == "error", F.lit('{"categories": ["Weather", '))
             .when(kind == "signup", F.to_json(F.struct(value.alias("confidence"))))
             .when(kind == "view", F.to_json(F.struct(F.array(F.lit("Weather"), kind).alias("categories"))))
             .otherwise(F.to_json(F.struct(F.array(F.lit("Weather"), kind).alias("categories"), value.alias("confidence")))))
    replies = fixtures.table(spark, sf, "events").select("event_id", reply.alias("reply"))
    return tags.parse_reply(replies).select("event_id", tags.joined_categories(F.col("categories")).alias("categories"), "confidence")


@query("p_edge_table", with_edges("SELECT graph_id, month_start, source, target, weight, coalesce(avg_toxicity, 0) AS toxicity FROM edges"))
def p_edge_table(spark, sf):
    return tables.edge_table(fixtures.edges(spark, sf))


# Joins ------------------------------------------------------------------------------------------------------------

@query("j_hashtag_left", f"WITH {CLASSIFIED} SELECT hashtag, politician_users, categories, confidence FROM hashtags JOIN classified USING (hashtag)")
def j_hashtag_left(spark, sf):
    hashtags = settle(fixtures.hashtags(spark, sf))
    return tags.attach(hashtags, tags.classify(hashtags))


UNSCORED = f"{TWEETS}, done AS (SELECT CAST(doc_id AS VARCHAR) AS tweet_id FROM labels)"


@query("j_unscored_anti", f"WITH {UNSCORED} SELECT * FROM tweets WHERE tweet_id NOT IN (SELECT tweet_id FROM done)")
def j_unscored_anti(spark, sf):
    done = fixtures.table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("tweet_id"))
    tweets = fixtures.tweets(spark, sf)
    return scoring.unscored(tweets, done).select(*tweets.columns)


@query("j_politician_nodes", with_edges("""SELECT graph_id, month_start, node_id, official_name, party, 'politician' AS category
  FROM nodes JOIN politicians ON node_id = twitter_handle""", extra=f"{NODES}, {POLITICIANS}"))
def j_politician_nodes(spark, sf):
    nodes = build.node_set(fixtures.edges(spark, sf))
    return tables.politician_nodes(nodes, fixtures.politicians(spark, sf)).select(*K, "node_id", "official_name", "party", "category")


@query("j_endpoint_labels", with_edges("SELECT graph_id, month_start, source, target, length(source) AS source_digits, length(target) AS target_digits FROM edges"))
def j_endpoint_labels(spark, sf):
    edges = fixtures.edges(spark, sf)
    labels = build.node_set(edges).withColumn("digits", F.length("node_id"))
    return local.label_ends(edges.select(*K, "source", "target"), labels, "digits")


# Aggregations -----------------------------------------------------------------------------------------------------

@query("a_weekly_toxicity", f"""WITH {SCORES} SELECT CAST(date_trunc('week', recorded_at) AS TIMESTAMP) AS week_start, count(tweet_id) AS total_tweets,
  round(avg(toxicity_score), 6) AS avg_toxicity_score FROM scored GROUP BY 1""")
def a_weekly_toxicity(spark, sf):
    return rounded(scoring.weekly_toxicity(scoring.score_by_lexicon(fixtures.tweets(spark, sf))))


@query("a_network_toxicity", with_edges("""SELECT graph_id, month_start, CAST(sum(weight) AS BIGINT) AS total_interactions,
  round(sum(sum_toxicity), 6) AS total_toxicity, round(sum(sum_toxicity) / sum(weight), 6) AS network_avg_toxicity FROM edges GROUP BY 1, 2"""))
def a_network_toxicity(spark, sf):
    return rounded(local.network_toxicity(fixtures.edges(spark, sf)))


@query("a_node_flow", with_edges("""SELECT strftime(month_start, '%Y-%m') || '_' || node_id AS row_id, graph_id, month_start, node_id, interactions_sent, interactions_received, interactions_total,
  round(toxicity_sent, 6) AS toxicity_sent, round(toxicity_received, 6) AS toxicity_received,
  round(toxicity_sent_avg, 6) AS toxicity_sent_avg, round(toxicity_received_avg, 6) AS toxicity_received_avg FROM flow""", extra=FLOW))
def a_node_flow(spark, sf):
    flow = local.node_flow(build.simple_arcs(fixtures.edges(spark, sf)))
    return rounded(flow.withColumn("row_id", scalars.row_id(F.col("month_start"), F.col("node_id"))))


@query("a_node_toxicity_stats", with_edges("""SELECT graph_id, month_start, round(median(toxicity_sent_avg), 6) AS median_node_toxicity,
  round(max(toxicity_sent_avg), 6) AS max_node_toxicity, round(min(toxicity_sent_avg), 6) AS min_node_toxicity FROM flow GROUP BY 1, 2""", extra=FLOW))
def a_node_toxicity_stats(spark, sf):
    return rounded(local.node_toxicity_stats(local.node_flow(fixtures.edges(spark, sf))))


@query("a_party_rollup", with_edges("""SELECT graph_id, month_start, party, round(avg(interactions_received), 6) AS in_degree_mean, round(stddev_samp(interactions_received), 6) AS in_degree_std,
  round(avg(interactions_sent), 6) AS out_degree_mean, round(stddev_samp(interactions_sent), 6) AS out_degree_std,
  round(sum(toxicity_sent), 6) AS sent_toxicity_sum, round(sum(toxicity_received), 6) AS received_toxicity_sum,
  CAST(sum(interactions_total) AS BIGINT) AS total_interactions_sum
  FROM flow JOIN politicians ON node_id = twitter_handle GROUP BY 1, 2, 3""", extra=f"{FLOW}, {POLITICIANS}"))
def a_party_rollup(spark, sf):
    flow = local.node_flow(fixtures.edges(spark, sf))
    rows = tables.politician_nodes(flow, fixtures.politicians(spark, sf)).select(
        *K, "party", "category", F.col("interactions_received").cast("double").alias("in_degree"),
        F.col("interactions_sent").cast("double").alias("out_degree"), F.col("toxicity_sent").alias("sent_toxicity"),
        F.col("toxicity_received").alias("received_toxicity"), F.col("interactions_total").alias("total_interactions"))
    return rounded(tables.party_rollup(rows))


PREDICTED = rf"""{EVALUATION}, predicted AS (SELECT sentiment, toxicity_label,
  CASE WHEN p > n THEN 'positive' WHEN n > p THEN 'negative' ELSE 'neutral' END AS sentiment_predicted,
  CASE WHEN t > 0 THEN 'toxic' ELSE 'non-toxic' END AS toxicity_predicted FROM
  (SELECT sentiment, toxicity_label, {_count_sql(lexicon.POSITIVE)} AS p, {_count_sql(lexicon.NEGATIVE)} AS n, {_count_sql(lexicon.TOXIC)} AS t
   FROM (SELECT *, regexp_split_to_array(lower(text), '[^\p{{L}}]+') AS words FROM evaluation)))"""


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    text = F.col("text")
    return evaluation_rows(spark, sf).select(
        "sentiment", "toxicity_label", lexicon.sentiment(text)["label"].alias("sentiment_predicted"),
        lexicon.toxicity(text)["label"].alias("toxicity_predicted"))


def _confusion_sql(truth: str, predicted: str, labels: tuple[str, ...]) -> str:
    cells = ", ".join(f"count(*) FILTER ({predicted} = '{label}') AS \"{label}\"" for label in labels)
    values = ", ".join(f"('{label}')" for label in labels)
    return f"""SELECT l.label AS true_label, {cells} FROM (VALUES {values}) l(label) LEFT JOIN predicted ON {truth} = l.label GROUP BY l.label"""


@query("a_confusion", f"""WITH {PREDICTED} {_confusion_sql('toxicity_label', 'toxicity_predicted', lexicon.TOXICITY_LABELS)}""")
def a_confusion(spark, sf):
    return evaluation.confusion(predictions(spark, sf), "toxicity_label", "toxicity_predicted", lexicon.TOXICITY_LABELS)


@query("a_confusion_sentiment", f"""WITH {PREDICTED} {_confusion_sql('sentiment', 'sentiment_predicted', lexicon.SENTIMENT_LABELS)}""")
def a_confusion_sentiment(spark, sf):
    return evaluation.confusion(predictions(spark, sf), "sentiment", "sentiment_predicted", lexicon.SENTIMENT_LABELS)


@query("a_accuracy", f"WITH {PREDICTED} SELECT round(avg(CASE WHEN toxicity_label = toxicity_predicted THEN 1.0 ELSE 0.0 END), 6) AS accuracy, count(*) AS total FROM predicted")
def a_accuracy(spark, sf):
    return rounded(evaluation.accuracy(predictions(spark, sf), "toxicity_label", "toxicity_predicted"))


@query("a_prf", f"""WITH {PREDICTED}, labels_list(label) AS (VALUES ('non-toxic'), ('neutral'), ('toxic')),
cells AS (SELECT label, count(*) FILTER (toxicity_label = label AND toxicity_predicted = label) AS tp,
  count(*) FILTER (toxicity_label <> label AND toxicity_predicted = label) AS fp,
  count(*) FILTER (toxicity_label = label AND toxicity_predicted <> label) AS fn FROM predicted, labels_list GROUP BY label),
ratios AS (SELECT label, CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / (tp + fn) ELSE 0 END AS r FROM cells)
SELECT label, round(p, 4) AS precision, round(r, 4) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 4) AS f1_score FROM ratios""")
def a_prf(spark, sf):
    return evaluation.precision_recall(predictions(spark, sf), "toxicity_label", "toxicity_predicted", lexicon.TOXICITY_LABELS)


@query("a_token_usage", f"""WITH {CLASSIFIED} SELECT CAST(sum(length(hashtag)) AS BIGINT) AS total_input_tokens,
  CAST(sum(length(categories) - length(replace(categories, ';', '')) + 1) AS BIGINT) AS total_output_tokens FROM classified""")
def a_token_usage(spark, sf):
    return tags.token_usage(tags.classify(fixtures.hashtags(spark, sf)))


@query("a_run_span", with_edges("""SELECT graph_id AS table_name, count(DISTINCT month_start) AS total_months_processed,
  strftime(min(month_start), '%Y-%m-%d') AS first_month, strftime(max(month_start), '%Y-%m-%d') AS last_month FROM edges GROUP BY 1"""))
def a_run_span(spark, sf):
    return tables.run_span(fixtures.edges(spark, sf))


@query("a_axis_max", with_edges("SELECT round(greatest(max(toxicity_sent_avg), max(toxicity_received_avg)) * 1.05, 6) AS axis_max FROM chosen", extra=f"{FLOW}, {PARTY_ROWS}"))
def a_axis_max(spark, sf):
    flow = local.node_flow(fixtures.edges(spark, sf))
    return rounded(tables.axis_max(tables.party_accounts(flow, list(ACCOUNTS), "1997-01-01", "1998-01-01")))


@query("a_run_stats", f"WITH {TWEETS} SELECT count(*) AS total_processed, true AS timed FROM tweets")
def a_run_stats(spark, sf):
    path = scratch_path(spark, "run-stats")
    stats = incremental.run_statistics(scoring.score_by_lexicon(fixtures.tweets(spark, sf)), lambda df: df.write.parquet(path))
    written = spark.read.schema(schemas.SCORED_TWEETS).parquet(path)
    return written.agg(F.count(F.lit(1)).alias("total_processed")).withColumn(
        "timed", (F.col("total_processed") == int(stats["total_processed"])) & (F.lit(stats["per_second"]) > 0))


# Sorting, limits, sets --------------------------------------------------------------------------------------------

@query("t_top_edges", with_edges("""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY graph_id, month_start ORDER BY weight DESC, source, target) AS position
  FROM edges) WHERE position <= 100000"""))
def t_top_edges(spark, sf):
    order = [F.desc("weight"), F.col("source"), F.col("target")]
    return top_rows(fixtures.edges(spark, sf), K, order, 100_000)


@query("t_hashtags", f"WITH {HASHTAGS} SELECT * FROM hashtags ORDER BY politician_users DESC, hashtag LIMIT 55000")
def t_hashtags(spark, sf):
    return tags.top_hashtags(fixtures.hashtags(spark, sf), 55_000)


@query("t_newest_tweets", f"WITH {TWEETS} SELECT * FROM tweets ORDER BY recorded_at DESC, tweet_id LIMIT 5120")
def t_newest_tweets(spark, sf):
    return scoring.newest(fixtures.tweets(spark, sf), 5120)


@query("t_page_tweets", f"WITH {TWEETS} SELECT * FROM tweets ORDER BY recorded_at, tweet_id LIMIT 5000 OFFSET 100")
def t_page_tweets(spark, sf):
    return scoring.page(fixtures.tweets(spark, sf), 5000, skip=100)


@query("s_concat_months", with_edges("""SELECT graph_id, month_start, count(*) AS edges, CASE WHEN graph_id = 'part' THEN round(avg(weight), 6) END AS mean_weight FROM edges GROUP BY 1, 2"""))
def s_concat_months(spark, sf):
    edges = fixtures.edges(spark, sf)
    plain = edges.where(F.col("graph_id") == "supplier").groupBy(*K).agg(F.count(F.lit(1)).alias("edges"))
    wide = edges.where(F.col("graph_id") == "part").groupBy(*K).agg(F.count(F.lit(1)).alias("edges"), F.avg("weight").alias("mean_weight"))
    return rounded(plain.unionByName(wide, allowMissingColumns=True))


@query("s_node_set", with_edges("SELECT * FROM nodes", extra=NODES))
def s_node_set(spark, sf):
    return build.node_set(fixtures.edges(spark, sf))


# Models and increments --------------------------------------------------------------------------------------------

@query("u_score_tweets", SCORED_ROWS)
def u_score_tweets(spark, sf):
    return rounded(scoring.score_by_lexicon(fixtures.tweets(spark, sf)))


@query("u_score_tweets_plugin", SCORED_ROWS)
def u_score_tweets_plugin(spark, sf):
    return rounded(scoring.score_by_models(fixtures.tweets(spark, sf), lambda: lexicon.lexicon_sentiment, lambda: lexicon.lexicon_toxicity))


@query("u_classify_hashtags", f"WITH {CLASSIFIED} SELECT hashtag, categories, confidence FROM classified")
def u_classify_hashtags(spark, sf):
    classified = tags.classify(fixtures.hashtags(spark, sf))
    return classified.select("hashtag", tags.joined_categories(F.col("categories")).alias("categories"), "confidence")


@query("u_validate_taxonomy", f"""WITH {HASHTAGS} SELECT hashtag, CASE WHEN contains(hashtag, 'nation') THEN 'Weather' ELSE '{taxonomy.UNCATEGORIZED}' END AS categories FROM hashtags""")
def u_validate_taxonomy(spark, sf):
    found = F.when(F.contains("hashtag", F.lit("nation")), F.array(F.lit("Weather"), F.lit("Rain"))).otherwise(F.array("hashtag"))
    return fixtures.hashtags(spark, sf).select("hashtag", tags.joined_categories(tags.legal_categories(found)).alias("categories"))


@query("i_score_increment", SCORED_ROWS)
def i_score_increment(spark, sf):
    path, tweets = scratch_path(spark, "scored"), fixtures.tweets(spark, sf)
    incremental.score_increment(tweets, path, limit=100)
    for _ in range(2):  # the second pass finds nothing to do
        incremental.score_increment(tweets, path)
    return rounded(incremental.stored_scores(spark, path))


@query("i_score_stream", SCORED_ROWS)
def i_score_stream(spark, sf):
    source, target = scratch_path(spark, "arriving"), scratch_path(spark, "stream-scored")
    fixtures.tweets(spark, sf).repartition(4).write.parquet(source)
    incremental.score_stream(spark, source, target, scratch_path(spark, "stream-state"), files_per_batch=2).awaitTermination()
    return rounded(incremental.stored_scores(spark, target))


@query("a_stream_times", f"""WITH {TWEETS} SELECT count(*) AS total_processed, 4 AS batches, count(*) / 4.0::DOUBLE AS mean_batch_rows, true AS timed FROM tweets
  WHERE regexp_matches(text, '\\S')""")
def a_stream_times(spark, sf):
    """Four batches, one a file; the seconds differ from run to run, so that they add up is what is compared."""
    source, target, times = scratch_path(spark, "arriving"), scratch_path(spark, "stream-scored"), incremental.RunTimes()
    fixtures.tweets(spark, sf).repartition(4).write.parquet(source)
    incremental.score_stream(spark, source, target, scratch_path(spark, "stream-state"), files_per_batch=1, times=times).awaitTermination()
    found = times.summary()
    sound = (found["mean_inference_seconds"] > 0 and found["mean_queue_seconds"] > 0 and found["per_second"] > 0
             and abs(found["mean_inference_seconds"] + found["mean_queue_seconds"] - found["mean_batch_seconds"]) < 1e-6)
    return incremental.stored_scores(spark, target).agg(F.count(F.lit(1)).alias("total_processed")).select(
        "total_processed", F.lit(found["batches"]).alias("batches"), F.lit(found["mean_batch_rows"]).alias("mean_batch_rows"),
        ((F.col("total_processed") == found["total_processed"]) & F.lit(sound)).alias("timed"))


@query("i_weekly_stream", f"""WITH {SCORES} SELECT CAST(date_trunc('week', recorded_at) AS TIMESTAMP) AS week_start, count(tweet_id) AS total_tweets,
  round(avg(toxicity_score), 6) AS avg_toxicity_score FROM scored GROUP BY 1""")
def i_weekly_stream(spark, sf):
    """All posts arrive in one batch, then complete mode writes every week."""
    source, target = scratch_path(spark, "weekly-source"), scratch_path(spark, "weekly")
    scoring.score_by_lexicon(fixtures.tweets(spark, sf)).repartitionByRange(4, "recorded_at").write.parquet(source)
    arriving = spark.readStream.schema(schemas.SCORED_TWEETS).parquet(source)
    (incremental.weekly_stream(arriving).writeStream.outputMode("complete")
     .foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(target))
     .option("checkpointLocation", scratch_path(spark, "weekly-state")).trigger(availableNow=True).start().awaitTermination())
    return rounded(spark.read.parquet(target))
