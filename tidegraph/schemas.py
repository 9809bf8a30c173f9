"""Declared schemas of every input and output table."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(text: str, required: tuple[str, ...] = ()) -> T.StructType:
    """``"name type, …"`` with the named columns not nullable."""
    kinds = {"string": T.StringType(), "bigint": T.LongType(), "double": T.DoubleType(),
             "date": T.DateType(), "timestamp": T.TimestampType()}
    fields = [part.split() for part in text.split(",")]
    return T.StructType([T.StructField(name, kinds[kind], name not in required) for name, kind in fields])


EDGES = _struct("graph_id string, month_start date, source string, target string, weight bigint, "
                "sum_toxicity double, avg_toxicity double")

WEEKLY_EDGES = _struct("Source string, Target string, Weight bigint, Week string")

TWEETS = _struct("tweet_id string, user_id string, recorded_at timestamp, text string")

# Columns of the published tables.
SCORED_TWEETS = _struct(
    "tweet_id string, user_id string, recorded_at timestamp, text string, sentiment string, "
    "positive_probability double, neutral_probability double, negative_probability double, "
    "toxicity_label string, toxicity_score double")

NODE_METRICS = _struct(
    "row_id string, month_start date, node_id string, pagerank double, degree_in double, degree_out double, "
    "betweenness double, clustering double, triangles bigint, core_number bigint, interactions_sent bigint, "
    "interactions_received bigint, interactions_total bigint, toxicity_sent double, toxicity_received double, "
    "toxicity_sent_avg double, toxicity_received_avg double", required=("row_id",))

NETWORK_METRICS = _struct(
    "row_id string, month_start date, table_name string, nodes bigint, edges bigint, density double, "
    "connected_components bigint, transitivity double, modularity double, modularity_classes bigint, "
    "assortativity double, network_avg_toxicity double, median_node_toxicity double, max_core_number bigint, "
    "avg_core_number double, rich_club_coefficient double, average_clustering double", required=("row_id",))

HASHTAGS = _struct("hashtag string, politician_users bigint")
HASHTAGS_CLASSIFIED = _struct("hashtag string, politician_users bigint, categories string, confidence double")
POLITICIANS = _struct("twitter_handle string, official_name string, party string")
EVALUATION = _struct("text string, sentiment string, toxicity_label string")


def of_sources(schema: T.StructType) -> T.StructType:
    """``schema`` for a table that holds several sources, each under its ``graph_id``."""
    return T.StructType([*schema.fields, T.StructField("graph_id", T.StringType())])
