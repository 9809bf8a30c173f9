"""From raw documents to token ids: language, boilerplate lines, near copies, benchmark passages, encoding.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns of
``documents``. ``run`` writes each stage's rows and reads them again, which cuts the lineage and lets a lost
executor cost one stage's tasks at most.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidegraph.llm import decontaminate, jaccard, language, lines, pieces
from tidegraph.llm.common import flat, stored

MODEL = "piece_bpe_32k.model"


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without letters, or unlike the language they are nearest to, go."""
    return language.accepted(docs, language.trained_on(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found on many sites stay at their first place only; texts of nothing else go."""
    return lines.deduplicated(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by 0.8 or more of its five-word n-grams stays, the one of least id."""
    return jaccard.representatives(docs, shingle=5, percent=80, spare=0.25)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a twentieth or more of their words in benchmark passages go."""
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, with digests of the ids and of the decoded text."""
    with open(public_tokenizers.path(MODEL), "rb") as f:
        return flat(pieces.digests(docs, f.read(), keep=["doc_id", "lang", "source"], with_ids=True))


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_copies", near_copies),
          ("decontamination", decontamination), ("encoding", encoding)]

ORACLE_SQL = None
"""SQL cannot express the language models and the encoding; tests compare the stages with brute force."""


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
