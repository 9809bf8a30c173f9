"""Sinks: replace, append, refresh of months, CSV and JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Select and cast the declared columns; a missing column or a null in a required one is an error."""
    missing = [f.name for f in schema if f.name not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")

    def column(field: T.StructField):
        value = F.col(field.name).cast(field.dataType)
        if not field.nullable:
            value = F.when(value.isNull(), F.raise_error(F.lit(f"{field.name} is null"))).otherwise(value)
        return value.alias(field.name)

    return df.select(*[column(f) for f in schema])


def _by_month(df: DataFrame, month: str):
    """Rows of a month meet in as many tasks as their size asks for: small months share one, large ones are split."""
    return df.hint("rebalance", month).write.partitionBy(month)


def replace_table(df: DataFrame, path: str, schema: T.StructType, month: str = "month_start") -> None:
    """Drop what is there and write anew, laid out by month."""
    _by_month(conform(df, schema), month).option("partitionOverwriteMode", "static").mode("overwrite").parquet(path)


def append_table(df: DataFrame, path: str, schema: T.StructType, month: str = "month_start") -> None:
    _by_month(conform(df, schema), month).mode("append").parquet(path)


def refresh_months(df: DataFrame, path: str, schema: T.StructType, month: str = "month_start") -> None:
    """Replace the months present in ``df`` and leave the others."""
    _by_month(conform(df, schema), month).option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


def write_csv(df: DataFrame, path: str, quote_all: bool = False) -> None:
    df.write.mode("overwrite").csv(path, header=True, quoteAll=quote_all, escape='"')


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
