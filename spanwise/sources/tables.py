"""Tables of the test data and the observations read from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as observations: entity user_id, order (ts, event_id), value, and k from the properties."""
    return table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "value", F.get_json_object("props", "$.k").cast("int").alias("k"))
