"""Seeded scenes with known truth, made on the cluster from a range and hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def _unit(seed: int, *columns: str | Column) -> Column:
    """A number from 0 to 1 that depends on the seed and the columns only."""
    return F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(1 << 31)) / float(1 << 31)


def moving_boxes(spark: SparkSession, seed: int, scenes: int, elements: int, frames: int) -> DataFrame:
    """One row per scene, element and frame: a box that moves in a line, and its noisy observation."""
    rows = spark.range(scenes * elements * frames).select(
        F.floor(F.col("id") / (elements * frames)).alias("scene"), (F.floor(F.col("id") / frames) % elements).alias("element"), (F.col("id") % frames).alias("frame"),
    )
    who = ("scene", "element")
    x, y = 1000 * _unit(seed, *who) + F.col("frame") * (10 * _unit(seed + 1, *who) - 5), 600 * _unit(seed + 2, *who)
    size = 20 + 60 * _unit(seed + 3, *who)
    noise = _unit(seed + 4, *who, "frame") - 0.5
    return rows.withColumns({"x": x, "y": y, "size": size, "seen_x": x + noise, "seen_y": y - noise})
