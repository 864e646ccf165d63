"""Joins by several attributes at once, and nearest neighbours, over grids whose cells meet by equi-joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .checkpoints import Rounds

#: Rows of a key that are compared with each other as they are, without a grid.
FEW = 64


def grid_join(left: DataFrame, right: DataFrame, keys: list[str], bands: list[tuple[str, str, float]]) -> DataFrame:
    """Pairs with equal keys whose attributes differ by at most a width each: bands of (left column, right column, width).

    A key with few rows on the right meets whole, so that the grid's copies of a row (three for
    each band) are made for large keys alone.
    """
    if keys:
        large = right.groupBy(*keys).agg(F.count(F.lit(1)).alias("_all")).filter(F.col("_all") > FEW).select(*keys)
        few = left.join(large, keys, "left_anti").join(right, keys)
        for a, b, width in bands:
            few = few.filter(F.abs(F.col(a) - F.col(b)) <= width)
        return few.unionByName(_by_cells(left.join(large, keys, "left_semi"), right, keys, bands))
    return _by_cells(left, right, keys, bands)


def _by_cells(left: DataFrame, right: DataFrame, keys: list[str], bands: list[tuple[str, str, float]]) -> DataFrame:
    dealt, other = left, right
    for i, (a, b, width) in enumerate(bands):
        at = F.floor(F.col(a) / width)
        dealt = dealt.withColumn(f"_cell{i}", F.explode(F.array(at - 1, at, at + 1)))
        other = other.withColumn(f"_cell{i}", F.floor(F.col(b) / width))
    cells = [f"_cell{i}" for i in range(len(bands))]
    pairs = dealt.join(other, [*keys, *cells]).drop(*cells)
    for a, b, width in bands:
        pairs = pairs.filter(F.abs(F.col(a) - F.col(b)) <= width)
    return pairs


def nearest_in_rings(rows: DataFrame, others: DataFrame, keys: list[str], ident: str, other: str, x: str, y: str, k: int, cell: float) -> DataFrame:
    """(keys, ident, rank, other, distance): the k nearest others of each row among equal keys, ties to the smaller id.

    A row whose key has few others looks at them all.  Any other looks at the nine cells around its own; it is done when its k-th distance is within
    one cell's width, or when it has seen all others of its key.  What is not done goes on with
    cells twice as wide, so the work at a row follows the room around it and not its key's size.
    """
    rounds = Rounds(rows.sparkSession)
    points = rows.select(*keys, ident, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    places = rounds.keep(others.select(*keys, F.col(other).alias("other"), F.col(x).cast("double").alias("_ox"), F.col(y).cast("double").alias("_oy")).filter("_ox is not null and _oy is not null"), "others")
    counts = places.groupBy(*keys).agg(F.count(F.lit(1)).alias("_all"))
    open_ = rounds.keep(points.filter("_x is not null and _y is not null").join(counts, keys), "open")
    order = Window.partitionBy(*keys, ident).orderBy("distance", "other")
    off = F.sqrt((F.col("_ox") - F.col("_x")) * (F.col("_ox") - F.col("_x")) + (F.col("_oy") - F.col("_y")) * (F.col("_oy") - F.col("_y")))
    few = open_.filter(F.col("_all") <= FEW).join(places, keys).withColumn("distance", off)  # no copies of rows for cells
    found = few.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(*keys, ident, "rank", "other", "distance")
    open_ = open_.filter(F.col("_all") > FEW)
    if open_.isEmpty():
        return found
    while True:
        at = [F.floor(F.col(c) / cell) for c in ("_x", "_y")]
        around = open_.withColumn("_cx", F.explode(F.array(at[0] - 1, at[0], at[0] + 1))).withColumn("_cy", F.explode(F.array(at[1] - 1, at[1], at[1] + 1)))
        dealt = places.withColumn("_cx", F.floor(F.col("_ox") / cell)).withColumn("_cy", F.floor(F.col("_oy") / cell))
        met = around.join(dealt, [*keys, "_cx", "_cy"]).withColumn("distance", off)
        seen = met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        ends = seen.groupBy(*keys, ident).agg(F.count(F.lit(1)).alias("_n"), F.max("distance").alias("_far"), F.max("_all").alias("_all"))
        seen = rounds.keep(seen.select(*keys, ident, "rank", "other", "distance"), "seen")
        done = rounds.keep(ends.filter(((F.col("_n") >= k) & (F.col("_far") <= cell)) | (F.col("_n") >= F.col("_all"))).select(*keys, ident), "done")
        part = seen.join(done, [*keys, ident], "left_semi")
        found = found.unionByName(part)
        open_ = rounds.keep(open_.join(done, [*keys, ident], "left_anti"), "open")
        if open_.isEmpty():
            return found
        cell *= 2
