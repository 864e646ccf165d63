"""Per-entity and per-pair measures: extents, shares, levels, lines, covered spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def extents(rows: DataFrame, entity: list[str], position: str, rate: float) -> DataFrame:
    """First and last position, row count and duration in units of ``rate`` positions (both ends count)."""
    found = rows.groupBy(*entity).agg(F.min(position).alias("first"), F.max(position).alias("last"), F.count(F.lit(1)).alias("rows"))
    return found.withColumn("duration", (F.col("last") - F.col("first") + 1) / rate)


def shares(rows: DataFrame, entity: list[str], owner: str) -> DataFrame:
    """Share of each owner in an entity's rows."""
    counts = rows.groupBy(*entity, owner).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*entity)))


def unstable_share(rows: DataFrame, entity: list[str], value: str, off: float, least_seen: int) -> DataFrame:
    """Share of values further than ``off`` from the entity's median; null where too few were seen."""
    middle = rows.groupBy(*entity).agg(F.median(value).alias("_middle"))
    near = rows.join(middle, entity).groupBy(*entity).agg(F.avg((F.abs(F.col(value) - F.col("_middle")) > off).cast("double")).alias("_share"), F.count(value).alias("seen"))
    return near.select(*entity, "seen", F.when(F.col("seen") >= least_seen, F.col("_share")).alias("share"))


def early_late(rows: DataFrame, entity: list[str], index: str, value: str) -> DataFrame:
    """Median of the later half of an entity's rows less that of the earlier half."""
    late = F.col(index) * 2 >= F.max(index).over(Window.partitionBy(*entity)) + 1
    halves = rows.withColumn("_late", late)
    return halves.groupBy(*entity).agg((F.median(F.when(F.col("_late"), F.col(value))) - F.median(F.when(~F.col("_late"), F.col(value)))).alias("change"))


def near_peak(rows: DataFrame, entity: list[str], value: str, ident: str, nth: int = 3, share: float = 0.97) -> DataFrame:
    """Rows that reach a share of their entity's nth highest value (of its highest, where it has fewer)."""
    order = Window.partitionBy(*entity).orderBy(F.desc(value), ident)
    level = F.coalesce(F.nth_value(value, nth).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.max(value).over(Window.partitionBy(*entity)))
    return rows.withColumn("level", level).filter(F.col(value) >= share * F.col("level"))


def weighted_line(rows: DataFrame, by: list[str], x: str, y: str, weight: str) -> DataFrame:
    """Weighted least-squares line y = a + b x per group, from sums that combine before the shuffle."""
    w, u, v = F.col(weight), F.col(x), F.col(y)
    sums = rows.groupBy(*by).agg(F.sum(w).alias("w"), F.sum(w * u).alias("x"), F.sum(w * v).alias("y"), F.sum(w * u * u).alias("xx"), F.sum(w * u * v).alias("xy"))
    det = F.col("w") * F.col("xx") - F.col("x") * F.col("x")
    slope = F.when(det != 0, (F.col("w") * F.col("xy") - F.col("x") * F.col("y")) / det)
    return sums.withColumn("slope", slope).select(*by, "slope", ((F.col("y") - F.col("slope") * F.col("x")) / F.col("w")).alias("intercept"))


def covered(spans: DataFrame, entity: list[str], first: str, last: str, pad: int) -> DataFrame:
    """Disjoint spans that the padded spans of an entity cover together."""
    padded = spans.select(*entity, (F.col(first) - pad).alias("_a"), (F.col(last) + pad).alias("_z"))
    order = Window.partitionBy(*entity).orderBy("_a", "_z")
    reach = F.max("_z").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = padded.withColumn("_new", F.coalesce((F.col("_a") > reach + 1).cast("int"), F.lit(1))).withColumn("_group", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return opened.groupBy(*entity, "_group").agg(F.min("_a").alias("first"), F.max("_z").alias("last"), F.count(F.lit(1)).alias("parts")).drop("_group")


def named(rows: DataFrame, value: str, seen: str, names: dict[str, str], prefix: str) -> DataFrame:
    """Distinct values with their preset name, or a number in the order they were first seen."""
    found = rows.groupBy(value).agg(F.min(seen).alias("seen"))
    preset = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    known = found.withColumn("_name", F.try_element_at(preset, F.col(value)))
    number = F.row_number().over(Window.partitionBy(F.col("_name").isNull()).orderBy("seen", value))
    return known.select(value, "seen", F.coalesce("_name", F.concat(F.lit(prefix), number.cast("string"))).alias("name"))


def first_fault(checks: list[tuple[str, Column]]) -> Column:
    """Code of the first check that fails (a null outcome fails too), or null."""
    out = F.lit(None).cast("string")
    for code, ok in reversed(checks):
        out = F.when(~F.coalesce(ok, F.lit(False)), code).otherwise(out)
    return out


def ramps(start: Column, length: Column, at: Column, delays: Column) -> Column:
    """Progress from 0 to 1 of items that start one after another, as an array."""
    return F.transform(delays, lambda d: F.greatest(F.lit(0.0), F.least(F.lit(1.0), (at - start - d) / length)))


def matrix_parts(a: Column, b: Column, c: Column, d: Column) -> dict[str, Column]:
    """Rotation in degrees, scales and shear of a 2 x 2 matrix (rows a b, c d)."""
    sx = F.sqrt(a * a + c * c)
    return {"rotation": F.degrees(F.atan2(c, a)), "sx": sx, "sy": (a * d - b * c) / sx, "shear": (a * b + c * d) / (sx * sx)}


def mean_distance(a: DataFrame, b: DataFrame, pairs: DataFrame, entity: str, frame: str, axes: list[str], far: float = 1e9) -> DataFrame:
    """Mean distance of each pair (a, b) of entities over their common frames; far where these are fewer than two."""
    left = a.select(F.col(entity).alias("a"), frame, *[F.col(c).alias(f"_a_{c}") for c in axes])
    right = b.select(F.col(entity).alias("b"), frame, *[F.col(c).alias(f"_b_{c}") for c in axes])
    off = F.sqrt(sum(((F.col(f"_a_{c}") - F.col(f"_b_{c}")) * (F.col(f"_a_{c}") - F.col(f"_b_{c}")) for c in axes), F.lit(0.0)))
    found = pairs.join(left, "a").join(right, ["b", frame]).groupBy("a", "b").agg(F.count(F.lit(1)).alias("frames"), F.avg(off).alias("_mean"))
    known = pairs.join(found, ["a", "b"], "left").withColumn("frames", F.coalesce("frames", F.lit(0)))
    return known.select("a", "b", "frames", F.when(F.col("frames") >= 2, F.col("_mean")).otherwise(far).alias("distance"))


def foreign_cover(boxes: DataFrame, others: DataFrame, keys: list[str], ident: str, other: str) -> DataFrame:
    """Share of each box that boxes of other identity cover among equal keys, at most 1."""
    from ..functions.geometry import box_area, box_overlap

    pairs = boxes.join(others.withColumnRenamed("box", "_other"), keys, "left")
    shared = F.when(F.col(other) != F.col(ident), box_overlap(F.col("box"), F.col("_other"))).otherwise(0.0)
    sums = pairs.groupBy(*keys, ident).agg(F.sum(F.coalesce(shared, F.lit(0.0))).alias("_shared"), F.first(box_area(F.col("box"))).alias("_area"))
    return sums.select(*keys, ident, F.when(F.col("_area") > 0, F.least(F.lit(1.0), F.col("_shared") / F.col("_area"))).otherwise(0.0).alias("cover"))


def offsets(df: DataFrame, entity: list[str], frame: str, x: str, y: str, area: str) -> DataFrame:
    """Each row's shift from its entity's row of largest area (the first of equals)."""
    base = df.groupBy(*entity).agg(F.max_by(F.struct(F.col(x).alias("x"), F.col(y).alias("y")), F.struct(F.col(area), -F.col(frame))).alias("_base"))
    return df.join(base, entity).select(*entity, frame, (F.col(x) - F.col("_base.x")).alias("dx"), (F.col(y) - F.col("_base.y")).alias("dy"))
