"""Operators over the ordered rows of an entity: changes, runs, gaps, keys and events.

All partition by entity, so they shuffle once on it and then run as windows; operators
chained on one entity reuse that partitioning.  Order columns must order an entity's rows
totally.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F


def _order(entity: list[str], order: list[str]) -> WindowSpec:
    return Window.partitionBy(*entity).orderBy(*order)


def indexed(df: DataFrame, entity: list[str], order: list[str], name: str = "idx") -> DataFrame:
    """Number each entity's rows from 0."""
    return df.withColumn(name, F.row_number().over(_order(entity, order)).cast("long") - 1)


def changes(df: DataFrame, entity: list[str], order: list[str], value: str, name: str = "change") -> DataFrame:
    """Absolute difference from the row before; 0 for the first row and next to nulls."""
    return df.withColumn(name, F.coalesce(F.abs(F.col(value) - F.lag(value).over(_order(entity, order))), F.lit(0.0)))


def runs(df: DataFrame, entity: list[str], index: str, moving: Column, bridge: int = 1, least: int = 2, step: Column | None = None) -> DataFrame:
    """Runs of moving rows: first, last, count.

    Up to ``bridge`` quiet rows inside a run do not end it; runs shorter than ``least`` rows
    are dropped unless one of their rows is a step.
    """
    order = _order(entity, [index])
    rows = df.withColumn("_step", step if step is not None else F.lit(False)).filter(moving)
    opened = (F.col(index) - F.lag(index).over(order) > bridge + 1).cast("int")
    rows = rows.withColumn("_opened", F.coalesce(opened, F.lit(1))).withColumn("_run", F.sum("_opened").over(order))
    found = rows.groupBy(*entity, "_run").agg(F.min(index).alias("first"), F.max(index).alias("last"), F.count(F.lit(1)).alias("n"), F.max("_step").alias("_step"))
    return found.filter((F.col("last") - F.col("first") + 1 >= least) | F.col("_step")).drop("_run", "_step")


def merged_runs(found: DataFrame, entity: list[str], apart: int) -> DataFrame:
    """Join neighbouring runs whose distance is less than ``apart``."""
    order = _order(entity, ["first"])
    opened = F.coalesce((F.col("first") - F.lag("last").over(order) >= apart).cast("int"), F.lit(1))
    rows = found.withColumn("_opened", opened).withColumn("_group", F.sum("_opened").over(order))
    return rows.groupBy(*entity, "_group").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.count(F.lit(1)).alias("parts")).drop("_group")


# Least change per row of each kind of motion, the change that makes one row a step, and the kinds' order.
EPS = {"translation": 0.5, "rotation": 0.25, "scale": 0.002, "opacity": 0.005, "reveal": 0.005, "spin": 0.25}
STEP = {"translation": 2.0, "rotation": 1.0, "scale": 0.01, "opacity": 0.02, "reveal": 0.01, "spin": 1.0}
KINDS = ("translation", "rotation", "scale", "opacity", "reveal", "spin")


def _moving_spans(steps: DataFrame, keys: list[str], index: str) -> DataFrame:
    """Runs of moving steps (index, now, next, step): start, end, the state at the start and at the end."""
    order = _order(keys, [index])
    opened = F.coalesce((F.col(index) - F.lag(index).over(order) > 2).cast("int"), F.lit(1))
    rows = steps.withColumn("_opened", opened).withColumn("_run", F.sum("_opened").over(order))
    found = rows.groupBy(*keys, "_run").agg(F.min(index).alias("start"), (F.max(index) + 1).alias("end"), F.min_by("now", index).alias("_from"), F.max_by("next", index).alias("_to"), F.max("step").alias("_step"))
    return found.filter((F.col("end") - F.col("start") >= 2) | F.col("_step"))


def _numbered(found: DataFrame, entity: list[str]) -> DataFrame:
    number = F.row_number().over(Window.partitionBy(*entity).orderBy("start", "_rank"))
    return found.withColumns({"motion": number.cast("long"), "dur": F.col("end") - F.col("start")})


def motions(df: DataFrame, entity: list[str], index: str, channels: dict[str, tuple[str, float]]) -> DataFrame:
    """Motion events of several channels {type: (value column, threshold)}, in one pass over the rows.

    A motion spans a run of changing steps and ends one row after the run; its magnitude is
    the value there less the value at its start.  Motions are numbered per entity by start,
    then by the channels' order.
    """
    values = F.array(*[F.col(v).cast("double") for v, _ in channels.values()])
    rows = df.select(*entity, F.col(index).alias("_at"), values.alias("_now")).withColumn("_next", F.lead("_now").over(_order(entity, ["_at"])))
    options = F.array(*[F.struct(F.lit(kind).alias("type"), F.lit(i).alias("_rank"), F.col("_now")[i].alias("now"), F.col("_next")[i].alias("next"), F.lit(float(least)).alias("_least")) for i, (kind, (_, least)) in enumerate(channels.items())])
    steps = rows.filter("_next is not null").select(*entity, "_at", F.explode(options).alias("_c")).select(*entity, "_at", "_c.*").filter(F.abs(F.col("next") - F.col("now")) > F.col("_least"))
    found = _moving_spans(steps.withColumn("step", F.lit(False)), [*entity, "type", "_rank"], "_at").withColumn("mag", F.col("_to") - F.col("_from"))
    return _numbered(found, entity).select(*entity, "motion", "type", "start", "end", "dur", "mag")


def matrix_motions(df: DataFrame, entity: list[str], index: str, eps: dict[str, float] | None = None, step: dict[str, float] | None = None, extra: dict[str, str] | None = None) -> DataFrame:
    """Motions of elements with columns x, y, sx, sy, rot and opacity, and extra ones {column: kind} if given.

    Translation has a unit direction and its length as magnitude, scale the mean ratio of its
    two factors, all else a difference.  A row with nulls is not seen, and nothing moves into
    or out of it; a single changing row counts only where ``step`` calls its change a step.
    Every entity has a row for each index from its first to its last.
    """
    least, jump = {**EPS, **(eps or {})}, step or {}
    base = ["x", "y", "sx", "sy", "rot", "opacity"]
    columns = [*base, *(extra or {})]
    state = F.struct(*[F.col(c).cast("double").alias(c) for c in columns])
    seen = F.when(F.greatest(*[F.col(c).isNull().cast("int") for c in base]) == 0, state)
    rows = df.select(*entity, F.col(index).alias("_at"), seen.alias("now")).withColumn("next", F.lead("now").over(_order(entity, ["_at"])))
    off = {c: F.col(f"next.{c}") - F.col(f"now.{c}") for c in columns}
    signals = {"translation": ("translation", F.hypot(off["x"], off["y"])), "rotation": ("rotation", F.abs(off["rot"])), "scale": ("scale", F.abs(off["sx"]) + F.abs(off["sy"])), "opacity": ("opacity", F.abs(off["opacity"]))}
    signals |= {c: (kind, F.abs(off[c])) for c, kind in (extra or {}).items()}
    options = F.array(*[
        F.struct(F.lit(kind).alias("type"), F.lit(name).alias("_channel"), F.lit(KINDS.index(kind)).alias("_rank"), (signal > least[kind]).alias("_moves"), (signal > jump.get(kind, float("inf"))).alias("step"))
        for name, (kind, signal) in signals.items()
    ])
    steps = rows.filter("now is not null and next is not null").select(*entity, "_at", "now", "next", F.explode(options).alias("_c")).select(*entity, "_at", "now", "next", "_c.*").filter("_moves")
    found = _moving_spans(steps, [*entity, "type", "_channel", "_rank"], "_at")
    to, back = (lambda c: F.col(f"_to.{c}")), (lambda c: F.col(f"_from.{c}"))
    dx, dy = to("x") - back("x"), to("y") - back("y")
    length, moved = F.hypot(dx, dy), F.col("type") == "translation"
    mag = F.when(moved, length).when(F.col("type") == "scale", 0.5 * (F.try_divide(to("sx"), back("sx")) + F.try_divide(to("sy"), back("sy"))))
    for name in ("rot", "opacity", *(extra or {})):
        mag = mag.when(F.col("_channel") == {"rot": "rotation"}.get(name, name), to(name) - back(name))
    found = found.withColumns({"mag": mag, "dir_x": F.when(moved, F.try_divide(dx, length)), "dir_y": F.when(moved, F.try_divide(dy, length))})
    number = F.row_number().over(Window.partitionBy(*entity).orderBy("start", "_rank", "_channel"))
    return found.withColumns({"motion": number.cast("long"), "dur": F.col("end") - F.col("start")}).select(*entity, "motion", "type", "start", "end", "dur", "dir_x", "dir_y", "mag")


def spikes(df: DataFrame, entity: list[str], index: str, change: str, floor: float, factor: float, near: int = 2, duplicate: float = 0.0) -> DataFrame:
    """Rows whose change stands out: at least ``floor`` and ``factor`` times the mean of the near changes.

    Rows that do not change (repeated rows) are no neighbours.
    """
    order = _order(entity, [index])
    around = order.rowsBetween(-near, near)
    rows = df.filter(F.col(change) > duplicate).withColumn("_sum", F.sum(change).over(around) - F.col(change)).withColumn("_n", F.count(F.lit(1)).over(around) - 1)
    limit = F.greatest(F.lit(floor), F.when(F.col("_n") > 0, factor * F.col("_sum") / F.col("_n")).otherwise(0.0))
    return rows.filter(F.col(change) >= limit).drop("_sum", "_n")


def segments(df: DataFrame, entity: list[str], index: str, cut: Column) -> DataFrame:
    """Contiguous segments that begin at each cut: segment, first, last, and whether it follows the one before."""
    order = _order(entity, [index])
    rows = df.withColumn("_cut", F.coalesce(cut, F.lit(True)).cast("int")).withColumn("segment", F.sum("_cut").over(order).cast("long"))
    found = rows.groupBy(*entity, "segment").agg(F.min(index).alias("first"), F.max(index).alias("last"))
    before = F.lag("last").over(_order(entity, ["segment"]))
    return found.withColumn("contiguous", F.coalesce(F.col("first") == before + 1, F.lit(True)))


def intervals(df: DataFrame, entity: list[str], position: str) -> DataFrame:
    """Collapse a set of integer positions to inclusive intervals."""
    rows = df.select(*entity, position).distinct()
    island = F.col(position) - F.row_number().over(_order(entity, [position]))
    return rows.withColumn("_island", island).groupBy(*entity, "_island").agg(F.min(position).alias("first"), F.max(position).alias("last"), F.count(F.lit(1)).alias("n")).drop("_island")


def dense(df: DataFrame, entity: list[str], position: str) -> DataFrame:
    """One row per entity and integer position from its first to its last; other columns are null where absent."""
    span = df.groupBy(*entity).agg(F.min(position).alias("_a"), F.max(position).alias("_b"))
    grid = span.select(*entity, F.explode(F.sequence("_a", "_b")).alias(position))
    return grid.join(df, [*entity, position], "left")


def held(df: DataFrame, entity: list[str], position: str, value: str, name: str = "held") -> DataFrame:
    """The last known value at or before each row (a step function)."""
    return df.withColumn(name, F.last(value, ignorenulls=True).over(_order(entity, [position]).rowsBetween(Window.unboundedPreceding, 0)))


def filled(df: DataFrame, entity: list[str], position: str, value: str, name: str = "filled") -> DataFrame:
    """Linear interpolation of inner nulls by position; nulls at the edges stay.

    Only rows with a value know the next one; each carries the line to it over the rows after.
    """
    order = _order(entity, [position])
    known = df.filter(F.col(value).isNotNull())
    ahead = F.struct(F.col(position).alias("p0"), F.col(value).alias("v0"), F.lead(position).over(order).alias("p1"), F.lead(value).over(order).alias("v1"))
    lines = known.select(*entity, position, ahead.alias("_line"))
    rows = df.join(lines, [*entity, position], "left").withColumn("_line", F.last("_line", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    at = F.col("_line")
    line = F.when(F.col(value).isNotNull(), F.col(value)).otherwise(at["v0"] + (at["v1"] - at["v0"]) * ((F.col(position) - at["p0"]) / (at["p1"] - at["p0"])))
    return rows.withColumn(name, line).drop("_line")


def filled_dense(df: DataFrame, entity: list[str], position: str, value: str, name: str = "filled") -> DataFrame:
    """Every integer position from an entity's first known value to its last, interpolated linearly.

    Each known row makes the positions up to the next one, so nothing is joined and the only
    window is over known rows.
    """
    known = df.filter(F.col(value).isNotNull()).select(*entity, F.col(position).alias("_p"), F.col(value).alias("_v"))
    order = _order(entity, ["_p"])
    known = known.withColumns({"_q": F.lead("_p").over(order), "_w": F.lead("_v").over(order)})
    rows = known.withColumn(position, F.explode(F.sequence(F.col("_p"), F.coalesce(F.col("_q") - 1, F.col("_p")))))
    line = F.when(F.col(position) == F.col("_p"), F.col("_v")).otherwise(F.col("_v") + (F.col("_w") - F.col("_v")) * ((F.col(position) - F.col("_p")) / (F.col("_q") - F.col("_p"))))
    return rows.select(*entity, position, line.alias(name))


def noise_bound(df: DataFrame, entity: list[str], order: list[str], value: str, least: int = 11) -> DataFrame:
    """Largest deviation that measurement noise alone gives: the smaller of two robust deviations times sqrt(2 ln n).

    They are the scaled median absolute deviations of the first and of the third
    differences, over sqrt(2) and sqrt(20); entities with few values get 0.
    """
    w = _order(entity, order)
    rows = df.filter(F.col(value).isNotNull() & ~F.isnan(value))
    v = [F.col(value), *[F.lag(value, i).over(w) for i in (1, 2, 3)]]
    rows = rows.withColumn("_d1", v[0] - v[1]).withColumn("_d3", v[0] - 3 * v[1] + 3 * v[2] - v[3])
    middle = rows.groupBy(*entity).agg(F.median("_d1").alias("_m1"), F.median("_d3").alias("_m3"), F.count(F.lit(1)).alias("n"))
    spread = rows.join(middle, entity).groupBy(*entity).agg(F.first("n").alias("n"), F.median(F.abs(F.col("_d1") - F.col("_m1"))).alias("_a1"), F.median(F.abs(F.col("_d3") - F.col("_m3"))).alias("_a3"))
    sigma = F.least(F.col("_a1") / 0.6745 / F.sqrt(F.lit(2.0)), F.col("_a3") / 0.6745 / F.sqrt(F.lit(20.0)))
    return spread.select(*entity, "n", F.when(F.col("n") < least, 0.0).otherwise(sigma * F.sqrt(2 * F.log(F.col("n").cast("double")))).alias("bound"))


def crossings(df: DataFrame, entity: list[str], position: str, value: str, level: Column) -> DataFrame:
    """First time, interpolated, at which a series reaches a level; null for an entity that never does."""
    w = _order(entity, [position])
    rows = df.withColumns({"_v": F.lag(value).over(w), "_p": F.lag(position).over(w), "_level": level})
    hit = F.when(F.col("_v").isNull() & (F.col(value) >= F.col("_level")), F.col(position).cast("double")).when(
        (F.col("_v") < F.col("_level")) & (F.col(value) >= F.col("_level")),
        F.col("_p") + (F.col("_level") - F.col("_v")) / (F.col(value) - F.col("_v")) * (F.col(position) - F.col("_p")),
    )
    return rows.groupBy(*entity).agg(F.min(hit).alias("crossing"))


def settled(df: DataFrame, entity: list[str], index: str, change: str, quiet: float, within: int, step: int = 1) -> DataFrame:
    """For each row the first index from it, at most within - 1 on (or back, for step -1), whose changes on both sides are quiet; else its own."""
    w = _order(entity, [index])
    calm = F.greatest(F.col(change), F.coalesce(F.lead(change).over(w), F.lit(float("inf")))) < quiet
    rows = df.withColumn("_calm", F.when(calm, F.col(index)))
    found = F.first("_calm", ignorenulls=True).over(w.rowsBetween(0, within - 1)) if step > 0 else F.last("_calm", ignorenulls=True).over(w.rowsBetween(1 - within, 0))
    return rows.withColumn("settled", F.coalesce(found, F.col(index))).drop("_calm")


def first_of_run(df: DataFrame, entity: list[str], order: list[str], value: str) -> DataFrame:
    """Number runs of one repeated value; work on a run's first row serves all its rows."""
    w = _order(entity, order)
    fresh = ~F.col(value).eqNullSafe(F.lag(value).over(w)) | (F.row_number().over(w) == 1)
    return df.withColumn("_fresh", fresh.cast("int")).withColumn("run", F.sum("_fresh").over(w).cast("long")).withColumn("is_first", F.col("_fresh") == 1).drop("_fresh")


def retimed(keys: DataFrame, entity: list[str], time: str, order: list[str], speed: float, delay: int, anchor: Column) -> DataFrame:
    """Affine remap of key times, rounded half to even; of keys that fall together the later one stays."""
    moved = keys.withColumn("new_t", (F.rint(anchor + (F.col(time) - anchor) / speed) + delay).cast("long"))
    last = F.row_number().over(Window.partitionBy(*entity, "new_t").orderBy(*[F.desc(c) for c in [time, *order]]))
    return moved.withColumn("_last", last).filter("_last = 1").drop("_last")


def evenly(df: DataFrame, entity: list[str], index: str, n: int) -> DataFrame:
    """At most n rows of each entity at evenly spaced indices, both ends included."""
    count = F.max(index).over(Window.partitionBy(*entity)) + 1
    picks = F.when(count <= n, F.sequence(F.lit(0).cast("long"), count - 1)).otherwise(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.floor(i * (count - 1) / (n - 1) + 0.5).cast("long")))
    return df.withColumn("_picks", picks).filter(F.array_contains("_picks", F.col(index))).drop("_picks")


def keyed_curve(df: DataFrame, entity: list[str], position: str, value: str, bound: float) -> DataFrame:
    """Keys of a piecewise linear curve within ``bound`` of all values, split at the worst row.

    A sequence is compressed as a whole, so an entity is one unit of work; entities run in parallel.
    """
    schema = df.select(*entity, F.col(position).cast("long").alias("t"), F.col(value).cast("double").alias("v"))

    def compress(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.dropna(subset=["v"]).sort_values("t", ignore_index=True)
        t, v = rows["t"].to_numpy(np.float64), rows["v"].to_numpy()
        keep, open_ = np.zeros(len(rows), bool), [(0, len(rows) - 1)]
        keep[[0, -1]] = True if len(rows) else keep[:0]
        while open_ and len(rows):
            a, b = open_.pop()
            if b - a < 2:
                continue
            line = v[a] + (v[b] - v[a]) * (t[a + 1 : b] - t[a]) / (t[b] - t[a])
            off = np.abs(line - v[a + 1 : b])
            worst = int(off.argmax())
            if off[worst] > bound:
                keep[a + 1 + worst] = True
                open_ += [(a, a + 1 + worst), (a + 1 + worst, b)]
        return rows[keep]

    return schema.groupBy(*entity).applyInPandas(compress, schema.schema)


def handles(keys: DataFrame, entity: list[str], position: str, value: str, fps: float, influence: float) -> DataFrame:
    """Speed by second from each key to the next, and the handle's influence in percent; the last key has none."""
    w = _order(entity, [position])
    rows = keys.withColumns({"_p": F.lead(position).over(w), "_v": F.lead(value).over(w)}).filter(F.col("_v").isNotNull())
    speed = (F.col("_v") - F.col(value)) / (F.col("_p") - F.col(position)) * fps
    return rows.select(*entity, position, speed.alias("speed"), (F.lit(influence) * 100).alias("influence"))


def merged_timeline(keys: DataFrame, entity: list[str], position: str, channels: dict[str, Column]) -> DataFrame:
    """The union of the channels' key times with each channel's value there, held since its own last key; null: no key."""
    rows = keys.withColumns({f"_{name}": value for name, value in channels.items()})
    rows = rows.filter(F.coalesce(*[F.col(f"_{name}").cast("string") for name in channels]).isNotNull())
    past = _order(entity, [position]).rowsBetween(Window.unboundedPreceding, 0)
    return rows.select(*entity, position, *[F.last(f"_{name}", ignorenulls=True).over(past).alias(name) for name in channels])


def trimmed_tail(rows: DataFrame, entity: list[str], index: str, value: str, share: float) -> DataFrame:
    """Rows of an entity's first half, and later ones of at least a share of its largest value."""
    whole = Window.partitionBy(*entity)
    marked = rows.withColumns({"_top": F.max(value).over(whole), "_middle": F.percentile(index, 0.5).over(whole)})
    return marked.filter((F.col(index) <= F.col("_middle")) | (F.col(value) >= share * F.col("_top"))).drop("_top", "_middle")
