"""Versions, jobs, heartbeats, transcripts: folds of event logs to their present state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: A device is lost after so many seconds without a sign, and connected within so many.
LOST_SECONDS, CONNECTED_SECONDS = 60, 40


def latest(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row per key in a total order, by aggregation (partial before the shuffle)."""
    others = [c for c in rows.columns if c not in key]
    last = F.max_by(F.struct(*others), F.struct(*order))
    return rows.groupBy(*key).agg(last.alias("_r")).select(*key, *[F.col(f"_r.{c}").alias(c) for c in others])


def parents(rows: DataFrame, key: list[str], order: list[str], ident: str) -> DataFrame:
    """Each version with its ordinal and its parent."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumns({"ord": F.row_number().over(w).cast("long") - 1, "parent": F.lag(ident).over(w)})


def folded_jobs(events: DataFrame, key: list[str], order: list[str], state: str, start: tuple[str, ...], final: tuple[str, ...]) -> DataFrame:
    """Final state of each job: the first terminal event after its start; later events change nothing."""
    w = Window.partitionBy(*key).orderBy(*order)
    started = F.max(F.col(state).isin(*start).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)) == 1
    rows = events.withColumn("_end", F.when(started & F.col(state).isin(*final), F.struct(*order, F.col(state).alias("_state"))))
    found = rows.groupBy(*key).agg(F.min("_end").alias("_end"), F.max(F.col(state).isin(*start).cast("int")).alias("_started"), F.count(F.lit(1)).alias("events"))
    return found.select(*key, F.coalesce(F.col("_end._state"), F.when(F.col("_started") == 1, "running").otherwise("queued")).alias("state"), "events")


def silent(beats: DataFrame, device: str, at: str, now: Column, seconds: int = LOST_SECONDS) -> DataFrame:
    """Devices whose last sign is more than so many seconds ago (exactly so many is in time)."""
    gap = now.cast("double") - F.max(F.col(at).cast("double"))
    return beats.groupBy(device).agg(gap.alias("gap")).filter(F.col("gap") > seconds)


def gaps(beats: DataFrame, device: str, order: list[str], at: Column, seconds: float) -> DataFrame:
    """Times a device was silent for more than so many seconds: the beat before, and how long."""
    w = Window.partitionBy(device).orderBy(*order)
    rows = beats.withColumn("_at", at).withColumn("gap", F.lead("_at").over(w) - F.col("_at"))
    return rows.filter(F.col("gap") > seconds).drop("_at")


def used_once(tokens: DataFrame, uses: DataFrame, key: list[str], issued: str, used: str, order: str, seconds: int) -> DataFrame:
    """Uses that count: the first of each token, and only within its life."""
    live = uses.join(tokens, key).filter((F.col(used) >= F.col(issued)) & (F.col(used) - F.col(issued) <= seconds))
    first = F.row_number().over(Window.partitionBy(*key).orderBy(used, order))
    return live.withColumn("_n", first).filter("_n = 1").drop("_n")


def within_budget(rows: DataFrame, key: list[str], order: list[str], size: Column, most_rows: int, most_size: int) -> DataFrame:
    """Newest rows of each key until the first that would pass the row or size limit."""
    w = Window.partitionBy(*key).orderBy(*[F.desc(c) for c in order])
    counted = rows.withColumns({"_row": F.row_number().over(w), "_sum": F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0))})
    return counted.filter((F.col("_row") <= most_rows) & (F.col("_sum") <= most_size)).drop("_row", "_sum")


def transcript_page(rows: DataFrame, key: list[str], order: list[str], before: Column, limit: int, pending: Column) -> DataFrame:
    """The page of at most ``limit`` rows before a position; only the newest pending row of all can be acted on."""
    w = Window.partitionBy(*key).orderBy(*order)
    numbered = rows.withColumn("pos", F.row_number().over(w).cast("long") - 1)
    newest = F.max(F.when(pending, F.col("pos"))).over(Window.partitionBy(*key))
    count = F.count(F.lit(1)).over(Window.partitionBy(*key))
    stop = F.least(count, F.coalesce(before, count))
    marked = numbered.withColumns({"_stop": stop, "actionable": F.coalesce(pending & (F.col("pos") == newest), F.lit(False))})
    return marked.filter((F.col("pos") < F.col("_stop")) & (F.col("pos") >= F.col("_stop") - limit)).drop("_stop")


def overridden(seed: DataFrame, live: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Seed rows overridden by live rows of the same key; live rows without a seed are added."""
    a, b = seed.alias("a"), live.alias("b")
    joined = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer")
    return joined.select(F.coalesce(f"b.{key}", f"a.{key}").alias(key), *[F.coalesce(f"b.{c}", f"a.{c}").alias(c) for c in columns])


def key_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys that only one side has."""
    left, right = a.select(key).distinct(), b.select(key).distinct()
    missing = left.join(right, key, "left_anti").withColumn("side", F.lit("left"))
    return missing.unionByName(right.join(left, key, "left_anti").withColumn("side", F.lit("right")))


def group_edits(edits: DataFrame, members: DataFrame) -> DataFrame:
    """Edits (edit, element, kind, value) on a member of a group (group, element, rank, start) as edits of its members.

    Text goes to the group's first member, colour to all, timing to all, later by as much as a
    member starts after the edited one.  An edit of an element without a group stays as it is.
    """
    mine = members.select("element", F.col("group").alias("_group"), F.col("start").alias("_start"))
    others = members.select(F.col("group").alias("_group"), F.col("element").alias("_member"), F.col("rank").alias("_rank"), F.col("start").alias("_begin"))
    grouped = edits.join(mine, "element", "left").join(others, "_group", "left")
    first = F.min("_rank").over(Window.partitionBy("edit"))
    kept = grouped.withColumn("_first", first).filter(F.col("_group").isNull() | (F.col("kind") != "text") | (F.col("_rank") == F.col("_first")))
    value = F.when(F.col("_group").isNotNull() & (F.col("kind") == "timing"), F.col("value") + F.col("_begin") - F.col("_start")).otherwise(F.col("value"))
    return kept.select("edit", F.coalesce("_member", "element").alias("element"), "kind", value.alias("value"))


def clock(rows: DataFrame, at: str) -> DataFrame:
    """The last time of all rows as one row, now."""
    return rows.agg(F.max(at).alias("now"))


def connected(beats: DataFrame, device: str, at: str, now: DataFrame, seconds: float = CONNECTED_SECONDS) -> DataFrame:
    """Whether each device gave a sign within so many seconds before now (one row)."""
    seen = beats.groupBy(device).agg(F.max(at).alias("_seen"))
    return seen.crossJoin(F.broadcast(now)).select(device, (F.col("now") - F.col("_seen") <= seconds).alias("connected"))


def live_codes(codes: DataFrame, owner: str, at: str, ident: str, now: DataFrame, seconds: float, most: int) -> DataFrame:
    """Codes not older than so many seconds before now (one row), the newest ``most`` of each owner."""
    live = codes.crossJoin(F.broadcast(now)).filter(F.col("now") - F.col(at) <= seconds)
    newest = F.row_number().over(Window.partitionBy(owner).orderBy(F.desc(at), F.desc(ident)))
    return live.withColumn("_n", newest).filter(F.col("_n") <= most).drop("_n", "now")


def superseded(jobs: DataFrame, target: list[str], order: list[str], name: str = "state") -> DataFrame:
    """Jobs with their state: only the newest of a target stays queued."""
    newest = F.row_number().over(Window.partitionBy(*target).orderBy(*[F.desc(c) for c in order]))
    return jobs.withColumn(name, F.when(newest == 1, "queued").otherwise("superseded"))


def next_jobs(jobs: DataFrame, before: DataFrame, busy: DataFrame, device: str, job: str, done: str) -> DataFrame:
    """Each free device's first job whose needed job (job, state), if there is one, is done."""
    ready = jobs.join(before.select(job, F.col("state").alias("_before")), job, "left").filter(F.col("_before").isNull() | (F.col("_before") == done))
    first = F.row_number().over(Window.partitionBy(device).orderBy(job))
    return ready.join(busy.select(device).distinct(), device, "left_anti").withColumn("_n", first).filter("_n = 1").select(device, job)


def quota_percent(used: Column, limit: Column) -> Column:
    """Percent of a limit that is used, at most 100; all of a limit of 0."""
    return F.when(limit != 0, F.least(F.lit(100), F.round(100 * used / F.nullif(limit, F.lit(0))))).otherwise(F.lit(100)).cast("long")


def state_counts(rows: DataFrame, by: list[str], state: str, names: dict[str, str]) -> DataFrame:
    """How many rows are in each state {state: column}, in one pass."""
    return rows.groupBy(*by).agg(*[F.count_if(F.col(state) == value).alias(name) for value, name in names.items()])


def remaining(used: Column, most: int) -> Column:
    """What is left of a budget, never below 0."""
    return F.greatest(F.lit(0), most - used)


def clipped(frame: Column, first: int, last: int) -> Column:
    return F.greatest(F.lit(first), F.least(frame, F.lit(last)))


def seconds_left(stage: Column, seconds: dict[str, int]) -> Column:
    """Seconds from a stage on by a table; 0 for a stage that it lacks."""
    table = F.create_map(*[F.lit(x) for pair in seconds.items() for x in pair])
    return F.coalesce(F.try_element_at(table, stage), F.lit(0))
