"""Operators over tracks and elements: which are kept, what holds them, how well two sets agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.geometry import box_area, box_overlap, iou
from ..functions.text import compact, word_prefix
from .checkpoints import ensure_checkpoint_dir, shuffled
from .graph import components
from .match import band_join
from .reads import best_read


def modal(rows: DataFrame, entity: list[str], value: str, order: str) -> DataFrame:
    """Most frequent value per entity (the first seen of equals), how often, and the row count."""
    counts = rows.groupBy(*entity, value).agg(F.count(F.lit(1)).alias("_n"), F.min(order).alias("_seen"))
    return counts.groupBy(*entity).agg(F.max_by(value, F.struct("_n", -F.col("_seen"))).alias("mode"), F.max("_n").alias("n"), F.sum("_n").alias("rows"))


def kept_texts(rows: DataFrame, entity: list[str], text: str, order: str, confidence: str, least_rows: int = 3, sure: float = 0.9) -> DataFrame:
    """Entities with enough rows and two letters or digits in their modal text, or one with high mean confidence."""
    letters = F.length(F.regexp_replace("mode", r"[^\p{L}\p{N}]", ""))
    found = modal(rows, entity, text, order).join(rows.groupBy(*entity).agg(F.avg(confidence).alias("confidence")), entity)
    return found.withColumn("kept", (F.col("rows") >= least_rows) & ((letters >= 2) | ((letters == 1) & (F.col("confidence") >= sure))))


def claims(pairs: DataFrame, owner: str, item: str, hit: Column, share: float) -> DataFrame:
    """(owner, item) where at least a share of the pair's rows hit; an item goes to its first owner only."""
    shares = pairs.groupBy(owner, item).agg(F.avg(hit.cast("double")).alias("share")).filter(F.col("share") >= share)
    first = F.row_number().over(Window.partitionBy(item).orderBy(owner))
    return shares.withColumn("_n", first).filter("_n = 1").drop("_n")


def smallest_holder(items: DataFrame, holders: DataFrame, keys: list[str], item: str, holder: str, inside: float = 0.6) -> DataFrame:
    """The smallest holder box that holds at least a share of each item's box, among equal keys (a frame)."""
    pairs = items.withColumnRenamed("box", "_item").join(holders.withColumnRenamed("box", "_holder"), keys)
    area = box_area(F.col("_item"))
    held = pairs.filter((area > 0) & (box_overlap(F.col("_item"), F.col("_holder")) >= inside * area))
    rank = F.row_number().over(Window.partitionBy(*keys, item).orderBy(box_area(F.col("_holder")), holder))
    return held.withColumn("_n", rank).filter("_n = 1").select(*keys, item, holder)


def successions(spans: DataFrame, keys: list[str], ident: str, gap: int, least: float) -> DataFrame:
    """Groups of elements that follow one another in one place: each starts 0 to gap after another's end with overlapping boxes."""
    later = spans.select(*keys, F.col(ident).alias("_next"), F.col("first").alias("_first"), F.col("box").alias("_box"))
    pairs = band_join(spans, later, keys, "last", "_first", 0, gap).filter(F.col(ident) != F.col("_next"))
    return components(pairs.filter(iou(F.col("box"), F.col("_box")) >= least), ident, "_next")


def reveals(tracks: DataFrame, keys: list[str], ident: str, text: str, gap: int) -> DataFrame:
    """Chains of tracks whose text grows: a proper prefix that ends at most gap before the longer one starts."""
    later = tracks.select(*keys, F.col(ident).alias("_next"), F.col("first").alias("_first"), compact(F.col(text)).alias("_text"))
    pairs = band_join(tracks.withColumn("_short", compact(F.col(text))), later, keys, "last", "_first", 0, gap)
    grows = F.startswith("_text", "_short") & (F.length("_text") > F.length("_short")) & (F.length("_short") > 0)
    return components(pairs.filter(grows), ident, "_next")


def best_of_both(scores: DataFrame, left: str, right: str, score: str) -> DataFrame:
    """Mean over both sides of each one's best score with the other side, between 0 and 1."""
    one = scores.groupBy(left).agg(F.max(score).alias("_s")).agg(F.avg("_s").alias("a"))
    other = scores.groupBy(right).agg(F.max(score).alias("_s")).agg(F.avg("_s").alias("b"))
    return one.crossJoin(other).select(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("a") + F.col("b")) / 2)).alias("similarity"))  # one row each


def verified(expected: DataFrame, probed: DataFrame, keys: list[str], tolerance: float) -> DataFrame:
    """Largest box error over expected rows, how many lack a probe, and whether all is within tolerance and complete."""
    joined = expected.withColumnRenamed("box", "_want").join(probed.withColumnRenamed("box", "_got"), keys, "left")
    error = F.greatest(*[F.abs(F.col(f"_want.{c}") - F.col(f"_got.{c}")) for c in ("x0", "y0", "x1", "y1")])
    sums = joined.agg(F.max(error).alias("error"), F.sum(F.col("_got").isNull().cast("long")).alias("missing"), F.count(F.lit(1)).alias("expected"))
    return sums.withColumn("passed", F.coalesce((F.col("error") <= tolerance) & (F.col("missing") == 0), F.lit(False)))


def regions(cells: DataFrame, scene: list[str], x: str, y: str, label: str, least: int) -> DataFrame:
    """Connected regions of one label on a grid (eight neighbours): smallest cell, area, box and centre.

    Each cell links to the four neighbours after it, by equi-joins on their places.
    """
    key = F.struct(*[F.col(c) for c in scene], F.col(y).cast("long").alias("y"), F.col(x).cast("long").alias("x"))
    nodes = cells.select(*scene, F.col(x).cast("long").alias("x"), F.col(y).cast("long").alias("y"), F.col(label).alias("label"), key.alias("cell"))
    steps = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in ((1, 0), (-1, 1), (0, 1), (1, 1))])).alias("_step")
    reach = nodes.select(*scene, "label", "x", "y", F.col("cell").alias("a"), steps).select(*scene, "label", "a", (F.col("x") + F.col("_step.dx")).alias("x"), (F.col("y") + F.col("_step.dy")).alias("y"))
    links = reach.join(shuffled(nodes.select(*scene, "label", "x", "y", F.col("cell").alias("b"))), [*scene, "label", "x", "y"]).select("a", "b")
    joined = nodes.join(shuffled(components(links, "a", "b")), F.col("cell") == F.col("node"), "left").withColumn("region", F.coalesce("component", "cell"))
    found = joined.groupBy("region", "label").agg(F.count(F.lit(1)).alias("area"), F.min("x").alias("x0"), F.min("y").alias("y0"), (F.max("x") + 1).alias("x1"), (F.max("y") + 1).alias("y1"), F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    return found.filter(F.col("area") >= least)


def relaxed_top(rows: DataFrame, by: list[str], filters: list[Column], score: Column, ties: list[str], most: int) -> DataFrame:
    """The best rows that pass all filters; where none does, the last filters are dropped one by one until some do."""
    level = F.lit(len(filters))
    for i in range(len(filters) - 1, -1, -1):  # how many of the filters, from the first, a row passes
        level = F.when(~F.coalesce(filters[i], F.lit(False)), i).otherwise(level)
    ranked = rows.withColumn("level", level).withColumn("_best", F.max("level").over(Window.partitionBy(*by)))
    order = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), *ties))
    return ranked.filter(F.col("level") == F.col("_best")).withColumn("rank", order.cast("long")).filter(F.col("rank") <= most).drop("_best")


def largest_window(costs: DataFrame, order: str, cost: str, budget: float) -> int:
    """Length of the longest window whose cost never passes the budget anywhere (0 if none), by halving.

    Costs are summed per position on the cluster; each step of the search is one aggregate
    over rolling differences of the running sum, found by an equi-join on the position.
    """
    count = costs.count()
    by_block = costs.withColumn("_block", F.floor(F.col(order) / 4096)).groupBy("_block").agg(F.sum(cost).alias("_sum"))
    before = by_block.select("_block", (F.sum("_sum").over(Window.orderBy("_block")) - F.col("_sum")).alias("_before"))
    inner = F.sum(cost).over(Window.partitionBy("_block").orderBy(order))
    running = costs.withColumn("_block", F.floor(F.col(order) / 4096)).withColumn("_run", inner).join(before, "_block").select(F.col(order).alias("_at"), (F.col("_run") + F.col("_before")).alias("_total"))
    ensure_checkpoint_dir(costs.sparkSession)
    running = running.unionByName(costs.sparkSession.createDataFrame([(-1, 0.0)], "_at long, _total double")).checkpoint()
    low, high = 0, count
    while low < high:
        size = (low + high + 1) // 2
        earlier = running.select((F.col("_at") + size).alias("_at"), F.col("_total").alias("_then"))
        worst = running.join(earlier, "_at").agg(F.max(F.col("_total") - F.col("_then"))).first()[0]
        low, high = (size, high) if worst is not None and worst <= budget else (low, size - 1)
    return low


def split_swaps(reads: DataFrame, track: str, frame: str, text: str, full: str, seen: int, held: int) -> DataFrame:
    """Reads with the piece of their track they belong to: 1 from where only first words are left of the text, else 0.

    A track splits where its whole text was read in at least ``seen`` frames and, after the
    last of these, only its first words in at least ``held`` frames.
    """
    order = Window.partitionBy(track)
    whole = F.when(compact(F.col(text)) == compact(F.col(full)), F.col(frame))
    rows = reads.withColumns({"_last": F.max(whole).over(order), "_seen": F.count(whole).over(order)})
    short = F.when((F.col(frame) > F.col("_last")) & word_prefix(F.col(text), F.col(full)), F.col(frame))
    rows = rows.withColumns({"_first": F.min(short).over(order), "_held": F.count(short).over(order)})
    splits = (F.col("_seen") >= seen) & (F.col("_held") >= held)
    return rows.withColumn("piece", F.coalesce(splits & (F.col(frame) >= F.col("_first")), F.lit(False)).cast("int")).drop("_last", "_seen", "_first", "_held")


def piece_texts(split: DataFrame, track: str, frame: str, text: str, full: str) -> DataFrame:
    """(track, piece, text): the first piece keeps the track's text, what remains gets the best of its own reads."""
    first = split.filter("piece = 0").groupBy(track).agg(F.first(full).alias("text")).select(track, F.lit(0).alias("piece"), "text")
    rest = best_read(split.filter("piece = 1"), [track], frame, text).select(track, F.lit(1).alias("piece"), F.col("read").alias("text"))
    return first.unionByName(rest)


def joined_members(rows: DataFrame, group: list[str], member: str, order: str) -> DataFrame:
    """A group's members as one line in order of their first row, and its row count."""
    members = rows.groupBy(*group, member).agg(F.count(F.lit(1)).alias("_n"), F.min(order).alias("_seen"))
    line = F.transform(F.array_sort(F.collect_list(F.struct("_seen", member))), lambda m: m[member])
    return members.groupBy(*group).agg(F.array_join(line, " ").alias("line"), F.sum("_n").alias("n"))


def overlay(parts: dict[str, DataFrame], every: DataFrame, keys: list[str], ident: str) -> DataFrame:
    """Per key, what each named table holds there as ``name:id`` in order, how many, and whether any does."""
    union = None
    for name, part in parts.items():
        rows = part.select(*keys, F.lit(name).alias("_source"), F.col(ident).alias("_id"))
        union = rows if union is None else union.unionByName(rows)
    objects = F.transform(F.array_sort(F.collect_list(F.struct("_source", "_id"))), lambda o: F.concat(o["_source"], F.lit(":"), o["_id"].cast("string")))
    found = union.groupBy(*keys).agg(F.array_join(objects, ",").alias("objects"), F.count(F.lit(1)).alias("_n"))
    return every.select(*keys).distinct().join(found, keys, "left").select(*keys, "objects", F.coalesce("_n", F.lit(0)).alias("n"), F.col("_n").isNotNull().alias("available"))
