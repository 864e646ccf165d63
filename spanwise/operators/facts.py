"""Facts between motions and boxes: relations in time and space, predicates as text, keep flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.geometry import spatial_relations
from .checkpoints import shuffled
from .match import nearest_earlier

# Tolerances of predicates.
PIXELS, COSINE, MAG_SHARE, MAG_LEAST, DURATION = 2.0, 0.9, 0.1, 2.0, 2

# Predicates of two motions, and of two boxes.
TIME, SPACE = ("before", "after", "while"), ("left", "right", "top", "bottom", "intersect")

# Which predicate heads each preset keeps.
PRESETS = {
    "content_only": ("type", "dir", "mag", "dur", "before", "after", "while"),
    "motion_shape": ("type", "dir", "before", "after"),
    "all": ("type", "dir", "mag", "dur", "before", "after", "while", "left", "right", "top", "bottom", "intersect"),
    "none": (),
}


def temporal_relations(s1: Column, e1: Column, s2: Column, e2: Column) -> dict[str, Column]:
    """before and after may touch; while needs one shared unit at least."""
    return {"before": e1 <= s2, "after": e2 <= s1, "while": F.least(e1, e2) - F.greatest(s1, s2) >= 1}


def parsed(predicates: DataFrame, column: str = "pred") -> DataFrame:
    """Split ``name(args)@frame`` into name, args (brackets kept together) and frame."""
    inner = F.regexp_extract(column, r"^\s*\w+\((.*)\)\s*(?:@\s*\d+)?\s*$", 1)
    frame = F.regexp_extract(column, r"@\s*(\d+)\s*$", 1)
    return predicates.withColumns({
        "name": F.regexp_extract(column, r"^\s*(\w+)\(", 1),
        "args": F.transform(F.regexp_extract_all(inner, F.lit(r"(\[[^\]]*\]|'[^']*'|[^,\s][^,]*)"), F.lit(1)), lambda a: F.trim(F.regexp_replace(a, "^'|'$", ""))),
        "frame": F.when(frame != "", frame.cast("int")),
    })


def evaluated(predicates: DataFrame, motions: DataFrame, boxes: DataFrame, last_frame: int, strict: bool = True) -> DataFrame:
    """Truth of parsed predicates about motions (id, type, start, end, dx, dy, mag, dur) and boxes (id, frame, x0..y1).

    A predicate is joined only with what it speaks of: one motion, two motions or two boxes.  One
    about something unknown is false.  An unknown name (as bad syntax gives) is an error, or null where not strict.
    """
    args = F.col("args")
    rows = predicates.withColumns({"_a": F.element_at(args, 1), "_b": F.try_element_at(args, F.lit(2))})
    known = lambda *names: F.coalesce(F.col("name").isin(*names), F.lit(False))

    # of motions: one that a predicate names
    own = rows.filter(~known(*TIME, *SPACE)).join(shuffled(motions.select(F.col("id").alias("_a"), *[F.col(c).alias(f"_{c}") for c in ("type", "dx", "dy", "mag", "dur")])), "_a", "left")
    wanted = F.transform(F.split(F.regexp_replace("_b", r"[\[\]\s]", ""), ","), lambda v: v.try_cast("double"))
    wx, wy = F.try_element_at(wanted, F.lit(1)), F.try_element_at(wanted, F.lit(2))
    along = F.try_divide(F.col("_dx") * wx + F.col("_dy") * wy, F.sqrt(wx * wx + wy * wy))
    number = F.col("_b").try_cast("double")
    truth = F.when(F.col("name") == "type", F.col("_type") == F.col("_b"))
    truth = truth.when(F.col("name") == "dir", along >= COSINE)
    truth = truth.when(F.col("name") == "mag", F.abs(F.col("_mag") - number) <= F.greatest(MAG_SHARE * F.abs(number), F.lit(MAG_LEAST)))
    truth = truth.when(F.col("name") == "dur", F.abs(F.col("_dur") - number) <= DURATION)
    other = F.raise_error(F.concat(F.lit("unknown predicate: "), F.coalesce("name", F.lit("")))).cast("boolean") if strict else F.lit(None).cast("boolean")
    out = own.withColumn("holds", F.when(known("type", "dir", "mag", "dur"), F.coalesce(truth, F.lit(False))).otherwise(other)).select(*predicates.columns, "holds")

    def of_two(part: DataFrame, found: DataFrame, by: list[str], truths: dict[str, Column]) -> DataFrame:
        """Predicates of two things by their keys (the second's are named with a 2)."""
        for side, end in (("_a", ""), ("_b", "2")):
            part = part.join(shuffled(found.select(F.col("id").alias(side), *by, *[F.col(c).alias(c + end) for c in found.columns if c not in ("id", *by)])), [side, *by], "left")
        truth = F.lit(None).cast("boolean")
        for name, value in truths.items():
            truth = F.when(F.col("name") == name, value).otherwise(truth)
        return part.withColumn("holds", F.coalesce(truth, F.lit(False))).select(*predicates.columns, "holds")

    spans = motions.select("id", F.col("start").alias("_start"), F.col("end").alias("_end"))
    out = out.unionByName(of_two(rows.filter(known(*TIME)), spans, [], temporal_relations(F.col("_start"), F.col("_end"), F.col("_start2"), F.col("_end2"))))
    shown = boxes.select("id", F.col("frame").alias("_frame"), F.struct("x0", "y0", "x1", "y1").alias("_box"))
    placed = rows.filter(known(*SPACE)).withColumn("_frame", F.coalesce("frame", F.lit(last_frame)))
    return out.unionByName(of_two(placed, shown, ["_frame"], spatial_relations(F.col("_box"), F.col("_box2"), PIXELS)))


def earliest_later(motions: DataFrame, scene: list[str]) -> DataFrame:
    """``before`` facts: each motion with the motions of other elements that start first after its end.

    No motion meets all later ones: it takes the next start after its end, or, where only its
    own element starts there, the next start of the scene at which another one does.
    """
    starts = motions.groupBy(*scene, "start").agg(F.min("element").alias("_one"), F.max("element").alias("_most"))
    starts = starts.select(*scene, F.col("start").alias("_start"), F.when(F.col("_one") == F.col("_most"), F.col("_one")).alias("_only"))
    backwards = Window.partitionBy(*scene).orderBy(F.desc("_start"))
    fresh = F.coalesce(F.lag("_only").over(Window.partitionBy(*scene).orderBy("_start")) != F.col("_only"), F.lit(True))
    starts = starts.withColumn("_fresh", F.when(fresh, F.col("_start"))).withColumn("_other", F.last("_fresh", ignorenulls=True).over(backwards.rowsBetween(Window.unboundedPreceding, -1)))
    starts = starts.withColumn("_back", -F.col("_start")).select(*scene, "_back", "_start", "_only", "_other")
    asked = motions.select(*scene, "id", "element", (-F.col("end")).alias("_end"))
    found = nearest_earlier(asked, starts, scene, "_end", "_back", "id", ["_start"])
    found = found.select(*scene, "id", "element", F.when(F.col("_only") == F.col("element"), F.col("_other")).otherwise(F.col("_start")).alias("start"))
    later = motions.select(*scene, "start", F.col("id").alias("later"), F.col("element").alias("_element"))
    return found.join(later, [*scene, "start"]).filter(F.col("_element") != F.col("element")).select(*scene, "id", "later")


def with_preset(constraints: DataFrame, preset: str, column: str = "pred") -> DataFrame:
    """Set keep by the predicate's head."""
    if preset not in PRESETS:
        raise ValueError(f"unknown keep preset {preset!r}")
    return constraints.withColumn("keep", F.trim(F.substring_index(column, "(", 1)).isin(*PRESETS[preset]))


def carried(constraints: DataFrame, previous: DataFrame, key: list[str], flag: str = "keep") -> DataFrame:
    """Carry the previous flag where the key still exists."""
    old = previous.select(*key, F.col(flag).alias("_old"))
    return constraints.join(old, key, "left").withColumn(flag, F.coalesce("_old", flag)).drop("_old")


def most_salient(elements: DataFrame, scene: list[str], is_text: Column, area: Column, start: str, end: str, ident: str, most: int) -> DataFrame:
    """The first ``most`` elements of a scene: text first, then area times duration, start, id."""
    order = Window.partitionBy(*scene).orderBy(F.desc(is_text.cast("int")), F.desc(area * (F.col(end) - F.col(start) + 1)), start, ident) if scene else Window.orderBy(F.desc(is_text.cast("int")), F.desc(area * (F.col(end) - F.col(start) + 1)), start, ident)
    return elements.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= most)


def extracted(motions: DataFrame, boxes: DataFrame, salient: DataFrame, scene: str) -> DataFrame:
    """All facts of a scene as predicates: of every motion its kind, direction, size and length, and between salient elements order and place.

    motions has (scene, id, element, type, start, end, dir_x, dir_y, mag, dur), boxes the last
    frame's visible (scene, id, box), salient (scene, element), a bounded number in a scene.
    """
    fixed = lambda c, n: F.format_string(f"%.{n}f", F.col(c).cast("double"))
    way = F.when((F.col("type") == "translation") & F.col("dir_x").isNotNull(), F.concat(F.lit("dir("), "id", F.lit(",["), fixed("dir_x", 2), F.lit(","), fixed("dir_y", 2), F.lit("])")))
    own = F.array(F.concat(F.lit("type("), "id", F.lit(",'"), "type", F.lit("')")), way, F.concat(F.lit("mag("), "id", F.lit(","), fixed("mag", 1), F.lit(")")), F.concat(F.lit("dur("), "id", F.lit(","), F.col("dur").cast("string"), F.lit(")")))
    single = motions.select(scene, F.explode(own).alias("pred")).filter("pred is not null")
    # all meet by the scene alone, so rows are dealt once
    chosen = shuffled(salient.groupBy(scene).agg(F.collect_set("element").alias("_chosen")))
    key = motions.select(scene, "id", "element", "start", "end").join(chosen, scene).filter(F.array_contains("_chosen", F.col("element"))).drop("_chosen")
    named = lambda name, a, b: F.concat(F.lit(f"{name}("), a, F.lit(","), b, F.lit(")"))
    before = earliest_later(key, [scene]).select(scene, named("before", F.col("id"), F.col("later")).alias("pred"))
    other = key.select(scene, *[F.col(c).alias(f"_{c}") for c in ("id", "element", "start", "end")])
    together = key.join(shuffled(other), scene).filter((F.col("id") < F.col("_id")) & (F.col("element") != F.col("_element")))
    overlap = temporal_relations(F.col("start"), F.col("end"), F.col("_start"), F.col("_end"))["while"]
    during = together.filter(overlap).select(scene, named("while", F.col("id"), F.col("_id")).alias("pred"))
    seen = boxes.select(scene, "id", "box").join(chosen, scene).filter(F.array_contains("_chosen", F.col("id"))).drop("_chosen")
    pairs = seen.join(shuffled(seen.select(scene, F.col("id").alias("_id"), F.col("box").alias("_box"))), scene).filter(F.col("id") < F.col("_id"))
    held = F.array(*[F.when(v, named(n, F.col("id"), F.col("_id"))) for n, v in spatial_relations(F.col("box"), F.col("_box"), PIXELS).items()])
    placed = pairs.select(scene, F.explode(held).alias("pred")).filter("pred is not null")
    return single.unionByName(before).unionByName(during).unionByName(placed)


def motion_questions(motions: DataFrame, scene: str) -> DataFrame:
    """Question rows with typed answers and tolerances about each motion: kind, start, length, and size."""
    rows = F.array(*[
        F.struct(F.lit(kind).alias("about"), F.lit(answer).alias("answer_type"), value.cast("string").alias("answer"), F.lit(slack).cast("double").alias("tolerance"))
        for kind, answer, value, slack in (("type", "choice", F.col("type"), 0), ("start", "number", F.col("start"), DURATION), ("dur", "number", F.col("dur"), DURATION), ("mag", "number", F.round("mag", 1), MAG_LEAST))
    ])
    return motions.select(scene, "id", F.explode(rows).alias("_q")).select(scene, "id", "_q.*")
