"""Titles from fragments: which pieces of a scene are one title, and what of them is merged or bound."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from ..functions.geometry import box_area, overlap
from ..functions.text import best_window, window_ratio
from .checkpoints import Rounds
from .graph import components
from .grid import FEW, grid_join
from .match import whole_entities
from .reads import digits_agree

# Height ratio, row offset and gap in line heights, colour distance, onset (s), motion (px a frame), succession (s),
# text ratio, a glyph's height and width in line heights, turn (degrees), containment, concurrence, step (s).
LINE_RATIO, LINE_DY, GAP_H, COLOUR, ONSET_S, MOTION, SUCCESSION_S = 1.6, 0.5, 1.2, 20.0, 1.0, 2.0, 0.5
SUBSTRING, GLYPH, TURN, CONTAIN, CONCURRENT, STEP_S = 0.8, (1.6, 2.5), 5.0, 0.5, 0.5, 0.1
BOX = ("x0", "y0", "x1", "y1")


def median_of(values: Column) -> Column:
    """The median of an array without nulls: the mean of the two middle values where their number is even."""
    ordered, n = F.array_sort(values), F.size(values)
    return (F.get(ordered, F.floor((n - 1) / 2).cast("int")) + F.get(ordered, F.floor(n / 2).cast("int"))) / 2


def _box(prefix: str = "") -> Column:
    return F.struct(*[F.col(prefix + c).alias(c) for c in BOX])


def described(fragments: DataFrame, boxes: DataFrame, scene: list[str]) -> DataFrame:
    """Fragments (scene, id, text, h, rot, l, a, b, cut) with span, median place and size, and first and last box."""
    if "boxes" in boxes.columns:  # an array of (frame, x0, y0, x1, y1) a piece
        at = boxes.select(*scene, "id", F.array_sort("boxes").alias("boxes"))
        mid = {"cy": lambda b: (b["y0"] + b["y1"]) / 2, "w": lambda b: b["x1"] - b["x0"], "bh": lambda b: b["y1"] - b["y0"]}
        ends = [F.struct(*[F.element_at("boxes", i)[c].alias(c) for c in BOX]).alias(n) for i, n in ((1, "first_box"), (-1, "last_box"))]
        frames = [F.element_at("boxes", i)["frame"].alias(n) for i, n in ((1, "first"), (-1, "last"))]
        sizes = at.filter(F.size("boxes") > 0).select("*", *frames, F.size("boxes").cast("long").alias("n"), *[median_of(F.transform("boxes", f)).alias(n) for n, f in mid.items()], *ends)
        return fragments.join(sizes, [*scene, "id"]).withColumn("logh", F.log("h"))
    sizes = boxes.groupBy(*scene, "id").agg(
        F.min("frame").alias("first"), F.max("frame").alias("last"), F.count(F.lit(1)).alias("n"), F.median((F.col("y0") + F.col("y1")) / 2).alias("cy"),
        F.median(F.col("x1") - F.col("x0")).alias("w"), F.median(F.col("y1") - F.col("y0")).alias("bh"), F.min_by(_box(), "frame").alias("first_box"), F.max_by(_box(), "frame").alias("last_box"),
    )
    return fragments.join(sizes, [*scene, "id"]).withColumn("logh", F.log("h"))


def _speed(n: Column, k: Column, anchor: tuple[str, str]) -> Column:
    """Median difference of the two sides' velocities over k common frames, the anchor the mean of two edges."""

    def apart(c: Column) -> tuple[Column, Column]:
        across = (c[f"p_{anchor[0]}"] + c[f"p_{anchor[1]}"] - c[f"q_{anchor[0]}"] - c[f"q_{anchor[1]}"]) / 2
        return across, (c["p_y0"] + c["p_y1"] - c["q_y0"] - c["q_y1"]) / 2

    def step(i: Column) -> Column:
        now, before = apart(F.get("_both", i.cast("int"))), apart(F.get("_both", (i - k).cast("int")))
        return F.hypot((now[0] - before[0]) / k, (now[1] - before[1]) / k)

    return F.when(n > 1, median_of(F.transform(F.sequence(k, n - 1), step))).otherwise(0.0)


def candidates(pieces: DataFrame, scene: list[str]) -> DataFrame:
    """Pairs p < q of described pieces that height, turn, colour and cuts allow to be one title, from a grid over several of these at once."""
    left, right = (pieces.select(*scene, *[F.col(c).alias(f"{side}_{c}") for c in pieces.columns if c not in scene]) for side in "pq")
    near = grid_join(left, right, scene, [("p_logh", "q_logh", math.log(LINE_RATIO) + 1e-9), ("p_rot", "q_rot", TURN), ("p_l", "q_l", COLOUR)]).filter("p_id < q_id")
    colour = F.sqrt(sum(((F.col(f"p_{c}") - F.col(f"q_{c}")) ** 2 for c in "lab"), F.lit(0.0)))
    tall, low = F.greatest("p_h", "q_h"), F.least("p_h", "q_h")
    texts = (F.coalesce(F.col("p_text"), F.lit("")) != "").cast("int") + (F.coalesce(F.col("q_text"), F.lit("")) != "").cast("int")
    cut = F.coalesce(F.col("p_cut") == F.col("q_cut"), F.lit(False))
    return near.filter((tall <= LINE_RATIO * low) & (colour <= COLOUR) & ~cut & (texts > 0)).withColumns({"_h": tall, "texts": texts})


def in_common(p: Column, q: Column) -> Column:
    """The boxes of both in common frames, in order, from each one's array of (frame, box); null where there are none."""
    of = lambda c, side: [c[n].alias(f"{side}_{n}") for n in BOX]
    both = F.flatten(F.transform(p, lambda b: F.transform(F.filter(q, lambda c: c["frame"] == b["frame"]), lambda c: F.struct(b["frame"].alias("frame"), *of(b, "p"), *of(c, "q")))))
    return F.when(F.size(both) > 0, both)


def same_title(near: DataFrame, boxes: DataFrame | None, scene: list[str], fps: float, steps: bool = True, lines: DataFrame | None = None) -> DataFrame:
    """(scene, p, q, texts): the candidate pairs that are of one title, and how many of the two have a text (1 or 2).

    Two pieces are one title side by side (concurrent, near, moving together: over ``STEP_S`` by
    any edge, or by frame and centre where ``steps`` is False) or in succession (the later one
    starts in the earlier one's last box and repeats part of its text).  A piece without text
    must be a glyph beside a text.  Without boxes, the pairs hold what both show (_both), as
    ``in_common`` gives it.  With lines (scene, line), both texts must be read in one of
    them, in scenes that have any.
    """
    # what both show in common frames, in order
    if boxes is not None:
        frames = [boxes.select(*scene, "frame", F.col("id").alias(f"{side}_id"), *[F.col(c).alias(f"{side}_{c}") for c in BOX]) for side in "pq"]
        common = near.select(*scene, "p_id", "q_id").join(frames[0], [*scene, "p_id"]).join(frames[1], [*scene, "q_id", "frame"])
        both = F.array_sort(F.collect_list(F.struct("frame", *[f"{side}_{c}" for side in "pq" for c in BOX])))
        near = near.join(common.groupBy(*scene, "p_id", "q_id").agg(both.alias("_both")), [*scene, "p_id", "q_id"], "left")
    n = F.coalesce(F.size("_both"), F.lit(0))
    n = F.when(F.col("_both").isNull(), 0).otherwise(n)
    middle = median_of(F.transform("_both", lambda c: F.abs(c["p_y0"] + c["p_y1"] - c["q_y0"] - c["q_y1"]) / 2))
    near = near.withColumn("_n", n).filter(F.when(F.col("_n") > 0, middle).otherwise(F.abs(F.col("p_cy") - F.col("q_cy"))) <= LINE_DY * F.col("_h"))
    for s, ref in (("p", "q"), ("q", "p")):  # a glyph, mostly concurrent with its text
        bare = F.coalesce(F.col(f"{s}_text"), F.lit("")) == ""
        glyph = (F.col(f"{s}_bh") <= GLYPH[0] * F.col(f"{ref}_h")) & (F.col(f"{s}_w") <= GLYPH[1] * F.col(f"{ref}_h")) & (F.col("_n") >= CONCURRENT * F.col(f"{s}_n"))
        near = near.filter(~bare | glyph)

    k = F.greatest(F.lit(1), F.least(F.lit(round(STEP_S * fps)), F.col("_n") - 1)) if steps else F.lit(1)
    anchors = (("x0", "x0"), ("x1", "x1"), ("x0", "x1")) if steps else (("x0", "x1"),)
    speeds = [_speed(F.col("_n"), k, a) for a in anchors]
    gap = median_of(F.transform("_both", lambda c: F.greatest(c["p_x0"], c["q_x0"]) - F.least(c["p_x1"], c["q_x1"])))
    together = (F.least(*speeds) if len(speeds) > 1 else speeds[0]) <= MOTION
    near = near.withColumn("_side", F.coalesce((F.col("_n") > 0) & (gap <= GAP_H * F.col("_h")) & (F.abs(F.col("p_first") - F.col("q_first")) / fps <= ONSET_S) & together, F.lit(False)))
    earlier = F.col("p_last") <= F.col("q_first")
    ended, began = F.when(earlier, F.col("p_last")).otherwise(F.col("q_last")), F.when(earlier, F.col("q_first")).otherwise(F.col("p_first"))
    e, l = F.when(earlier, F.col("p_last_box")).otherwise(F.col("q_last_box")), F.when(earlier, F.col("q_first_box")).otherwise(F.col("p_first_box"))  # noqa: E741
    shared, small = overlap(e["x0"], e["x1"], l["x0"], l["x1"]) * overlap(e["y0"], e["y1"], l["y0"], l["y1"]), F.least(box_area(e), box_area(l))
    place = (began >= ended) & ((began - ended) / fps <= SUCCESSION_S) & (small > 0) & (shared > 0) & (shared >= CONTAIN * small)
    near = near.filter(F.col("_side") | (place & (digits_agree(F.col("p_text"), F.col("q_text")) | digits_agree(F.col("q_text"), F.col("p_text")))))
    slim = near.select(*scene, F.col("p_id").alias("p"), F.col("q_id").alias("q"), "texts", "_side", F.col("p_text").alias("_pt"), F.col("q_text").alias("_qt"))
    beside, after = slim.filter("_side"), slim.filter("not _side")
    found = beside.unionByName(after.filter(best_window(F.col("_pt"), F.col("_qt")) >= SUBSTRING))
    if lines is not None:
        read = [(F.coalesce(F.col(t), F.lit("")) == "") | (best_window(F.coalesce(F.col(t), F.lit("")), F.col("line")) >= SUBSTRING) for t in ("_pt", "_qt")]
        told = lines.select(*scene).distinct()
        vouched = found.join(lines.select(*scene, "line"), scene).filter(read[0] & read[1]).select(*found.columns).distinct()
        found = vouched.unionByName(found.join(told, scene, "left_anti"))  # a scene without lines is not checked
    return found.select(*scene, "p", "q", "texts")


def grouped(pieces: DataFrame, links: DataFrame, scene: list[str]) -> DataFrame:
    """(scene, id, group): texts joined by links among texts; a piece without text joins the one group it fits, and none of several.

    A group is named after its smallest text.  Ids are unique across scenes.
    """
    groups = components(links.filter("texts = 2"), "p", "q").withColumnsRenamed({"node": "id", "component": "group"})
    whole = pieces.select(*scene, "id", (F.coalesce(F.col("text"), F.lit("")) != "").alias("_text")).join(groups, "id", "left").withColumn("group", F.coalesce("group", "id"))
    of_text = whole.filter("_text").select(F.col("id").alias("_at"), "group")
    one = links.filter("texts = 1").select(F.explode(F.array(F.struct(F.col("p").alias("id"), F.col("q").alias("_at")), F.struct(F.col("q").alias("id"), F.col("p").alias("_at")))).alias("_l")).select("_l.*")
    fits = one.join(of_text, "_at").groupBy("id").agg(F.min("group").alias("_group"), F.max("group").alias("_other")).filter(F.col("_group") == F.col("_other")).select("id", "_group")
    bare = whole.filter("not _text").join(fits, "id", "left").withColumn("group", F.coalesce("_group", "group")).drop("_group")
    return whole.filter("_text").unionByName(bare).select(*scene, "id", "group")


def _few(sizes: np.ndarray) -> Iterator[np.ndarray]:
    """Positions of equal sizes above 0, so that what belongs to them stacks to one matrix."""
    for n in np.unique(sizes[sizes > 0]).tolist():
        yield np.flatnonzero(sizes == n)


def _middle(values: np.ndarray) -> np.ndarray:
    """The median of each row: the mean of the two middle values where their number is even."""
    ordered, n = np.sort(values, axis=1), values.shape[1]
    return (ordered[:, (n - 1) // 2] + ordered[:, n // 2]) / 2


@lru_cache(maxsize=65536)
def _repeats(a: str, b: str) -> bool:
    """Whether one of two texts repeats part of the other, and its digits."""
    digits = [re.sub(r"[^0-9]", "", t) for t in (a, b)]
    return (digits[0] in digits[1] or digits[1] in digits[0]) and window_ratio(a, b) >= SUBSTRING


def _titles(pieces: dict[str, np.ndarray], texts: list[str], text: np.ndarray, frames: np.ndarray, corners: np.ndarray, sizes: np.ndarray, last: np.ndarray, fps: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """For the wide and the strict test of ``same_title``, which pieces are of one title: pairs of places.

    Pieces come by scene and id; last is where a piece's scene ends, corners are boxes by piece and frame.
    """
    every = np.arange(len(sizes))
    begin = np.concatenate([[0], sizes.cumsum()])[:-1]
    cy, w, bh = np.zeros((3, len(sizes)))
    for at in _few(sizes):
        x0, y0, x1, y1 = corners[:, begin[at][:, None] + np.arange(sizes[at[0]])]
        cy[at], w[at], bh[at] = _middle((y0 + y1) / 2), _middle(x1 - x0), _middle(y1 - y0)
    first, final = frames[begin], frames[begin + sizes - 1]
    # candidates
    later = last - every - 1
    p = np.repeat(every, later)
    q = p + 1 + np.arange(len(p)) - np.repeat(later.cumsum() - later, later)
    h, bare = pieces["h"], text < 0
    tall, low = np.maximum(h[p], h[q]), np.minimum(h[p], h[q])
    colour = np.sqrt(sum((pieces[c][p] - pieces[c][q]) ** 2 for c in "lab"))
    cut = (pieces["cut"][p] >= 0) & (pieces["cut"][p] == pieces["cut"][q])
    fits = (low > 0) & (tall <= LINE_RATIO * low) & (np.abs(pieces["rot"][p] - pieces["rot"][q]) <= TURN) & (colour <= COLOUR) & ~cut & ~(bare[p] & bare[q])
    p, q, tall = p[fits], q[fits], tall[fits]
    # what both show in common frames, in order
    _, moment = np.unique(frames, return_inverse=True)
    moments = int(moment.max(initial=0)) + 1
    place = np.repeat(every, sizes) * moments + moment
    pair = np.repeat(np.arange(len(p)), sizes[p])
    mine = np.arange(len(pair)) - np.repeat(sizes[p].cumsum() - sizes[p] - begin[p], sizes[p])
    wanted = q[pair] * moments + moment[mine]
    theirs = np.minimum(np.searchsorted(place, wanted), max(0, len(place) - 1))
    met = place[theirs] == wanted
    pair, mine, theirs = pair[met], mine[met], theirs[met]
    n = np.bincount(pair, minlength=len(p))
    at_pair = np.concatenate([[0], n.cumsum()])[:-1]
    off, gap, speeds = np.abs(cy[p] - cy[q]), np.full(len(p), np.inf), np.zeros((2, len(p)))
    for at in _few(n):
        count = int(n[at[0]])
        both = at_pair[at][:, None] + np.arange(count)
        (px0, py0, px1, py1), (qx0, qy0, qx1, qy1) = corners[:, mine[both]], corners[:, theirs[both]]
        down = (py0 + py1 - qy0 - qy1) / 2
        off[at], gap[at] = _middle(np.abs(down)), _middle(np.maximum(px0, qx0) - np.minimum(px1, qx1))
        if count > 1:
            ways = [(px0 + px0 - qx0 - qx0) / 2, (px1 + px1 - qx1 - qx1) / 2, (px0 + px1 - qx0 - qx1) / 2]
            for i, (k, edges) in enumerate(((max(1, min(round(STEP_S * fps), count - 1)), ways), (1, ways[2:]))):
                speeds[i, at] = np.min([_middle(np.hypot((x[:, k:] - x[:, :-k]) / k, (down[:, k:] - down[:, :-k]) / k)) for x in edges], axis=0)
    fits = off <= LINE_DY * tall
    for s, ref in ((p, q), (q, p)):  # a glyph, mostly concurrent with its text
        fits &= ~bare[s] | ((bh[s] <= GLYPH[0] * h[ref]) & (w[s] <= GLYPH[1] * h[ref]) & (n >= CONCURRENT * sizes[s]))
    beside = fits & (n > 0) & (gap <= GAP_H * tall) & (np.abs(first[p] - first[q]) / fps <= ONSET_S)
    earlier = final[p] <= first[q]
    e, l = np.where(earlier, p, q), np.where(earlier, q, p)  # noqa: E741
    e_box, l_box = corners[:, begin[e] + sizes[e] - 1], corners[:, begin[l]]
    area = [np.maximum(0.0, b[2] - b[0]) * np.maximum(0.0, b[3] - b[1]) for b in (e_box, l_box)]
    shared = np.prod([np.maximum(0.0, np.minimum(e_box[i + 2], l_box[i + 2]) - np.maximum(e_box[i], l_box[i])) for i in (0, 1)], axis=0)
    small, wait = np.minimum(*area), first[l] - final[e]
    after = fits & ~bare[p] & ~bare[q] & (wait >= 0) & (wait / fps <= SUCCESSION_S) & (shared > 0) & (shared >= CONTAIN * small)
    at = np.flatnonzero(after)
    after[at] = [_repeats(texts[i], texts[j]) for i, j in zip(text[p[at]].tolist(), text[q[at]].tolist(), strict=True)]
    found = [(beside & (speed <= MOTION)) | after for speed in speeds]
    return [(p[f], q[f]) for f in found]


def _grouped(links: tuple[np.ndarray, np.ndarray], bare: np.ndarray) -> np.ndarray:
    """``grouped`` by places: of each piece, the place of the smallest text of its group, or its own."""
    p, q = links
    texts = ~bare[p] & ~bare[q]
    group = np.arange(len(bare))
    while True:
        least = np.minimum(group[p[texts]], group[q[texts]])
        before = group.copy()
        for ends in (p[texts], q[texts]):
            np.minimum.at(group, ends, least)
        group = group[group]
        if (group == before).all():
            break
    low, high = np.full(len(bare), len(bare)), np.full(len(bare), -1)
    for s, t in ((p[~texts], q[~texts]), (q[~texts], p[~texts])):
        s, t = s[bare[s]], t[bare[s]]
        np.minimum.at(low, s, group[t])
        np.maximum.at(high, s, group[t])
    return np.where(bare & (low == high), low, group)


def _plan(rows: pa.Table, scene: np.ndarray, fps: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Group and part of each piece of whole scenes, which come in order of their numbers, as places, and whether it is merged and bound."""
    n = len(rows)
    boxes = rows["boxes"].combine_chunks()
    sizes, shown = boxes.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), boxes.flatten()
    frames, corners = shown.field("frame").to_numpy(zero_copy_only=False), np.array([shown.field(c).to_numpy(zero_copy_only=False) for c in BOX], np.float64)
    order = np.lexsort((frames, np.repeat(np.arange(n), sizes)))
    frames, corners = frames[order], corners[:, order]

    def codes(column: str) -> tuple[np.ndarray, list]:
        """Values as numbers, null as -1."""
        known = rows[column].combine_chunks().dictionary_encode()
        return known.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64), known.dictionary.to_pylist()

    text, texts = codes("text")
    text = np.where(np.isin(text, [i for i, t in enumerate(texts) if t == ""]), -1, text)
    pieces = {c: rows[c].to_numpy().astype(np.float64) for c in ("h", "rot", "l", "a", "b")} | {"cut": codes("cut")[0]}
    wide, strict = _titles(pieces, texts, text, frames, corners, sizes, np.searchsorted(scene, scene, side="right"), fps)
    bare = text < 0
    group = _grouped(wide, bare)
    inside = group[strict[0]] == group[strict[1]]
    part = _grouped((strict[0][inside], strict[1][inside]), bare)
    members, of_part = np.bincount(group, minlength=n), np.bincount(part, minlength=n)
    told, part_told = (np.bincount(x, weights=~bare, minlength=n) > 0 for x in (group, part))
    parts = np.bincount(np.unique(group * n + part) // n, minlength=n)
    title = (members > 1) & told
    return group, part, title[group] & (of_part > 1)[part] & part_told[part], (title & (parts > 1))[group]


def _planned(pieces: DataFrame, scene: list[str], fps: float) -> DataFrame:
    """``merge_plan`` of scenes of few pieces, which hold their boxes: a task works through many scenes at once, pair by pair inside of each."""
    columns = ["id", "text", "h", "rot", "l", "a", "b", "cut", "boxes"]
    rank = F.row_number().over(Window.partitionBy(*scene).orderBy("id"))
    rows = pieces.select(*scene, *columns).withColumn("_rank", rank).sortWithinPartitions(*scene, "id")
    own = rows.schema["id"]
    schema = StructType([*(rows.schema[c] for c in (*scene, "id")), StructField("group", own.dataType), StructField("part", own.dataType), StructField("merged", BooleanType()), StructField("bound", BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_entities(batches):
            shown = pa.compute.fill_null(pa.compute.list_value_length(table["boxes"]), 0).to_numpy() > 0
            at = (table["_rank"].to_numpy() == 1).cumsum()[shown]
            table = table.filter(pa.array(shown))
            group, part, merged, bound = _plan(table, at, fps)
            ids = table["id"].combine_chunks()
            out = table.select([*scene, "id"])
            for name, values in (("group", ids.take(pa.array(group))), ("part", ids.take(pa.array(part))), ("merged", pa.array(merged)), ("bound", pa.array(bound))):
                out = out.append_column(name, values)
            yield from out.combine_chunks().to_batches()

    return rows.mapInArrow(run, schema)


def merge_plan(fragments: DataFrame, boxes: DataFrame | None, scene: list[str], fps: float, lines: DataFrame | None = None) -> DataFrame:
    """(scene, id, group, part, merged, bound): each piece's title, the part of it that is merged, and whether the title is bound.

    Pieces that the stricter test (frame by frame, by centres) joins too are merged; a title of
    several such parts is bound around them.  A group or part without a text is left alone.
    boxes is (scene, id, frame, x0, y0, x1, y1), or (scene, id, boxes) with each piece's in an
    array; it is None where the fragments have such arrays, one box a frame.  Then a scene of at
    most ``FEW`` pieces is planned in one task, without joins (unless lines are given).
    """
    if boxes is not None:
        return _joined_plan(fragments, boxes, scene, fps, lines)
    rounds = Rounds(fragments.sparkSession)
    large = rounds.keep(fragments.groupBy(*scene).agg(F.count(F.lit(1)).alias("_all")).filter(F.col("_all") > (0 if lines is not None else FEW)).select(*scene), "large")
    if large.isEmpty():
        return _planned(fragments, scene, fps)
    many = rounds.keep(fragments.join(large, scene, "left_semi"), "many")
    joined = _joined_plan(many.drop("boxes"), many.select(*scene, "id", "boxes"), scene, fps, lines)
    return _planned(fragments.join(large, scene, "left_anti"), scene, fps).unionByName(joined)


def _joined_plan(fragments: DataFrame, boxes: DataFrame, scene: list[str], fps: float, lines: DataFrame | None) -> DataFrame:
    """``merge_plan`` by joins, for scenes of any size."""
    rounds = Rounds(fragments.sparkSession)
    packed = "boxes" in boxes.columns  # few boxes a piece, in one row: no table of boxes is written or joined by frame
    if not packed:
        boxes = rounds.keep(boxes.select(*scene, "id", "frame", *BOX), "boxes")
    pieces = rounds.keep(described(fragments, boxes, scene), "pieces")
    near = candidates(pieces, scene)
    if packed:
        near, boxes = near.withColumn("_both", in_common(F.col("p_boxes"), F.col("q_boxes"))).drop("p_boxes", "q_boxes"), None
    near = rounds.keep(near, "near")
    wide = rounds.keep(grouped(pieces, same_title(near, boxes, scene, fps, True, lines), scene), "wide")
    ends = [wide.select(F.col("id").alias(f"{c}_id"), F.col("group").alias(f"_{c}")) for c in "pq"]
    inside = same_title(near.join(ends[0], "p_id").join(ends[1], "q_id").filter("_p = _q").drop("_p", "_q"), boxes, scene, fps, False, lines)
    parts = grouped(pieces, inside, scene).select("id", F.col("group").alias("part"))
    named = wide.join(parts, "id").join(pieces.select("id", (F.coalesce(F.col("text"), F.lit("")) != "").cast("int").alias("_text")), "id")
    of_group = named.groupBy("group").agg(F.count(F.lit(1)).alias("_n"), F.max("_text").alias("_texts"), F.count_distinct("part").alias("_parts"))
    of_part = named.groupBy("part").agg(F.count(F.lit(1)).alias("_pn"), F.max("_text").alias("_ptexts"))
    title = (F.col("_n") > 1) & (F.col("_texts") == 1)
    return named.join(of_group, "group").join(of_part, "part").select(*scene, "id", "group", "part", (title & (F.col("_pn") > 1) & (F.col("_ptexts") == 1)).alias("merged"), (title & (F.col("_parts") > 1)).alias("bound"))


def union_boxes(groups: DataFrame, boxes: DataFrame, scene: list[str]) -> DataFrame:
    """Per group and frame: the box around its members that are seen there, and how many are."""
    edges = [F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")]
    return groups.join(boxes, [*scene, "id"]).groupBy(*scene, "group", "frame").agg(*edges, F.count(F.lit(1)).alias("members"))
