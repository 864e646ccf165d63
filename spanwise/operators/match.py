"""Joins by time, overlap and cost.

A range condition alone would compare all pairs, so interval and nearest joins go by
buckets: each row is dealt to the buckets that its reach touches, an equi-join on the bucket
(and key) finds candidates, and the exact condition decides.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .checkpoints import shuffled


def band_join(left: DataFrame, right: DataFrame, keys: list[str], left_at: str, right_at: str, low: float, high: float) -> DataFrame:
    """Pairs with equal keys and low <= right_at - left_at <= high, both sides' columns kept (rows once each)."""
    width = max(high - low, 1)
    dealt = left.withColumn("_bucket", F.explode(F.sequence(F.floor((F.col(left_at) + low) / width), F.floor((F.col(left_at) + high) / width))))
    other = right.withColumn("_bucket", F.floor(F.col(right_at) / width))
    gap = F.col(right_at) - F.col(left_at)
    return dealt.join(other, [*keys, "_bucket"]).filter((gap >= low) & (gap <= high)).drop("_bucket")


def nearest_earlier(left: DataFrame, right: DataFrame, keys: list[str], left_at: str, right_at: str, left_id: str, right_order: list[str]) -> DataFrame:
    """Each left row with the last right row at or before it (left rows without one keep nulls).

    Both sides are laid in one order per key and the last right row is carried forward: one
    shuffle, and no pairs.
    """
    names = [c for c in right.columns if c not in keys]
    rights = right.select(*keys, F.col(right_at).alias("_at"), F.lit(0).alias("_side"), F.struct(*names).alias("_right"), F.lit(None).cast(left.select(F.struct(*left.columns)).schema[0].dataType).alias("_left"))
    lefts = left.select(*keys, F.col(left_at).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast(rights.schema["_right"].dataType).alias("_right"), F.struct(*left.columns).alias("_left"))
    order = Window.partitionBy(*keys).orderBy("_at", "_side", *[F.col(f"_right.{c}") for c in right_order]).rowsBetween(Window.unboundedPreceding, 0)
    rows = rights.unionByName(lefts).withColumn("_found", F.last("_right", ignorenulls=True).over(order)).filter("_side = 1")
    return rows.select("_left.*", *[F.col(f"_found.{c}").alias(c) for c in names])


def best_pairs(pairs: DataFrame, left_id: list[str], cost: Column, ties: list[str]) -> DataFrame:
    """The cheapest pair of each left row; ties by the given columns."""
    return pairs.withColumn("_rank", F.row_number().over(Window.partitionBy(*left_id).orderBy(cost, *ties))).filter("_rank = 1").drop("_rank")


def assignment(cost: np.ndarray) -> np.ndarray:
    """Column of each row in a minimum-cost one-to-one assignment of a matrix with no more rows than columns.

    Rows enter one by one; each enters along a cheapest alternating path, and potentials keep
    all reduced costs non-negative.
    """
    n, m = cost.shape
    row_price, column_price = np.zeros(n), np.zeros(m)
    row_of = np.full(m, -1)
    for r in range(n):
        shortest, came_from = np.full(m, np.inf), np.full(m, -1)
        done = np.zeros(m, bool)
        row, at, reached = r, -1, 0.0
        while True:
            through = reached + cost[row] - row_price[row] - column_price
            better = ~done & (through < shortest)
            shortest[better], came_from[better] = through[better], at
            at = int(np.where(done, np.inf, shortest).argmin())
            reached = shortest[at]
            done[at] = True
            if row_of[at] < 0:
                break
            row = row_of[at]
        seen = np.flatnonzero(done)
        row_price[r] += reached
        for c in seen:
            if row_of[c] >= 0:
                row_price[row_of[c]] += reached - shortest[c]
            column_price[c] -= reached - shortest[c]
        while at >= 0:
            before = came_from[at]
            row_of[at] = row_of[before] if before >= 0 else r
            at = before
    out = np.full(n, -1)
    out[row_of[row_of >= 0]] = np.flatnonzero(row_of >= 0)
    return out


def whole_groups(batches: Iterator[pd.DataFrame], group: list[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Batches whose rows come sorted by group as frames of whole groups, and where each group begins and the last ends.

    So a task works through many small groups without a call of Spark for each.
    """

    def edges(rows: pd.DataFrame) -> np.ndarray:
        """Rows whose group is not that of the row before; nulls are one value."""
        keys, before = rows[group], rows[group].shift()
        same = (keys == before) | (keys.isna() & before.isna())
        return np.flatnonzero(~same.all(axis=1).to_numpy()[1:]) + 1

    def ready(parts: list[pd.DataFrame]) -> tuple[pd.DataFrame, np.ndarray]:
        rows = pd.concat(parts, ignore_index=True) if len(parts) > 1 else parts[0].reset_index(drop=True)
        return rows, np.concatenate([[0], edges(rows), [len(rows)]]).astype(np.int64)

    held: list[pd.DataFrame] = []  # of a group that may go on in the next batch
    for batch in batches:
        if not len(batch):
            continue
        if held and len(edges(pd.concat([held[-1].tail(1), batch.head(1)], ignore_index=True))):
            yield ready(held)
            held = []
        cuts = edges(batch)
        if len(cuts):
            yield ready([*held, batch.iloc[: cuts[-1]]])
            held = []
        held.append(batch.iloc[cuts[-1] if len(cuts) else 0 :])
    if held:
        yield ready(held)


def whole_entities(batches: Iterator[pa.RecordBatch], rank: str = "_rank") -> Iterator[pa.Table]:
    """Batches whose rows come by entity and count from 1 in each, as tables of whole entities."""
    held: list[pa.RecordBatch] = []  # of an entity that may go on in the next batch
    for batch in batches:
        begins = np.flatnonzero(batch.column(rank).to_numpy() == 1)
        if len(begins):
            rows = pa.Table.from_batches([*held, batch.slice(0, int(begins[-1]))])
            if len(rows):
                yield rows
            held = []
        held.append(batch.slice(int(begins[-1]) if len(begins) else 0))
    if held:
        yield pa.Table.from_batches(held)


def chosen_pairs(pairs: DataFrame, group: list[str], left: str, right: str, cost: str, choose: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """The rows of pairs that ``choose(left, right, cost)`` marks in each group."""
    schema = pairs.select(*group, left, right, F.col(cost).cast("double").alias(cost)).schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, cuts in whole_groups(batches, group):
            a, b, c = rows[left].to_numpy(), rows[right].to_numpy(), rows[cost].to_numpy()
            yield rows[np.concatenate([choose(a[i:j], b[i:j], c[i:j]) for i, j in zip(cuts, cuts[1:], strict=False)])]

    return pairs.select(*schema.names).repartition(*group).sortWithinPartitions(*group, left, right).mapInPandas(run, schema)


def _parts(i: np.ndarray, j: np.ndarray) -> list[np.ndarray]:
    """The links (i, j) by connected part: positions of each part's links."""
    parent: dict[tuple[bool, int], tuple[bool, int]] = {}

    def root(x: tuple[bool, int]) -> tuple[bool, int]:
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        x, y = root((False, a)), root((True, b))
        parent[x] = y
    found: dict[tuple[bool, int], list[int]] = {}
    for n, a in enumerate(i.tolist()):
        found.setdefault(root((False, a)), []).append(n)
    return [np.array(x) for x in found.values()]


def assigned(left: np.ndarray, right: np.ndarray, cost: np.ndarray, most: float) -> np.ndarray:
    """Which pairs the one-to-one choice of least total cost takes, leaving a left side alone for ``most``.

    Only pairs of at most ``most`` count, and each connected part of them is a matrix of its own.
    """
    keep, fits = np.zeros(len(left), bool), np.flatnonzero(cost <= most)
    for part in _parts(left[fits], right[fits]):
        at = fits[part]
        rows, columns = np.unique(left[at]), np.unique(right[at])
        matrix = np.full((len(rows), len(columns) + len(rows)), float(most))
        matrix[:, : len(columns)] = 4.0 * most + 1.0
        i, j = np.searchsorted(rows, left[at]), np.searchsorted(columns, right[at])
        matrix[i, j] = cost[at]
        keep[at] = assignment(matrix)[i] == j
    return keep


def one_to_one(pairs: DataFrame, group: list[str], left: str, right: str, cost: str, most: float) -> DataFrame:
    """Per group the one-to-one pairs of least total cost, where a pair may cost at most ``most``.

    Pairs not listed cannot be chosen.  Leaving a left row alone costs ``most``, so every
    pair below the limit is worth it.  A group (a frame, an order) is one unit of work.
    """

    return chosen_pairs(pairs, group, left, right, cost, lambda a, b, c: assigned(a, b, c, most))


def greedy_pairs(pairs: DataFrame, group: list[str], left: str, right: str, cost: str, most: float) -> DataFrame:
    """Per group, pairs taken by ascending cost (ties by ids) while both sides are free."""

    def take(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
        keep, used_left, used_right = np.zeros(len(a), bool), set(), set()
        for i in np.lexsort((b, a, c)):
            if c[i] <= most and a[i] not in used_left and b[i] not in used_right:
                keep[i] = True
                used_left.add(a[i])
                used_right.add(b[i])
        return keep

    return chosen_pairs(pairs, group, left, right, cost, take)


def monotone_pairs(rows: DataFrame, candidates: list[str], group: list[str], order: list[str], text: str, score: Callable[[str, str], float], least: float) -> DataFrame:
    """Match an entity's rows, in order, to a given list of texts, never going back in the list."""
    schema = rows.select(*group, *order, text).schema.add("copy", "string")

    def follow(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(order, ignore_index=True)
        at, found = 0, []
        for value in part[text]:
            scores = [(score(value or "", c), -i, i) for i, c in enumerate(candidates[at:], at)]
            best = max(scores, default=(0.0, 0, 0))
            found.append(candidates[best[2]] if best[0] >= least else None)
            at = best[2] if best[0] >= least else at
        return part[[*group, *order, text]].assign(copy=found)

    return rows.select(*group, *order, text).groupBy(*group).applyInPandas(follow, schema)


def _least_total(cost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of a one-to-one choice of least total cost that leaves no side's smaller number alone."""
    if cost.shape[0] > cost.shape[1]:
        columns, rows = _least_total(cost.T)
        return rows, columns
    if min(cost.shape) == 1:
        return np.zeros(1, np.int64), np.array([cost[0].argmin()])
    return np.arange(len(cost)), assignment(cost)


def _linked(frames: np.ndarray, place: np.ndarray, area: np.ndarray, colour: np.ndarray, reach: float, most: float, idle: int, smallest: float) -> np.ndarray:
    """Track of each row of one scene, whose rows come by frame (-1: none)."""
    label = np.full(len(frames), -1)
    history: list[tuple[int, int]] = []  # the last row of each track, and the one before it
    live: list[int] = []
    edges = [*np.flatnonzero(np.diff(frames, prepend=frames[0] - 1)).tolist(), len(frames)]
    for begin, end in zip(edges, edges[1:], strict=False):
        f = frames[begin]
        live = [t for t in live if f - frames[history[t][0]] <= idle]
        if live:
            last, before = np.array([history[t] for t in live]).T
            span = np.maximum(frames[last] - frames[before], 1)
            ahead = place[last] + (place[last] - place[before]) * ((f - frames[last]) / span)[:, None]
            cost = np.sqrt(((ahead[:, None] - place[None, begin:end]) ** 2).sum(axis=2)) / reach + np.abs(np.log(area[last][:, None] / area[None, begin:end]))
            cost += np.sqrt(((colour[last][:, None] - colour[None, begin:end]) ** 2).sum(axis=2))
            for a, b in zip(*_least_total(cost), strict=True):
                if cost[a, b] <= most:
                    label[begin + b] = live[a]
                    history[live[a]] = (int(begin + b), history[live[a]][0])
        enough = smallest * area[begin:end].max()
        for i in range(begin, end):
            if label[i] < 0 and area[i] >= enough:
                label[i] = len(history)
                live.append(len(history))
                history.append((i, i))
    return label


def tracks(observed: DataFrame, scene: list[str], frame: str, obs_id: str, x: str, y: str, size: str, reach: float, most: float, idle: int = 2, smallest: float = 0.25, colour: list[str] | None = None, colour_reach: float = 60.0) -> DataFrame:
    """Link observations of successive frames to tracks by one-to-one assignment.

    Each frame's observations are matched to the tracks seen at most ``idle`` frames before:
    of all one-to-one choices the one of least total cost, where a pair costs the distance to
    the track's extrapolated place over ``reach``, the log ratio of sizes and the distance of
    colours over ``colour_reach``; pairs of more than ``most`` are then undone.  What is left
    starts a track, but not if it is smaller than a share ``smallest`` of the frame's largest
    (its track is null).  A scene is sequential; a task works through many scenes.
    """
    given = [F.col(c).cast("double").alias(f"_{n}") for n, c in (("x", x), ("y", y), ("size", size), *((f"c{i}", c) for i, c in enumerate(colour or [])))]
    slim = observed.select(*scene, F.col(frame).cast("long").alias(frame), F.col(obs_id).cast("long").alias(obs_id), *given)
    schema = slim.select(*scene, frame, obs_id).schema.add("track", "long")
    shades = [f"_c{i}" for i in range(len(colour or []))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, cuts in whole_groups(batches, scene):
            frames, place, area = rows[frame].to_numpy(), rows[["_x", "_y"]].to_numpy(np.float64), np.maximum(rows["_size"].to_numpy(np.float64), 1.0)
            hue = rows[shades].to_numpy(np.float64).reshape(len(rows), len(shades)) / colour_reach
            label = np.concatenate([_linked(frames[i:j], place[i:j], area[i:j], hue[i:j], reach, most, idle, smallest) for i, j in zip(cuts, cuts[1:], strict=False)])
            yield rows[[*scene, frame, obs_id]].assign(track=pd.array(label, "Int64")).assign(track=lambda r: r["track"].mask(r["track"] < 0))

    return slim.repartition(*scene).sortWithinPartitions(*scene, frame, obs_id).mapInPandas(run, schema)


def frame_pairs(regions: DataFrame, keys: list[str], ident: str, frame: str, x: str, y: str, area: str, apart: int, gate: float) -> DataFrame:
    """Candidate pairs of regions 1 to ``apart`` frames from each other, nearer than the gate or twice the root of the first's area."""
    later = regions.select(*keys, F.col(ident).alias("other"), F.col(frame).alias("_frame"), F.col(x).alias("_x"), F.col(y).alias("_y"))
    pairs = band_join(regions, later, keys, frame, "_frame", 1, apart)
    off = F.hypot(F.col("_x") - F.col(x), F.col("_y") - F.col(y))
    return pairs.withColumn("distance", off).filter(off <= F.greatest(F.lit(gate), 2 * F.sqrt(F.col(area)))).select(*keys, ident, "other", (F.col("_frame") - F.col(frame)).alias("apart"), "distance")


def nearest_by(rows: DataFrame, others: DataFrame, keys: list[str], ident: str, other: str, distance: Column) -> DataFrame:
    """The nearest of the others for each row among equal keys (ties to the smaller id), infinity where there is none.

    A distance that is not known comes after all that are, infinite ones and NaN included.
    """
    pairs = rows.join(others, keys, "left").withColumn("_d", distance)
    nearest = F.min(F.struct(F.col("_d").isNull().alias("_unknown"), F.col("_d").alias("distance"), F.col(other).alias("other"))).alias("_n")
    return pairs.groupBy(*keys, ident).agg(nearest).select(*keys, ident, F.coalesce("_n.distance", F.lit(float("inf"))).alias("distance"), "_n.other")


def linked_across(left: DataFrame, right: DataFrame, keys: list[str], bits: int = 5, aspect: float = 0.1) -> DataFrame:
    """One-to-one links of elements (id, text, hash, aspect) of neighbouring scenes.

    Equal texts are at distance 0.  Elements without equal texts compare 64-bit hashes: at most
    ``bits`` may differ, and aspects by a tenth.  Hashes that differ in at most ``bits`` places
    agree in one of ``bits`` + 1 parts, so an equi-join on the parts finds them all.  Links are
    taken by distance, then ids.
    """
    size = -(-64 // (bits + 1))
    parts = F.explode(F.array(*[F.struct(F.lit(i).alias("n"), F.shiftrightunsigned("hash", i * size).bitwiseAND(F.lit((1 << size) - 1)).alias("part")) for i in range(bits + 1)])).alias("_p")
    a = left.select(*keys, F.col("id").alias("a"), F.col("text").alias("_ta"), F.col("hash"), F.col("aspect").alias("_ra"))
    b = right.select(*keys, F.col("id").alias("b"), F.col("text").alias("_tb"), F.col("hash").alias("_hb"), F.col("aspect").alias("_rb"))
    texts = a.filter(F.col("_ta") != "").join(shuffled(b), keys).filter(F.col("_ta") == F.col("_tb")).select(*keys, "a", "b", F.lit(0).alias("distance"), F.lit("text").alias("reason"))
    split_a = a.filter("hash is not null").select("*", parts).select(*keys, "a", "_ta", F.col("hash").alias("_ha"), "_ra", "_p.*")
    split_b = b.filter("_hb is not null").withColumnRenamed("_hb", "hash").select("*", parts).select(*keys, "b", "_tb", F.col("hash").alias("_hb"), "_rb", "_p.*")
    off = F.bit_count(F.col("_ha").bitwiseXOR(F.col("_hb")))
    near = split_a.join(shuffled(split_b), [*keys, "n", "part"]).filter((off <= bits) & (F.abs(F.col("_ra") - F.col("_rb")) <= aspect * F.greatest("_ra", "_rb", F.lit(1e-6))))
    near = near.filter(~((F.col("_ta") != "") & F.col("_ta").eqNullSafe(F.col("_tb")))).select(*keys, "a", "b", off.cast("int").alias("distance"), F.lit("hash").alias("reason")).distinct()
    pairs = texts.unionByName(near)
    return greedy_pairs(pairs, keys, "a", "b", "distance", float(bits)).withColumn("distance", F.col("distance").cast("int")).join(shuffled(pairs), [*keys, "a", "b", "distance"])
