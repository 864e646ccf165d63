"""Clusters of vectors: k-means with seeds drawn in rounds, near centres merged, rows labelled by the nearest."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType


def _matrix(batch: pa.RecordBatch, column: str) -> np.ndarray:
    lists = batch.column(column)
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)


def nearest(points: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centre (the first of equals) and the squared distance to it, for each point."""
    squares = (points * points).sum(axis=1)[:, None] - 2 * points @ centres.T + (centres * centres).sum(axis=1)[None]
    label = squares.argmin(axis=1)
    return label, ((points - centres[label]) ** 2).sum(axis=1)


def _sums(rows: DataFrame, vector: str, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Rows and vector sum of each centre, and the total squared distance: partial in each task, then added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total, cost = np.zeros(len(centres), np.int64), np.zeros_like(centres), np.zeros(len(centres))
        for batch in batches:
            if batch.num_rows:
                points = _matrix(batch, vector)
                label, off = nearest(points, centres)
                count += np.bincount(label, minlength=len(centres))
                cost += np.bincount(label, off, len(centres))
                np.add.at(total, label, points)
        met = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int32()), pa.array(count[met]), pa.array(cost[met]), pa.array(list(total[met]), pa.list_(pa.float64()))], names=["centre", "n", "cost", "total"])

    parts = rows.select(vector).mapInArrow(run, "centre int, n long, cost double, total array<double>")
    size = centres.shape[1]
    found = parts.groupBy("centre").agg(F.sum("n").alias("n"), F.sum("cost").alias("cost"), *[F.sum(F.col("total")[i]).alias(f"t{i}") for i in range(size)]).collect()  # one row a centre
    count, total = np.zeros(len(centres)), np.zeros_like(centres)
    for r in found:
        count[r["centre"]], total[r["centre"]] = r["n"], [r[f"t{i}"] for i in range(size)]
    return count, total, sum(r["cost"] for r in found)


def _seeds(rows: DataFrame, vector: str, ident: str, k: int, rounds: int, seed: int) -> np.ndarray:
    """Candidates drawn in rounds, each row with a chance of its share of the squared distance, times 2 k; about 2 k a round."""
    first = rows.orderBy(F.xxhash64(F.lit(seed), ident), ident).select(vector).first()
    if first is None:
        return np.zeros((0, 0))
    chosen = np.array([first[0]], np.float64)
    for turn in range(rounds):
        _, _, cost = _sums(rows, vector, chosen)
        if cost <= 0:
            break
        drawn = labelled(rows.select(ident, vector), vector, chosen, "_centre", "_off")
        chance = F.pmod(F.xxhash64(F.lit(seed), F.lit(turn), ident), F.lit(1 << 40)) / float(1 << 40)
        more = drawn.filter(chance < F.col("_off") * (2.0 * k / cost)).select(vector).distinct().collect()  # about 2 k rows
        if more:
            chosen = np.concatenate([chosen, np.array([r[0] for r in more], np.float64)])
    return np.unique(chosen, axis=0)


def _fewer(candidates: np.ndarray, weight: np.ndarray, k: int, seed: int, tries: int = 10) -> np.ndarray:
    """k centres of the few weighted candidates: the best of several tries, each from centres drawn by weight times squared distance."""
    rng, best, least = np.random.default_rng(seed), candidates[:1], np.inf
    for _ in range(tries):
        centres = candidates[[int(rng.choice(len(candidates), p=weight / weight.sum()))]]
        while len(centres) < k:
            mass = nearest(candidates, centres)[1] * weight
            if mass.sum() <= 0:
                break
            centres = np.concatenate([centres, candidates[[int(rng.choice(len(candidates), p=mass / mass.sum()))]]])
        for _ in range(10):
            label, _ = nearest(candidates, centres)
            full = np.bincount(label, weight, len(centres))
            total = np.stack([np.bincount(label, weight * x, len(centres)) for x in candidates.T], axis=1)
            centres = np.where(full[:, None] > 0, total / np.maximum(full, 1e-300)[:, None], centres)
        cost = float((nearest(candidates, centres)[1] * weight).sum())
        if cost < least:
            best, least = centres, cost
    return best


def palette(rows: DataFrame, vector: str, ident: str, k: int = 8, apart: float = 0.0, passes: int = 30, least_move: float = 0.5, rounds: int = 5, seed: int = 0) -> np.ndarray:
    """At most k centres of the rows' vectors, the largest cluster's first; of centres nearer than ``apart`` the first stays.

    Each pass is one aggregate over partial sums; passes end when no centre moves by more than
    ``least_move``.  Centres without rows stay where they are.  Rows with null vectors are left out.
    """
    rows = rows.filter(F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull()))
    candidates = _seeds(rows, vector, ident, k, rounds, seed)
    if not len(candidates):
        return np.zeros((0, 0))
    count, _, _ = _sums(rows, vector, candidates)
    centres = _fewer(candidates, count, k, seed)
    for _ in range(passes):
        count, total, _ = _sums(rows, vector, centres)
        moved = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centres)
        still = np.sqrt(((moved - centres) ** 2).sum(axis=1).max()) <= least_move
        centres = moved
        if still:
            break
    kept: list[np.ndarray] = []
    for i in np.lexsort((np.arange(len(centres)), -count)):
        if all(np.linalg.norm(centres[i] - c) > apart for c in kept):
            kept.append(centres[i])
    return np.array(kept)


def labelled(rows: DataFrame, vector: str, centres: np.ndarray | Sequence[Sequence[float]], name: str = "label", distance: str = "distance") -> DataFrame:
    """Rows with the number of their nearest centre and the squared distance to it (null where the vector is null)."""
    centres = np.asarray(centres, np.float64)
    schema = StructType([*rows.schema, StructField(name, IntegerType()), StructField(distance, DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = np.flatnonzero(batch.column(vector).is_valid().to_numpy(zero_copy_only=False))
            label, off = np.full(batch.num_rows, -1), np.full(batch.num_rows, np.nan)
            if len(known) and len(centres):
                label[known], off[known] = nearest(_matrix(batch.take(pa.array(known)), vector), centres)
            empty = label < 0
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(label, pa.int32(), mask=empty), pa.array(off, mask=empty)], names=[*batch.schema.names, name, distance])

    return rows.mapInArrow(run, schema)
