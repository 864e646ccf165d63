"""Training a small network: gradients are partial sums in the tasks, the driver holds the weights alone."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame, functions as F

from .checkpoints import Rounds

Layers = list[tuple[np.ndarray, np.ndarray]]

# Fixed value: numbers that one task takes of a minibatch at most.
COMPONENTS = 1 << 21


def _forward(x: np.ndarray, layers: Layers) -> list[np.ndarray]:
    """What enters each layer, and the logits last."""
    seen = [x]
    for i, (weights, bias) in enumerate(layers):
        out = seen[-1] @ weights.T + bias
        seen.append(np.maximum(out, 0.0) if i + 1 < len(layers) else out)
    return seen


def gradients(x: np.ndarray, y: np.ndarray, w: np.ndarray, layers: Layers) -> tuple[list[tuple[np.ndarray, np.ndarray]], float]:
    """Summed gradients of the weighted logistic loss by layer, and the loss."""
    seen = _forward(x, layers)
    logits = seen[-1][:, 0]
    loss = float((w * (np.logaddexp(0.0, logits) - y * logits)).sum())
    back, out = (w * (1 / (1 + np.exp(-np.clip(logits, -500, 500))) - y))[:, None], []
    for i in range(len(layers) - 1, -1, -1):
        out.append((back.T @ seen[i], back.sum(axis=0)))
        if i:
            back = (back @ layers[i][0]) * (seen[i] > 0)
    return out[::-1], loss


def _flat(parts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    return np.concatenate([a.ravel() for pair in parts for a in pair])


def _shaped(flat: np.ndarray, like: Layers) -> Layers:
    out, at = [], 0
    for weights, bias in like:
        a = flat[at : at + weights.size].reshape(weights.shape)
        at += weights.size
        out.append((a, flat[at : at + bias.size]))
        at += bias.size
    return out


def _packed(rows: DataFrame, folds: int, size: int, seed: int) -> tuple[RDD, int]:
    """Rows as blocks of numbers, one in each partition, and how many blocks a minibatch has.

    Partition ``fold * parts + part`` holds a part of a minibatch: all of it, unless it has more than COMPONENTS numbers.
    """
    dealt = rows.withColumn("fold", F.pmod(F.xxhash64(F.lit(seed), "_id"), F.lit(folds)))
    parts = max(1, math.ceil(dealt.groupBy("fold").count().agg(F.max("count")).first()[0] * size / COMPONENTS))

    def pack(table: pa.Table) -> pa.Table:
        x = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in table.column("x").chunks])
        return pa.table({"place": table.column("place")[:1], "x": [x.tobytes()], "y": [table.column("y").to_numpy().tobytes()], "w": [table.column("w").to_numpy().tobytes()]})

    placed = dealt.select((F.col("fold") * parts + F.pmod(F.monotonically_increasing_id(), F.lit(parts))).alias("place"), "x", "y", "w")
    blocks = placed.groupBy("place").applyInArrow(pack, "place long, x binary, y binary, w binary")
    return blocks.rdd.map(lambda r: (r["place"], (bytes(r["x"]), bytes(r["y"]), bytes(r["w"])))).partitionBy(folds * parts, int).persist(StorageLevel.DISK_ONLY), parts


def _summed(blocks: RDD, places: list[int], layers: Layers, mean: np.ndarray, deviation: np.ndarray) -> tuple[np.ndarray, float, int]:
    """Gradient sum, loss sum and number of rows of some blocks: a job of one task for each, without a shuffle."""

    def run(found: Iterator[tuple[int, tuple[bytes, bytes, bytes]]]) -> Iterator[np.ndarray]:
        for _, block in found:
            x, y, w = (np.frombuffer(part, np.float64) for part in block)
            total, loss = gradients((x.reshape(len(y), -1) - mean) / deviation, y, w, layers)
            yield np.append(_flat(total), [loss, len(y)])

    out = sum(blocks.context.runJob(blocks, run, places), np.zeros(sum(w.size + b.size for w, b in layers) + 2))
    return out[:-2], float(out[-2]), int(out[-1])


def fit_network(rows: DataFrame, ident: str, vector: str, label: str, weight: str | None = None, hidden: tuple[int, ...] = (32, 32), epochs: int = 30, batch: int = 4096, rate: float = 1e-3, decay: float = 1e-4, seed: int = 0) -> tuple[list[float], list[float], list[tuple[list[list[float]], list[float]]], list[float]]:
    """Mean, deviation and layers for ``vectors.network_score``, and the loss of each epoch.

    Rows are dealt to minibatches by a hash of their id once, packed and kept on the executors'
    disks; each step is a job on the partitions of one minibatch alone, which sums its gradients
    in the tasks, and moves the weights (Adam, with decay of the weights) on the driver, which
    sends them out with the next step.  Steps grow with the rows, what one costs does not.  The order of
    minibatches changes by epoch with the seed, so reruns agree up to rounding of sums.  Rows
    with a null label, vector, component or weight are left out.
    """
    given = rows.select(F.col(ident).alias("_id"), F.col(vector).cast("array<double>").alias("x"), F.col(label).cast("double").alias("y"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"))
    given = given.filter(F.col("x").isNotNull() & ~F.exists("x", lambda v: v.isNull() | F.isnan(v)) & F.col("y").isNotNull() & F.col("w").isNotNull())
    rounds = Rounds(rows.sparkSession)
    kept = rounds.keep(given, "rows")
    count = kept.count()
    if not count:
        raise ValueError("no rows to learn from")
    size = len(kept.select("x").first()[0])
    stats = kept.agg(*[F.avg(F.col("x")[i]).alias(f"m{i}") for i in range(size)], *[F.stddev_pop(F.col("x")[i]).alias(f"s{i}") for i in range(size)]).first()
    mean, deviation = np.array([stats[f"m{i}"] for i in range(size)]), np.array([stats[f"s{i}"] for i in range(size)]) + 1e-6
    folds = max(1, math.ceil(count / batch))
    blocks, parts = _packed(kept, folds, size, seed)

    rng = np.random.default_rng(seed)
    sizes = [size, *hidden, 1]
    layers: Layers = [(rng.uniform(-1, 1, (n, m)) / math.sqrt(m), rng.uniform(-1, 1, n) / math.sqrt(m)) for m, n in zip(sizes, sizes[1:], strict=False)]
    now = _flat(layers)
    first, second, steps, losses = np.zeros_like(now), np.zeros_like(now), 0, []
    for _ in range(epochs):
        lost = 0.0
        for fold in rng.permutation(folds):
            total, loss, n = _summed(blocks, [int(fold) * parts + part for part in range(parts)], _shaped(now, layers), mean, deviation)
            if not n:
                continue
            lost += loss
            steps += 1
            gradient = total / n + decay * now
            first, second = 0.9 * first + 0.1 * gradient, 0.999 * second + 0.001 * gradient**2
            now = now - rate * (first / (1 - 0.9**steps)) / (np.sqrt(second / (1 - 0.999**steps)) + 1e-8)
        losses.append(lost / count)
    blocks.unpersist()
    rounds.drop(kept)
    return mean.tolist(), deviation.tolist(), [(w.tolist(), b.tolist()) for w, b in _shaped(now, layers)], losses
