"""Vector columns: products, correlation, a small network, nearest centres, near neighbours."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema


def as_doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def mean(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)


def centred(a: Column) -> Column:
    m = mean(a)
    return F.transform(a, lambda x: x - m)


def correlation(a: Column, b: Column) -> Column:
    """Normalised cross-correlation; null where a side is constant."""
    x, y = centred(a), centred(b)
    size = F.sqrt(dot(x, x) * dot(y, y))
    return F.when(size > 0, dot(x, y) / size)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def _layer(v: Column, weights: Sequence[Sequence[float]], bias: Sequence[float], relu: bool) -> Column:
    outs = [dot(v, F.array(*[F.lit(float(w)) for w in row])) + float(b) for row, b in zip(weights, bias, strict=True)]
    return F.array(*[F.greatest(o, F.lit(0.0)) if relu else o for o in outs])


def network_score(v: Column, mean_: Sequence[float], deviation: Sequence[float], layers: Sequence[tuple[Sequence[Sequence[float]], Sequence[float]]]) -> Column:
    """Standardise, ReLU layers, sigmoid; null where the vector does not fit the weights."""
    x = F.zip_with(F.zip_with(v, F.array(*[F.lit(float(m)) for m in mean_]), lambda a, m: a - m), F.array(*[F.lit(float(s)) for s in deviation]), lambda a, s: a / s)
    for i, (weights, bias) in enumerate(layers):
        x = _layer(x, weights, bias, relu=i + 1 < len(layers))
    return F.when(F.size(v) == len(mean_), 1 / (1 + F.exp(-x[0])))


def nearest_centre(rows: DataFrame, vector: str, centres: Sequence[Sequence[float]], name: str = "centre") -> DataFrame:
    """Number of the closest centre (the first of equals) and the squared distance to it."""
    options = [F.struct(squared_distance(F.col(vector), F.array(*[F.lit(float(x)) for x in c])).alias("distance"), F.lit(i).alias("centre")) for i, c in enumerate(centres)]
    return rows.withColumn("_near", F.array_min(F.array(*options))).withColumns({name: F.col("_near.centre"), "distance": F.col("_near.distance")}).drop("_near")


def _blocks(rows: DataFrame, keep: list[str], vector: str, size: int = 1024) -> DataFrame:
    """Rows in blocks: their columns as lists, and their centred unit vectors as one matrix of doubles; blocks have one dimension."""
    schema = rows.select(F.lit(0).alias("dim"), *[F.array(c).alias(c) for c in keep]).schema.add("matrix", "binary")

    def pack(part: pa.Table) -> pa.Table:
        dim = part["_dim"][0].as_py()
        matrix = part["_v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, dim)
        matrix = matrix - matrix.mean(axis=1, keepdims=True)
        matrix /= np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300)
        return pa.table({"dim": pa.array([dim], pa.int32()), **{c: pa.array([part[c].to_pylist()], pa.list_(part.schema.field(c).type)) for c in keep}, "matrix": pa.array([matrix.tobytes()], pa.binary())})

    slim = rows.select(*keep, as_doubles(F.col(vector)).alias("_v")).filter(F.col("_v").isNotNull() & (F.size("_v") > 0) & ~F.exists("_v", lambda x: x.isNull())).withColumn("_dim", F.size("_v"))
    count = max(1, -(-slim.count() // size))
    return slim.withColumn("_block", F.pmod(F.xxhash64(*keep), F.lit(count))).groupBy("_dim", "_block").applyInArrow(pack, schema)


def leaked(rows: DataFrame, held: DataFrame, group: str, ident: str, vector: str, least: float, hits: int) -> DataFrame:
    """Groups with at least ``hits`` vectors that correlate with a held-out vector.

    Both sides go in blocks of a thousand vectors; each block meets each block of the other
    side once, by an equi-join on the dimension, as one product of matrices.
    """

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, groups, idents, mine, others in zip(*(batch.column(c).to_pylist() for c in ("dim", group, ident, "matrix", "_others")), strict=True):
                product = np.frombuffer(mine).reshape(-1, dim) @ np.frombuffer(others).reshape(-1, dim).T
                for i in np.flatnonzero((product >= least).any(axis=1)).tolist():
                    yield pa.RecordBatch.from_pylist([{group: groups[i], ident: idents[i]}], schema=kinds)

    schema = rows.select(group, ident).schema
    kinds = to_arrow_schema(schema)
    asked = _blocks(rows, [group, ident], vector)
    other = _blocks(held, [ident], vector).select("dim", F.col("matrix").alias("_others"))
    found = asked.join(other, "dim").mapInArrow(near, schema)
    return found.distinct().groupBy(group).agg(F.count(F.lit(1)).alias("near")).filter(F.col("near") >= hits)
