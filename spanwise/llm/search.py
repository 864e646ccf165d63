"""Exact top-k inner-product search by norm-bucketed retrieval.

Vectors are grouped by length: a bucket holds norms within a fixed ratio, and a large
bucket is split by a hash of the id into blocks of a few thousand vectors, so that no
task depends on how the norms are spread.  Queries go in blocks too.  One block of large
norm gives every query a first threshold (its k-th score there, a lower bound of the true
one).  Then each pair of a query block and a vector block that can still matter is one
row of an equi-join on the block's key; for each query in it the local cosine threshold
theta / (|q| * longest norm of the block) chooses how to prune:

* above 1: nothing in the block can reach theta;
* at least ``coordinate_from``: coordinate pruning, a vector stays only if its few focus
  coordinates lie in the range that this cosine allows;
* else: length pruning, only vectors with |p| >= theta / |q|, a prefix of the block.

What is left is verified by exact integer products, and the best k per query are merged.

Vectors that are null or hold a null or non-finite component take no part, nor do rows
without an id; vectors of different dimension are not compared.  Candidates with the
query's own id are left out.  Repeated query ids are one query (its largest vector in
array order); repeated candidate rows count as rows of their own.  Ties go to the smaller
id.  A component beyond the range of long integers counts as that range's end, and so does
a score; all scores within it are exact.  Extra columns are ignored, whatever their names;
an empty table gives none.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import ensure_checkpoint_dir, read_table, released

#: Components of one candidate block and of one query block, ratio of norms in a bucket.  A
#: query block travels to every candidate block it may have hits in, so those are the larger.
BLOCK_COMPONENTS, QUERY_COMPONENTS, NORM_RATIO = 2_000_000, 200_000, 1.02
FOCUS = 4

BLOCK = "dim int, bucket int, part int, ids binary, vectors binary"
QUERY_BLOCK = "dim int, query_part int, ids binary, vectors binary, theta binary, longest double, least_theta double"
HITS = "query_id long, vec_id long, score long"


def quantise(vectors: DataFrame, id_column: str, column: str, scale: int = 64) -> DataFrame:
    """Vectors floor(scale * x), with dimension, norm and norm bucket; rows that take no part are dropped."""
    x = F.col(column)
    good = F.col(id_column).isNotNull() & x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < F.lit(math.inf)))
    values = F.transform(x, lambda v: F.floor(v.cast("double") * scale).cast("long"))
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))
    return (
        vectors.filter(F.coalesce(good, F.lit(False)))
        .select(F.col(id_column).cast("long").alias("vec_id"), values.alias("vector"))
        .withColumn("dim", F.size("vector"))
        .withColumn("norm", norm)
        .withColumn("bucket", F.when(F.col("norm") > 0, F.floor(F.log("norm") / math.log(NORM_RATIO))).otherwise(-(10**6)).cast("int"))
    )


def _matrix(table: pa.Table, dim: int) -> np.ndarray:
    return table["vector"].combine_chunks().flatten().to_numpy().reshape(table.num_rows, dim)


def _pack(matrix: np.ndarray) -> bytes:
    small = not matrix.size or (matrix.max() < 1 << 31 and matrix.min() > -(1 << 31))
    return (b"4" if small else b"8") + np.ascontiguousarray(matrix, "<i4" if small else "<i8").tobytes()


def _unpack(raw: bytes, dim: int, rows: int) -> np.ndarray:
    small = raw[:1] == b"4"
    matrix = np.frombuffer(raw, "<i4" if small else "<i8", offset=1).reshape(rows, dim)
    return matrix.astype(np.float64) if small else matrix


def _block(table: pa.Table) -> pa.Table:
    """Pack a block's vectors, longest first."""
    dim, bucket, part = (table[c][0].as_py() for c in ("dim", "bucket", "part"))
    matrix, ids = _matrix(table, dim), table["vec_id"].to_numpy()
    order = np.lexsort((ids, -table["norm"].to_numpy()))
    return pa.table({"dim": pa.array([dim], pa.int32()), "bucket": pa.array([bucket], pa.int32()), "part": pa.array([part], pa.int32()), "ids": [ids[order].astype("<i8").tobytes()], "vectors": [_pack(matrix[order])]})


def _query_block(table: pa.Table) -> pa.Table:
    dim, part = table["dim"][0].as_py(), table["query_part"][0].as_py()
    ids = table["vec_id"].to_numpy()
    theta = np.full(len(ids), -np.inf)
    longest = float(table["norm"].to_numpy().max())
    return pa.table({"dim": pa.array([dim], pa.int32()), "query_part": pa.array([part], pa.int32()), "ids": [ids.astype("<i8").tobytes()], "vectors": [_pack(_matrix(table, dim))], "theta": [theta.tobytes()], "longest": [longest], "least_theta": [-math.inf]})


def products(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Exact integer inner products: in doubles while no partial sum can leave their exact range, else in integers."""
    bound = (np.abs(q.astype(np.float64)).max() if q.size else 0) * (np.abs(p.astype(np.float64)).max() if p.size else 0) * q.shape[1]
    if bound < 2**53:
        return (q.astype(np.float64, copy=False) @ p.T.astype(np.float64, copy=False)).astype(np.int64)
    q, p = q.astype(np.int64), p.astype(np.int64)
    if bound < 2**63:
        return q @ p.T
    return np.clip(q.astype(object) @ p.T.astype(object), -(2**63), 2**63 - 1).astype(np.int64)


def retrieve(q: np.ndarray, q_ids: np.ndarray, theta: np.ndarray, p: np.ndarray, p_ids: np.ndarray, k: int, coordinate_from: float = 0.6) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """For each query with something in the block: its row, and the ids and scores of at most its k best."""
    if not len(p_ids):
        return []
    q_norm, p_norm = (np.linalg.norm(x.astype(np.float64, copy=False), axis=1) for x in (q, p))
    longest = p_norm[0]
    with np.errstate(divide="ignore", invalid="ignore"):
        need = np.where(theta > 0, theta / q_norm, -np.inf)  # least norm that can reach theta
        cosine = np.where(theta > 0, need / longest, -1.0)
    slack = 1e-9
    live = ~(cosine > 1 + slack)
    by_coordinate = live & (cosine >= coordinate_from)
    found: list[tuple[int, np.ndarray, np.ndarray]] = []

    def best(row: int, ids: np.ndarray, scores: np.ndarray) -> None:
        keep = (scores >= theta[row]) & (ids != q_ids[row])
        ids, scores = ids[keep], scores[keep]
        if len(ids):
            order = np.lexsort((ids, -scores))[:k]
            found.append((row, ids[order], scores[order]))

    unit = p / np.maximum(p_norm, 1e-300)[:, None] if by_coordinate.any() else None
    for row in np.flatnonzero(by_coordinate):
        x, t = q[row] / q_norm[row], min(1.0, float(cosine[row]) - slack)
        keep = p_norm >= need[row] * (1 - slack)
        for f in np.argsort(-np.abs(x))[:FOCUS]:
            wide = math.sqrt(max(0.0, (1 - t * t) * (1 - x[f] * x[f]))) + slack
            if x[f] < t:  # else the axis itself is near enough: no upper bound
                keep &= unit[:, f] <= x[f] * t + wide
            if x[f] > -t:  # else its opposite is: no lower bound
                keep &= unit[:, f] >= x[f] * t - wide
        at = np.flatnonzero(keep)
        if len(at):
            best(row, p_ids[at], products(q[row : row + 1], p[at])[0])
    rows = np.flatnonzero(live & ~by_coordinate)
    if len(rows):
        longest_first = -p_norm
        reach = np.searchsorted(longest_first, -need[rows] * (1 - slack), side="right")
        rows, reach = rows[reach > 0], reach[reach > 0]
    for at in range(0, len(rows), 128):
        some, upto = rows[at : at + 128], int(reach[at : at + 128].max())
        scores = products(q[some], p[:upto])
        for i, row in enumerate(some):
            others = np.flatnonzero(p_ids[:upto] != q_ids[row])
            s = scores[i][others]
            if len(s) > 8 * k:  # only those that reach the k-th score are sorted
                near = s >= np.partition(s, len(s) - k)[len(s) - k]
                s, others = s[near], others[near]
            best(row, p_ids[others], s)
    return found


def _thresholds(k: int):
    """Give each query block its thresholds from the first vector block."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids, p_ids = np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["p_ids"] or b"", "<i8")
                theta = np.frombuffer(r["theta"], np.float64).copy()
                if r["p_vectors"] is not None:
                    q, p = _unpack(r["vectors"], r["dim"], len(ids)), _unpack(r["p_vectors"], r["dim"], len(p_ids))
                    for row, _, scores in retrieve(q, ids, theta, p, p_ids, k):
                        if len(scores) == k:
                            theta[row] = scores[-1]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["dim"]], pa.int32()), pa.array([r["query_part"]], pa.int32()), pa.array([r["ids"]], pa.binary()), pa.array([r["vectors"]], pa.binary()), pa.array([theta.tobytes()], pa.binary()), pa.array([r["longest"]]), pa.array([float(theta.min())])],
                    names=["dim", "query_part", "ids", "vectors", "theta", "longest", "least_theta"],
                )

    return run


def _pairs(k: int, coordinate_from: float):
    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids, p_ids = np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["p_ids"], "<i8")
                q, p = _unpack(r["vectors"], r["dim"], len(ids)), _unpack(r["p_vectors"], r["dim"], len(p_ids))
                found = retrieve(q, ids, np.frombuffer(r["theta"], np.float64), p, p_ids, k, coordinate_from)
                if found:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate([np.full(len(i), ids[row]) for row, i, _ in found])), pa.array(np.concatenate([i for _, i, _ in found])), pa.array(np.concatenate([s for _, _, s in found]))],
                        names=["query_id", "vec_id", "score"],
                    )

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, scale: int = 64, id_column: str = "vec_id", column: str = "embedding", coordinate_from: float = 0.6) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products of each query, ties to the smaller id."""
    spark = vectors.sparkSession
    ensure_checkpoint_dir(spark)
    points = quantise(vectors, id_column, column, scale)
    asked = quantise(queries, id_column, column, scale).groupBy("vec_id").agg(F.max(F.struct("vector", "dim", "norm")).alias("q")).select("vec_id", "q.*")
    # dimensions and norm buckets are few: a norm of double range falls into a few ten thousand at most
    counts = sorted(points.groupBy("dim", "bucket").count().collect(), key=lambda r: -r["bucket"])
    if not counts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    parts = {(r["dim"], r["bucket"]): -(-r["count"] * max(r["dim"], 1) // BLOCK_COMPONENTS) for r in counts}
    first = {}
    for r in counts:  # per dimension the bucket of largest norms that fills a part of a block, else the fullest
        at = first.get(r["dim"])
        if at is None or at["count"] < min(r["count"], BLOCK_COMPONENTS // max(r["dim"], 1) // 32):
            first[r["dim"]] = r
    sizes = spark.createDataFrame([(d, b, n) for (d, b), n in parts.items()], "dim int, bucket int, parts int")
    dealt = points.join(F.broadcast(sizes), ["dim", "bucket"]).withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int"))
    blocks = dealt.select("dim", "bucket", "part", "vec_id", "norm", "vector").groupBy("dim", "bucket", "part").applyInArrow(_block, BLOCK).checkpoint()
    query_parts = max(1, -(-(asked.agg(F.sum("dim")).first()[0] or 0) // QUERY_COMPONENTS))
    query_blocks = (
        asked.withColumn("query_part", F.pmod(F.xxhash64("vec_id"), F.lit(query_parts)).cast("int"))
        .select("dim", "query_part", "vec_id", "norm", "vector").groupBy("dim", "query_part").applyInArrow(_query_block, QUERY_BLOCK)
    )
    candidate = blocks.select("dim", "bucket", "part", F.col("ids").alias("p_ids"), F.col("vectors").alias("p_vectors"))
    of_first = spark.createDataFrame([(d, r["bucket"]) for d, r in first.items()], "dim int, bucket int")
    # one block per dimension, of about BLOCK_COMPONENTS: a bounded side
    seeds = candidate.filter("part = 0").join(F.broadcast(of_first), ["dim", "bucket"]).drop("bucket", "part")
    query_blocks = query_blocks.join(F.broadcast(seeds), "dim", "left").mapInArrow(_thresholds(k), QUERY_BLOCK)
    listed = F.broadcast(sizes.groupBy("dim").agg(F.collect_list(F.struct("bucket", "parts")).alias("buckets")))
    reach = F.col("longest") * F.pow(F.lit(NORM_RATIO), F.col("bucket") + 1) * (1 + 1e-9)
    pairs = (
        query_blocks.join(listed, "dim").withColumn("b", F.explode("buckets")).select("*", "b.bucket", "b.parts").drop("b", "buckets")
        .filter((F.col("least_theta") <= 0) | (reach >= F.col("least_theta")))
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .join(candidate, ["dim", "bucket", "part"])
    )
    hits = pairs.select("dim", "ids", "vectors", "theta", "p_ids", "p_vectors").mapInArrow(_pairs(k, coordinate_from), HITS)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(vectors, vectors.filter(F.col("vec_id") % 20 == 0))


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS z
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, p.vec_id, CAST(list_dot_product(q.z, p.z) AS BIGINT) AS score
  FROM v q JOIN v p ON q.vec_id % 20 = 0 AND p.vec_id <> q.vec_id
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 20
"""
