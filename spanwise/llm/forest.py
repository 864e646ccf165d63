"""Approximate nearest neighbours by a hash-prefix forest (largest inner product).

Every vector has one long hash string per tree: symbols that name the axis, and its sign,
to which a random projection of the vector is nearest (lengths enter as one more component,
which makes the largest product the smallest angle).  A tree is a sorted array of its
strings; what shares a prefix is a range of it.

1. strings: the distinct strings of each tree with their counts, in pages by their first bits;
2. descent: in its page of each tree a query's string finds, by binary search, how many
   vectors share its first 28, 27, ... 0 bits;
3. ascent: all trees of a query go up together, bit by bit, until they hold enough
   candidates.  How many are enough is measured: for a bounded sample of the queries
   (``SAMPLE``) the true neighbours are found by brute force over all vectors, and the least
   number is taken at which these meet their neighbours as often as ``recall`` asks; no
   number is enough for fewer than k others, and where none is, everything is a candidate;
4. candidates: each tree's range goes, with the query, to the pages of vectors that it
   touches.  There the slice of the sorted array is multiplied with the query, in double
   precision, and the k best of each tree are merged.

Pages hold a few thousand vectors each.  Where many vectors crowd into one, it is cut by
further bits, and by a hash of the id where even whole strings are equal.  Of equal vectors
only the k + 1 smallest ids are indexed: no query can have more of them among its k, as ties
go to the smaller id.  Each vector is shuffled once for every tree.

Vectors that are null, zero or hold a null or non-finite component take no part, nor do
rows without an id; vectors of different dimension are not compared.  A query's own id is no
candidate.  Repeated query ids are one query (its largest vector in array order); rows that
repeat id and vector are one candidate, rows that repeat an id with other vectors are
candidates of their own.  Scores are sums in order of components.  Extra columns are ignored,
whatever their names; an empty table gives none.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..operators.checkpoints import Rounds
from .common import read_table, released, worker_state

#: Trees, symbols of a string and axes of a projection (a symbol is an axis and a sign).
TREES, SYMBOLS, AXES = 16, 4, 64
SYMBOL_BITS = AXES.bit_length()
BITS = SYMBOLS * SYMBOL_BITS
#: First bits by which the strings of a tree are dealt for the descent.
STRING_PAGE = 10
#: Vectors of a page, aimed at and at most.
PAGE, FULL_PAGE = 4096, 4 * 4096
#: Queries for which the ascent is measured.
SAMPLE = 64
SEED = 11
POINTS = "id long, vector array<{kind}>, dim int, strings array<int>"
HITS = "query_id long, vec_id long, score double"


def _by_dim(batch: pa.RecordBatch, column: str = "vector") -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Dimension, rows and matrix of the vectors of each dimension."""
    lists = batch.column(column)
    flat, ends = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
    sizes = np.diff(ends)
    for dim in np.unique(sizes):
        rows = np.flatnonzero(sizes == dim)
        yield int(dim), rows, flat[(ends[rows][:, None] + np.arange(dim)).ravel()].reshape(len(rows), dim)


def _projections(dim: int) -> np.ndarray:
    kept = worker_state().setdefault("projections", {})
    if dim not in kept:
        kept.clear()
        kept[dim] = np.random.default_rng([SEED, dim]).standard_normal((dim + 1, TREES * SYMBOLS * AXES)).astype(np.float32)
    return kept[dim]


def hash_strings(vectors: np.ndarray, longest: float, query: bool) -> np.ndarray:
    """(rows, TREES) strings as integers of BITS bits; queries are taken at unit length."""
    lifted = np.zeros((len(vectors), vectors.shape[1] + 1), np.float32)
    scaled = vectors / (np.abs(vectors).max(axis=1, keepdims=True) if query else longest)
    lifted[:, :-1] = scaled / np.linalg.norm(scaled, axis=1, keepdims=True) if query else scaled
    if not query:
        lifted[:, -1] = np.sqrt(np.maximum(0.0, 1.0 - (scaled * scaled).sum(axis=1)))
    out = np.empty((len(vectors), TREES), np.int32)
    for at in range(0, len(vectors), 512):
        y = (lifted[at : at + 512] @ _projections(vectors.shape[1])).reshape(-1, TREES, SYMBOLS, AXES)
        axis = np.abs(y).argmax(axis=3)
        negative = np.take_along_axis(y, axis[..., None], axis=3)[..., 0] < 0
        symbol = (negative.astype(np.int64) << (SYMBOL_BITS - 1)) | axis
        out[at : at + 512] = (symbol << (SYMBOL_BITS * np.arange(SYMBOLS - 1, -1, -1))).sum(axis=2)
    return out


def _hashed(longest: float, query: bool):
    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            strings, dims = np.zeros((batch.num_rows, TREES), np.int32), np.zeros(batch.num_rows, np.int32)
            for dim, rows, matrix in _by_dim(batch):
                strings[rows], dims[rows] = hash_strings(matrix, longest, query), dim
            lists = pa.ListArray.from_arrays(np.arange(0, strings.size + 1, TREES, dtype=np.int32), strings.ravel())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("vector"), pa.array(dims), lists], names=["id", "vector", "dim", "strings"])

    return run


def shared_bits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits of the longest common prefix of two strings."""
    return BITS - np.frexp((a ^ b).astype(np.float64))[1]


def _descended(left: pa.Table, right: pa.Table) -> pa.Table:
    """For each query of a page: how many vectors share its first 0 to BITS bits."""
    strings, n = left["string"].to_numpy(), left["n"].to_numpy()
    real = strings >= 0
    above = left["above"].to_pylist()[int(np.flatnonzero(~real)[0])] if (~real).any() else [0] * STRING_PAGE
    order = np.argsort(strings[real], kind="stable")
    strings, upto = strings[real][order], np.concatenate([[0], np.cumsum(n[real][order])])
    asked = right["string"].to_numpy()
    counts = np.empty((len(asked), BITS + 1), np.int64)
    counts[:, :STRING_PAGE] = above
    for bits in range(STRING_PAGE, BITS + 1):
        low = (asked >> (BITS - bits)) << (BITS - bits)
        counts[:, bits] = upto[np.searchsorted(strings, low + (1 << (BITS - bits)))] - upto[np.searchsorted(strings, low)]
    lists = pa.ListArray.from_arrays(np.arange(0, counts.size + 1, BITS + 1, dtype=np.int32), counts.ravel())
    return pa.table({"id": right["id"], "counts": lists})


def _exact(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Inner products of pairs of rows, summed in order of components."""
    return np.add.accumulate(q * p, axis=1)[:, -1]


def _best(scores: np.ndarray, q: np.ndarray, q_ids: np.ndarray, p: np.ndarray, p_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, columns and exact scores of each row's k best (ties to the smaller id); what is no candidate scores -inf."""
    need = np.full(len(scores), -np.inf)
    if scores.shape[1] > k:
        need = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
        need = need - 1e-9 * np.maximum(1e-300, np.linalg.norm(q, axis=1) * np.linalg.norm(p, axis=1).max())
    row, col = np.nonzero((scores >= need[:, None]) & (scores > -np.inf))
    exact = _exact(q[row], p[col]) if len(row) else np.zeros(0)
    order = np.lexsort((p_ids[col], -exact, row))
    row, col, exact = row[order], col[order], exact[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    return row[rank < k], col[rank < k], exact[rank < k]


def _neighbours_of(sample: list, k: int):
    """True neighbours, as far as a batch goes, of a few queries, and the longest prefix that some tree shares with each."""
    ids = np.array([r["id"] for r in sample], np.int64)
    strings = np.array([r["strings"] for r in sample], np.int32)
    vectors = [np.array(r["vector"], np.float64) for r in sample]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p_ids, p_strings = batch.column("id").to_numpy(), batch.column("strings").flatten().to_numpy().reshape(-1, TREES)
            for dim, rows, matrix in _by_dim(batch):
                asked = [i for i, v in enumerate(vectors) if len(v) == dim]
                if not asked:
                    continue
                q, q_ids = np.array([vectors[i] for i in asked]), ids[asked]
                scores = q @ matrix.T
                scores[q_ids[:, None] == p_ids[rows][None]] = -np.inf
                row, col, exact = _best(scores, q, q_ids, matrix, p_ids[rows], k)
                level = shared_bits(strings[asked][row], p_strings[rows[col]]).max(axis=1) if len(row) else np.zeros(0)
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[row]), pa.array(p_ids[rows[col]]), pa.array(exact), pa.array(level, pa.int32())], names=["query_id", "vec_id", "score", "level"])

    return run


def enough(levels: dict[int, list[int]], counts: dict[int, list[int]], least: int, recall: float) -> int | None:
    """The least number of candidates at which so many true neighbours are met; None: everything is a candidate."""
    wanted, total = least, sum(len(x) for x in levels.values())
    while any(c[0] >= wanted for c in counts.values()):
        depth = {i: max((x for x in range(BITS + 1) if c[x] >= wanted), default=0) for i, c in counts.items()}
        if sum(level >= depth[i] for i, found in levels.items() for level in found) >= recall * total:
            return wanted
        wanted = -(-wanted * 5 // 4)
    return None


_KEY = ["dim", "tree", "bits", "sub", "part"]


def _verified(k: int):
    """The k best of each query in each page's slice; a page's vectors come first and sorted, then its queries."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts, page = None, [], None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in (*_KEY, "kind")])
            cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                matrix = part.column("vector").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b - a, int(keys[0, a]))
                low, high, ids = (part.column(c).to_numpy() for c in ("low", "high", "id"))
                if (now := tuple(keys[:-1, a])) != key:
                    key, parts, page = now, [], None
                if keys[-1, a] == 0:
                    parts.append((low, ids, matrix))
                    continue
                if not parts:
                    continue
                if page is None:
                    page = [np.concatenate(x) for x in zip(*parts, strict=True)]
                strings, p_ids, p = page
                for at in range(0, len(ids), 128):
                    q, q_ids = matrix[at : at + 128], ids[at : at + 128]
                    begin, end = np.searchsorted(strings, low[at : at + 128]), np.searchsorted(strings, high[at : at + 128])
                    first, last = int(begin.min()), int(end.max())
                    if first >= last:
                        continue
                    place = np.arange(first, last)[None]
                    scores = q @ p[first:last].T
                    scores[(place < begin[:, None]) | (place >= end[:, None]) | (p_ids[first:last][None] == q_ids[:, None])] = -np.inf
                    row, col, exact = _best(scores, q, q_ids, p[first:last], p_ids[first:last], k)
                    if len(row):
                        yield pa.RecordBatch.from_arrays([pa.array(q_ids[row]), pa.array(p_ids[first:last][col]), pa.array(exact)], names=["query_id", "vec_id", "score"])

    return run


def _directory(strings: DataFrame, bits: int, rounds: Rounds) -> tuple[DataFrame, DataFrame]:
    """Pages of vectors (dim, tree, page, bits), by how many bits each is cut, and parts of those that are full even so."""
    page = F.shiftright("string", BITS - bits)
    sizes = strings.groupBy("dim", "tree", page.alias("page")).agg(F.sum("n").alias("n"))
    more = F.least(F.lit(BITS - bits), F.ceil(F.log2(F.col("n") / PAGE)))
    pages = rounds.keep(sizes.select("dim", "tree", "page", (F.lit(bits) + F.when(F.col("n") > FULL_PAGE, more).otherwise(0)).cast("int").alias("bits")), "pages")
    crowded = strings.withColumn("page", page).join(pages.filter(F.col("bits") > bits), ["dim", "tree", "page"])
    subs = crowded.groupBy("dim", "tree", "bits", F.expr(f"shiftright(string, {BITS} - bits)").alias("sub")).agg(F.sum("n").alias("n")).filter(F.col("n") > FULL_PAGE)
    return pages, rounds.keep(subs.select("dim", "tree", "bits", "sub", F.ceil(F.col("n") / PAGE).cast("int").alias("parts")), "parts")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, recall: float = 0.95, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: k near neighbours of each query, by inner product, ties to the smaller id."""
    spark = vectors.sparkSession
    rounds = Rounds(spark)
    x = F.col(column)
    good = F.col(id_column).isNotNull() & x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < F.lit(math.inf))) & F.exists(x, lambda v: v != 0)
    kind = "float" if "float" in vectors.schema[column].dataType.simpleString() else "double"

    def taken(rows: DataFrame) -> DataFrame:
        return rows.filter(F.coalesce(good, F.lit(False))).select(F.col(id_column).cast("long").alias("id"), x.cast(f"array<{kind}>").alias("vector"))

    # of equal vectors the k + 1 smallest ids: the limit is applied before the shuffle as well
    copies = Window.partitionBy("vector").orderBy("id")
    points = taken(vectors).distinct().withColumn("_copy", F.row_number().over(copies)).filter(F.col("_copy") <= k + 1).drop("_copy")
    points = rounds.keep(points, "vectors")
    most = F.array_max(F.transform("vector", lambda v: F.abs(v.cast("double"))))
    length = F.col("most") * F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, v: s + F.pow(v.cast("double") / F.col("most"), 2)))
    longest, n = points.withColumn("most", most).agg(F.max(length), F.count(F.lit(1))).first()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    schema = POINTS.format(kind=kind)
    points = rounds.keep(points.mapInArrow(_hashed(float(longest), False), schema), "points")
    asked = taken(queries).groupBy("id").agg(F.max("vector").alias("vector"))
    asked = rounds.keep(asked.mapInArrow(_hashed(float(longest), True), schema), "queries")

    # 1. sorted strings with counts; a page's first row has the counts of its shorter prefixes
    tree = F.posexplode("strings").alias("tree", "string")
    strings = rounds.keep(points.select("dim", tree).groupBy("dim", "tree", F.col("string").cast("long").alias("string")).agg(F.count(F.lit(1)).alias("n")), "strings")
    page = F.shiftright("string", BITS - STRING_PAGE).alias("page")
    filled = strings.groupBy("dim", "tree", page).agg(F.sum("n").alias("n"))
    every = strings.select("dim", "tree").distinct().select("dim", "tree", F.explode(F.expr(f"sequence(0L, {(1 << STRING_PAGE) - 1}L)")).alias("page"))
    above = [F.sum(F.coalesce("n", F.lit(0))).over(Window.partitionBy("dim", "tree", F.shiftright("page", STRING_PAGE - b))) for b in range(STRING_PAGE)]
    heads = every.join(filled, ["dim", "tree", "page"], "left").select("dim", "tree", "page", F.lit(-1).cast("long").alias("string"), F.lit(0).cast("long").alias("n"), F.array(*above).alias("above"))
    dealt = strings.select("dim", "tree", page, "string", "n", F.lit(None).cast("array<long>").alias("above")).unionByName(heads)

    # 2. descent
    by_tree = asked.select("id", "dim", tree).select("id", "dim", "tree", F.col("string").cast("long").alias("string"), page)
    keys = ["dim", "tree", "page"]
    found = dealt.groupBy(*keys).cogroup(by_tree.groupBy(*keys)).applyInArrow(_descended, "id long, counts array<long>")
    sums = rounds.keep(found.groupBy("id").agg(F.array(*[F.sum(F.col("counts")[b]) for b in range(BITS + 1)]).alias("counts")), "counts")

    # 3. ascent
    sample = asked.join(sums, "id").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    true = points.mapInArrow(_neighbours_of(sample, k), f"{HITS}, level int").withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    levels: dict[int, list[int]] = {r["id"]: [] for r in sample}
    for r in true.select("query_id", "level").collect():  # k rows for each query of the sample
        levels[r["query_id"]].append(r["level"])
    wanted = enough(levels, {r["id"]: r["counts"] for r in sample}, TREES * (k + 1), recall)
    reached = [F.when(F.col("counts")[b] >= (wanted or 1 << 62), b) for b in range(BITS, 0, -1)]
    ranges = asked.join(sums.select("id", F.coalesce(*reached, F.lit(0)).alias("depth")), "id").select("id", "vector", "dim", "depth", tree)
    ranges = ranges.filter("depth > 0 or tree = 0").withColumn("string", F.col("string").cast("long"))  # at the root any tree has all
    ranges = ranges.withColumn("low", F.expr(f"shiftleft(shiftright(string, {BITS} - depth), {BITS} - depth)")).withColumn("high", F.expr(f"low + shiftleft(1L, {BITS} - depth)"))

    # 4. candidates
    bits = min(20, max(0, math.ceil(math.log2(n / PAGE))))
    pages, parts = _directory(strings, bits, rounds)
    sub_key = ["dim", "tree", "bits", "sub"]
    placed = points.select("id", "vector", "dim", tree).withColumn("low", F.col("string").cast("long")).withColumn("page", F.shiftright("low", BITS - bits))
    placed = placed.join(pages, keys).withColumn("sub", F.expr(f"shiftright(low, {BITS} - bits)")).join(parts, sub_key, "left")
    rows = placed.select("dim", "tree", "bits", "sub", F.pmod(F.xxhash64("id"), F.coalesce("parts", F.lit(1))).cast("int").alias("part"), F.lit(0).alias("kind"), "low", F.col("low").alias("high"), "id", "vector")
    over = ranges.withColumn("page", F.explode(F.sequence(F.shiftright("low", BITS - bits), F.shiftright(F.col("high") - 1, BITS - bits)))).join(pages, keys)
    begin, end = f"greatest(low, shiftleft(page, {BITS - bits}))", f"least(high, shiftleft(page + 1, {BITS - bits})) - 1"
    over = over.withColumn("sub", F.explode(F.expr(f"sequence(shiftright({begin}, {BITS} - bits), shiftright({end}, {BITS} - bits))"))).join(parts, sub_key, "left")
    over = over.select("dim", "tree", "bits", "sub", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"), F.lit(1).alias("kind"), "low", "high", "id", "vector")
    together = rows.unionByName(over).repartition(*_KEY).sortWithinPartitions(*_KEY, "kind", "low")
    hits = together.mapInArrow(_verified(k), HITS).distinct()
    return hits.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(vectors, vectors.filter(F.col("vec_id") % 20 == 0))
