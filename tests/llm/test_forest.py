"""The hash-prefix forest against brute force."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spanwise.llm import forest


def _brute(rows, queries, k):
    out = {}
    rows = list({(i, tuple(v)): (i, v) for i, v in rows}.values())
    for qid, q in queries:
        scored = []
        for i, v in rows:
            if i != qid and len(v) == len(q):
                total = 0.0
                for a, b in zip(q, v):
                    total += float(a) * float(b)
                scored.append((-total, i))
        out[qid] = [(i, -s) for s, i in sorted(scored)[:k]]
    return out


def _got(found):
    out = {}
    for r in sorted(found.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def test_prefix_counts_of_a_page():
    rng = np.random.default_rng(0)
    page = 5 << (forest.BITS - forest.STRING_PAGE)
    strings = np.unique(page + rng.integers(0, 1 << 8, 40))
    n = rng.integers(1, 4, len(strings))
    asked = page + rng.integers(0, 1 << 9, 30)
    left = pa.table({"string": np.append(strings, -1), "n": np.append(n, 0), "above": pa.array([None] * len(strings) + [[9] * forest.STRING_PAGE], pa.list_(pa.int64()))})
    got = forest._descended(left, pa.table({"id": np.arange(30), "string": asked}))["counts"].to_pylist()
    for q, counts in zip(asked, got):
        assert counts == [9] * forest.STRING_PAGE + [int(n[(strings >> (forest.BITS - b)) == (q >> (forest.BITS - b))].sum()) for b in range(forest.STRING_PAGE, forest.BITS + 1)]
    shared = forest.shared_bits(np.array([0, 5, 1 << 27]), np.array([0, 4, 0]))
    assert shared.tolist() == [forest.BITS, forest.BITS - 1, 0]


def test_few_vectors_are_searched_exactly(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=6) * (1 + i % 3)]) for i in range(50)]
    rows += [(100 + i, [3.0, 0.0, 0.0, 0.0, 0.0, 1.0]) for i in range(40)]  # more copies than a query can have
    rows += [(7, rows[8][1]), (300, [1.0, 2.0]), (301, [2.0, 1.0]), (302, [5.0])] + rows[:5]
    idle = [(None, [1.0] * 6), (400, None), (401, [0.0] * 6), (402, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (403, [float("nan")] * 6), (404, [float("inf")] * 6), (405, [])]
    frame = spark.createDataFrame(rows + idle, "vec_id long, embedding array<float>").withColumn("dim", F.lit("x")).withColumn("tree", F.lit(1)).withColumn("rank", F.lit(0))
    queries = frame.filter("vec_id % 10 = 0 or vec_id > 299")
    want = _brute(rows, [(i, v) for i, v in rows[:5] + rows[5:-5] if i % 10 == 0 or i > 299], 20)
    got = _got(forest.nearest(frame, queries))
    assert got == {q: found for q, found in want.items() if found}
    assert forest.nearest(frame.limit(0), queries).count() == 0 and forest.nearest(frame, queries.limit(0)).count() == 0


@pytest.mark.parametrize("page", [4096, 60])
def test_recall_on_clusters(spark, monkeypatch, page):
    monkeypatch.setattr(forest, "PAGE", page)
    monkeypatch.setattr(forest, "FULL_PAGE", 2 * page)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(60, 24))
    vectors = np.float32(np.concatenate([centres[rng.integers(0, 60, 3500)] + 0.35 * rng.normal(size=(3500, 24)), np.tile(centres[0], (500, 1)) + 1e-7 * rng.normal(size=(500, 24))]) * rng.uniform(0.5, 2, (4000, 1)))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    got = _got(forest.nearest(frame, frame.filter("vec_id % 20 = 0")))
    exact = vectors[::20].astype(float) @ vectors.astype(float).T
    exact[np.arange(200), np.arange(0, 4000, 20)] = -np.inf
    hits = sum(len({i for i, _ in got[20 * j]} & set(np.argsort(-row)[:20].tolist())) for j, row in enumerate(exact))
    assert len(got) == 200 and all(len(x) == 20 for x in got.values()) and hits >= 0.9 * 4000
    for q, found in list(got.items())[:20]:
        assert all(s == pytest.approx(exact[q // 20, i], rel=1e-12) for i, s in found)
