"""Cases where a cut, a bound or a guard of the training-data operators once gave less than the whole job."""

import random

import numpy as np
from pyspark.sql import functions as F

from spanwise.llm import near_dedup, recompression, search, suffix_dedup


def test_stretches_that_agree_in_32_bits_of_digest_are_not_equal(spark):
    # found by search: one anchor, and digests that agreed in the 32 bits once carried
    head = "the quick brown fox jumps over lazy dogs "
    docs = spark.createDataFrame([(0, head + "8964239488"), (1, head + "9854619114")], "doc_id long, text string")
    assert [r.n_removed for r in suffix_dedup.remove_repeats(docs, width=51).collect()] == [0, 0]
    head = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen "
    docs = spark.createDataFrame([(0, head + "w193240"), (1, head + "w305096")], "doc_id long, text string")
    assert [r.n_removed for r in recompression.remove_repeats(docs).collect()] == [0, 0]


def test_coordinate_pruning_keeps_vectors_near_a_dominant_coordinate():
    rng = np.random.default_rng(4)
    for sign in (1, -1):
        p = np.round(rng.normal(size=(300, 6)) * 20)
        p[:, 2] = sign * np.round(rng.uniform(0, 1000, 300))
        p[0] = [0, 0, sign * 1000, 0, 0, 0]
        p = p[np.argsort(-np.linalg.norm(p, axis=1), kind="stable")]
        q = np.array([[436, 0, sign * 900, 0, 0, 0], [0, 0, sign * 1000, 1, 0, 0]], float)
        exact = search.products(q, p)
        theta = 0.6 * np.linalg.norm(q, axis=1) * np.linalg.norm(p, axis=1)[0]
        found = {row: sorted(ids.tolist()) for row, ids, _ in search.retrieve(q, np.array([-1, -2]), theta, p, np.arange(300), 300)}
        assert found == {row: np.flatnonzero(exact[row] >= theta[row]).tolist() for row in range(2)}
        assert all(found.values())


def test_no_gram_is_sorted_whole_however_many_stretches_it_has(spark, monkeypatch):
    rows = spark.range(10000).select(F.lit(7).cast("long").alias("name"), F.xxhash64("id").alias("digest"), F.col("id").alias("doc"), F.lit(0).cast("long").alias("span"))
    count = lambda flag: F.sum(F.size(F.filter("spans", lambda x: x.bitwiseAND(F.lit(3)) == flag)))
    flagged = suffix_dedup.repeats_by_gram(rows).agg(count(1).alias("sorted"), count(2).alias("hot")).first()
    assert (flagged["sorted"], flagged["hot"]) == (0, 10000)
    monkeypatch.setattr(suffix_dedup, "HOT", 8)
    rng = random.Random(5)
    noise = lambda: "".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(40, 90)))
    passage = "a passage that many documents hold in surroundings of their own, and no two alike"
    texts = [noise() + passage + noise() for _ in range(60)] + [passage[:55] + noise(), passage + passage]
    owner, want = {}, {}
    for ident, text in enumerate(texts):
        gone = [False] * len(text)
        for i in range(len(text) - 49):
            if owner.setdefault(text[i : i + 50], ident) != ident:
                gone[i : i + 50] = [True] * 50
        want[ident] = "".join(c for c, g in zip(text, gone) if not g).encode()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert {r.doc_id: bytes(r.kept) for r in suffix_dedup.remove_repeats(docs).collect()} == want


def test_a_very_long_document_is_worked_on_whole(spark):
    rng = random.Random(6)
    words = [f"w{rng.randrange(100_000)}" for _ in range(150_000)]
    tail = " ".join(words[-30:])
    docs = spark.createDataFrame([(1, " ".join(words)), (2, "start " + tail), (3, " ".join(words[:-1] + ["other"]))], "doc_id long, text string")
    found = {r.doc_id: r.n_removed for r in recompression.remove_repeats(docs).collect()}
    assert found == {1: 0, 2: 30, 3: 149_999}
    kept = {r.doc_id: (r.n_removed, bytes(r.kept)) for r in suffix_dedup.remove_repeats(docs).collect()}
    assert kept[1][0] == 0 and kept[2][1] == b"start" and kept[3][1] == b"other"
    near = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(docs).collect()}
    assert near[1][1] == near[3][1] == 1 and near[2] == (27, 2) and near[1][0] > 149_000
