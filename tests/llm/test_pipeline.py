"""The pipeline's stages against brute force on the smallest tables."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_dedup import _brute_components

import corpus_pipeline as pipeline
from spanwise.llm import mixing, toxicity

SF = "/root/testdata/sf0.001"


def _kept_text(rows, width):
    """Texts without bytes that a smaller document's strings cover, whole characters only."""
    owner, out = {}, {}
    for ident, text in sorted(rows):
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for i in range(len(data) - width + 1):
            if owner.setdefault(data[i : i + width], ident) != ident:
                gone[i : i + width] = True
        left, at = [], 0
        for c in text or "":
            n = len(c.encode())
            if not gone[at : at + n].any():
                left.append(c)
            at += n
        out[ident] = "".join(left)
    return out


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_stages_do_what_brute_force_does(spark, tmp_path):
    given, docs = {}, spark.read.parquet(f"{SF}/documents.parquet")
    docs = docs.withColumns({c: F.lit("mine") for c in ("_toxicity", "_toxic", "component_id", "kept", "row", "copies", "size", "counts", "spans")})
    columns = docs.columns
    for name, stage in pipeline.STAGES[:-1]:
        given[name] = docs
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == columns
    rows = {name: [(r.doc_id, r.text) for r in df.collect()] for name, df in given.items()}
    rows["packing"] = [(r.doc_id, r.text) for r in docs.collect()]

    first = given["toxicity"]
    model = toxicity.fit(first, spark.read.parquet(f"{SF}/labels.parquet"))
    clean = {r.doc_id for r in toxicity.score_documents(first, model).collect() if r.predicted == 0}
    assert {i for i, _ in rows["near_dedup"]} == clean
    found = _brute_components(rows["near_dedup"], 5, 80)
    assert {i for i, _ in rows["suffix_array_dedup"]} == {i for i, (_, c) in found.items() if c == i}
    assert dict(rows["mixing"]) == _kept_text(rows["suffix_array_dedup"], 50)
    copies = {r.doc_id: r.copies for r in mixing.decide(given["mixing"]).collect()}
    taken = [i for i, _ in rows["packing"]]
    assert {i: taken.count(i) for i in copies} == copies

    assert {r._toxic for r in docs.select("_toxic").collect()} == {"mine"}
    packed = pipeline.STAGES[-1][1](spark, docs, SF).toPandas()
    assert (packed.groupby("sequence_id")["length"].sum() <= 2048).all()
    assert sorted(packed[packed.piece == 0].doc_id) == sorted(taken)


def test_stages_take_tables_without_rows_or_counts(spark):
    some = spark.createDataFrame([(1, None, "a"), (2, "", None), (None, "one two", "a"), (2, "", None)], "doc_id long, text string, source string")
    for docs in (some, some.limit(0)):
        for _, stage in pipeline.STAGES[1:]:
            docs = stage(spark, docs, SF)
        assert docs.columns[:3] == ["doc_id", "piece", "start"]
        docs.collect()
