"""A training corpus from raw documents: five stages, each written as Parquet and read again by the next.

Toxic documents go, then all but one of each group of near copies, then long passages that
an earlier document has too; sources are mixed to target weights, and what is left is
packed into sequences for training.

Near copies share 80 % of their five-word shingles, as for all stages on word shingles (the
query op6_setsketch_near_dedup takes four, as its contract says).

Each stage takes any table with doc_id, text and source, and all but the last give back its
columns, whatever their names.  Null and empty texts: never toxic beyond the score of no
evidence, near copies of nothing, without passages, of size 0 and so in no mix.  Null doc_ids
count as smaller than all others and as one document.  Repeated rows: scored alike, all but
the rows of the smallest doc_id go as near copies (rows that repeat under that very doc_id
stay), mixed alike.  Very long texts are worked on whole.  An empty table gives an empty one.
Stages are written as Parquet under the shared checkpoint folder, in a folder of their own
for each run; a stage's table goes once the next stage has written its own.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from spanwise.llm import mixing, near_dedup, packing, suffix_dedup, toxicity
from spanwise.llm.common import ensure_checkpoint_dir, read_table
from spanwise.operators.checkpoints import remove


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels"))
    fresh = "_" * (1 + max(len(c) for c in docs.columns))  # names that no column has
    scored = toxicity.score_documents(docs, model, docs.columns, names=(f"{fresh}score", f"{fresh}toxic"))
    return scored.filter(F.col(f"{fresh}toxic") == 0).select(*docs.columns)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = near_dedup.near_duplicates(docs)
    first = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_first")).distinct()
    return docs.join(first, docs["doc_id"].cast("long").eqNullSafe(first["_first"]), "left_semi")


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    others = F.struct(*[c for c in docs.columns if c not in ("text", "n_chars")]).alias("_row")
    kept = suffix_dedup.remove_repeats(docs.select("doc_id", "text", others), whole_characters=True)
    text = F.col("kept").cast("string")
    chars = [F.length(text).cast(docs.schema["n_chars"].dataType).alias("n_chars")] if "n_chars" in docs.columns else []
    return kept.select("_row.*", text.alias("text"), *chars).select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", without_toxic),
    ("near_dedup", without_near_copies),
    ("suffix_array_dedup", without_repeated_passages),
    ("mixing", mixed),
    ("packing", packed),
]

#: No stage but the mixing's sums can be said in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/corpus-{uuid.uuid4().hex}"
    docs, earlier = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if earlier:  # what the next stage has taken over is no longer needed
            remove(spark, f"{folder}/{earlier}")
        earlier = name
    return docs
