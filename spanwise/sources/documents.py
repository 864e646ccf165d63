"""Scene documents, logs of turns, and the sinks that keep them.

Documents are JSON with a fixed schema: strict readers fail on a bad file, lenient ones skip
malformed lines.  Versions are appended, never overwritten; snapshots are named by the digest
of what they hold, so that equal ones are written once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.utils import AnalysisException

KEYS = "array<struct<t:int,v:double,ease:array<double>>>"
ELEMENT = f"struct<id:string,kind:string,role:string,width:double,height:double,text:string,color:string,first:int,last:int,confidence:double,provenance:string,tracks:map<string,{KEYS}>>"
SCENE = (
    "id string, w int, h int, fps double, frames int, background struct<kind:string,value:string,confidence:double>, "
    f"elements array<{ELEMENT}>, groups array<struct<id:string,members:array<string>,reason:string>>, constraints array<struct<pred:string,keep:boolean>>"
)
TURN = "schema string, id string, created_at string, user string, turn struct<status:string,reply:string>"
KNOWN_TRACKS = ("x", "y", "sx", "sy", "rot", "skx", "sky", "opacity", "reveal", "rx", "ry", "z")


def read_scenes(spark: SparkSession, path: str) -> DataFrame:
    """One row per scene document; a document that does not fit the schema fails the read."""
    return spark.read.schema(SCENE).option("multiLine", True).option("mode", "FAILFAST").json(path)


def read_turns(spark: SparkSession, path: str, schema_tag: str) -> DataFrame:
    """Turns of a JSONL log; malformed lines and other schemas are skipped."""
    return spark.read.schema(TURN).option("mode", "DROPMALFORMED").json(path).filter((F.col("schema") == schema_tag) & F.col("id").isNotNull())


def append_turns(turns: DataFrame, path: str) -> None:
    turns.write.mode("append").json(path)


def elements(scenes: DataFrame) -> DataFrame:
    """Exploded elements of each scene."""
    return scenes.select(F.col("id").alias("scene"), F.explode("elements").alias("e")).select("scene", "e.*")


def keys(elements_: DataFrame) -> DataFrame:
    """Exploded track keys: scene, element, prop, t, v, ease."""
    return (
        elements_.select("scene", F.col("id").alias("element"), F.explode("tracks").alias("prop", "keys"))
        .select("scene", "element", "prop", F.explode("keys").alias("k"))
        .select("scene", "element", "prop", "k.*")
    )


def element_faults(elements_: DataFrame) -> DataFrame:
    """Elements that break an invariant, with a code for the first one broken."""
    unordered = F.exists(F.map_values("tracks"), lambda k: F.exists(F.sequence(F.lit(1), F.greatest(F.size(k) - 1, F.lit(1))), lambda i: (F.size(k) > 1) & (F.element_at(k, i + 1)["t"] <= F.element_at(k, i)["t"])))
    unknown = F.exists(F.map_keys("tracks"), lambda p: ~p.isin(*KNOWN_TRACKS))
    empty = F.exists(F.map_values("tracks"), lambda k: F.size(k) == 0)
    code = (
        F.when(F.col("id").isNull(), "no id").when(F.col("first") > F.col("last"), "range").when(~F.col("kind").isin("text", "sprite", "ui", "3d", "group"), "kind")
        .when(unknown, "track name").when(empty, "empty track").when(unordered, "key order")
    )
    return elements_.withColumn("fault", code).filter("fault is not null").select("scene", "id", "fault")


def canonical_digest(*columns: str) -> Column:
    """SHA-256 of the columns as JSON with fixed field order."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def write_snapshots(rows: DataFrame, columns: list[str], path: str) -> DataFrame:
    """Write rows under the digest of their columns, each digest once; returns what was new."""
    spark = rows.sparkSession
    marked = rows.withColumn("digest", canonical_digest(*columns)).dropDuplicates(["digest"])
    try:
        marked = marked.join(spark.read.parquet(path).select("digest"), "digest", "left_anti")
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
    marked.write.mode("append").parquet(path)
    return marked


def write_audit_csv(audit: DataFrame, path: str) -> None:
    """Newest first, nulls empty, with a header."""
    audit.orderBy(F.desc("seq")).na.fill("").write.option("header", True).csv(path)


def create_project(rows: DataFrame, path: str) -> None:
    """Write a project's first rows; one that exists is not overwritten."""
    rows.write.mode("errorifexists").parquet(path)


def append_version(versions: DataFrame, new: DataFrame) -> DataFrame:
    """New version rows with the next ordinal and the last version as parent, ready to append."""
    last = versions.groupBy("project", "scene").agg(F.max("ord").alias("last"), F.max_by("id", "ord").alias("parent"), F.max_by("analysis_file", "ord").alias("inherited"))
    inherit = F.coalesce(new["analysis_file"], F.col("inherited")) if "analysis_file" in new.columns else F.col("inherited")
    return new.join(last, ["project", "scene"], "left").select("project", "scene", (F.coalesce("last", F.lit(-1)) + 1).alias("ord"), "id", "parent", inherit.alias("analysis_file"))


def verify_manifest(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Entries (path, sha256, length) of a manifest that do not match the stored files, and files it lacks."""
    stored = files.select("path", F.sha2("content", 256).alias("stored_sha256"), F.length("content").alias("stored_length"))
    joined = manifest.join(stored, "path", "full_outer")
    fault = F.when(F.col("stored_sha256").isNull(), "missing").when(F.col("sha256").isNull(), "extra").when(F.col("length") != F.col("stored_length"), "length").when(F.col("sha256") != F.col("stored_sha256"), "content")
    return joined.select("path", fault.alias("fault")).filter("fault is not null")
