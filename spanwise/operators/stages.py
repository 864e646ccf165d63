"""Stages of work kept by what they were made from: only what a change touches is worked out again."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from .checkpoints import ensure_checkpoint_dir, remove

Stage = tuple[str, Callable[..., DataFrame], dict]


@dataclass
class Done:
    """A stage's name, the key of its table, and whether this run worked it out."""

    name: str
    key: str
    computed: bool


def content_key(rows: DataFrame) -> str:
    """A digest of a table's names, types and rows, whatever their order: sums over the cluster, one row to the driver."""
    mine = F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns])
    other = F.xxhash64(F.lit(1), *[F.col(f"`{c}`") for c in rows.columns])
    sums = rows.agg(F.count(F.lit(1)), F.sum(mine.cast("decimal(38,0)")), F.sum(other.cast("decimal(38,0)")), F.bit_xor(mine)).first()
    return _digest([rows.schema.simpleString(), *map(str, sums)])


def _digest(parts: object) -> str:
    return hashlib.sha256(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()


class Store:
    """Tables under a shared folder, each published whole: written under a name of its own, then renamed to its key."""

    def __init__(self, spark: SparkSession, folder: str | None = None):
        ensure_checkpoint_dir(spark)
        self.spark, self.folder = spark, folder or f"{spark.sparkContext.getCheckpointDir()}/stages"

    def _files(self, path: str):
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return place, place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def has(self, key: str) -> bool:
        place, files = self._files(f"{self.folder}/{key}")
        return files.exists(place)

    def publish(self, rows: DataFrame, key: str) -> None:
        """Keep a table.  Of two runs that publish one key at once the first stays; a run that is lost leaves nothing under the key."""
        given = f"{self.folder}/unfinished-{uuid.uuid4().hex}"
        rows.write.parquet(given)
        (here, files), (there, _) = self._files(given), self._files(f"{self.folder}/{key}")
        if files.exists(there) or not files.rename(here, there):
            remove(self.spark, given)
            if not files.exists(there):
                raise OSError(f"could not publish {key} in {self.folder}")

    def read(self, key: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{key}")

    def prune(self, keys: set[str]) -> list[str]:
        """Remove published tables of other keys, and say which."""
        place, files = self._files(self.folder)
        found = [s.getPath().getName() for s in files.listStatus(place)] if files.exists(place) else []
        gone = sorted(x for x in found if len(x) == 64 and x not in keys)
        for key in gone:
            remove(self.spark, f"{self.folder}/{key}")
        return gone


def run(store: Store, source: DataFrame, stages: list[Stage], source_key: str | None = None, again_from: str | None = None) -> tuple[DataFrame, list[Done]]:
    """The last stage's table, and what was done for each.

    A stage is a name, a function of the table before it and its parameters.  Its key is a
    digest of the key before it, its name and its parameters, so a changed parameter gives new
    keys to it and to what follows; tables of known keys are read.  ``again_from`` works a
    stage and all after it out anew, though their keys are known.
    """
    key, rows, report, anew = source_key or content_key(source), source, [], False
    for name, work, parameters in stages:
        key = _digest([key, name, parameters])
        anew = anew or name == again_from
        known = store.has(key)
        if known and anew:
            remove(store.spark, f"{store.folder}/{key}")
        if not known or anew:
            store.publish(work(rows, **parameters), key)
        rows = store.read(key)
        report.append(Done(name, key, not known or anew))
    return rows, report


def corrected(rows: DataFrame, corrections: DataFrame, keys: list[str], columns: list[str], order: list[str]) -> DataFrame:
    """Rows with manual corrections (keys, column, value as text, order) replayed: of each cell the last one counts.

    A null value clears the cell.  Corrections of unknown columns or of rows that are not there
    have no effect; what two corrections of equal order say is decided by the larger value.
    """
    last = corrections.filter(F.col("column").isin(*columns)).groupBy(*keys, "column").agg(F.max(F.struct(*order, F.struct("value").alias("_v"))).alias("_last"))
    cells = last.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("column", F.struct(F.col("_last._v.value").alias("value"))))).alias("_cells"))
    met = rows.join(cells, keys, "left")
    fixed = {c: F.when(F.col("_cells")[c].isNotNull(), F.col("_cells")[c]["value"].cast(rows.schema[c].dataType)).otherwise(F.col(c)) for c in columns}
    return met.select(*[fixed.get(c, F.col(c)).alias(c) for c in rows.columns])
