"""The shared folder for checkpoints, and tables written there."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Rows of a table that one task of ``spread`` gets on average.
ROWS = 1 << 18


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder that the session names; set a local one only where none is named and all runs in one process (tests)."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.fullmatch(r"local(\[.*\])?", context.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spanwise-checkpoint-"))


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store, whatever file system it is on."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def shuffled(table: DataFrame) -> DataFrame:
    """A side of a join that grows with the input: never broadcast.

    Files of small integers are far smaller than their rows, and what an explode makes is not
    in Spark's estimate at all, so it would send such a side through the driver.
    """
    return table.hint("merge")


def spread(table: DataFrame, *keys: str, rows: int = ROWS) -> DataFrame:
    """Rows dealt by keys to as many tasks as their number asks for, ROWS on average unless told otherwise.

    What follows by these keys needs no further shuffle, and its tasks grow in number and not in
    size.  Made for tables as they are read, which Parquet counts without reading them.
    """
    return table.repartition(max(1, -(-table.count() // rows)), *keys)


class Rounds:
    """Tables of an iteration, each written to the shared folder and read back.

    Unlike checkpoint(), reading back gives the plan the size of the files, so that estimates
    do not grow from round to round, and the round before can be deleted at once.
    """

    def __init__(self, spark: SparkSession):
        ensure_checkpoint_dir(spark)
        self.spark, self.number = spark, 0
        self.folder = f"{spark.sparkContext.getCheckpointDir()}/rounds-{uuid.uuid4().hex}"

    def keep(self, table: DataFrame, name: str) -> DataFrame:
        self.number += 1
        path = f"{self.folder}/{self.number}-{name}"
        table.write.parquet(path)
        return self.spark.read.schema(table.schema).parquet(path)

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            for path in {p.rsplit("/", 1)[0] for p in table.inputFiles()}:
                remove(self.spark, path)
