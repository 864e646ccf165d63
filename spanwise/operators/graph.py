"""Components and propagation over links, in passes whose number grows with the logarithm of a chain."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, functions as F
from pyspark.sql.types import StructType

from .checkpoints import Rounds, shuffled


#: Links that a task joins to stars before the first pass.
LINKS = 200_000


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of a task as stars, so many at a time: what they connect, linked to the least node of it."""
    root: dict = {}
    held, kind = 0, None

    def find(x: object) -> object:
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    def stars() -> pa.RecordBatch:
        nodes = list(root)
        return pa.RecordBatch.from_arrays([pa.array(nodes, kind), pa.array([find(x) for x in nodes], kind)], names=["high", "low"])

    for batch in batches:
        kind = batch.schema.field(0).type
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
        held += batch.num_rows
        if held >= LINKS:
            yield stars()
            root.clear()
            held = 0
    if root:
        yield stars()


def _large_star(links: DataFrame) -> DataFrame:
    """Every neighbour above a node (and it itself) is linked to the least of the node's neighbourhood."""
    ends = F.explode(F.array(F.struct(F.col("high").alias("node"), F.col("low").alias("other")), F.struct(F.col("low").alias("node"), F.col("high").alias("other"))))
    both = links.select(ends.alias("e")).select("e.node", "e.other")
    least = shuffled(both.groupBy("node").agg(F.min("other").alias("least")).select(F.col("node").alias("at"), F.least("node", "least").alias("least")))
    return both.filter("other > node").join(least, F.col("node") == F.col("at")).select(F.col("other").alias("high"), F.col("least").alias("low"), (F.col("least") < F.col("node")).cast("int").alias("moved"))


def _small_star(links: DataFrame) -> DataFrame:
    """A node and all its lower neighbours are linked to the least of them."""
    least = shuffled(links.groupBy("high").agg(F.min("low").alias("least")).withColumnRenamed("high", "at"))
    met = links.join(least, F.col("high") == F.col("at"))
    below = met.filter("low > least").select(F.col("low").alias("high"), F.col("least").alias("low"), F.lit(1).alias("moved"))
    return met.filter("low = least").select("high", "low", "moved").unionByName(below)


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) of every linked node: the smallest node it reaches.

    Large-star and small-star steps (Kiveris and others, "Connected components in MapReduce
    and beyond", 2014) alternate until every node is linked to its component's smallest: a
    chain's length halves with each pass, whatever the order of its nodes, and there are never
    more links than at first.  Minima are partial before the shuffle, so a node with very many
    links is no hot spot.  Each pass is one job, written and read back.  Rows with a null end
    name no link; a link of a node with itself makes it a component of its own.
    """
    rounds = Rounds(links.sparkSession)
    kind = links.schema[a].dataType
    known = links.select(F.col(a).alias("high"), F.col(b).cast(kind).alias("low")).filter("high is not null and low is not null")
    raw = rounds.keep(known, "links")
    tasks = max(1, raw.count() // LINKS)
    if isinstance(kind, StructType):  # keys of several columns have no order in Python: as they are
        ends = F.explode(F.array(F.struct(F.greatest("high", "low").alias("high"), F.least("high", "low").alias("low")), F.struct("high", F.col("high").alias("low")), F.struct(F.col("low").alias("high"), "low")))
        stars = raw.select(ends.alias("e")).select("e.high", "e.low")
    else:
        stars = raw.coalesce(tasks).mapInArrow(_stars, known.schema)
    given = rounds.keep(stars.distinct(), "given")  # nodes are linked to themselves as well
    rounds.drop(raw)
    now = given.filter("high <> low")
    while True:
        seen, starred = Observation(), _large_star(now).groupBy("high", "low").agg(F.max("moved").alias("moved"))
        done = _small_star(starred).groupBy("high", "low").agg(F.max("moved").alias("moved")).observe(seen, F.sum("moved").alias("moved"))
        before, now = now, rounds.keep(done.select("high", "low"), "pass")
        if not seen.get["moved"]:
            break
        if rounds.number > 3:
            rounds.drop(before)
    nodes = given.groupBy(F.col("high").alias("node")).agg(F.min("low").alias("least"))
    return nodes.join(shuffled(now), F.col("node") == F.col("high"), "left").select("node", F.coalesce("low", "least").alias("component"))


def _chains(edges: DataFrame, failed: DataFrame, rounds: Rounds) -> tuple[DataFrame, DataFrame]:
    """Edges (child, parent, hops) of children with one parent, led on to the end of their chains by doubling, and all other edges.

    A chain ends at a failed key or at a key with no or several parents.
    """
    single = edges.groupBy("child").agg(F.count(F.lit(1)).alias("n"), F.first("parent").alias("parent")).filter("n = 1")
    single = single.join(failed.withColumnRenamed("key", "child"), "child", "left_anti").select("child", "parent", F.lit(1).cast("long").alias("hops"))
    kept = rounds.keep(single, "single")
    now, open_ = kept, None
    while True:
        seen, onward = Observation(), now.select(F.col("child").alias("parent"), F.col("parent").alias("next"), F.col("hops").alias("more"))
        led = now.join(onward, "parent", "left").observe(seen, F.count("next").alias("open"))
        before, now = now, rounds.keep(led.select("child", F.coalesce("next", "parent").alias("parent"), (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops")), "chain")
        left = seen.get["open"]
        if not left or left == open_:  # what never ends is a circle
            break
        if before is not kept:
            rounds.drop(before)
        open_ = left
    branched = edges.join(kept.select("child"), "child", "left_anti").withColumn("hops", F.lit(1).cast("long"))
    return now, branched


def cascade(edges: DataFrame, child: str, parent: str, failed: DataFrame, key: str) -> DataFrame:
    """Keys that fail because a key they depend on, directly or not, failed: (key, depth), depth 0 for the given ones.

    Chains are led to their ends by doubling first, so the passes grow with the number of keys
    with several parents on a way, not with its length.  Depth is the least number of edges;
    edges with a null end are none.
    """
    rounds = Rounds(edges.sparkSession)
    ends = edges.select(F.col(child).alias("child"), F.col(parent).alias("parent")).filter("child is not null and parent is not null and child <> parent")
    ends = rounds.keep(ends.distinct(), "edges")
    found = rounds.keep(failed.select(F.col(key).alias("key"), F.lit(0).cast("long").alias("depth")).distinct(), "found")
    chains, branched = _chains(ends, found.select("key"), rounds)
    branched = rounds.keep(branched, "branched")
    onward, forked = chains.unionByName(branched), not branched.isEmpty()
    while True:
        seen = Observation()
        reached = onward.join(found.withColumnRenamed("key", "parent"), "parent").groupBy(F.col("child").alias("key")).agg(F.min(F.col("depth") + F.col("hops")).alias("by"))
        better = (F.col("depth").isNull() | (F.col("by") < F.col("depth"))).cast("int")
        step = found.join(reached, "key", "full").select("key", F.least("depth", "by").alias("depth"), F.coalesce(better, F.lit(0)).alias("better")).observe(seen, F.sum("better").alias("better"))
        before, found = found, rounds.keep(step.select("key", "depth"), "found")
        if not forked or not seen.get["better"]:  # without forks every chain ends at a failed key or nowhere
            return found.select("key", F.col("depth").cast("int").alias("depth"))
        rounds.drop(before)
