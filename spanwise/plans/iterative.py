"""Queries that pass over links until nothing changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..operators import graph
from ..sources.tables import table
from .registry import query


@query("""
WITH RECURSIVE d AS (SELECT doc_id, md5(text) AS h FROM documents), e AS (SELECT doc_id AS a, lag(doc_id) OVER (PARTITION BY h ORDER BY doc_id) AS b FROM d),
l AS (SELECT a, b FROM e WHERE b IS NOT NULL UNION SELECT b, a FROM e WHERE b IS NOT NULL),
r(node, reach) AS (SELECT a, a FROM l UNION SELECT r.node, l.b FROM r JOIN l ON l.a = r.reach)
SELECT node, min(reach) AS component FROM r GROUP BY node
""")
def motion_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("h"))
    links = docs.withColumn("b", F.lag("doc_id").over(Window.partitionBy("h").orderBy("doc_id"))).filter("b is not null")
    return graph.components(links, "doc_id", "b")


@query("""
WITH RECURSIVE e AS (SELECT o_orderkey AS child, o_orderkey // 3 AS parent FROM orders WHERE o_orderkey > 0 AND o_orderkey % 5 <> 0),
f(key, depth) AS (SELECT o_orderkey, 0 FROM orders WHERE o_orderkey BETWEEN 7 AND 12 UNION SELECT e.child, f.depth + 1 FROM f JOIN e ON e.parent = f.key)
SELECT key, min(depth) AS depth FROM f GROUP BY key
""")
def dependency_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    edges = orders.filter("o_orderkey > 0 and o_orderkey % 5 <> 0").select(F.col("o_orderkey").alias("child"), F.expr("o_orderkey div 3").alias("parent"))
    failed = orders.filter(F.col("o_orderkey").between(7, 12)).select(F.col("o_orderkey").alias("key"))
    return graph.cascade(edges, "child", "parent", failed, "key")
