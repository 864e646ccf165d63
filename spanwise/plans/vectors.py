"""Queries over vectors."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import vectors as vec
from ..sources.tables import table
from .registry import query

SIZE = 64
#: A small network with weights from a formula, for reproducible scores.
LAYERS = [([[math.sin(i * 7 + j) / 4 for j in range(SIZE)] for i in range(6)], [0.1 * i for i in range(6)]), ([[math.cos(i * 3 + j) for j in range(6)] for i in range(1)], [0.05])]
CENTRES = [[math.sin(c * 11 + j) / 8 for j in range(SIZE)] for c in range(5)]


def _list(values: list[float]) -> str:
    return "[" + ", ".join(repr(float(v)) for v in values) + "]"


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", vec.as_doubles(F.col("embedding")).alias("v"))


_HIDDEN = "[" + ", ".join(f"greatest(0.0, list_dot_product(x, {_list(w)}) + {b!r})" for w, b in zip(*LAYERS[0], strict=True)) + "]"


@query(f"""
WITH x AS (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda e: (e - 0.01) / 0.125) AS x FROM embeddings), h AS (SELECT vec_id, {_HIDDEN} AS h FROM x)
SELECT vec_id, round(1 / (1 + exp(-(list_dot_product(h, {_list(LAYERS[1][0][0])}) + {LAYERS[1][1][0]!r}))), 6) AS p FROM h
""")
def mlp_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = vec.network_score(F.col("v"), [0.01] * SIZE, [0.125] * SIZE, LAYERS)
    return _vectors(spark, sf_dir).select("vec_id", F.round(score, 6).alias("p"))


_CENTRE_SQL = ", ".join(f"({i}, {_list(c)})" for i, c in enumerate(CENTRES))


@query(f"""
WITH c(centre, m) AS (VALUES {_CENTRE_SQL}), d AS (SELECT vec_id, centre, list_distance(CAST(embedding AS DOUBLE[]), m) AS d FROM embeddings, c)
SELECT vec_id, arg_min(centre, d) AS centre, round(min(d) * min(d), 6) AS distance FROM d GROUP BY vec_id
""")
def nearest_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vec.nearest_centre(_vectors(spark, sf_dir), "v", CENTRES).select("vec_id", "centre", F.round("distance", 6).alias("distance"))


@query("""
WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), m AS (SELECT vec_id, label, v, list_avg(v) AS m FROM v),
c AS (SELECT vec_id, label, list_transform(list_zip(v, list_resize([m], len(v), m)), lambda z: z[1] - z[2]) AS c FROM m),
u AS (SELECT vec_id, label, c, sqrt(list_dot_product(c, c)) AS n FROM c),
h AS (SELECT DISTINCT a.label, a.vec_id FROM u a JOIN u b ON a.vec_id % 10 <> 0 AND b.vec_id % 10 = 0 AND list_dot_product(a.c, b.c) / (a.n * b.n) >= 0.35)
SELECT label, count(*) AS near FROM h GROUP BY label HAVING count(*) >= 3
""")
def near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _vectors(spark, sf_dir)
    return vec.leaked(rows.filter("vec_id % 10 <> 0"), rows.filter("vec_id % 10 = 0"), "label", "vec_id", "v", 0.35, 3)
