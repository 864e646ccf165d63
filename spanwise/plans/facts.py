"""Queries about predicates, keep flags, salience and shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import geometry as geo
from ..operators import facts
from ..sources.tables import observations, table
from .registry import query

# Predicate heads by event type.
HEADS = {"view": "left", "purchase": "before", "signup": "dir", "error": "intersect", "click": "mag"}
HEAD_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in HEADS.items()) + " END"


def _constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = F.create_map(*[F.lit(x) for pair in HEADS.items() for x in pair])
    return observations(spark, sf_dir).select("event_id", F.concat(heads[F.col("event_type")], F.lit("(e"), "user_id", F.lit(",e"), "k", F.lit(")")).alias("pred"))


@query(f"""
WITH c AS (SELECT event_id, {HEAD_SQL} AS head FROM events), p(preset) AS (VALUES ('content_only'), ('motion_shape'), ('all'), ('none'))
SELECT preset, head, count(*) AS n, CAST(sum(CASE WHEN preset = 'all' OR (preset = 'content_only' AND head IN ('type', 'dir', 'mag', 'dur', 'before', 'after', 'while'))
  OR (preset = 'motion_shape' AND head IN ('type', 'dir', 'before', 'after')) THEN 1 ELSE 0 END) AS BIGINT) AS kept
FROM c, p GROUP BY preset, head
""")
def keep_presets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _constraints(spark, sf_dir)
    out = None
    for preset in facts.PRESETS:
        part = facts.with_preset(rows, preset).groupBy(F.lit(preset).alias("preset"), F.substring_index("pred", "(", 1).alias("head")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("keep").cast("long")).alias("kept"))
        out = part if out is None else out.unionByName(part)
    return out


@query("""
SELECT d.doc_id, coalesce(l.toxic = 1, FALSE) AS keep FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
""")
def carry_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = table(spark, sf_dir, "documents").select("doc_id", F.lit(False).alias("keep"))
    old = table(spark, sf_dir, "labels").select("doc_id", (F.col("toxic") == 1).alias("keep"))
    return facts.carried(new, old, ["doc_id"]).select("doc_id", "keep")


@query("""
SELECT p_brand, p_partkey, rank FROM (
  SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY CASE WHEN p_name LIKE '%ring%' THEN 1 ELSE 0 END DESC, p_retailprice * (p_size % 7 + 1) DESC, p_size, p_partkey) AS rank FROM part)
WHERE rank <= 24
""")
def salient_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 24 most salient parts of each brand."""
    parts = table(spark, sf_dir, "part").withColumns({"first": F.col("p_size"), "last": F.col("p_size") + F.col("p_size") % 7})
    return facts.most_salient(parts, ["p_brand"], F.col("p_name").contains("ring"), F.col("p_retailprice"), "first", "last", "p_partkey", 24).select("p_brand", "p_partkey", "rank")


@query(f"""
WITH m AS (SELECT user_id AS scene, event_id AS id, event_type AS element, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS start FROM events),
n AS (SELECT *, start + 1 + start % 3 AS z FROM m),
p AS (SELECT a.scene, a.id, b.id AS later, b.start, min(b.start) OVER (PARTITION BY a.scene, a.id) AS first
      FROM n a JOIN n b ON b.scene = a.scene AND b.element <> a.element AND b.start >= a.z)
SELECT scene, id, later FROM p WHERE start = first
""")
def earliest_later(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.sequence import indexed

    rows = indexed(observations(spark, sf_dir), ["user_id"], ["ts", "event_id"])
    motions = rows.select(F.col("user_id").alias("scene"), F.col("event_id").alias("id"), F.col("event_type").alias("element"), F.col("idx").alias("start"), (F.col("idx") + 1 + F.col("idx") % 3).alias("end"))
    return facts.earliest_later(motions, ["scene"])


@query("""
WITH m AS (SELECT event_id AS id, event_id % 50 AS start, event_id % 50 + k % 20 AS z, k % 4 AS turn, k AS mag, k % 20 AS dur, CASE WHEN k % 3 = 0 THEN 'rotation' ELSE 'translation' END AS type,
  CAST(k AS DOUBLE) AS x0, k + 10.0 AS x1, event_id % 40 + 0.0 AS y0, event_id % 40 + 12.5 AS y1 FROM (SELECT *, CAST(props->>'$.k' AS INTEGER) AS k FROM events)),
q AS (SELECT a.*, b.start AS start2, b.z AS z2, b.x0 AS u0, b.x1 AS u1, b.y0 AS v0, b.y1 AS v1 FROM m a JOIN m b ON b.id = a.id + 7),
r AS (SELECT id, unnest([{'n': 'before', 'h': z <= start2}, {'n': 'after', 'h': z2 <= start}, {'n': 'while', 'h': least(z, z2) - greatest(start, start2) >= 1},
  {'n': 'mag', 'h': abs(mag - 30) <= greatest(0.10 * 30, 2.0)}, {'n': 'dir', 'h': turn = 0}, {'n': 'dur', 'h': abs(dur - 8) <= 2}, {'n': 'type', 'h': type = 'rotation'},
  {'n': 'left', 'h': x1 <= u0 + 2.0}, {'n': 'right', 'h': x0 >= u1 - 2.0}, {'n': 'top', 'h': y1 <= v0 + 2.0}, {'n': 'bottom', 'h': y0 >= v1 - 2.0},
  {'n': 'intersect', 'h': least(x1, u1) > greatest(x0, u0) AND least(y1, v1) > greatest(y0, v0)}]) AS f FROM q)
SELECT f.n AS name, count(*) AS n, CAST(sum(CASE WHEN f.h THEN 1 ELSE 0 END) AS BIGINT) AS true_facts FROM r GROUP BY f.n
""")
def predicate_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = observations(spark, sf_dir).select("event_id", "k")
    turn, ident = F.col("k") % 4, F.col("event_id").cast("string")
    motions = rows.select(
        ident.alias("id"), F.when(F.col("k") % 3 == 0, "rotation").otherwise("translation").alias("type"), (F.col("event_id") % 50).alias("start"), (F.col("event_id") % 50 + F.col("k") % 20).alias("end"),
        F.when(turn == 0, 1.0).when(turn == 2, -1.0).otherwise(0.0).alias("dx"), F.when(turn == 1, 1.0).when(turn == 3, -1.0).otherwise(0.0).alias("dy"), F.col("k").cast("double").alias("mag"), (F.col("k") % 20).alias("dur"),
    )
    low = F.col("event_id") % 40
    boxes = rows.select(ident.alias("id"), F.lit(3).alias("frame"), F.col("k").cast("double").alias("x0"), (F.col("k") + 10.0).alias("x1"), low.cast("double").alias("y0"), (low + 12.5).alias("y1"))
    other = rows.select((F.col("event_id") - 7).alias("event_id"))
    pair = F.concat(F.lit("("), ident, F.lit(", "), (F.col("event_id") + 7).cast("string"), F.lit(")"))
    # facts about boxes name their frame or mean the last one
    texts = F.array(
        *[F.concat(F.lit(n), pair) for n in ("before", "after", "while", "left", "top", "intersect")], *[F.concat(F.lit(n), pair, F.lit("@3")) for n in ("right", "bottom")],
        *[F.concat(F.lit(f"{n}("), ident, F.lit(f"{value})")) for n, value in {"mag": ",30", "dur": ", 8", "dir": ",[1, 0]", "type": ",'rotation'"}.items()],
    )
    predicates = facts.parsed(rows.join(other, "event_id").select(F.explode(texts).alias("pred")))
    held = facts.evaluated(predicates, motions, boxes, last_frame=3)
    return held.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("holds").cast("long")).alias("true_facts"))


@query("""
WITH c AS (SELECT p_partkey, p_size * 5 % 256 AS r, p_size * 11 % 256 AS g, CAST(p_partkey % 256 AS INTEGER) AS b FROM part),
l AS (SELECT p_partkey, r, g, b, CASE WHEN r / 255.0 <= 0.04045 THEN r / 255.0 / 12.92 ELSE pow((r / 255.0 + 0.055) / 1.055, 2.4) END AS lr,
  CASE WHEN g / 255.0 <= 0.04045 THEN g / 255.0 / 12.92 ELSE pow((g / 255.0 + 0.055) / 1.055, 2.4) END AS lg,
  CASE WHEN b / 255.0 <= 0.04045 THEN b / 255.0 / 12.92 ELSE pow((b / 255.0 + 0.055) / 1.055, 2.4) END AS lb FROM c),
x AS (SELECT p_partkey, r, g, b, (0.4124564 * lr + 0.3575761 * lg + 0.1804375 * lb) / 0.95047 AS x, 0.2126729 * lr + 0.7151522 * lg + 0.0721750 * lb AS y, (0.0193339 * lr + 0.1191920 * lg + 0.9503041 * lb) / 1.08883 AS z FROM l),
f AS (SELECT p_partkey, r, g, b, CASE WHEN x > 216.0 / 24389 THEN pow(x, 1 / 3.0) ELSE (24389 / 27.0 * x + 16) / 116 END AS fx, CASE WHEN y > 216.0 / 24389 THEN pow(y, 1 / 3.0) ELSE (24389 / 27.0 * y + 16) / 116 END AS fy,
  CASE WHEN z > 216.0 / 24389 THEN pow(z, 1 / 3.0) ELSE (24389 / 27.0 * z + 16) / 116 END AS fz FROM x)
SELECT p_partkey, printf('#%02x%02x%02x', r, g, b) AS hex, round(116 * fy - 16, 3) AS l, round(500 * (fx - fy), 3) AS a, round(200 * (fy - fz), 3) AS b,
  round(sqrt(pow(116 * fy - 16 - 100, 2) + pow(500 * (fx - fy), 2) + pow(200 * (fy - fz), 2)), 3) AS from_white FROM f
""")
def colour_lab(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 5 % 256).alias("r"), (F.col("p_size") * 11 % 256).alias("g"), (F.col("p_partkey") % 256).cast("int").alias("b"))
    rows = rows.withColumn("hex", geo.channels_to_hex(F.col("r"), F.col("g"), F.col("b"))).withColumn("rgb", geo.hex_to_channels(F.col("hex")))
    lab = geo.lab(*[F.col("rgb")[i] for i in range(3)])
    white = [F.lit(100.0), F.lit(0.0), F.lit(0.0)]
    return rows.select("p_partkey", "hex", *[F.round(v, 3).alias(n) for n, v in zip("lab", lab, strict=True)], F.round(geo.delta_e(lab, white), 3).alias("from_white"))


@query("""
WITH RECURSIVE e AS (SELECT event_id, CAST(props->>'$.k' AS INTEGER) / 99.0::DOUBLE AS x FROM events),
b(x, lo, hi, n) AS (SELECT DISTINCT x, 0.0::DOUBLE, 1.0::DOUBLE, 0 FROM e UNION ALL SELECT x, CASE WHEN low THEN t ELSE lo END, CASE WHEN low THEN hi ELSE t END, n + 1
  FROM (SELECT *, (lo + hi) / 2 AS t, 3 * (1 - (lo + hi) / 2) ** 2 * ((lo + hi) / 2) * 0.42 + 3 * (1 - (lo + hi) / 2) * ((lo + hi) / 2) ** 2 * 0.58 + ((lo + hi) / 2) ** 3 < x AS low FROM b WHERE n < 40)),
y AS (SELECT x, CASE WHEN x <= 0 THEN 0 WHEN x >= 1 THEN 1 ELSE 3 * (1 - (lo + hi) / 2) * ((lo + hi) / 2) ** 2 + ((lo + hi) / 2) ** 3 END AS y FROM b WHERE n = 40)
SELECT event_id, round(y, 6) AS eased FROM e JOIN y ON y.x = e.x
""")
def eased_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = observations(spark, sf_dir).select("event_id", (F.col("k") / 99.0).alias("x"))
    return rows.select("event_id", F.round(geo.bezier_ease(F.col("x"), F.lit(0.42), F.lit(0.0), F.lit(0.58), F.lit(1.0)), 6).alias("eased"))


@query("""
WITH e AS (SELECT event_id, value AS x, CAST(props->>'$.k' AS DOUBLE) AS k FROM events),
c AS (SELECT event_id, x, k, cos(radians(k * 3)) AS c, sin(radians(k * 3)) AS s FROM e)
SELECT event_id, round(x - (abs(c) * 20 + abs(s) * 10) / 2, 4) + 0.0 AS x0, round(k - (abs(s) * 20 + abs(c) * 10) / 2, 4) + 0.0 AS y0,
       round(x + (abs(c) * 20 + abs(s) * 10) / 2, 4) + 0.0 AS x1, round(k + (abs(s) * 20 + abs(c) * 10) / 2, 4) + 0.0 AS y1 FROM c
""")
def element_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = observations(spark, sf_dir)
    corners = geo.affine_corners(F.col("value"), F.col("k").cast("double"), F.lit(2.0), F.lit(1.0), F.col("k") * 3.0, F.lit(10.0), F.lit(10.0))
    box = geo.bounding_box(corners)
    return rows.withColumn("box", box).select("event_id", *[F.round(F.col(f"box.{c}"), 4).alias(c) for c in ("x0", "y0", "x1", "y1")])


@query("""
WITH RECURSIVE c AS (SELECT p_partkey % 40 AS scene, p_partkey AS id, (p_size * 5 + p_partkey % 7) % 256 AS r, (p_size * 11 + p_partkey % 7) % 256 AS g, (p_size * 3 + p_partkey % 7) % 256 AS b FROM part),
n AS (SELECT scene, id, list_transform([r, g, b], lambda v: CASE WHEN v / 255.0 <= 0.04045 THEN v / 255.0 / 12.92 ELSE pow((v / 255.0 + 0.055) / 1.055, 2.4) END) AS q FROM c),
x AS (SELECT scene, id, list_transform([(0.4124564 * q[1] + 0.3575761 * q[2] + 0.1804375 * q[3]) / 0.95047, 0.2126729 * q[1] + 0.7151522 * q[2] + 0.0721750 * q[3], (0.0193339 * q[1] + 0.1191920 * q[2] + 0.9503041 * q[3]) / 1.08883],
  lambda v: CASE WHEN v > 216.0 / 24389 THEN pow(v, 1 / 3.0) ELSE (24389 / 27.0 * v + 16) / 116 END) AS f FROM n),
p AS (SELECT scene, id, row_number() OVER (PARTITION BY scene ORDER BY id) AS n, 116 * f[2] - 16 AS l, 500 * (f[1] - f[2]) AS a, 200 * (f[2] - f[3]) AS b FROM x),
m(scene, n, heads, id, near) AS (SELECT DISTINCT scene, CAST(0 AS BIGINT), CAST([] AS STRUCT(i BIGINT, l DOUBLE, a DOUBLE, b DOUBLE)[]), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT) FROM p
  UNION ALL SELECT scene, n, CASE WHEN len(found) = 0 THEN list_append(heads, {'i': id, 'l': l, 'a': a, 'b': b}) ELSE heads END, id, coalesce(found[1].i, id)
  FROM (SELECT p.*, heads, list_filter(heads, lambda h: sqrt((h.l - p.l) ** 2 + (h.a - p.a) ** 2 + (h.b - p.b) ** 2) <= 3.0) AS found FROM m JOIN p ON p.scene = m.scene AND p.n = m.n + 1))
SELECT scene, id AS p_partkey, near AS representative FROM m WHERE id IS NOT NULL
""")
def merged_palette(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.greedy import merged_points

    rows = table(spark, sf_dir, "part").withColumn("scene", F.col("p_partkey") % 40)
    lab = geo.lab(*[(F.col("p_size") * n + F.col("p_partkey") % 7) % 256 for n in (5, 11, 3)])
    return merged_points(rows.select("scene", "p_partkey", *[v.alias(n) for n, v in zip("lab", lab, strict=True)]), ["scene"], "p_partkey", ["l", "a", "b"], 3.0)
