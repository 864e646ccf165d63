"""Queries of per-entity and per-pair measures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import measures as mea, sequence as seq
from ..sources.tables import observations, table
from .registry import query

IDX = "o AS (SELECT *, CAST(props->>'$.k' AS INTEGER) AS k, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx FROM events)"


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seq.indexed(observations(spark, sf_dir), ["user_id"], ["ts", "event_id"])


@query(f"WITH {IDX} SELECT user_id, min(idx) AS first, max(idx) AS last, count(*) AS rows, round((max(idx) - min(idx) + 1) / 30.0, 6) AS duration FROM o GROUP BY user_id")
def entity_extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mea.extents(_rows(spark, sf_dir), ["user_id"], "idx", 30.0).withColumn("duration", F.round("duration", 6))


@query("""
WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2)
SELECT user_id, event_type, n, round(n / sum(n) OVER (PARTITION BY user_id), 6) AS share FROM c
""")
def owner_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mea.shares(observations(spark, sf_dir), ["user_id"], "event_type").withColumn("share", F.round("share", 6))


@query("""
WITH m AS (SELECT user_id, event_type, median(value) AS m FROM events GROUP BY 1, 2)
SELECT e.user_id, e.event_type, count(value) AS seen, round(CASE WHEN count(value) >= 12 THEN avg(CASE WHEN abs(value - m) > 30 THEN 1.0 ELSE 0.0 END) END, 6) AS share
FROM events e JOIN m ON m.user_id = e.user_id AND m.event_type = e.event_type GROUP BY 1, 2
""")
def unstable_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mea.unstable_share(observations(spark, sf_dir), ["user_id", "event_type"], "value", 30.0, 12).withColumn("share", F.round("share", 6))


@query(f"""
WITH {IDX}, h AS (SELECT user_id, value, idx * 2 >= max(idx) OVER (PARTITION BY user_id) + 1 AS late FROM o)
SELECT user_id, round(median(value) FILTER (WHERE late) - median(value) FILTER (WHERE NOT late), 4) AS change FROM h GROUP BY user_id
""")
def early_late_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mea.early_late(_rows(spark, sf_dir), ["user_id"], "idx", "value").withColumn("change", F.round("change", 4))


@query("""
WITH r AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS n FROM events),
l AS (SELECT user_id, coalesce(max(value) FILTER (WHERE n = 3), max(value)) AS level FROM r GROUP BY user_id)
SELECT r.user_id, event_id, level FROM r JOIN l ON l.user_id = r.user_id WHERE value >= 0.97 * level
""")
def near_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mea.near_peak(observations(spark, sf_dir), ["user_id"], "value", "event_id").select("user_id", "event_id", "level")


@query("""
WITH s AS (SELECT l_returnflag, sum(l_tax + 1) AS w, sum((l_tax + 1) * l_quantity) AS x, sum((l_tax + 1) * l_extendedprice) AS y, sum((l_tax + 1) * l_quantity * l_quantity) AS xx, sum((l_tax + 1) * l_quantity * l_extendedprice) AS xy FROM lineitem GROUP BY 1),
b AS (SELECT *, (w * xy - x * y) / (w * xx - x * x) AS slope FROM s)
SELECT l_returnflag, round(slope, 3) AS slope, round((y - slope * x) / w, 1) AS intercept FROM b
""")
def weighted_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").withColumn("w", F.col("l_tax") + 1)
    return mea.weighted_line(rows, ["l_returnflag"], "l_quantity", "l_extendedprice", "w").select("l_returnflag", F.round("slope", 3).alias("slope"), F.round("intercept", 1).alias("intercept"))


@query(f"""
WITH {IDX}, p AS (SELECT user_id, idx - 1 AS a, idx + k % 4 + 1 AS z FROM o WHERE event_type = 'view'),
r AS (SELECT *, max(z) OVER (PARTITION BY user_id ORDER BY a, z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM p),
g AS (SELECT *, sum(CASE WHEN reach IS NULL OR a > reach + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY a, z ROWS UNBOUNDED PRECEDING) AS grp FROM r)
SELECT user_id, min(a) AS first, max(z) AS last, count(*) AS parts FROM g GROUP BY user_id, grp
""")
def covered_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = _rows(spark, sf_dir).filter("event_type = 'view'").withColumn("end", F.col("idx") + F.col("k") % 4)
    return mea.covered(spans, ["user_id"], "idx", "end", 1)


@query("""
WITH f AS (SELECT o_orderpriority AS value, min(o_orderkey) AS seen FROM orders GROUP BY 1), n AS (SELECT *, CASE value WHEN '1-URGENT' THEN 'urgent' WHEN '5-LOW' THEN 'low' END AS preset FROM f)
SELECT value, seen, coalesce(preset, 'p' || row_number() OVER (PARTITION BY preset IS NULL ORDER BY seen, value)) AS name FROM n
""")
def value_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("value"), "o_orderkey")
    return mea.named(rows, "value", "o_orderkey", {"1-URGENT": "urgent", "5-LOW": "low"}, "p")


@query("""
SELECT o_orderkey, CASE WHEN NOT o_totalprice > 1000 THEN 'price' WHEN o_orderstatus NOT IN ('O', 'F') THEN 'status' WHEN NOT regexp_full_match(o_orderpriority, '[1-4]-.*') THEN 'priority' END AS fault FROM orders
""")
def target_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    fault = mea.first_fault([("price", F.col("o_totalprice") > 1000), ("status", F.col("o_orderstatus").isin("O", "F")), ("priority", F.col("o_orderpriority").rlike("^[1-4]-.*$"))])
    return table(spark, sf_dir, "orders").select("o_orderkey", fault.alias("fault"))


@query("""
SELECT event_id, round(greatest(0, least(1, (value - 10 - 0) / 20)), 6) AS first, round(greatest(0, least(1, (value - 10 - 5) / 20)), 6) AS second, round(greatest(0, least(1, (value - 10 - 12) / 20)), 6) AS third FROM events
""")
def glyph_ramps(spark: SparkSession, sf_dir: str) -> DataFrame:
    progress = mea.ramps(F.lit(10.0), F.lit(20.0), F.col("value"), F.array(F.lit(0.0), F.lit(5.0), F.lit(12.0)))
    rows = observations(spark, sf_dir).select("event_id", progress.alias("p"))
    return rows.select("event_id", *[F.round(F.col("p")[i], 6).alias(n) for i, n in enumerate(("first", "second", "third"))])


@query("""
WITH m AS (SELECT event_id, value + 1 AS a, CAST(props->>'$.k' AS DOUBLE) / 10 AS b, CAST(props->>'$.k' AS DOUBLE) / 20 - 2 AS c, value / 2 + 3 AS d FROM events), s AS (SELECT *, sqrt(a * a + c * c) AS sx FROM m)
SELECT event_id, round(degrees(atan2(c, a)), 4) + 0.0 AS rotation, round(sx, 4) AS sx, round((a * d - b * c) / sx, 4) + 0.0 AS sy, round((a * b + c * d) / (sx * sx), 4) + 0.0 AS shear FROM s
""")
def affine_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k").cast("double")
    parts = mea.matrix_parts(F.col("value") + 1, k / 10, k / 20 - 2, F.col("value") / 2 + 3)
    return observations(spark, sf_dir).select("event_id", *[(F.round(v, 4) + 0.0).alias(n) for n, v in parts.items()])


@query("""
WITH g AS (SELECT user_id, CAST(floor(epoch(ts) / 86400) AS BIGINT) AS day, string_agg(event_type || ':' || event_id, ',' ORDER BY event_type, event_id) AS objects, count(*) AS n FROM events WHERE event_type <> 'error' GROUP BY 1, 2),
d AS (SELECT DISTINCT user_id, CAST(floor(epoch(ts) / 86400) AS BIGINT) AS day FROM events)
SELECT d.user_id, d.day, objects, coalesce(n, 0) AS n, n IS NOT NULL AS available FROM d LEFT JOIN g ON g.user_id = d.user_id AND g.day = d.day
""")
def frame_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = observations(spark, sf_dir).withColumn("day", F.floor(F.col("ts").cast("timestamp").cast("double") / 86400))
    from ..operators.tracks import overlay

    parts = {kind: rows.filter(F.col("event_type") == kind) for kind in ("view", "click", "signup", "purchase")}
    return overlay(parts, rows, ["user_id", "day"], "event_id")


@query("""
WITH r AS (SELECT doc_id, nullif(lang, 'en') AS given, CASE WHEN n_chars > 800 THEN source END AS joined, 'unknown' AS model FROM documents)
SELECT doc_id, coalesce(given, joined, model) AS text, CASE WHEN given IS NOT NULL THEN 'given' WHEN joined IS NOT NULL THEN 'joined' ELSE 'model' END AS provenance,
       contains(regexp_replace(doc_id || 'x' || doc_id, '\\D', '', 'g'), regexp_replace('n' || doc_id, '\\D', '', 'g')) AS digits_agree FROM r
""")
def reconciled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.nullif("lang", F.lit("en")).alias("given"), F.when(F.col("n_chars") > 800, F.col("source")).alias("joined"))
    from ..operators import reads

    ident = F.col("doc_id").cast("string")
    text, provenance = reads.reconciled({"given": F.col("given"), "joined": F.col("joined"), "model": F.lit("unknown")})
    agree = reads.digits_agree(F.concat(ident, F.lit("x"), ident), F.concat(F.lit("n"), ident))
    return rows.select("doc_id", text.alias("text"), provenance.alias("provenance"), agree.alias("digits_agree"))
