"""Queries that score, gate and summarise."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import score
from ..sources.tables import observations, table
from .registry import query


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars"), "doc_id")


@query("""
SELECT source, round(avg(n_chars), 4) AS mean, CAST(arg_max(n_chars, n_chars - 4000) AS DOUBLE) AS worst, count(*) AS samples,
       CAST(sum(CASE WHEN n_chars <= 4000 THEN 0 ELSE 1 END) AS BIGINT) AS failed, bool_and(n_chars <= 4000) AS passed
FROM labels JOIN documents USING (doc_id) GROUP BY source
""")
def gate_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.gate(_labelled(spark, sf_dir), ["source"], "n_chars", "le", 4000.0).withColumn("mean", F.round("mean", 4))


@query("""
SELECT source, round(avg(CASE WHEN quality = 1 THEN 1.0 ELSE 0.0 END), 6) AS rate, count(*) AS samples, avg(CASE WHEN quality = 1 THEN 1.0 ELSE 0.0 END) >= 0.85 AS passed
FROM labels JOIN documents USING (doc_id) GROUP BY source
""")
def rate_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.rate_gate(_labelled(spark, sf_dir), ["source"], F.col("quality") == 1, 0.85).withColumn("rate", F.round("rate", 6))


@query("""
WITH g AS (SELECT source, bool_and(n_chars <= 4000) AS passed FROM labels JOIN documents USING (doc_id) GROUP BY source)
SELECT bool_and(passed) AS passed FROM g
""")
def overall_passed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.overall(score.gate(_labelled(spark, sf_dir), ["source"], "n_chars", "le", 4000.0), "passed", strict=True)


@query("""
WITH c AS (SELECT lang, n_chars, sum(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS p, sum(CASE WHEN toxic = 0 THEN 1 ELSE 0 END) AS n FROM labels JOIN documents USING (doc_id) GROUP BY 1, 2),
b AS (SELECT *, sum(n) OVER (PARTITION BY lang ORDER BY n_chars) - n AS below FROM c)
SELECT lang, round(sum(p * below) / (CAST(sum(p) AS DOUBLE) * sum(n)), 6) AS auc, CAST(sum(p) AS BIGINT) AS positives, CAST(sum(n) AS BIGINT) AS negatives FROM b GROUP BY lang
""")
def auc_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.rank_auc(_labelled(spark, sf_dir), ["lang"], "n_chars", "toxic").withColumn("auc", F.round("auc", 6))


@query("""
WITH g AS (SELECT source, toxic, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY 1, 2), t AS (SELECT count(DISTINCT source) AS s, sum(n) AS r FROM g)
SELECT source, toxic, round(r / (2.0 * s * n), 6) AS weight FROM g, t
""")
def balanced_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.balanced_weights(_labelled(spark, sf_dir), "source", "toxic").select("source", "toxic", F.round("weight", 6).alias("weight"))


@query("""
SELECT CAST(t AS DOUBLE) AS threshold, round(avg(CASE WHEN (n_chars >= t) = (quality = 1) THEN 1.0 ELSE 0.0 END), 6) AS agreement
FROM labels JOIN documents USING (doc_id), (VALUES (50.0), (200.0), (500.0), (1000.0), (2000.0)) v(t) GROUP BY t
""")
def threshold_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = score.threshold_grid(_labelled(spark, sf_dir), "n_chars", F.col("quality") == 1, [50.0, 200.0, 500.0, 1000.0, 2000.0])
    return found.withColumn("agreement", F.round("agreement", 6))


@query()
def paired_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _labelled(spark, sf_dir).select("source", (F.col("quality") - F.col("toxic")).cast("double").alias("difference"))
    return score.paired_bootstrap(rows, "source", "difference", draws=2000, seed=0)


@query("""
WITH RECURSIVE c(doc_id, s, i, x) AS (SELECT doc_id, CAST(doc_id AS VARCHAR), 0, CAST(4294967295 AS BIGINT) FROM documents
  UNION ALL SELECT doc_id, s, i + 1, xor(y >> 1, CASE WHEN y & 1 = 1 THEN 3988292384 ELSE 0 END)
  FROM (SELECT doc_id, s, i, CASE WHEN i % 8 = 0 THEN xor(x, CAST(ascii(s[i // 8 + 1]) AS BIGINT)) ELSE x END AS y FROM c WHERE i < 8 * length(s)))
SELECT doc_id, xor(x, CAST(4294967295 AS BIGINT)) % 5 AS fold FROM c WHERE i = 8 * length(s)
""")
def hash_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5).alias("fold"))


TRACKS = """
o AS (SELECT user_id, CAST(props->>'$.k' AS DOUBLE) AS k, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx FROM events),
d AS (SELECT user_id, idx, value - lag(value) OVER w AS dx, k - lag(k) OVER w AS dy FROM o WINDOW w AS (PARTITION BY user_id ORDER BY idx)),
s AS (SELECT * FROM d WHERE dx IS NOT NULL),
j AS (SELECT a.user_id AS a, b.user_id AS b, sqrt(a.dx * a.dx + a.dy * a.dy) AS na, sqrt(b.dx * b.dx + b.dy * b.dy) AS nb, a.dx * b.dx + a.dy * b.dy AS p
      FROM s a JOIN s b ON b.user_id = a.user_id + 1 AND b.idx = a.idx),
c AS (SELECT a, b, CASE WHEN na < 0.25 AND nb < 0.25 THEN 1.0 WHEN na < 0.25 OR nb < 0.25 THEN 0.0 ELSE p / (na * nb) * least(na, nb) / greatest(na, nb) END AS score FROM j)"""


def _neighbour_scores(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Correlation of each user's track with the next user's, and all steps."""
    from ..operators.sequence import indexed

    rows = indexed(observations(spark, sf_dir), ["user_id"], ["ts", "event_id"]).withColumn("k", F.col("k").cast("double"))
    steps = score.tracklets(rows, "user_id", "idx", "value", "k")
    users = rows.select(F.col("user_id").alias("a")).distinct().withColumn("b", F.col("a") + 1)
    return score.correlation(steps, steps, users, "user_id", "idx"), steps


@query(f"WITH {TRACKS} SELECT a, b, round(avg(score), 6) AS score, count(*) AS steps FROM c GROUP BY a, b")
def track_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _neighbour_scores(spark, sf_dir)[0].withColumn("score", F.round("score", 6))


@query(f"""
WITH {TRACKS}, w AS (SELECT user_id, count(*) AS weight FROM s GROUP BY user_id), m AS (SELECT a AS user_id, avg(score) AS score FROM c GROUP BY a, b)
SELECT round(sum(weight * coalesce(score, 0)) / sum(weight), 6) AS similarity, CAST(sum(weight) AS BIGINT) AS weight FROM w LEFT JOIN m USING (user_id)
""")
def similarity_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores, steps = _neighbour_scores(spark, sf_dir)
    evidence = steps.groupBy("user_id").agg(F.count(F.lit(1)).alias("weight"))
    found = score.weighted_by_evidence(scores.select(F.col("a").alias("user_id"), "score"), evidence, "user_id")
    return found.withColumn("similarity", F.round("similarity", 6))


@query("""
SELECT event_type, CAST(floor(epoch(ts) / 86400) AS BIGINT) AS day, floor(quantile_cont(value, 0.5) FILTER (WHERE CAST(props->>'$.k' AS INTEGER) < 80) + 0.5) AS middle,
       count(*) FILTER (WHERE CAST(props->>'$.k' AS INTEGER) < 80) AS seen FROM events GROUP BY 1, 2
""")
def temporal_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.floor(F.col("ts").cast("timestamp").cast("double") / 86400)
    return score.masked_median(observations(spark, sf_dir), ["event_type", day.alias("day")], F.col("value"), F.col("k") < 80)


@query("""
WITH s AS (SELECT l_returnflag, l_extendedprice AS v, sum(l_quantity) AS w FROM lineitem WHERE l_quantity > 0 GROUP BY 1, 2),
r AS (SELECT *, sum(w) OVER (PARTITION BY l_returnflag ORDER BY v) AS run, sum(w) OVER (PARTITION BY l_returnflag) AS total FROM s)
SELECT l_returnflag, min(v) AS median FROM r WHERE run >= total / 2 GROUP BY l_returnflag
""")
def weighted_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.weighted_median(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", "l_quantity")


@query("""
WITH o AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx FROM events),
q AS (SELECT user_id, quantile_cont(value, 0.8) AS lim, count(*) AS n FROM o GROUP BY user_id),
b AS (SELECT o.user_id, value, lim, CAST(floor((idx * least(20, n) + least(20, n) - 1) / CAST(n AS DOUBLE)) AS BIGINT) AS bin FROM o JOIN q ON q.user_id = o.user_id)
SELECT user_id, bin, max(value) AS peak, max(CASE WHEN value >= lim THEN 1 ELSE 0 END) AS hot FROM b GROUP BY user_id, bin
""")
def percentile_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.sequence import indexed

    return score.series_bins(indexed(observations(spark, sf_dir), ["user_id"], ["ts", "event_id"]), ["user_id"], "idx", "value", most=20)


@query("""
SELECT l_returnflag, count(*) AS n, round(avg(l_extendedprice), 2) AS mean, min(l_extendedprice) AS low, max(l_extendedprice) AS high FROM lineitem GROUP BY l_returnflag
""")
def partial_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("l_extendedprice")
    parts = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus", "l_shipdate").agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.min(v).alias("low"), F.max(v).alias("high"))
    return score.pooled(parts, ["l_returnflag"]).withColumn("mean", F.round("mean", 2))


@query("""
SELECT coalesce(source, 'all') AS source, coalesce(lang, 'all') AS lang, count(*) AS n, round(avg(quality), 6) AS accuracy
FROM labels JOIN documents USING (doc_id) GROUP BY GROUPING SETS ((source, lang), (source), ())
""")
def pooled_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.accuracy_by(_labelled(spark, sf_dir), ["source", "lang"], F.col("quality")).withColumn("accuracy", F.round("accuracy", 6))


@query("""
WITH m AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS seen FROM events GROUP BY 1, 2)
SELECT user_id, string_agg(event_type, ' ' ORDER BY seen) AS line, CAST(sum(n) AS BIGINT) AS n FROM m GROUP BY user_id
""")
def group_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.tracks import joined_members

    return joined_members(observations(spark, sf_dir), ["user_id"], "event_type", "event_id")


@query("""
WITH t AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx FROM events),
m AS (SELECT *, max(value) OVER (PARTITION BY user_id) AS top, quantile_cont(idx, 0.5) OVER (PARTITION BY user_id) AS middle FROM t)
SELECT user_id, event_id FROM m WHERE idx <= middle OR value >= 0.6 * top
""")
def trimmed_tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.sequence import indexed, trimmed_tail

    rows = indexed(observations(spark, sf_dir), ["user_id"], ["ts", "event_id"])
    return trimmed_tail(rows, ["user_id"], "idx", "value", 0.6).select("user_id", "event_id")
