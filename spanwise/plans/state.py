"""Queries over versions, jobs, heartbeats, transcripts and admin tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import state
from ..sources.tables import observations, table
from .registry import query


@query("""
SELECT o_custkey, arg_max(o_orderkey, (CAST(o_orderdate AS DATE), o_orderkey)) AS o_orderkey, arg_max(o_orderstatus, (CAST(o_orderdate AS DATE), o_orderkey)) AS o_orderstatus
FROM orders GROUP BY o_custkey
""")
def latest_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_orderstatus")
    return state.latest(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_orderstatus")


@query("""
SELECT o_custkey, o_orderkey, row_number() OVER w - 1 AS ord, lag(o_orderkey) OVER w AS parent FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)
""")
def version_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.parents(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_orderkey").select("o_custkey", "o_orderkey", "ord", "parent")


JOBS = "j AS (SELECT *, user_id * 10 + event_id % 10 AS job, row_number() OVER (PARTITION BY user_id * 10 + event_id % 10 ORDER BY ts, event_id) AS n FROM events)"


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observations(spark, sf_dir).withColumn("job", F.col("user_id") * 10 + F.col("event_id") % 10)


@query(f"""
WITH {JOBS}, s AS (SELECT job, min(n) FILTER (WHERE event_type IN ('view', 'click')) AS started, count(*) AS events FROM j GROUP BY job),
e AS (SELECT j.job, arg_min(event_type, n) AS state FROM j JOIN s ON s.job = j.job WHERE event_type IN ('purchase', 'error') AND n >= started GROUP BY j.job)
SELECT s.job, coalesce(e.state, CASE WHEN started IS NOT NULL THEN 'running' ELSE 'queued' END) AS state, s.events FROM s LEFT JOIN e ON e.job = s.job
""")
def job_state_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.folded_jobs(_jobs(spark, sf_dir), ["job"], ["ts", "event_id"], "event_type", ("view", "click"), ("purchase", "error"))


@query("""
WITH g AS (SELECT user_id, event_id, epoch_us(lead(ts) OVER w) - epoch_us(ts) AS gap FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, event_id, round(gap / 1000000.0, 3) AS gap FROM g WHERE gap > 100000 * 1000000.0
""")
def stale_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = state.gaps(observations(spark, sf_dir), "user_id", ["ts", "event_id"], F.unix_micros(F.col("ts").cast("timestamp")), 100000 * 1000000.0)
    return found.select("user_id", "event_id", F.round(F.col("gap") / 1000000.0, 3).alias("gap"))


@query("""
WITH l AS (SELECT user_id, max(epoch(ts)) AS seen FROM events GROUP BY user_id), n AS (SELECT max(epoch(ts)) AS now FROM events)
SELECT user_id, now - seen <= 40000 AS connected FROM l, n
""")
def connected_devices(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = observations(spark, sf_dir).withColumn("at", F.col("ts").cast("timestamp").cast("double"))
    return state.connected(rows, "user_id", "at", state.clock(rows, "at"), 40000)


@query("""
WITH t AS (SELECT user_id, min(epoch(ts)) AS issued FROM events WHERE event_type = 'signup' GROUP BY user_id),
u AS (SELECT e.user_id, e.event_id, epoch(e.ts) - issued AS after, row_number() OVER (PARTITION BY e.user_id ORDER BY epoch(e.ts), e.event_id) AS n
      FROM events e JOIN t ON t.user_id = e.user_id WHERE event_type = 'click' AND epoch(e.ts) >= issued AND epoch(e.ts) - issued <= 180000)
SELECT user_id, event_id FROM u WHERE n = 1
""")
def token_uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = observations(spark, sf_dir).withColumn("at", F.col("ts").cast("timestamp").cast("double"))
    tokens = rows.filter("event_type = 'signup'").groupBy("user_id").agg(F.min("at").alias("issued"))
    uses = rows.filter("event_type = 'click'").select("user_id", "event_id", F.col("at").alias("used"))
    return state.used_once(tokens, uses, ["user_id"], "issued", "used", "event_id", 180000).select("user_id", "event_id")


@query("""
WITH r AS (SELECT conv_id, turn, row_number() OVER w AS n, sum(strlen(text)) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS used FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn DESC))
SELECT conv_id, turn FROM r WHERE n <= 6 AND used <= 2000
""")
def top_k_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return state.within_budget(turns, ["conv_id"], ["turn"], F.octet_length("text"), 6, 2000).select("conv_id", "turn")


@query("""
WITH n AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, count(*) OVER (PARTITION BY conv_id) AS c FROM conversations),
p AS (SELECT *, least(c, 5) AS stop, max(CASE WHEN role = 'user' THEN pos END) OVER (PARTITION BY conv_id) AS newest FROM n)
SELECT conv_id, turn, pos, role = 'user' AND pos = newest AS actionable FROM p WHERE pos < stop AND pos >= stop - 3
""")
def transcript_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return state.transcript_page(turns, ["conv_id"], ["turn"], F.lit(5), 3, F.col("role") == "user").select("conv_id", "turn", "pos", "actionable")


@query("""
SELECT n_name, count(*) AS members, CAST(least(100, round(100 * sum(CASE WHEN c_acctbal > 0 THEN c_acctbal ELSE 0 END) / nullif(n_nationkey * 20000, 0))) AS BIGINT) AS percent
FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY n_name, n_nationkey
""")
def quota_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    used = F.sum(F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).otherwise(0.0))
    found = rows.groupBy("n_name", "n_nationkey").agg(F.count(F.lit(1)).alias("members"), used.alias("used"))
    return found.select("n_name", "members", state.quota_percent(F.col("used"), F.col("n_nationkey") * 20000).alias("percent"))


@query("SELECT n_regionkey AS role, count(*) AS members, min(n_nationkey) AS first_seen FROM nation GROUP BY n_regionkey")
def role_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("role")).agg(F.count(F.lit(1)).alias("members"), F.min("n_nationkey").alias("first_seen"))


@query("""
SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'O') AS open, count(*) FILTER (WHERE o_orderstatus = 'F') AS finished, count(*) FILTER (WHERE o_orderstatus = 'P') AS partial
FROM orders GROUP BY o_orderpriority
""")
def queue_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.state_counts(table(spark, sf_dir, "orders"), ["o_orderpriority"], "o_orderstatus", {"O": "open", "F": "finished", "P": "partial"})


@query("""
SELECT event_id AS seq, event_type AS action, coalesce(CASE WHEN event_type <> 'view' THEN props END, '') AS detail FROM events
""")
def audit_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("event_type").alias("action"), F.when(F.col("event_type") != "view", F.col("props")).alias("detail"))
    return rows.na.fill("").orderBy(F.desc("seq"))


@query("SELECT event_id, event_type, CAST(props->>'$.k' AS INTEGER) AS k, CAST(props->>'$.k' AS INTEGER) * 2 AS twice FROM events")
def json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = F.from_json("props", "struct<k:int>")
    return table(spark, sf_dir, "events").select("event_id", "event_type", parsed["k"].alias("k"), (parsed["k"] * 2).alias("twice"))


@query("""
WITH c AS (SELECT user_id, event_id, epoch(ts) AS made, (SELECT max(epoch(ts)) FROM events) AS now FROM events WHERE event_type = 'signup'),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY made DESC, event_id DESC) AS n FROM c WHERE now - made <= 600000)
SELECT user_id, event_id FROM r WHERE n <= 5
""")
def pairing_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = observations(spark, sf_dir).withColumn("at", F.col("ts").cast("timestamp").cast("double"))
    codes = rows.filter("event_type = 'signup'")
    return state.live_codes(codes, "user_id", "at", "event_id", state.clock(rows, "at"), 600000, 5).select("user_id", "event_id")


@query("""
WITH q AS (SELECT user_id AS device, event_id AS job, CAST(props->>'$.k' AS INTEGER) % 9 AS scene, row_number() OVER (PARTITION BY user_id, CAST(props->>'$.k' AS INTEGER) % 9 ORDER BY ts DESC, event_id DESC) AS n FROM events WHERE event_type IN ('view', 'click'))
SELECT device, job, scene, CASE WHEN n = 1 THEN 'queued' ELSE 'superseded' END AS state FROM q
""")
def superseded_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = observations(spark, sf_dir).filter(F.col("event_type").isin("view", "click"))
    jobs = rows.select(F.col("user_id").alias("device"), F.col("event_id").alias("job"), (F.col("k") % 9).alias("scene"), "ts")
    return state.superseded(jobs, ["device", "scene"], ["ts", "job"]).drop("ts")


@query("""
WITH d AS (SELECT event_id AS job, user_id AS device, event_type, event_id - 3 AS needs FROM events), p AS (SELECT event_id, event_type FROM events),
r AS (SELECT d.job, d.device, row_number() OVER (PARTITION BY d.device ORDER BY d.job) AS n FROM d LEFT JOIN p ON p.event_id = d.needs WHERE d.event_type = 'view' AND (p.event_id IS NULL OR p.event_type = 'purchase')),
b AS (SELECT DISTINCT user_id AS device FROM events WHERE event_type = 'error' AND event_id % 11 = 0)
SELECT device, job FROM r WHERE n = 1 AND device NOT IN (SELECT device FROM b)
""")
def next_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = observations(spark, sf_dir).select(F.col("event_id").alias("job"), F.col("user_id").alias("device"), "event_type")
    needed = rows.select((F.col("job") + 3).alias("job"), F.col("event_type").alias("state"))
    busy = rows.filter("event_type = 'error' and job % 11 = 0")
    return state.next_jobs(rows.filter("event_type = 'view'"), needed, busy, "device", "job", done="purchase")


@query("""
SELECT event_id, greatest(0, 4 - CAST(props->>'$.k' AS INTEGER) % 7) AS retries_left, greatest(0, least(CAST(props->>'$.k' AS INTEGER), 80)) AS first_frame,
       CASE event_type WHEN 'view' THEN 600 WHEN 'click' THEN 420 WHEN 'signup' THEN 300 WHEN 'purchase' THEN 60 ELSE 0 END AS eta FROM events
""")
def job_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    eta = state.seconds_left(F.col("event_type"), {"view": 600, "click": 420, "signup": 300, "purchase": 60})
    return observations(spark, sf_dir).select("event_id", state.remaining(F.col("k") % 7, 4).alias("retries_left"), state.clipped(F.col("k"), 0, 80).alias("first_frame"), eta.alias("eta"))
