"""Queries over the ordered events of users and the orders of customers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import sequence as seq
from ..sources.tables import observations, table
from .registry import query

ENTITY, ORDER = ["user_id"], ["ts", "event_id"]

#: Events numbered per user with the change from the event before.
CHANGED = """
o AS (
  SELECT user_id, event_id, ts, event_type, value, CAST(props->>'$.k' AS INTEGER) AS k,
         row_number() OVER w - 1 AS idx, coalesce(abs(value - lag(value) OVER w), 0) AS change
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
)"""


def _changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = seq.indexed(observations(spark, sf_dir), ENTITY, ORDER)
    return seq.changes(rows, ENTITY, ORDER, "value")


@query(f"WITH {CHANGED} SELECT user_id, event_id, round(change, 6) AS change FROM o")
def change_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _changed(spark, sf_dir).select("user_id", "event_id", F.round("change", 6).alias("change"))


@query(f"""
WITH {CHANGED},
m AS (SELECT *, CASE WHEN idx - lag(idx) OVER w <= 2 THEN 0 ELSE 1 END AS opened FROM o WHERE change > 40 WINDOW w AS (PARTITION BY user_id ORDER BY idx)),
r AS (SELECT *, sum(opened) OVER (PARTITION BY user_id ORDER BY idx) AS run FROM m)
SELECT user_id, min(idx) AS first, max(idx) AS last, count(*) AS n FROM r GROUP BY user_id, run
HAVING max(idx) - min(idx) + 1 >= 2 OR max(change) > 150
""")
def motion_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seq.runs(_changed(spark, sf_dir), ENTITY, "idx", F.col("change") > 40, step=F.col("change") > 150)


@query(f"""
WITH {CHANGED},
n AS (SELECT *, lead(value) OVER w AS nv, lead(k) OVER w AS nk FROM o WINDOW w AS (PARTITION BY user_id ORDER BY idx)),
s AS (SELECT user_id, 'value' AS type, 0 AS rk, idx FROM n WHERE abs(nv - value) > 40
      UNION ALL SELECT user_id, 'k', 1, idx FROM n WHERE abs(nk - k) > 50),
m AS (SELECT *, CASE WHEN idx - lag(idx) OVER (PARTITION BY user_id, rk ORDER BY idx) <= 2 THEN 0 ELSE 1 END AS opened FROM s),
r AS (SELECT *, sum(opened) OVER (PARTITION BY user_id, rk ORDER BY idx) AS run FROM m),
e AS (SELECT user_id, type, rk, min(idx) AS a, max(idx) + 1 AS z FROM r GROUP BY user_id, type, rk, run HAVING max(idx) - min(idx) >= 1)
SELECT e.user_id, row_number() OVER (PARTITION BY e.user_id ORDER BY a, rk) AS motion, type, a AS start, z AS "end", z - a AS dur,
       round(CASE WHEN rk = 0 THEN y.value - x.value ELSE CAST(y.k - x.k AS DOUBLE) END, 6) AS mag
FROM e JOIN o x ON x.user_id = e.user_id AND x.idx = a JOIN o y ON y.user_id = e.user_id AND y.idx = z
""")
def motion_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _changed(spark, sf_dir).withColumn("k", F.col("k").cast("double"))
    found = seq.motions(rows, ENTITY, "idx", {"value": ("value", 40.0), "k": ("k", 50.0)})
    return found.withColumn("mag", F.round("mag", 6))


@query(f"""
WITH {CHANGED},
m AS (SELECT user_id, idx, CASE WHEN k % 17 <> 0 THEN value END AS x, CAST(k AS DOUBLE) AS y, 1.0 + k % 4 AS sx, 2.0 AS sy, CAST(k % 90 AS DOUBLE) AS rot, (k % 5) / 10.0 AS opacity FROM o),
n AS (SELECT *, lead(x) OVER w AS nx, lead(y) OVER w AS ny, lead(sx) OVER w AS nsx, lead(rot) OVER w AS nrot, lead(opacity) OVER w AS nop FROM m WINDOW w AS (PARTITION BY user_id ORDER BY idx)),
s AS (SELECT user_id, idx, unnest([{{'t': 'translation', 'r': 0, 's': sqrt((nx - x) ** 2 + (ny - y) ** 2), 'e': 60.0, 'j': 110.0}}, {{'t': 'rotation', 'r': 1, 's': abs(nrot - rot), 'e': 30.0, 'j': 85.0}},
  {{'t': 'scale', 'r': 2, 's': abs(nsx - sx), 'e': 1.5, 'j': 2.5}}, {{'t': 'opacity', 'r': 3, 's': abs(nop - opacity), 'e': 0.25, 'j': 9.0}}]) AS c FROM n WHERE x IS NOT NULL AND nx IS NOT NULL),
v AS (SELECT *, CASE WHEN idx - lag(idx) OVER (PARTITION BY user_id, c.r ORDER BY idx) <= 2 THEN 0 ELSE 1 END AS opened FROM s WHERE c.s > c.e),
r AS (SELECT *, sum(opened) OVER (PARTITION BY user_id, c.r ORDER BY idx) AS run FROM v),
e AS (SELECT user_id, c.t AS type, c.r AS rk, min(idx) AS a, max(idx) + 1 AS z FROM r GROUP BY user_id, c.t, c.r, run HAVING max(idx) - min(idx) >= 1 OR max(c.s - c.j) > 0),
f AS (SELECT e.*, q.x - p.x AS dx, q.y - p.y AS dy, q.rot - p.rot AS dr, q.opacity - p.opacity AS dop, 0.5 * (q.sx / p.sx + q.sy / p.sy) AS ratio
      FROM e JOIN m p ON p.user_id = e.user_id AND p.idx = a JOIN m q ON q.user_id = e.user_id AND q.idx = z)
SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY a, rk) AS motion, type, a AS start, z AS "end", z - a AS dur,
  round(CASE WHEN rk = 0 AND sqrt(dx * dx + dy * dy) > 0 THEN dx / sqrt(dx * dx + dy * dy) END, 6) + 0.0 AS dir_x, round(CASE WHEN rk = 0 AND sqrt(dx * dx + dy * dy) > 0 THEN dy / sqrt(dx * dx + dy * dy) END, 6) + 0.0 AS dir_y,
  round(CASE rk WHEN 0 THEN sqrt(dx * dx + dy * dy) WHEN 1 THEN dr WHEN 2 THEN ratio ELSE dop END, 6) + 0.0 AS mag FROM f
""")
def matrix_motions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    rows = _changed(spark, sf_dir).select("user_id", "idx", F.when(k % 17 != 0, F.col("value")).alias("x"), k.alias("y"), (1 + k % 4).alias("sx"), F.lit(2.0).alias("sy"), (k % 90).alias("rot"), ((k % 5) / 10).alias("opacity"))
    found = seq.matrix_motions(rows, ENTITY, "idx", eps={"translation": 60.0, "rotation": 30.0, "scale": 1.5, "opacity": 0.25}, step={"translation": 110.0, "rotation": 85.0, "scale": 2.5, "opacity": 9.0})
    return found.withColumns({c: F.round(c, 6) + 0.0 for c in ("dir_x", "dir_y", "mag")})


@query()
def eased_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.curves import eased_keys as keys

    rows = seq.indexed(observations(spark, sf_dir), ENTITY, ORDER)
    return keys(rows, ENTITY, "idx", "value", F.lit(30.0)).withColumns({"v": F.round("v", 6), "error": F.round("error", 6)})


def _properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = seq.indexed(observations(spark, sf_dir), ENTITY, ORDER)
    return rows.select("user_id", "idx", F.col("value").alias("x"), F.col("k").alias("rot"), (1 + F.col("k") / 1000.0).alias("sx"), (F.col("k") / 100.0).alias("opacity"), (F.col("user_id") % 200 + 1).alias("width"))


@query()
def property_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.curves import property_keys as keys

    found = keys(_properties(spark, sf_dir), ENTITY, "idx", ["x", "rot", "sx", "opacity"], {"sx": "width"})
    return found.withColumns({"v": F.round("v", 6), "error": F.round("error", 6)})


@query()
def fit_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import curves

    rows, names = _properties(spark, sf_dir), ["x", "rot", "sx", "opacity"]
    found = curves.fit_errors(curves.property_keys(rows, ENTITY, "idx", names, {"sx": "width"}), rows, ENTITY, "idx", names, {"sx": "width"})
    return found.withColumn("place_error", F.round("place_error", 4))


@query(f"""
WITH {CHANGED},
w AS (SELECT *, sum(change) OVER v - change AS s, count(*) OVER v - 1 AS c FROM o WHERE change > 0.5
      WINDOW v AS (PARTITION BY user_id ORDER BY idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING))
SELECT user_id, idx, event_id, round(change, 6) AS change FROM w
WHERE change >= greatest(20.0, CASE WHEN c > 0 THEN 3.0 * s / c ELSE 0 END)
""")
def spike_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = seq.spikes(_changed(spark, sf_dir), ENTITY, "idx", "change", floor=20.0, factor=3.0, duplicate=0.5)
    return found.select("user_id", "idx", "event_id", F.round("change", 6).alias("change"))


@query(f"""
WITH {CHANGED},
m AS (SELECT *, CASE WHEN idx - lag(idx) OVER (PARTITION BY user_id ORDER BY idx) <= 2 THEN 0 ELSE 1 END AS opened FROM o WHERE change >= 30),
r AS (SELECT *, sum(opened) OVER (PARTITION BY user_id ORDER BY idx) AS run FROM m),
g AS (SELECT user_id, min(idx) AS a, max(idx) AS z FROM r GROUP BY user_id, run HAVING max(idx) - min(idx) >= 2),
j AS (SELECT *, CASE WHEN a - lag(z) OVER (PARTITION BY user_id ORDER BY a) < 6 THEN 0 ELSE 1 END AS opened FROM g),
k AS (SELECT *, sum(opened) OVER (PARTITION BY user_id ORDER BY a) AS grp FROM j)
SELECT user_id, min(a) AS first, max(z) AS last, count(*) AS parts FROM k GROUP BY user_id, grp
""")
def merge_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = seq.runs(_changed(spark, sf_dir), ENTITY, "idx", F.col("change") >= 30, least=3)
    return seq.merged_runs(found, ENTITY, apart=6)


@query(f"""
WITH {CHANGED},
c AS (SELECT *, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY idx) THEN 0 ELSE 1 END AS cut FROM o),
s AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY idx) AS segment FROM c),
g AS (SELECT user_id, CAST(segment AS BIGINT) AS segment, min(idx) AS first, max(idx) AS last FROM s GROUP BY user_id, segment)
SELECT *, coalesce(first = lag(last) OVER (PARTITION BY user_id ORDER BY segment) + 1, TRUE) AS contiguous FROM g
""")
def segments_contiguous(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = seq.first_of_run(_changed(spark, sf_dir), ENTITY, ["idx"], "event_type")
    return seq.segments(rows, ENTITY, "idx", F.col("is_first"))


@query(f"""
WITH {CHANGED}, c AS (SELECT *, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY idx) THEN 0 ELSE 1 END AS fresh FROM o)
SELECT user_id, event_id, CAST(sum(fresh) OVER (PARTITION BY user_id ORDER BY idx) AS BIGINT) AS run, fresh = 1 AS is_first FROM c
""")
def run_length_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seq.first_of_run(_changed(spark, sf_dir), ENTITY, ["idx"], "event_type").select("user_id", "event_id", "run", "is_first")


@query("""
WITH d AS (SELECT DISTINCT o_custkey, date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) // 30 AS period FROM orders),
i AS (SELECT *, period - row_number() OVER (PARTITION BY o_custkey ORDER BY period) AS island FROM d)
SELECT o_custkey, min(period) AS first, max(period) AS last, count(*) AS n FROM i GROUP BY o_custkey, island
""")
def frame_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1995-01-01").cast("date"))
    return seq.intervals(table(spark, sf_dir, "orders").select("o_custkey", F.floor(day / 30).alias("period")), ["o_custkey"], "period")


HOURLY = """
h AS (SELECT user_id, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS hour, avg(value) AS value FROM events GROUP BY 1, 2),
b AS (SELECT user_id, min(hour) AS a, max(hour) AS z FROM h GROUP BY user_id),
g AS (SELECT user_id, unnest(range(a, z + 1)) AS hour FROM b),
d AS (SELECT g.user_id, g.hour, h.value FROM g LEFT JOIN h ON h.user_id = g.user_id AND h.hour = g.hour)"""


def _hourly_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    hour = F.floor(F.col("ts").cast("timestamp").cast("double") / 3600)
    return observations(spark, sf_dir).groupBy("user_id", hour.alias("hour")).agg(F.avg("value").alias("value"))


def _hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seq.dense(_hourly_means(spark, sf_dir), ENTITY, "hour")


@query(f"""
WITH {HOURLY}
SELECT user_id, hour, round(last_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY hour ROWS UNBOUNDED PRECEDING), 4) AS held FROM d
""")
def densify_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seq.held(_hourly(spark, sf_dir), ENTITY, "hour", "value").select("user_id", "hour", F.round("held", 4).alias("held"))


@query(f"""
WITH {HOURLY},
f AS (SELECT *, last_value(value IGNORE NULLS) OVER p AS v0, last_value(CASE WHEN value IS NOT NULL THEN hour END IGNORE NULLS) OVER p AS p0,
             first_value(value IGNORE NULLS) OVER n AS v1, first_value(CASE WHEN value IS NOT NULL THEN hour END IGNORE NULLS) OVER n AS p1
      FROM d WINDOW p AS (PARTITION BY user_id ORDER BY hour ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                    n AS (PARTITION BY user_id ORDER BY hour ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT user_id, hour, round(CASE WHEN p1 = p0 THEN v0 ELSE v0 + (v1 - v0) * ((hour - p0) / (p1 - p0)) END, 6) AS filled FROM f
""")
def fill_gaps_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seq.filled_dense(_hourly_means(spark, sf_dir), ENTITY, "hour", "value").select("user_id", "hour", F.round("filled", 6).alias("filled"))


@query(f"""
WITH {CHANGED},
d AS (SELECT user_id, value - lag(value) OVER w AS d1, value - 3 * lag(value) OVER w + 3 * lag(value, 2) OVER w - lag(value, 3) OVER w AS d3
      FROM o WINDOW w AS (PARTITION BY user_id ORDER BY idx)),
m AS (SELECT user_id, median(d1) AS m1, median(d3) AS m3, count(*) AS n FROM d GROUP BY user_id)
SELECT d.user_id, first(n) AS n, round(CASE WHEN first(n) < 11 THEN 0 ELSE
  least(median(abs(d1 - m1)) / 0.6745 / sqrt(2), median(abs(d3 - m3)) / 0.6745 / sqrt(20)) * sqrt(2 * ln(first(n))) END, 4) AS bound
FROM d JOIN m ON m.user_id = d.user_id GROUP BY d.user_id
""")
def noise_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seq.noise_bound(observations(spark, sf_dir), ENTITY, ORDER, "value").withColumn("bound", F.round("bound", 4))


@query(f"""
WITH {CHANGED},
c AS (SELECT user_id, idx, sum(value) OVER (PARTITION BY user_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS total FROM o),
l AS (SELECT *, lag(total) OVER (PARTITION BY user_id ORDER BY idx) AS before FROM c)
SELECT user_id, round(min(CASE WHEN before IS NULL AND total >= 1000 THEN CAST(idx AS DOUBLE)
  WHEN before < 1000 AND total >= 1000 THEN idx - 1 + (1000 - before) / (total - before) END), 4) AS crossing
FROM l GROUP BY user_id
""")
def crossing_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    running = F.sum("value").over(Window.partitionBy("user_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0))
    rows = _changed(spark, sf_dir).withColumn("total", running)
    return seq.crossings(rows, ENTITY, "idx", "total", F.lit(1000.0)).withColumn("crossing", F.round("crossing", 4))


@query(f"""
WITH {CHANGED},
c AS (SELECT *, CASE WHEN greatest(change, coalesce(lead(change) OVER (PARTITION BY user_id ORDER BY idx), 'inf'::DOUBLE)) < 20 THEN idx END AS calm FROM o)
SELECT user_id, idx, coalesce(first_value(calm IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING), idx) AS settled FROM c
""")
def settled_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seq.settled(_changed(spark, sf_dir), ENTITY, "idx", "change", quiet=20.0, within=6).select("user_id", "idx", "settled")


@query(f"""
WITH {CHANGED}, t AS (SELECT *, CAST(round_even(10 + (idx - 10) / 2.5, 0) AS BIGINT) + 3 AS new_t FROM o)
SELECT user_id, new_t, arg_max(event_id, idx) AS event_id, max(idx) AS idx FROM t GROUP BY user_id, new_t
""")
def retime_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seq.retimed(_changed(spark, sf_dir), ENTITY, "idx", [], speed=2.5, delay=3, anchor=F.lit(10)).select("user_id", "new_t", "event_id", "idx")


@query(f"""
WITH {CHANGED}, c AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM o)
SELECT user_id, idx, event_id FROM c
WHERE n <= 24 OR idx IN (SELECT CAST(floor(i * (n - 1) / 23.0 + 0.5) AS BIGINT) FROM range(24) t(i))
""")
def evenly_spaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seq.evenly(_changed(spark, sf_dir), ENTITY, "idx", 24).select("user_id", "idx", "event_id")


@query()
def reduced_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = seq.indexed(observations(spark, sf_dir), ENTITY, ORDER)
    return seq.keyed_curve(rows, ENTITY, "idx", "value", bound=60.0)


@query(f"""
WITH {CHANGED}, s AS (SELECT user_id, string_agg('[' || idx || ',' || k || ']', ',' ORDER BY idx) AS t FROM o WHERE event_type = 'signup' GROUP BY user_id)
SELECT user_id, sha256('[' || t || ']') AS digest FROM s
""")
def boundary_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _changed(spark, sf_dir).filter("event_type = 'signup'")
    pairs = F.transform(F.array_sort(F.collect_list(F.struct("idx", "k"))), lambda p: F.array(p["idx"], p["k"].cast("long")))
    return rows.groupBy("user_id").agg(F.sha2(F.to_json(pairs), 256).alias("digest"))


@query(f"""
WITH {CHANGED}, n AS (SELECT user_id, idx, value, lead(idx) OVER w AS i2, lead(value) OVER w AS v2 FROM o WHERE k % 4 = 0 WINDOW w AS (PARTITION BY user_id ORDER BY idx))
SELECT user_id, idx, round((v2 - value) / (i2 - idx) * 30, 4) + 0.0 AS speed, CAST(round(0.42 * 100, 4) AS DOUBLE) AS influence FROM n WHERE v2 IS NOT NULL
""")
def key_handles(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = seq.handles(_changed(spark, sf_dir).filter("k % 4 = 0"), ENTITY, "idx", "value", fps=30, influence=0.42)
    return found.withColumns({"speed": F.round("speed", 4) + 0.0, "influence": F.round("influence", 4)})


@query(f"""
WITH {CHANGED}, t AS (SELECT DISTINCT user_id, idx FROM o WHERE k % 5 = 0 OR k % 7 = 0),
a AS (SELECT t.*, last_value(CASE WHEN k % 5 = 0 THEN value END IGNORE NULLS) OVER w AS x, last_value(CASE WHEN k % 7 = 0 THEN value END IGNORE NULLS) OVER w AS y
      FROM t JOIN o USING (user_id, idx) WINDOW w AS (PARTITION BY user_id ORDER BY idx ROWS UNBOUNDED PRECEDING))
SELECT user_id, idx, x, y FROM a
""")
def merged_timelines(spark: SparkSession, sf_dir: str) -> DataFrame:
    channels = {"x": F.when(F.col("k") % 5 == 0, F.col("value")), "y": F.when(F.col("k") % 7 == 0, F.col("value"))}
    return seq.merged_timeline(_changed(spark, sf_dir), ENTITY, "idx", channels)


@query("""
WITH RECURSIVE c AS (SELECT p_partkey // 2000 AS scene, p_partkey % 50 AS x, p_partkey % 2000 // 50 AS y, p_size % 3 AS label FROM part),
e AS (SELECT a.scene, a.x, a.y, b.x AS x2, b.y AS y2 FROM c a JOIN c b ON b.scene = a.scene AND b.label = a.label AND abs(b.x - a.x) <= 1 AND abs(b.y - a.y) <= 1 AND (a.x <> b.x OR a.y <> b.y)),
r(scene, x, y, u, v) AS (SELECT scene, x, y, x, y FROM c UNION SELECT r.scene, r.x, r.y, e.x2, e.y2 FROM r JOIN e ON e.scene = r.scene AND e.x = r.u AND e.y = r.v),
m AS (SELECT scene, x, y, min({'y': v, 'x': u}) AS head FROM r GROUP BY ALL)
SELECT m.scene AS scene, head.y AS head_y, head.x AS head_x, label, count(*) AS area, min(m.x) AS x0, min(m.y) AS y0, max(m.x) + 1 AS x1, max(m.y) + 1 AS y1
FROM m JOIN c ON c.scene = m.scene AND c.x = m.x AND c.y = m.y GROUP BY m.scene, head, label HAVING count(*) >= 3
""")
def label_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.tracks import regions

    cells = table(spark, sf_dir, "part").select(F.floor(F.col("p_partkey") / 2000).alias("scene"), (F.col("p_partkey") % 50).alias("x"), F.floor(F.col("p_partkey") % 2000 / 50).alias("y"), (F.col("p_size") % 3).alias("label"))
    found = regions(cells, ["scene"], "x", "y", "label", least=3)
    return found.select("region.scene", F.col("region.y").alias("head_y"), F.col("region.x").alias("head_x"), "label", "area", "x0", "y0", "x1", "y1")


@query(f"""
WITH RECURSIVE {CHANGED}, c AS (SELECT user_id, idx, event_id FROM o WHERE change >= 40),
n AS (SELECT c.user_id, c.idx, min(d.idx) AS next FROM c JOIN c d ON d.user_id = c.user_id AND d.idx >= c.idx + 6 GROUP BY 1, 2),
r(user_id, idx, n) AS (SELECT user_id, min(idx), 1 FROM c GROUP BY user_id UNION ALL SELECT r.user_id, next, r.n + 1 FROM r JOIN n ON n.user_id = r.user_id AND n.idx = r.idx WHERE r.n < 24)
SELECT r.user_id, r.idx, event_id FROM r JOIN c ON c.user_id = r.user_id AND c.idx = r.idx
""")
def spaced_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.greedy import spaced

    return spaced(_changed(spark, sf_dir).filter("change >= 40").select("user_id", "idx", "event_id"), ENTITY, "idx", gap=6, most=24)


@query(f"""
WITH RECURSIVE {CHANGED},
f(user_id, idx, room, form) AS (SELECT DISTINCT user_id, CAST(-1 AS BIGINT), CAST(6000 AS BIGINT), CAST(NULL AS VARCHAR) FROM o
  UNION ALL SELECT f.user_id, o.idx, room - CASE WHEN k * 10 <= room THEN k * 10 WHEN k <= room THEN k ELSE 0 END, CASE WHEN k * 10 <= room THEN 'full' WHEN k <= room THEN 'small' END
  FROM f JOIN o ON o.user_id = f.user_id AND o.idx = f.idx + 1)
SELECT user_id, idx, form FROM f WHERE idx >= 0
""")
def view_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.greedy import fit_in_budget

    rows = _changed(spark, sf_dir).select("user_id", "idx", (F.col("k") * 10).alias("full"), F.col("k").alias("small"))
    return fit_in_budget(rows, ENTITY, ["idx"], "full", "small", 6000)
