"""Queries that find structure: palettes, neighbours, choices without conflict, titles and their integrity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import choose, cluster, grid, similar, stages, titles, train, vectors
from ..operators.checkpoints import spread
from ..sources.tables import observations, table
from .joins import HALVES, _halves
from .registry import query


@query()
def palette_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors by the nearest of at most eight centres found among them."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    centres = cluster.palette(rows, "embedding", "vec_id", k=8, apart=0.05, passes=12, least_move=0.005)
    return cluster.labelled(rows, "embedding", centres).select("vec_id", "label", F.round("distance", 4).alias("distance"))


@query("""
WITH e AS (SELECT user_id, event_id, event_type, value AS x, CAST(props->>'$.k' AS DOUBLE) AS y FROM events),
d AS (SELECT v.user_id, v.event_id, p.event_id AS other, sqrt((p.x - v.x) * (p.x - v.x) + (p.y - v.y) * (p.y - v.y)) AS d FROM e v JOIN e p ON p.user_id = v.user_id AND v.event_type = 'view' AND p.event_type = 'purchase')
SELECT user_id, event_id, CAST(row_number() OVER w AS INTEGER) AS rank, other, round(d, 6) AS distance FROM d
WINDOW w AS (PARTITION BY user_id, event_id ORDER BY d, other) QUALIFY row_number() OVER w <= 3
""")
def nearest_in_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = observations(spark, sf_dir).select("user_id", "event_id", "event_type", F.col("value").alias("x"), "k")
    views, bought = rows.filter("event_type = 'view'"), rows.filter("event_type = 'purchase'").withColumnRenamed("event_id", "bought")
    found = grid.nearest_in_rings(views, bought, ["user_id"], "event_id", "bought", "x", "k", 3, 8.0)
    return found.withColumn("distance", F.round("distance", 6))


@query(f"""
WITH RECURSIVE {HALVES}, p AS (SELECT *, row_number() OVER (PARTITION BY o ORDER BY cost, i, j) AS n FROM h WHERE cost <= 0.95),
g(o, n, lefts, rights, i, j, cost, took) AS (SELECT DISTINCT o, CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST([] AS BIGINT[]), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS DOUBLE), FALSE FROM p
  UNION ALL SELECT o, n, CASE WHEN t THEN list_append(lefts, i) ELSE lefts END, CASE WHEN t THEN list_append(rights, j) ELSE rights END, i, j, cost, t
  FROM (SELECT g.o, p.n, lefts, rights, CAST(p.i AS BIGINT) AS i, CAST(p.j AS BIGINT) AS j, p.cost, NOT (list_contains(lefts, CAST(p.i AS BIGINT)) OR list_contains(rights, CAST(p.j AS BIGINT))) AS t FROM g JOIN p ON p.o = g.o AND p.n = g.n + 1))
SELECT o, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(cost, 6) AS cost FROM g WHERE took
""")
def chosen_in_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of an order's lines taken by cost, each line once: as greedy_match takes them, but on the JVM and in rounds."""
    pairs = _halves(spark, sf_dir).filter("cost <= 0.95")
    proposed = pairs.select("*", F.struct("o", "i", "j").alias("pair"), F.array(F.struct("o", "i"), F.struct("o", F.col("j").alias("i"))).alias("lines"))
    return choose.independent(proposed, "pair", "lines", ["cost"]).select("o", "i", "j", F.round("cost", 6).alias("cost"))


TITLE_PIECES = """
f AS (SELECT l_orderkey AS scene, l_orderkey * 10 + l_linenumber AS id, any_value(l_linenumber) AS i, min(date_diff('day', DATE '1990-01-01', CAST(l_shipdate AS DATE)) % 12) AS first, max(date_diff('day', DATE '1990-01-01', CAST(l_shipdate AS DATE)) % 12 + 3 + l_partkey % 9) AS last,
        max(l_partkey) AS p, max(l_suppkey) AS s, CAST(max(l_quantity) AS BIGINT) AS q, max(l_discount) * 100.0 AS rot, 50 + max(l_tax) * 200.0 AS l FROM lineitem GROUP BY 1, 2),
t AS (SELECT *, CASE WHEN p % 4 = 0 THEN '' ELSE repeat(chr(CAST(65 + p % 3 AS INTEGER)), 4) END AS text, 10.0 + q % 8 AS h, CASE WHEN s % 10 = 0 THEN 1 END AS cut FROM f),
b AS (SELECT scene, id, frame, i * 18.0 + (frame - first) * (p % 2) * 3 AS x0, i * 18.0 + (frame - first) * ((p % 2) * 3 + CASE WHEN p % 5 = 0 THEN 5 ELSE 0 END) + 12 + q % 10 AS x1, (s % 3) * 4.0 AS y0, (s % 3) * 4.0 + h AS y1 FROM (SELECT *, unnest(range(first, last + 1)) AS frame FROM t)),
n AS (SELECT a.scene, a.id AS p, c.id AS q, greatest(a.h, c.h) AS h, a.text AS ta, c.text AS tb, a.h AS ha, c.h AS hb, a.first AS fa, c.first AS fb, a.last AS la, c.last AS lb, 12.0 + a.q % 10 + CASE WHEN a.p % 5 = 0 THEN 2.5 ELSE 0 END * (a.last - a.first) AS wa, 12.0 + c.q % 10 + CASE WHEN c.p % 5 = 0 THEN 2.5 ELSE 0 END * (c.last - c.first) AS wb, (a.s % 3) * 4.0 + a.h / 2 AS ya, (c.s % 3) * 4.0 + c.h / 2 AS yb
  FROM t a JOIN t c ON c.scene = a.scene AND a.id < c.id WHERE NOT coalesce(a.cut = c.cut, FALSE) AND greatest(a.h, c.h) <= 1.6 * least(a.h, c.h) AND abs(a.l - c.l) <= 20 AND abs(a.rot - c.rot) <= 5 AND (a.text <> '' OR c.text <> '')),
c AS (SELECT n.p, n.q, a.frame, row_number() OVER (PARTITION BY n.p, n.q ORDER BY a.frame) AS rn, count(*) OVER (PARTITION BY n.p, n.q) AS k, a.x0 - d.x0 AS d0, a.x1 - d.x1 AS d1, (a.y0 + a.y1 - d.y0 - d.y1) / 2 AS dy, greatest(a.x0, d.x0) - least(a.x1, d.x1) AS gap
  FROM n JOIN b a ON a.scene = n.scene AND a.id = n.p JOIN b d ON d.scene = n.scene AND d.id = n.q AND d.frame = a.frame),
m AS (SELECT p, q, count(*) AS k, median(abs(dy)) AS dy, median(gap) AS gap FROM c GROUP BY 1, 2),
steps AS (SELECT unnest([TRUE, FALSE]) AS steps),
v AS (SELECT steps, x.p, x.q, median(sqrt(((x.d0 - y.d0) / z) ** 2 + ((x.dy - y.dy) / z) ** 2)) AS v0, median(sqrt(((x.d1 - y.d1) / z) ** 2 + ((x.dy - y.dy) / z) ** 2)) AS v1, median(sqrt(((x.d0 + x.d1 - y.d0 - y.d1) / 2 / z) ** 2 + ((x.dy - y.dy) / z) ** 2)) AS v2
  FROM (SELECT *, CASE WHEN steps THEN greatest(1, least(2, k - 1)) ELSE 1 END AS z FROM c, steps) x JOIN c y ON y.p = x.p AND y.q = x.q AND y.rn = x.rn - x.z GROUP BY 1, 2, 3),
g AS (SELECT steps.steps, n.*, coalesce(m.k, 0) AS k, m.gap, CASE WHEN coalesce(m.k, 0) <= 1 THEN 0 WHEN steps.steps THEN least(v0, v1, v2) ELSE v2 END AS speed, CASE WHEN m.k > 0 THEN m.dy ELSE abs(ya - yb) END AS off
  FROM n CROSS JOIN steps LEFT JOIN m ON m.p = n.p AND m.q = n.q LEFT JOIN v ON v.steps = steps.steps AND v.p = n.p AND v.q = n.q),
j AS (SELECT *, coalesce(k > 0 AND gap <= 1.2 * h AND abs(fa - fb) / 20.0 <= 1.0 AND speed <= 2.0, FALSE) AS side, la <= fb AS ahead FROM g
  WHERE off <= 0.5 * h AND (ta <> '' OR (ha <= 1.6 * hb AND wa <= 2.5 * hb AND k >= 0.5 * (la - fa + 1))) AND (tb <> '' OR (hb <= 1.6 * ha AND wb <= 2.5 * ha AND k >= 0.5 * (lb - fb + 1)))),
w AS (SELECT j.*, least(e.x1, o.x1) - greatest(e.x0, o.x0) AS ww, least(e.y1, o.y1) - greatest(e.y0, o.y0) AS hh, least((e.x1 - e.x0) * (e.y1 - e.y0), (o.x1 - o.x0) * (o.y1 - o.y0)) AS small
  FROM j JOIN b e ON e.scene = j.scene AND e.id = CASE WHEN ahead THEN j.p ELSE j.q END AND e.frame = CASE WHEN ahead THEN la ELSE lb END JOIN b o ON o.scene = j.scene AND o.id = CASE WHEN ahead THEN j.q ELSE j.p END AND o.frame = CASE WHEN ahead THEN fb ELSE fa END),
links AS (SELECT steps, p, q, ta <> '' AND tb <> '' AS texts FROM w WHERE side OR (CASE WHEN ahead THEN fb - la ELSE fa - lb END BETWEEN 0 AND 10 AND ww > 0 AND hh > 0 AND ww * hh >= 0.5 * small AND ta = tb AND ta <> ''))"""


@query(f"""
WITH RECURSIVE {TITLE_PIECES},
l2 AS (SELECT steps, p AS a, q AS z, texts FROM links UNION ALL SELECT steps, q, p, texts FROM links),
r(a, z) AS (SELECT id, id FROM t UNION SELECT r.a, l2.z FROM r JOIN l2 ON l2.a = r.z AND l2.texts AND l2.steps),
tg AS (SELECT a AS id, min(z) AS grp FROM r GROUP BY 1),
sg AS (SELECT l2.a AS id, min(tg.grp) AS grp FROM l2 JOIN tg ON tg.id = l2.z WHERE NOT texts AND steps AND l2.a IN (SELECT id FROM t WHERE text = '') GROUP BY 1 HAVING count(DISTINCT tg.grp) = 1),
wide AS (SELECT t.scene, t.id, t.text, CASE WHEN t.text = '' THEN coalesce(sg.grp, t.id) ELSE tg.grp END AS grp FROM t LEFT JOIN tg USING (id) LEFT JOIN sg USING (id)),
l3 AS (SELECT l2.* FROM l2 JOIN wide x ON x.id = l2.a JOIN wide y ON y.id = l2.z WHERE NOT steps AND x.grp = y.grp),
r2(a, z) AS (SELECT id, id FROM t UNION SELECT r2.a, l3.z FROM r2 JOIN l3 ON l3.a = r2.z AND l3.texts),
tp AS (SELECT a AS id, min(z) AS part FROM r2 GROUP BY 1),
sp AS (SELECT l3.a AS id, min(tp.part) AS part FROM l3 JOIN tp ON tp.id = l3.z WHERE NOT texts AND l3.a IN (SELECT id FROM t WHERE text = '') GROUP BY 1 HAVING count(DISTINCT tp.part) = 1),
named AS (SELECT wide.*, CASE WHEN text = '' THEN coalesce(sp.part, wide.id) ELSE tp.part END AS part FROM wide LEFT JOIN tp USING (id) LEFT JOIN sp USING (id)),
gs AS (SELECT grp, count(*) AS n, max(text) AS x, count(DISTINCT part) AS parts FROM named GROUP BY 1), ps AS (SELECT part, count(*) AS n, max(text) AS x FROM named GROUP BY 1)
SELECT scene, id, named.grp AS "group", named.part, gs.n > 1 AND gs.x <> '' AND ps.n > 1 AND ps.x <> '' AS merged, gs.n > 1 AND gs.x <> '' AND gs.parts > 1 AS bound FROM named JOIN gs USING (grp) JOIN ps USING (part)
""")
def title_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's lines as pieces of titles: shown some frames from their day on, some moving, some without text."""
    day = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1990-01-01").cast("date")).cast("long") % 12
    read = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("scene"), "l_linenumber", day.alias("day"), "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_tax")
    # an order's lines stay in one task from here on
    lines = spread(read, "scene", rows=1 << 16).groupBy("scene", (F.col("scene") * 10 + F.col("l_linenumber")).alias("id")).agg(
        F.first("l_linenumber").alias("i"), F.min("day").alias("start"), F.max(F.col("day") + 3 + F.col("l_partkey") % 9).alias("end"), F.max("l_partkey").alias("p"), F.max("l_suppkey").alias("s"),
        F.max("l_quantity").cast("long").alias("q"), (F.max("l_discount") * 100.0).cast("double").alias("rot"), (50 + F.max("l_tax") * 200.0).cast("double").alias("l"),
    )
    letter = F.chr(F.lit(65) + F.col("p") % 3)
    rows = lines.select("*", F.when(F.col("p") % 4 == 0, "").otherwise(F.repeat(letter, F.lit(4))).alias("text"), (10.0 + F.col("q") % 8).alias("h"), F.when(F.col("s") % 10 == 0, 1).alias("cut"), F.lit(0.0).alias("a"), F.lit(0.0).alias("b"))
    def box(frame):
        shift = F.col("i") * 18.0 + (frame - F.col("start")) * (F.col("p") % 2) * 3
        wider = F.when(F.col("p") % 5 == 0, 5).otherwise(0) * (frame - F.col("start"))
        low = (F.col("s") % 3) * 4.0
        return F.struct(frame.alias("frame"), shift.alias("x0"), low.alias("y0"), (shift + wider + 12 + F.col("q") % 10).alias("x1"), (low + F.col("h")).alias("y1"))

    shown = F.transform(F.sequence("start", "end"), box).alias("boxes")
    return titles.merge_plan(rows.select("scene", "id", "text", "h", "rot", "l", "a", "b", "cut", shown), None, ["scene"], 20.0)


@query()
def title_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of the benchmark as titles, lines of all documents as what shows them."""
    lines = table(spark, sf_dir, "documents").select("doc_id", "n_chars", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    shown = lines.select((F.col("doc_id") * 1_000_000 + F.col("n")).alias("line_id"), F.col("line").alias("text"), F.col("n_chars").alias("span"))
    found = similar.title_integrity(shown, table(spark, sf_dir, "benchmark"), "line_id", "item_id", "text", "span")
    return found.withColumn("fragment_ids", F.array_join(F.transform("fragment_ids", lambda x: x.cast("string")), ","))


def _counted(rows: DataFrame, least: float) -> DataFrame:
    return rows.filter(F.col("value") >= least).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("most"))


def _lifted(rows: DataFrame, by: float) -> DataFrame:
    return rows.withColumn("most", F.round(F.col("most") * by, 4))


@query("""
WITH k AS (SELECT user_id, count(*) AS n, round(max(value) * 1.5, 4) AS most FROM events WHERE value >= 20 GROUP BY 1),
f AS (SELECT user_id, arg_max(CAST(props->>'$.k' AS BIGINT), (ts, event_id)) AS n FROM events WHERE event_type = 'signup' GROUP BY 1)
SELECT k.user_id, CASE WHEN f.user_id IS NULL THEN k.n ELSE f.n END AS n, k.most FROM k LEFT JOIN f ON f.user_id = k.user_id
""")
def rerun_with_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two kept stages, the second run again with another parameter, then each user's last sign-up as a correction of the count."""
    rows, store = observations(spark, sf_dir), stages.Store(spark)
    work = lambda by: [("counted", _counted, {"least": 20.0}), ("lifted", _lifted, {"by": by})]
    key = stages.content_key(rows)
    stages.run(store, rows, work(1.0), key)
    found, _ = stages.run(store, rows, work(1.5), key)
    fixes = rows.filter("event_type = 'signup'").select("user_id", F.lit("n").alias("column"), F.col("k").cast("string").alias("value"), "ts", "event_id")
    return stages.corrected(found, fixes, ["user_id"], ["n"], ["ts", "event_id"])


@query()
def trained_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A network that learns which vectors have an even label, and what it says of each."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", (F.col("label") % 2 == 0).cast("int").alias("even"))
    mean, deviation, layers, _ = train.fit_network(rows, "vec_id", "embedding", "even", hidden=(8,), epochs=15, rate=0.02)
    score = vectors.network_score(vectors.as_doubles(F.col("embedding")), mean, deviation, layers)
    return rows.select("vec_id", "even", F.round(score, 4).alias("p"))
