"""Queries about pairs, pieces, matches and edits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import facts, greedy, match, measures, score, sequence as seq, state, tracks
from ..operators.checkpoints import Rounds, spread
from ..sources.documents import verify_manifest
from ..sources.tables import observations, table
from .registry import query
from .sequences import CHANGED, ENTITY, ORDER, _changed


@query("""
SELECT l_orderkey AS o, l_linenumber AS i, l_quantity AS q, l_quantity >= 10 AND l_quantity <= 40 AS passed, greatest(10 - l_quantity, l_quantity - 40) AS excess FROM lineitem
""")
def sample_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("i"), F.col("l_quantity").alias("q"))
    return score.sample_excess(lines, "q", "in", 10.0, 40.0)


@query("""
WITH c AS (SELECT row_number() OVER (ORDER BY d) - 1 AS i, n FROM (SELECT CAST(o_orderdate AS DATE) AS d, count(*) AS n FROM orders GROUP BY 1)),
r AS (SELECT i, sum(n) OVER (ORDER BY i) AS t FROM c UNION ALL SELECT -1, 0)
SELECT CAST(coalesce(max(w) FILTER (WHERE worst <= 40), 0) AS BIGINT) AS length FROM (SELECT b.i - a.i AS w, max(b.t - a.t) AS worst FROM r a JOIN r b ON b.i > a.i GROUP BY 1)
""")
def largest_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("d")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    costs = seq.indexed(days.withColumn("all", F.lit(0)), ["all"], ["d"], "i").select("i", "n")  # one row for each day
    return spark.createDataFrame([(tracks.largest_window(costs, "i", "n", 40.0),)], "length long")


@query("""
WITH p AS (SELECT l_partkey % 40 AS a, l_suppkey % 30 AS b, l_discount * 10 AS s FROM lineitem),
x AS (SELECT avg(m) AS m FROM (SELECT max(s) AS m FROM p GROUP BY a)), y AS (SELECT avg(m) AS m FROM (SELECT max(s) AS m FROM p GROUP BY b))
SELECT round(greatest(0.0, least(1.0, (x.m + y.m) / 2)), 6) AS similarity FROM x, y
""")
def best_of_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 40).alias("a"), (F.col("l_suppkey") % 30).alias("b"), (F.col("l_discount") * 10).alias("s"))
    return tracks.best_of_both(pairs, "a", "b", "s").withColumn("similarity", F.round("similarity", 6))


@query("""
WITH l AS (SELECT l_orderkey AS o, l_linenumber AS i, max(l_quantity) AS q FROM lineitem GROUP BY 1, 2), e AS (SELECT * FROM l WHERE i % 2 = 0), d AS (SELECT * FROM l WHERE i % 2 = 1)
SELECT e.o, e.i, coalesce(min(abs(d.q - e.q)), 'inf'::DOUBLE) AS distance, arg_min(d.i, (abs(d.q - e.q), d.i)) AS other FROM e LEFT JOIN d ON d.o = e.o GROUP BY 1, 2
""")
def nearest_partner(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("i")).agg(F.max("l_quantity").alias("q"))
    odd = lines.filter("i % 2 = 1").select("o", F.col("i").alias("other"), F.col("q").alias("r"))
    return match.nearest_by(lines.filter("i % 2 = 0"), odd, ["o"], "i", "other", F.abs(F.col("r") - F.col("q")))


@query(f"""
WITH {CHANGED}, p AS (SELECT DISTINCT user_id AS a, user_id + 1 AS b FROM events WHERE user_id + 1 IN (SELECT user_id FROM events)),
m AS (SELECT a, b, count(*) AS n, avg(sqrt((x.value - y.value) ** 2 + (x.k - y.k) ** 2)) AS d FROM p JOIN o x ON x.user_id = a JOIN o y ON y.user_id = b AND y.idx = x.idx GROUP BY a, b)
SELECT a, b, coalesce(n, 0) AS frames, round(CASE WHEN n >= 2 THEN d ELSE 1e9 END, 6) AS distance FROM p LEFT JOIN m USING (a, b)
""")
def mean_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _changed(spark, sf_dir)
    users = rows.select("user_id").distinct()
    pairs = users.select(F.col("user_id").alias("a"), (F.col("user_id") + 1).alias("b")).join(users.select(F.col("user_id").alias("b")), "b").select("a", "b")
    return measures.mean_distance(rows, rows, pairs, "user_id", "idx", ["value", "k"]).withColumn("distance", F.round("distance", 6))


@query("""
WITH m AS (SELECT CAST(doc_id AS VARCHAR) AS path, sha256(text) AS sha, strlen(text) AS n FROM documents WHERE text IS NOT NULL AND doc_id % 10 <> 3),
f AS (SELECT CAST(doc_id AS VARCHAR) AS path, CASE WHEN doc_id % 10 = 5 THEN text || 'x' WHEN doc_id % 10 = 6 THEN repeat('x', CAST(strlen(text) AS INTEGER)) ELSE text END AS c FROM documents WHERE text IS NOT NULL AND doc_id % 10 <> 4)
SELECT path, fault FROM (SELECT coalesce(m.path, f.path) AS path, CASE WHEN f.path IS NULL THEN 'missing' WHEN m.path IS NULL THEN 'extra' WHEN n <> strlen(c) THEN 'length' WHEN sha <> sha256(c) THEN 'content' END AS fault FROM m FULL OUTER JOIN f ON f.path = m.path) WHERE fault IS NOT NULL
""")
def manifest_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", "text", F.col("doc_id").cast("string").alias("path"))
    manifest = docs.filter("doc_id % 10 <> 3").select("path", F.sha2("text", 256).alias("sha256"), F.octet_length("text").alias("length"))
    stored = F.when(F.col("doc_id") % 10 == 5, F.concat("text", F.lit("x"))).when(F.col("doc_id") % 10 == 6, F.repeat(F.lit("x"), F.octet_length("text"))).otherwise(F.col("text"))
    return verify_manifest(manifest, docs.filter("doc_id % 10 <> 4").select("path", stored.cast("binary").alias("content")))


@query("""
WITH b AS (SELECT item_id, text, string_split(text, ' ') AS w FROM benchmark),
r AS (SELECT item_id, f, text, CASE WHEN f < 4 + item_id % 4 THEN text WHEN f < 20 + item_id % 30 THEN CASE WHEN f % 2 = 0 THEN array_to_string(w[1:len(w) - 1], ' ') ELSE upper(array_to_string(w[1:len(w) - 1], '')) END ELSE text || 'x' END AS read FROM b, range(60) t(f)),
x AS (SELECT *, max(f) FILTER (WHERE read = text) OVER (PARTITION BY item_id) AS last, count(*) FILTER (WHERE read = text) OVER (PARTITION BY item_id) AS seen FROM r),
s AS (SELECT *, f > last AND length(replace(text, ' ', '')) - length(replace(read, ' ', '')) >= 2 AND len(list_filter(range(1, len(string_split(text, ' '))), lambda k: lower(array_to_string(string_split(text, ' ')[1:k], '')) = lower(replace(read, ' ', '')))) > 0 AS short FROM x),
y AS (SELECT *, min(f) FILTER (WHERE short) OVER (PARTITION BY item_id) AS first, count(*) FILTER (WHERE short) OVER (PARTITION BY item_id) AS held FROM s)
SELECT item_id, CASE WHEN seen >= 5 AND held >= 15 AND f >= first THEN 1 ELSE 0 END AS piece, count(*) AS reads, min(f) AS first FROM y GROUP BY 1, 2
""")
def split_swaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.split("text", " ")
    rows = table(spark, sf_dir, "benchmark").select("item_id", "text", F.array_join(F.slice(words, F.lit(1), F.size(words) - 1), " ").alias("head"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(59).cast("long"))).alias("f"))
    read = F.when(F.col("f") < 4 + F.col("item_id") % 4, F.col("text")).when(F.col("f") < 20 + F.col("item_id") % 30, F.when(F.col("f") % 2 == 0, F.col("head")).otherwise(F.upper(F.replace("head", F.lit(" "), F.lit(""))))).otherwise(F.concat("text", F.lit("x")))
    found = tracks.split_swaps(rows.withColumn("read", read), "item_id", "f", "read", "text", seen=5, held=15)
    return found.groupBy("item_id", "piece").agg(F.count(F.lit(1)).alias("reads"), F.min("f").alias("first"))


LINKED = """
e AS (SELECT p_partkey // 50 AS scene, p_partkey AS id, CASE WHEN p_partkey % 6 = 0 THEN p_name || p_size % 3 ELSE '' END AS text,
        (p_partkey % 25) * 1311768467463790 + (p_partkey * 7) % 8 AS hash, 1.0 + p_size % 5 * 0.06 AS aspect FROM part)"""


@query(f"""
WITH RECURSIVE {LINKED},
c AS (SELECT x.scene, x.id AS a, y.id AS b, CASE WHEN x.text <> '' AND x.text = y.text THEN 0 ELSE CAST(bit_count(xor(x.hash, y.hash)) AS INTEGER) END AS d, CASE WHEN x.text <> '' AND x.text = y.text THEN 'text' ELSE 'hash' END AS reason
      FROM e x JOIN e y ON y.scene = x.scene + 1 AND ((x.text <> '' AND x.text = y.text) OR (bit_count(xor(x.hash, y.hash)) <= 5 AND abs(x.aspect - y.aspect) <= 0.1 * greatest(x.aspect, y.aspect, 0.000001)))),
p AS (SELECT *, row_number() OVER (PARTITION BY scene ORDER BY d, a, b) AS n FROM c),
g(scene, n, lefts, rights, a, b, d, reason, took) AS (SELECT DISTINCT scene, CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST([] AS BIGINT[]), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS INTEGER), CAST(NULL AS VARCHAR), FALSE FROM p
  UNION ALL SELECT scene, n, CASE WHEN t THEN list_append(lefts, a) ELSE lefts END, CASE WHEN t THEN list_append(rights, b) ELSE rights END, a, b, d, reason, t
  FROM (SELECT g.scene, p.n, lefts, rights, p.a, p.b, p.d, p.reason, NOT (list_contains(lefts, p.a) OR list_contains(rights, p.b)) AS t FROM g JOIN p ON p.scene = g.scene AND p.n = g.n + 1))
SELECT scene, a, b, d AS distance, reason FROM g WHERE took
""")
def linked_scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    ident = F.col("p_partkey")
    parts = table(spark, sf_dir, "part").select(
        F.floor(ident / 50).alias("scene"), ident.alias("id"), F.when(ident % 6 == 0, F.concat("p_name", (F.col("p_size") % 3).cast("string"))).otherwise("").alias("text"),
        ((ident % 25) * 1311768467463790 + (ident * 7) % 8).alias("hash"), (1.0 + F.col("p_size") % 5 * 0.06).alias("aspect"),
    )
    return match.linked_across(parts, parts.withColumn("scene", F.col("scene") - 1), ["scene"])


@query("""
WITH b AS (SELECT l_orderkey AS o, l_linenumber AS i, max(l_quantity) AS q FROM lineitem GROUP BY 1, 2),
p AS (SELECT x.o, x.i, sum(CASE WHEN y.i <> x.i THEN greatest(0, least(x.q, y.q + y.i) - greatest(0, y.i)) * 4 ELSE 0 END) AS s, any_value(x.q * 4) AS a FROM b x JOIN b y ON y.o = x.o GROUP BY 1, 2)
SELECT o, i, round(least(1.0, s / a), 6) AS cover FROM p
""")
def foreign_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    # an order's lines stay in one task from here on
    lines = spread(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("i"), F.col("l_quantity").alias("q")), "o").groupBy("o", "i").agg(F.max("q").alias("q"))

    def box(start, end):
        return F.struct(start.cast("double").alias("x0"), F.lit(0.0).alias("y0"), end.cast("double").alias("x1"), F.lit(4.0).alias("y1")).alias("box")

    mine, others = lines.select("o", "i", box(F.lit(0), F.col("q"))), lines.select("o", F.col("i").alias("j"), box(F.col("i"), F.col("q") + F.col("i")))
    return measures.foreign_cover(mine, others, ["o"], "i", "j").withColumn("cover", F.round("cover", 6))


@query("""
SELECT lang, round(avg(CASE WHEN quality = 1 THEN 1.0 ELSE 0.0 END), 6) AS hit_rate, round(avg(CASE WHEN n_chars % 100 <= 25 THEN 1.0 ELSE 0.0 END), 6) AS within, median(n_chars) AS seconds, count(*) AS n
FROM documents JOIN labels USING (doc_id) GROUP BY lang
""")
def hit_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    found = score.hit_summary(rows, ["lang"], F.col("quality") == 1, F.col("n_chars") % 100, 25.0, "n_chars")
    return found.withColumns({"hit_rate": F.round("hit_rate", 6), "within": F.round("within", 6)})


@query("""
WITH t AS (SELECT l_orderkey AS o, l_linenumber AS target, l_quantity AS q, l_partkey AS p FROM lineitem WHERE l_linenumber <= 2), g AS (SELECT l_orderkey AS o, l_quantity AS lo, l_quantity + 12 AS hi, l_partkey AS gp FROM lineitem WHERE l_linenumber > 2),
m AS (SELECT t.o, target, bool_or(coalesce(q BETWEEN lo AND hi OR p = gp, FALSE)) AS met FROM t LEFT JOIN g ON g.o = t.o GROUP BY 1, 2)
SELECT o, bool_and(met) AS matched, count(*) AS targets FROM m GROUP BY o
""")
def gold_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "o")
    targets = lines.filter("l_linenumber <= 2").select("o", F.col("l_linenumber").alias("target"), F.col("l_quantity").alias("q"), F.col("l_partkey").alias("p"))
    gold = lines.filter("l_linenumber > 2").select("o", F.col("l_quantity").alias("lo"), (F.col("l_quantity") + 12).alias("hi"), F.col("l_partkey").alias("gp"))
    return score.all_matched(targets, gold, ["o"], F.col("p") == F.col("gp"), F.col("q").between(F.col("lo"), F.col("hi")))


@query(f"""
WITH {CHANGED}, b AS (SELECT user_id, arg_max({{'x': value, 'y': k}}, (k % 13, -idx)) AS base FROM o GROUP BY user_id)
SELECT o.user_id, idx, round(value - base.x, 6) + 0.0 AS dx, CAST(k - base.y AS INTEGER) AS dy FROM o JOIN b ON b.user_id = o.user_id
""")
def largest_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _changed(spark, sf_dir).withColumn("area", F.col("k") % 13)
    return measures.offsets(rows, ENTITY, "idx", "value", "k", "area").withColumn("dx", F.round("dx", 6) + 0.0)


@query(f"""
WITH {CHANGED}
SELECT a.user_id, a.event_id, b.event_id AS other, b.idx - a.idx AS apart, round(sqrt((b.value - a.value) ** 2 + (b.k - a.k) ** 2), 6) AS distance
FROM o a JOIN o b ON b.user_id = a.user_id AND b.idx - a.idx BETWEEN 1 AND 8 AND sqrt((b.value - a.value) ** 2 + (b.k - a.k) ** 2) <= greatest(12.0, 2 * sqrt(a.k))
""")
def frame_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _changed(spark, sf_dir)
    return match.frame_pairs(rows, ENTITY, "event_id", "idx", "value", "k", "k", 8, 12.0).withColumn("distance", F.round("distance", 6))


EDITS = """
m AS (SELECT event_id AS element, user_id AS grp, rank, rank * 3 AS start FROM (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS rank FROM events) WHERE rank < 5),
d AS (SELECT event_id AS edit, event_id AS element, CASE event_id % 3 WHEN 0 THEN 'text' WHEN 1 THEN 'colour' ELSE 'timing' END AS kind, event_id % 50 AS value FROM events WHERE event_id % 2 = 0)"""


@query(f"""
WITH {EDITS}
SELECT d.edit, coalesce(o.element, d.element) AS element, kind, CASE WHEN g.grp IS NOT NULL AND kind = 'timing' THEN value + o.start - g.start ELSE value END AS value
FROM d LEFT JOIN m g ON g.element = d.element LEFT JOIN m o ON o.grp = g.grp AND (kind <> 'text' OR o.rank = 0)
""")
def group_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = seq.indexed(observations(spark, sf_dir), ENTITY, ORDER).filter("idx < 5")
    members = rows.select(F.col("event_id").alias("element"), F.col("user_id").alias("group"), F.col("idx").alias("rank"), (F.col("idx") * 3).alias("start"))
    ident = F.col("event_id")
    edits = observations(spark, sf_dir).filter(ident % 2 == 0).select(ident.alias("edit"), ident.alias("element"), F.when(ident % 3 == 0, "text").when(ident % 3 == 1, "colour").otherwise("timing").alias("kind"), (ident % 50).alias("value"))
    return state.group_edits(edits, members)


@query(f"""
WITH {CHANGED},
c AS (SELECT *, CASE WHEN greatest(change, coalesce(lead(change) OVER (PARTITION BY user_id ORDER BY idx), 'inf'::DOUBLE)) < 20 THEN idx END AS calm FROM o)
SELECT user_id, idx, coalesce(last_value(calm IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY idx ROWS BETWEEN 5 PRECEDING AND CURRENT ROW), idx) AS settled FROM c
""")
def settled_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seq.settled(_changed(spark, sf_dir), ENTITY, "idx", "change", quiet=20.0, within=6, step=-1).select("user_id", "idx", "settled")


@query(f"""
WITH RECURSIVE {CHANGED}, n AS (SELECT user_id, max(idx) + 1 AS n FROM o GROUP BY user_id), c AS (SELECT o.user_id, idx FROM o JOIN n USING (user_id) WHERE change >= 40 AND n - idx >= 6),
r(user_id, a, scene) AS (SELECT user_id, CAST(0 AS BIGINT), CAST(1 AS BIGINT) FROM n UNION ALL SELECT r.user_id, min(c.idx), any_value(r.scene) + 1 FROM r JOIN c ON c.user_id = r.user_id AND c.idx >= r.a + 6 GROUP BY r.user_id, r.a)
SELECT r.user_id, scene, a AS first, coalesce(lead(a) OVER (PARTITION BY r.user_id ORDER BY a), n) - 1 AS last FROM r JOIN n ON n.user_id = r.user_id
""")
def scene_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _changed(spark, sf_dir).withColumn("cut", F.col("change") >= 40)
    return greedy.scene_spans(rows, ENTITY, "idx", "cut", 6)


FACTS = """
m AS (SELECT o_custkey AS scene, 'm' || l_orderkey || '_' || l_linenumber AS id, 'e' || l_partkey % 5 AS element, CASE WHEN l_linenumber % 2 = 0 THEN 'rotation' ELSE 'translation' END AS type,
        CAST(l_quantity AS INTEGER) AS start, CAST(l_quantity AS INTEGER) + 1 + l_partkey % 4 AS z, CASE WHEN l_linenumber % 2 = 1 THEN 0.6 END AS dx, CASE WHEN l_linenumber % 2 = 1 THEN -0.8 END AS dy, l_suppkey % 20 + 0.5 AS mag
      FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
u AS (SELECT scene, id, min(element) AS element, min(type) AS type, min(start) AS start, max(z) AS z, min(dx) AS dx, min(dy) AS dy, min(mag) AS mag FROM m GROUP BY scene, id),
k AS (SELECT * FROM u WHERE element <> 'e4'), b AS (SELECT DISTINCT scene, element AS id, substr(element, 2)::INTEGER * 8 AS x FROM k)"""


@query(f"""
WITH {FACTS},
f AS (SELECT x.scene, x.id, y.id AS other, y.start, min(y.start) OVER (PARTITION BY x.scene, x.id) AS first FROM k x JOIN k y ON y.scene = x.scene AND y.element <> x.element AND y.start >= x.z),
p AS (SELECT scene, 'type(' || id || ',''' || type || ''')' AS pred FROM u UNION ALL SELECT scene, 'dir(' || id || ',[0.60,-0.80])' FROM u WHERE type = 'translation'
  UNION ALL SELECT scene, 'mag(' || id || ',' || printf('%.1f', mag) || ')' FROM u UNION ALL SELECT scene, 'dur(' || id || ',' || (z - start) || ')' FROM u
  UNION ALL SELECT scene, 'before(' || id || ',' || other || ')' FROM f WHERE start = first
  UNION ALL SELECT x.scene, 'while(' || x.id || ',' || y.id || ')' FROM k x JOIN k y ON y.scene = x.scene AND x.id < y.id AND y.element <> x.element AND least(x.z, y.z) - greatest(x.start, y.start) >= 1
  UNION ALL SELECT x.scene, unnest([CASE WHEN x.x + 7 <= y.x + 2 THEN 'left' END, CASE WHEN x.x >= y.x + 7 - 2 THEN 'right' END, CASE WHEN least(x.x, y.x) + 7 > greatest(x.x, y.x) THEN 'intersect' END]) || '(' || x.id || ',' || y.id || ')'
  FROM b x JOIN b y ON y.scene = x.scene AND x.id < y.id)
SELECT scene, pred FROM p WHERE pred IS NOT NULL
""")
def extracted_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    motions = Rounds(spark).keep(_line_motions(spark, sf_dir), "motions")  # several kinds of facts read them
    salient = motions.filter("element <> 'e4'").select("scene", "element").distinct()
    x = F.substring("element", 2, 9).cast("double") * 8
    boxes = salient.select("scene", F.col("element").alias("id"), F.struct(x.alias("x0"), F.lit(0.0).alias("y0"), (x + 7).alias("x1"), F.lit(9.0).alias("y1")).alias("box"))
    return facts.extracted(motions, boxes, salient, "scene")


def _line_motions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A motion for each of an order's lines, in its customer's scene."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    odd = F.col("l_linenumber") % 2 == 1
    rows = lines.select(
        F.col("o_custkey").alias("scene"), F.concat(F.lit("m"), "l_orderkey", F.lit("_"), "l_linenumber").alias("id"), F.concat(F.lit("e"), F.col("l_partkey") % 5).alias("element"), F.when(odd, "translation").otherwise("rotation").alias("type"),
        F.col("l_quantity").cast("int").alias("start"), (F.col("l_quantity").cast("int") + 1 + F.col("l_partkey") % 4).alias("end"), F.when(odd, 0.6).alias("dir_x"), F.when(odd, -0.8).alias("dir_y"), (F.col("l_suppkey") % 20 + 0.5).alias("mag"),
    )
    found = rows.groupBy("scene", "id").agg(*[F.min(c).alias(c) for c in ("element", "type", "start", "dir_x", "dir_y", "mag")], F.max("end").alias("end"))
    return found.withColumn("dur", F.col("end") - F.col("start"))


@query(f"""
WITH {FACTS}
SELECT scene, id, q.about, q.answer_type, q.answer, q.tolerance FROM (SELECT scene, id, unnest([{{'about': 'type', 'answer_type': 'choice', 'answer': type, 'tolerance': 0.0::DOUBLE}},
  {{'about': 'start', 'answer_type': 'number', 'answer': CAST(start AS VARCHAR), 'tolerance': 2.0}}, {{'about': 'dur', 'answer_type': 'number', 'answer': CAST(z - start AS VARCHAR), 'tolerance': 2.0}},
  {{'about': 'mag', 'answer_type': 'number', 'answer': printf('%.1f', mag), 'tolerance': 2.0}}]) AS q FROM u)
""")
def motion_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.motion_questions(_line_motions(spark, sf_dir), "scene")


@query("""
SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY user_id, event_type
""")
def latest_of_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = observations(spark, sf_dir).select("user_id", "event_type", "ts", "event_id", "value")
    return state.latest(rows, ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")
