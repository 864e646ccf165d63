"""Queries that join by time, overlap, cost or key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.geometry import containment, iou
from ..operators import facts, match, sequence as seq
from ..operators.checkpoints import spread
from ..sources.tables import observations, table
from .registry import query

SPANS = """
s AS (SELECT o_custkey AS cust, o_orderkey AS id, min(date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE))) AS a, max(date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE))) AS z
      FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2)"""


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shipping interval of each order, in days."""
    day = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1995-01-01").cast("date")).cast("long")
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min(day).alias("a"), F.max(day).alias("z"))
    return table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("cust"), F.col("o_orderkey").alias("id"), "a", "z")


@query(f"""
WITH {SPANS}, n AS (SELECT *, lead(id) OVER w AS id2, lead(a) OVER w AS a2, lead(z) OVER w AS z2 FROM s WINDOW w AS (PARTITION BY cust ORDER BY a, id))
SELECT cust, id, id2, z <= a2 AS before, z2 <= a AS after, least(z, z2) - greatest(a, a2) >= 1 AS "while" FROM n WHERE id2 IS NOT NULL
""")
def temporal_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("cust").orderBy("a", "id")
    rows = _spans(spark, sf_dir).withColumns({f"{c}2": F.lead(c).over(w) for c in ("id", "a", "z")}).filter("id2 is not null")
    relations = facts.temporal_relations(F.col("a"), F.col("z"), F.col("a2"), F.col("z2"))
    return rows.select("cust", "id", "id2", *[v.alias(k) for k, v in relations.items()])


@query(f"WITH {SPANS} SELECT x.cust, x.id, y.id AS id2, y.a - x.z AS gap FROM s x JOIN s y ON y.cust = x.cust AND y.id <> x.id AND y.a - x.z BETWEEN 0 AND 20")
def succession_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = _spans(spark, sf_dir)
    later = spans.select("cust", F.col("id").alias("id2"), F.col("a").alias("a2"))
    pairs = match.band_join(spans, later, ["cust"], "z", "a2", 0, 20)
    return pairs.filter("id <> id2").select("cust", "id", "id2", (F.col("a2") - F.col("z")).alias("gap"))


@query("""
WITH v AS (SELECT user_id, event_id, epoch_us(ts) AS at FROM events WHERE event_type = 'view'),
p AS (SELECT user_id, event_id, epoch_us(ts) AS at FROM events WHERE event_type = 'purchase')
SELECT p.user_id, p.event_id, v.event_id AS view_id, round((p.at - v.at) / 1000000.0, 3) AS seconds
FROM p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.at >= v.at
""")
def asof_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = observations(spark, sf_dir).withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    views = rows.filter("event_type = 'view'").select("user_id", F.col("event_id").alias("view_id"), F.col("at").alias("view_at"))
    purchases = rows.filter("event_type = 'purchase'").select("user_id", "event_id", "at")
    found = match.nearest_earlier(purchases, views, ["user_id"], "at", "view_at", "event_id", ["view_id"])
    return found.select("user_id", "event_id", "view_id", F.round((F.col("at") - F.col("view_at")) / 1000000.0, 3).alias("seconds"))


BOXES = """
b AS (SELECT l_orderkey AS o, l_linenumber AS i, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice) AS k,
             CAST(l_quantity AS DOUBLE) AS x0, l_quantity + 10 AS x1, l_discount * 100 AS y0, l_discount * 100 + 4 AS y1 FROM lineitem)"""


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A box for each line of an order, from its numbers."""
    w = Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_extendedprice")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("i"), F.row_number().over(w).alias("k"),
        F.struct(F.col("l_quantity").alias("x0"), (F.col("l_quantity") + 10).alias("x1"), (F.col("l_discount") * 100).alias("y0"), (F.col("l_discount") * 100 + 4).alias("y1")).alias("box"),
    )


def _box_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = _boxes(spark, sf_dir)
    other = boxes.select("o", F.col("i").alias("i2"), F.col("k").alias("k2"), F.col("box").alias("box2"))
    return boxes.join(other, "o").filter("i < i2 or (i = i2 and k < k2)")


@query(f"""
WITH {BOXES},
p AS (SELECT x.o, x.i, x.k, y.i AS i2, y.k AS k2, greatest(0, least(x.x1, y.x1) - greatest(x.x0, y.x0)) * greatest(0, least(x.y1, y.y1) - greatest(x.y0, y.y0)) AS shared
      FROM b x JOIN b y ON y.o = x.o AND (x.i < y.i OR (x.i = y.i AND x.k < y.k)))
SELECT o, i, k, i2, k2, round(shared / (80 - shared), 6) AS iou, round(shared / 40, 6) AS inside FROM p WHERE shared / (80 - shared) >= 0.1
""")
def box_iou_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _box_pairs(spark, sf_dir).withColumns({"iou": iou(F.col("box"), F.col("box2")), "inside": containment(F.col("box"), F.col("box2"))})
    return pairs.filter("iou >= 0.1").select("o", "i", F.col("k").cast("long").alias("k"), "i2", F.col("k2").cast("long").alias("k2"), F.round("iou", 6).alias("iou"), F.round("inside", 6).alias("inside"))


def _halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of the even and odd lines of each order, by how little their boxes overlap."""
    boxes = _boxes(spark, sf_dir).filter("k = 1").select("o", "i", "box")
    left, right = boxes.filter("i % 2 = 0"), boxes.filter("i % 2 = 1").select("o", F.col("i").alias("j"), F.col("box").alias("box2"))
    return left.join(right, "o").withColumn("cost", 1 - iou(F.col("box"), F.col("box2"))).select("o", "i", "j", "cost")


HALVES = f"""
{BOXES},
q AS (SELECT x.o, x.i, y.i AS j, greatest(0, least(x.x1, y.x1) - greatest(x.x0, y.x0)) * greatest(0, least(x.y1, y.y1) - greatest(x.y0, y.y0)) AS shared, (x.x1 - x.x0) * (x.y1 - x.y0) AS s1, (y.x1 - y.x0) * (y.y1 - y.y0) AS s2
      FROM b x JOIN b y ON y.o = x.o AND x.k = 1 AND y.k = 1 AND x.i % 2 = 0 AND y.i % 2 = 1),
h AS (SELECT o, i, j, 1 - shared / (s1 + s2 - shared) AS cost FROM q)"""


@query(f"""
WITH RECURSIVE {HALVES}, n AS (SELECT o, i, row_number() OVER (PARTITION BY o ORDER BY i) AS n FROM (SELECT DISTINCT o, i FROM h)),
m(o, n, used, saved) AS (SELECT DISTINCT o, CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST(0 AS DOUBLE) FROM n
  UNION ALL SELECT m.o, m.n + 1, CASE WHEN h.j IS NULL THEN used ELSE list_append(used, CAST(h.j AS BIGINT)) END, saved + CASE WHEN h.j IS NULL THEN 0 ELSE 0.9 - h.cost END
  FROM m JOIN n ON n.o = m.o AND n.n = m.n + 1
  JOIN (SELECT o, i, j, cost FROM h WHERE cost <= 0.9 UNION ALL SELECT DISTINCT o, i, NULL, NULL FROM h) h ON h.o = n.o AND h.i = n.i AND (h.j IS NULL OR NOT list_contains(m.used, CAST(h.j AS BIGINT))))
SELECT o, round(max(saved), 6) + 0.0 AS saved FROM m GROUP BY o HAVING max(saved) > 0.000001
""")
def one_to_one_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the best one-to-one choice saves against leaving all alone: unlike the pairs, it is the same for all best choices."""
    chosen = match.one_to_one(_halves(spark, sf_dir), ["o"], "i", "j", "cost", most=0.9)
    return chosen.groupBy("o").agg((F.round(F.sum(0.9 - F.col("cost")), 6) + 0.0).alias("saved")).filter("saved > 0.000001")


@query()
def one_to_one_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.one_to_one(_halves(spark, sf_dir), ["o"], "i", "j", "cost", most=0.9)


@query(f"""
WITH RECURSIVE {HALVES}, p AS (SELECT *, row_number() OVER (PARTITION BY o ORDER BY cost, i, j) AS n FROM h WHERE cost <= 0.9),
g(o, n, lefts, rights, i, j, cost, took) AS (SELECT DISTINCT o, CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST([] AS BIGINT[]), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS DOUBLE), FALSE FROM p
  UNION ALL SELECT o, n, CASE WHEN t THEN list_append(lefts, i) ELSE lefts END, CASE WHEN t THEN list_append(rights, j) ELSE rights END, i, j, cost, t
  FROM (SELECT g.o, p.n, lefts, rights, CAST(p.i AS BIGINT) AS i, CAST(p.j AS BIGINT) AS j, p.cost, NOT (list_contains(lefts, CAST(p.i AS BIGINT)) OR list_contains(rights, CAST(p.j AS BIGINT))) AS t FROM g JOIN p ON p.o = g.o AND p.n = g.n + 1))
SELECT o, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(cost, 6) AS cost FROM g WHERE took
""")
def greedy_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.greedy_pairs(_halves(spark, sf_dir), ["o"], "i", "j", "cost", most=0.9).withColumn("cost", F.round("cost", 6))


@query()
def object_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a scene is a user's day, so that scenes stay small however many users and days there are
    day = observations(spark, sf_dir).withColumn("day", F.to_date("ts"))
    rows = seq.indexed(day, ["user_id", "day"], ["ts", "event_id"])
    seen = rows.select("user_id", "day", F.floor(F.col("idx") / 4).alias("frame"), "event_id", F.col("value").alias("x"), F.col("k").cast("double").alias("y"), (F.col("value") + 1).alias("size"))
    return match.tracks(seen, ["user_id", "day"], "frame", "event_id", "x", "y", "size", reach=60.0, most=1.5)


@query("""
WITH b AS (SELECT user_id, idx, event_id FROM (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx FROM events) WHERE event_type = 'error'),
t AS (SELECT user_id, idx FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx FROM events) WHERE event_type = 'signup')
SELECT t.user_id, t.idx, min(abs(b.idx - t.idx)) AS off, count(*) AS near FROM t JOIN b ON b.user_id = t.user_id AND abs(b.idx - t.idx) <= 1 GROUP BY ALL
""")
def boundary_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = seq.indexed(observations(spark, sf_dir), ["user_id"], ["ts", "event_id"])
    truth = rows.filter("event_type = 'signup'").select("user_id", "idx")
    found = rows.filter("event_type = 'error'").select("user_id", F.col("idx").alias("at"))
    pairs = match.band_join(truth, found, ["user_id"], "idx", "at", -1, 1)
    return pairs.groupBy("user_id", "idx").agg(F.min(F.abs(F.col("at") - F.col("idx"))).alias("off"), F.count(F.lit(1)).alias("near"))


@query("""
WITH z AS (SELECT l_orderkey AS o, l_linenumber AS i, l_partkey AS p, l_suppkey AS s, l_extendedprice AS e, l_quantity AS q FROM lineitem),
v AS (SELECT *, rank() OVER (PARTITION BY o ORDER BY q) - rank() OVER (PARTITION BY o ORDER BY q DESC) AS votes FROM z)
SELECT o, i, p, s, CAST(votes AS BIGINT) AS votes, row_number() OVER (PARTITION BY o ORDER BY votes, i * 1000000 + p, s, e) AS z FROM v
""")
def z_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.score import overlap_votes

    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("i"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"), F.col("l_quantity").alias("q"), F.struct((F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("a"), "l_suppkey", "l_extendedprice").alias("ident"))
    return overlap_votes(lines, ["o"], "ident", "q").select("o", "i", "p", "s", "votes", "z")


@query("""
SELECT coalesce(a.id, b.id) AS id, coalesce(b.state, a.state) AS state, coalesce(b.amount, a.amount) AS amount
FROM (SELECT o_orderkey AS id, o_orderstatus AS state, o_totalprice AS amount FROM orders WHERE o_orderkey % 3 <> 0) a
FULL OUTER JOIN (SELECT o_orderkey AS id, 'live' AS state, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE round(o_totalprice * 2, 2) END AS amount FROM orders WHERE o_orderkey % 2 = 0) b ON a.id = b.id
""")
def overridden_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.state import overridden

    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("state"), F.col("o_totalprice").alias("amount"))
    live = orders.filter("id % 2 = 0").select("id", F.lit("live").alias("state"), F.when(F.col("id") % 4 != 0, F.round(F.col("amount") * 2, 2)).alias("amount"))
    return overridden(orders.filter("id % 3 <> 0"), live, "id", ["state", "amount"])


@query("""
SELECT 'left' AS side, doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
UNION ALL SELECT 'right', doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)
""")
def symmetric_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.state import key_difference

    return key_difference(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id").select("side", F.col("doc_id").alias("id"))


def _typed_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of the lines of an order; the widest lines of each order act as holders."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("o"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"), F.col("l_linenumber").alias("i"),
        F.struct((F.col("l_discount") * 100).alias("x0"), (F.col("l_discount") * 100 + F.col("l_quantity")).alias("x1"), F.lit(0.0).alias("y0"), F.col("l_quantity").alias("y1")).alias("box"),
    )


@query("""
WITH b AS (SELECT l_orderkey AS o, l_partkey AS p, l_suppkey AS s, l_linenumber AS i, l_discount * 100 AS x0, l_discount * 100 + l_quantity AS x1, 0.0 AS y0, l_quantity AS y1 FROM lineitem),
h AS (SELECT a.o, a.p, b.p AS holder, row_number() OVER (PARTITION BY a.o, a.p ORDER BY (b.x1 - b.x0) * (b.y1 - b.y0), b.p) AS n
      FROM b a JOIN b ON b.o = a.o WHERE a.i <= 3 AND b.i > 3 AND a.y1 > 0
        AND greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) >= 0.6 * ((a.x1 - a.x0) * (a.y1 - a.y0)))
SELECT o, p, holder FROM h WHERE n = 1
""")
def smallest_holders(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.tracks import smallest_holder

    boxes = _typed_boxes(spark, sf_dir)
    return smallest_holder(boxes.filter("i <= 3").select("o", "p", "box"), boxes.filter("i > 3").select("o", F.col("p").alias("holder"), "box"), ["o"], "p", "holder")


@query(f"""
WITH RECURSIVE {SPANS}, w AS (SELECT s.cust, s.id, a, z, o_totalprice AS w FROM s JOIN orders ON o_orderkey = s.id),
l AS (SELECT x.id AS p, y.id AS q FROM w x JOIN w y ON y.cust = x.cust AND y.id <> x.id AND y.a - x.z BETWEEN 0 AND 30 AND least(x.w, y.w) / greatest(x.w, y.w) >= 0.5),
e AS (SELECT p, q FROM l UNION SELECT q, p FROM l), r(node, reach) AS (SELECT DISTINCT p, p FROM e UNION SELECT r.node, e.q FROM r JOIN e ON e.p = r.reach)
SELECT node, min(reach) AS component FROM r GROUP BY node
""")
def succession_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.tracks import successions

    spans = _spans(spark, sf_dir).join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("w")), "id")
    boxed = spans.select("cust", "id", F.col("a").alias("first"), F.col("z").alias("last"), F.struct(F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.col("w").alias("x1"), F.lit(1.0).alias("y1")).alias("box"))
    return successions(boxed, ["cust"], "id", gap=30, least=0.5)


@query("""
WITH p AS (SELECT user_id, event_type, k, value >= 50 AS hit FROM (SELECT *, CAST(props->>'$.k' AS INTEGER) % 7 AS k FROM events)),
s AS (SELECT user_id AS owner, k AS item, avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END) AS share FROM p GROUP BY 1, 2)
SELECT min(owner) AS owner, item, round(arg_min(share, owner), 6) AS share FROM s WHERE share >= 0.5 GROUP BY item
""")
def first_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.tracks import claims

    pairs = observations(spark, sf_dir).select(F.col("user_id").alias("owner"), (F.col("k") % 7).alias("item"), "value")
    return claims(pairs, "owner", "item", F.col("value") >= 50, 0.5).withColumn("share", F.round("share", 6))


@query("""
WITH e AS (SELECT l_orderkey AS o, l_linenumber AS i, max(l_quantity) AS q FROM lineitem GROUP BY 1, 2), p AS (SELECT o, i, q + (o % 3) * 0.5 AS g FROM e WHERE (o + i) % 50 <> 0)
SELECT round(max(abs(e.q - p.g)), 6) AS error, CAST(sum(CASE WHEN p.g IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS missing, count(*) AS expected, max(abs(e.q - p.g)) <= 2 AND sum(CASE WHEN p.g IS NULL THEN 1 ELSE 0 END) = 0 AS passed
FROM e LEFT JOIN p ON p.o = e.o AND p.i = e.i
""")
def verified_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.tracks import verified

    want = spread(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("i"), F.col("l_quantity").alias("q")), "o", "i").groupBy("o", "i").agg(F.max("q").alias("q"))

    def boxed(shift):
        return F.struct(*[(F.col("q") + (shift if c == "x1" else F.lit(0.0))).alias(c) for c in ("x0", "y0", "x1", "y1")]).alias("box")

    got = want.filter("(o + i) % 50 <> 0").select("o", "i", boxed((F.col("o") % 3) * 0.5))
    return verified(want.select("o", "i", boxed(F.lit(0.0))), got, ["o", "i"], 2.0).withColumn("error", F.round("error", 6))


@query("""
WITH r AS (SELECT l_orderkey AS o, l_partkey AS p, l_suppkey AS s, l_extendedprice AS e, CASE WHEN NOT l_quantity >= 20 THEN 0 WHEN NOT l_discount <= 0.05 THEN 1 ELSE 2 END AS level FROM lineitem),
b AS (SELECT *, max(level) OVER (PARTITION BY o) AS best FROM r)
SELECT o, p, level, rank FROM (SELECT *, row_number() OVER (PARTITION BY o ORDER BY e DESC, p, s) AS rank FROM b WHERE level = best) WHERE rank <= 2
""")
def relaxed_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.tracks import relaxed_top

    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"), "l_extendedprice", "l_quantity", "l_discount")
    return relaxed_top(rows, ["o"], [F.col("l_quantity") >= 20, F.col("l_discount") <= 0.05], F.col("l_extendedprice"), ["p", "s"], 2).select("o", "p", "level", "rank")


@query("""
WITH RECURSIVE o AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx FROM events),
a AS (SELECT user_id, idx AS t FROM o WHERE event_type = 'signup'), b AS (SELECT user_id, idx AS f FROM o WHERE event_type = 'error'),
p AS (SELECT a.user_id, t, f, row_number() OVER (PARTITION BY a.user_id ORDER BY abs(t - f), t, f) AS n FROM a JOIN b ON b.user_id = a.user_id AND abs(t - f) <= 1),
g(user_id, n, lefts, rights) AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST([] AS BIGINT[]) FROM p
  UNION ALL SELECT g.user_id, p.n, CASE WHEN list_contains(lefts, t) OR list_contains(rights, f) THEN lefts ELSE list_append(lefts, t) END,
    CASE WHEN list_contains(lefts, t) OR list_contains(rights, f) THEN rights ELSE list_append(rights, f) END FROM g JOIN p ON p.user_id = g.user_id AND p.n = g.n + 1),
h AS (SELECT user_id, CAST(max(len(lefts)) AS BIGINT) AS hits FROM g GROUP BY user_id),
c AS (SELECT user_id, CAST(sum(w) AS BIGINT) AS wanted, CAST(sum(f) AS BIGINT) AS found FROM (SELECT user_id, 1 AS w, 0 AS f FROM a UNION ALL SELECT user_id, 0, 1 FROM b) GROUP BY user_id)
SELECT user_id, coalesce(hits, 0) AS hits, CASE WHEN found > 0 THEN coalesce(hits, 0) / found::DOUBLE END AS precision, CASE WHEN wanted > 0 THEN coalesce(hits, 0) / wanted::DOUBLE END AS recall,
  CASE WHEN wanted + found > 0 THEN 2 * coalesce(hits, 0) / (wanted + found)::DOUBLE END AS f1 FROM c LEFT JOIN h USING (user_id)
""")
def boundary_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.greedy import boundary_scores as scores

    rows = seq.indexed(observations(spark, sf_dir), ["user_id"], ["ts", "event_id"])
    return scores(rows.filter("event_type = 'signup'"), rows.filter("event_type = 'error'"), ["user_id"], "idx", 1)
