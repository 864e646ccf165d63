"""Mixing sources to target weights by Pareto order sampling.

Sources get targets in words by weight; a target stops at a multiple of its source's
size and the excess is shared anew.  Within a source a document of n words is expected
``rate * floor(n ** 0.75) / n`` times, at most ``most`` times, so long documents are repeated
less than short ones; the rate is the one that makes the expected words meet the target.
The whole part of that is taken as certain copies, the fraction p is the inclusion
probability of one more.  Documents are ranked by random odds over inclusion odds,
(u / (1 - u)) / (p / (1 - p)), with u a hash of doc_id, and taken in that order until the
words that the certain copies leave open are used up; the one at the cut is taken if that
comes nearer.

Documents are drawn in tiers by their share of their source's target, the longest first:
each tier for the words expected of it, and what the cut leaves over or short goes to the
next one.  So a long document at a cut does not decide how near the target comes.  Words are summed in rank order over ranges of
(source, rank), so a source of any size is spread over the tasks.  What comes out is one
row of cuts per source, and whether a document is taken follows from that row, its doc_id,
source and number of words: no text is shuffled, and reruns agree.

Nulls: a null text has size 0 and is never taken; a null source is a source of its own,
ordered last; null doc_ids share one rank.  Repeated rows share a rank and are taken alike,
as are rows that tie otherwise.  Very long texts count as any other.  Extra columns stay in
``mix``, whatever their names, and are ignored in ``decide``.  An empty table gives none.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import ensure_checkpoint_dir, read_table

#: Shares of a source's target that part the tiers.
TIERS = (1 / 8, 1 / 32, 1 / 128)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _in_order(sources: DataFrame) -> DataFrame:
    """Number the sources by code point from 0, null last, without bringing them into one task."""
    dealt = sources.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()).checkpoint()
    counts = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n"))  # as many rows as partitions
    before = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    within = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1
    return dealt.withColumn("number", within).join(before, "part").withColumn("number", F.col("number") + F.col("before")).drop("part", "before")


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """One row per source: its size and target.

    Each pass sums, on the cluster, what the sources below their limit share; a source
    found above its limit stays there, so the passes end.
    """
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    sources = _in_order(sizes.groupBy("source").agg(F.sum("size").alias("source_size")))
    sources = sources.withColumn("weight", F.element_at(cycle, (F.col("number") % len(weights) + 1).cast("int"))).checkpoint()
    limit = F.col("source_size") * most
    total = share * (sources.agg(F.sum("source_size")).first()[0] or 0)
    rate = -1.0
    while True:
        capped = F.col("weight") * rate >= limit if rate >= 0 else F.lit(False)
        got = sources.agg(F.sum(F.when(capped, limit)).alias("fixed"), F.sum(F.when(~capped, F.col("weight"))).alias("open")).first()
        if not got["open"]:
            break
        new = (total - (got["fixed"] or 0.0)) / got["open"]
        if new <= rate:
            break
        rate = new
    return sources.select("source", "source_size", F.least(F.col("weight") * max(rate, 0.0), limit).alias("target"))


def _valued(size: Column) -> Column:
    return F.floor(F.sqrt(size) * F.sqrt(F.sqrt(size)))


def _expected(most: float) -> Column:
    """Expected copies of a document with ``size`` words of a source with ``rate`` (null: all as often as may be)."""
    return F.when(F.col("size") > 0, F.coalesce(F.least(F.lit(most), F.col("rate") * _valued(F.col("size")) / F.col("size")), F.lit(most))).otherwise(0.0)


def _rank(doc_id: Column, p: Column) -> Column:
    u = (F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 13), 16, 10).cast("long") + 0.5) / float(1 << 52)
    return (u / (1 - u)) / (p / (1 - p))


def _decided(rows: DataFrame, most: float) -> DataFrame:
    """rows (size, doc_id, and their source's columns) with certain copies, p, tier and rank."""
    rows = rows.withColumn("expected", _expected(most))
    tier = sum(((F.col("size") <= F.col("target") * share).cast("int") for share in TIERS), F.lit(0))
    rows = rows.withColumns({"sure": F.floor("expected"), "p": F.col("expected") - F.floor("expected"), "tier": tier})
    return rows.withColumn("rank_odds", F.when(F.col("p") > 0, _rank(F.col("doc_id"), F.col("p"))))


def _rates(by_size: DataFrame, sources: DataFrame, most: float) -> DataFrame:
    """sources with rate, and the words that certain copies leave open in all (open) and by tier, the last one's being the remainder.

    Sizes are gone through from those expected most often: the first ones are at the limit,
    and the rate is what remains for the others over their values.
    """
    of_source = Window.partitionBy("source")
    order = of_source.orderBy(F.desc(F.col("value") / F.col("size")), "size")
    rows = by_size.filter("size > 0").withColumn("value", _valued(F.col("size"))).join(sources, by_size["source"].eqNullSafe(F.col("_source")))
    words, values = F.col("n") * F.col("size"), F.col("n") * F.col("value")
    rows = rows.withColumns({"fixed": F.sum(words).over(order) - words, "values": F.sum(values).over(of_source) - F.sum(values).over(order) + values})
    rate = (F.col("target") - most * F.col("fixed")) / F.col("values")
    rates = rows.withColumn("rate", rate).groupBy("source").agg(F.max(F.when(F.col("rate") * F.col("value") < most * F.col("size"), F.col("rate"))).alias("rate"))
    known = sources.join(rates, F.col("_source").eqNullSafe(rates["source"]), "left").drop("source")
    sized = _decided(by_size.withColumn("doc_id", F.lit(None).cast("long")).join(known, by_size["source"].eqNullSafe(known["_source"])), most)
    rests = sized.groupBy("source").agg(
        (F.first("target") - F.sum(F.col("sure") * words)).alias("open"),
        *[F.floor(F.sum(F.when(F.col("tier") == i, F.col("p") * words).otherwise(0.0)) + 0.5).alias(f"open_{i}") for i in range(len(TIERS))],
    )
    return known.join(rests, known["_source"].eqNullSafe(rests["source"])).drop("source")


def cuts(slim: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """One row per source (_source): source_size, target, rate, and the last rank taken of each tier."""
    by_size = slim.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")).checkpoint()
    sources = source_targets(by_size.select("source", (F.col("size") * F.col("n")).alias("size")), weights, share, most)
    sources = _rates(by_size, sources.withColumnRenamed("source", "_source"), most).checkpoint()
    rows = _decided(slim.join(sources, slim["source"].eqNullSafe(sources["_source"])), most).filter("p > 0")
    key = ["source", "tier", "rank_odds"]
    groups = rows.groupBy(*key).agg(F.sum("size").alias("words"))
    groups = groups.repartitionByRange(*key).withColumn("part", F.spark_partition_id()).checkpoint()
    # words before each rank: within its range of ranks, and in the ranges before
    mine = Window.partitionBy("source", "tier", "part").orderBy("rank_odds")
    sums = groups.groupBy("source", "tier", "part").agg(F.sum("words").alias("in_part"))
    sums = sums.select(F.col("source").alias("_s"), F.col("tier").alias("_t"), F.col("part").alias("_p"), (F.sum("in_part").over(Window.partitionBy("source", "tier").orderBy("part")) - F.col("in_part")).alias("earlier"))
    ordered = groups.withColumn("before", F.sum("words").over(mine) - F.col("words"))
    ordered = ordered.join(sums, ordered["source"].eqNullSafe(sums["_s"]) & (ordered["tier"] == sums["_t"]) & (ordered["part"] == sums["_p"]))
    ordered = ordered.select(*key, "words", (F.col("before") + F.col("earlier")).alias("before")).checkpoint()
    sources = sources.withColumns({"due": F.lit(0).cast("long"), "taken": F.lit(0).cast("long")})
    for i in range(len(TIERS) + 1):
        due = F.col("due") + F.col(f"open_{i}") if i < len(TIERS) else F.col("open")  # of all tiers so far
        some = ordered.filter(F.col("tier") == i).join(sources, ordered["source"].eqNullSafe(sources["_source"]))
        found = some.filter(2 * F.col("before") + F.col("words") <= 2 * (due - F.col("taken"))).groupBy("source").agg(F.max("rank_odds").alias(f"cut_{i}"), F.sum("words").alias("more"))
        joined = sources.join(found, sources["_source"].eqNullSafe(found["source"]), "left")
        sources = joined.withColumns({"due": due, "taken": F.col("taken") + F.coalesce("more", F.lit(0))}).drop("source", "more").checkpoint()
    return sources.select("_source", "source_size", "target", "rate", *[f"cut_{i}" for i in range(len(TIERS) + 1)])


def _with_copies(rows: DataFrame, found: DataFrame, most: float) -> DataFrame:
    """rows (doc_id, source, size, ...) with their source's row and ``copies``."""
    rows = _decided(rows.join(found, rows["source"].eqNullSafe(found["_source"])), most)
    taken = F.coalesce(F.col("rank_odds") <= F.element_at(F.array(*[f"cut_{i}" for i in range(len(TIERS) + 1)]), F.col("tier") + 1), F.lit(False))
    return rows.withColumn("copies", (F.col("sure") + taken.cast("int")).cast("int"))


def _slim(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"))


def decide(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """How many copies the mix takes of each row: doc_id, source, size, source_size, target, copies."""
    ensure_checkpoint_dir(docs.sparkSession)
    slim = _slim(docs).checkpoint()
    return _with_copies(slim, cuts(slim, weights, share, most), most).select("doc_id", "source", "size", "source_size", "target", "copies")


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """The mixed table: rows of docs, each as often as it is taken."""
    ensure_checkpoint_dir(docs.sparkSession)
    found = cuts(_slim(docs).checkpoint(), weights, share, most)
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"))
    return _with_copies(rows, found, most).filter("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = decide(read_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", F.col("copies").cast("long").alias("copies"))


ORACLE_SQL = r"""
WITH RECURSIVE d AS (SELECT CAST(doc_id AS BIGINT) AS doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size FROM documents),
w AS (SELECT source, source_size, CAST([5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INTEGER) + 1] AS DOUBLE) AS weight FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source)),
f(rate, next) AS (SELECT CAST(-1 AS DOUBLE), (SELECT 1.5::DOUBLE * sum(source_size) / sum(weight) FROM w)
  UNION ALL SELECT next, (SELECT (1.5::DOUBLE * sum(source_size) - coalesce(sum(2.0::DOUBLE * source_size) FILTER (WHERE weight * f.next >= 2.0::DOUBLE * source_size), 0)) / sum(weight) FILTER (WHERE NOT weight * f.next >= 2.0::DOUBLE * source_size) FROM w) FROM f WHERE next > rate),
t AS (SELECT source, source_size, least(weight * greatest((SELECT max(rate) FROM f), 0), 2.0::DOUBLE * source_size) AS target FROM w),
z AS (SELECT t.source, size, target, count(*) AS n, CAST(floor(sqrt(CAST(size AS DOUBLE)) * sqrt(sqrt(CAST(size AS DOUBLE)))) AS BIGINT) AS value FROM d JOIN t ON t.source IS NOT DISTINCT FROM d.source WHERE size > 0 GROUP BY ALL),
y AS (SELECT *, (target - 2.0::DOUBLE * (sum(n * size) OVER o - n * size)) / CAST(sum(n * value) OVER (PARTITION BY source) - sum(n * value) OVER o + n * value AS DOUBLE) AS rate FROM z WINDOW o AS (PARTITION BY source ORDER BY CAST(value AS DOUBLE) / size DESC, size ROWS UNBOUNDED PRECEDING)),
x AS (SELECT t.*, (SELECT max(rate) FROM y WHERE y.source IS NOT DISTINCT FROM t.source AND y.rate * value < 2.0::DOUBLE * size) AS rate FROM t),
e AS (SELECT doc_id, d.source, size, source_size, target, CASE WHEN size > 0 THEN coalesce(least(2.0::DOUBLE, rate * floor(sqrt(CAST(size AS DOUBLE)) * sqrt(sqrt(CAST(size AS DOUBLE)))) / size), 2.0::DOUBLE) ELSE 0.0 END AS expected,
  (CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u FROM d JOIN x ON x.source IS NOT DISTINCT FROM d.source),
p AS (SELECT *, CAST(floor(expected) AS BIGINT) AS sure, expected - floor(expected) AS p, CAST(size <= target / 8 AS INTEGER) + CAST(size <= target / 32 AS INTEGER) + CAST(size <= target / 128 AS INTEGER) AS tier FROM e),
r AS (SELECT *, CASE WHEN p > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS rank_odds FROM p),
o AS (SELECT source, any_value(target) - sum(sure * size) AS open, floor(coalesce(sum(p * size) FILTER (WHERE tier = 0), 0) + 0.5::DOUBLE) AS open_0,
  floor(coalesce(sum(p * size) FILTER (WHERE tier = 1), 0) + 0.5::DOUBLE) AS open_1, floor(coalesce(sum(p * size) FILTER (WHERE tier = 2), 0) + 0.5::DOUBLE) AS open_2 FROM r GROUP BY source),
g AS (SELECT source, tier, rank_odds, sum(size) AS words FROM r WHERE p > 0 GROUP BY ALL),
b AS (SELECT *, sum(words) OVER (PARTITION BY source, tier ORDER BY rank_odds ROWS UNBOUNDED PRECEDING) - words AS before FROM g),
c0 AS (SELECT source, open, open_1, open_2, cut AS cut_0, now AS due, was + coalesce(more, 0) AS taken FROM (SELECT o.source, open, open_1, open_2, open_0 AS now, 0 AS was, sum(words) AS more, max(rank_odds) AS cut FROM o LEFT JOIN b ON b.source IS NOT DISTINCT FROM o.source AND tier = 0 AND 2 * before + words <= 2 * (open_0 - 0) GROUP BY ALL)),
c1 AS (SELECT source, open, open_1, open_2, cut_0, cut AS cut_1, now AS due, was + coalesce(more, 0) AS taken FROM (SELECT c0.*, due + open_1 AS now, taken AS was, sum(words) AS more, max(rank_odds) AS cut FROM c0 LEFT JOIN b ON b.source IS NOT DISTINCT FROM c0.source AND tier = 1 AND 2 * before + words <= 2 * (due + open_1 - taken) GROUP BY ALL)),
c2 AS (SELECT source, open, open_1, open_2, cut_0, cut_1, cut AS cut_2, now AS due, was + coalesce(more, 0) AS taken FROM (SELECT c1.*, due + open_2 AS now, taken AS was, sum(words) AS more, max(rank_odds) AS cut FROM c1 LEFT JOIN b ON b.source IS NOT DISTINCT FROM c1.source AND tier = 2 AND 2 * before + words <= 2 * (due + open_2 - taken) GROUP BY ALL)),
c3 AS (SELECT source, open, open_1, open_2, cut_0, cut_1, cut_2, cut AS cut_3, now AS due, was + coalesce(more, 0) AS taken FROM (SELECT c2.*, open AS now, taken AS was, sum(words) AS more, max(rank_odds) AS cut FROM c2 LEFT JOIN b ON b.source IS NOT DISTINCT FROM c2.source AND tier = 3 AND 2 * before + words <= 2 * (open - taken) GROUP BY ALL)),
k AS (SELECT r.*, sure + CASE WHEN rank_odds <= [cut_0, cut_1, cut_2, cut_3][tier + 1] THEN 1 ELSE 0 END AS copies FROM r LEFT JOIN c3 ON c3.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(size * copies AS BIGINT) AS taken, source, CAST(copies AS BIGINT) AS copies FROM k
"""
