"""Scores and gates: every aggregate keeps its partial form, so groups combine before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value)


def passes(value: Column, op: str, limit: Column | float, upper: float | None = None) -> Column:
    """Whether a sample meets its limit; a missing or NaN sample never does."""
    tests = {"le": lambda: value <= limit, "lt": lambda: value < limit, "ge": lambda: value >= limit, "in": lambda: (value >= limit) & (value <= F.lit(upper))}
    return F.coalesce(finite(value) & tests[op](), F.lit(False))


def excess(value: Column, op: str, limit: Column | float, upper: float | None = None) -> Column:
    """How far a sample is on the wrong side of its limit (negative: on the right side)."""
    limit = limit if isinstance(limit, Column) else F.lit(limit)
    return {"le": value - limit, "lt": value - limit, "ge": limit - value, "in": F.greatest(limit - value, value - F.lit(upper if upper is not None else 0.0))}[op]


def gate(samples: DataFrame, by: list[str], value: str, op: str, limit: float, upper: float | None = None) -> DataFrame:
    """Mean of finite samples, worst sample, counts, and whether all pass; no samples fail."""
    v = F.col(value).cast("double")
    good = passes(v, op, F.lit(limit), upper)
    return samples.groupBy(*by).agg(
        F.avg(F.when(finite(v), v)).alias("mean"),
        F.max_by(F.when(finite(v), v), F.when(finite(v), excess(v, op, limit, upper))).alias("worst"),
        F.count(F.lit(1)).alias("samples"),
        F.sum((~good).cast("long")).alias("failed"),
        F.coalesce(F.every(good), F.lit(False)).alias("passed"),
    )


def rate_gate(samples: DataFrame, by: list[str], hit: Column, least: float) -> DataFrame:
    """Share of hits (missing counts as a miss) and whether it is enough."""
    got = F.avg(F.coalesce(hit, F.lit(False)).cast("double"))
    return samples.groupBy(*by).agg(got.alias("rate"), F.count(F.lit(1)).alias("samples"), F.coalesce(got >= least, F.lit(False)).alias("passed"))


def overall(gates: DataFrame, passed: str, strict: bool) -> DataFrame:
    """True only if a gate ran and none that ran failed; under strict, gates that did not run fail too."""
    verdict = F.coalesce(F.every(passed), F.lit(False))
    if strict:
        verdict &= F.count(passed) == F.count(F.lit(1))
    return gates.agg(verdict.alias("passed"))


def rank_auc(scored: DataFrame, by: list[str], score: str, label: str) -> DataFrame:
    """Rank-sum area under the curve, positives first among equal scores; null where a class is missing.

    Labels are counted per distinct score first, so the window only sees distinct scores.
    """
    counts = scored.filter(F.col(label).isin(0, 1) & F.col(score).isNotNull()).groupBy(*by, score).agg(F.sum((F.col(label) == 1).cast("long")).alias("_p"), F.sum((F.col(label) == 0).cast("long")).alias("_n"))
    below = F.sum("_n").over(Window.partitionBy(*by).orderBy(score).rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")
    sums = counts.withColumn("_wins", (F.col("_p") * below).cast("double")).groupBy(*by).agg(F.sum("_wins").alias("_wins"), F.sum("_p").alias("positives"), F.sum("_n").alias("negatives"))
    value = F.col("_wins") / (F.col("positives").cast("double") * F.col("negatives"))
    return sums.select(*by, F.when((F.col("positives") > 0) & (F.col("negatives") > 0), value).alias("auc"), "positives", "negatives")


def balanced_weights(rows: DataFrame, source: str, label: str) -> DataFrame:
    """Weights under which each source counts the same, and inside it both classes; their sum is the row count."""
    groups = rows.groupBy(source, label).agg(F.count(F.lit(1)).alias("_n"))
    totals = groups.agg(F.countDistinct(source).alias("_sources"), F.sum("_n").alias("_rows"))
    weight = F.col("_rows") / (2 * F.col("_sources") * F.col("_n"))
    weighted = groups.crossJoin(F.broadcast(totals)).select(source, label, "_n", weight.alias("weight"))  # one row of totals
    return weighted


def threshold_grid(rows: DataFrame, score: str, truth: Column, grid: list[float]) -> DataFrame:
    """Share of rows where score >= threshold agrees with the truth, for each threshold."""
    sums = rows.agg(*[F.avg(((F.col(score) >= t) == truth).cast("double")).alias(f"_{i}") for i, t in enumerate(grid)])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"_{i}").alias("agreement")) for i, t in enumerate(grid)])).alias("r")).select("r.*")


def tracklets(rows: DataFrame, entity: str, index: str, x: str, y: str) -> DataFrame:
    """Steps of each track: entity, index, dx, dy."""
    w = Window.partitionBy(entity).orderBy(index)
    steps = rows.withColumns({"dx": F.col(x) - F.lag(x).over(w), "dy": F.col(y) - F.lag(y).over(w), "_before": F.lag(index).over(w)})
    return steps.filter((F.col("_before") == F.col(index) - 1) & F.col("dx").isNotNull() & F.col("dy").isNotNull()).select(entity, index, "dx", "dy")


def correlation(a: DataFrame, b: DataFrame, pairs: DataFrame, entity: str, index: str, still: float = 0.25) -> DataFrame:
    """Mean over common steps of cosine times speed ratio: 1 where both are still, 0 where one is."""
    left = a.select(F.col(entity).alias("a"), index, F.col("dx").alias("ax"), F.col("dy").alias("ay"))
    right = b.select(F.col(entity).alias("b"), index, F.col("dx").alias("bx"), F.col("dy").alias("by"))
    both = pairs.join(left, "a").join(right, ["b", index])
    na, nb = F.sqrt(F.col("ax") * F.col("ax") + F.col("ay") * F.col("ay")), F.sqrt(F.col("bx") * F.col("bx") + F.col("by") * F.col("by"))
    cosine = (F.col("ax") * F.col("bx") + F.col("ay") * F.col("by")) / (na * nb)
    score = F.when((na < still) & (nb < still), 1.0).when((na < still) | (nb < still), 0.0).otherwise(cosine * F.least(na, nb) / F.greatest(na, nb))
    return both.groupBy("a", "b").agg(F.avg(score).alias("score"), F.count(F.lit(1)).alias("steps"))


def weighted_by_evidence(scores: DataFrame, evidence: DataFrame, key: str) -> DataFrame:
    """Mean score weighted by evidence; a key without a score counts 0, and no evidence at all gives null."""
    joined = evidence.filter("weight > 0").join(scores, key, "left")
    return joined.agg((F.sum(F.col("weight") * F.coalesce("score", F.lit(0.0))) / F.sum("weight")).alias("similarity"), F.sum("weight").alias("weight"))


def weighted_median(rows: DataFrame, by: list[str], value: str, weight: str) -> DataFrame:
    """Smallest value at which the weights so far reach half; nulls and rows without weight are left out.

    Weights are summed per distinct value first, so the window sees distinct values only.
    """
    summed = rows.filter(F.col(value).isNotNull() & (F.col(weight) > 0)).groupBy(*by, value).agg(F.sum(weight).alias("_w"))
    running = F.sum("_w").over(Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("_w").over(Window.partitionBy(*by))
    return summed.withColumns({"_running": running, "_total": total}).filter(F.col("_running") >= F.col("_total") / 2).groupBy(*by).agg(F.min(value).alias("median"))


def pooled(parts: DataFrame, by: list[str]) -> DataFrame:
    """Combine partial statistics (n, mean, low, high) of parts."""
    return parts.groupBy(*by).agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("mean"), F.min("low").alias("low"), F.max("high").alias("high"))


def series_bins(rows: DataFrame, entity: list[str], index: str, value: str, most: int = 200, quantile: float = 0.8) -> DataFrame:
    """At most ``most`` bins of a series: each bin's maximum, and whether it reaches the series' quantile."""
    whole = Window.partitionBy(*entity)
    size = F.count(F.lit(1)).over(whole)
    limit = F.percentile(value, F.lit(quantile)).over(whole)
    bins = F.least(F.lit(most), size)
    return (
        rows.withColumns({"_bins": bins, "_size": size, "limit": limit})
        .withColumn("bin", F.floor((F.col(index) * F.col("_bins") + F.col("_bins") - 1) / F.col("_size")).cast("long"))
        .groupBy(*entity, "bin").agg(F.max(value).alias("peak"), F.max((F.col(value) >= F.col("limit")).cast("int")).alias("hot"))
    )


def overlap_votes(rows: DataFrame, group: list[str], ident: str, size: str) -> DataFrame:
    """Order within a group by pairwise votes: the larger of two wins one; ties by id.

    With each pair voting once per group, a row's net votes are the rows below it less those
    above, which two ranks give without building pairs.
    """
    below = F.rank().over(Window.partitionBy(*group).orderBy(size)) - 1
    above = F.rank().over(Window.partitionBy(*group).orderBy(F.desc(size))) - 1
    voted = rows.withColumn("votes", (below - above).cast("long"))
    return voted.withColumn("z", F.row_number().over(Window.partitionBy(*group).orderBy("votes", ident)).cast("long"))


def paired_bootstrap(differences: DataFrame, cluster: str, value: str, draws: int, seed: int) -> DataFrame:
    """Mean paired difference with a 95 % interval that resamples clusters.

    Clusters are summed first.  Each draw takes as many clusters as there are, with
    replacement: draw and slot pick a cluster number by hash, and an equi-join finds it.
    """
    sums = differences.filter(F.col(value).isNotNull()).groupBy(cluster).agg(F.sum(value).alias("total"), F.count(F.lit(1)).alias("n"))
    numbered = sums.withColumn("slot", F.row_number().over(Window.orderBy(cluster)).cast("long") - 1)
    count = sums.count()
    if not count:
        return differences.sparkSession.createDataFrame([], "mean double, low double, high double, clusters long, n long")
    picks = differences.sparkSession.range(draws * count).select(F.floor(F.col("id") / count).alias("draw"), F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(count)).alias("slot"))
    means = picks.join(numbered, "slot").groupBy("draw").agg((F.sum("total") / F.sum("n")).alias("mean"))
    interval = means.agg(F.percentile("mean", F.array(F.lit(0.025), F.lit(0.975))).alias("q")).select(F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))
    centre = sums.agg((F.sum("total") / F.sum("n")).alias("mean"), F.count(F.lit(1)).alias("clusters"), F.sum("n").alias("n"))
    return centre.crossJoin(interval).select("mean", "low", "high", "clusters", "n")  # one row each


def sample_excess(samples: DataFrame, value: str, op: str, limit: float, upper: float | None = None) -> DataFrame:
    """Each sample with whether it passes, and by how much it misses its limit."""
    v = F.col(value).cast("double")
    return samples.withColumns({"passed": passes(v, op, F.lit(limit), upper), "excess": F.when(finite(v), excess(v, op, limit, upper))})


def hit_summary(rows: DataFrame, by: list[str], hit: Column, error: Column, tolerance: float, seconds: str) -> DataFrame:
    """Share of hits, share of errors within the tolerance (missing ones are not), and median seconds."""
    return rows.groupBy(*by).agg(
        F.avg(F.coalesce(hit, F.lit(False)).cast("double")).alias("hit_rate"), F.avg(F.coalesce(error <= tolerance, F.lit(False)).cast("double")).alias("within"),
        F.median(seconds).alias("seconds"), F.count(F.lit(1)).alias("n"),
    )


def all_matched(targets: DataFrame, gold: DataFrame, keys: list[str], same: Column, holds: Column) -> DataFrame:
    """Per keys, whether every target meets a gold row that is the same or holds its point; columns of gold are named apart."""
    met = targets.join(gold, keys, "left").withColumn("_met", F.coalesce(same | holds, F.lit(False)))
    each = met.groupBy(*keys, "target").agg(F.bool_or("_met").alias("_met"))
    return each.groupBy(*keys).agg(F.bool_and("_met").alias("matched"), F.count(F.lit(1)).alias("targets"))


def masked_median(rows: DataFrame, by: list[str | Column], value: Column, seen: Column) -> DataFrame:
    """Median of the values that are seen, rounded half up, and how many these are."""
    open_ = F.when(seen, value)
    return rows.groupBy(*by).agg(F.floor(F.median(open_) + 0.5).cast("double").alias("middle"), F.count(open_).alias("seen"))


def accuracy_by(rows: DataFrame, levels: list[str], hit: Column) -> DataFrame:
    """Mean and count at every level of the given columns, from all of them to none, in one pass; all for a level left out."""
    sets = [levels[:n] for n in range(len(levels), -1, -1)]
    found = rows.groupingSets(sets, *levels).agg(F.count(F.lit(1)).alias("n"), F.avg(hit).alias("accuracy"))
    return found.select(*[F.coalesce(c, F.lit("all")).alias(c) for c in levels], "n", "accuracy")
