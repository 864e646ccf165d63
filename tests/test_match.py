import itertools

import numpy as np
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from spanwise.operators import match


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 5), st.integers(0, 3), st.integers(0, 10_000))
def test_assignment_has_least_total(n, more, seed):
    cost = np.random.default_rng(seed).integers(0, 9, (n, n + more)).astype(float)
    chosen = match.assignment(cost)
    assert len(set(chosen)) == n
    best = min(sum(cost[i, p[i]] for i in range(n)) for p in itertools.permutations(range(n + more), n))
    assert cost[np.arange(n), chosen].sum() == best


def test_one_to_one_prefers_total_and_keeps_limit(spark):
    pairs = spark.createDataFrame([(1, 0, 0, 0.1), (1, 0, 1, 0.2), (1, 1, 0, 0.15), (1, 1, 1, 0.9), (2, 0, 0, 0.95)], "g long, a long, b long, c double")
    found = sorted((r.g, r.a, r.b) for r in match.one_to_one(pairs, ["g"], "a", "b", "c", 0.5).collect())
    assert found == [(1, 0, 1), (1, 1, 0)]
    greedy = sorted((r.g, r.a, r.b) for r in match.greedy_pairs(pairs, ["g"], "a", "b", "c", 0.5).collect())
    assert greedy == [(1, 0, 0)]


def test_null_groups_are_one_group_and_groups_span_batches(spark):
    rows = [(g, a, b, c) for g in (None, 5) for a, b, c in ((1, 1, 0.1), (1, 2, 0.2), (2, 1, 0.15))]
    rows += [(7, a, b, abs(a - b) / 100) for a in range(20) for b in range(20)]
    pairs = spark.createDataFrame(rows, "g long, a long, b long, c double")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        for choose, few in ((match.one_to_one, [(1, 2), (2, 1)]), (match.greedy_pairs, [(1, 1)])):
            found = choose(pairs, ["g"], "a", "b", "c", 0.5).collect()
            assert sorted((r.a, r.b) for r in found if r.g is None) == few == sorted((r.a, r.b) for r in found if r.g == 5)
            assert sorted((r.a, r.b) for r in found if r.g == 7) == [(i, i) for i in range(20)]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_band_join_equals_range_condition(spark):
    rng = np.random.default_rng(3)
    left = [(int(k), i, int(t)) for i, (k, t) in enumerate(zip(rng.integers(0, 3, 60), rng.integers(-50, 50, 60)))]
    right = [(int(k), i, int(t)) for i, (k, t) in enumerate(zip(rng.integers(0, 3, 60), rng.integers(-50, 50, 60)))]
    a, b = spark.createDataFrame(left, "k long, i long, t long"), spark.createDataFrame(right, "k long, j long, u long")
    for low, high in ((0, 7), (-3, 2), (1, 1)):
        got = sorted((r.i, r.j) for r in match.band_join(a, b, ["k"], "t", "u", low, high).collect())
        assert got == sorted((i, j) for k, i, t in left for q, j, u in right if k == q and low <= u - t <= high)


def test_nearest_earlier_takes_last_at_or_before(spark):
    left = spark.createDataFrame([("a", 1, 5), ("a", 2, 10), ("b", 3, 1)], "k string, i long, t long")
    right = spark.createDataFrame([("a", 7, 5), ("a", 8, 6), ("b", 9, 2)], "k string, j long, u long")
    got = sorted((r.i, r.j) for r in match.nearest_earlier(left, right, ["k"], "t", "u", "i", ["j"]).collect() if r.j is not None)
    assert got == [(1, 7), (2, 8)]


def test_tracks_follow_and_start(spark):
    rows = [("s", f, 2 * f, 10.0 * f, 0.0, 1.0) for f in range(4)] + [("s", f, 2 * f + 1, 100.0 - 10 * f, 50.0, 1.0) for f in range(4)]
    seen = spark.createDataFrame(rows, "s string, f long, o long, x double, y double, a double")
    found = {r.o: r.track for r in match.tracks(seen, ["s"], "f", "o", "x", "y", "a", reach=20.0, most=1.5).collect()}
    assert len({found[o] for o in (0, 2, 4, 6)}) == 1 and len({found[o] for o in (1, 3, 5, 7)}) == 1 and found[0] != found[1]


def _plain_tracks(rows, reach, most, idle):
    """Frame by frame, trying all one-to-one choices."""
    history, label = [], {}
    for f in sorted({r[0] for r in rows}):
        now = sorted(r for r in rows if r[0] == f)
        live = [t for t in range(len(history)) if f - history[t][-1][0] <= idle]

        def cost(t, r):
            last, before = history[t][-1], history[t][-2] if len(history[t]) > 1 else None
            at = [last[i] + ((last[i] - before[i]) / (last[0] - before[0]) * (f - last[0]) if before else 0) for i in (2, 3)]
            return np.hypot(at[0] - r[2], at[1] - r[3]) / reach + abs(np.log(r[4] / last[4]))

        few, many = (live, now) if len(live) <= len(now) else (now, live)
        best = min(([sum(cost(*((a, b) if few is live else (b, a))) for a, b in zip(few, p)), p] for p in itertools.permutations(many, len(few))), key=lambda x: x[0], default=[0, ()])
        met = {}
        for a, b in zip(few, best[1]):
            t, r = (a, b) if few is live else (b, a)
            if cost(t, r) <= most:
                met[r[1]] = t
        for r in now:
            if r[1] in met:
                history[met[r[1]]].append(r)
                label[r[1]] = met[r[1]]
            elif 4 * r[4] >= max(x[4] for x in now):
                label[r[1]] = len(history)
                history.append([r])
            else:
                label[r[1]] = None
    return label


def test_tracks_equal_trying_all_choices(spark):
    rng = np.random.default_rng(9)
    scenes = {}
    for s in range(30):
        rows, n = [], 0
        for f in range(6):
            for _ in range(rng.integers(0, 4)):
                rows.append((f, n, float(rng.uniform(0, 60)), float(rng.uniform(0, 60)), float(rng.uniform(1, 9))))
                n += 1
        scenes[s] = rows
    seen = spark.createDataFrame([(s, *r) for s, rows in scenes.items() for r in rows], "s long, f long, o long, x double, y double, a double")
    got = {}
    for r in match.tracks(seen, ["s"], "f", "o", "x", "y", "a", reach=40.0, most=1.2).collect():
        got.setdefault(r.s, {})[r.o] = r.track
    assert got == {s: _plain_tracks(rows, 40.0, 1.2, 2) for s, rows in scenes.items() if rows}


def test_monotone_pairs_never_go_back(spark):
    rows = spark.createDataFrame([("s", 0, "one"), ("s", 1, "two"), ("s", 2, "one"), ("s", 3, "tree")], "s string, i long, text string")
    found = match.monotone_pairs(rows, ["one", "two", "three"], ["s"], ["i"], "text", lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b)), 0.6)
    assert [r["copy"] for r in found.orderBy("i").collect()] == ["one", "two", None, "three"]


def test_links_across_scenes_send_no_side_through_the_driver(spark):
    rows = spark.createDataFrame([(i // 5, i, "t" if i % 3 else "", i * 77, 1.0) for i in range(20)], "scene long, id long, text string, hash long, aspect double")
    found = match.linked_across(rows, rows.selectExpr("scene - 1 AS scene", "id", "text", "hash", "aspect"), ["scene"])
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.count() > 0


def test_an_unknown_distance_comes_after_infinite_ones_and_nan(spark):
    inf, nan = float("inf"), float("nan")
    rows = spark.createDataFrame([(1, 2, 0.0), (2, 2, inf), (3, 2, nan), (4, 2, None), (5, 2, 1.0), (None, 2, 1.0)], "o long, i long, q double")
    others = spark.createDataFrame([(1, 1, None), (1, 3, 7.0), (1, 5, 7.0), (2, 1, None), (2, 3, 5.0), (3, 1, None), (3, 3, 5.0), (4, 3, 1.0), (4, 1, 1.0), (None, 1, 1.0)], "o long, other long, r double")
    found = match.nearest_by(rows, others, ["o"], "i", "other", F.abs(F.col("r") - F.col("q"))).collect()
    assert {r.o: (repr(r.distance), r.other) for r in found} == {1: ("7.0", 3), 2: ("inf", 3), 3: ("nan", 3), 4: ("inf", 1), 5: ("inf", None), None: ("inf", None)}
