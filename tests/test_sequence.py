import numpy as np
from pyspark.sql import functions as F

from spanwise.operators import sequence as seq


def _series(spark, values, entity="a"):
    return spark.createDataFrame([(entity, i, float(v) if v is not None else None) for i, v in enumerate(values)], "e string, i long, v double")


def _rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_runs_bridge_one_quiet_row_and_drop_short_ones(spark):
    moving = spark.createDataFrame([("a", i, i in (1, 2, 4, 8, 12, 13)) for i in range(15)], "e string, i long, m boolean")
    assert _rows(seq.runs(moving, ["e"], "i", F.col("m")), "first", "last", "n") == [(1, 4, 3), (12, 13, 2)]
    stepped = seq.runs(moving, ["e"], "i", F.col("m"), step=F.col("i") == 8)
    assert _rows(stepped, "first", "last") == [(1, 4), (8, 8), (12, 13)]


def test_merged_runs_join_what_is_close(spark):
    found = spark.createDataFrame([("a", 0, 3), ("a", 8, 10), ("a", 16, 20)], "e string, first long, last long")
    assert _rows(seq.merged_runs(found, ["e"], apart=6), "first", "last", "parts") == [(0, 10, 2), (16, 20, 1)]


def test_motions_have_magnitude_and_number(spark):
    rows = spark.createDataFrame([("a", i, float(min(i, 4) * 10), 0.0 if i < 6 else (i - 5) * 5.0) for i in range(9)], "e string, i long, x double, r double")
    found = seq.motions(rows, ["e"], "i", {"move": ("x", 1.0), "turn": ("r", 1.0)})
    assert _rows(found, "motion", "type", "start", "end", "dur", "mag") == [(1, "move", 0, 4, 4, 40.0), (2, "turn", 5, 8, 3, 15.0)]


def test_filled_leaves_edges_and_held_keeps_last(spark):
    rows = _series(spark, [None, 1, None, None, 4, None])
    assert [r["filled"] for r in seq.filled(rows, ["e"], "i", "v").orderBy("i").collect()] == [None, 1.0, 2.0, 3.0, 4.0, None]
    assert [r["held"] for r in seq.held(rows, ["e"], "i", "v").orderBy("i").collect()] == [None, 1.0, 1.0, 1.0, 4.0, 4.0]


def test_dense_and_intervals_are_inverse(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("a", 5), ("a", 5)], "e string, i long")
    assert _rows(seq.intervals(rows, ["e"], "i"), "first", "last", "n") == [(1, 2, 2), (5, 5, 1)]
    assert seq.dense(rows.distinct(), ["e"], "i").count() == 5


def test_spikes_stand_out_and_skip_repeats(spark):
    changes = spark.createDataFrame([("a", i, c) for i, c in enumerate([1.0, 1.0, 30.0, 0.0, 1.0, 1.0])], "e string, i long, c double")
    assert _rows(seq.spikes(changes, ["e"], "i", "c", floor=5.0, factor=3.0), "i") == [(2,)]


def test_noise_is_small_for_ramps_and_zero_for_few(spark):
    assert seq.noise_bound(_series(spark, range(20)), ["e"], ["i"], "v").first()["bound"] == 0.0
    assert seq.noise_bound(_series(spark, [5, 1, 7]), ["e"], ["i"], "v").first()["bound"] == 0.0


def test_crossing_interpolates(spark):
    assert seq.crossings(_series(spark, [0, 10, 20]), ["e"], "i", "v", F.lit(15.0)).first()["crossing"] == 1.5
    assert seq.crossings(_series(spark, [0, 1]), ["e"], "i", "v", F.lit(15.0)).first()["crossing"] is None


def test_retime_rounds_half_even_and_later_key_wins(spark):
    keys = spark.createDataFrame([("a", t) for t in range(5)], "e string, t long")
    found = seq.retimed(keys, ["e"], "t", [], speed=2.0, delay=0, anchor=F.lit(0))
    assert _rows(found, "new_t", "t") == [(0, 1), (1, 2), (2, 4)]


def test_keyed_curve_keeps_within_bound(spark):
    rows = _series(spark, [0, 1, 2, 3, 2, 1, 0])
    assert _rows(seq.keyed_curve(rows, ["e"], "i", "v", 0.1), "t", "v") == [(0, 0.0), (3, 3.0), (6, 0.0)]


def test_evenly_includes_ends(spark):
    picked = _rows(seq.evenly(_series(spark, range(101)), ["e"], "i", 5), "i")
    assert picked == [(0,), (25,), (50,), (75,), (100,)]
    assert seq.evenly(_series(spark, range(3)), ["e"], "i", 5).count() == 3


def test_settled_looks_ahead(spark):
    changes = spark.createDataFrame([("a", i, c) for i, c in enumerate([9.0, 9.0, 1.0, 1.0, 1.0])], "e string, i long, c double")
    assert [r["settled"] for r in seq.settled(changes, ["e"], "i", "c", quiet=5.0, within=4).orderBy("i").collect()] == [2, 2, 2, 3, 4]


def test_eased_keys_draw_the_curve_within_bound():
    from spanwise.operators import curves

    rng = np.random.default_rng(5)
    for turn in range(60):
        n = int(rng.integers(1, 60))
        v = np.concatenate([np.full(n, 3.0), 3 + 40 * curves.ease_at(np.arange(30) / 29, curves.EASES["out_cubic"]), np.full(n, 43.0)]) if turn % 2 else np.cumsum(rng.normal(size=n) * 3)
        bound = float(rng.choice([0.5, 2.0, 8.0]))
        at, value, ease, error = curves.keys_of(v, bound)
        assert error <= bound + 1e-9 and at[0] == 0 and (len(at) == 1 or at[-1] == len(v) - 1)
        for a, b, x, y, e in zip(at, at[1:], value, value[1:], ease):
            assert np.abs(x + (y - x) * curves._shapes(b - a)[e] - v[a : b + 1]).max() <= bound + 1e-9
    at, value, ease, error = curves.keys_of(3 + 40 * curves.ease_at(np.arange(30) / 29, curves.EASES["in_out_quad"]), 0.5)
    assert (len(at), curves.NAMES[ease[0]]) == (2, "in_out_quad")
    at, value, ease, error = curves.keys_of(np.concatenate([np.full(9, 3.0), 3 + 40 * curves.ease_at(np.arange(30) / 29, curves.EASES["out_cubic"]), np.full(9, 43.0)]), 0.5)
    assert len(at) <= 9 and error <= 0.5
    assert curves.keys_of(np.array([1.0, 1.2, 0.9, 1.1]), 0.5)[1].tolist() == [1.05]
    steps = np.concatenate([np.full(20, 5.0), np.full(20, 50.0), np.full(20, 5.0)]) + rng.normal(size=60) * 0.1
    at, value, ease, error = curves.keys_of(steps, 1.0)
    assert len(at) == 6 and value[0] == value[1] and value[2] == value[3] and value[4] == value[5]  # noise on a hold is no motion
    x = np.linspace(0, 1, 101)
    for e in curves.EASES.values():  # on the curve that the control points draw
        s = np.linspace(0, 1, 51)
        along = [3 * (1 - s) ** 2 * s * a + 3 * (1 - s) * s**2 * b + s**3 for a, b in ((e[0], e[2]), (e[1], e[3]))]
        assert np.abs(curves.ease_at(along[0], e) - along[1]).max() < 1e-6 and np.all(np.isfinite(curves.ease_at(x, e)))


def test_property_keys_leave_defaults_out_and_draw_back(spark):
    from spanwise.operators import curves

    rows = [("a", i, 5.0 * i, 1.0, 0.5) for i in range(20)] + [("b", i, 0.5, 1.0, 1.0) for i in range(20)] + [("b", 20, None, None, None)]
    df = spark.createDataFrame(rows, "e string, i long, x double, sx double, opacity double")
    keys = curves.property_keys(df, ["e"], "i", ["x", "sx", "opacity"])
    found = {(r.e, r.property, r.t, r.v) for r in keys.collect()}
    assert found == {("a", "x", 0, 0.0), ("a", "x", 19, 95.0), ("a", "opacity", 0, 0.5)}
    drawn = curves.key_errors(keys.filter("property = 'x'"), df.filter("e = 'a'"), ["e"], "i", "x").collect()
    assert len(drawn) == 20 and all(abs(r.drawn - r.x) < 1e-9 for r in drawn)


def test_curves_of_a_batch_are_compressed_at_once(spark, monkeypatch):
    from spanwise.operators import curves

    rng = np.random.default_rng(5)
    parts = [np.cumsum(rng.normal(size=n)) if n % 3 else np.repeat(rng.normal(size=n // 3), 3) for n in [1, 2, 3, *rng.integers(1, 60, 40)]]
    first, bound = np.concatenate([[0], np.cumsum([len(p) for p in parts])]), rng.uniform(0.1, 3, len(parts))
    alone = [curves.keys_of(p, b) for p, b in zip(parts, bound)]
    monkeypatch.setattr(curves, "ELEMENTS", 500)  # pieces of one length come in several turns
    for one, many in zip(alone, curves.keys_of_all(np.concatenate(parts), first, bound), strict=True):
        assert all(np.array_equal(x, y) for x, y in zip(one, many, strict=True))
    df = spark.createDataFrame([(e, i, float(v), float(bound[e])) for e, p in enumerate(parts) for i, v in enumerate(p)], "e long, i long, v double, b double").coalesce(1)
    keys = curves.eased_keys(df, ["e"], "i", "v", "b")
    assert keys.rdd.getNumPartitions() == 4  # few bytes, much work: not joined to one task
    want = {(e, int(t), float(v), curves.NAMES[s], error) for e, (at, values, eases, error) in enumerate(alone) for t, v, s in zip(at, values, eases)}
    assert {tuple(r) for r in keys.collect()} == want


def test_small_elements_get_wider_scales_and_misses_are_counted(spark):
    from spanwise.operators import curves

    rows = [(e, i, 1.0 + 0.04 * (i == 5), w, 3.0 * i) for e, w in (("small", 10.0), ("large", 400.0)) for i in range(9)]
    df = spark.createDataFrame(rows, "e string, i long, sx double, w double, x double")
    keys = curves.property_keys(df, ["e"], "i", ["sx", "x"], {"sx": "w"})
    assert {r.e for r in keys.filter("property = 'sx'").collect()} == {"large"}  # 2 / 10 of an edge's place is more than 0.04
    exact = {r.e: (r.place_error, r.longest_miss) for r in curves.fit_errors(keys, df, ["e"], "i", ["sx", "x"], {"sx": "w"}).collect()}
    assert exact == {"small": (0.0, 0), "large": (0.0, 0)}
    rough = spark.createDataFrame([("large", "x", 0, 0.0, "linear", 0.0), ("large", "x", 8, 0.0, "linear", 0.0)], "e string, property string, t long, v double, ease string, error double")
    missed = curves.fit_errors(rough, df, ["e"], "i", ["x"]).collect()
    assert [(r.e, r.place_error, r.longest_miss) for r in missed] == [("large", 24.0, 8)]
