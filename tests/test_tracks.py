from pyspark.sql import functions as F

from spanwise.operators import tracks
from spanwise.sources import synthetic

BOX = "struct<x0:double,y0:double,x1:double,y1:double>"


def test_kept_texts(spark):
    rows = spark.createDataFrame([("a", i, "Hi", 0.5) for i in range(3)] + [("b", 0, "x", 0.95)] * 3 + [("c", 0, "x", 0.5)] * 3 + [("d", 0, "Hello", 1.0)], "e string, i long, t string, c double")
    assert {r.e: r.kept for r in tracks.kept_texts(rows, ["e"], "t", "i", "c").collect()} == {"a": True, "b": True, "c": False, "d": False}


def test_claims_go_to_the_first_owner(spark):
    rows = spark.createDataFrame([(1, "a", True), (1, "a", False), (2, "a", True), (2, "b", False)], "o int, i string, hit boolean")
    assert [(r.o, r.i) for r in tracks.claims(rows, "o", "i", F.col("hit"), 0.5).collect()] == [(1, "a")]


def test_smallest_holder(spark):
    items = spark.createDataFrame([(0, 1, (1.0, 1.0, 3.0, 3.0)), (0, 2, (50.0, 50.0, 60.0, 60.0))], f"f int, item int, box {BOX}")
    holders = spark.createDataFrame([(0, 7, (0.0, 0.0, 10.0, 10.0)), (0, 8, (0.0, 0.0, 4.0, 4.0))], f"f int, holder int, box {BOX}")
    assert [(r["item"], r.holder) for r in tracks.smallest_holder(items, holders, ["f"], "item", "holder").collect()] == [(1, 8)]


def test_successions_and_reveals_chain(spark):
    box = (0.0, 0.0, 2.0, 2.0)
    spans = spark.createDataFrame([(1, 10, 0, 4, box), (1, 11, 5, 9, box), (1, 12, 11, 12, box), (1, 13, 30, 40, box)], f"s int, id int, first long, last long, box {BOX}")
    assert {r.node: r.component for r in tracks.successions(spans, ["s"], "id", 2, 0.5).collect()} == {10: 10, 11: 10, 12: 10}
    typed = spark.createDataFrame([(1, 1, "Y", 0, 2), (1, 2, "You", 3, 5), (1, 3, "You ju", 6, 8), (1, 4, "No", 9, 10)], "s int, id int, t string, first long, last long")
    assert {r.node: r.component for r in tracks.reveals(typed, ["s"], "id", "t", 3).collect()} == {1: 1, 2: 1, 3: 1}


def test_verified_counts_missing(spark):
    want = spark.createDataFrame([(1, (0.0, 0.0, 1.0, 1.0)), (2, (0.0, 0.0, 1.0, 1.0))], f"k int, box {BOX}")
    got = want.filter("k = 1").withColumn("box", F.expr("named_struct('x0', 0.5D, 'y0', 0.0D, 'x1', 1.0D, 'y1', 1.0D)"))
    row = tracks.verified(want, got, ["k"], 1.0).first()
    assert (row.error, row.missing, row.passed) == (0.5, 1, False)
    assert tracks.verified(want, want, ["k"], 0.0).first().passed is True


def test_regions_join_diagonals(spark):
    grid = ["110", "001", "220"]
    cells = spark.createDataFrame([("s", x, y, int(v)) for y, row in enumerate(grid) for x, v in enumerate(row)], "s string, x int, y int, label int")
    found = {(r.label, r.area): (r.x0, r.y0, r.x1, r.y1) for r in tracks.regions(cells, ["s"], "x", "y", "label", 2).collect()}
    assert found[(1, 3)] == (0, 0, 3, 2) and found[(2, 2)] == (0, 2, 2, 3)


def test_relaxed_top_drops_filters_in_order(spark):
    rows = spark.createDataFrame([("a", 1, 5.0, True, False), ("a", 2, 9.0, False, True), ("b", 3, 1.0, True, True)], "g string, id int, s double, p boolean, q boolean")
    got = sorted((r.g, r.id, r.level) for r in tracks.relaxed_top(rows, ["g"], [F.col("p"), F.col("q")], F.col("s"), ["id"], 1).collect())
    assert got == [("a", 1, 1), ("b", 3, 2)]


def test_best_of_both_and_largest_window(spark):
    scores = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 0.2), ("b", "x", 0.4), ("b", "y", 0.6)], "l string, r string, s double")
    assert tracks.best_of_both(scores, "l", "r", "s").first().similarity == 0.8
    costs = spark.createDataFrame([(i, float(c)) for i, c in enumerate([3, 1, 4, 1, 5])], "i long, c double")
    assert tracks.largest_window(costs, "i", "c", 8.0) == 2 and tracks.largest_window(costs, "i", "c", 0.5) == 0 and tracks.largest_window(costs, "i", "c", 99.0) == 5


def test_synthetic_scenes_repeat(spark):
    a, b = (synthetic.moving_boxes(spark, 3, 2, 3, 4).orderBy("scene", "element", "frame").collect() for _ in range(2))
    assert a == b and len(a) == 24 and all(abs(r.x - r.seen_x) <= 0.5 for r in a)


def test_regions_send_no_side_through_the_driver(spark):
    from spanwise.operators import tracks

    cells = spark.createDataFrame([(0, x, y, (x + y) // 3 % 2) for x in range(6) for y in range(6)], "scene long, x long, y long, label long")
    found = tracks.regions(cells, ["scene"], "x", "y", "label", 1)
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.selectExpr("sum(area)").first()[0] == 36
