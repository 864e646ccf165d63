from spanwise.operators import greedy


def test_budget_lets_later_small_rows_in(spark):
    rows = spark.createDataFrame([("a", 0, 6, 2), ("a", 1, 6, 5), ("a", 2, 3, 1)], "e string, i int, full int, small int")
    assert [r.form for r in greedy.fit_in_budget(rows, ["e"], ["i"], "full", "small", 10).orderBy("i").collect()] == ["full", None, "full"]


def test_spacing_and_limit(spark):
    rows = spark.createDataFrame([("a", i) for i in (0, 3, 6, 7, 13, 20)], "e string, i int")
    assert sorted(r.i for r in greedy.spaced(rows, ["e"], "i", 6, 3).collect()) == [0, 6, 13]


def test_points_join_the_first_representative(spark):
    rows = spark.createDataFrame([("s", 1, 0.0, 0.0), ("s", 2, 2.0, 0.0), ("s", 3, 4.0, 0.0)], "s string, i int, x double, y double")
    assert {r.i: r.representative for r in greedy.merged_points(rows, ["s"], "i", ["x", "y"], 3.0).collect()} == {1: 1, 2: 1, 3: 3}


def test_boundaries_are_used_once(spark):
    truth = spark.createDataFrame([("c", 10), ("c", 11), ("c", 30)], "c string, i long")
    found = spark.createDataFrame([("c", 11), ("c", 31), ("c", 50), ("d", 1)], "c string, i long")
    got = {r.c: (r.hits, r.precision, r.recall) for r in greedy.boundary_scores(truth, found, ["c"], "i", 1).collect()}
    assert got == {"c": (2, 2 / 3, 2 / 3), "d": (0, 0.0, None)}
