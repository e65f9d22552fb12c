import random

from conftest import rows

from sparkwarden.operators import dashboards, evaluation, search


def test_confusion_metrics(spark):
    df = spark.createDataFrame([(True, True), (True, False), (False, True), (False, False), (True, True)], "predicted boolean, actual boolean")
    m = evaluation.confusion_metrics(df).collect()[0]
    assert (m.tp, m.fp, m.fn, m.tn, m.precision, m.recall, m.f1, m.accuracy) == (2, 1, 1, 1, 66.7, 66.7, 0.67, 60.0)
    empty = evaluation.confusion_metrics(df.limit(0)).collect()[0]
    assert (empty.tp, empty.precision, empty.f1) == (0, 0.0, 0.0)


def test_containing_function(spark):
    fns = spark.createDataFrame([("f", "r", "a", "f", 1, 20), ("g", "r", "a", "g", 5, 9), ("w", "r", "a", "<file>", 1, 30)],
                                "node_id string, repo string, file_path string, name string, start_line int, end_line int")
    pts = spark.createDataFrame([(1, "r", "a", 7), (2, "r", "a", 15), (3, "r", "a", 25)], "point_id int, repo string, file_path string, line int")
    assert rows(evaluation.containing_function(pts, fns), "point_id", "function_id") == [(1, "g"), (2, "f"), (3, "w")]


def test_band_join_equals_all_pairs(spark):
    rng = random.Random(5)
    a = [(i, "r", f"f{rng.randrange(2)}", rng.randrange(1, 80)) for i in range(60)]
    b = [(i, "r", f"f{rng.randrange(2)}", rng.randrange(1, 80)) for i in range(60)]
    left = spark.createDataFrame(a, "candidate_id int, repo string, file_path string, line int")
    right = spark.createDataFrame(b, "finding_id int, repo string, file_path string, line int")
    for w in (0, 1, 5):
        want = sorted(((x[0], y[0]) for x in a for y in b if x[2] == y[2] and abs(x[3] - y[3]) <= w), key=repr)
        assert rows(evaluation.band_join(left, right, w), "candidate_id", "f_finding_id") == want


def test_balanced_sample_is_balanced_and_stable(spark):
    df = spark.range(1000).selectExpr("id", "CAST(id % 10 = 0 AS INT) AS target")
    for cap in (0, 50, 51):
        one = evaluation.balanced_sample(df, "id", max_rows=cap)
        n = 100 if cap == 0 else cap // 2
        assert rows(one.groupBy("target").count()) == [(0, n), (1, n)]
        assert rows(one) == rows(evaluation.balanced_sample(df.repartition(7), "id", max_rows=cap))


def test_select_balanced_fills_up(spark):
    data = [(i, "r", "TP" if i < 2 else "FP", "c", "f", i, "x") for i in range(10)]
    df = spark.createDataFrame(data, "candidate_id int, repo string, oracle_label string, category string, file_path string, line int, rule_id string")
    assert rows(evaluation.select_balanced(df, 6), "candidate_id") == [(0,), (1,), (2,), (3,), (4,), (5,)]


def test_constraint_suite(spark):
    df = spark.createDataFrame(
        [("a", "primary", "x", ">", 0), ("a", "primary", "x", "<", 100), ("b", "primary", "x", ">", 0), ("b", "primary", "x", "<", 1),
         ("c", "primary", "x", "==", 5), ("c", "primary", "x", "==", 10), ("c", "alternative", "x", ">=", 0)],
        "case_id string, guard string, var string, op string, value long")
    assert rows(evaluation.constraint_verdicts(df)) == [("a", True, True), ("b", False, False), ("c", False, True)]


def test_fusion_and_names(spark):
    lists = [spark.createDataFrame(list(enumerate(x)), "rank int, id string") for x in (["a", "b", "c"], ["b", "d"])]
    assert [r.id for r in search.reciprocal_rank_fusion(lists, top=10).collect()] == ["b", "a", "d", "c"]
    df = spark.createDataFrame([("linux_linux_kernel",), ("n/a",), ("*",), ("Linux linux_kernel",)], "vendor_product string")
    assert rows(dashboards.top_products(df)) == [("Linux Kernel", 2)]


def test_text_dates(spark):
    df = spark.createDataFrame([("2024-02-03",), ("",), ("bad",), (None,)], "published_date string")
    assert rows(dashboards.cve_trend(df)) == [(2024, 1)]
    assert rows(dashboards.cve_trend(df, 2024, 2)) == [(3, 1)]
