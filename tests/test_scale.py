"""Steps that grow with their input, not with pairs of it; tables in many files."""

import random

import duckdb
import pytest
from conftest import rows

import __spark_entry__ as entry
import check
from sparkwarden.harness import views
from sparkwarden.operators import evaluation, graph, retrieval, search

SF = "/root/testdata/sf0.001"


def most_rows(df, metric="numOutputRows"):
    """The most rows (or another metric) that any operator of the finished plan gave out."""
    df.collect()

    def largest(plan):
        kind = plan.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return largest(plan.executedPlan())
        if kind.endswith("QueryStageExec"):
            return largest(plan.plan())
        given = plan.metrics().get(metric)
        below = plan.children()
        return max([given.get().value() if given.isDefined() else 0, *[largest(below.apply(i)) for i in range(below.size())]])

    return largest(df._jdf.queryExecution().executedPlan())


@pytest.mark.parametrize("name", ["stream_rule_scan", "stream_trend"])
def test_streams_read_a_table_of_many_files(spark, tmp_path, name):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in ("documents", "events"):
        spark.read.parquet(f"{SF}/{t}.parquet").repartition(3).write.parquet(f"{tmp_path}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, str(tmp_path))
    cur = con.execute(entry.oracle_sql()[name])
    want = check.rows_of([d[0] for d in cur.description], cur.fetchall())
    assert want[0] and check.rows_of(df.columns, [tuple(r) for r in df.collect()]) == want


def _points_and_spans(spark, points, spans):
    return (spark.createDataFrame(points, "point_id int, repo string, file_path string, line int"),
            spark.createDataFrame(spans, "node_id string, repo string, file_path string, start_line long, end_line long"))


def test_innermost_against_all_pairs(spark):
    rng = random.Random(3)
    points = [(i, "r", f"f{rng.randrange(3)}", rng.choice([None, *range(-3, 70)])) for i in range(200)] + [(900, "r", "f0", 2**31 - 1), (901, "r", None, 4)]
    spans = [(f"n{rng.randrange(50):02d}", "r", f"f{rng.randrange(2)}", s, s + rng.randrange(-2, 40)) for s in (rng.randrange(-4, 60) for _ in range(120))]
    spans += [("end", "r", "f0", 5, 2**31 - 1), ("open", "r", "f1", None, 9), ("lost", "r", None, 1, 9)]
    want = []
    for i, _, f, line in points:
        inside = [(e - s, s, n) for n, _, g, s, e in spans if line is not None and f is not None and f == g and s is not None and s <= line <= e]
        want.append((i, min(inside)[2] if inside else None))
    assert rows(evaluation.innermost(*_points_and_spans(spark, points, spans)), "point_id", "inner_id") == sorted(want, key=repr)


def test_innermost_does_not_pair_points_and_spans(spark):
    points, spans = [(i, "r", "f", i % 20) for i in range(1000)], [(f"n{i}", "r", "f", i % 15, i % 15 + 8) for i in range(1000)]
    assert most_rows(evaluation.innermost(*_points_and_spans(spark, points, spans))) <= 8000


def test_tool_matches_meet_a_line_once(spark):
    candidates = spark.createDataFrame([(i, "r", "f", i % 5) for i in range(1000)], "candidate_id int, repo string, file_path string, line int")
    found = spark.createDataFrame([(i, "r", "f", i % 11) for i in range(200)], "finding_id int, repo string, file_path string, line int")
    df = evaluation.match_tool_findings(candidates, found)
    near = {line: sorted(i for i in range(200) if abs(i % 11 - line) <= 5) for line in range(5)}
    assert rows(df, "candidate_id", "matched_count", "first_matches") == sorted(((i, len(near[i % 5]), near[i % 5][:5]) for i in range(1000)), key=repr)
    assert most_rows(df) <= 2000


def test_word_lists_hold_no_word_sets(spark):
    rng = random.Random(4)
    words = [f"word{i}" for i in range(220)]
    functions = spark.createDataFrame([(f"n{i:03d}", "r", "f", "g", " ".join(rng.sample(words, 200))) for i in range(40)],
                                      "node_id string, repo string, file_path string, name string, content string")
    candidates = spark.createDataFrame([(i, "r", None, " ".join(rng.sample(words, 30)), "", "", "") for i in range(5)],
                                       "candidate_id int, repo string, function_id string, rule_name string, category string, matched_text string, file_path string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = retrieval.text_context(candidates, functions, list_length=4)
        assert most_rows(found, "dataSize") < 5_000_000 and found.count() == 40
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_few_ids_do_not_shuffle_the_edges(spark):
    ids = [f"concat('n', {c}) AS {n}" for c, n in (("id", "from_id"), ("id + 1", "to_id"))]
    edges = spark.range(20_000).selectExpr("'r' AS repo_name", *ids, "'CALLS' AS relation_type", "-1 AS step")
    nodes = spark.range(20_000).selectExpr("'r' AS repo_name", "concat('n', id) AS id", "'Function' AS label", "concat('name', id) AS name", "'f' AS file_path")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20000")
    try:
        few = nodes.filter("name IN ('name3', 'name9')")
        touching = graph.edges_touching(edges, few)
        assert most_rows(touching, "shuffleRecordsWritten") < 100 and touching.count() == 4
        around = graph.neighbourhood(nodes, edges, few.selectExpr("repo_name", "id AS root_id"), 2, same_file=False)
        assert most_rows(around.edges, "shuffleRecordsWritten") < 100 and around.edges.count() == 8 and around.nodes.count() == 10
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_paths_into_one_node_leave_other_calls_alone(spark, monkeypatch):
    written, write = [], graph.reliable_checkpoint
    monkeypatch.setattr(graph, "reliable_checkpoint", lambda df: written.append(write(df)) or written[-1])
    edges = spark.range(5_000).selectExpr("'r' AS repo_name", "concat('n', id) AS from_id", "concat('n', id - id % 50) AS to_id", "'CALLS' AS relation_type")
    target = spark.createDataFrame([("r", "n100")], "repo_name string, target_id string")
    assert graph.call_paths(edges.filter("from_id <> to_id"), target).count() == 10
    assert sum(df.count() for df in written) < 250


def test_relations_are_joined_by_keys(spark):
    """Ids are made after the joins; the largest exchange holds the lines' own columns."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert most_rows(views.derive_relations(spark, "/root/testdata/sf0.01"), "dataSize") < 3_600_000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_repeated_links_are_cut_before_they_meet(spark):
    """A hub of 2,000 links, ten times each: its first 2 * max_nodes leave a task."""
    links = spark.range(20_000).selectExpr("'r' AS repo", "'hub' AS src", "concat('n', lpad(id % 2000, 4, '0')) AS dst")
    starts = spark.createDataFrame([(1, "r", "hub")], "candidate_id int, repo string, function_id string")
    found = retrieval.bfs_context(links, starts, 2, 4)
    assert rows(found, "position", "node_id") == [(0, "hub"), (1, "n0000"), (2, "n0001"), (3, "n0002")]
    assert most_rows(found, "shuffleRecordsWritten") < 1000


def test_batch_search_counts_words_in_their_record(spark):
    """A record gives a row per distinct word, not per word; the words of all records never meet in one table."""
    records = spark.createDataFrame([(1, "a", "a b " * 2000), (2, "b", "B"), (3, None, None), (3, "a a", "c")], "id int, title string, description string")
    queries = spark.createDataFrame([(7, "a c"), (8, "b"), (9, "")], "query_id int, query string")
    found = search.fulltext_topk_batch(records, queries)
    assert rows(found, "query_id", "id", "score", "rank") == [(7, 1, 801.0, 0), (7, 3, 2.4, 1), (8, 1, 800.0, 0), (8, 2, 1.4, 1)]
    assert most_rows(found) < 20


def test_band_join_repeats_no_finding(spark):
    found = spark.range(300).selectExpr("'r' AS repo", "'f' AS file_path", "CAST(id AS INT) AS line", "id AS finding_id")
    near = spark.createDataFrame([("r", "f", 150, 1)], "repo string, file_path string, line int, candidate_id long")
    pairs = evaluation.band_join(near, found, 5)
    assert sorted(r["f_line"] for r in pairs.collect()) == list(range(145, 156))
    assert most_rows(evaluation.band_join(near, found, 5)) <= 300
