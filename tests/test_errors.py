"""Malformed and unusual input that once stopped a job or gave stale rows."""

from pyspark.sql import functions as F
from sparkwarden.functions import vectors as vx
from sparkwarden.operators import findings
from sparkwarden.sources import graph_json, sinks
from sparkwarden.streaming import jobs

from conftest import rows


def test_zero_vector_has_no_distance(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0]), ([2.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(vx.cosine_distance("a", "b")).collect()] == [None, 0.0]


def test_bad_number_is_rejected(spark):
    schema = "id string, label string, properties map<string,string>"
    nodes = spark.createDataFrame([("1", "F", {"startLine": "abc"}), ("2", "F", {"startLine": "7", "isExported": ""})], schema)
    relations = spark.createDataFrame([], "sourceId string, targetId string, type string, confidence double, reason string, step int")
    g = graph_json.normalise(nodes, relations, "r")
    assert rows(g.nodes, "id", "start_line") == [("2", 7)]
    assert "abc" in g.rejected.first().record


def test_relations_of_an_earlier_sync_go(spark, tmp_path):
    node, relation = str(tmp_path / "n"), str(tmp_path / "r")
    nodes = spark.createDataFrame([("a b", "1", 0), ("c", "2", 0)], "repo_name string, id string, seq int")
    relations = spark.createDataFrame([("a b", "1", "CALLS", "1", -1, 0), ("c", "2", "CALLS", "2", -1, 0)], "repo_name string, from_id string, relation_type string, to_id string, step int, seq int")
    sinks.replace_repo(nodes, relations, node, relation, ["a b", "c"])
    sinks.replace_repo(nodes.filter("repo_name = 'a b'"), relations.limit(0), node, relation, ["a b"])
    assert rows(spark.read.parquet(node), "repo_name", "id") == [("a b", "1"), ("c", "2")]
    assert rows(spark.read.parquet(relation), "repo_name") == [("c",)]


def test_late_event_of_a_smaller_order_loses(spark, tmp_path):
    schema = "k string, ts int, v string"
    source, log = str(tmp_path / "in"), str(tmp_path / "log")
    spark.createDataFrame([("a", 5, "new")], schema).coalesce(1).write.parquet(source + "/1")
    spark.createDataFrame([("a", 3, "late"), ("b", 1, "x")], schema).coalesce(1).write.parquet(source + "/2")
    stream = jobs.file_stream(spark, source + "/*", schema, files_per_trigger=1)
    jobs.stream_sync(stream, log, ["k"], "ts", str(tmp_path / "check")).awaitTermination()
    assert len(list((tmp_path / "log").glob("batch=*"))) == 2
    assert rows(jobs.current_rows(spark, log, schema, ["k"], "ts"), "k", "v") == [("a", "new"), ("b", "x")]


def test_large_dictionary(spark):
    d = spark.range(30_000).select(F.concat(F.lit("CWE-"), "id").alias("cwe_id"), F.lit("plain").alias("cwe_name"))
    e = spark.createDataFrame([(1, "see CWE-12345 here"), (2, "nothing")], "evidence_id int, evidence string")
    got = rows(findings.prefilter_cwe(e, d), "evidence_id", "cwe_id", "whole_dictionary")
    assert got == sorted([(1, f"CWE-{'12345'[:n]}", False) for n in range(1, 6)] + [(2, None, True)], key=repr)
