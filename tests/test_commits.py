"""Commits of several tables, and progress merged field by field over batches."""

import pytest
from conftest import rows
from pyspark.sql import functions as F

from sparkwarden.sources import sinks
from sparkwarden.streaming import jobs

NODES, EDGES, LOG = "repo_name string, id int", "repo_name string, a int, b int", "repo_name string, sync int"


def state(spark, root):
    return [rows(sinks.read_committed(spark, root, t, s)) for t, s in (("nodes", NODES), ("edges", EDGES), ("log", LOG))]


def test_all_tables_change_at_once_or_not_at_all(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    frame = lambda data, schema: spark.createDataFrame(data, schema)
    assert state(spark, root) == [[], [], []]
    first = {"nodes": frame([("a", 1), ("a", 2), ("b c/ü", 3)], NODES), "edges": frame([("a", 1, 2), ("b c/ü", 3, 3)], EDGES), "log": frame([("a", 1), ("b c/ü", 1)], LOG)}
    assert sinks.commit_repos(spark, root, first, ["a", "b c/ü"]) == 1
    before = [[("a", 1), ("a", 2), ("b c/ü", 3)], [("a", 1, 2), ("b c/ü", 3, 3)], [("a", 1), ("b c/ü", 1)]]
    assert state(spark, root) == before
    # the first table is written, the second fails
    broken = frame([("a", 9, 9)], EDGES).withColumn("b", F.raise_error(F.lit("lost")).cast("int"))
    with pytest.raises(Exception, match="lost"):
        sinks.commit_repos(spark, root, {"nodes": frame([("a", 7)], NODES), "edges": broken, "log": frame([("a", 2)], LOG)}, ["a"])
    assert state(spark, root) == before
    # a repository that lost its edges, and rows of a repository that is not listed
    again = {"nodes": frame([("a", 7), ("z", 1)], NODES), "edges": frame([], EDGES), "log": frame([("a", 2)], LOG)}
    assert sinks.commit_repos(spark, root, again, ["a"]) == 2
    after = [[("a", 7), ("b c/ü", 3)], [("b c/ü", 3, 3)], [("a", 2), ("b c/ü", 1)]]
    assert state(spark, root) == after
    # the folder of the failed run goes; versions that still count stay
    assert sinks.drop_unused(spark, root, ["nodes", "edges", "log"]) >= 1
    assert state(spark, root) == after


def test_fields_keep_their_last_known_value(spark, tmp_path):
    schema = "scan_id string, ts long, percent int, stage string"
    batches = [[("s", 1, 10, "start"), ("s", 5, None, "scan"), ("t", 1, 1, None)], [("s", 3, 30, "late"), ("s", 6, 60, None), ("u", 2, None, None)]]
    for i, b in enumerate(batches):
        spark.createDataFrame(b, schema).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        out = []
        jobs.stream_progress_fields(stream, "scan_id", "ts", "percent", "stage").writeStream.outputMode("complete").foreachBatch(
            lambda df, _, out=out: out.append(rows(df))).option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
        want = [[("s", 5, 10, "scan"), ("t", 1, 1, None)], [("s", 6, 60, "scan"), ("t", 1, 1, None), ("u", 2, None, None)]][i]
        assert out[-1] == want
