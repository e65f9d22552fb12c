"""Masking of JSON text, shared sets of weaknesses, and items on their way to the model."""

import json

import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import rows
from sparkwarden.functions import masking
from sparkwarden.operators import findings
from sparkwarden.plans import report
from sparkwarden.sources import sinks

_TEXT = st.one_of(st.text(max_size=12), st.sampled_from(["password: hunter22", 'a "token=abc" \\ b', "AKIA" + "A" * 16, "x\ny: secret = q", "\u00e9\u4e2d\U0001f600"]))
_JSON = st.recursive(st.one_of(_TEXT, st.integers(), st.none(), st.booleans()),
                     lambda inner: st.one_of(st.lists(inner, max_size=3), st.dictionaries(_TEXT, inner, max_size=3)), max_leaves=8)


def _masked(value, table):
    if isinstance(value, str):
        return table[value]
    if isinstance(value, dict):
        return {k: _masked(v, table) for k, v in value.items()}
    if isinstance(value, list):
        return [_masked(v, table) for v in value]
    return value


def _strings(value):
    if isinstance(value, str):
        yield value
    elif isinstance(value, (dict, list)):
        for v in value.values() if isinstance(value, dict) else value:
            yield from _strings(v)


def _masks(spark, strings):
    listed = spark.createDataFrame(pd.DataFrame({"s": sorted(set(strings)) or [""]}))
    return dict(map(tuple, listed.select("s", masking.mask_secrets("s")).collect()))


@settings(max_examples=4, deadline=None)
@given(st.lists(_JSON, min_size=40, max_size=40), st.booleans())
def test_masked_json_equals_masked_leaves(spark, values, plain):
    data = [json.dumps(v, ensure_ascii=plain, indent=None if plain else 1) for v in values]
    df = spark.createDataFrame(pd.DataFrame({"i": range(len(data)), "j": data}))
    got = masking.mask_json(df, "j").orderBy("i").collect()
    table = _masks(spark, [s for v in values for s in _strings(v)])
    for value, text, row in zip(values, data, got):
        assert json.loads(row.j) == _masked(value, table)
        if _masked(value, table) == value:
            assert row.j == text


def test_masked_json_keeps_what_is_no_string(spark):
    text = '{ "password: a" : [1.50, 12345678901234567890123, true, null, "token=abc"],\n"b":"\\u0041" }'
    long = json.dumps({"a": "x" * 3_000_000 + " password=hunter2"})
    df = spark.createDataFrame([(0, text), (1, None), (2, ""), (3, '{"a": "password=hunter2'), (4, '{"a":"secret=q1","a":2}'), (5, long)], "i int, j string")
    got = [r.j for r in masking.mask_json(df, "j").orderBy("i").collect()]
    assert got[0] == text.replace("token=abc", "token=***MASKED***")
    assert got[1:3] == [None, ""]
    assert "hunter2" not in got[3] and "q1" not in got[4]
    assert json.loads(got[5])["a"] == "x" * 3_000_000 + " password=***MASKED***"


def test_no_python_in_masking(spark):
    df = masking.mask_json(spark.createDataFrame([("{}",)], "j string"), "j")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_weakness_sets_are_stored_once(spark):
    d = spark.createDataFrame([("CWE-89", "SQL Injection"), ("CWE-22", "Path Traversal"), ("CWE-78", "Command Injection"), ("cwe-89 ", "SQL Injection"), ("CWE-9", None), ("", "empty")],
                              "cwe_id string, cwe_name string")
    e = spark.range(300).select(F.col("id").alias("evidence_id"), F.when(F.col("id") % 3 == 0, "sql and path and command").when(F.col("id") % 3 == 1, "see CWE-89").alias("evidence"))
    links, sets = findings.weakness_sets(e, d)
    assert sets.count() == 3 + 4 and links.count() == 300
    whole = links.join(sets, "set_id").select("evidence_id", "cwe_id")
    assert rows(whole.filter("evidence_id = 0")) == [(0, "CWE-22"), (0, "CWE-78"), (0, "CWE-89")]
    assert whole.filter("evidence_id = 1").count() == 4 and whole.filter("evidence_id = 2").count() == 4
    _, first = findings.weakness_sets(e, d, limit=2)
    assert rows(first.filter("set_id = 'all'"), "rank", "cwe_id") == [(1, "CWE-9"), (2, "CWE-22")]
    links, sets = findings.weakness_sets(e.limit(0), d.limit(0))
    assert links.isEmpty() and sets.isEmpty()


def test_every_item_has_one_outcome(spark):
    rule = "array<struct<line int, rules array<struct<rule_id string, severity string>>>>"
    schema = f"file_path string, findings {rule}, result struct<ok boolean, severity string>, layer int, seq int, matched_text string"
    hit = lambda s: [(1, [("R", s)])]
    data = [
        ("src/a.py", hit("critical"), None, 1, 0, "api_key=abcdef"), ("src/a.py", None, (True, None), 2, 1, None),
        ("src/b.py", None, (True, "High"), 0, 0, "m"), ("src/b.py", hit("critical"), None, 1, 5, "late"),
        ("src/c.py", hit("info"), None, 1, 0, None), ("tests/d.py", hit("critical"), None, 1, 0, None),
        ("", hit("critical"), None, 1, 0, None), ("gone.py", hit("critical"), None, 1, 0, None), ("src/e.py", hit("critical"), None, 1, 0, "known")]
    items = spark.createDataFrame(data, schema)
    nodes = spark.createDataFrame([("r", f"File:src/{x}.py", "File", f"{x}.py", f"src/{x}.py", 1, 9, "body") for x in "abce"],
                                  "repo_name string, id string, label string, name string, file_path string, start_line long, end_line long, content string")
    edges = spark.createDataFrame([("r", "File:src/b.py", "File:src/a.py", "CALLS", 1.0, -1)], "repo_name string, from_id string, to_id string, relation_type string, confidence double, step int")
    d = spark.createDataFrame([("CWE-89", "SQL"), ("CWE-22", "Path")], "cwe_id string, cwe_name string")
    key = spark.createDataFrame([("src/e.py", "known", "", "No algorithmic path found.")], "f string, m string, e string, p string").select(
        sinks.cache_key("f", "m", "e", "e", "p").alias("cache_key"), F.lit("CWE-1").alias("selected_cwe_id"), F.lit("x").alias("selected_cwe_name"), F.lit("Low").alias("severity"))
    out = report.prepare_analysis(items, nodes, edges, d, key.unionByName(key), "r")
    assert rows(out.results, "node_id", "outcome", "selected_cwe_id") == sorted([
        ("", "no_node", "SKIPPED"), ("File:src/c.py", "skipped_low", "SKIPPED"), ("File:tests/d.py", "skipped_path", "SKIPPED"),
        ("File:gone.py", "failed", "ERROR"), ("File:src/e.py", "reused", "CWE-1")], key=repr)
    pending = {r.node_id: r for r in out.pending.collect()}
    assert set(pending) == {"File:src/a.py", "File:src/b.py"}
    assert pending["File:src/a.py"].paths == "File:src/b.py -> File:src/a.py" and "--- Node: File:src/b.py ---" in pending["File:src/a.py"].prompt
    assert json.loads(pending["File:src/a.py"].evidence)["matched_text"] == "api_key=***MASKED***"
    assert json.loads(pending["File:src/b.py"].evidence)["layer1_findings"] == [{"line": 1, "rules": [{"rule_id": "R", "severity": "critical"}]}]
    assert [w["cwe_id"] for w in json.loads(pending["File:src/a.py"].weaknesses)] == ["CWE-22", "CWE-89"]
    empty = report.prepare_analysis(items.limit(0), nodes, edges, d, key, "r")
    assert empty.pending.isEmpty() and empty.results.isEmpty()
