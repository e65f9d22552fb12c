import json

from conftest import rows

from sparkwarden.functions import masking
from sparkwarden.operators import code, scoring
from sparkwarden.sources import files, graph_json, sarif, sinks
from sparkwarden.streaming import jobs


def put(path, value):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(value if isinstance(value, str) else json.dumps(value), encoding="utf-8")
    return str(path)


def test_file_trees(spark, tmp_path):
    root = tmp_path / "repos"
    for name, text in {"one/src/a.py": "x", "one/tests/b.py": "x", "one/big.py": "y" * 400_000, "two/Dockerfile": "FROM x", "two/readme.md": "r",
                       "two/build/c.py": "z", "two/test_d.py": "z"}.items():
        put(root / name, text)
    assert [r[0] for r in rows(files.read_repo_files(spark, str(root)), "file_path")] == ["Dockerfile", "big.py", "src/a.py", "test_d.py"]
    assert rows(files.read_repo_files(spark, str(root), 350_000), "repo", "file_path", "content") == [
        ("one", "src/a.py", "x"), ("two", "Dockerfile", "FROM x"), ("two", "test_d.py", "z")]
    assert rows(files.read_scan_files(spark, str(root)), "repo", "file_path") == [
        ("one", "big.py"), ("one", "src/a.py"), ("one", "tests/b.py"), ("two", "Dockerfile")]


def test_graph_dump(spark, tmp_path):
    path = put(tmp_path / "g.json", {
        "nodes": [{"id": "Function:a:f", "label": "Function", "properties": {"name": "f", "filePath": "a", "startLine": "3", "isExported": "true", "returnType": "int", "zip": "1"}},
                  {"label": "Class", "properties": {"name": "K"}}, {"properties": {}}],
        "relationships": [{"sourceId": "a", "targetId": "b", "type": "CALLS", "step": None}, {"sourceId": "", "targetId": "b", "type": "CALLS"}]})
    g = graph_json.read_graph_json(spark, path, "r")
    assert rows(g.nodes, "id", "label", "start_line", "is_exported", "return_type", "raw_properties") == [
        ("Class:K", "Class", None, None, None, "{}"), ("Function:a:f", "Function", 3, True, "int", '{"zip":"1"}')]
    assert rows(g.relations, "from_id", "to_id", "step") == [("a", "b", -1)]
    assert rows(g.rejected.groupBy("kind").count()) == [("node", 1), ("relation", 1)]


SARIF = {"runs": [{"tool": {"driver": {"rules": [{"id": "q", "name": "Q", "properties": {"tags": ["security", "external/cwe/cwe-089"], "problem.severity": "error"}}]}},
                   "results": [{"ruleId": "q", "message": {"text": "m"}, "locations": [{"physicalLocation": {"artifactLocation": {"uri": "repo/a.py"}, "region": {"startLine": 2}}}]},
                               {"ruleId": "q", "locations": []},
                               {"ruleId": "zz", "locations": [{"physicalLocation": {"artifactLocation": {"uri": "repo/b.py"}}}]}]},
                  {"tool": {"driver": {"rules": []}}, "results": [{"ruleId": "w", "locations": [{"physicalLocation": {"artifactLocation": {"uri": "repo/c.py"}}}]}]}]}


def test_analyzer_formats(spark, tmp_path):
    path = put(tmp_path / "s.sarif", SARIF)
    texts = spark.createDataFrame([("repo/a.py", "one\n  two \n")], "file_path string, content string")
    got = sarif.read_sarif(spark, path, texts)
    assert rows(got, "file_path", "line", "column", "rule_id", "name", "category", "cwe", "severity", "description", "line_content") == [
        ("repo/a.py", 2, 1, "q", "Q", "security", ["CWE-089"], "error", "m", "two"), ("repo/b.py", 1, 1, "zz", "zz", "codeql", [], "warning", "", "")]
    every = sarif.load_findings(spark, path, "CodeQL", ["repo"])
    assert rows(every, "repo", "file_path", "line", "category", "severity") == [
        ("repo", "a.py", 2, "security,external/cwe/cwe-089", "error"), ("repo", "b.py", 1, "", ""), ("repo", "c.py", 1, "", "")]
    semgrep = put(tmp_path / "m.json", {"results": [{"path": "./x/repo/a.py", "start": {"line": 4}, "check_id": "c", "extra": {"severity": "ERROR", "message": "m", "metadata": {"technology": "py"}}},
                                                    {"path": "elsewhere/a.py", "start": {"line": 4}, "check_id": "c"}]})
    assert rows(sarif.load_findings(spark, semgrep, "semgrep", ["repo", "other"]), "file_path", "line", "category") == [("a.py", 4, "py")]
    listed = put(tmp_path / "l.json", [{"path": "repo/a.py", "start_line": 3, "rule": "r"}, {"file": "b.py", "repo": "mine", "line": 2}])
    wrapped = put(tmp_path / "w.json", {"findings": [{"file_path": "repo/z.py", "rule_id": "r", "description": "d"}]})
    assert rows(sarif.load_findings(spark, listed, "tool", ["repo", "other"]), "repo", "file_path", "line", "rule_id") == [("mine", "b.py", 2, ""), ("repo", "a.py", 3, "r")]
    assert rows(sarif.read_generic_findings(spark, wrapped, "tool", ["repo"]), "file_path", "line", "message") == [("z.py", 1, "d")]


def test_feeds_and_lists(spark, tmp_path):
    d = put(tmp_path / "c.json", [{"cwe_id": "cwe-79", "name": "XSS"}, "noise", {"cwe_id": "CWE-89", "cwe_name": "SQL", "description": "d"}])
    assert rows(files.read_cwe_dictionary(spark, d)) == [("CWE-79", "XSS", ""), ("CWE-89", "SQL", "d")]
    feed = put(tmp_path / "f.txt", "\n".join(["http://a", "", "  ", "http://b"]))
    assert rows(files.read_url_feed(spark, feed, 10), "url", "risk") == [("http://a", "High"), ("http://b", "High")]
    nvd = put(tmp_path / "n.json", {"vulnerabilities": [
        {"cve": {"id": "CVE-1", "published": "p", "descriptions": [{"value": "d"}], "metrics": {"cvssMetricV30": [{"cvssData": {"baseScore": 9.8}}]}}},
        {"cve": {"id": "CVE-2", "published": "p", "descriptions": [{"value": "d"}], "metrics": {}}}]})
    assert rows(files.read_nvd_json(spark, nvd), "id", "score") == [("CVE-1", "9.8"), ("CVE-2", "N/A")]
    lines = put(tmp_path / "j.jsonl", '{"idx": 1, "target": 1, "func": "f"}\n\n{"idx": 2, "target": 0}\n')
    assert rows(files.read_jsonl_dataset(spark, lines), "idx", "target") == [(1, 1), (2, 0)]


def test_sinks(spark, tmp_path):
    schema = "repo_name string, id string, name string"
    base = spark.createDataFrame([("a", "1", "x"), ("b", "1", "y"), ("b", "2", "z")], schema)
    path = str(tmp_path / "nodes")
    sinks.write_partitioned(base, path)
    sinks.write_partitioned(spark.createDataFrame([("b", "9", "new")], schema), path)
    assert rows(spark.read.parquet(path), "repo_name", "id") == [("a", "1"), ("b", "9")]
    source = spark.createDataFrame([("a", "1", "first", 1), ("a", "1", "last", 2), ("c", "1", "add", 1)], schema + ", seq int")
    assert rows(sinks.upsert_nodes(base, source)) == [("a", "1", "last"), ("b", "1", "y"), ("b", "2", "z"), ("c", "1", "add")]
    calls = []

    def step(df):
        calls.append(df.count())
        return df.selectExpr("k", "k * 2 AS v")

    out = str(tmp_path / "out")
    for n in (10, 10, 15):
        sinks.checkpointed_run(spark, spark.range(n).withColumnRenamed("id", "k"), out, ["k"], step, "k long, v long", 3)
    assert sum(calls) == 15 and spark.read.parquet(out).count() == 15


def test_change_log(spark, tmp_path):
    schema = "k string, ts int, v string"
    src, keys = tmp_path / "in", ["k"]
    for i, data in enumerate(([("a", 1, "x"), ("b", 1, "x"), ("a", 2, "y")], [("a", 3, "z"), ("c", 1, "n")])):
        spark.createDataFrame(data, schema).coalesce(1).write.parquet(str(src / f"p{i}"))
        stream = jobs.file_stream(spark, str(src) + "/*", spark.createDataFrame([], schema).schema)
        jobs.stream_sync(stream, str(tmp_path / "log"), keys, "ts", str(tmp_path / "ck")).awaitTermination()
    state = jobs.current_rows(spark, str(tmp_path / "log"), schema + ", batch int", keys, "ts")
    assert rows(state, "k", "ts", "v") == [("a", 3, "z"), ("b", 1, "x"), ("c", 1, "n")]
    jobs.compact(spark, str(tmp_path / "log"), schema + ", batch int", keys, "ts", str(tmp_path / "log2"))
    assert rows(jobs.current_rows(spark, str(tmp_path / "log2"), schema + ", batch int", keys, "ts"), "k", "v") == [("a", "z"), ("b", "x"), ("c", "n")]


def test_code_extraction(spark):
    py = "import lib.util\n\n\ndef f(x):\n    g(x)\n    return x.h()\n\n\nclass K:\n    async def g(self):\n        pass\n"
    js = "const u = require('./u')\nfunction a(x) {\n  b(x)\n}\nconst b = (y) => {\n  return c(y)\n}\n"
    df = spark.createDataFrame([("r", "m.py", py), ("r", "bad.py", "def ("), ("r", "lib/util.py", ""), ("r", "w/j.js", js), ("r", "w/u.js", "")],
                               "repo string, file_path string, content string")
    fns = code.build_functions(df)
    got = rows(fns.filter("name != '<file>'").selectExpr("name", "start_line", "end_line", "array_join(array_sort(calls), ',')"))
    assert got == [("a", 2, 4, "a,b"), ("b", 5, 7, "c"), ("f", 4, 6, "g,h"), ("g", 10, 11, "")]
    assert rows(code.import_edges(df), "file_path", "imported") == [("m.py", "lib/util.py"), ("w/j.js", "w/u.js")]
    assert ("r:m.py:f:4", "r:m.py:g:10") in rows(code.build_code_graph(fns, df), "src", "dst")


def test_scorer_failures_stay_in_their_batch(spark):
    import numpy as np

    def flaky():
        def score(codes):
            if any("boom" in c for c in codes):
                raise ValueError("boom")
            return np.array([[0.0, 3.0]] * len(codes))
        return score

    df = spark.createDataFrame([("1", "ok"), ("2", " "), ("3", "boom"), ("4", "ok"), ("5", None)], "node_id string, content string").coalesce(1)
    got = rows(scoring.score_functions(df, flaky, batch_size=1).selectExpr("node_id", "result.ok", "result.label", "result.error"))
    assert got == [("1", True, "VULNERABLE", None), ("2", False, None, "Empty or null function code"), ("3", False, None, "Scorer failed: boom"), ("4", True, "VULNERABLE", None)]
    assert rows(scoring.keep_vulnerable(scoring.score_functions(df, flaky, batch_size=1)), "node_id") == [("1",), ("4",)]


def test_responses(spark):
    flat = {"selected_cwe_id": 89, "attack_path": [{"a": 1}, "b"], "remediation": ["x", ""], "candidate_comparison": "no"}
    nested = {"security_report": {"vulnerability_summary": {"root_cause": "rc", "severity": "High"}, "cwe_matrix": {"cwe-79": {"fit": "strong", "name": "XSS"}}}}
    deep = {"a": {"b": {"c": flat}}}
    data = ["```json\n{\"selected_cwe_id\": \"1\"}\n```\n```\n" + json.dumps(flat) + "\n```", "text {not json} " + json.dumps(nested) + " tail", json.dumps(deep), "nothing", 'x {"root_cause": "a\\.b", "selected_cwe_id": "CWE-5"}']
    df = spark.createDataFrame(list(enumerate(data)), "i int, t string")
    got = scoring.normalize_responses(df, "t", "r").orderBy("i").collect()
    assert [r.r.selected_cwe_id for r in got] == ["CWE-89", "CWE-79", "CWE-89", "UNMAPPED", "CWE-5"]
    assert got[0].r.attack_path == '{"a":1}\nb' and got[0].r.remediation == ["x"] and got[0].r.candidate_comparison == "[]"
    assert (got[1].r.selected_cwe_name, got[1].r.root_cause, got[1].r.severity, got[1].r.evidence_strength) == ("XSS", "rc", "High", "medium")
    assert got[4].r.root_cause == "a\\.b"


def test_opaque_json_masking(spark):
    doc = json.dumps({"a": ["password: hunter22", 3], "b": {"c": None, "d": "plain"}})
    df = masking.mask_json(spark.createDataFrame([(doc,), (None,)], "j string"), "j")
    assert json.loads(df.collect()[0].j) == {"a": ["password=***MASKED***", 3], "b": {"c": None, "d": "plain"}}
