from conftest import rows

from sparkwarden.operators import findings
from sparkwarden.plans import report

ITEM = ("file_path string, findings array<struct<line:int,rules:array<struct<rule_id:string,name:string,category:string,severity:string>>>>, "
        "result struct<ok:boolean,severity:string>, layer int, seq int")


def rule(rid, category, severity):
    return {"rule_id": rid, "name": rid, "category": category, "severity": severity}


def items(spark, *data):
    return spark.createDataFrame([(p, f, r, 1 if f is not None else 2, i) for i, (p, f, r) in enumerate(data)], ITEM)


def long(spark, *data):
    return spark.createDataFrame(data, "file_path string, line int, rule_id string, category string, severity string")


def test_noise_paths_and_quality_rules(spark):
    data = items(
        spark,
        ("File:src/app.py", [{"line": 10, "rules": [rule("SEC008", "hardcoded_secret", "critical")]},
                             {"line": 20, "rules": [rule("py/commented-out-code", "quality", "recommendation")]}], None),
        ("File:node_modules/pkg/index.js", [{"line": 1, "rules": [rule("SEC001", "security", "critical")]}], None),
        ("File:test/fixtures/sample.py", [{"line": 1, "rules": [rule("SEC001", "security", "critical")]}], None))
    stats = findings.filter_stats(data).collect()[0].asDict()
    assert stats["ignored_path_items"] == 2 and stats["layer1_findings_kept"] == 1 and stats["files_after_cap"] == 1
    kept = data.select(findings.filter_findings("findings").alias("f")).collect()[0].f
    assert [f.line for f in kept] == [10]


def test_files_rank_by_severity(spark):
    hits = long(spark, ("File:src/warning.py", 3, "PATH001", "path_injection", "warning"),
                ("File:src/critical.py", 8, "SEC008", "hardcoded_secret", "critical"),
                ("File:latest/x.py", 8, "SEC008", "hardcoded_secret", "critical"))
    model = spark.createDataFrame([("Function:src/model.py:f",)], "file_path string")
    got = findings.rank_files(hits, model, 30).collect()
    assert [(r.file_path, r.file_rank, r.layer2_items) for r in got] == [("src/critical.py", 4, 0), ("src/model.py", 2, 1), ("src/warning.py", 2, 0)]


def test_dedup_and_routes(spark):
    low = [{"line": 1, "rules": [rule("a", "x", "info")]}]
    high = [{"line": 1, "rules": [rule("a", "x", "critical")]}]
    data = items(spark, ("src/a.py", high, None), ("Function:src/a.py:f", None, (True, "")), ("docs/b.py", high, None), ("src/c.py", low, None),
                 ("src/d.py", None, (True, "")), ("", high, None))
    routed = findings.route_findings(findings.dedup_by_node(data))
    assert rows(routed, "node_id", "layer", "route") == sorted([
        ("File:src/a.py", 1, "job"), ("File:docs/b.py", 1, "skipped_path"), ("File:src/c.py", 1, "skipped_low"),
        ("File:src/d.py", 2, "job"), ("", 1, "no_node")], key=repr)


def test_cwe_mapping(spark):
    df = spark.createDataFrame([("xss", "R1"), ("dos", "R2"), (None, "R3")], "category string, rule_id string")
    assert rows(df.select(findings.cwe_of("category", "rule_id"))) == [("CWE-79",), ("R2",), ("R3",)]
    ids = spark.createDataFrame([("CWE-089",), ("cwe-79",), ("X",)], "c string")
    assert rows(ids.select(findings.canonical_cwe("c"))) == [("CWE-79",), ("CWE-89",), ("X",)]


def test_scan_report(spark):
    files = spark.createDataFrame([("r", "src/a.py", "x = eval(y)\n")], "repo string, file_path string, content string")
    fns = spark.createDataFrame([("n", "r", "src/a.py", "f", 1, 2, "eval(eval(", ["eval"])],
                                "node_id string, repo string, file_path string, name string, start_line int, end_line int, content string, calls array<string>")
    out = report.scan_report(files, fns)
    assert rows(out.layer2, "function_name") == [("f",)]
    assert rows(out.routed, "node_id", "layer", "route") == [("File:src/a.py", 1, "job")]
    assert rows(out.reports, "selected_cwe_id", "severity") == [("CWE-94", "Critical")]


def test_repository_blocks_mask_secrets(spark):
    nodes = spark.createDataFrame([("r", "File:src/a.py", "File", "a.py", "src/a.py", 1, 3, "password = 'hunter22'\n")],
                                  "repo_name string, id string, label string, name string, file_path string, start_line long, end_line long, content string")
    rel = spark.createDataFrame([], "repo_name string, from_id string, to_id string, relation_type string, confidence double, step int")
    hits = long(spark, ("src/a.py", 1, "SEC004", "hardcoded_secret", "critical"), ("src/missing.py", 1, "SEC004", "hardcoded_secret", "critical"))
    blocks, _ = report.repository_blocks(hits, hits.limit(0), nodes, rel, "r")
    got = blocks.collect()
    assert [b.file_path for b in got] == ["src/a.py"]
    assert "hunter22" not in got[0].context and "password=***MASKED***" in got[0].context and "```python" in got[0].context
