from conftest import rows

from sparkwarden.operators import code, graph
from sparkwarden.sources import files


def test_hubs_keep_all_partners(spark):
    edges = [("r", f"a{i:02d}", "hub", "CALLS", i) for i in range(60)] + [("r", "hub", f"b{i:02d}", "IMPORTS", i) for i in range(60)]
    df = spark.createDataFrame(edges, "repo_name string, from_id string, to_id string, relation_type string, step int")
    assert graph.callers(df).filter("node_id = 'hub'").count() == graph.callees(df).filter("node_id = 'hub'").count() == 60
    assert graph.callers(df, limit=50).filter("node_id = 'hub'").count() == 50


def test_common_names_keep_all_targets(spark):
    fns = spark.createDataFrame([("r", f"n{i:02d}", f"f{i:02d}.py", "run", 1, []) for i in range(12)] + [("r", "c", "c.py", "main", 1, ["run"])],
                                "repo string, node_id string, file_path string, name string, start_line int, calls array<string>")
    assert code.call_targets(fns).count() == 13
    src = spark.createDataFrame([("r", "c.py", "run()")], "repo string, file_path string, content string")
    assert len(rows(code.build_code_graph(fns, src).filter("src = 'c'"))) == 12
    assert len(rows(code.build_code_graph(fns, src, 8).filter("src = 'c'"))) == 8


def test_full_fingerprint_sees_every_file(spark):
    make = lambda last: spark.createDataFrame([("r", f"f{i:03d}", last if i == 149 else "x") for i in range(150)], "repo string, file_path string, content string")
    full = [rows(files.repo_fingerprint_full(make(x)), "fingerprint", "files") for x in "xy"]
    assert full[0] != full[1] and full[0][0][1] == 150
    assert rows(files.repo_fingerprint(make("x"), 100)) == rows(files.repo_fingerprint(make("y"), 100))
