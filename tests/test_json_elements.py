"""Elements of large JSON documents against a parser, with splits of a few bytes."""

import json
import random

import pytest

from conftest import rows
from test_scale import most_rows
from sparkwarden.sources import graph_json
from sparkwarden.sources.json_elements import json_elements


@pytest.fixture
def tiny_splits(spark):
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    old = {k: spark.conf.get(k) for k in keys}
    for k in keys:
        spark.conf.set(k, "97" if k == keys[0] else "0")
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v)


def _value(rng, depth):
    kind = rng.randrange(7 if depth else 3)
    if kind < 3:
        return rng.choice(["}", '{"a":{', '\\"}', "\\", "\\\\\"{", "x" * 150, "", "é}\n", 7, None, "[", '"nodes":[{'])
    if kind < 5:
        return {rng.choice(['k"}', "b{", "c", "nodes"]): _value(rng, depth - 1) for _ in range(rng.randrange(3))}
    return [_value(rng, depth - 1) for _ in range(rng.randrange(3))]


def _objects(document):
    for field, value in document.items():
        stack = list(value) if isinstance(value, list) else [value]
        while stack:
            x = stack.pop(0)
            if isinstance(x, dict):
                yield field, x
            elif isinstance(x, list):
                stack = [*x, *stack]


def test_elements_equal_a_parser(tiny_splits, tmp_path):
    rng, want = random.Random(3), {}
    for i in range(40):
        document = {f: [_value(rng, 3) for _ in range(rng.randrange(8))] if f != "one" else _value(rng, 2) for f in rng.sample(["nodes", "relationships", 'o"{}', "one"], 3)}
        path = tmp_path / "in" / f"{i}.json"
        path.parent.mkdir(exist_ok=True)
        path.write_text(json.dumps(document, indent=rng.choice([None, 1]), ensure_ascii=rng.random() < 0.5) + rng.choice(["", "\n"]), encoding="utf-8")
        want[path.name] = [(f[f.rfind('}'):] if '}' in f else f, x) for f, x in _objects(document)]
    (tmp_path / "in" / "empty.json").write_text("")
    found = json_elements(tiny_splits, str(tmp_path / "in"))
    got = {name: [] for name in want}
    for r in found.orderBy("file", "place").collect():
        got[r.file.rsplit("/", 1)[1]].append((r.field, json.loads(r.element)))
    assert got == want and sum(map(len, want.values())) > 40


def test_cut_off_and_deeper_levels(tiny_splits, tmp_path):
    (tmp_path / "a.json").write_text('{"nodes":[{"id":"1","x":{"y":2}},{"id":"2","x":{"y":3}')
    assert rows(json_elements(tiny_splits, str(tmp_path / "a.json")), "field", "element") == [("nodes", '{"id":"1","x":{"y":2}}')]
    runs = {"runs": [{"results": [{"n": i, "in": [{"m": "}" * i}]} for i in range(9)], "tool": {"driver": {}}}] * 2}
    (tmp_path / "b.json").write_text(json.dumps(runs))
    got = rows(json_elements(tiny_splits, str(tmp_path / "b.json"), 3).filter("field = 'results'"), "element")
    assert sorted(json.loads(r[0])["n"] for r in got) == sorted([*range(9)] * 2)
    (tmp_path / "c.json").write_text('[{"a":1}, {"b":{}}\n]')
    assert rows(json_elements(tiny_splits, str(tmp_path / "c.json"), 1), "field", "element") == [(None, '{"a":1}'), (None, '{"b":{}}')]


def test_large_dump_is_read_in_many_tasks(tiny_splits, tmp_path):
    dump = {"nodes": [{"id": f"n{i}", "label": "Function", "properties": {"name": "f{" + str(i), "startLine": i if i % 5 else "x"}} for i in range(60)],
            "relationships": [{"sourceId": "n1", "targetId": f"n{i}", "type": "CALLS", "step": i} for i in range(60)] + [{"sourceId": "n1"}]}
    path = tmp_path / "g.json"
    path.write_text(json.dumps(dump))
    assert tiny_splits.read.option("lineSep", "}").text(str(path)).rdd.getNumPartitions() > 20
    one, many = graph_json.read_graph_json(tiny_splits, str(path), "r"), graph_json.read_large_graph_json(tiny_splits, str(path), "r")
    assert rows(many.nodes) == rows(one.nodes) and one.nodes.count() == 48
    assert rows(many.relations) == rows(one.relations)
    assert rows(many.rejected) == rows(one.rejected) and one.rejected.count() == 13


def test_text_of_single_pieces_is_not_shuffled(spark, tmp_path):
    """Batches of three pieces; only elements of several pieces meet."""
    dump = {"nodes": [{"id": f"n{i}", "properties": {"name": "}" * (i % 3)}} for i in range(50)], "relationships": [{"sourceId": f"n{i}"} for i in range(3000)]}
    (tmp_path / "g.json").write_text(json.dumps(dump))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        found = json_elements(spark, str(tmp_path / "g.json"))
        assert most_rows(found, "shuffleRecordsWritten") < 300
        got = [(r.field, json.loads(r.element)) for r in found.orderBy("place").collect()]
        assert got == [(f, x) for f in dump for x in dump[f]]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
