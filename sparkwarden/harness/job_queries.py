"""Composed jobs, model responses and streams."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwarden.harness.finding_queries import _KEYS as KEYS_SQL
from sparkwarden.harness.graph_queries import META, NOISE, ROOT_SQL, root_of
from sparkwarden.harness.registry import query
from sparkwarden.harness.text_queries import _MARK as MARK_SQL
from sparkwarden.harness.text_queries import DOC_MATCHES
from sparkwarden.harness.views import REPO, code_files, code_functions, doc_files, nodes, relations, spread, table, with_views
from sparkwarden.operators import rules, scoring
from sparkwarden.plans import report
from sparkwarden.session import shared_folder
from sparkwarden.sources import graph_json, sinks
from sparkwarden.streaming import jobs


# --- responses --------------------------------------------------------------------------------
@query("normalize_reports", """
SELECT o_orderkey, CASE o_orderkey % 3 WHEN 2 THEN 'UNMAPPED' ELSE 'CWE-' || (o_custkey % 900) END AS cwe, CASE o_orderkey % 3 WHEN 2 THEN 'Unknown' ELSE 'High' END AS severity,
  CASE o_orderkey % 3 WHEN 2 THEN '' ELSE 'a' || chr(10) || 'b' || o_orderkey END AS attack_path, 'weak' AS evidence FROM orders""")
def normalize_reports(spark, sf):
    """Model responses: fenced, inline after prose, and without any object."""
    o = table(spark, sf, "orders")
    body = F.concat(F.lit('{"report": {"selected_cwe_id": "'), (F.col("o_custkey") % 900).cast("string"), F.lit('", "severity": "High", "attack_path": ["a", "b'),
                    F.col("o_orderkey").cast("string"), F.lit('"], "remediation": "fix \\. it"}}'))
    kind = F.col("o_orderkey") % 3
    raw = F.when(kind == 0, F.concat(F.lit("Result:\n```json\n"), body, F.lit("\n```\ndone"))).when(
        kind == 1, F.concat(F.lit("I think {x} first. "), body, F.lit(" end"))).otherwise(F.lit("no object {here"))
    parsed = scoring.normalize_responses(o.select("o_orderkey", raw.alias("raw")), "raw", "r")
    return parsed.select("o_orderkey", F.col("r.selected_cwe_id").alias("cwe"), F.col("r.severity").alias("severity"),
                         F.col("r.attack_path").alias("attack_path"), F.col("r.evidence_strength").alias("evidence"))


@query("build_evidence", """
SELECT doc_id, (0.1 + quality * 0.8)::DOUBLE > 0.8 AS passes FROM labels""")
def build_evidence(spark, sf):
    p = (F.lit(0.1) + F.col("quality") * 0.8).cast("double")
    rows = table(spark, sf, "labels").select(
        "doc_id", F.struct(F.lit(True).alias("ok"), F.lit("x").alias("label"), F.lit(1).alias("label_id"), p.alias("confidence"),
                           F.create_map(F.lit(1), p).alias("prob_by_label_id")).alias("result"), F.array(F.lit("n")).alias("retrieved_nodes"))
    text = rows.withColumn("e", scoring.build_evidence(rows))
    return text.select("doc_id", F.get_json_object("e", "$.layer2_softmax.passes_threshold").cast("boolean").alias("passes"))


# --- composed jobs ----------------------------------------------------------------------------

@query("scan_report", with_views(DOC_MATCHES + """
SELECT selected_cwe_id, severity, count(*) AS n FROM (SELECT CASE WHEN rule_id = 'SEC031' THEN 'CWE-327' WHEN category = 'hardcoded_secret' THEN 'CWE-798' WHEN category = 'misconfiguration' THEN 'CWE-352' ELSE rule_id END AS selected_cwe_id, 'Critical' AS severity
  FROM matches WHERE rule_id LIKE 'SEC%') GROUP BY ALL""", "files"))
def scan_report(spark, sf):
    """Rule hits of all documents and model hits of the derived functions as one report table."""
    out = report.scan_report(spread(doc_files(spark, sf)), code_functions(spark, sf))
    return out.reports.filter(F.col("layer1_raw")).groupBy("selected_cwe_id", "severity").agg(F.count("*").alias("n"))


@query("scan_report_routes", with_views("""
SELECT 'job' AS route, 1 AS layer, count(DISTINCT file_path) AS n FROM code WHERE left(name, 1) IN ('c', 't')""", "code"))
def scan_report_routes(spark, sf):
    """How the scan report routes its items."""
    out = report.scan_report(spread(code_files(spark, sf)), code_functions(spark, sf))
    return out.routed.groupBy("route", "layer").agg(F.count("*").alias("n"))


@query("repository_blocks", with_views("""
SELECT 'File:' || 'sup/n' || s_nationkey || '.py' AS root_id, count(*)::BIGINT AS layer1_findings FROM supplier GROUP BY s_nationkey ORDER BY root_id LIMIT 10""", "nodes"))
def repository_blocks(spark, sf):
    """Context blocks of the worst files; every supplier is a critical finding in its file."""
    hits = table(spark, sf, "supplier").select(
        F.concat(F.lit("File:sup/n"), F.col("s_nationkey").cast("string"), F.lit(".py")).alias("file_path"), F.col("s_suppkey").alias("line"),
        F.lit("SEC001").alias("rule_id"), F.lit("hardcoded_secret").alias("category"), F.lit("critical").alias("severity"))
    blocks, _ = report.repository_blocks(hits, hits.limit(0).select("file_path"), nodes(spark, sf), relations(spark, sf), REPO, max_files=10)
    return blocks.filter(F.col("context").startswith("## File: sup/")).select("root_id", "layer1_findings")


@query("item_context", with_views(f"SELECT id AS root_id, TRUE AS has_paths, TRUE AS bounded FROM nodes WHERE id = {ROOT_SQL}", "nodes"))
def item_context(spark, sf):
    """Prompt input of one item: masked neighbourhood and call paths within the size limit."""
    n = nodes(spark, sf)
    out = report.item_context(n, relations(spark, sf), root_of(n), depth=1)
    return out.select("root_id", F.col("paths").contains(" -> ").alias("has_paths"), (F.length("prompt") <= 9100).alias("bounded"))

CONTAINERS = "('File', 'Folder')"
_FENCE = "chr(10) || '```python' || chr(10) || r.name || chr(10) || '```' || chr(10)"


def _middle(c: str, limit: int) -> str:
    return f"CASE WHEN length({c}) <= {limit} THEN {c} ELSE left({c}, {limit // 2}) || {MARK_SQL} || right({c}, {limit - limit // 2}) END"


# What item_context gives for the nodes of ``roots``, one level around, with names as contents.
_CONTEXT_SQL = f"""
edges AS (SELECT * FROM relations WHERE relation_type NOT IN {META}),
touching AS (SELECT r.id AS root_id, e.* FROM roots r JOIN edges e ON e.from_id = r.id UNION ALL SELECT r.id, e.* FROM roots r JOIN edges e ON e.to_id = r.id AND e.from_id <> e.to_id),
near AS (SELECT DISTINCT t.root_id, o.id AS oid FROM touching t JOIN nodes o ON o.id = CASE WHEN t.from_id = t.root_id THEN t.to_id ELSE t.from_id END AND o.id <> t.root_id JOIN roots r ON r.id = t.root_id
  WHERE o.label NOT IN {NOISE} AND o.file_path = r.file_path AND (r.label IN {CONTAINERS} OR o.label NOT IN {CONTAINERS})),
members AS (SELECT id AS root_id, 0 AS level, * FROM roots UNION ALL SELECT near.root_id, 1, n.* FROM near JOIN nodes n ON n.id = near.oid),
sym AS (SELECT root_id, string_agg('- [' || label || '] `' || name || '` (lines ' || start_line || '-' || end_line || ')', chr(10) ORDER BY level, label, name, id) AS t FROM members WHERE label <> 'File' GROUP BY root_id),
rel AS (SELECT t.root_id, string_agg('- ' || from_id || ' --[' || relation_type || ']--> ' || to_id, chr(10) ORDER BY relation_type, from_id, to_id, step::VARCHAR) AS t FROM touching t
  JOIN near ON near.root_id = t.root_id AND near.oid = CASE WHEN t.from_id = t.root_id THEN t.to_id ELSE t.from_id END GROUP BY t.root_id),
texts AS (SELECT r.id AS root_id, r.file_path, '## File: ' || r.file_path || {_FENCE} || coalesce(chr(10) || '## Symbols:' || chr(10) || sym.t, '') || coalesce(chr(10) || chr(10) || '## Relations:' || chr(10) || rel.t, '') AS c
  FROM roots r LEFT JOIN sym ON sym.root_id = r.id LEFT JOIN rel ON rel.root_id = r.id),
calls AS (SELECT from_id, to_id FROM relations WHERE relation_type IN ('CALLS', 'DATA_DEPENDS_ON')),
walks AS (SELECT to_id AS root_id, from_id AS node, 1 AS depth, [to_id, from_id] AS path FROM calls JOIN roots ON id = to_id
  UNION ALL SELECT root_id, c.from_id, depth + 1, list_append(path, c.from_id) FROM walks JOIN calls c ON c.to_id = walks.node WHERE depth < 10 AND NOT list_contains(path, c.from_id)),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY root_id ORDER BY depth DESC, array_to_string(path, chr(1))) AS rank FROM walks) WHERE rank <= 10),
lines AS (SELECT root_id, string_agg(array_to_string(list_reverse(path), ' -> '), chr(10) ORDER BY rank) AS paths FROM best GROUP BY root_id),
bodies AS (SELECT root_id, string_agg(chr(10) || '--- Node: ' || id || ' ---' || chr(10) || name || chr(10), '' ORDER BY id) AS bodies
  FROM (SELECT DISTINCT root_id, unnest(path) AS node FROM best) JOIN nodes ON nodes.id = node GROUP BY root_id),
full_ AS (SELECT t.root_id, coalesce(paths, 'No algorithmic path found.') AS paths, '[Repository: {REPO} | Target File: ' || file_path || ']' || chr(10) || '[CALL PATHS (SOURCE -> SINK)]' || chr(10) || coalesce(paths, 'No algorithmic path found.')
  || chr(10) || chr(10) || '[NODES ALONG THE PATHS]' || chr(10) || coalesce(bodies, '') || chr(10) || chr(10) || chr(10) || '[GRAPH CONTEXT]' || chr(10) || ({_middle('t.c', 22_000)}) AS p
  FROM texts t LEFT JOIN lines ON lines.root_id = t.root_id LEFT JOIN bodies ON bodies.root_id = t.root_id)"""


@query("item_context_all", with_views(f"""
, roots AS (SELECT * FROM nodes WHERE label = 'Class'),{_CONTEXT_SQL}
SELECT root_id, sha256(paths) AS paths_sha256, sha256({_middle('p', 9_000)}) AS prompt_sha256, length(p) > 9000 AS cut FROM full_""", "nodes", "relations", recursive=True))
def item_context_all(spark, sf):
    """The whole prompt input of every class: context, ten deepest call paths and the contents of their nodes."""
    n = nodes(spark, sf).withColumn("content", F.col("name"))
    roots = n.filter(F.col("label") == "Class").select("repo_name", F.col("id").alias("root_id"))
    out = report.item_context(n, relations(spark, sf), roots, depth=1)
    return out.select("root_id", F.sha2("paths", 256).alias("paths_sha256"), F.sha2("prompt", 256).alias("prompt_sha256"), (F.length("prompt") > 9000).alias("cut"))


_ANALYSIS_ITEMS = """
named AS (SELECT file_path, end_line AS k FROM nodes WHERE label = 'File'
  UNION ALL SELECT 'docs/n' || n_nationkey || '.md', n_nationkey::BIGINT FROM nation UNION ALL SELECT 'gone/r' || r_regionkey || '.py', 1::BIGINT + 4 * r_regionkey FROM region),
item AS (SELECT file_path, k, CASE WHEN k % 4 = 0 THEN 'info' ELSE 'critical' END AS severity, 'cwe-' || (k % 5) || ' ' || (['sql path', 'command', 'secret', 'none'])[k % 4 + 1] AS note, 'm' || k AS matched,
  '{"file_path":"' || file_path || '","findings":[{"line":' || k || ',"rules":[{"rule_id":"R' || k || '","severity":"critical"}]}],"note":"' || note || '; password=***MASKED***","matched_text":"' || matched || '"}' AS evidence FROM named),
d AS (SELECT 'CWE-' || r_regionkey AS cwe_id, lower(r_name) || ' ' || (['sql', 'path', 'auth', 'command', 'sql path'])[r_regionkey + 1] AS cwe_name FROM region)"""


@query("prepare_analysis", with_views(f"""
, {_ANALYSIS_ITEMS},
roots AS (SELECT nodes.* FROM nodes JOIN item ON item.file_path = nodes.file_path WHERE label = 'File' AND severity = 'critical'),{_CONTEXT_SQL},
cand AS (SELECT file_path, cwe_id, cwe_name, (contains(lower(evidence), lower(cwe_id)) OR len(list_filter({KEYS_SQL}, lambda w: contains(lower(evidence), w) AND contains(cwe_name, w))) > 0) AS hit FROM item CROSS JOIN d),
counted AS (SELECT *, count(*) FILTER (hit) OVER (PARTITION BY file_path) AS n FROM cand),
weak AS (SELECT file_path, '[' || string_agg('{{"cwe_id":"' || cwe_id || '","cwe_name":"' || cwe_name || '"}}', ',' ORDER BY cwe_id) || ']' AS weaknesses FROM counted WHERE hit OR n < 3 GROUP BY file_path),
job AS (SELECT item.*, 'File:' || item.file_path AS node_id, weaknesses, p
  FROM item JOIN weak ON weak.file_path = item.file_path LEFT JOIN full_ ON root_id = 'File:' || item.file_path WHERE severity = 'critical' AND item.file_path NOT LIKE 'docs/%')
SELECT node_id, 'pending' AS outcome, sha256({_middle('p', 9_000)} || chr(10) || evidence || chr(10) || weaknesses) AS detail FROM job WHERE p IS NOT NULL AND k % 3 <> 0
UNION ALL SELECT node_id, 'reused', 'CWE-' || k FROM job WHERE p IS NOT NULL AND k % 3 = 0
UNION ALL SELECT node_id, 'failed', 'ERROR' FROM job WHERE p IS NULL
UNION ALL SELECT 'File:' || file_path, CASE WHEN file_path LIKE 'docs/%' THEN 'skipped_path' ELSE 'skipped_low' END, 'SKIPPED' FROM item WHERE file_path LIKE 'docs/%' OR severity = 'info'""", "nodes", "relations", recursive=True))
def prepare_analysis(spark, sf):
    """Every file's first item on its way to the model: routed, with evidence, weaknesses and context, or with a known result."""
    n = nodes(spark, sf).withColumn("content", F.col("name"))
    named = n.filter(F.col("label") == "File").select("file_path", F.col("end_line").alias("k")).unionByName(
        table(spark, sf, "nation").select(F.concat(F.lit("docs/n"), F.col("n_nationkey").cast("string"), F.lit(".md")).alias("file_path"), F.col("n_nationkey").cast("long").alias("k"))).unionByName(
        table(spark, sf, "region").select(F.concat(F.lit("gone/r"), F.col("r_regionkey").cast("string"), F.lit(".py")).alias("file_path"), (F.col("r_regionkey") * 4 + 1).cast("long").alias("k")))
    pick = lambda words, i: F.element_at(F.array(*[F.lit(w) for w in words]), (i + 1).cast("int"))
    k = F.col("k")
    rule = F.struct(F.concat(F.lit("R"), k.cast("string")).alias("rule_id"), F.when(k % 4 == 0, "info").otherwise("critical").alias("severity"))
    note = F.concat(F.lit("cwe-"), (k % 5).cast("string"), F.lit(" "), pick(("sql path", "command", "secret", "none"), k % 4))
    first = named.select("file_path", F.array(F.struct(k.alias("line"), F.array(rule).alias("rules"))).alias("findings"), F.lit(1).alias("layer"), k.alias("seq"),
                         F.concat(note, F.lit("; password: hunter2")).alias("note"), F.concat(F.lit("m"), k.cast("string")).alias("matched_text"))
    again = named.select("file_path", F.struct(F.lit(True).alias("ok")).alias("result"), F.lit(2).alias("layer"), k.alias("seq"))
    items = first.unionByName(again, allowMissingColumns=True)
    d = table(spark, sf, "region").select(F.concat(F.lit("CWE-"), F.col("r_regionkey").cast("string")).alias("cwe_id"), F.concat_ws(
        " ", F.lower("r_name"), pick(("sql", "path", "auth", "command", "sql path"), F.col("r_regionkey"))).alias("cwe_name"))
    known = named.filter(k % 3 == 0).select("file_path", F.concat(F.lit("m"), k.cast("string")).alias("m"), F.lit("").alias("e"), F.lit("No algorithmic path found.").alias("p"), "k")
    cache = known.select(sinks.cache_key("file_path", "m", "e", "e", "p").alias("cache_key"), F.concat(F.lit("CWE-"), k.cast("string")).alias("selected_cwe_id"),
                         F.lit("known").alias("selected_cwe_name"), F.lit("High").alias("severity"))
    out = report.prepare_analysis(items, n, relations(spark, sf), d, cache, REPO)
    text = F.sha2(F.concat_ws("\n", "prompt", "evidence", "weaknesses"), 256)
    return out.pending.select("node_id", F.lit("pending").alias("outcome"), text.alias("detail")).unionByName(
        out.results.select("node_id", "outcome", F.col("selected_cwe_id").alias("detail")))


def _as_document(field: str):
    """Lines of JSON objects to one document a partition, a row at a time."""
    def write(batches):
        mark = '{"' + field + '":['
        for batch in batches:
            batch["value"] = [mark + batch["value"].iloc[0], *("," + v for v in batch["value"].iloc[1:])] if len(batch) else []
            mark = "," if len(batch) else mark
            yield batch
        yield pd.DataFrame({"value": ["]}" if mark == "," else mark + "]}"]})

    return write


@query("large_graph_dump", with_views("""
SELECT 'node' AS kind, id AS a, label AS b, name || '{"' || coalesce(start_line, -1) AS c FROM nodes UNION ALL SELECT 'relation', from_id, relation_type, to_id || step FROM relations""", "nodes", "relations"))
def large_graph_dump(spark, sf):
    """The graph written as JSON documents and read again by splits; names hold braces and quotes."""
    n, path = nodes(spark, sf), _scratch(spark, "dump")
    node = F.struct("id", "label", F.create_map(F.lit("name"), F.concat("name", F.lit('{"')), F.lit("startLine"), F.col("start_line").cast("string")).alias("properties"))
    edge = F.struct(F.col("from_id").alias("sourceId"), F.col("to_id").alias("targetId"), F.col("relation_type").alias("type"), "confidence", "step")
    n.select(F.to_json(node).alias("value")).mapInPandas(_as_document("nodes"), "value string").write.option("lineSep", " ").text(f"{path}/nodes")
    relations(spark, sf).select(F.to_json(edge).alias("value")).mapInPandas(_as_document("relationships"), "value string").write.text(f"{path}/relations")
    g = graph_json.read_large_graph_json(spark, f"{path}/*", REPO)
    return g.nodes.select(F.lit("node").alias("kind"), F.col("id").alias("a"), F.col("label").alias("b"), F.concat(
        "name", F.coalesce("start_line", F.lit(-1)).cast("string")).alias("c")).unionByName(g.relations.select(
            F.lit("relation").alias("kind"), F.col("from_id").alias("a"), F.col("relation_type").alias("b"), F.concat("to_id", F.col("step").cast("string")).alias("c")))


@query("prompt_table", "SELECT doc_id::VARCHAR AS root_node_id, length(text) AS n FROM documents")
def prompt_table(spark, sf):
    d = table(spark, sf, "documents")
    context = d.select(F.col("doc_id").cast("string").alias("root_id"), F.col("text").alias("context"))
    evidence = d.select(F.col("doc_id").cast("string").alias("root_id"), F.to_json(F.struct("lang", "source")).alias("evidence"))
    out = sinks.prompt_table(context, evidence, "docs", 22_000, F.to_timestamp(F.lit("2024-01-01")))
    return out.select("root_node_id", F.length("graph_context").cast("long").alias("n"))


@query("markdown_report", """
WITH c AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1)
SELECT '| Type | Events |' || chr(10) || '|---|---:|' || chr(10) || string_agg('| ' || event_type || ' | ' || n || ' |', chr(10) ORDER BY event_type) || chr(10) AS markdown FROM c""")
def markdown_report(spark, sf):
    c = table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return sinks.markdown_table(c, ["event_type", "n"], ["Type", "Events"], ["event_type"])


@query("replace_repo", """
SELECT 'r' || (c_nationkey % 5) AS repo_name, count(*) AS n, count(*) FILTER (c_nationkey % 5 = 2) AS replaced, count(*) FILTER (c_nationkey % 5 <> 2) AS relations
FROM customer WHERE c_nationkey % 5 <> 2 OR c_custkey % 2 = 0 GROUP BY ALL""")
def replace_repo(spark, sf):
    """Replace one repository, which has lost all its relations, through the operator."""
    node_path, relation_path = _scratch(spark, "nodes"), _scratch(spark, "relations")
    c = table(spark, sf, "customer").select(
        F.concat(F.lit("r"), (F.col("c_nationkey") % 5).cast("string")).alias("repo_name"), F.col("c_custkey").cast("string").alias("id"), F.lit(0).alias("generation"), F.lit(0).alias("seq"), "c_custkey")
    nodes = c.drop("c_custkey")
    relations = c.select("repo_name", F.col("id").alias("from_id"), F.lit("CALLS").alias("relation_type"), F.col("id").alias("to_id"), F.lit(-1).alias("step"), "generation", "seq")
    sinks.replace_repo(nodes, relations, node_path, relation_path, [f"r{i}" for i in range(5)])
    fresh = c.filter((F.col("repo_name") == "r2") & (F.col("c_custkey") % 2 == 0)).drop("c_custkey").withColumn("generation", F.lit(1))
    sinks.replace_repo(fresh, relations.limit(0), node_path, relation_path, ["r2"])
    n = spark.read.parquet(node_path).groupBy("repo_name").agg(F.count("*").alias("n"), F.sum("generation").alias("replaced"))
    r = spark.read.parquet(relation_path).groupBy("repo_name").agg(F.count("*").alias("relations"))
    return n.join(r, "repo_name", "left").select("repo_name", "n", "replaced", F.coalesce("relations", F.lit(0)).alias("relations"))


@query("commit_repos", """
SELECT 'r' || (c_nationkey % 5) AS repo_name, count(*) AS n, count(*) FILTER (c_nationkey % 5 = 2) AS replaced, count(*) FILTER (c_nationkey % 5 <> 2) AS relations,
  CASE WHEN c_nationkey % 5 = 2 THEN 2 ELSE 1 END AS sync
FROM customer WHERE c_nationkey % 5 <> 2 OR c_custkey % 2 = 0 GROUP BY ALL""")
def commit_repos(spark, sf):
    """Nodes, relations and the sync log in one commit; then one repository again, which has lost all its relations."""
    root = _scratch(spark, "committed")
    c = table(spark, sf, "customer").select(
        F.concat(F.lit("r"), (F.col("c_nationkey") % 5).cast("string")).alias("repo_name"), F.col("c_custkey").cast("string").alias("id"), F.lit(0).alias("generation"), "c_custkey")
    relations = c.select("repo_name", F.col("id").alias("from_id"), F.col("id").alias("to_id"))
    log = lambda n: c.select("repo_name", F.lit(n).alias("sync")).distinct()
    sinks.commit_repos(spark, root, {"nodes": c.drop("c_custkey"), "relations": relations, "sync_runs": log(1)}, [f"r{i}" for i in range(5)])
    fresh = c.filter(F.col("c_custkey") % 2 == 0).drop("c_custkey").withColumn("generation", F.lit(1))
    sinks.commit_repos(spark, root, {"nodes": fresh, "relations": relations.limit(0), "sync_runs": log(2)}, ["r2"])
    n = sinks.read_committed(spark, root, "nodes", c.drop("c_custkey").schema).groupBy("repo_name").agg(F.count("*").alias("n"), F.sum("generation").alias("replaced"))
    r = sinks.read_committed(spark, root, "relations", relations.schema).groupBy("repo_name").agg(F.count("*").alias("relations"))
    s = sinks.read_committed(spark, root, "sync_runs", "repo_name string, sync int")
    return n.join(r, "repo_name", "left").join(s, "repo_name").select("repo_name", "n", "replaced", F.coalesce("relations", F.lit(0)).alias("relations"), "sync")


@query("checkpointed_run", "SELECT o_orderkey, o_custkey * 2 AS twice FROM orders")
def checkpointed_run(spark, sf):
    """Work in batches; a second call finds nothing left to do."""
    path = _scratch(spark, "resume")
    work = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    step = lambda df: df.select("o_orderkey", (F.col("o_custkey") * 2).alias("twice"))
    for _ in range(2):
        sinks.checkpointed_run(spark, work, path, ["o_orderkey"], step, "o_orderkey long, twice long", batches=2)
    return spark.read.parquet(path)


# --- streams ----------------------------------------------------------------------------------

def _scratch(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def _stream(spark, sf: str, name: str) -> DataFrame:
    """The table as a stream; the pattern finds it as one file and as a folder of files."""
    schema = table(spark, sf, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf}/{name}.parque[t]")


def _drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over what is there and return its output table."""
    spark = stream.sparkSession
    out = _scratch(spark, "stream")
    schema = stream.schema
    if mode == "append":
        writer = stream.writeStream.format("parquet").option("path", f"{out}/data")
    else:
        def write(batch: DataFrame, _: int) -> None:
            batch.write.mode("overwrite").parquet(f"{out}/data")

        writer = stream.writeStream.foreachBatch(write)
    writer.outputMode(mode).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(schema).parquet(f"{out}/data")


@query("stream_trend", """
SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n FROM events WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR GROUP BY ALL""")
def stream_trend(spark, sf):
    """Daily counts from the event stream; the last, still open windows are not out yet."""
    return _drain(jobs.stream_trend(_stream(spark, sf, "events"), "ts", "1 day", "1 hour", "event_type"))


@query("stream_progress", "SELECT user_id AS scan_id, max(ts) AS ts, arg_max(event_type, (ts, event_type, value)) AS event_type, arg_max(value, (ts, event_type, value)) AS value FROM events GROUP BY user_id")
def stream_progress(spark, sf):
    events = _stream(spark, sf, "events").withColumnRenamed("user_id", "scan_id")
    return _drain(jobs.stream_progress(events, "scan_id", "ts", "event_type", "value"), "complete")


@query("stream_progress_fields", """
SELECT user_id AS scan_id, max(ts) AS ts, arg_max(event_type, (ts, event_type)) FILTER (value >= 30) AS stage, arg_max(value, (ts, value)) FILTER (value < 60) AS percent FROM events GROUP BY user_id""")
def stream_progress_fields(spark, sf):
    """Updates that tell a stage, a percentage or both, merged field by field."""
    events = _stream(spark, sf, "events").select(F.col("user_id").alias("scan_id"), "ts", F.when(F.col("value") >= 30, F.col("event_type")).alias("stage"),
                                                 F.when(F.col("value") < 60, F.col("value")).alias("percent"))
    return _drain(jobs.stream_progress_fields(events, "scan_id", "ts", "stage", "percent"), "complete")


@query("stream_rule_scan", with_views(DOC_MATCHES + "SELECT rule_id, count(*) AS hits, count(DISTINCT (repo, file_path)) AS files FROM matches GROUP BY rule_id", "files"))
def stream_rule_scan(spark, sf):
    docs = _stream(spark, sf, "documents").select(F.col("source").alias("repo"), F.col("doc_id").cast("string").alias("file_path"), F.col("text").alias("content"))
    return _drain(jobs.stream_rule_scan(docs, rules.rules_in(("core", "app")))).groupBy("rule_id").agg(
        F.count("*").alias("hits"), F.count_distinct("repo", "file_path").alias("files"))


@query("stream_dedup", "SELECT user_id, event_type, count(*) > 0 AS kept FROM events GROUP BY ALL")
def stream_dedup(spark, sf):
    """First result per (user, type) key over a watermark longer than the stream."""
    keyed = _stream(spark, sf, "events").withColumn("cache_key", F.concat_ws("|", F.col("user_id").cast("string"), "event_type"))
    out = _drain(jobs.stream_dedup_results(keyed, late="60 days"))
    return out.groupBy("user_id", "event_type").agg((F.count("*") == 1).alias("kept"))


@query("stream_sync", "SELECT user_id, count(*) AS n, max(ts) AS ts FROM (SELECT user_id, event_type, max(ts) AS ts FROM events GROUP BY ALL) GROUP BY user_id")
def stream_sync(spark, sf):
    """Incremental upsert of (user, type) rows through the change log."""
    path = _scratch(spark, "sync")
    events = _stream(spark, sf, "events").select("user_id", "event_type", "ts", "value")
    keys = ["user_id", "event_type"]
    jobs.stream_sync(events, f"{path}/log", keys, "ts", f"{path}/checkpoint").awaitTermination()
    schema = "user_id long, event_type string, ts timestamp, value double, batch int"
    state = jobs.current_rows(spark, f"{path}/log", schema, keys, "ts")
    return state.groupBy("user_id").agg(F.count("*").alias("n"), F.max("ts").alias("ts"))
