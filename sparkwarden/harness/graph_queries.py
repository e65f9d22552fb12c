"""Code-graph queries over the graph view of the sales tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkwarden.harness.registry import query
from sparkwarden.harness.views import REPO, nodes, relations, table, with_views
from sparkwarden.operators import graph, impact, retrieval
from sparkwarden.sources import graph_json

NOISE = "('Variable', 'Community', 'Process', 'Section')"
META = "('MEMBER_OF', 'STEP_IN_PROCESS', 'ENTRY_POINT_OF')"
NODE_COLUMNS = "id, label, name, file_path, start_line, end_line"
_NODE = [c.strip() for c in NODE_COLUMNS.split(",")]
_EDGE = ["from_id", "to_id", "relation_type", "step"]

# The customer with the smallest key stands for a function under review.
ROOT_SQL = "(SELECT id FROM nodes WHERE label = 'Class' ORDER BY start_line LIMIT 1)"


def root_of(all_nodes):
    return all_nodes.filter(F.col("label") == "Class").orderBy("start_line").limit(1).select(
        "repo_name", F.col("id").alias("root_id"))


@query("graph_node_page", with_views(f"""
SELECT {NODE_COLUMNS} FROM nodes WHERE repo_name = 'tpch' AND label = 'Function' AND contains(lower(file_path), 'ord/p') ORDER BY label, name, id LIMIT 500 OFFSET 100""", "nodes"))
def graph_node_page(spark, sf):
    return graph.select_nodes(nodes(spark, sf), REPO, "Function", "ORD/p", 500, 100).select(*_NODE)


@query("graph_node_keyset_page", with_views(f"""
SELECT {NODE_COLUMNS} FROM nodes WHERE repo_name = 'tpch' AND (label > 'Function' OR (label = 'Function' AND name > 'order_5')) ORDER BY label, name, id LIMIT 200""", "nodes"))
def graph_node_keyset_page(spark, sf):
    n = nodes(spark, sf).filter(F.col("repo_name") == REPO)
    return graph.page_after(n, ["label", "name", "id"], ["Function", "order_5"], 200).select(*_NODE)


@query("graph_relation_page", with_views("""
SELECT from_id, to_id, relation_type, confidence, step FROM relations WHERE repo_name = 'tpch' AND relation_type = 'CALLS' ORDER BY relation_type, from_id, to_id, step LIMIT 500""", "relations"))
def graph_relation_page(spark, sf):
    return graph.select_relations(relations(spark, sf), REPO, "CALLS").select(*_EDGE, "confidence")


@query("graph_noise_filter", with_views(f"""
SELECT kind, value, count(*) AS n FROM (SELECT 'label' AS kind, label AS value FROM nodes WHERE label NOT IN {NOISE}
UNION ALL SELECT 'relation', relation_type FROM relations WHERE relation_type NOT IN {META}) GROUP BY ALL""", "nodes", "relations"))
def graph_noise_filter(spark, sf):
    a = graph.exclude_noise(nodes(spark, sf)).groupBy(F.lit("label").alias("kind"), F.col("label").alias("value")).agg(F.count("*").alias("n"))
    b = graph.exclude_meta_relations(relations(spark, sf)).groupBy(
        F.lit("relation").alias("kind"), F.col("relation_type").alias("value")).agg(F.count("*").alias("n"))
    return a.unionByName(b)


@query("label_counts", with_views("SELECT label, count(*) AS n FROM nodes GROUP BY label", "nodes"))
def label_counts(spark, sf):
    return graph.label_counts(nodes(spark, sf))


@query("graph_edges_touching", with_views("""
, ids AS (SELECT id FROM nodes WHERE file_path = 'seg/building.py')
SELECT from_id, to_id, relation_type, step FROM relations WHERE relation_type NOT IN ('IMPORTS') AND (from_id IN (SELECT id FROM ids) OR to_id IN (SELECT id FROM ids))""", "nodes", "relations"))
def graph_edges_touching(spark, sf):
    ids = nodes(spark, sf).filter(F.col("file_path") == "seg/building.py").select("repo_name", "id")
    return graph.edges_touching(relations(spark, sf), ids, ["IMPORTS"]).select(*_EDGE)


@query("graph_nodes_by_ids", with_views(f"""
SELECT {NODE_COLUMNS} FROM nodes WHERE label NOT IN {NOISE} AND id IN (SELECT to_id FROM relations WHERE relation_type = 'IMPORTS')""", "nodes", "relations"))
def graph_nodes_by_ids(spark, sf):
    ids = relations(spark, sf).filter(F.col("relation_type") == "IMPORTS").select("repo_name", F.col("to_id").alias("id"))
    return graph.nodes_by_ids(nodes(spark, sf), ids, ("Variable", "Community", "Process", "Section")).select(*_NODE)


@query("resolve_file_nodes", with_views("""
, asked AS (SELECT DISTINCT file_path FROM nodes WHERE file_path IS NOT NULL UNION SELECT name FROM nodes WHERE label = 'Process' UNION SELECT '')
SELECT file_path, CASE WHEN trim(file_path) = '' THEN NULL ELSE coalesce((SELECT min(id) FROM nodes n WHERE n.id = 'File:' || asked.file_path),
  (SELECT min(id) FROM nodes n WHERE n.label = 'File' AND n.file_path = asked.file_path)) END AS node_id FROM asked""", "nodes"))
def resolve_file_nodes(spark, sf):
    n = nodes(spark, sf)
    asked = (
        n.filter(F.col("file_path").isNotNull()).select("file_path")
        .unionByName(n.filter(F.col("label") == "Process").select(F.col("name").alias("file_path")))
        .unionByName(n.groupBy().agg(F.lit("").alias("file_path"))).distinct())
    return graph.resolve_file_nodes(n, asked.withColumn("repo_name", F.lit(REPO))).select("file_path", "node_id")


@query("graph_induced_edges", with_views(f"""
, page AS (SELECT id FROM nodes WHERE repo_name = 'tpch' AND label NOT IN {NOISE} ORDER BY label, name, id LIMIT 5000)
SELECT from_id, to_id, relation_type, step FROM relations WHERE relation_type NOT IN {META} AND from_id IN (SELECT id FROM page) AND to_id IN (SELECT id FROM page)""", "nodes", "relations"))
def graph_induced_edges(spark, sf):
    return graph.full_graph(nodes(spark, sf), relations(spark, sf), REPO).edges.select(*_EDGE)


@query("graph_full_unfiltered", with_views("""
SELECT id, label, string_split(coalesce(name, ''), '#')[1] AS display_name FROM nodes WHERE repo_name = 'tpch' ORDER BY label, name, id LIMIT 300 OFFSET 20""", "nodes"))
def graph_full_unfiltered(spark, sf):
    return graph.full_graph(nodes(spark, sf), relations(spark, sf), REPO, [], [], 300, 20).nodes.select("id", "label", "display_name")


def _levels(depth: int, keep: str) -> str:
    """Level CTEs of an undirected neighbourhood around the root."""
    out = f""", root AS (SELECT id, file_path AS root_path FROM nodes WHERE id = {ROOT_SQL}),
adj AS (SELECT from_id AS src, to_id AS dst FROM relations WHERE relation_type NOT IN {META} UNION SELECT to_id, from_id FROM relations WHERE relation_type NOT IN {META}),
v0 AS (SELECT id, 0 AS level FROM root)"""
    for i in range(1, depth + 1):
        out += f""",
n{i} AS (SELECT DISTINCT n.id FROM v{i - 1} v JOIN adj ON adj.src = v.id JOIN nodes n ON n.id = adj.dst CROSS JOIN root r WHERE v.level = {i - 1} AND {keep} AND n.id NOT IN (SELECT id FROM v{i - 1})),
v{i} AS (SELECT * FROM v{i - 1} UNION ALL SELECT id, {i} FROM n{i})"""
    return out


_FREE = f"n.label NOT IN {NOISE}"
_SAME = f"n.label NOT IN {NOISE} AND n.label NOT IN ('File', 'Folder') AND n.file_path = r.root_path"
_INSIDE = "SELECT e.from_id, e.to_id, e.relation_type, e.step FROM relations e JOIN v{d} a ON a.id = e.from_id JOIN v{d} b ON b.id = e.to_id WHERE e.relation_type NOT IN " + META + " AND least(a.level, b.level) < {d}"


def _around(spark, sf, depth, same_file):
    n = nodes(spark, sf)
    return graph.neighbourhood(n, relations(spark, sf), root_of(n), depth, same_file)


@query("graph_neighbourhood_nodes", with_views(_levels(2, _FREE) + "SELECT v2.id AS node_id, level, label, string_split(coalesce(name, ''), '#')[1] AS display_name FROM v2 JOIN nodes ON nodes.id = v2.id", "nodes", "relations"))
def graph_neighbourhood_nodes(spark, sf):
    return _around(spark, sf, 2, False).nodes.select("node_id", "level", "label", "display_name")


@query("graph_neighbourhood_edges", with_views(_levels(2, _FREE) + _INSIDE.format(d=2), "nodes", "relations"))
def graph_neighbourhood_edges(spark, sf):
    return _around(spark, sf, 2, False).edges.select(*_EDGE)


@query("graph_neighbourhood_depth3", with_views(_levels(3, _FREE) + "SELECT level, label, count(*) AS n FROM v3 JOIN nodes ON nodes.id = v3.id GROUP BY ALL", "nodes", "relations"))
def graph_neighbourhood_depth3(spark, sf):
    return _around(spark, sf, 3, False).nodes.groupBy("level", "label").agg(F.count("*").alias("n"))


@query("graph_neighbourhood_same_file", with_views(_levels(2, _SAME) + "SELECT v2.id AS node_id, level FROM v2", "nodes", "relations"))
def graph_neighbourhood_same_file(spark, sf):
    return _around(spark, sf, 2, True).nodes.select("node_id", "level")


@query("graph_stats_all_files", with_views(f"""
, roots AS (SELECT id AS root_id FROM nodes WHERE label = 'File'),
adj AS (SELECT from_id AS src, to_id AS dst FROM relations WHERE relation_type NOT IN {META} UNION SELECT to_id, from_id FROM relations WHERE relation_type NOT IN {META}),
near AS (SELECT DISTINCT root_id, n.id FROM roots JOIN adj ON adj.src = root_id JOIN nodes n ON n.id = adj.dst WHERE n.label NOT IN {NOISE} AND n.id <> root_id),
e AS (SELECT near.root_id, count(*) AS n FROM relations r JOIN near ON (r.from_id = near.root_id AND r.to_id = near.id) OR (r.to_id = near.root_id AND r.from_id = near.id) WHERE r.relation_type NOT IN {META} GROUP BY 1)
SELECT roots.root_id, 1 + count(near.id) AS total_nodes, coalesce(max(e.n), 0) AS total_edges FROM roots LEFT JOIN near ON near.root_id = roots.root_id LEFT JOIN e ON e.root_id = roots.root_id GROUP BY 1""", "nodes", "relations"))
def graph_stats_all_files(spark, sf):
    """Neighbourhoods of every file in one batch."""
    n = nodes(spark, sf)
    roots = n.filter(F.col("label") == "File").select("repo_name", F.col("id").alias("root_id"))
    return graph.neighbourhood(n, relations(spark, sf), roots, 1, same_file=False).stats().drop("repo_name")


@query("graph_callers", with_views("""
, r AS (SELECT to_id AS node_id, from_id AS caller_id, relation_type AS relation, step, row_number() OVER (PARTITION BY to_id ORDER BY relation_type, from_id, step) AS k
  FROM relations WHERE relation_type IN ('CALLS', 'IMPORTS'))
SELECT node_id, caller_id, relation, step FROM r WHERE k <= 50""", "relations"))
def graph_callers(spark, sf):
    """As the reference asks: 50 of each node."""
    return graph.callers(relations(spark, sf), limit=50).drop("repo_name")


@query("graph_callers_all", with_views("""
SELECT to_id AS node_id, from_id AS caller_id, relation_type AS relation, step FROM relations WHERE relation_type IN ('CALLS', 'IMPORTS')""", "relations"))
def graph_callers_all(spark, sf):
    return graph.callers(relations(spark, sf)).drop("repo_name")


@query("graph_callees", with_views("""
, r AS (SELECT from_id AS node_id, to_id AS callee_id, relation_type AS relation, step, row_number() OVER (PARTITION BY from_id ORDER BY relation_type, to_id, step) AS k
  FROM relations WHERE relation_type IN ('CALLS', 'IMPORTS') AND from_id IN (SELECT id FROM nodes WHERE file_path = 'sup/n1.py'))
SELECT node_id, callee_id, relation, step FROM r WHERE k <= 50""", "nodes", "relations"))
def graph_callees(spark, sf):
    ids = nodes(spark, sf).filter(F.col("file_path") == "sup/n1.py").select("repo_name", F.col("id").alias("node_id"))
    return graph.callees(relations(spark, sf), ids, limit=50).drop("repo_name")


@query("graph_callees_all", with_views("""
SELECT from_id AS node_id, to_id AS callee_id, relation_type AS relation, step FROM relations WHERE relation_type IN ('CALLS', 'IMPORTS') AND from_id IN (SELECT id FROM nodes)""", "nodes", "relations"))
def graph_callees_all(spark, sf):
    ids = nodes(spark, sf).select("repo_name", F.col("id").alias("node_id"))
    return graph.callees(relations(spark, sf), ids).drop("repo_name")


@query("impact_radius", with_views("""
, calls AS (SELECT to_id AS node_id, from_id AS caller_id, count(*) AS edges FROM relations WHERE relation_type = 'CALLS' GROUP BY ALL),
totals AS (SELECT node_id, sum(edges)::BIGINT AS call_edges, count(*) AS distinct_callers FROM calls GROUP BY node_id)
SELECT node_id, caller_id, edges, call_edges, distinct_callers FROM calls JOIN totals USING (node_id)
UNION ALL SELECT id, NULL, 0, 0, 0 FROM nodes WHERE id NOT IN (SELECT node_id FROM totals)""", "nodes", "relations"))
def impact_radius(spark, sf):
    """Every caller of every node, and the nodes without one."""
    return graph.impact_radius(relations(spark, sf), nodes(spark, sf)).drop("repo_name")


def _paths_sql(depth: int, extra: str = "") -> str:
    return f"""
, target AS (SELECT id FROM nodes WHERE id = {ROOT_SQL}),
calls AS (SELECT from_id, to_id FROM relations WHERE relation_type IN ('CALLS', 'DATA_DEPENDS_ON'){extra}),
paths AS (SELECT from_id AS node, 1 AS depth, [to_id, from_id] AS path FROM calls WHERE to_id = (SELECT id FROM target)
  UNION ALL SELECT c.from_id, depth + 1, list_append(path, c.from_id) FROM paths JOIN calls c ON c.to_id = paths.node WHERE depth < {depth} AND NOT list_contains(path, c.from_id))"""


_PATH_OUT = "SELECT depth, array_to_string(list_reverse(path), ' -> ') AS call_path FROM paths"


def _targets(n):
    return root_of(n).withColumnRenamed("root_id", "target_id")


@query("call_paths", with_views(_paths_sql(3) + _PATH_OUT, "nodes", "relations", recursive=True))
def call_paths(spark, sf):
    n = nodes(spark, sf)
    return graph.call_paths(relations(spark, sf), _targets(n), 3, top=None).select("depth", "call_path")


@query("call_paths_top", with_views(_paths_sql(3) + _PATH_OUT + " ORDER BY depth DESC, array_to_string(path, chr(1)) LIMIT 10", "nodes", "relations", recursive=True))
def call_paths_top(spark, sf):
    n = nodes(spark, sf)
    return graph.call_paths(relations(spark, sf), _targets(n), 3).select("depth", "call_path")


@query("call_paths_top_all", with_views("""
, calls AS (SELECT from_id, to_id FROM relations WHERE relation_type IN ('CALLS', 'DATA_DEPENDS_ON')),
paths AS (SELECT to_id AS target_id, from_id AS node, 1 AS depth, [to_id, from_id] AS path FROM calls
  UNION ALL SELECT target_id, c.from_id, depth + 1, list_append(path, c.from_id) FROM paths JOIN calls c ON c.to_id = paths.node WHERE depth < 10 AND NOT list_contains(path, c.from_id)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY depth DESC, array_to_string(path, chr(1))) AS rank FROM paths)
SELECT target_id, depth, array_to_string(list_reverse(path), ' -> ') AS call_path, rank::INTEGER AS rank FROM ranked WHERE rank <= 10""", "nodes", "relations", recursive=True))
def call_paths_top_all(spark, sf):
    """The ten deepest paths, up to ten calls deep, into every node."""
    targets = nodes(spark, sf).select("repo_name", F.col("id").alias("target_id"))
    return graph.call_paths(relations(spark, sf), targets, 10).select("target_id", "depth", "call_path", F.col("rank").cast("int").alias("rank"))


_FIRST_ORDER = f"(SELECT min(from_id) FROM relations WHERE to_id = {ROOT_SQL} AND relation_type = 'CALLS')"


@query("call_paths_excluding", with_views(_paths_sql(3, " AND from_id NOT LIKE 'File:%' AND to_id NOT LIKE 'File:%'") + _PATH_OUT, "nodes", "relations", recursive=True))
def call_paths_excluding(spark, sf):
    """Paths that avoid every file node."""
    n = nodes(spark, sf)
    banned = [f"File:ord/p{i}.py" for i in range(1, 6)] + [f"File:seg/{s}.py" for s in (
        "automobile", "building", "furniture", "household", "machinery")]
    return graph.call_paths(relations(spark, sf), _targets(n), 3, banned, top=None).select("depth", "call_path")


@query("path_contents", with_views(_paths_sql(2) + """, ids AS (SELECT DISTINCT unnest(path) AS id FROM paths)
SELECT ids.id, chr(10) || '--- Node: ' || ids.id || ' ---' || chr(10) || coalesce(name, 'None') || chr(10) AS block FROM ids JOIN nodes ON nodes.id = ids.id""", "nodes", "relations", recursive=True))
def path_contents(spark, sf):
    n = nodes(spark, sf)
    paths = graph.call_paths(relations(spark, sf), _targets(n), 2, top=None)
    return graph.path_contents(n.withColumn("content", F.col("name")), paths).select("id", "block")


@query("forward_chains", with_views("""
, s AS (SELECT id AS start_id, name FROM nodes WHERE file_path = 'brand/brand7.py' AND label = 'Method'),
calls AS (SELECT DISTINCT from_id, to_id, coalesce(name, to_id) AS to_name FROM relations LEFT JOIN nodes ON nodes.id = to_id WHERE relation_type = 'CALLS' AND from_id <> to_id),
l1 AS (SELECT start_id, name || ' -> ' || to_name AS c, min(to_id) AS node FROM s JOIN calls ON from_id = start_id GROUP BY ALL),
l2 AS (SELECT start_id, c || ' -> ' || to_name AS c, min(to_id) AS node FROM l1 JOIN calls ON from_id = node GROUP BY ALL),
ends AS (SELECT start_id, c, 2 AS length FROM l1 WHERE node NOT IN (SELECT from_id FROM calls) UNION ALL SELECT start_id, c, 3 FROM l2 WHERE node NOT IN (SELECT from_id FROM calls))
SELECT start_id, c AS chain_text, length FROM ends""", "nodes", "relations"))
def forward_chains(spark, sf):
    n = nodes(spark, sf)
    starts = n.filter((F.col("file_path") == "brand/brand7.py") & (F.col("label") == "Method")).select("repo_name", F.col("id").alias("start_id"))
    return graph.forward_chains(relations(spark, sf), n, starts, 4).drop("repo_name")


@query("process_members", with_views("""
SELECT nodes.id AS group_id, nodes.name AS group_name, from_id AS member_id, step FROM nodes LEFT JOIN relations ON to_id = nodes.id AND relation_type = 'STEP_IN_PROCESS' WHERE label = 'Process'""", "nodes", "relations"))
def process_members(spark, sf):
    return graph.group_members(nodes(spark, sf), relations(spark, sf)).drop("repo_name")


@query("cluster_sizes", with_views("""
SELECT nodes.id AS group_id, nodes.name AS group_name, count(from_id) AS members, arg_min(from_id, from_id) AS first_member FROM nodes
LEFT JOIN relations ON to_id = nodes.id AND relation_type = 'MEMBER_OF' WHERE label = 'Community' GROUP BY ALL""", "nodes", "relations"))
def cluster_sizes(spark, sf):
    return graph.group_sizes(nodes(spark, sf), relations(spark, sf), "Community", "MEMBER_OF").drop("repo_name")


# --- impact -----------------------------------------------------------------------------------
_FILE_ROOT = ", root AS (SELECT id, file_path AS root_path FROM nodes WHERE id = 'File:ord/p1.py')"
_FILE_LEVELS = _levels(1, _FREE).replace(f", root AS (SELECT id, file_path AS root_path FROM nodes WHERE id = {ROOT_SQL})", _FILE_ROOT)
_IMPACT = _FILE_LEVELS + f"""
, e AS ({_INSIDE.format(d=1)}),
f AS (SELECT e.*, CASE WHEN regexp_matches(from_id, '^(File|Function|Class|Method):') THEN string_split(from_id, ':')[2] ELSE '' END AS sf,
  CASE WHEN regexp_matches(to_id, '^(File|Function|Class|Method):') THEN string_split(to_id, ':')[2] ELSE '' END AS tf, 'ord/p1.py' AS rf FROM e),
x AS (SELECT 'defined_symbol' AS role, * FROM f WHERE relation_type IN ('DEFINES', 'HAS_METHOD') AND sf = rf AND tf = rf
  UNION ALL SELECT 'entrypoint', * FROM f WHERE relation_type = 'CALLS' AND from_id = 'File:' || rf
  UNION ALL SELECT 'internal_call', * FROM f WHERE relation_type = 'CALLS' AND sf = rf AND tf = rf AND from_id NOT LIKE 'File:%'
  UNION ALL SELECT 'cross_file', * FROM f WHERE sf <> '' AND tf <> '' AND sf <> tf
  UNION ALL SELECT 'upstream', * FROM f WHERE sf <> '' AND tf <> '' AND sf <> tf AND tf = rf
  UNION ALL SELECT 'downstream', * FROM f WHERE sf <> '' AND tf <> '' AND sf <> tf AND sf = rf)"""


def _file_impact(spark, sf):
    n = nodes(spark, sf)
    roots = n.filter(F.col("id") == "File:ord/p1.py").select("repo_name", F.col("id").alias("root_id"))
    return impact.impact_edges(graph.neighbourhood(n, relations(spark, sf), roots, 1, same_file=False))


@query("impact_context", with_views(_IMPACT + """
, d AS (SELECT id, label || ':' || coalesce(file_path, '') || ':' || string_split(name, '#')[1] AS shown FROM nodes)
SELECT role, a.shown AS source, b.shown AS target, sf AS source_file, tf AS target_file, relation_type AS relation FROM x JOIN d a ON a.id = from_id JOIN d b ON b.id = to_id""", "nodes", "relations"))
def impact_context(spark, sf):
    return _file_impact(spark, sf).drop("repo_name", "root_id", "root_file")


_ALL_IMPACT = f"""
, edges AS (SELECT * FROM relations WHERE relation_type NOT IN {META}),
around AS (SELECT n.id AS root_id, n.file_path AS rf, e.from_id, e.to_id, e.relation_type, e.step FROM nodes n JOIN edges e ON e.from_id = n.id JOIN nodes o ON o.id = e.to_id AND o.label NOT IN {NOISE} WHERE n.label = 'Class'
  UNION ALL SELECT n.id, n.file_path, e.from_id, e.to_id, e.relation_type, e.step FROM nodes n JOIN edges e ON e.to_id = n.id AND e.from_id <> e.to_id JOIN nodes o ON o.id = e.from_id AND o.label NOT IN {NOISE} WHERE n.label = 'Class'),
f AS (SELECT *, string_split(from_id, ':')[2] AS sf, string_split(to_id, ':')[2] AS tf FROM around),
c AS (SELECT root_id, count(DISTINCT CASE WHEN relation_type IN ('DEFINES', 'HAS_METHOD') AND sf = rf AND tf = rf THEN to_id END) AS defined_symbols,
  count(DISTINCT CASE WHEN relation_type = 'CALLS' AND from_id = 'File:' || rf THEN to_id END) AS entrypoints,
  count(*) FILTER (relation_type = 'CALLS' AND sf = rf AND tf = rf AND from_id NOT LIKE 'File:%') AS internal_calls,
  count(*) FILTER (sf <> tf) AS cross_files, count(*) FILTER (sf <> tf AND tf = rf) AS upstreams, count(*) FILTER (sf <> tf AND sf = rf) AS downstreams,
  len(list_distinct(list_concat(coalesce(list(DISTINCT CASE WHEN sf <> tf AND sf <> rf THEN sf END) FILTER (sf <> tf AND sf <> rf), []), coalesce(list(DISTINCT CASE WHEN sf <> tf AND tf <> rf THEN tf END) FILTER (sf <> tf AND tf <> rf), [])))) AS related_files
  FROM f GROUP BY root_id)
SELECT * FROM c WHERE defined_symbols + entrypoints + internal_calls + cross_files > 0"""


@query("impact_context_counts", with_views(_ALL_IMPACT, "nodes", "relations"))
def impact_context_counts(spark, sf):
    """Impact counters of every class in one batch."""
    n = nodes(spark, sf)
    roots = n.filter(F.col("label") == "Class").select("repo_name", F.col("id").alias("root_id"))
    found = graph.neighbourhood(n, relations(spark, sf), roots, 1, same_file=False)
    return impact.impact_counts(impact.impact_edges(found)).drop("repo_name")


@query("render_contexts", with_views(f"""
, edges AS (SELECT * FROM relations WHERE relation_type NOT IN {META}),
roots AS (SELECT * FROM nodes WHERE label = 'Class'),
around AS (SELECT DISTINCT r.id AS root_id, o.* FROM roots r JOIN edges e ON e.from_id = r.id OR e.to_id = r.id JOIN nodes o ON (o.id = e.to_id OR o.id = e.from_id) AND o.id <> r.id WHERE o.label NOT IN {NOISE}),
members AS (SELECT id AS root_id, 0 AS level, * FROM roots UNION ALL SELECT root_id, 1, * EXCLUDE (root_id) FROM around),
sym AS (SELECT root_id, string_agg('- [' || label || '] `' || name || '` (lines ' || start_line || '-' || end_line || ')', chr(10) ORDER BY level, label, name, id) AS t FROM members WHERE label <> 'File' GROUP BY root_id),
rel AS (SELECT r.id AS root_id, string_agg('- ' || from_id || ' --[' || relation_type || ']--> ' || to_id, chr(10) ORDER BY relation_type, from_id, to_id, step::VARCHAR) AS t FROM roots r JOIN edges e ON e.from_id = r.id OR e.to_id = r.id GROUP BY r.id)
, full_ AS (SELECT r.id AS root_id, '## File: ' || file_path || chr(10) || '## Symbols:' || chr(10) || sym.t || coalesce(chr(10) || chr(10) || '## Relations:' || chr(10) || rel.t, '') AS c FROM roots r JOIN sym ON sym.root_id = r.id LEFT JOIN rel ON rel.root_id = r.id)
SELECT root_id, length(c) > 2000 AS cut, md5(CASE WHEN length(c) <= 2000 THEN c ELSE left(c, 1000) || chr(10) || chr(10) || '... [TRUNCATED: middle omitted to fit LLM context] ...' || chr(10) || chr(10) || right(c, 1000) END) AS context_md5 FROM full_""", "nodes", "relations"))
def render_contexts(spark, sf):
    """Rendered neighbourhood of every class."""
    n = nodes(spark, sf)
    roots = n.filter(F.col("label") == "Class").select("repo_name", F.col("id").alias("root_id"))
    found = graph.neighbourhood(n, relations(spark, sf), roots, 1, same_file=False)
    out = impact.render_context(found, 2000)
    return out.select("root_id", (F.length("context") > 2000).alias("cut"), F.md5("context").alias("context_md5"))


@query("bfs_context_rank", with_views(f"""
, adj AS (SELECT from_id AS src, to_id AS dst FROM relations WHERE relation_type NOT IN {META} UNION SELECT to_id, from_id FROM relations WHERE relation_type NOT IN {META}),
starts AS (SELECT id AS candidate_id FROM nodes WHERE label = 'Class'),
l1 AS (SELECT candidate_id, dst, row_number() OVER (PARTITION BY candidate_id ORDER BY dst) AS p FROM starts JOIN (SELECT DISTINCT src, dst FROM adj) ON src = candidate_id WHERE dst <> candidate_id),
k1 AS (SELECT * FROM l1 WHERE p < 8),
c2 AS (SELECT k1.candidate_id, a.dst, min(k1.p) AS parent FROM k1 JOIN adj a ON a.src = k1.dst WHERE a.dst <> k1.candidate_id AND NOT EXISTS (SELECT 1 FROM k1 q WHERE q.candidate_id = k1.candidate_id AND q.dst = a.dst) GROUP BY ALL),
l2 AS (SELECT candidate_id, dst, (SELECT count(*) FROM k1 q WHERE q.candidate_id = c2.candidate_id) + row_number() OVER (PARTITION BY candidate_id ORDER BY parent, dst) AS p FROM c2)
SELECT candidate_id, candidate_id AS node_id, 0 AS distance, 0 AS position FROM starts
UNION ALL SELECT candidate_id, dst, 1, p::INTEGER FROM k1 UNION ALL SELECT candidate_id, dst, 2, p::INTEGER FROM l2 WHERE p < 8""", "nodes", "relations"))
def bfs_context_rank(spark, sf):
    """Breadth-first context of every class."""
    links = graph.exclude_meta_relations(relations(spark, sf)).select(F.col("repo_name").alias("repo"), F.col("from_id").alias("src"), F.col("to_id").alias("dst"))
    both = links.unionByName(links.select("repo", F.col("dst").alias("src"), F.col("src").alias("dst")))
    starts = nodes(spark, sf).filter(F.col("label") == "Class").select(
        F.col("id").alias("candidate_id"), F.col("repo_name").alias("repo"), F.col("id").alias("function_id"))
    return retrieval.bfs_context(both, starts, 2, 8).drop("repo")


@query("node_content", with_views(f"SELECT id, name AS content FROM nodes WHERE id = {ROOT_SQL}", "nodes"))
def node_content(spark, sf):
    n = nodes(spark, sf)
    wanted = root_of(n).select(F.col("root_id").alias("id"), "repo_name")
    return graph.nodes_by_ids(n, wanted).select("id", F.col("name").alias("content"))


@query("list_repos", """
SELECT user_id AS repo_name, max(ts) AS started_at, arg_max(event_type, (ts, event_type, value)) AS source, arg_max(value, (ts, event_type, value)) AS stats FROM events GROUP BY user_id""")
def list_repos(spark, sf):
    runs = table(spark, sf, "events").select(
        F.col("user_id").alias("repo_name"), F.col("ts").alias("started_at"), F.col("event_type").alias("source"), F.col("value").alias("stats"))
    return graph_json.list_repos(runs)
