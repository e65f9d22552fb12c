"""Finding filters, ranking, routing, synchronisation and resumable work."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkwarden.functions import fixed_values as fv
from sparkwarden.harness.registry import query
from sparkwarden.harness.text_queries import quote
from sparkwarden.harness.views import hits, items, model_hits, nodes, relations, table, with_views
from sparkwarden.operators import findings
from sparkwarden.sources import graph_json, sinks


@query("important_rules", with_views("SELECT category, severity, rule_id, important, count(*) AS n FROM kept_hits GROUP BY ALL", "kept_hits"))
def important_rules(spark, sf):
    h = hits(spark, sf).withColumn("important", findings.is_important_rule("severity", "category", "rule_id"))
    return h.groupBy("category", "severity", "rule_id", "important").agg(F.count("*").alias("n"))


@query("high_priority_items", with_views("SELECT layer, seq, coalesce(high, TRUE) AS high FROM item_rows", "item_rows"))
def high_priority_items(spark, sf):
    high = findings.is_high_priority(F.lit(None).cast("string"), "findings", F.col("result").isNotNull())
    return items(spark, sf).select("layer", "seq", high.alias("high"))


@query("filter_findings", with_views("""
SELECT l_orderkey AS seq, count(*) AS kept, max(rank) AS top_rank, max(rank) AS first_rank FROM kept_hits WHERE important GROUP BY l_orderkey""", "kept_hits"))
def filter_findings(spark, sf):
    kept = items(spark, sf).filter(F.col("layer") == 1).withColumn("f", findings.filter_findings("findings"))
    ranks = F.transform("f", lambda f: findings.severity_rank(f["rules"][0]["severity"]))
    return kept.filter(F.size("f") > 0).select("seq", F.size("f").cast("long").alias("kept"), F.array_max(ranks).alias("top_rank"), ranks[0].alias("first_rank"))


_IGNORED = "(regexp_matches(p, '(^|/)(node_modules|vendor|fixtures|__pycache__|.venv|venv|dist|build|coverage|.git)(/|$)') OR " + " OR ".join(
    f"contains(p, {quote(f)})" for f in fv.IGNORED_FRAGMENTS) + ")"


@query("rank_files", with_views(f"""
, r AS (SELECT file_path, max(rank) AS file_rank, count(DISTINCT line) AS l1, 0 AS l2 FROM kept_hits WHERE important GROUP BY file_path
  UNION ALL SELECT string_split(file_path, ':')[2], 2, 0, count(*) FROM model_hits GROUP BY 1)
SELECT file_path, max(file_rank)::INTEGER AS file_rank, sum(l1)::BIGINT AS layer1_findings, sum(l2)::BIGINT AS layer2_items FROM (SELECT *, lower(file_path) AS p FROM r) WHERE NOT {_IGNORED}
GROUP BY file_path ORDER BY file_rank DESC, file_path LIMIT 30""", "kept_hits", "model_hits"))
def rank_files(spark, sf):
    return findings.rank_files(hits(spark, sf), model_hits(spark, sf), 30)


@query("filter_stats", with_views(f"""
, i AS (SELECT *, lower(CASE WHEN layer = 1 THEN file_path ELSE string_split(file_path, ':')[2] END) AS p FROM item_rows),
j AS (SELECT *, {_IGNORED} AS ign FROM i)
SELECT count(*) AS input_items, count(*) FILTER (p <> '' AND ign) AS ignored_path_items, count(*) FILTER (layer = 1 AND p <> '' AND NOT ign AND kept = 0) AS dropped_low_value_layer1_items,
  coalesce(sum(kept) FILTER (layer = 1 AND p <> '' AND NOT ign), 0)::BIGINT AS layer1_findings_kept, count(*) FILTER (layer = 2 AND NOT ign) AS layer2_items_kept,
  count(DISTINCT p) FILTER (p <> '' AND NOT ign AND (layer = 2 OR kept > 0)) AS files_before_cap, least(30, count(DISTINCT p) FILTER (p <> '' AND NOT ign AND (layer = 2 OR kept > 0))) AS files_after_cap,
  30::BIGINT AS max_repository_files FROM j""", "item_rows"))
def filter_stats(spark, sf):
    return findings.filter_stats(items(spark, sf), 30)


_NODE_ID = "CASE WHEN file_path = '' THEN '' WHEN layer = 2 THEN 'File:' || string_split(file_path, ':')[2] ELSE 'File:' || file_path END"


@query("dedup_first_by_node", with_views(f"""
, n AS (SELECT *, {_NODE_ID} AS node_id FROM item_rows), r AS (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY layer, seq) AS k FROM n)
SELECT node_id, layer, seq FROM r WHERE k = 1 OR node_id = ''""", "item_rows"))
def dedup_first_by_node(spark, sf):
    return findings.dedup_by_node(items(spark, sf)).select("node_id", "layer", "seq")


_ROUTED = f"""
, n AS (SELECT *, {_NODE_ID} AS node_id FROM item_rows), r AS (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY layer, seq) AS k FROM n),
d AS (SELECT *, lower(replace(node_id, 'File:', '')) AS p FROM r WHERE k = 1 OR node_id = ''),
routed AS (SELECT *, CASE WHEN node_id = '' THEN 'no_node' WHEN {_IGNORED} THEN 'skipped_path' WHEN NOT coalesce(high, TRUE) THEN 'skipped_low' ELSE 'job' END AS route FROM d)"""


@query("route_findings", with_views(_ROUTED + "SELECT route, layer, count(*) AS n FROM routed GROUP BY ALL", "item_rows"))
def route_findings(spark, sf):
    return findings.route_findings(findings.dedup_by_node(items(spark, sf))).groupBy("route", "layer").agg(F.count("*").alias("n"))


@query("skipped_rows", with_views(_ROUTED + """
SELECT node_id, replace(node_id, 'File:', '') AS file_path, 'SKIPPED' AS selected_cwe_id, 'Low' AS severity, route,
  CASE route WHEN 'skipped_path' THEN 'Ignored benchmark/non-application path' WHEN 'skipped_low' THEN 'Low-priority finding skipped' ELSE 'Cannot infer graph node_id from scan result.' END AS selected_cwe_name
FROM routed WHERE route <> 'job'""", "item_rows"))
def skipped_rows(spark, sf):
    return findings.skipped_rows(findings.route_findings(findings.dedup_by_node(items(spark, sf))))


@query("attach_rule_findings", with_views("""
, f AS (SELECT file_path, count(*) AS n FROM hits GROUP BY file_path)
SELECT m.o_orderkey, coalesce(f.n, 0) AS attached FROM model_hits m LEFT JOIN f ON f.file_path = string_split(m.file_path, ':')[2]""", "hits", "model_hits"))
def attach_rule_findings(spark, sf):
    """Layer-2 items beside the rule findings of their file (here their number)."""
    per_file = hits(spark, sf).groupBy("file_path").agg(F.count("*").alias("findings"))
    return findings.attach_rule_findings(model_hits(spark, sf), per_file).select(
        "o_orderkey", F.coalesce("layer1_findings", F.lit(0)).alias("attached"))


_TWO = "(VALUES ('a'), ('b')) AS two(repo)"


def _in_two(df):
    """The same rows in two repositories, which so share every path."""
    return df.withColumn("repo", F.explode(F.array(F.lit("a"), F.lit("b"))))


@query("dedup_two_repos", with_views(f"""
, n AS (SELECT *, {_NODE_ID} AS node_id FROM item_rows CROSS JOIN {_TWO}), r AS (SELECT *, row_number() OVER (PARTITION BY repo, node_id ORDER BY layer, seq) AS k FROM n)
SELECT repo, node_id, layer, seq FROM r WHERE k = 1 OR node_id = ''""", "item_rows"))
def dedup_two_repos(spark, sf):
    return findings.dedup_by_node(_in_two(items(spark, sf))).select("repo", "node_id", "layer", "seq")


@query("rank_files_two_repos", with_views(f"""
, r AS (SELECT file_path, max(rank) AS file_rank, count(DISTINCT line) AS l1, 0 AS l2 FROM kept_hits WHERE important GROUP BY file_path
  UNION ALL SELECT string_split(file_path, ':')[2], 2, 0, count(*) FROM model_hits GROUP BY 1)
SELECT repo, file_path, max(file_rank)::INTEGER AS file_rank, sum(l1)::BIGINT AS layer1_findings, sum(l2)::BIGINT AS layer2_items FROM (SELECT *, lower(file_path) AS p FROM r) CROSS JOIN {_TWO} WHERE NOT {_IGNORED}
GROUP BY repo, file_path""", "kept_hits", "model_hits"))
def rank_files_two_repos(spark, sf):
    return findings.rank_files(_in_two(hits(spark, sf).drop("repo")), _in_two(model_hits(spark, sf).drop("repo")))


@query("attach_two_repos", with_views(f"""
, f AS (SELECT repo, file_path, count(*) AS n FROM hits CROSS JOIN {_TWO} WHERE repo = 'a' GROUP BY ALL)
SELECT m.o_orderkey, two.repo, coalesce(f.n, 0) AS attached FROM model_hits m CROSS JOIN {_TWO} LEFT JOIN f ON f.file_path = string_split(m.file_path, ':')[2] AND f.repo = two.repo""", "hits", "model_hits"))
def attach_two_repos(spark, sf):
    """Findings of one repository do not reach the same path of another."""
    per_file = hits(spark, sf).groupBy("file_path").agg(F.count("*").alias("findings")).withColumn("repo", F.lit("a"))
    return findings.attach_rule_findings(_in_two(model_hits(spark, sf).drop("repo")), per_file).select(
        "o_orderkey", "repo", F.coalesce("layer1_findings", F.lit(0)).alias("attached"))


@query("layer_counts", with_views("""
SELECT 'layer1_files' AS counter, count(*) FILTER (layer = 1) AS n FROM item_rows UNION ALL SELECT 'layer1_findings', sum(n)::BIGINT FROM item_rows
UNION ALL SELECT 'layer2_items', count(*) FILTER (layer = 2) FROM item_rows UNION ALL SELECT 'layer3_jobs', count(*) FROM item_rows WHERE file_path <> ''""", "item_rows"))
def layer_counts(spark, sf):
    all_items = items(spark, sf)
    return findings.layer_counts(all_items.filter(F.col("layer") == 1), all_items.filter(F.col("layer") == 2),
                                 all_items.filter(F.col("file_path") != ""))


@query("issue_index", with_views("SELECT CASE WHEN file_path LIKE 'Function:%' THEN 'function' END AS kind, count(*) AS n FROM item_rows WHERE file_path LIKE 'Function:%' GROUP BY 1", "item_rows"))
def issue_index(spark, sf):
    return findings.issue_index(items(spark, sf)).groupBy("kind").agg(F.count("*").alias("n"))


@query("combine_layers", with_views("SELECT coalesce(rule_id, 'none') AS rule_id, count(*) AS n, count(o_orderkey) AS model FROM (SELECT rule_id, NULL AS o_orderkey FROM hits UNION ALL SELECT NULL, o_orderkey FROM model_hits) GROUP BY 1", "hits", "model_hits"))
def combine_layers(spark, sf):
    return findings.combine_layers(hits(spark, sf), model_hits(spark, sf)).groupBy(
        F.coalesce("rule_id", F.lit("none")).alias("rule_id")).agg(F.count("*").alias("n"), F.count("o_orderkey").alias("model"))


def _dictionary(spark, sf):
    """Parts as a weakness dictionary: id from the key, name from the part."""
    return table(spark, sf, "part").select(F.concat(F.lit("CWE-"), F.col("p_partkey").cast("string")).alias("cwe_id"), F.col("p_name").alias("cwe_name"))


_CATEGORY_LISTS = ", ".join(f"({quote(k)}, [{', '.join(quote(c) for c in v)}])" for k, v in fv.CWE_CANDIDATES_BY_CATEGORY.items())


@query("cwe_candidates", with_views(f"""
, lists(category, own) AS (VALUES {_CATEGORY_LISTS}), cats AS (SELECT DISTINCT category FROM hits),
e AS (SELECT cats.category, unnest(list_concat(coalesce(own, []), [{', '.join(quote(c) for c in fv.DEFAULT_CWES)}])) AS cwe_id, generate_subscripts(list_concat(coalesce(own, []), [{', '.join(quote(c) for c in fv.DEFAULT_CWES)}]), 1) AS pos FROM cats LEFT JOIN lists ON lists.category = cats.category),
f AS (SELECT category, cwe_id, min(pos) AS pos FROM e GROUP BY ALL),
k AS (SELECT category, cwe_id, p_name AS cwe_name, row_number() OVER (PARTITION BY category ORDER BY pos) AS rank FROM f JOIN part ON 'CWE-' || p_partkey = cwe_id)
SELECT category, rank::INTEGER AS rank, cwe_id, cwe_name FROM k WHERE rank <= 16""", "hits"))
def cwe_candidates(spark, sf):
    return findings.cwe_candidates(spark, hits(spark, sf), _dictionary(spark, sf))


_KEYS = "[" + ", ".join(quote(k) for k in fv.CWE_PREFILTER_KEYWORDS) + "]"


_PREFILTER_SQL = f"""
WITH d AS (SELECT 'CWE-' || r_regionkey AS cwe_id, lower(r_name) || ' ' || (['sql', 'path', 'auth', 'command', 'plain'])[r_regionkey + 1] AS cwe_name FROM region),
e AS (SELECT o_orderkey AS evidence_id, lower('order cwe-' || (o_custkey % 7) || ' ' || (['sql', 'path', 'secret', 'none'])[o_orderkey % 4 + 1] || ' ' || o_orderpriority) AS t FROM orders),
j AS (SELECT evidence_id, cwe_id, cwe_name, (contains(t, lower(cwe_id)) OR len(list_filter({_KEYS}, lambda k: contains(t, k) AND contains(lower(cwe_name), k))) > 0) AS hit FROM e CROSS JOIN d),
c AS (SELECT *, count(*) FILTER (hit) OVER (PARTITION BY evidence_id) AS n FROM j)"""


@query("cwe_prefilter", _PREFILTER_SQL + """
SELECT DISTINCT e.evidence_id, c.cwe_id, c.cwe_name, coalesce(c.n, 0) < 3 AS whole_dictionary FROM e LEFT JOIN (SELECT * FROM c WHERE hit) c ON c.evidence_id = e.evidence_id""")
def cwe_prefilter(spark, sf):
    return findings.prefilter_cwe(*_evidence(spark, sf))


def _evidence(spark, sf):
    """Orders as evidence, regions as dictionary."""
    hint = F.element_at(F.array(*[F.lit(x) for x in ("sql", "path", "auth", "command", "plain")]), F.col("r_regionkey") + 1)
    d = table(spark, sf, "region").select(F.concat(F.lit("CWE-"), F.col("r_regionkey").cast("string")).alias("cwe_id"),
                                          F.concat_ws(" ", F.lower("r_name"), hint).alias("cwe_name"))
    word = F.element_at(F.array(*[F.lit(x) for x in ("sql", "path", "secret", "none")]), (F.col("o_orderkey") % 4 + 1).cast("int"))
    e = table(spark, sf, "orders").select(F.col("o_orderkey").alias("evidence_id"), F.concat(
        F.lit("order CWE-"), (F.col("o_custkey") % 7).cast("string"), F.lit(" "), word, F.lit(" "), "o_orderpriority").alias("evidence"))
    return e, d


@query("weakness_sets", _PREFILTER_SQL + """
, k AS (SELECT evidence_id, cwe_id, cwe_name, row_number() OVER (PARTITION BY evidence_id ORDER BY cwe_id) AS rank FROM c WHERE hit OR n < 3)
SELECT evidence_id, cwe_id, cwe_name, rank::INTEGER AS rank FROM k WHERE rank <= 4""")
def weakness_sets(spark, sf):
    """The first four candidates of every evidence, put together from links and sets."""
    links, sets = findings.weakness_sets(*_evidence(spark, sf), limit=4)
    return links.join(sets, "set_id").select("evidence_id", "cwe_id", "cwe_name", F.col("rank").cast("int").alias("rank"))


# --- synchronisation --------------------------------------------------------------------------

@query("upsert_snapshot", """
WITH t AS (SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey % 3 <> 0),
s AS (SELECT c_custkey, c_name || '!' AS c_name, c_acctbal, 1 AS seq FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, c_name || '?', c_acctbal + 1, 2 FROM customer WHERE c_custkey % 4 = 0),
l AS (SELECT * EXCLUDE (seq, k) FROM (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY seq DESC) AS k FROM s) WHERE k = 1)
SELECT * FROM l UNION ALL SELECT * FROM t WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.c_custkey = t.c_custkey)""")
def upsert_snapshot(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal")
    first = c.filter(F.col("c_custkey") % 2 == 0).withColumn("c_name", F.concat("c_name", F.lit("!"))).withColumn("seq", F.lit(1))
    second = c.filter(F.col("c_custkey") % 4 == 0).withColumn("c_name", F.concat("c_name", F.lit("?"))).withColumn(
        "c_acctbal", F.col("c_acctbal") + 1).withColumn("seq", F.lit(2))
    return sinks.upsert(c.filter(F.col("c_custkey") % 3 != 0), first.unionByName(second), ["c_custkey"], "seq")


@query("upsert_relations", with_views("""
, s AS (SELECT * REPLACE (confidence / 2 AS confidence) FROM relations WHERE relation_type = 'CALLS' AND step > 3)
SELECT relation_type, count(*) AS n, round(sum(confidence), 4) AS total FROM (SELECT * FROM s UNION ALL SELECT * FROM relations WHERE NOT (relation_type = 'CALLS' AND step > 3)) GROUP BY 1""", "relations"))
def upsert_relations(spark, sf):
    r = relations(spark, sf)
    changed = r.filter((F.col("relation_type") == "CALLS") & (F.col("step") > 3)).withColumn("confidence", F.col("confidence") / 2)
    merged = sinks.upsert_relations(r, changed.withColumn("seq", F.lit(1)))
    return merged.groupBy("relation_type").agg(F.count("*").alias("n"), F.round(F.sum("confidence"), 4).alias("total"))


@query("sync_counts", with_views("SELECT 'tpch' AS repo_name, (SELECT count(*) FROM nodes)::INTEGER AS stats_nodes, (SELECT count(*) FROM relations)::INTEGER AS stats_edges", "nodes", "relations"))
def sync_counts(spark, sf):
    g = graph_json.Graph(nodes(spark, sf), relations(spark, sf), nodes(spark, sf).limit(0))
    return graph_json.sync_meta(g, "tpch", F.to_timestamp(F.lit("2024-01-01"))).select("repo_name", "stats_nodes", "stats_edges")


@query("normalise_records", """
SELECT 'node' AS kind, count(*) FILTER (c_custkey % 5 <> 0 OR c_custkey % 2 = 0) AS kept, count(*) FILTER (c_custkey % 5 = 0 AND c_custkey % 2 <> 0) AS rejected FROM customer
UNION ALL SELECT 'relation', count(*) FILTER (o_orderkey % 9 <> 0), count(*) FILTER (o_orderkey % 9 = 0) FROM orders""")
def normalise_records(spark, sf):
    """Customers as raw node records and orders as raw relation records, some of them incomplete."""
    raw_nodes = table(spark, sf, "customer").select(
        F.when(F.col("c_custkey") % 5 != 0, F.concat(F.lit("Class:c"), F.col("c_custkey").cast("string"))).alias("id"),
        F.when(F.col("c_custkey") % 3 != 0, F.lit("Class")).alias("label"),
        F.map_from_arrays(F.array(F.lit("name"), F.lit("segment")), F.array(
            F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")), F.col("c_mktsegment"))).alias("properties"))
    raw_relations = table(spark, sf, "orders").select(
        F.when(F.col("o_orderkey") % 9 != 0, F.col("o_orderkey").cast("string")).alias("sourceId"), F.col("o_custkey").cast("string").alias("targetId"),
        F.lit("CALLS").alias("type"), F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("string").alias("reason"), F.lit(None).cast("int").alias("step"))
    g = graph_json.normalise(raw_nodes, raw_relations, "r")
    count = lambda df, kind, name: df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), F.lit(name).alias("what"), "n")
    bad = g.rejected.groupBy("kind").agg(F.count("*").alias("n")).select("kind", F.lit("rejected").alias("what"), "n")
    every = count(g.nodes, "node", "kept").unionByName(count(g.relations, "relation", "kept")).unionByName(bad)
    return every.groupBy("kind").agg(F.sum(F.when(F.col("what") == "kept", F.col("n"))).alias("kept"),
                                     F.sum(F.when(F.col("what") == "rejected", F.col("n"))).alias("rejected"))


@query("resume_pending", """
SELECT o_orderkey, 'P' || '|' || o_orderkey || '|' || o_custkey AS run_key FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')""")
def resume_pending(spark, sf):
    work = table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.lit("P").alias("stage")).withColumn(
        "run_key", sinks.run_key("stage", "o_orderkey", "o_custkey"))
    done = table(spark, sf, "lineitem").filter(F.col("l_returnflag") == "R").select(F.col("l_orderkey").alias("o_orderkey"))
    return sinks.pending(work, done, ["o_orderkey"]).select("o_orderkey", "run_key")


@query("cache_lookup", """
WITH k AS (SELECT o_orderkey, md5(o_orderstatus || '|' || o_orderpriority || o_custkey || o_orderkey || '|' || 'p') AS cache_key FROM orders),
c AS (SELECT k.cache_key, count(*) AS n FROM k JOIN lineitem ON l_orderkey = o_orderkey WHERE l_linenumber = 1 GROUP BY 1)
SELECT o_orderkey, k.cache_key, c.n FROM k LEFT JOIN c ON c.cache_key = k.cache_key""")
def cache_lookup(spark, sf):
    """Results by content key: hits carry the cached value, misses NULL."""
    work = table(spark, sf, "orders").withColumn("paths", F.lit("p")).withColumn("cache_key", sinks.cache_key(
        "o_orderstatus", "o_orderpriority", "o_custkey", "o_orderkey", "paths"))
    firsts = table(spark, sf, "lineitem").filter(F.col("l_linenumber") == 1).select(F.col("l_orderkey").alias("o_orderkey"))
    cache = work.join(firsts, "o_orderkey").groupBy("cache_key").agg(F.count("*").alias("n"))
    found, missing = sinks.split_cached(work.select("o_orderkey", "cache_key"), cache)
    return found.unionByName(missing, allowMissingColumns=True)
