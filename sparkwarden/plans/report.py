"""Composed jobs: from files, functions and a graph to findings, contexts and reports."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwarden.functions import fixed_values as fv
from sparkwarden.functions import masking
from sparkwarden.functions import paths as px
from sparkwarden.functions import text as tx
from sparkwarden.operators import code, evaluation, findings, graph, impact, retrieval, rules, scan, scoring
from sparkwarden.session import reliable_checkpoint
from sparkwarden.sources import sinks


class Analysis(NamedTuple):
    """``pending`` are jobs with their prompt input, ``results`` one row per node that needs no model: reused, skipped, failed."""

    pending: DataFrame
    results: DataFrame


class Report(NamedTuple):
    matches: DataFrame
    layer2: DataFrame
    routed: DataFrame
    reports: DataFrame


def scan_candidates(files: DataFrame, functions: DataFrame) -> DataFrame:
    """Labelled finding candidates of both rule packs.

    One row per (repo, path, line, rule, match); rows that cannot be
    labelled are dropped.  ``candidate_id`` is derived from that key, so it does not depend on how
    the rows are spread.
    """
    chosen = rules.rules_in(("core", "app"), rules.CANDIDATE_CATEGORIES)
    hits = scan.scan_rules(files, chosen, allow_ignores_case=True).withColumn(
        "matched_key", F.md5("matched_text"))
    key = ["repo", "file_path", "line", "rule_id", "matched_key"]
    first = hits.groupBy(*key).agg(F.min_by(
        F.struct("rule_seq", "match_seq", F.col("name").alias("rule_name"), "category", "matched_text"),
        F.struct("rule_seq", "match_seq")).alias("m")).select(*key, "m.*")
    # Written, because the place of a hit is found from its line and the scan would run once more for that.
    first = reliable_checkpoint(first.withColumn("point_id", F.md5(F.concat_ws("|", *key))))
    placed = evaluation.containing_function(first, functions)
    body = functions.select(F.col("node_id").alias("function_id"), F.col("content").alias("fn_content"))
    rich = placed.join(body, "function_id").join(files.select("repo", "file_path", "content"), ["repo", "file_path"])
    context = F.concat_ws("\n", "file_path", "fn_content", tx.line_window("content", "line", 8), "matched_text")
    labelled = rich.withColumn("o", evaluation.oracle_label("file_path", "rule_id", "category", context))
    return labelled.filter(F.col("o.label") != "UNKNOWN").select(
        F.concat_ws(":", "repo", F.substring("point_id", 1, 16)).alias("candidate_id"), "repo", "file_path",
        "line", "rule_id", "rule_name", "category", tx.shorten("matched_text").alias("matched_text"),
        "function_id", F.col("o.label").alias("oracle_label"), F.col("o.reason").alias("oracle_reason"))


def evaluate_contexts(candidates: DataFrame, contexts: dict[str, DataFrame]) -> DataFrame:
    """Metrics of each retrieval strategy; a context table has candidate_id, context, n_nodes.

    What the metrics need of a context (no text) is written, so each context is made and judged once.
    """
    rows = None
    for name, ctx in contexts.items():
        part = ctx.select("candidate_id", "context", "n_nodes").withColumn("strategy", F.lit(name))
        rows = part if rows is None else rows.unionByName(part)
    judged = (
        candidates.join(rows, "candidate_id")
        .withColumn("s", evaluation.signals("context", "matched_text", "category"))
        .select("strategy", "s", evaluation.predict_from_signals("category", "s").alias("predicted"), (F.col("oracle_label") == "TP").alias("actual"),
                F.length("context").alias("chars"), "n_nodes"))
    judged = reliable_checkpoint(judged)
    base = evaluation.confusion_metrics(judged, ["strategy"])
    actual = F.col("actual")
    share = lambda hit, of: F.bround(F.count_if(hit) / F.greatest(F.lit(1), F.count_if(of)) * 100, 1)
    extra = judged.groupBy("strategy").agg(
        share(actual & F.col("s.source") & F.col("s.sink"), actual).alias("tp_evidence_coverage"),
        share(~actual & F.col("s.safe"), ~actual).alias("fp_guard_coverage"),
        F.bround(F.avg("chars"), 1).alias("avg_context_chars"),
        F.bround(F.avg("n_nodes"), 1).alias("avg_nodes"))
    return base.join(extra, "strategy")


def evaluate_strategies(files: DataFrame, per_repo: int | None = None, depth: int = 2, max_nodes: int = 8) -> DataFrame:
    """The retrieval ablation: local, text, graph and evidence-ranked contexts side by side.

    Functions, candidates and links feed all four strategies, so each is written once; parsing the
    sources again for every use would dominate.  So is the breadth-first pool of the ranking, whose first nodes are the context of the
    graph traversal.  All candidates count, or the first ``per_repo`` of a repository (35 in the reference).
    """
    functions = reliable_checkpoint(code.build_functions(files))
    found = scan_candidates(files, functions)
    candidates = reliable_checkpoint(found if per_repo is None else evaluation.top_per_repo(found, per_repo))
    links = reliable_checkpoint(code.build_code_graph(functions, files))
    pool = reliable_checkpoint(retrieval.bfs_context(links, candidates, depth, retrieval.pool_size(max_nodes)))
    ranked = retrieval.rank_pool(pool, candidates, functions, max_nodes)
    return evaluate_contexts(candidates, {
        "Local function only": retrieval.local_context(candidates, functions, files),
        "Text-based retrieval": retrieval.join_contents(
            retrieval.text_context(candidates, functions, max_nodes), functions),
        "Graph traversal": retrieval.join_contents(
            pool.filter(F.col("position") < max_nodes), functions),
        "Evidence-ranked graph": retrieval.render_ranked_context(ranked, candidates, functions, files),
    })


def scan_report(files: DataFrame, functions: DataFrame, make_scorer=scoring.linear_scorer) -> Report:
    """Rule hits and model hits, routed, and flattened to one report table."""
    matches = scan.scan_rules(files)
    by_file = scan.file_findings(matches)
    scored = scoring.keep_vulnerable(scoring.score_functions(functions, make_scorer))
    layer2 = scored.join(functions.drop("content", "calls"), "node_id").select(
        "repo", "file_path", F.col("name").alias("function_name"), "start_line", "end_line", "result")
    first = by_file.select("repo", "file_path", "findings", F.lit(1).alias("layer"), F.lit(0).cast("long").alias("seq"))
    second = layer2.select("repo", "file_path", "result", F.lit(2).alias("layer"),
                           F.coalesce("start_line", F.lit(0)).cast("long").alias("seq"))
    items = first.unionByName(second, allowMissingColumns=True)
    routed = findings.route_findings(findings.dedup_by_node(items))
    reports = findings.combine_layers(findings.skipped_rows(routed).drop("route"), findings.flatten_to_reports(matches))
    return Report(matches, layer2, routed, reports)


def repository_blocks(rule_hits: DataFrame, layer2: DataFrame, nodes: DataFrame, edges: DataFrame, repo: str,
                      depth: int = 1, max_files: int = 30, max_chars: int = 22_000) -> tuple[DataFrame, DataFrame]:
    """(context blocks, impact edges) of the worst files; files without a graph node drop out.

    All roots travel through one batched traversal.
    """
    worst = findings.rank_files(rule_hits, layer2, max_files).withColumn("repo_name", F.lit(repo))
    roots = graph.resolve_file_nodes(nodes, worst).filter(F.col("node_id").isNotNull())
    around = graph.neighbourhood(nodes, edges, roots.select("repo_name", F.col("node_id").alias("root_id")),
                                 depth, same_file=False, include_content="content" in nodes.columns)
    masked = impact.render_context(around, max_chars)
    blocks = roots.select("repo_name", F.col("node_id").alias("root_id"), "file_path", "file_rank",
                          "layer1_findings", "layer2_items").join(masked, ["repo_name", "root_id"])
    return blocks, impact.impact_edges(around)


def item_context(nodes: DataFrame, edges: DataFrame, roots: DataFrame, depth: int = 2, max_chars: int = 22_000,
                 fast_chars: int | None = 9_000) -> DataFrame:
    """Per root: masked graph text, call-path block and both joined (fast mode cuts once more)."""
    around = graph.neighbourhood(nodes, edges, roots, depth, include_content="content" in nodes.columns)
    text = impact.render_context(around, max_chars)
    targets = roots.select("repo_name", F.col("root_id").alias("target_id"))
    paths = graph.call_paths(edges, targets)
    # At most ten paths per root remain, so gathering them is bounded.
    lines = paths.groupBy("repo_name", F.col("target_id").alias("root_id")).agg(
        F.array_sort(F.collect_list(F.struct("rank", "call_path"))).alias("p")).select(
        "repo_name", "root_id", F.array_join(F.transform("p", lambda x: x["call_path"]), "\n").alias("paths"))
    joined = text.join(lines, ["repo_name", "root_id"], "left").withColumn(
        "paths", F.coalesce("paths", F.lit("No algorithmic path found.")))
    if "content" in nodes.columns:
        on_path = graph.path_contents(nodes, paths)
        bodies = on_path.groupBy("repo_name", F.col("target_id").alias("root_id")).agg(
            F.array_sort(F.collect_list(F.struct("id", "block"))).alias("b")).select(
            "repo_name", "root_id", F.array_join(F.transform("b", lambda x: x["block"]), "").alias("bodies"))
        joined = joined.join(bodies, ["repo_name", "root_id"], "left")
    else:
        joined = joined.withColumn("bodies", F.lit(""))
    facts = F.concat(
        F.lit("[Repository: "), "repo_name", F.lit(" | Target File: "), px.symbol_file_path("root_id"),
        F.lit("]\n[CALL PATHS (SOURCE -> SINK)]\n"), F.col("paths"),
        F.lit("\n\n[NODES ALONG THE PATHS]\n"), F.coalesce("bodies", F.lit("")), F.lit("\n"))
    full = F.concat(facts, F.lit("\n\n[GRAPH CONTEXT]\n"), F.col("context"))
    return joined.select("repo_name", "root_id", "paths", "context",
                         (full if fast_chars is None else tx.truncate_middle(full, fast_chars)).alias("prompt"))


_CACHED = ("selected_cwe_id", "selected_cwe_name", "severity")


def prepare_analysis(items: DataFrame, nodes: DataFrame, edges: DataFrame, dictionary: DataFrame, cache: DataFrame, repo: str, depth: int = 1,
                     max_chars: int = 22_000, context_chars: int | None = 9_000, max_weaknesses: int | None = 12) -> Analysis:
    """Scan items made ready for the model: one item of each node, its masked evidence, weaknesses, context and paths; known results are reused.

    ``items`` has file_path, findings, result, layer, seq and any further evidence; matched_text, line_content and rules, where there, are part
    of the key under which ``cache`` (cache_key, selected_cwe_id, selected_cwe_name, severity) holds results.

    The routed items, the walk around their nodes and the paths are each written once; all branches read them.  A layer-2 item takes the rule
    findings of its file along.  Evidence points to its weaknesses by ``set_id``; only distinct sets are built.  A job whose node is not in the
    graph gives an ERROR row, so every node of the items comes back exactly once (items without a node, each by itself).
    """
    rules_of = items.filter(F.col("findings").isNotNull()).groupBy(px.bare_path("file_path").alias("bare")).agg(
        F.max_by("findings", F.struct("layer", "seq")).alias("layer1_findings"))
    routed = findings.route_findings(findings.dedup_by_node(items)).withColumn("bare", px.bare_path("node_id"))
    own = F.col("findings").isNull() & F.col("result").isNotNull()
    routed = reliable_checkpoint(routed.join(rules_of, "bare", "left").withColumn("layer1_findings", F.when(own, F.col("layer1_findings"))))
    skipped = findings.skipped_rows(routed)

    told = [c for c in routed.columns if c not in ("bare", "node_id", "layer", "seq", "route")]
    jobs = masking.mask_columns(routed.filter(F.col("route") == "job"), *told).withColumn("evidence", F.to_json(F.struct(*told)))
    links, sets = findings.weakness_sets(jobs, dictionary, "node_id", "evidence", max_weaknesses)
    shown = sets.groupBy("set_id").agg(F.to_json(F.transform(
        F.array_sort(F.collect_list(F.struct("rank", "cwe_id", "cwe_name"))), lambda x: F.struct(x["cwe_id"].alias("cwe_id"), x["cwe_name"].alias("cwe_name")))).alias("weaknesses"))
    roots = jobs.select(F.lit(repo).alias("repo_name"), F.col("node_id").alias("root_id"))
    around = item_context(nodes, edges, roots, depth, max_chars, context_chars).withColumnRenamed("root_id", "node_id")
    part = lambda c: c if c in told else "nothing"
    ready = (
        jobs.join(links, "node_id").join(shown, "set_id", "left").join(around.select("node_id", "paths", "prompt"), "node_id", "left")
        .withColumn("file_path", F.col("bare")).withColumn("nothing", F.lit(""))
        .withColumn("cache_key", sinks.cache_key("file_path", part("matched_text"), part("line_content"), part("rules"), "paths")))
    ready = reliable_checkpoint(ready.select("node_id", "file_path", "evidence", F.coalesce("weaknesses", F.lit("[]")).alias("weaknesses"), "set_id", "paths", "prompt", "cache_key"))

    known = ready.filter(F.col("prompt").isNotNull())
    reused, pending = sinks.split_cached(known, cache.select("cache_key", *_CACHED).dropDuplicates(["cache_key"]))
    lost = findings.failed_rows(ready.filter(F.col("prompt").isNull()).select(
        "node_id", F.lit("ERROR").alias("kind"), F.lit("The node is not in the graph.").alias("message")))
    columns = ["node_id", "file_path", *_CACHED, "outcome"]
    results = reused.withColumn("outcome", F.lit("reused")).select(*columns).unionByName(
        skipped.withColumn("outcome", F.col("route")).select(*columns)).unionByName(
        lost.withColumn("outcome", F.lit("failed")).select(*columns))
    return Analysis(pending, results)
