"""Labels, matches, metrics, sampling, scoring and retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkwarden.functions import fixed_values as fv
from sparkwarden.functions import text as tx
from sparkwarden.harness.registry import query
from sparkwarden.harness.text_queries import _NAME, _stripped, any_token, in_list, parts_in, quote
from sparkwarden.harness.views import code_files, code_functions, doc_files, spread, table, with_views
from sparkwarden.operators import code, evaluation, retrieval, scoring
from sparkwarden.plans import report


# --- metrics ----------------------------------------------------------------------------------

def _predictions(spark, sf):
    """Labelled documents with a rule that predicts quality from the length."""
    d = table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    return table(spark, sf, "labels").join(d, "doc_id").select(
        "doc_id", "lang", (F.col("n_chars") > 1500).alias("predicted"), (F.col("quality") == 1).alias("actual"), "toxic")


_PRED = "SELECT doc_id, lang, n_chars > 1500 AS predicted, quality = 1 AS actual, toxic FROM labels JOIN documents USING (doc_id)"
_COUNTS = "count(*) FILTER (predicted AND actual) AS tp, count(*) FILTER (predicted AND NOT actual) AS fp, count(*) FILTER (NOT predicted AND actual) AS fn, count(*) FILTER (NOT predicted AND NOT actual) AS tn, count(*) AS total"
_RATIOS = "CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0 END AS r, (tp + tn)::DOUBLE / total AS a"


@query("confusion_by_group", f"""
WITH j AS ({_PRED}), c AS (SELECT lang, {_COUNTS} FROM j GROUP BY lang), x AS (SELECT *, {_RATIOS} FROM c)
SELECT lang, tp, fp, fn, tn, total, round(p, 9) AS precision, round(r, 9) AS recall, round(a, 9) AS accuracy, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 9) AS f1 FROM x""")
def confusion_by_group(spark, sf):
    m = evaluation.confusion(_predictions(spark, sf), ["lang"])
    return m.withColumns({c: F.round(c, 9) for c in ("precision", "recall", "accuracy", "f1")})


@query("confusion_metrics", f"""
WITH j AS ({_PRED}), c AS (SELECT {_COUNTS} FROM j), x AS (SELECT *, {_RATIOS} FROM c)
SELECT tp, fp, fn, tn, total, round_even(p * 100, 1) AS precision, round_even(r * 100, 1) AS recall, round_even(a * 100, 1) AS accuracy, round_even(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 2) AS f1, fp AS false_positive_count FROM x""")
def confusion_metrics(spark, sf):
    return evaluation.confusion_metrics(_predictions(spark, sf))


@query("fp_reduction", f"""
WITH j AS ({_PRED}), c AS (SELECT lang AS strategy, {_COUNTS} FROM j GROUP BY lang), b AS (SELECT fp AS fp_base FROM c WHERE strategy = 'en')
SELECT strategy, fp_base, fp, CASE WHEN fp_base > 0 THEN round_even((fp_base - fp)::DOUBLE / fp_base * 100, 1) END AS reduction FROM c CROSS JOIN b WHERE strategy <> 'en'""")
def fp_reduction(spark, sf):
    m = evaluation.confusion(_predictions(spark, sf).withColumnRenamed("lang", "strategy"), ["strategy"])
    return evaluation.fp_reduction(m, "en")


@query("label_frequency", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def label_frequency(spark, sf):
    return evaluation.frequency(table(spark, sf, "events"), "event_type")


@query("threshold_prediction", "SELECT event_id, coalesce(CASE WHEN event_type <> 'view' THEN value END > 50.0, FALSE) AS predicted FROM events")
def threshold_prediction(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.when(F.col("event_type") != "view", F.col("value")).alias("p"))
    return e.select("event_id", evaluation.threshold_prediction("p", 50.0).alias("predicted"))


@query("predicted_vulnerable", """
SELECT o_orderkey, cwe <> 'UNMAPPED' AND sev NOT IN ('low', 'unknown', 'none') AND ev <> 'weak' AS flagged, cwe <> 'UNMAPPED' AND sev IN ('critical', 'high', 'medium') AND ev <> 'weak' AS strict FROM
(SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'UNMAPPED' ELSE 'CWE-79' END AS cwe, coalesce(lower(nullif(regexp_extract(o_orderpriority, '[A-Z]+$'), '')), 'unknown') AS sev, CASE WHEN o_totalprice > 250000 THEN 'strong' ELSE 'weak' END AS ev FROM orders)""")
def predicted_vulnerable(spark, sf):
    o = table(spark, sf, "orders").select(
        "o_orderkey", F.when(F.col("o_orderstatus") == "F", "unmapped").otherwise("cwe-79").alias("cwe"),
        F.regexp_extract("o_orderpriority", "[A-Z]+$", 0).alias("sev"), F.when(F.col("o_totalprice") > 250000, "Strong").otherwise("").alias("ev"))
    return o.select("o_orderkey", evaluation.is_predicted_vulnerable("cwe", "sev", "ev").alias("flagged"),
                    evaluation.is_predicted_vulnerable("cwe", "sev", "ev", strict=True).alias("strict"))


# --- joins ------------------------------------------------------------------------------------

def _candidates(spark, sf):
    """Orders as candidates: file from the customer, line from the day."""
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("candidate_id"), F.lit("shop").alias("repo"), F.concat(F.lit("f"), (F.col("o_custkey") % 500).cast("string")).alias("file_path"),
        F.dayofyear("o_orderdate").alias("line"), (F.col("o_orderstatus") == "F").alias("actual"))


def _tool_findings(spark, sf):
    """Line items as tool findings on the same files."""
    return table(spark, sf, "lineitem").select(
        F.lit("shop").alias("repo"), F.concat(F.lit("f"), (F.col("l_partkey") % 500).cast("string")).alias("file_path"), F.dayofyear("l_shipdate").alias("line"),
        F.concat_ws(":", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), F.col("l_suppkey").cast("string"), F.col("l_extendedprice").cast("int").cast("string")).alias("finding_id"),
        "l_returnflag")


_CANDIDATES = """
WITH cand AS (SELECT o_orderkey AS candidate_id, 'f' || (o_custkey % 500) AS file_path, dayofyear(o_orderdate)::INTEGER AS line, o_orderstatus = 'F' AS actual FROM orders),
tool AS (SELECT 'f' || (l_partkey % 500) AS file_path, dayofyear(l_shipdate)::INTEGER AS line, l_orderkey || ':' || l_linenumber || ':' || l_suppkey || ':' || trunc(l_extendedprice)::INTEGER AS finding_id, l_returnflag FROM lineitem),
pairs AS (SELECT candidate_id, finding_id, cand.line, tool.line AS f_line, l_returnflag FROM cand JOIN tool ON cand.file_path = tool.file_path AND abs(cand.line - tool.line) <= 5)"""


@query("band_match", _CANDIDATES + "SELECT candidate_id, finding_id, line, f_line FROM pairs")
def band_match(spark, sf):
    return evaluation.band_join(_candidates(spark, sf), _tool_findings(spark, sf)).select("candidate_id", F.col("f_finding_id").alias("finding_id"), "line", "f_line")


@query("match_tool_findings", _CANDIDATES + """
, n AS (SELECT candidate_id, count(*) AS k, array_to_string(list_sort(list(finding_id))[1:5], '|') AS firsts FROM pairs GROUP BY 1)
SELECT cand.candidate_id, coalesce(k, 0) AS matched_count, coalesce(k, 0) > 0 AS predicted, coalesce(firsts, '') AS firsts FROM cand LEFT JOIN n USING (candidate_id)""")
def match_tool_findings(spark, sf):
    m = evaluation.match_tool_findings(_candidates(spark, sf), _tool_findings(spark, sf))
    return m.select("candidate_id", "matched_count", "predicted", F.coalesce(F.array_join("first_matches", "|"), F.lit("")).alias("firsts"))


@query("tool_metrics", _CANDIDATES + f"""
, t AS (SELECT DISTINCT l_returnflag AS tool FROM lineitem), m AS (SELECT DISTINCT candidate_id, l_returnflag FROM pairs),
j AS (SELECT tool, actual, m.candidate_id IS NOT NULL AS predicted FROM cand CROSS JOIN t LEFT JOIN m ON m.candidate_id = cand.candidate_id AND m.l_returnflag = tool)
SELECT tool, {_COUNTS} FROM j GROUP BY tool""")
def tool_metrics(spark, sf):
    """Metrics of each tool (return flag) over all candidates."""
    candidates, found = _candidates(spark, sf), _tool_findings(spark, sf)
    parts = None
    for tool in ("A", "N", "R"):
        m = evaluation.match_tool_findings(candidates, found.filter(F.col("l_returnflag") == tool)).withColumn("tool", F.lit(tool))
        parts = m if parts is None else parts.unionByName(m)
    return evaluation.confusion(parts, ["tool"]).select("tool", "tp", "fp", "fn", "tn", "total")


_SPANS = """
WITH span AS (SELECT 'f' || (l_partkey % 300) AS file_path, l_orderkey || ':' || l_linenumber || ':' || l_suppkey AS node_id, (l_orderkey % 900)::INTEGER AS start_line, (l_orderkey % 900 + l_quantity)::INTEGER AS end_line FROM lineitem),
point AS (SELECT event_id AS point_id, 'f' || (user_id % 300) AS file_path, floor(value * 7)::INTEGER AS line FROM events)"""


def _spans(spark, sf):
    return table(spark, sf, "lineitem").select(
        F.lit("r").alias("repo"), F.concat(F.lit("f"), (F.col("l_partkey") % 300).cast("string")).alias("file_path"),
        F.concat_ws(":", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_suppkey")]).alias("node_id"), F.lit("fn").alias("name"),
        (F.col("l_orderkey") % 900).cast("int").alias("start_line"), (F.col("l_orderkey") % 900 + F.col("l_quantity")).cast("int").alias("end_line"))


def _points(spark, sf):
    return table(spark, sf, "events").select(
        F.col("event_id").alias("point_id"), F.lit("r").alias("repo"), F.concat(F.lit("f"), (F.col("user_id") % 300).cast("string")).alias("file_path"),
        F.floor(F.col("value") * 7).cast("int").alias("line"))


@query("innermost_container", _SPANS + """
, m AS (SELECT point_id, min((end_line - start_line, start_line, node_id)) AS b FROM point JOIN span ON span.file_path = point.file_path AND line BETWEEN start_line AND end_line GROUP BY 1)
SELECT point.point_id, line, b[3] AS inner_id FROM point LEFT JOIN m USING (point_id)""")
def innermost_container(spark, sf):
    return evaluation.innermost(_points(spark, sf), _spans(spark, sf)).select("point_id", "line", "inner_id")


@query("containing_function", _SPANS + """
, m AS (SELECT point_id, min((end_line - start_line, start_line, node_id)) AS b FROM point JOIN span ON span.file_path = point.file_path AND line BETWEEN start_line AND end_line GROUP BY 1)
SELECT point.point_id, coalesce(b[3], CASE WHEN file_path IN (SELECT file_path FROM span) THEN file_path || ':<file>' END) AS function_id FROM point LEFT JOIN m USING (point_id)""")
def containing_function(spark, sf):
    spans = _spans(spark, sf)
    whole = spans.select("repo", "file_path").distinct().select(
        "repo", "file_path", F.concat("file_path", F.lit(":<file>")).alias("node_id"), F.lit("<file>").alias("name"), F.lit(1).alias("start_line"), F.lit(1).alias("end_line"))
    return evaluation.containing_function(_points(spark, sf), spans.unionByName(whole)).select("point_id", "function_id")


@query("flagged_functions", _SPANS + """
, s AS (SELECT *, CASE WHEN start_line % 10 <> 3 THEN start_line END AS a, CASE WHEN start_line % 10 <> 4 THEN end_line END AS b FROM span)
SELECT DISTINCT node_id FROM s WHERE start_line % 97 = 0 OR EXISTS (SELECT 1 FROM point WHERE point.file_path = s.file_path AND line >= coalesce(a, 0) AND (b IS NULL OR line <= b))""")
def flagged_functions(spark, sf):
    """Spans, some of them open, that hold a point or are flagged by the model."""
    spans = _spans(spark, sf)
    model = spans.filter(F.col("start_line") % 97 == 0)
    opened = spans.withColumns({"start_line": F.when(F.col("start_line") % 10 != 3, F.col("start_line")),
                                "end_line": F.when(F.col("start_line") % 10 != 4, F.col("end_line"))})
    return evaluation.flagged_functions(opened, _points(spark, sf), model).select("node_id").distinct()


# --- selection --------------------------------------------------------------------------------
_POOL = """
WITH pool AS (SELECT o_orderkey AS candidate_id, 'r' || (o_custkey % 7) AS repo, CASE WHEN o_custkey % 3 = 0 THEN 'routes/a' ELSE 'lib/b' END || (o_custkey % 50) || '.py' AS file_path,
  dayofyear(o_orderdate)::INTEGER AS line, 'R' || o_orderstatus AS rule_id, o_orderpriority AS category, CASE WHEN o_totalprice > 450000 THEN 'TP' ELSE 'FP' END AS oracle_label FROM orders)"""


def _pool(spark, sf):
    o = F.col("o_custkey")
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("candidate_id"), F.concat(F.lit("r"), (o % 7).cast("string")).alias("repo"),
        F.concat(F.when(o % 3 == 0, "routes/a").otherwise("lib/b"), (o % 50).cast("string"), F.lit(".py")).alias("file_path"), F.dayofyear("o_orderdate").alias("line"),
        F.concat(F.lit("R"), "o_orderstatus").alias("rule_id"), F.col("o_orderpriority").alias("category"),
        F.when(F.col("o_totalprice") > 450000, "TP").otherwise("FP").alias("oracle_label"), F.lit("x").alias("oracle_reason"))


@query("top_per_repo", _POOL + """
SELECT candidate_id, pick::INTEGER AS pick FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY CASE WHEN file_path LIKE 'routes/%' THEN 0 ELSE 1 END, file_path, line, rule_id, candidate_id) AS pick FROM pool) WHERE pick <= 35""")
def top_per_repo(spark, sf):
    return evaluation.top_per_repo(_pool(spark, sf), 35).select("candidate_id", "pick")


@query("select_balanced", _POOL + """
, g AS (SELECT *, row_number() OVER (PARTITION BY repo, oracle_label ORDER BY category, file_path, line, rule_id, candidate_id) AS r FROM pool),
f AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY CASE WHEN r <= CASE oracle_label WHEN 'TP' THEN 101 ELSE 100 END THEN 0 ELSE 1 END, CASE oracle_label WHEN 'TP' THEN 0 ELSE 1 END, r) AS pick FROM g)
SELECT repo, oracle_label, candidate_id FROM f WHERE pick <= 201""")
def select_balanced(spark, sf):
    return evaluation.select_balanced(_pool(spark, sf), 201).select("repo", "oracle_label", "candidate_id")


@query("public_candidates", _POOL + "SELECT candidate_id, repo, file_path, line, rule_id, category FROM pool")
def public_candidates(spark, sf):
    return evaluation.public_candidate(_pool(spark, sf))


@query("balanced_counts", "SELECT quality AS target, (SELECT least(count(*) FILTER (quality = 1), count(*) FILTER (quality = 0), 60) FROM labels) AS n FROM labels WHERE quality IN (0, 1) GROUP BY quality")
def balanced_counts(spark, sf):
    """Class sizes of a balanced sample."""
    sample = evaluation.balanced_sample(table(spark, sf, "labels"), "doc_id", "quality", 120)
    return sample.groupBy(F.col("quality").alias("target")).agg(F.count("*").alias("n"))


_CONSTRAINTS = """
SELECT l_orderkey AS case_id, CASE WHEN l_linestatus = 'O' THEN 'primary' ELSE 'alternative' END AS guard, CASE WHEN l_suppkey % 2 = 0 THEN 'x' ELSE 'y' END AS var,
  (['>', '<', '>=', '<=', '=='])[l_partkey % 5 + 1] AS op, l_quantity::BIGINT AS value FROM lineitem"""


def _constraints(spark, sf):
    op = F.element_at(F.array(*[F.lit(x) for x in (">", "<", ">=", "<=", "==")]), (F.col("l_partkey") % 5 + 1).cast("int"))
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("case_id"), F.when(F.col("l_linestatus") == "O", "primary").otherwise("alternative").alias("guard"),
        F.when(F.col("l_suppkey") % 2 == 0, "x").otherwise("y").alias("var"), op.alias("op"), F.col("l_quantity").cast("long").alias("value"))


_FEASIBLE = f"""
WITH c AS ({_CONSTRAINTS}),
v AS (SELECT case_id, guard, var, max(CASE op WHEN '>' THEN value + 1 WHEN '>=' THEN value WHEN '==' THEN value END) AS lo, min(CASE op WHEN '<' THEN value - 1 WHEN '<=' THEN value WHEN '==' THEN value END) AS hi FROM c GROUP BY ALL),
f AS (SELECT case_id, guard, bool_and(lo IS NULL OR hi IS NULL OR lo <= hi) AS feasible FROM v GROUP BY ALL)"""


@query("bounds_feasible", _FEASIBLE + "SELECT case_id, guard, feasible FROM f")
def bounds_feasible(spark, sf):
    return evaluation.bounds_feasible(_constraints(spark, sf))


@query("constraint_verdicts", _FEASIBLE + "SELECT case_id, coalesce(bool_or(feasible) FILTER (guard = 'primary'), FALSE) AS first_pass, bool_or(feasible) AS second_pass FROM f GROUP BY case_id")
def constraint_verdicts(spark, sf):
    return evaluation.constraint_verdicts(_constraints(spark, sf))


@query("case_grid", """
WITH t AS (SELECT p_partkey AS slot, p_name, (SELECT count(*) FROM part) AS k FROM part), i AS (SELECT unnest(range(3000)) AS i)
SELECT 'TP-' || CASE WHEN i < 9 THEN '0' ELSE '' END || left((i + 1)::VARCHAR, 2) AS case_id, i // k AS variant, p_name FROM i JOIN t ON i % k = slot""")
def case_grid(spark, sf):
    templates = table(spark, sf, "part").select(F.col("p_partkey").alias("slot"), "p_name")
    return evaluation.case_grid(templates, 3000, "TP-")


# --- labels and evidence ----------------------------------------------------------------------
_CATEGORIES = ("injection", "xss", "path_traversal", "ssrf", "dangerous_function", "weak_crypto", "hardcoded_secret", "auth_bypass", "dos")


def _category(key: str):
    return F.element_at(F.array(*[F.lit(c) for c in _CATEGORIES]), (F.col(key) % len(_CATEGORIES) + 1).cast("int"))


_CATEGORY_SQL = "(" + "[" + ", ".join(quote(c) for c in _CATEGORIES) + "]" + f")[{{k}} % {len(_CATEGORIES)} + 1]"


def _labelled_docs(spark, sf):
    return spread(doc_files(spark, sf)).withColumn("category", _category("doc_id")).withColumn(
        "rule_id", F.when(F.col("doc_id") % 4 == 0, "SEC033").otherwise("SEC001"))


_SAFE = f"(NOT {any_token('s', fv.UNSAFE_MARKERS)} AND {any_token('s', fv.SAFE_TOKENS)} AND (category NOT IN {in_list(fv.PATH_GUARDED_CATEGORIES)} OR {any_token('s', fv.PATH_GUARD_TOKENS)}))"


@query("oracle_labels", with_views(f"""
, d AS (SELECT doc_id, file_path, file_path || chr(10) || content AS raw, {_CATEGORY_SQL.format(k='doc_id')} AS category, CASE WHEN doc_id % 4 = 0 THEN 'SEC033' ELSE 'SEC001' END AS rule_id FROM files),
c AS (SELECT *, {_stripped('raw')} AS s FROM d),
f AS (SELECT *, {any_token('s', fv.SOURCE_TOKENS)} AS source, {any_token('s', fv.SINK_TOKENS)} OR category IN {in_list(fv.SINK_CATEGORIES)} AS sink, {_SAFE} AS safe FROM c)
SELECT doc_id, CASE WHEN {parts_in(fv.FP_HINT_PARTS)} THEN 'FP' WHEN category = 'hardcoded_secret' AND {any_token('s', fv.PLACEHOLDER_WORDS)} THEN 'FP'
  WHEN rule_id IN ('SEC033', 'SEC101') AND NOT regexp_matches(raw, {quote(fv.RANDOMNESS_CONTEXT)}) THEN 'FP'
  WHEN category = 'hardcoded_secret' THEN CASE WHEN contains(lower(file_path), 'config') OR contains(lower(file_path), 'settings') OR contains(lower(file_path), '.env') THEN 'TP' ELSE 'FP' END
  WHEN category IN ('weak_crypto', 'misconfiguration') THEN CASE WHEN safe THEN 'FP' ELSE 'TP' END
  WHEN category IN ('dangerous_function', 'auth_bypass') AND source AND sink THEN 'TP' WHEN source AND sink AND NOT safe THEN 'TP' WHEN sink AND NOT safe AND {parts_in(fv.TP_HINT_PARTS)} THEN 'TP'
  WHEN safe THEN 'FP' ELSE 'UNKNOWN' END AS label FROM f""", "files"))
def oracle_labels(spark, sf):
    d = _labelled_docs(spark, sf)
    context = F.concat_ws("\n", "file_path", "content")
    return d.select("doc_id", evaluation.oracle_label("file_path", "rule_id", "category", context)["label"].alias("label"))


@query("predict_from_context", with_views(f"""
, d AS (SELECT doc_id, content, {_CATEGORY_SQL.format(k='doc_id')} AS category, {_stripped('content')} AS s FROM files),
f AS (SELECT doc_id, category, {any_token('content', fv.SOURCE_TOKENS)} AS source, {any_token('content', fv.SINK_TOKENS)} AS sink, {_SAFE} AS safe FROM d)
SELECT doc_id, source, sink, safe, CASE WHEN category IN ('dangerous_function', 'auth_bypass') AND source AND sink THEN TRUE WHEN category = 'hardcoded_secret' THEN sink OR NOT safe
  WHEN category IN ('weak_crypto', 'misconfiguration') THEN NOT safe ELSE source AND sink AND NOT safe END AS predicted FROM f""", "files"))
def predict_from_context(spark, sf):
    d = _labelled_docs(spark, sf).withColumn("s", evaluation.signals("content", F.lit("match"), "category"))
    return d.select("doc_id", "s.*", evaluation.predict_from_signals("category", "s").alias("predicted"))


def _evidence_score(spark, sf, text_chars):
    d = _labelled_docs(spark, sf)
    own = F.col("doc_id").cast("string")
    score = retrieval.evidence_score(
        {"function_id": F.when(F.col("doc_id") % 3 == 0, own).otherwise(F.lit("other")), "category": F.col("category"), "matched_text": F.lit("match"),
         "file_path": F.when(F.col("doc_id") % 2 == 0, F.col("file_path")).otherwise(F.lit("other"))},
        {"node_id": own, "file_path": F.col("file_path"), "name": F.lit("fn"), "content": F.col("content")}, F.col("doc_id") % 4, F.col("doc_id") % 20, text_chars)
    return d.select("doc_id", F.round(score, 6).alias("score"))


@query("evidence_score", with_views(f"""
, d AS (SELECT doc_id, file_path, {_stripped("file_path || chr(10) || 'fn' || chr(10) || left(content, 3000)")} AS s, {_CATEGORY_SQL.format(k='doc_id')} AS category, doc_id % 4 AS dist, doc_id % 20 AS pos FROM files)
SELECT doc_id, round(CASE WHEN doc_id % 3 = 0 THEN 40 ELSE 0 END + greatest(0, 18 - dist * 6) + greatest(0, 4 - pos * 0.1::DOUBLE) + CASE WHEN doc_id % 2 = 0 THEN 12 ELSE 0 END
  + CASE WHEN {parts_in(fv.RUNTIME_PARTS, 'string_split(lower(file_path), chr(47))')} THEN 8 ELSE 0 END + CASE WHEN {any_token('s', fv.SOURCE_TOKENS)} THEN 12 ELSE 0 END + CASE WHEN {any_token('s', fv.SINK_TOKENS)} THEN 10 ELSE 0 END
  + CASE WHEN {_SAFE} THEN 14 ELSE 0 END + CASE WHEN category = 'auth_bypass' AND {any_token('s', fv.AUTH_GUARD_TOKENS)} THEN 10 ELSE 0 END
  + CASE WHEN category IN {in_list(fv.PATH_GUARDED_CATEGORIES)} AND {any_token('s', fv.PATH_GUARD_TOKENS)} THEN 10 ELSE 0 END
  - CASE WHEN {parts_in(fv.NON_RUNTIME_PARTS, 'string_split(lower(file_path), chr(47))')} OR regexp_matches(lower({_NAME}), '(^|[._-])(test|spec)([._-]|$)') THEN 18 ELSE 0 END, 6)::DOUBLE AS score FROM d""", "files"))
def evidence_score(spark, sf):
    """As the reference reads it: the first 3,000 characters."""
    return _evidence_score(spark, sf, 3000)


@query("evidence_score_whole", with_views(f"""
, d AS (SELECT doc_id, file_path, {_stripped("file_path || chr(10) || 'fn' || chr(10) || content")} AS s, {_CATEGORY_SQL.format(k='doc_id')} AS category, doc_id % 4 AS dist, doc_id % 20 AS pos FROM files)
SELECT doc_id, round(CASE WHEN doc_id % 3 = 0 THEN 40 ELSE 0 END + greatest(0, 18 - dist * 6) + greatest(0, 4 - pos * 0.1::DOUBLE) + CASE WHEN doc_id % 2 = 0 THEN 12 ELSE 0 END
  + CASE WHEN {parts_in(fv.RUNTIME_PARTS, 'string_split(lower(file_path), chr(47))')} THEN 8 ELSE 0 END + CASE WHEN {any_token('s', fv.SOURCE_TOKENS)} THEN 12 ELSE 0 END + CASE WHEN {any_token('s', fv.SINK_TOKENS)} THEN 10 ELSE 0 END
  + CASE WHEN {_SAFE} THEN 14 ELSE 0 END + CASE WHEN category = 'auth_bypass' AND {any_token('s', fv.AUTH_GUARD_TOKENS)} THEN 10 ELSE 0 END
  + CASE WHEN category IN {in_list(fv.PATH_GUARDED_CATEGORIES)} AND {any_token('s', fv.PATH_GUARD_TOKENS)} THEN 10 ELSE 0 END
  - CASE WHEN {parts_in(fv.NON_RUNTIME_PARTS, 'string_split(lower(file_path), chr(47))')} OR regexp_matches(lower({_NAME}), '(^|[._-])(test|spec)([._-]|$)') THEN 18 ELSE 0 END, 6)::DOUBLE AS score FROM d""", "files"))
def evidence_score_whole(spark, sf):
    return _evidence_score(spark, sf, None)


def _text_context(spark, sf, text_chars):
    functions = spread(doc_files(spark, sf)).select(
        F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("node_id"), "repo", "file_path", F.lit("doc").alias("name"), "content")
    candidates = table(spark, sf, "benchmark").select(
        F.col("item_id").alias("candidate_id"), F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("repo"), F.lit(None).cast("string").alias("function_id"),
        F.col("text").alias("rule_name"), F.lit("bench").alias("category"), F.lit("benchmark").alias("matched_text"), F.lit("x q").alias("file_path"))
    found = retrieval.text_context(candidates, functions, text_chars=text_chars)
    return found.select(F.col("candidate_id").alias("item_id"), F.col("node_id").cast("long").alias("doc_id"), F.round("score", 9).alias("score"), F.col("position").cast("int").alias("position"))


@query("text_context_topk", with_views(f"""
, q AS (SELECT item_id, 'src' || (item_id % 20) AS repo, list_distinct(list_transform(regexp_extract_all(text || ' bench ' || 'benchmark' || ' x' || ' q', {quote(fv.TOKEN_PATTERN)}), lambda x: lower(x))) AS w FROM benchmark),
f AS (SELECT doc_id, repo, list_distinct(list_transform(regexp_extract_all(file_path || ' doc ' || left(content, 1200), {quote(fv.TOKEN_PATTERN)}), lambda x: lower(x))) AS w FROM files),
s AS (SELECT item_id, doc_id, len(list_intersect(q.w, f.w)) / sqrt(greatest(1, len(f.w))) AS score FROM q JOIN f ON q.repo = f.repo),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, lpad(doc_id::VARCHAR, 12, '0') DESC) - 1 AS position FROM s WHERE score > 0)
SELECT item_id, doc_id, round(score, 9) AS score, position::INTEGER AS position FROM r WHERE position < 8""", "files"))
def text_context_topk(spark, sf):
    """As the reference reads it: the first 1,200 characters."""
    return _text_context(spark, sf, 1200)


@query("text_context_topk_whole", with_views(f"""
, q AS (SELECT item_id, 'src' || (item_id % 20) AS repo, list_distinct(list_transform(regexp_extract_all(text || ' bench ' || 'benchmark' || ' x' || ' q', {quote(fv.TOKEN_PATTERN)}), lambda x: lower(x))) AS w FROM benchmark),
f AS (SELECT doc_id, repo, list_distinct(list_transform(regexp_extract_all(file_path || ' doc ' || content, {quote(fv.TOKEN_PATTERN)}), lambda x: lower(x))) AS w FROM files),
s AS (SELECT item_id, doc_id, len(list_intersect(q.w, f.w)) / sqrt(greatest(1, len(f.w))) AS score FROM q JOIN f ON q.repo = f.repo),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, lpad(doc_id::VARCHAR, 12, '0') DESC) - 1 AS position FROM s WHERE score > 0)
SELECT item_id, doc_id, round(score, 9) AS score, position::INTEGER AS position FROM r WHERE position < 8""", "files"))
def text_context_topk_whole(spark, sf):
    return _text_context(spark, sf, None)


# --- scoring ----------------------------------------------------------------------------------
_HITS = " + ".join(f"(length(lower(text)) - length(replace(lower(text), {quote(t.lower())}, ''))) / {len(t)}" for t in fv.SINK_TOKENS)


@query("score_functions", f"""
WITH h AS (SELECT doc_id, text, ({_HITS})::DOUBLE AS h FROM documents WHERE text IS NOT NULL)
SELECT doc_id, trim(text) <> '' AS ok, CASE WHEN trim(text) <> '' THEN round(1 / (1 + exp(2 - 2 * h)), 6) END AS probability FROM h""")
def score_functions(spark, sf):
    d = spread(table(spark, sf, "documents").select("doc_id", F.col("text").alias("content")))
    s = scoring.score_functions(d, key="doc_id")
    return s.select("doc_id", F.col("result.ok").alias("ok"), F.round(scoring.vulnerable_probability("result"), 6).alias("probability"))


@query("keep_vulnerable", """
SELECT 'cust/c' || c_custkey || '.py' AS file_path, 'c' || c_custkey AS function_name, 1 AS start_line, 2 AS end_line, 'SAFE' AS label FROM customer
UNION ALL SELECT 'sup/s' || s_suppkey || '.js', 't' || s_suppkey, 5, 5, 'SAFE' FROM supplier""")
def keep_vulnerable(spark, sf):
    """Functions of the derived sources above a threshold that one risky call passes."""
    f = code_functions(spark, sf).filter(F.col("name") != "<file>")
    kept = scoring.keep_vulnerable(scoring.score_functions(f), 0.4)
    return kept.join(f, "node_id").select("file_path", F.col("name").alias("function_name"), "start_line", "end_line", F.col("result.label").alias("label"))


@query("score_candidates", f"""
WITH t AS (SELECT doc_id, text FROM documents), h AS (SELECT doc_id, ({_HITS})::DOUBLE AS h FROM t)
SELECT l.doc_id, quality, round(CASE WHEN trim(text) <> '' THEN 1 / (1 + exp(2 - 2 * h)) END, 6) AS probability, coalesce(CASE WHEN trim(text) <> '' THEN 1 / (1 + exp(2 - 2 * h)) END > 0.5, FALSE) AS predicted
FROM labels l LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)""")
def score_candidates(spark, sf):
    """Each labelled document's function is scored once and joined back."""
    functions = table(spark, sf, "documents").select(F.col("doc_id").alias("node_id"), F.col("text").alias("content"))
    candidates = table(spark, sf, "labels").withColumn("function_id", F.col("doc_id"))
    return scoring.score_candidates(candidates, functions).select("doc_id", "quality", F.round("probability", 6).alias("probability"), "predicted")


# --- source code ------------------------------------------------------------------------------
_FUNCTIONS = """
, files_ AS (SELECT file_path, file_lines, flatten(list(calls)) AS calls, list(name) AS names FROM code GROUP BY ALL),
functions AS (SELECT 'shop:' || file_path || ':' || name || ':' || start_line AS node_id, file_path, name, start_line, end_line, CASE WHEN file_path LIKE '%.js' AND name LIKE 's%' THEN calls WHEN file_path LIKE '%.js' THEN ['random'] ELSE calls END AS calls FROM code
  UNION ALL SELECT 'shop:' || file_path || ':<file>:1', file_path, '<file>', 1, file_lines, CASE WHEN file_path LIKE '%.js' THEN list_concat(['require'], calls) ELSE list_concat(names, calls) END FROM files_)"""


@query("extract_functions", with_views(_FUNCTIONS + """
SELECT node_id, name, start_line::INTEGER AS start_line, end_line::INTEGER AS end_line, array_to_string(list_sort(list_distinct(calls)), ',') AS calls FROM functions""", "code"))
def extract_functions(spark, sf):
    f = code.build_functions(spread(code_files(spark, sf)))
    return f.select("node_id", "name", "start_line", "end_line", F.array_join(F.array_sort("calls"), ",").alias("calls"))


@query("call_targets", with_views(_FUNCTIONS + """
, r AS (SELECT name, node_id AS target_id, row_number() OVER (PARTITION BY name ORDER BY file_path, start_line, node_id) AS k FROM functions) SELECT name, target_id FROM r WHERE k <= 8""", "code"))
def call_targets(spark, sf):
    """As the reference links: 8 of each name."""
    return code.call_targets(code_functions(spark, sf), 8).drop("repo")


@query("call_targets_all", with_views(_FUNCTIONS + "SELECT name, node_id AS target_id FROM functions", "code"))
def call_targets_all(spark, sf):
    return code.call_targets(code_functions(spark, sf)).drop("repo")


@query("code_graph", with_views(_FUNCTIONS + """
, t AS (SELECT name, node_id FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY file_path, start_line, node_id) AS k FROM functions) WHERE k <= 8),
whole AS (SELECT file_path, node_id FROM functions WHERE name = '<file>'),
imports AS (SELECT DISTINCT file_path, imported FROM code WHERE imported IN (SELECT file_path FROM whole)),
e AS (SELECT w.node_id AS src, f.node_id AS dst FROM functions f JOIN whole w ON w.file_path = f.file_path WHERE f.name <> '<file>'
  UNION SELECT c.node_id, t.node_id FROM (SELECT node_id, unnest(calls) AS name FROM functions) c JOIN t ON t.name = c.name WHERE c.node_id <> t.node_id
  UNION SELECT a.node_id, b.node_id FROM imports JOIN whole a ON a.file_path = imports.file_path JOIN whole b ON b.file_path = imported)
SELECT src, dst FROM e UNION SELECT dst, src FROM e""", "code"))
def code_graph(spark, sf):
    return code.build_code_graph(code_functions(spark, sf), code_files(spark, sf), 8).drop("repo")


@query("code_graph_all", with_views(_FUNCTIONS + """
, t AS (SELECT name, node_id FROM functions),
whole AS (SELECT file_path, node_id FROM functions WHERE name = '<file>'),
imports AS (SELECT DISTINCT file_path, imported FROM code WHERE imported IN (SELECT file_path FROM whole)),
e AS (SELECT w.node_id AS src, f.node_id AS dst FROM functions f JOIN whole w ON w.file_path = f.file_path WHERE f.name <> '<file>'
  UNION SELECT c.node_id, t.node_id FROM (SELECT node_id, unnest(calls) AS name FROM functions) c JOIN t ON t.name = c.name WHERE c.node_id <> t.node_id
  UNION SELECT a.node_id, b.node_id FROM imports JOIN whole a ON a.file_path = imports.file_path JOIN whole b ON b.file_path = imported)
SELECT src, dst FROM e UNION SELECT dst, src FROM e""", "code"))
def code_graph_all(spark, sf):
    return code.build_code_graph(code_functions(spark, sf), code_files(spark, sf)).drop("repo")


@query("import_edges", with_views("SELECT DISTINCT file_path, imported FROM code WHERE imported IN (SELECT file_path FROM code)", "code"))
def import_edges(spark, sf):
    return code.import_edges(code_files(spark, sf)).drop("repo").distinct()


@query("scan_candidates", with_views("""
SELECT file_path, CASE WHEN name LIKE 'c%' THEN 2 ELSE 5 END AS line, rule_id, 'shop:' || file_path || ':' || name || ':' || start_line AS function_id, label AS oracle_label
FROM code JOIN (VALUES ('c', 'SEC021', 'TP'), ('c', 'APP-EVAL-REQ', 'TP'), ('t', 'SEC101', 'FP')) v(p, rule_id, label) ON left(name, 1) = p""", "code"))
def scan_candidates(spark, sf):
    files = spread(code_files(spark, sf))
    return report.scan_candidates(files, code_functions(spark, sf)).select("file_path", "line", "rule_id", "function_id", "oracle_label")


@query("evaluate_strategies")
def evaluate_strategies(spark, sf):
    """The retrieval ablation over the derived source files."""
    return report.evaluate_strategies(spread(code_files(spark, sf)))
