"""Rule scan, masking and scalar expressions over documents and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkwarden.functions import fixed_values as fv
from sparkwarden.functions import masking
from sparkwarden.functions import paths as px
from sparkwarden.functions import text as tx
from sparkwarden.functions import vectors as vx
from sparkwarden.harness.registry import query
from sparkwarden.harness.views import SQL, doc_files, doc_path, nodes, page_files, spread, table, with_views
from sparkwarden.operators import evaluation, findings, rules, scan
from sparkwarden.sources import files as file_sources


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def in_list(values) -> str:
    return "(" + ", ".join(quote(v) for v in values) + ")"


def any_token(column: str, tokens) -> str:
    return "(" + " OR ".join(f"contains(lower({column}), {quote(t.lower())})" for t in tokens) + ")"


# --- rule scan --------------------------------------------------------------------------------
# The checking engine has ASCII word classes and no look-around.  Patterns with a word boundary run
# on a copy of the text in which accented letters are plain ones (same length), and the three
# look-ahead rules are spelled out.
_SPELLED = {
    "SEC079": r"(?i)(SAXParserFactory|DocumentBuilderFactory)\.newInstance\(\)(?:\.setFeature)?",
    "SEC036": r"\bopen\s*\((?:\s*(?:[^)'\"][^)]{0,59})?|\s[^)]{0,59})(?:request|param|arg|input|user|filename|path)[^)]{0,60}\)",
    "SEC038": r"['\"]http://[^'\"]{5,}['\"]",
}
_DROP = {
    "SEC079": r"(?i)\.setFeature$",
    "SEC038": r"^['\"]http://(localhost|127\.0\.0\.1|0\.0\.0\.0)",
}


def matches_sql(source: str, keys: str, packs=("core", "app")) -> str:
    """CTEs ending in ``matches``: keys, rule fields, match_seq, start, line, column, texts."""
    branches = []
    for i, r in enumerate(rules.rules_in(packs)):
        pattern = quote("(?m)" + _SPELLED.get(r.rule_id, r.pattern))
        body = "folded" if r"\b" in r.pattern and r.rule_id != "SEC020" else "content"
        branches.append(
            f"SELECT {keys}, content, {i} AS rule_seq, {quote(r.rule_id)} AS rule_id, {quote(r.name)} AS name, {quote(r.category)} AS category, "
            f"{quote(r.severity) if r.severity else 'NULL'} AS rule_severity, {quote(r.allow) if r.allow else 'NULL'} AS allow, "
            f"{quote(_DROP[r.rule_id]) if r.rule_id in _DROP else 'NULL'} AS unwanted, "
            f"regexp_extract_all({body}, {pattern}) AS m, string_split_regex({body}, {pattern}) AS p FROM src WHERE regexp_matches({body}, {pattern})")
    union = "\nUNION ALL ".join(branches)
    allowed = " OR ".join(
        f"(rule_id = {quote(r.rule_id)} AND regexp_matches(matched_text, {quote('(?m)' + r.allow)}))"
        for r in rules.rules_in(packs) if r.allow)
    dropped = " OR ".join(f"(rule_id = '{k}' AND regexp_matches(matched_text, {quote(v)}))" for k, v in _DROP.items())
    return f"""
, src AS (SELECT *, regexp_replace(content, '[^\\x00-\\x7F&&\\pL]', 'x', 'g') AS folded FROM {source}),
hits AS ({union}),
each AS (SELECT *, unnest(range(len(m))) AS match_seq FROM hits),
placed AS (SELECT * EXCLUDE (m, p), coalesce(list_sum(list_transform(p[1:match_seq + 1], lambda x: length(x))), 0)::BIGINT
  + coalesce(list_sum(list_transform(m[1:match_seq], lambda x: length(x))), 0)::BIGINT AS start, length(m[match_seq + 1]) AS n FROM each),
texts AS (SELECT *, substr(content, start + 1, n) AS matched_text, substr(content, 1, start) AS before FROM placed),
matches AS (SELECT *, length(before) - length(replace(before, chr(10), '')) + 1 AS line,
  start + 1 - coalesce(length(before) - length(list_extract(string_split(before, chr(10)), -1)), 0) AS "column" FROM texts
  WHERE NOT ({allowed}) AND NOT ({dropped}))
""".replace("[^\\x00-\\x7F&&\\pL]", "[\\x{C0}-\\x{24F}]")


DOC_MATCHES = matches_sql("files", "repo, file_path")
PAGE_MATCHES = matches_sql("(SELECT page_id, html AS content FROM pages)", "page_id")


def doc_matches(spark, sf, packs=("core", "app")):
    return scan.scan_rules(spread(doc_files(spark, sf)), rules.rules_in(packs))


@query("rank_files_by_finding", with_views(DOC_MATCHES + """,
files_ranked AS (SELECT repo, file_path, max(CASE rule_severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END) AS worst_level,
  count(*) AS matches, count(DISTINCT rule_id) AS rules, count(DISTINCT line) AS lines, min(line) AS first_line FROM matches GROUP BY repo, file_path)
SELECT * FROM files_ranked ORDER BY worst_level DESC, matches DESC, repo, file_path LIMIT 100""", "files"))
def rank_files_by_finding(spark, sf):
    """Flagship: files by worst finding."""
    return scan.file_severity(doc_matches(spark, sf)).orderBy(
        F.desc("worst_level"), F.desc("matches"), "repo", "file_path").limit(100)


_POSITION_COLUMNS = "rule_id, match_seq, start, line, \"column\", matched_text"


@query("rule_match_positions", with_views(DOC_MATCHES + f"SELECT repo, file_path, {_POSITION_COLUMNS} FROM matches", "files"))
def rule_match_positions(spark, sf):
    return doc_matches(spark, sf).select("repo", "file_path", "rule_id", "match_seq", "start", "line", "column", "matched_text")


@query("rule_match_positions_pages", f"WITH unused AS (SELECT 1 AS one){PAGE_MATCHES}SELECT page_id, {_POSITION_COLUMNS} FROM matches")
def rule_match_positions_pages(spark, sf):
    pages = spread(page_files(spark, sf))
    return scan.scan_rules(pages, rules.rules_in(("core", "app")), keys=("page_id",)).select(
        "page_id", "rule_id", "match_seq", "start", "line", "column", "matched_text")


@query("rule_match_lines", with_views(DOC_MATCHES + """
SELECT repo, file_path, line, arg_min("column", rule_seq * 1000000 + match_seq) AS "column", count(*) AS hits,
  arg_min(trim(list_extract(string_split(content, chr(10)), line), chr(32) || chr(9) || chr(13)), rule_seq * 1000000 + match_seq) AS line_content,
  arg_min(rule_id, rule_seq * 1000000 + match_seq) AS first_rule FROM matches GROUP BY repo, file_path, line""", "files"))
def rule_match_lines(spark, sf):
    lines = scan.line_findings(doc_matches(spark, sf))
    return lines.select("repo", "file_path", "line", "column", F.size("rules").cast("long").alias("hits"),
                        "line_content", F.element_at("rules", 1)["rule_id"].alias("first_rule"))


@query("rule_severity_histogram", with_views(DOC_MATCHES + """
SELECT coalesce(rule_severity, 'none') AS rule_severity, category, rule_id, count(*) AS hits, count(DISTINCT file_path) AS files FROM matches GROUP BY ALL""", "files"))
def rule_severity_histogram(spark, sf):
    return doc_matches(spark, sf).groupBy(
        F.coalesce("rule_severity", F.lit("none")).alias("rule_severity"), "category", "rule_id").agg(
        F.count("*").alias("hits"), F.count_distinct("file_path").alias("files"))


def _catalog_sql() -> str:
    rows = ", ".join(f"({quote(r.category)}, {quote(r.severity or 'none')}, {quote(r.rule_id)})" for r in rules.rules_in(("core", "app")))
    return f"(VALUES {rows}) AS catalog(category, severity, rule_id)"


@query("rule_coverage", with_views(DOC_MATCHES + f"""
SELECT catalog.rule_id, catalog.category, catalog.severity, count(matches.rule_id) AS hits
FROM {_catalog_sql()} LEFT JOIN matches ON matches.rule_id = catalog.rule_id GROUP BY ALL""", "files"))
def rule_coverage(spark, sf):
    """Every catalog rule with its number of hits."""
    hits = doc_matches(spark, sf).groupBy("rule_id").agg(F.count("*").alias("hits"))
    catalog = rules.rule_catalog(spark).select("rule_id", "category", F.coalesce("severity", F.lit("none")).alias("severity"))
    return F.broadcast(catalog).join(hits, "rule_id", "left").fillna(0, ["hits"])


@query("flatten_reports", with_views(DOC_MATCHES + f"""
SELECT 'File:' || file_path AS node_id, file_path, line, rule_id,
  CASE category {' '.join(f"WHEN {quote(k)} THEN {quote(v)}" for k, v in fv.CWE_BY_CATEGORY.items())} ELSE rule_id END AS selected_cwe_id,
  name AS selected_cwe_name, 'Critical' AS severity,
  'Detected by Layer 1 rule at line ' || line || ' of ' || file_path || '. ' || name || ' (' || replace(category, '_', ' ') || ')' AS root_cause, TRUE AS layer1_raw
FROM matches""", "files"))
def flatten_reports(spark, sf):
    return findings.flatten_to_reports(doc_matches(spark, sf)).select(
        "node_id", "file_path", "line", "rule_id", "selected_cwe_id", "selected_cwe_name", "severity", "root_cause", "layer1_raw")


@query("format_findings", with_views(DOC_MATCHES + """
SELECT file_path, line, rule_id, '  ⚠ [CRITICAL][regex] Line ' || line || ': ' || min(name) || ' — ' || left(min(name || ' (' || replace(category, '_', ' ') || ')'), 100) AS text
FROM matches GROUP BY file_path, line, rule_id""", "files"))
def format_findings(spark, sf):
    return findings.format_findings(doc_matches(spark, sf)).drop("repo")


@query("external_merge", with_views(DOC_MATCHES + """,
ext AS (SELECT repo, file_path, length(content) - length(replace(content, chr(10), '')) + 1 AS line FROM files),
both_ AS (SELECT repo, file_path, line, 'regex' AS source FROM matches UNION ALL SELECT repo, file_path, line, 'sarif' FROM ext)
SELECT repo, file_path, line, count(*) AS hits, count(DISTINCT source) AS sources FROM both_ GROUP BY ALL""", "files"))
def external_merge(spark, sf):
    """Rule hits and an external finding on the last line of every file, merged per line."""
    docs = spread(doc_files(spark, sf))
    external = docs.select(
        "repo", "file_path", (tx.count_newlines("content") + 1).alias("line"), F.lit(1).alias("column"),
        F.lit("ext/last-line").alias("rule_id"), F.lit(0).alias("match_seq"), F.lit("last line").alias("name"),
        F.lit("security").alias("category"), F.lit("warning").alias("severity"), F.lit("").alias("description"))
    merged = scan.merge_external(scan.scan_rules(docs, rules.rules_in(("core", "app"))), external)
    return merged.groupBy("repo", "file_path", "line").agg(
        F.count("*").alias("hits"), F.count_distinct("source").alias("sources"))


# --- masking and scalars ----------------------------------------------------------------------

def _mask_sql(column: str) -> str:
    out = column
    for pattern, replacement in fv.MASKS:
        out = f"regexp_replace({out}, {quote(pattern)}, {quote(replacement.replace('$1', chr(92) + '1'))}, 'g')"
    return out


@query("mask_secrets", f"""
WITH m AS (SELECT doc_id, text, {_mask_sql('text')} AS masked FROM documents)
SELECT doc_id, md5(masked) AS masked_md5, length(masked) AS n, masked <> text AS changed FROM m""")
def mask_secrets(spark, sf):
    d = spread(table(spark, sf, "documents").select("doc_id", "text"))
    return d.withColumn("masked", masking.mask_secrets("text")).select(
        "doc_id", F.md5("masked").alias("masked_md5"), F.length("masked").cast("long").alias("n"),
        (F.col("masked") != F.col("text")).alias("changed"))


@query("mask_nested", f"""
SELECT conv_id, turn, md5({_mask_sql('text')}) AS masked_md5 FROM conversations""")
def mask_nested(spark, sf):
    """Masking inside a nested column."""
    c = table(spark, sf, "conversations").select(
        "conv_id", "turn", F.struct(F.array(F.struct("role", "text")).alias("items"), F.col("turn").alias("n")).alias("v"))
    return masking.mask_columns(c, "v").select("conv_id", "turn", F.md5(F.col("v.items")[0]["text"]).alias("masked_md5"))


@query("mask_json", f"""
SELECT doc_id, md5({_mask_sql('text')}) AS masked_md5, 'password: kept' AS key_kept, lang AS rest FROM documents WHERE text IS NOT NULL""")
def mask_json(spark, sf):
    """Masking inside JSON text of unknown shape: only values change, at any depth."""
    d = spread(table(spark, sf, "documents").where("text IS NOT NULL")).select("doc_id", F.to_json(F.struct(
        F.array(F.struct("text")).alias("items"), F.create_map(F.lit("password: kept"), F.lit(1)).alias("keys"), "lang")).alias("j"))
    masked = d.select("doc_id", masking.mask_json_text("j").alias("j"))
    parsed = masked.withColumn("v", F.from_json("j", "items array<struct<text string>>, keys map<string, int>, lang string"))
    return parsed.select("doc_id", F.md5(F.col("v.items")[0]["text"]).alias("masked_md5"), F.map_keys("v.keys")[0].alias("key_kept"), F.col("v.lang").alias("rest"))


_WS = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x0B]"
_FLAT = f"regexp_replace(regexp_replace(text, {quote(_WS + '+')}, ' ', 'g'), '^ | $', '', 'g')"
_MARK = "chr(10) || chr(10) || '... [TRUNCATED: middle omitted to fit LLM context] ...' || chr(10) || chr(10)"


@query("truncate_and_shorten", f"""
SELECT doc_id, CASE WHEN length(text) <= 400 THEN text ELSE left(text, 200) || {_MARK} || right(text, 200) END AS middle,
  CASE WHEN length({_FLAT}) <= 160 THEN {_FLAT} ELSE left({_FLAT}, 157) || '...' END AS short,
  left(regexp_replace(regexp_replace(text, {quote(f'^{_WS}+|{_WS}+$')}, '', 'g'), {quote(r'[^\p{L}\p{N}\p{M}\p{Pc}.\-]+')}, '_', 'g'), 120) AS fragment
FROM documents""")
def truncate_and_shorten(spark, sf):
    d = spread(table(spark, sf, "documents"))
    return d.select("doc_id", tx.truncate_middle("text", 400).alias("middle"), tx.shorten("text").alias("short"),
                    tx.sanitize_fragment("text").alias("fragment"))


def _stripped(c: str) -> str:
    return (f"regexp_replace(regexp_replace(regexp_replace({c}, '(?s)/\\*.*?\\*/', '', 'g'), "
            f"{quote('(?m)^' + _WS + '*//.*$')}, '', 'g'), {quote('(?m)^' + _WS + '*#.*$')}, '', 'g')")


@query("strip_comments", "SELECT page_id, md5(" + _stripped("html") + ") AS page_md5, length(" + _stripped("html") + ") AS n FROM pages")
def strip_comments(spark, sf):
    p = spread(table(spark, sf, "pages")).withColumn("s", tx.strip_comments("html"))
    return p.select("page_id", F.md5("s").alias("page_md5"), F.length("s").cast("long").alias("n"))


@query("tokenize_counts", f"""
SELECT doc_id, len(list_distinct(list_transform(regexp_extract_all(text, {quote(fv.TOKEN_PATTERN)}), lambda x: lower(x)))) AS tokens,
  len(list_filter(list_distinct(list_concat(regexp_extract_all(text, '(?:^|[^\\p{{L}}\\p{{N}}_$])([A-Za-z_$][\\p{{L}}\\p{{N}}\\p{{M}}_$]*)\\s*\\(', 1), regexp_extract_all(text, '\\.([A-Za-z_$][\\p{{L}}\\p{{N}}\\p{{M}}_$]*)\\s*\\(', 1))),
    lambda x: x NOT IN {in_list(fv.CALL_KEYWORDS)})) AS calls
FROM documents""")
def tokenize_counts(spark, sf):
    d = spread(table(spark, sf, "documents").select("doc_id", "text"))
    return d.select("doc_id", F.size(tx.tokenize("text")).cast("long").alias("tokens"),
                    F.size(tx.call_tokens("text")).cast("long").alias("calls"))


_SAFE = f"(NOT {any_token('s', fv.UNSAFE_MARKERS)} AND {any_token('s', fv.SAFE_TOKENS)})"


@query("token_signals", f"""
WITH c AS (SELECT page_id, html, {_stripped('html')} AS s FROM pages)
SELECT page_id, {any_token('html', fv.SOURCE_TOKENS)} AS source, {any_token('html', fv.SINK_TOKENS)} AS sink,
  {_SAFE} AS safe, {_SAFE} AND {any_token('s', fv.PATH_GUARD_TOKENS)} AS guarded FROM c""")
def token_signals(spark, sf):
    p = spread(table(spark, sf, "pages"))
    return p.select("page_id", tx.has_any("html", fv.SOURCE_TOKENS).alias("source"),
                    tx.has_any("html", fv.SINK_TOKENS).alias("sink"),
                    tx.strong_safe_signal("html", F.lit("xss")).alias("safe"),
                    tx.strong_safe_signal("html", F.lit("ssrf")).alias("guarded"))


@query("line_windows", f"""
WITH l AS (SELECT doc_id, string_split(regexp_replace(text, '\\r?\\n\\z', ''), chr(10)) AS ls, string_split(text, chr(10)) AS raw, (doc_id % 9)::INTEGER AS n FROM documents)
SELECT doc_id, n, regexp_replace(coalesce(CASE WHEN n >= 1 THEN raw[n] END, ''), {quote(f'^{_WS}+|{_WS}+$')}, '', 'g') AS line_text,
  md5(array_to_string(ls[greatest(1, n - 2):n + 2], chr(10))) AS window_md5 FROM l""")
def line_windows(spark, sf):
    d = table(spark, sf, "documents").withColumn("n", (F.col("doc_id") % 9).cast("int"))
    return d.select("doc_id", "n", tx.line_at("text", "n").alias("line_text"), F.md5(tx.line_window("text", "n", 2)).alias("window_md5"))


# --- paths ------------------------------------------------------------------------------------
_NAME = "regexp_extract(file_path, '[^/]*$')"
_SUFFIX = f"regexp_extract({_NAME}, '^.+(\\.[^.]+)$', 1)"
_PARTS = "string_split(file_path, '/')"


def parts_in(values, column=_PARTS) -> str:
    return f"list_has_any({column}, [{', '.join(quote(v) for v in values)}])"


@query("path_filters", with_views(f"""
SELECT doc_id, file_path, ({_NAME} IN {in_list(fv.SCAN_FILENAMES)} OR lower({_SUFFIX}) IN {in_list(fv.SCAN_EXTENSIONS)}) AS scanned,
  ({parts_in(fv.SKIP_PARTS)} OR starts_with(lower({_NAME}), 'test_') OR starts_with(lower({_NAME}), 'conftest')) AS skipped,
  ({parts_in(fv.IGNORED_PARTS, 'string_split(lower(file_path), chr(47))')} OR {' OR '.join(f"contains(lower(file_path), {quote(f)})" for f in fv.IGNORED_FRAGMENTS)}) AS ignored,
  ({parts_in(fv.NON_RUNTIME_PARTS, 'string_split(lower(file_path), chr(47))')} OR regexp_matches(lower({_NAME}), '(^|[._-])(test|spec)([._-]|$)')) AS nonruntime,
  {parts_in(fv.RUNTIME_PARTS, 'string_split(lower(file_path), chr(47))')} AS runtime,
  (NOT {parts_in(fv.SOURCE_SKIP_PARTS)} AND lower({_SUFFIX}) IN {in_list(fv.SOURCE_EXTENSIONS)}) AS benchmark_source
FROM files""", "files"))
def path_filters(spark, sf):
    d = doc_files(spark, sf)
    return d.select("doc_id", "file_path", px.should_scan_file("file_path").alias("scanned"),
                    px.should_skip_path("file_path").alias("skipped"), px.should_ignore_file("file_path").alias("ignored"),
                    px.is_nonruntime_path("file_path").alias("nonruntime"),
                    px.is_runtime_likely_path("file_path").alias("runtime"),
                    px.benchmark_source_file("file_path").alias("benchmark_source"))


@query("select_scan_files", with_views(f"""
SELECT doc_id, file_path FROM files WHERE ({_NAME} IN {in_list(fv.SCAN_FILENAMES)} OR lower({_SUFFIX}) IN {in_list(fv.SCAN_EXTENSIONS)})
  AND NOT ({parts_in(fv.SKIP_PARTS)} OR starts_with(lower({_NAME}), 'test_') OR starts_with(lower({_NAME}), 'conftest'))""", "files"))
def select_scan_files(spark, sf):
    return file_sources.select_scan_files(doc_files(spark, sf)).select("doc_id", "file_path")


@query("normalize_paths", with_views("""
, w AS (SELECT doc_id, './' || replace(repo || '/' || file_path, '/', chr(92)) AS raw FROM files),
n AS (SELECT doc_id, regexp_replace(replace(raw, chr(92), '/'), '^\\./', '') AS path FROM w)
SELECT doc_id, path, CASE WHEN string_split(path, '/')[1] IN ('src1', 'src2', 'src3') THEN string_split(path, '/')[1] END AS repo,
  CASE WHEN string_split(path, '/')[1] IN ('src1', 'src2', 'src3') THEN array_to_string(string_split(path, '/')[2:], '/') END AS file_path FROM n""", "files"))
def normalize_paths(spark, sf):
    raw = F.concat(F.lit("./"), F.replace(F.concat_ws("/", F.col("source"), doc_path()), F.lit("/"), F.lit("\\")))
    d = table(spark, sf, "documents").select("doc_id", raw.alias("raw"))
    return d.withColumn("p", px.infer_repo_and_path("raw", ["src1", "src2", "src3"])).select(
        "doc_id", px.normalize_path("raw").alias("path"), F.col("p.repo").alias("repo"), F.col("p.file_path").alias("file_path"))


@query("node_identifiers", with_views("""
SELECT id, CASE WHEN contains(id, ':') THEN string_split(id, ':')[2] END AS path,
  CASE WHEN regexp_matches(id, '^(File|Function|Class|Method):') THEN 'File:' || string_split(id, ':')[2] ELSE id END AS file_id,
  CASE WHEN regexp_matches(id, '^(File|Function|Class|Method):') THEN string_split(id, ':')[2] ELSE '' END AS symbol_path,
  string_split(coalesce(name, ''), '#')[1] AS display_name,
  CASE WHEN coalesce(file_path, '') <> '' THEN 'File:' || file_path WHEN regexp_matches(id, '^(File|Function|Class|Method):') THEN 'File:' || string_split(id, ':')[2] ELSE 'File:' || id END AS extracted
FROM nodes""", "nodes"))
def node_identifiers(spark, sf):
    return nodes(spark, sf).select(
        "id", px.node_file_path("id").alias("path"), px.to_file_node_id("id").alias("file_id"),
        px.symbol_file_path("id").alias("symbol_path"), px.display_name("name").alias("display_name"),
        px.extract_node_id("file_path", "id").alias("extracted"))


@query("url_host", """
SELECT page_id, regexp_replace(lower(regexp_extract(CASE WHEN starts_with(url, 'http://') OR starts_with(url, 'https://') THEN url ELSE 'http://' || url END,
  '^https?://(?:[^/@]*@)?([^/:?#]+)', 1)), '^www\\.', '') AS host FROM pages""")
def url_host(spark, sf):
    return table(spark, sf, "pages").select("page_id", px.url_host("url").alias("host"))


@query("url_id", "SELECT page_id, translate(rtrim(to_base64(encode(url)), '='), '+/', '-_') AS url_id FROM pages")
def url_id(spark, sf):
    return table(spark, sf, "pages").select("page_id", px.url_id("url").alias("url_id"))


# --- vectors ----------------------------------------------------------------------------------

@query("softmax_argmax", """
WITH l AS (SELECT vec_id, list_transform(embedding[1:2], lambda x: x::DOUBLE) AS v FROM embeddings),
e AS (SELECT vec_id, list_transform(v, lambda x: exp(x - greatest(v[1], v[2]))) AS e FROM l),
p AS (SELECT vec_id, list_transform(e, lambda x: x / (e[1] + e[2])) AS p FROM e)
SELECT vec_id, CASE WHEN p[2] > p[1] THEN 1 ELSE 0 END AS label_id, CASE WHEN p[2] > p[1] THEN 'VULNERABLE' ELSE 'SAFE' END AS label,
  round(greatest(p[1], p[2]), 6) AS confidence, round(p[2], 6) AS vulnerable_probability FROM p""")
def softmax_argmax(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", vx.softmax(F.slice("embedding", 1, 2)).alias("p"))
    r = e.withColumn("r", vx.classify("p"))
    return r.select("vec_id", "r.label_id", "r.label", F.round("r.confidence", 6).alias("confidence"),
                    F.round(F.col("r.prob_by_label_id")[1], 6).alias("vulnerable_probability"))


@query("mrl_normalize", """
WITH h AS (SELECT vec_id, list_transform(embedding[1:32], lambda x: x::DOUBLE) AS v FROM embeddings),
n AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM h)
SELECT vec_id, round(v[1] / n, 6) AS first_value, round(v[32] / n, 6) AS last_value, len(v) AS dims FROM n""")
def mrl_normalize(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", vx.mrl_normalize("embedding", 32).alias("v"))
    return e.select("vec_id", F.round(F.col("v")[0], 6).alias("first_value"), F.round(F.col("v")[31], 6).alias("last_value"),
                    F.size("v").cast("long").alias("dims"))


@query("repo_fingerprint", with_views("""
, visible AS (SELECT repo, file_path, content FROM files),
head AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY file_path) AS r FROM visible)
SELECT repo, sha256(string_agg(content, '' ORDER BY file_path)) AS fingerprint, count(*) AS files FROM head WHERE r <= 100 GROUP BY repo""", "files"))
def repo_fingerprint(spark, sf):
    """As the reference reads it: the first 100 files."""
    return file_sources.repo_fingerprint(doc_files(spark, sf), 100)


@query("repo_fingerprint_full", with_views("""
SELECT repo, md5(sum(CAST('0x' || left(sha256(file_path || '|' || sha256(content)), 15) AS HUGEINT))::VARCHAR || ':' || count(*)) AS fingerprint, count(*) AS files FROM files GROUP BY repo""", "files"))
def repo_fingerprint_full(spark, sf):
    return file_sources.repo_fingerprint_full(doc_files(spark, sf))


@query("choose_repos", with_views("SELECT repo, count(*) AS n FROM files WHERE repo IN ('src2', 'src5') GROUP BY repo", "files"))
def choose_repos(spark, sf):
    return evaluation.frequency(file_sources.choose_repos(doc_files(spark, sf), ["src2", "src5", "missing"]), "repo")


@query("choose_repos_fallback", with_views("SELECT repo, count(*) AS n FROM files GROUP BY repo", "files"))
def choose_repos_fallback(spark, sf):
    return evaluation.frequency(file_sources.choose_repos(doc_files(spark, sf), ["missing"]), "repo")
