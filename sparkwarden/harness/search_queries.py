"""Search, listings and dashboards."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkwarden.harness.registry import query
from sparkwarden.harness.text_queries import quote
from sparkwarden.harness.views import cves, nodes, spread, table, with_views
from sparkwarden.operators import dashboards, search

_COSINE = "1 - list_sum(list_transform(list_zip({a}, {b}), lambda p: p[1]::DOUBLE * p[2]::DOUBLE)) / (sqrt(list_sum(list_transform({a}, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform({b}, lambda x: x::DOUBLE * x::DOUBLE))))"
_VECTOR = f"""
, q AS (SELECT embedding AS v FROM embeddings ORDER BY vec_id LIMIT 1),
vt AS (SELECT vec_id AS id, {_COSINE.format(a='embedding', b='q.v')} AS distance FROM embeddings CROSS JOIN q),
vr AS (SELECT id, distance, row_number() OVER (ORDER BY distance, id) - 1 AS rank FROM vt QUALIFY rank < 50)"""
_WORDS = ["the", "and", "token", "of"]
_QUERY = " ".join(_WORDS)
_IN = "[" + ", ".join(quote(w) for w in _WORDS) + "]"


def _terms(column: str) -> str:
    return r"regexp_extract_all(lower(" + column + r"), '[\p{L}\p{N}\p{M}\p{Pc}]+')"


_FULLTEXT = f"""
, ts AS (SELECT doc_id AS id, len(list_filter({_terms("lang || ' ' || source")}, lambda t: list_contains({_IN}, t))) * 1.0::DOUBLE + len(list_filter({_terms('text')}, lambda t: list_contains({_IN}, t))) * 0.4::DOUBLE AS score FROM documents),
tr AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) - 1 AS rank FROM ts WHERE score > 0 QUALIFY rank < 50)"""


def _first_vector(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.agg(F.min_by("embedding", "vec_id").alias("v")).scalar()


def _records(spark, sf):
    return spread(table(spark, sf, "documents")).select(
        F.col("doc_id").alias("id"), F.concat_ws(" ", "lang", "source").alias("title"), F.col("text").alias("description"))


def _vectors(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return search.vector_topk(e, _first_vector(spark, sf).cast("array<double>"), 50)


@query("vector_topk", "WITH unused AS (SELECT 1 AS one)" + _VECTOR + "SELECT id, rank::INTEGER AS rank, round(distance, 6) AS distance FROM vr")
def vector_topk(spark, sf):
    return _vectors(spark, sf).select("id", F.col("rank").cast("int").alias("rank"), F.round("distance", 6).alias("distance"))


@query("vector_topk_by_label", f"""
WITH q AS (SELECT embedding AS v FROM embeddings ORDER BY vec_id LIMIT 1),
t AS (SELECT vec_id AS id, {_COSINE.format(a='embedding', b='q.v')} AS distance FROM embeddings CROSS JOIN q WHERE label IN (1, 2))
SELECT id, round(distance, 6) AS distance FROM t ORDER BY t.distance, id LIMIT 20""")
def vector_topk_by_label(spark, sf):
    """Filtered nearest neighbours (the label plays the year)."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding", F.col("label").alias("year"))
    found = search.vector_topk(e, _first_vector(spark, sf).cast("array<double>"), 20, year=[1, 2])
    return found.select("id", F.round("distance", 6).alias("distance"))


@query("vector_topk_batch", f"""
WITH q AS (SELECT vec_id AS query_id, embedding AS v FROM embeddings WHERE vec_id % 100 = 0),
t AS (SELECT query_id, vec_id AS id, {_COSINE.format(a='embedding', b='q.v')} AS distance FROM embeddings CROSS JOIN q),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) - 1 AS rank FROM t)
SELECT query_id, id, round(distance, 6) AS distance, rank::INTEGER AS rank FROM r WHERE rank < 50""")
def vector_topk_batch(spark, sf):
    """The fifty nearest records of every hundredth vector (itself among them)."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    asked = e.filter(F.col("id") % 100 == 0).withColumnRenamed("id", "query_id")
    found = search.vector_topk_batch(e, asked, 50)
    return found.select("query_id", "id", (F.round("distance", 6) + F.lit(0.0)).alias("distance"), F.col("rank").cast("int").alias("rank"))


@query("fulltext_topk", "WITH unused AS (SELECT 1 AS one)" + _FULLTEXT + "SELECT id, rank::INTEGER AS rank, round(score, 6) AS score FROM tr")
def fulltext_topk(spark, sf):
    return search.fulltext_topk(_records(spark, sf), _QUERY).select("id", F.col("rank").cast("int").alias("rank"), F.round("score", 6).alias("score"))


@query("fulltext_topk_batch", f"""
WITH q AS (SELECT DISTINCT item_id, unnest({_terms('text')}) AS word FROM benchmark),
w AS (SELECT doc_id, word, sum(wt) AS wt FROM (SELECT doc_id, unnest({_terms('source')}) AS word, 1.0::DOUBLE AS wt FROM documents UNION ALL SELECT doc_id, unnest({_terms('text')}), 0.4::DOUBLE FROM documents) GROUP BY ALL),
s AS (SELECT item_id, doc_id, round(sum(wt), 4) AS score FROM q JOIN w USING (word) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) - 1 AS rank FROM s)
SELECT item_id, doc_id, score, rank::INTEGER AS rank FROM r WHERE rank < 10""")
def fulltext_topk_batch(spark, sf):
    docs = spread(table(spark, sf, "documents")).select("doc_id", F.col("source").alias("title"), F.col("text").alias("description"))
    queries = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    found = search.fulltext_topk_batch(docs, queries, 10, key="doc_id", digits=4)
    return found.select(F.col("query_id").alias("item_id"), "doc_id", "score", F.col("rank").cast("int").alias("rank"))


_FUSED = """
, u AS (SELECT id, rank, 0 AS list FROM vr UNION ALL SELECT id, rank, 1 FROM tr),
f AS (SELECT id, sum(1.0::DOUBLE / (61 + rank)) AS score, min((list, rank)) AS first FROM u GROUP BY id ORDER BY score DESC, first, id LIMIT 10)"""


@query("rank_fusion", "WITH unused AS (SELECT 1 AS one)" + _VECTOR + _FULLTEXT + _FUSED + "SELECT id, round(score, 9) AS score FROM f")
def rank_fusion(spark, sf):
    text = search.fulltext_topk(_records(spark, sf), _QUERY)
    return search.reciprocal_rank_fusion([_vectors(spark, sf), text], top=10).select("id", F.round("score", 9).alias("score"))


@query("fused_list_sides", "WITH unused AS (SELECT 1 AS one)" + _VECTOR + _FULLTEXT + """
SELECT coalesce(vr.id, tr.id) AS id, vr.rank::INTEGER AS vector_rank, tr.rank::INTEGER AS text_rank FROM vr FULL JOIN tr ON vr.id = tr.id""")
def fused_list_sides(spark, sf):
    """Both lists side by side."""
    v = _vectors(spark, sf).select("id", F.col("rank").cast("int").alias("vector_rank"))
    t = search.fulltext_topk(_records(spark, sf), _QUERY).select("id", F.col("rank").cast("int").alias("text_rank"))
    return v.join(t, "id", "full")


def _hybrid_records(spark, sf):
    docs = _records(spark, sf)
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return docs.join(vectors, "id", "left")


@query("hybrid_search", f"""
WITH unused AS (SELECT 1 AS one)
, q AS (SELECT embedding AS v FROM embeddings ORDER BY vec_id LIMIT 1),
vt AS (SELECT vec_id AS id, {_COSINE.format(a='embedding', b='q.v')} AS distance FROM embeddings CROSS JOIN q WHERE vec_id IN (SELECT doc_id FROM documents)),
vr AS (SELECT id, distance, row_number() OVER (ORDER BY distance, id) - 1 AS rank FROM vt QUALIFY rank < 50)""" + _FULLTEXT + _FUSED + "SELECT id, round(score, 9) AS score FROM f")
def hybrid_search(spark, sf):
    records = _hybrid_records(spark, sf)
    found = search.hybrid_search(records, _QUERY, _first_vector(spark, sf).cast("array<double>"))
    return found.select("id", F.round("score", 9).alias("score"))


@query("exact_id_search", with_views("""
, q AS (SELECT l_orderkey AS query_id, 'see cve-' || year(o_orderdate) || '-' || lpad(l_orderkey::VARCHAR, 7, '0') || ' and CVE-1999-00001' AS t FROM (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_linenumber = 1) JOIN orders ON o_orderkey = l_orderkey),
e AS (SELECT query_id, unnest(list_distinct(list_transform(regexp_extract_all(t, '(?i)cve-\\d{4}-\\d{4,7}'), lambda x: upper(x)))) AS id FROM q)
SELECT query_id, e.id, left(description, 300) || '...' AS description FROM e JOIN cves ON cves.id = e.id""", "cves"))
def exact_id_search(spark, sf):
    first = table(spark, sf, "lineitem").filter(F.col("l_linenumber") == 1).select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    q = first.join(table(spark, sf, "orders"), "o_orderkey").select(F.col("o_orderkey").alias("query_id"), F.concat(
        F.lit("see cve-"), F.year("o_orderdate").cast("string"), F.lit("-"), F.lpad(F.col("o_orderkey").cast("string"), 7, "0"), F.lit(" and CVE-1999-00001")).alias("query"))
    return search.exact_id_search(q, cves(spark, sf)).select("query_id", "id", "description")


@query("hybrid_exact_first", with_views("SELECT id, 1.0::DOUBLE AS score FROM cves WHERE id IN (SELECT min(id) FROM cves UNION SELECT max(id) FROM cves)", "cves"))
def hybrid_exact_first(spark, sf):
    """A query that names ids skips ranking."""
    c = cves(spark, sf)
    # The ids come from the data: the first and the last one.
    ends = c.agg(F.concat_ws(" ", F.min("id"), F.max("id")).alias("q"))
    asked = ends.select(F.lit(1).alias("query_id"), F.col("q").alias("query"))
    return search.exact_id_search(asked, c).select("id", F.lit(1.0).alias("score"))


@query("search_nodes", with_views(r"""
, s AS (SELECT id, len(list_filter(regexp_extract_all(lower(coalesce(name, '')), '[\p{L}\p{N}\p{M}\p{Pc}]+'), lambda t: t IN ('red', 'ring'))) * 1.0::DOUBLE AS score FROM nodes)
SELECT id, score FROM s WHERE score > 0 ORDER BY score DESC, id LIMIT 10""", "nodes"))
def search_nodes(spark, sf):
    return search.search_nodes(nodes(spark, sf), "red ring").select("id", "score")


@query("chat_context", with_views("""
SELECT id, '[Vulnerability: ' || id || ']' || chr(10) || '- Title: ' || title || chr(10) || '- CVSS: ' || (o_orderkey % 100)::DOUBLE || chr(10) || '- Product: ' || vendor_product || chr(10) || '- Published: ' || year || chr(10) || '- Description: ' || description || chr(10) || '---' || chr(10) AS block
FROM cves WHERE o_orderkey % 100 <> 0 UNION ALL
SELECT id, '[Vulnerability: ' || id || ']' || chr(10) || '- Title: ' || title || chr(10) || '- CVSS: N/A' || chr(10) || '- Product: ' || vendor_product || chr(10) || '- Published: ' || year || chr(10) || '- Description: ' || description || chr(10) || '---' || chr(10) FROM cves WHERE o_orderkey % 100 = 0""", "cves"))
def chat_context(spark, sf):
    c = cves(spark, sf).withColumn("cvss_score", (F.col("o_orderkey") % 100).cast("double")).withColumn("published_date", F.col("year"))
    return search.chat_context(c)


# --- listings ---------------------------------------------------------------------------------
_VENDOR = "'Vendor ' || upper(split_part(split_part(vendor_product, ',', 1), '_', 2)) || ' ' || split_part(split_part(vendor_product, ',', 2), '_', 2)"


@query("cve_list_page", with_views(f"""
, f AS (SELECT * FROM cves WHERE contains(lower(title), 'urgent') OR contains(lower(vendor_product), 'urgent'))
SELECT id, title, cvss_score, published_date, {_VENDOR} AS vendor_product, (SELECT count(*) FROM f) AS total FROM f ORDER BY published_date DESC NULLS LAST, id LIMIT 20 OFFSET 20""", "cves"))
def cve_list_page(spark, sf):
    return dashboards.cve_list(cves(spark, sf), "Urgent", 2).select("id", "title", "cvss_score", "published_date", "vendor_product", "total")


@query("cve_list_by_id", with_views("""
, f AS (SELECT * FROM cves WHERE starts_with(id, 'CVE-1998-'))
SELECT id, published_date, (SELECT count(*) FROM f) AS total FROM f ORDER BY published_date DESC NULLS LAST, id LIMIT 50""", "cves"))
def cve_list_by_id(spark, sf):
    return dashboards.cve_list(cves(spark, sf), "cve-1998-", 1, 50).select("id", "published_date", "total")


@query("cves_by_date", with_views("""
SELECT id, title, cvss_score, vendor_product FROM cves WHERE year(published_date) = 1998 AND month(published_date) = 10 AND day(published_date) = 3 ORDER BY cvss_score DESC NULLS LAST, id LIMIT 50""", "cves"))
def cves_by_date(spark, sf):
    return dashboards.cves_by_date(cves(spark, sf), 1998, 10, 3)


@query("severity_histogram", with_views("SELECT CASE WHEN severity IS NULL OR trim(severity) = '' OR upper(severity) = 'N/A' THEN 'UNKNOWN' ELSE upper(severity) END AS severity, count(*) AS n FROM cves GROUP BY 1", "cves"))
def severity_histogram(spark, sf):
    return dashboards.severity_histogram(cves(spark, sf))


@query("cve_trend_year", with_views("SELECT year(published_date)::INTEGER AS label, count(*) AS n FROM cves GROUP BY 1", "cves"))
def cve_trend_year(spark, sf):
    return dashboards.cve_trend(cves(spark, sf), "all")


@query("cve_trend_month", with_views("SELECT month(published_date)::INTEGER AS label, count(*) AS n FROM cves WHERE year(published_date) = 1997 GROUP BY 1", "cves"))
def cve_trend_month(spark, sf):
    return dashboards.cve_trend(cves(spark, sf), 1997)


@query("cve_trend_day", with_views("SELECT day(published_date)::INTEGER AS label, count(*) AS n FROM cves WHERE year(published_date) = 1997 AND month(published_date) = 12 GROUP BY 1", "cves"))
def cve_trend_day(spark, sf):
    """Days of one month, from dates stored as text."""
    text = cves(spark, sf).withColumn("published_date", F.col("published_date").cast("string"))
    return dashboards.cve_trend(text, "1997", "12")


@query("cve_trend_sets", with_views("""
SELECT year(published_date)::INTEGER AS y, month(published_date)::INTEGER AS m, day(published_date)::INTEGER AS d, count(*) AS n FROM cves
GROUP BY GROUPING SETS ((year(published_date)), (year(published_date), month(published_date)), (year(published_date), month(published_date), day(published_date)))""", "cves"))
def cve_trend_sets(spark, sf):
    return dashboards.cve_trend_sets(cves(spark, sf))


@query("linear_trend", with_views("""
, t AS (SELECT year(published_date) * 12 + month(published_date) AS label, count(*) AS n FROM cves GROUP BY 1),
x AS (SELECT n, row_number() OVER (ORDER BY label) - 1 AS x FROM t)
SELECT round(regr_slope(n, x), 6) AS slope, round(regr_intercept(n, x), 6) AS intercept FROM x""", "cves"))
def linear_trend(spark, sf):
    months = cves(spark, sf).groupBy((F.year("published_date") * 12 + F.month("published_date")).alias("label")).agg(F.count("*").alias("n"))
    return dashboards.linear_trend(months).select(F.round("slope", 6).alias("slope"), F.round("intercept", 6).alias("intercept"))


@query("top_products", """
WITH p AS (SELECT lower(p_name || ' ' || p_type || '_' || p_type || ' ' || p_name) AS v FROM part),
w AS (SELECT string_split(replace(v, '_', ' '), ' ') AS ws FROM p),
c AS (SELECT list_filter(ws, lambda x, i: i = 1 OR x <> ws[i - 1]) AS ws FROM w)
SELECT array_to_string(list_transform(ws, lambda x: upper(x[1]) || x[2:]), ' ') AS vendor_product, count(*)::BIGINT AS n FROM c GROUP BY 1 ORDER BY n DESC, 1 LIMIT 5""")
def top_products(spark, sf):
    p = table(spark, sf, "part").select(F.lower(F.concat("p_name", F.lit(" "), "p_type", F.lit("_"), "p_type", F.lit(" "), "p_name")).alias("vendor_product"))
    return dashboards.top_products(p)


@query("clean_vendor", """
WITH w AS (SELECT p_partkey, string_split(lower(replace(replace(p_name || ',' || p_type || '_' || p_name, ',', ' '), '_', ' ')), ' ') AS ws FROM part),
d AS (SELECT p_partkey, list_filter(ws, lambda x, i: list_position(ws, x) = i) AS ws FROM w)
SELECT p_partkey, array_to_string(list_transform(ws, lambda x: upper(x[1]) || x[2:]), ' ') AS vendor FROM d""")
def clean_vendor(spark, sf):
    return table(spark, sf, "part").select("p_partkey", dashboards.clean_vendor(F.concat("p_name", F.lit(","), "p_type", F.lit("_"), "p_name")).alias("vendor"))


@query("cwe_history", with_views("""
, b AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_partkey = 7)
SELECT id, coalesce(cvss_score, 0) AS score, description AS "desc", (SELECT p_name FROM part WHERE p_partkey = 7) AS cwe_name FROM cves JOIN b ON l_orderkey = o_orderkey ORDER BY cvss_score DESC NULLS LAST, id LIMIT 15""", "cves"))
def cwe_history(spark, sf):
    c = cves(spark, sf)
    bridge = table(spark, sf, "lineitem").select(F.concat(F.lit("CWE-"), F.col("l_partkey").cast("string")).alias("cwe_id"), F.col("l_orderkey").alias("cve_id")).distinct()
    names = table(spark, sf, "part").select(F.concat(F.lit("CWE-"), F.col("p_partkey").cast("string")).alias("cwe_id"), F.col("p_name").alias("cwe_name"))
    keyed = c.withColumn("cve", F.col("id")).withColumn("id", F.col("o_orderkey"))
    found = dashboards.cwe_history(keyed, bridge, names, "cwe-7")
    return found.join(c.select("o_orderkey", F.col("id").alias("cve")), F.col("id") == F.col("o_orderkey")).select(F.col("cve").alias("id"), "score", "desc", "cwe_name")


@query("critical_recent", """
WITH e AS (SELECT event_id, ts, CASE event_type WHEN 'error' THEN 'critical' ELSE 'low' END AS severity FROM events)
SELECT event_id AS id, ts AS published_date FROM e WHERE severity = 'critical' AND ts >= (SELECT max(ts) FROM e) - INTERVAL 20 DAYS ORDER BY ts, event_id LIMIT 5""")
def critical_recent(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("published_date"), F.when(F.col("event_type") == "error", "critical").otherwise("low").alias("severity"))
    return dashboards.critical_recent(e, 20).select("id", "published_date")


@query("blog_list", """
SELECT doc_id AS id, n_chars, (SELECT count(*) FROM documents) AS total_items, ceil((SELECT count(*) FROM documents) / 9.0)::BIGINT AS total_pages, 3 AS current_page, TRUE AS has_next_page, TRUE AS has_prev_page
FROM documents ORDER BY n_chars DESC, doc_id LIMIT 9 OFFSET 18""")
def blog_list(spark, sf):
    posts = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "n_chars")
    return dashboards.blog_list(posts, 3, order="n_chars").drop("items_per_page")


@query("get_by_id", "SELECT conv_id, turn, role FROM conversations WHERE conv_id = 3 AND role = 'user'")
def get_by_id(spark, sf):
    return dashboards.get_by_id(table(spark, sf, "conversations"), "conv_id", 3, ("role", "user"), ("text",))


@query("recent_messages", """
SELECT conv_id, turn, role, k::INTEGER AS back, left(text, 30) || CASE WHEN length(text) > 30 THEN '...' ELSE '' END AS title
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations) WHERE k <= 4""")
def recent_messages(spark, sf):
    m = dashboards.recent_messages(table(spark, sf, "conversations"))
    return m.select("conv_id", "turn", "role", "back", dashboards.conversation_title("text").alias("title"))


@query("conversation_counts", "SELECT role, count(*) AS messages, count(DISTINCT conv_id) AS conversations FROM conversations GROUP BY role")
def conversation_counts(spark, sf):
    return dashboards.conversation_counts(table(spark, sf, "conversations"))


@query("conversation_summaries", """
WITH f AS (SELECT conv_id, count(*) AS messages, min(turn) FILTER (role = 'user') AS t FROM conversations GROUP BY conv_id)
SELECT f.conv_id, messages, left(text, 30) || CASE WHEN length(text) > 30 THEN '...' ELSE '' END AS title FROM f LEFT JOIN conversations c ON c.conv_id = f.conv_id AND c.turn = f.t AND c.role = 'user'""")
def conversation_summaries(spark, sf):
    return dashboards.conversation_summaries(table(spark, sf, "conversations"))


@query("conversations_for_user", """
SELECT user_id AS conversation_id, event_type AS title, ts AS updated_at FROM events WHERE user_id = 8""")
def conversations_for_user(spark, sf):
    c = table(spark, sf, "events").select("user_id", F.col("user_id").alias("conversation_id"), F.col("event_type").alias("title"), F.col("ts").alias("updated_at"))
    return dashboards.conversations_for_user(c, 8)


@query("latest_state", "SELECT user_id, max(ts) AS ts, arg_max(event_type, (ts, event_type, value)) AS event_type, arg_max(value, (ts, event_type, value)) AS value FROM events GROUP BY user_id")
def latest_state(spark, sf):
    return dashboards.latest_state(table(spark, sf, "events"), "user_id", "ts", "event_type", "value")
