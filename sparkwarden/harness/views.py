"""Domain tables bound to the driver's tables, in Spark and as SQL text for the checker.

Every view derives from whole tables.  ``SQL`` holds the same definitions for the checking engine;
``with_views`` puts the ones a statement needs in front of it.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwarden.operators.code import build_functions
from sparkwarden.session import stored

REPO = "tpch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Use all cores for a small input that arrives in fewer splits than there are cores.

    Large inputs have more splits than cores and pass through untouched, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _c(name: str) -> Column:
    return F.col(name)


def _ids() -> dict[str, Column]:
    segment = F.concat(F.lit("seg/"), F.lower("c_mktsegment"), F.lit(".py"))
    orders = F.concat(F.lit("ord/p"), F.left(_c("o_orderpriority"), F.lit(1)), F.lit(".py"))
    brand = F.concat(F.lit("brand/"), F.lower(F.replace(_c("p_brand"), F.lit("#"), F.lit(""))), F.lit(".py"))
    supplier = _text("sup/n", _c("s_nationkey"), ".py")
    return {
        "seg": segment, "ord": orders, "brand": brand, "sup": supplier,
        "customer": _text("Class:", segment, ":C", _c("c_custkey")),
        "order": _text("Function:", orders, ":O", _c("o_orderkey")),
        "part": _text("Method:", brand, ":P", _c("p_partkey")),
        "supplier": _text("Function:", supplier, ":S", _c("s_suppkey")),
        "nation": _text("Process:nation:", _c("n_nationkey")),
        "region": _text("Community:region:", _c("r_regionkey")),
    }


def _key(sf: str) -> str:
    return re.sub(r"[^A-Za-z0-9.]+", "_", sf).strip("_")


def nodes(spark: SparkSession, sf: str) -> DataFrame:
    """The graph is stored once per application, as its users find it stored in a database."""
    return stored(spark, f"{_key(sf)}/nodes", lambda: derive_nodes(spark, sf))


def relations(spark: SparkSession, sf: str) -> DataFrame:
    return stored(spark, f"{_key(sf)}/relations", lambda: derive_relations(spark, sf))


def derive_nodes(spark: SparkSession, sf: str) -> DataFrame:
    i = _ids()

    def rows(name: str, node_id: Column, label: str, title: Column, path: Column | None, start: Column | None,
             span: int = 0) -> DataFrame:
        path = F.lit(None).cast("string") if path is None else path
        begin = F.lit(None).cast("long") if start is None else start.cast("long")
        return table(spark, sf, name).select(
            F.lit(REPO).alias("repo_name"), node_id.alias("id"), F.lit(label).alias("label"), title.alias("name"),
            path.alias("file_path"), begin.alias("start_line"), (begin + span).alias("end_line"))

    symbols = (
        rows("customer", i["customer"], "Class", _c("c_name"), i["seg"], _c("c_custkey"), 9)
        .unionByName(rows("orders", i["order"], "Function", _text("order_", _c("o_orderkey"), "#2"), i["ord"], _c("o_orderkey"), 4))
        .unionByName(rows("part", i["part"], "Method", _c("p_name"), i["brand"], _c("p_partkey"), 2))
        .unionByName(rows("supplier", i["supplier"], "Function", _c("s_name"), i["sup"], _c("s_suppkey"), 3))
    )
    files = symbols.groupBy("repo_name", "file_path").agg(F.max("end_line").alias("end_line")).select(
        "repo_name", _text("File:", _c("file_path")).alias("id"), F.lit("File").alias("label"),
        F.substring_index("file_path", "/", -1).alias("name"), "file_path", F.lit(1).cast("long").alias("start_line"), "end_line")
    return (
        symbols.unionByName(files)
        .unionByName(rows("nation", i["nation"], "Process", _c("n_name"), None, None))
        .unionByName(rows("region", i["region"], "Community", _c("r_name"), None, None))
    )


def derive_relations(spark: SparkSession, sf: str) -> DataFrame:
    """Keys and the small columns that ids are made of meet; the ids themselves are made last.  Lines meet their order before they are
    grouped, so both need one shuffle."""
    i = _ids()
    t = lambda n: table(spark, sf, n)
    cust = t("customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    orders = t("orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.left("o_orderpriority", F.lit(1)).alias("o_orderpriority"))
    part = t("part").select("p_partkey", "p_brand")
    sup = t("supplier").select("s_suppkey", "s_nationkey")
    line = t("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_discount", "l_returnflag")

    def edge(df: DataFrame, a: Column, kind: str, b: Column, step: Column | int = -1, confidence: Column | float = 1.0) -> DataFrame:
        c = lambda x: x if isinstance(x, Column) else F.lit(x)
        return df.select(F.lit(REPO).alias("repo_name"), a.alias("from_id"), b.alias("to_id"),
                         F.lit(kind).alias("relation_type"), c(confidence).alias("confidence"), c(step).cast("int").alias("step"))

    of_order = ["l_orderkey", "o_orderkey", "o_orderpriority"]
    known = orders.select("o_orderkey", "o_orderpriority")
    uses = line.join(known, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(*of_order, "l_partkey", "l_linenumber").agg(
        F.min("l_discount").alias("disc")).join(part, F.col("l_partkey") == F.col("p_partkey"))
    supplies = line.select("l_suppkey", "l_partkey").distinct().join(
        sup, F.col("l_suppkey") == F.col("s_suppkey")).join(part, F.col("l_partkey") == F.col("p_partkey"))
    returns = line.filter(F.col("l_returnflag") == "R").join(known, F.col("l_orderkey") == F.col("o_orderkey")).select(
        *of_order, "l_suppkey").distinct().join(sup, F.col("l_suppkey") == F.col("s_suppkey"))
    bought = orders.join(cust, F.col("o_custkey") == F.col("c_custkey"))
    nation = t("nation")
    return (
        edge(bought, i["order"], "CALLS", i["customer"])
        .unionByName(edge(uses, i["part"], "CALLS", i["order"], F.col("l_linenumber"), F.col("disc")))
        .unionByName(edge(supplies, i["supplier"], "CALLS", i["part"]))
        .unionByName(edge(returns, i["supplier"], "IMPORTS", i["order"]))
        .unionByName(edge(cust, i["customer"], "STEP_IN_PROCESS", _text("Process:nation:", _c("c_nationkey")), F.col("c_custkey")))
        .unionByName(edge(nation, i["nation"], "MEMBER_OF", _text("Community:region:", _c("n_regionkey"))))
        .unionByName(edge(cust, _text("File:", i["seg"]), "DEFINES", i["customer"]))
        .unionByName(edge(orders.filter(F.col("o_orderstatus") == "P"), _text("File:", i["ord"]), "CALLS", i["order"]))
    )


def doc_path() -> Column:
    """Path of a document as a source file; folder and extension follow its id."""
    folder = F.element_at(F.array(*[F.lit(x) for x in ("src", "tests", "config", "node_modules/pkg", "app/routes", "docs", "latest")]),
                          (F.col("doc_id") % 7 + 1).cast("int"))
    name = F.element_at(F.array(*[F.lit(x) for x in ("mod", "test_mod", "settings", "a.spec")]), (F.col("doc_id") % 4 + 1).cast("int"))
    ext = F.element_at(F.array(*[F.lit(x) for x in (".py", ".js", ".md", ".yml", "")]), (F.col("doc_id") % 5 + 1).cast("int"))
    return _text(_c("lang"), "/", folder, "/", name, "_", _c("doc_id"), ext)


def doc_files(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(
        "doc_id", F.col("source").alias("repo"), doc_path().alias("file_path"), F.col("text").alias("content"))


def page_files(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select(
        "page_id", F.lit("web").alias("repo"), _text("p/", _c("page_id"), ".html").alias("file_path"), F.col("html").alias("content"))


def cves(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as vulnerability records."""
    return table(spark, sf, "orders").select(
        _text("CVE-", F.year("o_orderdate"), "-", F.lpad(_c("o_orderkey").cast("string"), 7, "0")).alias("id"),
        F.concat(F.lit("Order "), "o_orderkey", F.lit(" "), "o_orderpriority").alias("title"),
        F.concat(F.lit("status "), "o_orderstatus", F.lit(" customer "), F.col("o_custkey").cast("string")).alias("description"),
        F.concat(F.lit("vendor_"), F.lower("o_orderstatus"), F.lit(",vendor_"), (F.col("o_custkey") % 10).cast("string")).alias("vendor_product"),
        F.when(F.col("o_orderpriority").startswith("4"), F.lit("n/a")).otherwise(F.col("o_orderpriority")).alias("severity"),
        F.col("o_totalprice").alias("cvss_score"), F.col("o_orderdate").alias("published_date"),
        F.year("o_orderdate").alias("year"), "o_orderkey")


SQL: dict[str, str] = {
    "nodes": """
SELECT 'tpch' AS repo_name, 'Class:seg/' || lower(c_mktsegment) || '.py:C' || c_custkey AS id, 'Class' AS label, c_name AS name,
       'seg/' || lower(c_mktsegment) || '.py' AS file_path, c_custkey::BIGINT AS start_line, c_custkey::BIGINT + 9 AS end_line FROM customer
UNION ALL SELECT 'tpch', 'Function:ord/p' || left(o_orderpriority, 1) || '.py:O' || o_orderkey, 'Function', 'order_' || o_orderkey || '#2',
       'ord/p' || left(o_orderpriority, 1) || '.py', o_orderkey::BIGINT, o_orderkey::BIGINT + 4 FROM orders
UNION ALL SELECT 'tpch', 'Method:brand/' || lower(replace(p_brand, '#', '')) || '.py:P' || p_partkey, 'Method', p_name,
       'brand/' || lower(replace(p_brand, '#', '')) || '.py', p_partkey::BIGINT, p_partkey::BIGINT + 2 FROM part
UNION ALL SELECT 'tpch', 'Function:sup/n' || s_nationkey || '.py:S' || s_suppkey, 'Function', s_name,
       'sup/n' || s_nationkey || '.py', s_suppkey::BIGINT, s_suppkey::BIGINT + 3 FROM supplier
UNION ALL SELECT 'tpch', 'File:seg/' || lower(c_mktsegment) || '.py', 'File', lower(c_mktsegment) || '.py', 'seg/' || lower(c_mktsegment) || '.py', 1::BIGINT, max(c_custkey)::BIGINT + 9 FROM customer GROUP BY c_mktsegment
UNION ALL SELECT 'tpch', 'File:ord/p' || left(o_orderpriority, 1) || '.py', 'File', 'p' || left(o_orderpriority, 1) || '.py', 'ord/p' || left(o_orderpriority, 1) || '.py', 1::BIGINT, max(o_orderkey)::BIGINT + 4 FROM orders GROUP BY left(o_orderpriority, 1)
UNION ALL SELECT 'tpch', 'File:brand/' || lower(replace(p_brand, '#', '')) || '.py', 'File', lower(replace(p_brand, '#', '')) || '.py', 'brand/' || lower(replace(p_brand, '#', '')) || '.py', 1::BIGINT, max(p_partkey)::BIGINT + 2 FROM part GROUP BY p_brand
UNION ALL SELECT 'tpch', 'File:sup/n' || s_nationkey || '.py', 'File', 'n' || s_nationkey || '.py', 'sup/n' || s_nationkey || '.py', 1::BIGINT, max(s_suppkey)::BIGINT + 3 FROM supplier GROUP BY s_nationkey
UNION ALL SELECT 'tpch', 'Process:nation:' || n_nationkey, 'Process', n_name, NULL, NULL, NULL FROM nation
UNION ALL SELECT 'tpch', 'Community:region:' || r_regionkey, 'Community', r_name, NULL, NULL, NULL FROM region""",
    "oid": "SELECT o_orderkey, o_custkey, o_orderstatus, 'ord/p' || left(o_orderpriority, 1) || '.py' AS opath, 'Function:ord/p' || left(o_orderpriority, 1) || '.py:O' || o_orderkey AS oid FROM orders",
    "cid": "SELECT c_custkey, c_nationkey, 'seg/' || lower(c_mktsegment) || '.py' AS cpath, 'Class:seg/' || lower(c_mktsegment) || '.py:C' || c_custkey AS cid FROM customer",
    "pid": "SELECT p_partkey, 'Method:brand/' || lower(replace(p_brand, '#', '')) || '.py:P' || p_partkey AS pid FROM part",
    "sid": "SELECT s_suppkey, 'Function:sup/n' || s_nationkey || '.py:S' || s_suppkey AS sid FROM supplier",
    "relations": """
SELECT 'tpch' AS repo_name, oid AS from_id, cid AS to_id, 'CALLS' AS relation_type, 1.0::DOUBLE AS confidence, -1::INTEGER AS step FROM oid JOIN cid ON o_custkey = c_custkey
UNION ALL SELECT 'tpch', pid, oid, 'CALLS', min(l_discount), l_linenumber::INTEGER FROM lineitem JOIN oid ON l_orderkey = o_orderkey JOIN pid ON l_partkey = p_partkey GROUP BY pid, oid, l_linenumber
UNION ALL SELECT DISTINCT 'tpch', sid, pid, 'CALLS', 1.0::DOUBLE, -1::INTEGER FROM lineitem JOIN sid ON l_suppkey = s_suppkey JOIN pid ON l_partkey = p_partkey
UNION ALL SELECT DISTINCT 'tpch', sid, oid, 'IMPORTS', 1.0::DOUBLE, -1::INTEGER FROM lineitem JOIN sid ON l_suppkey = s_suppkey JOIN oid ON l_orderkey = o_orderkey WHERE l_returnflag = 'R'
UNION ALL SELECT 'tpch', cid, 'Process:nation:' || c_nationkey, 'STEP_IN_PROCESS', 1.0::DOUBLE, c_custkey::INTEGER FROM cid
UNION ALL SELECT 'tpch', 'Process:nation:' || n_nationkey, 'Community:region:' || n_regionkey, 'MEMBER_OF', 1.0::DOUBLE, -1::INTEGER FROM nation
UNION ALL SELECT 'tpch', 'File:' || cpath, cid, 'DEFINES', 1.0::DOUBLE, -1::INTEGER FROM cid
UNION ALL SELECT 'tpch', 'File:' || opath, oid, 'CALLS', 1.0::DOUBLE, -1::INTEGER FROM oid WHERE o_orderstatus = 'P'""",
    "files": """
SELECT doc_id, source AS repo, lang || '/' || (['src', 'tests', 'config', 'node_modules/pkg', 'app/routes', 'docs', 'latest'])[doc_id % 7 + 1] || '/'
       || (['mod', 'test_mod', 'settings', 'a.spec'])[doc_id % 4 + 1] || '_' || doc_id || (['.py', '.js', '.md', '.yml', ''])[doc_id % 5 + 1] AS file_path, text AS content FROM documents""",
    "cves": """
SELECT 'CVE-' || year(o_orderdate) || '-' || lpad(o_orderkey::VARCHAR, 7, '0') AS id, 'Order ' || o_orderkey || ' ' || o_orderpriority AS title,
       'status ' || o_orderstatus || ' customer ' || o_custkey AS description, 'vendor_' || lower(o_orderstatus) || ',vendor_' || (o_custkey % 10) AS vendor_product,
       CASE WHEN o_orderpriority LIKE '4%' THEN 'n/a' ELSE o_orderpriority END AS severity, o_totalprice AS cvss_score, o_orderdate AS published_date,
       year(o_orderdate)::INTEGER AS year, o_orderkey FROM orders""",
}
_NEEDS = {"relations": ("oid", "cid", "pid", "sid")}


def with_views(statement: str, *names: str, recursive: bool = False) -> str:
    """Put the definitions of the named views in front of a statement that may start with more
    common table expressions (``, x AS (...)``)."""
    wanted: list[str] = []
    for n in names:
        for d in (*_NEEDS.get(n, ()), n):
            if d not in wanted:
                wanted.append(d)
    head = ",\n".join(f"{n} AS ({SQL[n]})" for n in wanted)
    body = statement.strip()
    joint = "" if body.startswith(",") else "\n"
    return f"WITH {'RECURSIVE ' if recursive else ''}{head}{joint}{body}"


def hits(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as rule hits in long form."""
    s = F.col("l_suppkey")
    folder = F.when(s % 10 == 0, "node_modules/s").when(s % 10 == 1, "docs/s").otherwise("src/s")
    return table(spark, sf, "lineitem").select(
        F.concat(folder, s.cast("string"), F.lit(".py")).alias("file_path"), F.col("l_orderkey").cast("int").alias("line"),
        F.when(F.col("l_linenumber") == 7, "py/unused-import").otherwise(_text("rule-", _c("l_linenumber"))).alias("rule_id"),
        F.when(F.col("l_discount") < 0.02, "quality").when(F.col("l_tax") > 0.04, "hardcoded_secret").otherwise("other").alias("category"),
        F.when(F.col("l_returnflag") == "R", "critical").when(F.col("l_returnflag") == "A", "warning").otherwise("info").alias("severity"),
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")


def model_hits(spark: SparkSession, sf: str) -> DataFrame:
    """Expensive orders as layer-2 results."""
    return table(spark, sf, "orders").filter(F.col("o_totalprice") > 400000).select(
        _text("Function:src/s", F.col("o_custkey") % 100, ".py:f", _c("o_orderkey")).alias("file_path"), "o_orderkey",
        F.struct(F.lit(True).alias("ok"), F.col("o_orderpriority").alias("severity")).alias("result"))


def items(spark: SparkSession, sf: str) -> DataFrame:
    """Scan results: one layer-1 item per order (its lines are the findings) and the layer-2 items."""
    h = hits(spark, sf).groupBy("l_orderkey").agg(
        F.array_sort(F.collect_list(F.struct("line", "rule_id", "category", "severity", "l_suppkey"))).alias("x"))
    path = F.expr("""CASE WHEN l_orderkey % 11 = 0 THEN 'tests/o' WHEN l_orderkey % 11 = 1 THEN '' ELSE 'src/o' END""")
    rules = F.transform("x", lambda r: F.struct(r["line"].alias("line"), F.array(F.struct(
        r["rule_id"].alias("rule_id"), r["rule_id"].alias("name"), r["category"].alias("category"), r["severity"].alias("severity"))).alias("rules")))
    first = h.select(
        F.when(path == "", "").otherwise(F.concat(path, (F.col("l_orderkey") % 500).cast("string"), F.lit(".py"))).alias("file_path"),
        rules.alias("findings"), F.lit(1).alias("layer"), F.col("l_orderkey").alias("seq"))
    second = model_hits(spark, sf).select("file_path", "result", F.lit(2).alias("layer"), F.col("o_orderkey").alias("seq"))
    return first.unionByName(second, allowMissingColumns=True)


def code_files(spark: SparkSession, sf: str) -> DataFrame:
    """Source files written from the sales tables: Python per order and customer, script per supplier."""
    order = table(spark, sf, "orders").select(_text("ord/o", _c("o_orderkey"), ".py").alias("file_path"), _text(
        "import cust.c", _c("o_custkey"), "\n\ndef o", _c("o_orderkey"), "(\n    request,\n):\n    return c", _c("o_custkey"), "(request)\n").alias("content"))
    customer = table(spark, sf, "customer").select(_text("cust/c", _c("c_custkey"), ".py").alias("file_path"), _text(
        "def c", _c("c_custkey"), "(request):\n    return eval(request.args)\n").alias("content"))
    supplier = table(spark, sf, "supplier").select(_text("sup/s", _c("s_suppkey"), ".js").alias("file_path"), _text(
        "const x = require('./s", F.col("s_suppkey") + 1, "')\nfunction s", _c("s_suppkey"), "(req) {\n  return c", _c("s_suppkey"),
        "(req.body)\n}\nexports.t", _c("s_suppkey"), " = function() { return Math.random() }\n").alias("content"))
    every = order.unionByName(customer).unionByName(supplier)
    return every.select(F.lit("shop").alias("repo"), "file_path", "content")


def code_functions(spark: SparkSession, sf: str) -> DataFrame:
    """Functions of the derived sources, stored once per application."""
    return stored(spark, f"{_key(sf)}/functions", lambda: build_functions(spread(code_files(spark, sf))))


SQL["hits"] = """
SELECT CASE WHEN l_suppkey % 10 = 0 THEN 'node_modules/s' WHEN l_suppkey % 10 = 1 THEN 'docs/s' ELSE 'src/s' END || l_suppkey || '.py' AS file_path, l_orderkey::INTEGER AS line,
  CASE WHEN l_linenumber = 7 THEN 'py/unused-import' ELSE 'rule-' || l_linenumber END AS rule_id,
  CASE WHEN l_discount < 0.02 THEN 'quality' WHEN l_tax > 0.04 THEN 'hardcoded_secret' ELSE 'other' END AS category,
  CASE l_returnflag WHEN 'R' THEN 'critical' WHEN 'A' THEN 'warning' ELSE 'info' END AS severity, l_orderkey, l_partkey, l_suppkey, l_linenumber FROM lineitem"""
SQL["model_hits"] = """
SELECT 'Function:src/s' || (o_custkey % 100) || '.py:f' || o_orderkey AS file_path, o_orderkey, o_orderpriority AS severity FROM orders WHERE o_totalprice > 400000"""
SQL["kept_hits"] = """
SELECT *, CASE severity WHEN 'critical' THEN 4 WHEN 'warning' THEN 2 ELSE 0 END AS rank,
  (severity IN ('critical', 'error', 'warning') AND NOT contains(rule_id, 'unused-import') AND category <> 'quality' AND (category = 'hardcoded_secret' OR severity IN ('critical', 'error'))) AS important FROM hits"""
SQL["item_rows"] = """
SELECT CASE WHEN l_orderkey % 11 = 1 THEN '' ELSE CASE WHEN l_orderkey % 11 = 0 THEN 'tests/o' ELSE 'src/o' END || (l_orderkey % 500) || '.py' END AS file_path,
  1 AS layer, l_orderkey AS seq, count(*) AS n, count(*) FILTER (important) AS kept, bool_or(severity NOT IN ('info', 'low', 'none', '')) AS high FROM kept_hits GROUP BY l_orderkey
UNION ALL SELECT file_path, 2, o_orderkey, NULL, NULL, NULL FROM model_hits"""
_NEEDS["kept_hits"] = ("hits",)
_NEEDS["item_rows"] = ("hits", "kept_hits", "model_hits")
SQL["code"] = """
SELECT 'ord/o' || o_orderkey || '.py' AS file_path, 'o' || o_orderkey AS name, 3 AS start_line, 6 AS end_line, 6 AS file_lines, ['c' || o_custkey] AS calls, 'cust/c' || o_custkey || '.py' AS imported FROM orders
UNION ALL SELECT 'cust/c' || c_custkey || '.py', 'c' || c_custkey, 1, 2, 2, ['eval'], NULL FROM customer
UNION ALL SELECT 'sup/s' || s_suppkey || '.js', 's' || s_suppkey, 2, 4, 5, ['s' || s_suppkey, 'c' || s_suppkey], 'sup/s' || (s_suppkey + 1) || '.js' FROM supplier
UNION ALL SELECT 'sup/s' || s_suppkey || '.js', 't' || s_suppkey, 5, 5, 5, ['random'], NULL FROM supplier"""
