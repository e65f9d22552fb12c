"""External analyzer results: SARIF, scanner JSON and generic finding lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwarden.functions import paths as px
from sparkwarden.functions import text as tx
from sparkwarden.functions.text import ColumnLike, col

_RULE = (
    "struct<id:string,name:string,shortDescription:struct<text:string>,fullDescription:struct<text:string>,"
    "properties:struct<tags:array<string>,`problem.severity`:string,`security-severity`:string,precision:string>>"
)
_RESULT = (
    "struct<ruleId:string,message:struct<text:string>,locations:array<struct<physicalLocation:"
    "struct<artifactLocation:struct<uri:string>,region:struct<startLine:int,startColumn:int>>>>>"
)
SARIF_SCHEMA = f"runs array<struct<tool:struct<driver:struct<rules:array<{_RULE}>>>,results:array<{_RESULT}>>>"


def extract_cwe(tags: ColumnLike) -> Column:
    """Weakness ids among rule tags, zero-padded as written; sorted and distinct."""
    named = F.filter(F.coalesce(col(tags), F.array().cast("array<string>")), lambda t: F.lower(t).contains("cwe"))
    return F.array_sort(F.array_distinct(F.transform(named, lambda t: F.upper(F.substring_index(t, "/", -1)))))


def extract_category(tags: ColumnLike) -> Column:
    t = F.coalesce(col(tags), F.array().cast("array<string>"))
    return F.when(F.array_contains(t, "security"), "security").when(
        F.array_contains(t, "correctness"), "correctness").otherwise(F.coalesce(F.get(t, F.lit(0)), F.lit("codeql")))


def _some(*values: Column) -> Column:
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values])


def extract_severity(properties: ColumnLike) -> Column:
    p = col(properties)
    return _some(p["problem.severity"], p["security-severity"], p["precision"], F.lit("warning"))


def _results(spark: SparkSession, path: str, first_run_only: bool) -> DataFrame:
    """Results with their own run's rule.  A run's rules stay beside its results as a map, so no
    join is needed to pair them."""
    raw = spark.read.schema(SARIF_SCHEMA).option("multiLine", True).json(path)
    runs = raw.select(F.posexplode("runs").alias("run", "r"))
    if first_run_only:
        runs = runs.filter(F.col("run") == 0)
    named = F.filter(F.coalesce(F.col("r.tool.driver.rules"), F.array().cast(f"array<{_RULE}>")),
                     lambda x: x["id"].isNotNull())
    table = F.map_from_entries(F.array_distinct(F.transform(named, lambda x: F.struct(x["id"], x))))
    return runs.select("run", table.alias("rules"), F.posexplode("r.results").alias("seq", "x")).select(
        "run", "seq", "x", F.element_at("rules", F.coalesce("x.ruleId", F.lit("unknown-rule"))).alias("rule"))


def read_sarif(spark: SparkSession, path: str, sources: DataFrame | None = None, repo: str | None = None) -> DataFrame:
    """Findings of the first run in the rule scan's long form; ``sources`` (file_path, content)
    supplies line texts.  Results without a location or path are left out."""
    place = F.get(F.col("x.locations"), 0)["physicalLocation"]
    rule_id = F.coalesce("x.ruleId", F.lit("unknown-rule"))
    full = F.col("rule")["fullDescription"]["text"]
    out = _results(spark, path, True).select(
        place["artifactLocation"]["uri"].alias("file_path"),
        F.coalesce(place["region"]["startLine"], F.lit(1)).alias("line"),
        F.coalesce(place["region"]["startColumn"], F.lit(1)).alias("column"),
        rule_id.alias("rule_id"), F.col("seq").alias("match_seq"),
        F.coalesce(_some(F.col("rule")["name"]), F.col("rule")["shortDescription"]["text"], rule_id).alias("name"),
        extract_category(F.col("rule")["properties"]["tags"]).alias("category"),
        extract_cwe(F.col("rule")["properties"]["tags"]).alias("cwe"),
        F.when(F.col("rule").isNull(), F.lit("warning")).otherwise(
            extract_severity(F.col("rule")["properties"])).alias("severity"),
        F.lit("").alias("matched_text"),
        F.coalesce(_some(F.col("x.message.text")), full, F.lit("")).alias("description"),
    ).filter(F.coalesce("file_path", F.lit("")) != "")
    if repo is not None:
        out = out.withColumn("repo", F.lit(repo))
    if sources is None:
        return out.withColumn("line_content", F.lit(""))
    texts = sources.select("file_path", F.col("content").alias("__text"))
    return out.join(texts, "file_path", "left").withColumn(
        "line_content", F.coalesce(tx.line_at("__text", "line"), F.lit(""))).drop("__text")


def _tool_rows(df: DataFrame, tool: str, repos: list[str], path: Column, line: Column, rule_id: Column,
               category: Column, severity: Column, message: Column, raw: Column,
               repo: Column | None = None) -> DataFrame:
    place = px.infer_repo_and_path(path, repos)
    if repo is not None:
        own = F.struct(repo.alias("repo"), px.normalize_path(path).alias("file_path"))
        place = F.coalesce(place, F.when(F.coalesce(repo, F.lit("")) != "", own))
    blank = lambda c: F.coalesce(c, F.lit(""))
    return df.withColumn("__p", place).filter(F.col("__p").isNotNull()).select(
        F.lit(tool).alias("tool"), F.col("__p.repo").alias("repo"), F.col("__p.file_path").alias("file_path"),
        F.coalesce(F.nullif(line.cast("int"), F.lit(0)), F.lit(1)).alias("line"), blank(rule_id).alias("rule_id"),
        blank(category).alias("category"), blank(severity).alias("severity"), blank(message).alias("message"),
        raw.alias("raw"))


def read_sarif_all_runs(spark: SparkSession, path: str, repos: list[str], tool: str = "CodeQL") -> DataFrame:
    place = F.get(F.col("x.locations"), 0)["physicalLocation"]
    props = F.col("rule")["properties"]
    found = _results(spark, path, False).filter(F.size("x.locations") > 0)
    return _tool_rows(
        found, tool, repos, F.coalesce(place["artifactLocation"]["uri"], F.lit("")),
        place["region"]["startLine"], F.col("x.ruleId"), F.array_join(props["tags"], ","),
        _some(props["problem.severity"], props["security-severity"]), F.col("x.message.text"),
        F.to_json("x"))


def read_semgrep(spark: SparkSession, path: str, repos: list[str], tool: str = "Semgrep") -> DataFrame:
    schema = (
        "results array<struct<path:string,start:struct<line:int>,check_id:string,extra:struct<severity:string,"
        "message:string,metadata:struct<category:string,technology:string>>>>")
    found = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("results").alias("x"))
    meta = F.col("x.extra.metadata")
    return _tool_rows(
        found, tool, repos, F.coalesce("x.path", F.lit("")), F.col("x.start.line"), F.col("x.check_id"),
        _some(meta["category"], meta["technology"]), F.col("x.extra.severity"), F.col("x.extra.message"),
        F.to_json("x"))


_GENERIC = (
    "file_path string, path string, file string, repo string, line int, start_line int, rule_id string, "
    "rule string, category string, severity string, message string, description string"
)


def read_generic_findings(spark: SparkSession, path: str, tool: str, repos: list[str]) -> DataFrame:
    """A list of findings, or an object with a ``findings`` list, under several key names."""
    item = ",".join(f.strip().replace(" ", ":") for f in _GENERIC.split(","))
    raw = spark.read.schema(f"findings array<struct<{item}>>, {_GENERIC}").option("multiLine", True).json(path)
    wrapped = raw.filter(F.col("findings").isNotNull()).select(F.explode("findings").alias("x")).select("x.*")
    found = wrapped.unionByName(raw.filter(F.col("findings").isNull()).drop("findings"))
    line = lambda c: F.nullif(F.col(c), F.lit(0))
    return _tool_rows(
        found, tool, repos, F.coalesce(_some(F.col("file_path"), F.col("path"), F.col("file")), F.lit("")),
        F.coalesce(line("line"), line("start_line")), _some(F.col("rule_id"), F.col("rule")), F.col("category"),
        F.col("severity"), _some(F.col("message"), F.col("description")), F.to_json(F.struct("*")), F.col("repo"))


def load_findings(spark: SparkSession, path: str, tool: str, repos: list[str]) -> DataFrame:
    """Findings of any supported tool, chosen by its name."""
    if tool.lower() == "semgrep":
        return read_semgrep(spark, path, repos)
    if tool.lower() == "codeql":
        return read_sarif_all_runs(spark, path, repos)
    return read_generic_findings(spark, path, tool, repos)
