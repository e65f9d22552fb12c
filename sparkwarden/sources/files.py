"""File trees, JSON lines, dictionaries and feeds as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwarden.functions import fixed_values as fv
from sparkwarden.functions import paths as px


def _relative(path: Column, root: str) -> Column:
    base = root.rstrip("/")
    plain = F.regexp_replace(path, "^file:/+", "/")
    return F.substring(plain, F.lit(len(base) + 2), F.length(plain))


def read_tree(spark: SparkSession, root: str, max_bytes: int | None = None) -> DataFrame:
    """Files under ``root`` (absolute): path below the root, size and raw content.

    The content column is only read for rows that survive filters on path and length.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    if max_bytes is not None:
        raw = raw.filter(F.col("length") <= max_bytes)
    return raw.select(_relative(F.col("path"), root).alias("below"), "length", "modificationTime", "content")


def _text(content: str = "content") -> Column:
    """Decode UTF-8; malformed bytes become the replacement character."""
    return F.make_valid_utf8(F.col(content).cast("string"))


def _split_repo(files: DataFrame) -> DataFrame:
    return files.withColumn("repo", F.substring_index("below", "/", 1)).withColumn(
        "file_path", F.expr("substring(below, length(repo) + 2)"))


def read_repo_files(spark: SparkSession, root: str, max_bytes: int | None = None) -> DataFrame:
    """Source files of every repository folder under ``root``: repo, file_path, content.  ``max_bytes`` leaves larger files out."""
    files = _split_repo(read_tree(spark, root, max_bytes))
    return files.filter(px.benchmark_source_file("file_path")).select(
        "repo", "file_path", _text().alias("content"))


def read_scan_files(spark: SparkSession, root: str) -> DataFrame:
    """Files of the rule scan: allowed names and extensions outside skipped folders."""
    return select_scan_files(_split_repo(read_tree(spark, root))).select(
        "repo", "file_path", _text().alias("content"))


def select_scan_files(files: DataFrame, from_disk: bool = True) -> DataFrame:
    """The rule scan's choice of files.  Contents that come from the graph table are not subject to
    the skip rules (``from_disk=False``)."""
    wanted = files.filter(px.should_scan_file("file_path"))
    return wanted.filter(~px.should_skip_path("file_path")) if from_disk else wanted


def choose_repos(files: DataFrame, preferred: list[str], column: str = "repo") -> DataFrame:
    """Files of the preferred repositories that exist, of all repositories when none does."""
    known = files.select(F.coalesce(F.max(F.col(column).isin(*preferred)), F.lit(False)).alias("k"))
    return files.withColumn("__known", known.scalar()).filter(
        ~F.col("__known") | F.col(column).isin(*preferred)).drop("__known")


def repo_fingerprint(files: DataFrame, first: int) -> DataFrame:
    """SHA-256 over the concatenated contents of each repository's first files in path order.

    Hidden files and folders do not count.  The cut to ``first`` files happens in every task
    before the shuffle, so a repository gathers a bounded number of files (100 in the reference);
    ``repo_fingerprint_full`` reads all of them.
    """
    from pyspark.sql import Window as W

    visible = files.filter(~F.exists(px.parts("file_path"), lambda p: p.startswith(".")))
    order = W.partitionBy("repo").orderBy("file_path")
    head = visible.select("repo", "file_path", "content").withColumn(
        "__r", F.row_number().over(order)).filter(F.col("__r") <= first)
    joined = head.groupBy("repo").agg(F.array_sort(F.collect_list(F.struct("__r", "content"))).alias("x"))
    return joined.select("repo", F.sha2(F.concat_ws("", F.transform("x", lambda f: f["content"])), 256).alias("fingerprint"),
                         F.size("x").cast("long").alias("files"))


def repo_fingerprint_full(files: DataFrame) -> DataFrame:
    """Order-free fingerprint of all files: the sum of per-file hashes, for repositories of any size."""
    one = F.sha2(F.concat(F.coalesce("file_path", F.lit("")), F.lit("|"), F.coalesce(F.sha2("content", 256), F.lit(""))), 256)
    h = F.conv(F.substring(one, 1, 15), 16, 10).cast("decimal(38,0)")
    return files.groupBy("repo").agg(
        F.md5(F.concat_ws(":", F.sum(h).cast("string"), F.count("*").cast("string"))).alias("fingerprint"),
        F.count("*").alias("files"))


def mtime_fingerprint(files: DataFrame) -> DataFrame:
    """Fingerprint of modification times (repo, file_path, modificationTime)."""
    h = F.xxhash64("file_path", "modificationTime").cast("decimal(38,0)")
    return files.groupBy("repo").agg(F.md5(F.sum(h).cast("string")).alias("fingerprint"))


def read_jsonl_dataset(spark: SparkSession, path: str) -> DataFrame:
    """Labelled functions, one JSON object per line; blank lines are skipped."""
    schema = ("idx long, project string, file_name string, cwe string, cve string, target int, func string")
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_cwe_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """Weakness list: a JSON array of objects under current or older key names."""
    schema = "cwe_id string, cwe_name string, name string, cwe_description string, description string"
    text = spark.read.text(path, wholetext=True).select(F.trim("value").alias("t"))
    listed = F.when(F.col("t").startswith("["), F.from_json("t", "array<string>")).otherwise(
        F.raise_error(F.lit("the weakness dictionary must be a JSON list")))
    entries = text.select(F.explode(listed).alias("e")).filter(F.col("e").startswith("{"))
    named = entries.select(F.from_json("e", schema).alias("x")).select("x.*")
    either = lambda a, b: F.coalesce(F.nullif(F.col(a), F.lit("")), F.nullif(F.col(b), F.lit("")), F.lit(""))
    return named.select(
        F.upper(F.coalesce("cwe_id", F.lit(""))).alias("cwe_id"), either("cwe_name", "name").alias("cwe_name"),
        either("cwe_description", "description").alias("cwe_description"))


def unique_cwes(dictionary: DataFrame) -> DataFrame:
    """One row per weakness id; blank ids are dropped."""
    ids = dictionary.withColumn("cwe_id", F.trim(F.upper("cwe_id"))).filter(F.col("cwe_id") != "")
    return ids.dropDuplicates(["cwe_id"])


def read_url_feed(spark: SparkSession, path: str, n: int = 10) -> DataFrame:
    """First ``n`` non-blank lines of a text feed as threat entries."""
    lines = spark.read.text(path).filter(F.trim("value") != "").limit(n)
    return lines.select(
        F.col("value").alias("url"), F.lit("Phishing").alias("type"),
        F.lit("Unknown (Zero-day)").alias("target"), F.lit("High").alias("risk"))


def read_nvd_json(spark: SparkSession, path: str) -> DataFrame:
    """Vulnerability service response: id, score (newest scheme first), description, link."""
    metric = "array<struct<cvssData:struct<baseScore:double>>>"
    schema = (
        "vulnerabilities array<struct<cve:struct<id:string,published:string,"
        "descriptions:array<struct<lang:string,value:string>>,"
        f"metrics:struct<cvssMetricV31:{metric},cvssMetricV30:{metric}>>>>")
    raw = spark.read.schema(schema).option("multiLine", True).json(path)
    c = raw.select(F.explode("vulnerabilities.cve").alias("c"))
    score = lambda v: F.get(F.col(f"c.metrics.{v}"), 0)["cvssData"]["baseScore"]
    return c.select(
        F.col("c.id").alias("id"),
        F.coalesce(score("cvssMetricV31"), score("cvssMetricV30")).cast("string").alias("s"),
        F.get(F.col("c.descriptions"), 0)["value"].alias("description"),
        F.col("c.published").alias("published"),
        F.concat(F.lit("https://nvd.nist.gov/vuln/detail/"), F.col("c.id")).alias("link"),
    ).withColumn("score", F.coalesce("s", F.lit("N/A"))).drop("s")


def scan_relational(spark: SparkSession, source: str, columns: list[str] | None = None,
                    where: Column | None = None) -> DataFrame:
    """Parameterised read of a table: a registered name, or a folder of Parquet files."""
    df = spark.read.parquet(source) if "/" in source else spark.table(source)
    if where is not None:
        df = df.filter(where)
    return df.select(*columns) if columns else df
