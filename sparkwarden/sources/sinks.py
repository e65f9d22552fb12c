"""Snapshots, run logs, resumable output and reports."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType
from pyspark.sql.window import Window

from sparkwarden.session import shared_folder

NODE_KEY = ("repo_name", "id")
RELATION_KEY = ("repo_name", "from_id", "relation_type", "to_id", "step")


def last_per_key(source: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Latest row of every key; later rows win.  Each task keeps one row of a key before the shuffle."""
    rest = [c for c in source.columns if c not in keys and c != order]
    turn = Window.partitionBy(*keys).orderBy(F.desc(order), *[F.desc(c) for c in rest])
    return source.withColumn("__turn", F.row_number().over(turn)).filter(F.col("__turn") == 1).select(*keys, *rest)


def upsert(target: DataFrame, source: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """New snapshot: source rows insert or overwrite by key, the rest of the target stays."""
    fresh = last_per_key(source, keys, order)
    kept = target.join(fresh.select(*keys), list(keys), "left_anti")
    return kept.unionByName(fresh.select(*target.columns))


def upsert_nodes(target: DataFrame, source: DataFrame, order: str = "seq") -> DataFrame:
    return upsert(target, source, NODE_KEY, order)


def upsert_relations(target: DataFrame, source: DataFrame, order: str = "seq") -> DataFrame:
    return upsert(target, source, RELATION_KEY, order)


def write_partitioned(df: DataFrame, path: str, partition: str = "repo_name") -> None:
    """Replace exactly the repositories that ``df`` holds and leave the others alone.

    Rows are rebalanced by repository: small ones share a task and a large one is split over many,
    so neither tiny files nor one huge task come out.  ``df`` must not read from ``path`` itself.
    """
    df.hint("rebalance", F.col(partition)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def replace_repo(nodes: DataFrame, relations: DataFrame, node_path: str, relation_path: str, repos: Sequence[str], order: str = "seq") -> None:
    """Replace the nodes and relations of ``repos``, one partition swap per table.

    A listed repository without rows in one of the tables is cleared there by a separate step, so nothing of an earlier sync stays.
    Readers may see one table before the other; ``commit_repos`` changes all at once.
    """
    for rows, keys, path in ((relations, RELATION_KEY, relation_path), (nodes, NODE_KEY, node_path)):
        fresh = last_per_key(rows, keys, order)
        write_partitioned(fresh, path)
        # no more names than the list has
        present = {r[0] for r in fresh.select("repo_name").filter(F.col("repo_name").isin(list(repos))).distinct().collect()}
        for repo in set(repos) - present:
            _clear_partition(fresh.sparkSession, path, "repo_name", repo)


def _clear_partition(spark: SparkSession, path: str, column: str, value: str) -> None:
    jvm = spark._jvm
    escape = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    folder = jvm.org.apache.hadoop.fs.Path(f"{path}/{column}={escape(value)}")
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


# --- several tables in one commit ---------------------------------------------------------------
# <root>/<table>/version=<v>/repo_name=<r>/...   rows of one sync
# <root>/_manifests/<number>/                     (table, repo_name, version) of all rows that count, complete once _SUCCESS is there

_MANIFEST = "table string, repo_name string, version string"


def _children(spark: SparkSession, folder: str, must_hold: str | None = None) -> list[str]:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    inner = lambda name: spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}/{must_hold}")
    names = [x.getPath().getName() for x in fs.listStatus(path) if x.isDirectory()]
    return sorted(n for n in names if must_hold is None or fs.exists(inner(n)))


def _manifest(spark: SparkSession, root: str) -> tuple[int, DataFrame]:
    """Number and rows of the last complete manifest; 0 and none before the first commit."""
    known = _children(spark, f"{root}/_manifests", "_SUCCESS")
    if not known:
        return 0, spark.createDataFrame([], _MANIFEST)
    return int(known[-1]), spark.read.schema(_MANIFEST).parquet(f"{root}/_manifests/{known[-1]}")


def commit_repos(spark: SparkSession, root: str, tables: Mapping[str, DataFrame], repos: Sequence[str]) -> int:
    """Replace the rows of ``repos`` in all ``tables`` (frames with ``repo_name``) at once; returns the commit's number.

    Every table is written to a folder of its own first.  Then one manifest names what counts from now on, so readers see all tables
    before or after the commit, never between, and a run that fails leaves them where they were.  A repository that has no rows in a table is
    simply not named.  The sync log can be one of the tables.  Of two commits at the same time the second fails, as its manifest exists, and can be run again.
    """
    number, old = _manifest(spark, root)
    version = f"{number + 1:012d}-{uuid.uuid4().hex[:8]}"
    rows = old.filter(~F.col("repo_name").isin(list(repos)) | ~F.col("table").isin(list(tables)))
    for name, df in tables.items():
        path = f"{root}/{name}/version={version}"
        mine = df.filter(F.col("repo_name").isin(list(repos)))
        mine.hint("rebalance", F.col("repo_name")).write.partitionBy("repo_name").parquet(path)
        written = spark.read.schema(df.schema).parquet(path).select("repo_name").distinct()
        rows = rows.unionByName(written.select(F.lit(name).alias("table"), "repo_name", F.lit(version).alias("version")))
    rows.write.parquet(f"{root}/_manifests/{number + 1:012d}")
    return number + 1


def read_committed(spark: SparkSession, root: str, table: str, schema: StructType | str) -> DataFrame:
    """The rows of a table that the last manifest names; without one, none."""
    fields = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    _, manifest = _manifest(spark, root)
    if not _children(spark, f"{root}/{table}"):
        return spark.createDataFrame([], fields)
    every = spark.read.schema(StructType([*fields.fields, StructField("version", StringType())])).option("basePath", f"{root}/{table}").parquet(f"{root}/{table}")
    counting = manifest.filter(F.col("table") == table).select("repo_name", "version")
    return every.join(counting, ["repo_name", "version"], "left_semi").select(*fields.names)


def drop_unused(spark: SparkSession, root: str, tables: Sequence[str]) -> int:
    """Delete versions that neither the last manifest names nor a later commit may be writing; returns how many."""
    number, manifest = _manifest(spark, root)
    named = {(r["table"], r["version"]) for r in manifest.select("table", "version").distinct().collect()}  # one row per table and sync that still counts
    gone = 0
    for table in tables:
        for folder in _children(spark, f"{root}/{table}"):
            version = folder.removeprefix("version=")
            if int(version[:12]) <= number and (table, version) not in named:
                path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{table}/{folder}")
                gone += bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))
    return gone


def append_sync_run(meta: DataFrame, path: str) -> None:
    meta.write.mode("append").parquet(path)


def pending(work: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Work items without a result yet."""
    return work.join(done.select(*keys).distinct(), list(keys), "left_anti")


def run_key(*columns: str) -> Column:
    return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])


def cache_key(file_path: str, matched_text: str, line_content: str, rules: str, paths: str) -> Column:
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    evidence = F.concat(text(matched_text), text(line_content), text(rules))
    return F.md5(F.concat(text(file_path), F.lit("|"), evidence, F.lit("|"), text(paths)))


def split_cached(work: DataFrame, cache: DataFrame, key: str = "cache_key") -> tuple[DataFrame, DataFrame]:
    """(hits with their cached columns, misses)."""
    return work.join(cache, key), work.join(cache.select(key), key, "left_anti")


def checkpointed_run(spark: SparkSession, work: DataFrame, path: str, keys: Sequence[str],
                     process: Callable[[DataFrame], DataFrame], schema: str, batches: int = 8) -> int:
    """Process pending work in hash batches and append each batch's results.

    A batch that is complete is never redone: the next run leaves out every key that has a result.
    Returns the number of batches that ran.
    """
    done = spark.read.schema(schema).parquet(path) if _exists(spark, path) else spark.createDataFrame([], schema)
    slot = F.pmod(F.xxhash64(*keys), F.lit(batches))
    # written once by slot, so a batch reads its own folder only
    todo = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/todo-{uuid.uuid4().hex}"
    pending(work, done, keys).withColumn("__slot", slot).write.partitionBy("__slot").parquet(todo)
    ran = 0
    for i in range(batches):
        if _exists(spark, f"{todo}/__slot={i}"):
            process(spark.read.schema(work.schema).parquet(f"{todo}/__slot={i}")).write.mode("append").parquet(path)
            ran += 1
    folder = spark._jvm.org.apache.hadoop.fs.Path(todo)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return ran


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def prompt_table(context: DataFrame, evidence: DataFrame, repo_name: str, max_chars: int, dumped_at: Column) -> DataFrame:
    """Prompt inputs of every item in one table instead of one file each."""
    return context.join(evidence, ["root_id"], "left").select(
        dumped_at.alias("dumped_at"), F.lit(repo_name).alias("repo_name"), F.col("root_id").alias("root_node_id"),
        F.lit(max_chars).alias("max_graph_chars"), "evidence", F.col("context").alias("graph_context"))


def write_json_report(metrics: DataFrame, path: str) -> None:
    metrics.write.mode("overwrite").json(path)


def markdown_table(metrics: DataFrame, columns: Sequence[str], titles: Sequence[str], order: Sequence[str]) -> DataFrame:
    """A metrics table (one row per tool or strategy, so small) as one Markdown text."""
    cells = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), F.lit(" |"))
    head = "| " + " | ".join(titles) + " |\n|" + "|".join(["---"] + ["---:"] * (len(titles) - 1)) + "|"
    rows = metrics.select(F.struct(*order, cells.alias("line")).alias("r"))
    return rows.agg(F.array_sort(F.collect_list("r")).alias("x")).select(F.concat(
        F.lit(head + "\n"), F.array_join(F.transform("x", lambda r: r["line"]), "\n"), F.lit("\n")).alias("markdown"))


def write_markdown_report(markdown: DataFrame, path: str) -> None:
    markdown.coalesce(1).write.mode("overwrite").text(path)
