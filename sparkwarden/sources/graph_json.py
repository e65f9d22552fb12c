"""Code-graph dumps: reading, normalising and quarantining bad records."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sparkwarden.sources.json_elements import json_elements

NODE_PROPERTIES = (
    "name:string,filePath:string,content:string,description:string,startLine:bigint,endLine:bigint,"
    "isExported:boolean,parameterCount:int,returnType:string,processType:string,stepCount:int,level:int"
)
GRAPH_SCHEMA = (
    "nodes array<struct<id:string,label:string,properties:map<string,string>>>, "
    "relationships array<struct<sourceId:string,targetId:string,type:string,confidence:double,"
    "reason:string,step:int>>"
)
_USED = [p.split(":")[0] for p in NODE_PROPERTIES.split(",")]


class Graph(NamedTuple):
    nodes: DataFrame
    relations: DataFrame
    rejected: DataFrame


def read_graph_json(spark: SparkSession, path: str, repo_name: str) -> Graph:
    """A graph dump (one JSON document per file) as node and relation tables."""
    raw = spark.read.schema(GRAPH_SCHEMA).option("multiLine", True).json(path)
    nodes = raw.select(F.explode("nodes").alias("n")).select("n.*")
    relations = raw.select(F.explode("relationships").alias("r")).select("r.*")
    return normalise(nodes, relations, repo_name)


def read_large_graph_json(spark: SparkSession, path: str, repo_name: str) -> Graph:
    """As ``read_graph_json``, for dumps of any size: a document is read in as many tasks as it has splits, and its text is written once.

    Elements that are no objects, or are cut off, are not seen.
    """
    elements = json_elements(spark, path)
    fields = {x.name: x.dataType.elementType for x in StructType.fromDDL(GRAPH_SCHEMA).fields}

    def part(name: str) -> DataFrame:
        return elements.filter(F.col("field") == name).select(F.from_json("element", fields[name]).alias("x")).select("x.*")

    return normalise(part("nodes"), part("relationships"), repo_name)


def normalise(nodes: DataFrame, relations: DataFrame, repo_name: str) -> Graph:
    """Typed records.  Nodes without an id fall back to label:name, and are rejected when they have
    neither, or when a property does not fit its type; relations without both ends or a type are rejected.  Nothing is raised."""
    p = F.col("properties")

    def prop(name: str, kind: str) -> Column:
        return F.nullif(F.trim(F.element_at(p, name)), F.lit("")).try_cast(kind) if kind != "string" else F.element_at(p, name)

    usable_id = F.coalesce(F.nullif("id", F.lit("")), F.concat_ws(":", "label", prop("name", "string")))
    has_id = (F.coalesce("id", F.lit("")) != "") | prop("name", "string").isNotNull()
    unfit = F.lit(False)
    for pair in NODE_PROPERTIES.split(","):
        name, kind = pair.split(":")
        if kind != "string":
            unfit = unfit | (F.coalesce(F.trim(F.element_at(p, name)), F.lit("")) != "") & prop(name, kind).isNull()
    usable = has_id & ~unfit
    rest = F.map_filter(p, lambda k, v: ~k.isin(*_USED) & v.isNotNull())
    typed = [prop(*pair.split(":")).alias(_snake(pair.split(":")[0])) for pair in NODE_PROPERTIES.split(",")]
    good_nodes = nodes.filter(usable).select(
        F.lit(repo_name).alias("repo_name"), usable_id.alias("id"),
        F.coalesce(F.nullif("label", F.lit("")), F.lit("CodeElement")).alias("label"), *typed,
        F.coalesce(F.to_json(rest), F.lit("{}")).alias("raw_properties"))
    complete = (
        (F.coalesce("sourceId", F.lit("")) != "") & (F.coalesce("targetId", F.lit("")) != "")
        & F.col("type").isNotNull())
    good_relations = relations.filter(complete).select(
        F.lit(repo_name).alias("repo_name"), F.col("sourceId").alias("from_id"),
        F.col("targetId").alias("to_id"), F.col("type").alias("relation_type"), "confidence", "reason",
        F.coalesce("step", F.lit(-1)).alias("step"))
    rejected = nodes.filter(~usable).select(F.lit("node").alias("kind"), F.to_json(F.struct("*")).alias("record")).unionByName(
        relations.filter(~complete).select(F.lit("relation").alias("kind"), F.to_json(F.struct("*")).alias("record")))
    return Graph(good_nodes, good_relations, rejected)


def _snake(name: str) -> str:
    return "".join("_" + c.lower() if c.isupper() else c for c in name)


def sync_meta(graph: Graph, repo_name: str, started_at: Column, repo_path: str | None = None,
              indexed_at: str | None = None) -> DataFrame:
    """Run-log row of one ingest, with the record counts."""
    counts = graph.nodes.select(F.lit(1).alias("n"), F.lit(0).alias("e")).unionByName(
        graph.relations.select(F.lit(0).alias("n"), F.lit(1).alias("e")))
    totals = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("int").alias("stats_nodes"),
                        F.coalesce(F.sum("e"), F.lit(0)).cast("int").alias("stats_edges"))
    return totals.select(
        F.md5(F.concat_ws("|", F.lit(repo_name), started_at.cast("string"))).alias("run_id"),
        F.lit(repo_name).alias("repo_name"), F.lit(repo_path).cast("string").alias("repo_path"),
        F.lit(indexed_at).cast("string").alias("indexed_at"), started_at.alias("started_at"),
        F.lit("graph").alias("source"), "stats_nodes", "stats_edges")


def list_repos(runs: DataFrame, key: str = "repo_name", order: str = "started_at", *columns: str) -> DataFrame:
    """Latest run of every repository."""
    names = [c for c in (columns or runs.columns) if c not in (key, order)]
    return runs.groupBy(key).agg(
        F.max(order).alias(order), F.max_by(F.struct(*names), F.struct(order, *names)).alias("r")).select(
        key, order, "r.*")


def repo_info(runs: DataFrame, repo_name: str | None = None, repo_path: str | None = None) -> DataFrame:
    """One repository by name, or by its path without a trailing slash."""
    out = list_repos(runs)
    if repo_name is not None:
        out = out.filter(F.col("repo_name") == repo_name)
    if repo_path is not None:
        out = out.filter(F.regexp_replace("repo_path", "/+$", "") == repo_path.rstrip("/"))
    return out
