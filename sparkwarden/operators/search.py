"""Search over vulnerability records: exact ids, full text, vectors and their fusion."""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkwarden.functions import fixed_values as fv
from sparkwarden.functions import vectors as vx
from sparkwarden.functions.text import bind

TITLE_WEIGHT, BODY_WEIGHT = 1.0, 0.4


def _in_years(df: DataFrame, year: int | Sequence[int] | None) -> DataFrame:
    if year is None:
        return df
    years = [year] if isinstance(year, int) else list(year)
    return df.filter(F.col("year").isin(*years))


def reciprocal_rank_fusion(ranked: Sequence[DataFrame], key: str = "id", k: int = fv.RRF_K,
                           top: int = 3) -> DataFrame:
    """Fuse ranked lists (key, rank from 0): sum of 1 / (k + rank + 1), best first.

    Ties keep the order in which the lists first name the item.
    """
    tagged = None
    for i, df in enumerate(ranked):
        part = df.select(key, F.col("rank").cast("long").alias("rank"), F.lit(i).alias("list"))
        tagged = part if tagged is None else tagged.unionByName(part)
    fused = tagged.groupBy(key).agg(
        F.sum(F.lit(1.0) / (F.lit(float(k + 1)) + F.col("rank"))).alias("score"),
        F.min(F.struct("list", "rank")).alias("first"))
    return fused.orderBy(F.desc("score"), "first", key).limit(top).select(key, "score")


def ranked(df: DataFrame, order: Sequence[Column | str], limit: int, key: str = "id") -> DataFrame:
    """First ``limit`` rows in a total order with their rank from 0.

    The limit is taken before the window, so the single ranking task sees ``limit`` rows.
    """
    top = df.orderBy(*order).limit(limit)
    return top.withColumn("rank", F.row_number().over(W.orderBy(*order)) - 1)


def vector_topk(vectors: DataFrame, query: Sequence[float] | Column, limit: int = 50,
                key: str = "id", column: str = "embedding", year: int | Sequence[int] | None = None,
                described: str | None = None) -> DataFrame:
    """Exact nearest neighbours by cosine distance: a scan with a per-task top-k.

    ``query`` is a literal vector or a scalar subquery.  Rows whose ``described`` column is NULL
    do not take part.
    """
    pool = _in_years(vectors, year)
    if described:
        pool = pool.filter(F.col(described).isNotNull())
    vector = query if isinstance(query, Column) else F.array(*[F.lit(float(x)) for x in query])
    scored = pool.select(key, F.col(column).alias("__v")).withColumn("__q", vector).select(
        key, vx.cosine_distance("__v", "__q").alias("distance"))
    return ranked(scored, [F.asc_nulls_last("distance"), key], limit, key)


def vector_topk_batch(vectors: DataFrame, queries: DataFrame, limit: int = 50, key: str = "id", column: str = "embedding",
                      query_key: str = "query_id", query_column: str = "embedding", block: int = 4096, query_block: int = 1024) -> DataFrame:
    """Exact nearest neighbours by cosine distance of many queries: (query_key, key, distance, rank from 0).

    Records and queries are dealt out in blocks by the hash of their key, and each pair of blocks meets once in a task that
    multiplies them and keeps ``limit`` records per query, so only those are shuffled on.  Order and missing distances are those of ``vector_topk``:
    a vector that is null, of length zero or of another dimension has none and comes last, ties go to the smaller key.
    """
    n, m = vectors.count(), queries.count()
    blocks, parts = max(1, -(-n // block)), max(1, -(-m // query_block))

    def dealt(df: DataFrame, name: str, vector: str, mine: str, count: int, other: str, others: int) -> DataFrame:
        return df.select(F.col(name).alias("k"), vx.doubles(vector).alias("v"), F.pmod(F.xxhash64(name), F.lit(count)).cast("int").alias(mine),
                         F.explode(F.sequence(F.lit(0), F.lit(others - 1))).alias(other))

    left = dealt(vectors, key, column, "block", blocks, "part", parts)
    right = dealt(queries, query_key, query_column, "part", parts, "block", blocks)

    def lengths(x: np.ndarray) -> np.ndarray:
        norm = np.sqrt((x * x).sum(axis=1))
        return np.where(norm > 0, norm, np.nan)

    def meet(records: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(records) and len(asked):
            records = records.sort_values("k", kind="stable")
            keys, far = records["k"].to_numpy(), np.full((len(asked), len(records)), np.nan)
            width = lambda v: -1 if v is None or any(x is None for x in v) else len(v)
            dims, wants = records["v"].map(width).to_numpy(), asked["v"].map(width).to_numpy()
            for d in set(dims) & set(wants) - {-1, 0}:
                rows, cols = np.flatnonzero(wants == d), np.flatnonzero(dims == d)
                a, b = np.stack(asked["v"].iloc[rows].to_numpy()), np.stack(records["v"].iloc[cols].to_numpy())
                far[np.ix_(rows, cols)] = 1.0 - (a @ b.T) / (lengths(a)[:, None] * lengths(b)[None, :])
            for q, distance in zip(asked["k"], far, strict=True):
                # rows are in key order, so a stable order by distance keeps ties right; missing distances sort last
                first = np.argsort(distance, kind="stable")[:limit]
                out += [(q, keys[i], None if np.isnan(distance[i]) else float(distance[i])) for i in first.tolist()]
        return pd.DataFrame(out, columns=["q", "k", "distance"])

    group = ["block", "part"]
    kind = f"q {queries.schema[query_key].dataType.simpleString()}, k {vectors.schema[key].dataType.simpleString()}, distance double"
    met = left.groupBy(*group).cogroup(right.groupBy(*group)).applyInPandas(meet, kind)
    order = W.partitionBy("q").orderBy(F.asc_nulls_last("distance"), "k")
    return met.withColumn("rank", F.row_number().over(order) - 1).filter(F.col("rank") < limit).select(
        F.col("q").alias(query_key), F.col("k").alias(key), "distance", "rank")


def terms(text: Column | str) -> Column:
    c = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"(?U)\w+"), F.lit(0))


def fulltext_scores(records: DataFrame, query: str, key: str = "id", title: str = "title",
                    body: str = "description", year: int | Sequence[int] | None = None) -> DataFrame:
    """Score of every record that holds one of the query's words: title positions weigh 1.0, body
    positions 0.4, which is what cover density comes to when the words are OR-ed.

    Words are compared in lower case without stemming or stop words.  The query is one literal,
    so each record is scored where it lies and nothing is shuffled.
    """
    asked = sorted(set(re.findall(r"\w+", query.lower())))
    pattern = F.lit(r"(?U)\b(?:" + "|".join(asked) + r")\b")

    def hits(column: str) -> Column:
        return F.regexp_count(F.lower(F.coalesce(F.col(column), F.lit(""))), pattern)

    scored = _in_years(records, year).select(
        key, (hits(title) * F.lit(TITLE_WEIGHT) + hits(body) * F.lit(BODY_WEIGHT)).alias("score"))
    return scored.filter(F.col("score") > 0)


def fulltext_topk(records: DataFrame, query: str, limit: int = 50, **names) -> DataFrame:
    key = names.get("key", "id")
    return ranked(fulltext_scores(records, query, **names), [F.desc("score"), key], limit, key)


def fulltext_topk_batch(records: DataFrame, queries: DataFrame, limit: int = 50, key: str = "id",
                        title: str = "title", body: str = "description", query_key: str = "query_id",
                        query_text: str = "query", digits: int = 6) -> DataFrame:
    """Many queries at once through a word join; scores are rounded to ``digits`` before ranking,
    so that the order of additions does not decide ties.

    A record counts its own words where it lies, by runs of its sorted words, and gives one weighted row per distinct word.  Those
    that queries ask for become (query, record) rows at once, so a task never holds a table of the words of its records.
    """
    def weighted(column: str, weight: float) -> Column:
        def runs(s: Column) -> Column:
            first = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
            return bind(first, lambda f: F.transform(f, lambda i, k: F.struct(
                F.get(s, i).alias("word"), ((F.coalesce(F.get(f, k + 1), F.size(s)) - i) * F.lit(weight)).alias("w"))))

        none = F.array().cast("array<struct<word:string,w:double>>")
        return bind(F.array_sort(terms(column)), lambda s: F.when(F.size(s) > 0, runs(s)).otherwise(none))

    asked = queries.select(query_key, F.explode(F.array_distinct(terms(query_text))).alias("word"))
    words = records.select(key, F.explode(F.concat(weighted(title, TITLE_WEIGHT), weighted(body, BODY_WEIGHT))).alias("x")).select(key, "x.word", "x.w")
    scores = words.join(asked, "word").groupBy(query_key, key).agg(
        F.round(F.sum("w"), digits).alias("score"))
    order = W.partitionBy(query_key).orderBy(F.desc("score"), key)
    return scores.withColumn("rank", F.row_number().over(order) - 1).filter(F.col("rank") < limit)


def exact_ids(text: Column | str, pattern: str = fv.EXACT_ID_PATTERN) -> Column:
    c = F.col(text) if isinstance(text, str) else text
    return F.array_distinct(F.transform(
        F.regexp_extract_all(c, F.lit(pattern), F.lit(0)), lambda x: F.upper(x)))


def exact_id_search(queries: DataFrame, records: DataFrame, query_key: str = "query_id",
                    query_text: str = "query", key: str = "id", pattern: str = fv.EXACT_ID_PATTERN) -> DataFrame:
    """Records whose ids the query texts name; descriptions are cut to 300 characters."""
    asked = queries.select(query_key, F.explode(exact_ids(query_text, pattern)).alias(key))
    found = asked.join(records, key)
    return found.withColumn(
        "description", F.concat(F.substring("description", 1, 300), F.lit("...")))


def hybrid_search(records: DataFrame, query: str, vector: Sequence[float] | Column | None = None,
                  keywords: str | None = None, year: int | Sequence[int] | None = None,
                  key: str = "id", pool: int = 50, top: int = 10) -> DataFrame:
    """Ids that the query names win outright; otherwise vectors and full text are fused.

    Without a vector or without keywords that list is empty and the other one decides alone.
    The exact path must be known to be empty before the lists count, so its hits and the fused
    list are combined and the fused rows are dropped when there is an exact one.
    """
    spark = records.sparkSession
    text = query if keywords is None else keywords
    asked = spark.range(1).select(F.lit(query).alias("q"))
    exact = (
        asked.select(F.explode(exact_ids("q")).alias(key)).join(records.select(key), key)
        .select(key, F.lit(1.0).alias("score"), F.lit(0).alias("tier"))
    )
    lists = []
    if vector is not None:
        lists.append(vector_topk(records, vector, pool, key, year=year, described="description"))
    if text.strip():
        lists.append(fulltext_topk(records, text, pool, key=key, year=year))
    if not lists:
        return exact
    fused = reciprocal_rank_fusion(lists, key, top=top).withColumn("tier", F.lit(1))
    best = exact.agg(F.count("*").alias("n"))
    fused = fused.withColumn("__exact", best.scalar()).filter(F.col("__exact") == 0).drop("__exact")
    return exact.unionByName(fused)


def search_nodes(nodes: DataFrame, query: str, limit: int = 10, repo: str | None = None) -> DataFrame:
    """Node search: names weigh like titles, description and content like bodies."""
    pool = nodes if repo is None else nodes.filter(F.col("repo_name") == repo)
    texts = pool.select("id", F.col("name").alias("title"), F.concat_ws(
        " ", *[c for c in ("description", "content") if c in nodes.columns]).alias("description"))
    return fulltext_topk(texts, query, limit)


def chat_context(records: DataFrame) -> DataFrame:
    """One text block per record, for a prompt."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("N/A"))
    score = F.when(F.coalesce("cvss_score", F.lit(0.0)) == 0, F.lit("N/A")).otherwise(text("cvss_score"))
    block = F.concat(
        F.lit("[Vulnerability: "), text("id"), F.lit("]\n- Title: "), text("title"),
        F.lit("\n- CVSS: "), score, F.lit("\n- Product: "), text("vendor_product"),
        F.lit("\n- Published: "), text("published_date"), F.lit("\n- Description: "),
        text("description"), F.lit("\n---\n"))
    return records.select("id", block.alias("block"))
