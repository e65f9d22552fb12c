"""A training corpus from ``documents``: STAGES in order, each on all that the one before it kept.

A stage is (name, function); a function takes (spark, docs, sf_dir) and returns a frame that is written and read
again as the next one's docs.  All but the last return the columns of ``documents``.  ``run`` applies them all.

1. Language ID drops texts that are null, have no letter, or lie far from every language.
2. The n-gram Jaccard join keeps the document of the smallest id of each group of near duplicates (a document is an id with a text; one row of it,
   if rows repeat).
3. PII replaces personal data in the text by its kind.
4. Mixing keeps a document as often as its source's target asks for: not at all, once or twice.
5. BPE encodes every text and decodes it again.

Empty tables pass through every stage.  Columns beyond those of ``documents`` are dropped by the first stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkwarden.llm import bpe, jaccard_join, language_id, mixing, pii
from sparkwarden.llm.common import Scratch
from sparkwarden.llm.vocabulary import vocab_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; learned from the labels of the same documents."""
    docs = docs.select(*COLUMNS)
    return language_id.identify(docs, docs).where(~F.col("rejected")).select(*COLUMNS)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that of the smallest id (null ids last).

    A document is its id and text, so one id with two texts is two documents, and documents without an id are told apart by their text.  Of rows that
    repeat a document one stays, by source, language and length.
    """
    keyed = docs.withColumn("key", F.xxhash64(F.lit(1), "doc_id", F.col("doc_id").isNull(), "text", F.col("text").isNull()))
    found = jaccard_join.near_duplicates(keyed, "key").distinct()
    first = keyed.select("key", "doc_id").join(found, "key").groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("first"))
    kept = keyed.join(first.select("first.key"), "key", "left_semi")
    turn = Window.partitionBy("key").orderBy("source", "lang", "n_chars")
    return kept.withColumn("turn", F.row_number().over(turn)).where("turn = 1").select(*COLUMNS)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with personal data replaced."""
    masked = pii.mask(pii.detect(docs))
    return masked.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    taken = mixing.mix(docs).where("rounds > 0").withColumnRenamed("source", "s").withColumnRenamed("size", "n").withColumnRenamed("doc_id", "id")
    sized = docs.withColumn("size", mixing.word_count(F.col("text")))
    copies = Window.partitionBy("doc_id", "source", "size").orderBy("doc_id")
    rows = sized.withColumn("number", F.row_number().over(copies))
    same = F.col("doc_id").eqNullSafe(F.col("id")) & F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("n")) & (F.col("number") == F.col("copy"))
    return rows.join(taken.select("id", "s", "n", "copy", "rounds"), same).withColumn("round", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rounds")))).select(*COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, ids_sha256, decoded_sha256, ids) of every row."""
    return bpe.digests(docs, vocab_path(), ["doc_id", "lang", "source"], with_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", known_language),
    ("jaccard_join", one_of_each_group),
    ("pii", without_personal_data),
    ("mixing", mixed),
    ("bpe", encoded),
]

#: SQL expresses neither the classifiers nor the encoding; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``; each result is written to the shared folder and read again."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return docs
