"""Registered queries of this subpackage, each over its whole table, with their SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from sparkwarden.llm import bpe, collocations, hard_negatives, jaccard_join, language_id, license_scan, mixing, nearest, pii, quality, secret_scan, url_lists, weighted_sampling
from sparkwarden.llm.common import Scratch, in_order, table
from sparkwarden.llm.vocabulary import vocab_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _register(fn):
    QUERIES[fn.__name__] = fn
    return fn


@_register
def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents: five-word shingles, Jaccard similarity of 0.8 or more."""
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"))


@_register
def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document's encoding and of its decoded text."""
    return bpe.digests(table(spark, sf_dir, "documents"), vocab_path(), ["doc_id"])


@_register
def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of every document a mix of all sources takes."""
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("rounds")).alias("taken"), "source")


@_register
def op4_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page against the lists of its fetch time.

    The time of a page is that of the event with its number.  Events are also the lists' log: an event of key k is about the
    k-th host in order (or, for spam, the host's parent).  Errors add to ``malware`` and signups remove; purchases add to ``spam`` and clicks remove.
    """
    pages, events = table(spark, sf_dir, "pages").select("page_id", "url"), table(spark, sf_dir, "events")
    captures = pages.join(events.select(F.col("event_id").alias("page_id"), F.col("ts").alias("fetched_at")), "page_id", "left")
    hosts = pages.select(url_lists.host_of(F.col("url")).alias("host")).where("host is not null").distinct()
    ranked = Scratch(spark).save(in_order(hosts, "host", "place"), "hosts")
    n = ranked.agg(F.greatest(F.count(F.lit(1)), F.lit(1)).alias("n")).scalar()
    kind = F.col("event_type")
    log = events.where(kind.isin("error", "signup", "purchase", "click")).select(
        F.when(kind.isin("error", "signup"), "malware").otherwise("spam").alias("list"), F.when(kind.isin("error", "purchase"), "add").otherwise("remove").alias("action"),
        F.col("ts").alias("at"), (F.get_json_object("props", "$.k").cast("long") % n).cast("int").alias("place"))
    entries = log.join(ranked, "place").select("list", "action", "at", F.when(F.col("list") == "malware", F.col("host")).otherwise(F.regexp_replace("host", r"^[^.]*\.", "")).alias("pattern"))
    judged = url_lists.evaluate(captures, entries)
    return judged.select("page_id", F.array_join("active_lists", ",").alias("lists"), F.size("active_lists").cast("long").alias("n_lists"), F.array_contains("active_lists", "malware").alias("blocked"))


ORACLES["op4_url_lists"] = r"""
WITH captures AS (
    SELECT page_id, e.ts AS t, nullif(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1), '') AS host
    FROM pages LEFT JOIN events e ON e.event_id = page_id),
ranked AS (SELECT host, row_number() OVER (ORDER BY host) - 1 AS place, count(*) OVER () AS n FROM (SELECT DISTINCT host FROM captures WHERE host IS NOT NULL)),
entries AS (
    SELECT DISTINCT CASE WHEN event_type IN ('error', 'signup') THEN 'malware' ELSE 'spam' END AS list, CASE WHEN event_type IN ('error', 'purchase') THEN 'add' ELSE 'remove' END AS action, ts AS since,
        CASE WHEN event_type IN ('error', 'signup') THEN host ELSE regexp_replace(host, '^[^.]*\.', '') END AS pattern
    FROM events JOIN ranked ON CAST(json_extract_string(props, '$.k') AS BIGINT) % n = place
    WHERE event_type IN ('error', 'signup', 'purchase', 'click')),
spans AS (SELECT *, lead(since) OVER (PARTITION BY list, pattern ORDER BY since, action) AS until FROM entries),
hits AS (
    SELECT DISTINCT page_id, t, list FROM captures c JOIN spans s
        ON s.action = 'add' AND s.since <= c.t AND (s.until IS NULL OR c.t < s.until) AND (c.host = s.pattern OR ends_with(c.host, '.' || s.pattern)))
SELECT c.page_id, coalesce(string_agg(h.list, ',' ORDER BY h.list), '') AS lists, count(h.list) AS n_lists, coalesce(bool_or(h.list = 'malware'), FALSE) AS blocked
FROM captures c LEFT JOIN hits h ON h.page_id = c.page_id AND h.t = c.t
GROUP BY c.page_id"""


@_register
def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of every hundredth one."""
    rows = table(spark, sf_dir, "embeddings")
    return nearest.search(rows, rows.where("vec_id % 100 = 0")).select("query_id", "rank", F.col("id").alias("vec_id"), "score")


@_register
def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: counts and digest of the base spans, and all spans."""
    spans = F.col("pii_spans")
    base = F.filter(spans, lambda x: x["base"])
    count = lambda kind: F.size(F.filter(spans, lambda x: x["base"] & (x["kind"] == kind))).cast("long").alias(f"n_{kind}")
    return pii.detect(table(spark, sf_dir, "documents")).select(
        "doc_id", *[count(k) for k in pii.KINDS], F.sha2(pii.describe(base), 256).alias("base_sha256"), pii.describe(spans).alias("spans"))


@_register
def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document with the verdict of corpus-wide ownership."""
    spans = F.col("spans")
    base = F.filter(spans, lambda x: x["base"])
    count = lambda kind: F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return secret_scan.scan(table(spark, sf_dir, "documents")).select(
        F.col("repository").alias("doc_id"), *[count(k) for k in secret_scan.KINDS], F.sha2(secret_scan.describe(base), 256).alias("base_sha256"),
        secret_scan.describe(spans).alias("spans"), "n_live", "n_copied")


def held_out():
    """Whether a document is kept from learning languages."""
    return F.crc32(F.col("doc_id").cast("string")) % 4 == 2


@_register
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the labelled three quarters."""
    docs = table(spark, sf_dir, "documents")
    known = language_id.identify(docs.select("doc_id", "text"), docs.where(~F.coalesce(held_out(), F.lit(False))))
    return known.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


@_register
def op10_weighted_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness."""
    return weighted_sampling.compare_with_next(table(spark, sf_dir, "documents"))


@_register
def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and licence labels of every document."""
    found = license_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    names = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return found.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min("places.first_word").alias("first_word"), F.array_max("places.first_word").alias("last_word"),
        names(F.col("places.label")).alias("base_labels"), names(F.concat("places.label", "spans.label")).alias("labels"),
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max("spans.covered"), F.lit(0.0))).alias("score"))


@_register
def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2,000 collocations of two and three words of every language."""
    return collocations.collocations(table(spark, sf_dir, "documents"), first=2000).withColumnRenamed("grp", "lang")


ORACLES["op11_collocations"] = r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
grams AS (
    SELECT lang, size, array_to_string(w[p:p + size - 1], ' ') AS phrase, w[p:p + size - 1] AS ws
    FROM (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS p FROM words, (SELECT unnest([1, 2, 3]) AS size) WHERE len(w) >= size)),
f AS (SELECT lang, size, phrase, any_value(ws) AS ws, count(*) AS n FROM grams GROUP BY lang, size, phrase),
total AS (SELECT lang, sum(n) AS n FROM f WHERE size = 1 GROUP BY lang),
candidates AS (SELECT * FROM f WHERE size > 1 AND n >= 10),
cuts AS (
    SELECT c.lang, c.phrase, c.size, c.n AS a, x.n AS l, y.n AS r, k, (1000000 * CAST(c.n AS HUGEINT) * c.n) // (CAST(x.n AS HUGEINT) * y.n) AS score
    FROM (SELECT *, unnest(range(1, size)) AS k FROM candidates) c
    JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.ws[1:k], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.ws[k + 1:], ' ')),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_phrases AS (SELECT lang, array_to_string(ws[p:p + 1], ' ') AS phrase, n FROM (SELECT *, unnest([1, 2]) AS p FROM candidates WHERE size = 3)),
longer AS (SELECT lang, phrase, max(n) AS outer_n FROM inner_phrases GROUP BY lang, phrase),
kept AS (SELECT lowest.* FROM lowest LEFT JOIN longer g ON g.lang = lowest.lang AND g.phrase = lowest.phrase AND lowest.size = 2 WHERE g.outer_n IS NULL OR 100 * g.outer_n < 50 * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT ranked.lang, rank, phrase, a, l, r, CAST(total.n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM ranked JOIN total ON total.lang = ranked.lang WHERE rank <= 2000"""


@_register
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three hard negatives for each of the five positives of every fiftieth vector; a seventh of all labels is noise."""
    rows = table(spark, sf_dir, "embeddings").withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives.mine(rows, F.col("vec_id") % 50 == 0)


ORACLES["op12_hard_negatives"] = r"""
WITH usable AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
    FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
    SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
    FROM usable a JOIN usable b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
positives AS (SELECT * FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
hard AS (
    SELECT p.anchor_id, p.id AS positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id) AS rank,
        n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
    FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM hard WHERE rank <= 3"""


@_register
def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learned from the labels of four fifths."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "quality")
    kept = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    found = quality.assess(docs, quality.fit(docs, labels.where(~kept)))
    return found.select("doc_id", kept.alias("held_out"), F.col("quality_score").alias("score"), F.when(F.col("quality_score") >= 0.3, 1).otherwise(0).alias("predicted"), "n_passages", "top_passage")


QUERIES["pipeline"] = corpus_pipeline.run
