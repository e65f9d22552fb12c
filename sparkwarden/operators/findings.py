"""Finding filters, ranking, routing and mapping to weakness classes.

Two shapes occur.  *Items* are one row per scan result: ``file_path``, ``findings`` (array, NULL
for a layer-2 item), ``result`` (struct, NULL for a layer-1 item), ``layer`` and ``seq``.  *Long*
tables hold one row per rule hit and stay spread for files with any number of hits.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkwarden.functions import fixed_values as fv
from sparkwarden.functions import paths as px
from sparkwarden.functions.text import ColumnLike, col, lookup, one_of, words



def _norm(value: ColumnLike) -> Column:
    return F.trim(F.lower(F.coalesce(col(value), F.lit(""))))


def severity_rank(severity: ColumnLike) -> Column:
    return F.coalesce(F.element_at(lookup(fv.SEVERITY_RANK, "int"), _norm(severity)), F.lit(0))


def is_important_rule(severity: ColumnLike, category: ColumnLike, rule_id: ColumnLike,
                      cwe: ColumnLike | None = None) -> Column:
    """Security-relevant rule hits of at least warning level.

    ``cwe`` is accepted for completeness of the signature: a hit with a weakness id passes only at
    error level or above, and such a hit passes by its level alone.
    """
    level, kind, rid = _norm(severity), _norm(category), _norm(rule_id)
    noisy = one_of(kind, fv.NOISE_CATEGORIES) | rid.rlike("|".join(fv.NOISE_RULE_PARTS))
    return one_of(level, fv.IMPORTANT_SEVERITIES) & ~noisy & (
        one_of(kind, fv.SECURITY_CATEGORIES) | level.isin("critical", "error"))


def is_high_priority(severity: ColumnLike, findings: ColumnLike, has_result: ColumnLike) -> Column:
    """Items worth a closer look.  The item's own severity only counts when it carries a result;
    an item without findings passes."""
    own = F.when(col(has_result), _norm(severity)).otherwise(F.lit(""))
    low = list(fv.LOW_SEVERITIES)
    found = col(findings)
    nested = F.exists(found, lambda f: F.exists(
        f["rules"], lambda r: ~F.lower(F.coalesce(r["severity"], F.lit(""))).isin(*low)))
    empty = found.isNull() | (F.size(found) == 0)
    return ~own.isin(*low) | empty | F.coalesce(nested, F.lit(False))


def filter_findings(findings: ColumnLike) -> Column:
    """Important rules only, each finding's rules and the findings themselves by falling rank."""
    def rank(r: Column) -> Column:
        return severity_rank(r["severity"])

    def falling(a: Column, b: Column) -> Column:
        return F.when(a > b, -1).when(a < b, 1).otherwise(0)

    def trim(f: Column) -> Column:
        kept = F.filter(f["rules"], lambda r: is_important_rule(
            r["severity"], r["category"], F.coalesce(r["rule_id"], r["name"])))
        return f.withField("rules", F.array_sort(kept, lambda a, b: falling(rank(a), rank(b))))

    kept = F.filter(F.transform(col(findings), trim), lambda f: F.size(f["rules"]) > 0)
    top = lambda f: rank(f["rules"][0])
    return F.array_sort(kept, lambda a, b: falling(top(a), top(b)))


def node_id_of(items: DataFrame) -> Column:
    names = [n for n in ("file_path", "node_id", "id", "file") if n in items.columns]
    return px.extract_node_id(*names)


def _scope(*frames: DataFrame) -> list[str]:
    """The repository, where all frames name it: paths are unique only within one."""
    return ["repo"] if all("repo" in f.columns for f in frames) else []


def dedup_by_node(items: DataFrame, order: Sequence[str] = ("layer", "seq")) -> DataFrame:
    """First item of every node (of a repository, if items name it).  Each task keeps one item of a node before the shuffle;
    items without a node stay apart with an empty ``node_id``."""
    named = items.withColumn("node_id", node_id_of(items))
    turn = Window.partitionBy(*_scope(items), "node_id").orderBy(*order)
    first = named.filter(F.col("node_id") != "").withColumn("__turn", F.row_number().over(turn)).filter(F.col("__turn") == 1).drop("__turn")
    blank = named.filter(F.coalesce("node_id", F.lit("")) == "")
    return first.unionByName(blank).select("node_id", *items.columns)


def route_findings(items: DataFrame) -> DataFrame:
    """Adds ``route`` to deduplicated items: job, skipped_path, skipped_low or no_node."""
    severity = F.col("severity") if "severity" in items.columns else F.lit(None).cast("string")
    path = px.bare_path("node_id")
    important = is_high_priority(severity, "findings", F.col("result").isNotNull())
    return items.withColumn("route", F.when(F.col("node_id") == "", "no_node")
                            .when(px.should_ignore_file(path), "skipped_path")
                            .when(~important, "skipped_low").otherwise("job"))


def skipped_rows(routed: DataFrame) -> DataFrame:
    """Placeholder results of everything that is not a job."""
    why = F.when(F.col("route") == "skipped_path", "Ignored benchmark/non-application path").when(
        F.col("route") == "skipped_low", "Low-priority finding skipped").otherwise(
        "Cannot infer graph node_id from scan result.")
    return routed.filter(F.col("route") != "job").select(
        *_scope(routed), "node_id", px.bare_path("node_id").alias("file_path"), F.lit("SKIPPED").alias("selected_cwe_id"),
        why.alias("selected_cwe_name"), F.lit("Low").alias("severity"), "route")


def failed_rows(failures: DataFrame) -> DataFrame:
    """Result rows of jobs that failed or ran out of time; ``kind`` is ERROR or TIMEOUT."""
    return failures.select(
        *_scope(failures), "node_id", px.bare_path("node_id").alias("file_path"), F.col("kind").alias("selected_cwe_id"),
        F.when(F.col("kind") == "TIMEOUT", "Scan timed out").otherwise("Scan failed").alias("selected_cwe_name"),
        F.lit("Unknown").alias("severity"), F.substring("message", 1, 500).alias("selected_cwe_reason"))


def attach_rule_findings(layer2: DataFrame, rule_files: DataFrame) -> DataFrame:
    """Layer-2 items with the rule findings of the same file (``layer1_findings``)."""
    scope = _scope(layer2, rule_files)
    keyed = rule_files.select(*scope, px.bare_path("file_path").alias("__path"),
                              F.col("findings").alias("layer1_findings"))
    return layer2.withColumn("__path", px.bare_path(px.to_file_node_id("file_path"))).join(
        keyed, [*scope, "__path"], "left").drop("__path")


# --- grouping by file ------------------------------------------------------------------------

def rank_files(rule_hits: DataFrame, layer2: DataFrame, max_files: int = 0) -> DataFrame:
    """Files by falling rank of their worst important finding; a layer-2 item counts as rank 2.

    ``rule_hits`` is long (file_path, line, rule_id, category, severity) and ``layer2`` has
    file_path.  Both sides are reduced per file before they meet; 0 lifts the cap.
    """
    scope = _scope(rule_hits, layer2)
    hits = rule_hits.filter(
        (px.bare_path("file_path") != "") & ~px.should_ignore_file("file_path")
        & is_important_rule("severity", "category", "rule_id"))
    by_rule = hits.groupBy(*scope, px.bare_path("file_path").alias("file_path")).agg(
        F.max(severity_rank("severity")).alias("file_rank"),
        F.count_distinct("line").alias("layer1_findings"),
        F.lit(0).cast("long").alias("layer2_items"))
    path = px.bare_path(px.extract_node_id("file_path"))
    by_model = layer2.filter((path != "") & ~px.should_ignore_file(path)).groupBy(
        *scope, path.alias("file_path")).agg(
        F.lit(2).alias("file_rank"), F.lit(0).cast("long").alias("layer1_findings"),
        F.count("*").alias("layer2_items"))
    ranked = by_rule.unionByName(by_model).groupBy(*scope, "file_path").agg(
        F.max("file_rank").alias("file_rank"), F.sum("layer1_findings").alias("layer1_findings"),
        F.sum("layer2_items").alias("layer2_items"))
    if max_files > 0:
        return ranked.orderBy(F.desc("file_rank"), "file_path", *scope).limit(max_files)
    return ranked


def filter_stats(items: DataFrame, max_files: int = 0) -> DataFrame:
    """The eight counters of the file grouping, from one pass over the items."""
    layer1 = F.col("findings").isNotNull()
    layer2 = ~layer1 & F.col("result").isNotNull()
    path = F.when(layer1, px.bare_path(F.coalesce("file_path", F.lit("")))).otherwise(
        px.bare_path(node_id_of(items)))
    ignored = px.should_ignore_file("__path")
    flagged = (
        items.withColumn("__path", path).withColumn("__l1", layer1).withColumn("__l2", layer2)
        .withColumn("__live", (F.trim("__path") != "") & ~ignored)
        .withColumn("__ignored", (F.trim("__path") != "") & ignored & (F.col("__l1") | F.col("__l2")))
        .withColumn("__kept", F.when(F.col("__l1") & F.col("__live"),
                                     F.size(filter_findings("findings"))).otherwise(0))
    )
    per_file = flagged.groupBy(*_scope(items), "__path").agg(
        F.count("*").alias("n"),
        F.sum(F.col("__ignored").cast("long")).alias("ignored"),
        F.sum((F.col("__l1") & F.col("__live") & (F.col("__kept") == 0)).cast("long")).alias("dropped"),
        F.sum(F.col("__kept").cast("long")).alias("kept"),
        F.sum((F.col("__l2") & F.col("__live")).cast("long")).alias("l2"))
    files = F.sum(((F.col("kept") > 0) | (F.col("l2") > 0)).cast("long"))
    capped = F.least(files, F.lit(max_files).cast("long")) if max_files > 0 else files
    return per_file.agg(
        F.sum("n").alias("input_items"), F.sum("ignored").alias("ignored_path_items"),
        F.sum("dropped").alias("dropped_low_value_layer1_items"),
        F.sum("kept").alias("layer1_findings_kept"), F.sum("l2").alias("layer2_items_kept"),
        files.alias("files_before_cap"), capped.alias("files_after_cap"),
        F.lit(max_files).cast("long").alias("max_repository_files"))


# --- reports ---------------------------------------------------------------------------------

def cwe_of(category: ColumnLike, rule_id: ColumnLike) -> Column:
    return F.coalesce(F.element_at(lookup(fv.CWE_BY_CATEGORY), F.coalesce(col(category), F.lit(""))), col(rule_id), F.lit("UNKNOWN"))


def canonical_cwe(cwe: ColumnLike) -> Column:
    """CWE-089 and CWE-89 are the same weakness."""
    return F.regexp_replace(F.upper(col(cwe)), r"^CWE-0*(\d+)$", "CWE-$1")


def flatten_to_reports(matches: DataFrame) -> DataFrame:
    """One report row per rule hit (long form in, so nothing is exploded)."""
    where = F.col("line").cast("string")
    description = F.coalesce("description", F.lit(""))
    return matches.select(
        *_scope(matches), F.concat(F.lit("File:"), F.col("file_path")).alias("node_id"), "file_path", "line", "rule_id",
        cwe_of("category", "rule_id").alias("selected_cwe_id"),
        F.coalesce("name", F.lit("Vulnerability")).alias("selected_cwe_name"),
        F.initcap(F.coalesce("severity", F.lit("High"))).alias("severity"),
        F.concat(F.lit("Line "), where, F.lit(": "), description, F.lit("\nCode: "),
                 F.col("line_content")).alias("selected_cwe_reason"),
        F.concat(F.lit("Detected by Layer 1 rule at line "), where, F.lit(" of "), F.col("file_path"),
                 F.lit(". "), description).alias("root_cause"),
        F.lit("").alias("attack_path"), F.lit("").alias("impact"),
        F.lit("Follow secure coding guidance.").alias("remediation"),
        F.lit(None).cast("string").alias("secure_code_example"),
        F.lit(True).alias("layer1_raw"))


def combine_layers(*parts: DataFrame) -> DataFrame:
    """Bag union by column name; columns a layer lacks are NULL."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def format_findings(matches: DataFrame) -> DataFrame:
    """One text line per distinct (repository, file, line, rule)."""
    scope = _scope(matches)
    turn = Window.partitionBy(*scope, "file_path", "line", "rule_id").orderBy("rule_seq", "match_seq")
    first = matches.select(*scope, "file_path", "line", "rule_id", "severity", "source", "name", "description", "rule_seq", "match_seq").withColumn(
        "__turn", F.row_number().over(turn)).filter(F.col("__turn") == 1)
    text = F.concat(
        F.lit("  ⚠ ["), F.upper("severity"), F.lit("]["), F.col("source"), F.lit("] Line "),
        F.col("line").cast("string"), F.lit(": "), F.col("name"), F.lit(" — "),
        F.substring("description", 1, 100))
    return first.select(*scope, "file_path", "line", "rule_id", text.alias("text"))


def issue_index(items: DataFrame) -> DataFrame:
    """Key of every item: its kind (function or file) and identifier."""
    kind = F.when(F.col("file_path").startswith("Function:"), "function").when(
        F.col("file_path").startswith("File:"), "file")
    return items.withColumn("kind", kind).filter(F.col("kind").isNotNull())


def layer_counts(rule_files: DataFrame, layer2: DataFrame, jobs: DataFrame) -> DataFrame:
    """files, findings, layer-2 items and jobs as (layer, n) rows."""
    def row(name: str, df: DataFrame, value: Column) -> DataFrame:
        return df.agg(F.coalesce(value, F.lit(0)).cast("long").alias("n")).select(F.lit(name).alias("counter"), "n")

    return (
        row("layer1_files", rule_files, F.count("*"))
        .unionByName(row("layer1_findings", rule_files, F.sum(F.size("findings"))))
        .unionByName(row("layer2_items", layer2, F.count("*")))
        .unionByName(row("layer3_jobs", jobs, F.count("*")))
    )


# --- weakness candidates ---------------------------------------------------------------------

def cwe_candidates(spark: SparkSession, categories: DataFrame, dictionary: DataFrame,
                   limit: int = 16) -> DataFrame:
    """Candidate weaknesses per category in order: the category's own, then the defaults.

    The candidate list is a fixed table of a few dozen ids, so it is an array expression; only the
    dictionary is joined.
    """
    table = lookup({k: ",".join(v) for k, v in fv.CWE_CANDIDATES_BY_CATEGORY.items()})
    own = F.coalesce(F.split(F.element_at(table, F.col("category")), ","), F.array().cast("array<string>"))
    ids = F.array_distinct(F.concat(own, words(fv.DEFAULT_CWES)))
    asked = categories.select("category").distinct().select(
        "category", F.posexplode(ids).alias("pos", "cwe_id"))
    known = asked.join(dictionary.select("cwe_id", "cwe_name"), "cwe_id")
    from pyspark.sql import Window as W

    order = W.partitionBy("category").orderBy("pos")
    return known.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit).select(
        "category", "rank", "cwe_id", "cwe_name")


def prefilter_cwe(evidence: DataFrame, dictionary: DataFrame, key: str = "evidence_id",
                  text: str = "evidence") -> DataFrame:
    """Weaknesses that the evidence text names or hints at: (key, cwe_id, cwe_name, whole_dictionary).

    Where fewer than three qualify, every weakness is a candidate; such evidence has the flag ``whole_dictionary`` on its rows (one row
    without a weakness, if none qualified), and the dictionary is not copied to it.

    Both sides meet by equality: an id that the text contains is a prefix of an id written there, and a hint is one of a dozen fixed
    words.  The dictionary may have any size.  Ids have the form CWE-digits.
    """
    asked = evidence.select(key, F.explode(_signs_in(F.col(text))).alias("sign"))
    hits = asked.join(_dictionary_signs(dictionary), "sign").select(key, "cwe_id", "cwe_name").distinct()
    counted = hits.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    flagged = evidence.select(key).distinct().join(counted, key, "left").select(key, (F.coalesce("n", F.lit(0)) < 3).alias("whole_dictionary"))
    return flagged.join(hits, key, "left").select(key, "cwe_id", "cwe_name", "whole_dictionary")


def _signs_in(text: Column) -> Column:
    """What of a text can name a weakness, distinct and sorted: hint words, and ids that a written id begins with."""
    low = F.lower(F.coalesce(text, F.lit("")))
    hinted = F.filter(words(fv.CWE_PREFILTER_KEYWORDS), lambda k: low.contains(k))
    written = F.array_distinct(F.regexp_extract_all(low, F.lit(r"cwe-[0-9]+"), F.lit(0)))
    contained = F.flatten(F.transform(written, lambda w: F.transform(F.sequence(F.lit(5), F.length(w)), lambda n: F.left(w, n))))
    return F.array_sort(F.array_distinct(F.concat(contained, hinted)))


def _listed(dictionary: DataFrame) -> DataFrame:
    """The dictionary's weaknesses, each id once (its smallest name, named ones first)."""
    rows = dictionary.select(F.trim(F.upper("cwe_id")).alias("cwe_id"), "cwe_name").filter(F.col("cwe_id") != "")
    return rows.groupBy("cwe_id").agg(F.min("cwe_name").alias("cwe_name"))


def _dictionary_signs(dictionary: DataFrame) -> DataFrame:
    name = F.lower(F.coalesce("cwe_name", F.lit("")))
    return _listed(dictionary).select("cwe_id", "cwe_name", F.explode(F.concat(
        F.array(F.lower("cwe_id")), F.filter(words(fv.CWE_PREFILTER_KEYWORDS), lambda k: name.contains(k)))).alias("sign"))


#: The set of evidence for which fewer than three weaknesses qualify: the whole dictionary.
WHOLE_DICTIONARY = "all"


def weakness_sets(evidence: DataFrame, dictionary: DataFrame, key: str = "evidence_id", text: str = "evidence",
                  limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The candidates of ``prefilter_cwe`` with every set stored once: (key, set_id) and (set_id, rank, cwe_id, cwe_name).

    Evidence of the same signs has the same set, so the rows grow with the evidence plus the distinct sets, not with their product.
    Evidence with fewer than three weaknesses points to the set ``all``, which holds the dictionary, once.  A set is ordered by the
    number of its ids; ``limit`` keeps its first ones (12 in the reference's fast mode).  Null text has no signs.
    """
    signed = evidence.select(key, _signs_in(F.col(text)).alias("signs")).withColumn("set_id", F.md5(F.concat_ws("|", "signs")))
    combinations = signed.groupBy("set_id").agg(F.first("signs").alias("signs"))
    hits = combinations.select("set_id", F.explode("signs").alias("sign")).join(_dictionary_signs(dictionary), "sign").select(
        "set_id", "cwe_id", "cwe_name").distinct()
    enough = hits.groupBy("set_id").agg(F.count("*").alias("n")).filter("n >= 3").select("set_id", F.lit(True).alias("enough"))
    links = signed.join(enough, "set_id", "left").select(key, F.when(F.col("enough"), F.col("set_id")).otherwise(F.lit(WHOLE_DICTIONARY)).alias("set_id"))
    sets = hits.join(enough, "set_id", "left_semi").unionByName(
        _listed(dictionary).select(F.lit(WHOLE_DICTIONARY).alias("set_id"), "cwe_id", "cwe_name"))
    order = Window.partitionBy("set_id").orderBy(F.length("cwe_id"), "cwe_id")
    ranked = sets.withColumn("rank", F.row_number().over(order))
    return links, (ranked if limit is None else ranked.filter(F.col("rank") <= limit)).select("set_id", "rank", "cwe_id", "cwe_name")
