"""Labels, predictions, finding matches and confusion metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkwarden.functions import fixed_values as fv
from sparkwarden.functions import paths as px
from sparkwarden.functions import text as tx
from sparkwarden.functions.text import ColumnLike, col


def oracle_label(path: ColumnLike, rule_id: ColumnLike, category: ColumnLike, context: ColumnLike) -> Column:
    """Ordered decision list: struct (label TP / FP / UNKNOWN, reason).

    ``context`` is the path, the function, the lines around the hit and the match, joined.
    """
    p, kind, raw = col(path), col(category), col(context)

    def look(clean: Column) -> Column:
        sink = tx.has_any(clean, fv.SINK_TOKENS) | tx.one_of(kind, fv.SINK_CATEGORIES)
        return F.struct(
            tx.has_any(clean, fv.SOURCE_TOKENS).alias("source"), sink.alias("sink"),
            tx.strong_safe_signal(clean, kind).alias("safe"),
            tx.has_any(clean, fv.PLACEHOLDER_WORDS).alias("placeholder"),
            raw.rlike(fv.RANDOMNESS_CONTEXT).alias("sensitive"))

    seen = tx.bind(tx.strip_comments(raw), look)
    return tx.bind(seen, lambda s: _decide(p, col(rule_id), kind, s))


def _decide(path: Column, rule_id: Column, kind: Column, seen: Column) -> Column:
    def verdict(label: str, reason: str) -> Column:
        return F.struct(F.lit(label).alias("label"), F.lit(reason).alias("reason"))

    secret = kind == "hardcoded_secret"
    source, sink, safe = seen["source"], seen["sink"], seen["safe"]
    where = F.lower(path)
    configured = where.contains("config") | where.contains("settings") | where.contains(".env")
    weak = kind.isin("weak_crypto", "misconfiguration")
    return (
        F.when(px.any_part(path, fv.FP_HINT_PARTS), verdict("FP", "documentation/test/support file"))
        .when(secret & seen["placeholder"], verdict("FP", "placeholder secret"))
        .when(rule_id.isin(*fv.RANDOMNESS_RULES) & ~seen["sensitive"],
              verdict("FP", "randomness not used for security-sensitive value"))
        .when(secret & configured,
              verdict("TP", "runtime configuration contains hardcoded credential-like value"))
        .when(secret, verdict("FP", "credential-like token outside runtime-sensitive context"))
        .when(weak & safe, verdict("FP", "guarded or tutorial-like configuration"))
        .when(weak, verdict("TP", "security-relevant weak primitive/configuration"))
        .when((kind == "dangerous_function") & source & sink,
              verdict("TP", "dangerous function receives user-controlled input"))
        .when((kind == "auth_bypass") & source & sink,
              verdict("TP", "request-controlled update of account-sensitive field"))
        .when(source & sink & ~safe, verdict("TP", "source-to-sink evidence without strong guard"))
        .when(sink & ~safe & px.any_part(path, fv.TP_HINT_PARTS),
              verdict("TP", "sink in vulnerable application module"))
        .when(safe, verdict("FP", "guard/sanitization evidence present"))
        .otherwise(verdict("UNKNOWN", "insufficient evidence"))
    )


def signals(context: ColumnLike, matched_text: ColumnLike, category: ColumnLike) -> Column:
    """Struct (source, sink, safe) of a retrieved context."""
    return F.struct(
        tx.has_any(context, fv.SOURCE_TOKENS).alias("source"),
        (tx.has_any(context, fv.SINK_TOKENS) | tx.has_any(matched_text, fv.SINK_TOKENS)).alias("sink"),
        tx.strong_safe_signal(context, category).alias("safe"))


def predict_from_signals(category: ColumnLike, found: ColumnLike) -> Column:
    kind, s = col(category), col(found)
    source, sink, safe = s["source"], s["sink"], s["safe"]
    reached = source & sink
    return (
        F.when(kind.isin("dangerous_function", "auth_bypass") & reached, F.lit(True))
        .when(kind == "hardcoded_secret", sink | ~safe)
        .when(kind.isin("weak_crypto", "misconfiguration"), ~safe)
        .otherwise(reached & ~safe)
    )


def is_predicted_vulnerable(cwe: ColumnLike, severity: ColumnLike, evidence: ColumnLike,
                            strict: bool = False) -> Column:
    """Does a report claim a vulnerability?  ``strict`` asks for a listed severity."""
    weakness = F.upper(F.coalesce(F.nullif(col(cwe), F.lit("")), F.lit("UNMAPPED")))
    level = F.lower(F.coalesce(F.nullif(col(severity), F.lit("")), F.lit("unknown")))
    strength = F.lower(F.coalesce(F.nullif(col(evidence), F.lit("")), F.lit("weak")))
    grave = level.isin("critical", "high", "medium") if strict else ~level.isin("low", "unknown", "none")
    return (weakness != "UNMAPPED") & grave & (strength != "weak")


# --- metrics ----------------------------------------------------------------------------------

def confusion(df: DataFrame, by: Sequence[str] = (), predicted: str = "predicted", actual: str = "actual") -> DataFrame:
    """Counts TP, FP, FN, TN and the unrounded ratios, one row per group.

    The ratios are 0 where their divisor is 0.  Boolean sums combine before the shuffle, so a
    group of any size costs one partial row per task.
    """
    p = F.coalesce(F.col(predicted).cast("boolean"), F.lit(False))
    a = F.coalesce(F.col(actual).cast("boolean"), F.lit(False))
    counts = df.groupBy(*by).agg(
        F.count_if(p & a).alias("tp"), F.count_if(p & ~a).alias("fp"),
        F.count_if(~p & a).alias("fn"), F.count_if(~p & ~a).alias("tn"), F.count("*").alias("total"))

    def ratio(n: Column, d: Column) -> Column:
        return F.when(d > 0, n / d).otherwise(F.lit(0.0))

    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    # F1 from the ratios, as the harmonic mean is defined.
    return counts.withColumns({
        "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn),
        "accuracy": ratio(tp + tn, F.col("total"))}).withColumn(
        "f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def confusion_metrics(df: DataFrame, by: Sequence[str] = (), predicted: str = "predicted",
                      actual: str = "actual") -> DataFrame:
    """Metrics as reports print them: percentages with one decimal, F1 with two, half to even."""
    m = confusion(df, by, predicted, actual)
    percent = {c: F.bround(F.col(c) * 100, 1) for c in ("precision", "recall", "accuracy")}
    return m.withColumns({**percent, "f1": F.bround("f1", 2)}).withColumn("false_positive_count", F.col("fp"))


def fp_reduction(metrics: DataFrame, base: str, key: str = "strategy") -> DataFrame:
    """Share of the base's false positives that each other row avoids, in percent."""
    base_fp = metrics.filter(F.col(key) == base).agg(F.max("fp").alias("n")).scalar()
    return metrics.filter(F.col(key) != base).withColumn("fp_base", base_fp).select(
        key, "fp_base", "fp", F.when(F.col("fp_base") > 0, F.bround(
            (F.col("fp_base") - F.col("fp")) / F.col("fp_base") * 100, 1)).alias("reduction"))


def frequency(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))


def threshold_prediction(prob: ColumnLike, threshold: float = 0.5) -> Column:
    return F.coalesce(col(prob) > F.lit(threshold), F.lit(False))


# --- joins ------------------------------------------------------------------------------------

def band_join(candidates: DataFrame, findings: DataFrame, window: int = 5,
              keys: Sequence[str] = ("repo", "file_path"), line: str = "line") -> DataFrame:
    """Pairs of candidate and finding in one file at most ``window`` lines apart.

    Lines are cut into blocks as long as the whole band (2w + 1), so the band of a candidate touches at most two
    blocks.  The block is part of the join key: a file with very many findings is spread over many
    tasks, and a candidate meets only its neighbours.  The candidates are repeated, as findings are more and wider.
    """
    width = 2 * window + 1
    block = lambda at: F.floor(at / F.lit(width))
    left = candidates.withColumn("__block", F.explode(F.sequence(block(F.col(line) - window), block(F.col(line) + window))))
    right = findings.select(*keys, *[F.col(c).alias(f"f_{c}") for c in findings.columns if c not in keys])
    right = right.withColumn("__block", block(F.col(f"f_{line}")))
    near = F.abs(F.col(line) - F.col(f"f_{line}")) <= window
    return left.join(right, [*keys, "__block"]).filter(near).drop("__block")


def match_tool_findings(candidates: DataFrame, findings: DataFrame, window: int = 5,
                        keys: Sequence[str] = ("repo", "file_path"), key: str = "candidate_id",
                        finding_key: str = "finding_id", keep: int = 5) -> DataFrame:
    """Candidates with ``matched_count``, ``predicted`` and the ids of the first matches.

    Findings are reduced per line before they meet the candidates: a count and the first ``keep``
    ids.  The band around a line is gathered once, however many candidates the line has, and joins at most 2 * window + 1 rows.
    """
    at = [*keys, "line"]
    found = findings.select(*at, F.col(finding_key).alias("fid"))
    counts = found.groupBy(*at).agg(F.count("*").alias("n"))
    order = W.partitionBy(*at).orderBy("fid")
    first = found.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= keep).groupBy(*at).agg(
        F.collect_list("fid").alias("fids"))
    per_line = counts.join(first, at)
    near = band_join(candidates.select(*at).distinct(), per_line, window, keys)
    matched = near.groupBy(*at).agg(
        F.sum("f_n").alias("matched_count"),
        F.slice(F.array_sort(F.flatten(F.collect_list("f_fids"))), 1, keep).alias("first_matches"))
    out = candidates.join(matched, at, "left").select(key, *[c for c in candidates.columns if c != key], "matched_count", "first_matches")
    return out.withColumn("matched_count", F.coalesce("matched_count", F.lit(0).cast("long"))).withColumn(
        "predicted", F.col("matched_count") > 0)


def _bits(start: Column, end: Column) -> Column:
    """Number of binary digits of a span's length in lines."""
    return F.length(F.bin(end - start + 1))


def innermost(points: DataFrame, spans: DataFrame, keys: Sequence[str] = ("repo", "file_path")) -> DataFrame:
    """Innermost span (start_line..end_line) around each point's line, NULL when there is none.

    The narrowest span wins, then the earliest, then the id.  Points and spans never meet in pairs: a span is cut into aligned
    blocks of 1, 2, 4, ... lines, at most two of each length, and a block keeps the best extent that covers it.  A line then asks the
    one block of each length around it.  Lines are asked once however many points they hold, the minimum of numbers
    combines before the shuffle, and ids are looked up for the extents found only.  Lines are 32-bit numbers, as texts hold no more.
    """
    keys = list(keys)
    start, end = F.col("start_line").cast("long"), F.col("end_line").cast("long")
    low, high = F.lit(-(1 << 31)).cast("long"), F.lit((1 << 31) - 1).cast("long")
    fits = (start >= low) & (end <= high) & (end - start <= high)
    extent = F.when(fits, (end - start) * (1 << 32) + start - low).otherwise(
        F.raise_error(F.lit("line numbers of a span pass 32 bits")))
    proper = spans.filter(end >= start)
    cut = proper.select(*keys, start.alias("__from"), (end + 1).alias("__to"), extent.alias("__extent"), F.explode(
        F.sequence(F.lit(0), _bits(start, end) - 1)).alias("__level"))
    # The whole blocks of one length within the span; an odd one at either edge lies in no whole block of twice the length.
    cut = cut.select(*keys, "__level", "__extent", F.expr("shiftright(__from + shiftleft(1L, __level) - 1, __level)").alias("__first"),
                     F.expr("shiftright(__to, __level)").alias("__last")).filter("__first < __last")
    edges = F.array_compact(F.array(F.when(F.col("__first").bitwiseAND(1) == 1, F.col("__first")),
                                    F.when(F.col("__last").bitwiseAND(1) == 1, F.col("__last") - 1)))
    block = [*keys, "__level", "__block"]
    covered = cut.select(*keys, "__level", "__extent", F.explode(edges).alias("__block")).groupBy(*block).agg(F.min("__extent").alias("__extent"))

    levels = proper.groupBy(*keys).agg(F.max(_bits(start, end)).alias("__bits"))
    asked = points.select(*keys, "line").distinct().join(levels, keys).withColumn(
        "__level", F.explode(F.sequence(F.lit(0), F.col("__bits") - 1))).withColumn("__block", F.expr("shiftright(CAST(line AS LONG), __level)"))
    best = asked.join(covered, block).groupBy(*keys, "line").agg(F.min("__extent").alias("__extent")).withColumn(
        "__start", F.col("__extent").bitwiseAND((1 << 32) - 1) + low).withColumn("__end", F.col("__start") + F.shiftright("__extent", 32))
    bounds = [*keys, "__start", "__end"]
    named = proper.select(*keys, start.alias("__start"), end.alias("__end"), "node_id").join(
        best.select(*bounds).distinct(), bounds).groupBy(*bounds).agg(F.min("node_id").alias("inner_id"))
    inner = best.join(named, bounds).select(*keys, "line", "inner_id")
    return points.join(inner, [*keys, "line"], "left").select(*points.columns, "inner_id")


def containing_function(points: DataFrame, functions: DataFrame) -> DataFrame:
    """Function around each point, the file's own row when no function holds it."""
    keys = ["repo", "file_path"]
    inner = innermost(points, functions.filter(F.col("name") != "<file>"), keys)
    whole = functions.filter(F.col("name") == "<file>").groupBy(*keys).agg(F.min("node_id").alias("__file"))
    return inner.join(whole, keys, "left").withColumn(
        "function_id", F.coalesce("inner_id", "__file")).drop("inner_id", "__file")


def flagged_functions(functions: DataFrame, hits: DataFrame, model_flags: DataFrame) -> DataFrame:
    """Functions that hold a finding line or that the model flagged.

    A function without a start begins at 0 and one without an end never ends.
    """
    keys = ["repo", "file_path"]
    begin = F.coalesce(F.col("start_line"), F.lit(0))
    # Open ends cannot be cut into blocks; they meet the largest line of their file instead.
    bounded = functions.filter(F.col("end_line").isNotNull()).withColumn("start_line", begin)
    open_ended = functions.filter(F.col("end_line").isNull()).withColumn("start_line", begin)
    block = 64
    cut = bounded.select(*keys, "node_id", "start_line", "end_line").withColumn("__block", F.explode(
        F.sequence(F.floor(F.col("start_line") / block), F.floor(F.col("end_line") / block))))
    lines = hits.select(*keys, "line").distinct().withColumn("__block", F.floor(F.col("line") / block))
    within = cut.join(lines, [*keys, "__block"]).filter(
        F.col("line").between(F.col("start_line"), F.col("end_line"))).select("node_id")
    last = hits.groupBy(*keys).agg(F.max("line").alias("last_line"))
    beyond = open_ended.join(last, keys).filter(F.col("last_line") >= F.col("start_line")).select("node_id")
    flagged = within.unionByName(beyond).unionByName(model_flags.select("node_id")).distinct()
    return functions.join(flagged, "node_id", "left_semi")


# --- sampling and selection -------------------------------------------------------------------

def top_per_repo(candidates: DataFrame, limit: int = 35, repo: str = "repo") -> DataFrame:
    """First candidates of each repository: application modules first, then path and line."""
    order = W.partitionBy(repo).orderBy(
        F.when(px.any_part("file_path", fv.TP_HINT_PARTS), 0).otherwise(1), "file_path", "line", "rule_id", "candidate_id")
    return candidates.withColumn("pick", F.row_number().over(order)).filter(F.col("pick") <= limit)


def select_balanced(candidates: DataFrame, limit: int, repo: str = "repo", label: str = "oracle_label") -> DataFrame:
    """Per repository up to ``limit`` rows, half TP and half FP, the shortfall filled in order.

    Order: label (TP first), category, path, line, rule.  Each class contributes at most ``limit``
    rows, which is cut in every task before the shuffle; the rest works on those few rows.
    """
    sort = ["category", "file_path", "line", "rule_id", "candidate_id"]
    grouped = W.partitionBy(repo, label).orderBy(*sort)
    pool = candidates.filter(F.col(label).isin("TP", "FP")).withColumn(
        "__r", F.row_number().over(grouped)).filter(F.col("__r") <= limit)
    share = F.when(F.col(label) == "TP", limit // 2 + limit % 2).otherwise(limit // 2)
    fill = W.partitionBy(repo).orderBy(
        F.when(F.col("__r") <= share, 0).otherwise(1), F.when(F.col(label) == "TP", 0).otherwise(1), "__r")
    return pool.withColumn("pick", F.row_number().over(fill)).filter(F.col("pick") <= limit).drop("__r")


def class_counts(df: DataFrame, target: str = "target", max_rows: int = 0) -> DataFrame:
    """Rows each class contributes to a balanced sample (one row: n)."""
    both = df.agg(F.count_if(F.col(target) == 1).alias("pos"), F.count_if(F.col(target) == 0).alias("neg"))
    n = F.least("pos", "neg")
    return both.select((F.least(n, F.lit(max_rows // 2)) if max_rows > 0 else n).cast("long").alias("n"))


def balanced_sample(df: DataFrame, key: str, target: str = "target", max_rows: int = 0, seed: int = 1337) -> DataFrame:
    """The same number of rows of either class, chosen by a seeded hash of the key.

    The cut-off is a hash value per class, found through a histogram of the hash's leading bits:
    only the one bucket in which the cut falls is ranked, so a large class is never sorted whole.
    """
    hashed = df.filter(F.col(target).isin(0, 1)).withColumn("__h", F.xxhash64(F.col(key), F.lit(seed))).withColumn(
        "__b", F.shiftright("__h", 48))
    n = class_counts(df, target, max_rows).scalar()
    histogram = hashed.groupBy(target, "__b").agg(F.count("*").alias("__k"))
    running = histogram.withColumn("__before", F.coalesce(F.sum("__k").over(
        W.partitionBy(target).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).withColumn("__n", n)
    open_buckets = running.filter(F.col("__before") < F.col("__n"))
    whole = open_buckets.filter(F.col("__before") + F.col("__k") <= F.col("__n")).select(target, "__b")
    split = open_buckets.filter(F.col("__before") + F.col("__k") > F.col("__n")).select(
        target, "__b", (F.col("__n") - F.col("__before")).alias("__take"))
    taken = hashed.join(whole, [target, "__b"], "left_semi").select(*df.columns)
    order = W.partitionBy(target, "__b").orderBy("__h", key)
    edge = hashed.join(split, [target, "__b"]).withColumn("__r", F.row_number().over(order)).filter(
        F.col("__r") <= F.col("__take")).select(*df.columns)
    return taken.unionByName(edge)


def public_candidate(candidates: DataFrame) -> DataFrame:
    return candidates.drop("oracle_label", "oracle_reason")


# --- constraint suite -------------------------------------------------------------------------

def bounds_feasible(constraints: DataFrame) -> DataFrame:
    """Is each guard's conjunction of integer bounds satisfiable?

    ``constraints``: case_id, guard ('primary' / 'alternative'), var, op (> >= < <= ==), value.
    """
    op, v = F.col("op"), F.col("value")
    low = F.when(op == ">", v + 1).when(op.isin(">=", "=="), v)
    high = F.when(op == "<", v - 1).when(op.isin("<=", "=="), v)
    per_var = constraints.groupBy("case_id", "guard", "var").agg(F.max(low).alias("lo"), F.min(high).alias("hi"))
    fits = F.col("lo").isNull() | F.col("hi").isNull() | (F.col("lo") <= F.col("hi"))
    return per_var.groupBy("case_id", "guard").agg(F.bool_and(fits).alias("feasible"))


def constraint_verdicts(constraints: DataFrame) -> DataFrame:
    """Per case: flagged after the primary guard alone, and after the alternative one too."""
    f = bounds_feasible(constraints)
    primary = F.coalesce(F.bool_or(F.when(F.col("guard") == "primary", F.col("feasible"))), F.lit(False))
    return f.groupBy("case_id").agg(
        primary.alias("first_pass"),
        F.coalesce(F.bool_or("feasible"), F.lit(False)).alias("second_pass"))


def case_grid(templates: DataFrame, n: int, prefix: str) -> DataFrame:
    """``n`` cases by cycling through numbered templates (slot 0..k-1): id, variant and template.

    Each template row writes its own cases, so there is no join.
    """
    k = F.lit(templates.agg(F.count("*").alias("k")).scalar())
    mine = F.sequence(F.col("slot").cast("int"), F.lit(n - 1), F.col("__k"))
    return templates.filter(F.col("slot") < n).withColumn("__k", k.cast("int")).withColumn("i", F.explode(mine)).select(
        F.concat(F.lit(prefix), F.lpad((F.col("i") + 1).cast("string"), 2, "0")).alias("case_id"),
        F.floor(F.col("i") / F.col("__k")).alias("variant"), *[c for c in templates.columns if c != "slot"])
