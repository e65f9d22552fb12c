"""Listings and dashboards over vulnerability records, posts and conversations."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkwarden.functions.text import ColumnLike, col
from sparkwarden.operators.graph import contains_ci, page


def published_at(column: ColumnLike) -> Column:
    """Timestamp of a date column that may be text; blanks and malformed values are NULL."""
    return F.try_to_timestamp(F.nullif(F.trim(col(column).cast("string")), F.lit("")))


def clean_vendor(column: ColumnLike) -> Column:
    """Distinct words, each with a capital first letter."""
    flat = F.trim(F.regexp_replace(col(column), "[,_]", " "))
    unique = F.array_distinct(F.split(F.lower(flat), r"\s+"))
    return F.array_join(F.transform(unique, lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.substring(w, 2, 1 << 20))), " ")


def product_name(column: ColumnLike) -> Column:
    """Underscores to blanks, runs of one repeated word to one, initial capitals."""
    spaced = F.replace(col(column), F.lit("_"), F.lit(" "))
    return F.initcap(F.regexp_replace(spaced, r"(?iU)\b(\w+)(?:\s+\1\b)+", "$1"))


def with_total(df: DataFrame, paged: DataFrame, name: str = "total") -> DataFrame:
    """Adds the row count of ``df`` to a page of it; the count is a scalar, not a window."""
    return paged.withColumn(name, df.agg(F.count("*").alias("n")).scalar())


def cve_list(cves: DataFrame, search: str = "", page_number: int = 1, limit: int = 20,
             raw_like: bool = False) -> DataFrame:
    """A page of records, newest first, with the total of the search."""
    search = search.strip()
    found = cves
    if search.upper().startswith("CVE-"):
        found = cves.filter(F.upper("id").startswith(search.upper()))
    elif search:
        found = cves.filter(contains_ci("title", search, raw_like)
                            | contains_ci("vendor_product", search, raw_like))
    number = max(1, page_number)
    chosen = page(found, [F.desc_nulls_last("published_date"), "id"], limit, (number - 1) * limit)
    return with_total(found, chosen).withColumn("vendor_product", clean_vendor("vendor_product"))


def cves_by_date(cves: DataFrame, year: int, month: int, day: int, limit: int = 50) -> DataFrame:
    """Records of one day, as a range on the raw column where it is a timestamp (so it prunes)."""
    first = date(year, month, day)
    after = first + timedelta(days=1)
    kind = dict(cves.dtypes)["published_date"]
    when = F.col("published_date") if kind.startswith("timestamp") else published_at("published_date")
    of_day = cves.filter((when >= F.lit(first).cast("timestamp")) & (when < F.lit(after).cast("timestamp")))
    return of_day.orderBy(F.desc_nulls_last("cvss_score"), "id").limit(limit).select(
        "id", "title", "cvss_score", "vendor_product")


def severity_label(column: ColumnLike) -> Column:
    c = col(column)
    blank = c.isNull() | (F.trim(c) == "") | (F.upper(c) == "N/A")
    return F.when(blank, F.lit("UNKNOWN")).otherwise(F.upper(c))


def severity_histogram(cves: DataFrame, column: str = "severity") -> DataFrame:
    return cves.groupBy(severity_label(column).alias("severity")).agg(F.count("*").alias("n"))


def top_products(cves: DataFrame, limit: int = 5, column: str = "vendor_product") -> DataFrame:
    c = F.col(column)
    usable = c.isNotNull() & (c != "") & ~F.lower(c).startswith("n/a") & ~c.startswith("-") & (
        c != "*") & (F.length(c) > 2)
    # Raw names repeat far more often than clean ones differ: counting them first runs the
    # pattern once per distinct name.
    counted = cves.filter(usable).groupBy(column).agg(F.count("*").alias("k"))
    return counted.groupBy(product_name(column).alias("vendor_product")).agg(
        F.sum("k").alias("n")).orderBy(F.desc("n"), "vendor_product").limit(limit)


def cve_trend(cves: DataFrame, year: int | str | None = None, month: int | str | None = None,
              column: str = "published_date") -> DataFrame:
    """Counts per year, per month of a year, or per day of a month; 'all' means unset."""
    year = None if year in (None, "", "all") else int(year)
    month = None if month in (None, "", "all") else int(month)
    kind = dict(cves.dtypes)[column]
    when = F.col(column) if kind.startswith("timestamp") else published_at(column)
    dated = cves.filter(when.isNotNull())
    unit = F.year
    if year is not None:
        first, after, unit = date(year, 1, 1), date(year + 1, 1, 1), F.month
        if month is not None:
            first = date(year, month, 1)
            after = date(year + month // 12, month % 12 + 1, 1)
            unit = F.dayofmonth
        dated = dated.filter((when >= F.lit(first).cast("timestamp")) & (when < F.lit(after).cast("timestamp")))
    return dated.groupBy(unit(when).alias("label")).agg(F.count("*").alias("n"))


def cve_trend_sets(cves: DataFrame, column: str = "published_date") -> DataFrame:
    """All three trend levels in one pass."""
    kind = dict(cves.dtypes)[column]
    when = F.col(column) if kind.startswith("timestamp") else published_at(column)
    parts = cves.filter(when.isNotNull()).select(
        F.year(when).alias("y"), F.month(when).alias("m"), F.dayofmonth(when).alias("d"))
    # Days are few, so the levels are rolled up from the daily counts.
    daily = parts.groupBy("y", "m", "d").agg(F.count("*").alias("k"))
    y, m, d = F.col("y"), F.col("m"), F.col("d")
    return daily.groupingSets([[y], [y, m], [y, m, d]], y, m, d).agg(F.sum("k").alias("n"))


def linear_trend(points: DataFrame, order: str = "label", value: str = "n") -> DataFrame:
    """Least-squares slope and intercept over x = 0, 1, ... in label order.

    ``points`` is a trend, whose length is bounded by the calendar, so one ranking task is fine.
    """
    numbered = points.withColumn("x", F.row_number().over(W.orderBy(order)) - 1)
    return numbered.agg(F.regr_slope(value, "x").alias("slope"), F.regr_intercept(value, "x").alias("intercept"))


def critical_recent(cves: DataFrame, days: int = 30, limit: int = 5, now: Column | None = None,
                    column: str = "published_date") -> DataFrame:
    """Latest critical records of the last ``days`` days before ``now`` (the newest record)."""
    end = cves.agg(F.max(column).alias("t")).scalar() if now is None else now
    windowed = cves.withColumn("__now", end)
    recent = windowed.filter((F.upper("severity") == "CRITICAL") & (
        F.col(column) >= F.col("__now") - F.expr(f"INTERVAL {int(days)} DAYS")))
    return recent.drop("__now").orderBy(F.col(column).asc(), "id").limit(limit)


def cwe_history(cves: DataFrame, bridge: DataFrame, dictionary: DataFrame, cwe_id: str,
                limit: int = 15, unknown: str = "Unknown Vulnerability") -> DataFrame:
    """Highest-scored records of one weakness, beside the weakness name."""
    wanted = cwe_id.upper()
    ids = bridge.filter(F.col("cwe_id") == wanted).select(F.col("cve_id").alias("id"))
    name = dictionary.filter(F.col("cwe_id") == wanted).agg(F.min("cwe_name").alias("n"))
    best = cves.join(ids, "id").orderBy(F.desc_nulls_last("cvss_score"), "id").limit(limit)
    return best.withColumn("cwe_name", F.coalesce(name.scalar(), F.lit(unknown))).select(
        "id", F.coalesce("cvss_score", F.lit(0.0)).alias("score"), F.col("description").alias("desc"), "cwe_name")


def blog_list(posts: DataFrame, page_number: int = 1, limit: int = 9, order: str = "published_at",
              key: str = "id") -> DataFrame:
    """A page of posts, newest first, each row with the pagination fields."""
    number = max(1, page_number)
    chosen = with_total(posts, page(posts, [F.desc(order), key], limit, (number - 1) * limit), "total_items")
    pages = F.ceil(F.col("total_items") / F.lit(limit))
    return chosen.withColumn("total_pages", pages).withColumns({
        "current_page": F.lit(number), "items_per_page": F.lit(limit),
        "has_next_page": F.lit(number) < F.col("total_pages"), "has_prev_page": F.lit(number > 1)})


def get_by_id(df: DataFrame, key: str, value, owner: tuple | None = None, drop: tuple[str, ...] = ()) -> DataFrame:
    out = df.filter(F.col(key) == F.lit(value))
    if owner:
        out = out.filter(F.col(owner[0]) == F.lit(owner[1]))
    return out.drop(*drop)


# --- conversations ---------------------------------------------------------------------------

def conversation_title(text: ColumnLike) -> Column:
    c = col(text)
    return F.concat(F.substring(c, 1, 30), F.when(F.length(c) > 30, F.lit("...")).otherwise(F.lit("")))


def conversations_for_user(conversations: DataFrame, user_id) -> DataFrame:
    return conversations.filter(F.col("user_id") == F.lit(user_id)).orderBy(F.desc("updated_at")).select(
        "conversation_id", "title", "updated_at")


def conversation_counts(messages: DataFrame, key: str = "conv_id", by: str = "role") -> DataFrame:
    return messages.groupBy(by).agg(F.count("*").alias("messages"), F.count_distinct(key).alias("conversations"))


def recent_messages(messages: DataFrame, n: int = 4, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """Last ``n`` messages of every conversation (cut to n rows per task before the shuffle)."""
    latest = W.partitionBy(key).orderBy(F.desc(order))
    return messages.withColumn("back", F.row_number().over(latest)).filter(F.col("back") <= n)


def conversation_summaries(messages: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """Per conversation: title from its first user message, and its number of messages."""
    first = F.min_by("text", F.when(F.col("role") == "user", F.col(order)))
    return messages.groupBy(key).agg(
        conversation_title(first).alias("title"), F.count("*").alias("messages"))


def latest_state(progress: DataFrame, key: str, order: str, *columns: str) -> DataFrame:
    """Newest state of every key; an aggregate, so it combines before the shuffle."""
    return progress.groupBy(key).agg(
        F.max_by(F.struct(*columns), F.struct(order, *columns)).alias("s"),
        F.max(order).alias(order)).select(key, order, "s.*")
