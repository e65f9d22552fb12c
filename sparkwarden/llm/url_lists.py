"""URL filters by a temporal list join.

Lists change: an entry (list, pattern, action, at) adds a pattern to a list or removes it.  A pattern is a host or a parent domain.
Entries become validity intervals, and every capture is judged by the entries that were active when it was fetched, not by
those of today.

Intervals are cut at days, so the as-of join is an equality join: a capture meets the pieces of its host's patterns on its
day.  What happens within a day is ordered there; what lasts longer is known from one row per pattern and day.  Whole days are
held in blocks of 32, so a long interval has few pieces.  A pattern that a third of all entries or captures name is thus spread over its days, and
no window is larger than a pattern's entries of one day or its number of days.

An entry takes effect at its time; of several at one time a removal comes last.  Captures or entries with a null part match
nothing; captures without time have no active list.  Equal captures (url and time) are judged once and get equal results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkwarden.llm.common import Scratch

SPAN = 32


def host_of(url: Column) -> Column:
    """Lower-case host of a URL without user and port; null without one."""
    found = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.when(found != "", found)


def patterns_of(host: Column) -> Column:
    """The host and its parent domains of at least two labels."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def _day(at: Column) -> Column:
    return F.datediff(at.cast("date"), F.lit("1970-01-01").cast("date"))


def _start(day: Column) -> Column:
    return F.date_from_unix_date(day).cast("timestamp")


def pieces(entries: DataFrame, horizon: Column, scratch: Scratch) -> DataFrame:
    """(list, pattern, unit, slot, begin, finish): where a list holds a pattern, by day (unit 0) and block of whole days (unit 1).

    ``horizon`` is the last day that matters.
    """
    key = ["list", "pattern"]
    rows = scratch.save(entries.where("list is not null and pattern is not null and action is not null and at is not null").select(*key, "action", "at", _day(F.col("at")).alias("day")).distinct(), "entries")
    within = Window.partitionBy(*key, "day").orderBy("at", "action")
    inside = rows.withColumn("then", F.lead("at").over(within)).where("action = 'add'").select(
        *key, F.lit(0).alias("unit"), F.col("day").alias("slot"), F.col("at").alias("begin"), F.coalesce("then", _start(F.col("day") + 1)).alias("finish"))
    daily = rows.groupBy(*key, "day").agg(F.max(F.struct("at", "action")).alias("last"), F.min("at").alias("first"))
    across = Window.partitionBy(*key).orderBy("day")
    kept = daily.withColumn("until", F.lead("day").over(across)).withColumn("change", F.lead("first").over(across)).where(F.col("last.action") == "add")
    change = kept.where("until is not null").select(*key, F.lit(0).alias("unit"), F.col("until").alias("slot"), _start(F.col("until")).alias("begin"), F.col("change").alias("finish"))
    whole = kept.select(*key, (F.col("day") + 1).alias("a"), F.coalesce(F.col("until") - 1, horizon).alias("b")).where("a <= b")
    first, last = F.ceil(F.col("a") / SPAN).cast("int"), F.floor((F.col("b") + 1) / SPAN).cast("int") - 1
    run = lambda x, y: F.when(x <= y, F.sequence(x, y)).otherwise(F.array().cast("array<int>"))
    blocks = run(first, last)
    days = F.when(first <= last, F.concat(run(F.col("a"), first * SPAN - 1), run((last + 1) * SPAN, F.col("b")))).otherwise(run(F.col("a"), F.col("b")))
    slots = F.explode(F.concat(F.transform(blocks, lambda x: F.struct(F.lit(1).alias("unit"), x.alias("slot"), (x * SPAN).alias("from"), ((x + 1) * SPAN).alias("to"))),
                               F.transform(days, lambda x: F.struct(F.lit(0).alias("unit"), x.alias("slot"), x.alias("from"), (x + 1).alias("to")))))
    lasting = whole.select(*key, slots.alias("s")).select(*key, "s.unit", "s.slot", _start(F.col("s.from")).alias("begin"), _start(F.col("s.to")).alias("finish"))
    return scratch.save(inside.union(change).union(lasting).where("begin < finish"), "pieces")


def evaluate(captures: DataFrame, entries: DataFrame, url: str = "url", fetched: str = "fetched_at") -> DataFrame:
    """All columns of ``captures`` and ``active_lists``, the sorted names of the lists that held the URL's host or a parent then."""
    scratch = Scratch(captures.sparkSession)
    asked = scratch.save(captures.select(F.col(url).alias("url"), F.col(fetched).alias("at")).where(F.col("url").isNotNull() & F.col("at").isNotNull()).distinct(), "captures")
    horizon = asked.agg(F.max(_day(F.col("at")))).first()[0]
    held = pieces(entries, F.lit(horizon if horizon is not None else 0), scratch)
    day = _day(F.col("at"))
    meets = asked.withColumn("pattern", F.explode(patterns_of(host_of(F.col("url"))))).withColumn("s", F.explode(F.array(
        F.struct(F.lit(0).alias("unit"), day.alias("slot")), F.struct(F.lit(1).alias("unit"), F.floor(day / SPAN).cast("int").alias("slot")))))
    meets = scratch.save(meets.select("url", "at", "pattern", "s.unit", "s.slot"), "meets")
    hit = meets.join(held, ["pattern", "unit", "slot"]).where("begin <= at and at < finish").select("url", "at", "list").distinct()
    judged = scratch.save(hit.groupBy(F.col("url").alias("u"), F.col("at").alias("t")).agg(F.array_sort(F.collect_set("list")).alias("found")), "judged")
    out = captures.drop("active_lists")
    return out.join(judged, (F.col(url) == F.col("u")) & (F.col(fetched) == F.col("t")), "left").withColumn("active_lists", F.coalesce("found", F.array().cast("array<string>"))).drop("u", "t", "found")
