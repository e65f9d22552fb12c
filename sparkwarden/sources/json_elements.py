"""The objects of one large JSON document as rows, read in as many tasks as the file has splits."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkwarden.session import reliable_checkpoint

# Possessive loops: a string of any length is one step.
_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
_BEFORE_BRACE = r'(?:' + _STRING + r'|[^"{]++)*+\{'
_MAYBE_KEY = "(?s)" + _STRING + r"(?:\s*+:)?+"
_CARRIED = ("start_block", "start_n", "field")


def _count(text: Column, of: str) -> Column:
    return F.length(F.regexp_replace(text, f"[^{of}]+", ""))


def _outside(text: Column) -> Column:
    """A text without its strings, also without one that is not closed."""
    return F.regexp_replace(F.regexp_replace(text, "(?s)" + _STRING, ""), '(?s)".*$', "")


def _running(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Running sums before each piece of a split, for both states (0 outside, 1 inside a string) the split may begin in; pieces come in file order."""
    ends = {}
    for batch in batches:
        split = [batch["file"], batch["block"]]
        last = batch.groupby(split, sort=False).ngroup()
        names = list(batch[["file", "block"]].drop_duplicates().itertuples(index=False, name=None))
        start = [last.map({i: ends.get(name, (0, 0, 0))[j] for i, name in enumerate(names)}) for j in range(3)]
        batch["odd"] = (batch["quotes"].groupby(last).cumsum() - batch["quotes"] + start[0]) % 2
        quotes = batch["odd"] + batch["quotes"]
        for state in (0, 1):
            other = (batch["odd"] + state) % 2 == 1
            batch[f"opened{state}"] = batch["opened_in"].where(other, batch["opened_out"])
            batch[f"net{state}"] = batch[f"opened{state}"] - ((quotes + state) % 2 == 0)
            batch[f"depth{state}"] = batch[f"net{state}"].groupby(last).cumsum() - batch[f"net{state}"] + start[1 + state]
        final = batch.assign(q=quotes % 2, d0=batch["depth0"] + batch["net0"], d1=batch["depth1"] + batch["net1"])[["q", "d0", "d1"]].groupby(last).last()
        # Only the split that the batch ends in can go on.
        ends = {names[i]: tuple(final.loc[i]) for i in final.index if i == last.iloc[-1]} if len(batch) else ends
        yield batch.drop(columns=["opened_out", "opened_in"])


def _carry(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The last start and field up to each piece of its split; pieces come in file order."""
    names, ends = list(_CARRIED), None
    for batch in batches:
        if len(batch):
            if ends is not None:
                batch = pd.concat([ends, batch])
            batch[names] = batch.groupby(["file", "block"], sort=False)[names].ffill()
            done, ends = batch.iloc[0 if ends is None else 1:], batch.iloc[-1:]
            yield done


def json_elements(spark: SparkSession, path: str, level: int = 2) -> DataFrame:
    """Objects that lie ``level`` objects deep, whole, with the name of the field that holds them: (file, place, field, element).

    The document is level 1, so level 2 are the elements of its arrays of objects, or the objects in its fields.  Arrays do not count.  ``place``
    orders the elements of a file.  Of a field whose name holds closing braces, the name starts with the last of them.  The files may be laid out in any way, one long line too.

    The text is split at closing braces, so every split of a file is read by itself.  Whether a piece begins inside a string, and how deep, are running
    sums: within a split in the task that reads it, over splits by a table of one row a split, which is sent to all tasks so that the pieces stay where and in the order they are.
    The sums are taken for both states a split may begin in.  The text is written once; only elements of several pieces are gathered.  An element that is cut off at the end of
    a file is left out (at level 1, where nothing around it tells, it may not be).  Empty files have none.
    """
    split = ["file", "block"]
    raw = spark.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"), "value")
    counted = raw.select(
        "*", _count(F.regexp_replace("value", r"(?s)\\.", ""), '"').alias("quotes"), _count(_outside(F.col("value")), "{").alias("opened_out"),
        _count(_outside(F.concat(F.lit('"'), "value")), "{").alias("opened_in"))
    sums = "quotes int, odd int, opened0 int, net0 int, depth0 long, opened1 int, net1 int, depth1 long"
    totals = counted.drop("value").mapInPandas(_running, f"file string, block long, n long, {sums}").groupBy(*split).agg(
        F.sum("quotes").alias("quotes"), F.sum("net0").alias("net0"), F.sum("net1").alias("net1"), F.max("n").alias("last_n"))
    earlier = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    begins = totals.withColumn("inside", F.coalesce(F.sum("quotes").over(earlier), F.lit(0)) % 2)
    begins = begins.withColumn("net", F.when(F.col("inside") == 1, F.col("net1")).otherwise(F.col("net0")))
    begins = begins.withColumn("depth", F.coalesce(F.sum("net").over(earlier), F.lit(0)))
    # The last piece of a file counts as closed.  If that leaves the document open, the file was cut off there.
    every = W.partitionBy("file")
    begins = begins.withColumn("cut_at", F.when((F.sum("net").over(every) >= 1) & (F.col("block") == F.max("block").over(every)), F.col("last_n")))
    begins = reliable_checkpoint(begins.select(*split, "inside", "depth", "cut_at"))

    known = counted.mapInPandas(_running, f"file string, block long, n long, value string, {sums}").join(F.broadcast(begins), split)
    of = lambda name: F.when(F.col("inside") == 1, F.col(f"{name}1")).otherwise(F.col(f"{name}0"))
    known = known.select(*split, "n", "value", "cut_at", ((F.col("odd") + F.col("inside")) % 2 == 1).alias("inside_string"),
                         of("opened").alias("opened"), of("net").alias("net"), (F.col("depth") + of("depth")).alias("depth"))
    text = F.concat(F.when(F.col("inside_string"), '"').otherwise(""), "value")
    turn = level - F.col("depth")
    starts = (turn >= 1) & (turn <= F.col("opened"))
    head = F.when(starts, F.regexp_substr("text", F.concat(F.lit("(?s)^(?:" + _BEFORE_BRACE + "){"), turn.cast("string"), F.lit("}"))))
    known = known.withColumn("text", text).withColumn("starts", starts).withColumn("head", head)
    # The last key before an element, or in a piece between elements, names the field of what follows.
    between = F.col("depth") + F.col("opened") == level - 1
    tokens = F.regexp_extract_all(F.when(F.col("starts"), F.col("head")).when(between, F.col("text")), F.lit(_MAYBE_KEY), F.lit(0))
    keys = F.filter("tokens", lambda t: F.endswith(t, F.lit(":")))
    begun = F.when(F.col("inside_string") & (F.size(keys) == 1) & F.endswith(F.get("tokens", F.lit(0)), F.lit(":")), "}").otherwise("")
    field = F.concat(begun, F.regexp_extract(F.get(keys, F.size(keys) - 1), r'(?s)^"(.*)"\s*:$', 1))
    part = F.col("starts") | (F.col("depth") >= level)
    ends = (F.col("depth") + F.col("net") < level) & ~F.col("n").eqNullSafe(F.col("cut_at"))
    known = known.withColumn("tokens", tokens).withColumn("field", field).filter(part | F.col("field").isNotNull()).select(
        *split, "n", part.alias("part"), ends.alias("ends"), (F.col("starts") & ends).alias("alone"), "field",
        F.when(F.col("starts"), F.col("block")).alias("start_block"), F.when(F.col("starts"), F.col("n")).alias("start_n"),
        F.concat(F.when(F.col("starts"), F.concat(F.lit("{"), F.substring("text", F.length("head") + 1, F.length("text")))).otherwise(F.col("value")), F.lit("}")).alias("value"))
    known = reliable_checkpoint(known.mapInPandas(_carry, known.schema))

    carried = known.groupBy(*split).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("n"))).alias(f"last_{c}") for c in _CARRIED])
    carried = carried.select(*split, *[F.last(f"last_{c}", ignorenulls=True).over(earlier).alias(f"from_{c}") for c in _CARRIED])
    placed = known.filter("part").join(carried, split)
    for c in _CARRIED:
        placed = placed.withColumn(c, F.coalesce(c, f"from_{c}"))
    placed = placed.withColumn("place", F.struct(F.col("start_block").alias("block"), F.col("start_n").alias("n")))
    # All pieces of an element carry its field.
    gathered = placed.filter(~F.col("alone")).groupBy("file", "place", "field").agg(
        F.max("ends").alias("complete"), F.array_sort(F.collect_list(F.struct("block", "n", "value"))).alias("parts"))
    whole = gathered.filter("complete").select("file", "place", "field", F.array_join(F.transform("parts", lambda p: p["value"]), "").alias("element"))
    return placed.filter("alone").select("file", "place", "field", F.col("value").alias("element")).unionByName(whole)
