"""Mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources a document belongs to).  Flow runs from patterns
to sources: a pattern offers its words once at no cost, a second time at cost 1 and so on (convex, so a repeat is used
only where first uses are exhausted), and a source takes up to its target.  Patterns and sources that share nothing are
independent, so each connected component of the pattern graph is its own flow problem and its own task; its size depends on
how many sources overlap, not on the number of documents.  Where every document has one source, all components are single
edges.

The flow gives each pattern a number of words.  Its documents are taken in a seeded hash order: whole rounds first, then the
documents below a cut that is located in two histograms of hash digits and one short ordered list, so nothing is
sorted whole.  One more document, whose size comes nearest to what is missing, closes the gap.  Reruns agree, as nothing depends on the
order or the partitioning of rows.

Null and blank texts have size 0 and are never taken.  A null source is a source of its own, last in order.  Rows with equal id
and text are taken alike up to the cut (rows tied in id and size share one place and are ordered arbitrarily but
equal).  Rows with a null id are documents of their own, told apart by their size and number.  Columns named as the results are replaced.
"""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkwarden.llm.common import Scratch
from sparkwarden.llm.components import components

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
REPEATS = 2
DIGITS = 12  # bits of the hash per histogram


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text; null counts 0."""
    marked = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     ")
    # a word begins at each character that is no space and stands first or after a space
    return F.regexp_count(marked, F.lit("(?<![^ ])[^ ]")).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """(source, source_size, target): ``sizes`` (source, source_size) with the words each source should give.

    Sources by code point, null last, weigh ``weights`` in turn and share ``share`` of all words by weight.  A target stops at
    ``repeats`` times its source's size; the excess goes to the others by weight until none is above.  The table has one row per
    source; its order is a window over this small table.
    """
    scratch = Scratch(sizes.sparkSession)
    order = Window.orderBy(F.col("source").isNull(), F.encode("source", "utf-8"))
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))).cast("int") + 1)
    now = scratch.save(sizes.select("source", "source_size", turn.alias("weight"), (repeats * F.col("source_size")).cast("double").alias("limit"), F.lit(False).alias("full")), "weights")
    everything = float(now.agg(F.sum("source_size")).first()[0] or 0) * share
    while True:
        taken, open_weight = now.agg(F.sum(F.when(F.col("full"), F.col("limit")).otherwise(0.0)), F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("weight")))).first()
        rest = F.lit(everything - (taken or 0.0)) * F.col("weight") / F.lit(open_weight or 1.0)
        above = ~F.col("full") & (rest > F.col("limit"))
        if now.where(above).limit(1).count() == 0:
            return now.select("source", "source_size", F.when(F.col("full"), F.col("limit")).otherwise(rest).alias("target"))
        now = scratch.save(now.withColumn("full", F.col("full") | above), "weights")


def route(capacity: dict, edges: list[tuple], demand: dict, repeats: int = REPEATS) -> dict:
    """Min-cost flow from patterns (``capacity`` words each, up to ``repeats`` times) over ``edges`` to sources (``demand``).

    Returns the words per pattern.  Successive cheapest augmenting paths: the cost of a path is the number of the repetition of the
    pattern that it starts from, so patterns are served tier by tier.
    """
    out = {p: 0 for p in capacity}
    flow = {e: 0 for e in edges}
    left = dict(demand)
    to: dict = {}
    back: dict = {}
    for p, s in edges:
        to.setdefault(p, []).append(s)
        back.setdefault(s, []).append(p)
    for tier in range(repeats):
        for start in sorted(capacity, key=repr):
            room = capacity[start] * (tier + 1) - out[start]
            while room > 0:
                seen: dict = {("p", start): None}
                queue, end = deque([("p", start)]), None
                while queue and end is None:
                    kind, x = queue.popleft()
                    for y in sorted(to.get(x, []) if kind == "p" else [p for p in back.get(x, []) if flow[p, x] > 0], key=repr):
                        node = ("s" if kind == "p" else "p", y)
                        if node not in seen:
                            seen[node] = (kind, x)
                            if kind == "p" and left[y] > 0:
                                end = node
                                break
                            queue.append(node)
                if end is None:
                    break
                path, node = [], end
                while seen[node] is not None:
                    path.append((seen[node], node))
                    node = seen[node]
                amount = min([room, left[end[1]], *(flow[b[1], a[1]] for a, b in path if a[0] == "s")])
                for a, b in path:
                    if a[0] == "p":
                        flow[a[1], b[1]] += amount
                    else:
                        flow[b[1], a[1]] -= amount
                left[end[1]] -= amount
                out[start] += amount
                room -= amount
    return out


def quotas(patterns: DataFrame, wanted: DataFrame, repeats: int = REPEATS) -> DataFrame:
    """(pattern, quota) from ``patterns`` (pattern, sources array, size) and ``wanted`` (source, target)."""
    scratch = Scratch(patterns.sparkSession)
    edges = scratch.save(patterns.select("pattern", "size", F.explode("sources").alias("s")).join(wanted, F.col("s").eqNullSafe(F.col("source"))).select(
        "pattern", "size", F.round("target").cast("long").alias("target"), F.xxhash64(F.lit("s"), "source", F.col("source").isNull()).alias("node")), "edges")
    roots = scratch.save(components(edges.select(F.col("pattern").alias("a"), F.col("node").alias("b")), scratch), "groups")
    grouped = edges.join(roots, edges["pattern"] == roots["node"]).select("root", "pattern", "size", edges["node"].alias("source"), "target")

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        got = route(dict(zip(pdf["pattern"], pdf["size"], strict=True)), sorted(set(zip(pdf["pattern"], pdf["source"], strict=True))), dict(zip(pdf["source"], pdf["target"], strict=True)), repeats)
        return pd.DataFrame({"pattern": list(got), "quota": list(got.values())})

    return grouped.groupBy("root").applyInPandas(solve, "pattern long, quota long")


def select(docs: DataFrame, plan: DataFrame, scratch: Scratch) -> DataFrame:
    """``docs`` (pattern, id, size, copy) with ``rounds``, how often each document is taken, for ``plan`` (pattern, size, quota)."""
    # at most as many rows as there are patterns
    plan = scratch.save(plan.select("pattern", F.expr("quota div size").alias("whole"), F.expr("quota % size").alias("rest")).where("rest >= 0"), "plan")
    hashed = docs.where("size > 0").withColumn("h", F.xxhash64(F.lit(17), "id", "copy"))
    first, second = F.shiftrightunsigned("h", 64 - DIGITS), F.shiftrightunsigned("h", 64 - 2 * DIGITS)
    hashed = scratch.save(hashed.join(plan, "pattern").withColumn("d1", first).withColumn("d2", second), "hashed")

    def cut(rows: DataFrame, digit: str, before: str) -> DataFrame:
        """The histogram cell in which the running size passes the rest."""
        cells = rows.groupBy("pattern", digit, "rest", before).agg(F.sum("size").alias("words"))
        run = Window.partitionBy("pattern").orderBy(digit)
        upto = F.sum("words").over(run)
        return cells.withColumn("from", F.col(before) + upto - F.col("words")).withColumn("to", F.col(before) + upto).where("from <= rest and rest < to").select("pattern", digit, "from")

    top = scratch.save(cut(hashed.withColumn("zero", F.lit(0).cast("long")), "d1", "zero"), "top")
    inner = hashed.join(top.withColumnRenamed("from", "base"), ["pattern", "d1"])
    low = scratch.save(cut(inner, "d2", "base"), "low")
    short = hashed.join(low, ["pattern", "d2"])
    run = Window.partitionBy("pattern").orderBy("h", "id", "size", "copy").rowsBetween(Window.unboundedPreceding, 0)
    # a cell of both histograms: one document in 2 ** (2 * DIGITS)
    ends = short.withColumn("to", F.col("from") + F.sum("size").over(run)).where("to <= rest").groupBy("pattern").agg(F.max("to").alias("to"), F.max(F.struct("h", "id", "size", "copy")).alias("edge"))
    edge = scratch.save(low.join(ends, "pattern", "left").select("pattern", F.col("d2").alias("cut"), F.coalesce("to", "from").alias("filled"), "edge"), "edge")
    marked = hashed.join(edge, "pattern", "left").withColumn("below", F.coalesce((F.col("d2") < F.col("cut")) | ((F.col("d2") == F.col("cut")) & F.col("edge").isNotNull() & (F.struct("h", "id", "size", "copy") <= F.col("edge"))), F.lit(False)))
    gap = F.col("rest") - F.col("filled")
    near = marked.where(~F.col("below") & F.col("filled").isNotNull()).where(F.abs(F.col("size") - gap) < gap)
    filler = scratch.save(near.groupBy("pattern").agg(F.min(F.struct(F.abs(F.col("size") - gap).alias("off"), "h", "id", "size", "copy")).alias("x")).select(F.col("pattern").alias("p2"), F.col("x.h").alias("h2"), F.col("x.id").alias("id2"), F.col("x.size").alias("size2"), F.col("x.copy").alias("copy2"), F.lit(1).alias("fill")), "filler")
    here = (F.col("pattern") == F.col("p2")) & (F.col("h") == F.col("h2")) & F.col("id").eqNullSafe(F.col("id2")) & (F.col("size") == F.col("size2")) & (F.col("copy") == F.col("copy2"))
    out = marked.join(filler, here, "left")
    return out.select("pattern", "id", "copy", "size", (F.col("whole") + F.when(F.col("below") | F.col("fill").isNotNull(), 1).otherwise(0)).cast("long").alias("rounds"))


def mix(df: DataFrame, id_column: str = "doc_id", text: str = "text", source: str = "source", overlapping: bool = False,
        weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """(id, source, copy, size, source_size, target, rounds) of every row, narrow: texts are read once and not shuffled.

    ``copy`` numbers rows that have the same id, source and size, so repeated rows stay apart.  With ``overlapping`` the source
    column is an array of sources; source_size and target are then the sums over its sources.
    """
    scratch = Scratch(df.sparkSession)
    sources = F.coalesce(F.array_distinct(F.col(source)), F.array().cast(df.schema[source].dataType)) if overlapping else F.array(F.col(source))
    # a null id is an id like others: it joins by its hash and by whether it is there
    narrow = df.select(F.col(id_column).alias("id"), F.xxhash64(F.col(id_column).isNull(), id_column).alias("who"), F.col(source).alias("source"), F.array_sort(sources).alias("sources"), word_count(F.col(text)).alias("size"))
    narrow = narrow.withColumn("pattern", F.xxhash64(F.transform("sources", lambda s: F.coalesce(F.concat(F.lit("="), s), F.lit("-")))))
    copies = Window.partitionBy("id", "pattern", "size").orderBy("id")
    docs = scratch.save(narrow.withColumn("copy", F.row_number().over(copies)), "narrow")
    patterns = scratch.save(docs.groupBy("pattern", "sources").agg(F.sum("size").alias("size")), "patterns")
    sizes = patterns.select(F.explode("sources").alias("source"), "size").groupBy("source").agg(F.sum("size").alias("source_size"))
    wanted = scratch.save(targets(sizes, weights, share, repeats), "targets")
    plan = patterns.select("pattern", "size").join(quotas(patterns, wanted, repeats), "pattern").where("size > 0")
    rounds = scratch.save(select(docs.select("pattern", "id", "size", "copy"), plan, scratch), "rounds")
    known = patterns.select("pattern", F.explode("sources").alias("s")).join(wanted, F.col("s").eqNullSafe(F.col("source"))).groupBy("pattern").agg(F.sum("source_size").alias("source_size"), F.sum("target").alias("target"))
    known = scratch.save(known, "known")
    same = docs["id"].eqNullSafe(F.col("id2")) & (docs["who"] == F.col("who2")) & (docs["pattern"] == F.col("p2")) & (docs["size"] == F.col("size2")) & (docs["copy"] == F.col("copy2"))
    found = rounds.select(F.col("pattern").alias("p2"), F.col("id").alias("id2"), F.xxhash64(F.col("id").isNull(), "id").alias("who2"), F.col("size").alias("size2"), F.col("copy").alias("copy2"), "rounds")
    return docs.join(found, same, "left").join(known, "pattern", "left").select(
        F.col("id").alias(id_column), "source", "copy", "size", F.coalesce("source_size", F.lit(0)).alias("source_size"), F.coalesce("target", F.lit(0.0)).alias("target"), F.coalesce("rounds", F.lit(0)).cast("long").alias("rounds"))
