"""Running values over arrays, and spans of regex matches, in linear time within a row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkwarden.functions.text import bind

BLOCK = 48


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)


def largest(values: Column) -> Column:
    return F.coalesce(F.array_max(values), F.lit(-1).cast("long"))


def running(values: Column, fold: Callable[[Column], Column] = total, join: Callable[[Column, Column], Column] = lambda a, b: a + b, levels: int = 2) -> Column:
    """For each element of an array<bigint> the fold of all elements before it.

    Elements are folded in blocks, and the blocks' folds in blocks again, so the work per element is
    bound by the block size and not by the length of the array (up to about ``BLOCK ** 3`` elements;
    beyond, the square of the length divided by that).  An array of one block is folded as it is.
    """
    plain = lambda v: F.transform(v, lambda _, i: fold(F.slice(v, F.lit(1), i)))
    if levels == 0:
        return bind(values, plain)

    def blocks(v: Column) -> Column:
        last = F.floor((F.size(v) - 1) / BLOCK).cast("int")
        return F.when(F.size(v) > 0, F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(v, b * BLOCK + 1, F.lit(BLOCK)))).otherwise(
            F.array().cast("array<array<bigint>>"))

    def inside(b: Column) -> Column:
        before = running(F.transform(b, fold), fold, join, levels - 1)
        return bind(before, lambda s: F.flatten(F.transform(b, lambda block, k: F.transform(
            block, lambda _, i: join(F.get(s, k), fold(F.slice(block, F.lit(1), i)))))))

    return bind(values, lambda v: F.when(F.size(v) <= BLOCK, plain(v)).otherwise(bind(blocks(v), inside)))


def match_spans(text: Column, pattern: str, around: int = 0) -> Column:
    """array<struct<start,end,text[,before,after]>>: leftmost non-overlapping matches of a Java pattern.

    Offsets count code points and the end is exclusive.  The text is cut at the matches once; starts are
    running sums of the lengths of what stands between and in the matches.  With ``around``, up to so many
    characters on both sides come along, as far as the neighbouring matches.  Null and match-free texts give
    an empty array after a single test.
    """
    width = lambda t: F.char_length(t).cast("bigint")

    def spans(s: Column) -> Column:
        pieces, found = s["p"], s["m"]
        steps = F.zip_with(F.slice(pieces, F.lit(1), F.size(found)), found, lambda p, m: width(p) + width(m))

        def at(before: Column) -> Column:
            def item(m: Column, i: Column) -> Column:
                gap = F.get(pieces, i)
                start = F.get(before, i) + width(gap)
                fields = [start.alias("start"), (start + width(m)).alias("end"), m.alias("text")]
                if around:
                    fields += [F.right(gap, F.lit(around)).alias("before"), F.left(F.get(pieces, i + 1), F.lit(around)).alias("after")]
                return F.struct(*fields)

            return F.transform(found, item)

        return bind(running(steps), at)

    cut = F.struct(F.split(text, pattern, -1).alias("p"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"))
    kind = "array<struct<start:bigint,end:bigint,text:string" + (",before:string,after:string" if around else "") + ">>"
    return F.when(text.rlike(pattern), bind(cut, spans)).otherwise(F.array().cast(kind))


def match_positions(pieces: Column, matches: Column) -> Column:
    """array<struct<start,line,column,text>> of regex matches, from the text around and in them.

    ``pieces`` stand around ``matches``: piece 1, match 1, piece 2, match 2 and so on.  Starts count from 0, lines and columns
    from 1.  All are running sums (or the running last line break), so the work is linear in the number of matches.
    """
    def breaks(t: Column) -> Column:
        return (F.char_length(t) - F.char_length(F.replace(t, F.lit("\n"), F.lit("")))).cast("bigint")

    def width(t: Column) -> Column:
        return F.char_length(t).cast("bigint")

    def tail(t: Column) -> Column:
        return width(F.substring_index(t, "\n", -1))

    def step(p: Column, m: Column) -> Column:
        return F.struct((width(p) + width(m)).alias("w"), (breaks(p) + breaks(m)).alias("b"), tail(F.concat(p, m)).alias("t"))

    def walked(s: Column) -> Column:
        steps = F.zip_with(F.slice(s["p"], F.lit(1), F.size(s["m"])), s["m"], step)
        return F.struct(s["p"].alias("p"), s["m"].alias("m"), steps.alias("x"))

    def summed(s: Column) -> Column:
        return F.struct(s["p"].alias("p"), s["m"].alias("m"), s["x"].alias("x"), running(F.transform(s["x"], lambda x: x["w"])).alias("at"), running(F.transform(s["x"], lambda x: x["b"])).alias("lines"))

    def placed(s: Column) -> Column:
        ends = F.transform(s["x"], lambda x, i: F.when(x["b"] > 0, F.get(s["at"], i) + x["w"] - x["t"] - 1).otherwise(F.lit(-1).cast("bigint")))

        def item(last: Column) -> Column:
            def one(m: Column, i: Column) -> Column:
                gap = F.get(s["p"], i)
                start = F.get(s["at"], i) + width(gap)
                inside = breaks(gap)
                column = F.when(inside > 0, tail(gap) + 1).otherwise(start - F.get(last, i))
                return F.struct(start.cast("int").alias("start"), (F.get(s["lines"], i) + inside + 1).cast("int").alias("line"), column.cast("int").alias("column"), m.alias("text"))

            return F.transform(s["m"], one)

        return bind(running(ends, largest, F.greatest), item)

    return bind(F.struct(pieces.alias("p"), matches.alias("m")), lambda s: bind(walked(s), lambda s: bind(summed(s), placed)))
