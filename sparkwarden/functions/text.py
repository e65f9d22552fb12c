"""Text expressions.  Everything here is a Column in, a Column out, and stays in the JVM."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkwarden.functions import fixed_values as fv

ColumnLike = Column | str


def col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def words(values: Iterable[str]) -> Column:
    """Array of fixed words, folded to one literal at planning."""
    return F.split(F.lit("\u0001".join(values)), "\u0001")


def lookup(table: Mapping[str, object], kind: str = "string") -> Column:
    """Map of fixed entries, folded to one literal at planning."""
    pairs = "\u0001".join(f"{k}\u0002{v}" for k, v in table.items())
    folded = F.str_to_map(F.lit(pairs), F.lit("\u0001"), F.lit("\u0002"))
    return folded if kind == "string" else folded.cast(f"map<string,{kind}>")


def one_of(value: Column, values: Iterable[str]) -> Column:
    return F.array_contains(words(values), value)


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it many times inside ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def has_any(text: ColumnLike, tokens: Iterable[str]) -> Column:
    """Case-insensitive: does the text contain one of the tokens?"""
    # A token that contains another one adds nothing to the disjunction.
    needles = sorted({t.lower() for t in tokens}, key=len)
    minimal = [t for i, t in enumerate(needles) if not any(s in t for s in needles[:i])]

    listed = words(minimal)
    return bind(F.lower(col(text)), lambda low: F.exists(listed, lambda t: low.contains(t)))


def strip_comments(text: ColumnLike) -> Column:
    out = F.regexp_replace(col(text), r"(?s)/\*.*?\*/", "")
    out = F.regexp_replace(out, r"(?mdU)^\s*//.*$", "")
    return F.regexp_replace(out, r"(?mdU)^\s*#.*$", "")


def strong_safe_signal(text: ColumnLike, category: ColumnLike) -> Column:
    def judge(clean: Column) -> Column:
        guarded = ~one_of(col(category), fv.PATH_GUARDED_CATEGORIES) | has_any(clean, fv.PATH_GUARD_TOKENS)
        return ~has_any(clean, fv.UNSAFE_MARKERS) & has_any(clean, fv.SAFE_TOKENS) & guarded

    return bind(strip_comments(text), judge)


def shorten(text: ColumnLike, limit: int = 160) -> Column:
    flat = F.regexp_replace(F.regexp_replace(col(text), r"(?U)\s+", " "), "^ | $", "")
    return F.when(F.length(flat) <= limit, flat).otherwise(
        F.concat(F.substring(flat, 1, limit - 3), F.lit("..."))
    )


def truncate_middle(text: ColumnLike, limit: int) -> Column:
    c = col(text)
    head, tail = limit // 2, limit - limit // 2
    cut = F.concat(F.substring(c, 1, head), F.lit(fv.MIDDLE_MARKER), F.right(c, F.lit(tail)))
    return F.when(F.length(c) <= limit, c).otherwise(cut)


def sanitize_fragment(text: ColumnLike, limit: int = 120) -> Column:
    cleaned = F.regexp_replace(strip(text), r"(?U)[^\w.\-]+", "_")
    return F.when(cleaned == "", F.lit("unknown")).otherwise(F.substring(cleaned, 1, limit))


def strip(text: ColumnLike) -> Column:
    return F.regexp_replace(col(text), r"(?U)^\s+|\s+$", "")


def tokenize(text: ColumnLike) -> Column:
    """Distinct lower-cased identifiers of three or more characters."""
    found = F.regexp_extract_all(col(text), F.lit(fv.TOKEN_PATTERN), F.lit(0))
    return F.array_distinct(F.transform(found, lambda t: F.lower(t)))


def call_tokens(text: ColumnLike) -> Column:
    """Distinct names written directly before a parenthesis, control keywords left out."""
    found = [F.regexp_extract_all(col(text), F.lit("(?U)" + p), F.lit(1)) for p in fv.CALL_PATTERNS]
    return F.array_except(F.array_distinct(F.concat(*found)), words(fv.CALL_KEYWORDS))


def lines_of(text: ColumnLike) -> Column:
    """Lines of a text; a final newline does not open another line."""
    c = col(text)
    body = F.when(c.endswith("\n"), F.regexp_replace(c, r"(?d)\r?\n\z", "")).otherwise(c)
    return F.when(F.length(c) == 0, F.array().cast("array<string>")).when(
        c.contains("\r"), F.split(body, "\r?\n", -1)).otherwise(F.split(body, "\n", -1))


def line_at(text: ColumnLike, number: ColumnLike) -> Column:
    n = col(number)
    found = F.get(F.split(col(text), "\n", -1), n - 1)
    return F.coalesce(F.when(n >= 1, strip(found)), F.lit(""))


def line_window(text: ColumnLike, line: ColumnLike, radius: int = 5) -> Column:
    n = col(line)
    first = F.greatest(F.lit(1), n - radius)

    def cut(lines: Column) -> Column:
        last = F.least(F.size(lines), n + radius)
        return F.array_join(F.slice(lines, first, F.greatest(last - first + 1, F.lit(0))), "\n")

    return bind(lines_of(text), cut)


def count_newlines(text: ColumnLike) -> Column:
    c = col(text)
    return F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))
