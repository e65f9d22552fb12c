"""Secret scan with corpus-wide ownership frequency.

Patterns find candidates inside each row.  Each candidate's value is hashed, and the hashes are counted over the corpus by
distinct (owner, repository): a value that several owners hold is a copied example; one that a single owner holds looks
live.  Base candidates always stay as spans, with the verdict beside them.  Long random-looking words outside the base
become spans (``key``) only where ownership makes them look live.

Counting runs in three combining aggregates (by value, owner and repository; by value and owner; by value), so a value that a
third of all rows hold is no group.  Null and empty texts have no spans; a null owner or repository counts as one.  Repeated rows
get equal results each and count once as repository.  Columns named as the results are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkwarden.functions.runs import match_spans
from sparkwarden.functions.text import bind
from sparkwarden.llm.common import Scratch

# The base patterns, kinds in the order of their results.
ASSIGN = r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"(?:(?<![0-9a-f])|\G)[0-9a-f]{16,}+"
KEY = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{24,}+={0,2}"
KINDS = ("assign", "access", "hex")
SEVERAL = 2  # owners from which on a value counts as copied


def candidates(text: Column) -> Column:
    """array<struct<start,rank,end,kind,base,value>> with ``value`` the SHA-256 of what would be the credential."""
    def found(kind: str, rank: int, pattern: str, keep=None, value=None, base: bool = True) -> Column:
        spans = match_spans(text, pattern)
        if keep is not None:
            spans = F.filter(spans, lambda x: keep(x["text"]))
        return F.transform(spans, lambda x: F.struct(
            x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end"), F.lit(kind).alias("kind"), F.lit(base).alias("base"),
            F.sha2(value(x["text"]) if value else x["text"], 256).alias("value")))

    secret = lambda t: F.regexp_extract(t, ASSIGN, 2)
    base = F.concat(
        found("assign", 0, ASSIGN, lambda t: F.length(secret(t)) >= 12, secret), found("access", 1, ACCESS, lambda t: F.length(t) >= 18), found("hex", 2, HEX))
    mixed = lambda t: t.rlike("[a-z]") & t.rlike("[A-Z]") & t.rlike("[0-9].*[0-9].*[0-9]")
    loose = found("key", 3, KEY, mixed, base=False)
    return bind(base, lambda b: F.concat(b, F.filter(loose, lambda x: ~F.exists(b, lambda y: (y["start"] < x["end"]) & (x["start"] < y["end"])))))


def ownership(found: DataFrame) -> DataFrame:
    """(value, repositories, owners) of ``found`` (value, owner, repository)."""
    one = found.groupBy("value", "owner", "repository").agg(F.count(F.lit(1)).alias("places"))
    by_owner = one.groupBy("value", "owner").agg(F.count(F.lit(1)).alias("repositories"))
    return by_owner.groupBy("value").agg(F.sum("repositories").alias("repositories"), F.count(F.lit(1)).alias("owners"))


def scan(df: DataFrame, repository: str = "doc_id", owner: str = "source", text: str = "text") -> DataFrame:
    """(repository, owner, spans, n_live, n_copied) of every row.

    ``spans array<struct<start,rank,end,kind,base,value,repositories,owners>>`` holds base spans and live-looking keys by start,
    then kind.  n_live and n_copied count the base spans by verdict.
    """
    scratch = Scratch(df.sparkSession)
    rows = scratch.save(df.select(F.col(repository).alias("repository"), F.col(owner).alias("owner"), F.xxhash64(text).alias("digest"), candidates(F.col(text)).alias("found")), "rows")
    each = rows.select("repository", "digest", "owner", F.explode("found").alias("x")).select("repository", "digest", "owner", "x.*")
    known = scratch.save(ownership(each.select("value", "owner", "repository")), "ownership")
    judged = each.join(known, "value").where((F.col("base")) | (F.col("owners") < SEVERAL))
    span = F.struct("start", "rank", "end", "kind", "base", "value", "repositories", "owners")
    own = judged.groupBy(F.col("repository").alias("r"), F.col("digest").alias("d")).agg(F.array_sort(F.collect_set(span)).alias("spans"))  # a row's own spans
    live = lambda x: x["base"] & (x["owners"] < SEVERAL)
    out = rows.drop("found").join(own, F.col("repository").eqNullSafe(F.col("r")) & (F.col("digest") == F.col("d")), "left").select(
        "repository", "owner", F.coalesce("spans", F.array().cast(own.schema["spans"].dataType)).alias("spans"))
    return out.select("*", F.size(F.filter("spans", live)).cast("long").alias("n_live"), F.size(F.filter("spans", lambda x: x["base"] & ~live(x))).cast("long").alias("n_copied"))


def describe(spans: Column) -> Column:
    """``kind:start:end`` of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
