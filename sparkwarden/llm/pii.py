"""Personal data by weak supervision: labelers vote, expectation-maximisation weighs them, a span classifier decides.

Everything is a DataFrame expression.  Candidates come from four strict patterns (the base, which always
stays) and from looser ones.  Each candidate gets votes (1 for, -1 against, 0 abstains) of four labelers:
pattern, gazetteer, context words and shape.

1. One pass counts candidates by kind, votes and features.  There are at most ``kinds * 3**4 * features``
   such combinations, whatever the input, so the rest of the fit works on a bounded table.
2. Expectation-maximisation estimates, per kind, how often each labeler votes how on true and on false
   candidates, and with it the probability that each vote pattern is true.
3. With these probabilities as soft labels a log-linear classifier over votes and features is fitted: its
   weights are smoothed log odds per kind and feature value (under 200 numbers).
4. A second pass scores candidates inside their row and keeps loose ones of probability 0.5 or more.

Null and empty texts have no spans.  Repeated rows get equal spans each.  Spans are found in whole texts in
time linear in their number.  Columns named as the results are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkwarden.functions.runs import largest, match_spans, running
from sparkwarden.functions.text import bind
from sparkwarden.llm.common import Scratch

AROUND = 40
ROUNDS = 8
KINDS = ("email", "ip", "card", "phone")
LABELERS = ("pattern", "gazetteer", "context", "shape")
FEATURES = (*LABELERS, "length", "left", "right")

# The base patterns, with a start guard where a run of characters would be tried from each of its places.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[ -]?[0-9])++"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
OCTET = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9]?)"
VALID_IP = rf"^(?:{OCTET})(?:\.{OCTET}){{3}}$"
# Looser candidates: written-out addresses, national telephone numbers.
LOOSE_EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?[(\[](?:at|AT)[)\]] ?[A-Za-z0-9-]{1,63}+(?: ?[(\[](?:dot|DOT)[)\]] ?|\.)[A-Za-z]{2,24}+"
LOOSE_PHONE = r"(?<![A-Za-z0-9+.-])(?<!\+[0-9] |\+[0-9][0-9] )(?:\([0-9]{3}\) ?|[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}(?![0-9])"
# Gazetteers and context words.
DOMAINS = ["com", "org", "net", "edu", "gov", "io", "info", "biz", "de", "fr", "es", "it", "uk", "nl", "ch", "at", "eu", "us"]
PRIVATE_NETS = r"^(?:0|10|127|255|192\.168|169\.254)\."
CONTEXT = {
    "email": ["mail", "contact", "write", "reach", "correo", "courriel"],
    "ip": ["ip", "host", "server", "address", "login", "adresse"],
    "card": ["card", "visa", "credit", "payment", "karte", "carte", "tarjeta"],
    "phone": ["tel", "phone", "call", "fax", "mobile", "contact", "telefon"],
}
AGAINST = ["isbn", "version", "order", "page", "serial", "invoice", "section"]


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _vote(yes: Column, no: Column | None = None) -> Column:
    v = F.when(yes, F.lit(1))
    return (v.when(no, F.lit(-1)) if no is not None else v).otherwise(F.lit(0))


def _says(text: Column, words: list[str]) -> Column:
    return text.rlike(r"(?i)(?<![a-z])(?:" + "|".join(words) + ")")


def _gazetteer(kind: str, text: Column) -> Column:
    if kind == "email":
        return _vote(F.lower(F.regexp_extract(text, "[A-Za-z]+$", 0)).isin(DOMAINS), F.lit(True))
    if kind == "ip":
        return _vote(~text.rlike(PRIVATE_NETS), F.lit(True))
    if kind == "card":
        return _vote(text.rlike("^(?:4|5[1-5]|2[2-7]|3[47]|6)"), F.lit(True))
    return _vote(text.rlike(r"^(?:\+[1-9]|\(?[2-9])"), F.lit(True))


def _valid(kind: str, text: Column) -> Column:
    if kind == "ip":
        return text.rlike(VALID_IP)
    n = F.length(_digits(text))
    if kind == "card":
        return n.between(14, 19) & F.call_function("luhn_check", _digits(text))
    if kind == "phone":
        return n.between(10, 15)
    return F.lit(True)


def _candidates(text: Column, kind: str, pattern: str, base: bool) -> Column:
    """Spans of one pattern with base flag, votes and features."""
    def describe(x: Column) -> Column:
        t, before, after = x["text"], x["before"], x["after"]
        size = F.char_length(t)
        edge = lambda c: F.when(c == "", "none").when(c.rlike("[A-Za-z0-9]"), "word").when(c.rlike(r"\s"), "space").otherwise("mark")
        left, right = edge(F.right(before, F.lit(1))), edge(F.left(after, F.lit(1)))
        return F.struct(
            x["start"].alias("start"), x["end"].alias("end"), F.lit(kind).alias("kind"), F.lit(base).alias("base"),
            F.lit(1 if base else 0).alias("pattern"), _gazetteer(kind, t).alias("gazetteer"),
            _vote(_says(before, CONTEXT[kind]), _says(before, AGAINST)).alias("context"),
            _vote((left != "word") & (right != "word"), F.lit(True)).alias("shape"),
            F.when(size < 12, "short").when(size < 20, "middle").otherwise("long").alias("length"), left.alias("left"), right.alias("right"))

    found = match_spans(text, pattern, AROUND)
    return F.transform(F.filter(found, lambda x: _valid(kind, x["text"])) if base else found, describe)


def candidates(text: Column) -> Column:
    """All candidates of a text, by start; loose ones only where they meet no base span of their kind."""
    empty = F.filter(F.transform(F.array(F.struct(F.lit(0).cast("bigint").alias("start"), F.lit(0).cast("bigint").alias("end"), F.lit("").alias("text"), F.lit("").alias("before"), F.lit("").alias("after"))), lambda x: F.struct(
        x["start"].alias("start"), x["end"].alias("end"), F.lit("").alias("kind"), F.lit(True).alias("base"), *[F.lit(0).alias(v) for v in LABELERS], F.lit("").alias("length"), F.lit("").alias("left"), F.lit("").alias("right"))), lambda x: x["end"] > 0)

    def gated(gate: Column, spans: Column) -> Column:
        return F.when(gate, spans).otherwise(empty)

    digit = text.rlike("[0-9]")
    emails = gated(text.contains("@"), _candidates(text, "email", EMAIL, True))
    ips = gated(digit & text.contains("."), _candidates(text, "ip", IP, True))
    cards = gated(digit, _candidates(text, "card", CARD, True))
    phones = gated(text.contains("+"), _candidates(text, "phone", PHONE, True))
    loose_emails = gated(text.rlike(r"[(\[](?:at|AT)[)\]]"), _candidates(text, "email", LOOSE_EMAIL, False))
    loose_phones = gated(digit, _candidates(text, "phone", LOOSE_PHONE, False))

    def apart(loose: Column, strict: Column) -> Column:
        return F.when(F.size(loose) == 0, loose).otherwise(
            bind(strict, lambda s: F.filter(loose, lambda x: ~F.exists(s, lambda y: (y["start"] < x["end"]) & (x["start"] < y["end"])))))

    return F.concat(emails, ips, cards, phones, apart(loose_emails, emails), apart(loose_phones, phones))


def reliabilities(counts: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``counts`` (kind, votes, n) with ``truth``, the estimated probability that a candidate with these votes is true.

    Expectation-maximisation of a two-class model with votes independent given the class, started from the
    votes' mean.  All sums are smoothed, so a labeler that always votes alike decides nothing.
    """
    kind = Window.partitionBy("kind")
    df = counts.withColumn("truth", F.greatest(F.lit(0.05), F.least(F.lit(0.95), 0.5 + sum(F.col(v) for v in LABELERS) * 0.15)))
    for _ in range(rounds):
        for side, weight in (("t", F.col("n") * F.col("truth")), ("f", F.col("n") * (1 - F.col("truth")))):
            df = df.withColumn(f"w{side}", weight)
        sums = {}
        for side in "tf":
            sums[f"all_{side}"] = F.sum(f"w{side}").over(kind)
            for v in LABELERS:
                for vote in (-1, 0, 1):
                    sums[f"{v}_{vote + 1}_{side}"] = F.sum(F.when(F.col(v) == vote, F.col(f"w{side}")).otherwise(0.0)).over(kind)
        df = df.withColumns(sums)
        score = {}
        for side in "tf":
            s = F.log((F.col(f"all_{side}") + 1) / (F.col("all_t") + F.col("all_f") + 2))
            for v in LABELERS:
                mine = F.when(F.col(v) == -1, F.col(f"{v}_0_{side}")).when(F.col(v) == 0, F.col(f"{v}_1_{side}")).otherwise(F.col(f"{v}_2_{side}"))
                s = s + F.log((mine + 1) / (F.col(f"all_{side}") + 3))
            score[side] = s
        df = df.withColumn("truth", 1 / (1 + F.exp(score["f"] - score["t"]))).select(*counts.columns, "truth")
    return df


def fit(found: DataFrame) -> DataFrame:
    """Weights (key, weight) of the span classifier from a column ``__candidates``; under 200 rows."""
    each = found.select(F.explode("__candidates").alias("c")).select(*[F.col(f"c.{x}").alias(x) for x in ("kind", *FEATURES)])
    scratch = Scratch(found.sparkSession)
    combos = scratch.save(each.groupBy("kind", *FEATURES).agg(F.count(F.lit(1)).cast("double").alias("n")).coalesce(1), "combinations")
    by_votes = combos.groupBy("kind", *LABELERS).agg(F.sum("n").alias("n"))
    truth = scratch.save(reliabilities(by_votes).drop("n").coalesce(1), "truth")
    soft = combos.join(F.broadcast(truth), ["kind", *LABELERS])  # at most kinds * 3**4 rows
    entries = [F.struct(F.concat_ws("|", F.lit(name), F.col(name).cast("string")).alias("key")) for name in FEATURES]
    values = soft.select("kind", F.explode(F.array(*entries)).alias("e"), (F.col("n") * F.col("truth")).alias("t"), (F.col("n") * (1 - F.col("truth"))).alias("f"))
    one = values.groupBy("kind", F.col("e.key").alias("key")).agg(F.sum("t").alias("t"), F.sum("f").alias("f"))
    every = soft.groupBy("kind").agg(F.sum(F.col("n") * F.col("truth")).alias("at"), F.sum(F.col("n") * (1 - F.col("truth"))).alias("af"))
    odds = one.join(F.broadcast(every), "kind").select(
        F.concat_ws("|", "kind", "key").alias("key"), (F.log((F.col("t") + 1) / (F.col("at") + 4)) - F.log((F.col("f") + 1) / (F.col("af") + 4))).alias("weight"))
    prior = every.select(F.col("kind").alias("key"), F.log((F.col("at") + 1) / (F.col("af") + 1)).alias("weight"))
    return scratch.save(odds.unionByName(prior).coalesce(1), "weights")


def detect(df: DataFrame, text: str = "text", spans: str = "pii_spans") -> DataFrame:
    """All columns and ``pii_spans array<struct<start,end,kind,base,probability>>`` by start, then kind as listed."""
    out = df.drop(spans)
    found = out.withColumn("__candidates", candidates(F.col(text)))
    weights = fit(found)
    # at most 200 entries
    table = weights.agg(F.map_from_entries(F.collect_list(F.struct("key", "weight"))).alias("m")).scalar()

    def probability(x: Column, w: Column) -> Column:
        keys = [x["kind"], *[F.concat_ws("|", x["kind"], F.lit(name), x[name].cast("string")) for name in FEATURES]]
        logit = sum((F.coalesce(F.element_at(w, k), F.lit(0.0)) for k in keys), F.lit(0.0))
        return 1 / (1 + F.exp(-logit))

    order = F.create_map(*[F.lit(v) for i, k in enumerate(KINDS) for v in (k, i)])

    def judge(w: Column) -> Column:
        scored = F.transform(F.col("__candidates"), lambda x: F.struct(
            x["start"].alias("start"), F.element_at(order, x["kind"]).alias("rank"), x["end"].alias("end"), x["kind"].alias("kind"), x["base"].alias("base"), probability(x, w).alias("probability")))
        kept = F.filter(scored, lambda x: x["base"] | (x["probability"] >= 0.5))
        return F.transform(F.array_sort(kept), lambda x: F.struct(x["start"], x["end"], x["kind"], x["base"], x["probability"]))

    judged = F.when(F.size("__candidates") > 0, judge(F.col("__weights"))).otherwise(F.array().cast("array<struct<start:bigint,end:bigint,kind:string,base:boolean,probability:double>>"))
    return found.withColumn("__weights", table).withColumn(spans, judged).drop("__candidates", "__weights")


def describe(spans: Column) -> Column:
    """``kind:start:end`` of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def mask(df: DataFrame, text: str = "text", spans: str = "pii_spans") -> DataFrame:
    """The text with every span replaced by ``[KIND]``; overlapping spans become one, named after the first.

    A text without spans stays as it is, null included.  The text is read in blocks, so the work is linear
    in its length.
    """
    step = 64

    def cut(blocks: Column, a: Column, b: Column) -> Column:
        first = F.floor(a / step).cast("int")
        near = F.array_join(F.slice(blocks, first + 1, F.floor(b / step).cast("int") - first + 1), "")
        return F.substring(near, (a - first * step).cast("int") + 1, (b - a).cast("int"))

    def rebuild(t: Column) -> Column:
        def piece(x: Column, i: Column) -> Column:
            before = F.get(t["before"], i)
            opened = x["start"] >= before
            gap = F.when(opened, cut(t["blocks"], F.greatest(before, F.lit(0).cast("bigint")), x["start"])).otherwise("")
            return F.concat(gap, F.when(opened, F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]"))).otherwise(""))

        return F.concat(F.array_join(F.transform(t["spans"], piece), ""), cut(t["blocks"], t["last"], t["size"]))

    ends = F.transform(F.col(spans), lambda x: x["end"])
    parts = F.struct(
        F.regexp_extract_all(F.col(text), F.lit(f"(?s).{{1,{step}}}"), F.lit(0)).alias("blocks"), F.col(spans).alias("spans"),
        running(ends, largest, F.greatest).alias("before"), F.array_max(ends).alias("last"), F.char_length(F.col(text)).cast("bigint").alias("size"))
    return df.withColumn(text, F.when(F.size(spans) > 0, bind(parts, rebuild)).otherwise(F.col(text)))
