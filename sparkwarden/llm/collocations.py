"""Phrase collocations by weighted acyclic automata: count transducers of shards, united by prefix range, composed for parts.

Texts are lower-cased (A-Z), split into pieces at ``[.,;:!?\\x0A-\\x0D]`` and into words at blanks and tabs.  A phrase of 2 to
``longest`` words that occurs ``least`` times in its group (a language) is a candidate.  Each cut of a candidate into two parts of l and r
occurrences scores ``floor(1000000 a a / (l r))``; the lowest-scoring cut counts.  Candidates that a longer candidate explains to
``absorbed`` percent are dropped, the rest ranked.

1. *Words* are counted exactly; those of ``least`` occurrences and more become symbols, 64-bit hashes of group and word.  Should two words share
   a symbol, the job fails rather than count wrongly (pass another ``seed``).
2. *Shards.*  For each length a task gathers about ``SEGMENT`` words of whole texts, sorts their distinct n-grams and builds a count
   transducer from the sorted list: an acyclic automaton whose path is an n-gram and whose weight its count.  Equal
   prefixes share arcs; states of equal futures are merged from the last level upwards.  Only n-grams whose two parts of one word less may be frequent
   enter: bit tables of fixed size say so, whose errors cost time, never results.
3. *Union.*  A transducer leaves its task in prefix ranges (hashes of all words but the last).  A prefix that has more than a range's share of all
   words, as counted one length before, is spread over several ranges by its last word.  One task unites the transducers of a range and sums weights.
4. *Composition.*  The parts of a candidate are paths of the shorter unions; their weights are looked up by equality joins.

Group values that are null count as ``und``; null and empty texts have no word.  Rows that repeat count as often as they stand.  Numbers beyond 64 bits
are decimals.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkwarden.llm.common import Scratch, chunks, mix64, ranges, span_hashes

SEGMENT = 2_000_000  # words of a shard
TARGET, RANGES = 2_000_000, 65_536  # words a prefix range; at most so many ranges
BITS = 1 << 26
SALTS = 64
UNKNOWN_GROUP = "und"
_SEPARATOR = np.isin(np.arange(256), [*b".,;:!?", *range(0x0A, 0x0E)])
_BLANK = _SEPARATOR | np.isin(np.arange(256), [0x20, 0x09])
_STEPS = mix64(np.arange(301, 341, dtype=np.uint64)) | np.uint64(1)


def group_hash(group: str, seed: int) -> int:
    return int.from_bytes(hashlib.blake2b(group.encode(), digest_size=8, salt=seed.to_bytes(8, "little")).digest(), "little")


def words_of(batch: pa.RecordBatch, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, bytes, np.ndarray, np.ndarray]:
    """(symbols, numbers of pieces, rows, bytes, starts, ends) of all words of the column ``text``, in order."""
    raw = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
    whole = b"\n".join([*raw, b""]).lower()
    b = np.frombuffer(whole, np.uint8)
    inside = ~_BLANK[b]
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, ends = edge[0::2], edge[1::2]
    row = np.searchsorted(np.cumsum([len(r) + 1 for r in raw]), starts, side="right")
    salt = np.array([group_hash(g, seed) for g in batch.column("grp").to_pylist()], np.uint64)
    piece = np.cumsum(_SEPARATOR[b], dtype=np.int64)[starts]
    return mix64(span_hashes(b, starts, ends) ^ salt[row]), piece, row, whole, starts, ends


def key_of(symbols: np.ndarray) -> np.ndarray:
    """One 64-bit hash per row of symbols."""
    return mix64((symbols * _STEPS[: symbols.shape[1]]).sum(axis=1, dtype=np.uint64))


def known(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    place = keys & np.uint64(BITS - 1)
    return (bits[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1


def _narrow(a: np.ndarray) -> np.ndarray:
    return a.astype(np.min_scalar_type(int(a.max())) if len(a) else np.uint8)


class CountTransducer:
    """Acyclic automaton over words with one weight per path; all paths have one length.

    ``levels`` holds from the root on (first arc of each state, arc symbols, arc targets); the targets of the last level are weights.
    """

    def __init__(self, alphabet: np.ndarray, levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        self.alphabet, self.levels = alphabet, levels

    @classmethod
    def from_sorted(cls, paths: np.ndarray, weights: np.ndarray) -> CountTransducer:
        """From distinct rows of symbols in lexicographic order."""
        alphabet, ids = np.unique(paths, return_inverse=True)
        ids = ids.reshape(paths.shape)
        levels, target, rows = [], weights.astype(np.int64), ids
        for depth in range(paths.shape[1] - 1, -1, -1):
            prefix, symbol = rows[:, :depth], rows[:, depth]
            new = np.append(True, (prefix[1:] != prefix[:-1]).any(axis=1)) if depth else np.arange(len(rows)) == 0
            first = np.flatnonzero(new)
            kept, state = cls._merge(first, symbol, target)
            count = np.diff(np.append(first, len(rows)))[kept]
            arcs = ranges(first[kept], count)
            levels.append((np.append(0, np.cumsum(count)), symbol[arcs], target[arcs]))
            rows, target = prefix[first], state
        return cls(alphabet, levels[::-1])

    @staticmethod
    def _merge(first: np.ndarray, symbol: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """States kept, and the kept state of each; states are equal if their arcs are (compared, not only hashed)."""
        count = np.diff(np.append(first, len(symbol)))
        sign = np.add.reduceat(mix64(mix64(symbol.astype(np.uint64)) + target.astype(np.uint64)), first) + count.astype(np.uint64)
        _, lead, group = np.unique(sign, return_index=True, return_inverse=True)
        lead = lead[group]
        same = count == count[lead]
        lead = np.where(same, lead, np.arange(len(first)))
        own, other = ranges(first, count), ranges(first[lead], count)
        differ = np.add.reduceat((symbol[own] != symbol[other]) | (target[own] != target[other]), first, dtype=np.int64) > 0
        lead = np.where(differ, np.arange(len(first)), lead)
        kept, state = np.unique(lead, return_inverse=True)
        return kept, state

    def paths(self) -> tuple[np.ndarray, np.ndarray]:
        """All paths as rows of symbols in order, and their weights."""
        state, rows = np.zeros(1, np.int64), np.zeros((1, 0), np.int64)
        for offset, symbol, target in self.levels:
            offset = offset.astype(np.int64)
            count = offset[state + 1] - offset[state]
            arcs = ranges(offset[state], count)
            rows = np.column_stack((np.repeat(rows, count, axis=0), symbol[arcs].astype(np.int64)))
            state = target[arcs].astype(np.int64)
        return self.alphabet[rows], state

    def to_bytes(self) -> bytes:
        parts = [self.alphabet, *(_narrow(a) for level in self.levels for a in level)]
        head = [len(self.levels), *(x for a in parts for x in (len(a), a.dtype.itemsize))]
        return b"".join([np.array(head, np.int64).tobytes(), *(a.tobytes() for a in parts)])

    @classmethod
    def from_bytes(cls, data: bytes) -> CountTransducer:
        depth = int(np.frombuffer(data, np.int64, 1)[0])
        head = np.frombuffer(data, np.int64, 3 + 6 * depth)[1:].tolist()
        at, parts = 8 * (3 + 6 * depth), []
        for length, size in zip(head[0::2], head[1::2], strict=True):
            parts.append(np.frombuffer(data, f"u{size}", length, at))
            at += length * size
        return cls(parts[0], [tuple(parts[k: k + 3]) for k in range(1, len(parts), 3)])


def summed(paths: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows in lexicographic order with the sums of their weights."""
    order = np.lexsort(paths.T[::-1])
    paths = paths[order]
    first = np.flatnonzero(np.append(True, (paths[1:] != paths[:-1]).any(axis=1))) if len(paths) else np.zeros(0, np.int64)
    return paths[first], np.add.reduceat(weights[order], first) if len(first) else np.zeros(0, np.int64)


def union(transducers: list[CountTransducer]) -> tuple[np.ndarray, np.ndarray]:
    """Paths of all transducers with summed weights."""
    each = [t.paths() for t in transducers]
    return summed(np.concatenate([p for p, _ in each]), np.concatenate([w for _, w in each]))


def _word_counts(docs: DataFrame, seed: int) -> DataFrame:
    """(symbol, grp, word, n) of each shard's words, and per group a row with a null word and the number of all words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        totals: dict[str, int] = {}
        seen = 0

        def flush():
            n, total = len(held), list(totals)
            cols = [pa.array(np.array([*held, *(group_hash(g, seed) for g in total)], np.uint64).view(np.int64)), pa.array([v[0] for v in held.values()] + total, pa.string()),
                    pa.array([v[1].decode() for v in held.values()] + [None] * len(total), pa.string()), pa.array([v[2] for v in held.values()] + list(totals.values()), pa.int64())]
            held.clear()
            totals.clear()
            return pa.RecordBatch.from_arrays(cols, ["symbol", "grp", "word", "n"]), n

        for whole in batches:
            for batch in chunks(whole, "text"):
                symbol, _, row, raw, starts, ends = words_of(batch, seed)
                groups = batch.column("grp").to_pylist()
                per_row = np.bincount(row, minlength=len(groups)).tolist()
                for g, k in zip(groups, per_row, strict=True):
                    if k:
                        totals[g] = totals.get(g, 0) + k
                one, first, n = np.unique(symbol, return_index=True, return_counts=True)
                for s, i, k in zip(one.tolist(), first.tolist(), n.tolist(), strict=True):
                    if s in held:
                        held[s][2] += k
                    else:
                        held[s] = [groups[row[i]], raw[starts[i]: ends[i]], k]
                seen += len(symbol)
                if seen >= SEGMENT:
                    yield flush()[0]
                    seen = 0
        if held:
            yield flush()[0]

    return docs.mapInArrow(run, "symbol long, grp string, word string, n long")


def _words(docs: DataFrame, least: int, seed: int, scratch: Scratch) -> DataFrame:
    """(symbol, grp, word, n) of frequent words, and per group a row with a null word."""
    clash = F.raise_error(F.lit("two words share a symbol: pass another seed"))
    sure = lambda c: F.when(F.min(c).eqNullSafe(F.max(c)), F.min(c)).otherwise(clash)
    each = _word_counts(docs, seed).groupBy("symbol").agg(F.sum("n").alias("n"), sure("grp").alias("grp"), sure("word").alias("word"))
    return scratch.save(each.where(F.col("word").isNull() | (F.col("n") >= least)), "words")


def _bits(keys: DataFrame, key: Column) -> np.ndarray:
    """A bit table of fixed size with the places of all keys."""
    place = key.bitwiseAND(F.lit(BITS - 1))
    words = keys.groupBy(F.shiftright(place, 6).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int"))).alias("bits"))
    table, out = words.toArrow(), np.zeros(BITS // 64, np.uint64)  # at most BITS / 64 rows
    out[table.column("w").to_numpy()] = table.column("bits").to_numpy().view(np.uint64)
    return out


def _counted(docs: DataFrame, size: int, shorter: DataFrame, total: int, least: int, seed: int, scratch: Scratch) -> DataFrame:
    """(s0, s1, ..., key, n) of all n-grams of ``size`` words with ``least`` occurrences; ``shorter`` has those of one word less."""
    context = docs.sparkSession.sparkContext
    bits = context.broadcast(_bits(shorter, F.col("key")))
    n_ranges = int(min(RANGES, max(1, -(-total // TARGET))))
    share = max(1, total // n_ranges)
    hot = shorter.where(F.col("n") > share).select("key", "n").toArrow()  # at most n_ranges rows
    order = np.argsort(hot.column("key").to_numpy().view(np.uint64))
    hot_key, hot_spread = hot.column("key").to_numpy().view(np.uint64)[order], -(-hot.column("n").to_numpy()[order] // share)

    def range_of(paths: np.ndarray) -> np.ndarray:
        prefix, last = key_of(paths[:, :-1]), mix64(paths[:, -1])
        spread = np.ones(len(paths), np.int64)
        if len(hot_key):
            at = np.minimum(np.searchsorted(hot_key, prefix), len(hot_key) - 1)
            spread = np.where(hot_key[at] == prefix, hot_spread[at], 1)
        return ((prefix % np.uint64(n_ranges)).astype(np.int64) + (last % spread.astype(np.uint64)).astype(np.int64)) % n_ranges

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        seen = 0

        def flush() -> pa.RecordBatch:
            alphabet, ids = np.unique(np.concatenate(held), return_inverse=True)
            ids = ids.reshape(-1, size)
            # numbers of prefixes and words make one key of 64 bits
            code = ids[:, 0]
            for k in range(1, size):
                distinct, code = np.unique(code * len(alphabet) + ids[:, k], return_inverse=True)
            _, first, n = np.unique(code, return_index=True, return_counts=True)
            paths = alphabet[ids[first]]
            to = range_of(paths)
            order = np.argsort(to, kind="stable")
            to, paths, n = to[order], paths[order], n[order]
            at = np.append(np.flatnonzero(np.append(True, to[1:] != to[:-1])), len(to))
            pieces = [CountTransducer.from_sorted(paths[a:b], n[a:b]).to_bytes() for a, b in zip(at.tolist(), at[1:].tolist(), strict=False)]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(to[at[:-1]]), pa.array(pieces, pa.binary())], ["range", "piece"])

        for whole in batches:
            for batch in chunks(whole, "text"):
                symbol, piece, *_ = words_of(batch, seed)
                n = len(symbol) - size + 1
                if n <= 0:
                    continue
                part = symbol[:, None] if size == 2 else np.column_stack([symbol[k: len(symbol) - size + 2 + k] for k in range(size - 1)])
                often = known(bits.value, key_of(part))
                start = np.flatnonzero(often[:-1] & often[1:] & (piece[:n] == piece[size - 1:]))
                if len(start):
                    held.append(symbol[start[:, None] + np.arange(size)])
                    seen += len(start)
                if seen >= SEGMENT:
                    yield flush()
                    seen = 0
        if held:
            yield flush()

    names = [f"s{k}" for k in range(size)]

    def unite(pieces: pd.DataFrame) -> pd.DataFrame:
        paths, n = union([CountTransducer.from_bytes(p) for p in pieces["piece"]])
        kept = n >= least
        paths, n = paths[kept], n[kept]
        return pd.DataFrame({**{c: paths[:, k].view(np.int64) if len(paths) else np.zeros(0, np.int64) for k, c in enumerate(names)}, "key": key_of(paths).view(np.int64), "n": n})

    made = docs.mapInArrow(build, "range long, piece binary").groupBy("range").applyInPandas(unite, ", ".join(f"{c} long" for c in names) + ", key long, n long")
    out = scratch.save(made, f"grams{size}")
    bits.unpersist()
    return out


def _scored(grams: dict[int, DataFrame], size: int, scale: int) -> DataFrame:
    """The n-grams of one length with l, r and score of their lowest-scoring cut."""
    out = grams[size]
    big = lambda c: c.cast("decimal(19,0)")
    cuts = []
    for k in range(1, size):
        for name, part in ((f"l{k}", range(k)), (f"r{k}", range(k, size))):
            keys = [f"s{i}" for i in part]
            found = grams[len(keys)].select(*[F.col(f"s{j}").alias(c) for j, c in enumerate(keys)], F.col("n").alias(name))
            out = out.join(found, keys)
        cuts.append(F.struct(F.expr(f"(cast(n as decimal(19,0)) * cast(n as decimal(19,0)) * {scale}) div (cast(l{k} as decimal(19,0)) * cast(r{k} as decimal(19,0)))").alias("score"),
                             F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")))
    return out.withColumn("cut", F.least(*cuts) if len(cuts) > 1 else cuts[0]).select(*[f"s{i}" for i in range(size)], F.col("n").alias("a"), "cut.l", "cut.r", "cut.score")


def collocations(df: DataFrame, text: str = "text", group: str = "lang", longest: int = 3, least: int = 10, absorbed: int = 50, first: int | None = None, scale: int = 1_000_000, seed: int = 0) -> DataFrame:
    """(grp, rank, phrase, a, l, r, n, score) of the candidates that no longer one absorbs, best first; ``first`` of each group, or all."""
    if longest < 2:
        raise ValueError("a phrase has two words or more")
    scratch = Scratch(df.sparkSession)
    docs = df.select(F.col(text).alias("text"), F.coalesce(F.col(group).cast("string"), F.lit(UNKNOWN_GROUP)).alias("grp"))
    words = _words(docs, least, seed, scratch)
    totals = words.where("word is null").select("grp", F.col("n").alias("total"))
    total = totals.agg(F.sum("total")).first()[0] or 0
    vocabulary = words.where("word is not null")

    def keyed(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("s0"), pa.array(key_of(b.column("s0").to_numpy().view(np.uint64)[:, None]).view(np.int64)), b.column("n")], ["s0", "key", "n"])

    grams = {1: scratch.save(vocabulary.select(F.col("symbol").alias("s0"), "n").mapInArrow(keyed, "s0 long, key long, n long"), "grams1")}
    for size in range(2, longest + 1):
        grams[size] = _counted(docs, size, grams[size - 1], total, least, seed, scratch)
    ranked = None
    for size in range(2, longest + 1):
        kept, keys = _scored(grams, size, scale), [f"s{i}" for i in range(size)]
        for longer in range(size + 1, longest + 1):
            inner = None
            for at in range(longer - size + 1):
                one = grams[longer].select(*[F.col(f"s{at + i}").alias(c) for i, c in enumerate(keys)], F.col("n").alias("outer"))
                inner = one if inner is None else inner.union(one)
            most = inner.groupBy(*keys).agg(F.max("outer").alias("outer"))
            kept = kept.join(most, keys, "left").where(F.col("outer").isNull() | (100 * F.col("outer") < absorbed * F.col("a"))).drop("outer")
        for i, c in enumerate(keys):
            kept = kept.join(vocabulary.select(F.col("symbol").alias(c), F.col("word").alias(f"w{i}"), *(["grp"] if i == 0 else [])), c)
        kept = kept.select("grp", F.concat_ws(" ", *[f"w{i}" for i in range(size)]).alias("phrase"), "a", "l", "r", "score")
        ranked = kept if ranked is None else ranked.union(kept)
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    if first is not None:
        # a large group is cut in parts before it meets
        part = Window.partitionBy("grp", "salt").orderBy(*order)
        ranked = ranked.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).withColumn("turn", F.row_number().over(part)).where(F.col("turn") <= first).drop("salt", "turn")
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("grp").orderBy(*order)).cast("long"))
    if first is not None:
        ranked = ranked.where(F.col("rank") <= first)
    return ranked.join(totals, "grp").select("grp", "rank", "phrase", "a", "l", "r", F.col("total").alias("n"), "score")
