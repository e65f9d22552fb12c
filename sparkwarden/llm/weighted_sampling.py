"""Document fingerprints by consistent weighted sampling.

A text is a bag of lower-case words, each a 64-bit hash weighed by its count.  For each sample every word has
three random values that depend on the word and the seed only: r and c from a Gamma(2, 1) distribution and b uniform.  With
weight w it draws the step t = floor(ln w / r + b) and the key ln c - r (t - b) - r; the word of the smallest key and its
step are the sample.  The values come from a counter-based hash, so every word has its own; a worker keeps those of
``PLACES`` words at hand, which saves time and never changes results.  Two texts agree in a sample with a probability equal to their generalised Jaccard similarity, the
sum of the smaller weights over the sum of the larger ones.

A fingerprint holds ``SAMPLES`` samples of 16 bits in hex; likeness is the share of equal samples.  Texts without words have
the fingerprint ``EMPTY``, which is like itself only.

For neighbours in a total order rows are dealt out by ranges and sorted there; a partition's last row waits for the first row
of the next one, and these edge rows (two per partition) are matched in a second small step.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkwarden.llm.common import Scratch, chunks, lower_words, mix64, widened

SAMPLES = 64
PLACES = 1 << 15
BLOCK = 2048
SEED = 20
EMPTY = "-"


@functools.cache
def _counters() -> np.ndarray:
    return mix64(np.arange(2 * SAMPLES, dtype=np.uint64) + np.uint64(SEED << 32)).reshape(2, 1, SAMPLES)


def _draws(words: np.ndarray) -> np.ndarray:
    """r, b and the key's constant part, of every word and sample."""
    h, g = mix64(words[:, None] + _counters()[0]), mix64(words[:, None] + _counters()[1])
    # two values of 23 bits from the upper bits of each hash, one from the lower bits of both
    unit = lambda x: ((x & np.uint64(0x7FFFFF)).astype(np.float32) + np.float32(0.5)) * np.float32(2**-23)
    gamma = lambda x: -np.log(unit(x >> np.uint64(41)) * unit(x >> np.uint64(18)))
    r, b = gamma(h), unit(h << np.uint64(5) | g & np.uint64(31))
    return np.stack([r, b, np.log(gamma(g)) + r * b - r], axis=1)


@functools.cache
def _kept() -> tuple[np.ndarray, np.ndarray]:
    """The word kept in each place (at first one that belongs elsewhere) and its draws."""
    return np.arange(1, PLACES + 1, dtype=np.uint64), np.empty((PLACES, 3, SAMPLES), np.float32)


def _draws_of(words: np.ndarray) -> np.ndarray:
    held, kept = _kept()
    place = (words & np.uint64(PLACES - 1)).astype(np.int64)
    out = kept[place]
    new = np.flatnonzero(held[place] != words)
    if len(new):
        out[new] = _draws(words[new])
        # of words with one place the last stays
        last = place[new][::-1]
        last, at = np.unique(last, return_index=True)
        chosen = new[len(new) - 1 - at]
        held[last], kept[last] = words[chosen], out[chosen]
    return out


def sketch(texts: list[str | None]) -> list[np.ndarray | None]:
    """``SAMPLES`` 16-bit samples of each text, or None without words."""
    words, bounds = lower_words(texts)
    out: list[np.ndarray | None] = []
    columns = np.arange(SAMPLES)
    for at, to in zip(bounds.tolist(), bounds[1:].tolist(), strict=False):
        if at == to:
            out.append(None)
            continue
        distinct, counts = np.unique(words[at:to], return_counts=True)
        least = np.full(SAMPLES, np.inf, np.float32)
        sample = np.zeros(SAMPLES, np.uint64)
        for k in range(0, len(distinct), BLOCK):
            p, n = distinct[k : k + BLOCK], counts[k : k + BLOCK]
            r, b, rest = _draws_of(p).swapaxes(0, 1)
            step = np.floor(np.log(n, dtype=np.float32)[:, None] / r + b)
            key = rest - r * step
            won = key.argmin(axis=0)
            less = key[won, columns] < least
            least = np.where(less, key[won, columns], least)
            sample = np.where(less, p[won] * np.uint64(0x10001) + step[won, columns].astype(np.int64).view(np.uint64), sample)
        out.append((mix64(sample) >> np.uint64(48)).astype(">u2"))
    return out


def printed(samples: np.ndarray | None) -> str:
    return EMPTY if samples is None else samples.tobytes().hex()


def likeness(a: np.ndarray | None, b: np.ndarray | None) -> float:
    if a is None or b is None:
        return float(a is None and b is None)
    return float((a == b).mean())


def fingerprints(df: DataFrame, text: str = "text", fingerprint: str = "fingerprint") -> DataFrame:
    """All columns and the fingerprint of every whole text; null counts as empty, equal texts get equal fingerprints."""
    out = df.drop(fingerprint)
    fields = out.columns

    def run(batches):
        for whole in batches:
            for b in chunks(whole, text):
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in fields), pa.array([printed(s) for s in sketch(b.column(text).to_pylist())], pa.string())], [*fields, fingerprint])

    return out.mapInArrow(run, widened(out, **{fingerprint: "string"}))


def edited(text: str, following: str) -> str:
    """The text with its last quarter replaced by the beginning of another."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


_FIELDS = {"n_chars": "long", "edited_sha256": "string", "fingerprint": "string", "edited_fingerprint": "string", "near_edited": "double", "near_next": "double"}


def _compare(ids: list, texts: list[str], following: list[str], own: list, other: list) -> pa.RecordBatch:
    changed = [edited(t, f) for t, f in zip(texts, following, strict=True)]
    after = sketch(changed)
    return pa.RecordBatch.from_arrays([
        pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(c.encode()).hexdigest() for c in changed], pa.string()),
        pa.array([printed(s) for s in own], pa.string()), pa.array([printed(s) for s in after], pa.string()),
        pa.array([likeness(a, b) for a, b in zip(own, after, strict=True)], pa.float64()), pa.array([likeness(a, b) for a, b in zip(own, other, strict=True)], pa.float64())], ["id", *_FIELDS])


def compare_with_next(df: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row.

    The next row is that of the next larger (id, text); after the last comes the first, and a single row follows itself.  Rows that
    repeat an id follow each other in the order of their texts.  A null id comes first, a null text counts as empty.
    """
    scratch = Scratch(df.sparkSession)
    rows = df.select(F.col(id_column).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # ranges of ids alone, as their bounds are found by sampling keys
    ordered = rows.repartitionByRange("id").sortWithinPartitions("id", "text")
    names = ["id", *_FIELDS, "part", "edge", "edge_text"]

    def walk(batches):
        part = TaskContext.get().partitionId()
        held, first = None, True

        def edge(kind, i, t):
            return pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), *(pa.nulls(1, kind_of) for kind_of in (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())), pa.array([part], pa.int32()), pa.array([kind]), pa.array([t])], names)

        for whole in batches:
            for b in chunks(whole, "text"):
                ids, texts = b.column("id").to_pylist(), b.column("text").to_pylist()
                own = sketch(texts)
                if first and ids:
                    first = False
                    yield edge("first", ids[0], texts[0])
                if held:
                    ids, texts, own = [held[0], *ids], [held[1], *texts], [held[2], *own]
                if ids:
                    held = (ids[-1], texts[-1], own[-1])
                if len(ids) > 1:
                    got = _compare(ids[:-1], texts[:-1], texts[1:], own[:-1], own[1:])
                    n = len(got)
                    yield pa.RecordBatch.from_arrays([*got.columns, pa.array([part] * n, pa.int32()), pa.nulls(n, pa.string()), pa.nulls(n, pa.string())], names)
        if held:
            yield edge("last", held[0], held[1])

    schema = "id long, " + ", ".join(f"{k} {v}" for k, v in _FIELDS.items()) + ", part int, edge string, edge_text string"
    walked = scratch.save(ordered.mapInArrow(walk, schema), "walked")
    heads = walked.where("edge = 'first'").select("part", F.col("edge_text").alias("following"))
    # one narrow row per partition
    turn = Window.orderBy("part")
    parts = heads.select("part").withColumn("then", F.coalesce(F.lead("part").over(turn), F.first("part").over(turn.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    ends = walked.where("edge = 'last'").select("id", "part", "edge_text").join(parts, "part").drop("part").join(heads, F.col("then") == F.col("part")).select("id", "edge_text", "following")

    def finish(batches):
        for b in batches:
            texts, following = b.column("edge_text").to_pylist(), b.column("following").to_pylist()
            if texts:
                yield _compare(b.column("id").to_pylist(), texts, following, sketch(texts), sketch(following))

    closed = ends.mapInArrow(finish, "id long, " + ", ".join(f"{k} {v}" for k, v in _FIELDS.items()))
    return walked.where("edge is null").select("id", *_FIELDS).unionByName(closed).withColumnRenamed("id", id_column)
