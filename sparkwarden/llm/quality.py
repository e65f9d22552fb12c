"""Quality of documents by attention-based multiple-instance learning.

A document is a bag of passages, ``PASSAGE`` words each, over its whole text.  A passage is described by shares of characters of each kind,
transitions between kinds, word lengths, repeated words and characters.  Only the document has a label, so the model learns which passages speak for it:

    h = tanh(E x)                                   encoded passage
    a = softmax(w . (tanh(V h) * sigmoid(U h)))     gated attention over the document's passages
    score = sigmoid(c . sum(a h) + d)               the weighted representation

The model is fitted in numpy on a bounded sample: at most ``SAMPLE`` labelled documents of each class in a seeded hash order, and of a document with
more than ``BAG`` passages as many drawn by hash.  Classes weigh as often as they occur among all labelled rows, so scores keep the base rate.
Scoring reads every passage of every text; a model is a few thousand numbers and travels with the task.

Null and empty texts, and texts of white space, are one passage without characters.  A document whose labels differ learns from their mean, at 0.5 and
above as class 1.  Without labels all scores are 0.5; with labels of one class only they are that class's smoothed share.  Equal texts get equal scores.  Labels that are null
or of no document are left out.  Only ``text`` is an input of a score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkwarden.llm.common import chunks, ranges, span_hashes, widened

PASSAGE = 32
SAMPLE = 1500
BAG = 64
HIDDEN, GATE = 16, 12
EPOCHS, BATCH, RATE, DECAY = 40, 64, 0.01, 1e-3
SLICE = 1 << 19  # bytes described at once
SEED = 13

_PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_KIND = np.full(256, 1, np.uint8)  # other controls
_KIND[[0x20, 0x09]], _KIND[[0x0A, 0x0B, 0x0C, 0x0D]] = 2, 3
_KIND[0x30:0x3A], _KIND[0x41:0x5B], _KIND[0x61:0x7B], _KIND[0x80:] = 4, 5, 6, 7
for _i, _c in enumerate(_PUNCTUATION):
    _KIND[_c] = 8 + _i
KINDS = 8 + len(_PUNCTUATION)
_COARSE = np.minimum(_KIND, 8)
COARSE = 9
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
FEATURES = KINDS + COARSE * COARSE + 6


def describe(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of all passages, number of passages of each text, first word of each passage)."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    b = np.frombuffer(b" ".join([*raw, b""]), np.uint8)
    edge = np.flatnonzero(np.diff(~_SPACE[b], prepend=False, append=False))
    starts, ends = edge[0::2], edge[1::2]
    after = np.cumsum([len(r) + 1 for r in raw])
    bounds = np.searchsorted(starts, np.append(0, after))
    words = np.diff(bounds)
    count = np.maximum(1, -(-words // PASSAGE))
    first = np.repeat(bounds[:-1], count) + PASSAGE * (ranges(np.zeros(len(raw), np.int64), count))
    last = np.minimum(first + PASSAGE, np.repeat(bounds[1:], count))
    begin = np.where(first < last, starts[np.minimum(first, max(0, len(starts) - 1))] if len(starts) else 0, 0)
    end = np.where(first < last, ends[np.maximum(last - 1, 0)] if len(ends) else 0, 0)
    out = np.zeros((len(first), FEATURES), np.float32)
    size = np.cumsum(end - begin)
    at = 0
    while at < len(first):
        stop = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + SLICE, side="right")))
        out[at:stop] = _passages(b, begin[at:stop], end[at:stop], first[at:stop], last[at:stop], starts, ends)
        at = stop
    return out, count, first - np.repeat(bounds[:-1], count)


def _passages(b: np.ndarray, begin: np.ndarray, end: np.ndarray, first: np.ndarray, last: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Features of consecutive passages that hold the bytes ``b[begin:end]`` and the words from ``first`` to ``last``."""
    n, length, words = len(begin), end - begin, last - first
    base = int(begin[length > 0][0]) if (length > 0).any() else 0
    part = b[base: int(end.max(initial=base))]
    owner, place = np.repeat(np.arange(n), length), ranges(begin - base, length)
    kind, coarse = _KIND[part], _COARSE[part]
    chars = np.maximum(1, length)[:, None]
    kinds = np.bincount(owner * KINDS + kind[place], minlength=n * KINDS).reshape(n, KINDS) / chars
    same = owner[1:] == owner[:-1]
    left, right = place[:-1][same], place[1:][same]
    pairs = np.bincount(owner[1:][same] * (COARSE * COARSE) + coarse[left].astype(np.int64) * COARSE + coarse[right], minlength=n * COARSE * COARSE).reshape(n, -1) / chars
    runs = np.bincount(owner[1:][same][part[left] == part[right]], minlength=n) / chars[:, 0]
    who, word = np.repeat(np.arange(n), words), ranges(first, words)
    long = (ends[word] - starts[word]).astype(float)
    many = np.maximum(1, words)
    mean = np.bincount(who, long, n) / many
    spread = np.sqrt(np.maximum(0, np.bincount(who, long * long, n) / many - mean * mean))
    hashes = span_hashes(part, starts[word] - base, ends[word] - base)
    order = np.lexsort((hashes, who))
    again = (hashes[order][1:] == hashes[order][:-1]) & (who[order][1:] == who[order][:-1])
    repeated = np.bincount(who[order][1:][again], minlength=n) / many
    extra = np.column_stack((np.log1p(mean), np.log1p(spread), repeated, runs, words / PASSAGE, words == 0))
    # roots bring rare kinds to the scale of frequent ones
    return np.column_stack((np.sqrt(kinds), np.sqrt(pairs), extra)).astype(np.float32)


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Model:
    """Gated attention over passages; ``prior`` alone if it was fitted on less than two classes."""

    def __init__(self, prior: float = 0.5):
        self.prior, self.weights = prior, None

    def start(self, features: np.ndarray) -> None:
        r = np.random.Generator(np.random.PCG64(SEED))
        self.mean, self.scale = features.mean(axis=0), features.std(axis=0) + 0.02
        draw = lambda *s: r.standard_normal(s) / np.sqrt(s[-1])
        self.weights = {"E": draw(HIDDEN, FEATURES), "e": np.zeros(HIDDEN), "V": draw(GATE, HIDDEN), "U": draw(GATE, HIDDEN), "w": draw(GATE), "c": draw(HIDDEN), "d": np.zeros(1)}

    def forward(self, features: np.ndarray, counts: np.ndarray) -> dict:
        """All steps for the bags of ``counts`` consecutive passages."""
        p = self.weights
        x = np.clip((features - self.mean) / self.scale, -8, 8)
        h = np.tanh(x @ p["E"].T + p["e"])
        v, u = np.tanh(h @ p["V"].T), sigmoid(h @ p["U"].T)
        s = (v * u) @ p["w"]
        at = np.append(0, np.cumsum(counts)[:-1])
        q = np.exp(s - np.repeat(np.maximum.reduceat(s, at), counts))
        a = q / np.repeat(np.add.reduceat(q, at), counts)
        z = np.add.reduceat(a[:, None] * h, at, axis=0)
        return {"x": x, "h": h, "v": v, "u": u, "a": a, "at": at, "z": z, "score": sigmoid(z @ p["c"] + p["d"])}

    def gradient(self, features: np.ndarray, counts: np.ndarray, label: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Of the weighted mean log loss."""
        p, f = self.weights, self.forward(features, counts)
        g = weight * (f["score"] - label) / weight.sum()
        over = lambda each: np.repeat(each, counts, axis=0)
        gz = over(g[:, None] * p["c"])
        ga = (gz * f["h"]).sum(axis=1)
        gs = f["a"] * (ga - over(np.add.reduceat(f["a"] * ga, f["at"])))
        gate = gs[:, None] * p["w"]
        gv, gu = gate * f["u"] * (1 - f["v"] ** 2), gate * f["v"] * f["u"] * (1 - f["u"])
        gh = (f["a"][:, None] * gz + gv @ p["V"] + gu @ p["U"]) * (1 - f["h"] ** 2)
        return {"E": gh.T @ f["x"], "e": gh.sum(axis=0), "V": gv.T @ f["h"], "U": gu.T @ f["h"], "w": (f["v"] * f["u"]).T @ gs, "c": f["z"].T @ g, "d": np.array([g.sum()])}

    def fit(self, bags: list[np.ndarray], label: np.ndarray, weight: np.ndarray) -> Model:
        """Adam with decay of weights over shuffled batches of documents."""
        self.start(np.concatenate(bags))
        r = np.random.Generator(np.random.PCG64(SEED + 1))
        m = {k: np.zeros_like(v) for k, v in self.weights.items()}
        s = {k: np.zeros_like(v) for k, v in self.weights.items()}
        step, total = 0, EPOCHS * max(1, -(-len(bags) // BATCH))
        for _ in range(EPOCHS):
            order = r.permutation(len(bags))
            for i in range(0, len(bags), BATCH):
                pick = order[i: i + BATCH]
                grad = self.gradient(np.concatenate([bags[j] for j in pick]), np.array([len(bags[j]) for j in pick]), label[pick], weight[pick])
                step += 1
                rate = RATE * (1 - step / (total + 1))
                for k, x in grad.items():
                    x = x + DECAY * self.weights[k]
                    m[k], s[k] = 0.9 * m[k] + 0.1 * x, 0.99 * s[k] + 0.01 * x * x
                    self.weights[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-8)
        return self

    def score(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(score, passages, first word of the most attended passage, its attention) of each text."""
        features, counts, first = describe(texts)
        at = np.append(0, np.cumsum(counts)[:-1])
        if self.weights is None:
            return np.full(len(texts), self.prior), counts, first[at], 1 / counts
        score, attention = [], []
        # a bag is whole, whatever its length; bags are taken together up to a bound
        i = 0
        while i < len(texts):
            j = max(i + 1, int(np.searchsorted(np.cumsum(counts), at[i] + 8192, side="right")))
            f = self.forward(features[at[i]: at[j - 1] + counts[j - 1]], counts[i:j])
            score.append(f["score"])
            attention.append(f["a"])
            i = j
        a = np.concatenate(attention)
        peak = np.maximum.reduceat(a, at)
        top = np.flatnonzero(a == np.repeat(peak, counts))
        lead = top[np.searchsorted(top, at)]
        return np.concatenate(score), counts, first[lead], peak


def fit(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> Model:
    """A model from ``labels`` (id, label) of ``docs``; see the module for the bounds of the sample."""
    known = labels.where(F.col(id_column).isNotNull() & F.col(label).isNotNull()).select(F.col(id_column).alias("id"), F.col(label).cast("double").alias("y"))
    each = known.groupBy("id").agg(F.avg("y").alias("y")).withColumn("one", (F.col("y") >= 0.5).cast("int")).withColumn("h", F.xxhash64(F.lit(SEED), "id"))
    n = {r["one"]: r["count"] for r in each.groupBy("one").count().collect()}  # two rows
    if len(n) < 2:
        return Model((n.get(1, 0) + 0.5) / (sum(n.values()) + 1) if n else 0.5)
    # a threshold on the hash leaves about twice the sample to rank
    few = None
    for one, rows in n.items():
        part = each.where(F.col("one") == one)
        if rows > 4 * sample:
            part = part.where(F.shiftrightunsigned("h", 1) < int(2**63 * (2 * sample / rows)))
        part = part.withColumn("turn", F.row_number().over(Window.partitionBy("one").orderBy("h", "id"))).where(F.col("turn") <= sample)
        few = part if few is None else few.union(part)
    drawn = docs.select(F.col(id_column).alias("id"), F.col(text).alias("text")).join(F.broadcast(few.select("id", "y", "one", "h")), "id")

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, "text"):
                features, counts, _ = describe(batch.column("text").to_pylist())
                out = []
                for a, k in zip((np.cumsum(counts) - counts).tolist(), counts.tolist(), strict=True):
                    bag = features[a: a + k]
                    if k > BAG:
                        bag = bag[np.sort(np.random.Generator(np.random.PCG64(SEED)).permutation(k)[:BAG])]
                    out.append(bag.tobytes())
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("y", "one", "h")), pa.array(out, pa.binary())], ["y", "one", "h", "bag"])

    # rows may repeat an id: one text of each, so the sample stays bounded
    one_text = drawn.groupBy("id", "y", "one", "h").agg(F.min("text").alias("text"))
    table = one_text.select("y", "one", "h", "text").mapInArrow(bags, "y double, one int, h long, bag binary").toPandas()  # at most 2 x sample bags of at most BAG passages
    table = table.sort_values(["h", "bag"])
    one = table["one"].to_numpy()
    if len(set(one.tolist())) < 2:
        return Model((n[1] + 0.5) / (n[0] + n[1] + 1))
    weight = np.where(one == 1, n[1] / (one == 1).sum(), n[0] / (one == 0).sum())
    return Model().fit([np.frombuffer(x, np.float32).reshape(-1, FEATURES) for x in table["bag"]], table["y"].to_numpy(), weight / weight.mean())


def assess(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with quality_score, n_passages, top_passage (its first word) and top_attention; columns of these names are replaced."""
    docs = docs.drop("quality_score", "n_passages", "top_passage", "top_attention")
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, text):
                score, n, first, attention = model.score(batch.column(text).to_pylist())
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score), pa.array(n, pa.int64()), pa.array(first, pa.int64()), pa.array(attention)],
                                                 [*names, "quality_score", "n_passages", "top_passage", "top_attention"])

    return docs.mapInArrow(run, widened(docs, quality_score="double", n_passages="long", top_passage="long", top_attention="double"))
