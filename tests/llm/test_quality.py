"""Quality classifier: features, attention and gradients against direct computations, held-out accuracy."""

import random
import re

import numpy as np
from pyspark.sql import functions as F

from sparkwarden.llm import quality as q

TEXTS = ["One two, three!! FOUR*** five 66\nsix é ü", None, "", " \n", "w " * 5000, "x" * 3000, "a  b a\tb " * 40, "Ünïcode 文字 " * 50]


def test_passages_cover_whole_texts(monkeypatch):
    monkeypatch.setattr(q, "SLICE", 300)
    features, counts, first = q.describe(TEXTS)
    alone = [q.describe([t]) for t in TEXTS]
    assert (features == np.concatenate([a[0] for a in alone])).all()  # neither neighbours nor slices matter
    words = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in TEXTS]
    assert counts.tolist() == [max(1, -(-w // q.PASSAGE)) for w in words]
    assert first[: counts[0]].tolist() == [0] and first[-3:].tolist() == [32, 64, 96]
    x = features[0]
    text = TEXTS[0].encode()
    for kind, chars in ((5, r"[A-Z]"), (4, r"[0-9]"), (3, r"\n"), (7, "[éü]{1}"), (8 + q._PUNCTUATION.index(b"*"), r"\*")):
        found = len("".join(re.findall(chars, TEXTS[0])).encode())
        assert np.isclose(x[kind] ** 2 * len(text), found)
    assert features[counts[0], -1] == 1 and features[counts[0], :-1].sum() == 0  # no text: no characters


def test_gradient_is_that_of_the_loss():
    r = np.random.default_rng(0)
    counts = np.array([1, 4, 7])
    x, y, weight = r.random((12, q.FEATURES)), np.array([0.0, 1.0, 0.5]), np.array([1.0, 2.0, 0.5])
    model = q.Model()
    model.start(x)

    def loss():
        p = model.forward(x, counts)["score"]
        return float((weight * -(y * np.log(p) + (1 - y) * np.log(1 - p))).sum() / weight.sum())

    for name, g in model.gradient(x, counts, y, weight).items():
        for _ in range(6):
            at = tuple(r.integers(0, s) for s in g.shape)
            keep = model.weights[name][at]
            model.weights[name][at] = keep + 1e-6
            up = loss()
            model.weights[name][at] = keep - 1e-6
            assert np.isclose((up - loss()) / 2e-6, g[at], atol=1e-6)
            model.weights[name][at] = keep


def corpus(n, seed):
    """Documents of several passages; a bad one has a single bad passage."""
    r = random.Random(seed)
    plain = lambda k: " ".join(r.choice("river stone cloud walk green early".split()) for _ in range(k))
    rows = []
    for i in range(n):
        passages = [plain(q.PASSAGE) for _ in range(r.randint(2, 12))]
        bad = i % 3 == 0
        if bad:
            passages[r.randrange(len(passages))] = " ".join(w + r.choice(["!!", "***", "%%"]) for w in plain(q.PASSAGE).split())
        rows.append((i, " ".join(passages), 0 if bad else 1))
    return rows


def test_attention_finds_the_passage_that_decides(spark):
    train, test = corpus(300, 1), corpus(60, 2)
    docs = spark.createDataFrame([(i, t) for i, t, _ in train], "doc_id long, text string")
    model = q.fit(docs, spark.createDataFrame([(i, y) for i, _, y in train], "doc_id long, quality int"))
    score, n, first, attention = model.score([t for _, t, _ in test])
    label = np.array([y for *_, y in test])
    assert ((score >= 0.5) == label).mean() >= 0.97
    bad = label == 0
    marked = [any(c in " ".join(t.split()[f: f + q.PASSAGE]) for c in "!*%") for (_, t, _), f in zip(test, first.tolist(), strict=True)]
    assert np.mean(np.array(marked)[bad]) >= 0.9
    # the forward pass, one document at a time, by its formula
    w = model.weights
    for (_, t, _), s in list(zip(test, score, strict=True))[:10]:
        x = np.clip((q.describe([t])[0] - model.mean) / model.scale, -8, 8)
        h = np.tanh(x @ w["E"].T + w["e"])
        e = np.exp([w["w"] @ (np.tanh(w["V"] @ k) * q.sigmoid(w["U"] @ k)) for k in h])
        assert np.isclose(s, q.sigmoid(w["c"] @ (e / e.sum() @ h) + w["d"][0]))


def test_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    kept = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    found = q.assess(docs, q.fit(docs, labels.where(~kept))).where(kept).join(labels, "doc_id").select("quality_score", "quality").toPandas()
    assert ((found["quality_score"] >= 0.3) == found["quality"]).mean() >= 0.95


def test_odd_rows(spark):
    rows = [(i, t, 0.5, "x") for i, t in enumerate(TEXTS)] + [(None, "no id", 0.5, "x"), (3, "a second text", 0.5, "y"), (3, "a second text", 0.5, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality_score double, quality string")
    labels = spark.createDataFrame([(0, 1, 1), (0, 0, 0), (4, 0, 0), (4, 0, 0), (5, None, 0), (None, 1, 1), (99, 1, 1), (3, 1, 1)], "doc_id long, quality int, text int")
    got = q.assess(docs, q.fit(docs, labels)).collect()
    assert len(got) == len(rows) and all(0 <= r["quality_score"] <= 1 for r in got) and len({r["quality_score"] for r in got if r["doc_id"] in (1, 2) and not r["text"]}) == 1
    one = labels.where("quality = 1")
    assert {r["quality_score"] for r in q.assess(docs, q.fit(docs, one)).collect()} == {3.5 / 4}
    assert {r["quality_score"] for r in q.assess(docs, q.fit(docs, labels.limit(0))).collect()} == {0.5}
    assert q.assess(docs.limit(0), q.fit(docs.limit(0), labels)).count() == 0


def test_sample_is_bounded_and_keeps_the_base_rate(spark, monkeypatch):
    monkeypatch.setattr(q, "BAG", 3)
    rows = corpus(300, 5)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(q.Model, "fit", lambda self, bags, label, weight: seen.append((bags, label, weight)) or self)
    q.fit(docs, labels, sample=20)
    bags, label, weight = seen[0]
    assert (label == 1).sum() == (label == 0).sum() == 20 and max(map(len, bags)) == 3
    assert np.isclose(weight[label == 1].sum() / weight.sum(), 200 / 300)
