"""Language ID, fingerprints, neighbours, mixing, URL lists and the pipeline."""

import collections
import datetime
import hashlib
import re

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from sparkwarden.llm import language_id, mixing, nearest, queries, url_lists, weighted_sampling
from sparkwarden.llm.common import in_order

import __spark_entry__ as entry
import corpus_pipeline

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents():
    return {r["doc_id"]: r for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()}


def test_held_out_accuracy(spark):
    docs = {r["doc_id"]: r["lang"] for r in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["doc_id", "lang"]).to_pylist()}
    got = queries.op9_language_id(spark, "/root/testdata/sf0.01").collect()
    held = [r for r in got if r.held_out]
    assert len(got) == len(docs) and len(held) > 200
    assert np.mean([r.lang_pred == docs[r.doc_id] for r in held]) > 0.97
    assert not any(r.rejected for r in got) and all(0 <= r.score <= 1 for r in got)


def test_long_texts_of_no_known_language_are_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    draw = np.random.default_rng(4)

    def invented(letters, words, length):
        return " ".join("".join(draw.choice(letters, length)) for _ in range(words))

    latin, cyrillic = list("abcdefghijklmnopqrstuvwxyz"), list("абвгдежзийклмнопрстуфхцчшщыэюя")
    rows = [(-1 - k, invented(letters, words, length), "odd", 0) for k, (letters, words, length) in enumerate(
        (a, n, m) for a, m in ((latin, 6), (cyrillic, 6), ([chr(c) for c in range(0x4E00, 0x9000)], 40)) for n in (20, 100, 2000, 10000))]
    odd = spark.createDataFrame(rows, "doc_id long, text string, source string, other int").drop("other")
    got = language_id.identify(odd, docs).collect()
    assert len(got) == 12 and all(r.rejected for r in got)
    clean = language_id.identify(docs.select("doc_id", "text", F.col("lang").alias("told")), docs).where("length(text) >= 300")
    assert clean.where("rejected").count() == 0 and clean.count() > 500


def test_cosine_is_that_of_direct_counts():
    """The cosine of signed hashed counts differs from that of the n-grams themselves by collisions only."""
    texts = ["Der Hund und die Katze, der Mond.", "Der Hund und der Mond; die Katze", "zzz qqq"]

    def direct(text):
        s = " " + re.sub(r"[^a-z]+", " ", text.lower()).strip() + " "
        return collections.Counter(s[i:i + k] for k in (1, 2, 3) for i in range(len(s) - k + 1))

    v = language_id._weigh(language_id.gram_counts(texts)[0], np.float32(1))
    bags = [direct(t) for t in texts]
    norm = lambda b: sum(np.log1p(c) ** 2 for c in b.values()) ** 0.5
    for i in range(3):
        for j in range(3):
            want = sum(np.log1p(bags[i][g]) * np.log1p(bags[j][g]) for g in bags[i]) / norm(bags[i]) / norm(bags[j])
            assert abs(float(v[i] @ v[j]) - want) < 0.12


def test_language_edge_cases(spark):
    df = spark.createDataFrame([(1, None, "s"), (2, "", "s"), (3, "12 %", "s"), (4, "mot", "s"), (4, "mot", "s")], "doc_id long, text string, score string")
    none = language_id.identify(df, df.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert [r.lang_pred for r in none] == ["und"] * 5 and [r.rejected for r in none] == [True, True, True, False, False]
    some = language_id.identify(df, df.where("doc_id = 4").withColumn("lang", F.lit("fr"))).collect()
    assert [r.lang_pred for r in some] == ["und", "und", "und", "fr", "fr"] and some[0].score == 0
    assert language_id.identify(df.limit(0), df.limit(0).withColumn("lang", F.lit("x"))).count() == 0


def jaccard(a, b):
    x, y = (collections.Counter(t.encode().lower().split()) for t in (a, b))
    return sum((x & y).values()) / max(1, sum((x | y).values()))


def test_fingerprints(spark, documents):
    got = {r.doc_id: r for r in queries.op10_weighted_sampling(spark, SF).collect()}
    order = sorted(documents)
    error = []
    for at, i in enumerate(order):
        text, following = documents[i]["text"], documents[order[(at + 1) % len(order)]]["text"]
        k = len(text) // 4
        changed = text[: len(text) - k] + following[:k]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(changed.encode()).hexdigest())
        error += [r.near_edited - jaccard(text, changed), r.near_next - jaccard(text, following)]
    assert abs(np.mean(error)) < 0.02 and np.std(error) < 0.08
    same = collections.defaultdict(set)
    for i in order:
        same[documents[i]["text"]].add(got[i].fingerprint)
    assert all(len(x) == 1 for x in same.values())


def test_fingerprints_of_long_disjoint_texts():
    n = 60_000
    for at in range(3):
        a, b = (" ".join(f"{side}{at}x{i}" for i in range(n)) for side in "ab")
        one, other = weighted_sampling.sketch([a, b])
        assert weighted_sampling.likeness(one, other) <= 2 / 64
        assert (weighted_sampling.sketch([a])[0] == one).all()
    half = " ".join(f"h{i}" for i in range(n))
    one, other = weighted_sampling.sketch([half, half + " " + " ".join(f"k{i}" for i in range(n))])
    assert abs(weighted_sampling.likeness(one, other) - 0.5) < 0.25


def test_fingerprint_edge_cases(spark):
    df = spark.createDataFrame([(3, None, 1), (1, "a b", 1), (2, "", 1), (2, "z", 1), (2, "z", 1), (None, "q", 1)], "doc_id long, text string, id int")
    got = weighted_sampling.compare_with_next(df).orderBy("doc_id", "near_next").collect()
    assert [(r.doc_id, r.near_next) for r in got] == [(None, 0.0), (1, 0.0), (2, 0.0), (2, 0.0), (2, 1.0), (3, 0.0)]
    assert weighted_sampling.compare_with_next(df.limit(0)).count() == 0
    assert [r.near_next for r in weighted_sampling.compare_with_next(df.where("doc_id = 1")).collect()] == [1.0]


def test_neighbours_recall(spark):
    t = pq.read_table(f"{SF}/embeddings.parquet")
    ids, x = np.array(t["vec_id"]), np.array(t["embedding"].to_pylist(), float)
    got = collections.defaultdict(list)
    for r in queries.op5_nearest(spark, SF).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    hits = total = 0
    for q in ids[ids % 100 == 0]:
        at = np.flatnonzero(ids == q)[0]
        d = np.sqrt(((x - x[at]) ** 2).sum(axis=1))
        order = np.lexsort((ids, d))
        want = ids[order[order != at][:10]]
        rows = sorted(got[q])
        assert [r for r, _, _ in rows] == list(range(1, 11)) and all(abs(d[ids == v][0] - s) < 1e-12 for _, v, s in rows)
        hits += len(set(want) & {v for _, v, _ in rows})
        total += 10
    assert hits / total >= 0.9


def test_neighbours_edge_cases(spark):
    rows = [(0, None), (100, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [0.0, 0.0]), (3, [float("nan"), 1.0]), (4, [1.0, None]), (5, [3.0, 1.0]), (200, [1.0, 2.0]), (6, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [(r.query_id, r["rank"], r.id) for r in nearest.search(df, df.where("vec_id % 100 = 0")).orderBy("query_id", "rank").collect()]
    assert got == [(100, 1, 1), (100, 2, 200), (100, 3, 5), (200, 1, 1), (200, 2, 100), (200, 3, 5)]
    assert nearest.search(df.limit(0), df.limit(0)).count() == 0


def test_neighbours_of_repeated_rows(spark):
    rows = [(1, [1.0, 2.0])] * 11 + [(i, [1.0, 2.0]) for i in range(2, 15)] * 2 + [(100, [1.0, 2.0]), (50, [3.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [(r["rank"], r.id, r.score) for r in nearest.search(df, df.where("vec_id = 100")).orderBy("rank").collect()]
    assert got == [(i, i, 0.0) for i in range(1, 11)]


def test_chi2_distribution():
    draws = np.random.Generator(np.random.PCG64(1)).chisquare(nearest.LOW, 20_000)
    for q in (2.0, 8.0, 15.0):
        assert abs(float(nearest.chi2(q)) - (draws < q).mean()) < 0.01


def test_flow_prefers_first_uses():
    got = mixing.route({1: 10, 2: 10, 3: 5}, [(1, "a"), (2, "a"), (2, "b"), (3, "b")], {"a": 18, "b": 14})
    assert sum(got.values()) == 32 and got[2] >= 10 and got[1] >= 10
    assert mixing.route({1: 10, 2: 10}, [(1, "a"), (2, "a")], {"a": 20}) == {1: 10, 2: 10}


def brute_targets(rows):
    size = collections.Counter()
    for _, text, source in rows:
        size[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    names = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [None] * (None in size)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    full = set()
    while True:
        rest, open_weight = 1.5 * sum(size.values()) - sum(2 * size[s] for s in full), sum(weight[s] for s in names if s not in full)
        target = {s: 2.0 * size[s] if s in full else rest * weight[s] / open_weight for s in names}
        above = {s for s in names if s not in full and target[s] > 2 * size[s]}
        if not above:
            return size, target
        full |= above


def test_mix(spark, documents):
    rows = [(r["doc_id"], r["text"], "s" + r["source"][-1]) for r in documents.values()] + [(900, "x y", "a")] * 3 + [(901, None, "q"), (902, "", None), (903, "w " * 5000, None), (904, "\x0b\x1f\x85 a", "ü")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df).collect()
    size, target = brute_targets(rows)
    taken = collections.Counter()
    for r in got:
        assert 0 <= r.rounds <= 2 and r.source_size == size[r.source] and r.target == pytest.approx(target[r.source])
        taken[r.source] += r.size * r.rounds
    assert len(got) == len(rows)
    for s in ("s0", "s1", "s2"):
        assert abs(taken[s] - target[s]) <= 0.05 * target[s]
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.mix(df.repartition(3)).collect()))
    assert mixing.mix(df.limit(0)).count() == 0


def test_mix_of_overlapping_sources(spark):
    df = spark.createDataFrame([(i, "w " * 10, [["a"], ["a", "b"], ["b"], []][i % 4]) for i in range(80)], "doc_id long, text string, source array<string>")
    assert all(r.rounds <= 2 for r in mixing.mix(df, overlapping=True).collect())


def test_numbers_in_order(spark):
    words = sorted({f"{i * 7919 % 1000:03d}" for i in range(500)})
    got = in_order(spark.createDataFrame([(w,) for w in reversed(words)], "w string").repartition(5), "w", "place").collect()
    assert sorted((r.place, r.w) for r in got) == list(enumerate(words))
    assert in_order(spark.createDataFrame([], "w string"), "w", "place").count() == 0


def test_url_lists(spark):
    day = lambda d, h=0: datetime.datetime(2024, 1, 1) + datetime.timedelta(days=d, hours=h)
    log = [("m", "x.com", "add", day(0, 5)), ("m", "x.com", "remove", day(0, 9)), ("m", "x.com", "add", day(3)), ("m", "x.com", "add", day(3)), ("m", "x.com", "remove", day(200, 1)),
           ("s", "a.x.com", "add", day(1)), (None, "x.com", "add", day(0)), ("t", "y.com", "add", day(2)), ("t", "y.com", "remove", day(2))]
    entries = spark.createDataFrame(log, "list string, pattern string, action string, at timestamp")
    asked = [(url, day(d, h)) for url in ("http://A.x.com/p", "https://u@x.com:8/", "http://yx.com", "http://y.com", "nohost") for d, h in ((-1, 0), (0, 5), (0, 8), (0, 9), (1, 0), (2, 1), (3, 0), (40, 3), (199, 23), (200, 0), (200, 1), (300, 0))]
    asked += [(None, day(1)), ("http://x.com", None), asked[0]]
    got = url_lists.evaluate(spark.createDataFrame([(*a, 1) for a in asked], "url string, fetched_at timestamp, list int"), entries).collect()

    def active(url, t):
        host = (re.match(r"[a-z]+://(?:[^/@]*@)?([^/:]+)", (url or "").lower()) or [None, None])[1]
        out = set()
        for name, pattern in {(x, p) for x, p, _, _ in log if x}:
            before = sorted((at, action) for x, p, action, at in log if (x, p) == (name, pattern) and t is not None and at <= t)
            if host and before and before[-1][1] == "add" and (host == pattern or host.endswith("." + pattern)):
                out.add(name)
        return sorted(out)

    assert len(got) == len(asked) and all(r.active_lists == active(r.url, r.fetched_at) for r in got)
    assert url_lists.evaluate(spark.createDataFrame([], "url string, fetched_at timestamp"), entries).count() == 0


def test_pipeline(spark, documents):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("lang_pred", F.lit("x"))
    kept, results = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        kept = stage(spark, kept, SF)
        kept = spark.createDataFrame(kept.collect(), kept.schema)
        results[name] = kept
        if name != "bpe":
            assert kept.columns == corpus_pipeline.COLUMNS
    assert results["language_id"].count() == len(documents)
    assert results["jaccard_join"].count() == results["pii"].count() < len(documents)
    assert not [r for r in results["pii"].collect() if re.search(r"[\w.]+@mail\d", r.text)]
    words = lambda t: len(t.split())
    before, after = results["pii"].collect(), results["mixing"].collect()
    assert max(collections.Counter(r.doc_id for r in after).values()) <= 2
    assert sum(words(r.text) for r in after) == pytest.approx(1.5 * sum(words(r.text) for r in before), rel=0.05)
    text = {r.doc_id: r.text for r in after}
    assert all(r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest() and r.n_tokens == len(r.ids) for r in results["bpe"].collect())


def test_pipeline_of_nothing_and_of_nulls(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for rows in ([], [(None, None, None, None, None), (1, "", "en", None, 0), (2, "some text here", None, "a", 14), (2, "some text here", None, "a", 14)]):
        kept = spark.createDataFrame(rows, schema)
        for _, stage in corpus_pipeline.STAGES:
            kept = stage(spark, kept, SF)
        assert kept.count() <= len(rows) * 2


def test_every_operator_is_registered():
    names = set(entry.queries())
    assert all(any(q.startswith(f"op{n}_") for q in names) for n in range(1, 11)) and "pipeline" in names


def test_one_of_each_group_keeps_other_texts_of_an_id(spark):
    a, b, c = ("one two three four five six " * 3 + x for x in ("alpha", "beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu", "q"))
    rows = [(1, a), (1, b), (2, b), (3, a), (None, a), (None, c + " z y x w v u t s r q p o n m l k j i h"), (None, None), (4, None), (4, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.one_of_each_group(spark, docs, "").collect()), key=repr)
    assert kept == sorted([(1, a), (1, b), (None, rows[5][1]), (None, None), (4, None)], key=repr)


def test_mix_takes_rows_without_an_id(spark):
    rows = [(None, "w " * k, s) for k in range(1, 40) for s in ("a", "b", None)] + [(i, "w " * 20, "a") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs).selectExpr("source", "target", "size * rounds AS taken", "rounds").collect()
    assert len(got) == len(rows) and max(r["rounds"] for r in got) <= 2
    for s in ("a", "b", None):
        mine = [r for r in got if r["source"] == s]
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= 20
