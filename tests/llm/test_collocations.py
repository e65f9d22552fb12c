"""Collocations against a direct count."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from sparkwarden.llm import collocations as c

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, longest, least, absorbed, first):
    f, total = Counter(), Counter()
    for text, lang in rows:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            w = re.findall(r"[^ \t]+", piece)
            total[lang] += len(w)
            for size in range(1, longest + 1):
                for i in range(len(w) - size + 1):
                    f[lang, tuple(w[i:i + size])] += 1
    out = {}
    held = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    for (lang, p), a in held.items():
        inside = [n for (g, q), n in held.items() if g == lang and len(q) > len(p) and any(q[i:i + len(p)] == p for i in range(len(q)))]
        if any(100 * n >= absorbed * a for n in inside):
            continue
        score, k = min((1_000_000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted((lang, r, p.decode(), -a, x, y, total[lang], -s) for lang, each in out.items() for r, (s, a, p, x, y) in enumerate(sorted(each)[:first], 1))


def fixture():
    r = random.Random(3)
    vocabulary = [a + b for a in "abcdé" for b in "xyzÅ"]
    def text(n):
        return "".join(r.choice(vocabulary[: r.choice([3, 20])]) + r.choice([" ", "  ", "\t", " ", " ", ". ", ",", "\n", "!\r"]) for _ in range(n))
    rows = [(text(r.randint(0, 120)), r.choice(["en", "de", None, "und", "x"])) for _ in range(150)]
    rows += [("New  York City hall. " * 12 + "new york x", "en"), (text(6000), "en"), (None, "en"), ("", None), (" \t.,", "fr"), ("one two", "fr")]
    rows += [("the same copy of Words", "de")] * 90
    return rows


@pytest.mark.parametrize("longest,first,segment,target", [(3, 40, 2_000_000, 2_000_000), (4, 10_000, 500, 60)])
def test_against_direct_count(spark, monkeypatch, longest, first, segment, target):
    monkeypatch.setattr(c, "SEGMENT", segment)
    monkeypatch.setattr(c, "TARGET", target)
    df = spark.createDataFrame([(t, g, 1, "p", 2) for t, g in fixture()], "text string, lang string, n int, grp string, symbol int").repartition(3)
    got = sorted(tuple(r) for r in c.collocations(df, longest=longest, first=first).collect())
    assert got == brute(fixture(), longest, 10, 50, first) and len(got) > 40


def test_empty_tables(spark):
    for rows in ([], [(None, None)], [("a b c", "en")]):
        assert c.collocations(spark.createDataFrame(rows, "text string, lang string")).count() == 0


def test_transducer_keeps_paths_and_shares_states():
    r = np.random.default_rng(1)
    paths, weights = c.summed(r.integers(0, 12, (3000, 3)).astype(np.uint64), np.ones(3000, np.int64))
    t = c.CountTransducer.from_bytes(c.CountTransducer.from_sorted(paths, weights).to_bytes())
    got, n = t.paths()
    assert (got == paths).all() and (n == weights).all()
    grid = np.array([(a, b, d) for a in range(20) for b in range(20) for d in range(20)], np.uint64)
    assert [len(x[1]) for x in c.CountTransducer.from_sorted(grid, np.ones(8000, np.int64)).levels] == [20, 20, 20]
    both, n = c.union([t, c.CountTransducer.from_sorted(grid, np.full(8000, 7))])
    assert n.sum() == 3000 + 56000 and len(both) == 8000


def test_words_that_share_a_symbol_fail(spark, monkeypatch):
    monkeypatch.setattr(c, "_word_counts", lambda docs, seed: docs.selectExpr("1L AS symbol", "grp", "text AS word", "1L AS n"))
    with pytest.raises(Exception, match="share a symbol"):
        c.collocations(spark.createDataFrame([("a", "en"), ("b", "en")], "text string, lang string"))
