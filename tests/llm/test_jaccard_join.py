"""Near-duplicate components against all pairs."""

import random
import re

from sparkwarden.llm import jaccard_join


def brute(rows):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        sets.append({tuple(w[k: k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    root = {i: i for i, _ in rows}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = top(rows[a][0]), top(rows[b][0])
                root[max(x, y)] = min(x, y)
    return sorted((i, len(s), top(i)) for (i, _), s in zip(rows, sets, strict=True))


def fixture():
    r = random.Random(11)
    rows = []
    for size in (3, 5, 9, 30, 60, 150):
        base = [r.choice("abcdefghijklmnop") * r.randint(1, 3) for _ in range(size)]
        for _ in range(20):
            w = list(base)
            for _ in range(r.randint(0, 3)):
                w[r.randrange(len(w))] = r.choice("xyz") * 2
            rows.append((len(rows) * 3, r.choice(["  ", " ", "\n"]).join(w[: r.choice([len(w), len(w) * 9 // 10]) or 1])))
    rows += [(5000, None), (5001, ""), (5002, " \n"), (5003, "A b"), (5004, "a  B"), (5005, "é Ö"), (5006, "é ö"), (5007, "é Ö"), (5008, "w " * 4000)]
    return rows + [(0, rows[0][1]), (9, rows[40][1])]  # a repeated row, and an id with two texts


def test_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "TILE", 4)
    monkeypatch.setattr(jaccard_join, "HEAVY_LEAST", 3)
    rows = fixture()
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, n long, id long")
    assert sorted(tuple(r) for r in jaccard_join.near_duplicates(df).collect()) == brute(rows)


def test_rows_without_id(spark):
    """They keep their size and link with nothing, nor do they link others."""
    rows = [(1, "a b c d e f g"), (None, "a b c d e f g"), (None, None), (7, "a b c d e f g"), (None, "x"), (9, "x y")]
    got = jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(1, 3, 1), (None, 3, None), (None, 0, None), (7, 3, 1), (None, 1, None), (9, 1, 9)], key=repr)


def test_large_group_of_pairs_just_below(spark, monkeypatch):
    """Documents that share three quarters of their shingles with a centre link rarely; the last step meets them all."""
    monkeypatch.setattr(jaccard_join, "TILE", 16)
    r = random.Random(4)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for i in range(90):
        w = list(base)
        for _ in range(r.randint(0, 5)):
            w[r.randrange(len(w))] = f"x{r.randint(0, 9)}"
        rows.append((i, " ".join(w)))
    assert sorted(map(tuple, jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())) == brute(rows)


def test_empty_table(spark):
    assert jaccard_join.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
