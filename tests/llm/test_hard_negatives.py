"""Hard negatives against all pairs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkwarden.llm import hard_negatives

SCHEMA = "vec_id long, embedding array<double>, label int, id int, packed string, cluster int"


def brute(rows, step, positives, negatives, low, high):
    usable = [(i, label, tuple(math.floor(256 * x) for x in v)) for i, v, label in rows
              if i is not None and v and label is not None and all(x is not None and math.isfinite(x) for x in v)]
    usable = sorted(set(usable))
    out = []
    for a in usable:
        if a[0] % step:
            continue
        scored = sorted((-sum(x * y for x, y in zip(a[2], b[2], strict=True)), b[0], b[1] == a[1]) for b in usable if b[0] != a[0] and len(b[2]) == len(a[2]))
        for p, i, _ in [x for x in scored if x[2]][:positives]:
            fits = [(-s, j) for s, j, same in scored if not same and low * -p <= 100 * -s <= high * -p][:negatives]
            out += [(a[0], i, r, j, -p, s) for r, (s, j) in enumerate(fits, 1)]
    return sorted(out)


def mined(spark, rows, step, clusters=None, **more):
    df = spark.createDataFrame([(i, v, label, 0, "x", 1) for i, v, label in rows], SCHEMA)
    return sorted(tuple(r) for r in hard_negatives.mine(df, F.col("vec_id") % step == 0, clusters=clusters, **more).collect())


def fixture(scale=1.0):
    r = np.random.default_rng(7)
    centres = r.normal(size=(6, 8)) * 2
    rows = [(i, (scale * (centres[i % 6] + r.normal(size=8) * r.choice([0.1, 0.6]))).tolist(), int(r.integers(4))) for i in range(260)]
    common = rows[3][1]
    rows += [(1000 + i, common, i % 3) for i in range(120)]  # a vector that a third of all rows share
    rows += [(2000, None, 1), (2001, [1.0] * 8, None), (2002, [math.nan] + [1.0] * 7, 1), (2003, [math.inf] * 8, 1), (2004, [None] + [1.0] * 7, 2), (2005, [], 1),
             (None, [1.0] * 8, 1), (2010, [0.0] * 8, 1), (2020, [0.0] * 8, 2), (2030, [1.0, 2.0], 1), (2031, [1.0, 1.0], 1), (2032, [0.6, 1.0], 2)]
    return rows + rows[:5] + [(7, rows[20][1], 3)]  # repeated rows, and an id with two vectors


@pytest.mark.parametrize("clusters,first,block", [(1, 10_000, 4096), (5, 40, 16)])
def test_against_all_pairs(spark, monkeypatch, clusters, first, block):
    monkeypatch.setattr(hard_negatives, "FIRST", first)
    monkeypatch.setattr(hard_negatives, "BLOCK", block)
    monkeypatch.setattr(hard_negatives, "ANCHORS", 16)
    monkeypatch.setattr(hard_negatives, "STEP", 8)
    got = mined(spark, fixture(), 10, clusters)
    assert got == brute(fixture(), 10, 5, 3, 50, 95) and got


def test_wide_integers_stay_exact(spark):
    got = mined(spark, fixture(3e5)[:150], 20, 3, positives=2, negatives=4, low=10, high=99)
    assert got == brute(fixture(3e5)[:150], 20, 2, 4, 10, 99) and max(r[4] for r in got) > 2**53


def test_walks_end_early_on_tight_clusters(monkeypatch):
    """Far rows are not met once a bound is below the positives found."""
    import pandas as pd
    met = []
    monkeypatch.setattr(hard_negatives, "STEP", 10)
    plain = hard_negatives.scores
    monkeypatch.setattr(hard_negatives, "scores", lambda a, b: met.append(len(b)) or plain(a, b))
    v = [[100, i % 3] for i in range(50)] + [[-100, i % 3] for i in range(450)]
    rows = pd.DataFrame({"id": range(1, 501), "label": 1, "d": 2, "packed": [hard_negatives._pack(x) for x in v], "bound": [np.hypot(*x) if x[0] > 0 else -90.0 for x in v]})
    members = pd.DataFrame({"id": [0], "mark": [5], "label": [1], "packed": [hard_negatives._pack([100, 0])], "norm": [100.0], "slots": [[{"slot": 0, "low": -(2**63) + 1, "high": 2**63 - 1}]]})
    assert hard_negatives.walk_block(rows, members, 5, True)["id"].tolist() == [1, 2, 3, 4, 5] and sum(met) <= 60


def test_empty_tables(spark):
    assert mined(spark, [], 10) == []
    assert mined(spark, [(1, [1.0, 2.0], 1)], 10) == []
