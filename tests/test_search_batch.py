"""Many query vectors at once against one query at a time."""

import random

import pytest

from sparkwarden.operators import search


@pytest.mark.parametrize("block,query_block", [(4096, 1024), (7, 3)])
def test_batch_equals_single_queries(spark, block, query_block):
    r = random.Random(2)
    rows = [(i, [r.gauss(0, 1) for _ in range(4)]) for i in range(60)]
    rows += [(100 + i, rows[i][1]) for i in range(20)]  # ties
    rows += [(200, [0.0] * 4), (201, None), (202, [2 * x for x in rows[5][1]])]
    vectors = spark.createDataFrame(rows, "id long, embedding array<double>")
    asked = [rows[0], rows[5], rows[30], (200, [0.0] * 4)]
    queries = spark.createDataFrame(asked, "query_id long, embedding array<double>")
    got = {}
    for x in search.vector_topk_batch(vectors, queries, 25, block=block, query_block=query_block).collect():
        got.setdefault(x.query_id, []).append((x["rank"], x.id, None if x.distance is None else round(x.distance, 9)))
    for q, v in asked:
        want = [(x["rank"], x.id, None if x.distance is None else round(x.distance, 9)) for x in search.vector_topk(vectors, v, 25).collect()]
        assert [w[2] for w in sorted(want)] == [g[2] for g in sorted(got[q])]
        # distances that differ by rounding only may change places
        assert {w[1] for w in want if w[2] != sorted(want)[-1][2]} <= {g[1] for g in got[q]}


def test_nothing_asked(spark):
    vectors = spark.createDataFrame([(1, [1.0])], "id long, embedding array<double>")
    queries = spark.createDataFrame([], "query_id long, embedding array<double>")
    assert search.vector_topk_batch(vectors, queries).count() == 0
