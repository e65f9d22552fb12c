"""Match positions take time in proportion to the number of matches."""

import re
import time

from pyspark.sql import functions as F
from sparkwarden.functions.runs import match_positions, match_spans, running
from sparkwarden.functions.text import lines_of


def places(text, pattern):
    return match_positions(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))


def test_positions_against_brute_force(spark):
    texts = ["", "a1\n22 b\n\n3é4", "1\n" * 130 + "x 5", "👍7\n👍 8", "99"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for i, got in df.select("i", places(F.col("t"), "[0-9\n]+").alias("m")).collect():
        want = [(m.start(), texts[i].count("\n", 0, m.start()) + 1, m.start() - texts[i].rfind("\n", 0, m.start()), m.group())
                for m in re.finditer("[0-9\n]+", texts[i])]
        assert [tuple(x) for x in got] == want


def test_running_over_many_blocks(spark):
    n = 10_000
    got = spark.range(1).select(running(F.sequence(F.lit(1).cast("long"), F.lit(n).cast("long"))).alias("r")).first()[0]
    assert got == [i * (i + 1) // 2 for i in range(n)]


def test_spans_of_null(spark):
    assert spark.sql("SELECT CAST(NULL AS STRING) AS t").select(match_spans(F.col("t"), "x").alias("s")).first()[0] == []


def test_four_times_the_matches_take_about_four_times(spark):
    def seconds(n):
        df = spark.range(1).select(F.repeat(F.lit("ab 1\n"), n).alias("t")).cache()
        df.count()
        best = 1e9
        for _ in range(3):
            start = time.time()
            df.select(F.size(places(F.col("t"), "[0-9]"))).write.format("noop").mode("overwrite").save()
            best = min(best, time.time() - start)
        return best

    seconds(1000)
    assert seconds(64_000) < 6 * seconds(16_000) + 1


def test_running_at_the_size_of_a_block(spark):
    for n in (0, 1, 47, 48, 49, 97):
        df = spark.range(1).select(F.sequence(F.lit(1).cast("long"), F.lit(n).cast("long")) if n else F.array().cast("array<bigint>")).toDF("v")
        assert df.select(running(F.col("v")).alias("r")).first()[0] == [i * (i + 1) // 2 for i in range(n)]


def test_lines_of_any_line_end(spark):
    texts = ["", "\n", "a", "a\n", "a\n\n", "a\r\n", "a\r\nb", "a\rb\n", "a\nb\r\n", "é\n👍", None]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(lines_of("t").alias("x")).collect()
    want = [[], [""], ["a"], ["a"], ["a", ""], ["a"], ["a", "b"], ["a\rb"], ["a", "b"], ["é", "👍"], None]
    assert [r["x"] for r in got] == want
