"""Vector and score expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkwarden.functions import fixed_values as fv
from sparkwarden.functions.text import ColumnLike, bind, col


def doubles(vec: ColumnLike) -> Column:
    return col(vec).cast("array<double>")


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(vec: Column) -> Column:
    return F.sqrt(total(F.transform(vec, lambda x: x * x)))


def cosine_distance(a: ColumnLike, b: ColumnLike) -> Column:
    """One minus the cosine; null where a vector has no length."""
    x, y = doubles(a), doubles(b)
    return F.lit(1.0) - F.try_divide(dot(x, y), norm(x) * norm(y))


def mrl_normalize(vec: ColumnLike, dims: int = 1024) -> Column:
    """First ``dims`` values scaled to length one; a zero vector stays as it is."""
    def scale(head: Column) -> Column:
        return bind(norm(head), lambda n: F.when(n == 0, head).otherwise(
            F.transform(head, lambda x: x / n)))

    return bind(F.slice(doubles(vec), 1, dims), scale)


def softmax(logits: ColumnLike) -> Column:
    def weigh(values: Column) -> Column:
        top = F.array_max(values)
        return bind(F.transform(values, lambda v: F.exp(v - top)),
                    lambda e: bind(total(e), lambda s: F.transform(e, lambda v: v / s)))

    return bind(doubles(logits), weigh)


def classify(probs: ColumnLike, labels: tuple[str, ...] = (fv.SAFE_LABEL, fv.VULNERABLE_LABEL)) -> Column:
    """Prediction struct of a probability array: argmax label, confidence and both maps."""
    p = col(probs)
    best = (F.array_position(p, F.array_max(p)) - 1).cast("int")
    names = F.array(*[F.lit(x) for x in labels])
    ids = F.transform(p, lambda _, i: i)
    return F.struct(
        F.lit(True).alias("ok"),
        F.get(names, best).alias("label"),
        best.alias("label_id"),
        F.array_max(p).alias("confidence"),
        F.map_from_arrays(names, p).alias("scores"),
        F.map_from_arrays(ids, p).alias("prob_by_label_id"),
        F.lit(None).cast("string").alias("error"),
    )
