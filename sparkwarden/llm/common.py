"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from sparkwarden.session import shared_folder

CHUNK_CHARS = 1_000_000
LIGHT_CHARS = 100_000  # for steps whose workers stand beside a full executor


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch:
    """Tables of one run in the shared folder.

    ``save`` cuts lineage: what follows reads files, so a lost executor costs only its own tasks.
    ``drop`` removes a table that nothing reads any more.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/llm-{uuid.uuid4().hex}"
        self.paths: dict[int, str] = {}

    def save(self, df: DataFrame, name: str, *partition_by: str) -> DataFrame:
        path = f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"
        writer = df.write.partitionBy(*partition_by) if partition_by else df.write
        writer.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        out._scratch_path = path  # keeps the name with the frame
        return out

    def drop(self, *frames: DataFrame) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for df in frames:
            path = jvm.org.apache.hadoop.fs.Path(df._scratch_path)
            path.getFileSystem(conf).delete(path, True)


def chunks(batch: pa.RecordBatch, column: str, limit: int = CHUNK_CHARS) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts hold about ``limit`` characters; a longer text stands alone."""
    sizes = pc.fill_null(pc.utf8_length(batch.column(column)), 0).to_pylist()
    start = held = 0
    for i, k in enumerate(sizes):
        if i > start and held + k > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += k
    if start < len(sizes):
        yield batch.slice(start)


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Concatenation of ``arange(s, s + c)``."""
    counts = counts.astype(np.int64)
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts.astype(np.int64) - (ends - counts), counts) + np.arange(total, dtype=np.int64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BASE = 0x9E6C63D0876A3F35  # odd, so it has an inverse modulo 2**64
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = max(n, 2 * len(_POWERS[0]))
        for k, base in enumerate((_BASE, pow(_BASE, -1, 2**64))):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POWERS[k] = np.multiply.accumulate(p)
    return _POWERS[0], _POWERS[1]


def span_hashes(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the slices ``symbols[start:end]``, equal for equal slices wherever they stand.

    One running sum of ``symbol * base**position`` modulo 2**64 serves all slices.
    """
    power, inverse = _powers(len(symbols) + 1)
    total = np.zeros(len(symbols) + 1, np.uint64)
    np.cumsum((symbols.astype(np.uint64) + np.uint64(1)) * power[: len(symbols)], out=total[1:])
    h = (total[ends] - total[starts]) * inverse[starts]
    return mix64(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def lower_words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words ``[^\\x20\\x09-\\x0D]+`` of A-Z-lowered texts, and each text's first word index (n + 1 bounds)."""
    raw = [(t or "").encode().lower() for t in texts]
    lengths = np.array([len(r) + 1 for r in raw], dtype=np.int64)
    b = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    space = (b == 32) | ((b >= 9) & (b <= 13))
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if len(b) and not space[0]:
        edge = np.concatenate(([0], edge))
    starts, ends = edge[0::2], edge[1::2]
    bounds = np.searchsorted(starts, np.concatenate(([0], np.cumsum(lengths))))
    return span_hashes(b, starts, ends), bounds


def widened(df: DataFrame, **types: str) -> StructType:
    """The schema of a frame with further columns; the frame's own schema stays as it is."""
    return StructType([*df.schema.fields, *StructType.fromDDL(", ".join(f"`{name}` {kind}" for name, kind in types.items())).fields])


def in_order(df: DataFrame, key: str, place: str) -> DataFrame:
    """``df`` and the number of each row in the order of ``key``, from 0.

    Rows are sorted in ranges of the key and numbered there; a range starts after the rows of those before it.  Only the sizes of the
    ranges, one row each, meet in one task.
    """
    at = F.monotonically_increasing_id()  # the range in the upper bits, the row in it in the lower 33
    ranges = Scratch(df.sparkSession).save(df.repartitionByRange(key).sortWithinPartitions(key).withColumn("__at", at), "ranges")
    part = F.shiftrightunsigned("__at", 33)
    sizes = ranges.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    inside = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    return ranges.withColumn("__part", part).join(F.broadcast(starts), "__part").withColumn(place, F.col("__start") + inside).drop("__part", "__start", "__at")
