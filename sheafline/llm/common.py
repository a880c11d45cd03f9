"""What the operators of this subpackage share: stored intermediates and text columns."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import shared

#: Bytes in a batch of rows that a Python task gets.
ARROW_BYTES = 4_000_000


#: Folders written in the innermost ``scratch`` block, or None outside of one.
_open: list[str] | None = None


def new_path(spark: SparkSession, name: str) -> str:
    path = shared.new_path(spark, name)
    if _open is not None:
        _open.append(path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again.

    Cuts the lineage: later stages reread the files if an executor is lost.
    """
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def forget(spark: SparkSession, *paths: str) -> None:
    """Deletes stored tables that no frame reads any more."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """At the end of the block, tables stored in it go, but for those appended to its list.

    What else the block made must not be used afterwards.
    """
    global _open
    outer, _open, kept = _open, [], []
    try:
        yield kept
    finally:
        mine, _open = _open, outer
        keep = {x.stored_at for x in kept}
        forget(spark, *(x for x in mine if x not in keep))
        if outer is not None:
            outer.extend(x for x in mine if x in keep)


def small_batches(spark: SparkSession) -> None:
    """Has Spark hand Python tasks a few MB at a time, however long the texts are."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc32_of_id(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary"))


def piece_of(text: Column, chars: int) -> Column:
    """``text``, or a piece of ``chars`` code points of a longer one, at a place set by its hash."""
    start = F.pmod(F.xxhash64(text), F.greatest(F.length(text) - chars, F.lit(1))) + 1
    return F.when(F.length(text) <= chars, text).otherwise(F.substring(text, start.cast("int"), F.lit(chars)))


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The texts of a batch; null counts as empty."""
    return [x or "" for x in batch.column(name).to_pylist()]


def grouped(texts: list, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of neighbours whose lengths add up to about ``limit``."""
    start = total = 0
    for i, x in enumerate(texts):
        total += len(x) + 1
        if total >= limit:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over 64 bits."""
    x = np.asarray(x, np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Odd base of the rolling hash, and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
UNBASE = pow(BASE, -1, 1 << 64)


class RollingHash:
    """Hashes of any substring of a byte array in constant time, modulo 2**64."""

    _powers = np.ones(1, np.uint64)
    _unpowers = np.ones(1, np.uint64)
    _bytes = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def __init__(self, data: np.ndarray) -> None:
        n = len(data) + 1
        cls = RollingHash
        if len(cls._powers) < n:
            with np.errstate(over="ignore"):
                size = max(n, 1 << 16)
                for name, base in (("_powers", BASE), ("_unpowers", UNBASE)):
                    x = np.full(size, base, np.uint64)
                    x[0] = 1
                    setattr(cls, name, np.cumprod(x, dtype=np.uint64))
        self.unpowers = cls._unpowers
        self.sums = np.zeros(n, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(cls._bytes[data] * cls._powers[: n - 1], out=self.sums[1:])

    def all_of(self, k: int) -> np.ndarray:
        """The hash of every ``k`` neighbouring bytes, by start."""
        n = len(self.sums) - k
        if n <= 0:
            return np.zeros(0, np.uint64)
        with np.errstate(over="ignore"):
            return mix64((self.sums[k:] - self.sums[:-k]) * self.unpowers[:n])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix64((self.sums[end] - self.sums[start]) * self.unpowers[start])
