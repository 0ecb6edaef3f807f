"""Helpers that the operators of this package share."""

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark import session

# Task code travels with the job, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules["waymark.llm"])

#: Words of the contracts: runs of characters other than ASCII white space.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"

U64 = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finalizer (splitmix64) over an array; wraps around silently."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches into runs of rows whose texts take about `max_bytes`; one long text is a run of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(text))
        sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(col), 0), dtype=np.int64)
        part = (np.cumsum(sizes) - sizes) // max_bytes
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            yield batch.slice(a, b - a)


def shingle_hashes(words: list[bytes] | list[str], size: int = 5) -> np.ndarray:
    """One 64-bit hash for each run of `size` words, in text order; a shorter text is one run, none has none."""
    import xxhash

    n = len(words)
    if not n:
        return np.empty(0, U64)
    each = np.fromiter(map(xxhash.xxh3_64_intdigest, words), U64, n)
    width = min(size, n)
    out = np.zeros(n - width + 1, U64)
    with np.errstate(over="ignore"):
        for k in range(width):
            out = (out * U64(0x9E3779B97F4A7C15) + each[k : n - width + 1 + k]) ^ (out >> U64(29))
    return mix(out + U64(width))


def lowered_words(text: str | None) -> list[bytes]:
    """Words of a whole text with A-Z in lower case (null: none)."""
    return text.encode().lower().split() if text else []


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def without(df: DataFrame, *names: str) -> DataFrame:
    """Drop columns whatever the case of their names, so that added ones cannot clash."""
    low = {n.lower() for n in names}
    return df.drop(*(c for c in df.columns if c.lower() in low))


class Scratch:
    """Tables that cut lineage, below the shared folder; `drop` removes those no longer needed.

    They survive lost executors. A result still reads the last of them, so those stay
    until the folder is cleared.
    """

    def __init__(self, spark, label: str):
        self.spark, self.root = spark, session.fresh_dir(spark, label)
        self.count = 0

    def write(self, df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count}"
        writer = df.write.option("compression", "zstd")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        jvm = self.spark.sparkContext._jvm
        for t in tables:
            path = jvm.org.apache.hadoop.fs.Path(t._scratch)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
