"""Centroid clustering of quantized vectors over dictionaries of their subvectors.

Vectors are cut into blocks of a few dimensions. Each chunk of vectors is stored once as,
for every block, the distinct subvectors and a code per vector, so nothing is lost. In a
round, each distinct subvector's squared distance to the same block of each centroid is
computed once for its chunk; a vector's distance is the sum of those that its codes name. New
centroids come from the same dictionaries: how often a cluster holds a code, times the
subvector. All numbers are integers, so results are exact and do not depend on partitions.

Dictionaries belong to chunks, so neither a broadcast nor the driver holds anything that
grows with the input: centroids only, and one row of sums per cluster and task are shuffled.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import Scratch

#: Quantized components beyond this are set to it, so that squared distances fit 64 bits.
LARGEST = 1 << 27


def kept(vectors: DataFrame, dims: int) -> DataFrame:
    """(vec_id, v): the vectors with exactly `dims` components, none null or non-finite."""
    v = F.col("embedding").cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.where((F.size("embedding") == dims) & finite).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))


def quantize(x: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x) as 64-bit integers, held within `LARGEST`."""
    return np.clip(np.floor(x * scale), -LARGEST, LARGEST).astype(np.int64)


def first_centroids(rows: DataFrame, k: int, scale: float, salt: str) -> list[list[int]]:
    """The `k` vectors with the smallest sha256 of `<salt><vec_id>`; ties by their components, rows without an id last."""
    mark = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256)
    # Quantized components decide ties, so that equal ones need no order.
    cells = F.transform("v", lambda x: F.floor(x * F.lit(scale)))
    picked = rows.orderBy(mark.asc_nulls_last(), cells).limit(k).select("v").collect()
    return [quantize(np.array(r["v"]), scale).tolist() for r in picked]


def encode_chunk(ids: pa.Array, x: np.ndarray, width: int) -> pa.RecordBatch:
    """A chunk as dictionaries of distinct subvectors and codes."""
    words, codes, sizes = [], [], []
    for at in range(0, x.shape[1], width):
        part = x[:, at : at + width]
        low, span = part.min(0), part.max(0) - part.min(0) + 1
        if sum(int(s).bit_length() for s in span) < 63:  # a subvector as one number, digit by digit
            key = part[:, 0] - low[0]
            for d in range(1, part.shape[1]):
                key = key * span[d] + part[:, d] - low[d]
            _, first, code = np.unique(key, return_index=True, return_inverse=True)
            found = part[first]
        else:
            found, code = np.unique(part, axis=0, return_inverse=True)
        words.append(found.tobytes())
        codes.append(code.reshape(-1).astype("<u2" if len(found) <= 1 << 16 else "<u4").tobytes())
        sizes.append(len(found))
    one = pa.array([0, len(ids)], pa.int32())
    return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(one, ids), *(pa.array([c], t.type) for c, t in zip((sizes, words, codes), list(CHUNK_ARROW)[1:]))], schema=CHUNK_ARROW)


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Chunks one by one, their arrays as they lie in memory."""
    for batch in batches:
        for k in range(batch.num_rows):
            yield {"ids": batch.column(0)[k].values, **{c: batch.column(i)[k].as_py() for i, c in ((1, "sizes"), (2, "words"), (3, "codes"))}}


CHUNK = "ids array<long>, sizes array<int>, words array<binary>, codes array<binary>"
CHUNK_ARROW = pa.schema([("ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("words", pa.list_(pa.binary())), ("codes", pa.list_(pa.binary()))])


def encode(rows: DataFrame, dims: int, width: int = 2, scale: float = 64.0, chunk: int = 32_768) -> DataFrame:
    """Chunks of up to `chunk` vectors of a partition, each with its dictionaries; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, parts, held = [], [], 0

        for batch in batches:
            for at in range(0, batch.num_rows, chunk):
                part = batch.slice(at, chunk)
                if held + part.num_rows > chunk and held:
                    yield encode_chunk(pa.concat_arrays(ids), np.concatenate(parts), width)
                    ids, parts, held = [], [], 0
                ids.append(part.column(0))
                parts.append(quantize(part.column(1).flatten().to_numpy().reshape(-1, dims), scale))
                held += part.num_rows
        if held:
            yield encode_chunk(pa.concat_arrays(ids), np.concatenate(parts), width)

    return rows.mapInArrow(run, CHUNK)


def blocks_of(row: dict, dims: int, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first dimension, distinct subvectors, codes) of each block of a chunk."""
    for k, (size, words, codes) in enumerate(zip(row["sizes"], row["words"], row["codes"])):
        wide = min(width, dims - k * width)
        yield k * width, np.frombuffer(words, np.int64).reshape(size, wide), np.frombuffer(codes, "<u2" if size <= 1 << 16 else "<u4")


def assign_chunk(row: dict, centroids: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid (the smallest number of equal ones) and squared distance of each vector of a chunk."""
    total = np.zeros((len(row["ids"]), len(centroids)), np.int64)
    for at, words, codes in blocks_of(row, centroids.shape[1], width):
        away = words[:, None, :] - centroids[None, :, at : at + words.shape[1]]
        total += np.einsum("wcd,wcd->wc", away, away)[codes]
    nearest = total.argmin(1)
    return nearest, np.take_along_axis(total, nearest[:, None], 1)[:, 0]


def sum_chunk(row: dict, nearest: np.ndarray, k: int, dims: int, width: int) -> np.ndarray:
    """Componentwise sums of each cluster's vectors: code counts times subvectors."""
    sums = np.zeros((k, dims), np.int64)
    for at, words, codes in blocks_of(row, dims, width):
        held = np.bincount(nearest * len(words) + codes, minlength=k * len(words)).reshape(k, len(words))
        sums[:, at : at + words.shape[1]] = held @ words
    return sums


def cluster(
    vectors: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: float = 64.0, salt: str = "1:", width: int = 2, chunk: int = 32_768
) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid) of every kept vector.

    `embedding` is quantized to floor(scale * x). Vectors of another length, with a null, NaN
    or infinite component, or null themselves, give no row. Rows that repeat a vec_id are
    vectors of their own; a null vec_id stays null and is the last to become a centroid. With
    fewer than `k` kept vectors there are as many centroids as vectors; an empty table gives
    no rows. Components beyond 2^27 after scaling count as 2^27. Other columns are ignored.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "subvectors")
    rows = kept(vectors, dims)
    now = np.array(first_centroids(rows, k, scale, salt), np.int64).reshape(-1, dims)
    if not len(now):
        empty = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid array<long>"
        return spark.createDataFrame([], empty)
    chunks = scratch.write(encode(rows, dims, width, scale, chunk))

    def sums(at: np.ndarray) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, count = np.zeros(at.shape, np.int64), np.zeros(len(at), np.int64)
            for row in rows_of(batches):
                nearest, _ = assign_chunk(row, at, width)
                total += sum_chunk(row, nearest, len(at), dims, width)
                count += np.bincount(nearest, minlength=len(at))
            yield pa.RecordBatch.from_pylist(
                [{"cluster": int(c), "n": int(count[c]), "total": total[c].tolist()} for c in np.flatnonzero(count)],
                pa.schema([("cluster", pa.int32()), ("n", pa.int64()), ("total", pa.list_(pa.int64()))]),
            )

        each = chunks.mapInArrow(run, "cluster int, n long, total array<long>")
        wide = each.select("cluster", "n", F.posexplode("total").alias("dim", "part"))
        return wide.groupBy("cluster", "dim").agg(F.sum("n").alias("n"), F.sum(F.col("part").cast("decimal(38,0)")).alias("part"))

    for _ in range(rounds):
        new = now.copy()
        for r in sums(now).collect():  # k * dims rows
            new[r["cluster"], r["dim"]] = int(r["part"]) // r["n"]
        now = new

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            nearest, distance = assign_chunk(row, now, width)
            yield pa.RecordBatch.from_arrays([row["ids"], pa.array(nearest.astype(np.int32)), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    found = scratch.write(chunks.mapInArrow(assign, "vec_id long, cluster int, distance long"))
    inertia = {r["cluster"]: int(r["d"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    table = [(c, inertia.get(c, 0), sum(inertia.values()), now[c].tolist()) for c in range(len(now))]
    facts = spark.createDataFrame(table, "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    return found.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")


def digest(centroid: str) -> Column:
    """sha256 of a centroid's components, joined by commas."""
    return F.sha2(F.concat_ws(",", F.transform(centroid, lambda x: x.cast("string"))), 256)
