"""Pairing a set of queries with a large table on a non-equality condition.

The queries are broadcast in slices of checked size, so the large table is never shuffled
and no wide row is copied; it is read once for each slice. Slices are independent: each
query is in one, so cuts per query hold within a slice.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.session import union_all

#: Queries of a slice, and the bytes of their texts: what is broadcast stays below a few times as much.
BROADCAST_QUERIES = 20_000
BROADCAST_BYTES = 16 << 20


def count_slices(n: int, n_bytes: int, most: int | None = None, most_bytes: int | None = None) -> int:
    """Slices that `n` queries with texts of `n_bytes` need."""
    return max(1, -(-n // (most or BROADCAST_QUERIES)), -(-n_bytes // (most_bytes or BROADCAST_BYTES)))


def slices(queries: DataFrame, small: bool | None = None, key: str = "qid", most: int | None = None, most_bytes: int | None = None) -> list[DataFrame]:
    """The query set in parts of about `most` rows or `most_bytes` of text, by a hash of `key`.

    Without them, `BROADCAST_QUERIES` and `BROADCAST_BYTES`. `small` passes a size check already made.
    """
    if small:
        return [queries]
    texts = [F.coalesce(F.octet_length(c), F.lit(0)) for c, kind in queries.dtypes if kind == "string"]
    size = queries.agg(F.count("*").alias("n"), F.coalesce(F.sum(sum(texts, F.lit(0))), F.lit(0)).alias("bytes")).first()
    n = count_slices(size["n"], size["bytes"], most, most_bytes)
    return [queries] if n == 1 else [queries.filter(F.pmod(F.xxhash64(key), F.lit(n)) == i) for i in range(n)]


def pair_by_mask(
    big: DataFrame,
    queries: DataFrame,
    big_mask: str,
    query_mask: str,
    condition: Column,
    small: bool | None = None,
) -> DataFrame:
    """Rows of `big` x queries whose mask is covered, and `condition` holds.

    The two sides must not share column names.
    """
    covered = F.col(big_mask).bitwiseAND(F.col(query_mask)) == F.col(query_mask)
    return union_all(big.join(F.broadcast(part), covered & condition) for part in slices(queries, small))


def pair_by_substring(
    big: DataFrame,
    queries: DataFrame,
    texts: list[str],
    query_text: str,
    condition: Column,
    small: bool | None = None,
) -> DataFrame:
    """Rows of `big` x queries where any of `texts` contains the query."""
    inside = F.lit(False)
    for t in texts:
        inside = inside | F.coalesce(F.contains(F.col(t), F.col(query_text)), F.lit(False))
    return union_all(big.join(F.broadcast(part), inside & condition) for part in slices(queries, small))
