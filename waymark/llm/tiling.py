"""Benchmark decontamination by greedy string tiling with running Karp-Rabin.

Documents and test items meet on shared seeds of five tokens. For each pair whose seeds
could cover enough of the item, the longest matches that overlap nothing marked before
are marked again and again, so passages in another order count as well; a document leaks
an item when the marked tokens reach the coverage.
"""

import heapq
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import Scratch, shingle_hashes, slices, without

SEED, COVERAGE = 5, 0.75
#: Benchmarks of up to this many tokens travel with the tasks (about 30 bytes each); larger ones are joined.
MAX_HELD_TOKENS = 2_000_000
TOKEN = re.compile(r"\w+")
LEAKS = "array<struct<item_id:{kind},coverage:double,n_tiles:int>>"
BASE, MOD = 1_000_003, (1 << 61) - 1


def tokens(text: str | None) -> list[str]:
    return TOKEN.findall(text.lower()) if text else []


def seeds(words: list[str]) -> np.ndarray:
    return shingle_hashes(words, SEED) if len(words) >= SEED else np.empty(0, np.uint64)


def _windows(words: list, marked: list[bool], size: int) -> Iterator[tuple[int, int]]:
    """(hash, begin) of each window of `size` unmarked tokens; the hash runs on by one token."""
    top = pow(BASE, size - 1, MOD)
    h = run = 0
    for i, w in enumerate(words):
        if marked[i]:
            h = run = 0
            continue
        if run == size:
            h = (h - hash(words[i - size]) * top) % MOD
            run -= 1
        h = (h * BASE + hash(w)) % MOD
        run += 1
        if run == size:
            yield h, i - size + 1


def tiles(text: list, item: list, least: int = SEED) -> list[tuple[int, int, int]]:
    """Greedy tiling: (begin in text, begin in item, length), each of `least` tokens or more."""
    in_text, in_item = [False] * len(text), [False] * len(item)
    out: list[tuple[int, int, int]] = []
    size = max(least, min(20, len(item)))
    while True:
        at: dict[int, list[int]] = {}
        for h, j in _windows(item, in_item, size):
            at.setdefault(h, []).append(j)
        queue: list[tuple[int, int, int]] = []
        for h, i in _windows(text, in_text, size):
            for j in at.get(h, ()):
                if i and j and text[i - 1] == item[j - 1] and not in_text[i - 1] and not in_item[j - 1]:
                    continue  # part of the match that begins one token earlier
                n = 0
                while i + n < len(text) and j + n < len(item) and text[i + n] == item[j + n] and not in_text[i + n] and not in_item[j + n]:
                    n += 1
                if n >= size:
                    queue.append((-n, i, j))
        longest = -min(queue, default=(0,))[0]
        if longest > 2 * size:
            size = longest
            continue
        heapq.heapify(queue)
        while queue:
            n, i, j = heapq.heappop(queue)
            n = -n
            free = [not in_text[i + k] and not in_item[j + k] for k in range(n)]
            if all(free):
                in_text[i : i + n] = in_item[j : j + n] = [True] * n
                out.append((i, j, n))
                continue
            begin = 0
            for k in range(n + 1):  # what is left of it, if still long enough
                if k == n or not free[k]:
                    if k - begin >= size:
                        heapq.heappush(queue, (begin - k, i + begin, j + begin))
                    begin = k + 1
        if size == least:
            return out
        size = max(least, size // 2)


class Bench(NamedTuple):
    """Test items and where their seeds are."""

    ids: list
    words: list[list[str]]
    seeds: np.ndarray
    item: np.ndarray
    place: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple]) -> "Bench":
        words = [tokens(t) for _, t in rows]
        each = [seeds(w) for w in words]
        flat = np.concatenate([*each, np.empty(0, np.uint64)])
        order = np.argsort(flat, kind="stable")
        item = np.repeat(np.arange(len(rows)), [len(x) for x in each])
        place = np.concatenate([*(np.arange(len(x)) for x in each), np.empty(0, np.int64)]).astype(np.int64)
        return cls([i for i, _ in rows], words, flat[order], item[order], place[order])

    def leaks(self, text: str | None, coverage: float) -> list[dict]:
        words = tokens(text)
        mine = seeds(words)
        if not len(mine) or not len(self.seeds):
            return []
        lo = np.searchsorted(self.seeds, mine)
        n = np.searchsorted(self.seeds, mine, "right") - lo
        if not n.any():
            return []
        here = np.repeat(np.arange(len(mine)), n)
        there = np.repeat(lo, n) + np.arange(len(here)) - np.repeat(np.cumsum(n) - n, n)
        item, place = self.item[there], self.place[there]
        out = []
        for k in np.unique(item).tolist():
            got = tile_pair(words, self.words[k], here[item == k], place[item == k], coverage)
            if got:
                out.append({"item_id": self.ids[k], "coverage": got[0], "n_tiles": got[1]})
        return out


def covered(places: np.ndarray, length: int) -> np.ndarray:
    """Which of `length` tokens a seed at one of `places` covers."""
    mark = np.zeros(length + 1, np.int64)
    np.add.at(mark, places, 1)
    np.add.at(mark, places + SEED, -1)
    return np.cumsum(mark[:-1]) > 0


def tile_pair(words: list[str], item: list[str], here: np.ndarray, place: np.ndarray, coverage: float) -> tuple[float, int] | None:
    """(coverage, tiles) if they reach `coverage`. No tile goes beyond shared seeds, which bounds it from above."""
    need = coverage * len(item)
    if covered(np.unique(place), len(item)).sum() < need:
        return None
    at = np.flatnonzero(covered(np.unique(here), len(words)))
    part: list = []
    for a, b in zip(at, [*at[1:], -1]):
        part.append(words[a])
        if b != a + 1:
            part.append(None)  # equals no token
    found = tiles(part, item)
    total = sum(n for _, _, n in found)
    return (total / len(item), len(found)) if total >= need else None


def _held(docs: DataFrame, bench: Bench, kind: str, coverage: float) -> DataFrame:
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    target = pa.list_(pa.struct([("item_id", _arrow(kind)), ("coverage", pa.float64()), ("n_tiles", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            got = [bench.leaks(t, coverage) for t in part.column(part.schema.get_field_index("text")).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(got, target)], names=[*part.schema.names, "leaks"])

    return docs.mapInArrow(run, f"{schema}, leaks {LEAKS.format(kind=kind)}")


def _arrow(kind: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]


def _seed_rows(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(seed, *keys, place) of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            each = [seeds(tokens(t)) for t in part.column(part.num_columns - 1).to_pylist()]
            at = pa.array(np.repeat(np.arange(part.num_rows), [len(x) for x in each]))
            flat = np.concatenate([*each, np.empty(0, np.uint64)]).astype(np.int64)
            place = np.concatenate([*(np.arange(len(x)) for x in each), np.empty(0, np.int64)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(flat), *(part.column(i).take(at) for i in range(len(keys))), pa.array(place)], names=["seed", *keys, "place"])

    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    return rows.select(*keys, "text").mapInArrow(run, f"seed long, {kinds}, place int")


def _joined(docs: DataFrame, benchmark: DataFrame, kind: str, coverage: float) -> DataFrame:
    """The same by joins: seeds, then the bound on coverage, then the tiling of what is left.

    A document is a (doc_id, hash of the text), an item an (item_id, hash of the text), so
    each text is judged on its own, as in `_held`.
    """
    scratch = Scratch(docs.sparkSession, "tiling")
    doc, item = ["doc_id", "doc_mark"], ["item_id", "item_mark"]
    items = benchmark.select("item_id", F.xxhash64("text").alias("item_mark"), "text")
    texts = docs.where("text is not null").select("doc_id", F.xxhash64("text").alias("doc_mark"), "text")
    theirs = scratch.write(_seed_rows(items, item))
    mine = _seed_rows(texts, doc).join(theirs.select("seed").distinct(), "seed", "left_semi").select("seed", *doc).distinct()
    pairs = mine.join(theirs, "seed").groupBy(*doc, *item).agg(F.count("*").alias("n"))
    sizes = theirs.groupBy(*item).agg((F.max("place") + SEED).alias("size"))
    # n seeds cover SEED * n tokens at most; tile_pair has the exact bound.
    near = pairs.join(sizes, item).where(F.col("n") * SEED >= coverage * F.col("size")).select(*doc, *item)
    near = scratch.write(near.join(items.withColumnRenamed("text", "item_text"), item).select(F.col("doc_id").alias("_id"), F.col("doc_mark").alias("_mark"), "item_id", "item_text"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("doc_mark") == F.col("_mark"))
    both = near.join(texts.dropDuplicates(doc), same).select(*doc, "item_id", "item_text", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            out = []
            for i, (of, of_text, text) in enumerate(zip(*(part.column(k).to_pylist() for k in (2, 3, 4)))):
                out += [(i, x["coverage"], x["n_tiles"]) for x in Bench.of([(of, of_text)]).leaks(text, coverage)]
            at = pa.array([r[0] for r in out], pa.int64())
            found = [pa.array([r[1] for r in out], pa.float64()), pa.array([r[2] for r in out], pa.int32())]
            yield pa.RecordBatch.from_arrays([*(part.column(k).take(at) for k in range(4)), *found], names=names)

    names = ["_id", "_mark", "item_id", "item_text", "coverage", "n_tiles"]
    doc_kind = docs.schema["doc_id"].dataType.simpleString()
    found = both.mapInArrow(run, f"_id {doc_kind}, _mark long, item_id {kind}, item_text string, coverage double, n_tiles int")
    # In the order of `_held`: by item_id, then by the item's text.
    leaks = F.sort_array(F.collect_list(F.struct("item_id", "item_text", "coverage", "n_tiles")))
    found = found.groupBy("_id", "_mark").agg(F.transform(leaks, lambda x: F.struct(x["item_id"].alias("item_id"), x["coverage"].alias("coverage"), x["n_tiles"].alias("n_tiles"))).alias("leaks"))
    out = docs.withColumn("doc_mark", F.xxhash64("text")).join(found, same, "left")
    return out.withColumn("leaks", F.coalesce("leaks", F.array().cast(LEAKS.format(kind=kind)))).select(*docs.columns, "leaks")


def find_leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, max_held_tokens: int = MAX_HELD_TOKENS) -> DataFrame:
    """Adds `leaks`, array of (item_id, coverage, n_tiles) by item_id, to each row of `docs`.

    Tokens are runs of letters, digits and underscores in lower case. Items of fewer than
    five tokens, null items and null texts match nothing; empty tables give empty arrays.
    Repeated rows get equal answers; repeated benchmark rows count once. A benchmark beyond
    `max_held_tokens` is joined instead of shipped; results are the same. A column `leaks`
    in the input is replaced.
    """
    base = without(docs, "leaks")
    items = benchmark.select("item_id", "text").where("item_id is not null and text is not null").distinct()
    kind = items.schema["item_id"].dataType.simpleString()
    # A token takes two characters at least, with what parts it from the next.
    total = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"]
    if total <= 2 * max_held_tokens:
        rows = sorted((r["item_id"], r["text"]) for r in items.collect())  # bounded by the check above
        return _held(base, Bench.of(rows), kind, coverage)
    return _joined(base, items, kind, coverage)


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """`docs` without those that leak an item."""
    return find_leaks(docs, benchmark, **options).where(F.size("leaks") == 0).drop("leaks")
