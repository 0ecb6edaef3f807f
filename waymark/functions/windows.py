"""Grams and windows of many texts at once, as arrays inside tasks.

The code points of a run of texts are one array; what a place of it needs is computed for
all places together, and only what was found leaves as rows.
"""

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Task code travels with the job, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

U64 = np.uint64
#: Bytes of text that a task holds as arrays at once; each takes about fifty.
RUN_BYTES = 2 << 20
#: A gram is one code point and up to two that follow.
GRAM = 3


def runs(batches: Iterator[pa.RecordBatch], sizes: str, most: int = RUN_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches into runs of rows whose `sizes` sum to about `most`; a larger row is a run of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        each = np.asarray(batch.column(sizes), dtype=np.int64)
        part = (np.cumsum(each) - each) // most
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            yield batch.slice(a, b - a)


def code_points(texts: pa.Array) -> np.ndarray:
    """The code points of all `texts`, one after another; a null has none."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    bounds = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = memoryview(texts.buffers()[2] or b"")[bounds[0] : bounds[-1]]
    plain = np.frombuffer(data, np.uint8)
    if plain.max(initial=0) < 128:
        return plain
    return np.frombuffer(str(data, "utf-8").encode("utf-32-le"), np.uint32)


def alphabet_of(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct `codes` in order, and a table that gives each code its place, from 1; others have 0."""
    seen = np.zeros(int(codes.max(initial=0)) + 2, bool)
    seen[codes] = True
    return np.flatnonzero(seen), np.where(seen, np.cumsum(seen), 0).astype(U64)


# ------------------------------------------------------------------------ grams


def _gram_lists(texts: pa.Array, row: np.ndarray, ids: np.ndarray, range_bits: int) -> Iterator[pa.RecordBatch]:
    """(gram, part, ids) of one run: `row` is the row of each text, `ids` the ids of the rows in order."""
    codes, sizes = code_points(texts), np.asarray(pc.utf8_length(pc.fill_null(texts, "")), dtype=np.int64)
    if not len(codes):
        return
    alphabet, places = alphabet_of(codes)
    bits, row_bits = U64(len(alphabet).bit_length()), U64(len(ids).bit_length())
    if GRAM * int(bits) + int(row_bits) > 64:  # a great many different characters: in halves
        mid = len(ids) // 2
        for low, high in ((0, mid), (mid, len(ids))):
            mine = (row >= low) & (row < high)
            yield from _gram_lists(texts.filter(pa.array(mine)), row[mine] - low, ids[low:high], range_bits)
        return
    digits = places[codes]
    # A place without two others after it starts no gram, but a text of one or two characters is one.
    starts, ends = np.cumsum(sizes) - sizes, np.cumsum(sizes)
    whole = np.ones(len(codes), bool)
    whole[ends[sizes > 0] - 1] = False
    whole[ends[sizes > 1] - 2] = False
    at = np.flatnonzero(whole)
    row_at = np.repeat(row, sizes).astype(U64)
    grams = ((((digits[at] << bits) | digits[at + 1]) << bits) | digits[at + 2]) << row_bits | row_at[at]
    short = np.flatnonzero((sizes > 0) & (sizes < GRAM))
    second = np.where(sizes[short] == 2, digits[np.minimum(starts[short] + 1, len(codes) - 1)], U64(0))
    few = (((digits[starts[short]] << bits) | second) << bits) << row_bits | row[short].astype(U64)
    pairs = np.concatenate([grams, few])
    pairs.sort()
    pairs = pairs[np.diff(pairs, prepend=~pairs[:1]) != 0]
    gram, of = pairs >> row_bits, ids[(pairs & ((U64(1) << row_bits) - U64(1))).astype(np.int64)]
    part = of >> range_bits
    first = np.flatnonzero((np.diff(gram, prepend=~gram[:1]) != 0) | (np.diff(part, prepend=part[:1]) != 0))
    each = np.stack([gram[first] >> (bits + bits), (gram[first] >> bits) & ((U64(1) << bits) - U64(1)), gram[first] & ((U64(1) << bits) - U64(1))], axis=1).astype(np.int64)
    lengths = (each > 0).sum(axis=1)
    letters = np.concatenate([[0], alphabet])[each].astype("<u4").tobytes().decode("utf-32-le")
    named = pa.array([letters[GRAM * i : GRAM * i + n] for i, n in enumerate(lengths.tolist())], pa.string())
    places_of = pa.array((of & ((1 << range_bits) - 1)).astype(np.int16))
    lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(of)).astype(np.int32)), places_of)
    yield pa.RecordBatch.from_arrays([named, pa.array(part[first]), lists], names=["gram", "part", "ids"])


def gram_lists(rows: DataFrame, row_id: str, texts: Column, range_bits: int) -> DataFrame:
    """(gram, part, ids) of `rows`: the ids, less the start of their range, that have a gram in their array `texts`.

    The distinct grams of a text are all its runs of three characters; one of one or two
    characters is a gram itself. Several lists of one gram and range come out, one for each
    run of rows that a task takes together: few where rows come in the order of their ids.
    """

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in runs(batches, "size"):
            ids, lists = np.asarray(run.column("id"), dtype=np.int64), run.column("texts")
            order = np.argsort(ids, kind="stable")
            rank = np.empty(len(ids), np.int64)
            rank[order] = np.arange(len(ids))
            sizes = np.asarray(pc.fill_null(pc.list_value_length(lists), 0), dtype=np.int64)
            yield from _gram_lists(lists.flatten(), np.repeat(rank, sizes), ids[order], range_bits)

    size = F.aggregate("texts", F.lit(0).cast("bigint"), lambda a, t: a + F.coalesce(F.octet_length(t), F.lit(0)))
    known = rows.select(F.col(row_id).cast("bigint").alias("id"), F.transform(texts, F.make_valid_utf8).alias("texts"))
    sized = known.filter("id is not null and texts is not null").select("id", "texts", size.alias("size"))
    return sized.mapInArrow(take, "gram string, part bigint, ids array<smallint>")


# ---------------------------------------------------------------------- windows


def window_keys(digits: np.ndarray, size: int, base: int, hashed: bool) -> np.ndarray:
    """A number for each window of `size` digits: the number they write in `base`, or a hash of them, `base` its odd factor."""
    with np.errstate(over="ignore"):
        out, width, factor = digits, 1, U64(base)
        for bit in bin(size)[3:]:
            n = max(0, len(digits) - 2 * width + 1)
            out = out[:n] * factor + out[width : width + n]
            width, factor = 2 * width, factor * factor
            if hashed:
                out ^= out >> U64(32)
            if bit == "1":
                n = max(0, len(digits) - width)
                out = out[:n] * U64(base) + digits[width : width + n]
                width, factor = width + 1, factor * U64(base)
        return out


class KeyTable:
    """Finds keys among distinct `wanted` ones: one look into a table, a search for the few that share a cell."""

    def __init__(self, wanted: np.ndarray):
        self.wanted, n = wanted, len(wanted)
        self.shift = U64(64 - max(8, (4 * n).bit_length()))
        cell, mine = self.cell(wanted), np.arange(n, dtype=np.int32)
        self.first = np.zeros(1 << (64 - int(self.shift)), np.int32)
        self.first[cell] = mine
        rest = np.flatnonzero(self.first[cell] != mine)
        self.rest = rest[np.argsort(wanted[rest])]
        self.shared = np.zeros(len(self.first), bool)
        self.shared[cell[rest]] = True

    def cell(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (keys * U64(0x9E3779B97F4A7C15)) >> self.shift

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in `keys` that hold a wanted key, and which; in no order."""
        cell = self.cell(keys)
        which = self.first[cell]
        same = self.wanted[which] == keys
        at = np.flatnonzero(same)
        if not len(self.rest):
            return at, which[at]
        more = np.flatnonzero(self.shared[cell] & ~same)
        there = np.searchsorted(self.wanted[self.rest], keys[more])
        which_more = self.rest[np.minimum(there, len(self.rest) - 1)]
        hit = self.wanted[which_more] == keys[more]
        return np.concatenate([at, more[hit]]), np.concatenate([which[at], which_more[hit].astype(np.int32)])


class Texts:
    """Distinct texts to find, not empty and without line breaks; one number for each window of a length tells them apart."""

    def __init__(self, texts: pa.Array):
        sizes = np.asarray(pc.utf8_length(texts), dtype=np.int64)
        codes, starts = code_points(texts), np.cumsum(sizes) - sizes
        self.alphabet, self.places = alphabet_of(codes)
        base, digits = len(self.alphabet) + 1, self.places[codes]
        self.tables: list[tuple[int, int, bool, np.ndarray, np.ndarray, KeyTable]] = []
        for size in np.unique(sizes).tolist():
            mine = np.flatnonzero(sizes == size)
            each = digits[starts[mine][:, None] + np.arange(size)]
            # Numbers too large for 64 bits are hashed, by a factor that tells all the texts apart.
            hashed = base**size > 1 << 64
            tries = np.random.default_rng(size)
            while True:
                factor = int(tries.integers(1 << 62)) * 2 + 1 if hashed else base
                keys = window_keys(each.reshape(-1), size, factor, hashed)[::size]
                if not hashed or len(np.unique(keys)) == len(keys):
                    break
            self.tables.append((size, factor, hashed, mine, each if hashed else each[:0], KeyTable(keys)))

    def find(self, codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places, texts) of all occurrences, a pair of arrays for each length."""
        digits = self.places[np.minimum(codes, len(self.places) - 1)]
        for size, factor, hashed, mine, each, table in self.tables:
            at, which = table.find(window_keys(digits, size, factor, hashed))
            for k in range(size if hashed else 0):
                same = digits[at + k] == each[which, k]
                at, which = at[same], which[same]
            yield at, mine[which]


def _held(text: pa.Array, n_lines: np.ndarray, wanted: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, line of the row, text), distinct, of texts whose lines all end in a line break."""
    codes = code_points(text)
    line_at = np.cumsum(codes == 10, dtype=np.int32)
    found = [(line_at[at].astype(np.int64) << 32) | which for at, which in wanted.find(codes)]
    pairs = np.concatenate([*found, np.empty(0, np.int64)])
    pairs.sort()
    pairs = pairs[np.diff(pairs, prepend=-1) != 0]
    line = pairs >> 32
    row = np.repeat(np.arange(len(n_lines)), n_lines)[line]
    return row, line - (np.cumsum(n_lines) - n_lines)[row], pairs & 0xFFFFFFFF


def find_in_lines(rows: DataFrame, lines: str, low: Column, texts: pa.Table) -> DataFrame:
    """`rows` with `found_at` and `found`: the place in `lines`, from 0, and the number of each of `texts` (n, q_low) that it holds.

    `low` is what is searched of each line, an array as long as `lines` without nulls or line
    breaks. One look at a window of a text's length tells whether it is one of the texts, so
    the time does not grow with their count.
    """
    numbers, each = texts.column("n").to_numpy(), texts.column("q_low").combine_chunks()
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    kept = rows.columns

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = Texts(each)
        for run in runs(batches, "_size"):
            n_lines = np.asarray(pc.list_value_length(run.column(lines)), dtype=np.int64)
            row, at, which = _held(run.column("_low"), n_lines, wanted)
            ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=run.num_rows))]).astype(np.int32))
            both = (pa.ListArray.from_arrays(ends, pa.array(x)) for x in (at.astype(np.int32), numbers[which]))
            yield pa.RecordBatch.from_arrays([*(run.column(c) for c in kept), *both], names=[*kept, "found_at", "found"])

    text = F.array_join(F.transform(low, lambda x: F.concat(x, F.lit("\n"))), "")
    sized = rows.select("*", text.alias("_low")).select("*", F.octet_length("_low").alias("_size"))
    return sized.mapInArrow(take, f"{kinds}, found_at array<int>, found array<bigint>")
