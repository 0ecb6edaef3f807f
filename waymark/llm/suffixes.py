"""Removal of repeated byte strings by difference-cover suffix sorting.

A string of `LENGTH` bytes that also starts earlier (smaller doc_id, or earlier in the
document) is repeated; every byte that such a string covers goes.

1. Each window of LENGTH bytes has an anchor: the least hash of the runs of `RUN` bytes in
   it. Equal windows have equal anchors, so windows whose anchor occurs once are done, and
   neighbouring windows of one anchor form a segment, which is repeated as a whole if its
   bytes occurred before. This leaves the segments that share an anchor, but differ.
2. Those are sorted by the difference-cover method: triples at positions 1 and 2 modulo 3
   are sorted and named, their suffixes ranked by recursion on the names, the remaining
   suffixes sorted by first byte and rank, and both merged. Adjacent suffixes that agree
   on LENGTH bytes are equal windows. Spark deals the segments out by anchor, so equal
   windows meet in one task, which sorts the segments of many anchors together.
3. An anchor with more than `MANY` different segments could outgrow a task; its windows are
   grouped by their bytes instead, pre-aggregated.
"""

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import U64, Scratch, mix, slices, text_or_empty

LENGTH, RUN = 100, 40
#: Different segments of an anchor that one task takes.
MANY = 2_000
#: Bytes that a task sorts at once, and in all.
BATCH, SHARE = 1 << 20, 8 << 20
BLOCK = 1 << 20
#: Bytes of short texts that are cut into segments at once.
TOGETHER = 1 << 15


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Suffixes of `t` (integers of 1 or more) in order, by the difference cover {1, 2} modulo 3."""
    n = len(t)
    if n < 4:
        return np.array(sorted(range(n), key=lambda i: t[i:].tolist()), np.int64)
    if int(t.max()) < 4 * n + 512:
        seen = np.zeros(int(t.max()) + 1, np.int64)
        seen[t] = 1
        p = np.r_[np.cumsum(seen)[t], 0, 0, 0]
    else:
        p = np.r_[np.unique(t, return_inverse=True)[1] + 1, 0, 0, 0].astype(np.int64)
    top, wide = int(p.max()) + 1, n + 4
    # One more sample position than positions at 1 mod 3 keeps the halves of the names apart.
    one, two = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    sample = np.r_[one, two]
    pair = p[:-1] * top + p[1:]  # every two symbols; named where the keys below would not fit otherwise
    if top * top * max(top, wide) >= 2**63:
        pair = np.unique(pair, return_inverse=True)[1].astype(np.int64)
    name = np.unique(pair[sample] * top + p[sample + 2], return_inverse=True)[1].astype(np.int64) + 1
    if int(name.max()) < len(sample):
        order = suffix_array(name)
    else:
        order = np.argsort(name, kind="stable")
    rank = np.zeros(n + 3, np.int64)
    rank[sample[order]] = np.arange(1, len(sample) + 1)
    rank[n:] = 0
    zero = np.arange(0, n, 3)
    zero = zero[np.argsort(p[zero] * wide + rank[zero + 1])]
    # Where each remaining suffix goes among the samples of either kind.
    samples = sample[order]
    samples = samples[samples < n]
    ones, twos = samples[samples % 3 == 1], samples[samples % 3 == 2]
    at = np.searchsorted(p[ones] * wide + rank[ones + 1], p[zero] * wide + rank[zero + 1])
    at = at + np.searchsorted(pair[twos] * wide + rank[twos + 2], pair[zero] * wide + rank[zero + 2])
    out = np.empty(n, np.int64)
    place = np.arange(len(zero)) + at
    free = np.ones(n, bool)
    free[place] = False
    out[place], out[free] = zero, samples
    return out


def repeated_windows(texts: list[bytes], length: int = LENGTH) -> np.ndarray:
    """For the joined `texts`: whether the window that begins at a byte lies in one text and also begins earlier."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    flat = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum(sizes)
    # A different symbol behind each text keeps matches inside.
    t = np.insert(flat.astype(np.int64) + 1, ends, 257 + np.arange(len(texts)))
    origin = np.insert(np.arange(len(flat)), ends, -1)
    left = np.insert(np.repeat(ends, sizes) - np.arange(len(flat)), ends, 0)
    order = suffix_array(t)
    order = origin[order[left[order] >= length]]
    out = np.zeros(len(flat), bool)
    if len(order) < 2:
        return out
    # Eight bytes at a time; the last ones overlap.
    padded, step = np.r_[flat, np.zeros(8, np.uint8)], min(8, length)
    eight = np.lib.stride_tricks.as_strided(padded, (len(flat), step), (1, 1))
    same = np.ones(len(order) - 1, bool)
    for k in sorted({*range(0, length - step + 1, step), length - step}, reverse=True):
        on = np.flatnonzero(same)
        same[on] = (eight[order[on] + k] == eight[order[on + 1] + k]).all(1)
    group = np.r_[0, np.cumsum(~same)]
    first = np.full(group[-1] + 1, len(flat))
    np.minimum.at(first, group, order)
    out[order] = order != first[group]
    return out


#: Hash of each byte.
OF_BYTE = mix(np.arange(1, 257, dtype=U64))


def run_hashes(block: bytes, run: int = RUN) -> np.ndarray:
    """A 64-bit hash of the `run` bytes from each place on."""
    x = np.frombuffer(block, np.uint8)
    n = len(x)
    with np.errstate(over="ignore"):
        level, size, h, done = OF_BYTE[x], 1, None, 0
        while True:
            if run & size:
                h = level.copy() if h is None else mix(h[: n - done - size + 1] * U64(0xD6E8FEB86659FD93) + level[done : n - size + 1])
                done += size
            if done == run:
                break
            level = mix(level[: n - 2 * size + 1] * U64(0x9E3779B97F4A7C15) + level[size:])
            size *= 2
    return h


def _segments(block: bytes, starts: np.ndarray, stops: np.ndarray, length: int, run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, begin, windows) of each segment of the texts that lie in a block from `starts` to `stops`, side by side."""
    if len(block) < length:
        return np.empty(0, U64), np.empty(0, np.int64), np.empty(0, np.int64)
    h = run_hashes(block, run)
    count, width = len(block) - length + 1, length - run + 1
    grid = np.r_[h, np.full(-len(h) % width, 2**64 - 1, U64)].reshape(-1, width)
    after = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].ravel()
    before = np.minimum.accumulate(grid, 1).ravel()
    least = np.minimum(after[:count], before[width - 1 : width - 1 + count])
    # The place of the anchor changes where a lesser hash comes in and where it goes out. Within
    # a segment it stays, so no two windows of a segment are equal.
    cut = np.r_[True, (least[1:] != least[:-1]) | (h[: count - 1] == least[:-1]), True]
    # Windows across texts form segments of their own, which go.
    inside = np.zeros(count + 1, np.int64)
    holds = stops - starts >= length
    first, behind = starts[holds], stops[holds] - length + 1
    np.add.at(inside, first, 1)
    np.add.at(inside, behind, -1)
    cut[first], cut[behind] = True, True
    edge = np.flatnonzero(cut)
    begin, windows = edge[:-1], np.diff(edge)
    mine = np.cumsum(inside)[begin] > 0
    return least[begin[mine]], begin[mine], windows[mine]


def segments(block: bytes, length: int = LENGTH, run: int = RUN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, begin, windows) of each segment of a block of at least `length` bytes."""
    return _segments(block, np.zeros(1, np.int64), np.array([len(block)]), length, run)


def blocks(data: bytes) -> Iterator[tuple[int, bytes]]:
    """Windows of a long text, some at a time."""
    for a in range(0, len(data) - LENGTH + 1, BLOCK):
        yield a, data[a : a + BLOCK + LENGTH - 1]


def _together(texts: list[str]) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, starts, places, begins): blocks of some texts joined, where each starts, its text's place in the list, and its begin there."""
    held, size = [], 0
    for k, text in enumerate(texts):
        for at, block in blocks(text.encode()):
            held.append((block, size, k, at))
            size += len(block)
            if size >= TOGETHER:
                yield _joined(held)
                held, size = [], 0
    if held:
        yield _joined(held)


def _joined(held: list[tuple[bytes, int, int, int]]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    parts, *rest = zip(*held)
    return b"".join(parts), *(np.array(x, np.int64) for x in rest)


def _anchors(docs: DataFrame) -> DataFrame:
    """(anchor) of each segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            out = [_segments(block, starts, np.r_[starts[1:], len(block)], LENGTH, RUN)[0] for block, starts, _, _ in _together(part.column(0).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*out, np.empty(0, U64)]).astype(np.int64))], names=["anchor"])

    return docs.select("text").mapInArrow(run, "anchor long")


def _segment_rows(docs: DataFrame) -> DataFrame:
    """(doc, anchor, key, place) of each segment: a hash of its bytes; 64 times its begin, plus its windows."""
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            out: list[list[np.ndarray]] = [[], [], [], []]
            ids = part.column(0).to_numpy(zero_copy_only=False)
            for block, starts, places, begins in _together(part.column(1).to_pylist()):
                anchor, begin, windows = _segments(block, starts, np.r_[starts[1:], len(block)], LENGTH, RUN)
                keys = (xxhash.xxh3_64_intdigest(block[b:e]) for b, e in zip(begin.tolist(), (begin + windows + (LENGTH - 1)).tolist()))
                text = np.searchsorted(starts, begin, "right") - 1
                place = (begin - starts[text] + begins[text]) * 64 + windows
                for o, x in zip(out, (ids[places[text]], anchor, np.fromiter(keys, U64, len(begin)), place)):
                    o.append(x.astype(np.int64))
            flat = [pa.array(np.concatenate(o) if o else np.empty(0, np.int64), pa.int64()) for o in out]
            yield pa.RecordBatch.from_arrays(flat, names=["doc", "anchor", "key", "place"])

    return docs.select("doc", "text").mapInArrow(run, "doc long, anchor long, key long, place long")


def _pieces(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(anchor, hot, doc, begin, bytes): the bytes of wanted segments; of hot ones, window by window."""
    lists = wanted.groupBy("doc").agg(F.collect_list(F.struct("anchor", "place", "hot")).alias("places"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            out = []
            for doc, text, places in zip(*(c.to_pylist() for c in part.columns)):
                data = text.encode()
                for p in places:
                    begin, windows = divmod(p["place"], 64)
                    step = 1 if p["hot"] else windows
                    for b in range(begin, begin + windows, step):
                        out.append((p["anchor"], p["hot"], doc, b, data[b : b + step + LENGTH - 1]))
                if len(out) > 50_000:
                    yield _batch(out)
                    out = []
            yield _batch(out)

    return docs.join(lists, "doc").select("doc", "text", "places").mapInArrow(run, "anchor long, hot boolean, doc long, begin long, bytes binary")


PIECE = pa.schema([("anchor", pa.int64()), ("hot", pa.bool_()), ("doc", pa.int64()), ("begin", pa.int64()), ("bytes", pa.binary())])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(PIECE)], schema=PIECE)


def _sorted_out(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    """(doc, begin, stop) of what the windows of these (doc, begin, bytes) repeat among themselves."""
    rows.sort(key=lambda r: r[:2])
    again = repeated_windows([r[2] for r in rows])
    sizes = np.array([len(r[2]) for r in rows])
    at = np.cumsum(sizes) - sizes
    hit = np.flatnonzero(again)
    row = np.searchsorted(at, hit, "right") - 1
    new = np.r_[True, (np.diff(hit) > 1) | (np.diff(row) > 0)] if len(hit) else np.empty(0, bool)
    last = np.r_[new[1:], True] if len(hit) else new
    begin = np.array([r[1] for r in rows])
    doc = np.array([r[0] for r in rows])
    head, tail = np.flatnonzero(new), np.flatnonzero(last)
    start = begin[row[head]] + hit[head] - at[row[head]]
    stop = begin[row[tail]] + hit[tail] - at[row[tail]] + LENGTH
    return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (doc[row[head]], start, stop)], names=["doc", "begin", "stop"])


def _by_suffixes(pieces: DataFrame, partitions: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        size, anchor = 0, None
        for part in batches:
            for a, doc, begin, data in zip(*(c.to_pylist() for c in part.columns)):
                if size >= BATCH and a != anchor:
                    yield _sorted_out(held)
                    held, size = [], 0
                held.append((doc, begin, data))
                size, anchor = size + len(data) + 1, a
        if held:
            yield _sorted_out(held)

    dealt = pieces.select("anchor", "doc", "begin", "bytes").repartition(partitions, "anchor").sortWithinPartitions("anchor")
    return dealt.mapInArrow(run, "doc long, begin long, stop long")


def _tidy(spark) -> None:
    """Shuffle files stay until the driver happens to collect its garbage; the next stages need the room."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def repeats(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc, begin, stop): byte ranges of repeated windows, for docs(doc, text) with a unique doc that gives the order."""
    spark = docs.sparkSession
    shared = scratch.write(_anchors(docs).groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"))
    _tidy(spark)
    again = scratch.write(_segment_rows(docs).join(shared, "anchor"))
    _tidy(spark)
    begin, windows = F.shiftright("place", 6), F.col("place").bitwiseAND(F.lit(63))
    first = again.groupBy("anchor", "key").agg(F.min(F.struct("doc", "place")).alias("first"), F.count("*").alias("n"))
    first = scratch.write(first)
    whole = again.join(first.where("n > 1").select("anchor", "key", "first"), ["anchor", "key"])
    whole = whole.where((F.col("doc") != F.col("first.doc")) | (F.col("place") != F.col("first.place")))
    whole = scratch.write(whole.select("doc", begin.alias("begin"), (begin + windows + (LENGTH - 1)).alias("stop")))
    kinds = first.select("anchor", "first.*")
    many = scratch.write(kinds.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor", (F.col("n") > MANY).alias("hot")))
    pieces = scratch.write(_pieces(docs, kinds.join(many, "anchor")))
    _tidy(spark)
    size = pieces.where("not hot").agg(F.coalesce(F.sum(F.length("bytes")), F.lit(0)).alias("n")).first()["n"]
    inner = _by_suffixes(pieces.where("not hot"), max(1, -(-size // SHARE)))
    single = pieces.where("hot").select("doc", "begin", "bytes")
    origin = single.groupBy("bytes").agg(F.min(F.struct("doc", "begin")).alias("first"), F.count("*").alias("n")).where("n > 1")
    equal = single.join(origin, "bytes").where((F.col("doc") != F.col("first.doc")) | (F.col("begin") != F.col("first.begin")))
    equal = equal.select("doc", "begin", (F.col("begin") + LENGTH).alias("stop"))
    return whole.union(scratch.write(inner.union(equal)))


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges that touch or overlap, as one."""
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


SPANS = pa.list_(pa.struct([("begin", pa.int64()), ("stop", pa.int64())]))


def _ordered(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, bool]:
    """docs(doc_id, doc, text): `doc` is doc_id where that is unique, else its place in the order of (doc_id, text)."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    seen = base.groupBy("doc_id").agg(F.count("*").alias("n")).agg(F.max("n").alias("most"), F.sum(F.col("doc_id").isNull().cast("int")).alias("nulls")).first()
    if (seen["most"] or 1) == 1 and not seen["nulls"]:
        return base.withColumn("doc", F.col("doc_id")), True
    base = base.withColumn("mark", F.sha2("text", 256))
    order = base.select("doc_id", "mark").distinct().orderBy(F.asc_nulls_first("doc_id"), "mark")
    order = scratch.write(order.select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"), F.monotonically_increasing_id().alias("doc")))
    return base.join(order, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark"))).select("doc_id", "doc", "text"), False


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, spans, kept) for each row of `docs`.

    `spans` are the removed byte ranges (begin, stop), `kept` the remaining bytes, which
    need not be valid UTF-8. A null text is empty. Rows that repeat a doc_id are ordered by
    their text; equal rows count as one document and get equal answers; a null doc_id comes
    first. An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "suffixes")
    base, unique = _ordered(docs, scratch)
    one = base.select("doc", "text") if unique else base.select("doc", "text").dropDuplicates(["doc"])
    found = repeats(one, scratch).groupBy("doc").agg(F.collect_list(F.struct("begin", "stop")).alias("ranges"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            sizes, spans, kept = [], [], []
            for text, ranges in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                data = text.encode()
                gone = merged([(r["begin"], r["stop"]) for r in ranges or ()])
                edges = [0, *(x for g in gone for x in g), len(data)]
                sizes.append(len(data))
                spans.append([{"begin": a, "stop": b} for a, b in gone])
                kept.append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2])))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(sizes, pa.int64()), pa.array(spans, SPANS), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"]
            )

    out = base.join(found, "doc", "left").select("doc_id", "text", "ranges")
    return out.mapInArrow(run, "doc_id long, n_bytes long, spans array<struct<begin:long,stop:long>>, kept binary")
