"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

The sketch of a set has `SLOTS` coordinates. Round i hashes every element into a slot
with a value that starts at i; after SLOTS rounds, round SLOTS + j aims all elements at
slot j. Each slot keeps its least (round, hash), so every slot is filled, and the slots
two sets agree on concentrate around their similarity (Dahlgaard, Knudsen, Thorup 2017).

Sets that are equal are one class with one representative. Bands of sketch slots put
representatives into buckets; within a bucket all are compared with its smallest member
first. What is still apart and could be linked at all is then compared with what shares one
of its rarest shingles. Links are confirmed on the whole shingle sets.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import U64, Scratch, lowered_words, mix, shingle_hashes, slices
from waymark.llm.graph import components

SHINGLE, PERCENT = 5, 75
BANDS, ROWS = 32, 4
SLOTS = BANDS * ROWS
#: Sketches of similarity 0.75 agree on 96 of the 128 slots, with a deviation of 4.9: on fewer than 70 once in 30 million pairs.
PLANES, AGREE = 8, 70
#: Bits that tell apart the shingles of two texts, and rare shingles that a row carries along of those before its own.
BITS, CARRIED = 1024, 8


def sketch(items: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """Fast similarity sketch of distinct 64-bit items (at least one)."""
    none = U64(2**64 - 1)
    out = np.full(slots, none)
    done = 0
    while (out == none).any():
        if done < slots:
            # Enough rounds at once that about six elements aim at each slot.
            rounds = np.arange(done, min(slots, done + max(1, -(-6 * slots // len(items)))), dtype=U64)
        else:
            rounds = np.arange(done, 2 * slots, dtype=U64)
        with np.errstate(over="ignore"):
            h = mix(items[None, :] + (rounds[:, None] + U64(1)) * U64(0x9E3779B97F4A7C15))
        aim = (h % U64(slots)).astype(np.int64) if done < slots else np.broadcast_to((rounds - U64(slots)).astype(np.int64)[:, None], h.shape)
        value = (rounds[:, None] << U64(48)) | (h >> U64(16))
        np.minimum.at(out, aim.ravel(), value.ravel())
        done = int(rounds[-1]) + 1
    return out


def bands(slots: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of a sketch."""
    s = slots.reshape(BANDS, ROWS)
    key = np.arange(BANDS, dtype=U64)
    with np.errstate(over="ignore"):
        for k in range(ROWS):
            key = mix(key * U64(0x9E3779B97F4A7C15) + s[:, k])
    return key


def planes(slots: np.ndarray) -> np.ndarray:
    """The sketch as PLANES bits of each slot, in words of 64 slots: plane 0 of the first 64, of the next, plane 1 ..."""
    low = mix(slots).astype(np.uint8)
    return np.packbits((low[None, :] >> np.arange(PLANES, dtype=np.uint8)[:, None]) & 1, axis=1).view(">u8").astype(U64).ravel()


def shingle_set(text: str | None) -> frozenset[bytes]:
    """Distinct shingles of a whole text as bytes, for the exact test."""
    w = lowered_words(text)
    return frozenset(b" ".join(w[i : i + SHINGLE]) for i in range(max(1, len(w) - SHINGLE + 1))) if w else frozenset()


def similar(a: frozenset, b: frozenset) -> bool:
    if 100 * min(len(a), len(b)) < PERCENT * max(len(a), len(b)):
        return False
    both = len(a & b)
    return 100 * both >= PERCENT * (len(a) + len(b) - both)


def _sets(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, set_key, bands, planes) of every row; the key is a 128-bit hash of the sorted set, null if it is empty."""
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            counts, keys, held, bits = [], [], [], []
            for text in part.column(1).to_pylist():
                items = np.unique(shingle_hashes(lowered_words(text), SHINGLE))
                counts.append(len(items))
                keys.append(xxhash.xxh3_128_digest(items.tobytes()) if len(items) else None)
                slots = sketch(items) if len(items) else None
                held.append(None if slots is None else bands(slots).astype(np.int64))
                bits.append(None if slots is None else planes(slots).astype(np.int64))
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(counts, pa.int64()), pa.array(keys, pa.binary()), pa.array(held, longs), pa.array(bits, longs)],
                names=["doc_id", "n_shingles", "set_key", "bands", "planes"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_shingles long, set_key binary, bands array<long>, planes array<long>")


def _representatives(sets: DataFrame) -> DataFrame:
    """(rep, n_shingles, bands, planes): the smallest document of each set that is not empty."""
    known = sets.where("set_key is not null and doc_id is not null")
    return known.groupBy("set_key").agg(F.min(F.struct("doc_id", "n_shingles", "bands", "planes")).alias("x")).select(F.col("x.doc_id").alias("rep"), "x.n_shingles", "x.bands", "x.planes")


def _confirm(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those pairs (a, b) whose whole sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = (None, frozenset())
        for part in slices(batches, "text_b"):
            keep = []
            for a, ta, tb in zip(*(part.column(k).to_pylist() for k in (0, 2, 3))):
                if last[0] != a:
                    last = (a, shingle_set(ta))
                keep.append(similar(last[1], shingle_set(tb)))
            yield pa.RecordBatch.from_arrays([part.column(k).filter(pa.array(keep)) for k in (0, 1)], names=["a", "b"])

    kind = pairs.schema["a"].dataType.simpleString()
    both = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    both = both.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, f"a {kind}, b {kind}").distinct()


def _sizes_fit(a, b):
    return 100 * F.least(a, b) >= PERCENT * F.greatest(a, b)


def _star(members: DataFrame) -> DataFrame:
    """Pairs of each member with the smallest of its bucket."""
    first = members.groupBy("bucket").agg(F.min(F.struct("rep", "n_shingles")).alias("c"))
    pairs = members.join(first, "bucket").where((F.col("rep") != F.col("c.rep")) & _sizes_fit(F.col("n_shingles"), F.col("c.n_shingles")))
    return pairs.select(F.col("c.rep").alias("a"), F.col("rep").alias("b")).distinct()


def _shingle_rows(texts: DataFrame) -> DataFrame:
    """(shingle, rep, n_shingles, mark): each distinct shingle of each text; the mark tells texts of one doc_id apart."""
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            each = [np.unique(shingle_hashes(lowered_words(t), SHINGLE)) for t in part.column(1).to_pylist()]
            counts = np.array([len(x) for x in each], np.int64)
            at = pa.array(np.repeat(np.arange(part.num_rows), counts))
            flat = np.concatenate([*each, np.empty(0, U64)]).astype(np.int64)
            marks = np.array([xxhash.xxh3_64_intdigest(x.tobytes()) for x in each], U64).astype(np.int64)
            columns = [pa.array(flat), part.column(0).take(at), *(pa.array(np.repeat(x, counts)) for x in (counts, marks))]
            yield pa.RecordBatch.from_arrays(columns, names=["shingle", "rep", "n_shingles", "mark"])

    return texts.select("doc_id", "text").mapInArrow(run, f"shingle long, rep {texts.schema['doc_id'].dataType.simpleString()}, n_shingles long, mark long")


def _unique_counts(texts: DataFrame) -> DataFrame:
    """(rep, n_unique): shingles that no other of these texts has."""
    once = _shingle_rows(texts).groupBy("shingle").agg(F.count("*").alias("n"), F.min("rep").alias("rep")).where("n = 1")
    return once.groupBy("rep").agg(F.count("*").alias("n_unique"))


def _open(members: DataFrame) -> DataFrame:
    """Members of buckets that hold more than one part."""
    split = members.groupBy("bucket").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo < hi").select("bucket")
    return members.join(split, "bucket").select(*members.columns)


def _linkable(members: DataFrame, texts: DataFrame, scratch: Scratch, rounds: int = 2) -> DataFrame:
    """Open members that can be linked with one of a bucket at all, with `shared`, their shingles that other texts have.

    A member stays in all its open buckets or leaves all.

    Exact: a link of sets of n and m shingles shares 3/7 (n + m) or more of them, and both
    ends are members, so neither has fewer that occur in other members.
    """
    for _ in range(rounds):
        members = scratch.write(_open(members))
        alone = _unique_counts(texts.join(members.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi"))
        least = members.groupBy("bucket").agg(F.min("n_shingles").alias("least"))
        members = members.join(alone, "rep", "left").withColumn("shared", F.col("n_shingles") - F.coalesce("n_unique", F.lit(0)))
        other = F.greatest(100 * F.col("least"), PERCENT * F.col("n_shingles"))
        fits = (100 + PERCENT) * 100 * F.col("shared") >= PERCENT * (100 * F.col("n_shingles") + other)
        able = members.join(least, "bucket").where(fits).select("rep").distinct()
        members = members.join(able, "rep", "left_semi").select("bucket", "rep", "n_shingles", "part", "shared")
    return scratch.write(_open(members))


def _with_bits(lists: DataFrame) -> DataFrame:
    """Adds `bits`, in words of 64: for each of BITS hashes, whether an odd number of the `shared` shingles has it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            held = []
            for x in part.column(part.schema.get_field_index("shared")):
                at = mix(x.values.to_numpy(zero_copy_only=False).astype(U64)) % U64(BITS)
                held.append(np.packbits((np.bincount(at.astype(np.int64), minlength=BITS) & 1).astype(np.uint8)).view("<i8"))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(held, pa.list_(pa.int64()))], names=[*part.schema.names, "bits"])

    return lists.mapInArrow(run, f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in lists.schema.fields)}, bits array<long>")


def _prefixes(texts: DataFrame, parts: DataFrame) -> DataFrame:
    """(shingle, rep, n_shingles, place, alone, before, bits): the rarest shingles of each text among these texts, as many as a link needs.

    Not those of one part only; a text has `alone` of them. `place` counts them first, then
    the others in the order of (texts that have it, shingle), which is the same for all.
    Exact: the first common shingle of two linked sets of different parts has all others
    behind it in either, so of n shingles at least 3/4 n begin there or later. `before` holds
    the last few before this one, `bits` stands for all that other parts have, too.
    """
    rows = _shingle_rows(texts).join(parts, "rep")
    often = rows.groupBy("shingle").agg(F.count("*").alias("often"), (F.min("part") < F.max("part")).alias("across"))
    each = rows.join(often, "shingle").groupBy("rep", "n_shingles", "mark")
    shared = F.transform(F.sort_array(F.collect_set(F.when(F.col("across"), F.struct("often", "shingle")))), lambda x: x["shingle"])
    lists = each.agg(shared.alias("shared")).select("rep", "n_shingles", "shared").where(F.size("shared") > 0)
    lists = _with_bits(lists).withColumn("alone", F.col("n_shingles") - F.size("shared"))
    count = F.greatest(F.floor(F.lit(100 - PERCENT) * F.col("n_shingles") / 100) + 1 - F.col("alone"), F.lit(0)).cast("int")
    least = F.slice("shared", F.lit(1), F.least(count, F.size("shared")))
    found = lists.select("rep", "n_shingles", "alone", "shared", "bits", F.posexplode(least).alias("at", "shingle"))
    before = F.slice("shared", F.greatest(F.col("at") - CARRIED, F.lit(0)) + 1, F.least("at", F.lit(CARRIED)))
    return found.select("shingle", "rep", "n_shingles", (F.col("alone") + F.col("at")).alias("place"), "alone", before.alias("before"), "bits")


def _across(members: DataFrame, texts: DataFrame, reps: DataFrame, scratch: Scratch) -> DataFrame:
    """Pairs of different parts that may be linked.

    They meet in a shingle that is rare enough to be the first that a link has in common
    (see `_prefixes`), so texts that differ from each other about as much as all of a large
    group do are not paired with all of it. They share enough (see `_linkable`), and their
    sketches agree on as many slots as those of linked sets do (see AGREE). Linked sets of n
    and m shingles differ by (n + m) / 7 at most; those of one part only and those that the
    bits tell apart are different ones, so pairs with more are not linked. Where they have a
    common shingle before this one, the pair is made there.
    """
    each = scratch.write(members.select("rep", "n_shingles", "part", "shared").distinct())
    parts = each.select("rep", "part").distinct()
    rare = _prefixes(texts.join(parts.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi"), parts)
    left = scratch.write(rare.join(each, ["rep", "n_shingles"]))
    sizes = left.groupBy("shingle", "part").count().groupBy("shingle").agg(F.max(F.struct("count", "part")).alias("most"))
    left = left.join(sizes, "shingle").withColumn("main", F.col("part") == F.col("most.part")).drop("most")
    right = left.select(*(F.col(c).alias(f"{c}_b") for c in left.columns))
    unlike = F.col("alone") + F.col("alone_b")
    for k in range(BITS // 64):
        unlike = unlike + F.bit_count(F.get("bits", F.lit(k)).bitwiseXOR(F.get("bits_b", F.lit(k))))
    both = F.col("n_shingles") + F.col("n_shingles_b")
    left_over = F.least(F.col("n_shingles") - F.col("place"), F.col("n_shingles_b") - F.col("place_b"))
    on = (
        (F.col("shingle") == F.col("shingle_b"))
        & (F.col("part") != F.col("part_b"))
        & (F.col("main_b") | (F.col("rep") < F.col("rep_b")))
        & ((100 + PERCENT) * F.least("shared", "shared_b") >= PERCENT * both)
        & ((100 + PERCENT) * left_over >= PERCENT * both)
        & _sizes_fit(F.col("n_shingles"), F.col("n_shingles_b"))
        & ((100 + PERCENT) * unlike <= (100 - PERCENT) * both)
        & ~F.arrays_overlap("before", "before_b")
    )
    # The largest part of a shingle is not compared with itself.
    pairs = left.where(~F.col("main")).join(right, on).select(F.least("rep", "rep_b").alias("a"), F.greatest("rep", "rep_b").alias("b")).distinct()
    held = each.select("rep").distinct().join(reps.select("rep", "planes"), "rep")
    pairs = pairs.join(held.select(F.col("rep").alias("a"), "planes"), "a").join(held.select(F.col("rep").alias("b"), F.col("planes").alias("planes_b")), "b")
    differ = None
    for half in range(SLOTS // 64):
        words = [F.get("planes", F.lit(k * (SLOTS // 64) + half)).bitwiseXOR(F.get("planes_b", F.lit(k * (SLOTS // 64) + half))) for k in range(PLANES)]
        off = words[0]
        for w in words[1:]:
            off = off.bitwiseOR(w)
        differ = F.bit_count(off) if differ is None else differ + F.bit_count(off)
    return pairs.where(differ <= SLOTS - AGREE).select("a", "b").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of `docs`.

    The set of a text is its distinct five-word shingles, A-Z in lower case; of fewer
    words, the whole sequence; of none (null and empty texts), nothing, which is linked
    with nothing. `component_id` is the smallest doc_id linked directly or through others.
    `kept` is true for the document that gives its component the id. Rows that repeat a
    doc_id with the same text get the same answer; rows without a doc_id are kept and have
    no component. A row of an empty table has none.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "near")
    base = docs.select("doc_id", "text")
    sets = scratch.write(_sets(base))
    reps = scratch.write(_representatives(sets))
    buckets = reps.select(F.explode("bands").alias("bucket"), "rep", "n_shingles")
    full = buckets.groupBy("bucket").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo < hi").select("bucket")
    full = scratch.write(full)
    members = scratch.write(buckets.join(full, "bucket").withColumn("part", F.col("rep")))
    wanted = members.select(F.col("rep").alias("doc_id")).distinct()
    texts = scratch.write(base.join(wanted, "doc_id"))
    links, parts = None, None
    tested = scratch.write(_star(members))
    if not tested.isEmpty():
        links = scratch.write(_confirm(tested, texts))
        parts = components(links, scratch)
        named = parts.select(F.col("node").alias("rep"), F.col("component").alias("part"))
        members = members.drop("part").join(named, "rep", "left").withColumn("part", F.coalesce("part", "rep"))
    pairs = scratch.write(_across(_linkable(members, texts, scratch), texts, reps, scratch).join(tested, ["a", "b"], "left_anti"))
    if not pairs.isEmpty():
        more = scratch.write(_confirm(pairs, texts))
        if not more.isEmpty():
            parts = components(more if links is None else links.union(more), scratch)
    reps = sets.where("set_key is not null and doc_id is not null").groupBy("set_key").agg(F.min("doc_id").alias("rep"))
    if parts is not None:
        reps = reps.join(parts.select(F.col("node").alias("rep"), "component"), "rep", "left")
        reps = reps.select("set_key", F.coalesce("component", "rep").alias("component"))
    else:
        reps = reps.select("set_key", F.col("rep").alias("component"))
    scratch.drop(texts)
    out = sets.select("doc_id", "n_shingles", "set_key").join(reps, "set_key", "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_first(docs: DataFrame) -> DataFrame:
    """`docs` without those near-duplicates that are not the first of their component."""
    gone = near_duplicates(docs).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti")
