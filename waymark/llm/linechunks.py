"""Line dedup by content-defined chunks of lines, with SQL functions only.

A line's hash comes from its MD5. A rolling hash over each two neighbouring lines ends a
chunk where it is divisible by `DIVISOR`, so an insertion moves boundaries only near
itself. Chunks of two or more lines with a word that occur again, anywhere in the corpus,
are taken out after their bytes were compared with those of the first.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import Scratch, without
from waymark.llm.rules import bound

DIVISOR, MIXER, MODULUS = 4, 31, 1_000_003
HAS_WORD = r"[^\x20\x09-\x0D]"


def lines_of(text: str = "text") -> Column:
    return F.split(F.col(text), "\n")


def chunks_of(lines: Column) -> Column:
    """array<struct<begin, n>> of the chunks of an array of lines; `begin` counts from 1."""

    def of_lines(ls: Column) -> Column:
        hashes = F.transform(ls, lambda x: F.conv(F.substring(F.md5(x.cast("binary")), 1, 7), 16, 10).cast("long"))

        def of_hashes(h: Column) -> Column:
            rolled = F.transform(h, lambda x, i: F.struct(i.alias("i"), ((x * MIXER + F.coalesce(F.get(h, i - 1), F.lit(0))) % MODULUS % DIVISOR).alias("r")))
            ends = F.transform(F.filter(rolled, lambda x: (x["r"] == 0) | (x["i"] == F.size(h) - 1)), lambda x: x["i"] + 1)

            def of_ends(e: Column) -> Column:
                begin = lambda k: F.coalesce(F.get(e, k - 1), F.lit(0)) + 1
                return F.transform(e, lambda x, k: F.struct(begin(k).alias("begin"), (x - begin(k) + 1).alias("n")))

            return bound(ends, of_ends)

        return bound(hashes, of_hashes)

    return bound(lines, of_lines)


def _joined(lines: Column, chunk: Column) -> Column:
    return F.array_join(F.slice(lines, chunk["begin"], chunk["n"]), "\n")


def _chunk_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, k, chunk): the chunks of two or more lines with a word."""
    rows = docs.where(F.col("text").isNotNull()).select("doc_id", lines_of().alias("lines"))
    rows = rows.select("doc_id", "lines", F.posexplode(chunks_of(F.col("lines"))).alias("k", "c")).where("c.n > 1")
    part = F.slice("lines", F.col("c.begin"), F.col("c.n"))
    rows = rows.where(F.size(F.filter(part, lambda x: x.rlike(HAS_WORD))) > 1)
    return rows.select("doc_id", "k", _joined(F.col("lines"), F.col("c")).alias("chunk"))


def repeated_chunks(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, k): chunks whose bytes occurred before, in the order of doc_id and place."""
    docs = docs.select("doc_id", "text")
    keys = _chunk_rows(docs).select("doc_id", "k", F.xxhash64("chunk").alias("key"))
    first = keys.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "k")).alias("first")).where("n > 1")
    first = scratch.write(first.select("key", "first"))
    marks = keys.join(first, "key").groupBy("doc_id").agg(F.collect_set(F.struct("k", "key", "first")).alias("marks"))
    held = docs.join(marks.withColumnRenamed("doc_id", "id"), F.col("doc_id").eqNullSafe(F.col("id"))).where(F.col("text").isNotNull())
    held = held.withColumn("lines", lines_of()).withColumn("chunks", chunks_of(F.col("lines")))
    held = held.select("doc_id", "lines", "chunks", F.explode("marks").alias("m"))
    held = held.select(
        "doc_id",
        F.col("m.k").alias("k"),
        F.col("m.key").alias("key"),
        (F.col("doc_id").eqNullSafe(F.col("m.first.doc_id")) & (F.col("m.k") == F.col("m.first.k"))).alias("is_first"),
        _joined(F.col("lines"), F.get("chunks", F.col("m.k"))).alias("chunk"),
    )
    # Rows that repeat a doc_id with another text may hold something else in that place.
    held = scratch.write(held.where(F.xxhash64("chunk") == F.col("key")))
    origin = scratch.write(held.where("is_first").groupBy("key").agg(F.min("chunk").alias("origin")))
    same = held.where("not is_first").join(origin, "key").where(F.col("chunk").cast("binary") == F.col("origin").cast("binary"))
    return same.select("doc_id", "k").distinct()


def dedup_lines(docs: DataFrame) -> DataFrame:
    """`docs` with shortened `text`, and `n_lines`, `n_removed_lines`, `n_removed_chunks` (long).

    The first occurrence of a chunk, by doc_id and place, stays. A null text stays null with
    counts of 0; an empty one is one line. Rows that repeat a doc_id count as one document
    and lose the same chunks; rows without a doc_id count as one document that comes first.
    Columns of the added names are replaced; all others stay as they are.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    gone = repeated_chunks(docs, scratch).groupBy("doc_id").agg(F.collect_set("k").alias("_gone"))
    base = without(docs, "n_lines", "n_removed_lines", "n_removed_chunks")
    rows = base.join(gone.withColumnRenamed("doc_id", "_id"), F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    rows = rows.withColumn("_lines", lines_of())
    touched = F.col("_gone").isNotNull() & F.col("text").isNotNull()
    rows = rows.withColumn("_chunks", F.when(touched, chunks_of(F.col("_lines"))))
    kept = F.filter("_chunks", lambda c, k: ~F.array_contains("_gone", k))
    rows = rows.withColumn("_kept", F.when(touched, F.flatten(F.transform(kept, lambda c: F.slice("_lines", c["begin"], c["n"])))))
    n = F.coalesce(F.size("_lines"), F.lit(0)).cast("long")
    n_lines = F.when(F.col("text").isNull(), F.lit(0).cast("long")).otherwise(n)
    return rows.select(
        *(F.when(touched, F.array_join("_kept", "\n")).otherwise(F.col("text")).alias(c) if c == "text" else F.col(c) for c in base.columns),
        n_lines.alias("n_lines"),
        F.when(touched, n - F.size("_kept")).otherwise(F.lit(0).cast("long")).alias("n_removed_lines"),
        F.when(touched, F.size("_chunks") - F.size(kept)).otherwise(F.lit(0)).cast("long").alias("n_removed_chunks"),
    )
