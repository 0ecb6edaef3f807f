"""Shards by balanced label propagation, with SQL functions and joins only.

Documents of equal text are neighbours. All start in a shard by hash. In each round, every
group that is still apart asks to move to the shard where most of its members are, if there
is room; a shard takes whole groups, in a fixed order, as far as its quota goes. Groups
larger than half a quota are cut into bundles first. What is linked to nothing, or found no
room, then fills the shards: their row counts differ by one at most.
"""

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from waymark.llm.common import Scratch

SHARDS = 8
#: Rows numbered by one task in a stretch.
STRETCH = 50_000


def _stretches(n: int) -> int:
    return max(1, -(-n // STRETCH))


def numbered(rows: DataFrame, by: list[str], order: list[str], n: int, weight: Column | None = None, name: str = "at") -> DataFrame:
    """Adds the sum of `weight` (default 1) over the earlier rows with equal `by`.

    Rows are dealt into stretches by a hash of `order`; each stretch is summed on its own
    and shifted by the totals of those before it, so no task reads all rows of a `by`.
    """
    w = F.lit(1).cast("long") if weight is None else weight.cast("long")
    held = rows.withColumn("_w", w).withColumn("_s", F.pmod(F.xxhash64(*order), F.lit(_stretches(n))))
    inner = W.partitionBy(*by, "_s").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    totals = held.groupBy(*by, "_s").agg(F.sum("_w").alias("_t"))
    outer = W.partitionBy(*by).orderBy("_s").rowsBetween(W.unboundedPreceding, -1) if by else W.orderBy("_s").rowsBetween(W.unboundedPreceding, -1)
    shift = totals.select(*by, "_s", F.coalesce(F.sum("_t").over(outer), F.lit(0)).alias("_shift"))
    out = held.withColumn("_in", F.coalesce(F.sum("_w").over(inner), F.lit(0))).join(shift, [*by, "_s"])
    return out.select(*rows.columns, (F.col("_shift") + F.col("_in")).alias(name))


def shard(docs: DataFrame, shards: int = SHARDS, rounds: int | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for each row of `docs`.

    `size` is the UTF-8 length of the text (null: none) plus 1, `text_crc32` its unsigned
    CRC-32, `law` is 'rows', `slot` counts from 0 in each shard in a fixed order,
    `grown_shard` is null. Equal texts are neighbours; null texts have none. Rows that
    repeat a doc_id are rows of their own, ordered arbitrarily among themselves if they are
    equal. An empty table gives no rows. Rounds go on until one places nothing, each places
    a bundle at least; `rounds` limits them.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "shards")
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    kind = docs.schema["doc_id"].dataType.simpleString()
    base = docs.select(
        "doc_id",
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
        F.when(F.col("text").isNotNull(), F.md5(body)).alias("text_key"),
        F.xxhash64("doc_id", F.crc32(body)).alias("mark"),
    )
    base = scratch.write(base)
    n = base.count()
    quota = [n // shards + (s < n % shards) for s in range(shards)]
    quotas = F.element_at(F.array(*map(F.lit, quota)), F.col("shard") + 1)

    def start() -> Column:
        return F.pmod(F.xxhash64("mark"), F.lit(shards)).cast("int")

    groups = base.where("text_key is not null").groupBy("text_key").agg(F.count("*").alias("members")).where("members > 1")
    # Bundles: parts of a group that move as one, about half a quota each at most.
    part = max(1, n // shards // 2)
    linked = base.join(groups, "text_key", "left").withColumn("bundle", F.pmod(F.col("mark"), F.ceil(F.col("members") / F.lit(part))))
    linked = linked.drop("members")
    keys = ["text_key", "bundle"]
    cells = linked.where("bundle is not null").groupBy(*keys, start().alias("shard")).agg(F.count("*").alias("n"))
    sizes = cells.groupBy(*keys).agg(F.sum("n").alias("total"))
    cells = scratch.write(cells.join(sizes, keys))
    settled = scratch.write(cells.limit(0).select(*keys, "shard", "total"))
    held: dict[int, int] = {}
    for _ in itertools.count() if rounds is None else range(rounds):
        left = [q - held.get(s, 0) for s, q in enumerate(quota)]
        widest = max(range(shards), key=lambda s: (left[s], -s))
        room = lambda c: F.element_at(F.array(*map(F.lit, left)), c + 1)  # noqa: E731, B023
        # The shard with most of a bundle's neighbours that has room for it, the lowest of equals; if none has, the widest.
        fits = F.col("total") <= room(F.col("shard"))
        aim = cells.groupBy(*keys, "total").agg(F.max(F.when(fits, F.struct("n", (-F.col("shard")).alias("low")))).alias("m"))
        aim = aim.select(*keys, "total", F.coalesce(-F.col("m.low"), F.lit(widest)).cast("int").alias("shard"))
        # What fits nowhere does not ask, or it would stand in the way of smaller ones.
        aim = aim.where(F.col("total") <= room(F.col("shard")))
        asked = numbered(aim, ["shard"], keys, n, F.col("total"))
        taken = scratch.write(asked.where(F.col("at") + F.col("total") <= room(F.col("shard"))).select(*keys, "shard", "total"))
        if taken.isEmpty():
            break
        settled = settled.union(taken)
        rest = scratch.write(cells.join(taken.select(keys), keys, "left_anti"))
        scratch.drop(cells)
        cells = rest
        held = {r["shard"]: r["n"] for r in settled.groupBy("shard").agg(F.sum("total").alias("n")).collect()}
    placed = linked.join(settled.drop("total"), keys, "left")
    columns = ["doc_id", "size", "text_crc32", "mark", "shard"]
    # What is linked to nothing, and groups that found no room, fill what is left.
    stay = placed.where("shard is not null").select(columns)
    free = numbered(placed.where("shard is null").select(columns), [], ["mark", "doc_id"], n)
    goal = F.lit(shards - 1)
    for s in reversed(range(shards)):
        upto = sum(quota[t] - held.get(t, 0) for t in range(s + 1))
        goal = F.when(F.col("at") < upto, F.lit(s)).otherwise(goal)
    free = free.withColumn("shard", goal.cast("int")).select(columns)
    out = numbered(scratch.write(stay.union(free)), ["shard"], ["mark", "doc_id"], n, name="slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
