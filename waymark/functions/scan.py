"""What all earlier rows of a key combine to, for any associative combination.

Rows are numbered along their order and combined by groups of 64, the groups by groups of
64, and so on until one group is left for each key; on the way down each group hands its members
what came before them. So no task holds more than 64 values of a key, the plan grows with
the logarithm of the longest key only, and a value may be anything that combines.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.functions.prefix import number_chunk, running
from waymark.session import cut

WIDTH = 64


def scan(
    rows: DataFrame, keys: list[str], order: list[str], value: Column, combine: Callable[[Column, Column], Column],
    name: str = "before", chunk: Column | None = None, width: int = WIDTH,
) -> DataFrame:
    """Add `name`: the combination of `value` over all earlier rows of the key, NULL for its first row.

    `order` must tell the rows of a key apart; its first column is a number unless `chunk`
    gives a number that does not decrease along the order. Keys must not be NULL.
    """
    part = number_chunk(F.col(order[0])) if chunk is None else chunk
    numbered = running(rows.withColumn("_value", value), keys, order, part, {"_n": ("sum", F.lit(1).cast("bigint"))})
    # Read by every level; what is written is what was asked for, numbered.
    numbered = cut(numbered.withColumn("_n", F.col("_n") - 1), "scan")
    longest = numbered.agg(F.coalesce(F.max("_n"), F.lit(0)).alias("n")).first()["n"]
    kind = numbered.schema["_value"].dataType.simpleString()

    def grouped(level: DataFrame) -> DataFrame:
        members = F.array_sort(F.collect_list(F.struct("_n", "_value")))
        return level.groupBy(*keys, F.floor(F.col("_n") / width).alias("_group")).agg(members.alias("_members"))

    def then(a: Column, b: Column) -> Column:
        return F.when(a.isNull(), b).otherwise(combine(a, b))

    none = F.lit(None).cast(kind)
    groups = [grouped(numbered.select(*keys, "_n", "_value"))]
    while longest >= width:
        longest //= width
        whole = F.aggregate("_members", none, lambda a, x: then(a, x["_value"]))
        groups.append(grouped(groups[-1].select(*keys, F.col("_group").alias("_n"), whole.alias("_value"))))
    came = None
    for level in reversed(groups):
        if came is None:
            led = level.withColumn("_first", none)
        else:
            led = level.join(came.withColumnRenamed("_n", "_group").withColumnRenamed("_came", "_first"), [*keys, "_group"])
        empty = F.array().cast(f"array<struct<_n:bigint,_came:{kind}>>")
        each = F.aggregate(
            "_members", F.struct(F.col("_first").alias("v"), empty.alias("all")),
            lambda s, x: F.struct(
                then(s["v"], x["_value"]).alias("v"), F.concat(s["all"], F.array(F.struct(x["_n"].alias("_n"), s["v"].alias("_came")))).alias("all")
            ),
            lambda s: s["all"],
        )
        came = led.select(*keys, F.inline(each))
    return numbered.join(came, [*keys, "_n"]).withColumnRenamed("_came", name).drop("_n", "_value")
