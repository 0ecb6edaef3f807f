"""Run summaries over latency samples."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions.text import format_duration
from waymark.session import cut, fits, union_all

#: Parts of an octave that the first histogram tells apart, and parts of a part in each later one.
FIRST_PARTS, PARTS = 64, 4_096
#: Names up to which what is looked for is sent to the tasks: a few dozen bytes each.
BROADCAST_NAMES = 100_000


def _octave_part(value: str) -> Column:
    """A number that does not decrease along the values, the same for all within 1/64 of an octave."""
    size = f"cast(floor(log2(abs({value})) * {FIRST_PARTS}) as bigint) + 100000L"
    return F.expr(f"CASE WHEN isnan({value}) THEN 1000000L WHEN {value} = 0 THEN 0L WHEN {value} > 0 THEN {size} ELSE -({size}) END")


def _pick(counted: DataFrame) -> DataFrame:
    """The part of each name that holds its rank, and the rank within: (name, lo, hi, rank)."""
    upto = F.sum("c").over(Window.partitionBy("name").orderBy("part"))
    reached = counted.withColumn("upto", upto).filter((F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("c") < F.col("rank")))
    return reached.select("name", "lo", "hi", (F.col("rank") - F.col("upto") + F.col("c")).alias("rank"))


def nearest_rank(samples: DataFrame, q: float) -> DataFrame:
    """Exact nearest-rank percentile per name, by histograms that get finer.

    The first one has a fixed part of an octave for each count, so it needs no bounds; each
    later one divides the part that holds the rank by 4,096, until one value is left there.
    Only counts by name and part are shuffled, never samples; no sample row is sorted. Null
    values do not count; NaN is the greatest.
    """
    known = samples.filter("value is not null").select("name", F.col("value").cast("double").alias("value"))
    bounds = [F.count("*").alias("c"), F.min("value").alias("lo"), F.max("value").alias("hi")]
    counted = known.groupBy("name", _octave_part("value").alias("part")).agg(*bounds)
    rank = F.greatest(F.ceil(F.lit(q) * F.sum("c").over(Window.partitionBy("name"))), F.lit(1))
    found, left = [], cut(_pick(counted.withColumn("rank", rank)), "ranks")
    few = fits(left, BROADCAST_NAMES)
    while True:
        found.append(left.filter("lo = hi").select("name", F.col("lo").alias("percentile")))
        left = left.filter("lo <> hi")
        if left.isEmpty():
            return union_all(found)
        near = known.join(F.broadcast(left) if few else left, "name").filter("value >= lo and value <= hi")
        part = F.expr(f"least(cast(floor((value - lo) / (hi - lo) * {PARTS}) as bigint), {PARTS - 1}L)")
        left = cut(_pick(near.groupBy("name", "rank", part.alias("part")).agg(*bounds)), "ranks")


def latency_summary(samples: DataFrame, q: float = 0.95) -> DataFrame:
    """Average, total, extremes, nearest-rank percentile and population stddev."""
    plain = samples.groupBy("name").agg(
        F.count("value").alias("samples"),
        F.avg("value").alias("avg_ms"),
        F.sum("value").alias("total_ms"),
        F.min("value").alias("min_ms"),
        F.max("value").alias("max_ms"),
        F.stddev_pop("value").alias("std_dev_ms"),
    )
    ranked = nearest_rank(samples, q).withColumnRenamed("percentile", "p95_ms")
    return plain.join(ranked, "name")


REPORT_COLUMNS = ["avg_ms", "total_ms", "min_ms", "max_ms", "p95_ms", "std_dev_ms"]



def latency_report(suites: dict[str, DataFrame]) -> DataFrame:
    """One table row of text per benchmark, labelled by suite."""
    cells = [F.concat(F.lit(" "), format_duration(F.col(c)), F.lit(" |")) for c in REPORT_COLUMNS]
    row = F.concat(F.lit("| "), F.col("name"), F.lit(" |"), *cells)
    return union_all(
        df.select(F.lit(suite).alias("suite"), "name", row.alias("text")) for suite, df in suites.items()
    )


def memory_report(samples: DataFrame) -> DataFrame:
    """One table row of text per stage with megabytes to two decimals."""
    cols = ["rss", "heap_total", "heap_used", "external"]
    cells = [
        F.concat(F.lit(" "), F.coalesce(F.regexp_replace(F.format_number(c, 2), ",", ""), F.lit("")), F.lit(" |"))
        for c in cols
    ]
    return samples.select("name", F.concat(F.lit("| "), F.col("name"), F.lit(" |"), *cells).alias("text"))
