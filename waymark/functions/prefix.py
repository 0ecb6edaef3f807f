"""Running values over ordered rows that do not depend on one task per key.

A plain window sorts a whole key in one task. Here a key is cut into chunks by
a monotone function of the order; a window runs inside each chunk, one summary
row per chunk carries the state across chunks. A key that holds a third of all
rows is spread over as many tasks as it has chunks.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_CHUNK = "_chunk"


def running(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    chunk: Column,
    specs: dict[str, tuple[str, Column]],
    tasks: int | None = None,
) -> DataFrame:
    """Add running columns.

    `specs` maps a new column to `(kind, value)`; kinds are `sum`, `max`,
    `last` (latest non-null value up to this row) and `lag` (value of the
    previous row, NULL on the first row of the key). `chunk` must not decrease
    along `order`, rows equal in `order` must be unique per key, and keys must not
    be NULL. `tasks` is how many the chunks are dealt to, where the session's number
    of shuffle partitions is not enough.
    """
    names = list(specs)
    order_key = F.struct(*[F.col(c) for c in order])
    inside = Window.partitionBy(*keys, _CHUNK).orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    across = Window.partitionBy(*keys).orderBy(_CHUNK).rowsBetween(Window.unboundedPreceding, -1)

    base = df.select("*", chunk.alias(_CHUNK), *[v.alias(f"_v_{n}") for n, (_, v) in specs.items()])

    if tasks is not None:
        base = base.repartition(tasks, *keys, _CHUNK)

    within, summary = [], []
    for n, (kind, _) in specs.items():
        v = F.col(f"_v_{n}")
        if kind == "sum":
            within.append(F.sum(v).over(upto).alias(f"_w_{n}"))
            summary.append(F.sum(v).alias(f"_s_{n}"))
        elif kind == "max":
            within.append(F.max(v).over(upto).alias(f"_w_{n}"))
            summary.append(F.max(v).alias(f"_s_{n}"))
        elif kind == "last":
            within.append(F.last(v, ignorenulls=True).over(upto).alias(f"_w_{n}"))
            summary.append(F.max_by(v, F.when(v.isNotNull(), order_key)).alias(f"_s_{n}"))
        elif kind == "lag":
            within.append(F.lag(v).over(inside).alias(f"_w_{n}"))
            # Wrapped, so that a NULL value still counts as the latest one.
            summary.append(F.max_by(F.struct(v.alias("v")), order_key).alias(f"_s_{n}"))
        else:
            raise ValueError(f"unknown running kind: {kind}")

    rows = base.select("*", F.row_number().over(inside).alias("_rn"), *within)
    carried = base.groupBy(*keys, _CHUNK).agg(*summary)
    carry = {"sum": F.sum, "max": F.max}
    carried = carried.select(
        *keys,
        _CHUNK,
        *[
            (
                carry[kind](F.col(f"_s_{n}")).over(across)
                if kind in carry
                else F.last(F.col(f"_s_{n}"), ignorenulls=True).over(across)
            ).alias(f"_c_{n}")
            for n, (kind, _) in specs.items()
        ],
    )

    left, right = rows.alias("l"), carried.alias("r")
    # Plain equality on the window's own keys: the rows are not shuffled again.
    on = F.col(f"l.{_CHUNK}") == F.col(f"r.{_CHUNK}")
    for k in keys:
        on = on & (F.col(f"l.{k}") == F.col(f"r.{k}"))
    joined = left.join(right, on, "left")

    out = []
    for n, (kind, _) in specs.items():
        w, c = F.col(f"l._w_{n}"), F.col(f"r._c_{n}")
        if kind == "sum":
            out.append(F.when(w.isNull() & c.isNull(), None).otherwise(
                F.coalesce(w, F.lit(0)) + F.coalesce(c, F.lit(0))).alias(n))
        elif kind == "max":
            out.append(F.greatest(w, c).alias(n))
        elif kind == "last":
            out.append(F.coalesce(w, c).alias(n))
        else:
            out.append(F.when(F.col("l._rn") == 1, c["v"]).otherwise(w).alias(n))
    keep = [F.col(f"l.{c}") for c in df.columns if c not in names]
    return joined.select(*keep, *out)


CHUNK_ROWS = 1_000_000
SEGMENTS = 64
EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"


def time_chunk(df: DataFrame, ts: str = "ts", rows: int = CHUNK_ROWS) -> Column:
    """Chunk number along a time column, about `rows` rows each.

    One aggregated row tells the count and 64 quantiles. Between two quantiles
    time is divided evenly, so busy hours get narrow chunks and quiet ones wide.
    """
    micros = f"timestampdiff(MICROSECOND, {EPOCH}, cast({ts} as timestamp_ntz))"
    shares = F.array(*[F.lit(i / SEGMENTS) for i in range(SEGMENTS + 1)])
    about = df.agg(
        F.count(ts).alias("n"), F.percentile_approx(F.expr(micros), shares, 10_000).alias("q")
    ).first()
    return F.lit(0) if not about["n"] else spread_chunk(micros, about["n"], about["q"], rows)


def spread_chunk(value: str, n: int, quantiles: list[int], rows: int) -> Column:
    """Chunk number of a numeric SQL expression from its count and quantiles."""
    edges = sorted(set(quantiles))
    pieces = -(-n // rows)
    if pieces <= 1 or len(edges) < 2:
        return F.lit(0)
    per = -(-pieces // (len(edges) - 1))

    def pick(low: int, high: int) -> str:
        """Binary search over the edges as nested conditions."""
        if high - low == 1:
            width = edges[high] - edges[low]
            inside = f"cast(floor(({value} - {edges[low]}L) * {per}D / {width}D) as bigint)"
            return f"{low * per}L + least(greatest({inside}, 0L), {per - 1}L)"
        mid = (low + high) // 2
        return f"if({value} < {edges[mid]}L, {pick(low, mid)}, {pick(mid, high)})"

    return F.expr(pick(0, len(edges) - 1))


def number_chunk(n: Column, width: int = 10000) -> Column:
    """Chunk number of a row or line number."""
    return F.floor(n / width)
