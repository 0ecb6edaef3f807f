"""Streams whose rows depend on what their key saw before, in Spark's own keyed state.

Each function takes a streaming frame and gives one; state, its recovery and its expiry are
Spark's (`transformWithStateInPandas`, with the RocksDB state store). Rows of a micro-batch are
taken in the order of time and `event_id`. Rows later than the watermark are dropped; a row
that comes in a later micro-batch than a later row of its key, but within the delay, is
late, and each function states what happens to it. State goes once the watermark is the
function's retention past the last row of a key. Where one short row is kept of a key, keys
are kept together by buckets of their hash.
"""

import pickle
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

# Processors travel with the query, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Seconds of a bin of time.
BIN = 21_600
EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"
US = f"timestampdiff(MICROSECOND, {EPOCH}, cast(ts as timestamp_ntz)) as us"


def use_keyed_state(spark: SparkSession) -> None:
    """Choose the state store that keyed state needs, unless the session names one."""
    if spark.conf.get(STORE, "").endswith("RocksDBStateStoreProvider"):
        return
    spark.conf.set(STORE, ROCKS)


def in_order(frames: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(frames), ignore_index=True).sort_values(["us", "event_id"], kind="stable", ignore_index=True)


class _Kept(StatefulProcessor):
    """State of a key in `state`, cleared once the watermark is `retention_ms` past the last of its rows."""

    fields = ""

    def __init__(self, retention_days: float):
        self.retention_ms = int(retention_days * 86_400_000)

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", self.fields)
        self.timer = handle.getValueState("timer", "ms long")

    def before(self) -> tuple | None:
        return tuple(self.state.get()) if self.state.exists() else None

    def keep(self, state: tuple, last_us: int) -> None:
        ms = last_us // 1000 + self.retention_ms
        if self.timer.exists():
            held = self.timer.get()[0]
            if held < ms:
                self.handle.deleteTimer(held)
        else:
            held = -1
        if held < ms:
            self.handle.registerTimer(ms)
            self.timer.update((ms,))
        self.state.update(state)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.state.clear()
        self.timer.clear()
        return iter([])

    def close(self) -> None:
        pass


def _timed(rows: DataFrame, delay: str) -> DataFrame:
    use_keyed_state(rows.sparkSession)
    return rows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)


def _run(rows: DataFrame, key: str, processor: StatefulProcessor, columns: str, mode: str = "Append") -> DataFrame:
    return rows.groupBy(key).transformWithStateInPandas(processor, columns, mode, "EventTime")


class _Changes(_Kept):
    fields = "us long, event_id long, value string"

    def handleInputRows(self, key, rows, timerValues):
        batch = in_order(rows)
        before = self.before()
        if before is not None:
            late = (batch["us"] < before[0]) | ((batch["us"] == before[0]) & (batch["event_id"] <= before[1]))
            batch = batch[~late].reset_index(drop=True)
        if not len(batch):
            return
        previous = batch["value"].shift(1)
        previous[0] = None if before is None else before[2]
        known = np.arange(len(batch)) > (0 if before is None else -1)
        # A null value differs from none, as in SQL.
        changed = known & batch["value"].notna() & previous.notna() & (batch["value"] != previous)
        end = batch.iloc[-1]
        self.keep((int(end["us"]), int(end["event_id"]), end["value"]), int(end["us"]))
        out = pd.DataFrame({"key": key[0], "us": batch["us"], "event_id": batch["event_id"], "value": batch["value"], "previous": previous})[changed]
        if len(out):
            yield out


def changes_only_stream(events: DataFrame, retention_days: float = 30, delay: str = "10 minutes") -> DataFrame:
    """Rows `(key, us, event_id, value, previous)` of `events(key, ts, event_id, value)` whose value differs from the row before.

    The first value of a key is its baseline. A late row is dropped.
    """
    rows = _timed(events, delay).selectExpr("key", "ts", US, "event_id", "value")
    kind = events.schema["key"].dataType.simpleString()
    return _run(rows, "key", _Changes(retention_days), f"key {kind}, us long, event_id long, value string, previous string")


class _Guard(_Kept):
    fields = "us long"

    def __init__(self, retention_days: float, gap: int):
        super().__init__(retention_days)
        self.gap = gap

    def handleInputRows(self, key, rows, timerValues):
        batch = in_order(rows)
        times = batch["us"].to_numpy()
        last = self.before()
        chosen, at = [], 0 if last is None else int(np.searchsorted(times, last[0] + self.gap, "right"))
        while at < len(times):
            chosen.append(at)
            at = int(np.searchsorted(times, times[at] + self.gap, "right"))
        if chosen:
            self.keep((int(times[chosen[-1]]),), int(times[chosen[-1]]))
            yield pd.DataFrame({"key": key[0], "us": times[chosen], "event_id": batch["event_id"].to_numpy()[chosen]})


def rebuild_guard_stream(requests: DataFrame, seconds: float = 60.0, retention_days: float = 30, delay: str = "10 minutes") -> DataFrame:
    """Requests `(key, us, event_id)` more than `seconds` after the last accepted one of the key.

    A late row is dropped if it is not after the pause of the accepted one, and judged by it otherwise.
    """
    rows = _timed(requests, delay).selectExpr("key", "ts", US, "event_id")
    kind = requests.schema["key"].dataType.simpleString()
    return _run(rows, "key", _Guard(max(retention_days, seconds / 86_400), int(seconds * 1_000_000)), f"key {kind}, us long, event_id long")


class _Cooldown(_Kept):
    fields = "times array<long>"

    def __init__(self, retention_days: float, gap: int):
        super().__init__(retention_days)
        self.gap = gap

    def handleInputRows(self, key, rows, timerValues):
        batch = in_order(rows)
        before = self.before()
        times = np.array([] if before is None else list(before[0]), np.int64)
        fresh = batch.loc[batch["is_mark"], "us"].to_numpy()
        if len(fresh):
            times = np.union1d(times, fresh)
            self.keep((times.tolist(),), int(times[-1]))
        events = batch[~batch["is_mark"]]
        if not len(events):
            return
        us = events["us"].to_numpy()
        at = np.searchsorted(times, us, "right") - 1
        age = us - (times[np.maximum(at, 0)] if len(times) else 0)
        quiet = (at < 0) | (age > self.gap)
        out = events.loc[quiet | (events["kind"] == "delete").to_numpy(), ["us", "event_id", "kind"]]
        if len(out):
            yield out


def cooldown_stream(events: DataFrame, seconds: float = 5.0, retention_days: float = 1, delay: str = "10 minutes") -> DataFrame:
    """Rows `(us, event_id, kind)` of `events(ts, event_id, kind)` without creates and changes within `seconds` after a `rebuild`.

    Time is the key, in bins of `BIN` seconds, or of the pause where that is longer: a
    rebuild stands in its bin and in that of the end of its pause, so each bin is judged by
    itself and no task sees all events. A late row is judged by the rebuilds that arrived up
    to its micro-batch.
    """
    gap = int(seconds * 1_000_000)
    wide = max(gap, BIN * 1_000_000)
    rows = _timed(events, delay).selectExpr("ts", US, "event_id", "kind", "kind = 'rebuild' as is_mark").withColumn("bin", F.floor(F.col("us") / wide))
    end = F.floor((F.col("us") + gap) / wide)
    bins = F.when(F.col("is_mark"), F.array_distinct(F.array(F.col("bin"), end))).otherwise(F.array("bin"))
    processor = _Cooldown(max(retention_days, 2 * wide / 86_400_000_000), gap)
    return _run(rows.withColumn("bin", F.explode(bins)), "bin", processor, "us long, event_id long, kind string")


#: Groups that the keys of a stream are dealt to, where what is kept of a key is one short row.
BUCKETS = 512


class _Bucket(StatefulProcessor):
    """Rows `(name, us, ...)`, one for each key of a bucket of keys, kept together and merged at once.

    A call for each key would cost several round trips to the state store. A row goes once
    the watermark is `retention_ms` past its `us`, unless rows of its key arrive.
    """

    columns: tuple[str, ...] = ()

    def __init__(self, retention_days: float):
        self.retention_ms = int(retention_days * 86_400_000)

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "ms long, rows binary")

    def merged(self, kept: pd.DataFrame, batch: pd.DataFrame) -> pd.DataFrame:
        """The rows of the names in `batch`, from its rows and those kept of them."""
        raise NotImplementedError

    def read(self) -> tuple[int, pd.DataFrame]:
        """When the next row goes, and the rows."""
        held = self.state.get() if self.state.exists() else None
        if held is None:
            return -1, pd.DataFrame({c: [] for c in self.columns}, dtype=object)
        rows = pickle.loads(bytes(held[1]))
        return held[0], pd.DataFrame({c: pd.Series(v, dtype=object) for c, v in zip(self.columns, rows)})

    def write(self, held: int, rows: pd.DataFrame) -> None:
        if not len(rows):
            self.state.clear()
            ms = -1
        else:
            ms = int(rows["us"].min()) // 1000 + self.retention_ms
            self.state.update((ms, pickle.dumps([rows[c].tolist() for c in self.columns])))
        if ms != held:
            if held >= 0:
                self.handle.deleteTimer(held)
            if ms >= 0:
                self.handle.registerTimer(ms)

    def lasting(self, rows: pd.DataFrame, watermark: int) -> pd.DataFrame:
        return rows[rows["us"].astype("int64") // 1000 + self.retention_ms >= watermark]

    def handleInputRows(self, key, rows, timerValues):
        batch = in_order(rows)
        held, kept = self.read()
        again = kept["name"].isin(batch["name"])
        new = self.merged(kept[again], batch)
        rest = self.lasting(kept[~again], timerValues.getCurrentWatermarkInMs())
        self.write(held, pd.concat([rest, new[list(self.columns)].astype(object)], ignore_index=True))
        yield new[list(self.columns)]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        _, kept = self.read()
        # The timer that expired is gone already.
        self.write(-1, self.lasting(kept, max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs() + 1)))
        return iter([])

    def close(self) -> None:
        pass


class _Latest(_Bucket):
    columns = ("name", "us", "event_id", "query")

    def merged(self, kept, batch):
        # A row of the batch wins over an equal one from before.
        both = pd.concat([kept, batch[list(self.columns)].astype(object)], ignore_index=True)
        both = both.sort_values(["us", "event_id"], kind="stable")
        return both.drop_duplicates("name", keep="last")


class _Counts(_Bucket):
    columns = ("name", "us", "n")

    def merged(self, kept, batch):
        both = pd.concat([kept, batch.assign(n=1)[list(self.columns)].astype(object)], ignore_index=True)
        both = both.astype({"us": "int64", "n": "int64"})
        out = both.groupby("name", dropna=False, sort=False).agg(us=("us", "max"), n=("n", "sum")).reset_index()
        # A null name stays one.
        return out.assign(name=out["name"].astype(object).where(out["name"].notna(), None))


def _run_buckets(rows: DataFrame, name: str, processor: _Bucket, columns: str) -> DataFrame:
    """`processor` over buckets of the column `name`, which goes through it as text."""
    named = rows.withColumn("name", F.col(name).cast("string"))
    dealt = named.withColumn("bucket", F.pmod(F.xxhash64("name"), F.lit(BUCKETS)))
    keep = [c for c in dealt.columns if c != name]
    out = _run(dealt.select(*keep), "bucket", processor, f"name string, {columns}", "Update")
    return out.withColumn("name", F.col("name").cast(rows.schema[name].dataType)).withColumnRenamed("name", name)


def latest_query_stream(typed: DataFrame, retention_days: float = 1, delay: str = "10 minutes") -> DataFrame:
    """The newest query `(session, us, event_id, query)` of each session, again whenever rows of it arrive.

    Rows later than the watermark are dropped. A session that comes back after its state
    went starts anew, with the same answer, as its rows are newer.
    """
    rows = _timed(typed, delay).selectExpr("session", "ts", US, "event_id", "query")
    return _run_buckets(rows, "session", _Latest(retention_days), "us long, event_id long, query string")


def access_counts_stream(accesses: DataFrame, retention_days: float = 30, delay: str = "10 minutes") -> DataFrame:
    """Accesses and the last one `(item_id, last_us, access_count)` of each item of `accesses(item_id, ts, event_id)`, again whenever rows arrive.

    Rows later than the watermark are dropped. An item not used for the retention is
    forgotten, as by `retain`: its count starts again.
    """
    rows = _timed(accesses, delay).selectExpr("item_id", "ts", US, "event_id")
    out = _run_buckets(rows, "item_id", _Counts(retention_days), "us long, n long")
    return out.withColumnsRenamed({"us": "last_us", "n": "access_count"})
