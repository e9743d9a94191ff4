"""Streaming twins of the batch operators, and the batch twins of the state machines.

State is bounded by watermarks of our own choice (one hour by default): the source has none, and keys would pile up.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StructField, StructType

from pagequarry.functions.tables import blocks_in_order
from pagequarry.operators import netlog, reports


def apply_patches(patches: DataFrame, known: DataFrame | None = None, fields: list[str] | None = None) -> DataFrame:
    """Per id, the last non-null value of every field in order of ts and seq; with known, patches of other ids are ignored."""
    cols = fields or [c for c in patches.columns if c not in ("id", "ts", "seq")]
    some = patches if known is None else patches.join(known.select("id").distinct(), "id", "left_semi")
    order = F.struct("ts", "seq")
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in cols]
    return some.groupBy("id").agg(*last)


class _Upsert(StatefulProcessor):
    """Keeps the fields of each known id; a micro-batch touches the ids of its patches only."""

    def __init__(self, key: str, fields: list[str], schema: StructType):
        self.key, self.fields = key, fields
        self.kept = StructType([schema[c] for c in fields] + [StructField("_patches", LongType())])

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("row", self.kept)

    def handleInitialState(self, key: tuple, initial: pd.DataFrame, timer) -> None:
        self.state.update((*self._row(initial.iloc[-1:])[0], 0))

    def _row(self, frame: pd.DataFrame) -> list[tuple]:
        """Rows of the fields, with None for what is missing."""
        return list(zip(*[pa.array(frame[c], t.type, from_pandas=True).to_pylist() for c, t in zip(self.fields, self.arrow())]))

    def arrow(self) -> pa.Schema:
        return to_arrow_schema(StructType(self.kept.fields[:-1]))

    def handleInputRows(self, key: tuple, frames: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        if not self.state.exists():
            return  # a patch of an unknown id
        *now, n = self.state.get()
        rows = pd.concat(list(frames)).sort_values(["ts", "seq"], kind="stable")
        for patch in self._row(rows):
            now = [b if b is not None else a for a, b in zip(now, patch)]
        n += len(rows)
        self.state.update((*now, n))
        columns = [pa.array([key[0]]), *(pa.array([v], t.type) for v, t in zip(now, self.arrow())), pa.array([n], pa.int64())]
        yield pa.Table.from_arrays(columns, names=[self.key, *self.fields, "patches"]).to_pandas(types_mapper=_nullable)

    def close(self) -> None:
        pass


def _nullable(kind: pa.DataType):
    """Whole numbers and flags stay what they are beside nulls."""
    return {pa.int32(): pd.Int32Dtype(), pa.int64(): pd.Int64Dtype(), pa.bool_(): pd.BooleanDtype()}.get(kind)


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def upsert_stream(patches: DataFrame, known: DataFrame) -> DataFrame:
    """A stream of rows as they become: id, the fields of known, patches (how many it has had), one row per id and micro-batch.

    known (id, fields) is the state at the start; patches (id, ts, seq, fields) of other ids are ignored; a null leaves a field as
    it is. Within a micro-batch, patches go by ts and seq. The state is one row per known id, in a state store that needs the
    session's spark.sql.streaming.stateStore.providerClass to be RocksDB's (run_to_end() sees to it).
    """
    fields = [c for c in known.columns if c != "id"]
    out = StructType([known.schema["id"], *(known.schema[c] for c in fields), StructField("patches", LongType())])
    rows = patches.select("id", "ts", "seq", *fields)
    return rows.groupBy("id").transformWithStateInPandas(_Upsert("id", fields, known.schema), out, "Append", "None", known.groupBy("id"))


def run_to_end(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Runs a stream over all that is there, appending its rows to Parquet files. With the checkpoint of an earlier run it goes on
    where that one ended, and what was written then is not written again."""
    conf, name = stream.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(name, None)
    conf.set(name, ROCKS)
    try:
        q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        conf.unset(name) if before is None else conf.set(name, before)


def stream_candidates(requests: DataFrame, delay: str = "1 hour") -> DataFrame:
    """New media candidates of a request stream, one per tab and storage key, when first seen."""
    c = netlog.network_candidates(netlog.filter_network_log(requests))
    return c.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay).dropDuplicatesWithinWatermark(["tab_id", "storage_key"])


def within_observation_window(events: DataFrame, scans: DataFrame, window_ms: int) -> DataFrame:
    """Events (page_id, ts, url) at most max(500, window_ms) after their page's scan (page_id, started_at), each URL once per
    page; events may be a stream, scans is a table. On a stream, drop repeats with dropDuplicatesWithinWatermark."""
    ms = max(500, window_ms)
    s = scans.select("page_id", "started_at")
    met = events.join(s, "page_id").where((F.col("ts") >= F.col("started_at")) & (F.col("ts") <= F.col("started_at") + F.expr(f"INTERVAL {ms / 1000} SECONDS")))
    return met.drop("started_at") if events.isStreaming else met.groupBy("page_id", "url").agg(F.min("ts").alias("ts"))


#: Events of a block, blocks that are combined at once.
BACKOFF_BLOCK, FAN = 20_000, 1_000


def _step(status: Column, most: float) -> Column:
    """What an event does to the factor, as the map x -> least(high, greatest(low, times * x))."""
    times = F.when(status.isNull(), 1.4).when(status.isin(429, 503), 2.0).when(status.between(200, 399), 0.75).otherwise(1.0)
    low = F.when(status.between(200, 399), 1.0).otherwise(0.0)
    return F.struct(times.alias("times"), F.least(low, F.lit(most)).alias("low"), F.lit(most).alias("high"))


def _clamp(m: Column, x: Column) -> Column:
    return F.least(m["high"], F.greatest(m["low"], m["times"] * x))


def _then(first: Column, second: Column) -> Column:
    """The map that applies one after the other: such maps are closed under this, whatever their number."""
    return F.struct((second["times"] * first["times"]).alias("times"), _clamp(second, first["low"]).alias("low"), _clamp(second, first["high"]).alias("high"))


def _composed(maps: Column, most: float) -> Column:
    """The maps of an array (place first, m), one after the other, as one."""
    same = F.struct(F.lit(1.0).alias("times"), F.lit(0.0).alias("low"), F.lit(most).alias("high"))
    return F.aggregate(F.array_sort(maps), same, lambda acc, x: _then(acc, x["m"]))


def backoff_maps(events: DataFrame, most: float, rows: int = BACKOFF_BLOCK, fan: int = FAN) -> DataFrame:
    """job_id, kind, m: all events of a key (seq, status) as one map. Blocks of about `rows` events in order of seq are folded side by
    side, and their maps combined in a tree, `fan` at once; so a key of any length is spread over tasks. Events that agree in seq
    go by status, nulls first, within a block."""
    keys = ["job_id", "kind"]
    some = events.select(*keys, "seq", F.when(~F.isnan(F.col("status").cast("double")), F.col("status")).cast("int").alias("status"))
    dealt = blocks_in_order(some, [*keys, "seq", "status"], rows)
    maps = dealt.groupBy(*keys, "block").agg(_composed(F.collect_list(F.struct("seq", "status", _step(F.col("status"), most).alias("m"))), most).alias("m"))
    blocks = max(1, dealt.agg(F.max("block")).first()[0] or 0) + 1
    while blocks > 1:
        blocks = -(-blocks // fan)
        maps = maps.groupBy(*keys, F.floor(F.col("block") / fan).cast("int").alias("block")).agg(_composed(F.collect_list(F.struct(F.col("block").alias("at"), "m")), most).alias("m"))
    return maps.select(*keys, "m")


def _delay(factor: Column, min_delay: float, max_backoff: float) -> Column:
    return F.least(F.greatest(factor * min_delay, F.lit(float(min_delay))), F.lit(float(max_backoff)))


def backoff(events: DataFrame, min_delay: float, max_backoff: float, rows: int = BACKOFF_BLOCK) -> DataFrame:
    """Per job and kind, the back-off factor after all events (seq, status; null: network error) and the delay it gives.

    429 and 503 double it, a network error makes it 1.4 times as large, success takes a quarter off, not below 1; the most
    is max_backoff / min_delay. Nothing is kept of single events but what backoff_maps() makes of them.
    """
    most = max(max_backoff / max(min_delay, 1.0), 1.0)
    factor = _clamp(F.col("m"), F.lit(1.0))
    return backoff_maps(events, most, rows).select("job_id", "kind", factor.alias("factor"), _delay(factor, min_delay, max_backoff).alias("delay_ms"))


def backoff_stream(events: DataFrame, min_delay: float, max_backoff: float) -> DataFrame:
    """The streaming twin: the factor after each micro-batch, per job and kind; state is the map of all events so far, three
    numbers per key. A micro-batch's events of a key are taken in order of seq."""
    most = max(max_backoff / max(min_delay, 1.0), 1.0)

    def step(status: float | None) -> tuple[float, float]:
        if status is None or status != status:
            return 1.4, 0.0
        return (2.0, 0.0) if status in (429, 503) else (0.75, 1.0) if 200 <= status < 400 else (1.0, 0.0)

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        times, low, high = state.get if state.exists else (1.0, 0.0, most)
        rows = pd.concat([f[["seq", "status"]] for f in frames]).sort_values("seq")
        for s in rows["status"]:
            a, least = step(s)
            times, low, high = a * times, min(most, max(least, a * low)), min(most, max(least, a * high))
        state.update((times, low, high))
        factor = min(high, max(low, times))
        yield pd.DataFrame({"job_id": [key[0]], "kind": [key[1]], "factor": [factor], "delay_ms": [min(max(factor * min_delay, min_delay), max_backoff)]})

    return events.groupBy("job_id", "kind").applyInPandasWithState(run, "job_id long, kind string, factor double, delay_ms double", "times double, low double, high double", "update", GroupStateTimeout.NoTimeout)


def stream_logs(logs: DataFrame, level: str = "info", categories: list[str] | None = None, q: str = "") -> DataFrame:
    """A log stream, filtered as filter_logs() does; to be appended."""
    return reports.filter_logs(logs, level, categories, q)


def append_batch(path: str) -> Callable[[DataFrame, int], None]:
    """Writes a micro-batch to a folder of its own number, in place of what is there: a batch that is played again changes nothing."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def append_logs(logs: DataFrame, path: str, checkpoint: str) -> None:
    """Appends a log stream to path to its end, each line once whatever fails in between."""
    logs.writeStream.foreachBatch(append_batch(path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
