"""The first row per id of a stream, by event time and not by arrival, with state that ends.

Per id the earliest row so far is held until the watermark has passed its time, when no earlier one can come any
more; then it is given out. A mark stays behind for as long as rows of one id may lie apart, so that later copies
are dropped; after that nothing of the id is left. Any order of arrival within the lateness gives the same rows.
Rows behind the watermark are late: they are dropped and counted by the stream (``late_rows``).

Ids are dealt by hash to ``GROUPS`` groups. The state of a group is one table of its ids, which a batch that has rows
of the group reads, merges and writes as a whole, and one timer for what is due next; so calls to the state store
grow with the groups and not with the ids. A task holds one group at a time: a ``GROUPS``-th of the rows held.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Groups of ids; a checkpoint belongs to one number of them.
GROUPS = 2048
FRESH = pa.schema([("id_key", pa.string()), ("at_ms", pa.int64()), ("row_json", pa.string())])
HELD = FRESH.append(pa.field("given", pa.bool_()))


class KeepFirst(StatefulProcessor):
    """State of one group of ids: the first row of each as JSON and its time, or, with the row given out, the time alone."""

    def __init__(self, spread_ms: int) -> None:
        self.spread_ms = spread_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.group = handle.getValueState("group", "due long, ids binary")

    def _read(self) -> tuple[int | None, pa.Table]:
        if not self.group.exists():
            return None, HELD.empty_table()
        due, ids = self.group.get()
        return due, pa.ipc.open_stream(ids).read_all()

    def _write(self, before: int | None, held: pa.Table) -> None:
        """Store the ids of the group, and have a timer at the time when the first of them is due."""
        due = None
        if held.num_rows:
            until = pc.add(held["at_ms"], pc.if_else(held["given"], self.spread_ms, 0))
            due = pc.min(until).as_py()
            out = pa.BufferOutputStream()
            with pa.ipc.new_stream(out, HELD) as writer:
                writer.write_table(held)
            self.group.update((due, out.getvalue().to_pybytes()))
        else:
            self.group.clear()
        if due != before:
            if before is not None:
                self.handle.deleteTimer(before)
            if due is not None:
                self.handle.registerTimer(due)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        due, held = self._read()
        names = HELD.names[:-1]
        come = pa.concat_tables([pa.Table.from_pandas(x[names], FRESH, preserve_index=False) for x in rows])
        given, waiting = held.filter(held["given"]), held.filter(pc.invert(held["given"]))
        # copies of a row given out before count no more
        come = come.filter(pc.invert(pc.is_in(come["id_key"], given["id_key"])))
        both = pa.concat_tables([waiting.select(names), come]).sort_by([(name, "ascending") for name in names])
        ids = both["id_key"].combine_chunks()
        firsts = pa.concat_arrays([pa.array([True] * min(len(ids), 1), pa.bool_()), pc.not_equal(ids[1:], ids[:-1])])
        both = both.filter(firsts)
        fresh = both.append_column(HELD.field("given"), pa.array(np.zeros(both.num_rows, bool)))
        self._write(due, pa.concat_tables([given, fresh]))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due, held = self._read()
        passed = timerValues.getCurrentWatermarkInMs()
        ready = pc.and_(pc.invert(held["given"]), pc.less_equal(held["at_ms"], passed))
        found = held.filter(ready)["row_json"].to_pandas()
        given = pc.or_(held["given"], ready)
        marked = pa.table([held["id_key"], held["at_ms"], pc.if_else(ready, "", held["row_json"]), given], schema=HELD)
        over = pc.and_(given, pc.less_equal(pc.add(held["at_ms"], self.spread_ms), passed))
        self._write(due, marked.filter(pc.invert(over)))
        if len(found):
            yield pd.DataFrame({"row_json": found})

    def close(self) -> None:
        pass


def first_rows(
    messages: DataFrame, lateness: str = "1 day", spread_hours: int = 24, key: str = "msg_id", time: str = "create_time"
) -> DataFrame:
    """The rows of a stream that are the first of their id, each once the watermark has passed it.

    Of rows with one id and time the one whose JSON text is smallest counts. Rows of one id are taken to
    lie at most ``spread_hours`` apart. Rows without id or time are dropped.
    """
    schema = messages.schema
    rows = messages.where(F.col(key).isNotNull() & F.col(time).isNotNull()).withWatermark(time, lateness)
    shaped = rows.select(
        F.col(key).cast("string").alias("id_key"), time, F.unix_millis(time).alias("at_ms"),
        F.to_json(F.struct(*schema.names), {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}).alias("row_json"),
    )
    dealt = shaped.withColumn("id_group", F.pmod(F.xxhash64("id_key"), F.lit(GROUPS)).cast("int"))
    kept = dealt.groupBy("id_group").transformWithStateInPandas(
        statefulProcessor=KeepFirst(spread_hours * 3_600_000), outputStructType="row_json string",
        outputMode="append", timeMode="EventTime",
    )
    parsed = F.from_json("row_json", schema, {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"})
    return kept.select(parsed.alias("r")).select("r.*")


def start(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write a stream with state to Parquet as far as data is there; its state is kept by RocksDB."""
    spark = rows.sparkSession
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        return (
            rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start()
        )
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


def late_rows(query: StreamingQuery) -> int:
    """Rows that came behind the watermark, over the batches this query still remembers."""
    states: Sequence = [state for progress in query.recentProgress for state in progress.stateOperators]
    return sum(state.numRowsDroppedByWatermark for state in states)


def held_rows(query: StreamingQuery) -> int:
    """Rows of state after the last batch: groups that hold ids, and their timers."""
    states = [progress.stateOperators[0] for progress in query.recentProgress if progress.stateOperators]
    return states[-1].numRowsTotal if states else 0
