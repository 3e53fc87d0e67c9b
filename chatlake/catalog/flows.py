"""Incremental ingestion, streams, recorded pages and lineage."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatlake.catalog.reading import _CLEAN_LINES
from chatlake.catalog.registry import message_lake, query
from chatlake.operators import state
from chatlake.plans import lineage
from chatlake.session import scratch_path
from chatlake.sources import growing, lake, recorded
from chatlake.sources.adapters import Tables
from chatlake.streaming import activity, first, ingest

# Every id that survives cleaning, once.
_LANDED_ONCE = _CLEAN_LINES + """
select msg_id, any_value(cast(create_time as bigint)) as create_epoch from m
where coalesce(msg_id, '') <> '' and coalesce(create_time, '') <> '' group by 1
"""


def _landing(t: Tables, part: str, lines: DataFrame | None = None) -> str:
    """Six rolled landing files; some lines come again in the next file."""
    path = scratch_path(t.spark, f"landing_{part}")
    lines = t.fx_raw_lines if lines is None else lines
    again = lines.filter("line_no % 10 = 3")
    both = lines.select("value", (F.col("line_no") % 6).alias("roll")).unionByName(
        again.select("value", ((F.col("line_no") + 1) % 6).alias("roll"))
    )
    both.repartition("roll").write.partitionBy("roll").text(path)
    return path


def _stored(t: Tables, root: str) -> DataFrame:
    rows = lake.read_lake(t.spark, root)
    return rows.select("msg_id", F.unix_timestamp("create_time").alias("create_epoch"))


@query("R01_stream_ingest", _LANDED_ONCE)
def stream_ingest(t: Tables) -> DataFrame:
    raw, root, mark = _landing(t, "all"), scratch_path(t.spark, "ingested"), scratch_path(t.spark, "mark")
    ingest.run_to_end(ingest.ingest_stream(t.spark, raw, root, mark, files_per_trigger=4))
    ingest.run_to_end(ingest.ingest_stream(t.spark, raw, root, mark, files_per_trigger=4))
    return _stored(t, root)


@query("R01_growing_files", _LANDED_ONCE)
def growing_files(t: Tables) -> DataFrame:
    """The landing files as they are after a third of all lines, after two thirds and at last; one run after each."""
    raw, root, mark = (scratch_path(t.spark, name) for name in ("growing", "grown", "mark"))
    lines = t.fx_raw_lines.select("value", "line_no", F.concat(F.lit("roll_"), F.col("line_no") % 6).alias("file"))
    again = F.concat(F.lit("roll_"), (F.col("line_no") + 1) % 6).alias("file")
    both = lines.unionByName(lines.filter("line_no % 10 = 3").select("value", "line_no", again))
    last = lines.agg(F.max("line_no")).first()[0] or 0
    for part in (1, 2, 3):
        growing.land_lines(both.filter(F.col("line_no") * 3 <= last * part), raw, "file", "line_no")
        ingest.run_to_end(ingest.ingest_stream(t.spark, raw, root, mark, growing=True))
    return _stored(t, root)


@query("R02_batch_step", _LANDED_ONCE)
def batch_step(t: Tables) -> DataFrame:
    root = scratch_path(t.spark, "stepped")
    lines = t.fx_raw_lines.withColumn("source_file", F.lit("f"))
    ingest.ingest_batch(t.spark, lines.filter("line_no % 2 = 0"), root)
    ingest.ingest_batch(t.spark, lines, root)
    return _stored(t, root)


# Each line of the landing files (some come twice) by what becomes of it.
_ACCOUNTS = _CLEAN_LINES + """
, f as (
  select line_no, coalesce(trim(value), '') = '' as blank,
         case when json_valid(value) then 0 else 1 end as bad,
         case when line_no % 10 = 3 then 2 else 1 end as times
  from fx_raw_lines_checked
), a as (
  select f.*, msg_id, coalesce(msg_id, '') = '' or coalesce(create_time, '') = '' as lacking,
         coalesce(try_cast(coalesce(msg_type, '0') as double) = floor(try_cast(coalesce(msg_type, '0') as double)), false) as good
  from f left join m using (line_no)
)
select sum(times)::bigint as total_lines, sum(times) filter (where blank)::bigint as blank_lines,
       sum(times) filter (where not blank and bad = 1)::bigint as parse_errors,
       sum(times) filter (where not blank and bad = 0 and lacking)::bigint as schema_errors,
       sum(times) filter (where not blank and bad = 0 and not lacking and not good)::bigint as validation_errors,
       sum(times) filter (where not blank and bad = 0 and not lacking and good)::bigint as total_processed,
       count(distinct msg_id) filter (where not blank and bad = 0 and not lacking and good) as new_records
from a
"""


@query("R01_ingest_accounts", _ACCOUNTS.replace("fx_raw_lines_checked", "fx_lines").replace("from fx_raw_lines", "from fx_lines"))
def ingest_accounts(t: Tables) -> DataFrame:
    """All lines of all batches, and the dead letters by kind."""
    raw, root, mark = _landing(t, "accounts", lines=t.fx_lines), scratch_path(t.spark, "counted"), scratch_path(t.spark, "mark")
    totals = ingest.run_to_end(ingest.ingest_stream(t.spark, raw, root, mark, files_per_trigger=2))
    letters = t.spark.read.parquet(f"{mark}-dead-letters")
    kinds = letters.agg(
        *[F.count_if(F.col("error_type") == k).alias(f"{k}s") for k in ("parse_error", "schema_error", "validation_error")]
    )
    counted = [F.lit(totals[n]).cast("long").alias(n) for n in ("total_lines", "blank_lines", "total_processed", "new_records")]
    return kinds.select("*", *counted)


@query(
    "R02_any_batch_cut",
    _CLEAN_LINES + "select cut, count(distinct msg_id) as stored, count(distinct msg_id) as ids from m, "
    "(select unnest([1, 3, 7]) as cut) where coalesce(msg_id, '') <> '' and coalesce(create_time, '') <> '' group by 1",
)
def any_batch_cut(t: Tables) -> DataFrame:
    """The same lines, some of them twice, in one, three and seven batches: one table.

    Batches of one table follow each other; the three tables are filled side by side, so that the jobs of one
    run while another lists folders or moves its files into place.
    """
    lines = t.fx_raw_lines.select("value", "line_no").withColumn("source_file", F.lit("f"))
    lines = lines.unionByName(lines.filter("line_no % 10 = 3").withColumn("line_no", F.col("line_no") + 5))
    roots = {cut: scratch_path(t.spark, f"cut_{cut}") for cut in (1, 3, 7)}

    def fill(cut: int) -> DataFrame:
        for part in range(cut):
            ingest.ingest_batch(t.spark, lines.filter(F.col("line_no") % cut == part).select("value", "source_file"), roots[cut])
        table = lake.read_lake(t.spark, roots[cut])
        return lake.in_larger_tasks(table.select("msg_id"), table).agg(
            F.lit(cut).alias("cut"), F.count(F.lit(1)).alias("stored"), F.countDistinct("msg_id").alias("ids")
        )

    with ThreadPoolExecutor(len(roots)) as side_by_side:
        # the table of most batches first, since it is the last to be done
        filled = [side_by_side.submit(inheritable_thread_target(t.spark)(fill), cut) for cut in sorted(roots, reverse=True)]
        return reduce(DataFrame.unionByName, [table.result() for table in filled])


@query(
    "M09_written_checkpoints",
    "select 'completed' as status, (select count(*) from fx_raw_lines) + (select count(*) from fx_raw_lines where line_no % 10 = 3) as lines, "
    "6 as files, 6 as started",
)
def written_checkpoints(t: Tables) -> DataFrame:
    """State of the landing files after a run from checkpoints."""
    raw, root, log = _landing(t, "marked"), scratch_path(t.spark, "marked"), scratch_path(t.spark, "checkpoints")
    ingest.ingest_from_checkpoints(t.spark, raw, root, log)
    rows = t.spark.read.parquet(log)
    started = rows.filter("status = 'processing'").select("source_file").distinct().count()
    current = state.latest(rows, ["source_file"], ["log_no"])
    return current.groupBy("status").agg(
        F.sum("last_processed_line").alias("lines"), F.count(F.lit(1)).cast("int").alias("files"), F.lit(started).alias("started")
    )


@query("R02_resumed_file", _LANDED_ONCE)
def resumed_file(t: Tables) -> DataFrame:
    root, raw = scratch_path(t.spark, "resumed"), _landing(t, "resumed")
    first = ingest.resume_lines(t.spark, raw, None, 500)
    log = ingest.checkpoint_rows(first.filter("line_no <= 700"))
    path = scratch_path(t.spark, "log")
    state.append_log(log, path)
    ingest.ingest_batch(t.spark, first.filter("line_no <= 700").select("value", "source_file"), root)
    rest = ingest.resume_lines(t.spark, raw, state.read_log(t.spark, path), 500)
    ingest.ingest_batch(t.spark, rest.select("value", "source_file"), root)
    return _stored(t, root)


@query("R03_stream_unique", "select msg_id from fx_messages")
def stream_unique(t: Tables) -> DataFrame:
    raw = message_lake(t, "fx_duplicates")
    out, mark = scratch_path(t.spark, "unique"), scratch_path(t.spark, "mark")
    rows = t.spark.readStream.schema("msg_id string, create_time timestamp").parquet(raw)
    stream = (
        ingest.stream_unique(rows.select("msg_id", "create_time"), "40 days")
        .writeStream.format("parquet").option("path", out).option("checkpointLocation", mark)
        .trigger(availableNow=True).start()
    )
    stream.awaitTermination()
    return t.spark.read.parquet(out).select("msg_id")


@query("R03_first_by_state", "select msg_id from fx_messages")
def first_by_state(t: Tables) -> DataFrame:
    """Each id once, held as state until the watermark has passed it; a closing row far ahead moves the watermark."""
    raw, out, mark = (scratch_path(t.spark, name) for name in ("arriving", "first", "mark"))
    rows = t.fx_duplicates.select("msg_id", "create_time")
    rows.write.parquet(raw)
    closing = rows.agg((F.max("create_time") + F.expr("interval 400 days")).alias("create_time"))
    closing.where("create_time is not null").select(F.lit("closing").alias("msg_id"), "create_time").write.mode("append").parquet(raw)
    stream = t.spark.readStream.schema("msg_id string, create_time timestamp").parquet(raw)
    first.start(first.first_rows(stream, "40 days", 24 * 40), out, mark).awaitTermination()
    return t.spark.read.schema("msg_id string").parquet(out).where("msg_id <> 'closing'")


@query(
    "R04_directory_run",
    _CLEAN_LINES + "select count(distinct msg_id) as stored, (select count(*) + count(*) filter (where line_no % 10 = 3) from fx_raw_lines) as lines "
    "from m where coalesce(msg_id, '') <> '' and coalesce(create_time, '') <> ''",
)
def directory_run(t: Tables) -> DataFrame:
    raw, root, mark = _landing(t, "dir"), scratch_path(t.spark, "dumped"), scratch_path(t.spark, "mark")
    totals = ingest.run_to_end(ingest.ingest_stream(t.spark, raw, root, mark))
    stored = lake.read_lake(t.spark, root)
    return stored.agg(F.count(F.lit(1)).alias("stored"), F.lit(totals["lines"]).cast("long").alias("lines"))


_HOURLY = """
select cast(epoch(date_trunc('hour', create_time)) as bigint) as window_epoch, chatroom, count(*) as messages from fx_messages group by 1, 2
"""


@query("R05_hourly_activity", _HOURLY)
def hourly_activity(t: Tables) -> DataFrame:
    rows = activity.activity(t.fx_messages)
    return rows.select(F.unix_timestamp("window_start").alias("window_epoch"), "chatroom", "messages")


@query("R05_streamed_activity", _HOURLY)
def streamed_activity(t: Tables) -> DataFrame:
    out, mark = scratch_path(t.spark, "activity"), scratch_path(t.spark, "mark")
    rows = t.spark.readStream.schema("msg_id string, chatroom string, create_time timestamp").parquet(message_lake(t))
    activity.upsert_activity(rows, out, mark, lateness="40 days").awaitTermination()
    stored = activity.current_activity(t.spark.read.parquet(out))
    return stored.select(F.unix_timestamp("window_start").alias("window_epoch"), "chatroom", "messages")


@query(
    "D07_write_lineage",
    "select 'events' as source_path, 'parquet' as target_type, 'ingest' as operation, count(*) as record_count from fx_messages",
)
def write_lineage(t: Tables) -> DataFrame:
    log, out = scratch_path(t.spark, "lineage"), scratch_path(t.spark, "copied")
    rows = t.fx_messages.withColumnRenamed("descr", "desc")
    lineage.write_with_lineage(rows, out, log, "events", "parquet", "ingest")
    return t.spark.read.parquet(log).select("source_path", "target_type", "operation", "record_count")


@query(
    "X04_recorded_pages",
    "select c_nationkey, count(*) as records from customer group by 1",
)
def recorded_pages(t: Tables) -> DataFrame:
    out = scratch_path(t.spark, "pages")
    # a page is bounded: customers of one nation and a thousand keys
    page = F.concat_ws("_", "c_nationkey", F.floor(F.col("c_custkey") / 1000)).alias("page_key")
    one = t.table("customer").select(page, F.struct("c_custkey", "c_nationkey").alias("record"))
    pages = one.groupBy("page_key").agg(F.to_json(F.collect_list("record")).alias("value"))
    pages.repartition("page_key").write.partitionBy("page_key").text(out)
    rows = recorded.read_pages(t.spark, out, ".txt")
    nation = F.get_json_object("record", "$.c_nationkey").cast("int").alias("c_nationkey")
    return rows.groupBy(nation).agg(F.count(F.lit(1)).alias("records"))
