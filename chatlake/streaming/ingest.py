"""Incremental ingestion of landing files into the message table."""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from datetime import date

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from chatlake import schemas
from chatlake.functions import clean
from chatlake.operators import cleaning, state
from chatlake.operators.shaping import counted, rows_seen
from chatlake.operators.skew import keep_first_by_place
from chatlake.session import cut_lineage, scratch_path
from chatlake.sources import jsonl, lake
from chatlake.sources.growing import stream_growing

DAY = schemas.PARTITION_COLUMNS


def stream_lines(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """Lines of landing files as a stream. A file is read once, so landing files must be
    complete when they appear; lines added to a file later are not seen."""
    lines = (
        spark.readStream.schema("value string")
        .option("maxFilesPerTrigger", files_per_trigger)
        .option("recursiveFileLookup", "true")
        .text(path)
    )
    return lines.select("value", F.col("_metadata.file_path").alias("source_file"))


def judged(lines: DataFrame) -> DataFrame:
    """Each line once: its typed row with day, file and order, or why it is refused (with the line)."""
    placed = lines.withColumn("_order", F.monotonically_increasing_id()).withColumn("line", F.col("value"))
    rows = cleaning.judge_lines(placed)
    good = F.col("error_type").isNull()
    # the time of a refused line may not fit a timestamp
    times = F.when(good, F.timestamp_seconds("create_time"))
    rows = rows.withColumns({"create_time": times, "line": F.when(~good, F.col("line"))})
    extra = [("source_file", T.StringType()), ("_order", T.LongType()), ("error_type", T.StringType()),
             ("missing_fields", T.StringType()), ("line", T.StringType())]
    schema = T.StructType([*schemas.MESSAGES.fields, *[T.StructField(*pair) for pair in extra]])
    return cleaning.with_day(cleaning.conform(rows, schema))


def days_of(batch: DataFrame) -> list[date]:
    """The days of a batch: as many values as it has days."""
    return [row["day_"] for row in batch.select(F.make_date(*DAY).alias("day_")).distinct().collect()]


def in_days(stored: DataFrame, days: list[date]) -> DataFrame:
    """Stored rows of these days; folders of other days are not read, also not those between them."""
    if not days:
        return stored.filter(F.lit(False))
    # as one text: a literal of its own for each day takes longer than reading the day
    named = ", ".join(f"date'{day.isoformat()}'" for day in days)
    return stored.filter(f"make_date({', '.join(DAY)}) in ({named})")


def unseen(batch: DataFrame, stored: DataFrame | None, days: list[date]) -> DataFrame:
    """Rows whose id is not yet stored under their day; ``days`` are those of the batch."""
    if stored is None:
        return batch
    ids = lake.in_larger_tasks(in_days(stored, days).select(*DAY, "msg_id"), stored)
    return batch.join(ids, [*DAY, "msg_id"], "left_anti")


def not_written(batch: DataFrame, stored: DataFrame | None, days: list[date]) -> DataFrame:
    """Rows that a first attempt at this batch has not stored: equal content, as often as it is there."""
    if stored is None:
        return batch
    content = [name for name in schemas.MESSAGES.names if name != "ingestion_time"]
    same = Window.partitionBy("_content").orderBy("_order")
    marked = batch.withColumn("_content", F.xxhash64(*content))
    counted_ = in_days(stored, days).groupBy(F.xxhash64(*content).alias("_content")).agg(
        F.count(F.lit(1)).alias("_there")
    )
    numbered = marked.join(counted_, "_content", "left").withColumn("_nth", F.row_number().over(same))
    return numbered.filter(F.col("_nth") > F.coalesce("_there", F.lit(0))).drop("_content", "_there", "_nth")


COUNTS = ("total_lines", "blank_lines", "quarantined", "total_processed", "new_records", "duplicates_skipped")


def ingest_batch(
    spark: SparkSession, lines: DataFrame, root: str, deduplicate: bool = True,
    dead_letters: str | None = None, batch_id: int = 0, repeated: bool = False,
) -> dict[str, int]:
    """Land one batch of lines: one parse, good rows to the table, refused lines to ``dead_letters``.

    The first row per day and id is kept, inside the batch and against what is stored, so any cut
    of the lines into batches gives the same table. Every line is accounted for:
    total_lines = blank_lines + quarantined + total_processed, and
    total_processed = new_records + duplicates_skipped.
    A batch that is repeated after a failure adds nothing twice: by id when deduplicating, else
    (``repeated``) by content. Its dead letters replace those of the first attempt.
    """
    staged = scratch_path(spark, "batch")
    with ThreadPoolExecutor(1) as beside:
        # the folders of the table are listed while the lines are judged
        listed = beside.submit(inheritable_thread_target(spark)(lake.read_if_there), spark, root) if deduplicate or repeated else None
        judged(lines).write.parquet(staged)
        stored = listed.result() if listed else None
    rows = spark.read.parquet(staged)
    kinds = {
        row["error_type"]: row["count"] for row in rows.groupBy("error_type").count().collect()
    }
    good = rows.filter("error_type is null")
    total = kinds.get(None, 0)
    new = 0
    if total:
        days = [] if stored is None else days_of(good)
        if deduplicate:
            good = unseen(keep_first_by_place(good, [*DAY, "msg_id"], ["source_file", "_order"]), stored, days)
        elif repeated:
            good = not_written(good, stored, days)
        new_rows, added = counted(cleaning.conform(good))
        lake.write_days(new_rows, root, "append", id_filter=True)
        new = rows_seen(added)
    refused = sum(kinds.values()) - total - kinds.get("blank", 0)
    if dead_letters is not None and refused:
        letters = rows.filter("error_type is not null and error_type <> 'blank'").select(
            "source_file", "error_type", "missing_fields", "line",
            F.left("line", F.lit(cleaning.RAW_PREVIEW)).alias("raw"),
            F.current_timestamp().alias("refused_at"), F.lit(batch_id).cast("long").alias("batch_id"),
        )
        (
            letters.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            .partitionBy("batch_id").parquet(dead_letters)
        )
    counts = (sum(kinds.values()), kinds.get("blank", 0), refused, total, new, total - new)
    return dict(zip(COUNTS, counts, strict=True))


@dataclass
class IngestRun:
    """A started stream, and where its batches are accounted for."""

    spark: SparkSession
    query: StreamingQuery
    log: str
    run: str


def batch_log(spark: SparkSession, path: str) -> DataFrame | None:
    """One row per batch and state: run, batch_id, state and the counts of ``ingest_batch``."""
    return lake.read_if_there(spark, path)


def _log_batch(spark: SparkSession, path: str, run: str, batch_id: int, state: str, counts: dict[str, int]) -> None:
    schema = "run string, " + ", ".join(f"{name} long" for name in COUNTS) + ", batch_id long, state string"
    row = (run, *[counts.get(name, 0) for name in COUNTS], batch_id, state)
    (
        spark.createDataFrame([row], schema).coalesce(1).write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id", "state").parquet(path)
    )


def ingest_stream(
    spark: SparkSession, raw_dir: str, root: str, checkpoint: str, deduplicate: bool = True,
    files_per_trigger: int = 1000, dead_letters: str | None = None, growing: bool = False,
) -> IngestRun:
    """Ingest all landing files not ingested before, then stop.

    ``growing`` also reads what is added to files later, whole line by whole line; a checkpoint
    belongs to one of both forms. Spark's checkpoint remembers the files read (or how far). Beside it lie the batch log (a row when a batch
    starts and one when it is done, with its counts) and the dead letters, unless another folder is
    named. A batch that had started but not ended is repeated so that nothing is added twice.
    """
    log = f"{checkpoint.rstrip('/')}-batches"
    letters = dead_letters or f"{checkpoint.rstrip('/')}-dead-letters"
    run = uuid.uuid4().hex

    def land(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        # only the folder of this batch is listed, so a batch costs the same however many there were
        own = batch_log(session, f"{log}/batch_id={batch_id}")
        states = set() if own is None else {row["state"] for row in own.select("state").distinct().collect()}
        if "completed" in states:
            return
        _log_batch(session, log, run, batch_id, "processing", {})
        counts = ingest_batch(session, batch, root, deduplicate, letters, batch_id, "processing" in states)
        _log_batch(session, log, run, batch_id, "completed", counts)

    if growing:
        lines = stream_growing(spark, raw_dir).select("value", "source_file")
    else:
        lines = stream_lines(spark, raw_dir, files_per_trigger)
    query = (
        lines.writeStream.foreachBatch(land)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    return IngestRun(spark, query, log, run)


def run_to_end(started: IngestRun) -> dict[str, int]:
    """Wait for an available-now stream and return its totals, summed over the log of all its batches."""
    started.query.awaitTermination()
    names = ("batches", "lines", *COUNTS)
    known = batch_log(started.spark, started.log)
    if known is None:
        return dict.fromkeys(names, 0)
    done = known.filter((F.col("run") == started.run) & (F.col("state") == "completed"))
    sums = [F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in COUNTS]
    row = done.agg(F.count(F.lit(1)).alias("batches"), *sums).first()
    return {name: int(row["total_lines" if name == "lines" else name]) for name in names}


def ingest_objects(
    spark: SparkSession, objects: DataFrame, root: str, raw_dir: str | None = None,
    checkpoint: str | None = None,
) -> dict[str, int]:
    """Ingest given JSON texts (column ``value``); anything but objects is refused.

    Complete objects are appended as they are. With ``raw_dir`` the objects are first landed
    as a file of the current day and then ingested with everything else that waits there.
    ``incomplete`` counts objects that lack a required field or a valid time.
    """
    parsed = cleaning.parse_lines(objects)
    is_object = clean.members(F.col("doc")).isNotNull()
    refused = parsed.filter(~is_object | F.col("doc").isNull()).count()
    if raw_dir is None:
        given, offered = counted(parsed.filter(is_object).drop("line_kind"))
        rows, seen = counted(cleaning.complete_messages(given))
        lake.write_days(rows, root, "append", id_filter=True)
        new = rows_seen(seen)
        return {"new_records": new, "incomplete": rows_seen(offered) - new, "refused": refused}
    accepted = parsed.filter(is_object).select("value")
    day = F.date_format(F.current_timestamp(), "yyyy-MM-dd").alias("arrival_date")
    accepted.select("value", day).write.mode("append").partitionBy("arrival_date").text(raw_dir)
    if checkpoint is None:
        raise ValueError("a checkpoint folder is needed to ingest from a landing folder")
    totals = run_to_end(ingest_stream(spark, raw_dir, root, checkpoint))
    return totals | {"incomplete": totals["quarantined"], "refused": refused}


def resume_lines(
    spark: SparkSession, path: str, log: DataFrame | None, batch_size: int = 1000
) -> DataFrame:
    """Lines of growing files behind each file's checkpoint, with a batch number.

    ``log`` has ``source_file`` and ``last_processed_line`` in physical lines, so blank and
    malformed lines do not shift the position.
    """
    numbered = jsonl.number_lines(jsonl.read_lines(spark, path))
    if log is not None:
        reached = log.groupBy("source_file").agg(F.max("last_processed_line").alias("_reached"))
        numbered = numbered.join(reached, "source_file", "left").filter(
            F.col("line_no") > F.coalesce("_reached", F.lit(0))
        ).drop("_reached")
    return numbered.withColumn("batch_no", F.floor((F.col("line_no") - 1) / batch_size))


def checkpoint_rows(lines: DataFrame, status: str = "completed") -> DataFrame:
    """Checkpoint rows of files: how far they are read, with the last id and time on the way."""
    last = F.max_by(F.struct("msg_id", "create_time"), F.when(F.col("error_type").isNull(), F.col("line_no")))
    found = cleaning.judge_lines(lines).groupBy("source_file").agg(
        F.max("line_no").alias("last_processed_line"),
        F.count(F.lit(1)).alias("processed_record_count"),
        last.alias("_last"),
    )
    return found.select(
        "source_file", "last_processed_line", "processed_record_count",
        F.col("_last.msg_id").alias("last_processed_msg_id"),
        F.col("_last.create_time").alias("last_processed_timestamp"),
        F.lit(status).alias("status"),
        F.unix_micros(F.current_timestamp()).alias("log_no"),
    )


def ingest_from_checkpoints(
    spark: SparkSession, raw_dir: str, root: str, log: str, deduplicate: bool = True,
    dead_letters: str | None = None,
) -> dict[str, int]:
    """Ingest what lies behind each file's checkpoint, and write the checkpoints on the way.

    A file is ``processing`` (at its old line) while it is read, then ``completed`` at its new one,
    or ``failed`` at the old one if the batch could not be stored; a failed file is read again.
    """
    known = lake.read_if_there(spark, log)
    lines = resume_lines(spark, raw_dir, known)

    def mark(status: str) -> None:
        rows = open_files.withColumns(
            {
                "processed_record_count": F.lit(0).cast("long"),
                "last_processed_msg_id": F.lit(None).cast("string"),
                "last_processed_timestamp": F.lit(None).cast("long"),
                "status": F.lit(status),
                "log_no": F.unix_micros(F.current_timestamp()),
            }
        )
        state.append_log(rows, log)

    # the lines as they are now; what is added to the files meanwhile waits for the next run
    taken = cut_lineage(lines)
    open_files = cut_lineage(
        taken.groupBy("source_file").agg((F.min("line_no") - 1).alias("last_processed_line"))
    )
    mark("processing")
    try:
        counts = ingest_batch(spark, taken.select("value", "source_file"), root, deduplicate, dead_letters)
    except Exception:
        mark("failed")
        raise
    state.append_log(checkpoint_rows(taken), log)
    return counts


def stream_unique(messages: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Drop repeated ids inside a stream, with state bounded by the watermark."""
    return messages.withWatermark("create_time", lateness).dropDuplicatesWithinWatermark(["msg_id"])
