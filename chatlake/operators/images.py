"""Image assets: extraction from messages, and their state as an event log.

State changes are appended as events and never updated in place; the current table is
computed from the log, per image and with map-side combine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatlake import schemas
from chatlake.functions import xml
from chatlake.operators.shaping import evaluate_once
from chatlake.operators.skew import keep_first
from chatlake.operators.state import append_log, completed_files
from chatlake.session import cut_lineage, scratch_path
from chatlake.sources import files
from chatlake.sources.lake import read_if_there, read_lake, write_days

STATUSES = ["pending", "downloading", "completed", "failed"]


def new_image_id(msg_id: Column) -> Column:
    """A repeatable id in the form of a UUID, derived from the message id."""
    digest = F.sha2(msg_id, 256)
    parts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat_ws("-", *[F.substring(digest, start, size) for start, size in parts])


def image_messages(messages: DataFrame) -> DataFrame:
    """Messages whose content is an encrypted image, with its fields."""
    content = F.trim(F.regexp_replace("content", r"^\s+|\s+$", ""))
    # an encrypted image must spell this attribute, so other rows are not parsed at all
    likely = messages.filter(F.col("content").contains("encryver") & (F.coalesce("msg_id", F.lit("")) != ""))
    trimmed = likely.withColumn("_text", content)
    parsed = evaluate_once(trimmed, {"_doc": xml.parse(F.col("_text"))})
    info = xml.image_info(F.col("_doc"), F.col("_text"))
    found = evaluate_once(parsed, {"_image": info}).filter(F.col("_image").isNotNull())
    return found.select(*messages.columns, "_image.*")


def extract_images(messages: DataFrame, from_username: str, images: DataFrame) -> DataFrame:
    """Image of each image message of a sender: the known one, or a new pending one."""
    own = image_messages(messages.filter(F.col("from_username") == from_username))
    single = keep_first(
        own.select("msg_id", "from_username", "create_time", "aes_key", "cdn_mid_img_url"),
        ["msg_id"],
        ["create_time", "aes_key", "cdn_mid_img_url"],
    )
    known = images.select("msg_id", F.col("image_id").alias("_known"))
    joined = single.join(known, "msg_id", "left")
    return joined.select(
        F.coalesce("_known", new_image_id(F.col("msg_id"))).alias("image_id"),
        *single.columns,
        F.col("_known").isNull().alias("is_new"),
        F.lit("pending").alias("status"),
    )


def insertable(candidates: DataFrame, images: DataFrame) -> DataFrame:
    """Candidate images whose message is not in the table yet, one per message."""
    single = keep_first(candidates, ["msg_id"], ["image_id"])
    return single.join(images.select("msg_id"), "msg_id", "left_anti")


def rewrite_content(
    messages: DataFrame,
    mapping: DataFrame,
    id_column: str = "msg_id",
    content_column: str = "content",
    pattern: str = "image#%s",
) -> DataFrame:
    """Replace the content of mapped rows; ``mapping`` has the id column and ``value``."""
    text = F.format_string(pattern, F.col("_value"))
    mapped = mapping.select(id_column, F.col("value").alias("_value"))
    joined = messages.join(mapped, id_column, "left")
    content = F.when(F.col("_value").isNotNull(), text).otherwise(F.col(content_column))
    return joined.withColumn(content_column, content).select(*messages.columns)


def _files_of(spark: SparkSession, root: str, days: DataFrame) -> DataFrame:
    """Files of the given days, with their day and size."""
    listed = files.list_files(spark, root).withColumn("_p", files.parse_path(F.col("file_path")))
    placed = listed.select("file_path", "file_size", "_p.*")
    return placed.join(days, schemas.PARTITION_COLUMNS, "left_semi")


def rewrite_days(
    spark: SparkSession, root: str, mapping: DataFrame, days: DataFrame | None = None,
    layout: T.StructType | None = None,
) -> DataFrame:
    """Rewrite mapped content in place, in the days that hold a mapped row.

    ``days`` (year, month, day) names these days where they are known, so that only they are read.
    The new rows are staged in full before they replace the days read; if files of these days have
    come or gone meanwhile, nothing is replaced and the job fails. Returns the days whose rows are
    afterwards exactly those written, and the number of their rows.
    """
    day = schemas.PARTITION_COLUMNS
    layout = layout or read_lake(spark, root).schema
    lake = spark.read.schema(layout).parquet(root)
    if days is None:
        days = lake.join(mapping.select("msg_id"), "msg_id", "left_semi").select(*day).distinct()
    touched = cut_lineage(days.select(*day).distinct())
    nothing = spark.createDataFrame([], "year int, month int, day int, rows long")
    date = F.make_date(*day)
    # named one by one, so that no file of a day between them is opened
    wanted_days = [row["date"] for row in touched.select(date.alias("date")).collect()]
    if not wanted_days:
        return nothing
    before = cut_lineage(_files_of(spark, root, touched).select("file_path", "file_size"))
    near = lake.filter(date.isin(wanted_days))
    staged = scratch_path(spark, "rewrite")
    write_days(rewrite_content(near.join(touched, day, "left_semi"), mapping).drop(*day), staged, "overwrite")
    rewritten = read_if_there(spark, staged)
    if rewritten is None:
        return nothing
    now = _files_of(spark, root, touched).select("file_path", "file_size")
    if now.exceptAll(before).unionByName(before.exceptAll(now)).take(1):
        raise RuntimeError("files of the days to rewrite have changed; nothing was replaced")
    write_days(rewritten.drop(*day), root, "overwrite")
    wanted = rewritten.groupBy(*day).agg(F.count(F.lit(1)).alias("rows"))
    found = spark.read.schema(layout).parquet(root).filter(date.isin(wanted_days))
    stored = found.groupBy(*day).agg(F.count(F.lit(1)).alias("rows"))
    return cut_lineage(wanted.join(stored, [*day, "rows"], "left_semi"))


def extract_all(
    spark: SparkSession, root: str, image_log: str, checkpoint_log: str, from_username: str,
    update_content: bool = True, dry_run: bool = False,
) -> DataFrame:
    """Extract images from every file this sender has not completed; returns the counters.

    One distributed pass: pick files, extract, register new images, rewrite content, and mark files.
    Only the days of open files are read, once. A file whose footer cannot be read, or of which fewer
    rows can be read than its footer names, is marked ``failed`` with the error, gives no images and is
    tried again in the next run; the others are ``completed`` with their number of images. Files that the rewrite wrote are completed as well, unless rows came to their day meanwhile.
    """
    day = schemas.PARTITION_COLUMNS
    listed = files.list_files(spark, root).select(F.col("file_path").alias("parquet_file"), "file_size")
    marks, log = read_if_there(spark, checkpoint_log), read_if_there(spark, image_log)
    nothing = spark.createDataFrame([], "image_id string, msg_id string, parquet_file string")
    done = nothing.select("parquet_file") if marks is None else completed_files(marks, from_username)
    known = nothing if log is None else current_images(log)
    # the list is needed again after the files themselves have been replaced
    todo = cut_lineage(listed.join(done, "parquet_file", "left_anti"))
    facts = files.read_footers(todo.withColumnRenamed("parquet_file", "file_path"))
    judged = cut_lineage(facts.select(F.col("file_path").alias("parquet_file"), "readable", "error", "row_count"))
    likely = judged.filter("readable")
    opened = likely.select(files.parse_path(F.col("parquet_file")).alias("_p")).select("_p.*")
    date = F.make_date(*day)
    span = opened.agg(F.min(date).alias("first"), F.max(date).alias("last")).first()
    # a broken footer is a finding of this run, not the end of it
    some = likely.first()
    fields = spark.read.parquet(some["parquet_file"]).schema.fields if some else schemas.MESSAGES.fields
    layout = T.StructType([*fields, *[T.StructField(name, T.IntegerType()) for name in day]])
    lake = spark.read.schema(layout).option("ignoreCorruptFiles", "true").parquet(root)
    rows = lake.filter(date.between(F.lit(span["first"]), F.lit(span["last"])))
    placed = rows.select("*", F.col("_metadata.file_path").alias("parquet_file"))
    # damage inside a file ends its rows early; extraction and count come from one and the same read
    sent = (F.col("from_username") == from_username) & F.col("content").contains("encryver")
    image = F.when(sent, F.struct("from_username", "create_time", "content"))
    kept = ["parquet_file", *day, "msg_id", image.alias("_image")]
    if update_content:  # rewriting reads every column, so every column has to be readable
        hashed = [f.name for f in fields if f.dataType.typeName() not in ("map", "variant")]
        kept.append((F.xxhash64(*hashed) % 2 == 0).alias("_read"))
    staged = cut_lineage(placed.join(likely.select("parquet_file"), "parquet_file", "left_semi").select(*kept))
    read = staged.groupBy("parquet_file").agg(F.count(F.lit(1)).alias("_rows"))
    held = likely.join(read, "parquet_file", "left").withColumn("_rows", F.coalesce("_rows", F.lit(0)))
    held = cut_lineage(held.select("parquet_file", "row_count", "_rows"))
    short = F.format_string("read %d of %d rows", "_rows", "row_count").alias("error")
    good = held.filter("_rows = row_count").select("parquet_file")
    bad = judged.filter("not readable").select("parquet_file", "error").unionByName(
        held.filter("_rows != row_count").select("parquet_file", short)
    )
    total, scanned, failed = listed.count(), good.count(), bad.count()
    open_rows = staged.join(good, "parquet_file", "left_semi")
    sent_rows = open_rows.filter("_image is not null").select("msg_id", "_image.*")
    found = cut_lineage(extract_images(sent_rows, from_username, known))
    where = open_rows.join(found.select("msg_id"), "msg_id", "left_semi")
    # a day with a broken file is not rewritten, since the file would go with it; its files stay open
    broken_days = bad.select(files.parse_path(F.col("parquet_file")).alias("_p")).select("_p.*").distinct()
    placed_good = good.withColumn("_p", files.parse_path(F.col("parquet_file"))).select("parquet_file", "_p.*")
    if update_content:
        placed_good = placed_good.join(broken_days, day, "left_anti")
    per_file = where.groupBy("parquet_file").agg(F.count_distinct("msg_id").alias("images"))
    marked = cut_lineage(
        placed_good.join(per_file, "parquet_file", "left").select(
            "parquet_file", F.lit("completed").alias("status"), F.coalesce("images", F.lit(0)).alias("total_images_extracted"),
            F.lit("").alias("error_message"),
        ).unionByName(
            bad.select(
                "parquet_file", F.lit("failed").alias("status"), F.lit(0).cast("long").alias("total_images_extracted"),
                F.col("error").alias("error_message"),
            )
        )
    )
    extracted = found.filter("is_new").count()
    if not dry_run:
        append_log(creation_events(found.filter("is_new")), image_log)
        if update_content:
            mapping = found.select("msg_id", F.col("image_id").alias("value"))
            days = where.select(*day).distinct().join(broken_days, day, "left_anti")
            whole = rewrite_days(spark, root, mapping, days, layout)
            fresh = _files_of(spark, root, whole.select(*day)).select(F.col("file_path").alias("parquet_file"))
            marked = marked.unionByName(
                fresh.join(marked, "parquet_file", "left_anti").select(
                    "parquet_file", F.lit("completed").alias("status"), F.lit(0).cast("long").alias("total_images_extracted"),
                    F.lit("").alias("error_message"),
                )
            )
        append_log(
            marked.withColumns(
                {"from_username": F.lit(from_username), "log_no": F.unix_micros(F.current_timestamp())}
            ),
            checkpoint_log,
        )
    return spark.createDataFrame(
        [(scanned, extracted, total - scanned - failed, failed)],
        "files_scanned long, images_extracted long, files_skipped long, files_failed long",
    )


# -- events -------------------------------------------------------------------------------

EVENTS = schemas.table_of(
    "image_id string, event_no long, kind string, msg_id string, from_username string, "
    "status string, download_url string, error_message string, has_text boolean, "
    "ocr_content string, at timestamp"
)


def _event(df: DataFrame, kind: str, **fields: Column) -> DataFrame:
    now = F.current_timestamp()
    given = {"kind": F.lit(kind), "event_no": F.unix_micros(now), "at": now, **fields}
    columns = []
    for field in EVENTS.fields:
        if field.name in given:
            value = given[field.name]
        elif field.name in ("image_id", "msg_id", "from_username") and field.name in df.columns:
            value = F.col(field.name)
        else:
            value = F.lit(None)
        columns.append(value.cast(field.dataType).alias(field.name))
    return df.select(*columns)


def creation_events(images: DataFrame) -> DataFrame:
    return _event(images, "status", status=F.lit("pending"))


def status_events(
    images: DataFrame, status: Column, download_url: Column | None = None,
    error_message: Column | None = None,
) -> DataFrame:
    """Status changes; a link or error not given is cleared by the change."""
    fields = {"status": status}
    if download_url is not None:
        fields["download_url"] = download_url
    if error_message is not None:
        fields["error_message"] = error_message
    return _event(images, "status", **fields)


def ocr_events(images: DataFrame, has_text: Column, ocr_content: Column) -> DataFrame:
    return _event(images, "ocr", has_text=has_text, ocr_content=ocr_content)


def ocr_error_events(images: DataFrame, error_message: Column) -> DataFrame:
    return _event(images, "ocr_error", error_message=error_message)


def current_images(log: DataFrame, order: str = "event_no") -> DataFrame:
    """Current row per image: each group of fields comes from the last event that sets it."""
    kind, place = F.col("kind"), F.col(order)
    status = F.max_by(F.struct("status", "download_url", "at"), F.when(kind == "status", place))
    error = F.max_by(
        F.struct("error_message"), F.when(kind.isin("status", "ocr_error"), place)
    )
    ocr = F.max_by(F.struct("has_text", "ocr_content"), F.when(kind == "ocr", place))
    folded = log.groupBy("image_id").agg(
        F.max("msg_id").alias("msg_id"),
        F.max("from_username").alias("from_username"),
        F.min("at").alias("extracted_at"),
        status.alias("_s"),
        error.alias("_e"),
        ocr.alias("_o"),
    )
    completed = F.col("_s.status") == "completed"
    return folded.select(
        "image_id", "msg_id", "from_username", "extracted_at",
        "_s.status", "_s.download_url",
        F.when(completed, F.col("_s.at")).alias("downloaded_at"),
        "_e.error_message", "_o.has_text", "_o.ocr_content",
    )


# -- results of the outside services ------------------------------------------------------


def download_results(responses: DataFrame, column: str = "response") -> DataFrame:
    """Status, link and error that each download response means."""
    body = F.col(column)
    code = F.get_json_object(body, "$.errcode")
    link = F.coalesce(
        F.nullif(F.get_json_object(body, "$.data.url"), F.lit("")),
        F.nullif(F.get_json_object(body, "$.data.download_url"), F.lit("")),
    )
    message = F.nullif(F.get_json_object(body, "$.errmsg"), F.lit(""))
    good = F.coalesce(code, F.lit("")) == "0"
    reason = (
        F.when(good & link.isNull(), "No download URL in response")
        .when(~good, F.coalesce(message, F.concat(F.lit("Error code: "), F.coalesce(code, F.lit("None")))))
    )
    return responses.withColumns(
        {
            "status": F.when(good & link.isNotNull(), "completed").otherwise("failed"),
            "download_url": F.when(good, link),
            "error_message": reason,
        }
    )


def download_totals(results: DataFrame) -> DataFrame:
    return results.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status") == "completed").alias("succeeded"),
        F.count_if(F.col("status") == "failed").alias("failed"),
    )


def ocr_results(responses: DataFrame, column: str = "response") -> DataFrame:
    """Text flag and text that each OCR response means; text only when words were found."""
    words = F.coalesce(F.get_json_object(column, "$.prism_wnum").try_cast("int"), F.lit(0))
    text = F.coalesce(F.get_json_object(column, "$.content"), F.lit(""))
    return responses.withColumns({"has_text": words > 0, "ocr_content": F.when(words > 0, text)})


# -- queues and counts --------------------------------------------------------------------


def pending(images: DataFrame, limit: int = 100, order: str = "extracted_at") -> DataFrame:
    """Oldest images still to be downloaded."""
    return images.filter(F.col("status") == "pending").orderBy(order, "image_id").limit(limit)


def pending_ocr(images: DataFrame, limit: int = 100, order: str = "extracted_at") -> DataFrame:
    """Oldest downloaded images without an OCR result or error."""
    waiting = (
        F.col("download_url").isNotNull()
        & F.col("has_text").isNull()
        & F.col("error_message").isNull()
    )
    return images.filter(waiting).orderBy(order, "image_id").limit(limit)


def retryable(images: DataFrame, limit: int = 100, order: str = "extracted_at") -> DataFrame:
    """Oldest failed images, as the pending events that put them back in the queue."""
    return images.filter(F.col("status") == "failed").orderBy(order, "image_id").limit(limit)


def image_statistics(images: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Images and extraction checkpoints by status, one row each."""

    def counts(df: DataFrame, kind: str) -> DataFrame:
        states = ("pending", "completed", "failed")
        return df.agg(
            F.lit(kind).alias("kind"),
            F.count(F.lit(1)).alias("total"),
            *[F.count_if(F.col("status") == state).alias(state) for state in states],
        )

    return counts(images, "images").unionByName(counts(checkpoints, "checkpoints"))
