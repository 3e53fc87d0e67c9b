"""JSON line files: reading with line numbers, request parsing, daily landing files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chatlake.functions import clean
from chatlake.operators.cleaning import valid_lines


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Physical lines with their file and the split they came from."""
    lines = spark.read.text(path)
    return lines.select(
        *lines.columns,
        F.col("_metadata.file_path").alias("source_file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line_order"),
    )


def number_lines(lines: DataFrame, name: str = "line_no") -> DataFrame:
    """Number the rows of each file from 1 in file order.

    Rows are counted per split first; the window only ever spans one split, whose size
    ``spark.sql.files.maxPartitionBytes`` bounds, so one huge file is numbered in parallel.
    """
    split = ["source_file", "block"]
    earlier = Window.partitionBy("source_file").orderBy("block")
    starts = (
        lines.groupBy(*split)
        .agg(F.count(F.lit(1)).alias("_rows"))
        .withColumn("_before", F.sum("_rows").over(earlier) - F.col("_rows"))
        .drop("_rows")
    )
    inside = F.row_number().over(Window.partitionBy(*split).orderBy("line_order"))
    numbered = lines.withColumn("_inside", inside).join(starts, split)
    return numbered.withColumn(name, F.col("_inside") + F.col("_before")).drop("_inside", "_before")


def read_from_line(
    spark: SparkSession, path: str | list[str], start_line: int = 0, strict: bool = False
) -> DataFrame:
    """Valid rows after physical line ``start_line`` of each file; blank lines are counted."""
    numbered = number_lines(read_lines(spark, path))
    return valid_lines(numbered.filter(F.col("line_no") > start_line), strict=strict)


def count_lines(lines: DataFrame) -> DataFrame:
    """Non-blank lines per file."""
    filled = lines.filter(~clean.is_blank(F.col("value")))
    return filled.groupBy("source_file").agg(F.count(F.lit(1)).alias("lines"))


def batches_of(lines: DataFrame, size: int = 10_000) -> DataFrame:
    """Valid rows of each file in batches of ``size``, numbered from 0."""
    numbered = number_lines(valid_lines(lines), "valid_no")
    return numbered.withColumn("batch_id", F.floor((F.col("valid_no") - 1) / size))


def _form_map(body: Column) -> Column:
    """First non-empty value per key of a URL-encoded body."""

    def decode(text: Column) -> Column:
        return F.coalesce(F.try_url_decode(text), F.replace(text, F.lit("+"), F.lit(" ")))

    pairs = F.transform(
        F.filter(F.split(body, "&"), lambda part: part.rlike("=.")),
        lambda part, place: F.struct(
            decode(F.substring_index(part, "=", 1)).alias("k"),
            place.alias("n"),
            decode(F.regexp_replace(part, "^[^=]*=", "")).alias("v"),
        ),
    )
    # the first pair of each key by sorting, as a search per key costs the square of a long body
    ordered = F.array_sort(pairs)
    none = F.array(F.lit(None).cast("struct<k:string,n:int,v:string>"))
    firsts = F.zip_with(ordered, F.concat(none, ordered), lambda pair, last: F.when(~pair["k"].eqNullSafe(last["k"]), pair))
    kept = F.array_sort(
        F.transform(
            F.filter(firsts, lambda pair: pair["k"].isNotNull()),
            lambda pair: F.struct(pair["n"].alias("n"), pair["k"].alias("k"), pair["v"].alias("v")),
        )
    )
    return F.map_from_entries(F.transform(kept, lambda pair: F.struct(pair["k"], pair["v"])))


def parse_requests(
    requests: DataFrame, content_type: str = "content_type", body: str = "body"
) -> DataFrame:
    """Parse raw requests by content type; text that only looks like JSON may fail quietly."""
    kind = F.lower(F.coalesce(F.col(content_type), F.lit("")))
    text = F.col("body_text")
    says_json = kind.contains("json")
    says_form = ~says_json & (kind.contains("form") | kind.contains("urlencoded"))
    looks_json = ~says_json & ~says_form & F.trim(text).rlike(r"^\s*[{\[]")
    good = clean.is_json(text)
    return requests.withColumn(
        "body_text", F.make_valid_utf8(F.col(body).cast("string"))
    ).withColumns(
        {
            "parsed_json": F.when((says_json | looks_json) & good, text),
            "parsed_form": F.when(says_form, _form_map(text)),
            "parse_error": F.when(says_json & ~good, F.lit("JSON decode error")),
        }
    )


def append_daily(df: DataFrame, root: str, arrival: Column | None = None) -> None:
    """Append rows as JSON text to rolled files under the UTC arrival day."""
    day = F.current_timestamp() if arrival is None else arrival
    text = df.select(
        F.to_json(F.struct(*df.columns)).alias("value"),
        F.date_format(day, "yyyy-MM-dd").alias("arrival_date"),
    )
    text.write.mode("append").partitionBy("arrival_date").text(root)
