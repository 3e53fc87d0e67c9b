"""Comparing, merging and versioning schemas as tables of fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatlake import schemas
from chatlake.session import cut_lineage
from chatlake.sources.lake import read_if_there

DAY = tuple(schemas.PARTITION_COLUMNS)


def fields_of(spark: SparkSession, schema: T.StructType) -> DataFrame:
    """A schema as rows of position, name and type."""
    rows = [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(schema.fields)]
    return spark.createDataFrame(rows, "position int, name string, type string")


def observed_fields(documents: DataFrame, column: str = "_body") -> DataFrame:
    """Top-level names and JSON types seen in a column of JSON object members."""
    cells = documents.select(F.explode(column).alias("name", "_v"))
    seen = cells.groupBy("name", F.schema_of_variant("_v").alias("_t")).agg(F.lit(1))
    kind = (
        F.when(F.col("_t").rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT)"), "number")
        .when(F.col("_t") == "STRING", "string")
        .when(F.col("_t") == "BOOLEAN", "boolean")
        .when(F.col("_t") == "VOID", "null")
        .otherwise(F.lower(F.regexp_extract("_t", "^[A-Z]+", 0)))
    )
    return seen.select("name", kind.alias("type")).distinct()


def field_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Each field with its status: added, removed, changed or same."""
    before = old.select("name", F.col("type").alias("old_type"))
    after = new.select("name", F.col("type").alias("new_type"))
    status = (
        F.when(F.col("old_type").isNull(), "added")
        .when(F.col("new_type").isNull(), "removed")
        .when(F.col("old_type") != F.col("new_type"), "changed")
        .otherwise("same")
    )
    return before.join(after, "name", "full").withColumn("status", status)


def compatibility(changes: DataFrame) -> DataFrame:
    """One verdict: removals and type changes break, additions are backward compatible."""

    def names(status: str):
        picked = F.collect_list(F.when(F.col("status") == status, F.col("name")))
        return F.array_join(F.array_sort(picked), ",")

    breaking = F.count_if(F.col("status").isin("removed", "changed")) > 0
    grown = F.count_if(F.col("status") == "added") > 0
    verdict = F.when(breaking, "breaking").when(grown, "backward").otherwise("full")
    return changes.agg(
        names("added").alias("added_fields"),
        names("removed").alias("removed_fields"),
        names("changed").alias("changed_fields"),
        verdict.alias("compatibility_type"),
        (~breaking).alias("is_compatible"),
    )


def check_compatibility(old: DataFrame, new: DataFrame) -> DataFrame:
    return compatibility(field_changes(old, new))


def merge_fields(fields: DataFrame, conflict_type: str = "string") -> DataFrame:
    """Union of fields; a name with several types takes the conflict type."""
    merged = F.when(F.count_distinct("type") > 1, conflict_type).otherwise(F.first("type"))
    return fields.groupBy("name").agg(merged.alias("type"))


def merge_two(first: DataFrame, second: DataFrame) -> DataFrame:
    """Union of two schemas where the first one's type wins."""
    changes = field_changes(first, second)
    return changes.select("name", F.coalesce("old_type", "new_type").alias("type"))


def dataset_layouts(footers: DataFrame) -> DataFrame:
    """Distinct layouts of a dataset, files each, and whether each equals the first file's."""
    layouts = footers.filter("readable").groupBy("schema_text").agg(
        F.count(F.lit(1)).alias("files"), F.min("file_path").alias("first_file")
    )
    summary = layouts.agg(
        F.min_by("schema_text", "first_file").alias("_base"),
        F.collect_list(F.struct("schema_text", "files", "first_file")).alias("_all"),
    )
    opened = summary.select("_base", F.inline("_all"))
    return opened.withColumn("is_base", F.col("schema_text") == F.col("_base")).drop("_base")


def file_schema_errors(footers: DataFrame, expected: dict[str, str]) -> DataFrame:
    """Per file: expected fields that are missing or of another type; extras are allowed."""
    wanted = F.array(
        *[F.struct(F.lit(n).alias("name"), F.lit(t).alias("type")) for n, t in expected.items()]
    )

    def judge(field):
        found = F.filter("fields", lambda other: other["name"] == field["name"])
        problem = (
            F.when(F.size(found) == 0, "missing")
            .when(found[0]["type"] != field["type"], "type_mismatch")
        )
        return F.struct(field["name"].alias("name"), problem.alias("problem"))

    problems = F.filter(F.transform(wanted, judge), lambda p: p["problem"].isNotNull())
    return footers.filter("readable").select("file_path", F.inline(problems))


# -- fields that no schema names -----------------------------------------------------------


def extra_fields(rows: DataFrame, column: str = "extra", by: tuple[str, ...] = DAY) -> DataFrame:
    """Per day the fields found in ``extra`` with the type that holds all their values, and the rows that have them.

    Types are merged value by value as the rows are counted, so a day is one aggregate with map-side combine and no
    footer is read. Types are those of a VARIANT: nested ones are named in full (``OBJECT<floor: BIGINT>``), VOID stands
    for nulls only, and VARIANT for values without a common type. Rows without ``extra`` add nothing.
    """
    cells = rows.where(F.col(column).isNotNull()).select(
        *by, F.explode(F.from_json(column, "map<string, variant>")).alias("name", "_v")
    )
    return cells.groupBy(*by, "name").agg(F.schema_of_variant_agg("_v").alias("type"), F.count(F.lit(1)).alias("row_count"))


def extra_drift(found: DataFrame, registry: DataFrame | None, name: str) -> DataFrame:
    """Fields of ``extra_fields`` that the latest version of a schema lacks or has with another type, and since when."""
    seen = found.groupBy("name").agg(
        F.array_join(F.array_sort(F.collect_set("type")), " | ").alias("type"),
        F.min(F.make_date(*DAY)).alias("since"),
        F.sum("row_count").alias("row_count"),
    )
    if registry is None:
        return seen.withColumn("status", F.lit("added"))
    latest = latest_versions(registry.where(F.col("schema_name") == name))
    known = latest.select(F.inline("fields")).select("name", F.col("type").alias("_known"))
    drift = seen.join(known, "name", "left").where("_known is null or _known <> type")
    return drift.withColumn("status", F.when(F.col("_known").isNull(), "added").otherwise("changed")).drop("_known")


def register_extra(spark: SparkSession, path: str, name: str, found: DataFrame) -> bool:
    """Append a version with all fields of the last one and those of ``extra``; nothing where there is no drift."""
    registry = read_if_there(spark, path)
    drift = cut_lineage(extra_drift(found, registry, name))
    if not drift.limit(1).count():
        return False
    fresh = drift.select("name", "type", F.lit(True).alias("nullable"))
    if registry is None:
        version, rows = 1, fresh
    else:
        latest = latest_versions(registry.where(F.col("schema_name") == name))
        last = latest.first()
        version = 1 if last is None else int(last["version"]) + 1
        rows = latest.select(F.inline("fields")).join(fresh.select("name"), "name", "left_anti").unionByName(fresh)
    entry = rows.agg(F.array_sort(F.collect_list(F.struct("name", "type", "nullable"))).alias("fields")).select(
        F.lit(name).alias("schema_name"), F.lit(version).cast("long").alias("version"), "fields",
        F.lit("fields found in extra").alias("description"), F.current_timestamp().alias("registered_at"),
    )
    cut_lineage(entry).write.mode("append").parquet(path)
    return True


# -- registry -----------------------------------------------------------------------------


def next_versions(registry: DataFrame, names: DataFrame) -> DataFrame:
    """The version a new registration of each schema name would get."""
    last = registry.groupBy("schema_name").agg(F.max("version").alias("_last"))
    joined = names.select("schema_name").distinct().join(last, "schema_name", "left")
    return joined.select("schema_name", (F.coalesce("_last", F.lit(0)) + 1).alias("version"))


def register_schema(
    spark: SparkSession, path: str, name: str, schema: T.StructType, description: str = ""
) -> int:
    """Append a new version of a schema; types are kept as DDL, so nothing is lost."""
    known = read_if_there(spark, path)
    version = 1
    if known is not None:
        row = next_versions(known, spark.createDataFrame([(name,)], "schema_name string")).first()
        version = int(row["version"])
    ddl = [(f.name, f.dataType.simpleString(), f.nullable) for f in schema.fields]
    entry = spark.createDataFrame(
        [(name, version, ddl, description)],
        "schema_name string, version long, "
        "fields array<struct<name:string,type:string,nullable:boolean>>, description string",
    )
    entry.withColumn("registered_at", F.current_timestamp()).write.mode("append").parquet(path)
    return version


def schema_version(registry: DataFrame, name: str, version: int | None = None) -> DataFrame:
    """The row of one version, or of the latest."""
    rows = registry.filter(F.col("schema_name") == name)
    if version is not None:
        return rows.filter(F.col("version") == version)
    return rows.orderBy(F.desc("version")).limit(1)


def latest_versions(registry: DataFrame) -> DataFrame:
    """Latest version per schema name with its fields."""
    return registry.groupBy("schema_name").agg(
        F.max("version").alias("version"),
        F.max_by("fields", "version").alias("fields"),
        F.count(F.lit(1)).alias("versions"),
    )


def registered_struct(registry: DataFrame, name: str, version: int | None = None) -> T.StructType | None:
    """The registered schema as a StructType."""
    row = schema_version(registry, name, version).first()
    if row is None:
        return None
    ddl = ", ".join(f"`{f['name']}` {f['type']}" for f in row["fields"])
    return T.StructType.fromDDL(ddl)
