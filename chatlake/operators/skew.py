"""Building blocks that stay even when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatlake.session import cut_lineage

_SALTS = 1024


def number_rows(
    df: DataFrame, group: Sequence[str], order: Sequence[str], name: str = "seq"
) -> DataFrame:
    """Position 1..n of each row in its group.

    A window over the group would send the whole group to one task. Here the rows are
    range-partitioned on group and order together, so a large group spans many tasks; each
    (group, task) slice then only needs the number of rows in the slices before it. The
    sorted rows are materialised once, since both steps must see the same slices.

    Rows with equal order are ordered by their content, and even full copies differ in
    ``_copy``, so that a heap of equal rows is spread as well.
    """
    plain = [f.name for f in df.schema if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    keys = [*group, *order, "_tie", "_copy"]
    slices = cut_lineage(
        df.withColumns({"_tie": F.xxhash64(*plain), "_copy": F.monotonically_increasing_id()})
        .repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .drop("_tie", "_copy")
        .withColumn("_row", F.monotonically_increasing_id())
        .withColumn("_slice", F.shiftright("_row", 33))
    )
    before = Window.partitionBy(*group).orderBy("_slice")
    starts = (
        slices.groupBy(*group, "_slice")
        .agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_rows"))
        .withColumn("_before", F.sum("_rows").over(before) - F.col("_rows"))
        .select(*group, "_slice", "_first", "_before")
    )
    left, right = slices.alias("l"), starts.alias("r")
    same = F.col("l._slice") == F.col("r._slice")
    for key in group:
        same = same & F.col(f"l.{key}").eqNullSafe(F.col(f"r.{key}"))
    position = F.col("l._row") - F.col("r._first") + F.col("r._before") + 1
    return left.join(right, same).select(
        *[F.col(f"l.{column}") for column in df.columns], position.alias(name)
    )


def keep_first(df: DataFrame, key: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The first row per key by a total order, as an aggregate with map-side combine."""
    others = [column for column in df.columns if column not in key]
    ranking = F.struct(*[F.col(o) if isinstance(o, str) else o for o in order])
    first = F.min_by(F.struct(*others), ranking).alias("_kept")
    kept = df.groupBy(*key).agg(first).select(*key, "_kept.*")
    return kept.select(*df.columns)


def keep_first_by_place(df: DataFrame, key: Sequence[str], place: Sequence[str]) -> DataFrame:
    """The first row per key, where no two rows share a place, without moving rows that are alone.

    Keys are counted and the places of repeated keys compared on narrow rows; whole rows only meet the
    list of repeated keys, which Spark broadcasts where it measures it to be small.
    """
    def same(left: str, right: str) -> Column:
        return reduce(lambda a, b: a & b, [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in key])

    often = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(*key)
    narrow = df.select(*dict.fromkeys([*key, *place])).alias("l").join(often.alias("r"), same("l", "r"), "left_semi")
    firsts = narrow.groupBy(*key).agg(F.min(F.struct(*place)).alias("_first"))
    joined = df.alias("l").join(firsts.alias("r"), same("l", "r"), "left")
    first = F.col("r._first").isNull() | (F.struct(*[F.col(f"l.{c}") for c in place]) == F.col("r._first"))
    return joined.filter(first).select(*[F.col(f"l.{c}") for c in df.columns])


def keep_last(df: DataFrame, key: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The last row per key by a total order, as an aggregate with map-side combine."""
    others = [column for column in df.columns if column not in key]
    ranking = F.struct(*[F.col(o) if isinstance(o, str) else o for o in order])
    last = F.max_by(F.struct(*others), ranking).alias("_kept")
    kept = df.groupBy(*key).agg(last).select(*key, "_kept.*")
    return kept.select(*df.columns)


def look_up(df: DataFrame, lookup: DataFrame, key: Sequence[str], spread: str) -> DataFrame:
    """Left join to a table unique on ``key``.

    Rows without a key cannot match; they get a salt from ``spread`` so that they do not
    pile up in one task. A hot real key is split at run time (skew join is always on in our
    sessions), and the small side is broadcast only when its measured size allows it.
    """
    missing = F.lit(False)
    for column in key:
        missing = missing | F.col(column).isNull()
    salt = F.when(missing, F.pmod(F.hash(spread), F.lit(_SALTS)) + 1).otherwise(0)
    salted = df.withColumn("_salt", salt)
    # always 0, but a literal would be folded away and with it the salt as a join key
    matched = lookup.withColumn("_salt", F.pmod(F.hash(*key), F.lit(1)))
    return salted.join(matched, [*key, "_salt"], "left").drop("_salt")
