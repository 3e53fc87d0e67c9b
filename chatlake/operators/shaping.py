"""Small plan-shaping helpers."""

from __future__ import annotations

from collections.abc import Mapping

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def evaluate_once(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """Add columns whose expressions are computed once per row.

    A later filter or projection on a plain derived column is rewritten in terms of its
    inputs, so a costly parse would run again in every place that uses it. Passing the
    values through ``inline`` stops that rewriting without leaving generated code.
    """
    others = [F.col(f"`{name}`") for name in df.columns if name not in columns]
    row = F.struct(*[F.col(f"`{name}`") for name in columns])
    return df.withColumns(dict(columns)).select(*others, F.inline(F.array(row)))


def counted(df: DataFrame) -> tuple[DataFrame, Observation]:
    """The same rows, and the means to learn their number once they have been written."""
    seen = Observation()
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen


def rows_seen(observation: Observation) -> int:
    """Rows that passed; a plan that Spark proves to be empty reports no metrics at all."""
    try:
        return int(observation.get["rows"])
    except Py4JJavaError:
        return 0
