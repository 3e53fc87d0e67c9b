"""Per-room order: sequence numbers, batches and samples."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatlake.operators.skew import number_rows
from chatlake.session import cut_lineage

DEFAULT_TOKEN_BUDGET = 120_000
CHUNK_ROWS = 1 << 20


def assign_sequence(
    messages: DataFrame, room: str = "chatroom", order: Sequence[str] = ("create_time", "msg_id")
) -> DataFrame:
    """``seq_id`` 1..n in time order per room; ids break ties, so repeats agree."""
    return number_rows(messages, [room], list(order), "seq_id")


def ensure_ids(sequenced: DataFrame, position: str = "seq_id") -> DataFrame:
    """Give a message without id the id ``auto_<position>``."""
    made = F.concat(F.lit("auto_"), F.col(position).cast("string"))
    return sequenced.withColumn("msg_id", F.coalesce(F.col("msg_id").cast("string"), made))


def batches_by_count(sequenced: DataFrame, size: int, position: str = "seq_id") -> DataFrame:
    """``batch_index`` from 1, ``size`` messages each."""
    index = F.floor((F.col(position) - 1) / size) + 1
    return sequenced.withColumn("batch_index", index.cast("long"))


def stride_sample(df: DataFrame, group: Sequence[str], position: str, limit: int) -> DataFrame:
    """Every k-th row from the first where a group has more than ``limit`` rows.

    ``position`` counts the rows of a group from 1; the kept rows are counted anew.
    """
    counts = df.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    step = F.when(F.col("_n") > limit, F.greatest(F.lit(1), F.floor(F.col("_n") / limit))).otherwise(1)
    skipped = F.col(position) - 1
    sampled = df.join(counts, list(group)).filter(skipped % step == 0)
    return sampled.withColumn(position, F.floor(skipped / step) + 1).drop("_n")


# -- greedy batches -----------------------------------------------------------------------
#
# A batch takes rows in order until the next row would exceed the budget. Where a batch
# starts depends on all rows before it, yet a group may be too large for one task. Groups
# are therefore cut into chunks of bounded size. Each chunk of a group with several chunks
# is summarised as a function: from the total of the batch still open when the chunk begins,
# to the total open at its end and the number of batches it starts. The summaries are
# chained in order, which gives every chunk its true starting point. Then all chunks are
# numbered in parallel; a group of one chunk needs only this last step.


def _chunk_effect(costs: np.ndarray, budget: int, opening: bool) -> pd.DataFrame:
    """The chunk as a table: for an open total up to ``limit``, its effect.

    ``opening`` marks the first chunk of a group, where the first row always starts a batch.
    """
    rows = len(costs)
    before = np.concatenate(([0], np.cumsum(costs)))
    # the row that starts the following batch, for a batch starting at each row
    following = np.searchsorted(before, before[:-1] + budget, side="right") - 1
    following = np.maximum(following, np.arange(1, rows + 1))
    end_total = np.zeros(rows, dtype=np.int64)
    started = np.zeros(rows, dtype=np.int64)
    for row in range(rows - 1, -1, -1):
        after = following[row]
        if after >= rows:
            end_total[row], started[row] = before[rows] - before[row], 1
        else:
            end_total[row], started[row] = end_total[after], started[after] + 1
    if opening:
        return pd.DataFrame({"limit": [0], "carry": [0], "end_total": end_total[:1], "started": started[:1]})
    # the first start is at row r for open totals in (budget - before[r + 1], budget - before[r]]
    highest = int(np.searchsorted(before, budget, side="right"))
    firsts = np.arange(0, min(highest, rows))
    limits = np.where(firsts == 0, np.iinfo(np.int64).max, budget - before[firsts])
    table = pd.DataFrame(
        {"limit": limits, "carry": 0, "end_total": end_total[firsts], "started": started[firsts]}
    )
    same = (table["end_total"].diff() == 0) & (table["started"].diff() == 0)
    table = table[~same]
    if before[rows] <= budget:
        unbroken = pd.DataFrame(
            {"limit": [budget - before[rows]], "carry": [1], "end_total": [before[rows]], "started": [0]}
        )
        table = pd.concat([table, unbroken])
    return table.sort_values("limit", kind="stable")


def greedy_batches(
    df: DataFrame,
    group: Sequence[str],
    position: str,
    cost: str,
    budget: int = DEFAULT_TOKEN_BUDGET,
    name: str = "batch_index",
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Number the greedy batches of each group from 1.

    ``position`` counts the rows of a group from 1 without gaps, and the group columns are
    never null. A row costlier than the budget gets a batch of its own.
    """
    keys = list(group)
    typed = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in keys)
    chunk = F.floor((F.col(position) - 1) / chunk_rows).cast("long").alias("_chunk")
    # three passes read these rows, so they are written once and the input is not worked out anew for each
    narrow = cut_lineage(
        df.select(*keys, chunk, F.col(position).cast("long").alias("_pos"), F.col(cost).cast("long").alias("_cost"))
    )

    def summarise(rows: pd.DataFrame) -> pd.DataFrame:
        ordered = rows.sort_values("_pos")
        table = _chunk_effect(ordered["_cost"].to_numpy(), budget, ordered["_chunk"].iat[0] == 0)
        head = {key: ordered[key].iat[0] for key in [*keys, "_chunk"]}
        return table.assign(**head)[[*keys, "_chunk", "limit", "carry", "end_total", "started"]]

    def chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Follow the chunks of each group in order; rows arrive sorted by group and chunk."""
        current: tuple | None = None
        total = opened = 0
        at_chunk: int | None = None
        settled = True
        for batch in batches:
            out = []
            columns = [batch[c].tolist() for c in [*keys, "_chunk", "limit", "carry", "end_total", "started"]]
            for *key, number, limit, carry, end_total, started in zip(*columns, strict=True):
                if tuple(key) != current:
                    current, total, opened, at_chunk = tuple(key), 0, 0, None
                if number != at_chunk:
                    at_chunk, settled = number, False
                    out.append((*key, number, total, opened))
                if not settled and (limit >= total or number == 0):
                    total, opened = (total if carry else 0) + end_total, opened + started
                    settled = True
            yield pd.DataFrame(out, columns=[*keys, "_chunk", "_total", "_opened"])

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Number the rows of each chunk from its starting point; rows arrive in order."""
        current: tuple | None = None
        total = opened = 0
        for batch in batches:
            numbers = []
            columns = [batch[c].tolist() for c in [*keys, "_chunk", "_cost", "_total", "_opened"]]
            for *key, row_cost, start_total, start_opened in zip(*columns, strict=True):
                if key != current:
                    current, total, opened = key, start_total, start_opened
                if opened == 0 or total + row_cost > budget:
                    total, opened = row_cost, opened + 1
                else:
                    total += row_cost
                numbers.append(opened)
            yield batch[[*keys, "_pos"]].assign(**{name: np.array(numbers, dtype=np.int64)})

    large = narrow.filter("_chunk > 0").select(*keys).distinct()
    effects = narrow.join(large, keys, "left_semi").groupBy(*keys, "_chunk").applyInPandas(
        summarise, f"{typed}, _chunk long, limit long, carry long, end_total long, started long"
    )
    entries = (
        effects.repartition(*keys)
        .sortWithinPartitions(*keys, "_chunk", "limit")
        .mapInPandas(chain, f"{typed}, _chunk long, _total long, _opened long")
    )
    placed = narrow.join(entries, [*keys, "_chunk"], "left").fillna(0, ["_total", "_opened"])
    numbered = (
        placed.repartition(*keys, "_chunk")
        .sortWithinPartitions(*keys, "_chunk", "_pos")
        .mapInPandas(number, f"{typed}, _pos long, `{name}` long")
    )
    return df.join(numbered.withColumnRenamed("_pos", position), [*keys, position])
