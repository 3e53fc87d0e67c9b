"""Numbering, greedy batches and keep-first under skew, against plain loops."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from chatlake.operators.sequence import greedy_batches, stride_sample
from chatlake.operators.skew import keep_first, keep_last, look_up, number_rows


def _fold(costs: list[int], budget: int) -> list[int]:
    batch, total, out = 0, 0, []
    for cost in costs:
        if batch == 0 or total + cost > budget:
            batch, total = batch + 1, cost
        else:
            total += cost
        out.append(batch)
    return out


def test_number_rows_with_a_hot_group_and_equal_times(spark) -> None:
    random.seed(3)
    rows = [("hot", i % 3, f"m{i:05d}") for i in range(3000)]
    rows += [(random.choice("abc"), random.randrange(50), f"n{i}") for i in range(500)]
    random.shuffle(rows)
    df = spark.createDataFrame(rows, "room string, at int, id string").repartition(7)
    found = {(r.room, r.id): r.seq for r in number_rows(df, ["room"], ["at", "id"]).collect()}
    for room in {row[0] for row in rows}:
        ordered = sorted((at, name) for r, at, name in rows if r == room)
        assert [found[room, name] for _, name in ordered] == list(range(1, len(ordered) + 1))


def test_number_rows_spreads_copies(spark) -> None:
    from chatlake.operators import skew

    seen = {}
    real = skew.cut_lineage

    def spy(df):
        seen["slices"] = real(df)
        return seen["slices"]

    skew.cut_lineage = spy
    # otherwise so few rows would be put together again
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(60_000).select(F.lit("hot").alias("room"), F.lit(1).alias("at"), F.lit("same").alias("v"))
        rows = number_rows(df, ["room"], ["at"])
        assert rows.agg(F.count_distinct("seq"), F.max("seq")).first()[:] == (60_000, 60_000)
        assert seen["slices"].groupBy("_slice").count().agg(F.max("count")).first()[0] < 30_000
    finally:
        skew.cut_lineage = real
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_number_rows_keeps_null_groups(spark) -> None:
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 1)], "room string, at int")
    assert sorted(r.seq for r in number_rows(df, ["room"], ["at"]).collect()) == [1, 1, 2]


@pytest.mark.parametrize("seed", range(6))
def test_greedy_batches_match_the_loop(spark, seed: int) -> None:
    rng = random.Random(seed)
    budget = rng.choice([7, 40, 150])
    groups = {f"g{i}": [rng.randint(1, rng.choice([3, 20, 60])) for _ in range(rng.randint(1, 300))] for i in range(5)}
    groups["hot"] = [rng.randint(1, 12) for _ in range(4000)]
    rows = [(g, i + 1, cost) for g, costs in groups.items() for i, cost in enumerate(costs)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, pos long, cost long")
    chunk = rng.choice([1, 2, 13, 100, 10_000])
    found = greedy_batches(df, ["g"], "pos", "cost", budget, chunk_rows=chunk).collect()
    numbers = {(r.g, r.pos): r.batch_index for r in found}
    assert len(found) == len(rows)
    for g, costs in groups.items():
        assert [numbers[g, i + 1] for i in range(len(costs))] == _fold(costs, budget)


def test_keep_first_and_last(spark) -> None:
    rows = [("hot", i, f"v{i}") for i in range(1000)] + [("a", 5, "x"), ("a", 4, "y")]
    df = spark.createDataFrame(rows, "k string, n int, v string").repartition(5)
    assert {(r.k, r.v) for r in keep_first(df, ["k"], ["n"]).collect()} == {("hot", "v0"), ("a", "y")}
    assert {(r.k, r.v) for r in keep_last(df, ["k"], ["n"]).collect()} == {("hot", "v999"), ("a", "x")}


def test_look_up_keeps_rows_without_key(spark) -> None:
    rows = [(i, "k" if i % 3 == 0 else None) for i in range(300)]
    df = spark.createDataFrame(rows, "i int, k string")
    table = spark.createDataFrame([("k", 1), ("z", 2)], "k string, v int")
    found = look_up(df, table, ["k"], "i")
    assert found.count() == 300
    assert found.filter("v = 1").count() == 100
    assert "_salt" not in found.columns


@pytest.mark.parametrize(("size", "limit"), [(10, 3), (7, 10), (9, 3), (5, 1)])
def test_stride_sample(spark, size: int, limit: int) -> None:
    df = spark.range(1, size + 1).select(F.lit("t").alias("t"), F.col("id").alias("pos"), F.col("id").alias("was"))
    items = list(range(1, size + 1))
    step = max(1, size // limit) if size > limit else 1
    rows = sorted((r.pos, r.was) for r in stride_sample(df, ["t"], "pos", limit).collect())
    assert rows == list(enumerate(items[::step], start=1))
