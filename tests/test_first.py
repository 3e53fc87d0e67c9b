"""The first row per id of a stream."""

from __future__ import annotations

import random
from datetime import datetime, timedelta, timezone

from chatlake.streaming import first

SCHEMA = "msg_id string, create_time timestamp, content string, n int"
START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def _run(spark, folder, batches) -> tuple[list, object]:
    raw, out, mark = (str(folder / name) for name in ("raw", "out", "mark"))
    query = None
    for number, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(raw)
        stream = spark.readStream.schema(SCHEMA).parquet(raw)
        query = first.start(first.first_rows(stream, "10 hours", 20), out, mark)
        query.awaitTermination()
    return sorted((r["msg_id"], r["content"], r["n"]) for r in spark.read.schema(SCHEMA).parquet(out).collect()), query


def test_order_of_arrival_does_not_matter(spark, tmp_path) -> None:
    r = random.Random(1)
    rows = [(f"m{r.randrange(8)}", START + timedelta(minutes=r.randrange(300)), r.choice(["a", "b", None]), i) for i in range(40)]
    rows += [(None, START, "x", 1), ("m1", None, "x", 1)]
    end = [("end", START + timedelta(days=9), "x", 0)]
    earliest = {}
    for row in rows:
        if row[0] and row[1]:
            key = (row[1], f'"content":{"null" if row[2] is None else chr(34) + row[2] + chr(34)},"n":{row[3]}' + "}")
            earliest[row[0]] = min(earliest.get(row[0], (key, row)), (key, row), key=lambda x: x[0])
    wanted = sorted((row[0], row[2], row[3]) for _, row in earliest.values())
    one, _ = _run(spark, tmp_path / "one", [rows[:20], rows[20:], end])
    turned = rows[::-1]
    late = [("m1", START, "late", 99)]
    two, query = _run(spark, tmp_path / "two", [turned[:15], turned[15:], end, late])
    assert one == wanted == two
    # the late row was counted, and only the closing row is still held
    assert first.late_rows(query) == 1 and first.held_rows(query) <= 2


def test_many_ids_share_the_state_of_a_group(spark, tmp_path, monkeypatch) -> None:
    """State rows, and with them calls to the store, follow the groups and not the ids; copies in later batches are dropped."""
    monkeypatch.setattr(first, "GROUPS", 3, raising=False)
    rows = [(f"m{i}", START + timedelta(minutes=i), f"c{i}", i) for i in range(300)]
    copies = [(f"m{i}", START + timedelta(minutes=i + 90), "copy", i) for i in range(0, 300, 2)]
    _, query = _run(spark, tmp_path / "held", [copies + rows[:150]])
    assert 0 < first.held_rows(query) <= 2 * 3
    end = [("end", START + timedelta(days=9), "x", 0)]
    found, query = _run(spark, tmp_path / "all", [copies + rows[:150], rows[150:], end])
    assert found == sorted((r[0], r[2], r[3]) for r in rows)
    assert first.held_rows(query) <= 2
