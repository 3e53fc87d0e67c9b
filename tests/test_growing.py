"""Files that grow between runs, against the batch reader."""

from __future__ import annotations

import json
import random

import pytest
from pyarrow import fs

from chatlake.sources import growing, lake
from chatlake.streaming import ingest


@pytest.mark.parametrize("buffer,piece", [(3, 7), (4, 1), (1 << 20, 5)])
def test_pieces_give_each_line_once(tmp_path, monkeypatch, buffer, piece) -> None:
    monkeypatch.setattr(growing, "BUFFER", buffer)
    r = random.Random(buffer)
    system = fs.LocalFileSystem()
    for case in range(60):
        data = b"".join(r.choice([b"a", b"bc", b"\n", b"\r\n", "é".encode()]) for _ in range(r.randint(0, 25)))
        path = str(tmp_path / f"f{case}")
        with open(path, "wb") as out:
            out.write(data)
        start = r.choice([0, data.find(b"\n") + 1])
        end = growing.whole_lines_end(system, path, len(data), start)
        assert end == max(start, data.rfind(b"\n") + 1)
        found = []
        for first in range(start, end, piece):
            found += growing.read_piece(system, growing.Piece(path, start, first, min(first + piece, end), end))
        wanted, at = [], start
        for line in data[start:end].split(b"\n")[:-1]:
            wanted.append((at, line.removesuffix(b"\r")))
            at += len(line) + 1
        assert found == wanted


def _message(number: int) -> str:
    return json.dumps({"msg_id": f"m{number}", "create_time": 1704067200 + 3600 * number, "msg_type": 1, "content": f"c{number} ü"})


def _append(path, text: str) -> None:
    with open(path, "a", encoding="utf-8") as out:
        out.write(text)


def test_appended_lines_are_read_once(spark, tmp_path) -> None:
    raw, root, mark = tmp_path / "raw", str(tmp_path / "lake"), str(tmp_path / "mark")
    (raw / "sub").mkdir(parents=True)

    def run() -> dict[str, int]:
        return ingest.run_to_end(ingest.ingest_stream(spark, str(raw), root, mark, growing=True))

    def stored() -> list[str]:
        return sorted(r["msg_id"] for r in lake.read_lake(spark, root).select("msg_id").collect())

    half = _message(3)
    _append(raw / "a.jsonl", f"{_message(1)}\n\n{_message(2)}\r\n{half[:25]}")
    assert run()["total_lines"] == 3 and stored() == ["m1", "m2"]
    # the half line is finished, another file comes; a new query goes on from the positions kept
    _append(raw / "a.jsonl", f"{half[25:]}\n{_message(1)}\n")
    _append(raw / "sub" / "b.jsonl", f"{_message(4)}\nnot json\n")
    assert run()["total_lines"] == 4 and stored() == ["m1", "m2", "m3", "m4"]
    assert run()["total_lines"] == 0
    # a replaced, shorter file is read anew
    (raw / "sub" / "b.jsonl").write_text(f"{_message(5)}", encoding="utf-8")
    assert run()["total_lines"] == 0
    _append(raw / "sub" / "b.jsonl", "\n")
    assert run()["new_records"] == 1
    twin = str(tmp_path / "twin")
    lines = spark.read.text(str(raw), recursiveFileLookup=True).selectExpr("value", "_metadata.file_path as source_file")
    ingest.ingest_batch(spark, lines, twin)
    found = {r["msg_id"]: r["content"] for r in lake.read_lake(spark, root).collect()}
    assert {r["msg_id"]: r["content"] for r in lake.read_lake(spark, twin).collect()}.items() <= found.items()
    assert set(found) == {f"m{i}" for i in range(1, 6)}


def test_only_the_days_of_a_batch_are_read(spark, tmp_path) -> None:
    """One early message does not make the days between it and the others be read."""
    root = str(tmp_path / "lake")
    days = [0, 10, 20, 30, 40]
    lines = [(_message(24 * day), "f") for day in days]
    ingest.ingest_batch(spark, spark.createDataFrame(lines, "value string, source_file string"), root)
    batch = ingest.judged(spark.createDataFrame([lines[0], lines[4]], "value string, source_file string"))
    near = ingest.in_days(lake.read_if_there(spark, root), ingest.days_of(batch))
    assert near.count() == 2
    plan = near._jdf.queryExecution().executedPlan()
    files = {r["f"] for r in near.selectExpr("_metadata.file_path as f").collect()}
    assert len(files) == 2 and "PartitionFilters: [make_date" in plan.toString()
