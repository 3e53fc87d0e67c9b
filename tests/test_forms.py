"""Form bodies: the first non-empty value of each key, in order of the keys' first places."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from chatlake.sources import jsonl


def test_form_bodies(spark) -> None:
    long = "&".join(f"k{i % 9000}={i}" for i in range(10_000))
    bodies = ["a=1&b=2&a=3", "", None, "x", "a=&a=5&b=%20c", "=v&k=a=b", "z=1&a=%zz&z=2&m=+", long]
    table = spark.createDataFrame(list(enumerate(bodies)), "n int, body string")
    rows = table.select("n", F.to_json(jsonl._form_map(F.col("body"))).alias("found")).orderBy("n").collect()
    found = [json.loads(r.found) if r.found else None for r in rows]
    assert found[:-1] == [{"a": "1", "b": "2"}, {}, None, {}, {"a": "5", "b": " c"}, {"": "v", "k": "a=b"}, {"z": "1", "a": "%zz", "m": " "}]
    assert found[-1] == {f"k{i}": str(i) for i in range(9000)}
