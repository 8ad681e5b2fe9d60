import json
import random

import pytest

from mirepoix.sources import readers

SCHEMA = "id long, text string, parts array<struct<name: string, n: int>>, more struct<a: string>"


def made(n, seed):
    rng = random.Random(seed)
    odd = ["}", "{", '"', "\\", "]", "[", ",", "\n", "é", "日", "\\\"}", "plain words", "\t", '\\"', "}{", "\\\\"]
    text = lambda: "".join(rng.choices(odd, k=rng.randrange(0, 9)))
    return [{"id": i, "text": text(), "parts": [{"name": text(), "n": j} for j in range(rng.randrange(0, 4))], **({"more": {"a": text()}} if rng.random() < 0.5 else {}), text() + "x": {"deep": [[{}], "}"]}} for i in range(n)]


@pytest.mark.parametrize("form", [{}, {"indent": 2}, {"ensure_ascii": False, "separators": (",", ":")}])
def test_one_array_read_by_many_tasks_equals_a_plain_parse(spark, tmp_path, form):
    rows = made(2000, len(form))
    (tmp_path / "a.json").write_text(json.dumps(rows, **form) + "\n", encoding="utf-8")
    (tmp_path / "b.json").write_text("  " + json.dumps(made(3, 9), **form), encoding="utf-8")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        assert spark.read.text(f"{tmp_path}/a.json", lineSep="}").rdd.getNumPartitions() > 5
        got = [r.asDict(recursive=True) for r in readers.json_array(spark, f"{tmp_path}/*.json", SCHEMA).collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    want = [{"id": r["id"], "text": r["text"], "parts": r["parts"], "more": r.get("more")} for r in [*rows, *made(3, 9)]]
    by = lambda r: json.dumps(r, sort_keys=True)
    assert sorted(got, key=by) == sorted(want, key=by)


def test_empty_arrays(spark, tmp_path):
    (tmp_path / "a.json").write_text("[]")
    (tmp_path / "b.json").write_text("")
    assert readers.json_array(spark, f"{tmp_path}/*.json", SCHEMA).collect() == []
