import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from mirepoix.sources import readers, sinks
from mirepoix.streaming import upserts


def test_json_shapes(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"id": 1, "title": "x"}, {"id": 2}]))
    (tmp_path / "d.json").write_text(json.dumps({"k1": {"v": 1.5}, "k2": {"v": None}}))
    assert [tuple(r) for r in readers.json_records(spark, f"{tmp_path}/a.json", "id int, title string").orderBy("id").collect()] == [(1, "x"), (2, None)]
    assert sorted(tuple(r) for r in readers.json_dictionary(spark, f"{tmp_path}/d.json", "struct<v:double>").collect()) == [("k1", 1.5), ("k2", None)]


def test_delimited_files(spark, tmp_path):
    (tmp_path / "sr.txt").write_text("~01001~^~Butter, salted~^100.5\n~01002~^~~^\n")
    rows = readers.delimited(spark, f"{tmp_path}/sr.txt", ["id", "name", "amount"]).orderBy("id").collect()
    assert (rows[0].id, rows[0].name, rows[0].amount) == ("01001", "Butter, salted", "100.5")
    (tmp_path / "long.csv").write_text("food|code|value\na|NaN|1,5\na|FE|2\nb|FE|x\nb|ZN|3\n")
    got = {r.food: r.nutrients for r in readers.long_nutrients(spark, f"{tmp_path}/long.csv", "food", "code", "value").collect()}
    assert got == {"a": {"FE": 2.0, "NaN": 1.5}, "b": {"ZN": 3.0}}
    (tmp_path / "wide.csv").write_text("food_id,food_name,fat,iron\n1,\"oil, olive\",<0.1,Tr\n2,egg,\"9,5\",1.8\n")
    got = {r.food_id: (r.food_name, r.nutrients) for r in readers.composition(spark, f"{tmp_path}/wide.csv", ["fat", "iron"]).collect()}
    assert got == {"1": ("oil, olive", {"fat": 0.1}), "2": ("egg", {"fat": 9.5, "iron": 1.8})}
    (tmp_path / "x.ttl").write_text("<http://e/a> <p> <http://f/9> .\n# none\n")
    assert [tuple(r) for r in readers.links(spark, f"{tmp_path}/x.ttl", r"<http://e/(\w+)> <p> <http://f/(\d+)>", ["a", "b"]).collect()] == [("a", "9")]
    with pytest.raises(KeyError):
        readers.named_dimension(spark, str(tmp_path), "other", ["units"])


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "id int, name string")
    bad = sinks.write_checked(rows, f"{tmp_path}/t", F.when(F.col("name").isNull(), "no name"))
    assert [tuple(r) for r in bad.collect()] == [(2, None, "no name")]
    assert spark.read.parquet(f"{tmp_path}/t").count() == 2
    for v in (1, 2):
        sinks.write_version(rows.limit(v), f"{tmp_path}/v", v, "current_rows")
        assert spark.table("current_rows").count() == v
    sinks.write_report(rows, f"{tmp_path}/r", ["name", "id"], [F.desc("id")])
    assert [r.id for r in spark.read.csv(f"{tmp_path}/r", header=True).collect()] == ["3", "2", "1"]
    assert sinks.partition_counts(spark, f"{tmp_path}/t", "name").count() == 2


SCHEMA = "event_id long, ts timestamp, user_id long, value double"


def _write(spark, folder, rows):
    at = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    spark.createDataFrame([(e, at(m), u, v) for e, m, u, v in rows], SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def test_stream_merges_by_key_and_resumes(spark, tmp_path):
    src, out, marks = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/marks"
    _write(spark, src, [(1, 0, 7, 1.0), (2, 5, 7, 2.0), (3, 1, 8, 3.0)])
    run = lambda: upserts.merge_into(upserts.read_events(spark, src, SCHEMA), out, marks, ["user_id"], [F.desc("ts")]).awaitTermination()
    run()
    assert {r.user_id: r.value for r in upserts.latest(spark, out).collect()} == {7: 2.0, 8: 3.0}
    _write(spark, src, [(4, 9, 8, 4.0), (5, 9, 9, 5.0)])
    run()
    assert {r.user_id: r.value for r in upserts.latest(spark, out).collect()} == {7: 2.0, 8: 4.0, 9: 5.0}
    before = upserts.versions(spark, out)
    run()
    assert upserts.versions(spark, out) == before


def test_only_the_last_two_versions_of_a_part_stay(spark, tmp_path):
    src, out, marks = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/marks"
    run = lambda: upserts.merge_into(upserts.read_events(spark, src, SCHEMA), out, marks, ["user_id"], [F.desc("ts")], parts=3).awaitTermination()
    want = {}
    for i in range(7):
        rows = [(100 * i + u, i, u, float(i)) for u in ([1] if i else range(12))]
        want |= {u: float(i) for _, _, u, _ in rows}
        _write(spark, src, rows)
        run()
        assert {r.user_id: r.value for r in upserts.latest(spark, out).collect()} == want
    kept = [p for p in tmp_path.glob("out/batch=*/part=*")]
    parts = {p.name for p in kept}
    assert max(sum(p.name == part for p in kept) for part in parts) == 2 and len(kept) == len(parts) + 1
    assert len([*tmp_path.glob("out/batch=*")]) == 3


def test_duplicates_and_windows(spark, tmp_path):
    src = f"{tmp_path}/in"
    _write(spark, src, [(1, 0, 7, 1.0), (1, 2, 7, 1.0), (2, 10, 7, 2.0), (3, 60 * 30, 8, 1.0)])
    events = upserts.read_events(spark, src, SCHEMA)
    query = upserts.deduplicated(events, "ts", ["event_id"]).writeStream.format("memory").queryName("dedup").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("dedup").count() == 3
    query = upserts.windowed_counts(events, "ts", ["user_id"]).writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted((r.user_id, r.n) for r in spark.table("windows").collect()) == [(7, 3), (8, 1)]
