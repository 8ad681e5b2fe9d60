import hashlib
import random

import pytest

from mirepoix.operators import documents


def probed(keys, modulus):
    """Linear probing, key by key in order of number and key."""
    number = lambda k: int(hashlib.sha1(str(k).encode()).hexdigest(), 16) % modulus
    used = set()
    for k in sorted(keys, key=lambda k: (number(k), k)):
        at = number(k)
        while at in used:
            at = (at + 1) % modulus
        used.add(at)
    return used


@pytest.mark.parametrize("n", [0, 1, 500, 900, 1000])
def test_ids_are_free_at_any_load(spark, n):
    keys = random.Random(n).sample(range(10**9), n)
    df = spark.createDataFrame([(k, "x") for k in keys], "k long, hash string").repartition(6)
    rows = documents.free_ids(df, "k", 3).collect()
    assert len(rows) == n and len({r.new_id for r in rows}) == n
    assert {r.new_id for r in rows} == probed(keys, 1000)
    if n == 500:  # no key is far from its own number, and those whose number is theirs alone have it
        number = lambda k: int(hashlib.sha1(str(k).encode()).hexdigest(), 16) % 1000
        assert sum(r.new_id == number(r.k) for r in rows) > 250


def test_wide_ids_are_the_digest_and_too_many_keys_are_refused(spark):
    rows = documents.free_ids(spark.range(200), "id").collect()
    assert {r.id: r.new_id for r in rows} == {i: int(hashlib.sha1(str(i).encode()).hexdigest(), 16) % 10**10 for i in range(200)}
    with pytest.raises(ValueError):
        documents.free_ids(spark.range(11), "id", 1)


def test_too_many_keys_have_no_ids_where_they_are_not_refused(spark):
    assert [tuple(r) for r in documents.free_ids(spark.range(11), "id", 1, refuse=False).orderBy("id").collect()] == [(i, None) for i in range(11)]
    assert {r.new_id for r in documents.free_ids(spark.range(10), "id", 1, refuse=False).collect()} == set(range(10))


def test_query_of_more_users_than_ids_equals_its_sql(spark, tmp_path):
    from mirepoix.plans.documents import hashed_ids
    from mirepoix.plans.registry import ORACLES
    from tests import oracle

    for t in oracle.TABLES:
        (tmp_path / f"{t}.parquet").symlink_to(f"/root/testdata/sf0.001/{t}.parquet")
    (tmp_path / "events.parquet").unlink()
    spark.range(1001).withColumnRenamed("id", "user_id").write.parquet(str(tmp_path / "events.parquet"))
    assert oracle.differences(spark, oracle.connect(str(tmp_path)), hashed_ids, ORACLES["hashed_ids"], str(tmp_path)) is None
