"""The keyed store: repeated keys, replays, compaction, and what an upsert reads."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import blocks, hybrid
from tidemark.session import scratch_path
from tidemark.sources import keyed

KIND = "id long, v string"


@pytest.fixture
def store(spark):
    return keyed.KeyedStore(scratch_path(spark, "keyed"), "id", 8)


def rows(spark, *values):
    return spark.createDataFrame(list(values), KIND)


def content(spark, store):
    return sorted(map(tuple, keyed.read_keyed(spark, store).collect()))


def test_first_batch_of_a_key_wins(spark, store):
    assert keyed.read_keyed(spark, store) is None and keyed.compact(spark, store) == 0
    one = rows(spark, (1, "a"), (1, "a"), (1, "b"), (2, "c"))
    two = rows(spark, (2, "late"), (3, "d"))
    expected = [(1, "a"), (1, "b"), (2, "c"), (3, "d")]
    keyed.upsert_keyed(one, store, "batch-0")
    keyed.upsert_keyed(two, store, "batch-1")
    assert content(spark, store) == expected
    for name, batch in (("batch-1", two), ("batch-0", one)):  # replays before and after a compaction
        keyed.upsert_keyed(batch, store, name)
    assert content(spark, store) == expected and keyed.compact(spark, store) == 1
    for name, batch in (("batch-1", two), ("batch-0", one)):
        keyed.upsert_keyed(batch, store, name)
    keyed.upsert_keyed(rows(spark, (4, "e"), (1, "late")), store, "batch-2")
    assert content(spark, store) == [*expected, (4, "e")]


def test_killed_compaction_changes_nothing(spark, store):
    keyed.upsert_keyed(rows(spark, (1, "a")), store, "batch-0")
    rest = rows(spark, (9, "half")).withColumns({"bucket": F.lit(0), "batch": F.lit("compacted")})
    keyed._write(rest, f"{store.path}/rows/generation=1", store, "static")
    assert content(spark, store) == [(1, "a")]
    assert keyed.compact(spark, store) == 1 and content(spark, store) == [(1, "a")]


def test_upserts_read_the_buckets_of_their_keys(spark, store, monkeypatch):
    many = spark.range(1000).select("id", F.lit("x").alias("v"))
    keyed.upsert_keyed(many, store, "batch-0")
    assert keyed._stored(spark, store).select("bucket").distinct().count() == 8
    spark.conf.set("spark.sql.maxMetadataStringLength", 10_000)
    few = rows(spark, (5, "new"), (5000, "new"))
    plan = keyed.stored_with_keys(store, few)._jdf.queryExecution().executedPlan().toString()
    folders = plan.split("PartitionFilters")[1].split("PushedFilters")[0]
    assert "bucket" in folders and "In(id" in plan
    monkeypatch.setattr(blocks, "PUSHED_VALUES", 1)  # many keys are joined
    assert [r.id for r in keyed.stored_with_keys(store, few).collect()] == [5]


def test_parents_of_few_hits_are_a_filter_of_the_scan(spark):
    path = scratch_path(spark, "parents")
    spark.range(5000).select("id", F.lit("p").alias("name")).repartitionByRange(4, "id").write.parquet(path)
    hits = spark.createDataFrame([(1, 7, 0), (1, 4100, 0), (2, 7, 1), (2, 9999, 0)], "query_id long, id long, chunk_no int")
    found = hybrid.attach_parent(hits, spark.read.parquet(path))
    assert "In(id, [" in found._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.query_id, r.id, r.name) for r in found.collect()) == [(1, 7, "p"), (1, 4100, "p"), (2, 7, "p")]
