"""Sources, the store, joins with hot keys, and micro-batches."""

import pytest
from pyspark.sql import functions as F

from tidemark import sources
from tidemark.operators import etl
from tidemark.session import scratch_path
from tidemark.streaming import ingest


def test_unknown_split(spark):
    df = spark.createDataFrame([("mortality_phase1", "val", 1)], "task string, split string, label int")
    assert sources.load_split(df, "mortality_phase1", "val").count() == 1
    with pytest.raises(ValueError, match="unknown task"):
        sources.load_split(df, "nope")
    with pytest.raises(ValueError, match="unknown split"):
        sources.load_split(df, "mortality_phase1", "nope")


def test_lookup_missing_key_raises(spark):
    df = spark.createDataFrame([("a", 1)], "k string, v int")
    assert etl.lookup_required(df, "k", "a")["v"] == 1
    with pytest.raises(KeyError):
        etl.lookup_required(df, "k", "b")


def test_store_computes_once_and_retries_failures(spark):
    store, calls = scratch_path(spark, "store"), []

    def compute(todo):
        calls.append(sorted(r["id"] for r in todo.collect()))
        bad = (F.col("id") == 3) & F.lit(len(calls) == 1)
        return todo.select("id", F.when(~bad, F.col("id") * 10).alias("v"), (~bad).alias("ok"))

    keys = spark.createDataFrame([(1,), (2,), (3,), (3,)], "id bigint")
    first = {r["id"]: r["v"] for r in sources.materialize_missing(keys, store, "p", compute, ["id"]).rows.collect()}
    second = {r["id"]: r["v"] for r in sources.materialize_missing(keys, store, "p", compute, ["id"]).rows.collect()}
    assert first == {1: 10, 2: 20, 3: None} and second == {1: 10, 2: 20, 3: 30}
    assert calls == [[1, 2, 3], [3]]


def test_batch_replay_leaves_the_same_rows(spark):
    store = scratch_path(spark, "replay")
    one = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "c")], "id bigint, v string")
    two = spark.createDataFrame([(2, "new"), (3, "d")], "id bigint, v string")
    for batch_id, df in ((0, one), (1, two), (1, two), (0, one)):
        ingest.upsert_batch(df, batch_id, store, "id")
    rows = spark.read.parquet(store).select("id", "v").collect()
    assert sorted(map(tuple, rows)) == [(1, "a"), (1, "b"), (2, "c"), (3, "d")]


def test_upsert_twice_is_once(spark):
    old = spark.createDataFrame([(1, [1, 2]), (1, [1, 2])], "id int, v array<int>")
    once = etl.upsert(None, old)
    assert etl.upsert(once, old).collect() == once.collect()


def test_distinct_over_maps(spark):
    df = spark.range(4).select(F.create_map(F.lit("a"), F.lit(1)).alias("m"))
    assert etl.distinct_rows(df).count() == 1


def test_dimension_with_variants(spark):
    facts = spark.range(3).select(F.lit("k").alias("key"), "id")
    dim = spark.createDataFrame([("k", 1), ("k", 2), ("k", 2)], "key string, v int")
    assert etl.left_join_dim(facts, dim, ["key"]).count() == 6
    with pytest.raises(Exception, match="not unique"):
        etl.left_join_dim(facts, dim, ["key"], require_unique=True).collect()
    assert etl.left_join_dim(facts, dim.limit(1), ["key"], require_unique=True).count() == 3


def test_people_lists(spark):
    from tidemark.functions import concat_people

    people = "array<string>"
    df = spark.createDataFrame(
        [([["i"], None, ["j"]], ["a"]), (None, ["a"]), ([["i"]], None), (None, None)], f"n array<{people}>, f {people}"
    )
    got = [r[0] for r in df.select(concat_people(F.col("n"), F.col("f"), "string")).collect()]
    assert got == [["i", "j", "a"], ["a"], ["i"], []]


def test_micro_batches_come_in_many_files_and_keep_keys_together(spark):
    from pyspark.sql import functions as F

    from tidemark.queries import incremental

    rows = spark.range(3000).select((F.col("id") % 400).alias("key"), F.lit("x").alias("text"))
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    try:
        stream = incremental.arriving(rows, "key")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    store, batches = scratch_path(spark, "store"), []

    def keep(batch, n):
        batches.append(len(batch.inputFiles()))
        batch.withColumn("file", F.input_file_name()).write.mode("overwrite").parquet(f"{store}/batch_id={n}")

    stream.writeStream.foreachBatch(keep).option("checkpointLocation", scratch_path(spark, "c")).trigger(availableNow=True).start().awaitTermination()
    stored = spark.read.parquet(store)
    assert stored.count() == 3000 and stored.select("batch_id").distinct().count() >= 3
    assert stored.select("file").distinct().count() == 12
    assert stored.groupBy("key").agg(F.countDistinct("file").alias("n")).where("n > 1").isEmpty()


def test_keyed_stream_comes_in_many_files(spark, sf_dir, monkeypatch):
    from tidemark.queries import incremental

    seen = []
    read = incremental.ingest.read_stream

    def counted(session, path, *a, **b):
        seen.append(len(session.read.parquet(path).inputFiles()))
        return read(session, path, *a, **b)

    monkeypatch.setattr(incremental.ingest, "read_stream", counted)
    assert incremental.st1_keyed(spark, sf_dir).count() > 0
    assert seen == [4, 8, 12]
