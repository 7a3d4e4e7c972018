"""The stored index against the search that scans everything."""

import datetime as dt
import random
from operator import itemgetter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.operators import blocks, index_store, keyword
from tidemark.operators.chunking import chunk
from tidemark.session import scratch_path
from tidemark.streaming import ingest

WORDS = [f"{a}{b}" for a in "bcdfghk" for b in ("ala", "oro", "iti", "unu")]


@pytest.fixture(scope="module")
def corpus(spark):
    """Terms of very different frequency; a third of all texts are copies."""
    rng = random.Random(4)
    rows = []
    for i in range(400):
        text = " ".join(rng.choices(WORDS, [1 / (j + 1) for j in range(len(WORDS))], k=rng.randint(1, 40)))
        rows.append((i, dt.date(2001, 1, 1) + dt.timedelta(days=rng.randint(0, 300)) if i % 9 else None, text))
    rows += [(1000 + i, dt.date(2001, 3, 1 + i % 20), rows[5][2]) for i in range(200)]
    return spark.createDataFrame(rows, "id long, doc_date date, text string").repartition(4)


@pytest.fixture(scope="module")
def queries(spark):
    rng = random.Random(5)
    rows = [(q, dt.date(2001, 1, 1) + dt.timedelta(days=rng.randint(0, 330)) if q % 6 else None, " ".join(rng.sample(WORDS, 3)))
            for q in range(25)] + [(99, None, "unknown"), (98, dt.date(1990, 1, 1), WORDS[0]), (97, None, None)]
    return spark.createDataFrame(rows, "query_id long, as_of date, text string")


def hits(df):
    return sorted(map(tuple, df.select("query_id", "rank", "id", "chunk_no", "score").collect()))


@pytest.fixture(scope="module")
def expected(spark, corpus, queries):
    tokens = keyword.token_table(chunk(corpus.dropna(), "text"))
    return hits(keyword.search_keyword(queries, tokens, 5))


@pytest.fixture(scope="module")
def stored(spark, corpus):
    path = scratch_path(spark, "index")
    for part in range(3):
        index_store.append(corpus.where(F.col("id") % 3 == part), path, range_bits=3, dim=32)
    return path


def test_segments_give_the_hits_of_a_scan(spark, stored, queries, expected):
    index = index_store.load(spark, stored)
    assert index.version == 3 and len(index.segments) == 3
    assert hits(index_store.search_stored(queries, index, 5)) == expected


def test_many_terms_are_joined_not_listed(spark, stored, queries, expected, monkeypatch):
    monkeypatch.setattr(blocks, "PUSHED_VALUES", 2)
    assert hits(index_store.search_stored(queries, index_store.load(spark, stored), 5)) == expected


def test_bounds_hold_and_skip_ranges(spark, stored, queries):
    index = index_store.load(spark, stored)
    plan = index_store.plan_reads(queries, index)
    scores = index_store._scores(plan.bounds, plan, index.mean_len)
    where = index.chunks.select(*index_store.PLACE, "id", "chunk_no")
    best = scores.join(where, ["id", "chunk_no"]).groupBy("query_id", *index_store.PLACE).agg(F.max("score").alias("best"))
    assert plan.bounds.join(best, ["query_id", *index_store.PLACE]).where("best > bound + 0.000001").isEmpty()

    first = index_store.first_ranges(plan)
    top = index_store.top_k_per_key(
        index_store._scores(first, plan, index.mean_len), ["query_id"], [F.desc("score"), F.asc("id"), F.asc("chunk_no")], 5)
    read = first.count() + index_store.further_ranges(plan, first, top, 5).count()
    everything = index.blocks.select(*index_store.PLACE).distinct().count() * queries.count()
    assert read < plan.bounds.count() < everything
    assert read < 0.8 * plan.bounds.count()


def test_scans_are_pruned(spark, stored, queries):
    """Folders of terms that nobody asks for are not listed, and dates reach the scan."""
    spark.conf.set("spark.sql.maxMetadataStringLength", 10_000)
    index = index_store.load(spark, stored)
    one = queries.where("query_id = 7")
    plan = index_store.plan_reads(one, index).blocks._jdf.queryExecution().executedPlan().toString()
    assert "term_bucket" in plan.split("PartitionFilters")[1].split("PushedFilters")[0]
    assert "LessThan(min_day" in plan and "In(term" in plan
    tokens = index.chunks.select("id", "chunk_no", "doc_date")
    scan = blocks.before_all(tokens, one)._jdf.queryExecution().executedPlan().toString()
    assert "LessThan(doc_date" in scan


def test_merge_and_earlier_versions(spark, corpus, queries, expected):
    path = scratch_path(spark, "index")
    index_store.append(corpus.where("id < 200"), path, range_bits=4, dim=32)
    old = hits(index_store.search_stored(queries, index_store.load(spark, path), 5))
    index_store.append(corpus.where("id >= 200"), path)
    assert index_store.merge(spark, path) == 3 == index_store.merge(spark, path)
    index = index_store.load(spark, path)
    assert len(index.segments) == 1 and hits(index_store.search_stored(queries, index, 5)) == expected
    assert hits(index_store.search_stored(queries, index_store.load(spark, path, 1), 5)) == old != expected
    with pytest.raises(ValueError, match="no version"):
        index_store.load(spark, path, 9)
    with pytest.raises(ValueError, match="no index"):
        index_store.load(spark, scratch_path(spark, "index"))


def test_replay_and_killed_writer_leave_one_copy(spark, corpus, queries, expected):
    path = scratch_path(spark, "index")
    half, rest = corpus.where("id % 2 = 0"), corpus.where("id % 2 = 1")
    index_store.append(half, path, segment="batch-0", range_bits=4)
    # Killed after the files of a segment were written and before the commit: it does not exist yet.
    rows = index_store.load(spark, path).chunks.drop(*index_store.PLACE)
    index_store._write_segment(rows, path, "s-batch-1", index_store.DEFAULT_DIM, 4)
    assert index_store.load(spark, path).version == 1
    assert index_store.load(spark, path).chunks.count() == half.dropna().where("text <> ''").count()
    assert index_store.append(rest, path, segment="batch-1") == 2
    assert index_store.append(rest, path, segment="batch-1") == 2 == index_store.append(half, path, segment="batch-0")
    assert hits(index_store.search_stored(queries, index_store.load(spark, path), 5)) == expected


def test_stream_restarts_where_it_stopped(spark, corpus, queries, expected):
    files, path, checkpoint = (scratch_path(spark, x) for x in ("files", "index", "checkpoint"))

    def stream():
        return ingest.read_stream(spark, files, corpus.schema, files_per_batch=1)

    corpus.where("id < 300").coalesce(2).write.parquet(files)
    ingest.stream_segments(stream(), path, checkpoint, range_bits=4)
    corpus.where("id >= 300").coalesce(1).write.mode("append").parquet(files)
    ingest.stream_segments(stream(), path, checkpoint)
    index_store.merge(spark, path)
    assert hits(index_store.search_stored(queries, index_store.load(spark, path), 5)) == expected


def test_a_range_sends_only_its_best(spark, stored, queries):
    index = index_store.load(spark, stored)
    plan = index_store.plan_reads(queries, index)
    order = [F.desc("score"), F.asc("id"), F.asc("chunk_no")]
    everything, few = (index_store._scores(plan.bounds, plan, index.mean_len, k) for k in (None, 2))
    assert few.count() < everything.count()
    assert hits(index_store.top_k_per_key(few, ["query_id"], order, 2)) == hits(index_store.top_k_per_key(everything, ["query_id"], order, 2))


def test_queries_are_dealt_out_when_their_terms_are_many(spark, stored, queries, expected, monkeypatch):
    monkeypatch.setattr(index_store, "MAX_BLOCK_TERMS", 20)
    assert hits(index_store.search_stored(queries, index_store.load(spark, stored), 5)) == expected


def test_texts_are_put_in_order_before_they_are_cut(spark, corpus, monkeypatch):
    plans = []
    monkeypatch.setattr(index_store, "_write_ordered", lambda rows, *a: plans.append(rows._jdf.queryExecution().toString()) or (0, 0, []))
    index_store.append(corpus, scratch_path(spark, "index"))
    plan = plans[0].split("== Physical Plan ==")[1]
    assert plan.index("Generate") < plan.index("rangepartitioning")


def test_a_range_that_two_tasks_read_counts_once(spark, corpus, queries, expected, monkeypatch):
    path = scratch_path(spark, "index")
    rows = index_store._build_blocks

    def torn(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 3):
                yield from rows(iter([batch.slice(at, 3)]))

    monkeypatch.setattr(index_store, "_build_blocks", torn)
    index_store.append(corpus, path, range_bits=4)
    assert hits(index_store.search_stored(queries, index_store.load(spark, path), 5)) == expected


def test_blocks_are_sent_by_the_bucket_of_their_terms_in_fewer_bytes(spark, stored):
    terms = ["", "a", "été", "seven77", "eight888", "twelve letters", "漢字漢字漢字", "x" * 31, "y" * 23, *WORDS]
    rows = spark.createDataFrame([(t,) for t in terms], "term string").select("term", index_store._term_bucket(F.col("term")))
    want = dict(map(tuple, rows.collect()))
    assert index_store._routes(pa.array(terms)).tolist() == [want[t] for t in terms]
    assert index_store._routes(pa.array([None, *terms, "z" * 40])[1:]).tolist() == [*(want[t] for t in terms), 0]

    chunks = index_store.load(spark, stored).chunks
    kept = chunks.select("range", "id", "chunk_no", F.unix_date("doc_date").alias("day"), F.size("tokens").alias("doc_len"), "tokens")
    made = list(index_store._build_blocks(iter(kept.coalesce(1).orderBy("range").toArrow().combine_chunks().to_batches())))
    packed = list(index_store._packed_blocks(lambda x: x)(iter(made)))
    assert all(b.num_rows == len(set(b.column("route").to_pylist())) for b in packed)
    found = [row for b in index_store._unpacked_blocks(iter(packed)) for row in b.to_pylist()]
    key = itemgetter("range", "term")
    assert sorted(found, key=key) == sorted((row for b in made for row in b.to_pylist()), key=key)

    wide = chunks.select("id", "tokens", "buckets").unionByName(spark.createDataFrame([(-1, [], [])], "id long, tokens array<string>, buckets array<int>"))
    back = index_store._widened(index_store._narrow(wide, 32), wide.schema)
    assert back.schema.simpleString() == wide.schema.simpleString() and sorted(back.collect()) == sorted(wide.collect())


def test_finished_shuffles_of_a_segment_are_deleted(spark, corpus, monkeypatch):
    freed = []
    monkeypatch.setattr(index_store, "release", lambda s, f=index_store.release: freed.append(s) or f(s))
    index_store.append(corpus, scratch_path(spark, "index"), range_bits=3)
    assert len(freed) == 2
