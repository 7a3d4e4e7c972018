"""Incremental queries: the same tables arriving in several files and micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.operators import index_store
from tidemark.queries.registry import query, table
from tidemark.queries.retrieval import KEYWORD_SQL, QUERIES_SQL, chunk_sql, corpus, passages, top_sql
from tidemark.session import release, scratch_path
from tidemark.sources import keyed
from tidemark.streaming import ingest


def shuffle_tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def arriving(df: DataFrame, key: str, batches: int = 3) -> DataFrame:
    """The rows as a file stream of so many micro-batches, or a few more if some files are empty. All rows of a key are in
    one file, so in one batch; a batch has as many files as the session's shuffles have tasks for it."""
    spark = df.sparkSession
    path = scratch_path(spark, "arriving")
    df.repartition(batches * -(-shuffle_tasks(spark) // batches), key).write.option("compression", "zstd").parquet(path)
    release(spark)
    files = len(spark.read.schema(df.schema).parquet(path).inputFiles())
    return ingest.read_stream(spark, path, df.schema, files_per_batch=max(1, files // batches))


@query("st1_stream_upsert", "SELECT DISTINCT l_orderkey, l_linenumber, l_returnflag FROM lineitem")
def st1(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    store = scratch_path(spark, "upserted")
    ingest.stream_upsert(arriving(rows, "l_orderkey"), store, "l_orderkey", scratch_path(spark, "checkpoint"))
    return spark.read.parquet(store).drop("batch_id")


@query("st1_stream_keyed", """
    SELECT DISTINCT l_orderkey, l_linenumber, l_returnflag FROM lineitem
    JOIN (SELECT l_orderkey, min(l_linenumber % 3) AS batch FROM lineitem GROUP BY l_orderkey) USING (l_orderkey)
    WHERE l_linenumber % 3 = batch""")
def st1_keyed(spark, d):
    """Keys come again in later batches and are skipped; the store is compacted on the way and a batch is replayed."""
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    files, checkpoint = scratch_path(spark, "arriving"), scratch_path(spark, "checkpoint")
    store = keyed.KeyedStore(scratch_path(spark, "keyed"), "l_orderkey", 16)
    n = shuffle_tasks(spark)
    for part in range(3):
        rows.where(F.col("l_linenumber") % 3 == part).repartition(n).write.mode("append").parquet(files)
        # What has come since the last drain is one micro-batch, whose number is that of the part.
        ingest.stream_keyed(ingest.read_stream(spark, files, rows.schema, files_per_batch=n), store, checkpoint)
        if part:
            keyed.compact(spark, store)
    keyed.upsert_keyed(rows.where("l_linenumber % 3 = 1"), store, "batch-1")
    return keyed.read_keyed(spark, store)


@query("st2_stream_index", f"""
    WITH RECURSIVE {chunk_sql()} SELECT id AS doc_id, chunk_no, md5(chunk) AS chunk_md5 FROM chunks""")
def st2(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    store = scratch_path(spark, "chunks")
    ingest.stream_index(arriving(docs, "doc_id"), store, "text", scratch_path(spark, "checkpoint"))
    return spark.read.parquet(store).select("doc_id", "chunk_no", F.md5("chunk").alias("chunk_md5"))


@query("st2_stream_segments", f"""
    WITH RECURSIVE {chunk_sql()}, {QUERIES_SQL}, {KEYWORD_SQL} SELECT * FROM {top_sql("keyword_scores", 10)}""")
def st2_segments(spark, d):
    """Hits of an index that grew by micro-batches and whose segments were merged."""
    path = scratch_path(spark, "index")
    ingest.stream_segments(arriving(corpus(spark, d), "id"), path, scratch_path(spark, "checkpoint"))
    index_store.merge(spark, path)
    return index_store.search_stored(passages(spark, d), index_store.load(spark, path), 10)


@query("st3_stream_features", """
    SELECT doc_id, n_chars AS chars, len(regexp_extract_all(text, '\\p{L}+')) AS words FROM documents WHERE doc_id % 7 <> 0""")
def st3(spark, d):
    from tidemark.functions import approx_tokens

    docs = table(spark, d, "documents").select("doc_id", "text", "n_chars")
    store = scratch_path(spark, "features")

    def compute(todo: DataFrame) -> DataFrame:
        words = approx_tokens(F.col("text")).cast("bigint")
        return todo.select("doc_id", F.col("n_chars").alias("chars"), words.alias("words"), (F.col("doc_id") % 7 != 0).alias("ok"))

    ingest.stream_features(arriving(docs, "doc_id"), store, "plan1", compute, ["doc_id"], scratch_path(spark, "checkpoint"))
    return spark.read.parquet(store).select("doc_id", "chars", "words")
