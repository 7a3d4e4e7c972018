"""Queries for scans, sinks and the compute-if-absent store. Files go to the shared scratch folder."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tidemark.functions import format_day
from tidemark.queries.registry import query, table
from tidemark.session import scratch_path
from tidemark.sources import (
    explode_responses, load_split, map_batches, materialize_missing, read_json_array, read_ndjson, unpack_tables,
    write_csv, write_leaderboard, write_ndjson, write_table,
)

EVENTS_SQL = "SELECT event_id, user_id, event_type, value, props FROM events"
EVENT_COLUMNS = ["event_id", "user_id", "event_type", "value", "props"]
EVENT_SCHEMA = "event_id bigint, user_id bigint, event_type string, value double, props string"
ORDER_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"]
ORDERS_SQL = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders"


def json_array_files(rows: DataFrame, path: str, keys: tuple[str, ...] = ()) -> None:
    """Write rows as many files of one JSON array each, or of one object with an array per key.

    A file holds one Arrow batch, so its size is bounded whatever the rows are.
    """
    whole = F.to_json(F.struct(*rows.columns)).alias("row")
    texts = rows.select(*([F.to_json(k).alias(k) for k in keys] or [whole]))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        arrays = {c: f"[{','.join(pdf[c].dropna())}]" for c in pdf.columns}
        if not keys:
            return pd.DataFrame({"value": [arrays["row"]]})
        return pd.DataFrame({"value": ["{" + ",".join(f'"{k}":{arrays[k]}' for k in keys) + "}"]})

    files = map_batches(texts, pack, "value string", 5000)
    files.write.option("maxRecordsPerFile", 1).text(path)


@query("sc1_read_json_array", EVENTS_SQL)
def sc1(spark, d):
    path = scratch_path(spark, "array")
    json_array_files(table(spark, d, "events").select(*EVENT_COLUMNS), path)
    return read_json_array(spark, path).select(*EVENT_COLUMNS)


@query("sc2_read_ndjson", EVENTS_SQL)
def sc2(spark, d):
    path = scratch_path(spark, "ndjson")
    table(spark, d, "events").select(*EVENT_COLUMNS).write.json(path)
    return read_ndjson(spark, path).select(*EVENT_COLUMNS)


@query("sc3_read_table", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderpriority FROM orders")
def sc3(spark, d):
    rows = table(spark, d, "orders")
    return rows.withColumn("day", format_day(F.col("o_orderdate"))).drop("o_orderdate")


@query("sc4_map_batches", "SELECT doc_id, length(text) AS chars, len(string_split(text, ' ')) AS words FROM documents")
def sc4(spark, d):
    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({
            "doc_id": pdf["doc_id"], "chars": pdf["text"].str.len(), "words": pdf["text"].str.count(" ") + 1
        })

    return map_batches(table(spark, d, "documents").select("doc_id", "text"), count, "doc_id bigint, chars bigint, words bigint", 500)


@query("sc5_write_zstd_parquet", ORDERS_SQL)
def sc5(spark, d):
    path = scratch_path(spark, "zstd")
    write_table(table(spark, d, "orders").select(*ORDER_COLUMNS), path, compression="zstd")
    return spark.read.parquet(path)


@query("sc6_write_parquet", ORDERS_SQL)
def sc6(spark, d):
    path = scratch_path(spark, "parquet")
    write_table(table(spark, d, "orders").select(*ORDER_COLUMNS), path)
    return spark.read.parquet(path)


@query("sc7_export_ndjson", "SELECT event_id, user_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_type END AS event_type FROM events")
def sc7(spark, d):
    path = scratch_path(spark, "export")
    kind = F.when(F.col("event_id") % 3 != 0, F.col("event_type"))
    write_ndjson(table(spark, d, "events").select("event_id", "user_id", kind.alias("event_type")), path)
    return read_ndjson(spark, path, "event_id bigint, user_id bigint, event_type string")


@query("sc8_explode_responses", """
    SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN event_type END AS title, CASE WHEN event_id % 3 = 0 THEN value END AS price FROM events""")
def sc8(spark, d):
    path = scratch_path(spark, "responses")
    k = F.col("event_id")
    rows = table(spark, d, "events").select(
        "event_id",
        F.when(k % 3 != 0, F.struct("event_id", F.col("event_type").alias("title"))).alias("PubmedArticle"),
        F.when(k % 3 == 0, F.struct("event_id", F.col("value").alias("price"))).alias("PubmedBookArticle"),
    )
    json_array_files(rows, path, keys=("PubmedArticle", "PubmedBookArticle"))
    schema = (
        "PubmedArticle array<struct<event_id:bigint,title:string>>, "
        "PubmedBookArticle array<struct<event_id:bigint,price:double>>"
    )
    return explode_responses(read_json_array(spark, path, schema), ["PubmedArticle", "PubmedBookArticle"])


@query("sc9_unpack_tables", """
    SELECT 'task' || (o_orderkey % 2) || '_Phase' || (o_orderkey // 2 % 4 + 1) || '_x' AS table_name, o_orderkey::VARCHAR AS row_index,
      CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderpriority END AS title, o_custkey::VARCHAR AS customer FROM orders""")
def sc9(spark, d):
    k = F.col("o_orderkey")
    title = F.when(k % 5 == 0, "nan").otherwise(F.concat(F.lit("'"), F.col("o_orderpriority"), F.lit("'")))
    literal = F.concat(
        F.lit("{'title': {'"), k.cast("string"), F.lit("': "), title, F.lit("}, 'customer': {'"), k.cast("string"),
        F.lit("': '"), F.col("o_custkey").cast("string"), F.lit("'}}"),
    )
    packed = table(spark, d, "orders").select(
        F.concat(F.lit("task"), (k % 2).cast("string")).alias("task"),
        F.concat(F.lit("Phase"), (F.floor(k / 2) % 4 + 1).cast("string")).alias("phase"),
        F.lit("x").alias("type"), literal.alias("data"),
    )
    return unpack_tables(packed, ["title", "customer"])


@query("sc10_load_split", """
    SELECT doc_id AS nctid, quality AS label FROM documents LEFT JOIN labels USING (doc_id) WHERE doc_id % 10 IN (6, 7)""")
def sc10(spark, d):
    k = F.col("doc_id")
    rows = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left")
    split = F.when(k % 10 < 6, "train").when(k % 10 < 8, "val").otherwise("test")
    tasks = F.explode(F.array(
        F.struct(F.lit("quality").alias("task"), F.col("quality").alias("label")),
        F.struct(F.lit("toxic").alias("task"), F.col("toxic").alias("label")),
    )).alias("t")
    stored = rows.select(k.alias("nctid"), split.alias("split"), tasks).select("nctid", "split", "t.*")
    path = scratch_path(spark, "splits")
    write_table(stored, path, partition_by=["task", "split"])
    return load_split(spark.read.parquet(path), "quality", "val", known_tasks=["quality", "toxic"]).select("nctid", "label")


@query("sc12_write_leaderboard", "SELECT user_id, count(*) AS n, round(avg(value), 6) AS mean_value FROM events GROUP BY user_id")
def sc12(spark, d):
    path = scratch_path(spark, "leaderboard")
    board = table(spark, d, "events").groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean_value")
    )
    write_leaderboard(board, path)
    return read_ndjson(spark, path, "user_id bigint, n bigint, mean_value double")


@query("sc13_write_csv", """
    SELECT p_partkey, p_name, '["' || array_to_string(string_split(p_name, ' '), '","') || '"]' AS words, p_size FROM part""")
def sc13(spark, d):
    path = scratch_path(spark, "csv")
    rows = table(spark, d, "part").select("p_partkey", "p_name", F.split("p_name", " ").alias("words"), "p_size")
    write_csv(rows, path)
    schema = "p_partkey bigint, p_name string, words string, p_size int"
    # The writer escapes quotes with a backslash, which is the reader's default as well.
    return spark.read.option("header", True).schema(schema).csv(path)


@query("sc14_materialize_missing", """
    SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'stored' WHEN doc_id % 7 = 0 THEN 'failed' ELSE 'computed' END AS origin,
      CASE WHEN doc_id % 2 = 1 AND doc_id % 7 = 0 THEN NULL ELSE n_chars END AS chars FROM documents""")
def sc14(spark, d):
    store = scratch_path(spark, "store")
    docs = table(spark, d, "documents").select("doc_id", "n_chars")

    def compute(origin: str, fails):
        def run(todo: DataFrame) -> DataFrame:
            ok = ~fails(F.col("doc_id"))
            return todo.select(
                "doc_id", F.when(ok, F.lit(origin)).otherwise("failed").alias("origin"),
                F.when(ok, F.col("n_chars")).alias("chars"), ok.alias("ok"),
            )
        return run

    even = docs.filter("doc_id % 2 = 0")
    materialize_missing(even, store, "plan1", compute("stored", lambda k: k < 0), ["doc_id"])
    return materialize_missing(docs, store, "plan1", compute("computed", lambda k: k % 7 == 0), ["doc_id"]).rows
