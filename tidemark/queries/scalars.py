"""Queries for the scalar functions, on values formatted or packed from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import functions as tf
from tidemark.operators.hybrid import DIVIDER, render_hits
from tidemark.operators.topk import top_k_per_key
from tidemark.queries.registry import query, table

PARTIAL_DATE_SQL = """
    CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y-%m')
      WHEN 2 THEN strftime(o_orderdate, '%Y') WHEN 3 THEN 'soon' ELSE NULL END"""


def partial_date():
    day, k = tf.format_day(F.col("o_orderdate")), F.col("o_orderkey")
    return (
        F.when(k % 5 == 0, day).when(k % 5 == 1, F.substring(day, 1, 7))
        .when(k % 5 == 2, F.substring(day, 1, 4)).when(k % 5 == 3, "soon")
    )


@query("s1_join_list", """
    SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN NULL WHEN p_size % 4 = 1 THEN p_type ELSE p_type || '-' || p_brand END AS phases FROM part""")
def s1(spark, d):
    size = F.col("p_size")
    items = F.when(size % 4 == 1, F.array("p_type")).when(size % 4 != 0, F.array("p_type", "p_brand"))
    return table(spark, d, "part").select("p_partkey", tf.join_list(items).alias("phases"))


@query("s2_document_text", """
    SELECT doc_id, md5('# ' || source || chr(10) || 'Keywords: ' || CASE WHEN doc_id % 3 = 0 THEN '' ELSE lang || ', ' || source END
      || chr(10) || chr(10) || CASE WHEN doc_id % 5 = 0 THEN '' ELSE array_to_string(string_split(text, chr(10)), chr(10) || chr(10)) END) AS text_md5
    FROM documents""")
def s2(spark, d):
    k = F.col("doc_id")
    terms = F.when(k % 3 != 0, F.array("lang", "source"))
    bodies = F.when(k % 5 != 0, F.split("text", "\n"))
    text = tf.document_text(F.col("source"), terms, F.array_join(bodies, "\n\n"), label="Keywords")
    return table(spark, d, "documents").select("doc_id", F.md5(text).alias("text_md5"))


@query("s3_parse_mixed_date", f"""
    SELECT o_orderkey, strftime(CASE length(t) WHEN 10 THEN try_strptime(t, '%Y-%m-%d') WHEN 7 THEN try_strptime(t, '%Y-%m')
      WHEN 4 THEN try_strptime(t, '%Y') END, '%Y-%m-%d') AS day
    FROM (SELECT o_orderkey, {PARTIAL_DATE_SQL} AS t FROM orders)""")
def s3(spark, d):
    parsed = tf.parse_mixed_date(partial_date())
    return table(spark, d, "orders").select("o_orderkey", tf.format_day(parsed).alias("day"))


@query("s4_date_from_parts", """
    SELECT o_orderkey, CASE
      WHEN o_orderkey % 7 = 0 THEN NULL
      WHEN o_orderkey % 7 = 1 THEN strftime(o_orderdate, '%Y') || '-01-01'
      WHEN o_orderkey % 7 = 2 THEN strftime(o_orderdate, '%Y-%m') || '-01'
      WHEN o_orderkey % 7 = 3 THEN NULL
      ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders""")
def s4(spark, d):
    k, date = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    month = F.when(k % 7 != 1, F.when(k % 7 == 3, "2").otherwise(F.month(date).cast("string")))
    day = F.when(k % 7 > 2, F.when(k % 7 == 3, "31").otherwise(F.dayofmonth(date).cast("string")))
    parts = F.struct(F.year(date).cast("string").alias("Year"), month.alias("Month"), day.alias("Day"))
    rows = table(spark, d, "orders").select("o_orderkey", F.when(k % 7 != 0, parts).alias("parts"))
    return rows.select("o_orderkey", tf.format_day(tf.date_from_parts(F.col("parts"))).alias("day"))


@query("s5_format_day", "SELECT event_id, strftime(ts, '%Y-%m-%d') AS day FROM events")
def s5(spark, d):
    return table(spark, d, "events").select("event_id", tf.format_day(F.col("ts")).alias("day"))


@query("s6_year_text", "SELECT o_orderkey, CAST(year(o_orderdate) AS VARCHAR) AS start_year FROM orders")
def s6(spark, d):
    return table(spark, d, "orders").select("o_orderkey", tf.year_text(F.col("o_orderdate")).alias("start_year"))


@query("s7_coalesce", """
    SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%Y-%m') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS start_date FROM orders""")
def s7(spark, d):
    day = tf.format_day(F.col("o_orderdate"))
    stated = F.when(F.col("o_orderkey") % 3 == 0, F.substring(day, 1, 7))
    return table(spark, d, "orders").select("o_orderkey", F.coalesce(stated, day).alias("start_date"))


@query("s8_parse_list_literal", """
    SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN p_name WHEN 2 THEN NULL
        WHEN 3 THEN array_to_string(list_transform(string_split(p_name, ' '), lambda x: x || '''s'), '|')
        ELSE array_to_string(string_split(p_name, ' '), '|') || '|None' END AS items,
      CASE p_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 1 WHEN 2 THEN NULL WHEN 3 THEN len(string_split(p_name, ' '))
        ELSE len(string_split(p_name, ' ')) + 2 END AS n
    FROM part""")
def s8(spark, d):
    words, k = F.split("p_name", " "), F.col("p_partkey")
    double_quoted = F.array_join(F.transform(words, lambda w: F.concat(F.lit('"'), w, F.lit("'s\""))), ", ")
    single_quoted = F.array_join(F.transform(words, lambda w: F.concat(F.lit("'"), w, F.lit("'"))), ", ")
    text = (
        F.when(k % 5 == 1, F.col("p_name"))
        .when(k % 5 == 2, F.concat(F.lit("["), F.col("p_name")))
        .when(k % 5 == 3, F.concat(F.lit("["), double_quoted, F.lit("]")))
        .when(k % 5 == 4, F.concat(F.lit("["), single_quoted, F.lit(", 'None', None]")))
    )
    rows = table(spark, d, "part").select("p_partkey", tf.parse_list_literal(text).alias("list"))
    n = F.when(F.col("list").isNotNull(), F.size("list").cast("bigint"))
    return rows.select("p_partkey", F.array_join("list", "|").alias("items"), n.alias("n"))


@query("s9_nested_list_literal", """
    SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN NULL WHEN p_partkey % 4 = 1 THEN p_type
      ELSE array_to_string(string_split(p_name, ' '), '|') END AS codes FROM part""")
def s9(spark, d):
    k = F.col("p_partkey")
    inner = F.array_join(F.transform(F.split("p_name", " "), lambda w: F.concat(F.lit("'"), w, F.lit("'"))), ", ")
    text = (
        F.when(k % 4 == 1, F.concat(F.lit("['"), F.col("p_type"), F.lit("']")))
        .when(k % 4 > 1, F.concat(F.lit('["['), inner, F.lit(']", "[\'other\']"]')))
    )
    codes = F.array_join(tf.parse_nested_list_literal(text), "|")
    return table(spark, d, "part").select("p_partkey", codes.alias("codes"))


@query("s10_pad_start_date", f"""
    SELECT o_orderkey, CASE WHEN length(t) < 10 THEN t || '-01' ELSE t END AS padded
    FROM (SELECT o_orderkey, {PARTIAL_DATE_SQL} AS t FROM orders)""")
def s10(spark, d):
    return table(spark, d, "orders").select("o_orderkey", tf.pad_start_date(partial_date()).alias("padded"))


@query("s11_is_missing", "SELECT event_id, event_id % 3 < 2 AS missing FROM events")
def s11(spark, d):
    k = F.col("event_id")
    value = F.when(k % 3 == 0, F.lit(float("nan"))).when(k % 3 == 2, F.col("value"))
    return table(spark, d, "events").select("event_id", tf.is_missing(value, floating=True).alias("missing"))


@query("s12_concat_people", """
    SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'I' || o_custkey || ',J' || o_custkey || ',K' || o_orderkey END
      || CASE WHEN o_orderkey % 3 = 0 OR o_orderkey % 4 = 0 THEN '' ELSE ',' END
      || CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE 'A' || o_orderkey END AS people FROM orders""")
def s12(spark, d):
    k = F.col("o_orderkey")

    def person(prefix: str, column: str):
        return F.struct(F.concat(F.lit(prefix), F.col(column).cast("string")).alias("name"))

    nested = F.array(
        F.array(person("I", "o_custkey"), person("J", "o_custkey")),
        F.lit(None).cast("array<struct<name:string>>"),
        F.array(person("K", "o_orderkey")),
    )
    people = tf.concat_people(
        F.when(k % 3 != 0, nested), F.when(k % 4 != 0, F.array(person("A", "o_orderkey"))), "struct<name:string>"
    )
    names = F.array_join(F.transform(people, lambda p: p["name"]), ",")
    return table(spark, d, "orders").select("o_orderkey", names.alias("people"))


@query("s13_json", """
    SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
      '{"k":' || json_extract_string(props, '$.k') || ',"note":null}' AS encoded FROM events""")
def s13(spark, d):
    rows = table(spark, d, "events").select("event_id", tf.decode_json(F.col("props"), "k bigint, note string").alias("p"))
    return rows.select("event_id", F.col("p.k").alias("k"), tf.encode_json(F.col("p")).alias("encoded"))


@query("s14_content_hash", """
    SELECT p_partkey, sha256('["' || array_to_string(list_sort([p_name, p_brand, p_type]), '","') || '"]') AS hash FROM part""")
def s14(spark, d):
    return table(spark, d, "part").select("p_partkey", tf.content_hash(F.array("p_type", "p_name", "p_brand")).alias("hash"))


@query("s15_strip_quotes", """
    SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN p_name WHEN 1 THEN p_name WHEN 2 THEN p_name WHEN 3 THEN '"' || p_name
      WHEN 4 THEN '' ELSE '"' || p_name || '"' END AS bare FROM part""")
def s15(spark, d):
    k, name = F.col("p_partkey"), F.col("p_name")
    quoted = (
        F.when(k % 6 == 0, F.concat(F.lit('"'), name, F.lit('"')))
        .when(k % 6 == 1, F.concat(F.lit("\"'"), name, F.lit("'\"")))
        .when(k % 6 == 2, F.concat(F.lit("'"), name, F.lit("'")))
        .when(k % 6 == 3, F.concat(F.lit('"'), name))
        .when(k % 6 == 4, F.lit('"'))
        .otherwise(F.concat(F.lit("'\""), name, F.lit("\"'")))
    )
    return table(spark, d, "part").select("p_partkey", tf.strip_quotes(quoted).alias("bare"))


@query("s16_word_tests", """
    SELECT event_id, CASE lower(t) WHEN 'true' THEN 1.0::DOUBLE WHEN 'false' THEN 0.0::DOUBLE END AS flag,
      CASE WHEN regexp_full_match(t, '[0-9]+') THEN CAST(t AS DOUBLE) END AS digits,
      CASE WHEN regexp_full_match(t, '-?[0-9]+\\.[0-9]+') THEN CAST(t AS DOUBLE) END AS decimal_value
    FROM (SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'True' WHEN 1 THEN 'FALSE' WHEN 2 THEN event_id::VARCHAR WHEN 3 THEN '-3'
      WHEN 4 THEN '-' || event_id::VARCHAR || '.25' WHEN 5 THEN '1e3' ELSE event_type END AS t FROM events)""")
def s16(spark, d):
    k = F.col("event_id")
    text = (
        F.when(k % 7 == 0, "True").when(k % 7 == 1, "FALSE").when(k % 7 == 2, k.cast("string")).when(k % 7 == 3, "-3")
        .when(k % 7 == 4, F.concat(F.lit("-"), k.cast("string"), F.lit(".25"))).when(k % 7 == 5, "1e3")
        .otherwise(F.col("event_type"))
    )
    rows = table(spark, d, "events").select("event_id", text.alias("t"))
    return rows.select(
        "event_id", tf.to_boolean(F.col("t")).alias("flag"), tf.to_digits(F.col("t")).alias("digits"),
        tf.to_float(F.col("t")).alias("decimal_value"),
    )


@query("s17_approx_tokens", "SELECT doc_id, len(regexp_extract_all(text, '\\p{L}+')) AS approx_tokens FROM documents")
def s17(spark, d):
    n = tf.approx_tokens(F.col("text")).cast("bigint")
    return table(spark, d, "documents").select("doc_id", n.alias("approx_tokens"))


@query("s18_render_hits", """
    SELECT s AS query_id, string_agg('{"part":' || p || ',"price":null,"flag":"' || f || '"}', chr(10) || chr(10) || '---------' || chr(10) || chr(10) ORDER BY rank) AS rendered
    FROM (SELECT l_suppkey AS s, l_partkey AS p, l_returnflag AS f, row_number() OVER (PARTITION BY l_suppkey
      ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) AS rank FROM lineitem)
    WHERE rank <= 10 GROUP BY s""")
def s18(spark, d):
    rows = table(spark, d, "lineitem").withColumnRenamed("l_suppkey", "query_id")
    order = [F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber"), F.asc("l_partkey")]
    best = top_k_per_key(rows, ["query_id"], order, 10).select(
        "query_id", "rank", F.col("l_partkey").alias("part"), F.lit(None).cast("double").alias("price"),
        F.col("l_returnflag").alias("flag"),
    )
    return render_hits(best, ["part", "price", "flag"])


@query("s20_parse_reply", """
    SELECT conv_id, turn, CASE WHEN turn % 3 = 2 THEN NULL ELSE role || '|' || conv_id END AS university,
      CASE WHEN turn % 3 = 2 THEN NULL WHEN turn % 3 = 1 THEN 0::BIGINT ELSE 1::BIGINT END AS n_countries, turn % 3 = 2 AS corrupt FROM conversations""")
def s20(spark, d):
    turn, conv = F.col("turn"), F.col("conv_id").cast("string")
    reply = F.concat(
        F.lit('{"university": ["'), F.col("role"), F.lit('", "'), conv, F.lit('"], "institutes": [], "companies": null, "countries": '),
        F.when(turn % 3 == 0, '["DE"]').when(turn % 3 == 1, "[]").otherwise('["DE"'), F.lit("}"),
    )
    rows = table(spark, d, "conversations").select("conv_id", "turn", tf.parse_reply(reply).alias("r"))
    corrupt = F.col("r._corrupt_record").isNotNull()
    return rows.select(
        "conv_id", "turn", F.when(~corrupt, F.array_join("r.university", "|")).alias("university"),
        F.when(~corrupt, F.size("r.countries").cast("bigint")).alias("n_countries"), corrupt.alias("corrupt"),
    )
