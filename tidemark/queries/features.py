"""Feature queries: raw values built from documents, bad ones mixed in by fixed rules."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.functions import is_subset
from tidemark.operators import features as ops, long_matrix
from tidemark.plans import feature_plan as plans
from tidemark.queries.registry import query, table

LANGS = ["de", "en", "es", "fr"]
TAGS = ["long", "digits", "accent", "lines"]


def plan(spark: SparkSession) -> DataFrame:
    rows = [
        (0, "size", "chars", "integer", None),
        (0, "language", "lang", "categorical", LANGS),
        (1, "flags", "tags", "multi-categorical", TAGS),
        (1, "shape", "has_digit", "boolean", None),
        (1, "shape", "avg_word", "float", None),
        (2, "density", "ratio", "float", None),
    ]
    names = ["group_no", "feature", "sub", "type", "possible_values"]
    return plans.plan_table(spark, [dict(zip(names, r), idea=r[1], sources=["pubmed"]) for r in rows])


def raw_values(spark: SparkSession, d: str) -> DataFrame:
    """Long raw values of every document, with each kind of bad value on some of them."""
    k, n = F.col("doc_id"), F.col("n_chars")
    text = n.cast("string")
    tags = F.when(n > 1500, '["long", "lines"]').otherwise('["accent", "accent"]')

    def value(group: int, feature: str, sub, raw, when=None):
        entry = F.struct(
            F.lit(group).alias("group_no"), F.lit(feature).alias("feature"),
            (sub if sub is not None else F.lit(None).cast("string")).alias("sub"), raw.cast("string").alias("raw"),
        )
        return entry if when is None else F.when(when, entry)

    size = F.when(k % 7 == 1, "-3").when(k % 7 == 2, F.concat(F.lit('"'), text, F.lit('"'))).when(k % 7 == 3, "None").otherwise(text)
    lang = F.when(k % 7 == 4, "xx").when(k % 7 == 5, F.concat(F.lit("'"), F.col("lang"), F.lit("'"))).otherwise(F.col("lang"))
    flags = (
        F.when(k % 7 == 0, "[]").when(k % 7 == 1, '[1, "long"]').when(k % 7 == 2, '["long"').when(k % 7 == 3, '["None"]')
        .when(k % 7 == 5, '["zzz"]').when((k % 7 == 4) & (k % 3 == 0), '["digits", ["long"]]').otherwise(tags)
    )
    digit = F.when(k % 7 == 2, '"false"').when(k % 7 == 6, "yes").when(n % 2 == 0, "True").otherwise("False")
    word = F.when(k % 7 == 1, "5").when(k % 7 == 4, "1e3").otherwise(
        F.concat(F.floor(n / 100).cast("string"), F.lit("."), (n % 100).cast("string"))
    )
    ratio = F.concat(F.lit("-"), (k % 10).cast("string"), F.lit(".25"))
    entries = F.array(
        value(0, "size", F.lit("chars"), size),
        value(0, "language", F.when(k % 17 != 4, "lang"), F.when(k % 17 != 4, lang)),
        value(1, "flags", F.lit("tags"), flags),
        value(1, "shape", F.lit("has_digit"), digit),
        value(1, "shape", F.lit("avg_word"), word),
        value(1, "shape", F.lit("oops"), F.lit("1"), k % 11 == 3),
        value(2, "density", F.lit("ratio"), ratio, k % 13 != 5),
        value(2, "extra", F.lit("foo"), F.lit("bar")),
    )
    rows = table(spark, d, "documents").select(k.alias("id"), F.explode(F.array_compact(entries)).alias("e"))
    return rows.select("id", "e.*")


def coerced(spark: SparkSession, d: str) -> DataFrame:
    return ops.coerce(raw_values(spark, d), plan(spark))


def wide(spark: SparkSession, d: str) -> DataFrame:
    return ops.to_wide(coerced(spark, d), plans.collect_plan(plan(spark)))


BASE_SQL = """
docs AS (SELECT doc_id AS k, n_chars AS n, lang, doc_id % 11 = 3 OR (doc_id % 7 = 4 AND doc_id % 3 = 0) AS fail1 FROM documents),
wide AS (SELECT k AS id,
  CASE WHEN k % 7 IN (1, 3) THEN NULL ELSE n::DOUBLE END AS size_chars,
  CASE WHEN k % 17 = 4 OR k % 7 = 4 THEN NULL ELSE lang END AS language_lang,
  CASE WHEN fail1 OR k % 7 IN (1, 2, 3, 5) THEN NULL WHEN k % 7 = 0 THEN []::VARCHAR[]
    WHEN n > 1500 THEN ['long', 'lines'] ELSE ['accent', 'accent'] END AS flags_tags,
  CASE WHEN fail1 OR k % 7 = 6 THEN NULL WHEN k % 7 = 2 THEN 0.0::DOUBLE ELSE CAST(n % 2 = 0 AS INT)::DOUBLE END AS shape_has_digit,
  CASE WHEN fail1 OR k % 7 IN (1, 4) THEN NULL ELSE ((n // 100)::VARCHAR || '.' || (n % 100)::VARCHAR)::DOUBLE END AS shape_avg_word,
  CASE WHEN k % 13 = 5 THEN NULL ELSE -(k % 10 + 0.25)::DOUBLE END AS density_ratio FROM docs)"""

VALUES_SQL = f"""{BASE_SQL},
typed AS (
  SELECT id, 'size' AS feature, 'chars' AS sub, size_chars AS num, NULL::VARCHAR AS txt, NULL::VARCHAR AS items FROM wide
  UNION ALL SELECT id, 'language', 'lang', NULL, language_lang, NULL FROM wide
  UNION ALL SELECT id, 'flags', 'tags', NULL, NULL, array_to_string(flags_tags, '|') FROM wide
  UNION ALL SELECT id, 'shape', 'has_digit', shape_has_digit, NULL, NULL FROM wide
  UNION ALL SELECT id, 'shape', 'avg_word', shape_avg_word, NULL, NULL FROM wide
  UNION ALL SELECT id, 'density', 'ratio', density_ratio, NULL, NULL FROM wide)"""


@query("f4_coerce", f"WITH {VALUES_SQL} SELECT * FROM typed")
def f4(spark, d):
    rows = coerced(spark, d)
    return rows.select("id", "feature", "sub", "num", "txt", F.array_join("items", "|").alias("items"))


@query("f4s_coerce_strict", """
    WITH docs AS (SELECT doc_id AS k, n_chars AS n, lang,
        doc_id % 7 = 6 OR doc_id % 11 = 3 OR doc_id % 7 = 1 OR doc_id % 7 = 4 OR doc_id % 7 = 2 AS bad_shape FROM documents)
    SELECT k AS id, 'size' AS feature, 'chars' AS sub, CASE WHEN k % 7 IN (1, 3) THEN NULL ELSE n::DOUBLE END AS num, NULL::VARCHAR AS txt FROM docs
    UNION ALL SELECT k, 'language', 'lang', NULL, CASE WHEN k % 17 = 4 OR k % 7 = 4 THEN NULL ELSE lang END FROM docs
    UNION ALL SELECT k, 'flags', 'tags', NULL, CASE WHEN k % 7 IN (1, 2, 3, 5) OR (k % 7 = 4 AND k % 3 = 0) THEN NULL WHEN k % 7 = 0 THEN '[]'
      WHEN n > 1500 THEN '["long", "lines"]' ELSE '["accent", "accent"]' END FROM docs
    UNION ALL SELECT k, 'shape', 'has_digit', CASE WHEN bad_shape AND NOT (k % 7 = 2 AND FALSE) THEN NULL ELSE CAST(n % 2 = 0 AS INT)::DOUBLE END, NULL FROM docs
    UNION ALL SELECT k, 'shape', 'avg_word', CASE WHEN bad_shape THEN NULL ELSE ((n // 100)::VARCHAR || '.' || (n % 100)::VARCHAR)::DOUBLE END, NULL FROM docs
    UNION ALL SELECT k, 'density', 'ratio', -(k % 10 + 0.25)::DOUBLE, NULL FROM docs WHERE k % 13 <> 5""")
def f4s(spark, d):
    return ops.coerce_strict(raw_values(spark, d), plan(spark)).select("id", "feature", "sub", "num", "txt")


@query("f5_to_wide", f"""
    WITH {BASE_SQL} SELECT id, size_chars AS "size--chars", language_lang AS "language--lang", array_to_string(flags_tags, '|') AS "flags--tags",
      shape_has_digit AS "shape--has_digit", shape_avg_word AS "shape--avg_word", density_ratio AS "density--ratio" FROM wide""")
def f5(spark, d):
    return wide(spark, d).withColumn("flags--tags", F.array_join("flags--tags", "|"))


@query("f6_one_hot", f"""
    WITH {BASE_SQL} SELECT id, {", ".join(f"CASE WHEN language_lang = '{v}' THEN 1.0 ELSE 0.0 END::DOUBLE AS is_{v}" for v in LANGS)} FROM wide""")
def f6(spark, d):
    columns = ops.one_hot(F.col("language--lang"), LANGS)
    return wide(spark, d).select("id", *[c.alias(f"is_{v}") for c, v in zip(columns, LANGS)])


@query("f7_multi_hot", f"""
    WITH {BASE_SQL} SELECT id, {", ".join(f"coalesce(len(list_filter(flags_tags, lambda x: x = '{v}')), 0)::DOUBLE AS n_{v}" for v in TAGS)} FROM wide""")
def f7(spark, d):
    columns = ops.multi_hot(F.col("flags--tags"), TAGS)
    return wide(spark, d).select("id", *[c.alias(f"n_{v}") for c, v in zip(columns, TAGS)])


@query("f8_impute", f"""
    WITH {BASE_SQL} SELECT id, coalesce(size_chars, 0.0) AS filled, CAST(size_chars IS NULL AS INT)::DOUBLE AS gap FROM wide""")
def f8(spark, d):
    filled, gap = ops.impute(F.col("size--chars"), "xgb")
    return wide(spark, d).select("id", filled.alias("filled"), gap.alias("gap"))


@query("f9_bool01", f"WITH {BASE_SQL} SELECT id, coalesce(shape_has_digit, 0.0) AS flag, coalesce(shape_has_digit, 1.0) AS flag_null_true FROM wide")
def f9(spark, d):
    value = F.col("shape--has_digit")
    return wide(spark, d).select("id", ops.bool01(value).alias("flag"), ops.bool01(value, 1.0).alias("flag_null_true"))


@query("f10_design_matrix", f"""
    WITH {BASE_SQL} SELECT id, coalesce(len(list_filter(flags_tags, lambda x: x = 'long')), 0)::DOUBLE AS x_long,
      coalesce(len(list_filter(flags_tags, lambda x: x = 'accent')), 0)::DOUBLE AS x_accent,
      CASE WHEN language_lang = 'en' THEN 1.0 ELSE 0.0 END::DOUBLE AS x_en, coalesce(size_chars, 0.0) AS x_chars,
      coalesce(shape_avg_word, 0.0) AS x_word, coalesce(shape_has_digit, 0.0) AS x_digit, 12::INT AS n_inputs FROM wide""")
def f10(spark, d):
    subs = plans.collect_plan(plan(spark))
    matrix, names = ops.design_matrix(wide(spark, d), subs, "lr")
    at = {name: vector_to_array("features")[i] for i, name in enumerate(names)}
    return matrix.select(
        "id", at["flags--tags=long"].alias("x_long"), at["flags--tags=accent"].alias("x_accent"),
        at["language--lang=en"].alias("x_en"), at["size--chars"].alias("x_chars"), at["shape--avg_word"].alias("x_word"),
        at["shape--has_digit"].alias("x_digit"), F.size(vector_to_array("features")).alias("n_inputs"),
    )


@query("f10_long_matrix", f"""
    WITH {BASE_SQL}, entries AS (
      SELECT id, 0 AS position, size_chars AS x FROM wide
      {"".join(f"UNION ALL SELECT id, {p}, CAST(language_lang = '{v}' AS INT)::DOUBLE FROM wide " for p, v in enumerate(LANGS, -4))}
      {"".join(f"UNION ALL SELECT id, {p}, len(list_filter(flags_tags, lambda x: x = '{v}'))::DOUBLE FROM wide " for p, v in enumerate(TAGS, 1))}
      UNION ALL SELECT id, 5, shape_avg_word FROM wide UNION ALL SELECT id, 6, shape_has_digit FROM wide
      UNION ALL SELECT id, 7, density_ratio FROM wide)
    SELECT id, CAST(position + 4 AS INT) AS position, x FROM entries WHERE x <> 0""")
def f10_long(spark, d):
    inputs = long_matrix.input_table(plan(spark))
    found = long_matrix.entries(coerced(spark, d), inputs)
    return found.filter("position is not null").select("id", "position", "x")


def part_quantities(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Per customer, the largest quantity of every part that they ordered: a plan as long as the part table, and its values."""
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("feature"))
    subs = parts.select(
        F.lit(0).alias("group_no"), "feature", F.col("l_partkey").cast("string").alias("sub"), F.lit("float").alias("type"),
        F.lit(None).cast("array<string>").alias("possible_values"))
    lines = table(spark, d, "lineitem").join(parts, "l_partkey")
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("id"))
    values = lines.join(orders, "l_orderkey").select(
        "id", "feature", F.col("l_partkey").cast("string").alias("sub"), F.col("l_quantity").cast("double").alias("num"),
        F.lit(None).cast("string").alias("txt"), F.lit(None).cast("array<string>").alias("items"))
    return subs, values


@query("f10_large_plan", """
    WITH inputs AS (SELECT p_partkey, row_number() OVER (ORDER BY p_brand, p_partkey::VARCHAR) - 1 AS position FROM part),
    one AS (SELECT o_custkey AS id, l_partkey, max(l_quantity)::DOUBLE AS x FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)
    SELECT id, (SELECT count(*)::INT FROM part) AS n_inputs, count(*)::INT AS n_entries, sum(position)::BIGINT AS positions,
      sum(x * (position % 7))::DOUBLE AS mixed FROM one JOIN inputs ON l_partkey = p_partkey WHERE x <> 0 GROUP BY 1""")
def f10_large(spark, d):
    """Sparse vectors over one input per part, read back from the vectors themselves."""
    subs, values = part_quantities(spark, d)
    matrix = long_matrix.sparse_matrix(values, long_matrix.input_table(subs))
    v = F.unwrap_udt("features")
    mixed = F.aggregate(
        F.zip_with(v["indices"], v["values"], lambda p, x: x * (p % 7)), F.lit(0.0), lambda a, x: a + x)
    positions = F.aggregate(v["indices"], F.lit(0).cast("long"), lambda a, p: a + p)
    return matrix.select(
        "id", v["size"].alias("n_inputs"), F.size(v["indices"]).alias("n_entries"), positions.alias("positions"), mixed.alias("mixed"))


@query("p16_drop_feature", f"""
    WITH {VALUES_SQL} SELECT t.id, feature, sub, num, txt, size_chars AS "size--chars" FROM typed t JOIN wide USING (id) WHERE feature <> 'flags'""")
def p16(spark, d):
    subs = plans.collect_plan(plan(spark))
    values = coerced(spark, d)
    rows = ops.drop_feature(values, "flags").select("id", "feature", "sub", "num", "txt")
    slim = ops.to_wide(values, subs)
    for gone in ("flags", "language", "shape", "density"):
        slim = ops.drop_feature(slim, gone)
    return rows.join(slim, "id")


@query("j4_cross_groups", "SELECT doc_id AS id, g::INT AS group_no FROM documents, range(0, 3) r(g)")
def j4(spark, d):
    ids = table(spark, d, "documents").select(F.col("doc_id").alias("id"))
    return ops.cross_groups(ids, plans.collect_plan(plan(spark)))


def event_values(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(
        F.col("user_id").alias("id"), F.col("event_id").alias("group_no"), F.col("event_type").alias("feature"),
        F.col("props").alias("value"),
    )


LATEST_SQL = "SELECT user_id AS id, event_type AS feature, arg_max(props, event_id) AS v FROM events GROUP BY 1, 2"


@query("j5_merge_features", """
    SELECT user_id AS id, event_type AS feature, event_id AS sub, CASE WHEN event_id % 4 = 0 THEN 'new' ELSE 'old' END AS raw FROM events
    WHERE event_id % 4 = 0 OR (user_id, event_type) NOT IN (SELECT user_id, event_type FROM events WHERE event_id % 4 = 0)""")
def j5(spark, d):
    rows = table(spark, d, "events").select(
        F.col("user_id").alias("id"), F.col("event_type").alias("feature"), F.col("event_id").alias("sub")
    )
    old = rows.filter("sub % 4 <> 0").withColumn("raw", F.lit("old"))
    new = rows.filter("sub % 4 = 0").withColumn("raw", F.lit("new"))
    return ops.merge_features(old, new)


@query("a4_collect_features", f"SELECT id, string_agg(feature || '=' || v, ';' ORDER BY feature) AS features FROM ({LATEST_SQL}) GROUP BY id")
def a4(spark, d):
    rows = ops.collect_features(event_values(spark, d))
    texts = F.transform("features", lambda e: F.concat(e["feature"], F.lit("="), e["value"]))
    return rows.select("id", F.array_join(texts, ";").alias("features"))


@query("a5_collect_reasons", """
    SELECT id, string_agg(feature || ':' || v, ';' ORDER BY feature) AS reasons FROM (
      SELECT user_id AS id, event_type AS feature, arg_max('no ' || event_id, event_id) AS v FROM events GROUP BY 1, 2) GROUP BY id""")
def a5(spark, d):
    values = event_values(spark, d).withColumn("reason", F.concat(F.lit("no "), F.col("group_no").cast("string")))
    rows = ops.collect_reasons(values.drop("value"))
    texts = F.transform("reasons", lambda e: F.concat(e["feature"], F.lit(":"), e["reason"]))
    return rows.select("id", F.array_join(texts, ";").alias("reasons"))


@query("a6_multicat_counts", f"""
    WITH {BASE_SQL}, seen AS (SELECT unnest(flags_tags) AS item FROM wide)
    SELECT v AS item, (SELECT count(*) FROM seen WHERE item = v) AS n FROM (SELECT unnest({TAGS}) AS v)""")
def a6(spark, d):
    return ops.multicat_counts(wide(spark, d), "flags--tags", TAGS)


@query("f18_reasons", """
    SELECT user_id AS id, event_type AS feature, arg_max(CASE WHEN event_id % 4 = 0 THEN 'new ' ELSE 'old ' END || event_id,
      CASE WHEN event_id % 4 = 0 THEN 1000000000 ELSE 0 END + event_id) AS reason
    FROM events WHERE event_type <> 'error' GROUP BY 1, 2""")
def f18(spark, d):
    rows = table(spark, d, "events").select(
        F.col("user_id").alias("id"), F.col("event_id").alias("group_no"), F.col("event_type").alias("feature")
    )
    number = F.col("group_no").cast("string")
    old = rows.filter("group_no % 4 <> 0").withColumn("reason", F.concat(F.lit("old "), number))
    new = rows.filter("group_no % 4 = 0").withColumn("reason", F.concat(F.lit("new "), number))
    key = ["id", "feature"]
    merged = ops.merge_features(ops.latest_group(old, "reason", key), ops.latest_group(new, "reason", key))
    return ops.drop_feature(merged, "error").select("id", "feature", "reason")


@query("f18_reasons_of_validation", """
    SELECT id, list({'feature': feature, 'reason': reason} ORDER BY feature)::VARCHAR AS reasons FROM (
      SELECT user_id AS id, event_type AS feature, arg_max('r' || event_id, event_id) AS reason FROM events
      WHERE user_id % 10 IN (6, 7) GROUP BY 1, 2) GROUP BY id""")
def f18_validation(spark, d):
    rows = table(spark, d, "events").select(
        F.col("user_id").alias("id"), F.col("event_id").alias("group_no"), F.col("event_type").alias("feature"),
        F.concat(F.lit("r"), F.col("event_id").cast("string")).alias("reason"))
    k = F.col("id") % 10
    splits = rows.select("id").distinct().withColumn("split", F.when(k < 6, "train").when(k < 8, "val").otherwise("test"))
    listed = ops.collect_reasons(ops.of_split(rows, splits))
    text = F.transform("reasons", lambda r: F.concat(F.lit("{'feature': "), r["feature"], F.lit(", 'reason': "), r["reason"], F.lit("}")))
    return listed.select("id", F.concat(F.lit("["), F.array_join(text, ", "), F.lit("]")).alias("reasons"))


@query("f3_apply_groups", """
    SELECT doc_id AS id, g::INT AS group_no, CASE g WHEN 0 THEN 'size' ELSE 'words' END AS feature, 'n' AS sub,
      CASE WHEN doc_id % 7 = 0 AND g = 1 THEN NULL WHEN g = 0 THEN length(text)::VARCHAR ELSE len(string_split(text, ' '))::VARCHAR END AS raw,
      CASE WHEN g = 0 AND n_chars < 100 THEN 'short' END AS reason, NOT (doc_id % 7 = 0 AND g = 1) AS ok
    FROM documents, range(0, 2) r(g)""")
def f3(spark, d):
    subs = [plans.SubFeature(0, "size", "n", "integer", ()), plans.SubFeature(1, "words", "n", "integer", ())]

    def measure(record: dict, group: int):
        if group == 0:
            reasons = {"size": "short"} if record["n_chars"] < 100 else {}
            return {"size": {"n": str(len(record["text"]))}}, reasons
        if record["id"] % 7 == 0:
            raise RuntimeError("no answer")
        return {"words": {"n": str(record["text"].count(" ") + 1)}}, {}

    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", "n_chars")
    return ops.apply_groups(ops.cross_groups(docs, subs), subs, measure)


# ---- plans derived from parts ---------------------------------------------------------------------

TYPE_NAMES = plans.FEATURE_TYPES


def part_types(spark: SparkSession, d: str) -> DataFrame:
    names = F.array(*[F.lit(t) for t in TYPE_NAMES])
    grouped = table(spark, d, "part").groupBy(F.col("p_brand").alias("feature"), F.col("p_type").alias("sub"))
    return grouped.agg((F.min("p_size") % 5).alias("m")).select("feature", "sub", F.get(names, F.col("m")).alias("type"))


def part_values(spark: SparkSession, d: str) -> DataFrame:
    grouped = table(spark, d, "part").filter("p_size > 45").groupBy(F.col("p_brand").alias("feature"), F.col("p_type").alias("sub"))
    return grouped.agg(F.array(F.min("p_name"), F.max("p_name")).alias("possible_values"))


PART_TYPES_SQL = f"""
part_types AS (SELECT p_brand AS feature, p_type AS sub, {TYPE_NAMES}[min(p_size) % 5 + 1] AS type FROM part GROUP BY 1, 2),
part_values AS (SELECT p_brand AS feature, p_type AS sub, min(p_name) || '|' || max(p_name) AS v FROM part WHERE p_size > 45 GROUP BY 1, 2)"""


def part_plan(spark: SparkSession, d: str) -> DataFrame:
    rows = part_types(spark, d).join(part_values(spark, d), ["feature", "sub"], "left")
    return rows.select(
        F.lit(0).alias("group_no"), "feature", "sub", "type", F.concat(F.lit("about "), F.col("feature")).alias("idea"),
        F.array(F.lit("pubmed")).alias("sources"), "possible_values",
        F.array(F.col("sub")).alias("example_values"), F.concat(F.lit("find "), F.col("sub")).alias("instructions"),
    )


@query("f1_check_plan", f"""
    WITH {PART_TYPES_SQL}
    SELECT coalesce(t.feature, x.feature) AS feature, coalesce(t.sub, x.sub) AS sub, type,
      CASE WHEN type IN ('categorical', 'multi-categorical') THEN v END AS allowed,
      CASE WHEN type IS NULL THEN 'values without a type' WHEN type IN ('categorical', 'multi-categorical') AND v IS NULL THEN 'categorical without values' END AS problem
    FROM (SELECT * FROM part_types WHERE type <> 'float') t FULL JOIN part_values x ON t.feature = x.feature AND t.sub = x.sub""")
def f1(spark, d):
    checked = plans.check_plan(part_types(spark, d).filter("type <> 'float'"), part_values(spark, d))
    return checked.select("feature", "sub", "type", F.array_join("possible_values", "|").alias("allowed"), "problem")


@query("f2_apply_op", f"""
    WITH {PART_TYPES_SQL}
    SELECT feature, sub, type, CASE WHEN feature = 'Brand#3' THEN 'about Brand#3' || chr(10) || '---' || chr(10) || 'by name' ELSE 'about ' || feature END AS idea
    FROM part_types WHERE feature <> 'Brand#2'
    UNION ALL SELECT 'Region', r_name, 'boolean', 'where it is made' FROM region""")
def f2(spark, d):
    current = part_plan(spark, d)
    made = table(spark, d, "region").select(
        F.lit(1).alias("group_no"), F.lit("Region").alias("feature"), F.col("r_name").alias("sub"),
        F.lit("boolean").alias("type"), F.lit(None).cast("array<string>").alias("sources"),
        F.lit(None).cast("array<string>").alias("possible_values"), F.lit(None).cast("array<string>").alias("example_values"),
        F.lit("").alias("instructions"),
    )
    refined = current.filter("feature = 'Brand#3'").drop("idea")
    current = plans.apply_op(current, "remove", "Brand#2")
    current = plans.apply_op(current, "refine", "Brand#3", "by name", refined)
    current = plans.apply_op(current, "add", "Region", "where it is made", made)
    return current.select("feature", "sub", "type", "idea")


@query("p17_slim_plan", f"""
    WITH {PART_TYPES_SQL} SELECT 0 AS group_no, feature, sub, type, 'about ' || feature AS idea, 'find ' || sub AS instructions FROM part_types""")
def p17(spark, d):
    return plans.slim_plan(part_plan(spark, d))


@query("s14_plan_hash", f"""
    WITH {PART_TYPES_SQL}, listed AS (SELECT t.feature, '{{"feature":"' || t.feature || '","sub":"' || t.sub || '","type":"' || type || '","possible_values":'
        || CASE WHEN v IS NULL THEN 'null' ELSE '["' || replace(v, '|', '","') || '"]' END || '}}' AS j
      FROM part_types t LEFT JOIN part_values x ON t.feature = x.feature AND t.sub = x.sub)
    SELECT feature, sha256('["' || string_agg(replace(j, '"', '\\"'), '","' ORDER BY j) || '"]') AS plan_hash FROM listed GROUP BY feature""")
def s14_plan(spark, d):
    return plans.plan_hash(part_plan(spark, d), ["feature"])


@query("a12_check_groups", """
    WITH g AS (SELECT DISTINCT p_type, p_brand FROM part WHERE p_brand <> 'Brand#7')
    SELECT count(DISTINCT p_type) AS groups, count(*) AS entries, (SELECT count(DISTINCT p_brand) FROM part) AS features,
      (SELECT count(DISTINCT p_brand) FROM part) - count(DISTINCT p_brand) AS missing, FALSE AS sound FROM g""")
def a12(spark, d):
    parts = table(spark, d, "part")
    groups = parts.filter("p_brand <> 'Brand#7'").select(F.col("p_type").alias("group_no"), F.col("p_brand").alias("feature")).distinct()
    return plans.check_groups(groups, parts.select(F.col("p_brand").alias("feature")))


@query("u5_is_subset", """
    SELECT p_partkey, len(list_filter(string_split(p_name, ' '), lambda x: x NOT IN ('small', 'red', 'ring', 'widget', 'large'))) = 0 AS subset FROM part""")
def u5(spark, d):
    allowed = F.array(*[F.lit(w) for w in ("small", "red", "ring", "widget", "large")])
    return table(spark, d, "part").select("p_partkey", is_subset(F.split("p_name", " "), allowed).alias("subset"))
