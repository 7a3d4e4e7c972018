"""Queries over nested study records derived from orders, and over plain tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.functions import format_day, join_list, min_date, parse_mixed_date, year_text
from tidemark.operators import etl, topk
from tidemark.queries.registry import DOC_DATE_SQL, days_after, doc_date, query, query_date, table


def studies(spark: SparkSession, d: str) -> DataFrame:
    """Each order as one nested study record; references are built inside the row."""
    k = F.col("o_orderkey")
    day = format_day(F.col("o_orderdate"))
    start = (
        F.when(k % 10 == 9, None)
        .when(k % 4 == 1, F.substring(day, 1, 7))
        .when(k % 4 == 2, F.substring(day, 1, 4))
        .otherwise(day)
    )
    done = format_day(F.date_add(F.col("o_orderdate").cast("date"), (k % 50 + 30).cast("int")))
    reference = F.transform(
        F.sequence(F.lit(1).cast("bigint"), k % 4),
        lambda i: F.struct(
            (k * 10 + i).cast("string").alias("pmid"),
            F.when((k + i) % 3 == 0, "BACKGROUND").when((k + i) % 3 == 1, "RESULT").otherwise("DERIVED").alias("type"),
            F.concat(F.lit("Cite "), k.cast("string"), F.lit("-"), i.cast("string")).alias("citation"),
        ),
    )
    protocol = F.struct(
        F.struct(F.concat(F.lit("NCT"), k.cast("string")).alias("nctId")).alias("identificationModule"),
        F.struct(
            F.col("o_orderstatus").alias("overallStatus"),
            F.struct(start.alias("date"), F.when(k % 2 == 0, "ACTUAL").otherwise("ESTIMATED").alias("type")).alias("startDateStruct"),
            F.struct(done.alias("date"), F.lit("ACTUAL").alias("type")).alias("completionDateStruct"),
            F.col("o_orderdate").cast("date").alias("studyFirstSubmitDate"),
        ).alias("statusModule"),
        F.struct(
            F.when(F.col("o_orderstatus") == "O", "OBSERVATIONAL").otherwise("INTERVENTIONAL").alias("studyType"),
            F.when(k % 3 == 1, F.array(F.lit("PHASE1"))).when(k % 3 == 2, F.array(F.lit("PHASE1"), F.lit("PHASE2"))).alias("phases"),
        ).alias("designModule"),
        F.struct(
            F.col("o_orderpriority").alias("briefSummary"),
            F.concat(F.lit("Customer "), F.col("o_custkey").cast("string")).alias("detailedDescription"),
        ).alias("descriptionModule"),
        F.struct(F.when(k % 4 > 0, reference).alias("references")).alias("referencesModule"),
    )
    return table(spark, d, "orders").select(
        k.alias("study_key"), protocol.alias("protocolSection"), (k % 2 == 0).alias("hasResults")
    )


STUDY = """
study AS (
  SELECT o_orderkey AS k, 'NCT' || o_orderkey::VARCHAR AS nct_id, o_orderstatus AS overall_status,
    CASE WHEN o_orderstatus = 'O' THEN 'OBSERVATIONAL' ELSE 'INTERVENTIONAL' END AS study_type,
    CASE WHEN o_orderkey % 10 = 9 THEN NULL
         WHEN o_orderkey % 4 = 1 THEN strftime(o_orderdate, '%Y-%m')
         WHEN o_orderkey % 4 = 2 THEN strftime(o_orderdate, '%Y')
         ELSE strftime(o_orderdate, '%Y-%m-%d') END AS start_text,
    CASE WHEN o_orderkey % 2 = 0 THEN 'ACTUAL' ELSE 'ESTIMATED' END AS start_type,
    CAST(o_orderdate AS DATE) + CAST(o_orderkey % 50 + 30 AS INT) AS completion,
    CAST(o_orderdate AS DATE) AS first_submit,
    CASE WHEN o_orderkey % 3 = 1 THEN 'PHASE1' WHEN o_orderkey % 3 = 2 THEN 'PHASE1-PHASE2' END AS phases,
    o_orderpriority AS brief, 'Customer ' || o_custkey::VARCHAR AS detail, o_orderkey % 2 = 0 AS has_results
  FROM orders),
refs AS (
  SELECT k, i, (k * 10 + i)::VARCHAR AS pmid,
    CASE (k + i) % 3 WHEN 0 THEN 'BACKGROUND' WHEN 1 THEN 'RESULT' ELSE 'DERIVED' END AS ref_type,
    'Cite ' || k::VARCHAR || '-' || i::VARCHAR AS citation
  FROM study, range(1, 4) r(i) WHERE i <= k % 4)
"""

PATHS = {
    "nct_id": "protocolSection.identificationModule.nctId",
    "overall_status": "protocolSection.statusModule.overallStatus",
    "start_struct": "protocolSection.statusModule.startDateStruct",
    "completion_struct": "protocolSection.statusModule.completionDateStruct",
    "study_type": "protocolSection.designModule.studyType",
    "phases": "protocolSection.designModule.phases",
    "brief": "protocolSection.descriptionModule.briefSummary",
    "detail": "protocolSection.descriptionModule.detailedDescription",
    "has_results": "hasResults",
    "references": "protocolSection.referencesModule.references",
}


def projected(spark: SparkSession, d: str) -> DataFrame:
    return etl.project_paths(studies(spark, d), PATHS)


def processed(spark: SparkSession, d: str, mask: bool = True) -> DataFrame:
    """The processed study table: interventional, flattened, dated, background references only."""
    rows = projected(spark, d).filter(F.col("study_type") == "INTERVENTIONAL")
    rows = etl.explode_references(rows, "references", "reference")
    for column, prefix in (("start_struct", "start_"), ("completion_struct", "completion_"), ("reference", "reference_")):
        rows = etl.flatten_struct(rows, column, prefix)
    if mask:
        rows = rows.filter(F.col("reference_type") == "BACKGROUND")
    return rows.select(
        "nct_id", "overall_status", join_list(F.col("phases")).alias("phases"), "brief", "detail", "has_results",
        parse_mixed_date(F.col("start_date")).alias("start_date"), "start_type",
        parse_mixed_date(F.col("completion_date")).alias("completion_date"), "completion_type",
        "reference_citation", "reference_pmid", "reference_type",
    )


@query("p1_project_paths", f"WITH {STUDY} SELECT nct_id, overall_status, study_type, brief, detail, start_text AS start_date FROM study")
def p1(spark, d):
    return etl.project_paths(studies(spark, d), {
        "nct_id": PATHS["nct_id"], "overall_status": PATHS["overall_status"], "study_type": PATHS["study_type"],
        "brief": PATHS["brief"], "detail": PATHS["detail"],
        "start_date": "protocolSection.statusModule.startDateStruct.date",
    })


@query("p2_flatten_struct", f"""
    WITH {STUDY} SELECT nct_id, start_text AS start_date, start_type,
      strftime(completion, '%Y-%m-%d') AS done_date, 'ACTUAL' AS done_type FROM study""")
def p2(spark, d):
    rows = projected(spark, d).select("nct_id", "start_struct", "completion_struct")
    return etl.flatten_struct(etl.flatten_struct(rows, "start_struct", "start_"), "completion_struct", "done_")


@query("p3_nested_equality", f"WITH {STUDY} SELECT nct_id, overall_status FROM study WHERE study_type = 'INTERVENTIONAL'")
def p3(spark, d):
    rows = studies(spark, d).filter(F.col("protocolSection.designModule.studyType") == "INTERVENTIONAL")
    return etl.project_paths(rows, {a: PATHS[a] for a in ("nct_id", "overall_status")})


@query("p4_struct_not_null", "SELECT o_orderkey AS record_id, o_orderpriority AS title FROM orders WHERE o_orderkey % 5 <> 0")
def p4(spark, d):
    k = F.col("o_orderkey")
    citation = F.when(k % 5 != 0, F.struct(k.alias("id"), F.col("o_orderpriority").alias("title")))
    kept = table(spark, d, "orders").select(citation.alias("citation")).filter(F.col("citation").isNotNull())
    return kept.select(F.col("citation.id").alias("record_id"), F.col("citation.title").alias("title"))


@query("p5_background_mask", f"""
    WITH {STUDY} SELECT nct_id, overall_status, phases, brief, detail, has_results,
      CASE length(start_text) WHEN 4 THEN start_text || '-01-01' WHEN 7 THEN start_text || '-01' ELSE start_text END AS start_date,
      start_type, strftime(completion, '%Y-%m-%d') AS completion_date, 'ACTUAL' AS completion_type,
      citation AS reference_citation, pmid AS reference_pmid, ref_type AS reference_type
    FROM study JOIN refs USING (k) WHERE study_type = 'INTERVENTIONAL' AND ref_type = 'BACKGROUND'""")
def p5(spark, d):
    rows = processed(spark, d)
    return rows.withColumns({c: format_day(F.col(c)) for c in ("start_date", "completion_date")})


@query("p6_keep_list", f"WITH {STUDY} SELECT nct_id, phases, brief FROM study")
def p6(spark, d):
    keep = ["nct_id", "phases", "brief"]
    return projected(spark, d).select(*keep).withColumn("phases", join_list(F.col("phases")))


@query("p7_rename", 'SELECT doc_id AS nctid, lang AS "lead_sponsor", source AS location, n_chars AS size FROM documents')
def p7(spark, d):
    rows = table(spark, d, "documents").select(
        "doc_id", F.col("lang").alias("sponsors/lead_sponsor/agency_class"),
        F.col("source").alias("location/facility/address/city"), "n_chars",
    )
    return etl.rename(rows, {
        "doc_id": "nctid", "sponsors/lead_sponsor/agency_class": "lead_sponsor",
        "location/facility/address/city": "location", "n_chars": "size",
    })


@query("p8_literal_tag", "SELECT doc_id, lang, 'Article' AS kind FROM documents")
def p8(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang", F.lit("Article").alias("kind"))


@query("p9_struct_except", f"WITH {STUDY} SELECT nct_id, study_type, brief FROM study")
def p9(spark, d):
    rows = etl.struct_except(studies(spark, d).select("protocolSection"), "protocolSection", ["statusModule"])
    return rows.select(
        F.col("identificationModule.nctId").alias("nct_id"), F.col("designModule.studyType").alias("study_type"),
        F.col("descriptionModule.briefSummary").alias("brief"),
    )


@query("p10_lookup", "SELECT doc_id, lang, source, n_chars, md5(text) AS text_md5 FROM documents WHERE doc_id = 42")
def p10(spark, d):
    row = etl.lookup(table(spark, d, "documents"), "doc_id", 42)
    return row.select("doc_id", "lang", "source", "n_chars", F.md5("text").alias("text_md5"))


@query("p11_as_of", f"""
    SELECT doc_id, strftime({DOC_DATE_SQL}, '%Y-%m-%d') AS doc_date FROM documents WHERE {DOC_DATE_SQL} < DATE '2005-06-01'""")
def p11(spark, d):
    rows = table(spark, d, "documents").select("doc_id", doc_date(F.col("doc_id")).alias("doc_date"))
    early = etl.as_of(rows, "doc_date", F.lit("2005-06-01").cast("date"))
    return early.withColumn("doc_date", format_day(F.col("doc_date")))


@query("p12_exclude_keys", """
    SELECT p_partkey, p_brand, p_name FROM part
    WHERE p_partkey NOT IN (17, 18, 99) AND p_size % 7 <> 0
      AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45)""")
def p12(spark, d):
    sized = table(spark, d, "part").withColumn("dated", F.when(F.col("p_size") % 7 != 0, F.col("p_size")))
    returned = table(spark, d, "lineitem").filter("l_returnflag = 'R' and l_quantity > 45")
    kept = etl.exclude_keys(sized, "p_partkey", [17, 18, 99]).dropna(subset=["dated"])
    kept = etl.exclude_keys(kept, "p_partkey", returned.withColumnRenamed("l_partkey", "p_partkey"))
    return kept.select("p_partkey", "p_brand", "p_name")


@query("p13_recode_outcome", """
    SELECT doc_id, lang, CASE WHEN toxic = 1 THEN 'Success' ELSE 'Failure' END AS outcome
    FROM documents LEFT JOIN labels USING (doc_id)""")
def p13(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    return rows.withColumn("outcome", etl.recode_outcome(F.col("toxic"))).select("doc_id", "lang", "outcome")


@query("p14_split_by_label", """
    SELECT CASE WHEN quality = 1 THEN 'positive' ELSE 'rest' END AS side, count(*) AS n, sum(n_chars)::BIGINT AS chars
    FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1""")
def p14(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    yes, rest = etl.split_by_label(rows, "quality")
    both = yes.withColumn("side", F.lit("positive")).unionByName(rest.withColumn("side", F.lit("rest")))
    return both.groupBy("side").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


@query("p15_distinct_keys", "SELECT DISTINCT l_partkey AS pmid FROM lineitem WHERE l_returnflag <> 'N' AND l_partkey IS NOT NULL")
def p15(spark, d):
    rows = table(spark, d, "lineitem").select(F.when(F.col("l_returnflag") != "N", F.col("l_partkey")).alias("pmid"))
    return etl.distinct_keys(rows, "pmid")


# ---- joins ----------------------------------------------------------------------------------------

@query("j1_explode_references", f"""
    WITH {STUDY} SELECT nct_id, pmid, ref_type FROM study s LEFT JOIN refs r ON r.k = s.k WHERE study_type = 'INTERVENTIONAL'""")
def j1(spark, d):
    rows = projected(spark, d).filter(F.col("study_type") == "INTERVENTIONAL").select("nct_id", "references")
    out = etl.explode_references(rows, "references", "r")
    return out.select("nct_id", F.col("r.pmid").alias("pmid"), F.col("r.type").alias("ref_type"))


@query("j1_left_join", """
    SELECT o_orderkey, o_orderstatus, l_linenumber, l_partkey
    FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'O'""")
def j1_left_join(spark, d):
    parents = table(spark, d, "orders").filter("o_orderstatus <> 'O'").select("o_orderkey", "o_orderstatus")
    children = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey")
    return etl.left_join_children(parents, children, ["o_orderkey"])


@query("j2_left_join_dim", f"""
    WITH {STUDY}, dim AS (
      SELECT DISTINCT k, CAST(CASE length(start_text) WHEN 4 THEN start_text || '-01-01' WHEN 7 THEN start_text || '-01' ELSE start_text END AS DATE) AS start_date, brief
      FROM study JOIN refs USING (k) WHERE study_type = 'INTERVENTIONAL' AND ref_type = 'BACKGROUND')
    SELECT l_orderkey, l_linenumber, l_partkey, strftime(start_date, '%Y-%m-%d') AS start_date,
      CAST(year(start_date) AS VARCHAR) AS start_year, brief
    FROM lineitem LEFT JOIN dim ON k = l_orderkey""")
def j2(spark, d):
    facts = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    facts = facts.withColumn("nct_id", F.concat(F.lit("NCT"), F.col("l_orderkey").cast("string")))
    dim = processed(spark, d).select("nct_id", "start_date", "brief")
    return etl.left_join_dim(facts, dim, ["nct_id"]).select(
        "l_orderkey", "l_linenumber", "l_partkey", format_day(F.col("start_date")).alias("start_date"),
        year_text(F.col("start_date")).alias("start_year"), "brief",
    )


@query("j3_join_xy", """
    SELECT doc_id, doc_id % 4 + 1 AS phase, CASE WHEN doc_id % 10 < 6 THEN 'train' ELSE 'test' END AS split, lang, quality AS outcome
    FROM documents JOIN labels USING (doc_id)""")
def j3(spark, d):
    keys = {
        "phase": F.col("doc_id") % 4 + 1,
        "split": F.when(F.col("doc_id") % 10 < 6, "train").otherwise("test"),
    }
    x = table(spark, d, "documents").select("doc_id", "lang").withColumns(keys)
    y = table(spark, d, "labels").select("doc_id", F.col("quality").alias("outcome")).withColumns(keys)
    return etl.join_xy(x, y, ["doc_id", "phase", "split"])


@query("j6_missing_keys", """
    SELECT DISTINCT l_partkey AS pmid FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 25)""")
def j6(spark, d):
    ids = table(spark, d, "lineitem").select(F.col("l_partkey").alias("pmid"))
    article = F.when(F.col("p_partkey") % 2 == 0, F.struct(F.col("p_partkey").alias("PMID")))
    book = F.when(F.col("p_partkey") % 2 != 0, F.struct(F.col("p_partkey").alias("PMID")))
    store = table(spark, d, "part").filter("p_size < 25").select(article.alias("MedlineCitation"), book.alias("BookDocument"))
    held = store.select(F.coalesce("MedlineCitation.PMID", "BookDocument.PMID").alias("pmid"))
    return etl.missing_keys(ids, held, "pmid")


@query("j6_of_this_pull", """
    SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000)""")
def j6_of_this_pull(spark, d):
    pulled = table(spark, d, "supplier").filter("s_acctbal > 5000").select(F.col("s_suppkey").alias("l_suppkey"))
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    return etl.of_this_pull(rows, pulled, "l_suppkey").select("l_orderkey", "l_linenumber", "l_suppkey")


# ---- distinct, counts, unions ---------------------------------------------------------------------

@query("a1_distinct_rows", """
    SELECT a AS order_key, b AS line_no, flags FROM (
      SELECT DISTINCT l_orderkey AS a, l_linenumber AS b, l_returnflag || l_linestatus AS flags FROM lineitem)""")
def a1(spark, d):
    nested = table(spark, d, "lineitem").select(
        F.struct(F.col("l_orderkey").alias("a"), F.struct(F.col("l_linenumber").alias("b")).alias("s")).alias("key"),
        F.array("l_returnflag", "l_linestatus").alias("flags"),
    )
    return etl.distinct_rows(nested).select(
        F.col("key.a").alias("order_key"), F.col("key.s.b").alias("line_no"), F.array_join("flags", "").alias("flags")
    )


@query("a2_distinct_columns", "SELECT DISTINCT lang, source FROM documents")
def a2(spark, d):
    return table(spark, d, "documents").select("lang", "source").distinct()


@query("a3_row_count", "SELECT count(*) AS n FROM lineitem")
def a3(spark, d):
    return table(spark, d, "lineitem").agg(F.count(F.lit(1)).alias("n"))


@query("a14_min_date", """
    SELECT o_orderkey, strftime(least(
      CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END,
      CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) + CAST(o_orderkey % 40 - 20 AS INT) END,
      CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) + 3 END,
      CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) - 2 END), '%Y-%m-%d') AS available
    FROM orders""")
def a14(spark, d):
    k, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    dates = F.when(k % 5 != 0, F.array(F.date_add(day, (k % 40 - 20).cast("int")), F.date_add(day, 3)))
    first = min_date([F.when(k % 3 != 0, day), F.when(k % 7 != 0, F.date_sub(day, 2))], [dates])
    return table(spark, d, "orders").select("o_orderkey", format_day(first).alias("available"))


@query("u1_union_all", """
    SELECT CAST(doc_id % 4 + 1 AS VARCHAR) AS phase, CASE WHEN doc_id % 10 < 6 THEN 'train' ELSE 'test' END AS split,
      count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY 1, 2""")
def u1(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "n_chars")
    parts = [
        docs.filter((F.col("doc_id") % 4 == phase - 1) & ((F.col("doc_id") % 10 < 6) == (split == "train")))
        .withColumns({"phase": F.lit(str(phase)), "split": F.lit(split)})
        for phase in range(1, 5) for split in ("train", "test")
    ]
    return etl.union_all(parts).groupBy("phase", "split").agg(
        F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars")
    )


@query("u2_union_kinds", """
    SELECT doc_id AS pmid, lang, NULL::VARCHAR AS url, 'article' AS kind FROM documents
    UNION ALL SELECT page_id, NULL, url, 'book' FROM pages""")
def u2(spark, d):
    articles = table(spark, d, "documents").select(F.col("doc_id").alias("pmid"), "lang", F.lit("article").alias("kind"))
    books = table(spark, d, "pages").select(F.col("page_id").alias("pmid"), "url", F.lit("book").alias("kind"))
    return etl.union_kinds(articles, books)


@query("u3_upsert", "SELECT DISTINCT l_orderkey, l_linenumber, l_returnflag FROM lineitem")
def u3(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    old, new = rows.filter("l_orderkey % 3 <> 0"), rows.filter("l_orderkey % 3 <> 1")
    return etl.upsert(old, new)


@query("u4_set_difference", """
    SELECT p_partkey AS feature FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A' AND l_quantity > 45""")
def u4(spark, d):
    used = table(spark, d, "lineitem").filter("l_returnflag = 'A' and l_quantity > 45").select(F.col("l_partkey").alias("feature"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("feature")).subtract(used)


# ---- top-k ----------------------------------------------------------------------------------------

TOP_SUPPLIER = """
    SELECT * FROM (
      SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, l_extendedprice, CAST(row_number() OVER (PARTITION BY l_suppkey
        ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) AS INT) AS rank FROM lineitem) WHERE rank <= 10"""
PRICE_ORDER = [F.desc, F.asc, F.asc, F.asc]


def price_order():
    return [f(c) for f, c in zip(PRICE_ORDER, ["l_extendedprice", "l_orderkey", "l_linenumber", "l_partkey"])]


@query("w1_top_k_per_key", TOP_SUPPLIER)
def w1(spark, d):
    rows = table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return topk.top_k_per_key(rows, ["l_suppkey"], price_order(), 10)


@query("l1_top_k", """
    SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem
    ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey LIMIT 10""")
def l1(spark, d):
    rows = table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return topk.top_k(rows, price_order(), 10)


@query("l6_first_items", """
    SELECT p_partkey, array_to_string(string_split(p_name || ' ' || p_brand || ' ' || p_type || ' a b c', ' ')[1:5], ',') AS authors FROM part""")
def l6(spark, d):
    from tidemark.functions import first_items

    words = F.split(F.concat_ws(" ", "p_name", "p_brand", "p_type", F.lit("a b c")), " ")
    return table(spark, d, "part").select("p_partkey", F.array_join(first_items(words, 5), ",").alias("authors"))


@query("l7_value_counts", "SELECT l_returnflag || l_linestatus AS flag, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, flag")
def l7(spark, d):
    flags = table(spark, d, "lineitem").groupBy(F.concat("l_returnflag", "l_linestatus").alias("flag"))
    return flags.agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "flag")
