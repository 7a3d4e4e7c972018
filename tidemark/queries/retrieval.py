"""Retrieval queries: benchmark passages searched in dated documents."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.functions import format_day
from tidemark.operators import dense, hybrid, index_store, keyword, quantised
from tidemark.operators.chunking import DEFAULT_MAX_CHARS, chunk
from tidemark.queries.registry import DOC_DATE_SQL, QUERY_DATE_SQL, doc_date, query, query_date, table
from tidemark.session import materialize, scratch_path
from tidemark.sources.readers import spread

DIM = dense.DEFAULT_DIM


def corpus(spark: SparkSession, d: str) -> DataFrame:
    docs = spread(table(spark, d, "documents"))
    return docs.select(F.col("doc_id").alias("id"), doc_date(F.col("doc_id")).alias("doc_date"), "text")


def passages(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "benchmark")
    return items.select(F.col("item_id").alias("query_id"), query_date(F.col("item_id")).alias("as_of"), "text")


# ---- oracle fragments -----------------------------------------------------------------------------

def _split(level: str, before: str, pattern: str, n: int) -> str:
    return f"""
{level} AS (SELECT id, doc_date, flatten(list_transform(p, lambda x: CASE WHEN length(x) <= {n} THEN [x]
    ELSE regexp_extract_all(x, '{pattern}') END)) AS p FROM {before})"""


def chunk_sql(n: int = DEFAULT_MAX_CHARS) -> str:
    return f"""
whole AS (SELECT doc_id AS id, {DOC_DATE_SQL} AS doc_date, [text] AS p FROM documents WHERE text <> ''),
{_split("blanks", "whole", r"(?s).+?(?:\n\n+|\z)", n)},
{_split("lines", "blanks", r"[^\n]*\n+|[^\n]+", n)},
{_split("sentences", "lines", r"(?s).+?(?:[.!?] |\z)", n)},
{_split("words", "sentences", r"[^ ]* +|[^ ]+", n)},
cuts AS (SELECT id, doc_date, flatten(list_transform(p, lambda x: CASE WHEN length(x) <= {n} THEN [x]
    ELSE list_transform(range(0, CAST(ceil(length(x) / {n}) AS BIGINT)), lambda i: substr(x, CAST(i * {n} + 1 AS BIGINT), {n})) END)) AS p FROM words),
pieces AS (SELECT id, doc_date, unnest(p) AS piece, generate_subscripts(p, 1) AS i FROM cuts),
fold(id, i, chunk_no, size) AS (
  SELECT id, i, 0, length(piece) FROM pieces WHERE i = 1
  UNION ALL
  SELECT f.id, p.i, CASE WHEN f.size + length(p.piece) <= {n} THEN f.chunk_no ELSE f.chunk_no + 1 END,
    CASE WHEN f.size + length(p.piece) <= {n} THEN f.size + length(p.piece) ELSE length(p.piece) END
  FROM fold f JOIN pieces p ON p.id = f.id AND p.i = f.i + 1),
chunks AS (SELECT id, doc_date, chunk_no, string_agg(piece, '' ORDER BY i) AS chunk FROM pieces JOIN fold USING (id, i) GROUP BY 1, 2, 3)"""


QUERIES_SQL = f"q AS (SELECT item_id AS query_id, {QUERY_DATE_SQL} AS as_of, text FROM benchmark)"


def top_sql(source: str, k: int) -> str:
    return f"""(SELECT query_id, id, chunk_no, score, rank FROM (
      SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id, chunk_no) AS INT) AS rank FROM {source}) WHERE rank <= {k})"""


KEYWORD_SQL = r"""
tokens AS (SELECT id, doc_date, chunk_no, regexp_extract_all(lower(chunk), '\p{L}+') AS toks FROM chunks),
corpus_stats AS (SELECT count(*) AS n, avg(len(toks)) AS mean_len FROM tokens),
postings AS (SELECT id, chunk_no, doc_date, doc_len, term, count(*) AS tf FROM (
    SELECT id, chunk_no, doc_date, len(toks) AS doc_len, unnest(toks) AS term FROM tokens) GROUP BY ALL),
query_terms AS (SELECT query_id, as_of, unnest(list_distinct(regexp_extract_all(lower(text), '\p{L}+'))) AS term FROM q),
frequency AS (SELECT term, count(*) AS df FROM postings GROUP BY term),
keyword_scores AS (SELECT query_id, id, chunk_no,
    round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * doc_len / mean_len))), 6) AS score
  FROM query_terms JOIN frequency USING (term) JOIN postings USING (term), corpus_stats
  WHERE doc_date < as_of GROUP BY ALL)"""

DENSE_SQL = rf"""
chunk_buckets AS (SELECT id, chunk_no, doc_date, bucket, count(*) AS tf FROM (
    SELECT id, chunk_no, doc_date, ('0x' || substr(md5(term), 1, 8))::BIGINT % {DIM} AS bucket FROM (
      SELECT id, chunk_no, doc_date, unnest(regexp_extract_all(lower(chunk), '\p{{L}}+')) AS term FROM chunks)) GROUP BY ALL),
bucket_idf AS (SELECT bucket, ln(((SELECT count(*) FROM chunks) + 1) / (count(*) + 1)) AS idf FROM chunk_buckets GROUP BY bucket),
chunk_weights AS (SELECT id, chunk_no, doc_date, bucket, tf * idf AS w FROM chunk_buckets JOIN bucket_idf USING (bucket) WHERE tf * idf <> 0),
chunk_unit AS (SELECT id, chunk_no, doc_date, bucket, w / sqrt(sum(w * w) OVER (PARTITION BY id, chunk_no)) AS w FROM chunk_weights),
query_buckets AS (SELECT query_id, as_of, bucket, count(*) AS tf FROM (
    SELECT query_id, as_of, ('0x' || substr(md5(term), 1, 8))::BIGINT % {DIM} AS bucket FROM (
      SELECT query_id, as_of, unnest(regexp_extract_all(lower(text), '\p{{L}}+')) AS term FROM q)) GROUP BY ALL),
query_weights AS (SELECT query_id, as_of, bucket, tf * idf AS w FROM query_buckets JOIN bucket_idf USING (bucket) WHERE tf * idf <> 0),
query_unit AS (SELECT query_id, as_of, bucket, w / sqrt(sum(w * w) OVER (PARTITION BY query_id)) AS w FROM query_weights),
dense_scores AS (SELECT query_id, id, chunk_no, round(sum(dot), 6) AS score FROM (
    SELECT query_id, id, chunk_no, a.w * b.w AS dot FROM query_unit a JOIN chunk_unit b USING (bucket) WHERE doc_date < as_of
    UNION ALL
    SELECT x.query_id, y.id, y.chunk_no, 0.0 FROM q x, chunks y WHERE y.doc_date < x.as_of) GROUP BY ALL)"""

HYBRID_SQL = f"""
dense_scaled AS (SELECT query_id, id, chunk_no, CASE WHEN max(score) OVER p = min(score) OVER p THEN 1.0
    ELSE (score - min(score) OVER p) / (max(score) OVER p - min(score) OVER p) END AS s FROM dense_scores WINDOW p AS (PARTITION BY query_id)),
keyword_scaled AS (SELECT query_id, id, chunk_no, CASE WHEN max(score) OVER p = min(score) OVER p THEN 1.0
    ELSE (score - min(score) OVER p) / (max(score) OVER p - min(score) OVER p) END AS s FROM keyword_scores WINDOW p AS (PARTITION BY query_id)),
hybrid_scores AS (SELECT query_id, id, chunk_no, round(0.5 * coalesce(a.s, 0) + 0.5 * coalesce(b.s, 0), 6) AS score
  FROM dense_scaled a FULL JOIN keyword_scaled b USING (query_id, id, chunk_no)),
hits AS {top_sql("hybrid_scores", 10)}"""

FULL_SQL = f"WITH RECURSIVE {chunk_sql()}, {QUERIES_SQL}, {KEYWORD_SQL}, {DENSE_SQL}, {HYBRID_SQL}"


# ---- queries --------------------------------------------------------------------------------------

@query("r1_chunk", f"WITH RECURSIVE {chunk_sql()} SELECT id, chunk_no, length(chunk) AS size, md5(chunk) AS chunk_md5 FROM chunks")
def r1(spark, d):
    rows = chunk(corpus(spark, d), "text")
    return rows.select("id", "chunk_no", F.length("chunk").cast("bigint").alias("size"), F.md5("chunk").alias("chunk_md5"))


@query("r1_chunk_small", f"WITH RECURSIVE {chunk_sql(40)} SELECT id, chunk_no, length(chunk) AS size, md5(chunk) AS chunk_md5 FROM chunks")
def r1_small(spark, d):
    rows = chunk(corpus(spark, d), "text", 40)
    return rows.select("id", "chunk_no", F.length("chunk").cast("bigint").alias("size"), F.md5("chunk").alias("chunk_md5"))


@query("r2_encode", f"""
    WITH RECURSIVE {chunk_sql()}, {QUERIES_SQL}, {DENSE_SQL}
    SELECT id, chunk_no, bucket, round(w, 6) AS weight FROM chunk_unit""")
def r2(spark, d):
    chunks = keyword.with_tokens(chunk(corpus(spark, d), "text"))
    hashed = materialize(
        chunks.select("id", "chunk_no", dense.token_buckets(F.col("tokens"), DIM).alias("buckets")), "buckets")
    vectors = dense.hashed_tfidf(hashed, "buckets", dense.bucket_idf(hashed, "buckets", DIM))
    cells = vectors.select("id", "chunk_no", F.posexplode("vec").alias("bucket", "w")).filter("w <> 0")
    return cells.select("id", "chunk_no", F.col("bucket").cast("bigint").alias("bucket"), F.round("w", 6).alias("weight"))


@query("r2_encode_batches", """
    SELECT doc_id, round(length(text)::DOUBLE, 3) AS chars, round((len(string_split(text, ' ')) - 1)::DOUBLE, 3) AS spaces FROM documents""")
def r2_batches(spark, d):
    def encoder(texts: list[str]) -> np.ndarray:
        return np.array([[len(t), t.count(" ")] for t in texts], dtype=np.float32)

    rows = dense.encode(table(spark, d, "documents").select("doc_id", "text"), "text", encoder)
    return rows.select(
        "doc_id", F.round(F.get("vec", F.lit(0)).cast("double"), 3).alias("chars"),
        F.round(F.get("vec", F.lit(1)).cast("double"), 3).alias("spaces"),
    )


def vector_table(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(
        F.col("vec_id").alias("id"), F.lit(0).alias("chunk_no"), doc_date(F.col("vec_id")).alias("doc_date"),
        F.col("embedding").alias("vec"),
    )


def label_means(spark: SparkSession, d: str) -> DataFrame:
    """One query vector per label: the mean of its embeddings."""
    cells = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("pos", "x"))
    means = cells.groupBy("label", "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    # A label collects as many entries as the vectors have dimensions.
    listed = F.array_sort(F.collect_list(F.struct("pos", "x")))
    vectors = means.groupBy("label").agg(F.transform(listed, lambda c: c["x"]).alias("qvec"))
    return vectors.select(F.col("label").alias("query_id"), F.lit("2007-01-01").cast("date").alias("as_of"), "qvec")


VECTOR_SQL = f"""
    WITH means AS (SELECT label, pos, avg(x::DOUBLE) AS x FROM (
        SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY 1, 2),
      qv AS (SELECT label AS query_id, list(x ORDER BY pos) AS qvec FROM means GROUP BY 1),
      scored AS (SELECT query_id, vec_id AS id, 0 AS chunk_no, round(list_cosine_similarity(qvec, embedding::DOUBLE[]), 6) AS score
        FROM qv, embeddings WHERE {DOC_DATE_SQL.replace('doc_id', 'vec_id')} < DATE '2007-01-01')
    SELECT query_id, id, chunk_no, score, rank FROM {top_sql('scored', 10)}"""


@query("r3_search_dense", VECTOR_SQL)
def r3(spark, d):
    return dense.search_dense(label_means(spark, d), vector_table(spark, d), 10)


@query("r4_search_ann", f"""
    SELECT query_id, true AS fewer_compared, true AS recalls_half FROM ({VECTOR_SQL}) GROUP BY query_id""")
def r4(spark, d):
    """Fewer comparisons than the exact search makes, and at least half of its hits."""
    vectors, asked = vector_table(spark, d), label_means(spark, d)
    found = dense.search_ann(asked, dense.build_cells(vectors, cells=16), 10, nprobe=8)
    exact = dense.search_dense(asked, vectors, 10)
    hits = exact.join(found.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    recall = hits.groupBy("query_id").agg((F.count("hit") / F.count(F.lit(1))).alias("recall"))
    return found.select("query_id", "compared").distinct().join(recall, "query_id").select(
        "query_id", (F.col("compared") < vectors.filter("doc_date < '2007-01-01'").count()).alias("fewer_compared"),
        (F.col("recall") >= 0.5).alias("recalls_half"))


def row_queries(spark: SparkSession, d: str) -> DataFrame:
    """Every twentieth vector as a query over all vectors, whatever their date."""
    return vector_table(spark, d).filter("id % 20 = 0").select(
        F.col("id").alias("query_id"), F.lit(None).cast("date").alias("as_of"), F.col("vec").alias("qvec"))


def ann_row_hits(spark: SparkSession, d: str) -> DataFrame:
    """Approximate hits of ``row_queries``: 12 of 16 cells, for a recall of 0.9 or more."""
    return dense.search_ann(row_queries(spark, d), dense.build_cells(vector_table(spark, d), cells=16), 10, nprobe=12)


@query("r4_search_ann_rows", """
    SELECT vec_id AS query_id, 10::BIGINT AS hits, true AS fewer_compared, true AS recalls FROM embeddings
    WHERE vec_id % 20 = 0""")
def r4_rows(spark, d):
    """Hits of each query, and whether 0.9 of all exact hits are among them."""
    vectors = vector_table(spark, d)
    found = materialize(ann_row_hits(spark, d), "hits")
    exact = dense.search_dense(row_queries(spark, d), vectors, 10)
    hits = exact.join(found.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    recall = hits.agg((F.count("hit") / F.count(F.lit(1)) >= 0.9).alias("recalls"))
    return found.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("hits"), (F.max("compared") < vectors.count()).alias("fewer_compared")).crossJoin(recall)


@query("r4_search_quantised", """
    SELECT vec_id AS query_id, 10::BIGINT AS hits, true AS few_compared, true AS recalls FROM embeddings
    WHERE vec_id % 20 = 0""")
def r4_quantised(spark, d):
    """Hits of every twentieth vector over all: under a tenth compared exactly, and 0.9 of all exact hits found."""
    vectors, asked = vector_table(spark, d), row_queries(spark, d)
    found = materialize(quantised.search_quantised(asked, quantised.build_quantised(vectors), 10), "hits")
    exact = dense.search_dense(asked, vectors, 10)
    hits = exact.join(found.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    recall = hits.agg((F.count("hit") / F.count(F.lit(1)) >= 0.9).alias("recalls"))
    return found.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("hits"), (10 * F.max("compared") < vectors.count()).alias("few_compared")).crossJoin(recall)


@query("r4_search_ann_all_cells", VECTOR_SQL)
def r4_all(spark, d):
    index = dense.build_cells(vector_table(spark, d), cells=8)
    return dense.search_ann(label_means(spark, d), index, 10, nprobe=8).drop("compared")


def token_rows(spark: SparkSession, d: str) -> DataFrame:
    return materialize(keyword.token_table(chunk(corpus(spark, d), "text")), "tokens")


@query("r5_build_postings", f"""
    WITH RECURSIVE {chunk_sql()}, {QUERIES_SQL}, {KEYWORD_SQL}
    SELECT term, count(*) AS df, sum(tf)::BIGINT AS tf FROM postings GROUP BY term""")
def r5_postings(spark, d):
    postings = keyword.build_postings(keyword.token_table(chunk(corpus(spark, d), "text")))
    return postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("tf"))


@query("r5_search_keyword", f"""
    WITH RECURSIVE {chunk_sql()}, {QUERIES_SQL}, {KEYWORD_SQL} SELECT * FROM {top_sql("keyword_scores", 10)}""")
def r5(spark, d):
    return keyword.search_keyword(passages(spark, d), token_rows(spark, d), 10)


@query("r5_search_postings", f"""
    WITH RECURSIVE {chunk_sql()}, {QUERIES_SQL}, {KEYWORD_SQL} SELECT * FROM {top_sql("keyword_scores", 10)}""")
def r5_search_postings(spark, d):
    tokens = token_rows(spark, d)
    postings = materialize(keyword.build_postings(tokens), "postings")
    return keyword.search_postings(passages(spark, d), keyword.KeywordIndex(tokens, postings), 10)


@query("r5_search_stored", f"""
    WITH RECURSIVE {chunk_sql()}, {QUERIES_SQL}, {KEYWORD_SQL} SELECT * FROM {top_sql("keyword_scores", 10)}""")
def r5_search_stored(spark, d):
    """From a stored index of two segments, read back by its path."""
    path, docs = scratch_path(spark, "index"), corpus(spark, d)
    for part in range(2):
        index_store.append(docs.filter(F.col("id") % 2 == part), path)
    return index_store.search_stored(passages(spark, d), index_store.load(spark, path), 10)


@query("r6_search_hybrid", f"{FULL_SQL} SELECT query_id, id, chunk_no, score, rank FROM hits")
def r6(spark, d):
    index = hybrid.build_index(corpus(spark, d), dim=DIM)
    return hybrid.search_hybrid(passages(spark, d), index)


@query("r6_search_stored", f"{FULL_SQL} SELECT query_id, id, chunk_no, score, rank FROM hits")
def r6_stored(spark, d):
    path = scratch_path(spark, "index")
    index_store.append(corpus(spark, d), path, dim=DIM)
    return hybrid.search_hybrid(passages(spark, d), index_store.load(spark, path).search_index())


@query("r7_search_articles", f"""
    {FULL_SQL} SELECT query_id, rank, id, h.chunk_no, score, md5(chunk) AS chunk_md5,
      strftime(c.doc_date, '%Y-%m-%d') AS date_avail, lang, array_to_string(string_split(source || '-a-b-c-d-e', '-')[1:5], ',') AS authors
    FROM hits h JOIN chunks c USING (id, chunk_no) JOIN documents ON doc_id = id""")
def r7(spark, d):
    index = hybrid.build_index(corpus(spark, d), dim=DIM)
    articles = table(spark, d, "documents").select(
        F.col("doc_id").alias("id"), format_day(doc_date(F.col("doc_id"))).alias("date_avail"), "lang",
        F.split(F.concat(F.col("source"), F.lit("-a-b-c-d-e")), "-").alias("authors"),
        F.col("text").alias("reference_list"),
    )
    hits = hybrid.search_articles(passages(spark, d), index, articles, heavy=["reference_list"], authors="authors")
    return hits.select(
        "query_id", "rank", "id", "chunk_no", "score", F.md5("chunk").alias("chunk_md5"), "date_avail", "lang",
        F.array_join("authors", ",").alias("authors"),
    )


@query("r8_search_trials", f"""
    {FULL_SQL} SELECT query_id, rank, id, chunk_no, score, lang,
      CASE WHEN toxic = 1 THEN 'Success' ELSE 'Failure' END AS outcome
    FROM hits JOIN documents ON doc_id = id LEFT JOIN labels USING (doc_id)""")
def r8(spark, d):
    index = hybrid.build_index(corpus(spark, d), dim=DIM)
    trials = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left").select(
        F.col("doc_id").alias("id"), "lang", F.col("toxic").alias("outcome"), F.col("text").alias("detailed_description"),
    )
    hits = hybrid.search_trials(passages(spark, d), index, trials, heavy=["detailed_description", "chunk"])
    return hits


@query("r9_search_cached", f"""
    WITH RECURSIVE {chunk_sql()}, {QUERIES_SQL}, {KEYWORD_SQL}, found AS {top_sql("keyword_scores", 10)}
    SELECT query_id, id, chunk_no, score, rank FROM found
    UNION ALL SELECT query_id + 100000000, id, chunk_no, score, rank FROM found""")
def r9(spark, d):
    index = token_rows(spark, d)
    asked = passages(spark, d)
    repeated = asked.unionByName(asked.withColumn("query_id", F.col("query_id") + 100000000))
    store = scratch_path(spark, "searches")

    def search(todo: DataFrame) -> DataFrame:
        return keyword.search_keyword(todo, index, 10)

    def search_few(todo: DataFrame) -> DataFrame:
        return keyword.search_keyword(todo, index, 3)

    hybrid.search_cached(asked, store, "docs-v1", search_few, settings="k=3")
    hybrid.search_cached(asked.filter("query_id % 2 = 0"), store, "docs-v1", search, settings="k=10")
    return hybrid.search_cached(repeated, store, "docs-v1", search, settings="k=10")


@query("r9_search_versions", f"""
    WITH RECURSIVE {chunk_sql()}, {QUERIES_SQL}, {KEYWORD_SQL} SELECT * FROM {top_sql("keyword_scores", 10)}""")
def r9_versions(spark, d):
    """Answers of an earlier version of the index are not those of the grown one."""
    path, store, docs, asked = scratch_path(spark, "index"), scratch_path(spark, "searches"), corpus(spark, d), passages(spark, d)

    def cached() -> DataFrame:
        index = index_store.load(spark, path)
        return hybrid.search_cached(asked, store, "docs", lambda todo: index_store.search_stored(todo, index, 10),
                                    settings=f"k=10;version={index.version}")

    index_store.append(docs.filter("id % 3 = 0"), path)
    cached()
    index_store.append(docs.filter("id % 3 <> 0"), path)
    return cached()


@query("j7_as_of_hits", f"""
    WITH RECURSIVE {chunk_sql()}, {QUERIES_SQL}, {KEYWORD_SQL}
    SELECT query_id, rank, id, chunk_no, score, md5(chunk) AS chunk_md5, doc_date FROM {top_sql("keyword_scores", 10)}
    JOIN chunks USING (id, chunk_no)""")
def j7_hits(spark, d):
    path = scratch_path(spark, "index")
    index_store.append(corpus(spark, d), path)
    index = index_store.load(spark, path)
    hits = index_store.search_stored(passages(spark, d), index, 10)
    return hits.join(index.chunks.select("id", "chunk_no", "doc_date", F.md5("chunk").alias("chunk_md5")), ["id", "chunk_no"])


@query("j7_as_of_top_k", f"""
    WITH RECURSIVE {chunk_sql()}, {QUERIES_SQL}, {KEYWORD_SQL}
    SELECT query_id, count(*) AS hits, max(doc_date) < min(as_of) AS all_before FROM {top_sql("keyword_scores", 10)} h
    JOIN chunks USING (id, chunk_no) JOIN q USING (query_id) GROUP BY query_id""")
def j7(spark, d):
    hits = keyword.search_keyword(passages(spark, d), token_rows(spark, d), 10)
    dated = hits.withColumn("doc_date", doc_date(F.col("id"))).withColumn("as_of", query_date(F.col("query_id")))
    return dated.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("hits"), (F.max("doc_date") < F.min("as_of")).alias("all_before")
    )


@query("j10_attach_parent", f"""
    WITH RECURSIVE {chunk_sql()}, {QUERIES_SQL}, {KEYWORD_SQL}
    SELECT query_id, rank, id, chunk_no, score, lang, source, n_chars FROM {top_sql("keyword_scores", 10)} h JOIN documents ON doc_id = id""")
def j10(spark, d):
    hits = keyword.search_keyword(passages(spark, d), token_rows(spark, d), 10)
    parent = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "lang", "source", "n_chars")
    return hybrid.attach_parent(hits, parent)


@query("l2_search_limit", f"""
    WITH RECURSIVE {chunk_sql()}, {QUERIES_SQL}, {KEYWORD_SQL}
    SELECT query_id, count(*) AS n, max(rank)::INT AS last_rank FROM {top_sql("keyword_scores", 3)} GROUP BY query_id""")
def l2(spark, d):
    hits = keyword.search_keyword(passages(spark, d), token_rows(spark, d), 3)
    return hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.max("rank").alias("last_rank"))


@query("l2_search_limit_hits", f"""
    WITH RECURSIVE {chunk_sql()}, {QUERIES_SQL}, {KEYWORD_SQL} SELECT * FROM {top_sql("keyword_scores", 3)}""")
def l2_hits(spark, d):
    return keyword.search_keyword(passages(spark, d), token_rows(spark, d), 3)
