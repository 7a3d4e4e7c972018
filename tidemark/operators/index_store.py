"""A stored search index: immutable segments, a log of versions, and postings in blocks with upper bounds.

A segment holds its chunks in date order, cut to ranges of consecutive ones, and for every term of a range one block:
its postings there, how many they are, the greatest count of the term, the shortest chunk and the earliest day. From
these follows the greatest score that the term can give in the range, whatever the statistics of the whole
index are by then. A search adds these bounds per query and range, scores the few most promising ranges, and then
reads only the ranges whose bound reaches the k-th score found so far, which cannot change the result. Ranges that
begin on or after a query's date are never read.

Blocks are stored by hash of their term and sorted by term and range, so a scan for some terms reads some folders
and skips the row groups without them. The log is a table to which each commit adds one file; a segment that is not in
the log does not exist, so a writer that is killed leaves nothing behind. One writer at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.operators.blocks import SCORE_CELLS, SCORE_DECIMALS, latest_day, only_among
from tidemark.operators.chunking import DEFAULT_MAX_CHARS, chunk
from tidemark.operators.dense import DEFAULT_DIM, hashed_tfidf, token_buckets
from tidemark.operators.hybrid import HITS, SearchIndex
from tidemark.operators.keyword import (
    BM25_B, BM25_K1, MAX_BLOCK_TERMS, bm25_idf, bm25_weight, query_terms, token_table, with_tokens,
)
from tidemark.operators.topk import top_k_per_key
from tidemark.session import materialize, release

RANGE_BITS = 12  # 4,096 chunks a range
TERM_BUCKETS = 64
FIRST_RANGES = 2
TASK_TOKENS = 1 << 20  # of the chunks whose blocks a task sorts and writes

LOG = ("version int, action string, segment string, n_chunks long, total_len long, bucket_rows array<long>, "
       "max_chars int, dim int, range_bits int")
PLACE = ["segment", "range"]
ENTRY = ["id", "chunk_no", "day", "doc_len", "tf"]


class StoredIndex(NamedTuple):
    """One version: ``chunks`` (segment, range, id, chunk_no, doc_date, chunk, tokens, buckets) and ``blocks``
    (segment, term_bucket, range, term, df, max_tf, min_len, min_day, entries), with the statistics of all its segments."""

    path: str
    version: int
    segments: list[str]
    n_chunks: int
    mean_len: float
    bucket_rows: np.ndarray
    settings: dict
    chunks: DataFrame
    blocks: DataFrame

    def search_index(self) -> SearchIndex:
        """The index as hybrid search takes it, from the stored tables."""
        dim = len(self.bucket_rows)
        seen = self.bucket_rows > 0
        idf = np.where(seen, np.log((self.n_chunks + 1) / (np.where(seen, self.bucket_rows, 0) + 1)), 0.0)
        hashed = self.chunks.select("id", "chunk_no", "doc_date", "buckets")
        return SearchIndex(self.chunks, token_table(self.chunks), hashed_tfidf(hashed, "buckets", idf[:dim]), idf)


def _log(spark: SparkSession, path: str) -> list:
    """Entries of all commits; one row per segment added or removed."""
    try:
        return spark.read.schema(LOG).parquet(f"{path}/log").orderBy("version").collect()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return []


def _active(log: list, version: int | None = None) -> dict:
    found: dict = {}
    for row in log:
        if version is None or row["version"] <= version:
            found.pop(row["segment"], None)
            if row["action"] == "add":
                found[row["segment"]] = row
    return found


def _commit(spark: SparkSession, path: str, rows: list[tuple]) -> None:
    spark.createDataFrame(rows, LOG).coalesce(1).write.mode("append").parquet(f"{path}/log")


def _term_bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(TERM_BUCKETS)).cast("int")


def _blocks_of_ranges(range_rows: pa.Table) -> pa.RecordBatch:
    """The blocks of the rows of one range: an entry per chunk and term, entries in the order of the chunks."""
    key = range_rows.select(["id", "chunk_no", "day", "doc_len"]).combine_chunks()
    tokens = range_rows["tokens"].combine_chunks()
    sizes = pc.list_value_length(tokens).fill_null(0).to_numpy()
    words = tokens.flatten().dictionary_encode()
    groups = key.to_pandas().groupby(key.column_names, dropna=False, sort=False).ngroup().to_numpy()
    first = np.unique(groups, return_index=True)[1]  # rows that agree in all of these count as one chunk
    cells = words.indices.to_numpy().astype(np.int64) * len(first) + np.repeat(groups, sizes)
    cells, tf = np.unique(cells, return_counts=True)
    term, group = np.divmod(cells, max(1, len(first)))
    starts = np.flatnonzero(np.diff(term, prepend=-1))
    row = first[group]
    entry = [key[c].combine_chunks().take(pa.array(row)) for c in key.column_names] + [pa.array(tf, pa.int32())]
    entries = pa.StructArray.from_arrays(entry, ENTRY)
    at = key["doc_len"].to_numpy()[row], key["day"].to_numpy()[row]
    least = [pa.array(np.minimum.reduceat(x, starts) if len(starts) else x, pa.int32()) for x in at]
    most = pa.array(np.maximum.reduceat(tf, starts) if len(starts) else tf, pa.int32())
    bounds = np.append(starts, len(term)).astype(np.int32)
    return pa.RecordBatch.from_arrays([
        pa.array(np.full(len(starts), range_rows["range"][0].as_py()), pa.int64()), words.dictionary.take(pa.array(term[starts])),
        pa.array(np.diff(bounds), pa.int64()), most, *least, pa.ListArray.from_arrays(pa.array(bounds), entries),
    ], ["range", "term", "df", "max_tf", "min_len", "min_day", "entries"])


def _build_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batch function over stored chunks. Rows of a range follow each other, so a task holds one range at a time; a range that is
    read by two tasks gets two blocks per term, whose bounds and entries add up."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        ranges = batch.column("range").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(ranges)) + 1).tolist(), len(ranges)]
        for start, end in zip(cuts, cuts[1:]):
            if start == end:
                continue
            if held and held[0].column("range")[0].as_py() != ranges[start]:
                yield _blocks_of_ranges(pa.Table.from_batches(held))
                held = []
            held.append(batch.slice(start, end - start))
    if held:
        yield _blocks_of_ranges(pa.Table.from_batches(held))


def _rotated(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def _routes(terms: pa.Array) -> np.ndarray:
    """``_term_bucket`` of every term of up to 31 bytes, as XXH64 has it; longer ones, which are rare, get 0. Tells where a block is
    sent only, so a wrong one would cost files, not hits."""
    terms = terms.cast(pa.large_binary())
    ends = np.frombuffer(terms.buffers()[1], np.int64)[terms.offset : terms.offset + len(terms) + 1]
    data = np.concatenate([np.frombuffer(terms.buffers()[2] or b"", np.uint8), np.zeros(8, np.uint8)])
    at, left = ends[:-1].copy(), np.diff(ends)
    short = left < 32
    one, two, three, four, five = (np.uint64(p) for p in (
        0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    hashed = left.astype(np.uint64) + np.uint64(42) + five

    def step(width: int, mixed) -> None:
        rows = np.flatnonzero(short & (left >= width))
        value = np.zeros((len(rows), 8), np.uint8)
        value[:, :width] = data[at[rows, None] + np.arange(width)]
        hashed[rows] = mixed(hashed[rows], value.view(np.uint64).ravel())
        at[rows] += width
        left[rows] -= width

    for _ in range(3):
        step(8, lambda h, v: _rotated(h ^ (_rotated(v * two, 31) * one), 27) * one + four)
    step(4, lambda h, v: _rotated(h ^ (v * one), 23) * two + three)
    for _ in range(3):
        step(1, lambda h, v: _rotated(h ^ (v * five), 11) * one)
    hashed ^= hashed >> np.uint64(33)
    hashed *= two
    hashed ^= hashed >> np.uint64(29)
    hashed *= three
    hashed ^= hashed >> np.uint64(32)
    return np.where(short, (hashed % np.uint64(TERM_BUCKETS)).view(np.int64), 0)


def _packed_blocks(build):
    """Batch function: the blocks that ``build`` gives, those of a range and a route (the bucket of their terms) as one value. Column by
    column and compressed they take a third of what they take as rows, which have eight bytes for every number."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        options = pa.ipc.IpcWriteOptions(compression="zstd")
        for blocks in build(batches):
            if not blocks.num_rows:
                continue
            route = _routes(blocks.column("term"))
            order = np.argsort(route, kind="stable")
            cuts = np.append(np.flatnonzero(np.diff(route[order], prepend=-1)), len(order))
            held = []
            for start, end in zip(cuts, cuts[1:]):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, blocks.schema, options=options) as writer:
                    writer.write_batch(blocks.take(pa.array(order[start:end])))
                held.append(sink.getvalue().to_pybytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(route[order[cuts[:-1]]]), blocks.column("range").take(pa.array(order[cuts[:-1]])), pa.array(held, pa.binary())],
                ["route", "range", "blocks"])

    return run


def _unpacked_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for value in batch.column("blocks"):
            yield from pa.ipc.open_stream(value.as_buffer())


def _narrow(rows: DataFrame, dim: int) -> DataFrame:
    """Chunks with their lists in fewer bytes, for an exchange: tokens are runs of letters, so a space can join them."""
    kind = "array<smallint>" if dim <= 1 << 15 else rows.schema["buckets"].dataType
    return rows.withColumns({"tokens": F.array_join("tokens", " "), "buckets": F.col("buckets").cast(kind)})


def _widened(rows: DataFrame, schema) -> DataFrame:
    empty = F.array().cast("array<string>")
    return rows.withColumns({"tokens": F.when(F.col("tokens") == "", empty).otherwise(F.split("tokens", " ")),
                             "buckets": F.col("buckets").cast(schema["buckets"].dataType)})


def _in_order(rows: DataFrame, order: list[str]) -> DataFrame:
    return rows.repartitionByRange(*order).sortWithinPartitions(*order)


def _write_segment(rows: DataFrame, path: str, segment: str, dim: int, range_bits: int) -> tuple:
    """Writes the chunks and blocks of a segment, over what an earlier attempt left; returns its statistics."""
    moved = _in_order(_narrow(rows, dim), ["doc_date", "id", "chunk_no"])
    return _write_ordered(_widened(moved, rows.schema), path, segment, dim, range_bits)


def _write_ordered(rows: DataFrame, path: str, segment: str, dim: int, range_bits: int) -> tuple:
    """As ``_write_segment``, for rows in date order within partitions that follow each other."""
    spark = rows.sparkSession
    placed = rows.withColumn("range", F.shiftright(F.monotonically_increasing_id(), range_bits))
    where = f"{path}/chunks/segment={segment}"
    placed.write.mode("overwrite").option("compression", "zstd").parquet(where)
    release(spark)
    chunks = spark.read.schema(placed.schema).parquet(where)
    n, total = chunks.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("tokens").cast("long")), F.lit(0))).first()

    # Terms are counted where a range lies, at most 2 ** range_bits chunks at a time; only finished blocks are shuffled, packed.
    read = chunks.select("range", "id", "chunk_no", F.unix_date("doc_date").alias("day"), F.size("tokens").alias("doc_len"), "tokens")
    kinds = {f.name: f.dataType.simpleString() for f in read.schema.fields}
    entry = ", ".join(f"{c}: {kinds.get(c, 'int')}" for c in ENTRY)
    schema = f"range long, term string, df long, max_tf int, min_len int, min_day int, entries array<struct<{entry}>>"
    packed = read.mapInArrow(_packed_blocks(_build_blocks), "route long, range long, blocks binary")
    tasks = max(spark.sparkContext.defaultParallelism, -(-total // TASK_TOKENS))
    blocks = packed.repartition(tasks, "route", F.shiftright("range", 6)).mapInArrow(_unpacked_blocks, schema)
    blocks = blocks.withColumn("term_bucket", _term_bucket(F.col("term")))
    (blocks.sortWithinPartitions("term_bucket", "term", "range").write.mode("overwrite").option("compression", "zstd")
     .partitionBy("term_bucket").parquet(f"{path}/blocks/segment={segment}"))
    release(spark)

    bucket_rows = [0] * dim
    hashed = chunks.select(F.explode(F.array_distinct("buckets")).alias("b"))
    for row in hashed.groupBy("b").agg(F.count(F.lit(1)).alias("n")).collect():
        bucket_rows[row["b"]] = row["n"]
    return n, total, bucket_rows


def append(
    corpus: DataFrame, path: str, segment: str | None = None, max_chars: int = DEFAULT_MAX_CHARS, dim: int = DEFAULT_DIM,
    range_bits: int = RANGE_BITS,
) -> int:
    """Add ``corpus`` (id, doc_date, text) as a segment; returns the version that holds it.

    A segment that the log has already is left alone, so a replay adds nothing. Settings are those of the first
    segment. Rows without a date are left out, as no as-of search could return them.
    """
    spark = corpus.sparkSession
    log = _log(spark, path)
    segment = f"s-{segment or uuid.uuid4().hex}"
    version = max((r["version"] for r in log), default=0)
    if any(r["segment"] == segment for r in log):
        return version
    if log:
        max_chars, dim, range_bits = (log[0][c] for c in ("max_chars", "dim", "range_bits"))
    dated = corpus.select("id", "doc_date", "text").dropna(subset=["doc_date"])
    # Texts are put in order before they are cut: the exchange and its sampling pass see whole texts and nothing derived.
    rows = with_tokens(chunk(_in_order(dated, ["doc_date", "id"]), "text", max_chars))
    rows = rows.withColumn("buckets", token_buckets(F.col("tokens"), dim))
    stats = _write_ordered(rows, path, segment, dim, range_bits)
    _commit(spark, path, [(version + 1, "add", segment, *stats, max_chars, dim, range_bits)])
    return version + 1


def merge(spark: SparkSession, path: str) -> int:
    """Write all segments as one, with ranges over all dates; earlier versions stay readable."""
    index = load(spark, path)
    if len(index.segments) < 2:
        return index.version
    segment, set_ = f"s-merged-{index.version + 1}", index.settings
    stats = _write_segment(index.chunks.drop(*PLACE), path, segment, set_["dim"], set_["range_bits"])
    gone = [(index.version + 1, "remove", s, 0, 0, None, *set_.values()) for s in index.segments]
    _commit(spark, path, [*gone, (index.version + 1, "add", segment, *stats, *set_.values())])
    return index.version + 1


def load(spark: SparkSession, path: str, version: int | None = None) -> StoredIndex:
    """The index as of ``version``, or the latest one."""
    log = _log(spark, path)
    if version is not None and version not in {r["version"] for r in log}:
        raise ValueError(f"no version {version} at {path}")
    active = _active(log, version)
    if not active:
        raise ValueError(f"no index at {path}")
    rows = list(active.values())
    n, total = sum(r["n_chunks"] for r in rows), sum(r["total_len"] for r in rows)
    chosen = F.col("segment").isin(list(active))
    chunks, blocks = (spark.read.parquet(f"{path}/{part}").where(chosen) for part in ("chunks", "blocks"))
    settings = {c: rows[0][c] for c in ("max_chars", "dim", "range_bits")}
    return StoredIndex(
        path, version or log[-1]["version"], list(active), n, total / n if n else 0.0,
        np.sum([r["bucket_rows"] for r in rows], axis=0), settings, chunks, blocks)


class ReadPlan(NamedTuple):
    """What a search reads: ``weights`` (query_id, as_of_day, term, idf), ``blocks`` of its terms, and all ``bounds`` (query_id,
    segment, range, bound), none of which begins after its query's date."""

    weights: DataFrame
    blocks: DataFrame
    bounds: DataFrame


def plan_reads(queries: DataFrame, index: StoredIndex) -> ReadPlan:
    terms = materialize(query_terms(queries).withColumn("as_of_day", F.unix_date("as_of")).drop("as_of"), "query-terms")

    def folders(rows: DataFrame, few: list) -> DataFrame:
        known = rows.sparkSession.createDataFrame([(t,) for t in few], "term string").select(_term_bucket(F.col("term")))
        return rows.where(F.col("term_bucket").isin(sorted({r[0] for r in known.distinct().collect()})))

    blocks = only_among(index.blocks, "term", terms, folders)
    heads = materialize(blocks.select(*PLACE, "term", "df", "max_tf", "min_len", "min_day"), "heads")
    # Document frequencies count all dates, so they come before the dates prune anything.
    idf = bm25_idf(F.lit(index.n_chunks), F.col("df"))
    frequency = heads.groupBy("term").agg(F.sum("df").alias("df"))
    weights = materialize(terms.join(frequency, "term").select("query_id", "as_of_day", "term", idf.alias("idf")), "weights")
    day = latest_day(queries)
    if day is not None:
        blocks, heads = (x.where(F.col("min_day") < day) for x in (blocks, heads))
    most = F.col("idf") * bm25_weight(F.col("max_tf"), F.col("min_len"), F.lit(index.mean_len))
    bounds = heads.join(weights, "term").where("as_of_day IS NULL OR min_day < as_of_day")
    bounds = materialize(bounds.groupBy("query_id", *PLACE).agg(F.sum(most).alias("bound")), "bounds")
    return ReadPlan(weights, blocks, bounds)


def _score_ranges(mean_len: float, k: int | None):
    """Function from the weights and the blocks of one range to the scores of its chunks; with ``k``, only of those
    among the ``k`` best of a query there, and of what ties with them."""

    def run(wanted: pa.Table, read: pa.Table) -> pa.Table:
        lists = read["entries"].combine_chunks()
        flat = lists.flatten()
        key = pd.DataFrame({c: flat.field(c).to_pandas() for c in ENTRY[:-1]})
        place = key.groupby(ENTRY[:-1], dropna=False, sort=False).ngroup().to_numpy()
        first = np.unique(place, return_index=True)[1]
        chunks = key.iloc[first].reset_index(drop=True)
        same = chunks.groupby(["id", "chunk_no"], dropna=False, sort=False).ngroup().to_numpy()
        kept = np.unique(same, return_index=True)[1]
        tf, doc_len = flat.field("tf").to_numpy(), key["doc_len"].to_numpy(dtype=np.float64)
        weight = tf * (BM25_K1 + 1) / (tf + BM25_K1 * (1 - BM25_B + BM25_B * doc_len / mean_len))
        ends = np.cumsum(pc.list_value_length(lists).to_numpy())
        days = chunks["day"].to_numpy(dtype=np.float64)

        asked = wanted.select(["query_id", "as_of_day", "term", "idf"]).to_pandas()
        vocabulary = pd.Index(read["term"].to_pandas()).unique()
        asked["term_no"] = vocabulary.get_indexer(asked["term"])
        asked["query_no"], names = pd.factorize(asked["query_id"], use_na_sentinel=False)
        asked = asked[asked["term_no"] >= 0].sort_values(["term_no", "query_no"])
        block_terms = vocabulary.get_indexer(read["term"].to_pandas())
        step, found = max(1, SCORE_CELLS // max(1, len(first))), []
        for low in range(0, len(names), step):
            part = asked[(asked["query_no"] >= low) & (asked["query_no"] < low + step)]
            n = min(step, len(names) - low)
            query, idf = part["query_no"].to_numpy() - low, part["idf"].to_numpy()
            starts = np.searchsorted(part["term_no"].to_numpy(), np.arange(len(vocabulary) + 1))
            scores = np.zeros((n, len(first)))
            for block, term in enumerate(block_terms):
                uses = slice(starts[term], starts[term + 1])
                own = slice(ends[block - 1] if block else 0, ends[block])
                # The chunks of a block differ, and so do the queries of a term: every cell is added to once.
                scores[query[uses, None], place[own]] += idf[uses, None] * weight[own]
            bound = np.full(n, np.inf)
            bound[query] = part["as_of_day"].astype("float64").fillna(np.inf).to_numpy()
            scores[~((days < bound[:, None]) | np.isinf(bound)[:, None])] = 0.0
            if len(kept) < len(first):  # chunks of one name count together
                scores, apart = np.zeros((n, len(kept))), scores
                np.add.at(scores.T, same, apart.T)
            mask = scores > 0
            if k is not None and len(kept) > k:
                floor = np.partition(scores, len(kept) - k, axis=1)[:, [len(kept) - k]]
                mask &= scores >= floor - 10.0**-SCORE_DECIMALS
            rows, cells = np.nonzero(mask)
            found.append((rows + low, kept[cells], scores[rows, cells]))
        rows, cells, values = (np.concatenate([f[i] for f in found]) if found else np.array([], dtype=np.int64) for i in range(3))
        ids = wanted["query_id"].combine_chunks().take(pa.array(np.unique(pd.factorize(
            wanted["query_id"].to_pandas(), use_na_sentinel=False)[0], return_index=True)[1]))
        at = pa.array(first[cells])
        return pa.table({"query_id": ids.take(pa.array(rows)), "id": flat.field("id").take(at),
                         "chunk_no": flat.field("chunk_no").take(at), "score": pa.array(values, pa.float64())})

    return run


def _scores(pairs: DataFrame, plan: ReadPlan, mean_len: float, k: int | None = None) -> DataFrame:
    """Scores of the chunks in the given (query_id, segment, range), or only what may be among the ``k`` best of a query.

    Weights and blocks of a range meet in one task, with at most about ``MAX_BLOCK_TERMS`` weights at a time, and
    (query, chunk) pairs stay there: what is shuffled on is queries x ranges x k rows.
    """
    deals = max(1, -(-plan.weights.count() // MAX_BLOCK_TERMS))
    wanted = pairs.select("query_id", *PLACE).join(plan.weights, "query_id")
    wanted = wanted.withColumn("deal", F.pmod(F.xxhash64("query_id"), F.lit(deals)))
    read = only_among(plan.blocks, "range", pairs).select(*PLACE, "term", "entries")
    read = read.withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(deals - 1)).cast("array<bigint>")))
    kinds = {f.name: f.dataType.simpleString() for f in wanted.schema.fields}
    entry = {f.name: f.dataType.simpleString() for f in read.schema["entries"].dataType.elementType.fields}
    schema = f"query_id {kinds['query_id']}, id {entry['id']}, chunk_no {entry['chunk_no']}, score double"
    found = wanted.groupBy(*PLACE, "deal").cogroup(read.groupBy(*PLACE, "deal")).applyInArrow(_score_ranges(mean_len, k), schema)
    return found.groupBy("query_id", "id", "chunk_no").agg(F.round(F.sum("score"), SCORE_DECIMALS).alias("score"))


def first_ranges(plan: ReadPlan) -> DataFrame:
    return top_k_per_key(plan.bounds, ["query_id"], [F.desc("bound"), *map(F.asc, PLACE)], FIRST_RANGES).drop("rank")


def further_ranges(plan: ReadPlan, first: DataFrame, best: DataFrame, k: int) -> DataFrame:
    """Ranges that may still hold one of the ``k`` best: their bound reaches the k-th score, if there is one."""
    floor = best.where(F.col("rank") == k).select("query_id", F.col("score").alias("floor"))
    rest = plan.bounds.join(first.select("query_id", *PLACE), ["query_id", *PLACE], "left_anti").join(floor, "query_id", "left")
    return rest.where(F.col("floor").isNull() | (F.col("bound") + 10.0**-SCORE_DECIMALS >= F.col("floor")))


def search_stored(queries: DataFrame, index: StoredIndex, k: int = HITS) -> DataFrame:
    """The ``k`` best chunks of every query (query_id, text, as_of) by BM25, as ``search_keyword`` ranks them, from
    the stored blocks. Queries are a table throughout: nothing of them reaches the driver but up to ``blocks.PUSHED_VALUES``
    distinct terms. Runs jobs when called.
    """
    order = [F.desc("score"), F.asc("id"), F.asc("chunk_no")]
    plan = plan_reads(queries, index)
    first = materialize(first_ranges(plan), "ranges")
    best = materialize(top_k_per_key(_scores(first, plan, index.mean_len, k), ["query_id"], order, k), "hits")
    rest = materialize(further_ranges(plan, first, best, k), "ranges")
    found = best.drop("rank").unionByName(_scores(rest, plan, index.mean_len, k))
    return top_k_per_key(found, ["query_id"], order, k)
