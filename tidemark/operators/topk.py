"""Top-k, ranked lists and repeatable samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.session import materialize


def top_k_per_key(df: DataFrame, key: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows of every key, ranked from 1.

    Spark cuts each task's rows to ``k`` per key before the shuffle, so one very common key moves at
    most ``k`` rows per task. ``order`` must end in a unique tie-break.
    """
    window = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= k)


def range_buckets(df: DataFrame, key: list[str], order: list[Column], ranges: int | None = None) -> DataFrame:
    """Add ``bucket``: ranges of rows of about equal size in (key, order), numbered in that order.

    A key of any size is cut to as many ranges as its share of rows. The numbers are written down with
    the rows, so they stay the same when a task is run again.
    """
    columns = [*[F.asc(k) for k in key], *order]
    ranged = df.repartitionByRange(ranges, *columns) if ranges else df.repartitionByRange(*columns)
    return materialize(ranged.withColumn("bucket", F.spark_partition_id()), "ranges")


def rank_per_key(
    df: DataFrame, key: list[str], order: list[Column], rank: str = "rank", ranges: int | None = None
) -> DataFrame:
    """Rank of every row within its key, from 1, without ever sorting a whole key in one task.

    Rows are ranked inside their range, and the counts of earlier ranges of the key are added.
    ``order`` must end in a unique tie-break.
    """
    ranged = range_buckets(df, key, order, ranges)
    before = Window.partitionBy(*key).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy(*key, "bucket").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select(*key, "bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(*key, "bucket").orderBy(*order))
    ranked = ranged.withColumn("_inside", inside).join(offsets, [*key, "bucket"])
    return ranked.withColumn(rank, (F.col("_before") + F.col("_inside")).cast("int")).drop("bucket", "_inside", "_before")


def top_k(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    return df.orderBy(*order).limit(k)


def rank_importance(df: DataFrame, value: str = "importance", name: str = "feature") -> DataFrame:
    """Largest signed value first (not the largest size), ties by name."""
    return df.orderBy(F.desc(value), F.asc(name))


def draw_order(key: Column, seed: int | str) -> Column:
    """A fixed shuffle order: the MD5 of key and seed."""
    return F.md5(F.concat_ws("-", key.cast("string"), F.lit(str(seed))))


def sample_rows(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """Up to ``n`` rows without replacement, the same ones on every run."""
    return df.orderBy(draw_order(F.col(key), seed), key).limit(n)


def sample_balanced(df: DataFrame, key: str, side: str, draws: int, seed: int = 42) -> DataFrame:
    """One row of each side per draw; draws do not know of each other, so a row can come again.

    Each draw is a minimum per side, which combines before the shuffle: rows are never sorted.
    """
    order = [F.struct(draw_order(F.col(key), f"{seed}-{d}"), F.col(key)) for d in range(draws)]
    picks = df.groupBy(side).agg(*[F.min(o)[key].alias(f"draw_{d}") for d, o in enumerate(order)])
    pairs = F.array(*[F.struct(F.lit(d).alias("draw"), F.col(f"draw_{d}").alias(key)) for d in range(draws)])
    return picks.select(side, F.explode(pairs).alias("p")).select(side, "p.*")
