"""Sinks: Parquet, NDJSON, CSV and the leaderboard history."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, functions as F, types as T


def write_table(
    df: DataFrame, path: str, compression: str | None = None, partition_by: list[str] = (), mode: str = "error"
) -> None:
    """Parquet, plain or with a named codec such as ``zstd``."""
    writer = df.write.mode(mode).partitionBy(*partition_by)
    if compression:
        writer = writer.option("compression", compression)
    writer.parquet(path)


def write_ndjson(df: DataFrame, path: str, mode: str = "error") -> None:
    """One object per line, null fields kept."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_leaderboard(df: DataFrame, path: str, mode: str = "error") -> None:
    write_ndjson(df, path, mode)


def write_csv(df: DataFrame, path: str, mode: str = "error") -> None:
    """Header CSV; arrays, structs and vectors go in as JSON text, which CSV cannot hold otherwise."""
    def plain(field: T.StructField) -> Column:
        if isinstance(field.dataType, VectorUDT):
            return F.to_json(vector_to_array(field.name)).alias(field.name)
        nested = isinstance(field.dataType, (T.ArrayType, T.StructType, T.MapType))
        return F.to_json(field.name).alias(field.name) if nested else F.col(field.name)

    df.select(*map(plain, df.schema.fields)).write.mode(mode).option("header", True).csv(path)
