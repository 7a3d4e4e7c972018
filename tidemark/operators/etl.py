"""Projections, filters, joins and set operations over nested records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T


def project_paths(df: DataFrame, paths: dict[str, str]) -> DataFrame:
    """Select deep struct paths under new names: ``{alias: "a.b.c"}``."""
    return df.select(*[F.col(path).alias(alias) for alias, path in paths.items()])


def _leaves(column: Column, schema: T.StructType, prefix: str, recursive: bool) -> list[Column]:
    out = []
    for field in schema.fields:
        inner = column[field.name]
        if recursive and isinstance(field.dataType, T.StructType):
            out += _leaves(inner, field.dataType, f"{prefix}{field.name}_", recursive)
        else:
            out.append(inner.alias(prefix + field.name))
    return out


def flatten_struct(df: DataFrame, column: str, prefix: str, recursive: bool = True) -> DataFrame:
    """Struct fields to prefixed columns in the same row; the struct column goes away."""
    rest = [F.col(c) for c in df.columns if c != column]
    return df.select(*rest, *_leaves(F.col(column), df.schema[column].dataType, prefix, recursive))


def struct_except(df: DataFrame, column: str, drop: list[str]) -> DataFrame:
    """All fields of a struct as columns, but for the named ones."""
    kept = [f.name for f in df.schema[column].dataType.fields if f.name not in drop]
    return df.select(*[c for c in df.columns if c != column], *[F.col(column)[n].alias(n) for n in kept])


def rename(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed(mapping)


def lookup(df: DataFrame, key: str, value) -> DataFrame:
    """The record of one key, at most one row. The filter reaches the Parquet scan."""
    return df.filter(F.col(key) == F.lit(value)).limit(1)


def lookup_required(df: DataFrame, key: str, value):
    row = lookup(df, key, value).first()
    if row is None:
        raise KeyError(value)
    return row


def as_of(df: DataFrame, date_column: str, bound) -> DataFrame:
    """Rows dated strictly before the bound; the bound's own day is out, and so are null dates."""
    return df.filter(F.col(date_column) < bound)


def exclude_keys(df: DataFrame, key: str, blocked: list | DataFrame) -> DataFrame:
    """Drop blocked keys, given as a short list or as a table of any size."""
    if isinstance(blocked, DataFrame):
        return df.join(blocked.select(key).distinct(), key, "left_anti")
    return df.filter(~F.col(key).isin(blocked) | F.col(key).isNull())


def distinct_keys(df: DataFrame, key: str) -> DataFrame:
    return df.select(key).dropna().distinct()


def recode_outcome(outcome: Column) -> Column:
    """1 is a success; anything else, null too, is a failure."""
    return F.when(outcome == 1, "Success").otherwise("Failure")


def label_side(label: Column) -> Column:
    """``positive`` for label 1, ``rest`` for every other label and for null."""
    return F.when(label == 1, "positive").otherwise("rest")


def split_by_label(df: DataFrame, label: str = "label") -> tuple[DataFrame, DataFrame]:
    side = label_side(F.col(label))
    return df.filter(side == "positive"), df.filter(side == "rest")


def explode_references(df: DataFrame, array: str, name: str) -> DataFrame:
    """One row per array item, one row with a null item where the array is null or empty."""
    return df.select(*[c for c in df.columns if c != array], F.explode_outer(array).alias(name))


def left_join_children(parents: DataFrame, children: DataFrame, on: list[str]) -> DataFrame:
    """All parents with their child rows; a parent without children keeps one row of nulls."""
    return parents.join(children, on, "left")


def left_join_dim(df: DataFrame, dim: DataFrame, on: list[str], require_unique: bool = False) -> DataFrame:
    """Left join to the distinct rows of a dimension.

    A key with several variants fans out, unless ``require_unique``, which makes that an error.
    """
    dim = dim.distinct()
    if require_unique:
        repeated = F.count(F.lit(1)) > 1
        rest = [c for c in dim.columns if c not in on]
        dim = dim.groupBy(*on).agg(
            F.when(repeated, F.raise_error(F.lit("dimension key is not unique")).cast("boolean")).alias("_check"),
            *[F.first(c).alias(c) for c in rest],
        )
        dim = dim.filter(F.col("_check").isNull()).drop("_check")
    return df.join(dim, on, "left")


def join_xy(x: DataFrame, y: DataFrame, on: list[str]) -> DataFrame:
    """Feature rows with their labels, every phase and split in one join."""
    return x.join(y, on, "inner")


def missing_keys(ids: DataFrame, store: DataFrame, key: str) -> DataFrame:
    """Distinct ids that the store does not hold."""
    return ids.select(key).dropna().distinct().join(store.select(key), key, "left_anti")


def unseen(rows: DataFrame, stored: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose key is not stored, for few rows against a large store.

    The store is first cut to the keys at hand, so with a small batch it is scanned and not shuffled.
    """
    known = stored.select(*on).join(rows.select(*on).distinct(), on, "left_semi")
    return rows.join(known, on, "left_anti")


def of_this_pull(df: DataFrame, pulled: DataFrame, key: str) -> DataFrame:
    return df.join(pulled.select(key), key, "left_semi")


def distinct_rows(df: DataFrame) -> DataFrame:
    """Whole-row distinct. Maps cannot be compared, so they become sorted entry arrays."""
    sortable = [
        F.array_sort(F.map_entries(f.name)).alias(f.name) if isinstance(f.dataType, T.MapType) else F.col(f.name)
        for f in df.schema.fields
    ]
    return df.select(*sortable).distinct()


def union_all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def union_kinds(left: DataFrame, right: DataFrame) -> DataFrame:
    """Union of two record kinds; columns only one of them has are null in the other."""
    return left.unionByName(right, allowMissingColumns=True)


def upsert(old: DataFrame | None, new: DataFrame) -> DataFrame:
    """Old and new rows, repeats removed. Write the result to a new path, never over ``old``."""
    return distinct_rows(new if old is None else union_kinds(old, new))
