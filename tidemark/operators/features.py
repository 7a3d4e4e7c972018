"""Feature values: checks, merging, wide tables, encoding and fail-soft computation."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.lists import is_subset
from tidemark.functions.text import strip_quotes, to_boolean, to_digits, to_float
from tidemark.plans.feature_plan import SubFeature, sized_plan

# Patterns of the multi-categorical rule, applied after every string became "".
# Possessive and unrolled, so that long texts do not overflow the stack.
JSON_STRING = r'(?s)"[^"\\]*+(?:\\.[^"\\]*+)*+"'
LIST_OF_STRINGS = r'^\s*+\[\s*+(?:""\s*+(?:,\s*+""\s*+)*+)?\]\s*+\z'
LIST_WITH_NESTING = r'(?s)^\s*\[.*[\[{]'

VALUE_KEY = ["id", "group_no", "feature", "sub"]
MODEL_KINDS = ["xgb", "lr", "rf"]


def cross_groups(ids: DataFrame, plan: list[SubFeature]) -> DataFrame:
    """Every record with every feature group. Groups come from the plan, so they are a short literal."""
    numbers = sorted({s.group_no for s in plan})
    return ids.select("*", F.explode(F.array(*[F.lit(n) for n in numbers])).alias("group_no"))


# ---- value checks ---------------------------------------------------------------------------------

def _clean(raw: Column) -> Column:
    text = strip_quotes(raw)
    return F.when(text != "None", text)


def _skeleton(text: Column) -> Column:
    return F.regexp_replace(text, JSON_STRING, '""')


def _nested_list(text: Column) -> Column:
    return _skeleton(text).rlike(LIST_WITH_NESTING) & F.try_parse_json(text).isNotNull()


def _checked_items(text: Column, allowed: Column) -> Column:
    """The list if it is JSON, all strings and within the allowed values; null otherwise."""
    items = F.from_json(text, "array<string>")
    fits = _skeleton(text).rlike(LIST_OF_STRINGS) & items.isNotNull() & is_subset(items, allowed)
    return F.when(fits, items)


def _typed(kind: Column, text: Column, allowed: Column, lenient_float: bool) -> list[Column]:
    items = _checked_items(text, allowed)
    no_answer = (F.size(items) == 1) & (F.get(items, F.lit(0)) == "None")
    number = (
        F.when(kind == "boolean", to_boolean(text))
        .when(kind == "integer", to_digits(text))
        .when(kind == "float", to_float(text, lenient_float))
    )
    return [
        number.alias("num"),
        F.when((kind == "categorical") & F.array_contains(allowed, text), text).alias("txt"),
        F.when((kind == "multi-categorical") & ~no_answer, items).alias("items"),
    ]


def _tag(values: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows with their plan entry; rows of features outside the group's plan get a null ``feature``."""
    subs, small = sized_plan(plan)
    hinted = F.broadcast if small else lambda df: df
    planned = subs.select("group_no", "feature").distinct().withColumn("planned", F.lit(True))
    known = values.join(hinted(planned), ["group_no", "feature"], "left").withColumn(
        "feature", F.when(F.col("planned"), F.col("feature"))
    )
    tagged = known.join(hinted(subs), ["group_no", "feature", "sub"], "left")
    return tagged.withColumn("text", _clean(F.col("raw")))


def _plan_groups(plan: DataFrame) -> DataFrame:
    """One row per group: its sub-features and its number of features."""
    entries = F.collect_list(F.struct("feature", "sub", "type"))
    subs, small = sized_plan(plan)
    grouped = subs.groupBy("group_no").agg(
        entries.alias("subs"), F.count_distinct("feature").alias("n_features")
    )
    return F.broadcast(grouped) if small else grouped


def _checked_rows(checked: DataFrame, plan: DataFrame, fails: Column, v_type: str, whole_group: bool) -> DataFrame:
    """Apply failures to ``checked`` (id, group_no, feature, sub, type, v, broken) and lay rows out again.

    Repeats are reduced per (record, feature, sub) before lists are made, so a list is no longer than
    the group's plan. One scan and no join on the data side.
    """
    one = checked.groupBy("id", "group_no", "feature", "sub", "type").agg(
        F.max("v").alias("v"), F.bool_or("broken").alias("broken")
    )
    entry = F.struct("feature", "sub", "type", "v")
    lists = one.groupBy("id", "group_no").agg(
        F.collect_list(entry).alias("entries"),
        F.array_distinct(F.flatten(F.collect_list(
            F.when(F.col("broken"), F.array("feature")).otherwise(F.array().cast("array<string>"))
        ))).alias("broken_features"),
        F.bool_or("broken").alias("broken"),
        F.size(F.collect_set("feature")).alias("n_seen"),
    )
    both = lists.join(_plan_groups(plan), "group_no")

    def blank(sub: Column) -> Column:
        nothing = F.lit(None).cast(v_type).alias("v")
        return F.struct(sub["feature"].alias("feature"), sub["sub"].alias("sub"), sub["type"].alias("type"), nothing)

    def emptied(sub: Column) -> Column:
        """Sub-features whose feature came as an empty object or failed on its own."""
        came_empty = F.exists("entries", lambda e: e["sub"].isNull() & (e["feature"] == sub["feature"]))
        return came_empty if whole_group else came_empty | F.array_contains("broken_features", sub["feature"])

    def kept(e: Column) -> Column:
        usable = e["sub"].isNotNull() & e["type"].isNotNull()
        return usable if whole_group else usable & ~F.array_contains("broken_features", e["feature"])

    fine = F.concat(F.filter("entries", kept), F.transform(F.filter("subs", emptied), blank))
    rows = F.when(fails, F.transform("subs", blank)).otherwise(fine) if whole_group else fine
    return both.select("id", "group_no", F.explode(rows).alias("e")).select("id", "group_no", "e.*").select(
        *VALUE_KEY, "type", "v.*"
    )


def coerce(
    values: DataFrame, plan: DataFrame, on_unknown_key: str = "fail", lenient_float: bool = False
) -> DataFrame:
    """Raw values (id, group_no, feature, sub, raw) to typed ones (..., type, num, txt, items).

    A row with a null ``sub`` stands for an empty value object. A group of one record fails as a whole,
    giving nulls for all its sub-features, if a feature is missing, a sub-key is unknown (unless
    ``on_unknown_key="drop"``) or a list holds lists or objects. Any other bad value only turns null.
    """
    tagged = _tag(values, plan)
    planned = F.col("feature").isNotNull()
    unknown = planned & F.col("sub").isNotNull() & F.col("type").isNull()
    nested = (F.col("type") == "multi-categorical") & F.coalesce(_nested_list(F.col("text")), F.lit(False))
    nested = F.coalesce(nested, F.lit(False))
    v = F.struct(*_typed(F.col("type"), F.col("text"), F.col("possible_values"), lenient_float))
    checked = tagged.select(
        "id", "group_no", "feature", F.when(F.col("type").isNotNull(), F.col("sub")).alias("sub"), "type",
        v.alias("v"), (nested if on_unknown_key == "drop" else unknown | nested).alias("broken"),
        unknown.alias("unknown"),
    )
    if on_unknown_key == "drop":
        # The feature still counts as given, but its unknown key leaves no row behind.
        checked = checked.withColumn("sub", F.when(F.col("unknown"), "").otherwise(F.col("sub")))
    fails = F.col("broken") | (F.col("n_seen") < F.col("n_features"))
    return _checked_rows(checked.drop("unknown"), plan, fails, "struct<num:double,txt:string,items:array<string>>", True)


def coerce_strict(values: DataFrame, plan: DataFrame) -> DataFrame:
    """The strict form: one bad value fails the whole feature of that record.

    Boolean words are case-sensitive, and multi-categorical values stay JSON text (in ``txt``).
    """
    tagged = _tag(values, plan).filter("feature is not null")
    kind, text, allowed = F.col("type"), F.col("text"), F.col("possible_values")
    number = (
        F.when(kind == "boolean", to_boolean(text, case_sensitive=True))
        .when(kind == "integer", to_digits(text))
        .when(kind == "float", to_float(text))
    )
    label = (
        F.when((kind == "categorical") & F.array_contains(allowed, text), text)
        .when((kind == "multi-categorical") & _checked_items(text, allowed).isNotNull(), text)
    )
    typed = tagged.withColumn("num", number).withColumn("txt", label)
    bad = F.when(kind.isNull(), F.col("sub").isNotNull()).otherwise(
        text.isNotNull() & F.col("num").isNull() & F.col("txt").isNull()
    )
    checked = typed.select(
        "id", "group_no", "feature", F.when(kind.isNotNull(), F.col("sub")).alias("sub"), "type",
        F.struct("num", "txt").alias("v"), bad.alias("broken"),
    )
    return _checked_rows(checked, plan, F.lit(False), "struct<num:double,txt:string>", False)


# ---- merging --------------------------------------------------------------------------------------

def merge_features(old: DataFrame, new: DataFrame, key: list[str] = ("id", "feature")) -> DataFrame:
    """New values replace all old sub-values of the same record and feature; new records are let in."""
    keep = old.join(new.select(*key).distinct(), list(key), "left_anti")
    return keep.unionByName(new)


def latest_group(values: DataFrame, value: str, key: list[str]) -> DataFrame:
    """One value per key: that of the highest group number. Combines before the shuffle."""
    return values.groupBy(*key).agg(F.max_by(value, "group_no").alias(value))


def collect_features(values: DataFrame, value: str = "value") -> DataFrame:
    """One row per record with its sorted (feature, value) entries, later groups winning.

    Repeats are reduced first, so a list never exceeds the number of distinct features.
    """
    one = latest_group(values, value, ["id", "feature"])
    return one.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("feature", value))).alias("features"))


def collect_reasons(reasons: DataFrame) -> DataFrame:
    return collect_features(reasons, "reason").withColumnRenamed("features", "reasons")


def of_split(rows: DataFrame, splits: DataFrame, split: str = "val") -> DataFrame:
    """Rows of the records of one split (id, split); by default those that errors may be looked up in."""
    return rows.join(splits.filter(F.col("split") == split).select("id").distinct(), "id", "left_semi")


def drop_feature(df: DataFrame, feature: str) -> DataFrame:
    """Without one feature: rows of a long table, ``feature--*`` columns of a wide one."""
    if "feature" in df.columns:
        return df.filter(F.col("feature") != feature)
    return df.drop(*[c for c in df.columns if c.startswith(f"{feature}--")])


# ---- wide tables and encoding ---------------------------------------------------------------------

def to_wide(values: DataFrame, plan: list[SubFeature]) -> DataFrame:
    """One row per record, one ``feature--sub`` column per planned sub-feature, absent ones null."""
    columns = []
    for s in plan:
        source = {"categorical": "txt", "multi-categorical": "items"}.get(s.type, "num")
        mine = (F.col("feature") == s.feature) & (F.col("sub") == s.sub)
        columns.append(F.max(F.when(mine, F.col(source))).alias(s.column))
    return values.groupBy("id").agg(*columns)


def one_hot(value: Column, categories: list[str]) -> list[Column]:
    """One 0/1 column per fixed category; null or unknown is all zeros."""
    return [F.when(value == c, 1.0).otherwise(0.0) for c in categories]


def multi_hot(items: Column, vocabulary: list[str]) -> list[Column]:
    """Counts per fixed vocabulary item: null counts nothing, repeats count twice, unknown is ignored."""

    def count(value: str) -> Column:
        return F.coalesce(F.size(F.filter(items, lambda x: x == value)), F.lit(0)).cast("double")

    return [count(v) for v in vocabulary]


def impute(value: Column, model: str, fill: float = 0.0) -> list[Column]:
    """Zero for gaps; for boosted trees also a gap indicator, as Spark trees have no missing branch."""
    filled = F.coalesce(value, F.lit(fill))
    return [filled, F.when(value.isNull(), 1.0).otherwise(0.0)] if model == "xgb" else [filled]


def bool01(value: Column, null_bool: float = 0.0) -> Column:
    return F.coalesce(value.cast("double"), F.lit(null_bool))


def encoded_columns(plan: list[SubFeature], model: str, skip: list[str] = ()) -> list[tuple[str, Column]]:
    out: list[tuple[str, Column]] = []
    for s in plan:
        if s.feature in skip:
            continue
        value = F.col(f"`{s.column}`")
        if s.type == "categorical":
            out += [(f"{s.column}={c}", e) for c, e in zip(s.possible_values, one_hot(value, s.possible_values))]
        elif s.type == "multi-categorical":
            out += [(f"{s.column}={c}", e) for c, e in zip(s.possible_values, multi_hot(value, s.possible_values))]
        else:
            names = [s.column, f"{s.column}=missing"]
            out += list(zip(names, impute(value.cast("double"), model)))
    return out


def design_matrix(
    wide: DataFrame, plan: list[SubFeature], model: str, skip: list[str] = (), keep: list[str] = ("id",)
) -> tuple[DataFrame, list[str]]:
    """``keep`` columns and a ``features`` vector, with the feature names. Absent columns are an error."""
    absent = [s.column for s in plan if s.feature not in skip and s.column not in wide.columns]
    if absent:
        raise ValueError(f"columns missing from the feature table: {absent}")
    encoded = encoded_columns(plan, model, skip)
    positions = [f"x{i}" for i in range(len(encoded))]
    numeric = wide.select(*keep, *[e.alias(p) for p, (_, e) in zip(positions, encoded)])
    assembled = VectorAssembler(inputCols=positions, outputCol="features").transform(numeric)
    return assembled.select(*keep, "features"), [name for name, _ in encoded]


def multicat_counts(df: DataFrame, items: str, vocabulary: list[str]) -> DataFrame:
    """Rows per fixed item, zeros kept, most frequent first. The counts are sums, so nothing explodes."""
    sums = [F.sum(e).cast("long") for e in multi_hot(F.col(items), vocabulary)]
    pairs = F.array(*[
        F.struct(F.lit(v).alias("item"), F.coalesce(s, F.lit(0)).alias("n")) for v, s in zip(vocabulary, sums)
    ])
    counts = df.agg(pairs.alias("pairs")).select(F.explode("pairs").alias("p")).select("p.*")
    return counts.orderBy(F.desc("n"), F.asc("item"))


# ---- fail-soft computation ------------------------------------------------------------------------

def apply_groups(
    pairs: DataFrame, plan: list[SubFeature], fn: Callable[[dict, int], tuple[dict, dict]]
) -> DataFrame:
    """Run ``fn(record, group_no) -> ({feature: {sub: raw}}, {feature: reason})`` for every pair.

    Result: id, group_no, feature, sub, raw, reason, ok. Lists become JSON text and other values that are not
    strings become their text, ``None`` among them. If ``fn`` raises or returns anything that cannot be laid
    out this way, every sub-feature of that group is null with ``ok`` false, and the job goes on. Rows stream
    through in Arrow batches.
    """
    def as_text(value: object) -> str:
        if isinstance(value, str):
            return value
        return json.dumps(value) if isinstance(value, list) else str(value)

    by_group: dict[int, list[SubFeature]] = {}
    for s in plan:
        by_group.setdefault(s.group_no, []).append(s)
    id_type = pairs.schema["id"].dataType.simpleString()
    schema = f"id {id_type}, group_no int, feature string, sub string, raw string, reason string, ok boolean"

    def one(record: dict) -> Iterator[tuple]:
        key, group = record["id"], int(record["group_no"])
        rows = []
        try:
            values, reasons = fn(record, group)
            for feature, subs in values.items():
                reason = None if reasons.get(feature) is None else as_text(reasons[feature])
                rows += [(key, group, feature, sub, as_text(raw), reason, True) for sub, raw in subs.items()]
                if not subs:
                    rows.append((key, group, feature, None, None, reason, True))
        except Exception:
            rows = [(key, group, s.feature, s.sub, None, None, False) for s in by_group[group]]
        yield from rows

    names = ["id", "group_no", "feature", "sub", "raw", "reason", "ok"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [row for record in pdf.to_dict("records") for row in one(record)]
            yield pd.DataFrame(rows, columns=names)

    return pairs.mapInPandas(run, schema)
