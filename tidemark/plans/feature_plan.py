"""Feature plans: one row per sub-feature, checked, edited and grouped as tables.

Columns: ``group_no, feature, sub, type, idea, sources, possible_values, example_values, instructions``.
"""

from __future__ import annotations

from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidemark.functions.text import encode_json

# The declared domains of a plan.
FEATURE_TYPES = ["boolean", "integer", "float", "categorical", "multi-categorical"]
VALUED_TYPES = ["categorical", "multi-categorical"]
OPERATIONS = ["add", "remove", "refine"]
PLAN_ONLY_COLUMNS = ["sources", "example_values", "possible_values"]

PLAN_SCHEMA = (
    "group_no int, feature string, sub string, type string, idea string, sources array<string>, "
    "possible_values array<string>, example_values array<string>, instructions string"
)

SUB_SCHEMA = "group_no int, feature string, sub string, type string, possible_values array<string>"

# Most sub-features of a plan that becomes columns or is broadcast; larger ones take the long form and plain joins.
MAX_PLAN_ROWS = 5_000


class SubFeature(NamedTuple):
    group_no: int
    feature: str
    sub: str
    type: str
    possible_values: tuple[str, ...]

    @property
    def column(self) -> str:
        return f"{self.feature}--{self.sub}"


def plan_table(spark: SparkSession, rows: list[dict]) -> DataFrame:
    return local_table(spark, rows, PLAN_SCHEMA)


def local_table(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A small table that is part of the plan itself: reading it starts no tasks."""
    arrow = to_arrow_schema(T.StructType.fromDDL(schema))
    columns = {f.name: [r.get(f.name) for r in rows] for f in arrow}
    return spark.createDataFrame(pa.table(columns, schema=arrow), schema)


def collect_plan(plan: DataFrame) -> list[SubFeature]:
    """The plan on the driver, in (group, feature, sub) order, refused when above its size bound."""
    subs = small_plan(plan)
    if subs is None:
        raise ValueError(f"a wide plan may have at most {MAX_PLAN_ROWS} sub-features; operators.long_matrix takes larger ones")
    return subs


def small_plan(plan: DataFrame) -> list[SubFeature] | None:
    """As ``collect_plan``, or nothing for a plan above the bound."""
    rows = plan.select(*SubFeature._fields).limit(MAX_PLAN_ROWS + 1).collect()
    if len(rows) > MAX_PLAN_ROWS:
        return None
    subs = [SubFeature(r[0], r[1], r[2], r[3], tuple(r[4] or ())) for r in rows]
    return sorted(subs, key=lambda s: (s.group_no if s.group_no is not None else -1, s.feature, s.sub))


def sized_plan(plan: DataFrame) -> tuple[DataFrame, bool]:
    """The plan's sub-features, and whether they may be broadcast: as a local table if small, else as they are."""
    subs = small_plan(plan)
    if subs is None:
        return plan.select(*SubFeature._fields), False
    rows = [s._asdict() | {"possible_values": list(s.possible_values)} for s in subs]
    return local_table(plan.sparkSession, rows, SUB_SCHEMA), True


def check_plan(types: DataFrame, values: DataFrame) -> DataFrame:
    """Join declared types (feature, sub, type) with declared values (feature, sub, possible_values).

    ``problem`` is null for a sound row. Values survive only for the two categorical kinds.
    """
    both = types.join(values, ["feature", "sub"], "full")
    valued = F.col("type").isin(VALUED_TYPES)
    problem = (
        F.when(F.col("type").isNull(), "values without a type")
        .when(~F.col("type").isin(FEATURE_TYPES), "unknown type")
        .when(valued & F.col("possible_values").isNull(), "categorical without values")
    )
    return both.select(
        "feature", "sub", "type",
        F.when(valued, F.col("possible_values")).alias("possible_values"),
        problem.alias("problem"),
    )


def require_sound(checked: DataFrame) -> DataFrame:
    bad = checked.filter("problem is not null").first()
    if bad is not None:
        raise ValueError(f"{bad['feature']}/{bad['sub']}: {bad['problem']}")
    return checked.drop("problem")


def apply_op(plan: DataFrame, operation: str, feature: str, explanation: str = "", new_rows: DataFrame | None = None) -> DataFrame:
    """Add, remove or refine one feature. A refined idea is the old one, a divider and the new text."""
    if operation not in OPERATIONS:
        raise ValueError(f"unknown operation {operation!r}")
    current = plan.filter(F.col("feature") == feature).select("idea").first()
    if operation == "add" and current is not None:
        raise ValueError(f"{feature} is already in use")
    if operation != "add" and current is None:
        raise ValueError(f"{feature} is not an existing feature")
    rest = plan.filter(F.col("feature") != feature)
    if operation == "remove":
        return rest
    idea = explanation if current is None else f"{current['idea']}\n---\n{explanation}"
    return rest.unionByName(new_rows.withColumn("idea", F.lit(idea)))


def slim_plan(plan: DataFrame) -> DataFrame:
    """Only what a researcher needs."""
    return plan.drop(*PLAN_ONLY_COLUMNS)


def plan_hash(plan: DataFrame, group: list[str] = ()) -> DataFrame:
    """SHA-256 of the canonical JSON of a plan, independent of row order, per group if asked."""
    row = encode_json(F.struct("feature", "sub", "type", "possible_values"))
    listed = F.array_sort(F.collect_list(row))
    return plan.groupBy(*group).agg(F.sha2(F.to_json(listed), 256).alias("plan_hash"))


def check_groups(groups: DataFrame, features: DataFrame) -> DataFrame:
    """One row: group and feature counts, features left out, and whether the grouping is sound.

    Sound means at least one group, as many entries as features, and none missing (so none twice).
    """
    wanted = features.select("feature").distinct()
    seen = groups.groupBy("feature").agg(F.count(F.lit(1)).alias("uses"))
    n_groups = groups.agg(F.count_distinct("group_no")).scalar()
    both = wanted.withColumn("wanted", F.lit(1)).join(seen, "feature", "full")
    counts = both.agg(
        F.coalesce(F.sum("uses"), F.lit(0)).alias("entries"),
        F.coalesce(F.sum("wanted"), F.lit(0)).alias("features"),
        F.count_if(F.col("uses").isNull()).alias("missing"),
    ).select(n_groups.alias("groups"), "*")
    sound = (F.col("groups") > 0) & (F.col("entries") == F.col("features")) & (F.col("missing") == 0)
    return counts.withColumn("sound", sound)
