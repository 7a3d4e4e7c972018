"""Design matrices of plans of any size: values stay long, meet their positions in a join, and become sparse vectors.

The wide form (``features.to_wide`` and ``features.design_matrix``) has a column per sub-feature, so its plan has to
stay small. Here the plan is a table of inputs, and neither plans nor vectors are expanded: work and memory follow
the values that are there.
"""

from __future__ import annotations

from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame, functions as F, types as T

from tidemark.operators.topk import rank_per_key
from tidemark.plans.feature_plan import VALUED_TYPES
from tidemark.session import materialize

INPUT_KEY = ["feature", "sub", "kind", "value"]


def input_table(plan: DataFrame, model: str = "lr", skip: list[str] = ()) -> DataFrame:
    """One row per model input: feature, sub, kind (``number``, ``gap`` or ``value``), value, name, position (from 0).

    Positions follow the plan's order by (group, feature, sub) and a sub-feature's declared values, as those of
    ``features.design_matrix`` do; numbers of boosted trees are followed by a gap indicator. Rows are numbered range by
    range and the table is stored, so plans of any size spread over tasks. A null group comes first, a sub-feature
    without a type counts as a number, declared values that repeat are inputs each, and an empty plan has none.
    """
    number = [("number", ""), ("gap", "=missing")] if model == "xgb" else [("number", "")]
    numbers = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit("").alias("value"), F.lit(end).alias("ending")) for k, end in number])
    values = F.transform(
        F.coalesce("possible_values", F.array().cast("array<string>")),
        lambda v: F.struct(F.lit("value").alias("kind"), v.alias("value"), F.concat(F.lit("="), v).alias("ending")))
    kept = plan.filter(~F.col("feature").isin(list(skip))) if skip else plan
    inputs = kept.select(
        F.coalesce("group_no", F.lit(-1)).alias("group_no"), "feature", "sub",
        F.posexplode(F.when(F.col("type").isin(VALUED_TYPES), values).otherwise(numbers)).alias("place", "i"))
    order = [F.asc("group_no"), F.asc("feature"), F.asc("sub"), F.asc("place")]
    ranked = rank_per_key(inputs.withColumn("all", F.lit(0)), ["all"], order, "position")
    return materialize(ranked.select(
        "feature", "sub", "i.kind", "i.value", F.concat("feature", F.lit("--"), "sub", "i.ending").alias("name"),
        (F.col("position") - 1).alias("position")), "inputs")


def entries(values: DataFrame, inputs: DataFrame) -> DataFrame:
    """Rows (id, position, x) of typed values (id, feature, sub, num, txt, items): what is not zero.

    Repeats of a sub-feature are reduced to their greatest value, as in the wide form. A null, an unknown category or
    a sub-feature outside the plan gives no entry; items of a list count as often as they occur. Each record
    without any entry keeps one row with a null position. ``inputs`` is joined by whichever way its size asks for.
    """
    one = values.groupBy("id", "feature", "sub").agg(*[F.max(c).alias(c) for c in ("num", "txt", "items")])

    def entry(kind: str, value, x):
        return F.struct(F.lit(kind).alias("kind"), value.alias("value"), x.cast("double").alias("x"))

    number = F.when(F.col("num").isNotNull(), F.array(
        entry("number", F.lit(""), F.col("num")), entry("gap", F.lit(""), F.lit(1.0))))
    category = F.when(F.col("txt").isNotNull(), F.array(entry("value", F.col("txt"), F.lit(1.0))))
    items = F.transform(F.array_distinct("items"), lambda v: entry(
        "value", v, F.size(F.filter("items", lambda x: x == v))))
    found = F.flatten(F.array_compact(F.array(number, category, items)))
    long = one.select("id", "feature", "sub", F.explode_outer(found).alias("e")).select("id", "feature", "sub", "e.*")
    placed = long.join(inputs.select(*INPUT_KEY, "position"), INPUT_KEY, "left")
    return placed.select("id", F.when((F.col("x") != 0) | (F.col("kind") == "gap"), F.col("position")).alias("position"), "kind", "x")


def sparse_matrix(values: DataFrame, inputs: DataFrame) -> DataFrame:
    """One row per record with its sparse ``features`` vector, of as many places as there are inputs.

    Equal to the vector of ``features.design_matrix`` for records that have values; a record without usable values
    has an empty vector. Gap indicators are 1 wherever no value came, so they make vectors as long as the plan has
    numbers: only boosted trees ask for them. Vectors are made by expressions, without Python.
    """
    size = inputs.agg(F.count(F.lit(1)).cast("int")).scalar()
    listed = F.collect_list(F.when(
        F.col("position").isNotNull() & (F.col("kind") != "gap"), F.struct("position", "x")))
    came = F.collect_list(F.when(F.col("kind") == "gap", F.col("position")))
    rows = entries(values, inputs).groupBy("id").agg(listed.alias("listed"), came.alias("came"))
    gaps = inputs.agg(F.collect_list(F.when(F.col("kind") == "gap", F.col("position")))).scalar()
    rows = rows.select("id", "listed", "came", gaps.alias("gaps"), size.alias("size"))
    absent = F.transform(F.array_except("gaps", "came"), lambda p: F.struct(p.alias("position"), F.lit(1.0).alias("x")))
    rows = rows.select("id", F.array_sort(F.concat("listed", absent)).alias("all"), "size")
    # A vector is stored as (type, size, indices, values); reading it from JSON gives the column the vector type.
    parts = F.struct(F.struct(
        F.lit(0).alias("type"), "size", F.col("all.position").alias("indices"), F.col("all.x").alias("values")).alias("features"))
    schema = T.StructType([T.StructField("features", VectorUDT())])
    return rows.select("id", F.from_json(F.to_json(parts), schema)["features"].alias("features"))
