"""The long design matrix against the wide one, plans beyond the wide bound, and odd rows."""

import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tidemark.operators import features as ops, long_matrix
from tidemark.plans import feature_plan as plans
from tidemark.queries import features as queries

VALUES = "id long, feature string, sub string, num double, txt string, items array<string>"


def large_plan(spark, n):
    return spark.range(n).select(
        F.lit(0).alias("group_no"), F.concat(F.lit("f"), F.col("id") % 100).alias("feature"),
        F.col("id").cast("string").alias("sub"), F.lit("float").alias("type"),
        F.lit(None).cast("array<string>").alias("possible_values"))


@pytest.mark.parametrize("kind", ["lr", "xgb"])
def test_equal_to_the_wide_form(spark, sf_dir, kind):
    plan, values = queries.plan(spark), queries.coerced(spark, sf_dir)
    subs = plans.collect_plan(plan)
    wide, names = ops.design_matrix(ops.to_wide(values, subs), subs, kind, skip=["density"])
    inputs = long_matrix.input_table(plan, kind, skip=["density"])
    assert [r["name"] for r in inputs.orderBy("position").collect()] == names
    matrix = long_matrix.sparse_matrix(values, inputs)

    def rows(df):
        return {r["id"]: list(r["x"]) for r in df.select("id", vector_to_array("features").alias("x")).collect()}

    assert rows(matrix) == rows(wide)


def test_large_plan_trains_and_is_sparse(spark):
    inputs = long_matrix.input_table(large_plan(spark, 100_000))
    assert inputs.count() == 100_000
    places = inputs.agg(F.min("position"), F.max("position"), F.count_distinct("position")).first()
    assert tuple(places) == (0, 99_999, 100_000)
    i = F.col("id")
    none = F.lit(None)
    values = spark.range(200).select(i, F.explode(F.array(i, i % 2, i + 50_000)).alias("at")).select(
        "id", F.concat(F.lit("f"), F.col("at") % 100).alias("feature"), F.col("at").cast("string").alias("sub"),
        F.lit(2.0).alias("num"), none.cast("string").alias("txt"), none.cast("array<string>").alias("items"))
    matrix = long_matrix.sparse_matrix(values, inputs).withColumn("label", (F.col("id") % 2).cast("double"))
    vector = matrix.filter("id = 7").first()["features"]
    assert vector.size == 100_000 and sorted(vector.values) == [2.0] * 3
    model = LogisticRegression(maxIter=10, regParam=0.01).fit(matrix)
    assert model.transform(matrix).filter("prediction = label").count() == 200


def test_wide_form_refuses_and_checks_take_large_plans(spark):
    plan = large_plan(spark, plans.MAX_PLAN_ROWS + 1)
    with pytest.raises(ValueError, match="long_matrix"):
        plans.collect_plan(plan)
    one = plan.filter("feature = 'f1'").withColumn("group_no", F.lit(1))
    plan = plan.filter("feature <> 'f1'").unionByName(one)
    raw = spark.createDataFrame([("a", 1, "f1", "101", "5.5"), ("a", 1, "f1", "1", "x")],
                                "id string, group_no int, feature string, sub string, raw string")
    found = {r["sub"]: r["num"] for r in ops.coerce(raw, plan).collect()}
    assert found == {"101": 5.5, "1": None}
    strict = ops.coerce_strict(raw, plan).collect()
    assert len(strict) == 0 or all(r["num"] is None for r in strict)


def test_odd_rows(spark):
    plan = plans.plan_table(spark, [
        {"group_no": 0, "feature": "f", "sub": "c", "type": "categorical", "possible_values": ["a", "b"]},
        {"group_no": 0, "feature": "f", "sub": "m", "type": "multi-categorical", "possible_values": ["x", "y"]},
        {"group_no": None, "feature": "z", "sub": "n", "type": "float"}])
    inputs = long_matrix.input_table(plan)
    assert [r["name"] for r in inputs.orderBy("position").collect()] == ["z--n", "f--c=a", "f--c=b", "f--m=x", "f--m=y"]
    values = spark.createDataFrame([
        (1, "f", "c", None, "b", None), (1, "f", "m", None, None, ["y", "x", "y"]), (1, "z", "n", 1.5, None, None),
        (1, "z", "n", 0.5, None, None), (2, "f", "c", None, "unknown", None), (3, "gone", "n", 4.0, None, None),
        (4, "z", "n", 0.0, None, None), (5, "f", "m", None, None, []), (None, "z", "n", 2.0, None, None)], VALUES)
    found = {r["id"]: (r["features"].size, list(r["features"].toArray())) for r in long_matrix.sparse_matrix(values, inputs).collect()}
    nothing = (5, [0.0] * 5)
    assert found == {1: (5, [1.5, 0.0, 1.0, 1.0, 2.0]), 2: nothing, 3: nothing, 4: nothing, 5: nothing, None: (5, [2.0, 0, 0, 0, 0])}
    assert long_matrix.input_table(plan.limit(0)).count() == 0
    assert long_matrix.sparse_matrix(values.limit(0), inputs).count() == 0
