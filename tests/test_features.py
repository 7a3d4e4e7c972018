"""Value rules, merging and encoding on small fixtures."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import features as ops
from tidemark.plans import feature_plan as plans

PLAN = [
    {"group_no": 0, "feature": "f", "sub": "b", "type": "boolean"},
    {"group_no": 0, "feature": "f", "sub": "i", "type": "integer"},
    {"group_no": 0, "feature": "f", "sub": "x", "type": "float"},
    {"group_no": 0, "feature": "f", "sub": "c", "type": "categorical", "possible_values": ["a", "None", "b"]},
    {"group_no": 0, "feature": "f", "sub": "m", "type": "multi-categorical", "possible_values": ["a", "b", "None"]},
]
SCHEMA = "id string, group_no int, feature string, sub string, raw string"


@pytest.fixture(scope="module")
def plan(spark):
    return plans.plan_table(spark, PLAN)


def coerced(spark, plan, rows, strict=False, **options):
    values = spark.createDataFrame(rows, SCHEMA)
    out = ops.coerce_strict(values, plan) if strict else ops.coerce(values, plan, **options)
    return {(r["id"], r["feature"], r["sub"]): r for r in out.collect()}


CASES = [
    ("b", "True", 1.0), ("b", '"false"', 0.0), ("b", "'TRUE'", 1.0), ("b", "yes", None), ("b", "None", None),
    ("i", "5", 5.0), ("i", "-3", None), ("i", "5.0", None), ("i", "none", None), ("i", "²", None),
    ("x", "5.0", 5.0), ("x", "-0.25", -0.25), ("x", "5", None), ("x", "1e3", None),
    ("c", "a", "a"), ("c", "A", None), ("c", "None", None), ("c", "'b'", "b"),
    ("m", '["a","b","a"]', ["a", "b", "a"]), ("m", "[]", []), ("m", '["None"]', None), ("m", "[null]", None),
    ("m", '["a", "zzz"]', None), ("m", '["a"', None), ("m", '[1]', None), ("m", '"a"', None), ("m", '["a", "None"]', ["a", "None"]),
]


def test_single_value_rules(spark, plan):
    rows = [(str(i), 0, "f", sub, raw) for i, (sub, raw, _) in enumerate(CASES)]
    out = coerced(spark, plan, rows)
    assert len(out) == len(CASES)
    for i, (sub, raw, expected) in enumerate(CASES):
        row = out[(str(i), "f", sub)]
        value = row["items"] if sub == "m" else row["txt"] if sub == "c" else row["num"]
        assert value == expected, (sub, raw)


def test_group_failures(spark, plan):
    rows = [
        ("unknown", 0, "f", "b", "True"), ("unknown", 0, "f", "zzz", "1"),
        ("nested", 0, "f", "i", "5"), ("nested", 0, "f", "m", '["a", ["b"]]'),
        ("object", 0, "f", "m", '[{"a": 1}]'), ("text", 0, "f", "m", '["[{", "a"]'),
        ("absent", 0, "other", "b", "True"), ("empty", 0, "f", None, None), ("some", 0, "f", "i", "7"),
    ]
    out = coerced(spark, plan, rows)
    for failed in ("unknown", "nested", "object", "absent", "empty"):
        subs = {k[2]: r for k, r in out.items() if k[0] == failed}
        assert set(subs) == {"b", "i", "x", "c", "m"}, failed
        assert all(r["num"] is None and r["txt"] is None and r["items"] is None for r in subs.values())
    assert {k[2] for k in out if k[0] == "some"} == {"i"}
    assert {k[2] for k in out if k[0] == "text"} == {"m"}

    kept = coerced(spark, plan, rows[:2], on_unknown_key="drop")
    assert set(kept) == {("unknown", "f", "b")} and kept[("unknown", "f", "b")]["num"] == 1.0


def test_lenient_float(spark, plan):
    out = coerced(spark, plan, [("1", 0, "f", "x", "5"), ("2", 0, "f", "x", "1e3")], lenient_float=True)
    assert sorted(r["num"] for r in out.values()) == [5.0, 1000.0]


def test_strict_fails_the_feature(spark, plan):
    rows = [
        ("ok", 0, "f", "b", "True"), ("ok", 0, "f", "i", "None"), ("ok", 0, "f", "m", '["a"]'),
        ("case", 0, "f", "b", "true"), ("case", 0, "f", "i", "5"), ("key", 0, "f", "zzz", "1"), ("key", 0, "f", "i", "5"),
    ]
    out = coerced(spark, plan, rows, strict=True)
    assert out[("ok", "f", "b")]["num"] == 1.0 and out[("ok", "f", "i")]["num"] is None
    assert out[("ok", "f", "m")]["txt"] == '["a"]'
    for failed in ("case", "key"):
        assert {k[2] for k in out if k[0] == failed} == {"b", "i", "x", "c", "m"}
        assert all(r["num"] is None and r["txt"] is None for k, r in out.items() if k[0] == failed)


def test_repeated_values_do_not_grow(spark, plan):
    """One (record, group) with very many copies comes out once per sub-feature."""
    values = spark.range(50_000).select(
        F.lit("hot").alias("id"), F.lit(0).alias("group_no"), F.lit("f").alias("feature"), F.lit("i").alias("sub"), F.lit("4").alias("raw")
    )
    assert [r["num"] for r in ops.coerce(values, plan).collect()] == [4.0]


def test_wide_and_encoding(spark, plan):
    subs = plans.collect_plan(plan)
    values = ops.coerce(spark.createDataFrame(
        [("1", 0, "f", "c", "b"), ("1", 0, "f", "m", '["a","a"]'), ("2", 0, "f", "i", "3")], SCHEMA), plan)
    wide = ops.to_wide(values, subs)
    assert wide.columns == ["id"] + sorted(f"f--{s}" for s in "bcimx")
    matrix, names = ops.design_matrix(wide, subs, "lr")
    got = {r["id"]: dict(zip(names, r["features"].toArray())) for r in matrix.collect()}
    assert got["1"]["f--c=b"] == 1.0 and got["1"]["f--m=a"] == 2.0 and got["1"]["f--i"] == 0.0
    assert got["2"]["f--i"] == 3.0 and got["2"]["f--m=a"] == 0.0
    _, boosted = ops.design_matrix(wide, subs, "xgb")
    assert "f--i=missing" in boosted
    with pytest.raises(ValueError, match="missing from the feature table"):
        ops.design_matrix(wide.drop("f--i"), subs, "lr")
    assert ops.design_matrix(wide.drop("f--i"), [s for s in subs if s.sub != "i"], "lr")[1]


def test_fail_soft(spark):
    subs = [plans.SubFeature(0, "a", "x", "integer", ()), plans.SubFeature(1, "b", "y", "integer", ())]

    def fn(record, group):
        if group == 1 and record["id"] == 2:
            raise ValueError("bad")
        return ({"a": {"x": "1"}}, {}) if group == 0 else ({"b": {}}, {"b": "none found"})

    ids = spark.createDataFrame([(1,), (2,)], "id bigint")
    out = {(r["id"], r["feature"]): r for r in ops.apply_groups(ops.cross_groups(ids, subs), subs, fn).collect()}
    assert out[(1, "a")]["raw"] == "1" and out[(1, "b")]["sub"] is None and out[(1, "b")]["reason"] == "none found"
    assert out[(2, "b")]["ok"] is False and out[(2, "b")]["raw"] is None and out[(2, "b")]["sub"] == "y"


def test_plan_edits(spark, plan):
    new = plans.plan_table(spark, [{"group_no": 1, "feature": "g", "sub": "z", "type": "float"}]).drop("idea")
    assert plans.apply_op(plan, "add", "g", "try", new).filter("feature = 'g'").first()["idea"] == "try"
    with pytest.raises(ValueError, match="already in use"):
        plans.apply_op(plan, "add", "f", "try", new)
    with pytest.raises(ValueError, match="not an existing"):
        plans.apply_op(plan, "remove", "g")
    checked = plans.check_plan(plan.select("feature", "sub", "type"), plan.select("feature", "sub", "possible_values"))
    assert plans.require_sound(checked).count() == 5
    broken = plans.check_plan(plan.select("feature", "sub", "type"), plan.filter("sub <> 'c'").select("feature", "sub", "possible_values"))
    with pytest.raises(ValueError, match="categorical without values"):
        plans.require_sound(broken)


def test_good_grouping(spark, plan):
    groups = spark.createDataFrame([(0, "f"), (1, "g")], "group_no int, feature string")
    features = spark.createDataFrame([("f",), ("g",)], "feature string")
    assert plans.check_groups(groups, features).first()["sound"] is True
    assert plans.check_groups(groups.limit(0), features).first()["sound"] is False


def test_apply_groups_survives_any_output(spark):
    from tidemark.operators.features import apply_groups
    from tidemark.plans.feature_plan import SubFeature

    plan = [SubFeature(0, "f", "s", "integer", ())]
    answers = {0: {"f": {"s": 5}}, 1: {"f": {"s": [1, "b"]}}, 2: {"f": {"s": None}}, 3: {"f": None}, 4: None,
               5: {"f": {"s": {1, 2}.__class__}}, 6: {"f": {"s": True}}}

    def fn(record, group):
        if record["id"] == 7:
            raise ValueError("no answer")
        return answers[record["id"]], {}

    pairs = spark.createDataFrame([(i, 0) for i in range(8)], "id long, group_no int")
    rows = {r["id"]: (r["raw"], r["ok"]) for r in apply_groups(pairs, plan, fn).collect()}
    assert rows[0] == ("5", True) and rows[1] == ('[1, "b"]', True) and rows[2] == ("None", True)
    assert rows[3] == rows[4] == rows[7] == (None, False)
    assert rows[6] == ("True", True) and rows[5][1] is True
