"""Scalar rules on hand-written rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark import functions as tf


def one(spark, column, **values):
    """Evaluate a column on one row of string columns."""
    schema = ", ".join(f"{k} string" for k in values) or "x string"
    return spark.createDataFrame([tuple(values.values()) or ("",)], schema).select(column.alias("r")).first()["r"]


@pytest.mark.parametrize("text, expected", [
    ("2020-03-04", dt.date(2020, 3, 4)), ("2020-03", dt.date(2020, 3, 1)), ("2020", dt.date(2020, 1, 1)),
    ("2020-02-31", None), ("soon", None), (None, None),
])
def test_mixed_dates(spark, text, expected):
    assert one(spark, tf.parse_mixed_date(F.col("t")), t=text) == expected


def test_strict_dates_raise(spark):
    with pytest.raises(Exception, match="unreadable date"):
        one(spark, tf.parse_mixed_date(F.col("t"), strict=True), t="soon")
    assert one(spark, tf.parse_mixed_date(F.col("t"), strict=True), t=None) is None


@pytest.mark.parametrize("parts, expected", [
    (("2020", "5", "7"), dt.date(2020, 5, 7)), (("2020", "5", None), dt.date(2020, 5, 1)),
    (("2020", None, None), dt.date(2020, 1, 1)), (("2020", "2", "31"), None), (("2020", None, "3"), None),
    ((None, None, None), None),
])
def test_date_parts(spark, parts, expected):
    struct = F.struct(F.col("Year"), F.col("Month"), F.col("Day"))
    assert one(spark, tf.date_from_parts(struct), Year=parts[0], Month=parts[1], Day=parts[2]) == expected


@pytest.mark.parametrize("text, expected", [
    ("2020-05-06", "2020-05-06"), ("2020-05", "2020-05-01"), ("2020", "2020-01"), (None, None),
])
def test_padding(spark, text, expected):
    assert one(spark, tf.pad_start_date(F.col("t")), t=text) == expected


@pytest.mark.parametrize("text, expected", [
    (None, None), ("", None), ("plain", ["plain"]), ("['a', 'b']", ["a", "b"]), ('["it\'s"]', ["it's"]),
    ("['a \"b\"']", ['a "b"']), ("[None, 'None, x']", [None, "None, x"]), ("[]", []), ("['a'", None),
    (r"['it\'s']", ["it's"]),
])
def test_list_literals(spark, text, expected):
    assert one(spark, tf.parse_list_literal(F.col("t")), t=text) == expected


def test_nested_list_literals(spark):
    assert one(spark, tf.parse_nested_list_literal(F.col("t")), t="""["['A1', 'B2']", "['C3']"]""") == ["A1", "B2"]
    assert one(spark, tf.parse_nested_list_literal(F.col("t")), t="[]") is None


@pytest.mark.parametrize("text, expected", [
    ('"a"', "a"), ("'a'", "a"), ("\"'a'\"", "a"), ("'\"a\"'", '"a"'), ('"', ""), ('"a', '"a'), ("", ""), (None, None),
])
def test_strip_quotes(spark, text, expected):
    assert one(spark, tf.strip_quotes(F.col("t")), t=text) == expected


@pytest.mark.parametrize("text, expected", [
    ('"x"', "x"), ("null", "None"), ("true", "True"), ("5", "5"), ('["a","b"]', '["a","b"]'), ('"a\\"b"', 'a"b'),
])
def test_json_value_text(spark, text, expected):
    assert one(spark, tf.json_value_text(F.col("t")), t=text) == expected


def test_join_list_keeps_null(spark):
    assert one(spark, tf.join_list(F.lit(None).cast("array<string>"))) is None
    assert one(spark, tf.join_list(F.array(F.lit("a"), F.lit("b")))) == "a-b"


def test_min_date_skips_nulls(spark):
    none, day = F.lit(None).cast("date"), F.lit("2020-01-02").cast("date")
    assert one(spark, tf.min_date([none, day], [F.array(none, F.date_sub(day, 1))])) == dt.date(2020, 1, 1)
    assert one(spark, tf.min_date([none], [F.lit(None).cast("array<date>")])) is None


def test_document_text(spark):
    text = tf.document_text(F.col("t"), F.array(F.lit("a"), F.lit("b")), F.col("x"), F.col("y"))
    assert one(spark, text, t="T", x=None, y="body") == "# T\nTerms: a, b\n\nbody"
    assert one(spark, text, t=None, x="one", y="two") == "# \nTerms: a, b\n\none\n\ntwo"


def test_json_keeps_nulls_and_hash_ignores_order(spark):
    assert one(spark, tf.encode_json(F.struct(F.lit(None).cast("string").alias("a")))) == '{"a":null}'
    a, b = F.array(F.lit("x"), F.lit("y")), F.array(F.lit("y"), F.lit("x"))
    assert one(spark, tf.content_hash(a)) == one(spark, tf.content_hash(b))


def test_long_texts_do_not_overflow_the_stack(spark):
    from tidemark.operators import features

    long = "x" * 100_000
    items = "[" + ", ".join(["None", "'a\\'b'", '"c"'] + [f"'{i}'" for i in range(50_000)]) + "]"
    assert len(one(spark, tf.parse_list_literal(F.col("t")), t=items)) == 50_003
    assert one(spark, tf.parse_list_literal(F.col("t")), t=f"['{long}', None]") == [long, None]
    skeleton = features._skeleton(F.col("t"))
    assert one(spark, skeleton, t=f'["{long}", "{long}"]') == '["", ""]'
    many = "[" + ",".join(['"a"'] * 50_000) + "]"
    assert one(spark, skeleton.rlike(features.LIST_OF_STRINGS), t=many) is True


def test_number_patterns_do_not_end_before_a_newline(spark):
    from tidemark.functions.text import to_digits

    assert one(spark, to_digits(F.col("t")), t="5\n") is None
    assert one(spark, to_digits(F.col("t")), t="5") == 5.0
