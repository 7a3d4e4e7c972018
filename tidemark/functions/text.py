"""Text and JSON expressions, and the single-value coercions used by feature checks."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The text patterns of the coercion and token rules.
TOKEN_PATTERN = r"\p{L}+"
DIGITS_PATTERN = r"^[0-9]+\z"
FLOAT_PATTERN = r"^-?[0-9]+\.[0-9]+\z"
LENIENT_FLOAT_PATTERN = r"^[-+]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][-+]?[0-9]+)?\z"

REPLY_SCHEMA = (
    "university array<string>, institutes array<string>, companies array<string>, "
    "countries array<string>, _corrupt_record string"
)


def document_text(title: Column, terms: Column, *bodies: Column, label: str = "Terms") -> Column:
    """Title line, term line, then bodies separated by blank lines; missing parts print as empty."""
    body = F.concat_ws("\n\n", *bodies)
    return F.concat(
        F.lit("# "), F.coalesce(title, F.lit("")),
        F.lit(f"\n{label}: "), F.coalesce(F.array_join(terms, ", "), F.lit("")),
        F.lit("\n\n"), body,
    )


def is_missing(value: Column, floating: bool = False) -> Column:
    return (value.isNull() | F.isnan(value)) if floating else value.isNull()


def encode_json(value: Column) -> Column:
    """JSON text that keeps null fields."""
    return F.to_json(value, {"ignoreNullFields": "false"})


def decode_json(text: Column, schema: str) -> Column:
    return F.from_json(text, schema)


def content_hash(items: Column) -> Column:
    """SHA-256 of the canonical JSON of a list: the items sorted, nothing else."""
    return F.sha2(F.to_json(F.array_sort(items)), 256)


def strip_quotes(text: Column) -> Column:
    """Take off one layer of double quotes, then one layer of single quotes."""
    for quote in ('"', "'"):
        inner = F.substring(text, F.lit(2), F.greatest(F.length(text) - 2, F.lit(0)))
        text = F.when(text.startswith(quote) & text.endswith(quote), inner).otherwise(text)
    return text


def to_boolean(text: Column, case_sensitive: bool = False) -> Column:
    """1.0 or 0.0 for the boolean words, null for anything else."""
    word = text if case_sensitive else F.lower(text)
    yes, no = ("True", "False") if case_sensitive else ("true", "false")
    return F.when(word == yes, F.lit(1.0)).when(word == no, F.lit(0.0))


def to_digits(text: Column) -> Column:
    """Unsigned digits only, as a double."""
    return F.when(text.rlike(DIGITS_PATTERN), text.try_cast("double"))


def to_float(text: Column, lenient: bool = False) -> Column:
    """A decimal point is required unless ``lenient``."""
    return F.when(text.rlike(LENIENT_FLOAT_PATTERN if lenient else FLOAT_PATTERN), text.try_cast("double"))


def tokenize(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN_PATTERN), F.lit(0))


def approx_tokens(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(TOKEN_PATTERN), F.lit(0)))


def json_value_text(value: Column) -> Column:
    """Text form of one JSON value: strings bare, lists as JSON, null as ``None``, booleans capitalised."""
    return (
        F.when(value == "null", F.lit("None"))
        .when(value == "true", F.lit("True"))
        .when(value == "false", F.lit("False"))
        .when(value.startswith('"'), F.from_json(F.concat(F.lit('{"v":'), value, F.lit("}")), "v string")["v"])
        .otherwise(value)
    )


def parse_reply(text: Column) -> Column:
    """Reply JSON to the declared struct; unreadable replies land in ``_corrupt_record``."""
    return F.from_json(text, REPLY_SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
