"""Array expressions: joining, list literals, people lists, subset tests."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed value: a quoted item (single or double, with escapes) or a run without quotes. Possessive and unrolled:
# an alternation in a loop recurses once per character, which a long text turns into a stack overflow.
LITERAL_TOKENS = r"""(?s)'[^'\\]*+(?:\\.[^'\\]*+)*+'|"[^"\\]*+(?:\\.[^"\\]*+)*+"|[^'"]++|['"]"""

PYTHON_CONSTANTS = r"\b(?:None|nan|True|False)\b"

JSON_LENIENT = {"allowSingleQuotes": "true", "allowBackslashEscapingAnyCharacter": "true"}


def join_list(items: Column, separator: str = "-") -> Column:
    """Join with a separator; a null list stays null."""
    return F.array_join(items, separator)


def first_items(items: Column, n: int) -> Column:
    return F.slice(items, 1, n)


def _python_constants_to_json(text: Column) -> Column:
    """Rewrite None, nan, True and False outside quotes, so that the text reads as JSON."""

    def rewrite(token: Column) -> Column:
        plain = F.regexp_replace(token, r"\b(?:None|nan)\b", "null")
        plain = F.regexp_replace(plain, r"\bTrue\b", "true")
        plain = F.regexp_replace(plain, r"\bFalse\b", "false")
        return F.when(token.startswith("'") | token.startswith('"'), token).otherwise(plain)

    tokens = F.regexp_extract_all(text, F.lit(LITERAL_TOKENS), F.lit(0))
    rewritten = F.array_join(F.transform(tokens, rewrite), "")
    return F.when(text.rlike(PYTHON_CONSTANTS), rewritten).otherwise(text)


def json_from_literal(text: Column, schema: str) -> Column:
    """Parse a Python-style literal with ``from_json``; text is never run as code."""
    return F.from_json(_python_constants_to_json(text), schema, JSON_LENIENT)


def parse_list_literal(text: Column) -> Column:
    """Null stays null, ``[...]`` is parsed, any other text becomes a one-item list."""
    return (
        F.when(text.isNull() | (text == ""), None)
        .when(text.startswith("["), json_from_literal(text, "array<string>"))
        .otherwise(F.array(text))
    )


def parse_nested_list_literal(text: Column) -> Column:
    """A list whose first item is itself list text: parse, take the first, parse again."""
    return parse_list_literal(F.get(parse_list_literal(text), F.lit(0)))


def concat_people(nested: Column, flat: Column, item_type: str) -> Column:
    """Flatten the nested list one level, put the flat list after it, skip null and empty parts."""
    empty = F.array().cast(f"array<{item_type}>")
    inner = F.flatten(F.filter(nested, lambda x: x.isNotNull()))
    return F.concat(F.coalesce(inner, empty), F.coalesce(flat, empty))


def is_subset(values: Column, allowed: Column) -> Column:
    return F.size(F.array_except(values, allowed)) == 0
