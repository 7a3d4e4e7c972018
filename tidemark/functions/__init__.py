from tidemark.functions.dates import (
    date_from_parts,
    format_day,
    min_date,
    pad_start_date,
    parse_mixed_date,
    year_text,
)
from tidemark.functions.lists import (
    concat_people,
    first_items,
    is_subset,
    join_list,
    parse_list_literal,
    parse_nested_list_literal,
)
from tidemark.functions.text import (
    approx_tokens,
    content_hash,
    decode_json,
    document_text,
    encode_json,
    is_missing,
    json_value_text,
    parse_reply,
    strip_quotes,
    to_boolean,
    to_digits,
    to_float,
    tokenize,
)

__all__ = [
    "approx_tokens", "concat_people", "content_hash", "date_from_parts", "decode_json",
    "document_text", "encode_json", "first_items", "format_day", "is_missing", "is_subset",
    "join_list", "json_value_text", "min_date", "pad_start_date", "parse_list_literal",
    "parse_mixed_date", "parse_nested_list_literal", "parse_reply", "strip_quotes", "to_boolean",
    "to_digits", "to_float", "tokenize", "year_text",
]
