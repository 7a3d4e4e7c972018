"""Recursive text chunking as array expressions, so that it stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Where a piece that is too long is cut, coarsest first, and the text each cut needs.
# Separators stay on the left.
SPLIT_LEVELS = [
    (r"(?s).+?(?:\n\n+|\z)", "\n\n"),
    (r"[^\n]*\n+|[^\n]+", "\n"),
    (r"(?s).+?(?:[.!?] |\z)", " "),
    (r"[^ ]* +|[^ ]+", " "),
]
DEFAULT_MAX_CHARS = 2048


def _cut_long(pieces: Column, pattern: str, max_chars: int, needs: str = "") -> Column:
    """Cut pieces that are too long; ``needs`` is text without which the pattern cannot cut."""

    def cut(piece: Column) -> Column:
        whole = F.length(piece) <= max_chars
        if needs:
            whole = whole | ~piece.contains(needs)
        parts = F.regexp_extract_all(piece, F.lit(pattern), F.lit(0))
        return F.when(whole, F.array(piece)).otherwise(parts)

    return F.flatten(F.transform(pieces, cut))


def _pieces(text: Column, max_chars: int) -> Column:
    """Cut only what is longer than ``max_chars``, one level after another, at last by length."""
    pieces = F.array(text)
    for pattern, needs in SPLIT_LEVELS:
        pieces = _cut_long(pieces, pattern, max_chars, needs)
    return _cut_long(pieces, rf"(?s).{{1,{max_chars}}}", max_chars)


def chunk_array(text: Column, max_chars: int = DEFAULT_MAX_CHARS) -> Column:
    """Chunks of at most ``max_chars`` characters that join back to exactly the text.

    Neighbouring pieces are joined greedily. Null or empty text has no chunks.
    """

    def state(done: Column, open_: Column, size: Column) -> Column:
        return F.struct(done.alias("done"), open_.alias("open"), size.alias("size"))

    def grow(acc: Column, piece: Column) -> Column:
        size = acc["size"] + F.length(piece)
        return F.when(
            (size <= max_chars) | (acc["size"] == 0),
            state(acc["done"], F.concat(acc["open"], piece), size),
        ).otherwise(state(F.array_append(acc["done"], acc["open"]), piece, F.length(piece)))

    def close(acc: Column) -> Column:
        return F.array_append(acc["done"], acc["open"])

    start = state(F.array().cast("array<string>"), F.lit(""), F.lit(0))
    return (
        F.when(text.isNull() | (text == ""), F.array().cast("array<string>"))
        .when(F.length(text) <= max_chars, F.array(text))
        .otherwise(F.aggregate(_pieces(text, max_chars), start, grow, close))
    )


def chunk(df: DataFrame, text: str, max_chars: int = DEFAULT_MAX_CHARS) -> DataFrame:
    """One row per chunk with ``chunk_no`` from 0 and ``chunk``; all other columns are kept."""
    rest = [c for c in df.columns if c != text]
    return df.select(*rest, F.posexplode(chunk_array(F.col(text), max_chars)).alias("chunk_no", "chunk"))
