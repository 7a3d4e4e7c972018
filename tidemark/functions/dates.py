"""Date expressions: mixed precision, split parts, padding and minima."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The three precisions a registry date comes in.
MIXED_DATE_FORMATS = ["yyyy-MM-dd", "yyyy-MM", "yyyy"]


def parse_mixed_date(text: Column, strict: bool = False) -> Column:
    """Day, month or year precision text to a date; unreadable text is null, or an error if strict."""
    parsed = F.coalesce(*[F.try_to_date(text, fmt) for fmt in MIXED_DATE_FORMATS])
    if not strict:
        return parsed
    message = F.concat(F.lit("unreadable date: "), text)
    return F.when(text.isNotNull() & parsed.isNull(), F.raise_error(message).cast("date")).otherwise(parsed)


def date_from_parts(parts: Column, year: str = "Year", month: str = "Month", day: str = "Day") -> Column:
    """Date from a struct of text parts; a missing day or month counts as the first."""
    y, m, d = parts[year], parts[month], parts[day]
    text = F.concat_ws("-", y, F.coalesce(m, F.lit("1")), F.coalesce(d, F.lit("1")))
    usable = y.isNotNull() & (m.isNotNull() | d.isNull())
    return F.when(usable, F.try_to_date(text, "yyyy-M-d"))


def format_day(value: Column) -> Column:
    return F.date_format(value.cast("date"), "yyyy-MM-dd")


def year_text(value: Column) -> Column:
    return F.year(value).cast("string")


def pad_start_date(text: Column) -> Column:
    """Short dates get ``-01`` once, and stay text that compares by characters."""
    return F.when(F.length(text) < 10, F.concat(text, F.lit("-01"))).otherwise(text)


def min_date(singles: list[Column], lists: list[Column] = ()) -> Column:
    """Earliest date among single columns and date arrays, nulls skipped."""
    parts = [F.array(*singles)] if singles else []
    parts += [F.coalesce(c, F.array().cast("array<date>")) for c in lists]
    return F.array_min(F.concat(*parts))
