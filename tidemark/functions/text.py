"""Lenient and strict text parsing as the request rules define it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The accepted shapes. ``\z`` is the very end; ``$`` would allow a line break.
DEVICE_PATTERN = r"^[a-zA-Z0-9_-]{1,50}\z"
TYPE_PATTERN = r"^[a-zA-Z0-9]{1,30}\z"
INTEGER_PATTERN = r"^[+-]?[0-9]+\z"
LEADING_INTEGER = r"^[ \t]*([+-]?[0-9]+)"
RFC3339_PATTERN = (
    r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{1,2}:[0-9]{2}:[0-9]{2}([.,][0-9]+)?"
    r"(Z|[+-][0-9]{2}:[0-9]{2})\z"
)


def matches(text: Column, pattern: str) -> Column:
    return F.regexp_like(text, F.lit(pattern))


def strict_long(text: Column) -> Column:
    """A whole signed integer, or null; blanks around it are not accepted."""
    return F.when(matches(text, INTEGER_PATTERN), text.try_cast("bigint"))


def leading_long(text: Column, default: int) -> Column:
    """The integer the text starts with; ``default`` when there is none or it overflows."""
    digits = F.regexp_extract(F.coalesce(text, F.lit("")), LEADING_INTEGER, 1)
    return F.coalesce(digits.try_cast("bigint"), F.lit(default).cast("bigint"))


def rfc3339(text: Column) -> Column:
    """The instant of a full date-time with zone, or null."""
    return F.when(
        matches(text, RFC3339_PATTERN), F.try_to_timestamp(F.translate(text, ",", "."))
    )


def rfc3339_text(ts: Column) -> Column:
    """UTC text with the fraction only as long as needed."""
    fraction = F.rtrim(F.date_format(ts, "SSSSSS"), F.lit("0"))
    return F.concat(
        F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"),
        F.when(fraction == "", "").otherwise(F.concat(F.lit("."), fraction)),
        F.lit("Z"),
    )
