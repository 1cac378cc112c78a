"""The one customer key that every source is mapped to."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyhouse.functions.text import strip

KEY_PREFIX = "C-"
KEY_DIGITS = 4


def canonical_key(raw: Column, pattern: str) -> Column:
    """Map a source's own key text to "C-0007"; NULL where the pattern does not match.

    The digits are handled as text, so a key of any length keeps all its digits.
    """
    number = F.regexp_extract(strip(raw.cast("string")), f"^(?:{pattern})", 1)
    padded = F.concat(F.lit("0" * KEY_DIGITS), F.nullif(number, F.lit("")))
    spare_zeros = f"^0+(?=.{{{KEY_DIGITS}}})"
    return F.concat(F.lit(KEY_PREFIX), F.regexp_replace(padded, spare_zeros, ""))
