"""Text expressions: trimming, title case, redaction and search tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values -----------------------------------------------------------
# Characters counted as blank when text is trimmed.
BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# The same characters as a regular-expression class.
BLANK_CLASS = (
    r"[\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
UK_PHONE = rf"(?:\+44{BLANK_CLASS}?|0)(?:\p{{Nd}}{BLANK_CLASS}?){{9,10}}"
TOKEN = "([a-z0-9£]+)"
STOP_WORDS = (
    "a an and are as at be by for from has have how i in is it of on or our that the this to we "
    "what when which who will with you your do does should"
).split()
MIN_STEM = 4
# ----------------------------------------------------------------------------

# An address can only begin where its leading run of characters begins, or right
# where the last match ended. Saying so keeps long unbroken runs linear.
_EMAIL_AT_RUN_START = rf"(?:(?<![A-Za-z0-9._%+-])|\G){EMAIL}"


def strip(text: Column) -> Column:
    """Trim every kind of blank from both ends, not only spaces."""
    return F.trim(text, F.lit(BLANKS))


def title_case(text: Column) -> Column:
    """Trim, then capitalise each run of letters ("o-neil" becomes "O-Neil")."""
    runs = F.regexp_extract_all(F.lower(strip(text)), F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(F.transform(runs, F.initcap), "")


def redact(text: Column) -> Column:
    """Mask e-mail addresses first, then UK telephone numbers."""
    masked = F.when(
        F.contains(text, F.lit("@")), F.regexp_replace(text, _EMAIL_AT_RUN_START, "[EMAIL]")
    ).otherwise(text)
    return F.regexp_replace(masked, UK_PHONE, "[PHONE]")


def raw_tokens(text: Column) -> Column:
    """All lower-case word tokens of a text, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(1))


def _without(token: Column, suffix: str) -> tuple[Column, Column]:
    """Whether a suffix fits and leaves a long enough word, and that word."""
    left = F.length(token) - F.lit(len(suffix))
    return token.endswith(suffix) & (left >= MIN_STEM), F.substring(token, F.lit(1), left)


def stem(token: Column) -> Column:
    """Take off "ing", else "es", else "s" (but not of "ss"), where enough is left.

    Most words end in neither s nor g and are through after two looks at their end.
    """
    plural = F.when(*_without(token, "es")).when(*_without(token, "s")).otherwise(token)
    return (
        F.when(token.endswith("s"), F.when(token.endswith("ss"), token).otherwise(plural))
        .when(*_without(token, "ing"))
        .otherwise(token)
    )


def search_tokens(text: Column) -> Column:
    """Tokens without stop words, stemmed; repeats and order are kept."""
    kept = F.filter(raw_tokens(text), lambda t: ~t.isin(STOP_WORDS))
    return F.transform(kept, stem)
