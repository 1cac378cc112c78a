"""Typed parsing of source text. A value that cannot be read becomes NULL, never an error."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyhouse.functions.text import BLANK_CLASS, strip, title_case

# strptime directive -> (Spark pattern letter(s), accepted text)
_DIRECTIVES = {
    "%Y": ("yyyy", "[0-9]{4}"),
    "%m": ("M", "[0-9]{1,2}"),
    "%d": ("d", "[0-9]{1,2}"),
    "%H": ("H", "[0-9]{1,2}"),
    "%M": ("m", "[0-9]{1,2}"),
    "%S": ("s", "[0-9]{1,2}"),
}
_NUMBER = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"
_MONEY_NOISE = rf"[£,]|{BLANK_CLASS}"
_LONG_LIMIT = 2.0**63
# Money is added up as decimal(24,6); an amount that does not fit is reported as unreadable.
MONEY_LIMIT = 1e18


def _date_pattern(fmt: str) -> tuple[str, str]:
    """Spark datetime pattern, and the shape the text must have, for a strptime format."""
    spark, shape = "", ""
    for piece in re.findall(r"%.|[^%]+", fmt):
        if piece in _DIRECTIVES:
            letters, accepted = _DIRECTIVES[piece]
            spark, shape = spark + letters, shape + accepted
        elif piece.startswith("%"):
            raise ValueError(f"Unsupported date directive {piece} in {fmt!r}")
        else:
            spark += re.sub("([A-Za-z]+)", r"'\1'", piece)
            shape += re.escape(piece)
    return spark, f"^{shape}$"


def _date(text: Column, spec: dict) -> Column:
    pattern, shape = _date_pattern(spec["format"])
    return F.when(text.rlike(shape), F.try_to_date(text, pattern))


def _datetime(text: Column, spec: dict) -> Column:
    """Read as UTC and counted from the epoch, so no session time zone can move a local time."""
    pattern, shape = _date_pattern(spec["format"])
    in_utc = F.try_to_timestamp(F.concat(text, F.lit(" +0000")), F.lit(f"{pattern} Z"))
    seconds = F.when(text.rlike(shape), F.unix_seconds(in_utc))
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return epoch + F.make_dt_interval(secs=seconds)


def _number(text: Column) -> Column:
    """The number that a text is; digits beyond the range of a double make an infinite one."""
    return F.regexp_extract(text, _NUMBER, 0).try_cast("double")


def _within(number: Column, limit: float) -> Column:
    """A number nearer to zero than a limit, else NULL.

    The number stands here once. A condition and a value would each read the text again, row by row.
    """
    held = F.greatest(F.lit(-limit), F.least(F.lit(limit), number))
    return F.nullif(F.nullif(held, F.lit(limit)), F.lit(-limit))


def _float(text: Column, spec: dict) -> Column:
    """A finite number; digits beyond the range of a double cannot be read."""
    return _within(_number(strip(text)), float("inf"))


def _currency(text: Column, spec: dict) -> Column:
    return _within(_number(F.regexp_replace(text, _MONEY_NOISE, "")), MONEY_LIMIT)


def _int(text: Column, spec: dict) -> Column:
    """Whole numbers only: "7.0" is 7, "1.5" cannot be read."""
    digits = strip(text)
    number = _number(digits)
    whole = (number == F.floor(number)) & (F.abs(number) < _LONG_LIMIT)
    return F.coalesce(
        F.when(digits.rlike(_NUMBER), digits.try_cast("bigint")),
        F.when(whole, number.try_cast("bigint")),
    )


_PARSERS: dict[str, Callable[[Column, dict], Column]] = {
    "date": _date,
    "datetime": _datetime,
    "currency": _currency,
    "int": _int,
    "float": _float,
}

# Named column transforms that a source mapping may ask for. Add to it to extend.
TRANSFORMS: dict[str, Callable[[Column], Column]] = {"title_case": title_case}


def parse(raw: Column, spec: dict) -> Column:
    """Read text as the type a mapping names; empty text is NULL."""
    kind = spec["type"]
    if kind not in _PARSERS:
        raise ValueError(f"Unknown type {kind}")
    return _PARSERS[kind](F.nullif(raw.cast("string"), F.lit("")), spec)


def unreadable(raw: Column, parsed: Column) -> Column:
    """True where there was text but no value came out of it."""
    return parsed.isNull() & raw.isNotNull() & (raw.cast("string") != "")


def transform(name: str, column: Column) -> Column:
    if name not in TRANSFORMS:
        raise ValueError(f"Unknown transform {name}")
    return TRANSFORMS[name](column)
