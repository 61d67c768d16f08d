"""Dates and amounts written as free text, parsed with built-in expressions."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import is_blank, strip

# Accepted date layouts in order of trial; day-first comes before month-first.
DATE_FORMATS = (
    "%Y-%m-%d %H:%M:%S",
    "%Y-%m-%dT%H:%M:%S",
    "%Y-%m-%dT%H:%M:%SZ",
    "%Y-%m-%dT%H:%M:%S%z",
    "%d/%m/%Y",
    "%m/%d/%Y",
    "%Y-%m-%d",
    "%d-%m-%Y",
)

# Currency symbols in order of trial and their codes.
CURRENCY_SYMBOLS = (("$", "USD"), ("€", "EUR"), ("£", "GBP"), ("¥", "JPY"))

_DIRECTIVES = {
    "Y": r"(\d{4})",
    "m": r"(1[0-2]|0?[1-9])",
    "d": r"(3[01]|[12]\d|0?[1-9])",
    "H": r"(2[0-3]|[01]?\d)",
    "M": r"([0-5]?\d)",
    "S": r"([0-5]?\d)",
    "z": r"([+-]\d{2}):?([0-5]\d)",
}


def _layout(fmt: str) -> tuple[str, str, str]:
    """Regular expression of a layout, the replacement that rewrites a match as a timestamp, and one for its offset."""
    pattern, at, group = "", {}, 0
    for token in re.findall(r"%.|\s+|.", fmt):
        if token.startswith("%"):
            pattern += _DIRECTIVES[token[1]]
            group += 1
            at[token[1]] = group
            group += token[1] == "z"
        else:
            pattern += r"\s+" if token.isspace() else re.escape(token)
    clock = ":".join(f"${{{at[k]}}}" if k in at else "0" for k in "HMS").replace("{", "").replace("}", "")
    stamp = f"${at['Y']}-${at['m']}-${at['d']} {clock}"
    offset = f"${at['z']}:${at['z'] + 1}" if "z" in at else "+00:00"
    return f"^{pattern}$", stamp, offset


def parse_timestamp_text(c: Column, formats: Sequence[str] = DATE_FORMATS) -> Column:
    """ISO text with offset from the first layout that reads ``c`` as a real date; null when none does."""
    text = strip(c)
    tries = []
    for fmt in formats:
        pattern, stamp, offset = _layout(fmt)
        wall = F.regexp_replace(text, pattern, stamp).try_cast("timestamp_ntz")
        zone = F.regexp_replace(text, pattern, offset) if offset.startswith("$") else F.lit(offset)
        tries.append(F.when(text.rlike(pattern), F.concat(F.date_format(wall, "yyyy-MM-dd'T'HH:mm:ss"), zone)))
    return F.coalesce(*tries)


def parse_date(c: Column, formats: Sequence[str] = DATE_FORMATS) -> Column:
    """ISO-8601 text, naive input taken as UTC; blank becomes empty and unreadable text stays as it is."""
    return F.when(is_blank(c), F.lit("")).otherwise(F.coalesce(parse_timestamp_text(c, formats), strip(c)))


def currency_amount(c: Column) -> Column:
    """First number in the text without thousands separators, 0.0 when there is none."""
    digits = F.regexp_extract(F.replace(c, F.lit(",")), r"[-+]?\d*\.\d+|[-+]?\d+", 0)
    return F.coalesce(digits.try_cast("double"), F.lit(0.0))


def currency_code(c: Column) -> Column:
    """Code of the first symbol that starts or ends the text, USD when none does."""
    text = F.replace(strip(c), F.lit(","))
    code = F.when(text.isNull(), F.lit("USD"))
    for symbol, name in CURRENCY_SYMBOLS:
        code = code.when(text.startswith(symbol) | text.endswith(symbol), F.lit(name))
    return code.otherwise(F.lit("USD"))


def parse_currency(c: Column) -> Column:
    """``struct(amount double, currency string)``."""
    return F.struct(currency_amount(c).alias("amount"), currency_code(c).alias("currency"))
