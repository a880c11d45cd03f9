"""Numbers, dates, names and format smells in spreadsheet text, as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as a number once brackets, percent sign and commas are gone: digits may be grouped by single underscores.
_DIGITS = r"\d+(_\d+)*"
_NUMBER = rf"^[+-]?(({_DIGITS})(\.({_DIGITS})?)?|\.{_DIGITS})([eE][+-]?{_DIGITS})?$"
_SPECIAL = r"^[+-]?(?i:inf|infinity|nan)$"

#: Formats that a profile flags.
PERCENT = r"^\s*-?\d[\d,]*(\.\d+)?\s*%\s*$"
THOUSANDS = r"^\s*-?\d{1,3}(,\d{3})+(\.\d+)?\s*$"
PARENTHESES = r"^\s*\(\s*[\d,]+(\.\d+)?\s*%?\s*\)\s*$"
SERIAL_RANGE = (20_000, 60_000)


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def number(c: Column) -> Column:
    """The value of a messy number; NaN for the word nan, null if it can't be read.

    In this order: trim, one pair of brackets means negative, a closing percent sign
    divides by 100, commas go.
    """
    text = stripped(c.cast("string"))
    core = F.regexp_replace(text, r"^\(\s*(.*?)\s*\)$", "$1")
    plain = F.regexp_replace(
        stripped(F.translate(F.regexp_replace(core, r"\s*%$", ""), ",", "")), r"^[+-](?i:nan)$", "nan"
    )
    value = F.when(plain.rlike(f"{_NUMBER}|{_SPECIAL}"), F.translate(plain, "_", "").try_cast("double"))
    return value / F.when(core.endswith("%"), 100.0).otherwise(1.0) * F.when(text.rlike(r"^\(.*\)$"), -1.0).otherwise(1.0)


_DATE_CODES = {
    "m": "M", "d": "d", "Y": "yyyy", "H": "H", "M": "m", "S": "s", "y": "yy", "b": "MMM", "B": "MMMM", "%": "%"
}


def date_pattern(fmt: str) -> str:
    """The Spark pattern of a strptime format; letters that aren't codes are quoted."""
    out, i = [], 0
    while i < len(fmt):
        if fmt[i] == "%" and i + 1 < len(fmt):
            if fmt[i + 1] not in _DATE_CODES:
                raise ValueError(f"date code %{fmt[i + 1]} is not supported")
            out.append(_DATE_CODES[fmt[i + 1]])
            i += 2
        else:
            out.append(f"'{fmt[i]}'" if fmt[i].isalpha() else fmt[i])
            i += 1
    return "".join(out)


def iso_date(c: Column, fmt: str | None) -> Column:
    """ISO text of a date in ``fmt``, or of a spreadsheet serial number without one; null if it can't be read."""
    if fmt is not None:
        return F.date_format(F.try_to_timestamp(stripped(c.cast("string")), F.lit(date_pattern(fmt))), "yyyy-MM-dd")
    serial = F.floor(c.cast("string").try_cast("double")).cast("int")
    # Serials up to 59 stand before the day in February 1900 that never was.
    return F.date_format(F.date_add(F.lit("1899-12-30").cast("date"), serial + (serial < 60).cast("int")), "yyyy-MM-dd")


def normalized_name(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def normalize_name(text: str) -> str:
    return re.sub("[^a-z0-9]+", " ", text.lower()).strip()


def smells(text: Column, kind: Column) -> Column:
    """The smells of one cell, sorted."""
    is_text = kind == "string"
    serial = (kind == "integer") & text.try_cast("bigint").between(*SERIAL_RANGE)
    found = [
        F.when(serial, "date_serial_suspect"),
        F.when(is_text & text.rlike(PARENTHESES), "parens_negative"),
        F.when(is_text & text.rlike(PERCENT), "percent_string"),
        F.when(is_text & text.rlike(THOUSANDS), "thousands_separator")
    ]
    return F.array_compact(F.array(*found))
