"""Free-text scalar functions used while deriving clinical columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Result-defining constants, token lists and patterns.
DAYS_PER_MONTH = 30.4375
ADJUDICATION_DAYS_PER_MONTH = 30.44
MONTHS_PER_UNIT = {
    "days": 1.0 / 30.4375,
    "weeks": 7.0 / 30.4375,
    "months": 1.0,
    "years": 12.0,
}
DEFAULT_EVENT_TOKENS = [
    "1", "yes", "y", "true", "event", "recurrence", "bcr", "dead", "deceased",
]
DEFAULT_CENSOR_TOKENS = [
    "0", "no", "n", "false", "censored", "ned", "alive", "no recurrence",
]
NULL_SYMBOL_TOKENS = ["", "nan", "---", "null"]
FIRST_NUMBER = r"(-?\d+\.?\d*)"
KEY_VALUE = r"^\s*([^:]+?)\s*:\s*(.*)$"
MULTI_TARGET = r"\s*///\s*"
BARCODE = r"^(TCGA-[0-9A-Z]{2}-[0-9A-Z]{4})(?:-(\d{2})[A-Z]?)?"
PRIMARY_TYPE = "01"


def blank_to_null(col: Column) -> Column:
    return F.when(col != "", col)


def first_number(col: Column) -> Column:
    """First number found in free text, or NULL."""
    return blank_to_null(F.regexp_extract(col, FIRST_NUMBER, 1)).try_cast("double")


def months_from_text(col: Column, unit: Column | str) -> Column:
    """First number in the text, converted to months by a declared unit."""
    unit_col = F.lit(unit) if isinstance(unit, str) else unit
    factor = F.lit(None).cast("double")
    for name, months in MONTHS_PER_UNIT.items():
        factor = F.when(unit_col == name, F.lit(months)).otherwise(factor)
    return first_number(col) * factor


def event_token(col: Column) -> Column:
    return F.lower(F.trim(col))


def event_indicator(col: Column, event_tokens: Column, censor_tokens: Column) -> Column:
    """1 / 0 / NULL; declared tokens replace the defaults, and events win a clash."""

    def declared_or(tokens: Column, default: list[str]) -> Column:
        fallback = F.array(*[F.lit(t) for t in default])
        given = tokens.isNotNull() & (F.size(tokens) > 0)
        return F.when(given, F.transform(tokens, F.lower)).otherwise(fallback)

    token = event_token(col)
    return (
        F.when(F.array_contains(declared_or(event_tokens, DEFAULT_EVENT_TOKENS), token), 1)
        .when(F.array_contains(declared_or(censor_tokens, DEFAULT_CENSOR_TOKENS), token), 0)
        .cast("int")
    )


def key_part(col: Column) -> Column:
    """Key of a ``key: value`` cell, lower-cased with underscores, or NULL."""
    key = F.regexp_extract(col, KEY_VALUE, 1)
    return blank_to_null(F.replace(F.lower(key), F.lit(" "), F.lit("_")))


def value_part(col: Column) -> Column:
    """Value of a ``key: value`` cell, NULL when the cell has no key."""
    return F.when(col.rlike(KEY_VALUE), F.regexp_extract(col, KEY_VALUE, 2))


def unquote(col: Column) -> Column:
    """Trim whitespace, then surrounding double quotes."""
    return F.regexp_replace(F.trim(col), r'^"+|"+$', "")


def split_targets(col: Column) -> Column:
    """Targets of a probe: split on the multi-target separator, null tokens dropped."""
    text = F.trim(F.coalesce(col, F.lit("")))
    empty = F.array().cast("array<string>")
    parts = F.filter(F.transform(F.split(text, MULTI_TARGET), lambda t: F.trim(t)), lambda t: t != "")
    return F.when(F.lower(text).isin(NULL_SYMBOL_TOKENS), empty).otherwise(parts)


def barcode_patient(col: Column) -> Column:
    return blank_to_null(F.regexp_extract(F.upper(col), BARCODE, 1))


def barcode_type(col: Column) -> Column:
    return blank_to_null(F.regexp_extract(F.upper(col), BARCODE, 2))


def strip_version(col: Column) -> Column:
    """Drop the ``.N`` suffix of a versioned identifier."""
    return F.split_part(col, F.lit("."), F.lit(1))


def populated(values: Column) -> Column:
    """Trimmed, non-blank entries of an array of nullable strings."""
    trimmed = F.transform(values, lambda v: F.trim(v))
    return F.filter(
        F.coalesce(trimmed, F.array().cast("array<string>")),
        lambda v: v.isNotNull() & (v != ""),
    )


def positive_days(values: Column) -> Column:
    """Finite, strictly positive numbers of a populated array (NaN excluded)."""
    days = F.transform(populated(values), lambda v: v.try_cast("double"))
    return F.filter(
        days,
        lambda d: d.isNotNull() & ~F.isnan(d) & (d > 0) & (d < F.lit(float("inf"))),
    )


def mentions(values: Column, word: str) -> Column:
    """True if any populated entry contains the word, ignoring case."""
    return F.exists(populated(values), lambda v: F.contains(F.lower(v), F.lit(word)))
