"""Predicates and aggregates over loosely typed columns, in two profiles.

STANDARD follows SQL over typed columns. COMPATIBLE compares cells as numbers where both sides read as numbers and as text
otherwise, counts nulls in COUNT(column), and applies a limit before an aggregate.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the operators of a predicate in either profile, and those that only STANDARD knows
OPERATORS = ("=", ">", "<")
MORE_OPERATORS = (">=", "<=", "!=", "<>")
AGGREGATES = ("COUNT", "SUM", "AVG", "MIN", "MAX")
NULL_WORD = "NULL"


@dataclass(frozen=True)
class Profile:
    """What the two profiles disagree on."""

    name: str
    text_as_number: bool  # cells and literals that read as numbers compare as numbers
    count_nulls: bool  # COUNT(column) counts every row
    limit_first: bool  # LIMIT cuts the rows before they are aggregated
    zero_is_no_limit: bool
    text_group_order: bool  # grouped output is ordered by the key's text
    check_key_on_update: bool
    null_literal: bool  # INSERT accepts NULL
    negative_int: bool  # INSERT accepts -5 as INT
    ignore_unknown_order: bool  # ORDER BY an unknown column is no order


STANDARD = Profile("standard", False, False, False, False, False, True, True, True, False)
COMPATIBLE = Profile("compatible", True, True, True, True, True, False, False, False, True)


def number_in(text: str) -> float | None:
    """The number that a literal reads as, if any."""
    try:
        return float(text)
    except ValueError:
        return None


def unquoted(literal: str) -> str:
    """A literal without blanks around it and without one pair of like quotes."""
    bare = literal.strip()
    return bare[1:-1] if len(bare) > 1 and bare[0] == bare[-1] and bare[0] in "'\"" else bare


def as_number(column: Column) -> Column:
    """The cell as a double, null where it isn't one; NaN never compares."""
    found = column.try_cast("double")
    return F.when(~F.isnan(found), found)


def comparison(column: Column, op: str, value, profile: Profile = STANDARD) -> Column:
    """column op value as a condition for a filter: null where the cell is unknown. STANDARD ones are plain, so scans take them.

    `= None` matches nulls in both profiles. An operator that the profile lacks is an error.
    """
    allowed = OPERATORS if profile.text_as_number else OPERATORS + MORE_OPERATORS
    if op not in allowed:
        raise ValueError(f"Unsupported operator {op}")
    if value is None or (profile.text_as_number and value == NULL_WORD):
        if op == "=":
            return column.isNull()
        return column.isNotNull() if op in ("!=", "<>") else F.lit(False)
    if not profile.text_as_number:
        if isinstance(value, float) and value != value:
            return F.lit(False)
        typed = F.lit(value)
        return {"=": column == typed, ">": column > typed, "<": column < typed, ">=": column >= typed, "<=": column <= typed, "!=": column != typed, "<>": column != typed}[op]
    number = number_in(str(value))
    if number is not None:
        cell = as_number(column)
        return F.lit(False) if number != number else {"=": cell == number, ">": cell > number, "<": cell < number}[op]
    return column.cast("string") == F.lit(str(value)) if op == "=" else F.lit(False)


def predicate(column: Column, op: str, value, profile: Profile = STANDARD) -> Column:
    """The same as a two-valued condition: an unknown comparison is false, so its negation keeps the row."""
    return F.coalesce(comparison(column, op, value, profile), F.lit(False))


def number_of(column: Column, strict: bool) -> Column:
    """The cell as a double, whatever Spark's ANSI mode: text that is no number is an error, and so is a null if strict."""
    cell = column.try_cast("double")
    bad = cell.isNull() if strict else cell.isNull() & column.isNotNull()
    return F.when(bad, F.raise_error(F.lit("a value is no number")).cast("double")).otherwise(cell)


def aggregate(name: str, column: Column | None, profile: Profile = STANDARD, grouped: bool = True) -> Column:
    """COUNT, SUM, AVG, MIN or MAX. All but COUNT and the MIN and MAX of text are doubles.

    Nulls are skipped; over all rows (not grouped) the compatible profile raises for them.
    """
    name = name.upper()
    if name not in AGGREGATES:
        raise ValueError(f"Unsupported aggregate {name}")
    if name == "COUNT":
        return F.count(F.lit(1)) if column is None or profile.count_nulls else F.count(column)
    if column is None:
        raise ValueError(f"{name} needs a column")
    if name in ("MIN", "MAX") and not profile.text_as_number:
        return F.min(column) if name == "MIN" else F.max(column)
    number = number_of(column, profile.text_as_number and not grouped)
    return {"SUM": F.sum, "AVG": F.avg, "MIN": F.min, "MAX": F.max}[name](number)
