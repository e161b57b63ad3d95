"""Changes to the rows of a table, as DataFrames of the rows after the change."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.functions.compat import STANDARD, Profile, comparison, predicate, unquoted
from larkspur.operators.select import Condition, UnknownColumn, column_of

# fixed values: the four declared types, and, in this package, the texts of errors
TYPES: dict[str, T.DataType] = {"INT": T.LongType(), "DOUBLE": T.DoubleType(), "CHAR": T.StringType(), "VARCHAR": T.StringType()}


class KeyViolation(ValueError):
    """Rows that a primary key doesn't allow."""


def type_of(name: str, profile: Profile = STANDARD) -> T.DataType:
    """The Spark type of a declared one, in any case. STANDARD ignores a length, as in VARCHAR(20)."""
    bare = re.sub(r"\s*\(\s*\d+\s*\)$", "", name) if profile.null_literal else name
    if bare.upper() not in TYPES:
        raise ValueError(f"Unsupported datatype {name}")
    return TYPES[bare.upper()]


def literal_value(literal: str | None, declared: str, profile: Profile = STANDARD):
    """The Python value of a literal for a column of the declared type."""
    if literal is None or (literal == "NULL" and profile.null_literal):
        if not profile.null_literal:
            raise ValueError(f"Invalid {declared} value : NULL")
        return None
    kind = declared.upper().split("(")[0].strip()
    if kind == "INT":
        if not re.fullmatch(r"-?[0-9]+" if profile.negative_int else r"[0-9]+", literal) or abs(int(literal)) >= 1 << 63:
            raise ValueError(f"Invalid INT value : {literal}")
        return int(literal)
    if kind == "DOUBLE":
        try:
            return float(literal)
        except ValueError:
            raise ValueError(f"Invalid DOUBLE value : {literal}") from None
    if kind in ("CHAR", "VARCHAR"):
        bare = literal.strip()
        if len(bare) < 2 or bare[0] not in "'\"" or bare[-1] != bare[0]:
            raise ValueError(f"{kind} value must be inside quotes")
        text = unquoted(bare)
        return None if text == "NULL" and not profile.null_literal else text
    raise ValueError(f"Unsupported datatype {declared}")


def batch(spark: SparkSession, columns: Sequence[tuple[str, str]], rows: Sequence[Sequence[str | None]], names: Sequence[str] | None = None, profile: Profile = STANDARD) -> DataFrame:
    """Literal rows as a DataFrame of the table's columns (name, declared type); columns that `names` leaves out are null."""
    declared = dict(columns)
    given = list(names) if names is not None else [c for c, _ in columns]
    for c in given:
        if c not in declared:
            raise UnknownColumn(f"Column {c} not found")
    made = []
    for row in rows:
        if len(row) != len(given):
            raise ValueError("Column count mismatch")
        values = {c: literal_value(x, declared[c], profile) for c, x in zip(given, row, strict=True)}
        made.append(tuple(values.get(c) for c, _ in columns))
    schema = T.StructType([T.StructField(c, type_of(t, profile)) for c, t in columns])
    return spark.createDataFrame(made, schema)


def null_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows with a null in a column of the key."""
    return df.filter(" OR ".join(f"`{c}` IS NULL" for c in key))


def repeated_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Key columns and n of keys that more than one row has; counted in each task before the shuffle."""
    return df.groupBy(*[column_of(df, c) for c in key]).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def clashing_keys(existing: DataFrame, incoming: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys of the incoming rows that exist already. Spark broadcasts the smaller side by its size, or deals both."""
    return incoming.select(*key).distinct().join(existing.select(*key), list(key), "left_semi")


def _named(row, key: Sequence[str]) -> str:
    parts = [f"{c}={row[c]}" for c in key]
    return f"{key[0]} = {row[key[0]]}" if len(key) == 1 else f"({', '.join(parts)})"


def check_key(existing: DataFrame | None, incoming: DataFrame, key: Sequence[str] | None) -> None:
    """Raises KeyViolation for null keys, keys repeated among the incoming rows, and keys that exist."""
    if not key:
        return
    bad = null_keys(incoming, key).first()
    if bad is not None:
        raise KeyViolation(f"Primary Key column '{next(c for c in key if bad[c] is None)}' cannot be NULL")
    kind = "Primary Key violation" if len(key) == 1 else "Composite Primary Key violation"
    for found in [repeated_keys(incoming, key)] + ([clashing_keys(existing, incoming, key)] if existing is not None else []):
        row = found.first()
        if row is not None:
            raise KeyViolation(f"{kind}: {_named(row, key)}")


def inserted(df: DataFrame, incoming: DataFrame, key: Sequence[str] | None = None) -> DataFrame:
    """The rows with the incoming ones, all of them or, on a violation, none. Missing columns are null."""
    check_key(df, incoming, key)
    return df.unionByName(incoming, allowMissingColumns=True)


def check_value(value, kind: T.DataType) -> None:
    """Raises if a new value isn't one of the column's type; types that can't be declared are left to Spark."""
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    bits = {T.ByteType: 8, T.ShortType: 16, T.IntegerType: 32, T.LongType: 64}.get(type(kind))
    if value is None:
        return
    if bits and not (number and value == value and abs(value) != float("inf") and int(value) == value and -(1 << bits - 1) <= value < 1 << bits - 1):
        raise ValueError(f"Invalid INT value : {value}")
    if isinstance(kind, (T.DoubleType, T.FloatType)) and not number:
        raise ValueError(f"Invalid DOUBLE value : {value}")
    if isinstance(kind, T.StringType) and not isinstance(value, str):
        raise ValueError("VARCHAR value must be text")


def updated(df: DataFrame, assignments: dict[str, object], condition: Condition, profile: Profile = STANDARD) -> DataFrame:
    """The rows with new values where the condition holds; it sees the old values. A row whose condition is unknown stays."""
    name, op, value = condition
    hit = predicate(column_of(df, name), op, value, profile)
    kinds = df.schema
    for c, v in assignments.items():
        column_of(df, c)
        check_value(v, kinds[c].dataType)
    new = {c: F.when(hit, F.lit(v).cast(kinds[c].dataType)).otherwise(F.col(c)) for c, v in assignments.items()}
    return df.select(*[new.get(c, F.col(c)).alias(c) for c in df.columns])


def deleted(df: DataFrame, condition: Condition, profile: Profile = STANDARD) -> DataFrame:
    """The rows where the condition doesn't hold; those for which it is unknown stay."""
    name, op, value = condition
    column = column_of(df, name)
    if profile.text_as_number or value is None or value != value:
        return df.filter(~predicate(column, op, value, profile))
    return df.filter(column.isNull() | ~comparison(column, op, value, profile))  # in this form scans take it
