"""Changes to the columns of a table, as DataFrames of the rows after the change."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.functions.compat import STANDARD, Profile
from larkspur.operators.rows import KeyViolation, null_keys, repeated_keys, type_of
from larkspur.operators.select import UnknownColumn, column_of


def added(df: DataFrame, columns: Sequence[tuple[str, str]], profile: Profile = STANDARD) -> DataFrame:
    """New columns (name, declared type) at the end, null in all rows."""
    kinds = {}
    for name, declared in columns:
        kind = type_of(declared, profile)
        if name in df.columns or name in kinds:
            raise ValueError(f"Column {name} already exists")
        kinds[name] = kind
    return df.withColumns({c: F.lit(None).cast(t) for c, t in kinds.items()})


def dropped(df: DataFrame, name: str, key: Sequence[str] | None = None) -> DataFrame:
    """The table without a column, which must not belong to the key or be the last one."""
    column_of(df, name)
    if name in (key or ()):
        raise ValueError(f"Cannot drop primary key column '{name}'")
    if len(df.columns) == 1:
        raise ValueError(f"Cannot drop the only column '{name}'")
    return df.drop(name)


def modified(df: DataFrame, name: str, declared: str, profile: Profile = STANDARD) -> DataFrame:
    """A column under a new type. STANDARD refuses if a value would be lost; COMPATIBLE makes it null."""
    column, kind = column_of(df, name), type_of(declared, profile)
    cast = column.try_cast(kind)
    lost = column.isNotNull() & cast.isNull()
    if isinstance(df.schema[name].dataType, T.NumericType) and isinstance(kind, T.NumericType):
        lost = lost | (cast.cast("double") != column.cast("double"))
    if not profile.text_as_number and not df.filter(lost).isEmpty():
        raise ValueError(f"Column {name} has values that are no {declared.upper()}")
    return df.withColumn(name, cast)


def renamed(df: DataFrame, old: str, new: str, key: Sequence[str] | None = None) -> tuple[DataFrame, list[str] | None]:
    """The table with a column renamed, and its key under the new name."""
    column_of(df, old)
    if new in df.columns:
        raise ValueError(f"Column {new} already exists")
    return df.withColumnRenamed(old, new), [new if c == old else c for c in key] if key else None


def check_new_key(df: DataFrame, key: Sequence[str], existing: Sequence[str] | None = None) -> None:
    """Raises if the table has a key, lacks a column, or has null or repeated keys."""
    if existing:
        raise ValueError(f"Table already has a primary key: {', '.join(existing)}")
    for c in key:
        if c not in df.columns:
            raise UnknownColumn(f"Column '{c}' does not exist")
    bad = null_keys(df, key).first()
    if bad is not None:
        raise KeyViolation(f"Cannot add PRIMARY KEY: Column '{next(c for c in key if bad[c] is None)}' has NULL values")
    twice = repeated_keys(df, key).first()
    if twice is not None:
        raise KeyViolation(f"Cannot add PRIMARY KEY: Duplicate values found ({', '.join(str(twice[c]) for c in key)})")
