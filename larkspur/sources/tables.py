"""Tables in Spark's own catalog: Parquet files, declared types and primary key as table properties.

Rows are appended in place. Anything that rewrites a table writes a new one beside it and swaps names, so a failed write
leaves the old rows as they are.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from larkspur.functions.compat import STANDARD, Profile
from larkspur.operators import columns as column_changes
from larkspur.operators import rows as row_changes
from larkspur.operators.select import Condition

PROPERTY = "larkspur.table"
NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


class MissingTable(ValueError):
    """A table that doesn't exist."""


def _name(table: str) -> str:
    if not NAME.fullmatch(table):
        raise ValueError(f"Invalid table name {table}")
    return table


def _need(spark: SparkSession, table: str) -> None:
    if not spark.catalog.tableExists(_name(table)):
        raise MissingTable("Table does not exist")


def described(spark: SparkSession, table: str) -> dict:
    """columns [[name, declared type], ...] and primary_key of a table."""
    _need(spark, table)
    found = {r["key"]: r["value"] for r in spark.sql(f"SHOW TBLPROPERTIES {table}").collect()}
    if PROPERTY in found:
        return json.loads(found[PROPERTY])
    return {"columns": [[f.name, declared(f.dataType)] for f in spark.table(table).schema], "primary_key": None}


def declared(kind: T.DataType) -> str:
    if isinstance(kind, (T.IntegerType, T.LongType, T.ShortType)):
        return "INT"
    return "DOUBLE" if isinstance(kind, (T.DoubleType, T.FloatType)) else "VARCHAR"


def _put(spark: SparkSession, table: str, columns: Sequence, key: Sequence[str] | None) -> None:
    text = json.dumps({"columns": [list(c) for c in columns], "primary_key": list(key) if key else None})
    literal = text.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(f"ALTER TABLE {table} SET TBLPROPERTIES ('{PROPERTY}' = '{literal}')")


def create(spark: SparkSession, table: str, columns: Sequence[tuple[str, str]], primary_key: str | Sequence[str] | None = None, profile: Profile = STANDARD) -> None:
    """An empty table."""
    if spark.catalog.tableExists(_name(table)):
        raise ValueError("Table already exists")
    names = [c for c, _ in columns]
    if len(set(names)) < len(names):
        raise ValueError("Column names must differ")
    key = [primary_key] if isinstance(primary_key, str) else list(primary_key or [])
    schema = T.StructType([T.StructField(c, row_changes.type_of(t, profile)) for c, t in columns])
    for c in key:
        if c not in names:
            raise ValueError(f"Primary Key column '{c}' must be valid column")
    spark.createDataFrame([], schema).write.format("parquet").saveAsTable(table)
    _put(spark, table, columns, key)


def rows(spark: SparkSession, table: str) -> DataFrame:
    _need(spark, table)
    return spark.table(table)


def rewrite(spark: SparkSession, table: str, df: DataFrame, columns: Sequence | None = None, key: Sequence[str] | None = None) -> None:
    """Publishes df as the table's rows: written beside it first, then swapped in by two renames.

    One writer at a time: Spark's catalog has no locks. A crash between the renames leaves the old and the new rows in
    tables of the same name with a suffix.
    """
    now = described(spark, table)
    fresh, old = f"{table}__{uuid.uuid4().hex[:12]}", f"{table}__{uuid.uuid4().hex[:12]}"
    df.write.format("parquet").saveAsTable(fresh)
    _put(spark, fresh, columns if columns is not None else now["columns"], key if columns is not None else now["primary_key"])
    spark.sql(f"ALTER TABLE {table} RENAME TO {old}")
    spark.sql(f"ALTER TABLE {fresh} RENAME TO {table}")
    spark.sql(f"DROP TABLE {old}")


def insert(spark: SparkSession, table: str, values: Sequence[Sequence[str | None]], names: Sequence[str] | None = None, profile: Profile = STANDARD) -> int:
    """Appends literal rows, all or none; the number of rows."""
    about = described(spark, table)
    incoming = row_changes.batch(spark, [tuple(c) for c in about["columns"]], values, names, profile)
    row_changes.check_key(spark.table(table), incoming, about["primary_key"])
    incoming.write.insertInto(table)
    return len(values)


def append(spark: SparkSession, table: str, df: DataFrame) -> None:
    """Appends a DataFrame under the table's key. It is written beside the table first, so what is checked is what is appended."""
    about = described(spark, table)
    staged = f"{table}__{uuid.uuid4().hex[:12]}"
    df.select(*[c for c, _ in about["columns"]]).write.format("parquet").saveAsTable(staged)
    try:
        incoming = spark.table(staged)
        row_changes.check_key(spark.table(table), incoming, about["primary_key"])
        incoming.write.insertInto(table)
    finally:
        spark.sql(f"DROP TABLE {staged}")


def update(spark: SparkSession, table: str, assignments: dict[str, object], condition: Condition, profile: Profile = STANDARD) -> int:
    """Sets columns where the condition holds; the number of rows that it held for."""
    about, df = described(spark, table), rows(spark, table)
    after = row_changes.updated(df, assignments, condition, profile)
    if profile.check_key_on_update and set(assignments) & set(about["primary_key"] or ()):
        row_changes.check_key(None, after, about["primary_key"])
    n = df.filter(row_changes.predicate(df[condition[0]], *condition[1:], profile)).count()
    rewrite(spark, table, after)
    return n


def delete(spark: SparkSession, table: str, condition: Condition, profile: Profile = STANDARD) -> int:
    """Removes the rows for which the condition holds; their number."""
    df = rows(spark, table)
    n = df.filter(row_changes.predicate(row_changes.column_of(df, condition[0]), *condition[1:], profile)).count()
    rewrite(spark, table, row_changes.deleted(df, condition, profile))
    return n


def drop(spark: SparkSession, table: str) -> None:
    _need(spark, table)
    spark.sql(f"DROP TABLE {table}")


def truncate(spark: SparkSession, table: str) -> int:
    """Removes all rows and keeps the columns; the number of rows."""
    n = rows(spark, table).count()
    spark.sql(f"TRUNCATE TABLE {table}")
    return n


def rename(spark: SparkSession, table: str, new: str) -> None:
    _need(spark, table)
    if spark.catalog.tableExists(_name(new)):
        raise ValueError(f"Table {new} already exists")
    spark.sql(f"ALTER TABLE {table} RENAME TO {new}")


def add_columns(spark: SparkSession, table: str, columns: Sequence[tuple[str, str]], profile: Profile = STANDARD) -> None:
    """New columns, null in the rows that exist: Parquet tables take them without a rewrite."""
    about = described(spark, table)
    column_changes.added(spark.table(table), columns, profile)
    added = ", ".join(f"`{c}` {row_changes.type_of(t, profile).simpleString()}" for c, t in columns)
    spark.sql(f"ALTER TABLE {table} ADD COLUMNS ({added})")
    _put(spark, table, [*about["columns"], *columns], about["primary_key"])


def drop_column(spark: SparkSession, table: str, column: str) -> None:
    about = described(spark, table)
    after = column_changes.dropped(spark.table(table), column, about["primary_key"])
    rewrite(spark, table, after, [c for c in about["columns"] if c[0] != column], about["primary_key"])


def modify_column(spark: SparkSession, table: str, column: str, declared: str, profile: Profile = STANDARD) -> None:
    about = described(spark, table)
    after = column_changes.modified(spark.table(table), column, declared, profile)
    rewrite(spark, table, after, [[c, declared if c == column else t] for c, t in about["columns"]], about["primary_key"])


def rename_column(spark: SparkSession, table: str, old: str, new: str) -> None:
    about = described(spark, table)
    after, key = column_changes.renamed(spark.table(table), old, new, about["primary_key"])
    rewrite(spark, table, after, [[new if c == old else c, t] for c, t in about["columns"]], key)


def add_primary_key(spark: SparkSession, table: str, key: Sequence[str]) -> None:
    about = described(spark, table)
    column_changes.check_new_key(spark.table(table), key, about["primary_key"])
    _put(spark, table, about["columns"], key)


def drop_primary_key(spark: SparkSession, table: str) -> None:
    about = described(spark, table)
    if not about["primary_key"]:
        raise ValueError("Table does not have a primary key")
    _put(spark, table, about["columns"], None)


def show_tables(spark: SparkSession) -> DataFrame:
    """Names of the tables in the current database, in order."""
    return spark.sql("SHOW TABLES").filter("NOT isTemporary").selectExpr("tableName AS table_name").orderBy("table_name")


def describe(spark: SparkSession, table: str) -> DataFrame:
    """column_name, data_type, key ("PRIMARY KEY" or empty), in the order of the columns."""
    about = described(spark, table)
    found = [(i + 1, c, t, "PRIMARY KEY" if c in (about["primary_key"] or ()) else "") for i, (c, t) in enumerate(about["columns"])]
    return spark.createDataFrame(found, "position int, column_name string, data_type string, key string")


def details(spark: SparkSession, table: str) -> DataFrame:
    """One row: n_columns, n_rows, primary_key ("(a, b)", or "None")."""
    about = described(spark, table)
    key = f"({', '.join(about['primary_key'])})" if about["primary_key"] else "None"
    return spark.createDataFrame([(len(about["columns"]), spark.table(table).count(), key)], "n_columns int, n_rows long, primary_key string")
