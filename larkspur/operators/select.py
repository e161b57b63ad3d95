"""Single-table queries: filter, projection, grouping, ordering, limits, as lazy DataFrames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions.compat import STANDARD, Profile, aggregate, comparison

Condition = tuple[str, str, object]


class UnknownColumn(ValueError):
    """A column that the table doesn't have."""


def column_of(df: DataFrame, name: str) -> Column:
    """The column of exactly that name; case counts."""
    if name not in df.columns:
        raise UnknownColumn(f"Column {name} does not exist")
    return df[name]


def where(df: DataFrame, conditions: Condition | Sequence[Condition], profile: Profile = STANDARD) -> DataFrame:
    """Rows that meet all conditions, each (column, operator, value). Catalyst pushes typed ones to the scan."""
    several = [conditions] if isinstance(conditions, tuple) else conditions
    for name, op, value in several:
        df = df.filter(comparison(column_of(df, name), op, value, profile))
    return df


def project(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The named columns in that order; a name may come twice. ["*"] is all of them."""
    return df if list(columns) == ["*"] else df.select(*[column_of(df, c) for c in columns])


def ordered(df: DataFrame, by: str, descending: bool = False, ties: Sequence[str] = (), profile: Profile = STANDARD) -> DataFrame:
    """Rows by one column: nulls first when ascending, last when descending. `ties` make the order total.

    In the compatible profile a text column whose cells all read as numbers is ordered by them, and an unknown column
    leaves the order as it is.
    """
    if by not in df.columns and profile.ignore_unknown_order:
        return df
    key = column_of(df, by)
    if profile.text_as_number and dict(df.dtypes)[by] == "string":
        numbers = df.agg(F.bool_and(key.isNull() | key.try_cast("double").isNotNull())).first()[0]
        key = key.cast("double") if numbers else F.coalesce(key, F.lit("NULL"))
    return df.orderBy(key.desc_nulls_last() if descending else key.asc_nulls_first(), *ties)


def limited(df: DataFrame, n: int | None, profile: Profile = STANDARD) -> DataFrame:
    """The first n rows; None is no limit, and so is 0 in the compatible profile."""
    if n is not None and n < 0:
        raise ValueError("LIMIT must not be negative")
    return df if n is None or (n == 0 and profile.zero_is_no_limit) else df.limit(n)


def aggregated(df: DataFrame, aggregates: Sequence[tuple[str, str | None, str]], by: Sequence[str] = (), profile: Profile = STANDARD) -> DataFrame:
    """Aggregates (name, column or None, alias), by the given keys or over all rows. A null key is a group.

    Partial sums are made before the shuffle; without keys the result is one row, of nulls where there is nothing.
    """
    found = [aggregate(name, None if c is None else column_of(df, c), profile, bool(by)).alias(alias) for name, c, alias in aggregates]
    return df.groupBy(*[column_of(df, k) for k in by]).agg(*found) if by else df.agg(*found)


def query(
    df: DataFrame,
    columns: Sequence[str] = ("*",),
    where_: Condition | Sequence[Condition] = (),
    aggregates: Sequence[tuple[str, str | None, str]] = (),
    group_by: Sequence[str] = (),
    order_by: tuple[str, bool] | None = None,
    limit: int | None = None,
    ties: Sequence[str] = (),
    profile: Profile = STANDARD,
) -> DataFrame:
    """A whole query. STANDARD: filter, aggregate, order, limit, project. COMPATIBLE: filter, order, limit, aggregate, order groups.

    With aggregates, STANDARD's columns are keys and aliases of the result; COMPATIBLE always returns (key, aggregate), takes
    one aggregate and one key, and lets columns be any of the table's.
    """
    df = where(df, where_, profile) if where_ else df
    if not aggregates:
        if group_by and not profile.limit_first:
            df = df.select(*[column_of(df, k) for k in group_by]).distinct()
        if order_by:
            df = ordered(df, *order_by, ties=ties, profile=profile)
        return project(limited(df, limit, profile), columns)
    if profile.limit_first:
        if len(aggregates) > 1 or len(group_by) > 1:
            raise ValueError("the compatible profile has one aggregate and one key in a query")
        for c in columns:
            if c != "*" and c not in [a[2] for a in aggregates]:
                column_of(df, c)
        if limit:
            df = limited(ordered(df, *order_by, ties=ties, profile=profile) if order_by and not group_by else df.orderBy(*ties) if ties else df, limit, profile)
        out = aggregated(df, aggregates, group_by, profile)
        if group_by and order_by:
            # a name that begins like the aggregate's means the aggregate
            name = aggregates[0][2] if order_by[0].upper().startswith(aggregates[0][0].upper()) else order_by[0]
            out = group_ordered(out, group_by[0], (name, order_by[1]), aggregates[0][2])
        return out
    out = aggregated(df, aggregates, group_by, profile)
    if order_by:
        out = ordered(out, *order_by, ties=ties, profile=profile)
    return project(limited(out, limit, profile), columns)


def group_ordered(groups: DataFrame, key: str, order_by: tuple[str, bool], value: str) -> DataFrame:
    """Groups by their aggregate where that is what is asked for, else by the key's text: 10 comes before 9."""
    name, descending = order_by
    column = F.col(value) if name == value else F.col(key).cast("string")
    return groups.orderBy(column.desc_nulls_last() if descending else column.asc_nulls_first())
