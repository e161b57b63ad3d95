"""Queries, changes and catalog tables, in both profiles."""

import duckdb
import pytest

import __spark_entry__ as entry
from larkspur.functions.compat import COMPATIBLE, STANDARD, predicate
from larkspur.operators import columns as C
from larkspur.operators import rows as R
from larkspur.operators import select as S
from larkspur.plans import catalog
from larkspur.sources import tables, text

SF = "/root/testdata/sf0.001"
BOATS = [("id", "INT"), ("name", "VARCHAR"), ("harbour", "CHAR"), ("draught", "DOUBLE")]
ROWS = [["11", "'Petrel'", "'North'", "2.25"], ["12", "'Auk'", "'Quay'", "0.75"], ["17", "'Skua'", "'North'", "3.5"]]


@pytest.fixture
def boats(spark):
    if spark.catalog.tableExists("boats"):
        tables.drop(spark, "boats")
    tables.create(spark, "boats", BOATS, "id")
    tables.insert(spark, "boats", ROWS)
    yield "boats"
    if spark.catalog.tableExists("boats"):
        tables.drop(spark, "boats")


def ids(df):
    return [r["id"] for r in df.orderBy("id").collect()]


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query_matches_sql(spark, name):
    db = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found, wanted = catalog.QUERIES[name](spark, SF), db.sql(catalog.ORACLES[name])
    columns = sorted(found.columns)
    assert columns == sorted(wanted.columns)
    order = [wanted.columns.index(c) for c in columns]
    assert sorted((tuple(r[c] for c in columns) for r in found.collect()), key=repr) == sorted((tuple(r[i] for i in order) for r in wanted.fetchall()), key=repr)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


CELLS = ["10", "9", "1.0", "01", "abc", None, "NaN", "Infinity", ""]


@pytest.mark.parametrize(("op", "value", "want"), [("=", "1", ["01", "1.0"]), (">", "9", ["10", "Infinity"]), ("<", "9.5", ["01", "1.0", "9"]), ("=", "abc", ["abc"]), (">", "abc", []), ("=", "NULL", [None]), (">", "nan", []), ("=", "nan", [])])
def test_compatible_predicate(spark, op, value, want):
    df = spark.createDataFrame([(c,) for c in CELLS], "s string")
    hit = predicate(df["s"], op, value, COMPATIBLE)
    assert sorted((r["s"] for r in df.filter(hit).collect()), key=str) == sorted(want, key=str)
    assert df.filter(~hit).count() == len(CELLS) - len(want)


def test_standard_predicate_errors(spark):
    df = spark.createDataFrame([(1,)], "a int")
    with pytest.raises(ValueError, match="Unsupported operator"):
        S.where(df, ("a", "LIKE", 1))
    with pytest.raises(ValueError, match="Unsupported operator"):
        S.where(df, ("a", ">=", 1), COMPATIBLE)
    with pytest.raises(S.UnknownColumn):
        S.where(df, ("A", "=", 1))


def test_nulls_in_aggregates(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", None), (None, 4.0)], "k string, v double")
    assert {tuple(r) for r in S.aggregated(df, [("SUM", "v", "s"), ("COUNT", "v", "n")], ["k"]).collect()} == {("a", 1.0, 1), ("b", None, 0), (None, 4.0, 1)}
    assert {tuple(r) for r in S.aggregated(df, [("COUNT", "v", "n")], ["k"], COMPATIBLE).collect()} == {("a", 2), ("b", 1), (None, 1)}
    assert R.deleted(df, ("v", ">", 0.0)).count() == 2
    assert S.where(df, ("v", "=", None)).count() == 2


def test_limits(spark):
    df = spark.range(5).toDF("id")
    assert S.limited(df, 0).count() == 0 and S.limited(df, 0, COMPATIBLE).count() == 5
    with pytest.raises(ValueError):
        S.limited(df, -1)
    assert S.query(df, aggregates=[("SUM", "id", "s")], order_by=("id", True), limit=2, profile=COMPATIBLE).first()["s"] == 7.0
    assert S.query(df, order_by=("nothing", False), profile=COMPATIBLE).count() == 5
    with pytest.raises(S.UnknownColumn):
        S.query(df, order_by=("nothing", False))


def test_text_order(spark):
    df = spark.createDataFrame([("10",), ("9",), ("100",)], "s string")
    assert [r["s"] for r in S.ordered(df, "s", profile=COMPATIBLE).collect()] == ["9", "10", "100"]
    assert [r["s"] for r in S.ordered(df.union(spark.createDataFrame([("x",)], "s string")), "s", profile=COMPATIBLE).collect()] == ["10", "100", "9", "x"]


def test_insert_and_key(spark, boats):
    df = tables.rows(spark, boats)
    assert ids(df) == [11, 12, 17]
    for values, names, message in ((["17", "'X'", "'I'", "1.0"], None, "Primary Key violation: id = 17"), (["'X'"], ["name"], "cannot be NULL"), (["6", "'X'", "'I'"], None, "Column count mismatch"), (["6", "X", "'I'", "1.0"], None, "must be inside quotes"), (["x", "'X'", "'I'", "1.0"], None, "Invalid INT value"), (["6", "'X'", "'I'", "y"], None, "Invalid DOUBLE value"), (["6"], ["idd"], "Column idd not found")):
        with pytest.raises(ValueError, match=message):
            tables.insert(spark, boats, [values], names)
    with pytest.raises(R.KeyViolation):
        tables.insert(spark, boats, [["7", "'a'", "'b'", "1"], ["7", "'a'", "'b'", "1"]])
    with pytest.raises(ValueError, match="Invalid INT value : -6"):
        tables.insert(spark, boats, [["-6", "'X'", "'I'", "1.0"]], profile=COMPATIBLE)
    assert tables.insert(spark, boats, [["-6", "'a, b'", "NULL", "1e3"]]) == 1
    assert ids(tables.rows(spark, boats)) == [-6, 11, 12, 17]


def test_update_delete(spark, boats):
    assert tables.update(spark, boats, {"harbour": "Lock"}, ("id", "=", 12)) == 1
    assert [r["harbour"] for r in tables.rows(spark, boats).orderBy("id").collect()] == ["North", "Lock", "North"]
    with pytest.raises(R.KeyViolation):
        tables.update(spark, boats, {"id": 11}, ("id", "=", 12))
    assert tables.delete(spark, boats, ("draught", "<", 1.0)) == 1
    assert ids(tables.rows(spark, boats)) == [11, 17]
    assert tables.described(spark, boats)["primary_key"] == ["id"]
    assert tables.truncate(spark, boats) == 2 and tables.rows(spark, boats).columns == [c for c, _ in BOATS]


def test_alter(spark, boats):
    tables.add_columns(spark, boats, [("gpa", "DOUBLE"), ("city", "VARCHAR")])
    assert {r["gpa"] for r in tables.rows(spark, boats).collect()} == {None}
    with pytest.raises(ValueError, match="Cannot drop primary key column"):
        tables.drop_column(spark, boats, "id")
    tables.drop_column(spark, boats, "gpa")
    tables.rename_column(spark, boats, "id", "sid")
    assert tables.described(spark, boats)["primary_key"] == ["sid"]
    with pytest.raises(ValueError, match="already has a primary key: sid"):
        tables.add_primary_key(spark, boats, ["name"])
    tables.drop_primary_key(spark, boats)
    with pytest.raises(ValueError, match="does not have a primary key"):
        tables.drop_primary_key(spark, boats)
    with pytest.raises(R.KeyViolation, match="Duplicate values found"):
        tables.add_primary_key(spark, boats, ["harbour"])
    with pytest.raises(R.KeyViolation, match="has NULL values"):
        tables.add_primary_key(spark, boats, ["city"])
    tables.add_primary_key(spark, boats, ["name", "harbour"])
    with pytest.raises(ValueError, match="has values that are no INT"):
        tables.modify_column(spark, boats, "name", "INT")
    tables.modify_column(spark, boats, "sid", "DOUBLE")
    assert dict(tables.rows(spark, boats).dtypes)["sid"] == "double"
    got = {r["column_name"]: (r["data_type"], r["key"]) for r in tables.describe(spark, boats).collect()}
    assert got["name"] == ("VARCHAR", "PRIMARY KEY") and got["sid"] == ("DOUBLE", "")
    tables.rename(spark, boats, "vessels")
    assert "vessels" in [r["table_name"] for r in tables.show_tables(spark).collect()]
    tables.drop(spark, "vessels")
    with pytest.raises(tables.MissingTable, match="Table does not exist"):
        tables.rows(spark, "vessels")


def test_create_errors(spark, boats):
    with pytest.raises(ValueError, match="Table already exists"):
        tables.create(spark, boats, BOATS)
    for name, columns, key in (("t1", [("a", "BLOB")], None), ("t1", [("a", "INT"), ("a", "INT")], None), ("t1", [("a", "INT")], "b"), ("../t", [("a", "INT")], None)):
        with pytest.raises(ValueError):
            tables.create(spark, name, columns, key)
    assert R.type_of("varchar(20)").simpleString() == "string"
    with pytest.raises(ValueError):
        R.type_of("VARCHAR(20)", COMPATIBLE)


def test_text_tables(spark, tmp_path):
    columns = [["id", "INT"], ["name", "VARCHAR"], ["depth", "DOUBLE"]]
    (tmp_path / "t.tbl").write_text("21,Fulmar,4.125\n22,NULL,0.5\n")
    (tmp_path / "t.meta").write_text('{"columns": [["id","INT"],["name","VARCHAR"],["depth","DOUBLE"]],\n "primary_key": "id"}')
    assert text.read_columns(spark, f"file://{tmp_path}/t.meta") == {"columns": columns, "primary_key": ["id"]}
    text.write_columns(spark, f"file://{tmp_path}/again", columns, ["id", "name"])
    assert text.read_columns(spark, f"file://{tmp_path}/again") == {"columns": columns, "primary_key": ["id", "name"]}
    df = text.read_rows(spark, f"file://{tmp_path}/t.tbl", columns)
    assert [tuple(r) for r in df.orderBy("id").collect()] == [(21, "Fulmar", 4.125), (22, None, 0.5)]
    text.write_rows(df, f"file://{tmp_path}/out")
    assert text.read_rows(spark, f"file://{tmp_path}/out", columns).count() == 2
    for i, bad in enumerate(("a,b", "a\nb", "", "NULL")):
        with pytest.raises(ValueError, match="comma"):
            text.write_rows(spark.createDataFrame([("a",), (bad,)], "s string"), f"file://{tmp_path}/bad{i}")


@pytest.mark.parametrize(("condition", "pushed"), [(("l_quantity", ">", 49.0), "GreaterThan(l_quantity,49.0)"), (("l_returnflag", "=", "R"), "EqualTo(l_returnflag,R)")])
def test_filters_reach_the_scan(spark, condition, pushed):
    df = spark.read.parquet(f"{SF}/lineitem.parquet")
    plan = S.query(df, ["l_orderkey"], condition)._jdf.queryExecution().executedPlan().toString()
    assert pushed in plan and f"struct<l_orderkey:bigint,{condition[0]}" in plan
    assert "PushedFilters: [Or(IsNull(" in R.deleted(df, condition)._jdf.queryExecution().executedPlan().toString()


def test_select_list_with_aggregates(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", 3.0)], "k string, v double")
    total = [("SUM", "v", "s")]
    for profile in (STANDARD, COMPATIBLE):
        with pytest.raises(S.UnknownColumn):
            S.query(df, ["nope"], aggregates=total, profile=profile)
    with pytest.raises(S.UnknownColumn):
        S.query(df, ["v"], aggregates=total, group_by=["k"])
    with pytest.raises(ValueError, match="one aggregate"):
        S.query(df, aggregates=[*total, ("COUNT", None, "n")], profile=COMPATIBLE)
    assert S.query(df, ["v"], aggregates=total, group_by=["k"], profile=COMPATIBLE).columns == ["k", "s"]
    assert S.query(df, aggregates=total).first()["s"] == 4.0
    with pytest.raises(Exception, match="a value is no number"):  # a null, over all rows
        S.query(df, aggregates=total, profile=COMPATIBLE).collect()
    with pytest.raises(Exception, match="a value is no number"):
        S.query(df, aggregates=[("SUM", "k", "s")]).collect()
    counts = [("COUNT", None, "count_of_k")]
    assert [r["k"] for r in S.query(df, aggregates=counts, group_by=["k"], order_by=("COUNT(*)", False), profile=COMPATIBLE).collect()] == ["b", "a"]


def test_values_are_not_lost(spark, boats):
    df = spark.createDataFrame([(8.5,), (2.0,)], "x double")
    with pytest.raises(ValueError, match="no INT"):
        C.modified(df, "x", "INT")
    assert {r["x"] for r in C.modified(df, "x", "INT", COMPATIBLE).collect()} == {8, 2}
    for value in ("deep", True):
        with pytest.raises(ValueError, match="Invalid DOUBLE value"):
            tables.update(spark, boats, {"draught": value}, ("id", "=", 11))
    with pytest.raises(ValueError, match="Invalid INT value"):
        tables.update(spark, boats, {"id": 1.5}, ("id", "=", 11))
    tables.create(spark, "quoted", [("a'b", "INT"), ("c\\d", "VARCHAR")], "a'b")
    try:
        assert tables.described(spark, "quoted") == {"columns": [["a'b", "INT"], ["c\\d", "VARCHAR"]], "primary_key": ["a'b"]}
    finally:
        tables.drop(spark, "quoted")
    assert tuple(tables.details(spark, boats).first()) == (4, 3, "(id)")


def test_column_changes(spark):
    df = spark.createDataFrame([("1", 2)], "a string, b int")
    assert dict(C.modified(df, "a", "INT").dtypes)["a"] == "bigint"
    with pytest.raises(ValueError, match="already exists"):
        C.added(df, [("a", "INT")])
    with pytest.raises(ValueError, match="already exists"):
        C.renamed(df, "a", "b")
    assert STANDARD.name == "standard"
