"""The registered queries over the library's own operators, each with the DuckDB SQL of its result."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions.compat import COMPATIBLE, STANDARD, aggregate, unquoted
from larkspur.operators import columns as C
from larkspur.operators import rows as R
from larkspur.operators import select as S
from larkspur.sources import tables, text

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def registered(sql: str) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with its SQL."""

    def keep(f: Query) -> Query:
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer with nulls in its segment."""
    return table(spark, sf_dir, "customer").withColumn("segment", F.nullif("c_mktsegment", F.lit("BUILDING")))


@contextmanager
def scratch(spark: SparkSession, df: DataFrame, key: Sequence[str]) -> Iterator[str]:
    """A table in the catalog with the rows of df, dropped at the end."""
    name = f"scratch_{uuid.uuid4().hex[:12]}"
    tables.create(spark, name, [(f.name, tables.declared(f.dataType)) for f in df.schema], key)
    try:
        tables.append(spark, name, df)
        yield name
    finally:
        tables.drop(spark, name)


@contextmanager
def folder(spark: SparkSession) -> Iterator[str]:
    """A folder in the warehouse, deleted at the end."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(spark.conf.get("spark.sql.warehouse.dir"), f"text-{uuid.uuid4().hex}")
    try:
        yield where.toString()
    finally:
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def local(df: DataFrame) -> DataFrame:
    """The few rows of a description or a small table, apart from the table that they were read from."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


SEGMENTS = "(SELECT *, NULLIF(c_mktsegment, 'BUILDING') AS segment FROM customer)"


# scan, projection, filter


@registered("SELECT * FROM region")
def scan_star(spark, sf_dir):
    return S.query(table(spark, sf_dir, "region"))


@registered("SELECT o_orderkey, o_totalprice FROM orders")
def project_columns(spark, sf_dir):
    return S.query(table(spark, sf_dir, "orders"), ["o_orderkey", "o_totalprice"])


@registered("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_returnflag = 'R'")
def filter_eq_text(spark, sf_dir):
    return S.query(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber", "l_quantity"], ("l_returnflag", "=", "R"))


@registered("SELECT l_orderkey, l_partkey FROM lineitem WHERE l_linenumber = 3")
def filter_eq_number(spark, sf_dir):
    return S.query(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_partkey"], ("l_linenumber", "=", 3))


@registered("SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity > 49")
def filter_gt(spark, sf_dir):
    return S.query(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_quantity"], ("l_quantity", ">", 49.0))


@registered("SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal < 0")
def filter_lt(spark, sf_dir):
    return S.query(table(spark, sf_dir, "customer"), ["c_custkey", "c_acctbal"], ("c_acctbal", "<", 0.0))


@registered(f"SELECT c_custkey, segment FROM {SEGMENTS} WHERE segment IS NULL")
def filter_null_match(spark, sf_dir):
    return S.query(segments(spark, sf_dir), ["c_custkey", "segment"], ("segment", "=", None))


@registered("SELECT p_partkey, SUBSTR(p_brand, 7) AS brand_no FROM part WHERE TRY_CAST(SUBSTR(p_brand, 7) AS DOUBLE) > 9")
def filter_text_as_number(spark, sf_dir):
    df = table(spark, sf_dir, "part").withColumn("brand_no", F.expr("substr(p_brand, 7)"))
    return S.query(df, ["p_partkey", "brand_no"], ("brand_no", ">", "9"), profile=COMPATIBLE)


@registered("SELECT COUNT(*) AS n FROM customer WHERE FALSE")
def filter_text_gt_false(spark, sf_dir):
    return S.query(table(spark, sf_dir, "customer"), where_=("c_name", ">", "B"), aggregates=[("COUNT", None, "n")], profile=COMPATIBLE)


@registered("SELECT c_custkey FROM customer WHERE c_mktsegment >= 'HOUSEHOLD' AND c_acctbal <= 100 AND c_nationkey <> 7")
def filter_several(spark, sf_dir):
    return S.query(table(spark, sf_dir, "customer"), ["c_custkey"], [("c_mktsegment", ">=", "HOUSEHOLD"), ("c_acctbal", "<=", 100.0), ("c_nationkey", "<>", 7)])


@registered("SELECT c_custkey, c_name FROM customer WHERE c_name = 'Customer#000000007'")
def filter_unquoted_literal(spark, sf_dir):
    return S.query(table(spark, sf_dir, "customer"), ["c_custkey", "c_name"], ("c_name", "=", unquoted(" 'Customer#000000007' ")), profile=COMPATIBLE)


# aggregation


@registered("SELECT COUNT(*) AS n FROM orders")
def count_star(spark, sf_dir):
    return S.query(table(spark, sf_dir, "orders"), aggregates=[("COUNT", None, "n")])


@registered(f"SELECT COUNT(*) AS every_row, COUNT(segment) AS known FROM {SEGMENTS}")
def count_column_compat(spark, sf_dir):
    df = segments(spark, sf_dir)
    return df.agg(aggregate("COUNT", df["segment"], COMPATIBLE).alias("every_row"), aggregate("COUNT", df["segment"], STANDARD).alias("known"))


@registered("SELECT SUM(l_quantity) AS total FROM lineitem")
def sum_global(spark, sf_dir):
    # whole numbers: the sum doesn't depend on the order of rows
    return S.query(table(spark, sf_dir, "lineitem"), aggregates=[("SUM", "l_quantity", "total")])


@registered("SELECT AVG(l_quantity) AS mean FROM lineitem")
def avg_global(spark, sf_dir):
    return S.query(table(spark, sf_dir, "lineitem"), aggregates=[("AVG", "l_quantity", "mean")], profile=COMPATIBLE)


@registered("SELECT CAST(MIN(c_acctbal) AS DOUBLE) AS least FROM customer")
def min_global(spark, sf_dir):
    return S.query(table(spark, sf_dir, "customer"), aggregates=[("MIN", "c_acctbal", "least")])


@registered("SELECT CAST(MAX(p_size) AS DOUBLE) AS most FROM part")
def max_global(spark, sf_dir):
    return S.query(table(spark, sf_dir, "part"), aggregates=[("MAX", "p_size", "most")], profile=COMPATIBLE)


@registered("SELECT MIN(c_name) AS least, MAX(c_name) AS most FROM customer")
def min_max_text(spark, sf_dir):
    return S.query(table(spark, sf_dir, "customer"), aggregates=[("MIN", "c_name", "least"), ("MAX", "c_name", "most")])


@registered("SELECT CAST(SUM(l_quantity) AS DOUBLE) AS total, COUNT(*) AS n FROM lineitem WHERE l_quantity < 0")
def empty_aggregate(spark, sf_dir):
    return S.query(table(spark, sf_dir, "lineitem"), where_=("l_quantity", "<", 0.0), aggregates=[("SUM", "l_quantity", "total"), ("COUNT", None, "n")])


@registered("SELECT l_returnflag, COUNT(*) AS n FROM lineitem GROUP BY l_returnflag")
def group_count(spark, sf_dir):
    return S.query(table(spark, sf_dir, "lineitem"), aggregates=[("COUNT", None, "n")], group_by=["l_returnflag"])


@registered("""
SELECT l_linestatus, SUM(q) AS total, AVG(q) AS mean, MIN(q) AS least, MAX(q) AS most, COUNT(q) AS known
FROM (SELECT l_linestatus, NULLIF(l_quantity, 1) AS q FROM lineitem) GROUP BY l_linestatus
""")
def group_sum_avg_min_max(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").withColumn("q", F.nullif("l_quantity", F.lit(1.0)))
    wanted = [("SUM", "q", "total"), ("AVG", "q", "mean"), ("MIN", "q", "least"), ("MAX", "q", "most"), ("COUNT", "q", "known")]
    return S.query(df, aggregates=wanted, group_by=["l_linestatus"])


@registered("SELECT l_linestatus, COUNT(*) AS n FROM lineitem GROUP BY l_linestatus")
def group_shape_compat(spark, sf_dir):
    return S.query(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_linestatus"], aggregates=[("COUNT", "l_tax", "n")], group_by=["l_linestatus"], profile=COMPATIBLE)


@registered("SELECT SUM(l_quantity) AS total, l_returnflag FROM lineitem GROUP BY l_returnflag")
def group_select_list(spark, sf_dir):
    wanted = [("SUM", "l_quantity", "total"), ("COUNT", None, "n")]
    return S.query(table(spark, sf_dir, "lineitem"), ["total", "l_returnflag"], aggregates=wanted, group_by=["l_returnflag"])


@registered("SELECT NULLIF(l_returnflag, 'N') AS flag, COUNT(*) AS n FROM lineitem GROUP BY 1")
def group_null_key(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").withColumn("flag", F.nullif("l_returnflag", F.lit("N")))
    return S.query(df, aggregates=[("COUNT", None, "n")], group_by=["flag"])


@registered("SELECT l_returnflag, COUNT(*) AS n FROM lineitem WHERE l_quantity > 10 GROUP BY l_returnflag ORDER BY n DESC, l_returnflag LIMIT 2")
def where_group(spark, sf_dir):
    return S.query(table(spark, sf_dir, "lineitem"), where_=("l_quantity", ">", 10.0), aggregates=[("COUNT", None, "n")], group_by=["l_returnflag"], order_by=("n", True), limit=2, ties=["l_returnflag"])


@registered("SELECT DISTINCT c_mktsegment FROM customer")
def group_without_aggregate(spark, sf_dir):
    return S.query(table(spark, sf_dir, "customer"), group_by=["c_mktsegment"], columns=["c_mktsegment"])


@registered("SELECT l_returnflag, l_linestatus, COUNT(*) AS n, MIN(l_quantity) AS least FROM lineitem GROUP BY ALL")
def group_two_keys(spark, sf_dir):
    return S.query(table(spark, sf_dir, "lineitem"), aggregates=[("COUNT", None, "n"), ("MIN", "l_quantity", "least")], group_by=["l_returnflag", "l_linestatus"])


# order, limit, top-k


@registered("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 10")
def order_limit_asc(spark, sf_dir):
    return S.query(table(spark, sf_dir, "orders"), ["o_orderkey", "o_totalprice"], order_by=("o_totalprice", False), ties=["o_orderkey"], limit=10)


@registered("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def order_limit_desc(spark, sf_dir):
    return S.query(table(spark, sf_dir, "orders"), ["o_orderkey", "o_totalprice"], order_by=("o_totalprice", True), ties=["o_orderkey"], limit=10)


@registered("SELECT n_name FROM nation ORDER BY NULLIF(n_regionkey, 0) ASC NULLS FIRST, n_nationkey LIMIT 7")
def order_nulls(spark, sf_dir):
    df = table(spark, sf_dir, "nation").withColumn("r", F.nullif("n_regionkey", F.lit(0)))
    return S.query(df, ["n_name"], order_by=("r", False), ties=["n_nationkey"], limit=7)


@registered("SELECT n_name FROM nation ORDER BY COALESCE(NULLIF(n_name, 'CHINA'), 'NULL'), n_nationkey LIMIT 16")
def order_nulls_text_compat(spark, sf_dir):
    df = table(spark, sf_dir, "nation").withColumn("name", F.nullif("n_name", F.lit("CHINA")))
    return S.query(df, ["n_name"], order_by=("name", False), ties=["n_nationkey"], limit=16, profile=COMPATIBLE)


@registered("SELECT n_name FROM nation ORDER BY NULLIF(n_regionkey, 0) DESC NULLS LAST, n_nationkey LIMIT 22")
def order_nulls_desc_hidden(spark, sf_dir):
    df = table(spark, sf_dir, "nation").withColumn("r", F.nullif("n_regionkey", F.lit(0)))
    return S.query(df, ["n_name"], order_by=("r", True), ties=["n_nationkey"], limit=22)


@registered("SELECT c_mktsegment, COUNT(*) AS n FROM customer GROUP BY 1 ORDER BY n DESC, c_mktsegment LIMIT 3")
def order_by_aggregate(spark, sf_dir):
    return S.query(table(spark, sf_dir, "customer"), aggregates=[("COUNT", None, "n")], group_by=["c_mktsegment"], order_by=("n", True), ties=["c_mktsegment"], limit=3)


@registered("SELECT p_size, COUNT(*) AS n FROM part GROUP BY p_size ORDER BY CAST(p_size AS VARCHAR) LIMIT 20")
def group_key_text_order(spark, sf_dir):
    groups = S.query(table(spark, sf_dir, "part"), aggregates=[("COUNT", None, "n")], group_by=["p_size"], order_by=("p_size", False), profile=COMPATIBLE)
    return S.limited(groups, 20)


@registered("SELECT SUM(l_quantity) AS total FROM (SELECT * FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey LIMIT 100)")
def limit_before_sum(spark, sf_dir):
    ties = ["l_orderkey", "l_linenumber", "l_partkey"]
    return S.query(table(spark, sf_dir, "lineitem"), aggregates=[("SUM", "l_quantity", "total")], order_by=("l_extendedprice", True), ties=ties, limit=100, profile=COMPATIBLE)


@registered("SELECT o_orderstatus, COUNT(*) AS n FROM (SELECT * FROM orders ORDER BY o_orderkey LIMIT 1000) GROUP BY 1")
def limit_before_group(spark, sf_dir):
    return S.query(table(spark, sf_dir, "orders"), aggregates=[("COUNT", None, "n")], group_by=["o_orderstatus"], limit=1000, ties=["o_orderkey"], profile=COMPATIBLE)


@registered("SELECT * FROM region")
def limit_zero_compat(spark, sf_dir):
    return S.query(table(spark, sf_dir, "region"), limit=0, profile=COMPATIBLE)


@registered("SELECT p_partkey, SUBSTR(p_brand, 7) AS brand_no FROM part ORDER BY CAST(SUBSTR(p_brand, 7) AS DOUBLE) DESC, p_partkey LIMIT 20")
def order_text_as_number(spark, sf_dir):
    df = table(spark, sf_dir, "part").withColumn("brand_no", F.expr("substr(p_brand, 7)"))
    return S.query(df, ["p_partkey", "brand_no"], order_by=("brand_no", True), ties=["p_partkey"], limit=20, profile=COMPATIBLE)


# changes of rows


@registered("SELECT * FROM region UNION ALL SELECT * FROM (VALUES (7, 'OCEANIA'), (8, 'it''s, new')) AS t(r_regionkey, r_name)")
def insert_post_state(spark, sf_dir):
    incoming = R.batch(spark, [("r_regionkey", "INT"), ("r_name", "VARCHAR")], [["7", "'OCEANIA'"], ["8", '"it\'s, new"']])
    return R.inserted(table(spark, sf_dir, "region"), incoming.withColumn("r_regionkey", F.col("r_regionkey").cast("int")), ["r_regionkey"])


@registered("SELECT * FROM nation UNION ALL SELECT 99, NULL, 3")
def insert_column_list(spark, sf_dir):
    df = table(spark, sf_dir, "nation")
    incoming = R.batch(spark, [("n_nationkey", "INT"), ("n_name", "VARCHAR"), ("n_regionkey", "INT")], [["3", "99"]], ["n_regionkey", "n_nationkey"])
    return R.inserted(df, incoming.select(*[F.col(f.name).cast(f.dataType) for f in df.schema]), ["n_nationkey"])


@registered("SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 49)")
def pk_violation_probe(spark, sf_dir):
    incoming = S.where(table(spark, sf_dir, "lineitem"), ("l_quantity", ">", 49.0)).select(F.col("l_orderkey").alias("o_orderkey"))
    return R.clashing_keys(table(spark, sf_dir, "orders"), incoming, ["o_orderkey"])


@registered(f"SELECT c_custkey, c_acctbal, CASE WHEN COALESCE(segment = 'MACHINERY', FALSE) THEN 'M' ELSE segment END AS segment FROM {SEGMENTS}")
def update_post_state(spark, sf_dir):
    return R.updated(segments(spark, sf_dir).select("c_custkey", "c_acctbal", "segment"), {"segment": "M"}, ("segment", "=", "MACHINERY"))


@registered(f"SELECT c_custkey, segment FROM {SEGMENTS} WHERE NOT COALESCE(segment = 'MACHINERY', FALSE)")
def delete_post_state(spark, sf_dir):
    return R.deleted(segments(spark, sf_dir).select("c_custkey", "segment"), ("segment", "=", "MACHINERY"))


@registered("SELECT COUNT_IF(segment IS NULL) AS updated, COUNT_IF(segment = 'MACHINERY') AS deleted, COUNT_IF(segment IS NULL OR segment <> 'MACHINERY') AS n_left, COUNT_IF(segment IS NULL) AS n_new FROM " + SEGMENTS)
def affected_rows(spark, sf_dir):
    with scratch(spark, segments(spark, sf_dir).select("c_custkey", "segment"), ["c_custkey"]) as name:
        changed = tables.update(spark, name, {"segment": "NEW"}, ("segment", "=", None)), tables.delete(spark, name, ("segment", "=", "MACHINERY"))
        after = tables.rows(spark, name)
        return spark.createDataFrame([(*changed, after.count(), S.where(after, ("segment", "=", "NEW")).count())], "updated long, deleted long, n_left long, n_new long")


@registered("SELECT COUNT(*) AS removed, 0::BIGINT AS n_left, 2 AS columns_kept FROM region")
def truncate_count(spark, sf_dir):
    with scratch(spark, table(spark, sf_dir, "region"), ["r_regionkey"]) as name:
        removed = tables.truncate(spark, name)
        after = tables.rows(spark, name)
        return spark.createDataFrame([(removed, after.count(), len(after.columns))], "removed long, n_left long, columns_kept int")


# changes of columns, keys


@registered("SELECT *, CAST(NULL AS DOUBLE) AS gpa, CAST(NULL AS VARCHAR) AS city FROM supplier")
def add_column(spark, sf_dir):
    return C.added(table(spark, sf_dir, "supplier"), [("gpa", "DOUBLE"), ("city", "VARCHAR")])


@registered("SELECT s_suppkey, s_name, s_nationkey FROM supplier")
def drop_column(spark, sf_dir):
    return C.dropped(table(spark, sf_dir, "supplier"), "s_acctbal", ["s_suppkey"])


@registered("SELECT c_custkey, CAST(c_nationkey AS DOUBLE) AS c_nationkey FROM customer")
def modify_column(spark, sf_dir):
    return C.modified(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), "c_nationkey", "DOUBLE")


@registered("SELECT p_partkey, TRY_CAST(SUBSTR(p_brand, 7) AS DOUBLE) AS p_brand, TRY_CAST(p_name AS DOUBLE) AS p_name FROM (SELECT p_partkey, p_brand, p_name FROM part)")
def modify_column_compat(spark, sf_dir):
    df = table(spark, sf_dir, "part").select("p_partkey", F.expr("substr(p_brand, 7)").alias("p_brand"), "p_name")
    return C.modified(C.modified(df, "p_brand", "DOUBLE", COMPATIBLE), "p_name", "DOUBLE", COMPATIBLE)


@registered("SELECT r_regionkey AS id, r_name FROM region")
def rename_column(spark, sf_dir):
    return C.renamed(table(spark, sf_dir, "region"), "r_regionkey", "id", ["r_regionkey"])[0]


@registered("SELECT l_orderkey, l_linenumber, COUNT(*) AS n FROM lineitem GROUP BY 1, 2 HAVING COUNT(*) > 1")
def add_pk_duplicates(spark, sf_dir):
    return R.repeated_keys(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@registered(f"SELECT COUNT(*) AS n FROM {SEGMENTS} WHERE segment IS NULL")
def add_pk_nulls(spark, sf_dir):
    return S.aggregated(R.null_keys(segments(spark, sf_dir), ["c_custkey", "segment"]), [("COUNT", None, "n")])


@registered("""
SELECT 1 AS position, 'n_nationkey' AS column_name, 'INT' AS data_type, 'PRIMARY KEY' AS key UNION ALL SELECT 2, 'n_name', 'VARCHAR', '' UNION ALL SELECT 3, 'n_regionkey', 'INT', ''
""")
def describe_table(spark, sf_dir):
    with scratch(spark, table(spark, sf_dir, "nation"), ["n_nationkey"]) as name:
        return local(tables.describe(spark, name))


@registered("SELECT 2 AS n_columns, COUNT(*) AS n_rows, '(r_regionkey, r_name)' AS primary_key FROM region")
def describe_details(spark, sf_dir):
    with scratch(spark, table(spark, sf_dir, "region"), ["r_regionkey", "r_name"]) as name:
        return local(tables.details(spark, name))


@registered("SELECT r_regionkey::BIGINT AS id, r_name, NULL::DOUBLE AS size FROM region")
def altered_table(spark, sf_dir):
    with scratch(spark, table(spark, sf_dir, "region").withColumn("extra", F.lit("x")), ["r_regionkey"]) as name:
        tables.drop_column(spark, name, "extra")
        tables.rename_column(spark, name, "r_regionkey", "id")
        tables.add_columns(spark, name, [("size", "VARCHAR")])
        tables.modify_column(spark, name, "size", "DOUBLE")
        tables.drop_primary_key(spark, name)
        tables.add_primary_key(spark, name, ["r_name"])
        return local(tables.rows(spark, name))


@registered("SELECT 1::BIGINT AS listed, 0::BIGINT AS under_old_name, COUNT(*) AS n_rows FROM region")
def renamed_table(spark, sf_dir):
    with scratch(spark, table(spark, sf_dir, "region"), ["r_regionkey"]) as name:
        tables.rename(spark, name, f"{name}_new")
        try:
            shown = tables.show_tables(spark)
            found = [shown.filter(F.col("table_name") == x).count() for x in (f"{name}_new", name)]
            return spark.createDataFrame([(*found, tables.rows(spark, f"{name}_new").count())], "listed long, under_old_name long, n_rows long")
        finally:
            tables.rename(spark, f"{name}_new", name)


@registered("SELECT * FROM nation")
def text_table(spark, sf_dir):
    """Written in the text form and read back; nation has 25 rows at any scale."""
    df = table(spark, sf_dir, "nation")
    with folder(spark) as path:
        text.write_rows(df, f"{path}/rows")
        text.write_columns(spark, f"{path}/columns", [("n_nationkey", "INT"), ("n_name", "VARCHAR"), ("n_regionkey", "INT")], ["n_nationkey"])
        back = text.read_rows(spark, f"{path}/rows", text.read_columns(spark, f"{path}/columns")["columns"])
        return local(back.select(*[F.col(f.name).cast(f.dataType) for f in df.schema]))