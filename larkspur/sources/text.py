"""Tables kept as text: rows of comma-joined fields without a header, NULL for a missing value, and columns in a JSON file."""

from __future__ import annotations

import json
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.functions.compat import NULL_WORD
from larkspur.operators.rows import type_of


def read_columns(spark: SparkSession, path: str) -> dict:
    """columns and primary_key of a JSON file; a key given as a bare string is a list of one."""
    text = "\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())
    about = json.loads(text)
    key = about.get("primary_key")
    return {"columns": about["columns"], "primary_key": [key] if isinstance(key, str) else key}


def write_columns(spark: SparkSession, path: str, columns: list, primary_key: list | None = None) -> None:
    """The same form, as one JSON file in a folder."""
    text = json.dumps({"columns": [list(c) for c in columns], "primary_key": list(primary_key) if primary_key else None})
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)


def read_rows(spark: SparkSession, path: str, columns: list) -> DataFrame:
    """Typed rows; a field that doesn't fit its type is an error, as fields of a row too many or few are."""
    schema = T.StructType([T.StructField(c, type_of(t)) for c, t in columns])
    return spark.read.csv(path, schema=schema, nullValue=NULL_WORD, emptyValue="", quote="", mode="FAILFAST", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def write_rows(df: DataFrame, path: str) -> None:
    """The same form. Text that is empty, the word NULL, or has a comma or line end can't be written in it and is an error."""
    texts = [F.col(f"`{f.name}`").rlike(rf"[,\n\r]|\A\z|\A{NULL_WORD}\z") for f in df.schema if isinstance(f.dataType, T.StringType)]
    if texts and not df.filter(reduce(or_, texts)).isEmpty():
        raise ValueError("text that is empty, NULL, or has a comma or line end has no form in a text table")
    df.write.csv(path, nullValue=NULL_WORD, emptyValue="", quote="")
