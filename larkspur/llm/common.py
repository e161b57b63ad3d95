"""What the corpus operators share: null rules, words, and tables in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words; everything else belongs to a word.
WORD_SPACE = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str | Column = "text") -> Column:
    """The text, a null one as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def fold(key: str | Column, n: int) -> Column:
    """crc32 of the key as text, modulo n; a null key counts as empty text."""
    key = F.col(key) if isinstance(key, str) else key
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % n


def words_of(text: Column) -> Column:
    """The words of a text as an array: `[^\\x20\\x09-\\x0D]+`."""
    bare = F.regexp_replace(text, rf"\A{WORD_SPACE}+|{WORD_SPACE}+\z", "")
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, f"{WORD_SPACE}+"))


def free_name(df: DataFrame, like: str) -> str:
    """A name like the given one that no column of df has, whatever its case."""
    taken, name = {c.lower() for c in df.columns}, f"_{like}"
    while name.lower() in taken:
        name = f"_{name}"
    return name


#: For bytes.translate: lower-cases A-Z only; UTF-8 bytes of other characters stay.
LOWER_BYTES = bytes(range(0x41)) + bytes(range(0x61, 0x7B)) + bytes(range(0x5B, 0x100))


def split_words(text: bytes) -> list[bytes]:
    """The same words of a UTF-8 text, in Python: bytes.split() without a separator cuts at exactly WORD_SPACE."""
    return text.split()


def split_lower(text: bytes) -> list[bytes]:
    """Those words with A-Z lower-cased."""
    return text.translate(LOWER_BYTES).split()


def key_bounds(docs: DataFrame, key: str, parts: int) -> list:
    """Keys that cut the table into at most `parts` ranges of about equal size: each is some row's key, the last the largest.

    Only the key column is read, and only the bounds come to the driver, as for any range partitioning.
    """
    probabilities = [(i + 1) / parts for i in range(parts)]
    found = docs.agg(F.percentile_approx(key, probabilities, F.lit(max(1000, 20 * parts))).alias("at"), F.max(key).alias("top")).first()
    return sorted({*(found["at"] or []), *([found["top"]] if found["top"] is not None else [])})


def range_of(key: str | Column, bounds: list) -> Column:
    """The number of the range that a key is in: how many bounds lie below it. Null keys are in the first range."""
    key = F.col(key) if isinstance(key, str) else key
    if not bounds:
        return F.lit(0)
    return F.when(key.isNull(), F.lit(0)).otherwise(F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b < key)))


#: Bytes of rows that go to Python at once. Rows that hold texts are large: Spark's own bound lets a task hold several times more.
BATCH_BYTES = 8 << 20


def for_python(df: DataFrame) -> DataFrame:
    """The same rows, in a session that hands rows to Python in batches of at most BATCH_BYTES."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see. A local session without one gets a temporary folder; on a cluster it must be set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors see")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


#: Has Spark delete a query's shuffle files when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def save(df: DataFrame, path: str) -> None:
    """Writes the rows as Parquet. What they were shuffled through is deleted: nothing that is lost later is made from it again."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP)
    conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(CLEANUP, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder: computed once, and still there when an executor is lost."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    save(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared store, whatever file system that is."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def discarded(*tables: DataFrame) -> None:
    """Deletes written tables that no later query reads."""
    for t in tables:
        for folder in {x.rpartition("/")[0] for x in t.inputFiles()}:
            removed(t.sparkSession, folder)
