"""Helpers shared by the training-data operators: shared scratch tables and skew-safe ranks."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word, as Java's and Python's regular expressions write it.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows up to which a lookup table is broadcast; larger ones go through a shuffled join.
BROADCAST_ROWS = 50_000

#: A key is hot with more rows than this, and than its share of all rows if one in HOT_KEYS had that many: never more hot keys than that.
HOT_ROWS, HOT_KEYS = 1_000, 20_000

#: Rows that go to Python at a time where they hold whole texts: Spark's own number of 10,000 would be a gigabyte of long ones.
BATCH_ROWS = 1_000

#: Rows in one bucket of a key, at least.
LEAST_BUCKET = 256


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors share.

    It is the one named in ``spark.checkpoint.dir``. Only where that is unset and Spark runs on one machine, as in tests,
    a temporary folder is made, which goes when the driver's Python ends; on a cluster that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not found:
        found = tempfile.mkdtemp(prefix="dayspans-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def stash_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"


def stash(df: DataFrame, tag: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = stash_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def maybe_broadcast(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast hint for a table of a counted size; beyond the bound the join is left to the planner."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def join_hot(rows: DataFrame, table: DataFrame, key: str, total: int, how: str = "inner") -> DataFrame:
    """Join with a table of one row per key that says in ``n_rows`` how many of ``rows`` have it; ``how`` is inner or left.

    Rows of hot keys meet their few keys by broadcast where they are, the others by a shuffle, so that a key with a third
    of all rows is no task of its own. Both inputs should be stored tables, for they are read twice. Drops ``n_rows``.
    """
    hot = table.where(F.col("n_rows") > max(HOT_ROWS, total // HOT_KEYS)).drop("n_rows")
    if hot.isEmpty():
        return rows.join(table.drop("n_rows"), key, how)
    cold = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(table.drop("n_rows"), key, how)
    return rows.join(F.broadcast(hot), key).unionByName(cold)


def bounded_batches(spark: SparkSession) -> None:
    """Send rows to Python in batches of BATCH_ROWS from now on, unless the session has a number of its own. No result depends on it."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(BATCH_ROWS))


def n_words(text: Column) -> Column:
    """Words of a text; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def bound(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body``; a plain reference inside a lambda would be evaluated per element."""
    return F.transform(F.array(value), body)[0]


def free(df: DataFrame, name: str) -> str:
    """``name``, lengthened until the table has no column of that name in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def packed_row(df: DataFrame) -> Column:
    """A row's columns as one struct, beside which an operator's own columns cannot clash with them."""
    return F.struct(*[F.col(f"`{c.replace('`', '``')}`") for c in df.columns])


def buckets(n: str) -> str:
    """SQL: buckets to deal ``n`` rows of a key to. Their number and their size grow with the root of ``n``."""
    return f"cast(ceil({n} / greatest({LEAST_BUCKET}D, sqrt({n}))) as bigint)"


def sampled(hashed: Column, most: int, n: int) -> Column:
    """Whether a row is among about ``most`` of ``n``, by its 64-bit hash; all are if there are no more. Never none, however many rows."""
    if n <= most:
        return F.lit(True)
    return hashed.bitwiseAND(F.lit((1 << 63) - 1)) < F.lit(max(1, (most << 63) // n))


def running(df: DataFrame, keys: list[str], bucket: str, order: list, amount: Column, name: str) -> DataFrame:
    """Exclusive running sum of ``amount`` within ``keys``, in order of (``bucket``, ``order``).

    Works bucket by bucket, so that a key with a third of all rows is spread over many tasks: a window inside each
    bucket and one over the buckets' sums. ``df`` should be a stored table, for it is read twice.
    """
    cells = [*keys, bucket]
    inside = Window.partitionBy(*cells).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy(*cells).agg(F.sum(amount).alias("_sum")).select(*cells, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    return df.withColumn("_in", F.sum(amount).over(inside) - amount).join(sums, cells).withColumn(name, (F.col("_in") + F.col("_before")).cast("long")).drop("_in", "_before")
