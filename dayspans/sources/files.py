"""Readers and writers of study files: delimiters, preambles, transposed records, many files of many entities, rejects."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, sep: str = ",", quote: str = '"', encoding: str = "UTF-8", pattern: str | None = None) -> DataFrame:
    """SC1, SC2, SC7, SC9: delimited text with a header; a schema spares the pass that infers one, ``pattern`` picks files by name."""
    r = spark.read.option("header", True).option("sep", sep).option("quote", quote).option("encoding", encoding)
    r = r.option("pathGlobFilter", pattern) if pattern else r
    return (r.schema(schema) if schema else r.option("inferSchema", True)).csv(path)


def with_entity(df: DataFrame, pattern: str = r"(\d+)", into: str = "entity", of: str = "file_name") -> DataFrame:
    """SC5: the entity's id from the file's name, or from its whole path; hidden files are never read by Spark."""
    return df.withColumn(into, F.regexp_extract(F.col(f"_metadata.{of}"), pattern, 1))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """SC3: the lines of text files: value, file, line (from 1), n_lines of the file.

    A file of any size is read split by split. The splits' line counts, summed up over the splits before, say where each
    split starts; within it lines are numbered by themselves. So no file's rows meet in one task, only a split's.
    """
    meta = F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_split")
    raw = spark.read.text(path).select("value", *meta, F.monotonically_increasing_id().alias("_i"))
    counts = spark.read.text(path).select(*meta).groupBy("file", "_split").agg(F.count("*").alias("_n"))
    before, whole = Window.partitionBy("file").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("file")
    starts = counts.select("file", "_split", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(whole).alias("n_lines"))
    own = F.row_number().over(Window.partitionBy("file", "_split").orderBy("_i"))
    return raw.withColumn("_own", own).join(starts, ["file", "_split"]).select("value", "file", (F.col("_before") + F.col("_own")).alias("line"), "n_lines")


def read_csv_skip(spark: SparkSession, path: str, schema: str, head: int = 0, foot: int = 0, sep: str = ",") -> DataFrame:
    """SC3: delimited text whose files have ``head`` lines before and ``foot`` lines after the data; adds file and line."""
    n = numbered_lines(spark, path)
    data = n.where((F.col("line") > head) & (F.col("line") <= F.col("n_lines") - foot))
    return data.select("file", "line", F.from_csv("value", F.lit(schema), {"sep": sep}).alias("r")).select("file", "line", "r.*")


def after_second_stamp(df: DataFrame, keys: list[str], order: Column, text: str, length: int = 18) -> DataFrame:
    """SC4: rows in reverse order from the second one on whose ``text`` has the length of a full time stamp."""
    w = Window.partitionBy(*keys).orderBy(order.desc()).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("_n", F.sum((F.length(text) == length).cast("int")).over(w)).where("_n >= 2").drop("_n")


def first_by_pattern(files: DataFrame, keys: list[str], patterns: list[str], path: str = "path") -> DataFrame:
    """SC6: of each key's files the one that fits the earliest pattern (ties: by name)."""
    rank = F.coalesce(*[F.when(F.col(path).rlike(p), i) for i, p in enumerate(patterns)])
    w = Window.partitionBy(*keys).orderBy("_rank", path)
    return files.withColumn("_rank", rank).where("_rank is not null").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_rank", "_n")


def records_from_rows(df: DataFrame, keys: list[str], name: str, values: list[str], fields: list[str]) -> DataFrame:
    """SC8: a file of one row per field and one column per record, as one row per record."""
    long = df.unpivot([*keys, name], values, "record", "value")
    return long.groupBy(*keys, "record").pivot(name, fields).agg(F.first("value"))


def write_days(df: DataFrame, path: str, by: tuple[str, ...] = ("date",)) -> None:
    """SC11, SC12: one folder per day, written again day by day: a rerun replaces only the days it has."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def latest_change(spark: SparkSession, path: str, schema: str) -> str | None:
    """SC12: when the newest file under a path was written, as ``read_newer`` takes it; None without files."""
    found = spark.read.schema(schema).parquet(path).select(F.max("_metadata.file_modification_time").cast("string")).first()
    return found[0] if found else None


def read_newer(spark: SparkSession, path: str, schema: str, after: str | None) -> DataFrame:
    """SC12: only files that changed after a moment, such as the last run's ``latest_change``, so that a run takes up what
    is new and skips the rest; all files without a moment."""
    r = spark.read.schema(schema)
    return (r.option("modifiedAfter", after.replace(" ", "T")) if after else r).parquet(path)


def listing(spark: SparkSession, path: str) -> DataFrame:
    """SC12: path, bytes and time of change of every file under a path, without reading any."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("changed"))


def pending(spark: SparkSession, path: str, manifest: str) -> DataFrame:
    """SC12: the files that no committed run has taken up in this size and of this time; all of them before the first commit."""
    found = listing(spark, path)
    return found.join(committed(spark, manifest), ["path", "bytes", "changed"], "left_anti")


def committed(spark: SparkSession, manifest: str) -> DataFrame:
    """SC12: what runs have taken up so far: path, bytes, changed, run."""
    fields = "path string, bytes long, changed timestamp, run string"
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(manifest)
    if not there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(there):
        return spark.createDataFrame([], fields)
    return spark.read.schema(fields).parquet(manifest)


def take_up(spark: SparkSession, path: str, manifest: str, read: Callable[[list[str]], DataFrame], write: Callable[[DataFrame], None], run: str) -> int:
    """SC12: read and write what is pending under ``path``, then commit it to the manifest; the number of files taken up.

    The listing is fixed before anything is read, and committed only after ``write`` is done: a run that fails commits
    nothing and takes up the same files again, a file that comes meanwhile waits for the next run, and one that is written
    in the same instant as others are committed is told from them by its path. ``write`` should replace what an earlier,
    failed attempt of the same ``run`` left.
    """
    todo = pending(spark, path, manifest).collect()  # one entry per new file, as a reader's list of paths needs them anyway
    if not todo:
        return 0
    write(read([r["path"] for r in todo]))
    spark.createDataFrame([(*r, run) for r in todo], "path string, bytes long, changed timestamp, run string").coalesce(1).write.mode("append").parquet(manifest)
    return len(todo)


def split_rejects(df: DataFrame, bad: Column) -> tuple[DataFrame, DataFrame]:
    """SC13: kept and rejected rows; a null condition keeps."""
    flag = F.coalesce(bad, F.lit(False))
    return df.where(~flag), df.where(flag)


def quality_counters(df: DataFrame, kept: Column, keys: list[str]) -> DataFrame:
    """SC14: one row of counts for the run report."""
    return df.agg(F.count("*").alias("n_rows"), F.count_if(kept).alias("n_kept"), F.round(F.avg(F.when(kept, 100.0).otherwise(0.0)), 6).alias("pct_kept"), *[F.countDistinct(k).alias(f"n_{k}") for k in keys])


def write_counted(df: DataFrame, path: str, kept: Column, sums: dict[str, Column] | None = None) -> dict[str, int | float]:
    """SC14: write the rows that are ``kept`` and return the run's counts, which the writing job itself takes in passing.

    n_rows, n_kept, pct_kept (null without rows), and per entry of ``sums`` its sum over all rows. No second scan. A null
    condition does not keep.
    """
    flag, seen = F.coalesce(kept, F.lit(False)), Observation()
    own = [F.sum(c).alias(name) for name, c in (sums or {}).items()]
    df.observe(seen, F.count(F.lit(1)).alias("n_rows"), F.count_if(flag).alias("n_kept"), *own).where(flag).write.parquet(path)
    got = seen.get
    return {**got, "pct_kept": 100.0 * got["n_kept"] / got["n_rows"] if got["n_rows"] else None}
