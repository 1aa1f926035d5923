"""Fragmentation: normalised entropy of a day's episode durations, and what is reported with it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.quantiles import exact_percentiles


def fragmentation_index(episodes: DataFrame, keys: list[str], minutes: Column, *, min_episodes: int = 1, max_minutes: float | None = None, trim_sd: float = 3.0, trim_above: int = 2) -> DataFrame:
    """FR1, FR2: per key index, count, total, mean, sd, cv and status.

    Durations that are null or not positive (or above ``max_minutes``) do not count. Of more than ``trim_above``
    durations those further than ``trim_sd`` sample deviations from the mean go; with ``trim_above`` 0 a single duration,
    which has no deviation, goes too. The index is the entropy of the shares of time over its maximum, 0 for one episode.
    """
    ok = F.col("_m").isNotNull() & (F.col("_m") > 0)
    if max_minutes is not None:
        ok = ok & (F.col("_m") <= max_minutes)
    d = episodes.withColumn("_m", minutes).withColumn("_m", F.when(ok, F.col("_m")))
    w = Window.partitionBy(*keys)
    d = d.withColumns({"_n": F.count("_m").over(w), "_mean": F.avg("_m").over(w), "_sd": F.stddev_samp("_m").over(w)})
    inside = F.coalesce(F.abs(F.col("_m") - F.col("_mean")) <= trim_sd * F.col("_sd"), F.lit(False))
    d = d.withColumn("_k", F.when((F.col("_n") <= trim_above) | inside, F.col("_m")))
    d = d.withColumn("_p", F.col("_k") / F.sum("_k").over(w))
    g = d.groupBy(*keys).agg(F.max("_n").alias("_n"), F.count("_k").alias("episode_count"), F.sum("_k").alias("total_duration"), F.avg("_k").alias("mean_duration"), F.coalesce(F.stddev_samp("_k"), F.lit(0.0)).alias("std_duration"), F.sum(-F.col("_p") * F.log("_p")).alias("_h"))
    n = F.col("episode_count")
    few = F.concat(F.lit("insufficient_episodes_"), F.col("_n").cast("string"))
    status = F.when(F.col("_n") == 0, "no_valid_episodes").when(F.col("_n") < min_episodes, few).when(n < F.greatest(F.lit(min_episodes), F.lit(1)), "insufficient_episodes_after_outlier_removal").otherwise("success")
    good = status == "success"
    val = lambda x, digits=6: F.round(F.when(good, x), digits)
    index = F.when(n == 1, 0.0).otherwise(F.col("_h") / F.log(F.when(n > 1, n)))
    return g.select(*keys, val(index).alias("fragmentation_index"), n.alias("episode_count"), val(F.col("total_duration"), 10).alias("total_duration"), val(F.col("mean_duration"), 10).alias("mean_duration"), val(F.col("std_duration")).alias("std_duration"), val(F.col("std_duration") / F.col("mean_duration")).alias("cv"), status.alias("status"))


def delta(home: Column, overlap: Column, reverse: bool = False) -> Column:
    """FR5: home less overlap, null if either is; the other sign on demand."""
    return overlap - home if reverse else home - overlap


def minutes_by(df: DataFrame, keys: list[str], column: str, values: list[str], minutes: Column) -> DataFrame:
    """FR6, AG16: minutes of each value as columns."""
    return df.groupBy(*keys).agg(*[F.round(F.sum(F.when(F.col(column) == x, minutes).otherwise(0.0)), 8).alias(f"{x}_duration") for x in values])


def out_of_home(points: DataFrame, home: DataFrame, keys: list[str]) -> DataFrame:
    """AG16: minutes from the first point to the last, in home episodes, and the rest. ``points``: us; ``home``: start_us, end_us."""
    span = points.groupBy(*keys).agg(((F.max("us") - F.min("us")) / 60_000_000).alias("_span"))
    own = home.groupBy(*keys).agg((F.sum(F.col("end_us") - F.col("start_us")) / 60_000_000).alias("_home"))
    at_home = F.coalesce("_home", F.lit(0.0))
    return span.join(own, keys, "left").select(*keys, F.round("_span", 8).alias("observed_minutes"), F.round(at_home, 8).alias("home_minutes"), F.round(F.col("_span") - at_home, 8).alias("out_of_home_minutes"))


def wide(df: DataFrame, keys: list[str], types: list[str], metrics: list[str]) -> DataFrame:
    """FR7, AG12: one row per key with every type's metrics under its prefix."""
    out = [F.max(F.when(F.col("type") == t, F.col(m))).alias(f"{t}_{m}") for t in types for m in metrics]
    return df.groupBy(*keys).agg(*out)


def status_rates(df: DataFrame) -> DataFrame:
    """FR9: per type and status the rows and their share in per cent."""
    g = df.groupBy("type", "status").agg(F.count("*").alias("n"))
    return g.withColumn("pct", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy("type")), 6))


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """FR10: valid rows, mean, median, sd, extremes and quartiles, a row per column; all but the quantiles in one pass."""
    long = df.unpivot([], columns, "variable", "value").where("value is not null")
    quartiles = [(c, *exact_percentiles(df, c, [0.5, 0.25, 0.75])) for c in columns]
    q = df.sparkSession.createDataFrame(quartiles, "variable string, median double, q25 double, q75 double")
    g = long.groupBy("variable").agg(F.count("*").alias("n_valid"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_samp("value"), 6).alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))
    return g.join(F.broadcast(q), "variable").select("variable", "n_valid", "mean", F.round("median", 6).alias("median"), "std", "min", "max", F.round("q25", 6).alias("q25"), F.round("q75", 6).alias("q75"))


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """FR11: Pearson's r of every pair of columns over the rows that have both, in one pass."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    one = df.agg(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.round(F.corr(a, b), 6).alias("r"), F.count_if(F.col(a).isNotNull() & F.col(b).isNotNull()).alias("n")).alias(f"p{i}") for i, (a, b) in enumerate(pairs)])
    return one.select(F.explode(F.array(*[F.col(f"p{i}") for i in range(len(pairs))])).alias("p")).select("p.*")


def histogram(df: DataFrame, column: str, bins: int, lo: float, hi: float) -> DataFrame:
    """FR12: rows in each of ``bins`` equal ranges; the upper end belongs to the last."""
    b = F.least(F.width_bucket(column, F.lit(lo), F.lit(hi), F.lit(bins)), F.lit(bins))
    return df.where(F.col(column).between(lo, hi)).groupBy(b.cast("int").alias("bin")).agg(F.count("*").alias("n"))
