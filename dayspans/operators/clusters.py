"""Density clusters and constant runs on one time axis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import spread_over, window_join

#: Minutes of one bucket of time, by which intervals meet.
BUCKET = 1440


def density_clusters(df: DataFrame, key: str, minute: Column, eps: int = 5, min_samples: int = 3) -> DataFrame:
    """CL1, CL2: exact DBSCAN in one dimension over the rows given: key, cluster (by time), first and last minute, n.

    A row with ``min_samples`` rows within ``eps`` (itself counted) is core; cores no further apart than ``eps`` are one
    cluster; another row within ``eps`` of a core joins the earlier of its clusters.
    """
    d = df.withColumn("_m", minute)
    near = Window.partitionBy(key).orderBy("_m").rangeBetween(-eps, eps)
    d = d.withColumn("_core", F.count("*").over(near) >= min_samples)
    upto = Window.partitionBy(key).orderBy("_m").rangeBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy(key).orderBy("_m").rangeBetween(0, Window.unboundedFollowing)
    cores = d.where("_core").select(key, "_m").distinct()
    w = Window.partitionBy(key).orderBy("_m")
    cores = cores.withColumn("_new", F.coalesce(F.col("_m") - F.lag("_m").over(w) > eps, F.lit(True)).cast("int"))
    cores = cores.withColumn("_c", F.sum("_new").over(w)).select(key, "_m", "_c")
    d = d.withColumns({"_prev": F.max(F.when(F.col("_core"), F.col("_m"))).over(upto), "_next": F.min(F.when(F.col("_core"), F.col("_m"))).over(after)})
    at = F.when(F.col("_m") - F.col("_prev") <= eps, F.col("_prev")).when(F.col("_next") - F.col("_m") <= eps, F.col("_next"))
    d = d.withColumn("_at", at).where("_at is not null")
    c = cores.select(F.col(key).alias("_k"), F.col("_m").alias("_cm"), "_c")
    j = d.join(c, (d[key] == c["_k"]) & (F.col("_at") == F.col("_cm")))
    return j.groupBy(key, F.col("_c").alias("cluster")).agg(F.min("_m").alias("start_minute"), F.max("_m").alias("end_minute"), F.count("*").alias("n"))


def cluster_counts(clusters: DataFrame, rows: DataFrame, key: str, stressed: Column) -> DataFrame:
    """CL1: rows of all kinds in each cluster's time, how many are stressed, and their share in per cent."""
    r = rows.select(key, F.col("minute").alias("_t"), stressed.cast("int").alias("_s"))
    j = window_join(r, clusters.select(key, "cluster", "start_minute", "end_minute"), [key], "_t", "start_minute", "end_minute", BUCKET)
    g = j.groupBy(key, "cluster", "start_minute", "end_minute").agg(F.count("*").alias("n_rows"), F.sum("_s").alias("n_stress"))
    return g.withColumns({"n_other": F.col("n_rows") - F.col("n_stress"), "pct_stress": F.round(F.col("n_stress") * 100.0 / F.col("n_rows"), 6)})


def constant_runs(df: DataFrame, key: str, on: Column, min_minutes: int = 5) -> DataFrame:
    """CL3: runs of rows where ``on`` holds that last long enough: start, end, n. ``df``: minute, event_id."""
    w = Window.partitionBy(key).orderBy("minute", "event_id")
    d = df.withColumn("_on", F.coalesce(on, F.lit(False)))
    d = d.withColumn("_run", F.sum(F.coalesce(F.col("_on") != F.lag("_on").over(w), F.lit(True)).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    g = d.where("_on").groupBy(key, "_run").agg(F.min("minute").alias("start_minute"), F.max("minute").alias("end_minute"), F.count("*").alias("n")).drop("_run")
    return g.where(F.col("end_minute") - F.col("start_minute") >= min_minutes)


def hit_by(df: DataFrame, other: DataFrame, key: str, strict: bool) -> DataFrame:
    """The distinct intervals of ``df`` that overlap one of ``other``; ``strict`` leaves out those that only touch.

    Both go to the buckets of time that they touch and meet by key and bucket.
    """
    own = spread_over(df.select(key, "start_minute", "end_minute").distinct(), "start_minute", "end_minute", BUCKET)
    o = spread_over(other.select(key, F.col("start_minute").alias("_s"), F.col("end_minute").alias("_e")), "_s", "_e", BUCKET)
    s, e = F.col("start_minute"), F.col("end_minute")
    hit = (s < F.col("_e")) & (F.col("_s") < e) if strict else (s <= F.col("_e")) & (F.col("_s") <= e)
    return own.join(o, [key, "_bucket"]).where(hit).select(key, "start_minute", "end_minute").distinct()


def without_overlaps(df: DataFrame, other: DataFrame, key: str, min_minutes: int = 0) -> DataFrame:
    """CL4: intervals that overlap none of the others (touching is allowed) and are long enough."""
    return df.join(hit_by(df, other, key, True), [key, "start_minute", "end_minute"], "left_anti").where(F.col("end_minute") - F.col("start_minute") >= min_minutes)


def with_overlaps(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """CL5: intervals that overlap or touch one of the others."""
    return df.join(hit_by(df, other, key, False), [key, "start_minute", "end_minute"], "left_semi")
