"""Queries of the readers and writers; files are derived from the given tables in the shared folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import functions as F

from ..sources import files
from .registry import query

c = F.col


def place(v, name: str) -> str:
    """A new folder for a query's files, in the folder that the cluster shares."""
    shared = v.spark.conf.get("spark.checkpoint.dir", None) or v.spark.sparkContext.getCheckpointDir()
    if not shared:
        if not v.spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = tempfile.mkdtemp(prefix="dayspans-")
        atexit.register(shutil.rmtree, shared, ignore_errors=True)
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("sc1_csv", "SELECT user_id, raw_id, gender_raw FROM v_demo")
def _(v):
    path = place(v, "csv")
    v.demo.select("user_id", "raw_id", "gender_raw").write.option("header", True).csv(path)
    return files.read_csv(v.spark, path, "user_id long, raw_id string, gender_raw string")


@query("sc2_csv_options", "SELECT user_id, raw_id || ';' || class_name AS label FROM v_demo")
def _(v):
    path = place(v, "csv")
    v.demo.select("user_id", F.concat_ws(";", "raw_id", "class_name").alias("label")).write.option("header", True).option("sep", ";").option("quote", "'").option("encoding", "ISO-8859-1").csv(path)
    return files.read_csv(v.spark, path, "user_id long, label string", sep=";", quote="'", encoding="ISO-8859-1")


def with_margins(d, path: str, n: int) -> None:
    """Write user_id and gender_raw to ``n`` files, each with 6 lines before and 1 line after its rows."""
    rows = d.select(F.pmod(F.xxhash64("user_id"), F.lit(n)).alias("f"), F.lit(1).alias("part"), "user_id", F.concat_ws(";", c("user_id").cast("string"), "gender_raw").alias("value"))
    margin = lambda part, text, times: d.sparkSession.range(n).select(c("id").alias("f"), F.lit(part).alias("part"), F.explode(F.array_repeat(F.lit(0).cast("long"), times)).alias("user_id"), F.lit(text).alias("value"))
    text = rows.unionByName(margin(0, "head", 6)).unionByName(margin(2, "foot", 1))
    text.repartition("f").sortWithinPartitions("f", "part", "user_id").select("f", "value").write.partitionBy("f").text(path)


def margins_skipped(v, d):
    path = place(v, "txt")
    with_margins(d, path, 4 + d.count() // 1000)
    return files.read_csv_skip(v.spark, path, "user_id long, gender_raw string", 6, 1, ";").select("user_id", "gender_raw")


@query("sc3_csv_skip", "SELECT user_id, gender_raw FROM v_demo")
def _(v):
    return margins_skipped(v, v.demo)


@query("sc4_after_second_stamp", "WITH n AS (SELECT user_id, event_id, sum(CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id DESC ROWS UNBOUNDED PRECEDING) AS n FROM v_points) SELECT user_id, event_id FROM n WHERE n >= 2")
def _(v):
    d = v.points.withColumn("Time", F.when(c("event_id") % 3 == 0, "2024-01-01 10:00:0").otherwise("10:00"))
    return files.after_second_stamp(d, ["user_id"], c("event_id"), "Time").select("user_id", "event_id")


@query("sc5_entity_files", "SELECT CAST(user_id % 5 AS VARCHAR) AS entity, count(*) AS n FROM v_demo GROUP BY ALL")
def _(v):
    path = place(v, "entities")
    v.demo.withColumn("p", c("user_id") % 5).write.partitionBy("p").parquet(path)
    d = v.spark.read.schema("user_id long").option("recursiveFileLookup", True).parquet(path)
    return files.with_entity(d, r"/p=(\d+)/", of="file_path").groupBy("entity").agg(F.count("*").alias("n"))


@query("sc6_first_by_pattern", "SELECT user_id, CASE WHEN user_id % 2 = 0 THEN 'a_reduced.csv' ELSE 'b_full.csv' END AS path FROM v_demo")
def _(v):
    names = F.when(c("user_id") % 2 == 0, F.array(F.lit("b_full.csv"), F.lit("a_reduced.csv"))).otherwise(F.array(F.lit("b_full.csv"), F.lit("c_other.txt")))
    d = v.demo.select("user_id", F.explode(names).alias("path"))
    return files.first_by_pattern(d, ["user_id"], ["educed", "full"])


@query("sc7_name_filter", "SELECT user_id FROM v_demo WHERE user_id % 3 = 1")
def _(v):
    path = place(v, "names")
    for i, name in enumerate(("one", "bouts", "old")):
        v.demo.where(c("user_id") % 3 == i).select("user_id").write.parquet(f"{path}/{name}.parquet")
    return v.spark.read.schema("user_id long").option("recursiveFileLookup", True).parquet(path).where(F.col("_metadata.file_path").contains("bou")).select("user_id")


@query("sc8_records", "SELECT user_id, 'r1' AS record, CAST(count(*) AS VARCHAR) AS n, CAST(min(event_id) AS VARCHAR) AS first FROM v_points GROUP BY user_id UNION ALL SELECT user_id, 'r2', CAST(count(DISTINCT date) AS VARCHAR), CAST(max(event_id) AS VARCHAR) FROM v_points GROUP BY user_id")
def _(v):
    g = v.points.groupBy("user_id").agg(F.count("*").alias("a"), F.min("event_id").alias("b"), F.countDistinct("date").alias("x"), F.max("event_id").alias("y"))
    rows = g.select("user_id", F.explode(F.array(F.struct(F.lit("n").alias("field"), c("a").cast("string").alias("r1"), c("x").cast("string").alias("r2")), F.struct(F.lit("first").alias("field"), c("b").cast("string").alias("r1"), c("y").cast("string").alias("r2")))).alias("s")).select("user_id", "s.*")
    return files.records_from_rows(rows, ["user_id"], "field", ["r1", "r2"], ["n", "first"])


@query("sc9_pruned", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity > 45")
def _(v):
    return v.table("lineitem").where("l_quantity > 45").select("l_orderkey", "l_quantity")


@query("sc10_row_limit", "SELECT event_id FROM v_points ORDER BY event_id LIMIT 100")
def _(v):
    return v.points.select("event_id").orderBy("event_id").limit(100)


@query("sc11_day_folders", "SELECT date, count(*) AS n FROM v_points GROUP BY date")
def _(v):
    path = place(v, "days")
    files.write_days(v.points.select("event_id", "date"), path)
    return v.spark.read.schema("event_id long, date date").parquet(path).groupBy("date").agg(F.count("*").alias("n"))


def rewritten(v, path: str) -> str | None:
    """All days, then one of them again with a single row; returns when the first write was done."""
    d = v.points.select("event_id", "date")
    files.write_days(d, path)
    done = files.latest_change(v.spark, path, "event_id long, date date")
    files.write_days(d.where("date = date'2024-01-05'").groupBy("date").agg(F.min("event_id").alias("event_id")).select("event_id", "date"), path)
    return done


@query("sc12_rewritten_day", "SELECT date, CASE WHEN date = DATE '2024-01-05' THEN 1 ELSE count(*) END AS n FROM v_points GROUP BY date")
def _(v):
    path = place(v, "days")
    rewritten(v, path)
    return files.read_newer(v.spark, path, "event_id long, date date", None).groupBy("date").agg(F.count("*").alias("n"))


@query("sc12_newer_only", "SELECT date, min(event_id) AS event_id FROM v_points WHERE date = DATE '2024-01-05' GROUP BY date")
def _(v):
    path = place(v, "days")
    done = rewritten(v, path)
    return files.read_newer(v.spark, path, "event_id long, date date", done).select("date", "event_id")


@query("sc12_manifest", "WITH d AS (SELECT event_id, CAST(event_id % 3 AS INTEGER) AS part FROM v_points) SELECT part + 1 AS run, CAST(count(*) AS BIGINT) AS n, min(event_id) AS first, max(event_id) AS last FROM d WHERE part < 2 GROUP BY part UNION ALL SELECT 3, 0, NULL, NULL")
def _(v):
    """Two deliveries, each taken up once however close in time, and a run that finds nothing new."""
    path, manifest, out = place(v, "delivered"), place(v, "manifest"), place(v, "taken")
    d = v.points.select("event_id", (c("event_id") % 3).cast("int").alias("part"))
    for run in (1, 2, 3):
        if run < 3:
            d.where(c("part") == run - 1).select("event_id").write.mode("append").parquet(path)
        files.take_up(v.spark, path, manifest, lambda paths: v.spark.read.schema("event_id long").parquet(*paths), lambda x: x.write.mode("overwrite").parquet(f"{out}/run={run}"), str(run))  # noqa: B023
    taken = v.spark.read.schema("event_id long, run int").parquet(out).groupBy("run").agg(F.count("*").alias("n"), F.min("event_id").alias("first"), F.max("event_id").alias("last"))
    runs = v.spark.createDataFrame([(i,) for i in (1, 2, 3)], "run int")
    return runs.join(taken, "run", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


@query("sc13_rejects", "SELECT event_id, CASE WHEN accuracy > 100 THEN 'rejected' ELSE 'kept' END AS kind FROM v_gps")
def _(v):
    kept, rejected = files.split_rejects(v.gps, c("accuracy") > 100)
    return kept.select("event_id", F.lit("kept").alias("kind")).union(rejected.select("event_id", F.lit("rejected")))


@query("sc14_counters", "SELECT count(*) AS n_rows, count(*) FILTER (WHERE accuracy <= 100) AS n_kept, round(avg(CASE WHEN accuracy <= 100 THEN 100.0::DOUBLE ELSE 0 END), 6) AS pct_kept, count(DISTINCT user_id) AS n_user_id, count(DISTINCT date) AS n_date FROM v_gps")
def _(v):
    return files.quality_counters(v.gps, c("accuracy") <= 100, ["user_id", "date"])


@query("sc14_counts_in_flight", "SELECT count(*) AS n_rows, count(*) FILTER (WHERE accuracy <= 100) AS n_kept, round(100.0::DOUBLE * count(*) FILTER (WHERE accuracy <= 100) / count(*), 6) AS pct_kept, count(*) FILTER (WHERE source = 'phone') AS n_phone, count(*) FILTER (WHERE accuracy <= 100) AS n_written FROM v_gps")
def _(v):
    path = place(v, "counted")
    seen = files.write_counted(v.gps.select("event_id", "accuracy", "source"), path, c("accuracy") <= 100, {"n_phone": (c("source") == "phone").cast("long")})
    row = [(seen["n_rows"], seen["n_kept"], round(seen["pct_kept"], 6), seen["n_phone"])] if seen["n_rows"] else [(0, 0, None, 0)]
    report = v.spark.createDataFrame(row, "n_rows long, n_kept long, pct_kept double, n_phone long")
    written = v.spark.read.schema("event_id long").parquet(path).agg(F.count("*").alias("n_written"))
    return report.crossJoin(F.broadcast(written))


@query("sc15_constant_columns", "SELECT 'studyA' AS study, user_id, 'gps' AS kind FROM v_demo")
def _(v):
    return v.demo.select(F.lit("studyA").alias("study"), "user_id").withColumn("kind", F.lit("gps"))
