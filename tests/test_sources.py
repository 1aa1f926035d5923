"""Readers and writers of files: lines of split files, manifests, counts in flight."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from dayspans.sources import files


@pytest.fixture()
def small_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def test_lines_of_a_file_of_many_splits(spark, tmp_path, small_splits):
    rows = {f"f{i}.txt": [f"{i};{j};" + "x" * (j % 90) for j in range(n)] for i, n in enumerate((400, 9, 3, 0, 1))}
    for name, lines in rows.items():
        body = ["head"] * 2 + lines + ["foot"] if name != "f3.txt" else lines
        (tmp_path / name).write_text("\n".join(body))
    read = files.numbered_lines(spark, str(tmp_path))
    assert spark.read.text(str(tmp_path)).select(F.col("_metadata.file_block_start").alias("b")).distinct().count() > 8
    got = {}
    for r in read.collect():
        got.setdefault(os.path.basename(r["file"]), {})[r["line"]] = (r["value"], r["n_lines"])
    for name, lines in rows.items():
        body = ["head"] * 2 + lines + ["foot"] if name != "f3.txt" else lines
        assert got.get(name, {}) == {i + 1: (x, len(body)) for i, x in enumerate(body)}
    data = files.read_csv_skip(spark, str(tmp_path), "i int, j int, x string", 2, 1, ";").select("i", "j", "line").collect()
    assert sorted(map(tuple, data)) == sorted((i, j, j + 3) for i, n in enumerate((400, 9, 3, 0, 1)) if i != 3 for j in range(n))
    plan = read._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.split("\n") if "row_number()" in line and "Window" in line]
    assert windows and all("_split" in w for w in windows)  # no window of rows over a whole file


def test_manifest_takes_up_each_file_once(spark, tmp_path):
    data, manifest, out = (f"{tmp_path}/{n}" for n in ("data", "manifest", "out"))
    os.makedirs(data)
    read = lambda paths: spark.read.schema("x long").parquet(*paths)
    write = lambda run: lambda d: d.write.mode("overwrite").parquet(f"{out}/run={run}")
    put = lambda n: spark.range(n, n + 3).select(F.col("id").alias("x")).coalesce(1).write.mode("append").parquet(data)
    taken = lambda: sorted((r["run"], r["x"]) for r in spark.read.parquet(out).collect())
    put(0)
    assert files.take_up(spark, data, manifest, read, write(1), "1") == 1
    put(10)
    put(20)
    now = 1_700_000_000
    for f in os.listdir(data):  # all of them of one instant
        os.utime(f"{data}/{f}", (now, now))
    assert files.pending(spark, data, manifest).count() == 3  # a changed time is a change
    with pytest.raises(RuntimeError):
        files.take_up(spark, data, manifest, read, lambda d: (_ for _ in ()).throw(RuntimeError()), "2")
    assert files.committed(spark, manifest).count() == 1  # a failed run commits nothing
    assert files.take_up(spark, data, manifest, read, write(2), "2") == 3
    put(30)
    for f in os.listdir(data):
        os.utime(f"{data}/{f}", (now, now))
    assert files.take_up(spark, data, manifest, read, write(3), "3") == 1  # written in the same instant, still told apart
    assert files.take_up(spark, data, manifest, read, write(4), "4") == 0
    assert taken() == [(1, 0), (1, 1), (1, 2), *[(2, x) for n in (0, 10, 20) for x in range(n, n + 3)], (3, 30), (3, 31), (3, 32)]


def test_counts_come_from_the_job_that_writes(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def touched(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    d = spark.range(100).mapInPandas(touched, "id long").withColumn("ok", F.when(F.col("id") % 10 != 0, F.col("id") % 3 == 0))
    got = files.write_counted(d, f"{tmp_path}/kept", F.col("ok"), {"total": F.col("id")})
    kept = [i for i in range(100) if i % 10 and i % 3 == 0]
    assert got == {"n_rows": 100, "n_kept": len(kept), "total": 4950, "pct_kept": float(len(kept))} and seen.value == 100
    assert sorted(r["id"] for r in spark.read.parquet(f"{tmp_path}/kept").collect()) == kept
    assert files.write_counted(d.where("false"), f"{tmp_path}/none", F.col("ok"))["pct_kept"] is None
