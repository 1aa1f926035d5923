"""Queries against their SQL on small tables of values that the given ones are too small to hold."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from oracle import compare, connect

from dayspans.plans import registry


def put(folder, name: str, **columns) -> str:
    pq.write_table(pa.table(columns), f"{folder}/{name}.parquet")
    return str(folder)


def matches(spark, name: str, data: str) -> str:
    return compare(spark, connect(data), registry.QUERIES[name], registry.ORACLE[name], data)


@pytest.mark.parametrize("name", ["nm4_sentinels_to_null", "nm6_fill_constant", "nm7_fill_mean"])
def test_balances_that_look_like_sentinels(spark, tmp_path, name):
    balance = [-999.0, 9999.0, -9999.0, 999.0, None, 12.5]
    n = len(balance)
    data = put(tmp_path, "customer", c_custkey=pa.array(range(1, n + 1), pa.int64()), c_name=["x"] * n, c_nationkey=pa.array([3] * n, pa.int32()), c_acctbal=pa.array(balance, pa.float64()), c_mktsegment=["BUILDING"] * n)
    assert matches(spark, name, data) == ""


def events(folder, rows: list[tuple]) -> str:
    """An events table of (user, seconds, value) rows, in an order of files that is not that of time."""
    rows = sorted(rows, key=lambda r: hash((r[1], r[0])))
    user, at, value = zip(*rows)
    start = 1_704_067_200_000_000
    ts = pa.array([start + s * 1_000_000 for s in at], pa.timestamp("us"))
    return put(folder, "events", event_id=pa.array(range(len(rows)), pa.int64()), ts=ts, user_id=pa.array(user, pa.int64()), event_type=["view"] * len(rows), value=pa.array(value, pa.float64()), props=['{"k": 4}'] * len(rows))


def test_points_at_exactly_the_limit_of_deviations(spark, tmp_path):
    """Four of 29 points off by the same step lie 2.5 deviations from the mean, where the last bit decides."""
    rows = [(user, 86_400 * i, 40.0 * (3 + user % 7) if (i * 11 + user) % 29 < 4 else 40.0 * (user % 3)) for user in range(400) for i in range(29)]
    assert matches(spark, "ge5_flag_outliers", events(tmp_path, rows)) == ""


def test_points_without_a_latitude_do_not_count(spark, tmp_path):
    from pyspark.sql import functions as F

    from dayspans.operators import track

    d = spark.range(12).select(F.lit(1).alias("k"), "id", F.timestamp_seconds(F.col("id") * 86_400).alias("at"), F.when(F.col("id") < 5, 1.0).alias("lat"), F.when(F.col("id") == 0, 9.0).otherwise(1.0).alias("lon"))
    assert not [r for r in track.flag_outliers(d, ["k"], ["at", "id"], max_z=2.5).collect() if r["is_outlier"]]


def test_least_squares_keep_their_digits(spark):
    """Values far from zero beside their deviations; against the same sums in fractions."""
    import math
    from fractions import Fraction as Q

    from dayspans.operators import statistics as st

    rows = [(10_000.0 + i % 7, 25_000.0 + 3 * (i % 7) + (i * 37 % 101) / 8) for i in range(3000)]
    n = len(rows)
    x, y = [[Q(r[k]) for r in rows] for k in (0, 1)]
    mx, my = sum(x) / n, sum(y) / n
    sxx, sxy, syy = sum((a - mx) ** 2 for a in x), sum((a - mx) * (b - my) for a, b in zip(x, y)), sum((b - my) ** 2 for b in y)
    rss = float(syy - sxy * sxy / sxx)
    got = {r["term"]: r for r in st.ols(spark.createDataFrame(rows, "x double, y double"), "y", ["x"]).collect()}
    assert got["x"]["coef"] == pytest.approx(float(sxy / sxx), rel=1e-9)
    assert got["x"]["aic"] == pytest.approx(4 + n * (math.log(2 * math.pi * rss / n) + 1), abs=1e-4)
    assert got["x"]["r2"] == pytest.approx(float(sxy * sxy / sxx / syy), abs=1e-8)


def test_nested_models_leave_out_their_own_incomplete_rows(spark):
    import numpy as np

    from dayspans.operators import statistics as st

    r = np.random.default_rng(5)
    x = r.normal(size=(300, 4)).round(3)
    y = (x @ [1.0, -2.0, 0.5, 3.0] + r.normal(size=300)).round(3)
    data = np.column_stack([y, x])
    gone = r.random(data.shape) < 0.15
    rows = [tuple(None if g else float(v) for v, g in zip(a, b)) for a, b in zip(data, gone)]
    d = spark.createDataFrame([*rows, (None,) * 5, (1.0, None, None, None, None)], "y double, a double, b double, c double, e double")
    got = st.nested_models(d, ["y", "e"], {"a": [["a"], ["b", "c"]]}).collect()
    for outcome, at in (("y", 0), ("e", 4)):
        for step, terms in ((1, [1]), (2, [1, 2, 3])):
            ok = ~gone[:, [at, *terms]].any(axis=1)
            want = np.linalg.lstsq(np.column_stack([np.ones(ok.sum()), data[ok][:, terms]]), data[ok][:, at], rcond=None)[0]
            found = [q for q in got if (q["outcome"], q["step"]) == (outcome, step)]
            assert [q["n"] for q in found] == [int(ok.sum())] * len(want)
            assert [q["coef"] for q in found] == pytest.approx(list(want))


def test_variance_ratio_of_balanced_groups_to_many_digits(spark):
    """Equal groups have a closed form: the mean squares' variance components."""
    import numpy as np

    from dayspans.operators import statistics as st

    r = np.random.default_rng(8)
    y = np.round(50 + np.repeat(r.normal(size=400), 20) * 4.0 + r.normal(size=8000) * 21, 2)
    d = spark.createDataFrame([(i // 20, float(v)) for i, v in enumerate(y)], "g int, y double")
    means = y.reshape(400, 20).mean(axis=1)
    between, within = 20 * ((means - y.mean()) ** 2).sum() / 399, ((y.reshape(400, 20) - means[:, None]) ** 2).sum() / 7600
    got = st.random_intercept(d, "y", [], "g").first()
    assert between > within and got["converged"]
    assert got["group_var"] == pytest.approx((between - within) / 20, rel=1e-9)
    assert got["residual_var"] == pytest.approx(within, rel=1e-9)
