"""Matching blocks, corrections in time, factors and mappings, against brute force and known values."""

from __future__ import annotations

import datetime as dt
import random
from collections import Counter
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from dayspans.functions import quantiles, times
from dayspans.operators import joins, schemas, statistics


@pytest.mark.parametrize("least", [0.5, 0.8, 0.95, 1.0])
def test_matching_texts_lose_no_pair(spark, least):
    rng = random.Random(int(least * 100))
    texts = ["", "a", "aa", "ab", "ba", "é😀x", None]
    for _ in range(25):
        t = "".join(rng.choice("abcde ") for _ in range(rng.randrange(1, 22)))
        texts += [t, t[::-1], t[2:] + t[:2]]
        for _ in range(2):
            u = list(t)
            for _ in range(rng.randrange(1, 5)):
                at = rng.randrange(len(u) + 1)
                u[at : at + rng.randrange(2)] = [rng.choice("abcdef")] * rng.randrange(3)
            texts.append("".join(u))
    half = len(texts) // 2
    frame = lambda own: spark.createDataFrame([(t,) for t in own], "t string")
    got = {(r["a"], r["b"], r["similarity"]) for r in joins.matching_texts(frame(texts), frame(texts[half:]), least).collect()}
    ratio = lambda a, b: round(SequenceMatcher(None, a, b).ratio(), 6)
    known = lambda own: {t for t in own if t is not None}
    assert got == {(a, b, ratio(a, b)) for a in known(texts) for b in known(texts[half:]) if ratio(a, b) >= least}


def test_matching_texts_of_popular_characters(spark):
    """From 200 characters on, characters that are too common start no block: the ratio says so, and the pairs stay complete."""
    rng = random.Random(4)
    long = "".join(rng.choice("ab") for _ in range(230))
    rows = [(long,), (long[:-3] + "xyz",), ("q" + long[1:],)]
    got = {(r["a"], r["b"]): r["similarity"] for r in joins.matching_texts(spark.createDataFrame(rows, "t string"), spark.createDataFrame(rows, "t string"), 0.9).collect()}
    want = {(a, b): round(SequenceMatcher(None, a, b).ratio(), 6) for (a,) in rows for (b,) in rows}
    assert got == {k: v for k, v in want.items() if v >= 0.9} and len(got) >= 3


@pytest.mark.parametrize("bucket", [1_000_000, 60_000_000, 86_400_000_000])
def test_corrections_are_the_last_that_began(spark, bucket):
    rng, start = random.Random(7), dt.datetime(2024, 1, 1)
    at = lambda: start + dt.timedelta(seconds=rng.randrange(400))
    fixes = [(f"d{rng.randrange(4)}", at(), rng.randrange(-9, 9)) for _ in range(30)] + [("d1", None, 5), ("other", start, 1)]
    rows = [(i, f"d{rng.randrange(5)}" if i % 9 else None, at() if i % 11 else None) for i in range(300)]
    d = spark.createDataFrame(rows, "id int, device string, ts timestamp_ntz")
    k = spark.createDataFrame(fixes, "device string, since timestamp_ntz, minutes int")
    got = {r["id"]: (r["since"], r["minutes"]) for r in joins.last_before(d, k, ["device"], "ts", "since", ["since", "minutes"], bucket).collect()}
    for i, device, ts in rows:
        mine = [(s, m) for f, s, m in fixes if f == device and s is not None and ts is not None and s <= ts]
        assert got[i] == (max(mine) if mine else (None, None))
    moved = {r["id"]: r["ts"] for r in times.corrected(d, k, ["device"], "ts", "since", "minutes").collect()}
    assert all(moved[i] == (ts and ts + dt.timedelta(minutes=got[i][1] or 0)) for i, _, ts in rows)


def dummies(rows, levels):
    return np.array([[1.0, x, *[float(g == v) for v in levels]] for _, x, g in rows])


def test_factor_model_matches_dense_fit(spark):
    rng = np.random.default_rng(8)
    rows = [(float(2 + 0.5 * x + {"a": 0, "b": 1, "c": -1}[g] + rng.normal()), float(x), g) for x, g in zip(rng.normal(size=90), rng.choice(["a", "b", "c"], 90, p=[0.6, 0.3, 0.1]))]
    d = spark.createDataFrame([*rows, (None, 1.0, "d"), (1.0, None, "e"), (1.0, 1.0, None)], "y double, x double, g string")
    terms, tests = (t.collect() for t in statistics.factor_model(d, "y", ["x"], {"g": "b"}))
    a, y = dummies(rows, ["a", "c"]), np.array([r[0] for r in rows])
    coef, rss = np.linalg.lstsq(a, y, rcond=None)[0], lambda m: float(((y - m @ np.linalg.lstsq(m, y, rcond=None)[0]) ** 2).sum())
    assert [t["term"] for t in terms] == ["intercept", "x", "g[a]", "g[c]"] and np.allclose([t["coef"] for t in terms], coef)
    f = ((rss(a[:, :2]) - rss(a)) / 2) / (rss(a) / 86)
    got = {t["factor"]: t for t in tests}
    assert abs(got["g"]["f"] - f) < 1e-8 and (got["g"]["df1"], got["g"]["df2"]) == (2, 86) and abs(got["g"]["p"] - (1 + 2 * f / 86) ** -43) < 1e-9
    whole = ((rss(a[:, :1]) - rss(a)) / 3) / (rss(a) / 86)
    assert abs(got["model"]["f"] - whole) < 1e-8 and abs(terms[0]["f"] - whole) < 1e-8


def test_factor_model_odd_factors(spark):
    d = spark.createDataFrame([(float(i), float(i % 3), "one", i % 2 == 0) for i in range(20)], "y double, x double, g string, h boolean")
    terms, tests = (t.collect() for t in statistics.factor_model(d, "y", ["x"], {"g": None, "h": None}))
    assert [t["term"] for t in terms] == ["intercept", "x", "h[true]"] and {t["factor"] for t in tests} == {"h", "model"}
    assert statistics.factor_model(d.where("false"), "y", ["x"], {"g": None})[0].count() == 0
    plain = statistics.factor_model(d, "y", ["x"], {})[0].collect()
    assert [tuple(r) for r in plain] == [tuple(r) for r in statistics.ols(d, "y", ["x"]).collect()]
    with pytest.raises(ValueError, match="no level"):
        statistics.factor_model(d, "y", ["x"], {"h": "maybe"})
    with pytest.raises(ValueError, match="more than"):
        statistics.factor_model(spark.range(500).select(F.col("id").alias("y"), F.col("id").alias("g")), "y", [], {"g": None})


def test_mapping_fills_checks_and_reports(spark):
    d = spark.createDataFrame([(1, "F", 2.5), (2, None, None)], "user long, sex string, score double")
    wanted = "id string, score double, n int, who string, day date"
    got = schemas.to_schema(d, wanted, {"id": F.col("user").cast("string"), "score": "score", "who": "no_such"}, required=["id"])
    assert got.dtypes == [("id", "string"), ("score", "double"), ("n", "int"), ("who", "string"), ("day", "date")]
    assert [tuple(r) for r in got.collect()] == [("1", 2.5, None, None, None), ("2", None, None, None, None)]
    with pytest.raises(ValueError, match="extra: not in the schema; id: no source; n: bigint does not fit int"):
        schemas.to_schema(d, wanted, {"extra": "user", "n": "user"}, required=["id"])
    assert schemas.to_schema(d, "x double", {"x": "user"}).first()["x"] == 1.0  # a wider type of its kind
    with pytest.raises(ValueError, match="differ"):
        schemas.pool([got, got.withColumn("n", F.lit("x"))])
    assert schemas.pool([got, got]).count() == 4


def test_both_standardisations(spark):
    rows = [("a", 1.0), ("a", 3.0), ("b", 5.0), ("c", 2.0), ("c", 2.0), ("c", None)]
    d = spark.createDataFrame(rows, "who string, raw double")
    one = Counter((r["who"], r["z"] if r["z"] is None else round(r["z"], 9)) for r in schemas.standardised(d, {"z": "raw"}, ["who"], {"z": -1}).collect())
    assert one == Counter([("a", 0.707106781), ("a", -0.707106781), ("b", 0.0), ("c", 0.0), ("c", 0.0), ("c", None)])
    x = np.array([1.0, 3, 5, 2, 2])
    z = [r["z"] for r in schemas.standardised(d, {"z": "raw"}).collect()]
    assert sorted(round(v, 9) for v in z if v is not None) == sorted(np.round((x - x.mean()) / x.std(), 9)) and z.count(None) == 1


@pytest.mark.parametrize(("small", "groups"), [(50_000, 50_000), (100, 50_000), (100, 0)])
def test_group_percentiles(spark, monkeypatch, small, groups):
    """Ranks found in brackets or among all values, rows per group broadcast or joined: those of numpy."""
    monkeypatch.setattr(quantiles, "SMALL", small)
    monkeypatch.setattr(quantiles, "GROUPS", groups)
    monkeypatch.setattr(quantiles, "MARGIN", 2e-2)  # wide enough for groups of a hundred values
    rng = np.random.default_rng(3)
    own = {"a": rng.normal(size=2000).tolist(), "b": [1.0, 2.0, 2.0], None: np.round(rng.normal(size=900), 1).tolist(), "c": [5.0]}
    rows = [(k, x) for k, v in own.items() for x in v] + [("a", None), ("d", None), ("b", float("nan"))]
    shares = [0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0]
    got = quantiles.group_percentiles(spark.createDataFrame(rows, "g string, x double"), ["g"], "x", shares).collect()
    assert {r["g"] for r in got} == set(own)
    for r in got:
        assert r["quantiles"] == pytest.approx(np.quantile(own[r["g"]], shares).tolist())
    assert quantiles.group_percentiles(spark.createDataFrame([], "g string, x double"), ["g"], "x", shares).count() == 0


def test_anova_icc_agrees_with_reml_on_balanced_groups(spark):
    rng = np.random.default_rng(6)
    rows = [(g, float(u + e)) for g, u in enumerate(rng.normal(0, 2, 40)) for e in rng.normal(0, 1, 6)]
    d = spark.createDataFrame([*rows, (99, None), (None, 1.0)], "g int, y double")
    a = statistics.anova_icc(d, "y", "g").first()
    r = statistics.random_intercept(d.dropna(), "y", [], "g").first()
    assert a["n"] == 240 and a["n_groups"] == 40 and a["n0"] == pytest.approx(6)
    assert a["icc"] == pytest.approx(r["icc"], abs=1e-5) and a["group_var"] == pytest.approx(r["group_var"], rel=1e-4)
    uneven = spark.createDataFrame([(g, float(g % 2)) for g in range(9) for _ in range(g % 3 + 1)], "g int, y double")
    m = np.array([g % 3 + 1 for g in range(9)])
    assert statistics.anova_icc(uneven, "y", "g").first()["n0"] == pytest.approx((m.sum() - (m**2).sum() / m.sum()) / 8)
    assert statistics.anova_icc(d.where("g = 1"), "y", "g").count() == 0


def test_slope_bands(spark):
    rng = np.random.default_rng(2)
    x = rng.uniform(0, 5, 30)
    y = 1 + 2 * x + rng.normal(size=30)
    d = spark.createDataFrame([("a", float(p), float(q)) for p, q in zip(x, y)] + [("a", None, 1.0), ("b", 1.0, 1.0)], "g string, x double, y double")
    got = statistics.slope_bands(d, "g", "x", "y", points=5).orderBy("i").collect()
    b, a = np.polyfit(x, y, 1)
    grid = np.linspace(x.min(), x.max(), 5)
    s2, sxx, t = ((y - a - b * x) ** 2).sum() / 28, ((x - x.mean()) ** 2).sum(), 2.048407141795
    half = t * np.sqrt(s2 * (1 / 30 + (grid - x.mean()) ** 2 / sxx))
    assert [r["g"] for r in got] == ["a"] * 5
    assert np.allclose([r["fit"] for r in got], a + b * grid) and np.allclose([r["high"] for r in got], a + b * grid + half) and np.allclose([r["low"] for r in got], a + b * grid - half)
