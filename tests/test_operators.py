"""Episode, cluster, track, statistics and time operators on small rows, against brute force and known values."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from dayspans.functions import ids, labels, missing, quantiles, times
from dayspans.operators import clusters, episodes, fragmentation, joins, questionnaires, statistics, track


def one(spark, expr, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(("raw", "clean"), [(None, ""), ("  Study_012P", "12"), ("p_7", "7"), ("Pilot_003", "3"), ("p_00", "0"), ("x-ray", "xray"), ("study-5p", "5")])
def test_standardize_id(spark, raw, clean):
    assert one(spark, ids.standardize_id, raw) == clean


@pytest.mark.parametrize(("raw", "minutes"), [("0 days 00:01:23", 83 / 60), ("1 days 02", 1560.0), ("05:30", 5.5), ("2 days 01:30", 2881.5), ("12.5", 12.5), ("abc", 1.0), (None, None)])
def test_duration_minutes(spark, raw, minutes):
    got = one(spark, lambda c: times.duration_minutes(c, on_error=1.0), raw)
    assert got == (None if minutes is None else pytest.approx(minutes))


def test_times(spark):
    assert str(one(spark, times.parse_any, "31/12/2023 10:00:00")) == "2023-12-31 10:00:00" and one(spark, times.parse_any, "?") is None
    assert one(spark, times.pad_clock, "7:5:9") == "07:05:09"
    assert str(one(spark, times.month_year, "Aug-97")) == "1997-08-15" and one(spark, times.month_year, "97") is None


def test_missing(spark):
    assert one(spark, missing.to_number, "nan") is None and one(spark, missing.salvage_number, "r4") == 4.0
    d = spark.createDataFrame([(1.0, "a"), (999.0, None), (None, "b")], "x double, y string")
    assert [r["x"] for r in missing.sentinels_to_null(d).collect()] == [1.0, None, None]
    assert {(r["column"], r["n_null"]) for r in missing.null_profile(d, ["x", "y"]).collect()} == {("x", 1), ("y", 1)}


def random_intervals(rng, n=200):
    out = []
    for _ in range(n):
        s = rng.randrange(1000)
        out.append((rng.randrange(4), s, s + rng.randrange(1, 30)))
    return out


def test_merge_intervals_matches_brute_force(spark):
    rows = random_intervals(random.Random(1))
    want = []
    for k in range(4):
        own = sorted((s, e) for u, s, e in rows if u == k)
        cur = list(own[0])
        for s, e in own[1:]:
            if s - cur[1] <= 5:
                cur[1] = max(cur[1], e)
            else:
                want.append((k, *cur))
                cur = [s, e]
        want.append((k, *cur))
    d = spark.createDataFrame(rows, "user_id int, start_us long, end_us long")
    got = sorted((r["user_id"], r["start_us"], r["end_us"]) for r in episodes.merge_intervals(d, ["user_id"], 5).collect())
    assert got == sorted(want)


def test_intersect_intervals_matches_brute_force(spark):
    a, b = random_intervals(random.Random(2), 80), random_intervals(random.Random(3), 80)
    want = sorted((u, max(s, x), min(e, y)) for u, s, e in a for v, x, y in b if u == v and min(e, y) - max(s, x) >= 3)
    f = lambda rows: spark.createDataFrame(rows, "user_id int, start_us long, end_us long")
    got = sorted(map(tuple, episodes.intersect_intervals(f(a), f(b), ["user_id"], 3).select("user_id", "start_us", "end_us").collect()))
    assert got == want


def test_pair_events_and_timeline(spark):
    rows = [(1, 10, False, 1), (1, 20, True, 2), (1, 25, True, 3), (1, 40, False, 4), (1, 41, False, 5), (1, 60, True, 6)]
    d = spark.createDataFrame(rows, "user_id int, us long, is_on boolean, event_id int")
    got = [(r["start_us"], r["end_us"]) for r in episodes.pair_events(d, ["user_id"], F.lit(99).cast("long")).orderBy("start_us").collect()]
    assert got == [(20, 40), (60, 99)]
    stays = spark.createDataFrame([(1, "2024-01-02", 10, 20, "home"), (1, "2024-01-02", 50, 60, "out")], "user_id int, date string, s int, e int, place string")
    lo = episodes.day_us(F.to_date("date"))
    stays = stays.select("user_id", F.to_date("date").alias("date"), (lo + F.col("s")).alias("start_us"), (lo + F.col("e")).alias("end_us"), "place")
    day = episodes.fill_day(stays, ["user_id", "date"]).orderBy("start_us").collect()
    assert [r["place"] for r in day] == ["home", "home", "home", "out", "out"]
    assert all(a["end_us"] == b["start_us"] for a, b in zip(day, day[1:])) and day[-1]["end_us"] - day[0]["start_us"] == episodes.DAY


def brute_dbscan(xs, eps, least):
    core = [x for x in sorted(xs) if sum(abs(x - y) <= eps for y in xs) >= least]
    groups = []
    for x in sorted(set(core)):
        if groups and x - groups[-1][-1] <= eps:
            groups[-1].append(x)
        else:
            groups.append([x])
    member = [[] for _ in groups]
    for x in sorted(xs):
        i = next((i for i, g in enumerate(groups) if any(abs(x - y) <= eps for y in g)), None)
        if i is not None:
            member[i].append(x)
    return [(min(m), max(m), len(m)) for m in member]


def test_density_clusters_match_brute_force(spark):
    rng = random.Random(4)
    xs = {u: [rng.randrange(300) for _ in range(60)] for u in range(5)}
    d = spark.createDataFrame([(u, x) for u, own in xs.items() for x in own], "user_id int, minute long")
    got = {u: [] for u in xs}
    for r in clusters.density_clusters(d, "user_id", F.col("minute"), 4, 4).orderBy("cluster").collect():
        got[r["user_id"]].append((r["start_minute"], r["end_minute"], r["n"]))
    assert got == {u: brute_dbscan(own, 4, 4) for u, own in xs.items()}


@pytest.mark.parametrize("batch", [7, 10_000])
def test_staypoints_match_brute_force(spark, batch):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    rng, rows = random.Random(6), []
    for u in range(4):
        t, lat = 0, 32.0
        for i in range(120):
            t += rng.randrange(30, 900)
            lat += rng.choice([0, 0, 0, 0.0001, 0.002])
            rows.append((u, i, t * 1_000_000, lat, 34.0))
    d = spark.createDataFrame(rows, "user_id int, event_id int, us long, lat double, lon double").withColumn("tracked_at", F.timestamp_micros("us"))
    got = sorted((r["user_id"], r["started_us"], r["finished_us"], r["n_points"]) for r in track.staypoints(d, ["user_id"], minutes=10, gap_minutes=12).collect())
    want = []
    for u in range(4):
        own, i = [r for r in rows if r[0] == u], 0
        while i < len(own):
            j = next((j for j in range(i + 1, len(own)) if 2 * track.EARTH * math.asin(abs(math.sin(math.radians(own[j][3] - own[i][3]) / 2))) >= 75), None)
            if j is None:
                break
            if own[j][2] - own[i][2] >= 6e8 and own[j][2] - own[j - 1][2] < 7.2e8:
                want.append((u, own[i][2], own[j][2], j - i))
            i = j
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == sorted(want)


def test_window_join_matches_brute_force(spark):
    rng = random.Random(14)
    pts = [(rng.randrange(3), i, rng.randrange(1000)) for i in range(200)]
    wins = [(rng.randrange(3), i, a, a + rng.randrange(-5, 120)) for i, a in enumerate(rng.randrange(1000) for _ in range(60))]
    p, w = spark.createDataFrame(pts, "k int, i int, us long"), spark.createDataFrame(wins, "k int, j int, lo long, hi long")
    got = sorted(map(tuple, joins.window_join(p, w, ["k"], "us", "lo", "hi", 50).select("i", "j").collect()))
    assert got == sorted((i, j) for k, i, t in pts for q, j, a, b in wins if k == q and a <= t <= b)


def test_fragmentation_index_bounds(spark):
    rows = [("one", 5.0), ("equal", 3.0), ("equal", 3.0), ("none", 0.0), ("null", None)] + [("trim", 1.0)] * 20 + [("trim", 500.0)]
    d = spark.createDataFrame(rows, "k string, m double")
    got = {r["k"]: r for r in fragmentation.fragmentation_index(d, ["k"], F.col("m")).collect()}
    assert got["one"]["fragmentation_index"] == 0 and got["equal"]["fragmentation_index"] == pytest.approx(1)
    assert got["none"]["status"] == got["null"]["status"] == "no_valid_episodes"
    assert got["trim"]["episode_count"] == 20
    strict = {r["k"]: r["status"] for r in fragmentation.fragmentation_index(d, ["k"], F.col("m"), trim_above=0).collect()}
    assert strict["one"] == "insufficient_episodes_after_outlier_removal"


def test_tails_match_the_jvm(spark):
    dist = spark._jvm.org.apache.commons.math3.distribution
    cases = [(t, df) for t in (0.1, 1.0, 2.5, 7.0) for df in (1.0, 4.5, 30.0, 2000.0)]
    d = spark.createDataFrame(cases, "t double, df double")
    for r in d.select("t", "df", statistics.t_p(F.col("t"), F.col("df")).alias("p")).collect():
        want = 2 * dist.TDistribution(r["df"]).cumulativeProbability(-r["t"])
        assert r["p"] == pytest.approx(want, rel=1e-8, abs=1e-14)
    f = spark.createDataFrame([(0.3, 2.0, 10.0), (4.0, 3.0, 200.0), (12.0, 1.0, 7.0)], "f double, a double, b double")
    for r in f.select("*", statistics.f_p(F.col("f"), F.col("a"), F.col("b")).alias("p")).collect():
        assert r["p"] == pytest.approx(1 - dist.FDistribution(r["a"], r["b"]).cumulativeProbability(r["f"]), rel=1e-8)
    q = spark.createDataFrame([(10.0,), (2.5,), (900.0,)], "df double").select("df", statistics.t_quantile(F.lit(0.975), F.col("df")).alias("q")).collect()
    assert all(r["q"] == pytest.approx(dist.TDistribution(r["df"]).inverseCumulativeProbability(0.975), abs=1e-6) for r in q)


def test_ols_matches_numpy(spark):
    rng = np.random.default_rng(3)
    x, z = rng.normal(size=200), rng.normal(size=200)
    y = 1 + 2 * x - z + rng.normal(size=200)
    rows = {r["term"]: r for r in statistics.ols(spark.createDataFrame(list(zip(y.tolist(), x.tolist(), z.tolist())), "y double, x double, z double"), "y", ["x", "z"]).collect()}
    design = np.column_stack([np.ones(200), x, z])
    coef = np.linalg.lstsq(design, y, rcond=None)[0]
    rss = ((y - design @ coef) ** 2).sum()
    se = np.sqrt(np.diag(np.linalg.inv(design.T @ design)) * rss / 197)
    for i, t in enumerate(("intercept", "x", "z")):
        assert rows[t]["coef"] == pytest.approx(coef[i]) and rows[t]["se"] == pytest.approx(se[i])
    assert statistics.ols(spark.createDataFrame([(1.0, 2.0)], "y double, x double"), "y", ["x"]).count() == 0


def test_random_intercept_matches_dense_likelihood(spark):
    rng = np.random.default_rng(5)
    g = np.repeat(np.arange(25), rng.integers(2, 9, 25))
    x = rng.normal(size=len(g))
    y = 2 + 0.5 * x + rng.normal(0, 1.5, 25)[g] + rng.normal(size=len(g))
    d = spark.createDataFrame(list(zip(g.tolist(), x.tolist(), y.tolist())), "g int, x double, y double")
    r = {r["term"]: r for r in statistics.random_intercept(d, "y", ["x"], "g").collect()}
    design, same = np.column_stack([np.ones(len(g)), x]), (g[:, None] == g[None, :]).astype(float)

    vals, vecs = np.linalg.eigh(same)  # once: the inverse for any theta follows, whatever the number of threads

    def ll(theta):
        inv = (vecs / (1 + theta * vals)) @ vecs.T
        a = design.T @ inv @ design
        coef = np.linalg.solve(a, design.T @ inv @ y)
        res = y - design @ coef
        s2 = res @ inv @ res / (len(g) - 2)
        return -0.5 * ((len(g) - 2) * (math.log(2 * math.pi * s2) + 1) + np.log(np.abs(1 + theta * vals)).sum() + np.linalg.slogdet(a)[1]), coef

    near = max(np.linspace(-4, 4, 81), key=lambda t: ll(math.exp(t))[0])
    best = max((math.exp(near + t) for t in np.linspace(-0.1, 0.1, 101)), key=lambda t: ll(t)[0])
    assert r["x"]["ll"] == pytest.approx(ll(best)[0], abs=1e-4) and r["x"]["coef"] == pytest.approx(ll(best)[1][1], abs=1e-3)
    assert r["x"]["group_var"] / r["x"]["residual_var"] == pytest.approx(best, rel=0.02) and r["x"]["converged"]
    fixed = np.var(design @ ll(best)[1])
    assert r["x"]["marginal_r2"] == pytest.approx(fixed / (fixed + r["x"]["group_var"] + r["x"]["residual_var"]), abs=1e-3)


def test_published_group_comparison(spark):
    """Student's t and Cohen's d by hand from means, deviations and counts of two groups."""
    rows = [("a", 0.919 + 0.09 * s) for s in (-1, 1) for _ in range(30)] + [("b", 0.972 + 0.019 * s) for s in (-1, 1) for _ in range(19)]
    r = statistics.student(spark.createDataFrame(rows, "g string, x double"), [], "g", "x").first()
    assert r["d"] == pytest.approx(-0.815, abs=0.01) and r["t"] == pytest.approx(-3.6, abs=0.1) and r["p"] < 0.001


def test_joins(spark):
    left = spark.createDataFrame([(1, "2024-01-02"), (1, "2024-01-09"), (2, "2024-03-01")], "id int, d string").withColumn("d", F.to_date("d"))
    right = spark.createDataFrame([(1, "2024-01-01", "x"), (1, "2024-01-03", "y"), (2, "2024-01-03", "z")], "id int, d string, v string").withColumn("d", F.to_date("d"))
    assert [(r["v"], r["day_offset"]) for r in joins.offset_join(left, right, "id", "d").collect()] == [("x", -1)]
    got = {(r["id"], str(r["d"])): (r["match_type"], r["matched_v"]) for r in joins.priority_join(left, right, "id", "d", times.swapped_date(F.col("d")), ["v"]).collect()}
    assert got[(2, "2024-03-01")] == ("swapped", "z") and got[(1, "2024-01-02")] == ("none", None)
    near = joins.similar_texts(spark.createDataFrame([("how are you",)], "a string"), spark.createDataFrame([("how are you?",), ("who",)], "b string")).collect()
    assert [(r["a"], r["b"]) for r in near] == [("how are you", "how are you?")]


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("least", [1.0, 0.8, 0.75, 0.6, 0.3])
def test_similar_texts_matches_brute_force(spark, least):
    rng = random.Random(7)
    texts = ["", "a", "é", "日本語"]
    for _ in range(25):
        t = "".join(rng.choice("abcé") for _ in range(rng.randrange(1, 25)))
        for _ in range(3):
            texts.append(t)
            cut = rng.randrange(len(t) + 1)
            t = t[:cut] + rng.choice(["", "x", "ab"]) + t[cut + rng.randrange(2) :]
    want = {(a, b) for a in texts for b in texts[::2] if round(1 - edits(a, b) / max(len(a), len(b), 1), 6) >= least}
    f = lambda rows: spark.createDataFrame([(x,) for x in [*rows, None]], "x string")
    got = [(r["a"], r["b"]) for r in joins.similar_texts(f(texts), f(texts[::2]), least).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_similar_texts_compares_few_pairs_of_one_length(spark):
    rng = random.Random(8)
    d = spark.createDataFrame([("".join(rng.choice("abcdefghijklmnopqrst") for _ in range(20)),) for _ in range(1000)], "x string").cache()
    seen = joins.similar_texts(d, d)
    assert seen.count() == d.distinct().count()
    plan = seen._jdf.queryExecution().executedPlan().toString()
    assert "_piece" in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_similar_texts_of_all_rows(spark, tmp_path):
    from dayspans.plans import registry

    spark.createDataFrame([(1, "small ring"), (900, "small rings"), (901, "tall tree")], "p_partkey long, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    got = {(r["a"], r["b"]) for r in registry.QUERIES["jn11_similar_texts"](spark, str(tmp_path)).collect()}
    assert got == {("small ring", "small ring"), ("small ring", "small rings"), ("small rings", "small ring"), ("small rings", "small rings"), ("tall tree", "tall tree")}


def test_hourly_default_matches_brute_force(spark):
    rng, hour, day = random.Random(9), 3_600_000_000, 19_700 * 86_400_000_000
    edges = [h * hour + x for h in range(24) for x in (-hour // 2, hour // 2 - 1, hour // 2)]
    rows = [(rng.randrange(25), rng.choice([*edges, rng.randrange(24 * hour)]), rng.choice([True, False, None])) for _ in range(150)]
    f = spark.createDataFrame([(u, day + t, n) for u, t, n in [*rows, (3, None, True)] if t is not None], "user_id int, us long, near boolean")
    f = f.withColumn("date", F.date_add(F.lit("1970-01-01").cast("date"), 19_700))
    f = f.unionByName(f.limit(1).withColumns({"us": F.lit(None).cast("long"), "near": F.lit(True)}))
    got = episodes.hourly_default(f.select("user_id", "date"), f)
    want = {(u, h): any(n and v == u and h * hour - hour // 2 <= t < h * hour + 3 * hour // 2 for v, t, n in rows) for u in {r[0] for r in rows} for h in range(24)}
    found = got.collect()
    assert len(found) == len(want) and {(r["user_id"], r["hour"]): r["location_type"] == "home" for r in found} == want
    joins_made = [x for x in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join " in x]
    assert joins_made and all("hour" in x for x in joins_made)


def test_hours_and_pairs_of_all_users(spark, tmp_path):
    from dayspans.plans import registry

    rows = [(i, u, "2024-01-02 10:40:00", e, 1.0, '{"k": 3}') for i, (u, e) in enumerate([(1, "view"), (1, "click"), (900, "view"), (900, "error")])]
    spark.createDataFrame(rows, "event_id long, user_id long, ts string, event_type string, value double, props string").withColumn("ts", F.col("ts").cast("timestamp_ntz")).write.parquet(f"{tmp_path}/events.parquet")
    hours = registry.QUERIES["ep13_hourly_default"](spark, str(tmp_path)).where("location_type = 'home'").collect()
    assert {(r["user_id"], r["hour"]) for r in hours} == {(u, h) for u in (1, 900) for h in (10, 11)}
    assert {(r["a"], r["b"]) for r in registry.QUERIES["se3_unordered_pairs"](spark, str(tmp_path)).collect()} == {("click", "view"), ("error", "view")}


def test_skipped_margins_of_many_files(spark, tmp_path):
    import glob

    from dayspans.plans import registry, scans

    spark.range(5000).select(F.col("id").alias("c_custkey"), F.lit(1).alias("c_nationkey"), F.lit("a").alias("c_mktsegment"), F.lit(1.0).alias("c_acctbal")).write.parquet(f"{tmp_path}/customer.parquet")
    got = registry.QUERIES["sc3_csv_skip"](spark, str(tmp_path)).collect()
    assert len(got) == 5000 and {r["user_id"] for r in got} == set(range(5000)) and {r["gender_raw"] for r in got} == {"F", "M", "n/a"}
    d = spark.range(300).select(F.col("id").alias("user_id"), F.lit("F").alias("gender_raw"))
    scans.with_margins(d, f"{tmp_path}/txt", 5)
    written = [open(x).read().splitlines() for x in glob.glob(f"{tmp_path}/txt/f=*/part-*")]
    assert len(written) == 5 and all(x[:6] == ["head"] * 6 and x[-1] == "foot" and "head" not in x[6:] and "foot" not in x[:-1] for x in written)
    assert sorted(int(y.split(";")[0]) for x in written for y in x[6:-1]) == list(range(300))


@pytest.mark.parametrize("margin", [2e-4, 0.0, -0.2])
def test_exact_percentiles(spark, monkeypatch, margin):
    """With any bracket, even one that misses its rank, the quantiles are those of numpy."""
    monkeypatch.setattr(quantiles, "MARGIN", margin)
    rng, shares = random.Random(15), [0.0, 0.05, 0.25, 0.5, 0.731, 1.0]
    for values in ([3.0], [1.0, 2.0], [rng.choice([1.0, 2.0, 7.0]) for _ in range(500)], [rng.gauss(0, 1) for _ in range(801)]):
        d = spark.createDataFrame([(x,) for x in [*values, None]], "x double")
        assert quantiles.exact_percentiles(d, "x", shares) == pytest.approx(np.quantile(values, shares).tolist())
    assert quantiles.exact_percentiles(d.where("false"), "x", [0.5]) == [None]


def test_questionnaires(spark):
    assert one(spark, lambda c: questionnaires.reverse_scale(c, 5), "2") == "4" and one(spark, lambda c: questionnaires.reverse_scale(c, 5), "x") == "x"
    assert one(spark, lambda c: questionnaires.map_codes(c, questionnaires.TRAFFIC_4), "5") is None
    d = spark.createDataFrame([(1, 1.0), (1, 3.0), (2, 5.0), (3, None)], "k int, x double")
    assert [r["z"] for r in questionnaires.zscore(d, "x", ["k"], "z").orderBy("k", "x").collect()] == [pytest.approx(-2**-0.5), pytest.approx(2**-0.5), 0.0, None]
    assert spark.createDataFrame([(None, 2.0, 4.0)], "a double, b double, c double").select(questionnaires.row_mean(F.col("a"), F.col("b"), F.col("c")).alias("m")).first()["m"] == 3.0


def test_labels(spark):
    assert one(spark, labels.stars, 0.0005, "double") == "***" and one(spark, labels.effect_words, -0.4, "double") == "Medium"
    assert one(spark, labels.short_number, 0.00053, "double") == "0.00053" and one(spark, labels.short_number, 1.5, "double") == "1.500"
