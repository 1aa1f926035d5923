"""Tracks: distances, implausible points, source fusion, stays, legs, modes, trips and homes."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.times import micros

EARTH = 6_371_000.0


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """GE1: great-circle distance in metres."""
    a = F.pow(F.sin((F.radians(lat2) - F.radians(lat1)) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), 2)
    return F.lit(2 * EARTH) * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def planar(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """GE2: degrees taken as 111 km each, both ways."""
    return F.sqrt(F.pow(lat2 - lat1, 2) + F.pow(lon2 - lon1, 2)) * 111_000


def steps(df: DataFrame, keys: list[str], order: list[str], distance=haversine) -> DataFrame:
    """Add ``dt`` (seconds) and ``dist`` (metres) since the previous point of the key; null on the first."""
    w = Window.partitionBy(*keys).orderBy(*order)
    prev = lambda c: F.lag(c).over(w)
    us = micros(F.col(order[0]))
    return df.withColumns({"dt": (us - prev(us)) / 1_000_000, "dist": distance(prev(F.col("lat")), prev(F.col("lon")), F.col("lat"), F.col("lon"))})


def drop_jumps(df: DataFrame, keys: list[str], order: list[str], max_km: float = 50, within_h: float = 3) -> DataFrame:
    """GE3: a point that lies too far from the raw point shortly before it goes; one pass, the first point stays."""
    s = steps(df, keys, order)
    return s.where(~F.coalesce((F.col("dt") < within_h * 3600) & (F.col("dist") > max_km * 1000), F.lit(False))).drop("dt", "dist")


def drop_fast(df: DataFrame, keys: list[str], order: list[str], max_kmh: float = 200) -> DataFrame:
    """GE4: a point that could only be reached faster than the limit goes."""
    s = steps(df, keys, order)
    return s.where(~F.coalesce((F.col("dt") > 0) & (F.col("dist") > F.col("dt") * (max_kmh / 3.6)), F.lit(False))).drop("dt", "dist")


def flag_outliers(df: DataFrame, keys: list[str], order: list[str], max_speed: float = 100, max_z: float = 5) -> DataFrame:
    """GE5: too fast, or too far from the key's mean in either coordinate (population deviation, more than 5 points).

    Coordinates on a grid lie exactly at the limit now and then, where rounding decides. So the moments are taken in the
    order of the track, whatever the order of the shuffle, and the deviation as the root of the covariance with itself,
    which is Welford's recurrence, bit by bit that of other engines: reruns agree, and so does SQL. A row without a
    latitude is no point.
    """
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = steps(df, keys, order, planar)

    def far(c):
        sd = F.sqrt(F.covar_pop(c, c).over(w))
        z = F.abs(F.col(c) - F.avg(c).over(w)) / F.when(sd > 0, sd)
        return F.coalesce((F.count("lat").over(w) > 5) & (z > max_z), F.lit(False))

    fast = F.coalesce((F.col("dt") > 0) & (F.col("dist") / F.when(F.col("dt") > 0, F.col("dt")) > max_speed), F.lit(False))
    return s.withColumn("is_outlier", fast | far("lat") | far("lon")).drop("dt", "dist")


def source_quality(df: DataFrame, keys: list[str], order: list[str], max_gap: float = 3600) -> DataFrame:
    """GE6: points, days, mean gap, trimmed area and a score of 0 to 100 per key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    gap = (F.lead(micros(F.col(order[0]))).over(w) - micros(F.col(order[0]))) / 1_000_000
    d = df.withColumn("gap", gap)
    q = lambda c, p: F.percentile(c, F.lit(p))
    g = d.groupBy(*keys).agg(F.count("*").alias("points"), F.countDistinct("date").alias("days"), F.avg(F.when((F.col("gap") > 0) & (F.col("gap") < max_gap), F.col("gap"))).alias("mean_gap"), F.least(F.lit(200.0), (q("lat", 0.95) - q("lat", 0.05)) * (q("lon", 0.95) - q("lon", 0.05)) * 111.0 * 111.0).alias("area"))
    ppd = F.col("points") / F.col("days")
    score = F.least(F.lit(40.0), ppd / 4) + F.least(F.lit(30.0), F.col("area") / 3) + F.least(F.lit(30.0), F.coalesce(30 * (1 - F.least(F.lit(1.0), F.col("mean_gap") / 300)), F.lit(0.0)))
    return g.withColumns({"points_per_day": ppd, "score": F.least(F.lit(100.0), score)})


def fuse_sources(df: DataFrame, first: str, second: str, quality: DataFrame, enough: int = 50, margin_s: int = 300) -> DataFrame:
    """GE7: per user and day the points of one source, or of the first with the second's outside its span.

    ``quality`` has user_id, source, score. A day of one source only keeps it; a first source with ``enough`` points
    keeps all and gains the second's outside its span and margin; else the source of strictly higher score wins, the
    first on a tie.
    """
    us = micros(F.col("tracked_at"))
    a, b = F.col("source") == first, F.col("source") == second
    day = df.groupBy("user_id", "date").agg(F.count_if(a).alias("n_a"), F.count_if(b).alias("n_b"), F.min(F.when(a, us)).alias("lo"), F.max(F.when(a, us)).alias("hi"))
    score = quality.groupBy("user_id").agg(F.max(F.when(a, F.col("score"))).alias("s_a"), F.max(F.when(b, F.col("score"))).alias("s_b"))
    j = df.join(day, ["user_id", "date"]).join(score, "user_id", "left")
    better = F.coalesce(F.col("s_b") > F.col("s_a"), F.lit(False))
    outside = (us < F.col("lo") - margin_s * 1_000_000) | (us > F.col("hi") + margin_s * 1_000_000)
    keep = F.when(F.col("n_a") == 0, b).when(F.col("n_b") == 0, a).when(F.col("n_a") >= enough, a | (b & outside)).when(better, b).otherwise(a)
    return j.where(keep).select(*df.columns)


def day_gate(df: DataFrame, min_points: int = 5, min_span_h: float = 1, gap_min: float = 5, max_gap_share: float = 0.6) -> DataFrame:
    """GE8: whether a user's day has points, span and few enough gaps; the first reason it fails."""
    w = Window.partitionBy("user_id", "date").orderBy("tracked_at", "event_id")
    us = micros(F.col("tracked_at"))
    d = df.select("user_id", "date", us.alias("us"), (us - F.lag(us).over(w)).alias("gap"))
    g = d.groupBy("user_id", "date").agg(F.count("*").alias("n_points"), (F.max("us") - F.min("us")).alias("span_us"), F.count_if(F.col("gap") > gap_min * 60_000_000).alias("n_gaps"), (F.percentile("gap", F.lit(0.5)) / 1_000_000).alias("median_gap_s"))
    share = F.when(F.col("n_points") > 1, F.col("n_gaps") / (F.col("n_points") - 1)).otherwise(0.0)
    reason = F.when(F.col("n_points") < min_points, "too_few_points").when(F.col("span_us") < min_span_h * 3_600_000_000, "too_short").when(share > max_gap_share, "too_many_gaps").otherwise("ok")
    return g.select("user_id", "date", "n_points", "span_us", "n_gaps", "median_gap_s", reason.alias("reason"))


#: Points that the stay scan looks ahead at first; it doubles them until one lies beyond.
AHEAD = 16


def staypoints(df: DataFrame, keys: list[str], ts: str = "tracked_at", tie: str = "event_id", meters: float = 75, minutes: float = 5, gap_minutes: float = 45) -> DataFrame:
    """GE9: sliding stays. From an anchor on, points within ``meters`` belong together; the first one beyond ends the
    stay, which counts if it lasted long enough and its last step was no gap; that point is the next anchor.

    The next anchor depends on the one before, so rows are sorted by key and time by Spark and scanned in order, in
    Arrow batches: a task holds one batch and the points since its open anchor, however many points a key has, and
    distances are taken in growing windows from the anchor on. Adds started_us, finished_us, lat, lon (mean of the
    points), n_points.
    """
    fields = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)
    names = [*keys, "started_us", "finished_us", "lat", "lon", "n_points"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        def stays(us, lat, lon, near: int) -> tuple[list, int]:
            """(stays, open anchor) of points of one key, the first of which is an anchor with ``near`` points known to be close."""
            rlat, rlon, out, i, n = np.radians(lat), np.radians(lon), [], 0, len(us)
            while i < n:
                at, step, j = max(i, near if i == 0 else 0), AHEAD, -1
                while at < n and j < 0:
                    p, q = rlat[at : at + step], rlon[at : at + step]
                    a = np.sin((p - rlat[i]) / 2) ** 2 + np.cos(rlat[i]) * np.cos(p) * np.sin((q - rlon[i]) / 2) ** 2
                    beyond = np.flatnonzero(2 * EARTH * np.arctan2(np.sqrt(a), np.sqrt(1 - a)) >= meters)
                    j = at + int(beyond[0]) if len(beyond) else -1
                    at, step = at + step, step * 2
                if j < 0:
                    break
                if us[j] - us[i] >= minutes * 6e7 and us[j] - us[j - 1] < gap_minutes * 6e7:
                    out.append((us[i], us[j], lat[i:j].mean(), lon[i:j].mean(), j - i))
                i = j
            return out, i

        key, left = None, None
        for batch in batches:
            cols = [batch.column(i) for i in range(len(keys))]
            us, lat, lon = (batch.column(len(keys) + i).to_numpy(zero_copy_only=False) for i in range(3))
            own = list(zip(*(c.to_pylist() for c in cols)))
            starts = [0, *(i for i in range(1, len(own)) if own[i] != own[i - 1]), len(own)]
            for a, b in zip(starts, starts[1:]):
                part, near = (us[a:b], lat[a:b], lon[a:b]), 0
                if left is not None and key == own[a]:
                    near = len(left[0])
                    part = tuple(np.concatenate(x) for x in zip(left, part))
                key = own[a]
                out, at = stays(*part, near)
                left = tuple(x[at:] for x in part)
                if out:
                    found = list(zip(*out))
                    head = [pa.array([k] * len(out), c.type) for k, c in zip(key, cols)]
                    yield pa.RecordBatch.from_arrays([*head, *(pa.array(x, t) for x, t in zip(found, [pa.int64()] * 2 + [pa.float64()] * 2 + [pa.int64()]))], names)

    d = df.select(*keys, micros(F.col(ts)).alias("us"), "lat", "lon", F.col(tie).alias("tie"))
    return d.repartition(*keys).sortWithinPartitions(*keys, "us", "tie").mapInArrow(scan, f"{fields}, started_us long, finished_us long, lat double, lon double, n_points long")


def triplegs(points: DataFrame, stays: DataFrame, gap_minutes: float = 45) -> DataFrame:
    """GE10: runs of points outside all stays, split where a step is a gap; with length and mean speed (GE11).

    A user's stays do not overlap, so a point is inside one if it is before the end of the last that has started: both
    are put in one order, and nothing is joined.
    """
    us = micros(F.col("tracked_at"))
    p = points.select("user_id", us.alias("us"), F.lit(1).alias("kind"), F.col("event_id").alias("tie"), "lat", "lon", F.lit(None).cast("long").alias("until"))
    s = stays.select("user_id", F.col("started_us").alias("us"), F.lit(0).alias("kind"), F.lit(None).cast(p.schema["tie"].dataType).alias("tie"), *[F.lit(None).cast("double").alias(c) for c in ("lat", "lon")], F.col("finished_us").alias("until"))
    w = Window.partitionBy("user_id").orderBy("us", "kind", "tie")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    d = p.unionByName(s).withColumn("_stay", F.max("until").over(upto)).where("kind = 1")
    d = d.withColumn("inside", F.coalesce(F.col("us") < F.col("_stay"), F.lit(False)))
    prev = lambda c: F.lag(c).over(w)
    d = d.withColumns({"new": F.coalesce(prev("inside") | (F.col("us") - prev("us") > gap_minutes * 60_000_000), F.lit(True)).cast("int"), "dist": haversine(prev("lat"), prev("lon"), F.col("lat"), F.col("lon"))}).where("not inside")
    d = d.withColumn("leg", F.sum("new").over(upto))
    return d.groupBy("user_id", "leg").agg(F.min("us").alias("started_us"), F.max("us").alias("finished_us"), F.count("*").alias("n_points"), F.sum(F.when(F.col("new") == 0, F.col("dist")).otherwise(0.0)).alias("meters"))


def transport_mode(kmh: Column, slow: float = 15, fast: float = 100) -> Column:
    """GE11: by mean speed."""
    return F.when(kmh <= slow, "slow_mobility").when(kmh <= fast, "motorized_mobility").when(kmh.isNotNull(), "fast_mobility")


def transport_type(mode: Column) -> Column:
    return F.when(mode == "slow_mobility", "active").when(mode.isin("motorized_mobility", "fast_mobility"), "automated").otherwise("unknown")


def trips(stays: DataFrame, activity_minutes: float = 15, gap_minutes: float | None = None) -> DataFrame:
    """GE12: what lies between one activity stay and the next."""
    a = stays.where((F.col("finished_us") - F.col("started_us")) >= activity_minutes * 60_000_000)
    w = Window.partitionBy("user_id").orderBy("started_us")
    t = a.select("user_id", F.col("finished_us").alias("started_us"), F.lead("started_us").over(w).alias("finished_us"), F.col("lat").alias("from_lat"), F.col("lon").alias("from_lon"), F.lead("lat").over(w).alias("to_lat"), F.lead("lon").over(w).alias("to_lon"))
    t = t.where(F.col("finished_us") > F.col("started_us"))
    return t if gap_minutes is None else t.where(F.col("finished_us") - F.col("started_us") <= gap_minutes * 60_000_000)


def trip_ends(trips: DataFrame, home: DataFrame, meters: float = 75) -> DataFrame:
    """GE15: where trips start and end, home or out; the trip's place is its origin's, else its destination's, and trips at home go.

    ``trips``: user_id, from_lat, from_lon, to_lat, to_lon. An end without coordinates has no type.
    """
    j = trips.join(home, "user_id", "left")

    def kind(lat: str, lon: str) -> Column:
        near = F.coalesce(haversine(F.col(lat), F.col(lon), F.col("home_lat"), F.col("home_lon")) <= meters, F.lit(False))
        return F.when(F.col(lat).isNotNull() & F.col(lon).isNotNull(), F.when(near, "home").otherwise("out_of_home"))

    j = j.withColumns({"origin_type": kind("from_lat", "from_lon"), "destination_type": kind("to_lat", "to_lon")})
    return j.withColumn("location_type", F.coalesce("origin_type", "destination_type")).where("location_type <> 'home'").drop("home_lat", "home_lon")


def trip_modes(legs: DataFrame, keys: list[str]) -> DataFrame:
    """GE13: the modes of a trip's legs, and the one with most time (ties: by name)."""
    per = legs.groupBy(*keys, "mode").agg(F.sum("duration_us").alias("us"))
    g = per.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_set("mode")), ",").alias("modes"), F.min(F.struct((-F.col("us")).alias("us"), "mode")).alias("top"))
    return g.select(*keys, "modes", F.col("top.mode").alias("primary_mode"), transport_type(F.col("top.mode")).alias("transport_type"))


def split_long(df: DataFrame, max_minutes: int = 120) -> DataFrame:
    """GE14: intervals longer than the limit fall into max(2, floor(length / limit)) equal parts."""
    us = F.col("finished_us") - F.col("started_us")
    n = F.when(us > max_minutes * 60_000_000, F.greatest(F.lit(2), F.expr(f"(finished_us - started_us) div {max_minutes * 60_000_000}").cast("int"))).otherwise(1)
    d = df.withColumn("n_parts", n).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("n_parts") - 1)))
    cut = lambda i: F.expr(f"started_us + ((finished_us - started_us) * {i}) div n_parts")
    return d.withColumns({"part_start_us": cut("part"), "part_end_us": cut("(part + 1)")})


def label_home(df: DataFrame, home: DataFrame, meters: float = 75) -> DataFrame:
    """GE17: home within ``meters`` of the user's home, else out; without a home all is out. ``home``: user_id, home_lat, home_lon."""
    j = df.join(home, "user_id", "left")
    near = haversine(F.col("lat"), F.col("lon"), F.col("home_lat"), F.col("home_lon")) <= meters
    return j.withColumn("location_type", F.when(near, "home").otherwise("out_of_home"))


def home_location(stays: DataFrame, night_points: int = 1) -> DataFrame:
    """GE16: the first that a user has of: longest stay starting 01-06 h, first starting 06-09 h, last starting 21-23 h, longest of all."""
    s = stays.withColumns({"hour": F.hour(F.timestamp_micros("started_us")), "us": F.col("finished_us") - F.col("started_us")})
    place = F.struct("lat", "lon")
    pick = lambda cond, by: F.max_by(F.when(cond, place), F.when(cond, by))
    longest, first, last = F.struct("us", -F.col("started_us")), F.struct(-F.col("started_us")), F.struct("started_us")
    night = F.col("hour").between(1, 5) & (F.col("n_points") >= night_points)
    g = s.groupBy("user_id").agg(pick(night, longest).alias("a"), pick(F.col("hour").between(6, 8), first).alias("b"), pick(F.col("hour").between(21, 22), last).alias("c"), F.max_by(place, longest).alias("d"))
    best = F.coalesce("a", "b", "c", "d")
    return g.select("user_id", best["lat"].alias("home_lat"), best["lon"].alias("home_lon"))


def probe_location(asked: DataFrame, points: DataFrame, minutes: int = 30) -> DataFrame:
    """GE18: home if any fix within ``minutes`` of the moment is near home; without one, as the day's nearest fix; else out.

    ``asked``: user_id, date, at_us; ``points``: user_id, date, us, near (boolean).
    """
    p = points.select(F.col("user_id").alias("_u"), F.col("date").alias("_d"), "us", "near")
    j = asked.join(p, (F.col("user_id") == F.col("_u")) & (F.col("date") == F.col("_d")), "left")
    away = F.abs(F.col("us") - F.col("at_us"))
    g = j.groupBy("user_id", "date", "at_us").agg(F.max(F.when(away <= minutes * 60_000_000, F.col("near"))).alias("inside"), F.min_by("near", F.struct(away, "us")).alias("nearest"))
    return g.select("user_id", "date", "at_us", F.when(F.coalesce("inside", "nearest", F.lit(False)), "home").otherwise("out_of_home").alias("location_type"))
