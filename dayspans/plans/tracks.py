"""Queries of the track operators. Thresholds are scaled to the given events, hours apart instead of seconds."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.times import micros
from ..operators import track
from .registry import query

c = F.col

HAV = "(2 * 6371000.0::DOUBLE * atan2(sqrt(A), sqrt(1 - A)))"


def hav(lat1, lon1, lat2, lon2):
    a = f"(pow(sin((radians({lat2}) - radians({lat1})) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin((radians({lon2}) - radians({lon1})) / 2), 2))"
    return HAV.replace("A", a)


STEPS = f"s AS (SELECT *, (epoch_us(tracked_at) - epoch_us(lag(tracked_at) OVER w)) / 1000000.0::DOUBLE AS dt, {hav('lag(lat) OVER w', 'lag(lon) OVER w', 'lat', 'lon')} AS dist FROM v_gps WINDOW w AS (PARTITION BY user_id, source ORDER BY tracked_at, event_id))"
KEYS, ORDER = ["user_id", "source"], ["tracked_at", "event_id"]


@query("ge1_haversine", f"WITH {STEPS} SELECT event_id, round(dist, 3) AS meters FROM s WHERE dist IS NOT NULL")
def _(v):
    return track.steps(v.gps, KEYS, ORDER).where("dist is not null").select("event_id", F.round("dist", 3).alias("meters"))


@query("ge2_planar", "WITH s AS (SELECT event_id, sqrt(pow(lat - lag(lat) OVER w, 2) + pow(lon - lag(lon) OVER w, 2)) * 111000 AS dist FROM v_gps WINDOW w AS (PARTITION BY user_id, source ORDER BY tracked_at, event_id)) SELECT event_id, round(dist, 3) AS meters FROM s WHERE dist IS NOT NULL")
def _(v):
    return track.steps(v.gps, KEYS, ORDER, track.planar).where("dist is not null").select("event_id", F.round("dist", 3).alias("meters"))


@query("ge3_drop_jumps", f"WITH {STEPS} SELECT event_id FROM s WHERE NOT coalesce(dt < 3 * 3600 AND dist > 5000, false)")
def _(v):
    return track.drop_jumps(v.gps, KEYS, ORDER, max_km=5).select("event_id")


@query("ge4_drop_fast", f"WITH {STEPS} SELECT event_id FROM s WHERE NOT coalesce(dt > 0 AND dist > dt * (20 / 3.6::DOUBLE), false)")
def _(v):
    return track.drop_fast(v.gps, KEYS, ORDER, max_kmh=20).select("event_id")


@query("ge5_flag_outliers", """WITH s AS (SELECT *, (epoch_us(tracked_at) - epoch_us(lag(tracked_at) OVER w)) / 1000000.0::DOUBLE AS dt, sqrt(pow(lat - lag(lat) OVER w, 2) + pow(lon - lag(lon) OVER w, 2)) * 111000 AS dist,
  count(lat) OVER p AS n, avg(lat) OVER p AS mlat, stddev_pop(lat) OVER p AS slat, avg(lon) OVER p AS mlon, stddev_pop(lon) OVER p AS slon FROM v_gps WINDOW w AS (PARTITION BY user_id, source ORDER BY tracked_at, event_id), p AS (PARTITION BY user_id, source))
SELECT event_id, coalesce(dt > 0 AND dist / dt > 2, false) OR coalesce(n > 5 AND slat > 0 AND abs(lat - mlat) / slat > 2.5, false) OR coalesce(n > 5 AND slon > 0 AND abs(lon - mlon) / slon > 2.5, false) AS is_outlier FROM s""")
def _(v):
    return track.flag_outliers(v.gps, KEYS, ORDER, max_speed=2, max_z=2.5).select("event_id", "is_outlier")


QUALITY = """q AS (WITH d AS (SELECT user_id, source, date, lat, lon, (epoch_us(lead(tracked_at) OVER w) - epoch_us(tracked_at)) / 1000000.0::DOUBLE AS gap FROM v_gps WINDOW w AS (PARTITION BY user_id, source ORDER BY tracked_at, event_id)),
g AS (SELECT user_id, source, count(*) AS points, count(DISTINCT date) AS days, avg(CASE WHEN gap > 0 AND gap < 86400 THEN gap END) AS mean_gap, least(200.0::DOUBLE, (quantile_cont(lat, 0.95) - quantile_cont(lat, 0.05)) * (quantile_cont(lon, 0.95) - quantile_cont(lon, 0.05)) * 111.0::DOUBLE * 111.0::DOUBLE) AS area FROM d GROUP BY user_id, source)
SELECT *, least(100.0::DOUBLE, least(40.0::DOUBLE, points / days / 4) + least(30.0::DOUBLE, area / 3) + least(30.0::DOUBLE, coalesce(30 * (1 - least(1.0::DOUBLE, mean_gap / 300)), 0.0::DOUBLE))) AS score FROM g)"""


@query("ge6_source_quality", f"WITH {QUALITY} SELECT user_id, source, points, days, round(mean_gap, 4) AS mean_gap, round(area, 6) AS area, round(score, 6) AS score FROM q")
def _(v):
    q = track.source_quality(v.gps, KEYS, ORDER, 86_400)
    return q.select("user_id", "source", "points", "days", F.round("mean_gap", 4).alias("mean_gap"), F.round("area", 6).alias("area"), F.round("score", 6).alias("score"))


@query("ge7_fuse_sources", f"""WITH {QUALITY}, d AS (SELECT user_id, date, count_if(source = 'logger') AS na, count_if(source = 'phone') AS nb, min(CASE WHEN source = 'logger' THEN epoch_us(tracked_at) END) AS lo, max(CASE WHEN source = 'logger' THEN epoch_us(tracked_at) END) AS hi FROM v_gps GROUP BY user_id, date),
sc AS (SELECT user_id, max(CASE WHEN source = 'logger' THEN score END) AS sa, max(CASE WHEN source = 'phone' THEN score END) AS sb FROM q GROUP BY user_id)
SELECT event_id FROM v_gps JOIN d USING (user_id, date) LEFT JOIN sc USING (user_id) WHERE CASE WHEN na = 0 THEN source = 'phone' WHEN nb = 0 THEN source = 'logger' WHEN na >= 2 THEN source = 'logger' OR epoch_us(tracked_at) < lo - 300000000 OR epoch_us(tracked_at) > hi + 300000000 WHEN coalesce(sb > sa, false) THEN source = 'phone' ELSE source = 'logger' END""")
def _(v):
    return track.fuse_sources(v.gps, "logger", "phone", track.source_quality(v.gps, KEYS, ORDER, 86_400), enough=2).select("event_id")


@query("ge8_day_gate", """WITH d AS (SELECT user_id, date, epoch_us(tracked_at) AS us, epoch_us(tracked_at) - epoch_us(lag(tracked_at) OVER (PARTITION BY user_id, date ORDER BY tracked_at, event_id)) AS gap FROM v_gps),
g AS (SELECT user_id, date, count(*) AS n_points, max(us) - min(us) AS span_us, coalesce(count_if(gap > 360 * 60000000::BIGINT), 0) AS n_gaps, round(quantile_cont(gap, 0.5) / 1000000, 4) AS median_gap_s FROM d GROUP BY user_id, date)
SELECT *, CASE WHEN n_points < 3 THEN 'too_few_points' WHEN span_us < 3600000000 THEN 'too_short' WHEN n_gaps / (n_points - 1) > 0.6 THEN 'too_many_gaps' ELSE 'ok' END AS reason FROM g""")
def _(v):
    return track.day_gate(v.gps, min_points=3, gap_min=360).withColumn("median_gap_s", F.round("median_gap_s", 4))


def stays(v):
    return track.staypoints(v.gps, ["user_id"], meters=75, minutes=60, gap_minutes=2880)


STAYS = f"""RECURSIVE p AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY tracked_at, event_id) AS i, epoch_us(tracked_at) AS us, lat, lon FROM v_gps),
j AS (SELECT a.user_id, a.i, min(b.i) AS nxt FROM p a JOIN p b ON a.user_id = b.user_id AND b.i > a.i AND b.i <= a.i + 60 AND {hav('a.lat', 'a.lon', 'b.lat', 'b.lon')} >= 75 GROUP BY a.user_id, a.i),
r AS (SELECT user_id, CAST(1 AS BIGINT) AS i FROM p WHERE i = 1 UNION ALL SELECT j.user_id, j.nxt FROM r JOIN j ON r.user_id = j.user_id AND r.i = j.i),
s AS (SELECT r.user_id, r.i, j.nxt, a.us AS started_us, b.us AS finished_us FROM r JOIN j USING (user_id, i) JOIN p a ON a.user_id = r.user_id AND a.i = r.i JOIN p b ON b.user_id = r.user_id AND b.i = j.nxt JOIN p l ON l.user_id = r.user_id AND l.i = j.nxt - 1 WHERE b.us - a.us >= 60 * 60000000::BIGINT AND b.us - l.us < 2880 * 60000000::BIGINT),
stays AS (SELECT s.user_id, s.started_us, s.finished_us, avg(p.lat) AS lat, avg(p.lon) AS lon, count(*) AS n_points FROM s JOIN p ON p.user_id = s.user_id AND p.i >= s.i AND p.i < s.nxt GROUP BY s.user_id, s.started_us, s.finished_us)"""


@query("ge9_staypoints", f"WITH {STAYS} SELECT user_id, started_us, finished_us, n_points FROM stays")
def _(v):
    return stays(v).select("user_id", "started_us", "finished_us", "n_points")


def legs(v):
    return track.triplegs(v.gps, stays(v), 1440)


@query("ge10_triplegs", f"""WITH {STAYS}, pt AS (SELECT g.user_id, g.event_id, epoch_us(tracked_at) AS us, lat, lon, EXISTS (SELECT 1 FROM stays s WHERE s.user_id = g.user_id AND epoch_us(g.tracked_at) >= s.started_us AND epoch_us(g.tracked_at) < s.finished_us) AS inside FROM v_gps g),
pn AS (SELECT *, coalesce(lag(inside) OVER w OR us - lag(us) OVER w > 1440 * 60000000::BIGINT, true) AS new, {hav('lag(lat) OVER w', 'lag(lon) OVER w', 'lat', 'lon')} AS dist FROM pt WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)),
pl AS (SELECT *, sum(CASE WHEN new THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS leg FROM pn WHERE NOT inside)
SELECT user_id, leg, min(us) AS started_us, max(us) AS finished_us, count(*) AS n_points, round(sum(CASE WHEN new THEN 0 ELSE dist END), 3) AS meters FROM pl GROUP BY user_id, leg""")
def _(v):
    return legs(v).select("user_id", "leg", "started_us", "finished_us", "n_points", F.round("meters", 3).alias("meters"))


@query("ge11_transport_mode", f"WITH {STEPS}, k AS (SELECT event_id, dist / dt * 3.6::DOUBLE AS kmh FROM s WHERE dt > 0), m AS (SELECT event_id, CASE WHEN kmh <= 0.02 THEN 'slow_mobility' WHEN kmh <= 0.5 THEN 'motorized_mobility' ELSE 'fast_mobility' END AS mode FROM k) SELECT event_id, mode, CASE WHEN mode = 'slow_mobility' THEN 'active' ELSE 'automated' END AS transport_type FROM m")
def _(v):
    s = track.steps(v.gps, KEYS, ORDER).where("dt > 0").withColumn("mode", track.transport_mode(c("dist") / c("dt") * 3.6, 0.02, 0.5))
    return s.select("event_id", "mode", track.transport_type(c("mode")).alias("transport_type"))


TRIPS = "trips AS (SELECT * FROM (SELECT user_id, finished_us AS started_us, lead(started_us) OVER (PARTITION BY user_id ORDER BY started_us) AS finished_us FROM stays WHERE finished_us - started_us >= 360 * 60000000::BIGINT) t WHERE finished_us > started_us)"


@query("ge12_trips", f"WITH {STAYS}, {TRIPS} SELECT * FROM trips")
def _(v):
    return track.trips(stays(v), 360).select("user_id", "started_us", "finished_us")


LEG_MODES = "l AS (SELECT user_id, date, travel_mode AS mode, CAST(1 + event_id % 7 AS BIGINT) AS us FROM v_points), g AS (SELECT user_id, date, mode, sum(us) AS us FROM l GROUP BY user_id, date, mode)"


@query("ge13_trip_modes", f"WITH {LEG_MODES} SELECT user_id, date, string_agg(mode, ',' ORDER BY mode) AS modes, first(mode ORDER BY us DESC, mode) AS primary_mode FROM g GROUP BY user_id, date")
def _(v):
    d = v.points.select("user_id", "date", c("travel_mode").alias("mode"), (1 + c("event_id") % 7).alias("duration_us"))
    return track.trip_modes(d, ["user_id", "date"]).select("user_id", "date", "modes", "primary_mode")


@query("ge14_split_long", f"WITH {STAYS}, {TRIPS}, n AS (SELECT *, CASE WHEN finished_us - started_us > 720 * 60000000::BIGINT THEN greatest(2, (finished_us - started_us) // 43200000000) ELSE 1 END AS n FROM trips), e AS (SELECT *, unnest(range(0, n)) AS part FROM n) SELECT user_id, CAST(part AS INT) AS part, started_us + ((finished_us - started_us) * part) // n AS part_start_us, started_us + ((finished_us - started_us) * (part + 1)) // n AS part_end_us FROM e")
def _(v):
    return track.split_long(track.trips(stays(v), 360), 720).select("user_id", "part", "part_start_us", "part_end_us")


HOME = "home AS (SELECT user_id, max(lat) AS home_lat, max(lon) AS home_lon FROM v_gps GROUP BY user_id)"


def home(v):
    return v.gps.groupBy("user_id").agg(F.max("lat").alias("home_lat"), F.max("lon").alias("home_lon"))


TRIP_ENDS = "te AS (SELECT * FROM (SELECT user_id, finished_us AS started_us, lead(started_us) OVER w AS finished_us, lat AS from_lat, lon AS from_lon, lead(lat) OVER w AS to_lat, lead(lon) OVER w AS to_lon FROM stays WHERE finished_us - started_us >= 360 * 60000000::BIGINT WINDOW w AS (PARTITION BY user_id ORDER BY started_us)) t WHERE finished_us > started_us)"


@query("ge15_trip_ends", f"WITH {STAYS}, {TRIP_ENDS}, {HOME}, k AS (SELECT te.*, CASE WHEN {hav('from_lat', 'from_lon', 'home_lat', 'home_lon')} <= 2500 THEN 'home' ELSE 'out_of_home' END AS origin_type, CASE WHEN {hav('to_lat', 'to_lon', 'home_lat', 'home_lon')} <= 2500 THEN 'home' ELSE 'out_of_home' END AS destination_type FROM te LEFT JOIN home ON home.user_id = te.user_id) SELECT user_id, started_us, finished_us, round(from_lat, 6) AS from_lat, round(from_lon, 6) AS from_lon, origin_type, destination_type, coalesce(origin_type, destination_type) AS location_type FROM k WHERE coalesce(origin_type, destination_type) <> 'home'")
def _(v):
    t = track.trip_ends(track.trips(stays(v), 360), home(v), 2500)
    return t.select("user_id", "started_us", "finished_us", F.round("from_lat", 6).alias("from_lat"), F.round("from_lon", 6).alias("from_lon"), "origin_type", "destination_type", "location_type")


@query("ge16_home_location", f"""WITH {STAYS}, h AS (SELECT *, hour(make_timestamp(started_us)) AS h, finished_us - started_us AS us FROM stays),
a AS (SELECT DISTINCT ON (user_id) user_id, lat, lon FROM h WHERE h BETWEEN 1 AND 5 ORDER BY user_id, us DESC, started_us), b AS (SELECT DISTINCT ON (user_id) user_id, lat, lon FROM h WHERE h BETWEEN 6 AND 8 ORDER BY user_id, started_us),
c AS (SELECT DISTINCT ON (user_id) user_id, lat, lon FROM h WHERE h BETWEEN 21 AND 22 ORDER BY user_id, started_us DESC), d AS (SELECT DISTINCT ON (user_id) user_id, lat, lon FROM h ORDER BY user_id, us DESC, started_us)
SELECT d.user_id, round(coalesce(a.lat, b.lat, c.lat, d.lat), 6) AS home_lat, round(coalesce(a.lon, b.lon, c.lon, d.lon), 6) AS home_lon FROM d LEFT JOIN a USING (user_id) LEFT JOIN b USING (user_id) LEFT JOIN c USING (user_id)""")
def _(v):
    return track.home_location(stays(v)).select("user_id", F.round("home_lat", 6).alias("home_lat"), F.round("home_lon", 6).alias("home_lon"))


@query("ge17_label_home", f"WITH {HOME} SELECT event_id, CASE WHEN {hav('lat', 'lon', 'home_lat', 'home_lon')} <= 2500 THEN 'home' ELSE 'out_of_home' END AS location_type FROM v_gps JOIN home USING (user_id)")
def _(v):
    return track.label_home(v.gps, home(v), 2500).select("event_id", "location_type")


@query("ge18_probe_location", f"""WITH {HOME}, p AS (SELECT user_id, date, epoch_us(tracked_at) AS us, {hav('lat', 'lon', 'home_lat', 'home_lon')} <= 2500 AS near FROM v_gps JOIN home USING (user_id)),
q AS (SELECT DISTINCT user_id, date, epoch_us(CAST(date AS TIMESTAMP)) + 43200000000 AS at_us FROM v_gps),
j AS (SELECT q.*, p.near, abs(us - at_us) AS away, us FROM q LEFT JOIN p USING (user_id, date))
SELECT user_id, date, at_us, CASE WHEN coalesce(bool_or(near) FILTER (WHERE away <= 120 * 60000000::BIGINT), first(near ORDER BY away, us), false) THEN 'home' ELSE 'out_of_home' END AS location_type FROM j GROUP BY user_id, date, at_us""")
def _(v):
    p = track.label_home(v.gps, home(v), 2500).select("user_id", "date", micros(c("tracked_at")).alias("us"), (c("location_type") == "home").alias("near"))
    q = v.gps.select("user_id", "date", (micros(c("date").cast("timestamp_ntz")) + 43_200_000_000).alias("at_us")).distinct()
    return track.probe_location(q, p, 120)
