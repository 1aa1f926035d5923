"""Queries of the episode, clustering and fragmentation operators; thresholds are scaled to events hours apart."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.times import micros
from ..operators import clusters as cl
from ..operators import episodes as ep
from ..operators import fragmentation as fr
from .registry import query

c = F.col
UD = ["user_id", "date"]
MIN = "60000000.0::DOUBLE"

SCREEN = "scr AS (SELECT user_id, date, epoch_us(ts) AS us, action LIKE '%ON' AS is_on, event_id FROM v_screen WHERE action LIKE '%ON%' OR action LIKE '%OFF%')"
DIGITAL = SCREEN + """, ch AS (SELECT *, lag(is_on) OVER w AS was FROM scr WINDOW w AS (PARTITION BY user_id, date ORDER BY us, event_id)),
prs AS (SELECT *, lead(us) OVER (PARTITION BY user_id, date ORDER BY us, event_id) AS nxt FROM ch WHERE was IS NULL OR was <> is_on),
dig AS (SELECT user_id, date, us AS start_us, coalesce(nxt, epoch_us(CAST(date AS TIMESTAMP)) + 86399000000) AS end_us FROM prs WHERE is_on)"""


def digital(v):
    return ep.pair_events(ep.screen_events(v.screen), UD, ep.day_us(c("date")) + 86_399_000_000)


@query("ep1_pair_events", f"WITH {DIGITAL} SELECT user_id, date, start_us, end_us FROM dig")
def _(v):
    return digital(v)


@query("ep2_rapid_toggles", f"WITH {SCREEN}, f AS (SELECT *, coalesce(NOT is_on AND lag(is_on) OVER w AND us - lag(us) OVER w < 3600000000, false) AS off FROM scr WINDOW w AS (PARTITION BY user_id, date ORDER BY us, event_id)), g AS (SELECT *, coalesce(lead(off) OVER (PARTITION BY user_id, date ORDER BY us, event_id), false) AS nxt FROM f) SELECT event_id, is_on FROM g WHERE NOT off AND NOT nxt")
def _(v):
    return ep.drop_rapid_toggles(ep.screen_events(v.screen), UD, 3600).select("event_id", "is_on")


def points(v):
    return v.points.withColumn("us", micros(c("ts")))


@query("ep3_marked_episodes", """WITH p AS (SELECT user_id, date, epoch_us(ts) AS us, event_id, coalesce(start_end = 'Start', false) AS s, coalesce(start_end = 'End', false) AS e, app <> 'No use' AS a, max(epoch_us(ts)) OVER (PARTITION BY user_id, date) AS last FROM v_points),
x AS (SELECT *, e OR (NOT a AND NOT s) AS x FROM p),
g AS (SELECT *, coalesce(sum(CASE WHEN x THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, date ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seg FROM x),
r AS (SELECT user_id, date, seg, coalesce(max(us) FILTER (WHERE s AND NOT x), min(us) FILTER (WHERE NOT x)) AS start_us, coalesce(max(us) FILTER (WHERE x), max(last)) AS end_us FROM g GROUP BY user_id, date, seg)
SELECT user_id, date, start_us, end_us FROM r WHERE start_us IS NOT NULL AND end_us - start_us >= 20000000""")
def _(v):
    return ep.marked_episodes(points(v), UD, c("start_end") == "Start", c("app") != "No use", c("start_end") == "End")


def run_sql(on: str, minutes: int) -> str:
    return f"""p AS (SELECT user_id, date, epoch_us(ts) AS us, event_id, coalesce({on}, false) AS o, max(epoch_us(ts)) OVER (PARTITION BY user_id, date) AS last FROM v_points),
q AS (SELECT *, lag(o) OVER (PARTITION BY user_id, date ORDER BY us, event_id) AS was FROM p),
r AS (SELECT *, lead(us) OVER (PARTITION BY user_id, date ORDER BY us, event_id) AS nxt FROM q WHERE was IS NULL OR was <> o),
runs AS (SELECT user_id, date, us AS start_us, coalesce(nxt, last) AS end_us FROM r WHERE o AND coalesce(nxt, last) - us >= {minutes} * 60000000::BIGINT)"""


MOVING = "travel_mode NOT IN ('Missing', 'Staying') OR speed > 3 OR (travel_mode = 'Missing' AND speed > 2)"


def moving(v):
    m = c("travel_mode")
    return ep.runs_to_episodes(points(v), UD, ~m.isin("Missing", "Staying") | (c("speed") > 3) | ((m == "Missing") & (c("speed") > 2)), 2)


@query("ep4_moving_episodes", f"WITH {run_sql(MOVING, 2)} SELECT * FROM runs")
def _(v):
    return moving(v)


def at_home(v):
    return ep.runs_to_episodes(points(v), UD, c("place").isin("Home", "~Home"), 5)


HOME_SQL = run_sql("place IN ('Home', '~Home')", 5)


@query("ep5_home_episodes", f"WITH {HOME_SQL} SELECT * FROM runs")
def _(v):
    return at_home(v)


def merged_sql(source: str, keys: str, gap: int) -> str:
    return f"""m1 AS (SELECT *, max(end_us) OVER (PARTITION BY {keys} ORDER BY start_us, end_us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {source}),
m2 AS (SELECT *, sum(CASE WHEN reach IS NULL OR start_us - reach > {gap}::BIGINT THEN 1 ELSE 0 END) OVER (PARTITION BY {keys} ORDER BY start_us, end_us ROWS UNBOUNDED PRECEDING) AS g FROM m1),
mrg AS (SELECT {keys}, min(start_us) AS start_us, max(end_us) AS end_us, count(*) AS n_merged FROM m2 GROUP BY {keys}, g)"""


@query("ep6_merge_intervals", f"WITH {DIGITAL}, {merged_sql('dig', 'user_id', 3600000000)} SELECT * FROM mrg")
def _(v):
    return ep.merge_intervals(digital(v).drop("date"), ["user_id"], 60 * ep.MINUTE)


BOTH = f"{DIGITAL}, {run_sql(MOVING, 2)}, mov AS (SELECT * FROM runs)"
OVERLAP = "ovl AS (SELECT a.user_id, a.date, greatest(a.start_us, b.start_us) AS start_us, least(a.end_us, b.end_us) AS end_us FROM dig a JOIN mov b ON a.user_id = b.user_id AND a.date = b.date AND a.start_us < b.end_us AND b.start_us < a.end_us)"


@query("ep7_intersect_intervals", f"WITH {BOTH}, {OVERLAP} SELECT * FROM ovl WHERE end_us - start_us >= 60000000")
def _(v):
    return ep.intersect_intervals(digital(v), moving(v), UD, ep.MINUTE)


@query("ep8_any_overlap", f"WITH {BOTH}, {OVERLAP} SELECT user_id, date, start_us, end_us, round((end_us - start_us) / {MIN}, 8) AS minutes FROM ovl WHERE end_us > start_us")
def _(v):
    return ep.intersect_intervals(digital(v), moving(v), UD).withColumn("minutes", F.round((c("end_us") - c("start_us")) / ep.MINUTE, 8))


@query("ep9_majority_transport", f"""WITH {run_sql(MOVING, 2)}, j AS (SELECT e.*, coalesce(sum(CASE WHEN p.travel_mode IN ('AT', 'Walking') THEN 1 ELSE 0 END), 0) AS a, coalesce(sum(CASE WHEN p.travel_mode = 'PT' THEN 1 ELSE 0 END), 0) AS m FROM runs e LEFT JOIN v_points p ON p.user_id = e.user_id AND p.date = e.date AND epoch_us(p.ts) BETWEEN e.start_us AND e.end_us GROUP BY ALL)
SELECT user_id, date, start_us, end_us, CASE WHEN a > m THEN 'active' WHEN m > 0 THEN 'mechanised' ELSE 'none' END AS transport FROM j""")
def _(v):
    return ep.majority_transport(moving(v), points(v), UD, c("travel_mode").isin("AT", "Walking"), c("travel_mode") == "PT")


@query("ep10_clip_to_waking", f"WITH {DIGITAL}, k AS (SELECT user_id, date, greatest(start_us, epoch_us(CAST(date AS TIMESTAMP)) + 18000000000) AS start_us, least(end_us, epoch_us(CAST(date AS TIMESTAMP)) + 104400000000) AS end_us FROM dig) SELECT * FROM k WHERE end_us > start_us")
def _(v):
    return ep.clip_to_waking(digital(v), 5)


def places(v):
    home, out = at_home(v), ep.runs_to_episodes(points(v), UD, ~c("place").isin("Home", "~Home"), 5)
    return home.withColumn("place", F.lit("home")).unionByName(out.withColumn("place", F.lit("out_of_home")))


PLACES = f"{HOME_SQL}, {run_sql('NOT place IN (' + chr(39) + 'Home' + chr(39) + ', ' + chr(39) + '~Home' + chr(39) + ')', 5).replace('p AS', 'p2 AS').replace('q AS', 'q2 AS').replace('r AS', 'r2 AS').replace('runs AS', 'runs2 AS').replace('FROM p)', 'FROM p2)').replace('FROM q WHERE', 'FROM q2 WHERE').replace('FROM r WHERE', 'FROM r2 WHERE')}, plc AS (SELECT *, 'home' AS place FROM runs UNION ALL SELECT *, 'out_of_home' FROM runs2)"


@query("ep11_dominant_label", f"""WITH {DIGITAL}, {PLACES}, j AS (SELECT d.user_id, d.date, d.start_us, d.end_us, sum(CASE WHEN place = 'home' THEN greatest(least(d.end_us, p.end_us) - greatest(d.start_us, p.start_us), 0) ELSE 0 END) AS own, sum(CASE WHEN place <> 'home' THEN greatest(least(d.end_us, p.end_us) - greatest(d.start_us, p.start_us), 0) ELSE 0 END) AS other FROM dig d LEFT JOIN plc p ON d.user_id = p.user_id AND d.date = p.date GROUP BY ALL)
SELECT user_id, date, start_us, end_us, CASE WHEN own > other THEN 'home' ELSE 'out_of_home' END AS location_type FROM j""")
def _(v):
    return ep.dominant_label(digital(v), places(v), UD)


def near_fixes(v):
    return points(v).select("user_id", "date", "us", (c("place") == "~Home").alias("near"))


NEAR = "place = '~Home'"


@query("ep12_fill_day", f"""WITH {PLACES}, s AS (SELECT user_id, date, epoch_us(CAST(date AS TIMESTAMP)) AS lo, start_us, end_us, place FROM plc WHERE end_us > start_us),
n AS (SELECT *, lead(start_us) OVER w AS nxt, row_number() OVER w AS i FROM s WINDOW w AS (PARTITION BY user_id, date ORDER BY start_us, end_us)),
gp AS (SELECT user_id, date, end_us AS a, nxt AS b FROM n WHERE nxt > end_us),
gj AS (SELECT gp.*, {NEAR} AS near, abs(epoch_us(p.ts) - a) AS away, epoch_us(p.ts) AS us FROM gp LEFT JOIN v_points p ON p.user_id = gp.user_id AND p.date = gp.date),
gl AS (SELECT user_id, date, a, b, CASE WHEN coalesce(bool_or(near) FILTER (WHERE away <= 120 * 60000000::BIGINT), first(near ORDER BY away, us), false) THEN 'home' ELSE 'out_of_home' END AS place FROM gj GROUP BY user_id, date, a, b)
SELECT user_id, date, start_us, end_us, place, 'stay' AS kind FROM n UNION ALL SELECT user_id, date, lo, start_us, place, 'gap' FROM n WHERE i = 1 AND start_us > lo
UNION ALL SELECT user_id, date, a, b, place, 'gap' FROM gl UNION ALL SELECT user_id, date, end_us, lo + 86400000000, place, 'gap' FROM n WHERE nxt IS NULL AND lo + 86400000000 > end_us""")
def _(v):
    return ep.fill_day(places(v), UD, near_fixes(v), 120)


@query("ep13_hourly_default", """WITH d AS (SELECT DISTINCT user_id, date FROM v_points), h AS (SELECT *, unnest(range(0, 24)) AS hour FROM d),
j AS (SELECT h.user_id, h.date, h.hour, bool_or(p.place = '~Home') FILTER (WHERE epoch_us(p.ts) >= epoch_us(CAST(h.date AS TIMESTAMP)) + h.hour * 3600000000 - 1800000000 AND epoch_us(p.ts) < epoch_us(CAST(h.date AS TIMESTAMP)) + h.hour * 3600000000 + 5400000000) AS n FROM h LEFT JOIN v_points p ON p.user_id = h.user_id AND p.date = h.date GROUP BY ALL)
SELECT user_id, date, CAST(hour AS INT) AS hour, CASE WHEN coalesce(n, false) THEN 'home' ELSE 'out_of_home' END AS location_type FROM j""")
def _(v):
    return ep.hourly_default(v.points.select("user_id", "date").distinct(), near_fixes(v))


@query("ep14_stationary", f"WITH {HOME_SQL} SELECT user_id, date, start_us, end_us, 'stationary' AS movement_state FROM runs WHERE end_us - start_us >= 15 * 60000000")
def _(v):
    return at_home(v).where(c("end_us") - c("start_us") >= 15 * ep.MINUTE).withColumn("movement_state", F.lit("stationary"))


TIMELINE = f"{BOTH}, tl AS (SELECT *, row_number() OVER w AS episode_number, start_us - lag(start_us) OVER w AS since_prev_us FROM (SELECT *, 'digital' AS episode_type FROM dig UNION ALL SELECT *, 'moving' FROM mov) t WINDOW w AS (PARTITION BY user_id, date ORDER BY start_us, end_us, episode_type))"


def typed(v):
    return ep.timeline({"digital": digital(v), "moving": moving(v)}, UD)


# Every type of episode with what it has: digital ones a location, moving and overlapping ones a transport.
MOBILE = """mt AS (SELECT m.user_id, m.date, m.start_us, m.end_us, CASE WHEN coalesce(sum(CASE WHEN p.travel_mode IN ('AT', 'Walking') THEN 1 ELSE 0 END), 0) > coalesce(sum(CASE WHEN p.travel_mode = 'PT' THEN 1 ELSE 0 END), 0) THEN 'active' WHEN coalesce(sum(CASE WHEN p.travel_mode = 'PT' THEN 1 ELSE 0 END), 0) > 0 THEN 'mechanised' ELSE 'none' END AS transport FROM mov m LEFT JOIN v_points p ON p.user_id = m.user_id AND p.date = m.date AND epoch_us(p.ts) BETWEEN m.start_us AND m.end_us GROUP BY ALL)"""
LOCATED = """dj AS (SELECT d.user_id, d.date, d.start_us, d.end_us, coalesce(sum(CASE WHEN place = 'home' THEN greatest(least(d.end_us, p.end_us) - greatest(d.start_us, p.start_us), 0) ELSE 0 END), 0) AS own, coalesce(sum(CASE WHEN place <> 'home' THEN greatest(least(d.end_us, p.end_us) - greatest(d.start_us, p.start_us), 0) ELSE 0 END), 0) AS other FROM dig d LEFT JOIN plc p ON d.user_id = p.user_id AND d.date = p.date GROUP BY ALL),
dl AS (SELECT user_id, date, start_us, end_us, CASE WHEN own > other THEN 'home' ELSE 'out_of_home' END AS location_type FROM dj)"""
FULL = f"""{DIGITAL}, {PLACES.replace('p AS', 'hp AS', 1).replace('FROM p)', 'FROM hp)', 1).replace('q AS', 'hq AS', 1).replace('FROM q WHERE', 'FROM hq WHERE', 1).replace('r AS (', 'hr AS (', 1).replace('FROM r WHERE', 'FROM hr WHERE', 1).replace('runs AS', 'hruns AS', 1).replace('FROM runs UNION', 'FROM hruns UNION')}, {run_sql(MOVING, 2)}, mov AS (SELECT * FROM runs), {OVERLAP}, {MOBILE}, {LOCATED},
vt AS (SELECT o.user_id, o.date, o.start_us, o.end_us, first(m.transport ORDER BY m.start_us, m.end_us, m.transport) AS transport FROM (SELECT * FROM ovl WHERE end_us > start_us) o LEFT JOIN mt m ON m.user_id = o.user_id AND m.date = o.date AND o.start_us < m.end_us AND m.start_us < o.end_us GROUP BY o.user_id, o.date, o.start_us, o.end_us),
ft AS (SELECT *, row_number() OVER w AS episode_number, start_us - lag(start_us) OVER w AS since_prev_us FROM (SELECT user_id, date, start_us, end_us, 'digital' AS episode_type, location_type, NULL AS transport FROM dl UNION ALL SELECT user_id, date, start_us, end_us, 'moving', NULL, transport FROM mt UNION ALL SELECT user_id, date, start_us, end_us, 'overlap', NULL, transport FROM vt) t WINDOW w AS (PARTITION BY user_id, date ORDER BY start_us, end_us, episode_type))"""


def mobile(v):
    return ep.majority_transport(moving(v), points(v), UD, c("travel_mode").isin("AT", "Walking"), c("travel_mode") == "PT")


def full(v):
    d, m = digital(v), mobile(v)
    # Moving episodes of a day do not overlap each other, so an overlap has the transport of the one that it is part of.
    both = ep.intersect_intervals(d.select(*UD, "start_us", "end_us"), m, UD, carry=("transport",))
    return ep.timeline({"digital": ep.dominant_label(d, places(v), UD), "moving": m, "overlap": both}, UD)


@query("ep15_timeline", f"WITH {FULL} SELECT user_id, date, start_us, end_us, episode_type, location_type, transport, episode_number, since_prev_us FROM ft")
def _(v):
    return full(v)


GROUPS = {"digital": "episode_type = 'digital'", "moving": "episode_type = 'moving'", "overlap": "episode_type = 'overlap'", "active": "episode_type = 'moving' and transport = 'active'", "mechanised": "episode_type = 'moving' and transport = 'mechanised'", "overlap_active": "episode_type = 'overlap' and transport = 'active'", "overlap_mechanised": "episode_type = 'overlap' and transport = 'mechanised'", "digital_home": "episode_type = 'digital' and location_type = 'home'", "digital_out_of_home": "episode_type = 'digital' and location_type = 'out_of_home'"}


@query("ep16_day_statistics", f"WITH {FULL} SELECT user_id, date, " + ", ".join(f"count(*) FILTER (WHERE {w}) AS {n}_episodes, round(sum(CASE WHEN {w} THEN end_us - start_us ELSE 0 END) / {MIN}, 8) AS {n}_minutes" for n, w in GROUPS.items()) + " FROM ft GROUP BY user_id, date")
def _(v):
    return ep.day_statistics(full(v), UD, {n: F.expr(w) for n, w in GROUPS.items()})


@query("ep17_participant_summary", f"WITH {FULL}, d AS (SELECT user_id, date, count(*) AS n, CASE WHEN bool_or(episode_type = 'overlap') THEN 'overlapping' WHEN count(DISTINCT episode_type) > 1 THEN 'separate' ELSE 'single' END AS method FROM ft GROUP BY user_id, date) SELECT user_id, count(*) AS days, count(*) FILTER (WHERE n >= 2) AS valid_days, round(100.0::DOUBLE * count(*) FILTER (WHERE n >= 2) / count(*), 6) AS pct_valid, round(avg(n), 6) AS mean_episodes, count(*) FILTER (WHERE method = 'overlapping') AS overlapping_days, count(*) FILTER (WHERE method = 'separate') AS separate_days, count(*) FILTER (WHERE method = 'single') AS single_days FROM d GROUP BY user_id")
def _(v):
    kinds = F.countDistinct("episode_type")
    method = F.when(F.bool_or(c("episode_type") == "overlap"), "overlapping").when(kinds > 1, "separate").otherwise("single")
    days = full(v).groupBy(*UD).agg(F.count("*").alias("n"), method.alias("method"))
    return ep.participant_summary(days, "user_id", ["overlapping", "separate", "single"], 2)


@query("ep18_episode_summary", f"WITH {TIMELINE}, m AS (SELECT *, end_us - start_us AS m FROM tl) SELECT user_id, date, episode_type, count(*) AS num_episodes, round(sum(m) / {MIN}, 8) AS total_minutes, round(sum(m) / CAST(count(*) AS DOUBLE) / {MIN}, 10) AS mean_minutes, round(median(m) / {MIN}, 10) AS median_minutes, min(start_us) AS first_us, max(end_us) AS last_us FROM m GROUP BY user_id, date, episode_type")
def _(v):
    return ep.episode_summary(typed(v), UD)


@query("ep19_day_keys", f"WITH {BOTH}, k AS (SELECT user_id, date FROM dig UNION SELECT user_id, date FROM mov) SELECT k.user_id, k.date, count(DISTINCT d.start_us) AS n_digital FROM k LEFT JOIN dig d USING (user_id, date) GROUP BY k.user_id, k.date")
def _(v):
    keys = digital(v).select(*UD).union(moving(v).select(*UD)).distinct()
    return keys.join(digital(v), UD, "left").groupBy(*UD).agg(F.countDistinct("start_us").alias("n_digital"))


@query("ep19_day_grid", f"WITH {BOTH}, k AS (SELECT user_id, date, 'digital' AS s FROM dig UNION SELECT user_id, date, 'moving' FROM mov), g AS (SELECT user_id, CAST(unnest(generate_series(CAST(min(date) AS TIMESTAMP), CAST(max(date) AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS date FROM k GROUP BY user_id) SELECT g.user_id, g.date, coalesce(bool_or(s = 'digital'), false) AS has_digital, coalesce(bool_or(s = 'moving'), false) AS has_moving FROM g LEFT JOIN k ON k.user_id = g.user_id AND k.date = g.date GROUP BY g.user_id, g.date")
def _(v):
    return ep.day_grid({"digital": digital(v), "moving": moving(v)}, "user_id")


def stress(v):
    return v.stress.withColumn("minute", F.expr("unix_micros(cast(ts as timestamp)) div 60000000"))


def dbscan_sql(where: str, eps: int, least: int) -> str:
    return f"""st AS (SELECT user_id, event_id, epoch_us(ts) // 60000000 AS minute, score, flag FROM v_stress), rw AS (SELECT user_id, minute AS m FROM st WHERE {where}),
co AS (SELECT *, count(*) OVER (PARTITION BY user_id ORDER BY m RANGE BETWEEN {eps} PRECEDING AND {eps} FOLLOWING) >= {least} AS core FROM rw),
cs AS (SELECT *, sum(CASE WHEN p IS NULL OR m - p > {eps} THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY m) AS cluster FROM (SELECT user_id, m, lag(m) OVER (PARTITION BY user_id ORDER BY m) AS p FROM (SELECT DISTINCT user_id, m FROM co WHERE core) t) u),
mem AS (SELECT r.user_id, r.m, (SELECT min(cluster) FROM cs WHERE cs.user_id = r.user_id AND abs(cs.m - r.m) <= {eps}) AS cluster FROM rw r),
clu AS (SELECT user_id, cluster, min(m) AS start_minute, max(m) AS end_minute, count(*) AS n FROM mem WHERE cluster IS NOT NULL GROUP BY user_id, cluster)"""


def flagged(v):
    return cl.density_clusters(stress(v).where("flag = 1"), "user_id", c("minute"), 180, 3)


@query("cl1_density_clusters", f"WITH {dbscan_sql('flag = 1', 180, 3)} SELECT * FROM clu")
def _(v):
    return flagged(v)


@query("cl1_cluster_counts", f"WITH {dbscan_sql('flag = 1', 180, 3)} SELECT k.user_id, k.cluster, start_minute, end_minute, count(*) AS n_rows, sum(flag) AS n_stress, count(*) - sum(flag) AS n_other, round(100.0::DOUBLE * sum(flag) / count(*), 6) AS pct_stress FROM clu k JOIN st ON st.user_id = k.user_id AND st.minute BETWEEN start_minute AND end_minute GROUP BY ALL")
def _(v):
    return cl.cluster_counts(flagged(v), stress(v), "user_id", c("flag") == 1)


def banded(v):
    return cl.density_clusters(stress(v).where("score between 0.5 and 1.0"), "user_id", c("minute"), 240, 3)


@query("cl2_score_band", f"WITH {dbscan_sql('score BETWEEN 0.5 AND 1.0', 240, 3)} SELECT user_id, 'stress_' || cluster AS cluster_id, start_minute, end_minute, n FROM clu")
def _(v):
    return banded(v).select("user_id", F.concat(F.lit("stress_"), c("cluster").cast("string")).alias("cluster_id"), "start_minute", "end_minute", "n")


CALM = """cst AS (SELECT user_id, event_id, epoch_us(ts) // 60000000 AS minute, score = 0 AS o FROM v_stress), cr AS (SELECT *, sum(CASE WHEN p IS NULL OR p <> o THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY minute, event_id ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, lag(o) OVER (PARTITION BY user_id ORDER BY minute, event_id) AS p FROM cst) t),
calm AS (SELECT user_id, min(minute) AS start_minute, max(minute) AS end_minute, count(*) AS n FROM cr WHERE o GROUP BY user_id, run HAVING max(minute) - min(minute) >= 5)"""


def calm(v):
    return cl.constant_runs(stress(v), "user_id", c("score") == 0, 5)


@query("cl3_constant_runs", f"WITH {CALM} SELECT * FROM calm")
def _(v):
    return calm(v)


@query("cl4_without_overlaps", f"WITH {CALM}, {dbscan_sql('flag = 1', 180, 3)} SELECT * FROM calm a WHERE NOT EXISTS (SELECT 1 FROM clu k WHERE k.user_id = a.user_id AND a.start_minute < k.end_minute AND k.start_minute < a.end_minute) AND end_minute - start_minute >= 30")
def _(v):
    return cl.without_overlaps(calm(v), flagged(v), "user_id", 30)


@query("cl5_with_overlaps", f"WITH {CALM}, {dbscan_sql('flag = 1', 180, 3)} SELECT * FROM calm a WHERE EXISTS (SELECT 1 FROM clu k WHERE k.user_id = a.user_id AND a.start_minute <= k.end_minute AND k.start_minute <= a.end_minute)")
def _(v):
    return cl.with_overlaps(calm(v), flagged(v), "user_id")


@query("cl6_coverage", f"WITH {dbscan_sql('flag = 1', 180, 3)}, i AS (SELECT count(*) AS n_in, sum(flag) AS s_in FROM st JOIN clu k ON st.user_id = k.user_id AND st.minute BETWEEN start_minute AND end_minute) SELECT round(100.0::DOUBLE * n_in / (SELECT count(*) FROM st), 6) AS pct_rows, round(100.0::DOUBLE * s_in / (SELECT sum(flag) FROM st), 6) AS pct_stress FROM i")
def _(v):
    inside = cl.cluster_counts(flagged(v), stress(v), "user_id", c("flag") == 1).agg(F.sum("n_rows").alias("n_in"), F.sum("n_stress").alias("s_in"))
    every = v.stress.agg(F.count("*").alias("n"), F.sum("flag").alias("s"))
    return inside.crossJoin(F.broadcast(every)).select(F.round(c("n_in") * 100.0 / c("n"), 6).alias("pct_rows"), F.round(c("s_in") * 100.0 / c("s"), 6).alias("pct_stress"))


@query("cl7_all_clusters", f"WITH {CALM}, {dbscan_sql('flag = 1', 180, 3)} SELECT user_id, start_minute, end_minute, n, 'calm' AS kind FROM calm UNION ALL SELECT user_id, start_minute, end_minute, n, 'stress' FROM clu")
def _(v):
    return calm(v).withColumn("kind", F.lit("calm")).unionByName(flagged(v).drop("cluster").withColumn("kind", F.lit("stress")))


def index_sql(source: str, keys: str = "user_id, date", least: int = 1, most: str = "", above: int = 2, name: str = "fi") -> str:
    m = f"(end_us - start_us) / {MIN}"
    return f"""{name}1 AS (SELECT {keys}, CASE WHEN {m} > 0 {most} THEN {m} END AS m FROM {source}),
{name}2 AS (SELECT *, count(m) OVER w AS n, avg(m) OVER w AS mean, stddev_samp(m) OVER w AS sd FROM {name}1 WINDOW w AS (PARTITION BY {keys})),
{name}3 AS (SELECT *, CASE WHEN n <= {above} OR coalesce(abs(m - mean) <= 3 * sd, false) THEN m END AS k FROM {name}2),
{name}4 AS (SELECT *, k / sum(k) OVER (PARTITION BY {keys}) AS p FROM {name}3),
{name}5 AS (SELECT {keys}, max(n) AS n, count(k) AS episode_count, sum(k) AS total, avg(k) AS mean, coalesce(stddev_samp(k), 0) AS sd, sum(-p * ln(p)) AS h FROM {name}4 GROUP BY {keys}),
{name}6 AS (SELECT *, CASE WHEN n = 0 THEN 'no_valid_episodes' WHEN n < {least} THEN 'insufficient_episodes_' || n WHEN episode_count < {least} THEN 'insufficient_episodes_after_outlier_removal' ELSE 'success' END AS status FROM {name}5),
{name} AS (SELECT {keys}, CASE WHEN status = 'success' THEN round(CASE WHEN episode_count = 1 THEN 0 ELSE h / ln(episode_count) END, 6) END AS fragmentation_index, episode_count, CASE WHEN status = 'success' THEN round(total, 10) END AS total_duration, CASE WHEN status = 'success' THEN round(mean, 10) END AS mean_duration, CASE WHEN status = 'success' THEN round(sd, 6) END AS std_duration, CASE WHEN status = 'success' THEN round(sd / mean, 6) END AS cv, status FROM {name}6)"""


def minutes():
    return (c("end_us") - c("start_us")) / 60_000_000


@query("fr1_fragmentation_index", f"WITH {DIGITAL}, {index_sql('dig')} SELECT * FROM fi")
def _(v):
    return fr.fragmentation_index(digital(v), UD, minutes())


@query("fr2_unguarded_trim", f"WITH {DIGITAL}, {index_sql('dig', 'user_id', 3, 'AND ' + '(end_us - start_us) / ' + MIN + ' <= 720', 0)} SELECT * FROM fi")
def _(v):
    return fr.fragmentation_index(digital(v), ["user_id"], minutes(), min_episodes=3, max_minutes=720, trim_above=0)


@query("fr3_digital_at_home", f"WITH {DIGITAL}, {HOME_SQL}, mov AS (SELECT * FROM runs), {OVERLAP}, {index_sql('ovl')} SELECT * FROM fi")
def _(v):
    return fr.fragmentation_index(ep.intersect_intervals(digital(v), at_home(v), UD), UD, minutes())


@query("fr4_digital_in_motion", f"WITH {BOTH}, {OVERLAP}, {index_sql('ovl')} SELECT * FROM fi")
def _(v):
    return fr.fragmentation_index(ep.intersect_intervals(digital(v), moving(v), UD), UD, minutes())


TYPES = f"{TIMELINE}, {index_sql('tl', 'user_id, date, episode_type')}"


def per_type(v):
    return fr.fragmentation_index(typed(v), [*UD, "episode_type"], minutes()).withColumnRenamed("episode_type", "type")


@query("fr5_delta", f"WITH {TYPES} SELECT user_id, date, round(max(CASE WHEN episode_type = 'digital' THEN fragmentation_index END) - max(CASE WHEN episode_type = 'moving' THEN fragmentation_index END), 6) AS delta FROM fi GROUP BY user_id, date")
def _(v):
    w = fr.wide(per_type(v), UD, ["digital", "moving"], ["fragmentation_index"])
    return w.select(*UD, F.round(fr.delta(c("digital_fragmentation_index"), c("moving_fragmentation_index")), 6).alias("delta"))


@query("fr6_minutes_by_place", f"WITH {PLACES} SELECT user_id, date, round(sum(CASE WHEN place = 'home' THEN (end_us - start_us) / {MIN} ELSE 0 END), 8) AS home_duration, round(sum(CASE WHEN place = 'out_of_home' THEN (end_us - start_us) / {MIN} ELSE 0 END), 8) AS out_of_home_duration FROM plc GROUP BY user_id, date")
def _(v):
    return fr.minutes_by(places(v), UD, "place", ["home", "out_of_home"], minutes())


@query("fr7_wide", f"WITH {TYPES} SELECT user_id, date, max(CASE WHEN episode_type = 'digital' THEN fragmentation_index END) AS digital_fragmentation_index, max(CASE WHEN episode_type = 'digital' THEN episode_count END) AS digital_episode_count, max(CASE WHEN episode_type = 'moving' THEN fragmentation_index END) AS moving_fragmentation_index, max(CASE WHEN episode_type = 'moving' THEN episode_count END) AS moving_episode_count FROM fi GROUP BY user_id, date")
def _(v):
    return fr.wide(per_type(v), UD, ["digital", "moving"], ["fragmentation_index", "episode_count"])


@query("fr8_participant_summary", f"WITH {DIGITAL}, {index_sql('dig')} SELECT user_id, count(*) AS days_processed, round(avg(fragmentation_index), 5) AS mean_index, min(fragmentation_index) AS min_index, max(fragmentation_index) AS max_index, sum(episode_count) AS episodes FROM fi GROUP BY user_id")
def _(v):
    d = fr.fragmentation_index(digital(v), UD, minutes())
    return d.groupBy("user_id").agg(F.count("*").alias("days_processed"), F.round(F.avg("fragmentation_index"), 5).alias("mean_index"), F.min("fragmentation_index").alias("min_index"), F.max("fragmentation_index").alias("max_index"), F.sum("episode_count").alias("episodes"))


@query("fr9_status_rates", f"WITH {TYPES} SELECT episode_type AS type, status, count(*) AS n, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (PARTITION BY episode_type), 6) AS pct FROM fi GROUP BY episode_type, status")
def _(v):
    return fr.status_rates(per_type(v))


def described_sql(column: str) -> str:
    return f"SELECT '{column}' AS variable, count({column}) AS n_valid, round(avg({column}), 6) AS mean, round(quantile_cont({column}, 0.5), 6) AS median, round(stddev_samp({column}), 6) AS std, CAST(min({column}) AS DOUBLE) AS min, CAST(max({column}) AS DOUBLE) AS max, round(quantile_cont({column}, 0.25), 6) AS q25, round(quantile_cont({column}, 0.75), 6) AS q75 FROM v_daily"


@query("fr10_describe", " UNION ALL ".join(described_sql(x) for x in ("total_value", "outcome")))
def _(v):
    return fr.describe(v.daily, ["total_value", "outcome"])


@query("fr11_correlations", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r, count(*) AS n FROM v_daily" for a, b in (("total_value", "outcome"), ("total_value", "n_events"), ("outcome", "n_events"))))
def _(v):
    return fr.correlations(v.daily, ["total_value", "outcome", "n_events"])


@query("fr12_histogram", "SELECT CAST(least(1 + floor(outcome / 5), 20) AS INT) AS bin, count(*) AS n FROM v_daily WHERE outcome BETWEEN 0 AND 100 GROUP BY ALL")
def _(v):
    return fr.histogram(v.daily, "outcome", 20, 0.0, 100.0)
