"""Queries of the joins, aggregations, windows, sorts, set operations, questionnaires and study-level compositions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import ids, labels, missing, quantiles, times
from ..operators import fragmentation as fr
from ..operators import joins as jn
from ..operators import questionnaires as qn
from ..operators import schemas
from . import episodes as eps
from .registry import query

c = F.col
W = Window
KEY_SQL = "CASE WHEN ltrim(substr(raw_id, 3), '0') = '' THEN '0' ELSE ltrim(substr(raw_id, 3), '0') END"


def r6(x, name):
    return F.round(x, 6).alias(name)


# Joins


@query("jn1_key_coverage", "WITH l AS (SELECT DISTINCT user_id FROM v_daily), r AS (SELECT user_id FROM v_demo) SELECT (SELECT count(*) FROM l) AS n_left, (SELECT count(*) FROM r) AS n_right, (SELECT count(*) FROM l JOIN r USING (user_id)) AS n_common")
def _(v):
    return jn.key_coverage(v.daily, v.demo, ["user_id"])


@query("jn2_id_date_join", f"SELECT d.user_id, d.date, d.total_value, e.q1 FROM v_daily d JOIN (SELECT {KEY_SQL} AS id, user_id FROM v_demo) m ON CAST(d.user_id AS VARCHAR) = m.id JOIN v_ema_wide e ON e.user_id = m.user_id AND CAST(e.response_time AS DATE) = d.date")
def _(v):
    m = v.demo.select(ids.standardize_id(c("raw_id")).alias("id"), c("user_id").alias("demo_user"))
    e = v.ema_wide.select(c("user_id").alias("demo_user"), F.to_date("response_time").alias("date"), "q1")
    d = v.daily.withColumn("id", c("user_id").cast("string"))
    return d.join(m, "id").join(e, ["demo_user", "date"]).select("user_id", "date", "total_value", "q1")


@query("jn3_offset_join", """WITH l AS (SELECT user_id, date, n_events FROM v_daily WHERE n_types >= 3), r AS (SELECT user_id, CAST(response_time AS DATE) AS date, q1, event_id FROM v_ema_wide),
o AS (SELECT * FROM (VALUES (0, 0), (1, -1), (2, 1)) t(rank, day_offset)), j AS (SELECT l.*, o.*, r.q1, r.event_id, min(o.rank) OVER (PARTITION BY l.user_id, l.date) AS best FROM l CROSS JOIN o JOIN r ON r.user_id = l.user_id AND r.date = l.date + CAST(o.day_offset AS INT))
SELECT user_id, date, n_events, q1, event_id, day_offset FROM j WHERE rank = best""")
def _(v):
    r = v.ema_wide.select("user_id", F.to_date("response_time").alias("date"), "q1", "event_id")
    return jn.offset_join(v.daily.where("n_types >= 3").select("user_id", "date", "n_events"), r, "user_id", "date")


@query("jn4_priority_join", """WITH r AS (SELECT * FROM (SELECT user_id, CAST(response_time AS DATE) AS date, q1, row_number() OVER (PARTITION BY user_id, CAST(response_time AS DATE) ORDER BY response_time, event_id) AS n FROM v_ema_wide) t WHERE n = 1),
l AS (SELECT user_id, date, n_events, CASE WHEN day(date) <= 12 THEN make_date(CAST(year(date) AS INT), CAST(day(date) AS INT), CAST(month(date) AS INT)) END AS s FROM v_daily)
SELECT l.user_id, l.date, n_events, CASE WHEN a.user_id IS NOT NULL THEN 'exact' WHEN b.user_id IS NOT NULL THEN 'swapped' ELSE 'none' END AS match_type, coalesce(a.date, b.date) AS matching_date, CASE WHEN a.user_id IS NOT NULL THEN a.q1 ELSE b.q1 END AS matched_q1
FROM l LEFT JOIN r a ON a.user_id = l.user_id AND a.date = l.date LEFT JOIN r b ON b.user_id = l.user_id AND b.date = l.s""")
def _(v):
    r = v.ema_wide.select("user_id", F.to_date("response_time").alias("date"), "q1", "response_time", "event_id")
    d = jn.priority_join(v.daily.select("user_id", "date", "n_events"), r, "user_id", "date", times.swapped_date(c("date")), ["response_time", "event_id"])
    return d.drop("matched_response_time", "matched_event_id")


@query("jn5_discard_reasons", "SELECT d.user_id, d.date, CASE WHEN k.user_id IS NOT NULL THEN 'no_date' ELSE 'no_participant' END AS reason FROM v_daily d LEFT JOIN (SELECT DISTINCT user_id FROM v_ema_wide WHERE q1 < 3) k USING (user_id) WHERE NOT EXISTS (SELECT 1 FROM v_ema_wide e WHERE q1 < 3 AND e.user_id = d.user_id AND CAST(e.response_time AS DATE) = d.date)")
def _(v):
    r = v.ema_wide.where("q1 < 3").select("user_id", F.to_date("response_time").alias("date"))
    return jn.discard_reasons(v.daily.select("user_id", "date"), r, "user_id", "date")


LONG = "(SELECT *, try_cast(response_raw AS DOUBLE) AS response FROM v_ema_long)"


def long(v):
    return v.ema_long.withColumn("response", missing.to_number(c("response_raw")))


@query("jn6_outer_merge", f"WITH a AS (SELECT user_id, date, avg(response) AS s4 FROM {LONG} WHERE scale = 'S4' GROUP BY ALL), b AS (SELECT user_id, date, avg(response) AS s5 FROM {LONG} WHERE scale = 'S5' GROUP BY ALL) SELECT user_id, date, round(s4, 6) AS s4, round(s5, 6) AS s5 FROM a FULL JOIN b USING (user_id, date)")
def _(v):
    one = lambda s, n: long(v).where(c("scale") == s).groupBy("user_id", "date").agg(r6(F.avg("response"), n))
    return one("S4", "s4").join(one("S5", "s5"), ["user_id", "date"], "full_outer")


@query("jn7_outer_with_side", "WITH l AS (SELECT DISTINCT user_id FROM v_daily), r AS (SELECT user_id, class_name FROM v_demo WHERE user_id % 3 <> 0) SELECT coalesce(l.user_id, r.user_id) AS user_id, class_name, CASE WHEN l.user_id IS NULL THEN 'right_only' WHEN r.user_id IS NULL THEN 'left_only' ELSE 'both' END AS side FROM l FULL JOIN r USING (user_id)")
def _(v):
    return jn.outer_with_side(v.daily.select("user_id").distinct(), v.demo.where("user_id % 3 <> 0").select("user_id", "class_name"), ["user_id"])


@query("jn8_demographics", "SELECT d.user_id, date, total_value, gender_raw, class_name FROM v_daily d LEFT JOIN v_demo m USING (user_id)")
def _(v):
    return v.daily.join(v.demo, "user_id", "left").select("user_id", "date", "total_value", "gender_raw", "class_name")


DICT = "(SELECT DISTINCT scale, variable, upper(variable) || '_' || scale AS code FROM v_ema_long WHERE variable <> 'error')"


def book(v):
    return v.ema_long.where("variable <> 'error'").select("scale", "variable", F.concat_ws("_", F.upper("variable"), "scale").alias("code")).distinct()


@query("jn9_dictionary_join", f"SELECT event_id, e.scale, e.variable, code FROM v_ema_long e LEFT JOIN {DICT} d ON d.scale = e.scale AND d.variable = e.variable")
def _(v):
    return v.ema_long.select("event_id", "scale", "variable").join(book(v), ["scale", "variable"], "left")


@query("jn10_two_pass_lookup", "SELECT event_id, CASE event_type WHEN 'view' THEN 'V' WHEN 'click' THEN 'C' END AS variable FROM events")
def _(v):
    q = v.spark.createDataFrame([("view", "V", 1), ("cl-ick!", "X", 2), ("CLICK", "C", 3)], "question string, value string, seq int")
    asked = F.concat(F.lit(" "), "event_type", F.lit(" "))
    return jn.two_pass_lookup(v.events.select("event_id", "event_type"), asked, q, "variable").select("event_id", "variable")


@query("jn11_similar_texts", "WITH a AS (SELECT DISTINCT p_name AS a FROM part), s AS (SELECT x.a, y.a AS b, round(1 - levenshtein(x.a, y.a) / CAST(greatest(length(x.a), length(y.a), 1) AS DOUBLE), 6) AS similarity FROM a x, a y) SELECT * FROM s WHERE similarity >= 0.8")
def _(v):
    p = v.table("part").select("p_name")
    return jn.similar_texts(p, p, 0.8)


# Matching blocks by recursion on what is left and right of the longest common block (earliest in a, then in b).
BLOCKS = """a AS (SELECT DISTINCT p_name AS a FROM part), p AS (SELECT x.a, y.a AS b FROM a x, a y WHERE 2 * least(length(x.a), length(y.a)) >= 0.8 * (length(x.a) + length(y.a))),
seg AS (SELECT a, b, a AS sa, b AS sb, 0 AS k, 0 AS lvl, 0 AS side FROM p UNION ALL
  SELECT a, b, CASE s WHEN 0 THEN substr(sa, 1, i) ELSE substr(sa, i + len + 1) END, CASE s WHEN 0 THEN substr(sb, 1, strpos(sb, substr(sa, i + 1, len)) - 1) ELSE substr(sb, strpos(sb, substr(sa, i + 1, len)) + len) END, CASE s WHEN 0 THEN len ELSE 0 END, lvl + 1, s
  FROM (SELECT *, code // 1000 AS len, 999 - code % 1000 AS i FROM (SELECT *, list_max(list_transform(range(0, CAST(length(sa) * length(sa) AS BIGINT)), lambda q: CASE WHEN q // length(sa) + q % length(sa) < length(sa) AND contains(sb, substr(sa, 1 + q % length(sa), 1 + q // length(sa))) THEN (1 + q // length(sa)) * 1000 + 999 - q % length(sa) ELSE 0 END)) AS code FROM seg WHERE sa <> '' AND sb <> '') WHERE code > 0), (SELECT unnest([0, 1]) AS s)),
s AS (SELECT a, b, round(2 * sum(k) / CAST(length(a) + length(b) AS DOUBLE), 6) AS similarity FROM seg GROUP BY a, b)"""


@query("jn11_matching_blocks", f"WITH RECURSIVE {BLOCKS} SELECT a, b, similarity FROM s WHERE similarity >= 0.8")
def _(v):
    p = v.table("part").select("p_name")
    return jn.matching_texts(p, p, 0.8)


@query("jn12_metric_joins", "WITH a AS (SELECT user_id, CAST(ts AS DATE) AS date, count(*) AS n_on FROM v_screen WHERE action LIKE '%ON' GROUP BY ALL), b AS (SELECT user_id, CAST(response_time AS DATE) AS date, max(q1) AS q1 FROM v_ema_wide GROUP BY ALL) SELECT d.user_id, d.date, n_events, n_on, q1 FROM v_daily d LEFT JOIN a USING (user_id, date) LEFT JOIN b USING (user_id, date)")
def _(v):
    a = v.screen.where("action like '%ON'").groupBy("user_id", "date").agg(F.count("*").alias("n_on"))
    b = v.ema_wide.groupBy("user_id", F.to_date("response_time").alias("date")).agg(F.max("q1").alias("q1"))
    return v.daily.select("user_id", "date", "n_events").join(a, ["user_id", "date"], "left").join(b, ["user_id", "date"], "left")


@query("jn13_window_join", "SELECT e.event_id AS response_id, p.event_id FROM v_ema_wide e JOIN v_points p ON p.user_id = e.user_id AND epoch_us(p.ts) BETWEEN epoch_us(CAST(CAST(e.response_time AS DATE) AS TIMESTAMP)) + 18000000000 AND epoch_us(e.response_time)")
def _(v):
    e = v.ema_wide.select("user_id", c("event_id").alias("response_id"), (F.unix_date(F.to_date("response_time")).cast("long") * 86_400_000_000 + 18_000_000_000).alias("lo"), times.micros(c("response_time")).alias("hi"))
    p = v.points.select("user_id", "event_id", times.micros(c("ts")).alias("us"))
    return jn.window_join(p, e, ["user_id"], "us", "lo", "hi").select("response_id", "event_id")


@query("jn14_keyed_update", f"SELECT event_id, coalesce(code, e.variable) AS variable FROM v_ema_long e LEFT JOIN {DICT} d ON d.scale = e.scale AND d.variable = e.variable")
def _(v):
    u = book(v).withColumn("key", c("variable")).select("scale", "key", c("code").alias("variable"))
    d = v.ema_long.select("event_id", "scale", c("variable").alias("key"), "variable")
    return jn.update_where(d, u, ["scale", "key"], "variable").select("event_id", "variable")


@query("jn15_day_keys", "WITH a AS (SELECT DISTINCT user_id, date FROM v_screen WHERE action LIKE '%ON'), b AS (SELECT DISTINCT user_id, date FROM v_points WHERE travel_mode IN ('AT', 'PT')), h AS (SELECT DISTINCT user_id, date FROM v_points WHERE place = '~Home') SELECT a.user_id, a.date, h.user_id IS NOT NULL AS has_home FROM a JOIN b USING (user_id, date) LEFT JOIN h USING (user_id, date)")
def _(v):
    days = lambda d, w: d.where(w).select("user_id", "date").distinct()
    h = days(v.points, "place = '~Home'").withColumn("has_home", F.lit(True))
    return days(v.screen, "action like '%ON'").join(days(v.points, "travel_mode in ('AT', 'PT')"), ["user_id", "date"]).join(h, ["user_id", "date"], "left").withColumn("has_home", F.coalesce("has_home", F.lit(False)))


@query("jn16_points_in_interval", "WITH i AS (SELECT user_id, event_id, epoch_us(ts) AS lo, epoch_us(ts) + 14400000000 AS hi FROM v_screen WHERE action LIKE '%ON') SELECT i.event_id, count(*) AS n_points FROM i JOIN v_points p ON p.user_id = i.user_id AND epoch_us(p.ts) BETWEEN lo AND hi GROUP BY i.event_id")
def _(v):
    i = v.screen.where("action like '%ON'").select("user_id", c("event_id").alias("id"), times.micros(c("ts")).alias("lo"), (times.micros(c("ts")) + 14_400_000_000).alias("hi"))
    p = v.points.select("user_id", times.micros(c("ts")).alias("us"))
    return jn.window_join(p, i, ["user_id"], "us", "lo", "hi").groupBy(c("id").alias("event_id")).agg(F.count("*").alias("n_points"))


@query("jn17_semi", "SELECT user_id, date, n_events FROM v_daily WHERE user_id IN (SELECT user_id FROM v_ema_wide WHERE q1 = 5)")
def _(v):
    return v.daily.select("user_id", "date", "n_events").join(v.ema_wide.where("q1 = 5").select("user_id"), "user_id", "left_semi")


# Aggregations, windows, sorts, sets


@query("ag1_value_counts", "SELECT travel_mode, count(*) AS n, count(DISTINCT user_id) AS n_users, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 6) AS pct FROM v_points GROUP BY travel_mode")
def _(v):
    g = v.points.groupBy("travel_mode").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("n_users"))
    return g.withColumn("pct", F.round(c("n") * 100.0 / F.sum("n").over(W.partitionBy()), 6))


@query("ag2_group_stats", "SELECT user_id, round(avg(total_value), 6) AS mean, min(total_value) AS min, max(total_value) AS max, round(stddev_samp(total_value), 6) AS std, arg_min(total_value, date) AS first FROM v_daily GROUP BY user_id")
def _(v):
    return v.daily.groupBy("user_id").agg(r6(F.avg("total_value"), "mean"), F.min("total_value").alias("min"), F.max("total_value").alias("max"), r6(F.stddev_samp("total_value"), "std"), F.min_by("total_value", "date").alias("first"))


@query("ag3_shares", "SELECT user_id, round(avg(CASE WHEN n_types >= 2 THEN 100.0::DOUBLE ELSE 0 END), 6) AS pct_good FROM v_daily GROUP BY user_id")
def _(v):
    return v.daily.groupBy("user_id").agg(r6(F.avg(F.when(c("n_types") >= 2, 100.0).otherwise(0.0)), "pct_good"))


@query("ag4_conditional", "SELECT user_id, count(*) AS n, count(*) FILTER (WHERE hour(ts) < 5) AS n_early, min(CASE WHEN hour(ts) < 5 THEN event_id END) AS first_early FROM v_screen GROUP BY user_id")
def _(v):
    early = F.hour("ts") < 5
    return v.screen.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(early).alias("n_early"), F.min(F.when(early, c("event_id"))).alias("first_early"))


@query("ag5_grouping_sets", "SELECT class_name, gender_raw, count(*) AS n, round(avg(balance), 6) AS mean FROM v_demo GROUP BY GROUPING SETS ((class_name), (gender_raw), (class_name, gender_raw))")
def _(v):
    return v.demo.groupingSets([["class_name"], ["gender_raw"], ["class_name", "gender_raw"]], "class_name", "gender_raw").agg(F.count("*").alias("n"), r6(F.avg("balance"), "mean"))


@query("ag6_quantiles", "SELECT source, round(quantile_cont(total_value, 0.05), 6) AS q05, round(quantile_cont(total_value, 0.5), 6) AS q50, round(quantile_cont(total_value, 0.95), 6) AS q95 FROM v_daily GROUP BY source")
def _(v):
    q = quantiles.group_percentiles(v.daily, ["source"], "total_value", [0.05, 0.5, 0.95], "q")
    return q.select("source", *[F.round(c("q")[i], 6).alias(n) for i, n in enumerate(("q05", "q50", "q95"))])


@query("ag7_mode", "WITH n AS (SELECT user_id, travel_mode, count(*) AS n FROM v_points GROUP BY ALL) SELECT user_id, first(travel_mode ORDER BY n DESC, travel_mode) AS top FROM n GROUP BY user_id")
def _(v):
    n = v.points.groupBy("user_id", "travel_mode").agg(F.count("*").alias("n"))
    return n.groupBy("user_id").agg(F.min(F.struct((-c("n")).alias("n"), "travel_mode"))["travel_mode"].alias("top"))


@query("ag8_row_of_max", "SELECT user_id, date, total_value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY total_value DESC, date) AS n FROM v_daily) t WHERE n = 1")
def _(v):
    top = v.daily.groupBy("user_id").agg(F.min(F.struct((-c("total_value")).alias("v"), "date")).alias("t"))
    return top.select("user_id", c("t.date").alias("date"), (-c("t.v")).alias("total_value"))


@query("ag9_latest_response", """WITH d AS (SELECT *, CASE WHEN hour(response_time) < 5 THEN CAST(CAST(response_time AS DATE) - INTERVAL 1 DAY AS DATE) ELSE CAST(response_time AS DATE) END AS data_date FROM v_ema_wide), n AS (SELECT *, row_number() OVER (PARTITION BY user_id, data_date ORDER BY response_time DESC, event_id DESC) AS n, count(*) OVER (PARTITION BY user_id, data_date) AS n_responses FROM d) SELECT user_id, data_date, event_id, n_responses, n_responses > 1 AS several FROM n WHERE n = 1""")
def _(v):
    d = v.ema_wide.withColumn("data_date", times.data_date(c("response_time")))
    w = W.partitionBy("user_id", "data_date")
    n = d.withColumns({"n": F.row_number().over(w.orderBy(F.desc("response_time"), F.desc("event_id"))), "n_responses": F.count("*").over(w)})
    return n.where("n = 1").select("user_id", "data_date", "event_id", "n_responses", (c("n_responses") > 1).alias("several"))


DAYQ = """WITH s AS (SELECT user_id, date, epoch_us(ts) AS us, hour(ts) AS h, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id, date ORDER BY ts, event_id)) AS gap FROM v_screen)"""


def day_quality(v):
    w = W.partitionBy("user_id", "date").orderBy("ts", "event_id")
    us = times.micros(c("ts"))
    return v.screen.withColumns({"us": us, "h": F.hour("ts"), "gap": us - F.lag(us).over(w)}).groupBy("user_id", "date")


@query("ag10_window_quality", DAYQ + " SELECT user_id, date, count(*) AS n, min(us) AS first_us, max(us) AS last_us, max(gap) AS max_gap_us, count(DISTINCT CASE WHEN h < 5 THEN 0 WHEN h < 12 THEN 1 WHEN h < 17 THEN 2 WHEN h < 22 THEN 3 ELSE 4 END) AS n_periods FROM s GROUP BY user_id, date HAVING max(us) - min(us) >= 5 * 3600000000")
def _(v):
    g = day_quality(v).agg(F.count("*").alias("n"), F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.max("gap").alias("max_gap_us"), F.countDistinct(times.period(c("h"))).alias("n_periods"))
    return g.where(c("last_us") - c("first_us") >= 5 * 3_600_000_000)


@query("ag11_day_flags", DAYQ + " SELECT user_id, date, bool_or(h < 12) AS has_morning, bool_or(h >= 17) AS has_evening, bool_or(h < 5) AS has_early, count(*) AS n FROM s GROUP BY user_id, date")
def _(v):
    return day_quality(v).agg(F.bool_or(c("h") < 12).alias("has_morning"), F.bool_or(c("h") >= 17).alias("has_evening"), F.bool_or(c("h") < 5).alias("has_early"), F.count("*").alias("n"))


@query("ag12_wide_pivot", "SELECT user_id, date, sum(CASE WHEN travel_mode = 'AT' THEN 1 END) AS \"AT_n\", max(CASE WHEN travel_mode = 'AT' THEN speed END) AS \"AT_top\", sum(CASE WHEN travel_mode = 'PT' THEN 1 END) AS \"PT_n\", max(CASE WHEN travel_mode = 'PT' THEN speed END) AS \"PT_top\" FROM v_points GROUP BY user_id, date")
def _(v):
    return v.points.groupBy("user_id", "date").pivot("travel_mode", ["AT", "PT"]).agg(F.count("event_id").alias("n"), F.max("speed").alias("top")).withColumns({f"{m}_n": F.when(c(f"{m}_n") > 0, c(f"{m}_n")) for m in ("AT", "PT")})


@query("ag13_pivot_first", f"SELECT user_id, date, arg_min(response, event_id) FILTER (WHERE scale = 'S4' AND response IS NOT NULL) AS \"S4\", arg_min(response, event_id) FILTER (WHERE scale = 'S5' AND response IS NOT NULL) AS \"S5\" FROM {LONG} GROUP BY user_id, date")
def _(v):
    one = lambda s: F.min_by("response", F.when((c("scale") == s) & c("response").isNotNull(), c("event_id"))).alias(s)
    return long(v).groupBy("user_id", "date").agg(one("S4"), one("S5"))


def matrix_sql(source: str, keys: str, what: str, day: str) -> str:
    return f"SELECT {keys}, " + ", ".join(f"count(DISTINCT CASE WHEN day({day}) = {d} THEN {what} END) AS \"Day_{d}\"" for d in range(1, 8)) + f", count(DISTINCT CASE WHEN day({day}) <= 7 THEN {what} END) AS \"Total\" FROM {source} GROUP BY {keys}"


def study_day(d):
    """The number of the study day, from its label."""
    d = d.withColumn("label", F.concat(F.lit("EMA day "), F.day("date").cast("string")))
    return d.withColumn("day", F.regexp_extract(F.lower("label"), r"ema day (\d+)", 1).cast("int"))


MATRIX = matrix_sql("v_ema_long", "user_id", "event_id", "date")


def matrix(v):
    return qn.completeness_matrix(study_day(v.ema_long), ["user_id"], "day", "event_id", range(1, 8))


@query("ag14_completeness_matrix", MATRIX)
def _(v):
    return matrix(v)


@query("ag14_scale_matrix", "SELECT user_id, scale, " + ", ".join(f"count(DISTINCT CASE WHEN day(date) = {d} THEN variable END) AS \"Day_{d}\"" for d in range(1, 8)) + ", " + " + ".join(f"count(DISTINCT CASE WHEN day(date) = {d} THEN variable END)" for d in range(1, 8)) + " AS \"Total\" FROM v_ema_long GROUP BY user_id, scale")
def _(v):
    return qn.completeness_matrix(study_day(v.ema_long), ["user_id", "scale"], "day", "variable", range(1, 8))


WIDE_MATRIX = matrix_sql("v_ema_wide", "user_id", "event_id", "response_time")
VALID = f"""WITH a AS ({MATRIX}), b AS ({WIDE_MATRIX}), m AS (SELECT user_id, {", ".join(f'sum("Day_{d}") AS "Day_{d}"' for d in range(1, 8))} FROM (SELECT * FROM a UNION ALL SELECT * FROM b) t GROUP BY user_id),
vd AS (SELECT user_id, {", ".join(f'"Day_{d}" >= 3 AS "Valid_{d}"' for d in range(1, 8))}, {" + ".join(f'CASE WHEN "Day_{d}" >= 3 THEN 1 ELSE 0 END' for d in range(1, 8))} AS valid_days, {" + ".join(f'"Day_{d}"' for d in range(1, 8))} > 0 AS active FROM m)"""


def valid(v):
    wide = qn.completeness_matrix(study_day(v.ema_wide.withColumn("date", F.to_date("response_time"))), ["user_id"], "day", "event_id", range(1, 8))
    return qn.valid_days(matrix(v), wide, "user_id", range(1, 8))


@query("ag15_valid_days", VALID + f" SELECT user_id, {', '.join(f'Valid_{d}' for d in range(1, 8))}, valid_days, round(100.0::DOUBLE * valid_days / 7, 6) AS pct_valid, active FROM vd")
def _(v):
    return valid(v)


@query("ag15_valid_counts", VALID + " " + " UNION ALL ".join(f"SELECT {d} AS day, count(*) FILTER (WHERE Valid_{d}) AS n_valid, round(100.0::DOUBLE * count(*) FILTER (WHERE Valid_{d}) / count(*), 6) AS pct_all, round(100.0::DOUBLE * count(*) FILTER (WHERE Valid_{d}) / count(*) FILTER (WHERE active), 6) AS pct_active FROM vd" for d in range(1, 8)))
def _(v):
    return qn.valid_counts(valid(v), range(1, 8))


@query("ag16_out_of_home", f"""WITH {eps.HOME_SQL}, s AS (SELECT user_id, date, (epoch_us(max(ts)) - epoch_us(min(ts))) / 60000000.0::DOUBLE AS span FROM v_points GROUP BY user_id, date),
h AS (SELECT user_id, date, sum(end_us - start_us) / 60000000.0::DOUBLE AS home FROM runs GROUP BY user_id, date)
SELECT s.user_id, s.date, round(span, 8) AS observed_minutes, round(coalesce(home, 0), 8) AS home_minutes, round(span - coalesce(home, 0), 8) AS out_of_home_minutes FROM s LEFT JOIN h ON h.user_id = s.user_id AND h.date = s.date""")
def _(v):
    return fr.out_of_home(v.points.withColumn("us", times.micros(c("ts"))), eps.at_home(v), ["user_id", "date"])


@query("ag16_transport_minutes", f"WITH {eps.BOTH}, {eps.MOBILE} SELECT user_id, date, round(sum(CASE WHEN transport = 'active' THEN (end_us - start_us) / 60000000.0::DOUBLE ELSE 0 END), 8) AS active_duration, round(sum(CASE WHEN transport = 'mechanised' THEN (end_us - start_us) / 60000000.0::DOUBLE ELSE 0 END), 8) AS mechanised_duration FROM mt GROUP BY user_id, date")
def _(v):
    return fr.minutes_by(eps.mobile(v), ["user_id", "date"], "transport", ["active", "mechanised"], eps.minutes())


@query("ag17_dedup", "SELECT user_id, date, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, date ORDER BY ts, event_id) AS n FROM v_points) t WHERE n = 1")
def _(v):
    return missing.first_per(v.points, ["user_id", "date"], ["ts", "event_id"]).select("user_id", "date", "event_id")


@query("ag18_spans", "SELECT user_id, min(ts) AS start_time, max(ts) AS end_time FROM v_points GROUP BY user_id")
def _(v):
    return v.points.groupBy("user_id").agg(F.min("ts").alias("start_time"), F.max("ts").alias("end_time"))


@query("ag19_long_days", "SELECT user_id, date, epoch_us(max(ts)) - epoch_us(min(ts)) AS span_us FROM v_points GROUP BY user_id, date HAVING epoch_us(max(ts)) - epoch_us(min(ts)) > 20 * 3600000000")
def _(v):
    return v.points.groupBy("user_id", "date").agg((times.micros(F.max("ts")) - times.micros(F.min("ts"))).alias("span_us")).where(c("span_us") > 20 * 3_600_000_000)


@query("ag20_day_centre", "SELECT user_id, date, round(median(lat), 6) AS lat, round(median(lon), 6) AS lon FROM v_gps GROUP BY user_id, date")
def _(v):
    return v.gps.groupBy("user_id", "date").agg(r6(F.percentile("lat", F.lit(0.5)), "lat"), r6(F.percentile("lon", F.lit(0.5)), "lon"))


@query("ag21_counts_of_counts", "WITH n AS (SELECT source, user_id, count(*) AS n FROM v_daily GROUP BY ALL) SELECT source, count(*) AS participants, round(avg(n), 6) AS mean_n, min(n) AS min_n, max(n) AS max_n FROM n GROUP BY source")
def _(v):
    n = v.daily.groupBy("source", "user_id").agg(F.count("*").alias("n"))
    return n.groupBy("source").agg(F.count("*").alias("participants"), r6(F.avg("n"), "mean_n"), F.min("n").alias("min_n"), F.max("n").alias("max_n"))


@query("wn1_since_previous", "SELECT event_id, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS since_us FROM v_points")
def _(v):
    us = times.micros(c("ts"))
    return v.points.select("event_id", (us - F.lag(us).over(W.partitionBy("user_id").orderBy("ts", "event_id"))).alias("since_us"))


@query("wn2_run_id", "SELECT event_id, sum(CASE WHEN p IS NULL OR p <> score THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, lag(score) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM v_stress) t")
def _(v):
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    d = v.stress.withColumn("new", F.coalesce(F.lag("score").over(w) != c("score"), F.lit(True)).cast("int"))
    return d.select("event_id", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0)).alias("run"))


@query("wn3_within_between", "SELECT user_id, date, round(total_value - avg(total_value) OVER (PARTITION BY user_id), 6) AS within, round(avg(total_value) OVER (PARTITION BY user_id) - avg(total_value) OVER (), 6) AS between FROM v_daily".replace("AS between", 'AS "between"'))
def _(v):
    grand = v.daily.agg(F.avg("total_value").alias("g"))
    own = F.avg("total_value").over(W.partitionBy("user_id"))
    return v.daily.crossJoin(F.broadcast(grand)).select("user_id", "date", r6(c("total_value") - own, "within"), r6(own - c("g"), "between"))


@query("wn4_person_z", "SELECT user_id, date, CASE WHEN coalesce(stddev_samp(total_value) OVER w, 0) = 0 THEN 0 ELSE round((total_value - avg(total_value) OVER w) / stddev_samp(total_value) OVER w, 6) END AS z FROM v_daily WINDOW w AS (PARTITION BY user_id)")
def _(v):
    return qn.zscore(v.daily, "total_value", ["user_id"], "z").select("user_id", "date", r6(c("z"), "z"))


@query("wn5_population_z", "SELECT user_id, date, round(-(total_value - (SELECT avg(total_value) FROM v_daily)) / (SELECT stddev_pop(total_value) FROM v_daily), 6) AS z FROM v_daily")
def _(v):
    return qn.zscore(v.daily, "total_value", [], "z", ddof=0).select("user_id", "date", r6(-c("z"), "z"))


@query("wn6_row_number", "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM v_points")
def _(v):
    return v.points.select("event_id", F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")).alias("n"))


@query("so1_sort", "SELECT user_id, date, n_events FROM v_daily ORDER BY n_events DESC, user_id, date")
def _(v):
    return v.daily.select("user_id", "date", "n_events").orderBy(F.desc("n_events"), "user_id", "date")


@query("so2_top_k", "SELECT user_id, date, total_value FROM v_daily ORDER BY total_value DESC, user_id, date LIMIT 20")
def _(v):
    return v.daily.select("user_id", "date", "total_value").orderBy(F.desc("total_value"), "user_id", "date").limit(20)


@query("so3_map_by_value", "SELECT user_id, 'a' || (1 + user_id % 3) || ',b' || (5 + user_id % 3) AS entries FROM v_demo")
def _(v):
    m = F.create_map(F.lit("b"), (5 + c("user_id") % 3).cast("string"), F.lit("a"), (1 + c("user_id") % 3).cast("string"))
    return v.demo.select("user_id", F.array_join(F.transform(qn.by_code(m), lambda e: F.concat(e["key"], e["value"])), ",").alias("entries"))


@query("se1_union", "SELECT user_id, date, n_events, NULL::BIGINT AS q1 FROM v_daily UNION ALL SELECT user_id, CAST(response_time AS DATE), NULL, q1 FROM v_ema_wide")
def _(v):
    e = v.ema_wide.select("user_id", F.to_date("response_time").alias("date"), c("q1").cast("long").alias("q1"))
    return v.daily.select("user_id", "date", "n_events").unionByName(e, allowMissingColumns=True)


@query("se2_set_operations", "(SELECT user_id, 'both' AS kind FROM v_demo INTERSECT SELECT user_id, 'both' FROM v_daily) UNION ALL (SELECT user_id, 'demo_only' FROM v_demo EXCEPT SELECT user_id, 'demo_only' FROM v_daily)")
def _(v):
    a, b = v.demo.select("user_id"), v.daily.select("user_id")
    return a.intersect(b).withColumn("kind", F.lit("both")).union(a.subtract(b).withColumn("kind", F.lit("demo_only")))


@query("se3_unordered_pairs", "SELECT DISTINCT least(a.event_type, b.event_type) AS a, greatest(a.event_type, b.event_type) AS b FROM (SELECT DISTINCT user_id, event_type FROM events) a JOIN (SELECT DISTINCT user_id, event_type FROM events) b ON a.user_id = b.user_id AND a.event_type <> b.event_type")
def _(v):
    e = v.events.select("user_id", "event_type").distinct()
    j = e.join(e.select("user_id", c("event_type").alias("other")), "user_id").where("event_type <> other")
    return j.select(F.least("event_type", "other").alias("a"), F.greatest("event_type", "other").alias("b")).dropDuplicates(["a", "b"])


# Questionnaires


@query("qn1_question_key", "SELECT event_id, variable AS question FROM v_ema_long")
def _(v):
    return v.ema_long.select("event_id", qn.question_key(F.concat(F.lit(" /"), c("variable"), F.lit("?  "))).alias("question"))


@query("qn2_reverse_dictionary", "SELECT DISTINCT scale, 'low:' || CASE scale WHEN 'S4' THEN 4 ELSE 5 END || ',high:1' AS codes FROM v_ema_long")
def _(v):
    top = F.when(c("scale") == "S4", 4).otherwise(5)
    m = qn.reverse_codes(qn.as_map(F.concat(F.lit('{"low": "1", "high": "'), top.cast("string"), F.lit('"}'))), top)
    return v.ema_long.select("scale", F.array_join(F.transform(F.map_entries(m), lambda e: F.concat_ws(":", e["key"], e["value"])), ",").alias("codes")).distinct()


@query("qn3_reverse_scale", "SELECT event_id, CASE WHEN regexp_matches(response_raw, '^[0-9]+$') THEN CAST(6 - CAST(response_raw AS INT) AS VARCHAR) ELSE response_raw END AS response FROM v_ema_long WHERE NOT response_raw LIKE 'never'".replace("CAST(response_raw AS INT)", "try_cast(response_raw AS INT)"))
def _(v):
    return v.ema_long.select("event_id", qn.reverse_scale(c("response_raw"), 5).alias("response"))


@query("qn4_map_codes", "SELECT event_id, CASE response_raw WHEN '1' THEN '4' WHEN '2' THEN '3' WHEN '3' THEN '2' WHEN '4' THEN '2' WHEN '5' THEN '1' END AS traffic, CASE response_raw WHEN '1' THEN '3' WHEN '2' THEN '1' WHEN '3' THEN '2' WHEN '4' THEN '4' ELSE response_raw END AS calm FROM v_ema_long")
def _(v):
    return v.ema_long.select("event_id", qn.map_codes(c("response_raw"), qn.TRAFFIC_5).alias("traffic"), qn.map_codes(c("response_raw"), qn.CALM_4, keep=True).alias("calm"))


@query("qn5_canonical_names", "SELECT event_id, CASE WHEN variable LIKE '%pur%' THEN 'PURCHASE' ELSE variable END AS variable, CASE WHEN scale IN ('S4') THEN CASE variable WHEN 'view' THEN 'LOOK' WHEN 'click' THEN 'PRESS' END ELSE variable END AS label FROM v_ema_long")
def _(v):
    return v.ema_long.select("event_id", qn.canonical_name(c("variable"), "pur", "PURCHASE").alias("variable"), qn.form_labels(c("variable"), c("scale"), ("S4", "V7"), {"view": "LOOK", "click": "PRESS"}).alias("label"))


@query("qn6_changed_counts", "SELECT scale, count(*) FILTER (WHERE regexp_matches(response_raw, '^[0-9]+$') AND response_raw <> '3') AS n_changed, count(*) FILTER (WHERE NOT (regexp_matches(response_raw, '^[0-9]+$') AND response_raw <> '3')) AS n_same FROM v_ema_long GROUP BY scale")
def _(v):
    new = qn.reverse_scale(c("response_raw"), 5)
    return v.ema_long.groupBy("scale").agg(F.count_if(~c("response_raw").eqNullSafe(new)).alias("n_changed"), F.count_if(c("response_raw").eqNullSafe(new)).alias("n_same"))


@query("qn7_translate", "SELECT event_id, CASE variable WHEN 'view' THEN 'look' WHEN 'click' THEN 'press' ELSE variable END AS term FROM v_ema_long")
def _(v):
    return v.ema_long.select("event_id", qn.map_codes(c("variable"), {"view": "look", "click": "press"}, keep=True).alias("term"))


@query("qn8_reversed_map", "SELECT user_id, CAST(user_id % 5 AS VARCHAR) || '=' || class_name AS entry FROM v_demo")
def _(v):
    m = qn.reversed_map(F.create_map("class_name", (c("user_id") % 5).cast("string")))
    return v.demo.select("user_id", F.array_join(F.transform(F.map_entries(m), lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("entry"))


@query("qn9_scale_range", f"SELECT event_id, CASE WHEN response BETWEEN 1 AND 4 THEN response END AS response FROM {LONG} WHERE scale = 'S5'")
def _(v):
    return long(v).where("scale = 'S5'").select("event_id", qn.in_range(c("response"), 1, 4).alias("response"))


SCORED = f"(SELECT *, CASE WHEN scale = 'S4' AND variable IN ('view', 'click') THEN 5 - response WHEN scale = 'S5' AND variable = 'purchase' THEN 6 - response ELSE response END AS scored FROM {LONG})"


def scored(v):
    x = F.when((c("scale") == "S4") & c("variable").isin("view", "click"), 5 - c("response")).when((c("scale") == "S5") & (c("variable") == "purchase"), 6 - c("response")).otherwise(c("response"))
    return long(v).withColumn("scored", x)


@query("qn10_reverse_score", f"SELECT event_id, scored FROM {SCORED}")
def _(v):
    return scored(v).select("event_id", "scored")


@query("qn11_person_z", f"SELECT event_id, CASE WHEN scored IS NULL THEN NULL WHEN coalesce(stddev_samp(scored) OVER w, 0) = 0 THEN 0 ELSE round((scored - avg(scored) OVER w) / stddev_samp(scored) OVER w, 6) END AS z FROM {SCORED} WINDOW w AS (PARTITION BY user_id, scale)")
def _(v):
    return qn.zscore(scored(v), "scored", ["user_id", "scale"], "z").select("event_id", r6(c("z"), "z"))


@query("qn12_population_z", f"SELECT event_id, round((scored - avg(scored) OVER w) / stddev_samp(scored) OVER w, 6) AS z FROM {SCORED} WINDOW w AS (PARTITION BY scale)")
def _(v):
    g = scored(v).groupBy("scale").agg(F.avg("scored").alias("m"), F.stddev_samp("scored").alias("s"))
    return scored(v).join(F.broadcast(g), "scale").select("event_id", r6((c("scored") - c("m")) / F.when(c("s") == 0, 1.0).otherwise(c("s")), "z"))


@query("qn13_raw_path", f"SELECT user_id, scale, count(scored) AS n_valid, round(avg(scored), 6) AS mean FROM {SCORED} GROUP BY user_id, scale")
def _(v):
    return scored(v).groupBy("user_id", "scale").agg(F.count("scored").alias("n_valid"), r6(F.avg("scored"), "mean"))


ZED = f"(SELECT *, CASE WHEN scored IS NULL THEN NULL WHEN coalesce(stddev_samp(scored) OVER w, 0) = 0 THEN 0 ELSE (scored - avg(scored) OVER w) / stddev_samp(scored) OVER w END AS z FROM {SCORED} WINDOW w AS (PARTITION BY user_id, scale))"


def zed(v):
    return qn.zscore(scored(v), "scored", ["user_id", "scale"], "z")


@query("qn14_scale_summary", f"SELECT user_id, scale, variable, count(*) AS n, count(response) AS n_valid, count(DISTINCT variable) AS n_vars, count(DISTINCT date) AS n_days, min(date) AS first_date, max(date) AS last_date, " + ", ".join(f"round(avg({x}), 6) + 0.0::DOUBLE AS {n}_mean, round(stddev_samp({x}), 6) AS {n}_sd" for x, n in (("response", "raw"), ("scored", "reversed"), ("z", "z"))) + f" FROM {ZED} GROUP BY GROUPING SETS ((user_id, scale), (user_id, scale, variable))")
def _(v):
    return qn.scale_summary(zed(v), "user_id")


@query("qn15_daily_averages", "SELECT user_id, date, " + ", ".join(f"round(avg(scored) FILTER (WHERE scale = '{x}'), 6) AS \"{x}_reversed\", round(avg(z) FILTER (WHERE scale = '{x}'), 6) AS \"{x}_z\", count(scored) FILTER (WHERE scale = '{x}') AS \"{x}_n\"" for x in ("S4", "S5")) + f" FROM {ZED} GROUP BY user_id, date")
def _(v):
    return qn.daily_scales(zed(v), ["user_id", "date"], ["S4", "S5"])


@query("qn15_response_counts", f"WITH d AS (SELECT user_id, date, count(scored) AS n_responses FROM {SCORED} GROUP BY user_id, date) SELECT n_responses, count(*) AS n_days, count(DISTINCT user_id) AS n_users, round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM d), 6) AS pct_days FROM d GROUP BY n_responses")
def _(v):
    d = scored(v).groupBy("user_id", "date").agg(F.count("scored").alias("n_responses"))
    g = d.groupBy("n_responses").agg(F.count("*").alias("n_days"), F.countDistinct("user_id").alias("n_users"))
    return g.withColumn("pct_days", F.round(c("n_days") * 100.0 / F.sum("n_days").over(W.partitionBy()), 6))


@query("qn16_composite", "SELECT event_id, round((q1 + q2 + q3 + (6 - q4) + (6 - q5) + (6 - q6)) / 6.0::DOUBLE, 6) AS composite FROM v_ema_wide")
def _(v):
    return v.ema_wide.select("event_id", r6(qn.row_mean(c("q1"), c("q2"), c("q3"), 6 - c("q4"), 6 - c("q5"), 6 - c("q6")), "composite"))


@query("qn17_participant_table", f"SELECT e.user_id, e.event_id, e.variable AS item, code FROM v_ema_long e JOIN {DICT} d ON d.scale = e.scale AND d.variable = e.variable WHERE e.scale <> 'S5'")
def _(v):
    d = v.ema_long.where("scale <> 'S5'").join(book(v), ["scale", "variable"]).withColumnRenamed("variable", "item")
    return d.select("user_id", "event_id", "item", "code")


# Study-level compositions


# Both studies' days with what the common schema takes of each: scores as they are and standardised, demographics, durations.
POOL = """dm AS (SELECT user_id, CASE gender_raw WHEN 'F' THEN 'female' WHEN 'M' THEN 'male' END AS gender, CASE centre_raw WHEN 'Yes' THEN 'city_center' ELSE 'suburb' END AS location_type, class_name AS class FROM v_demo),
a AS (SELECT 'studyA_' || user_id AS participant_id, 'studyA' AS dataset_source, date, outcome AS mood_raw, (outcome - avg(outcome) OVER ()) / stddev_pop(outcome) OVER () AS mood, gender, location_type, 'adult' AS age_group, NULL::VARCHAR AS class, total_value AS duration, n_events AS mobility_duration, n_types AS fragments, n_types - total_value AS fragments_delta, CASE WHEN isodow(date) - 1 IN (4, 5) THEN 1 ELSE 0 END AS is_weekend FROM (SELECT * FROM v_daily WHERE source = 'studyA') d LEFT JOIN dm USING (user_id)),
b AS (SELECT 'studyB_' || user_id AS participant_id, 'studyB' AS dataset_source, date, outcome AS mood_raw, -(outcome - avg(outcome) OVER ()) / stddev_pop(outcome) OVER () AS mood, gender, location_type, 'adolescent' AS age_group, class, total_value AS duration, n_events AS mobility_duration, NULL::BIGINT AS fragments, NULL::DOUBLE AS fragments_delta, CASE WHEN isodow(date) - 1 IN (5, 6) THEN 1 ELSE 0 END AS is_weekend FROM (SELECT * FROM v_daily WHERE source = 'studyB') d LEFT JOIN dm USING (user_id)),
pool AS (SELECT * FROM a UNION ALL SELECT * FROM b)"""


def study(v, name, weekend, sign, age_group):
    demo = v.demo.select("user_id", labels.recode(c("gender_raw"), {"F": "female", "M": "male"}).alias("gender"), labels.recode(c("centre_raw"), {"Yes": "city_center"}, F.lit("suburb")).alias("location_type"), c("class_name").alias("class"))
    d = qn.zscore(v.daily.where(c("source") == name), "outcome", [], "z", ddof=0).join(demo, "user_id", "left")
    return d.select(ids.composite_id(c("source"), c("user_id")).alias("participant_id"), c("source").alias("dataset_source"), "date", c("outcome").alias("mood_raw"), (c("z") * sign).alias("mood"), "gender", "location_type", F.lit(age_group).alias("age_group"), "class", c("total_value").alias("duration"), c("n_events").alias("mobility_duration"), c("n_types").alias("fragments"), fr.delta(c("total_value"), c("n_types"), reverse=True).alias("fragments_delta"), times.is_weekend(c("date"), weekend).alias("is_weekend"))


def study_a(v):
    return study(v, "studyA", (4, 5), 1, "adult").drop("class")


def study_b(v):
    return study(v, "studyB", (5, 6), -1, "adolescent").drop("fragments", "fragments_delta")


def pooled(v):
    return study_a(v).unionByName(study_b(v), allowMissingColumns=True)


COMMON = "participant_id, dataset_source, date, mood_raw, round(mood, 6) AS mood, gender, location_type, age_group, duration, mobility_duration, is_weekend"


@query("po1_study_a", f"WITH {POOL} SELECT {COMMON}, fragments, fragments_delta FROM a")
def _(v):
    return study_a(v).withColumn("mood", F.round("mood", 6))


@query("po2_study_b", f"WITH {POOL} SELECT {COMMON}, class FROM b")
def _(v):
    return study_b(v).withColumn("mood", F.round("mood", 6))


@query("po3_pool", f"WITH {POOL} SELECT {COMMON}, fragments, fragments_delta, class FROM pool")
def _(v):
    return pooled(v).withColumn("mood", F.round("mood", 6))


# Both studies in the common schema by a mapping each: two raw scores, and both standardised, by participant or over all.
COMMON_SCHEMA = "participant_id string, dataset_source string, date date, anxiety_raw double, mood_raw double, anxiety double, mood double, gender string, location_type string, age_group string, class string, duration double, mobility_duration double, fragments double, fragments_delta double, is_weekend int"
GENDER = {"F": "female", "M": "male"}


def mapped(v, name: str, own: dict, sign: int, by: tuple[str, ...]):
    d = v.daily.where(c("source") == name).withColumn("level", c("total_value") / c("n_events"))
    d = schemas.standardised(d, {"anxiety": "level", "mood": "outcome"}, by, {"mood": sign})
    shared = {"participant_id": ids.composite_id(c("source"), c("user_id")), "dataset_source": "source", "date": "date", "anxiety_raw": "level", "mood_raw": "outcome", "anxiety": "anxiety", "mood": "mood", "gender": labels.recode(c("gender_raw"), GENDER, F.lit("other")), "duration": "total_value", "mobility_duration": "n_events"}
    return schemas.to_schema(d.join(v.demo, "user_id", "left"), COMMON_SCHEMA, {**shared, **own}, required=("participant_id", "anxiety_raw"))


def mapped_a(v, by=()):
    own = {"location_type": labels.recode(c("centre_raw"), {"Yes": "city_center"}, F.lit("suburb")), "age_group": F.lit("adult"), "fragments": "n_types", "fragments_delta": fr.delta(c("total_value"), c("n_types"), reverse=True), "is_weekend": times.is_weekend(c("date"), (4, 5)), "class": "no_such_column"}
    return mapped(v, "studyA", own, 1, by)


def mapped_b(v, by=()):
    own = {"location_type": F.when(F.coalesce(F.lower(F.trim("centre_raw")), F.lit("")) != "no", "city_center").otherwise("suburb"), "age_group": F.lit("adolescent"), "class": "class_name", "is_weekend": times.is_weekend(c("date"), (5, 6))}
    return mapped(v, "studyB", own, -1, by)


def mapped_sql(by: bool) -> str:
    z = lambda x: f"CASE WHEN coalesce(stddev_samp({x}) OVER w, 0) = 0 THEN CASE WHEN {x} IS NOT NULL THEN 0 END ELSE ({x} - avg({x}) OVER w) / stddev_samp({x}) OVER w END" if by else f"({x} - avg({x}) OVER ()) / stddev_pop({x}) OVER ()"
    w = " WINDOW w AS (PARTITION BY user_id)" if by else ""
    one = lambda name, sign, place, age, cls, frag, delta, days: f"SELECT '{name}_' || user_id AS participant_id, '{name}' AS dataset_source, date, level AS anxiety_raw, outcome AS mood_raw, {z('level')} AS anxiety, {sign} * ({z('outcome')}) AS mood, CASE gender_raw WHEN 'F' THEN 'female' WHEN 'M' THEN 'male' ELSE 'other' END AS gender, {place} AS location_type, '{age}' AS age_group, {cls} AS class, total_value AS duration, CAST(n_events AS DOUBLE) AS mobility_duration, {frag} AS fragments, {delta} AS fragments_delta, CASE WHEN isodow(date) - 1 IN ({days}) THEN 1 ELSE 0 END AS is_weekend FROM (SELECT *, total_value / n_events AS level FROM v_daily WHERE source = '{name}') d LEFT JOIN v_demo USING (user_id){w}"
    a = one("studyA", 1, "CASE centre_raw WHEN 'Yes' THEN 'city_center' ELSE 'suburb' END", "adult", "CAST(NULL AS VARCHAR)", "CAST(n_types AS DOUBLE)", "n_types - total_value", "4, 5")
    b = one("studyB", -1, "CASE WHEN coalesce(lower(trim(centre_raw)), '') <> 'no' THEN 'city_center' ELSE 'suburb' END", "adolescent", "class_name", "CAST(NULL AS DOUBLE)", "CAST(NULL AS DOUBLE)", "5, 6")
    return f"a AS ({a}), b AS ({b}), pool AS (SELECT * FROM a UNION ALL SELECT * FROM b)"


MAPPED = "participant_id, dataset_source, date, round(anxiety_raw, 6) AS anxiety_raw, mood_raw, round(anxiety, 6) AS anxiety, round(mood, 6) AS mood, gender, location_type, age_group, class, duration, mobility_duration, fragments, round(fragments_delta, 6) AS fragments_delta, is_weekend"


def rounded(d):
    return d.withColumns({x: F.round(x, 6) for x in ("anxiety_raw", "anxiety", "mood", "fragments_delta")})


@query("po1_mapped_by_participant", f"WITH {mapped_sql(True)} SELECT {MAPPED} FROM a")
def _(v):
    return rounded(mapped_a(v, ("user_id",)))


@query("po1_mapped_by_population", f"WITH {mapped_sql(False)} SELECT {MAPPED} FROM a")
def _(v):
    return rounded(mapped_a(v))


@query("po2_mapped_by_participant", f"WITH {mapped_sql(True)} SELECT {MAPPED} FROM b")
def _(v):
    return rounded(mapped_b(v, ("user_id",)))


@query("po2_mapped_by_population", f"WITH {mapped_sql(False)} SELECT {MAPPED} FROM b")
def _(v):
    return rounded(mapped_b(v))


@query("po3_pool_by_participant", f"WITH {mapped_sql(True)} SELECT {MAPPED} FROM pool")
def _(v):
    return rounded(schemas.pool([mapped_a(v, ("user_id",)), mapped_b(v, ("user_id",))]))


@query("po3_pool_by_population", f"WITH {mapped_sql(False)} SELECT {MAPPED} FROM pool")
def _(v):
    return rounded(schemas.pool([mapped_a(v), mapped_b(v)]))


@query("po4_fragment_stats", f"WITH {POOL} SELECT dataset_source, count(fragments) AS n, round(avg(fragments), 6) AS mean, round(stddev_samp(fragments), 6) AS sd FROM pool GROUP BY GROUPING SETS ((dataset_source), ())")
def _(v):
    return pooled(v).groupingSets([["dataset_source"], []], "dataset_source").agg(F.count("fragments").alias("n"), r6(F.avg("fragments"), "mean"), r6(F.stddev_samp("fragments"), "sd"))


@query("po5_quality_checks", f"WITH {POOL} SELECT dataset_source, count(*) AS n, round(corr(duration, mood), 6) AS r_duration_mood, round(corr(duration, fragments), 6) AS r_duration_fragments FROM pool GROUP BY GROUPING SETS ((dataset_source), ()) HAVING count(*) > 5")
def _(v):
    g = pooled(v).groupingSets([["dataset_source"], []], "dataset_source").agg(F.count("*").alias("n"), r6(F.corr("duration", "mood"), "r_duration_mood"), r6(F.corr("duration", "fragments"), "r_duration_fragments"))
    return g.where("n > 5")


@query("po5_duration_distribution", f"WITH {POOL} SELECT dataset_source, count(duration) AS n, round(avg(duration), 6) AS mean, round(stddev_samp(duration), 6) AS sd, min(duration) AS min, max(duration) AS max, " + ", ".join(f"round(quantile_cont(duration, {q}), 6) AS {n}" for q, n in ((0.25, "q25"), (0.5, "median"), (0.75, "q75"))) + ", count(*) FILTER (WHERE duration = 0) AS n_zero, count(*) FILTER (WHERE duration > 1440) AS n_over_day FROM pool GROUP BY GROUPING SETS ((dataset_source), ())")
def _(v):
    """The quartiles of each study and of the pool, as which every row counts once more, come from brackets and ranks."""
    d = pooled(v).select("dataset_source", "duration")
    g = d.groupingSets([["dataset_source"], []], "dataset_source").agg(F.count("duration").alias("n"), r6(F.avg("duration"), "mean"), r6(F.stddev_samp("duration"), "sd"), F.min("duration").alias("min"), F.max("duration").alias("max"), F.count_if(c("duration") == 0).alias("n_zero"), F.count_if(c("duration") > 1440).alias("n_over_day"))
    both = d.withColumn("dataset_source", F.explode(F.array(c("dataset_source"), F.lit(None))))
    q = quantiles.group_percentiles(both, ["dataset_source"], "duration", [0.25, 0.5, 0.75], "q").withColumnRenamed("dataset_source", "of")
    quartiles = [F.round(c("q")[i], 6).alias(n) for i, n in enumerate(("q25", "median", "q75"))]
    return g.join(q, c("dataset_source").eqNullSafe(c("of")), "left").select("dataset_source", "n", "mean", "sd", "min", "max", *quartiles, "n_zero", "n_over_day")


BREAKDOWN = ("dataset_source", "gender", "location_type", "age_group", "is_weekend")


@query("po6_pooled_summary", f"WITH {POOL}, l AS (" + " UNION ALL ".join(f"SELECT '{x}' AS variable, CAST({x} AS VARCHAR) AS value, participant_id, fragments, mood, duration FROM pool" for x in BREAKDOWN) + ") SELECT variable, value, count(*) AS n, count(DISTINCT participant_id) AS participants, round(100.0::DOUBLE * count(fragments) / count(*), 6) AS pct_fragments, round(100.0::DOUBLE * count(mood) / count(*), 6) AS pct_mood, round(avg(duration), 6) AS mean_duration FROM l GROUP BY variable, value")
def _(v):
    d = pooled(v).withColumn("is_weekend", c("is_weekend").cast("string"))
    long_ = d.unpivot(["participant_id", "fragments", "mood", "duration"], list(BREAKDOWN), "variable", "value")
    share = lambda x: F.count(x) * 100.0 / F.count("*")
    return long_.groupBy("variable", "value").agg(F.count("*").alias("n"), F.countDistinct("participant_id").alias("participants"), r6(share("fragments"), "pct_fragments"), r6(share("mood"), "pct_mood"), r6(F.avg("duration"), "mean_duration"))


@query("po6_delta_signs", f"WITH {POOL} SELECT dataset_source, count(fragments_delta) AS n, " + ", ".join(f"round(100.0::DOUBLE * count(*) FILTER (WHERE fragments_delta {o} 0) / nullif(count(fragments_delta), 0), 6) AS pct_{n}" for n, o in (("positive", ">"), ("negative", "<"), ("zero", "="))) + " FROM pool GROUP BY GROUPING SETS ((dataset_source), ())")
def _(v):
    n = F.count("fragments_delta")
    sign = lambda cond, name: r6(F.count_if(cond) * 100.0 / F.nullif(n, F.lit(0)), name)
    d = c("fragments_delta")
    return pooled(v).groupingSets([["dataset_source"], []], "dataset_source").agg(n.alias("n"), sign(d > 0, "pct_positive"), sign(d < 0, "pct_negative"), sign(d == 0, "pct_zero"))


@query("po7_clean_set", f"WITH {POOL} SELECT participant_id, date, coalesce(fragments, 0) AS fragments, coalesce(fragments, 0) - duration AS delta FROM pool WHERE duration <> 0")
def _(v):
    d = pooled(v).where("duration <> 0").na.fill(0, ["fragments"])
    return d.select("participant_id", "date", "fragments", fr.delta(c("duration"), c("fragments"), reverse=True).alias("delta"))


@query("po8_coverage", "WITH e AS (SELECT DISTINCT user_id, CAST(response_time AS DATE) AS date FROM v_ema_wide), j AS (SELECT coalesce(d.user_id, e.user_id) AS user_id, d.user_id IS NOT NULL AND e.user_id IS NOT NULL AS both_ FROM v_daily d FULL JOIN e ON d.user_id = e.user_id AND d.date = e.date) SELECT gender_raw, class_name, count(*) AS n, count(DISTINCT user_id) AS participants, round(count(*) / CAST(count(DISTINCT user_id) AS DOUBLE), 6) AS mean_records, round(avg(CASE WHEN both_ THEN 1.0::DOUBLE ELSE 0 END), 6) AS overlap FROM j JOIN v_demo USING (user_id) GROUP BY GROUPING SETS ((gender_raw), (class_name), (gender_raw, class_name))")
def _(v):
    e = v.ema_wide.select("user_id", F.to_date("response_time").alias("date")).distinct()
    j = jn.outer_with_side(v.daily.select("user_id", "date"), e, ["user_id", "date"]).join(v.demo, "user_id")
    return j.groupingSets([["gender_raw"], ["class_name"], ["gender_raw", "class_name"]], "gender_raw", "class_name").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("participants"), r6(F.count("*") / F.countDistinct("user_id"), "mean_records"), r6(F.avg(F.when(c("side") == "both", 1.0).otherwise(0.0)), "overlap"))
