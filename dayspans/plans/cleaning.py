"""Queries of the cleaning operators: identifiers, missing values, times, predicates and labels."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import ids, labels, missing, times
from .registry import query

c = F.col

ID1_SQL = r"""
WITH a AS (SELECT user_id, trim(coalesce(raw, '')) AS s FROM v_ids),
b AS (SELECT user_id, regexp_replace(CASE WHEN starts_with(lower(s), 'study') THEN substr(s, 6) WHEN starts_with(lower(s), 'p_') THEN substr(s, 3) WHEN starts_with(lower(s), 'p') THEN substr(s, 2) ELSE s END, '[pP]$', '') AS s FROM a),
d AS (SELECT user_id, s, regexp_extract(s, '[0-9]+', 0) AS n FROM b)
SELECT user_id, CASE WHEN n <> '' THEN CASE WHEN ltrim(n, '0') = '' THEN '0' ELSE ltrim(n, '0') END ELSE regexp_replace(s, '[^A-Za-z0-9]', '', 'g') END AS clean_id FROM d
"""


@query("id1_standardize_id", ID1_SQL)
def _(v):
    return v.ids.select("user_id", ids.standardize_id(c("raw")).alias("clean_id"))


@query("id2_clean_id", r"""
WITH a AS (SELECT user_id, trim(coalesce(raw, '')) AS s FROM v_ids),
b AS (SELECT user_id, CASE WHEN starts_with(lower(s), 'study') THEN substr(s, 6) ELSE s END AS s FROM a),
b2 AS (SELECT user_id, CASE WHEN starts_with(lower(s), 'study_') OR starts_with(lower(s), 'study-') THEN substr(s, 7) ELSE s END AS s FROM b),
b3 AS (SELECT user_id, CASE WHEN starts_with(lower(s), 'p_') THEN substr(s, 3) ELSE s END AS s FROM b2),
b4 AS (SELECT user_id, CASE WHEN starts_with(lower(s), 'p') THEN substr(s, 2) ELSE s END AS s FROM b3),
b5 AS (SELECT user_id, regexp_replace(CASE WHEN starts_with(lower(s), 'pilot_') THEN substr(s, 7) ELSE s END, '[pP]$', '') AS s FROM b4),
d AS (SELECT user_id, s, regexp_extract(s, '[0-9]+', 0) AS n FROM b5)
SELECT user_id, CASE WHEN n <> '' THEN CASE WHEN ltrim(n, '0') = '' THEN '0' ELSE ltrim(n, '0') END ELSE s END AS clean_id FROM d""")
def _(v):
    return v.ids.select("user_id", ids.clean_id(c("raw")).alias("clean_id"))


@query("id3_padded_id", "SELECT user_id, CASE WHEN regexp_replace(raw, '[^0-9]', '', 'g') = '' THEN regexp_replace(raw, '[^A-Za-z0-9]', '', 'g') WHEN length(regexp_replace(raw, '[^0-9]', '', 'g')) < 3 THEN lpad(regexp_replace(raw, '[^0-9]', '', 'g'), 3, '0') ELSE regexp_replace(raw, '[^0-9]', '', 'g') END AS clean_id FROM v_ids")
def _(v):
    return v.ids.select("user_id", ids.padded_id(c("raw")).alias("clean_id"))


@query("id4_short_id", "WITH d AS (SELECT user_id, ltrim(regexp_replace(raw, '[^0-9]', '', 'g'), '0') AS n FROM v_ids) SELECT user_id, CASE WHEN length(n) < 2 THEN lpad(n, 2, '0') ELSE n END AS clean_id FROM d")
def _(v):
    return v.ids.select("user_id", ids.short_id(c("raw")).alias("clean_id"))


@query("id5_integer_id", "SELECT user_id, coalesce(CAST(try_cast(substr(raw_id, 3) AS BIGINT) AS VARCHAR), raw_id) AS clean_id FROM v_demo")
def _(v):
    return v.demo.select("user_id", ids.integer_id(F.substring("raw_id", 3, 100)).alias("clean_id"))


@query("id6_id_mapping", "SELECT DISTINCT raw_id, CASE WHEN length(ltrim(regexp_replace(raw_id, '[^0-9]', '', 'g'), '0')) < 2 THEN lpad(ltrim(regexp_replace(raw_id, '[^0-9]', '', 'g'), '0'), 2, '0') ELSE ltrim(regexp_replace(raw_id, '[^0-9]', '', 'g'), '0') END AS clean_id FROM v_demo")
def _(v):
    return ids.id_mapping(v.demo, "raw_id", ids.short_id(c("raw_id")))


@query("id7_composite_check", "SELECT count(*) AS n_pairs, count(DISTINCT source || '_' || CAST(user_id AS VARCHAR)) AS n_composite FROM (SELECT DISTINCT source, user_id FROM v_daily)")
def _(v):
    return ids.composite_check(v.daily, "source", "user_id")


@query("id8_surrogate_id", "SELECT event_id, substr(sha256(CAST(user_id AS VARCHAR) || '|' || CAST(event_id AS VARCHAR)), 1, 8) AS short_id FROM v_gps")
def _(v):
    return v.gps.select("event_id", ids.surrogate_id(c("user_id"), c("event_id"), length=8).alias("short_id"))


@query("id9_source_of", "SELECT user_id, lower(split_part(raw_id, '_', 1)) AS source FROM v_demo")
def _(v):
    return v.demo.select("user_id", ids.source_of(c("raw_id")).alias("source"))


@query("nm1_tokens_to_null", "SELECT event_id, CASE WHEN travel_mode NOT IN ('Missing', 'NA', '') THEN travel_mode END AS travel_mode FROM v_points")
def _(v):
    return v.points.select("event_id", missing.tokens_to_null(c("travel_mode")).alias("travel_mode"))


@query("nm2_to_number", "SELECT event_id, try_cast(response_raw AS DOUBLE) AS response FROM v_ema_long")
def _(v):
    return v.ema_long.select("event_id", missing.to_number(c("response_raw")).alias("response"))


@query("nm3_salvage_number", "SELECT event_id, coalesce(try_cast(response_raw AS DOUBLE), try_cast(regexp_replace(response_raw, '[^0-9.]', '', 'g') AS DOUBLE)) AS response FROM v_ema_long")
def _(v):
    return v.ema_long.select("event_id", missing.salvage_number(c("response_raw")).alias("response"))


@query("nm4_sentinels_to_null", "SELECT user_id, CASE WHEN balance NOT IN (999, -999, 9999, -9999) THEN balance END AS balance FROM v_demo")
def _(v):
    return missing.sentinels_to_null(v.demo.select("user_id", "balance"), ["balance"])


@query("nm5_text_to_bool", "SELECT user_id, CASE centre_raw WHEN 'Yes' THEN true WHEN 'No' THEN false END AS is_centre FROM v_demo")
def _(v):
    text = labels.recode(c("centre_raw"), {"Yes": "True", "No": "False"})
    return v.demo.select("user_id", missing.text_to_bool(text).alias("is_centre"))


# What stands for an unknown balance in v_demo; the other sentinels are balances that a customer may have.
UNKNOWN = (999,)


@query("nm6_fill_constant", "SELECT user_id, coalesce(CASE WHEN balance <> 999 THEN balance END, 0) AS balance FROM v_demo")
def _(v):
    return missing.sentinels_to_null(v.demo.select("user_id", "balance"), ["balance"], UNKNOWN).na.fill(0.0, ["balance"])


@query("nm7_fill_mean", "WITH d AS (SELECT user_id, CASE WHEN balance <> 999 THEN balance END AS balance FROM v_demo) SELECT user_id, round(coalesce(balance, (SELECT avg(balance) FROM d)), 6) AS balance FROM d")
def _(v):
    filled = missing.fill_with_mean(missing.sentinels_to_null(v.demo.select("user_id", "balance"), ["balance"], UNKNOWN), ["balance"])
    return filled.select("user_id", F.round("balance", 6).alias("balance"))


@query("nm8_fill_from_other", "SELECT event_id, coalesce(try_cast(response_raw AS DOUBLE), CAST(user_id AS DOUBLE)) AS response FROM v_ema_long")
def _(v):
    return v.ema_long.select("event_id", F.coalesce(missing.to_number(c("response_raw")), c("user_id").cast("double")).alias("response"))


RULES = {"balance": (-500.0, 5000.0)}


@query("nm9_apply_rules", "SELECT user_id, CASE WHEN balance BETWEEN -500 AND 5000 THEN balance END AS balance, CASE WHEN gender_raw IN ('F', 'M') THEN gender_raw END AS gender_raw FROM v_demo")
def _(v):
    return missing.apply_rules(v.demo.select("user_id", "balance", "gender_raw"), RULES, {"gender_raw": ("F", "M")})


@query("nm9_rule_report", "SELECT count_if(NOT balance BETWEEN -500 AND 5000) AS balance_violations, count_if(gender_raw NOT IN ('F', 'M')) AS gender_raw_violations FROM v_demo")
def _(v):
    return missing.rule_report(v.demo, RULES, {"gender_raw": ("F", "M")})


@query("nm10_range_report", "WITH l AS (SELECT 'q1' AS variable, q1 AS x FROM v_ema_wide UNION ALL SELECT 'q6', q6 FROM v_ema_wide UNION ALL SELECT 'happy', happy FROM v_ema_wide) SELECT variable, min(x) AS min_value, max(x) AS max_value, min(x) < 1 OR max(x) > 4 AS out_of_range FROM l GROUP BY variable")
def _(v):
    return missing.range_report(v.ema_wide, ["q1", "q6", "happy"], 1, 4)


@query("nm11_null_profile", "WITH l AS (SELECT 'start_end' AS \"column\", start_end AS x FROM v_points UNION ALL SELECT 'app', app FROM v_points UNION ALL SELECT 'place', place FROM v_points) SELECT count(*) AS n_rows, \"column\", count_if(x IS NULL) AS n_null, round(100.0::DOUBLE * count_if(x IS NULL) / count(*), 6) AS pct_null FROM l GROUP BY \"column\"")
def _(v):
    return missing.null_profile(v.points, ["start_end", "app", "place"])


@query("nm11_any_all_null", "SELECT count_if(start_end IS NULL OR app IS NULL) AS any_null, count_if(start_end IS NULL AND app IS NULL) AS all_null FROM v_points")
def _(v):
    return missing.any_all_null(v.points, ["start_end", "app"])


@query("nm11_completeness", "SELECT user_id, round(avg(CASE WHEN start_end IS NOT NULL THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS pct_complete FROM v_points GROUP BY user_id")
def _(v):
    return missing.completeness(v.points, "user_id", "start_end")


@query("nm12_drop_null", "SELECT event_id, start_end FROM v_points WHERE start_end IS NOT NULL")
def _(v):
    return v.points.select("event_id", "start_end").na.drop(subset=["start_end"])


@query("nm13_resolve_columns", "SELECT tracked_at AS timestamp, lat AS latitude, lon AS longitude FROM v_gps")
def _(v):
    found = missing.resolve_columns(v.gps, {"timestamp": ["timestamp", "tracked"], "latitude": ["latitude", "lat"], "longitude": ["lng", "lon"]})
    return v.gps.select(*[c(col).alias(name) for name, col in found.items()])


@query("nm14_tidy_names", "SELECT user_id AS participant_id, balance AS mean__eur_ FROM v_demo")
def _(v):
    return missing.tidy_names(v.demo.select(c("user_id").alias("Participant-ID "), c("balance").alias("Mean (EUR)"), c("class_name").alias("Unnamed: 3")))


@query("nm15_drop_columns", "SELECT user_id, gender_raw, centre_raw, balance FROM v_demo")
def _(v):
    return v.demo.drop("raw_id", "class_name", "not_there")


@query("nm16_datetime_columns", "SELECT tracked_at, date FROM v_gps")
def _(v):
    return v.gps.select(*missing.datetime_columns(v.gps))


@query("nm17_clean", "SELECT CASE WHEN ltrim(substr(raw_id, 3), '0') = '' THEN '0' ELSE ltrim(substr(raw_id, 3), '0') END AS clean_id, CASE WHEN balance NOT IN (999, -999, 9999, -9999) THEN balance END AS balance FROM v_demo")
def _(v):
    d = v.demo.select(ids.standardize_id(c("raw_id")).alias("clean_id"), "balance")
    return d.transform(missing.sentinels_to_null, ["balance"])


@query("ts1_pad_clock", "SELECT event_id, lpad(CAST(hour(ts) AS VARCHAR), 2, '0') || ':' || lpad(CAST(minute(ts) AS VARCHAR), 2, '0') || ':' || lpad(CAST(second(ts) AS VARCHAR), 2, '0') AS clock FROM v_screen")
def _(v):
    raw = F.concat_ws(":", F.hour("ts").cast("string"), F.minute("ts").cast("string"), F.second("ts").cast("string"))
    return v.screen.select("event_id", times.pad_clock(raw).alias("clock"))


@query("ts2_parse_any", "SELECT event_id, CASE WHEN event_id % 4 < 3 THEN date_trunc('second', ts) END AS parsed FROM v_screen")
def _(v):
    fmt = lambda f: F.date_format("ts", f)
    raw = F.when(c("event_id") % 4 == 0, fmt("yyyy-MM-dd HH:mm:ss")).when(c("event_id") % 4 == 1, fmt("dd/MM/yyyy HH:mm:ss")).when(c("event_id") % 4 == 2, fmt("dd-MM-yyyy HH:mm:ss")).otherwise("n/a")
    return v.screen.select("event_id", times.parse_any(raw).alias("parsed"))


@query("ts3_combine", "SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN date_trunc('second', ts) END AS combined FROM v_screen")
def _(v):
    t = F.when(c("event_id") % 5 != 0, F.date_format("ts", "HH:mm:ss"))
    return v.screen.select("event_id", times.combine(F.date_format("ts", "yyyy-MM-dd"), t).alias("combined"))


@query("ts4_zone", "SELECT event_id, CAST(epoch_us(ts) AS BIGINT) AS us FROM v_screen")
def _(v):
    return v.screen.select("event_id", times.micros(c("ts")).alias("us"))


@query("ts5_shift", "SELECT event_id, ts + INTERVAL 1603 DAY + INTERVAL 17 HOUR + INTERVAL 1 MINUTE AS shifted FROM v_screen")
def _(v):
    return v.screen.select("event_id", times.shift(c("ts"), 1603, 17, 1).alias("shifted"))


# Each user's answers set its device's clock right, from then on: several corrections a device, rows before any of them.
CORRECTIONS = "(SELECT user_id, response_time AS since, max(q1 * 31 - 60) AS minutes FROM v_ema_wide WHERE event_id % 2 = 0 GROUP BY ALL)"


@query("ts5_device_corrections", f"SELECT event_id, s.ts + to_minutes(coalesce(k.minutes, 0)) AS corrected, k.since FROM v_screen s ASOF LEFT JOIN {CORRECTIONS} k ON s.user_id = k.user_id AND s.ts >= k.since")
def _(v):
    k = v.ema_wide.where("event_id % 2 = 0").groupBy("user_id", c("response_time").alias("since")).agg(F.max(c("q1") * 31 - 60).alias("minutes"))
    return times.corrected(v.screen, k, ["user_id"], "ts", "since", "minutes").select("event_id", c("ts").alias("corrected"), "since")


@query("ts6_clock_24", "SELECT event_id, strftime(ts, '%H:%M:%S') AS clock FROM v_screen")
def _(v):
    return v.screen.select("event_id", times.clock_24(F.date_format("ts", "hh:mm:ss a")).alias("clock"))


@query("ts7_unswap_february", "WITH d AS (SELECT event_id, make_date(2024, 1 + CAST(event_id % 12 AS INT), 1 + CAST(event_id % 3 AS INT)) AS d FROM v_screen) SELECT event_id, CASE WHEN day(d) = 2 AND month(d) > 2 AND d > DATE '2024-04-15' THEN make_date(year(d), 2, month(d)) ELSE d END AS d FROM d")
def _(v):
    d = F.make_date(F.lit(2024), 1 + (c("event_id") % 12).cast("int"), 1 + (c("event_id") % 3).cast("int"))
    return v.screen.select("event_id", times.unswap_february(d, F.lit("2024-04-15").cast("date")).alias("d"))


@query("ts8_unfuture", "WITH m AS (SELECT user_id, mode(CAST(year(ts) AS INT)) AS y FROM v_screen GROUP BY user_id), d AS (SELECT event_id, user_id, CAST(ts AS DATE) AS d FROM v_screen) SELECT event_id, CASE WHEN d > DATE '2024-01-20' THEN make_date(CAST(CASE WHEN y > 2024 THEN 2024 ELSE y - 1 END AS INT), month(d), day(d)) ELSE d END AS d FROM d JOIN m USING (user_id)")
def _(v):
    m = v.screen.groupBy("user_id").agg(F.mode(F.year("ts")).alias("y"))
    d = v.screen.join(m, "user_id")
    return d.select("event_id", times.unfuture(F.to_date("ts"), F.lit("2024-01-20").cast("date"), c("y")).alias("d"))


@query("ts9_data_date", "SELECT event_id, CASE WHEN hour(response_time) < 5 THEN CAST(CAST(response_time AS DATE) - INTERVAL 1 DAY AS DATE) ELSE CAST(response_time AS DATE) END AS data_date FROM v_ema_wide")
def _(v):
    return v.ema_wide.select("event_id", times.data_date(c("response_time")).alias("data_date"))


@query("ts10_period", "SELECT event_id, CASE WHEN hour(ts) < 5 THEN 'early_morning' WHEN hour(ts) < 12 THEN 'morning' WHEN hour(ts) < 17 THEN 'afternoon' WHEN hour(ts) < 22 THEN 'evening' ELSE 'night' END AS period FROM v_screen")
def _(v):
    return v.screen.select("event_id", times.period(F.hour("ts")).alias("period"))


@query("ts11_weekend", "SELECT event_id, CAST(isodow(ts) - 1 AS INT) AS weekday, dayname(ts) AS day_name, CASE WHEN isodow(ts) - 1 IN (5, 6) THEN 1 ELSE 0 END AS weekend, CASE WHEN isodow(ts) - 1 IN (4, 5) THEN 1 ELSE 0 END AS weekend_fri_sat FROM v_screen")
def _(v):
    return v.screen.select("event_id", F.weekday("ts").alias("weekday"), F.date_format("ts", "EEEE").alias("day_name"), times.is_weekend(c("ts")).alias("weekend"), times.is_weekend(c("ts"), (4, 5)).alias("weekend_fri_sat"))


@query("ts12_elapsed_minutes", "SELECT event_id, CAST(floor((epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 60000000) AS BIGINT) AS minute FROM v_stress")
def _(v):
    first = F.min(times.micros(c("ts"))).over(Window.partitionBy("user_id"))
    return v.stress.withColumn("us", times.micros(c("ts")) - first).select("event_id", F.expr("us div 60000000").alias("minute"))


@query("ts13_duration_minutes", "SELECT event_id, CASE CAST(event_id % 7 AS INT) WHEN 0 THEN 1440.0 + 60 + 23 + 30.0 / 60 WHEN 1 THEN 5 + 30.0 / 60 WHEN 2 THEN 2880.0 + 7 * 60 WHEN 3 THEN 120.0 + 3 + 4.0 / 60 WHEN 4 THEN 12.5 WHEN 5 THEN 1.0 END::DOUBLE AS minutes FROM v_screen")
def _(v):
    raw = labels.recode((c("event_id") % 7).cast("int"), {0: "1 days 01:23:30", 1: "05:30", 2: "2 days 7", 3: "02:03:04", 4: "12.5", 5: "abc"})
    return v.screen.select("event_id", times.duration_minutes(raw, on_error=1.0).alias("minutes"))


@query("ts14_candidate_dates", "SELECT event_id, CASE WHEN day(ts) <= 12 THEN make_date(CAST(year(ts) AS INT), CAST(day(ts) AS INT), CAST(month(ts) AS INT)) END AS swapped, CAST(CAST(ts AS DATE) - INTERVAL 1 DAY AS DATE) AS day_before, CAST(CAST(ts AS DATE) + INTERVAL 1 DAY AS DATE) AS day_after FROM v_screen")
def _(v):
    d = F.to_date("ts")
    return v.screen.select("event_id", times.swapped_date(d).alias("swapped"), F.date_sub(d, 1).alias("day_before"), F.date_add(d, 1).alias("day_after"))


@query("ts15_month_year", "SELECT user_id, make_date(CAST(CASE WHEN user_id % 100 > 50 THEN 1900 + user_id % 100 ELSE 2000 + user_id % 100 END AS INT), CAST(1 + user_id % 12 AS INT), 15) AS born, CAST(2023 - CASE WHEN user_id % 100 > 50 THEN 1900 + user_id % 100 ELSE 2000 + user_id % 100 END AS INT) AS age FROM v_demo")
def _(v):
    raw = F.concat(F.date_format(F.make_date(F.lit(2000), 1 + (c("user_id") % 12).cast("int"), F.lit(1)), "MMM"), F.lit("-"), F.lpad((c("user_id") % 100).cast("string"), 2, "0"))
    born = times.month_year(raw)
    return v.demo.select("user_id", born.alias("born"), (2023 - F.year(born)).alias("age"))


@query("ts16_clip_to_day", "SELECT event_id, greatest(ts - INTERVAL 3 HOUR, CAST(date AS TIMESTAMP)) AS start_time, least(ts + INTERVAL 3 HOUR, CAST(date AS TIMESTAMP) + INTERVAL 86399 SECOND) AS end_time FROM v_screen")
def _(v):
    day = c("date").cast("timestamp_ntz")
    return v.screen.select("event_id", F.greatest(times.shift(c("ts"), hours=-3), day).alias("start_time"), F.least(times.shift(c("ts"), hours=3), day + F.expr("interval 86399 seconds")).alias("end_time"))


@query("pf1_on_earth", "SELECT event_id FROM v_gps WHERE lat <> 0 AND lon <> 0 AND lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180")
def _(v):
    return v.gps.where(labels.on_earth(c("lat"), c("lon"))).select("event_id")


@query("pf2_in_box", "SELECT event_id, lat BETWEEN 31.9 AND 32.5 AND lon BETWEEN 32.9 AND 36.1 AS near_box FROM v_gps WHERE lat BETWEEN 32 AND 32.06 AND lon BETWEEN 33 AND 36")
def _(v):
    box = (32.0, 32.06, 33.0, 36.0)
    return v.gps.where(labels.in_box(c("lat"), c("lon"), box)).select("event_id", labels.in_box(c("lat"), c("lon"), (32.0, 32.4, 33.0, 36.0), 0.1).alias("near_box"))


@query("pf3_repair_swaps", "SELECT event_id, lat, lon FROM v_gps")
def _(v):
    odd = c("event_id") % 3 == 0
    swapped = v.gps.select("event_id", F.when(odd, c("lon")).otherwise(c("lat")).alias("lat"), F.when(odd, c("lat")).otherwise(c("lon")).alias("lon"))
    return labels.repair_swaps(swapped, (29.0, 34.0, 34.0, 36.0)).select("event_id", "lat", "lon")


@query("pf4_repair_tracks", "SELECT event_id, CASE WHEN user_id % 4 <> 1 AND event_id % 5 = 0 THEN lon ELSE lat END AS lat, CASE WHEN user_id % 4 <> 1 AND event_id % 5 = 0 THEN lat ELSE lon END AS lon FROM v_gps")
def _(v):
    odd = (c("user_id") % 4 == 1) | (c("event_id") % 5 == 0)
    d = v.gps.where("true").select("user_id", "event_id", F.when(odd, c("lon")).otherwise(c("lat")).alias("lat"), F.when(odd, c("lat")).otherwise(c("lon")).alias("lon"))
    return labels.repair_tracks(d, "user_id", (29.0, 34.2, 34.5, 36.0)).select("event_id", "lat", "lon")


@query("pf5_accuracy", "SELECT event_id FROM v_gps WHERE accuracy <= 100")
def _(v):
    return v.gps.where(c("accuracy") <= 100).select("event_id")


@query("pf6_exclude", "SELECT user_id FROM v_demo WHERE user_id NOT IN (3, 5, 8) AND NOT raw_id ILIKE '%12%'")
def _(v):
    return v.demo.where(~c("user_id").isin(3, 5, 8) & ~c("raw_id").ilike("%12%")).select("user_id")


@query("pf7_recode", "SELECT user_id, CASE gender_raw WHEN 'F' THEN 'female' WHEN 'M' THEN 'male' ELSE 'other' END AS gender, CASE centre_raw WHEN 'Yes' THEN 1 WHEN 'No' THEN 0 END AS centre FROM v_demo")
def _(v):
    return v.demo.select("user_id", labels.recode(c("gender_raw"), {"F": "female", "M": "male"}, F.lit("other")).alias("gender"), labels.recode(c("centre_raw"), {"Yes": 1, "No": 0}).alias("centre"))


@query("pf8_flags", "SELECT event_id, travel_mode IN ('AT', 'PT', 'Walking') AS is_moving, place IN ('Home', '~Home') AS is_home, lower(place) LIKE '%home%' OR lower(place) LIKE '%house%' AS looks_home FROM v_points")
def _(v):
    return v.points.select("event_id", c("travel_mode").isin("AT", "PT", "Walking").alias("is_moving"), c("place").isin("Home", "~Home").alias("is_home"), labels.contains_any(c("place"), ("Home", "House")).alias("looks_home"))


@query("pf9_quality_gate", "SELECT user_id, date, n_events >= 3 AND n_types >= 2 AND total_value >= 50 AS passes FROM v_daily")
def _(v):
    return v.daily.select("user_id", "date", ((c("n_events") >= 3) & (c("n_types") >= 2) & (c("total_value") >= 50)).alias("passes"))


@query("pf10_drop_zero", "SELECT event_id, score FROM v_stress WHERE score <> 0")
def _(v):
    return v.stress.where("score <> 0").select("event_id", "score")


@query("pf11_high_low", "SELECT user_id, date, CASE WHEN total_value > (SELECT median(total_value) FROM v_daily) THEN 'high' ELSE 'low' END AS level FROM v_daily")
def _(v):
    return labels.high_low(v.daily, "total_value", "level").select("user_id", "date", "level")


@query("pf12_stars", "SELECT event_id, CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' WHEN p < 0.1 THEN '†' ELSE '' END AS stars FROM (SELECT event_id, (event_id % 200) / 1000.0::DOUBLE AS p FROM v_gps)")
def _(v):
    return v.gps.select("event_id", labels.stars((c("event_id") % 200) / F.lit(1000.0), trend=True).alias("stars"))


@query("pf13_effect_words", "SELECT event_id, CASE WHEN r < 0.1 THEN 'Negligible' WHEN r < 0.3 THEN 'Small' WHEN r < 0.5 THEN 'Medium' ELSE 'Large' END AS words FROM (SELECT event_id, abs((event_id % 200) - 100) / 100.0::DOUBLE AS r FROM v_gps)")
def _(v):
    return v.gps.select("event_id", labels.effect_words(((c("event_id") % 200) - 100) / F.lit(100.0)).alias("words"))


@query("pf14_data_quality", "SELECT user_id, CAST(ts AS DATE) AS date, CASE WHEN bool_or(hour(ts) < 12) AND bool_or(hour(ts) >= 17) AND epoch_us(max(ts)) - epoch_us(min(ts)) >= 5 * 3600000000 THEN 'good' ELSE 'partial' END AS data_quality FROM v_screen GROUP BY user_id, CAST(ts AS DATE)")
def _(v):
    q = v.screen.groupBy("user_id", "date").agg(F.bool_or(F.hour("ts") < 12).alias("m"), F.bool_or(F.hour("ts") >= 17).alias("e"), (times.micros(F.max("ts")) - times.micros(F.min("ts"))).alias("us"))
    return q.select("user_id", "date", F.when(c("m") & c("e") & (c("us") >= 5 * 3_600_000_000), "good").otherwise("partial").alias("data_quality"))


@query("pf15_mean_sd", "SELECT source, printf('%.2f (%.2f)', avg(total_value), stddev_samp(total_value)) AS text FROM v_daily GROUP BY source")
def _(v):
    return v.daily.groupBy("source").agg(labels.mean_sd(F.avg("total_value"), F.stddev_samp("total_value")).alias("text"))


@query("pf16_every_kth", "WITH n AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM v_points) SELECT user_id, event_id FROM n WHERE n <= 60 OR i % 4 = 0")
def _(v):
    return labels.every_kth(v.points, ["user_id"], ["ts", "event_id"], 4, 60).select("user_id", "event_id")
