"""Episodes: half-open intervals of a state, in microseconds since 1970 (start_us, end_us), with their keys.

All are windows and joins on the keys (a user, or a user's day), so a plan shuffles once per key and never leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.times import micros
from .track import probe_location

MINUTE, DAY = 60_000_000, 86_400_000_000


def day_us(date: Column) -> Column:
    return F.unix_date(date).cast("long") * DAY


def drop_rapid_toggles(df: DataFrame, keys: list[str], seconds: float = 3) -> DataFrame:
    """EP2: an OFF within ``seconds`` of the ON right before it removes both. ``df``: us, is_on, event_id."""
    w = Window.partitionBy(*keys).orderBy("us", "event_id")
    off = ~F.col("is_on") & F.lag("is_on").over(w) & (F.col("us") - F.lag("us").over(w) < seconds * 1_000_000)
    d = df.withColumn("_off", F.coalesce(off, F.lit(False)))
    return d.withColumn("_on", F.coalesce(F.lead("_off").over(w), F.lit(False))).where("not _off and not _on").drop("_off", "_on")


def pair_events(df: DataFrame, keys: list[str], end_of_key: Column | None = None) -> DataFrame:
    """EP1: the first ON opens, the next OFF closes, repeats count nothing; an open one ends at ``end_of_key``. ``df``: us, is_on, event_id."""
    w = Window.partitionBy(*keys).orderBy("us", "event_id")
    d = df.withColumn("_was", F.lag("is_on").over(w)).where(F.col("_was").isNull() | (F.col("_was") != F.col("is_on")))
    d = d.withColumn("end_us", F.lead("us").over(w)).where("is_on")
    d = d.withColumn("end_us", F.coalesce("end_us", end_of_key) if end_of_key is not None else F.col("end_us"))
    return d.select(*keys, F.col("us").alias("start_us"), "end_us")


def runs_to_episodes(df: DataFrame, keys: list[str], on: Column, min_minutes: float = 0) -> DataFrame:
    """EP4, EP5: runs where ``on`` holds, from the first such row to the first other one; an open run ends at the key's last row."""
    w = Window.partitionBy(*keys).orderBy("us", "event_id")
    d = df.withColumn("_on", F.coalesce(on, F.lit(False))).withColumn("_last", F.max("us").over(Window.partitionBy(*keys)))
    d = d.withColumn("_was", F.lag("_on").over(w)).where(F.col("_was").isNull() | (F.col("_was") != F.col("_on")))
    d = d.withColumn("end_us", F.coalesce(F.lead("us").over(w), "_last")).where("_on")
    return d.select(*keys, F.col("us").alias("start_us"), "end_us").where(F.col("end_us") - F.col("start_us") >= min_minutes * MINUTE)


def marked_episodes(df: DataFrame, keys: list[str], starts: Column, stays: Column, stops: Column, min_seconds: float = 20) -> DataFrame:
    """EP3: a start mark sets the start (again, if one is set), an active row sets it if none is, a stop mark or an inactive
    row clears it and emits; an open one ends at the key's last row."""
    w = Window.partitionBy(*keys).orderBy("us", "event_id")
    d = df.withColumns({"_s": F.coalesce(starts, F.lit(False)), "_x": F.coalesce(stops, F.lit(False)) | (~F.coalesce(stays, F.lit(False)) & ~F.coalesce(starts, F.lit(False))), "_last": F.max("us").over(Window.partitionBy(*keys))})
    d = d.withColumn("_seg", F.coalesce(F.sum(F.col("_x").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    g = d.groupBy(*keys, "_seg").agg(F.max(F.when(F.col("_s") & ~F.col("_x"), F.col("us"))).alias("mark"), F.min(F.when(~F.col("_x"), F.col("us"))).alias("first"), F.max(F.when(F.col("_x"), F.col("us"))).alias("stop"), F.max("_last").alias("last"))
    e = g.select(*keys, F.coalesce("mark", "first").alias("start_us"), F.coalesce("stop", "last").alias("end_us"))
    return e.where(F.col("start_us").isNotNull() & (F.col("end_us") - F.col("start_us") >= min_seconds * 1_000_000))


def merge_intervals(df: DataFrame, keys: list[str], gap_us: int = 0) -> DataFrame:
    """EP6: intervals no more than ``gap_us`` apart become one; n_merged counts them."""
    w = Window.partitionBy(*keys).orderBy("start_us", "end_us")
    reach = F.max("end_us").over(w.rowsBetween(Window.unboundedPreceding, -1))
    d = df.withColumn("_new", F.coalesce(F.col("start_us") - reach > gap_us, F.lit(True)).cast("int"))
    d = d.withColumn("_g", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.groupBy(*keys, "_g").agg(F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"), F.count("*").alias("n_merged")).drop("_g")


def intersect_intervals(a: DataFrame, b: DataFrame, keys: list[str], min_us: int = 0, carry: tuple[str, ...] = ()) -> DataFrame:
    """EP7, EP8: what intervals of both sides have in common, if longer than nothing and at least ``min_us``; with the columns
    of ``a`` and those of ``b`` in ``carry``."""
    o = b.select(*keys, F.col("start_us").alias("_s"), F.col("end_us").alias("_e"), *carry)
    j = a.join(o, keys).where((F.col("start_us") < F.col("_e")) & (F.col("_s") < F.col("end_us")))
    j = j.withColumns({"start_us": F.greatest("start_us", "_s"), "end_us": F.least("end_us", "_e")}).drop("_s", "_e")
    return j.where((F.col("end_us") > F.col("start_us")) & (F.col("end_us") - F.col("start_us") >= min_us))


def majority_transport(episodes: DataFrame, points: DataFrame, keys: list[str], active: Column, mechanised: Column) -> DataFrame:
    """EP9: active if strictly more points are, else mechanised if any is, else none."""
    us = points.select(*keys, "us", active.cast("int").alias("_a"), mechanised.cast("int").alias("_m"))
    e = episodes.join(us, keys, "left")
    inside = (F.col("us") >= F.col("start_us")) & (F.col("us") <= F.col("end_us"))
    g = e.groupBy(*keys, "start_us", "end_us").agg(F.sum(F.when(inside, F.col("_a")).otherwise(0)).alias("a"), F.sum(F.when(inside, F.col("_m")).otherwise(0)).alias("m"))
    return g.select(*keys, "start_us", "end_us", F.when(F.col("a") > F.col("m"), "active").when(F.col("m") > 0, "mechanised").otherwise("none").alias("transport"))


def clip_to_waking(df: DataFrame, waking_hour: int = 5) -> DataFrame:
    """EP10: what lies in the 24 hours from ``waking_hour`` on of the day it starts; ``df`` has date."""
    lo = day_us(F.col("date")) + waking_hour * 60 * MINUTE
    d = df.withColumns({"start_us": F.greatest("start_us", lo), "end_us": F.least("end_us", lo + DAY)})
    return d.where("end_us > start_us")


def dominant_label(episodes: DataFrame, places: DataFrame, keys: list[str], label: str = "home") -> DataFrame:
    """EP11: ``label`` only if the episode overlaps such places strictly longer than others; out is the default."""
    p = places.select(*keys, F.col("start_us").alias("_s"), F.col("end_us").alias("_e"), "place")
    j = episodes.join(p, keys, "left")
    over = F.greatest(F.least("end_us", "_e") - F.greatest("start_us", "_s"), F.lit(0))
    g = j.groupBy(*keys, "start_us", "end_us").agg(F.sum(F.when(F.col("place") == label, over).otherwise(0)).alias("own"), F.sum(F.when(F.col("place") != label, over).otherwise(0)).alias("other"))
    return g.select(*keys, "start_us", "end_us", F.when(F.col("own") > F.col("other"), label).otherwise("out_of_home").alias("location_type"))


def fill_day(stays: DataFrame, keys: list[str], fixes: DataFrame | None = None, minutes: int = 30) -> DataFrame:
    """EP12: a whole day's timeline from its labelled stays (``place``): clipped to the day, the first gap takes the first
    label, the last gap the last, and a gap between what GE18 finds at its start from ``fixes`` (user_id, date, us, near);
    without fixes it takes the label of the stay before it. ``keys`` are user_id and date."""
    lo = day_us(F.col("date"))
    s = stays.withColumns({"start_us": F.greatest("start_us", lo), "end_us": F.least("end_us", lo + DAY)}).where("end_us > start_us")
    w = Window.partitionBy(*keys).orderBy("start_us", "end_us")
    s = s.withColumns({"_next": F.lead("start_us").over(w), "_first": F.row_number().over(w) == 1})
    own = s.select(*keys, "start_us", "end_us", "place", F.lit("stay").alias("kind"))
    before = s.where(F.col("_first") & (F.col("start_us") > lo)).select(*keys, lo.alias("start_us"), F.col("start_us").alias("end_us"), "place", F.lit("gap").alias("kind"))
    stop = F.coalesce("_next", lo + DAY)
    after = s.where(stop > F.col("end_us")).select(*keys, F.col("end_us").alias("start_us"), stop.alias("end_us"), "place", F.lit("gap").alias("kind"), F.col("_next").isNull().alias("_last"))
    if fixes is not None:
        inner = after.where("not _last")
        asked = inner.select(*keys, F.col("start_us").alias("at_us")).distinct()
        found = probe_location(asked, fixes, minutes).withColumnsRenamed({"at_us": "start_us", "location_type": "_found"})
        after = after.join(found, [*keys, "start_us"], "left").withColumn("place", F.when(F.col("_last"), F.col("place")).otherwise(F.col("_found"))).drop("_found")
    return own.unionByName(before).unionByName(after.select(*own.columns))


def hourly_default(days: DataFrame, fixes: DataFrame, minutes: int = 30) -> DataFrame:
    """EP13: an hour is home if a fix within ``minutes`` of it is. ``fixes``: user_id, date, us, near.

    Each fix goes to the hours of its date that it is close to, one row is left per hour, and days join by the hour.
    """
    at = F.col("us") - day_us(F.col("date"))
    first = F.greatest(F.floor((at - F.lit((60 + minutes) * MINUTE)) / F.lit(60 * MINUTE)) + 1, F.lit(0))
    last = F.least(F.floor((at + F.lit(minutes * MINUTE)) / F.lit(60 * MINUTE)), F.lit(23))
    f = fixes.withColumns({"_first": first.cast("int"), "_last": last.cast("int")}).where("us is not null and _first <= _last")
    f = f.withColumn("hour", F.explode(F.sequence("_first", "_last"))).groupBy("user_id", "date", "hour").agg(F.max("near").alias("n"))
    h = days.select("user_id", "date").distinct().withColumn("hour", F.explode(F.sequence(F.lit(0), F.lit(23))))
    g = h.join(f, ["user_id", "date", "hour"], "left")
    return g.select("user_id", "date", "hour", F.when(F.coalesce("n", F.lit(False)), "home").otherwise("out_of_home").alias("location_type"))


def timeline(parts: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """EP15: episodes of several types in one order, numbered, with the time since the one before began."""
    typed = [d.withColumn("episode_type", F.lit(t)) for t, d in parts.items()]
    out = typed[0]
    for d in typed[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy("start_us", "end_us", "episode_type")
    return out.withColumns({"episode_number": F.row_number().over(w), "since_prev_us": F.col("start_us") - F.lag("start_us").over(w)})


def day_statistics(episodes: DataFrame, keys: list[str], groups: dict[str, Column]) -> DataFrame:
    """EP16: per key the episodes and minutes of each named group, such as a type, a transport or a type at a location."""
    us = F.col("end_us") - F.col("start_us")
    out = []
    for name, own in groups.items():
        own = F.coalesce(own, F.lit(False))
        out += [F.count_if(own).alias(f"{name}_episodes"), F.round(F.sum(F.when(own, us).otherwise(0)) / MINUTE, 8).alias(f"{name}_minutes")]
    return episodes.groupBy(*keys).agg(*out)


def participant_summary(days: DataFrame, key: str, methods: list[str], least: int) -> DataFrame:
    """EP17: per participant days, valid ones (``n`` of at least ``least``), their share, mean ``n``, and days by ``method``."""
    valid = F.col("n") >= least
    by = [F.count_if(F.col("method") == m).alias(f"{m}_days") for m in methods]
    return days.groupBy(key).agg(F.count("*").alias("days"), F.count_if(valid).alias("valid_days"), F.round(F.avg(F.when(valid, 100.0).otherwise(0.0)), 6).alias("pct_valid"), F.round(F.avg("n"), 6).alias("mean_episodes"), *by)


def day_grid(sources: dict[str, DataFrame], key: str) -> DataFrame:
    """EP19: every day of a participant from its first to its last in any source, and which sources have it."""
    keys = None
    for name, d in sources.items():
        own = d.select(key, "date", F.lit(name).alias("source")).distinct()
        keys = own if keys is None else keys.unionByName(own)
    span = keys.groupBy(key).agg(F.min("date").alias("a"), F.max("date").alias("b"))
    grid = span.select(key, F.explode(F.sequence("a", "b")).alias("date"))
    flags = [F.coalesce(F.max(F.col("source") == name), F.lit(False)).alias(f"has_{name}") for name in sources]
    return grid.join(keys, [key, "date"], "left").groupBy(key, "date").agg(*flags)


def episode_summary(episodes: DataFrame, keys: list[str]) -> DataFrame:
    """EP18: per key and type number, total, mean and median minutes, first start and last end."""
    us = F.col("end_us") - F.col("start_us")
    return episodes.groupBy(*keys, "episode_type").agg(F.count("*").alias("num_episodes"), F.round(F.sum(us) / MINUTE, 8).alias("total_minutes"), F.round(F.sum(us) / F.count("*") / MINUTE, 10).alias("mean_minutes"), F.round(F.percentile(us, F.lit(0.5)) / MINUTE, 10).alias("median_minutes"), F.min("start_us").alias("first_us"), F.max("end_us").alias("last_us"))


def screen_events(screen: DataFrame, on: str = "ON", off: str = "OFF") -> DataFrame:
    """The ON and OFF events of a screen log: user_id, date, us, is_on, event_id."""
    a = F.upper("action")
    return screen.where(a.contains(on) | a.contains(off)).select("user_id", "date", micros(F.col("ts")).alias("us"), (~a.contains(off)).alias("is_on"), "event_id")
