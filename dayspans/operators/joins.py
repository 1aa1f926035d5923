"""Joins on tolerant keys, with reports of what did not match."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY = 86_400_000_000


def key_coverage(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """JN1: distinct keys on the left, on the right, and on both sides."""
    l, r = left.select(*keys).distinct().withColumn("_l", F.lit(1)), right.select(*keys).distinct().withColumn("_r", F.lit(1))
    j = l.join(r, keys, "full_outer")
    return j.agg(F.count("_l").alias("n_left"), F.count("_r").alias("n_right"), F.count_if(F.col("_l").isNotNull() & F.col("_r").isNotNull()).alias("n_common"))


def offset_join(left: DataFrame, right: DataFrame, key: str, date: str, offsets: tuple[int, ...] = (0, -1, 1)) -> DataFrame:
    """JN3: per left row the matches of the first day offset that has any; adds day_offset. Left rows without a match go."""
    ranked = F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(o).alias("day_offset")) for i, o in enumerate(offsets)])
    l = left.withColumn("_row", F.struct(*left.columns)).withColumn("_o", F.explode(ranked)).withColumn("_d", F.date_add(date, F.col("_o.day_offset")))
    r = right.withColumnsRenamed({key: "_k", date: "_rd"})
    j = l.join(r, (F.col(key) == F.col("_k")) & (F.col("_d") == F.col("_rd")))
    first = F.min("_o.rank").over(Window.partitionBy("_row"))
    return j.withColumn("_first", first).where(F.col("_o.rank") == F.col("_first")).withColumn("day_offset", F.col("_o.day_offset")).drop("_row", "_o", "_d", "_k", "_rd", "_first")


def priority_join(left: DataFrame, right: DataFrame, key: str, date: str, swapped: Column, order: list) -> DataFrame:
    """JN4: the right row of the same date, else of the date with day and month exchanged; the first in ``order`` per key.

    Adds match_type (exact, swapped, none) and matching_date; right columns are null without a match.
    """
    w = Window.partitionBy(key, date).orderBy(*order)
    r = right.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    values = [c for c in right.columns if c not in (key, date)]
    one = lambda tag: r.select(F.col(key).alias(f"_k{tag}"), F.col(date).alias(f"_d{tag}"), F.struct(*values).alias(f"_v{tag}"))
    j = left.withColumn("_s", swapped).join(one(1), (F.col(key) == F.col("_k1")) & (F.col(date) == F.col("_d1")), "left").join(one(2), (F.col(key) == F.col("_k2")) & (F.col("_s") == F.col("_d2")), "left")
    kind = F.when(F.col("_k1").isNotNull(), "exact").when(F.col("_k2").isNotNull(), "swapped").otherwise("none")
    v = F.when(F.col("_k1").isNotNull(), F.col("_v1")).otherwise(F.col("_v2"))
    return j.select(*left.columns, kind.alias("match_type"), F.when(F.col("_k1").isNotNull(), F.col("_d1")).otherwise(F.col("_d2")).alias("matching_date"), *[v[c].alias(f"matched_{c}") for c in values])


def discard_reasons(left: DataFrame, right: DataFrame, key: str, date: str) -> DataFrame:
    """JN5: left rows without a match, and whether the participant or only the date is missing."""
    known = right.select(key).distinct().withColumn("_there", F.lit(True))
    lost = left.join(right.select(key, date).distinct(), [key, date], "left_anti").join(known, key, "left")
    return lost.withColumn("reason", F.when(F.col("_there"), "no_date").otherwise("no_participant")).drop("_there")


def outer_with_side(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """JN7: full outer join that says where a key came from: both, left_only or right_only."""
    j = left.withColumn("_l", F.lit(1)).join(right.withColumn("_r", F.lit(1)), keys, "full_outer")
    return j.withColumn("side", F.when(F.col("_l").isNull(), "right_only").when(F.col("_r").isNull(), "left_only").otherwise("both")).drop("_l", "_r")


def letters_only(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}]", ""))


def two_pass_lookup(df: DataFrame, text: Column, lookup: DataFrame, into: str) -> DataFrame:
    """JN10: by the trimmed text, else by its letters and digits only. ``lookup``: question, value, seq; the last of a key wins."""
    last = lambda k: lookup.groupBy(k.alias("_q")).agg(F.max_by("value", "seq").alias("_v"))
    d = df.withColumns({"_a": F.trim(text), "_b": letters_only(text)})
    one, two = last(F.trim("question")), last(letters_only(F.col("question"))).withColumnsRenamed({"_q": "_q2", "_v": "_v2"})
    j = d.join(one, F.col("_a") == F.col("_q"), "left").join(two, F.col("_b") == F.col("_q2"), "left")
    return j.withColumn(into, F.coalesce("_v", "_v2")).drop("_a", "_b", "_q", "_v", "_q2", "_v2")


def similar_texts(left: DataFrame, right: DataFrame, least: float = 0.8) -> DataFrame:
    """JN11: pairs of distinct short texts whose Levenshtein similarity (six digits) is at least ``least``, above 0.

    An operator of its own: a ratio of matching blocks, as other tools have it, lets other pairs pass the same limit.

    Two lengths allow k edits at most. Of k + 1 pieces of the right text one is then unedited, and stands in the left text
    shifted by no more than the edits before and after it allow. Texts meet by lengths and such a piece; no pair is lost.
    """
    n, m = F.col("_n"), F.col("_m")
    most = F.floor(F.greatest(n, m) * F.lit(1 - least + 5e-7) + F.lit(1e-9)).cast("int")
    start = lambda i: F.floor(i * m / (F.col("_k") + 1)).cast("int")

    def pieces(d: DataFrame, own: str, other: str) -> DataFrame:
        near = F.sequence(F.floor(F.col(own) * F.lit(least)).cast("int"), F.ceil(F.col(own) / F.lit(least)).cast("int"))
        d = d.withColumn(other, F.explode(near)).withColumn("_k", most).where(F.abs(n - m) <= F.col("_k"))
        d = d.withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_k"))))
        return d.withColumns({"_from": start(F.col("_i")), "_size": start(F.col("_i") + 1) - start(F.col("_i"))})

    distinct = lambda d, into, size: d.select(F.col(d.columns[0]).alias(into)).distinct().withColumn(size, F.length(into))
    l, r = pieces(distinct(left, "a", "_n"), "_n", "_m"), pieces(distinct(right, "b", "_m"), "_m", "_n")
    low = F.greatest(F.ceil((n - m - F.col("_k")) / 2).cast("int"), -F.col("_from"))
    high = F.least(F.floor((n - m + F.col("_k")) / 2).cast("int"), n - F.col("_size") - F.col("_from"))
    l = l.withColumns({"_low": low, "_high": high}).where("_low <= _high").withColumn("_at", F.explode(F.sequence("_low", "_high")))
    l = l.withColumn("_piece", F.substring("a", F.col("_from") + F.col("_at") + 1, F.col("_size")))
    r = r.withColumn("_piece", F.substring("b", F.col("_from") + 1, F.col("_size")))
    keys = ["_n", "_m", "_i", "_piece"]
    near = l.select("a", *keys).distinct().join(r.select("b", *keys), keys).select("a", "b").distinct()
    ratio = 1 - F.levenshtein("a", "b") / F.greatest(F.length("a"), F.length("b"), F.lit(1))
    return near.select("a", "b", F.round(ratio, 6).alias("similarity")).where(F.col("similarity") >= least)


def block_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the characters in matching blocks over all characters: the longest common block, and so on left and right of it."""
    return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype=float)


def matching_texts(left: DataFrame, right: DataFrame, least: float = 0.8) -> DataFrame:
    """JN11: pairs of distinct short texts whose ratio of matching blocks (six digits) is at least ``least``, above 0.

    The blocks are a common subsequence, so two lengths need so many characters in it, and leave so many out on either
    side. Of one piece more of the right text than are left out in all, one is whole and unbroken in the left text, shifted
    by no more than what is left out. Texts meet by lengths and such a piece, then by their counts of characters, which
    bound the ratio from above; only what is left is compared. No pair is lost, and no text meets all others.
    """
    n, m, k = F.col("_n"), F.col("_m"), F.col("_k")
    need = F.ceil(F.lit(least - 1e-6) * (n + m) / 2 - F.lit(1e-9)).cast("int")
    start = lambda i: F.floor(i * m / (k + 1)).cast("int")

    def pieces(d: DataFrame, own: str, other: str) -> DataFrame:
        low, high = F.floor(F.col(own) * F.lit(least / (2 - least))).cast("int"), F.ceil(F.col(own) * F.lit((2 - least) / least)).cast("int")
        d = d.withColumn(other, F.explode(F.sequence(low, high))).withColumn("_need", need).where(F.col("_need") <= F.least(n, m))
        d = d.withColumn("_k", n + m - 2 * F.col("_need")).withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_k"))))
        return d.withColumns({"_from": start(F.col("_i")), "_size": start(F.col("_i") + 1) - start(F.col("_i"))}).where((F.col("_size") > 0) | (m <= k))

    distinct = lambda d, into, size: d.select(F.col(d.columns[0]).alias(into)).where(F.col(into).isNotNull()).distinct().withColumn(size, F.length(into))
    l, r = pieces(distinct(left, "a", "_n"), "_n", "_m"), pieces(distinct(right, "b", "_m"), "_m", "_n")
    low, high = F.greatest(F.col("_from") - (m - F.col("_need")), F.lit(0)), F.least(F.col("_from") + (n - F.col("_need")), n - F.col("_size"))
    l = l.withColumns({"_low": low, "_high": high}).where("_low <= _high").withColumn("_at", F.explode(F.sequence("_low", "_high")))
    l = l.withColumn("_piece", F.substring("a", F.col("_at") + 1, F.col("_size")))
    r = r.withColumn("_piece", F.substring("b", F.col("_from") + 1, F.col("_size")))
    keys = ["_n", "_m", "_i", "_piece"]
    near = l.select("a", *keys, "_need").distinct().join(r.select("b", *keys), keys).select("a", "b", "_need").distinct()
    times = lambda text, letter: F.length(text) - F.length(F.replace(text, letter, F.lit("")))
    shared = F.aggregate(F.array_distinct(F.split("b", "")), F.lit(0), lambda t, x: t + F.when(x == "", 0).otherwise(F.least(times(F.col("a"), x), times(F.col("b"), x))))
    near = near.where(shared >= F.col("_need"))
    return near.select("a", "b", F.round(F.pandas_udf(block_ratio, "double")("a", "b"), 6).alias("similarity")).where(F.col("similarity") >= least)


def last_before(df: DataFrame, table: DataFrame, keys: list[str], ts: str, start: str, values: list[str], bucket_us: int = DAY) -> DataFrame:
    """TS5: every row with the ``values`` of the last row of ``table`` of its keys that starts at or before it, null if none does.

    Both sides meet in one window over their union, by keys and bucket of time. What a bucket begins with comes from a
    window over the buckets' last rows alone; so one key with a third of all rows is spread over its buckets, and there is
    no range join. Of rows of ``table`` that start at the same time, the one of the greatest values counts.
    """
    us, bucket = F.unix_micros(F.col(ts).cast("timestamp")), F.floor(F.col("_us") / F.lit(bucket_us))
    rows = df.select(F.struct(*df.columns).alias("_row"), *keys, us.alias("_us")).withColumn("_b", bucket)
    first = table.where(F.col(start).isNotNull()).select(*keys, F.unix_micros(F.col(start).cast("timestamp")).alias("_us"), F.struct(*values).alias("_v"))
    first = first.groupBy(*keys, "_us").agg(F.max("_v").alias("_v")).withColumn("_b", bucket)
    ends = first.groupBy(*keys, "_b").agg(F.max_by("_v", "_us").alias("_v"))
    buckets = rows.select(*keys, "_b").distinct().unionByName(ends, allowMissingColumns=True).groupBy(*keys, "_b").agg(F.max("_v").alias("_v"))
    before = F.last("_v", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    carried = buckets.select(*keys, "_b", before.alias("_v")).where("_v is not null").withColumn("_us", F.col("_b") * F.lit(bucket_us))
    both = rows.withColumn("_kind", F.lit(2)).unionByName(first.withColumn("_kind", F.lit(1)), allowMissingColumns=True).unionByName(carried.withColumn("_kind", F.lit(0)), allowMissingColumns=True)
    w = Window.partitionBy(*keys, "_b").orderBy("_us", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_v", F.last("_v", ignorenulls=True).over(w)).where("_kind = 2")
    return found.select("_row.*", "_v.*")


def spread_over(df: DataFrame, lo: str, hi: str, size: int, into: str = "_bucket") -> DataFrame:
    """A row for every bucket of ``size`` that the closed interval from ``lo`` to ``hi`` touches; none if it is empty."""
    bucket = lambda c: F.floor(F.col(c) / F.lit(size))
    return df.where(F.col(lo) <= F.col(hi)).withColumn(into, F.explode(F.sequence(bucket(lo), bucket(hi))))


def window_join(points: DataFrame, windows: DataFrame, keys: list[str], us: str, lo: str, hi: str, bucket_us: int = DAY) -> DataFrame:
    """JN13, JN16: points of the same keys from ``lo`` to ``hi``, both included.

    Windows go to the buckets of time that they touch, and points meet them by key and bucket, so no user's whole
    history meets all of its windows; choose ``bucket_us`` near the windows' usual length.
    """
    w = spread_over(windows, lo, hi, bucket_us)
    p = points.withColumn("_bucket", F.floor(F.col(us) / F.lit(bucket_us)))
    return p.join(w, [*keys, "_bucket"]).where((F.col(us) >= F.col(lo)) & (F.col(us) <= F.col(hi))).drop("_bucket")


def update_where(df: DataFrame, updates: DataFrame, keys: list[str], column: str) -> DataFrame:
    """JN14: the new value where there is one, else the old."""
    u = updates.select(*keys, F.col(column).alias("_new"))
    return df.join(u, keys, "left").withColumn(column, F.coalesce("_new", column)).drop("_new")
