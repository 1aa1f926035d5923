"""Predicates, flags and labels as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import exact_percentiles

#: South, north, west and east of the study area.
BOX = (29.0, 34.0, 33.0, 36.0)


def on_earth(lat: Column, lon: Column) -> Column:
    """PF1: a coordinate that is there, not zero, and on the globe."""
    return lat.isNotNull() & lon.isNotNull() & (lat != 0) & (lon != 0) & lat.between(-90, 90) & lon.between(-180, 180)


def in_box(lat: Column, lon: Column, box=BOX, buffer: float = 0.0) -> Column:
    """PF2."""
    return lat.between(box[0] - buffer, box[1] + buffer) & lon.between(box[2] - buffer, box[3] + buffer)


def repair_swaps(df: DataFrame, box=BOX) -> DataFrame:
    """PF3: rows outside the box stay only if exchanging latitude and longitude brings them inside."""
    inside, swapped = in_box(F.col("lat"), F.col("lon"), box), in_box(F.col("lon"), F.col("lat"), box)
    return df.where(inside | swapped).withColumns({"lat": F.when(inside, F.col("lat")).otherwise(F.col("lon")), "lon": F.when(inside, F.col("lon")).otherwise(F.col("lat"))})


def repair_tracks(df: DataFrame, key: str, box=BOX) -> DataFrame:
    """PF4: a track mostly outside the box is exchanged as a whole if that brings more of it inside."""
    share = df.groupBy(key).agg(F.avg(in_box(F.col("lat"), F.col("lon"), box).cast("double")).alias("_in"), F.avg(in_box(F.col("lon"), F.col("lat"), box).cast("double")).alias("_swapped"))
    turn = (F.col("_in") < 0.5) & (F.col("_swapped") > F.col("_in"))
    return df.join(share, key).withColumns({"lat": F.when(turn, F.col("lon")).otherwise(F.col("lat")), "lon": F.when(turn, F.col("lat")).otherwise(F.col("lon"))}).drop("_in", "_swapped")


def recode(c: Column, mapping: dict, default: Column | None = None) -> Column:
    """PF7: value by value; what the map lacks becomes ``default``."""
    out = reduce(lambda acc, kv: acc.when(c == kv[0], kv[1]), list(mapping.items())[1:], F.when(c == next(iter(mapping)), next(iter(mapping.values()))))
    return out if default is None else out.otherwise(default)


def contains_any(c: Column, patterns: tuple[str, ...]) -> Column:
    """PF8: one of the patterns, whatever the case."""
    return reduce(lambda a, p: a | F.lower(c).contains(p.lower()), patterns[1:], F.lower(c).contains(patterns[0].lower()))


def high_low(df: DataFrame, column: str, into: str) -> DataFrame:
    """PF11: above the median high, else low; ties are low."""
    mid = F.lit(exact_percentiles(df, column, [0.5])[0]).cast("double")
    return df.withColumn(into, F.when(F.col(column) > mid, "high").when(F.col(column).isNotNull(), "low"))


def stars(p: Column, trend: bool = False) -> Column:
    """PF12."""
    out = F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*")
    return (out.when(p < 0.1, "†") if trend else out).otherwise("")


def effect_words(r: Column) -> Column:
    """PF13."""
    a = F.abs(r)
    return F.when(a < 0.1, "Negligible").when(a < 0.3, "Small").when(a < 0.5, "Medium").when(a.isNotNull(), "Large")


def short_number(c: Column) -> Column:
    """PF15: more digits for smaller numbers."""
    a = F.abs(c)
    fmt = lambda n: F.format_string(f"%.{n}f", c)
    return F.when((a >= 0.01) | (a == 0), fmt(3)).when(a >= 0.001, fmt(4)).when(a >= 0.0001, fmt(5)).when(a.isNotNull(), fmt(6))


def mean_sd(mean: Column, sd: Column) -> Column:
    """PF15: "M (SD)"."""
    return F.format_string("%.2f (%.2f)", mean, sd)


def every_kth(df: DataFrame, keys: list[str], order: list, k: int, above: int) -> DataFrame:
    """PF16: of keys with more than ``above`` rows every ``k``-th row in order."""
    w = Window.partitionBy(*keys)
    out = df.withColumns({"_n": F.row_number().over(w.orderBy(*order)) - 1, "_all": F.count("*").over(w)})
    return out.where((F.col("_all") <= above) | (F.col("_n") % k == 0)).drop("_n", "_all")
