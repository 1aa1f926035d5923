"""Questionnaires: recoding, reverse scoring, scales, z-scores, summaries and completeness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Codes of the two non-monotone answer formats, for five and four points.
TRAFFIC_5, TRAFFIC_4 = {"1": "4", "2": "3", "3": "2", "4": "2", "5": "1"}, {"1": "4", "2": "3", "3": "2", "4": "1"}
CALM_5, CALM_4 = {"1": "3", "2": "1", "3": "2", "4": "4", "5": "5"}, {"1": "3", "2": "1", "3": "2", "4": "4"}


def question_key(c: Column) -> Column:
    """QN1: slashes and question marks off, double spaces as one, trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, "[/?]", ""), " {2,}", " "))


def as_map(text: Column) -> Column:
    return F.from_json(text, "map<string,string>")


def reverse_codes(m: Column, points: Column) -> Column:
    """QN2: label -> points - code + 1."""
    return F.transform_values(m, lambda k, v: (points - v.cast("int") + 1).cast("string"))


def by_code(m: Column) -> Column:
    """SO3: the map's entries in order of their codes."""
    return F.array_sort(F.map_entries(m), lambda a, b: a["value"].cast("int") - b["value"].cast("int"))


def reversed_map(m: Column) -> Column:
    """QN8: code -> label."""
    return F.map_from_entries(F.transform(F.map_entries(m), lambda e: F.struct(e["value"], e["key"])))


def reverse_scale(x: Column, top: int) -> Column:
    """QN3: top + 1 - x where x is a number, else as it was."""
    return F.when(x.rlike("^[0-9]+$"), (top + 1 - x.try_cast("int")).cast("string")).otherwise(x)


def map_codes(x: Column, codes: dict[str, str], keep: bool = False) -> Column:
    """QN4: through the map; what it lacks becomes null, or stays."""
    m = F.create_map(*[F.lit(v) for kv in codes.items() for v in kv])
    hit = F.try_element_at(m, x)
    return F.coalesce(hit, x) if keep else hit


def in_range(x: Column, lo: float, hi: float) -> Column:
    """QN9: values of the scale's range, others null."""
    return F.when(x.between(lo, hi), x)


def zscore(df: DataFrame, column: str, keys: list[str], into: str, ddof: int = 1, flat: Column | None = None) -> DataFrame:
    """QN11, QN12, WN4, WN5: by the mean and deviation of each key (of all rows without keys); without spread ``flat``, 0 if not given."""
    if keys:
        w = Window.partitionBy(*keys)
        mean, sd, d = F.avg(column).over(w), (F.stddev_samp if ddof else F.stddev_pop)(column).over(w), df
    else:
        stats = df.agg(F.avg(column).alias("_m"), (F.stddev_samp if ddof else F.stddev_pop)(column).alias("_s"))
        d, mean, sd = df.crossJoin(F.broadcast(stats)), F.col("_m"), F.col("_s")
    z = F.when(F.coalesce(sd, F.lit(0.0)) == 0, F.when(F.col(column).isNotNull(), F.lit(0.0) if flat is None else flat)).otherwise((F.col(column) - mean) / F.when(sd != 0, sd))
    return d.withColumn(into, z).drop("_m", "_s")


def row_mean(*items: Column) -> Column:
    """QN16: mean of the items that are there."""
    there = F.filter(F.array(*[i.cast("double") for i in items]), lambda x: x.isNotNull())
    return F.when(F.size(there) > 0, F.aggregate(there, F.lit(0.0), lambda a, x: a + x) / F.size(there))


def canonical_name(name: Column, part: str, canonical: str) -> Column:
    """QN5: every name that contains ``part`` becomes ``canonical``."""
    return F.when(name.contains(part), canonical).otherwise(name)


def form_labels(name: Column, form: Column, forms: tuple[str, ...], names: dict[str, str]) -> Column:
    """QN5: names of the ``forms`` (found in the form's text) go through the map, what it lacks becomes null; others stay."""
    own = form.contains(forms[0])
    for f in forms[1:]:
        own = own | form.contains(f)
    return F.when(own, map_codes(name, names)).otherwise(name)


def scale_summary(df: DataFrame, key: str) -> DataFrame:
    """QN14: by scale, and by scale and variable, in one pass. ``df``: response, scored (reversed where due), z, variable, date."""
    out = [F.count("*").alias("n"), F.count("response").alias("n_valid"), F.countDistinct("variable").alias("n_vars"), F.countDistinct("date").alias("n_days"), F.min("date").alias("first_date"), F.max("date").alias("last_date")]
    for x, name in (("response", "raw"), ("scored", "reversed"), ("z", "z")):
        out += [(F.round(F.avg(x), 6) + 0.0).alias(f"{name}_mean"), F.round(F.stddev_samp(x), 6).alias(f"{name}_sd")]
    return df.groupingSets([[key, "scale"], [key, "scale", "variable"]], key, "scale", "variable").agg(*out)


def daily_scales(df: DataFrame, keys: list[str], scales: list[str]) -> DataFrame:
    """QN15: per day the mean scored and z value of each scale, and the responses behind it."""
    out = []
    for s in scales:
        own = F.col("scale") == s
        out += [F.round(F.avg(F.when(own, F.col("scored"))), 6).alias(f"{s}_reversed"), F.round(F.avg(F.when(own, F.col("z"))), 6).alias(f"{s}_z"), F.count(F.when(own, F.col("scored"))).alias(f"{s}_n")]
    return df.groupBy(*keys).agg(*out)


def valid_days(first: DataFrame, second: DataFrame, key: str, days: range, least: int = 3) -> DataFrame:
    """AG15: a day is valid where both matrices together have ``least`` entries or more; per participant a boolean for
    each day, the valid days and their share of all days, and whether there is any entry."""
    names = [f"Day_{d}" for d in days]
    both = first.select(key, *names).unionByName(second.select(key, *names)).groupBy(key).agg(*[F.sum(n).alias(n) for n in names])
    total = sum((F.when(F.col(n) >= least, 1).otherwise(0) for n in names), F.lit(0))
    entries = sum((F.col(n) for n in names), F.lit(0))
    return both.select(key, *[(F.col(n) >= least).alias(f"Valid_{d}") for n, d in zip(names, days)], total.alias("valid_days"), F.round(total * 100.0 / len(names), 6).alias("pct_valid"), (entries > 0).alias("active"))


def valid_counts(valid: DataFrame, days: range) -> DataFrame:
    """AG15: per day the participants for whom it is valid, as a share of all and of those with any entry."""
    one = valid.agg(F.count("*").alias("n_all"), F.count_if("active").alias("n_active"), *[F.count_if(f"Valid_{d}").alias(f"v{d}") for d in days])
    rows = F.explode(F.array(*[F.struct(F.lit(d).alias("day"), F.col(f"v{d}").alias("n_valid")) for d in days])).alias("r")
    share = lambda of: F.round(F.col("r.n_valid") * 100.0 / F.nullif(F.col(of), F.lit(0)), 6)
    return one.select("n_all", "n_active", rows).select("r.day", "r.n_valid", share("n_all").alias("pct_all"), share("n_active").alias("pct_active"))


def completeness_matrix(df: DataFrame, keys: list[str], day: str, what: str, days: range) -> DataFrame:
    """AG14: per participant (and scale) the distinct ``what`` of each study day, and their total.

    Distinct per day first, so that one count per day is left to add up.
    """
    once = df.where(F.col(what).isNotNull()).select(*keys, F.col(day).alias("_day"), what).distinct().groupBy(*keys, "_day").agg(F.count("*").alias("_n"))
    cols = [F.coalesce(F.sum(F.when(F.col("_day") == d, F.col("_n"))), F.lit(0)).alias(f"Day_{d}") for d in days]
    m = df.select(*keys).distinct().join(once, keys, "left").groupBy(*keys).agg(*cols)
    return m.withColumn("Total", sum((F.col(f"Day_{d}") for d in days), F.lit(0)))
