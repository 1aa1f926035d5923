"""Missing values: tokens, sentinels, coercion, filling, rules and profiles. Missing is null everywhere; NaN never enters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKENS = ("Missing", "NA", "")
SENTINELS = (999, -999, 9999, -9999)


def tokens_to_null(c: Column, tokens=TOKENS) -> Column:
    """NM1."""
    return F.when(~c.isin(*tokens), c)


def to_number(c: Column) -> Column:
    """NM2: a number, or null where it is none."""
    return F.nanvl(c.try_cast("double"), F.lit(None).cast("double"))


def salvage_number(c: Column) -> Column:
    """NM3: as NM2, else what digits and points are left."""
    return F.coalesce(to_number(c), to_number(F.regexp_replace(c, "[^0-9.]", "")))


def sentinels_to_null(df: DataFrame, columns: list[str] | None = None, sentinels=SENTINELS) -> DataFrame:
    """NM4: sentinels of the named columns, or of all numeric ones, become null."""
    columns = columns or [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]
    return df.withColumns({c: F.when(~F.col(c).isin(*sentinels), F.col(c)) for c in columns})


def text_to_bool(c: Column) -> Column:
    """NM5."""
    return F.when(c == "True", True).when(c == "False", False)


def fill_with_mean(df: DataFrame, columns: list[str]) -> DataFrame:
    """NM7: nulls become the column's mean: one row of means, joined to all."""
    means = df.agg(*[F.avg(c).alias(f"_{c}") for c in columns])
    return df.crossJoin(F.broadcast(means)).withColumns({c: F.coalesce(F.col(c), F.col(f"_{c}")) for c in columns}).drop(*[f"_{c}" for c in columns])


def apply_rules(df: DataFrame, ranges: dict[str, tuple[float, float]], allowed: dict[str, tuple] | None = None) -> DataFrame:
    """NM9: numbers out of range and values not allowed become null; a missing required column is an error of the plan."""
    out = {c: F.when(F.col(c).between(lo, hi), F.col(c)) for c, (lo, hi) in ranges.items()}
    out |= {c: F.when(F.col(c).isin(*v), F.col(c)) for c, v in (allowed or {}).items()}
    return df.withColumns(out)


def rule_report(df: DataFrame, ranges: dict[str, tuple[float, float]], allowed: dict[str, tuple] | None = None) -> DataFrame:
    """NM9: one row with the number of violations of each rule."""
    bad = {c: ~F.col(c).between(lo, hi) for c, (lo, hi) in ranges.items()} | {c: ~F.col(c).isin(*v) for c, v in (allowed or {}).items()}
    return df.agg(*[F.count_if(v).alias(f"{c}_violations") for c, v in bad.items()])


def range_report(df: DataFrame, columns: list[str], lo: float, hi: float) -> DataFrame:
    """NM10: least and greatest value of each column and whether it leaves the range; nothing is changed."""
    long = df.unpivot([], columns, "variable", "value")
    return long.groupBy("variable").agg(F.min("value").alias("min_value"), F.max("value").alias("max_value")).withColumn("out_of_range", (F.col("min_value") < lo) | (F.col("max_value") > hi))


def null_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """NM11: per column the nulls and their share in per cent, in one pass."""
    one = df.agg(F.count("*").alias("n_rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return one.unpivot(["n_rows"], columns, "column", "n_null").withColumn("pct_null", F.round(F.expr("try_divide(100.0D * n_null, n_rows)"), 6))


def any_all_null(df: DataFrame, columns: list[str]) -> DataFrame:
    """NM11: rows with any and with all of the columns null."""
    nulls = [F.col(c).isNull().cast("int") for c in columns]
    return df.agg(F.count_if(F.greatest(*nulls) == 1).alias("any_null"), F.count_if(F.least(*nulls) == 1).alias("all_null"))


def completeness(df: DataFrame, key: str, column: str) -> DataFrame:
    """NM11: per key the share of rows where the column is there, in per cent."""
    return df.groupBy(key).agg(F.round(F.avg(F.when(F.col(column).isNotNull(), 100.0).otherwise(0.0)), 6).alias("pct_complete"))


def resolve_columns(df: DataFrame, wanted: dict[str, list[str]]) -> dict[str, str]:
    """NM13: canonical name -> column, by exact name first, then the first column that contains a pattern; metadata only."""
    names = {c.strip().lower(): c for c in df.columns}
    found = {}
    for want, patterns in wanted.items():
        hit = next((names[p] for p in patterns if p in names), None) or next((c for p in patterns for k, c in names.items() if p in k), None)
        if hit:
            found[want] = hit
    return found


def tidy_names(df: DataFrame) -> DataFrame:
    """NM14: names trimmed and in lower case, hyphens, spaces and brackets as underscores, unnamed columns dropped."""
    keep = [c for c in df.columns if not c.startswith("Unnamed")]
    return df.select(*keep).toDF(*[c.strip().lower().translate(str.maketrans("- ()", "____")) for c in keep])


def datetime_columns(df: DataFrame, terms: tuple[str, ...] = ("date", "time", "timestamp", "_at")) -> list[str]:
    """NM16: columns whose name has one of the terms."""
    return [c for c in df.columns if any(t in c.lower() for t in terms)]


def first_per(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in a total order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
