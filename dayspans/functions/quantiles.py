"""Exact quantiles of a whole table, or of each of its groups, without gathering their values in one task."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Accuracy of the sketch that brackets a quantile, and the width of the bracket on either side, above its error.
ACCURACY, MARGIN = 10_000, 2e-4
#: Values of a group that are ranked as they are; groups up to which a row per group is broadcast.
SMALL, GROUPS = 50_000, 50_000


def exact_percentiles(df: DataFrame, column: str, shares: list[float]) -> list[float | None]:
    """Interpolated quantiles of a column, null values left out; None without any value.

    A first pass brackets each quantile by a sketch; a second one counts what lies below the brackets and the values
    inside them, about two in a thousand rows, among which the wanted ranks are found. If a bracket misses its ranks,
    it is widened to all values, so the result is exact whatever the sketch says.
    """
    d = df.select(F.col(column).cast("double").alias("x")).where("x is not null and not isnan(x)")
    ask = [F.percentile_approx("x", F.array(*[F.lit(min(max(p + sign * MARGIN, 0.0), 1.0)) for p in shares]), ACCURACY) for sign in (-1, 1)]
    n, lows, highs = d.agg(F.count("*"), *ask).first()
    if not n:
        return [None] * len(shares)
    ranks = [(math.floor(p * (n - 1)), math.ceil(p * (n - 1))) for p in shares]
    for low, high in ((lows, highs), ([-math.inf] * len(shares), [math.inf] * len(shares))):
        below = d.agg(*[F.count_if(F.col("x") < F.lit(v)) for v in low]).first()
        inside = F.filter(F.array(*[F.when(F.col("x").between(F.lit(a), F.lit(b)), i) for i, (a, b) in enumerate(zip(low, high))]), lambda v: v.isNotNull())
        counts = d.select("x", F.explode(inside).alias("i")).groupBy("i", "x").agg(F.count("*").alias("n"))
        upto = F.sum("n").over(Window.partitionBy("i").orderBy("x")) + F.array(*[F.lit(v) for v in below])[F.col("i")]
        wanted = counts.withColumn("upto", upto).where(" or ".join(f"(i = {i} and ((upto > {r} and upto - n <= {r})))" for i, own in enumerate(ranks) for r in set(own)))
        found = wanted.collect()  # a row or two per quantile
        at = lambda i, r: next((v["x"] for v in found if v["i"] == i and v["upto"] - v["n"] <= r < v["upto"]), None)
        ends = [(at(i, a), at(i, b)) for i, (a, b) in enumerate(ranks)]
        if all(x is not None for own in ends for x in own):
            break
    return [a + (b - a) * (p * (n - 1) - math.floor(p * (n - 1))) for p, (a, b) in zip(shares, ends)]


def group_percentiles(df: DataFrame, keys: list[str], column: str, shares: list[float], into: str = "quantiles") -> DataFrame:
    """Per group, the keys and in ``into`` an array of the interpolated quantiles of a column, null values left out.

    One sketch per group brackets each quantile of a group of more than SMALL values; a smaller one is ranked as it is. The
    values inside the brackets, about two in a thousand, are counted, and their ranks found by a window per group and
    bracket, after what lies below. So no group's values meet in one task. Null keys are a group; groups without values are
    left out. A bracket that should miss its ranks, which its width excludes, is an error, never a wrong value.
    """
    d = df.select(*keys, F.col(column).cast("double").alias("x")).where("x is not null and not isnan(x)")
    ask = [F.percentile_approx("x", F.array(*[F.lit(min(max(p + sign * MARGIN, 0.0), 1.0)) for p in shares]), ACCURACY) for sign in (-1, 1)]
    own = d.groupBy(*keys).agg(F.count("*").alias("all"), ask[0].alias("low"), ask[1].alias("high"))
    every = lambda v: F.array(*[F.lit(v)] * len(shares))
    small = F.col("all") <= SMALL
    own = own.withColumns({"low": F.when(small, every(-math.inf)).otherwise(F.col("low")), "high": F.when(small, every(math.inf)).otherwise(F.col("high"))})
    own = own.select(F.struct(*keys).alias("group"), "all", "low", "high")
    few = F.broadcast if d.select(*keys).distinct().count() <= GROUPS else lambda t: t
    rows = d.select(F.struct(*keys).alias("of"), "x").join(few(own), F.col("of").eqNullSafe(F.col("group")))
    inside = F.filter(F.sequence(F.lit(0), F.lit(len(shares) - 1)), lambda i: F.col("x").between(F.col("low")[i], F.col("high")[i]))
    below = rows.groupBy("group").agg(*[F.count_if(F.col("x") < F.col("low")[i]).alias(f"b{i}") for i in range(len(shares))])
    counts = rows.select("group", "all", "x", F.explode(inside).alias("i")).groupBy("group", "all", "i", "x").agg(F.count("*").alias("n"))
    below = below.select(F.col("group").alias("of"), F.array(*[f"b{i}" for i in range(len(shares))]).alias("below"))
    upto = F.sum("n").over(Window.partitionBy("group", "i").orderBy("x")) + F.col("below")[F.col("i")]
    ranked = counts.join(few(below), F.col("group").eqNullSafe(F.col("of"))).withColumn("upto", upto)
    share = F.array(*[F.lit(p) for p in shares])[F.col("i")]
    at = share * (F.col("all") - 1)
    value = lambda r: F.max(F.when((F.col("upto") > r) & (F.col("upto") - F.col("n") <= r), F.col("x")))
    found = ranked.groupBy("group", "i").agg(value(F.floor(at)).alias("a"), value(F.ceil(at)).alias("b"), F.first(at - F.floor(at)).alias("part"))
    found = found.withColumn("q", F.when(F.col("a").isNull() | F.col("b").isNull(), F.raise_error(F.lit("a bracket missed its ranks"))).otherwise(F.col("a") + (F.col("b") - F.col("a")) * F.col("part")))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("i", "q"))), lambda s: s["q"])
    return found.groupBy("group").agg(ordered.alias(into)).select("group.*", into)
