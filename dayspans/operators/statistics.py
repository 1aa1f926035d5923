"""Statistics from distributed aggregates: one grouped pass gives the moments, the rest is arithmetic on few rows."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Steps of the continued fraction; far more than it needs for statistics in use.
STEPS = 200
#: Levels of a factor, at most.
LEVELS = 200
#: Blocks of rows whose sums are taken apart, and rounds at most in which a solution is refined.
BLOCKS, REFINE = 1024, 6
#: Share of a term's squares about its mean below which it does not vary, and of correlations' singular values that count as 0.
STILL, SINGULAR = 1e-14, 1e-12
#: Trial values of the variance ratio in one round, rounds, and the log ratio's width at which the search has converged.
TRIALS, ROUNDS, CONVERGED = 12, 12, 1e-6
#: How far on either side of the best trial its slope is looked at, in log ratio, and halvings between.
NEAR, HALVINGS = 0.1, 60


def log_gamma(x: Column) -> Column:
    """Stirling's series, after moving x above 10."""
    y = x + 10
    shift = F.aggregate(F.sequence(F.lit(0), F.lit(9)), F.lit(0.0), lambda a, i: a + F.log(x + i))
    r = 1 / y
    return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + r / 12 - F.pow(r, 3) / 360 + F.pow(r, 5) / 1260 - F.pow(r, 7) / 1680 - shift


def incomplete_beta(x: Column, a: Column, b: Column) -> Column:
    """Regularised incomplete beta function as a column expression (Lentz's continued fraction)."""

    def half(x, a, b):
        front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.log(x) + b * F.log(1 - x)) / a
        tiny = 1e-300
        safe = lambda v: F.when(F.abs(v) < tiny, tiny).otherwise(v)
        d0 = 1 / safe(1 - (a + b) * x / (a + 1))
        first = F.struct(F.lit(1.0).alias("c"), d0.alias("d"), d0.alias("h"))

        def step(s, m):
            m = m.cast("double")
            e = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
            o = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))

            def move(s, k):
                return F.transform(F.array(F.struct((1 / safe(1 + k * s["d"])).alias("d"), safe(1 + k / s["c"]).alias("c"))), lambda t: F.struct(t["c"].alias("c"), t["d"].alias("d"), (s["h"] * t["c"] * t["d"]).alias("h")))[0]

            return F.transform(F.array(move(s, e)), lambda t: move(t, o))[0]

        return front * F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), first, step, lambda s: s["h"])

    mid = (a + 1) / (a + b + 2)
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).when(x < mid, half(x, a, b)).otherwise(1 - half(1 - x, b, a))


def t_p(t: Column, df: Column) -> Column:
    """Two-sided p of Student's t."""
    return incomplete_beta(df / (df + t * t), df / 2, F.lit(0.5))


def f_p(f: Column, d1: Column, d2: Column) -> Column:
    """Upper tail of F."""
    return incomplete_beta(d2 / (d2 + d1 * f), d2 / 2, d1 / 2)


def grouped_moments(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Count, mean and both variances per key; the base of every test."""
    return df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.var_samp(value).alias("var"), F.var_pop(value).alias("var0"))


def two_groups(df: DataFrame, keys: list[str], group: str, value: str) -> DataFrame:
    """One row per key with the moments of its first two groups in order of their names, as g1_*, g2_*."""
    m = grouped_moments(df.where(F.col(group).isNotNull()), [*keys, group], value).where("n > 0")
    w = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy(group)
    r = m.withColumn("_r", F.row_number().over(w)).where("_r <= 2")
    one = lambda i, c: F.max(F.when(F.col("_r") == i, F.col(c))).alias(f"g{i}_{c}")
    agg = [one(i, c) for i in (1, 2) for c in ("n", "mean", "var", "var0")] + [one(i, group).alias(f"g{i}") for i in (1, 2)]
    return (r.groupBy(*keys) if keys else r.groupBy()).agg(*agg)


def student(df: DataFrame, keys: list[str], group: str, value: str) -> DataFrame:
    """ST1: t of equal variances and Cohen's d with population variances, signed."""
    g = two_groups(df, keys, group, value)
    n1, n2 = F.col("g1_n"), F.col("g2_n")
    pooled = ((n1 - 1) * F.col("g1_var") + (n2 - 1) * F.col("g2_var")) / (n1 + n2 - 2)
    diff = F.col("g1_mean") - F.col("g2_mean")
    return g.withColumns({"t": diff / F.sqrt(pooled * (1 / n1 + 1 / n2)), "df": (n1 + n2 - 2).cast("double"), "d": diff / F.sqrt((F.col("g1_var0") + F.col("g2_var0")) / 2)}).withColumn("p", t_p(F.col("t"), F.col("df")))


def welch(df: DataFrame, keys: list[str], group: str, value: str, min_n: int = 5) -> DataFrame:
    """ST3, ST4: Welch's t with its degrees of freedom and the absolute pooled d; groups below ``min_n`` are not tested."""
    g = two_groups(df, keys, group, value).where((F.col("g1_n") >= min_n) & (F.col("g2_n") >= min_n))
    n1, n2 = F.col("g1_n"), F.col("g2_n")
    a, b = F.col("g1_var") / n1, F.col("g2_var") / n2
    diff = F.col("g1_mean") - F.col("g2_mean")
    pooled = F.sqrt(((n1 - 1) * F.col("g1_var") + (n2 - 1) * F.col("g2_var")) / (n1 + n2 - 2))
    return g.withColumns({"t": diff / F.sqrt(a + b), "df": F.pow(a + b, 2) / (a * a / (n1 - 1) + b * b / (n2 - 1)), "d": F.abs(diff) / pooled, "se": F.sqrt(a + b)}).withColumn("p", t_p(F.col("t"), F.col("df")))


def t_quantile(p: Column, df: Column) -> Column:
    """ST4: the t that leaves ``1 - p`` above it, by bisection on the same tail; meant for few rows of results."""
    first = F.struct(F.lit(0.0).alias("lo"), F.lit(1e4).alias("hi"))

    def step(s, _):
        mid = (s["lo"] + s["hi"]) / 2
        low = 1 - t_p(mid, df) / 2 < p
        return F.struct(F.when(low, mid).otherwise(s["lo"]).alias("lo"), F.when(low, s["hi"]).otherwise(mid).alias("hi"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(60)), first, step, lambda s: (s["lo"] + s["hi"]) / 2)


def mean_difference(df: DataFrame, keys: list[str], group: str, value: str, level: float = 0.95, min_n: int = 3) -> DataFrame:
    """ST4: Welch's test with the difference of the means and its confidence interval."""
    w = welch(df, keys, group, value, min_n).withColumn("diff", F.col("g1_mean") - F.col("g2_mean"))
    half = F.col("se") * t_quantile(F.lit((1 + level) / 2), F.col("df"))
    return w.withColumns({"low": F.col("diff") - half, "high": F.col("diff") + half})


def beta(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function of plain numbers."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta(1 - x, b, a)
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1))
    h = d
    for m in range(1, STEPS + 1):
        for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / (1 + k * d), 1 + k / c
            h *= c * d
    return h * math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) / a


def anova(df: DataFrame, keys: list[str], group: str, value: str) -> DataFrame:
    """ST2: one-way F, its degrees of freedom, eta squared and p."""
    m = grouped_moments(df.where(F.col(group).isNotNull()), [*keys, group], value).where("n > 0")
    g = (m.groupBy(*keys) if keys else m.groupBy()).agg(F.count("*").alias("k"), F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("grand"), F.sum(F.col("n") * F.col("mean") * F.col("mean")).alias("q"), F.sum(F.col("n") * F.col("var0")).alias("ssw"))
    g = g.withColumn("ssb", F.col("q") - F.col("n") * F.col("grand") * F.col("grand"))
    d1, d2 = (F.col("k") - 1).cast("double"), (F.col("n") - F.col("k")).cast("double")
    g = g.withColumns({"f": (F.col("ssb") / d1) / (F.col("ssw") / d2), "df1": d1, "df2": d2, "eta2": F.col("ssb") / (F.col("ssb") + F.col("ssw"))})
    return g.withColumn("p", f_p(F.col("f"), F.col("df1"), F.col("df2"))).drop("grand", "q")


def pearson(df: DataFrame, pairs: list[tuple[str, str]], keys: list[str] | None = None, min_n: int = 5) -> DataFrame:
    """ST7: r, n, t and p of pairs of columns over the rows that have both, all in one pass."""
    both = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y")) for a, b in pairs]))
    long = df.select(*(keys or []), both.alias("v")).select(*(keys or []), "v.*").where("x is not null and y is not null")
    g = long.groupBy(*(keys or []), "a", "b").agg(F.corr("x", "y").alias("r"), F.count("*").alias("n")).where(F.col("n") >= min_n)
    n = F.col("n").cast("double")
    g = g.withColumn("t", F.col("r") * F.sqrt((n - 2) / F.when(F.abs("r") < 1, 1 - F.col("r") * F.col("r"))))
    return g.withColumn("p", t_p(F.col("t"), n - 2))


def simple_slopes(df: DataFrame, level: str, x: str, y: str, min_n: int = 10) -> DataFrame:
    """ST17: slope, intercept and slope's standard error of y on x per level."""
    g = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(level).agg(F.count("*").alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_sxx(y, x).alias("sxx"), F.regr_syy(y, x).alias("syy"), F.regr_sxy(y, x).alias("sxy")).where(F.col("n") >= min_n)
    rss = F.col("syy") - F.col("slope") * F.col("sxy")
    return g.withColumn("se", F.sqrt(rss / (F.col("n") - 2) / F.col("sxx"))).select(level, "n", "slope", "intercept", "se")


def normal_sums(df: DataFrame, y: str, xs: list[str], keys: list[str] | None = None) -> DataFrame:
    """X'X (upper triangle), X'y and y'y of complete rows, with an intercept, per key: the data that OLS and REML need."""
    names = ["_1", *xs]
    d = df.dropna(subset=[y, *xs]).withColumn("_1", F.lit(1.0))
    agg = [F.sum(F.col(a).cast("double") * F.col(b).cast("double")).alias(f"x{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if j >= i]
    agg += [F.sum(F.col(a).cast("double") * F.col(y).cast("double")).alias(f"y{i}") for i, a in enumerate(names)] + [F.sum(F.col(y).cast("double") * F.col(y).cast("double")).alias("yy")]
    return (d.groupBy(*keys) if keys else d.groupBy()).agg(*agg)


def model_sums(df: DataFrame, models: dict[str, tuple[str, list[str]]]) -> dict[str, tuple]:
    """(X'X, X'y, y'y) of each model's complete rows, all models in one pass.

    A row goes once to the sums of those that lack the same columns, whatever the number of models; a model adds up those
    that lack none of its own. Sums are taken per block of rows and then over blocks, which keeps their last digits.
    """
    names = ["", *dict.fromkeys(c for y, xs in models.values() for c in (*xs, y))]  # the first is the intercept
    at = {c: i for i, c in enumerate(names)}
    pairs = sorted({(min(i, j), max(i, j)) for y, xs in models.values() for own in [[0, *(at[c] for c in (*xs, y))]] for i in own for j in own})
    d = df.select(F.lit(1.0).alias("v0"), *[F.col(c).cast("double").alias(f"v{at[c]}") for c in names[1:]])
    there = lambda y, xs: reduce(Column.__and__, [F.col(f"v{at[c]}").isNotNull() for c in (*xs, y)])
    some = reduce(Column.__or__, [there(y, xs) for y, xs in models.values()])
    lacks = F.concat(*[F.when(F.col(f"v{i}").isNull(), "1").otherwise("0") for i in range(len(names))])
    d = d.where(some).withColumns({"lacks": lacks, "block": F.monotonically_increasing_id() % BLOCKS})
    blocks = d.groupBy("lacks", "block").agg(*[F.sum(F.col(f"v{i}") * F.col(f"v{j}")).alias(f"s{i}_{j}") for i, j in pairs])
    found = blocks.groupBy("lacks").agg(*[F.sum(f"s{i}_{j}").alias(f"s{i}_{j}") for i, j in pairs]).collect()  # a row per set of absent columns
    out = {}
    for m, (y, xs) in models.items():
        own = [0, *(at[c] for c in xs)]
        rows = [r for r in found if all(r["lacks"][i] == "0" for i in (*own, at[y]))]
        total = lambda i, j: math.fsum(r[f"s{min(i, j)}_{max(i, j)}"] for r in rows)  # noqa: E731, B023
        if rows:
            out[m] = np.array([[total(i, j) for j in own] for i in own]), np.array([total(i, at[y]) for i in own]), total(at[y], at[y])
    return out


def solved(a: np.ndarray, b: np.ndarray, yy: float) -> tuple:
    """(inverse of X'X, coefficients, squares left, squares about the mean), of which the first term is the intercept.

    The sums are centred and scaled in long doubles, and the solution is refined by what it leaves as far as that helps:
    values far from zero beside their deviations keep their digits. A term that does not vary gets 0, as a doubled one
    gets its share.
    """
    n, wide = a[0, 0], a.astype(np.longdouble)
    mean, high = wide[0, 1:] / n, np.longdouble(b[0]) / n
    c, d, tss = wide[1:, 1:] - n * np.outer(mean, mean), b[1:] - n * mean * high, yy - n * high * high
    varies = np.diag(c) > STILL * np.diag(wide)[1:]
    scale = np.where(varies, 1 / np.sqrt(np.where(varies, np.diag(c), 1)), 0)
    c, d = c * np.outer(scale, scale), d * scale
    inv = np.linalg.pinv(c.astype(float), rcond=SINGULAR, hermitian=True)
    x, left = np.zeros_like(d), d
    for _ in range(REFINE):
        y = x + inv @ left
        rest = d - c @ y
        if not np.abs(rest).max(initial=0) < np.abs(left).max(initial=0):
            break
        x, left = y, rest
    own, coef = inv * np.outer(scale, scale), x * scale
    side = own @ mean
    whole = np.block([[np.array([[1 / n + mean @ side]]), -side[None, :]], [-side[:, None], own]])
    return whole.astype(float), np.array([high - mean @ coef, *coef], float), float(max(tss - x @ d, 0)), float(tss)


OLS = "term string, coef double, se double, t double, p double, n long, r2 double, adj_r2 double, aic double, bic double, f double"


def ols_rows(terms: list[str], a: np.ndarray, b: np.ndarray, yy: float, min_n: int) -> list[tuple]:
    """A row per term of one model, from its sums."""
    k, n = len(terms), a[0, 0]
    if n < max(min_n, k + 1):
        return []
    inv, coef, rss, tss = solved(a, b, yy)
    se = np.sqrt(np.maximum(np.diag(inv) * rss / (n - k), 0))
    r2 = 1 - rss / tss if tss > 0 else 0.0
    ll = -n / 2 * (math.log(2 * math.pi) + math.log(max(rss, 1e-300) / n) + 1)
    f = float((r2 / (k - 1)) / ((1 - r2) / (n - k))) if k > 1 and r2 < 1 else None
    rows = []
    for i, term in enumerate(terms):
        t = float(coef[i] / se[i]) if se[i] > 0 else None
        rows.append((term, float(coef[i]), float(se[i]), t, None if t is None else tail(t, n - k), int(n), float(r2), float(1 - (1 - r2) * (n - 1) / (n - k)), float(2 * k - 2 * ll), float(k * math.log(n) - 2 * ll), f))
    return rows


def tail(t: float, df: float) -> float:
    """Two-sided p of Student's t, of plain numbers."""
    return float(beta(float(df / (df + t * t)), df / 2, 0.5))


def ols(df: DataFrame, y: str, xs: list[str], min_n: int = 10) -> DataFrame:
    """ST9: least squares from one pass of sums; a row per term with coef, se, t, p, and the model's r2, adj_r2, aic, bic, f.

    Rows with a null in y or any term are left out; fewer than ``min_n`` rows give no result.
    """
    found = model_sums(df, {"m": (y, xs)})
    return df.sparkSession.createDataFrame(ols_rows(["intercept", *xs], *found["m"], min_n) if found else [], OLS)


TESTS = "factor string, df1 double, df2 double, f double, p double"


def factor_model(df: DataFrame, y: str, xs: list[str], factors: dict[str, str | None], min_n: int = 10) -> tuple[DataFrame, DataFrame]:
    """ST9: least squares with categorical terms: the terms' rows as of ``ols``, and an F test per factor and of the whole model.

    A factor's levels are those of the complete rows, in order of their names; each but the reference (the first, if none
    is given) gets a 0/1 term named factor[level]. A factor of one level adds none. One pass finds the levels, one the
    cross products of all terms; more than LEVELS levels are an error. The F of a factor tests all its terms at once.
    """
    spark, d = df.sparkSession, df.dropna(subset=[y, *xs, *factors])
    level = lambda f: F.col(f).cast("string")
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("factor"), level(f).alias("level")) for f in factors]))
    found = d.select(each.alias("l")).select("l.*").distinct().orderBy("factor", "level").limit(LEVELS * len(factors) + 1).collect() if factors else []
    levels = {f: [r["level"] for r in found if r["factor"] == f] for f in factors}
    terms: dict[str, list[str]] = {}
    for f, reference in factors.items():
        if len(levels[f]) > LEVELS or len(found) > LEVELS * len(factors):
            raise ValueError(f"factor {f} has more than {LEVELS} levels")
        if reference is not None and levels[f] and reference not in levels[f]:
            raise ValueError(f"factor {f} has no level {reference}")
        terms[f] = [v for v in levels[f] if v != (reference if reference is not None else levels[f][0])]
    coded = [(f"{f}[{v}]", (level(f) == v).cast("double")) for f, own in terms.items() for v in own]
    d = d.select(F.col(y).cast("double").alias("y"), *[F.col(x).cast("double").alias(f"x{i}") for i, x in enumerate(xs)], *[c.alias(f"t{i}") for i, (_, c) in enumerate(coded)])
    sums = model_sums(d, {"m": ("y", d.columns[1:])})
    names = ["intercept", *xs, *[n for n, _ in coded]]
    rows = ols_rows(names, *sums["m"], min_n) if sums else []
    if not rows:
        return spark.createDataFrame([], OLS), spark.createDataFrame([], TESTS)
    a, b, yy = sums["m"]
    n, k = a[0, 0], np.linalg.matrix_rank(a)
    inv, coef, rss, _ = solved(a, b, yy)
    s2 = rss / (n - k)
    tests = []
    for name, own in [*terms.items(), ("model", names[1:])]:
        at = [names.index(f"{name}[{v}]" if name != "model" else v) for v in own]
        block = inv[np.ix_(at, at)] if at else np.zeros((0, 0))
        q = int(np.linalg.matrix_rank(block)) if at else 0
        if q and s2 > 0:
            f = float(coef[at] @ np.linalg.pinv(block) @ coef[at] / q / s2)
            tests.append((name, float(q), float(n - k), f, float(beta((n - k) / (n - k + q * f), (n - k) / 2, q / 2))))
    return spark.createDataFrame(rows, OLS), spark.createDataFrame(tests, TESTS)


def nested_models(df: DataFrame, outcomes: list[str], predictors: dict[str, list[list[str]]], min_n: int = 10) -> DataFrame:
    """ST10: for every outcome and predictor the models of growing lists of terms, a block of rows per step.

    ``predictors``: name -> terms that each step adds. All models come from one pass; each leaves out its own incomplete rows.
    """
    models = {}
    for y in outcomes:
        for name, steps in predictors.items():
            for i in range(len(steps)):
                models[f"{y}~{name}~{i + 1}"] = y, [t for s in steps[: i + 1] for t in s]
    found, rows = model_sums(df, models), []
    for m, (y, xs) in models.items():
        if m in found:
            name, step = m.split("~")[1:]
            rows += [(y, name, int(step), *r) for r in ols_rows(["intercept", *xs], *found[m], min_n)]
    return df.sparkSession.createDataFrame(rows, "outcome string, predictor string, step int, " + OLS)


def random_intercept(df: DataFrame, y: str, xs: list[str], group: str) -> DataFrame:
    """ST13, ST14: linear mixed model with a random intercept per group, by REML.

    Spark makes each group's sums and adds up the groups of one size, for the profile in theta = group variance /
    residual variance needs no more; the search over theta is arithmetic on those few rows (as many as group sizes). A row
    per term: coef, se, z, p (normal), p_t (Student's t), and the model's variances, icc, share of variance explained by
    the fixed part alone (marginal_r2) and with the groups (conditional_r2), ll, aic, bic, n, n_groups, converged.
    """
    k, s = len(xs) + 1, lambda i: F.col(f"x0_{i}")
    g = normal_sums(df, y, xs, [group])
    agg = [F.count("*").alias("m"), F.sum("yy").alias("yy"), F.sum(F.col("y0") * F.col("y0")).alias("q")]
    agg += [F.sum(f"x{i}_{j}").alias(f"a{i}_{j}") for i in range(k) for j in range(i, k)] + [F.sum(s(i) * s(j)).alias(f"s{i}_{j}") for i in range(k) for j in range(i, k)]
    agg += [F.sum(f"y{i}").alias(f"b{i}") for i in range(k)] + [F.sum(s(i) * F.col("y0")).alias(f"c{i}") for i in range(k)]
    sizes = g.groupBy(F.col("x0_0").alias("size")).agg(*agg).toPandas().sort_values("size")
    schema = "term string, coef double, se double, z double, p double, p_t double, group_var double, residual_var double, icc double, marginal_r2 double, conditional_r2 double, ll double, aic double, bic double, n long, n_groups long, converged boolean"
    square = lambda x: np.stack([[sizes[f"{x}{min(i, j)}_{max(i, j)}"].to_numpy(float) for j in range(k)] for i in range(k)])
    if not len(sizes) or (sizes["size"] * sizes["m"]).sum() <= k:
        return df.sparkSession.createDataFrame([], schema)
    size, m, a_all, s_all = sizes["size"].to_numpy(float), sizes["m"].to_numpy(float), square("a"), square("s")
    b_all, c_all = (np.stack([sizes[f"{x}{i}"].to_numpy(float) for i in range(k)]) for x in "bc")
    n = float((size * m).sum())

    def profile(theta: float) -> tuple:
        """(ll, coef, s2, X'V^-1X) for V = I + theta J."""
        w = theta / (1 + size * theta)
        a, b = (a_all - w * s_all).sum(2), (b_all - w * c_all).sum(1)
        coef = np.linalg.solve(a, b)
        s2 = max(((sizes["yy"] - w * sizes["q"]).sum() - coef @ b) / (n - k), 1e-300)
        return -0.5 * ((n - k) * (math.log(2 * math.pi * s2) + 1) + (m * np.log(1 + size * theta)).sum() + np.linalg.slogdet(a)[1]), coef, s2, a

    def slope(theta: float) -> float:
        """Slope of the profile in theta."""
        _, coef, s2, a = profile(theta)
        w = 1 / (1 + size * theta) ** 2
        ds = (w * s_all).sum(2)
        drop = (w * sizes["q"]).sum() - 2 * coef @ (w * c_all).sum(1) + coef @ ds @ coef  # squares of the groups' sums less the fixed part
        return 0.5 * (drop / s2 - (m * size / (1 + size * theta)).sum() + np.trace(np.linalg.solve(a, ds)))

    lo, hi = -12.0, 8.0  # the profile has one top: narrow in on it, on the scale of log theta
    for _ in range(ROUNDS):
        trial = np.linspace(lo, hi, TRIALS)
        top = int(np.argmax([profile(math.exp(x))[0] for x in trial]))
        lo, hi, theta = trial[max(top - 1, 0)], trial[min(top + 1, TRIALS - 1)], math.exp(trial[top])
    # near its top the profile is flat within rounding, so the last digits come from where its slope changes sign
    low, high = max(math.log(theta) - NEAR, -12.0), min(math.log(theta) + NEAR, 8.0)
    if slope(math.exp(low)) > 0 > slope(math.exp(high)):
        for _ in range(HALVINGS):
            mid = (low + high) / 2
            low, high = (mid, high) if slope(math.exp(mid)) > 0 else (low, mid)
        theta = math.exp((low + high) / 2)
    best, zero = profile(theta), profile(0.0)
    if zero[0] >= best[0]:
        theta, best = 0.0, zero
    ll, coef, s2, a = best
    se, groups, p = np.sqrt(np.diag(np.linalg.inv(a)) * s2), int(m.sum()), k + 2
    plain = a_all.sum(2)
    fixed = max(float(coef @ plain @ coef / n - (plain[0] @ coef / n) ** 2), 0.0)
    total = fixed + theta * s2 + s2
    shared = (float(theta * s2), float(s2), float(theta / (1 + theta)), float(fixed / total), float((fixed + theta * s2) / total), float(ll), float(2 * p - 2 * ll), float(p * math.log(n) - 2 * ll), int(n), groups, bool(theta == 0 or hi - lo < CONVERGED * 10))
    rows = [(t, float(c), float(e), float(c / e), math.erfc(abs(c / e) / math.sqrt(2)), tail(float(c / e), n - k), *shared) for t, c, e in zip(["intercept", *xs], coef, se)]
    return df.sparkSession.createDataFrame(rows, schema)


def anova_icc(df: DataFrame, y: str, group: str) -> DataFrame:
    """ST14: variance components of groups and rows from the mean squares, and the share of the groups (ICC).

    One row: n, n_groups, n0 (the groups' size that unequal ones amount to), ms_between, ms_within, group_var (0 if
    negative), residual_var, icc. Two passes of sums: per group, then over all groups; nothing is collected.
    """
    g = df.where(F.col(y).isNotNull() & F.col(group).isNotNull()).groupBy(group).agg(F.count(y).alias("m"), F.avg(y).alias("mean"), F.var_pop(y).alias("var"))
    m, mean = F.col("m"), F.col("mean")
    t = g.agg(F.sum("m").alias("n"), F.count("*").alias("n_groups"), F.sum(m * m).alias("mm"), F.sum(m * mean).alias("s"), F.sum(m * mean * mean).alias("ss"), F.sum(m * F.col("var")).alias("within"))
    n, k = F.col("n"), F.col("n_groups")
    t = t.where((k > 1) & (n > k)).withColumns({"n0": (n - F.col("mm") / n) / (k - 1), "ms_between": (F.col("ss") - F.col("s") * F.col("s") / n) / (k - 1), "ms_within": F.col("within") / (n - k)})
    t = t.withColumns({"group_var": F.greatest((F.col("ms_between") - F.col("ms_within")) / F.col("n0"), F.lit(0.0)), "residual_var": F.col("ms_within")})
    return t.select("n", "n_groups", "n0", "ms_between", "ms_within", "group_var", "residual_var", (F.col("group_var") / (F.col("group_var") + F.col("residual_var"))).alias("icc"))


def slope_bands(df: DataFrame, level: str, x: str, y: str, points: int = 20, confidence: float = 0.95, min_n: int = 10) -> DataFrame:
    """ST17: per level the line of y on x at ``points`` evenly spaced x from its least to its greatest, with the confidence
    band of the line: fit, low and high, by its standard error there and the t quantile of n - 2."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    g = both.groupBy(level).agg(F.count("*").alias("n"), F.avg(F.col(x).cast("double")).alias("mean"), F.min(F.col(x).cast("double")).alias("lo"), F.max(F.col(x).cast("double")).alias("hi"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_sxx(y, x).alias("sxx"), F.regr_syy(y, x).alias("syy"), F.regr_sxy(y, x).alias("sxy")).where((F.col("n") >= min_n) & (F.col("sxx") > 0))
    s2 = F.greatest(F.col("syy") - F.col("slope") * F.col("sxy"), F.lit(0.0)) / (F.col("n") - 2)
    g = g.withColumns({"s2": s2, "t": t_quantile(F.lit((1 + confidence) / 2), (F.col("n") - 2).cast("double"))})
    g = g.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn("x", F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("i") / (points - 1))
    half = F.col("t") * F.sqrt(F.col("s2") * (1 / F.col("n") + F.pow(F.col("x") - F.col("mean"), 2) / F.col("sxx")))
    fit = F.col("intercept") + F.col("slope") * F.col("x")
    return g.select(level, "i", "x", fit.alias("fit"), (fit - half).alias("low"), (fit + half).alias("high"))


def within_between(df: DataFrame, x: str, group: str, category: str) -> tuple[DataFrame, list[str]]:
    """ST12, ST15: the group's mean of x less the grand mean, x less the group's mean, a 0/1 category, and its products with both."""
    grand = df.agg(F.avg(x).alias("_g"))
    own = F.avg(x).over(Window.partitionBy(group))
    d = df.withColumn("_m", own).crossJoin(F.broadcast(grand)).withColumns({f"{x}_between": F.col("_m") - F.col("_g"), f"{x}_within": F.col(x) - F.col("_m")}).drop("_m", "_g")
    d = d.withColumns({f"{category}_x_between": F.col(category) * F.col(f"{x}_between"), f"{category}_x_within": F.col(category) * F.col(f"{x}_within")})
    return d, [f"{x}_between", f"{x}_within", category, f"{category}_x_between", f"{category}_x_within"]


def article_table(models: dict[str, DataFrame]) -> DataFrame:
    """ST16: parameters as rows, outcomes as columns: coefficient with stars and (standard error), then the model's measures."""
    out = None
    for name, m in models.items():
        stars = F.when(F.col("p_t") < 0.001, "***").when(F.col("p_t") < 0.01, "**").when(F.col("p_t") < 0.05, "*").otherwise("")
        terms = m.select("term", F.concat(F.format_string("%.3f", "coef"), stars, F.format_string(" (%.3f)", "se")).alias("value"))
        measures = ["group_var", "residual_var", "icc", "marginal_r2", "conditional_r2", "ll", "aic", "bic"]
        fits = m.where("term = 'intercept'").select(F.explode(F.array(*[F.struct(F.lit(x).alias("term"), F.format_string("%.3f", x).alias("value")) for x in measures])).alias("f")).select("f.*")
        own = terms.unionByName(fits).withColumn("outcome", F.lit(name))
        out = own if out is None else out.unionByName(own)
    return out.groupBy(F.col("term").alias("parameter")).pivot("outcome", list(models)).agg(F.first("value"))


def model_diagnostics(df: DataFrame, columns: list[str], group: str, r: float = 0.7, least_var: float = 1e-6) -> DataFrame:
    """ST19: pairs of columns that correlate above ``r`` either way, and columns whose group means hardly vary."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    one = df.agg(*[F.corr(a, b).alias(f"r{i}") for i, (a, b) in enumerate(pairs)]) if pairs else None
    means = df.groupBy(group).agg(*[F.avg(x).alias(x) for x in columns]).agg(*[F.var_samp(x).alias(x) for x in columns])
    low = means.select(F.explode(F.array(*[F.struct(F.lit("between_variance").alias("kind"), F.lit(x).alias("a"), F.lit(None).cast("string").alias("b"), F.col(x).alias("value"), (F.col(x) < least_var).alias("flagged")) for x in columns])).alias("d")).select("d.*")
    if one is None:
        return low
    high = one.select(F.explode(F.array(*[F.struct(F.lit("correlation").alias("kind"), F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{i}").alias("value"), (F.abs(f"r{i}") > r).alias("flagged")) for i, (a, b) in enumerate(pairs)])).alias("d")).select("d.*")
    return high.unionByName(low)


def check_standardisation(df: DataFrame, key: str, column: str, tolerance: float = 0.1, population: float = 0.01) -> DataFrame:
    """ST21: keys of more than one row whose mean is not about 0 or whose deviation is not about 1, and all rows as one key,
    null, held to the narrower ``population`` limits."""
    g = df.groupingSets([[key], []], key).agg(F.grouping(key).alias("_all"), F.count(column).alias("n"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("sd"))
    limit = F.when(F.col("_all") == 1, population).otherwise(tolerance)
    out = g.where((F.col("n") > 1) & ((F.abs("mean") > limit) | (F.abs(F.col("sd") - 1) > limit)))
    return out.withColumn("level", F.when(F.col("_all") == 1, "population").otherwise("participant")).drop("_all")
