"""Queries of the statistics operators. DuckDB has no tail functions: its p-values integrate the density of t."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import labels
from ..operators import fragmentation as fr
from ..operators import questionnaires as qn
from ..operators import statistics as st
from .registry import query

c = F.col


def r6(x, name):
    return F.round(x, 6).alias(name)


def tp(t: str, df: str) -> str:
    """SQL: two-sided p of Student's t by Simpson's rule."""
    inside = f"list_sum(list_transform(range(0, 2001), lambda i: (CASE WHEN i = 0 OR i = 2000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * pow(1 + pow(abs({t}) * i / 2000.0::DOUBLE, 2) / ({df}), -(({df}) + 1) / 2.0::DOUBLE)))"
    return f"greatest(0.0::DOUBLE, 1 - 2 * abs({t}) / 6000.0::DOUBLE * exp(lgamma((({df}) + 1) / 2.0::DOUBLE) - lgamma(({df}) / 2.0::DOUBLE)) / sqrt(({df}) * pi()) * {inside})"


JOINED = "(SELECT d.*, CASE gender_raw WHEN 'F' THEN 'female' WHEN 'M' THEN 'male' END AS gender, centre_raw, class_name FROM v_daily d JOIN v_demo m USING (user_id))"


def joined(v):
    gender = labels.recode(c("gender_raw"), {"F": "female", "M": "male"})
    return v.daily.join(v.demo.select("user_id", gender.alias("gender"), "centre_raw", "class_name"), "user_id")


def groups_sql(source: str, group: str, value: str, key: str = "") -> str:
    k = f"{key}, " if key else ""
    by = f"GROUP BY {key}" if key else ""
    return f"""mo AS (SELECT {k}{group} AS g, count({value}) AS n, avg({value}) AS mean, var_samp({value}) AS var, var_pop({value}) AS var0 FROM {source} WHERE {group} IS NOT NULL GROUP BY {k}{group}),
rk AS (SELECT *, row_number() OVER ({f'PARTITION BY {key} ' if key else ''}ORDER BY g) AS r FROM mo WHERE n > 0),
tw AS (SELECT {k}max(n) FILTER (WHERE r = 1) AS n1, max(n) FILTER (WHERE r = 2) AS n2, max(mean) FILTER (WHERE r = 1) AS m1, max(mean) FILTER (WHERE r = 2) AS m2, max(var) FILTER (WHERE r = 1) AS v1, max(var) FILTER (WHERE r = 2) AS v2, max(var0) FILTER (WHERE r = 1) AS p1, max(var0) FILTER (WHERE r = 2) AS p2 FROM rk {by})"""


WELCH = "n1, n2, round((m1 - m2) / sqrt(v1 / n1 + v2 / n2), 6) AS t, round(pow(v1 / n1 + v2 / n2, 2) / (pow(v1 / n1, 2) / (n1 - 1) + pow(v2 / n2, 2) / (n2 - 1)), 4) AS df, round(abs(m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)), 6) AS d"


def welch_columns(d, *keys):
    return d.select(*keys, c("g1_n").alias("n1"), c("g2_n").alias("n2"), r6(c("t"), "t"), F.round("df", 4).alias("df"), r6(c("d"), "d"))


@query("st1_student", f"WITH {groups_sql(JOINED, 'gender', 'total_value')} SELECT n1, n2, round((m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1.0::DOUBLE / n1 + 1.0::DOUBLE / n2)), 6) AS t, CAST(n1 + n2 - 2 AS DOUBLE) AS df, round((m1 - m2) / sqrt((p1 + p2) / 2), 6) AS d FROM tw")
def _(v):
    return st.student(joined(v), [], "gender", "total_value").select(c("g1_n").alias("n1"), c("g2_n").alias("n2"), r6(c("t"), "t"), "df", r6(c("d"), "d"))


@query("st1_student_p", f"WITH {groups_sql(JOINED, 'gender', 'total_value')}, t AS (SELECT (m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1.0::DOUBLE / n1 + 1.0::DOUBLE / n2)) AS t, CAST(n1 + n2 - 2 AS DOUBLE) AS df FROM tw) SELECT round(t, 6) AS t, round({tp('t', 'df')}, 6) AS p FROM t")
def _(v):
    return st.student(joined(v), [], "gender", "total_value").select(r6(c("t"), "t"), r6(c("p"), "p"))


@query("st2_anova", f"""WITH mo AS (SELECT class_name, count(total_value) AS n, avg(total_value) AS mean, var_pop(total_value) AS var0 FROM {JOINED} GROUP BY class_name),
s AS (SELECT count(*) AS k, sum(n) AS n, sum(n * mean) / sum(n) AS grand, sum(n * var0) AS ssw FROM mo), b AS (SELECT sum(n * pow(mean - (SELECT grand FROM s), 2)) AS ssb FROM mo)
SELECT k, CAST(n AS BIGINT) AS n, round((ssb / (k - 1)) / (ssw / (n - k)), 5) AS f, round(ssb / (ssb + ssw), 6) AS eta2 FROM s, b""")
def _(v):
    return st.anova(joined(v), [], "class_name", "total_value").select("k", "n", F.round("f", 5).alias("f"), r6(c("eta2"), "eta2"))


@query("st3_welch", f"WITH {groups_sql(JOINED, 'centre_raw', 'total_value')} SELECT {WELCH} FROM tw")
def _(v):
    return welch_columns(st.welch(joined(v), [], "centre_raw", "total_value"))


MEANS = f"(SELECT user_id, gender, avg(total_value) AS total_value FROM {JOINED} GROUP BY user_id, gender)"


@query("st4_participant_means", f"""WITH RECURSIVE {groups_sql(MEANS, 'gender', 'total_value')}, w AS (SELECT n1, n2, m1 - m2 AS diff, sqrt(v1 / n1 + v2 / n2) AS se, pow(v1 / n1 + v2 / n2, 2) / (pow(v1 / n1, 2) / (n1 - 1) + pow(v2 / n2, 2) / (n2 - 1)) AS df, abs(m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)) AS d FROM tw),
nw AS (SELECT 0 AS i, 1.96::DOUBLE AS x, df FROM w UNION ALL SELECT i + 1, x + ({tp('x', 'df')} - 0.05) / (2 * exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(df * pi()) * pow(1 + x * x / df, -(df + 1) / 2)), df FROM nw WHERE i < 8)
SELECT n1, n2, round(diff / se, 6) AS t, round(w.df, 4) AS df, round(d, 6) AS d, round({tp('diff / se', 'w.df')}, 6) AS p, round(diff, 6) AS diff, round(diff - x * se, 5) AS low, round(diff + x * se, 5) AS high FROM w JOIN nw ON nw.i = 8""")
def _(v):
    means = joined(v).groupBy("user_id", "gender").agg(F.avg("total_value").alias("total_value"))
    m = st.mean_difference(means, [], "gender", "total_value")
    return m.select(c("g1_n").alias("n1"), c("g2_n").alias("n2"), r6(c("t"), "t"), F.round("df", 4).alias("df"), r6(c("d"), "d"), r6(c("p"), "p"), r6(c("diff"), "diff"), F.round("low", 5).alias("low"), F.round("high", 5).alias("high"))


TESTS = f"(SELECT metric || '~' || demo AS test, grp, x FROM (SELECT 'total_value' AS metric, total_value AS x, gender, centre_raw FROM {JOINED} UNION ALL SELECT 'outcome', outcome, gender, centre_raw FROM {JOINED}) m, LATERAL (SELECT 'gender' AS demo, gender AS grp UNION ALL SELECT 'centre', centre_raw) g)"


@query("st5_all_tests", f"WITH {groups_sql(TESTS, 'grp', 'x', 'test')} SELECT test, {WELCH} FROM tw")
def _(v):
    d = joined(v).select("gender", c("centre_raw").alias("centre"), "total_value", "outcome")
    d = d.unpivot(["gender", "centre"], ["total_value", "outcome"], "metric", "x").unpivot(["metric", "x"], ["gender", "centre"], "demo", "grp")
    return welch_columns(st.welch(d.withColumn("test", F.concat_ws("~", "metric", "demo")), ["test"], "grp", "x"), "test")


SPLIT = "(SELECT CASE WHEN total_value > (SELECT median(total_value) FROM v_daily) THEN 'high' ELSE 'low' END AS level, outcome FROM v_daily)"


@query("st6_median_split", f"WITH {groups_sql(SPLIT, 'level', 'outcome')} SELECT {WELCH} FROM tw")
def _(v):
    return welch_columns(st.welch(labels.high_low(v.daily, "total_value", "level"), [], "level", "outcome"))


PAIRS = [("total_value", "outcome"), ("total_value", "n_events"), ("n_types", "outcome")]
CORR = "c AS (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r, count(*) AS n FROM v_daily" for a, b in PAIRS) + ")"


@query("st7_pearson", f"WITH {CORR} SELECT a, b, n, round(r, 6) AS r, round(r * sqrt((n - 2) / (1 - r * r)), 5) AS t, CASE WHEN abs(r) < 0.1 THEN 'Negligible' WHEN abs(r) < 0.3 THEN 'Small' WHEN abs(r) < 0.5 THEN 'Medium' ELSE 'Large' END AS effect FROM c")
def _(v):
    return st.pearson(v.daily, PAIRS).select("a", "b", "n", r6(c("r"), "r"), F.round("t", 5).alias("t"), labels.effect_words(c("r")).alias("effect"))


CATEGORY = "CASE WHEN b = 'outcome' THEN 'outcome' ELSE 'activity' END"


@query("st8_result_summary", f"WITH {CORR}, t AS (SELECT *, {CATEGORY} AS category, {tp('r * sqrt((n - 2) / (1 - r * r))', '(n - 2)::DOUBLE')} AS p FROM c) SELECT category, count(*) AS tests, count(*) FILTER (WHERE p < 0.05) AS significant, round(100.0::DOUBLE * count(*) FILTER (WHERE p < 0.05) / count(*), 6) AS pct_significant, max(round(abs(r), 6)) AS top_r FROM t GROUP BY GROUPING SETS ((category), ())")
def _(v):
    p = st.pearson(v.daily, PAIRS).withColumn("category", F.expr(CATEGORY))
    hit = F.count_if(c("p") < 0.05)
    return p.groupingSets([["category"], []], "category").agg(F.count("*").alias("tests"), hit.alias("significant"), r6(hit * 100.0 / F.count("*"), "pct_significant"), F.max(F.round(F.abs("r"), 6)).alias("top_r"))


@query("st8_top_five", f"WITH {CORR} SELECT a, b, round(r, 6) AS r, row_number() OVER (ORDER BY abs(r) DESC, a, b) AS rank FROM c ORDER BY rank LIMIT 5")
def _(v):
    w = Window.orderBy(F.abs("r").desc(), "a", "b")
    return st.pearson(v.daily, PAIRS).withColumn("rank", F.row_number().over(w)).where("rank <= 5").select("a", "b", r6(c("r"), "r"), "rank")


@query("st9_ols", "SELECT round(regr_slope(outcome, total_value), 7) AS coef, round(regr_r2(outcome, total_value), 6) AS r2, count(*) AS n FROM v_daily")
def _(v):
    return st.ols(v.daily, "outcome", ["total_value"]).where("term = 'total_value'").select(F.round("coef", 7).alias("coef"), r6(c("r2"), "r2"), "n")


# Outcome by a value and a factor of three levels, of which F is the reference: the sweep operator on the cross products.
FACTOR = """fz AS (SELECT [1.0::DOUBLE, CAST(total_value AS DOUBLE), CASE WHEN gender_raw = 'M' THEN 1 ELSE 0 END, CASE WHEN gender_raw = 'n/a' THEN 1 ELSE 0 END, CAST(outcome AS DOUBLE)] AS z FROM v_daily JOIN v_demo USING (user_id) WHERE outcome IS NOT NULL AND total_value IS NOT NULL AND gender_raw IS NOT NULL),
fs AS (SELECT 0 AS p, [""" + ", ".join(f"sum(z[{i + 1}] * z[{j + 1}])" for i in range(5) for j in range(5)) + """] AS a FROM fz UNION ALL SELECT p + 1, list_transform(range(0, 25), lambda i: CASE WHEN i // 5 = p AND i % 5 = p THEN -1 / a[6 * p + 1] WHEN i // 5 = p OR i % 5 = p THEN a[i + 1] / a[6 * p + 1] ELSE a[i + 1] - a[5 * (i // 5) + p + 1] * a[5 * p + i % 5 + 1] / a[6 * p + 1] END) FROM fs WHERE p < 4),
ff AS (SELECT max(a) FILTER (WHERE p = 0) AS a0, max(a) FILTER (WHERE p = 2) AS a2, max(a) FILTER (WHERE p = 4) AS a4 FROM fs),
fm AS (SELECT a0[1] AS n, a4, a4[25] AS rss, a2[25] AS rss2, a0[25] - a0[5] * a0[5] / a0[1] AS tss FROM ff),
ft AS (SELECT *, unnest(range(0, 4)) AS i FROM fm)"""


def factors(v):
    return st.factor_model(v.daily.join(v.demo, "user_id"), "outcome", ["total_value"], {"gender_raw": "F"})


@query("st9_factor_terms", f"WITH RECURSIVE {FACTOR} SELECT ['intercept', 'total_value', 'gender_raw[M]', 'gender_raw[n/a]'][i + 1] AS term, round(a4[5 * i + 5], 6) AS coef, round(sqrt(-a4[6 * i + 1] * rss / (n - 4)), 6) AS se, round(a4[5 * i + 5] / sqrt(-a4[6 * i + 1] * rss / (n - 4)), 5) AS t, CAST(n AS BIGINT) AS n, round(1 - rss / tss, 6) AS r2 FROM ft")
def _(v):
    return factors(v)[0].select("term", r6(c("coef"), "coef"), r6(c("se"), "se"), F.round("t", 5).alias("t"), "n", r6(c("r2"), "r2"))


@query("st9_factor_tests", f"WITH RECURSIVE {FACTOR}, fq AS (SELECT 'gender_raw' AS factor, 2.0::DOUBLE AS df1, n - 4 AS df2, (rss2 - rss) / 2 / (rss / (n - 4)) AS f FROM fm UNION ALL SELECT 'model', 3, n - 4, (tss - rss) / 3 / (rss / (n - 4)) FROM fm) SELECT factor, df1, df2, round(f, 5) AS f, CASE WHEN df1 = 2 THEN round(pow(1 + 2 * f / df2, -df2 / 2), 6) END AS p FROM fq")
def _(v):
    """The p of two degrees of freedom has a closed form, which the SQL takes; the model's, of three, is left out in both."""
    return factors(v)[1].select("factor", "df1", "df2", F.round("f", 5).alias("f"), F.when(c("df1") == 2, F.round("p", 6)).alias("p"))


# Per outcome and predictor four steps: the predictor, its control, a place and a gender as 0 and 1.
OUTCOMES, PREDICTORS = ["outcome", "log_value", "hour", "spread"], {"total_value": "n_events", "n_types": "n_events", "first_hour": "n_types"}
REG = f"(SELECT d.user_id, outcome, ln(1 + total_value) AS log_value, total_value, n_events, n_types, first_hour, hour, spread, CASE centre_raw WHEN 'Yes' THEN 1 ELSE 0 END AS centre, CASE gender WHEN 'female' THEN 1 WHEN 'male' THEN 0 END AS female FROM {JOINED} d JOIN (SELECT user_id, CAST(ts AS DATE) AS date, CAST(min(hour(ts)) AS DOUBLE) AS first_hour, avg(hour(ts)) AS hour, max(value) - min(value) AS spread FROM events GROUP BY ALL) h ON h.user_id = d.user_id AND h.date = d.date)"


def regression(v):
    h = v.events.groupBy("user_id", F.to_date("ts").alias("date")).agg(F.min(F.hour("ts")).cast("double").alias("first_hour"), F.avg(F.hour("ts")).alias("hour"), (F.max("value") - F.min("value")).alias("spread"))
    d = joined(v).join(h, ["user_id", "date"])
    return d.withColumns({"log_value": F.log(1 + c("total_value")), "centre": (c("centre_raw") == "Yes").cast("int"), "female": F.when(c("gender") == "female", 1).when(c("gender") == "male", 0)})


def models(v):
    return st.nested_models(regression(v), OUTCOMES, {x: [[x], [control], ["centre"], ["female"]] for x, control in PREDICTORS.items()})


# The sweep operator on each model's matrix of cross products (intercept, four terms, outcome): one pivot a turn.
SWEEP = f"""rg AS {REG},
md AS (SELECT y_.y AS outcome, x_.x AS predictor, s_.s AS step, CASE y_.y {' '.join(f"WHEN '{y}' THEN CAST({y} AS DOUBLE)" for y in OUTCOMES)} END AS y, CASE x_.x {' '.join(f"WHEN '{x}' THEN CAST({x} AS DOUBLE)" for x in PREDICTORS)} END AS x1, CASE WHEN s_.s >= 2 THEN CASE x_.x {' '.join(f"WHEN '{x}' THEN CAST({k} AS DOUBLE)" for x, k in PREDICTORS.items())} END ELSE 0 END AS x2, CASE WHEN s_.s >= 3 THEN CAST(centre AS DOUBLE) ELSE 0 END AS x3, CASE WHEN s_.s >= 4 THEN CAST(female AS DOUBLE) ELSE 0 END AS x4
  FROM rg, (SELECT unnest({OUTCOMES}) AS y) y_, (SELECT unnest({list(PREDICTORS)}) AS x) x_, (SELECT unnest([1, 2, 3, 4]) AS s) s_),
ml AS (SELECT outcome, predictor, step, [1.0::DOUBLE, x1, x2, x3, x4, y] AS z FROM md WHERE y IS NOT NULL AND x1 IS NOT NULL AND x2 IS NOT NULL AND x3 IS NOT NULL AND x4 IS NOT NULL),
cp AS (SELECT outcome, predictor, step, [{', '.join(f'sum(z[{i + 1}] * z[{j + 1}])' for i in range(6) for j in range(6))}] AS a0 FROM ml GROUP BY outcome, predictor, step),
sw AS (SELECT outcome, predictor, step, 0 AS p, a0 AS a, a0 FROM cp UNION ALL SELECT outcome, predictor, step, p + 1, list_transform(range(0, 36), lambda i: CASE WHEN i // 6 = p AND i % 6 = p THEN -1 / a[7 * p + 1] WHEN i // 6 = p OR i % 6 = p THEN a[i + 1] / a[7 * p + 1] ELSE a[i + 1] - a[6 * (i // 6) + p + 1] * a[6 * p + i % 6 + 1] / a[7 * p + 1] END), a0 FROM sw WHERE p <= step),
fn AS (SELECT *, a0[1] AS n, step + 1 AS k, a[36] AS rss, a0[36] - a0[6] * a0[6] / a0[1] AS tss FROM sw WHERE p = step + 1),
tm AS (SELECT *, unnest(range(0, 5)) AS i FROM fn),
ls AS (SELECT *, CASE i WHEN 0 THEN 'intercept' WHEN 1 THEN predictor WHEN 2 THEN CASE predictor {' '.join(f"WHEN '{x}' THEN '{k}'" for x, k in PREDICTORS.items())} END WHEN 3 THEN 'centre' ELSE 'female' END AS term, a[6 * i + 6] AS coef, sqrt(-a[7 * i + 1] * rss / (n - k)) AS se FROM tm WHERE i <= step)"""


@query("st10_nested_models", f"WITH RECURSIVE {SWEEP} SELECT outcome, predictor, step, term, round(coef, 6) AS coef, round(se, 6) AS se, round(coef / se, 5) AS t, round({tp('coef / se', 'n - k')}, 6) AS p, round(1 - rss / tss, 6) AS r2, round(1 - rss / tss * (n - 1) / (n - k), 6) AS adj_r2, round(2 * k + n * (ln(2 * pi() * rss / n) + 1), 4) AS aic, round(k * ln(n) + n * (ln(2 * pi() * rss / n) + 1), 4) AS bic FROM ls")
def _(v):
    return models(v).select("outcome", "predictor", "step", "term", *[r6(c(x), x) for x in ("coef", "se", "p", "r2", "adj_r2")], F.round("t", 5).alias("t"), F.round("aic", 4).alias("aic"), F.round("bic", 4).alias("bic"))


@query("st11_step_pivot", f"WITH RECURSIVE {SWEEP} SELECT outcome, predictor, term, " + ", ".join(f"max(CASE WHEN step = {i} THEN round(coef, 6) END) AS step_{i}" for i in (1, 2, 3, 4)) + " FROM ls WHERE term <> 'intercept' GROUP BY outcome, predictor, term")
def _(v):
    m = models(v).where("term <> 'intercept'")
    return m.groupBy("outcome", "predictor", "term").pivot("step", [1, 2, 3, 4]).agg(F.round(F.first("coef"), 6)).withColumnsRenamed({str(i): f"step_{i}" for i in (1, 2, 3, 4)})


@query("st12_decomposition", "SELECT user_id, date, round(avg(total_value) OVER (PARTITION BY user_id), 6) AS person_mean, round(total_value - avg(total_value) OVER (PARTITION BY user_id), 6) AS deviation, round(outcome - avg(outcome) OVER (), 6) AS centred FROM v_daily")
def _(v):
    grand = v.daily.agg(F.avg("outcome").alias("g"))
    own = F.avg("total_value").over(Window.partitionBy("user_id"))
    return v.daily.crossJoin(F.broadcast(grand)).select("user_id", "date", r6(own, "person_mean"), r6(c("total_value") - own, "deviation"), r6(c("outcome") - c("g"), "centred"))


def reml_sql(y: str, x: str | None) -> str:
    """SQL: the restricted likelihood of a random intercept from each group's sums, added up by group size; its top on the
    same scale of log variance ratio, narrowed in by recursion; then coefficients by the inverse of two by two sums."""
    x = f"CAST({x} AS DOUBLE)" if x else "0.0::DOUBLE"
    k = 2 if x != "0.0::DOUBLE" else 1
    det = "(a00 * a11 - a01 * a01)" if k == 2 else "a00"
    solved = "(b0 * a11 - b1 * a01) / (a00 * a11 - a01 * a01) AS k0, (a00 * b1 - a01 * b0) / (a00 * a11 - a01 * a01) AS k1" if k == 2 else "b0 / a00 AS k0, 0.0::DOUBLE AS k1"
    sums = ", ".join(f"sum({p} - theta / (1 + size * theta) * {q}) AS {n}" for p, q, n in (("p00", "s00", "a00"), ("p01", "s01", "a01"), ("p11", "s11", "a11"), ("q0", "c0", "b0"), ("q1", "c1", "b1"), ("yy", "qq", "ry")))

    def fitted(source: str, keys: str) -> str:
        return f"SELECT *, -0.5 * ((n - {k}) * (ln(2 * pi() * s2) + 1) + lg + ln({det})) AS ll FROM (SELECT *, greatest((ry - k0 * b0 - k1 * b1) / (n - {k}), 1e-300) AS s2 FROM (SELECT *, {solved} FROM (SELECT {keys}, theta, {sums}, sum(g * ln(1 + size * theta)) AS lg, sum(size * g) AS n, sum(g) AS groups FROM {source}, zz GROUP BY {keys}, theta)))"

    trial = "(SELECT turn, lo, hi, lt, i, exp(lo + (hi - lo) * i / 11) AS theta FROM rr, (SELECT unnest(range(0, 12)) AS i) WHERE turn < 12)"
    return f"""gg AS (SELECT user_id, count(*)::DOUBLE AS m, sum({x}) AS sx, sum({x} * {x}) AS sxx, sum({y}) AS sy, sum({x} * {y}) AS sxy, sum({y} * {y}) AS syy FROM v_daily WHERE {y} IS NOT NULL AND ({x}) IS NOT NULL GROUP BY user_id),
zz AS (SELECT m AS size, count(*)::DOUBLE AS g, sum(m) AS p00, sum(sx) AS p01, sum(sxx) AS p11, sum(m * m) AS s00, sum(m * sx) AS s01, sum(sx * sx) AS s11, sum(sy) AS q0, sum(sxy) AS q1, sum(m * sy) AS c0, sum(sx * sy) AS c1, sum(syy) AS yy, sum(sy * sy) AS qq FROM gg GROUP BY m),
rr AS (SELECT 0 AS turn, -12.0::DOUBLE AS lo, 8.0::DOUBLE AS hi, 0.0::DOUBLE AS lt UNION ALL SELECT turn + 1, lo + (hi - lo) * greatest(best - 1, 0) / 11, lo + (hi - lo) * least(best + 1, 11) / 11, lo + (hi - lo) * best / 11 FROM (SELECT turn, lo, hi, arg_max(i, ll) AS best FROM ({fitted(trial, 'turn, lo, hi, lt, i')}) GROUP BY turn, lo, hi)),
ends AS (SELECT exp(lt) AS theta, 1 AS which, hi - lo AS width FROM rr WHERE turn = 12 UNION ALL SELECT 0, 0, 0 FROM rr WHERE turn = 12),
fin AS (SELECT *, theta * s2 AS gv, {det} AS det FROM (SELECT *, row_number() OVER (ORDER BY ll DESC, which) AS place FROM ({fitted('ends', 'which, width')})) WHERE place = 1)"""


NORMAL_P = "greatest(0.0::DOUBLE, 1 - 2 * abs({z}) / 6000 / sqrt(2 * pi()) * list_sum(list_transform(range(0, 2001), lambda i: (CASE WHEN i = 0 OR i = 2000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * exp(-pow({z} * i / 2000.0::DOUBLE, 2) / 2))))"
ST13 = "SELECT term, round(coef, 5) AS coef, round(se, 5) AS se, round(coef / se, 5) AS z, round(" + NORMAL_P.format(z="(coef / se)") + ", 5) AS p, round(gv, 5) AS group_var, round(s2, 5) AS residual_var, round(theta / (1 + theta), 5) AS icc, round(ll, 3) AS ll, round(8 - 2 * ll, 3) AS aic, round(4 * ln(n) - 2 * ll, 3) AS bic, CAST(n AS BIGINT) AS n, CAST(groups AS BIGINT) AS n_groups, which = 0 OR width < 0.00001 AS converged FROM (SELECT *, 'intercept' AS term, k0 AS coef, sqrt(a11 / det * s2) AS se FROM fin UNION ALL SELECT *, 'total_value', k1, sqrt(a00 / det * s2) FROM fin)"


@query("st13_random_intercept", f"WITH RECURSIVE {reml_sql('outcome', 'total_value')} {ST13}")
def _(v):
    m = st.random_intercept(v.daily, "outcome", ["total_value"], "user_id")
    return m.select("term", *[F.round(x, 5).alias(x) for x in ("coef", "se", "z", "p", "group_var", "residual_var", "icc")], *[F.round(x, 3).alias(x) for x in ("ll", "aic", "bic")], "n", "n_groups", "converged")


@query("st14_icc", f"WITH RECURSIVE {reml_sql('outcome', None)} SELECT round(theta / (1 + theta), 6) AS icc, CAST(n AS BIGINT) AS n, CAST(groups AS BIGINT) AS n_groups FROM fin")
def _(v):
    return st.random_intercept(v.daily, "outcome", [], "user_id").select(F.round("icc", 6).alias("icc"), "n", "n_groups")


@query("st14_anova_icc", "WITH g AS (SELECT user_id, count(outcome) AS m, avg(outcome) AS mean, var_pop(outcome) AS var FROM v_daily WHERE outcome IS NOT NULL GROUP BY user_id), t AS (SELECT sum(m) AS n, count(*) AS k, sum(m * m) AS mm, sum(m * mean) AS s, sum(m * mean * mean) AS ss, sum(m * var) AS w FROM g), v AS (SELECT *, (n - mm / n::DOUBLE) / (k - 1) AS n0, (ss - s * s / n) / (k - 1) AS msb, w / (n - k) AS msw FROM t) SELECT CAST(n AS BIGINT) AS n, k AS n_groups, round(n0, 6) AS n0, round(msb, 4) AS ms_between, round(msw, 4) AS ms_within, round(greatest((msb - msw) / n0, 0), 5) AS group_var, round(msw, 4) AS residual_var, round(greatest((msb - msw) / n0, 0) / (greatest((msb - msw) / n0, 0) + msw), 6) AS icc FROM v")
def _(v):
    d = st.anova_icc(v.daily, "outcome", "user_id")
    return d.select("n", "n_groups", r6(c("n0"), "n0"), *[F.round(x, 4).alias(x) for x in ("ms_between", "ms_within", "residual_var")], F.round("group_var", 5).alias("group_var"), r6(c("icc"), "icc"))


def interaction(v, outcome):
    d, terms = st.within_between(regression(v), "total_value", "user_id", "female")
    return st.random_intercept(d.where("female is not null"), outcome, terms, "user_id")


@query("st15_interaction_model")
def _(v):
    m = interaction(v, "outcome")
    return m.select("term", *[F.round(x, 5).alias(x) for x in ("coef", "se")], F.round("p_t", 5).alias("p"), F.round(c("coef") - 1.96 * c("se"), 5).alias("low"), F.round(c("coef") + 1.96 * c("se"), 5).alias("high"), *[F.round(x, 5).alias(x) for x in ("marginal_r2", "conditional_r2")])


@query("st16_article_table")
def _(v):
    return st.article_table({y: interaction(v, y) for y in ("outcome", "hour")})


ARTICLE = "g AS (SELECT source, avg(total_value) AS m1, stddev_samp(total_value) AS s1, avg(n_events) AS m2, stddev_samp(n_events) AS s2 FROM v_daily GROUP BY source)"


@query("st16_descriptives", f"WITH {ARTICLE} SELECT 'total_value' AS parameter, max(CASE WHEN source = 'studyA' THEN printf('%.2f (%.2f)', m1, s1) END) AS \"studyA\", max(CASE WHEN source = 'studyB' THEN printf('%.2f (%.2f)', m1, s1) END) AS \"studyB\" FROM g UNION ALL SELECT 'n_events', max(CASE WHEN source = 'studyA' THEN printf('%.2f (%.2f)', m2, s2) END), max(CASE WHEN source = 'studyB' THEN printf('%.2f (%.2f)', m2, s2) END) FROM g")
def _(v):
    d = v.daily.select("source", "total_value", c("n_events").cast("double").alias("n_events")).unpivot(["source"], ["total_value", "n_events"], "parameter", "x")
    return d.groupBy("parameter").pivot("source", ["studyA", "studyB"]).agg(labels.mean_sd(F.avg("x"), F.stddev_samp("x")))


@query("st17_simple_slopes", "SELECT source, count(*) AS n, round(regr_slope(outcome, total_value), 7) AS slope, round(regr_intercept(outcome, total_value), 6) AS intercept, round(sqrt((regr_syy(outcome, total_value) - regr_slope(outcome, total_value) * regr_sxy(outcome, total_value)) / (count(*) - 2) / regr_sxx(outcome, total_value)), 7) AS se FROM v_daily GROUP BY source")
def _(v):
    s = st.simple_slopes(v.daily, "source", "total_value", "outcome")
    return s.select("source", "n", F.round("slope", 7).alias("slope"), r6(c("intercept"), "intercept"), F.round("se", 7).alias("se"))


# The t quantile by bisection on the integrated density, once per level.
BANDS = f"""g AS (SELECT source, count(*) AS n, avg(CAST(total_value AS DOUBLE)) AS m, min(CAST(total_value AS DOUBLE)) AS lo, max(CAST(total_value AS DOUBLE)) AS hi, regr_slope(outcome, total_value) AS b, regr_intercept(outcome, total_value) AS a, regr_sxx(outcome, total_value) AS sxx, regr_syy(outcome, total_value) AS syy, regr_sxy(outcome, total_value) AS sxy FROM v_daily WHERE outcome IS NOT NULL GROUP BY source HAVING count(*) >= 10),
q AS (SELECT source, 0 AS turn, 0.0::DOUBLE AS lt, 100.0::DOUBLE AS ht, (n - 2)::DOUBLE AS df FROM g UNION ALL SELECT source, turn + 1, CASE WHEN p > 0.05 THEN mid ELSE lt END, CASE WHEN p > 0.05 THEN ht ELSE mid END, df FROM (SELECT *, {tp('mid', 'df')} AS p FROM (SELECT *, (lt + ht) / 2 AS mid FROM q)) WHERE turn < 50),
k AS (SELECT g.*, (lt + ht) / 2 AS t, greatest(syy - b * sxy, 0) / (n - 2) AS s2, unnest(range(0, 20)) AS i FROM g JOIN q USING (source) WHERE turn = 50),
x AS (SELECT *, lo + (hi - lo) * i / 19 AS x FROM k),
h AS (SELECT *, a + b * x AS fit, t * sqrt(s2 * (1 / n::DOUBLE + pow(x - m, 2) / sxx)) AS half FROM x)"""


@query("st17_slope_bands", f"WITH RECURSIVE {BANDS} SELECT source, CAST(i AS INTEGER) AS i, round(x, 5) AS x, round(fit, 5) AS fit, round(fit - half, 4) AS low, round(fit + half, 4) AS high FROM h")
def _(v):
    d = st.slope_bands(v.daily, "source", "total_value", "outcome")
    return d.select("source", "i", F.round("x", 5).alias("x"), F.round("fit", 5).alias("fit"), F.round("low", 4).alias("low"), F.round("high", 4).alias("high"))


@query("st18_marginal_effects", "WITH s AS (SELECT source, regr_slope(outcome, total_value) AS b, sqrt((regr_syy(outcome, total_value) - regr_slope(outcome, total_value) * regr_sxy(outcome, total_value)) / (count(*) - 2) / regr_sxx(outcome, total_value)) AS se FROM v_daily GROUP BY source), w AS (SELECT max(b) FILTER (WHERE source = 'studyA') AS b1, max(b) FILTER (WHERE source = 'studyB') AS b2, max(se) FILTER (WHERE source = 'studyA') AS s1, max(se) FILTER (WHERE source = 'studyB') AS s2 FROM s) SELECT round(b1, 7) AS ref, round(b2 - b1, 7) AS change, round(b2 - b1 - 1.96 * sqrt(s1 * s1 + s2 * s2), 7) AS low, round(b2 - b1 + 1.96 * sqrt(s1 * s1 + s2 * s2), 7) AS high FROM w")
def _(v):
    s = st.simple_slopes(v.daily, "source", "total_value", "outcome")
    pick = lambda x, name: F.max(F.when(c("source") == name, c(x)))
    w = s.agg(pick("slope", "studyA").alias("b1"), pick("slope", "studyB").alias("b2"), pick("se", "studyA").alias("s1"), pick("se", "studyB").alias("s2"))
    diff, se = c("b2") - c("b1"), F.sqrt(c("s1") * c("s1") + c("s2") * c("s2"))
    return w.select(F.round("b1", 7).alias("ref"), F.round(diff, 7).alias("change"), F.round(diff - 1.96 * se, 7).alias("low"), F.round(diff + 1.96 * se, 7).alias("high"))


COLUMNS = ["total_value", "outcome", "n_events"]


@query("st19_collinearity", "WITH c AS (" + " UNION ALL ".join(f"SELECT 'correlation' AS kind, '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS value, abs(corr({a}, {b})) > 0.7 AS flagged FROM v_daily" for i, a in enumerate(COLUMNS) for b in COLUMNS[i + 1 :]) + "), m AS (SELECT user_id, " + ", ".join(f"avg({x}) AS {x}" for x in COLUMNS) + " FROM v_daily GROUP BY user_id), b AS (" + " UNION ALL ".join(f"SELECT 'between_variance', '{x}', NULL, var_samp({x}), var_samp({x}) < 0.000001 FROM m" for x in COLUMNS) + ") SELECT kind, a, b, round(value, 6) AS value, flagged FROM (SELECT * FROM c UNION ALL SELECT * FROM b) t")
def _(v):
    return st.model_diagnostics(v.daily, COLUMNS, "user_id").withColumn("value", F.round("value", 6))


@query("st20_descriptive_groups", "SELECT round(avg(total_value) FILTER (WHERE source = 'studyA'), 6) AS mean_a, round(avg(total_value) FILTER (WHERE source = 'studyB'), 6) AS mean_b, round(stddev_samp(total_value) FILTER (WHERE source = 'studyA') / stddev_samp(total_value) FILTER (WHERE source = 'studyB'), 6) AS sd_ratio, round(avg(total_value) FILTER (WHERE source = 'studyA') - avg(total_value) FILTER (WHERE source = 'studyB'), 6) AS mean_diff FROM v_daily")
def _(v):
    x = lambda s: F.when(c("source") == s, c("total_value"))
    a, b = x("studyA"), x("studyB")
    return v.daily.agg(r6(F.avg(a), "mean_a"), r6(F.avg(b), "mean_b"), r6(F.stddev_samp(a) / F.stddev_samp(b), "sd_ratio"), r6(F.avg(a) - F.avg(b), "mean_diff"))


AGES = "(SELECT CASE source WHEN 'studyA' THEN 'adult' ELSE 'adolescent' END AS age_group, total_value, outcome, CAST(n_events AS DOUBLE) AS n_events FROM v_daily)"


@query("st20_age_groups", f"WITH d AS (SELECT age_group, unnest(['total_value', 'outcome', 'n_events']) AS metric, unnest([total_value, outcome, n_events]) AS x FROM {AGES}), g AS (SELECT metric, count(x) FILTER (WHERE age_group = 'adolescent') AS n_adolescent, count(x) FILTER (WHERE age_group = 'adult') AS n_adult, avg(x) FILTER (WHERE age_group = 'adolescent') AS m1, avg(x) FILTER (WHERE age_group = 'adult') AS m2, stddev_samp(x) FILTER (WHERE age_group = 'adolescent') AS s1, stddev_samp(x) FILTER (WHERE age_group = 'adult') AS s2 FROM d GROUP BY metric) SELECT metric, n_adolescent, n_adult, round(m1, 6) AS mean_adolescent, round(m2, 6) AS mean_adult, round(s1, 6) AS sd_adolescent, round(s2, 6) AS sd_adult, round(m1 - m2, 6) AS mean_diff, round(s1 / s2, 6) AS sd_ratio FROM g")
def _(v):
    """n, mean and SD of each measure per age group, their difference and the ratio of the SDs."""
    d = v.daily.select(F.when(c("source") == "studyA", "adult").otherwise("adolescent").alias("age_group"), c("total_value").cast("double").alias("total_value"), "outcome", c("n_events").cast("double").alias("n_events"))
    d = d.unpivot(["age_group"], ["total_value", "outcome", "n_events"], "metric", "x")
    ages = ("adolescent", "adult")
    own = {a: F.when(c("age_group") == a, c("x")) for a in ages}
    g = d.groupBy("metric").agg(*[F.count(x).alias(f"n_{a}") for a, x in own.items()], *[F.avg(x).alias(f"mean_{a}") for a, x in own.items()], *[F.stddev_samp(x).alias(f"sd_{a}") for a, x in own.items()])
    both = r6(c("mean_adolescent") - c("mean_adult"), "mean_diff"), r6(c("sd_adolescent") / c("sd_adult"), "sd_ratio")
    return g.select("metric", "n_adolescent", "n_adult", *[r6(c(f"{k}_{a}"), f"{k}_{a}") for k in ("mean", "sd") for a in ages], *both)


@query("st21_check_standardisation", "WITH z AS (SELECT user_id, (total_value - avg(total_value) OVER ()) / stddev_samp(total_value) OVER () AS z FROM v_daily), g AS (SELECT user_id, 'participant' AS level, count(z) AS n, avg(z) AS mean, stddev_samp(z) AS sd, 0.1 AS lim FROM z GROUP BY user_id UNION ALL SELECT NULL, 'population', count(z), avg(z), stddev_samp(z), 0.01 FROM z UNION ALL SELECT user_id + 1000000000, 'participant', count(x), avg(x), stddev_samp(x), 0.1 FROM (SELECT user_id, total_value / 97 AS x FROM v_daily) r GROUP BY user_id UNION ALL SELECT NULL, 'population', count(x), avg(x), stddev_samp(x), 0.01 FROM (SELECT total_value / 97 AS x FROM v_daily) r) SELECT user_id, level, n, round(mean, 6) AS mean, round(sd, 6) AS sd FROM g WHERE n > 1 AND (abs(mean) > lim OR abs(sd - 1) > lim)")
def _(v):
    """What is standardised over all rows, and what is not at all (ids above 10^9), of which the population is listed too."""
    z = qn.zscore(v.daily, "total_value", [], "z", ddof=1)
    raw = v.daily.select((c("user_id") + 1_000_000_000).alias("user_id"), (c("total_value") / 97).alias("z"))
    found = st.check_standardisation(z, "user_id", "z").unionByName(st.check_standardisation(raw, "user_id", "z"))
    return found.select("user_id", "level", "n", r6(c("mean"), "mean"), r6(c("sd"), "sd"))


@query("st22_two_standardisations", "WITH z AS (SELECT user_id, (total_value - avg(total_value) OVER ()) / stddev_pop(total_value) OVER () AS zp, CASE WHEN coalesce(stddev_samp(total_value) OVER w, 0) = 0 THEN 0 ELSE (total_value - avg(total_value) OVER w) / stddev_samp(total_value) OVER w END AS zi FROM v_daily WINDOW w AS (PARTITION BY user_id)) SELECT user_id, round(avg(zp), 6) AS population, abs(avg(zi)) < 0.000001 AS person_is_zero FROM z GROUP BY user_id")
def _(v):
    z = qn.zscore(qn.zscore(v.daily, "total_value", [], "zp", ddof=0), "total_value", ["user_id"], "zi")
    return z.groupBy("user_id").agg(r6(F.avg("zp"), "population"), (F.abs(F.avg("zi")) < 0.000001).alias("person_is_zero"))
