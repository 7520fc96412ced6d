"""Statistics queries (T1–T13) on lineitem and part."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulon.operators import stats as st
from tabulon.plans.registry import query
from tabulon.sources.tables import read_table as T

VARS = ["l_quantity", "l_extendedprice", "l_tax", "net"]
_LI = ("WITH li AS (SELECT l_quantity, l_extendedprice, l_tax, l_extendedprice * (1 - l_discount) AS net, "
       "l_linestatus, l_returnflag FROM lineitem)\n")


def _li(spark, d):
    li = T(spark, d, "lineitem")
    return li.select("l_quantity", "l_extendedprice", "l_tax",
                     (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"),
                     "l_linestatus", "l_returnflag")


def _r(df, cols, k=6):
    return df.select(*[F.round(c, k).alias(c) if c in cols else F.col(c) for c in df.columns])


@query("describe", _LI + "\nUNION ALL ".join(
    f"SELECT '{c}' AS column_name, CAST({i + 1} AS INTEGER) AS position, count({c}) AS count, "
    f"round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, round(min({c}), 6) AS min, "
    f"round(quantile_cont({c}, 0.25), 6) AS p25, round(quantile_cont({c}, 0.5), 6) AS p50, "
    f"round(quantile_cont({c}, 0.75), 6) AS p75, round(max({c}), 6) AS max, count(*) AS row_count FROM li"
    for i, c in enumerate(VARS)))
def describe(spark, d):
    return _r(st.describe(_li(spark, d), VARS), ["mean", "std", "min", "p25", "p50", "p75", "max"])


_CORR_CTE = _LI + ", c AS (" + "\nUNION ALL ".join(
    f"SELECT '{a}' AS var1, '{b}' AS var2, CAST({i} AS INTEGER) AS i, CAST({j} AS INTEGER) AS j, corr({a}, {b}) AS r FROM li"
    for i, a in enumerate(VARS) for j, b in enumerate(VARS)) + ")\n"


@query("correlation", _CORR_CTE + "SELECT var1, var2, i, j, round(r, 6) AS r FROM c")
def correlation(spark, d):
    return _r(st.correlation(_li(spark, d), VARS), ["r"])


@query("significant_correlations", _CORR_CTE + """
SELECT var1, var2, round(r, 6) AS correlation, CASE WHEN abs(r) >= 0.7 THEN 'strong' ELSE 'moderate' END AS strength
FROM c WHERE i < j AND abs(r) >= 0.5""")
def significant_correlations(spark, d):
    return _r(st.significant_correlations(st.correlation(_li(spark, d), VARS)), ["correlation"])


@query("heatmap_cells", _CORR_CTE + "SELECT var1, var2, round(r, 6) AS r, printf('%.2f', r) AS label FROM c")
def heatmap_cells(spark, d):
    return _r(st.heatmap_cells(st.correlation(_li(spark, d), VARS)), ["r"])


@query("interpretation", _CORR_CTE + """
SELECT var1, var2, printf('%s %s correlation between %s and %s (r = %.2f).',
   CASE WHEN abs(r) >= 0.7 THEN 'Strong' ELSE 'Moderate' END, CASE WHEN r > 0 THEN 'positive' ELSE 'negative' END,
   var1, var2, r) AS sentence
FROM c WHERE i < j AND abs(r) >= 0.5""")
def interpretation(spark, d):
    return st.interpretation(st.correlation(_li(spark, d), VARS))


_TT_CTE = """
WITH g AS (SELECT l_linestatus AS grp, avg(l_extendedprice) AS mean, stddev_samp(l_extendedprice) AS std,
                  count(*) AS n FROM lineitem WHERE l_linestatus IS NOT NULL GROUP BY 1),
a AS (SELECT * FROM g WHERE grp = (SELECT min(grp) FROM g)),
b AS (SELECT * FROM g WHERE grp = (SELECT max(grp) FROM g)),
s AS (SELECT a.grp AS g1, a.mean AS m1, a.std AS s1, a.n AS n1, b.grp AS g2, b.mean AS m2, b.std AS s2, b.n AS n2,
             ((a.n - 1) * a.std * a.std + (b.n - 1) * b.std * b.std) / (a.n + b.n - 2) AS sp2 FROM a, b)
"""


def t_test_ctes(table: str, dependent: str, group: str) -> str:
    """``tt`` (t, df, d, p): pooled two-sample t; p by Simpson's rule on the density."""
    return f"""
    WITH g AS (SELECT {group} AS grp, avg({dependent}) AS mean, stddev_samp({dependent}) AS std, count(*) AS n
               FROM {table} WHERE {group} IS NOT NULL AND {dependent} IS NOT NULL GROUP BY 1),
    s AS (SELECT a.mean AS m1, b.mean AS m2, a.n AS n1, b.n AS n2, (a.n + b.n - 2)::DOUBLE AS df,
                 sqrt(((a.n - 1) * a.std * a.std + (b.n - 1) * b.std * b.std) / (a.n + b.n - 2)) AS sp
          FROM g a, g b WHERE a.grp = (SELECT min(grp) FROM g) AND b.grp = (SELECT max(grp) FROM g)),
    t0 AS (SELECT (m1 - m2) / (sp * sqrt(1.0 / n1 + 1.0 / n2)) AS t, df, (m1 - m2) / sp AS d FROM s),
    steps AS (SELECT t, df, d, abs(t) / 4000 AS h, unnest(range(4001)) AS i FROM t0),
    dens AS (SELECT t, df, d, h, CASE WHEN i = 0 OR i = 4000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END AS weight,
                    exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(df * pi())
                    * power(1 + (i * h) * (i * h) / df, -(df + 1) / 2) AS f FROM steps),
    tt AS (SELECT t, df, d, greatest(0.0, 1 - 2 * sum(weight * f) * any_value(h) / 3) AS p FROM dens GROUP BY t, df, d)"""


def _ppf_sql(x: str) -> str:
    """Normal quantile by Acklam's coefficients (the fixed values of functions.columns)."""
    from tabulon.functions.columns import _A, _B, _C, _D

    def horner(coefs, v):
        out = repr(coefs[0])
        for c in coefs[1:]:
            out = f"({out} * {v} + {c!r})"
        return out

    def tail(p):
        v = f"sqrt(-2 * ln({p}))"
        return f"{horner(_C, v)} / ({horner(_D, v)} * {v} + 1)"

    r = f"(({x}) - 0.5) * (({x}) - 0.5)"
    mid = f"{horner(_A, f'({r})')} * (({x}) - 0.5) / ({horner(_B, f'({r})')} * ({r}) + 1)"
    return f"CASE WHEN ({x}) < 0.02425 THEN {tail(x)} WHEN ({x}) > 0.97575 THEN -({tail(f'1 - ({x})')}) ELSE {mid} END"


def shapiro_ctes(table: str, column: str) -> str:
    """``sw`` (n, mean, std, w): Shapiro–Wilk W with Royston's end weights (n above 5)."""
    return f"""
    WITH v AS (SELECT CAST({column} AS DOUBLE) AS x, row_number() OVER (ORDER BY {column}) AS rk, count(*) OVER () AS n
               FROM {table} WHERE {column} IS NOT NULL),
    m AS (SELECT x, rk, n, {_ppf_sql("(rk - 0.375) / (n + 0.25)")} AS m FROM v),
    a AS (SELECT n, sum(m * x) AS smx, sum(m * m) AS mm, var_pop(x) * n AS ssq, avg(x) AS mean, stddev_samp(x) AS std,
                 max(x) FILTER (WHERE rk = 1) AS x1, max(x) FILTER (WHERE rk = 2) AS x2,
                 max(x) FILTER (WHERE rk = n - 1) AS xn1, max(x) FILTER (WHERE rk = n) AS xn,
                 max(m) FILTER (WHERE rk = n) AS mn, max(m) FILTER (WHERE rk = n - 1) AS mn1, 1 / sqrt(n) AS u
          FROM m GROUP BY n),
    c AS (SELECT *, -2.706056 * u ** 5 + 4.434685 * u ** 4 - 2.071190 * u ** 3 - 0.147981 * u ** 2 + 0.221157 * u + mn / sqrt(mm) AS an,
                 -3.582633 * u ** 5 + 5.682633 * u ** 4 - 1.752461 * u ** 3 - 0.293762 * u ** 2 + 0.042981 * u + mn1 / sqrt(mm) AS an1 FROM a),
    sw AS (SELECT n, mean, std, least(1.0, power((smx - mn * (xn - x1) - mn1 * (xn1 - x2))
                  / sqrt((mm - 2 * mn * mn - 2 * mn1 * mn1) / (1 - 2 * an * an - 2 * an1 * an1))
                  + an * (xn - x1) + an1 * (xn1 - x2), 2) / ssq) AS w FROM c)"""


@query("t_test", _TT_CTE + """
SELECT 'l_extendedprice' AS dependent_variable, 'l_linestatus' AS group_variable,
       g1 AS group1, round(m1, 6) AS mean1, round(s1, 6) AS std1, n1, g2 AS group2, round(m2, 6) AS mean2,
       round(s2, 6) AS std2, n2, round((m1 - m2) / sqrt(sp2 * (1.0 / n1 + 1.0 / n2)), 6) AS t_statistic,
       CAST(n1 + n2 - 2 AS DOUBLE) AS df, round((m1 - m2) / sqrt(sp2), 6) AS cohens_d FROM s""")
def t_test(spark, d):
    tt = st.t_test(T(spark, d, "lineitem"), "l_extendedprice", "l_linestatus")
    return _r(tt, ["mean1", "std1", "mean2", "std2", "t_statistic", "cohens_d"])


@query("cohens_d", _TT_CTE + """
SELECT g1 AS group1, g2 AS group2, round(CASE WHEN sqrt(sp2) <> 0 THEN (m1 - m2) / sqrt(sp2) ELSE 0 END, 6) AS cohens_d FROM s""")
def cohens_d(spark, d):
    tt = st.t_test(T(spark, d, "lineitem"), "l_extendedprice", "l_linestatus")
    return _r(tt.select("group1", "group2", "cohens_d"), ["cohens_d"])


@query("t_test_significance", t_test_ctes("lineitem", "l_extendedprice", "l_linestatus") + """
SELECT 'F' AS group1, 'O' AS group2, round(t, 6) AS t_statistic, df, round(p, 6) AS p_value, p < 0.05 AS significant FROM tt""")
def t_test_significance(spark, d):
    """T5 verdict: two-sided p from the incomplete beta."""
    tt = st.t_test(T(spark, d, "lineitem"), "l_extendedprice", "l_linestatus")
    out = st.with_t_pvalue(tt).select("group1", "group2", "t_statistic", "df", "p_value", "significant")
    return _r(out, ["t_statistic", "p_value"])


def _jb_sql(table, c, expr=None):
    x = expr or c
    return f"""
WITH v AS (SELECT CAST({x} AS DOUBLE) AS x FROM {table} WHERE {x} IS NOT NULL),
m AS (SELECT count(*) AS n, avg(x) AS mean, stddev_samp(x) AS std FROM v),
k AS (SELECT avg(power(x - mean, 2)) AS m2, avg(power(x - mean, 3)) AS m3, avg(power(x - mean, 4)) AS m4 FROM v, m),
s AS (SELECT n, mean, std, m3 / power(m2, 1.5) AS skewness, m4 / (m2 * m2) - 3 AS kurtosis FROM m, k)
SELECT '{c}' AS variable, n, round(mean, 6) AS mean, round(std, 6) AS std, round(skewness, 6) AS skewness,
       round(kurtosis, 6) AS kurtosis, round(n / 6.0 * (skewness * skewness + kurtosis * kurtosis / 4), 4) AS jb_statistic,
       round(exp(-(n / 6.0 * (skewness * skewness + kurtosis * kurtosis / 4)) / 2), 6) AS jb_p_value FROM s"""


@query("jarque_bera", _jb_sql("part", "p_retailprice"))
def jarque_bera(spark, d):
    jb = st.jarque_bera(T(spark, d, "part"), "p_retailprice")
    return _r(_r(jb, ["mean", "std", "skewness", "kurtosis", "jb_p_value"]), ["jb_statistic"], 4)


@query("jarque_bera_quantity", _jb_sql("lineitem", "l_quantity"))
def jarque_bera_quantity(spark, d):
    jb = st.jarque_bera(T(spark, d, "lineitem"), "l_quantity")
    return _r(_r(jb, ["mean", "std", "skewness", "kurtosis", "jb_p_value"]), ["jb_statistic"], 4)


_SW = """
SELECT '{c}' AS variable, n AS sample_size, round(mean, 6) AS mean, round(std, 6) AS std, round(w, 6) AS statistic FROM sw"""


@query("shapiro_wilk", shapiro_ctes("part", "p_retailprice") + _SW.format(c="p_retailprice"))
def shapiro_wilk(spark, d):
    """W on every row (distributed ranks); the p-value is checked by tests."""
    out = st.shapiro_wilk(T(spark, d, "part"), "p_retailprice").drop("p_value", "is_normal")
    return _r(out, ["mean", "std", "statistic"])


@query("shapiro_wilk_quantity", shapiro_ctes("lineitem", "l_quantity") + _SW.format(c="l_quantity"))
def shapiro_wilk_quantity(spark, d):
    out = st.shapiro_wilk(T(spark, d, "lineitem"), "l_quantity").drop("p_value", "is_normal")
    return _r(out, ["mean", "std", "statistic"])


@query("histogram", """
WITH s AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi, count(l_extendedprice) AS n,
                  (max(l_extendedprice) - min(l_extendedprice)) / 30 AS w FROM lineitem),
b AS (SELECT CAST(least(floor((l_extendedprice - lo) / w), 29) AS INTEGER) AS bin, count(*) AS count
      FROM lineitem, s WHERE l_extendedprice IS NOT NULL GROUP BY 1)
SELECT bin, round(lo + bin * w, 6) AS bin_start, round(lo + (bin + 1) * w, 6) AS bin_end, count,
       round(count / (n * w), 12) AS density FROM b, s""")
def histogram(spark, d):
    h = st.histogram(T(spark, d, "lineitem"), "l_extendedprice", 30)
    return _r(_r(h, ["bin_start", "bin_end"]), ["density"], 12)


@query("normal_curve", """
WITH s AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi, avg(l_extendedprice) AS mu,
                  stddev_samp(l_extendedprice) AS sd FROM lineitem),
p AS (SELECT CAST(i AS INTEGER) AS i, lo + (hi - lo) * i / 99 AS x, mu, sd FROM s, range(100) t(i))
SELECT i, round(x, 6) AS x, round(exp(-((x - mu) * (x - mu)) / (2 * sd * sd)) / (sd * sqrt(2 * pi())), 12) AS density FROM p""")
def normal_curve(spark, d):
    c = st.normal_curve(T(spark, d, "lineitem"), "l_extendedprice", 100)
    return _r(_r(c, ["x"]), ["density"], 12)


@query("box_stats", """
WITH v AS (SELECT l_returnflag AS grp, l_extendedprice AS value FROM lineitem WHERE l_extendedprice IS NOT NULL),
q AS (SELECT grp, count(*) AS n, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median,
             quantile_cont(value, 0.75) AS q3 FROM v GROUP BY grp),
f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lo_f, q3 + 1.5 * (q3 - q1) AS hi_f FROM q)
SELECT f.grp AS "group", n, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
       round(min(value) FILTER (WHERE value >= lo_f AND value <= hi_f), 6) AS whisker_low,
       round(max(value) FILTER (WHERE value >= lo_f AND value <= hi_f), 6) AS whisker_high,
       count(*) FILTER (WHERE value < lo_f OR value > hi_f) AS n_fliers
FROM v JOIN f USING (grp) GROUP BY ALL""")
def box_stats(spark, d):
    b = st.box_stats(T(spark, d, "lineitem"), "l_extendedprice", "l_returnflag")
    return _r(b, ["q1", "median", "q3", "whisker_low", "whisker_high"])


@query("linear_regression", """
SELECT 'l_extendedprice' AS dependent, 'l_quantity' AS independent,
       CAST(regr_count(l_extendedprice, l_quantity) AS BIGINT) AS n,
       round(regr_slope(l_extendedprice, l_quantity), 6) AS slope,
       round(regr_intercept(l_extendedprice, l_quantity), 6) AS intercept,
       round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem""")
def linear_regression(spark, d):
    r = st.linear_regression(T(spark, d, "lineitem"), "l_extendedprice", "l_quantity")
    return _r(r, ["slope", "intercept", "r2"])


_ANOVA_SQL = """
WITH g AS (SELECT l_returnflag AS grp, count(*) AS n, avg(l_extendedprice) AS mean, var_samp(l_extendedprice) AS var
           FROM lineitem WHERE l_returnflag IS NOT NULL AND l_extendedprice IS NOT NULL GROUP BY 1),
t AS (SELECT sum(n) AS nn, sum(mean * n) / sum(n) AS grand, count(*) AS k, sum(coalesce((n - 1) * var, 0)) AS ssw FROM g),
s AS (SELECT k, nn, ssw, (SELECT sum(n * (mean - grand) * (mean - grand)) FROM g) AS ssb FROM t)
SELECT 'l_extendedprice' AS dependent, 'l_returnflag' AS group_variable, CAST(k AS BIGINT) AS k, CAST(nn AS BIGINT) AS n,
       round(ssb, 0) AS ss_between, round(ssw, 0) AS ss_within, CAST(k - 1 AS DOUBLE) AS df_between,
       CAST(nn - k AS DOUBLE) AS df_within, round((ssb / (k - 1)) / (ssw / (nn - k)), 6) AS f_statistic FROM s"""


def _anova(spark, d):
    return st.anova(T(spark, d, "lineitem"), "l_extendedprice", "l_returnflag")


@query("anova", _ANOVA_SQL)
def anova(spark, d):
    a = _r(_anova(spark, d), ["ss_between", "ss_within"], 0)
    return _r(a, ["f_statistic"])


@query("anova_significance")
def anova_significance(spark, d):
    """ANOVA verdict: F upper tail through the incomplete beta."""
    a = st.with_tail_pvalue(_anova(spark, d), "f", "f_statistic", "df_between", "df_within")
    return a.select("group_variable", "f_statistic", "df_between", "df_within", "p_value", "significant")


_CHI_SQL = """
WITH c AS (SELECT l_returnflag AS a, l_linestatus AS b, count(*) AS o FROM lineitem
           WHERE l_returnflag IS NOT NULL AND l_linestatus IS NOT NULL GROUP BY 1, 2),
e AS (SELECT o, a, b, (sum(o) OVER (PARTITION BY a)) * (sum(o) OVER (PARTITION BY b)) / (SELECT sum(o) FROM c) AS e FROM c)
SELECT 'l_returnflag' AS var1, 'l_linestatus' AS var2, CAST(sum(o) AS BIGINT) AS n,
       round(sum((o - e) * (o - e) / e) + (sum(o) - sum(e)), 6) AS chi2,
       CAST((count(DISTINCT a) - 1) * (count(DISTINCT b) - 1) AS BIGINT) AS dof FROM e"""


@query("chi_square", _CHI_SQL)
def chi_square(spark, d):
    return _r(st.chi_square(T(spark, d, "lineitem"), "l_returnflag", "l_linestatus"), ["chi2"])


@query("chi_square_significance")
def chi_square_significance(spark, d):
    c = st.chi_square(T(spark, d, "lineitem"), "l_returnflag", "l_linestatus")
    return st.with_tail_pvalue(c, "chi", "chi2", "dof").select("var1", "var2", "chi2", "dof", "p_value", "significant")


@query("spearman", """
WITH b AS (SELECT l_quantity AS x, l_extendedprice AS y FROM lineitem WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL),
r AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx,
             rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM b)
SELECT 'l_quantity' AS var1, 'l_extendedprice' AS var2, count(*) AS n, round(corr(rx, ry), 6) AS rho FROM r""")
def spearman(spark, d):
    return _r(st.spearman(T(spark, d, "lineitem"), "l_quantity", "l_extendedprice"), ["rho"])


@query("box_fliers", """
WITH v AS (SELECT event_type AS grp, value FROM events WHERE value IS NOT NULL),
q AS (SELECT grp, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM v GROUP BY grp)
SELECT v.grp AS "group", value FROM v JOIN q USING (grp)
WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)""")
def box_fliers(spark, d):
    """T11 detail: the points beyond the whisker fences, per group."""
    return st.fliers(T(spark, d, "events"), "value", "event_type")


@query("describe_text", """
SELECT c AS column_name, printf('%s has %d values from %.2f to %.2f; mean %.2f, median %.2f.',
       c, n, round(lo, 2), round(hi, 2), round(m, 2), round(med, 2)) AS sentence
FROM (SELECT 'o_totalprice' AS c, count(o_totalprice) AS n, min(o_totalprice) AS lo, max(o_totalprice) AS hi,
             avg(o_totalprice) AS m, quantile_cont(o_totalprice, 0.5) AS med FROM orders)""")
def describe_text(spark, d):
    return st.describe_text(st.describe(T(spark, d, "orders"), ["o_totalprice"]))


@query("t_test_text", t_test_ctes("lineitem", "l_extendedprice", "l_linestatus") + """
SELECT 'l_extendedprice' AS dependent_variable,
       printf('l_extendedprice %s significantly between F and O (t = %.2f, p = %.4f).',
              CASE WHEN p < 0.05 THEN 'differs' ELSE 'does not differ' END, t, p) AS sentence FROM tt""")
def t_test_text(spark, d):
    return st.t_test_text(st.with_t_pvalue(st.t_test(T(spark, d, "lineitem"), "l_extendedprice", "l_linestatus")))


@query("normality_text", shapiro_ctes("lineitem", "l_quantity") + """
SELECT 'l_quantity' AS variable, printf('l_quantity %s (W = %.4f, n = %d).',
       'has no Shapiro-Wilk p-value at this size', w, n) AS sentence FROM sw""")
def normality_text(spark, d):
    return st.normality_text(st.shapiro_wilk(T(spark, d, "lineitem"), "l_quantity"))
