"""Descriptive statistics, correlation, t-test, normality, histograms, box stats."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.functions import distributions as dist
from tabulon.functions.columns import norm_ppf, norm_ppf_scalar, normalise_nan, numeric_columns, pearson, q
from tabulon.operators.ranking import column_quantiles, exact_quantiles, rank_rows, running_sum
from tabulon.session import local_frame, shared_table


def numeric_or_error(df: DataFrame, cols: list[str] | None, minimum: int = 1) -> list[str]:
    cols = numeric_columns(df) if not cols else cols
    if len(cols) < minimum:
        raise ValueError(f"Analysis requires at least {minimum} numeric variable(s); got {cols}")
    return cols


def moment_aggs(cols: list[str]) -> dict:
    """Row count and per-column count, mean, sample std, min and max (name →
    aggregate), shared by describe and the first pass of correlation."""
    aggs = {"_rows": F.count(F.lit(1))}
    for k, c in enumerate(cols):
        x = q(c).cast("double")
        aggs.update({f"c{k}": F.count(x), f"m{k}": F.avg(x), f"s{k}": F.stddev_samp(x),
                     f"lo{k}": F.min(x), f"hi{k}": F.max(x)})
    return aggs


DESCRIBE_PROBS = [0.25, 0.5, 0.75]


def describe(df: DataFrame, cols: list[str] | None = None, approx: bool = False) -> DataFrame:
    """Count, mean, sample std, min, 25/50/75 % (linear), max per numeric
    column, plus the table's row count (small result: one row per column)."""
    df = normalise_nan(df)
    cols = numeric_or_error(df, cols)
    # The moments ride along in the quantiles' counting pass (no scan of their own).
    row: dict = {}
    qs = column_quantiles(df, cols, DESCRIBE_PROBS, approx=approx, extra=moment_aggs(cols), extra_out=row)
    return describe_from(df.sparkSession, cols, qs, row)


def describe_from(spark, cols: list[str], quantiles: DataFrame, row: dict) -> DataFrame:
    """T1 from results already computed: :func:`column_quantiles` at
    ``DESCRIBE_PROBS`` and the values of :func:`moment_aggs`."""
    qs = {r["column_name"]: r for r in quantiles.collect()}
    none = {"q0250": None, "q0500": None, "q0750": None}     # an all-null column has no quantiles
    out = [(c, k + 1, row[f"c{k}"], row[f"m{k}"], row[f"s{k}"], row[f"lo{k}"], qs.get(c, none)["q0250"],
            qs.get(c, none)["q0500"], qs.get(c, none)["q0750"], row[f"hi{k}"], row["_rows"])
           for k, c in enumerate(cols)]
    return local_frame(spark, out, "column_name string, position int, count long, mean double, std double, "
                       "min double, p25 double, p50 double, p75 double, max double, row_count long")


def correlation(df: DataFrame, cols: list[str] | None = None, first: dict | None = None) -> DataFrame:
    """Pearson r for every ordered pair (diagonal included), pairwise
    complete, in long form.

    Per-column count, mean, min and max, then the pairwise sums of centred values
    (shifted by the column mean, so no cancellation), one aggregation per pair of
    column blocks.  A side that is constant over the pair's rows gives null, never an
    error."""
    df = normalise_nan(df)
    cols = numeric_or_error(df, cols, 2)
    x = {c: q(c).cast("double") for c in cols}
    if first is None:
        # ``first`` may come from the caller: the values of moment_aggs(cols).
        first = df.agg(F.count(F.lit(1)).alias("_rows"), *[e for k, c in enumerate(cols) for e in (
            F.count(x[c]).alias(f"c{k}"), F.avg(x[c]).alias(f"m{k}"),
            F.min(x[c]).alias(f"lo{k}"), F.max(x[c]).alias(f"hi{k}"))]).collect()[0]
    mean = {c: (first[f"m{k}"] if first[f"m{k}"] is not None else 0.0) for k, c in enumerate(cols)}
    const = {c for k, c in enumerate(cols) if first[f"lo{k}"] is not None and first[f"lo{k}"] == first[f"hi{k}"]}
    s = _pair_sums(df.select(*[x[c].alias(f"x{k}") for k, c in enumerate(cols)]), [mean[c] for c in cols],
                   [first[f"c{k}"] == first["_rows"] for k in range(len(cols))])
    out = []
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            n, sab, sa, sb, saa, sbb = s.get((i, j), (0, None, None, None, None, None))
            r = None
            if n > 1 and a not in const and b not in const and None not in (sab, sa, sb, saa, sbb):
                vaa, vbb = saa - sa * sa / n, sbb - sb * sb / n
                if vaa > 1e-12 * max(saa, 1e-300) and vbb > 1e-12 * max(sbb, 1e-300):
                    r = (sab - sa * sb / n) / math.sqrt(vaa * vbb)
                    r = max(-1.0, min(1.0, r))
            out.append((a, b, i, j, r))
    return local_frame(df.sparkSession, out, "var1 string, var2 string, i int, j int, r double")


#: Columns per block of the pairwise sums (an aggregation holds one pair of blocks).
PAIR_BLOCK = 16


def _pair_sums(df: DataFrame, means: list[float], complete: list[bool]) -> dict:
    """(i, j) → n, Σab, Σa, Σb, Σa², Σb² of centred values over rows where both are
    present.  One aggregation per pair of column blocks, which reads those columns only;
    where both columns are complete, only Σab is the pair's own."""
    k = len(means)
    d = [F.col(f"x{c}") - F.lit(means[c]) for c in range(k)]
    blocks = [range(b, min(b + PAIR_BLOCK, k)) for b in range(0, k, PAIR_BLOCK)]
    got: dict = {}
    for bi, left in enumerate(blocks):
        for right in blocks[bi:]:
            aggs = {"n": F.count(F.lit(1))}
            for c in {*left, *right}:
                aggs |= {f"s{c}": F.sum(d[c]), f"q{c}": F.sum(d[c] * d[c])}
            for i in left:
                for j in (j for j in right if j >= i):
                    aggs[f"ab{i}_{j}"] = F.sum(d[i] * d[j])
                    if not (complete[i] and complete[j]):
                        both = d[i].isNotNull() & d[j].isNotNull()
                        a, b = F.when(both, d[i]), F.when(both, d[j])
                        aggs |= {f"n{i}_{j}": F.count_if(both), f"a{i}_{j}": F.sum(a), f"b{i}_{j}": F.sum(b),
                                 f"aa{i}_{j}": F.sum(a * a), f"bb{i}_{j}": F.sum(b * b)}
            row = df.agg(*[e.alias(name) for name, e in aggs.items()]).first()
            for i in left:
                for j in (j for j in right if j >= i):
                    if complete[i] and complete[j]:
                        one = (row["n"], row[f"ab{i}_{j}"], row[f"s{i}"], row[f"s{j}"], row[f"q{i}"], row[f"q{j}"])
                    else:
                        one = tuple(row[f"{p}{i}_{j}"] for p in ("n", "ab", "a", "b", "aa", "bb"))
                    n, ab, a, b, aa, bb = one
                    got[(i, j)], got[(j, i)] = one, (n, ab, b, a, bb, aa)
    return got


def significant_correlations(corr: DataFrame, threshold: float = 0.5, strong: float = 0.7) -> DataFrame:
    """T4: pairs i<j with |r| ≥ threshold; strong at ≥ 0.7, else moderate."""
    return corr.filter((F.col("i") < F.col("j")) & (F.abs("r") >= threshold)).select(
        "var1", "var2", F.col("r").alias("correlation"),
        F.when(F.abs("r") >= strong, "strong").otherwise("moderate").alias("strength"))


def heatmap_cells(corr: DataFrame) -> DataFrame:
    """Correlation cells with a two-decimal label (colour range −1..1)."""
    return corr.select("var1", "var2", "r", F.format_string("%.2f", F.col("r")).alias("label"))


def interpretation(corr: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One templated sentence per notable pair."""
    sig = significant_correlations(corr, threshold)
    return sig.select("var1", "var2", F.format_string(
        "%s %s correlation between %s and %s (r = %.2f).",
        F.initcap("strength"), F.when(F.col("correlation") > 0, "positive").otherwise("negative"),
        F.col("var1"), F.col("var2"), F.col("correlation")).alias("sentence"))


def describe_text(described: DataFrame) -> DataFrame:
    """One templated sentence per described column."""
    return described.select("column_name", F.when(F.col("count") == 0, F.format_string(
        "%s has no values.", F.col("column_name"))).otherwise(F.format_string(
            "%s has %d values from %.2f to %.2f; mean %.2f, median %.2f.", F.col("column_name"), F.col("count"),
            F.col("min"), F.col("max"), F.col("mean"), F.col("p50"))).alias("sentence"))


def t_test_text(tested: DataFrame, alpha: float = 0.05) -> DataFrame:
    """The verdict of :func:`with_t_pvalue` as a sentence."""
    differ = F.when(F.col("p_value") < alpha, "differs").otherwise("does not differ")
    return tested.select("dependent_variable", F.when(F.col("p_value").isNull(), F.format_string(
        "%s has too few or constant values for a t-test.", F.col("dependent_variable"))).otherwise(F.format_string(
            "%s %s significantly between %s and %s (t = %.2f, p = %.4f).", F.col("dependent_variable"), differ,
            F.col("group1"), F.col("group2"), F.col("t_statistic"), F.col("p_value"))).alias("sentence"))


def normality_text(tested: DataFrame) -> DataFrame:
    """The verdict of :func:`shapiro_wilk` as a sentence."""
    verdict = (F.when(F.col("is_normal").isNull(), "has no Shapiro-Wilk p-value at this size")
               .when(F.col("is_normal"), "is compatible with a normal distribution")
               .otherwise("is not normally distributed"))
    return tested.select("variable", F.format_string("%s %s (W = %.4f, n = %d).", F.col("variable"), verdict,
                                                     F.col("statistic"), F.col("sample_size")).alias("sentence"))


# ------------------------------------------------------------------ t-test
def group_moments(df: DataFrame, dependent: str, group: str) -> DataFrame:
    """Mean, sample std, n per group (null groups and null values left out)."""
    df = normalise_nan(df)
    return (df.filter(q(group).isNotNull() & q(dependent).isNotNull())
            .groupBy(q(group).cast("string").alias("grp"))
            .agg(F.avg(q(dependent)).alias("mean"), F.stddev_samp(q(dependent)).alias("std"),
                 F.count(F.lit(1)).alias("n")))


def t_test(df: DataFrame, dependent: str, group: str) -> DataFrame:
    """Student's pooled two-sample t.  Groups are ordered by value.

    One grouped aggregation, read once: its first three group rows (by value)
    tell whether there are exactly two, and the two rows become the one-row
    result.  Raises unless there are exactly two groups."""
    g = group_moments(df, dependent, group)
    # At most three group rows reach the driver: enough to tell "exactly two".
    top = g.orderBy("grp").limit(3).collect()
    if len(top) != 2:
        k = g.count() if len(top) == 3 else len(top)
        raise ValueError(f"T-test requires exactly 2 groups, found {k}")
    two = local_frame(df.sparkSession, [(top[0]["grp"], top[0]["mean"], top[0]["std"], top[0]["n"],
                                         top[1]["grp"], top[1]["mean"], top[1]["std"], top[1]["n"])],
                      "grp1 string, mean1 double, std1 double, n1 long, grp2 string, mean2 double, std2 double, n2 long")
    a = {k: F.col(f"{k}1") for k in ("grp", "mean", "std", "n")}
    b = {k: F.col(f"{k}2") for k in ("grp", "mean", "std", "n")}
    n1, n2 = a["n"].cast("double"), b["n"].cast("double")
    # A group of one row has no deviation of its own; it adds nothing to the pooled one.
    ss = (n1 - 1) * F.coalesce(a["std"], F.lit(0.0)) ** 2 + (n2 - 1) * F.coalesce(b["std"], F.lit(0.0)) ** 2
    sp2 = F.try_divide(ss, n1 + n2 - 2)
    sp = F.sqrt(sp2)
    t = F.try_divide(a["mean"] - b["mean"], F.sqrt(sp2 * (1 / n1 + 1 / n2)))
    d = F.when(sp != 0, (a["mean"] - b["mean"]) / sp).when(sp == 0, F.lit(0.0))
    return two.select(
        F.lit(dependent).alias("dependent_variable"), F.lit(group).alias("group_variable"),
        a["grp"].alias("group1"), a["mean"].alias("mean1"), a["std"].alias("std1"), a["n"].alias("n1"),
        b["grp"].alias("group2"), b["mean"].alias("mean2"), b["std"].alias("std2"), b["n"].alias("n2"),
        t.alias("t_statistic"), (n1 + n2 - 2).alias("df"), d.alias("cohens_d"))


def _t_pvalues(batches):
    for pdf in batches:
        p = [dist.t_two_sided_p(t, d) if t == t and t is not None else None
             for t, d in zip(pdf["t_statistic"], pdf["df"])]
        pdf = pdf.assign(p_value=p)
        pdf["significant"] = pdf["p_value"].map(lambda v: None if v is None or v != v else bool(v < 0.05))
        yield pdf


def with_t_pvalue(tt: DataFrame) -> DataFrame:
    """Two-sided p-value and the 5 % verdict for each t-test row (tiny rows;
    the incomplete beta runs in a vectorised Python task)."""
    schema = T.StructType(tt.schema.fields + [T.StructField("p_value", T.DoubleType()),
                                              T.StructField("significant", T.BooleanType())])
    return tt.mapInPandas(_t_pvalues, schema)


# ------------------------------------------------------------------ normality
def jarque_bera(df: DataFrame, column: str) -> DataFrame:
    """T8 (all rows): population skewness S, excess kurtosis K,
    JB = n/6·(S² + K²/4), p = exp(−JB/2)."""
    df = normalise_nan(df)
    x = q(column).cast("double")
    m = df.filter(x.isNotNull()).agg(F.count(F.lit(1)).alias("n"), F.avg(x).alias("mean"),
                                      F.stddev_samp(x).alias("std"), F.skewness(x).alias("skewness"),
                                      F.kurtosis(x).alias("kurtosis"))
    jb = F.col("n") / 6 * (F.col("skewness") ** 2 + F.col("kurtosis") ** 2 / 4)
    return m.select(F.lit(column).alias("variable"), "n", "mean", "std", "skewness", "kurtosis",
                    jb.alias("jb_statistic"), F.exp(-jb / 2).alias("jb_p_value"))


#: Rows up to which the p-value of Shapiro–Wilk is defined.
SHAPIRO_MAX = 5000


def shapiro_wilk_parts(df: DataFrame, column: str) -> DataFrame:
    """Shapiro–Wilk W on every row (Royston's coefficients).

    Ranks come from the distributed rank operator; Σmᵢxᵢ, Σmᵢ², the four end
    values and Σ(x−x̄)² are one aggregation over the ranked rows; the end
    coefficient corrections are scalars that depend on n only."""
    x = q(column).cast("double")
    vals = df.select(x.alias("value")).filter(F.col("value").isNotNull()).withColumn("column_name", F.lit(column))
    ranked = rank_rows(vals)
    nn = F.col("n").cast("double")
    m = norm_ppf((F.col("rank") - 0.375) / (nn + 0.25))
    v = F.col("value")
    agg = ranked.agg(
        F.first("n").alias("n"), F.sum(m * v).alias("smx"), F.sum(m * m).alias("mm"),
        F.max(F.when(F.col("rank") == 1, v)).alias("x1"), F.max(F.when(F.col("rank") == 2, v)).alias("x2"),
        F.max(F.when(F.col("rank") == F.col("n") - 1, v)).alias("xn1"),
        F.max(F.when(F.col("rank") == F.col("n"), v)).alias("xn"),
        F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.var_pop(v).alias("vp"))
    return agg


def _shapiro_finish(batches):
    import math
    for pdf in batches:
        out = []
        for r in pdf.itertuples(index=False):
            n = int(r.n) if r.n == r.n else 0
            if n < 3:
                raise ValueError("A test of normality needs three values or more")
            ssq = r.vp * n
            if n == 3:
                a = [math.sqrt(0.5)]
                num = a[0] * (r.xn - r.x1)
            else:
                mn = norm_ppf_scalar((n - 0.375) / (n + 0.25))
                mn1 = norm_ppf_scalar((n - 1 - 0.375) / (n + 0.25))
                u = 1.0 / math.sqrt(n)
                # Royston (1995) polynomial corrections for the end weights.
                an = (-2.706056 * u ** 5 + 4.434685 * u ** 4 - 2.071190 * u ** 3 - 0.147981 * u ** 2
                      + 0.221157 * u + mn / math.sqrt(r.mm))
                if n > 5:
                    an1 = (-3.582633 * u ** 5 + 5.682633 * u ** 4 - 1.752461 * u ** 3 - 0.293762 * u ** 2
                           + 0.042981 * u + mn1 / math.sqrt(r.mm))
                    phi = (r.mm - 2 * mn ** 2 - 2 * mn1 ** 2) / (1 - 2 * an ** 2 - 2 * an1 ** 2)
                    inner = r.smx - (mn * r.xn - mn * r.x1) - (mn1 * r.xn1 - mn1 * r.x2)
                    num = inner / math.sqrt(phi) + an * (r.xn - r.x1) + an1 * (r.xn1 - r.x2)
                else:
                    phi = (r.mm - 2 * mn ** 2) / (1 - 2 * an ** 2)
                    inner = r.smx - (mn * r.xn - mn * r.x1)
                    num = inner / math.sqrt(phi) + an * (r.xn - r.x1)
            w = None if ssq <= 0 else min(num * num / ssq, 1.0)
            # The fit behind p holds up to SHAPIRO_MAX rows; above, Jarque–Bera applies.
            p = dist.shapiro_p(w, n) if w is not None and n <= SHAPIRO_MAX else None
            out.append((w, p, None if p is None else bool(p >= 0.05)))
        yield pdf.assign(statistic=[o[0] for o in out], p_value=[o[1] for o in out],
                         is_normal=[o[2] for o in out])[["n", "mean", "std", "statistic", "p_value", "is_normal"]]


def shapiro_wilk(df: DataFrame, column: str | None = None) -> DataFrame:
    """W, p (Royston, null above 5,000 rows), is_normal (p ≥ 0.05), n, mean, std.
    Default variable: the first numeric column."""
    column = column or numeric_or_error(df, None)[0]
    parts = shapiro_wilk_parts(normalise_nan(df), column)
    res = parts.mapInPandas(_shapiro_finish, "n long, mean double, std double, statistic double, "
                                             "p_value double, is_normal boolean")
    return res.select(F.lit(column).alias("variable"), F.col("n").alias("sample_size"), "mean", "std",
                      "statistic", "p_value", "is_normal")


# ------------------------------------------------------------------ distribution plots
def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """Equal-width bins over [min, max] (last bin closed) with density."""
    df = normalise_nan(df)
    x = q(column).cast("double")
    vals = df.select(x.alias("v")).filter(F.col("v").isNotNull())
    st = vals.agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count(F.lit(1)).alias("n"))
    lo, hi, n = st.select("lo").scalar(), st.select("hi").scalar(), st.select("n").scalar()
    width = (hi - lo) / bins
    b = F.when(width > 0, F.least(F.floor((F.col("v") - lo) / width), F.lit(bins - 1))).otherwise(F.lit(0))
    counts = vals.groupBy(b.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    return counts.select(
        "bin", (lo + F.col("bin") * width).alias("bin_start"), (lo + (F.col("bin") + 1) * width).alias("bin_end"),
        "count", F.try_divide(F.col("count"), n * width).alias("density"))


def normal_curve(df: DataFrame, column: str, points: int = 100) -> DataFrame:
    """Normal pdf with the column's mean and sd at evenly spaced points over [min, max]."""
    df = normalise_nan(df)
    x = q(column).cast("double")
    st = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi"), F.avg(x).alias("mu"), F.stddev_samp(x).alias("sd"))
    pts = st.select("*", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i"))
    xv = F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("i") / (points - 1)
    pdf = F.exp(-((xv - F.col("mu")) ** 2) / (2 * F.col("sd") ** 2)) / (F.col("sd") * F.sqrt(F.lit(2 * 3.141592653589793)))
    return pts.select("i", xv.alias("x"), pdf.alias("density"))


def box_stats(df: DataFrame, value: str, group: str | None = None, approx: bool = False) -> DataFrame:
    """Per group Q1, median, Q3, whiskers (furthest points inside 1.5·IQR), flier count."""
    df = normalise_nan(df)
    gcol = q(group).cast("string") if group else F.lit("all")
    vals = df.select(gcol.alias("grp"), q(value).cast("double").alias("value")).filter(F.col("value").isNotNull())
    qs = exact_quantiles(vals, [0.25, 0.5, 0.75], keys=("grp",), approx=approx)
    iqr = F.col("q0750") - F.col("q0250")
    fences = qs.select("grp", "n", F.col("q0250").alias("q1"), F.col("q0500").alias("median"),
                       F.col("q0750").alias("q3"), (F.col("q0250") - 1.5 * iqr).alias("lo_f"),
                       (F.col("q0750") + 1.5 * iqr).alias("hi_f"))
    # One row per group: small unless the group column is near-unique; the
    # join strategy is left to AQE, which broadcasts only after measuring it.
    j = vals.join(fences.select("grp", "lo_f", "hi_f"), "grp")
    inside = (F.col("value") >= F.col("lo_f")) & (F.col("value") <= F.col("hi_f"))
    w = j.groupBy("grp").agg(F.min(F.when(inside, F.col("value"))).alias("whisker_low"),
                             F.max(F.when(inside, F.col("value"))).alias("whisker_high"),
                             F.count_if(~inside).alias("n_fliers"))
    return fences.join(w, "grp").select(F.col("grp").alias("group"), "n", "q1", "median", "q3",
                                        "whisker_low", "whisker_high", "n_fliers")


def fliers(df: DataFrame, value: str, group: str | None = None) -> DataFrame:
    """T11 detail: the points outside the whiskers' fences."""
    df = normalise_nan(df)
    gcol = q(group).cast("string") if group else F.lit("all")
    vals = df.select(gcol.alias("grp"), q(value).cast("double").alias("value")).filter(F.col("value").isNotNull())
    b = box_stats(df, value, group)
    iqr = F.col("q3") - F.col("q1")
    f = b.select(F.col("group").alias("grp"), (F.col("q1") - 1.5 * iqr).alias("lo_f"), (F.col("q3") + 1.5 * iqr).alias("hi_f"))
    return vals.join(f, "grp").filter((F.col("value") < F.col("lo_f")) | (F.col("value") > F.col("hi_f"))) \
        .select(F.col("grp").alias("group"), "value")


# ------------------------------------------------------------------ documented-only tests
def linear_regression(df: DataFrame, y: str, x: str) -> DataFrame:
    """Least-squares line of y on x (pairs with both present): one aggregation."""
    yy, xx = q(y).cast("double"), q(x).cast("double")
    return df.agg(F.regr_count(yy, xx).alias("n"), F.regr_slope(yy, xx).alias("slope"),
                  F.regr_intercept(yy, xx).alias("intercept"), F.regr_r2(yy, xx).alias("r2")).select(
        F.lit(y).alias("dependent"), F.lit(x).alias("independent"), "n", "slope", "intercept", "r2")


def anova(df: DataFrame, value: str, group: str) -> DataFrame:
    """One-way ANOVA: between/within sums of squares and F, from one grouped
    aggregation (per-group n, mean, variance) folded into one row with plain
    sums: the grand mean is a scalar subquery over the same groups, so no
    list of groups is ever built, however many groups there are."""
    g = group_moments(df, value, group)
    grand = g.select(F.sum(F.col("mean") * F.col("n")) / F.sum("n")).scalar()
    tot = g.agg(F.sum("n").alias("N"), F.count(F.lit(1)).alias("k"),
                F.sum(F.coalesce((F.col("n") - 1) * F.col("std") ** 2, F.lit(0.0))).alias("ssw"),
                F.sum(F.col("n") * (F.col("mean") - grand) ** 2).alias("ssb"))
    out = tot.select(F.lit(value).alias("dependent"), F.lit(group).alias("group_variable"),
                     F.col("k").cast("long").alias("k"), F.col("N").cast("long").alias("n"),
                     F.col("ssb").alias("ss_between"), F.col("ssw").alias("ss_within"))
    d1, d2 = F.col("k") - 1, F.col("n") - F.col("k")
    return out.withColumn("df_between", d1.cast("double")).withColumn("df_within", d2.cast("double")).withColumn(
        "f_statistic", F.try_divide(F.col("ss_between") / d1, F.col("ss_within") / d2))


def chi_square(df: DataFrame, a: str, b: str) -> DataFrame:
    """Chi-square test of independence of two nominal columns.

    Observed cells are one grouped count; expected counts come from the
    row/column totals (windows over the contingency cells).  Absent cells
    contribute their expected count, which is N − Σ expected over present
    cells, so no cell grid (cross product) is ever built."""
    cells = (df.filter(q(a).isNotNull() & q(b).isNotNull())
             .groupBy(q(a).cast("string").alias("a"), q(b).cast("string").alias("b"))
             .agg(F.count(F.lit(1)).alias("o")))
    n = cells.select(F.sum("o")).scalar()
    ra = F.sum("o").over(Window.partitionBy("a"))
    cb = F.sum("o").over(Window.partitionBy("b"))
    e = cells.withColumn("e", ra * cb / n)
    return e.agg(F.sum((F.col("o") - F.col("e")) ** 2 / F.col("e")).alias("_present"),
                 F.sum("e").alias("_esum"), F.count_distinct("a").alias("ra"), F.count_distinct("b").alias("cb"),
                 F.sum("o").alias("n")).select(
        F.lit(a).alias("var1"), F.lit(b).alias("var2"), "n",
        (F.col("_present") + (F.col("n") - F.col("_esum"))).alias("chi2"),
        ((F.col("ra") - 1) * (F.col("cb") - 1)).cast("long").alias("dof"))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Spearman's rho: Pearson r of average ranks (ties share their mean rank).

    Equal values and equal pairs are counted first, so a value or pair that holds a
    third of the rows is one row; ranks are running sums of the value counts."""
    both = normalise_nan(df).select(q(x).cast("double").alias("x"), q(y).cast("double").alias("y")).filter(
        F.col("x").isNotNull() & F.col("y").isNotNull())
    pairs = shared_table(both.groupBy("x", "y").agg(F.count(F.lit(1)).alias("c")), "pairs")

    def avg_ranks(c):
        counts = pairs.groupBy(c).agg(F.sum("c").alias("_c"))
        upto = running_sum(counts, [c], F.col("_c"), "_upto")
        return upto.select(F.col(c).alias(f"_{c}"), (F.col("_upto") - (F.col("_c") - 1) / 2).alias(f"r{c}"))

    rx, ry = avg_ranks("x"), avg_ranks("y")
    # The mean of average ranks is (n + 1) / 2, so the sums are centred as they are built.
    mid = pairs.select(((F.sum("c") + 1) / 2).alias("m")).scalar()
    j = pairs.join(rx, F.col("x") == F.col("_x")).join(ry, F.col("y") == F.col("_y"))
    a, b = F.col("rx") - mid, F.col("ry") - mid
    return j.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.sum(F.col("c") * a * b).alias("sab"),
                 F.sum(F.col("c") * a * a).alias("saa"), F.sum(F.col("c") * b * b).alias("sbb")).select(
        F.lit(x).alias("var1"), F.lit(y).alias("var2"), "n",
        F.try_divide(F.col("sab"), F.sqrt(F.col("saa") * F.col("sbb"))).alias("rho"))


def _tail_rows(batches):
    for pdf in batches:
        p = []
        for r in pdf.itertuples(index=False):
            if r.kind == "f":
                p.append(dist.f_sf(r.stat, r.d1, r.d2))
            else:
                p.append(dist.chi2_sf(r.stat, r.d1))
        yield pdf.assign(p_value=p)


def with_tail_pvalue(df: DataFrame, kind: str, stat: str, d1: str, d2: str | None = None) -> DataFrame:
    """Upper-tail p-value of an F (``kind='f'``) or chi-square statistic per row."""
    staged = df.select("*", F.lit(kind).alias("kind"), F.col(stat).cast("double").alias("stat"),
                       F.col(d1).cast("double").alias("d1"),
                       (F.col(d2).cast("double") if d2 else F.lit(None).cast("double")).alias("d2"))
    schema = T.StructType(staged.schema.fields + [T.StructField("p_value", T.DoubleType())])
    out = staged.mapInPandas(_tail_rows, schema).drop("kind", "stat", "d1", "d2")
    return out.withColumn("significant", F.col("p_value") < 0.05)
