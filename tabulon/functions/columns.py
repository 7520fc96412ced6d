"""Column expressions shared by operators.  All stay inside Spark's codegen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: a string counts as numeric if it matches this pattern
# (optional sign, digits with optional fraction, optional exponent, outer blanks).
NUMERIC_TEXT = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
                 T.DoubleType, T.DecimalType)
TEMPORAL_TYPES = (T.DateType, T.TimestampType, T.TimestampNTZType)


def q(name: str) -> Column:
    """Column by exact name (names may hold dots or spaces)."""
    return F.col(f"`{name}`")


def is_numeric(dt: T.DataType) -> bool:
    """Numbers only: booleans are nominal here."""
    return isinstance(dt, NUMERIC_TYPES)


def is_temporal(dt: T.DataType) -> bool:
    return isinstance(dt, TEMPORAL_TYPES)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_numeric(f.dataType)]


def normalise_nan(df: DataFrame) -> DataFrame:
    """NaN → null in float columns, once on entry (missing = null or NaN).  A frame that
    went through here already comes back as it is."""
    fl = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    if not fl or getattr(df, "_tabulon_no_nan", False):
        return df
    out = df.select(*[F.when(~F.isnan(q(c)), q(c)).alias(c) if c in fl else q(c)
                      for c in df.columns])
    out._tabulon_no_nan = True
    return out


def safe_div(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def pearson(x: Column, y: Column) -> Column:
    """Pearson r over rows where both are non-null; null (not an error) when a
    side is constant.  Aggregate expression."""
    both = x.isNotNull() & y.isNotNull()
    xm = F.when(both, x)
    ym = F.when(both, y)
    return F.try_divide(F.covar_samp(xm, ym), F.stddev_samp(xm) * F.stddev_samp(ym))


# Coefficients of Acklam's rational approximation of the
# standard normal quantile function (relative error below 1.15e-9).
_A = [-3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02,
      1.383577518672690e+02, -3.066479806614716e+01, 2.506628277459239e+00]
_B = [-5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02,
      6.680131188771972e+01, -1.328068155288572e+01]
_C = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e+00,
      -2.549732539343734e+00, 4.374664141464968e+00, 2.938163982698783e+00]
_D = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e+00,
      3.754408661907416e+00]
_P_LOW = 0.02425


def _horner(coefs, x):
    acc = F.lit(coefs[0])
    for c in coefs[1:]:
        acc = acc * x + F.lit(c)
    return acc


def norm_ppf(p: Column) -> Column:
    """Standard normal quantile Φ⁻¹(p) as a column expression (0 < p < 1)."""
    ql = F.sqrt(-2 * F.log(p))
    low = _horner(_C, ql) / (_horner(_D, ql) * ql + 1)
    qh = F.sqrt(-2 * F.log(1 - p))
    high = -_horner(_C, qh) / (_horner(_D, qh) * qh + 1)
    qc = p - 0.5
    r = qc * qc
    mid = _horner(_A, r) * qc / (_horner(_B, r) * r + 1)
    return F.when(p < _P_LOW, low).when(p > 1 - _P_LOW, high).otherwise(mid)


def norm_ppf_scalar(p: float) -> float:
    """Same approximation for one Python float."""
    import math
    def horner(cs, x):
        acc = cs[0]
        for c in cs[1:]:
            acc = acc * x + c
        return acc
    if p < _P_LOW:
        ql = math.sqrt(-2 * math.log(p))
        return horner(_C, ql) / (horner(_D, ql) * ql + 1)
    if p > 1 - _P_LOW:
        qh = math.sqrt(-2 * math.log(1 - p))
        return -horner(_C, qh) / (horner(_D, qh) * qh + 1)
    qc = p - 0.5
    r = qc * qc
    return horner(_A, r) * qc / (horner(_B, r) * r + 1)
