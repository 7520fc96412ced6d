"""Series: gaps, decomposition and anomalies against plain Python."""
import datetime as dt
import math
import statistics

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tabulon.operators import series as S

START = dt.datetime(2020, 1, 1)


def month(i):
    return dt.datetime(2020 + i // 12, i % 12 + 1, 15, 7)


def brute_parts(values, season, additive=True):
    """Trend, seasonal part and remainder of one gapless series that starts in January."""
    half, n = season // 2, len(values)
    trend = [None] * n
    for i in range(half, n - half):
        frame = values[i - half:i + half + 1]
        total = sum(frame) - ((frame[0] + frame[-1]) / 2 if season % 2 == 0 else 0)
        trend[i] = total / season
    left = {}
    for i, (v, t) in enumerate(zip(values, trend, strict=True)):
        if t is not None and (additive or t):
            left.setdefault(i % season, []).append(v - t if additive else v / t)
    raw = {k: sum(x) / len(x) for k, x in left.items()}
    mean = sum(raw.values()) / len(raw) if raw else None
    out = []
    for i, (v, t) in enumerate(zip(values, trend, strict=True)):
        s = raw.get(i % season)
        s = None if s is None else s - mean if additive else s / mean if mean else None
        rest = None if t is None or s is None else v - t - s if additive else v / (t * s) if t * s else None
        out.append((i, v, t, s, rest))
    return out


def close(a, b):
    return (a is None) == (b is None) and (a is None or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-6))


def frame(spark, rows, ddl="k string, at timestamp, v double"):
    return spark.createDataFrame(rows, ddl).repartition(3)


@pytest.mark.parametrize("model", ["additive", "multiplicative"])
def test_parts_of_several_series(spark, model):
    rows, want = [], {}
    for k, n in (("a", 40), ("b", 13), ("c", 12), ("d", 1), (None, 26)):
        values = [float(50 + i + 20 * math.sin(i * math.pi / 6) + i * i % 7) for i in range(n)]
        want[k] = brute_parts(values, 12, model == "additive")
        # Two rows to a month, one of them null where that changes nothing.
        rows += [(k, month(i), v / 2) for i, v in enumerate(values)] * 2 + [(k, month(0), None)]
    rows.append(("a", None, 1e9))
    got = S.seasonal_parts(frame(spark, rows), ["k"], "at", F.sum("v"), model=model).collect()
    assert len(got) == sum(map(len, want.values()))
    for r in got:
        w = want[r.k][r.t]
        assert all(close(a, b) for a, b in zip((r.value, r.trend, r.seasonal, r.remainder), w[1:], strict=True)), (r, w)
        assert r.season_idx == r.period.month - 1 == r.t % 12


def test_parts_of_an_odd_season_and_gaps(spark):
    days = [START + dt.timedelta(days=i, hours=i % 24) for i in range(60) if i not in (10, 11, 30)]
    rows = [("x", t, float((t - START).days % 7 * 3 + (t - START).days)) for t in days]
    value = {(t - START).days: v for _, t, v in rows}
    filled = S.seasonal_parts(frame(spark, rows), ["k"], "at", F.sum("v"), "day", 7).collect()
    want = brute_parts([value.get(i, 0.0) for i in range(60)], 7)
    assert [r.t for r in sorted(filled, key=lambda r: r.t)] == list(range(60))
    for r in filled:
        assert close(r.trend, want[r.t][2]) and close(r.value, want[r.t][1])
    # Without a filler the trend is null wherever its frame holds a gap.
    for r in S.seasonal_parts(frame(spark, rows), ["k"], "at", F.sum("v"), "day", 7, fill=None).collect():
        gap = {10, 11, 30} & set(range(r.t - 3, r.t + 4))
        assert (r.trend is None) == bool(gap or r.t < 3 or r.t > 56)


def test_a_pure_season_and_line_are_told_apart(spark):
    season = [5.0, -3, 2, -4, 6, -6, 1, -1, 3, -3, 0, 0]
    rows = [("x", month(i), 100 + 2.0 * i + season[i % 12]) for i in range(72)]
    parts = S.seasonal_parts(frame(spark, rows), ["k"], "at", F.sum("v"))
    for r in parts.collect():
        assert r.trend is None or math.isclose(r.trend, 100 + 2.0 * r.t, abs_tol=1e-9)
        assert math.isclose(r.seasonal, season[r.season_idx], abs_tol=1e-9)
    [s] = S.series_strength(parts, ["k"]).collect()
    assert (s.n_periods, s.peak_idx) == (72, 4) and math.isclose(s.slope, 2.0, abs_tol=1e-9)
    assert s.trend_strength > 0.999 and s.seasonal_strength > 0.999
    [flat] = S.series_strength(S.seasonal_parts(frame(spark, [("x", month(i), 1.0) for i in range(30)]), ["k"], "at", F.sum("v")),
                               ["k"]).collect()
    assert flat.slope == 0 and flat.trend_strength is None and flat.seasonal_strength is None and flat.peak_idx == 0


def test_series_of_nothing(spark):
    none = frame(spark, [("x", None, 1.0)])
    assert S.seasonal_parts(none, ["k"], "at", F.sum("v")).count() == 0
    assert S.series_anomalies(none, ["k"], "at", F.sum("v")).count() == 0
    with pytest.raises(ValueError):
        S.seasonal_parts(none, ["k"], "at", F.sum("v"), "decade")
    with pytest.raises(ValueError):
        S.seasonal_parts(none, ["k"], "at", F.sum("v"), model="loess")


def brute_anomalies(values, window, threshold, centred, least):
    out = []
    for i, v in enumerate(values):
        near = values[max(0, i - window):i] + (values[i + 1:i + 1 + window] if centred else [])
        near = [x for x in near if x is not None]
        if len(near) < least:
            out.append((None, None, None, False, None))
            continue
        med = statistics.median(near)
        far = [abs(x - med) for x in near]
        mad = statistics.median(far)
        unit = mad * 1.4826 if mad > 0 else sum(far) / len(far) * 1.253314
        away = None if v is None else v - med
        score = away / unit if away is not None and unit else None
        hit = away is not None and (abs(score) > threshold if unit else away != 0)
        out.append((med, mad, score, hit, ("high" if away > 0 else "low") if hit else None))
    return out


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.one_of(st.none(), st.integers(-3, 3), st.sampled_from([50, -80])), min_size=1, max_size=40),
       st.integers(1, 6), st.booleans(), st.sampled_from([0.5, 3.5]))
def test_anomalies_against_brute_force(spark, values, window, centred, threshold):
    values = [None if v is None else float(v) for v in values]
    rows = [("x", START + dt.timedelta(hours=i), v) for i, v in enumerate(values)]
    got = S.series_anomalies(frame(spark, rows), ["k"], "at", F.max("v"), "hour", window, threshold, centred=centred).collect()
    want = brute_anomalies(values, window, threshold, centred, 5)
    got.sort(key=lambda r: r.period)
    assert len(got) == len(values)
    for r, w in zip(got, want, strict=True):
        assert all(close(a, b) for a, b in zip((r["median"], r.mad, r.score), w[:3], strict=True)), (r, w)
        assert (r.is_anomaly, r.direction) == w[3:]


def test_anomalies_of_a_hot_key_and_an_absent_hour(spark):
    rows = [("hot", START + dt.timedelta(hours=h, minutes=m % 60), 1.0) for h in range(48) if h != 20 for m in range(30 if h != 33 else 300)]
    rows += [("cold", START + dt.timedelta(hours=h), 1.0) for h in range(0, 48, 2)]
    got = S.series_anomalies(frame(spark, rows), ["k"], "at", F.count(F.lit(1)), "hour", 12, fill=0.0).collect()
    odd = {(r.k, (r.period - START).total_seconds() / 3600, r.direction) for r in got if r.is_anomaly}
    assert odd == {("hot", 20.0, "low"), ("hot", 33.0, "high")}
