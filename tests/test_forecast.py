import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from staylens.operators import forecast as T


def _series(spark, days, fn, name="s"):
    start = dt.date(2020, 1, 1)
    rows = [(name, start + dt.timedelta(days=i), float(fn(i, start + dt.timedelta(days=i)))) for i in range(days)]
    return spark.createDataFrame(rows, "series string, ds date, y double")


def test_recovers_noiseless_multiplicative_series(spark):
    def fn(i, d):
        epoch = (d - dt.date(1970, 1, 1)).days
        trend = 100.0 * (1 + 0.0005 * i)
        weekly = 1 + 0.1 * math.sin(2 * math.pi * epoch / 7.0)
        yearly = 1 + 0.2 * math.cos(2 * math.pi * epoch / 365.25)
        return trend * weekly * yearly

    s = _series(spark, 3 * 365, fn)
    fc, models = T.forecast(s, horizon=30)
    m = models.collect()[0]
    assert m.status == "ok" and m.multiplicative
    pdf = fc.where(~F.col("is_future")).join(s, ["series", "ds"]).toPandas()
    rel = np.abs(pdf.yhat / pdf.y - 1)
    assert rel.max() < 0.02
    fut = fc.where(F.col("is_future")).toPandas().sort_values("ds")
    assert len(fut) == 30
    truth = np.array([fn(3 * 365 + k, dt.date(2020, 1, 1) + dt.timedelta(days=3 * 365 + k)) for k in range(30)])
    assert np.abs(fut.yhat.to_numpy() / truth - 1).max() < 0.05
    assert (fut.yhat_lower <= fut.yhat).all() and (fut.yhat <= fut.yhat_upper).all()


def test_flat_series_and_short_series(spark):
    flat = _series(spark, 60, lambda i, d: 50.0, "flat")
    short = _series(spark, 5, lambda i, d: 10.0 + i, "short")
    single = _series(spark, 1, lambda i, d: 10.0, "single")
    fc, models = T.forecast(flat.unionByName(short).unionByName(single), horizon=7)
    ms = {r.series: r for r in models.collect()}
    assert ms["single"].status == "skipped" and "1 days" in ms["single"].reason
    assert ms["flat"].status == ms["short"].status == "ok"
    vals = fc.where(F.col("series") == "flat").select("yhat").toPandas().yhat
    assert np.allclose(vals, 50.0, rtol=1e-6)
    assert fc.where(F.col("series") == "short").count() == 12
    assert fc.where(F.col("series") == "single").count() == 0
    summ = T.summary_table(models, T.forecast_summary(fc, 90)).collect()
    by = {r.neighborhood: r for r in summ}
    assert by["single"].avg_price is None and by["flat"].trend in ("up", "down") and by["short"].trend == "up"
    assert abs(by["flat"].avg_price - 50.0) < 1e-6


def test_sparse_trend_solves_the_penalised_problem():
    rng = np.random.default_rng(0)
    n = 400
    t = np.linspace(0, 1, n)
    rest = np.column_stack([np.ones(n), t, np.sin(t * 50), np.cos(t * 50)])
    hinges = np.column_stack([np.maximum(t - c, 0) for c in np.linspace(0.05, 0.8, 16)])
    y = 0.3 * t + 0.2 * rest[:, 2] + 1.5 * hinges[:, 4] - 2 * hinges[:, 10] + rng.normal(0, 0.02, n)
    coef, delta, sd = T.sparse_trend(y, rest, np.zeros(4), hinges, 0.05)
    assert 0.017 < sd < 0.024
    # Optimality: the residual is orthogonal to the free columns, and a hinge's correlation is the penalty where the
    # coefficient isn't zero and at most that where it is.
    left = y - rest @ coef - hinges @ delta
    pull, penalty = hinges.T @ left, sd * sd / 0.05
    assert np.abs(rest.T @ left).max() < 1e-6
    assert np.abs(pull).max() <= penalty * 1.01 + 1e-6
    assert np.allclose(pull[delta != 0], penalty * np.sign(delta[delta != 0]), rtol=0.02, atol=1e-6)
    assert 2 <= np.count_nonzero(delta) <= 8


def test_bands_widen_after_trend_changes_and_reruns_agree(spark):
    rng = np.random.default_rng(4)
    bends = np.cumsum(np.where(np.arange(1000) % 150 == 0, rng.normal(0, 0.004, 1000), 0))
    level = np.exp(4 + np.cumsum(bends) + rng.normal(0, 0.02, 1000))
    still = np.exp(4 + rng.normal(0, 0.02, 1000))
    s = _series(spark, 1000, lambda i, d: level[i], "bent").unionByName(_series(spark, 1000, lambda i, d: still[i], "still"))
    fc, _ = T.forecast(s, horizon=120)
    rows = fc.where("is_future").withColumn("width", F.log(F.col("yhat_upper") / F.col("yhat_lower"))).orderBy("ds").collect()
    width = {n: [r.width for r in rows if r.series == n] for n in ("bent", "still")}
    assert np.mean(width["bent"][-10:]) > 2 * np.mean(width["bent"][:10])
    assert np.mean(width["still"][-10:]) < 1.5 * np.mean(width["still"][:10])
    again, _ = T.forecast(s.repartition(3), horizon=120)
    keyed = lambda df: {(r.series, r.ds): (round(r.yhat_lower, 9), round(r.yhat_upper, 9)) for r in df.where("is_future").collect()}
    assert keyed(fc) == keyed(again)


def test_backtest_covers_made_series(spark):
    rng = np.random.default_rng(1)
    n = 4 * 365
    made = {}
    for name, trend in (("flat", 0.0), ("rising", 0.0004), ("falling", -0.0003)):
        made[name] = [100 * math.exp(trend * i + 0.1 * math.sin(2 * math.pi * i / 365.25) + 0.05 * math.sin(2 * math.pi * i / 7)
                                     + e) for i, e in enumerate(rng.normal(0, 0.05, n))]
    s = None
    for name, y in made.items():
        one = _series(spark, n, lambda i, d: y[i], name)
        s = one if s is None else s.unionByName(one)
    scored = T.backtest(s, horizon=60, initial=800, period=120)
    assert scored.where("ds <= cutoff or datediff(ds, cutoff) > 60").count() == 0
    out = {r.series: r for r in T.backtest_summary(scored).collect()}
    assert set(out) == set(made)
    for r in out.values():
        assert r.cutoffs == 5 and r.days == 300
        assert 0.80 <= r.coverage <= 0.98 and r.mape < 0.08, r
    assert out["rising"].mae < out["rising"].naive_mae / 2
    assert T.backtest(s.where("ds < '2020-03-01'")).count() == 0


def test_empty_series_yields_no_model(spark):
    empty = spark.createDataFrame([], "series string, ds date, y double")
    fc, models = T.forecast(empty)
    assert models.count() == 0 and fc.count() == 0


def test_daily_series_q95_cut_and_null_days(spark):
    cal = spark.createDataFrame(
        [(1, dt.date(2024, 1, d), float(d)) for d in range(1, 21)] + [(2, None, 5.0), (3, dt.date(2024, 1, 21), None)],
        "listing_id long, date date, price double")
    out = T.daily_series(cal).orderBy("ds").collect()
    # 20 priced days; q95 of 1..20 is 19.05, so day 20 is cut; the null-price day has no mean and is dropped.
    assert [r.y for r in out] == [float(d) for d in range(1, 20)]
