"""Daily price series and per-series forecasts (T-1 .. T-8).

The series set is built in one pass: each calendar row is routed to the whole-market series and, when its listing
lies in one of the top districts, to that district's series (``explode`` of at most two keys), then averaged per
(series, day) with map-side partial aggregation. A series has one row per day, so its size is bounded by the
calendar's date range, not by the data volume; that is what lets the fit run per series in Python.

The model is an additive regression on log price (so effects multiply, as in a multiplicative seasonal model):
piecewise-linear trend with candidate changepoints in the first 80 % of the history plus Fourier terms for the cycles that
the history spans at least once. Trend changes have a Laplace prior, that is an L1 penalty, so most of them are exactly
zero: the other terms are projected out, and coordinate descent on the small Gram matrix of the changepoints finds them
together with the noise level. The model is fitted per series with NumPy inside ``applyInPandas`` and stored as a
coefficient table (one row per series). Prediction is a native Spark expression: the design row is rebuilt from the date and
dotted with the coefficients, so scoring any number of dates is a join, not Python.

The 95 % band of a day in the history is the fitted value and 1.96 residual sd. Beyond the history the trend may change
again, as often and by as much as it did: ``simulate_bands`` draws such changes and the noise from hashes of (series, path,
day), adds them up along each path natively and takes the quantiles over the paths, so bands widen with the horizon
and reruns agree. ``backtest`` refits every series at cutoffs rolling through its history, all (series, cutoff) pairs as
series of one job, and compares the days after each cutoff with what was forecast there.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from staylens.functions.semantics import checkpointed, quantiles

ALL_SERIES = "all"
HORIZON = 90
MIN_DAYS = 2  # a line needs two days; the weekly cycle is fitted from two weeks on
MONEY_SCALE = 10
Z95 = 1.959963984540054
CHANGEPOINTS = 25
CHANGEPOINT_RANGE = 0.8
CHANGEPOINT_SCALE = 0.05  # of the Laplace prior, for a target scaled to at most one and time to the history's length
SEASONAL_RIDGE = 1e-6
PATHS = 400  # simulated futures per series
# Seasonal cycles (fixed values): (name, period in days, Fourier order).
SEASONALITIES = (("yearly", 365.25, 10), ("weekly", 7.0, 3), ("monthly", 30.5, 5))
EPOCH = "1970-01-01"
BACKTEST_INITIAL = 730
BACKTEST_PERIOD = 180

MODEL_SCHEMA = T.StructType([
    T.StructField("series", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("reason", T.StringType()),
    T.StructField("training_days", T.LongType()),
    T.StructField("first_ds", T.DateType()),
    T.StructField("last_ds", T.DateType()),
    T.StructField("span_days", T.DoubleType()),
    T.StructField("multiplicative", T.BooleanType()),
    T.StructField("changepoints", T.ArrayType(T.DoubleType())),
    T.StructField("beta", T.ArrayType(T.DoubleType())),
    T.StructField("sigma", T.DoubleType()),
    T.StructField("changes_per_day", T.DoubleType()),
    T.StructField("change_scale", T.DoubleType()),
])


# --- T-1 / T-2: series preparation ------------------------------------------------------------------------------

def daily_series(calendar: DataFrame, series: str | F.Column | None = None, date="date", price="price",
                 cut_q: float | None = 0.95, money_scale: int | None = MONEY_SCALE, **qkw) -> DataFrame:
    """T-1: mean price per (series, day); days above the series' ``cut_q`` quantile (and days without a mean) are
    dropped. Null days are dropped before grouping (pandas drops null group keys).

    With ``money_scale`` the mean is taken over decimals of that scale (ten places by default, more than prices
    have), so a day's value does not depend on the order partitions are summed in; None averages doubles."""
    ptype = "double" if money_scale is None else f"decimal(28,{money_scale})"
    s = F.lit(ALL_SERIES) if series is None else series if isinstance(series, F.Column) else F.col(series)
    daily = (calendar.where(F.col(date).isNotNull()).select(s.alias("series"), F.col(date).alias("ds"),
                                                             F.col(price).cast(ptype).alias("_p"))
             .where(F.col("series").isNotNull())
             .groupBy("series", "ds").agg(F.avg("_p").cast("double").alias("y")))
    if cut_q is None:
        return daily.where(F.col("y").isNotNull())
    q = quantiles(daily, "y", [cut_q], ["series"], ["_cut"], **qkw)
    return daily.join(q, "series").where(F.col("y") <= F.col("_cut")).drop("_cut")


def district_calendar(calendar: DataFrame, listings: DataFrame, district: str, listing_id="listing_id",
                      district_col="neighbourhood_cleansed", id_col="id") -> DataFrame:
    """J-a: calendar rows of the listings in one district (semi join; ids are never collected)."""
    ids = listings.where(F.col(district_col) == district).select(F.col(id_col).alias(listing_id))
    return calendar.join(ids, listing_id, "left_semi")


def top_districts_by_size(listings: DataFrame, n: int = 5, district_col="neighbourhood_cleansed") -> DataFrame:
    """A-19: the n districts with most listings (ties by name)."""
    return (listings.where(F.col(district_col).isNotNull()).groupBy(district_col)
            .agg(F.count(F.lit(1)).alias("listings"))
            .orderBy(F.col("listings").desc(), F.col(district_col)).limit(n))


def series_set(calendar: DataFrame, listings: DataFrame, top: int = 5, listing_id="listing_id",
               district_col="neighbourhood_cleansed", id_col="id", **kw) -> DataFrame:
    """T-2: the whole-market series plus one per top district, in one grouped frame (series, ds, y)."""
    tops = top_districts_by_size(listings, top, district_col).select(F.col(district_col).alias("_top"))
    # The top-district frame has at most ``top`` rows, so broadcasting it is bounded.
    li = (listings.select(F.col(id_col).alias(listing_id), F.col(district_col).alias("_d"))
          .join(F.broadcast(tops), F.col("_d") == F.col("_top"), "inner").select(listing_id, "_top"))
    routed = calendar.join(li, listing_id, "left").withColumn(
        "_series", F.explode(F.array_compact(F.array(F.lit(ALL_SERIES), F.col("_top")))))
    return daily_series(routed, "_series", **kw)


# --- T-3 / T-8: fit, model table, native scoring ----------------------------------------------------------------

def _fourier(days: np.ndarray) -> list[np.ndarray]:
    cols = []
    for _, period, order in SEASONALITIES:
        for k in range(1, order + 1):
            ang = 2.0 * math.pi * k * days / period
            cols.append(np.sin(ang))
            cols.append(np.cos(ang))
    return cols


def _design(tt: np.ndarray, days: np.ndarray, cps: Sequence[float]) -> np.ndarray:
    cols = [np.ones_like(tt), tt] + [np.maximum(tt - c, 0.0) for c in cps] + _fourier(days)
    return np.column_stack(cols)


def sparse_trend(target: np.ndarray, rest: np.ndarray, ridge: np.ndarray, hinges: np.ndarray,
                 scale: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Least squares of ``target`` on ``rest`` (ridge per column) and ``hinges`` under a Laplace prior of ``scale``.

    Returns both coefficient vectors and the residual sd. With ``rest`` projected out, only the hinges' Gram matrix is
    left, on which coordinate descent solves the L1 problem; its penalty is the noise variance over the prior's scale, so
    both are found in turns."""
    project = np.linalg.solve(rest.T @ rest + np.diag(ridge), rest.T)
    y = target - rest @ (project @ target)
    free = hinges - rest @ (project @ hinges)
    gram, cross = hinges.T @ free, hinges.T @ y
    delta = np.zeros(hinges.shape[1])
    spare = len(target) - rest.shape[1]
    variance = float(y @ y) / max(spare, 1)
    for _ in range(20):
        penalty = variance / scale
        for _ in range(2000):
            moved = 0.0
            for j in range(len(delta)):
                if gram[j, j] < 1e-10:
                    continue
                z = cross[j] - gram[j] @ delta + gram[j, j] * delta[j]
                new = math.copysign(max(abs(z) - penalty, 0.0), z) / gram[j, j]
                moved = max(moved, abs(new - delta[j]))
                delta[j] = new
            if moved < 1e-9:
                break
        left = y - free @ delta
        now = float(left @ left) / max(spare - np.count_nonzero(delta), 1)
        if abs(now - variance) <= 1e-6 * variance:
            break
        variance = now
    return project @ (target - hinges @ delta), delta, math.sqrt(now)


def _fit_one(key, pdf: pd.DataFrame, min_days: int, n_cp: int, cp_range: float, scale: float) -> pd.DataFrame:
    series = key[0]
    pdf = pdf.dropna(subset=["ds", "y"]).sort_values("ds")
    n = len(pdf)
    base = {f.name: None for f in MODEL_SCHEMA} | {"series": series, "training_days": n}
    if n < max(min_days, 2):
        return pd.DataFrame([{**base, "status": "skipped",
                              "reason": f"{n} days of history; at least {max(min_days, 2)} needed"}])
    ds = pd.to_datetime(pdf["ds"]).to_numpy()
    first, last = ds[0], ds[-1]
    span = max(float((last - first) / np.timedelta64(1, "D")), 1.0)
    tt = ((ds - first) / np.timedelta64(1, "D")).astype(float) / span
    days = ((ds - np.datetime64(EPOCH)) / np.timedelta64(1, "D")).astype(float)
    y = pdf["y"].to_numpy(dtype=float)
    mult = bool((y > 0).all())
    target = np.log(y) if mult else y
    hist = int(math.floor(cp_range * (n - 1)))
    k = min(n_cp, max(hist - 1, 0))
    idx = np.unique(np.linspace(0, hist, k + 2).round().astype(int)[1:-1]) if k > 0 else np.array([], dtype=int)
    cps = [float(tt[i]) for i in idx]
    X = _design(tt, days, cps)
    # Coefficients of terms that aren't fitted are zero: cycles that the history doesn't span, and, with fewer days
    # than terms, all but the line and from two weeks on the weekly cycle.
    line, cycles = [0, 1], []
    at = 2 + len(cps)
    for name, period, order in SEASONALITIES:
        if span + 1 >= period and (n >= X.shape[1] or (name == "weekly" and n >= 14)):
            cycles += range(at, at + 2 * order)
        at += 2 * order
    hinges = list(range(2, 2 + len(cps))) if n >= X.shape[1] else []
    rest = line + cycles
    middle = target.mean()
    size = float(np.abs(target - middle).max()) or 1.0
    coef, delta, sd = sparse_trend((target - middle) / size, X[:, rest],
                                   np.array([0.0, 0.0] + [SEASONAL_RIDGE] * len(cycles)), X[:, hinges], scale)
    beta = np.zeros(X.shape[1])
    beta[rest] = coef * size
    beta[hinges] = delta * size
    beta[0] += middle
    return pd.DataFrame([{**base, "status": "ok",
                          "first_ds": pd.Timestamp(first).date(), "last_ds": pd.Timestamp(last).date(),
                          "span_days": span, "multiplicative": mult, "changepoints": cps,
                          "beta": [float(b) for b in beta], "sigma": sd * size,
                          "changes_per_day": len(hinges) / span,
                          "change_scale": float(np.abs(delta).mean()) * size if hinges else 0.0}])


def fit_models(series: DataFrame, min_days: int = MIN_DAYS, changepoints: int = CHANGEPOINTS,
               changepoint_range: float = CHANGEPOINT_RANGE, changepoint_scale: float = CHANGEPOINT_SCALE) -> DataFrame:
    """T-3 (fit) / T-8 (model table): one coefficient row per series; series with too little history get
    ``status='skipped'`` and a reason instead of coefficients."""

    def fit(key, pdf):
        return _fit_one(key, pdf, min_days, changepoints, changepoint_range, changepoint_scale)

    return series.select("series", "ds", "y").groupBy("series").applyInPandas(fit, MODEL_SCHEMA)


def future_frame(series: DataFrame, horizon: int = HORIZON) -> DataFrame:
    """T-4: every history day of each series plus ``horizon`` days after its last one (is_future flags them)."""
    hist = series.select("series", "ds", F.lit(False).alias("is_future"))
    last = series.groupBy("series").agg(F.max("ds").alias("_last"))
    fut = last.select("series", F.explode(F.sequence(F.date_add("_last", 1), F.date_add("_last", horizon)))
                      .alias("ds"), F.lit(True).alias("is_future"))
    return hist.unionByName(fut)


def _fourier_cols(days: F.Column) -> list[F.Column]:
    cols = []
    for _, period, order in SEASONALITIES:
        for k in range(1, order + 1):
            ang = days * (2.0 * math.pi * k / period)
            cols += [F.sin(ang), F.cos(ang)]
    return cols


def _uniform(*parts) -> F.Column:
    """A number in (0, 1) from a hash of the parts: the same in every run and task."""
    return (F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") + 0.5) / float(1 << 53)


def simulate_bands(models: DataFrame, horizons: DataFrame, paths: int = PATHS, coverage: float = 0.95) -> DataFrame:
    """``series, ahead, dev_lower, dev_upper``: by how much the days after the history may leave the fitted trend.

    ``horizons`` holds ``series, most`` (days ahead). Each of ``paths`` futures draws a trend change per day with the fitted rate and
    a Laplace size of the fitted scale, adds them up twice (slope, then level) and draws that day's noise. Windows are
    per path, quantiles per (series, day) over ``paths`` numbers, so no series is one task's work."""
    rows = (models.where(F.col("status") == "ok").join(horizons, "series").where(F.col("most") > 0)
            .select("series", "span_days", "sigma", "changes_per_day", "change_scale", "most",
                    F.explode(F.sequence(F.lit(1), F.lit(paths))).alias("path"))
            .withColumn("ahead", F.explode(F.sequence(F.lit(1), "most"))))
    draw = lambda name: _uniform("series", "path", "ahead", F.lit(name))
    side = draw("size") - 0.5
    size = -F.col("change_scale") * F.signum(side) * F.log(1 - 2 * F.abs(side))
    change = F.when(draw("change") < F.col("changes_per_day"), size).otherwise(0.0)
    noise = F.sqrt(-2 * F.log(draw("radius"))) * F.cos(draw("angle") * (2 * math.pi)) * F.col("sigma")
    path = Window.partitionBy("series", "path").orderBy("ahead")
    upto, before = (path.rowsBetween(Window.unboundedPreceding, k) for k in (0, -1))
    walked = rows.withColumn("slope", F.sum(change).over(upto)).withColumn(
        "dev", F.coalesce(F.sum("slope").over(before), F.lit(0.0)) / F.col("span_days") + noise)
    tail = (1 - coverage) / 2
    return walked.groupBy("series", "ahead").agg(F.percentile("dev", F.array(F.lit(tail), F.lit(1 - tail))).alias("q")).select(
        "series", "ahead", F.col("q")[0].alias("dev_lower"), F.col("q")[1].alias("dev_upper"))


def predict(models: DataFrame, dates: DataFrame, z: float = Z95, paths: int = PATHS) -> DataFrame:
    """T-3 (predict): score (series, ds) rows with the model of their series, natively. The model table has one
    row per series, so it is joined on the series key (broadcast by AQE when small)."""
    ok = models.where(F.col("status") == "ok")
    ahead = F.datediff("ds", "last_ds")
    j = dates.join(ok, "series").withColumn("ahead", ahead)
    horizons = dates.join(ok.select("series", "last_ds"), "series").groupBy("series").agg(F.max(ahead).alias("most"))
    bands = simulate_bands(models, horizons, paths, math.erf(z / math.sqrt(2)))
    tt = F.datediff("ds", "first_ds").cast("double") / F.col("span_days")
    days = F.datediff("ds", F.lit(EPOCH).cast("date")).cast("double")
    feats = F.concat(F.array(F.lit(1.0), tt), F.transform("changepoints", lambda c: F.greatest(tt - c, F.lit(0.0))),
                     F.array(*_fourier_cols(days)))
    mu = F.aggregate(F.zip_with(feats, "beta", lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x)
    names = [c for c in dates.columns if c not in ("series", "ds")]
    out = j.select("series", "ds", *names, mu.alias("_mu"), "sigma", "multiplicative", "ahead").join(
        bands, ["series", "ahead"], "left")
    band = z * F.col("sigma")
    lower = F.least(F.coalesce("dev_lower", -band), F.lit(0.0))
    upper = F.greatest(F.coalesce("dev_upper", band), F.lit(0.0))
    back = lambda c: F.when(F.col("multiplicative"), F.exp(c)).otherwise(c)
    return out.select("series", "ds", *names, back(F.col("_mu")).alias("yhat"),
                      back(F.col("_mu") + lower).alias("yhat_lower"), back(F.col("_mu") + upper).alias("yhat_upper"))


def forecast(series: DataFrame, horizon: int = HORIZON, **fit_kw) -> tuple[DataFrame, DataFrame]:
    """T-3: fit every series and predict its history plus ``horizon`` days. Returns (forecast, models).

    Series (one row per series and day) and models (one row per series) are computed once."""
    series = checkpointed(series.select("series", "ds", "y"))
    models = checkpointed(fit_models(series, **fit_kw))
    return predict(models, future_frame(series, horizon)), models


# --- T-3: rolling-origin backtest ---------------------------------------------------------------------------------

def backtest_cutoffs(series: DataFrame, horizon: int = HORIZON, initial: int = BACKTEST_INITIAL,
                     period: int = BACKTEST_PERIOD) -> DataFrame:
    """``series, cutoff``: days every ``period`` from ``initial`` days after a series' first day, as long as ``horizon`` days
    follow."""
    ends = series.groupBy("series").agg(F.date_add(F.min("ds"), initial).alias("_from"),
                                        F.date_sub(F.max("ds"), horizon).alias("_to"))
    return ends.where(F.col("_from") <= F.col("_to")).select(
        "series", F.explode(F.sequence("_from", "_to", F.expr(f"interval {period} days"))).alias("cutoff"))


def backtest(series: DataFrame, horizon: int = HORIZON, initial: int = BACKTEST_INITIAL, period: int = BACKTEST_PERIOD,
             paths: int = PATHS, **fit_kw) -> DataFrame:
    """``series, cutoff, ds, y, yhat, yhat_lower, yhat_upper, naive``: for each cutoff the ``horizon`` days after it, forecast
    from the days up to it; ``naive`` is the mean of those days.

    A cutoff's history is a series of its own, so all fits are one grouped job; a day is copied once per later cutoff."""
    series = checkpointed(series.select("series", "ds", "y").where(F.col("ds").isNotNull() & F.col("y").isNotNull()))
    runs = checkpointed(backtest_cutoffs(series, horizon, initial, period).withColumn(
        "run", F.concat_ws("@", "series", F.col("cutoff").cast("string"))))
    rows = series.join(runs, "series").where(F.col("ds") <= F.date_add("cutoff", horizon))
    past = F.col("ds") <= F.col("cutoff")
    history = rows.where(past).select(F.col("run").alias("series"), "ds", "y")
    models = checkpointed(fit_models(history, **fit_kw))
    naive = rows.where(past).groupBy("run").agg(F.avg("y").alias("naive"))
    ahead = rows.where(~past).join(naive, "run").select(F.col("run").alias("series"), "ds", "y", "cutoff", "naive",
                                                      F.col("series").alias("_name"))
    return predict(models, ahead, paths=paths).select(
        F.col("_name").alias("series"), "cutoff", "ds", "y", "yhat", "yhat_lower", "yhat_upper", "naive")


def backtest_summary(scored: DataFrame) -> DataFrame:
    """Per series: cutoffs and days compared, mean absolute error (also relative, and of the naive mean), root mean squared
    error, and the share of days inside the band."""
    miss = F.abs(F.col("y") - F.col("yhat"))
    return scored.groupBy("series").agg(
        F.count_distinct("cutoff").alias("cutoffs"), F.count(F.lit(1)).alias("days"), F.avg(miss).alias("mae"),
        F.avg(F.when(F.col("y") != 0, miss / F.abs("y"))).alias("mape"), F.sqrt(F.avg(miss * miss)).alias("rmse"),
        F.avg(F.abs(F.col("y") - F.col("naive"))).alias("naive_mae"),
        F.avg(F.when(F.col("y").between(F.col("yhat_lower"), F.col("yhat_upper")), 1.0).otherwise(0.0)).alias("coverage"))


# --- T-5 / T-6 / T-7: summaries -----------------------------------------------------------------------------------

def forecast_summary(fc: DataFrame, last_n: int = HORIZON) -> DataFrame:
    """T-5: over each series' last ``last_n`` rows by date: mean / min / max yhat, trend (last > first: up),
    mean lower and upper bound."""
    # The names of the columns are fixed values.
    w = Window.partitionBy("series").orderBy(F.col("ds").desc())
    tail = fc.withColumn("_rk", F.row_number().over(w)).where(F.col("_rk") <= last_n)
    return tail.groupBy("series").agg(
        F.avg("yhat").alias("avg_forecast_price"), F.min("yhat").alias("min_forecast_price"),
        F.max("yhat").alias("max_forecast_price"),
        F.when(F.max_by("yhat", "ds") > F.min_by("yhat", "ds"), "up").otherwise("down").alias("trend_direction"),
        F.avg("yhat_lower").alias("price_range_lower"), F.avg("yhat_upper").alias("price_range_upper"))


def summary_table(models: DataFrame, summary: DataFrame) -> DataFrame:
    """T-6: one row per series: training days and date range from the model table, the T-5 figures, and the
    reason when a series was not fitted."""
    return models.select("series", "status", "reason", "training_days", "first_ds", "last_ds").join(
        summary, "series", "left").select(
        F.col("series").alias("neighborhood"), "status", "reason", "training_days",
        F.concat_ws(" to ", F.col("first_ds").cast("string"), F.col("last_ds").cast("string")).alias("date_range"),
        F.col("avg_forecast_price").alias("avg_price"), F.col("trend_direction").alias("trend"),
        F.col("price_range_lower").alias("price_lower"), F.col("price_range_upper").alias("price_upper"))


def series_forecast(fc: DataFrame, name: str) -> DataFrame:
    """T-7: the ds, yhat, yhat_lower, yhat_upper columns of one series."""
    return fc.where(F.col("series") == name).select("ds", "yhat", "yhat_lower", "yhat_upper")


def save_models(models: DataFrame, path: str) -> None:
    """T-8: the model table is data: write it as Parquet (one row per series)."""
    models.write.mode("overwrite").parquet(path)


def load_models(spark, path: str) -> DataFrame:
    return spark.read.schema(MODEL_SCHEMA).parquet(path)
