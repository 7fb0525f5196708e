"""Series and forecast queries (T-1 .. T-8) over the long calendar role (orders: six and a half years of days)."""

from __future__ import annotations

from pyspark.sql import functions as F

from staylens.functions.semantics import r4_decimal
from staylens.operators import forecast as T
from staylens.plans.catalog.reports import _r4all
from staylens.plans.registry import register
from staylens.sources import roles

LC = ("listings", "calendar_long")

# DuckDB: the daily mean of 2-decimal prices rounded half-up to 4 places in exact integer arithmetic
# (sum of cents S over n prices: floor((200 S + n) / 2n) / 10000), the twin of the Spark side's decimal mean.
Y4 = ("((CAST(sum(round(price * 100)) AS HUGEINT) * 200 + count(price)) // nullif(2 * count(price), 0))::DOUBLE"
      " / 10000")

_SERIES_SQL = """
tops AS (SELECT neighbourhood_cleansed AS d FROM listings WHERE neighbourhood_cleansed IS NOT NULL
         GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 5),
routed AS (SELECT 'all' AS series, c.date AS ds, c.price FROM calendar_long c
           UNION ALL
           SELECT t.d, c.date, c.price FROM calendar_long c JOIN listings l ON c.listing_id = l.id
           JOIN tops t ON l.neighbourhood_cleansed = t.d),
daily AS (SELECT series, ds, avg(price) AS y, {Y4} AS y4 FROM routed WHERE ds IS NOT NULL GROUP BY 1, 2),
cut AS (SELECT series, quantile_cont(y, 0.95) AS c FROM daily GROUP BY 1),
series AS (SELECT d.series, d.ds, d.y, d.y4 FROM daily d JOIN cut USING (series) WHERE d.y <= cut.c)""".replace(
    "{Y4}", Y4)


def _y4(df):
    return df.select("series", "ds", r4_decimal("y").alias("y"))


def _series(spark, d):
    return T.series_set(roles.calendar_long(spark, d), roles.listings(spark, d))


@register("t1_daily_price_series", roles=("calendar_long",), sql="""
WITH daily AS (SELECT date AS ds, avg(price) AS y, {Y4} AS y4 FROM calendar_long WHERE date IS NOT NULL GROUP BY 1),
cut AS (SELECT quantile_cont(y, 0.95) AS c FROM daily)
SELECT 'all' AS series, ds, y4 AS y FROM daily, cut WHERE y <= c
""".replace("{Y4}", Y4))
def t1_daily_price_series(spark, d):
    return _y4(T.daily_series(roles.calendar_long(spark, d)))


@register("t1_district_daily_series", roles=LC, sql="""
WITH top1 AS (SELECT neighbourhood_cleansed AS d FROM listings WHERE neighbourhood_cleansed IS NOT NULL
              GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
daily AS (SELECT c.date AS ds, avg(c.price) AS y, {Y4} AS y4 FROM calendar_long c
          WHERE c.listing_id IN (SELECT id FROM listings WHERE neighbourhood_cleansed = (SELECT d FROM top1))
            AND c.date IS NOT NULL GROUP BY 1),
cut AS (SELECT quantile_cont(y, 0.95) AS c FROM daily)
SELECT (SELECT d FROM top1) AS series, ds, y4 AS y FROM daily, cut WHERE y <= c
""".replace("{Y4}", Y4))
def t1_district_daily_series(spark, d):
    li = roles.listings(spark, d)
    # The largest district, kept as a one-row frame (broadcast is bounded) rather than collected to the driver.
    top = T.top_districts_by_size(li, 1).select(F.col("neighbourhood_cleansed").alias("_top"))
    ids = li.join(F.broadcast(top), F.col("neighbourhood_cleansed") == F.col("_top")).select(
        F.col("id").alias("listing_id"), "_top")
    cal = roles.calendar_long(spark, d).join(ids, "listing_id")
    return _y4(T.daily_series(cal, "_top"))


@register("t1_named_district_series", roles=LC, sql="""
WITH daily AS (SELECT c.date AS ds, avg(c.price) AS y, {Y4} AS y4 FROM calendar_long c
          WHERE c.listing_id IN (SELECT id FROM listings WHERE neighbourhood_cleansed = 'NATION_3')
            AND c.date IS NOT NULL GROUP BY 1),
cut AS (SELECT quantile_cont(y, 0.95) AS c FROM daily)
SELECT 'all' AS series, ds, y4 AS y FROM daily, cut WHERE y <= c
""".replace("{Y4}", Y4))
def t1_named_district_series(spark, d):
    """T-1 over the calendar of one named district (J-a)."""
    cal = T.district_calendar(roles.calendar_long(spark, d), roles.listings(spark, d), "NATION_3")
    return _y4(T.daily_series(cal))


@register("t2_series_set", roles=LC, sql=f"""
WITH {_SERIES_SQL.strip()}
SELECT series, ds, y4 AS y FROM series
""")
def t2_series_set(spark, d):
    return _y4(_series(spark, d))


@register("t4_future_frame", roles=LC, sql=f"""
WITH {_SERIES_SQL.strip()},
last AS (SELECT series, max(ds) AS l FROM series GROUP BY 1)
SELECT series, ds, false AS is_future FROM series
UNION ALL
SELECT series, CAST(unnest(generate_series(l + INTERVAL 1 DAY, l + INTERVAL 90 DAY, INTERVAL 1 DAY)) AS DATE),
       true FROM last
""")
def t4_future_frame(spark, d):
    return T.future_frame(_series(spark, d), 90)


@register("t5_observed_summary", roles=LC, sql=f"""
WITH {_SERIES_SQL.strip()},
tail AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY ds DESC) AS rk FROM series QUALIFY rk <= 90)
SELECT series, round(avg(y), 4) AS avg_forecast_price, round(min(y), 4) AS min_forecast_price,
       round(max(y), 4) AS max_forecast_price,
       CASE WHEN arg_max(y, ds) > arg_min(y, ds) THEN 'up' ELSE 'down' END AS trend_direction,
       round(avg(y), 4) AS price_range_lower, round(avg(y), 4) AS price_range_upper
FROM tail GROUP BY series
""")
def t5_observed_summary(spark, d):
    """T-5 applied to the observed series (yhat = y, band = y): the summary logic on data both engines share."""
    s = _series(spark, d).select("series", "ds", F.col("y").alias("yhat"), F.col("y").alias("yhat_lower"),
                                 F.col("y").alias("yhat_upper"))
    return _r4all(T.forecast_summary(s, 90))


def _forecast(spark, d):
    return T.forecast(_series(spark, d), 90)


@register("t3_forecast")
def t3_forecast(spark, d):
    """Fit every series and predict history + 90 days (model output; rows-only)."""
    fc, _ = _forecast(spark, d)
    return _r4all(fc)


# Cutoffs every 180 days from two years on, each followed by 90 days.
_RUNS_SQL = """
runs AS (SELECT series, CAST(unnest(generate_series(min(ds) + INTERVAL 730 DAY, max(ds) - INTERVAL 90 DAY, INTERVAL 180 DAY)) AS DATE) AS cutoff
         FROM series GROUP BY series),
naive AS (SELECT r.series, r.cutoff, avg(s.y) AS naive FROM runs r JOIN series s ON s.series = r.series AND s.ds <= r.cutoff GROUP BY ALL),
ahead AS (SELECT n.*, s.ds, s.y FROM naive n JOIN series s ON s.series = n.series AND s.ds > n.cutoff AND s.ds <= n.cutoff + INTERVAL 90 DAY)"""


@register("t3_backtest")
def t3_backtest(spark, d):
    """Errors and band coverage per series over rolling cutoffs (model output; rows-only)."""
    return _r4all(T.backtest_summary(T.backtest(_series(spark, d))))


@register("t3_backtest_days", roles=LC, sql=f"""
WITH {_SERIES_SQL.strip()}, {_RUNS_SQL.strip()}
SELECT series, cutoff, count(*)::BIGINT AS days, round(avg(abs(y - naive)), 4) AS naive_mae FROM ahead GROUP BY series, cutoff
""")
def t3_backtest_days(spark, d):
    """The part of the backtest that no fit decides: its cutoffs, days compared and the naive mean's error."""
    b = T.backtest(_series(spark, d), paths=2)
    return _r4all(b.groupBy("series", "cutoff").agg(
        F.count(F.lit(1)).alias("days"), F.avg(F.abs(F.col("y") - F.col("naive"))).alias("naive_mae")))


@register("t3_backtest_holds", roles=LC, sql=f"""
WITH {_SERIES_SQL.strip()}, {_RUNS_SQL.strip()}
SELECT series, count(DISTINCT cutoff)::BIGINT AS cutoffs, count(*)::BIGINT AS days, true AS covered, true AS near_naive
FROM ahead GROUP BY series
""")
def t3_backtest_holds(spark, d):
    """Bands hold 80 to 99.5 % of the days they were drawn for; the error stays within a quarter above that of the mean,
    which nothing beats on these tables' prices, as they don't depend on the day."""
    s = T.backtest_summary(T.backtest(_series(spark, d)))
    return s.select("series", "cutoffs", "days", F.col("coverage").between(0.8, 0.995).alias("covered"),
                    (F.col("mae") <= F.col("naive_mae") * 1.25).alias("near_naive"))


@register("t6_forecast_summary")
def t6_forecast_summary(spark, d):
    fc, models = _forecast(spark, d)
    return _r4all(T.summary_table(models, T.forecast_summary(fc, 90)))


@register("t7_district_forecast")
def t7_district_forecast(spark, d):
    li = roles.listings(spark, d)
    top = T.top_districts_by_size(li, 1).select(F.col("neighbourhood_cleansed").alias("series"))
    fc, _ = _forecast(spark, d)
    return _r4all(fc.join(F.broadcast(top), "series", "left_semi").select("ds", "yhat", "yhat_lower", "yhat_upper"))


@register("t8_model_table")
def t8_model_table(spark, d):
    models = T.fit_models(_series(spark, d))
    return models.select("series", "status", "reason", "training_days", "first_ds", "last_ds",
                         F.size("beta").alias("n_params"), F.round("sigma", 4).alias("sigma"))


@register("t6_summary_days", roles=LC, sql=f"""
WITH {_SERIES_SQL.strip()}
SELECT series AS neighborhood, 'ok' AS status, count(*)::BIGINT AS training_days,
       CAST(min(ds) AS VARCHAR) || ' to ' || CAST(max(ds) AS VARCHAR) AS date_range FROM series GROUP BY series
""")
def t6_summary_days(spark, d):
    """The part of T-6 that no model decides."""
    fc, models = _forecast(spark, d)
    return T.summary_table(models, T.forecast_summary(fc, 90)).select("neighborhood", "status", "training_days", "date_range")


@register("t7_series_days", roles=LC, sql=f"""
WITH {_SERIES_SQL.strip()},
last AS (SELECT max(ds) AS l FROM series WHERE series = 'all')
SELECT ds, true AS ordered FROM series WHERE series = 'all'
UNION ALL
SELECT CAST(unnest(generate_series(l + INTERVAL 1 DAY, l + INTERVAL 90 DAY, INTERVAL 1 DAY)) AS DATE), true FROM last
""")
def t7_series_days(spark, d):
    """T-7 for the whole market: its days, and that every band holds its forecast."""
    fc, _ = _forecast(spark, d)
    one = T.series_forecast(fc, T.ALL_SERIES)
    return one.select("ds", ((F.col("yhat_lower") <= F.col("yhat")) & (F.col("yhat") <= F.col("yhat_upper"))).alias("ordered"))


@register("t8_model_days", roles=LC, sql=f"""
WITH {_SERIES_SQL.strip()}
SELECT series, 'ok' AS status, count(*)::BIGINT AS training_days, min(ds) AS first_ds, max(ds) AS last_ds
FROM series GROUP BY series
""")
def t8_model_days(spark, d):
    """The part of T-8 that no fit decides."""
    return T.fit_models(_series(spark, d)).select("series", "status", "training_days", "first_ds", "last_ds")
