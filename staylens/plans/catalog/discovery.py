"""Discovery queries (I-1 .. I-6) over the listings role."""

from __future__ import annotations

from pyspark.sql import functions as F

from staylens.functions.semantics import r4
from staylens.operators import discovery as D
from staylens.plans.registry import register
from staylens.sources import roles


_I1 = """
SELECT neighbourhood_cleansed, round(mean, 4) AS mean, round(median, 4) AS median, count,
       round(skew_ratio, 4) AS skew_ratio
FROM (
  SELECT neighbourhood_cleansed, avg(price) AS mean, median(price) AS median, count(price)::BIGINT AS count,
         (avg(price) - median(price)) / median(price) AS skew_ratio
  FROM listings WHERE price IS NOT NULL AND neighbourhood_cleansed IS NOT NULL
  GROUP BY neighbourhood_cleansed HAVING count(price) >= 20
) ORDER BY skew_ratio DESC NULLS LAST, neighbourhood_cleansed LIMIT 8
"""


@register("i1_price_anomalies", roles=("listings",), headline=True, sql=_I1)
def i1_price_anomalies(spark, d):
    t = D.price_anomalies(roles.listings(spark, d))
    return t.select("neighbourhood_cleansed", r4("mean").alias("mean"), r4("median").alias("median"), "count",
                    r4("skew_ratio").alias("skew_ratio"))


_I2 = """
WITH base AS (SELECT * FROM listings WHERE price IS NOT NULL AND review_scores_rating IS NOT NULL),
med AS (SELECT median(price) AS med_price, median(review_scores_rating) AS med_rating FROM base),
gems AS (SELECT b.*, m.med_price, m.med_rating FROM base b, med m
         WHERE b.price < m.med_price AND b.review_scores_rating >= m.med_rating)
SELECT neighbourhood_cleansed, count(id)::BIGINT AS count, round(avg(price), 4) AS avg_price,
       round(avg(review_scores_rating), 4) AS avg_rating, round(any_value(med_price), 4) AS med_price,
       round(any_value(med_rating), 4) AS med_rating, (SELECT count(*) FROM gems)::BIGINT AS total_gems
FROM gems WHERE neighbourhood_cleansed IS NOT NULL
GROUP BY neighbourhood_cleansed ORDER BY count DESC, neighbourhood_cleansed LIMIT 12
"""


@register("i2_value_gems", roles=("listings",), headline=True, sql=_I2)
def i2_value_gems(spark, d):
    t = D.value_gems(roles.listings(spark, d))
    return t.select("neighbourhood_cleansed", "count", r4("avg_price").alias("avg_price"),
                    r4("avg_rating").alias("avg_rating"), r4("med_price").alias("med_price"),
                    r4("med_rating").alias("med_rating"), "total_gems")


_I3 = """
WITH grid AS (
  SELECT neighbourhood_cleansed, room_type, count(id)::BIGINT AS supply, avg(review_scores_rating) AS avg_rating
  FROM listings
  WHERE neighbourhood_cleansed IS NOT NULL AND room_type IS NOT NULL AND review_scores_rating IS NOT NULL
  GROUP BY 1, 2),
cuts AS (SELECT quantile_cont(supply, 0.2) AS p_supply, quantile_cont(avg_rating, 0.7) AS p_rating FROM grid),
gaps AS (SELECT g.* FROM grid g, cuts c WHERE g.supply <= c.p_supply AND g.avg_rating >= c.p_rating)
SELECT neighbourhood_cleansed, room_type, supply, round(avg_rating, 4) AS avg_rating,
       (SELECT count(*) FROM gaps)::BIGINT AS n_gaps
FROM gaps ORDER BY avg_rating DESC, neighbourhood_cleansed, room_type LIMIT 12
"""


@register("i3_market_gaps", roles=("listings",), headline=True, sql=_I3)
def i3_market_gaps(spark, d):
    t = D.market_gaps(roles.listings(spark, d))
    return t.select("neighbourhood_cleansed", "room_type", "supply", r4("avg_rating").alias("avg_rating"), "n_gaps")


_I4 = """
WITH base AS (
  SELECT * FROM listings
  WHERE accommodates IS NOT NULL AND bedrooms IS NOT NULL AND number_of_reviews IS NOT NULL AND review_scores_rating IS NOT NULL
    AND availability_365 IS NOT NULL AND minimum_nights IS NOT NULL AND price IS NOT NULL),
w AS (
  SELECT corr(accommodates, price) AS accommodates, corr(bedrooms, price) AS bedrooms,
         corr(number_of_reviews, price) AS number_of_reviews,
         corr(review_scores_rating, price) AS review_scores_rating, corr(availability_365, price) AS availability_365,
         corr(minimum_nights, price) AS minimum_nights FROM base),
l AS (UNPIVOT w ON accommodates, bedrooms, number_of_reviews, review_scores_rating, availability_365, minimum_nights
      INTO NAME feature VALUE r)
SELECT feature, round(r, 4) AS r FROM l ORDER BY abs(r) DESC NULLS LAST, feature LIMIT 8
"""


@register("i4_price_correlations", roles=("listings",), headline=True, sql=_I4)
def i4_price_correlations(spark, d):
    t = D.price_correlations(roles.listings(spark, d))
    return t.select("feature", r4("r").alias("r"))


_I5 = """
WITH nb AS (
  SELECT neighbourhood_cleansed, avg(availability_365) AS avg_avail, avg(price) AS avg_price, count(id)::BIGINT AS count
  FROM listings
  WHERE availability_365 IS NOT NULL AND price IS NOT NULL AND neighbourhood_cleansed IS NOT NULL
  GROUP BY 1 HAVING count(id) >= 20),
cut AS (SELECT quantile_cont(avg_avail, 0.25) AS p FROM nb),
cand AS (
  SELECT nb.*, false AS fallback FROM nb, cut WHERE nb.avg_avail <= cut.p
  UNION ALL SELECT nb.*, true AS fallback FROM nb)
SELECT neighbourhood_cleansed, round(avg_avail, 4) AS avg_avail, round(avg_price, 4) AS avg_price, count, fallback
FROM cand ORDER BY fallback, avg_price DESC, neighbourhood_cleansed LIMIT 1
"""


@register("i5_scarce_expensive", roles=("listings",), headline=True, sql=_I5)
def i5_scarce_expensive(spark, d):
    t = D.scarce_expensive(roles.listings(spark, d))
    return t.select("neighbourhood_cleansed", r4("avg_avail").alias("avg_avail"), r4("avg_price").alias("avg_price"),
                    "count", "fallback")


@register("i6_discovery", headline=True)
def i6_discovery(spark, d):
    """All five finders as insight rows (narrative text; checked by tests, rows-only here)."""
    return D.run_discovery(roles.listings(spark, d)).select("category", "severity", "title", "narrative")


# The insight rows' titles from the five forms above: the leading row of each finder.
TITLES_SQL = f"""
WITH i1 AS ({_I1.strip()}), i2 AS ({_I2.strip()}), i3 AS ({_I3.strip()}), i4 AS ({_I4.strip()}), i5 AS ({_I5.strip()})
SELECT 'anomaly' AS category, 'high' AS severity, 'Few dear listings lift the mean price of ' || neighbourhood_cleansed AS title
FROM (SELECT * FROM i1 ORDER BY skew_ratio DESC NULLS LAST, neighbourhood_cleansed LIMIT 1)
UNION ALL SELECT DISTINCT 'pattern', 'high', format('{{:,}}', total_gems) || ' well-rated listings below the median price' FROM i2
UNION ALL SELECT DISTINCT 'gap', 'medium', n_gaps || ' segments with thin supply and high ratings' FROM i3
UNION ALL SELECT 'correlation', 'medium', 'Price follows ''' || coalesce(arg_max(feature, r) FILTER (r > 0), arg_max(feature, r)) || ''' most closely'
FROM i4 HAVING count(*) > 0
UNION ALL SELECT 'pattern', 'low', neighbourhood_cleansed || ': hard to book at a high price' FROM i5
"""


@register("i6_titles", roles=("listings",), sql=TITLES_SQL)
def i6_titles(spark, d):
    """I-6 / I-7: category, severity and title of every insight row."""
    return D.run_discovery(roles.listings(spark, d)).select("category", "severity", "title")
