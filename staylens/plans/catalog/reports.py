"""Report and filter queries (A-1 .. A-19, P-1 .. P-7) over the listings and reviews roles."""

from __future__ import annotations

from pyspark.sql import functions as F

from staylens.functions.semantics import r4
from staylens.operators import filters as P
from staylens.operators import reports as A
from staylens.plans.registry import register
from staylens.sources import roles

L = ("listings",)


def _r4all(df, keep=()):
    """Round every double column to 4 places (comparison output)."""
    return df.select(*[r4(c).alias(c) if t == "double" and c not in keep else F.col(c) for c, t in df.dtypes])


# Numeric columns of the listings role (what the describe / missing reports cover).
LISTING_NUMERIC = ["id", "host_id", "price", "review_scores_rating", "accommodates", "number_of_reviews", "bedrooms",
                   "reviews_per_month",
                   "availability_365", "minimum_nights", "latitude", "longitude"]


@register("a1_summary_report", roles=L, sql="""
WITH s AS (
  SELECT count(*)::DOUBLE AS total_listings, count(price)::DOUBLE AS total_listings_with_price,
         avg(price) AS avg_price, median(price) AS median_price, min(price) AS min_price, max(price) AS max_price,
         avg(review_scores_rating) AS avg_review_score,
         count(DISTINCT neighbourhood_cleansed)::DOUBLE AS total_neighborhoods FROM listings),
u AS (UNPIVOT s ON COLUMNS(*) INTO NAME key VALUE value),
rt AS (SELECT room_type AS k, avg(price) AS m FROM listings WHERE room_type IS NOT NULL GROUP BY 1),
nb AS (SELECT neighbourhood_cleansed AS k, avg(price) AS m FROM listings
       WHERE neighbourhood_cleansed IS NOT NULL GROUP BY 1 HAVING avg(price) IS NOT NULL)
SELECT 'summary' AS section, key, round(value, 4) AS value, NULL::DOUBLE AS value_rounded FROM u
UNION ALL SELECT 'room_type_counts', room_type, count(*)::DOUBLE, NULL FROM listings
          WHERE room_type IS NOT NULL GROUP BY 2
UNION ALL SELECT 'room_type_avg_price', k, round(m, 4), round_even(m, 0) FROM rt
UNION ALL (SELECT 'top_expensive', k, round(m, 4), round_even(m, 0) FROM nb ORDER BY m DESC, k LIMIT 5)
UNION ALL (SELECT 'top_cheapest', k, round(m, 4), round_even(m, 0) FROM nb ORDER BY m ASC, k LIMIT 5)
""")
def a1_summary_report(spark, d):
    return _r4all(A.summary_report(roles.listings(spark, d)))


_BOUNDS_SQL = """
bounds AS (SELECT CAST(trunc(min(price)) AS BIGINT) AS price_floor,
                  least(CAST(trunc(quantile_cont(price, 0.98)) AS BIGINT), 200000) AS price_cap FROM listings),
filtered AS (SELECT l.* FROM listings l, bounds b WHERE l.price BETWEEN b.price_floor AND b.price_cap)"""


def _filtered(spark, d):
    li = roles.listings(spark, d)
    return li, P.filter_by_bounds(li, P.price_bounds(li))


@register("a2_kpi_panel", roles=L, sql=f"""
WITH {_BOUNDS_SQL}
SELECT count(*)::BIGINT AS listings, round(avg(price), 4) AS avg_price,
       round(avg(price) - (SELECT avg(price) FROM listings), 4) AS avg_vs_all, round(median(price), 4) AS median_price,
       count(DISTINCT neighbourhood_cleansed)::BIGINT AS neighbourhoods FROM filtered
""")
def a2_kpi_panel(spark, d):
    full, filt = _filtered(spark, d)
    return _r4all(A.kpi_panel(filt, full))


def _hist_sql(source: str, column: str, bins: int) -> str:
    return f"""
WITH x AS (SELECT {column}::DOUBLE AS x FROM {source} WHERE {column} IS NOT NULL),
r0 AS (SELECT min(x) AS mn, max(x) AS mx FROM x),
r AS (SELECT CASE WHEN mn = mx THEN mn - 0.5 ELSE mn END AS lo,
             (CASE WHEN mn = mx THEN mx + 0.5 ELSE mx END - CASE WHEN mn = mx THEN mn - 0.5 ELSE mn END) / {bins} AS w
      FROM r0 WHERE mn IS NOT NULL),
c AS (SELECT CAST(least(floor((x - lo) / w), {bins - 1}) AS INTEGER) AS bin, count(*) AS n FROM x, r GROUP BY 1),
g AS (SELECT CAST(range AS INTEGER) AS bin FROM range(0, {bins}))
SELECT g.bin, round(lo + g.bin * w, 4) AS bin_start, round(lo + (g.bin + 1) * w, 4) AS bin_end,
       coalesce(c.n, 0)::BIGINT AS count
FROM g CROSS JOIN r LEFT JOIN c ON c.bin = g.bin
"""


@register("a3_price_histogram", roles=L, sql=_hist_sql("listings", "price", 50))
def a3_price_histogram(spark, d):
    return _r4all(A.histogram(roles.listings(spark, d), "price", 50))


@register("a3_price_histogram_60", roles=L, sql=_hist_sql("listings", "price", 60))
def a3_price_histogram_60(spark, d):
    return _r4all(A.histogram(roles.listings(spark, d), "price", 60))


@register("a3_histogram_lines", roles=L, sql="SELECT round(avg(price), 4) AS mean, round(median(price), 4) AS median FROM listings")
def a3_histogram_lines(spark, d):
    return _r4all(A.histogram_lines(roles.listings(spark, d), "price"))


@register("p3_typical_price_histogram", roles=L,
          sql=_hist_sql("(SELECT * FROM listings WHERE price < 100000)", "price", 50))
def p3_typical_price_histogram(spark, d):
    return _r4all(A.histogram(P.typical_range(roles.listings(spark, d)), "price", 50))


@register("a4_mean_price_by_room_type", roles=L, sql="""
SELECT room_type, round(avg(price), 4) AS avg_price FROM listings WHERE room_type IS NOT NULL GROUP BY room_type
""")
def a4_mean_price_by_room_type(spark, d):
    return _r4all(A.mean_by(roles.listings(spark, d), "room_type"))


@register("a5_room_type_boxes", roles=L, sql="""
WITH b AS (SELECT room_type, price FROM listings
           WHERE room_type IS NOT NULL AND price IS NOT NULL AND price < 100000),
q AS (SELECT room_type, quantile_cont(price, 0.25) AS q1, median(price) AS med, quantile_cont(price, 0.75) AS q3
      FROM b GROUP BY 1),
f AS (SELECT *, q1 - (q3 - q1) * 1.5 AS lf, q3 + (q3 - q1) * 1.5 AS hf FROM q)
SELECT f.room_type, round(q1, 4) AS q1, round(med, 4) AS median, round(q3, 4) AS q3, count(*)::BIGINT AS n,
       round(min(CASE WHEN price >= lf AND price <= hf THEN price END), 4) AS whisker_low,
       round(max(CASE WHEN price >= lf AND price <= hf THEN price END), 4) AS whisker_high,
       count(CASE WHEN NOT (price >= lf AND price <= hf) THEN 1 END)::BIGINT AS outliers
FROM b JOIN f ON b.room_type = f.room_type GROUP BY f.room_type, q1, med, q3
""")
def a5_room_type_boxes(spark, d):
    t = A.box_stats(roles.listings(spark, d), "room_type")
    return _r4all(t.select("room_type", "q1", "median", "q3", "n", "whisker_low", "whisker_high", "outliers"))


@register("a6_top_district_boxes", roles=L, sql="""
WITH top AS (SELECT neighbourhood_cleansed FROM listings WHERE neighbourhood_cleansed IS NOT NULL
             GROUP BY 1 ORDER BY avg(price) DESC NULLS LAST, neighbourhood_cleansed LIMIT 10),
b AS (SELECT neighbourhood_cleansed, price FROM listings
      WHERE neighbourhood_cleansed IN (SELECT neighbourhood_cleansed FROM top)
        AND price IS NOT NULL AND price < 100000)
SELECT neighbourhood_cleansed, round(quantile_cont(price, 0.25), 4) AS q1, round(median(price), 4) AS median,
       round(quantile_cont(price, 0.75), 4) AS q3, count(*)::BIGINT AS n, round(min(price), 4) AS whisker_low,
       round(max(price), 4) AS whisker_high, 0::BIGINT AS outliers
FROM b GROUP BY 1
""")
def a6_top_district_boxes(spark, d):
    t = A.top_district_boxes(roles.listings(spark, d), 10)
    return _r4all(t.select("neighbourhood_cleansed", "q1", "median", "q3", "n", "whisker_low", "whisker_high",
                           "outliers"))


_TOP_SQL = """
SELECT neighbourhood_cleansed, round(avg(price), 4) AS mean, count(price)::BIGINT AS count FROM listings
WHERE neighbourhood_cleansed IS NOT NULL GROUP BY 1 ORDER BY avg(price) {dir} NULLS LAST, neighbourhood_cleansed
LIMIT 10
"""


@register("a7_top_expensive_districts", roles=L, sql=_TOP_SQL.format(dir="DESC"))
def a7_top_expensive_districts(spark, d):
    return _r4all(A.top_districts(roles.listings(spark, d), 10, "expensive"))


@register("a7_top_cheapest_districts", roles=L, sql=_TOP_SQL.format(dir="ASC"))
def a7_top_cheapest_districts(spark, d):
    return _r4all(A.top_districts(roles.listings(spark, d), 10, "cheapest"))


def _corr_sql(cols):
    parts = []
    for i, a in enumerate(cols):
        for b in cols[i:]:
            parts.append(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}::DOUBLE, {b}::DOUBLE), 4) AS r FROM listings")
            if a != b:
                parts.append(f"SELECT '{b}' AS a, '{a}' AS b, round(corr({a}::DOUBLE, {b}::DOUBLE), 4) AS r "
                             "FROM listings")
    return "\nUNION ALL ".join(parts)


_HEAT_PRESENT = ["price", "accommodates", "bedrooms", "number_of_reviews", "review_scores_rating", "availability_365"]


@register("a8_correlation_matrix", roles=L, sql=_corr_sql(_HEAT_PRESENT))
def a8_correlation_matrix(spark, d):
    return _r4all(A.correlation_matrix(roles.listings(spark, d)))


@register("a9_district_treemap", roles=L, sql="""
SELECT neighbourhood_cleansed, round(avg(price), 4) AS avg_price, count(price)::BIGINT AS listings FROM listings
WHERE neighbourhood_cleansed IS NOT NULL GROUP BY 1
""")
def a9_district_treemap(spark, d):
    return _r4all(A.district_treemap(roles.listings(spark, d)))


@register("a10_price_vs_rating", roles=L, sql="""
WITH g AS (SELECT neighbourhood_cleansed, avg(price) AS avg_price, avg(review_scores_rating) AS avg_rating,
                  count(id)::BIGINT AS listings FROM listings WHERE neighbourhood_cleansed IS NOT NULL
           GROUP BY 1 HAVING avg(review_scores_rating) IS NOT NULL),
m AS (SELECT median(avg_price) AS mp, median(avg_rating) AS mr FROM g)
SELECT neighbourhood_cleansed, round(avg_price, 4) AS avg_price, round(avg_rating, 4) AS avg_rating, listings,
       round(mp, 4) AS med_price, round(mr, 4) AS med_rating,
       CASE WHEN avg_price <= mp AND avg_rating >= mr THEN 'best value'
            WHEN avg_price > mp AND avg_rating >= mr THEN 'premium'
            WHEN avg_price <= mp AND avg_rating < mr THEN 'budget' ELSE 'overpriced' END AS quadrant
FROM g, m
""")
def a10_price_vs_rating(spark, d):
    return _r4all(A.price_vs_rating(roles.listings(spark, d)))


@register("a11_price_estimate", roles=L, sql="""
SELECT id, CAST(trunc((15000.0::DOUBLE + (accommodates - 2) * 3000.0::DOUBLE + (1.0::DOUBLE - 1) * 5000.0::DOUBLE
       + 1.0::DOUBLE * 8000.0::DOUBLE + 2.0::DOUBLE * 2000.0::DOUBLE + (365 - availability_365) * 20.0::DOUBLE)
       * CASE room_type WHEN 'Entire home/apt' THEN 1.0 WHEN 'Private room' THEN 0.6 WHEN 'Shared room' THEN 0.3
                        WHEN 'Hotel room' THEN 0.8 ELSE 1.0 END::DOUBLE) AS BIGINT) AS estimated_price
FROM listings
""")
def a11_price_estimate(spark, d):
    return A.price_estimate(roles.listings(spark, d)).select("id", "estimated_price")


_ROOMS = [*A.ROOM_MULTIPLIERS, "Other"]
_ROOM_SQL = "list_extract([" + ", ".join(f"'{r}'" for r in _ROOMS) + f"], CAST(id % {len(_ROOMS)} AS INTEGER) + 1)"


@register("a11_price_estimate_by_room_type", roles=L, sql=f"""
WITH l AS (SELECT id, accommodates, availability_365, {_ROOM_SQL} AS rt FROM listings)
SELECT id, rt AS room_type, CAST(trunc((15000.0::DOUBLE + (accommodates - 2) * 3000.0::DOUBLE + (1.0::DOUBLE - 1) * 5000.0::DOUBLE
       + 1.0::DOUBLE * 8000.0::DOUBLE + 2.0::DOUBLE * 2000.0::DOUBLE + (365 - availability_365) * 20.0::DOUBLE)
       * CASE rt WHEN 'Entire home/apt' THEN 1.0 WHEN 'Private room' THEN 0.6 WHEN 'Shared room' THEN 0.3
                 WHEN 'Hotel room' THEN 0.8 ELSE 1.0 END::DOUBLE) AS BIGINT) AS estimated_price FROM l
""")
def a11_price_estimate_by_room_type(spark, d):
    """A-11 with every multiplier: the room types are dealt out by id, as the listings role has none of them."""
    room = F.element_at(F.array(*[F.lit(r) for r in _ROOMS]), (F.col("id") % len(_ROOMS)).cast("int") + 1)
    return A.price_estimate(roles.listings(spark, d).withColumn("room_type", room)).select("id", "room_type", "estimated_price")


def _dist_sql(cols, source="listings"):
    parts = []
    for c in cols:
        x = f"{c}::DOUBLE"
        parts.append(
            f"SELECT '{c}' AS column_name, count({x})::BIGINT AS count, round(avg({x}), 4) AS mean, "
            f"round(median({x}), 4) AS median, round(stddev_samp({x}), 4) AS std, round(min({x}), 4) AS min, "
            f"round(quantile_cont({x}, 0.25), 4) AS q1, round(quantile_cont({x}, 0.75), 4) AS q3, "
            f"round(max({x}), 4) AS max, round(skewness({x}), 4) AS skew, "
            f"CASE WHEN skewness({x}) > 0.5 THEN 'right-skewed' WHEN skewness({x}) < -0.5 THEN 'left-skewed' "
            f"ELSE 'roughly symmetric' END AS skew_label, (count(*) - count({x}))::BIGINT AS nulls, "
            f"round((count(*) - count({x})) * 100.0 / count(*), 4) AS null_pct FROM {source}")
    return "\nUNION ALL ".join(parts)


def _dist(df, cols):
    t = A.distribution_stats(df, cols).withColumnRenamed("column", "column_name")
    return _r4all(t)


@register("a12_price_distribution", roles=L, sql=_dist_sql(["price"]))
def a12_price_distribution(spark, d):
    return _dist(roles.listings(spark, d), ["price"])


@register("a18_describe_listings", roles=L, sql=_dist_sql(LISTING_NUMERIC))
def a18_describe_listings(spark, d):
    return _dist(roles.listings(spark, d), LISTING_NUMERIC)


_ALL_LISTING_COLUMNS = ["id", "host_id", "price", "neighbourhood_cleansed", "room_type", "review_scores_rating",
                        "accommodates", "number_of_reviews", "bedrooms", "reviews_per_month", "availability_365",
                        "minimum_nights", "host_since", "instant_bookable",
                        "latitude", "longitude"]


def _missing_sql(cols):
    parts = [f"SELECT '{c}' AS column_name, avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END)::DOUBLE * 100 AS p "
             "FROM listings" for c in cols]
    return ("WITH m AS (" + "\nUNION ALL ".join(parts) + ")\n"
            "SELECT column_name, round(p, 4) AS pct_exact, round_even(p, 1) AS pct_missing FROM m "
            "WHERE round_even(p, 1) > 0")


@register("a13_missing_report", roles=L, sql=_missing_sql(_ALL_LISTING_COLUMNS))
def a13_missing_report(spark, d):
    t = A.missing_report(roles.listings(spark, d)).withColumnRenamed("column", "column_name")
    return t.select("column_name", r4("pct_exact").alias("pct_exact"), "pct_missing")


@register("a14_district_comparison", roles=L, sql="""
SELECT neighbourhood_cleansed, count(id)::BIGINT AS listings, round(avg(price), 4) AS avg_price,
       round(median(price), 4) AS median_price, round(min(price), 4) AS min_price, round(max(price), 4) AS max_price,
       round(avg(review_scores_rating), 4) AS avg_rating, round(avg(availability_365), 4) AS avg_availability,
       round_even(avg(price), 1) AS avg_price_1, round_even(median(price), 1) AS median_price_1,
       round_even(min(price), 1) AS min_price_1, round_even(max(price), 1) AS max_price_1,
       round_even(avg(review_scores_rating), 1) AS avg_rating_1, round_even(avg(availability_365), 1) AS avg_availability_1
FROM listings WHERE neighbourhood_cleansed IS NOT NULL GROUP BY 1 HAVING count(*) >= 10
""")
def a14_district_comparison(spark, d):
    return _r4all(A.district_comparison(roles.listings(spark, d)))


# The listings role has one score; the six others are made from it: a score less (id mod k), null where id mod 11 is 0.
_SCORES = {c: k for k, c in enumerate(A.SCORE_COLUMNS)}


def _score_sql(c: str, k: int) -> str:
    x = f"(review_scores_rating - id % {k})" if k else "review_scores_rating"
    x = f"CASE WHEN id % 11 <> 0 THEN {x} END" if k else x
    return (f"SELECT '{c.removeprefix('review_scores_')}' AS score, round(avg({x}), 4) AS mean, round(median({x}), 4) AS median, "
            f"count({x})::BIGINT AS count, round_even(avg({x}), 2) AS mean_2, round_even(median({x}), 2) AS median_2 FROM listings")


def _scored_listings(spark, d):
    made = {c: F.when(F.col("id") % 11 != 0, F.col("review_scores_rating") - F.col("id") % k) for c, k in _SCORES.items() if k}
    return roles.listings(spark, d).withColumns(made)


@register("a15_review_score_stats", roles=L, sql="\nUNION ALL ".join(_score_sql(c, k) for c, k in _SCORES.items()))
def a15_review_score_stats(spark, d):
    return _r4all(A.review_score_stats(_scored_listings(spark, d)))


@register("a16_rating_bands", roles=L, sql="""
SELECT count(CASE WHEN review_scores_rating = 100 THEN 1 END)::BIGINT AS band_top,
       count(CASE WHEN review_scores_rating >= 90 AND review_scores_rating < 100 THEN 1 END)::BIGINT AS band_high,
       count(CASE WHEN review_scores_rating >= 80 AND review_scores_rating < 90 THEN 1 END)::BIGINT AS band_mid,
       count(CASE WHEN review_scores_rating < 80 THEN 1 END)::BIGINT AS band_low,
       count(review_scores_rating)::BIGINT AS reviewed_listings, count(*)::BIGINT AS total_listings FROM listings
""")
def a16_rating_bands(spark, d):
    return A.rating_bands(roles.listings(spark, d), edges=A.RATING_BANDS_100)


@register("a17_recommend_neighborhood", roles=L, sql="""
WITH g AS (SELECT neighbourhood_cleansed, count(price)::BIGINT AS count,
                  floor(avg(price) * 100 + 0.5) / 100 AS avg_price,
                  floor(avg(review_scores_rating) * 100 + 0.5) / 100 AS avg_rating
           FROM listings WHERE price <= 150000 AND room_type = 'BUILDING' AND neighbourhood_cleansed IS NOT NULL
           GROUP BY 1)
SELECT * FROM g WHERE count >= 10 ORDER BY avg_rating DESC NULLS LAST, neighbourhood_cleansed LIMIT 10
""")
def a17_recommend_neighborhood(spark, d):
    return A.recommend_neighborhood(roles.listings(spark, d), budget=150_000, room_type_value="BUILDING")


@register("a19_room_type_counts", roles=L, sql="""
SELECT room_type, count(*)::BIGINT AS count FROM listings WHERE room_type IS NOT NULL GROUP BY 1
""")
def a19_room_type_counts(spark, d):
    return A.value_counts(roles.listings(spark, d), "room_type")


@register("a19_top5_districts_by_size", roles=L, sql="""
SELECT neighbourhood_cleansed, count(*)::BIGINT AS count FROM listings WHERE neighbourhood_cleansed IS NOT NULL
GROUP BY 1 ORDER BY count DESC, neighbourhood_cleansed LIMIT 5
""")
def a19_top5_districts_by_size(spark, d):
    return A.value_counts(roles.listings(spark, d), "neighbourhood_cleansed", top=5)


# --- filters ----------------------------------------------------------------------------------------------------

@register("p1_market_filter", roles=L, sql=f"""
WITH {_BOUNDS_SQL}
SELECT id, price, room_type, neighbourhood_cleansed FROM filtered
WHERE room_type IN ('BUILDING', 'MACHINERY') AND neighbourhood_cleansed IN ('NATION_1', 'NATION_2', 'NATION_3')
""")
def p1_market_filter(spark, d):
    _, filt = _filtered(spark, d)
    t = P.market_filter(filt, room_types=["BUILDING", "MACHINERY"], districts=["NATION_1", "NATION_2", "NATION_3"])
    return t.select("id", "price", "room_type", "neighbourhood_cleansed")


@register("p2_price_bounds", roles=L, sql=f"WITH {_BOUNDS_SQL} SELECT * FROM bounds")
def p2_price_bounds(spark, d):
    return P.price_bounds(roles.listings(spark, d))


@register("p4_first_rows", roles=L, sql="SELECT id, price, room_type FROM listings ORDER BY id LIMIT 100")
def p4_first_rows(spark, d):
    return P.first_rows(roles.listings(spark, d), ["id", "price", "room_type"], 100)


@register("p5_distinct_districts", roles=L, sql="""
SELECT DISTINCT neighbourhood_cleansed FROM listings WHERE neighbourhood_cleansed IS NOT NULL
""")
def p5_distinct_districts(spark, d):
    return P.distinct_values(roles.listings(spark, d), "neighbourhood_cleansed")


@register("p7_review_cards", roles=("reviews",), sql="""
SELECT id, substr(comments, 1, 260) AS snippet FROM reviews
""")
def p7_review_cards(spark, d):
    return P.truncate_text(roles.reviews(spark, d), "comments", 260, "snippet").select("id", "snippet")
