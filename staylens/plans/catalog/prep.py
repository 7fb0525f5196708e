"""Source, cleaning and feature queries (S-*, C-*, F-*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from staylens.functions.semantics import hash_sample, r4
from staylens.operators import cleaning as C
from staylens.operators import features as FE
from staylens.plans.registry import register
from staylens.sources import files as S
from staylens.sources import roles

L = ("listings",)
AS_OF = "2001-08-01"


def _r4all(df):
    return df.select(*[r4(c).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# --- sources -------------------------------------------------------------------------------------------------------

@register("s4_recent_reviews", roles=("reviews_dated",), sql=f"""
SELECT id, date FROM reviews_dated WHERE date >= DATE '{AS_OF}' - INTERVAL 24 MONTH
""")
def s4_recent_reviews(spark, d):
    return S.recent_reviews(roles.reviews_dated(spark, d), AS_OF, 2).select("id", "date")


def _summary_sql():
    parts = []
    for t in roles.TABLES:
        parts.append(f"SELECT '{t}' AS table_name, count(*)::BIGINT AS rows, "
                     f"(SELECT count(*) FROM information_schema.columns WHERE table_name = '{t}')::BIGINT AS columns "
                     f"FROM {t}")
    return "\nUNION ALL ".join(parts)


@register("s8_dataset_summary", sql=_summary_sql())
def s8_dataset_summary(spark, d):
    return S.dataset_summary({t: roles.table(spark, d, t) for t in roles.TABLES})


@register("s9_hash_sample", roles=L, sql="""
SELECT id, price FROM listings ORDER BY md5(concat_ws('|', CAST(id AS VARCHAR), '42')), id LIMIT 1000
""")
def s9_hash_sample(spark, d):
    return hash_sample(roles.listings(spark, d), 1000, "id", 42).select("id", "price")


@register("s10_systematic_sample", roles=("calendar_long",), sql="""
SELECT listing_id, date FROM (
  SELECT listing_id, date, row_number() OVER (ORDER BY listing_id, date) AS rn FROM calendar_long)
WHERE (rn - 1) % 50 = 0
""")
def s10_systematic_sample(spark, d):
    return S.systematic_sample(roles.calendar_long(spark, d), 50, "listing_id", "date").select("listing_id", "date")


@register("s12_parquet_projection", sql="""
SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 400000
""")
def s12_parquet_projection(spark, d):
    return S.read_columns(spark, f"{d}/orders.parquet", ["o_orderkey", "o_totalprice"]).where(
        F.col("o_totalprice") > 400000)


# --- cleaning ----------------------------------------------------------------------------------------------------

@register("c1_clean_price", roles=L, sql="""
WITH t AS (SELECT id, '¥' || CAST(price AS VARCHAR) || ' per night' AS raw FROM listings),
s AS (SELECT id, regexp_replace(raw, '[$,¥ ]', '', 'g') AS s FROM t)
SELECT id,
       CASE WHEN regexp_replace(s, 'pernight.*$', '') SIMILAR TO '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?'
            THEN round(CAST(regexp_replace(s, 'pernight.*$', '') AS DOUBLE), 4) END AS price_clean,
       CASE WHEN s SIMILAR TO '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?'
            THEN round(CAST(s AS DOUBLE), 4) END AS price_compat
FROM s
""")
def c1_clean_price(spark, d):
    raw = F.concat(F.lit("¥"), F.col("price").cast("string"), F.lit(" per night"))
    t = roles.listings(spark, d).select("id", raw.alias("raw"))
    return t.select("id", r4(C.clean_price("raw")).alias("price_clean"),
                    r4(C.clean_price("raw", compat=True)).alias("price_compat"))


_PRICES = {c: k + 2 for k, c in enumerate(c for c in C.PRICE_COLUMNS if c != "price")}


@register("c2_price_columns", roles=L, sql="SELECT id, " + ", ".join(
    f"CASE WHEN id % {k} <> 1 THEN round(CAST(accommodates * {k} + id % 100 AS DOUBLE) + 0.5, 4) END AS {c}"
    for c, k in _PRICES.items()) + " FROM listings")
def c2_price_columns(spark, d):
    """C-2: every other price column as text ('$1,234.50', or 'n/a' for some ids), cleaned."""
    raw = {c: F.when(F.col("id") % k != 1, F.concat(F.lit("$"), F.format_number(
        F.col("accommodates") * k + F.col("id") % 100 + 0.5, 2))).otherwise(F.lit("n/a")) for c, k in _PRICES.items()}
    t = roles.listings(spark, d).withColumns(raw)
    return C.clean_listings(t, drop_threshold=None).select("id", *[r4(c).alias(c) for c in _PRICES])


@register("f5_response_rate", roles=L, sql="""
WITH t AS (SELECT id, CASE WHEN id % 13 <> 0 THEN id % 101 END::DOUBLE AS r FROM listings)
SELECT id, r AS response_rate_numeric, CASE WHEN r > 0 AND r <= 50 THEN 'Low' WHEN r > 50 AND r <= 80 THEN 'Medium'
       WHEN r > 80 AND r <= 90 THEN 'High' WHEN r > 90 AND r <= 100 THEN 'Excellent' END AS response_category FROM t
""")
def f5_response_rate(spark, d):
    """F-5 over rates written as text by id, some of them not numbers."""
    rate = F.when(F.col("id") % 13 != 0, F.concat((F.col("id") % 101).cast("string"), F.lit("%"))).otherwise(F.lit("N/A"))
    t = FE.response_features(roles.listings(spark, d).withColumn("host_response_rate", rate))
    return t.select("id", "response_rate_numeric", "response_category")


@register("f6_flags", roles=L, sql="""
SELECT id, CASE id % 4 WHEN 0 THEN 1 WHEN 1 THEN 0 END AS instant_book, CASE id % 5 WHEN 0 THEN 1 WHEN 2 THEN 0 END AS is_superhost
FROM listings
""")
def f6_flags(spark, d):
    """F-6 with true, false, other and missing flags by id."""
    flag = {"instant_bookable": F.when(F.col("id") % 4 == 0, "t").when(F.col("id") % 4 == 1, "f").when(F.col("id") % 4 == 2, "x"),
            "host_is_superhost": F.when(F.col("id") % 5 == 0, "t").when(F.col("id") % 5 == 2, "f").when(F.col("id") % 5 == 3, "T")}
    return FE.flag_features(roles.listings(spark, d).withColumns(flag)).select("id", "instant_book", "is_superhost")


_CLEAN_LISTINGS_SQL = """
WITH m AS (SELECT median(bedrooms) AS mb, median(review_scores_rating) AS ms, median(reviews_per_month) AS mr
           FROM listings),
c AS (
  SELECT l.id, l.host_id, l.price, l.neighbourhood_cleansed, l.room_type,
         coalesce(l.review_scores_rating, m.ms) AS review_scores_rating, l.accommodates, l.number_of_reviews,
         coalesce(l.bedrooms, m.mb) AS bedrooms, coalesce(l.reviews_per_month, m.mr) AS reviews_per_month,
         l.availability_365, l.minimum_nights, l.host_since, l.instant_bookable, l.latitude, l.longitude,
         l.review_scores_rating IS NOT NULL AS has_reviews
  FROM listings l, m)
SELECT id, host_id, round(price, 4) AS price, neighbourhood_cleansed, room_type,
       round(review_scores_rating, 4) AS review_scores_rating, accommodates, number_of_reviews,
       round(bedrooms, 4) AS bedrooms, round(reviews_per_month, 4) AS reviews_per_month, availability_365,
       minimum_nights, host_since, instant_bookable, round(latitude, 4) AS latitude, round(longitude, 4) AS longitude,
       has_reviews,
       CASE WHEN review_scores_rating > 0 AND review_scores_rating <= 80 THEN 'Poor'
            WHEN review_scores_rating > 80 AND review_scores_rating <= 90 THEN 'Good'
            WHEN review_scores_rating > 90 AND review_scores_rating <= 95 THEN 'Great'
            WHEN review_scores_rating > 95 AND review_scores_rating <= 100 THEN 'Excellent' END AS rating_category
FROM c
"""


@register("c10_clean_listings", roles=L, sql=_CLEAN_LISTINGS_SQL)
def c10_clean_listings(spark, d):
    return _r4all(C.clean_listings(roles.listings(spark, d)))


@register("c3_median_impute", roles=L, sql="""
WITH m AS (SELECT median(bedrooms) AS mb, median(review_scores_rating) AS ms, median(reviews_per_month) AS mr
           FROM listings)
SELECT id, round(coalesce(bedrooms, mb), 4) AS bedrooms, round(coalesce(review_scores_rating, ms), 4)
       AS review_scores_rating, round(coalesce(reviews_per_month, mr), 4) AS reviews_per_month FROM listings, m
""")
def c3_median_impute(spark, d):
    t = C.median_impute(roles.listings(spark, d), C.IMPUTE_MEDIAN_COLUMNS)
    return _r4all(t.select("id", "bedrooms", "review_scores_rating", "reviews_per_month"))


_LABELLED_DOCS_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars", "quality", "toxic"]


def _labelled_docs(spark, d):
    docs = roles.table(spark, d, "documents")
    labels = roles.table(spark, d, "labels")
    return docs.join(labels, "doc_id", "left")


@register("c7_drop_sparse_columns", sql="WITH j AS (SELECT * FROM documents LEFT JOIN labels USING (doc_id)),\n"
          "s AS (" + "\nUNION ALL ".join(
              f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL) AS n_null, count(*) AS n FROM j"
              for c in _LABELLED_DOCS_COLUMNS) + ")\nSELECT column_name FROM s WHERE n_null <= 0.5 * n")
def c7_drop_sparse_columns(spark, d):
    kept = C.drop_null_heavy(_labelled_docs(spark, d), 0.5).columns
    return spark.createDataFrame([(c,) for c in kept], "column_name string")


@register("c8_parse_flags", roles=L, sql="""
SELECT id, CASE instant_bookable WHEN 't' THEN true WHEN 'f' THEN false END AS instant_bookable FROM listings
""")
def c8_parse_flags(spark, d):
    return roles.listings(spark, d).select("id", C.parse_flag("instant_bookable").alias("instant_bookable"))


@register("c9_clean_reviews", roles=("reviews",), sql="""
SELECT id, coalesce(comments, '') AS comments, length(coalesce(comments, ''))::INTEGER AS review_length FROM reviews
""")
def c9_clean_reviews(spark, d):
    return C.clean_reviews(roles.reviews(spark, d)).select("id", "comments", "review_length")


def _ws():
    return C.WHITESPACE_CLASS


@register("c11_clean_page_text", sql=f"""
WITH e AS (
  SELECT page_id, replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(html,
         '&copy;', '©'), '&middot;', '·'), '&lt;', '<'), '&gt;', '>'),
         '&quot;', '"'), '&#39;', ''''), '&#x27;', ''''), '&apos;', ''''), '&nbsp;', ' '), '&amp;', '&') AS t
  FROM pages),
s AS (SELECT page_id, regexp_replace(regexp_replace(t, '<[^>]+>', ' ', 'g'), '{_ws()}+', ' ', 'g') AS t FROM e)
SELECT page_id, regexp_replace(t, '^{_ws()}+|{_ws()}+$', '', 'g') AS text FROM s
""")
def c11_clean_page_text(spark, d):
    return roles.table(spark, d, "pages").select("page_id", C.clean_review_text("html").alias("text"))


# --- features ----------------------------------------------------------------------------------------------------

@register("f1_price_ratios", roles=L, sql="""
SELECT id, round(price / CASE WHEN bedrooms = 0 THEN 1 ELSE bedrooms END, 4) AS price_per_bedroom,
       round(price / CASE WHEN accommodates = 0 THEN 1 ELSE accommodates END, 4) AS price_per_guest FROM listings
""")
def f1_price_ratios(spark, d):
    return _r4all(FE.price_ratios(roles.listings(spark, d)).select("id", "price_per_bedroom", "price_per_guest"))


@register("f2_host_activity", roles=L, sql=f"""
SELECT id, CAST(datediff('day', host_since, DATE '{AS_OF}') AS INTEGER) AS host_days_active,
       round(datediff('day', host_since, DATE '{AS_OF}') / 365.25, 4) AS host_years_active FROM listings
""")
def f2_host_activity(spark, d):
    return _r4all(FE.host_activity(roles.listings(spark, d), AS_OF).select("id", "host_days_active",
                                                                          "host_years_active"))


@register("f3_popularity", roles=L, sql="""
SELECT id, number_of_reviews > (SELECT median(number_of_reviews) FROM listings) AS is_popular,
       round(coalesce(reviews_per_month, 0.0), 4) AS review_velocity FROM listings
""")
def f3_popularity(spark, d):
    return _r4all(FE.popularity(roles.listings(spark, d)).select("id", "is_popular", "review_velocity"))


@register("f4_listing_score", roles=L, sql="""
SELECT id, round((review_scores_rating / 100 * 0.7 + (1 - availability_365 / 365) * 0.3) * 100, 4) AS listing_score
FROM listings
""")
def f4_listing_score(spark, d):
    return _r4all(FE.listing_score(roles.listings(spark, d)).select("id", "listing_score"))


@register("f6_flag_features", roles=L, sql="""
SELECT id, CASE instant_bookable WHEN 't' THEN 1 WHEN 'f' THEN 0 END AS instant_book FROM listings
""")
def f6_flag_features(spark, d):
    return FE.flag_features(roles.listings(spark, d)).select("id", "instant_book")


@register("f7_price_category", roles=L, sql="""
WITH q AS (SELECT quantile_cont(price, 0.25) AS a, quantile_cont(price, 0.5) AS b, quantile_cont(price, 0.75) AS c
           FROM listings)
SELECT id, CASE WHEN price > 0 AND price <= a THEN 'Budget' WHEN price > a AND price <= b THEN 'Moderate'
                WHEN price > b AND price <= c THEN 'Premium' WHEN price > c THEN 'Luxury' END AS price_category
FROM listings, q
""")
def f7_price_category(spark, d):
    return FE.price_category(roles.listings(spark, d)).select("id", "price_category")


@register("f8_district_counts", roles=L, sql="""
SELECT id, count(id) OVER (PARTITION BY neighbourhood_cleansed) AS neighborhood_count FROM listings
WHERE neighbourhood_cleansed IS NOT NULL
UNION ALL SELECT id, NULL FROM listings WHERE neighbourhood_cleansed IS NULL
""")
def f8_district_counts(spark, d):
    return FE.district_counts(roles.listings(spark, d)).select("id", "neighborhood_count")


@register("f9_calendar_parts", roles=("calendar_long",), sql="""
SELECT listing_id, date, year(date)::INTEGER AS year, month(date)::INTEGER AS month, day(date)::INTEGER AS day,
       (isodow(date) - 1)::INTEGER AS day_of_week, quarter(date)::INTEGER AS quarter,
       CASE WHEN isodow(date) IN (6, 7) THEN 1 ELSE 0 END::INTEGER AS is_weekend,
       CASE WHEN month(date) IN (12, 1, 2) THEN 'Winter' WHEN month(date) IN (3, 4, 5) THEN 'Spring'
            WHEN month(date) IN (6, 7, 8) THEN 'Summer' ELSE 'Fall' END AS season
FROM calendar_long
""")
def f9_calendar_parts(spark, d):
    return FE.calendar_parts(roles.calendar_long(spark, d)).select(
        "listing_id", "date", "year", "month", "day", "day_of_week", "quarter", "is_weekend", "season")


# --- C-4 .. C-6 on their own (also part of c10) ----------------------------------------------------------------

@register("c4_parse_dates", roles=L, sql="""
SELECT id, CAST(host_since AS DATE) AS host_since FROM listings
""")
def c4_parse_dates(spark, d):
    li = roles.listings(spark, d).select("id", F.col("host_since").cast("string").alias("host_since"))
    return li.select("id", C.parse_date("host_since").alias("host_since"))


@register("c5_has_reviews", roles=L, sql="""
SELECT id, review_scores_rating IS NOT NULL AS has_reviews FROM listings
""")
def c5_has_reviews(spark, d):
    return C.clean_listings(roles.listings(spark, d), drop_threshold=None).select("id", "has_reviews")


@register("c6_rating_category", roles=L, sql="""
SELECT id, round(review_scores_rating, 4) AS review_scores_rating,
       CASE WHEN review_scores_rating > 0 AND review_scores_rating <= 80 THEN 'Poor'
            WHEN review_scores_rating > 80 AND review_scores_rating <= 90 THEN 'Good'
            WHEN review_scores_rating > 90 AND review_scores_rating <= 95 THEN 'Great'
            WHEN review_scores_rating > 95 AND review_scores_rating <= 100 THEN 'Excellent' END AS rating_category
FROM listings
""")
def c6_rating_category(spark, d):
    li = roles.listings(spark, d)
    return li.select("id", r4("review_scores_rating").alias("review_scores_rating"),
                     C.cut("review_scores_rating", C.RATING_EDGES, C.RATING_LABELS).alias("rating_category"))
