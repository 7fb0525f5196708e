"""Feature derivation for listings and calendar (F-1 .. F-10).

Column expressions only, plus two one-row statistics (median reviews, price quartiles) broadcast back and one
per-district count joined back (an aggregate, not a window: a hot district never lands in one task).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staylens.functions.semantics import cut, join_group_stats, nan_to_null, parse_number, quantiles, with_scalars

# Fixed values of the feature rules.
RESPONSE_EDGES = [0, 50, 80, 90, 100]
RESPONSE_LABELS = ["Low", "Medium", "High", "Excellent"]
PRICE_CATEGORY_LABELS = ["Budget", "Moderate", "Premium", "Luxury"]
SCORE_RATING_WEIGHT = 0.7
SCORE_AVAILABILITY_WEIGHT = 0.3
DAYS_PER_YEAR = 365.25
SEASONS = {12: "Winter", 1: "Winter", 2: "Winter", 3: "Spring", 4: "Spring", 5: "Spring",
           6: "Summer", 7: "Summer", 8: "Summer", 9: "Fall", 10: "Fall", 11: "Fall"}


def _zero_as_one(c: str):
    x = F.col(c)
    return F.when(x == 0, F.lit(1)).otherwise(x)


def price_ratios(df: DataFrame, price="price") -> DataFrame:
    """F-1: price per bedroom and per guest; a zero divisor counts as one."""
    out = df
    if price in df.columns and "bedrooms" in df.columns:
        out = out.withColumn("price_per_bedroom", F.col(price) / _zero_as_one("bedrooms"))
    if price in df.columns and "accommodates" in df.columns:
        out = out.withColumn("price_per_guest", F.col(price) / _zero_as_one("accommodates"))
    return out


def host_activity(df: DataFrame, as_of: dt.date | str, host_since="host_since") -> DataFrame:
    """F-2: whole days (and years of 365.25 days) between ``host_since`` and an explicit ``as_of`` date."""
    if host_since not in df.columns:
        return df
    days = F.datediff(F.lit(str(as_of)).cast("date"), F.col(host_since))
    return df.withColumn("host_days_active", days).withColumn("host_years_active", days / DAYS_PER_YEAR)


def popularity(df: DataFrame, **qkw) -> DataFrame:
    """F-3: is_popular = number_of_reviews above its median; review_velocity = reviews_per_month or 0."""
    if not {"number_of_reviews", "reviews_per_month"} <= set(df.columns):
        return df
    med = quantiles(df, "number_of_reviews", [0.5], names=["_med_reviews"], **qkw)
    out = with_scalars(df, med)
    return (out.withColumn("is_popular", F.col("number_of_reviews") > F.col("_med_reviews"))
            .withColumn("review_velocity", F.coalesce(nan_to_null("reviews_per_month"), F.lit(0.0)))
            .drop("_med_reviews"))


def listing_score(df: DataFrame, rating="review_scores_rating", availability="availability_365") -> DataFrame:
    """F-4: (rating/100 · 0.7 + (1 − availability/365) · 0.3) · 100."""
    if not {rating, availability} <= set(df.columns):
        return df
    score = (F.col(rating) / 100 * SCORE_RATING_WEIGHT
             + (1 - F.col(availability) / 365) * SCORE_AVAILABILITY_WEIGHT) * 100
    return df.withColumn("listing_score", score)


def response_features(df: DataFrame, column="host_response_rate") -> DataFrame:
    """F-5: '97%' → 97.0 and its band (0,50] Low, (50,80] Medium, (80,90] High, (90,100] Excellent."""
    if column not in df.columns:
        return df
    num = parse_number(F.regexp_replace(F.col(column), "%", ""))
    return (df.withColumn("response_rate_numeric", num)
            .withColumn("response_category", cut("response_rate_numeric", RESPONSE_EDGES, RESPONSE_LABELS)))


def flag_features(df: DataFrame) -> DataFrame:
    """F-6: instant_book and is_superhost as 1/0 (other values null)."""
    out = df
    for src, dst in (("instant_bookable", "instant_book"), ("host_is_superhost", "is_superhost")):
        if src in df.columns:
            x = F.col(src)
            out = out.withColumn(dst, F.when(x == "t", F.lit(1)).when(x == "f", F.lit(0)))
    return out


def price_category(df: DataFrame, price="price", **qkw) -> DataFrame:
    """F-7: quartile bands (0, q25] Budget, (q25, q50] Moderate, (q50, q75] Premium, (q75, ∞) Luxury.

    The quartiles are exact and computed once; repeated edges make the bands undefined, and the job fails with
    an error as ``pd.cut`` does."""
    if price not in df.columns:
        return df
    q = quantiles(df, price, [0.25, 0.5, 0.75], names=["_q25", "_q50", "_q75"], **qkw)
    out = with_scalars(df, q)
    p, a, b, c = F.col(price), F.col("_q25"), F.col("_q50"), F.col("_q75")
    ok = (F.lit(0.0) < a) & (a < b) & (b < c)
    band = (F.when((p > 0) & (p <= a), "Budget").when((p > a) & (p <= b), "Moderate")
            .when((p > b) & (p <= c), "Premium").when(p > c, "Luxury"))
    guarded = F.when(ok.isNull() | ok, band).otherwise(F.raise_error(F.lit("price_category: bin edges must be unique")))
    return out.withColumn("price_category", guarded).drop("_q25", "_q50", "_q75")


def district_counts(df: DataFrame, district="neighbourhood_cleansed", id_col="id") -> DataFrame:
    """F-8: listings per district on every row (null for a null district; 0 when there is no district column).

    Counted with a partial aggregate and joined back without moving the listings of a hot district to one task."""
    if district not in df.columns:
        return df.withColumn("neighborhood_count", F.lit(0).cast("long"))
    counts = (df.where(F.col(district).isNotNull()).groupBy(district)
              .agg(F.count(id_col).alias("neighborhood_count")))
    return join_group_stats(df, counts, [district], "left")


def engineer_listings(df: DataFrame, as_of: dt.date | str, **qkw) -> DataFrame:
    """F-1 .. F-8 in the reference's order."""
    out = price_ratios(df)
    out = host_activity(out, as_of)
    out = popularity(out, **qkw)
    out = listing_score(out)
    out = response_features(out)
    out = flag_features(out)
    out = price_category(out, **qkw)
    return district_counts(out)


def calendar_parts(df: DataFrame, date="date") -> DataFrame:
    """F-9: year, month, day, day_of_week (Monday = 0), quarter, is_weekend (Sat/Sun) and season."""
    if date not in df.columns:
        return df
    d = F.col(date)
    season = None
    for m, name in SEASONS.items():
        season = F.when(F.month(d) == m, name) if season is None else season.when(F.month(d) == m, name)
    return (df.withColumn("year", F.year(d)).withColumn("month", F.month(d)).withColumn("day", F.dayofmonth(d))
            .withColumn("day_of_week", F.weekday(d)).withColumn("quarter", F.quarter(d))
            .withColumn("is_weekend", F.weekday(d).isin(5, 6).cast("int")).withColumn("season", season))


def engineer_all(data: dict[str, DataFrame], as_of: dt.date | str, **qkw) -> dict[str, DataFrame]:
    """F-10: listings and calendar features; other tables pass through."""
    out: dict[str, DataFrame] = {}
    if "listings" in data:
        out["listings"] = engineer_listings(data["listings"], as_of, **qkw)
    if "calendar" in data:
        out["calendar"] = calendar_parts(data["calendar"])
    for k in ("reviews", "neighbourhoods", "neighbourhoods_geojson"):
        if k in data:
            out[k] = data[k]
    return out
