"""Market reports: summaries, distributions, rankings and profiles (A-1 .. A-20).

Rules followed throughout: one scan computes all scalar statistics of a report; per-column statistics are computed
on an unpivoted long form keyed by column name (one job for any number of columns); quantiles are exact
(``semantics.quantiles``); rankings are bounded top-k with the key as tie-break.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staylens.functions.semantics import (
    checkpointed, column_quantiles, drop_null_keys, evaluated_once, hash_order, join_group_stats, nan_to_null, quantiles,
    round_half_up, sample_skew, with_scalars,
)

# Columns the reference's correlation heat map considers (fixed list; only present ones are used).
HEATMAP_COLUMNS = ["price", "accommodates", "bathrooms", "bedrooms", "beds", "number_of_reviews",
                   "review_scores_rating", "availability_365"]

# Review score columns (fixed list; only present ones are used).
SCORE_COLUMNS = ["review_scores_rating", "review_scores_accuracy", "review_scores_cleanliness",
                 "review_scores_checkin", "review_scores_communication", "review_scores_location",
                 "review_scores_value"]

# Rating-band edges: the 1-5 preset of the agent tool and a 0-100 preset (fixed values).
RATING_BANDS_5 = (4.0, 4.5, 5.0)
RATING_BANDS_100 = (80.0, 90.0, 100.0)

# Rule-based price estimate (fixed values): base, per-guest above 2, per bath above 1, per bedroom, per bed,
# per unavailable day, and the room-type multipliers (default 1.0).
ESTIMATE_BASE = 15_000
ESTIMATE_PER_GUEST = 3_000
ESTIMATE_PER_BATH = 5_000
ESTIMATE_PER_BEDROOM = 8_000
ESTIMATE_PER_BED = 2_000
ESTIMATE_PER_BLOCKED_DAY = 20
ROOM_MULTIPLIERS = {"Entire home/apt": 1.0, "Private room": 0.6, "Shared room": 0.3, "Hotel room": 0.8}


def _long(df: DataFrame, columns: Sequence[str], name="column", value="value") -> DataFrame:
    """Unpivot numeric columns into (column, value double) with NaN as null."""
    cast = df.select(*[nan_to_null(F.col(c).cast("double")).alias(c) for c in columns])
    return cast.unpivot([], list(columns), name, value)


# --- A-1 summary ----------------------------------------------------------------------------------------------

def summary_report(listings: DataFrame, price="price", rating="review_scores_rating",
                   district="neighbourhood_cleansed", room_type="room_type", top=5, **qkw) -> DataFrame:
    """A-1: the summary report in long form (section, key, value), with grouped means as whole numbers too
    (``value_rounded``, half-even; null in other sections). Section and key names are fixed values."""
    p = nan_to_null(F.col(price))
    scal = listings.agg(
        F.count(F.lit(1)).cast("double").alias("total_listings"),
        F.count(p).cast("double").alias("total_listings_with_price"),
        F.avg(p).alias("avg_price"), F.min(p).alias("min_price"), F.max(p).alias("max_price"),
        F.avg(nan_to_null(F.col(rating))).alias("avg_review_score"),
        F.count_distinct(F.col(district)).cast("double").alias("total_neighborhoods"),
    )
    med = quantiles(listings, price, [0.5], names=["median_price"], **qkw)
    wide = scal.crossJoin(med)
    names = ["total_listings", "total_listings_with_price", "avg_price", "median_price", "min_price", "max_price",
             "avg_review_score", "total_neighborhoods"]
    summary = wide.unpivot([], names, "key", "value").select(F.lit("summary").alias("section"), "key", "value")
    rt = drop_null_keys(listings, [room_type]).groupBy(room_type).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.avg(p).alias("m"))
    rt_counts = rt.select(F.lit("room_type_counts").alias("section"), F.col(room_type).alias("key"),
                          F.col("n").alias("value"))
    rt_price = rt.select(F.lit("room_type_avg_price").alias("section"), F.col(room_type).alias("key"),
                         F.col("m").alias("value"))
    nb = drop_null_keys(listings, [district]).groupBy(district).agg(F.avg(p).alias("m")).where(F.col("m").isNotNull())
    dear = nb.orderBy(F.col("m").desc(), F.col(district)).limit(top).select(
        F.lit("top_expensive").alias("section"), F.col(district).alias("key"), F.col("m").alias("value"))
    cheap = nb.orderBy(F.col("m").asc(), F.col(district)).limit(top).select(
        F.lit("top_cheapest").alias("section"), F.col(district).alias("key"), F.col("m").alias("value"))
    out = summary.unionByName(rt_counts).unionByName(rt_price).unionByName(dear).unionByName(cheap)
    grouped = F.col("section").isin("room_type_avg_price", "top_expensive", "top_cheapest")
    return out.withColumn("value_rounded", F.when(grouped, F.bround("value", 0)))


# --- A-2 KPI panel ---------------------------------------------------------------------------------------------

def kpi_panel(filtered: DataFrame, full: DataFrame, price="price", district="neighbourhood_cleansed",
              **qkw) -> DataFrame:
    """A-2: count, mean, mean minus the unfiltered mean, median and distinct districts of the filtered table."""
    p = nan_to_null(F.col(price))
    k = filtered.agg(F.count(F.lit(1)).alias("listings"), F.avg(p).alias("avg_price"),
                     F.count_distinct(district).alias("neighbourhoods"))
    overall = full.agg(F.avg(p).alias("_all"))
    med = quantiles(filtered, price, [0.5], names=["median_price"], **qkw)
    return k.crossJoin(overall).crossJoin(med).select(
        "listings", "avg_price", (F.col("avg_price") - F.col("_all")).alias("avg_vs_all"), "median_price",
        "neighbourhoods")


# --- A-3 histogram ----------------------------------------------------------------------------------------------

def histogram(df: DataFrame, column: str, bins: int = 50, keys: Sequence[str] = ()) -> DataFrame:
    """A-3: exactly ``bins`` equal-width bins between min and max (last bin closed), empty bins included.

    Bin edges come from a one-row (or per-key) min/max aggregate; rows are binned by an expression and counted
    with map-side combine; empty bins come from ``sequence`` over the edges, not from the data.
    """
    keys = list(keys)
    x = nan_to_null(F.col(column).cast("double"))
    base = drop_null_keys(df.select(*keys, x.alias("_x")), keys).where(F.col("_x").isNotNull())
    kcols = keys or ["_g"]
    if not keys:
        base = base.withColumn("_g", F.lit(0))
    rng = base.groupBy(*kcols).agg(F.min("_x").alias("_mn"), F.max("_x").alias("_mx"))
    lo = F.when(F.col("_mn") == F.col("_mx"), F.col("_mn") - 0.5).otherwise(F.col("_mn"))
    hi = F.when(F.col("_mn") == F.col("_mx"), F.col("_mx") + 0.5).otherwise(F.col("_mx"))
    rng = rng.select(*kcols, lo.alias("_lo"), ((hi - lo) / bins).alias("_w"))
    joined = join_group_stats(base, rng, kcols) if keys else base.join(F.broadcast(rng), kcols)
    binned = joined.select(
        *kcols, F.least(F.floor((F.col("_x") - F.col("_lo")) / F.col("_w")), F.lit(bins - 1)).cast("int").alias("bin"))
    counts = binned.groupBy(*kcols, "bin").agg(F.count(F.lit(1)).alias("count"))
    grid = rng.select(*kcols, "_lo", "_w", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    out = grid.join(counts, [*kcols, "bin"], "left").select(
        *keys, "bin", (F.col("_lo") + F.col("bin") * F.col("_w")).alias("bin_start"),
        (F.col("_lo") + (F.col("bin") + 1) * F.col("_w")).alias("bin_end"),
        F.coalesce(F.col("count"), F.lit(0)).cast("long").alias("count"))
    return out


def histogram_lines(df: DataFrame, column: str, **qkw) -> DataFrame:
    """A-3: the two reference lines of a histogram: mean and median of the column, in one row."""
    x = nan_to_null(F.col(column).cast("double"))
    return df.agg(F.avg(x).alias("mean")).crossJoin(quantiles(df, column, [0.5], names=["median"], **qkw))


# --- A-4 / A-7 / A-9 / A-19 grouped means and counts ----------------------------------------------------------------

def mean_by(df: DataFrame, key: str, value="price", name="avg_price") -> DataFrame:
    """A-4: mean of ``value`` per key, ascending (null keys dropped)."""
    return drop_null_keys(df, [key]).groupBy(key).agg(F.avg(nan_to_null(F.col(value))).alias(name)).orderBy(name, key)


def top_districts(df: DataFrame, n: int = 10, order: str = "expensive", price="price",
                  district="neighbourhood_cleansed") -> DataFrame:
    """A-7: n most expensive (or cheapest) districts by mean price, with listing counts."""
    g = drop_null_keys(df, [district]).groupBy(district).agg(
        F.avg(nan_to_null(F.col(price))).alias("mean"), F.count(nan_to_null(F.col(price))).alias("count"))
    m = F.col("mean").asc_nulls_last() if order == "cheapest" else F.col("mean").desc_nulls_last()
    return g.orderBy(m, F.col(district)).limit(n)


def district_treemap(df: DataFrame, price="price", district="neighbourhood_cleansed") -> DataFrame:
    """A-9: mean price and priced-listing count per district."""
    p = nan_to_null(F.col(price))
    return drop_null_keys(df, [district]).groupBy(district).agg(F.avg(p).alias("avg_price"),
                                                                F.count(p).alias("listings"))


def value_counts(df: DataFrame, column: str, top: int | None = None) -> DataFrame:
    """A-19: rows per value (nulls dropped), largest first, optionally top n."""
    g = drop_null_keys(df, [column]).groupBy(column).agg(F.count(F.lit(1)).alias("count"))
    g = g.orderBy(F.col("count").desc(), F.col(column))
    return g.limit(top) if top else g


# --- A-5 / A-6 box statistics --------------------------------------------------------------------------------------

def box_stats(df: DataFrame, key: str, value="price", whisker: float | None = 1.5, below: float | None = 100_000,
              **qkw) -> DataFrame:
    """A-5: quartiles per group; Tukey whiskers (furthest points inside q1 - k·IQR, q3 + k·IQR) and outlier counts.
    ``whisker=None`` gives min/max whiskers (A-6)."""
    v = nan_to_null(F.col(value))
    base = drop_null_keys(df.select(key, v.alias(value)), [key]).where(F.col(value).isNotNull())
    if below is not None:
        base = base.where(F.col(value) < below)
    q = quantiles(base, value, [0.25, 0.5, 0.75], [key], ["q1", "median", "q3"], **qkw)
    if whisker is None:
        mm = base.groupBy(key).agg(F.count(value).alias("n"), F.min(value).alias("whisker_low"),
                                   F.max(value).alias("whisker_high"))
        return q.join(mm, key).withColumn("outliers", F.lit(0).cast("long"))
    fences = q.select(key, "q1", "median", "q3",
                      (F.col("q1") - whisker * (F.col("q3") - F.col("q1"))).alias("_lf"),
                      (F.col("q3") + whisker * (F.col("q3") - F.col("q1"))).alias("_hf"))
    inside = (F.col(value) >= F.col("_lf")) & (F.col(value) <= F.col("_hf"))
    j = join_group_stats(base, fences, [key])
    agg = j.groupBy(key).agg(
        F.count(value).alias("n"),
        F.min(F.when(inside, F.col(value))).alias("whisker_low"),
        F.max(F.when(inside, F.col(value))).alias("whisker_high"),
        F.count(F.when(~inside, F.lit(1))).alias("outliers"))
    return fences.drop("_lf", "_hf").join(agg, key)


def top_district_boxes(df: DataFrame, top_n: int = 10, price="price", district="neighbourhood_cleansed",
                       below: float = 100_000, **qkw) -> DataFrame:
    """A-6: min/max box statistics for the ``top_n`` districts by mean price (semi join on the top-k frame),
    prices below ``below``; ``rank`` orders them by median, highest first."""
    top = top_districts(df, top_n, "expensive", price, district).select(district)
    picked = df.join(top, district, "left_semi")
    boxes = box_stats(picked, district, price, whisker=None, below=below, **qkw)
    ranked = boxes.orderBy(F.col("median").desc(), F.col(district)).limit(top_n)
    return ranked


# --- A-8 / I-4 correlations -------------------------------------------------------------------------------------------

def correlation_matrix(df: DataFrame, columns: Sequence[str] = HEATMAP_COLUMNS) -> DataFrame:
    """A-8: pairwise-complete Pearson matrix in long form (a, b, r); one aggregate for all pairs."""
    cols = [c for c in columns if c in df.columns]
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    casted = df.select(*[nan_to_null(F.col(c).cast("double")).alias(c) for c in cols])
    wide = casted.agg(*[F.corr(a, b).alias(f"{i}") for i, (a, b) in enumerate(pairs)])
    names = [f"{i}" for i in range(len(pairs))]
    long = wide.unpivot([], names, "_p", "r")
    lut = df.sparkSession.createDataFrame([(f"{i}", a, b) for i, (a, b) in enumerate(pairs)], "_p string, a string, b string")
    upper = long.join(F.broadcast(lut), "_p").select("a", "b", nan_to_null("r").alias("r"))
    lower = upper.where(F.col("a") != F.col("b")).select(F.col("b").alias("a"), F.col("a").alias("b"), "r")
    return upper.unionByName(lower)


# --- A-10 price vs rating -----------------------------------------------------------------------------------------

def price_vs_rating(df: DataFrame, price="price", rating="review_scores_rating", district="neighbourhood_cleansed",
                    id_col="id", **qkw) -> DataFrame:
    """A-10: per district mean price, mean rating, listings; medians across districts; quadrant label.
    'best value' = mean price at or below the median and mean rating at or above the median."""
    g = checkpointed(drop_null_keys(df, [district]).groupBy(district).agg(
        F.avg(nan_to_null(F.col(price))).alias("avg_price"), F.avg(nan_to_null(F.col(rating))).alias("avg_rating"),
        F.count(id_col).alias("listings")).where(F.col("avg_rating").isNotNull()))
    meds = column_quantiles(g, {"med_price": ("avg_price", 0.5), "med_rating": ("avg_rating", 0.5)}, **qkw)
    cheap = F.col("avg_price") <= F.col("med_price")
    good = F.col("avg_rating") >= F.col("med_rating")
    quadrant = (F.when(cheap & good, "best value").when(~cheap & good, "premium")
                .when(cheap & ~good, "budget").otherwise("overpriced"))
    return with_scalars(g, meds).withColumn("quadrant", quadrant)


# --- A-11 rule-based estimate -------------------------------------------------------------------------------------------

def price_estimate(df: DataFrame, accommodates="accommodates", bathrooms: str | float = 1.0,
                   bedrooms: str | float = 1.0, beds: str | float = 2.0, availability="availability_365",
                   room_type="room_type", noise_seed: int | None = None, id_col="id") -> DataFrame:
    """A-11: the rule-based nightly price for every row. Attributes may be columns or constants; ``noise_seed``
    turns on a reproducible ×[0.9, 1.1) factor from md5(id|seed)."""

    def v(x):
        return F.col(x).cast("double") if isinstance(x, str) else F.lit(float(x))

    base = (F.lit(float(ESTIMATE_BASE)) + (v(accommodates) - 2) * ESTIMATE_PER_GUEST
            + (v(bathrooms) - 1) * ESTIMATE_PER_BATH + v(bedrooms) * ESTIMATE_PER_BEDROOM
            + v(beds) * ESTIMATE_PER_BED + (365 - v(availability)) * ESTIMATE_PER_BLOCKED_DAY)
    mult = F.lit(1.0)
    for rt, m in ROOM_MULTIPLIERS.items():
        mult = F.when(F.col(room_type) == rt, F.lit(m)).otherwise(mult) if rt else mult
    est = base * mult
    if noise_seed is not None:
        u = F.conv(F.substring(hash_order(id_col, noise_seed), 1, 8), 16, 10).cast("double") / 4294967296.0
        est = est * (F.lit(0.9) + 0.2 * u)
    return df.withColumn("estimated_price", est.cast("long"))


# --- A-12 / A-18 distribution statistics ----------------------------------------------------------------------------------

def distribution_stats(df: DataFrame, columns: Sequence[str], **qkw) -> DataFrame:
    """A-12 (one column) and A-18 (all numeric columns): count, mean, median, sd (n-1), min, q1, q3, max, bias-
    corrected skew and its label, nulls and null %. One unpivot, one grouped aggregate, one quantile job."""
    with evaluated_once(_long(df, columns)) as long:
        stats = checkpointed(long.groupBy("column").agg(
            F.count(F.lit(1)).alias("_rows"), F.count("value").alias("count"), F.avg("value").alias("mean"),
            F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"),
            sample_skew("value").alias("skew")))
        q = quantiles(long, "value", [0.25, 0.5, 0.75], ["column"], ["q1", "median", "q3"], **qkw)
    out = stats.join(q, "column", "left")
    label = (F.when(F.col("skew") > 0.5, "right-skewed").when(F.col("skew") < -0.5, "left-skewed")
             .otherwise("roughly symmetric"))
    nulls = F.col("_rows") - F.col("count")
    return out.select("column", "count", "mean", "median", "std", "min", "q1", "q3", "max", "skew",
                      label.alias("skew_label"), nulls.alias("nulls"),
                      F.try_divide(nulls * 100.0, F.col("_rows")).alias("null_pct"))


# --- A-13 missing shares -------------------------------------------------------------------------------------------

def missing_report(df: DataFrame, digits: int = 1) -> DataFrame:
    """A-13: % missing per column (NaN counts as missing), rounded half-even, only > 0, ascending."""
    def miss(c):
        f = df.schema[c].dataType.simpleString()
        isn = F.col(c).isNull() | F.isnan(F.col(c)) if f in ("double", "float") else F.col(c).isNull()
        return F.avg(isn.cast("double")).alias(c)

    cols = df.columns
    wide = df.agg(*[miss(c) for c in cols])
    long = wide.unpivot([], cols, "column", "share")
    return (long.select("column", (F.col("share") * 100).alias("pct_exact"),
                        F.bround(F.col("share") * 100, digits).alias("pct_missing"))
            .where(F.col("pct_missing") > 0).orderBy("pct_missing", "column"))


# --- A-14 district comparison -------------------------------------------------------------------------------------------

def district_comparison(df: DataFrame, districts: Sequence[str] | None = None, min_listings: int = 10,
                        price="price", rating="review_scores_rating", availability="availability_365",
                        district="neighbourhood_cleansed", id_col="id", **qkw) -> DataFrame:
    """A-14: for districts with at least ``min_listings`` rows (optionally only the chosen ones): listings, mean,
    median, min, max price, mean rating and mean availability; ``*_1`` are the same to one place (half-even)."""
    base = drop_null_keys(df, [district])
    if districts:
        base = base.where(F.col(district).isin(list(districts)))
    p = nan_to_null(F.col(price))
    g = base.groupBy(district).agg(
        F.count(F.lit(1)).alias("_rows"), F.count(id_col).alias("listings"), F.avg(p).alias("avg_price"),
        F.min(p).alias("min_price"), F.max(p).alias("max_price"),
        F.avg(nan_to_null(F.col(rating))).alias("avg_rating"),
        F.avg(nan_to_null(F.col(availability))).alias("avg_availability")).where(F.col("_rows") >= min_listings)
    med = quantiles(base.join(g.select(district), district, "left_semi"), price, [0.5], [district],
                    ["median_price"], **qkw)
    names = ["avg_price", "median_price", "min_price", "max_price", "avg_rating", "avg_availability"]
    return g.join(med, district, "left").select(
        district, "listings", *names, *[F.bround(c, 1).alias(f"{c}_1") for c in names])


# --- A-15 / A-16 review scores --------------------------------------------------------------------------------------------

def review_score_stats(df: DataFrame, columns: Sequence[str] = SCORE_COLUMNS, **qkw) -> DataFrame:
    """A-15: mean, median and count of each present score column (nulls skipped per column), and mean and median to
    two places (half-even)."""
    cols = [c for c in columns if c in df.columns]
    long = _long(df, cols, "score", "value").where(F.col("value").isNotNull())
    stats = long.groupBy("score").agg(F.avg("value").alias("mean"), F.count("value").alias("count"))
    med = quantiles(long, "value", [0.5], ["score"], ["median"], **qkw)
    label = F.regexp_replace("score", "^review_scores_", "")
    return stats.join(med, "score").select(label.alias("score"), "mean", "median", "count",
                                           F.bround("mean", 2).alias("mean_2"), F.bround("median", 2).alias("median_2"))


def rating_bands(df: DataFrame, rating="review_scores_rating", edges: tuple[float, float, float] = RATING_BANDS_5):
    """A-16: rows at the top score, in [e1, top), [e0, e1), below e0; reviewed and total rows."""
    e0, e1, top = edges
    r = nan_to_null(F.col(rating))
    return df.agg(
        F.count(F.when(r == top, 1)).alias("band_top"),
        F.count(F.when((r >= e1) & (r < top), 1)).alias("band_high"),
        F.count(F.when((r >= e0) & (r < e1), 1)).alias("band_mid"),
        F.count(F.when(r < e0, 1)).alias("band_low"),
        F.count(r).alias("reviewed_listings"),
        F.count(F.lit(1)).alias("total_listings"))


# --- A-17 recommendation ------------------------------------------------------------------------------------------

def recommend_neighborhood(df: DataFrame, budget: float = 20_000, room_type_value: str = "Entire home/apt",
                           min_count: int = 10, top: int = 10, price="price", rating="review_scores_rating",
                           room_type="room_type", district="neighbourhood_cleansed") -> DataFrame:
    """A-17: districts with at least ``min_count`` priced listings within budget for a room type; means rounded
    to 2 places (half-up, the same formula in every engine) and ranked by rounded mean rating."""
    p = nan_to_null(F.col(price))
    base = drop_null_keys(df.where((p <= budget) & (F.col(room_type) == room_type_value)), [district])
    g = base.groupBy(district).agg(F.count(p).alias("count"), F.avg(p).alias("_p"),
                                   F.avg(nan_to_null(F.col(rating))).alias("_r"))
    g = g.select(district, "count", round_half_up("_p", 2).alias("avg_price"),
                 round_half_up("_r", 2).alias("avg_rating"))
    return g.where(F.col("count") >= min_count).orderBy(F.col("avg_rating").desc_nulls_last(), F.col(district)).limit(top)


def all_reports(listings: DataFrame, **qkw) -> dict[str, DataFrame]:
    """A-20: the standard report set, lazily (nothing runs until a frame is used)."""
    return {
        "price_histogram": histogram(listings, "price", 50),
        "room_type_boxes": box_stats(listings, "room_type", **qkw),
        "top_districts": top_districts(listings),
        "correlations": correlation_matrix(listings),
        "summary": summary_report(listings, **qkw),
    }
