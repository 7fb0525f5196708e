"""Market segments (G-1 .. G-6, G-11): standardised features, K-Means with restarts, elbow, names and summaries.

Scaling statistics are one global aggregate (a one-row frame, broadcast). K-Means itself is in ``kmeans``: packed blocks
of complete rows, all restarts and all k in one job per iteration, and bounds that spare most distances.
Labelling does not join back: the fitted centres (k x d numbers, bounded by k) are applied to every
listing by a native arg-min expression, so rows with a missing feature get a null label with no shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staylens.functions.semantics import nan_to_null, with_scalars
from staylens.operators import kmeans
from staylens.operators.kmeans import MAX_ITER, TOL

FEATURES = ("latitude", "longitude", "price")
N_INIT = 10
SEED = 42
MAX_K = 10
# Segment naming (fixed values, parameters of ``name_segments``): mean price above 30,000 Luxury, above 20,000
# Premium, above 12,000 Standard, else Budget; mean latitude above 35.75 North, above 35.65 Central, else South.
PRICE_LEVELS = ((30_000, "Luxury"), (20_000, "Premium"), (12_000, "Standard"))
PRICE_DEFAULT = "Budget"
AREA_LEVELS = ((35.75, "North"), (35.65, "Central"))
AREA_DEFAULT = "South"


def _z(i: int) -> str:
    return f"_z{i}"


def feature_stats(df: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    """One row: count of complete rows, mean and population sd of each feature over them (N7)."""
    complete = _complete(df, features)
    aggs = [F.count(F.lit(1)).alias("_n")]
    for i, c in enumerate(features):
        aggs += [F.avg(c).alias(f"_m{i}"), F.stddev_pop(c).alias(f"_s{i}")]
    return complete.agg(*aggs)


def _complete(df: DataFrame, features: Sequence[str]) -> DataFrame:
    cond = None
    for c in features:
        x = nan_to_null(F.col(c)).isNotNull()
        cond = x if cond is None else cond & x
    return df.where(cond)


def scale(df: DataFrame, stats: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    """G-1: add ``_z<i>`` = (x - mean) / sd for every feature (sd 0 scales by 1, as the standard scaler does);
    null on rows with any feature missing."""
    j = with_scalars(df, stats)
    complete = None
    for c in features:
        x = nan_to_null(F.col(c)).isNotNull()
        complete = x if complete is None else complete & x
    cols = []
    for i, c in enumerate(features):
        sd = F.when(F.col(f"_s{i}") == 0, F.lit(1.0)).otherwise(F.col(f"_s{i}"))
        cols.append(F.when(complete, (F.col(c) - F.col(f"_m{i}")) / sd).alias(_z(i)))
    drop = ["_n"] + [f"_{p}{i}" for i in range(len(features)) for p in "ms"]
    return j.select(*[c for c in j.columns if c not in drop], *cols)


def _rows(scaled: DataFrame, d: int) -> DataFrame:
    """The scaled features of complete rows."""
    return scaled.where(F.col(_z(0)).isNotNull()).select(*[_z(i) for i in range(d)])


def _total_ss(scaled: DataFrame, d: int) -> float:
    """Cost at k = 1: squared distance of every complete row to the feature means (MLlib refuses k = 1)."""
    rows = scaled.where(F.col(_z(0)).isNotNull())
    means = rows.agg(*[F.avg(_z(i)).alias(f"m{i}") for i in range(d)])
    ss = sum((F.col(_z(i)) - F.col(f"m{i}")) ** 2 for i in range(d))
    return float(with_scalars(rows, means).agg(F.sum(ss)).first()[0] or 0.0)


def check_segments(listings: DataFrame, k: int = 5, features: Sequence[str] = FEATURES, near: float = 1e-2, **kw) -> DataFrame:
    """One row of what K-Means promises: complete rows, clusters, whether every row has its nearest centre, whether every
    centre is the mean of its rows (to ``near`` in scaled units), and whether the cost is below that of one cluster."""
    features = tuple(c for c in features if c in listings.columns)
    d = len(features)
    labelled, cost, centres = cluster(listings, k, features, **kw)
    scaled = scale(labelled, feature_stats(listings, features), features).where(F.col("cluster").isNotNull())
    squares = [sum((F.col(_z(i)) - F.lit(float(c[i]))) ** 2 for i in range(d)) for c in centres]
    own = F.element_at(F.array(*squares), F.col("cluster") + 1)
    per = scaled.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("rows"), F.max(own - F.least(*squares)).alias("excess"), F.sum(own).alias("cost"),
        F.sum(sum(F.col(_z(i)) ** 2 for i in range(d))).alias("one"),
        *[F.avg(_z(i)).alias(f"m{i}") for i in range(d)])
    of = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in centres])
    away = sum((F.col(f"m{i}") - F.element_at(of, F.col("cluster") + 1)[i]) ** 2 for i in range(d))
    return per.agg(F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("clusters"), (F.max("excess") <= 1e-9).alias("nearest"),
                   (F.max(away) <= near ** 2).alias("centred"),
                   ((F.sum("cost") <= F.sum("one")) & (F.abs(F.sum("cost") - cost) <= 1e-6 * F.lit(max(cost, 1.0)))).alias("cheaper"),
                   F.sum("one").alias("one_cluster_cost"))


def assign(scaled: DataFrame, centres: Sequence[Sequence[float]], d: int, name: str = "cluster") -> DataFrame:
    """Nearest centre (squared Euclidean, lowest index on ties) as a native expression; null when incomplete."""
    if not centres:
        return scaled.withColumn(name, F.lit(None).cast("int"))
    dists = [sum((F.col(_z(i)) - F.lit(float(c[i]))) ** 2 for i in range(d)) for c in centres]
    # Generated rather than projected: a filter on the cluster would be pushed below a projection and measure all distances again.
    far = scaled.select("*", F.explode(F.array(F.array(*dists))).alias("_far"))
    nearest = F.array_position("_far", F.array_min("_far")) - 1
    return far.withColumn(name, F.when(F.col(_z(0)).isNotNull(), nearest).cast("int")).drop("_far")


def cluster(listings: DataFrame, k: int = 5, features: Sequence[str] = FEATURES, n_init: int = N_INIT,
            seed: int = SEED, max_iter: int = MAX_ITER, tol: float = TOL) -> tuple[DataFrame, float,
                                                                                  list[list[float]]]:
    """G-3: label every listing with its segment (null when a feature is missing). Returns (labelled, cost,
    centres in scaled space). Features that the table lacks are left out: without prices, coordinates alone decide."""
    features = tuple(c for c in features if c in listings.columns)
    d = len(features)
    scaled = scale(listings, feature_stats(listings, features), features)
    rows = _rows(scaled, d).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        cost, centres, _ = kmeans.best_of_restarts(rows, [k], n_init, seed, max_iter, tol)[k]
    finally:
        rows.unpersist()
    labelled = assign(scaled, centres, d).drop(*[_z(i) for i in range(d)])
    return labelled, cost, centres


def elbow(listings: DataFrame, max_k: int = MAX_K, features: Sequence[str] = FEATURES, n_init: int = N_INIT,
          seed: int = SEED, max_iter: int = MAX_ITER, tol: float = TOL) -> DataFrame:
    """G-2: cost for k = 1..max_k and the chosen k: the reference rule argmin(diff(costs)[1:]) + 2, i.e. the k
    just before the steepest drop after the first one."""
    d = len(features)
    scaled = scale(listings, feature_stats(listings, features), features)
    rows = _rows(scaled, d).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        fits = kmeans.best_of_restarts(rows, range(2, max_k + 1), n_init, seed, max_iter, tol)
        costs = [_total_ss(scaled, d)] + [fits[k][0] for k in range(2, max_k + 1)]
    finally:
        rows.unpersist()
    diffs = [b - a for a, b in zip(costs, costs[1:])]
    rest = diffs[1:]
    optimal = (rest.index(min(rest)) + 2) if rest else 1
    spark = listings.sparkSession
    rows = [(k, float(c), optimal) for k, c in enumerate(costs, start=1)]
    return spark.createDataFrame(rows, "k int, inertia double, optimal_k int")


def _level(x, levels, default) -> F.Column:
    expr = None
    for edge, label in levels:
        expr = F.when(x > edge, F.lit(label)) if expr is None else expr.when(x > edge, F.lit(label))
    return expr.otherwise(F.lit(default))


def name_segments(labelled: DataFrame, cluster_col="cluster", price="price", lat="latitude",
                  price_levels=PRICE_LEVELS, area_levels=AREA_LEVELS) -> DataFrame:
    """G-4: name every cluster from its mean price and mean latitude, and attach ``cluster_name``. The per-cluster
    frame has one row per cluster (bounded by k), so the join back is a broadcast."""
    names = (labelled.where(F.col(cluster_col).isNotNull()).groupBy(cluster_col)
             .agg(F.avg(price).alias("_p"), F.avg(lat).alias("_lat"))
             .select(cluster_col, F.concat_ws(" ", _level(F.col("_p"), price_levels, PRICE_DEFAULT),
                                              _level(F.col("_lat"), area_levels, AREA_DEFAULT)).alias("cluster_name")))
    return labelled.join(F.broadcast(names), cluster_col, "left")


def segment_stats(named: DataFrame, cluster_col="cluster", price="price", lat="latitude", lon="longitude"):
    """G-5: per cluster: priced count, mean and sample sd of price, centre."""
    return named.where(F.col(cluster_col).isNotNull()).groupBy(cluster_col).agg(
        F.count(price).alias("count"), F.avg(price).alias("price_mean"), F.stddev_samp(price).alias("price_std"),
        F.avg(lat).alias("latitude_mean"), F.avg(lon).alias("longitude_mean"))


def segment_summary(named: DataFrame, cluster_col="cluster", id_col="id", price="price", lat="latitude",
                    lon="longitude", digits: int | None = 2) -> DataFrame:
    """G-6: per (cluster, name): listing count, mean / min / max price, centre; rounded to ``digits``."""
    rnd = (lambda c: F.bround(c, digits)) if digits is not None else (lambda c: c)
    return named.where(F.col(cluster_col).isNotNull()).groupBy(cluster_col, "cluster_name").agg(
        F.count(id_col).alias("count"), rnd(F.avg(price)).alias("avg_price"), rnd(F.min(price)).alias("min_price"),
        rnd(F.max(price)).alias("max_price"), rnd(F.avg(lat)).alias("avg_lat"), rnd(F.avg(lon)).alias("avg_lon"))


def segment_legend(named: DataFrame, cluster_col="cluster") -> DataFrame:
    """G-11: one name per cluster (names can repeat across clusters)."""
    return named.where(F.col(cluster_col).isNotNull()).groupBy(cluster_col).agg(
        F.min("cluster_name").alias("cluster_name"))
