"""Segment and map queries (G-1 .. G-11) over the listings role (synthetic coordinates, see the role view)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from staylens.functions.semantics import checkpointed, r4
from staylens.operators import geo as G
from staylens.operators import segments as S
from staylens.plans.catalog.reports import _r4all
from staylens.plans.registry import register
from staylens.sources import roles

L = ("listings",)

# Fixed centres in the standardised (lat, lon, price) space for the checkable labelling path (fixed values):
# the four lat/lon quadrants at average price, and a dearer centre in the middle.
DEMO_CENTRES = [(-1.0, -1.0, 0.0), (-1.0, 1.0, 0.0), (1.0, -1.0, 0.0), (1.0, 1.0, 0.0), (0.0, 0.0, 1.5)]


def _scaled_sql() -> str:
    return """
c AS (SELECT id, latitude, longitude, price FROM listings
      WHERE latitude IS NOT NULL AND longitude IS NOT NULL AND price IS NOT NULL),
st AS (SELECT avg(latitude) AS m0, stddev_pop(latitude) AS s0, avg(longitude) AS m1, stddev_pop(longitude) AS s1,
              avg(price) AS m2, stddev_pop(price) AS s2 FROM c),
z AS (SELECT c.id, (latitude - m0) / CASE WHEN s0 = 0 THEN 1 ELSE s0 END AS z0,
             (longitude - m1) / CASE WHEN s1 = 0 THEN 1 ELSE s1 END AS z1,
             (price - m2) / CASE WHEN s2 = 0 THEN 1 ELSE s2 END AS z2 FROM c, st)"""


def _labelled_sql() -> str:
    dists = [f"(z0 - ({a})::DOUBLE) ** 2 + (z1 - ({b})::DOUBLE) ** 2 + (z2 - ({c})::DOUBLE) ** 2"
             for a, b, c in DEMO_CENTRES]
    cols = ", ".join(f"{d} AS d{j}" for j, d in enumerate(dists))
    best = "least(" + ", ".join(f"d{j}" for j in range(len(dists))) + ")"
    case = " ".join(f"WHEN d{j} = {best} THEN {j}" for j in range(len(dists)))
    return _scaled_sql() + f""",
dz AS (SELECT id, {cols} FROM z),
lab AS (SELECT l.*, CAST(CASE {case} END AS INTEGER) AS cluster FROM listings l LEFT JOIN dz ON l.id = dz.id),
nm AS (SELECT cluster, avg(price) AS p, avg(latitude) AS lat FROM lab WHERE cluster IS NOT NULL GROUP BY 1),
names AS (SELECT cluster, p, lat,
                 CASE WHEN p > 30000 THEN 'Luxury' WHEN p > 20000 THEN 'Premium' WHEN p > 12000 THEN 'Standard'
                      ELSE 'Budget' END || ' ' ||
                 CASE WHEN lat > 35.75::DOUBLE THEN 'North' WHEN lat > 35.65::DOUBLE THEN 'Central' ELSE 'South' END
                   AS cluster_name FROM nm),
named AS (SELECT lab.*, names.cluster_name FROM lab LEFT JOIN names USING (cluster))"""


def _located(spark, d):
    """What segments need of every listing, joined together once for all passes."""
    return checkpointed(roles.listings(spark, d).select("id", *S.FEATURES))


def _demo_named(spark, d):
    li = _located(spark, d)
    scaled = S.scale(li, S.feature_stats(li))
    labelled = S.assign(scaled, DEMO_CENTRES, 3).drop("_z0", "_z1", "_z2")
    return S.name_segments(labelled)


@register("g1_scaled_features", roles=L, sql=f"""
WITH {_scaled_sql().strip()}
SELECT id, round(z0, 4) AS lat_z, round(z1, 4) AS lon_z, round(z2, 4) AS price_z FROM z
""")
def g1_scaled_features(spark, d):
    li = roles.listings(spark, d)
    z = S.scale(li, S.feature_stats(li)).where(F.col("_z0").isNotNull())
    return z.select("id", r4("_z0").alias("lat_z"), r4("_z1").alias("lon_z"), r4("_z2").alias("price_z"))


@register("g4_segment_names", roles=L, sql=f"""
WITH {_labelled_sql().strip()}
SELECT cluster, round(p, 4) AS avg_price, round(lat, 4) AS avg_lat, cluster_name FROM names
""")
def g4_segment_names(spark, d):
    named = _demo_named(spark, d)
    return _r4all(named.where(F.col("cluster").isNotNull()).groupBy("cluster", "cluster_name").agg(
        F.avg("price").alias("avg_price"), F.avg("latitude").alias("avg_lat")))


@register("g5_segment_stats", roles=L, sql=f"""
WITH {_labelled_sql().strip()}
SELECT cluster, count(price)::BIGINT AS count, round(avg(price), 4) AS price_mean,
       round(stddev_samp(price), 4) AS price_std, round(avg(latitude), 4) AS latitude_mean,
       round(avg(longitude), 4) AS longitude_mean
FROM named WHERE cluster IS NOT NULL GROUP BY cluster
""")
def g5_segment_stats(spark, d):
    return _r4all(S.segment_stats(_demo_named(spark, d)))


@register("g6_segment_summary", roles=L, sql=f"""
WITH {_labelled_sql().strip()}
SELECT cluster, cluster_name, count(id)::BIGINT AS count, round(avg(price), 4) AS avg_price,
       round(min(price), 4) AS min_price, round(max(price), 4) AS max_price, round(avg(latitude), 4) AS avg_lat,
       round(avg(longitude), 4) AS avg_lon
FROM named WHERE cluster IS NOT NULL GROUP BY cluster, cluster_name
""")
def g6_segment_summary(spark, d):
    return _r4all(S.segment_summary(_demo_named(spark, d), digits=None))


@register("g11_segment_legend", roles=L, sql=f"""
WITH {_labelled_sql().strip()}
SELECT cluster, min(cluster_name) AS cluster_name FROM named WHERE cluster IS NOT NULL GROUP BY cluster
""")
def g11_segment_legend(spark, d):
    return S.segment_legend(_demo_named(spark, d))


@register("g2_elbow")
def g2_elbow(spark, d):
    """Costs for k = 1..10 with 10 restarts each and the chosen k (model output; rows-only)."""
    return _r4all(S.elbow(_located(spark, d), max_k=10))


@register("g3_kmeans_segments")
def g3_kmeans_segments(spark, d):
    """K-Means (k = 5, 10 restarts) labels and names on every listing (model output; rows-only)."""
    labelled, _, _ = S.cluster(_located(spark, d), k=5)
    return S.name_segments(labelled).select("id", "cluster", "cluster_name")


@register("g3_kmeans_holds", roles=L, sql=f"""
WITH {_scaled_sql().strip()}
SELECT count(*)::BIGINT AS rows, 5::BIGINT AS clusters, true AS nearest, true AS centred, true AS cheaper,
       round(sum(z0 * z0 + z1 * z1 + z2 * z2) / count(*), 4) AS one_cluster_cost FROM z
""")
def g3_kmeans_holds(spark, d):
    """What any K-Means result must satisfy, and the cost per row of a single cluster."""
    out = S.check_segments(_located(spark, d), k=5)
    return out.withColumn("one_cluster_cost", r4(F.col("one_cluster_cost") / F.col("rows")))


@register("g6_kmeans_summary")
def g6_kmeans_summary(spark, d):
    labelled, _, _ = S.cluster(_located(spark, d), k=5)
    return S.segment_summary(S.name_segments(labelled))


@register("g7_district_map", roles=L, sql="""
WITH st AS (SELECT neighbourhood_cleansed AS d, avg(price) AS avg_price, count(id) AS n FROM listings
            WHERE neighbourhood_cleansed IS NOT NULL GROUP BY 1),
j AS (SELECT n.n_name AS name, st.avg_price, coalesce(st.n, 0)::BIGINT AS listings,
             CASE WHEN st.avg_price IS NULL THEN 'No data' ELSE '¥' || format('{:,.0f}', st.avg_price) END AS price_label
      FROM nation n LEFT JOIN st ON n.n_name = st.d)
SELECT name, round(avg_price, 4) AS avg_price, price_label, listings,
       '{"type":"Feature","properties":{"neighbourhood":"' || name || '","avg_price_fmt":"' || price_label ||
       '","listing_count":"' || format('{:,}', listings) || '"},"geometry":null}' AS feature
FROM j
""")
def g7_district_map(spark, d):
    return _r4all(G.district_map(roles.districts(spark, d), roles.listings(spark, d)))


@register("g8_grid_density", roles=L, sql="""
SELECT CAST(floor(latitude / 0.01::DOUBLE) AS BIGINT) AS lat_cell, CAST(floor(longitude / 0.01::DOUBLE) AS BIGINT)
       AS lon_cell, round(CAST(floor(latitude / 0.01::DOUBLE) AS BIGINT) * 0.01::DOUBLE, 4) AS lat0,
       round(CAST(floor(longitude / 0.01::DOUBLE) AS BIGINT) * 0.01::DOUBLE, 4) AS lon0, count(*)::BIGINT AS count
FROM listings WHERE latitude IS NOT NULL AND longitude IS NOT NULL GROUP BY 1, 2, 3, 4
""")
def g8_grid_density(spark, d):
    return _r4all(G.grid_density(roles.listings(spark, d), 0.01))


@register("g8_kernel_density", roles=L, sql=f"""
WITH k AS (SELECT * FROM (VALUES {", ".join(f"({i}, {j}, {w!r}::DOUBLE)" for i, j, w in G.kernel_weights())}) AS x(i, j, w)),
c AS (SELECT CAST(floor(latitude / 0.01::DOUBLE) AS BIGINT) AS lat_cell, CAST(floor(longitude / 0.01::DOUBLE) AS BIGINT) AS lon_cell,
             count(*) AS n FROM listings WHERE latitude IS NOT NULL AND longitude IS NOT NULL GROUP BY ALL)
SELECT lat_cell + i AS lat_cell, lon_cell + j AS lon_cell, round(sum(n * w), 4) AS density FROM c, k GROUP BY lat_cell + i, lon_cell + j
""")
def g8_kernel_density(spark, d):
    return _r4all(G.kernel_density(roles.listings(spark, d), 0.01))


@register("g9_cluster_totals", roles=L, sql=f"""
SELECT zoom, count(*)::BIGINT AS listings, true AS apart
FROM listings, (SELECT unnest(range({len(G.ZOOM_CELLS)}))::INTEGER AS zoom) WHERE latitude IS NOT NULL AND longitude IS NOT NULL GROUP BY zoom
""")
def g9_cluster_totals(spark, d):
    """Marker clusters of all zooms: every listing is in one cluster of each, and zooming out never adds clusters."""
    per = G.marker_clusters(roles.listings(spark, d)).groupBy("zoom").agg(F.sum("count").alias("listings"), F.count(F.lit(1)).alias("n"))
    wider = Window.partitionBy(F.lit(0)).orderBy("zoom")  # one row a zoom
    return per.select("zoom", "listings", (F.col("n") >= F.coalesce(F.lag("n").over(wider), F.lit(0))).alias("apart"))


@register("g9_marker_clusters")
def g9_marker_clusters(spark, d):
    """Clusters by distance for every zoom (an order-bound merge, checked against brute force)."""
    return _r4all(G.marker_clusters(roles.listings(spark, d)))


def _rollup_sql() -> str:
    parts = [f"SELECT {z} AS zoom, CAST(floor(latitude / {s!r}::DOUBLE) AS BIGINT) AS lat_cell, "
             f"CAST(floor(longitude / {s!r}::DOUBLE) AS BIGINT) AS lon_cell, latitude, longitude FROM listings "
             f"WHERE latitude IS NOT NULL AND longitude IS NOT NULL" for z, s in enumerate(G.ZOOM_CELLS)]
    return ("WITH e AS (" + "\nUNION ALL ".join(parts) + ")\nSELECT zoom, lat_cell, lon_cell, count(*)::BIGINT AS count,"
            " round(avg(latitude), 4) AS lat, round(avg(longitude), 4) AS lon FROM e GROUP BY 1, 2, 3")


@register("g9_grid_rollup", roles=L, sql=_rollup_sql())
def g9_grid_rollup(spark, d):
    return _r4all(G.grid_rollup(roles.listings(spark, d)))


@register("g9_marker_sample", roles=L, sql="""
WITH s AS (SELECT * FROM listings ORDER BY md5(concat_ws('|', CAST(id AS VARCHAR), '42')), id LIMIT 2000)
SELECT id, round(latitude, 4) AS latitude, round(longitude, 4) AS longitude FROM s
WHERE latitude IS NOT NULL AND longitude IS NOT NULL
""")
def g9_marker_sample(spark, d):
    return _r4all(G.marker_sample(roles.listings(spark, d)).select("id", "latitude", "longitude"))


@register("g10_map_centre", roles=L, sql="""
SELECT round(avg(latitude), 4) AS center_lat, round(avg(longitude), 4) AS center_lon FROM listings
""")
def g10_map_centre(spark, d):
    return _r4all(G.map_centre(roles.listings(spark, d)))
