"""Map tables (G-7 .. G-10): district enrichment of polygons, grid and kernel density, roll-up, marker clusters, centre.

Point layers are re-aimed from "every point to the browser" to grid cells counted in Spark: a cell count is a
partial-aggregated group-by whose output grows with the covered area, not with the number of listings.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staylens.functions.semantics import checkpointed, hash_sample, nan_to_null

# Cell sizes in degrees per zoom level (fixed values, a parameter of ``grid_rollup``).
ZOOM_CELLS = (0.2, 0.1, 0.05, 0.02, 0.01)
MARKER_SAMPLE = 2000
KERNEL_RADIUS = 3


def _coords(df: DataFrame, lat: str, lon: str) -> DataFrame:
    return df.select(nan_to_null(F.col(lat)).alias("_lat"), nan_to_null(F.col(lon)).alias("_lon")).where(
        F.col("_lat").isNotNull() & F.col("_lon").isNotNull())


def map_centre(df: DataFrame, lat="latitude", lon="longitude") -> DataFrame:
    """G-10: mean latitude and longitude (each over its own non-null values)."""
    return df.agg(F.avg(lat).alias("center_lat"), F.avg(lon).alias("center_lon"))


def grid_density(df: DataFrame, cell: float = 0.01, lat="latitude", lon="longitude") -> DataFrame:
    """G-8: listings per square cell of ``cell`` degrees, with the cell's lower-left corner."""
    c = _coords(df, lat, lon)
    gi, gj = F.floor(F.col("_lat") / cell), F.floor(F.col("_lon") / cell)
    return c.groupBy(gi.alias("lat_cell"), gj.alias("lon_cell")).agg(F.count(F.lit(1)).alias("count")).select(
        "lat_cell", "lon_cell", (F.col("lat_cell") * cell).alias("lat0"), (F.col("lon_cell") * cell).alias("lon0"),
        "count")


def grid_rollup(df: DataFrame, cells: Sequence[float] = ZOOM_CELLS, lat="latitude", lon="longitude") -> DataFrame:
    """G-9: marker clusters that merge on zoom out: for every zoom level, the count and mean position of the
    points in each cell. One scan; each point is routed to one cell per level, aggregated map-side."""
    c = _coords(df, lat, lon)
    levels = F.array(*[F.struct(F.lit(z).alias("zoom"), F.lit(float(s)).alias("size")) for z, s in enumerate(cells)])
    e = c.select("_lat", "_lon", F.explode(levels).alias("_lv"))
    size = F.col("_lv.size")
    return e.groupBy(F.col("_lv.zoom").alias("zoom"), F.floor(F.col("_lat") / size).alias("lat_cell"),
                     F.floor(F.col("_lon") / size).alias("lon_cell")).agg(
        F.count(F.lit(1)).alias("count"), F.avg("_lat").alias("lat"), F.avg("_lon").alias("lon"))


def kernel_weights(radius: int = KERNEL_RADIUS, sigma: float | None = None) -> list[tuple[int, int, float]]:
    """(rows, columns, weight) of a Gaussian cut off at ``radius`` cells, its weights adding up to one."""
    sigma = sigma or radius / 2
    raw = [(i, j, math.exp(-(i * i + j * j) / (2 * sigma * sigma)))
           for i in range(-radius, radius + 1) for j in range(-radius, radius + 1) if i * i + j * j <= radius * radius]
    total = sum(w for _, _, w in raw)
    return [(i, j, w / total) for i, j, w in raw]


def kernel_density(df: DataFrame, cell: float = 0.01, radius: int = KERNEL_RADIUS, sigma: float | None = None,
                   lat="latitude", lon="longitude") -> DataFrame:
    """G-8: a smooth heat map: every cell's listings are spread over the cells around it by a kernel, so the mass stays
    the number of listings. Points are counted per cell first: what is exploded grows with the area covered, not with the
    listings, and neighbours are added up map-side."""
    spread = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(w).alias("w")) for i, j, w in kernel_weights(radius, sigma)])
    cells = grid_density(df, cell, lat, lon).select("lat_cell", "lon_cell", "count", F.explode(spread).alias("k"))
    return cells.groupBy((F.col("lat_cell") + F.col("k.i")).alias("lat_cell"), (F.col("lon_cell") + F.col("k.j")).alias("lon_cell")).agg(
        F.sum(F.col("count") * F.col("k.w")).alias("density"))


def _greedy(points: DataFrame, radius: float) -> DataFrame:
    """``key, root``: greedy clusters of points (``key, n, lat, lon``): in order of falling count (ties by key) a point that no
    earlier centre lies within ``radius`` of becomes a centre, and every other point joins its nearest centre (ties by key).

    Points meet the points of their own tile and the eight around it. Whether a point is a centre is settled from its earlier
    neighbours, all points at once, round by round: one with a centre among them is not, one whose earlier neighbours are all
    settled as others is. The result is that of going through all points in order."""
    tiled = points.select("*", F.floor(F.col("lat") / radius).alias("ti"), F.floor(F.col("lon") / radius).alias("tj"))
    halo = F.explode(F.array(*[F.struct((F.col("ti") + i).alias("ti"), (F.col("tj") + j).alias("tj")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    other = tiled.select(F.col("key").alias("other"), F.col("n").alias("n2"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"), "ti", "tj")
    d2 = (F.col("lat") - F.col("lat2")) ** 2 + (F.col("lon") - F.col("lon2")) ** 2
    near = points.select("*", F.floor(F.col("lat") / radius).alias("ti"), F.floor(F.col("lon") / radius).alias("tj")).withColumn(
        "h", halo).drop("ti", "tj").select("key", "n", "lat", "lon", "h.*").join(other, ["ti", "tj"]).where(
        (F.col("key") != F.col("other")) & (d2 <= radius * radius))
    earlier = (F.col("n2") > F.col("n")) | ((F.col("n2") == F.col("n")) & (F.col("other") < F.col("key")))
    edges = checkpointed(near.select("key", "other", d2.alias("d2"), earlier.alias("earlier")))
    before = edges.where("earlier").select("key", "other")
    state = checkpointed(points.select("key").join(before.select("key").distinct().withColumn("has", F.lit(True)), "key", "left").select(
        "key", F.when(F.col("has").isNull(), F.lit(True)).alias("centre")))
    while state.where("centre is null").limit(1).count():
        seen = before.join(state.select(F.col("key").alias("other"), F.col("centre").alias("of")), "other").groupBy("key").agg(
            F.max(F.coalesce("of", F.lit(False))).alias("some"), F.max(F.col("of").isNull()).alias("open"))
        state = checkpointed(state.join(seen, "key", "left").select("key", F.coalesce(
            "centre", F.when(F.col("some"), F.lit(False)).when(~F.col("open"), F.lit(True))).alias("centre")))
    centres = state.where("centre").select(F.col("key").alias("other"))
    nearest = edges.join(centres, "other").groupBy("key").agg(F.min(F.struct("d2", "other")).alias("b"))
    return state.join(nearest, "key", "left").select("key", F.when(F.col("centre"), F.col("key")).otherwise(F.col("b.other")).alias("root"))


def marker_clusters(df: DataFrame, radii: Sequence[float] = ZOOM_CELLS, lat="latitude", lon="longitude", finer: int = 4) -> DataFrame:
    """G-9: marker clusters by distance: ``zoom, count, lat, lon`` for each radius (degrees), widest first as zoom 0.

    The narrowest radius groups the listings, the next wider one groups those clusters, and so on, so clusters only merge on
    zooming out. What is grouped is first put together in cells of a ``finer``-th of the radius: a tile then holds few points
    (at most ``finer`` squared, and a row and column more), however many listings lie in one spot."""
    points = _coords(df, lat, lon).select(F.lit(1).cast("long").alias("n"), F.col("_lat").alias("lat"), F.col("_lon").alias("lon"))
    levels = None
    for zoom, radius in sorted(enumerate(radii), key=lambda z: z[1]):
        size = radius / finer
        weigh = lambda c: (F.sum(F.col(c) * F.col("n")) / F.sum("n")).alias(c)
        cells = checkpointed(points.groupBy(F.struct(F.floor(F.col("lat") / size).alias("i"), F.floor(F.col("lon") / size).alias("j")).alias("key")).agg(
            F.sum("n").alias("_n"), weigh("lat"), weigh("lon")).withColumnRenamed("_n", "n"))
        members = cells.join(_greedy(cells, radius), "key")
        points = checkpointed(members.groupBy("root").agg(F.sum("n").alias("_n"), weigh("lat"), weigh("lon")).select(
            F.col("_n").alias("n"), "lat", "lon"))
        level = points.select(F.lit(zoom).alias("zoom"), F.col("n").alias("count"), "lat", "lon")
        levels = level if levels is None else levels.unionByName(level)
    return levels


def marker_sample(df: DataFrame, n: int = MARKER_SAMPLE, id_col="id", lat="latitude", lon="longitude",
                  seed: int = 42) -> DataFrame:
    """G-9 detail layer: an exact-n seeded sample first, then rows without coordinates dropped (that order)."""
    s = hash_sample(df, n, id_col, seed)
    return s.where(nan_to_null(F.col(lat)).isNotNull() & nan_to_null(F.col(lon)).isNotNull())


def district_map(polygons: DataFrame, listings: DataFrame, name="neighbourhood", district="neighbourhood_cleansed",
                 price="price", id_col="id", geometry: str | None = "geometry") -> DataFrame:
    """G-7 / J-f: every polygon with its district's mean price and listing count ("No data" and 0 when the
    district has no listings); ``feature`` is the GeoJSON feature text."""
    stats = listings.where(F.col(district).isNotNull()).groupBy(district).agg(
        F.avg(price).alias("avg_price"), F.count(id_col).alias("listings"))
    j = polygons.join(stats, polygons[name] == stats[district], "left")
    label = F.when(F.col("avg_price").isNull(), F.lit("No data")).otherwise(
        F.concat(F.lit("¥"), F.format_number(F.col("avg_price"), 0)))
    geom = F.col(geometry) if geometry and geometry in polygons.columns else F.lit(None).cast("string")
    out = j.select(polygons[name].alias("name"), "avg_price", label.alias("price_label"),
                   F.coalesce(F.col("listings"), F.lit(0)).cast("long").alias("listings"), geom.alias("_geom"))
    # The geometry is already JSON text: splice it in rather than re-parse it.
    props = F.to_json(F.struct(F.col("name").alias(name), F.col("price_label").alias("avg_price_fmt"),
                               F.format_number(F.col("listings"), 0).alias("listing_count")))
    feature = F.concat(F.lit('{"type":"Feature","properties":'), props, F.lit(',"geometry":'),
                       F.coalesce(F.col("_geom"), F.lit("null")), F.lit("}"))
    return out.select("name", "avg_price", "price_label", "listings", feature.alias("feature"))
