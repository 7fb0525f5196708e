"""File sources and sinks (S-1 .. S-16).

CSV is read with every column as text (no inference pass over the data) and the known columns are typed by name,
so a file with any number of extra columns works. Parquet is the working format: filters and projections reach
the scan. Sinks write directories (one file per task), never a single file through the driver.
"""

from __future__ import annotations

import datetime as dt
import logging
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from staylens.functions.semantics import checkpointed, hash_sample, parse_number

log = logging.getLogger(__name__)

# Typed columns of the raw tables (everything else stays text). Fixed names.
LISTING_TYPES = {
    "id": "long", "host_id": "long", "latitude": "double", "longitude": "double", "accommodates": "int",
    "number_of_reviews": "int", "availability_365": "int", "minimum_nights": "int", "bathrooms": "double",
    "bedrooms": "double", "beds": "double", "reviews_per_month": "double", "review_scores_rating": "double",
    "review_scores_accuracy": "double", "review_scores_cleanliness": "double", "review_scores_checkin": "double",
    "review_scores_communication": "double", "review_scores_location": "double", "review_scores_value": "double",
}
CALENDAR_TYPES = {"listing_id": "long", "minimum_nights": "int", "maximum_nights": "int"}
REVIEW_TYPES = {"listing_id": "long", "id": "long", "reviewer_id": "long"}

SAMPLE_ROWS = 1000

GEOJSON_SCHEMA = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("features", T.ArrayType(T.StructType([
        T.StructField("type", T.StringType()),
        T.StructField("properties", T.MapType(T.StringType(), T.StringType())),
        # Polygon and MultiPolygon nest coordinates to different depths: keep the geometry as JSON text.
        T.StructField("geometry", T.StringType()),
    ]))),
])


def _csv_reader(spark: SparkSession, multi_line: bool = False):
    # Doubled quotes are escapes. Only free text with line breaks needs multiLine, which reads a file in one task.
    return (spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"')
            .option("mode", "PERMISSIVE"))


def read_csv_typed(spark: SparkSession, path: str, types: Mapping[str, str], multi_line: bool = False) -> DataFrame:
    """Read a CSV with header as text and type the named columns (bad numbers become null, as pandas coerces)."""
    df = _csv_reader(spark, multi_line).csv(path)
    for c, t in types.items():
        if c in df.columns:
            v = parse_number(c)
            df = df.withColumn(c, v.cast(t) if t != "double" else v)
    return df


def load_listings(spark: SparkSession, path: str, sample: int | None = None) -> DataFrame:
    """S-1: listings CSV; optional exact-n seeded sample."""
    df = read_csv_typed(spark, path, LISTING_TYPES, multi_line=True)
    return hash_sample(df, sample, "id") if sample else df


def load_calendar(spark: SparkSession, path: str, sample: int | None = None) -> DataFrame:
    """S-2: calendar CSV."""
    df = read_csv_typed(spark, path, CALENDAR_TYPES)
    if sample:
        df = hash_sample(df.withColumn("_sid", F.concat_ws("|", "listing_id", "date")), sample, "_sid").drop("_sid")
    return df


def load_reviews(spark: SparkSession, path: str, sample: int | None = None) -> DataFrame:
    """S-3: reviews CSV (free text, multi-line)."""
    df = read_csv_typed(spark, path, REVIEW_TYPES, multi_line=True)
    return hash_sample(df, sample, "id") if sample else df


def recent_reviews(reviews: DataFrame, as_of: dt.date | str, years: int = 2, date="date") -> DataFrame:
    """S-4: reviews dated on or after ``as_of`` minus ``years`` (pushed into the scan for Parquet)."""
    cutoff = F.add_months(F.lit(str(as_of)).cast("date"), -12 * years)
    return reviews.where(F.to_date(F.col(date)) >= cutoff)


def load_neighbourhoods(spark: SparkSession, path: str) -> DataFrame:
    """S-5: district list CSV."""
    return _csv_reader(spark).csv(path)


def load_geojson(spark: SparkSession, path: str, name_key: str = "neighbourhood") -> DataFrame:
    """S-6: one row per GeoJSON feature: district name, group, geometry JSON."""
    raw = spark.read.schema(GEOJSON_SCHEMA).option("multiLine", True).json(path)
    f = raw.select(F.explode("features").alias("f"))
    return f.select(F.col("f.properties")[name_key].alias(name_key),
                    F.col("f.properties")["neighbourhood_group"].alias("neighbourhood_group"),
                    F.col("f.geometry").alias("geometry"))


def load_all(spark: SparkSession, raw_dir: str, as_of: dt.date | str | None = None, recent_years: int | None = 2,
             samples: Mapping[str, int] | None = None) -> dict[str, DataFrame]:
    """S-7: every raw table as a lazy DataFrame; reviews cut to the last ``recent_years`` when ``as_of`` is set."""
    samples = samples or {}
    data = {
        "listings": load_listings(spark, f"{raw_dir}/listings.csv", samples.get("listings")),
        "calendar": load_calendar(spark, f"{raw_dir}/calendar.csv", samples.get("calendar")),
    }
    rev = load_reviews(spark, f"{raw_dir}/reviews.csv")
    if as_of is not None and recent_years:
        rev = recent_reviews(rev, as_of, recent_years)
    if samples.get("reviews"):
        rev = hash_sample(rev, samples["reviews"], "id")
    data["reviews"] = rev
    data["neighbourhoods"] = load_neighbourhoods(spark, f"{raw_dir}/neighbourhoods.csv")
    data["neighbourhoods_geojson"] = load_geojson(spark, f"{raw_dir}/neighbourhoods.geojson")
    return data


def dataset_summary(tables: Mapping[str, DataFrame]) -> DataFrame:
    """S-8: (table_name, rows, columns) for every table; each count is its own aggregate, unioned."""
    frames = [df.agg(F.count(F.lit(1)).alias("rows")).select(
        F.lit(name).alias("table_name"), "rows", F.lit(len(df.columns)).cast("long").alias("columns"))
        for name, df in tables.items()]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def systematic_sample(df: DataFrame, every: int, order_col: str, id_col: str | None = None,
                      tasks: int | None = None) -> DataFrame:
    """S-10: every ``every``-th row in the order of ``order_col`` (rows 1, 1+every, …), ties by ``id_col`` if given, then
    by the other columns, so the sample doesn't depend on how rows are partitioned.

    No global window: rows are dealt out in ranges of that order, which splits a repeated key too, and stored; rows are
    counted per range, and each row's rank is its place in its range plus the rows of the ranges before."""
    types = dict(df.dtypes)
    rest = [c for c in df.columns if c not in (order_col, id_col) and not types[c].startswith("map")]
    order = [order_col, *([id_col] if id_col else []), *rest]
    dealt = df.repartitionByRange(tasks, *order) if tasks else df.repartitionByRange(*order)
    # A monotonic id counts up within a partition in its stored order; its high bits are the partition.
    held = checkpointed(dealt.sortWithinPartitions(*order)).withColumn("_id", F.monotonically_increasing_id())
    part, place = F.shiftright("_id", 33), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = held.groupBy(part.alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    # One row per range: a single ordered window over them is bounded by the number of tasks.
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    ranked = held.withColumn("_p", part).join(F.broadcast(offsets), "_p")
    return ranked.where((F.col("_off") + place) % every == 0).select(*df.columns)


def write_processed(data: Mapping[str, DataFrame], out_dir: str, sample_rows: int = SAMPLE_ROWS) -> dict[str, str]:
    """S-11: Parquet sink of processed tables (calendar partitioned by year/month) plus an n-row listings sample."""
    paths = {}
    for name, df in data.items():
        if name not in ("listings", "calendar", "reviews"):
            continue
        path = f"{out_dir}/{name}_processed.parquet"
        w = df.write.mode("overwrite")
        if name == "calendar" and {"year", "month"} <= set(df.columns):
            # Months are brought together first, or every task would write a file to every month; AQE splits a large one.
            w = df.hint("rebalance", "year", "month").write.mode("overwrite").partitionBy("year", "month")
        w.parquet(path)
        paths[name] = path
    if "listings" in data:
        path = f"{out_dir}/listings_sample_{sample_rows}.parquet"
        # The sample is drawn from the table just written, so the listings plan runs once.
        written = data["listings"].sparkSession.read.parquet(paths["listings"])
        hash_sample(written, sample_rows, "id").write.mode("overwrite").parquet(path)
        paths["listings_sample"] = path
    return paths


def read_columns(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """S-12: Parquet scan of selected columns (pruned in the scan)."""
    return spark.read.parquet(path).select(*columns)


def write_csv(df: DataFrame, path: str) -> str:
    """S-13: CSV sink with header (a directory of part files)."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    return path


def read_external_csv(spark: SparkSession, path: str) -> DataFrame:
    """S-14: an uploaded CSV with inferred column types (one extra pass over the file)."""
    return _csv_reader(spark, multi_line=True).option("inferSchema", True).csv(path)
