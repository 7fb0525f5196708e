"""Projections and filters (P-1 .. P-7). All are narrow transformations that Catalyst pushes into the scan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from staylens.functions.semantics import quantiles

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def market_filter(listings: DataFrame, price_range: tuple[float, float] | None = None,
                  room_types: Sequence[str] | None = None, districts: Sequence[str] | None = None,
                  price="price", room_type="room_type", district="neighbourhood_cleansed") -> DataFrame:
    """P-1: price between the bounds (inclusive; null price excluded), room type in the set, optional districts."""
    out = listings
    if price_range is not None:
        out = out.where(F.col(price).between(float(price_range[0]), float(price_range[1])))
    if room_types is not None:
        out = out.where(F.col(room_type).isin(list(room_types)))
    if districts:
        out = out.where(F.col(district).isin(list(districts)))
    return out


def price_bounds(listings: DataFrame, price="price", upper_q=0.98, hard_cap=200_000, **qkw) -> DataFrame:
    """P-2: one row (price_floor, price_cap): int(min price) and min(int(q98), hard cap)."""
    q = quantiles(listings, price, [upper_q], names=["_q"], **qkw)
    m = listings.agg(F.min(price).alias("_min"))
    return m.crossJoin(q).select(
        F.col("_min").cast("long").alias("price_floor"),
        F.least(F.col("_q").cast("long"), F.lit(hard_cap).cast("long")).alias("price_cap"),
    )


def filter_by_bounds(listings: DataFrame, bounds: DataFrame, price="price") -> DataFrame:
    """P-1 with the P-2 bounds, joined as a one-row broadcast instead of collected to the driver."""
    b = F.broadcast(bounds)
    return listings.crossJoin(b).where(F.col(price).between(F.col("price_floor"), F.col("price_cap"))).drop(
        "price_floor", "price_cap")


def typical_range(listings: DataFrame, price="price", below=100_000) -> DataFrame:
    """P-3: rows with price below a threshold (the 'typical range' view)."""
    return listings.where(F.col(price) < below)


def first_rows(df: DataFrame, columns: Sequence[str], n: int = 100, order_by: str = "id") -> DataFrame:
    """P-4: chosen columns, first n rows by a key (a top-n, not a sort of the table)."""
    cols = list(dict.fromkeys([*columns]))
    return df.select(*cols, *([] if order_by in cols else [order_by])).orderBy(order_by).limit(n).select(*cols)


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """P-5: sorted distinct non-null values (picker options)."""
    return df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column)


def numeric_columns(df: DataFrame) -> list[str]:
    """P-6: numeric columns, decided from the schema at plan time."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC_TYPES)]


def truncate_text(df: DataFrame, column: str, length: int = 260, name: str | None = None) -> DataFrame:
    """P-7: card text cut to ``length`` characters (code points)."""
    return df.withColumn(name or column, F.substring(F.col(column), 1, length))
