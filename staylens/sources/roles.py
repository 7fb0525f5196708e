"""Role views: the test tables standing in for listings, calendar, reviews, vectors and an external table.

Operators take column names as parameters and never know where a role came from. Each Spark view here has a
DuckDB twin (``ROLE_SQL``) written once, so every oracle query reuses the same definition.

listings  <- orders ⋈ customer ⋈ nation, left-joined to lineitem grouped by order (one row per order);
             bedrooms = lines // 2, reviews_per_month = lines / 12, instant_bookable from the order status
calendar  <- orders (long history) or events (one month)
reviews   <- documents (review id = listing id = doc_id, district = source)
vectors   <- embeddings
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One listing per order; lineitem supplies rating and size, customer supplies segment and coordinates."""
    o = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority", "o_orderstatus"
    )
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    # Aggregating lineitem by order leaves it hash-partitioned on the order key, so the join below reuses it.
    li = (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey")
        .agg(F.avg("l_quantity").alias("_q"), F.count(F.lit(1)).alias("_nl"))
    )
    j = (
        o.join(c, o.o_custkey == c.c_custkey, "left")
        .join(n, F.col("c_nationkey") == n.n_nationkey, "left")
        .join(li, o.o_orderkey == li.l_orderkey, "left")
    )
    return j.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("host_id"),
        F.col("o_totalprice").alias("price"),
        F.col("n_name").alias("neighbourhood_cleansed"),
        F.col("c_mktsegment").alias("room_type"),
        (F.lit(2.0) * F.col("_q")).alias("review_scores_rating"),
        F.col("_nl").alias("accommodates"),
        F.coalesce(F.col("_nl"), F.lit(0)).alias("number_of_reviews"),
        F.floor(F.col("_nl") / 2.0).cast("double").alias("bedrooms"),
        (F.col("_nl") / 12.0).alias("reviews_per_month"),
        F.dayofyear("o_orderdate").alias("availability_365"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("minimum_nights"),
        F.to_date("o_orderdate").alias("host_since"),
        F.when(F.col("o_orderstatus") == "F", "t").when(F.col("o_orderstatus") == "O", "f")
        .otherwise(F.col("o_orderstatus")).alias("instant_bookable"),
        (F.lit(35.5) + (F.col("c_acctbal") + 1000.0) / 11000.0 * 0.4).alias("latitude"),
        (F.lit(139.4) + ((F.col("o_custkey") * 7919) % 1000).cast("double") / 1000.0 * 0.5).alias("longitude"),
    )


def calendar_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily prices over several years (orders): listing_id, date, price."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("listing_id"),
        F.to_date("o_orderdate").alias("date"),
        F.col("o_totalprice").alias("price"),
    )


def calendar_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One month of per-user prices (events): listing_id, date, price."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("listing_id"),
        F.to_date("ts").alias("date"),
        F.col("value").alias("price"),
    )


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review text: id, listing_id, comments, neighbourhood, lang (the language is the truth for tagging)."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"),
        F.col("doc_id").alias("listing_id"),
        F.col("text").alias("comments"),
        F.col("source").alias("neighbourhood"),
        F.col("lang"),
    )


def reviews_dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews with a date: the listing's order date (documents carry none)."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("date"))
    r = reviews(spark, sf_dir)
    return r.join(o, r.listing_id == o.o_orderkey, "left").drop("o_orderkey")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored review vectors: id, embedding array<float>, label (metadata filter)."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def external(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An uploaded-style district table: one row per nation with region, supplier count and mean balance, under
    the column names a user file would carry (a dashed key, a 'ward' spelling for fuzzy matching)."""
    n = table(spark, sf_dir, "nation")
    r = table(spark, sf_dir, "region")
    s = (table(spark, sf_dir, "supplier").groupBy("s_nationkey")
         .agg(F.count(F.lit(1)).alias("suppliers"), F.avg("s_acctbal").alias("_bal")))
    j = n.join(r, n.n_regionkey == r.r_regionkey, "left").join(s, n.n_nationkey == s.s_nationkey, "left")
    return j.select(
        F.col("n_name").alias("Neighbourhood-Cleansed"),
        F.col("n_nationkey").alias("nation_code"),
        F.col("r_name").alias("region"),
        F.coalesce(F.col("suppliers"), F.lit(0)).alias("suppliers"),
        (F.floor(F.col("_bal") * 100 + 0.5) / 100).alias("supplier_balance"),
        F.concat(F.lower(F.translate("n_name", "_", "-")), F.lit(" ward")).alias("ward_name"),
    )


def districts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """District polygons by name (nation); the test tables carry no shapes, so the geometry is null."""
    return table(spark, sf_dir, "nation").select(F.col("n_name").alias("neighbourhood"),
                                                  F.lit(None).cast("string").alias("geometry"))


# --- DuckDB twins of the role views -------------------------------------------------------------------------------

ROLE_SQL = {
    "listings": """
listings AS (
  SELECT o.o_orderkey AS id, o.o_custkey AS host_id, o.o_totalprice AS price, n.n_name AS neighbourhood_cleansed,
         c.c_mktsegment AS room_type, 2.0::DOUBLE * li._q AS review_scores_rating, li._nl AS accommodates,
         coalesce(li._nl, 0) AS number_of_reviews, floor(li._nl / 2.0::DOUBLE)::DOUBLE AS bedrooms,
         li._nl / 12.0::DOUBLE AS reviews_per_month, CAST(dayofyear(o.o_orderdate) AS INTEGER) AS availability_365,
         CAST(substr(o.o_orderpriority, 1, 1) AS INTEGER) AS minimum_nights,
         CAST(o.o_orderdate AS DATE) AS host_since,
         CASE o.o_orderstatus WHEN 'F' THEN 't' WHEN 'O' THEN 'f' ELSE o.o_orderstatus END AS instant_bookable,
         35.5::DOUBLE + (c.c_acctbal + 1000.0::DOUBLE) / 11000.0::DOUBLE * 0.4::DOUBLE AS latitude,
         139.4::DOUBLE + CAST((o.o_custkey * 7919) % 1000 AS DOUBLE) / 1000.0::DOUBLE * 0.5::DOUBLE AS longitude
  FROM orders o
  LEFT JOIN customer c ON o.o_custkey = c.c_custkey
  LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
  LEFT JOIN (SELECT l_orderkey, avg(l_quantity) AS _q, count(*)::BIGINT AS _nl FROM lineitem GROUP BY l_orderkey) li
         ON o.o_orderkey = li.l_orderkey
)""",
    "calendar_long": """
calendar_long AS (
  SELECT o_orderkey AS listing_id, CAST(o_orderdate AS DATE) AS date, o_totalprice AS price FROM orders
)""",
    "calendar_short": """
calendar_short AS (
  SELECT user_id AS listing_id, CAST(ts AS DATE) AS date, value AS price FROM events
)""",
    "reviews": """
reviews AS (
  SELECT doc_id AS id, doc_id AS listing_id, text AS comments, source AS neighbourhood, lang FROM documents
)""",
    "reviews_dated": """
reviews_dated AS (
  SELECT doc_id AS id, doc_id AS listing_id, text AS comments, source AS neighbourhood, lang,
         CAST(o.o_orderdate AS DATE) AS date
  FROM documents d LEFT JOIN orders o ON d.doc_id = o.o_orderkey
)""",
    "vectors": """
vectors AS (SELECT vec_id AS id, embedding, label FROM embeddings)""",
    "external": """
external AS (
  SELECT n.n_name AS "Neighbourhood-Cleansed", n.n_nationkey AS nation_code, r.r_name AS region,
         coalesce(s.suppliers, 0)::BIGINT AS suppliers, floor(s._bal * 100 + 0.5) / 100 AS supplier_balance,
         lower(translate(n.n_name, '_', '-')) || ' ward' AS ward_name
  FROM nation n LEFT JOIN region r ON n.n_regionkey = r.r_regionkey
  LEFT JOIN (SELECT s_nationkey, count(*) AS suppliers, avg(s_acctbal) AS _bal FROM supplier GROUP BY 1) s
         ON n.n_nationkey = s.s_nationkey
)""",
}


def with_roles(sql: str, *roles: str) -> str:
    """Prefix ``sql`` (which may start with its own ``WITH``-free CTE list after a comma) with role CTEs."""
    ctes = ",\n".join(ROLE_SQL[r].strip() for r in roles)
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
