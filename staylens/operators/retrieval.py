"""Review retrieval: corpus, vectors, upserts and exact top-k search (V-1 .. V-11).

Search is exact. One query over a plain table: a scan with cosine by native array expressions and the query vector as a
literal, then a bounded top-k (``TakeOrderedAndProject``). Many queries, or a table that is searched again and again: an
inverted file of cells whose blocks are skipped by the triangle inequality (``vector_index``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from staylens.functions.semantics import hash_sample, unicode_strip
from staylens.operators import vector_index
from staylens.operators.vector_index import VectorIndex

# Fixed values of the retrieval setup.
MIN_REVIEW_CHARS = 30
EMBED_DIMS = 256
DEFAULT_K = 10
NO_RESULTS = "No relevant reviews found for that query and filter."
QUERY_BLOCK = 1_000  # queries of a pack, and stored rows of a block, in the batch search
STORE_BLOCK = 1_000


def build_corpus(reviews: DataFrame, listings: DataFrame, sample: int | None = None,
                 min_chars: int = MIN_REVIEW_CHARS, seed: int = 42) -> DataFrame:
    """V-1 / V-2: reviews of known listings in a known district whose stripped text is longer than ``min_chars``,
    with a stable document id ``rev_<review id>``; on request an exact-n seeded sample of ``sample`` of them."""
    li = listings.select(F.col("id").alias("_lid"), "neighbourhood_cleansed")
    j = reviews.join(li, reviews.listing_id == li._lid, "inner").drop("_lid")
    j = j.where(F.col("comments").isNotNull() & (F.length(unicode_strip("comments")) > min_chars)
                & F.col("neighbourhood_cleansed").isNotNull())
    if sample:
        j = hash_sample(j, sample, "id", seed)
    return j.select(F.concat(F.lit("rev_"), F.col("id").cast("string")).alias("doc_id"), "id",
                    F.col("listing_id").cast("string").alias("listing_id"),
                    F.col("neighbourhood_cleansed").alias("neighbourhood"), F.col("comments").alias("document"))


def hashing_embeddings(corpus: DataFrame, text_col: str = "document", dims: int = EMBED_DIMS):
    """V-3 (re-aimed): term-hashing + IDF + L2 vectors fitted in Spark ML; returns (model, vectors frame with an
    ``embedding`` array<double>). Use the model to embed questions the same way."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer
    from pyspark.ml.functions import vector_to_array

    pipe = Pipeline(stages=[
        RegexTokenizer(inputCol=text_col, outputCol="_tok", pattern=r"\W+", toLowercase=True),
        HashingTF(inputCol="_tok", outputCol="_tf", numFeatures=dims),
        IDF(inputCol="_tf", outputCol="_idf"),
        Normalizer(inputCol="_idf", outputCol="_vec", p=2.0),
    ])
    model = pipe.fit(corpus)
    out = model.transform(corpus).withColumn("embedding", vector_to_array("_vec")).drop("_tok", "_tf", "_idf", "_vec")
    return model, out


def _norm(c):
    return F.sqrt(F.aggregate(c, F.lit(0.0), lambda acc, x: acc + x * x))


def unit_vectors(df: DataFrame, col: str = "embedding", dims: int | None = EMBED_DIMS) -> DataFrame:
    """V-4: first ``dims`` components scaled to unit length (double); a zero vector becomes null."""
    v = F.transform(F.col(col), lambda x: x.cast("double"))
    if dims:
        v = F.slice(v, 1, dims)
    n = _norm(v)
    return df.withColumn(col, F.when(n > 0, F.transform(v, lambda x: x / n)))


def cosine(a, b) -> F.Column:
    """Cosine similarity of two double arrays (null when either norm is zero)."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)
    den = _norm(a) * _norm(b)
    return F.when(den > 0, dot / den)


def search(store: DataFrame, query: Sequence[float] | DataFrame, k: int = DEFAULT_K, where: F.Column | None = None,
           col: str = "embedding", id_col: str = "id") -> DataFrame:
    """V-7 / V-8 / V-9: the k stored rows most similar to ``query`` (after an optional metadata filter), with
    ``similarity`` (exact cosine), ``similarity_3`` (3 decimals) and ``rank``. Ties go to the smaller id.

    ``query`` is a vector, or a one-row frame with a ``query_vector`` column computed by Spark (it is broadcast,
    never collected)."""
    s = store if where is None else store.where(where)
    if isinstance(query, DataFrame):
        n = F.count(F.lit(1))
        one = query.agg(F.when(n > 1, F.raise_error(F.lit("search takes one query; use batch_search"))).otherwise(
            F.first(F.transform("query_vector", lambda x: x.cast("double")))).alias("_q"))
        s = s.crossJoin(F.broadcast(one))
        q = F.col("_q")
    else:
        q = F.array(*[F.lit(float(x)) for x in query])
    v = F.transform(F.col(col), lambda x: x.cast("double"))
    # The vector itself is dropped before the top-k: each partition forwards k narrow rows, not k vectors.
    scored = s.withColumn("similarity", cosine(v, q)).drop(col)
    if isinstance(query, DataFrame):
        scored = scored.drop("_q")
    top = scored.orderBy(F.col("similarity").desc_nulls_last(), F.col(id_col)).limit(k)
    w = Window.partitionBy(F.lit(0)).orderBy(F.col("similarity").desc_nulls_last(), F.col(id_col))
    # ``top`` holds at most k rows, so the single-partition ranking below is bounded.
    return top.withColumn("rank", F.row_number().over(w)).withColumn("similarity_3", F.bround("similarity", 3))


def context(results: DataFrame, text_col: str, district_col: str) -> DataFrame:
    """V-10: the grounding text '[district] text' joined by blank lines in rank order, or the no-result message.
    Runs on the ≤ k result rows."""
    item = F.concat(F.lit("["), F.coalesce(F.col(district_col), F.lit("Unknown")), F.lit("] "), F.col(text_col))
    agg = results.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", item.alias("t")))),
                                               lambda s: s["t"]), "\n\n").alias("_c"), F.count(F.lit(1)).alias("_n"))
    return agg.select(F.when(F.col("_n") > 0, F.col("_c")).otherwise(F.lit(NO_RESULTS)).alias("context"),
                      F.col("_n").alias("sources"))


def batch_search(store: DataFrame | VectorIndex, queries: DataFrame, k: int = DEFAULT_K, col: str = "embedding", id_col: str = "id",
                 qid_col: str = "query_id", qvec_col: str = "query_vector") -> DataFrame:
    """V-11: exact top-k per query for any number of queries, through the cells of a vector index: blocks that can't
    hold one of a query's k nearest are not read for it. ``store`` is an index that was built before, or a frame, which is indexed
    into the shared checkpoint folder first. No stored vector visits the driver."""
    if isinstance(store, DataFrame):
        store = vector_index.build_index(store, vector_index.scratch_path(store.sparkSession), None, col, id_col, STORE_BLOCK)
    return vector_index.search_index(store, queries, k, id_col, qid_col, qvec_col, QUERY_BLOCK)


def upsert(store: DataFrame, new: DataFrame, id_col: str = "id", order_col: str | None = None) -> DataFrame:
    """V-5: rows of ``new`` replace stored rows with the same id; others are added. Of several new rows with one id
    the one with the greatest ``order_col`` stays (equal or no order: the greatest row, so re-runs agree)."""
    row = F.struct(*[F.col(c) for c in new.columns])
    order = F.struct(F.col(order_col), row) if order_col else row
    last = new.groupBy(F.col(id_col).alias("_id")).agg(F.max_by(row, order).alias("_r")).select(
        *[F.col(f"_r.{c}").alias(c) for c in new.columns])
    kept = store.join(new.select(id_col), id_col, "left_anti")
    return kept.unionByName(last)


def store_exists(spark, path: str) -> bool:
    """V-6: True when a complete store can be read at ``path`` (a failed write leaves no readable table)."""
    try:
        return bool(spark.read.parquet(path).columns)
    except AnalysisException:
        return False


def store_count(store: DataFrame, id_col: str = "id") -> DataFrame:
    """V-6: one row: stored vectors and distinct ids."""
    return store.agg(F.count(F.lit(1)).alias("vectors"), F.count_distinct(id_col).alias("ids"))


def write_version(df: DataFrame, base_path: str, version: int) -> str:
    """V-5 / V-6: write the store as a new Parquet version (a full rebuild is version 0 with overwrite)."""
    path = f"{base_path}/version={version}"
    df.write.mode("overwrite").parquet(path)
    return path


def label_centroids(store: DataFrame, key: str = "label", col: str = "embedding") -> DataFrame:
    """Mean vector per key (component-wise), e.g. to use each label's centre as a query."""
    ex = store.select(key, F.posexplode(F.col(col)).alias("_pos", "_x"))
    comp = ex.groupBy(key, "_pos").agg(F.avg(F.col("_x").cast("double")).alias("_m"))
    return comp.groupBy(key).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_pos", "_m"))), lambda s: s["_m"]).alias(col))
