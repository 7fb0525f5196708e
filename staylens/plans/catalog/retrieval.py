"""Retrieval queries (V-1 .. V-11) over the reviews corpus and the stored vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from staylens.functions.semantics import r4
from staylens.operators import retrieval as V
from staylens.operators import vector_index
from staylens.operators.versioned_store import VersionedStore
from staylens.plans.registry import register
from staylens.sources import roles

# DuckDB: component-wise mean vector of a set of rows (the query vectors of the checks).
_CENTROID_ALL = """
comp AS (SELECT pos, avg(x::DOUBLE) AS m FROM (
           SELECT generate_subscripts(embedding, 1) AS pos, unnest(embedding) AS x FROM vectors) GROUP BY pos),
q AS (SELECT list(m ORDER BY pos) AS qv FROM comp)"""

_CENTROID_LABEL = """
compl AS (SELECT label, pos, avg(x::DOUBLE) AS m FROM (
            SELECT label, generate_subscripts(embedding, 1) AS pos, unnest(embedding) AS x FROM vectors)
          GROUP BY label, pos),
ql AS (SELECT label AS query_id, list(m ORDER BY pos) AS qv FROM compl GROUP BY label)"""


def _centroid_all(store):
    return V.label_centroids(store.withColumn("_all", F.lit(0)), "_all").select(
        F.col("embedding").alias("query_vector"))


@register("v1_review_corpus", roles=("reviews", "listings"), sql="""
SELECT 'rev_' || CAST(r.id AS VARCHAR) AS doc_id, r.id, CAST(r.listing_id AS VARCHAR) AS listing_id,
       l.neighbourhood_cleansed AS neighbourhood, r.comments AS document
FROM reviews r JOIN listings l ON r.listing_id = l.id
WHERE r.comments IS NOT NULL
  AND length(regexp_replace(r.comments, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g')) > 30
  AND l.neighbourhood_cleansed IS NOT NULL
""")
def v1_review_corpus(spark, d):
    return V.build_corpus(roles.reviews(spark, d), roles.listings(spark, d))


@register("v3_hashing_embeddings", roles=("reviews", "listings"), sql="""
SELECT 'rev_' || CAST(r.id AS VARCHAR) AS doc_id, 256 AS dims, 1.0::DOUBLE AS norm2
FROM reviews r JOIN listings l ON r.listing_id = l.id
WHERE r.comments IS NOT NULL
  AND length(regexp_replace(r.comments, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g')) > 30
  AND l.neighbourhood_cleansed IS NOT NULL
""")
def v3_hashing_embeddings(spark, d):
    """Term-hashing + IDF vectors of the whole corpus: ids, dimensions and length one."""
    _, vecs = V.hashing_embeddings(V.build_corpus(roles.reviews(spark, d), roles.listings(spark, d)))
    return vecs.select("doc_id", F.size("embedding").alias("dims"),
                       r4(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)).alias("norm2"))


@register("v4_unit_vectors", roles=("vectors",), sql="""
WITH n AS (SELECT id, embedding, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS nrm
           FROM vectors)
SELECT id, CAST(len(embedding) AS INTEGER) AS dims,
       round(CASE WHEN nrm > 0 THEN embedding[1]::DOUBLE / nrm END, 4) AS first,
       round(CASE WHEN nrm > 0 THEN list_sum(list_transform(embedding, lambda x: x::DOUBLE / nrm)) END, 4) AS total
FROM n
""")
def v4_unit_vectors(spark, d):
    u = V.unit_vectors(roles.vectors(spark, d), dims=V.EMBED_DIMS)
    return u.select("id", F.size("embedding").alias("dims"), r4(F.col("embedding")[0]).alias("first"),
                    r4(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x)).alias("total"))


@register("v4_cut_vectors", roles=("vectors",), sql="""
WITH c AS (SELECT id, list_slice(embedding, 1, 32) AS e FROM vectors),
n AS (SELECT id, e, sqrt(list_sum(list_transform(e, lambda x: x::DOUBLE * x::DOUBLE))) AS nrm FROM c)
SELECT id, CAST(len(e) AS INTEGER) AS dims, round(CASE WHEN nrm > 0 THEN e[1]::DOUBLE / nrm END, 4) AS first,
       round(CASE WHEN nrm > 0 THEN list_sum(list_transform(e, lambda x: x::DOUBLE / nrm)) END, 4) AS total FROM n
""")
def v4_cut_vectors(spark, d):
    """V-4 where the cut takes effect: 32 of 64 components."""
    u = V.unit_vectors(roles.vectors(spark, d), dims=32)
    return u.select("id", F.size("embedding").alias("dims"), r4(F.col("embedding")[0]).alias("first"),
                    r4(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x)).alias("total"))


@register("v9_similarity_3", roles=("vectors",), sql=f"""
WITH {_CENTROID_ALL.strip()},
s AS (SELECT v.id, list_cosine_similarity(list_transform(v.embedding, lambda x: x::DOUBLE), q.qv) AS sim FROM vectors v, q)
SELECT id, round_even(sim, 3) AS similarity_3 FROM s ORDER BY sim DESC NULLS LAST, id LIMIT 25
""")
def v9_similarity_3(spark, d):
    store = roles.vectors(spark, d)
    return V.search(store, _centroid_all(store), 25).select("id", "similarity_3")


_UPSERT_SQL = f"""
WITH {_CENTROID_LABEL.strip()},
upd AS (SELECT min(v.id) AS id, v.label, any_value(ql.qv) AS embedding FROM vectors v JOIN ql ON v.label = ql.query_id
        GROUP BY v.label),
st AS (SELECT id, label, list_transform(embedding, lambda x: x::DOUBLE) AS embedding FROM vectors
       WHERE id NOT IN (SELECT id FROM upd)
       UNION ALL SELECT id, label, embedding FROM upd)
SELECT id, label, CAST(len(embedding) AS INTEGER) AS dims, round(list_sum(embedding), 4) AS total FROM st
"""


@register("v5_upsert_index", roles=("vectors",), sql=_UPSERT_SQL)
def v5_upsert_index(spark, d):
    store = roles.vectors(spark, d).withColumn("embedding", F.transform("embedding", lambda x: x.cast("double")))
    cent = V.label_centroids(store)
    first_ids = store.groupBy("label").agg(F.min("id").alias("id"))
    new = first_ids.join(cent, "label").select("id", "label", "embedding")
    out = V.upsert(store, new)
    return out.select("id", "label", F.size("embedding").alias("dims"),
                      r4(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x)).alias("total"))


@register("v5_versioned_store", roles=("vectors",), sql=_UPSERT_SQL)
def v5_versioned_store(spark, d):
    """V-5 by versions: the store is written once, the upsert and a deletion of ids that it puts back write only their own rows."""
    store = roles.vectors(spark, d).withColumn("embedding", F.transform("embedding", lambda x: x.cast("double")))
    new = store.groupBy("label").agg(F.min("id").alias("id")).join(V.label_centroids(store), "label").select("id", "label", "embedding")
    kept = VersionedStore(spark, vector_index.scratch_path(spark))
    kept.upsert(store.select("id", "label", "embedding"))
    kept.delete(new.select("id"))
    kept.upsert(new)
    return kept.read().select("id", "label", F.size("embedding").alias("dims"),
                              r4(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x)).alias("total"))


_TOPK_SQL = """
WITH {cent},
s AS (SELECT v.id, v.label, list_cosine_similarity(list_transform(v.embedding, lambda x: x::DOUBLE), q.qv) AS sim
      FROM vectors v, q {where})
SELECT id, label, round(sim, 4) AS similarity, row_number() OVER (ORDER BY sim DESC NULLS LAST, id)::INTEGER AS rank
FROM s ORDER BY sim DESC NULLS LAST, id LIMIT 10
"""


@register("v7_top_k_search", roles=("vectors",), sql=_TOPK_SQL.format(cent=_CENTROID_ALL.strip(), where=""))
def v7_top_k_search(spark, d):
    store = roles.vectors(spark, d)
    t = V.search(store, _centroid_all(store), 10)
    return t.select("id", "label", r4("similarity").alias("similarity"), "rank")


@register("v7_indexed_search", roles=("vectors",), sql=_TOPK_SQL.format(cent=_CENTROID_ALL.strip(), where=""))
def v7_indexed_search(spark, d):
    """V-7 through the index of cells instead of a scan."""
    store = roles.vectors(spark, d)
    found = V.batch_search(store, _centroid_all(store).select(F.lit(0).alias("query_id"), "query_vector"), 10)
    return found.join(store.select("id", "label"), "id").select("id", "label", r4("similarity").alias("similarity"), "rank")


@register("v11_neighbours", roles=("vectors",), sql="""
WITH v AS (SELECT id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM vectors),
s AS (SELECT q.id AS query_id, v.id, list_cosine_similarity(v.e, q.e) AS sim FROM v q, v WHERE q.id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC NULLS LAST, id) AS rk FROM s)
SELECT query_id, rk::INTEGER AS rank, round(sim, 4) AS similarity FROM r WHERE rk <= 5
""")
def v11_neighbours(spark, d):
    """V-11 with stored rows as queries: every row whose id is divisible by 20, against all rows."""
    store = roles.vectors(spark, d)
    queries = store.where(F.col("id") % 20 == 0).select(F.col("id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return V.batch_search(store, queries, 5).select("query_id", "rank", r4("similarity").alias("similarity"))


@register("v11_rows_stored", roles=("vectors",), sql="""
SELECT label::BIGINT AS query_id, (SELECT count(*) FROM vectors)::BIGINT AS stored, true AS within FROM vectors GROUP BY label
""")
def v11_rows_stored(spark, d):
    """What the batch search reads for each query: never more than is stored."""
    store = roles.vectors(spark, d)
    queries = V.label_centroids(store).select(F.col("label").cast("long").alias("query_id"), F.col("embedding").alias("query_vector"))
    read = vector_index.rows_read(vector_index.build_index(store, vector_index.scratch_path(spark)), queries, 10)
    return read.select("query_id", "stored", (F.col("rows_read") <= F.col("stored")).alias("within"))


@register("v8_filtered_search", roles=("vectors",),
          sql=_TOPK_SQL.format(cent=_CENTROID_ALL.strip(), where="WHERE v.label = 3"))
def v8_filtered_search(spark, d):
    store = roles.vectors(spark, d)
    t = V.search(store, _centroid_all(store), 10, where=F.col("label") == 3)
    return t.select("id", "label", r4("similarity").alias("similarity"), "rank")


@register("v10_grounding_context", roles=("vectors",), sql=f"""
WITH {_CENTROID_ALL.strip()},
s AS (SELECT v.id, v.label, list_cosine_similarity(list_transform(v.embedding, lambda x: x::DOUBLE), q.qv) AS sim
      FROM vectors v, q WHERE v.label = 5),
t AS (SELECT *, row_number() OVER (ORDER BY sim DESC NULLS LAST, id) AS rk FROM s QUALIFY rk <= 10)
SELECT CASE WHEN count(*) > 0 THEN string_agg('[label_' || CAST(label AS VARCHAR) || '] vec_' || CAST(id AS VARCHAR),
            chr(10) || chr(10) ORDER BY rk) ELSE 'No relevant reviews found for that query and filter.' END AS context,
       count(*)::BIGINT AS sources FROM t
""")
def v10_grounding_context(spark, d):
    store = roles.vectors(spark, d)
    t = V.search(store, _centroid_all(store), 10, where=F.col("label") == 5)
    t = t.select("rank", F.concat(F.lit("label_"), F.col("label").cast("string")).alias("district"),
                 F.concat(F.lit("vec_"), F.col("id").cast("string")).alias("text"))
    return V.context(t, "text", "district")


@register("v11_batch_search", roles=("vectors",), sql=f"""
WITH {_CENTROID_LABEL.strip()},
s AS (SELECT ql.query_id, v.id,
             list_cosine_similarity(list_transform(v.embedding, lambda x: x::DOUBLE), ql.qv) AS sim FROM vectors v, ql),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC NULLS LAST, id) AS rk FROM s)
SELECT query_id::BIGINT AS query_id, id, round(sim, 4) AS similarity, rk::INTEGER AS rank FROM r WHERE rk <= 10
""")
def v11_batch_search(spark, d):
    store = roles.vectors(spark, d)
    queries = V.label_centroids(store).select(F.col("label").cast("long").alias("query_id"),
                                              F.col("embedding").alias("query_vector"))
    t = V.batch_search(store, queries, 10)
    return t.select("query_id", "id", r4("similarity").alias("similarity"), "rank")
