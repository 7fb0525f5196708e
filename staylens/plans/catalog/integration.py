"""External-table integration queries (J-1 .. J-7): the district table built from nation/region/supplier."""

from __future__ import annotations

from pyspark.sql import functions as F

from staylens.functions.semantics import r4
from staylens.operators import discovery as D
from staylens.operators import integrate as J
from staylens.plans.catalog.discovery import TITLES_SQL
from staylens.plans.registry import register
from staylens.sources import roles

EXT_COLS = ["Neighbourhood-Cleansed", "nation_code", "region", "suppliers", "supplier_balance", "ward_name"]
KNOWN_TEXT_COLS = ["id", "host_id", "neighbourhood_cleansed", "room_type", "accommodates", "number_of_reviews",
                   "availability_365", "minimum_nights", "instant_bookable"]
IMPORT = ["region", "suppliers"]


def _profile_sql():
    parts_m, parts_v = [], []
    for i, c in enumerate(EXT_COLS):
        q = f'"{c}"'
        parts_m.append(f"SELECT {i} AS position, '{c}' AS column_name, avg(CASE WHEN {q} IS NULL THEN 1.0 ELSE 0.0 END)"
                       f"::DOUBLE AS share, count(*) AS n_rows FROM external")
        parts_v.append(f"SELECT DISTINCT '{c}' AS column_name, CAST({q} AS VARCHAR) AS value FROM external "
                       f"WHERE {q} IS NOT NULL")
    hints = ", ".join(f"('{c}', {str(J.join_hint(c)).lower()})" for c in EXT_COLS)
    return f"""
WITH m AS ({' UNION ALL '.join(parts_m)}),
v AS ({' UNION ALL '.join(parts_v)}),
u AS (SELECT column_name, count(*) AS uniq FROM v GROUP BY 1),
r AS (SELECT column_name, value, row_number() OVER (PARTITION BY column_name ORDER BY value) AS rk FROM v),
s AS (SELECT column_name, string_agg(value, ' | ' ORDER BY rk) AS samples FROM r WHERE rk <= 3 GROUP BY 1),
h AS (SELECT * FROM (VALUES {hints}) t(column_name, join_hint))
SELECT m.position, m.column_name, coalesce(u.uniq, 0)::BIGINT AS "unique", round(m.share * 100, 4) AS missing_exact,
       round_even(m.share * 100, 1) AS missing_pct, coalesce(s.samples, '') AS samples, h.join_hint,
       m.n_rows::BIGINT AS n_rows, {len(EXT_COLS)}::BIGINT AS n_cols
FROM m LEFT JOIN u USING (column_name) LEFT JOIN s USING (column_name) JOIN h USING (column_name)
"""


@register("j1_profile_external", roles=("external",), sql=_profile_sql())
def j1_profile_external(spark, d):
    p = J.profile_table(roles.external(spark, d))
    return p.select("position", "column_name", "unique", r4("missing_exact").alias("missing_exact"), "missing_pct",
                    "samples", "join_hint", "n_rows", "n_cols")


@register("j3_fuzzy_key_map", roles=("external", "listings"), sql="""
WITH a AS (SELECT DISTINCT ward_name AS new_key, translate(lower(ward_name), '_-', '  ') AS na FROM external
           WHERE ward_name IS NOT NULL),
b AS (SELECT DISTINCT neighbourhood_cleansed AS known_key, translate(lower(neighbourhood_cleansed), '_-', '  ') AS nb
      FROM listings WHERE neighbourhood_cleansed IS NOT NULL),
p AS (SELECT new_key, known_key, 1 - levenshtein(na, nb) / greatest(length(na), length(nb)) AS sim FROM a, b),
best AS (SELECT new_key, known_key, sim, row_number() OVER (PARTITION BY new_key ORDER BY sim DESC, known_key) AS rk
         FROM p WHERE sim >= 0.55)
SELECT a.new_key, best.known_key, round(best.sim, 4) AS similarity
FROM a LEFT JOIN best ON a.new_key = best.new_key AND best.rk = 1
""")
def j3_fuzzy_key_map(spark, d):
    t = J.fuzzy_key_map(roles.external(spark, d), roles.listings(spark, d), "ward_name", "neighbourhood_cleansed")
    return t.select("new_key", "known_key", r4("similarity").alias("similarity"))


def _containment_sql():
    new_cols = [c for c in EXT_COLS if c != "supplier_balance"]
    a = " UNION ALL ".join(f"SELECT DISTINCT '{c}' AS column_name, CAST(\"{c}\" AS VARCHAR) AS value FROM external "
                           f"WHERE \"{c}\" IS NOT NULL" for c in new_cols)
    b = " UNION ALL ".join(f"SELECT DISTINCT '{c}' AS known_column, CAST({c} AS VARCHAR) AS value FROM listings "
                           f"WHERE {c} IS NOT NULL" for c in KNOWN_TEXT_COLS)
    return f"""
WITH a AS ({a}), b AS ({b}),
sz AS (SELECT column_name, count(*) AS n FROM a GROUP BY 1),
h AS (SELECT a.column_name, b.known_column, count(*) AS hits FROM a JOIN b ON a.value = b.value GROUP BY 1, 2)
SELECT h.column_name AS new_column, h.known_column, round(h.hits / sz.n, 4) AS containment
FROM h JOIN sz USING (column_name)
"""


@register("j4_value_containment", roles=("external", "listings"), sql=_containment_sql())
def j4_value_containment(spark, d):
    ext = roles.external(spark, d)
    t = J.value_containment(ext, roles.listings(spark, d), [c for c in EXT_COLS if c != "supplier_balance"],
                            KNOWN_TEXT_COLS)
    return t.select("new_column", "known_column", r4("containment").alias("containment"))


def _mapping_sql():
    long = lambda name, table, cols: " UNION ALL ".join(
        f"SELECT DISTINCT '{c}' AS {name}, CAST(\"{c}\" AS VARCHAR) AS value FROM {table} WHERE \"{c}\" IS NOT NULL" for c in cols)
    return f"""
WITH a AS ({long("new_column", "external", [c for c in EXT_COLS if c != "supplier_balance"])}),
b AS ({long("known_column", "listings", KNOWN_TEXT_COLS)}),
h AS (SELECT new_column, known_column, count(*)::DOUBLE AS hits FROM a JOIN b USING (value) GROUP BY ALL),
s AS (SELECT h.*, hits / (SELECT count(*) FROM a WHERE a.new_column = h.new_column) AS containment,
             hits / (SELECT count(*) FROM b WHERE b.known_column = h.known_column) AS coverage FROM h)
SELECT new_column, known_column, round(containment, 4) AS containment FROM s WHERE least(containment, coverage) >= 0.5
QUALIFY row_number() OVER (PARTITION BY new_column ORDER BY 2 * containment * coverage / (containment + coverage) DESC, known_column) = 1
"""


@register("j4_value_mapping", roles=("external", "listings"), sql=_mapping_sql())
def j4_value_mapping(spark, d):
    """The part of J-4 that values decide: sketches, then exact comparison of the pairs they leave."""
    ext = roles.external(spark, d)
    m = J.value_mapping(ext.select(*[f"`{c}`" for c in EXT_COLS if c != "supplier_balance"]), roles.listings(spark, d).select(*KNOWN_TEXT_COLS))
    return m.select("new_column", "known_column", r4("containment").alias("containment"))


@register("j4_column_mapping")
def j4_column_mapping(spark, d):
    """Name + value mapping with the default key (name matching is difflib on column names: rows-only check)."""
    return J.suggest_column_mapping(roles.external(spark, d), roles.listings(spark, d).select(*KNOWN_TEXT_COLS))


@register("j5_merge_external", roles=("external", "listings"), sql="""
SELECT l.id, e.region, e.suppliers FROM listings l
LEFT JOIN (SELECT "Neighbourhood-Cleansed" AS k, arg_min(region, "Neighbourhood-Cleansed") AS region,
                  arg_min(suppliers, "Neighbourhood-Cleansed") AS suppliers
           FROM external GROUP BY 1) e
       ON l.neighbourhood_cleansed IS NOT DISTINCT FROM e.k
""")
def j5_merge_external(spark, d):
    enriched, _ = J.merge_with_report(roles.listings(spark, d), roles.external(spark, d), "Neighbourhood-Cleansed",
                                      "neighbourhood_cleansed", IMPORT)
    return enriched.select("id", "region", "suppliers")


@register("j6_merge_report", roles=("external", "listings"), sql="""
WITH e AS (SELECT DISTINCT "Neighbourhood-Cleansed" AS k, region FROM external),
m AS (SELECT l.id, e.k, e.region FROM listings l LEFT JOIN e ON l.neighbourhood_cleansed IS NOT DISTINCT FROM e.k)
SELECT 'success' AS status, 'neighbourhood_cleansed' AS join_key, (SELECT count(*) FROM listings)::BIGINT AS original_rows,
       count(*)::BIGINT AS merged_rows, 'region, suppliers' AS new_columns,
       round(avg(CASE WHEN region IS NOT NULL THEN 1.0 ELSE 0.0 END)::DOUBLE * 100, 4) AS match_exact,
       round_even(avg(CASE WHEN region IS NOT NULL THEN 1.0 ELSE 0.0 END)::DOUBLE * 100, 1) AS match_rate,
       round(avg(CASE WHEN k IS NOT NULL THEN 1.0 ELSE 0.0 END)::DOUBLE * 100, 4) AS key_match_exact,
       round_even(avg(CASE WHEN k IS NOT NULL THEN 1.0 ELSE 0.0 END)::DOUBLE * 100, 1) AS key_match_rate
FROM m
""")
def j6_merge_report(spark, d):
    _, rep = J.merge_with_report(roles.listings(spark, d), roles.external(spark, d), "Neighbourhood-Cleansed",
                                 "neighbourhood_cleansed", IMPORT)
    return rep.select("status", "join_key", "original_rows", "merged_rows", "new_columns",
                      r4("match_exact").alias("match_exact"), "match_rate", r4("key_match_exact").alias("key_match_exact"),
                      "key_match_rate")


@register("j7_discovery_enriched", roles=("listings",), sql=TITLES_SQL)
def j7_discovery_enriched(spark, d):
    """Discovery re-run on the enriched listings: a left merge by key keeps every listing once, so the titles stay."""
    enriched, _ = J.merge_with_report(roles.listings(spark, d), roles.external(spark, d), "Neighbourhood-Cleansed",
                                      "neighbourhood_cleansed", IMPORT)
    return D.run_discovery(enriched).select("category", "severity", "title")
