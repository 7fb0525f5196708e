"""The queries of this subpackage and their DuckDB twins: one ``opN_<name>`` per operator, over whole tables."""

from __future__ import annotations

import re
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from staylens.llm import (
    alignment, ann, byte_bpe, chat_format, html_extract, language_id, lexical, mixing, packing, pii, quality_rules, secret_scan, simhash,
)
from staylens.llm.common import table

WORD_VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
BYTE_VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
ALIGNED = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def op1_role_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.format_conversations(table(spark, sf_dir, "conversations"))


def op2_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), WORD_VOCABULARY)


def op3_ppm_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op4_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op5_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.components(table(spark, sf_dir, "documents"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip_digests(table(spark, sf_dir, "documents"), BYTE_VOCABULARY, public_tokenizers.PATTERN)


def op8_dom_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(table(spark, sf_dir, "pages"))


def op9_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_policy(quality_rules.ledger(table(spark, sf_dir, "documents")))


def op10_candidate_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(table(spark, sf_dir, "documents"))


def op11_pair_bitmaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_documents(table(spark, sf_dir, "documents"), *ALIGNED)


def op12_sainte_lague(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op13_pair_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_role_repair, op2_pattern_packing, op3_ppm_language, op4_nn_descent, op5_secret_ownership, op6_simhash,
        op7_byte_bpe, op8_dom_model, op9_rule_ledger, op10_candidate_boosting, op11_pair_bitmaps,
        op12_sainte_lague, op13_pair_maxscore)
}

_SPACE = r"[\x20\x09-\x0D]"


def _rule_sql() -> str:
    """The ledger in DuckDB: measurements by list functions and window counts, the same rule conditions, the policies."""
    bits = " + ".join(f"CASE WHEN {r.fails} THEN {quality_rules.BIT[r.name]} ELSE 0 END" for r in quality_rules.RULES)
    base, whole = quality_rules.POLICIES["base"], quality_rules.POLICIES["base"] | quality_rules.POLICIES[quality_rules.CURRENT]
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, list_filter(string_split_regex(t, '{_SPACE}+'), lambda x: x <> '') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
tri AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
        FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
many AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM tri),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM many WHERE c > 1) GROUP BY r),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
             (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
             len(l)::BIGINT AS n_lines,
             len(list_filter(w, lambda x: strlen(x) > 1 AND regexp_matches(x, '[A-Z]') AND NOT regexp_matches(x, '[a-z]')))::BIGINT
               AS n_shouted,
             coalesce(list_max(list_transform(w, lambda x: strlen(x))), 0)::BIGINT AS longest_word
      FROM w LEFT JOIN rep USING (r)),
f AS (SELECT *, ({bits})::BIGINT AS fail_bits FROM m)
SELECT *, (fail_bits & {base}) <> 0 AS base_failed, (fail_bits & {whole}) = 0 AS kept FROM f
"""


def _either_case(pattern: str) -> str:
    """A pattern that begins with (?i), spelt out: DuckDB's own flag would also fold two letters from outside ASCII."""
    if not pattern.startswith("(?i)"):
        return pattern
    words, rest = pattern[4:].split(")", 1)
    return re.sub("[a-z]", lambda m: f"[{m[0].upper()}{m[0]}]", words) + ")" + rest


def _secret_sql() -> str:
    """The scan in DuckDB: a match begins after the texts between matches and the matches before it."""
    parts = []
    for order, kind in enumerate((*secret_scan.BASE, *secret_scan.ADDED)):
        pattern = _either_case(kind.pattern).replace("'", "''")
        value = f"regexp_extract(m[i], '{pattern}', {kind.value})" if kind.value else "m[i]"
        parts.append(f"""
SELECT r, {order} AS ord, '{kind.name}' AS kind, pos AS start, pos + length(m[i]) AS stop, {value} AS value FROM (
  SELECT r, m, i, list_sum(list_transform(p[1:i], lambda x: length(x)))
                  + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS pos
  FROM (SELECT r, m, p, unnest(range(1, len(m) + 1)) AS i FROM (
    SELECT r, regexp_extract_all(t, '{pattern}') AS m, string_split_regex(t, '{pattern}') AS p FROM d)))
WHERE length({value}) >= {kind.least}""")
    n = len(secret_scan.BASE)
    listed = "string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY start, ord, stop)"
    counts = ", ".join(f"count(CASE WHEN ord = {k} THEN 1 END)::BIGINT AS n_{x.name}" for k, x in enumerate(secret_scan.BASE))
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
c AS ({" UNION ALL ".join(parts)}),
o AS (SELECT value, count(DISTINCT doc_id) AS repos,
             count(DISTINCT CASE WHEN source IS NULL THEN 'r:' || doc_id ELSE 'o:' || source END) AS owners
      FROM c JOIN d USING (r) GROUP BY value),
j AS (SELECT c.*, repos, owners, owners < {secret_scan.EXAMPLE_OWNERS} AND repos < {secret_scan.EXAMPLE_REPOS} AS live
      FROM c JOIN o USING (value)),
b AS (SELECT r, {counts}, {listed} AS base FROM j WHERE ord < {n} GROUP BY r),
a AS (SELECT r, {listed} AS spans FROM j WHERE ord < {n} OR live GROUP BY r),
v AS (SELECT r, count(CASE WHEN live THEN 1 END)::BIGINT AS n_live, count(CASE WHEN NOT live THEN 1 END)::BIGINT AS n_example,
             max(repos)::BIGINT AS n_repos, max(owners)::BIGINT AS n_owners FROM j GROUP BY r)
SELECT doc_id, {", ".join(f"coalesce(n_{x.name}, 0) AS n_{x.name}" for x in secret_scan.BASE)},
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live,
       coalesce(n_example, 0) AS n_example, coalesce(n_repos, 0) AS n_repos, coalesce(n_owners, 0) AS n_owners
FROM d LEFT JOIN b USING (r) LEFT JOIN a USING (r) LEFT JOIN v USING (r)
"""


SQL: dict[str, str] = {"op5_secret_ownership": _secret_sql(), "op9_rule_ledger": _rule_sql(),
                       "op12_sainte_lague": mixing.mix_sql(), "op13_pair_maxscore": lexical.rank_sql()}
