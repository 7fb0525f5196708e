"""Grounding audit queries (H-1 .. H-7): truth from the listings role, answers from the conversations table."""

from __future__ import annotations

from pyspark.sql import functions as F

from staylens.functions.semantics import r4, with_scalars
from staylens.operators import audit as H
from staylens.plans.catalog.reports import _r4all
from staylens.plans.registry import register
from staylens.sources import roles


def _sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _any_sql(col: str, words) -> str:
    return "(" + " OR ".join(f"contains({col}, {_sql_str(w)})" for w in words) + ")"


_TRUTH_SQL = """
byd AS (SELECT neighbourhood_cleansed AS d, avg(price) AS m FROM listings
        WHERE neighbourhood_cleansed IS NOT NULL GROUP BY 1 HAVING avg(price) IS NOT NULL),
truth AS (SELECT count(*)::BIGINT AS total_listings, avg(price) AS avg_price, median(price) AS median_price,
                 count(DISTINCT room_type)::BIGINT AS room_types,
                 count(DISTINCT neighbourhood_cleansed)::BIGINT AS neighborhoods,
                 (SELECT d FROM byd ORDER BY m DESC, d LIMIT 1) AS top_neighborhood,
                 (SELECT max(m) FROM byd) AS top_neighborhood_price,
                 (SELECT d FROM byd ORDER BY m ASC, d LIMIT 1) AS cheapest_neighborhood,
                 (SELECT min(m) FROM byd) AS cheapest_neighborhood_price,
                 (SELECT string_agg(t || '=' || CAST(n AS VARCHAR), '; ' ORDER BY t) FROM (
                    SELECT room_type AS t, count(*) AS n FROM listings WHERE room_type IS NOT NULL GROUP BY 1))
                   AS room_type_counts,
                 (SELECT string_agg(d, '; ' ORDER BY d) FROM (
                    SELECT DISTINCT neighbourhood_cleansed AS d FROM listings WHERE neighbourhood_cleansed IS NOT NULL))
                   AS neighborhood_list FROM listings)"""

_NUMS_SQL = ("list_filter(list_transform(list_transform(regexp_extract_all({c}, '[¥]?[0-9,]+\\.?[0-9]*'), "
             "lambda s: regexp_replace(s, '[¥,]', '', 'g')), lambda s: TRY_CAST(s AS DOUBLE)), lambda x: x IS NOT NULL)")

# The conversations hold no prices: each pair is prefixed, by (conversation, turn), with a case that a rule is for. The
# number is the true mean price times a factor.
_KINDS = 8
_ASKED = "What is the average price? "
_CASES = (("It is ¥", 1.0), ("It is ¥", 1.15), ("It is ¥", 1.5), ("Roughly,. ", 1.5), ("It is exactly so. ", None),
          ("There is no data on reviews. ", None), ("It might be so. ", None), ("", None))
_KIND_SQL = f"((q.conv_id * 3 + q.turn // 2) % {_KINDS})"
_CASE_SQL = "CASE " + _KIND_SQL + " " + " ".join(
    f"WHEN {k} THEN {_sql_str(t)}" + (f" || CAST(CAST(floor(truth.avg_price * {x!r}) AS BIGINT) AS VARCHAR) || '. '" if x else "")
    for k, (t, x) in enumerate(_CASES)) + " END"

_AUDIT_SQL = f"""
qa AS (SELECT q.conv_id, q.turn, CASE WHEN {_KIND_SQL} < 4 THEN {_sql_str(_ASKED)} ELSE '' END || q.text AS question,
              {_CASE_SQL} || a.text AS answer
       FROM conversations q
       JOIN conversations a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 AND a.role = 'assistant', truth
       WHERE q.role = 'user'),
hr AS (SELECT count(*) > 0 AS has_reviews FROM reviews),
x AS (SELECT qa.*, lower(question) AS lq, lower(answer) AS la, {_NUMS_SQL.format(c="answer")} AS nums,
             truth.avg_price AS tp, hr.has_reviews FROM qa, truth, hr),
y AS (SELECT *, nums[1] AS first, abs(nums[1] - tp) / tp * 100 AS diff FROM x),
e AS (SELECT conv_id, turn, answer,
             CASE WHEN {_any_sql("lq", H.PRICE_QUESTION)} AND len(nums) > 0 AND diff > {H.ERROR_PCT!r}
                  THEN CASE WHEN diff > {H.HIGH_PCT!r} THEN 'high' ELSE 'medium' END END AS price_sev,
             first, diff,
             {_any_sql("la", H.ABSOLUTE_WORDS)} AS over,
             {_any_sql("la", H.NO_DATA_PHRASES)} AND contains(la, {_sql_str(H.REVIEWS_WORD)}) AND has_reviews AS fneg
      FROM y),
audited AS (SELECT conv_id, turn, answer, price_sev, first, diff,
                   list_filter([CASE WHEN price_sev IS NOT NULL THEN 'price_mismatch' END,
                                CASE WHEN over THEN 'overconfidence' END,
                                CASE WHEN fneg THEN 'false_negative' END], lambda t: t IS NOT NULL) AS types,
                   list_filter([price_sev, CASE WHEN over THEN 'low' END, CASE WHEN fneg THEN 'high' END],
                               lambda t: t IS NOT NULL) AS sevs FROM e)"""


@register("h1_ground_truth", roles=("listings",), sql=f"""
WITH {_TRUTH_SQL.strip()}
SELECT total_listings, round(avg_price, 4) AS avg_price, round(median_price, 4) AS median_price, room_types,
       neighborhoods, top_neighborhood, round(top_neighborhood_price, 4) AS top_neighborhood_price,
       cheapest_neighborhood, round(cheapest_neighborhood_price, 4) AS cheapest_neighborhood_price,
       room_type_counts, neighborhood_list FROM truth
""")
def h1_ground_truth(spark, d):
    return _r4all(H.ground_truth(roles.listings(spark, d)))


@register("h2_document_numbers", sql=f"""
WITH n AS (SELECT doc_id, {_NUMS_SQL.format(c="text")} AS nums,
                  list_filter(list_transform(regexp_extract_all(text, '[¥]?[0-9,]+\\.?[0-9]*'),
                              lambda s: regexp_replace(s, '[¥,]', '', 'g')), lambda s: s <> '') AS raw
           FROM documents)
SELECT doc_id, CAST(len(nums) AS INTEGER) AS n_numbers, nums[1] AS first_number, list_max(nums) AS max_number,
       array_to_string(raw, ' ') AS numbers_text FROM n
""")
def h2_document_numbers(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    nums = H.numbers("text")
    raw = F.filter(F.transform(F.regexp_extract_all("text", F.lit(H.NUMBER_PATTERN), 0),
                               lambda s: F.regexp_replace(s, "[¥,]", "")), lambda s: s != "")
    return docs.select("doc_id", F.size(nums).alias("n_numbers"), F.try_element_at(nums, F.lit(1)).alias("first_number"),
                       F.array_max(nums).alias("max_number"), F.array_join(raw, " ").alias("numbers_text"))


def _posed(spark, d, truth):
    """Question and answer pairs of the conversations, each with the case of its kind in front."""
    pairs = H.answers_from_turns(spark.read.parquet(f"{d}/conversations.parquet"))
    kind = (F.col("conv_id") * 3 + F.floor(F.col("turn") / 2)) % _KINDS
    case = F.lit(None).cast("string")
    for k, (text, factor) in enumerate(_CASES):
        number = F.floor(F.col("_mean") * factor).cast("bigint").cast("string") if factor else F.lit("")
        case = F.when(kind == k, F.concat(F.lit(text), number, F.lit(". " if factor else ""))).otherwise(case)
    asked = F.when(kind < 4, F.lit(_ASKED)).otherwise(F.lit(""))
    j = with_scalars(pairs, truth.select(F.col("avg_price").alias("_mean")))
    return j.select("conv_id", "turn", F.concat(asked, "question").alias("question"),
                    F.concat(case, "answer").alias("answer"))


def _audited(spark, d):
    truth = H.ground_truth(roles.listings(spark, d))
    return H.audit(_posed(spark, d, truth), truth, roles.reviews(spark, d))


@register("h5_audit_conversations", roles=("listings", "reviews"), sql=f"""
WITH {_TRUTH_SQL.strip()},
{_AUDIT_SQL.strip()}
SELECT conv_id, turn, len(types) > 0 AS has_hallucination, CAST(len(types) AS INTEGER) AS n_errors,
       array_to_string(types, ',') AS error_types,
       CASE WHEN list_contains(sevs, 'high') THEN 'high' WHEN len(sevs) > 0 THEN 'medium' ELSE 'none' END AS severity,
       CASE WHEN price_sev IS NOT NULL THEN first END AS reported,
       round(CASE WHEN price_sev IS NOT NULL THEN diff END, 4) AS diff_pct
FROM audited
""")
def h5_audit_conversations(spark, d):
    """H-3 to H-5 over the conversations. A fixed question and answer of some kind is put in front of each pair of turns (``_posed``), as the invented texts ask nothing."""
    a = _audited(spark, d)
    price = F.filter("errors", lambda e: e["type"] == "price_mismatch")
    return a.select("conv_id", "turn", "has_hallucination", F.size("errors").alias("n_errors"),
                    F.array_join(F.transform("errors", lambda e: e["type"]), ",").alias("error_types"), "severity",
                    F.try_element_at(price, F.lit(1))["reported"].alias("reported"),
                    r4(F.try_element_at(price, F.lit(1))["diff_pct"]).alias("diff_pct"))


@register("h6_pass_rate", roles=("listings", "reviews"), sql=f"""
WITH {_TRUTH_SQL.strip()},
{_AUDIT_SQL.strip()}
SELECT count(*)::BIGINT AS tested, count(CASE WHEN len(types) = 0 THEN 1 END)::BIGINT AS passed,
       round(CASE WHEN count(*) > 0 THEN count(CASE WHEN len(types) = 0 THEN 1 END) * 100.0 / count(*) END, 4)
         AS pass_rate
FROM audited
""")
def h6_pass_rate(spark, d):
    """H-6 over the conversations. A fixed question and answer of some kind is put in front of each pair of turns (``_posed``), as the invented texts ask nothing."""
    return _r4all(H.pass_rate(_audited(spark, d)))


@register("h7_hedged_answers", roles=("listings", "reviews"), sql=f"""
WITH {_TRUTH_SQL.strip()},
{_AUDIT_SQL.strip()}
SELECT conv_id, turn, {_any_sql("lower(answer)", H.HEDGE_WORDS)} AS hedged,
       CASE WHEN {_any_sql("lower(answer)", H.HEDGE_WORDS)} THEN answer || {_sql_str(H.HEDGE_SUFFIX)} ELSE answer END
         AS final_answer
FROM qa
""")
def h7_hedged_answers(spark, d):
    """H-7 over the conversations. A fixed question and answer of some kind is put in front of each pair of turns (``_posed``), as the invented texts ask nothing."""
    t = _posed(spark, d, H.ground_truth(roles.listings(spark, d)))
    hedged = H.hedge("answer")
    return t.select("conv_id", "turn", (hedged != F.col("answer")).alias("hedged"), hedged.alias("final_answer"))
