"""Answer grounding audit (H-1 .. H-7) as a batch job over a table of (question, answer) rows.

Ground truth is one aggregate over the listings (a one-row frame, broadcast to every answer). Each answer is
checked by native string and array expressions: numbers are pulled out with a regex, the first one is compared
with the true mean price when the question asks for it, and phrase rules flag absolute language and false claims
that review data is missing. Errors are an array of structs per row; nothing is collected to the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staylens.functions.semantics import col_of, median, with_scalars

# The number pattern, the phrases each rule looks for, thresholds and the texts of the errors.
NUMBER_PATTERN = r"[¥]?[0-9,]+\.?[0-9]*"
PRICE_QUESTION = ("average price", "avg price")
ABSOLUTE_WORDS = ("exactly", "precisely")
NO_DATA_PHRASES = ("no data", "not available")
REVIEWS_WORD = "reviews"
HEDGE_WORDS = ("maybe", "might", "could", "approximately")
HEDGE_SUFFIX = "\n\n*Based on available data — actual values may vary.*"
ERROR_PCT = 10.0
HIGH_PCT = 20.0
MSG_OVERCONFIDENT = "Response uses absolute language"
MSG_FALSE_NEGATIVE = "Claimed no review data when it exists"

ERROR_TYPE = ("struct<type:string,reported:double,true:double,diff_pct:double,severity:string,"
              "message:string>")


def ground_truth(listings: DataFrame, price="price", district="neighbourhood_cleansed", room_type="room_type",
                 **qkw) -> DataFrame:
    """H-1: one row: listing count, mean and median price, dearest and cheapest district by mean price (ties:
    first name) with that mean, number of room types and of districts, listings per room type as 'type=count' and
    the names of all districts, both in order of name and joined by '; ' (one entry per distinct value)."""
    by_d = listings.where(F.col(district).isNotNull()).groupBy(district).agg(F.avg(price).alias("_m")).where(
        F.col("_m").isNotNull())
    ext = by_d.agg(
        F.min_by(district, F.struct(-F.col("_m"), F.col(district))).alias("top_neighborhood"),
        F.max("_m").alias("top_neighborhood_price"),
        F.min_by(district, F.struct(F.col("_m"), F.col(district))).alias("cheapest_neighborhood"),
        F.min("_m").alias("cheapest_neighborhood_price"))
    base = listings.agg(F.count(F.lit(1)).alias("total_listings"), F.avg(price).alias("avg_price"),
                        F.count_distinct(room_type).alias("room_types"),
                        F.count_distinct(district).alias("neighborhoods"))
    med = median(listings, price, name="median_price", **qkw)
    per_type = listings.where(F.col(room_type).isNotNull()).groupBy(F.col(room_type).cast("string").alias("_t")).agg(
        F.count(F.lit(1)).alias("_n")).agg(F.array_join(F.transform(
            F.array_sort(F.collect_list(F.struct("_t", "_n"))), lambda x: F.concat_ws("=", x["_t"], x["_n"].cast("string"))),
            "; ").alias("room_type_counts"))
    names = by_names(listings, district).agg(
        F.array_join(F.array_sort(F.collect_list("_name")), "; ").alias("neighborhood_list"))
    return base.crossJoin(med).crossJoin(ext).crossJoin(per_type).crossJoin(names)


def by_names(listings: DataFrame, district: str) -> DataFrame:
    """Distinct district names."""
    return listings.where(F.col(district).isNotNull()).select(F.col(district).cast("string").alias("_name")).distinct()


def numbers(text) -> F.Column:
    """H-2: every number in the text, '¥' and ',' removed; pieces that do not parse (a lone comma) dropped."""
    raw = F.regexp_extract_all(col_of(text), F.lit(NUMBER_PATTERN), 0)
    cleaned = F.transform(raw, lambda s: F.regexp_replace(s, "[¥,]", ""))
    return F.filter(F.transform(cleaned, lambda s: s.try_cast("double")), lambda x: x.isNotNull())


def _contains_any(text: F.Column, words: Sequence[str]) -> F.Column:
    out = None
    for w in words:
        c = F.instr(text, w) > 0
        out = c if out is None else out | c
    return out


def audit(answers: DataFrame, truth: DataFrame, reviews: DataFrame, question="question", answer="answer",
          price_pct: float = ERROR_PCT, high_pct: float = HIGH_PCT) -> DataFrame:
    """H-3 .. H-5: per answer, ``errors`` (price mismatch, overconfidence, false negative, in that order),
    ``has_hallucination`` and ``severity`` (high if any error is high, medium if any error, else none)."""
    has_reviews = reviews.agg((F.count(F.lit(1)) > 0).alias("_has_reviews"))
    scal = truth.select(F.col("avg_price").alias("_true_price")).crossJoin(has_reviews)
    j = with_scalars(answers, scal)
    q, a = F.lower(F.col(question)), F.lower(F.col(answer))
    first = F.try_element_at(numbers(F.col(answer)), F.lit(1))
    nums_exist = F.size(numbers(F.col(answer))) > 0
    diff = F.abs(first - F.col("_true_price")) / F.col("_true_price") * 100
    price_err = F.when(_contains_any(q, PRICE_QUESTION) & nums_exist & (diff > price_pct), F.struct(
        F.lit("price_mismatch").alias("type"), first.alias("reported"), F.col("_true_price").alias("true"),
        diff.alias("diff_pct"), F.when(diff > high_pct, "high").otherwise("medium").alias("severity"),
        F.lit(None).cast("string").alias("message")))
    none_d = F.lit(None).cast("double")
    over_err = F.when(_contains_any(a, ABSOLUTE_WORDS), F.struct(
        F.lit("overconfidence").alias("type"), none_d.alias("reported"), none_d.alias("true"),
        none_d.alias("diff_pct"), F.lit("low").alias("severity"), F.lit(MSG_OVERCONFIDENT).alias("message")))
    fn_err = F.when(_contains_any(a, NO_DATA_PHRASES) & (F.instr(a, REVIEWS_WORD) > 0) & F.col("_has_reviews"),
                    F.struct(F.lit("false_negative").alias("type"), none_d.alias("reported"), none_d.alias("true"),
                             none_d.alias("diff_pct"), F.lit("high").alias("severity"),
                             F.lit(MSG_FALSE_NEGATIVE).alias("message")))
    errors = F.array_compact(F.array(price_err.cast(ERROR_TYPE), over_err.cast(ERROR_TYPE), fn_err.cast(ERROR_TYPE)))
    out = j.withColumn("errors", errors).drop("_true_price", "_has_reviews")
    sev = (F.when(F.exists("errors", lambda e: e["severity"] == "high"), "high")
           .when(F.size("errors") > 0, "medium").otherwise("none"))
    return out.withColumn("has_hallucination", F.size("errors") > 0).withColumn("severity", sev)


def pass_rate(audited: DataFrame) -> DataFrame:
    """H-6: answers checked, passed (no error) and the pass rate in percent."""
    return audited.agg(F.count(F.lit(1)).alias("tested"),
                       F.count(F.when(~F.col("has_hallucination"), 1)).alias("passed")).withColumn(
        "pass_rate", F.try_divide(F.col("passed") * 100.0, F.col("tested")))


def hedge(answer) -> F.Column:
    """H-7: the answer with the caveat appended when it hedges."""
    a = col_of(answer)
    return F.when(_contains_any(F.lower(a), HEDGE_WORDS), F.concat(a, F.lit(HEDGE_SUFFIX))).otherwise(a)


def answers_from_turns(turns: DataFrame, conv="conv_id", turn="turn", role="role", text="text",
                       asker="user", responder="assistant") -> DataFrame:
    """(question, answer) pairs: each asker turn with the responder turn right after it in the same
    conversation. An equi-join on (conversation, turn), so one long conversation still spreads over tasks."""
    qs = turns.where(F.col(role) == asker).select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"),
                                                   F.col(text).alias("question"))
    ans = turns.where(F.col(role) == responder).select(F.col(conv).alias("conv_id"),
                                                        (F.col(turn) - 1).alias("turn"), F.col(text).alias("answer"))
    return qs.join(ans, ["conv_id", "turn"], "inner")
