"""Cleaning of listings, calendar and reviews (C-1 .. C-11).

Every step is a column expression over the whole table. Statistics the steps need (medians for imputation) are
one-row aggregates broadcast back into the same plan. The only eager step is C-7 (drop mostly-null columns): the
output schema depends on the data, so one aggregate of null counts runs first and only its one row is read.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from html.entities import html5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staylens.functions.semantics import (
    UNICODE_SPACE, checkpointed, col_of, cut, hash_sample, nan_to_null, parse_number, quantiles, unicode_strip,
    with_scalars,
)

# Fixed values of the cleaning rules.
PRICE_COLUMNS = ["price", "weekly_price", "monthly_price", "security_deposit", "cleaning_fee", "extra_people"]
CALENDAR_PRICE_COLUMNS = ["price", "adjusted_price"]
IMPUTE_MEDIAN_COLUMNS = ["bathrooms", "bedrooms", "beds", "review_scores_rating", "reviews_per_month"]
LISTING_DATE_COLUMNS = ["last_scraped", "first_review", "last_review", "host_since"]
RATING_EDGES = [0, 80, 90, 95, 100]
RATING_LABELS = ["Poor", "Good", "Great", "Excellent"]
ANONYMOUS = "Anonymous"
CALENDAR_SAMPLE = 100_000
REVIEW_SAMPLE = 50_000

# Entities decoded natively (the rest need the full decoder): fixed values.
COMMON_ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"),
                   ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&")]
# Python's str-mode \s also matches these, which the shared class below does not cover on its own.
WHITESPACE_CLASS = r"[\s\p{Z}\x{1c}-\x{1f}\x{85}]"


def clean_price(c: str | Column, compat: bool = False) -> Column:
    """C-1: drop '$', ',', '¥' and spaces, then the trailing 'per night…' text, and parse; else null.

    Spaces go first, so the reference's own 'per night' rule can never match ("¥9,000 per night" → null).
    ``compat=True`` keeps that outcome; by default the joined form 'pernight…' is stripped as intended.
    """
    s = F.regexp_replace(col_of(c).cast("string"), "[$,¥ ]", "")
    if not compat:
        s = F.regexp_replace(s, "pernight.*$", "")
    return parse_number(s)


def parse_flag(c: str | Column) -> Column:
    """C-8: 't' → true, 'f' → false, anything else → null."""
    x = col_of(c)
    return F.when(x == "t", F.lit(True)).when(x == "f", F.lit(False))


def _present(df: DataFrame, cols: Sequence[str]) -> list[str]:
    return [c for c in cols if c in df.columns]


def parse_date(c: str | Column, strict: bool = False) -> Column:
    """C-4: text to date. Coerced (default, listings): anything unparseable becomes null. Strict (calendar,
    reviews): ``to_date``, which fails on malformed text under ANSI mode, as a strict parse does."""
    x = col_of(c).cast("string")
    return F.to_date(x) if strict else F.to_date(F.try_to_timestamp(x))


def median_impute(df: DataFrame, columns: Sequence[str], **qkw) -> DataFrame:
    """C-3: fill nulls of each column with that column's exact median. One quantile job for all columns (on the
    unpivoted long form); its one-row result is broadcast back."""
    cols = _present(df, columns)
    if not cols:
        return df
    casted = df.select(*[nan_to_null(F.col(c).cast("double")).alias(c) for c in cols])
    long = casted.unpivot([], cols, "_col", "_val")
    meds = quantiles(long, "_val", [0.5], ["_col"], ["_med"], **qkw)
    one = meds.groupBy().agg(*[F.max(F.when(F.col("_col") == c, F.col("_med"))).alias(f"_med_{c}") for c in cols])
    # One row, cut from its lineage: whatever reads the result (the sparse-column check too) reuses the medians.
    out = with_scalars(df, checkpointed(one))
    for c in cols:
        out = out.withColumn(c, F.coalesce(nan_to_null(F.col(c).cast("double")), F.col(f"_med_{c}")))
    return out.drop(*[f"_med_{c}" for c in cols])


def null_heavy_columns(df: DataFrame, threshold: float = 0.5) -> list[str]:
    """C-7 (plan step): names of columns with strictly more than ``threshold`` of rows null (NaN counts).

    Runs one aggregate and reads its single row: the result decides the output schema."""
    def is_missing(c):
        t = dict(df.dtypes)[c]
        return (F.col(c).isNull() | F.isnan(c)) if t in ("double", "float") else F.col(c).isNull()

    row = df.agg(F.count(F.lit(1)).alias("__n"),
                 *[F.count(F.when(is_missing(c), 1)).alias(f"__{i}") for i, c in enumerate(df.columns)]).first()
    n = row["__n"]
    return [c for i, c in enumerate(df.columns) if row[f"__{i}"] > threshold * n]


def drop_null_heavy(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """C-7: drop columns with more than ``threshold`` nulls."""
    return df.drop(*null_heavy_columns(df, threshold))


def clean_listings(df: DataFrame, compat: bool = False, drop_threshold: float | None = 0.5, **qkw) -> DataFrame:
    """C-2 .. C-7 for listings: prices, median imputation, dates, has_reviews, rating_category, sparse columns.

    ``has_reviews`` is taken before imputation (the reference takes it after, so it is always true;
    ``compat=True`` reproduces that order)."""
    out = df
    for c in _present(out, PRICE_COLUMNS):
        out = out.withColumn(c, clean_price(c, compat))
    rating = "review_scores_rating"
    if rating in out.columns and not compat:
        out = out.withColumn("has_reviews", nan_to_null(F.col(rating)).isNotNull())
    out = median_impute(out, IMPUTE_MEDIAN_COLUMNS, **qkw)
    for c in _present(out, LISTING_DATE_COLUMNS):
        out = out.withColumn(c, parse_date(c))
    if rating in out.columns:
        if compat:
            out = out.withColumn("has_reviews", F.col(rating).isNotNull())
        out = out.withColumn("rating_category", cut(rating, RATING_EDGES, RATING_LABELS))
    if drop_threshold is not None:
        out = drop_null_heavy(out, drop_threshold)
    return out


def clean_calendar(df: DataFrame, compat: bool = False) -> DataFrame:
    """C-4 / C-8 for calendar: strict date, cleaned prices, 't'/'f' availability."""
    out = df
    if "date" in out.columns:
        out = out.withColumn("date", F.to_date(F.col("date")))
    for c in _present(out, CALENDAR_PRICE_COLUMNS):
        out = out.withColumn(c, clean_price(c, compat))
    if "available" in out.columns:
        out = out.withColumn("available", parse_flag("available"))
    return out


def clean_reviews(df: DataFrame) -> DataFrame:
    """C-9: strict date, 'Anonymous' for a missing reviewer, '' for missing comments, review_length."""
    out = df
    if "date" in out.columns:
        out = out.withColumn("date", F.to_date(F.col("date")))
    if "reviewer_name" in out.columns:
        out = out.withColumn("reviewer_name", F.coalesce(F.col("reviewer_name"), F.lit(ANONYMOUS)))
    if "comments" in out.columns:
        out = out.withColumn("comments", F.coalesce(F.col("comments"), F.lit("")))
        out = out.withColumn("review_length", F.length("comments"))
    return out


def clean_all(data: dict[str, DataFrame], sample_calendar: bool = False, sample_reviews: bool = False,
              compat: bool = False, **qkw) -> dict[str, DataFrame]:
    """C-10: clean every table; optional exact-n seeded samples of calendar (100,000) and reviews (50,000)."""
    out: dict[str, DataFrame] = {}
    if "listings" in data:
        out["listings"] = clean_listings(data["listings"], compat=compat, **qkw)
    if "calendar" in data:
        cal = data["calendar"]
        if sample_calendar:
            cal = hash_sample(cal.withColumn("_sid", F.concat_ws("|", "listing_id", "date")), CALENDAR_SAMPLE,
                              "_sid").drop("_sid")
        out["calendar"] = clean_calendar(cal, compat)
    if "reviews" in data:
        rev = data["reviews"]
        if sample_reviews:
            rev = hash_sample(rev, REVIEW_SAMPLE, "id")
        out["reviews"] = clean_reviews(rev)
    for k in ("neighbourhoods", "neighbourhoods_geojson"):
        if k in data:
            out[k] = data[k]
    return out


# --- C-11 review text ------------------------------------------------------------------------------------------

def decode_common_entities(c: str | Column) -> Column:
    """Decode the common named entities natively (``&amp;`` last, so '&amp;lt;' stays '&lt;' as in one pass)."""
    x = col_of(c)
    for ent, ch in COMMON_ENTITIES:
        x = F.replace(x, F.lit(ent), F.lit(ch))
    return x


# Every named entity, from the HTML standard's table in the standard library; some may end without a semicolon.
_NAMED = {name[:-1]: text for name, text in html5.items() if name.endswith(";")}
_BARE = {name: text for name, text in html5.items() if not name.endswith(";")}


def _number_text(code: Column) -> Column:
    """The text of a numeric reference: zero, surrogates and what lies beyond Unicode become U+FFFD, and 128 to 159 are
    read as Windows-1252, as browsers do."""
    windows = {k: bytes([k]).decode("cp1252", "ignore") or chr(k) for k in range(128, 160)}
    remapped = F.from_json(F.lit(json.dumps(windows)), "map<string,string>")
    bad = (code == 0) | code.between(0xD800, 0xDFFF) | (code > 0x10FFFF) | code.isNull()
    char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    return F.when(bad, F.lit("\ufffd")).when(
        code.between(128, 159), F.try_element_at(remapped, code.cast("string"))).otherwise(char)


def decode_entities(c: str | Column) -> Column:
    """Decode every HTML entity in one pass, natively: named (with or without semicolon) and numeric ones.

    The text is split at its ampersands; each part begins with a reference or gets its ampersand back."""
    named = F.from_json(F.lit(json.dumps(_NAMED)), "map<string,string>")
    bare = F.from_json(F.lit(json.dumps(_BARE)), "map<string,string>")
    bare_pattern = "^(" + "|".join(sorted(_BARE, key=len, reverse=True)) + ")"

    def decoded(part: Column) -> Column:
        def after(n: Column) -> Column:
            return F.substring(part, n + 1, F.length(part))

        whole = F.regexp_extract(part, "^([A-Za-z][A-Za-z0-9]{0,31});", 1)
        short = F.regexp_extract(part, bare_pattern, 1)
        number = F.regexp_extract(part, "^#([0-9]+|[xX][0-9a-fA-F]+);?", 0)
        digits = F.regexp_extract(part, "^#([0-9]+|[xX][0-9a-fA-F]+)", 1)
        is_hex = digits.rlike("^[xX]")
        code = F.when(is_hex, F.conv(F.substring(digits, 2, 16), 16, 10)).otherwise(digits).try_cast("bigint")
        known = F.when(whole != "", F.try_element_at(named, whole))
        return (F.when(known.isNotNull(), F.concat(known, after(F.length(whole) + 1)))
                .when(number != "", F.concat(_number_text(code), after(F.length(number))))
                .when(short != "", F.concat(F.try_element_at(bare, short), after(F.length(short))))
                .otherwise(F.concat(F.lit("&"), part)))

    parts = F.split(col_of(c), "&", -1)
    return F.array_join(F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(decoded(p))), "")


def clean_review_text(c: str | Column, entities: str = "all") -> Column:
    """C-11: decode entities, replace tags by a space, collapse whitespace, strip.

    ``entities="common"`` decodes only the few entities that escape markup. Both are native expressions."""
    x = col_of(c).cast("string")
    x = decode_common_entities(x) if entities == "common" else decode_entities(x)
    x = F.regexp_replace(x, "<[^>]+>", " ")
    x = F.regexp_replace(x, f"{WHITESPACE_CLASS}+", " ")
    return F.regexp_replace(x, f"^{WHITESPACE_CLASS}+|{WHITESPACE_CLASS}+$", "")


__all__ = [
    "clean_price", "parse_flag", "median_impute", "null_heavy_columns", "drop_null_heavy", "clean_listings",
    "clean_calendar", "clean_reviews", "clean_all", "clean_review_text", "decode_common_entities", "decode_entities",
    "unicode_strip", "UNICODE_SPACE",
]
