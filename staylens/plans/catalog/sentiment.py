"""Sentiment and language queries (R-1 .. R-8) over the whole reviews role."""

from __future__ import annotations

from pyspark.sql import functions as F

from staylens.functions.semantics import r4
from staylens.operators import filters as P
from staylens.operators import language_profiles as N
from staylens.operators import lexicon as X
from staylens.operators import reports as A
from staylens.operators import sentiment as R
from staylens.plans.catalog.reports import _hist_sql, _r4all
from staylens.plans.registry import register
from staylens.sources import roles


def _sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _sql_list(words) -> str:
    return "[" + ", ".join(_sql_str(w) for w in words) + "]"


# DuckDB twins of the Spark expressions, generated from the same constants.
_LEX_SQL = "MAP {" + ", ".join(f"{_sql_str(w)}: {v!r}::DOUBLE" for w, v in R.DEFAULT_LEXICON.items()) + "}"
_TOKENS_SQL = "regexp_extract_all(lower(comments), '[\\p{L}'']+')"

# The documents hold no opinions: each review ends, by its id, with words of the lexicon, so every band occurs.
_ENDINGS = ("", " bad and dirty", " not good", " excellent and clean", " awful awful terrible", " not bad", " noisy but nice",
            " perfect wonderful", " clean small", " never happy, worst")
_END_SQL = f"comments || list_extract({_sql_list(_ENDINGS)}, CAST(id % {len(_ENDINGS)} AS INTEGER) + 1)"

_SCORED_SQL = f"""
rv AS (SELECT id, listing_id, {_END_SQL} AS comments FROM reviews),
tk AS (SELECT id, listing_id, comments, coalesce({_TOKENS_SQL}, []) AS t FROM rv),
sc AS (SELECT id, listing_id, list_filter(list_transform(t, lambda w, i: CASE
          WHEN list_contains({_sql_list(R.NEGATIONS)}, CASE WHEN i > 1 THEN t[i - 1] ELSE '' END)
          THEN {_LEX_SQL}[w] * {R.NEGATION_FACTOR!r} ELSE {_LEX_SQL}[w] END), lambda s: s IS NOT NULL) AS s FROM tk),
pol AS (SELECT id, listing_id,
               CASE WHEN len(s) > 0 THEN list_sum(s) / len(s) ELSE 0.0 END::DOUBLE AS sentiment FROM sc),
scored AS (SELECT *, CASE WHEN sentiment >= -1.0 AND sentiment <= -0.1 THEN 'Negative'
                          WHEN sentiment > -0.1 AND sentiment <= 0.1 THEN 'Neutral'
                          WHEN sentiment > 0.1 AND sentiment <= 1.0 THEN 'Positive' END AS sentiment_label FROM pol)"""


def _ended(spark, d):
    end = F.element_at(F.array(*[F.lit(e) for e in _ENDINGS]), (F.col("id") % len(_ENDINGS)).cast("int") + 1)
    return roles.reviews(spark, d).withColumn("comments", F.concat("comments", end))


def _scored(spark, d):
    return R.score_reviews(_ended(spark, d))


@register("r1_reviews_for_listings", roles=("reviews", "listings"), sql="""
WITH f AS (SELECT id FROM listings WHERE price BETWEEN 50000 AND 300000 AND room_type IN ('BUILDING', 'MACHINERY'))
SELECT r.id, r.listing_id FROM reviews r WHERE r.listing_id IN (SELECT id FROM f)
""")
def r1_reviews_for_listings(spark, d):
    li = P.market_filter(roles.listings(spark, d), price_range=(50_000, 300_000), room_types=["BUILDING", "MACHINERY"])
    return R.reviews_for_listings(roles.reviews(spark, d), li).select("id", "listing_id")


@register("r2_review_polarity", roles=("reviews",), sql=f"""
WITH {_SCORED_SQL.strip()}
SELECT id, round(sentiment, 4) AS sentiment, sentiment_label FROM scored
""")
def r2_review_polarity(spark, d):
    return _scored(spark, d).select("id", r4("sentiment").alias("sentiment"), "sentiment_label")


@register("r2_polarity_by_table", roles=("reviews",), sql=f"""
WITH {_SCORED_SQL.strip()}
SELECT id, round(sentiment, 4) AS sentiment FROM scored
""")
def r2_polarity_by_table(spark, d):
    """R-2 with the lexicon as a table, joined to the reviews' tokens."""
    lexicon = spark.createDataFrame(sorted(R.DEFAULT_LEXICON.items()), "word string, polarity double")
    t = R.polarity_by_table(_ended(spark, d), lexicon)
    return t.select("id", r4("sentiment").alias("sentiment"))


@register("r4_sentiment_kpis", roles=("reviews",), sql=f"""
WITH {_SCORED_SQL.strip()}
SELECT count(*)::BIGINT AS reviews, round(avg(sentiment), 4) AS avg_sentiment,
       round(avg(CASE WHEN sentiment > 0 THEN 1.0 ELSE 0.0 END) * 100, 4) AS pct_positive FROM scored
""")
def r4_sentiment_kpis(spark, d):
    return _r4all(R.sentiment_kpis(_scored(spark, d)))


@register("r5_label_counts", roles=("reviews",), sql=f"""
WITH {_SCORED_SQL.strip()}
SELECT sentiment_label, count(*)::BIGINT AS count FROM scored WHERE sentiment_label IS NOT NULL GROUP BY 1
""")
def r5_label_counts(spark, d):
    return R.label_counts(_scored(spark, d))


@register("r6_polarity_histogram", roles=("reviews",),
          sql=f"WITH {_SCORED_SQL.strip()},\n" + _hist_sql("scored", "sentiment", 40).strip()[5:])
def r6_polarity_histogram(spark, d):
    return _r4all(A.histogram(_scored(spark, d), "sentiment", 40))


@register("r7_extreme_reviews", roles=("reviews",), sql=f"""
WITH {_SCORED_SQL.strip()}
(SELECT id, round(sentiment, 4) AS sentiment, 'most_positive' AS kind FROM scored WHERE sentiment_label = 'Positive'
 ORDER BY sentiment DESC, id LIMIT 5)
UNION ALL
(SELECT id, round(sentiment, 4) AS sentiment, 'most_negative' AS kind FROM scored WHERE sentiment_label = 'Negative'
 ORDER BY sentiment ASC, id LIMIT 5)
""")
def r7_extreme_reviews(spark, d):
    return R.extremes(_scored(spark, d)).select("id", r4("sentiment").alias("sentiment"), "kind")


def _lang_sql() -> str:
    counts = ",\n       ".join(
        f"len(list_filter(t, lambda w: list_contains({_sql_list(ws)}, w))) AS c_{lang}"
        for lang, ws in R.STOP_WORDS.items())
    langs = list(R.STOP_WORDS)
    best = "greatest(" + ", ".join(f"c_{x}" for x in langs) + ")"
    case = " ".join(f"WHEN c_{x} = {best} THEN '{x}'" for x in langs)
    return f"""
tk AS (SELECT id, lang, coalesce({_TOKENS_SQL}, []) AS t FROM reviews),
cn AS (SELECT id, lang, {counts} FROM tk),
tagged AS (SELECT id, lang, CASE WHEN {best} = 0 THEN 'en' {case} END AS lang_pred FROM cn)"""


@register("r8_language_tags", roles=("reviews",), sql=f"""
WITH {_lang_sql().strip()}
SELECT id, lang_pred FROM tagged
""")
def r8_language_tags(spark, d):
    return R.tag_languages(roles.reviews(spark, d)).select("id", "lang_pred")


@register("r8_language_accuracy", roles=("reviews",), sql=f"""
WITH {_lang_sql().strip()}
SELECT lang, count(*)::BIGINT AS n, count(CASE WHEN lang = lang_pred THEN 1 END)::BIGINT AS correct FROM tagged
GROUP BY lang
""")
def r8_language_accuracy(spark, d):
    t = R.tag_languages(roles.reviews(spark, d))
    return R.language_accuracy(t).select("lang", F.col("n").cast("long"), F.col("correct").cast("long"))


@register("r3_sentiment_bands_compat", roles=("reviews",), sql=f"""
WITH {_SCORED_SQL.strip()}
SELECT id, CASE WHEN sentiment > -1.0 AND sentiment <= -0.1 THEN 'Negative'
                WHEN sentiment > -0.1 AND sentiment <= 0.1 THEN 'Neutral'
                WHEN sentiment > 0.1 AND sentiment <= 1.0 THEN 'Positive' END AS sentiment_label FROM scored
""")
def r3_sentiment_bands_compat(spark, d):
    """R-3 with the reference's open lower edge (a polarity of exactly -1.0 gets no label)."""
    return R.score_reviews(_ended(spark, d), compat=True).select("id", "sentiment_label")


# --- R-2 with a lexicon induced from the corpus ---------------------------------------------------------------------

_SEEDS_SQL = "(VALUES " + ", ".join(f"({_sql_str(w)}, {v!r}::DOUBLE)" for w, v in R.DEFAULT_LEXICON.items()) + ") AS x(word, polarity)"


def _links_sql() -> str:
    near = " UNION ALL ".join(
        f"SELECT least(a, b) AS a, greatest(a, b) AS b FROM (SELECT unnest(t[1:len(t) - {j}]) AS a, unnest(t[{j + 1}:]) AS b FROM tk WHERE len(t) > {j})"
        for j in range(1, X.WINDOW + 1))
    return f"""
rv AS (SELECT id, {_END_SQL} AS comments FROM reviews),
tk AS (SELECT id, coalesce({_TOKENS_SQL}, []) AS t FROM rv),
known AS (SELECT word FROM (SELECT unnest(list_distinct(t)) AS word FROM tk) GROUP BY word HAVING count(*) >= {X.MIN_REVIEWS}),
pairs AS (SELECT a, b, count(*) AS n FROM ({near}) WHERE a <> b GROUP BY a, b),
kept AS (SELECT * FROM pairs WHERE a IN (SELECT word FROM known) AND b IN (SELECT word FROM known)),
both_ways AS (SELECT a AS word, b AS other, n FROM kept UNION ALL SELECT b, a, n FROM kept),
of_word AS (SELECT word, sum(n)::DOUBLE AS n FROM both_ways GROUP BY word),
links AS (SELECT * FROM (SELECT e.word, e.other, ln(e.n::DOUBLE * (SELECT sum(n) FROM of_word) / (w.n * o.n)) AS ppmi
          FROM both_ways e JOIN of_word w ON w.word = e.word JOIN of_word o ON o.word = e.other) WHERE ppmi > 0),
seeds AS (SELECT * FROM {_SEEDS_SQL}),
round0 AS (SELECT * FROM seeds)"""


def _round_sql(k: int) -> str:
    return f"""
round{k} AS (SELECT l.word, sum(l.ppmi * s.polarity) / (sum(l.ppmi) + {X.SHRINKAGE!r}) AS polarity
             FROM links l JOIN round{k - 1} s ON s.word = l.other WHERE l.word NOT IN (SELECT word FROM seeds) GROUP BY l.word
             UNION ALL SELECT word, polarity FROM seeds)"""


@register("r2_propagation_round", roles=("reviews",), sql=f"""
WITH {_links_sql().strip()},{_round_sql(1)}
SELECT word, round(polarity, 4) AS polarity FROM round1
""")
def r2_propagation_round(spark, d):
    """One round of label propagation over the co-occurrence graph of all reviews."""
    rv = _ended(spark, d)
    seeds = X.seed_table(rv)
    return X.propagate(X.word_links(rv), seeds, seeds).select("word", r4("polarity").alias("polarity"))


@register("r2_induced_polarity", roles=("reviews",), sql=f"""
WITH {_links_sql().strip()},{_round_sql(1)},{_round_sql(2)},
hits AS (SELECT id, sum(s * n) / sum(n) AS sentiment FROM (
  SELECT id, polarity * CASE WHEN list_contains({_sql_list(R.NEGATIONS)}, p) THEN {R.NEGATION_FACTOR!r} ELSE 1 END AS s, count(*) AS n
  FROM (SELECT id, unnest(t) AS w, unnest(list_concat([''], t[1:len(t) - 1])) AS p FROM tk WHERE len(t) > 0)
  JOIN round2 ON round2.word = w GROUP BY id, w, p, polarity) GROUP BY id)
SELECT r.id, round(coalesce(sentiment, 0.0), 4) AS sentiment FROM rv r LEFT JOIN hits USING (id)
""")
def r2_induced_polarity(spark, d):
    """R-2 with the lexicon that two rounds induce from the reviews."""
    rv = _ended(spark, d)
    scored = R.polarity_by_table(rv, X.induce_lexicon(rv, rounds=2))
    return scored.select("id", r4("sentiment").alias("sentiment"))


# --- R-8 with learned profiles -----------------------------------------------------------------------------------------

HELD_OUT = 5  # reviews whose id it divides are not learned from

_PROFILE_SQL = f"""
words AS (SELECT id, lang, regexp_extract_all(lower(comments), '\p{{L}}+') AS t FROM reviews),
padded AS (SELECT id, lang, ' ' || array_to_string(t, ' ') || ' ' AS w FROM words WHERE len(t) > 0),
grams AS (SELECT id, lang, w[i:i + {N.SIZE - 1}] AS gram FROM (SELECT id, lang, w, unnest(range(1, length(w) - {N.SIZE - 2})) AS i FROM padded)),
counts AS (SELECT gram, lang, count(*) AS n FROM grams WHERE id % {HELD_OUT} <> 0 AND lang IS NOT NULL GROUP BY gram, lang),
texts AS (SELECT lang, count(*) AS texts FROM reviews WHERE id % {HELD_OUT} <> 0 AND lang IS NOT NULL GROUP BY lang),
languages AS (SELECT lang, ln(texts / (SELECT sum(texts) FROM texts)::DOUBLE) AS prior,
                     ln({N.SMOOTHING!r} / (total + {N.SMOOTHING!r} * (SELECT count(DISTINCT gram) FROM counts))) AS unseen
              FROM (SELECT lang, sum(n)::DOUBLE AS total FROM counts GROUP BY lang) JOIN texts USING (lang)),
gains AS (SELECT gram, lang, ln((n + {N.SMOOTHING!r}) / {N.SMOOTHING!r}) AS gain FROM counts),
own AS (SELECT id, gram, count(*) AS n FROM grams GROUP BY id, gram),
gained AS (SELECT id, g.lang, sum(o.n * g.gain) AS gain FROM own o JOIN gains g USING (gram) GROUP BY id, g.lang),
scores AS (SELECT s.id, l.lang, l.prior + s.n * l.unseen + coalesce(g.gain, 0) AS score
           FROM (SELECT id, sum(n) AS n FROM own GROUP BY id) s CROSS JOIN languages l LEFT JOIN gained g ON g.id = s.id AND g.lang = l.lang),
best AS (SELECT id, lang AS lang_pred FROM scores QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, lang) = 1),
profiled AS (SELECT r.id, r.lang, coalesce(b.lang_pred, 'en') AS lang_pred FROM reviews r LEFT JOIN best b USING (id))"""


def _profiled(spark, d):
    rv = roles.reviews(spark, d)
    profiles, languages = N.learn_profiles(rv.where(F.col("id") % HELD_OUT != 0))
    return N.tag_by_profiles(rv, profiles, languages)


@register("r8_profile_tags", roles=("reviews",), sql=f"""
WITH {_PROFILE_SQL.strip()}
SELECT id, lang_pred FROM profiled
""")
def r8_profile_tags(spark, d):
    """R-8 by character n-gram profiles, learned from the reviews whose id 5 does not divide."""
    return _profiled(spark, d).select("id", "lang_pred")


@register("r8_profile_accuracy", roles=("reviews",), sql=f"""
WITH {_PROFILE_SQL.strip()}, {_lang_sql().strip().replace("tk AS", "tk2 AS").replace("FROM tk)", "FROM tk2)")}
SELECT p.lang, count(*)::BIGINT AS n, count(CASE WHEN p.lang = p.lang_pred THEN 1 END)::BIGINT AS correct,
       count(CASE WHEN t.lang = t.lang_pred THEN 1 END)::BIGINT AS correct_by_stop_words
FROM profiled p JOIN tagged t USING (id) WHERE p.id % {HELD_OUT} = 0 GROUP BY p.lang
""")
def r8_profile_accuracy(spark, d):
    """On the reviews that were not learned from: right tags by profiles and by stop words, per language."""
    tagged = R.tag_languages(_profiled(spark, d).where(F.col("id") % HELD_OUT == 0), out="by_stop_words")
    return tagged.groupBy("lang").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("lang") == F.col("lang_pred"), 1)).alias("correct"),
        F.count(F.when(F.col("lang") == F.col("by_stop_words"), 1)).alias("correct_by_stop_words"))
