"""Review sentiment and language tags (R-1 .. R-8), scored row by row with native array expressions.

Polarity is lexicon-based: the text is tokenised with a regex, each token found in the lexicon contributes its
polarity (flipped and halved when the previous token is a negation), and a review's polarity is the mean over
its matched tokens, 0.0 when none match. A lexicon given as a mapping travels inside the expression, and scoring
needs no explode, join or shuffle; one given as a table, of any size, is joined to the tokens. Language tags count
stop words of each language over the whole text.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from staylens.functions.semantics import checkpointed, col_of, cut, hash_sample
from staylens.operators import words as W

TOKEN_PATTERN = r"[\p{L}']+"
NEGATION_FACTOR = -0.5
BROADCAST_WORDS = 1_000_000  # rows of a word table that are broadcast, some tens of bytes each

# A small English opinion lexicon (fixed values): every word has one of seven grades, given by this library.
_GRADES = {
    1.0: "excellent perfect wonderful superb best",
    0.8: "great amazing beautiful love loved",
    0.7: "good lovely happy",
    0.4: "nice clean comfortable friendly helpful better well easy quiet spacious convenient recommend fine cozy",
    -0.4: "small noisy hard cold old expensive worse",
    -0.7: "bad poor dirty rude broken disappointing disappointed uncomfortable smelly wrong sad",
    -1.0: "terrible awful horrible worst filthy",
}
DEFAULT_LEXICON = {w: grade for grade, words in _GRADES.items() for w in words.split()}

# Words that flip the next word's polarity (fixed values).
NEGATIONS = ["not", "no", "never", "n't", "don't", "didn't", "wasn't", "isn't", "aren't", "cannot", "can't"]

# Sentiment bands (fixed values): [-1,-0.1] Negative, (-0.1,0.1] Neutral, (0.1,1] Positive.
SENTIMENT_EDGES = [-1.0, -0.1, 0.1, 1.0]
SENTIMENT_LABELS = ["Negative", "Neutral", "Positive"]

# Stop words per language for tagging (fixed values; the first language wins ties, the default is "en").
STOP_WORDS = {
    "en": ["the", "of", "and", "to", "in", "is", "that", "it", "for", "was", "on", "with", "as", "by", "this", "are",
           "at", "from", "an", "be"],
    "fr": ["le", "la", "les", "des", "du", "et", "un", "une", "que", "qui", "dans", "pour", "avec", "sur", "au",
           "par", "est", "pas", "ce", "en"],
    "de": ["der", "die", "das", "und", "den", "von", "zu", "mit", "sich", "auf", "ist", "nicht", "ein", "eine",
           "dem", "des", "im", "für", "auch", "es"],
    "es": ["el", "la", "los", "las", "de", "que", "y", "en", "del", "por", "con", "una", "un", "para", "es", "se",
           "al", "lo", "como", "su"],
}


def tokens(c) -> F.Column:
    return F.regexp_extract_all(F.lower(col_of(c)), F.lit(TOKEN_PATTERN), 0)


def token_scores(t: F.Column, lexicon: Mapping[str, float] | None = None, negations: Sequence[str] = NEGATIONS) -> F.Column:
    """The polarities of the tokens that the lexicon holds, each turned by a negation right before it."""
    lex = dict(lexicon or DEFAULT_LEXICON)
    lex_map = F.map_from_arrays(F.array(*[F.lit(k) for k in lex]).cast("array<string>"),
                                F.array(*[F.lit(float(v)) for v in lex.values()]).cast("array<double>"))
    negs = F.array(*[F.lit(w) for w in negations])
    # Pair each token with its predecessor ("" before the first): one linear pass, no per-index lookups.
    prev = F.concat(F.array(F.lit("")), t)

    def score(x):
        v = F.try_element_at(lex_map, x["w"])
        return F.when(F.array_contains(negs, x["p"]), v * NEGATION_FACTOR).otherwise(v)

    # A map literal is searched from its start, a membership test is one hash lookup: most tokens end there.
    pairs = F.zip_with(t, prev, lambda w, p: F.struct(w.alias("w"), p.alias("p")))
    return F.transform(F.filter(pairs, lambda x: x["w"].isin(list(lex))), score)


def mean_score(scores: F.Column) -> F.Column:
    total = F.aggregate(scores, F.lit(0.0), lambda a, s: a + s)
    return F.when(F.size(scores) > 0, total / F.size(scores)).otherwise(F.lit(0.0))


def polarity(text, lexicon: Mapping[str, float] | None = None, negations: Sequence[str] = NEGATIONS) -> F.Column:
    """R-2: mean lexicon polarity of a text's tokens (negation-aware), 0.0 when no token matches or the text is
    null."""
    return mean_score(token_scores(tokens(text), lexicon, negations))


def polarity_by_table(reviews: DataFrame, lexicon: DataFrame, text: str = "comments", id_col: str = "id",
                      word: str = "word", score: str = "polarity", negations: Sequence[str] = NEGATIONS) -> DataFrame:
    """R-2 with a lexicon table of any size: ``id``, ``sentiment`` of every review (ids are unique).

    A lexicon of up to ``BROADCAST_WORDS`` words is broadcast, and one of up to ``MOST_WORDS`` is looked up by Python, so one row per review and
    task is shuffled. For a larger one, tokens are counted per review before the join, so a frequent word is one row per review. A word
    listed twice counts with its smallest score."""
    t = tokens(text)
    lex = checkpointed(lexicon.where(F.col(word).isNotNull() & F.col(score).isNotNull()).groupBy(F.col(word).alias("_w")).agg(
        F.min(F.col(score).cast("double")).alias("_s")))
    count = lex.count()
    if BROADCAST_WORDS < count <= W.MOST_WORDS:
        table = lex.toArrow()
        table, factor, turning = reviews.sparkSession.sparkContext.broadcast(W.word_table(table["_w"], table["_s"])), NEGATION_FACTOR, frozenset(negations)
        texts = reviews.select(F.col(id_col).alias("_id"), t.alias("_t"))
        schema = T.StructType([texts.schema["_id"], T.StructField("_sum", T.DoubleType()), T.StructField("_n", T.LongType())])
        one = texts.mapInArrow(lambda batches: W.scored(batches, table.value, turning, factor), schema)
        hits = one.groupBy("_id").agg((F.sum("_sum") / F.sum("_n")).alias("_mean"))
    else:
        pair = F.explode(F.arrays_zip(t.alias("w"), F.concat(F.array(F.lit("")), t).alias("p")))
        one = reviews.select(F.col(id_col).alias("_id"), pair.alias("x")).where(F.col("x.w").isNotNull()).select(
            "_id", F.col("x.w").alias("_w"), F.col("x.p").isin(list(negations)).alias("_neg"), F.lit(1).alias("_n"))
        if count <= BROADCAST_WORDS:
            lex = F.broadcast(lex)
        else:
            one = one.groupBy("_id", "_w", "_neg").agg(F.sum("_n").alias("_n"))
        sign = F.when(F.col("_neg"), F.lit(NEGATION_FACTOR)).otherwise(F.lit(1.0))
        hits = one.join(lex, "_w").groupBy("_id").agg(
            (F.sum(F.col("_s") * sign * F.col("_n")) / F.sum("_n")).alias("_mean"))
    return reviews.select(F.col(id_col).alias("id")).join(hits, F.col("id") == F.col("_id"), "left").select(
        "id", F.coalesce("_mean", F.lit(0.0)).alias("sentiment"))


def sentiment_label(c, compat: bool = False) -> F.Column:
    """R-3: band of a polarity. By default -1.0 is Negative; ``compat=True`` leaves it null as the open lower edge
    of ``pd.cut`` does."""
    return cut(c, SENTIMENT_EDGES, SENTIMENT_LABELS, include_lowest=not compat)


def reviews_for_listings(reviews: DataFrame, listings: DataFrame, cap: int | None = None,
                         seed: int = 42) -> DataFrame:
    """R-1: all reviews of the given listings (semi join; ids never collected), or on request an exact-n seeded
    sample of ``cap`` of them."""
    r = reviews.join(listings.select(F.col("id").alias("listing_id")), "listing_id", "left_semi")
    return hash_sample(r, cap, "id", seed) if cap else r


def score_reviews(reviews: DataFrame, text: str = "comments", lexicon=None, compat: bool = False) -> DataFrame:
    """R-2 + R-3: add ``sentiment`` and ``sentiment_label``. Tokens and scores are generated rather than projected: a filter on the label
    or polarity would be pushed below a projection and score the text again wherever it names them."""
    return (reviews.select("*", F.explode(F.array(tokens(text))).alias("_tokens"))
            .select("*", F.explode(F.array(token_scores(F.col("_tokens"), lexicon))).alias("_scores"))
            .withColumn("sentiment", mean_score(F.col("_scores"))).drop("_tokens", "_scores")
            .withColumn("sentiment_label", sentiment_label("sentiment", compat)))


def sentiment_kpis(scored: DataFrame) -> DataFrame:
    """R-4: reviews scored, mean polarity, % with polarity above zero."""
    return scored.agg(F.count(F.lit(1)).alias("reviews"), F.avg("sentiment").alias("avg_sentiment"),
                      (F.avg((F.col("sentiment") > 0).cast("double")) * 100).alias("pct_positive"))


def label_counts(scored: DataFrame) -> DataFrame:
    """R-5: reviews per label (unlabelled ones dropped)."""
    return scored.where(F.col("sentiment_label").isNotNull()).groupBy("sentiment_label").agg(
        F.count(F.lit(1)).alias("count"))


def extremes(scored: DataFrame, n: int = 5, id_col: str = "id") -> DataFrame:
    """R-7: the n most positive reviews among Positive ones and the n most negative among Negative ones."""
    label = F.col("sentiment_label")
    kind = F.when(label == "Positive", "most_positive").when(label == "Negative", "most_negative")
    # One pass for both: every task keeps n rows a kind before any is shuffled.
    strength = F.when(label == "Positive", -F.col("sentiment")).otherwise(F.col("sentiment"))
    ranked = scored.where(label.isin("Positive", "Negative")).withColumns({"kind": kind, "_strength": strength})
    place = Window.partitionBy("kind").orderBy("_strength", F.col(id_col))
    best = ranked.withColumn("_place", F.row_number().over(place)).where(F.col("_place") <= n)
    return best.orderBy(F.col("kind").desc(), "_place").drop("_strength", "_place")


def _stop_word_codes(stop_words: Mapping[str, Sequence[str]]) -> F.Column:
    """Map literal word -> bit mask of the languages whose stop-word list holds it."""
    codes: dict[str, int] = {}
    for i, ws in enumerate(stop_words.values()):
        for w in ws:
            codes[w] = codes.get(w, 0) | (1 << i)
    return F.map_from_arrays(F.array(*[F.lit(w) for w in codes]).cast("array<string>"),
                             F.array(*[F.lit(v) for v in codes.values()]).cast("array<int>"))


def _pick_language(codes: F.Column, langs: Sequence[str], default: str) -> F.Column:
    def count(bit):
        return F.size(F.filter(codes, lambda x: x.bitwiseAND(F.lit(bit)) != 0))

    counts = [count(1 << i) for i in range(len(langs))]
    best = F.greatest(*counts) if len(counts) > 1 else counts[0]
    expr = F.when(best == 0, F.lit(default))
    for lang, c in zip(langs, counts):
        expr = expr.when(c == best, F.lit(lang))
    return expr


def language_tag(text, stop_words: Mapping[str, Sequence[str]] = STOP_WORDS, default: str = "en") -> F.Column:
    """R-8: the language whose stop words occur most often in the whole text (ties: first listed; none: default).
    Each token costs one map lookup; the per-language counts then run over the (short) stop-word hits."""
    m = _stop_word_codes(stop_words)
    hits = F.filter(F.transform(tokens(text), lambda w: F.try_element_at(m, w)), lambda x: x.isNotNull())
    return _pick_language(hits, list(stop_words), default)


def tag_languages(df: DataFrame, text: str = "comments", out: str = "lang_pred",
                  stop_words: Mapping[str, Sequence[str]] = STOP_WORDS, default: str = "en") -> DataFrame:
    """R-8 on a frame: the stop-word hits are computed once per row as their own column (the optimizer keeps a
    costly expression that is used several times in its own projection), then counted per language."""
    m = _stop_word_codes(stop_words)
    hits = F.filter(F.transform(tokens(text), lambda w: F.try_element_at(m, w)), lambda x: x.isNotNull())
    return (df.withColumn("_sw", hits).withColumn(out, _pick_language(F.col("_sw"), list(stop_words), default))
            .drop("_sw"))


def language_accuracy(tagged: DataFrame, truth: str = "lang", pred: str = "lang_pred") -> DataFrame:
    """Tagging quality against a known language column: rows and correct tags per true language."""
    return tagged.groupBy(truth).agg(F.count(F.lit(1)).alias("n"),
                                     F.count(F.when(F.col(truth) == F.col(pred), 1)).alias("correct"))
