"""Language tags from learned profiles (R-8): character n-grams scored as naive Bayes.

``learn_profiles`` counts the n-grams of words (padded by a space on both sides) per language over all labelled texts, with
additive smoothing over the n-grams met; any number of languages. ``tag_by_profiles`` explodes a text's n-grams, looks each one up in the
profile table and adds up log probabilities per text and language. What every n-gram would cost if a language had never met it is
added once per text, so only n-grams that some language knows are looked up. A text's rows are added up before the shuffle, which moves one row
per text, language and task. The profile table is broadcast after its rows are counted, and salted beyond ``PROFILE_ROWS``.

Texts that are null or have no letters get ``default``; equal scores go to the first language by name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staylens.functions.semantics import checkpointed

SIZE = 3
SMOOTHING = 0.5
PROFILE_ROWS = 300_000  # profile rows that are broadcast, some tens of bytes each
SALTS = 32
MOST_COLUMNS = 64  # languages that are columns of the profile table
WORD_PATTERN = r"\p{L}+"


def _exploded(df: DataFrame, text: str, size: int, key: F.Column) -> DataFrame:
    """A row per n-gram of a text's words in lower case, which stand between single spaces, under the row's key."""
    # The joined words are a column of their own, so that they are computed once and not per n-gram.
    words = F.array_join(F.regexp_extract_all(F.lower(F.col(text)), F.lit(WORD_PATTERN), 0), " ")
    padded = df.select(key, F.concat(F.lit(" "), words, F.lit(" ")).alias("_w")).where(F.length("_w") >= size)
    name = padded.columns[0]
    # Cut in one linear pass: a substring by place would count characters from the start each time.
    chars = F.split("_w", "")
    held = padded.select(name, chars.alias("_c"))
    shifted = [F.slice("_c", F.lit(j + 1), F.size("_c") - (size - 1)) for j in range(size)]
    return held.select(name, F.explode(F.arrays_zip(*[c.alias(f"c{j}") for j, c in enumerate(shifted)])).alias("_g")).select(
        name, F.concat(*[F.col(f"_g.c{j}") for j in range(size)]).alias("gram"))


def learn_profiles(labelled: DataFrame, text: str = "comments", lang: str = "lang", size: int = SIZE,
                   smoothing: float = SMOOTHING) -> tuple[DataFrame, DataFrame]:
    """(profiles, languages): ``gram, lang, gain`` (log probability above that of an unseen n-gram) and ``lang, prior, unseen``."""
    source = labelled.where(F.col(lang).isNotNull())
    counts = checkpointed(_exploded(source, text, size, F.col(lang).alias("lang")).groupBy("gram", "lang").agg(F.count(F.lit(1)).alias("n")))
    kinds = counts.select("gram").distinct().agg(F.count(F.lit(1)).alias("kinds"))
    texts = source.groupBy(F.col(lang).alias("lang")).agg(F.count(F.lit(1)).alias("texts"))
    all_texts = texts.agg(F.sum("texts").alias("all_texts"))
    per = counts.groupBy("lang").agg(F.sum("n").alias("total")).join(texts, "lang").crossJoin(F.broadcast(kinds)).crossJoin(F.broadcast(all_texts))
    languages = checkpointed(per.select("lang", F.log(F.col("texts") / F.col("all_texts")).alias("prior"),
                                        F.log(F.lit(smoothing) / (F.col("total") + smoothing * F.col("kinds"))).alias("unseen")))
    profiles = checkpointed(counts.select("gram", "lang", F.log((F.col("n") + smoothing) / F.lit(smoothing)).alias("gain")))
    return profiles, languages


def tag_by_profiles(df: DataFrame, profiles: DataFrame, languages: DataFrame, text: str = "comments", id_col: str = "id",
                    out: str = "lang_pred", size: int = SIZE, default: str = "en") -> DataFrame:
    """``df`` with the likeliest language of each text (ids are unique)."""
    rows = _exploded(df, text, size, F.col(id_col).alias("_id"))
    known = [r.lang for r in languages.select("lang").distinct().orderBy("lang").limit(MOST_COLUMNS + 1).collect()]
    few = 0 < len(known) <= MOST_COLUMNS
    # All languages of an n-gram travel in one row, so a text's n-grams are not multiplied before the lookup; a few are columns,
    # so that they are not multiplied after it either and the texts are read once.
    gains = [F.sum(F.when(F.col("lang") == x, F.col("gain"))).alias(f"_g{i}") for i, x in enumerate(known)]
    wide = checkpointed(profiles.groupBy("gram").agg(*(gains if few else [F.collect_list(F.struct("lang", "gain")).alias("gains")])))
    if wide.count() <= PROFILE_ROWS:
        met = rows.join(F.broadcast(wide), "gram", "left")
    else:
        each = wide.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
        met = rows.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")).join(each, ["gram", "_salt"], "left")
    if few:
        sums = met.groupBy("_id").agg(F.count(F.lit(1)).alias("_n"), *[F.sum(f"_g{i}").alias(f"_g{i}") for i in range(len(known))])
        of = {r.lang: (r.prior, r.unseen) for r in languages.collect()}
        costs = [F.struct((-(F.lit(of[x][0]) + F.col("_n") * F.lit(of[x][1]) + F.coalesce(f"_g{i}", F.lit(0.0)))).alias("cost"),
                          F.lit(x).alias("lang")) for i, x in enumerate(known)]
        best = sums.select("_id", F.array_min(F.array(*costs)).alias("best"))
    else:
        length = met.groupBy("_id").agg(F.count(F.lit(1)).alias("_n"))
        gained = met.select("_id", F.explode("gains").alias("g")).groupBy("_id", F.col("g.lang").alias("lang")).agg(F.sum("g.gain").alias("gain"))
        # One row per language is bounded by the labels.
        scores = length.crossJoin(F.broadcast(languages)).join(gained, ["_id", "lang"], "left").select(
            "_id", "lang", (F.col("prior") + F.col("_n") * F.col("unseen") + F.coalesce("gain", F.lit(0.0))).alias("score"))
        best = scores.groupBy("_id").agg(F.min(F.struct((-F.col("score")).alias("cost"), F.col("lang").alias("lang"))).alias("best"))
    return df.join(best.select("_id", F.col("best.lang").alias("_lang")), F.col(id_col) == F.col("_id"), "left").withColumn(
        out, F.coalesce("_lang", F.lit(default))).drop("_id", "_lang")
