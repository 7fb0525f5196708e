"""An opinion lexicon induced from the reviews themselves (R-2): co-occurrence graph and label propagation.

Words that stand within a few places of each other are linked; a link weighs its positive pointwise mutual information,
so words that are merely frequent link weakly. Polarity then spreads from a few graded seed words along the links: in each
round a word takes the weighted mean of its scored neighbours, shrunk towards zero while their weight is small, and seeds keep their
grade. Every step is a join and a grouped sum over links, pre-aggregated before the shuffle. Words are numbers on the way; pairs are counted
in the tasks that read the texts and handed on in compressed tiles (``words``), a pair is stored once with its count, and links are
derived from the counts in every round rather than stored. Word tables are sent to the tasks; only beyond ``MOST_WORDS`` words are pairs shuffled by word.

Each token meets the next ``window`` tokens only, so the work is linear in the text and a long review is no pair explosion.
Words in fewer than ``min_reviews`` reviews get no score: too little is known of them. Null texts have no words.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from staylens.functions.semantics import checkpointed, with_scalars
from staylens.operators import words as W
from staylens.operators.sentiment import BROADCAST_WORDS, DEFAULT_LEXICON, tokens
from staylens.session import ensure_checkpoint_dir

WINDOW = 4
MIN_REVIEWS = 5
SHRINKAGE = 1.0
ROUNDS = 3


BROADCAST_NUMBERS = 3 * BROADCAST_WORDS  # rows of two numbers each, a third of a row with a word


def _placed(rows: DataFrame, table: DataFrame, keys: list[str], count: int, most: int | None = None) -> DataFrame:
    """``rows`` joined to a table of one row a word. A large table is dealt by key: a word has at most a row for every other word."""
    return rows.join(F.broadcast(table) if count <= (most or BROADCAST_WORDS) else table, keys)


def _numbered(words: DataFrame) -> DataFrame:
    """Words numbered from 0 on without a gap."""
    placed = checkpointed(words.withColumn("_id", F.monotonically_increasing_id()))
    task = F.shiftright("_id", 33)
    sizes = placed.groupBy(task.alias("task")).count().orderBy("task").collect()  # a row a task
    before, n = [], 0
    for r in sizes:
        before.append(F.struct(F.lit(r["task"]).cast("long").alias("_task"), F.lit(n).cast("long").alias("_before")))
        n += r["count"]
    if not before:
        return placed.withColumnRenamed("_id", "id")
    starts = placed.sparkSession.range(1).select(F.inline(F.array(*before)))
    return checkpointed(placed.join(F.broadcast(starts), task == F.col("_task")).select(
        *words.columns, (F.col("_before") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).alias("id")))


def pair_counts(reviews: DataFrame, text: str = "comments", window: int = WINDOW,
                min_reviews: int = MIN_REVIEWS) -> tuple[DataFrame, DataFrame, int]:
    """(``word, id`` of the words in at least ``min_reviews`` reviews; ``a, b, n``: how often two of them, by id, are near each
    other, each pair once; the number of words). Words become numbers, and rare ones leave, before the counts are shuffled; the
    counts are kept as columns."""
    spark = reviews.sparkSession
    tokenised = reviews.select(tokens(text).alias("_t"))
    known = tokenised.select(F.explode(F.array_distinct("_t")).alias("word")).groupBy("word").agg(
        F.count(F.lit(1)).alias("_in")).where(F.col("_in") >= min_reviews)
    known = _numbered(known)
    words, hits = known.agg(F.count(F.lit(1)), F.coalesce(F.sum("_in"), F.lit(0))).first()
    known = known.select("word", "id")
    path = f"{ensure_checkpoint_dir(spark)}/word-pairs-{uuid.uuid4().hex}"
    if words > W.MOST_WORDS:
        _joined_counts(tokenised, known, words, window).write.parquet(path)
    else:
        table = known.toArrow()
        table, tiles = spark.sparkContext.broadcast(W.word_table(table["word"], table["id"])), W.Tiles.of(words, window * hits)
        parts = tokenised.mapInArrow(lambda batches: W.counted(batches, table.value, tiles, window), W.PARTS)
        counts = parts.repartition("tile").sortWithinPartitions("tile").mapInArrow(lambda batches: W.added(batches, tiles), "a int, b int, n long")
        counts.write.option("compression", "zstd").parquet(path)
        table.destroy()
    return known, spark.read.parquet(path).select(F.col("a").cast("long"), F.col("b").cast("long"), "n"), words


def _joined_counts(tokenised: DataFrame, known: DataFrame, words: int, window: int) -> DataFrame:
    """The counts of more words than a task can look up: pairs of words are counted first and joined to their numbers."""
    t = F.col("_t")
    near = []
    for j in range(1, window + 1):
        n = F.greatest(F.size(t) - j, F.lit(0))
        near.append(F.arrays_zip(F.slice(t, F.lit(1), n).alias("v"), F.slice(t, F.lit(j + 1), n).alias("w")))
    pairs = tokenised.select(F.explode(F.concat(*near)).alias("p")).select("p.v", "p.w").where(F.col("v") != F.col("w"))
    pairs = pairs.groupBy(F.least("v", "w").alias("v"), F.greatest("v", "w").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    placed = _placed(_placed(pairs, known.toDF("v", "a"), ["v"], words), known.toDF("w", "b"), ["w"], words)
    return placed.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("n").alias("n"))


def pair_links(pairs: DataFrame, words: int) -> DataFrame:
    """``word, other, ppmi`` by id, in both directions, from ``pair_counts``: nothing but the counts per word is stored."""
    def ends(a, b):
        return F.struct(F.col(a).alias("word"), F.col(b).alias("other"))

    both = F.explode(F.array(ends("a", "b"), ends("b", "a")))
    of_word = checkpointed(pairs.select(both.alias("e"), "n").groupBy(F.col("e.word").alias("word")).agg(F.sum("n").alias("n_word")))
    total = of_word.agg(F.sum("n_word").alias("total"))
    weighed = _placed(_placed(pairs, of_word.toDF("a", "n_a"), ["a"], words, BROADCAST_NUMBERS), of_word.toDF("b", "n_b"), ["b"], words,
                      BROADCAST_NUMBERS)
    info = F.log(F.col("n").cast("double") * F.col("total") / (F.col("n_a").cast("double") * F.col("n_b")))
    return with_scalars(weighed, total).select("a", "b", info.alias("ppmi")).where(F.col("ppmi") > 0).select(
        both.alias("e"), "ppmi").select("e.word", "e.other", "ppmi")


def word_links(reviews: DataFrame, text: str = "comments", window: int = WINDOW, min_reviews: int = MIN_REVIEWS) -> DataFrame:
    """``word, other, ppmi`` in both directions, for words in at least ``min_reviews`` reviews and positive information."""
    known, pairs, words = pair_counts(reviews, text, window, min_reviews)
    links = pair_links(pairs, words).toDF("_word", "_other", "ppmi")
    if BROADCAST_WORDS < words <= W.MOST_WORDS:
        table = known.toArrow()
        names = reviews.sparkSession.sparkContext.broadcast(table["word"].combine_chunks().take(pa.array(np.argsort(table["id"].to_numpy()))))
        return links.mapInArrow(lambda batches: W.named(batches, names.value), "word string, other string, ppmi double")
    named = _placed(_placed(links, known.toDF("word", "_word"), ["_word"], words), known.toDF("other", "_other"), ["_other"], words)
    return named.select("word", "other", "ppmi")


def seed_table(reviews: DataFrame, seeds: Mapping[str, float] | None = None) -> DataFrame:
    return reviews.sparkSession.createDataFrame(sorted((seeds or DEFAULT_LEXICON).items()), "word string, polarity double")


def propagate(links: DataFrame, scores: DataFrame, seeds: DataFrame, shrinkage: float = SHRINKAGE) -> DataFrame:
    """One round: every linked word takes the shrunk weighted mean of its scored neighbours; seeds keep their polarity."""
    of_other = checkpointed(scores.select(F.col("word").alias("other"), "polarity"))
    most = BROADCAST_NUMBERS if of_other.schema["other"].dataType == T.LongType() else BROADCAST_WORDS
    near = _placed(links, of_other, ["other"], of_other.count(), most)
    mean = near.groupBy("word").agg((F.sum(F.col("ppmi") * F.col("polarity")) / (F.sum("ppmi") + shrinkage)).alias("polarity"))
    return mean.join(seeds.select("word"), "word", "left_anti").unionByName(seeds)


def induce_lexicon(reviews: DataFrame, text: str = "comments", seeds: Mapping[str, float] | None = None, rounds: int = ROUNDS,
                   window: int = WINDOW, min_reviews: int = MIN_REVIEWS, shrinkage: float = SHRINKAGE) -> DataFrame:
    """``word, polarity``: the seeds and every word that ``rounds`` rounds reach, for ``sentiment.polarity_by_table``."""
    known, pairs, words = pair_counts(reviews, text, window, min_reviews)
    links = pair_links(pairs, words)
    given = checkpointed(seed_table(reviews, seeds))
    of_id = checkpointed(known.join(F.broadcast(given), "word").select(F.col("id").alias("word"), "polarity"))
    scores = of_id
    for _ in range(rounds):
        scores = checkpointed(propagate(links, scores, of_id, shrinkage))
    found = scores.withColumnRenamed("word", "id").join(known, "id").select("word", "polarity")
    return checkpointed(found.join(F.broadcast(given.select("word")), "word", "left_anti").unionByName(given))


def scored_share(scored: DataFrame, score: str = "sentiment") -> DataFrame:
    """One row: reviews, those with a score other than zero, and their share."""
    hit = F.count(F.when(F.col(score) != 0, 1))
    return scored.agg(F.count(F.lit(1)).alias("reviews"), hit.alias("scored"), (hit / F.count(F.lit(1))).alias("share"))
