"""Secret scan with corpus-wide ownership frequency, in DataFrame functions alone.

Patterns propose candidates in every whole text. How widely a candidate's value is spread over the corpus then tells
examples from credentials: a value that several owners hold, or that very many repositories of one owner hold, is a copied
example; one that stays with an owner and in few places looks live. A repository without an owner is its own owner. The exact base
spans are always reported; of the further candidates only live-looking ones are.

A match's place is the length of all texts between the matches before it and of these matches: a text is split by the
expression, and a running sum over its matches adds up both, so the work is linear in the text however many matches it has.
Values meet their counts by join: the counts of few values are broadcast, of many salted (``join_group_stats``), so a value in
a third of all texts is no hot key. Null repositories aren't counted.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from staylens.functions.semantics import join_group_stats
from staylens.llm.common import materialised


@dataclass(frozen=True)
class Kind:
    """An expression whose group ``value`` is the secret; matches with a value shorter than ``least`` are dropped."""

    name: str
    pattern: str
    value: int = 0
    least: int = 1


# Base kinds, in the order in which equal starts are listed. Runs are whole, so a least length of a run may stand in the
# expression: a shorter run fails wherever one begins in it. (In ``assign`` a failing match hides what it spans.)
BASE = (
    Kind("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Kind("access", r"AKIA[A-Z0-9]{16,}"),
    Kind("hex", r"[0-9a-f]{24,}"),
)
# Further candidates, kept where they look live.
ADDED = (
    Kind("vendor", r"gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35}"),
    Kind("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Kind("bearer", r"[Bb]earer\x20+([A-Za-z0-9._~+/-]{20,}=*)", 1),
)
# A value of so many owners, or in so many repositories of however few, is a copied example.
EXAMPLE_OWNERS = 3
EXAMPLE_REPOS = 100


def matches(text: Column, found: Column, kind: Kind) -> Column:
    """Array of (gap, length, value) of a kind's matches, given their texts ``found``: leftmost, not overlapping; ``gap`` is the
    text since the last one, in code points, and a match that is to be dropped has no value. Null where there is no match."""

    def one(gap: Column, match: Column) -> Column:
        value = F.regexp_extract(match, kind.pattern, kind.value) if kind.value else match
        return F.struct(F.length(gap).alias("gap"), F.length(match).alias("length"),
                        F.when(F.length(value) >= kind.least, value).alias("value"))

    # What follows the last match is left out; texts without a match aren't split.
    between = F.slice(F.split(text, kind.pattern, -1), F.lit(1), F.size(found))
    return F.when(F.size(found) > 0, F.zip_with(between, found, one))


def listed(spans: Column) -> Column:
    """kind:start:end of spans by start, then kind as listed, joined by commas."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def candidates(docs: DataFrame, id_col: str, text_col: str, repo_col: str, owner_col: str) -> DataFrame:
    """A narrow row per document: ids, a number, and an array of matches per kind."""
    source = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{repo_col}`").cast("string").alias("repo"),
                         F.col(f"`{owner_col}`").cast("string").alias("owner"),
                         F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    kinds = (*BASE, *ADDED)
    # The texts of the matches are columns of their own, so that each expression runs once over a text.
    found = source.select("*", *[F.regexp_extract_all("text", F.lit(k.pattern), F.lit(0)).alias(f"_{k.name}") for k in kinds])
    return found.select("doc_id", "repo", "owner", F.monotonically_increasing_id().alias("row"),
                        *[matches(F.col("text"), F.col(f"_{k.name}"), k).alias(k.name) for k in kinds])


def spans_of(held: DataFrame) -> DataFrame:
    """``row, repo, owner, start, order, end, kind, value`` of every match with a value."""
    kinds = (*BASE, *ADDED)
    rows = None
    for order, k in enumerate(kinds):
        part = held.where(F.size(k.name) > 0).select("row", "repo", "owner", F.lit(order).alias("order"), F.lit(k.name).alias("kind"),
                                                     F.posexplode(k.name).alias("at", "m"))
        rows = part if rows is None else rows.unionByName(part)
    upto = Window.partitionBy("row", "order").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("m.gap") + F.col("m.length")).over(upto)
    return rows.withColumn("end", end.cast("int")).where(F.col("m.value").isNotNull()).select(
        "row", "repo", "owner", (F.col("end") - F.col("m.length")).alias("start"), "order", "end", "kind", F.col("m.value").alias("value"))


def ownership(rows: DataFrame) -> DataFrame:
    """``hash, n_repos, n_owners`` of every candidate value; copies in one repository count once, and a repository
    without an owner is its own. Distinct counts are aggregated within each task before any shuffle."""
    owner = F.when(F.col("owner").isNotNull(), F.concat(F.lit("o:"), "owner")).otherwise(F.concat(F.lit("r:"), "repo"))
    return rows.groupBy("hash").agg(F.count_distinct("repo").alias("n_repos"), F.count_distinct(owner).alias("n_owners"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "doc_id",
         owner_col: str = "source", example_owners: int = EXAMPLE_OWNERS, example_repos: int = EXAMPLE_REPOS) -> DataFrame:
    """``doc_id``, base counts, ``base_sha256``, ``spans``, how many of the values look live or are examples, and the
    repositories and owners of the most widely spread of its values.

    In the documents table a document stands for a repository and its source for the owner. A null text counts as empty;
    null ids and repeated rows stay; an empty table gives an empty result; other columns are ignored.
    """
    held = materialised(candidates(docs, id_col, text_col, repo_col, owner_col))
    one = materialised(spans_of(held).withColumn("hash", F.sha2("value", 256)).drop("value"))
    live = (F.col("n_owners") < example_owners) & (F.col("n_repos") < example_repos)
    judged = join_group_stats(one, ownership(one), ["hash"]).withColumn("live", live)
    span = F.struct("start", "order", "end", "kind")
    base = F.col("order") < len(BASE)
    per = judged.groupBy("row").agg(
        F.collect_list(F.when(base, span)).alias("base"), F.collect_list(F.when(base | F.col("live"), span)).alias("all"),
        *[F.count_if(F.col("order") == k).alias(f"n_{x.name}") for k, x in enumerate(BASE)],
        F.count_if("live").alias("n_live"), F.count_if(~F.col("live")).alias("n_example"),
        F.max("n_repos").alias("n_repos"), F.max("n_owners").alias("n_owners"))
    shown = per.select("row", *[f"n_{x.name}" for x in BASE], F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
                       listed(F.col("all")).alias("spans"), "n_live", "n_example", "n_repos", "n_owners")
    counts = [*[f"n_{x.name}" for x in BASE], "n_live", "n_example", "n_repos", "n_owners"]
    none = F.sha2(F.lit(""), 256)
    return held.select("doc_id", "row").join(shown, "row", "left").select(
        "doc_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts],
        F.coalesce("base_sha256", none).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"))
