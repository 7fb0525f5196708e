"""Quality rules as a bitmask ledger: measure each text once, store measurements and failure bits, decide later.

``ledger`` measures every whole text in one Arrow pass and evaluates every rule once, as one bit of ``fail_bits``.
A policy is a version name and the rules it enforces, so keeping a document is one bitwise test, another policy needs no
second pass over the texts, and ``ablation`` counts what each rule decides from the few distinct masks.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staylens.llm.common import pick, slices

SYMBOLS = "#*$%&|<>"
WHITE = " \t\n\x0b\x0c\r"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_shouted", "longest_word")


def measure(text: str) -> tuple[int, ...]:
    """The measurements of one text, in the order of ``MEASURES``. Words are runs without ASCII white space."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()  # bytes split at exactly the ASCII white space
    triples = list(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(set(triples)) < len(triples):
        counts, covered_to = Counter(triples), 0
        for at, triple in enumerate(triples):
            if counts[triple] > 1:
                repeated += at + 3 - max(at, covered_to)
                covered_to = at + 3
    lines = [line for line in data.split(b"\n") if line.strip()]
    return (len(words), len(text) - sum(map(text.count, WHITE)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)),
            repeated, len(lines), sum(len(w) > 1 and w.isupper() for w in words), max(map(len, words), default=0))


@dataclass(frozen=True)
class Rule:
    """A rule fails a document where its SQL condition on the measurements holds."""

    name: str
    fails: str


# A rule's place is its bit, so rules are only ever added at the end. The first two are the base rules.
RULES = (
    Rule("too_few_words", "n_words < 50"),
    Rule("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbol_soup", "100 * n_symbols > 30 * n_words"),
    Rule("repeated_lines", "100 * n_dup_lines > 60 * n_lines"),
    Rule("shouting", "100 * n_shouted > 70 * n_words"),
    Rule("short_words", "word_chars < 2 * n_words"),
    Rule("long_words", "word_chars > 30 * n_words"),
    Rule("endless_word", "longest_word > 4000"),
)
BIT = {rule.name: 1 << k for k, rule in enumerate(RULES)}
BASE = ("too_few_words", "repeated_words")


def mask(*names: str) -> int:
    return sum(BIT[n] for n in names)


# Versioned policies: the rules whose failure rejects a document. A published version is never changed.
POLICIES = {
    "base": mask(*BASE),
    "v1": mask(*BASE, "symbol_soup", "repeated_lines", "shouting"),
    "v2": mask(*BASE, "symbol_soup", "repeated_lines", "shouting", "short_words", "long_words"),
}
CURRENT = "v2"


def fail_bits() -> Column:
    """Every rule's bit in one long, from the measurement columns."""
    return sum((F.when(F.expr(rule.fails), F.lit(BIT[rule.name])).otherwise(F.lit(0)) for rule in RULES),
               F.lit(0)).cast("long")


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, the measurements and ``fail_bits`` of every document.

    A null text counts as empty (no words, and so too few); null ids and repeated rows stay; an empty table gives an
    empty ledger; other columns are ignored.
    """
    names = ["doc_id", *MEASURES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            rows = [measure(t or "") for t in part["text"].to_pylist()]
            cols = list(zip(*rows)) or [()] * len(MEASURES)
            yield pa.RecordBatch.from_arrays([part["doc_id"], *(pa.array(c, pa.int64()) for c in cols)], names=names)

    source = pick(docs, doc_id=id_col, text=text_col).withColumn("text", F.col("text").cast("string"))
    kind = source.schema["doc_id"].dataType.simpleString()
    measured = source.mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{m} long" for m in MEASURES))
    return measured.withColumn("fail_bits", fail_bits())


def passes(policy: str = CURRENT) -> Column:
    """True where none of the policy's rules failed."""
    return F.col("fail_bits").bitwiseAND(F.lit(POLICIES[policy]).cast("long")) == 0


def apply_policy(rows: DataFrame, policy: str = CURRENT) -> DataFrame:
    """The ledger with ``base_failed`` and ``kept`` under a policy (a document that fails a base rule is never kept)."""
    return rows.withColumns({"base_failed": ~passes("base"), "kept": passes(policy) & passes("base")})


def ablation(rows: DataFrame, policy: str = CURRENT) -> DataFrame:
    """A row per rule of the policy: documents that it fails, that it alone rejects, and that would be kept without it.

    The ledger folds into one row per distinct mask, of which there are at most 2^rules, before anything else.
    """
    whole = POLICIES[policy]
    masks = rows.groupBy(F.col("fail_bits").bitwiseAND(F.lit(whole).cast("long")).alias("bits")).agg(
        F.count(F.lit(1)).alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(k).alias("bit"), F.lit(r.name).alias("rule"))
                                for k, r in enumerate(RULES) if whole & BIT[r.name]]))
    bit = F.expr("shiftleft(1L, rule.bit)")
    return masks.withColumn("rule", rules).groupBy(F.col("rule.bit").alias("bit"), F.col("rule.rule").alias("rule")).agg(
        F.sum(F.when(F.col("bits").bitwiseAND(bit) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("bits") == bit, F.col("n")).otherwise(0)).alias("n_only_this"),
        F.sum(F.when(F.col("bits").bitwiseAND(F.bitwise_not(bit)) == 0, F.col("n")).otherwise(0)).alias("n_kept_without"))


def keep_documents(docs: DataFrame, policy: str = CURRENT, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns whatever these are named. The ledger of a batch decides
    within the batch, so texts are neither shuffled nor joined."""
    rejects = POLICIES[policy] | POLICIES["base"]
    # The same conditions, over a tuple of measurements: they are plain comparisons in both languages.
    checks = [(BIT[r.name], compile(r.fails, r.name, "eval")) for r in RULES if BIT[r.name] & rejects]

    def ok(text: str | None) -> bool:
        values = dict(zip(MEASURES, measure(text or "")))
        return not any(eval(check, {}, values) for _, check in checks)  # noqa: S307  fixed expressions of this module

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text_col):
            yield part.filter(pa.array([ok(t) for t in part[text_col].to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
