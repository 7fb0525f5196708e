"""Personal data by candidate gradient boosting.

1. Exact base spans: emails, IPv4 addresses, card and phone numbers by their patterns and checks.
2. High-recall generators propose further spans, overlapping ones too: from the start of any group of digits to the end of
   any later one that are joined by separators and hold 7 to 24 digits, and emails written with words for the signs.
3. Every candidate gets features of its format and of the text around it. Boosted trees learn from the corpus and from
   rule-made sentences with spelt emails, numbers without plus and harmless ones. In the corpus a candidate is a positive
   example where it is a base span (shown without the plus sign that gives phones away), a negative one where it
   overlaps one otherwise or is a bare number without a cue, and else unlabelled. Feature rows are grouped first, so copies of a
   text are one row with a weight. All of them are learned from: the driver fits up to ``DRIVER_ROWS``, Spark jobs fit more.
4. A threshold calibrated on rows kept out of training selects the candidates that are added to the base spans; of those
   that overlap, the likeliest one (ties: the longer, then the earlier).
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staylens.llm.boosting import BoostedTrees, calibrated_threshold, threshold_of_rows
from staylens.llm.common import materialised, pick, slices

KINDS = ("email", "ip", "card", "phone")
ADDED = "likely"  # kind of the spans that the classifier adds
DRIVER_ROWS = 20_000
ROWS_A_TASK = 50_000  # of a fit by Spark jobs
PRECISION = 0.995
RULE_MADE = 400  # sentences

LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# Every ip, card and phone match lies within one such run, as all their characters are in it.
RUN = re.compile(r"[0-9+][0-9+\x20().-]*")
# A match can't begin within a run of digits whose start fails, so starts after a digit are skipped.
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
SPELT_EMAIL = re.compile(
    r"[A-Za-z0-9._%+-]+\s?(?:\(at\)|\[at\]|\{at\})\s?[A-Za-z0-9-]+(?:\s?(?:\(dot\)|\[dot\]|\{dot\}|\.)\s?[A-Za-z0-9-]+)+", re.I)
CUES = re.compile(r"phone|call|tel|mobile|fax|card|visa|account|contact|ssn|iban|email|mail", re.I)
LEAST_DIGITS, MOST_DIGITS = 7, 24
DIGITS = re.compile("[0-9]+")
FEATURES = 21


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def only_digits(s: str) -> str:
    return "".join([c for c in s if "0" <= c <= "9"])


def emails(text: str) -> list[tuple[int, int]]:
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        domain = DOMAIN.match(text, at + 1)
        start = at
        if domain:
            while start > last and text[start - 1] in LOCAL:
                start -= 1
        if start < at:
            last = domain.end()
            out.append((start, last))
        at = text.find("@", max(at + 1, last))
    return out


def base_spans(text: str) -> tuple[dict[str, list[tuple[int, int]]], list[tuple[int, int]]]:
    """Base spans by kind, and every span of digit groups within a run that holds 7 to 24 digits."""
    found: dict[str, list[tuple[int, int]]] = {kind: [] for kind in KINDS}
    if "@" in text:
        found["email"] = emails(text)
    runs = []
    for run in RUN.finditer(text):
        part, at = run[0], run.start()
        if len(part) < 7:
            continue
        if part.count(".") >= 3:
            found["ip"] += [(at + m.start(), at + m.end()) for m in IP.finditer(part)
                            if all(int(x[-4:]) <= 255 and len(x.lstrip("0")) <= 3 for x in m[0].split("."))]
        digits = only_digits(part)
        if len(digits) >= 13:
            for m in CARD.finditer(part):
                number = only_digits(m[0])
                if 13 <= len(number) <= 19 and luhn(number):
                    found["card"].append((at + m.start(), at + m.end()))
        if "+" in part and len(digits) >= 9:
            found["phone"] += [(at + m.start(), at + m.end()) for m in PHONE.finditer(part)
                               if 9 <= len(only_digits(m[0])) <= 15]
        groups = [(m.start(), m.end()) for m in DIGITS.finditer(part)] if len(digits) >= LEAST_DIGITS else []
        for k, (start, _) in enumerate(groups):
            held = 0
            for first, end in groups[k:]:  # at most MOST_DIGITS groups
                held += end - first
                if held > MOST_DIGITS:
                    break
                if held >= LEAST_DIGITS:
                    runs.append((at + start, at + end))
    return found, runs


def gap(text: str, at: int, step: int) -> int:
    """Separators from ``at`` on to the next digit of the same run; 4 if there are more than two or no digit follows."""
    for n in range(3):
        c = text[at:at + 1] if at >= 0 else ""
        if "0" <= c <= "9":
            return n
        if not c or c not in " ().+-":
            break
        at += step
    return 4


def features(text: str, start: int, end: int) -> list[float]:
    """Format of the span, and context: what touches it and words that announce personal data shortly before it."""
    span = text[start:end]
    digits = only_digits(span)
    groups = [len(g) for g in re.split(r"[^0-9]+", span) if g] or [0]
    before, after = text[start - 1:start], text[end:end + 1]
    parts = span.split(".")
    return [float(v) for v in (
        len(span), len(digits), len(groups), groups[0], groups[-1], max(groups), span.count("."), span.count("-"),
        span.count(" "), "(" in span, len(digits) >= 13 and luhn(digits),
        len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts),
        before.isalnum() or before in ("_", "\"", "=", "#"), after.isalnum() or after in ("_", "\""),
        "@" in span or "at" in span.lower(), len(set(digits)), CUES.search(text, max(0, start - 32), start) is not None,
        gap(text, start - 1, -1), gap(text, end, 1), max(map(len, DIGITS.split(span)[1:-1]), default=0), span[:1] == "0")]


def label(start: int, end: int, base: list[tuple[int, int]], row: list[float]) -> bool | None:
    """Whether a candidate is personal data, as far as the base spans can tell (None: they can't)."""
    over = [s for s in base if s[0] < end and s[1] > start]
    if over:
        return (start, end) in over
    return False if row[2] == 1 and not row[14] and not row[16] else None


def propose(text: str) -> tuple[dict[str, list[tuple[int, int]]], list[tuple[int, int, bool | None, list[float]]]]:
    """Base spans, and candidates as (start, end, label, features). Overlaps are wanted here."""
    found, spans = base_spans(text)
    # The plus before a phone number belongs to the base span but not to the candidate.
    base = sorted((a + (text[a] == "+"), b) for kind in KINDS for a, b in found[kind])
    for marker in ("at)", "at]", "at}"):
        if marker in text or marker.upper() in text:
            spans += [m.span() for m in SPELT_EMAIL.finditer(text)]
            break
    out, at = [], 0
    longest = max((b - a for a, b in base), default=0)
    for start, end in sorted(set(spans) | set(found["email"])):
        while at < len(base) and base[at][0] + longest <= start:
            at += 1  # these end before this candidate and all later ones
        to = at
        while to < len(base) and base[to][0] < end:
            to += 1
        row = features(text, start, end)
        out.append((start, end, label(start, end, base[at:to], row), row))
    return found, out


@lru_cache(maxsize=1)
def rule_made() -> tuple[tuple[bool, tuple[float, ...]], ...]:
    """Labelled feature rows of the candidates in rule-made sentences: the same ones every time."""
    rng = random.Random(7)

    def filled(pattern: str) -> str:
        return re.sub("[nN]", lambda m: str(rng.randrange(m[0] == "N", 10)), pattern)

    phones = ("(Nnn) nnn-nnnn", "Nnn-nnn-nnnn", "Nnn.nnn.nnnn", "Nnn nnn nnnn", "0Nn nnnnnnn", "0Nnn nnnnnnn", "0Nnn-nnnnnnn",
              "0Nn nnnn nnnn", "00NN Nn nnnn nnnn", "1 Nnn nnn nnnn", "1-Nnn-nnn-nnnn", "0Nnnn nnnnnn")
    plain = ("20nn-0N-1n", "20nn-0N-1n 1n", "1n.0N.20nn", "20nn 20nn 20nn", "N nnn nnn", "N.nnn.nnn", "Nn.nnnnn", "20nn-nnnnnn", "20nn-20nn",
             "Nn nn Nn nn Nn", "N.n.nnnnn", "Nnnnnnnn", "Nnnnnnnnnn", "Nnnnnnnnnnnn", "20nn01Nn1n", "Nnnn-nnnn", "97N-N-nnnn-nnnn-n")
    cues = ("call ", "phone: ", "tel. ", "mobile ", "", "reach me on ", "ring ", "")
    leads = ("order ", "on ", "total ", "page ", "build ", "between ", "", "row ", "id ")
    words = ("anna", "j.smith", "info", "sales_2", "max-k", "team")
    out = []
    for k in range(RULE_MADE):
        if k % 4 == 0:
            at, dot = rng.choice((("(at)", "(dot)"), ("[at]", "[dot]"), ("{at}", "{dot}"), (" (at) ", " (dot) "), (" [at] ", "."), ("(at)", ".")))
            parts = [f"{rng.choice(words)}{at}{rng.choice(('mail', 'example', 'my-host'))}{dot}{rng.choice(('com', 'org', 'de'))}"]
            lead = rng.choice(("write to ", "", "mail ", "contact: "))
        elif k % 4 in (1, 2):
            parts = [filled(p) for p in [rng.choice(phones)] * rng.choice((1, 1, 2, 3))]
            lead = rng.choice(cues) + rng.choice(("", "", "", "2019. "))
        else:
            parts, lead = [filled(rng.choice(plain))], rng.choice(leads)
        text, mine = f"word {lead}", set()
        for part in parts:
            mine.add((len(text) + (part[0] == "("), len(text) + len(part)))
            text += part + rng.choice((" ", ", ")) * (part is not parts[-1])
        text += rng.choice((" today", ".", ", then", "\n"))
        mine = mine if k % 4 < 3 else set()
        out += [((a, b) in mine, tuple(row)) for a, b, _, row in propose(text)[1]]
    return tuple(out)


def joined(found: dict[str, list[tuple[int, int]]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind in kinds for a, b in sorted(found.get(kind, ())))


CANDIDATES_DDL = ("n_email long, n_ip long, n_card long, n_phone long, base string, "
                  "starts array<int>, ends array<int>, covers array<boolean>, features array<array<float>>")


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A narrow row per document: its base spans, and its candidates with their features. One pass over the texts."""
    source = pick(docs, doc_id=id_col, text=text_col).withColumn("text", F.col("text").cast("string"))
    names = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base", "starts", "ends", "covers", "features"]
    kinds = [None, *[pa.int64()] * 4, pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.bool_()),
             pa.list_(pa.list_(pa.float32()))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            rows = []
            for text in part["text"].to_pylist():
                found, proposed = propose(text or "")
                rows.append((*(len(found[k]) for k in KINDS), joined(found, KINDS), *(
                    [c[k] for c in proposed] for k in range(4))))
            cols = list(zip(*rows)) or [()] * 9
            yield pa.RecordBatch.from_arrays([part["doc_id"], *(pa.array(c, k) for c, k in zip(cols, kinds[1:]))], names=names)

    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, {CANDIDATES_DDL}")


class Detector:
    """Boosted trees over candidate features, and the calibrated threshold."""

    def __init__(self, trees: BoostedTrees, threshold: float):
        self.trees, self.threshold = trees, threshold

    def selected(self, rows: np.ndarray) -> np.ndarray:
        return self.likelihood(rows) > 0

    def likelihood(self, rows: np.ndarray) -> np.ndarray:
        """Probabilities of the selected candidates, 0 of the others."""
        p = self.trees.probability(rows) if len(rows) else np.zeros(0)
        return np.where(p >= self.threshold, p, 0)


def train(rows: DataFrame, most: int = DRIVER_ROWS, precision: float = PRECISION) -> Detector:
    """Fit on the distinct feature rows of all labelled candidates, each weighted by its count, and the rule-made ones.

    If there are more than ``most`` distinct rows, Spark jobs fit on all of them, else the driver does. A quarter of them, by a
    hash, calibrates the threshold and trains nothing.
    """
    one = rows.select(F.explode(F.arrays_zip("covers", "features")).alias("c")).select("c.covers", "c.features").filter(
        F.col("covers").isNotNull())
    kinds = materialised(one.groupBy("covers", "features").agg(F.count(F.lit(1)).alias("n")))
    total = kinds.count()
    folded = kinds.withColumn("fold", F.expr("pmod(xxhash64(features, 8), 4)"))
    if total > most:
        return train_by_jobs(folded, total, precision)
    got = sorted((bool(r["covers"]), tuple(r["features"]), r["n"], r["fold"]) for r in folded.collect())
    made = rule_made()
    got += [(y, row, 1, k % 4) for k, (y, row) in enumerate(made)]
    x = np.array([r[1] for r in got], "f8").reshape(-1, FEATURES)
    y, weight, fold = (np.array([r[k] for r in got], "f8") for k in (0, 2, 3))
    weight = np.sqrt(weight)  # copies count, but can't drown rare formats
    fit = fold > 0
    trees = BoostedTrees().fit(x[fit], y[fit], weight[fit])
    if not trees.fitted:
        return Detector(trees, float("inf"))
    return Detector(trees, calibrated_threshold(trees.probability(x[~fit]), y[~fit], weight[~fit], precision))


def train_by_jobs(folded: DataFrame, total: int, precision: float) -> Detector:
    made = folded.sparkSession.createDataFrame([(y, list(row), 1, k % 4) for k, (y, row) in enumerate(rule_made())],
                                               "covers boolean, features array<float>, n long, fold long")
    every = materialised(folded.unionByName(made).coalesce(total // ROWS_A_TASK + 1).select(
        F.col("features").alias("x"), F.col("covers").cast("double").alias("y"), F.sqrt("n").alias("weight"), "fold"))
    trees = BoostedTrees().fit_rows(every.filter("fold > 0"))
    if not trees.fitted:
        return Detector(trees, float("inf"))
    return Detector(trees, threshold_of_rows(trees.probability_rows(every.filter("fold = 0")), precision))


def added_spans(base: list[tuple[int, int]], starts: list[int], ends: list[int], likely: np.ndarray) -> list[tuple[int, int]]:
    """Selected candidates (of a likelihood above 0) that share no character with a base span or a likelier selected one."""
    order = sorted((-p, a - b, a, b) for a, b, p in zip(starts, ends, likely.tolist()) if p > 0)
    taken = sorted(base)
    ends_to = list(accumulate((b for _, b in taken), max))  # base spans may overlap one another
    out: list[tuple[int, int]] = []
    for _, _, a, b in order:
        at = bisect_left(taken, (b,))
        if at and ends_to[at - 1] > a:
            continue
        near = bisect_left(out, (b,))
        if not near or out[near - 1][1] <= a:
            out.insert(near, (a, b))
    return out


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, the four base counts, ``base_sha256`` and ``spans`` of every document, and ``n_likely``.

    A null text counts as empty; null ids and repeated rows stay; an empty table gives an empty result; other columns
    are ignored.
    """
    rows = materialised(candidates(docs, id_col, text_col))
    shared = docs.sparkSession.sparkContext.broadcast(train(rows))
    names = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_likely"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "base"):
            digests, spans, n = [], [], []
            for base, starts, ends, rows in zip(*(part[c].to_pylist() for c in ("base", "starts", "ends", "features"))):
                own = [tuple(map(int, s.split(":")[1:])) for s in base.split(",")] if base else []
                chosen = shared.value.likelihood(np.array(rows, "f8").reshape(-1, FEATURES))
                extra = [f"{ADDED}:{a}:{b}" for a, b in added_spans(own, starts, ends, chosen)]
                digests.append(hashlib.sha256(base.encode()).hexdigest())
                spans.append(",".join(([base] if base else []) + extra))
                n.append(len(extra))
            yield pa.RecordBatch.from_arrays(
                [*(part[c] for c in names[:5]), pa.array(digests, pa.string()), pa.array(spans, pa.string()),
                 pa.array(n, pa.int64())], names=names)

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, "
                                "base_sha256 string, spans string, n_likely long")


def masked(text: str, detector: Detector) -> str:
    """The text with every base span and selected candidate replaced by its kind in brackets."""
    found, proposed = propose(text)
    marks = [(a, b, kind) for kind in KINDS for a, b in found[kind]]
    if proposed:
        chosen = detector.likelihood(np.array([c[3] for c in proposed]))
        marks += [(a, b, ADDED) for a, b in added_spans([m[:2] for m in marks], [c[0] for c in proposed],
                                                        [c[1] for c in proposed], chosen)]
    if not marks:
        return text
    out, at = [], 0
    for a, b, kind in sorted(marks):
        if b <= at:
            continue  # within a span that is masked already
        out.append(f"{text[at:max(a, at)]}[{kind.upper()}]" if a >= at else "")
        at = b
    return "".join(out) + text[at:]


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the personal data in ``text_col`` masked; every row and other column stays as it is."""
    rows = candidates(docs, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(train(rows))
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text_col):
            texts = [t if t is None else masked(t, shared.value) for t in part.column(place).to_pylist()]
            cols = list(part.columns)
            cols[place] = pa.array(texts, part.schema.field(place).type)
            yield pa.RecordBatch.from_arrays(cols, schema=part.schema)

    return docs.mapInArrow(run, docs.schema)
