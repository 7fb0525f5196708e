"""Best-fit packing of tokenised documents by patterns: enumerate, fit repeat counts, round, pack the rest.

Sequence plans are made on the histogram of piece lengths (at most ``capacity`` rows), never on documents:

1. ``token_pieces`` encodes every text once and returns a narrow row per piece.
2. ``fit_patterns`` enumerates patterns of two to four lengths that fill a sequence, fits their repeat counts to the
   histogram by non-negative least squares, and rounds them down.
3. ``fill_rest`` packs what rounding leaves, by best fit in order of falling length, again on counts.
4. ``place`` numbers the pieces of each length and looks up their sequence and offset.

Numbering needs no sort or window: rows are counted per (partition, length) of the checkpointed piece table, whose
partitions are files and so the same in every attempt, and each row adds its place within its own partition. One length
that holds a third of all rows is spread over all partitions.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from staylens.llm.common import materialised, pick, slices
from staylens.llm.pretokens import word_vocabulary

CAPACITY = 2048
END_ID = 0
# Rounds in which patterns are added for the lengths that a fit leaves over, and such lengths in each.
COLUMN_ROUNDS, HOT_LENGTHS = 4, 12
EMPTY_PRICE = 1.0  # of a pattern's empty place, against an error of one piece of length one

PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
                    ("ids_crc32", pa.int64())])
PIECES_DDL = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(ids: np.ndarray, capacity: int) -> list[tuple[int, int, int, np.ndarray]]:
    """(piece, start, length, ids) of one document's ids; only the last piece may be shorter."""
    return [(k, at, len(part), part)
            for k, at in enumerate(range(0, len(ids), capacity)) for part in [ids[at:at + capacity]]]


def token_pieces(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text",
                 capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """A row per piece of every document: its place, length, CRC-32 and, if asked, its ids.

    A document is the ids of its whole text, then ``end_id``; a null text counts as empty (one piece of one id).
    Null ids stay null, repeated rows are packed each, an empty table gives an empty result, other columns are ignored.
    """
    schema = PIECES.append(pa.field("ids", pa.list_(pa.int64()))) if keep_ids else PIECES
    end = np.array([end_id], "<u4")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_vocabulary(vocabulary)
        for part in slices(batches):
            rows = []
            for doc, ids in zip(part["doc_id"].to_pylist(), words.encode_all(part["text"])):
                rows += [(doc, *at, zlib.crc32(piece), *([piece.astype("i8")] if keep_ids else []))
                         for *at, piece in cut(np.concatenate([ids, end]), capacity)]
            cols = [list(c) for c in zip(*rows)] or [[]] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

    source = pick(docs, doc_id=id_col, text=text_col).withColumns(
        {"doc_id": F.col("doc_id").cast("long"), "text": F.col("text").cast("string")})
    return source.mapInArrow(encode, PIECES_DDL + (", ids array<long>" if keep_ids else ""))


def enumerate_patterns(lengths: list[int], capacity: int, per_length: int = 12, slack: int | None = None) -> list[tuple[int, ...]]:
    """Patterns of two to four lengths whose sum is ``capacity`` or at most ``slack`` less (a twentieth of it by default).

    All pairs of that kind, and for each longest member a spread of ``per_length`` second members (triples) and of
    pairs of them (quadruples) with the best-fitting last member, so there are O(lengths * per_length) patterns.
    """
    lengths = sorted(x for x in lengths if x < capacity)
    slack = capacity // 20 if slack is None else slack
    found: set[tuple[int, ...]] = set()

    def close(head: tuple[int, ...]) -> None:
        room = capacity - sum(head)
        at = bisect_left(lengths, room + 1) - 1
        if at >= 0 and room - lengths[at] <= slack:
            found.add(tuple(sorted((*head, lengths[at]), reverse=True)))

    def spread(limit: int, n: int) -> list[int]:
        top = bisect_left(lengths, limit + 1)
        return sorted({lengths[int(i)] for i in np.linspace(0, top - 1, min(n, top))}) if top else []

    for a in lengths:
        close((a,))
        for b in spread(min(a, capacity - a - 1), per_length):
            close((a, b))
            for c in spread(min(b, capacity - a - b - 1), max(2, per_length // 4)):
                close((a, b, c))
    return sorted(found, reverse=True)


def patterns_around(hot: list[int], lengths: list[int], capacity: int) -> set[tuple[int, ...]]:
    """Patterns with a length of ``hot`` once, twice or three times, every other length, and the best-fitting last one."""
    found = set()
    for a in hot:
        for times in range(1, min(3, capacity // a) + 1):
            head = (a,) * times
            for b in (0, *lengths):
                room = capacity - a * times - b
                if room < 0:
                    break
                at = bisect_left(lengths, room + 1) - 1
                rest = (*([b] if b else []), *([lengths[at]] if at >= 0 else []))
                found.add(tuple(sorted((*head, *rest), reverse=True)))
    return found


def nonnegative_least_squares(patterns: list[tuple[int, ...]], histogram: dict[int, int], capacity: int,
                              steps: int = 300) -> np.ndarray:
    """x >= 0 that brings sum(x_p * pattern_p) close to the histogram, each length's error weighted by the length, with a
    price on the space that patterns leave empty.

    Accelerated projected gradient on the sparse pattern matrix: a pattern has at most four entries.
    """
    lengths = sorted(histogram)
    row_of = {x: i for i, x in enumerate(lengths)}
    rows = np.array([row_of[x] for p in patterns for x in p])
    cols = np.repeat(np.arange(len(patterns)), [len(p) for p in patterns])
    weight = np.sqrt(np.array(lengths, dtype="f8"))
    target = np.array([histogram[x] for x in lengths], dtype="f8") * weight
    price = EMPTY_PRICE * np.array([capacity - sum(p) for p in patterns], dtype="f8")

    def forward(x: np.ndarray) -> np.ndarray:
        return np.bincount(rows, x[cols], len(lengths)) * weight

    def backward(r: np.ndarray) -> np.ndarray:
        return np.bincount(cols, (r * weight)[rows], len(patterns))

    probe = np.ones(len(patterns))
    for _ in range(20):  # largest eigenvalue by power iteration
        probe = backward(forward(probe))
        norm = float(np.linalg.norm(probe))
        probe /= norm
    rate, x, y, t = 1.0 / (1.05 * norm), np.zeros(len(patterns)), np.zeros(len(patterns)), 1.0
    for _ in range(steps):
        after = np.maximum(0.0, y - rate * (backward(forward(y) - target) + price))
        t_after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, x, t = after + (t - 1) / t_after * (after - x), after, t_after
    return x


def fit_patterns(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], Counter]:
    """(pattern, repeats) that fit into the histogram after rounding down, and the counts they leave."""
    rest = Counter({x: n for x, n in histogram.items() if n > 0})
    plan = [((capacity,), rest.pop(capacity))] if rest[capacity] else []
    rest = +rest
    lengths = sorted(rest)
    patterns = enumerate_patterns(lengths, capacity)
    if patterns:
        whole = sum(v * n for v, n in rest.items())
        for _ in range(COLUMN_ROUNDS):
            # A length that the fit leaves over, such as that of very many copies, needs more patterns of its own.
            x = nonnegative_least_squares(patterns, rest, capacity, steps=120)
            left = Counter(rest)
            for p, n in zip(patterns, x.tolist()):
                for v in p:
                    left[v] -= n
            over = sorted(lengths, key=lambda v: -v * left[v])[:HOT_LENGTHS]
            if sum(v * max(0.0, left[v]) for v in lengths) <= 0.01 * whole:
                break
            used = {p for p, n in zip(patterns, x.tolist()) if n > 1e-6}
            more = patterns_around([v for v in over if left[v] >= 1], lengths, capacity) - set(patterns)
            if not more:
                break
            patterns = sorted(used | more, reverse=True)
        x = nonnegative_least_squares(patterns, rest, capacity)
        for k in np.argsort(-x, kind="stable"):
            need = Counter(patterns[k])
            n = min(int(x[k] + 1e-9), *(rest[v] // m for v, m in need.items()))
            if n > 0:
                plan.append((patterns[k], n))
                for v, m in need.items():
                    rest[v] -= n * m
    return plan, +rest


def fill_rest(rest: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit in order of falling length, on counts: bins alike in content are one class with a count."""
    room: dict[int, list[list]] = {}  # free space -> classes [content as ((length, times), ...), bins]
    free: list[int] = []  # the spaces in ``room``, sorted

    def put(space: int, content: tuple, bins: int) -> None:
        if space not in room:
            room[space] = []
            insort(free, space)
        room[space].append([content, bins])

    for length in sorted(rest, reverse=True):
        left = rest[length]
        while left:
            at = bisect_left(free, length)
            space = free[at] if at < len(free) else capacity
            fit = min(space // length, left)  # pieces of this length for one bin
            bins = left // fit
            if at < len(free):
                content, there = room[space][-1]
                bins = min(bins, there)
                if bins == there:
                    room[space].pop()
                    if not room[space]:
                        del room[space]
                        free.pop(at)
                else:
                    room[space][-1][1] -= bins
            else:
                content = ()
            put(space - fit * length, (*content, (length, fit)), bins)
            left -= bins * fit
    return [(tuple(x for x, n in content for _ in range(n)), bins)
            for space in sorted(room) for content, bins in room[space]]


class Allocation:
    """Where the r-th piece of each length goes: intervals of ranks share a pattern slot and run over its sequences."""

    def __init__(self, plan: list[tuple[tuple[int, ...], int]]):
        taken: Counter = Counter()
        keys, first, base, offset, at = [], [], [], [], 0
        for pattern, n in plan:
            place = 0
            for length in pattern:
                keys.append(length * (1 << 40) + taken[length])
                first.append(taken[length])
                base.append(at)
                offset.append(place)
                taken[length] += n
                place += length
            at += n
        order = np.argsort(np.array(keys, dtype="i8"), kind="stable")
        self.keys, self.first, self.base, self.offset = (
            np.array(x, dtype="i8")[order] for x in (keys, first, base, offset))
        self.sequences = at

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k = np.searchsorted(self.keys, length * (1 << 40) + rank, side="right") - 1
        return self.base[k] + rank - self.first[k], self.offset[k]


def plan_sequences(histogram: dict[int, int], capacity: int) -> Allocation:
    plan, rest = fit_patterns(histogram, capacity)
    return Allocation(plan + fill_rest(rest, capacity))


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (a column ``length`` from 1 to ``capacity``) with ``sequence_id`` and ``offset``.

    The driver sees the histogram only: at most ``capacity`` rows. The plan that goes to the tasks has a row per slot of
    a pattern class, of which there are a few per length.
    """
    held = materialised(pieces.withColumns({"_part": F.spark_partition_id()}))
    counts = held.groupBy("_part", "length").agg(F.count(F.lit(1)).alias("_n"))
    histogram = {r["length"]: r["_n"] for r in counts.groupBy("length").agg(F.sum("_n").alias("_n")).collect()}
    plan = plan_sequences(histogram, capacity)
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("_part", "length", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))

    def number(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict = {}
        for frame in frames:  # a task holds rows of one stored partition, in their stored order
            key = frame["_part"].to_numpy() * (1 << 20) + frame["length"].to_numpy()
            local = frame.groupby(key).cumcount().to_numpy()
            kinds, at, n = np.unique(key, return_inverse=True, return_counts=True)
            local = local + np.array([seen.get(k, 0) for k in kinds])[at]
            for k, m in zip(kinds, n):
                seen[k] = seen.get(k, 0) + m
            yield frame.assign(_rank=local)

    def look_up(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            length, rank = frame["length"].to_numpy(), (frame["_rank"] + frame["_first"]).to_numpy()
            sequence, offset = plan.find(length, rank)
            yield frame[out].assign(sequence_id=sequence, offset=offset)

    out = pieces.columns
    ranked = held.mapInPandas(number, held.schema.simpleString()[7:-1].replace(":", " ") + ", _rank long")
    joined = ranked.join(firsts, ["_part", "length"])
    fields = pieces.schema.simpleString()[7:-1].replace(":", " ")
    return joined.mapInPandas(look_up, fields + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text",
                   capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Every piece of every document with its sequence and offset (see ``token_pieces`` for nulls and repeats)."""
    return place(token_pieces(docs, vocabulary, id_col, text_col, capacity, end_id), capacity)
