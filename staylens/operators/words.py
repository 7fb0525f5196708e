"""Word tables that tasks look tokens up in (R-2), and pairs of word numbers counted in narrow frames.

A table of words with a number each is sent to the tasks once, sorted by a hash of the word: some 25 bytes a word. A batch of tokens is
reduced to its distinct words first; a word is found by its hash and then compared, so words of one hash are told apart.

Pairs of numbers are counted per task in sorted arrays. A pair's code is its tile (the pairs of two ranges of numbers) and its place there; a task hands on
one row a tile, with the differences of the sorted codes and the counts, byte by byte and compressed: some two bytes a pair instead of a row.
A task of the next stage adds up the rows of a tile a few at a time.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute

MOST_WORDS = 5_000_000  # words of a table that tasks look up
SLICE_TOKENS = 250_000
HELD_PAIRS = 1_000_000  # fresh ones that a task merges at once with what it has; at three times as many distinct ones it hands them on
TILE_PAIRS = 4_000_000  # of all tasks in a tile, on average

PARTS = "tile long, n long, codes binary, counts binary"


class WordTable(NamedTuple):
    hashes: np.ndarray  # sorted
    words: pa.Array
    values: np.ndarray


def _hashed(words: pa.Array) -> np.ndarray:
    return pd.util.hash_array(words.to_numpy(zero_copy_only=False).astype(object), categorize=False)


def word_table(words: pa.ChunkedArray, values: pa.ChunkedArray) -> WordTable:
    """A table of distinct words that aren't null."""
    words = pa.concat_arrays(words.chunks) if words.num_chunks else pa.array([], words.type)
    hashes = _hashed(words)
    order = np.argsort(hashes, kind="stable")
    return WordTable(hashes[order], words.take(pa.array(order)), values.to_numpy()[order])


def places(table: WordTable, words: pa.Array) -> np.ndarray:
    """Each word's place in the table, -1 where it is not there."""
    hashes = _hashed(words)
    at, last = np.searchsorted(table.hashes, hashes), len(table.hashes) - 1
    out = np.full(len(words), -1, "i8")
    left = np.flatnonzero(at <= last)
    left = left[table.hashes[at[left]] == hashes[left]]
    while len(left):
        same = pa.compute.equal(table.words.take(pa.array(at[left])), words.take(pa.array(left)).cast(table.words.type)).to_numpy(zero_copy_only=False)
        out[left[same]] = at[left[same]]
        # Another word of the same hash: the next one.
        left = left[~same]
        at[left] += 1
        left = left[at[left] <= last]
        left = left[table.hashes[at[left]] == hashes[left]]
    return out


def flat(column: pa.Array) -> tuple[np.ndarray, pa.DictionaryArray]:
    """The tokens of a column of arrays in one piece: how many each row has, and the tokens by their distinct words."""
    return column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype("i8"), column.flatten().dictionary_encode()


def _merged(runs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if len(runs) == 1:
        return runs[0]
    codes, counts = (np.concatenate([r[i] for r in runs]) for i in (0, 1))
    order = np.argsort(codes, kind="stable")  # which takes little time where sorted runs follow one another
    codes, counts = codes[order], counts[order]
    first = np.flatnonzero(np.append(True, codes[1:] != codes[:-1])) if len(codes) else np.zeros(0, "i8")
    return codes[first], np.add.reduceat(counts, first, dtype=counts.dtype) if len(first) else counts


def _bytewise(x: np.ndarray) -> bytes:
    """Numbers byte by byte, the lowest of all first, so that what is mostly zero compresses to nothing."""
    return pa.compress(np.ascontiguousarray(x.astype("<u8").view("u1").reshape(-1, 8).T).tobytes(), codec="zstd", asbytes=True)


def _numbers(b: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(b, decompressed_size=8 * n, codec="zstd"), "u1").reshape(8, n)
    return np.ascontiguousarray(planes.T).view("<u8").reshape(n).astype("i8")


class Tiles(NamedTuple):
    """Pairs of numbers under ``words``, cut in ``side`` ranges of ``width``."""

    side: int
    width: int

    @classmethod
    def of(cls, words: int, pairs: int) -> Tiles:
        """Tiles of some ``TILE_PAIRS`` of so many pairs each."""
        side = max(1, int(np.ceil(np.sqrt(2 * pairs / TILE_PAIRS))))
        return cls(side, max(1, -(-words // side)))

    def ends(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What a number adds to the code of a pair as its smaller and as its larger one."""
        tile, place, area = number // self.width, number % self.width, self.width ** 2
        return tile * self.side * area + place * self.width, tile * area + place

    def rows(self, codes: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        area = self.width ** 2
        tiles, first = np.unique(codes // area, return_index=True)
        for tile, lo, hi in zip(tiles, first, [*first[1:], len(codes)]):
            local = codes[lo:hi] - tile * area
            parts = _bytewise(np.diff(local, prepend=0)), _bytewise(counts[lo:hi])
            yield pa.RecordBatch.from_arrays([pa.array([tile], pa.int64()), pa.array([hi - lo], pa.int64()), pa.array(parts[:1], pa.binary()),
                                              pa.array(parts[1:], pa.binary())], ["tile", "n", "codes", "counts"])

    def pairs(self, tile: int, local: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        a, b = tile // self.side * self.width + local // self.width, tile % self.side * self.width + local % self.width
        for lo in range(0, len(a), SLICE_TOKENS):
            yield pa.RecordBatch.from_arrays([pa.array(x[lo:lo + SLICE_TOKENS]) for x in (a.astype("i4"), b.astype("i4"), counts)], ["a", "b", "n"])


def counted(batches: Iterable[pa.RecordBatch], table: WordTable, tiles: Tiles, window: int) -> Iterator[pa.RecordBatch]:
    """Rows of ``PARTS``: how often two known words of the arrays in the only column stand within ``window`` places of each other."""
    small, large = tiles.ends(table.values.astype("i8"))
    held: list[tuple[np.ndarray, np.ndarray]] = []
    fresh = seen = 0
    for batch in batches:
        lengths, tokens = flat(batch.column(0))
        at = places(table, tokens.dictionary).astype("i4")[tokens.indices.to_numpy()]
        row = np.repeat(np.arange(len(lengths), dtype="i4"), lengths)
        for lo in range(0, len(at), SLICE_TOKENS):
            some, of = at[lo:lo + SLICE_TOKENS + window], row[lo:lo + SLICE_TOKENS + window]
            starts, found = min(SLICE_TOKENS, len(at) - lo), []
            for j in range(1, window + 1):
                n = max(0, min(starts, len(some) - j))
                v, w = some[:n], some[j:j + n]
                kept = np.flatnonzero((v >= 0) & (w >= 0) & (v != w) & (of[:n] == of[j:j + n]))
                v, w = v[kept], w[kept]
                found.append(np.where(table.values[v] < table.values[w], small[v] + large[w], small[w] + large[v]))
            codes, counts = np.unique(np.concatenate(found), return_counts=True)
            held.append((codes, counts.astype("u4")))
            fresh, seen = fresh + len(codes), seen + window * starts
            if fresh >= HELD_PAIRS or seen >= 1 << 31:
                held, fresh = [_merged(held)], 0
                if len(held[0][0]) >= 3 * HELD_PAIRS or seen >= 1 << 31:  # no count has outgrown its type by then
                    yield from tiles.rows(*held.pop())
                    seen = 0
    if held:
        yield from tiles.rows(*_merged(held))


def added(batches: Iterable[pa.RecordBatch], tiles: Tiles) -> Iterator[pa.RecordBatch]:
    """``a, b, n``: the pairs of tiles whose rows of ``PARTS`` follow one another."""
    now, held, fresh = None, [], 0
    for batch in batches:
        for part in batch.to_pylist():
            if part["tile"] != now and held:
                yield from tiles.pairs(now, *_merged(held))
                held, fresh = [], 0
            now = part["tile"]
            held.append((np.cumsum(_numbers(part["codes"], part["n"])), _numbers(part["counts"], part["n"])))
            fresh += part["n"]
            if fresh >= HELD_PAIRS:
                held, fresh = [_merged(held)], 0
    if held:
        yield from tiles.pairs(now, *_merged(held))


def named(batches: Iterable[pa.RecordBatch], words: pa.Array) -> Iterator[pa.RecordBatch]:
    """Links by number (``word, other, ppmi``) as links by word."""
    for batch in batches:
        for lo in range(0, len(batch), SLICE_TOKENS):
            some = batch.slice(lo, SLICE_TOKENS)
            yield pa.RecordBatch.from_arrays([words.take(some.column(0)), words.take(some.column(1)), some.column(2)], ["word", "other", "ppmi"])


def scored(batches: Iterable[pa.RecordBatch], table: WordTable, negations: frozenset[str], factor: float) -> Iterator[pa.RecordBatch]:
    """``id, sum, n`` of an id and its tokens: what the words of the table add up to, turned after a negation, and how many they are."""
    for batch in batches:
        lengths, tokens = flat(batch.column(1))
        at = np.append(places(table, tokens.dictionary), -1)
        worth = np.append(table.values, 0.0)[at]
        turns = np.array([w in negations for w in tokens.dictionary.to_pylist()], bool)
        index = tokens.indices.to_numpy()
        starts = np.cumsum(lengths) - lengths
        after = np.append(False, turns[index][:-1]) if len(index) else np.zeros(0, bool)
        after[starts[lengths > 0]] = False
        row, hit = np.repeat(np.arange(len(lengths)), lengths), at[index] >= 0
        total = np.bincount(row[hit], (worth[index] * np.where(after, factor, 1.0))[hit], len(lengths))
        n = np.bincount(row[hit], minlength=len(lengths))
        kept = pa.array(np.flatnonzero(n))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(kept), pa.array(total).take(kept), pa.array(n).take(kept)], ["_id", "_sum", "_n"])
