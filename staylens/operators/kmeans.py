"""Lloyd's iteration on packed blocks of small cells (G-2, G-3).

Rows are packed once into blocks (the bytes of doubles, column by column) and persisted, so an iteration moves no row objects. All restarts
and all k run together, one job per iteration, which returns sums per cluster.

Cells. The rows of a block lie in cells of a few neighbours, and of each cell its box, sums and the scatter around its mean are kept.
The difference of a row's squared distances from two centres is linear in the row, so its least value over a box follows from the box's middle and half
widths. A cell that one centre wins against all others, by more than rounding can shift, is added to that cluster as a whole; only the
rows of the other cells, along the borders of clusters, meet the centres themselves, ties included.

Borders. At a few iterations (``RENEW``) a job keeps beside each block, for every run, the rows whose margin (distance to the second nearest
centre less that to their own) is below what the centres may move until the next time, and the sums of all others. As long as no
centre has moved farther, by the triangle inequality, only these rows need be looked at. Results are those of plain Lloyd from the same starts.

Starts come from k-means|| over all rows: in a few passes each restart draws rows with odds in proportion to their squared distance from
the candidates so far (an exponential race on hashed numbers, so reruns agree), and k-means++ on these candidates, weighted by the
rows nearest to each, picks the starts. The driver holds centres and candidates only.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame

BLOCK_ROWS = 150_000
BLOCK_BYTES = 8 << 20  # of a block's numbers at most, beyond one row
CELL_ROWS = 16
RENEW = tuple(range(10, 300, 10))  # iterations before which borders are renewed
MOST_BORDER = 0.125  # of a block's rows, else a run's border is not kept there
SEED_PASSES = 4
FEW_TASKS = 64  # whose sums the driver adds up itself
MAX_ITER = 300
TOL = 1e-4
SAME_COST = 1e-12  # share of a cost by which the order of its sums may shift it

_PACKED = "n long, x binary, cells binary"


class Block(NamedTuple):
    """``n`` rows, column by column, what ``_cells`` has of them, and per run the sums of the rows off the border and the border's places."""

    n: int
    x: bytes
    cells: bytes
    borders: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _in_cells(x: np.ndarray) -> np.ndarray:
    """An order of the rows in which each ``CELL_ROWS`` of them are neighbours: sorted in slabs by one column after the other, widest first."""
    n, d = x.shape
    cells = max(1.0, n / CELL_ROWS)
    used = min(d, max(1, int(np.log2(cells))))
    slabs = int(np.ceil(cells ** (1 / used)))
    order, group = np.arange(n), np.zeros(n, "i8")
    for i, column in enumerate(np.argsort(-np.ptp(x, 0), kind="stable")[:used]):
        order = order[np.lexsort((x[order, column], group))]
        group = np.arange(n) // (CELL_ROWS * slabs ** (used - 1 - i))
    return order


def _cells(x: np.ndarray) -> np.ndarray:
    """Per cell of ordered rows: middle and half widths of its box, rows, their sums, and the squares around their mean."""
    starts = np.arange(0, len(x), CELL_ROWS)
    low, high = np.minimum.reduceat(x, starts), np.maximum.reduceat(x, starts)
    middle = (low + high) / 2
    count = np.diff(np.append(starts, len(x)))[:, None]
    sums = np.add.reduceat(x, starts)
    around = np.add.reduceat(((x - np.repeat(sums / count, count[:, 0], axis=0)) ** 2).sum(1), starts)[:, None]
    return np.hstack([middle, np.maximum(high - middle, middle - low), count, sums, around])


def packed(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> RDD:
    """Blocks of up to ``block_rows`` rows of numeric columns, as doubles column by column, with their cells."""
    most = max(1, min(block_rows, BLOCK_BYTES // (8 * max(1, len(rows.columns)))))

    def block(x: np.ndarray) -> pd.DataFrame:
        x = x[_in_cells(x)]
        return pd.DataFrame({"n": [len(x)], "x": [x.T.tobytes()], "cells": [_cells(x).T.tobytes()]})

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for pdf in frames:
            held, n = [*held, pdf.to_numpy(dtype=float)], n + len(pdf)
            if n >= most:
                x = np.concatenate(held)
                for lo in range(0, n - most + 1, most):
                    yield block(x[lo:lo + most])
                held, n = [x[n - n % most:]], n % most
        if n:
            yield block(np.concatenate(held))

    return rows.mapInPandas(pack, _PACKED).rdd.map(lambda r: Block(r.n, bytes(r.x), bytes(r.cells)))


def _rows(block: Block) -> np.ndarray:
    return np.frombuffer(block.x).reshape(-1, block.n).T


def _squares(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return sum((x[:, i:i + 1] - centres[None, :, i]) ** 2 for i in range(x.shape[1]))


def _nearest(x: np.ndarray, centres: np.ndarray, both: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each row's nearest centre (the first on ties), and the squares of its distances from that and, if ``both``, from the second nearest.
    Centre by centre over columns, so that what is at work stays in the processor's cache."""
    columns = [np.ascontiguousarray(x[:, i]) for i in range(x.shape[1])]
    own, first, second = np.zeros(len(x), "i8"), np.full(len(x), np.inf), np.full(len(x) if both else 0, np.inf)
    for j, centre in enumerate(centres):
        far = sum((c - v) ** 2 for c, v in zip(columns, centre))
        nearer = far < first
        if both:
            np.minimum(second, np.where(nearer, first, far), out=second)
        np.copyto(own, j, where=nearer)
        np.copyto(first, far, where=nearer)
    return own, first, second


def _sums(x: np.ndarray, own: np.ndarray, k: int) -> np.ndarray:
    """Rows and feature sums per cluster."""
    return np.column_stack([np.bincount(own, minlength=k), *[np.bincount(own, x[:, i], k) for i in range(x.shape[1])]])


def _added(parts: RDD, add) -> list:
    """The tasks' results put together: by the driver if there are few, else by tasks of their own."""
    if parts.getNumPartitions() > FEW_TASKS:
        return [parts.treeReduce(add)]
    found = parts.collect()
    return [reduce(add, found)] if found else []


def _total(blocks: RDD, step, shape: tuple[int, int]) -> np.ndarray:
    """The sum of an array over all blocks."""
    def run(some: Iterable[Block]) -> Iterator[np.ndarray]:
        out = np.zeros(shape)
        for block in some:
            out += step(block)
        yield out

    return _added(blocks.mapPartitions(run), np.add)[0]


def _spans(runs: Sequence[np.ndarray]) -> list[tuple[int, int]]:
    ends = np.cumsum([len(c) for c in runs])
    return [(int(e - len(c)), int(e)) for e, c in zip(ends, runs)]


def _decided(middle: np.ndarray, half: np.ndarray, centres: np.ndarray, reach: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Per cell the centre nearest to its middle, and whether that is nearer than any other to all of the box, by more than ``reach``. Over a box
    the difference of two squared distances is least in a corner: twice the half widths times the centres' differences below the middle's."""
    far = [sum((c - v) ** 2 for c, v in zip(middle, centre)) for centre in centres]
    own, first = np.zeros(middle.shape[1], "i8"), far[0].copy()
    for j in range(1, len(centres)):
        nearer = far[j] < first
        own[nearer] = j
        np.copyto(first, far[j], where=nearer)
    apart = 2 * np.abs(centres[:, None] - centres[None])
    decided = np.ones(len(own), bool)
    if reach:
        root, wide = np.sqrt(first), 2 * np.sqrt((half ** 2).sum(0))
    for j in range(len(centres)):
        slack = sum(apart[j, :, i][own] * w for i, w in enumerate(half))
        slack += 1e-9 * (far[j] + first + slack)
        if reach:
            slack += reach * (np.sqrt(far[j]) + root + wide)
        decided &= (own == j) | (far[j] - first > slack)
    return own, decided


def _of_cells(block: Block, d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    cells = np.frombuffer(block.cells).reshape(3 * d + 2, -1)
    return cells[:d], cells[d:2 * d], cells[2 * d], cells[2 * d + 1:-1], cells[-1]


def _picked(x: np.ndarray, places: np.ndarray) -> np.ndarray:
    return np.stack([np.take(x[:, i], places) for i in range(x.shape[1])]).T


def renewed(blocks: RDD, runs: dict[int, np.ndarray], reaches: dict[int, float]) -> RDD:
    """The blocks with the border of every run given, as far as centres come by its reach towards each other."""
    def keep(block: Block) -> Block:
        x, borders = _rows(block), {}
        middle, half, count, sums, _ = _of_cells(block, x.shape[1])
        for r, centres in runs.items():
            own, decided = _decided(middle, half, centres, reaches[r])
            places = np.flatnonzero(np.repeat(~decided, CELL_ROWS)[:block.n])
            some = _picked(x, places)
            of, first, second = _nearest(some, centres)
            near = np.sqrt(second) - np.sqrt(first) <= reaches[r] * (1 + 1e-9) + 1e-12
            if near.sum() > MOST_BORDER * block.n:
                continue
            kept, k = _sums(some[~near], of[~near], len(centres)), len(centres)
            for i, v in enumerate([count, *sums]):
                kept[:, i] += np.bincount(own[decided], v[decided], k)
            borders[r] = kept, places[near].astype("u4")
        return block._replace(borders=borders)

    return blocks.map(keep)


def cell_pass(blocks: RDD, runs: dict[int, np.ndarray], close: set[int] = frozenset()) -> np.ndarray:
    """Per run and cluster: rows, feature sums, cost and rows that met the centres one by one. Runs in ``close`` start from their kept borders
    and have no cost."""
    order = list(runs)
    d, spans = runs[order[0]].shape[1], dict(zip(order, _spans(list(runs.values()))))

    def step(block: Block) -> np.ndarray:
        x = _rows(block)
        middle, half, count, sums, around = _of_cells(block, d)
        means = sums / count
        out = np.zeros((sum(map(len, runs.values())), d + 3))
        for r, (lo, hi) in spans.items():
            centres, k = runs[r], hi - lo
            if r in close and r in block.borders:
                out[lo:hi, :d + 1], places = block.borders[r]
            else:
                own, decided = _decided(middle, half, centres)
                of = own[decided]
                away = around[decided] + count[decided] * sum((m[decided] - centres[:, i][of]) ** 2 for i, m in enumerate(means))
                for i, v in enumerate([count[decided], *[s[decided] for s in sums], away]):
                    out[lo:hi, i] = np.bincount(of, v, k)
                places = np.flatnonzero(np.repeat(~decided, CELL_ROWS)[:block.n])
            if len(places):
                some = _picked(x, places)
                of, first, _ = _nearest(some, centres, both=False)
                out[lo:hi, :d + 1] += _sums(some, of, k)
                out[lo:hi, d + 1] += np.bincount(of, first, k)
                out[lo, -1] = len(places)
        return out

    return _total(blocks, step, (spans[order[-1]][1], d + 3))


def _reach(moves: np.ndarray) -> np.ndarray:
    """Per cluster, how far its centre and the farthest moved other one can have come towards each other for one of its rows."""
    order = np.argsort(moves)
    others = np.full(len(moves), moves[order[-1]])
    others[order[-1]] = moves[order[-2]] if len(moves) > 1 else 0.0
    return (moves + others) * (1 + 1e-9) + 1e-12


def lloyd(blocks: RDD, starts: Sequence[np.ndarray], max_iter: int = MAX_ITER, tol: float = TOL,
          renew: Sequence[int] = RENEW) -> tuple[list[np.ndarray], list[float], list[bool], float]:
    """Centres, costs, whether each run settled (no centre moved more than ``tol``), and the share of rows that met no centre themselves."""
    runs = {r: np.array(c, dtype=float) for r, c in enumerate(starts)}
    d = runs[0].shape[1]
    n = blocks.map(lambda b: b.n).sum()
    settled: set[int] = set()
    held, kept, reaches, last = None, {}, {}, {}
    looked, whole = 0.0, 0.0
    try:
        for t in range(max_iter):
            moving = {r: c for r, c in runs.items() if r not in settled}
            if not moving:
                break
            if t in renew and last:
                until = min([x for x in renew if x > t], default=max_iter) - t
                kept, reaches = {r: c.copy() for r, c in moving.items()}, {r: 2 * last[r] * until for r in moving}
                if held:
                    held.unpersist()
                held = renewed(blocks, kept, reaches).persist(StorageLevel.MEMORY_AND_DISK)
            close = {r for r in moving if r in kept and _reach(np.sqrt(((moving[r] - kept[r]) ** 2).sum(1))).max() < reaches[r]}
            table = cell_pass(held or blocks, moving, close)
            whole += n * len(moving)
            looked += table[:, -1].sum()
            for (r, old), (lo, hi) in zip(moving.items(), _spans(list(moving.values()))):
                count, sums = np.round(table[lo:hi, 0]), table[lo:hi, 1:d + 1]
                runs[r] = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], old)  # an empty cluster stays
                last[r] = float(np.sqrt(((runs[r] - old) ** 2).sum(1).max()))
                if last[r] <= tol:
                    settled.add(r)
    finally:
        if held:
            held.unpersist()
    table = cell_pass(blocks, runs)
    costs = [float(table[lo:hi, d + 1].sum()) for lo, hi in _spans(list(runs.values()))]
    return list(runs.values()), costs, [r in settled for r in runs], 1 - looked / max(whole, 1)


def _hashed(x: np.ndarray, salt: int) -> np.ndarray:
    """A number in (0, 1) per row from the bits of its values: the same wherever the row lies."""
    h = np.full(len(x), np.uint64(salt * 0x9E3779B97F4A7C15 % (1 << 64)))
    with np.errstate(over="ignore"):
        for i in range(x.shape[1]):
            h ^= np.ascontiguousarray(x[:, i]).view("u8")
            h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            h ^= h >> np.uint64(31)
    return ((h >> np.uint64(11)).astype(float) + 0.5) / float(1 << 53)


def _race(blocks: RDD, candidates: list[np.ndarray], draw: int, salt: int) -> list[np.ndarray]:
    """``draw`` further rows for each restart, odds in proportion to squared distance: the smallest of -log(u) / distance."""
    def fewest(a: list[tuple[np.ndarray, np.ndarray]], b: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
        out = []
        for (key, rows), (more, others) in zip(a, b):
            # Copies have one number and so one key: they take one place, and their weight counts later.
            key, some = np.unique(np.concatenate([key, more]), return_index=True)
            out.append((key[:draw], np.vstack([rows, others])[some[:draw]]))
        return out

    def run(some: Iterable[Block]) -> Iterator[list[tuple[np.ndarray, np.ndarray]]]:
        best = None
        for block in some:
            x, found = _rows(block), []
            for r, centres in enumerate(candidates):
                u = _hashed(x, salt * 1009 + r + 1)
                near = _nearest(x, centres, both=False)[1] if len(centres) else np.ones(len(x))
                key = np.where(near > 0, -np.log(u) / np.maximum(near, 1e-300), np.inf)
                key, first = np.unique(key, return_index=True)
                first = first[np.isfinite(key)][:draw]
                found.append((key[:len(first)], x[first]))
            best = fewest(best, found) if best else found
        if best:
            yield best

    won = _added(blocks.mapPartitions(run), fewest)
    return [np.unique(np.vstack([c, rows]) if len(c) else rows, axis=0) for c, (_, rows) in zip(candidates, won[0])] if won else candidates


def parallel_seeds(blocks: RDD, ks: Sequence[int], restarts: int, d: int, seed: int, passes: int = SEED_PASSES) -> dict[tuple[int, int], np.ndarray]:
    """k-means||: starts of every (k, restart), fewer than k where there are fewer distinct rows."""
    candidates = _race(blocks, [np.zeros((0, d))] * restarts, 1, seed)
    for t in range(passes):
        candidates = _race(blocks, candidates, 2 * max(ks), seed + 101 * (t + 1))
    weights = cell_pass(blocks, dict(enumerate(candidates)))[:, 0]
    out = {}
    for j, (lo, hi) in enumerate(_spans(candidates)):
        rows, weight = candidates[j], weights[lo:hi]
        for k in ks:
            rng = np.random.default_rng(seed + j)
            chosen = rows[rng.choice(len(rows), p=weight / weight.sum())][None, :]
            while len(chosen) < k:
                near = _squares(rows, chosen).min(1) * weight
                if not near.sum() > 0:
                    break
                chosen = np.vstack([chosen, rows[rng.choice(len(rows), p=near / near.sum())]])
            out[k, j] = chosen
    return out


def best_of_restarts(rows: DataFrame, ks: Sequence[int], n_init: int, seed: int, max_iter: int = MAX_ITER,
                     tol: float = TOL) -> dict[int, tuple[float, list[list[float]], bool]]:
    """Per k: the lowest cost of ``n_init`` restarts (the first of those that rounding alone tells apart), its centres, and whether it
    settled in ``max_iter``."""
    n, tasks = rows.count(), rows.sparkSession.sparkContext.defaultParallelism
    if not n:
        return {k: (0.0, [], True) for k in ks}
    # A pass costs a task much the same for a small block and a large one, and cells of larger blocks are smaller.
    blocks = packed(rows.coalesce(max(tasks, -(-n // BLOCK_ROWS)))).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        starts = parallel_seeds(blocks, ks, n_init, len(rows.columns), seed)
        names = list(starts)
        centres, costs, settled, _ = lloyd(blocks, [starts[x] for x in names], max_iter, tol)
    finally:
        blocks.unpersist()
    out: dict[int, tuple[float, list[list[float]], bool]] = {}
    for i, (k, _) in enumerate(names):
        if k not in out or costs[i] < out[k][0] * (1 - SAME_COST):
            out[k] = (costs[i], [list(map(float, c)) for c in centres[i]], settled[i])
    return out
