"""An exact vector index (V-7, V-11): an inverted file of cells whose blocks are skipped by the triangle inequality.

Building. Every stored vector is scaled to unit length and dealt to the nearest of a set of centres; within a cell, rows
are sorted by their distance from the centre and cut into blocks, a Parquet row each, with the least and largest
distance of its rows. Centres come from a few Lloyd rounds over a bounded seeded sample (``SAMPLE_ROWS``); they decide
how much is skipped, not what is found. Equal vectors are spread over blocks by their ids.

Searching. For unit vectors cosine = 1 - d^2 / 2, so the k most similar rows are the k nearest. A row x of a cell with centre c is at
least |d(q, c) - d(x, c)| away from q, which bounds a whole block by its two distances. A query first reads the blocks
with the least bounds, about ``PROBE_ROWS`` rows, which gives it the k-th distance found; then every other block whose bound doesn't exceed
that. What is skipped can't hold a row of the result, so results equal a scan's. Queries meet blocks by (cell, block): the
directory, one narrow row a block, says which queries a block is read for, and one matrix product answers all of them.

A vector that is null, zero, not finite or of another length than most has no direction: it is kept beside the cells, and
its similarity is null, which ranks last by id.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from staylens.functions.semantics import checkpointed, hash_sample
from staylens.session import ensure_checkpoint_dir

# Bounds of the fit: the sample's rows and the centres that are broadcast.
SAMPLE_ROWS = 20_000
MAX_CELLS = 4_096
LLOYD_ROUNDS = 8
ROWS_PER_BLOCK = 1_000
PROBE_ROWS = 8_000
QUERY_PACK = 1_000
REACH_ROWS = 200_000  # (query, cell) pairs that a task holds at once
SLACK = 1e-7  # of distances, far above their rounding error
NO_CELL = -1

_BLOCK = "cell int, block long, lo double, hi double, n long, ids array<long>, vecs binary"
_FOUND = "pack long, pos int, id long, similarity double"


@dataclass(frozen=True)
class VectorIndex:
    """The blocks as written, their centres (a bounded array) and the length of a vector."""

    blocks: DataFrame
    centres: np.ndarray

    @property
    def dims(self) -> int:
        return self.centres.shape[1]

    def directory(self) -> DataFrame:
        return self.blocks.select("cell", "block", "lo", "hi", "n")


def _unit_matrix(vectors: pd.Series, dims: int) -> np.ndarray:
    """Unit rows; a vector without direction is a row of NaN."""
    mat = np.full((len(vectors), dims), np.nan)
    for i, v in enumerate(vectors):
        if v is not None and len(v) == dims:
            mat[i] = v
    mat[~np.isfinite(mat).all(axis=1)] = np.nan
    norm = np.linalg.norm(mat, axis=1, keepdims=True)
    return np.divide(mat, norm, out=np.full_like(mat, np.nan), where=norm > 0)


def _distances(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    square = (rows * rows).sum(1)[:, None] + (centres * centres).sum(1)[None, :] - 2 * rows @ centres.T
    return np.sqrt(np.maximum(square, 0.0))


def fit_centres(sample: np.ndarray, cells: int, rounds: int = LLOYD_ROUNDS) -> np.ndarray:
    """Centres of a sample of unit rows: spread starting rows, then Lloyd; an emptied cell keeps its centre."""
    if not len(sample):
        return np.zeros((1, sample.shape[1]))
    pick = np.random.default_rng(0).permutation(len(sample))[:cells]
    centres = np.unique(sample[pick], axis=0)
    for _ in range(rounds):
        nearest = _distances(sample, centres).argmin(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, sample)
        count = np.bincount(nearest, minlength=len(centres))[:, None]
        centres = np.where(count > 0, sums / np.maximum(count, 1), centres)
    return centres


def build_index(store: DataFrame, path: str, cells: int | None = None, col: str = "embedding", id_col: str = "id",
                block_rows: int = ROWS_PER_BLOCK) -> VectorIndex:
    """Write the blocks of ``store`` to ``path`` and return the index. ``cells`` defaults to about the root of a quarter of the rows."""
    rows = store.select(F.col(id_col).cast("long").alias("id"), F.transform(F.col(col), lambda x: x.cast("double")).alias("v"))
    lengths = rows.where(F.col("v").isNotNull()).groupBy(F.size("v").alias("dims")).agg(F.count(F.lit(1)).alias("n"))
    common = lengths.orderBy(F.col("n").desc(), F.col("dims").desc()).first()
    dims, total = (common.dims, common.n) if common else (0, 0)
    cells = cells or int(np.clip(round((total / 4) ** 0.5), 1, MAX_CELLS))
    # Bounded by SAMPLE_ROWS.
    some = hash_sample(rows.where(F.size("v") == dims), min(SAMPLE_ROWS, 64 * cells), "id").select("v").toPandas()
    sample = _unit_matrix(some["v"], dims) if len(some) else np.zeros((0, dims))
    centres = fit_centres(sample[~np.isnan(sample).any(axis=1)], cells)

    def deal(frames):
        for pdf in frames:
            unit = _unit_matrix(pdf["v"], dims)
            good = ~np.isnan(unit).any(axis=1) if dims else np.zeros(len(unit), bool)
            cell, far = np.full(len(unit), NO_CELL), np.zeros(len(unit))
            if good.any():
                d = _distances(unit[good], centres)
                cell[good] = d.argmin(1)
                # Measured directly: the expanded square would lose half the digits of small distances.
                far[good] = np.linalg.norm(unit[good] - centres[cell[good]], axis=1)
            yield pd.DataFrame({"id": pdf["id"], "cell": cell, "far": far, "vec": [u.tobytes() for u in unit]})

    def cut(frames):
        """Blocks of a task's rows, which come sorted by (cell, distance)."""
        held: list[pd.DataFrame] = []
        made = 0
        task = TaskContext.get().partitionId()

        def blocks(pdf: pd.DataFrame, last: bool):
            nonlocal made
            starts = np.flatnonzero(np.diff(pdf["cell"].to_numpy(), prepend=-9)).tolist()
            for lo, hi in zip(starts, [*starts[1:], len(pdf)]):
                for at in range(lo, hi, block_rows):
                    part = pdf.iloc[at:min(at + block_rows, hi)]
                    if not last and hi == len(pdf) and len(part) < block_rows:
                        held.append(part)
                        return
                    made += 1
                    yield (int(part["cell"].iloc[0]), task << 32 | made, float(part["far"].min()), float(part["far"].max()),
                           len(part), part["id"].to_numpy(), b"".join(part["vec"]))

        names = ["cell", "block", "lo", "hi", "n", "ids", "vecs"]
        for pdf in frames:
            pdf = pd.concat([*held, pdf], ignore_index=True)
            held.clear()
            out = list(blocks(pdf, False))
            if out:
                yield pd.DataFrame(out, columns=names)
        if held:
            yield pd.DataFrame(list(blocks(held.pop(), True)), columns=names)

    from pyspark import TaskContext

    order = ["cell", "far", F.xxhash64("id")]
    dealt = rows.mapInPandas(deal, "id long, cell int, far double, vec binary").repartitionByRange(*order).sortWithinPartitions(*order)
    dealt.mapInPandas(cut, _BLOCK).write.parquet(path)
    return VectorIndex(store.sparkSession.read.schema(_BLOCK).parquet(path), centres)


def save_centres(index: VectorIndex, path: str) -> None:
    spark = index.blocks.sparkSession
    spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(index.centres)], "cell int, centre array<double>").write.parquet(path)


def load_index(spark: SparkSession, path: str, centres_path: str) -> VectorIndex:
    rows = spark.read.parquet(centres_path).orderBy("cell").collect()  # at most MAX_CELLS rows
    return VectorIndex(spark.read.schema(_BLOCK).parquet(path), np.array([r.centre for r in rows], dtype=float))


def _packed_queries(queries: DataFrame, qid_col: str, qvec_col: str, dims: int, size: int) -> DataFrame:
    """``pack, qids, qvecs``: up to ``size`` queries and their unit vectors a row."""

    def pack(frames):
        task, made = TaskContext.get().partitionId(), 0
        for pdf in frames:
            for lo in range(0, len(pdf), size):
                part = pdf.iloc[lo:lo + size]
                made += 1
                yield pd.DataFrame({"pack": [task << 32 | made], "qids": [part["qid"].to_numpy(np.int64)],
                                    "qvecs": [_unit_matrix(part["v"], dims).tobytes()]})

    from pyspark import TaskContext

    v = F.transform(F.col(qvec_col), lambda x: x.cast("double"))
    return checkpointed(queries.select(F.col(qid_col).cast("long").alias("qid"), v.alias("v")).mapInPandas(
        pack, "pack long, qids array<long>, qvecs binary"))


def _score(index: VectorIndex, packs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """The k best rows of every wanted (pack, pos, cell, block)."""
    dims = index.dims

    def products(frames):
        for pdf in frames:
            for r in pdf.itertuples(index=False):
                pos, ids = np.sort(np.asarray(r.poss)), np.asarray(r.ids)
                sims = np.frombuffer(r.vecs).reshape(-1, dims) @ np.frombuffer(r.qvecs).reshape(-1, dims)[pos].T
                # Final order (similarity desc, id asc), so no tie is lost.
                every = np.broadcast_to(ids[:, None], sims.shape)
                order = np.lexsort((every, -sims), axis=0)[:k]
                # A frame per row: a batch's results together would grow with its rows and their queries.
                yield pd.DataFrame({
                    "pack": r.pack, "pos": np.broadcast_to(pos[None, :], order.shape).ravel(),
                    "id": np.take_along_axis(every, order, 0).ravel(), "similarity": np.take_along_axis(sims, order, 0).ravel()})

    per_block = wanted.groupBy("cell", "block", "pack").agg(F.collect_list("pos").alias("poss"))  # at most a pack's queries
    joined = index.blocks.select("cell", "block", "ids", "vecs").join(per_block, ["cell", "block"]).join(
        packs.select("pack", "qvecs"), "pack").select("pack", "poss", "qvecs", "ids", "vecs")
    return joined.mapInPandas(products, _FOUND)


def _reach(index: VectorIndex, packs: DataFrame, cells: DataFrame) -> DataFrame:
    """``pack, pos, cell, far``: each query's distance from every centre whose cell it may need (``reach``: the largest distance
    of interest, null for any). The cells' distances are bounded like the centres and sent along."""
    dims, centres = index.dims, index.centres
    span = {r.cell: (r.lo, r.hi) for r in cells.collect()}  # at most MAX_CELLS rows
    known = np.array(sorted(span), dtype=int)
    lo, hi = (np.array([span[c][s] for c in known]) for s in (0, 1))

    def run(frames):
        for pdf in frames:
            for r in pdf.itertuples(index=False):
                q = np.frombuffer(r.qvecs).reshape(-1, dims)
                reach = np.asarray(r.reach, dtype=float) if r.reach is not None else np.full(len(q), np.inf)
                step = max(1, REACH_ROWS // max(len(known), 1))  # queries at once, so that memory doesn't grow with the cells
                for at_query in range(0, len(q), step):
                    d = _distances(q[at_query:at_query + step], centres[known])
                    bound = np.maximum(np.maximum(d - hi, lo - d), 0.0)
                    pos, at = np.nonzero(bound <= reach[at_query:at_query + step, None])  # a query without direction compares as false
                    yield pd.DataFrame({"pack": r.pack, "pos": at_query + pos, "cell": known[at], "far": d[pos, at],
                                        "least": bound[pos, at], "reach": reach[at_query + pos]})

    return packs.mapInPandas(run, "pack long, pos int, cell int, far double, least double, reach double")


def search_index(index: VectorIndex, queries: DataFrame, k: int, id_col: str = "id", qid_col: str = "query_id",
                 qvec_col: str = "query_vector", pack: int = QUERY_PACK, probe_rows: int = PROBE_ROWS) -> DataFrame:
    """``query_id, id, similarity, rank``: the k most similar rows per query, exactly."""
    packs = _packed_queries(queries, qid_col, qvec_col, index.dims, pack)
    wanted, first = probe(index, packs, k, probe_rows)
    rest = remaining(index, packs, first, wanted, k)
    found = first.unionByName(_score(index, packs, rest, k)).select("pack", "pos", "id", "similarity")
    names = packs.select("pack", F.posexplode("qids").alias("pos", "qid"))
    directed = found.join(names, ["pack", "pos"]).select("qid", "id", "similarity")
    # Rows without direction rank after all others, by id; so do all rows for a query without direction.
    ids = lambda blocks: blocks.select(F.explode("ids").alias("id")).orderBy("id").limit(k)
    null = F.lit(None).cast("double").alias("similarity")
    no_direction = ids(index.blocks.where(F.col("cell") == NO_CELL))
    lost = packs.mapInPandas(_lost(index.dims), "qid long")
    # Both sides of these products are bounded: k rows each.
    fill = names.select("qid").crossJoin(F.broadcast(no_direction)).select("qid", "id", null)
    unknown = lost.crossJoin(F.broadcast(ids(index.blocks.where(F.col("cell") != NO_CELL)))).select("qid", "id", null)
    place = Window.partitionBy("qid").orderBy(F.col("similarity").desc_nulls_last(), "id")
    return directed.unionByName(fill).unionByName(unknown).withColumn("rank", F.row_number().over(place)).where(
        F.col("rank") <= k).select(F.col("qid").alias(qid_col), F.col("id").alias(id_col), "similarity", "rank")


def _lost(dims: int):
    def run(frames):
        for pdf in frames:
            for r in pdf.itertuples(index=False):
                unit = np.frombuffer(r.qvecs).reshape(len(r.qids), dims)
                lost = np.isnan(unit).any(axis=1) if dims else np.ones(len(unit), bool)
                yield pd.DataFrame({"qid": np.asarray(r.qids)[lost]})

    return run


def _cells(index: VectorIndex) -> DataFrame:
    return index.directory().where(F.col("cell") != NO_CELL).groupBy("cell").agg(
        F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n"))


def probe(index: VectorIndex, packs: DataFrame, k: int, probe_rows: int) -> tuple[DataFrame, DataFrame]:
    """First the blocks with the least bounds, about ``probe_rows`` rows per query: (pack, pos, cell, block) and their best rows."""
    cells = checkpointed(_cells(index))
    near = _reach(index, packs.withColumn("reach", F.lit(None).cast("array<double>")), cells)
    by_bound = Window.partitionBy("pack", "pos").orderBy("least", "far", "cell")
    before = F.coalesce(F.sum("n").over(by_bound.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    some = near.join(F.broadcast(cells.select("cell", "n")), "cell").withColumn("before", before).where(F.col("before") < max(probe_rows, k))
    least = F.greatest(F.col("far") - F.col("hi"), F.col("lo") - F.col("far"), F.lit(0.0))
    blocks = some.drop("n", "least").join(index.directory(), "cell").withColumn("least", least)
    by_block = Window.partitionBy("pack", "pos").orderBy("least", "far", "block")
    before = F.coalesce(F.sum("n").over(by_block.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    wanted = checkpointed(blocks.withColumn("before", before).where(F.col("before") < max(probe_rows, k)).select("pack", "pos", "cell", "block"))
    return wanted, checkpointed(_score(index, packs, wanted, k))


def remaining(index: VectorIndex, packs: DataFrame, first: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """The (pack, pos, cell, block) that may still hold one of a query's k nearest."""
    place = Window.partitionBy("pack", "pos").orderBy(F.col("similarity").desc())
    kth = first.withColumn("r", F.row_number().over(place)).where(F.col("r") == k).select(
        "pack", "pos", (F.sqrt(F.greatest(2 - 2 * F.col("similarity"), F.lit(0.0))) + SLACK).alias("reach"))
    every = packs.select("pack", F.posexplode("qids").alias("pos", "qid")).join(kth, ["pack", "pos"], "left")
    reaches = every.groupBy("pack").agg(F.transform(F.array_sort(F.collect_list(
        F.struct("pos", F.coalesce("reach", F.lit(float("inf"))).alias("reach")))), lambda s: s["reach"]).alias("reach"))
    near = _reach(index, packs.join(reaches, "pack"), _cells(index))
    blocks = near.join(index.directory(), "cell").where(
        (F.col("lo") <= F.col("far") + F.col("reach")) & (F.col("hi") >= F.col("far") - F.col("reach")))
    return blocks.join(wanted, ["pack", "pos", "cell", "block"], "left_anti").select("pack", "pos", "cell", "block")


def rows_read(index: VectorIndex, queries: DataFrame, k: int, qid_col: str = "query_id", qvec_col: str = "query_vector",
              pack: int = QUERY_PACK, probe_rows: int = PROBE_ROWS) -> DataFrame:
    """Per query: rows compared with it and all stored rows that have a direction."""
    packs = _packed_queries(queries, qid_col, qvec_col, index.dims, pack)
    wanted, first = probe(index, packs, k, probe_rows)
    read = wanted.unionByName(remaining(index, packs, first, wanted, k)).join(index.directory().select("cell", "block", "n"), ["cell", "block"])
    total = _cells(index).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("stored"))
    names = packs.select("pack", F.posexplode("qids").alias("pos", "qid"))
    return names.join(read.groupBy("pack", "pos").agg(F.sum("n").alias("rows")), ["pack", "pos"], "left").crossJoin(
        F.broadcast(total)).select(F.col("qid").alias(qid_col), F.coalesce("rows", F.lit(0)).alias("rows_read"), "stored")


def scratch_path(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark)}/vector-index-{uuid.uuid4().hex}"
