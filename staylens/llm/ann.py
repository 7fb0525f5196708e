"""Approximate nearest neighbours by cosine: a neighbour graph by NN-descent, and greedy search on it.

* ``build_graph``: first lists come from short blocks of rows that random projections place together. Each round of
  NN-descent then joins every node's list (its neighbours and a bounded sample of the nodes that list it) with their
  vectors, compares the members of a list with one another, as neighbours of neighbours, and merges what is nearer than
  a member's farthest neighbour into that member's list, until a round changes hardly any edge (``CHANGED``).
* ``search``: every query expands the nearest nodes of its beam that it hasn't expanded yet, by a join with the graph, whose
  rows carry the vectors of their neighbours. Each round expands as many as all before it, and a query ends when such a
  round leaves its best as they were (from ``LEAST`` on). At last all of the beam that rounding can't tell from the best are
  scored on the original vectors in double precision.

Similarities are the cosine less one, as half the negative squared distance of single-precision unit vectors: near copies
differ in it by far more than its rounding error, whereas a product of vectors would lose their differences.

Equal vectors are one node, so copies, however many, are compared once; of a node's ids only the few smallest can be in a
result, as ties go to the smaller id. Lists and blocks have fixed lengths, and a beam has twice the nodes it expanded.
The bounds (neighbours, sampled listers) are the index's approximation: every vector is indexed, and recall
is measured against brute force in tests/llm and stated in the README.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from staylens.llm.common import materialised, pick

NEIGHBOURS = 16  # of a node
LISTERS = 16  # of the nodes that list a node, picked by a hash
BLOCK = 64  # rows of a first block
PROJECTIONS = 4  # first blocks that a row is in
CHANGED = 0.01  # share of the edges; NN-descent ends with a round that changes fewer
LEAST = 512  # nodes that a query expands before it may end
RESCORED = 64  # of a beam at least, on the original vectors
NONE = -4.0  # below any similarity
ROWS_A_TASK = 4000  # of the small frames made here
NODES_A_TASK = 1000  # with their lists: fewer would cost more to start a Python worker for than to work on
QUERIES_A_TASK = 16  # with their beams
ANY = 1_000_000  # tasks: as many as there are partitions

EDGES = pa.schema([("id", pa.int64()), ("near", pa.int64()), ("sim", pa.float32())])
EDGES_DDL = "id long, near long, sim float"
PAIRS = pa.schema([("id", pa.int64()), ("member", pa.int64()), ("own", pa.bool_())])


def _batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _vectors(column: pa.Array) -> np.ndarray:
    """Packed single-precision vectors (none null, all of one length) as a float matrix."""
    ends = np.frombuffer(column.buffers()[1], "<i4")[column.offset:column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], "u1")[ends[0]:ends[-1]].view("<f4").reshape(len(column), -1)


def _all_pairs(x: np.ndarray) -> np.ndarray:
    """Similarity of every row with every other (``NONE`` with itself), by products from the rows' mean."""
    y = x - x.mean(axis=0)
    half = np.einsum("ij,ij->i", y, y) / 2
    sims = np.minimum(y @ y.T - half[:, None] - half, 0)
    np.fill_diagonal(sims, NONE)
    return sims


def groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows sorted by ``key`` as tables of whole groups, with the groups' first rows (and the end) in each."""
    held: list[pa.RecordBatch] = []

    def whole(parts: list[pa.RecordBatch]) -> tuple[pa.Table, np.ndarray]:
        table = pa.Table.from_batches(parts).combine_chunks()
        keys = table[key].to_numpy()
        return table, np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)]])

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch[key].to_numpy(zero_copy_only=False)
        last = int(np.searchsorted(keys, keys[-1], side="left"))
        if last == 0 and held and held[-1][key][-1].as_py() == keys[-1]:
            held.append(batch)
            continue
        if last or held:
            parts = [*held, batch.slice(0, last)] if last else held
            if held and last == 0:
                yield whole(held)
            else:
                yield whole(parts)
        held = [batch.slice(last)]
    if held:
        yield whole(held)


def tasks_of(rows: int, a_task: int) -> int:
    return max(1, -(-rows // a_task))


def dealt(rows: DataFrame, key: str, tasks: int) -> DataFrame:
    """Rows of equal keys together and sorted, in at most ``tasks`` tasks, so that few rows don't become many tasks."""
    return rows.repartition(key).coalesce(tasks).sortWithinPartitions(key)


def best_of(ids: np.ndarray, near: np.ndarray, sim: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``most`` nearest distinct neighbours of each id, nearest first (ties: smaller neighbour)."""
    # A pair may be proposed more than once: keep one of each.
    order = np.lexsort((-sim, near, ids))
    ids, near, sim = ids[order], near[order], sim[order]
    once = np.append(True, (ids[1:] != ids[:-1]) | (near[1:] != near[:-1]))[:len(ids)]
    ids, near, sim = ids[once], near[once], sim[once]
    order = np.lexsort((near, -sim, ids))
    ids, near, sim = ids[order], near[order], sim[order]
    starts = np.flatnonzero(np.append(True, ids[1:] != ids[:-1])) if len(ids) else np.zeros(0, "i8")
    rank = np.arange(len(ids)) - np.repeat(starts, np.diff(np.append(starts, len(ids))))
    return ids[rank < most], near[rank < most], sim[rank < most]


def nodes_of(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """Usable rows (``row_id``, ``vec`` in doubles) and their distinct vectors as nodes (``id``: the smallest row id).

    Rows without id, and vectors that are null, zero, hold a null or non-finite component, or have not the most common
    length (ties: the shorter) take no part. A repeated id counts once, with its smallest usable vector.
    """
    vec = F.col("vec")
    rows = pick(embeddings, row_id=id_col, vec=vector_col).select(F.col("row_id").cast("long"), vec.cast("array<double>"))
    fine = rows.filter(F.col("row_id").isNotNull() & (F.size("vec") > 0) & F.forall(
        vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vec, lambda x: x != 0))
    once = materialised(fine.groupBy("row_id").agg(F.min("vec").alias("vec")))
    sizes = once.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    own = once.filter(F.size("vec") == (sizes[0]["n"] if sizes else 0))
    return own, materialised(own.groupBy("vec").agg(F.min("row_id").alias("id")))


def smallest_ids(own: DataFrame, nodes: DataFrame, keep: int) -> DataFrame:
    """``id, row_id``: the ``keep`` smallest row ids of each node, cut in two steps so that copies never meet in one task."""
    spread = Window.partitionBy("vec", "_salt").orderBy("row_id")
    some = own.withColumn("_salt", F.expr("pmod(xxhash64(row_id), 64)")).withColumn(
        "_rank", F.row_number().over(spread)).filter(F.col("_rank") <= keep).drop("_rank", "_salt")
    few = some.withColumn("_rank", F.row_number().over(Window.partitionBy("vec").orderBy("row_id"))).filter(
        F.col("_rank") <= keep)
    return few.join(nodes, "vec").select("id", "row_id")


def packed_units(nodes: DataFrame) -> DataFrame:
    """``id, unit``: vectors of length one in single precision, for building and walking the graph."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = np.stack(b["vec"].to_numpy(zero_copy_only=False)).astype("f8")
                x /= np.abs(x).max(axis=1, keepdims=True)  # no overflow or underflow in the squares
                x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype("<f4")
                yield pa.RecordBatch.from_arrays([b["id"], pa.array([r.tobytes() for r in x], pa.binary())], names=["id", "unit"])

    return nodes.mapInArrow(run, "id long, unit binary")


def first_lists(units: DataFrame, n: int) -> DataFrame:
    """Edges within blocks of rows that lie together: sorted by the signs on a few random directions, then by one more."""
    bits = max(1, int(np.log2(max(2, n / BLOCK))))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = _vectors(b["unit"])
            for k in range(PROJECTIONS):
                direction = np.random.default_rng(1000 + k).standard_normal((x.shape[1], bits + 1))
                seen = x @ direction
                code = (seen[:, :bits] > 0) @ (1 << np.arange(bits, dtype="i8"))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(x), k, "i4")), pa.array(code.astype("i8")), pa.array(seen[:, bits].astype("f4")),
                     b["id"], b["unit"]], names=["turn", "code", "along", "id", "unit"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        ids = np.concatenate([b["id"].to_numpy() for b in held])
        x = np.concatenate([_vectors(b["unit"]) for b in held])
        for rows in np.array_split(np.arange(len(ids)), -(-len(ids) // BLOCK)):
            sims = _all_pairs(x[rows])
            a, b = np.nonzero(sims > NONE)
            yield _batch(EDGES, *best_of(ids[rows][a], ids[rows][b], sims[a, b], NEIGHBOURS))

    tasks = max(1, n * PROJECTIONS // ROWS_A_TASK)
    placed = units.coalesce(tasks).mapInArrow(place, "turn int, code long, along float, id long, unit binary")
    return placed.repartitionByRange(tasks, "turn", "code", "along").coalesce(tasks).sortWithinPartitions(
        "turn", "code", "along").mapInArrow(compare, EDGES_DDL)


def merged(edges: DataFrame, most: int, tasks: int = ANY) -> DataFrame:
    """The ``most`` nearest of each id: first within each task, then over all, so a node in very many lists is no hot spot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows > 400_000:
                held = [_best_batch(held, most)]
                rows = held[0].num_rows
                if rows > 200_000:
                    yield held.pop()
                    rows = 0
        if held:
            yield _best_batch(held, most)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, _ in groups(batches, "id"):
            yield _best_batch(table.to_batches(), most)

    return dealt(edges.mapInArrow(run, EDGES_DDL), "id", tasks).mapInArrow(finish, EDGES_DDL)


def _best_batch(batches: list[pa.RecordBatch], most: int) -> pa.RecordBatch:
    return _batch(EDGES, *best_of(*(np.concatenate([b[c].to_numpy(zero_copy_only=False) for b in batches]) if batches
                                    else np.zeros(0) for c in ("id", "near", "sim")), most))


def _few(ids: np.ndarray, members: np.ndarray, most: int) -> np.ndarray:
    """Rows of at most ``most`` members of each id, picked by a hash of the pair (the same in every task and attempt)."""
    mixed = (ids.astype("u8") * np.uint64(0x9E3779B97F4A7C15)) ^ (members.astype("u8") * np.uint64(0xC2B2AE3D27D4EB4F))
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    order = np.lexsort((mixed, ids))
    starts = np.flatnonzero(np.append(True, ids[order][1:] != ids[order][:-1])) if len(ids) else np.zeros(0, "i8")
    rank = np.arange(len(ids)) - np.repeat(starts, np.diff(np.append(starts, len(ids))))
    return np.sort(order[rank < most])


def floors(edges: DataFrame) -> DataFrame:
    """``id, floor``: the similarity that a node must exceed to enter a node's list."""
    full = F.count(F.lit(1)) >= NEIGHBOURS
    return edges.groupBy("id").agg(F.when(full, F.min("sim")).otherwise(F.lit(NONE)).cast("float").alias("floor"))


def lists(edges: DataFrame, nodes: DataFrame, tasks: int = ANY) -> DataFrame:
    """``id, member, own`` and the columns of ``nodes`` for each member, sorted by id: each node's neighbours (``own``) and
    nodes that list it.

    A task passes on at most ``LISTERS`` nodes that list a node, so a node that very many list stays small."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        ids, near = (np.concatenate([b[c].to_numpy() for b in held]) for c in ("id", "near"))
        few = _few(near, ids, LISTERS)
        yield _batch(PAIRS, ids, near, np.ones(len(ids), bool))
        yield _batch(PAIRS, near[few], ids[few], np.zeros(len(few), bool))

    rows = edges.mapInArrow(pairs, "id long, member long, own boolean")
    known = nodes.withColumnRenamed("id", "member")
    return dealt(rows.join(known, "member"), "id", tasks)


def _cut_lists(table: pa.Table) -> pa.Table:
    """Whole lists cut to ``LISTERS`` nodes that aren't the node's own neighbours, each member once."""
    table = table.combine_chunks()
    ids, members, own = (table[c].to_numpy() for c in ("id", "member", "own"))
    others = np.flatnonzero(~own)
    keep = np.sort(np.concatenate([np.flatnonzero(own), others[_few(ids[others], members[others], LISTERS)]]))
    order = keep[np.lexsort((~own[keep], members[keep], ids[keep]))]
    ids, members = ids[order], members[order]
    once = np.append(True, (ids[1:] != ids[:-1]) | (members[1:] != members[:-1]))
    return table.take(pa.array(order[once])).combine_chunks()


def _starts(ids: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.flatnonzero(np.diff(ids)) + 1, [len(ids)]])


def descend(edges: DataFrame, units: DataFrame, tasks: int = ANY) -> DataFrame:
    """One round of NN-descent: the members of each list propose themselves to one another."""

    def propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, _ in groups(batches, "id"):
            table = _cut_lists(table)
            x, least, ids = _vectors(table["unit"].chunk(0)), table["floor"].to_numpy(), table["member"].to_numpy()
            at = _starts(table["id"].to_numpy())
            found = []
            for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
                sims = _all_pairs(x[a:b])
                to, of = np.nonzero(sims > least[a:b, None])
                found.append((ids[a + to], ids[a + of], sims[to, of]))
            yield _batch(EDGES, *best_of(*(np.concatenate(c) for c in zip(*found)), NEIGHBOURS))

    nodes = units.join(floors(edges), "id", "left").fillna(NONE, ["floor"])
    return merged(edges.union(lists(edges, nodes, tasks).mapInArrow(propose, EDGES_DDL)), NEIGHBOURS, tasks)


def build_graph(units: DataFrame, n: int, changed: float = CHANGED) -> DataFrame:
    """Edges ``id, near, sim`` of the neighbour graph over ``units`` (``n`` rows); a node's edges are together."""
    tasks = tasks_of(n, NODES_A_TASK)
    edges = materialised(merged(first_lists(units, n), NEIGHBOURS, tasks))
    while True:
        before, edges = edges, materialised(descend(edges, units, tasks))
        # Lists only ever get nearer, so this ends.
        if edges.join(before, ["id", "near"], "left_anti").count() <= changed * NEIGHBOURS * n:
            return edges


STATE = "query long, unit binary, ids array<long>, sims array<float>, open array<boolean>"


def search(starts: DataFrame, edges: DataFrame, units: DataFrame, k: int, least: int = LEAST, n: int | None = None,
           queries: int | None = None) -> DataFrame:
    """``query, ids, sims``: the beam of each query node (``query``, its ``unit``) after greedy search from itself.

    A query ends when its nearest ``k`` (beside itself) outlast a round that doubles the nodes it has expanded, ``least`` at
    least, or when nothing is left to expand. A beam is one row of at most twice those nodes; a round joins a row of the
    graph per node that it expands. ``n`` nodes and ``queries`` starts, where they are known, bound the tasks.
    """
    of_nodes, of_queries = (ANY if rows is None else tasks_of(rows, a_task)
                            for rows, a_task in ((n, NODES_A_TASK), (queries, QUERIES_A_TASK)))

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, _ in groups(batches, "id"):
            table = _cut_lists(table)
            ids = table["id"].to_numpy()
            at = _starts(ids)
            ends = pa.array(at.astype("i4"))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[at[:-1]]), pa.ListArray.from_arrays(ends, table["member"].chunk(0)),
                 pa.ListArray.from_arrays(ends, table["unit"].chunk(0))], names=["node", "members", "units"])

    # Rows of the graph with their neighbours' vectors, kept in one partitioning for the joins of all rounds.
    graph = lists(edges, units, of_nodes).mapInArrow(rows_of, "node long, members array<long>, units array<binary>").repartition(
        "node").persist(StorageLevel.DISK_ONLY)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("query", pa.int64()), ("ids", pa.list_(pa.int64())), ("sims", pa.list_(pa.float32()))])
        for b in batches:
            if not b.num_rows:
                continue
            q, floors, members, near = _vectors(b["unit"]), b["floor"].to_numpy(), b["members"], b["units"]
            at = np.asarray(members.offsets)
            ids, x = np.asarray(members.flatten()), _vectors(near.flatten())
            at = at - at[0]
            apart = x - np.repeat(q, np.diff(at), axis=0)
            sims = np.einsum("ij,ij->i", apart, apart) / -2
            keep = sims > np.repeat(floors, np.diff(at))
            kept = np.concatenate([[0], np.cumsum(keep)])[at].astype("i4")
            yield pa.RecordBatch.from_arrays([b["query"], pa.ListArray.from_arrays(pa.array(kept), pa.array(ids[keep])),
                                              pa.ListArray.from_arrays(pa.array(kept), pa.array(sims[keep].astype("f4")))],
                                             schema=schema)

    def merge(batches: Iterator[pa.RecordBatch], beam: int, may_end: bool) -> Iterator[pa.RecordBatch]:
        names = ["query", "unit", "ids", "sims", "open"]
        for table, at in groups(batches, "query"):
            rows = []
            table = table.combine_chunks()
            lists_ = table["ids"].chunk(0)
            ends = np.asarray(lists_.offsets) - lists_.offsets[0].as_py()
            all_ids, all_sims = np.asarray(lists_.flatten()), np.asarray(table["sims"].chunk(0).flatten())
            states = table["unit"].is_valid().to_numpy(zero_copy_only=False)
            for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
                own = a + int(states[a:b].argmax())
                first, last = ends[own], ends[own + 1]
                # The beam's own entries come first, so that a node in it keeps its mark.
                ids, sims = (np.concatenate([v[first:last], v[ends[a]:first], v[last:ends[b]]]) for v in (all_ids, all_sims))
                new = np.ones(len(ids), bool)
                new[:last - first] = table["open"][own].as_py()
                _, once = np.unique(ids, return_index=True)
                order = once[np.lexsort((ids[once], -sims[once]))][:beam]
                if may_end and np.array_equal(ids[order][:k + 1], ids[:last - first][:k + 1]):
                    new[:] = False
                rows.append((table["query"][own].as_py(), table["unit"][own].as_py(), ids[order], sims[order], new[order]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.binary(), pa.list_(pa.int64()),
                                                             pa.list_(pa.float32()), pa.list_(pa.bool_())))], names=names)

    def step(batches: Iterator[pa.RecordBatch], most: int, beam: int) -> Iterator[pa.RecordBatch]:
        """The nodes that each beam expands next, with the least similarity that would still enter the beam."""
        for b in batches:
            out = []
            for q, unit, ids, sims, new in zip(*(b[c].to_pylist() for c in ("query", "unit", "ids", "sims", "open"))):
                floor = sims[beam - 1] if len(ids) >= beam else NONE
                out += [(n, q, unit, floor) for n, ok in zip(ids, new) if ok][:most]
            cols = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
                cols, (pa.int64(), pa.int64(), pa.binary(), pa.float32()))], names=["node", "query", "unit", "floor"])

    def closed(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
        """The same beams with these nodes marked as expanded."""
        for b in batches:
            marks = []
            for new in b["open"].to_pylist():
                left = most
                for k, ok in enumerate(new):
                    if ok and left:
                        new[k], left = False, left - 1
                marks.append(new)
            yield pa.RecordBatch.from_arrays([b["query"], b["unit"], b["ids"], b["sims"], pa.array(marks, pa.list_(pa.bool_()))],
                                             names=["query", "unit", "ids", "sims", "open"])

    state = materialised(starts.coalesce(of_queries).select("query", "unit", F.array("query").alias("ids"), F.array(F.lit(0.0).cast("float")).alias("sims"),
                                       F.array(F.lit(True)).alias("open")))
    most, total = 2 * NEIGHBOURS, 0
    while not state.filter(F.exists("open", lambda x: x)).isEmpty():
        total, beam = total + most, max(2 * (total + most), least)
        frontier = state.mapInArrow(partial(step, most=most, beam=beam), "node long, query long, unit binary, floor float")
        expanded = ANY if queries is None else tasks_of(queries * most, NODES_A_TASK)
        seen = frontier.join(graph, "node").select("query", "unit", "floor", "members", "units").coalesce(expanded).mapInArrow(
            look, "query long, ids array<long>, sims array<float>")
        both = state.mapInArrow(partial(closed, most=most), STATE).unionByName(seen, allowMissingColumns=True)
        state = materialised(dealt(both, "query", of_queries).mapInArrow(
            partial(merge, beam=beam, may_end=total >= least), STATE))
        most = total
    graph.unpersist()
    return state.select("query", "ids", "sims")


def nearest(embeddings: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found of every row whose id is divisible by ``every``.

    All other rows are candidates. Fewer than ``k`` candidates are all returned. An empty table, or one without usable
    vectors (see ``nodes_of``), gives an empty result.
    """
    own, nodes = nodes_of(embeddings, id_col, vector_col)
    members = materialised(smallest_ids(own, nodes, k + 1))
    # One partitioning by id for the joins of all rounds.
    n = nodes.count()
    units = packed_units(nodes.coalesce(tasks_of(n, NODES_A_TASK))).repartition("id").persist(StorageLevel.DISK_ONLY)
    edges = build_graph(units, n)
    asked = materialised(own.filter(F.col("row_id") % every == 0).join(nodes.select(F.col("id").alias("node"), "vec"), "vec").select(
        F.col("row_id").alias("query_id"), "node"))
    starts = asked.select(F.col("node").alias("query")).distinct().join(
        units.select(F.col("id").alias("query"), "unit"), "query")
    queries = asked.count()
    beams = search(starts, edges, units, k, n=n, queries=queries)
    units.unpersist()
    # Whatever rounding can't tell from the last of the best: single-precision distances err by less than this slack.
    apart = F.sqrt(-2 * F.element_at("sims", F.least(F.lit(k + 1), F.size("sims"))).cast("double"))
    far = F.pow(apart * (1 + 2.0 ** -14) + 2.0 ** -20, 2) / -2
    within = F.size(F.filter("sims", lambda x: x >= far))
    found = beams.withColumn("_n", F.greatest(F.lit(RESCORED), within)).select("query", F.explode(
        F.array_union(F.expr("slice(ids, 1, _n)"), F.array("query"))).alias("id"))
    pairs = found.join(nodes.select("id", "vec"), "id").join(
        nodes.select(F.col("id").alias("query"), F.col("vec").alias("query_vec")), "query")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, y = (np.stack(b[c].to_numpy(zero_copy_only=False)) for c in ("vec", "query_vec"))
                cosine = np.einsum("ij,ij->i", x, y) / (np.sqrt(np.einsum("ij,ij->i", x, x)) * np.sqrt(np.einsum("ij,ij->i", y, y)))
                yield pa.RecordBatch.from_arrays([b["query"], b["id"], pa.array(cosine)], names=["query", "id", "score"])

    scored = pairs.select("query", "id", "vec", "query_vec").coalesce(tasks_of(queries, QUERIES_A_TASK)).mapInArrow(score, "query long, id long, score double")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "row_id")
    # One more than k: a query's own row may be among them.
    short = scored.join(members, "id").withColumn("_rank", F.row_number().over(best)).filter(F.col("_rank") <= k + 1)
    others = asked.join(short, F.col("node") == F.col("query")).filter(F.col("row_id") != F.col("query_id"))
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "row_id")
    return others.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= k).select(
        "query_id", "rank", F.col("row_id").alias("vec_id"), "score")

