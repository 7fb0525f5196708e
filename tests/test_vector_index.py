import numpy as np
import pytest

from staylens.operators import retrieval as V
from staylens.operators import vector_index as I

SCHEMA = "id long, embedding array<double>"


def brute(rows, queries, k):
    """Ids in order of rounded cosine, ties and nulls by id."""
    def unit(v):
        v = np.array(v if v is not None else [], float)
        n = np.linalg.norm(v) if len(v) and np.isfinite(v).all() else 0
        return v / n if n > 0 else None

    out = {}
    stored = [(i, unit(v)) for i, v in rows]
    for q, v in queries:
        u = unit(v)
        sims = [(-round(float(u @ w), 10) if u is not None and w is not None and len(u) == len(w) else np.inf, i) for i, w in stored]
        out[q] = [i for _, i in sorted(sims)[:k]]
    return out


def got(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append(r.id)
    return out


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(30, 16))
    return [(k, (centres[k % 30] + 0.05 * rng.normal(size=16)).tolist()) for k in range(6000)]


def test_equals_brute_force_on_clusters_and_reads_few_rows(spark, clustered):
    store = spark.createDataFrame(clustered, SCHEMA).repartition(5)
    queries = [(q, clustered[q * 37][1]) for q in range(60)]
    qdf = spark.createDataFrame(queries, "query_id long, query_vector array<double>")
    index = I.build_index(store, I.scratch_path(spark), block_rows=50)
    assert got(I.search_index(index, qdf, 7, pack=16, probe_rows=200)) == brute(clustered, queries, 7)
    read = I.rows_read(index, qdf, 7, probe_rows=200).collect()
    assert len(read) == 60 and all(r.stored == 6000 for r in read)
    assert sum(r.rows_read for r in read) < 0.15 * 60 * 6000


def test_every_row_is_in_one_block_within_its_bounds(spark, clustered):
    index = I.build_index(spark.createDataFrame(clustered, SCHEMA), I.scratch_path(spark), cells=20, block_rows=64)
    blocks = index.blocks.collect()
    assert sorted(i for b in blocks for i in b.ids) == list(range(6000))
    assert len({b.block for b in blocks}) == len(blocks)
    for b in blocks:
        rows = np.frombuffer(b.vecs).reshape(b.n, 16)
        far = np.linalg.norm(rows - index.centres[b.cell], axis=1)
        assert b.lo - 1e-9 <= far.min() and far.max() <= b.hi + 1e-9 and b.n <= 64
    path = I.scratch_path(spark)
    I.save_centres(index, path)
    again = I.load_index(spark, index.blocks.inputFiles()[0].rsplit("/", 1)[0], path)
    assert np.array_equal(again.centres, index.centres) and again.blocks.count() == len(blocks)


def test_unstructured_and_copies(spark):
    rng = np.random.default_rng(3)
    rows = [(k, rng.normal(size=8).tolist()) for k in range(800)]
    rows += [(1000 + k, rows[0][1]) for k in range(700)]  # nearly half the rows are copies of one
    queries = [(q, rows[q][1]) for q in range(0, 800, 40)]
    store = spark.createDataFrame(rows, SCHEMA)
    qdf = spark.createDataFrame(queries, "query_id long, query_vector array<double>")
    index = I.build_index(store, I.scratch_path(spark), block_rows=40)
    found = I.search_index(index, qdf, 5, probe_rows=50).collect()
    want = {}
    unit = lambda v: np.array(v) / np.linalg.norm(v)
    for q, v in queries:
        want[q] = sorted((float(unit(v) @ unit(w)) for _, w in rows), reverse=True)[:5]
    for q in want:
        sims = [r.similarity for r in sorted((r for r in found if r.query_id == q), key=lambda r: r["rank"])]
        assert np.allclose(sims, want[q], atol=1e-12)


def test_rows_without_direction_come_last(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [1.0, 2.0, 3.0]), (7, [1.0, 1.0])]
    queries = [(10, [1.0, 0.1]), (11, None), (12, [0.0, 0.0]), (13, [1.0, 2.0, 3.0])]
    store = spark.createDataFrame(rows, SCHEMA)
    qdf = spark.createDataFrame(queries, "query_id long, query_vector array<double>")
    found = V.batch_search(store, qdf, 5)
    assert got(found) == {10: [1, 7, 2, 3, 4], 11: [1, 2, 3, 4, 5], 12: [1, 2, 3, 4, 5], 13: [1, 2, 3, 4, 5]}
    assert found.where("query_id > 10 and similarity is not null").count() == 0
    assert V.batch_search(store.where("false"), qdf, 5).count() == 0
    assert V.batch_search(store, qdf.where("false"), 5).count() == 0


def test_few_queries_and_cells_are_at_work_at_once(spark, monkeypatch):
    """Frames of bounded size give what one frame a pack gave."""
    from staylens.operators import vector_index as V

    rng = np.random.default_rng(5)
    store = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(200)], "id long, embedding array<double>")
    queries = store.where("id % 10 = 0").selectExpr("id query_id", "embedding query_vector")
    index = V.build_index(store, V.scratch_path(spark), cells=8, block_rows=16)
    packs, cells = V._packed_queries(queries, "query_id", "query_vector", 4, 50), V._cells(index)
    every = packs.selectExpr("pack", "qids", "qvecs", "cast(null as array<double>) reach")
    whole = sorted(map(tuple, V._reach(index, every, cells).collect()))
    monkeypatch.setattr(V, "REACH_ROWS", 8)
    parts = sorted(map(tuple, V._reach(index, every, cells).collect()))
    assert [r[:3] for r in parts] == [r[:3] for r in whole] and len(whole) == 20 * cells.count()
    assert np.allclose([r[3:5] for r in parts], [r[3:5] for r in whole])
