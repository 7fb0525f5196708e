import math

import numpy as np

from staylens.llm import ann

SCHEMA = "vec_id long, embedding array<float>, id string, unit string, rank string"


def frame(spark, vectors):
    return spark.createDataFrame([(k, v, "x", "x", "x") for k, v in vectors], SCHEMA)


def brute(vectors, every=50, k=5):
    usable = {i: np.array(v, "f8") for i, v in vectors if i is not None and v and all(
        x is not None and math.isfinite(x) for x in v) and any(v)}
    out = {}
    for q, x in usable.items():
        if q % every == 0:
            scored = sorted((-float(x @ y) / (math.sqrt(float(x @ x)) * math.sqrt(float(y @ y))), i) for i, y in usable.items() if i != q)
            out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def found(frame_):
    out = {}
    for r in sorted(frame_.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def test_recall_on_points_without_structure(spark):
    rng = np.random.default_rng(3)
    vectors = [(k, [float(x) for x in np.float32(rng.standard_normal(24))]) for k in range(3000)]
    got, want = found(ann.nearest(frame(spark, vectors))), brute(vectors)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert got.keys() == want.keys() and hits >= 0.9 * 5 * len(want)
    for q, rows in got.items():
        scores = [s for _, s in rows]
        assert len(rows) == 5 and scores == sorted(scores, reverse=True)


def test_descent_goes_on_until_the_graph_is_built(spark):
    x = np.random.default_rng(5).standard_normal((4000, 32)).astype("f4")
    _, nodes = ann.nodes_of(frame(spark, [(k, v) for k, v in enumerate(x.tolist())]))
    units = ann.packed_units(nodes).repartition("id").persist()
    edges = ann.build_graph(units, len(x))
    before, after = ({(r.id, r.near) for r in e.collect()} for e in (edges, ann.descend(edges, units)))
    units.unpersist()
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    sims = x @ x.T
    np.fill_diagonal(sims, -2)
    want = {(k, int(j)) for k, row in enumerate(np.argpartition(-sims, 16, axis=1)[:, :16]) for j in row}
    assert len(after - before) <= 0.01 * len(want) and len(before & want) >= 0.7 * len(want)


def test_near_copies_are_told_apart(spark):
    rng = np.random.default_rng(6)
    middle = rng.standard_normal(64)
    for spread in (0.01, 0.003):
        x = np.float32(middle + spread * rng.standard_normal((2000, 64)))
        vectors = list(enumerate(x.tolist()))
        got, want = found(ann.nearest(frame(spark, vectors))), brute(vectors)
        hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
        assert got.keys() == want.keys() and hits >= 0.95 * 5 * len(want)


def test_copies_ties_and_unusable_rows(spark):
    rng = np.random.default_rng(4)
    one = [1.0, 2.0, 3.0, 4.0]
    vectors = [(k, one) for k in range(0, 400)] + [(k, [float(x) for x in np.float32(rng.standard_normal(4))]) for k in range(400, 520)]
    vectors += [(520, None), (550, [0.0] * 4), (600, [1.0, None, 2.0, 3.0]), (650, [float("nan"), 1.0, 1.0, 1.0]),
                (700, [float("inf"), 1.0, 1.0, 1.0]), (None, one), (750, [1.0, 2.0]), (800, [])]
    got = found(ann.nearest(frame(spark, vectors + vectors[:3])))
    want = brute([v for v in vectors if v[0] not in (750, 800)])
    assert got.keys() == want.keys()
    for q in want:  # the copies' order is exact
        if q < 400:
            assert [i for i, _ in got[q]] == [i for i in range(6) if i != q][:5]
        assert np.allclose([s for _, s in got[q]], [s for _, s in want[q]], atol=1e-9)


def test_few_rows_and_none(spark):
    assert found(ann.nearest(frame(spark, [(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [0.0, 1.0])])))[0][0][0] == 1
    assert found(ann.nearest(frame(spark, [(0, [1.0, 0.0])]))) == {}
    assert found(ann.nearest(frame(spark, []))) == {}


def test_few_rows_are_few_tasks_however_many_partitions_a_shuffle_has(spark):
    x = np.random.default_rng(8).standard_normal((300, 8)).astype("f4")
    held = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {c: spark.conf.get(c) for c in held}
    for c, v in held.items():
        spark.conf.set(c, v)
    try:
        _, nodes = ann.nodes_of(frame(spark, list(enumerate(x.tolist()))))
        units = ann.packed_units(nodes).repartition("id").persist()
        edges = ann.build_graph(units, len(x))
        assert edges.rdd.getNumPartitions() == 1 and edges.groupBy("id").count().filter("count = 16").count() == 300
        beams = ann.search(units.withColumnRenamed("id", "query").filter("query < 20"), edges, units, 5, n=300, queries=20)
        assert beams.rdd.getNumPartitions() == 2 and beams.count() == 20
        units.unpersist()
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
