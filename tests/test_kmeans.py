import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from staylens.operators import kmeans as K
from staylens.operators import segments as S


def plain_lloyd(x, centres, max_iter=300, tol=1e-4):
    centres = centres.copy()
    for _ in range(max_iter):
        own = ((x[:, None, :] - centres[None]) ** 2).sum(2).argmin(1)
        new = np.array([x[own == c].mean(0) if (own == c).any() else centres[c] for c in range(len(centres))])
        moved = ((new - centres) ** 2).sum(1).max()
        centres = new
        if moved <= tol ** 2:
            break
    far = ((x[:, None, :] - centres[None]) ** 2).sum(2)
    return centres, far.min(1).sum(), far.argmin(1)


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(5)
    x = np.vstack([rng.normal(c, 0.6, size=(700, 2)) for c in ((0, 0), (2, 1), (0, 3), (4, 4))] + [np.zeros((200, 2))])
    return x, spark.createDataFrame([tuple(map(float, r)) for r in x], "_z0 double, _z1 double").repartition(4)


def test_bounded_lloyd_equals_plain_lloyd(cloud):
    x, rows = cloud
    blocks = K.packed(rows, 300).persist()
    rng = np.random.default_rng(1)
    starts = [x[rng.choice(len(x), k, replace=False)] for k in (2, 3, 5, 6, 9)] + [np.array([[0.0, 0.0], [50.0, 50.0], [1.0, 1.0]])]
    for renew in ((1, 3, 8), (), K.RENEW):
        centres, costs, settled, saved = K.lloyd(blocks, starts, renew=renew)
        for start, got, cost in zip(starts, centres, costs):
            want, want_cost, want_own = plain_lloyd(x, start)
            assert np.allclose(got, want, atol=1e-8) and cost == pytest.approx(want_cost)
            assert (((x[:, None] - got[None]) ** 2).sum(2).argmin(1) == want_own).all()
        assert all(settled) and (saved > 0.4 if renew == (1, 3, 8) else saved >= 0)
    blocks.unpersist()


def test_seeds_are_rows_spread_out_and_repeatable(cloud):
    x, rows = cloud
    a = K.parallel_seeds(K.packed(rows, 300), [3, 4], 3, 2, 7)
    b = K.parallel_seeds(K.packed(rows.repartition(7), 500), [3, 4], 3, 2, 7)
    known = {tuple(r) for r in x}
    for key, c in a.items():
        assert len(c) == key[0] == len(np.unique(c, axis=0)) and all(tuple(r) in known for r in c)
        assert np.array_equal(c, b[key])
    assert len({a[4, j].tobytes() for j in range(3)}) > 1


def test_few_distinct_rows_and_none(spark):
    rows = spark.createDataFrame([(1.0, 2.0)] * 50 + [(3.0, 4.0)] * 5, "_z0 double, _z1 double")
    cost, centres, settled = K.best_of_restarts(rows, [4], 3, 42)[4]
    assert cost == 0 and settled and sorted(map(tuple, centres)) == [(1.0, 2.0), (3.0, 4.0)]
    assert K.best_of_restarts(rows.where("false"), [2], 3, 42) == {2: (0.0, [], True)}


def test_invariants_row(spark):
    rng = np.random.default_rng(2)
    li = spark.createDataFrame([(i, *map(float, rng.normal(size=3))) for i in range(500)] + [(900, None, 1.0, 1.0)],
                               "id long, latitude double, longitude double, price double")
    r = S.check_segments(li, k=4, n_init=3).first()
    assert (r.rows, r.clusters, r.nearest, r.centred, r.cheaper) == (500, 4, True, True, True)
    assert r.one_cluster_cost == pytest.approx(1500)
    labelled, _, _ = S.cluster(li, k=4, n_init=3)
    assert labelled.where(F.col("cluster").isNull()).count() == 1


def test_nearest_centre_by_columns_and_reach_per_cluster():
    import numpy as np

    from staylens.operators import kmeans as K

    rng = np.random.default_rng(2)
    x, centres = rng.normal(size=(500, 3)).round(1), rng.normal(size=(6, 3)).round(1)
    centres[4] = centres[1]
    far = K._squares(x, centres)
    own, first, second = K._nearest(x, centres)
    assert (own == far.argmin(1)).all() and (first == far.min(1)).all() and (second == np.sort(far, 1)[:, 1]).all()
    assert K._nearest(x, centres[:1])[2].min() == np.inf
    reach = K._reach(np.array([0.5, 0.0, 0.25]))
    assert reach == pytest.approx([0.75, 0.5, 0.75]) and K._reach(np.array([1.0])) == pytest.approx([1.0])


def test_a_filter_on_the_cluster_measures_no_distance_again(spark):
    rows = [(1, 0.0, 0.0), (2, 1.0, 1.0), (3, 0.5, 0.5), (4, None, None), (5, 9.0, 9.0)]
    z = spark.createDataFrame(rows, "id long, _z0 double, _z1 double")
    labelled = S.assign(z, [(0.0, 0.0), (1.0, 1.0)], 2)
    assert {r.id: r.cluster for r in labelled.collect()} == {1: 0, 2: 1, 3: 0, 4: None, 5: 1}  # the first on ties
    plan = labelled.where("cluster is not null").groupBy("cluster").count()._jdf.queryExecution().optimizedPlan().toString().lower()
    assert plan.count("power(") == 4


def test_cells_alone_spare_most_rows_and_ties_go_to_the_first_centre(spark):
    rng = np.random.default_rng(9)
    x = np.vstack([rng.normal(size=(12_000, 3)), rng.integers(0, 4, size=(4_000, 3))])
    rows = spark.createDataFrame(pd.DataFrame(x, columns=["_z0", "_z1", "_z2"])).repartition(2)
    blocks = K.packed(rows).persist()
    starts = [x[:4], np.array([[0.0, 0, 0], [2, 0, 0], [0, 2, 0], [2, 2, 0]]), np.array([[1.0, 1, 1], [1.0, 1, 1], [9, 9, 9]])]
    table = K.cell_pass(blocks, dict(enumerate(starts)))
    for start, (lo, hi) in zip(starts, K._spans(starts)):
        far = ((x[:, None] - start[None]) ** 2).sum(2)
        own = far.argmin(1)
        assert (table[lo:hi, 0] == np.bincount(own, minlength=len(start))).all()
        assert table[lo:hi, 4] == pytest.approx(np.bincount(own, far.min(1), len(start)))
    centres, costs, _, saved = K.lloyd(blocks, starts[:1], renew=())
    assert saved > 0.5  # without bounds kept, where every row met every centre before
    want, cost, _ = plain_lloyd(x, starts[0])
    assert np.allclose(centres[0], want, atol=1e-8) and costs[0] == pytest.approx(cost)
    blocks.unpersist()


def test_tasks_add_up_alike_on_the_driver_and_in_a_tree(cloud, monkeypatch):
    x, rows = cloud
    blocks = K.packed(rows, 100).persist()
    few = K.cell_pass(blocks, {0: x[:5]}), K.parallel_seeds(blocks, [3], 2, 2, 7)
    monkeypatch.setattr(K, "FEW_TASKS", 1)
    many = K.cell_pass(blocks, {0: x[:5]}), K.parallel_seeds(blocks, [3], 2, 2, 7)
    assert np.allclose(few[0], many[0]) and all(np.array_equal(c, many[1][key]) for key, c in few[1].items())
    blocks.unpersist()


def test_of_costs_that_rounding_tells_apart_the_first_wins(spark, monkeypatch):
    rows = spark.createDataFrame([(float(i), 0.0) for i in range(40)], "_z0 double, _z1 double")
    costs = [2.0, 1.0, 1.0 - 1e-15, 1.5]
    monkeypatch.setattr(K, "lloyd", lambda blocks, starts, *_: ([np.full((2, 2), i) for i in range(4)], costs, [True] * 4, 0.0))
    assert K.best_of_restarts(rows, [2], 4, 42)[2] == (1.0, [[1.0, 1.0], [1.0, 1.0]], True)
