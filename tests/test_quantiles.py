import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from staylens.functions import semantics as sem


def check(df, probs, **kw):
    got = {r.k: [r[f"q{i}"] for i in range(len(probs))] for r in sem.quantiles(df, "v", probs, ["k"], **kw).collect()}
    rows = df.where("k is not null and v is not null").toPandas()
    assert set(got) == set(rows.k)
    for k, part in rows.groupby("k"):
        assert np.allclose(got[k], np.quantile(part.v, probs), rtol=1e-12, atol=1e-12), k


@pytest.fixture(scope="module")
def groups(spark):
    rng = random.Random(1)
    rows = [("normal", rng.gauss(0, 1)) for _ in range(20000)]
    rows += [("ties", rng.choice([1.0, 2.0, 2.0, 2.0, 3.0])) for _ in range(9000)]
    rows += [("spike", 5.0 if rng.random() < 0.9 else rng.random() * 10) for _ in range(9000)]
    rows += [("skewed", rng.lognormvariate(0, 4)) for _ in range(9000)]
    rows += [("small", float(i)) for i in range(30)] + [("one", 4.0), ("none", None), (None, 3.0)]
    return spark.createDataFrame(rows, "k string, v double").repartition(6)


@pytest.mark.parametrize("last_values", [20, 500])
def test_narrowed_brackets_are_exact(groups, last_values):
    check(groups, [0.0, 0.001, 0.25, 0.5, 0.77, 0.95, 1.0], accuracy=50, last_values=last_values)


def test_last_window_does_not_grow_with_the_rows(spark):
    sizes = {}
    for n in (20_000, 200_000):
        df = spark.range(n).select(F.lit("a").alias("k"), F.rand(7).alias("_v"))
        state, groups = sem._brackets(df, ["k"], [0.25, 0.5, 0.75], 200, 100, ())
        assert groups == 1
        ranked = sem.folded_values(df, ["k"], state.select("k", "_n", "_lo", "_hi"), 3)
        sizes[n] = ranked.count()
        once = sem.checkpointed(df)
        want = once.agg(F.percentile("_v", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))).first()[0]
        got = sem.quantiles(once.withColumnRenamed("_v", "v"), "v", [0.25, 0.5, 0.75], ["k"], accuracy=200, last_values=100).first()
        assert [got.q0, got.q1, got.q2] == pytest.approx(want, abs=1e-15)
    assert all(n <= 3 * (100 + 3) for n in sizes.values()), sizes


def test_several_columns_in_the_same_passes_and_extras(spark):
    df = spark.createDataFrame([(float(i % 7), float(i), "a" if i % 2 else "b") for i in range(1000)] + [(None, 3.0, "a")],
                               "x double, y double, k string")
    r = sem.column_quantiles(df, {"mx": ("x", 0.5), "qy": ("y", 0.9)}).first()
    assert r.mx == 3.0 and r.qy == pytest.approx(np.quantile([*range(1000), 3], 0.9))
    per = {r.k: r for r in sem.quantiles(df, "x", [0.5], ["k"], ["m"], extra=[F.avg("_v").alias("mean"), F.count("_v").alias("n")]).collect()}
    assert per["a"].n == per["b"].n == 500 and per["a"].mean == pytest.approx(np.mean([i % 7 for i in range(1, 1000, 2)]))
    empty = sem.column_quantiles(df.where("false"), {"mx": ("x", 0.5)}).collect()
    assert len(empty) == 1 and empty[0].mx is None


def test_persisted_frames_are_released(spark, groups):
    held = spark.sparkContext._jsc.getPersistentRDDs().size()
    sem.quantiles(groups, "v", [0.5], ["k"]).collect()
    with sem.evaluated_once(groups) as once:
        assert once.storageLevel.useMemory
        sem.quantiles(once, "v", [0.5], ["k"]).collect()
        assert once.storageLevel.useMemory
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == held
