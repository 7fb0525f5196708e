import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from staylens.functions import semantics as S


def _frame(spark):
    rng = np.random.default_rng(7)
    rows = []
    # a hot group (most rows, many ties), a mid group and a tiny group
    for i in range(6000):
        rows.append(("hot", float(rng.integers(0, 300)) if i % 3 else 150.0))
    for i in range(900):
        rows.append(("mid", float(rng.normal(10, 3))))
    rows += [("tiny", 1.0), ("tiny", 4.0), (None, 9.0), ("mid", None), ("mid", float("nan"))]
    return spark.createDataFrame(rows, "k string, v double"), pd.DataFrame(rows, columns=["k", "v"])


@pytest.mark.parametrize("accuracy", [20, 100, 10000])
def test_bracket_quantiles_exact(spark, accuracy):
    df, pdf = _frame(spark)
    probs = [0.0, 0.05, 0.25, 0.5, 0.7, 0.95, 1.0]
    got = S.quantiles(df, "v", probs, ["k"], accuracy=accuracy).toPandas().set_index("k").sort_index()
    want = pdf.dropna(subset=["k"]).groupby("k")["v"].quantile(probs).unstack().sort_index()
    np.testing.assert_allclose(got.values, want.values, rtol=1e-12)
    glob = S.quantiles(df, "v", probs, accuracy=accuracy).toPandas().iloc[0].values
    np.testing.assert_allclose(glob, pdf["v"].quantile(probs).values, rtol=1e-12)


def test_quantile_methods_agree(spark):
    df, _ = _frame(spark)
    a = S.quantiles(df, "v", [0.3], ["k"], method="direct").orderBy("k").collect()
    b = S.quantiles(df, "v", [0.3], ["k"], method="bracket", accuracy=50).orderBy("k").collect()
    assert [round(r.q0, 9) for r in a] == [round(r.q0, 9) for r in b]


def test_global_quantile_empty_is_one_null_row(spark):
    df = spark.createDataFrame([], "v double")
    rows = S.quantiles(df, "v", [0.5]).collect()
    assert len(rows) == 1 and rows[0].q0 is None


def test_cut_is_right_closed_and_nulls_outside(spark):
    df = spark.createDataFrame([(x,) for x in [0.0, 80.0, 80.5, 90.0, 95.0, 100.0, 101.0, None]], "x double")
    out = df.select(S.cut("x", [0, 80, 90, 95, 100], ["Poor", "Good", "Great", "Excellent"]).alias("c")).collect()
    assert [r.c for r in out] == [None, "Poor", "Good", "Good", "Great", "Excellent", None, None]
    low = df.select(S.cut("x", [0, 80, 100], ["a", "b"], include_lowest=True).alias("c")).collect()
    assert low[0].c == "a"


def test_parse_number_like_pandas(spark):
    vals = ["1234.00", "9000pernight", "", None, "abc", "12d", "nan", "5000", "-1.5e3", ".5"]
    df = spark.createDataFrame([(v,) for v in vals], "s string")
    out = [r.x for r in df.select(S.parse_number("s").alias("x")).collect()]
    assert out == [1234.0, None, None, None, None, None, None, 5000.0, -1500.0, 0.5]


def test_sample_skew_matches_pandas(spark):
    xs = [1.0, 2.0, 2.0, 3.0, 10.0, 11.5]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = df.agg(S.sample_skew("x").alias("s")).first().s
    assert got == pytest.approx(pd.Series(xs).skew(), rel=1e-9)
    two = spark.createDataFrame([(1.0,), (2.0,)], "x double").agg(S.sample_skew("x").alias("s")).first().s
    assert two is None


def test_hash_sample_exact_n_and_stable(spark):
    df = spark.range(1000).withColumnRenamed("id", "i")
    a = [r.i for r in S.hash_sample(df, 50, "i", seed=42).collect()]
    b = [r.i for r in S.hash_sample(df.repartition(7), 50, "i", seed=42).collect()]
    assert len(a) == 50 and a == b
    assert S.hash_sample(df, 5000, "i").count() == 1000


def test_unicode_strip(spark):
    df = spark.createDataFrame([("　 hi there \n",)], "s string")
    assert df.select(S.unicode_strip("s").alias("t")).first().t == "hi there"


@pytest.mark.parametrize("n", [0, 1, 37, 500, 5000])
def test_bucketed_hash_sample_equals_full_order(spark, n):
    from staylens.functions.semantics import hash_order, hash_sample

    df = spark.range(0, 3000).withColumnRenamed("id", "k").repartition(5)
    naive = [r.k for r in df.orderBy(hash_order("k", 7), "k").limit(n).collect()]
    got = [r.k for r in hash_sample(df, n, "k", 7).collect()]
    assert sorted(got) == sorted(naive) and len(got) == min(n, 3000)
