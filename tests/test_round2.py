"""Off-row behaviour: each case gave a wrong answer or a dropped row before."""

import html
import math
import random

from pyspark.sql import functions as F

from staylens.functions import semantics as sem
from staylens.operators import audit as H
from staylens.operators import cleaning as C
from staylens.operators import discovery as D
from staylens.operators import forecast as T
from staylens.operators import integrate as J
from staylens.operators import retrieval as V
from staylens.operators import segments as S
from staylens.operators import sentiment as R
from staylens.plans import batch
from staylens.sources import files


def test_numbers_drop_what_does_not_parse(spark):
    df = spark.createDataFrame([("Roughly,. 500",), ("1,200.5 and ,",), (None,)], "t string")
    assert [r[0] for r in df.select(H.numbers("t")).collect()] == [[500.0], [1200.5], None]


def test_entities_are_decoded_as_the_standard_library_does(spark):
    texts = ["a &amp; b", "&copy; &middot; &notit; &not; &AMP &ampx", "&#65;&#x42;&#X43 &#128; &#0; &#xD800; &#9999999999;",
             "&unknown; & &; &&amp;", "&nbsp;|&hellip;&fjlig;", "no entity", "", "&amp;copy;", "&#x1F600;é漢"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(C.decode_entities("t")).collect()]
    assert got == [html.unescape(t) for t in texts]


def test_merge_keeps_keys_of_unmatched_external_rows(spark):
    li = spark.createDataFrame([(1, "A"), (2, "B"), (3, None)], "id long, d string")
    ext = spark.createDataFrame([("B", 5), ("C", 6), (None, 7)], "k string, pop int")
    for how, want in (("outer", {(1, "A", None), (2, "B", 5), (3, None, 7), (None, "C", 6)}),
                      ("right", {(2, "B", 5), (3, None, 7), (None, "C", 6)})):
        out = J.merge_external(li, ext, "k", "d", ["pop"], how=how)
        assert {(r.id, r.d, r.pop) for r in out.collect()} == want


def test_merge_report_measures_the_prefixed_column(spark):
    li = spark.createDataFrame([(1, "A", 1), (2, "B", 1), (3, "Z", 1)], "id long, d string, pop int")
    ext = spark.createDataFrame([("A", 5)], "k string, pop int")
    _, rep = J.merge_with_report(li, ext, "k", "d", ["missing", "pop"], prefix="x_")
    r = rep.first()
    assert round(r.match_exact, 1) == 33.3 and r.new_columns == "x_pop"


def test_profile_counts_nan_as_missing(spark):
    p = J.profile_table(spark.createDataFrame([(1.0,), (math.nan,), (None,), (2.0,)], "x double")).first()
    assert p["unique"] == 2 and p.missing_pct == 50.0 and "NaN" not in p.samples


def test_small_integers_do_not_map_onto_ids(spark):
    known = spark.createDataFrame([(i, f"D{i % 5}", i % 4) for i in range(500)], "host_id long, neighbourhood_cleansed string, beds int")
    ext = spark.createDataFrame([(f"D{i}", i) for i in range(5)], "ward string, zone int")
    m = {r.new_column: r.known_column for r in J.suggest_column_mapping(ext, known).collect()}
    assert m["ward"] == "neighbourhood_cleansed" and m["zone"] != "host_id"


def test_systematic_sample_does_not_depend_on_partitioning(spark):
    rng = random.Random(0)
    df = spark.createDataFrame([(rng.choice([1, 1, 1, 1, 2, 3]), i) for i in range(2000)], "k int, i int")
    first = sorted(map(tuple, files.systematic_sample(df.repartition(2), 50, "k", "i", tasks=3).collect()))
    assert first == sorted(map(tuple, files.systematic_sample(df.repartition(7), 50, "k", "i", tasks=6).collect()))
    want = sorted(map(tuple, df.collect()))[::50]
    assert first == want


def test_upsert_keeps_one_row_per_id(spark):
    store = spark.createDataFrame([(1, [1.0]), (2, [2.0])], "id long, embedding array<double>")
    new = spark.createDataFrame([(2, [5.0], 1), (2, [4.0], 2), (3, [3.0], 1)], "id long, embedding array<double>, version int")
    out = V.upsert(store.withColumn("version", F.lit(0)), new, order_col="version").collect()
    assert sorted((r.id, r.embedding[0]) for r in out) == [(1, 1.0), (2, 4.0), (3, 3.0)]


def test_store_exists_and_count(spark, tmp_path):
    path = str(tmp_path / "store")
    assert not V.store_exists(spark, path)
    V.write_version(spark.createDataFrame([(1, [1.0])], "id long, embedding array<double>"), path, 0)
    assert V.store_exists(spark, f"{path}/version=0") and V.store_count(spark.read.parquet(f"{path}/version=0")).first() == (1, 1)


def test_search_refuses_several_query_vectors(spark):
    store = spark.createDataFrame([(1, [1.0, 0.0])], "id long, embedding array<double>")
    two = spark.createDataFrame([([1.0, 0.0],), ([0.0, 1.0],)], "query_vector array<double>")
    try:
        V.search(store, two).collect()
    except Exception as exc:  # noqa: BLE001
        assert "one query" in str(exc)
    else:
        raise AssertionError("several queries were cut to one")


def test_batch_search_equals_brute_force_over_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(V, "STORE_BLOCK", 30)
    monkeypatch.setattr(V, "QUERY_BLOCK", 4)
    rng = random.Random(2)
    rows = [(i, [rng.random() for _ in range(5)]) for i in range(200)] + [(900, [0.0] * 5)]
    store = spark.createDataFrame(rows, "id long, embedding array<double>").repartition(3)
    queries = spark.createDataFrame([(q, v) for q, v in rows[:11]], "query_id long, query_vector array<double>")
    got = {}
    for r in V.batch_search(store, queries, 4).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r.id

    def cos(a, b):
        return sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a)) / math.sqrt(sum(x * x for x in b))

    for q, v in rows[:11]:
        want = sorted((-round(cos(v, w), 12), i) for i, w in rows[:200])[:4]
        assert [got[q][k] for k in range(1, 5)] == [i for _, i in want]


def test_no_caps_by_default(spark):
    reviews = spark.range(30).select(F.col("id"), F.lit(1).cast("long").alias("listing_id"), F.lit("x" * 40).alias("comments"))
    li = spark.createDataFrame([(1, "A")], "id long, neighbourhood_cleansed string")
    assert R.reviews_for_listings(reviews, li).count() == 30 and V.build_corpus(reviews, li).count() == 30


def test_daily_means_keep_all_decimals(spark):
    cal = spark.createDataFrame([("2024-01-01", 10.005), ("2024-01-02", 10.0049)], "date string, price double").withColumn("date", F.to_date("date"))
    assert sorted(r.y for r in T.daily_series(cal, cut_q=None).collect()) == [10.0049, 10.005]


def test_short_series_are_fitted(spark):
    rows = [("s", f"2024-01-{d:02d}", 100.0 + d) for d in range(1, 6)] + [("one", "2024-01-01", 5.0)]
    series = spark.createDataFrame(rows, "series string, ds string, y double").withColumn("ds", F.to_date("ds"))
    fc, models = T.forecast(series, 2, min_days=2)
    assert {r.series: r.status for r in models.collect()} == {"s": "ok", "one": "skipped"}
    last = fc.where("series = 's'").orderBy(F.desc("ds")).first()
    assert abs(last.yhat - 107) < 0.5


def test_lexicon_as_table_equals_the_expression(spark):
    texts = [(1, "good good bad"), (2, "not good"), (3, ""), (4, None), (5, "Terrible, never clean")]
    df = spark.createDataFrame(texts, "id long, comments string")
    lex = spark.createDataFrame(sorted(R.DEFAULT_LEXICON.items()), "word string, polarity double")
    a = {r.id: r.sentiment for r in R.polarity_by_table(df, lex).collect()}
    b = {r.id: r.p for r in df.select("id", R.polarity("comments").alias("p")).collect()}
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-12 for k in a) and b[1] > 0 > b[5]


def test_quantiles_of_one_group_with_all_rows_and_of_many_groups(spark, monkeypatch):
    rng = random.Random(4)
    rows = [("hot", rng.gauss(0, 1)) for _ in range(30_000)] + [(f"g{i % 40}", float(i)) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, v double")
    want = {r.k: r.m for r in df.groupBy("k").agg(F.expr("percentile(v, 0.3)").alias("m")).collect()}
    for bound in (20_000, 3):
        monkeypatch.setattr(sem, "MAX_BROADCAST_GROUPS", bound)
        got = {r.k: r.m for r in sem.quantiles(df, "v", [0.3], ["k"], ["m"]).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_kmeans_finds_separated_groups_and_reports_invariants(spark):
    rng = random.Random(6)
    spots = [(35.6, 139.6, 9000.0), (35.7, 139.8, 25000.0), (35.9, 139.7, 60000.0)]
    rows = [(i, a + rng.gauss(0, .002), b + rng.gauss(0, .002), c + rng.gauss(0, 200)) for i in range(300) for a, b, c in [spots[i % 3]]]
    rows.append((999, None, 139.0, 1.0))
    li = spark.createDataFrame(rows, "id long, latitude double, longitude double, price double")
    labelled, cost, centres = S.cluster(li, k=3, n_init=4)
    got = {r.id: r.cluster for r in labelled.collect()}
    assert got[999] is None and all(got[i] == got[i % 3] for i in range(300)) and len({got[0], got[1], got[2]}) == 3
    elbow = S.elbow(li, max_k=4, n_init=3).orderBy("k").collect()
    costs = [r.inertia for r in elbow]
    assert all(a >= b - 1e-9 for a, b in zip(costs, costs[1:])) and abs(costs[2] - cost) < 1e-6 * max(1, cost)
    two, _, _ = S.cluster(li.drop("price"), k=2, n_init=2)
    assert two.where("cluster is not null").count() == 300


def test_discovery_goes_on_after_a_failure_and_can_report_it(spark, monkeypatch):
    from staylens.sources import roles
    li = roles.listings(spark, "/root/testdata/sf0.001")
    boom = li.withColumn("availability_365", F.raise_error(F.lit("boom")).cast("int"))
    assert 0 < D.run_discovery(boom).count() < 5
    rows = D.run_discovery(boom, errors=True).collect()
    assert len(rows) == 5 and {r.category for r in rows} >= {"error", "anomaly"}


def test_processed_needs_the_marks(spark, tmp_path):
    out = str(tmp_path)
    for t in ("listings", "calendar", "reviews"):
        spark.range(3).write.parquet(f"{out}/{t}_processed.parquet")
    assert not batch.processed_exists(spark, out)
    spark.range(3).write.parquet(f"{out}/listings_sample_{files.SAMPLE_ROWS}.parquet")
    assert batch.processed_exists(spark, out)
    (tmp_path / "calendar_processed.parquet" / "_SUCCESS").unlink()
    assert not batch.processed_exists(spark, out)
