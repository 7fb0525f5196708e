import csv
import json
import os

import pytest
from pyspark.sql import functions as F

from staylens.operators import cleaning as C
from staylens.operators import features as FE
from staylens.operators import filters as P
from staylens.operators import geo as G
from staylens.plans import batch
from staylens.sources import files as S

LISTING_HEADER = ["id", "host_id", "name", "neighbourhood_cleansed", "latitude", "longitude", "room_type", "price",
                  "accommodates", "bedrooms", "beds", "bathrooms", "review_scores_rating", "reviews_per_month",
                  "number_of_reviews", "availability_365", "host_since", "last_review", "host_response_rate",
                  "instant_bookable", "host_is_superhost", "sparse", "sparser"]


def _write_csv(path, header, rows):
    with open(path, "w", newline="", encoding="utf-8") as f:
        w = csv.writer(f)
        w.writerow(header)
        w.writerows(rows)


@pytest.fixture(scope="module")
def raw_dir(tmp_path_factory):
    d = tmp_path_factory.mktemp("raw")
    rows = []
    prices = ["$1,234.00", "¥9,000", "9000 per night", "", "abc", "12d", "nan", "5000", "¥20,000", "$300.50"]
    for i in range(10):
        rows.append([i, 100 + i, f"Flat {i}", "Alpha" if i < 6 else ("Beta" if i < 9 else ""), 35.6 + i / 100,
                     139.7, "Entire home/apt" if i % 2 else "Private room", prices[i], i % 4, "" if i == 3 else i % 3,
                     1, 1, ["", 80, 80.5, 90, 95, 100, 101, 0, "", 60][i], 1.5, i, 100 + i,
                     "2024-13-40" if i == 2 else "2020-01-15", "2024-01-01", ["0%", "50%", "51%", ""][i % 4],
                     ["t", "f", "", "x"][i % 4], "t", "v" if i < 6 else "", "w" if i < 4 else ""])
    _write_csv(os.path.join(d, "listings.csv"), LISTING_HEADER, rows)
    _write_csv(os.path.join(d, "calendar.csv"), ["listing_id", "date", "available", "price", "adjusted_price"],
               [[1, "2024-02-29", "t", "", ""], [1, "2024-12-31", "f", "", ""], [2, "2024-03-02", "t", "", ""]])
    _write_csv(os.path.join(d, "reviews.csv"), ["listing_id", "id", "date", "reviewer_name", "comments"],
               [[1, 10, "2023-06-01", "", "<br/>Great &amp; clean"], [1, 11, "2021-05-31", "Ann", "old one"],
                [2, 12, "2023-01-01", "Bo", 'line one\nline "two"'], [99, 13, "2023-01-02", "Cy", ""]])
    _write_csv(os.path.join(d, "neighbourhoods.csv"), ["neighbourhood_group", "neighbourhood"],
               [["", "Alpha"], ["", "Beta"], ["", "Gamma"]])
    geo = {"type": "FeatureCollection", "features": [
        {"type": "Feature", "properties": {"neighbourhood": n},
         "geometry": {"type": "Polygon", "coordinates": [[[139.7, 35.6], [139.8, 35.6], [139.8, 35.7], [139.7, 35.6]]]}}
        for n in ("Alpha", "Gamma")]}
    with open(os.path.join(d, "neighbourhoods.geojson"), "w") as f:
        json.dump(geo, f)
    return str(d)


def test_csv_sources_type_known_columns(spark, raw_dir):
    data = S.load_all(spark, raw_dir)
    li = data["listings"]
    assert dict(li.dtypes)["id"] == "bigint" and dict(li.dtypes)["review_scores_rating"] == "double"
    assert li.count() == 10
    rev = data["reviews"].orderBy("id").collect()
    assert rev[2].comments == 'line one\nline "two"'
    assert data["neighbourhoods"].count() == 3
    geo = data["neighbourhoods_geojson"].collect()
    assert [g.neighbourhood for g in geo] == ["Alpha", "Gamma"] and json.loads(geo[0].geometry)["type"] == "Polygon"


def test_recent_reviews_cutoff(spark, raw_dir):
    data = S.load_all(spark, raw_dir, as_of="2023-06-01", recent_years=2)
    ids = sorted(r.id for r in data["reviews"].collect())
    # 2021-06-01 is the cutoff: the review on 2021-05-31 is one day before it.
    assert ids == [10, 12, 13]


def test_clean_price_cases(spark):
    vals = ["$1,234.00", "¥9,000", "9000 per night", "", None, "abc", "12d", "nan", "5000"]
    df = spark.createDataFrame([(v,) for v in vals], "p string")
    got = [r[0] for r in df.select(C.clean_price("p")).collect()]
    assert got == [1234.0, 9000.0, 9000.0, None, None, None, None, None, 5000.0]
    compat = [r[0] for r in df.select(C.clean_price("p", compat=True)).collect()]
    assert compat[2] is None


def test_process_raw_and_ensure(spark, raw_dir, tmp_path):
    out = str(tmp_path / "processed")
    assert batch.ensure_processed(spark, raw_dir, out, as_of="2024-06-01")
    assert not batch.ensure_processed(spark, raw_dir, out, as_of="2024-06-01")
    li = spark.read.parquet(f"{out}/listings_processed.parquet")
    cols = set(li.columns)
    assert {"price_per_bedroom", "rating_category", "price_category", "neighborhood_count", "has_reviews"} <= cols
    assert "sparse" in cols and "sparser" not in cols  # 40 % null kept, 60 % null dropped
    r = {x.id: x for x in li.collect()}
    assert r[2].host_since is None  # bad date coerced
    assert r[9].neighborhood_count is None  # no district
    assert r[0].neighborhood_count == 6
    cal = spark.read.parquet(f"{out}/calendar_processed.parquet")
    parts = {(x.day_of_week, x.is_weekend, x.season) for x in cal.collect()}
    assert (3, 0, "Winter") in parts and (5, 1, "Spring") in parts and (1, 0, "Winter") in parts
    rev = spark.read.parquet(f"{out}/reviews_processed.parquet")
    assert rev.where(F.col("reviewer_name") == "Anonymous").count() == 1
    sample = spark.read.parquet(f"{out}/listings_sample_1000.parquet")
    assert sample.count() == 10


def test_response_features_and_numeric_columns(spark):
    df = spark.createDataFrame([("0%",), ("50%",), ("51%",), (None,), ("97%",)], "host_response_rate string")
    out = [(r.response_rate_numeric, r.response_category) for r in FE.response_features(df).collect()]
    assert out == [(0.0, None), (50.0, "Low"), (51.0, "Medium"), (None, None), (97.0, "Excellent")]
    li = spark.createDataFrame([(1, "a", 2.0)], "id long, name string, price double")
    assert P.numeric_columns(li) == ["id", "price"]


def test_district_map_defaults(spark, raw_dir):
    data = S.load_all(spark, raw_dir)
    li = spark.createDataFrame([(1, "Alpha", 100.0), (2, "Alpha", 300.0), (3, "Delta", 5.0)],
                               "id long, neighbourhood_cleansed string, price double")
    m = {r.name: r for r in G.district_map(data["neighbourhoods_geojson"], li).collect()}
    assert m["Alpha"].price_label == "¥200" and m["Alpha"].listings == 2
    assert m["Gamma"].price_label == "No data" and m["Gamma"].listings == 0
    feat = json.loads(m["Gamma"].feature)
    assert feat["properties"]["avg_price_fmt"] == "No data" and feat["geometry"]["type"] == "Polygon"
    assert "Delta" not in m


def test_csv_sink_and_external_inferred(spark, tmp_path):
    df = spark.createDataFrame([(1, "x, y", 2.5)], "a int, b string, c double")
    path = S.write_csv(df, str(tmp_path / "out_csv"))
    back = S.read_external_csv(spark, path)
    assert dict(back.dtypes) == {"a": "int", "b": "string", "c": "double"}
    assert back.first().b == "x, y"


def test_a_cluster_must_name_its_checkpoint_folder():
    from types import SimpleNamespace

    from staylens.session import ensure_checkpoint_dir

    context = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=context))
