import os

import pytest
from pyspark.sql import functions as F

from staylens.operators.versioned_store import VersionConflict, VersionedStore
from staylens.plans import batch
from tests.test_sources import _write_csv, raw_dir  # noqa: F401 - the fixture


@pytest.fixture
def store(spark, tmp_path):
    return VersionedStore(spark, str(tmp_path / "store"))


def rows(df):
    return sorted(map(tuple, df.select("id", "v").collect()), key=str)


def test_upserts_write_only_their_rows_and_readers_keep_their_version(spark, store):
    assert not store.exists()
    frame = lambda *r: spark.createDataFrame(list(r), "id long, v string")
    assert store.upsert(frame(*[(k, "a") for k in range(1000)], (None, "n"))) == 1
    opened = store.read()
    assert store.upsert(frame((1, "b"), (1, "c"), (2000, "b"), (None, "m"))) == 2
    last = store.manifest()["tables"][-1]["name"]
    assert spark.read.parquet(f"{store.path}/{last}").count() == 3
    assert rows(opened) == rows(store.read(1)) and opened.count() == 1001 and opened.where("id = 1").first().v == "a"
    now = store.read()
    assert now.count() == 1003 and now.where("id = 1").first().v == "c" and now.where("id is null").count() == 2
    assert store.delete(frame((5, ""), (2000, ""))) == 3
    assert store.count() == 1001 and store.read().where("id in (5, 2000)").count() == 0
    store.upsert(frame((5, "again")))
    assert store.read().where("id = 5").first().v == "again" and store.versions() == [1, 2, 3, 4]
    want = rows(store.read())
    assert store.compact() == 5 and rows(store.read()) == want and len(store.manifest()["tables"]) == 1
    assert len(store.vacuum(keep=1)) == 4 and store.versions() == [5] and rows(store.read()) == want


def test_second_writer_gets_a_conflict(spark, store):
    one = spark.createDataFrame([(1, "a")], "id long, v string")
    store.upsert(one)
    store.upsert(one.withColumn("v", F.lit("b")), base=1)
    with pytest.raises(VersionConflict):
        store.upsert(one.withColumn("v", F.lit("c")), base=1)
    assert store.read().first().v == "b" and store.versions() == [1, 2]


HEADER = ["listing_id", "date", "available", "price", "adjusted_price"]


def test_only_changed_months_are_rewritten(spark, raw_dir, tmp_path):  # noqa: F811
    raw, out, full = (str(tmp_path / x) for x in ("raw", "out", "full"))
    os.makedirs(f"{raw}/calendar.csv")
    for name in ("listings.csv", "reviews.csv", "neighbourhoods.csv", "neighbourhoods.geojson"):
        with open(f"{raw_dir}/{name}", "rb") as f, open(f"{raw}/{name}", "wb") as g:
            g.write(f.read())

    def part(name, *data):
        _write_csv(f"{raw}/calendar.csv/{name}.csv", HEADER, [list(r) for r in data])

    part("a", [1, "2024-01-05", "t", "$10", ""], [1, "2024-02-01", "t", "$11", ""])
    part("b", [2, "2024-02-02", "f", "$12", ""], [2, "2024-03-01", "t", "$13", ""], [2, "", "t", "$1", ""])
    assert batch.refresh_processed(spark, raw, out, "2024-06-01")["calendar"] == ["2024-01", "2024-02", "2024-03", "none"]
    assert batch.refresh_processed(spark, raw, out, "2024-06-01") == {}

    def stamps():
        root = f"{out}/calendar_processed.parquet"
        return {os.path.relpath(d, root): sorted(f for f in fs if f.startswith("part-")) for d, _, fs in os.walk(root) if "month=" in d}

    def same():
        assert batch.ensure_processed(spark, raw, full, "2024-06-01") or True
        spark.catalog.clearCache()
        batch.process_raw(spark, raw, full, "2024-06-01")
        a, b = (spark.read.parquet(f"{x}/calendar_processed.parquet") for x in (out, full))
        key = lambda df: sorted((tuple(str(r[c]) for c in sorted(df.columns)) for r in df.collect()))
        assert key(a) == key(b)

    before = stamps()
    part("c", [3, "2024-03-09", "t", "$20", ""], [3, "2024-04-01", "t", "$21", ""])
    assert batch.refresh_processed(spark, raw, out, "2024-06-01") == {"calendar": ["2024-03", "2024-04"]}
    after = stamps()
    assert after["year=2024/month=1"] == before["year=2024/month=1"] and after["year=2024/month=2"] == before["year=2024/month=2"]
    assert after["year=2024/month=3"] != before["year=2024/month=3"]
    same()
    # A changed file that gives a month up, and a removed one.
    part("a", [1, "2024-02-01", "t", "$99", ""])
    os.remove(f"{raw}/calendar.csv/c.csv")
    assert batch.refresh_processed(spark, raw, out, "2024-06-01") == {"calendar": ["2024-01", "2024-02", "2024-03", "2024-04"]}
    same()
    assert spark.read.parquet(f"{out}/calendar_processed.parquet").where("month in (1, 4)").count() == 0
    # A new date or a lost mark concerns only its tables.
    assert sorted(batch.refresh_processed(spark, raw, out, "2024-07-01")) == ["listings", "reviews"]
    os.remove(f"{out}/reviews_processed.parquet/_SUCCESS")
    assert batch.refresh_processed(spark, raw, out, "2024-07-01") == {"reviews": []}
