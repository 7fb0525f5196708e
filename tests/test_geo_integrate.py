import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from staylens.operators import geo as G
from staylens.operators import integrate as J
from tests.test_integrate import _brute


def brute_clusters(points, radius):
    """(key, n, lat, lon) in order of falling count: centres, and each point's nearest centre."""
    centres = []
    for p in sorted(points, key=lambda p: (-p[1], p[0])):
        if all((p[2] - c[2]) ** 2 + (p[3] - c[3]) ** 2 > radius ** 2 for c in centres):
            centres.append(p)
    keys = {c[0] for c in centres}
    return {p[0]: p[0] if p[0] in keys else min(((p[2] - c[2]) ** 2 + (p[3] - c[3]) ** 2, c[0]) for c in centres)[1] for p in points}


@pytest.mark.parametrize("seed", [1, 2])
def test_greedy_clusters_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    points = [(k, rng.choice([1, 1, 2, 5, 9]), rng.gauss(0, 0.2), rng.gauss(0, 0.2)) for k in range(300)]
    df = spark.createDataFrame(points, "key long, n long, lat double, lon double")
    assert {r.key: r.root for r in G._greedy(df, 0.1).collect()} == brute_clusters(points, 0.1)


def test_marker_clusters_add_up_and_merge(spark):
    rng = random.Random(3)
    rows = [(35.6 + rng.gauss(0, 0.05), 139.7 + rng.gauss(0, 0.05)) for _ in range(1500)] + [(35.7, 139.8)] * 500 + [(None, 139.0), (math.nan, 1.0)]
    out = G.marker_clusters(spark.createDataFrame(rows, "latitude double, longitude double"))
    by = {r.zoom: (r.n, r.c) for r in out.groupBy("zoom").agg(F.sum("count").alias("n"), F.count("lat").alias("c")).collect()}
    assert all(n == 2000 for n, _ in by.values()) and sorted(by) == list(range(len(G.ZOOM_CELLS)))
    assert all(by[z][1] <= by[z + 1][1] for z in range(len(by) - 1)) and by[0][1] < 10 < by[4][1]
    assert G.marker_clusters(spark.createDataFrame([], "latitude double, longitude double")).count() == 0


def test_kernel_density_keeps_the_mass(spark):
    rng = random.Random(4)
    rows = [(rng.gauss(0, 0.03), rng.gauss(0, 0.03)) for _ in range(500)]
    got = {(r.lat_cell, r.lon_cell): r.density for r in G.kernel_density(spark.createDataFrame(rows, "latitude double, longitude double"), 0.01, 2).collect()}
    assert sum(got.values()) == pytest.approx(500)
    cells = {}
    for a, b in rows:
        c = math.floor(a / 0.01), math.floor(b / 0.01)
        cells[c] = cells.get(c, 0) + 1
    want = {}
    for (a, b), n in cells.items():
        for i, j, w in G.kernel_weights(2):
            want[a + i, b + j] = want.get((a + i, b + j), 0) + n * w
    assert got.keys() == want.keys() and all(got[c] == pytest.approx(want[c]) for c in want)


@pytest.mark.parametrize("cutoff,seed", [(0.55, 5), (0.8, 6), (0.55, 7), (0.51, 8)])
def test_fuzzy_map_over_longer_keys(spark, cutoff, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcde -", k=rng.randint(0, 22)))
    known = [word() for _ in range(80)]

    def edited(s):
        s = list(s)
        for _ in range(rng.randint(0, 6)):
            at = rng.randint(0, len(s))
            s[at:at + rng.randint(0, 1)] = rng.choice(["", "x", "a"])
        return "".join(s)

    new = [edited(k) for k in known] + [word() for _ in range(40)]
    frames = [spark.createDataFrame([(x,) for x in v], "k string") for v in (new, known)]
    got = {r.new_key: r.known_key for r in J.fuzzy_key_map(*frames, "k", "k", cutoff).collect()}
    assert got == _brute(new, known, cutoff)


def test_candidates_are_few(spark):
    rng = random.Random(9)
    names = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(8, 16))) for _ in range(600)]
    a = spark.createDataFrame([(x, x) for x in names[:300]], "new_key string, _na string")
    b = spark.createDataFrame([(x, x) for x in names[300:]], "known_key string, _nb string")
    assert J.fuzzy_candidates(a, b, 0.8).count() < 0.02 * 300 * 300
    assert J.fuzzy_candidates(a, b, 0.55).count() < 0.5 * 300 * 300


def test_sketches_find_the_columns_and_merge(spark):
    n = 20_000
    known = spark.range(n).select(F.col("id").alias("a"), (F.col("id") % 100).alias("few"), F.concat(F.lit("x"), F.col("id")).alias("text"),
                                  F.when(F.col("id") % 2 == 0, F.col("id") + n).alias("half"))
    new = spark.range(int(n * 0.8)).select((F.col("id") + 2000).alias("mostly_a"), (F.col("id") % 90).alias("some"),
                                           F.concat(F.lit("y"), F.col("id")).alias("other"), F.lit(None).cast("string").alias("empty"))
    pairs = J.containment_candidates(new, known, 0.5)
    assert ("mostly_a", "a") in pairs and ("some", "few") in pairs and all(p[0] not in ("other", "empty") for p in pairs) and len(pairs) <= 3
    full = {(r.new_column, r.known_column): (r.containment, r.coverage) for r in J.value_containment(new, known).collect()}
    exact = {(r.new_column, r.known_column): (r.containment, r.coverage) for r in J.exact_containment(new, known, pairs).collect()}
    assert all(exact[p] == full[p] for p in exact) and {p for p, (a, b) in full.items() if min(a, b) >= 0.5} <= set(exact)
    got = {r.column_name: r.hashes for r in J.column_sketches(known.repartition(7), 64).collect()}
    assert got == {r.column_name: r.hashes for r in J.column_sketches(known.coalesce(1), 64).collect()}
    values = np.sort(np.array([r.h for r in known.select(F.xxhash64(F.col("text")).alias("h")).collect()], "i8").view("u8"))[:64]
    assert (np.array(got["text"], "i8").view("u8") == values).all()
