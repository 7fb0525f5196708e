import random

import pytest

from staylens.operators import integrate as J


def _lev(a, b):
    prev = list(range(len(b) + 1))
    for i, ca in enumerate(a, 1):
        cur = [i]
        for j, cb in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[j - 1] + 1, prev[j - 1] + (ca != cb)))
        prev = cur
    return prev[-1]


def _brute(new, known, cutoff):
    out = {}
    for n in set(new):
        na = J._normalise_name(n)
        best = None
        for k in sorted(set(known)):
            nb = J._normalise_name(k)
            L = max(len(na), len(nb))
            s = 1.0 if L == 0 else 1 - _lev(na, nb) / L
            if s >= cutoff and (best is None or s > best[1]):
                best = (k, s)
        out[n] = best[0] if best else None
    return out


@pytest.mark.parametrize("cutoff,seed", [(0.55, 1), (0.55, 2), (0.7, 3), (0.9, 4)])
def test_fuzzy_key_map_equals_brute_force(spark, cutoff, seed):
    rnd = random.Random(seed)
    alpha = "aab-_ "
    known = ["".join(rnd.choice(alpha) for _ in range(rnd.randint(0, 9))) for _ in range(60)]
    new = [k if rnd.random() < 0.3 else "".join(rnd.choice(alpha) for _ in range(rnd.randint(0, 9)))
           for k in known[:40]] + ["zzzz", "Aa-B"]
    nd = spark.createDataFrame([(x,) for x in new], "k string")
    kd = spark.createDataFrame([(x,) for x in known], "k string")
    got = {r.new_key: r.known_key for r in J.fuzzy_key_map(nd, kd, "k", "k", cutoff).collect()}
    assert got == _brute(new, known, cutoff)


def test_merge_rules(spark):
    li = spark.createDataFrame([(1, "Alpha"), (2, "Beta"), (3, None)], "id long, neighbourhood_cleansed string")
    ext = spark.createDataFrame([("Alpha", 1, 10, 0.1), ("Alpha", 0, 20, 0.2), (None, 2, 30, 0.3)],
                                "`Neighbourhood-Cleansed` string, ord int, pop int, width double")
    out = {r.id: r for r in J.merge_external(li, ext, "Neighbourhood-Cleansed", "neighbourhood_cleansed",
                                             ["pop"], order_col="ord").collect()}
    assert out[1].pop == 20  # duplicate keys: the first by the order column wins
    assert out[2].pop is None
    assert out[3].pop == 30  # null key matches null key, as a pandas merge does
    with pytest.raises(J.MergeError):
        J.merge_external(li, ext, "missing", "neighbourhood_cleansed", ["pop"])
    with pytest.raises(J.MergeError):
        J.merge_external(li.withColumn("pop", li.id), ext, "Neighbourhood-Cleansed", "neighbourhood_cleansed", ["pop"])
    _, rep = J.merge_with_report(li, ext, "Neighbourhood-Cleansed", "neighbourhood_cleansed", ["pop"])
    r = rep.first()
    assert r.original_rows == 3 and r.merged_rows == 3 and abs(r.match_rate - 66.7) < 1e-9
    _, err = J.merge_with_report(li, ext, "nope", "neighbourhood_cleansed", ["pop"])
    assert err.first().status == "error"
    assert J.join_hint("width") and not J.token_hint("width")
