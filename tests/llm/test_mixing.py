import random
import re
from collections import Counter
from fractions import Fraction

import duckdb
import pytest

from staylens.llm import mixing
from tests.llm.conftest import plain


def brute_targets(sizes, weights=(1, 2, 3), most=3):
    """By the contract, in exact fractions: share by weight, cap, share the excess again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    out, free, left = {}, set(sizes), Fraction(sum(sizes.values()))
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > most * sizes[s]}
        if not over:
            return out | {s: weight[s] * level for s in free}
        for s in over:
            out[s] = Fraction(most * sizes[s])
            left -= out[s]
        free -= over
    return out


def brute_seats(weights, caps, seats):
    won = [0] * len(weights)
    for _ in range(seats):
        best = max((k for k in range(len(weights)) if won[k] < caps[k] and weights[k]),
                   key=lambda k: (weights[k] / (2 * won[k] + 1), -k))
        won[best] += 1
    return won


def check(rows, texts, sources):
    words = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]
    total = Counter()
    for s, n in zip(sources, words):
        total[s] += n
    want = brute_targets(dict(total))
    assert sorted((r.doc_id, r.size) for r in rows) == sorted(enumerate(words))
    taken = Counter()
    for r in rows:
        s = sources[r.doc_id]
        assert r.source_size == total[s] and r.target == pytest.approx(float(want[s]), abs=1e-6)
        assert 0 <= r.taken <= 3 * r.size
        taken[s] += r.taken
    return {s: (taken[s], float(want[s])) for s in total}


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    sources = ["hot"] * 1000 + [f"s{k % 7}" for k in range(800)] + ["tiny", "tiny", None, None, None]
    return [plain(rng.randrange(0, 120), k) for k in range(len(sources))], sources


def test_targets_and_near_shares(make_docs, corpus):
    texts, sources = corpus
    docs = make_docs(texts, sources=sources)
    rows = mixing.mix(docs).collect()
    near = check(rows, texts, sources)
    assert all(abs(a - b) <= 2 * mixing.BLOCK for a, b in near.values()), near
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_many_shards_match_sql(make_docs, corpus, spark):
    texts, sources = corpus
    docs = make_docs(texts, sources=sources)
    rows = mixing.mix(docs, shard_docs=100).collect()
    near = check(rows, texts, sources)
    assert all(abs(a - b) <= 20 * mixing.BLOCK for a, b in near.values()), near
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text", "source").toArrow())
    want = con.execute(mixing.mix_sql(shard_docs=100)).fetchall()
    assert sorted(map(tuple, rows)) == sorted(want)


def test_apportion_is_sainte_lague(spark):
    rng = random.Random(2)
    data, want = [], {}
    for g in range(30):
        weights = [rng.choice([0, 1, 5, 1000, rng.randrange(1, 5000)]) for _ in range(rng.randrange(1, 9))]
        caps = [rng.randrange(0, 40) for _ in weights]
        most = sum(c for c, w in zip(caps, weights) if w)
        seats = rng.choice([0, most, rng.randrange(most + 1)])
        want |= {(g, k): n for k, n in enumerate(brute_seats(weights, caps, seats))}
        data += [(g, k, w, c, seats) for k, (w, c) in enumerate(zip(weights, caps))]
    parties = spark.createDataFrame(data, "g int, k int, weight long, cap long, seats long")
    assert {(r.g, r.k): r.quota for r in mixing.apportion(parties, "g", ["k"]).collect()} == want


def test_copies_are_documents(make_docs):
    data = make_docs([plain(10, 1), plain(12, 2)], sources=("a", "b"))
    docs = data
    for _ in range(4):
        docs = docs.union(docs)
    rows = mixing.mix(docs).collect()
    assert len(rows) == 32 and all(r.taken <= 3 * r.size for r in rows)
    assert sum(r.taken for r in rows) == pytest.approx(16 * 22, abs=16)


def test_odd_rows(odd_docs, no_docs):
    rows = mixing.mix(odd_docs).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.taken <= 3 * r.size for r in rows)
    assert mixing.mix(no_docs).count() == 0
    empty = mixing.mix(odd_docs.where("text is null or length(trim(text)) = 0")).collect()
    assert empty and all(r.size == r.taken == 0 and r.target == 0 for r in empty)
