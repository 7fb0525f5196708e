import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from staylens.llm import lexical
from tests.llm.conftest import WORDS, plain

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, top=10):
    """docs and items: (id, text) rows."""
    counted = [Counter(terms(t)) for _, t in docs]
    n_docs, n_terms = sum(bool(c) for c in counted), sum(c.total() for c in counted)
    df = Counter(t for c in counted for t in c)
    out = []
    for item_id, text in items:
        scored = []
        for (doc_id, _), c in zip(docs, counted):
            score, n = 0, c.total()
            for t in set(terms(text)) & set(c):
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                m = 100 - 90 + (90 * n * n_docs) // n_terms
                score += w * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m))
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0))
        out += [(item_id, k + 1, None if null else d, -s) for k, (s, null, d) in enumerate(sorted(scored)[:top])]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(7)
    words = [f"w{k}" for k in range(400)]
    weights = [1 / (k + 1) for k in range(400)]
    text = lambda n: " ".join(rng.choices(words, weights, k=n))
    docs = [(k, text(rng.randrange(0, 200))) for k in range(1500)]
    docs += [(k + 5000, docs[k][1]) for k in range(0, 300, 3)] + [(9000, None), (9001, ""), (9002, "ÀB Ab-ab_AB é漢 w1")]
    items = [(k, text(rng.randrange(1, 60))) for k in range(40)] + [(100, None), (101, "nowhere"), (102, "ab É é漢 À"), (5, "w1"), (5, "w1")]
    return docs, items


def frames(spark, docs, items):
    return (spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))


def test_matches_brute_force(spark, corpus, monkeypatch):
    docs, items = corpus
    d, i = frames(spark, docs, items)
    want = brute(docs, items)
    assert sorted(map(tuple, lexical.rank_documents(d.repartition(3), i).collect()), key=str) == want
    con = duckdb.connect()
    con.register("documents", d.toArrow())
    con.register("benchmark", i.toArrow())
    assert sorted(con.execute(lexical.rank_sql()).fetchall(), key=str) == want


def test_blocks_of_items_agree(spark, corpus):
    docs, items = corpus
    d, i = frames(spark, docs[:300], items[:12])
    assert sorted(map(tuple, lexical.rank_documents(d, i, top=3, block_bytes=500).collect()), key=str) \
        == brute(docs[:300], items[:12], 3)


def chunk_of(docs, weights):
    """A chunk of {term: (documents, impacts)}."""
    numbers = sorted(docs)
    return lexical.Chunk(list(range(200)), np.array(numbers, "<i4").tobytes(),
                         np.array([len(docs[t][0]) for t in numbers], "<i4").tobytes(),
                         np.concatenate([docs[t][0] for t in numbers]).astype("<u2").tobytes(),
                         np.concatenate([docs[t][1] for t in numbers]).astype("<i4").tobytes(), weights)


def test_chunk_search_loses_no_document():
    rng = np.random.default_rng(1)
    for _ in range(200):
        docs = {}
        for t in range(12):
            held = np.flatnonzero(rng.random(200) < rng.choice([0.02, 0.2, 0.8]))
            if len(held):
                docs[t] = held, rng.integers(1, 8, len(held))
        weights = {t: int(rng.integers(0, 6)) for t in range(12)}
        chunk = chunk_of(docs, weights)
        units = lexical.pairs_of(list(range(12)), {t: weights[t] for t in docs})
        for u in units:
            if len(u) == 2:
                chunk.intersect(u)
        full = np.zeros(200, int)
        for t, (held, impact) in docs.items():
            full[held] += weights[t] * impact
        least = int(rng.integers(1, full.max() + 2)) if full.max() else 1
        found, score = chunk.search(units, 5, least)
        assert (full[found] == score).all()
        ranked = np.argsort(-full, kind="stable")
        must = {d for d in range(200) if full[d] >= max(least, full[ranked[4]], 1)}
        assert must <= set(found.tolist())


def test_pair_bounds_are_tighter_and_hold():
    docs = {0: (np.arange(0, 100), np.arange(1, 101)), 1: (np.arange(50, 150), np.arange(100, 0, -1))}
    chunk = chunk_of(docs, {0: 1, 1: 1})
    alone = sum(chunk.highest.values())
    chunk.intersect((0, 1))
    assert chunk.bound((0, 1)) == 151 < alone == 200
    assert chunk.lists[0, 1].tolist() == list(range(50, 100))
    for some in (chunk.lists[0, 1], np.zeros(0, "u2"), np.array([3], "u2")):
        assert lexical._unpacked(lexical._packed(some, 200)).tolist() == some.tolist()


def test_windows_agree(monkeypatch):
    text = plain(5000, 4) + " É漢 " + "x" * 300
    whole = [t for some in lexical.split_terms(text) for t in some]
    monkeypatch.setattr(lexical, "WINDOW", 100)
    assert [t for some in lexical.split_terms(text) for t in some] == whole == [t.encode() for t in terms(text)]


def test_odd_rows(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, " ".join(WORDS[:5]), "x"), (None, "漢字 a q", "y"), (2, None, None)],
                                  "item_id long, text string, doc_id string")
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    got = sorted(map(tuple, lexical.rank_documents(odd_docs, items).collect()), key=str)
    assert got == brute(rows, [(1, " ".join(WORDS[:5])), (None, "漢字 a q"), (2, None)])
    assert lexical.rank_documents(no_docs, items).count() == 0
    assert lexical.rank_documents(odd_docs, items.where("false")).count() == 0
