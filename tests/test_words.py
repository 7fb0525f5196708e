import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from staylens.operators import lexicon as X
from staylens.operators import sentiment as R
from staylens.operators import words as W


@pytest.fixture
def texts():
    rng = random.Random(4)
    return [rng.choices([chr(97 + k) * 2 for k in range(20)], k=rng.choice([0, 1, 7, 40])) for _ in range(50)]


def test_words_of_one_hash_are_told_apart(monkeypatch):
    words = pa.chunked_array([["x", "y"], ["z"]])
    for same in (False, True):
        if same:
            monkeypatch.setattr(W, "_hashed", lambda w: np.full(len(w), 7, "u8"))
        table = W.word_table(words, pa.chunked_array([[1.0, 2.0, 3.0]]))
        at = W.places(table, pa.array(["z", "n", "x", "y", ""]))
        assert [float(table.values[i]) if i >= 0 else None for i in at] == [3.0, None, 1.0, 2.0, None]
    empty = W.word_table(words.slice(0, 0), pa.chunked_array([pa.array([], pa.float64())]))
    assert (W.places(empty, pa.array(["x"])) == -1).all()


def brute_pairs(texts, ids, window):
    n = Counter()
    for t in texts:
        for i, v in enumerate(t):
            for w in t[i + 1:i + 1 + window]:
                if v != w and v in ids and w in ids:
                    n[min(ids[v], ids[w]), max(ids[v], ids[w])] += 1
    return n


@pytest.mark.parametrize("limits", [{}, {"SLICE_TOKENS": 9, "HELD_PAIRS": 12, "TILE_PAIRS": 300}])
def test_pairs_are_counted_across_slices_tiles_and_tasks(texts, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(W, name, value)
    ids = {chr(97 + k) * 2: (7 * k) % 18 for k in range(18)}  # two words are unknown
    table = W.word_table(pa.chunked_array([list(ids)]), pa.chunked_array([pa.array(ids.values(), pa.int64())]))
    tiles = W.Tiles.of(len(ids), 4 * sum(map(len, texts)))
    assert (tiles.side > 1) == bool(limits)
    tasks = [[texts[:20], [None, []]], [texts[20:]], []]
    parts = [r for task in tasks for r in W.counted([pa.record_batch([pa.array(b, pa.list_(pa.string()))], ["t"]) for b in task], table, tiles, 4)]
    parts = [pa.Table.from_batches(parts).sort_by("tile").combine_chunks().to_batches()[0]]
    got = [tuple(r.values()) for b in W.added(parts, tiles) for r in b.to_pylist()]
    want = brute_pairs(texts, ids, 4)
    assert len(got) == len(want) and {(a, b): n for a, b, n in got} == want


def test_a_large_lexicon_shuffles_a_row_a_review(spark, monkeypatch):
    rows = [(1, "good good not bad"), (2, "x"), (3, None), (None, "good"), (5, "not"), (5, "good bad"), (6, "")]
    df = spark.createDataFrame(rows, "id long, comments string")
    lexicon = spark.createDataFrame([("good", 1.0), ("good", 0.5), ("bad", -1.0), ("odd", 0.0), (None, 1.0), ("not", None)], "word string, polarity double")
    want = sorted(map(str, R.polarity_by_table(df, lexicon).collect()))
    monkeypatch.setattr(R, "BROADCAST_WORDS", 2)
    scored = R.polarity_by_table(df, lexicon)
    assert sorted(map(str, scored.collect())) == want
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert "explode" not in plan.lower()  # before, tokens were rows that were shuffled by review and word
    monkeypatch.setattr(W, "MOST_WORDS", 2)
    assert sorted(map(str, R.polarity_by_table(df, lexicon).collect())) == want


def test_pairs_of_many_words_are_the_same_with_and_without_a_table(spark, texts, monkeypatch):
    df = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "id long, comments string").repartition(3)
    named = {}
    for most in (W.MOST_WORDS, 3):
        monkeypatch.setattr(W, "MOST_WORDS", most)
        known, pairs, words = X.pair_counts(df)
        ids = {r.id: r.word for r in known.collect()}
        assert words == 20 and sorted(ids) == list(range(20)) and pairs.where("a >= b").count() == 0
        named[most] = sorted((*sorted((ids[r.a], ids[r.b])), r.n) for r in pairs.collect())
    first, second = named.values()
    assert first == second and len(first) == len({x[:2] for x in first})


def test_links_of_many_words_are_named_without_a_shuffle(spark, texts, monkeypatch):
    df = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "id long, comments string")
    want = sorted((r.word, r.other, round(r.ppmi, 9)) for r in X.word_links(df).collect())
    monkeypatch.setattr(X, "BROADCAST_WORDS", 3)
    links = X.word_links(df)
    assert "hashpartitioning" not in links._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.word, r.other, round(r.ppmi, 9)) for r in links.collect()) == want
