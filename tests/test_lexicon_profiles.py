import math
import random
from collections import Counter, defaultdict

import pytest

from staylens.operators import language_profiles as N
from staylens.operators import lexicon as X
from staylens.operators import sentiment as R


def brute_links(texts, window, least):
    toks = [t.split() for t in texts]
    known = {w for w, n in Counter(w for t in toks for w in set(t)).items() if n >= least}
    n = Counter()
    for t in toks:
        for i, a in enumerate(t):
            for b in t[i + 1:i + 1 + window]:
                if a != b and a in known and b in known:
                    n[a, b] += 1
                    n[b, a] += 1
    of = Counter()
    for (a, _), c in n.items():
        of[a] += c
    total = sum(of.values())
    out = {p: math.log(c * total / (of[p[0]] * of[p[1]])) for p, c in n.items()}
    return {p: x for p, x in out.items() if x > 0}


@pytest.fixture(scope="module")
def reviews(spark):
    rng = random.Random(3)
    good, bad, plain = ["sunny", "tidy", "warm"], ["grim", "leaky", "stale"], [f"w{k}" for k in "abcdefgh"]
    texts = []
    for k in range(300):
        mood, seed = (good, "great") if k % 2 else (bad, "awful")
        words = [*rng.choices(plain, k=5), rng.choice(mood), seed, rng.choice(mood), *rng.choices(plain, k=4)]
        texts.append(" ".join(words))
    return texts, spark.createDataFrame([(k, t) for k, t in enumerate([*texts, None, ""])], "id long, comments string")


def test_links_match_brute_force(reviews):
    texts, df = reviews
    got = {(r.word, r.other): r.ppmi for r in X.word_links(df.selectExpr("id", "translate(comments, '0123456789', 'abcdefghij') comments"),
                                                           window=3, min_reviews=4).collect()}
    want = brute_links(texts, 3, 4)
    assert got.keys() == want.keys() and all(got[p] == pytest.approx(want[p]) for p in want)


def test_polarity_spreads_to_the_words_around_seeds(reviews, spark):
    texts, df = reviews
    lex = {r.word: r.polarity for r in X.induce_lexicon(df, seeds={"great": 0.8, "awful": -1.0}, rounds=3).collect()}
    assert lex["great"] == 0.8 and lex["awful"] == -1.0
    assert all(lex[w] > 0.2 for w in ("sunny", "tidy", "warm")) and all(lex[w] < -0.2 for w in ("grim", "leaky", "stale"))
    unseen = spark.createDataFrame([(1, "sunny and tidy"), (2, "grim, leaky"), (3, "nothing")], "id long, comments string")
    table = spark.createDataFrame(list(lex.items()), "word string, polarity double")
    scored = R.polarity_by_table(unseen, table)
    by = {r.id: r.sentiment for r in scored.collect()}
    assert by[1] > 0 > by[2] and by[3] == 0
    share = X.scored_share(scored).first()
    assert (share.reviews, share.scored) == (3, 2)
    assert X.word_links(df.where("false")).count() == 0


def brute_profiles(train, texts, size=3, alpha=0.5):
    def grams(t):
        import re
        words = re.findall(r"[^\W\d_]+", (t or "").lower())
        s = " " + " ".join(words) + " "
        return [s[i:i + size] for i in range(len(s) - size + 1)] if len(s) >= size else []

    counts, docs = defaultdict(Counter), Counter(lang for _, lang in train if lang)
    for t, lang in train:
        if lang:
            counts[lang].update(grams(t))
    kinds = len({g for c in counts.values() for g in c})
    out = []
    for t in texts:
        gs = grams(t)
        if not gs:
            out.append("en")
            continue
        score = {}
        for lang, c in counts.items():
            total = sum(c.values())
            score[lang] = math.log(docs[lang] / sum(docs.values())) + sum(
                math.log((c[g] + alpha) / (total + alpha * kinds)) for g in gs)
        out.append(min(score, key=lambda x: (-score[x], x)))
    return out


def test_profiles_match_brute_force(spark, monkeypatch):
    train = [("The cat sat on the mat", "en"), ("a dog and the house", "en"), ("der Hund und das Haus", "de"), ("die Katze läuft schnell", "de"),
             ("le chien est dans la maison", "fr"), ("une chaise à côté", "fr"), ("x", None), (None, "fr"), ("кошка и собака", "ru")]
    texts = ["the house", "das Haus und", "la maison", "собака", "", None, "123 ...", "é", "schnell the côté", "a"]
    tdf = spark.createDataFrame(train, "comments string, lang string")
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id long, comments string")
    want = brute_profiles(train, texts)
    for rows in (N.PROFILE_ROWS, 3):
        monkeypatch.setattr(N, "PROFILE_ROWS", rows)
        got = {r.id: r.lang_pred for r in N.tag_by_profiles(df, *N.learn_profiles(tdf)).collect()}
        assert [got[k] for k in range(len(texts))] == want


def test_scores_are_planned_once(spark):
    df = spark.createDataFrame([(1, "good not good")], "id long, comments string")
    plan = R.score_reviews(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1


@pytest.mark.parametrize("broadcast", [X.BROADCAST_WORDS, 2])
def test_a_pair_is_stored_once_and_rare_words_never(reviews, spark, monkeypatch, broadcast):
    texts, df = reviews
    plain = [*["warm great warm"] * 3, "warm rare great", "great"]
    rv = spark.createDataFrame([(k, t) for k, t in enumerate(plain)], "id long, comments string")
    monkeypatch.setattr(X, "BROADCAST_WORDS", broadcast)
    monkeypatch.setattr(R, "BROADCAST_WORDS", broadcast)
    known, pairs, words = X.pair_counts(rv, min_reviews=2)
    assert words == 2 and {r.word for r in known.collect()} == {"warm", "great"}
    assert [(r.a < r.b, r.n) for r in pairs.collect()] == [(True, 7)]
    named = df.selectExpr("id", "translate(comments, '0123456789', 'abcdefghij') comments")
    got = {(r.word, r.other): r.ppmi for r in X.word_links(named, window=3, min_reviews=4).collect()}
    want = brute_links(texts, 3, 4)
    assert got.keys() == want.keys() and all(got[p] == pytest.approx(want[p]) for p in want)
    table = spark.createDataFrame([("good", 1.0), ("good", 0.5), ("bad", -1.0), ("odd", 0.0)], "word string, polarity double")
    two = spark.createDataFrame([(1, "good good not bad"), (2, "x"), (3, None)], "id long, comments string")
    assert {r.id: r.sentiment for r in R.polarity_by_table(two, table).collect()} == {1: 0.5, 2: 0.0, 3: 0.0}


def test_profile_tags_read_the_texts_once_and_agree_with_the_general_way(spark, monkeypatch):
    rows = [(1, "the house and the garden", "en"), (2, "das haus und der garten", "de"), (3, "la casa y el jardin", "es"),
            (4, "the house", None), (5, None, "en"), (6, "123", "de"), (7, "und das", None)]
    df = spark.createDataFrame(rows, "id long, comments string, lang string")
    profiles, languages = N.learn_profiles(df)
    few = N.tag_by_profiles(df, profiles, languages)
    assert few._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") <= 3
    tags = {r.id: r.lang_pred for r in few.collect()}
    assert tags[4] == "en" and tags[7] == "de" and tags[5] == tags[6] == "en"
    monkeypatch.setattr(N, "MOST_COLUMNS", 1)
    many = N.tag_by_profiles(df, profiles, languages)
    assert {r.id: r.lang_pred for r in many.collect()} == tags
    assert few._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") < many._jdf.queryExecution(
        ).optimizedPlan().toString().count("regexp_extract_all")
    assert {r.lang_pred for r in N.tag_by_profiles(df, profiles, languages.limit(0)).collect()} == {"en"}
