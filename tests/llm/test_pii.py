import hashlib
import random
import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from staylens.llm import boosting, pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute(text):
    def digits(s):
        return re.sub("[^0-9]", "", s)

    def luhn(s):
        return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(s[::-1])) % 10 == 0

    return {"email": [m.span() for m in EMAIL.finditer(text)],
            "ip": [m.span() for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))],
            "card": [m.span() for m in CARD.finditer(text) if 13 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))],
            "phone": [m.span() for m in PHONE.finditer(text) if 9 <= len(digits(m[0])) <= 15]}


PARTS = ["4111111111111111", "+1 (743) 555-3824", "192.168.0.1", "a.b@c.de", "é", "@", ".", " ", "  ", "-", "+", "1", "23", "456",
         "7890", "255", "256", "x", "(", ")", "0001", "٣", "\n", "0", "a@b", "c.d", "@e.f-g", "5500 0000 0000 0004"]


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=14))
def test_base_spans_equal_brute_force(parts):
    text = "".join(parts)
    assert pii.base_spans(text)[0] == brute(text)


def corpus():
    rng = random.Random(0)
    out = []
    for k in range(600):
        made = {0: f"call +1 ({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)} now", 1: f"order {rng.randrange(10**9, 10**10)} sent",
                2: f"from 10.{rng.randrange(256)}.{rng.randrange(256)}.7 came", 3: f"mail x{k}@mail.example.com please",
                4: f"hash ab{rng.randrange(10**11)}cd", 5: "nothing here"}[k % 6]
        out.append(f"word {made} word")
    return out


def test_detect_and_redact(make_docs, odd_docs, no_docs):
    docs = make_docs(corpus()).union(odd_docs)
    got = pii.detect(docs).collect()
    want = Counter()
    for r in docs.collect():
        b = brute(r.text or "")
        base = pii.joined(b, pii.KINDS)
        want[(r.doc_id, *(len(b[k]) for k in pii.KINDS), hashlib.sha256(base.encode()).hexdigest())] += 1
        assert all(g.spans.startswith(base) for g in got if g.doc_id == r.doc_id and g.base_sha256 == hashlib.sha256(base.encode()).hexdigest())
    assert Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got) == want
    red = pii.redact(docs)
    assert red.columns == docs.columns and red.count() == docs.count()
    texts = {r.doc_id: r.text for r in red.collect() if (r.text or "").startswith("word ")}
    assert texts[0] == "word call [PHONE] now word" and texts[3] == "word mail [EMAIL] please word"
    assert texts[5] == "word nothing here word" and all("[" not in texts[k] for k in range(4, 600, 6))
    assert pii.detect(no_docs).collect() == [] and pii.redact(no_docs).collect() == []


def test_boosted_trees_learn_and_calibrate():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((4000, 5))
    y = (((x[:, 0] > 0.3) & (x[:, 1] > -0.2)) | (x[:, 2] > 1)).astype(float)
    trees = boosting.BoostedTrees().fit(x[:3000], y[:3000], np.ones(3000))
    p = trees.probability(x[3000:])
    assert ((p > 0.5) == y[3000:]).mean() > 0.93
    t = boosting.calibrated_threshold(p, y[3000:], np.ones(1000), 0.98)
    assert y[3000:][p >= t].mean() >= 0.98 and (p >= t).sum() > 200
    one = boosting.BoostedTrees().fit(x[:10], np.ones(10), np.ones(10))
    assert not one.fitted and boosting.calibrated_threshold(np.zeros(0), np.zeros(0), np.zeros(0), 0.9) == float("inf")


def test_overlaps_are_masked_once():
    none = pii.Detector(boosting.BoostedTrees(), float("inf"))
    assert pii.masked("+4 111 1111 11111111 a@b.cc.", none) in ("[PHONE] [EMAIL].", "+[CARD] [EMAIL].", "[PHONE][CARD] [EMAIL].")
    assert pii.masked("x", none) == "x"


def test_every_number_of_a_list_is_a_candidate():
    for text in ("030 1234567 0171 2345678 0172 3456789", "(555) 123-4567 (555) 123-4568 (555) 123-4569", "2019. 555-123-4567"):
        spans = {text[a:b] for a, b, _, _ in pii.propose(text)[1]}
        assert spans >= {m[0] for m in re.finditer(r"0[0-9]+ [0-9]{7}|555\)? ?-?123-[0-9]{4}", text)}
    many = "1234567 " * 2000
    assert len(pii.propose(many)[1]) <= 3 * 2000


def test_planted_data_without_a_base_span_is_added(make_docs):
    rng = random.Random(1)
    clean = corpus()[1::6] + [f"on 2019-0{k % 9 + 1}-1{k % 10} there were {rng.randrange(10**7, 10**8)}" for k in range(100)]
    planted = [f"word call (555) {rng.randrange(200, 999)}-{rng.randrange(1000, 9999)} now" for _ in range(60)]
    planted += [f"word write to user{k}(at)mail(dot)com please" for k in range(60)]
    got = {r.doc_id: r for r in pii.detect(make_docs(planted + clean)).collect()}
    assert sum(got[k].n_likely == 1 for k in range(60)) >= 54 and sum(got[k].n_likely == 1 for k in range(60, 120)) >= 54
    assert sum(got[k].n_likely for k in range(120, len(got))) <= 2


def test_more_rows_than_the_driver_fits_are_all_learned_from(make_docs):
    rng = random.Random(2)
    texts = corpus() + [f"at {rng.randrange(10**6)}{' ' * (k % 3)} {rng.randrange(10**4)} {k}-{k}.{k}, tel 0{rng.randrange(10**9)}" for k in range(300)]
    rows = pii.candidates(make_docs(texts)).persist()
    here, jobs = pii.train(rows), pii.train(rows, most=10)
    x = np.array([f for r in rows.collect() for f in r.features], "f8").reshape(-1, pii.FEATURES)
    rows.unpersist()
    assert len(jobs.trees.fitted) == len(here.trees.fitted) and abs(jobs.trees.base - here.trees.base) < 1e-4
    assert np.mean(jobs.selected(x) == here.selected(x)) >= 0.99 and here.selected(x).any()


def test_trees_and_threshold_by_jobs_equal_those_in_memory(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(0, 40, (900, 4)).astype("f8")
    y = ((x[:, 0] > 11) & (x[:, 1] > 7) | (rng.random(900) < 0.05)).astype("f8")
    weight = np.sqrt(rng.integers(1, 9, 900).astype("f8"))
    rows = spark.createDataFrame([(r.tolist(), float(a), float(w)) for r, a, w in zip(x, y, weight)], "x array<float>, y double, weight double").coalesce(2)
    here, jobs = (boosting.BoostedTrees(trees=10) for _ in range(2))
    p = here.fit(x, y, weight).probability(x)
    assert np.allclose(jobs.fit_rows(rows).probability(x), p, atol=1e-3)
    scored = spark.createDataFrame([(float(a), float(b), float(w)) for a, b, w in zip(p, y, weight)], "p double, y double, weight double")
    for precision in (0.5, 0.9, 0.97, 1.0):
        assert boosting.threshold_of_rows(scored, precision) == boosting.calibrated_threshold(p, y, weight, precision)
    assert boosting.threshold_of_rows(scored.filter("p > 2"), 0.5) == float("inf")
