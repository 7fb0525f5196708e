import hashlib
import random
import re
import time
from collections import Counter

from staylens.llm import secret_scan as scan

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def brute(text):
    spans = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    spans += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return (*(sum(s[1] == k for s in spans) for k in range(3)), ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(spans)))


POOL = ["password", "TOKEN", "api_key", "ApiKey", "secret", "=", ":", " ", '"', "'", "abcdef", "0123456789abcdef", "abc", "AKIA",
        "ABCDEFGHIJ0123456789", "é", "漢", "😀", "\n", "x", "token=secret=", "passwd:ſecret", "Kelvin Key"]


def test_base_spans_equal_brute_force(make_docs, odd_docs, no_docs):
    rng = random.Random(3)
    docs = make_docs(["".join(rng.choice(POOL) for _ in range(rng.randrange(20))) for _ in range(800)], sources=("a", "b", None))
    docs = docs.union(odd_docs)
    want = Counter((r.doc_id, *brute(r.text or "")[:3], hashlib.sha256(brute(r.text or "")[3].encode()).hexdigest()) for r in docs.collect())
    got = scan.scan(docs).collect()
    assert Counter((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in got) == want
    assert scan.scan(no_docs).collect() == []


def test_ownership_separates_examples_from_live_values(make_docs):
    copied, own, added = "password=copied1234", "token=mine567890", "ghp_" + "a1B2" * 9
    docs = make_docs([f"w {copied} w"] * 90 + [f"w {own} é {added}"] * 3, sources=("s1", "s2", "s3"))
    alone = make_docs([f"w {own} é {added}"] * 50, sources=("s1",))
    by = scan.scan(alone).collect()
    assert {(r.n_live, r.n_example, r.n_repos, r.n_owners) for r in by} == {(2, 0, 50, 1)}
    assert {r.spans for r in by} == {"assign:2:18,vendor:21:61"}
    spread = scan.scan(docs).collect()
    assert {(r.n_live, r.n_example, r.spans) for r in spread if r.doc_id < 90} == {(0, 1, "assign:2:21")}
    assert {(r.n_live, r.n_example, r.spans) for r in spread if r.doc_id >= 90} == {(0, 2, "assign:2:18")}
    # One owner with very many repositories, and as many repositories without an owner.
    many = scan.scan(make_docs([f"w {own} é {added}"] * 200, sources=("s1",))).collect()
    assert {(r.n_live, r.n_example, r.spans, r.n_repos, r.n_owners) for r in many} == {(0, 2, "assign:2:18", 200, 1)}
    assert {(r.n_live, r.n_example, r.n_owners) for r in scan.scan(make_docs([f"w {added}"] * 5, sources=(None,))).collect()} == {(0, 1, 5)}
    assert {(r.n_live, r.n_owners) for r in scan.scan(make_docs([f"w {added}"] * 2, sources=(None,))).collect()} == {(1, 2)}


def test_a_text_of_very_many_matches(make_docs):
    n = 200_000
    text = " é ".join(f"token=v{k:07d}" for k in range(n))
    began = time.monotonic()
    row = scan.scan(make_docs([text])).first()
    assert row.n_assign == n and time.monotonic() - began < 60
    starts = ["assign:%d:%d" % (k * 17, k * 17 + 14) for k in range(n)]
    assert row.spans == ",".join(starts)


def test_only_native_operators(make_docs):
    plan = scan.scan(make_docs(["token=abcdefgh"]))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
