import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from staylens.llm import quality_rules as q

from .conftest import plain


def brute(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    triples = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    counts = Counter(triples)
    in_repeat = {i + j for i, t in enumerate(triples) if counts[t] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)),
            sum(x in lines[:i] for i, x in enumerate(lines)), len(in_repeat))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab \n\t\x0b#|é \x1c", max_size=60))
def test_measures_equal_brute_force(text):
    assert q.measure(text)[:5] == brute(text)


def test_ledger_policies_and_ablation(odd_docs, no_docs, make_docs):
    docs = odd_docs.union(make_docs([plain(200), "# | " * 80 + plain(60, 1), "SHOUT!! " * 30 + "THIS TEXT " * 20, "same line\n" * 60]))
    rows = q.apply_policy(q.ledger(docs)).collect()
    assert len(rows) == docs.count()
    for r in rows:
        failed = r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words
        assert r.base_failed == failed and not (failed and r.kept)
        assert bool(r.fail_bits & q.BIT["too_few_words"]) == (r.n_words < 50)
    kept = [r for r in rows if r.kept]
    assert sum(r.n_words == 200 for r in kept) == 1 and all(r.n_symbols == 0 for r in kept)
    good = {tuple(r[m] for m in q.MEASURES) for r in kept}
    assert sorted(r.text for r in q.keep_documents(docs).collect()) == sorted(
        d.text for d in docs.collect() if q.measure(d.text or "") in good)
    assert q.keep_documents(docs).columns == docs.columns
    reject = q.POLICIES[q.CURRENT]
    for a in q.ablation(q.ledger(docs)).collect():
        bit = q.BIT[a.rule]
        assert (a.n_failed, a.n_only_this, a.n_kept_without) == (
            sum(bool(r.fail_bits & bit) for r in rows), sum(r.fail_bits & reject == bit for r in rows),
            sum(r.fail_bits & reject & ~bit == 0 for r in rows))
    assert q.ledger(no_docs).collect() == [] and q.keep_documents(no_docs).collect() == []
