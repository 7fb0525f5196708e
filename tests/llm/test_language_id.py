from math import log2

import pyarrow as pa

from staylens.llm import language_id as lid

LANGS = {"en": "the of and to in that was with for thing ation", "fr": "le de la et des que les dans une est pour eau",
         "de": "der die und das ist nicht von mit ein auch ung"}


def sample(n, lang):
    words = LANGS[lang].split()
    return " ".join(words[(n * 3 + k * k) % len(words)] + words[(n + k) % len(words)] * (k % 2) for k in range(12 + n % 9))


def code_length(text, lang, counts):
    """PPM by hand: method C escapes, contexts up to ORDER bytes that stop at the word."""
    bits = 0.0
    for word in text.lower().split():
        coded = b" " + word.encode() + b" "
        for at in range(1, len(coded)):
            for k in range(min(lid.ORDER, at), -2, -1):
                if k < 0:
                    bits += 8
                    break
                seen = {g[-1:]: n for (la, g), n in counts.items() if la == lang and len(g) == k + 1 and g[:-1] == coded[at - k:at]}
                if not seen:
                    continue
                whole = sum(seen.values()) + len(seen)
                if coded[at:at + 1] in seen:
                    bits -= log2(seen[coded[at:at + 1]] / whole)
                    break
                bits -= log2(len(seen) / whole)
    return bits


def test_code_lengths_equal_ppm_by_hand():
    from collections import Counter
    counts = Counter()
    for lang in LANGS:
        for word in sample(1, lang).split():
            coded = b" " + word.encode() + b" "
            for at in range(1, len(coded)):
                for k in range(min(lid.ORDER, at) + 1):
                    counts[lang, coded[at - k:at + 1]] += 1
    model = lid.build_model(sorted(LANGS), [(la, g, n) for (la, g), n in counts.items()])
    texts = ["that was le zebra", "der eau", "ünd x", sample(2, "fr")]
    bits, n = model.text_lengths(pa.array(texts))
    for row, text in zip(bits, texts):
        for value, lang in zip(row, sorted(LANGS)):
            assert abs(value - code_length(text, lang, counts)) < 1e-6
    assert n.tolist() == [len(" ".join(t.split()).encode()) + 1 for t in texts]


def test_held_out_accuracy_and_odd_rows(spark, make_docs, odd_docs, no_docs):
    langs = sorted(LANGS)
    docs = make_docs([sample(k, langs[k % 3]) for k in range(600)], langs)
    got = lid.identify(docs).collect()
    truth = {r.doc_id: r.lang for r in docs.collect()}
    held = [r for r in got if r.held_out]
    assert 100 < len(held) < 200 and sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in got)
    odd = lid.identify(docs.union(odd_docs))
    assert odd.count() == docs.count() + odd_docs.count()
    assert {r.lang_pred for r in odd.join(odd_docs.filter("text is null or trim(text) = ''").select("doc_id"), "doc_id").collect()
            if r.doc_id is None or r.doc_id > 600} <= {"und"}
    assert {r.lang_pred for r in lid.identify(odd_docs.withColumn("lang", odd_docs.lang.substr(9, 1)).filter("false")).collect()} == set()
    assert lid.identify(no_docs).collect() == [] and lid.keep_documents(no_docs).collect() == []


def test_nothing_labelled_gives_und(make_docs):
    docs = make_docs(["some words", "12 34", None], (None,))
    assert {(r.lang_pred, r.score) for r in lid.identify(docs).collect()} == {("und", 0.0)}
    assert [r.text for r in lid.keep_documents(docs).collect()] == ["some words"]


def test_keep_rejects_what_no_language_explains(make_docs):
    langs = sorted(LANGS)
    docs = make_docs([sample(k, langs[k % 3]) for k in range(300)], langs).union(
        make_docs(["щука жизнь мышь чайка " * 20, "1234 5678 | 99"], (None,)).selectExpr(
            "doc_id + 300 as doc_id", "* except (doc_id)"))
    kept = lid.keep_documents(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == list(range(300))
