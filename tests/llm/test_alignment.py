import hashlib
import random
from collections import Counter
from functools import lru_cache

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from staylens.llm import alignment
from staylens.llm.pretokens import BYTE_CHARS
from tests.llm.conftest import plain

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
NAMES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def tokens(text, a, b):
    """(id, end byte) of both encodings of the whole text, and the joined bytes."""
    shown = {c: k for k, c in enumerate(BYTE_CHARS)}
    out = []
    ids = a.encode(" " + text, add_special_tokens=False).ids
    out.append([(i, bytes([shown[c] for c in a.id_to_token(i)])) for i in ids])
    out.append([(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode())
                for i in b.encode(text)])
    return out


@lru_cache
def libraries():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def brute(texts):
    a, b = libraries()
    docs, counts = [], Counter()
    for text in texts:
        x, y = tokens(text, a, b) if text else ([], [])
        data = (" " + text).encode() if text else b""
        if b"".join(t for _, t in x) != data or b"".join(t for _, t in y) != data:
            x, y = [], []
        ends = [{int(e): k for k, e in enumerate(np.cumsum([len(t) for _, t in z]))} for z in (x, y)]
        common = sorted(set(ends[0]) & set(ends[1]))
        links = [(x[ends[0][e]][0], y[ends[1][e]][0]) for e in common]
        groups, p, q = [], 0, 0
        for e in common:
            groups.append(",".join(str(i) for i, _ in x[p:ends[0][e] + 1]) + "|" + ",".join(str(i) for i, _ in y[q:ends[1][e] + 1]))
            p, q = ends[0][e] + 1, ends[1][e] + 1
        counts.update(links)
        docs.append((x, y, links, groups))
    top = Counter()
    for (i, j), n in counts.items():
        top[j] = max(top[j], n)
    return [(len(x), len(y), len(g), len(li), sum(counts[p] == top[p[1]] for p in li), sum(counts[p] for p in li),
             hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for x, y, li, g in docs], counts


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    odd = [" a", "a ", "  a  b", "a\n b", "a \n b\tc", "x▁y z", "<|endoftext|> <s> <unk> <0x0A>", "naïve façade 漢字 😀 🤷‍♂️", "\x00 \x1f b",
           "a  b   c", "it's we'll DON'T 12345 !!! ...", "```\n    def f(x):\n        return x\n```", "\r\n\r\n ;\r", "ﬁ①½", " ", "\n",
           "　 \x85 q", "x" * 3000]
    mixed = ["".join(rng.choices(" \n\tab,.'漢é😀0▁", k=rng.randrange(1, 60))) for _ in range(400)]
    return [None, "", *odd, *mixed, *[plain(rng.randrange(1, 300), k) for k in range(200)], plain(50000, 1)]


def test_matches_both_libraries(make_docs, texts):
    got = {r.doc_id: tuple(r[c] for c in NAMES) for r in alignment.align_documents(make_docs(texts), A, B).collect()}
    want, _ = brute(texts)
    assert [got[k] for k in range(len(texts))] == want


def test_small_chunks_and_windows_agree(make_docs, texts, monkeypatch):
    want, counts = brute(texts)
    words = alignment.Aligner(A, B, limit=50)
    monkeypatch.setattr(alignment, "WINDOW", 64)
    seg = words.segment_numbers(texts[-1])
    words.learn()
    assert words.digest(seg) == want[-1][-1] and words.n_a[seg].sum() == want[-1][0]


def test_pair_and_token_counts(make_docs, texts):
    cells = alignment.postings(make_docs(texts).repartition(5), A, B)
    pairs = {(r.a, r.b): (r.n_docs, r.n_links) for r in alignment.pair_scores(cells).collect()}
    per_doc = [brute([t])[1] for t in texts]
    links, docs, by_b = Counter(), Counter(), Counter()
    for c in per_doc:
        links.update(c)
        docs.update(c.keys())
        by_b.update({j for _, j in c})
    assert pairs == {p: (docs[p], links[p]) for p in links}
    assert {r.token: r.n_docs for r in alignment.token_documents(cells, "b").collect()} == dict(by_b)


def test_containers():
    rng = np.random.default_rng(3)
    sets = [np.sort(rng.choice(1 << 16, n, replace=False)).astype("<u2") for n in (1, 4095, 4096, 30000)]
    packed = [s.tobytes() if len(s) < alignment.DENSE else alignment.bits_of(s) for s in sets]
    assert all((alignment.members(p) == s).all() for p, s in zip(packed, sets))
    assert alignment.or_popcount(packed) == len(set(np.concatenate(sets).tolist()))


def test_dense_pairs(spark):
    docs = spark.createDataFrame([(k, "a b a" if k % 2 else "a") for k in range(9000)], "doc_id long, text string").coalesce(1)
    got = alignment.align_documents(docs, A, B).collect()
    want, _ = brute(["a b a" if k % 2 else "a" for k in range(9000)])
    assert sorted((r.doc_id, *[r[c] for c in NAMES]) for r in got) == [(k, *w) for k, w in enumerate(want)]


def test_odd_rows(odd_docs, no_docs):
    got = alignment.align_documents(odd_docs, A, B).collect()
    assert len(got) == odd_docs.count() and all(r.n_a == r.count_sum == 0 and r.groups_sha256 == "" for r in got if r.n_b == 0)
    assert sum(r.n_b == 0 for r in got) == odd_docs.where("text is null or text = ''").count()
    assert alignment.align_documents(no_docs, A, B).count() == 0
