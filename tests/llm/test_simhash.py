import random

import xxhash

from staylens.llm import simhash
from staylens.llm.components import connected_components

from .conftest import plain


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i:i + 4]), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups_of(nodes, linked):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def near_copies():
    base = plain(400, 1).split()
    out = []
    for k in range(40):
        words = list(base)
        words[10 + 9 * (k % 30)] = f"w{k}"
        out.append(" ".join(words))
    return out + [plain(400, 1)] * 5 + [plain(90, s) for s in range(2, 12)] + ["short", "Short", "", None]


def test_components_equal_brute_force(make_docs, odd_docs):
    for docs in (make_docs(near_copies()), odd_docs):
        got = simhash.components(docs).collect()
        prints = [(r.doc_id, brute_fingerprint(r.text)) for r in docs.collect()]
        ids = {d for d, _ in prints if d is not None}
        linked = [(a, b) for a, x in prints for b, y in prints
                  if a is not None and b is not None and a < b and (x ^ y).bit_count() <= 4]
        root = groups_of(ids, linked)
        want = sorted((d, f"{f:016x}", root[d] if d is not None else min(
            (root[b] for b, y in prints if b is not None and (f ^ y).bit_count() <= 4), default=None)) for d, f in prints
            if d is not None)
        assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in got if r.doc_id is not None) == want
        assert len(got) == len(prints)


def test_one_of_each_component_stays(make_docs, odd_docs, no_docs):
    docs = make_docs(near_copies())
    once = simhash.keep_one_of_each(docs.union(docs))
    assert once.columns == docs.columns
    assert sorted(r.doc_id for r in once.collect()) == sorted({r.component_id for r in simhash.components(docs).collect()})
    kept = simhash.keep_one_of_each(odd_docs).collect()
    assert len({brute_fingerprint(r.text) for r in kept}) == len(kept)
    assert simhash.keep_one_of_each(no_docs).collect() == [] and simhash.components(no_docs).collect() == []


def test_links_of_dense_fingerprints(spark):
    rng = random.Random(5)
    centre = rng.getrandbits(63)
    prints = {centre}
    while len(prints) < 150:
        f = centre
        for _ in range(rng.randrange(1, 6)):
            f ^= 1 << rng.randrange(63)
        prints.add(f)
    for bits, segments in ((4, 3), (4, 2), (2, 4)):
        got = {(r.a, r.b) for r in simhash.links(spark.createDataFrame([(f,) for f in prints], "fp long"), bits, segments).collect()}
        assert got == {(a, b) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= bits}


def test_connected_components(spark):
    rng = random.Random(1)
    for edges in ([(rng.randrange(200), rng.randrange(200)) for _ in range(150)], [(i + 1, i) for i in range(120)], [], [(3, 3)]):
        want = groups_of({v for a, b in edges if a != b for v in (a, b)}, [(a, b) for a, b in edges if a != b])
        assert {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()} == want
