import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from staylens.llm import packing
from staylens.llm.catalog import WORD_VOCABULARY as PATH
from staylens.llm.pretokens import WordVocabulary

LIBRARY = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
LIBRARY.encode_special_tokens = True
OURS = WordVocabulary(PATH, limit=50)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abcXYZ'sstrevmd09 \t\n\x0b\x1c!?.,_-ÀÉßÿŁİǅé \u0085漢к٣½²ªº×😀<|>", max_size=30))
def test_ids_equal_the_library(text):
    assert OURS.encode(text) == LIBRARY.encode(text, add_special_tokens=False).ids


def test_every_plain_character_inside_a_word_equals_the_library():
    odd = [w for c in map(chr, [*range(0x21, 0x7F), *range(0xC0, 0x250)]) for w in (f"q{c}rar", f"Q{c}RAR", f"{c}a", f"AK{c}", c + c)
           if OURS.encode(w) != LIBRARY.encode(w, add_special_tokens=False).ids]
    assert odd == []


def check(docs, capacity=2048):
    got = packing.pack_documents(docs, PATH, capacity=capacity).collect()
    want = Counter()
    for r in docs.collect():
        ids = np.array([*LIBRARY.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        for k, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at:at + capacity]
            want[r.doc_id, k, at, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    inside = defaultdict(list)
    for r in got:
        inside[r.sequence_id].append((r.offset, r.length))
    for places in inside.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return got, len(inside)


def test_pieces_fill_sequences_without_gaps(odd_docs):
    check(odd_docs)
    got, sequences = check(odd_docs, capacity=64)
    assert sequences <= -(-sum(r.length for r in got) // 64) + 1


def test_hot_length_is_spread(make_docs):
    got, sequences = check(make_docs(["one two three four five six seven"] * 3000 + ["one " * k for k in range(200)]).repartition(9))
    assert sequences == -(-sum(r.length for r in got) // 2048)


def test_empty_table(no_docs):
    assert packing.pack_documents(no_docs, PATH).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 100), st.integers(1, 60), max_size=40))
def test_plans_hold_every_piece_once_and_are_tight(histogram):
    plan, rest = packing.fit_patterns(histogram, 100)
    plan = plan + packing.fill_rest(rest, 100)
    used = Counter()
    for pattern, n in plan:
        assert sum(pattern) <= 100 and n > 0
        for x in pattern:
            used[x] += n
    assert used == Counter(histogram)
    free = []  # first fit in order of falling length, piece by piece
    for x in sorted(Counter(histogram).elements(), reverse=True):
        at = next((k for k, room in enumerate(free) if room >= x), len(free))
        free[at:at + 1] = [(free[at] if at < len(free) else 100) - x]
    assert sum(n for _, n in plan) <= 1.05 * len(free) + 2


def test_patterns_carry_most_of_a_large_table():
    rng = np.random.default_rng(0)
    histogram = Counter(np.minimum(2048, rng.lognormal(6, 1, 300_000).astype(int) + 1).tolist())
    plan, rest = packing.fit_patterns(histogram, 2048)
    by_pattern = sum(n for _, n in plan)
    whole = by_pattern + sum(n for _, n in packing.fill_rest(rest, 2048))
    assert by_pattern > 0.7 * whole and whole <= -(-sum(x * n for x, n in histogram.items()) // 2048) + 10


def test_a_hot_length_gets_patterns_of_its_own():
    rng = np.random.default_rng(1)
    lengths = np.concatenate([np.minimum(2048, rng.lognormal(6.3, 1, 40_000).astype(int) + 1), np.full(20_000, 701)])
    histogram = Counter(lengths.tolist())
    plan, rest = packing.fit_patterns(histogram, 2048)
    whole = sum(n for _, n in plan) + sum(n for _, n in packing.fill_rest(rest, 2048))
    assert whole <= sum(n for _, n in packing.fill_rest(histogram, 2048)) * 1.01
