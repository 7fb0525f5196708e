import hashlib

import numpy as np
import public_tokenizers
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from staylens.llm import byte_bpe
from staylens.llm.catalog import BYTE_VOCABULARY as PATH

RANKS = byte_bpe.read_ranks(PATH)
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
OURS = byte_bpe.ByteVocabulary(PATH, public_tokenizers.PATTERN, limit=100)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="abcXYZ'sstrevmd09 \t\n\x0b\x1c\x1f!?.,_-ÀÉßÿŁİǅé \u0085 漢к٣½²ªº×😀<|>", max_size=40))
def test_ids_equal_tiktoken_and_decode_back(text):
    ids = LIBRARY.encode_ordinary(text)
    assert OURS.encode(text) == ids
    assert OURS.decode(ids) == text.encode()
    assert "".join(OURS.decode_stream(ids)) == text
    spans = OURS.offsets(ids)
    assert all(text[a:b].encode().find(RANKS_BACK[i]) >= 0 for (a, b), i in zip(spans, ids))


RANKS_BACK = {r: t for t, r in RANKS.items()}


def test_split_character_comes_with_its_last_token():
    ids = OURS.encode("a😀b")
    assert [t for t in OURS.decode_stream(ids) if t] == ["a", "😀", "b"] and OURS.offsets(ids)[1] == (1, 2)
    assert OURS.decode_stream(ids[:2])[-1] == "�"


def test_digests(odd_docs, no_docs):
    got = byte_bpe.round_trip_digests(odd_docs, PATH, public_tokenizers.PATTERN).collect()
    want = []
    for r in odd_docs.collect():
        ids = LIBRARY.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                     hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert byte_bpe.round_trip_digests(no_docs, PATH, public_tokenizers.PATTERN).collect() == []


def test_encode_and_decode_frames(odd_docs):
    encoded = byte_bpe.encode_documents(odd_docs, PATH, public_tokenizers.PATTERN, offsets=True)
    back = byte_bpe.decode_documents(encoded, PATH, public_tokenizers.PATTERN).collect()
    assert sorted(bytes(r.data) for r in back) == sorted((r.text or "").encode() for r in odd_docs.collect())
