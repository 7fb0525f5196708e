"""Byte-level BPE: encode whole texts from a rank file with the ``tokenizers`` library, decode ids back to bytes.

A rank file names a token's bytes and its rank; any two neighbouring tokens whose bytes join to a ranked token may merge,
lowest rank first. The library wants merges as pairs of token strings instead, so ``merges_of`` lists every split of
every token into two tokens, in order of rank, with each byte written as its printable stand-in character. A pretoken
that is itself a token is taken whole (``ignore_merges``).

Encoding runs over Arrow batches in slices. Chunks in plain Latin characters are split by an equal pattern in Arrow's
regular expressions, others by the given pattern itself.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers.models import BPE

from staylens.llm.common import pick, slices
from staylens.llm.pretokens import (
    BYTE_CHARS, CACHE_ENTRIES, CUT, PLAIN_LETTERS, ids_of_chunks, ids_of_distinct, model_ids,
)

# Chunks of these characters, with single white space only, are split by an equal of the vocabulary's pattern that Arrow's
# regular expressions can run (they have no look-ahead, which matters for runs of white space).
PLAIN_CHUNK = f"^[ \\t\\n\\x0b\\x0c\\r]?([\\x21-\\x7e{PLAIN_LETTERS}]+([ \\t\\n\\x0b\\x0c\\r][\\x21-\\x7e{PLAIN_LETTERS}]+)*)?$"
PLAIN_SPLIT = (rf"'(?:s|t|re|ve|m|ll|d)| ?[A-Za-z{PLAIN_LETTERS}]+| ?[0-9]+| ?[!-/:-@\[-`{{-~]+|[ \t\n\x0b\x0c\r]")

# What sends a text down the other way: white space beside a space, or the mark that cuts texts.
_WHITE = r"\x09-\x0d\x1f\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
SPACE_RUN = f" [{_WHITE}]|[{_WHITE}] |\x1f"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


def merges_of(ranks: dict[bytes, int]) -> list[tuple[bytes, bytes]]:
    """Every split of every token into two tokens, by rank. Splits of one token are listed so that of two overlapping
    places for it the left one merges first, as in the rank rule: the split with the longer head comes first if the
    token's last part also begins it."""
    out = []
    for token, _ in sorted(ranks.items(), key=lambda x: x[1]):
        splits = [k for k in range(1, len(token)) if token[:k] in ranks and token[k:] in ranks]
        splits.sort(key=lambda k: not token.startswith(token[k:]))
        out += [(token[:k], token[k:]) for k in splits]
    return out


class ByteVocabulary:
    """Encoder and decoder of one rank file; one per worker process (see ``byte_vocabulary``)."""

    def __init__(self, path: str, pattern: str, limit: int = CACHE_ENTRIES):
        ranks = read_ranks(path)
        shown = {t: "".join([BYTE_CHARS[b] for b in t]) for t in ranks}
        model = BPE(vocab={shown[t]: r for t, r in ranks.items()}, merges=[(shown[a], shown[b]) for a, b in merges_of(ranks)],
                    ignore_merges=True, cache_capacity=0)
        self.pieces = model_ids(model, limit)
        # White space as Unicode's property has it; Python's own class also holds four control characters.
        self.split = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\S", r"\P{White_Space}")
                                   .replace(r"\s", r"\p{White_Space}"))
        self.token_bytes = {r: t for t, r in ranks.items()}

    def _whole(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.split.findall(text)))

    @staticmethod
    def _cut(chunks: pa.Array) -> pa.ListArray:
        return pc.split_pattern(pc.replace_substring_regex(chunks, f"({PLAIN_SPLIT})", rf"\1{CUT}"), CUT)

    def encode_all(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Ids of each whole text (null: none). A pretoken takes at most one space before it, so a text is cut before
        every space, unless one stands beside other white space: such a text is one chunk."""
        texts = pc.fill_null(texts, "")
        odd = np.asarray(pc.match_substring_regex(texts, SPACE_RUN).to_numpy(zero_copy_only=False), dtype=bool)
        marked = pc.replace_substring(pc.if_else(pa.array(odd), "", texts), " ", CUT + " ")
        cut = ids_of_chunks(pc.split_pattern(marked, CUT), lambda c: ids_of_distinct(
            c, PLAIN_CHUNK, self._cut, self.pieces, self._whole))
        for ids, whole, text in zip(cut, odd.tolist(), texts):
            yield np.frombuffer(self._whole(text.as_py()), "<u4") if whole else ids

    def encode(self, text: str) -> list[int]:
        return next(self.encode_all(pa.array([text], pa.string()))).tolist()

    def decode(self, ids) -> bytes:
        """The bytes of a list of ids: the byte table in reverse. An id without a token raises ``KeyError``."""
        return b"".join(map(self.token_bytes.__getitem__, ids))

    def decode_stream(self, ids) -> list[str]:
        """Text token by token. A character split over tokens comes out with the token that completes it; bytes that
        never complete one come out as U+FFFD, the last of them with the last token."""
        decoder = codecs.getincrementaldecoder("utf-8")(errors="replace")
        last = len(ids) - 1
        return [decoder.decode(self.token_bytes[i], k == last) for k, i in enumerate(ids)]

    def offsets(self, ids) -> list[tuple[int, int]]:
        """(start, end) of each token in code points of the decoded text, every character it touches included."""
        data = np.frombuffer(self.decode(ids), "u1")
        heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])  # characters begun before each byte
        ends = np.cumsum([len(self.token_bytes[i]) for i in ids])
        out, at = [], 0
        for end in ends.tolist():
            inside = at < len(data) and (data[at] & 0xC0) == 0x80  # the token begins within a character
            out.append((int(heads[at]) - bool(inside), int(heads[end])))
            at = end
        return out


@lru_cache(maxsize=2)
def byte_vocabulary(path: str, pattern: str, limit: int = CACHE_ENTRIES) -> ByteVocabulary:
    return ByteVocabulary(path, pattern, limit)


def encode_documents(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id",
                     text_col: str = "text", offsets: bool = False) -> DataFrame:
    """``doc_id, ids`` (and ``starts, ends`` in code points if asked) of every whole text; null text counts as empty."""
    names = ["doc_id", "ids", *(["starts", "ends"] if offsets else [])]
    kinds = [pa.int64(), *[pa.list_(pa.int32())] * (len(names) - 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = byte_vocabulary(vocabulary, pattern)
        for part in slices(batches):
            ids = [x.astype("i4") for x in words.encode_all(part["text"])]
            cols = [part["doc_id"], ids]
            if offsets:
                spans = [words.offsets(x.tolist()) for x in ids]
                cols += [[[s for s, _ in x] for x in spans], [[e for _, e in x] for x in spans]]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) if isinstance(c, list) else c for c, k in zip(cols, kinds)],
                                             names=names)

    ddl = "doc_id long, ids array<int>" + (", starts array<int>, ends array<int>" if offsets else "")
    return _source(docs, id_col, text_col).mapInArrow(run, ddl)


def decode_documents(encoded: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """``doc_id, data`` (binary) from ``doc_id, ids``; null ids give empty data."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = byte_vocabulary(vocabulary, pattern)
        for part in batches:
            data = [words.decode(x or ()) for x in part["ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(data, pa.binary())], names=["doc_id", "data"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, data binary")


def round_trip_digests(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id",
                       text_col: str = "text") -> DataFrame:
    """Encode and decode every whole text in one pass: ``doc_id, n_tokens, ids_sha256, decoded_sha256``.

    Null text counts as empty; null ids and repeated rows are kept; an empty table gives an empty result.
    """
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = byte_vocabulary(vocabulary, pattern)
        for part in slices(batches):
            rows = [(len(ids), hashlib.sha256(ids).hexdigest(), hashlib.sha256(words.decode(ids.tolist())).hexdigest())
                    for ids in words.encode_all(part["text"])]
            yield pa.RecordBatch.from_arrays([
                part["doc_id"], pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()),
                pa.array([r[2] for r in rows], pa.string())], names=names)

    return _source(docs, id_col, text_col).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return pick(docs, doc_id=id_col, text=text_col).withColumns(
        {"doc_id": F.col("doc_id").cast("long"), "text": F.col("text").cast("string")})
