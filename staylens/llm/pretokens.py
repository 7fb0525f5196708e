"""Batch token ids through bounded caches of chunks of text.

Both vocabularies split a text into pretokens that are merged independently, and texts repeat their words. So Arrow
splits a slice of texts into chunks at places where no pretoken can cross, finds the distinct chunks by its dictionary,
splits those into pretokens and finds the distinct ones again. Only pretokens that a worker's cache lacks go to the
``tokenizers`` library. numpy puts the ids of each chunk and then of each text together.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism

import numpy as np  # noqa: E402
import pyarrow as pa  # noqa: E402
import pyarrow.compute as pc  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

# A worker's cache is emptied when it holds so many pretokens (about 85 MB); results don't depend on it.
CACHE_ENTRIES = 400_000
# A mark that no chunk holds where one is split by it.
CUT = "\x1f"


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies (a rule, not a table)."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


BYTE_CHARS = byte_characters()


def packed(ids: list[int]) -> bytes:
    return np.asarray(ids, dtype="<u4").tobytes()


def as_byte_chars(piece: str) -> str:
    return "".join([BYTE_CHARS[b] for b in piece.encode("utf-8", "surrogatepass")])


class Cache(dict):
    """text -> packed little-endian ids; a miss calls ``make``."""

    def __init__(self, make: Callable[[str], bytes], limit: int):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, text: str) -> bytes:
        if len(self) >= self.limit:
            self.clear()
        out = self[text] = self.make(text)
        return out


def model_ids(model, limit: int) -> Cache:
    """pretoken -> packed ids by a byte-level model of the library."""
    return Cache(lambda piece: packed([t.id for t in model.tokenize(as_byte_chars(piece))]), limit)


class Ragged:
    """Id lists of many chunks, one after the other."""

    def __init__(self, flat: np.ndarray, lengths: np.ndarray):
        self.flat, self.lengths = flat, lengths
        self.firsts = np.cumsum(lengths) - lengths

    @classmethod
    def of(cls, parts: list[bytes]) -> Ragged:
        return cls(np.frombuffer(b"".join(parts), "<u4"), np.fromiter(map(len, parts), "i8", len(parts)) // 4)

    def take(self, codes: np.ndarray) -> np.ndarray:
        """The ids of these chunks, one after the other."""
        n = self.lengths[codes]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(n) else 0
        return self.flat[np.repeat(self.firsts[codes] - ends + n, n) + np.arange(total)]


def ids_of_pieces(pieces: pa.ListArray, ids: Cache) -> Ragged:
    """Ids of each list of pretokens. An empty pretoken has none."""
    coded = pieces.flatten().dictionary_encode()
    table = Ragged.of([ids[p] if p else b"" for p in coded.dictionary.to_pylist()])
    codes = np.asarray(coded.indices)
    sums = np.concatenate([[0], np.cumsum(table.lengths[codes])])
    offsets = np.asarray(pieces.offsets) - pieces.offsets[0].as_py()
    return Ragged(table.take(codes), np.diff(sums[offsets]))


def ids_of_chunks(chunks: pa.ListArray, encode: Callable[[pa.Array], Ragged]) -> Iterator[np.ndarray]:
    """For each list of chunks, the ids of its chunks one after the other; ``encode`` sees the distinct chunks."""
    offsets = np.asarray(chunks.offsets)
    coded = chunks.values.dictionary_encode()
    table = encode(coded.dictionary)
    codes = np.asarray(coded.indices)
    for at, to in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        yield table.take(codes[at:to])


def ids_of_distinct(chunks: pa.Array, plain: str, cut: Callable[[pa.Array], pa.ListArray], ids: Cache,
                    other: Callable[[str], bytes]) -> Ragged:
    """Ids of distinct chunks: those that match ``plain`` are cut into pretokens by Arrow, each other one goes to ``other``."""
    fast = np.asarray(pc.match_substring_regex(chunks, plain).to_numpy(zero_copy_only=False), dtype=bool)
    if fast.all():
        return ids_of_pieces(cut(chunks), ids)
    quick = ids_of_pieces(cut(chunks.filter(pa.array(fast))), ids)
    slow = Ragged.of([other(c) for c in chunks.filter(pa.array(~fast)).to_pylist()])
    both = Ragged(np.concatenate([quick.flat, slow.flat]), np.concatenate([quick.lengths, slow.lengths]))
    place = np.empty(len(chunks), "i8")
    place[np.flatnonzero(fast)] = np.arange(len(quick.lengths))
    place[np.flatnonzero(~fast)] = np.arange(len(quick.lengths), len(both.lengths))
    return Ragged(both.take(place), both.lengths[place])


WORD_LETTERS = "a-zß-öø-ɏ"
# Words in these characters are split here as the vocabulary's own normaliser and splitter do; any other goes to the
# library whole. Latin letters with marks up to U+024F are single, composed letters; those whose lower case is longer or
# lies outside WORD_LETTERS (as of Ə, Ɔ and İ) aren't among them.
PLAIN_LETTERS = "".join(c for c in map(chr, range(0xC0, 0x250)) if re.fullmatch(f"[{WORD_LETTERS}]", c.lower()))
PLAIN_WORD = f"^[\x21-\x7e{PLAIN_LETTERS}]*$"
WORD_PRETOKENS = rf"[{WORD_LETTERS}]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[!-/:-@\[-`{{-~]+"


class WordVocabulary:
    """Ids of a lower-casing, word-end BPE file (``word_bpe``): no special tokens are added or recognised."""

    def __init__(self, path: str, limit: int = CACHE_ENTRIES):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.pieces = model_ids(self.tokenizer.model, limit)

    def _whole(self, word: str) -> bytes:
        return packed(self.tokenizer.encode(word, add_special_tokens=False).ids)

    @staticmethod
    def _cut(words: pa.Array) -> pa.ListArray:
        marked = pc.replace_substring_regex(pc.utf8_lower(words), f"({WORD_PRETOKENS})", rf"\1{CUT}")
        return pc.split_pattern(marked, CUT)

    def encode_all(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Ids of each whole text (null: none). ASCII white space separates pretokens in any text, and no
        normalisation crosses it."""
        words = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        return ids_of_chunks(words, lambda c: ids_of_distinct(c, PLAIN_WORD, self._cut, self.pieces, self._whole))

    def encode(self, text: str) -> list[int]:
        return next(self.encode_all(pa.array([text], pa.string()))).tolist()


@lru_cache(maxsize=2)
def word_vocabulary(path: str, limit: int = CACHE_ENTRIES) -> WordVocabulary:
    """One vocabulary per worker process and path."""
    return WordVocabulary(path, limit)
