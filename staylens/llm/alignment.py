"""Cross-tokenizer alignment: which tokens of two vocabularies end together, and how often in the whole corpus.

Each text is encoded by a byte-level vocabulary A (``tokenizers``) and a piece vocabulary B (``sentencepiece``). The byte
offsets where a token of either ends cut both sequences into groups; the two tokens that end at such an offset are linked.

Method, inverted pair bitmaps. One text pass numbers the documents within chunks and writes, for each linked id pair of a
chunk, the compressed bitmap of the documents that hold it (16-bit numbers, or 8,192 bytes of bits from 4,096 documents
on) and multiplicity planes: plane k has the documents in which the pair's links beyond the first have bit k set.
Chunks hold different documents, so popcounts add up over them: documents of a pair are the popcounts of its bitmaps,
links those plus 2^k times the popcounts of plane k. Bitmaps of several pairs are OR-merged per chunk first
(``token_documents``). A score goes back along the postings: a pair meets its score with one narrow row a chunk,
however common it is, and a chunk's postings hand the scores to their documents.

Segments. Neither vocabulary has a token across the start of a run of spaces (``Aligner`` checks B's pieces; A's pattern
ends every pretoken before white space), so a text is cut there, and a segment's tokens and links are found once per
distinct segment.

Bounds: a chunk closes at ``CHUNK_DOCS`` documents or once it holds ``CHUNK_LINKS`` (document, pair) entries; a longer text
just makes its chunk larger, by at most its distinct pairs. Nothing is capped.

Odd rows: a text that is null, empty, or whose joined token bytes differ from a space and the text (U+2581 in it, for
one) has zeros and an empty ``groups_sha256``. Null and repeated ids and repeated rows are documents of their own. An
empty table gives an empty result. Further columns are left out.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from staylens.llm.common import pick, slices, written
from staylens.llm.pretokens import BYTE_CHARS

CHUNK_DOCS = 1 << 16
CHUNK_LINKS = 4_000_000
DENSE = 4096          # from so many documents on a container is a bitmap
CACHE_SEGMENTS = 100_000
SLICE_BYTES = 2 << 20
WINDOW = 1 << 21      # a longer text is split into segments window by window
ID_BITS = 23          # of a token id in a pair's key

DOCUMENT, MEMBERS = -2, -1  # ``plane`` of a document's row, of a pair's document bitmap; planes of links follow from 0

_BOUNDARY = re.compile(r"(?<=\S) ")
_BESIDE_SPACE = re.compile(r"\s ")

CELLS = pa.schema([
    ("chunk", pa.int64()), ("plane", pa.int32()), ("low", pa.int32()), ("a", pa.int32()), ("b", pa.int32()),
    ("n", pa.int32()), ("docs", pa.binary()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()),
    ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string())])


class _Numbers(dict):
    """Numbers its keys in order of first use."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


class Aligner:
    """Both tokenizers and what is known of the segments met so far; one per worker process."""

    def __init__(self, a_path: str, b_path: str, limit: int = CACHE_SEGMENTS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        byte_of = {c: k for k, c in enumerate(BYTE_CHARS)}
        known = self.a.get_vocab()
        self.a_bytes = [b""] * (max(known.values()) + 1)
        for token, i in known.items():
            self.a_bytes[i] = bytes([byte_of[c] for c in token]) if all(c in byte_of for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("a piece holds a space after another character: texts can't be cut at spaces")
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
                        for i, p in enumerate(pieces)]
        if max(len(self.a_bytes), len(pieces)) >> ID_BITS:
            raise ValueError(f"token ids need more than {ID_BITS} bits")
        self.a_size, self.b_size = (np.array([len(x) for x in table], "i8") for table in (self.a_bytes, self.b_bytes))
        self.shown = [str(i) for i in range(max(len(self.a_bytes), len(pieces)))]
        self.limit = limit
        self.clear()

    def clear(self):
        self.numbers = _Numbers()
        self.groups: list[str] = []
        self.n_a = self.n_b = self.n_links = self.first = np.zeros(0, "i8")
        self.good = np.zeros(0, bool)
        self.links = np.zeros(0, "i8")

    def segment_numbers(self, text: str) -> np.ndarray:
        """The numbers of a text's segments, each without the space that begins it."""
        cuts, at = [], 0
        while len(text) - at > WINDOW and (found := _BOUNDARY.search(text, at + WINDOW)) is not None:
            cuts.append((at, found.start()))
            at = found.end()
        return np.concatenate([self._split(text[x:y]) for x, y in (*cuts, (at, len(text)))])

    def _split(self, text: str) -> np.ndarray:
        spaced = " " + text
        if _BESIDE_SPACE.search(spaced):
            parts = _BOUNDARY.split(spaced)
            parts[0] = parts[0][1:]
        else:
            parts = text.split(" ")
        return np.fromiter(map(self.numbers.__getitem__, parts), "i4", len(parts))

    def learn(self) -> None:
        """Encode the segments that were numbered since the last call, and find where both encodings' tokens end."""
        known = len(self.groups)
        new = [" " + s for s in islice(self.numbers, known, None)] if len(self.numbers) > known else []
        if not new:
            return
        a_ids = [e.ids for e in self.a.encode_batch_fast(new, add_special_tokens=False)]
        # B adds a text's first space itself, but not to an empty text: a text's last space alone is its own piece.
        b_ids = [ids if len(s) > 1 else [self.b.piece_to_id("▁")]
                 for s, ids in zip(new, self.b.encode([s[1:] for s in new], num_threads=1))]
        data = [s.encode() for s in new]
        good, ends = np.ones(len(new), bool), np.array([len(x) for x in data], "i8")
        joined = b"".join(data)
        # Nearly always all segments are right at once; else each is looked at.
        if any(b"".join(map(table.__getitem__, chain.from_iterable(ids))) != joined
               for table, ids in ((self.a_bytes, a_ids), (self.b_bytes, b_ids))):
            for k, x in enumerate(data):
                if any(b"".join(map(table.__getitem__, ids[k])) != x for table, ids in ((self.a_bytes, a_ids), (self.b_bytes, b_ids))):
                    good[k], a_ids[k], b_ids[k], ends[k] = False, [], [], 0
        n_a, n_b = (np.array([len(x) for x in ids], "i8") for ids in (a_ids, b_ids))
        flat_a, flat_b = (np.fromiter(chain.from_iterable(ids), "i8", int(n.sum())) for ids, n in ((a_ids, n_a), (b_ids, n_b)))
        end_a, end_b = np.cumsum(self.a_size[flat_a]), np.cumsum(self.b_size[flat_b])
        both, at_a, at_b = np.intersect1d(end_a, end_b, assume_unique=True, return_indices=True)
        upto = np.searchsorted(both, np.cumsum(ends), side="right")  # groups up to each segment's end
        n_links = np.diff(upto, prepend=0)
        self.first = np.concatenate([self.first, len(self.links) + upto - n_links])
        self.links = np.concatenate([self.links, flat_a[at_a] << ID_BITS | flat_b[at_b]])
        self.n_a, self.n_b = np.concatenate([self.n_a, n_a]), np.concatenate([self.n_b, n_b])
        self.n_links, self.good = np.concatenate([self.n_links, n_links]), np.concatenate([self.good, good])
        words_a, words_b = (list(map(self.shown.__getitem__, x.tolist())) for x in (flat_a, flat_b))
        cut_a, cut_b = ([0, *(x + 1).tolist()] for x in (at_a, at_b))
        shown = [",".join(words_a[cut_a[g]:cut_a[g + 1]]) + "|" + ",".join(words_b[cut_b[g]:cut_b[g + 1]])
                 for g in range(len(both))]
        starts = (upto - n_links).tolist()
        self.groups += [";".join(shown[x:y]) for x, y in zip(starts, upto.tolist())]

    def digest(self, numbers: np.ndarray) -> str:
        """SHA-256 of a text's groups, window by window."""
        out = hashlib.sha256()
        for at in range(0, len(numbers), WINDOW):
            part = ";".join(map(self.groups.__getitem__, numbers[at:at + WINDOW].tolist()))
            out.update(((";" if at else "") + part).encode())
        return out.hexdigest()


@lru_cache(maxsize=2)
def aligner(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    starts = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[starts], np.add.reduceat(counts, starts) if len(keys) else counts


class _Chunk:
    """The documents of one chunk and their (pair, document) entries."""

    def __init__(self, number: int):
        self.number, self.rows, self.entries = number, [], 0
        self.keys: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []

    def add(self, words: Aligner, part: pa.RecordBatch) -> None:
        texts = [t or "" for t in part["text"].to_pylist()]
        numbers = [words.segment_numbers(t) if t else np.zeros(0, "i4") for t in texts]
        words.learn()
        low = len(self.rows)
        for doc_id, seg in zip(part["doc_id"].to_pylist(), numbers):
            good = len(seg) > 0 and bool(words.good[seg].all())
            links = int(words.n_links[seg].sum()) if good else 0
            self.rows.append((doc_id, int(words.n_a[seg].sum()), int(words.n_b[seg].sum()), links, words.digest(seg)) if good
                             else (doc_id, 0, 0, 0, ""))
        seg = np.concatenate([x if row[4] else x[:0] for x, row in zip(numbers, self.rows[low:])])
        owner = np.repeat(np.arange(low, len(self.rows)), [len(x) if row[4] else 0 for x, row in zip(numbers, self.rows[low:])])
        for at in range(0, len(seg), WINDOW):
            s, o = seg[at:at + WINDOW], owner[at:at + WINDOW]
            n = words.n_links[s]
            place = np.repeat(words.first[s] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            keys, counts = np.unique(words.links[place] << 16 | np.repeat(o, n), return_counts=True)
            self.keys.append(keys)
            self.counts.append(counts)
            self.entries += len(keys)

    def cells(self) -> Iterator[pa.RecordBatch]:
        """A row per document, then a row per pair's bitmap and per plane that isn't empty."""
        ids, n_a, n_b, links, digests = zip(*self.rows)
        links = np.array(links, "i8")
        yield self._batch(len(ids), plane=np.full(len(ids), DOCUMENT), low=np.arange(len(ids)), doc_id=pa.array(ids, pa.int64()),
                          n_a=n_a, n_b=n_b, n_groups=links, n_links=links, groups_sha256=digests)
        if not self.keys:
            return
        keys, counts = _summed(np.concatenate(self.keys), np.concatenate(self.counts))
        self.keys, self.counts = [], []
        more = counts - 1
        yield from self._containers(keys, MEMBERS)
        for k in range(int(more.max()).bit_length()):
            yield from self._containers(keys[(more >> k) & 1 == 1], k)

    def _containers(self, keys: np.ndarray, plane: int) -> Iterator[pa.RecordBatch]:
        pair, low = keys >> 16, (keys & 0xFFFF).astype("<u2")
        starts = np.flatnonzero(np.diff(pair, prepend=-1))
        n = np.diff(np.append(starts, len(pair)))
        for dense in (False, True):
            rows = np.flatnonzero((n >= DENSE) == dense)
            if not len(rows):
                continue
            if dense:
                docs = pa.array([bits_of(low[starts[r]:starts[r] + n[r]]) for r in rows.tolist()], pa.binary())
            else:
                data = low[np.repeat(n < DENSE, n)]
                ends = np.concatenate([[0], np.cumsum(n[rows] * 2)]).astype("i4")
                docs = pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(data)])
            which = pair[starts[rows]]
            yield self._batch(len(rows), plane=np.full(len(rows), plane), a=which >> ID_BITS, b=which & ((1 << ID_BITS) - 1),
                              n=n[rows], docs=docs)

    def _batch(self, rows: int, **columns) -> pa.RecordBatch:
        columns["chunk"] = np.full(rows, self.number)
        return pa.RecordBatch.from_arrays(
            [pa.nulls(rows, f.type) if f.name not in columns else columns[f.name] if isinstance(columns[f.name], pa.Array)
             else pa.array(columns[f.name], f.type) for f in CELLS], schema=CELLS)


def bits_of(low: np.ndarray) -> bytes:
    """The bitmap container of 16-bit document numbers."""
    bits = np.zeros(CHUNK_DOCS, bool)
    bits[low] = True
    return np.packbits(bits).tobytes()


def members(container: bytes) -> np.ndarray:
    """The document numbers in a container of either form."""
    if len(container) == CHUNK_DOCS // 8:
        return np.flatnonzero(np.unpackbits(np.frombuffer(container, "u1"))).astype("<u2")
    return np.frombuffer(container, "<u2")


def or_popcount(containers: list[bytes]) -> int:
    """How many documents are in any of a chunk's containers: bitmaps are OR-ed, numbers set in the result."""
    if len(containers) == 1:
        return len(members(containers[0]))
    merged = np.zeros(CHUNK_DOCS // 8, "u1")
    numbers = [np.zeros(0, "<u2")]
    for c in containers:
        if len(c) == len(merged):
            merged |= np.frombuffer(c, "u1")
        else:
            numbers.append(members(c))
    bits = np.unpackbits(merged)
    bits[np.concatenate(numbers)] = 1
    return int(bits.sum())


def postings(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The written postings: rows of ``CELLS``. A chunk is the work of one task and has rows in it alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, task, made = aligner(a_path, b_path), TaskContext.get().partitionId(), 0
        chunk = _Chunk(task << 24)
        for part in slices(batches, size=SLICE_BYTES):
            if len(chunk.rows) + part.num_rows > CHUNK_DOCS or chunk.entries > CHUNK_LINKS:
                yield from chunk.cells()
                made += 1
                chunk = _Chunk(task << 24 | made)
            chunk.add(words, part)
            if len(words.numbers) > words.limit:
                words.clear()
        if chunk.rows:
            yield from chunk.cells()

    source = pick(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    ddl = ("chunk long, plane int, low int, a int, b int, n int, docs binary, doc_id long, n_a long, n_b long, "
           "n_groups long, n_links long, groups_sha256 string")
    return written(source.mapInArrow(run, ddl), "alignment")


def pair_scores(cells: DataFrame) -> DataFrame:
    """``a, b, n_docs, n_links`` of every linked pair and ``best``: no pair of this B id has more links."""
    links = F.when(F.col("plane") == MEMBERS, F.col("n").cast("long")).otherwise(
        F.col("n") * F.pow(F.lit(2.0), F.col("plane")).cast("long"))
    pairs = cells.where(F.col("plane") >= MEMBERS).groupBy("a", "b").agg(
        F.sum(F.when(F.col("plane") == MEMBERS, F.col("n").cast("long")).otherwise(0)).alias("n_docs"),
        F.sum(links).alias("n_links"))
    highest = pairs.groupBy("b").agg(F.max("n_links").alias("highest"))
    return pairs.join(highest, "b").select("a", "b", "n_docs", "n_links", (F.col("n_links") == F.col("highest")).alias("best"))


def token_documents(cells: DataFrame, side: str) -> DataFrame:
    """``token, n_docs``: in how many documents a token of side ``a`` or ``b`` is linked to any token of the other."""

    def merge(rows: pa.Table) -> pa.Table:
        held: dict[int, list[bytes]] = {}
        for token, docs in zip(rows["token"].to_pylist(), rows["docs"].to_pylist()):
            held.setdefault(token, []).append(docs)
        return pa.table({"token": pa.array(held, pa.int32()), "n": pa.array(map(or_popcount, held.values()), pa.int64())})

    rows = cells.where(F.col("plane") == MEMBERS).select("chunk", F.col(side).alias("token"), "docs")
    return rows.groupBy("chunk").applyInArrow(merge, "token int, n long").groupBy("token").agg(F.sum("n").alias("n_docs"))


def _returned(cells: pa.Table, scores: pa.Table) -> pa.Table:
    """A chunk's documents with the sums of the scores that its postings bring them."""
    plane = cells["plane"].to_numpy()
    docs = cells.filter(pa.array(plane == DOCUMENT))
    low = docs["low"].to_numpy()
    best, total = (np.zeros(int(low.max(initial=-1)) + 1, "i8") for _ in range(2))
    posts = cells.filter(pa.array(plane != DOCUMENT))
    if posts.num_rows:
        known, keys = (x.to_numpy().astype("i8") << ID_BITS | y.to_numpy()
                       for x, y in ((scores["id_a"], scores["id_b"]), (posts["a"], posts["b"])))
        order = np.argsort(known)
        place = order[np.searchsorted(known, keys, sorter=order)]
        times = np.int64(1) << np.maximum(posts["plane"].to_numpy(), 0).astype("i8")
        links, tops = scores["score"].to_numpy()[place] * times, scores["best"].to_numpy()[place] * times
        held, n = posts["docs"].to_pylist(), posts["n"].to_numpy()
        flat = np.concatenate([np.frombuffer(b"".join([c for c in held if len(c) < CHUNK_DOCS // 8]), "<u2"),
                               *[members(c) for c in held if len(c) == CHUNK_DOCS // 8]])
        order = np.argsort(n >= DENSE, kind="stable")
        np.add.at(total, flat, np.repeat(links[order], n[order]))
        np.add.at(best, flat, np.repeat(tops[order], n[order]))
    columns = {c: docs[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")}
    return pa.table({**columns, "n_best": best[low], "count_sum": total[low], "groups_sha256": docs["groups_sha256"]})


def align_documents(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``."""
    cells = postings(docs, a_path, b_path, id_col, text_col)
    scores = pair_scores(cells).select("a", "b", F.col("n_links").alias("score"), F.col("best").cast("long").alias("best"))
    met = cells.where(F.col("plane") == MEMBERS).select("chunk", "a", "b").join(scores, ["a", "b"]).select(
        F.col("chunk").alias("at"), F.col("a").alias("id_a"), F.col("b").alias("id_b"), "score", "best")
    return cells.groupBy("chunk").cogroup(met.groupBy("at")).applyInArrow(
        _returned, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, "
                   "groups_sha256 string")
