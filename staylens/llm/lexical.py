"""Ranked lexical search: the best documents for each of a set of items, by pair-bound MaxScore over an inverted index.

Method. Documents are indexed in chunks, one written row each: postings by term with integer impacts and each term's
maximum in the chunk, and for the term pairs of the items the intersection of their postings with the largest joint
impact that any document in it has. An item's terms are taken in pairs, neighbours by weight. In a chunk a pair adds at most the larger of
its joint maximum and its terms' own maxima, which is less than the sum of the two unless one document has both. Bounds in
ascending order are added up while the sum stays below the item's threshold: documents with terms of these pairs alone can't
enter, so only the other pairs' postings name candidates, and these are dropped as soon as their partial score and the
bounds still open can't reach the threshold. Where an item has no threshold yet, the documents of its strongest pair's
intersection list give one. Documents are dropped only below the threshold, never at it, so ties come out right.

Jobs. One text pass counts (``count_terms``); corpus figures are sums over its chunk rows; a second pass over the written
counts computes impacts and pair lists (``index_chunks``); searching is a third pass that hands on one top list per item
and task, cut again by a window per item. No postings are shuffled, so a term that every document holds is no hot key.

Bounds: items are worked on in blocks of about ``ITEM_BYTES`` of text, whose terms are what the index holds; a chunk closes
at ``CHUNK_DOCS`` documents or ``CHUNK_POSTINGS`` postings. Nothing else is limited.

Odd rows: a null or empty text has no terms and is never found; an item without terms that occur has no rows; repeated
documents and items count as often as they are there; equal scores rank by id, null ids last. Without documents or items
the result is empty. Further columns are left out.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from staylens.llm.common import pick, slices, written

TOP = 10
ITEM_BYTES = 8 << 20
CHUNK_DOCS = 1 << 16
CHUNK_POSTINGS = 1_000_000
WINDOW = 4 << 20  # bytes of a text that are split into terms at once

# Letters and digits of ASCII, the capitals as small letters, and all bytes of other characters; the rest separates.
_FOLD = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in bytes(range(256)).lower())


def split_terms(text: str) -> Iterator[list[bytes]]:
    """The terms of a whole text, window by window."""
    data = text.encode("utf-8", "surrogatepass").translate(_FOLD)
    at = 0
    while len(data) - at > WINDOW:
        to = data.find(b" ", at + WINDOW)
        if to < 0:
            break
        yield data[at:to].split()
        at = to
    yield data[at:].split()


def read_items(items: DataFrame, id_col: str, text_col: str, block_bytes: int = ITEM_BYTES) -> Iterator[list[tuple]]:
    """Blocks of (item id, distinct terms); a block holds about ``block_bytes`` of text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            terms = [sorted({t for some in split_terms(x or "") for t in some}) for x in part["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([part["item_id"], part["block"], pa.array(terms, pa.list_(pa.binary()))],
                                             names=["item_id", "block", "terms"])

    source = pick(items, item_id=id_col, text=text_col).select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // block_bytes)
    numbered = source.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(max(blocks, 1))))
    for block in range(blocks):
        rows = numbered.where(F.col("block") == block).mapInArrow(run, "item_id long, block long, terms array<binary>").collect()
        yield [(r.item_id, [bytes(t) for t in r.terms]) for r in rows]


def count_terms(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """A written row per chunk of ``doc_id, text``: ids, lengths, and for the terms of the vocabulary the documents that
    hold them and how often (arrays as little-endian bytes, postings one after another in order of ``terms``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, lengths, keys, times = [], [], [], []

        def chunk() -> pa.RecordBatch:
            flat = np.concatenate([*keys, np.zeros(0, "i8")])
            order = np.argsort(flat, kind="stable")
            terms, df = np.unique(flat[order] >> 16, return_counts=True)
            n = np.array(lengths, "i8")
            binary = [terms.astype("<i4"), df.astype("<i4"), (flat[order] & 0xFFFF).astype("<u2"),
                      np.concatenate([*times, np.zeros(0, "i8")])[order].astype("<u4"), n.astype("<i8")]
            row = [pa.array([ids], pa.list_(pa.int64())), pa.array([int((n > 0).sum())], pa.int64()),
                   pa.array([int(n.sum())], pa.int64()), *[pa.array([x.tobytes()], pa.binary()) for x in binary]]
            for x in (ids, lengths, keys, times):
                x.clear()
            return pa.RecordBatch.from_arrays(row, names=["ids", "n_docs", "n_terms", "terms", "df", "docs", "tf", "lengths"])

        held = 0
        for part in slices(batches):
            if len(ids) + part.num_rows > CHUNK_DOCS or held > CHUNK_POSTINGS:
                yield chunk()
                held = 0
            for doc_id, text in zip(part["doc_id"].to_pylist(), part["text"].to_pylist()):
                n, found = 0, [np.zeros(0, "i8")]
                for some in split_terms(text or ""):
                    n += len(some)
                    found.append(np.fromiter(map(vocabulary.get, some, repeat(-1)), "i8", len(some)))
                terms, tf = np.unique(np.concatenate(found), return_counts=True)
                at = int(terms[:1].tolist() == [-1])
                keys.append(terms[at:] << 16 | len(ids))
                times.append(tf[at:])
                held += len(terms) - at
                ids.append(doc_id)
                lengths.append(n)
        if ids:
            yield chunk()

    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return written(source.mapInArrow(run, "ids array<long>, n_docs long, n_terms long, terms binary, df binary, docs binary, "
                                          "tf binary, lengths binary"), "term-counts")


def corpus_figures(counts: DataFrame) -> tuple[int, int, dict[int, int]]:
    """N, L and each term's document count; at most a row per term of the vocabulary comes back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for terms, df in zip(batch["terms"].to_pylist(), batch["df"].to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(terms, "<i4")), pa.array(np.frombuffer(df, "<i4"))],
                                                 names=["term", "df"])

    row = counts.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    df = counts.select("terms", "df").mapInArrow(run, "term int, df int").groupBy("term").agg(F.sum("df").alias("df"))
    return row[0] or 0, row[1] or 0, {r.term: r.df for r in df.collect()}


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def pairs_of(terms: Sequence[int], weights: dict[int, int]) -> list[tuple[int, ...]]:
    """An item's terms that occur, in pairs of neighbours by weight; an odd one stays single."""
    known = sorted((t for t in terms if t in weights), key=lambda t: (weights[t], t))
    return [tuple(sorted(known[k:k + 2])) for k in range(0, len(known), 2)]


class Chunk:
    """The index of one chunk: postings with scores (weight times impact), maxima and pair lists."""

    def __init__(self, ids: list, terms: bytes, df: bytes, docs: bytes, impacts: bytes, weights: dict[int, int]):
        self.null = np.array([x is None for x in ids], bool)
        self.ids = np.array([0 if x is None else x for x in ids], "i8")
        numbers, size = np.frombuffer(terms, "<i4").tolist(), np.frombuffer(df, "<i4")
        ends = np.cumsum(size)
        flat, impact = np.frombuffer(docs, "<u2"), np.frombuffer(impacts, "<i4").astype("i8")
        impact *= np.repeat(np.array([weights[t] for t in numbers], "i8"), size)
        self.postings = {t: (flat[e - s:e], impact[e - s:e]) for t, s, e in zip(numbers, size.tolist(), ends.tolist())}
        self.highest = {t: int(x.max()) for t, (_, x) in self.postings.items()}
        self.lists: dict[tuple[int, int], np.ndarray] = {}
        self.joint: dict[tuple[int, int], int] = {}

    def intersect(self, pair: tuple[int, int]) -> None:
        """The documents that hold both terms, and the largest joint score among them."""
        (docs_a, score_a), (docs_b, score_b) = (self.postings[t] for t in pair)
        both, at_a, at_b = np.intersect1d(docs_a, docs_b, assume_unique=True, return_indices=True)
        self.lists[pair] = both
        self.joint[pair] = int((score_a[at_a] + score_b[at_b]).max(initial=0))

    def bound(self, unit: tuple[int, ...]) -> int:
        """The most that a document's terms of this pair (or single term) can add."""
        return max(self.joint.get(unit, 0), *[self.highest[t] for t in unit])

    def add(self, docs: np.ndarray, unit: tuple[int, ...]) -> np.ndarray:
        """What the terms of a unit add to each of the documents."""
        out = np.zeros(len(docs), "i8")
        for t in unit:
            held, scores = self.postings[t]
            at = np.minimum(np.searchsorted(held, docs), len(held) - 1)
            out += np.where(held[at] == docs, scores[at], 0)
        return out

    def search(self, units: list[tuple[int, ...]], top: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and scores that hold every one of the chunk's ``top`` best of at least ``least``."""
        present = [p for unit in units if (p := tuple(t for t in unit if t in self.postings))]
        present.sort(key=self.bound)
        bounds = np.cumsum([self.bound(u) for u in present])
        if not present or bounds[-1] < least:
            return np.zeros(0, "i8"), np.zeros(0, "i8")
        if least <= 1:
            strong = max((u for u in present if len(self.lists.get(u, ())) >= top), key=self.bound, default=None)
            if strong:
                least = max(least, _nth(sum(self.add(self.lists[strong], u) for u in present), top))
        sure = int(np.searchsorted(bounds, least, side="left"))  # units whose bounds together stay below ``least``
        score = np.zeros(len(self.ids), "i8")
        for unit in present[sure:]:
            for t in unit:
                docs, scores = self.postings[t]
                score[docs] += scores
        docs = np.flatnonzero(score)
        score = score[docs]
        for k in range(sure - 1, -1, -1):
            least = max(least, _nth(score, top))
            keep = score + bounds[k] >= least
            docs, score = docs[keep], score[keep]
            score = score + self.add(docs, present[k])
        keep = score >= max(least, 1)
        return docs[keep], score[keep]


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    """One row, which is a whole chunk, at a time."""
    for k in range(batch.num_rows):
        yield batch.slice(k, 1).to_pylist()[0]


def _nth(scores: np.ndarray, n: int) -> int:
    """The n-th largest score, 0 if there are fewer."""
    return int(np.partition(scores, len(scores) - n)[len(scores) - n]) if len(scores) >= n else 0


def _packed(docs: np.ndarray, n: int) -> bytes:
    """A list of document numbers as 16-bit numbers or, if shorter, as bits with a mark before them."""
    if len(docs) * 2 <= n // 8:
        return b"n" + docs.astype("<u2").tobytes()
    bits = np.zeros(n, bool)
    bits[docs] = True
    return b"b" + np.packbits(bits).tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    if data[:1] == b"n":
        return np.frombuffer(data, "<u2", offset=1)
    return np.flatnonzero(np.unpackbits(np.frombuffer(data, "u1", offset=1))).astype("<u2")


def index_chunks(counts: DataFrame, n_docs: int, n_terms: int, weights: dict[int, int], pairs: list[tuple[int, int]]) -> DataFrame:
    """The written index: a row per chunk with impacts instead of counts, and the lists and joint maxima of the pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                tf, docs = np.frombuffer(row["tf"], "<u4").astype("i8"), np.frombuffer(row["docs"], "<u2")
                m = 100 - 90 + (90 * np.frombuffer(row["lengths"], "<i8") * n_docs) // max(n_terms, 1)
                impacts = ((1_000_000_000 * tf) // (1000 * tf + 8 * m[docs])).astype("<i4").tobytes()
                chunk = Chunk(row["ids"], row["terms"], row["df"], row["docs"], impacts, weights)
                here = [k for k, (a, b) in enumerate(pairs) if a in chunk.postings and b in chunk.postings]
                for k in here:
                    chunk.intersect(pairs[k])
                lists = [_packed(chunk.lists[pairs[k]], len(row["ids"])) for k in here]
                joint = np.array([chunk.joint[pairs[k]] for k in here], "<i8").tobytes()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["ids"]], pa.list_(pa.int64())), *[pa.array([x], pa.binary()) for x in (
                        row["terms"], row["df"], row["docs"], impacts, np.array(here, "<i4").tobytes(), joint)],
                     pa.array([lists], pa.list_(pa.binary()))],
                    names=["ids", "terms", "df", "docs", "impacts", "pairs", "joint", "lists"])

    return written(counts.select("ids", "terms", "df", "docs", "tf", "lengths").mapInArrow(
        run, "ids array<long>, terms binary, df binary, docs binary, impacts binary, pairs binary, joint binary, "
             "lists array<binary>"), "term-index")


def search_index(index: DataFrame, items: list[tuple], units: list[list[tuple[int, ...]]], weights: dict[int, int],
                 pairs: list[tuple[int, int]], top: int = TOP) -> DataFrame:
    """``item, item_id, rank, doc_id, score``: each item's best documents. A task goes through its chunks with one top
    list per item, whose last score is the threshold in the next chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [(np.zeros(0, "i8"), np.zeros(0, bool), np.zeros(0, "i8"))] * len(items)
        for batch in batches:
            for row in _rows(batch):
                chunk = Chunk(*[row[c] for c in ("ids", "terms", "df", "docs", "impacts")], weights)
                here = [pairs[k] for k in np.frombuffer(row["pairs"], "<i4").tolist()]
                chunk.joint = dict(zip(here, np.frombuffer(row["joint"], "<i8").tolist()))
                chunk.lists = dict(zip(here, map(_unpacked, row["lists"])))
                for k, item in enumerate(units):
                    score, null, ids = best[k]
                    docs, more = chunk.search(item, top, int(score[-1]) if len(score) == top else 1)
                    if len(docs):
                        score, null, ids = (np.concatenate(x) for x in (
                            (score, more), (null, chunk.null[docs]), (ids, chunk.ids[docs])))
                        order = np.lexsort((ids, null, -score))[:top]
                        best[k] = score[order], null[order], ids[order]
        for k, (score, null, ids) in enumerate(best):
            if len(score):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k] * len(score), pa.int32()), pa.array([items[k][0]] * len(score), pa.int64()),
                     pa.array(ids, mask=null), pa.array(score)], names=["item", "item_id", "doc_id", "score"])

    found = index.mapInArrow(run, "item int, item_id long, doc_id long, score long")
    place = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= top).select(
        "item", "item_id", "rank", "doc_id", "score")


def rank_documents(docs: DataFrame, items: DataFrame, top: int = TOP, id_col: str = "doc_id", text_col: str = "text",
                   item_id_col: str = "item_id", item_text_col: str = "text", block_bytes: int = ITEM_BYTES) -> DataFrame:
    """Each item's ``top`` highest-scoring documents: ``item_id, rank, doc_id, score``."""
    source = pick(docs, doc_id=id_col, text=text_col)
    results = []
    for block in read_items(items, item_id_col, item_text_col, block_bytes):
        vocabulary = {t: k for k, t in enumerate(sorted({t for _, terms in block for t in terms}))}
        counts = count_terms(source, vocabulary)
        n_docs, n_terms, df = corpus_figures(counts)
        weights = {t: weight(n_docs, n) for t, n in df.items()}
        units = [pairs_of([vocabulary[t] for t in terms], weights) for _, terms in block]
        pairs = sorted({u for item in units for u in item if len(u) == 2})
        index = index_chunks(counts, n_docs, n_terms, weights, pairs)
        results.append(search_index(index, block, units, weights, pairs, top).drop("item"))
    if not results:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return reduce(DataFrame.unionByName, results)


def rank_sql(top: int = TOP) -> str:
    """``rank_documents`` of ``documents`` for ``benchmark`` in DuckDB: every document that holds a term is scored."""
    terms = re.sub(r"\s+", " ", r"""
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')""").strip()
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {terms} AS t FROM documents),
q AS (SELECT DISTINCT i, item_id, unnest(t) AS term FROM (SELECT row_number() OVER () AS i, item_id, {terms} AS t FROM benchmark)),
c AS (SELECT count(CASE WHEN len(t) > 0 THEN 1 END)::BIGINT AS n_docs, sum(len(t))::BIGINT AS n_terms FROM d),
p AS (SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(t) AS term FROM d)
      WHERE term IN (SELECT term FROM q) GROUP BY r, term),
w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM p, c GROUP BY term, n_docs),
m AS (SELECT r, doc_id, 100 - 90 + (90 * len(t)::BIGINT * n_docs) // n_terms AS m FROM d, c),
s AS (SELECT i, item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
      FROM q JOIN p USING (term) JOIN w USING (term) JOIN m USING (r) GROUP BY i, item_id, r, doc_id)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0)
WHERE rank <= {top}
"""
