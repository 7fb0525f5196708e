"""SimHash near-duplicates by multi-index hashing.

A fingerprint has a bit set where more than half of the text's shingle hashes have it. Fingerprints within ``max_bits``
of each other link. With ``segments`` segments, two such fingerprints differ by at most ``max_bits // segments`` bits in
some segment. So each distinct fingerprint is stored once per segment under that segment's value, and looks up the whole
Hamming ball of that radius around its own value in each segment's table; every match is verified over all 64 bits inside
the join, which thus yields true links only. Copies share a fingerprint and are one row before any lookup.

With three segments and four bits a fingerprint makes 67 lookups among 2^21 keys, so the work per fingerprint stays flat
up to millions of them; more segments' bits per key (fewer segments) suit larger tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staylens.llm.common import materialised, pick, slices, unsigned_hex
from staylens.llm.components import connected_components

WORDS = 4
SEED = 42
MAX_BITS = 4
SEGMENTS = 3


def fingerprint(text: str, words: int = WORDS, seed: int = SEED) -> int:
    """The 64-bit SimHash of a text as a signed long: ASCII-lower-cased words, shingles with repeats, XXH64."""
    # Bytes change case and split at white space in ASCII only.
    tokens = text.encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = list(accumulate(map(len, tokens), lambda a, n: a + 1 + n))
    starts = [0, *(e + 1 for e in ends[:-1])]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts, ends[words - 1:])]
                      if len(tokens) >= words else [digest(joined, seed)], dtype="<u8")
    set_ = np.zeros(64, "i8")
    for at in range(0, len(hashes), 65536):
        bits = np.unpackbits(hashes[at:at + 65536].view("u1").reshape(-1, 8), axis=1, bitorder="little")
        set_ += bits.sum(axis=0, dtype="i8")
    return int(np.packbits(2 * set_ > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(rows: DataFrame, words: int = WORDS, seed: int = SEED) -> DataFrame:
    """``rows`` (with a string column ``text``) with ``text`` replaced by ``fp``, its fingerprint as a long."""
    others = [c for c in rows.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            fps = [fingerprint(t or "", words, seed) for t in part["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([*(part[c] for c in others), pa.array(fps, pa.int64())],
                                             names=[*others, "fp"])

    schema = rows.select(*others).schema.add("fp", "long")
    return rows.mapInArrow(run, schema)


def segment_layout(segments: int, bits: int = 64) -> list[tuple[int, int]]:
    """(first bit, width) of each segment; widths differ by one at most."""
    edges = [bits * k // segments for k in range(segments + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def ball(width: int, radius: int) -> list[int]:
    """Masks of all changes of at most ``radius`` of ``width`` bits."""
    return [sum(1 << k for k in ks) for r in range(radius + 1) for ks in combinations(range(width), r)]


def links(distinct: DataFrame, max_bits: int = MAX_BITS, segments: int = SEGMENTS) -> DataFrame:
    """Every pair ``a < b`` of distinct fingerprints (column ``fp``) that differ by at most ``max_bits`` bits."""
    radius = max_bits // segments

    def keys(expand: bool):
        """(segment, value) as one long, for the stored value alone or for its whole ball."""
        out = []
        for k, (first, width) in enumerate(segment_layout(segments)):
            value = F.shiftrightunsigned("fp", first).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
            masks = F.array(*[F.lit(m).cast("long") for m in (ball(width, radius) if expand else [0])])
            tagged = value.bitwiseOR(F.lit(k << 56).cast("long"))
            out.append(F.transform(masks, tagged.bitwiseXOR))
        return F.explode(F.concat(*out))

    stored = distinct.select(F.col("fp").alias("b"), keys(False).alias("key"))
    wanted = distinct.select(F.col("fp").alias("a"), keys(True).alias("key"))
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)
    return wanted.join(stored, (wanted["key"] == stored["key"]) & near).select("a", "b").distinct()


def roots(distinct: DataFrame, max_bits: int = MAX_BITS, segments: int = SEGMENTS) -> DataFrame:
    """``fp, root`` of each distinct fingerprint that has a link."""
    return connected_components(links(distinct, max_bits, segments)).select(F.col("node").alias("fp"), "root")


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS,
               max_bits: int = MAX_BITS, segments: int = SEGMENTS) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every document: the smallest id that links reach, its own included.

    A null text counts as empty, and all empty texts share fingerprint zero. A null id is never a component's id unless
    a component has no other. Repeated rows stay; an empty table gives an empty result; other columns are ignored.
    """
    source = pick(docs, doc_id=id_col, text=text_col).withColumn("text", F.col("text").cast("string"))
    held = materialised(fingerprints(source, words))
    distinct = materialised(held.groupBy("fp").agg(F.min("doc_id").alias("first")))
    linked = roots(distinct.select("fp"), max_bits, segments)
    rooted = distinct.join(linked, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    of = rooted.join(named, "root").select("fp", "component_id")
    return held.join(of, "fp").select("doc_id", unsigned_hex(F.col("fp")).alias("fingerprint"), "component_id")


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS,
                     max_bits: int = MAX_BITS, segments: int = SEGMENTS) -> DataFrame:
    """One row of ``docs``, with all its columns, of each component: the smallest id, then the smallest row hash.

    Only ids, row hashes and fingerprints are compared; the texts are shuffled once, by (id, row hash), for the winners
    to be picked, after each task has dropped its own repeats. Null ids come last within a component.
    """
    row_hash, names = F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]), docs.columns
    narrow = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"),
                         row_hash.alias("row_hash"))
    held = materialised(fingerprints(narrow, words))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_hash")
    distinct = materialised(held.groupBy("fp").agg(F.min(order).alias("first")))
    linked = roots(distinct.select("fp"), max_bits, segments)
    winners = distinct.join(linked, "fp", "left").groupBy(F.coalesce("root", "fp").alias("root")).agg(
        F.min("first").alias("first")).select("first.doc_id", "first.row_hash")
    # Positional names keep the operator's own columns apart from any column of the table.
    inner = [f"_{k}" for k in range(len(names))]
    own = docs.select(*[F.col(f"`{c}`").alias(i) for c, i in zip(names, inner)],
                      F.col(f"`{id_col}`").alias("doc_id"), row_hash.alias("row_hash"))
    once = own.dropDuplicates(["doc_id", "row_hash"])
    same = once["doc_id"].eqNullSafe(winners["doc_id"]) & (once["row_hash"] == winners["row_hash"])
    return once.join(winners, same, "left_semi").select(*[F.col(i).alias(c) for c, i in zip(names, inner)])
