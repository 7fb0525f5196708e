"""Language identification by prediction by partial matching (PPM) under frozen statistics.

Each language has a context tree over the bytes of lower-cased words: counts of every byte after its last 0 to
``ORDER`` bytes, where a word begins and ends with a space and no context reaches back over it. A byte unseen in a
context is coded by an escape (method C: as likely as the number of distinct bytes seen there) and then in the next
shorter context, at last as one of 256. A text's score for a language is the exact code length of its words.

As contexts stop at the word, a word's code length is a constant of the frozen model: it is computed once per distinct
word of a batch, for all languages together, by numpy lookups in sorted context tables, and kept in a bounded cache.

Training reads labelled documents outside the held-out part: about ``DOCS_PER_LANGUAGE`` of each language, chosen by a
hash of the id. That is the documented bound of the model; prediction covers every row and every whole text.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staylens.llm.common import pick, slices

ORDER = 4
DOCS_PER_LANGUAGE = 600
MAX_LANGUAGES = 200
UNKNOWN = "und"
# Words kept in a worker's cache of code lengths, and the longest word that is kept (bytes).
CACHE_WORDS, CACHE_BYTES = 150_000, 48


def held_out(id_col: Column) -> Column:
    """True for the part of the ids that is never learned from; a null id counts as not held out (nor learned)."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def words_of(texts: pa.Array) -> pa.ListArray:
    """The lower-cased runs of letters (with their marks) of each text; a null text has none."""
    lower = pc.utf8_lower(pc.fill_null(texts, ""))
    return pc.split_pattern(pc.utf8_trim(pc.replace_substring_regex(lower, r"[^\p{L}\p{M}]+", " "), " "), " ")


@dataclass
class Level:
    """One context length: sorted n-grams (context, then byte) with code lengths, and contexts with escape lengths."""

    grams: np.ndarray
    bits: np.ndarray  # (n-gram, language)
    contexts: np.ndarray
    escapes: np.ndarray  # (context, language); 0 where a language never saw the context


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``wanted`` in sorted ``keys`` and whether they are there."""
    if not len(keys):
        return np.zeros(len(wanted), "i8"), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


@dataclass
class Model:
    languages: list[str]
    levels: list[Level]
    cache: dict[str, bytes] = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return {"languages": self.languages, "levels": self.levels, "cache": {}}

    def code_lengths(self, words: list[str]) -> np.ndarray:
        """Bits of each word (with its closing space) for each language."""
        coded = [b" " + w.encode("utf-8", "surrogatepass") + b" " for w in words]
        data = np.frombuffer(b"".join(coded), "u1").astype("i8")
        sizes = np.fromiter(map(len, coded), "i8", len(coded))
        firsts = np.cumsum(sizes) - sizes
        place = np.arange(len(data)) - np.repeat(firsts, sizes)
        bits = np.zeros((len(data), len(self.languages)))
        open_ = np.flatnonzero(place > 0)  # the opening space is context only
        for k in range(len(self.levels) - 1, -1, -1):
            level = self.levels[k]
            here = open_[place[open_] >= k]
            gram = np.zeros(len(here), "i8")
            for back in range(k, -1, -1):
                gram = gram << 8 | data[here - back]
            at, seen = _find(level.grams, gram)
            bits[here[seen]] += level.bits[at[seen]]
            missed = here[~seen]
            at, known = _find(level.contexts, gram[~seen] >> 8)
            bits[missed[known]] += level.escapes[at[known]]
            open_ = np.concatenate([open_[place[open_] < k], missed])
        bits[open_] += 8.0
        return np.add.reduceat(bits, firsts) if len(words) else np.zeros((0, len(self.languages)))

    def cached_lengths(self, words: list[str]) -> np.ndarray:
        cache = self.cache
        new = [w for w in words if w not in cache]
        fresh = {}
        if new:
            fresh = {w: row.tobytes() for w, row in zip(new, self.code_lengths(new))}
            if len(cache) + len(new) > CACHE_WORDS:
                fresh |= {w: cache[w] for w in words if w in cache}
                cache.clear()
            cache.update((w, b) for w, b in fresh.items() if len(w) <= CACHE_BYTES)
        return np.frombuffer(b"".join([fresh.get(w) or cache[w] for w in words])).reshape(len(words), -1)

    def text_lengths(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Bits of each whole text for each language, and the bytes coded (each word with a closing space)."""
        lists = words_of(texts)
        offsets = np.asarray(lists.offsets)
        coded = lists.values.dictionary_encode()
        words = coded.dictionary.to_pylist()
        table = self.cached_lengths(words)
        sizes = np.fromiter((len(w.encode("utf-8", "surrogatepass")) + 1 for w in words), "i8", len(words))
        codes = np.asarray(coded.indices)
        full = np.flatnonzero(np.diff(offsets) > 0)
        bits, n = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts), "i8")
        if len(full):
            for k in range(len(self.languages)):
                bits[full, k] = np.add.reduceat(table[codes, k], offsets[full])
            n[full] = np.add.reduceat(sizes[codes], offsets[full])
        return bits, n


def count_contexts(docs: DataFrame) -> DataFrame:
    """``lang, gram, n``: how often each byte follows each context of up to ``ORDER`` bytes, over ``lang, text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, Counter] = defaultdict(Counter)
        for part in slices(batches):
            for lang, words in zip(part["lang"].to_pylist(), words_of(part["text"]).to_pylist()):
                total[lang].update(words)
        rows: Counter = Counter()
        for lang, words in total.items():
            for word, n in words.items():
                if word:
                    coded = b" " + word.encode("utf-8", "surrogatepass") + b" "
                    for at in range(1, len(coded)):
                        for k in range(min(ORDER, at) + 1):
                            rows[lang, coded[at - k:at + 1]] += n
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in rows], pa.string()), pa.array([k[1] for k in rows], pa.binary()),
             pa.array(list(rows.values()), pa.int64())], names=["lang", "gram", "n"])

    return docs.select("lang", "text").mapInArrow(run, "lang string, gram binary, n long").groupBy("lang", "gram").agg(
        F.sum("n").alias("n"))


def build_model(languages: list[str], grams: list[tuple[str, bytes, int]]) -> Model:
    """Code lengths of every seen n-gram and escape lengths of every seen context, for all languages."""
    column = {lang: k for k, lang in enumerate(languages)}
    by_order: list[list[tuple[int, int, int]]] = [[] for _ in range(ORDER + 1)]
    for lang, gram, n in grams:
        by_order[len(gram) - 1].append((int.from_bytes(gram, "big"), column[lang], n))
    levels: list[Level] = []
    for k, rows in enumerate(by_order):
        found = np.array(rows, "i8").reshape(-1, 3)
        keys, at = np.unique(found[:, 0], return_inverse=True)
        counts = np.zeros((len(keys), len(languages)))
        np.add.at(counts, (at, found[:, 1]), found[:, 2])
        contexts, of = np.unique(keys >> 8, return_inverse=True)
        total, distinct = np.zeros((len(contexts), len(languages))), np.zeros((len(contexts), len(languages)))
        np.add.at(total, of, counts)
        np.add.at(distinct, of, counts > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            escapes = np.where(total > 0, np.log2((total + distinct) / distinct), 0.0)
            bits = np.log2((total + distinct)[of] / counts)
        if k:
            shorter = levels[-1].bits[_find(levels[-1].grams, keys & ((1 << 8 * k) - 1))[0]]
        else:
            shorter = np.full((len(keys), len(languages)), 8.0)
        levels.append(Level(keys, np.where(counts > 0, bits, escapes[of] + shorter), contexts, escapes))
    return Model(languages, levels)


def train(docs: DataFrame, docs_per_language: int = DOCS_PER_LANGUAGE) -> Model:
    """Fit the context trees on ``doc_id, text, lang`` outside the held-out part.

    The driver gets the counts of the bounded sample only: about ``docs_per_language`` documents of each language (the
    ``MAX_LANGUAGES`` with most documents), each id once.
    """
    known = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull()
                        & ~held_out(F.col("doc_id")))
    sizes = known.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("n")).orderBy(
        F.desc("n"), "lang").limit(MAX_LANGUAGES).collect()
    languages = sorted(r["lang"] for r in sizes)
    if not languages:
        return Model([], [])
    share = F.create_map(*[F.lit(x) for r in sizes
                           for x in (r["lang"], min(1_000_000, 1_000_000 * docs_per_language // max(1, r["n"]) + 1))])
    sample = known.filter(F.expr("pmod(xxhash64(doc_id), 1000000L)") < share[F.col("lang")]).dropDuplicates(
        ["doc_id", "lang"])
    counts = count_contexts(sample).collect()
    return build_model(languages, [(r["lang"], bytes(r["gram"]), r["n"]) for r in counts if r["lang"] in set(languages)])


def _predict(model: Model, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, posterior and bits a byte of each text; without a letter, ``UNKNOWN``, 0 and 0."""
    bits, n = model.text_lengths(texts)
    letters = np.asarray(pc.match_substring_regex(pc.fill_null(texts, ""), r"\p{L}").to_numpy(zero_copy_only=False), bool)
    if not model.languages or not len(bits):
        return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
    best = bits.argmin(axis=1)  # equal lengths: the language first in order of name
    least = bits[np.arange(len(bits)), best]
    score = 1.0 / np.exp2(np.maximum(least[:, None] - bits, -1000.0)).sum(axis=1)
    names = [model.languages[k] if ok else UNKNOWN for k, ok in zip(best.tolist(), letters.tolist())]
    return names, np.where(letters, score, 0.0), np.where(letters, least / np.maximum(n, 1), 0.0)


def _source(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    return pick(docs, doc_id=id_col, text=text_col, lang=lang_col).withColumns(
        {"text": F.col("text").cast("string"), "lang": F.col("lang").cast("string")})


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
             docs_per_language: int = DOCS_PER_LANGUAGE) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, bits_per_byte`` of every document.

    The prediction sees the text alone. A null text, or one without a letter, is ``und`` with score 0, and so is every
    text if nothing is labelled. Null ids and repeated rows stay; an empty table gives an empty result; equal code
    lengths go to the language first in order of name; other columns are ignored.
    """
    source = _source(docs, id_col, text_col, lang_col)
    shared = docs.sparkSession.sparkContext.broadcast(train(source, docs_per_language))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            names, score, rate = _predict(shared.value, part["text"])
            yield pa.RecordBatch.from_arrays(
                [part["doc_id"], part["held_out"], pa.array(names, pa.string()), pa.array(score), pa.array(rate)],
                names=["doc_id", "held_out", "lang_pred", "score", "bits_per_byte"])

    kind = source.schema["doc_id"].dataType.simpleString()
    return source.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(
        run, f"doc_id {kind}, held_out boolean, lang_pred string, score double, bits_per_byte double")


def keep_documents(docs: DataFrame, max_bits_per_byte: float = 6.5, id_col: str = "doc_id", text_col: str = "text",
                   lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text some learned language explains.

    Rejected: texts without a letter, and texts that cost the best language more than ``max_bits_per_byte`` (a byte
    costs 8 bits without any model, and about 2 to 3 in a text of a learned language). If nothing is labelled, no
    language can reject a text, and only those without a letter go.
    """
    source = _source(docs, id_col, text_col, lang_col)
    shared = docs.sparkSession.sparkContext.broadcast(train(source))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for part in slices(batches, text_col):
            texts = part[text_col]
            if model.languages:
                names, _, rate = _predict(model, texts)
                ok = (np.array(names, object) != UNKNOWN) & (rate <= max_bits_per_byte)
            else:
                ok = pc.match_substring_regex(pc.fill_null(texts, ""), r"\p{L}").to_numpy(zero_copy_only=False)
            yield part.filter(pa.array(ok, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
