import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from staylens.llm import pii, quality_rules
from staylens.llm.simhash import fingerprint

from .conftest import plain
from .test_simhash import groups_of


def test_run_equals_plain_code(spark, tmp_path, make_docs):
    langs = {"en": "the of and to in that was with", "fr": "le de la et des que les dans"}

    def text(k):
        words = langs[("en", "fr")[k % 2]].split()
        return " ".join(words[(k * 7 + j * j + j // 3) % 8] + words[(k + j * 5) % 8] * (j % 3 > 0) + ("x" if (k + j) % 11 == 0 else "")
                        for j in range(70 + k % 40))

    texts = [text(k) + (f" call +1 (743) 555-{1000 + k}" if k % 9 == 0 else "") for k in range(150)]
    texts += [texts[3], texts[3] + " tail", "too short", None, "# | " * 100, "щука мышь жизнь чайка рыба " * 30 + " ".join(
        f"слово{chr(1072 + k % 30)}{chr(1072 + k // 30)}" for k in range(90))]
    docs = make_docs(texts, ("en", "fr")).withColumn("lang", F.when(~F.col("text").contains("щука"), F.col("lang")))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    kept = [(k, t) for k, t in enumerate(texts) if t and quality_ok(t) and "щука" not in t]
    prints = {k: fingerprint(t) for k, t in kept}
    root = groups_of(prints, [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 4])
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for k, t in kept:
        if root[k] == k:
            found = pii.base_spans(t)[0]
            for kind in pii.KINDS:
                for a, b in reversed(found[kind]):
                    t = f"{t[:a]}[{kind.upper()}]{t[b:]}"
            ids = np.array([*library.encode(t, add_special_tokens=False).ids, 0], "<u4")
            want[k, 0, 0, len(ids), zlib.crc32(ids.tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want


def quality_ok(text):
    values = dict(zip(quality_rules.MEASURES, quality_rules.measure(text)))
    return not any(eval(r.fails, {}, values) for r in quality_rules.RULES  # noqa: S307
                   if quality_rules.BIT[r.name] & quality_rules.POLICIES[quality_rules.CURRENT])


def test_stages_keep_the_columns(spark, odd_docs):
    docs = odd_docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, "")
        assert after.columns == docs.columns, name
        docs = spark.createDataFrame(after.collect(), odd_docs.schema)
    assert "piece" in corpus_pipeline.STAGES[-1][1](spark, docs, "").columns


def test_stages_take_an_empty_table(spark, no_docs):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, no_docs, "").collect() == [], name


def test_plain_text_passes(make_docs):
    assert quality_ok(plain(200))
