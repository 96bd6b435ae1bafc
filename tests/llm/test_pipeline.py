"""The corpus pipeline and its stages over a small table whose result is known by hand."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from plantlens.llm import bpe
from plantlens.llm.queries import TOKENIZERS

WORDS = [f"word{i}" for i in range(400)]


def prose(k, n=60):
    return " ".join(WORDS[(k * 37 + i * i * (k + 3)) % 400] for i in range(n))


def broken(text, n):
    w = text.split()
    return "\n".join(" ".join(w[i : i + n]) for i in range(0, len(w), n))


#: 2 loses its only line to 1, 4 is 3 in other lines, 5 and 6 hold the benchmark's passage.
TEXTS = {1: prose(1), 2: prose(1).replace(prose(1).split()[30], "swapped", 1), 3: broken(prose(4), 6), 4: broken(prose(4), 4), 5: prose(2), 6: prose(3) + "\n" + " ".join(w if i % 6 else "other" for i, w in enumerate(prose(2).split())), 7: prose(5), 8: None}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("corpus")
    rows = [(i, t, "en", f"src{i % 2}", None if t is None else len(t)) for i, t in TEXTS.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in TEXTS], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(0, prose(2, 50))], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d)


def test_run_gives_the_ids_of_what_is_left(spark, folder):
    codec = bpe.codec(f"{TOKENIZERS}/byte_bpe_50k.tiktoken")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, folder).collect()}
    assert {i: codec.decode(np.array(r.ids, np.uint32)).decode() for i, r in got.items()} == {1: TEXTS[1], 2: "", 3: TEXTS[3], 7: TEXTS[7], 8: ""}
    for r in got.values():
        assert r.n_tokens == len(r.ids) and r.ids_sha256 == hashlib.sha256(np.array(r.ids, "<u4").tobytes()).hexdigest()


def test_each_stage(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    after = {}
    for name in ("toxicity", "line_dedup", "ngram_join", "decontamination"):
        docs = stage[name](spark, docs, folder).checkpoint()
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        after[name] = {r.doc_id: r.text for r in docs.collect()}
    assert after["toxicity"] == TEXTS
    assert after["line_dedup"] == TEXTS | {2: ""}
    assert after["ngram_join"] == {i: t for i, t in after["line_dedup"].items() if i != 4}
    assert after["decontamination"] == {i: t for i, t in after["ngram_join"].items() if i not in (5, 6)}
    assert docs.where(F.col("n_chars") != F.length("text")).count() == 0
