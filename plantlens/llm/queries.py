"""The registered queries of the training-data operators, and their SQL where it can say it."""

from __future__ import annotations

import importlib
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plantlens.llm.base import table

#: The folder of the public tokenizers' vocabularies.
TOKENIZERS = os.environ.get("PLANTLENS_TOKENIZERS", "/opt/tokenizers")
URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def _op(module: str, name: str) -> Callable:
    return getattr(importlib.import_module(f"plantlens.llm.{module}"), name)


def op1_co_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _op("quality", "score_documents")(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _op("line_dedup", "decide_documents")(table(spark, sf_dir, "documents"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _op("bpe", "encode_documents")(table(spark, sf_dir, "documents"), f"{TOKENIZERS}/byte_bpe_50k.tiktoken")


def op4_external_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _op("sharding", "shard_documents")(table(spark, sf_dir, "documents"), shards=24, seed=42)


def op5_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _op("decontaminate", "find")(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_wav_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _op("audio", "describe")(table(spark, sf_dir, "documents"))


def op7_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _op("token_records", "record_documents")(table(spark, sf_dir, "documents"), f"{TOKENIZERS}/byte_bpe_50k.json")


def op8_factorization_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _op("toxicity", "score_documents")(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _op("ngram_join", "components_of")(table(spark, sf_dir, "documents"), width=5, share=(75, 100))


def op10_url_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _op("url_filter", "judge")(table(spark, sf_dir, "pages"), URL_RULES)


def op11_va_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _op("vector_codes", "compress")(table(spark, sf_dir, "embeddings"), parts=4, entries=256, rounds=4)


def op12_warc_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _op("warc", "archive_pages")(table(spark, sf_dir, "pages"), least=0)


def op13_feature_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _op("resampling", "resample")(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), buckets=10_000, longest=1, percent=10, least_words=20, seed=2024)


QUERIES = {f.__name__: f for f in (op1_co_training, op2_line_dedup, op3_byte_bpe, op4_external_shuffle, op5_spaced_seeds, op6_wav_fingerprints, op7_token_records, op8_factorization_machine, op9_ngram_join, op10_url_trie, op11_va_codes, op12_warc_dictionary, op13_feature_dictionary)}



def _codes_sql(rounds: int = 4) -> str:
    """Lloyd's rounds as a chain of common tables. Numbers are doubles that hold integers."""
    nearest = """a{k} AS (
            SELECT vec_id, row, p, v, i, d FROM (
                SELECT x.vec_id, x.row, x.p, x.v, b.i, list_inner_product(x.v, x.v) - 2 * list_inner_product(x.v, b.e) + list_inner_product(b.e, b.e) AS d,
                       row_number() OVER (PARTITION BY x.row, x.p ORDER BY d, b.i) AS k
                FROM x JOIN b{k} b ON x.p = b.p) WHERE k = 1)"""
    moved = """m{k} AS (SELECT p, i, j, floor(sum(c) / count(*)) AS c FROM (SELECT p, i, unnest(v) AS c, generate_subscripts(v, 1) AS j FROM a{k}) GROUP BY ALL),
        b{n} AS (SELECT b.p, b.i, coalesce(n.e, b.e) AS e FROM b{k} b LEFT JOIN (SELECT p, i, list(c ORDER BY j) AS e FROM m{k} GROUP BY p, i) n ON b.p = n.p AND b.i = n.i)"""
    chain = ",\n        ".join([nearest.format(k=k) + ",\n        " + moved.format(k=k, n=k + 1) for k in range(rounds)] + [nearest.format(k=rounds)])
    return f"""
        WITH whole AS (
            SELECT vec_id, label, row_number() OVER () AS row, [floor(y::DOUBLE * 1024) for y in embedding] AS w FROM embeddings
            WHERE embedding IS NOT NULL AND len(embedding) = len([y for y in embedding if y IS NOT NULL AND isfinite(y)])),
        x AS (SELECT vec_id, row, p, list_slice(w, p * len(w) // 4 + 1, (p + 1) * len(w) // 4) AS v FROM whole, (SELECT unnest([0, 1, 2, 3]) AS p)),
        first AS (SELECT row, row_number() OVER (ORDER BY vec_id, w) - 1 AS i FROM whole WHERE vec_id IS NOT NULL QUALIFY i < 256),
        b0 AS (SELECT p, i, v AS e FROM x JOIN first USING (row)),
        {chain},
        books AS (SELECT sha256(string_agg(c::BIGINT::VARCHAR, ',' ORDER BY p, i, j)) AS s FROM (SELECT p, i, unnest(e) AS c, generate_subscripts(e, 1) AS j FROM b{rounds})),
        coded AS (SELECT row, string_agg(lower(printf('%02x', i)), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY row),
        named AS (SELECT vec_id, label, code, error FROM coded JOIN whole USING (row))
        SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, s AS codebooks_sha256 FROM named, books
    """


ORACLE_SQL = {
    "op11_va_codes": _codes_sql(),
    "op12_warc_dictionary": r"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
        b AS (SELECT *, [instr('0123456789abcdef', substr(h, k, 1)) - 1 for k in range(1, 41)] AS x FROM p),
        v AS (SELECT *, [(((x[5 * k + 1] * 16 + x[5 * k + 2]) * 16 + x[5 * k + 3]) * 16 + x[5 * k + 4]) * 16 + x[5 * k + 5] for k in range(8)] AS w FROM b),
        d AS (SELECT *, array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((w[k // 4 + 1] >> (15 - 5 * (k % 4))) & 31) + 1, 1) for k in range(32)], '') AS digest, max(page_id) OVER (PARTITION BY html) AS rep FROM v)
        SELECT page_id, strlen(html)::BIGINT AS payload_bytes, digest AS payload_digest, CASE WHEN page_id = rep THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> rep THEN rep END AS refers_to FROM d
    """,
    "op13_feature_dictionary": r"""
        WITH RECURSIVE bits(b, k, c) AS (SELECT unnest(range(256)), 0, unnest(range(256)) UNION ALL SELECT b, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8),
        step AS (SELECT b, c FROM bits WHERE k = 8),
        d AS (SELECT doc_id, row_number() OVER () AS row, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
        f AS (SELECT row, word, count(*) AS n FROM (SELECT row, unnest(words) AS word FROM d) GROUP BY ALL),
        g AS (SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark) GROUP BY ALL),
        crc(word, h, i, c) AS (
            SELECT word, hex(word), 0, 4294967295 FROM (SELECT word FROM f UNION SELECT word FROM g)
            UNION ALL
            SELECT word, h, i + 1, xor(crc.c >> 8, step.c) FROM crc JOIN step ON step.b = xor(crc.c, (instr('0123456789ABCDEF', substr(h, 2 * i + 1, 1)) - 1) * 16 + instr('0123456789ABCDEF', substr(h, 2 * i + 2, 1)) - 1) & 255
            WHERE 2 * i < length(h)),
        bucket AS (SELECT word, xor(c, 4294967295) % 10000 AS bucket FROM crc WHERE 2 * i = length(h)),
        s AS (SELECT bucket, sum(n)::DOUBLE AS s FROM f JOIN bucket USING (word) GROUP BY bucket), t AS (SELECT bucket, sum(n)::DOUBLE AS t FROM g JOIN bucket USING (word) GROUP BY bucket),
        gain AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1) * ((SELECT coalesce(sum(s), 0) FROM s) + 10000) / ((s + 1) * ((SELECT coalesce(sum(t), 0) FROM t) + 10000))))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket)),
        w AS (SELECT row, sum(n)::BIGINT AS n, sum(n * gain)::BIGINT AS weight FROM f JOIN bucket USING (word) JOIN gain USING (bucket) GROUP BY row),
        h AS (SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight, list_sum([(instr('0123456789abcdef', substr(sha256('2024:' || doc_id), k, 1)) - 1) * (1 << (32 - 4 * k)) for k in range(1, 9)]) AS h FROM d LEFT JOIN w USING (row)),
        scored AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296)))::BIGINT AS score, n_features >= 20 AS eligible FROM h),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY eligible ORDER BY score DESC, doc_id) AS k, count(*) OVER (PARTITION BY eligible) AS m FROM scored)
        SELECT doc_id, n_features, weight, score, CASE WHEN eligible AND k <= m * 10 // 100 THEN k END AS rank FROM ranked
    """,
    "op10_url_trie": r"""
        WITH r AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
        h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
              regexp_extract(regexp_replace(rest, '^[^/?#]*', ''), '^[^?#]*') AS path FROM r),
        rules(verdict, rule_host, rule_path) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
        m AS (SELECT h.*, rule_host || rule_path AS rule, verdict,
              row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host) DESC NULLS LAST, length(rule_path) DESC) AS k
              FROM h LEFT JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
        SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE k = 1
    """,
}
