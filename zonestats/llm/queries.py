"""Registered queries of this package: one thin query per operator, over whole tables."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import functions as F

from zonestats.llm import (alignment, byte_bpe, exact_dup, lang_id, license_scan, line_runs, mixing, near_dup, quality, simhash,
                           token_files, toxicity, whitening)
from zonestats.llm.common import read_table
from zonestats.session import scratch_dir

QUERIES, ORACLES = {}, {}


def _query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f
    return add


@_query("op1_quality_llr")
def _op1(spark, d):
    docs = read_table(spark, d, "documents").select("doc_id", "text")
    weights = quality.bucket_weights(docs, quality.trusted_ids(read_table(spark, d, "labels")))
    return quality.quality(docs, weights).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                                                 "base_failed", "kept", "score")


@_query("op2_token_files")
def _op2(spark, d):
    folder = scratch_dir(spark, f"tokens-{uuid.uuid4().hex}")
    index = token_files.write_tokens(read_table(spark, d, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"),
                                     public_tokenizers.PATTERN)
    return token_files.read_checksums(index, folder)


@_query("op3_exact_dedup", r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM n JOIN g USING (t)
""")
def _op3(spark, d):
    return exact_dup.exact_duplicates(read_table(spark, d, "documents"))


@_query("op4_mix_sources")
def _op4(spark, d):
    return mixing.mix(read_table(spark, d, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@_query("op5_line_runs", r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
bad AS (SELECT key, max(doc_id) AS last_doc FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
j AS (SELECT k.doc_id, k.pos, k.line, bad.key IS NOT NULL AND k.doc_id <> bad.last_doc AS gone FROM k LEFT JOIN bad USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
""")
def _op5(spark, d):
    docs = read_table(spark, d, "documents").select("doc_id", "text")
    return line_runs.dedup_lines(docs).select("doc_id", "n_lines", "n_dropped",
                                              F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def _remainder(n: int):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


@_query("op6_lang_id")
def _op6(spark, d):
    docs = read_table(spark, d, "documents").select("doc_id", "text", "lang")
    held = F.coalesce(_remainder(4) == 2, F.lit(False))
    model = lang_id.fit(docs, held)
    return lang_id.identify(docs, model).select("doc_id", held.alias("held_out"), F.col("nearest").alias("lang_pred"), "score",
                                                "rejected")


@_query("op7_minmax_near_dup")
def _op7(spark, d):
    return near_dup.near_duplicates(read_table(spark, d, "documents"), words=4)


@_query("op8_license_scan")
def _op8(spark, d):
    return license_scan.scan_licenses(read_table(spark, d, "documents"))


@_query("op9_toxic_crf")
def _op9(spark, d):
    docs = read_table(spark, d, "documents").select("doc_id", "text")
    held = F.coalesce(_remainder(5) == 0, F.lit(False))
    model = toxicity.fit(docs, read_table(spark, d, "labels"), held)
    out = toxicity.tag(docs, model)
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans")


@_query("op10_byte_bpe")
def _op10(spark, d):
    return byte_bpe.round_trip(read_table(spark, d, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
                               public_tokenizers.PATTERN)


@_query("op11_simhash_golay")
def _op11(spark, d):
    return simhash.simhash_duplicates(read_table(spark, d, "documents"))


@_query("op12_whitening")
def _op12(spark, d):
    return whitening.whiten(read_table(spark, d, "embeddings"))


@_query("op13_token_alignment")
def _op13(spark, d):
    return alignment.align_tokenizers(read_table(spark, d, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                                      public_tokenizers.path("piece_bpe_32k.model")).scores()


@_query("pipeline")
def _pipeline(spark, d):
    import corpus_pipeline

    return corpus_pipeline.run(spark, d)
