"""The queries of these operators, one for each, over whole tables; `SQL` has those that SQL can express."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.llm import hmm, kneser_ney, ngram_join, ogg, packing, pii, quality_rules, suffix_dedup, token_counts, word_bpe


def tokenizer() -> str:
    """Path of the public tokenizer file; QUARRYLIGHT_TOKENIZER names another."""
    if "QUARRYLIGHT_TOKENIZER" in os.environ:
        return os.environ["QUARRYLIGHT_TOKENIZER"]
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.classes(table(spark, sf_dir))


def op2_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ogg.round_trip(table(spark, sf_dir))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir)
    judged = quality_rules.judge(docs, quality_rules.train(docs, table(spark, sf_dir, "labels")))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return judged.select("doc_id", *(F.col(quality_rules.PREFIX + n).alias(n) for n in names))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(table(spark, sf_dir))


def op6_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_bpe.digests(table(spark, sf_dir), tokenizer())


def op7_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score(table(spark, sf_dir))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count(table(spark, sf_dir), token_counts.sample_edits(F.col("doc_id"), F.col("text")), tokenizer())


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir), tokenizer())


def op10_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.classify(table(spark, sf_dir), table(spark, sf_dir, "labels"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_ngram_jaccard,
        op2_ogg_media,
        op3_pii,
        op4_quality_rules,
        op5_suffix_dedup,
        op6_word_bpe,
        op7_hidden_markov,
        op8_token_counts,
        op9_packing,
        op10_kneser_ney,
    )
}
SQL: dict[str, str] = {
    "op1_ngram_jaccard": r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
 s AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
 e AS (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM s),
 l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
 r(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.other = l.a)
 SELECT s.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, c.component_id FROM s JOIN (SELECT doc_id, min(other) AS component_id FROM r GROUP BY 1) c USING (doc_id)"""
}
