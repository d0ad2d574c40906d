"""The operators of this folder as queries over the given tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from netledger.llm import (
    bpe, decontaminate, fingerprint, html_text, jaccard, licences, pii, prefix_trie, quality, toxicity, warc, whitening, wordpiece,
)
from netledger.llm.shipping import ship_package
from netledger.llm.storage import stage_path

BPE_RANKS = "byte_bpe_multi_50k.tiktoken"
PIECE_RANKS = "byte_bpe_50k.tiktoken"
#: Least probability of grade 1 or better for a document to be kept.
KEEP_FROM = 0.5


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected grade, tail probability and decision for every document."""
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = quality.fit(docs, quality.ratings_from_labels(labels), grades=3)
    scored = docs.select("doc_id", quality.graded(model, F.col("text")).alias("q"))
    return scored.select(
        "doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "q.expected_grade", "q.tail_prob", "q.grade",
        (F.col("q.tail_prob") >= KEEP_FROM).alias("keep"),
    )


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base spans and disclosing terms of every document."""
    return pii.report(_table(spark, sf_dir, "documents"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with every benchmark item found in it."""
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of words, word pieces and unknown words of every document."""
    return wordpiece.count_pieces(_table(spark, sf_dir, "documents"), public_tokenizers.path(PIECE_RANKS))


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class, group and number of links of every document."""
    return jaccard.ngram_join(_table(spark, sf_dir, "documents"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and hashes of the token ids and of the decoded bytes of every document."""
    docs = _table(spark, sf_dir, "documents")
    return bpe.encode(docs, public_tokenizers.path(BPE_RANKS), bpe.digests, bpe.DIGEST_FIELDS)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as read back from the archives it was written to."""
    return warc.report(_table(spark, sf_dir, "pages"), stage_path(spark, "warc"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    learned = labels.filter(~quality.held_out(F.col("doc_id"))).select("doc_id", F.col("toxic").alias("label"))
    model = toxicity.fit(docs, learned)
    scored = docs.select("doc_id", toxicity.scores(model, spark, F.col("text")).alias("score"))
    return scored.select(
        "doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, with their likeness."""
    return fingerprint.with_edits(_table(spark, sf_dir, "documents"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened coordinates of every usable vector on the four leading components."""
    return whitening.whitened(_table(spark, sf_dir, "embeddings"))


def op12_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and notices of every document."""
    return licences.report(_table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the prefix trie of the rebuilt conversations."""
    return prefix_trie.prefix_trie(_table(spark, sf_dir, "conversations"))


def _shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return query(spark, sf_dir)

    run.__doc__ = query.__doc__
    return run


QUERIES = {q.__name__: _shipped(q) for q in (
    op1_quality, op2_pii, op3_decontaminate, op4_token_counts, op5_html, op6_ngram_join, op7_bpe, op8_warc, op9_toxicity,
    op10_fingerprints, op11_whitening, op12_licences, op13_prefix_trie,
)}

_CRC32 = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda z: ascii(z)::BIGINT)),
    lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
        lambda u, v: CASE WHEN u % 2 = 1 THEN xor(u // 2, 3988292384) ELSE u // 2 END)), 4294967295)"""

#: SQL where it can express the operator; see tests/llm for the brute-force checks of the others.
ORACLES: dict[str, str] = {
    "op13_prefix_trie": f"""
WITH turns AS (
    SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place
    FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
    SELECT conv_id, conv_id - conv_id % 100 AS base, {_CRC32} % 6 AS h FROM (SELECT DISTINCT conv_id FROM turns)),
chosen AS (
    SELECT c.conv_id, 0 AS part, place, role, text FROM convs c JOIN turns t ON t.conv_id = c.base WHERE place <= h
    UNION ALL
    SELECT c.conv_id, 1, place, role, text FROM convs c JOIN turns t ON t.conv_id = c.conv_id WHERE place > h),
paths AS (
    SELECT conv_id, row_number() OVER w AS depth, string_agg(md5(length(role) || ':' || role || text), '') OVER w AS k,
        length(text) AS chars
    FROM chosen WINDOW w AS (PARTITION BY conv_id ORDER BY part, place)
    UNION ALL
    SELECT conv_id, 0, '', 0 FROM convs),
members AS (SELECT *, depth = max(depth) OVER (PARTITION BY conv_id) AS ends FROM paths),
nodes AS (
    SELECT k, depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * min(chars) AS saved,
        sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
    FROM members GROUP BY k, depth),
children AS (SELECT left(k, (depth - 1) * 32) AS k, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
counted AS (SELECT nodes.*, coalesce(children.n, 0) AS n_children FROM nodes LEFT JOIN children USING (k)),
subtrees AS (
    SELECT left(k, d * 32) AS k, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum(saved)::BIGINT AS saved_tokens
    FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM counted) GROUP BY 1)
SELECT c.conv_id, c.depth, p.conv_id AS parent_conv_id, c.n_convs, c.n_children, s.n_leaves, s.saved_tokens, c.ends_sha256
FROM counted c JOIN subtrees s ON s.k = c.k LEFT JOIN nodes p ON c.depth > 0 AND p.k = left(c.k, (c.depth - 1) * 32)
""",
}
