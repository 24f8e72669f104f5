"""The operators over the whole sample tables, with production parameters, and the SQL for those that have one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bylines.llm import (
    conversations,
    cross_tokenizer,
    decontamination,
    exact_dedup,
    languages,
    licenses,
    mixing,
    packing,
    secrets,
    simhash,
    substring_dedup,
    token_counts,
    toxicity,
)
from bylines.llm.common import table

TOKEN_LIMIT = 512
HELD_OUT_LANGUAGE = "crc32(CAST(doc_id AS string)) % 4 = 2"  # rows whose language teaches nothing
HELD_OUT_TOXICITY = "crc32(CAST(doc_id AS string)) % 3 = 1"  # rows whose labels teach nothing


def vocabulary(name: str) -> str:
    """Where a public tokenizer's file lies on this machine and, at the same place, on the executors."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return found.selectExpr("doc_id", "n_words", "n_removed", "sha2(kept, 256) AS kept_sha256")


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.selectExpr("doc_id", "lpad(lower(hex(fingerprint)), 16, '0') AS fingerprint", "component_id")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = secrets.find_secrets(docs, secrets.fit(docs))
    count = "CAST(size(filter(spans, s -> s.kind = '{0}')) AS bigint) AS n_{0}"
    joined = "array_join(transform({0}, s -> concat(s.kind, ':', s.start, ':', s.`end`)), ',')"
    return found.selectExpr(
        "doc_id",
        *[count.format(kind) for kind in ("assign", "access", "hex")],
        f"sha2({joined.format("filter(spans, s -> s.kind <> 'crf')")}, 256) AS base_sha256",
        f"{joined.format('spans')} AS spans",
    )


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = languages.identify(docs, languages.fit(docs, learnable=f"NOT ({HELD_OUT_LANGUAGE})"))
    return found.selectExpr(
        "doc_id", f"{HELD_OUT_LANGUAGE} AS held_out", "lang_pred", "score", "n_switches"
    )


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = token_counts.count_tokens(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))
    return found.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (table(spark, sf_dir, n) for n in ("documents", "labels"))
    model = toxicity.fit(docs, labels, learnable=f"NOT ({HELD_OUT_TOXICITY})")
    found = toxicity.score_texts(docs, model)
    predicted = f"CAST(score >= {toxicity.THRESHOLD} AS int) AS predicted"
    return found.selectExpr("doc_id", f"{HELD_OUT_TOXICITY} AS held_out", "score", predicted)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.exact_groups(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = (table(spark, sf_dir, n) for n in ("documents", "benchmark"))
    found = decontamination.find_passages(docs, benchmark)
    hit = "aggregate(spans, 0L, (n, s) -> n + s.last - s.first + 1)"
    return found.selectExpr(
        "doc_id",
        "n_words",
        f"{hit} AS n_hit",
        "CAST(size(items) AS bigint) AS n_items",
        f"{decontamination.items_digest()} AS items_sha256",
        "size(spans) > 0 AS contaminated",
    )


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(table(spark, sf_dir, "documents"))
    return found.selectExpr(
        "doc_id",
        "CAST(size(matches) AS bigint) AS n_statements",
        "array_max(matches.dice) AS best_dice",
        "array_join(array_sort(array_distinct(matches.license)), ',') AS licenses",
    )


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = map(vocabulary, ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken"))
    return packing.pack_documents(table(spark, sf_dir, "documents"), *files)


def op11_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mix_sources(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", "taken")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations")
    faults, turns = conversations.repair(conversations.damaged(given))
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    parts = [given.select("conv_id").distinct(), faults, conversations.digests(turns)]
    found = conversations.stacked(parts, (*counts, "audit", "repaired_sha256"))
    return found.selectExpr(
        "conv_id",
        *[f"coalesce({c}, 0L) AS {c}" for c in counts],
        "coalesce(audit, '') AS audit",
        "coalesce(repaired_sha256, sha2('', 256)) AS repaired_sha256",
    )


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = map(vocabulary, ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return cross_tokenizer.align_tokenizers(table(spark, sf_dir, "documents"), *files)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_simhash_dedup": op2_simhash_dedup,
    "op3_secret_scan": op3_secret_scan,
    "op4_language_id": op4_language_id,
    "op5_token_counts": op5_token_counts,
    "op6_toxicity": op6_toxicity,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_license_scan": op8_license_scan,
    "op9_packing": op9_packing,
    "op10_decontamination": op10_decontamination,
    "op11_source_mixing": op11_source_mixing,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_tokenizer_alignment": op13_tokenizer_alignment,
}

ORACLE = {
    "op7_exact_dedup": r"""
        WITH t AS (
          SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
        ), g AS (
          SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm
        )
        SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept,
          sha256(norm) AS text_sha256
        FROM t JOIN g USING (norm)""",
    "op8_license_scan": licenses.oracle(),
    "op11_source_mixing": mixing.oracle(),
}
