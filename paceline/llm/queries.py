"""One query per operator, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from paceline.llm import chat, collocations, decontaminate, langid, merkle, neardup, packing, pii, quality, tokens, toxicity, urls, warc
from paceline.llm.common import read


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file is; a parameter of every operator that needs one."""
    import public_tokenizers

    return public_tokenizers.path(name)


def languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    net = langid.fit(docs.filter(~langid.held_out()))
    rows = docs.select("doc_id", "text", langid.held_out().alias("held_out"))
    return langid.identify(rows, net).drop("text")


def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return tokens.count_tokens(docs, tokenizer_path("word_bpe_49k.json")).drop("text")


def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read(spark, sf_dir, "documents"), width=2, percent=80)


def archived_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    archive = warc.write_archive(read(spark, sf_dir, "pages"))
    return warc.describe(warc.read_archive(spark, archive))


def surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace_entities(read(spark, sf_dir, "documents").select("doc_id", "text"), key="a key for tests")


def judged_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = urls.judge(read(spark, sf_dir, "pages").select("page_id", "url"))
    return pages.select("page_id", "host", "path", "rule", "verdict")


def packed_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read(spark, sf_dir, "labels").select("doc_id", "toxic").filter(~langid.held_out())
    classifier = toxicity.fit(docs, labels)
    rows = docs.withColumn("held_out", langid.held_out())
    return toxicity.score(rows, classifier).drop("text")


def decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.ledger(read(spark, sf_dir, "documents").select("doc_id", "text"))
    judged = quality.apply_policy(quality.apply_policy(rows, 1, "base_kept"), 2)
    return judged.selectExpr(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "not base_kept as base_failed",
        "kept",
        "failed",
    )


def manifest_proofs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.audit(read(spark, sf_dir, "documents"))


def phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read(spark, sf_dir, "documents"))


def chat_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], rows.schema)
    return chat.digest(chat.render(rows.union(extra), chat.TEMPLATE))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": languages,
    "op2_token_counts": token_counts,
    "op3_near_duplicates": near_duplicates,
    "op4_warc": archived_pages,
    "op5_pii_surrogates": surrogates,
    "op6_url_filter": judged_urls,
    "op7_packing": packed_sequences,
    "op8_toxicity": toxicity_scores,
    "op9_decontamination": decontamination,
    "op10_quality_rules": quality_rules,
    "op11_merkle_manifest": manifest_proofs,
    "op12_collocations": phrase_collocations,
    "op13_chat_format": chat_digests,
}
