"""Registered queries of this subpackage and their checking SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from veilscan.llm import alignment, bpe, chat, chat_events, decontaminate, exact_dedup, files, lexical_search, license_scan, simhash, suffix_array, token_count, token_files, toxicity, warc
from veilscan.llm.inputs import table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


@query("op1_chat_tool_links", chat_events.SQL)
def op1_chat_tool_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = chat_events.conversation_events(table(spark, sf_dir, "conversations"))
    return chat.link_tool_calls(events, chat.schema_table(spark))


@query("op2_warc_normaliser")
def op2_warc_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole, single = files.shared_folder(spark, "warc-whole"), files.shared_folder(spark, "warc")
    warc.write_archives(warc.page_records(table(spark, sf_dir, "pages")), f"{whole}/archives")
    return warc.read_archives(warc.normalise(spark, f"{whole}/archives", single))


@query("op3_simhash_near_dedup")
def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query("op4_suffix_array_dedup")
def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = suffix_array.remove_repeats(table(spark, sf_dir, "documents"), digest=True)
    return cleaned.select("doc_id", "n_bytes", "n_removed", "n_spans", F.lower(F.hex("kept")).alias("kept_sha256"))


@query("op5_benchmark_decontamination")
def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["after"] - s["first"])
    names = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(names.cast("binary"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )


@query("op6_token_files")
def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    manifest = token_files.write_token_files(
        table(spark, sf_dir, "documents"), path, files.shared_folder(spark, "tokens"), vocabulary_size=50_257
    )
    return token_files.read_token_files(manifest)


@query("op7_toxicity_ordinal")
def op7_toxicity_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return toxicity.score(documents, toxicity.train(documents, table(spark, sf_dir, "labels")))


@query(
    "op8_exact_dedup",
    "WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), "
    "g AS (SELECT text, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text) "
    "SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t.text) AS text_sha256 "
    "FROM t JOIN g ON t.text = g.text",
)
def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.mark_duplicates(table(spark, sf_dir, "documents"))


@query("op9_bpe_round_trip")
def op9_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op10_token_counts")
def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_count.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 2048)


@query("op12_license_scan")
def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_summary(license_scan.license_detections(table(spark, sf_dir, "documents")))


@query("op13_lexical_search", lexical_search.SQL)
def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op11_token_alignment")
def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, second = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    scored = alignment.link_scores(table(spark, sf_dir, "documents"), first, second, digest=True)
    return scored.select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("groups").alias("groups_sha256")
    )
