"""From raw documents to token digests: toxicity, exact and near copies, leaks, tokens.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir), works on all rows
its predecessor kept and returns the columns of documents, the last one its digests. The tables
``labels`` and ``benchmark`` come from sf_dir. A run writes every stage to the shared folder,
so a lost executor repeats one stage at most.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from veilscan.llm import bpe, decontaminate, exact_dedup, simhash, similar, toxicity
from veilscan.llm.inputs import table
from veilscan.session import materialise


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fitted on the labels of the documents given; the rest is scored and judged whole."""
    return toxicity.reject_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_duplicates_exact(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """By SimHash, as ``op3`` links them; of what is left, texts that share 80 % of their five-word
    shingles, which four differing bits may miss. The smallest id of a group stays."""
    apart = materialise(simhash.keep_one_per_group(docs, simhash.near_groups(docs)), "pipeline-simhash")
    return simhash.keep_one_per_group(apart, similar.similar_groups(apart))


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", remove_benchmark),
    ("bpe", encode_tokens),
]

# The fitted classifier, the fingerprints and the merges have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
