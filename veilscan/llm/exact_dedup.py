"""Exact duplicates by skew-safe combining.

Rows are compared in three steps, each on the full content: copies within a task are
combined before anything is shuffled (Spark's partial aggregation), the rest meets in groups
of (digest, salt, content), and the winners of the salts meet in groups of (digest, content).
A content that a third of all rows share reaches the second step as one row per task and the
third as one row per salt, so no task gathers its rows.

The digest only routes rows. Two contents under one digest stay two groups at every step.

Defined cases: a null text is an empty text; a null id is smaller than any id; of rows that
repeat id and text one stays; an empty table gives an empty table; further columns, whatever
their names, are neither read nor compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from veilscan.llm.inputs import id_and_text, utf8
from veilscan.session import materialise

SALTS = 16


def _digested(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return id_and_text(docs, id_col, text_col).withColumn("digest", F.unhex(F.sha2(utf8(F.col("text")), 256)))


def _salt(salts: int) -> Column:
    return F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int")


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One row per distinct content: digest, text, keep_id (the largest id), group_size."""
    salted = (
        _digested(docs, id_col, text_col)
        .groupBy("digest", _salt(salts).alias("salt"), "text")
        .agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    )
    return salted.groupBy("digest", "text").agg(
        F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size")
    )


def mark_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    The groups are written without their contents. As long as no digest holds two contents,
    which the table shows, documents find their group by digest alone and no content is
    shuffled for that; the documents of a digest that holds several find it by content.
    """
    groups = duplicate_groups(docs, id_col, text_col, salts)
    narrow = materialise(groups.select("digest", "keep_id", "group_size"), "exact-groups")
    shared = [r.digest for r in narrow.groupBy("digest").count().filter("count > 1").select("digest").limit(1).collect()]
    rows = _digested(docs, id_col, text_col)
    if not shared:
        members = rows.groupBy("doc_id", "digest").agg(F.count("*").alias("copies"))
        joined = members.join(narrow, "digest")
    else:
        members = rows.groupBy("doc_id", "digest", "text").agg(F.count("*").alias("copies"))
        joined = members.join(groups, ["digest", "text"])
    return (
        joined.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
        .select(
            "doc_id", "keep_id", "group_size",
            (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"),
        )
    )


def drop_duplicates_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """The rows that stay, with all their columns: of equal texts the one with the largest
    id; of rows equal in id and text the one whose other columns sort last."""
    digest, salt, winner, same = "__digest", "__salt", "__winner", "__text"
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    others = [c for c in docs.columns if c not in (id_col, text_col)]
    rank = F.struct(
        F.col(f"`{id_col}`").isNotNull().alias("i0"), F.col(f"`{id_col}`").alias("i1"),
        *[F.col(f"`{c}`").alias(f"o{k}") for k, c in enumerate(others)],
        F.col(f"`{text_col}`").isNotNull().alias("t0"),
    )
    rows = docs.select(
        F.unhex(F.sha2(utf8(text), 256)).alias(digest),
        F.pmod(F.xxhash64(F.col(f"`{id_col}`")), F.lit(salts)).cast("int").alias(salt),
        text.alias(same), rank.alias(winner),
    )
    salted = rows.groupBy(digest, salt, same).agg(F.max(winner).alias(winner))
    kept = salted.groupBy(digest, same).agg(F.max(winner).alias(winner))
    columns = {id_col: F.col(f"{winner}.i1"), text_col: F.when(F.col(f"{winner}.t0"), F.col(same))}
    columns |= {c: F.col(f"{winner}.o{k}") for k, c in enumerate(others)}
    return kept.select(*[columns[c].alias(c) for c in docs.columns])
