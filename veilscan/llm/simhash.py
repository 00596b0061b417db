"""Near-duplicates by 64-bit SimHash, found by anchor-point covering.

Fingerprints link at ``max_bits`` (4) or fewer differing bits. The 64 bits are cut into three
blocks of 22, 21 and 21, so two linked fingerprints differ by at most one bit in one block at
least. In a block the anchors are a covering code: a Hamming code over 15 of the bits, every
combination of the others. Every value is within the covering radius 1 of an anchor (its
home), and whatever differs from it by one bit is within radius plus threshold, 2, of that
anchor. So each fingerprint goes to its home and to all anchors within 2, and each anchor
compares its homes with its visitors.

Equal fingerprints are combined before, and an anchor returns a spanning forest of the links
it finds, not the pairs: at most as many rows as it received. Anchors that would compare too
much are cut into pieces of their homes, so no task depends on a popular anchor. The number of
anchors is fixed (655,360), which bounds the table of piece counts that is broadcast.

Defined cases: null and empty texts have fingerprint zero and link like any other; texts of
fewer words than a shingle are one shingle; a row with a null id is linked but cannot name the
component (null if there is no other); repeated rows are repeated in the result; an empty table
gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from veilscan.llm.components import component_labels
from veilscan.llm.inputs import id_and_text, shuffle_partitions
from veilscan.session import materialise

WORDS_PER_SHINGLE = 4
MAX_BITS = 4
SEED = 42
BLOCKS = ((0, 22), (22, 21), (43, 21))
CODE_BITS = 15
RADIUS = 1
# Comparisons of one piece of an anchor, in homes.
HOMES_PER_PIECE = 1024


def fingerprint(text: str, words: int = WORDS_PER_SHINGLE) -> int:
    """Lower-case A-Z, split at ASCII white space, hash all shingles, take majority bits."""
    parts = text.encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(parts) <= words:
        hashes = [digest(b" ".join(parts), SEED)]
    else:
        joined = b" ".join(parts)
        ends = np.cumsum(np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) + 1) - 1
        starts = np.concatenate(([0], ends[: len(parts) - words] + 1))
        hashes = [digest(joined[s:e], SEED) for s, e in zip(starts.tolist(), ends[words - 1 :].tolist())]
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[at : at + (1 << 16)], dtype="<u8")
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    packed = np.packbits((2 * ones > len(hashes)).astype(np.uint8), bitorder="little")
    return int(packed.view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS_PER_SHINGLE) -> DataFrame:
    """doc_id, copy (SHA-256 of the text) and fp, the fingerprint as a signed long."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t, words) for t in batch["text"]), dtype=np.uint64, count=len(batch))
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "copy": batch["copy"], "fp": fps.view(np.int64)})

    texts = id_and_text(docs, id_col, text_col).withColumn("copy", F.sha2(F.col("text").cast("binary"), 256))
    return texts.mapInPandas(run, "doc_id long, copy string, fp long")


def _syndromes(values: np.ndarray) -> np.ndarray:
    """Position of the wrong bit (1 to 15) for a Hamming code over 15 bits; 0 for code words."""
    out = np.zeros(len(values), dtype=np.int64)
    for bit in range(CODE_BITS):
        out ^= np.where((values >> bit) & 1, bit + 1, 0)
    return out


def _flips(width: int, within: int) -> list[list[tuple[int, bool]]]:
    """For each syndrome the bit patterns that lead to an anchor within ``within`` bits, and
    whether they lead to the home."""
    tables: list[list[tuple[int, bool]]] = []
    extra = range(CODE_BITS, width)
    for syndrome in range(CODE_BITS + 1):
        found = []
        for near in range(within + 1):
            for bits in combinations(range(CODE_BITS), near):
                left = syndrome
                for b in bits:
                    left ^= b + 1
                if left:
                    continue
                for far in range(within - near + 1):
                    for more in combinations(extra, far):
                        home = far == 0 and near == (1 if syndrome else 0)
                        found.append((sum(1 << b for b in (*bits, *more)), home))
        tables.append(found)
    return tables


def _anchors(fps: np.ndarray, block_bits: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(key, fp, is home) arrays for all blocks."""
    for number, (shift, width) in enumerate(BLOCKS):
        values = ((fps >> np.uint64(shift)) & np.uint64((1 << width) - 1)).astype(np.int64)
        syndromes = _syndromes(values)
        tables = _flips(width, RADIUS + block_bits)
        for syndrome in np.unique(syndromes).tolist():
            mine = syndromes == syndrome
            flips = np.array([f for f, _ in tables[syndrome]], dtype=np.int64)
            homes = np.array([h for _, h in tables[syndrome]])
            key = (values[mine][:, None] ^ flips[None, :]) | (number << 24)
            yield key.ravel(), np.repeat(fps[mine], len(flips)), np.tile(homes, int(mine.sum()))


def _spread(block_bits: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fps = batch["fp"].to_numpy().view(np.uint64)
            for key, fp, home in _anchors(fps, block_bits):
                yield pd.DataFrame({"key": key, "fp": fp.view(np.int64), "home": home})

    return run


def _links(homes: np.ndarray, visitors: np.ndarray, max_bits: int) -> Iterator[tuple[int, int]]:
    """A spanning forest of the links between homes and visitors."""
    labels = np.arange(len(visitors))
    for home in homes:
        near = np.nonzero(np.bitwise_count(visitors ^ home) <= max_bits)[0]
        if len(near) < 2:
            continue
        groups = np.unique(labels[near])
        if len(groups) > 1:
            for other in groups[1:].tolist():
                yield int(visitors[groups[0]]), int(visitors[other])
            labels[np.isin(labels, groups[1:])] = groups[0]


def _compare(max_bits: int):
    """Rows come sorted by (key, piece), a piece's homes before its visitors."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: list[pd.DataFrame] = []
        found: list[tuple[int, int]] = []

        def flush(frame: pd.DataFrame) -> None:
            place = frame["key"].to_numpy().astype(np.int64) * (1 << 32) + frame["piece"].to_numpy()
            fps, home = frame["fp"].to_numpy().view(np.uint64), frame["home"].to_numpy()
            cuts = np.concatenate(([0], np.nonzero(np.diff(place))[0] + 1, [len(place)]))
            for start, end in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if end - start > 1 and home[start]:
                    own = fps[start:end]
                    found.extend(_links(own[home[start:end]], own, max_bits))

        for batch in batches:
            if not len(batch):
                continue
            key, piece = batch["key"].to_numpy(), batch["piece"].to_numpy()
            last = np.nonzero((key != key[-1]) | (piece != piece[-1]))[0]
            cut = int(last[-1]) + 1 if len(last) else 0
            if rest and (cut or rest[0]["key"].iloc[0] != key[0] or rest[0]["piece"].iloc[0] != piece[0]):
                flush(pd.concat([*rest, batch.iloc[:cut]]))
                rest = []
            elif cut:
                flush(batch.iloc[:cut])
            rest.append(batch.iloc[cut:])
            if found:
                yield _edges(found)
                found.clear()
        if rest:
            flush(pd.concat(rest))
        if found:
            yield _edges(found)

    return run


def _edges(found: list[tuple[int, int]]) -> pd.DataFrame:
    pairs = np.array(found, dtype=np.uint64).view(np.int64)
    return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})


def fingerprint_links(distinct: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column ``fp``): a spanning forest per anchor
    of all pairs that differ in ``max_bits`` bits or fewer."""
    if max_bits // len(BLOCKS) > 2:
        raise ValueError("three blocks cover 0 to 8 differing bits")
    parts = shuffle_partitions(distinct)
    rows = distinct.select("fp").mapInPandas(_spread(max_bits // len(BLOCKS)), "key int, fp long, home boolean")
    sizes = rows.groupBy("key").agg(F.sum(F.col("home").cast("long")).alias("homes"))
    pieces = sizes.filter(F.col("homes") > HOMES_PER_PIECE).select(
        "key", F.ceil(F.col("homes") / HOMES_PER_PIECE).cast("int").alias("pieces")
    )
    cut = rows.join(F.broadcast(pieces), "key", "left").withColumn("pieces", F.coalesce("pieces", F.lit(1)))
    own = F.pmod(F.xxhash64("fp"), F.col("pieces").cast("long")).cast("int")
    dealt = cut.withColumn(
        "piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))
    ).withColumn("home", F.col("home") & (own == F.col("piece")))
    return (
        dealt.select("key", "piece", "home", "fp")
        .repartition(parts, "key", "piece")
        .sortWithinPartitions("key", "piece", F.col("home").desc())
        .mapInPandas(_compare(max_bits), "a long, b long")
    )


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    words: int = WORDS_PER_SHINGLE, max_bits: int = MAX_BITS,
) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (the smallest
    id reachable over links). Components need not be cliques."""
    return near_groups(docs, id_col, text_col, words, max_bits).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def near_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    words: int = WORDS_PER_SHINGLE, max_bits: int = MAX_BITS,
) -> DataFrame:
    """The same with what tells rows of one id apart: doc_id, copy (SHA-256 of the text), fp, label
    (of the component) and component_id."""
    prints = materialise(fingerprints(docs, id_col, text_col, words), "fingerprints")
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    labels = materialise(component_labels(fingerprint_links(distinct, max_bits)), "labels")
    labelled = distinct.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "label", F.coalesce("label", "fp")
    )
    names = labelled.groupBy("label").agg(F.min("least").alias("component_id"))
    classes = labelled.join(names, "label").select("fp", "label", "component_id")
    return prints.join(classes, "fp").select("doc_id", "copy", "fp", "label", "component_id")


def keep_one_per_group(docs: DataFrame, marks: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, without those that are near-duplicates of a kept one:
    each group of ``marks`` (doc_id, component_id, and label, the group, and copy, the SHA-256 of
    the text) keeps the row of its smallest id; of several rows with that id the one with the smallest digest, of rows equal
    in both any one. Rows without an id cannot be named by a group and are kept. Marks without
    ``copy`` tell rows by their id only: of several with one id the smallest digest stays."""
    own = F.sha2(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary"), 256)
    named = marks.filter(F.col("doc_id") == F.col("component_id"))
    told = "copy" in marks.columns
    kept = (named.groupBy("label", "component_id").agg(F.min("copy").alias("__copy")).drop("label").distinct() if told else named.select("component_id").distinct())
    kept = kept.withColumnRenamed("component_id", "__id")
    rows = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("__id"), own.alias("__copy"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")
    )
    keys = ["__id", "__copy"] if told else ["__id"]
    one = Window.partitionBy(*keys).orderBy("__copy", F.xxhash64("__row"))
    chosen = (
        rows.filter("__id IS NOT NULL").join(kept, keys, "left_semi")
        .withColumn("__at", F.row_number().over(one)).filter("__at = 1")
    )
    return chosen.select("__row.*").unionByName(rows.filter("__id IS NULL").select("__row.*"))
