"""Near-duplicates of a given Jaccard similarity of shingle sets, exactly.

A text is the set of the 64-bit hashes of its five-word shingles. Texts with equal sets are
combined; two sets link if their Jaccard similarity is at least ``similarity``, which is checked
on the whole sets for every link. No link is missed either:

1. *Candidates.* Two sets of n and m shingles of similarity s share s * max(n, m) at least, so in
   any common order of all shingles they share one among their first n - ceil(s * n) + 1. Any order
   is exact; this one puts last what is frequent (counted over all texts, in ``SLOTS`` slots), so
   most prefixes meet nobody.
2. *Rounds.* The sets that share a prefix shingle are its bucket. First each set is compared with one
   other, the smallest it meets, which joins most near copies. Then each round compares the smallest
   set of a bucket with the others, which settles those pairs, and takes it out. Pairs whose sizes
   or parity bits already tell that they differ too much are not compared shingle by shingle, nor
   are pairs that lie in one component already. Buckets whose rest lies in one component are done:
   a large group of near copies takes a round or two.
   Sets are written with their shingles only when they are to be compared; a bitmap of fixed size
   (``FILTER_BITS``) tells the pass over the texts which ones, and it may name a few too many.
3. *The rest.* After ``ROUNDS`` rounds all sets of a bucket are compared with each other, dealt into
   pieces by the shingles of their homes. A piece returns a spanning forest, never pairs. Before any
   shingles are sent, sizes, parity bits and components are compared in the same way; a set stays
   in a bucket only if it may be similar to a set of another component there. What is left of the
   many buckets two sets share is mostly the same few sets, and such buckets are one.

Defined cases: null and empty texts have no shingles and are one group; texts of fewer words than
a shingle are one shingle; a row with a null id is linked but cannot name the component (null if
there is no other); repeated rows are repeated in the result; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from veilscan.llm.components import component_labels
from veilscan.llm.files import release_shuffles
from veilscan.llm.inputs import id_and_text, shuffle_partitions
from veilscan.llm.simhash import SEED
from veilscan.session import discard, materialise

WORDS_PER_SHINGLE = 5
SIMILARITY = 0.8
SLOTS = 1 << 20
ROUNDS = 3
# Of one piece: sets compared with one other, and shingles of the sets compared with all others.
ROWS_PER_PIECE = 512
SHINGLES_PER_PIECE = 1 << 18
# Of one piece where only sizes and parity bits are compared: homes, and visitors at a time.
HOMES_PER_PIECE = 1 << 12
VISITORS = 64
# Longs of parity bits where the sets left are large and few: 8192 bits.
WIDE = 128
EDGES_PER_BATCH = 1 << 14
REMEMBERED = 50_000
BLOCKS = 64
SALTS = 64
FILTER_BITS = 1 << 25
# Longs of parity bits a set carries where its shingles do not.
PARITY = 8
_ODD = [f"p{k}" for k in range(PARITY)]


class WordHashes(dict):
    """64-bit hashes of words, at most ``REMEMBERED`` of them at a time."""

    def __missing__(self, word: bytes) -> int:
        made = xxhash.xxh64_intdigest(word, SEED)
        if len(self) >= REMEMBERED:
            self.clear()
        if len(word) <= 64:
            self[word] = made
        return made


_WORD_HASHES = WordHashes()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingle_set(text: str, words: int = WORDS_PER_SHINGLE) -> np.ndarray:
    """Sorted hashes of the shingles: lower-case A-Z, split at ASCII white space. The hash of a
    shingle is made of its words' hashes and their order."""
    parts = text.encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.zeros(0, dtype="<u8")
    own = np.fromiter(map(_WORD_HASHES.__getitem__, parts), dtype=np.uint64, count=len(parts))
    size = min(words, len(parts))
    sums = np.full(len(parts) - size + 1, size, dtype=np.uint64)
    for k in range(size):
        sums = _mixed(sums + own[k : len(own) - size + 1 + k])
    return np.unique(sums)


def _parity(shingles: np.ndarray, longs: int = PARITY) -> np.ndarray:
    """For each of 64 * ``longs`` slots whether an odd number of shingles falls there: two sets
    differ in at least as many shingles as slots."""
    slots = (shingles >> np.uint64(32)) % np.uint64(64 * longs)
    odd = (np.bincount(slots.astype(np.int64), minlength=64 * longs) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view("<i8")


def _parts(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[tuple[pa.RecordBatch, list[str], list[np.ndarray], np.ndarray]]:
    """Batches of bounded size with their texts, shingle sets and nodes."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            texts = [t.as_py() for t in part.column("text")]
            sets = [shingle_set(t, words) for t in texts]
            nodes = np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets], dtype=np.uint64).view(np.int64)
            yield part, texts, sets, nodes


_SETS = f"doc_id long, copy string, node long, n int, {', '.join(f'{p} long' for p in _ODD)}, prefix array<long>"


def shingle_sets(texts: DataFrame, counts, similarity: float = SIMILARITY, words: int = WORDS_PER_SHINGLE) -> DataFrame:
    """doc_id, copy (SHA-256 of the text), node (a hash of the set), n (its size), parity bits, and
    the prefix of its shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, every, sets, nodes in _parts(batches, words):
            copies = [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in every]
            odd = np.array([_parity(s) for s in sets]).reshape(-1, PARITY)
            prefixes = [s[np.lexsort((s, counts.value[_slots(s)]))[: prefix_size(len(s), similarity)]] for s in sets]
            ends = pa.array(np.cumsum([0, *map(len, prefixes)]), pa.int32())
            columns = [part.column("doc_id"), pa.array(copies, pa.string()), pa.array(nodes), pa.array(map(len, sets), pa.int32())]
            columns += [pa.array(odd[:, k].copy()) for k in range(PARITY)]
            columns += [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(prefixes).astype("<u8").view(np.int64)))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "copy", "node", "n", *_ODD, "prefix"])
        pa.default_memory_pool().release_unused()

    return texts.mapInArrow(run, _SETS)


def _chosen_sets(texts: DataFrame, bits, words: int) -> DataFrame:
    """node and shingles (eight bytes each) of the sets the bitmap names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        named = np.unpackbits(np.frombuffer(bits.value, dtype=np.uint8), bitorder="little")
        for _, _, sets, nodes in _parts(batches, words):
            chosen = np.nonzero(named[nodes & (FILTER_BITS - 1)])[0].tolist()
            if chosen:
                columns = [pa.array(nodes[chosen]), pa.array([sets[k].tobytes() for k in chosen], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["node", "shingles"])
        pa.default_memory_pool().release_unused()

    return texts.mapInArrow(run, "node long, shingles binary")


class Sets:
    """The shingles of the sets that are compared, read out of the texts when first needed."""

    def __init__(self, texts: DataFrame, words: int) -> None:
        self.texts, self.words = texts, words
        self.stored = [texts.sparkSession.createDataFrame([], "node long, shingles binary")]

    def of(self, nodes: DataFrame) -> DataFrame:
        """A table that has the sets of these nodes."""
        missing = nodes.select("node").distinct()
        for one in self.stored[1:]:
            missing = missing.join(one.select("node"), "node", "left_anti")
        missing = materialise(missing, "similar-missing")
        if not missing.isEmpty():
            bits = self.texts.sparkSession.sparkContext.broadcast(_bitmap(missing))
            found = _chosen_sets(self.texts, bits, self.words).join(missing, "node", "left_semi").dropDuplicates(["node"])
            self.stored.append(materialise(found, "similar-sets"))
            bits.destroy()
        discard(missing)
        return reduce(DataFrame.unionByName, self.stored)


def _bitmap(nodes: DataFrame) -> bytes:
    """``FILTER_BITS`` bits, set where a node falls; tasks combine theirs."""
    slot = F.col("node").bitwiseAND(F.lit(FILTER_BITS - 1))
    found = nodes.groupBy(F.bitmap_bucket_number(slot).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits")
    )
    out = np.zeros(FILTER_BITS + (1 << 15), dtype=np.uint8)
    for r in found.collect():
        # Bucket k holds the slots from 32768 * (k - 1) + 1 on, bucket 0 those up to 0.
        first = 32768 * (r.bucket - 1) + 1 if r.bucket else 0
        held = np.unpackbits(np.frombuffer(r.bits, dtype=np.uint8), bitorder="little")
        own = out[first : first + 32768]
        own |= held[: len(own)]
    return np.packbits(out[:FILTER_BITS], bitorder="little").tobytes()


def _shingles(value: pa.Scalar) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), dtype="<u8")


def _slots(shingles: np.ndarray) -> np.ndarray:
    return (shingles & np.uint64(SLOTS - 1)).astype(np.int64)


def _counts(texts: DataFrame, words: int) -> np.ndarray:
    """How many sets hold a shingle of each slot. A task sends its counts as ``BLOCKS`` rows of
    bytes (255 stands for more); they are added up in two levels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, salt = np.zeros(SLOTS, dtype=np.int64), TaskContext.get().partitionId() % SALTS
        for _, _, sets, _ in _parts(batches, words):
            total += np.bincount(_slots(np.concatenate(sets)), minlength=SLOTS)
        blocks = np.minimum(total, 255).astype("<u4").reshape(BLOCKS, -1)
        held = [b for b in range(BLOCKS) if blocks[b].any()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(held, pa.int32()), pa.array([salt] * len(held), pa.int32()), pa.array([zlib.compress(blocks[b].tobytes(), 1) for b in held], pa.binary())],
            ["block", "salt", "counts"],
        )

    def added(rows: pa.Table) -> pa.Table:
        total = np.zeros(SLOTS // BLOCKS, dtype=np.int64)
        for packed in rows.column("counts"):
            total += np.frombuffer(zlib.decompress(packed.as_py()), dtype="<u4")
        whole = zlib.compress(np.minimum(total, (1 << 32) - 1).astype("<u4").tobytes(), 1)
        return pa.table({"block": rows.column("block")[:1], "salt": rows.column("salt")[:1], "counts": pa.array([whole], pa.binary())})

    schema = "block int, salt int, counts binary"
    once = texts.mapInArrow(run, schema).groupBy("block", "salt").applyInArrow(added, schema)
    out = np.zeros((BLOCKS, SLOTS // BLOCKS), dtype=np.uint32)
    for r in once.groupBy("block").applyInArrow(added, schema).collect():
        out[r.block] = np.frombuffer(zlib.decompress(r.counts), dtype="<u4")
    return out.ravel()


def prefix_size(n: int, similarity: float) -> int:
    return n - math.ceil(similarity * n - 1e-9) + 1 if n else 0


def _compare(similarity: float):
    """Rows come sorted by (bucket, piece), homes first. Every other row is compared with the homes;
    what is held is the homes of one piece and a bounded batch of links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, names, sets, ready = None, [], [], False
        found: list[tuple[int, int]] = []
        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in ("bucket", "piece", "home", "node")))
            for (bucket, piece, home, node), value in zip(keys, batch.column("shingles")):
                if (bucket, piece) != place:
                    place, names, sets, ready = (bucket, piece), [], [], False
                if home:
                    names.append(node)
                    sets.append(_shingles(value).copy())
                    continue
                if not names:
                    continue
                if not ready:
                    sizes, labels, ready = np.array([len(s) for s in sets]), np.arange(len(sets)), True
                    every, owner, own_names = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes), np.array(names)
                own = _shingles(value)
                at = np.minimum(np.searchsorted(own, every), len(own) - 1)
                shared = np.bincount(owner[own[at] == every], minlength=len(sizes))
                near = np.nonzero((shared >= similarity * (sizes + len(own) - shared) - 1e-9) & (own_names != node))[0]
                if not len(near):
                    continue
                found.append((names[near[0]], node))
                groups = np.unique(labels[near])
                if len(groups) > 1:
                    found.extend((names[groups[0]], names[g]) for g in groups[1:].tolist())
                    labels[np.isin(labels, groups[1:])] = groups[0]
                if len(found) >= EDGES_PER_BATCH:
                    yield _edges(found)
                    found = []
        if found:
            yield _edges(found)

    return run


def _edges(found: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*found)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _links(dealt: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    return (
        dealt.join(sets.select("node", "shingles"), "node")
        .select("bucket", "piece", "home", "node", "shingles")
        .repartition(shuffle_partitions(dealt), "bucket", "piece")
        .sortWithinPartitions("bucket", "piece", F.col("home").desc())
        .mapInArrow(_compare(similarity), "a long, b long")
    )


def _pieces(of: DataFrame) -> DataFrame:
    return of.filter("pieces > 1").select("bucket", F.col("pieces").cast("int").alias("pieces"))


def _dealt(rows: DataFrame, pieces: DataFrame, whole: str) -> DataFrame:
    """Rows of each bucket dealt over its pieces, those of the kind ``whole`` to all of them."""
    many = rows.join(pieces, "bucket", "left").withColumn("pieces", F.coalesce("pieces", F.lit(1)))
    own = F.array(F.pmod(F.xxhash64("node"), F.col("pieces").cast("long")).cast("int"))
    places = F.when(F.expr(whole), F.sequence(F.lit(0), F.col("pieces") - 1)).otherwise(own)
    return many.select(*rows.columns, F.explode(places).alias("piece"))


def _possible(pairs: DataFrame, sizes: DataFrame, similarity: float) -> DataFrame:
    """The pairs (bucket, node) whose sizes and parity bits do not rule out the similarity: two sets
    of n and m shingles may differ in (1 - s) / (1 + s) of n + m."""
    lead = sizes.select(F.col("node").alias("bucket"), F.col("n").alias("lead_n"), *[F.col(p).alias(f"lead_{p}") for p in _ODD])
    apart = sum((F.bit_count(F.col(p).bitwiseXOR(F.col(f"lead_{p}"))) for p in _ODD), F.lit(0))
    return (
        pairs.join(sizes, "node").join(lead, "bucket")
        .filter(F.least("n", "lead_n") >= similarity * F.greatest("n", "lead_n") - 1e-9)
        .filter(apart <= (1 - similarity) / (1 + similarity) * (F.col("n") + F.col("lead_n")) + 1e-6)
        .select("bucket", "node")
    )


def _soon_compared(live: DataFrame, sizes: DataFrame, similarity: float) -> DataFrame:
    """Nodes that the first two sets of their buckets may be similar to, and those two: what the
    first turns compare, so that one pass over the texts fetches it."""
    second = live.filter("node <> lead").select("token", "node")
    second = second.join(second.groupBy("token").agg(F.min("node").alias("lead")), "token")
    pairs = live.unionByName(second).filter("node <> lead").select(F.col("lead").alias("bucket"), "node").distinct()
    found = _possible(pairs, sizes, similarity)
    return found.select(F.explode(F.array("bucket", "node")).alias("node"))


def _with_first(live: DataFrame, sizes: DataFrame, similarity: float, once: bool) -> tuple[DataFrame, DataFrame]:
    """Rows of the leads compared with every other set they meet that lies in another component so
    far (or, with ``once``, each set with the smallest lead it meets), as far as they may be similar."""
    met = live.filter("node <> lead")
    if once:
        pairs = met.groupBy("node").agg(F.min("lead").alias("bucket")).select("bucket", "node")
    else:
        pairs = met.filter("label <> lead_label").select(F.col("lead").alias("bucket"), "node").distinct()
    pairs = materialise(_possible(pairs, sizes, similarity), "similar-pairs")
    pieces = pairs.groupBy("bucket").agg(F.ceil(F.count("*") / ROWS_PER_PIECE).alias("pieces"))
    homes = pieces.select("bucket", F.lit(True).alias("home"), F.col("bucket").alias("node"))
    rows = pairs.select("bucket", F.lit(False).alias("home"), "node").unionByName(homes)
    return _dealt(rows, _pieces(pieces), "home"), pairs


def _wide_sizes(sets: DataFrame) -> DataFrame:
    """node, n and ``WIDE`` longs of parity bits, from the shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [_shingles(v) for v in batch.column("shingles")]
            wide = [_parity(h, WIDE).tobytes() for h in held]
            columns = [batch.column("node"), pa.array(map(len, held), pa.int32()), pa.array(wide, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["node", "n", "wide"])

    return sets.select("node", "shingles").mapInArrow(run, "node long, n int, wide binary")


def _parity_rows(batch: pa.RecordBatch) -> np.ndarray:
    if "wide" in batch.schema.names:
        return np.frombuffer(b"".join(batch.column("wide").to_pylist()), dtype="<u8").reshape(batch.num_rows, WIDE)
    return np.stack([batch.column(p).to_numpy(zero_copy_only=False) for p in _ODD], axis=1).view(np.uint64)


def _may_link(similarity: float):
    """Rows without shingles, sorted by (bucket, piece), homes first. Returns the visitors whose size
    and parity bits do not rule out that they are similar to a home of another component."""
    differ = (1 - similarity) / (1 + similarity)

    def met(homes: list[np.ndarray], label: np.ndarray, n: np.ndarray, odd: np.ndarray) -> np.ndarray:
        own_label, own_n, own_odd = homes
        apart = sum(np.bitwise_count(odd[:, k, None] ^ own_odd[None, :, k]).astype(np.int16) for k in range(odd.shape[1]))
        n, own_n = n[:, None], own_n[None, :]
        near = (np.minimum(n, own_n) >= similarity * np.maximum(n, own_n) - 1e-9) & (apart <= differ * (n + own_n) + 1e-6)
        return (near & (label[:, None] != own_label[None, :])).any(axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, held, homes = None, [], None
        for batch in batches:
            bucket, piece, home, node, label, n = (
                batch.column(c).to_numpy(zero_copy_only=False) for c in ("bucket", "piece", "home", "node", "label", "n")
            )
            n, odd = n.astype(np.int64), _parity_rows(batch)
            new = (np.diff(bucket) != 0) | (np.diff(piece) != 0) | (np.diff(home.astype(np.int8)) != 0)
            edges = [0, *(np.nonzero(new)[0] + 1).tolist(), len(bucket)]
            stay = np.zeros(len(bucket), dtype=bool)
            for first, last in zip(edges, edges[1:]):
                if first == last:
                    continue
                if (here := (bucket[first], piece[first])) != place:
                    place, held, homes = here, [], None
                if home[first]:
                    held.append((label[first:last].copy(), n[first:last].copy(), odd[first:last].copy()))
                    continue
                if not held:
                    continue
                homes = homes or [np.concatenate(c) for c in zip(*held)]
                for at in range(first, last, VISITORS):
                    some = slice(at, min(at + VISITORS, last))
                    stay[some] = met(homes, label[some], n[some], odd[some])
            if stay.any():
                yield pa.RecordBatch.from_arrays([pa.array(bucket[stay]), pa.array(node[stay])], ["token", "node"])

    return run


def _still_open(live: DataFrame, sizes: DataFrame, similarity: float) -> DataFrame:
    """The sets (token, node) of each bucket that may be similar to a set of another component there."""
    rows = live.select(F.col("token").alias("bucket"), "node", "label").join(sizes, "node")
    pieces = live.groupBy(F.col("token").alias("bucket")).agg(F.ceil(F.count("*") / HOMES_PER_PIECE).alias("pieces"))
    both = rows.withColumn("home", F.explode(F.array(F.lit(True), F.lit(False))))
    dealt = _dealt(both, _pieces(pieces), "NOT home")
    return (
        dealt.select("bucket", "piece", "home", "node", "label", *[c for c in sizes.columns if c != "node"])
        .repartition(shuffle_partitions(dealt), "bucket", "piece")
        .sortWithinPartitions("bucket", "piece", F.col("home").desc())
        .mapInArrow(_may_link(similarity), "token long, node long")
        .distinct()
    )


def _with_all(live: DataFrame, sizes: DataFrame, sets: Sets, similarity: float) -> tuple[DataFrame, DataFrame]:
    """Rows of the buckets that are left, each set a home in one piece and a visitor in all.
    Buckets of the same sets are one."""
    first = materialise(_still_open(live, sizes, similarity), "similar-open")
    # The few bits that every set carries tell little of large sets; those that stay get more.
    wide = materialise(_wide_sizes(sets.of(first).join(first.select("node").distinct(), "node", "left_semi")), "similar-wide")
    again = first.join(live.select("token", "node", "label"), ["token", "node"])
    open_ = materialise(_still_open(again, wide, similarity), "similar-open")
    discard(first, wide)
    marks = open_.groupBy("token").agg(F.count("*").alias("rows"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("mark"))
    one = marks.groupBy("rows", "mark").agg(F.min("token").alias("token")).select("token")
    rows = materialise(
        open_.join(one, "token", "left_semi").select(F.col("token").alias("bucket"), "node").join(sizes.select("node", "n"), "node"),
        "similar-rest",
    )
    discard(open_)
    pieces = rows.groupBy("bucket").agg(F.ceil(F.sum(F.col("n").cast("long")) / SHINGLES_PER_PIECE).alias("pieces"))
    both = rows.select("bucket", "node", F.explode(F.array(F.lit(True), F.lit(False))).alias("home"))
    return _dealt(both, _pieces(pieces), "NOT home"), rows


def similar_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS_PER_SHINGLE,
    similarity: float = SIMILARITY, rounds: int = ROUNDS,
) -> DataFrame:
    """One row per document: doc_id, copy (SHA-256 of its text), label (of its group) and
    component_id, the smallest id reachable over links."""
    spark = docs.sparkSession
    texts = id_and_text(docs, id_col, text_col)
    counts = spark.sparkContext.broadcast(_counts(texts, words))
    whole = materialise(shingle_sets(texts, counts, similarity, words), "shingle-prefixes")
    every = materialise(whole.drop("prefix"), "shingle-sets")
    rows = whole.select(F.explode("prefix").alias("token"), "node")
    met = materialise(
        rows.groupBy("token").agg(F.min("node").alias("lead"), F.max("node").alias("top")).filter("lead <> top").select("token", "lead"),
        "similar-met",
    )
    live = materialise(rows.join(met, "token").distinct(), "similar-live")
    discard(whole, met)
    sizes = materialise(every.select("node", "n", *_ODD).dropDuplicates(["node"]), "similar-sizes")
    sets = Sets(texts, words)
    sets.of(_soon_compared(live, sizes, similarity))
    release_shuffles(spark)
    labels = spark.createDataFrame([], "node long, label long")
    for turn in range(rounds + 2):
        if live.isEmpty():
            break
        last = turn > rounds
        dealt, step = _with_all(live, sizes, sets, similarity) if last else _with_first(live, sizes, similarity, turn == 0)
        links = materialise(_links(dealt, sets.of(dealt), similarity), "similar-links")
        labels = component_labels(links.unionByName(labels.select(F.col("label").alias("a"), F.col("node").alias("b"))))
        discard(step, links)
        if not last:
            # After the first turn the leads stay: each was compared with some of its bucket only.
            rest = live if turn == 0 else live.filter("node <> lead")
            rest = rest.select("token", "node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
            open_ = rest.groupBy("token").agg(
                F.min(F.struct("node", "label")).alias("first"), F.min("label").alias("least"), F.max("label").alias("most")
            ).filter("least <> most").select("token", F.col("first.node").alias("lead"), F.col("first.label").alias("lead_label"))
            left = materialise(rest.select("token", "node", "label").join(open_, "token"), "similar-live")
            discard(live)
            live = left
        release_shuffles(spark)
    distinct = every.groupBy("node").agg(F.min("doc_id").alias("least"))
    labelled = distinct.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    names = labelled.groupBy("label").agg(F.min("least").alias("component_id"))
    classes = labelled.join(names, "label").select("node", "label", "component_id")
    return every.select("doc_id", "copy", "node").join(classes, "node").select("doc_id", "copy", "label", "component_id")
