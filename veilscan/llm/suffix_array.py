"""Repeated byte strings by distributed prefix doubling.

A byte of a document is removed if it lies in a string of ``length`` (50) bytes that also
starts in a document with a smaller id. Prefix doubling ranks positions by what follows them,
sorts pairs of ranks at growing offsets and ranks anew, until a rank is unique or the length is
reached. Positions whose rank is unique can be dropped at once, and that is done before most of
them ever become rows:

1. *Ranks of sampled positions.* A window is the string of 50 bytes at a position. Its anchor is
   the smallest hash among its 20-byte strings: equal windows have equal anchors. Neighbouring
   windows share theirs, so a document becomes runs of windows, about one per 16 bytes. Spark
   sorts the pairs (rank of the anchor, rank of all the run covers). A run whose anchor is found
   nowhere else is unique and dropped; one whose whole stretch is found in a smaller document is
   removed; what remains are runs whose anchor has several surroundings.
2. *Pairs at offset 25.* The remaining runs, with their bytes, are sorted by anchor. Every
   position in them gets the pair (rank of its first 25 bytes, rank of the 25 bytes after them);
   the pairs of one anchor are sorted where they lie, and a position whose pair first occurs in a
   smaller document is removed. 50 bytes are the threshold, so this is the last round.
3. *Large anchors.* The positions of an anchor with more than ``GROUP_RUNS`` surroundings or
   ``PAIR_BYTES`` of them do not stay in one task: they become rows of their own and Spark sorts their pairs.

Ranks are 64-bit hashes rather than places in the sorted order, which saves a second shuffle per
round; positions are only ever taken as equal if a pair of them is (in the first round the pair is
the anchor and the whole stretch, so bytes outside the anchor stand on one 64-bit hash). Rows that a task can already
decide (a smaller document in its own batch has the same pair) are decided there, so a passage
that a third of all documents share reaches the sort as a few rows per task.

Documents travel by id and a checksum of their text. Sorted rows are read as streams, and no more
of a group is held than ``GROUP_RUNS`` and ``PAIR_BYTES`` allow. Each round is written to the shared folder.

Defined cases: null and empty texts have no bytes; a text shorter than ``length`` keeps all; a
null id is larger than any other; documents with one id neither remove each other's bytes nor
lose their own rows, and repeated rows are repeated in the result; an empty table gives an empty
table; further columns play no part. Texts are bytes: what is kept need not be valid UTF-8.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from veilscan.llm.files import release_shuffles
from veilscan.llm.inputs import id_and_text, shuffle_partitions, utf8
from veilscan.session import materialise

LENGTH = 50
ANCHOR = 20
NO_ID = (1 << 63) - 1
# Windows per piece of a very long text, and bytes per slice of a batch.
PIECE = 1 << 20
SLICE_BYTES = 16 << 20
GROUP_RUNS = 50_000
# Bytes of runs whose pairs are sorted together, and windows per row of an open run.
PAIR_BYTES = 4 << 20
RUN_WINDOWS = 1 << 16
PLACE_BITS = 31

_letters = np.random.default_rng(20240101).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15


def _powers_of(base: int, count: int) -> np.ndarray:
    factors = np.full(count, base, dtype=np.uint64)
    factors[0] = 1
    return np.cumprod(factors)


class Ranks:
    """64-bit hashes of substrings of one text, from prefix sums."""

    _powers: np.ndarray = np.ones(1, dtype=np.uint64)
    _inverse: np.ndarray = np.ones(1, dtype=np.uint64)

    def __init__(self, raw: np.ndarray) -> None:
        n = len(raw)
        if len(self._powers) <= n:
            Ranks._powers, Ranks._inverse = (_powers_of(b, 2 * n + 1) for b in (_BASE, pow(_BASE, -1, 1 << 64)))
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_letters[raw] * self._powers[:n], out=self.sums[1:])

    def every(self, length: int) -> np.ndarray:
        """Of the strings of one length at all positions."""
        sums = self.sums[length:] - self.sums[: len(self.sums) - length]
        return _mixed(sums * self._inverse[: len(sums)])

    def between(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[ends] - self.sums[starts]) * self._inverse[starts])


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def _smallest(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours."""
    out, have = values, 1
    while 2 * have <= width:
        out, have = np.minimum(out[:-have], out[have:]), 2 * have
    rest = width - have
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def runs_of(raw: np.ndarray, length: int, anchor: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(anchor rank, rank of the stretch, first window, windows) of the runs of a text."""
    for at in range(0, max(0, len(raw) - length + 1), PIECE):
        piece = raw[at : at + PIECE + length - 1]
        ranks = Ranks(piece)
        least = _smallest(ranks.every(anchor), length - anchor + 1)
        starts = np.concatenate(([0], np.nonzero(least[1:] != least[:-1])[0] + 1))
        ends = np.concatenate((starts[1:], [len(least)]))
        yield least[starts], ranks.between(starts, ends + length - 1), starts + at, ends - starts


def _place(text: bytes) -> int:
    return zlib.crc32(text) << PLACE_BITS


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    offsets = np.frombuffer(batch.column("text").buffers()[1], dtype=np.int32)[batch.column("text").offset :]
    cuts, start = [0], 0
    for k in range(1, batch.num_rows + 1):
        if offsets[k] - offsets[start] >= SLICE_BYTES or k == batch.num_rows:
            cuts.append(k)
            start = k
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)


_SORTED = "k1 long, k2 long, doc long, place long, n int"


def _decided_here(k1, k2, doc, place, n) -> pa.RecordBatch:
    """Rows for the sort. Of equal pairs only the rows of the smallest document go on; the
    others are covered, and marked so by a negative number of windows."""
    order = np.lexsort((doc, k2, k1))
    k1, k2, doc, place, n = (x[order] for x in (k1, k2, doc, place, n))
    new = np.ones(len(k1), dtype=bool)
    new[1:] = (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])
    least = doc[np.nonzero(new)[0]][np.cumsum(new) - 1]
    covered = doc > least
    # Covered runs that follow each other in a document become one row.
    c_doc, c_place, c_n = doc[covered], place[covered], n[covered]
    order = np.lexsort((c_place, c_doc))
    c_doc, c_place, c_n = c_doc[order], c_place[order], c_n[order]
    first = np.ones(len(c_doc), dtype=bool)
    first[1:] = (c_doc[1:] != c_doc[:-1]) | (c_place[1:] != c_place[:-1] + c_n[:-1])
    heads = np.nonzero(first)[0]
    total = np.add.reduceat(c_n, heads) if len(heads) else c_n
    keep = ~covered
    columns = (
        np.concatenate((k1[keep].view(np.int64), c_place[heads])),
        np.concatenate((k2[keep].view(np.int64), np.zeros(len(heads), dtype=np.int64))),
        np.concatenate((doc[keep], c_doc[heads])),
        np.concatenate((place[keep], c_place[heads])),
        np.concatenate((n[keep], -total)).astype(np.int32),
    )
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["k1", "k2", "doc", "place", "n"])


def _anchored(length: int, anchor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _slices(whole):
                parts = []
                for doc, text in zip(batch.column("doc").to_pylist(), batch.column("text")):
                    text = text.as_py()
                    place = _place(text)
                    for k1, k2, start, n in runs_of(np.frombuffer(text, dtype=np.uint8), length, anchor):
                        parts.append((k1, k2, np.full(len(k1), doc, dtype=np.int64), start + place, n))
                if parts:
                    yield _decided_here(*(np.concatenate(c) for c in zip(*parts)))

    return run


_FOUND = "rank long, doc long, place long, n int, open boolean"
_FOUND_COLUMNS = ["rank", "doc", "place", "n", "open"]


def _found(rank, doc, place, n, open_) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (rank, doc, place, n, open_)], _FOUND_COLUMNS)


def _settled(doc, place, n) -> pa.RecordBatch:
    """Covered runs."""
    return _found(np.zeros(len(doc), dtype=np.int64), doc, place, n.astype(np.int32), np.zeros(len(doc), dtype=bool))


def _first_round(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads rows sorted by (k1, k2, doc): covered runs, and open ones, whose anchor has several
    surroundings. The first row of a pair is open if the row before or the row after the pair
    has the same anchor; rows after it that belong to the same document share its fate."""
    held: tuple[np.ndarray, ...] | None = None  # rows of the last pair, not yet decided
    before: int | None = None  # the anchor of the pair before that

    def decided(rows: tuple[np.ndarray, ...], last_known: bool) -> tuple[pa.RecordBatch, int | None, int]:
        k1, k2, doc, place, n = rows
        new = np.ones(len(k1), dtype=bool)
        new[1:] = (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])
        heads = np.nonzero(new)[0]
        h1 = k1[heads]
        several = np.zeros(len(heads), dtype=bool)
        same = h1[1:] == h1[:-1]
        several[1:] |= same
        several[:-1] |= same
        if before is not None and len(heads):
            several[0] |= h1[0] == before
        until = len(k1) if last_known else int(heads[-1])
        group = np.cumsum(new) - 1
        covered = doc > doc[heads][group]
        chosen = np.nonzero((covered | several[group])[:until])[0]
        out = _found(k1[chosen], doc[chosen], place[chosen], n[chosen], ~covered[chosen])
        previous = int(h1[-2]) if len(h1) > 1 else before
        return out, previous, until

    for batch in batches:
        rows = tuple(batch.column(c).to_numpy() for c in ("k1", "k2", "doc", "place", "n"))
        ready = rows[4] < 0
        if ready.any():
            yield _settled(rows[2][ready], rows[3][ready], -rows[4][ready])
            rows = tuple(x[~ready] for x in rows)
        if not len(rows[0]):
            continue
        if held is not None:
            rows = tuple(np.concatenate(pair) for pair in zip(held, rows))
        out, before, until = decided(rows, False)
        held = tuple(x[until:] for x in rows)
        if len(held[0]) > (1 << 16):
            # A pair that many batches share: only its smallest document matters from here on.
            least = held[2][0]
            sure = held[2] > least
            yield _settled(held[2][sure], held[3][sure], held[4][sure])
            held = tuple(x[~sure] for x in held)
        if out.num_rows:
            yield out
    if held is not None:
        out, _, _ = decided(held, True)
        if out.num_rows:
            yield out


_RUNS = "k1 long, doc long, place long, n int, bytes binary"


def _opened(length: int):
    """The open runs of documents, with their bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _slices(whole):
                out: list[tuple] = []
                for doc, text, spans in zip(batch.column("doc").to_pylist(), batch.column("text"), batch.column("spans")):
                    raw = text.as_py()
                    for span in spans.as_py():
                        start = span["place"] & ((1 << PLACE_BITS) - 1)
                        for at in range(0, span["n"], RUN_WINDOWS):
                            n = min(RUN_WINDOWS, span["n"] - at)
                            out.append((span["rank"], doc, span["place"] + at, n, raw[start + at : start + at + n + length - 1]))
                if out:
                    types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
                    columns = [pa.array(c, t) for c, t in zip(zip(*out), types)]
                    yield pa.RecordBatch.from_arrays(columns, ["k1", "doc", "place", "n", "bytes"])

    return run


def _pairs(doc: np.ndarray, place: np.ndarray, n: np.ndarray, texts: list[bytes], length: int) -> pa.RecordBatch:
    """Every position of the runs with its pair; what these rows decide is marked."""
    half = length // 2
    ends = np.cumsum(n + length - 1)
    first = np.concatenate(([0], ends[:-1]))
    within = np.arange(int(n.sum())) - np.repeat(np.concatenate(([0], np.cumsum(n)[:-1])), n)
    at = np.repeat(first, n) + within
    ranks = Ranks(np.frombuffer(b"".join(texts), dtype=np.uint8))
    return _decided_here(
        ranks.between(at, at + half), ranks.between(at + half, at + length),
        np.repeat(doc, n), np.repeat(place, n) + within, np.ones(len(at), dtype=np.int64),
    )


def _second_round(length: int, group_runs: int):
    """Reads runs sorted by anchor. Covered positions have negative n; positions of anchors with
    too many runs go on as rows with their pairs."""

    def settled(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        """Whole groups, some at a time."""
        start, size = 0, 0
        for k, row in enumerate(rows):
            if size >= PAIR_BYTES and row[0] != rows[k - 1][0]:
                yield covered(rows[start:k])
                start, size = k, 0
            size += len(row[4])
        yield covered(rows[start:])

    def arrays(rows: list[tuple]) -> tuple:
        _, doc, place, n, texts = zip(*rows)
        return np.array(doc, dtype=np.int64), np.array(place, dtype=np.int64), np.array(n, dtype=np.int64), list(texts), length

    def covered(rows: list[tuple]) -> pa.RecordBatch:
        out = _pairs(*arrays(rows))
        return out.filter(pc.less(out.column("n"), 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # complete groups, then the last one so far
        last = 0  # where the last group starts
        size = 0  # bytes of the last group, or of what is held of a large one
        large: int | None = None  # the anchor whose positions are going on
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("k1", "doc", "place", "n", "bytes"))):
                if large is not None and row[0] != large:
                    if held:
                        yield _pairs(*arrays(held))
                    held, last, size, large = [], 0, 0, None
                elif held and row[0] != held[-1][0]:
                    last, size = len(held), 0
                held.append(row)
                size += len(row[4])
                if large is None and (len(held) - last > group_runs or size > PAIR_BYTES):
                    large = row[0]
                    if last:
                        yield from settled(held[:last])
                        held, last = held[last:], 0
                if large is not None and (len(held) > 10_000 or size > PAIR_BYTES):
                    yield _pairs(*arrays(held))
                    held, last, size = [], 0, 0
            if large is None and last:
                yield from settled(held[:last])
                held, last = held[last:], 0
        if held:
            if large is not None:
                yield _pairs(*arrays(held))
            else:
                yield from settled(held)

    return run


def _last_round(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads rows sorted by (k1, k2, doc); a position is covered if its pair began with a
    smaller document."""
    last: tuple[int, int, int] | None = None
    for batch in batches:
        k1, k2, doc, place, n = (batch.column(c).to_numpy() for c in ("k1", "k2", "doc", "place", "n"))
        ready = n < 0
        sums = [(doc[ready], place[ready], -n[ready])]
        k1, k2, doc, place = (x[~ready] for x in (k1, k2, doc, place))
        if len(k1):
            new = np.ones(len(k1), dtype=bool)
            new[1:] = (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])
            heads = np.nonzero(new)[0]
            least = doc[heads]
            if last is not None and (int(k1[0]), int(k2[0])) == last[:2]:
                least[0] = last[2]
            group = np.cumsum(new) - 1
            covered = doc > least[group]
            sums.append((doc[covered], place[covered], np.ones(int(covered.sum()), dtype=np.int32)))
            last = (int(k1[-1]), int(k2[-1]), int(least[-1]))
        docs, places, counts = (np.concatenate(c) for c in zip(*sums))
        yield _settled(docs, places, counts)


def _sorted_pairs(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.repartition(shuffle_partitions(rows), *keys).sortWithinPartitions("k1", "k2", "doc")


def _by_document(found: DataFrame, *columns: str) -> DataFrame:
    return found.groupBy("doc", F.shiftright("place", PLACE_BITS).alias("check")).agg(
        F.collect_list(F.struct("place", "n", *columns)).alias("spans")
    )


def covered_windows(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, anchor: int = ANCHOR,
    group_runs: int = GROUP_RUNS,
) -> tuple[DataFrame, DataFrame]:
    """The documents as (doc, doc_id, check, text bytes), and by (doc, check) the runs of
    windows, in ``spans`` (place, n), that also occur in a smaller document."""
    spark, parts = docs.sparkSession, shuffle_partitions(docs)
    rows = id_and_text(docs, id_col, text_col).select(
        F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"), "doc_id", F.crc32(utf8(F.col("text"))).alias("check"),
        utf8(F.col("text")).alias("text"),
    )
    anchored = rows.select("doc", "text").mapInArrow(_anchored(length, anchor), _SORTED)
    first = materialise(_sorted_pairs(anchored, "k1").mapInArrow(_first_round, _FOUND), "repeats-first")
    release_shuffles(spark)
    opened = (
        rows.select("doc", "check", "text").join(_by_document(first.filter("open"), "rank"), ["doc", "check"])
        .select("doc", "text", "spans").mapInArrow(_opened(length), _RUNS)
    )
    second = materialise(
        opened.repartition(parts, "k1").sortWithinPartitions("k1").mapInArrow(_second_round(length, group_runs), _SORTED),
        "repeats-second",
    )
    release_shuffles(spark)
    third = _sorted_pairs(second.filter("n > 0"), "k1", "k2").mapInArrow(_last_round, _FOUND)
    covered = (
        first.filter("NOT open").select("doc", "place", "n")
        .unionByName(second.filter("n < 0").select("doc", "place", (-F.col("n")).alias("n")))
        .unionByName(third.select("doc", "place", "n"))
    )
    return rows, _by_document(covered)


_RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"


def _cut(text: bytes, spans, length: int) -> tuple[int, int, bytes]:
    """(bytes removed, maximal runs, what is left) for covered windows in any order."""
    if spans is None:
        return 0, 0, text
    starts = np.asarray(spans.field("place")) & ((1 << PLACE_BITS) - 1)
    ends = starts + np.asarray(spans.field("n")) + length - 1
    edges = np.zeros(len(text) + 1, dtype=np.int32)
    np.add.at(edges, starts, 1)
    np.add.at(edges, ends, -1)
    removed = np.cumsum(edges[:-1]) > 0
    runs = int(removed[0]) + int((removed[1:] & ~removed[:-1]).sum())
    return int(removed.sum()), runs, np.frombuffer(text, dtype=np.uint8)[~removed].tobytes()


def _finish(length: int, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _slices(whole):
                spans, sizes, rows = batch.column("spans"), [], []
                for k, text in enumerate(batch.column("text")):
                    raw = text.as_py()
                    sizes.append(len(raw))
                    rows.append(_cut(raw, spans[k].values if spans[k].is_valid else None, length))
                kept = [hashlib.sha256(r[2]).digest() if digest else r[2] for r in rows]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array([r[0] for r in rows], pa.int64()),
                        pa.array([r[1] for r in rows], pa.int64()), pa.array(kept, pa.binary()),
                    ],
                    ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
                )

    return run


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, anchor: int = ANCHOR,
    digest: bool = False, group_runs: int = GROUP_RUNS,
) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and kept,
    the remaining bytes (or their SHA-256)."""
    rows, spans = covered_windows(docs, id_col, text_col, length, anchor, group_runs)
    return rows.join(spans, ["doc", "check"], "left").select("doc_id", "text", "spans").mapInArrow(
        _finish(length, digest), _RESULT
    )
