"""Alignment of two tokenizers' tokens over the same bytes, as a monoid of fragments.

Both tokenizers encode a text; byte offsets where a token of each ends cut the two sequences into
groups, and tokens whose byte ranges overlap are linked. What a byte range of a text contributes is
a *fragment*: an open prefix (tokens up to the first common end, whose group may have begun
before), closed groups, and an open suffix (tokens after the last common end). Fragments compose
associatively: the suffix of one and the prefix of the next are cut at the common ends they have
together.

* A text of at most ``CHUNK_BYTES`` is one byte range, closed on both sides.
* Longer ones are cut into ranges of that size, mapped by separate tasks and composed in a tree of
  two levels (``GROUP`` neighbours, then the rest). A range is encoded with its surroundings up to
  the next places where both tokenizers are sure to begin a token, a space after a visible ASCII
  character, and keeps the tokens that end in it. A range without such a place is joined with the
  one before.

Within a range all is arithmetic on arrays of byte ends: common ends are their intersection, links
the stretches between any two neighbouring ends.

How often a pair of ids is linked in the corpus is a sum over all documents. The table of pairs goes
back to the documents in blocks of at most ``BLOCK_PAIRS`` pairs, broadcast one after the other, so
neither a common pair nor a large table is a burden; per document only its own pairs are held.

Defined cases: null and empty texts, and those whose tokens do not spell a space and the text (as
where U+2581 stands in them), have no tokens: all counts are zero and the groups are empty; null
ids and repeated rows are aligned each; an empty table gives an empty table; further columns play
no part.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, functions as F

from veilscan.llm.bpe import byte_letters
from veilscan.llm.inputs import id_and_text, shuffle_partitions
from veilscan.llm.token_files import _UNSURE, Encoder
from veilscan.session import discard, materialise

CHUNK_BYTES = 1 << 16
GROUP = 128
# The word pattern of byte-level files.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Words and pieces of the first tokenizer kept per Python worker (then the memory starts anew).
REMEMBERED = 300_000
BLOCK_PAIRS = 1 << 22
PAIRS_PER_SUM = 1 << 21
B_BITS = 32
B_MASK = (1 << B_BITS) - 1

_SAFE = re.compile(rb"(?<=[!-~]) ")
_NONE = np.zeros((0, 2), dtype=np.int64)
_NO_LINKS = np.zeros(0, dtype=np.int64)


class Table:
    """Decimal ids of both tokenizers with what follows them in a written group."""

    def __init__(self, size_a: int, size_b: int) -> None:
        self.first_b = 2 * size_a
        self.texts = [f"{n}{mark}" for n in range(size_a) for mark in ",|"] + [f"{n}{mark}" for n in range(size_b) for mark in ",;"]


def common_ends(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.intersect1d(a[:, 1], b[:, 1], assume_unique=True)


def groups_of(a: np.ndarray, b: np.ndarray, table: Table) -> tuple[str, np.ndarray]:
    """Groups between common ends (each closed by a semicolon) and the keys of linked pairs, for
    rows of (id, end) that begin and end together."""
    if not len(a):
        return "", _NO_LINKS
    (ids_a, ends_a), (ids_b, ends_b) = a.T, b.T
    beside = np.searchsorted(ends_b, ends_a)
    last_a = ends_b[beside] == ends_a
    last_b = np.zeros(len(b), dtype=bool)
    last_b[beside[last_a]] = True
    # Where each token is written: all of a group from the first side, then those from the second.
    group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
    after_a, after_b = np.nonzero(last_a)[0] + 1, np.concatenate(([0], np.nonzero(last_b)[0] + 1))
    names = np.empty(len(a) + len(b), dtype=np.int64)
    names[np.arange(len(a)) + after_b[group_a]] = 2 * ids_a + last_a
    names[np.arange(len(b)) + after_a[group_b]] = table.first_b + 2 * ids_b + last_b
    # A stretch between neighbouring ends is a link; it ends with a token of the first side or, else, of the second.
    other = ~last_b
    links = np.concatenate((ids_a << B_BITS | ids_b[beside], ids_a[np.searchsorted(ends_a, ends_b[other])] << B_BITS | ids_b[other]))
    return "".join(map(table.texts.__getitem__, names.tolist())), links


def _split(tokens: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    at = int(np.searchsorted(tokens[:, 1], end, side="right"))
    return tokens[:at], tokens[at:]


def _joined(x: tuple, y: tuple) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate((x[0], y[0])), np.concatenate((x[1], y[1]))


@dataclass
class Fragment:
    """What a byte range contributes. Without a common end all tokens are in ``head``."""

    closes: bool = False
    head: tuple[np.ndarray, np.ndarray] = (_NONE, _NONE)
    groups: str = ""
    links: np.ndarray = field(default_factory=lambda: _NO_LINKS)
    tail: tuple[np.ndarray, np.ndarray] = (_NONE, _NONE)
    n_a: int = 0
    n_b: int = 0
    bad: bool = False

    @classmethod
    def of(cls, a: np.ndarray, b: np.ndarray, table: Table) -> Fragment:
        made = cls(n_a=len(a), n_b=len(b), head=(a, b))
        ends = common_ends(a, b)
        if len(ends):
            made.closes = True
            (head_a, a), (head_b, b) = _split(a, ends[0]), _split(b, ends[0])
            (a, tail_a), (b, tail_b) = _split(a, ends[-1]), _split(b, ends[-1])
            made.head, made.tail = (head_a, head_b), (tail_a, tail_b)
            made.groups, made.links = groups_of(a, b, table)
        return made

    def then(self, other: Fragment, table: Table) -> Fragment:
        """This range and the one after it."""
        middle = Fragment.of(*_joined(self.tail if self.closes else self.head, other.head), table)
        made = Fragment(self.closes or middle.closes, n_a=self.n_a + other.n_a, n_b=self.n_b + other.n_b, bad=self.bad or other.bad)
        groups, links = [middle.groups], [middle.links]
        if self.closes:
            made.head = self.head
            if middle.closes:
                between = groups_of(*middle.head, table)
                groups.insert(0, between[0])
                links.insert(0, between[1])
            groups.insert(0, self.groups)
            links.insert(0, self.links)
        else:
            made.head = middle.head
        if other.closes:
            made.tail = other.tail
            groups.append(other.groups)
            links.append(other.links)
        elif middle.closes:
            made.tail = middle.tail
        elif self.closes:
            made.tail = middle.head
        made.groups, made.links = "".join(groups), np.concatenate(links)
        return made

    def finished(self, table: Table) -> tuple[str, np.ndarray]:
        """Groups and links of a whole text."""
        groups, links = groups_of(*self.head, table)
        return (groups + self.groups)[:-1], np.concatenate((links, self.links))


def ranked(path: str) -> tiktoken.Encoding | None:
    """The vocabulary of a byte-level file as ranks, which the faster library reads, if its merges
    are in the order of their ids; texts in which the two libraries' ideas of letters may differ
    are not given to it."""
    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    of_letter = {letter: b for b, letter in enumerate(byte_letters())}
    pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    made = [model["vocab"][a + b] for a, b in pairs]
    if made != sorted(made) or any(len(t) > 1 for t in model["vocab"].keys() - {a + b for a, b in pairs} if set(t) <= of_letter.keys()):
        return None
    tokens = {t: n for t, n in model["vocab"].items() if len(t) == 1 or n >= made[0]}
    ranks = {bytes(of_letter[c] for c in t): n for t, n in tokens.items() if set(t) <= of_letter.keys()}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class Aligner:
    """Two tokenizers, a byte-level one of the ``tokenizers`` library and a ``sentencepiece`` model."""

    _loaded: dict[tuple[str, str], Aligner] = {}

    def __init__(self, path_a: str, path_b: str) -> None:
        import sentencepiece

        self.first = Encoder(path_a, "<u4")
        self.first.tokenizer.encode_special_tokens = True  # their strings in a text are plain text
        self.ranked = ranked(path_a)
        self.second = sentencepiece.SentencePieceProcessor(model_file=path_b)
        of_letter = {letter: b for b, letter in enumerate(byte_letters())}
        vocabulary = self.first.tokenizer.get_vocab()
        self.bytes_a = [b""] * (1 + max(vocabulary.values()))
        for token, n in vocabulary.items():
            self.bytes_a[n] = bytes(of_letter[c] for c in token) if all(c in of_letter for c in token) else token.encode()
        self.bytes_b = [self._piece(n) for n in range(self.second.get_piece_size())]
        self.sizes_a, self.sizes_b = (np.array([*map(len, x)], dtype=np.int64) for x in (self.bytes_a, self.bytes_b))
        self.space_b = self.second.piece_to_id("▁")
        self.table = Table(len(self.bytes_a), len(self.bytes_b))

    def _piece(self, n: int) -> bytes:
        piece = self.second.id_to_piece(n)
        return bytes((int(piece[3:-1], 16),)) if self.second.is_byte(n) else piece.replace("▁", " ").encode()

    @classmethod
    def at(cls, path_a: str, path_b: str) -> Aligner:
        if (path_a, path_b) not in cls._loaded:
            cls._loaded[path_a, path_b] = cls(path_a, path_b)
        return cls._loaded[path_a, path_b]

    def first_ids(self, text: str) -> np.ndarray:
        if self.ranked and not _UNSURE.search(text):
            return np.array(self.ranked.encode_ordinary(" " + text), dtype=np.int64)
        memory, words = self.first.memory, self.first.words
        if len(memory) + len(words) > REMEMBERED:
            memory.clear()
            words.clear()
        start, *others = self.first.pieces(text)
        return np.frombuffer(self.first.piece(" " + start) + b"".join(map(memory.__getitem__, others)), dtype="<u4").astype(np.int64)

    def tokens(self, text: str, at: int = 0) -> tuple[np.ndarray, np.ndarray] | None:
        """Rows of (id, end) of a space and the text, from byte ``at`` on; None if the tokens of
        one do not spell them."""
        a = self.first_ids(text)
        b = np.array(self.second.encode(text) if text else [self.space_b], dtype=np.int64)
        raw, out = (" " + text).encode("utf-8", "surrogatepass"), []
        for ids, spelled, sizes in ((a, self.bytes_a, self.sizes_a), (b, self.bytes_b, self.sizes_b)):
            if b"".join(map(spelled.__getitem__, ids.tolist())) != raw:
                return None
            out.append(np.stack((ids, at + np.cumsum(sizes[ids])), axis=1))
        return out[0], out[1]

    def whole(self, text: str) -> tuple[str, np.ndarray, int, int]:
        """A whole text: its groups, keys of links, and counts of tokens."""
        both = self.tokens(text) if text else None
        if both is None:
            return "", _NO_LINKS, 0, 0
        groups, links = groups_of(*both, self.table)
        return groups[:-1], links, len(both[0]), len(both[1])

    def ranged(self, stretch: str, at: int, low: int, high: int) -> Fragment:
        """The fragment of bytes (low, high] out of a stretch of text that begins at byte ``at``
        with a space."""
        both = self.tokens(stretch[1:], at)
        if both is None:
            return Fragment(bad=True)
        return Fragment.of(*(t[(t[:, 1] > low) & (t[:, 1] <= high)] for t in both), self.table)


def ranges_of(text: str, chunk_bytes: int) -> Iterator[tuple[int, int, int, str]]:
    """(low, high, start, stretch) of each byte range of a space and the text."""
    raw = (" " + text).encode("utf-8", "surrogatepass")
    low, start = 0, 0
    for place in [*range(chunk_bytes, len(raw), chunk_bytes), len(raw)]:
        if place == len(raw):
            yield low, place, start, raw[start:].decode("utf-8", "surrogatepass")
            return
        before = raw.rfind(b" ", low + 1, place + 1)
        while before > low and not _SAFE.match(raw, before):
            before = raw.rfind(b" ", low + 1, before)
        if before <= low:
            continue
        after = _SAFE.search(raw, place)
        end = after.start() if after else len(raw)
        yield low, place, start, raw[start:end].decode("utf-8", "surrogatepass")
        low, start = place, before


_ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<long>, times array<int>"
_RANGES = "item long, doc_id long, at long, low long, high long, start long, stretch string"
_FRAGMENTS = (
    "item long, doc_id long, at long, bad boolean, closes boolean, head_a array<long>, head_b array<long>, groups string, "
    "links array<long>, tail_a array<long>, tail_b array<long>, n_a long, n_b long"
)


def _row(item: int, doc_id, at: int, f: Fragment) -> tuple:
    return (item, doc_id, at, f.bad, f.closes, *(t.ravel() for t in f.head), f.groups, f.links, *(t.ravel() for t in f.tail), f.n_a, f.n_b)


def _fragment(r) -> Fragment:
    head_a, head_b, tail_a, tail_b = (np.asarray(t, dtype=np.int64).reshape(-1, 2) for t in (r.head_a, r.head_b, r.tail_a, r.tail_b))
    return Fragment(bool(r.closes), (head_a, head_b), r.groups, np.asarray(r.links, dtype=np.int64), (tail_a, tail_b), int(r.n_a), int(r.n_b), bool(r.bad))


def _frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=[c.split(" ")[0] for c in schema.split(", ")])
    return out.assign(doc_id=pd.array([None if pd.isna(i) else int(i) for i in out["doc_id"]], dtype="Int64"))


def _aligned_row(doc_id, groups: str, links: np.ndarray, n_a: int, n_b: int, digest: bool) -> tuple:
    if not n_a:
        return doc_id, 0, 0, 0, 0, "", [], []
    pairs, times = np.unique(links, return_counts=True)
    shown = hashlib.sha256(groups.encode()).hexdigest() if digest else groups
    return doc_id, n_a, n_b, groups.count(";") + 1, len(links), shown, pairs, times


def align_tokens(
    docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text",
    digest: bool = False, chunk_bytes: int = CHUNK_BYTES,
) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, groups (``a1,a2|b1;a3|b2,b3`` in
    decimal ids, or with ``digest`` their SHA-256), and its linked pairs (a id above 32 bits of
    the b id) with the times each is linked."""
    texts = id_and_text(docs, id_col, text_col)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner.at(path_a, path_b)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = []
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text")):
                    rows.append(_aligned_row(doc_id, *aligner.whole(text.as_py()), digest))
                yield _aligned_batch(rows)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                for at, (low, high, start, stretch) in enumerate(ranges_of(r.text, chunk_bytes)):
                    yield _frame([(r.item, r.doc_id, at, low, high, start, stretch)], _RANGES)

    def mapped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        aligner = Aligner.at(path_a, path_b)
        for batch in batches:
            for r in batch.itertuples():
                yield _frame([_row(r.item, r.doc_id, r.at, aligner.ranged(r.stretch, r.start, r.low, r.high))], _FRAGMENTS)

    def composed(group: pd.DataFrame) -> pd.DataFrame:
        table = Aligner.at(path_a, path_b).table
        rows = [*group.sort_values("at").itertuples()]
        level = [_fragment(r) for r in rows]
        while len(level) > 1:  # a tree, so nothing is copied more often than its depth
            level = [x.then(y, table) if y else x for x, y in zip(level[::2], [*level[1::2], None])]
        return _frame([_row(rows[0].item, rows[0].doc_id, int(rows[0].at) // GROUP, level[0])], _FRAGMENTS)

    def ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Aligner.at(path_a, path_b).table
        for batch in batches:
            for r in batch.to_pandas().itertuples():
                doc_id, f = None if pd.isna(r.doc_id) else int(r.doc_id), _fragment(r)
                groups, links = ("", _NO_LINKS) if f.bad else f.finished(table)
                yield _aligned_batch([_aligned_row(doc_id, groups, links, 0 if f.bad else f.n_a, f.n_b, digest)])

    long = F.octet_length("text") > chunk_bytes
    ranges = (
        texts.filter(long).withColumn("item", F.monotonically_increasing_id()).mapInPandas(cut, _RANGES)
        .repartition(shuffle_partitions(docs), "item", "at")
    )
    first = ranges.mapInPandas(mapped, _FRAGMENTS).withColumn("part", F.floor(F.col("at") / GROUP))
    second = first.groupBy("item", "part").applyInPandas(composed, _FRAGMENTS)
    wholes = second.groupBy("item").applyInPandas(composed, _FRAGMENTS)
    return texts.filter(~long).mapInArrow(whole, _ALIGNED).unionByName(wholes.mapInArrow(ended, _ALIGNED))


def _aligned_batch(rows: list[tuple]) -> pa.RecordBatch:
    ids, n_a, n_b, n_groups, n_links, groups, pairs, times = zip(*rows)
    ends = pa.array(np.cumsum([0, *map(len, pairs)]), pa.int32())
    flat = lambda parts, dtype: np.concatenate([np.zeros(0, dtype=dtype), *parts]).astype(dtype)
    columns = [pa.array(c, pa.int64()) for c in (ids, n_a, n_b, n_groups, n_links)]
    columns += [pa.array(groups, pa.string()), pa.ListArray.from_arrays(ends, pa.array(flat(pairs, np.int64)))]
    columns += [pa.ListArray.from_arrays(ends, pa.array(flat(times, np.int32)))]
    return pa.RecordBatch.from_arrays(columns, [c.split(" ")[0] for c in _ALIGNED.split(", ")])


def pair_counts(aligned: DataFrame) -> DataFrame:
    """pair, n (links of the corpus that hold it) and best (n is the highest of its b id)."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, times, held = [], [], 0
        for batch in batches:
            pairs.append(batch.column("pairs").flatten().to_numpy())
            times.append(batch.column("times").flatten().to_numpy())
            held += len(pairs[-1])
            if held >= PAIRS_PER_SUM:
                yield _summed(pairs, times)
                pairs, times, held = [], [], 0
        if held:
            yield _summed(pairs, times)

    counts = materialise(
        aligned.select("pairs", "times").mapInArrow(summed, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")), "token-pairs"
    )
    of_b = F.col("pair").bitwiseAND(F.lit(B_MASK)).alias("b")
    most = counts.groupBy(of_b).agg(F.max("n").alias("most"))
    return counts.withColumn("b", of_b).join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def _summed(pairs: list[np.ndarray], times: list[np.ndarray]) -> pa.RecordBatch:
    keys, place = np.unique(np.concatenate(pairs), return_inverse=True)
    order = np.argsort(place, kind="stable")
    total = np.add.reduceat(np.concatenate(times).astype(np.int64)[order], np.searchsorted(place[order], np.arange(len(keys))))
    return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(total)], ["pair", "n"])


def _scored(rows: DataFrame, table) -> DataFrame:
    """The rows (item, pairs, times) with n_best and count_sum over the pairs of one block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, counts, best = table.value
        for batch in batches:
            lists = batch.column("pairs")
            own, times = lists.flatten().to_numpy(), batch.column("times").flatten().to_numpy().astype(np.int64)
            ends = np.cumsum([0, *(lists.value_lengths().fill_null(0).to_pylist())])
            sums = []
            place = np.minimum(np.searchsorted(pairs, own), max(0, len(pairs) - 1))
            here = pairs[place] == own if len(pairs) else np.zeros(len(own), dtype=bool)
            for values in (best, counts):
                part = np.where(here, times * (values[place] if len(pairs) else 0), 0)
                running = np.concatenate(([0], np.cumsum(part)))
                sums.append(pa.array(running[ends[1:]] - running[ends[:-1]], pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("item"), *sums], ["item", "n_best", "count_sum"])

    return rows.select("item", "pairs", "times").mapInArrow(run, "item long, n_best long, count_sum long")


def link_scores(
    docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", digest: bool = False,
    chunk_bytes: int = CHUNK_BYTES, block_pairs: int = BLOCK_PAIRS,
) -> DataFrame:
    """The alignment of each document with n_best (its links whose count is the highest of their
    b id) and count_sum (the counts of its links, summed)."""
    spark = docs.sparkSession
    aligned = align_tokens(docs, path_a, path_b, id_col, text_col, digest, chunk_bytes)
    aligned = materialise(aligned.withColumn("item", F.monotonically_increasing_id()), "aligned")
    pairs = materialise(pair_counts(aligned), "token-pair-counts")
    blocks = max(1, -(-pairs.count() // block_pairs))
    parts = []
    for block in range(blocks):
        mine = pairs.filter(F.pmod(F.xxhash64("pair"), F.lit(blocks)) == block).toArrow().sort_by("pair")
        columns = tuple(mine.column(c).combine_chunks().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("pair", "n", "best"))
        held = spark.sparkContext.broadcast((columns[0], columns[1], columns[2]))
        parts.append(materialise(_scored(aligned, held), "link-scores"))
        held.destroy()
    discard(pairs)
    scores = parts[0]
    for other in parts[1:]:
        scores = scores.unionByName(other)
    if len(parts) > 1:
        scores = scores.groupBy("item").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return aligned.drop("pairs", "times").join(scores, "item").drop("item")

