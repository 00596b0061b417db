"""Byte-pair encoding and decoding with a contiguous rank array.

A word is held as two parallel lists: its parts and the rank of each adjacent pair. The
smallest rank is found by a scan, the boundary behind it deleted and the two neighbouring ranks
refreshed, until no pair has a rank. For the short words of ordinary text a scan over a few
adjacent numbers beats any other structure; words of more than ``SHORT`` parts use a heap of
pairs instead, with the same merges in the same order, so that a megabyte without a space costs
n log n and not n squared.

A tokenizer is a file of the ``tokenizers`` library (BPE with word ends, lower-cased; see
``Vocabulary``), named by path; it is read on every executor and never copied. Pieces between
white space are encoded once and remembered, at most ``REMEMBERED`` per Python worker (then
the memory starts anew): results do not depend on it.

Defined cases: null and empty texts have no tokens and decode to the empty text; null ids,
repeated rows, ties and empty tables pass through as they are; further columns play no part.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from veilscan.llm.inputs import id_and_text

SHORT = 64
REMEMBERED = 150_000
NO_RANK = 1 << 60
ID_BITS = 24
ID_MASK = (1 << ID_BITS) - 1
BATCH_BYTES = 8 << 20

# White space as the tokenizer's patterns know it (Unicode White_Space).
_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SPACES = regex.compile(f"[{_SPACE}]+")
# str.split() also splits at these four, which are no white space there.
_SEPARATORS = regex.compile("[\x1c-\x1f]")
# Characters whose class or lower case may differ between this interpreter's Unicode tables and
# those of the tokenizers library; texts with one of them are normalised and cut by the library.
_UNSURE = re.compile("[^\x00-\u024f\u2010-\u2027\u20ac]")
_WORDS = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{_SPACE}\p{{L}}\p{{N}}]+")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1
    characters for themselves, the others in order from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters, spare = [""] * 256, 0x100
    for b in range(256):
        if b in plain:
            letters[b] = chr(b)
        else:
            letters[b], spare = chr(spare), spare + 1
    return letters


def normalised(text: str) -> str:
    """NFC, then lower case letter by letter (a final sigma is no special case)."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
    return text.lower()


def fragments(text: str) -> list[str]:
    if _SEPARATORS.search(text):
        return [f for f in _SPACES.split(text) if f]
    return text.split()


class Vocabulary:
    """A BPE vocabulary with word ends, its merges, and the special tokens found in texts."""

    _loaded: dict[str, Vocabulary] = {}

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        ids, end = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.merges = {(ids[a], ids[b]): (rank, ids[a + b]) for rank, (a, b) in reversed(list(enumerate(pairs)))}
        # The rank of a pair above the id of what it becomes: the least number merges first.
        self.ranks = {pair: rank << ID_BITS | whole for pair, (rank, whole) in self.merges.items()}
        self.path, self.library = path, None
        letters = byte_letters()
        self.of_letter = {letter: b for b, letter in enumerate(letters)}
        self.inner = [ids[c] for c in letters]
        self.final = [ids[c + end] for c in letters]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = [""] * (1 + max([*ids.values(), *self.special.values()]))
        for token, n in [*ids.items(), *self.special.items()]:
            self.tokens[n] = token
        names = sorted(self.special, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None
        self.decimal = [str(n) for n in range(len(self.tokens))]
        # Pieces between white space that are not a word of letters, and words.
        self.memory: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    @classmethod
    def at(cls, path: str) -> Vocabulary:
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def library_words(self, text: str) -> list[str]:
        """The words of a text with any characters, as the library's normaliser and pattern have
        them; what becomes of a word is not left to it."""
        if self.library is None:
            self.library = Tokenizer.from_file(self.path)
        cut = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [bytes(map(self.of_letter.__getitem__, letters)).decode("utf-8", "surrogatepass") for letters, _ in cut]

    def word(self, word: str) -> list[int]:
        raw = word.encode("utf-8", "surrogatepass")
        parts = [*map(self.inner.__getitem__, raw)]
        parts[-1] = self.final[raw[-1]]
        return self._scan(parts) if len(parts) <= SHORT else self._heap(parts)

    def _scan(self, parts: list[int]) -> list[int]:
        rank_of = self.ranks.get
        ranks = [rank_of(p, NO_RANK) for p in zip(parts, parts[1:])]
        while ranks:
            least = min(ranks)
            if least == NO_RANK:
                break
            k = ranks.index(least)
            del parts[k], ranks[k]
            merged = parts[k] = least & ID_MASK
            if k:
                ranks[k - 1] = rank_of((parts[k - 1], merged), NO_RANK)
            if k < len(ranks):
                ranks[k] = rank_of((merged, parts[k + 1]), NO_RANK)
        return parts

    def _heap(self, parts: list[int]) -> list[int]:
        after = [*range(1, len(parts)), -1]
        before = [*range(-1, len(parts) - 1)]
        alive: list[int | None] = list(parts)
        heap = [(m[0], k, p) for k, p in enumerate(zip(parts, parts[1:])) if (m := self.merges.get(p))]
        heapq.heapify(heap)
        while heap:
            _, k, pair = heapq.heappop(heap)
            n = after[k]
            if n < 0 or alive[k] is None or (alive[k], alive[n]) != pair:
                continue
            alive[k], alive[n] = self.merges[pair][1], None
            after[k] = after[n]
            if after[n] >= 0:
                before[after[n]] = k
            for left in (before[k], k):
                if left >= 0 and after[left] >= 0:
                    pair = (alive[left], alive[after[left]])
                    if m := self.merges.get(pair):
                        heapq.heappush(heap, (m[0], left, pair))
        return [p for p in alive if p is not None]

    def _known_word(self, word: str) -> bytes:
        packed = self.words.get(word)
        if packed is None:
            packed = array("i", self.word(word)).tobytes()
            if len(word) <= 4 * SHORT:
                self.words[word] = packed
        return packed

    def _fragment(self, fragment: str) -> bytes:
        if len(self.memory) + len(self.words) >= REMEMBERED:
            self.memory.clear()
            self.words.clear()
        if fragment.isalpha():  # letters only: one word
            return self._known_word(fragment)
        packed = b"".join(map(self._known_word, _WORDS.findall(fragment)))
        if len(fragment) <= 4 * SHORT:
            self.memory[fragment] = packed
        return packed

    def encode(self, text: str) -> bytes:
        """Token ids of a text as little-endian 32-bit integers."""
        if self.cut is None or "<|" not in text:
            return self._plain(text)
        parts = self.cut.split(text)
        return b"".join(
            np.array([self.special[p]], dtype="<i4").tobytes() if k % 2 else self._plain(p) for k, p in enumerate(parts)
        )

    def _plain(self, text: str) -> bytes:
        if _UNSURE.search(text):
            if len(self.memory) + len(self.words) >= REMEMBERED:
                self.memory.clear()
                self.words.clear()
            return b"".join(map(self._known_word, self.library_words(text)))
        word, other, new = self.words.get, self.memory.get, self._fragment
        return b"".join([word(f) or other(f) or new(f) for f in fragments(normalised(text))])

    def decode(self, ids: list[int]) -> str:
        """The library has no decoder for this kind of file and joins tokens by a space."""
        return " ".join(map(self.tokens.__getitem__, ids))


def _sliced(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Cuts a batch into parts of about BATCH_BYTES, by the sizes of one column."""
    sizes = np.diff(np.frombuffer(batch.column(column).buffers()[1], dtype=np.int32)[batch.column(column).offset :][: batch.num_rows + 1])
    cuts, total = [0], 0
    for k, size in enumerate(sizes.tolist()):
        total += size
        if total >= BATCH_BYTES:
            cuts.append(k + 1)
            total = 0
    if cuts[-1] != batch.num_rows:
        cuts.append(batch.num_rows)
    for start, end in zip(cuts, cuts[1:]):
        yield batch.slice(start, end - start)


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (array of int), special tokens inside texts included, none added."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary.at(path)
        for whole in batches:
            for batch in _sliced(whole, "text"):
                packed = [vocabulary.encode(t) for t in batch.column("text").to_pylist()]
                ends = np.cumsum([0, *(len(p) // 4 for p in packed)]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(packed), dtype="<i4")))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids], ["doc_id", "ids"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """The encoded table with a column ``decoded``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary.at(path)
        for whole in batches:
            for batch in _sliced(whole, "ids"):
                lists = batch.column("ids")
                ends, flat = lists.offsets.to_pylist(), np.asarray(lists.values)
                decoded = [vocabulary.decode(flat[a:b].tolist()) for a, b in zip(ends, ends[1:])]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(decoded, pa.string())], [*batch.schema.names, "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, decoded string")


_DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def round_trip_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, and SHA-256 of the ids (in decimal, joined by a space) and of the text
    decoded from them. Both ways run in one worker, so neither ids nor texts travel back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary.at(path)
        for whole in batches:
            counts, first, second = [], [], []
            for text in whole.column("text"):
                ids = np.frombuffer(vocabulary.encode(text.as_py()), dtype="<i4").tolist()
                counts.append(len(ids))
                first.append(hashlib.sha256(" ".join(map(vocabulary.decimal.__getitem__, ids)).encode()).hexdigest())
                second.append(hashlib.sha256(vocabulary.decode(ids).encode()).hexdigest())
            columns = [whole.column("doc_id"), pa.array(counts, pa.int64()), pa.array(first, pa.string()), pa.array(second, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, _DIGESTS)
