"""Token ids as flat unsigned integer files with 64-bit document offsets.

Documents are range-partitioned by id and sorted, so the shards in order hold the ids of all
documents in ascending order. A shard is two files:

* ``.ids``: the token ids of its documents, one after the other, little-endian, 16 bits wide
  where the vocabulary has at most 65,536 entries and 32 bits otherwise, each document ended by
  the end id;
* ``.idx``: an 8-byte mark, the width in bytes, the number of documents, then 64-bit little-endian
  arrays: the document ids, the offsets within the shard (one more than documents), and a byte
  per document that is 0 for a null id.

The manifest (one row per shard) is a table; a shard's base is the prefix sum of the tokens of
the shards before it, so a reader finds any document at base plus offset. Shards are written by
streaming and read through memory maps; no task holds more than a batch of texts.

Defined cases: a null or empty text is just the end id; null ids come first; documents that
share an id are all kept, ordered by their text's hash and text; an empty table has no shard;
further columns play no part.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from veilscan.llm import files
from veilscan.llm.bpe import byte_letters
from veilscan.llm.inputs import id_and_text, shuffle_partitions
from veilscan.session import materialise

MARK = b"VSTOKEN1"
END_ID = 0
REMEMBERED = 600_000
MANIFEST = "shard int, width int, n_docs long, n_tokens long, ids_file string, index_file string"


# The byte-level word pattern. Texts in which regex engines may disagree about letters or white
# space, or with special tokens, are left to the library as they are.
_WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_UNSURE = re.compile("<\\||[\x1c-\x1f]|[^\x00-\u024f]")
_LETTERS = str.maketrans({chr(b): letter for b, letter in enumerate(byte_letters())})


class Memory(dict):
    """Ids by what follows a space: pieces met before are looked up, others encoded."""

    def __init__(self, encode) -> None:
        super().__init__()
        self.encode = encode

    def __missing__(self, rest: str) -> bytes:
        made = self.encode(" " + rest)
        if len(rest) <= 256:
            self[rest] = made
        return made


class Encoder:
    """Encodes texts with the tokenizers library, piece by piece.

    The byte-level word pattern always starts a new word at a space between two characters that
    are no white space, so the text falls into pieces there whose ids do not depend on each
    other. Each piece is taken apart into words once, each word given to the library's merges
    once, and both are remembered.
    """

    _loaded: dict[tuple[str, str], Encoder] = {}

    def __init__(self, path: str, dtype: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer, self.kind = Tokenizer.from_file(path), "H" if dtype == "<u2" else "I"
        self.words: dict[str, bytes] = {}
        self.memory = Memory(self.piece)

    @classmethod
    def at(cls, path: str, dtype: str) -> Encoder:
        if (path, dtype) not in cls._loaded:
            cls._loaded[path, dtype] = cls(path, dtype)
        return cls._loaded[path, dtype]

    @staticmethod
    def pieces(text: str) -> list[str]:
        """The first piece, and of the others what follows their space."""
        parts = text.split(" ")
        if not (text.startswith(" ") or any(c in text and c + " " in text for c in _SPACES)):
            return parts
        out = parts[:1]
        for part in parts[1:]:
            before = out[-1]
            if before and not before[-1].isspace():
                out.append(part)
            else:
                out[-1] = before + " " + part
        return out

    def encode(self, text: str) -> bytes:
        if len(self.memory) + len(self.words) > REMEMBERED:
            self.memory.clear()
            self.words.clear()
        pieces = iter(self.pieces(text))
        return b"".join([self.piece(next(pieces)), *map(self.memory.__getitem__, pieces)])

    def piece(self, piece: str) -> bytes:
        unsure = _UNSURE.search(piece)
        if piece[:1] == " " and not unsure:  # most pieces are a space and a word, with or without a mark
            if piece[1:].isalpha():  # remembered as a piece, and only so
                return self.merged(piece)
            if piece[1:-1].isalpha() and piece[-1] in ".,;:!?":
                return self.memory[piece[1:-1]] + self.word(piece[-1])
        if unsure:
            return array(self.kind, self.tokenizer.encode(piece, add_special_tokens=False).ids).tobytes()
        return b"".join(map(self.word, _WORDS.findall(piece)))

    def word(self, word: str) -> bytes:
        known = self.words.get(word)
        if known is None:
            known = self.merged(word)
            if len(word) <= 256:
                self.words[word] = known
        return known

    def merged(self, word: str) -> bytes:
        letters = word.encode().decode("latin-1").translate(_LETTERS)
        return array(self.kind, [t.id for t in self.tokenizer.model.tokenize(letters)]).tobytes()


# All white space, the space first. Looking for each in turn is faster than a pattern for all.
_SPACES = " \t\n\v\f\r\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def _batches(batch: pa.RecordBatch, size: int = 4 << 20) -> Iterator[tuple[list, list[str]]]:
    ids, texts, total = [], [], 0
    for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
        text = text.as_py()
        ids.append(doc_id)
        texts.append(text)
        total += len(text)
        if total >= size:
            yield ids, texts
            ids, texts, total = [], [], 0
    if ids:
        yield ids, texts


def write_token_files(
    docs: DataFrame, path: str, folder: str, vocabulary_size: int, id_col: str = "doc_id", text_col: str = "text",
    end_id: int = END_ID, shards: int | None = None,
) -> DataFrame:
    """Writes the shards below ``folder`` and returns the committed manifest."""
    dtype = "<u2" if vocabulary_size <= 1 << 16 else "<u4"
    width = int(dtype[2])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        encoder, end = Encoder.at(path, dtype), np.array([end_id], dtype=dtype).tobytes()
        doc_ids: list[np.ndarray] = []
        known: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        ids_file, out = files.own_name(folder, f"{shard:06d}", ".ids"), None
        for whole in batches:
            for ids, texts in _batches(whole):
                out = out or files.writer(ids_file)
                packed = [encoder.encode(t) for t in texts]
                out.write(end.join(packed) + end)
                sizes.append(np.array([len(p) // width + 1 for p in packed], dtype="<i8"))
                doc_ids.append(np.array([i or 0 for i in ids], dtype="<i8"))
                known.append(np.array([i is not None for i in ids], dtype=np.uint8))
        if out is None:
            return
        out.close()
        offsets = np.concatenate(([0], np.cumsum(np.concatenate(sizes)))).astype("<i8")
        index_file = files.own_name(folder, f"{shard:06d}", ".idx")
        with files.writer(index_file) as index:
            index.write(MARK + np.array([width, len(offsets) - 1], dtype="<i8").tobytes())
            index.write(np.concatenate(doc_ids).tobytes())
            index.write(offsets.tobytes())
            index.write(np.concatenate(known).tobytes())
        row = {
            "shard": [shard], "width": [width], "n_docs": [len(offsets) - 1], "n_tokens": [int(offsets[-1])],
            "ids_file": [ids_file], "index_file": [index_file],
        }
        types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row.values(), types)], list(row))

    ordered = (
        id_and_text(docs, id_col, text_col).withColumn("tie", F.xxhash64("text"))
        .repartitionByRange(shards or shuffle_partitions(docs), F.col("doc_id").asc_nulls_first(), "tie")
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie", "text")
    )
    return materialise(ordered.select("doc_id", "text").mapInArrow(write, MANIFEST), "token-manifest")


def with_bases(manifest: DataFrame) -> DataFrame:
    """The manifest (one row per shard) with ``base``, the tokens of all shards before."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0).cast("long")))


def read_token_files(manifest: DataFrame) -> DataFrame:
    """One row per document, from the files: doc_id, start (among all tokens), n_tokens, and
    the CRC-32 of its ids as little-endian 32-bit integers. Each shard is read by one task."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for shard in batch.itertuples():
                with files.mapped(shard.index_file) as index:
                    raw = index.read()
                if raw[:8] != MARK:
                    raise ValueError(f"{shard.index_file} is no index of token files")
                width, n = (int(x) for x in np.frombuffer(raw, dtype="<i8", count=2, offset=8))
                doc_ids = np.frombuffer(raw, dtype="<i8", count=n, offset=24)
                offsets = np.frombuffer(raw, dtype="<i8", count=n + 1, offset=24 + 8 * n)
                known = np.frombuffer(raw, dtype=np.uint8, count=n, offset=24 + 8 * n + 8 * (n + 1))
                with files.mapped(shard.ids_file) as ids:
                    for at in range(0, n, 4096):
                        until = min(n, at + 4096)
                        sums = []
                        for k in range(at, until):
                            ids.seek(int(offsets[k]) * width)
                            own = ids.read(int(offsets[k + 1] - offsets[k]) * width)
                            sums.append(zlib.crc32(np.frombuffer(own, dtype=f"<u{width}").astype("<u4").tobytes()))
                        yield pd.DataFrame({
                            "doc_id": pd.arrays.IntegerArray(doc_ids[at:until].astype(np.int64), known[at:until] == 0),
                            "start": offsets[at:until] + shard.base, "n_tokens": np.diff(offsets[at : until + 1]),
                            "ids_crc32": np.array(sums, dtype=np.int64),
                        })

    return (
        with_bases(manifest).repartition(shuffle_partitions(manifest), "shard")
        .mapInPandas(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
    )
