"""Token counts by a compiled finite-state transducer.

The tokenizer's word pattern and its merges are compiled into one deterministic transducer
over characters whose transitions are annotated with the number of tokens they emit. Inside a
word its state is what the merges still depend on: the longest suffix that begins some token,
and for every position in it from which a token may still begin the last token of the encoding
up to there with its count, relative to the current one. A character can finish a longer token in place of several, so an
annotation may be negative; their sum at the end of a word is its number of tokens. That an
encoding is settled by its adjacent pairs (two tokens may stand together if encoding their
joined text gives just them) is what makes this finite.

States are compiled when first reached, and so are the sums over whole pieces between white
space, where the transducer is back at its start. At most ``MAX_STATES`` and ``MAX_BETWEEN`` are
kept per Python worker (then compilation starts anew, which costs time and changes no count).

Texts of more than ``CHUNK_CHARS`` characters are cut into chunks that are counted in parallel.
White space returns the transducer to its start, whatever came before, so the map of a chunk
from states to states is: the characters up to its first white space, the tokens between the
first and the last, and the characters after it. Such maps compose associatively, and Spark
composes them in two levels: 256 neighbours at a time, then the rest (a string has fewer than
2^31 bytes, so both levels are bounded).

Defined cases: null and empty texts have 0 bytes and tokens; rows with null ids and repeated
rows are counted each; an empty table gives an empty table; further columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, functions as F

from veilscan.llm.bpe import _SPACE, _UNSURE, Vocabulary, fragments, normalised
from veilscan.llm.inputs import id_and_text, shuffle_partitions

CHUNK_CHARS = 1 << 18
MAX_STATES = 200_000
MAX_BETWEEN = 400_000
GROUP = 256

_GAP = regex.compile(f"[{_SPACE}]")
_LETTER = regex.compile(r"\p{L}")
_NUMBER = regex.compile(r"\p{N}")

# What may follow an apostrophe that begins a piece, as the tokenizer's pattern has it.
SHORT_ENDINGS = ("s", "t", "m", "d")
LONG_ENDINGS = ("re", "ve", "ll")

# The state between words, and the tail (suffix, marks) of a word without characters.
NO_TAIL: tuple = (b"", ((None, 0),))


class State(dict):
    """Transitions: character to (state, emitted tokens). "" ends the text."""

    __slots__ = ("kind", "tail")

    def __init__(self, kind: str, tail: tuple) -> None:
        super().__init__()
        self.kind, self.tail = kind, tail


class Between(dict):
    """What the transducer emits from one white space to the next, where it is back at its
    start: a piece met before is a single transition."""

    def __init__(self, transducer: Transducer) -> None:
        super().__init__()
        self.walk = transducer.walk

    def __missing__(self, piece: str) -> int:
        count = self.walk(piece)
        if len(piece) <= 256:
            self[piece] = count
        return count


class Transducer:
    _compiled: dict[str, Transducer] = {}

    def __init__(self, path: str) -> None:
        self.vocabulary = v = Vocabulary.at(path)
        of_byte = {n: bytes([b]) for b, n in enumerate(v.inner)} | {n: bytes([b]) for b, n in enumerate(v.final)}
        final = set(v.final)
        made: dict[int, tuple[int, ...]] = {n: (n,) for n in of_byte}
        for (a, b), (_, whole) in sorted(v.merges.items(), key=lambda m: m[1][0]):
            made.setdefault(whole, made[a] + made[b])
        # Tokens that the merges reach from their own characters, by their bytes.
        self.symbols = {n: s for n, s in made.items() if v._scan(list(s)) == [n]}
        self.inner: dict[bytes, int] = {}
        self.final: dict[bytes, int] = {}
        for n, symbols in self.symbols.items():
            text = b"".join(of_byte[s] for s in symbols)
            (self.final if symbols[-1] in final else self.inner)[text] = n
        self.beginnings = {b""}
        for text in self.inner:
            self.beginnings.update(text[:k] for k in range(1, len(text)))
        for text in self.final:
            self.beginnings.update(text[:k] for k in range(1, len(text) + 1))
        self.beside: dict[tuple[int, int], bool] = {}
        self.between = Between(self)
        self.reset()

    @classmethod
    def at(cls, path: str) -> Transducer:
        if path not in cls._compiled:
            cls._compiled[path] = cls(path)
        return cls._compiled[path]

    def reset(self) -> None:
        self.states: dict[tuple, State] = {}
        self.start = self.state("start", NO_TAIL)

    def state(self, kind: str, tail: tuple) -> State:
        key = (kind, tail)
        known = self.states.get(key)
        if known is None:
            known = self.states[key] = State(kind, tail)
        return known

    # The encoder of a word, byte by byte.

    def stand_together(self, left: int | None, right: int) -> bool:
        if left is None:
            return True
        known = self.beside.get((left, right))
        if known is None:
            if len(self.beside) >= 4 * MAX_STATES:
                self.beside.clear()
            both = self.vocabulary._scan([*self.symbols[left], *self.symbols[right]])
            known = self.beside[left, right] = both == [left, right]
        return known

    def grow(self, tail: tuple, byte: int) -> tuple[tuple, int]:
        suffix, marks = tail
        text = suffix + bytes((byte,))
        for k, mark in enumerate(marks):
            if mark:
                token = self.inner.get(text[k:])
                if token is not None and self.stand_together(mark[0], token):
                    break
        count = mark[1] + 1
        first, kept = len(text), [(token, 0)]
        for k in range(len(text) - 1, -1, -1):
            live = marks[k] and text[k:] in self.beginnings
            kept.append((marks[k][0], marks[k][1] - count) if live else None)
            if live:
                first = k
        return (text[first:], tuple(kept[len(text) - first :: -1])), count

    def close(self, tail: tuple) -> int:
        """Tokens that the end of the word adds."""
        suffix, marks = tail
        for k in range(len(suffix)):
            token = self.final.get(suffix[k:]) if marks[k] else None
            if token is not None and self.stand_together(marks[k][0], token):
                return marks[k][1] + 1
        raise ValueError("no token ends this word")

    def longer(self, tail: tuple, char: str) -> tuple[tuple, int]:
        total = 0
        for byte in char.encode("utf-8", "surrogatepass"):
            tail, count = self.grow(tail, byte)
            total += count
        return tail, total

    def whole(self, word: str) -> int:
        tail, total = self.longer(NO_TAIL, word)
        return total + self.close(tail)

    # The word pattern.

    def begin(self, char: str) -> tuple[State, int]:
        """From between words."""
        if char == "" or _GAP.match(char):
            return self.start, 0
        if _NUMBER.match(char):
            return self.start, self.whole(char)
        tail, count = self.longer(NO_TAIL, char)
        kind = "letters" if _LETTER.match(char) else "apostrophe" if char == "'" else "others"
        return self.state(kind, tail), count

    def follow(self, state: State, char: str) -> tuple[State, int]:
        kind, tail = state.kind, state.tail
        if kind == "start":
            return self.begin(char)
        if kind.startswith("'"):  # an apostrophe and a letter that may begin an ending
            if kind[1:] + char in LONG_ENDINGS:
                return self.start, self.whole(kind + char)
            then, count = self.begin(kind[1:])
            after, more = self.follow(then, char)
            return after, self.whole("'") + count + more
        letter = bool(char) and bool(_LETTER.match(char))
        other = bool(char) and not letter and not _GAP.match(char) and not _NUMBER.match(char)
        if kind == "apostrophe" and char in SHORT_ENDINGS:
            tail, count = self.longer(tail, char)
            return self.start, count + self.close(tail)
        if kind == "apostrophe" and any(e[0] == char for e in LONG_ENDINGS):
            # What the apostrophe has emitted is taken back until the next character decides.
            return self.state(f"'{char}", NO_TAIL), -self.longer(NO_TAIL, "'")[1]
        if (kind == "letters" and letter) or (kind in ("others", "apostrophe") and other):
            tail, count = self.longer(tail, char)
            return self.state("letters" if letter else "others", tail), count
        after, count = self.begin(char)
        return after, self.close(tail) + count

    def step(self, state: State, char: str) -> tuple[State, int]:
        if len(self.states) >= MAX_STATES:
            kind, tail = state.kind, state.tail
            self.reset()
            state = self.state(kind, tail)
        made = state[char] = self.follow(state, char)
        return made

    def run(self, text: str) -> int:
        """Tokens of a normalised text."""
        if len(self.between) > MAX_BETWEEN:
            self.between.clear()
        return sum(map(self.between.__getitem__, fragments(text)))

    def walk(self, text: str) -> int:
        """Tokens of a text, character by character from the start state to its end."""
        state, total = self.start, 0
        for char in text:
            try:
                state, emitted = state[char]
            except KeyError:
                state, emitted = self.step(state, char)
            total += emitted
        try:
            return total + state[""][1]
        except KeyError:
            return total + self.step(state, "")[1]

    def count(self, text: str) -> int:
        """Tokens of a raw text; special strings in it count one each."""
        cut = self.vocabulary.cut
        if cut is None or "<|" not in text:
            return self.plain(text)
        return sum(1 if k % 2 else self.plain(p) for k, p in enumerate(cut.split(text)))

    def plain(self, text: str) -> int:
        """Tokens of a raw text in which special strings are plain text. Where the library's
        Unicode tables decide what a word is, it names the words, which are walked all the same."""
        if not _UNSURE.search(text):
            return self.run(normalised(text))
        return sum(map(self.whole, self.vocabulary.library_words(text)))


# Maps of chunks: (head, tokens, tail), tokens None for a chunk without white space (all head).


def chunk_map(transducer: Transducer, chunk: str) -> tuple[str, int | None, str]:
    first = _GAP.search(chunk)
    if not first:
        return chunk, None, ""
    last = len(chunk) - 1
    while not _GAP.match(chunk[last]):
        last -= 1
    return chunk[: first.start()], transducer.count(chunk[first.start() : last + 1]), chunk[last + 1 :]


def compose(transducer: Transducer, left: tuple, right: tuple) -> tuple[str, int | None, str]:
    if left[1] is None:
        return left[0] + right[0], right[1], right[2]
    if right[1] is None:
        return left[0], left[1], left[2] + right[0]
    return left[0], left[1] + transducer.count(left[2] + right[0]) + right[1], right[2]


def closed(transducer: Transducer, whole: tuple) -> int:
    return transducer.count(whole[0]) + (whole[1] or 0) + transducer.count(whole[2])


_MAPS = "row long, doc_id long, n_bytes long, at long, head string, n long, tail string"


def count_tokens(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", chunk_chars: int = CHUNK_CHARS
) -> DataFrame:
    """One row per document: doc_id, n_bytes (UTF-8) and n_tokens."""
    texts = id_and_text(docs, id_col, text_col).withColumn("n_bytes", F.octet_length("text").cast("long"))

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        transducer = Transducer.at(path)
        for batch in batches:
            yield pd.DataFrame({
                "doc_id": batch["doc_id"].astype("Int64"), "n_bytes": batch["n_bytes"],
                "n_tokens": np.fromiter(map(transducer.count, batch["text"]), dtype=np.int64, count=len(batch)),
            })

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row, doc_id, n_bytes, text in zip(batch["row"], batch["doc_id"], batch["n_bytes"], batch["text"]):
                for at in range(0, len(text), chunk_chars):
                    yield pd.DataFrame({
                        "row": [row], "doc_id": pd.array([None if pd.isna(doc_id) else int(doc_id)], dtype="Int64"),
                        "n_bytes": [n_bytes], "at": [at // chunk_chars], "chunk": [text[at : at + chunk_chars]],
                    })

    def mapped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        transducer = Transducer.at(path)
        for batch in batches:
            maps = [chunk_map(transducer, c) for c in batch["chunk"]]
            yield batch[["row", "doc_id", "n_bytes", "at"]].assign(
                doc_id=batch["doc_id"].astype("Int64"), head=[m[0] for m in maps],
                n=pd.array([m[1] for m in maps], dtype="Int64"), tail=[m[2] for m in maps],
            )

    def combined(group: pd.DataFrame) -> pd.DataFrame:
        transducer = Transducer.at(path)
        group = group.sort_values("at")
        maps = [(h, None if pd.isna(n) else int(n), t) for h, n, t in zip(group["head"], group["n"], group["tail"])]
        one = maps[0]
        for other in maps[1:]:
            one = compose(transducer, one, other)
        return group.head(1).assign(
            at=int(group["at"].iloc[0]) // GROUP, doc_id=group["doc_id"].head(1).astype("Int64"),
            head=one[0], n=pd.array([one[1]], dtype="Int64"), tail=one[2],
        )

    def ended(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        transducer = Transducer.at(path)
        for batch in batches:
            maps = [(h, None if pd.isna(n) else int(n), t) for h, n, t in zip(batch["head"], batch["n"], batch["tail"])]
            yield pd.DataFrame({
                "doc_id": batch["doc_id"].astype("Int64"), "n_bytes": batch["n_bytes"],
                "n_tokens": [closed(transducer, m) for m in maps],
            })

    counted = "doc_id long, n_bytes long, n_tokens long"
    short = texts.filter(F.length("text") <= chunk_chars).mapInPandas(whole, counted)
    chunks = (
        texts.filter(F.length("text") > chunk_chars)
        .withColumn("row", F.monotonically_increasing_id())
        .mapInPandas(cut, "row long, doc_id long, n_bytes long, at long, chunk string")
        .repartition(shuffle_partitions(docs), "row", "at")
    )
    maps = chunks.mapInPandas(mapped, _MAPS)
    pairs = maps.groupBy("row", F.floor(F.col("at") / GROUP).alias("part")).applyInPandas(
        lambda group: combined(group.drop(columns="part", errors="ignore")), _MAPS
    )
    wholes = pairs.groupBy("row").applyInPandas(combined, _MAPS)
    return short.unionByName(wholes.mapInPandas(ended, counted))
