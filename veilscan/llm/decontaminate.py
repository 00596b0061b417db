"""Benchmark decontamination with a generalised suffix automaton.

All test items, as sequences of normalised words, go into one automaton. The words of a
document are streamed through it; after each word the automaton knows the longest run of words
ending there that occurs in some item. Where that run reaches a window (10 words, or a whole
shorter item), the words of the window are hit and the items that hold it are known from the
state. Time is linear in the words of the documents, whatever the number of items.

The automaton is broadcast. Its size is bounded: equal items are one text with several ids, and
beyond ``block_bytes`` the texts are dealt into blocks of about that size (an id counts as eight
bytes, and a text with very many ids takes several shares). Each block has its own automaton and
pass, whose hits are written before the next block is read, so one automaton lives at a time; hits
of several blocks are united per document, and texts are cut by all of them at once.

Words are the matches of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z.
Defined cases: null or empty texts have no words and are never hit; items without words are
never found; an item without an id marks words but is not listed; repeated documents and items
are each treated as themselves; empty tables give empty (or unhit) results; further columns
play no part.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from veilscan.llm.inputs import id_and_text
from veilscan.session import materialise

WINDOW = 10
BLOCK_BYTES = 1 << 20
# Shares per block when texts are dealt, and ids of one text in a share (about).
SHARES = 4
IDS_PER_SHARE = 1 << 12

_KEPT = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)
_WORD = re.compile(rb"[^ ]+")


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_KEPT).split()


@dataclass
class Automaton:
    """A generalised suffix automaton over word numbers, with the items of every window."""

    window: int
    words: dict[bytes, int] = field(default_factory=dict)
    moves: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])
    # By state: the state that holds its last `window` words, or -1.
    at_window: list[int] = field(default_factory=list)
    items: dict[int, set[int]] = field(default_factory=dict)
    # By state: (words, items) of whole shorter items that are suffixes of the state.
    short: dict[int, list[tuple[int, tuple[int, ...]]]] = field(default_factory=dict)

    @classmethod
    def of(cls, items: list[tuple[list[int], str | None]], window: int) -> Automaton:
        """``items`` are texts with their ids, which may be none."""
        self = cls(window)
        numbered = [
            (ids, [self.words.setdefault(w, len(self.words)) for w in words_of(text)]) for ids, text in items
        ]
        for _, numbers in numbered:
            last = 0
            for n in numbers:
                last = self._extend(last, n)
        by_length = sorted(range(len(self.length)), key=self.length.__getitem__)
        self.at_window = [-1] * len(self.length)
        for s in by_length[1:]:
            up = self.link[s]
            if self.length[s] >= window:
                self.at_window[s] = s if self.length[up] < window else self.at_window[up]
        ends: dict[int, set[tuple[int, tuple[int, ...]]]] = {}
        for ids, numbers in numbered:
            state = 0
            for k, n in enumerate(numbers, 1):
                state = self.moves[state][n]
                if k >= window:
                    self.items.setdefault(self.at_window[state], set()).update(ids)
            if 0 < len(numbers) < window:
                ends.setdefault(state, set()).add((len(numbers), tuple(ids)))
        if ends:
            for s in by_length[1:]:
                own = [*self.short.get(self.link[s], []), *ends.get(s, ())]
                if own:
                    self.short[s] = own
        return self

    def _extend(self, last: int, n: int) -> int:
        moves, link, length = self.moves, self.link, self.length
        if n in moves[last]:
            there = moves[last][n]
            return there if length[there] == length[last] + 1 else self._split(last, there, n)
        new = len(length)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        at = last
        while at != -1 and n not in moves[at]:
            moves[at][n] = new
            at = link[at]
        if at != -1:
            there = moves[at][n]
            link[new] = there if length[there] == length[at] + 1 else self._split(at, there, n)
        return new

    def _split(self, at: int, there: int, n: int) -> int:
        copy = len(self.length)
        self.moves.append(dict(self.moves[there]))
        self.length.append(self.length[at] + 1)
        self.link.append(self.link[there])
        self.link[there] = copy
        while at != -1 and self.moves[at].get(n) == there:
            self.moves[at][n] = copy
            at = self.link[at]
        return copy

    def spans(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Maximal runs of hit words, as [start, end), and the items whose windows occur."""
        moves, link, length, window = self.moves, self.link, self.length, self.window
        at_window, short, known = self.at_window, self.short, self.words.get
        spans: list[tuple[int, int]] = []
        found: set[int] = set()
        state = matched = 0
        for k, word in enumerate(words):
            n = known(word)
            if n is None:
                state = matched = 0
                continue
            while n not in moves[state]:
                state = link[state]
                if state < 0:
                    break
                matched = length[state]
            if state < 0:
                state = matched = 0
                continue
            state = moves[state][n]
            matched += 1
            reach = 0
            if matched >= window:
                reach = window
                found |= self.items[at_window[state]]
            if short and state in short:
                for size, ids in short[state]:
                    if size <= matched:
                        reach = max(reach, size)
                        found.update(ids)
            if reach:
                start = k + 1 - reach
                while spans and spans[-1][1] >= start:
                    start = min(start, spans.pop()[0])
                spans.append((start, k + 1))
        return spans, found


class Blocks:
    """The texts of the items with their ids, in blocks of bounded size."""

    def __init__(self, benchmark: DataFrame, item_col: str, text_col: str, window: int, block_bytes: int) -> None:
        self.spark, self.window = benchmark.sparkSession, window
        pairs = id_and_text(benchmark, item_col, text_col).filter("text <> ''").distinct()
        shares = pairs.groupBy("text").agg(F.ceil(F.count("*") / IDS_PER_SHARE).alias("shares"))
        texts = (
            pairs.join(shares, "text").withColumn("share", F.pmod(F.xxhash64("doc_id"), F.col("shares")))
            .groupBy("text", "share").agg(F.array_sort(F.collect_list("doc_id")).alias("ids"))
            .withColumn("weight", F.octet_length("text") + 8 * F.size("ids"))
        )
        texts = materialise(texts, "leak-items")
        total = texts.agg(F.sum("weight")).first()[0] or 0
        parts = SHARES * -(-total // block_bytes) if total > block_bytes else 1
        part = F.pmod(F.xxhash64("text", "share"), F.lit(parts))
        self.texts = texts.withColumn("part", part)
        # Neighbouring parts go together as long as they fit; one row per quarter of a block.
        self.bounds: list[list[int]] = []
        held = 0
        for r in self.texts.groupBy("part").agg(F.sum("weight").alias("weight")).orderBy("part").collect():
            if not self.bounds or held + r.weight > block_bytes:
                self.bounds.append([r.part, r.part])
                held = 0
            self.bounds[-1][1] = r.part
            held += r.weight
        self.bounds = self.bounds or [[0, 0]]

    def __len__(self) -> int:
        return len(self.bounds)

    def automaton(self, block: int) -> Broadcast:
        first, last = self.bounds[block]
        mine = self.texts.filter(F.col("part").between(first, last)).select("ids", "text").collect()
        return self.spark.sparkContext.broadcast(Automaton.of([(r.ids, r.text) for r in mine], self.window))

    def united(self, scan: Callable[[Broadcast], DataFrame]) -> DataFrame:
        """What ``scan`` finds with each block, one after the other."""
        found = None
        for block in range(len(self)):
            automaton = self.automaton(block)
            one = materialise(scan(automaton), "leak-spans")
            automaton.destroy()
            found = one if found is None else found.unionByName(one)
        return found


_HITS = "doc_id long, copy string, n_words long, spans array<struct<first:long,after:long>>, items array<long>"


def _scan(docs: DataFrame, automaton) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                words = words_of(text)
                spans, found = automaton.value.spans(words)
                copy = hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest() if spans else ""
                rows.append((doc_id, copy, len(words), [{"first": s, "after": e} for s, e in spans], sorted(found)))
            out = pd.DataFrame(rows, columns=["doc_id", "copy", "n_words", "spans", "items"])
            yield out.assign(doc_id=batch["doc_id"].astype("Int64").to_numpy(dtype=object))

    return docs.mapInPandas(run, _HITS)


_UNITED = (
    "aggregate(array_sort(flatten(all_spans)), cast(array() as array<struct<first:bigint,after:bigint>>), (acc, x) -> "
    "if(size(acc) > 0 AND element_at(acc, -1).after >= x.first, "
    "concat(slice(acc, 1, size(acc) - 1), array(named_struct('first', element_at(acc, -1).first, "
    "'after', greatest(element_at(acc, -1).after, x.after)))), concat(acc, array(x))))"
)


def find_overlaps(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row per document: doc_id, n_words, spans (maximal runs of hit words) and items (ids
    of the items whose windows occur, sorted)."""
    rows = id_and_text(docs, id_col, text_col)
    blocks = Blocks(benchmark, item_col, item_text_col, window, block_bytes)
    if len(blocks) == 1:
        return _scan(rows, blocks.automaton(0)).drop("copy")
    hits = blocks.united(lambda automaton: _scan(rows, automaton).filter("size(spans) > 0"))
    united = (
        hits.groupBy("doc_id", "copy")
        .agg(F.collect_set("spans").alias("all_spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
        .select(F.col("doc_id").alias("hit_id"), F.col("copy").alias("hit_copy"), F.expr(_UNITED).alias("spans"), "items")
    )
    every = _counted(rows)
    return every.join(united, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("copy") == F.col("hit_copy")), "left").select(
        "doc_id", "n_words",
        F.coalesce("spans", F.expr("cast(array() as array<struct<first:bigint,after:bigint>>)")).alias("spans"),
        F.coalesce("items", F.expr("cast(array() as array<bigint>)")).alias("items"),
    )


def _counted(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({
                "doc_id": batch["doc_id"].astype("Int64"),
                "copy": [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in batch["text"]],
                "n_words": [len(words_of(t)) for t in batch["text"]],
            })

    return rows.mapInPandas(run, "doc_id long, copy string, n_words long")


def cut_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans and what stands between them."""
    raw = text.encode("utf-8", "surrogatepass")
    places = [m.span() for m in _WORD.finditer(raw.translate(_KEPT))]
    parts, at = [], 0
    for first, after in spans:
        parts.append(raw[at : places[first][0]])
        at = places[after - 1][1]
    parts.append(raw[at:])
    return b"".join(parts).decode("utf-8", "surrogatepass")


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW,
    max_span_words: int = 0, max_coverage: float = 0.5, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``docs`` (all columns) with cleaned texts: runs of hit words longer than
    ``max_span_words`` are cut out, until none is left; documents of which more than
    ``max_coverage`` of the words are hit go altogether. Texts without hits stay as they are;
    an integer or long column ``n_chars`` follows the text."""
    blocks = Blocks(benchmark, item_col, item_text_col, window, block_bytes)
    if len(blocks) == 1:
        return _clean(docs, blocks.automaton(0), text_col, max_span_words, max_coverage)
    return _clean_by_blocks(docs, blocks, text_col, max_span_words, max_coverage)


def _clean(docs: DataFrame, automaton, text_col: str, max_span_words: int, max_coverage: float) -> DataFrame:
    def fixed(text: str | None) -> tuple[bool, str | None]:
        words = words_of(text)
        spans, _ = automaton.value.spans(words)
        if sum(e - s for s, e in spans) > max_coverage * len(words):
            return False, text
        while cut := [x for x in spans if x[1] - x[0] > max_span_words]:
            text = cut_spans(text, cut)
            spans, _ = automaton.value.spans(words_of(text))
        return True, text

    clean = _free(docs, "__clean")
    return _changed(docs.withColumn(clean, _fixer(fixed)(F.col(f"`{text_col}`").cast("string"))), docs, text_col, clean)


def _free(docs: DataFrame, name: str) -> str:
    """A column name that the table does not have."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _changed(marked: DataFrame, docs: DataFrame, text_col: str, clean: str) -> DataFrame:
    """``docs`` as the column ``clean`` (kept, text) tells."""
    kept, text = marked.filter(F.col(clean)["kept"]), F.col(clean)["text"]
    changes = {c: F.col(f"`{c}`") for c in docs.columns}
    changes[text_col] = text
    if dict(docs.dtypes).get("n_chars") in ("int", "bigint"):
        changed = ~text.eqNullSafe(F.col(f"`{text_col}`"))
        kind = dict(docs.dtypes)["n_chars"]
        changes["n_chars"] = F.when(changed, F.length(text).cast(kind)).otherwise(F.col("n_chars"))
    return kept.select(*[col.alias(c) for c, col in changes.items()])


def _clean_by_blocks(docs: DataFrame, blocks: Blocks, text_col: str, max_span_words: int, max_coverage: float) -> DataFrame:
    """The spans of all blocks are taken on one text and united; coverage is judged once, on the
    input. Texts with hits are cut and tried again on all blocks until none finds a hit."""

    @F.arrow_udf("kept boolean, text string")
    def cut(texts: pa.Array, spans: pa.Array, judged: pa.Array) -> pa.Array:
        kept, changed = [], []
        for text, found, judge in zip(texts, spans, judged):
            text, runs = text.as_py(), [(x["first"], x["after"]) for x in found.as_py() or ()]
            go = judge.as_py() and sum(e - s for s, e in runs) > max_coverage * len(words_of(text))
            long = [] if go else [x for x in runs if x[1] - x[0] > max_span_words]
            kept.append(not go)
            changed.append(cut_spans(text, long) if long else text)
        return _kept(kept, changed)

    def hit(texts: DataFrame) -> DataFrame:
        """copy and the united spans of the texts in which a block finds any."""
        only = texts.select(F.lit(None).cast("long").alias("doc_id"), "text")
        found = blocks.united(
            lambda automaton: _scan(only, automaton).filter("size(spans) > 0").select("copy", "spans").distinct()
        )
        return found.groupBy("copy").agg(F.collect_set("spans").alias("all_spans")).select("copy", F.expr(_UNITED).alias("spans"))

    digest = F.sha2(F.col("text").cast("binary"), 256)
    texts = docs.select(F.col(f"`{text_col}`").cast("string").alias("text")).filter("text IS NOT NULL")
    spans = materialise(hit(texts), "leaks")
    fixed = materialise(
        texts.withColumn("copy", digest).join(spans, "copy").dropDuplicates(["copy"])
        .select("copy", cut("text", "spans", F.lit(True)).alias("__clean")),
        "leaks-cut",
    )
    done = fixed.filter("NOT __clean.kept")
    now = fixed.filter("__clean.kept").select("copy", F.col("__clean.text").alias("text"))
    while True:
        again = hit(now.select("text")).withColumnRenamed("copy", "now")
        again = materialise(again.filter(f"exists(spans, x -> x.after - x.first > {max_span_words})"), "leaks")
        if again.isEmpty():
            break
        rest = now.withColumn("now", digest).join(again, "now", "left")
        shorter = F.when(F.col("spans").isNotNull(), cut("text", "spans", F.lit(False))["text"]).otherwise(F.col("text"))
        now = materialise(rest.select("copy", shorter.alias("text")), "leaks-cut")
    done = done.unionByName(now.select("copy", F.struct(F.lit(True).alias("kept"), "text").alias("__clean")))
    clean, copy = _free(docs, "__clean"), _free(docs, "__copy")
    marked = docs.withColumn(copy, F.sha2(F.col(f"`{text_col}`").cast("string").cast("binary"), 256)).join(
        done.select(F.col("copy").alias(copy), F.col("__clean").alias(clean)), copy, "left"
    )
    same = F.struct(F.lit(True).alias("kept"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return _changed(marked.withColumn(clean, F.coalesce(clean, same)), docs, text_col, clean)


def _fixer(fixed):
    @F.arrow_udf("kept boolean, text string")
    def clean(texts: pa.Array) -> pa.Array:
        kept, changed = [], []
        for text in texts:
            stays, new = fixed(text.as_py())
            kept.append(stays)
            changed.append(new)
        return _kept(kept, changed)

    # Otherwise the filter on ``kept`` gets a call of its own and each text is searched twice.
    return clean.asNondeterministic()


def _kept(kept: list[bool], texts: list[str | None]) -> pa.Array:
    return pa.StructArray.from_arrays([pa.array(kept, pa.bool_()), pa.array(texts, pa.string())], ["kept", "text"])
