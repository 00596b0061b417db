"""Ranked lexical search, term at a time with a limited number of accumulators.

Documents lie in the partitions of their table; each task ranks its own documents for all queries
and hands on the best ``k`` of each, which are merged. Two passes:

1. *Index.* Each document with words becomes a row of its length and of (term, occurrences) for
   the terms that some query asks for. Corpus counts (documents, terms, documents per term) are
   sums over all of them.
2. *Search.* A task takes its rows in batches of at most ``BATCH_POSTINGS``, turns each batch into
   postings and answers the queries term by term, rarest first. A document that first appears at
   some term can reach no more than the sum of the largest contributions of that term and those
   after it. Once that sum is below the k-th best partial score (of this batch, or of what the
   task has finished), no accumulator is created any more; those that exist are updated exactly
   to the end. A document left out so scores less than k others, ties included.

What a task holds is one batch, one accumulator per document of it, and k results per query.
Queries with equal text are one. Their terms are broadcast; beyond ``block_bytes`` of query text,
queries are dealt into blocks of about that size, each with passes of its own, whose tables are
deleted when its results are written.

Terms are the maximal matches of ``[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+``, A-Z lower-cased.
Defined cases: a null or empty text has no terms, is not counted and never found; a query without
terms, or whose terms occur nowhere, has no results; repeated documents are each ranked, queries
that share an id each have their own ranks; null document ids come first among equal scores;
empty tables give no results; further columns play no part.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from veilscan.llm.inputs import id_and_text
from veilscan.session import discard, materialise

K = 10
BLOCK_BYTES = 4 << 20
BATCH_POSTINGS = 1 << 21
SCALE = 1_000_000_000

_KEPT = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_KEPT).split(b" ")


def _counts(text: str | None) -> Counter[bytes]:
    found = Counter(terms_of(text))
    found.pop(b"", None)
    return found


# The index: one row per document that has terms.

_INDEX = "doc_id long, n long, terms array<int>, times array<int>"


def _indexed(docs: DataFrame, vocabulary) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = vocabulary.value
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                keep, sizes, ends, terms, times = [], [], [0], [], []
                for k, text in enumerate(batch.column("text")):
                    found = _counts(text.as_py())
                    if not found:
                        continue
                    keep.append(k)
                    sizes.append(found.total())
                    for term in found.keys() & number.keys():
                        terms.append(number[term])
                        times.append(found[term])
                    ends.append(len(terms))
                lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(v, pa.int32())) for v in (terms, times)]
                ids = batch.column("doc_id").take(pa.array(keep, pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), *lists], ["doc_id", "n", "terms", "times"])

    return docs.mapInArrow(run, _INDEX)


def _document_counts(index: DataFrame, terms: int) -> np.ndarray:
    """In how many documents each term occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(terms, dtype=np.int64)
        for batch in batches:
            total += np.bincount(batch.column("terms").flatten().to_numpy(), minlength=terms)
        used = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], ["term", "n"])

    found = index.select("terms").mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(terms, dtype=np.int64)
    counts[found.column("term").to_numpy()] = found.column("n").to_numpy()
    return counts


@dataclass(frozen=True)
class Queries:
    """Queries as term numbers, rarest first, with weight times repeats; and the corpus counts."""

    names: list[str]
    terms: list[np.ndarray]
    weights: list[np.ndarray]
    documents: int
    occurrences: int

    @classmethod
    def of(cls, texts: list[Counter[int]], names: list[str], counts: np.ndarray, documents: int, occurrences: int) -> Queries:
        terms, weights = [], []
        for text in texts:
            own = sorted((t for t in text if counts[t]), key=lambda t: (counts[t], t))
            terms.append(np.array(own, dtype=np.int64))
            weights.append(np.array([text[t] * weight(documents, int(counts[t])) for t in own], dtype=np.int64))
        return cls(names, terms, weights, documents, occurrences)


def weight(documents: int, held: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * held + 1)))


def _damping(sizes: np.ndarray, queries: Queries) -> np.ndarray:
    if int(sizes.max()) * queries.documents * 75 < 1 << 63:
        return 25 + (75 * sizes * queries.documents) // queries.occurrences
    return np.array([25 + 75 * n * queries.documents // queries.occurrences for n in sizes.tolist()], dtype=np.int64)


class Best:
    """The k best of one query so far: scores with document ids (null ids as None)."""

    def __init__(self, k: int) -> None:
        self.k, self.found = k, []

    @property
    def bar(self) -> int:
        """What a document must reach to count."""
        return self.found[-1][0] if len(self.found) == self.k else 0

    def add(self, scores: np.ndarray, ids: list[int | None]) -> None:
        rows = [*self.found, *zip(scores.tolist(), ids)]
        self.found = sorted(rows, key=lambda r: (-r[0], r[1] is not None, r[1] or 0))[: self.k]


class Postings:
    """Documents of one batch by term, each with its contribution per unit of weight."""

    def __init__(self, sizes: np.ndarray, lengths: np.ndarray, terms: np.ndarray, times: np.ndarray, queries: Queries) -> None:
        order = np.argsort(terms, kind="stable")
        owner = np.repeat(np.arange(len(sizes)), lengths)
        self.documents = len(sizes)
        self.owner = owner[order]
        times = times[order].astype(np.int64)
        self.impact = (SCALE * times) // (1000 * times + 8 * _damping(sizes, queries)[self.owner])
        self.first = np.searchsorted(terms[order], np.arange(int(terms.max(initial=0)) + 2))
        held = np.diff(self.first) > 0
        self.most = np.zeros(len(held), dtype=np.int64)
        if len(terms):
            self.most[held] = np.maximum.reduceat(self.impact, self.first[:-1][held])

    def of(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        span = slice(self.first[term], self.first[term + 1])
        return self.owner[span], self.impact[span]

    def answer(self, terms: np.ndarray, weights: np.ndarray, best: Best, sums: np.ndarray) -> np.ndarray:
        """Adds up one query in ``sums`` (zeros at first) and returns the documents with an
        accumulator, in order."""
        here = np.nonzero(terms < len(self.most))[0]
        here = here[(self.most[terms[here]] > 0) & (weights[here] > 0)]
        bounds = weights[here] * self.most[terms[here]]
        left = np.cumsum(bounds[::-1])[::-1]
        live, survivors = np.zeros(self.documents, dtype=bool), None
        created = 0
        for k, at in enumerate(here.tolist()):
            owner, impact = self.of(terms[at])
            if survivors is None:
                bar = best.bar
                if created >= best.k:
                    alive = sums[live]
                    bar = max(bar, int(np.partition(alive, len(alive) - best.k)[len(alive) - best.k]))
                if left[k] < bar:
                    survivors = np.nonzero(live)[0]
                    if not len(survivors):
                        return survivors
            if survivors is None:
                sums[owner] += weights[at] * impact
                live[owner] = True
                created = int(np.count_nonzero(live))
            elif len(survivors) * 8 < len(owner):
                place = np.minimum(np.searchsorted(owner, survivors), len(owner) - 1)
                held = owner[place] == survivors
                sums[survivors[held]] += weights[at] * impact[place[held]]
            else:
                held = live[owner]
                sums[owner[held]] += weights[at] * impact[held]
        return np.nonzero(live)[0] if survivors is None else survivors


_RESULTS = "query string, doc_id long, score long"


def _searched(index: DataFrame, queries, k: int, batch_postings: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: Queries = queries.value
        best = [Best(k) for _ in asked.names]
        held: list[pa.RecordBatch] = []
        size = 0

        def answer() -> None:
            table = pa.Table.from_batches(held).combine_chunks()
            lists = table.column("terms").combine_chunks()
            lengths = np.diff(lists.offsets.to_numpy())
            postings = Postings(
                table.column("n").to_numpy(), lengths, lists.flatten().to_numpy(),
                table.column("times").combine_chunks().flatten().to_numpy(), asked,
            )
            ids, sums = table.column("doc_id"), np.zeros(len(lengths), dtype=np.int64)
            for terms, weights, top in zip(asked.terms, asked.weights, best):
                found = postings.answer(terms, weights, top, sums)
                scores = sums[found]
                sums[found] = 0
                at_least = max(1, top.bar)
                if len(scores) > k:
                    at_least = max(at_least, int(np.partition(scores, len(scores) - k)[len(scores) - k]))
                good = np.nonzero(scores >= at_least)[0]
                if len(good):
                    top.add(scores[good], ids.take(pa.array(found[good])).to_pylist())

        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                part = whole.slice(at, 1024)
                held.append(part)
                size += len(part.column("terms").flatten()) + part.num_rows
                if size >= batch_postings:
                    answer()
                    held, size = [], 0
        if held:
            answer()
        rows = [(name, doc_id, score) for name, top in zip(asked.names, best) for score, doc_id in top.found]
        names, ids, scores = zip(*rows) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array(ids, pa.int64()), pa.array(scores, pa.int64())], ["query", "doc_id", "score"]
        )

    return index.mapInArrow(run, _RESULTS)


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(
    docs: DataFrame, queries: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", k: int = K, block_bytes: int = BLOCK_BYTES, batch_postings: int = BATCH_POSTINGS,
) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` best documents of each query with a score above 0."""
    spark = docs.sparkSession
    rows = id_and_text(docs, id_col, text_col)
    asked = id_and_text(queries, item_col, item_text_col).select(
        F.col("doc_id").alias("item_id"), "text", F.sha2(F.col("text").cast("binary"), 256).alias("query")
    )
    distinct = materialise(asked.groupBy("query").agg(F.first("text").alias("text")), "search-queries")
    blocks = max(1, -(-(distinct.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // block_bytes))
    found = None
    for block in range(blocks):
        mine = distinct.filter(F.pmod(F.xxhash64("query"), F.lit(blocks)) == block).collect()
        one = _search_block(spark, rows, [(r.query, r.text) for r in mine], k, batch_postings)
        found = one if found is None else found.unionByName(one)
    return asked.select("item_id", "query").join(found, "query").select(
        "item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"
    )


def _search_block(spark: SparkSession, rows: DataFrame, asked: list[tuple[str, str]], k: int, batch_postings: int) -> DataFrame:
    counted = [(name, _counts(text)) for name, text in asked]
    number = {term: at for at, term in enumerate(sorted({t for _, c in counted for t in c}))}
    vocabulary = spark.sparkContext.broadcast(number)
    index = materialise(_indexed(rows, vocabulary), "search-index")
    totals = index.agg(F.count("*"), F.sum("n")).first()
    counts = _document_counts(index, len(number)) if number else np.zeros(0, dtype=np.int64)
    texts = [Counter({number[t]: n for t, n in c.items()}) for _, c in counted]
    queries = spark.sparkContext.broadcast(Queries.of(texts, [n for n, _ in asked], counts, totals[0], totals[1] or 0))
    found = materialise(_best(_searched(index, queries, k, batch_postings), k), "search-results")
    for used in (vocabulary, queries):
        used.destroy()
    discard(index)
    return found


# The scores in SQL, for the query as registered.
SQL = """
WITH terms AS (
  SELECT rowid AS d, doc_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS term
  FROM (SELECT row_number() OVER () AS rowid, doc_id, text FROM documents)
), sizes AS (SELECT d, any_value(doc_id) AS doc_id, count(*) AS n FROM terms GROUP BY d),
corpus AS (SELECT count(*) AS documents, sum(n)::BIGINT AS occurrences FROM sizes),
items AS (
  SELECT rowid AS q, item_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS term
  FROM (SELECT row_number() OVER () AS rowid, item_id, text FROM benchmark)
), asked AS (SELECT q, any_value(item_id) AS item_id, term, count(*) AS repeats FROM items GROUP BY q, term),
postings AS (SELECT d, term, count(*) AS tf FROM terms WHERE term IN (SELECT term FROM asked) GROUP BY d, term),
weights AS (
  SELECT term, floor(1000 * ln((2 * any_value(documents) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
  FROM postings, corpus GROUP BY term
), scores AS (
  SELECT q, any_value(item_id) AS item_id, d, any_value(s.doc_id) AS doc_id,
    sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * documents) // occurrences))))::BIGINT AS score
  FROM asked JOIN postings USING (term) JOIN weights USING (term) JOIN sizes s USING (d), corpus GROUP BY q, d
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0
) WHERE rank <= 10
"""
