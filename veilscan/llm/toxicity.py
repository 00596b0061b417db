"""Toxicity as an ordinal severity, by cumulative-link regression on sparse text features.

P(grade <= k) = sigmoid(threshold_k - w.x): one weight vector for all grades, ordered
thresholds. x holds, as 0/1, which of the chosen words and word beginnings a text contains;
beginnings catch inflected insults. A text's expected severity is the sum over k of
P(grade > k).

Only the fit uses a sample: at most ``MAX_LABELLED`` labelled rows, those with the smallest
hash of their id. Features are counted in Spark over that sample, the ``FEATURES`` most telling
ones reach the driver together with the sample's rows over them, both bounded by the two
parameters. Every document is scored on its whole text.

Where labels only say toxic or not, grades are 0 for clean rows and, for toxic ones, 1 or 2 by
whether the share of their words that carry telling features is below or above the median of
the toxic rows.

Defined cases: a null or empty text has no features and gets the severity of the thresholds
alone; labels that are null, have a null id or no document are ignored; without any labelled
toxic (or any clean) row nothing can be learnt and every severity is 0; a document labelled
several times takes its highest label; repeated documents are scored each; further columns play
no part.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from veilscan.llm.decontaminate import words_of
from veilscan.llm.inputs import id_and_text

MAX_LABELLED = 6_000
FEATURES = 2_000
LEAST_TOXIC_ROWS = 3
BEGINNINGS = range(3, 9)
SEVERE_FROM = 0.5
REMEMBERED = 100_000


def features_of(word: bytes) -> list[bytes]:
    """The whole word (marked by a space) and its beginnings."""
    return [word + b" ", *(word[:n] for n in BEGINNINGS if len(word) >= n)]


def word_set(text: str | None) -> set[bytes]:
    return set(words_of((text or "").lower()))


@dataclass
class OrdinalModel:
    """Weights by feature and the thresholds between grades."""

    index: dict[bytes, int]
    weights: np.ndarray
    thresholds: np.ndarray

    def severity(self, active: np.ndarray) -> tuple[float, int]:
        """Expected grade and most likely grade of a text with these features."""
        if not len(self.thresholds):
            return 0.0, 0
        above = 1 / (1 + np.exp(self.thresholds - self.weights[active].sum()))
        steps = np.concatenate(([1.0], above)) - np.concatenate((above, [0.0]))
        return float(above.sum()), int(steps.argmax())


def labelled_sample(labels: DataFrame, grade_col: str, id_col: str = "doc_id", max_rows: int = MAX_LABELLED) -> DataFrame:
    rows = labels.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{grade_col}`").cast("int").alias("grade"))
    known = rows.filter("doc_id IS NOT NULL AND grade IS NOT NULL").groupBy("doc_id").agg(F.max("grade").alias("grade"))
    return known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)


def telling_features(sample: DataFrame, features: int = FEATURES) -> list[bytes]:
    """Features that occur far more often in rows of grade 1 and above."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seen = {True: Counter(), False: Counter()}
            for text, grade in zip(batch["text"], batch["grade"]):
                seen[grade > 0].update({f for w in word_set(text) for f in features_of(w)})
            every = list(seen[True] | seen[False])
            yield pd.DataFrame({
                "feature": every, "bad": [seen[True][f] for f in every], "good": [seen[False][f] for f in every],
            })

    totals = sample.agg(F.sum(F.expr("int(grade > 0)")), F.count("*")).first()
    bad, all_rows = totals[0] or 0, totals[1]
    if not bad or bad == all_rows:
        return []
    counts = sample.mapInPandas(count, "feature binary, bad long, good long").groupBy("feature").agg(
        F.sum("bad").alias("bad"), F.sum("good").alias("good")
    )
    odds = F.log((F.col("bad") + 0.5) / (bad + 1)) - F.log((F.col("good") + 0.5) / (all_rows - bad + 1))
    chosen = (
        counts.filter(F.col("bad") >= LEAST_TOXIC_ROWS).withColumn("score", odds * F.sqrt("bad"))
        .filter("score > 0").orderBy(F.desc("score"), "feature").limit(features)
    )
    return [bytes(r.feature) for r in chosen.select("feature").collect()]


def _activate(index: dict[bytes, int]):
    """Features of a text, with a memory of words."""
    memory: dict[bytes, tuple[int, ...]] = {}

    def of(text: str | None) -> tuple[np.ndarray, int, int]:
        active: set[int] = set()
        words = word_set(text)
        carrying = 0
        for word in words:
            mine = memory.get(word)
            if mine is None:
                if len(memory) >= REMEMBERED:
                    memory.clear()
                mine = memory[word] = tuple(index[f] for f in features_of(word) if f in index)
            if mine:
                carrying += 1
                active.update(mine)
        return np.array(sorted(active), dtype=np.int64), carrying, len(words)

    return of


def fit_ordinal(rows: list[np.ndarray], grades: np.ndarray, size: int, ridge: float = 0.02, steps: int = 500) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds by gradient steps (Adam) on the penalised mean log-likelihood."""
    levels = int(grades.max())
    where = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    which = np.concatenate(rows) if len(where) else np.array([], dtype=np.int64)
    shares = [max((grades > k).mean(), 1e-6) for k in range(levels)]
    first = np.log(1 / shares[0] - 1)
    gaps = np.log(np.maximum(np.diff([np.log(1 / s - 1) for s in shares]), 1e-2))
    params = np.concatenate((np.zeros(size), [first], gaps))
    mean, square = np.zeros_like(params), np.zeros_like(params)
    for step in range(1, steps + 1):
        weights, thresholds = params[:size], np.cumsum(np.concatenate(([params[size]], np.exp(params[size + 1 :]))))
        score = np.bincount(where, weights[which], len(rows))
        below = 1 / (1 + np.exp(score[:, None] - thresholds[None, :]))
        padded = np.concatenate((np.zeros((len(rows), 1)), below, np.ones((len(rows), 1))), axis=1)
        slopes = padded * (1 - padded)
        at = np.arange(len(rows))
        chance = np.maximum(padded[at, grades + 1] - padded[at, grades], 1e-9)
        by_score = (slopes[at, grades + 1] - slopes[at, grades]) / chance / len(rows)
        by_threshold = np.zeros_like(below)
        for k in range(levels):
            up, down = grades == k, grades == k + 1
            by_threshold[up, k] = -slopes[up, k + 1] / chance[up]
            by_threshold[down, k] = slopes[down, k + 1] / chance[down]
        t = by_threshold.sum(axis=0) / len(rows)
        tails = np.cumsum(t[::-1])[::-1]
        slope = np.concatenate((
            np.bincount(which, by_score[where], size) + ridge * weights / len(rows) * 10,
            [tails[0]], tails[1:] * np.exp(params[size + 1 :]),
        ))
        mean, square = 0.9 * mean + 0.1 * slope, 0.999 * square + 0.001 * slope**2
        params = params - 0.05 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-9)
    return params[:size], np.cumsum(np.concatenate(([params[size]], np.exp(params[size + 1 :]))))


def train(
    docs: DataFrame, labels: DataFrame, grade_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text",
    label_id_col: str = "doc_id", max_rows: int = MAX_LABELLED, features: int = FEATURES, split_toxic: bool = True,
) -> OrdinalModel:
    """Fit on a bounded sample. ``split_toxic`` turns 0/1 labels into the grades 0, 1 and 2."""
    sample = id_and_text(docs, id_col, text_col).join(
        F.broadcast(labelled_sample(labels, grade_col, label_id_col, max_rows)), "doc_id"
    )
    index = {f: k for k, f in enumerate(telling_features(sample, features))}
    if not index:
        return OrdinalModel({}, np.zeros(0), np.zeros(0))

    def design(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of = _activate(index)
        for batch in batches:
            found = [of(t) for t in batch["text"]]
            yield pd.DataFrame({
                "grade": batch["grade"], "active": [f[0] for f in found],
                "share": [f[1] / max(1, f[2]) for f in found],
            })

    rows = sample.mapInPandas(design, "grade int, active array<long>, share double").collect()
    rows.sort(key=lambda r: (r.grade, r.share, r.active))
    grades = np.array([r.grade for r in rows], dtype=np.int64)
    if split_toxic:
        grades = np.minimum(grades, 1)
        shares = np.array([r.share for r in rows])
        grades[(grades > 0) & (shares > np.median(shares[grades > 0]))] = 2
    weights, thresholds = fit_ordinal([np.array(r.active, dtype=np.int64) for r in rows], grades, len(index))
    return OrdinalModel(index, weights, thresholds)


def score(docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text", severe_from: float = SEVERE_FROM) -> DataFrame:
    """One row per document: doc_id, expected_severity, grade, toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _activate(shared.value.index)
        for batch in batches:
            found = [shared.value.severity(of(t.as_py())[0]) for t in batch.column("text")]
            severity = np.array([s for s, _ in found], dtype=float)
            columns = [
                batch.column("doc_id"), pa.array(severity), pa.array([g for _, g in found], pa.int32()), pa.array(severity >= severe_from),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "expected_severity", "grade", "toxic"])

    return id_and_text(docs, id_col, text_col).mapInArrow(
        run, "doc_id long, expected_severity double, grade int, toxic boolean"
    )


def reject_toxic(docs: DataFrame, model: OrdinalModel, text_col: str = "text", severe_from: float = SEVERE_FROM) -> DataFrame:
    """The rows of ``docs``, all columns, whose expected severity stays below the bound."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    known: list = []

    @F.arrow_udf("double")
    def severity(texts: pa.Array) -> pa.Array:
        if not known:
            known.append(_activate(shared.value.index))
        return pa.array([shared.value.severity(known[0](t.as_py())[0])[0] for t in texts], pa.float64())

    return docs.filter(severity(F.col(f"`{text_col}`").cast("string")) < severe_from)
