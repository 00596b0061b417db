"""Ranked search against scores of every document, and the limit on accumulators at work."""

import collections
import math
import random
import re

import numpy as np
import pytest

from veilscan.llm import lexical_search as S

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def terms(text):
    return [t.translate(LOWER) for t in re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", text or "")]


def brute(docs, queries, k=10):
    bags = [(i, collections.Counter(terms(t))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    n_docs, total = len(bags), sum(sum(b.values()) for _, b in bags)
    held = collections.Counter(t for _, b in bags for t in b)
    rows = []
    for item, text in queries:
        own, scores = collections.Counter(terms(text)), []
        for doc_id, bag in bags:
            m = 100 - 75 + (75 * sum(bag.values()) * n_docs) // total
            score = sum(
                r * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * held[t] + 1))) * ((1000000000 * bag[t]) // (1000 * bag[t] + 8 * m))
                for t, r in own.items() if t in bag
            )
            if score > 0:
                scores.append((-score, doc_id is not None, doc_id or 0, doc_id))
        rows += [(item, rank, s[3], -s[0]) for rank, s in enumerate(sorted(scores)[:k], 1)]
    return rows


def key(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((x is None, x) for x in r))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    vocabulary = [f"{rng.choice('abcdé')}{k}" for k in range(300)]
    draw = lambda: vocabulary[min(299, int(rng.paretovariate(0.7)) - 1)]
    docs = [(k, " ".join(draw() for _ in range(rng.randrange(1, 60)))) for k in range(700)]
    docs += [(800 + k, docs[5][1]) for k in range(40)] + [docs[6], docs[6], (900, None), (901, ""), (902, " .,\n")]
    docs += [(None, docs[7][1]), (None, docs[7][1].upper()), (903, "a0 " * 50_000 + "Üb"), (904, "UNIQUE üb")]
    queries = [(k, " ".join(draw() for _ in range(rng.randrange(1, 25)))) for k in range(60)]
    queries += [(100, docs[5][1]), (101, docs[5][1]), (101, docs[6][1]), (102, None), (103, ""), (104, "nowhere else"), (105, "unique Unique a0")]
    queries += [(None, docs[7][1])]
    return docs, queries


@pytest.fixture(scope="module")
def tables(spark, corpus):
    docs, queries = corpus
    documents = spark.createDataFrame([(i, t, "q", 1, [1], 0) for i, t in docs], "doc_id long, text string, query string, n int, terms array<int>, rank int")
    return documents.repartition(4), spark.createDataFrame([(i, t, 5) for i, t in queries], "item_id long, text string, doc_id int")


@pytest.mark.parametrize("batch,block", [(S.BATCH_POSTINGS, S.BLOCK_BYTES), (500, 2_000), (60, S.BLOCK_BYTES)])
def test_equals_scores_of_all(corpus, tables, batch, block):
    found = S.search(*tables, batch_postings=batch, block_bytes=block).select("item_id", "rank", "doc_id", "score")
    assert key(found.collect()) == key(brute(*corpus))


def test_accumulators_are_limited(corpus):
    """Common terms create no accumulators, yet the ones there are end with whole scores."""
    docs, queries = corpus
    bags = [collections.Counter(terms(t)) for _, t in docs if terms(t)]
    number = {t: k for k, t in enumerate(sorted({t for b in bags for t in b}))}
    counts = np.zeros(len(number), dtype=np.int64)
    for bag in bags:
        for t in bag:
            counts[number[t]] += 1
    texts = [collections.Counter({number[t]: n for t, n in collections.Counter(terms(q)).items() if t in number}) for _, q in queries]
    asked = S.Queries.of(texts, ["q"] * len(texts), counts, len(bags), sum(sum(b.values()) for b in bags))
    flat = [(number[t], n) for b in bags for t, n in b.items()]
    postings = S.Postings(
        np.array([sum(b.values()) for b in bags]), np.array([len(b) for b in bags]),
        np.array([t for t, _ in flat]), np.array([n for _, n in flat]), asked,
    )
    created = possible = 0
    for own, weights in zip(asked.terms, asked.weights):
        sums, whole = np.zeros(len(bags), dtype=np.int64), np.zeros(len(bags), dtype=np.int64)
        found = postings.answer(own, weights, S.Best(10), sums)
        for t, w in zip(own, weights):
            owner, impact = postings.of(t)
            whole[owner] += w * impact
        assert (sums[found] == whole[found]).all()
        assert sorted(whole[found])[-10:] == sorted(whole[whole > 0])[-10:]
        created, possible = created + len(found), possible + int((whole > 0).sum())
    assert created < 0.8 * possible


def test_empty_tables(spark, tables):
    documents, queries = tables
    assert S.search(documents.limit(0), queries).collect() == []
    assert S.search(documents, queries.limit(0)).collect() == []
