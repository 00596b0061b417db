"""The corpus pipeline, stage by stage, with planted cases."""

import hashlib
import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from veilscan.llm.decontaminate import words_of
from veilscan.session import materialise

SF = "/root/testdata/sf0.01"
STAGES = dict(corpus_pipeline.STAGES)
INSULTS = "idiot moron scum clown worthless pathetic loser trash stupid disgusting".split()


@pytest.fixture(scope="module")
def planted(spark):
    """The documents, and copies, leaks and insults under ids from 100,000 on."""
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    rng = random.Random(9)
    base = [r for r in documents.filter("lang = 'en' AND n_chars BETWEEN 900 AND 4000").orderBy("doc_id").collect()][40:80]
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    rows = []
    for k, r in enumerate(base[:10]):
        rows.append((100_000 + k, r.text, r.lang, r.source, r.n_chars))
        words = r.text.split(" ")
        words[len(words) // 2] = "replaced"
        rows.append((100_100 + k, " ".join(words), r.lang, r.source, None))
    for k, r in enumerate(base[10:20]):
        words = r.text.split(" ")
        rng.shuffle(words)
        words[len(words) // 2 : len(words) // 2] = item.split(" ")
        rows.append((100_200 + k, " ".join(words), r.lang, r.source, None))
    for k, r in enumerate(base[20:30]):
        words = r.text.split(" ")
        rng.shuffle(words)
        for w in INSULTS:
            words.insert(rng.randrange(len(words)), w)
        rows.append((100_300 + k, " ".join(words), r.lang, r.source, None))
    rows += [(100_400, None, None, None, None), (100_401, "", "en", None, 0), (None, "a row without an id", "en", "s", None)]
    extra = spark.createDataFrame(rows, documents.schema).withColumn(
        "n_chars", F.coalesce("n_chars", F.length("text").cast("long"))
    )
    return materialise(documents.unionByName(extra), "planted"), [r.doc_id for r in base], item


@pytest.fixture(scope="module")
def after(spark, planted):
    docs, out = planted[0], {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        nxt = materialise(stage(spark, docs, SF), name)
        assert nxt.columns == docs.columns and dict(nxt.dtypes) == dict(docs.dtypes)
        out[name] = (docs, nxt)
        docs = nxt
    return out


def ids(frame):
    return {r.doc_id for r in frame.select("doc_id").collect()}


def test_toxic_documents_go(after, spark):
    before, kept = after["toxicity"]
    left = ids(kept)
    assert not left & set(range(100_300, 100_310))
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    clean = {i for i, t in labels.items() if t == 0}
    assert len(clean - left) <= 0.01 * len(clean)
    assert sum(t == 1 and i in left for i, t in labels.items()) <= 0.2 * sum(labels.values())


def test_exact_copies_go(after):
    before, kept = after["exact_dedup"]
    largest = {}
    for r in before.collect():
        key = r.text or ""
        largest[key] = max(largest.get(key, -1), -1 if r.doc_id is None else r.doc_id)
    got = {(r.text or ""): r.doc_id for r in kept.collect()}
    assert {t: -1 if i is None else i for t, i in got.items()} == largest and kept.count() == len(largest)


def test_near_copies_go_and_others_stay(after, planted):
    before, kept = after["near_dedup"]
    left, was = ids(kept), ids(before)
    for k in range(10):
        exact, near = 100_000 + k, 100_100 + k
        assert not (exact in left and near in left)
    gone = before.filter("doc_id IS NOT NULL").join(kept.select("doc_id"), "doc_id", "left_anti").collect()
    texts = [r.text or "" for r in before.collect()]

    def shingles(text):
        w = text.lower().split()
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}

    sets = [shingles(t) for t in texts]
    for r in gone:  # whatever goes has a close relative
        own = shingles(r.text or "")
        near = sorted((len(own & s) / max(1, len(own | s)) for t, s in zip(texts, sets) if t != r.text), reverse=True)
        assert near[0] >= 0.6
    assert len(left) >= 0.85 * len(was)


def test_leaks_are_cut_out(after, planted):
    before, kept = after["decontamination"]
    window = words_of(planted[2])
    rows = {r.doc_id: r for r in kept.collect()}
    old = {r.doc_id: r.text for r in before.collect()}
    for k in range(100_200, 100_210):
        if k in rows:
            words = words_of(rows[k].text)
            assert not any(words[j : j + 10] == window[m : m + 10] for j in range(len(words)) for m in range(len(window) - 9))
            assert len(words) >= 0.5 * len(words_of(old[k])) and rows[k].n_chars == len(rows[k].text)
    assert any(k in rows for k in range(100_200, 100_210))
    assert sum(old[i] == r.text for i, r in rows.items()) >= 0.9 * len(old)


def test_tokens_are_the_library_s(after, spark):
    docs = after["decontamination"][1]
    got = {r.doc_id: r for r in STAGES["bpe"](spark, docs, SF).collect()}
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = docs.collect()
    assert len(rows) == len(got)
    for r in rows[::7]:
        own = library.encode(r.text or "", add_special_tokens=False).ids
        assert got[r.doc_id].n_tokens == len(own)
        assert got[r.doc_id].ids_sha256 == hashlib.sha256(" ".join(map(str, own)).encode()).hexdigest()


def test_run_equals_the_stages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, "/root/testdata/sf0.001"), "stage")
    whole = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, docs.collect()))
