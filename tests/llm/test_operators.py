"""The corpus operators against brute force, on awkward rows."""

import base64
import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from veilscan.llm import (
    bpe, components, decontaminate, exact_dedup, files, similar, simhash, token_count, token_files, toxicity, warc,
)

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
# Further columns under names that the operators use themselves.
SCHEMA = (
    "doc_id long, text string, digest string, salt int, fp long, key int, spans string, row long, n_tokens int, "
    "component_id string, n_chars long, copy string"
)


def awkward(rows):
    return [(i, t, "d", 1, 2, 3, "s", 4, 5, "c", None if t is None else len(t), None) for i, t in rows]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 9))) for _ in range(150)]
    rows = []
    for k in range(160):
        text = " ".join(rng.choice(words) for _ in range(rng.randrange(60)))
        rows.append((k * 3, text.capitalize() + rng.choice([".", "", "!\n", " 'tis <|endoftext|>"])))
    base = rows[20][1] + " " + rows[21][1] + " " + rows[22][1]
    rows += [(1000 + k, base) for k in range(6)]
    rows += [(1100 + k, base.replace(base.split()[k + 5], "other", 1)) for k in range(6)]
    rows += [(2000, None), (2001, ""), (2002, " \t\n"), (None, "orphan text"), (None, None), (None, rows[3][1])]
    rows += [rows[0], rows[0], (rows[1][0], rows[2][1]), (2003, "x" * 70_000), (2004, "word " * 9_000), (2005, "Ünïcode ẞ ΣΑΣ \x1c² 中文字")]
    return rows


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame(awkward(texts), SCHEMA).repartition(5)


def key(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


def test_exact_dedup(docs, texts, spark):
    groups = collections.defaultdict(list)
    for i, t in texts:
        groups[t or ""].append(i)
    largest = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    got = exact_dedup.mark_duplicates(docs).collect()
    assert key((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == key(
        (i, largest[t or ""], len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in texts
    )
    kept = [(r.doc_id, r.text_sha256) for r in got if r.kept]
    assert len(kept) == len(groups) == len({d for _, d in kept})
    stay = exact_dedup.drop_duplicates_exact(docs)
    assert stay.columns == docs.columns and dict(stay.dtypes) == dict(docs.dtypes)
    rows = stay.collect()
    assert len(rows) == len(groups)
    assert key((r.doc_id, r.text or "") for r in rows) == key((largest[t], t) for t in groups)
    assert all(r.digest == "d" and r.n_tokens == 5 for r in rows)


def test_exact_dedup_when_digests_collide(docs, texts, monkeypatch):
    from pyspark.sql import functions as F

    right = exact_dedup.mark_duplicates(docs).select("doc_id", "keep_id", "group_size").collect()
    monkeypatch.setattr(
        exact_dedup, "_digested",
        lambda d, i, t: exact_dedup.id_and_text(d, i, t).withColumn("digest", F.unhex(F.lpad(F.hex(F.length("text") % 7), 8, "0"))),
    )
    got = exact_dedup.mark_duplicates(docs).select("doc_id", "keep_id", "group_size").collect()
    assert key(map(tuple, got)) == key(map(tuple, right))


def fingerprint(text, words=4):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    found = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not found:
        return 0
    shingles = [" ".join(found[k : k + words]) for k in range(len(found) - words + 1)] or [" ".join(found)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def joined(n, links):
    up = list(range(n))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return [root(k) for k in range(n)]


def test_simhash(docs, texts):
    prints = [fingerprint(t) for _, t in texts]
    links = [(a, b) for a in range(len(prints)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 4]
    roots = joined(len(prints), links)
    least = {}
    for (i, _), r in zip(texts, roots):
        if i is not None:
            least[r] = min(least.get(r, i), i)
    got = simhash.near_duplicates(docs).collect()
    assert key((r.doc_id, r.fingerprint, r.component_id) for r in got) == key(
        (i, format(p, "016x"), least.get(r)) for (i, _), p, r in zip(texts, prints, roots)
    )


@pytest.mark.parametrize("limit", [4, 1024])
def test_simhash_finds_every_link(spark, monkeypatch, limit):
    """Random fingerprints, many close ones, and anchors cut into pieces."""
    monkeypatch.setattr(simhash, "HOMES_PER_PIECE", limit)
    rng = random.Random(limit)
    centres = [rng.getrandbits(64) for _ in range(40)]
    prints = set()
    for _ in range(900):
        p = rng.choice(centres)
        for _ in range(rng.randrange(9)):
            p ^= 1 << rng.randrange(64)
        prints.add(p)
    prints = sorted(prints)
    signed = np.array(prints, dtype=np.uint64).view(np.int64).tolist()
    links = [(a, b) for a in range(len(prints)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 4]
    frame = spark.createDataFrame([(p,) for p in signed], "fp long")
    edges = simhash.fingerprint_links(frame)
    found = {p: r.label for r in components.component_labels(edges).collect() for p in [r.node]}
    want = collections.defaultdict(set)
    for k, r in enumerate(joined(len(prints), links)):
        want[r].add(signed[k])
    assert {frozenset(g) for g in want.values() if len(g) > 1} == {
        frozenset(p for p in found if found[p] == label) for label in set(found.values())
    }


def test_keep_one_per_group(docs, texts, spark):
    marks = simhash.near_duplicates(docs)
    kept = simhash.keep_one_per_group(docs, marks)
    assert kept.columns == docs.columns
    rows = kept.collect()
    want = {r.component_id for r in marks.collect() if r.component_id is not None and r.doc_id == r.component_id}
    assert sorted(r.doc_id for r in rows if r.doc_id is not None) == sorted(want)
    assert sum(r.doc_id is None for r in rows) == sum(i is None for i, _ in texts)


def test_similar_groups(docs):
    got = {(r.doc_id, r.component_id) for r in similar.similar_groups(docs).collect()}
    assert all((k, 1000) in got for k in range(1000, 1006))
    assert all((k, 1000) in got for k in range(1100, 1106))
    assert (0, 0) in got and (3, 3) in got


def test_components_of_long_paths(spark):
    rng = random.Random(3)
    nodes = list(range(1, 400))
    rng.shuffle(nodes)
    pairs = list(zip(nodes[:199], nodes[1:200])) + [(nodes[k], nodes[250]) for k in range(251, 399)] + [(5, 5), (None, 3)]
    frame = spark.createDataFrame(pairs, "a long, b long")
    got = {r.node: r.label for r in components.component_labels(frame).collect()}
    assert all(got[n] == min(nodes[:200]) for n in nodes[:200])
    assert all(got[n] == min(nodes[250:]) for n in nodes[250:])
    assert components.component_labels(frame.limit(0)).count() == 0


BENCH = [
    (1, "one two three four five six seven eight nine ten eleven twelve"), (2, "short item here"), (3, None), (4, "..."),
    (5, "three four five six seven eight nine ten eleven twelve thirteen"), (10, "a b a b a b a b a b a b a b"), (None, "quite another small thing"),
    (2, "short item here"), (11, "a b a b a"), (6, "the very last item of them all is just ten words"),
]
LEAKS = [
    (1, "x ONE two, three four five six seven eight nine ten eleven! y"), (2, "short item"), (3, "a short-item\nhere and Quite another small thing"),
    (4, None), (5, ""), (6, "one two three four five six seven eight nine"), (7, "a b " * 40), (None, "short item here"), (7, "short item here"),
    (8, "zero " + BENCH[0][1] + " thirteen fourteen " + "clean " * 60), (8, "zero " + BENCH[0][1] + " thirteen fourteen " + "clean " * 60),
    (9, "one two three four five six " * 3 + "seven eight nine ten eleven"),
]
W = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def hits(text, bench, window=10):
    low = lambda t: W.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = collections.defaultdict(set)
    for item, body in bench:
        w = low(body)
        for k in range(max(1, len(w) - window + 1)) if w else ():
            windows[tuple(w[k : k + window])].add(item)
    words, hit, found = low(text), set(), set()
    for k in range(len(words)):
        for size in {len(x) for x in windows}:
            if (items := windows.get(tuple(words[k : k + size]))) and k + size <= len(words):
                hit.update(range(k, k + size))
                found |= items
    return len(words), hit, found - {None}


@pytest.mark.parametrize("block", [1 << 20, 60])
def test_decontamination_finds_windows(spark, block):
    docs = spark.createDataFrame(awkward(LEAKS), SCHEMA)
    bench = spark.createDataFrame([(i, t, "x") for i, t in BENCH], "item_id long, text string, doc_id string")
    got = decontaminate.find_overlaps(docs, bench, block_bytes=block).collect()
    want = []
    for i, t in LEAKS:
        n, hit, found = hits(t, BENCH)
        want.append((i, n, len(hit), tuple(sorted(found))))
    assert key((r.doc_id, r.n_words, sum(s.after - s.first for s in r.spans), tuple(r["items"])) for r in got) == key(want)
    assert all(a.after < b.first for r in got for a, b in zip(r.spans, r.spans[1:]))
    none = decontaminate.find_overlaps(docs, bench.limit(0), block_bytes=block).collect()
    assert len(none) == len(LEAKS) and not any(r.spans for r in none)


def test_decontamination_random(spark):
    rng = random.Random(2)
    items = [(k, " ".join(rng.choice("abc") for _ in range(rng.randrange(1, 16)))) for k in range(25)]
    rows = [(k, " ".join(rng.choice("abcd") for _ in range(rng.randrange(40)))) for k in range(120)]
    automaton = decontaminate.Automaton.of([([] if i is None else [i], text) for i, text in items], 6)
    for _, t in rows:
        n, hit, found = hits(t, items, 6)
        spans, got = automaton.spans(decontaminate.words_of(t))
        assert {k for a, b in spans for k in range(a, b)} == hit and got == found


def test_decontamination_cleans(spark):
    docs = spark.createDataFrame(awkward(LEAKS), SCHEMA)
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    clean = decontaminate.decontaminate(docs, bench)
    assert clean.columns == docs.columns
    rows = clean.collect()
    assert all(not hits(r.text, BENCH)[1] for r in rows)
    assert sorted(r.doc_id for r in rows if r.doc_id is not None) == [2, 4, 5, 6, 8, 8, 9]
    assert next(r.text for r in rows if r.doc_id == 8).startswith("zero  fourteen clean")
    assert all(r.n_chars == len(r.text) for r in rows if r.text is not None)
    untouched = {i: t for i, t in LEAKS if i in (2, 4, 5, 6)}
    assert all(r.text == untouched[r.doc_id] for r in rows if r.doc_id in untouched)


def test_bpe_round_trip(docs, texts):
    library = Tokenizer.from_file(WORD_BPE)
    want = []
    for i, t in texts:
        ids = library.encode(t or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        want.append((i, tuple(ids), back))
    got = bpe.decode_documents(bpe.encode_documents(docs, WORD_BPE), WORD_BPE).collect()
    assert key((r.doc_id, tuple(r.ids), r.decoded) for r in got) == key(want)
    digests = bpe.round_trip_digests(docs, WORD_BPE).collect()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert key(map(tuple, digests)) == key((i, len(x), sha(" ".join(map(str, x))), sha(d)) for i, x, d in want)


PIECES = [
    "a", "e", "th", "in", "'", "'s", "'re", "'r", "'ll", "'l", "'v", "re", "ll", " ", "\n", "1", "2", "²", "é", "Σ", "İ", "中", "!", "!!",
    "<|endoftext|>", "<|startoftext|>", "<|", "|>", "\x1c", "\xa0", "　", "ﬁ", "don't", "'m", "ing", "zz", "😀", "‍", "٣", "_", "̸", ">",
]


def test_tokenizers_on_random_strings():
    library, vocabulary, transducer = Tokenizer.from_file(WORD_BPE), bpe.Vocabulary.at(WORD_BPE), token_count.Transducer.at(WORD_BPE)
    rng = random.Random(8)
    for _ in range(3000):
        text = "".join(rng.choice(PIECES) for _ in range(rng.randrange(14)))
        ids = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(vocabulary.encode(text), dtype="<i4").tolist() == ids, repr(text)
        assert transducer.count(text) == len(ids), repr(text)
        maps = [token_count.chunk_map(transducer, text[k : k + 3]) for k in range(0, len(text), 3)]
        while len(maps) > 1:  # any order of composition gives the same
            k = rng.randrange(len(maps) - 1)
            maps[k : k + 2] = [token_count.compose(transducer, maps[k], maps[k + 1])]
        assert not maps or token_count.closed(transducer, maps[0]) == len(ids), repr(text)


def test_long_words_take_the_heap():
    vocabulary, rng = bpe.Vocabulary.at(WORD_BPE), random.Random(4)
    library = Tokenizer.from_file(WORD_BPE)
    for size in (65, 400, 3000):
        word = "".join(rng.choice("abcdeingthor") for _ in range(size))
        assert vocabulary.word(word) == library.encode(word, add_special_tokens=False).ids


@pytest.mark.parametrize("chunk", [64, token_count.CHUNK_CHARS])
def test_token_counts(docs, texts, chunk):
    library = Tokenizer.from_file(WORD_BPE)
    got = token_count.count_tokens(docs, WORD_BPE, chunk_chars=chunk).collect()
    want = [(i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in texts]
    assert key(map(tuple, got)) == key(want)


def test_token_counts_with_few_states(monkeypatch):
    monkeypatch.setattr(token_count, "MAX_STATES", 40)
    monkeypatch.setattr(token_count, "MAX_BETWEEN", 3)
    transducer, library = token_count.Transducer(WORD_BPE), Tokenizer.from_file(WORD_BPE)
    for text in ("the tokens of many words in a row, don't they", "another one's word " * 3):
        assert transducer.count(text) == len(library.encode(text, add_special_tokens=False).ids)


@pytest.mark.parametrize("size", [50_257, 70_000])
def test_token_files(docs, texts, spark, size):
    library = Tokenizer.from_file(BYTE_BPE)
    manifest = token_files.write_token_files(docs, BYTE_BPE, files.shared_folder(spark, "t"), size)
    got = token_files.read_token_files(manifest).collect()
    want = []
    for i, t in texts:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        want.append((i, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
    assert key((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == key(want)
    ordered = sorted(got, key=lambda r: r.start)
    assert [r.start for r in ordered] == np.cumsum([0, *(r.n_tokens for r in ordered)])[:-1].tolist()
    known = [r.doc_id for r in ordered if r.doc_id is not None]
    assert known == sorted(known) and [r.doc_id for r in ordered[:3]] == [None] * 3
    assert {r.width for r in manifest.collect()} == {2 if size <= 65_536 else 4}


def test_token_pieces_are_independent():
    library, rng = Tokenizer.from_file(BYTE_BPE), random.Random(5)
    encoder = token_files.Encoder(BYTE_BPE, "<u4")
    for _ in range(1500):
        text = "".join(rng.choice([*PIECES, "  ", " \n", "\t", " a"]) for _ in range(rng.randrange(14)))
        got = np.frombuffer(encoder.encode(text), dtype="<u4").tolist()
        assert got == library.encode(text, add_special_tokens=False).ids, repr(text)


PAGES = [(5, "http://a/x", "<p>é</p>"), (2, "http://b/\r\nInjected: 1", "<p>é</p>"), (9, None, "<p>é</p>"), (1, "u", None), (3, "u", ""), (4, "u", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n"),
         (7, "u", "\r\n\r\n" * 40), (8, "u", "z" * 300_000), (None, "u", "<p>é</p>"), (2, "again", "<p>é</p>"), (6, "u", "\x1f\x8bgz")]


@pytest.mark.parametrize("least", [0, 5])
def test_warc(spark, least):
    pages = spark.createDataFrame([(*p, "x", "y") for p in PAGES], "page_id long, url string, html string, digest string, payload string")
    whole, single = files.shared_folder(spark, "w"), files.shared_folder(spark, "n")
    warc.write_archives(warc.page_records(pages.repartition(3), least_revisit=least), f"{whole}/a", per_archive=2)
    archives = warc.normalise(spark, f"{whole}/a", single)
    got = warc.read_archives(archives).collect()
    groups = collections.defaultdict(list)
    for p, _, h in PAGES:
        groups[h or ""].append(p)
    want = []
    for p, _, h in PAGES:
        raw, first = (h or "").encode(), min(x for x in groups[h or ""] if x is not None)
        own = p == first or len(raw) < least
        sha = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        want.append((p, len(raw), sha, "response" if own else "revisit", None if own else first))
    assert key(tuple(r)[:5] for r in got) == key(want)
    for row in archives.collect():
        raw = bytes(files.reader(row.archive).read())
        lines = bytes(files.reader(row.sidecar).read()).decode().splitlines()
        at = 0
        for line in lines:
            offset, length = map(int, line.split()[:2])
            assert offset == at
            member = zlib.decompressobj(31)
            assert member.decompress(raw[offset : offset + length]).startswith(b"WARC/1.1\r\n") and member.eof
            assert not member.unused_data
            at += length
        assert at == len(raw) == row.bytes and len(lines) == row.records


def test_toxicity_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    train, held = labels.filter("doc_id % 4 <> 0"), labels.filter("doc_id % 4 = 0")
    model = toxicity.train(docs, train)
    assert np.all(np.diff(model.thresholds) > 0) and len(model.index) <= toxicity.FEATURES
    rows = toxicity.score(docs.join(held.select("doc_id", "toxic").withColumnRenamed("toxic", "label"), "doc_id"), model)
    judged = rows.join(held.select("doc_id", "toxic").withColumnRenamed("toxic", "label"), "doc_id").collect()
    bad, good = [r for r in judged if r.label == 1], [r for r in judged if r.label == 0]
    assert sum(r.toxic for r in bad) >= 0.85 * len(bad)
    assert sum(r.toxic for r in good) <= 0.005 * len(good)
    assert all(0 <= r.expected_severity <= 2 and 0 <= r.grade <= 2 for r in judged)


def test_toxicity_awkward_rows(spark, docs, texts):
    labels = spark.createDataFrame([(0, 1), (3, 0), (None, 1), (6, None), (77777, 1), (0, 0)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    assert toxicity.score(docs, model).count() == len(texts)
    empty = toxicity.train(docs, labels.limit(0))
    kept = toxicity.reject_toxic(docs, empty)
    assert kept.columns == docs.columns and kept.count() == len(texts)
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    assert exact_dedup.mark_duplicates(none).count() == 0 and exact_dedup.drop_duplicates_exact(none).count() == 0
    assert simhash.near_duplicates(none).count() == 0 and similar.similar_groups(none).count() == 0
    assert bpe.round_trip_digests(none, WORD_BPE).count() == 0
    assert token_count.count_tokens(none, WORD_BPE).count() == 0
    manifest = token_files.write_token_files(none, BYTE_BPE, files.shared_folder(spark, "t"), 50_257)
    assert manifest.count() == 0 and token_files.read_token_files(manifest).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    whole, single = files.shared_folder(spark, "w"), files.shared_folder(spark, "n")
    warc.write_archives(warc.page_records(pages), f"{whole}/a")
    assert warc.read_archives(warc.normalise(spark, f"{whole}/a", single)).count() == 0
