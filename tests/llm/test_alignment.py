"""Token alignment against both libraries on whole texts, and the laws of fragments."""

import collections
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from veilscan.llm import alignment as A
from veilscan.llm.bpe import byte_letters

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    first = Tokenizer.from_file(PATHS[0])
    first.encode_special_tokens = True
    return first, sentencepiece.SentencePieceProcessor(model_file=PATHS[1])


def spelled(libraries, text):
    """Tokens of both with byte ranges, or None, by the libraries on the whole text."""
    first, second = libraries
    letters = {c: b for b, c in enumerate(byte_letters())}
    names = {n: t for t, n in first.get_vocab().items()}
    out = []
    a = [(n, bytes(letters[c] for c in names[n])) for n in first.encode(" " + text, add_special_tokens=False).ids]
    b = []
    for n in second.encode(text):
        piece = second.id_to_piece(n)
        b.append((n, bytes([int(piece[3:5], 16)]) if second.is_byte(n) else piece.replace("▁", " ").encode()))
    for tokens in (a, b):
        if not text or b"".join(x for _, x in tokens) != (" " + text).encode():
            return None
        at, row = 0, []
        for n, x in tokens:
            row.append((n, at, at + len(x)))
            at += len(x)
        out.append(row)
    return out


def brute(libraries, rows):
    made, counts = [], collections.Counter()
    for doc_id, text in rows:
        both = spelled(libraries, text or "")
        if both is None:
            made.append((doc_id, 0, 0, 0, [], ""))
            continue
        a, b = both
        ends = sorted({t[2] for t in a} & {t[2] for t in b})
        groups = []
        for start, end in zip([0, *ends], ends):
            side = [",".join(str(n) for n, s, e in tokens if start < e <= end) for tokens in both]
            groups.append("|".join(side))
        links, j = [], 0
        for n, s, e in a:
            while b[j][2] <= s:
                j += 1
            k = j
            while k < len(b) and b[k][1] < e:
                links.append((n, b[k][0]))
                k += 1
        counts.update(links)
        made.append((doc_id, len(a), len(b), len(groups), links, ";".join(groups)))
    most = collections.Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    return [
        (i, na, nb, ng, len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), groups)
        for i, na, nb, ng, links, groups in made
    ]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(9)
    alphabet = [*"aeinrst ABC  .,'!", "\n", "\t", "é", "ß", "中文", " ", "ing", "tion", "the", "'s", "<|endoftext|>", "<s>", "<0x0A>", "🙂", "123"]
    rows = [(k, "".join(rng.choice(alphabet) for _ in range(rng.randrange(60)))) for k in range(300)]
    words = "under the circumstances unbelievable transformation ñandú naïve tokenizers".split()
    rows += [(400 + k, " ".join(rng.choice(words) for _ in range(300))) for k in range(5)]
    rows += [(500, None), (501, ""), (502, " "), (503, "  \n "), (504, "a▁b c"), (505, "x ▁y"), (None, "orphan text"), (None, None)]
    rows += [rows[3], rows[3], (506, "y" * 3_000), (507, "中文字" * 700 + " end of it"), (508, "ends with a space "), (509, "  begins"), (510, "\x00 \x1c \x85a")]
    return rows


def key(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((x is None, x) for x in r))


COLUMNS = "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"


@pytest.mark.parametrize("chunk,block", [(A.CHUNK_BYTES, A.BLOCK_PAIRS), (40, 150)])
def test_equals_the_libraries(spark, libraries, texts, chunk, block):
    schema = "doc_id long, text string, pairs string, item int, groups string, n_a int, at int"
    docs = spark.createDataFrame([(i, t, "p", 1, "g", 2, 3) for i, t in texts], schema).repartition(5)
    found = A.link_scores(docs, *PATHS, chunk_bytes=chunk, block_pairs=block)
    assert key(found.select(*COLUMNS).collect()) == key(brute(libraries, texts))


def test_digest(spark, texts):
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    one = {(r.doc_id, r.n_links): r.groups for r in A.align_tokens(docs, *PATHS).collect()}
    for r in A.align_tokens(docs, *PATHS, digest=True).collect():
        text = one[r.doc_id, r.n_links]
        assert r.groups == (hashlib.sha256(text.encode()).hexdigest() if text else "")


def test_fragments_compose_in_any_order(libraries, texts):
    rng, table = random.Random(2), A.Aligner.at(*PATHS).table
    for _, text in texts[:320]:
        both = spelled(libraries, text or "")
        if both is None:
            continue
        both = [np.array([(n, e) for n, _, e in side], dtype=np.int64) for side in both]
        size = int(both[0][-1, 1])
        cuts = sorted({0, size, *(rng.randrange(size + 1) for _ in range(rng.randrange(8)))})
        parts = [A.Fragment.of(*[t[(t[:, 1] > low) & (t[:, 1] <= high)] for t in both], table) for low, high in zip(cuts, cuts[1:])]
        groups, links = A.Fragment.of(*both, table).finished(table)
        while len(parts) > 1:
            k = rng.randrange(len(parts) - 1)
            parts[k : k + 2] = [parts[k].then(parts[k + 1], table)]
        assert parts[0].finished(table)[0] == groups and sorted(parts[0].finished(table)[1].tolist()) == sorted(links.tolist())


def test_ranges_cover_the_text(texts):
    for _, text in texts:
        raw = (" " + (text or "")).encode()
        ranges = [*A.ranges_of(text or "", 16)]
        assert [r[0] for r in ranges][1:] == [r[1] for r in ranges][:-1] and ranges[0][0] == 0 and ranges[-1][1] == len(raw)
        for low, high, start, stretch in ranges:
            end = start + len(stretch.encode())
            assert start <= low and high <= end and raw[start:end] == stretch.encode() and stretch[0] == " "


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert A.link_scores(empty, *PATHS).collect() == []
