"""Removal of repeated byte strings against brute force."""

import hashlib
import random

import pytest

from veilscan.llm import suffix_array

SCHEMA = "doc_id long, text string, spare string"


def brute(rows, length):
    """Per row: bytes removed, maximal runs, remaining bytes."""
    smallest = {}
    for doc, text, _ in rows:
        raw = (text or "").encode()
        key = float("inf") if doc is None else doc
        for k in range(len(raw) - length + 1):
            s = raw[k : k + length]
            smallest[s] = min(smallest.get(s, key), key)
    out = []
    for doc, text, _ in rows:
        raw = (text or "").encode()
        key = float("inf") if doc is None else doc
        gone = [False] * len(raw)
        for k in range(len(raw) - length + 1):
            if smallest[raw[k : k + length]] < key:
                gone[k : k + length] = [True] * length
        runs = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((doc, len(raw), sum(gone), runs, bytes(b for b, g in zip(raw, gone) if not g)))
    return sorted(out, key=str)


def result(spark, rows, length, anchor, group_runs=suffix_array.GROUP_RUNS):
    frame = spark.createDataFrame(rows, SCHEMA)
    got = suffix_array.remove_repeats(frame, length=length, anchor=anchor, group_runs=group_runs).collect()
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got), key=str)


def edited(rng, text):
    k = rng.randrange(len(text) + 1)
    return text[:k] + rng.choice(["", "é", "zz", "a"]) + text[k + rng.randrange(3) :]


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize(("length", "anchor"), [(12, 5), (50, 20)])
def test_equals_brute_force(spark, seed, length, anchor):
    rng = random.Random(seed)
    passages = ["".join(rng.choice("abcdé \n") for _ in range(rng.randrange(5, 140))) for _ in range(12)]
    rows = []
    for doc in range(120):
        text = "".join(
            rng.choice(passages) if rng.random() < 0.6 else "".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(40)))
            for _ in range(rng.randrange(6))
        )
        rows.append((rng.randrange(400), edited(rng, text) if text and rng.random() < 0.5 else text, None))
    rows += rows[:5]  # repeated rows
    rows += [(None, rows[7][1], "x"), (None, None, None), (5, None, "y"), (6, "", None), (7, "a" * 300, None), (900, "a" * 200 + "b", None)]
    rows += [(901, "ab" * 100, None), (902, "xab" + "ab" * 60, None), (903, passages[0] + "1", None), (903, "2" + passages[0], None)]
    want = brute(rows, length)
    assert result(spark, rows, length, anchor) == want
    assert result(spark, rows, length, anchor, group_runs=2) == want


def test_long_text_is_cut_into_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffix_array, "PIECE", 64)
    monkeypatch.setattr(suffix_array, "SLICE_BYTES", 500)
    rng = random.Random(5)
    base = "".join(rng.choice("abcdefgh") for _ in range(700))
    rows = [(3, base, None), (9, "q" * 13 + base[100:600] + "w", None), (1, base[300:420], None)]
    parts = list(suffix_array.runs_of(__import__("numpy").frombuffer(base.encode(), dtype="uint8"), 20, 8))
    assert len(parts) > 5
    assert result(spark, rows, 20, 8) == brute(rows, 20)


def test_empty_table(spark):
    assert result(spark, [], 50, 20) == []


def test_digest(spark):
    frame = spark.createDataFrame([(1, "x" * 60, None), (2, "x" * 60, None)], SCHEMA)
    got = {r.doc_id: bytes(r.kept) for r in suffix_array.remove_repeats(frame, digest=True).collect()}
    assert got == {1: hashlib.sha256(b"x" * 60).digest(), 2: hashlib.sha256(b"").digest()}
