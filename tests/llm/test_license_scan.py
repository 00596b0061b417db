"""Licence rules against a scan by Python's own regular expressions, without gate or blocks."""

import random
import re

import pytest

from veilscan.llm import license_scan
from veilscan.llm.license_rules import MAX_WORDS, rules

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute(text):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))
    norm = " " + " ".join(words) + " "
    found = []
    for k, r in enumerate(rules()):
        pattern = re.compile(f"(?s) (?=({r.pattern}) )")
        for m in pattern.finditer(norm):
            start = norm[: m.start()].count(" ")
            found.append((start, start + m[1].count(" ") + 1, r.label, k, r.priority, r.confidence, r.base))

    def outranks(y, x):
        return not y[6] and y[0] <= x[0] and y[1] >= x[1] and (-y[4], -(y[1] - y[0]), y[3]) < (-x[4], -(x[1] - x[0]), x[3])

    kept = sorted(x for x in found if x[6] or not any(outranks(y, x) for y in found))
    base = [x for x in kept if x[6]]
    return (
        len(words), len(base), min((x[0] for x in base), default=None), max((x[0] for x in base), default=None),
        ",".join(sorted({x[2] for x in base})), ",".join(sorted({x[2] for x in kept})),
        max((x[5] for x in kept), default=0.0), kept,
    )


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    vocabulary = sorted({w for r in rules() for w in re.findall("[a-z0-9]+", re.sub(r"\(\?:|\[sc\]|\?", " ", r.pattern)) if len(w) > 1})
    vocabulary += ["under", "the", "mit", "license", "cc", "by", "nc", "version", "2", "0", "apache", "gnu", "general", "public"] * 20
    exact = [r.pattern for r in rules() if not re.search(r"[()\[\]?|]", r.pattern)]
    rows = []
    for k in range(150):
        parts = [rng.choice(exact) if rng.random() < 0.1 else rng.choice(vocabulary) for _ in range(rng.randrange(120))]
        rows.append((k, rng.choice([" ", "\n", ", ", "-"]).join(parts).upper() if k % 3 else " ".join(parts)))
    rows += [
        (200, None), (201, ""), (202, " .\n"), (None, "Released under the MIT License."), (None, None),
        (203, "Licensed under CC BY-NC 4.0."), (204, "cc by nc cc by-nc CC BY NC"), (205, "Licensed under the Apache License, Version 2.0."),
        (206, "under the mit license"), (206, "under the mit license"), (207, "under the mit license"), (208, "K gnu GPLé gpl 3"),
        (209, "word " * 255 + "under the mit license " + "x " * 300 + "cc by nc"), (210, "w " * 254 + "licensed under the GNU General Public License, version 3."),
        (211, "x" * 200_000 + " mit license"), (212, "cc by nc " * 3_000), (213, "mit License mit licence isc license " * 500),
        (214, "SPDX-License-Identifier: GPL-2.0-or-later"), (215, "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International"),
    ]
    return rows


def result(row):
    return (row.doc_id, row.n_words, row.n_base, row.first_word, row.last_word, row.base_labels, row.labels, row.score)


def key(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x) for x in r))


def test_rules_are_bounded():
    made = rules()
    assert len(made) >= 250 and len({r.name for r in made}) == len(made)
    for r in made:
        assert not re.search(r"[*+{]", r.pattern), r
        assert len(r.pattern.split(" ")) <= MAX_WORDS, r


def test_equals_brute_force(spark, texts):
    schema = "doc_id long, text string, words string, blocks string, rules int, gate string, detections string"
    docs = spark.createDataFrame([(i, t, "w", "b", 1, "g", None) for i, t in texts], schema).repartition(4)
    found = license_scan.license_detections(docs)
    want = [(i, *brute(t)) for i, t in texts]
    assert key(map(result, license_scan.license_summary(found).collect())) == key(w[:8] for w in want)
    spans = {(r.doc_id, r.n_words): [tuple(d) for d in r.detections] for r in found.collect()}
    for i, n, *_, kept in want:
        assert sorted(spans[i, n]) == kept


def test_blocks_change_nothing(spark, texts):
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    one = license_scan.license_summary(license_scan.license_detections(docs))
    other = license_scan.license_summary(license_scan.license_detections(docs, block_words=64, margin=41))
    assert key(map(result, one.collect())) == key(map(result, other.collect()))


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert license_scan.license_summary(license_scan.license_detections(empty)).collect() == []
    with pytest.raises(ValueError):
        license_scan.license_detections(empty, margin=8)
