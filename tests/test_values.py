"""Known values, plain and hashed, checked against brute force in Python."""

import hashlib
import re

from veilscan.operators.values import detect_hashed_values, detect_values

WORD = re.compile(r"[^\W]+")


def whole_word(line, value):
    def is_word(c):
        return c.isalnum() or c == "_"

    start = 0
    while (i := line.find(value, start)) >= 0:
        j = i + len(value)
        if (i == 0 or not is_word(line[i - 1])) and (j >= len(line) or not is_word(line[j])):
            return True
        start = i + 1
    return False


LINES = [
    'final String p = "12345678"; // partner',
    "id = 9912345678990",
    "Anna Meier and Anna  Meier, Anna Meierhans, xAnna Meier",
    "Zürich-12 Zürich über ??? a??b ???? c???",
    "a.b.c a.b.cd é12345678 12345678é _12345678",
    "aa a aa a, scanner ((x)) ( (x) )",
    "x" * 5000 + " 12345678",
]
VALUES = [
    "12345678", "Anna Meier", "Zürich", "???", "a.b.c", "a aa", "(x)", "\\\\E", "Meier, Anna", "Anna  Meier, Anna", "((", "; //", "scanner ((x)) ( (x",
]


def test_whole_words_match_brute_force(spark, make_units):
    units = make_units(*[(f"f{i}.java", line) for i, line in enumerate(LINES)])
    values = spark.createDataFrame([(v, v) for v in VALUES], "attribute string, value string")
    want = sorted(
        (f"f{i}.java", v) for i, line in enumerate(LINES) for v in VALUES if whole_word(line, v)
    )
    assert len(want) >= 8
    for bound in (1000, 1):
        got = sorted((r["path"], r["rule_id"]) for r in detect_values(units, values, bound).collect())
        assert got == want, bound


def test_values_fixture(spark, make_units):
    units = make_units(("D.java", LINES[0] + "\n" + LINES[1]), ("b.png", LINES[0]))
    values = spark.createDataFrame([("partnernummer", "12345678")], "attribute string, value string")
    (row,) = detect_values(units, values).collect()
    assert (row["rule_id"], row["severity"], row["line_no"], row["redacted_match"]) == (
        "partnernummer", "HIGH", 1, "********",
    )


def test_inline_directive_covers_values(spark, make_units):
    units = make_units(("D.java", "12345678 scanner:ignore-pii\n12345678 scanner:ignore-secret"))
    values = spark.createDataFrame([("n", "12345678")], "attribute string, value string")
    assert [r["line_no"] for r in detect_values(units, values).collect()] == [2]


def test_hashed_values(spark, make_units):
    def frame(value, pepper):
        digest = hashlib.sha256((pepper + value).encode()).hexdigest()
        return spark.createDataFrame([("n", digest)], "attribute string, value_hash string")

    units = make_units(("D.java", 'String p = "12345678"; 12345678 x12345678 abc'))
    assert detect_hashed_values(units, frame("12345678", "p"), "p").count() == 2
    assert detect_hashed_values(units, frame("12345678", "p"), "q").count() == 0
    assert detect_hashed_values(units, frame("99999999", ""), "").count() == 0
    assert detect_hashed_values(units, frame("abc", ""), "").count() == 0
    assert detect_hashed_values(units, frame("abc", ""), "", min_length=3).count() == 1


def test_only_pieces_that_may_be_known_leave_their_task(spark, make_units):
    from pyspark.sql import functions as F

    from veilscan.operators import values as v

    words = [f"w{i}x{i * 7919 % 1000}" for i in range(20_000)]
    units = make_units(*[(f"f{i}.java", " ".join(words[i * 1000 : i * 1000 + 1000])) for i in range(20)])
    some = words[::20]
    rows = [(f"a{i % 3}", w, w) for i, w in enumerate(some)]
    parts = spark.createDataFrame(rows, "attribute string, value string, core string").withColumns(
        {"severity": F.lit("HIGH"), "category": F.lit("PII")}
    )
    left = v._line_pieces(units, v._parts(parts), False)
    found = {r.piece for r in left.select("piece").collect()}
    assert set(some) <= found and len(found) <= len(some) + 20_000 / v.SLOTS_PER_VALUE
    known = spark.createDataFrame([(hashlib.sha256(w.encode()).hexdigest(),) for w in some], "piece string")
    hashed = v._hashed_tokens(units, known, "", 1, False)
    assert len(some) <= hashed.count() <= len(some) + 20_000 / v.SLOTS_PER_VALUE
    # Results do not depend on the way the two sides meet, nor on a filter that lets all pass.
    values = spark.createDataFrame([(a, w) for a, w, _ in rows], "attribute string, value string")
    want = sorted((r.path, r.rule_id, r.line_no, r.redacted_match) for r in v.detect_values(units, values).collect())
    assert len(want) == len(some)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        for slots in (v.FILTER_SLOTS, (1, 1)):
            v.FILTER_SLOTS, old = slots, v.FILTER_SLOTS
            got = v.detect_values(units, values).collect()
            v.FILTER_SLOTS = old
            assert sorted((r.path, r.rule_id, r.line_no, r.redacted_match) for r in got) == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_no_known_values(spark, make_units):
    units = make_units(("A.java", "one two"))
    assert detect_values(units, spark.createDataFrame([], "attribute string, value string")).count() == 0
    assert detect_hashed_values(units, spark.createDataFrame([], "attribute string, value_hash string")).count() == 0


def test_long_stretches_are_tested_only_where_their_first_words_are_known(spark, make_units):
    """Of a text that shares no two words with a passage nothing is put together; passages and marks
    are found at the beginning, in the middle and at the end of lines."""
    from veilscan.operators import values as v

    passage = " ".join(f"p{k}" for k in range(21))
    texts = [passage, f"x {passage}, y", f"say: {passage}", f"x{passage} no", f"{passage}x", "what???", "???", "a???b", "p0 p2 p4", ""]
    units = make_units(*[(f"f{i}.java", t) for i, t in enumerate(texts)])
    values = spark.createDataFrame([("long", passage), ("marks", "???")], "attribute string, value string")
    got = sorted((r.path, r.rule_id) for r in v.detect_values(units, values).collect())
    assert got == [("f0.java", "long"), ("f1.java", "long"), ("f2.java", "long"), ("f6.java", "marks")]
    known = values.selectExpr("attribute", "value", "value AS core", "'HIGH' AS severity", "'PII' AS category")
    starts = {r.piece for r in v._filtered(v._parts(known)).collect()}
    assert {"p0 p1", "p5 p6", "???"} <= starts
