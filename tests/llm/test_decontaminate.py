"""Cleaning by one block of benchmark items and by many gives the same texts."""

import random

from veilscan.llm import decontaminate as module
from veilscan.llm.decontaminate import decontaminate, find_overlaps


def test_blocks_do_not_change_the_result(spark):
    rng = random.Random(4)

    def some(n):
        return [f"w{rng.getrandbits(30)}" for _ in range(n)]

    x, y = some(40), some(40)
    z = [*x[-4:], *some(15)]  # overlaps x by four words
    outer = some(12)
    items = [(1, x), (2, y), (3, z), (4, outer), (5, some(200)), (None, some(12))]
    texts = [
        [*some(25), *x, *some(25), *y],  # 62 % of the words by two items
        [*some(60), *x, *z[4:], *some(60)],
        [*some(90), *outer[:6], *x[:20], *outer[6:], *some(90)],  # a window joined by a cut
        [*some(50), *outer[:6], *y[:12], *outer[6:], *some(50)],
        some(50), [], [*some(40), *items[-1][1], *some(40)],
    ]
    rows = [(i, " ".join(w), len(" ".join(w)), "a") for i, w in enumerate(texts)] + [(9, None, None, "b"), (None, " ".join(texts[1]), 0, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, lang string")
    benchmark = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    key = lambda r: tuple(map(str, r))
    one = sorted(map(tuple, decontaminate(docs, benchmark).collect()), key=key)
    assert 0 not in {r[0] for r in one} and len(one) == len(rows) - 1
    for size in (2000, 600, 100):
        assert sorted(map(tuple, decontaminate(docs, benchmark, block_bytes=size).collect()), key=key) == one


def test_columns_under_the_names_of_the_operator(spark):
    leak = " ".join(f"w{k}" for k in range(12))
    rows = [(1, f"{leak} " + "own " * 30, "c", "k", "y"), (2, None, None, "k", None), (3, leak, "c", "k", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __clean string, __copy string, kept string")
    items = spark.createDataFrame([(k, f"{leak} {k}") for k in range(5)], "item_id long, text string")
    for size in (1 << 20, 40):
        found = sorted(decontaminate(docs, items, block_bytes=size).collect())
        assert [(r.doc_id, r["__clean"], r["__copy"], r.kept) for r in found] == [(1, "c", "k", "y"), (2, None, "k", None)]
        assert found[0].text.split() == ["own"] * 30 and found[1].text is None


def test_copies_of_one_item_are_one_text_in_blocks_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(module, "IDS_PER_SHARE", 50)
    leak, other = " ".join(f"w{k}" for k in range(12)), " ".join(f"v{k}" for k in range(12))
    items = spark.createDataFrame(
        [(i, leak) for i in range(1000)] + [(5, leak), (None, leak), (2000, other), (2001, "short one"), (2002, ""), (2003, None)],
        "item_id long, text string",
    )
    docs = spark.createDataFrame([(1, f"a {leak} b"), (2, other), (3, "a short one"), (4, None)], "doc_id long, text string")
    held = []
    of = module.Automaton.of.__func__
    monkeypatch.setattr(module.Automaton, "of", classmethod(lambda cls, rows, window: held.append(
        sum(8 * len(ids) + len(text) for ids, text in rows)) or of(cls, rows, window)))
    want = None
    for size in (1 << 20, 2000):
        held.clear()
        found = {r.doc_id: (r.n_words, [tuple(s) for s in r.spans], r["items"]) for r in find_overlaps(docs, items, block_bytes=size).collect()}
        assert want in (None, found)
        want = found
        assert len(held) > 1 if size == 2000 else len(held) == 1
        assert max(held) <= max(size, 2000)
    assert want[1] == (14, [(1, 13)], list(range(1000))) and want[2] == (12, [(0, 12)], [2000])
    assert want[3] == (3, [(1, 3)], [2001]) and want[4] == (0, [], [])


def test_each_text_is_searched_once(spark):
    docs = spark.createDataFrame([(1, "own words " * 20)], "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(f"w{k}" for k in range(12)))], "item_id long, text string")
    plan = decontaminate(docs, items)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
