"""Near copies of the pipeline against brute force over the shingle sets."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from veilscan.llm import similar, simhash


def brute_force(texts, similarity=0.8):
    sets = {}
    for i, t in texts:
        w = t.lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    names = sorted(sets)
    for k, a in enumerate(names):
        for b in names[:k]:
            x, y = sets[a], sets[b]
            if x == y or 5 * len(x & y) >= 4 * len(x | y):
                a_, b_ = root(a), root(b)
                up[max(a_, b_)] = min(a_, b_)
    return {(i, root(i)) for i in names}


def groups(spark, texts, **kw):
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    return {(r.doc_id, r.component_id) for r in similar.similar_groups(docs, **kw).collect()}


def changed(rng, words, times):
    out = list(words)
    for _ in range(times):
        out[rng.randrange(len(out))] = f"n{rng.getrandbits(40)}"
    return out


def family(rng, members, length=200):
    """One template with about 40 own shingles of 200 in each text: similarity around 0.6 to 0.7."""
    template = [f"t{rng.getrandbits(40)}" for _ in range(length)]
    return [changed(rng, template, rng.randrange(7, 11)) for _ in range(members)]


def test_relatives_below_the_limit_stay_apart(spark):
    """A template's texts at Jaccard 0.5 to 0.75: links by fingerprint join them into a component."""
    rng = random.Random(1)
    texts = [(i, " ".join(w)) for i, w in enumerate(family(rng, 150))]
    want = brute_force(texts)
    assert sum(i == c for i, c in want) >= 100
    assert groups(spark, texts) == want


def near_copies(rng):
    """Texts of every length, and copies of them with a few words changed, added or left out."""
    texts = []
    for length in [1, 2, 4, 5, 6, 7, 8, 8, 9, 10, 12, 15, 16, 20, 30, 40, 60, 100, 150, 300]:
        words = [f"w{rng.getrandbits(40)}" for _ in range(length)]
        texts += [words, [*words, "added"], ["first", *words], changed(rng, words, 1), words[: length - length // 9]]
        texts += [changed(rng, words, max(1, length // 40)) for _ in range(3)]
    return [(i, " ".join(w)) for i, w in enumerate(texts)]


def test_no_near_copy_is_missed(spark):
    texts = near_copies(random.Random(2))
    want = brute_force(texts)
    assert len(texts[48][1].split()) == 8 and (49, 48) in want  # four of five shingles
    assert groups(spark, texts) == want


@pytest.mark.parametrize("rounds", [0, 1])
def test_buckets_cut_into_pieces(spark, monkeypatch, rounds):
    monkeypatch.setattr(similar, "ROWS_PER_PIECE", 4)
    monkeypatch.setattr(similar, "SHINGLES_PER_PIECE", 500)
    monkeypatch.setattr(similar, "HOMES_PER_PIECE", 3)
    monkeypatch.setattr(similar, "VISITORS", 2)
    rng = random.Random(3)
    bases = [w.split() for _, w in near_copies(rng)[96:160:8]]
    texts = [(i, " ".join(changed(rng, rng.choice(bases), rng.randrange(3)))) for i in range(120)]
    texts += [(200 + i, " ".join(w)) for i, w in enumerate(family(rng, 40))]
    assert groups(spark, texts, rounds=rounds) == brute_force(texts)


def test_links_are_handed_on_in_bounded_batches():
    """A task holds the homes of one piece, whatever the number of rows that link to them."""
    own = similar.shingle_set("one two three four five six seven").tobytes()
    taken = []

    def batches():
        for at in range(0, 100_000, 10_000):
            taken.append(at)
            names = list(range(at, at + 10_000))
            yield pa.RecordBatch.from_arrays(
                [pa.array([7] * 10_000), pa.array([0] * 10_000), pa.array([n == 0 for n in names]), pa.array(names), pa.array([own] * 10_000)],
                ["bucket", "piece", "home", "node", "shingles"],
            )

    sizes, early = [], []
    for links in similar._compare(0.8)(batches()):
        sizes.append(links.num_rows)
        early.append(len(taken))
    assert sum(sizes) == 99_999 and max(sizes) <= similar.EDGES_PER_BATCH and early[0] <= 2


def test_rows_that_share_an_id_are_told_apart(spark):
    rng = random.Random(5)
    a, b, c = ([f"w{rng.getrandbits(40)}" for _ in range(60)] for _ in range(3))
    rows = [(1, a), (2, b), (2, [*a, "more"]), (3, [*b, "more"]), (3, c), (None, c[:30]), (None, a), (5, a[30:]), (5, b[30:])]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    kept = simhash.keep_one_per_group(docs, similar.similar_groups(docs)).collect()
    want = [(i, " ".join(w)) for i, w in (rows[0], rows[1], rows[4], rows[5], rows[6], rows[7], rows[8])]
    assert sorted(map(str, map(tuple, kept))) == sorted(map(str, want))


def test_sets_without_a_possible_partner_of_another_component_send_no_shingles(spark):
    """One bucket: two sets that may be similar, one of their component, one far larger, one far off."""
    rng = random.Random(7)
    base = [f"w{rng.getrandbits(40)}" for _ in range(100)]
    texts = [base, [*base, "x"], [*base, "y"], base * 4 + [f"z{k}" for k in range(400)], base[:20] + [f"q{k}" for k in range(80)]]
    sets = [similar.shingle_set(" ".join(t)) for t in texts]
    odd = [similar._parity(s).tolist() for s in sets]
    live = spark.createDataFrame([(1, k, min(k, 1) * k) for k in range(5)] + [(2, 0, 0), (2, 4, 4)], "token long, node long, label long")
    live = live.withColumn("label", F.when(F.col("node") == 1, 0).otherwise(F.col("label")).cast("long"))
    sizes = spark.createDataFrame([(k, len(s), *o) for k, (s, o) in enumerate(zip(sets, odd))], "node long, n int, " + ", ".join(f"{p} long" for p in similar._ODD))
    got = similar._still_open(live, sizes, 0.8).collect()
    assert sorted(map(tuple, got)) == [(1, 0), (1, 1), (1, 2)]
    alone = live.withColumn("label", F.lit(0).cast("long"))
    assert similar._still_open(alone, sizes, 0.8).isEmpty()


def test_more_parity_bits_rule_out_large_sets(spark):
    """2,000 words of which two texts share three quarters: 512 bits say nothing, 8,192 do."""
    rng = random.Random(8)
    base = [f"w{rng.getrandbits(40)}" for _ in range(2000)]
    texts = [base, base[:1700] + [f"q{rng.getrandbits(40)}" for _ in range(300)], [*base, "x"]]
    sets = [similar.shingle_set(" ".join(t)) for t in texts]
    stored = spark.createDataFrame([(k, bytearray(x.tobytes())) for k, x in enumerate(sets)], "node long, shingles binary")
    sizes = spark.createDataFrame(
        [(k, len(x), *similar._parity(x).tolist()) for k, x in enumerate(sets)], "node long, n int, " + ", ".join(f"{p} long" for p in similar._ODD)
    )
    far = spark.createDataFrame([(1, 0, 0), (1, 1, 1)], "token long, node long, label long")
    assert similar._still_open(far, sizes, 0.8).count() == 2
    wide = similar._wide_sizes(stored)
    assert similar._still_open(far, wide, 0.8).isEmpty()
    near = spark.createDataFrame([(1, 0, 0), (1, 1, 1), (1, 2, 2)], "token long, node long, label long")
    assert sorted(map(tuple, similar._still_open(near, wide, 0.8).collect())) == [(1, 0), (1, 2)]


def test_the_pipeline_drops_what_either_method_finds(spark):
    """A pair within four bits of SimHash whose similarity is below 0.8, one of 0.8 that differs in
    more bits, and a text alone."""
    rng, fp = random.Random(3), simhash.fingerprint

    def pair(times, linked):
        while True:
            one = [f"t{rng.getrandbits(40)}" for _ in range(200)]
            for _ in range(300):
                other = changed(rng, one, times)
                apart = (fp(" ".join(one)) ^ fp(" ".join(other))).bit_count()
                if (apart <= simhash.MAX_BITS) == linked:
                    return " ".join(one), " ".join(other)

    a, b = pair(7, True)
    c, d = pair(3, False)
    mine = [set(similar.shingle_set(t).tolist()) for t in (a, b, c, d)]
    assert 5 * len(mine[0] & mine[1]) < 4 * len(mine[0] | mine[1])
    assert 5 * len(mine[2] & mine[3]) >= 4 * len(mine[2] | mine[3])
    rows = [(1, a), (2, b), (3, c), (4, d), (5, " ".join(f"u{k}" for k in range(60)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()) == [1, 3, 5]
