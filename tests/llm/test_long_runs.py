"""Long runs of one anchor go on as rows instead of being sorted in one task."""

import pyarrow as pa

from veilscan.llm import suffix_array

COLUMNS = ["k1", "doc", "place", "n", "bytes"]


def test_runs_of_one_anchor_are_bounded_in_bytes(monkeypatch):
    text = b"a" * 1_500_000
    spans = [[{"place": 0, "n": len(text) - 49, "rank": 5}]]
    docs = [pa.RecordBatch.from_arrays([pa.array([d]), pa.array([text]), pa.array(spans)], ["doc", "text", "spans"]) for d in range(6)]
    rows = list(suffix_array._opened(50)(docs))
    lengths = [n for b in rows for n in b.column("n").to_pylist()]
    assert max(lengths) <= 1 << 16 and sum(lengths) == 6 * (len(text) - 49)
    asked, whole = [], suffix_array._pairs

    def pairs(doc, place, n, texts, length):
        asked.append(sum(map(len, texts)))
        return whole(doc, place, n, texts, length)

    monkeypatch.setattr(suffix_array, "_pairs", pairs)
    found = {True: 0, False: 0}
    for batch in suffix_array._second_round(50, 50_000)(rows):
        for n in batch.column("n").to_numpy().tolist():
            found[n < 0] += abs(n)
    assert max(asked) <= suffix_array.PAIR_BYTES + (1 << 17)
    assert found[True] + found[False] == 6 * (len(text) - 49) and found[False] > 0
