"""Decision logs and stored sketches against the operators that read everything."""

import random

from pyspark.sql import functions as F

from veilscan.operators import govern, sketches
from veilscan.sources import decisions as dl, store as st


def make_store(spark, n=40):
    rows = [(f"f{k}", f"r{k % 4}", "SECRET" if k % 3 else "PII", "OPEN" if k % 5 else "BASELINE", None, "OPEN") for k in range(n)]
    return spark.createDataFrame(rows, "id string, repo_id string, category string, triage_status string, triage_reason string, remediation_status string")


def rows_of(df):
    columns = ("id", "repo_id", "category", "triage_status", "triage_reason", "remediation_status")
    return sorted(map(str, df.select(*columns).collect()))


def test_decisions_are_merged_when_the_store_is_read(spark, tmp_path):
    store, path = make_store(spark), str(tmp_path / "log")
    schema = "id string, status string, reason string, seq long"
    first = [("f1", "FALSE_POSITIVE", "sample", 1), ("f1", "OPEN", None, 2), ("f2", "SUPPRESSED", " ", 3), ("f4", "FALSE_POSITIVE", "x", 4), ("no", "OPEN", None, 5)]
    second = [("f4", "OPEN", None, 7), ("f7", "FALSE_POSITIVE", "late", 8), (None, "OPEN", None, 9)]
    first, second = (spark.createDataFrame(d, schema) for d in (first, second))
    scrubbed = spark.createDataFrame([("r0",), ("r3",), ("none",)], "repo_id string")

    assert rows_of(dl.current(store, dl.read_log(spark, path))) == rows_of(store)
    dl.append(dl.triage_rows(store, first), path, 0)
    dl.append(dl.scrub_rows(store, dl.read_log(spark, path), scrubbed, 6), path, 1)
    before = dl.read_log(spark, path).count()
    for _ in range(2):  # a batch run again changes nothing
        dl.append(dl.triage_rows(store, second), path, 2)
    log = dl.read_log(spark, path)
    assert log.count() == before + 2

    want = govern.triage(govern.mark_scrubbed(govern.triage(store, first), scrubbed), second)
    assert rows_of(dl.current(store, log)) == rows_of(want)
    assert rows_of(dl.current(store, dl.fold(log))) == rows_of(want)
    assert dl.fold(log).groupBy("id", F.col("status").isNull()).count().filter("count > 1").isEmpty()


def test_a_decision_writes_its_own_row_only(spark, tmp_path):
    path = str(tmp_path / "log")
    one = spark.createDataFrame([("f1", "FALSE_POSITIVE", "sample", 1)], "id string, status string, reason string, seq long")
    dl.append(dl.triage_rows(make_store(spark), one), path, 0)
    assert [tuple(r) for r in dl.read_log(spark, path).collect()] == [("f1", 1, "FALSE_POSITIVE", "sample", None)]


def test_stored_sketches_give_quantiles_within_their_error(spark, tmp_path):
    rng = random.Random(3)
    rows = [(f"d{rng.randrange(3)}", 86400 * rng.randrange(6) + k % 86400, rng.expovariate(0.1), rng.random() < 0.2) for k in range(30_000)]
    rows.append(("quiet", 5, None, False))
    events = spark.createDataFrame(rows, "detector_id string, s long, duration_s double, failed boolean").withColumn("ts", F.timestamp_seconds("s"))
    path = str(tmp_path / "sketches")
    halves = [events.filter("s % 2 = 0"), events.filter("s % 2 = 1")]
    for batch, part in enumerate([*halves, halves[1]]):  # the second increment is run again
        st.write_batch(sketches.daily_sketches(part, "detector_id", "ts", of="s", failed=F.col("failed")), path, min(batch, 1))
    stored = spark.read.parquet(path)

    def checked(first, last):
        got = {r["detector_id"]: r for r in sketches.quantiles(stored, "detector_id", first, last).collect()}
        low, high = int(first[-2:]) - 1 if first else 0, int(last[-2:]) if last else 9
        for name, r in got.items():
            own = [(d, f) for n, s, d, f in rows if n == name and low <= s // 86400 < high]
            assert r["runs"] == len(own) and abs(r["error_rate"] - sum(f for _, f in own) / len(own)) < 1e-12
            known = sorted(d for d, _ in own if d is not None)
            if not known:
                assert r["p50"] is None and r["p95"] is None
                continue
            for share, value in ((0.5, r["p50"]), (0.95, r["p95"])):
                assert value in known
                assert abs(sum(d <= value for d in known) / len(known) - share) <= sketches.RANK_ERROR + 1 / len(known)
        return got

    assert set(checked(None, None)) == {"d0", "d1", "d2", "quiet"}
    checked("1970-01-02", "1970-01-03")
    for name, about in sketches.distinct_values(stored, "detector_id").collect():
        own = len({s for n, s, _, _ in rows if n == name})
        assert abs(about - own) <= 0.04 * own
    every = len({s for _, s, _, _ in rows})
    assert abs(sketches.distinct_values(stored).first()[0] - every) <= 0.04 * every
    assert sketches.quantiles(stored.limit(0), "detector_id").isEmpty()
