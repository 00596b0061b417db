"""A history chosen by digests moves no contents."""

import re

from __spark_entry__ import queries


def plan_of(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


def test_history_by_digest_moves_no_content(spark, tmp_path):
    rows = [(i, f"text {i}", "de", f"src{i % 3}") for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        chosen = queries()["select_history_full"](spark, str(tmp_path))
        got = chosen.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    below = re.search(r"Join LeftSemi[^\n]*\n(.*)", plan_of(chosen), re.S).group(1)
    assert "sha2" in below.split("\n")[0]  # the digest is made below the join
    assert len(got) == sum(i % 3 + 1 for i in range(40)) == len({r.commit_id for r in got})
