"""Rulesets, policies, value sources, ingest, links, lookups, history."""

import json

import pytest
from pyspark.sql import functions as F

from veilscan.functions import fixed_values as fv
from veilscan.operators import lookups, metrics, query as qo, rulesets
from veilscan.sources import reports, store as st, units as un, values as vs


@pytest.mark.parametrize("threshold", ["10m", "-1"])
@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_lookup_join_is_the_same_beyond_the_bound(spark, how, threshold):
    # One key holds a third of all rows.
    large = spark.range(900).select(
        F.col("id"), F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 40).alias("k"), F.lit("x" * 10).alias("content")
    )
    small = spark.range(20).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    right = small if how in ("inner", "left") else small.select("k")
    want = sorted(map(str, large.join(right, ["k"], how).collect()))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        got = lookups.lookup_join(large, right, ["k"], how)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert ("BroadcastHashJoin" in plan) == (threshold != "-1") and "explode" not in plan.lower()
        assert sorted(map(str, got.select(*large.join(right, ["k"], how).columns).collect())) == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def ruleset(position, enforcement, is_global, repos, *rules):
    return (str(position), position, f"set {position}", enforcement, is_global, list(repos), [tuple(r) for r in rules])


def resolve(spark, sets, pairs):
    frame = spark.createDataFrame(sets, rulesets.RULESET_SCHEMA)
    rows = rulesets.resolve_rules(spark.createDataFrame(pairs, "repo_id string, rule_id string"), frame).collect()
    return {(r["repo_id"], r["rule_id"]): r["override"] for r in rows}


def test_ruleset_precedence(spark):
    sets = [
        ruleset(1, "DISABLED", True, [], ("iban", False, None, "ALWAYS", None)),
        ruleset(2, "ACTIVE", True, [], ("email", False, None, "ALWAYS", None), ("phone", True, None, None, None)),
        ruleset(3, "ACTIVE", False, ["a"], ("email", True, "LOW", "ALWAYS", None)),
        ruleset(0, "ACTIVE", False, ["a"], ("email", False, "INFO", "ALWAYS", None)),
    ]
    got = resolve(spark, sets, [("a", "email"), ("b", "email"), ("a", "iban"), ("b", "phone")])
    assert got[("a", "email")]["enabled"] is True and got[("a", "email")]["severity"] == "LOW"
    assert got[("b", "email")]["enabled"] is False
    assert got[("a", "iban")] is None
    assert got[("b", "phone")]["match_mode"] == "ALWAYS"
    assert rulesets.rules_switched_on(spark.createDataFrame(sets, rulesets.RULESET_SCHEMA)) == ["phone"]


def policies(spark, *rows):
    return spark.createDataFrame(
        [(f"p{i}", org, fail_on, False, False, ["secrets"], "LOW") for i, (org, fail_on) in enumerate(rows)],
        rulesets.POLICY_SCHEMA,
    )


def test_policies(spark):
    repos = spark.createDataFrame(
        [("r1", "org/team/app"), ("r2", "org"), ("r3", "organ/x"), ("r4", None)], "repo_id string, org_unit string"
    )
    made = policies(spark, ("org", "LOW"), ("org/team", "CRITICAL"), ("", "INFO"))
    got = {r["repo_id"]: r["fail_on"] for r in rulesets.resolve_policies(repos, made).collect()}
    assert got == {"r1": "CRITICAL", "r2": "LOW", "r3": "INFO", "r4": "INFO"}
    fallback = rulesets.resolve_policies(repos, policies(spark, ("org", "LOW"))).filter("repo_id = 'r3'").first()
    assert fallback["fail_on"] == "HIGH" and fallback["groups"] == ["secrets", "pii"] and fallback["policy_id"] is None


@pytest.mark.parametrize(
    "text, want",
    [
        ("key,value\nname,Anna\ncity,Bern\n", [("name", "Anna"), ("city", "Bern")]),
        ('"k";"v"\r\n', [("k", "v")]),
        ('[{"key":"a","value":"1"},{"key":"b","value":"2"}]', [("a", "1"), ("b", "2")]),
        (' \n{\n "a": "1",\n "b": 2, "c": null}', [("a", "1"), ("b", "2")]),
        ("  \n", []),
        ("novalue\na,\n,b\n", []),
        ("a,b;c", [("a", "b;c")]),
    ],
)
def test_key_values(spark, tmp_path, text, want):
    path = tmp_path / "upload.txt"
    path.write_bytes(text.encode())
    got = [tuple(r) for r in vs.read_key_values(spark, str(path)).collect()]
    assert sorted(got) == sorted(want)


def test_records_at_path(spark):
    docs = {
        '[{"a":1},{"a":2}]': (None, 2), '{"a":1}': (None, 1), '{"d":{"e":[1,2,3]}}': ("$.d.e[*]", 3),
        '{"d":{}}': ("$.d.e[*]", 0), '{"d":null}': ("$.d", 0),
    }
    for text, (path, n) in docs.items():
        frame = spark.createDataFrame([(text,)], "d string")
        assert vs.records_at_path(frame, F.col("d"), path).count() == n, text


def test_replace_values(spark, tmp_path):
    path = str(tmp_path / "hashes")

    def upload(source, *words):
        pairs = spark.createDataFrame([("name", w) for w in words], "key string, value string")
        vs.replace_values(vs.hash_values(pairs, "p"), source, path)

    upload("s1", "anna", "bert", "bert", "abc")
    upload("s2", "carl")
    upload("s1", "dora")
    rows = spark.read.parquet(path).groupBy("source_id").count().collect()
    assert {(r["source_id"], r["count"]) for r in rows} == {("s1", 1), ("s2", 1)}


def test_ingest_is_idempotent(spark, tmp_path):
    body = json.dumps({
        "repoId": "r", "ci": {"runRef": "run-1", "actor": " "},
        "findings": [{"ruleId": "x", "file": "a", "line": 3, "redactedMatch": "**"}],
    })
    path = str(tmp_path / "deliveries")
    for batch_id, seqs in ((0, [1, 2]), (1, [3]), (1, [3])):
        feed = spark.createDataFrame([(s, body) for s in seqs], "seq bigint, body string")
        st.write_batch(feed, path, batch_id)
    runs = st.ingested_runs(spark, path)
    (record,) = st.ingested_records(runs).collect()
    assert (record["mode"], record["status"], record["finding_count"]) == ("diff", "COMPLETED", 1)
    assert record["ci"]["run_ref"] == "run-1" and record["ci"]["actor"] is None
    (found,) = st.ingested_findings(runs).collect()
    assert (found["fingerprint"], found["category"], found["severity"]) == ("r:x:a:3", "SECRET", "MEDIUM")


def test_source_links(spark):
    cases = {
        "https://github.com/org/repo": "https://github.com/org/repo/blob/main//x".replace("//x", "/src/M.java#L42"),
        "git@github.com:org/repo.git": "https://github.com/org/repo/blob/main/src/M.java#L42",
        "ssh://git@gitlab.com/grp/proj.git": "https://gitlab.com/grp/proj/blob/main/src/M.java#L42",
        "https://bitbucket.org/team/repo": "https://bitbucket.org/team/repo/src/main/src/M.java#lines-42",
        "https://user@host:8443/a/b": "https://host/a/b/blob/main/src/M.java#L42",
        "/Users/me/repo": None,
        "file:///tmp/repo": None,
    }
    repos = spark.createDataFrame([(k, k, ["main"]) for k in cases], "name string, location string, branches array<string>")
    found = spark.createDataFrame([(k, "/src/M.java", 42) for k in cases] + [("?", "a", 1)], "repo_id string, path string, line_no int")
    got = {r["repo_id"]: r["link"] for r in qo.source_links(found, repos).collect()}
    assert got == {**cases, "?": None}
    bare = spark.createDataFrame([("r", "https://h/a", [])], "name string, location string, branches array<string>")
    one = spark.createDataFrame([("r", "a.txt", 0)], "repo_id string, path string, line_no int")
    assert qo.source_links(one, bare).first()["link"] == "https://h/a/blob/HEAD/a.txt"


def test_history_modes(make_units):
    units = make_units(
        ("r", "a", "c1", 1, "x"), ("r", "a", "c2", 2, "y"), ("r", "b", "c2", 2, "z"), ("s", "a", "c9", 1, "x"),
    )
    branched = units.withColumn("branch", F.explode(F.array(F.lit("main"), F.lit("dev"))))
    assert un.select_history(branched, "FULL").count() == 4
    assert un.select_history(units.unionByName(units), "FULL").count() == 4
    head = un.select_history(units, "HEAD").select("repo_id", "commit_id", "path").collect()
    assert sorted(map(tuple, head)) == [("r", "c2", "a"), ("r", "c2", "b"), ("s", "c9", "a")]
    seen = un.mark_seen(units.filter("commit_id = 'c1'"))
    assert un.select_history(units, "INCREMENTAL", seen=seen).count() == 3
    assert un.mark_seen(units, seen).count() == 3
    with pytest.raises(ValueError):
        un.select_history(units, "DIFF")


def test_lines(make_units):
    units = make_units(("a", "x\ny\n"), ("b", ""), ("c", "p\n" + "q" * 4001 + "\nr"))

    def lines(limit):
        rows = un.explode_lines(units, limit).collect()
        return sorted((r["path"], r["line_no"], r["line"], r["prev_line"]) for r in rows)

    every = [
        ("a", 1, "x", None), ("a", 2, "y", "x"), ("a", 3, "", "y"), ("b", 1, "", None),
        ("c", 1, "p", None), ("c", 2, "q" * 4001, "p"), ("c", 3, "r", "q" * 4001),
    ]
    assert lines(None) == every
    assert lines(4000) == [r for r in every if r[1:2] != (2,) or r[0] != "c"]


def test_file_types_and_files(spark, tmp_path):
    from veilscan.functions.text import file_extension, file_type

    want = {
        "a/B.JAVA": "SOURCE", "x.yml": "CONFIG", "R.md": "DOCUMENTATION", "p.png": "BINARY", "Dockerfile": "OTHER",
        "java": "OTHER", "main.tf": "OTHER", "a.java/b": "OTHER", "x.": "OTHER",
    }
    frame = spark.createDataFrame([(p,) for p in want], "path string").select(
        "path", file_type(F.col("path")).alias("t"), file_extension(F.col("path")).alias("e")
    )
    rows = {r["path"]: r for r in frame.collect()}
    assert {p: r["t"] for p, r in rows.items()} == want
    assert rows["a.java/b"]["e"] == "" and rows["x.yml"]["e"] == "yml"
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "A.java").write_text("héllo\n")
    (tmp_path / "bin.dat").write_bytes(b"\x00\x01")
    read = un.read_files(spark, str(tmp_path), "r", "c").collect()
    assert [(r["path"], r["content"]) for r in read] == [("src/A.java", "héllo\n")]


def test_reports(spark):
    found = spark.createDataFrame(
        [("r", "fp1", "rule[1]", "SECRET", "HIGH", "a'|b.java", 3, "AB**|", False), ("r", "fp2", "x", "PII", "LOW", "c", 1, "**", True)],
        "repo_id string, fingerprint string, rule_id string, category string, severity string, path string, "
        "line_no int, redacted_match string, suppressed boolean",
    )
    (line,) = reports.build_log_messages(found).filter("part = 1").collect()
    assert line["message"] == (
        "##teamcity[inspection typeId='rule|[1|]' message='Potential SECRET: AB**||' file='a|'||b.java' line='3' SEVERITY='ERROR']"
    )
    catalog = rulesets.rule_catalog(spark)
    (doc,) = reports.sarif_documents(found, reports.sarif_rules(catalog, F.col("title"))).collect()
    log = json.loads(doc["document"])
    run = log["runs"][0]
    assert log["version"] == "2.1.0" and len(run["tool"]["driver"]["rules"]) == catalog.count()
    (result,) = run["results"]
    assert result["level"] == "error" and result["partialFingerprints"] == {"scannerFingerprint/v1": "fp1"}
    assert result["locations"][0]["physicalLocation"]["region"]["startLine"] == 3


def test_rule_catalog(spark):
    rows = {r["rule_id"]: r for r in rulesets.rule_catalog(spark).collect()}
    assert len(rows) == 8 + 8 + 4 + 3
    assert rows["phone"]["default_enabled"] is False
    assert rows["pii.custom-regex"]["default_severity"] == "MEDIUM"


def test_progress_and_sessions(spark):
    rows = spark.createDataFrame([("a", True), ("a", False), ("a", False), ("b", True)], "scan_id string, done boolean")
    assert {(r["scan_id"], r["progress"]) for r in metrics.scan_progress(rows).collect()} == {("a", 38), ("b", 95)}
    at = [0, 1800, 3601, 3602, 9000]
    events = spark.createDataFrame([("r", i, t, f"S{i}") for i, t in enumerate(at)], "repo_id string, id int, t bigint, status string")
    events = events.withColumn("started_at", F.timestamp_seconds("t"))
    mine = metrics.scan_sessions(events).select("session_start", "session_end", "n", "last_status")
    spark_own = (
        events.groupBy(F.session_window("started_at", "30 minutes").alias("w"), "repo_id")
        .agg(F.count("*").alias("n"), F.max_by("status", "started_at").alias("last_status"))
        .select("w.start", "w.end", "n", "last_status")
    )
    assert sorted(map(tuple, mine.collect())) == sorted(map(tuple, spark_own.collect()))


def test_report_rows_cut_before_the_shuffle(spark):
    store = spark.range(500).select(
        F.concat(F.lit("s"), F.floor(F.col("id") / 490)).alias("scan_id"),
        (F.col("id") % 5).cast("int").alias("severity_rank"), F.col("id").cast("string").alias("path"),
        F.lit(1).alias("line_no"), F.col("id"),
    )
    top = qo.report_rows(store, 50)
    assert top.count() == 60
    assert "WindowGroupLimit" in top._jdf.queryExecution().optimizedPlan().toString()


def test_facets_and_queries(spark):
    store = spark.createDataFrame(
        [
            ("1", "r", "OPEN", "HIGH", 3, "d", "x", "a.java"), ("2", "r", "OPEN", "LOW", 1, "d", "y", "b.md"),
            ("3", "q", "SUPPRESSED", "HIGH", 3, "e", "x", "c"),
        ],
        "id string, repo_id string, triage_status string, severity string, severity_rank int, detector_id string, rule_id string, path string",
    )

    def ids(frame):
        return [r["id"] for r in frame.collect()]

    assert ids(qo.facet_query(store, "")) == ["1", "2"]
    assert ids(qo.facet_query(store, "is:closed")) == ["3"]
    assert ids(qo.facet_query(store, "is:open severity:high rule:x")) == ["1"]
    assert ids(qo.facet_query(store, "language:md")) == ["2"]
    assert ids(qo.query_findings(store, min_severity="MEDIUM", limit=1, offset=1)) == ["3"]
    assert ids(qo.query_findings(store, repo_id="r", limit=0)) == ["1", "2"]
    counts = {r["severity"]: r["n"] for r in qo.dashboard_severity_counts(store).collect()}
    assert counts == {**{s: 0 for s in fv.SEVERITIES}, "HIGH": 1, "LOW": 1}
