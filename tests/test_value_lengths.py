"""Words are hashed only if their length is that of a known one."""

import re

from pyspark.sql import functions as F

from veilscan.operators import values as v


def plan_of(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


def test_words_of_other_lengths_than_known_ones_are_not_hashed(spark, make_units):
    units = make_units(("a.java", "short gamma42 alphabetical, gamma42x (delta-9) gamma42"), ("b.java", "gamma42"), ("c.java", "xgamma42 -9"))
    values = spark.createDataFrame([("w", "gamma42"), ("w", "(delta-9)"), ("w", "-9")], "attribute string, value string")
    got = sorted((r.path, r.redacted_match, r.line_no) for r in v.detect_values(units, values).collect())
    assert got == [("a.java", "(del*a-9)", 1), ("a.java", "*******", 1), ("b.java", "*******", 1), ("c.java", "**", 1)]
    singles = spark.createDataFrame([("w", "gamma42")], "attribute string, value string")
    parts = v._parts(v._with_rule_columns(singles).withColumn("core", v._core(F.col("value"))))
    plan = plan_of(v._line_pieces(units, parts, False))
    assert re.search(r"length\(run#\d+\) >= 7|length\(run#\d+\) = 7", plan)
