"""Chat formatting: tool calls linked to their results, ordered, validated, canonical.

Everything runs as DataFrame operations: arguments are parsed as variants, so no Python sees a
row.

1. Events that are equal in all columns read count once. A call identifier belongs, within its
   conversation, to the first call that bears it (by turn, then arguments, then name).
2. Results meet calls by a hash join on (conversation, identifier). Identifiers are unique on
   the call side by then, so a popular one has many rows on the probe side only, where adaptive
   execution splits them.
3. A call may wait for another one. Depths in that forest are found by pointer doubling: after k
   rounds every call knows its ancestor 2^k steps up, so a conversation of n calls takes log2 n
   rounds, each written to the shared folder. What has not reached a root by then hangs on a
   cycle.
4. Events sort by depth, then by the turn of their call, a call before its results. Positions
   come from a range-partitioned sort and per-partition counts, so a conversation that holds a
   third of all events is numbered by many tasks.
5. Arguments are checked against the schema of their tool and written as canonical JSON: keys
   sorted, no white space, numbers in one form.

Defined cases: null arguments are invalid JSON, as is an object that repeats a key; a null
identifier links to nothing; a result without a call is an orphan and comes last, as do calls on
a cycle; a call that waits for itself is on a cycle, one that waits for an unknown call is a
root; a null conversation is a conversation of its own; empty tables give empty results; further
columns play no part.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from veilscan.llm.inputs import shuffle_partitions
from veilscan.session import materialise

EVENT = ("conv_id", "turn", "kind", "call_id", "name", "arguments", "after", "content")
CALL, RESULT, MESSAGE = "call", "result", "message"

# Tools that the queries use: (tool, parameter, type, required).
SCHEMAS = (
    ("search", "limit", "integer", True),
    ("search", "query", "string", True),
    ("summarise", "ratio", "number", False),
    ("summarise", "text", "string", True),
    ("translate", "target", "string", True),
    ("translate", "text", "string", True),
)

_KINDS = {
    "string": "STRING$", "integer": "BIGINT$", "number": "(BIGINT|DOUBLE|DECIMAL.*)$", "boolean": "BOOLEAN$",
    "array": "ARRAY.*", "object": "OBJECT.*", "null": "VOID$",
}


def schema_table(spark: SparkSession, schemas: tuple = SCHEMAS) -> DataFrame:
    """One row per tool: its parameters as an array. Schemas are configuration: their number is
    that of the tools, not of the data."""
    rows = [(tool, param, _KINDS[kind], required) for tool, param, kind, required in schemas]
    return (
        spark.createDataFrame(rows, "tool string, param string, kind string, required boolean")
        .groupBy("tool").agg(F.array_sort(F.collect_list(F.struct("param", "kind", "required"))).alias("params"))
    )


def _errors() -> Column:
    """Sorted faults of a call: column ``args`` (map of variants), ``parsed``, ``params``."""
    keys = "map_keys(args)"
    missing = f"transform(filter(params, p -> p.required AND NOT array_contains({keys}, p.param)), p -> concat('missing:', p.param))"
    wrong = (
        f"transform(filter(params, p -> array_contains({keys}, p.param) AND NOT "
        "rlike(schema_of_variant(element_at(args, p.param)), concat('^', p.kind))), p -> concat('type:', p.param))"
    )
    unknown = f"transform(array_except({keys}, transform(params, p -> p.param)), k -> concat('unknown:', k))"
    return (
        F.when(F.col("parsed").isNull(), F.array(F.lit("invalid_json")))
        .when(F.col("args").isNull(), F.array(F.lit("not_an_object")))
        .when(F.col("params").isNull(), F.array(F.lit("unknown_tool")))
        .otherwise(F.array_sort(F.concat(F.expr(missing), F.expr(wrong), F.expr(unknown))))
    )


def validated(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """Calls with ``errors`` (sorted, empty if valid) and ``canonical`` (JSON, null if invalid)."""
    parsed = calls.withColumn("parsed", F.try_parse_json("arguments")).withColumn(
        "args", F.expr("try_variant_get(parsed, '$', 'map<string,variant>')")
    )
    met = parsed.join(F.broadcast(schemas), parsed["name"] == schemas["tool"], "left")
    return met.withColumn("errors", _errors()).withColumn("canonical", F.to_json("parsed")).drop(
        "parsed", "args", "tool", "params"
    )


def depths(calls: DataFrame) -> DataFrame:
    """``calls`` needs unique (conv_key, call_id) and ``after``. Adds nothing but returns conv_key,
    call_id and depth: 0 for roots, null on or behind a cycle."""
    known = calls.select("conv_key", F.col("call_id").alias("after"), F.lit(True).alias("found"))
    linked = calls.select("conv_key", "call_id", "after").join(known, ["conv_key", "after"], "left")
    nodes = linked.select(
        "conv_key", "call_id", F.when(F.col("found"), F.col("after")).alias("up"),
        F.when(F.col("found"), F.lit(1)).otherwise(F.lit(0)).cast("long").alias("depth"),
    )
    nodes = materialise(nodes, "chat-depths")
    longest = nodes.groupBy("conv_key").count().agg(F.max("count")).first()[0] or 0
    for _ in range(math.ceil(math.log2(longest + 1)) if longest else 0):
        waiting = nodes.filter("up IS NOT NULL")
        if waiting.isEmpty():
            break
        above = nodes.select(
            "conv_key", F.col("call_id").alias("up"), F.col("up").alias("next_up"), F.col("depth").alias("more")
        )
        moved = waiting.join(above, ["conv_key", "up"]).select(
            "conv_key", "call_id", F.col("next_up").alias("up"), (F.col("depth") + F.col("more")).alias("depth")
        )
        nodes = materialise(nodes.filter("up IS NULL").unionByName(moved), "chat-depths")
    return nodes.select("conv_key", "call_id", F.when(F.col("up").isNull(), F.col("depth")).alias("depth"))


def link_tool_calls(events: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row per event: conv_id, position (from 0 within the conversation), turn, kind, call_id,
    depth, status, errors (comma-joined) and message (canonical JSON).

    ``events`` has the columns of ``EVENT``; kind is call, result or message. Status is
    answered, unanswered, duplicate or cycle for calls, linked or orphan for results, plain for
    messages."""
    rows = events.select(*EVENT).distinct().withColumn(
        "conv_key", F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit("none"))
    )
    first = F.struct("turn", "arguments", "name", "after", "content")
    calls = rows.filter(F.col("kind") == CALL).withColumn("mark", first)
    owner = (
        calls.filter("call_id IS NOT NULL").groupBy("conv_key", "call_id").agg(F.min("mark").alias("owner"))
    )
    marked = calls.join(owner, ["conv_key", "call_id"], "left").withColumn(
        "owns", F.coalesce(F.col("mark").eqNullSafe(F.col("owner")), F.lit(False)) & F.col("call_id").isNotNull()
    ).drop("mark", "owner")
    marked = materialise(marked, "chat-calls")
    owners = marked.filter("owns")
    levels = depths(owners)
    sources = owners.select("conv_key", "call_id", F.col("turn").alias("call_turn")).join(
        levels, ["conv_key", "call_id"], "left"
    )
    results = rows.filter(F.col("kind") == RESULT).join(sources.hint("shuffle_hash"), ["conv_key", "call_id"], "left").withColumn(
        "status", F.when(F.col("call_turn").isNull(), F.lit("orphan")).otherwise(F.lit("linked"))
    )
    answered = results.filter("status = 'linked'").select("conv_key", "call_id").distinct().withColumn("has", F.lit(True))
    judged = (
        validated(marked, schemas)
        .join(levels, ["conv_key", "call_id"], "left").join(answered, ["conv_key", "call_id"], "left")
        .withColumn("call_turn", F.col("turn"))
        .withColumn(
            "status",
            F.when(F.col("call_id").isNull(), F.lit("unanswered")).when(~F.col("owns"), F.lit("duplicate")).when(F.col("depth").isNull(), F.lit("cycle"))
            .when(F.col("has"), F.lit("answered")).otherwise(F.lit("unanswered")),
        )
    )
    plain = rows.filter(~F.col("kind").isin(CALL, RESULT)).withColumn("depth", F.lit(0).cast("long")).withColumn(
        "call_turn", F.col("turn")
    ).withColumn("status", F.lit("plain"))
    none = F.lit(None).cast("string")
    columns = ("conv_id", "conv_key", "turn", "kind", "call_id", "depth", "call_turn", "status", "errors", "message")
    calls_out = judged.select(*columns[:8], F.array_join("errors", ",").alias("errors"), _call_message().alias("message"))
    results_out = results.select(*columns[:8], none.alias("errors"), _result_message().alias("message"))
    plain_out = plain.select(*columns[:8], none.alias("errors"), _plain_message().alias("message"))
    return _positions(calls_out.unionByName(results_out).unionByName(plain_out))


def _canonical_struct(**fields: Column) -> Column:
    """Keys in order; nulls are left out."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]))


def _call_message() -> Column:
    arguments = F.try_parse_json(F.coalesce("canonical", F.to_json(F.struct(F.col("arguments").alias("invalid")))))
    return _canonical_struct(
        role=F.lit("assistant"), type=F.lit("tool_call"), id=F.col("call_id"), name=F.col("name"),
        arguments=arguments, valid=F.size("errors") == 0,
    )


def _result_message() -> Column:
    return _canonical_struct(role=F.lit("tool"), type=F.lit("tool_result"), id=F.col("call_id"), content=F.col("content"))


def _plain_message() -> Column:
    return _canonical_struct(role=F.lit("user"), type=F.lit("message"), content=F.col("content"))


def _positions(rows: DataFrame) -> DataFrame:
    order = [
        F.col("conv_key"), F.col("depth").asc_nulls_last(), F.col("call_turn").asc_nulls_last(), F.col("call_id").asc_nulls_first(),
        F.col("kind"), F.col("turn"), F.col("message"),
    ]
    ranged = (
        rows.repartitionByRange(shuffle_partitions(rows), *order).sortWithinPartitions(*order)
        .withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id())
    )
    placed = materialise(ranged, "chat-order")
    parts = placed.groupBy("conv_key", "part").agg(F.min("at").alias("first_at"), F.count("*").alias("n"))
    before = Window.partitionBy("conv_key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long")))
    return placed.join(bases.drop("n"), ["conv_key", "part"]).select(
        "conv_id", (F.col("at") - F.col("first_at") + F.col("base")).alias("position"), "turn", "kind", "call_id",
        "depth", "status", "errors", "message",
    )
