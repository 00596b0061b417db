"""Tool events derived from the conversations table, and the same in SQL.

The table holds plain turns. Each assistant turn is read as a call, the user turn after it as
its result, the rest as messages. Tools, waits and faults follow from the numbers of
conversation and turn, texts are whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

TOOLS = ("search", "summarise", "translate", "draw")


def _json(text: Column) -> Column:
    held = F.to_json(F.struct(text.alias("t")))
    return F.substring(held, F.lit(6), F.length(held) - 6)


def conversation_events(conversations: DataFrame) -> DataFrame:
    conv, turn, role = F.col("conv_id"), F.col("turn"), F.col("role")
    text = F.coalesce("text", F.lit(""))
    quoted = _json(text)
    is_call = role == "assistant"
    is_result = (role == "user") & (turn > 0)

    def ident(at: Column) -> Column:
        return F.concat(F.lit("call-"), conv.cast("string"), F.lit("-"), at.cast("string"))

    tool = F.element_at(F.array(*[F.lit(t) for t in TOOLS]), (F.pmod(conv + turn, F.lit(4)) + 1).cast("int"))
    limit = F.when(conv % 7 == 3, F.lit('"many"')).otherwise((turn + 1).cast("string"))
    query = F.when(conv % 11 == 5, F.lit("")).otherwise(F.concat(F.lit('"query": '), quoted, F.lit(", ")))
    extra = F.when(conv % 13 == 6, F.lit(', "extra": [1, 2]')).otherwise(F.lit(""))
    body = (
        F.when(tool == "search", F.concat(F.lit("{"), query, F.lit('"limit": '), limit))
        .when(tool == "summarise", F.concat(F.lit('{"text": '), quoted, F.lit(', "ratio": 0.50'), extra))
        .when(tool == "translate", F.concat(F.lit('{"text": '), quoted, F.lit(', "target": "de"')))
        .otherwise(F.concat(F.lit('{"b": {"y": 1, "x": [true, null]}, "a": '), quoted))
    )
    arguments = F.concat(body, F.when(conv % 17 == 8, F.lit("")).otherwise(F.lit("}")))
    after = F.when((conv % 19 == 2) & (turn == 1), ident(F.lit(3))).when((conv % 5 != 0) & (turn >= 2), ident(turn - 2))
    return conversations.select(
        "conv_id", "turn",
        F.when(is_call, F.lit("call")).when(is_result, F.lit("result")).otherwise(F.lit("message")).alias("kind"),
        F.when(is_call, ident(turn)).when(is_result, ident(turn - 1)).alias("call_id"),
        F.when(is_call, tool).alias("name"), F.when(is_call, arguments).alias("arguments"),
        F.when(is_call, after).alias("after"), F.when(~is_call | role.isNull(), text).alias("content"),
    )


SQL = """
WITH RECURSIVE t AS (SELECT DISTINCT conv_id, turn, role, coalesce(text, '') AS text,
    to_json(coalesce(text, ''))::VARCHAR AS q FROM conversations),
e AS (SELECT *, CASE WHEN role = 'assistant' THEN 'call' WHEN role = 'user' AND turn > 0 THEN 'result' ELSE 'message' END AS kind,
    (['search','summarise','translate','draw'])[((conv_id + turn) % 4 + 1)::INTEGER] AS tool,
    CASE WHEN conv_id % 7 = 3 THEN '"many"' ELSE (turn + 1)::VARCHAR END AS lim FROM t),
calls AS (SELECT conv_id, turn, 'call-' || conv_id || '-' || turn AS call_id, tool AS name,
    CASE WHEN conv_id % 19 = 2 AND turn = 1 THEN 'call-' || conv_id || '-3'
         WHEN conv_id % 5 <> 0 AND turn >= 2 THEN 'call-' || conv_id || '-' || (turn - 2) END AS after,
    conv_id % 17 = 8 AS broken,
    CASE tool WHEN 'search' THEN '{' || CASE WHEN conv_id % 11 = 5 THEN '' ELSE '"query": ' || q || ', ' END || '"limit": ' || lim
        WHEN 'summarise' THEN '{"text": ' || q || ', "ratio": 0.50' || CASE WHEN conv_id % 13 = 6 THEN ', "extra": [1, 2]' ELSE '' END
        WHEN 'translate' THEN '{"text": ' || q || ', "target": "de"'
        ELSE '{"b": {"y": 1, "x": [true, null]}, "a": ' || q END AS raw,
    CASE tool WHEN 'search' THEN '{"limit":' || lim || CASE WHEN conv_id % 11 = 5 THEN '' ELSE ',"query":' || q END || '}'
        WHEN 'summarise' THEN '{' || CASE WHEN conv_id % 13 = 6 THEN '"extra":[1,2],' ELSE '' END || '"ratio":0.5,"text":' || q || '}'
        WHEN 'translate' THEN '{"target":"de","text":' || q || '}'
        ELSE '{"a":' || q || ',"b":{"x":[true,null],"y":1}}' END AS canonical,
    CASE tool WHEN 'search' THEN concat_ws(',', CASE WHEN conv_id % 11 = 5 THEN 'missing:query' END, CASE WHEN conv_id % 7 = 3 THEN 'type:limit' END)
        WHEN 'summarise' THEN CASE WHEN conv_id % 13 = 6 THEN 'unknown:extra' ELSE '' END
        WHEN 'translate' THEN '' ELSE 'unknown_tool' END AS faults
    FROM e WHERE kind = 'call'),
depths AS (SELECT c.conv_id, c.call_id, 0::BIGINT AS depth FROM calls c
        LEFT JOIN calls u ON u.conv_id = c.conv_id AND u.call_id = c.after WHERE u.call_id IS NULL
    UNION ALL SELECT c.conv_id, c.call_id, d.depth + 1 FROM calls c JOIN depths d ON d.conv_id = c.conv_id AND d.call_id = c.after),
results AS (SELECT conv_id, turn, 'call-' || conv_id || '-' || (turn - 1) AS call_id, q FROM e WHERE kind = 'result'),
rows AS (
    SELECT c.conv_id, c.turn, 'call' AS kind, c.call_id, d.depth, c.turn AS call_turn,
        CASE WHEN d.depth IS NULL THEN 'cycle' WHEN EXISTS (SELECT 1 FROM results r WHERE r.conv_id = c.conv_id AND r.call_id = c.call_id)
            THEN 'answered' ELSE 'unanswered' END AS status,
        CASE WHEN broken THEN 'invalid_json' ELSE faults END AS errors,
        '{"arguments":' || CASE WHEN broken THEN '{"invalid":' || to_json(raw)::VARCHAR || '}' ELSE canonical END ||
        ',"id":"' || c.call_id || '","name":"' || name || '","role":"assistant","type":"tool_call","valid":' ||
        CASE WHEN broken OR faults <> '' THEN 'false' ELSE 'true' END || '}' AS message
    FROM calls c LEFT JOIN depths d ON d.conv_id = c.conv_id AND d.call_id = c.call_id
    UNION ALL SELECT r.conv_id, r.turn, 'result', r.call_id, d.depth, c.turn,
        CASE WHEN c.turn IS NULL THEN 'orphan' ELSE 'linked' END, NULL,
        '{"content":' || q || ',"id":"' || r.call_id || '","role":"tool","type":"tool_result"}'
    FROM results r LEFT JOIN calls c ON c.conv_id = r.conv_id AND c.call_id = r.call_id
        LEFT JOIN depths d ON d.conv_id = c.conv_id AND d.call_id = c.call_id
    UNION ALL SELECT conv_id, turn, 'message', NULL, 0, turn, 'plain', NULL, '{"content":' || q || ',"role":"user","type":"message"}'
    FROM e WHERE kind = 'message')
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY depth NULLS LAST, call_turn NULLS LAST, call_id NULLS FIRST, kind, turn, message) - 1
    AS position, turn, kind, call_id, depth, status, errors, message FROM rows
"""
