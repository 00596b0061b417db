"""Licence scan with ordered signature rules, in Spark's own functions only.

1. *Words.* A text becomes its words joined by single spaces, so patterns need no escapes.
2. *Blocks.* Texts that hold a keyword of any rule are cut into blocks of ``BLOCK_WORDS`` words,
   each read with ``MARGIN`` words on both sides. No match is longer than a margin, so a block sees
   each match that starts in it and all that could contain it; results do not depend on the blocks.
3. *Gate.* The keywords that stand in a block choose its rules, a few out of hundreds.
4. *Matches.* A rule is tried at every word, so overlapping places all count.
5. *Suppression.* A match goes if another one contains it and has the higher priority, or the
   same priority and more words, or the same words and the earlier rule. Base phrases neither
   suppress nor go.

All of it is one narrow stage without a shuffle; what a row holds grows with its own text only.

Defined cases: null and empty texts have no words and no detections; rows with null ids and
repeated rows are scanned each; an empty table gives an empty table; further columns play no
part; keywords and patterns do not tell the case of A-Z.
"""

from __future__ import annotations

import json
from itertools import groupby

from pyspark.sql import DataFrame, functions as F

from veilscan.llm.inputs import id_and_text
from veilscan.llm.license_rules import MAX_WORDS, Rule, rules

BLOCK_WORDS = 256
MARGIN = 64
# What separates words.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

_RULES = "array<struct<rule:int,label:string,keywords:array<string>,pattern:string,priority:int,confidence:double,base:boolean>>"
_FOUND = "array<struct<start:bigint,after:bigint,label:string,rule:int,priority:int,confidence:double,base:boolean>>"


def _spaces(text: str) -> str:
    return f"(octet_length({text}) - octet_length(replace({text}, ' ', '')))"


def _table(chosen: list[Rule]):
    rows = [
        {"rule": k, "label": r.label, "keywords": r.keywords, "pattern": rf"(?is) (?=({r.pattern}) )(?=(.*))",
         "priority": r.priority, "confidence": r.confidence, "base": r.base}
        for k, r in enumerate(chosen)
    ]
    return F.from_json(F.lit(json.dumps(rows)), _RULES)


def _gate(chosen: list[Rule]) -> str:
    """Any keyword as a whole word, its words arranged by their first letter."""
    by_letter = {k: [w[1:] for w in g] for k, g in groupby(sorted({w for r in chosen for w in r.keywords}), key=lambda w: w[0])}
    tree = "|".join(f"{k}(?:{'|'.join(rest)})" for k, rest in by_letter.items())
    return rf"(?i) (?=[{''.join(by_letter)}])({tree})(?= )"


# All matches of one rule ``r`` in the words ``w.words``, by the words left from each on.
_MATCHES = f"""
transform(
  arrays_zip(regexp_extract_all(w.words, r.pattern, 1), regexp_extract_all(w.words, r.pattern, 2)),
  m -> named_struct(
    'start', cast(w.total - {_spaces("m['1']")} as bigint),
    'after', cast(w.total - {_spaces("m['1']")} + {_spaces("m['0']")} + 1 as bigint),
    'label', r.label, 'rule', r.rule, 'priority', r.priority, 'confidence', r.confidence, 'base', r.base))
"""

_SUPPRESSED = """
exists(w.found, y -> NOT y.base AND y.start <= x.start AND y.after >= x.after AND (
  y.priority > x.priority OR (y.priority = x.priority AND (
    y.after - y.start > x.after - x.start OR (y.after - y.start = x.after - x.start AND y.rule < x.rule)))))
"""


def license_detections(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chosen: list[Rule] | None = None,
    block_words: int = BLOCK_WORDS, margin: int = MARGIN,
) -> DataFrame:
    """One row per document: doc_id, n_words, detections (start and after in words from 0, label,
    rule, priority, confidence, base), in the order of their start."""
    if margin <= MAX_WORDS or block_words < margin:
        raise ValueError("a margin must be longer than any match, and a block no shorter than a margin")
    chosen = rules() if chosen is None else chosen
    gate = _gate(chosen)
    words = id_and_text(docs, id_col, text_col).select(
        "doc_id", F.regexp_replace(F.concat(F.lit(" "), "text", F.lit(" ")), GAP, " ").alias("words")
    )
    blocks = words.select(
        "doc_id", F.expr(f"cast({_spaces('words')} - 1 as bigint)").alias("n_words"),
        F.when(F.col("words").rlike(gate), F.regexp_extract_all("words", F.lit(rf"(?: [^ ]++){{1,{block_words}}}"), F.lit(0))).alias("blocks"),
    )
    read = blocks.select("doc_id", "n_words", F.expr(f"""
        transform(blocks, (b, i) -> named_struct(
          'first', cast(i * {block_words} as bigint), 'before', if(i = 0, 0, {margin}),
          'words', concat(if(i = 0, '', concat(' ', substring_index(blocks[i - 1], ' ', -{margin}))), b,
                          if(i + 1 < size(blocks), substring_index(blocks[i + 1], ' ', {margin + 1}), ''), ' ')))
    """).alias("blocks"))
    gated = read.withColumn("gate", F.lit(gate)).select("doc_id", "n_words", F.expr("""
        filter(transform(blocks, w -> named_struct('first', w.first, 'before', w.before, 'words', w.words,
          'keywords', array_distinct(transform(regexp_extract_all(w.words, gate, 1), k -> lower(k))))),
          w -> size(w.keywords) > 0)
    """).alias("blocks"))
    matched = gated.withColumn("rules", _table(chosen)).select("doc_id", "n_words", F.expr(f"""
        transform(transform(blocks, b -> named_struct('first', b.first, 'before', b.before, 'words', b.words,
            'total', {_spaces('b.words')} - 1, 'keywords', b.keywords)),
          w -> named_struct('first', w.first, 'before', w.before, 'found', flatten(transform(
            filter(rules, r -> arrays_overlap(r.keywords, w.keywords)), r -> {_MATCHES}))))
    """).alias("blocks"))
    kept = matched.select("doc_id", "n_words", F.expr(f"""
        flatten(transform(blocks, w -> transform(
          filter(w.found, x -> x.start >= w.before AND x.start < w.before + {block_words} AND (x.base OR NOT {_SUPPRESSED})),
          x -> named_struct('start', x.start - w.before + w.first, 'after', x.after - w.before + w.first, 'label', x.label,
            'rule', x.rule, 'priority', x.priority, 'confidence', x.confidence, 'base', x.base))))
    """).alias("detections"))
    return kept.select("doc_id", "n_words", F.coalesce(F.array_sort("detections"), F.expr(f"cast(array() as {_FOUND})")).alias("detections"))


def license_summary(detections: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, n_base (places of base phrases), first_word and last_word
    (their smallest and largest start), base_labels, labels, and score, the confidence of the
    surest detection (0 without any)."""
    base = F.filter("detections", lambda d: d["base"])
    names = lambda found: F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda d: d["label"]))), ",")
    starts = F.transform(base, lambda d: d["start"])
    return detections.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"), names(base).alias("base_labels"), names(F.col("detections")).alias("labels"),
        F.coalesce(F.array_max(F.transform("detections", lambda d: d["confidence"])), F.lit(0.0)).alias("score"),
    )
