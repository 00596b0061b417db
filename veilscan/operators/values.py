"""Known customer values: plain values by whole word, hashed values by token."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from veilscan.functions import fixed_values as fv, text
from veilscan.functions.patterns import sql_text
from veilscan.operators.detect import covered, suppression_flags
from veilscan.session import materialise
from veilscan.sources.units import explode_lines, with_file_type

LINE_KEY = ("repo_id", "path", "commit_id", "ts", "line_no", "off")
# A membership filter has about SLOTS_PER_VALUE bytes per known value, within these bounds.
SLOTS_PER_VALUE = 16
FILTER_SLOTS = (1 << 12, 1 << 22)
# Stretches of more words are looked at only where their first words are those of a known part.
START_WORDS = 2


def value_lines(units: DataFrame, require_reason: bool = False) -> DataFrame:
    """Lines for value matching: every line of every text file, however long, with
    the categories that inline directives cover there."""
    guarded = with_file_type(units).filter(F.col("file_type") != "BINARY")
    keep = guarded.select("repo_id", "path", "commit_id", "ts", "content")
    lines = explode_lines(keep).withColumn("off", suppression_flags(require_reason))
    return lines.drop("prev_line").filter(F.col("line") != "")


WORD_CHAR = r"[\p{L}\p{Nd}_]"
# What lies between the words of a line and the words, in turns: words have the even places from 2 on.
RUNS = (
    f"concat(if(line rlike {sql_text('^' + WORD_CHAR)}, array(''), cast(array() as array<string>)), "
    f"regexp_extract_all(line, {sql_text(fv.WORD_TOKEN + '|' + fv.NON_WORD_RUN)}, 0))"
)


class Membership:
    """A filter of bounded size over the known pieces, to test before a piece leaves its task: it
    holds one byte per slot, 1 where the hash of a known piece falls. Whatever it lets through by
    chance (about one in ``SLOTS_PER_VALUE`` up to 2^18 pieces, more beyond) the join drops."""

    def __init__(self, known: DataFrame, piece: str = "piece") -> None:
        self.piece = piece
        least, most = FILTER_SLOTS
        rows = known.count()
        self.slots = min(most, max(least, 1 << (SLOTS_PER_VALUE * rows).bit_length()))
        slot = F.expr(self._slot(piece))
        found = known.groupBy(F.bitmap_bucket_number(slot).alias("bucket")).agg(
            F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits")
        )
        held = bytearray(self.slots + 1 + (1 << 15))
        for r in found.collect():  # at most 129 rows of 4 kB
            # Bucket k has the slots from 32768 * (k - 1) + 1 on; slots are numbered from 1 here.
            at = 32768 * (r["bucket"] - 1) + 1
            held[at : at + (1 << 15)] = b"".join(_BITS_OF[b] for b in r["bits"])
        self.column = F.lit(bytearray(held[1 : self.slots + 1]))

    def _slot(self, piece: str) -> str:
        return f"pmod(xxhash64({piece}), {self.slots}L) + 1"

    def test(self, piece: str) -> str:
        """For a row with this filter in the column ``members``."""
        return f"substring(members, cast({self._slot(piece)} as int), 1) = X'01'"

    def column_test(self) -> Column:
        """For a row with the columns of a known piece."""
        return F.substring(self.column, F.expr(f"cast({self._slot(self.piece)} as int)"), F.lit(1)) == F.expr("X'01'")


_BITS_OF = [bytes(b >> k & 1 for k in range(8)) for b in range(256)]


def _core(value: Column) -> Column:
    """The part of a value from its first to its last word character, as it must
    appear in a line between word borders; a value without words is its own core."""
    core = F.regexp_extract(value, rf"{WORD_CHAR}(?:(?s:.*){WORD_CHAR})?", 0)
    return F.when(core != "", core).otherwise(value)


def _parts(known: DataFrame) -> DataFrame:
    """The stretches by which lines find a value: its first and its last 2^j words, for the
    largest power within its number of words. The two overlap or touch, so both at the right
    distance are the whole core. Values of 2^j words, or of none, are one stretch."""
    runs = F.regexp_extract_all(F.col("core"), F.lit(f"{fv.WORD_TOKEN}|{fv.NON_WORD_RUN}"), F.lit(0))
    words = F.size(text.tokens(F.col("core")))
    marked = (
        known.withColumn("runs", runs).withColumn("words", words)
        .withColumn("size", F.when(words > 0, F.pow(F.lit(2), F.floor(F.log2(words))).cast("int")).otherwise(0))
        .withColumn("delta", 2 * (F.col("words") - F.col("size")))
    )
    rule = ("attribute", "value", "severity", "category", "core", "size")
    whole = marked.filter("delta = 0").select(*rule, F.col("core").alias("piece"), F.lit(0).alias("back"), F.lit("whole").alias("role"))
    ends = marked.filter("delta > 0")
    width = 2 * F.col("size") - 1
    head = ends.select(*rule, F.array_join(F.slice("runs", F.lit(1), width), "").alias("piece"), F.lit(0).alias("back"), F.lit("head").alias("role"))
    tail = ends.select(*rule, F.array_join(F.slice("runs", F.col("delta") + 1, width), "").alias("piece"), F.col("delta").alias("back"), F.lit("tail").alias("role"))
    return whole.unionByName(head).unionByName(tail)


def _filtered(parts: DataFrame) -> DataFrame:
    """What lines test their stretches against: the parts and, of the longer ones, the beginning,
    so that a long stretch is put together only where its first two words are known."""
    runs = F.regexp_extract_all(F.col("piece"), F.lit(f"{fv.WORD_TOKEN}|{fv.NON_WORD_RUN}"), F.lit(0))
    long = parts.filter(F.col("size") > START_WORDS)
    starts = long.select(F.array_join(F.slice(runs, 1, 2 * START_WORDS - 1), "").alias("piece"))
    return parts.select("piece").unionByName(starts)


class Needs(NamedTuple):
    """Which powers of two of words occur, how long single words are, the lengths of values without
    words, and how many characters values have before and after their cores."""

    words: list[int]
    shortest: int
    longest: int
    symbols: list[int]
    before: int
    after: int


def _needs(parts: DataFrame) -> Needs:
    at = F.instr(F.col("value"), F.col("core")) - 1
    single = F.when(F.col("size") == 1, F.length("piece"))
    row = parts.agg(
        F.array_sort(F.collect_set(F.when(F.col("size") > 0, F.col("size")))).alias("words"),
        F.coalesce(F.min(single), F.lit(0)).alias("shortest"), F.coalesce(F.max(single), F.lit(0)).alias("longest"),
        F.array_sort(F.collect_set(F.when(F.col("size") == 0, F.length("value")))).alias("symbols"),
        F.coalesce(F.max(at), F.lit(0)).alias("before"),
        F.coalesce(F.max(F.length("value") - F.length("core") - at), F.lit(0)).alias("after"),
    ).first()
    return Needs(**row.asDict())


def _promising(members: Membership, needs: Needs) -> str:
    """Could a part of a known value begin in this run? Of longer parts the first words are sought."""
    tests = []
    if 1 in needs.words:  # the length is tested before the hash
        tests.append(f"(place % 2 = 0 AND length(run) BETWEEN {needs.shortest} AND {needs.longest} AND {members.test('run')})")
    if max(needs.words, default=0) >= START_WORDS:
        start = f"array_join(slice(runs, place, {2 * START_WORDS - 1}), '')"
        tests.append(f"(place % 2 = 0 AND place + {2 * (START_WORDS - 1)} <= size(runs) AND {members.test(start)})")
    if needs.symbols:
        tests.append(f"(place % 2 = 1 AND length(run) >= {min(needs.symbols)})")
    return " OR ".join(tests) or "false"


def _pieces(members: Membership, needs: Needs) -> Column:
    """The stretches that begin in a run, could be a part of a known value and pass its filter, each
    with its place and the few characters before and after it that decide whether the value stands
    there: runs of as many words as some part has, with what lies between them; and, for values
    without words, the stretches of their length between words. The line itself stays behind."""
    parts = []
    for k in needs.words:
        core = f"array_join(slice(near, 1, {2 * k - 1}), '')"
        right = f"left(concat(coalesce(get(near, {2 * k - 1}), ''), coalesce(get(near, {2 * k}), '')), {needs.after + 1})"
        parts.append(
            f"CASE WHEN place % 2 = 0 AND size(near) >= {2 * k - 1} AND {members.test(core)} THEN array(named_struct("
            f"'piece', {core}, 'place', cast(place as bigint), 'left', before, 'right', {right})) END"
        )
    for n in needs.symbols:
        # A stretch between words, with the last character before and the first one after it.
        stretch = f"substr(near[0], i, {n})"
        parts.append(
            f"CASE WHEN place % 2 = 1 AND length(near[0]) >= {n} THEN "
            f"transform(filter(sequence(1, length(near[0]) - {n - 1}), i -> {members.test(stretch)}), "
            f"i -> named_struct('piece', {stretch}, 'place', -(place * 2147483647L + i), "
            "'left', right(if(i > 1, substr(near[0], i - 1, 1), before), 1), "
            f"'right', left(if(i + {n} <= length(near[0]), substr(near[0], i + {n}, 1), coalesce(get(near, 1), '')), 1))) END"
        )
    empty = "cast(array() as array<struct<piece:string,place:bigint,left:string,right:string>>)"
    filled = [f"coalesce({p}, {empty})" for p in parts]
    return F.expr(f"concat({', '.join([empty, *filled])})")


def stands_whole(value: Column, piece: Column, left: Column, right: Column) -> Column:
    """Given its core in a line and what lies around: does the value stand there, with no letter,
    digit or ``_`` at either side?"""
    at = F.instr(value, piece) - 1
    head = F.substring(value, F.lit(1), at)
    tail = F.substring(value, at + F.length(piece) + 1, F.length(value))
    before = F.substring(left, F.lit(1), F.length(left) - F.length(head))
    after = F.substring(right, F.length(tail) + 1, F.length(right))
    return (
        left.endswith(head) & right.startswith(tail)
        & ~before.rlike(f"{WORD_CHAR}$") & ~after.rlike(f"^{WORD_CHAR}")
    )


def detect_values(units: DataFrame, values: DataFrame, require_reason: bool = False) -> DataFrame:
    """Whole-word occurrences of (attribute, value): one finding per value and line.

    A line lists its runs of 1, 2, 4, … words, up to the longest part of a value; those that pass
    a filter of the parts (see ``Membership``) meet the parts in an equi-join on the whole run. No line is paired with values it does not hold, even
    where many values share a word, and no run carries its line: the work is linear in the text
    and grows with the logarithm of the longest value. ``values`` may carry the severity and
    category of its attribute.
    """
    known = _with_rule_columns(values).filter(F.col("value") != "").distinct()
    parts = materialise(_parts(known.withColumn("core", _core(F.col("value")))), "values")
    pieces = _line_pieces(units, parts, require_reason)
    whole = stands_whole(F.col("value"), F.col("core"), F.col("left"), F.col("right"))
    # A part that is the whole core is judged where it stands, before anything is shuffled. Heads and tails of a value belong together if the tail stands as far back as it should.
    here = _meet(pieces, parts).filter((F.col("role") != "whole") | whole).groupBy(
        *LINE_KEY, "attribute", "value", "severity", "category", "core", (F.col("place") - F.col("back")).alias("place")
    ).agg(
        F.max(F.when(F.col("role") != "tail", F.col("left"))).alias("left"),
        F.max(F.when(F.col("role") != "head", F.col("right"))).alias("right"),
    )
    met = here.filter(F.col("left").isNotNull() & F.col("right").isNotNull()).filter(whole)
    return _as_findings(met.drop("left", "right", "place").distinct(), F.col("value"))


def _line_pieces(units: DataFrame, parts: DataFrame, require_reason: bool) -> DataFrame:
    """One row per run, most of which the filter drops at once: a test per row is compiled, one per
    element of an array would be interpreted."""
    members, needs = Membership(_filtered(parts)), _needs(parts)
    lines = value_lines(units, require_reason).withColumns({"runs": F.expr(RUNS), "members": members.column})
    # Of a bare column Spark would first ask for its size, and take the line apart twice for it.
    runs = F.slice("runs", F.lit(1), F.size("runs"))
    before = f"right(concat(coalesce(get(runs, place - 3), ''), coalesce(get(runs, place - 2), '')), {needs.before + 1})"
    near = f"slice(runs, place, {2 * max(needs.words, default=0) + 2})"
    return (
        lines.select(*LINE_KEY, "runs", "members", F.posexplode(runs).alias("pos", "run"))
        .withColumn("place", F.col("pos") + 1).filter(_promising(members, needs))
        .select(*LINE_KEY, "members", "place", F.expr(before).alias("before"), F.expr(near).alias("near"))
        .select(*LINE_KEY, F.explode(_pieces(members, needs)).alias("p"))
        .select(*LINE_KEY, "p.*")
    )


def _meet(pieces: DataFrame, known: DataFrame) -> DataFrame:
    """Join on ``piece``. ``known`` is a stored table, so Spark knows its size in bytes: below the
    session's threshold it is broadcast, beyond the narrow pieces meet it in a shuffle join whose
    skewed partitions adaptive execution splits. The text is read once either way."""
    return pieces.join(known, "piece")


def detect_hashed_values(
    units: DataFrame,
    hashes: DataFrame,
    pepper: str = "",
    min_length: int = fv.VALUE_MIN_LENGTH,
    require_reason: bool = False,
) -> DataFrame:
    """Tokens whose peppered hash is stored: one finding per occurrence. ``hashes``
    holds (attribute, value_hash) and optionally severity and category."""
    known = _with_rule_columns(hashes.withColumnRenamed("value_hash", "piece")).distinct()
    known = materialise(known, "hashes")
    return _as_findings(_meet(_hashed_tokens(units, known, pepper, min_length, require_reason), known), None)


def _hashed_tokens(
    units: DataFrame, known: DataFrame, pepper: str, min_length: int, require_reason: bool
) -> DataFrame:
    """The tokens whose hash passes the filter of the known ones, by hash and redacted text."""
    members = Membership(known)
    return (
        value_lines(units, require_reason)
        .select(*LINE_KEY, F.explode(text.tokens(F.col("line"))).alias("token"))
        .filter(F.length("token") >= min_length)
        .withColumns({"piece": text.value_hash(F.col("token"), pepper), "members": members.column})
        .filter(members.test("piece"))
        .select(*LINE_KEY, "piece", text.redact(F.col("token")).alias("redacted"))
    )


def _with_rule_columns(values: DataFrame) -> DataFrame:
    out = values
    if "severity" not in out.columns:
        out = out.withColumn("severity", F.lit("HIGH"))
    if "category" not in out.columns:
        out = out.withColumn("category", F.lit("PII"))
    keep = ["attribute", "value" if "value" in out.columns else "piece", "severity", "category"]
    return out.select(*keep)


def _as_findings(found: DataFrame, value: Column | None) -> DataFrame:
    redacted = F.col("redacted") if value is None else text.redact(value)
    return found.filter(~covered("off", "category")).select(
        "repo_id",
        F.lit(fv.VALUES_DETECTOR).alias("detector_id"),
        "category",
        "severity",
        F.col("attribute").alias("rule_id"),
        "path",
        "line_no",
        redacted.alias("redacted_match"),
        "commit_id",
        "ts",
        F.lit(False).alias("verified"),
    )
