"""Known-value sources: uploads, landed JSON responses, profiles, hashed storage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from veilscan.functions import fixed_values as fv, text
from veilscan.operators.lookups import keep_known, lookup_join
from veilscan.session import materialise

OBJECT = "map<string,variant>"


def read_key_values(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) pairs of an upload of one file or many, each read by its own kind: JSON when its
    first filled line starts with a bracket or brace, else CSV, whose first line goes if it holds
    just the words key and value. JSON lines (every filled line is a document of its own) and CSV
    files of any size are read in splits; one JSON document over several lines is one row by nature."""
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), place.alias("_place"))
    filled = F.trim("value") != ""
    first = F.min_by(F.when(filled, F.col("value")), F.when(filled, F.col("_place")))
    documents = F.bool_and(~filled | F.try_parse_json("value").isNotNull())
    kind = F.when(~first.rlike(r"^\s*[\[{]"), "csv").when(documents, "lines").otherwise("document")
    files = lines.groupBy("_file").agg(F.min("_place").alias("_first"), F.coalesce(kind, F.lit("csv")).alias("_kind"))
    files = materialise(files, "upload-files")
    known = lookup_join(lines, files, ["_file"], "inner", stored=True)
    header = (F.col("_place") == F.col("_first")) & _is_header(F.col("value"))
    found = key_values_of_lines(known.filter((F.col("_kind") == "csv") & ~header), F.col("value"), drop_headers=False)
    found = found.unionByName(key_values_of_json(known.filter((F.col("_kind") == "lines") & filled), F.col("value")))
    whole = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("_file"))
    whole = lookup_join(whole, files.filter("_kind = 'document'").select("_file"), ["_file"], "left_semi", stored=True)
    return found.unionByName(key_values_of_json(whole, F.col("value")))


def _cells(line: Column) -> tuple[Column, Column]:
    """The two columns of a CSV line."""
    cols = F.split(F.trim(F.regexp_replace(line, r"\r$", "")), "[,;]", 2)
    return _unquoted(F.trim(F.get(cols, F.lit(0)))), _unquoted(F.trim(F.get(cols, F.lit(1))))


def _is_header(line: Column) -> Column:
    key, value = _cells(line)
    return F.coalesce((F.lower(F.trim(key)) == "key") & (F.lower(F.trim(value)) == "value"), F.lit(False))


def key_values_of_lines(rows: DataFrame, line: Column, drop_headers: bool = True) -> DataFrame:
    """CSV lines ``key,value`` or ``key;value``, optionally quoted. Lines without two filled
    columns are left out, and unless told otherwise lines of just the words key and value."""
    key, value = _cells(line)
    pairs = rows.select(key.alias("key"), value.alias("value"))
    header = (F.lower("key") == "key") & (F.lower("value") == "value")
    return _filled(pairs.filter(~header) if drop_headers else pairs)


def _unquoted(value: Column) -> Column:
    quoted = (F.length(value) >= 2) & value.startswith('"') & value.endswith('"')
    return F.when(quoted, F.substr(value, F.lit(2), F.length(value) - 2)).otherwise(value)


def _filled(pairs: DataFrame) -> DataFrame:
    return pairs.filter(F.col("key").rlike(r"\S") & F.col("value").rlike(r"\S")).select(
        F.trim("key").alias("key"), "value"
    )


def key_values_of_json(rows: DataFrame, document: Column) -> DataFrame:
    """Arrays of {key, value}, arrays of objects, or one object."""
    is_array = document.rlike(r"^\s*\[")
    objects = rows.select(
        F.explode(
            F.when(is_array, F.from_json(document, f"array<{OBJECT}>")).otherwise(
                F.array(F.from_json(document, OBJECT))
            )
        ).alias("o")
    )
    pair_like = F.map_contains_key("o", "key") & F.map_contains_key("o", "value")
    one_pair = F.array(
        F.struct(_scalar(F.col("o")["key"]).alias("key"), _scalar(F.col("o")["value"]).alias("value"))
    )
    all_pairs = F.transform(
        F.map_entries("o"), lambda e: F.struct(e["key"].alias("key"), _scalar(e["value"]).alias("value"))
    )
    return _filled(objects.select(F.inline(F.when(pair_like, one_pair).otherwise(all_pairs))))


def _scalar(value: Column) -> Column:
    """Text of a JSON scalar; null for objects, arrays and JSON null."""
    nested = F.schema_of_variant(value).rlike("^(?:OBJECT|ARRAY)")
    return F.when(~nested, F.try_variant_get(value, "$", "string"))


def records_at_path(rows: DataFrame, document: Column, path: str | None = None) -> DataFrame:
    """Records of JSON documents under a path such as ``$.a.b[*]`` (default ``$[*]``),
    as JSON text in ``record``. One object is one record; a missing path gives none."""
    expr = (path or "").strip() or "$[*]"
    expr = expr.removeprefix("$").removesuffix("[*]")
    steps = "".join(f".{s.strip()}" for s in expr.split(".") if s.strip())
    node = F.get_json_object(document, f"${steps}") if steps else document
    found = F.trim(node)
    records = F.when(found.startswith("["), F.from_json(found, "array<string>")).when(
        found.isNotNull() & (found != "null"), F.array(found)
    )
    return rows.select("*", F.explode(records).alias("record"))


def load_value_columns(
    records: DataFrame, attributes: list[str], min_length: int = fv.VALUE_MIN_LENGTH
) -> DataFrame:
    """Distinct (attribute, value) of the checked attributes; short values left out."""
    pairs = F.array(
        *[
            F.struct(F.lit(a).alias("attribute"), F.col(a).cast("string").alias("value"))
            for a in attributes
        ]
    )
    return (
        records.select(F.inline(pairs))
        .filter(F.col("value").isNotNull() & (F.length("value") >= min_length))
        .distinct()
    )


def load_record_values(
    records: DataFrame, attributes: list[str], min_length: int = fv.VALUE_MIN_LENGTH
) -> DataFrame:
    """The same for records as JSON text in ``record``: only scalar values count,
    nested objects and arrays do not."""
    fields = F.from_json("record", "map<string,variant>")
    pairs = F.array(
        *[F.struct(F.lit(a).alias("attribute"), fields[a].alias("v")) for a in attributes]
    )
    return (
        records.select(F.inline(pairs))
        .select("attribute", _scalar(F.col("v")).alias("value"))
        .filter(F.col("value").isNotNull() & (F.length("value") >= min_length))
        .distinct()
    )


def checked_values(values: DataFrame, attribute_rules: DataFrame, sources: DataFrame) -> DataFrame:
    """``values`` (source_id, attribute, value or value_hash) of the enabled ``sources`` (id,
    enabled) and of their checked attributes, with each attribute's severity and category as its
    rule (source_id, field, checked, severity, category) has them; attributes without a rule are
    checked as MEDIUM personal data."""
    enabled = sources.filter("enabled").select(F.col("id").alias("source_id")).distinct()
    rules = attribute_rules.select("source_id", F.col("field").alias("attribute"), "checked", "severity", "category")
    ruled = lookup_join(keep_known(values, enabled, ["source_id"]), rules, ["source_id", "attribute"], "left")
    return ruled.filter(F.coalesce("checked", F.lit(True))).drop("checked").withColumns(
        {"severity": F.coalesce("severity", F.lit("MEDIUM")), "category": F.coalesce("category", F.lit("PII"))}
    )


def profile_source(records: DataFrame, order_by: str) -> DataFrame:
    """Reachable, number of records, and per attribute a masked sample from the first
    record in the given order."""
    names = [c for c in records.columns]
    samples = [
        F.struct(
            F.lit(c).alias("attribute"),
            text.mask_sample(F.min_by(F.col(c).cast("string"), order_by)).alias("sample"),
        )
        for c in names
    ]
    counted = records.agg(F.count("*").alias("records"), F.array(*samples).alias("s"))
    # Without records there is one row, and no attribute.
    return counted.select(
        F.lit(True).alias("reachable"), "records", F.inline_outer(F.when(F.col("records") > 0, F.col("s")))
    )


def hash_values(
    pairs: DataFrame, pepper: str = "", min_length: int = fv.VALUE_MIN_LENGTH
) -> DataFrame:
    """Distinct (attribute, value_hash); the plain values end here, before any
    shuffle."""
    return (
        pairs.filter(F.length("value") >= min_length)
        .select(
            F.col("key").alias("attribute"), text.value_hash(F.col("value"), pepper).alias("value_hash")
        )
        .distinct()
    )


def count_values(hashes: DataFrame) -> DataFrame:
    return hashes.groupBy("attribute").agg(F.count("*").alias("values"))


def default_attribute_rules(hashes: DataFrame, rules: DataFrame, source_id: str) -> DataFrame:
    """The rules of a source with a default one for every attribute that has none."""
    existing = rules.filter(F.col("source_id") == source_id)
    fresh = lookup_join(
        hashes.select(F.col("attribute").alias("field")).distinct(), existing.select("field"), ["field"], "left_anti"
    ).select(
        F.lit(source_id).alias("source_id"),
        "field",
        F.lit(True).alias("checked"),
        F.lit("MEDIUM").alias("severity"),
        F.lit("PII").alias("category"),
    )
    return existing.select(*fresh.columns).unionByName(fresh)


def replace_values(hashes: DataFrame, source_id: str, path: str) -> None:
    """Store the hashes of a source; a new upload replaces only that source."""
    (
        hashes.withColumn("source_id", F.lit(source_id))
        .write.option("partitionOverwriteMode", "dynamic")
        .partitionBy("source_id")
        .mode("overwrite")
        .parquet(path)
    )
