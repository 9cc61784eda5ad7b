"""Run-log scan and append (SRC2, SNK8) with secret redaction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from lapak.functions.text import or_blank
from lapak.functions.urls import DATABASE_URL_FIELDS, SENSITIVE_FIELD_WORDS, redact_url
from lapak.functions.values import parse_iso
from lapak.schemas import RUN_LOG


def parse_run_log_lines(lines: DataFrame, since=None) -> DataFrame:
    """JSON lines (value, file_name, line) to run records; broken and non-object lines are skipped.

    Records older than ``since`` are left out; records without a readable time stay.
    """
    variant = F.try_parse_json("value")
    is_object = F.coalesce(F.schema_of_variant(variant).startswith("OBJECT"), F.lit(False))
    # The generator parses a line once, however many fields are used later.
    rows = lines.filter(is_object).select(
        "file_name", "line", F.inline(F.array(F.from_json("value", RUN_LOG))))
    raw = F.coalesce(F.nullif("logged_at", F.lit("")), F.nullif("finished_at", F.lit("")), F.lit(""))
    rows = rows.withColumn("log_time", raw).withColumn("logged_time", parse_iso(raw))
    if since is not None:
        limit = F.lit(since).cast("timestamp_ntz")
        rows = rows.filter(F.col("logged_time").isNull() | (F.col("logged_time") >= limit))
    return rows


def scan_run_logs(spark: SparkSession, path: str, since=None) -> DataFrame:
    """SRC2: all JSON-lines files (.json, .jsonl) of a folder, those of ``append_run_log`` included.

    Lines are numbered by block and offset, which follows the file order.
    """
    text = spark.read.option("pathGlobFilter", "*.json*").text(path).select(
        "value", F.col("_metadata.file_name").alias("file_name"),
        F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_offset"))
    # Offsets grow within a file block; the block start puts the blocks of a file in order.
    return parse_run_log_lines(text.withColumn("line", F.struct("_block", "_offset")), since)


def redacted(column: Column, kind: T.DataType, name: str = "") -> Column:
    """a column with secrets hidden at every depth of its declared type."""
    key = name.lower()
    if isinstance(kind, T.StructType):
        return F.when(column.isNotNull(), F.struct(*[
            redacted(column[f.name], f.dataType, f.name).alias(f.name) for f in kind.fields]))
    if isinstance(kind, T.ArrayType):
        return F.transform(column, lambda x: redacted(x, kind.elementType))
    if isinstance(kind, T.MapType) and isinstance(kind.valueType, T.StringType):
        return F.transform_values(column, _redacted_entry)
    if key in DATABASE_URL_FIELDS:
        return redact_url(column.cast("string"))
    if any(word in key for word in SENSITIVE_FIELD_WORDS):
        return F.when(column.isNotNull(), F.lit("***"))
    return column


def _redacted_entry(key: Column, value: Column) -> Column:
    low = F.lower(key)
    secret = F.lit(False)
    for word in SENSITIVE_FIELD_WORDS:
        secret = secret | low.contains(word)
    return F.when(low.isin(*DATABASE_URL_FIELDS), redact_url(value)).when(
        secret & value.isNotNull(), F.lit("***")).otherwise(value)


def redact_events(events: DataFrame) -> DataFrame:
    """F24 over all columns of a table of events."""
    return events.select(*[redacted(F.col(f.name), f.dataType, f.name).alias(f.name) for f in events.schema.fields])


def append_run_log(events: DataFrame, path: str, logged_at) -> None:
    """SNK8: append redacted events as JSON lines with their log time first."""
    stamped = redact_events(events).drop("logged_at")
    stamped.select(F.lit(logged_at).cast("string").alias("logged_at"), "*").write.mode("append").option(
        "ignoreNullFields", "false").json(path)


def log_order(rows: DataFrame) -> DataFrame:
    return rows.orderBy(or_blank(F.col("log_time")), "file_name", "line")
