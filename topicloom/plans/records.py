"""Queries on uploaded records (problem 1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicloom.operators.records import parse_records, read_formats, typed_structs
from topicloom.session import table


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "raw_lines").where(F.coalesce(F.col("line_no"), F.lit(2)) > 1)
    return parse_records(lines, read_formats(table(spark, sf_dir, "upload_formats")))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that break their format."""
    return _parsed(spark, sf_dir).where("reason is not null").select("line_id")


def p1_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that break their format, with the reason."""
    return _parsed(spark, sf_dir).where("reason is not null").select("line_id", "format_id", "reason", "detail")


def p1_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The valid records as typed rows, one struct column for each format."""
    formats = read_formats(table(spark, sf_dir, "upload_formats"))
    lines = table(spark, sf_dir, "raw_lines").where(F.coalesce(F.col("line_no"), F.lit(2)) > 1)
    return typed_structs(parse_records(lines, formats), formats)


QUERIES = {"p1_found": p1_found, "p1_rejected": p1_rejected, "p1_valid": p1_valid}

_INT = "regexp_full_match({0}, '[+-]?[0-9]+') AND try_cast({0} AS {1}) IS NOT NULL"
_FITS = f"""CASE kinds[i] WHEN 'int' THEN {_INT.format('vals[i]', 'INTEGER')} WHEN 'bigint' THEN {_INT.format('vals[i]', 'BIGINT')}
 WHEN 'double' THEN regexp_full_match(vals[i], '[+-]?(?:[0-9]+\\.?[0-9]*|\\.[0-9]+)(?:[eE][+-]?[0-9]+)?')
 WHEN 'timestamp' THEN regexp_full_match(vals[i], '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}} [0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}') AND try_cast(vals[i] AS TIMESTAMP) IS NOT NULL ELSE true END"""
_FIELD = """'(?s)("(?:[^"]|"")*"|[^"' || d || ']*)'"""
_CHECKED = f"""WITH f AS (SELECT format_id, CASE delimiter WHEN 'comma' THEN ',' WHEN 'tab' THEN chr(9) WHEN 'semicolon' THEN ';' ELSE delimiter END AS d, column_names AS names, column_types AS kinds FROM upload_formats),
r AS (SELECT line_id, l.format_id, regexp_replace(text, '\\r$', '') AS t, d, names, kinds FROM raw_lines l LEFT JOIN f ON f.format_id = l.format_id WHERE coalesce(line_no, 2) > 1),
s AS (SELECT *, regexp_full_match(t, {_FIELD} || '(?:' || d || {_FIELD} || ')*') AS shaped FROM r),
v AS (SELECT *, CASE WHEN shaped THEN list_transform(regexp_extract_all(t || d, {_FIELD} || d, 1), lambda x: CASE WHEN starts_with(x, '"') THEN replace(substr(x, 2, length(x) - 2), '""', '"') ELSE x END) END AS vals FROM s),
w AS (SELECT *, CASE WHEN len(vals) = len(kinds) THEN list_filter(range(1, len(kinds) + 1), lambda i: vals[i] <> '' AND NOT ({_FITS}))[1] END AS wrong FROM v),
c AS (SELECT line_id, format_id, CASE WHEN d IS NULL THEN 'unknown_format' WHEN t IS NULL THEN 'empty_record' WHEN NOT shaped THEN 'broken_quoting' WHEN len(vals) <> len(kinds) THEN 'field_count'
  WHEN vals[1] = '' THEN 'empty_first_field' WHEN wrong IS NOT NULL THEN 'bad_' || kinds[wrong] END AS reason,
 CASE WHEN d IS NULL OR t IS NULL OR NOT shaped THEN NULL WHEN len(vals) <> len(kinds) THEN len(vals) || ' instead of ' || len(kinds) WHEN vals[1] = '' THEN names[1] WHEN wrong IS NOT NULL THEN names[wrong] || ': ' || substr(vals[wrong], 1, 80) END AS detail FROM w)
"""
SQL = {
    "p1_found": _CHECKED + "SELECT line_id FROM c WHERE reason IS NOT NULL",
    "p1_rejected": _CHECKED + "SELECT line_id, format_id, reason, detail FROM c WHERE reason IS NOT NULL",
}
