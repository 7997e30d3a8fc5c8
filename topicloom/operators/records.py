"""Delimited records: typed rows for the valid ones, a reason for each of the others.

Blocks of records go through a columnar parser. A block that fails is halved again and again until what remains is
small enough for the strict parser, which names the fault of each record. A record is

* fields divided by the format's delimiter, ``n_columns`` of them;
* a field is either unquoted, without any double quote, or enclosed in double quotes with inner quotes doubled and
  nothing between the closing quote and the next delimiter or the end;
* one carriage return at the end belongs to the line end;
* the first field is not empty; any other empty field is null;
* each value fits its column's type.

Defined cases: a null text is ``empty_record``; a format_id that is null or not in the formats is ``unknown_format``;
an empty table gives an empty result; repeated rows stay repeated; columns other than the key, format and text are
neither read nor returned, so their names can't clash.
"""

from __future__ import annotations

import io
import re
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import csv
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DELIMITERS = {"comma": ",", "tab": "\t", "semicolon": ";"}
SPARK_TYPES = {"bigint": "bigint", "int": "int", "double": "double", "timestamp": "timestamp_ntz", "string": "string"}
#: What a value of a type looks like; whether it is in range is tested apart.
VALUE = {
    "int": r"[+-]?[0-9]+",
    "bigint": r"[+-]?[0-9]+",
    "double": r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?",
    "timestamp": r"[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}",
}
BITS = {"int": 31, "bigint": 63}
#: Blocks of this many records or fewer aren't halved further.
SMALL = 16
#: Formats are configuration held by every task.
MAX_FORMATS = 10_000


@dataclass(frozen=True)
class Format:
    """One upload format; ``shape`` matches the records whose quoting and field count are right."""

    format_id: int
    delimiter: str
    names: tuple[str, ...]
    types: tuple[str, ...]

    @property
    def shape(self) -> str:
        d = re.escape(self.delimiter)
        field = f'(?:"(?:[^"]|"")*"|[^"{d}]*)'
        return f"^{field}(?:{d}{field}){{{len(self.names) - 1}}}$" if len(self.names) > 1 else f"^{field}$"


def read_formats(formats: DataFrame) -> list[Format]:
    """The formats, at most ``MAX_FORMATS``: a larger table is refused, since each task holds all of them."""
    rows = formats.select("format_id", "delimiter", "column_names", "column_types").limit(MAX_FORMATS + 1).collect()
    if len(rows) > MAX_FORMATS:
        raise ValueError(f"more than {MAX_FORMATS} formats")
    return [Format(r.format_id, DELIMITERS.get(r.delimiter, r.delimiter), tuple(r.column_names), tuple(r.column_types)) for r in rows if r.format_id is not None]


def fits(value: str, kind: str) -> bool:
    """Whether a non-empty value is one of its type."""
    if kind == "string":
        return True
    if not re.fullmatch(VALUE[kind], value):
        return False
    if kind in BITS:
        return len(value) < 40 and -(2 ** BITS[kind]) <= int(value) < 2 ** BITS[kind]
    if kind == "timestamp":
        try:
            datetime.strptime(value, "%Y-%m-%d %H:%M:%S")
        except ValueError:
            return False
    return True


def fields_of(text: str, delimiter: str) -> list[str] | None:
    """The fields of one record, or None where its quoting is broken."""
    out, at, end = [], 0, len(text)
    while True:
        if at < end and text[at] == '"':
            close = at + 1
            while True:
                close = text.find('"', close)
                if close < 0:
                    return None
                if text[close + 1 : close + 2] != '"':
                    break
                close += 2
            out.append(text[at + 1 : close].replace('""', '"'))
            at = close + 1
            if at < end and text[at] != delimiter:
                return None
        else:
            stop = text.find(delimiter, at)
            stop = end if stop < 0 else stop
            if '"' in text[at:stop]:
                return None
            out.append(text[at:stop])
            at = stop
        if at >= end:
            return out
        at += 1


def diagnose(text: str | None, form: Format | None) -> tuple[list[str | None] | None, str | None, str | None]:
    """(fields, reason, detail) of one record; the reason is None where it is valid."""
    if form is None:
        return None, "unknown_format", None
    if text is None:
        return None, "empty_record", None
    values = fields_of(text.removesuffix("\r"), form.delimiter)
    if values is None:
        return None, "broken_quoting", None
    if len(values) != len(form.names):
        return None, "field_count", f"{len(values)} instead of {len(form.names)}"
    if values[0] == "":
        return None, "empty_first_field", form.names[0]
    for value, name, kind in zip(values, form.names, form.types, strict=True):
        if value != "" and not fits(value, kind):
            return None, f"bad_{kind}", f"{name}: {value[:80]}"
    return [v or None for v in values], None, None


def _columns(texts: pa.Array, form: Format) -> list[pa.Array] | None:
    """The columns of a block as text if every record in it is valid, else None."""
    if texts.null_count or not pc.all(pc.match_substring_regex(texts, form.shape)).as_py():
        return None
    try:
        got = csv.read_csv(
            io.BytesIO("\n".join(texts.to_pylist()).encode()),
            csv.ReadOptions(column_names=list(map(str, range(len(form.names)))), use_threads=False, block_size=1 << 28),
            csv.ParseOptions(delimiter=form.delimiter, newlines_in_values=True, ignore_empty_lines=False),
            csv.ConvertOptions(column_types={str(i): pa.string() for i in range(len(form.names))}, strings_can_be_null=True, quoted_strings_can_be_null=True, null_values=[""]),
        )
        if got.num_rows != len(texts) or got.column(0).null_count:
            return None
        columns = [c.combine_chunks() for c in got.columns]
        for column, kind in zip(columns, form.types, strict=True):
            column = column.drop_null()
            if kind == "string" or not len(column):
                continue
            if not pc.all(pc.match_substring_regex(column, f"^(?:{VALUE[kind]})$")).as_py():
                return None
            if kind in BITS:
                pc.replace_substring_regex(column, r"^\+", "").cast(pa.int32() if kind == "int" else pa.int64())
            elif kind == "timestamp":
                column.cast(pa.timestamp("s"))
        return columns
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError):
        return None


def _lists(columns: list[pa.Array]) -> pa.Array:
    """The rows of a block's columns as lists, without leaving Arrow."""
    rows, width = len(columns[0]), len(columns)
    order = np.arange(rows * width).reshape(width, rows).T.ravel()
    return pa.ListArray.from_arrays(pa.array(np.arange(0, rows * width + 1, width), pa.int32()), pa.concat_arrays(columns).take(pa.array(order)))


def _parse(texts: pa.Array, form: Format | None) -> Iterator[tuple[int, pa.Array, list, list]]:
    """(first record, fields, reasons, details) of the records, block by block."""
    todo = [(0, len(texts))]
    while todo:
        a, b = todo.pop()
        block = texts.slice(a, b - a)
        columns = _columns(block, form) if form is not None else None
        if columns is not None:
            yield a, _lists(columns), [None] * (b - a), [None] * (b - a)
        elif b - a <= SMALL or form is None:
            found = [diagnose(text, form) for text in block.to_pylist()]
            yield a, pa.array([f[0] for f in found], pa.list_(pa.string())), [f[1] for f in found], [f[2] for f in found]
        else:
            todo += [(a, (a + b) // 2), ((a + b) // 2, b)]


def parse_records(lines: DataFrame, formats: list[Format], key: str = "line_id", text: str = "text", format_col: str = "format_id") -> DataFrame:
    """(key, format_id, fields array<string>, reason, detail) for each line; fields are null where there is a reason.

    One pass over the lines, no shuffle: blocks are formed from each Arrow batch and format.
    """
    by_id = {f.format_id: f for f in formats}
    source = lines.select(F.col(key).alias("k"), F.col(format_col).cast("int").alias("f"), F.col(text).cast("string").alias("t"))
    fields = [T.StructField(key, source.schema["k"].dataType), T.StructField("format_id", T.IntegerType()), T.StructField("fields", T.ArrayType(T.StringType())), T.StructField("reason", T.StringType()), T.StructField("detail", T.StringType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = batch.column("f").to_pylist()
            texts = pc.replace_substring_regex(batch.column("t").cast(pa.string()), "\r$", "")
            places, lists, reasons, details = [], [], [], []
            for kind in set(kinds):
                where = np.flatnonzero([k == kind for k in kinds])
                for first, fields_, reason, detail in _parse(texts.take(pa.array(where)), by_id.get(kind)):
                    places.append(where[first : first + len(reason)])
                    lists.append(fields_)
                    reasons += reason
                    details += detail
            order = pa.array(np.argsort(np.concatenate(places)) if places else np.zeros(0, np.int64))
            parsed = pa.concat_arrays(lists) if lists else pa.array([], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("k"), batch.column("f").cast(pa.int32()), parsed.take(order), pa.array(reasons, pa.string()).take(order), pa.array(details, pa.string()).take(order)],
                [key, "format_id", "fields", "reason", "detail"],
            )

    return source.mapInArrow(run, T.StructType(fields))


def typed_rows(parsed: DataFrame, form: Format, key: str = "line_id") -> DataFrame:
    """The valid records of one format as a table of its own columns.

    The key comes first as ``_<key>``; a column name that the format repeats gets ``_2``, ``_3`` ... so that nothing clashes.
    """
    seen: dict[str, int] = {}
    columns = [F.col(key).alias(f"_{key}")]
    for i, (name, kind) in enumerate(zip(form.names, form.types, strict=True)):
        seen[name.lower()] = n = seen.get(name.lower(), 0) + 1
        columns.append(F.col("fields")[i].try_cast(SPARK_TYPES[kind]).alias(name if n == 1 else f"{name}_{n}"))
    return parsed.where((F.col("format_id") == form.format_id) & F.col("reason").isNull()).select(*columns)


def typed_structs(parsed: DataFrame, formats: list[Format], key: str = "line_id") -> DataFrame:
    """All valid records in one pass: a struct column ``row_<format_id>`` for each format, null in the rows of the others."""
    columns = []
    for form in formats:
        parts, seen = [], {}
        for i, (name, kind) in enumerate(zip(form.names, form.types, strict=True)):
            seen[name.lower()] = n = seen.get(name.lower(), 0) + 1
            parts.append(F.col("fields")[i].try_cast(SPARK_TYPES[kind]).alias(name if n == 1 else f"{name}_{n}"))
        columns.append(F.when(F.col("format_id") == form.format_id, F.struct(*parts)).alias(f"row_{form.format_id}"))
    return parsed.where(F.col("reason").isNull()).select(key, "format_id", *columns)
