"""Reading tables from files and pasted text.

Encoding and delimiter are settled on a bounded sample of bytes at the driver; the table itself is read by Spark's
distributed readers. Workbooks are one zipped file each and are parsed by one task a sheet.
"""

from __future__ import annotations

import csv
import io
import re
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicloom.operators.corpus import unique_columns

#: Bytes of a file that encoding and delimiter are judged by.
SAMPLE_BYTES = 1 << 20
_SPARK_NAMES = {"utf-8": "UTF-8", "utf-8-sig": "UTF-8", "utf-16": "UTF-16", "utf-16-le": "UTF-16LE", "utf-16-be": "UTF-16BE", "cp1252": "ISO-8859-1", "latin1": "ISO-8859-1"}
#: What Latin-1 reads as control characters stands for these in the Western encoding, which Spark's reader doesn't know.
_CONTROLS, _WESTERN = zip(*((chr(b), bytes([b]).decode("cp1252")) for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)), strict=True)


class ReadError(ValueError):
    """A table can't be read."""


#: Byte order marks and what they announce.
_MARKS = ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16"))
_SEQUENCE = re.compile(rb"[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}")


def decoded(raw: bytes) -> tuple[str, str]:
    """(text, encoding) from the form of the bytes.

    A byte order mark decides. Without one, bytes that are sound UTF-8 are UTF-8, and bytes with a zero in every other
    place or nearly so are two-byte text. All else is the Western single-byte encoding, or Latin-1 where a byte is undefined in that.
    """
    for mark, name in _MARKS:
        if raw.startswith(mark):
            try:
                return raw.decode(name), name
            except UnicodeDecodeError:
                break  # the mark belongs to something else
    try:
        return raw.decode("utf-8"), "utf-8"
    except UnicodeDecodeError:
        pass
    halves = raw[0::2].count(0), raw[1::2].count(0)
    if 2 * max(halves) > 0.4 * len(raw) and len(raw) % 2 == 0:
        name = "utf-16-le" if halves[1] > halves[0] else "utf-16-be"
        try:
            return raw.decode(name), name
        except UnicodeDecodeError:
            pass
    # mostly UTF-8 with a few broken bytes is read as UTF-8 with marks for these
    good = sum(len(m[0]) for m in _SEQUENCE.finditer(raw))
    beyond = sum(b > 127 for b in raw)
    if good > 0.8 * beyond:
        return raw.decode("utf-8", "replace"), "utf-8"
    name = "latin1" if any(b in raw for b in (b"\x81", b"\x8d", b"\x8f", b"\x90", b"\x9d")) else "cp1252"
    return raw.decode(name), name


def delimiter(text: str) -> str:
    """The delimiter of a sample of lines; a comma where none is clear."""
    try:
        return csv.Sniffer().sniff("\n".join(text.splitlines()[:50]), ",;\t|").delimiter
    except csv.Error:
        return ","


def _sample(spark: SparkSession, path: str) -> bytes:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.getFileStatus(where).isDirectory():
        files = [s.getPath() for s in fs.listStatus(where) if s.isFile() and not s.getPath().getName().startswith(("_", "."))]
        if not files:
            raise ReadError(f"no files in {path}")
        where = files[0]
    stream = fs.open(where)
    try:
        size = int(min(SAMPLE_BYTES, fs.getFileStatus(where).getLen()))
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream, size)) if size else b""
    finally:
        stream.close()


def read_csv(spark: SparkSession, path: str, infer: bool = True, sep: str | None = None, encoding: str | None = None, multi_line: bool | None = None) -> DataFrame:
    """A CSV file or folder with a header; encoding and delimiter are found unless given.

    A file is only read as a whole, by one task, where it has to be: in two-byte encodings, and where quoted fields hold line
    breaks, as told by ``multi_line`` or, if that is None, by all records of the file: one with an odd number of quotes continues.
    """
    if sep is None or encoding is None:
        raw = _sample(spark, path)
        text, found = decoded(raw if len(raw) < SAMPLE_BYTES else raw[: raw.rfind(b"\n") + 1] or raw)
        sep, encoding = sep or delimiter(text), encoding or found
    if multi_line is None:
        quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
        multi_line = encoding.startswith("utf-16") or not spark.read.text(path).where(quotes % 2 == 1).isEmpty()
    reader = spark.read.option("header", True).option("inferSchema", infer).option("multiLine", multi_line).option("quote", '"').option("escape", '"')
    df = unique_columns(reader.option("sep", sep).option("encoding", _SPARK_NAMES.get(encoding, encoding)).csv(path))
    if encoding != "cp1252":
        return df
    controls, western = "".join(_CONTROLS), "".join(_WESTERN)
    columns = [F.translate(f"`{c}`", controls, western) if kind == "string" else F.col(f"`{c}`") for c, kind in df.dtypes]
    return df.select(*(col.alias(c.translate(str.maketrans(controls, western))) for col, c in zip(columns, df.columns, strict=True)))


def read_pasted(spark: SparkSession, raw: str, sep: str = "auto", header: bool = True) -> DataFrame:
    """A table from pasted text: blank lines go; the first of tab, comma and semicolon in the first line divides fields;
    without one there is a single column ``text``. Without a header the columns are col_1, col_2 ..., a single one ``text``."""
    lines = [line for line in raw.strip().splitlines() if line.strip()]
    if not lines:
        raise ReadError("nothing was pasted")
    found = next((s for s in ("\t", ",", ";") if s in lines[0]), None) if sep == "auto" else sep
    if found is None:
        return spark.createDataFrame([(line.strip(),) for line in lines], "text string")
    rows = list(csv.reader(io.StringIO("\n".join(lines)), delimiter=found))
    names = rows.pop(0) if header else [f"col_{i + 1}" for i in range(max(map(len, rows)))]
    if not header and len(names) == 1:
        names = ["text"]
    if not rows:
        raise ReadError("the pasted table has no rows")
    width = len(names)
    values = [tuple((r + [""] * width)[:width]) for r in rows]
    keep = [i for i, n in enumerate(names) if n not in names[:i]]
    schema = ", ".join(f"`{names[i].replace('`', '')}` string" for i in keep)
    return spark.createDataFrame([tuple(v[i] or None for i in keep) for v in values], schema)


def read_table(spark: SparkSession, path: str, sheet: str | None = None, infer: bool = True) -> DataFrame:
    """A table by the suffix of its path: parquet, CSV, JSON, ORC or a workbook; other suffixes are tried as CSV."""
    suffix = PurePosixPath(path).suffix.lower()
    if suffix == ".parquet":
        return spark.read.parquet(path)
    if suffix == ".orc":
        return spark.read.orc(path)
    if suffix in (".json", ".jsonl", ".ndjson"):
        return spark.read.option("multiLine", suffix == ".json").json(path)
    if suffix in (".xlsx", ".xlsm"):
        from topicloom.sources.workbook import read_workbook

        return read_workbook(spark, path, sheet)
    if suffix == ".xls":
        raise ReadError("the old binary workbook format can't be read; save it as .xlsx")
    try:
        return read_csv(spark, path, infer)
    except ReadError:
        raise
    except Exception as error:
        raise ReadError(f"{path}: {error}") from error


def decoded_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, text, encoding) of many files, each decoded as it fits best, in the executors."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    @F.pandas_udf("struct<text:string,encoding:string>")
    def run(s):
        import pandas as pd

        return pd.DataFrame([decoded(bytes(b)) for b in s], columns=["text", "encoding"])

    return files.select("path", run("content").alias("d")).select("path", "d.text", "d.encoding")
