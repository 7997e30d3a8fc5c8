"""Writing results. Tables of documents are written by the executors; summaries of a model, which have one row for each
topic or K, go through the driver where one file with a byte order mark, a workbook or one JSON document is wanted."""

from __future__ import annotations

import csv
import json
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.operators import topics
from topicloom.sources.workbook import workbook

#: Rows that a file made at the driver may have.
MAX_ROWS = 1_048_575


def write_table(df: DataFrame, path: str, kind: str = "parquet", mode: str = "errorifexists", mark: bool = False) -> None:
    """Any table, distributed: zstd parquet, CSV with a header, or JSON lines. With ``mark`` every CSV file begins with the byte
    order mark, for spreadsheet programs; its first column is then named with it."""
    if mark and kind == "csv":
        df = df.toDF(*(("\ufeff" if i == 0 else "") + c for i, c in enumerate(df.columns)))
    writer = df.write.mode(mode)
    if kind == "parquet":
        writer.option("compression", "zstd").parquet(path)
    elif kind == "csv":
        writer.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    elif kind == "json":
        writer.json(path)
    else:
        raise ValueError(f"unknown kind {kind}")


def _rows(df: DataFrame) -> tuple[list[str], list[tuple]]:
    rows = df.limit(MAX_ROWS + 1).collect()
    if len(rows) > MAX_ROWS:
        raise ValueError(f"more than {MAX_ROWS} rows: use write_table")
    return df.columns, [tuple(r) for r in rows]


def write_csv_file(df: DataFrame, path: str | Path) -> None:
    """One CSV file in UTF-8 with a byte order mark, for spreadsheet programs."""
    columns, rows = _rows(df)
    with open(path, "w", encoding="utf-8-sig", newline="") as f:
        out = csv.writer(f)
        out.writerow(columns)
        out.writerows(rows)


def write_workbook(tables: dict[str, DataFrame], path: str | Path) -> None:
    """One sheet for each table."""
    Path(path).write_bytes(workbook({name: _rows(df) for name, df in tables.items()}))


def with_topics(df: DataFrame, key: str, assigned: DataFrame, names: DataFrame) -> DataFrame:
    """Input columns plus Topic_ID, Topic and Topic_Score."""
    rows = df.join(assigned.select(F.col(key), F.col("topic_id").alias("Topic_ID"), F.col("score").alias("Topic_Score")), key, "left")
    named = rows.join(names.select(F.col("topic_id").alias("Topic_ID"), F.col("name").alias("Topic")), "Topic_ID", "left")
    default = F.concat(F.lit("Topic "), (F.col("Topic_ID") + 1).cast("string"))
    return named.withColumn("Topic", F.coalesce("Topic", default)).select(*df.columns, "Topic_ID", "Topic", "Topic_Score")


def write_summary(parts: dict[str, DataFrame | dict], path: str | Path) -> None:
    """One JSON document: tables as lists of rows, dicts as they are."""
    out = {}
    for name, part in parts.items():
        if isinstance(part, DataFrame):
            columns, rows = _rows(part)
            out[name] = [dict(zip(columns, r, strict=True)) for r in rows]
        else:
            out[name] = part
    Path(path).write_text(json.dumps(out, ensure_ascii=False, indent=2, default=str), encoding="utf-8")


def top_words_grid(dictionary: DataFrame, words: DataFrame, n: int = 5) -> DataFrame:
    """The table behind the grid of top words: topic_id, topic_short_name, n documents and their share, rank, word, weight."""
    top = topics.top_words(words, n)
    total = dictionary.agg(F.sum("num_docs_assigned").alias("total"))
    rows = top.join(dictionary.select("topic_id", "topic_short_name", F.col("num_docs_assigned").alias("n")), "topic_id", "left")
    share = F.when(total.scalar() > 0, F.round(F.col("n") / total.scalar(), 4)).otherwise(0.0)
    return rows.select("topic_id", F.substring("topic_short_name", 1, 30).alias("topic_short_name"), "n", share.alias("share"), "rank", "word", "weight").orderBy("topic_id", "rank")


def write_all(folder: str | Path, dictionary: DataFrame, assigned: DataFrame, stats: DataFrame, k: int, sweep: DataFrame | None = None, turning: dict | None = None, words: DataFrame | None = None) -> dict[str, str]:
    """All outputs of a run; each fails for itself into ``<kind>_error``. Documents go out distributed, and as a sheet of the workbook
    too where they fit into one; the rest are files made here."""
    folder = Path(folder)
    folder.mkdir(parents=True, exist_ok=True)
    small = {f"TopicDictionary_K{k}": dictionary, f"ModelStats_K{k}": stats} | ({"KSweep_Tuning": sweep} if sweep is not None else {})

    def book(path: Path) -> None:
        fits = assigned.limit(MAX_ROWS + 1).count() <= MAX_ROWS
        write_workbook(({f"DocAssignments_K{k}": assigned} if fits else {}) | small, path)

    counts = dictionary.select("topic_id", "num_docs_assigned")
    jobs = {
        "documents": (lambda p: write_table(assigned, str(p), "csv", "overwrite", mark=True), folder / f"doc_assignments_K{k}"),
        "workbook": (book, folder / f"topics_K{k}.xlsx"),
        "dictionary": (lambda p: write_csv_file(dictionary, p), folder / f"topic_dictionary_K{k}.csv"),
        "summary": (lambda p: write_summary({"topic_dictionary": dictionary, "model_stats": stats, "doc_counts_per_topic": counts, "turning_point_analysis": turning or {}} | ({"k_sweep": sweep} if sweep is not None else {}), p), folder / f"run_summary_K{k}.json"),
        "charts": (lambda p: write_csv_file(counts.orderBy(F.desc("num_docs_assigned"), "topic_id"), p), folder / f"doc_counts_K{k}.csv"),
    }
    if words is not None:
        jobs["salient"] = (lambda p: write_csv_file(top_words_grid(dictionary, words), p), folder / f"top5_words_K{k}.csv")
    out = {}
    for kind, (job, path) in jobs.items():
        try:
            job(path)
            out[kind] = str(path)
        except Exception as error:
            out[f"{kind}_error"] = str(error)[:500]
    return out
