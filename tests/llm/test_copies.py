import random
import re
import unicodedata
from collections import defaultdict

from pyspark.sql import functions as F

from topicloom.llm import copies

PAIRS = {"Title": "body", "content": "body"}
SCHEMA = "row_id bigint, Title string, content string, analysis_text string, h1 string, id int"


def essence(s):
    if s is None:
        return ""
    s = unicodedata.normalize("NFC", s).upper().lower()
    return "".join(ch for ch in s if unicodedata.category(ch)[0] in "LM" or unicodedata.category(ch) == "Nd")


def brute(rows):
    groups = defaultdict(list)
    for i, t, c, a, *_ in rows:
        if t is None and c is None:
            key = ("alone", essence(a)) if essence(a) else None
        else:
            parts = sorted(x for x in (essence(t), essence(c)) if x)
            key = ("body", *parts) if parts else None
        if key:
            groups[key].append(i)
    return {(min(g), i) for g in groups.values() for i in g if i != min(g)}


def test_against_brute_force(spark):
    rng = random.Random(5)
    words = ["Hotel", "HÓTEL", "hotel!", "straße", "STRASSE", None, " ", "?!", "bar 7", "酒店"]
    rows = [(i, rng.choice(words), rng.choice(words), rng.choice(words), "x", 0) for i in range(300)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = copies.redundant_copies(df, "row_id", PAIRS, "analysis_text")
    assert {tuple(r) for r in got.collect()} == brute(rows)
    kept = copies.collapsed(df, "row_id", PAIRS, "analysis_text")
    assert kept.agg(F.sum("copies")).first()[0] == 300 and kept.count() == 300 - len(brute(rows))


def test_cases(spark):
    rows = [(5, "A b", "C", None), (2, "c!", "ab", None), (3, "abc", None, None), (4, None, "A-B-C", None), (6, None, None, "abc"), (7, None, None, "A.b c"), (8, "", " ", "abc"), (9, "e", "é", None), (10, "é", "E", None), (11, "e", "e", None)]
    df = spark.createDataFrame([(*r, None, None) for r in rows], SCHEMA)
    assert {tuple(r) for r in copies.redundant_copies(df, "row_id", PAIRS, "analysis_text").collect()} == {(2, 5), (3, 4), (6, 7), (9, 10)}
    assert copies.redundant_copies(df.limit(0), "row_id", PAIRS, "analysis_text").count() == 0
    named = copies.redundant_copies(df, "row_id", {"Title": "t", "content": "c"})
    assert {tuple(r) for r in named.collect()} == set()


def test_collisions_are_told_apart(spark, monkeypatch):
    """With every fingerprint equal, the verification alone must separate the groups."""
    real = copies.fingerprints
    monkeypatch.setattr(copies, "fingerprints", lambda *a: real(*a).withColumn("h1", F.lit(1).cast("bigint")).withColumn("h2", F.lit(1).cast("bigint")))
    rows = [(i, ["a", "b", None, "c"][i % 4], ["b", "a", "x", None][i % 4], "y", None, None) for i in range(24)]
    got = copies.redundant_copies(spark.createDataFrame(rows, SCHEMA), "row_id", PAIRS, "analysis_text")
    assert {tuple(r) for r in got.collect()} == brute(rows)
    assert re.match("", "")


def test_one_group_of_a_third(spark):
    rows = [(i, "Same text", "again" if i % 2 else "AGAIN!", None, None, None) if i % 3 == 0 else (i, f"t{i}", None, None, None, None) for i in range(3000)]
    got = copies.redundant_copies(spark.createDataFrame(rows, SCHEMA), "row_id", PAIRS, "analysis_text")
    assert {tuple(r) for r in got.collect()} == brute(rows)
