"""Named queries of the llm problems over the standard tables, and the SQL of those that SQL can express.

Each query covers its whole tables with production parameters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicloom.llm import copies, encoding, frequency, language, leakage, packing, pii, visual
from topicloom.llm.texts import all_texts
from topicloom.session import table

TWINS = {"Title": "body", "content": "body"}
TOKENS = "text_preprocessed_academic_tokens"


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies.redundant_copies(table(spark, sf_dir, "docs_out"), "row_id", TWINS, "analysis_text")


def p2_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each record with its number of copies."""
    return copies.collapsed(table(spark, sf_dir, "docs_out"), "row_id", TWINS, "analysis_text")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return visual.same_look_pairs(all_texts(spark, sf_dir))


def p3_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text that looks like a different string, with its class: ``p3_found`` in one row a text."""
    return visual.same_look_classes(all_texts(spark, sf_dir))


def p3_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text in its one form."""
    return visual.visual_form(all_texts(spark, sf_dir), "text", ["tab", "rec_id"])


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.lit("documents").alias("tab"), F.col("doc_id").alias("rec_id"), "text", F.col("lang").alias("label"), F.col("source").alias("host"), F.col("doc_kind").alias("part"))
    outs = table(spark, sf_dir, "docs_out").select(F.lit("docs_out").alias("tab"), F.col("row_id").alias("rec_id"), F.col("analysis_text").alias("text"), F.col("lang").alias("label"), F.col("channel").alias("host"), F.col("video_id").alias("part"))
    return docs.unionAll(outs)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.wrong_labels(language.languages(_labelled(spark, sf_dir), ["host", "part"]))


def p4_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text with its language, its confidence, and the languages of its certain sentences in order."""
    return language.languages(_labelled(spark, sf_dir), ["host", "part"])


def p4_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stretch of one language of every text, with its place and confidence."""
    return language.segments(_labelled(spark, sf_dir), ["host", "part"])


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.find_garbled(all_texts(spark, sf_dir), "text", ["tab", "rec_id"]).select("tab", "rec_id")


def p5_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The garbled texts as restored, and whether they are whole again."""
    return encoding.find_garbled(all_texts(spark, sf_dir), "text", ["tab", "rec_id"])


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequency.marked_tokens(table(spark, sf_dir, "preprocessed"), "doc_id", TOKENS).where("mark is not null").select("token", "mark")


def p6_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every token with its occurrences, records and mark."""
    return frequency.marked_tokens(table(spark, sf_dir, "preprocessed"), "doc_id", TOKENS)


def p7_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every text for each capacity; the mixture follows the sources' shares of all tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pack_limits"))


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many containers each capacity takes and how full they are."""
    return packing.summary(p7_pack(spark, sf_dir))


#: Target parts of all tokens by kind of document, unlike those of the corpus.
MIXTURE = {"comment": 0.15, "review": 0.35, "article": 0.35, "transcript": 0.15}


def p7_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By how much each window of containers misses a given mixture of kinds of documents."""
    packed = packing.pack(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pack_limits"), source="doc_kind", shares=MIXTURE)
    return packing.deviations(packed, MIXTURE)


def p8_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each document and leaked item the longest verbatim match and its place."""
    return leakage.matches(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "eval_items"), "item_id", "text")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_matches(spark, sf_dir).select("doc_id", "item_id")


def p8_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents without leaked passages."""
    return leakage.without_leaks(table(spark, sf_dir, "documents"), p8_found(spark, sf_dir), "doc_id")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.kinds_found(table(spark, sf_dir, "documents"), "text", "doc_id")


def p9_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with placeholders for personal information."""
    return pii.redact(table(spark, sf_dir, "documents"), "text", ["doc_id"])


QUERIES = {
    f.__name__: f
    for f in (p2_found, p2_records, p3_found, p3_classes, p3_forms, p4_found, p4_languages, p4_segments, p5_found, p5_restored, p6_found, p6_counts, p7_pack, p7_fill, p7_mixture, p8_found, p8_matches, p8_clean, p9_found, p9_redacted)
}

_ESSENCE = "nullif(regexp_replace(replace(lower(upper({0})), 'ß', 'ss'), '[^\\p{{L}}\\p{{M}}\\p{{Nd}}]', '', 'g'), '')"
_GROUPS = f"""
WITH e AS (
  SELECT row_id, {_ESSENCE.format('"Title"')} AS t, {_ESSENCE.format('content')} AS c,
         CASE WHEN "Title" IS NULL AND content IS NULL THEN {_ESSENCE.format('analysis_text')} END AS a
  FROM docs_out),
k AS (
  SELECT row_id, CASE WHEN a IS NOT NULL THEN 'a:' || a
                      WHEN t IS NULL OR c IS NULL THEN 'b:' || coalesce(t, c)
                      ELSE 'b:' || least(t, c) || '|' || greatest(t, c) END AS k FROM e),
g AS (SELECT row_id, CASE WHEN k IS NULL THEN row_id ELSE min(row_id) OVER (PARTITION BY k) END AS first FROM k)
"""
_TOKENS = f"""
WITH t AS (
  SELECT doc_id, unnest(regexp_extract_all({TOKENS}, '\\S+')) AS token FROM preprocessed),
c AS (SELECT token, count(*) AS occurrences, count(DISTINCT doc_id) AS records FROM t GROUP BY token),
n AS (SELECT count(DISTINCT doc_id) AS n FROM t),
m AS (SELECT token, occurrences, records, CASE WHEN records < 10 THEN 'rare' WHEN records >= ceil(round(0.6 * n, 9)) THEN 'common' END AS mark FROM c, n)
"""


def _form(column: str) -> str:
    """The visual form in SQL, for characters of the Latin, Greek, Cyrillic and Armenian blocks, punctuation, compatibility forms
    and the stated look-alikes: single characters by translation, longer forms and invisible ones by replacing."""
    blocks = [*range(0x80, 0x590), *range(0x1E00, 0x2190), *range(0x2C80, 0x2D00), *range(0x2E80, 0x3100), *range(0xFB00, 0xFB07), *range(0xFE00, 0xFE10), *range(0xFE50, 0x10000)]
    chars = {chr(c) for c in blocks} | {ch for group in visual.LOOK_ALIKES.split() for ch in group[2:]}
    table = {ch: rep for ch, rep in visual.unicode_patterns().items() if ch in chars}
    one = {ch: rep for ch, rep in table.items() if len(rep) == 1}
    quote = str.maketrans({"'": "''"})
    s = f"regexp_replace(nfc_normalize({column}), '[\\x{{00AD}}\\x{{034F}}\\x{{200B}}-\\x{{200F}}\\x{{202A}}-\\x{{202E}}\\x{{2060}}-\\x{{2064}}\\x{{FE00}}-\\x{{FE0F}}\\x{{FEFF}}]', '', 'g')"
    s = f"translate({s}, '{''.join(one).translate(quote)}', '{''.join(one.values()).translate(quote)}')"
    for ch, rep in table.items():
        # what Latin and Chinese text can hold of the longer forms
        if len(rep) > 1 and ("\u00a0" <= ch <= "\u017f" or ch in "…™℠№℡ﬀﬁﬂﬃﬄﬅﬆ‥″‴⁇⁈⁉"):
            s = f"replace({s}, '{ch}', '{rep.translate(quote)}')"
    return f"nfc_normalize({s})"


_LOOKS = f"""WITH t AS (SELECT 'documents' AS tab, doc_id AS rec_id, text FROM documents WHERE text IS NOT NULL UNION ALL SELECT 'docs_out', row_id, analysis_text FROM docs_out),
f AS (SELECT tab, rec_id, text, {_form("text")} AS form FROM t WHERE regexp_matches(text, '\\p{{L}}'))
"""
_GRAMS = f"""WITH d AS (SELECT doc_id AS id, regexp_extract_all(lower({_form("text")}), '[\\p{{L}}\\p{{N}}]+') AS w FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id AS id, regexp_extract_all(lower({_form("text")}), '[\\p{{L}}\\p{{N}}]+') AS w FROM eval_items WHERE text IS NOT NULL),
dg AS (SELECT DISTINCT id, array_to_string(w[k:k + 11], ' ') AS g FROM (SELECT id, w, unnest(range(1, len(w) - 10)) AS k FROM d)),
ig AS (SELECT DISTINCT id, array_to_string(w[k:k + 11], ' ') AS g FROM (SELECT id, w, unnest(range(1, len(w) - 10)) AS k FROM i)),
m AS (SELECT DISTINCT dg.id AS doc_id, ig.id AS item_id FROM dg JOIN ig USING (g))
"""
SQL = {
    "p3_found": _LOOKS + "SELECT a.tab, a.rec_id AS id_a, b.rec_id AS id_b FROM f a JOIN f b ON a.tab = b.tab AND a.form = b.form AND a.rec_id < b.rec_id AND a.text <> b.text",
    "p3_classes": _LOOKS + """, c AS (SELECT tab, form, count(*) AS members, count(DISTINCT text) AS strings, min(rec_id) AS class_id FROM f GROUP BY tab, form HAVING count(DISTINCT text) > 1)
SELECT tab, rec_id, class_id, members, strings FROM f JOIN c USING (tab, form)""",
    "p8_found": _GRAMS + "SELECT doc_id, item_id FROM m",
    "p8_clean": _GRAMS + "SELECT * FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM m)",
    "p2_found": _GROUPS + "SELECT first AS row_id_a, row_id AS row_id_b FROM g WHERE row_id <> first",
    "p2_records": _GROUPS + "SELECT first AS row_id, count(*) AS copies FROM g GROUP BY first",
    "p6_found": _TOKENS + "SELECT token, mark FROM m WHERE mark IS NOT NULL",
    "p6_counts": _TOKENS + "SELECT token, occurrences, records, mark FROM m",
}
