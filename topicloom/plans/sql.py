"""Pieces of DuckDB SQL that say the same as the column expressions."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from topicloom.functions import annotate, stopwords, text
from topicloom.functions.tokens import VERBS

CJK = r"\x{4e00}-\x{9fff}"


def quoted(words: list[str]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def normalized(column: str) -> str:
    s = f"lower(coalesce({column}, ''))"
    for pattern in (r"https?://[^\s]+|www\.[^\s]+", r"@[\p{L}\p{N}_]+", r"#[\p{L}\p{N}_]+", f"[^a-z0-9{CJK} ]+", " {2,}"):
        s = f"regexp_replace({s}, '{pattern}', ' ', 'g')"
    return f"trim({s})"


def words(column: str, pattern: str = "[a-z]{3,25}") -> str:
    return f"list_concat(regexp_extract_all({column}, '{pattern}'), regexp_extract_all({column}, '[0-9]{{2,}}'))"


def _grams(run: str, n: int) -> str:
    return f"list_transform(range(1, length({run}) - {n - 2}), lambda i: substr({run}, i, {n}))"


def chinese(column: str) -> str:
    runs = f"regexp_extract_all({column}, '[{CJK}]{{2,}}')"
    grams = f"flatten(list_transform({runs}, lambda r: list_concat({_grams('r', 2)}, {_grams('r', 3)})))"
    return f"list_concat({grams}, regexp_extract_all({column}, '[{CJK}]{{1,6}}'))"


#: d(doc_id, text, tokens): the documents as the basic English pipeline gives them; l: their long form.
TOKENS = f"""WITH n AS (SELECT doc_id, text, {normalized('text')} AS norm FROM documents),
d AS (SELECT doc_id, text, list_filter({words('norm')}, lambda t: t NOT IN ({quoted(stopwords.base('en'))})) AS tokens FROM n),
l AS (SELECT doc_id, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS pos FROM d),
df AS (SELECT token, count(DISTINCT doc_id) AS doc_count FROM l GROUP BY token)
"""
VERB_LIST = quoted(VERBS)


@lru_cache(maxsize=1)
def _compatible() -> tuple[str, str, list[tuple[str, str]]]:
    """By rule from the Unicode data: characters with a compatibility form of one character, these forms, and those with a longer one."""
    one, form, more = [], [], []
    for cp in [*range(0xA0, 0x300), *range(0x2000, 0x2190), *range(0x2E80, 0x3100), *range(0xFB00, 0xFB07), *range(0xFE50, 0xFE70), *range(0xFF01, 0xFFA0)]:
        ch = chr(cp)
        if unicodedata.decomposition(ch).startswith("<"):
            plain = "".join(c for c in unicodedata.normalize("NFKD", ch) if unicodedata.category(c) not in ("Mn", "Me", "Mc"))
            if len(plain) == 1:
                one.append(ch)
                form.append(plain)
            else:
                more.append((ch, plain))
    return "".join(one), "".join(form), more


def accents_stripped(expression: str, enie: bool = False) -> str:
    """Compatibility decomposition without marks."""
    s = f"replace(replace(nfc_normalize({expression}), 'ñ', '\ue000'), 'Ñ', '\ue001')" if enie else expression
    one, form, more = _compatible()
    for ch, plain in more:
        s = f"replace({s}, '{ch}', '{plain}')"
    quote = form.replace("'", "''")
    s = f"strip_accents(translate({s}, '{one}', '{quote}'))"
    return f"replace(replace({s}, '\ue000', 'ñ'), '\ue001', 'Ñ')" if enie else s


def _gone(s: str, pattern: str) -> str:
    return f"regexp_replace({s}, '{pattern.replace(chr(39), chr(39) * 2)}', ' ', 'g')"


def cleaned(column: str, language: str) -> str:
    """The academic cleaning. RE2 has no look-behind, so an emoticon is matched with its neighbours, twice for those side by side."""
    s = f"coalesce({column}, '')"
    for pattern in (text.URL, text.HANDLE, r"#[^\s]+", text.EMOJI):
        s = _gone(s, pattern)
    for _ in range(2):
        emoticon = text.EMOTICON.replace("'", "''")
        s = f"regexp_replace({s}, '(^|[^\\p{{L}}\\p{{N}}]){emoticon}($|[^\\p{{L}}\\p{{N}}])', '\\1 \\2', 'g')"
    for pattern in (text.HEARTS, text.CARETS, r"\p{Nd}+"):
        s = _gone(s, pattern)
    if language == "zh":
        s = _gone(f"translate({s}, '{text.TRADITIONAL}', '{text.SIMPLIFIED}')", r"[^\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}]+")
        return f"trim(regexp_replace({s}, ' {{2,}}', ' ', 'g'))"
    s = _gone(accents_stripped(f"lower({s})", language == "es"), "[^a-zñ]+" if language == "es" else "[^a-z]+")
    s = f"trim(regexp_replace({s}, ' {{2,}}', ' ', 'g'))"
    for head, rests in text._pairs(text.CUT_WORDS[language]).items():
        s = f"regexp_replace({s}, '\\b{head}\\s+((?:{'|'.join(rests)})\\w*)\\b', '{head}\\1', 'g')"
    for head, rests in text._pairs(text.LOST_HEADS[language]).items():
        s = f"regexp_replace({s}, '\\b({'|'.join(sorted(rests, key=len, reverse=True))})\\b', '{head}\\1', 'g')"
    return s


def tagged_english(source: str) -> str:
    """g(doc_id, pos, pos_tag, lemma) over a CTE with doc_id and clean: the annotator by rules for English, one row a token."""
    ends = lambda of: "(" + " OR ".join(f"ends_with(w, '{e}')" for e in of) + ")"
    lost = {rest: head + rest for listed in (text.LOST_HEADS, text.LOST_HEADS_OF_LEMMAS) for head, rests in text._pairs(listed["en"]).items() for rest in rests}
    fixes = ", ".join(f"'{k}': '{v}'" for k, v in lost.items())
    return f"""w0 AS (SELECT doc_id, unnest(string_split(clean, ' ')) AS w, generate_subscripts(string_split(clean, ' '), 1) AS pos FROM {source}),
w1 AS (SELECT doc_id, pos, w, CASE WHEN w IN ({quoted(VERBS)}) OR length(w) > 5 AND {ends(annotate._VERB["en"])} THEN 'VERB' WHEN length(w) > 4 AND {ends(annotate._ADVERB["en"])} THEN 'ADV'
  WHEN length(w) > 4 AND {ends(annotate._ADJECTIVE["en"])} THEN 'ADJ' ELSE 'NOUN' END AS pos_tag,
  CASE WHEN length(w) > 4 AND ends_with(w, 'ies') THEN substr(w, 1, length(w) - 3) || 'y' WHEN length(w) > 4 AND {ends(("ches", "shes", "sses", "xes"))} THEN substr(w, 1, length(w) - 2)
  WHEN length(w) > 3 AND ends_with(w, 's') AND NOT {ends(("ss", "us", "is"))} THEN substr(w, 1, length(w) - 1) ELSE w END AS raw_lemma FROM w0 WHERE w <> ''),
g AS (SELECT doc_id, pos, pos_tag, coalesce(map_extract(MAP {{{fixes}}}, raw_lemma)[1], raw_lemma) AS lemma FROM w1)"""


def merged(long: str, pairs: str, out: str) -> str:
    """CTE ``out``(doc_id, pos, token): neighbours of ``pairs``(a, b) joined from left to right. In a run of positions that all begin a
    pair, the odd ones do."""
    return f"""{out} AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS pos, token FROM (
 SELECT doc_id, pos, CASE WHEN begins THEN token || '_' || nx ELSE token END AS token, coalesce(lag(begins) OVER (PARTITION BY doc_id ORDER BY pos), false) AS eaten FROM (
  SELECT *, hit AND (row_number() OVER (PARTITION BY doc_id, hit, grp ORDER BY pos)) % 2 = 1 AS begins FROM (
   SELECT *, pos - row_number() OVER (PARTITION BY doc_id, hit ORDER BY pos) AS grp FROM (
    SELECT x.doc_id, x.pos, x.token, x.nx, p.a IS NOT NULL AS hit FROM (SELECT *, lead(token) OVER (PARTITION BY doc_id ORDER BY pos) AS nx FROM {long}) x LEFT JOIN {pairs} p ON p.a = x.token AND p.b = x.nx)))) WHERE NOT eaten)"""


def scored(long: str, least: int, threshold: float, out: str) -> str:
    """CTE ``out``(a, b, n, score): the phrases of a long form."""
    return f"""{out}_q AS (SELECT a, b, count(*) AS n FROM (SELECT token AS a, lead(token) OVER (PARTITION BY doc_id ORDER BY pos) AS b FROM {long}) WHERE b IS NOT NULL GROUP BY a, b),
{out}_s AS (SELECT token, count(*) AS k FROM {long} GROUP BY token),
{out} AS (SELECT a, b, n, round((n - {least}) * v.v / (x.k * y.k)::DOUBLE, 6) AS score FROM {out}_q JOIN {out}_s x ON x.token = a JOIN {out}_s y ON y.token = b, (SELECT (SELECT count(*) FROM {out}_s) + (SELECT count(*) FROM {out}_q) AS v) v
 WHERE n >= {least} AND round((n - {least}) * v.v / (x.k * y.k)::DOUBLE, 6) > {threshold})"""


#: f(doc_id, tokens): the documents after the academic pipeline in English with the loose preset.
def academic() -> str:
    from topicloom.operators.academic import PRESETS

    p = PRESETS["loose"]
    return f"""WITH c AS (SELECT doc_id, {cleaned("text", "en")} AS clean FROM documents),
{tagged_english("c")},
a0 AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS pos, lemma AS token FROM g WHERE length(lemma) BETWEEN {p["min_token_len"]} AND {p["max_token_len"]} AND pos_tag IN ({quoted(list(p["pos_keep"]))}) AND lemma NOT IN ({quoted(stopwords.academic("en"))})),
{scored("a0", 5, 10.0, "p1")},
{merged("a0", "p1", "a1")},
{scored("a1", 2, 6.0, "p2")},
{merged("a1", "p2", "a2")},
v AS (SELECT token, count(DISTINCT doc_id) AS df FROM a2 GROUP BY token),
k AS (SELECT token FROM v WHERE df < (SELECT ceil(round(count(DISTINCT doc_id) * {p["df_no_above"]}, 9)) FROM a2) AND df >= {p["df_no_below"]}),
f AS (SELECT d.doc_id, coalesce(t.tokens, '') AS tokens, coalesce(t.n, 0)::INTEGER AS n FROM documents d LEFT JOIN (SELECT doc_id, string_agg(token, ' ' ORDER BY pos) AS tokens, count(*) AS n FROM a2 WHERE token IN (SELECT token FROM k) GROUP BY doc_id) t USING (doc_id))
"""
