"""One form for texts that look the same (problem 3).

The look of a text ignores full-width and other compatibility forms, the choice between composed and decomposed
accents, invisible characters, the kind of a single space, and look-alike letters and hyphens. Letter case, visible
punctuation, word order, line breaks, tabs and the number of spaces stay.

* Strings and code points that look alike are joined by union-find; the relation is transitive.
* Of each class the member that is most frequent in the collection becomes the representative. Only members that
  compatibility decomposition leaves alone may be chosen, so the result doesn't depend on the order of rewriting.
* A multi-pattern automaton rewrites each text greedily, the longest pattern first; canonical composition follows.

The code points are counted over all rows; the class table is bounded by the size of Unicode, not by the data.

Defined cases: a null text has a null form; an empty text stays empty; texts without letters get a form but are not
reported as pairs; repeated equal texts are no pair; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from topicloom.llm.texts import map_text
from topicloom.operators.joins import lookup
from topicloom.session import written

#: Rows of one string from which on they are spread over so many parts to be paired.
HOT_STRING, SPREAD = 50_000, 64
# Letters of other scripts and hyphens that display like the ASCII character before the colon: Cyrillic, Greek,
# Armenian, phonetic and small capital letters, Coptic, Cherokee and Lisu.
LOOK_ALIKES = """
a:аɑα  b:ƅᏏ  c:сϲⲥᴄꮯ  d:ԁᏧ  e:е  g:ɡց  h:һհᏂ  i:іɩιᎥ  j:јϳ  l:ӏ  n:ո  o:оοօⲟᴏσ  p:рρⲣ  q:ԛզ  s:ѕꜱꮪ  u:սʋᴜυ  v:νѵᴠꮩ  w:ԝᴡꮃ  x:хⲭ  y:уүʏγ  z:ᴢꮓ
A:АΑᎪꓮⲀ  B:ВΒᏴꓐⲂ  C:СϹᏟꓚⲤ  D:Ꭰꓓ  E:ЕΕᎬꓰ  F:Ϝꓝ  G:ԌᏀꓖ  H:НΗᎻꓧⲎ  I:ІΙӀꓲⲒ  J:ЈͿᎫꓙ  K:КΚᏦꓗⲔ  L:ᏞԼꓡ  M:МΜᎷꓟⲘ  N:Νꓠⲛ  O:ОΟՕꓳⲞ  P:РΡᏢꓑⲢ  Q:Ԛ  R:Ꭱꓣ  S:ЅՏᏚꓢ
T:ТΤᎢꓔⲦ  U:Սꓴ  V:ѴᏙꓦ  W:ԜᎳꓪ  X:ХΧꓫⲬ  Y:ΥҮꓬⲨ  Z:ΖᏃꓜ
-:‐‑−˗⁃֊
"""
# Characters outside the format category that nevertheless show nothing.
ALSO_INVISIBLE = "͏ᅟᅠ឴឵ㅤﾠ"
#: A letter, for the test whether a text contains any.
LETTER = re.compile(r"[^\W\d_]")


def invisible(ch: str) -> bool:
    return unicodedata.category(ch) == "Cf" or ch in ALSO_INVISIBLE or 0xFE00 <= ord(ch) <= 0xFE0F or 0xE0100 <= ord(ch) <= 0xE01EF


class Classes:
    """Union-find over strings."""

    def __init__(self) -> None:
        self.parent: dict[str, str] = {}

    def find(self, x: str) -> str:
        self.parent.setdefault(x, x)
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def union(self, a: str, b: str) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def members(self) -> dict[str, list[str]]:
        out: dict[str, list[str]] = defaultdict(list)
        for x in self.parent:
            out[self.find(x)].append(x)
        return out


def rewriting(counts: dict[int, int]) -> dict[str, str]:
    """pattern -> representative for the code points counted in a collection.

    First pass: classes of single characters without their accents. Second pass: whole strings, among them accented
    characters with their parts replaced, so that an accented look-alike joins the class of the accented letter.
    """
    chars = {chr(c) for c in counts if not 0xD800 <= c <= 0xDFFF}
    alike = [(group.strip()[0], ch) for group in LOOK_ALIKES.split() for ch in group.strip()[2:]]
    chars |= {x for pair in alike for x in pair}
    parts = chars | {p for ch in chars for p in unicodedata.normalize("NFKD", ch)}

    def best(members: list[str]) -> str:
        if "" in members:
            return ""
        stable = [m for m in members if unicodedata.normalize("NFKC", m) == m] or members
        return min(stable, key=lambda m: (-min(counts.get(ord(ch), 0) for ch in m), ord(m[0]), m))

    base = Classes()
    for ch in parts:
        base.find(ch)
        if invisible(ch):
            base.union(ch, "")
        elif unicodedata.category(ch) == "Zs" and ch != " ":
            base.union(ch, " ")
    for a, b in alike:
        base.union(a, b)
    of = {m: best(members) for members in base.members().values() for m in members}

    whole = Classes()
    for ch in parts:
        whole.union(ch, of[ch])
        split = unicodedata.normalize("NFKD", ch)
        if split != ch:
            whole.union(ch, unicodedata.normalize("NFC", "".join(of[p] for p in split)))
            canonical = unicodedata.normalize("NFD", ch)
            if len(canonical) > 1 and all(p in parts for p in canonical):
                whole.union(canonical, ch)
    def follows(m: str) -> bool:
        # an accented letter can only stand for its class if its parts stand for theirs
        return all(of.get(p, p) == p for p in unicodedata.normalize("NFD", m))

    out = {}
    for members in whole.members().values():
        rep = best([m for m in members if follows(m)] or members)
        out |= {m: rep for m in members if m and m != rep}
    return out


class Form:
    """The rewriting as a function of one text.

    A pattern can only match where its last character occurs, so the automaton holds the patterns whose last characters
    have been met so far, and texts without any of these characters are passed by.
    """

    def __init__(self, patterns: dict[str, str]) -> None:
        self.ending: dict[str, list[tuple[str, str]]] = {}
        for pattern, rep in patterns.items():
            self.ending.setdefault(pattern[-1], []).append((pattern, rep))
        self.met: set[str] = set()
        self.machine = ahocorasick.Automaton()

    def __call__(self, text: str) -> str:
        if not self.ending.keys().isdisjoint(text):
            fresh = {ch for ch in set(text) if ch in self.ending} - self.met
            if fresh:
                for ch in fresh:
                    for pattern, rep in self.ending[ch]:
                        self.machine.add_word(pattern, (len(pattern), rep))
                self.machine.make_automaton()
                self.met |= fresh
            out, at = [], 0
            for end, (size, rep) in self.machine.iter_long(text):
                out += (text[at : end + 1 - size], rep)
                at = end + 1
            if at:
                text = "".join(out) + text[at:]
        return text if text.isascii() or unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", text)


def count_code_points(texts: DataFrame, text: str = "text") -> dict[int, int]:
    """Occurrences of each code point over all rows; at most as many entries as Unicode has code points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0x110000, np.int64)
        for batch in batches:
            joined = "".join(t for t in batch.column(0).to_pylist() if t)
            points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
            if len(points):
                got = np.bincount(points)
                total[: len(got)] += got
        where = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(where.astype(np.int32)), pa.array(total[where])], ["cp", "n"])

    rows = texts.select(F.col(text).cast("string").alias("t")).mapInArrow(run, "cp int, n bigint").groupBy("cp").agg(F.sum("n").alias("n"))
    return {r.cp: r.n for r in rows.collect()}


def visual_form(df: DataFrame, text: str, keep: list[str], patterns: dict[str, str] | None = None, out: str = "form") -> DataFrame:
    """``keep`` and the form of ``text``; without ``patterns`` they are taken from this very collection."""
    patterns = rewriting(count_code_points(df, text)) if patterns is None else patterns

    def make():
        form = Form(patterns)
        return lambda t: (None if t is None else form(t),)

    return map_text(df, text, {out: T.StringType()}, make, keep)


def hashed_forms(df: DataFrame, text: str, keep: list[str], patterns: dict[str, str]) -> DataFrame:
    """``keep``, a 128-bit hash of the form (f1, f2) and a 64-bit hash of the text (th), for the texts with letters."""

    def signed(x: int) -> int:
        return x - (1 << 64) if x >> 63 else x

    def make():
        form = Form(patterns)

        def one(t: str | None):
            if t is None or not LETTER.search(t):
                return None
            h = xxhash.xxh3_128_intdigest(form(t).encode("utf-8", "surrogatepass"))
            return signed(h >> 64), signed(h & (1 << 64) - 1), signed(xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass")))

        return one

    return map_text(df, text, {"f1": T.LongType(), "f2": T.LongType(), "th": T.LongType()}, make, keep)


def _looks(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, looks): tab, rec_id and the hashes of form and text of each row with letters; and of the looks with different strings
    their rows n, strings and smallest rec_id."""
    patterns = rewriting(count_code_points(texts))
    rows = written(hashed_forms(texts, "text", ["tab", "rec_id"], patterns), "looks")
    # the strings of a look first: rows of one string, however many, end on the map side
    strings = rows.groupBy(*LOOK, "th").agg(F.count(F.lit(1)).alias("n"), F.min("rec_id").alias("first"))
    looks = strings.groupBy(*LOOK).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("strings"), F.min("first").alias("class_id")).where("strings > 1")
    return rows, written(looks, "mixed")


LOOK = ["tab", "f1", "f2"]


def same_look_classes(texts: DataFrame) -> DataFrame:
    """(tab, rec_id, class_id, members, strings): for each text that looks like a different string its class, named by its smallest
    rec_id, with the rows and the different strings in it. Its size is that of the input, whatever the classes."""
    rows, looks = _looks(texts)
    return lookup(rows, looks, LOOK, "n").select("tab", "rec_id", "class_id", F.col("n").alias("members"), "strings")


def same_look_pairs(texts: DataFrame) -> DataFrame:
    """(tab, id_a, id_b) of texts (tab, rec_id, text) that look the same but aren't the same string.

    All pairs are asked for, so the result grows with the square of a class; ``same_look_classes`` says the same in one
    row a text. Pairs are formed between the different strings of a look first and then spread to their rows, so rows
    with equal strings never meet. A string with very many rows is spread over ``SPREAD`` parts, which the other side of the pair is copied to.
    """
    rows, looks = _looks(texts)
    rows = written(lookup(rows, looks.select(*LOOK, "n"), LOOK, "n").select(*LOOK, "th", "rec_id"), "alike")
    strings = rows.groupBy(*LOOK, "th").agg(F.count(F.lit(1)).alias("k"))
    pairs = strings.select(*LOOK, F.col("th").alias("th_a"), F.col("k").alias("k_a")).join(strings.select(*LOOK, F.col("th").alias("th_b"), F.col("k").alias("k_b")), LOOK).where("th_a < th_b")
    # a pair of strings once for each part that the rows of its strings are spread over
    parts = F.sequence(F.lit(0), F.when(F.greatest("k_a", "k_b") > HOT_STRING, F.lit(SPREAD - 1)).otherwise(F.lit(0)))
    pairs = pairs.withColumn("wide", F.greatest("k_a", "k_b") > HOT_STRING).withColumn("a_wide", F.col("k_a") >= F.col("k_b")).withColumn("part", F.explode(parts))
    narrow = pairs.where("not wide")
    a = rows.select(*LOOK, F.col("th").alias("th_a"), F.col("rec_id").alias("a"))
    b = rows.select(*LOOK, F.col("th").alias("th_b"), F.col("rec_id").alias("b"))
    plain = narrow.join(a, [*LOOK, "th_a"]).join(b, [*LOOK, "th_b"]).select("tab", "a", "b")
    wide = pairs.where("wide")
    salted_a, salted_b = a.withColumn("part", F.pmod(F.xxhash64("a"), F.lit(SPREAD)).cast("int")), b.withColumn("part", F.pmod(F.xxhash64("b"), F.lit(SPREAD)).cast("int"))
    one = wide.where("a_wide").join(salted_a, [*LOOK, "th_a", "part"]).join(b, [*LOOK, "th_b"]).select("tab", "a", "b")
    two = wide.where("not a_wide").join(salted_b, [*LOOK, "th_b", "part"]).join(a, [*LOOK, "th_a"]).select("tab", "a", "b")
    spread = plain.unionByName(one).unionByName(two)
    return spread.select("tab", F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b"))


@lru_cache(maxsize=1)
def unicode_patterns() -> dict[str, str]:
    """The rewriting over all of Unicode, without counts: what a form is doesn't depend on a collection then.

    Characters without a decomposition that are neither invisible nor a kind of space stand for themselves, and
    Korean syllables are left to canonical composition.
    """
    chars = map(chr, range(0x110000))
    return rewriting({ord(ch): 0 for ch in chars if not "가" <= ch <= "힣" and (not unicodedata.is_normalized("NFKD", ch) or invisible(ch) or unicodedata.category(ch) == "Zs" or unicodedata.combining(ch))})
