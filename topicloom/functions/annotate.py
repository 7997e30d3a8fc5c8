"""Tokens with part of speech and lemma.

An annotator is a function from a list of texts to lists of (text, pos, lemma); ``annotate`` runs any such function over
Arrow batches, made once in each task, so a model of the caller's choice can be plugged in. The one given here works by
rules: suffixes and closed word lists for English and Spanish, 2-grams for Chinese.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.functions.tokens import VERBS
from topicloom.session import ship

TAGGED = "array<struct<text:string,pos:string,lemma:string>>"
Annotator = Callable[[list[str]], list[list[tuple[str, str, str]]]]

# Suffixes that tell an adjective, an adverb or a verb.
_ADJECTIVE = {"en": ("ous", "ful", "able", "ible", "ive", "ical", "less", "ish", "al", "ic"), "es": ("oso", "osa", "able", "ible", "ivo", "iva", "ante", "ente")}
_ADVERB = {"en": ("ly",), "es": ("mente",)}
_VERB = {"en": ("ing", "ed", "ize", "ise"), "es": ("ando", "iendo", "aron", "ieron", "aba", "aban")}


def _lemma(word: str, language: str) -> str:
    if language == "en":
        if len(word) > 4 and word.endswith("ies"):
            return word[:-3] + "y"
        if len(word) > 4 and word.endswith(("ches", "shes", "sses", "xes")):
            return word[:-2]
        if len(word) > 3 and word.endswith("s") and not word.endswith(("ss", "us", "is")):
            return word[:-1]
    if language == "es" and len(word) > 4 and word.endswith("s"):
        return word[:-2] if word.endswith(("ces", "nes", "res", "les", "des")) else word[:-1]
    return word


def rules(language: str) -> Annotator:
    """The annotator by rules."""
    verbs = set(VERBS) if language == "en" else set()

    def one(text: str) -> list[tuple[str, str, str]]:
        if language == "zh":
            return [(run[i : i + 2], "NOUN", run[i : i + 2]) for run in re.findall("[㐀-鿿]+", text) for i in range(0, len(run), 2)]
        out = []
        for word in text.split():
            if word in verbs or len(word) > 5 and word.endswith(_VERB[language]):
                pos = "VERB"
            elif len(word) > 4 and word.endswith(_ADVERB[language]):
                pos = "ADV"
            elif len(word) > 4 and word.endswith(_ADJECTIVE[language]):
                pos = "ADJ"
            else:
                pos = "NOUN"
            out.append((word, pos, _lemma(word, language)))
        return out

    return lambda texts: [one(t) for t in texts]


def annotate(df: DataFrame, text: str, make: Callable[[], Annotator], out: str = "tagged", clean: Callable[[], Callable[[str], str]] | None = None) -> DataFrame:
    """Add the tagged tokens of a text column; null texts have none. ``clean`` makes the function that every lemma goes
    through, or its text where the annotator gives no lemma."""
    ship(df.sparkSession)

    @F.pandas_udf(TAGGED)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        annotator = make()
        cleaner = clean() if clean else lambda w: w
        for s in batches:
            tagged = annotator(s.fillna("").tolist())
            yield pd.Series([[{"text": a, "pos": b, "lemma": cleaner(c if c and c.strip() else a)} for a, b, c in row] for row in tagged])

    return df.withColumn(out, run(F.col(text)))
