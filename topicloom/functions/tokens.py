"""Tokenising normalised text and filtering tokens, all in generated code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicloom.functions.text import CJK

# The verbs that the noun and adjective heuristic drops, with their forms.
VERBS = """
be am is are was were been being  have has had having  do does did doing
can could may might must shall should will would  go goes went gone going  get gets got getting  make makes made making
say says said saying  see sees saw seen seeing  know knows knew known knowing  think thinks thought thinking
take takes took taken taking  come comes came coming  use uses used using  need needs needed needing
want wants wanted wanting  like likes liked liking  love loves loved loving  try tries tried trying
work works worked working  play plays played playing  stay stays stayed staying  look looks looked looking
feel feels felt feeling  find finds found finding  keep keeps kept keeping  put puts putting  let lets letting
""".split()


def zh_char_ngrams(c: Column | str, n: int) -> Column:
    """All runs of n characters of a string of Chinese characters."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.length(c) >= n, F.transform(F.sequence(F.lit(1), F.length(c) - (n - 1)), lambda i: F.substr(c, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def _zh(c: Column) -> Column:
    runs = F.regexp_extract_all(c, F.lit(f"([{CJK}]{{2,}})"), 1)
    grams = F.flatten(F.transform(runs, lambda r: F.concat(zh_char_ngrams(r, 2), zh_char_ngrams(r, 3))))
    return F.concat(grams, F.regexp_extract_all(c, F.lit(f"([{CJK}]{{1,6}})"), 1))


def tokenize(c: Column | str, language: str = "mixed", variant: str = "app") -> Column:
    """Tokens of a normalised text, in the order words, numbers, Chinese 2- and 3-grams of each run, Chinese chunks."""
    c = F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))
    word = "([a-z_]{3,35})" if variant == "app" else "([a-z]{3,25})"
    parts = []
    if language in ("en", "mixed"):
        parts += [F.regexp_extract_all(c, F.lit(word), 1), F.regexp_extract_all(c, F.lit(r"([0-9]{2,})"), 1)]
    if language in ("zh", "mixed"):
        parts.append(_zh(c))
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def at_least(tokens: Column | str, n: int) -> Column:
    """Drop words shorter than n; numbers and Chinese tokens stay."""
    c = F.col(tokens) if isinstance(tokens, str) else tokens
    return c if n <= 1 else F.filter(c, lambda t: ~t.rlike("^[a-z_]+$") | (F.length(t) >= n))


def nouns_and_adjectives(tokens: Column | str, verbs: list[str] | None = None) -> Column:
    """Drop common verbs and longer words in -ing and -ed."""
    c = F.col(tokens) if isinstance(tokens, str) else tokens
    verbs_ = F.array(*map(F.lit, verbs or VERBS))
    return F.filter(c, lambda t: ~F.array_contains(verbs_, t) & ~((F.length(t) >= 6) & (t.endswith("ing") | t.endswith("ed"))))


def without(tokens: Column | str, words: list[str]) -> Column:
    """Drop the listed words."""
    c = F.col(tokens) if isinstance(tokens, str) else tokens
    return F.filter(c, lambda t: ~t.isin(*words)) if words else c


def split_tokens(c: Column | str) -> Column:
    """Tokens of a string that holds them separated by white space; null and blank give none."""
    c = F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))
    return F.filter(F.split(c, r"\s+"), lambda t: t != "")


def exploded(df: DataFrame, key: str, tokens: str = "tokens") -> DataFrame:
    """(key, pos, token): the long form of a tokenised collection, positions from 0."""
    return df.select(key, F.posexplode(tokens).alias("pos", "token"))
