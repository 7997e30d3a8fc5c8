"""The text functions under names for SQL.

``register(spark)`` makes them known to a session. They run over Arrow batches where they aren't table functions; DataFrame code
should use the column expressions of the other modules, which stay in generated code.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from topicloom.functions import text
from topicloom.session import ship

_URL = re.compile(r"https?://\S+|www\.\S+")
_TAG = re.compile(r"#\w+")
_HANDLE = re.compile(r"@\w+")
_OTHER = re.compile("[^a-z0-9\u4e00-\u9fff ]+")
_WORD = re.compile("[a-z]{3,25}")
_NUMBER = re.compile("[0-9]{2,}")


def _basic(t: str) -> str:
    t = _TAG.sub(" ", _HANDLE.sub(" ", _URL.sub(" ", t.lower())))
    return re.sub(" {2,}", " ", _OTHER.sub(" ", t)).strip(" ")


@F.pandas_udf(T.StringType())
def normalize_text(s: pd.Series) -> pd.Series:
    return s.fillna("").map(_basic)


@F.pandas_udf(T.StringType())
def strip_accents_text(s: pd.Series) -> pd.Series:
    return s.fillna("").map(lambda t: "".join(ch for ch in unicodedata.normalize("NFKD", t) if unicodedata.category(ch) not in ("Mn", "Me", "Mc")))


@F.pandas_udf(T.StringType())
def fix_mojibake_text(s: pd.Series) -> pd.Series:
    return s.map(text.ungarbled, na_action="ignore")


@F.pandas_udf(T.StringType())
def snippet_text(s: pd.Series) -> pd.Series:
    return s.fillna("").map(lambda t: " ".join(t.split())[:260])


class Tokens:
    """tokens(text): one row (pos, token) for each token of a normalised text."""

    def eval(self, value: str):
        form = _basic(value or "")
        yield from enumerate([*_WORD.findall(form), *_NUMBER.findall(form)])


FUNCTIONS = {"normalize_text": normalize_text, "strip_accents_text": strip_accents_text, "fix_mojibake_text": fix_mojibake_text, "snippet_text": snippet_text}


def register(spark: SparkSession) -> list[str]:
    """Register all functions and the table function ``tokens`` with a session; their names."""
    ship(spark)
    for name, function in FUNCTIONS.items():
        spark.udf.register(name, function)
    spark.udtf.register("tokens", F.udtf(Tokens, returnType=T.StructType([T.StructField("pos", T.IntegerType()), T.StructField("token", T.StringType())])))
    return [*FUNCTIONS, "tokens"]
