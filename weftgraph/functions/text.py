"""Folding of text: case and accents do not matter, nothing else changes.

Each side is decomposed (NFD), loses its combining marks and is upper-cased
in full (``ß`` becomes ``SS``).  Spark has no normaliser, so texts beyond
ASCII go through an Arrow-batched function; ASCII texts stay in the JVM.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def fold(text: str) -> str:
    plain = (c for c in unicodedata.normalize("NFD", text) if not unicodedata.category(c).startswith("M"))
    return "".join(plain).upper()


def _folded(s: pd.Series) -> pd.Series:
    return s.map(fold, na_action="ignore")


def folded(text: Column) -> Column:
    """The folded text.  Only rows with a character beyond ASCII reach Python's work."""
    ascii_only = ~text.rlike(r"[^\x00-\x7F]")
    rest = F.when(~ascii_only, text)  # null for ASCII rows: nothing to fold there
    return F.when(ascii_only, F.upper(text)).otherwise(F.pandas_udf(_folded, "string")(rest))


def spark_regex(pattern: str) -> str:
    """A linear-time regular expression for the JVM's engine.

    Look-around and back-references are refused, names of scripts are spelt as
    the JVM wants them.
    """
    import re

    if re.search(r"(?<!\\)(?:\\\\)*\(\?(?:=|!|<=|<!)", pattern) or re.search(r"(?<!\\)(?:\\\\)*\\[1-9]", pattern):
        raise ValueError("look-around and backreferences are not supported")
    return re.sub(r"\\([pP])\{([A-Z][a-z]{2,})\}", r"\\\1{Is\2}", pattern)
