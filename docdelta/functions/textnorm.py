"""Text normalisation as column expressions.

Input is taken to be in composed form (NFC); :func:`composed` brings whole
columns into it once, at ingest, in an Arrow stage that only sees texts with
code points that may be decomposed.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docdelta.functions import patterns as P


def composed(df: DataFrame, *columns: str) -> DataFrame:
    """The columns in NFC."""
    @F.pandas_udf("string")
    def nfc(texts: pd.Series) -> pd.Series:
        return texts.str.normalize("NFC")

    for c in columns:
        odd = F.when(F.col(c).rlike(P.MAYBE_DECOMPOSED), F.col(c))
        df = df.withColumn(c, F.coalesce(nfc(odd), F.col(c)))
    return df


def strip(text: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.btrim(text, F.lit(P.SPACES))


def squeeze(text: Column) -> Column:
    """Every run of white space as one blank, none at the ends."""
    return strip(F.regexp_replace(text, rf"{P.S}+", " "))


def layout_free(text: Column) -> Column:
    """Line ends, soft hyphens, hyphenated line breaks and blanks normalised."""
    t = F.coalesce(text, F.lit(""))
    t = F.regexp_replace(t, r"\r\n?", "\n")
    t = F.regexp_replace(t, rf"(?<={P.W}){P.SOFT_HYPHEN}[ \t]*\n[ \t]*(?={P.W})", "")
    t = F.replace(t, F.lit(P.SOFT_HYPHEN), F.lit(""))
    t = F.regexp_replace(t, rf"(?<={P.W})-[ \t]*\n[ \t]*(?={P.W})", "")
    t = F.regexp_replace(t, r"[ \t]+", " ")
    t = F.regexp_replace(t, rf"(^|\n){P.IN_LINE}+", "$1")
    t = F.regexp_replace(t, rf"{P.IN_LINE}++(?=\n|\z)", "")
    return strip(F.regexp_replace(t, r"\n{3,}", "\n\n"))


def literal_key(text: Column) -> Column:
    """The text with nothing but its words and single blanks."""
    return squeeze(layout_free(text))


def dashed(text: Column) -> Column:
    """All dashes as hyphens."""
    return F.translate(text, P.DASHES, "-" * len(P.DASHES))


def _undecorated(line: Column) -> Column:
    line = F.regexp_replace(strip(line), P.PREFIX, "")
    line = F.regexp_replace(line, P.LEADING_EMPHASIS, "")
    line = F.regexp_replace(line, P.TRAILING_EMPHASIS, "")
    line = F.regexp_replace(line, r"\*\*|__", "")
    return strip(F.regexp_replace(line, P.PREFIX, ""))


def alignment_key(text: Column) -> Column:
    """The content without structural prefixes and emphasis."""
    lines = F.filter(F.split(dashed(layout_free(text)), P.LINE_BREAKS, -1), lambda x: x.rlike(P.NS))
    return squeeze(F.array_join(F.transform(lines, _undecorated), " "))
