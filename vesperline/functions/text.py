"""Markup and hidden characters in text columns."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from vesperline.functions.inline import shown

#: Characters that do not show but change what does.
INVISIBLE = "[\u200b\u200e\u200f\u202a-\u202e\u2066-\u2069]"
CONTROL = "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]"
_MARKED = r"[`\[\]*_~\\&<\n]"  # a text without any of these has no marks


def without_marks(text: Column, keep_code: bool) -> Column:
    """Text without emphasis, links, strike marks, images and inline HTML; inline code is kept as its content or dropped;
    entities and escapes are what they stand for; line ends go. See ``inline.shown``."""

    @F.pandas_udf("string")
    def marked(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: t if t is None else shown(t)[0 if keep_code else 1])

    return F.when(text.rlike(_MARKED), marked(F.when(text.rlike(_MARKED), text))).otherwise(text)


def trimmed(text: Column) -> Column:
    """Without white space at its ends; ASCII texts need no pattern for that."""
    ascii_only = F.octet_length(text) == F.length(text)
    return F.when(ascii_only, F.btrim(text, F.lit(" \t\n\x0b\f\r"))).otherwise(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""))


def scrubbed(text: Column) -> Column:
    """Without invisible formatting and control characters; tabs and line ends stay."""
    return F.regexp_replace(F.regexp_replace(text, INVISIBLE, ""), CONTROL, "")


def html_escaped(text: Column) -> Column:
    out = scrubbed(text)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def markdown_escaped(text: Column) -> Column:
    """For headings and labels: characters that mark up are escaped, invisible formatting goes."""
    return F.regexp_replace(F.regexp_replace(text, INVISIBLE, ""), r"([\\`*_#\[\]<>|])", r"\\$1")
