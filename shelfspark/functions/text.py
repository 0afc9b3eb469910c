"""Text cleaning."""

from __future__ import annotations

import html
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@F.pandas_udf(StringType())
def unescaped(texts: pd.Series) -> pd.Series:
    """HTML entities to their characters; Spark has no function for it."""
    return texts.map(lambda t: html.unescape(t) if isinstance(t, str) and "&" in t else t)


@F.pandas_udf(StringType())
def folded(texts: pd.Series) -> pd.Series:
    """Letters without their accents; letters without such a form are dropped."""
    return texts.map(lambda t: unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode() if isinstance(t, str) and not t.isascii() else t)


#: What is taken out of a description, in order; (pattern, replacement).
_INLINE = (
    (r"<[^>]+>", ""),
    (r"\[http[s]?://[^\]]+\]", ""),
    (r"https?://[^\s]+", ""),
    (r"\(https?://[^\)]+\)", ""),
    (r"\[\d+\]\s*", ""),
    (r"\(\[Source\][^)]*\)", ""),
    (r"[\(\[\{]{2}[^\)\]\}\n]*[\)\]\}]{2}", ""),
    (r"\*\*([^*]+)\*\*", "$1"),
    (r"__([^_]+)__", "$1"),
    (r"\*([^*]+)\*", "$1"),
    (r"_([^_]+)_", "$1"),
    (r"(?m)^#+\s+", ""),
)
#: Rules that end a description, and tails that are taken off.
_RULES = (r"-{5,}", r"={5,}", r"\*{5,}", r"_{5,}")
_TAILS = (
    r"\n\*\*Also contained in:\*\*.*$",
    r"\n\*\*From the publisher:\*\*.*$",
    r"\n\*\*About the Author:\*\*.*$",
    r"\n\*\*Source:\*\*.*$",
    r"\n--+\s*\n.*$",
    r"\[1\]:\s*https?://.*$",
    r"^From Wikipedia.*$",
    r"^See also:.*$",
    r"^References:.*$",
    r"\n\nCopyright.*$",
    r"Preceded by:.*$",
    r"Followed by:.*$",
)


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def without_markup(text: Column) -> Column:
    """clean_description without entities: markup, links and footnotes go, then all from the first rule of one kind on,
    then known tails; white space is squeezed, an empty result is null."""
    out = stripped(text)
    for pattern, by in _INLINE:
        out = F.regexp_replace(out, pattern, by)
    cut = out
    for rule in reversed(_RULES):
        cut = F.when(out.rlike(rule), stripped(F.get(F.split(out, rule, 2), F.lit(0)))).otherwise(cut)
    out = cut
    for tail in _TAILS:
        out = F.regexp_replace(out, f"(?ismu){tail}", "")
    out = F.regexp_replace(F.regexp_replace(out, r"\n{3,}", "\n\n"), r"[ \t]{2,}", " ")
    out = stripped(F.regexp_replace(stripped(out), r":+$", ""))
    return F.when(out != "", out)


def clean_description(text: Column) -> Column:
    """Only texts that may hold an entity go through Python."""
    whole = stripped(text)
    return without_markup(F.coalesce(unescaped(F.when(whole.contains("&"), whole)), whole))
