"""Text normalisation, shapes, shingles and tags."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusforge.functions.words import BLANKS, SPACE

# Control characters that reject a text, numeric literals, terminal tags.
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
NUMBER = r"(?<![A-Za-z_])[-+]?\p{Nd}+(?:\.\p{Nd}+)?(?:/\p{Nd}+)?(?:e[-+]?\p{Nd}+)?"
TAGS = ["tool_call", "tool_result", "final", "unsupported", "error"]


@F.pandas_udf(T.StringType())
def _composed(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t))


def composed(c: Column) -> Column:
    """Unicode form NFC.  Only texts with other than ASCII characters leave the JVM; null stays null."""
    return F.when(c.rlike(r"[^\x00-\x7f]"), _composed(c)).otherwise(c)


def strip(c: Column) -> Column:
    """Without surrounding white space of any kind."""
    return F.btrim(c, F.lit(BLANKS))


def has_control(c: Column) -> Column:
    return c.rlike(CONTROL)


def normalized(c: Column) -> Column:
    """NFC, single spaces, at most one empty line, stripped; null for null, control characters or nothing left."""
    form = composed(F.when(~has_control(c), c))
    spaced = strip(F.regexp_replace(F.regexp_replace(form, r"[ \t]+", " "), r"\n{3,}", "\n\n"))
    # in an array, as the optimizer would else repeat the whole chain for the test of its length
    return F.transform(F.array(spaced), lambda t: F.when(F.length(t) > 0, t))[0]


def shape(c: Column) -> Column:
    """The text with numeric literals as ``<NUM>``, in lower case and single spaces; null stays null."""
    numbered = F.regexp_replace(F.lower(c), NUMBER, "<NUM>")
    return strip(F.regexp_replace(F.regexp_replace(numbered, r"\$\s*<NUM>", r"\$<NUM>"), f"[{SPACE}]+", " "))


def shingles(c: Column, size: int) -> Column:
    """Distinct runs of ``size`` words split at white space, in lower case; of a shorter text the whole; null stays null."""
    found = F.split(strip(F.lower(c)), f"[{SPACE}]+")
    runs = F.transform(F.array(found), lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(w) - size + 1)), lambda k: F.array_join(F.slice(w, k, F.lit(size)), " ")))
    return F.when(c.isNotNull(), F.array_sort(F.array_distinct(runs[0])))


def jaccard(a: Column, b: Column) -> Column:
    """Share of common elements of two sets; 1 for two empty ones, null if one is null."""
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(a.isNotNull() & b.isNotNull(), F.when(either == 0, 1.0).otherwise(both / either))


def tagged(c: Column, tag: str) -> Column:
    """What follows the first ``<tag>`` up to the next tag or the end, stripped; null without the tag."""
    end = "|".join(TAGS)
    return F.when(c.contains(f"<{tag}>"), strip(F.regexp_extract(c, f"(?s)<{tag}>(.*?)(?=<(?:{end})>|$(?!\\n))", 1)))


def first_tag(c: Column) -> Column:
    """Name of the first tag in the text; null without one."""
    found = F.regexp_extract(c, f"<({'|'.join(TAGS)})>", 1)
    return F.when(found != "", found)


def first_call(c: Column) -> Column:
    """The tool call's text if the first tag is a tool call, else null."""
    return F.when(first_tag(c) == "tool_call", tagged(c, "tool_call"))


# Fixed value: a number as answers write it - currency, sign, thousands, fraction or exponent, with no word around it.
ANSWER_NUMBER = r"(?<![\p{L}\p{N}_.])[$€£]?\s*([+-]?\p{Nd}+\s*/\s*\p{Nd}+|[+-]?(?:\p{Nd}+(?:,\p{Nd}{3})*(?:\.\p{Nd}+)?|\.\p{Nd}+)(?:[eE][+-]?\p{Nd}+)?)(?![\p{L}\p{N}_/])"


def last_number(c: Column) -> Column:
    """The last number in a text as ``n``, ``n/d`` or with exponent, without currency, commas and spaces; null without one."""
    found = F.regexp_extract_all(c, F.lit(ANSWER_NUMBER), F.lit(1))
    return F.when(F.size(found) > 0, F.regexp_replace(F.element_at(found, -1), r"[,\s]", ""))


def quality_counts(df: DataFrame, text: str) -> DataFrame:
    """One row: texts in all, null, with control characters, blank, and accepted by ``normalized``."""
    c = F.col(text)
    clean = F.coalesce(~has_control(c), F.lit(False))
    filled = F.coalesce(F.length(strip(c)) > 0, F.lit(False))
    return df.agg(F.count("*").alias("texts"), F.count_if(c.isNull()).alias("nulls"), F.count_if(~clean & c.isNotNull()).alias("control"), F.count_if(clean & ~filled).alias("blank"), F.count_if(clean & filled).alias("accepted"))
