"""Words and tokens of texts."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space in the sense of Python's str.isspace, and the token pattern over it, for Java's regular expressions.
SPACE = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
BLANKS = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
TOKEN = rf"[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_{SPACE}]+"

WORD = re.compile(r"[^\W_]+")
PUNCT_TOKEN = re.compile(r"\w+|[^\w\s]+")


def words(text: str | None) -> list[str]:
    """Maximal runs of letters and digits of the text's NFKC form in lower case; none for a null."""
    if not text:
        return []
    return WORD.findall((text if text.isascii() else unicodedata.normalize("NFKC", text)).lower())


def token_count(text: Column) -> Column:
    """Matches of the WordPunct pattern, counted in the JVM; 0 for a null."""
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0))


def clean_name(c: Column) -> Column:
    """Lower case without surrounding white space; null stays null."""
    return F.lower(F.btrim(c, F.lit(BLANKS)))


def clean_category(c: Column) -> Column:
    """``clean_name`` with each run of white space or hyphens as one underscore."""
    return F.regexp_replace(clean_name(c), f"[{SPACE}-]+", "_")
