r"""Report text: cleaning, tokens, n-grams.

All of it stays inside Catalyst; the one exception is `strip_accents`, which
hands only rows with non-ASCII text to Python.

The patterns follow Python's Unicode rules whatever the regex engine: a word
character is a letter, a number or "_"; a space is what `str.isspace` says; "."
stops only at "\n".
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortspark import constants as C

# U+10400 is a letter anyhow; a class that names a character above U+FFFF is matched by code points,
# so that a look-behind never sees half of a neighbour
WORD = "[\\p{L}\\p{N}_\U00010400]"
SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
DIGIT = r"\p{Nd}"
# [^a-z0-9.\-] as the ranges between these characters: Java tests a negated class about ten times as slowly
DROPPED = r"[\x{0}-,/:-`{-\x{10ffff}]"


def boilerplate_regex(pattern: str) -> str:
    # The text is lower case already, so ignoring case adds just the two letters
    # whose upper case is that of "s" or "i"; (?d) makes "\n" the only line end.
    folded = re.sub(r"(?<!\\)s", "[s\u017f]", pattern).replace("i", "[i\u0131]")
    return "(?d)" + folded.replace("\\s", SPACE).replace("\\d", DIGIT)


def expand_abbreviations(col: Column) -> Column:
    # literal first: the look at its neighbours is only taken where it occurs
    for short, full in C.MEDICAL_ABBREVIATIONS.items():
        col = F.regexp_replace(col, f"{short}(?<!{WORD}{short})(?!{WORD})", full)
    return col


def strip_boilerplate(col: Column) -> Column:
    for pattern in C.BOILERPLATE_PATTERNS:
        col = F.regexp_replace(col, boilerplate_regex(pattern), "")
    return col


def _lower(col: Column) -> Column:
    return F.lower(F.coalesce(col, F.lit("")))


def _squash(col: Column) -> Column:
    # one class covers both "other characters become a space" and "spaces collapse"
    return F.trim(F.regexp_replace(col, f"{DROPPED}+", " "))


def clean_text_min(col: Column) -> Column:
    """Lower case, keep [a-z0-9.-], collapse everything else to single spaces."""
    return _squash(_lower(col))


def clean_text(col: Column) -> Column:
    """Full cleaner: lower case, expand abbreviations, drop boilerplate, then keep as above."""
    return _squash(strip_boilerplate(expand_abbreviations(_lower(col))))


def is_nonempty_text(col: Column) -> Column:
    """Text that is there, is not blank and is not the word a missing value was written as."""
    return col.isNotNull() & col.rlike(SPACE.replace("[", "[^", 1)) & (col != "nan")


def words(col: Column) -> Column:
    """Whitespace tokens; blank or missing text has none."""
    return F.filter(F.split(F.coalesce(col, F.lit("")), f"{SPACE}+"), lambda w: w != "")


def word_count(col: Column) -> Column:
    return F.size(words(col))


def truncate_words(col: Column, n: int = C.MAX_WORDS) -> Column:
    return F.array_join(F.slice(words(col), 1, n), " ")


def excerpt(col: Column, n: int = 200) -> Column:
    return F.substring(col, 1, n)


def tokens(col: Column) -> Column:
    """TF-IDF tokens of cleaned (hence ASCII) text."""
    return F.regexp_extract_all(F.coalesce(col, F.lit("")), F.lit(C.TOKEN_PATTERN), F.lit(0))


def next_ngrams(grams: Column, toks: Column, n: int) -> Column:
    """n-grams out of the (n-1)-grams and the tokens that follow them: linear in the text."""
    length = F.greatest(F.size(toks) - (n - 1), F.lit(0))
    return F.zip_with(
        F.slice(grams, F.lit(1), length),
        F.slice(toks, F.lit(n), length),
        lambda left, right: F.concat(left, F.lit(" "), right),
    )


def has_gene(col: Column, gene: str) -> Column:
    """1 if the gene stands in the text as a whole word, else 0 (also for missing text)."""
    return F.coalesce(col.rlike(f"(?<!{WORD}){gene}(?!{WORD})"), F.lit(False)).cast("int")


@F.pandas_udf(T.StringType())
def _without_marks(texts: pd.Series) -> pd.Series:
    def plain(text):
        if text is None:
            return None
        return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))

    return texts.map(plain)


def strip_accents(col: Column) -> Column:
    """Compatibility decomposition without combining marks; ASCII text never leaves the JVM."""
    foreign = F.when(col.rlike(r"[^\x00-\x7f]"), col)
    return F.coalesce(_without_marks(foreign), col)
