"""Text primitives as column expressions, JVM-side but for the compatibility forms of non-ASCII text."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Fixed patterns that define results.
WORD_BREAK = r"[^\p{L}\p{N}]+"
LEXICAL = r"[a-z0-9]+(?:[-'][a-z0-9]+)*"
TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\p{Z}\x{85}\x1c-\x1f]"
SPACE = r"[\s\p{Z}\x{85}\x1c-\x1f]+"


def words(text: Column) -> Column:
    """Runs of letters or digits of the lower-cased text, in order; NULL gives an empty array."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), WORD_BREAK), lambda w: w != "")


def _kernel(case):
    """Arrow function of NFKC and then `case`; nulls stay null."""

    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else case(unicodedata.normalize("NFKC", t)) for t in texts.to_pylist()], pa.string())

    return F.arrow_udf(run, StringType())


def _compatible(text: Column, case) -> Column:
    """NFKC, then `case`. Only rows with non-ASCII characters reach Python; ASCII text is merely lower-cased."""
    return F.coalesce(_kernel(case)(F.when(F.octet_length(text) > F.length(text), text)), F.lower(text))


def lowered(text: Column) -> Column:
    """NFKC and lower case."""
    return _compatible(text, str.lower)


def folded(text: Column) -> Column:
    """NFKC and case folding."""
    return _compatible(text, str.casefold)


def lex_tokens(text: Column) -> Column:
    """Lexical tokens: runs of a-z and 0-9 of the NFKC, lower-cased text, joined over inner hyphens and apostrophes."""
    return F.regexp_extract_all(lowered(F.coalesce(text, F.lit(""))), F.lit(LEXICAL), F.lit(0))


def tokens(text: Column) -> Column:
    """Budget tokens: word runs (with underscore) or single other non-space characters."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))


def count_tokens(text: Column) -> Column:
    return F.size(tokens(text))


def one_line(text: Column) -> Column:
    """White space collapsed to single blanks and trimmed."""
    return F.trim(F.regexp_replace(text, SPACE, " "))


def preview(text: Column, n: int = 160) -> Column:
    return F.substring(one_line(text), 1, n)
