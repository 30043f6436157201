"""Text expressions. All are Columns of built-in functions, but for the exact accent folding by an Arrow UDF."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: White space as Unicode has it; Java's own \s is ASCII only.
WS = r"(?U)\s"


def _fold_table() -> tuple[str, str]:
    """Letters of the Latin blocks that decompose to one base letter and marks, and these base letters."""
    pairs = []
    for cp in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        parts = [c for c in unicodedata.normalize("NFKD", chr(cp)) if not unicodedata.combining(c)]
        if len(parts) == 1 and parts[0] != chr(cp):
            pairs.append((chr(cp), parts[0]))
    return "".join(p[0] for p in pairs), "".join(p[1] for p in pairs)


ACCENTED, PLAIN = _fold_table()


def ustrip(c: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+\z", "")


def fold_accents(c: Column) -> Column:
    """Base letters: precomposed Latin letters by table, combining marks dropped."""
    return F.regexp_replace(F.translate(c, ACCENTED, PLAIN), r"\p{M}+", "")


def _squeezed(c: Column) -> Column:
    return ustrip(F.regexp_replace(c, WS + "+", " "))


def normalize_street(c: Column) -> Column:
    """Lower case without parenthesised parts, accents and spare white space; never null, null gives ''."""
    bare = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)(?d)\s*\(.*?\)", "")
    return _squeezed(fold_accents(F.lower(bare)))


@F.pandas_udf(StringType())
def _nfkd(s: pd.Series) -> pd.Series:
    return s.map(lambda x: "".join(ch for ch in unicodedata.normalize("NFKD", x) if not unicodedata.combining(ch)))


def normalize_street_exact(c: Column) -> Column:
    """As normalize_street, with full compatibility decomposition (ligatures, fractions, other scripts), batch by batch in Python."""
    bare = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)(?d)\s*\(.*?\)", "")
    return _squeezed(_nfkd(F.lower(bare)))


def weak_norm(c: Column) -> Column:
    """Trimmed lower case with accents kept; null gives ''."""
    return F.lower(ustrip(F.coalesce(c, F.lit(""))))


def safe_str(c: Column) -> Column:
    """Trimmed; blank becomes null."""
    s = ustrip(c)
    return F.when(s != "", s)


def safe_int(c: Column) -> Column:
    """A whole number if the trimmed text is one, else null."""
    s = ustrip(c.cast("string"))
    return F.when(s.rlike(r"^[+-]?[0-9]+\z"), s.try_cast("bigint"))


def to_number(c: Column) -> Column:
    """A double if the trimmed text is a plain decimal number, else null."""
    s = ustrip(c.cast("string"))
    return F.when(s.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\z"), s.try_cast("double"))


def num_token(c: Column) -> Column:
    """Upper case with single spaces."""
    return _squeezed(F.upper(F.coalesce(c, F.lit(""))))


def slug(c: Column) -> Column:
    """Lower case, white space to underscores, only a-z, 0-9 and underscores."""
    return F.regexp_replace(F.regexp_replace(F.lower(ustrip(c)), WS + "+", "_"), "[^a-z0-9_]", "")
