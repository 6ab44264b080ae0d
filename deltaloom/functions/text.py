"""Tokens of text: split, trim, stopwords, and a caller's stemmer."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPLIT = r"[\s\-]+"
#: Separators as RE2 and so DuckDB's SQL read ``SPLIT``: without the vertical tab, which Java's ``\s`` has.
RE2_SPLIT = r"[\t\n\f\r \-]+"
RE2_PIECE = r"[^\t\n\f\r \-]"
#: Words that are never tokens, compared with case.
STOPWORDS = (
    "a able about across after all almost also am among an and any are as at be because been but by can cannot could dear did do does either "
    "else ever every for from get got had has have he her hers him his how however i if in into is it its just least let like likely may me "
    "might most must my neither no nor not of off often on only or other our own rather said say says she should since so some than that the "
    "their them then there these they this tis to too twas us wants was we were what when where which while who whom why will with would yet you your"
).split()


def split(text: Column, separators: str = SPLIT) -> Column:
    return F.split(text, separators)


def trim(token: Column) -> Column:
    """Without leading and trailing characters other than ASCII letters, digits and ``_``."""
    return F.regexp_replace(F.regexp_replace(token, r"^\W+", ""), r"\W+$", "")


def present(token: Column) -> Column:
    return token.isNotNull() & (token != "")


def wanted(token: Column) -> Column:
    return ~token.isin(STOPWORDS)


def tokens(text: Column, stem: Callable[[Column], Column] | None = None, separators: str = SPLIT) -> Column:
    """Tokens of a text in order, repeats included; null for null. ``stem`` maps a token column."""
    found = F.filter(F.transform(F.filter(split(text, separators), present), trim), lambda t: present(t) & wanted(t))
    return F.transform(found, stem) if stem else found
