"""Text as Column expressions: folding, query terms, tokens and stems."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The words that a query is not matched on.
STOPWORDS = frozenset(
    """
    a an the this that these those and or but nor so then also if than of to in on at by for from with without into
    onto over under about as is are was were be been being am do does did done have has had having can could may might
    must shall should will would i you he she it we they me him her us them my your his its our their what when where
    which who whom whose why how no not there here
    """.split()
)
#: Suffixes in the order in which they are tried, and what a stem must keep.
SUFFIXES = ("ional", "ings", "edly", "ing", "ies", "ely", "est", "ed", "es", "ly", "s", "e")
MIN_STEM = 4
MIN_TOKEN = 2


def folded(text: Column) -> Column:
    """Case folding; of what lower() leaves, only the sharp s differs in the languages at hand."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def content_terms(text: str) -> list[str]:
    """Driver-side, one query: its folded words without stop words, or all of them if nothing else is left."""
    words = text.casefold().split()
    return [w for w in words if w not in STOPWORDS] or words


def coverage(haystack: Column, terms: list[str]) -> Column:
    """The share of terms, with repeats, that are substrings; 1 without terms."""
    if not terms:
        return F.lit(1.0)
    hits = sum((F.when(F.contains(haystack, F.lit(t)), terms.count(t)).otherwise(0) for t in dict.fromkeys(terms)), F.lit(0))
    return hits / F.lit(len(terms))


def score_text(score: Column) -> Column:
    """Two decimals, halves to even."""
    return F.format_string("%.2f", F.bround(score, 2))


def stem(token: Column) -> Column:
    out = token
    for suffix in reversed(SUFFIXES):
        fits = F.endswith(token, F.lit(suffix)) & (F.length(token) - len(suffix) >= MIN_STEM)
        out = F.when(fits, F.substring(token, F.lit(1), F.length(token) - len(suffix))).otherwise(out)
    return out


def tokens(text: Column) -> Column:
    words = F.regexp_extract_all(folded(text), F.lit("[a-z0-9]+"), F.lit(0))
    return F.transform(F.filter(words, lambda w: F.length(w) >= MIN_TOKEN), stem)
