"""Scalar functions on words and sentences (Column -> Column)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The function words that do not count as content.
STOPWORDS = "the a an and or but so to of in on for with at by from is it that this as be are was if then".split()


def normal(word: Column) -> Column:
    """Lower case without punctuation (Unicode category P); symbols such as ``$`` stay."""
    return F.regexp_replace(F.lower(word), r"\p{P}", "")


def ends_sentence(word: Column) -> Column:
    return word.endswith(".") | word.endswith("?") | word.endswith("!")


def content(norm: Column) -> Column:
    return (norm != "") & ~norm.isin(STOPWORDS)


def lcs_length(a: Column, b: Column) -> Column:
    """Longest common subsequence of two strings by rows of the usual table, inside the JVM."""
    left, right = F.split(a, ""), F.split(b, "")
    zero = F.transform(F.array_append(right, ""), lambda _: F.lit(0))

    def row(previous, x):
        start = F.array(F.lit(0))
        return F.aggregate(
            F.sequence(F.lit(1), F.size(right)), start,
            lambda acc, j: F.array_append(acc, F.when(F.element_at(right, j) == x, F.element_at(previous, j) + 1).otherwise(F.greatest(F.element_at(previous, j + 1), F.element_at(acc, j)))),
        )

    return F.when((a == "") | (b == ""), 0).otherwise(F.element_at(F.aggregate(left, zero, row), -1))


def ratio(a: Column, b: Column) -> Column:
    """Indel similarity, 0 to 100: ``200 * LCS / (len a + len b)``; two empty strings are equal."""
    total = F.length(a) + F.length(b)
    return F.when(total == 0, F.lit(100.0)).otherwise(F.lit(200.0) * lcs_length(a, b) / F.greatest(total, F.lit(1)))


def strip_inline(text: Column) -> Column:
    """Inline markup away: image to its text, link to its text, code to its text, emphasis marks gone."""
    text = F.regexp_replace(text, r"!\[([^\]]*)\]\([^)]*\)", "$1")
    text = F.regexp_replace(text, r"\[([^\]]*)\]\([^)]*\)", "$1")
    return F.regexp_replace(text, r"[*_`]", "")


def strip_comments(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)<!--.*?-->", "")


def strip_front_matter(text: Column) -> Column:
    return F.regexp_replace(text, r"\A---[ \t]*\n(?s:.*?)\n(?:---|\.\.\.)[ \t]*(?:\n|\z)", "")


def sentences(text: Column) -> Column:
    """Split after ``. ? !`` before white space or the end; the rest is a last sentence."""
    parts = F.regexp_extract_all(text, F.lit(r"(?s)(.+?(?:[.?!](?=\s|\z)|\z))"), F.lit(1))
    return F.filter(F.transform(parts, lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")


def natural_key(name: Column) -> Column:
    """A sort key in which digit runs compare as numbers (up to 12 digits)."""
    pieces = F.regexp_extract_all(name, F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.array_join(F.transform(pieces, lambda p: F.when(p.rlike(r"^\d+$"), F.lpad(p, 12, "0")).otherwise(F.lower(p))), "")
