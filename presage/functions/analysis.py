"""Analysis of text into terms, alike for columns, for stated values and for SQL.

Plain: the words of letters, in lower case. English: of those, the ones that are
no stop words, without their endings. The endings are one table of patterns,
which hold the same in Java, Python and RE2.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The usual English stop words.
STOP_WORDS = [
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in", "into", "is", "it", "no", "not", "of", "on", "or", "such", "that", "the", "their", "then", "there", "these",
    "they", "this", "to", "was", "will", "with",
]

#: (pattern, what stays), one after the other: plurals, past, gerund and adverb endings, doubled consonants, a last e, a last y.
ENDINGS = [
    (r"^(.{2,}ss)es$", r"\1"), (r"^(.{2,})ies$", r"\1y"), (r"^(.{2,}[^su])s$", r"\1"), (r"^(.*[aeiouy].*)ing$", r"\1"), (r"^(.*[aeiouy].*)ed$", r"\1"), (r"^(.{3,})ly$", r"\1"),
    *[(f"^(.+{c}){c}$", r"\1") for c in "bdfgmnprt"], (r"^(.{3,})e$", r"\1"), (r"^(.{2,})y$", r"\1i"),
]

ANALYZERS = (None, "english")
#: Letters that every term shares with the words that it stands for.
KEPT = 1


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda t: t != "")


def stem(word: Column) -> Column:
    return reduce(lambda w, rule: F.regexp_replace(w, rule[0], rule[1].replace("\\", "$")), ENDINGS, word)


def terms(text: Column, analyzer: str | None = None) -> Column:
    """The terms of a text, in order, repeats included."""
    if analyzer is None:
        return words(text)
    return F.transform(telling(words(text)), stem)


def telling(found: Column) -> Column:
    """Words that are no stop words."""
    return F.filter(found, lambda w: ~w.isin(STOP_WORDS))


def stated_words(text: object) -> list[str]:
    return [w for w in re.split(r"[\W\d_]+", str(text).lower()) if w]


def stated_terms(text: object, analyzer: str | None = None) -> list[str]:
    """The distinct terms of a stated value, in order."""
    found = stated_words(text)
    if analyzer is not None:
        found = [reduce(lambda w, rule: re.sub(rule[0], rule[1], w), ENDINGS, w) for w in found if w not in STOP_WORDS]
    return list(dict.fromkeys(found))


def near_terms(found: Column, wanted: list[str], analyzer: str | None = None) -> Column:
    """Of a text's words, the terms of those that begin like a wanted term: no other word can be one, so no other's endings are cut.

    An ending that goes leaves the start of its word, but for a last letter that a rule may change.
    """
    starts = sorted({t[: max(KEPT, len(t) - 1)] for t in wanted})
    like = lambda w: reduce(Column.__or__, [F.startswith(w, F.lit(s)) for s in starts], F.lit(False))
    near = F.filter(found, lambda w: F.left(w, F.lit(KEPT)).isin(sorted({s[:KEPT] for s in starts})) & like(w))
    return near if analyzer is None else F.transform(near, stem)


def has_term(text: Column, wanted: list[str], analyzer: str | None = None) -> Column:
    """Whether the text has one of the terms."""
    found = words(text)
    near = near_terms(found if analyzer is None else telling(found), wanted, analyzer)
    return F.arrays_overlap(near, F.array(*[F.lit(t) for t in wanted]).cast("array<string>"))


def term_counts(text: Column, wanted: list[str], analyzer: str | None = None) -> Column:
    """(size, counts): terms in the text, and how often it has each wanted one as an array. The text is cut into words once."""

    def counted(found: Column) -> Column:
        own = near_terms(found, wanted, analyzer)
        each = F.transform(F.array(own), lambda o: F.transform(F.array(*[F.lit(t) for t in wanted]), lambda t: F.size(F.filter(o, lambda x: x == t))))[0]
        return F.struct(F.size(found).alias("size"), each.alias("counts"))

    found = words(text) if analyzer is None else telling(words(text))
    return F.transform(F.array(found), counted)[0]


def terms_sql(text: str, analyzer: str | None = None) -> str:
    """terms() of an SQL expression."""
    found = f"list_filter(regexp_split_to_array(lower({text}), '[^\\p{{L}}]+'), lambda w: w <> '')"
    if analyzer is None:
        return found
    stops = ", ".join(f"'{w}'" for w in STOP_WORDS)
    cut = reduce(lambda w, rule: f"regexp_replace({w}, '{rule[0]}', '{rule[1]}')", ENDINGS, "w")
    return f"list_transform(list_filter({found}, lambda w: w not in ({stops})), lambda w: {cut})"
