"""Keyword lexicons: patterns, counts, first-match and scored classifiers. Lexicons are parameters; their order is meaning."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that stand for themselves, and the endings cut from the others.
FUNCTION_WORDS = ("a", "an", "the", "of", "to", "in", "on", "at", "by", "for", "and", "or")
ENDINGS = ("ing", "ed", "es", "s", "tion", "sion", "ive", "ment", "al", "ly", "ance", "ence", "able", "ible", "ise", "ize", "ship", "ness", "ity", "ous", "ful", "less")
LEAST_STEM = 4


def stem(word: str) -> str:
    """The word without its ending, unless fewer than four characters would be left. The ending that starts first is cut."""
    cut = [len(word) - len(e) for e in ENDINGS if word.endswith(e)]
    short = word[: min(cut)] if cut else word
    return short if len(short) >= LEAST_STEM else word


def word_pattern(word: str) -> str:
    if word in FUNCTION_WORDS:
        return re.escape(word)
    s = stem(word)
    if s.startswith("de") and len(s) > 4:
        return rf"(?:de[- ]?)?{re.escape(s[2:])}\w*"
    return rf"{re.escape(s)}\w*"


def keyword_pattern(keyword: str) -> str:
    """A pattern for all forms of a keyword; its words are joined by blanks or hyphens."""
    return r"\b" + r"[\s\-]+".join(map(word_pattern, keyword.lower().split())) + r"\b"


def java(pattern: str) -> str:
    """With Unicode classes, as the patterns are meant."""
    return "(?U)" + pattern


def any_of(text: Column, terms: Iterable[str], whole_words_up_to: int = 3) -> Column:
    """Whether any term occurs: terms of few characters as whole words, others anywhere. One pass over the text."""
    parts = [rf"\b{re.escape(t.lower())}\b" if len(t) <= whole_words_up_to else re.escape(t.lower()) for t in terms]
    return F.lower(text).rlike("|".join(parts)) if parts else F.lit(False)


def times(text: Column, term: str) -> Column:
    """Non-overlapping occurrences of a term."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(term), F.lit("")))) / len(term)).cast("int")


def n_present(text: Column, terms: Iterable[str]) -> Column:
    """How many of the terms occur."""
    return F.aggregate(F.array(*[F.lit(t) for t in terms]), F.lit(0), lambda n, t: n + F.when(F.contains(text, t), 1).otherwise(0))


def total_times(text: Column, terms: Iterable[str], most: int | None = None) -> Column:
    out = F.lit(0)
    for t in terms:
        out = out + (F.least(times(text, t), F.lit(most)) if most else times(text, t))
    return out


def first_match(text: Column, rules: list[tuple[str, list[str]]], default: str, present: Callable[[Column, str], Column] = F.contains) -> Column:
    """The label of the first rule one of whose terms occurs."""
    out = None
    for label, terms in rules:
        hit = None
        for t in terms:
            one = present(text, F.lit(t) if present is F.contains else t)
            hit = one if hit is None else hit | one
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(default)


def best_label(scores: list[tuple[str, Column]], least: float, default: str) -> Column:
    """The label of the highest score that is at least `least`; of equal scores the first."""
    ranked = F.array_max(F.array(*[F.struct(s.cast("double").alias("score"), F.lit(-i).alias("order"), F.lit(label).alias("label")) for i, (label, s) in enumerate(scores)]))
    return F.when(ranked["score"] >= least, ranked["label"]).otherwise(default)


def last_segment(uri: Column) -> Column:
    """What stands behind the last slash of an address; slashes at its end do not count."""
    return F.substring_index(F.rtrim(uri, F.lit("/")), "/", -1)


def by_priority(candidates: Column, rules: list[tuple[str, list[str], int]], default: str) -> Column:
    """The label of the rule of smallest priority one of whose terms lies in any of the candidates, whatever the case; equal priorities in
    their order. Null and empty candidates hold no term."""
    upper = F.transform(candidates, lambda c: F.upper(c))

    def held(terms: list[str]) -> Column:
        any_term = "|".join(re.escape(t.upper()) for t in terms)
        return F.exists(upper, lambda c: F.coalesce(c.rlike(any_term), F.lit(False)))

    out = F.lit(default)
    for label, terms, _ in reversed(sorted(rules, key=lambda r: r[2])):
        out = F.when(held(terms), label).otherwise(out)
    return out


def most_terms(text: Column, rules: list[tuple[str, list[str]]], default: str) -> Column:
    """The label most of whose terms occur, of equal ones the first; the default where none does."""
    return best_label([(label, n_present(text, terms)) for label, terms in rules], 1, default)


def scored_topic(title: Column, body: Column, rules: list[tuple[str, list[str]]], strong: set[str], least: float = 5, default: str = "other") -> Column:
    """Sum over terms of min(count in body, 5) and 2 for the title, three times for strong terms; the best label of `least` or more."""
    scores = []
    for label, terms in rules:
        total = F.lit(0)
        for t in terms:
            weight = 3 if t in strong else 1
            total = total + (F.least(times(body, t), F.lit(5)) + F.when(F.contains(title, F.lit(t)), 2).otherwise(0)) * weight
        scores.append((label, total))
    return best_label(scores, least, default)
