"""Hundreds of terms found in one pass: an Aho-Corasick automaton over each text, and the filters that rest on its hits.

The automaton is built once a task from the terms, a parameter of `MOST_TERMS` entries at most. A text costs its length and its
occurrences, whatever the number of terms. A hit is (term, n, first): the place of the term in the list, its occurrences as `str.count`
counts them (from the left, without overlaps of the term with itself), and the characters before the first one.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_TERMS = 1_000_000
HITS = "array<struct<term:int,n:int,first:int>>"


def find_terms(text: Column, terms: Sequence[str]) -> Column:
    """The hits of all terms in a text, by term; null texts have none. Terms are taken as they are: lower-case both sides for matches that ignore case."""
    if len(terms) > MOST_TERMS or not all(terms):
        raise ValueError(f"at most {MOST_TERMS} terms, none of them empty")
    terms = list(terms)

    @F.pandas_udf(HITS)
    def find(texts):
        import ahocorasick
        import pandas as pd

        automaton = ahocorasick.Automaton()
        of: dict[str, list[int]] = {}
        for k, t in enumerate(terms):
            of.setdefault(t, []).append(k)
        for t, places in of.items():
            automaton.add_word(t, (len(t), places))
        automaton.make_automaton()

        def hits(t):
            found: dict[int, list[int]] = {}  # first place of a term -> n, first, end of the last counted one
            for end, (size, places) in automaton.iter(t) if t and of else ():
                start, seen = end + 1 - size, found.get(places[0])
                if seen is None:
                    found[places[0]] = [1, start, end]
                elif start > seen[2]:
                    seen[0] += 1
                    seen[2] = end
            return [{"term": k, "n": n, "first": first} for p in sorted(found) for k in of[terms[p]] for n, first, _ in [found[p]]]

        return pd.Series([hits(t) for t in texts])

    return find(text)


def hits_of(hits: Column, family: range) -> Column:
    """The hits of the terms from family.start to family.stop."""
    return F.filter(hits, lambda h: (h["term"] >= family.start) & (h["term"] < family.stop))


def occurrences(hits: Column) -> Column:
    return F.aggregate(hits, F.lit(0), lambda n, h: n + h["n"])


def families(*lists: Sequence[str]) -> tuple[list[str], list[range]]:
    """All terms in one list, and the places of each list's."""
    ends = [0, *reduce(lambda a, x: [*a, (a[-1] if a else 0) + len(x)], lists, [])]
    return [t for x in lists for t in x], [range(a, b) for a, b in zip(ends, ends[1:], strict=False)]


def with_hits(df: DataFrame, **found: Column) -> DataFrame:
    """df with columns of hits; functions of arrays take them as columns only."""
    return df.select("*", *[c.alias(name) for name, c in found.items()])


def dual_tier(docs: DataFrame, low: Column, title: Column, tier_one: Sequence[str], tier_two: Sequence[str], overlay: Sequence[str], least: int = 150, mentions: int = 3, near: int = 500) -> DataFrame:
    """The rows whose lower-cased text has `least` characters and a term of either tier, and the overlay: a term of it in the lower-cased title, or `mentions`
    of them, or one whose first place is less than `near` characters from the first of a term of the second tier."""
    terms, (one, two, over) = families(tier_one, tier_two, overlay)
    d = with_hits(docs.where(F.length(low) >= least), _hits=find_terms(low, terms), _titled=find_terms(title, list(overlay)))
    hits = F.col("_hits")
    close = F.exists(hits_of(hits, over), lambda a: F.exists(hits_of(hits, two), lambda b: F.abs(a["first"] - b["first"]) < near))
    tiers = F.size(hits_of(hits, range(one.start, two.stop))) > 0
    return d.where(tiers & ((F.size("_titled") > 0) | (occurrences(hits_of(hits, over)) >= mentions) | close)).drop("_hits", "_titled")


def white_black(docs: DataFrame, low: Column, white: Sequence[str], black: Sequence[str], phrases: Sequence[str], least: int = 200, head: int = 2500) -> DataFrame:
    """The rows whose lower-cased text has `least` characters, a phrase that ends within its head, three white terms, and at most three black ones for each white."""
    terms, (w, b, p) = families(white, black, phrases)
    d = with_hits(docs.where(F.length(low) >= least), _hits=find_terms(low, terms))
    hits = F.col("_hits")
    size = F.array(*[F.lit(len(t)) for t in terms])
    early = F.exists(hits_of(hits, p), lambda h: h["first"] + F.element_at(size, h["term"] + 1) <= head)
    n_white = F.size(hits_of(hits, w))
    return d.where(early & (n_white >= 3) & (F.size(hits_of(hits, b)) <= 3 * n_white)).drop("_hits")
