"""WordPiece: words cut into the longest pieces of a given vocabulary, from the left.

The vocabulary is a parameter (a list of pieces, or a file of a public tokenizer); nothing is learned here. A piece that does not begin a word carries the prefix `##`. A word of which
some part is in no piece, or of more than `MOST_CHARS` characters, is one unknown piece. Words are runs of letters, digits and underscores, and each other character that is no blank, in
lower case. Matching walks a table by length, so a word costs at most its length times the longest piece; words seen before in a task are looked up.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = re.compile(r"\w+|[^\w\s]")
PREFIX, UNKNOWN, MOST_CHARS = "##", "[UNK]", 100
MOST_SEEN = 100_000


class WordPiece:
    def __init__(self, vocabulary: Iterable[str], prefix: str = PREFIX, unknown: str = UNKNOWN, most_chars: int = MOST_CHARS):
        self.first, self.later = set(), set()
        for piece in vocabulary:
            if prefix and piece.startswith(prefix) and piece != prefix:
                self.later.add(piece[len(prefix) :])
            else:
                self.first.add(piece)
        self.prefix, self.unknown, self.most_chars = prefix, unknown, most_chars
        self.longest = max(map(len, self.first | self.later), default=0)
        self.seen: dict[str, tuple[str, ...]] = {}

    def pieces(self, word: str) -> tuple[str, ...]:
        """The pieces of one word."""
        if word not in self.seen:
            if len(self.seen) >= MOST_SEEN:
                self.seen.clear()
            self.seen[word] = self.cut(word)
        return self.seen[word]

    def cut(self, word: str) -> tuple[str, ...]:
        out, a = [], 0
        while a < len(word) <= self.most_chars:
            known = self.later if a else self.first
            b = next((b for b in range(min(len(word), a + self.longest), a, -1) if word[a:b] in known), None)
            if b is None:
                return (self.unknown,)
            out.append(self.prefix * bool(a) + word[a:b])
            a = b
        return tuple(out) or (self.unknown,)

    def tokens(self, text: str) -> list[str]:
        return [p for w in WORD.findall(text.lower()) for p in self.pieces(w)]

    def count(self, text: str) -> int:
        return sum(len(self.pieces(w)) for w in WORD.findall(text.lower()))


def word_end_vocabulary(path: str, mark: str = "</w>") -> list[str]:
    """Pieces of a vocabulary file (JSON, model.vocab) that marks ends of words: each stands both at a word's start and behind it, without its mark."""
    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    bare = sorted({p.removesuffix(mark) for p in vocabulary} - {""})
    return bare + [PREFIX + p for p in bare]


def counter(vocabulary: Iterable[str]) -> Callable[[str], int]:
    """A token counter for chunks: `chunked(docs, ..., count=counter(vocabulary))`."""
    return WordPiece(vocabulary).count


def token_count(text: Column, vocabulary: Iterable[str]) -> Column:
    """Pieces of a text; 0 for null."""
    pieces = list(vocabulary)

    @F.pandas_udf("long")
    def count(texts):
        import pandas as pd

        cut = WordPiece(pieces)
        return pd.Series([cut.count(t) if t else 0 for t in texts], dtype="int64")

    return count(text)


def tokens(text: Column, vocabulary: Iterable[str], most: int | None = None) -> Column:
    """The first `most` pieces of a text (all without it); none for null."""
    pieces = list(vocabulary)

    @F.pandas_udf("array<string>")
    def cut(texts):
        import pandas as pd

        model = WordPiece(pieces)
        return pd.Series([model.tokens(t)[:most] if t else [] for t in texts])

    return cut(text)
