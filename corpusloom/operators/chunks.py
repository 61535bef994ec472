"""Overlapping chunks of whole sentences under a token budget."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

SENTENCE = re.compile(r"(?<=[.!?])\s+")
TOKEN = re.compile(r"\w+|[^\w\s]")
BUDGET, OVERLAP, LEAST_WORDS = 450, 3, 20


def sentences(text: str) -> list[str]:
    return [s for s in (x.strip() for x in SENTENCE.split(text or "")) if s]


def token_count(sentence: str) -> int:
    return len(TOKEN.findall(sentence))


def chunk_bounds(tokens: list[int], budget: int = BUDGET, overlap: int = OVERLAP) -> Iterator[tuple[int, int]]:
    """[first, end) of each chunk: as many sentences as the budget holds, one at least; the next begins `overlap` before the end."""
    first = 0
    while first < len(tokens):
        end, total = first + 1, tokens[first]
        while end < len(tokens) and total + tokens[end] <= budget:
            total += tokens[end]
            end += 1
        yield first, end
        first = max(first + 1, end - overlap)


def chunked(docs: DataFrame, keep: list[str], budget: int = BUDGET, overlap: int = OVERLAP, least: int = LEAST_WORDS, count: Callable[[str], int] = token_count) -> DataFrame:
    """The columns `keep` of docs with chunk_no, n_tokens, n_words and text of each chunk of `least` words or more."""
    schema = docs.select(*keep).schema
    for name, kind in (("chunk_no", "integer"), ("n_tokens", "integer"), ("n_words", "integer"), ("text", "string")):
        schema = schema.add(name, kind)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for values, text in zip(batch[keep].itertuples(index=False, name=None), batch["text"], strict=True):
                parts = sentences(text)
                tokens, words = [count(s) for s in parts], [len(s.split()) for s in parts]
                no = 0
                for a, b in chunk_bounds(tokens, budget, overlap):
                    if sum(words[a:b]) >= least:
                        rows.append((*values, no, sum(tokens[a:b]), sum(words[a:b]), " ".join(parts[a:b])))
                        no += 1
            if rows:
                yield pd.DataFrame(rows, columns=schema.fieldNames())

    return docs.select(*dict.fromkeys([*keep, "text"])).mapInPandas(cut, schema)
