"""Token counts and cuts by a tokenizer's file, in Arrow batches; without one, four characters are a token.

The file's path is a parameter and must be readable on every executor.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from loresmith.functions import text

_LOADED: dict = {}


def _tokenizer(path: str):
    """This worker's tokenizer of a file."""
    if path not in _LOADED:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _LOADED[path] = Tokenizer.from_file(path)
    return _LOADED[path]


def count(path: str, t: str) -> int:
    return len(_tokenizer(path).encode(t, add_special_tokens=False).ids)


def longest_prefix(path: str, t: str, budget: int) -> str:
    """A prefix within the budget that no longer one is found beyond, by halving the characters in question."""
    if count(path, t) <= budget:
        return t
    low, high = 0, len(t)
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if count(path, t[:mid]) <= budget else (low, mid - 1)
    return t[:low]


def token_count(c: Column, path: str | None = None) -> Column:
    """Tokens of a text (null: 0)."""
    if path is None:
        return F.coalesce(text.token_count(c), F.lit(0).cast("long"))

    @F.pandas_udf("long")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokenizer = _tokenizer(path)
        for s in batches:
            yield pd.Series([len(e.ids) for e in tokenizer.encode_batch_fast(s.fillna("").tolist(), add_special_tokens=False)], dtype="int64")

    return counted(c)


def truncate_tokens(c: Column, tokens: int, path: str | None = None) -> Column:
    """The longest prefix within the tokens, marked as cut (null: null)."""
    if path is None:
        return text.truncate_tokens(c, tokens)

    @F.pandas_udf("string")
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            out = []
            for t in s:
                head = t if t is None else longest_prefix(path, t, tokens)
                out.append(head if head == t else head + text.TRUNCATED)
            yield pd.Series(out, dtype="object")

    return cut(c)
