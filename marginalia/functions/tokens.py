"""Counting tokens (TXT-6, FIL-9, AGG-8 to AGG-11): a public vocabulary by default, any other tokenizer by injection."""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache
from pathlib import Path

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

FOLDER = "/opt/tokenizers"
DEFAULT = "byte_bpe_50k"
# Fixed value: how the texts of these vocabularies are cut into words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
Counter = Callable[[Sequence[str]], Sequence[int]]


@lru_cache(maxsize=8)
def _encoding(name: str, folder: str):
    import tiktoken

    path = Path(folder, f"{name}.tiktoken")
    if not path.is_file():
        path = Path(folder, f"{DEFAULT}.tiktoken")
    ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in path.read_bytes().splitlines() if line)}
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def vocabulary(name: str = DEFAULT, folder: str = FOLDER) -> Callable[[], Counter]:
    """A maker of counters by a vocabulary file; a name without a file has that of ``DEFAULT``.  Markers in texts are plain text."""

    def make() -> Counter:
        held = _encoding(name, folder)
        return lambda texts: [len(x) for x in held.encode_ordinary_batch(list(texts), num_threads=1)]

    return make


def by_bytes() -> Counter:
    """The bound that needs no vocabulary: a token for each byte."""
    return lambda texts: [len(t.encode()) for t in texts]


def token_counts(texts: Column, counter: Callable[[], Counter] | None = None) -> Column:
    """The number of tokens of each text; null for null.  ``counter`` is called once per worker."""
    make = counter or vocabulary()

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count = make()
        for batch in batches:
            texts = batch.tolist()
            counted = iter(count([t for t in texts if t is not None]))
            yield pd.Series([None if t is None else next(counted) for t in texts], dtype="Int64")

    return F.pandas_udf(run, T.LongType())(texts)


def array_token_counts(texts: Column, counter: Callable[[], Counter] | None = None) -> Column:
    """The same for each text of an array, null for those that are null."""
    make = counter or vocabulary()

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count = make()
        for batch in batches:
            flat = [t for row in batch if row is not None for t in row if t is not None]
            counted = iter(count(flat)) if flat else iter(())
            yield pd.Series([None if row is None else [None if t is None else next(counted) for t in row] for row in batch], dtype=object)

    return F.pandas_udf(run, T.ArrayType(T.LongType()))(texts)


def excess(prompt: Column, budget: Column, overhead: int = 8) -> Column:
    """FIL-9's first look: the prompt where its bytes and the overhead exceed the budget, so that tokens must be counted; else null.

    A token holds at least one byte.
    """
    return F.when(F.octet_length(prompt) + overhead > budget, prompt)
