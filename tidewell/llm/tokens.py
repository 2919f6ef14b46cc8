"""Token counts of whole texts with a public tokenizer's vocabulary file."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Folder of the vocabulary files; every executor must have it.
TOKENIZERS = os.environ.get("TIDEWELL_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Fixed value: how the byte-level vocabulary divides a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_loaded: dict = {}


def encoding(folder: str = TOKENIZERS, vocabulary: str = VOCABULARY):
    """The tokenizer, loaded once per process; special tokens' strings are ordinary text."""
    import tiktoken

    path = os.path.join(folder, vocabulary)
    if path not in _loaded:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
        _loaded[path] = tiktoken.Encoding(vocabulary, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path]


def token_count(text: Column | str, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> Column:
    """Tokens of the whole text as a long; 0 for null and empty texts."""

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = encoding(folder, vocabulary)
        for batch in batches:
            yield batch.map(lambda t: len(own.encode_ordinary(t)) if t else 0).astype("int64")

    return count(text)


def with_tokens(documents: DataFrame, row_id: str, text: str, keep: list[str] | None = None, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """row_id, the columns keep and n_tokens of every document with a row_id."""
    return documents.where(F.col(row_id).isNotNull()).select(row_id, *(keep or []), token_count(text, folder, vocabulary).alias("n_tokens"))
