"""Exact token counts with vocabulary files of public tokenizers; the files are read where they lie, never copied."""

from __future__ import annotations

import base64
from collections.abc import Callable

import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import LongType

#: Fixed value: how the byte-level vocabularies split text before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_COUNTERS: dict[str, Callable[[list[str]], list[int]]] = {}


def counter(path: str) -> Callable[[list[str]], list[int]]:
    """Texts -> tokens of each, for a vocabulary file whose ending tells its kind; loaded once per worker."""
    if path not in _COUNTERS:
        if path.endswith(".tiktoken"):
            import tiktoken

            with open(path, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            bpe = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
            _COUNTERS[path] = lambda texts: [len(bpe.encode_ordinary(t)) for t in texts]
        elif path.endswith(".model"):
            import sentencepiece

            pieces = sentencepiece.SentencePieceProcessor(model_file=path)
            _COUNTERS[path] = lambda texts: [len(x) for x in pieces.encode(texts, num_threads=1)]
        else:
            from tokenizers import Tokenizer

            words = Tokenizer.from_file(path)
            words.encode_special_tokens = True
            _COUNTERS[path] = lambda texts: [len(x.ids) for x in words.encode_batch(texts, add_special_tokens=False)]
    return _COUNTERS[path]


def token_count(path: str):
    """Column function: tokens of a text under the vocabulary file; 0 for null."""

    @pandas_udf(LongType())
    def count(texts: pd.Series) -> pd.Series:
        return pd.Series(counter(path)([t or "" for t in texts]), dtype="int64")

    return count
