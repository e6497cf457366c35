"""Sizes of texts in tokens of a public byte-level BPE tokenizer. The rank file's path is a parameter; nothing is trained."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rank file used unless a caller names another one (a line: base64 of the token, its rank).
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern that splits text before the merges of such rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_loaded: dict = {}


def encoding(path: str = RANKS):
    """The tokenizer of a rank file; read once per process."""
    if path not in _loaded:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        _loaded[path] = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path]


def _counter(path: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoding(path).encode_ordinary
        for pdf in batches:
            texts = pdf["text"]
            lines = [t.find("\n") + 1 for t in texts]
            yield pd.DataFrame(
                {
                    "doc_id": pdf["doc_id"],
                    "source": pdf["source"],
                    "n_tokens": [len(encode(t)) for t in texts],
                    "prompt_tokens": [len(encode(t[:at])) if at else 0 for t, at in zip(texts, lines)],
                }
            )

    return run


def token_counts(documents: DataFrame, *, ranks: str = RANKS) -> DataFrame:
    """(doc_id, source, n_tokens, prompt_tokens) of every document with an id and a text that isn't empty.

    The first line of a text of several lines is its prompt; tokens after it bear loss.
    """
    rows = documents.filter("doc_id is not null and text is not null and text <> ''").select("doc_id", F.col("source").cast("string").alias("source"), "text")
    return rows.mapInPandas(_counter(ranks), "doc_id long, source string, n_tokens long, prompt_tokens long")
