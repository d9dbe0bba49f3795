"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reefglass.llm.batches import sliced

#: Folder and file of the vocabulary; a parameter, the file is never copied.
TOKENIZER = os.environ.get("REEFGLASS_TOKENIZER", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
#: Fixed value: how these vocabularies split text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def encoder(path: str = TOKENIZER):
    """A tiktoken encoding from a rank file."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(enc, text: str | None) -> int:
    """Tokens of the whole text, however long; 0 for null."""
    return len(enc.encode_ordinary(text.encode("utf-8", "replace").decode("utf-8"))) if text else 0


def token_sizes(docs: DataFrame, path: str = TOKENIZER, quality=None) -> DataFrame:
    """docs (doc_id, source, text) -> (doc_id, source, tokens, weight), one row per doc_id.

    ``quality`` maps a batch of texts to positive weights (1 if not given). Null and empty texts have 0 tokens.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(path)
        for pdf in sliced(batches):
            texts = pdf["text"].tolist()
            yield pd.DataFrame({
                "doc_id": pdf["doc_id"], "source": pdf["source"], "tokens": [count_tokens(enc, t) for t in texts],
                "weight": 1.0 if quality is None else quality(texts),
            })

    rows = docs.select("doc_id", "source", "text").where(F.col("doc_id").isNotNull())
    return rows.mapInPandas(run, "doc_id long, source string, tokens long, weight double").dropDuplicates(["doc_id"])
