"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import map_arrow

#: Path of the vocabulary (ranks, one base64 token and rank a line); a parameter wherever sizes are taken.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed value: the split pattern of byte-level BPE.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_sizes(docs: DataFrame, keep: tuple[str, ...] = (), vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, *keep, tokens), one row a doc_id; null and empty texts have 0 tokens.

    Rows repeated as they are become one; of different rows with one doc_id the least row by (tokens, keep) stays.
    """

    def rows(ids, texts, *rest):
        e = encoder(vocabulary)
        for i, t, *r in zip(ids, texts, *rest):
            if i is not None:
                yield (i, len(e.encode_ordinary(t)) if t else 0, *r)

    out = map_arrow(docs.select("doc_id", "text", *keep), rows, ", ".join(["doc_id long", "tokens int", *(f"{c} string" for c in keep)]))
    return out.groupBy("doc_id").agg(F.min(F.struct("tokens", *keep)).alias("r")).select("doc_id", *(f"r.{c}" for c in keep), "r.tokens")
