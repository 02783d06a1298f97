"""Token counts of a public tokenizer. The vocabulary's path is a parameter; it must exist on every worker."""

from __future__ import annotations

import base64
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: the public pattern that parts text before byte-pair merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(4)
def encoding(path: str):  # noqa: ANN201 - the library is imported on workers only
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count(text: Column, path: str = TOKENIZER) -> Column:
    """Tokens of a text; null stays null, special tokens' strings are ordinary text."""

    @pandas_udf(T.LongType())
    def run(texts: pd.Series) -> pd.Series:
        enc = encoding(path)
        return texts.map(lambda t: len(enc.encode_ordinary(t)), na_action="ignore").astype("Int64")

    return run(text)


def exceeds(text: Column, limit: int) -> Column:
    """False only where a text cannot have more than `limit` tokens: a token of a byte-level vocabulary has at least a byte."""
    return F.octet_length(text) > limit
