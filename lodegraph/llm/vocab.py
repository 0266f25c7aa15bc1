"""The public byte-level vocabulary, loaded once per process from a path that is a parameter."""

from __future__ import annotations

import base64
from functools import lru_cache

BYTE_BPE_50K = "/opt/tokenizers/byte_bpe_50k.tiktoken"

#: Fixed value: the published split pattern of this vocabulary.
SPLIT_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def encoding(path: str = BYTE_BPE_50K):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("byte-bpe", pat_str=SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=1)
def splitter():
    import regex

    return regex.compile(SPLIT_PATTERN)
