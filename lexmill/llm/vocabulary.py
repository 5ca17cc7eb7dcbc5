"""Vocabulary files of public tokenizers, loaded once per Python worker."""

from __future__ import annotations

import base64
import os
from functools import lru_cache

# one thread per task: Spark does the parallel work
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

from tokenizers import Tokenizer, models, pre_tokenizers  # noqa: E402


@lru_cache(maxsize=2)
def tokenizer_file(path: str) -> Tokenizer:
    """A saved tokenizer; strings of special tokens in a text are ordinary text."""
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


@lru_cache(maxsize=2)
def rank_file(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


@lru_cache(maxsize=1)
def byte_characters() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies.

    Printable Latin-1 characters stand for themselves; the other bytes take the
    characters from U+0100 on, in order.
    """
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


def split_by_rank(token: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The parts of a token just before its last merge: lowest ranks below its own merge first."""
    parts, limit = [token[i : i + 1] for i in range(len(token))], ranks[token]
    while len(parts) > 2:
        pairs = [(ranks.get(a + b, limit), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
        rank, i = min(pairs)
        if rank >= limit:
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts


@lru_cache(maxsize=2)
def from_ranks(path: str) -> Tokenizer:
    """The ranks as a byte-level BPE of the tokenizers library, for strings that are already split."""
    ranks, chars = rank_file(path), byte_characters()
    name = {token: "".join(chars[b] for b in token) for token in ranks}
    merges = []
    for token in sorted((t for t in ranks if len(t) > 1), key=ranks.get):
        parts = split_by_rank(token, ranks)
        if len(parts) == 2:
            merges.append((name[parts[0]], name[parts[1]]))
    t = Tokenizer(models.BPE(vocab={name[k]: r for k, r in ranks.items()}, merges=merges, cache_capacity=0))
    t.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    return t
