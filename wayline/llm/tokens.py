"""Token ids of a public byte-level BPE vocabulary, for use inside tasks."""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import tiktoken

#: How the vocabulary's own splitter cuts a text before merging.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same cuts for texts without two white-space characters in a row; it needs no look-ahead and so runs faster.
SPLIT_SINGLE_SPACES = SPLIT.replace(r"\s+(?!\S)|", "")
TWO_SPACES = re.compile(r"\s\s")
#: Fixed value: the vocabulary's added token, which its tokenizer also finds inside texts.
ADDED = {"<|endoftext|>": 50256}


@lru_cache(maxsize=2)
def encodings(ranks_path: str) -> tuple[tiktoken.Encoding, tiktoken.Encoding]:
    """Encoders for any text, and for texts without two white-space characters in a row."""
    with open(ranks_path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    make = lambda name, split: tiktoken.Encoding(name, pat_str=split, mergeable_ranks=ranks, special_tokens=ADDED)
    return make("any", SPLIT), make("single-spaced", SPLIT_SINGLE_SPACES)


def ids_of(text: str, ranks_path: str) -> list[int]:
    """Ids of a text, with none put around it; the string of an added token in a text is that token."""
    general, single = encodings(ranks_path)
    return (general if TWO_SPACES.search(text) else single).encode(text, allowed_special="all")
