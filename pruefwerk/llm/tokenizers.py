"""Public tokenizers inside Python workers. The folder with the vocabulary files is a parameter."""

from __future__ import annotations

import base64
import functools
import os

#: Where the public vocabulary files lie, unless a caller names another folder.
DEFAULT_FOLDER = "/opt/tokenizers"

#: Fixed value: the published pre-tokenization pattern of the byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@functools.cache
def encoding(name: str, folder: str = DEFAULT_FOLDER):
    """The byte-level vocabulary ``name`` as an encoder without special tokens; once in each worker."""
    import tiktoken

    with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class PretokenCounts(dict):
    """Number of tokens of each pre-token seen, for one vocabulary.

    Byte-level BPE never merges across pre-tokens, so that a text's count is the sum over its pre-tokens. The memo is
    emptied at ``most`` entries and doesn't keep long pre-tokens, so that its memory is bounded.
    """

    def __init__(self, name: str, folder: str, most: int = 400_000):
        super().__init__()
        self.encode, self.most = encoding(name, folder).encode_ordinary, most

    def __missing__(self, pretoken: str) -> int:
        n = len(self.encode(pretoken))
        if len(pretoken) <= 40:
            if len(self) >= self.most:
                self.clear()
            self[pretoken] = n
        return n
