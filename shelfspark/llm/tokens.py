"""Token ids of the public byte-level BPE vocabulary.

The vocabulary's ids are those of the `tokenizers` library. The same vocabulary is also read as ranks by `tiktoken`,
which takes a quarter of the CPU time. Both split texts by the same pattern, but their classes of letters and digits
come from different Unicode versions; so only texts within Latin-1, whose classes are settled, take the fast way. Texts
with a special token's string, and very long ones, go to `tokenizers` too.
"""

from __future__ import annotations

import base64
import os
from functools import cache

import numpy as np

#: Longer texts go to `tokenizers`.
FAST_CHARS = 1_000_000


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@cache
def slow_tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@cache
def fast_tokenizer(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@cache
def special_strings(path: str) -> tuple[str, ...]:
    return tuple(t.content for t in slow_tokenizer(path).get_added_tokens_decoder().values())


class ByteBpe:
    """ids(text): uint32 ids as `tokenizers` gives them with add_special_tokens=False."""

    def __init__(self, vocabulary: str | None = None, ranks: str | None = None):
        self.vocabulary = vocabulary or vocabulary_path("byte_bpe_50k.json")
        self.ranks = ranks or vocabulary_path("byte_bpe_50k.tiktoken")

    def ids(self, text: str) -> np.ndarray:
        fast = len(text) <= FAST_CHARS and (text.isascii() or self._latin(text))
        if fast and not any(s in text for s in special_strings(self.vocabulary)):
            return np.array(fast_tokenizer(self.ranks).encode_ordinary(text), np.uint32)
        return np.array(slow_tokenizer(self.vocabulary).encode(text, add_special_tokens=False).ids, np.uint32)

    @staticmethod
    def _latin(text: str) -> bool:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return False
        return True
