"""Token ids of whole texts, from a public tokenizer's vocabulary file."""

from __future__ import annotations

import re
from array import array
from collections.abc import Sequence
from functools import lru_cache

import tiktoken
from tokenizers import Tokenizer

# Fixed value: how byte-level tokenizers of this family split a text before merging.
SPLIT_RULE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


LONG_BLANKS = 60_000
MANY_BLANKS = re.compile(rf"\s{{{LONG_BLANKS}}}")


class Encoder:
    """Byte-level BPE ids.

    The vocabulary and the special tokens come from the tokenizer's file.  The merging
    runs in tiktoken on that vocabulary: the ids are the same and it takes a third of the
    time.  Texts that spell a special token go through the tokenizer itself, and so do
    texts with a stretch of blanks that the merger's split can't take back.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        to_byte = byte_of_letter()
        vocabulary = {t: i for t, i in self.tokenizer.get_vocab().items() if t not in self.special}
        ranks = {bytes(to_byte[c] for c in token): i for token, i in vocabulary.items()}
        self.merger = tiktoken.Encoding("file", pat_str=SPLIT_RULE, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str | None) -> list[int]:
        """Ids of one text; a null has none."""
        if not text:
            return []
        if any(mark in text for mark in self.special) or (len(text) >= LONG_BLANKS and MANY_BLANKS.search(text)):
            return self.tokenizer.encode(text, add_special_tokens=False).ids
        return self.merger.encode_ordinary(text)

    def lengths(self, texts: Sequence[str | None]) -> list[int]:
        return [len(self.ids(text)) for text in texts]


def packed(ids: list[int]) -> bytes:
    """Unsigned 32-bit little-endian."""
    return array("I", ids).tobytes()


def byte_of_letter() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves, the others as letters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One encoder per worker process and vocabulary file."""
    return Encoder(path)


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """The public vocabulary file ``name``; its place is the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def split_pattern() -> str:
    """The pattern that the public byte-level vocabularies cut texts with."""
    import public_tokenizers

    return public_tokenizers.PATTERN
