"""Ids of a byte-level BPE file of the ``tokenizers`` library, worked out by ``tiktoken``.

``tiktoken`` merges the adjacent pair whose concatenation has the lowest rank;
the library merges by its list of pairs, which names one pair per token. Both
give the same ids if the library, given any token's own bytes, makes that one
token of them. Merges inside a span whose outside never reaches into it follow
the span's own bytes alone, so two neighbours that ``tiktoken`` can join are
always the pair that the list names. ``tests/llm`` checks that for every token.
"""

from __future__ import annotations

import json
from functools import cache

import public_tokenizers


@cache
def byte_of() -> dict[str, int]:
    """The byte that a character of a byte-level vocabulary stands for: printable ones themselves, the others 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class ByteBpe:
    """A vocabulary file with its own special tokens; ``special`` says whether a text's mention of one counts as such."""

    def __init__(self, path: str, special: bool):
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            content = file.read()
        spec, to_byte = json.loads(content), byte_of()
        self.special = [t["content"] for t in spec["added_tokens"] if t["special"]] if special else []
        added = {t["content"] for t in spec["added_tokens"]}
        self.tokens = {i: bytes(map(to_byte.__getitem__, t)) for t, i in spec["model"]["vocab"].items() if t not in added}
        self.library = Tokenizer.from_str(content) if special else None
        ranks = {octets: i for i, octets in self.tokens.items()}
        self.fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    @staticmethod
    @cache
    def load(path: str, special: bool) -> ByteBpe:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        return ByteBpe(path, special)

    def encode(self, text: str) -> list[int]:
        if any(mention in text for mention in self.special):
            return self.library.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)
