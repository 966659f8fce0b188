"""Cut a text where no pre-tokenizer match can cross, so that pieces can be cached."""

from __future__ import annotations

import re

_RUN = re.compile(r"\s\s")
_LONE_SPACE = re.compile(r"(?<=\S) (?=\S)")


def segments(text: str) -> list[str]:
    """``text`` in pieces, each but the first with the one space in front of it.

    GPT-2 style patterns let white space start a match only, and join at most
    one space to what follows. A space between two other characters therefore
    always starts a new match, whatever surrounds it.
    """
    parts = (_LONE_SPACE.split(text) if _RUN.search(text) else text.split(" ")) if text else []
    return parts[:1] + [" " + part for part in parts[1:]]


def chunks(values: list, limit: int = 4 << 20):
    """Slices ``(first, last)`` of a list of strings or bytes of about ``limit`` characters each."""
    first = size = 0
    for k, value in enumerate(values):
        size += len(value)
        if size >= limit:
            yield first, k + 1
            first, size = k + 1, 0
    if first < len(values):
        yield first, len(values)
