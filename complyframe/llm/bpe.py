"""Byte-level BPE: texts to token ids and back, for rank files of public tokenizers.

The merges of one match work on a segment tree over its byte positions. A leaf
holds the rank of the pair that starts at that byte, together with the byte's
position, so the root is the leftmost pair of the lowest rank. A merge changes
three leaves (the merged pair and its live neighbours), each in logarithmic
time, hence a match of n bytes costs O(n log n) however long it is.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from functools import cache, cached_property
from unicodedata import category

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from complyframe.llm.pieces import chunks, segments

#: Ids of this many pieces and matches are remembered by a Python worker, of up to so many characters each.
REMEMBERED_PIECES, REMEMBERED_MATCHES, LONGEST_REMEMBERED = 250_000, 900_000, 48
_NONE = 1 << 62
_POSITION = (1 << 32) - 1


def merged(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one match of the pre-tokenizer pattern."""
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    n = len(word)
    rank = ranks.get
    size = 1 << max(0, (n - 2)).bit_length()
    tree = [_NONE] * (2 * size)
    for i in range(n - 1):
        r = rank(word[i : i + 2])
        if r is not None:
            tree[size + i] = r << 32 | i
    for i in range(size - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))

    while (best := tree[1]) != _NONE:
        i = best & _POSITION
        gone = after[i]
        end = after[i] = after[gone]
        changed = []
        if gone < n - 1 and tree[size + gone] != _NONE:
            changed.append((gone, _NONE))
        r = None
        if end < n:
            before[end] = i
            r = rank(word[i : after[end]])
        changed.append((i, _NONE if r is None else r << 32 | i))
        if i:
            p = before[i]
            r = rank(word[p:end])
            value = _NONE if r is None else r << 32 | p
            if tree[size + p] != value:
                changed.append((p, value))
        for at, value in changed:
            k = size + at
            tree[k] = value
            # Up to the root, or to where the change makes no difference.
            while k > 1:
                other = tree[k ^ 1]
                if other < value:
                    value = other
                k >>= 1
                if tree[k] == value:
                    break
                tree[k] = value
    ids, i = [], 0
    while i < n:
        ids.append(ranks[word[i : after[i]]])
        i = after[i]
    return ids


@cache
def newer_characters(pattern: str) -> str:
    """Letters and digits that the ``regex`` module knows and tiktoken's older Unicode tables do not.

    Asked of tiktoken itself, with a vocabulary in which a candidate and the
    letter or digit before it are one token if the pattern lets them match.
    """
    import regex
    import tiktoken

    found = []
    every = "".join(chr(c) for c in range(0x80, 0x110000) if not 0xD800 <= c < 0xE000)
    for kind, lead in ((r"\p{L}", "a"), (r"\p{N}", "1")):
        new = [c for c in regex.findall(kind, every) if category(c) == "Cn"]
        ranks = {bytes([k]): k for k in range(256)} | {(lead + c).encode(): 256 + k for k, c in enumerate(new)}
        library = tiktoken.Encoding("probe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        found += [c for c in new if len(library.encode_ordinary(lead + c)) > 1]
    return "".join(found)


class Codec:
    """One rank file with its pre-tokenizer pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.tokens[i] = token
        self.split = pattern
        # A word with and without a comma behind it is two pieces, but one match.
        self.known: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    @cached_property
    def matchers(self) -> tuple:
        """For any text, for one with newer characters, and the set of these; decoding needs none of it."""
        import regex

        # \s of the pattern means the Unicode property, not Python's wider class.
        pattern = self.split.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")
        plain, newer = regex.compile(pattern).findall, newer_characters(self.split)
        for kind in (r"\p{L}", r"\p{N}") if newer else ():
            pattern = pattern.replace(kind, f"[{kind}--[{newer}]]")
        return plain, regex.compile(f"(?V1){pattern}").findall, frozenset(newer)

    @staticmethod
    @cache
    def load(path: str, pattern: str) -> Codec:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        return Codec(ranks, pattern)

    def _match(self, match: str) -> bytes:
        found = self.words.get(match)
        if found is None:
            found = array("I", merged(match.encode(), self.ranks)).tobytes()
            if len(match) <= LONGEST_REMEMBERED and len(self.words) < REMEMBERED_MATCHES:
                self.words[match] = found
        return found

    def _piece(self, piece: str) -> bytes:
        found = self.known.get(piece)
        if found is None:
            matches, without_newer, newer = self.matchers
            if not piece.isascii() and not newer.isdisjoint(piece):
                matches = without_newer
            found = b"".join(map(self._match, matches(piece)))
            if len(piece) <= LONGEST_REMEMBERED and len(self.known) < REMEMBERED_PIECES:
                self.known[piece] = found
        return found

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        pieces = segments(text)
        ids = list(map(self.known.get, pieces))
        for k, known in enumerate(ids):
            if known is None:
                ids[k] = self._piece(pieces[k])
        return b"".join(ids)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, memoryview(ids).cast("I")))


def encode(df: DataFrame, ranks_path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text"):
    """Per row: the id, ``n_tokens`` and ``ids`` (little-endian unsigned 32-bit integers).

    A null text counts as empty and has no tokens. Texts are encoded whole, a
    few MB at a time. Repeated rows and ids, null ids included, come out as
    often as they came in; other columns are dropped, so names cannot clash.
    ``ranks_path`` is opened on the executors.
    """
    source = df.select(F.col(id_column).alias("doc_id"), F.coalesce(text_column, F.lit("")).cast("binary").alias("text"))
    schema = f"doc_id {source.schema['doc_id'].dataType.simpleString()}, n_tokens bigint, ids binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.load(ranks_path, pattern)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for first, last in chunks(texts):
                ids = [codec.encode(text.decode("utf-8", "replace")) for text in texts[first:last]]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[first:last], pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())],
                    ["doc_id", "n_tokens", "ids"],
                )

    return source.mapInArrow(run, schema)


def decode(df: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Frames of :func:`encode` with ``decoded``, the bytes that the ids stand for, in place of nothing else."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema) + ", decoded binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.load(ranks_path, pattern)
        for batch in batches:
            ids = batch.column("ids").to_pylist()
            for first, last in chunks(ids):
                part = batch.slice(first, last - first)
                decoded = pa.array([None if x is None else codec.decode(x) for x in ids[first:last]], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns, decoded], [*part.schema.names, "decoded"])

    return df.mapInArrow(run, schema)
