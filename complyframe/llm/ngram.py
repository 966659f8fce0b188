"""Bigram language model in an Elias-Fano trie: learnt, stored and queried by Spark tasks.

Level 1 holds the words as sorted 64-bit hashes, a word's id being its rank,
with their counts. Level 2 holds, for the words of an id range, pointers to
their successors, and all successors as one monotone sequence: each id is
raised by the value in which the previous context ended. A bigram is looked up
by its context's pointers and the successor relative to that base. Levels are
files in the shared folder, mapped into memory by the tasks that score.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from complyframe.llm.eliasfano import EliasFano, from_buffer, to_bytes
from complyframe.llm.files import Folder
from complyframe.llm.pieces import chunks
from complyframe.llm.shared import shared_folder, stored

#: Absolute discount of a bigram's count.
DISCOUNT = 0.75
#: Steps per decade of the stored probabilities, and the largest code.
STEPS, MOST = 2048, 65535
#: Bytes of input per file of level 1, tokens per file of level 2, tokens a task counts before it passes them on.
WORD_FILE, BIGRAM_FILE, HELD = 8 << 20, 2_000_000, 3_000_000
_BLOB = "shard int, blob binary"


def token_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, and where each text starts; every text ends with one end token, hashed as empty."""
    from xxhash import xxh64_intdigest

    hashes: list[int] = []
    end, starts = xxh64_intdigest(b""), []
    for text in texts:
        starts.append(len(hashes))
        hashes += map(xxh64_intdigest, text.lower().split())
        hashes.append(end)
    return np.array(hashes, np.uint64), np.array(starts, np.int64)


def counted(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with how often they occur or the sum of their counts."""
    if counts is None:
        return np.unique(keys, return_counts=True)
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(keys) else counts


def _rows(shards: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One row per shard: its sorted keys and counts, compressed."""
    from zstandard import ZstdCompressor

    cut = np.flatnonzero(np.concatenate([[True], shards[1:] != shards[:-1]])) if len(shards) else []
    ends = [*cut[1:], len(shards)] if len(shards) else []
    names, blobs = [], []
    for first, last in zip(cut, ends, strict=True):
        own = keys[first:last]
        head, tail = (own >> np.uint64(32)).astype("<u4"), own.astype("<u4")
        steps = np.diff(head, prepend=np.uint32(0)).astype("<u4")
        raw = to_bytes({"head": steps, "tail": tail, "count": counts[first:last].astype("<u4")})
        names.append(int(shards[first]))
        blobs.append(ZstdCompressor(level=1).compress(raw))
    yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(blobs, pa.binary())], ["shard", "blob"])


def _merged(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    from zstandard import ZstdDecompressor

    keys, counts = [], []
    for blob in table.column("blob"):
        arrays = from_buffer(np.frombuffer(ZstdDecompressor().decompress(blob.as_py()), np.uint8))
        head = np.cumsum(arrays["head"], dtype=np.uint32).astype(np.uint64)
        keys.append((head << np.uint64(32)) | arrays["tail"])
        counts.append(arrays["count"].astype(np.int64))
    return counted(np.concatenate(keys), np.concatenate(counts))


def quantised(p: np.ndarray) -> np.ndarray:
    return np.minimum(np.rint(-np.log10(p) * STEPS), MOST).astype("<u2")


class Words:
    """Level 1: ids and counts of words by hash."""

    def __init__(self, uri: str, bits: int, sizes: list[int], tokens: int):
        self.folder, self.bits, self.tokens = Folder(uri), bits, tokens
        self.first = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.types = int(self.first[-1])
        self.files: dict[int, tuple[EliasFano, np.ndarray]] = {}

    def file(self, shard: int) -> tuple[EliasFano, np.ndarray]:
        if shard not in self.files:
            arrays = from_buffer(self.folder.octets(f"words-{shard}"))
            self.files[shard] = EliasFano.read(arrays, "hash"), arrays["count"]
        return self.files[shard]

    def lookup(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids (-1: unknown) and counts of sorted hashes."""
        ids, counts = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        shards, inner = shard_of(hashes, self.bits)
        for shard in np.unique(shards):
            if self.first[shard + 1] == self.first[shard]:
                continue
            own = np.flatnonzero(shards == shard) if self.bits else np.arange(len(hashes))
            sequence, count = self.file(int(shard))
            at = sequence.find(inner[own])
            hit = at >= 0
            ids[own[hit]] = at[hit] + self.first[shard]
            counts[own[hit]] = count[at[hit]]
        return ids, counts

    def counts(self, ids: np.ndarray) -> np.ndarray:
        out = np.zeros(len(ids), np.int64)
        shards = np.searchsorted(self.first, ids, "right") - 1
        order = np.argsort(shards, kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(shards[order])) + 1):
            if len(own):
                out[own] = self.file(int(shards[own[0]]))[1][ids[own] - self.first[shards[own[0]]]]
        return out

    def base(self, counts: np.ndarray) -> np.ndarray:
        """Add-one probability of a word by its count; a word never seen has count 0."""
        return (counts + 1.0) / (self.tokens + self.types + 1.0)


def shard_of(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash's file by its leading bits, and the rest."""
    if not bits:
        return np.zeros(len(hashes), np.int64), hashes
    return (hashes >> np.uint64(64 - bits)).astype(np.int64), hashes & np.uint64((1 << (64 - bits)) - 1)


class Bigrams:
    """Level 2: successors of each word, in files of ``width`` words."""

    def __init__(self, uri: str, width: int):
        self.folder, self.width = Folder(uri), width
        self.files: dict[int, tuple] = {}

    @staticmethod
    def build(contexts: np.ndarray, words: np.ndarray, counts: np.ndarray, n: int, vocabulary: Words) -> bytes:
        """The file of ``n`` words; sorted bigrams with contexts from 0, all of whose counts are here."""
        types = np.bincount(contexts, minlength=n)
        pointers = np.concatenate([[0], np.cumsum(types)])
        total = np.bincount(contexts, weights=counts, minlength=n)
        spare = DISCOUNT * types / np.maximum(total, 1)
        p = (counts - DISCOUNT) / total[contexts] + spare[contexts] * vocabulary.base(vocabulary.counts(words))
        # A context ends in its last successor; the next one counts on from there.
        ends = np.where(types > 0, words[np.maximum(pointers[1:] - 1, 0)] if len(words) else 0, 0)
        raised = words + np.concatenate([[0], np.cumsum(ends)])[contexts]
        arrays = EliasFano.build(pointers, len(words) + 1).arrays("pointer")
        arrays |= EliasFano.build(raised, int(raised[-1]) + 1 if len(raised) else 1).arrays("word")
        return to_bytes(arrays | {"p": quantised(p), "spare": quantised(np.where(types > 0, np.maximum(spare, 1e-32), 1.0))})

    def file(self, shard: int) -> tuple:
        if shard not in self.files:
            arrays = from_buffer(self.folder.octets(f"bigrams-{shard}"))
            self.files[shard] = EliasFano.read(arrays, "pointer"), EliasFano.read(arrays, "word"), arrays["p"], arrays["spare"]
        return self.files[shard]

    def log10(self, contexts: np.ndarray, words: np.ndarray, base: np.ndarray) -> np.ndarray:
        """log10 p(word | context) for sorted contexts; -1 is an unknown word, ``base`` its add-one probability."""
        out = np.log10(base)
        shards = np.where(contexts >= 0, contexts // self.width, -1)
        for own in np.split(np.arange(len(shards)), np.flatnonzero(np.diff(shards)) + 1):
            if not len(own) or shards[own[0]] < 0:
                continue
            pointers, sequence, p, spare = self.file(int(shards[own[0]]))
            local = contexts[own] - shards[own[0]] * self.width
            first, last = pointers[local].astype(np.int64), pointers[local + 1].astype(np.int64)
            before = np.where(first > 0, sequence[np.maximum(first - 1, 0)], np.uint64(0))
            known = words[own] >= 0
            at = np.full(len(own), -1, np.int64)
            at[known] = sequence.find(words[own][known].astype(np.uint64) + before[known], first[known], last[known])
            out[own] = np.where(at >= 0, p[np.maximum(at, 0)] / -float(STEPS), out[own] - spare[local] / float(STEPS))
        return out


@lru_cache(maxsize=1)
def _opened(uri: str, bits: int, sizes: tuple[int, ...], tokens: int, width: int) -> tuple[Words, Bigrams]:
    return Words(uri, bits, list(sizes), tokens), Bigrams(uri, width)


class Model:
    """Where the levels are and how they are cut; small, and sent to every task."""

    def __init__(self, uri: str, bits: int, sizes: tuple[int, ...], tokens: int, width: int):
        self.at = (uri, bits, sizes, tokens, width)
        self.tokens, self.types = tokens, sum(sizes)

    def open(self) -> tuple[Words, Bigrams]:
        return _opened(*self.at)


def _texts(df: DataFrame, id_column: str, text_column: str) -> DataFrame:
    key = F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")
    return df.select(
        F.col(id_column).alias("doc_id"),
        (F.crc32(key) % 7 == 2).alias("held_out"),
        F.coalesce(text_column, F.lit("")).cast("binary").alias("text"),
    )


def _in_bulk(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in batches:
        texts = batch.column("text").to_pylist()
        for first, last in chunks(texts):
            yield token_hashes(texts[first:last])


def learn(df: DataFrame, text_column: str = "text") -> Model:
    """Count, smooth and store a model of all rows' texts.

    Both counts are taken over every text, in the map tasks first; a file's
    tokens meet in one task, and files are cut so small that they fit there
    (a word's successors are distinct words, so no share of the rows piles up).
    """
    spark = df.sparkSession
    uri = f"{shared_folder(spark)}/trie"
    texts = df.select(F.coalesce(text_column, F.lit("")).cast("binary").alias("text"))
    size = min(int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())), 1 << 50)
    bits = min(16, max(3, ceil(log2(max(size, 1) / WORD_FILE)) if size > WORD_FILE else 3))

    def words_seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for hashes, _ in _in_bulk(batches):
            more, n = counted(hashes)
            keys, counts = counted(np.concatenate([keys, more]), np.concatenate([counts, n]))
            if len(keys) > HELD:
                yield from _rows(shard_of(keys, bits)[0], keys, counts)
                keys, counts = keys[:0], counts[:0]
        yield from _rows(shard_of(keys, bits)[0], keys, counts)

    def write_words(table: pa.Table) -> pa.Table:
        keys, counts = _merged(table)
        shard = table.column("shard")[0].as_py()
        sequence = EliasFano.build(shard_of(keys, bits)[1], 1 << (64 - bits))
        most = int(counts.max())
        Folder(uri).write(f"words-{shard}", to_bytes(sequence.arrays("hash") | {"count": counts.astype("<u4" if most < 1 << 32 else "<u8")}))
        return pa.table({"shard": pa.array([shard], pa.int32()), "types": [len(keys)], "tokens": [int(counts.sum())]})

    written = texts.mapInArrow(words_seen, _BLOB).groupBy("shard").applyInArrow(write_words, "shard int, types bigint, tokens bigint")
    # One row per file of level 1; the table is written so that the files are made once.
    sizes, tokens = [0] * (1 << bits), 0
    for row in stored(written, "words").collect():
        sizes[row["shard"]] = row["types"]
        tokens += row["tokens"]
    types = sum(sizes)
    if types >= 1 << 32:
        raise ValueError("more than 2^32 distinct words")
    width = max(1, ceil(types / max(1, ceil(tokens / BIGRAM_FILE))))
    model = Model(uri, bits, tuple(sizes), tokens, width)

    def bigrams_seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, _ = model.open()
        keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for hashes, starts in _in_bulk(batches):
            own, inverse = np.unique(hashes, return_inverse=True)
            ids = words.lookup(own)[0][inverse].astype(np.uint64)
            pairs = (contexts_of(ids, starts) << np.uint64(32)) | ids
            more, n = counted(pairs)
            keys, counts = counted(np.concatenate([keys, more]), np.concatenate([counts, n]))
            if len(keys) > HELD:
                yield from _rows((keys >> np.uint64(32)).astype(np.int64) // width, keys, counts)
                keys, counts = keys[:0], counts[:0]
        yield from _rows((keys >> np.uint64(32)).astype(np.int64) // width, keys, counts)

    def write_bigrams(table: pa.Table) -> pa.Table:
        keys, counts = _merged(table)
        shard = table.column("shard")[0].as_py()
        contexts = (keys >> np.uint64(32)).astype(np.int64) - shard * width
        words = (keys & np.uint64((1 << 32) - 1)).astype(np.int64)
        n = min(width, types - shard * width)
        Folder(uri).write(f"bigrams-{shard}", Bigrams.build(contexts, words, counts, n, model.open()[0]))
        return pa.table({"shard": pa.array([shard], pa.int32()), "bigrams": [len(keys)]})

    bigrams = texts.mapInArrow(bigrams_seen, _BLOB).groupBy("shard").applyInArrow(write_bigrams, "shard int, bigrams bigint")
    stored(bigrams, "bigrams")
    return model


def contexts_of(ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The token before each; before a text's first stands the end token, as if of the text before."""
    before = np.empty_like(ids)
    before[1:] = ids[:-1]
    before[0] = ids[-1]
    # Every text ends with the end token, so the last token overall serves for all starts.
    before[starts] = ids[-1]
    return before


def score(df: DataFrame, model: Model) -> DataFrame:
    """Frames of doc_id, held_out and text with n_tokens, n_known, train_tokens, base_score and score."""
    kind = df.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, bigrams = model.open()
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for first, last in chunks(texts):
                hashes, starts = token_hashes(texts[first:last])
                own, inverse = np.unique(hashes, return_inverse=True)
                ids, counts = words.lookup(own)
                # Words by their place in ``own``: pairs stay small and unknown words apart.
                pairs, which = np.unique(contexts_of(inverse, starts) * len(own) + inverse, return_inverse=True)
                contexts, follows = ids[pairs // len(own)], pairs % len(own)
                order = np.argsort(contexts, kind="stable")
                p = np.empty(len(pairs))
                p[order] = bigrams.log10(contexts[order], ids[follows[order]], words.base(counts[follows[order]]))
                sums = [
                    np.diff(np.append(starts, len(hashes))),
                    np.add.reduceat((counts > 0)[inverse].astype(np.int64), starts),
                    np.full(last - first, model.tokens),
                    np.add.reduceat(np.log10(words.base(counts))[inverse], starts),
                    np.add.reduceat(p[which], starts),
                ]
                part = batch.slice(first, last - first)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("held_out"), *[pa.array(x) for x in sums]],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return df.select("doc_id", "held_out", "text").mapInArrow(run, schema)


def scores(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    The model learns from the rows whose id, as text, has a CRC-32 that leaves
    another remainder than 2 by 7; a null id counts as empty text. A null text
    is empty and has the end token alone. Repeated rows are learnt and scored as
    often as they occur. Without rows to learn from every token has chance 1.
    Other columns are dropped.
    """
    texts = _texts(df, id_column, text_column)
    return score(texts, learn(texts.where("NOT held_out")))
