"""Packing tokenized documents into sequences by bin completion.

Pieces of one length are interchangeable, so the search works on how many
pieces there are of each length: at most as many numbers as a sequence has
tokens. A filling is chosen for the largest length left and used as often as
its counts allow, so the number of decisions does not grow with the input.
Pieces then take their places by their rank among those of their length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import islice, takewhile
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from complyframe.llm.bytebpe import ByteBpe
from complyframe.llm.pieces import chunks
from complyframe.llm.shared import stored
from complyframe.operators.ordered import positions

CAPACITY, END = 2048, 0
#: Fillings looked at in all before the best packing so far is taken and its gap reported.
EXAMINED = 20_000
#: With at most FEW lengths left, fillings are put in order, this many at a time.
FEW, ORDERED = 6, 256
SLICES = 256


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: all full but perhaps the first."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *[(start, capacity) for start in range(first, n, capacity)]]


def tokenized(
    df: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, salt. A document ends with id 0, so an empty one has one token.

    ``salt`` tells rows apart that are equal in everything else, 256 ways.
    """
    source = df.select(F.col(id_column).alias("doc_id"), F.coalesce(text_column, F.lit("")).cast("binary").alias("text"))
    schema = f"doc_id {source.schema['doc_id'].dataType.simpleString()}, piece int, start bigint, length bigint, ids_crc32 bigint, salt int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = ByteBpe.load(tokenizer_path, True)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for first, last in chunks(texts):
                rows = []
                for k in range(first, last):
                    ids = np.array([*tokens.encode(texts[k].decode("utf-8", "replace")), END], "<u4").tobytes()
                    for piece, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                        rows.append((k, piece, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), k % SLICES))
                at, piece, start, length, crc, salt = map(list, zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").take(pa.array(at)),
                        pa.array(piece, pa.int32()),
                        *[pa.array(x, pa.int64()) for x in (start, length, crc)],
                        pa.array(salt, pa.int32()),
                    ],
                    ["doc_id", "piece", "start", "length", "ids_crc32", "salt"],
                )

    return source.mapInArrow(run, schema)


def dominates(a: tuple[int, ...], b: tuple[int, ...]) -> bool:
    """Whether the items of b can be dealt into those of a, each item of a holding its share."""
    room = list(a)

    def deal(k: int) -> bool:
        if k == len(b):
            return True
        for i in range(len(room)):
            if room[i] >= b[k] and room[i] not in room[:i]:
                room[i] -= b[k]
                if deal(k + 1):
                    return True
                room[i] += b[k]
        return False

    return sum(a) >= sum(b) and deal(0)


class Reach:
    """Which sums pieces of the lengths left can make, from each length down: bit s of ``sums[k]`` for lengths[k:]."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.lengths = sorted((x for x, n in counts.items() if n), reverse=True)
        self.capacity, self.all = capacity, (1 << (capacity + 1)) - 1
        self.copies = [0] * len(self.lengths)
        self.sums = [1] * (len(self.lengths) + 1)
        self.at = {x: k for k, x in enumerate(self.lengths)}
        self.update(counts, self.lengths)

    def update(self, counts: dict[int, int], changed) -> None:
        """Work the table anew from the shortest length whose useful copies changed."""
        lowest = -1
        for x in changed:
            k = self.at[x]
            useful = min(counts[x], self.capacity // x)
            if useful != self.copies[k]:
                self.copies[k], lowest = useful, max(lowest, k)
        for k in range(lowest, -1, -1):
            sums, left, step = self.sums[k + 1], self.copies[k], 1
            while left:
                take = min(step, left)
                sums |= (sums << (take * self.lengths[k])) & self.all
                left, step = left - take, 2 * step
            self.sums[k] = sums

    def exact(self, k: int, total: int) -> Iterator[tuple[int, ...]]:
        """All sets of pieces of lengths[k:] that add up to ``total``: large lengths first, every number of copies from the most."""
        if not total:
            yield ()
            return
        for j in range(k, len(self.lengths)):
            if not self.sums[j] >> total & 1:
                return
            x = self.lengths[j]
            for n in range(min(self.copies[j], total // x), 0, -1):
                if self.sums[j + 1] >> (total - n * x) & 1:
                    for rest in self.exact(j + 1, total - n * x):
                        yield (x,) * n + rest


class Budget:
    """How many more fillings may be looked at."""

    def __init__(self, left: int):
        self.left = left


def fillings(
    counts: dict[int, int], capacity: int, reach: Reach | None = None, budget: Budget | None = None
) -> Iterator[tuple[int, ...]]:
    """Undominated fillings around the largest piece left, by rising waste.

    None is left out but those that an earlier one with at most a dozen pieces
    dominates: it holds as much in fewer, larger pieces. Which sums can be made
    is known beforehand, so no branch ends without a filling. A filling that
    leaves room for another piece is not among them. The end comes early when
    the budget is spent.
    """
    reach, budget = reach or Reach(counts, capacity), budget or Budget(1 << 62)
    present = sorted(x for x, n in counts.items() if n)
    first = next(k for k, x in enumerate(reach.lengths) if counts[x])
    largest = reach.lengths[first]
    earlier: list[tuple[int, ...]] = []
    for waste in range(capacity - largest + 1):
        room = capacity - largest - waste
        for n in range(min(reach.copies[first] - 1, room // largest), -1, -1):
            if not reach.sums[first + 1] >> (room - n * largest) & 1:
                continue
            for rest in reach.exact(first + 1, room - n * largest):
                if budget.left <= 0:
                    return
                budget.left -= 1
                filling = (largest,) * (n + 1) + rest
                if any(counts[x] > filling.count(x) for x in takewhile(lambda x: x <= waste, present)):  # noqa: B023
                    continue
                if len(filling) <= 12 and any(dominates(e[n + 1 :], rest) for e in earlier if e[: n + 1] == filling[: n + 1]):
                    continue
                if len(filling) <= 12 and len(earlier) < 64:
                    earlier.append(filling)
                yield filling


def _uses(filling: tuple[int, ...], counts: dict[int, int]) -> int:
    return min(counts[x] // filling.count(x) for x in set(filling))


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """(uses, lengths) by best fit: beside the largest length left always the largest that fits."""
    left, result = dict(counts), []
    for largest in sorted(left, reverse=True):
        while left[largest]:
            filling, room = [largest], capacity - largest
            for x in sorted(left, reverse=True):
                if x <= room:
                    n = min(left[x] - filling.count(x), room // x)
                    filling += [x] * max(n, 0)
                    room -= x * max(n, 0)
            uses = _uses(tuple(filling), left)
            for x in filling:
                left[x] -= uses
            result.append((uses, tuple(filling)))
    return result


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """No packing needs fewer sequences: by tokens, and by pieces too long to share one.

    For every k up to half a sequence: pieces longer than capacity - k are
    alone among those of at least k; the other large ones leave known room.
    """
    n, size = np.zeros(capacity + 2, np.int64), np.arange(capacity + 2)
    for x, c in counts.items():
        n[x] = c
    above, tokens = n[::-1].cumsum()[::-1], (n * size)[::-1].cumsum()[::-1]
    best = -(-int(tokens[0]) // capacity)
    half = capacity // 2 + 1
    for k in range(half):
        alone, large = int(above[capacity - k + 1]), int(above[half] - above[max(capacity - k + 1, half)])
        room = large * capacity - int(tokens[half] - tokens[max(capacity - k + 1, half)])
        small = int(tokens[k] - tokens[half])
        best = max(best, alone + large + max(0, -(-(small - room) // capacity)))
    return best


class Packing(NamedTuple):
    """(uses, lengths) of all sequences, how many they are, and how many any packing needs at least."""

    plan: list[tuple[int, tuple[int, ...]]]
    sequences: int
    bound: int


def _balanced(found: Iterator[tuple[int, ...]], counts: dict[int, int], capacity: int) -> Iterator[tuple[int, ...]]:
    """The same fillings; of every ORDERED in turn those first that use the pieces most evenly, less waste before more."""
    share = capacity / sum(x * n for x, n in counts.items())
    while batch := list(islice(found, ORDERED)):
        yield from sorted(batch, key=lambda f: (-sum(f), sum(x * abs(f.count(x) - share * n) for x, n in counts.items())))


def _choices(counts: dict[int, int], capacity: int, reach: Reach, budget: Budget) -> Iterator[tuple[int, tuple[int, ...]]]:
    """Every filling, first as often as its pieces allow, then half as often, down to once.

    Of many lengths any full filling will do. Few must be used in proportion,
    or what is left no longer fits together.
    """
    found = fillings(counts, capacity, reach, budget)
    counts = {x: n for x, n in counts.items() if n}
    for filling in _balanced(found, counts, capacity) if len(counts) <= FEW else found:
        uses = _uses(filling, counts)
        while uses:
            yield uses, filling
            uses //= 2


def complete(counts: dict[int, int], capacity: int = CAPACITY, examined: int = EXAMINED) -> Packing:
    """A packing of all pieces by bin completion.

    Depth-first branch and bound from the best-fit incumbent: at each step the
    largest piece left is given a filling, as often as its pieces allow or less
    often. A branch ends when its waste so far shows that it cannot need fewer
    sequences than the incumbent; where the search stops, best fit completes
    the branch. It ends at the lower bound, which proves the packing best, or
    after ``examined`` fillings; ``sequences - bound`` is then the most that
    can be gained.
    """
    counts = {x: n for x, n in counts.items() if n}
    if not counts:
        return Packing([], 0, 0)
    tokens, bound = sum(x * n for x, n in counts.items()), lower_bound(counts, capacity)
    best = best_fit(counts, capacity)
    fewest = sum(n for n, _ in best)
    state, path, waste = dict(counts), [], 0
    reach, budget = Reach(state, capacity), Budget(examined)
    stack: list[Iterator[tuple[int, tuple[int, ...]]]] = []
    descending = True

    def apply(uses: int, filling: tuple[int, ...]) -> int:
        for x in filling:
            state[x] -= uses
        reach.update(state, set(filling))
        return uses * (capacity - sum(filling))

    if fewest > bound:
        stack.append(_choices(dict(state), capacity, reach, budget))
    while stack:
        allowed = (fewest - 1) * capacity - tokens - waste
        uses, filling = next(stack[-1], (0, ()))
        spare = capacity - sum(filling)
        if allowed < 0:
            uses = 0
        elif uses and spare:
            # No more often than the bound still allows; fillings that follow waste as much or more.
            uses = min(uses, allowed // spare)
        if not uses:
            if descending or budget.left <= 0:
                rest = best_fit({x: n for x, n in state.items() if n}, capacity)
                if sum(n for n, _ in path) + sum(n for n, _ in rest) < fewest:
                    best = [*path, *rest]
                    fewest = sum(n for n, _ in best)
                descending = False
            if fewest <= bound or budget.left <= 0:
                break
            stack.pop()
            if path:
                uses, filling = path.pop()
                waste += apply(-uses, filling)
            continue
        waste += apply(uses, filling)
        path.append((uses, filling))
        if any(state.values()):
            stack.append(_choices(dict(state), capacity, reach, budget))
            continue
        best, descending = list(path), False
        fewest = sum(n for n, _ in path)
        path.pop()
        waste += apply(-uses, filling)
        if fewest <= bound:
            break
    return Packing(best, fewest, bound)


def places(plan: list[tuple[int, tuple[int, ...]]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, from_rank, to_rank, uses, first_sequence, offset): at most 63 rows per decision.

    Ranks count the pieces of a length from 0. Rank r of a row goes to copy
    (r - from) mod uses, slot (r - from) div uses, at offset + slot * length.
    """
    rows, used, first = [], {}, 0
    for uses, filling in plan:
        offset = 0
        for x in sorted(set(filling), reverse=True):
            slots = filling.count(x)
            start = used.get(x, 0)
            used[x] = start + slots * uses
            rows.append((x, start, used[x], uses, first, offset))
            offset += slots * x
        first += uses
    return rows


def packed(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to stored pieces (doc_id, piece, length, ids_crc32, salt, ...); ``salt`` goes."""
    spark = pieces.sparkSession
    # One row per length: no more than the capacity, whatever the input.
    counts = {row["length"]: row["n"] for row in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows = places(complete(counts, capacity).plan)
    schema = "length bigint, from_rank bigint, to_rank bigint, uses bigint, first_sequence bigint, first_offset bigint"
    plan = spark.createDataFrame(rows, schema)
    sliced = pieces.withColumn("_slice", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "salt"), F.lit(SLICES)).cast("int"))
    ranked = positions(sliced, ["length"], ["_slice"], ["doc_id", "piece", "ids_crc32"], "_rank")
    ranked = ranked.withColumn("_rank", F.col("_rank") - 1).withColumnRenamed("length", "_length")
    inside = (F.col("_length") == F.col("length")) & (F.col("_rank") >= F.col("from_rank")) & (F.col("_rank") < F.col("to_rank"))
    placed = ranked.join(plan, inside)
    along = F.col("_rank") - F.col("from_rank")
    return placed.select(
        *[c for c in pieces.columns if c != "salt"],
        (F.col("first_sequence") + along % F.col("uses")).alias("sequence_id"),
        (F.col("first_offset") + F.expr("(_rank - from_rank) div uses") * F.col("length")).alias("offset"),
    )


def pack(
    df: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Only documents longer than a sequence are cut, into full pieces behind a
    first that may be shorter. A null text is empty and has one token. Rows
    that repeat an id are packed each; other columns are dropped.
    """
    return packed(stored(tokenized(df, tokenizer_path, capacity, id_column, text_column), "pieces"), capacity)
