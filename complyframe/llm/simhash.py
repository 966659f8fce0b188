"""SimHash fingerprints and their components at a small Hamming distance, by the generalised pigeonhole."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from complyframe.llm.components import components
from complyframe.llm.shared import stored

BITS, DISTANCE, SHINGLE, SEED = 64, 3, 3, 42
#: Relative cost of a probe row (made, shuffled, sorted) and of a candidate pair (two words compared in the join).
PROBE_COST, PAIR_COST = 1.0, 0.05
_BLOCK = 1 << 15


def fingerprint(text: bytes) -> int:
    """Majority of the bits of XXH64 over 3-word shingles, repeats included; 0 without words."""
    import xxhash

    words = text.lower().split()
    if not words:
        return 0
    width = min(SHINGLE, len(words))
    digest = xxhash.xxh64_intdigest
    ones, n = np.zeros(BITS, np.int64), len(words) - width + 1
    for first in range(0, n, _BLOCK):
        part = words[first : first + _BLOCK + width - 1]
        hashes = [digest(b" ".join(group), SEED) for group in zip(*[part[k:] for k in range(width)], strict=False)]
        octets = np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: doc_id and ``fp``, the fingerprint as a signed long. A null text counts as empty."""
    source = df.select(F.col(id_column).alias("doc_id"), F.coalesce(text_column, F.lit("")).cast("binary").alias("text"))
    schema = f"doc_id {source.schema['doc_id'].dataType.simpleString()}, fp bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.array([fingerprint(text.as_py()) for text in batch.column("text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(own, pa.int64())], ["doc_id", "fp"])

    return source.mapInArrow(run, schema)


def bit_counts(fps: DataFrame) -> np.ndarray:
    """How many of the fingerprints have bits i and j both set, for all i and j."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BITS, BITS), np.int64)
        for batch in batches:
            octets = batch.column("fp").to_numpy().view(np.uint8).reshape(-1, 8)
            bits = np.unpackbits(octets, axis=1, bitorder="little").astype(np.float32)
            total += (bits.T @ bits).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BITS * BITS)), pa.array(total.ravel())], ["cell", "n"])

    # 4,096 rows whatever the input.
    cells = fps.select("fp").mapInArrow(run, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(BITS * BITS, np.int64)
    for cell, n in cells:
        counts[cell] = n
    return counts.reshape(BITS, BITS)


def grouped_bits(both: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """Bits in ``parts`` groups of near equal size, correlated ones together."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    tied = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(tied, 0)
    left, groups = list(range(BITS)), []
    for k in range(parts):
        size = (BITS - sum(map(len, groups))) // (parts - k)
        seed = max(left, key=lambda b: (tied[b, left].sum(), -b))
        group = [seed]
        left.remove(seed)
        while len(group) < size:
            nearest = max(left, key=lambda b: (tied[b, group].sum(), -b))
            group.append(nearest)
            left.remove(nearest)
        groups.append(sorted(group))
    return groups


def within(chances: Sequence[float], most: int) -> list[float]:
    """Chance of at most 0, 1, ... ``most`` differences, when bit i differs with chance i on its own."""
    ways = np.zeros(most + 1)
    ways[0] = 1
    for q in chances:
        ways[1:] = ways[1:] * (1 - q) + ways[:-1] * q
        ways[0] *= 1 - q
    return list(np.cumsum(ways))


def allocate(costs: Sequence[Sequence[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds from -1 up, one per part, that add up to ``total`` at the least cost.

    ``costs[i][e + 1]`` is the cost of threshold e in part i. Dynamic
    programming over the parts and the sum so far.
    """
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for own in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for so_far, (cost, chosen) in best.items():
            for k, extra in enumerate(own):
                key, now = so_far + k - 1, (cost + extra, [*chosen, k - 1])
                if key not in step or now < step[key]:
                    step[key] = now
        best = step
    return best[total]


def plan(fps: DataFrame, distance: int = DISTANCE, parts: Sequence[int] = (2, 3, 4)) -> list[tuple[list[int], int]]:
    """(bits, threshold) per part: the number of parts and the thresholds of the least estimated cost.

    With m parts whose thresholds add up to distance - m + 1, any two
    fingerprints within the distance are within the threshold in some part; a
    part with -1 is not used. Pairs equal in a part are counted exactly, over
    all fingerprints; wider thresholds are scaled up by how often each bit
    differs.
    """
    both = bit_counts(fps)
    n = fps.count()
    p = np.diag(both) / max(n, 1)
    options = {m: grouped_bits(both, n, m) for m in parts}
    keys = [
        F.struct(F.lit(m).alias("m"), F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(mask(bits))).alias("v"))
        for m, groups in options.items()
        for i, bits in enumerate(groups)
    ]
    sizes = fps.select(F.explode(F.array(*keys)).alias("k")).groupBy("k.m", "k.i", "k.v").agg(F.count(F.lit(1)).alias("c"))
    equal = {(m, i): float(c) for m, i, c in sizes.groupBy("m", "i").agg(F.sum(F.expr("c * (c - 1) / 2D"))).collect()}
    found = []
    for m, groups in options.items():
        costs = []
        for i, bits in enumerate(groups):
            reach = within([2 * p[b] * (1 - p[b]) for b in bits], distance)
            own = [0.0]
            for e in range(distance + 1):
                probes = sum(comb(len(bits), k) for k in range(e + 1)) * n
                pairs = (equal.get((m, i), 0.0) + 1) * reach[e] / max(reach[0], 1e-12)
                own.append(PROBE_COST * probes + PAIR_COST * min(pairs, n * n / 2))
            costs.append(own)
        cost, thresholds = allocate(costs, distance - m + 1)
        found.append((cost, m, list(zip(groups, thresholds, strict=True))))
    return min(found)[2]


def mask(bits: Sequence[int]) -> int:
    """A signed long with these bits set."""
    return int(np.array([sum(1 << b for b in bits)], np.uint64).view(np.int64)[0])


def _flipped(part: int, value: Column):
    return lambda flip: F.struct(F.lit(part).alias("i"), value.bitwiseXOR(flip).alias("v"))


def links(fps: DataFrame, parts: Sequence[tuple[Sequence[int], int]], distance: int = DISTANCE) -> DataFrame:
    """(a, b) of distinct fingerprints within the distance, a < b as signed longs; a pair may come up once per part.

    Every fingerprint is filed under its value in each part and looks up the
    values within the part's threshold of its own. Candidates are verified in
    the join itself, so only links leave it; Spark can split a crowded value.
    """
    filed, probes = [], []
    for i, (bits, threshold) in enumerate(parts):
        if threshold < 0:
            continue
        value = F.col("fp").bitwiseAND(F.lit(mask(bits)))
        filed.append(F.struct(F.lit(i).alias("i"), value.alias("v")))
        flips = [F.lit(mask(flip)) for e in range(threshold + 1) for flip in combinations(bits, e)]
        near = F.transform(F.array(*flips), _flipped(i, value))
        probes.append(near)
    left = fps.select(F.col("fp").alias("a"), F.explode(F.concat(*probes)).alias("k")).select("a", "k.i", "k.v")
    right = fps.select(F.col("fp").alias("b"), F.explode(F.array(*filed)).alias("k")).select("b", F.col("k.i").alias("i2"), F.col("k.v").alias("v2"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance
    same = (F.col("i") == F.col("i2")) & (F.col("v") == F.col("v2")) & (F.col("a") < F.col("b")) & near
    return left.join(right, same).select("a", "b")


def near_duplicates(
    df: DataFrame, distance: int = DISTANCE, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Per row: doc_id, fingerprint (16 hex digits), component_id: the smallest id reachable over links.

    Equal fingerprints count as one, so copies make no pairs. A null text is
    empty; documents without words share the fingerprint zero and link like any
    other. A row with a null id gets the component of its fingerprint, null if
    no row there has an id. Rows come out as often as they came in; other
    columns are dropped.
    """
    own = stored(fingerprints(df, id_column, text_column), "fingerprints")
    distinct = stored(own.groupBy("fp").agg(F.min("doc_id").alias("rep")), "distinct")
    found = links(distinct.select("fp"), plan(distinct.select("fp"), distance), distance)
    groups = components(found, "a", "b")
    members = distinct.join(groups, distinct["fp"] == groups["node"], "left").select("fp", "rep", F.coalesce("component", "fp").alias("g"))
    members = stored(members, "members")
    smallest = members.groupBy("g").agg(F.min("rep").alias("component_id"))
    classes = members.select("fp", "g").join(smallest, "g").select("fp", "component_id")
    return own.join(classes, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
