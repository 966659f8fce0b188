"""Documents linked by the Jaccard similarity of their word shingles: an exact prefix join with set-relation skipping.

Every different set files the rarest of its shingles in index lists. A list is
cut into blocks by set size and position, and pairs of blocks that cannot hold
a link are skipped whole. In what is left each list has a leader: all members
are compared with it once, and its answers carry over to them. Members that
both link with the leader need no comparison of their own; the others are
compared by what each has beyond, and lacks of, the leader's set.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from complyframe.llm.components import components
from complyframe.llm.shared import stored
from complyframe.operators.joins import salted_join

WIDTH, PERCENT = 4, 85
#: Shingles in at least this many sets go to the end of the order, the KEPT most frequent of them; others keep hash order.
FREQUENT, KEPT = 16, 1 << 18
#: Members of a leader are compared in tiles of about this many sets or tokens.
TILE, TILE_TOKENS = 512, 1 << 20
#: Bytes of text hashed at once, tokens counted at once, columns of a product of tiles.
SPAN, FLUSH, COLUMNS = 1 << 18, 1 << 22, 1 << 13
#: Rows of a few numbers that may go to every executor: some 64 MB there.
BROADCAST = 2_000_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Which bytes are white space, and a fixed random number per byte, A-Z as a-z."""
    space, value = np.zeros(256, bool), np.random.default_rng(1).integers(1, 1 << 63, 256, np.uint64)
    space[[32, *range(9, 14)]] = True
    value[65:91] = value[97:123]
    return space, value


_SPACE, _VALUE = _tables()
_BASE = 0x9E3779B97F4A7C55
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    """Powers of an odd number, and of its inverse, modulo 2**64."""
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(max(n, 1 << 16), base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.multiply.accumulate(steps)
    return _POWERS


def words(text: bytes) -> np.ndarray:
    """A 64-bit hash of every word: sums of its bytes' numbers times powers by place, without a loop over words."""
    octets = np.frombuffer(text, np.uint8)
    edges = np.flatnonzero(np.diff(_SPACE[octets], prepend=True, append=True))
    first, last = edges[::2], edges[1::2]
    found, k = [], 0
    while k < len(first):
        # A span of text at a time, at least one word.
        until = max(k + 1, int(np.searchsorted(last, first[k] + SPAN, "right")))
        start, end = first[k:until] - first[k], last[k:until] - first[k]
        up, down = _powers(int(end[-1]))
        sums = np.zeros(int(end[-1]) + 1, np.uint64)
        np.cumsum(_VALUE[octets[first[k] : last[until - 1]]] * up[: end[-1]], out=sums[1:])
        found.append((sums[end] - sums[start]) * down[start])
        k = until
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def shingles(text: bytes, width: int = WIDTH) -> np.ndarray:
    """The distinct shingles of a text as ascending 64-bit hashes; a shorter text is one shingle, one without words none."""
    hashes = words(text)
    if not len(hashes):
        return hashes
    wide = min(width, len(hashes))
    n = len(hashes) - wide + 1
    mixed = np.full(n, wide, np.uint64)
    for k in range(wide):
        mixed ^= hashes[k : k + n]
        mixed *= _MIX
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def _class(tokens: np.ndarray) -> int:
    import xxhash

    return int(np.uint64(xxhash.xxh3_64_intdigest(tokens.tobytes())).view(np.int64))


def _texts(df: DataFrame, id_column: str, text_column: str) -> DataFrame:
    return df.select(F.col(id_column).alias("doc_id"), F.coalesce(text_column, F.lit("")).cast("binary").alias("text"))


def small(df: DataFrame) -> DataFrame:
    """A written table, to be broadcast if it has no more than BROADCAST rows; else Spark joins as it sees fit."""
    return F.broadcast(df) if df.count() <= BROADCAST else df


def classes(texts: DataFrame, width: int = WIDTH) -> DataFrame:
    """Per row: doc_id, key (a hash of the text), n (size of the set), cls (its 64-bit hash; null without shingles)."""
    kind = texts.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(text.as_py(), width) for text in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("key"),
                    pa.array(map(len, sets), pa.int64()),
                    pa.array([_class(s) if len(s) else None for s in sets], pa.int64()),
                ],
                ["doc_id", "key", "n", "cls"],
            )

    return texts.withColumn("key", F.xxhash64("text")).mapInArrow(run, f"doc_id {kind}, key bigint, n bigint, cls bigint")


def _once(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[int, np.ndarray]]:
    """The different sets of a task, each behind its class."""
    seen: set[int] = set()
    for batch in batches:
        for text in batch.column("text"):
            tokens = shingles(text.as_py(), width)
            if len(tokens) and (own := _class(tokens)) not in seen:
                seen.add(own)
                yield own, tokens


def gaps(values: np.ndarray) -> bytes:
    """Ascending 32-bit numbers as 16-bit gaps; a gap of more than 65,534 takes several."""
    steps = np.diff(values, prepend=np.uint32(0)).astype(np.int64)
    many, rest = np.divmod(steps, 0xFFFF)
    out = np.full(int(many.sum()) + len(steps), 0xFFFF, np.uint16)
    out[np.cumsum(many + 1) - 1] = rest
    return out.tobytes()


def from_gaps(octets: bytes) -> np.ndarray:
    steps = np.frombuffer(octets, np.uint16)
    return np.cumsum(steps, dtype=np.int64)[steps != 0xFFFF]


def frequent(texts: DataFrame, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Upper halves of the hashes of the most frequent shingles, ascending, and their ranks by frequency, from 1.

    Counted over all rows by the upper 32 bits: shingles that share those count
    together, which can change the order of shingles but no result. At most
    KEPT rows reach the driver.
    """
    buckets = 1 << max(6, (max(texts.rdd.getNumPartitions(), 1) - 1).bit_length())
    shift = np.uint32(32 - buckets.bit_length() + 1)

    def dealt(tokens: list[np.ndarray]) -> pa.RecordBatch:
        upper = np.sort((np.concatenate(tokens) >> np.uint64(32)).astype(np.uint32))
        ends = np.searchsorted(upper >> shift, np.arange(buckets), "right")
        parts = np.split(upper, ends[:-1])
        return pa.RecordBatch.from_arrays(
            [pa.array(range(buckets), pa.int32()), pa.array(map(gaps, parts), pa.binary())], ["bucket", "upper"]
        )

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for _, tokens in _once(batches, width):
            held.append(tokens)
            n += len(tokens)
            if n >= FLUSH:
                yield dealt(held)
                held, n = [], 0
        if held:
            yield dealt(held)

    def count(table: pa.Table) -> pa.Table:
        upper = np.concatenate([from_gaps(x) for x in table.column("upper").to_pylist()])
        values, n = np.unique(upper, return_counts=True)
        many = n >= FREQUENT
        return pa.table({"upper": pa.array(values[many]), "n": pa.array(n[many].astype(np.int64))})

    counted = texts.mapInArrow(deal, "bucket int, upper binary").groupBy("bucket").applyInArrow(count, "upper bigint, n bigint")
    counted = stored(counted.withColumn("level", F.floor(F.log2("n") * 8).cast("int")), "frequent")
    # A few hundred levels, whatever the input; the lowest whose rows and all above fit.
    least, room = None, KEPT
    for level, rows in counted.groupBy("level").agg(F.count(F.lit(1))).orderBy(F.desc("level")).collect():
        room -= rows
        if room < 0:
            break
        least = level
    top = counted.where(F.col("level") >= least).select("upper", "n").toArrow() if least is not None else None
    if top is None:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    upper, n = (top.column(c).to_numpy() for c in ("upper", "n"))
    ranks = np.empty(len(upper), np.int64)
    ranks[np.lexsort((upper, n))] = np.arange(1, len(upper) + 1)
    upper = upper.astype(np.uint32)
    order = np.argsort(upper)
    return upper[order], ranks[order]


def prefix(tokens: np.ndarray, upper: np.ndarray, ranks: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The first n - ceil(percent * n) + 1 shingles in the common order: two sets that link share one of theirs."""
    size = len(tokens) - -(-percent * len(tokens) // 100) + 1
    if not len(upper):
        return tokens[:size]
    high = (tokens >> np.uint64(32)).astype(np.uint32)
    at = np.minimum(np.searchsorted(upper, high), len(upper) - 1)
    often = upper[at] == high
    rare = tokens[~often][:size]
    if len(rare) == size:
        return rare
    order = np.argsort(ranks[at[often]], kind="stable")
    return np.concatenate([rare, tokens[often][order[: size - len(rare)]]])


def postings(texts: DataFrame, order, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """token, cls, n, pos: the index lists, each set once per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        upper, ranks = order.value
        held: list[tuple[np.ndarray, int, int]] = []

        def filed() -> pa.RecordBatch:
            sizes = [len(p) for p, _, _ in held]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([p for p, _, _ in held]).view(np.int64)),
                    pa.array(np.repeat([c for _, c, _ in held], sizes), pa.int64()),
                    pa.array(np.repeat([n for _, _, n in held], sizes), pa.int64()),
                    pa.array(np.concatenate([np.arange(k) for k in sizes]), pa.int64()),
                ],
                ["token", "cls", "n", "pos"],
            )

        for own, tokens in _once(batches, width):
            held.append((prefix(tokens, upper, ranks, percent), own, len(tokens)))
            if len(held) >= 2048:
                yield filed()
                held = []
        if held:
            yield filed()

    return texts.mapInArrow(run, "token bigint, cls bigint, n bigint, pos bigint")


def lists(filed: DataFrame, percent: int = PERCENT) -> DataFrame:
    """token, band, cls, n: members of the lists that may hold a link, after skipping blocks by size and position.

    A list is cut by size into bands so wide that sets that link are in one
    band or in neighbours; a band's list also holds the band below. Its blocks
    are narrow ranges of sizes and positions. A pair's first common shingle at
    positions i and j leaves at most 1 + min(n - 1 - i, m - 1 - j) in common;
    where the block's extremes cannot reach what a link takes, the pair of
    blocks is skipped. There are a few dozen blocks in a list of any length.
    """
    ends = filed.groupBy("token").agg(F.min("cls").alias("low"), F.max("cls").alias("high"))
    repeated = small(stored(ends.where("low <> high").select("token"), "repeated"))
    step = math.log(100 / percent) * 1.001
    held = filed.join(repeated, "token", "left_semi").distinct()
    held = stored(held.withColumn("own", F.floor(F.log("n") / step).cast("bigint")), "postings")
    inside = held.withColumn("band", F.explode(F.array(F.col("own"), F.col("own") + 1)))
    inside = inside.withColumns(
        {
            "below": F.col("band") > F.col("own"),
            "sb": F.floor(F.log("n") * 32).cast("bigint"),
            "pb": F.floor(F.col("pos") * 400 / ((100 - percent) * F.col("n") + 100)).cast("bigint"),
        }
    )
    key = ["token", "band", "below", "sb", "pb"]
    blocks = inside.groupBy(*key).agg(
        F.count(F.lit(1)).alias("c"), F.min("n").alias("least"), F.max("n").alias("most"), F.min("pos").alias("first")
    )
    blocks = blocks.withColumn("b", F.struct(*key[2:]))
    x, y = blocks.alias("x"), blocks.where("NOT below").alias("y")
    paired = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.band") == F.col("y.band")))
    reach = F.least(F.expr("x.most - x.first"), F.expr("y.most - y.first"))
    alive = paired.where((F.col("x.b") != F.col("y.b")) | (F.col("x.c") > 1)).where(
        (F.col("x.most") * 100 >= F.col("y.least") * percent)
        & (F.col("y.most") * 100 >= F.col("x.least") * percent)
        & (reach * (100 + percent) >= F.expr("x.least + y.least") * percent)
    )
    both = F.explode(F.array("x.b", "y.b")).alias("b")
    kept = alive.select(F.col("x.token").alias("token"), F.col("x.band").alias("band"), both)
    kept = kept.select("token", "band", "b.*").distinct()
    return inside.join(kept, key, "left_semi").select("token", "band", "cls", "n")


def members(held: DataFrame) -> DataFrame:
    """cls, n, leader, leader_n, tiles, tile: who is compared with which leader, the smallest class of a list."""
    leaders = held.groupBy("token", "band").agg(F.min(F.struct("cls", "n")).alias("l"))
    led = held.join(leaders, ["token", "band"])
    led = led.select("cls", "n", F.col("l.cls").alias("leader"), F.col("l.n").alias("leader_n")).distinct()
    sizes = led.groupBy("leader").agg(F.greatest(F.count(F.lit(1)) / TILE, F.sum("n") / TILE_TOKENS).alias("tiles"))
    led = salted_join(led, sizes.withColumn("tiles", F.ceil("tiles").cast("int")), ["leader"], ["cls"])
    return led.withColumn("tile", F.pmod(F.xxhash64("cls"), F.col("tiles").cast("bigint")).cast("int"))


def packed(tokens: np.ndarray) -> bytes:
    """Ascending tokens by their upper 48 bits, six bytes each: what sets are compared by."""
    return tokens.view(np.uint64).astype("<u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()


def unpacked(octets: bytes) -> np.ndarray:
    held = np.zeros((len(octets) // 6, 8), np.uint8)
    held[:, 2:] = np.frombuffer(octets, np.uint8).reshape(-1, 6)
    return held.view("<u8").ravel()


def sets(texts: DataFrame, width: int = WIDTH) -> DataFrame:
    """cls and tokens of the different sets of each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def gathered() -> pa.RecordBatch:
            tokens = pa.array([packed(t) for _, t in held], pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([c for c, _ in held], pa.int64()), tokens], ["cls", "tokens"])

        for own in _once(batches, width):
            held.append(own)
            n += len(own[1])
            if n >= FLUSH:
                yield gathered()
                held, n = [], 0
        if held:
            yield gathered()

    return texts.mapInArrow(run, "cls bigint, tokens binary")


def answers(led: DataFrame, held: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Each other member beside its leader: common and linked, and the member as changes to the leader's set or, if shorter, whole.

    A leader's only other member is answered by that alone and left without its set.
    """
    rest = led.where("cls <> leader")
    led = rest.join(rest.groupBy("leader").agg(F.count(F.lit(1)).alias("members")), "leader")
    facts = held.join(small(stored(led, "led")), "cls")
    lookup = small(stored(led.select("leader", "tiles").distinct(), "leaders")).join(held.withColumnsRenamed({"cls": "leader", "tokens": "led"}), "leader")
    lookup = lookup.select("leader", F.explode(F.expr("sequence(0, tiles - 1)")).alias("tile"), "led")
    joined = facts.join(lookup, ["leader", "tile"])
    columns = ["cls", "n", "leader", "leader_n", "tiles", "tile", "members"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for own, led, n, m, members in zip(*[batch.column(c) for c in ("tokens", "led", "n", "leader_n", "members")], strict=True):
                a, b, n, m = unpacked(own.as_py()), unpacked(led.as_py()), n.as_py(), m.as_py()
                plus, minus = np.setdiff1d(a, b, True), np.setdiff1d(b, a, True)
                common = n - len(plus)
                relative = len(plus) + len(minus) < n
                linked = (100 + percent) * common >= percent * (n + m)
                kept = (plus, minus) if relative else (a, minus[:0])
                rows.append((common, linked, relative, *((None, None) if members.as_py() == 1 else map(packed, kept))))
            common, linked, relative, plus, minus = zip(*rows, strict=True) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(c) for c in columns],
                    pa.array(common, pa.int64()),
                    pa.array(linked, pa.bool_()),
                    pa.array(relative, pa.bool_()),
                    pa.array(plus, pa.binary()),
                    pa.array(minus, pa.binary()),
                ],
                [*columns, "common", "linked", "relative", "plus", "minus"],
            )

    schema = "cls bigint, n bigint, leader bigint, leader_n bigint, tiles int, tile int, members bigint, common bigint, linked boolean, relative boolean, plus binary, minus binary"
    return joined.select(*columns, "tokens", "led").mapInArrow(run, schema)


def _incidence(lists_: list[np.ndarray], wanted: np.ndarray) -> np.ndarray:
    """Rows by the columns ``wanted`` (ascending): 1 where a list holds the token."""
    out = np.zeros((len(lists_), len(wanted)), np.float32)
    for k, own in enumerate(lists_):
        at = np.searchsorted(wanted, own)
        at[at == len(wanted)] = 0
        out[k, at[wanted[at] == own]] = 1
    return out


def overlaps(n, m, common, relative, plus, minus) -> np.ndarray:
    """Sizes of the intersections of different sets given as changes to one leader's set of size m (relative) or whole.

    Two relative sets share what neither lacks of the leader, and what both
    have beyond it; a relative and a whole one share what the whole one shares
    with the leader, corrected by the changes. The diagonal is without meaning.
    """
    size = len(n)
    both, lacking, crossed = (np.zeros((size, size), np.float64) for _ in range(3))
    tokens, seen = np.unique(np.concatenate([*plus, *minus]), return_counts=True)
    shared = tokens[seen > 1]
    for start in range(0, len(shared), COLUMNS):
        part = shared[start : start + COLUMNS]
        p, q = _incidence(plus, part), _incidence(minus, part)
        both += p @ p.T
        lacking += q @ q.T
        crossed += q @ p.T
    lost = np.array([len(x) for x in minus])
    inner = m - lost[:, None] - lost[None, :] + lacking + both
    mixed = common[None, :] - crossed + both
    r = relative[:, None], relative[None, :]
    return np.where(r[0] & r[1], inner, np.where(r[0], mixed, np.where(r[1], mixed.T, both))).astype(np.int64)


def tile_links(table: pa.Table, percent: int = PERCENT) -> pa.Table:
    """(a, b) that join the sets of a pair of tiles as its links do: each set with the least of those it reaches."""
    n, common = (table.column(c).to_numpy().astype(np.int64) for c in ("n", "common"))
    linked, relative = (np.array(table.column(c).to_pylist(), bool) for c in ("linked", "relative"))
    plus, minus = ([unpacked(x.as_py()) for x in table.column(c)] for c in ("plus", "minus"))
    shared = overlaps(n, table.column("leader_n")[0].as_py(), common, relative, plus, minus)
    near = (100 + percent) * shared >= percent * (n[:, None] + n[None, :])
    # Both link with the leader: that is known already.
    near &= ~(linked[:, None] & linked[None, :])
    np.fill_diagonal(near, True)
    least = np.arange(len(n))
    while True:
        lower = np.where(near, least[None, :], len(n)).min(1)
        if (lower == least).all():
            break
        least = lower
    cls = table.column("cls").to_numpy()
    moved = least != np.arange(len(n))
    return pa.table({"a": pa.array(cls[moved], pa.int64()), "b": pa.array(cls[least[moved]], pa.int64())})


def others(answered: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Links between members of a leader that are not both linked with it, found in pairs of tiles."""
    several = answered.where("members > 1")
    open_ = several.groupBy("leader").agg(F.count_if(~F.col("linked")).alias("apart")).where("apart > 0").select("leader")
    held = several.join(small(stored(open_, "open")), "leader", "left_semi")
    partner = F.explode(F.expr("sequence(0, tiles - 1)")).alias("partner")
    dealt = held.select("leader", "tile", partner, "cls", "n", "leader_n", "common", "linked", "relative", "plus", "minus")
    dealt = dealt.select("*", F.least("tile", "partner").alias("x"), F.greatest("tile", "partner").alias("y"))
    return dealt.groupBy("leader", "x", "y").applyInArrow(lambda table: tile_links(table, percent), "a bigint, b bigint")


def near_sets(
    df: DataFrame, percent: int = PERCENT, width: int = WIDTH, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id: the smallest id reachable over links of at least ``percent`` Jaccard.

    Equal sets count as one, so copies make no pairs. A null text is empty; an
    empty set links with nothing, not even its like, and is its own component.
    A row with a null id gets the component of its set, null if no row there
    has an id. Rows come out as often as they came in; other columns are
    dropped. Shingles and sets are known by 64-bit hashes, of which sets that
    are compared carry 48 bits: of two sets of a thousand, one shingle too many
    is found in common with a chance of 4 in a billion.
    """
    spark = df.sparkSession
    texts = _texts(df, id_column, text_column)
    own = stored(classes(texts, width), "classes")
    order = spark.sparkContext.broadcast(frequent(texts, width))
    filed = stored(postings(texts, order, width, percent), "lists")
    led = stored(members(stored(lists(filed, percent), "alive")), "members")
    # One row stands for a class: the one with the least id, told from rows of the same id by its text.
    wanted = own.join(led.select("cls").distinct(), "cls", "left_semi")
    wanted = wanted.groupBy("cls").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("r")).select("r.doc_id", "r.key")
    renamed = small(stored(wanted.distinct().withColumnsRenamed({"doc_id": "_id", "key": "_key"}), "wanted"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_key"))
    chosen = texts.join(renamed, same, "left_semi")
    if chosen.count() > renamed.count():
        chosen = chosen.dropDuplicates(["doc_id", "text"])
    # Worked out for members and again for leaders: cheaper than to write and shuffle.
    answered = stored(answers(led, sets(chosen, width), percent), "answers")
    found = answered.where("linked").select(F.col("cls").alias("a"), F.col("leader").alias("b"))
    groups = components(found.unionByName(others(answered, percent)), "a", "b")
    firsts = own.where("cls IS NOT NULL").groupBy("cls").agg(F.min("doc_id").alias("first"))
    placed = firsts.join(groups, firsts["cls"] == groups["node"], "left").select("cls", "first", F.coalesce("component", "cls").alias("g"))
    placed = stored(placed, "placed")
    smallest = placed.groupBy("g").agg(F.min("first").alias("_component"))
    by_class = placed.join(smallest, "g").select("cls", "_component")
    return salted_join(own, by_class, ["cls"], ["doc_id"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("_component")).otherwise(F.col("doc_id")).alias("component_id")
    )
