"""Ranked lexical search by scanning documents with an automaton of all terms of the items; no document index.

Texts are reduced to terms with one space on either side, and so are the
patterns, which makes every match a whole term. The automaton's outputs are
term numbers, and these map to the items that hold them.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from complyframe.llm.pieces import chunks

TOP = 20
#: Bytes of item texts that one automaton is built from; more items are searched in further scans.
BLOCK_BYTES = 4 << 20
SALTS = 64
#: Scores are summed in doubles, exact up to here.
EXACT = 1 << 53
#: A-Z to a-z; a-z, 0-9 and all bytes from 0x80 as they are; everything else to a space.
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or 48 <= b <= 57 or b >= 128 else 32 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    """The terms of a text in UTF-8: runs of digits, letters of ASCII (A-Z lower-cased) and all other characters."""
    return text.translate(_TERMS).split()


class Scanner:
    """Counts of a fixed set of terms in texts, straight from the text."""

    def __init__(self, patterns: tuple[bytes, ...]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for number, term in enumerate(patterns):
            self.automaton.add_word(f" {term.decode('latin-1')} ", number)
        if patterns:
            self.automaton.make_automaton()

    @staticmethod
    @lru_cache(maxsize=2)
    def load(patterns: tuple[bytes, ...]) -> Scanner:
        return Scanner(patterns)

    def scan(self, text: bytes) -> tuple[int, Counter]:
        """(terms in the text, occurrences by term number)."""
        words = text.translate(_TERMS).split()
        if not words or not len(self.automaton):
            return len(words), Counter()
        guarded = f" {b' '.join(words).decode('latin-1')} "
        return len(words), Counter(map(itemgetter(1), self.automaton.iter(guarded)))


class Items:
    """The terms of a block of items, and which items hold a term how often."""

    def __init__(self, texts: list[bytes]):
        counts = [Counter(terms(text)) for text in texts]
        self.patterns = tuple(sorted({term for own in counts for term in own}))
        number = {term: k for k, term in enumerate(self.patterns)}
        found = sorted((number[term], item, n) for item, own in enumerate(counts) for term, n in own.items())
        held = np.array(found, np.int64).reshape(-1, 3)
        self.first = np.searchsorted(held[:, 0], np.arange(len(self.patterns) + 1))
        self.item, self.times = held[:, 1], held[:, 2]
        self.most_terms = max((sum(own.values()) for own in counts), default=0)


def statistics(texts: DataFrame, patterns) -> tuple[int, int, np.ndarray]:
    """(documents with a term, terms in all, documents that hold each of the patterns); one row per pattern is collected."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner.load(patterns.value)
        holding, total, held = 0, 0, np.zeros(len(patterns.value), np.int64)
        for batch in batches:
            for text in batch.column("text"):
                n, found = scanner.scan(text.as_py())
                holding += n > 0
                total += n
                if found:
                    held[list(found)] += 1
        some = np.flatnonzero(held)
        numbers = np.concatenate([[-1, -2], some])
        yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array(np.concatenate([[holding, total], held[some]]), pa.int64())], ["term", "n"])

    merged = dict(map(tuple, texts.select("text").mapInArrow(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n")).collect()))
    held = np.zeros(len(patterns.value), np.int64)
    for term, n in merged.items():
        if term >= 0:
            held[term] = n
    return merged.get(-1, 0), merged.get(-2, 0), held


def weights(holding: int, held: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * holding + 2) / (2 * int(n) + 1))) for n in held], np.int64)


class Best:
    """The best documents of each item so far, equal scores by the order of documents."""

    def __init__(self, top: int):
        self.top = top
        self.rows = np.zeros((0, 3), np.int64)
        self.least: np.ndarray | None = None

    def add(self, item: np.ndarray, score: np.ndarray, order: np.ndarray, items: int) -> None:
        if self.least is None:
            self.least = np.zeros(items, np.int64)
        fit = score >= np.maximum(self.least[item], 1)
        rows = np.concatenate([self.rows, np.stack([item[fit], score[fit], order[fit]], 1)])
        rows = rows[np.lexsort((rows[:, 2], -rows[:, 1], rows[:, 0]))]
        start = np.searchsorted(rows[:, 0], rows[:, 0])
        self.rows = rows[np.arange(len(rows)) - start < self.top]
        full = np.flatnonzero(np.bincount(self.rows[:, 0], minlength=items) == self.top)
        last = np.searchsorted(self.rows[:, 0], full, "right") - 1
        self.least[full] = self.rows[last, 1]


def scored(found: list[tuple[int, Counter]], items: Items, weight: np.ndarray, holding: int, total: int, count: int):
    """(document, item, score) arrays of a chunk of scanned documents."""
    documents, numbers, values = [], [], []
    for k, (n, occurrences) in enumerate(found):
        if not occurrences:
            continue
        length = 100 - 25 + (25 * n * holding) // total
        number = np.fromiter(occurrences.keys(), np.int64, len(occurrences))
        tf = np.fromiter(occurrences.values(), np.int64, len(occurrences))
        numbers.append(number)
        values.append(weight[number] * ((1_000_000_000 * tf) // (1000 * tf + 12 * length)))
        documents.append(np.full(len(number), k))
    if not documents:
        return (np.zeros(0, np.int64),) * 3
    document, number, value = map(np.concatenate, (documents, numbers, values))
    holders = items.first[number + 1] - items.first[number]
    at = np.repeat(items.first[number] - np.cumsum(holders) + holders, holders) + np.arange(holders.sum())
    cell = np.repeat(document, holders) * count + items.item[at]
    terms_of = np.repeat(value, holders) * items.times[at]
    cells, place = np.unique(cell, return_inverse=True)
    if int(weight.max(initial=0)) * 1_000_000 * items.most_terms < EXACT:
        sums = np.bincount(place, terms_of, len(cells)).astype(np.int64)
    else:
        sums = np.zeros(len(cells), np.int64)
        np.add.at(sums, place, terms_of)
    return cells // count, cells % count, sums


def _block(docs: DataFrame, rows: list, item_type: str, top: int) -> DataFrame:
    """Candidates (item_id, doc_id, score) of one block of items: the best of every task."""
    spark = docs.sparkSession.sparkContext
    names, items = [r[0] for r in rows], Items([r[1] for r in rows])
    patterns = spark.broadcast(items.patterns)
    holding, total, held = statistics(docs, patterns)
    shared = spark.broadcast((names, items, weights(holding, held)))
    doc_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, items, weight = shared.value
        scanner = Scanner.load(patterns.value)
        best, kept = Best(top), None
        for batch in batches:
            # Documents in the order of their ids, without an id last: ties are then broken by place.
            texts = batch.column("text").to_pylist()
            for first, last in chunks(texts):
                found = [scanner.scan(text) for text in texts[first:last]]
                document, item, score = scored(found, items, weight, holding, total, len(names))
                ids = batch.column("doc_id")[first:last]
                kept = ids if kept is None else pa.concat_arrays([kept, ids])
                document = document + len(kept) - len(ids)
                by = pc.sort_indices(kept, null_placement="at_end").to_numpy()
                # Rank among all kept documents; rows already there move with it.
                rank = np.empty(len(kept), np.int64)
                rank[by] = np.arange(len(kept))
                if len(best.rows):
                    best.rows[:, 2] = rank[best.rows[:, 2]]
                best.add(item, score, rank[document], len(names))
                wanted, best.rows[:, 2] = np.unique(best.rows[:, 2], return_inverse=True)
                kept = kept.take(pa.array(by[wanted]))
        if kept is not None:
            at = best.rows
            yield pa.RecordBatch.from_arrays(
                [pa.array(at[:, 0], pa.int64()), kept.take(pa.array(at[:, 2])), pa.array(at[:, 1], pa.int64())], ["_item", "doc_id", "score"]
            )

    found = docs.mapInArrow(run, f"_item bigint, doc_id {doc_type}, score bigint")
    own = docs.sparkSession.createDataFrame(list(enumerate(names)), f"_item bigint, item_id {item_type}")
    salted = found.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    within = Window.partitionBy("_item", "_salt").orderBy(*order)
    over = Window.partitionBy("_item").orderBy(*order)
    salted = salted.withColumn("_r", F.row_number().over(within)).where(F.col("_r") <= top)
    ranked = salted.withColumn("rank", F.row_number().over(over)).where(F.col("rank") <= top)
    return ranked.join(own, "_item").select("item_id", "rank", "doc_id", "score")


def search(
    df: DataFrame, items: DataFrame, top: int = TOP, id_column: str = "doc_id", text_column: str = "text", item_id: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """Per item its ``top`` documents of the highest score above 0: item_id, rank, doc_id, score.

    A null text has no terms; an item or document without any is in no row.
    Rows that repeat an id, or have none, are documents and items of their own;
    equal scores go by ascending doc_id, rows without an id last. Items are
    searched in blocks of about BLOCK_BYTES of text, one pair of scans each, so
    no more than a block is ever on the driver; other columns are dropped.
    """
    docs = df.select(F.col(id_column).alias("doc_id"), F.coalesce(text_column, F.lit("")).cast("binary").alias("text"))
    wanted = items.select(F.col(item_id).alias("item_id"), F.coalesce(item_text, F.lit("")).cast("binary").alias("text"))
    size = wanted.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-size // BLOCK_BYTES) or 1
    kind = wanted.schema["item_id"].dataType.simpleString()
    result = None
    for block in range(blocks):
        rows = wanted.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()
        found = _block(docs, [(r[0], bytes(r[1])) for r in rows], kind, top)
        result = found if result is None else result.unionByName(found)
    return result


#: The same in SQL, for the tables ``documents`` and ``benchmark``.
SEARCH_SQL = r"""
WITH doc AS (
  SELECT row_number() OVER () AS place, doc_id,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words
  FROM documents
),
item AS (
  SELECT row_number() OVER () AS item, item_id,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words
  FROM benchmark
),
term AS (SELECT item, term, count(*) AS times FROM (SELECT item, unnest(words) AS term FROM item) GROUP BY ALL),
size AS (SELECT count(*) AS docs, sum(len(words)) AS total FROM doc WHERE len(words) > 0),
tf AS (SELECT place, term, count(*) AS tf FROM (SELECT place, unnest(words) AS term FROM doc) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * max(docs) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, size GROUP BY term),
value AS (
  SELECT tf.place, tf.term, w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 12 * CAST(100 - 25 + (25 * len(doc.words) * size.docs) // size.total AS BIGINT))) AS v
  FROM tf JOIN w USING (term) JOIN doc USING (place), size
),
score AS (SELECT item, place, CAST(sum(times * v) AS BIGINT) AS score FROM term JOIN value USING (term) GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM score JOIN doc USING (place) JOIN item USING (item) WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) <= 20"""
