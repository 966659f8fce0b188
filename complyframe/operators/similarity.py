"""Nearest clauses by cosine, exactly, within blocks of any size."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from complyframe.operators.joins import salted_join

TILE = 4096
#: Scores that a task holds at once.
SCORES = 1 << 20
#: Scores are rounded to so many digits before they are compared.
DIGITS = 6


def _tile_counts(df: DataFrame, block: str, tile: int, name: str) -> DataFrame:
    """How many tiles of about ``tile`` rows each block is cut into."""
    return df.groupBy(block).agg(F.ceil(F.count(F.lit(1)) / F.lit(tile)).cast("int").alias(name))


def _nearest_rows(x: np.ndarray, y: np.ndarray, own: np.ndarray, ids: np.ndarray, k: int):
    """Per row of ``x`` its k best rows of ``y`` with another id: row number, neighbour's id, rounded score; ties to the lower id.

    Only scores that may round to the k-th best or better are rounded and
    sorted; they are found without sorting the rest.
    """
    # Ids may repeat among the candidates, and the row's own do not count.
    wanted = min(k + int(np.unique(ids, return_counts=True)[1].max()), len(ids))
    step = max(1, SCORES // len(ids))
    for start in range(0, len(x), step):
        scores = x[start : start + step] @ y.T
        known = np.where(np.isnan(scores), -np.inf, scores)
        least = np.partition(known, len(ids) - wanted, axis=1)[:, len(ids) - wanted]
        row, column = np.nonzero(known >= (least - 2 * 10.0**-DIGITS)[:, None])
        other = ids[column] != own[start + row]
        row, column = row[other], column[other]
        score, neighbour = np.round(scores[row, column], DIGITS), ids[column]
        order = np.lexsort((neighbour, -score, row))
        row, neighbour, score = row[order], neighbour[order], score[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        best = place < k
        yield start + row[best], neighbour[best], score[best]


def most_similar(
    queries: DataFrame, candidates: DataFrame, block: str, key: str, vector: str, k: int, tile: int = TILE
) -> DataFrame:
    """The k most similar candidates of each query within its block; itself excluded.

    A block is cut into tiles on both sides; each pair of tiles is one matrix
    product that gives out k rows per query and no more. Work is split evenly
    however large one block is, and no candidate is left out.
    """
    counts = _tile_counts(queries, block, tile, "_q_tiles").join(
        _tile_counts(candidates, block, tile, "_c_tiles"), block
    )
    own_tile = lambda n: F.pmod(F.xxhash64(key), F.col(n).cast("bigint")).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    fields = [block, key, vector]
    left = salted_join(queries.select(*fields), counts, [block], [key])
    left = left.withColumn("_q", own_tile("_q_tiles")).withColumn("_c", every("_c_tiles"))
    right = salted_join(candidates.select(*fields), counts, [block], [key])
    right = right.withColumn("_c", own_tile("_c_tiles")).withColumn("_q", every("_q_tiles"))
    # New column identities, so that a frame can be compared with itself.
    columns = [block, key, vector, "_q", "_c"]
    left = left.select(*columns)
    right = right.select(*[F.col(c).alias(f"{c}_") for c in columns]).toDF(*columns)
    key_type, block_type = dict(queries.dtypes)[key], dict(queries.dtypes)[block]
    schema = f"{block} {block_type}, {key} {key_type}, neighbour {key_type}, score double"

    def nearest(names, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        columns = [block, key, "neighbour", "score"]
        if a.empty or b.empty:
            return pd.DataFrame(columns=columns)
        x, y = (np.stack(f[vector].to_numpy()).astype("float64") for f in (a, b))
        x, y = (m / np.where(n == 0, 1.0, n) for m in (x, y) for n in [np.linalg.norm(m, axis=1, keepdims=True)])
        own, ids = a[key].to_numpy(), b[key].to_numpy()
        parts = [
            pd.DataFrame({key: own[row], "neighbour": neighbour, "score": score})
            for row, neighbour, score in _nearest_rows(x, y, own, ids, k)
        ]
        found = pd.concat(parts, ignore_index=True)
        found.insert(0, block, names[0])
        return found[columns]

    on = [block, "_q", "_c"]
    tiles = left.groupBy(*on).cogroup(right.groupBy(*on)).applyInPandas(nearest, schema)
    window = Window.partitionBy(block, key).orderBy(F.desc("score"), F.asc("neighbour"))
    return tiles.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)
