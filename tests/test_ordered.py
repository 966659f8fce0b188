"""Sliced operators give what one window over the whole group gives."""

import random

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from complyframe.operators import similarity
from complyframe.operators.joins import salted_join
from complyframe.operators.ordered import neighbours, positions, quantiles
from complyframe.operators.similarity import most_similar


def _rows(spark):
    rng = random.Random(3)
    # Two thirds of the rows share one key.
    rows = [("hot" if rng.random() < 0.66 else f"k{rng.randrange(5)}", rng.randrange(40), i, rng.randrange(9)) for i in range(900)]
    return spark.createDataFrame(rows, "k STRING, day INT, id INT, v INT").withColumn("part", F.floor(F.col("id") / 50))


def test_neighbours_and_positions(spark):
    rows = _rows(spark)
    whole = Window.partitionBy("k").orderBy("day", "id")
    want = rows.select("id", F.lag("v").over(whole).alias("b"), F.lead("v").over(whole).alias("a"), F.row_number().over(whole).alias("p"))
    want = sorted(map(tuple, want.collect()))
    for levels, order in ((["day", "part"], ["id"]), (["day"], ["id"]), ([], ["day", "id"])):
        near = neighbours(rows, ["k"], levels, order, ["v"], "before", "after")
        got = positions(near, ["k"], levels, order).select("id", "before.v", F.col("after.v"), "position")
        assert sorted(map(tuple, got.collect())) == want


def test_exact_quantiles(spark):
    rows = _rows(spark).withColumn("x", F.col("id") * 7 % 5000)
    got = {(r["k"], r["percent"]): r["x"] for r in quantiles(rows, ["k"], "x", [50, 95], width=64).collect()}
    data = rows.select("k", "x").toPandas()
    for (k, p), x in got.items():
        values = sorted(data[data.k == k].x)
        assert x == values[-(-p * len(values) // 100) - 1]
    overall = quantiles(rows, [], "x", [95]).first()["x"]
    values = sorted(data.x)
    assert overall == values[-(-95 * len(values) // 100) - 1]


def test_salting_changes_nothing(spark):
    rows = _rows(spark)
    lookup = rows.groupBy("k").agg(F.max("v").alias("m")).where("k <> 'k1'")
    for how in ("inner", "left", "left_semi", "left_anti"):
        plain = sorted(map(str, rows.join(lookup, ["k"], how).collect()))
        assert sorted(map(str, salted_join(rows, lookup, ["k"], ["id"], how).collect())) == plain


def test_nearest_by_tiles_is_exact(spark):
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(120, 8)).astype("float32")
    rows = [(i, "hot" if i % 3 else "cold", [float(x) for x in vectors[i]]) for i in range(120)]
    df = spark.createDataFrame(rows, "id INT, block STRING, v ARRAY<FLOAT>")
    got = most_similar(df, df, "block", "id", "v", 4, tile=16).collect()
    found = {}
    for r in got:
        found.setdefault(r["id"], []).append((r["rank"], r["neighbour"]))
    unit = vectors.astype("float64") / np.linalg.norm(vectors.astype("float64"), axis=1, keepdims=True)
    for i, block, _ in rows:
        others = [j for j, b, _ in rows if b == block and j != i]
        best = sorted(others, key=lambda j: (-round(float(unit[i] @ unit[j]), 6), j))[:4]
        assert [n for _, n in sorted(found[i])] == best


def test_nearest_rows_are_found_without_sorting_all(monkeypatch):
    """Ties, repeated ids, rows without a direction and products cut into strips give what sorting every score gives."""
    monkeypatch.setattr(similarity, "SCORES", 500)
    sorted_rows, whole = [], np.lexsort
    monkeypatch.setattr(similarity.np, "lexsort", lambda keys: (sorted_rows.append(len(keys[0])), whole(keys))[1])
    rng = np.random.default_rng(7)
    for digits in (1, 9):
        x, y = (np.round(rng.normal(size=(n, 16)), digits) for n in (40, 200))
        y[100:] = y[:100]
        y[3] = np.nan
        x, y = (m / np.linalg.norm(m, axis=1, keepdims=True) for m in (x, y))
        ids = rng.integers(0, 150, 200)
        own = ids[rng.integers(0, 200, 40)]
        got = [list(zip(*map(np.ndarray.tolist, part))) for part in similarity._nearest_rows(x, y, own, ids, 3)]
        scores = np.round(x @ y.T, 6)
        best = []
        for i in range(40):
            order = whole((ids, -scores[i]))
            order = order[ids[order] != own[i]][:3]
            best += [(i, int(ids[j]), float(scores[i][j])) for j in order]
        assert [row for part in got for row in part] == best
    assert len(sorted_rows) > 2 and sum(sorted_rows) < 2 * 40 * 200 / 4


def test_rows_without_a_slice_come_last(spark):
    """Undated rows keep their place at the end of their group, and so do groups without a key."""
    from complyframe.operators.ordered import neighbours, positions

    rows = [("a", 2, 4), ("a", None, 1), ("a", 1, 3), ("a", None, 2), (None, 1, 5), (None, None, 6)]
    df = spark.createDataFrame(rows, "k string, day int, id int")
    placed = {r.id: r.position for r in positions(df, ["k"], ["day"], ["id"]).collect()}
    assert placed == {3: 1, 4: 2, 1: 3, 2: 4, 5: 1, 6: 2}
    linked = neighbours(df, ["k"], ["day"], ["id"], ["id"], "before", "after").collect()
    links = {r.id: (r.before and r.before.id, r.after and r.after.id) for r in linked}
    assert links == {3: (None, 4), 4: (3, 1), 1: (4, 2), 2: (1, None), 5: (None, 6), 6: (5, None)}
