"""The corpus pipeline against plain stages, on rows that repeat, lack or share ids."""

import random
import re
from collections import Counter

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from complyframe.llm import rules, simhash

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, _row string, _sha string, _kept string"


def prose(rng, n):
    return " ".join(rng.choice("river stone bread winter garden letter window morning").title() + str(rng.randrange(400)) for _ in range(n))


def near(rng, text):
    words = text.split()
    words[rng.randrange(len(words))] = "changed"
    return " ".join(words)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    base = [prose(rng, rng.randrange(30, 300)) for _ in range(60)]
    texts = [*enumerate(base), *[(100 + k, t) for k, t in enumerate(base[:10])], *[(200 + k, near(rng, t)) for k, t in enumerate(base[10:20])]]
    texts += [(300, "a  b"), (301, None), (302, ""), (303, "same words " * 50), (304, base[20].replace(" ", "\n")), (305, prose(rng, 5000))]
    # One good and one bad text without an id, and of one id; a row twice.
    texts += [(None, "x y"), (None, prose(rng, 80)), (400, "x y"), (400, prose(rng, 80)), (401, base[30]), (401, base[30]), (401, prose(rng, 50))]
    rng.shuffle(texts)
    return [(i, t, "en", "web", 1, f"r{k}", "s", None) for k, (i, t) in enumerate(texts)]


def order(row):
    import hashlib

    return (row[0] is None, row[0] or 0, hashlib.sha256((row[1] or "").encode()).hexdigest())


def same(df, rows):
    """Rows in all columns; of rows equal in id and text any may stand for the other."""
    bare = lambda r: (r[0], r[1], r[2], r[3], r[4], r[6], r[7])
    return Counter(bare(tuple(r)) for r in df.collect()) == Counter(map(bare, rows))


def test_stages(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    # Rules: the verdict of each row by a number of its own.
    numbered = spark.createDataFrame([(k, *r[1:5]) for k, r in enumerate(rows)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = {r.doc_id for r in rules.judge(numbered).collect() if r.kept}
    good = [r for k, r in enumerate(rows) if k in kept]
    assert 0 < len(good) < len(rows) and sum(r[0] is None for r in good) == 1 and sum(r[0] == 400 for r in good) == 1
    first = corpus_pipeline.quality_rules(spark, docs, "")
    assert first.columns == docs.columns and same(first, good)
    # Exact: by normalised text, the smallest id; one of equal rows.
    groups = {}
    for r in good:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or ""), []).append(r)
    different = [min(g, key=order) for g in groups.values()]
    second = corpus_pipeline.exact_dedup(spark, spark.createDataFrame(good, SCHEMA), "")
    assert second.columns == docs.columns and same(second, different) and len(different) < len(good)
    # Near: components by all pairs of fingerprints.
    prints = [simhash.fingerprint((r[1] or "").encode()) for r in different]
    root = list(range(len(prints)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                root[find(a)] = find(b)
    parts = {}
    for k, r in enumerate(different):
        parts.setdefault(find(k), []).append(r)
    apart = [min(g, key=order) for g in parts.values()]
    third = corpus_pipeline.simhash_dedup(spark, spark.createDataFrame(different, SCHEMA), "")
    assert third.columns == docs.columns and same(third, apart) and len(apart) < len(different)
    # Packing: all that is left, each document from its first token on.
    packed = corpus_pipeline.best_fit_packing(spark, spark.createDataFrame(apart, SCHEMA), "").collect()
    assert Counter(r.doc_id for r in packed if r.start == 0) == Counter(r[0] for r in apart)


def test_run_is_its_stages(spark, rows, tmp_path):
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, str(tmp_path)), "plain")
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    got = Counter(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).select(*columns).collect()))
    assert got == Counter(map(tuple, docs.select(*columns).collect())) and got


def test_nothing_in_nothing_out(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_extra_columns_stay(spark):
    df = spark.createDataFrame([(1, prose(random.Random(1), 60))], "doc_id bigint, text string").withColumns(
        {c: F.lit("mine") for c in ("lang", "source", "_row", "_row_", "_sha", "_kept", "fp", "copy")}
    )
    for stage in (corpus_pipeline.exact_dedup, corpus_pipeline.simhash_dedup):
        got = stage(spark, df, "")
        assert got.columns == df.columns and {got.first()[c] for c in ("_row", "_row_", "_sha", "_kept", "fp", "copy")} == {"mine"}
