"""Quality rules: counts per document, and robust multivariate outliers per language and source.

Documents that pass the base rule are vectors of four transformed statistics.
Per (language, source) the minimum-covariance-determinant estimate is found by
concentration steps from two deterministic starts, each step one pass over all
vectors. The same is done per language and for the corpus, and a group's
estimate leans on its language's, a language's on the corpus's, the more the
fewer rows it has. Vectors far off by Mahalanobis distance are rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from complyframe.llm.shared import stored
from complyframe.operators.joins import salted_join

WHITE, SYMBOLS = b" \t\n\x0b\x0c\r", b"#*$%&|<>"
#: Vectors hold thousandths, as integers, so that sums are exact in any order.
SCALE = 1000
#: Log of the mean word length, and arcsine square roots of symbols per word,
#: duplicate lines per line and repeated words per word.
STATISTICS = ("x0", "x1", "x2", "x3")
P = len(STATISTICS)
#: Deviation that a statistic may have anyhow, in its own unit; it keeps every
#: covariance regular, as most documents have no symbols or repeats at all.
TOLERANCE = (0.15, 0.05, 0.15, 0.12)
#: Rows at which a group's own centre counts as much as that of the level above.
PRIOR = 50
#: Squared distance beyond which a vector is an outlier: chance 1e-6 in four dimensions.
CUT = 33.38
#: Distances are counted in bins of this many per unit of log(1 + distance).
BINS = 64
MOST_STEPS = 12
_PAIRS = [(i, j) for i in range(P) for j in range(i, P)]
#: Level 0 is a (language, source), 1 a language, 2 the corpus; what a level lacks is empty.
KEYS = ["level", "lang", "source"]
_GROUP = ["start", *KEYS]


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a 5-word window found twice or more."""
    n = len(words)
    if n < 6:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, n)
    _, two = np.unique(ids[:-1] * len(known) + ids[1:], return_inverse=True)
    pairs = int(two.max()) + 1
    if pairs == n - 1:
        return 0
    _, four = np.unique(two[:-2] * pairs + two[2:], return_inverse=True)
    _, five, count = np.unique(four[:-1] * len(known) + ids[4:], return_inverse=True, return_counts=True)
    starts = np.flatnonzero(count[five] > 1)
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + 5, -1)
    return int((np.cumsum(cover)[:n] > 0).sum())


def counts(text: bytes) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lines with a word."""
    words = text.split()
    lines = [line for line in text.split(b"\n") if line.strip()]
    return (
        len(words),
        len(text.translate(None, WHITE).decode("utf-8", "replace")),
        len(text) - len(text.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
    )


def vector(n_words: int, word_chars: int, n_symbols: int, n_dup_lines: int, n_repeat_words: int, n_lines: int) -> list[int]:
    shares = (n_symbols / max(n_words, 1), n_dup_lines / max(n_lines, 1), n_repeat_words / max(n_words, 1))
    values = [np.log(max(word_chars, 1) / max(n_words, 1)), *[np.arcsin(np.sqrt(min(1.0, x))) for x in shares]]
    return [round(float(x) * SCALE) for x in values]


def measured(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: doc_id, lang, source, the counts, base_failed, and the vector in x0 to x3."""
    source = df.select(
        F.col(id_column).alias("doc_id"),
        F.coalesce(F.col("lang").cast("string"), F.lit("\\N")).alias("lang"),
        F.coalesce(F.col("source").cast("string"), F.lit("\\N")).alias("source"),
        F.coalesce(text_column, F.lit("")).cast("binary").alias("text"),
    )
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    schema = f"doc_id {source.schema['doc_id'].dataType.simpleString()}, lang string, source string, "
    schema += ", ".join(f"{c} bigint" for c in [*names, *STATISTICS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [counts(text.as_py()) for text in batch.column("text")]
            rows = np.array([[*x[:5], *vector(*x)] for x in found], np.int64).reshape(-1, 5 + P)
            kept = [batch.column(c) for c in ("doc_id", "lang", "source")]
            yield pa.RecordBatch.from_arrays(
                [*kept, *[pa.array(column) for column in rows.T]], ["doc_id", "lang", "source", *names, *STATISTICS]
            )

    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return source.mapInArrow(run, schema).withColumn("base_failed", failed)


def consistency(share: float) -> float:
    """Factor that makes the covariance of the nearest ``share`` of a four-dimensional normal sample right."""
    inside = lambda x: 1 - np.exp(-x / 2) * (1 + x / 2)
    low, high = 0.0, 200.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if inside(middle) < share else (low, middle)
    spread = 1 - np.exp(-high / 2) * (1 + high / 2 + high * high / 8)
    return share / max(spread, 1e-12)


def moments(sums: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Centre and covariance per group, from counts and sums of the chosen vectors."""
    n = sums["n"].to_numpy(float)
    centre = np.stack([sums[f"s{i}"].to_numpy(float) for i in range(P)], 1) / n[:, None] / SCALE
    cov = np.empty((len(n), P, P))
    for i, j in _PAIRS:
        cov[:, i, j] = cov[:, j, i] = sums[f"s{i}{j}"].to_numpy(float) / n / SCALE**2 - centre[:, i] * centre[:, j]
    return centre, cov


def metrics(frame: pd.DataFrame, columns: list[str], centre: np.ndarray, cov: np.ndarray) -> pd.DataFrame:
    """Centre (c*), metric (m*) and log determinant of the covariance with the tolerances on it."""
    cov = cov + np.diag(np.square(TOLERANCE))
    inverse = np.linalg.inv(cov)
    out = {c: frame[c] for c in columns}
    out |= {f"c{i}": centre[:, i] for i in range(P)}
    out |= {f"m{i}{j}": inverse[:, i, j] * (1 if i == j else 2) for i, j in _PAIRS}
    return pd.DataFrame(out | {"logdet": np.linalg.slogdet(cov)[1]})


def spreads(sums: pd.DataFrame) -> pd.DataFrame:
    """Centre (c*) and covariance (v*) per group, made right for a normal sample."""
    centre, cov = moments(sums)
    share = sums["n"].to_numpy(float) / sums["total"].to_numpy(float)
    cov *= np.array([consistency(min(x, 0.999)) for x in share])[:, None, None]
    out = {c: sums[c] for c in [*KEYS, "total"]} | {f"c{i}": centre[:, i] for i in range(P)}
    return pd.DataFrame(out | {f"v{i}{j}": cov[:, i, j] for i, j in _PAIRS})


def shrunk(total: np.ndarray, own: np.ndarray, above: np.ndarray, power: int) -> np.ndarray:
    """Between the estimates of a group and of the level above it, by the group's rows.

    A covariance (power 2) is trusted later than a centre (power 1): in a few
    rows, junk would widen it until nothing stands out.
    """
    weight = (total / (total + PRIOR)) ** power
    weight = weight.reshape(-1, *[1] * (own.ndim - 1))
    return weight * own + (1 - weight) * above


def _arrays(frame: pd.DataFrame, prefix: str = "") -> tuple[np.ndarray, np.ndarray]:
    centre = frame[[f"{prefix}c{i}" for i in range(P)]].to_numpy(float)
    cov = np.empty((len(frame), P, P))
    for i, j in _PAIRS:
        cov[:, i, j] = cov[:, j, i] = frame[f"{prefix}v{i}{j}"].to_numpy(float)
    return centre, cov


def leaning(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Centre and covariance of groups (c*, v*) leant on those above them (ac*, av*)."""
    total = frame["total"].to_numpy(float)
    (centre, cov), (above, above_cov) = _arrays(frame), _arrays(frame, "a")
    return shrunk(total, centre, above, 1), shrunk(total, cov, above_cov, 2)


_CENTRE, _COV, _METRIC = [f"c{i}" for i in range(P)], [f"v{i}{j}" for i, j in _PAIRS], [f"m{i}{j}" for i, j in _PAIRS]


def _schema(keys: str, columns: list[str]) -> str:
    return ", ".join([keys, *[f"{c} double" for c in columns]])


def _estimated(sums: DataFrame) -> DataFrame:
    schema = _schema("start int, level int, lang string, source string", [*_CENTRE, *_METRIC, "logdet"])
    return sums.mapInPandas(lambda frames: (metrics(f, _GROUP, *moments(f)) for f in frames if len(f)), schema)


def _leant(sums: DataFrame) -> DataFrame:
    """Centre and metric per (lang, source): leant on the language's, which leans on the corpus's."""
    schema = _schema("level int, lang string, source string, total bigint", [*_CENTRE, *_COV])
    own = stored(sums.mapInPandas(lambda frames: (spreads(f) for f in frames if len(f)), schema), "spreads")
    corpus = own.where("level = 2").first()  # One row, whatever the corpus.
    names = [*_CENTRE, *_COV]
    above = {f"a{c}": F.lit(corpus[c] if corpus else 0.0) for c in names}

    def languages(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            centre, cov = leaning(frame)
            out = {"lang": frame["lang"]} | {f"ac{i}": centre[:, i] for i in range(P)}
            yield pd.DataFrame(out | {f"av{i}{j}": cov[:, i, j] for i, j in _PAIRS})

    parents = own.where("level = 1").withColumns(above).mapInPandas(languages, _schema("lang string", [f"a{c}" for c in names]))
    groups = own.where("level = 0").join(parents, "lang")
    schema = _schema("lang string, source string", [*_CENTRE, *_METRIC, "logdet"])
    return groups.mapInPandas(lambda frames: (metrics(f, ["lang", "source"], *leaning(f)) for f in frames if len(f)), schema)


def distance() -> Column:
    """Squared Mahalanobis distance of x* from c* under m*, summed in a fixed order."""
    away = [F.col(x) / float(SCALE) - F.col(f"c{i}") for i, x in enumerate(STATISTICS)]
    total = F.lit(0.0)
    for i, j in _PAIRS:
        total = total + F.col(f"m{i}{j}") * away[i] * away[j]
    return F.greatest(total, F.lit(0.0))


def _starts(vectors: DataFrame) -> DataFrame:
    """Start 0 has the medians and the tolerances for scales, start 1 adds the median deviations.

    Values are bounded integers, so an exact percentile holds a bounded table.
    """
    keys = KEYS
    middles = stored(vectors.groupBy(*keys).agg(*[F.percentile(x, F.lit(0.5)).alias(f"q{x}") for x in STATISTICS]), "medians")
    off = salted_join(vectors, middles, keys, ["doc_id"]).select(*keys, *[F.abs(F.col(x) - F.col(f"q{x}")).alias(x) for x in STATISTICS])
    scales = off.groupBy(*keys).agg(*[F.percentile(x, F.lit(0.5)).alias(f"d{x}") for x in STATISTICS])
    both = middles.join(scales, keys).withColumn("start", F.explode(F.array(F.lit(0), F.lit(1))))
    centre = [(F.col(f"q{x}") / SCALE).alias(f"c{i}") for i, x in enumerate(STATISTICS)]
    metric = []
    for i, j in _PAIRS:
        spread = F.col(f"d{STATISTICS[i]}") * F.col("start") * 1.4826 / SCALE
        metric.append((1 / (spread * spread + TOLERANCE[i] ** 2) if i == j else F.lit(0.0)).alias(f"m{i}{j}"))
    return both.select("start", *keys, *centre, *metric, F.lit(1e300).alias("logdet"))


def _sums(vectors: DataFrame, now: DataFrame) -> DataFrame:
    """Counts and sums of the nearest half of each group, to the end of the distance bin that completes it."""
    x = [F.col(c) for c in STATISTICS]
    placed = salted_join(vectors, now, KEYS, ["doc_id"]).withColumn("bin", F.floor(F.log1p(distance()) * BINS).cast("int"))
    totals = [F.count(F.lit(1)).alias("n"), *[F.sum(x[i]).alias(f"s{i}") for i in range(P)]]
    totals += [F.sum(x[i] * x[j]).alias(f"s{i}{j}") for i, j in _PAIRS]
    binned = placed.groupBy(*_GROUP, "bin").agg(*totals)
    # At most some thousand bins a group, whatever its size.
    group = Window.partitionBy(*_GROUP)
    before = F.sum("n").over(group.orderBy("bin")) - F.col("n")
    placed = binned.withColumns({"total": F.sum("n").over(group), "_before": before})
    chosen = placed.where("_before < (total + %d) div 2" % (P + 1))
    names = ["n", *[f"s{i}" for i in range(P)], *[f"s{i}{j}" for i, j in _PAIRS]]
    return chosen.groupBy(*_GROUP).agg(F.first("total").alias("total"), *[F.sum(c).alias(c) for c in names])


def levels(vectors: DataFrame) -> DataFrame:
    """Each vector in its (language, source), its language and the corpus."""
    empty = F.lit("")
    at = [(0, F.col("lang"), F.col("source")), (1, F.col("lang"), empty), (2, empty, empty)]
    places = F.array(*[F.struct(F.lit(k).alias("level"), a.alias("lang"), b.alias("source")) for k, a, b in at])
    return vectors.select("doc_id", *STATISTICS, F.inline(places))


def concentrated(vectors: DataFrame) -> DataFrame:
    """Centre and metric per (lang, source) from all levels' estimates.

    Each takes steps until no determinant falls, and the lower of its two starts.
    """
    vectors = stored(levels(vectors), "levels")
    now = stored(_starts(vectors), "starts")
    for _ in range(MOST_STEPS):
        sums = stored(_sums(vectors, now), "sums")
        later = stored(_estimated(sums), "step")
        fell = later.select(*_GROUP, "logdet").join(now.select(*_GROUP, F.col("logdet").alias("was")), _GROUP)
        now = later
        if fell.where("logdet < was - 1e-9").isEmpty():
            break
    pick = F.min_by("start", F.struct("logdet", "start")).alias("start")
    best = now.groupBy(*KEYS).agg(pick)
    return _leant(sums.join(best, _GROUP, "left_semi"))


def judge(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept.

    Needs ``lang`` and ``source``; a null there is a group of its own. Rows
    that fail the base rule are not kept and take no part in the estimates. The
    rest is kept unless its squared distance exceeds ``CUT``. A group of few
    rows is judged nearly as its language, a language of few as the corpus, and
    a corpus of few rows is its own centre. Null and
    empty texts fail the base rule. Rows come out as often as they came in;
    other columns are dropped.
    """
    own = stored(measured(df, id_column, text_column), "measured")
    vectors = own.where("NOT base_failed").select("doc_id", "lang", "source", *STATISTICS)
    found = stored(concentrated(vectors), "estimates").drop("logdet")
    kept = ~F.col("base_failed") & F.coalesce(distance() <= CUT, F.lit(False))
    return salted_join(own, found, ["lang", "source"], ["doc_id"], "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept")
    )
