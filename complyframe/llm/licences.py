"""Licence scans: normalised lines, texts and windows of words against licence templates, on built-in functions alone."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Mapping
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Whole texts and standard headers of the usual licences, a file each, named by SPDX identifier.
TEXTS = Path(__file__).with_name("licence_texts")
#: Usual licence statements, the permission paragraphs of two short licences, and the files.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "mit": "Released under the MIT License.",
    "mit-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions: The above copyright notice and this permission notice shall be included in all copies "
        "or substantial portions of the Software."
    ),
    "isc-text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
    ),
    **{file.stem: file.read_text(encoding="utf-8") for file in sorted(TEXTS.glob("*.txt"))},
}
THRESHOLD_PERCENT = 80


def grams(text: str) -> list[str]:
    """Word bigrams, repeats included; words are lower-case runs of a-z and 0-9."""
    words = "".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).split()
    return [f"{a} {b}" for a, b in zip(words, words[1:])]


def size_bounds(n: int, percent: int) -> tuple[int, int]:
    """Numbers of bigrams that can reach a Dice of ``percent`` with n bigrams: 2 min / (a + b) must reach it."""
    return -(-n * percent // (200 - percent)), n * (200 - percent) // percent


def key_words(counts: Mapping[str, int], percent: int) -> list[str]:
    """Words, longest first, in so many of a template's bigrams that text without any of them cannot reach ``percent``."""
    n = sum(counts.values())
    spare = n - size_bounds(n, percent)[0]
    chosen: list[str] = []
    touched, among = set(), defaultdict(set)
    for g in counts:
        for word in g.split():
            among[word].add(g)
    for word in sorted(among, key=lambda w: (-len(w), w)):
        chosen.append(word)
        spare -= sum(counts[g] for g in among[word] - touched)
        touched |= among[word]
        if spare < 0:
            break
    return chosen


def _strings(values: list[str]) -> Column:
    """A literal array of words or bigrams, as one constant."""
    return F.split(F.lit("\n".join(values)), "\n") if values else F.array().cast("array<string>")


def _literal(templates: Mapping[str, str], percent: int) -> Column:
    rows = []
    for place, (name, text) in enumerate(sorted(templates.items())):
        counts = Counter(grams(text))
        if not counts:
            raise ValueError(f"template {name} needs two words")
        n = counts.total()
        least, most = size_bounds(n, percent)
        rows.append(
            F.struct(
                F.lit(name).alias("name"),
                F.lit(-place).alias("place"),
                F.lit(n).alias("n"),
                F.lit(least).alias("least"),
                F.lit(most).alias("most"),
                _strings(list(counts)).alias("grams"),
                _strings([str(c) for c in counts.values()]).cast("array<int>").alias("counts"),
                _strings([g for g, c in counts.items() if c > 1]).alias("again"),
                _strings([str(c) for c in counts.values() if c > 1]).cast("array<int>").alias("times"),
                _strings(key_words(counts, percent)).alias("keys"),
            )
        )
    return F.array(*rows)


def scan(
    df: DataFrame,
    templates: Mapping[str, str] = TEMPLATES,
    percent: int = THRESHOLD_PERCENT,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Per row: doc_id, licence (null: none), shared, unit_bigrams, template_bigrams, n_lines.

    Units are the lines of a text, the whole of it, and for each template that
    the text is longer than, all its windows of words, across lines, within the
    template's size bounds. Dice is taken over bigrams with their repeats: twice
    the shared ones over the sum of both sizes. A text without a template's key
    words cannot reach it and is not compared; the size bounds rest on the
    number of words alone, so a unit out of every template's reach is never cut
    into bigrams. The best match wins; ties go to more shared bigrams, then to
    the first name. ``n_lines`` counts the lines that reach the threshold. All
    work is within the row: no shuffle, no join.

    Null and empty texts match nothing. Rows come out as often as they came in;
    other columns are dropped.
    """
    every = [size_bounds(len(grams(text)), percent) for text in templates.values()]
    low, high = min(a for a, _ in every), max(b for _, b in every)
    keys = sorted({w for text in templates.values() for w in key_words(Counter(grams(text)), percent)})
    none = F.array().cast("array<string>")
    clean = F.regexp_replace(F.lower(F.coalesce(text_column, F.lit(""))), r"[^a-z0-9\n]+", " ")

    def pairs(words: Column) -> Column:
        return F.zip_with(F.slice(words, F.lit(1), F.size(words) - 1), F.slice(words, F.lit(2), F.size(words) - 1), lambda a, b: F.concat_ws(" ", a, b))

    lines = F.transform(
        F.when(F.size("_known") > 0, F.split("_clean", "\n")).otherwise(none),
        lambda x: F.struct(F.lit(True).alias("line"), F.split(F.trim(x), " +").alias("words")),
    )
    whole = F.when(
        (F.size("_known") > 0) & F.contains("_clean", F.lit("\n")), F.array(F.struct(F.lit(False).alias("line"), F.col("_words").alias("words")))
    ).otherwise(F.array())
    units = F.filter(F.concat(lines, whole), lambda u: F.size(u["words"]).between(low + 1, high + 1))
    paired = F.transform(
        units, lambda u: F.struct(u["line"].alias("line"), (F.size(u["words"]) - 1).alias("n"), pairs(u["words"]).alias("grams"))
    )

    def within_reach(u: Column, t: Column) -> Column:
        # No more is shared than what the template repeats plus one of each bigram in both.
        most = t["n"] - F.size(t["grams"]) + F.size(F.array_intersect(u["grams"], t["grams"]))
        return u["n"].between(t["least"], t["most"]) & (most * 200 >= (u["n"] + t["n"]) * percent)

    def match(u: Column, t: Column) -> Column:
        # Each bigram in both counts once; what the template repeats is counted out.
        more = F.zip_with(t["again"], t["times"], lambda g, c: F.greatest(F.least(c, F.size(F.filter(u["grams"], lambda x: x == g))) - 1, F.lit(0)))
        shared = F.aggregate(more, F.size(F.array_intersect(u["grams"], t["grams"])), lambda total, x: total + x)
        return F.struct(
            (shared * 2.0 / (u["n"] + t["n"])).alias("dice"),
            shared.alias("shared"),
            t["place"].alias("place"),
            u["n"].alias("n"),
            t["n"].alias("template_n"),
            t["name"].alias("name"),
        )

    def reaches(m: Column) -> Column:
        return m["shared"] * 200 >= (m["n"] + m["template_n"]) * percent

    best = F.transform(
        "_paired",
        lambda u: F.struct(
            u["line"].alias("line"),
            F.array_max(F.filter(F.transform(F.filter("_known", lambda t: within_reach(u, t)), lambda t: match(u, t)), reaches)).alias("match"),
        ),
    )

    def spots(t: Column) -> Column:
        """Places p of a template's bigrams in the text by k, the bigram's number in the template, then in order."""
        each = F.transform("_grams", lambda g, p: F.struct(F.array_position(t["grams"], g).cast("int").alias("k"), p.alias("p")))
        return F.array_sort(F.filter(each, lambda x: x["k"] > 0))

    def linked(t: Column, at: Column) -> Column:
        """A spot counts in the windows that begin after ``back``: later the template's number of that bigram is used up."""

        def link(x: Column, i: Column) -> Column:
            c = F.element_at(t["counts"], x["k"])
            back = F.when((i >= c) & (F.get(at, i - c)["k"] == x["k"]), F.get(at, i - c)["p"]).otherwise(-1)
            return F.struct(x["p"].alias("p"), back.alias("back"))

        return F.array_sort(F.transform(at, link))

    def window(t: Column, at: Column) -> Column:
        """The best window of a template. Both its ends are spots: others only add to its size, or are too few to reach."""

        def ends(x: Column, i: Column) -> Column:
            def longer(best: Column, y: Column) -> Column:
                seen = best["seen"] + F.when(y["back"] < x["p"], 1).otherwise(0)
                n = y["p"] - x["p"] + 1
                now = F.struct((seen * 2.0 / (n + t["n"])).alias("dice"), seen.alias("shared"), n.alias("n"))
                better = n.between(t["least"], t["most"]) & (now > best["top"])
                return F.struct(seen.alias("seen"), F.when(better, now).otherwise(best["top"]).alias("top"))

            start = F.struct(F.lit(0).alias("seen"), F.struct(F.lit(0.0).alias("dice"), F.lit(0).alias("shared"), F.lit(0).alias("n")).alias("top"))
            enough = F.get(at, i + t["least"] - 1)["p"] - x["p"] < t["most"]
            return F.when(enough, F.aggregate(F.slice(at, i + 1, t["most"]), start, longer)["top"])

        top = F.array_max(F.transform(at, ends))
        return F.struct(
            top["dice"].alias("dice"),
            top["shared"].alias("shared"),
            t["place"].alias("place"),
            top["n"].alias("n"),
            t["n"].alias("template_n"),
            t["name"].alias("name"),
        )

    def fits(t: Column) -> Column:
        return (F.size("_grams") > t["n"]) & (t["n"] - F.size(t["grams"]) + F.size(F.array_intersect(F.col("_grams"), t["grams"])) >= t["least"])

    rows = df.select(F.col(id_column).alias("doc_id"), clean.alias("_clean"))
    rows = rows.select("*", F.split(F.trim(F.translate("_clean", "\n", " ")), " +").alias("_words"))
    rows = rows.select("*", F.array_intersect("_words", _strings(keys)).alias("_keys"))
    known = F.filter(_literal(templates, percent), lambda t: F.arrays_overlap(F.col("_keys"), t["keys"]))
    rows = rows.select("doc_id", "_clean", "_words", F.when(F.size("_keys") > 0, known).alias("_known"))
    long = F.exists("_known", lambda t: F.size("_words") - 1 > t["n"])
    rows = rows.select("doc_id", "_known", paired.alias("_paired"), F.when(long, pairs(F.col("_words"))).otherwise(none).alias("_grams"))
    hits = F.filter(best, lambda x: x["match"].isNotNull()).alias("_hits")
    spotted = F.transform(F.filter("_known", fits), lambda t: F.struct(t.alias("t"), spots(t).alias("at")))
    rows = rows.select("doc_id", hits, spotted.alias("_spotted"))
    joined = F.transform("_spotted", lambda x: F.struct(x["t"].alias("t"), linked(x["t"], x["at"]).alias("at")))
    rows = rows.select("doc_id", "_hits", joined.alias("_linked"))
    windows = F.filter(F.transform("_linked", lambda x: window(x["t"], x["at"])), lambda m: F.coalesce(reaches(m), F.lit(False)))
    rows = rows.select("doc_id", "_hits", windows.alias("_windows"))
    top = F.array_max(F.concat(F.transform("_hits", lambda x: x["match"]), F.col("_windows")))
    rows = rows.select("doc_id", top.alias("_top"), F.filter("_hits", lambda x: x["line"]).alias("_lines"))
    return rows.select(
        "doc_id",
        F.col("_top.name").alias("licence"),
        F.col("_top.shared").cast("bigint").alias("shared"),
        F.col("_top.n").cast("bigint").alias("unit_bigrams"),
        F.col("_top.template_n").cast("bigint").alias("template_bigrams"),
        F.size("_lines").cast("bigint").alias("n_lines"),
    )


def scan_sql(templates: Mapping[str, str] = TEMPLATES, percent: int = THRESHOLD_PERCENT) -> str:
    """The same rows in SQL, without any pruning, where no window beats the lines and the whole text; ids must be unique."""
    values = ", ".join(
        f"('{name}', {-place}, '{g}', {c})"
        for place, (name, text) in enumerate(sorted(templates.items()))
        for g, c in Counter(grams(text)).items()
    )
    return f"""
WITH template_grams(name, place, gram, c) AS (VALUES {values}),
template AS (SELECT name, place, CAST(sum(c) AS BIGINT) AS n FROM template_grams GROUP BY ALL),
cleaned AS (SELECT doc_id, regexp_replace(lower(coalesce(text, '')), '[^a-z0-9\n]+', ' ', 'g') AS t FROM documents),
line AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS u, generate_subscripts(string_split(t, chr(10)), 1) AS no FROM cleaned),
unit AS (
  SELECT doc_id, no, string_split(trim(regexp_replace(u, ' +', ' ', 'g')), ' ') AS w FROM line
  UNION ALL
  SELECT doc_id, 0, string_split(trim(regexp_replace(t, '[ \n]+', ' ', 'g')), ' ') FROM cleaned WHERE contains(t, chr(10))
),
pairs AS (SELECT doc_id, no, len(w) - 1 AS n, unnest(list_zip(w[:-2], w[2:])) AS p FROM unit WHERE len(w) > 1),
counted AS (SELECT doc_id, no, n, p[1] || ' ' || p[2] AS gram, count(*) AS c FROM pairs GROUP BY ALL),
hit AS (
  SELECT doc_id, no, k.n AS un, name, CAST(sum(least(k.c, g.c)) AS BIGINT) AS shared
  FROM counted k JOIN template_grams g USING (gram) GROUP BY doc_id, no, k.n, name
),
match AS (
  SELECT h.*, t.n AS tn, place, shared * 2.0 / (un + t.n) AS dice FROM hit h JOIN template t USING (name)
  WHERE shared * 200 >= (un + t.n) * {percent}
),
best AS (
  SELECT * FROM match
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY dice DESC, shared DESC, place DESC, un) = 1
)
SELECT d.doc_id, b.name AS licence, b.shared, CAST(b.un AS BIGINT) AS unit_bigrams, b.tn AS template_bigrams,
  (SELECT count(DISTINCT m.no) FROM match m WHERE m.doc_id = d.doc_id AND m.no > 0) AS n_lines
FROM documents d LEFT JOIN best b ON b.doc_id = d.doc_id"""
