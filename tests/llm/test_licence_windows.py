"""Licences inside longer texts: windows of words against a plain search."""

import random
import textwrap
from collections import Counter

from complyframe.llm import licences

PROSE = "an ordinary paragraph of a file that has nothing to do with any of this and goes on for a while "


def plain_windows(text, templates, percent):
    """The best of all windows of every size within the bounds: name, shared, its bigrams, those of the template."""
    own, best = licences.grams(text), None
    for place, (name, template) in enumerate(sorted(templates.items())):
        known = Counter(licences.grams(template))
        n = known.total()
        low, high = licences.size_bounds(n, percent)
        # A text in reach of a template no shorter than it is compared whole.
        sizes = range(low, high + 1) if len(own) > n else [len(own)]
        for size in sizes:
            for at in range(len(own) - size + 1):
                shared = (Counter(own[at : at + size]) & known).total()
                if shared * 200 >= (size + n) * percent and shared:
                    rank = (shared * 2.0 / (size + n), shared, -place, size, name, n)
                    best = max(best, rank) if best else rank
    return (best[4], best[1], best[3], best[5]) if best else (None, None, None, None)


def scanned(spark, values, *more):
    df = spark.createDataFrame(list(enumerate(values)), "doc_id bigint, text string")
    return [(r.licence, r.shared, r.unit_bigrams, r.template_bigrams) for r in licences.scan(df, *more).orderBy("doc_id").collect()]


def test_licences_inside_long_texts(spark):
    mit, isc = licences.TEMPLATES["mit-text"], licences.TEMPLATES["isc-text"]
    wrapped = "\n".join(f" * {line}" for line in textwrap.wrap(mit, 60))
    cut = " ".join(isc.split()[:30])
    values = [
        PROSE * 8 + "\n" + wrapped + "\n" + PROSE * 8,
        PROSE + "\n" + "\n".join(f"# {line}" for line in textwrap.wrap(isc, 40)) + "\n" + PROSE * 3,
        PROSE + "it was Released under the MIT License. " + PROSE,
        PROSE + cut + " " + PROSE,
        PROSE * 20,
    ]
    got = scanned(spark, values)
    assert [r[0] for r in got] == ["mit-text", "isc-text", "mit", "isc-text", None]
    assert got == [plain_windows(v, licences.TEMPLATES, 80) for v in values]


def test_windows_equal_plain_search(spark):
    draw = random.Random(7)
    templates = {"a": "x y z x y z w", "b": "z z z z", "c": "longest x y word y x"}
    values = [" ".join(draw.choices(["x", "y", "z", "w", "word", "longest", "q"], [4, 4, 5, 2, 1, 1, 1], k=draw.randrange(2, 40))) for _ in range(150)]
    for percent in (60, 80):
        assert scanned(spark, values, templates, percent) == [plain_windows(v, templates, percent) for v in values]
