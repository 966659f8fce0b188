"""Whole licence texts and standard headers are found, alone and wrapped inside longer files."""

import textwrap

import pytest

from complyframe.llm import licences

PROSE = "an ordinary paragraph of a file that has nothing to do with any of this and goes on for a while\n"
HEADERS = [
    "agpl-3.0-header", "apache-2.0-header", "bsd-2-clause-text", "bsd-3-clause-text", "cc0-1.0-header", "gpl-2.0-header",
    "gpl-3.0-header", "lgpl-2.1-header", "lgpl-3.0-header", "mpl-2.0-header", "unlicense-text",
]
WHOLE = ["apache-2.0-text", "cc0-1.0-text", "gpl-2.0-text", "gpl-3.0-text", "lgpl-2.1-text", "lgpl-3.0-text", "mpl-2.0-text"]


@pytest.mark.parametrize("names", [HEADERS, WHOLE], ids=["headers", "whole"])
def test_usual_licences(spark, names):
    known = [licences.TEMPLATES[name] for name in names]
    values = [*known, *(PROSE * 9 + "\n".join(f" * {x}" for x in textwrap.wrap(text, 50)) + "\n" + PROSE * 9 for text in known if len(text) < 12_000)]
    df = spark.createDataFrame(list(enumerate(values)), "doc_id bigint, text string").repartition(8)
    got = licences.scan(df).orderBy("doc_id").collect()
    assert [r.licence for r in got] == names + [name for name in names if len(licences.TEMPLATES[name]) < 12_000]
    assert all(r.shared == r.unit_bigrams == r.template_bigrams for r in got)
