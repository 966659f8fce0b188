"""Jaccard components, lexical search and token alignment against plain versions."""

import hashlib
import json
import math
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from complyframe.llm import alignment, bytebpe, jaccard, lexical

SF = "/root/testdata/sf0.001"
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    "", " ", "\n", "  a  b ", "a b  c", "\x1c\x1d x\x85y", "don't WE'LL it's", "naïve \U0001f600\U0001f600 x", "a b  c", "A B c",
    "<|endoftext|> and </s> <unk> <0x41>", "a\r\n\r\n  b\t\tc ", "é" * 50, "ab" * 4000, "123 456,7!!??", "​ zero", "ﬁ ² Ⅷ ▁x", "x" * 30 + " y",
]


def table(spark, values, more=()):
    """Values as documents, with a repeated row, a null id, a null text and clashing column names."""
    rows = [*enumerate(values), (0, values[0]), (None, values[-1]), (None, "null id"), (len(values), None), *more]
    clash = ["cls", "n", "token", "item_id", "rank", "score", "a", "b", "node", "component", "leader", "tile", "key", "_item", "_r"]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    return df.withColumns({c: F.lit(1) for c in clash}), rows


# 11. N-gram Jaccard join


def plain_sets(rows, width=4):
    sets = []
    for _, text in rows:
        words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
        wide = min(width, len(words))
        sets.append({tuple(words[k : k + wide]) for k in range(len(words) - wide + 1)} if words else set())
    return sets


def plain_components(rows, percent=85, width=4):
    """By all pairs."""
    sets, root = plain_sets(rows, width), list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for k, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(k)] = min(least.get(find(k), doc), doc)
    return Counter((doc, len(sets[k]), least.get(find(k)) if sets[k] else doc) for k, (doc, _) in enumerate(rows))


def edited(rng, words, share):
    return [rng.choice(("uno", "dos", "tres")) + str(rng.randrange(99)) if rng.random() < share else w for w in words]


def family(rng, size, copies, shares):
    words = [f"w{rng.randrange(3000)}" for _ in range(size)]
    return [" ".join(edited(rng, words, rng.choice(shares))) for _ in range(copies)]


@pytest.mark.parametrize("seed", range(3))
def test_jaccard(spark, monkeypatch, seed):
    """Dense groups near the threshold, a shared passage, copies, sizes at the bounds; small tiles and few frequent shingles."""
    monkeypatch.setattr(jaccard, "TILE", 7)
    monkeypatch.setattr(jaccard, "KEPT", 60)
    monkeypatch.setattr(jaccard, "FREQUENT", 3)
    rng = random.Random(seed)
    passage = " ".join(f"p{k}" for k in range(60))
    values = family(rng, 120, 40, (0, 0.01, 0.02, 0.03)) + family(rng, 40, 30, (0, 0.03, 0.06))
    values += [" ".join([*family(rng, rng.randrange(1, 60), 1, (0,)), passage]) for _ in range(25)]
    long = [f"q{k}" for k in range(103)]
    values += [" ".join(long[:n]) for n in range(80, 104)] + [" ".join(long[k:]) for k in range(0, 20, 3)]
    values += family(rng, 3, 6, (0, 0.5)) + ["one", "One", "one two", "", " "] + values[:4]
    rng.shuffle(values)
    df, rows = table(spark, values)
    got = Counter(map(tuple, jaccard.near_sets(df).select("doc_id", "n_shingles", "component_id").collect()))
    assert got == plain_components(rows)


def test_jaccard_documents(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.collect()]
    got = Counter(map(tuple, jaccard.near_sets(df).select("doc_id", "n_shingles", "component_id").collect()))
    assert got == plain_components(rows)


def test_jaccard_odd_rows(spark):
    df, rows = table(spark, ODD)
    got = Counter(map(tuple, jaccard.near_sets(df, 60, 2).select("doc_id", "n_shingles", "component_id").collect()))
    assert got == plain_components(rows, 60, 2)


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 30)), st.lists(st.sets(st.integers(0, 30)), min_size=1, max_size=6))
def test_overlaps_from_a_leader(leader, others):
    """Whatever is given as changes or whole, the intersections of different members come out."""
    for mask in range(1 << len(others)):
        relative = np.array([bool(mask >> k & 1) for k in range(len(others))])
        plus = [np.array(sorted(s - leader if r else s), np.int64) for s, r in zip(others, relative, strict=True)]
        minus = [np.array(sorted(leader - s if r else ()), np.int64) for s, r in zip(others, relative, strict=True)]
        common = np.array([len(s & leader) for s in others])
        got = jaccard.overlaps(np.array([len(s) for s in others]), len(leader), common, relative, plus, minus)
        want = np.array([[len(a & b) for b in others] for a in others])
        apart = ~np.eye(len(others), dtype=bool)
        assert (got[apart] == want[apart]).all()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from([" ", "\n", "\x0b", "\x1c", "a", "A", "b", "é", "É", "\x85", "word", "x" * 40]), max_size=60))
def test_words_by_hash(parts):
    """Equal hashes and equal words are the same, in any span."""
    text = "".join(parts).encode()
    plain = re.findall(rb"[^\x20\x09-\x0D]+", text.lower())
    for span in (1, 7, jaccard.SPAN):
        held, jaccard.SPAN = jaccard.SPAN, span
        got = jaccard.words(text).tolist()
        jaccard.SPAN = held
        assert len(got) == len(plain) and len(set(zip(got, plain, strict=True))) == len(set(got)) == len(set(plain))
        assert got == [jaccard.words(w)[0] for w in plain]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=50))
def test_gaps(values):
    values = np.array(sorted(values), np.uint32)
    assert jaccard.from_gaps(jaccard.gaps(values)).tolist() == values.tolist()


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 2**48 - 1), max_size=30))
def test_packed_sets(values):
    tokens = np.array(sorted(values), np.uint64) << np.uint64(16)
    assert jaccard.unpacked(jaccard.packed(tokens | np.uint64(0xABCD))).tolist() == tokens.tolist()


def test_answers_derived_not_compared(spark):
    """Members that all link with their leader, and a leader's only member, make no pairs of tiles."""
    rows = spark.createDataFrame([(1, 1, True, 2), (2, 1, True, 2), (6, 5, False, 1)], "cls bigint, leader bigint, linked boolean, members bigint")
    held = rows.selectExpr("*", "10L AS n", "10L AS leader_n", "1 AS tiles", "0 AS tile", "5L AS common", "true AS relative")
    assert jaccard.others(held.selectExpr("*", "X'' AS plus", "X'' AS minus")).count() == 0


# 12. Ranked lexical search


def plain_search(docs, items, top=20):
    find = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = [find.findall((t or "").translate(lower)) for _, t in docs]
    holding, total = sum(map(bool, words)), sum(map(len, words))
    df = Counter(w for own in words for w in set(own))
    result = []
    for item, text in items:
        found = []
        for (doc, _), own in zip(docs, words, strict=True):
            tf, score = Counter(own), 0
            for w in find.findall((text or "").translate(lower)):
                if tf[w]:
                    m = 100 - 25 + (25 * len(own) * holding) // total
                    score += math.floor(1000 * math.log((2 * holding + 2) / (2 * df[w] + 1))) * ((1000000000 * tf[w]) // (1000 * tf[w] + 12 * m))
            if score:
                found.append((-score, doc is None, doc or 0))
        result += [(item, k, None if none else doc, -s) for k, (s, none, doc) in enumerate(sorted(found)[:top], 1)]
    return Counter(result)


def search_rows(found):
    return Counter(map(tuple, found.select("item_id", "rank", "doc_id", "score").collect()))


ITEMS = [(1, "A b, c the THE the"), (2, None), (3, "!?"), (1, "zero é naïve"), (None, "x y 123"), (4, "ab" * 4000), (5, "don't \x85y ﬁ")]


def test_search_odd_rows(spark):
    df, rows = table(spark, [*ODD, "the the cat", "The dog a", "x", "x"])
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string").withColumns({"doc_id": F.lit(1), "rank": F.lit(1)})
    assert search_rows(lexical.search(df, items, 3)) == plain_search(rows, ITEMS, 3)


def test_search_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK_BYTES", 700)
    monkeypatch.setattr(lexical, "EXACT", 0)
    df = spark.read.parquet(f"{SF}/documents.parquet").repartition(5)
    rows = [(r.doc_id, r.text) for r in df.collect()]
    items = spark.read.parquet(f"{SF}/benchmark.parquet").limit(20)
    assert search_rows(lexical.search(df, items)) == plain_search(rows, [(r.item_id, r.text) for r in items.collect()])


def test_terms_are_whole_and_overlap():
    scanner = lexical.Scanner((b"a", b"a\xc3\xa9", b"b"))
    assert scanner.scan("A a, aé-b ab a b".encode()) == (6, Counter({0: 2, 1: 1, 2: 1}))


# 13. Cross-tokenizer alignment


@pytest.fixture(scope="module")
def library():
    library = Tokenizer.from_file(A)
    library.encode_special_tokens = True
    return library


@pytest.fixture(scope="module")
def pieces():
    return sentencepiece.SentencePieceProcessor(model_file=B)


def plain_alignment(texts, library, pieces):
    """Per text (n_a, n_b, groups as text, links), by walking both lists."""
    to_byte = bytebpe.byte_of()
    result = []
    for text in texts:
        if not text:
            result.append((0, 0, "", []))
            continue
        a, b = library.encode(" " + text, add_special_tokens=False).ids, pieces.encode(text)
        bytes_a = [bytes(to_byte[c] for c in library.id_to_token(i)) for i in a]
        named = [pieces.id_to_piece(i) for i in b]
        bytes_b = [bytes([int(p[3:5], 16)]) if re.fullmatch(r"<0x..>", p) else p.replace("▁", " ").encode() for p in named]
        want = (" " + text).encode()
        if b"".join(bytes_a) != want or b"".join(bytes_b) != want:
            result.append((0, 0, "", []))
            continue
        end_a, end_b = np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()
        groups, i, j = [], 0, 0
        for end in sorted(set(end_a) & set(end_b)):
            x, y = end_a.index(end) + 1, end_b.index(end) + 1
            groups.append((a[i:x], b[j:y]))
            i, j = x, y
        spelled = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        result.append((len(a), len(b), spelled, [(x[-1], y[-1]) for x, y in groups]))
    return result


def test_alignment(spark, library, pieces):
    sample = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    df, rows = table(spark, [*ODD, *sample[:80]])
    plain = plain_alignment([t for _, t in rows], library, pieces)
    count = Counter(link for *_, found in plain for link in found)
    most = {}
    for (_, b), n in count.items():
        most[b] = max(most.get(b, 0), n)
    want = Counter()
    for (doc, _), (n_a, n_b, spelled, found) in zip(rows, plain, strict=True):
        digest = hashlib.sha256(spelled.encode()).hexdigest() if spelled else ""
        best = sum(count[p] == most[p[1]] for p in found)
        want[doc, n_a, n_b, len(found), len(found), best, sum(count[p] for p in found), digest] += 1
    got = alignment.align(df, A, B).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    assert Counter(map(tuple, got.collect())) == want
    assert sum(bool(found) for *_, found in plain) > 60 and len(count) <= alignment.Pair.load(A, B).bound()


def test_every_token_is_made_of_its_own_bytes(library):
    """What makes lowest-rank merges and the library's listed merges the same; see bytebpe."""
    codec = bytebpe.ByteBpe.load(A, False)
    from tokenizers import models

    spec = json.loads(open(A, encoding="utf-8").read())["model"]
    model = models.BPE(spec["vocab"], [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["merges"]])
    names = {i: t for t, i in spec["vocab"].items()}
    wrong = [i for i in codec.tokens if [t.id for t in model.tokenize(names[i])] != [i]]
    assert wrong == []


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=200) | st.text(alphabet="ab \n'st é<|endoftx>", max_size=300))
def test_ids_equal_the_library(library, text):
    assert bytebpe.ByteBpe.load(A, False).encode(text) == library.encode(text, add_special_tokens=False).ids


def test_special_tokens_as_the_library():
    plain = Tokenizer.from_file(A)
    for text in ("a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>x", "<|endoftext", "none"):
        assert bytebpe.ByteBpe.load(A, True).encode(text) == plain.encode(text, add_special_tokens=False).ids
