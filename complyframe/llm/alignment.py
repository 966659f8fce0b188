"""Two tokenizers aligned by byte offsets, on Arrow arrays from end to end.

Token lists of a batch are flattened; running sums of byte lengths give every
token's end, as one key that ascends through the batch. An Acero join of both
sides on that key finds where tokens of both end together. Pair counts are
grouped per task by Arrow and merged by Spark.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from complyframe.llm.bytebpe import ByteBpe
from complyframe.llm.pieces import chunks
from complyframe.llm.shared import stored

#: Characters of text aligned at once.
CHUNK = 1 << 18
#: Rows whose links are grouped at once.
ROWS = 256


class Pair:
    """Both tokenizers: A a byte-level BPE file, B a sentencepiece model that itself puts a space in front."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece

        self.a = ByteBpe.load(path_a, False)
        with open(path_b, "rb") as file:
            self.b = sentencepiece.SentencePieceProcessor(model_proto=file.read())
        octets = [b""] * (max(self.a.tokens) + 1)
        for i, token in self.a.tokens.items():
            octets[i] = token
        self.bytes_a = pa.array(octets, pa.binary())
        self.bytes_b = pa.array([self._piece(i) for i in range(self.b.get_piece_size())], pa.binary())
        # A pair of ids is one number.
        self.radix = len(self.bytes_b)
        self.code = np.dtype("<i4" if len(self.bytes_a) * self.radix < 1 << 31 else "<i8")

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    @staticmethod
    @cache
    def load(path_a: str, path_b: str) -> Pair:
        return Pair(path_a, path_b)

    def bound(self) -> int:
        """No more pairs of ids can end together: of two tokens that do, one's bytes end the other's."""
        return sum(pc.sum(pc.binary_length(x)).as_py() for x in (self.bytes_a, self.bytes_b))


def _lists(values: list[list[int]]) -> pa.ListArray:
    offsets = np.cumsum([0, *map(len, values)])
    flat = np.fromiter((i for own in values for i in own), np.int32, offsets[-1])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat))


def _spelled(lists: pa.ListArray, octets: pa.Array) -> pa.Array:
    """The joined bytes of each list."""
    flat = octets.take(lists.flatten())
    return pc.binary_join(pa.LargeListArray.from_arrays(lists.offsets.cast(pa.int64()), flat.cast(pa.large_binary())), pa.scalar(b"", pa.large_binary()))


def _side(lists: pa.ListArray, flat: pa.Array, name: str) -> pa.Table:
    """Per token: its document, its id, where it ends in the batch, its place."""
    ends = pc.cumulative_sum(pc.binary_length(flat).cast(pa.int64()))
    return pa.table(
        {"end": ends, f"doc_{name}": pc.list_parent_indices(lists), name: lists.flatten(), f"at_{name}": pa.array(np.arange(len(ends)))}
    )


def _grouped(ids: pa.Array, last: np.ndarray) -> pa.Array:
    """Ids as text with commas, by the place of each group's last one."""
    offsets = pa.array(np.concatenate([[0], last + 1]), pa.int32())
    return pc.binary_join(pa.ListArray.from_arrays(offsets, ids.cast(pa.string())), ",")


def aligned(texts: list[bytes], pair: Pair) -> pa.Table:
    """Per text: n_a, n_b, n_groups, n_links, groups_sha256 and ``links``, the codes of the linked id pairs in order."""
    whole = [text.decode("utf-8", "replace") for text in texts]
    lists_a = _lists([pair.a.encode(" " + text) if text else [] for text in whole])
    lists_b = _lists([found if text else [] for text, found in zip(whole, pair.b.encode(whole, num_threads=1), strict=True)])
    want = pa.array([b" " + text if text else b"" for text in texts], pa.large_binary())
    joined_a = _spelled(lists_a, pair.bytes_a)
    joined_b = _spelled(lists_b, pair.bytes_b)
    fits = pc.and_(pc.and_(pc.equal(joined_a, want), pc.equal(joined_b, want)), pc.greater(pc.binary_length(want), 0))
    where = np.flatnonzero(fits.to_numpy(zero_copy_only=False))
    lists_a, lists_b = lists_a.take(pa.array(where)), lists_b.take(pa.array(where))
    a = _side(lists_a, pair.bytes_a.take(lists_a.flatten()), "a")
    b = _side(lists_b, pair.bytes_b.take(lists_b.flatten()), "b")
    # Both sides spell the same bytes, so an end in the batch is one document's.
    links = a.join(b, "end", join_type="inner").sort_by([("end", "ascending"), ("at_a", "ascending"), ("at_b", "ascending")])
    document = links.column("doc_a").to_numpy()
    ends, first = np.unique(links.column("end").to_numpy(), return_index=True)
    # Where several tokens end at one place, the last of them ends the group.
    last = np.append(first[1:], len(document)) - 1 if len(first) else first
    text_a = _grouped(a.column("a").combine_chunks(), links.column("at_a").to_numpy()[last])
    text_b = _grouped(b.column("b").combine_chunks(), links.column("at_b").to_numpy()[last])
    groups = np.bincount(document[first], minlength=len(where)) if len(where) else np.zeros(0, np.int64)
    by_doc = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(groups)]), pa.int32()), pc.binary_join_element_wise(text_a, text_b, "|"))
    digests = [hashlib.sha256(x.as_buffer()).hexdigest() for x in pc.binary_join(by_doc, ";")]
    n_links = np.bincount(document, minlength=len(where)) if len(where) else np.zeros(0, np.int64)

    def spread(values, kind=pa.int64(), empty=0):
        out = np.full(len(texts), empty, object if kind == pa.string() else np.int64)
        out[where] = values
        return pa.array(out, kind)

    codes = (links.column("a").to_numpy().astype(np.int64) * pair.radix + links.column("b").to_numpy()).astype(pair.code)
    offsets = np.concatenate([[0], np.cumsum(spread(n_links).to_numpy())]) * pair.code.itemsize
    octets = pa.BinaryArray.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(codes)])
    return pa.table(
        {
            "n_a": spread(pc.list_value_length(lists_a).to_numpy()),
            "n_b": spread(pc.list_value_length(lists_b).to_numpy()),
            "n_groups": spread(groups),
            "n_links": spread(n_links),
            "groups_sha256": spread(digests, pa.string(), ""),
            "links": octets,
        }
    )


LINKED = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, links binary"


def links(df: DataFrame, path_a: str, path_b: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: doc_id, n_a, n_b, n_groups, n_links, groups_sha256, and ``links`` (a * radix + b per link, see ``Pair``)."""
    source = df.select(F.col(id_column).alias("doc_id"), F.coalesce(text_column, F.lit("")).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = Pair.load(path_a, path_b)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for first, last in chunks(texts, CHUNK):
                found = aligned(texts[first:last], pair)
                yield from found.add_column(0, "doc_id", batch.column("doc_id")[first:last]).combine_chunks().to_batches()

    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, {LINKED}")


def _coded(octets: pa.Array, code: np.dtype) -> tuple[np.ndarray, pa.Array]:
    """(links per row, all codes) of a column of links."""
    held = octets.drop_null()
    flat = np.frombuffer(b"".join(memoryview(x.as_buffer()) for x in held), code)
    return pc.binary_length(held).to_numpy(zero_copy_only=False) // code.itemsize, pa.array(flat)


def pair_counts(linked: DataFrame, code: np.dtype) -> DataFrame:
    """(code, n) over all rows: grouped by Arrow in the tasks, merged by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for first in range(0, len(batch), ROWS):
                own = pa.table({"code": _coded(batch.column("links")[first : first + ROWS], code)[1]})
                own = own.group_by("code").aggregate([([], "count_all")]).rename_columns({"count_all": "n"})
                both = own if held is None else pa.concat_tables([held, own])
                held = both.group_by("code").aggregate([("n", "sum")]).rename_columns({"n_sum": "n"})
        if held is not None:
            merged = pa.table({"code": held.column("code").cast(pa.int64()), "n": held.column("n")})
            yield from merged.combine_chunks().to_batches()

    return linked.select("links").mapInArrow(run, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n"))


def align(df: DataFrame, path_a: str, path_b: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A text that is null or empty, or that a tokenizer does not spell out byte
    for byte behind one space, has no tokens and zeros. ``n_best`` counts the
    links whose pair is the most frequent of its B id in all rows, ties
    included; ``count_sum`` adds up the counts of the pairs. Rows that repeat
    an id are rows of their own; other columns are dropped. The pairs that
    reach the driver are bounded by the two vocabularies, see ``Pair.bound``.
    """
    linked = stored(links(df, path_a, path_b, id_column, text_column), "links")
    pair = Pair.load(path_a, path_b)
    code, radix, bound = pair.code, pair.radix, pair.bound()
    table = pair_counts(linked, code).toArrow()
    if table.num_rows > bound:
        raise RuntimeError(f"{table.num_rows} id pairs, where {bound} are possible")
    table = table.append_column("b", pa.array(table.column("code").to_numpy() % radix))
    table = table.join(table.group_by("b").aggregate([("n", "max")]), "b")
    best = pc.equal(table.column("n"), table.column("n_max")).cast(pa.int64())
    sink = pa.BufferOutputStream()
    known = pa.table({"code": table.column("code"), "n": table.column("n"), "best": best})
    with pa.ipc.new_stream(sink, known.schema) as out:
        out.write_table(known)
    shared = df.sparkSession.sparkContext.broadcast(sink.getvalue().to_pybytes())
    kept = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    kind = linked.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.ipc.open_stream(shared.value).read_all()
        for batch in batches:
            for first in range(0, len(batch), ROWS):
                part = batch.slice(first, ROWS)
                sizes, codes = _coded(part.column("links"), code)
                held = pa.table({"row": np.repeat(np.arange(len(part)), sizes), "code": codes.cast(pa.int64())})
                own = held.group_by(["row", "code"]).aggregate([([], "count_all")]).join(known, "code")
                rows, times = own.column("row").to_numpy(), own.column("count_all").to_numpy()
                sums = [np.zeros(len(part), np.int64) for _ in range(2)]
                for total, name in zip(sums, ("best", "n"), strict=True):
                    np.add.at(total, rows, times * own.column(name).to_numpy())
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], *map(pa.array, sums)], [*kept, "n_best", "count_sum"])

    schema = f"doc_id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, n_best bigint, count_sum bigint"
    return linked.select(*kept, "links").mapInArrow(run, schema)
