"""WARC archives from tables and back: range-sorted, rolled by compressed size, committed by manifest."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from complyframe.llm.files import Folder
from complyframe.llm.shared import shared_folder, stored

#: Smallest payload, in bytes, that a later record may revisit.
LEAST_REVISITED = 1000
#: Compressed bytes after which a file is closed, and payload bytes per task.
#: Groups of equal payloads that may go to every executor: some 100 MB there.
BROADCAST = 500_000
ROLL, TASK = 64 << 20, 32 << 20
#: The tables carry no capture time; a fixed one keeps archives identical between runs.
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_MANIFEST = "file string, records bigint, bytes bigint, sha256 string"


def classified(df: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """page_id, url, payload, refers_to (null: a response), and ``copy`` of rows that repeat an id.

    Of equal payloads of at least ``LEAST_REVISITED`` bytes the one with the
    largest id is the response. Payloads are compared by SHA-256 and length.
    The join has one row per payload on one side; Spark can split a hot one.
    """
    payload = F.coalesce(F.col(html_column), F.lit("")).cast("binary")
    rows = df.select(F.col(id_column).alias("page_id"), F.col(url_column).alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"_sha": F.sha2("payload", 256), "_size": F.octet_length("payload")})
    keyed = rows.where(F.col("_size") >= LEAST_REVISITED)
    latest = keyed.groupBy("_sha", "_size").agg(F.max("page_id").alias("_latest"), F.count(F.lit(1)).alias("_n"))
    latest = latest.where("_n > 1").drop("_n")
    latest = stored(latest, "latest")
    # Only ids and digests go to every task, where they are few; payloads then stay where they are.
    joined = rows.join(F.broadcast(latest) if latest.count() <= BROADCAST else latest, ["_sha", "_size"], "left")
    refers = F.when(F.col("page_id") != F.col("_latest"), F.col("_latest"))
    # A row that repeats the response's id revisits nothing: it is the same capture.
    return joined.select("page_id", "url", "payload", refers.alias("refers_to"))


def _text(value: str) -> str:
    """A header value without line breaks, other controls or blanks."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def _id(page_id: object) -> str:
    """An id as a URN that gives it back: blanks, controls, percent signs and angle brackets are escaped."""
    return "<urn:page:" + re.sub(r"[\x00-\x20\x7f%<>]", lambda m: f"%{ord(m[0]):02X}", str(page_id)) + ">"


def _id_of(value: str | None) -> str | None:
    found = re.fullmatch(r"<urn:page:(.*)>", value or "")
    return found and re.sub(r"%([0-9A-F]{2})", lambda m: chr(int(m[1], 16)), found[1])


def record(page_id: object, url: str | None, payload: bytes, refers_to: object) -> bytes:
    """One WARC record; headers, lengths and digests are made from the row alone."""
    digest = hashlib.sha1(payload).hexdigest()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_id(page_id) if page_id is not None else f'<urn:sha1:{digest}>'}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{hashlib.sha1(block).hexdigest()}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.insert(3, f"WARC-Target-URI: {_text(url)}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: {_id(refers_to)}", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join([*head, "", ""]).encode() + block + b"\r\n\r\n"


def member(content: bytes) -> bytes:
    """A gzip member with no time in its header."""
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(content) + packer.flush()


def write(classes: DataFrame, uri: str, roll: int = ROLL, task_bytes: int = TASK) -> DataFrame:
    """Write archives under ``uri``; gives the manifest (file, records, bytes, sha256), as committed.

    Rows are dealt by ranges of the id and sorted, so the same table gives the
    same records in the same order. A task writes each file under a temporary
    name and renames it when it is whole; a task that runs again writes the
    same bytes under the same name. Only files in the manifest, a table that
    appears at the end, belong to the archive.
    """
    spark = classes.sparkSession
    total = classes.agg(F.sum(F.octet_length("payload"))).first()[0] or 0
    tasks = max(1, -(-total // task_bytes))
    rows = classes.withColumn("_order", F.xxhash64("url", "payload"))
    rows = rows.repartitionByRange(tasks, "page_id").sortWithinPartitions("page_id", "_order").drop("_order")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder, part = Folder(uri), TaskContext.get().partitionId()
        done: list[tuple[str, int, int, str]] = []
        members: list[bytes] = []
        size = 0

        def close() -> None:
            name, content = f"part-{part:06d}-{len(done):05d}.warc.gz", b"".join(members)
            folder.write(name, content)
            done.append((name, len(members), len(content), hashlib.sha256(content).hexdigest()))
            members.clear()

        for batch in batches:
            for page_id, url, payload, refers_to in zip(*[batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "refers_to")], strict=True):
                members.append(member(record(page_id, url, payload, refers_to)))
                size += len(members[-1])
                if size >= roll:
                    close()
                    size = 0
        if members:
            close()
        columns = zip(*done, strict=True) if done else ([], [], [], [])
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(x), kind) for x, kind in zip(columns, kinds, strict=True)], ["file", "records", "bytes", "sha256"]
        )

    rows.mapInArrow(run, _MANIFEST).write.mode("overwrite").parquet(f"{uri}/manifest")
    return spark.read.schema(_MANIFEST).parquet(f"{uri}/manifest")


class Checked:
    """A binary stream that counts and digests what is read from it."""

    def __init__(self, stream):
        self.stream, self.size, self.digest = stream, 0, hashlib.sha256()

    def read(self, n: int) -> bytes:
        part = self.stream.read(n)
        self.size += len(part)
        self.digest.update(part)
        return part


def unpacked(stream) -> Iterator[bytes]:
    """The content of all gzip members of a binary stream, in parts."""
    rest, unpacker = b"", None
    while rest or (rest := stream.read(1 << 20)):
        unpacker = unpacker or zlib.decompressobj(31)
        part = unpacker.decompress(rest)
        rest = unpacker.unused_data
        if unpacker.eof:
            unpacker = None
        if part:
            yield part
    if unpacker:
        raise ValueError("archive ends inside a member")


def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record, by its Content-Length, however records are dealt over gzip members."""
    parts, held = unpacked(stream), bytearray()

    def more() -> bool:
        part = next(parts, b"")
        held.extend(part)
        return bool(part)

    while held or more():
        searched = 0
        while (end := held.find(b"\r\n\r\n", searched)) < 0:
            searched = max(0, len(held) - 3)
            if not more():
                raise ValueError("archive ends inside a header")
        lines = held[:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("no record where one should begin")
        headers = dict(line.split(": ", 1) for line in lines[1:])
        first, size = end + 4, int(headers["Content-Length"])
        while len(held) < first + size + 4:
            if not more():
                raise ValueError("archive ends inside a record")
        if held[first + size : first + size + 4] != b"\r\n\r\n":
            raise ValueError("no end where a record should end")
        yield headers, bytes(held[first : first + size])
        del held[: first + size + 4]


def _row(headers: dict[str, str], block: bytes) -> tuple:
    """A record's columns, its digests checked."""
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
    length = int(re.search(rb"Content-Length: (\d+)", http)[1])
    kind = headers["WARC-Type"]
    if hashlib.sha1(block).hexdigest() != headers["WARC-Block-Digest"].removeprefix("sha1:"):
        raise ValueError(f"block of {headers['WARC-Record-ID']}")
    if kind == "response" and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != length):
        raise ValueError(f"payload of {headers['WARC-Record-ID']}")
    return _id_of(headers["WARC-Record-ID"]), headers.get("WARC-Target-URI"), kind, _id_of(headers.get("WARC-Refers-To")), length, digest


def read(spark: SparkSession, uri: str) -> DataFrame:
    """Per record: page_id and refers_to as text, url, record_type, payload_bytes, payload_digest.

    Reads every record of the files in the manifest, checks each block's
    digest, for responses the payload's, and per file the number of records,
    bytes and SHA-256 that the manifest gives; what does not agree raises an
    error. A record without a page has a null id. A revisit's
    length is that of its HTTP header, as it has no payload of its own.
    """
    manifest = spark.read.schema(_MANIFEST).parquet(f"{uri}/manifest")
    schema = "page_id string, url string, record_type string, refers_to string, payload_bytes bigint, payload_digest string"

    names, kinds = [f.split()[0] for f in schema.split(", ")], [*[pa.string()] * 4, pa.int64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder = Folder(uri)
        for batch in batches:
            for name, count, size, digest in zip(*[batch.column(c).to_pylist() for c in ("file", "records", "bytes", "sha256")], strict=True):
                try:
                    with folder.system.open_input_stream(f"{folder.path}/{name}", compression=None) as stream:
                        checked = Checked(stream)
                        rows = [_row(*found) for found in records(checked)]
                except (ValueError, KeyError, TypeError, zlib.error) as error:
                    raise ValueError(f"damaged file {name}: {error}") from error
                if (len(rows), checked.size, checked.digest.hexdigest()) != (count, size, digest):
                    raise ValueError(f"damaged file {name}: not what its manifest says")
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(columns, kinds, strict=True)], names)

    # One file a task, as far as the hash deals them so.
    return manifest.repartition(max(1, manifest.count()), "file").mapInArrow(run, schema)


def round_trip(df: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """Write an archive of all rows and read it back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    A null html is an empty payload, a null url leaves the header out, a null
    id is read back as null; ids may be any text. Rows that repeat an id are records of their
    own; among equal payloads those with the largest id are responses. Other
    columns are dropped.
    """
    uri = f"{shared_folder(df.sparkSession)}/warc"
    classes = stored(classified(df, id_column, url_column, html_column), "classes")
    write(classes, uri)
    kind = df.schema[id_column].dataType

    return read(df.sparkSession, uri).select(
        F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to")
    )
