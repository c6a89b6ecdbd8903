"""WARC archives: write pages, normalise monolithic gzip to one member a record with an offset index, and read back.

* `write_archives` writes a record per page; each task writes files that are one gzip stream (rolled at `roll` bytes of records).
  Equal payloads: the smallest page id is a response, the others revisit it.
* `normalise` inflates each file's stream once, as it is read, and rewrites every record as a gzip member of its own, with a
  sidecar (`<file>.idx`, lines of record id, offset, length) beside the new file. A task holds one record, whatever the file's size.
* `read_archives` reads records through the sidecars, inflating each member alone, and checks payloads against their digests.

Files lie in the shared folder, written through its own file system; a task's files carry its attempt number, and only
those that a successful task reported are read on, so a lost executor leaves nothing behind that counts.

Edge cases: a null html is the empty payload; page ids of any text come back as they were, null apart from empty; in a group of equal payloads null
ids revisit the smallest id, and if it is repeated, or all ids are null, each of those rows is a response; null urls are
empty; an empty table writes no records. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from itertools import batched
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import materialize, new_folder

ROLL, LEVEL, PIECE = 32_000_000, 6, 1 << 20
SALTS = 16
GZIP = 31  # zlib's window bits for gzip
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _clean(value: str) -> str:
    return value.replace("\r", "%0D").replace("\n", "%0A")


def _urn(page: str | None) -> str:
    """A page id as a header's value: whatever it holds, it comes back as it was, and null is apart from empty."""
    return "<urn:nopage>" if page is None else f"<urn:page:{quote(page, safe='')}>"


def _page(urn: str | None) -> str | None:
    return unquote(urn[len("<urn:page:") : -1]) if urn and urn.startswith("<urn:page:") else None


def record(page: str | None, url: str, payload: bytes, refers_to: str | None) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (b"" if refers_to is not None else payload)
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_urn(page)}", "WARC-Date: 2020-01-01T00:00:00Z",
            f"WARC-Target-URI: {_clean(url)}", f"WARC-Payload-Digest: sha1:{_digest(payload)}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: {_urn(refers_to)}", f"WARC-Profile: {REVISIT}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def headers(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}


def inflate(source, piece: int = PIECE) -> Iterator[bytes]:
    """The content of a gzip file in pieces, whether it has one member or several; source: anything with read(size)."""
    stream, data = None, b""
    while True:
        if not data:
            data = source.read(piece)
        if not data:
            break
        if stream is None or stream.eof:
            stream = zlib.decompressobj(GZIP)
        part = stream.decompress(data, piece)
        data = stream.unused_data if stream.eof else stream.unconsumed_tail
        if part:
            yield part
    if stream is not None and not stream.eof:
        raise ValueError("the gzip stream ends too early")


def split_records(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records, as they stand in the stream."""
    held, need, size = bytearray(), 0, None
    for part in pieces:
        held += part
        while len(held) >= need:
            if size is None:
                at = held.find(b"\r\n\r\n")
                if at < 0:
                    break
                size = at + 8 + int(headers(bytes(held[:at]))["content-length"])
                need = size
            else:
                yield bytes(held[:size])
                del held[:size]
                need, size = 0, None
                if not held:
                    break
    if held:
        raise ValueError("the last record is cut off")


class _File:
    """A file of the shared folder's own file system, visible under its name only when whole."""

    def __init__(self, folder: str, name: str):
        from pyarrow import fs

        self.system, base = fs.FileSystem.from_uri(folder)
        self.system.create_dir(base, recursive=True)
        self.path, self.size = f"{base}/{name}", 0
        self.out = self.system.open_output_stream(f"{self.path}.part", compression=None)

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def close(self) -> None:
        self.out.close()
        self.system.move(f"{self.path}.part", self.path)


_REPORT = pa.schema([("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])
_REPORTED = "file string, records long, bytes long"


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", html_col: str = "html", url_col: str = "url", min_bytes: int = 0, roll: int = ROLL, level: int = LEVEL) -> DataFrame:
    """Writes the records; returns a row per file: file, records, bytes."""
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    url = F.coalesce(F.col(url_col).cast("string"), F.lit("")) if url_col in pages.columns else F.lit("")
    base = pages.select(F.col(id_col).alias("_id"), url.alias("_url"), html.alias("_html"), F.sha2(F.encode(html, "UTF-8"), 256).alias("_sha"))
    groups = base.where(F.octet_length("_html") >= min_bytes).groupBy("_sha").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    # Rows of one payload meet their group in SALTS places, so a page that fills a third of the table doesn't fill a task.
    dealt = groups.select("_sha", "_first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    marked = base.withColumn("_salt", F.pmod(F.xxhash64("_id", "_url"), F.lit(SALTS)).cast("int")).join(dealt, ["_sha", "_salt"], "left")
    refers = F.when(F.col("_first").isNotNull() & ~F.col("_id").eqNullSafe(F.col("_first")), F.col("_first").cast("string"))
    rows = marked.select(F.col("_id").cast("string").alias("_id"), "_url", "_html", refers.alias("_refers"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, done, file, raw, n = TaskContext.get(), [], None, 0, 0
        name, stream = "", None

        def end() -> None:
            file.write(stream.flush())
            file.close()
            done.append((name, n, file.size))

        for batch in batches:
            for page, link, text, to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if file is None:
                    name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{len(done):05d}.warc.gz"
                    file, stream, raw, n = _File(folder, name), zlib.compressobj(level, zlib.DEFLATED, GZIP), 0, 0
                data = record(page, link, text.encode(), to)
                file.write(stream.compress(data))
                raw, n = raw + len(data), n + 1
                if raw >= roll:
                    end()
                    file = None
        if file is not None:
            end()
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], f.type) for i, f in enumerate(_REPORT)], schema=_REPORT)

    return materialize(rows.mapInArrow(write, _REPORTED), "warc-written")


def _dealt(report: DataFrame) -> DataFrame:
    """The reported names, a file to a task."""
    return report.select("file").repartitionByRange(max(1, report.count()), "file")


def normalise(spark: SparkSession, folder: str, report: DataFrame, target: str, level: int = LEVEL) -> DataFrame:
    """Rewrites the reported files of folder into target; returns a row per new file."""

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        attempt, (system, base) = TaskContext.get().taskAttemptId(), fs.FileSystem.from_uri(folder)
        for batch in batches:
            done = []
            for old in batch.column("file").to_pylist():
                name = f"{old.removesuffix('.warc.gz')}-{attempt}.warc.gz"
                file, sidecar, n = _File(target, name), _File(target, f"{name}.idx"), 0
                with system.open_input_stream(f"{base}/{old}", compression=None) as source:
                    for data in split_records(inflate(source)):
                        stream = zlib.compressobj(level, zlib.DEFLATED, GZIP)
                        member = stream.compress(data) + stream.flush()
                        sidecar.write(f"{headers(data[: data.find(b'\r\n\r\n')])['warc-record-id']}\t{file.size}\t{len(member)}\n".encode())
                        file.write(member)
                        n += 1
                sidecar.close()
                file.close()
                done.append((name, n, file.size))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], f.type) for i, f in enumerate(_REPORT)], schema=_REPORT)

    return materialize(_dealt(report).mapInArrow(rewrite, _REPORTED), "warc-normalised")


def _index(system, path: str) -> Iterator[tuple[int, int]]:
    """Offsets and lengths of a sidecar, line by line."""
    with system.open_input_stream(path, compression=None) as source:
        rest = b""
        while data := source.read(PIECE):
            *lines, rest = (rest + data).split(b"\n")
            for line in lines:
                _, offset, length = line.rsplit(b"\t", 2)
                yield int(offset), int(length)


def read_archives(spark: SparkSession, folder: str, report: DataFrame) -> DataFrame:
    """A row per record: page_id (string), payload_bytes, payload_digest, record_type, refers_to (string), url, file, offset."""
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "file", "offset"]
    kinds = [pa.string(), pa.int64(), *[pa.string()] * 5, pa.int64()]

    def records(system, base: str, name: str) -> Iterator[tuple]:
        with system.open_input_file(f"{base}/{name}") as archive:
            for offset, length in _index(system, f"{base}/{name}.idx"):
                archive.seek(offset)
                whole = zlib.decompress(archive.read(length), GZIP)
                at = whole.find(b"\r\n\r\n")
                h, block = headers(whole[:at]), whole[at + 4 : -4]
                http, _, payload = block.partition(b"\r\n\r\n")
                digest, kind, size = h["warc-payload-digest"].removeprefix("sha1:"), h["warc-type"], int(headers(http)["content-length"])
                if kind == "response" and (len(payload) != size or _digest(payload) != digest):
                    raise ValueError(f"{name}: the payload of {h['warc-record-id']} does not match its record")
                page, to = _page(h.get("warc-record-id")), _page(h.get("warc-refers-to"))
                yield page, size, digest, kind, to, h.get("warc-target-uri", ""), name, offset

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch.column("file").to_pylist():
                for some in batched(records(system, base, name), 4096):
                    yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in some], k) for i, k in enumerate(kinds)], names=names)

    schema = "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string, url string, file string, offset long"
    return _dealt(report).mapInArrow(read, schema)


def round_trip(pages: DataFrame, id_col: str = "page_id", **options) -> DataFrame:
    """Writes, normalises and reads back: page id, payload_bytes, payload_digest, record_type, refers_to."""
    spark, kind = pages.sparkSession, pages.schema[id_col].dataType
    whole, own = new_folder(spark, "warc-whole"), new_folder(spark, "warc")
    written = write_archives(pages, whole, id_col, **options)
    read = read_archives(spark, own, normalise(spark, whole, written, own))
    return read.select(F.col("page_id").cast(kind).alias(id_col), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))
