"""WARC archives: a writer that stores equal payloads once, and a splittable reader.

Writing. Every row becomes one gzip member, so that readers can begin at any record. Of rows with equal payloads of at
least `least` bytes the one with the largest id is a response; the others are revisits that refer to it and hold the
HTTP header only, whose Content-Length is the full payload's. Spark's own text writer puts the members into files, so
the commit protocol guards against lost or repeated tasks and any file system that Spark knows will do: a member ends
in the top byte of its length, which is zero below 16 MiB (longer members are followed by an empty one), and that zero
byte is the writer's line separator.

Reading. Spark's text reader splits files into byte ranges and looks for the gzip magic as its line separator: each task
gets what begins in its range, and reads on past the range's end to the next magic. The magic can also occur by chance
inside compressed data. So a piece is only a candidate: it must decode, to its checksum, and hold a WARC header; a
member that is cut by a chance magic is continued with the next piece. What begins in one range and is cut by a chance
magic in the next is put together afterwards, by file; that is next to nothing.

Archives are files called *.warc.gz, the standard name. Spark would decompress such a file as a whole before it looks
for lines, as codecs go by suffix; the reader's own options switch that off for this read, so ranges hold the raw bytes.

Null payloads count as empty; payloads may be as long as a cell can be. A null id matches no other row's; such rows are responses unless an equal payload has an id.
Rows repeated with the largest id are all responses. Further columns of pages are not read. An empty table gives no record. What cannot be decoded comes back as a record of type `corrupt`.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.llm.common import small_batches

MAGIC = b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FIELDS = "record_type string, record_id string, target_uri string, refers_to string, payload_bytes long, payload_digest string, payload binary"
_KINDS = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
_FLUSH = 4 << 20


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _member(headers: list[tuple[str, str]], block: bytes) -> bytes:
    clean = "".join(f"{k}: {re.sub(r'[\r\n]+', ' ', v)}\r\n" for k, v in headers)
    data = b"WARC/1.1\r\n" + clean.encode() + f"Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"
    out = gzip.compress(data, 5, mtime=0)
    return out if out.endswith(b"\0") else out + gzip.compress(b"", 5, mtime=0)


def write_warc(pages: DataFrame, path: str, key: str = "page_id", uri: str = "url", payload: str = "html", least: int = 0, date: str = "2000-01-01T00:00:00Z") -> None:
    """Write a record for every row under `path`, into files called *.warc.gz."""
    small_batches(pages.sparkSession)
    rows = pages.select(F.col(f"`{key}`").cast("string").alias("_key"), F.col(f"`{uri}`").cast("string").alias("_uri"), F.coalesce(F.col(f"`{payload}`").cast("binary"), F.lit(b"")).alias("_payload"), F.col(f"`{key}`").alias("_order"))
    rows = rows.withColumn("_same", F.sha1("_payload"))
    kept = rows.groupBy(F.col("_same").alias("_of")).agg(F.max("_order").cast("string").alias("_kept"))
    rows = rows.join(kept, F.col("_same") == F.col("_of")).select("_key", "_uri", "_payload", F.when(F.octet_length("_payload") >= least, F.col("_kept")).alias("_kept"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, first = [], 0, True
        for batch in batches:
            for name, target, body, kept in zip(*(c.to_pylist() for c in batch.columns)):
                if first:
                    held.append(_member([("WARC-Type", "warcinfo"), ("WARC-Date", date), ("WARC-Record-ID", "<urn:x-part:info>"), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")[:-1])
                    first = False
                revisit = kept is not None and kept != name
                http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode()
                headers = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<urn:x-page:{'' if name is None else name}>"), ("WARC-Date", date), ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha1:{base32_sha1(body)}")]
                headers += [("WARC-Target-URI", target)] if target is not None else []
                headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:x-page:{kept}>")] if revisit else []
                held.append(_member(headers, http if revisit else http + body)[:-1])
                size += len(held[-1])
                if size > _FLUSH:
                    yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], ["value"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], ["value"])

    members = rows.mapInArrow(run, "value binary")
    members.select(F.col("value").cast("string")).write.option("lineSep", "\0").option("compression", "none").text(path)
    at = pages.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(pages.sparkSession.sparkContext._jsc.hadoopConfiguration())
    for file in fs.globStatus(at.suffix("/part-*.txt")) or []:  # names only, one for each task
        fs.rename(file.getPath(), at.suffix("/" + file.getPath().getName().removesuffix(".txt") + ".warc.gz"))


class _Broken(Exception):
    pass


def _parse(data: bytes) -> tuple:
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(fields.get("content-length", 0))]
    kind, digest, size, body = fields.get("warc-type"), fields.get("warc-payload-digest", "").removeprefix("sha1:") or None, None, None
    if fields.get("content-type", "").startswith("application/http"):
        http, _, body = block.partition(b"\r\n\r\n")
        if kind == "revisit":
            found, body = re.search(rb"(?im)^content-length:\s*(\d+)", http), None
            size = int(found[1]) if found else None
        else:
            size, digest = len(body), base32_sha1(body)
    bare = lambda x: x[1:-1] if x and x[0] == "<" else x
    return kind, bare(fields.get("warc-record-id")), fields.get("warc-target-uri"), bare(fields.get("warc-refers-to")), size, digest, body


class Members:
    """Takes the pieces between magics in order; gives the contents of whole members, and the pieces that are of none."""

    def __init__(self) -> None:
        self.pieces: list[bytes] = []

    def _try(self) -> bytes | None:
        """The content of the member that all pieces make; None if it goes on. Raises _Broken if they make none."""
        decoder, out = zlib.decompressobj(31), []
        try:
            for i, piece in enumerate(self.pieces):
                if i == 0 and (len(piece) < 7 or piece[0] & 0xE0):
                    raise _Broken
                out.append(decoder.decompress(MAGIC + piece))
                if decoder.eof and (decoder.unused_data or i + 1 < len(self.pieces)):
                    raise _Broken
                if i == 0 and out[0] and not b"WARC/".startswith(out[0][:5]):
                    raise _Broken
        except zlib.error as e:
            raise _Broken from e
        return b"".join(out) if decoder.eof else None

    def feed(self, piece: bytes) -> Iterator[tuple[bool, bytes]]:
        """(True, content) or (False, piece of no member that begins here)."""
        todo = [piece]
        while todo:
            self.pieces.append(todo.pop(0))
            try:
                if (content := self._try()) is not None:
                    self.pieces = []
                    yield True, content
            except _Broken:
                todo = self.pieces[1:] + todo
                yield False, self.pieces[0]
                self.pieces = []


def _records(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), _KINDS)], [f.split()[0] for f in FIELDS.split(", ")])


def raw_options(spark: SparkSession) -> dict[str, str]:
    """Options of a reader that takes *.gz for plain bytes.

    Hadoop looks for a file's codec among the known suffixes, all reversed and in order: the last one before the reversed
    name is the file's, if the name begins with it. A codec of a suffix that no file has, but that stands between ".gz" and
    every name that ends so, leaves such names without a codec."""
    codec = spark.sparkContext._jvm.org.apache.hadoop.io.compress.PassthroughCodec
    return {"io.compression.codecs": codec.CLASSNAME, codec.OPT_EXTENSION: ".\x01.gz"}


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """All records but warcinfo: record_type, record_id, target_uri, refers_to, payload_bytes, payload_digest, payload.

    Length and digest of a response are those of the payload read; of a revisit, those that it states."""
    small_batches(spark)
    found = spark.read.options(**raw_options(spark)).option("lineSep", MAGIC.decode("latin-1")).option("encoding", "ISO-8859-1").text(path)
    pieces = found.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.col("value").cast("binary").alias("piece"))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """(True, content) for members; (False, file, at, number, piece, whether it opens a member cut by the range's end)."""
        where, members, number = None, Members(), 0
        for batch in batches:
            for file, at, piece in zip(*(c.to_pylist() for c in batch.columns)):
                if where != (file, at):
                    if where:
                        for i, x in enumerate(members.pieces):
                            yield False, *where, number + i, x, i == 0
                    where, members, number = (file, at), Members(), 0
                    if at == 0:  # what stands before the first magic
                        continue
                for whole, x in members.feed(piece):
                    number += 1
                    yield (True, x) if whole else (False, file, at, number, x, False)
                number += 1
        if where:
            for i, x in enumerate(members.pieces):
                yield False, *where, number + i, x, i == 0

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for got in walk(batches):
            if got[0] and got[1]:
                row = _parse(got[1])
                if row[0] != "warcinfo":
                    held.append(row)
                    size += len(got[1])
            if size > _FLUSH:
                yield _records(held)
                held, size = [], 0
        if held:
            yield _records(held)

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in walk(batches):
            if not got[0]:
                yield pa.RecordBatch.from_arrays([pa.array([x]) for x in got[1:]], ["file", "at", "number", "piece", "opens"])

    def stitch(table: pa.Table) -> pa.Table:
        table = table.sort_by([("at", "ascending"), ("number", "ascending")])
        rows, members = [], Members()
        for piece in table.column("piece").to_pylist():
            for ok, x in members.feed(piece):
                rows.append(_parse(x) if ok else ("corrupt", None, None, None, None, None, x))
        rows += [("corrupt", None, None, None, None, None, x) for x in members.pieces]
        rows = [r for r in rows if r[0] != "warcinfo"]
        return pa.Table.from_batches([_records(rows)]) if rows else pa.Table.from_batches([], _records([(None,) * 7]).schema)

    leftover = pieces.mapInArrow(rest, "file string, at long, number long, piece binary, opens boolean")
    return pieces.mapInArrow(whole, FIELDS).unionByName(leftover.groupBy("file").applyInArrow(stitch, FIELDS))
