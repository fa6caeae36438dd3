"""WARC archives: written one gzip member a record, read back in splits.

A reading task gets a byte range of an archive. It looks for gzip magic, takes a candidate for a record
only if its decoded head is a WARC header, and owns the records that start inside its range; the last
one may end beyond it. Members are decoded piece by piece, so a task holds one piece and not a payload.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldcheck.llm.common import query, scratch, table, written

MAGIC = b"\x1f\x8b\x08"
#: Payloads of this many bytes or more are written once; later equal ones refer to the first.
LEAST_REVISIT = 100
ARCHIVE_BYTES, RANGE_BYTES, PIECE = 64 << 20, 4 << 20, 256 << 10
#: How a record begins, whatever the length of its header.
VERSION = b"WARC/1."
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (fs.LocalFileSystem(), path)


# --- writing ------------------------------------------------------------------------------------


def record(row: dict[str, Any]) -> bytes:
    """One record as a gzip member: a response with its payload, or a revisit with the head only."""
    payload = (row["html"] or "").encode()
    revisit = row["revisit"]
    page, first = _text(row["page_id"]), _text(row["refers_to"])
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    fields = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page}')}>",
        "WARC-Date": DATE,
        "WARC-Page-ID": page,
        "WARC-Target-URI": None if row["url"] is None else " ".join(row["url"].split()),
        "WARC-Payload-Digest": f"sha256:{row['digest']}",
        "WARC-Profile": PROFILE if revisit else None,
        "WARC-Refers-To": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{first}')}>" if revisit else None,
        "WARC-Refers-To-Page-ID": first if revisit else None,
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None) + "\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(head.encode()) + packer.compress(block) + packer.compress(b"\r\n\r\n") + packer.flush()


def _text(x: Any) -> str | None:
    return None if x is None else str(x)


def with_originals(pages: DataFrame) -> DataFrame:
    """page_id, url, html, digest, revisit, refers_to: what each page is to be written as.

    Of equal payloads of LEAST_REVISIT bytes or more the page with the smallest id is the response; rows
    that repeat that id are responses too. Pages without id refer to it; if none has an id, all are
    responses. Only ids and digests are compared; the texts go through one shuffle, by id and digest. Page ids
    are whole numbers; others are refused.
    """
    kind = pages.schema["page_id"].dataType.simpleString()
    if kind not in ("bigint", "int", "smallint", "tinyint"):
        raise ValueError(f"page_id must be a whole number, not {kind}")
    body = F.coalesce("html", F.lit(""))
    known = pages.select("page_id", "url", "html", F.sha2(body, 256).alias("digest"))
    sized = pages.select("page_id", F.sha2(body, 256).alias("digest"), F.octet_length(body).alias("bytes"))
    firsts = (
        sized.filter(F.col("bytes") >= LEAST_REVISIT)
        .groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("rows"))
        .filter("rows > 1 AND first IS NOT NULL").select("digest", "first")
    )
    copies = (
        sized.select("page_id", "digest").join(firsts, "digest")
        .filter("page_id IS NULL OR page_id <> first").distinct()
    )
    same = F.expr("p.digest = c.digest AND p.page_id <=> c.page_id")
    joined = known.alias("p").join(copies.hint("shuffle_hash").alias("c"), same, "left")
    return joined.select("p.*", F.col("c.first").isNotNull().alias("revisit"), F.col("c.first").alias("refers_to"))


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes records of `with_originals` rows into archives under folder; returns path and bytes of each.

    A task's archives have names of their own, and only those of finished tasks are in the returned table:
    what a lost task left behind is never read.
    """
    system, inner = _opened(folder)
    system.create_dir(inner, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, inner = _opened(folder)
        out, name, size = None, "", 0
        done: list[tuple[str, int]] = []
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    name, size = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = system.open_output_stream(f"{inner}/{name}", compression=None)
                data = record(row)
                out.write(data)
                size += len(data)
                if size >= ARCHIVE_BYTES:
                    out.close()
                    out = None
                    done.append((f"{folder}/{name}", size))
        if out is not None:
            out.close()
            done.append((f"{folder}/{name}", size))
        if done:
            yield pa.RecordBatch.from_arrays(
                [pa.array([p for p, _ in done]), pa.array([n for _, n in done], pa.int64())], ["path", "bytes"]
            )

    return written(pages.mapInArrow(run, "path string, bytes bigint"), "archives")


# --- reading ------------------------------------------------------------------------------------


class _Member:
    """Decodes the gzip member that starts at an offset, piece by piece."""

    def __init__(self, file, start: int) -> None:
        self.file, self.at = file, start
        self.unpack = zlib.decompressobj(31)

    def read(self, most: int = PIECE) -> bytes:
        """The next decoded bytes, `most` at a time; empty at the member's end."""
        while not self.unpack.eof:
            waiting = self.unpack.unconsumed_tail
            if not waiting:
                self.file.seek(self.at)
                waiting = self.file.read(PIECE if most >= PIECE else 1024)
                if not waiting:
                    raise zlib.error("the file ends inside a member")
                self.at += len(waiting)
            if data := self.unpack.decompress(waiting, most):
                return data
        return b""

    @property
    def end(self) -> int:
        return self.at - len(self.unpack.unused_data)


def _header(member: _Member) -> tuple[dict[str, str], bytes] | None:
    """Fields of a WARC header and the bytes read beyond it; None if the candidate is no record.

    A candidate that begins as a record does but cannot be decoded is a damaged record, and an error.
    """
    data = b""
    try:
        while len(data) < len(VERSION):
            more = member.read(4)
            data += more
            if not more or not data.startswith(VERSION[: len(data)]):
                return None
    except zlib.error:
        return None
    held, tail = [data], data
    while b"\r\n\r\n" not in tail:
        more = member.read(1024)
        if not more:
            raise ValueError("a record ends inside its header")
        held.append(more)
        tail = tail[-3:] + more
    head, _, rest = b"".join(held).partition(b"\r\n\r\n")
    fields = {}
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.decode("utf-8", "replace").partition(":")
        fields[name.strip().lower()] = value.strip()
    if "warc-type" not in fields or not fields.get("content-length", "").isdigit():
        raise ValueError("a record's header lacks its type or length")
    return fields, rest


def read_range(path: str, lo: int, hi: int, size: int, payloads: bool = False) -> Iterator[dict[str, Any]]:
    """The records of an archive of `size` bytes that start in lo:hi.

    Only the first one is searched for; an archive begins with a record, and each further one has to begin just
    where the last one ends, up to the archive's end. Whoever reads a range's last record also decodes the
    header behind it, which starts in a later range: so no damaged record is passed over as a false candidate.
    """
    system, inner = _opened(path)
    with system.open_input_file(inner) as file:
        at, found = lo, None
        while found is None:
            if (at := _next_magic(file, at, hi)) is None:
                if lo == 0 < size:
                    raise ValueError(f"{path} does not begin with a record")
                return
            member = _Member(file, at)
            if (found := _header(member)) is None:
                at += 1
            if lo == 0 and (at > 0):
                raise ValueError(f"{path} does not begin with a record")
        while at < hi:
            yield _record(*found, member, at, payloads)
            at = member.end
            if at >= size:
                break
            member = _Member(file, at)
            if (found := _header(member)) is None:
                raise ValueError(f"no record begins at {at} of {path}, where the last one ends")


def _next_magic(file, at: int, hi: int) -> int | None:
    """The first place of gzip magic in at:hi, or None; magic may reach beyond hi."""
    while at < hi:
        file.seek(at)
        data = file.read(min(PIECE, hi - at) + len(MAGIC) - 1)
        if (i := data.find(MAGIC)) >= 0:
            return at + i
        at += PIECE
    return None


def _record(fields: dict[str, str], rest: bytes, member: _Member, offset: int, payloads: bool) -> dict[str, Any]:
    left = int(fields["content-length"])
    head, digest, size, kept = b"", hashlib.sha256(), 0, []
    http: bytes | None = None
    data = rest
    while True:
        data, left = data[:left], left - len(data[:left])
        if http is None:
            head += data
            if b"\r\n\r\n" in head:
                http, _, data = head.partition(b"\r\n\r\n")
            else:
                data = b""
        if data:
            digest.update(data)
            size += len(data)
            if payloads:
                kept.append(data)
        data = member.read()
        if not data:
            break
    if left:
        raise ValueError(f"the record at {offset} is shorter than its header says")
    declared = fields.get("warc-payload-digest", "").removeprefix("sha256:")
    revisit = fields["warc-type"] == "revisit"
    if revisit:
        size = next(int(x.split(b":")[1]) for x in (http or b"").split(b"\r\n") if x.lower().startswith(b"content-length:"))
    elif declared != digest.hexdigest():
        raise ValueError(f"the payload at {offset} is not the one that was written")
    page, first = fields.get("warc-page-id"), fields.get("warc-refers-to-page-id")
    return {
        "page_id": None if page is None else int(page),
        "url": fields.get("warc-target-uri"),
        "record_type": fields["warc-type"],
        "refers_to": None if first is None else int(first),
        "payload_bytes": size,
        "payload_digest": declared,
        "offset": offset,
        "payload": b"".join(kept) if payloads and not revisit else None,
    }


RECORD = (
    "page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, "
    "offset bigint, payload binary"
)


def read_archives(archives: DataFrame, range_bytes: int = RANGE_BYTES, payloads: bool = False) -> DataFrame:
    """All records of the archives (path, bytes), read in ranges of range_bytes.

    The digest of each response is checked against its payload; a damaged record, head or magic ends the job. A
    revisit's size and digest are those of the payload it stands for. Empty archives have no records.
    """
    last = F.greatest(F.floor((F.col("bytes") - 1) / range_bytes), F.lit(0))
    ranges = archives.filter("bytes > 0").select(
        "path", "bytes", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("no")
    )
    total = archives.agg(F.coalesce(F.sum(last + 1), F.lit(1)).alias("n")).first()["n"]
    spread = ranges.repartition(max(1, int(total)), "path", "no")  # a number that is named is kept by the planner

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema(
            [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
             ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("offset", pa.int64()),
             ("payload", pa.binary())]
        )
        for batch in batches:
            for row in batch.to_pylist():
                lo = row["no"] * range_bytes
                held: list[dict] = []
                for found in read_range(row["path"], lo, min(lo + range_bytes, row["bytes"]), row["bytes"], payloads):
                    held.append(found)
                    if len(held) >= (1 if payloads else 1000):
                        yield pa.RecordBatch.from_pylist(held, kind)
                        held = []
                if held:
                    yield pa.RecordBatch.from_pylist(held, kind)

    return spread.mapInArrow(run, RECORD)


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM f
"""


@query("op8_warc", ORACLE)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    archives = write_archives(with_originals(pages), scratch(spark, "warc"))
    return read_archives(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
