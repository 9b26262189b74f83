"""WARC archives of pages: a writer that stores equal payloads once, and a splittable reader.

Archives are gzip members end to end, one a record, so any byte range can be read for itself. The reader lets Spark cut
files into byte ranges and scan each for the gzip magic; a task owns the candidate members that start inside its range
(and reads on past its end to finish the last). Candidates are validated by decoding their headers: a magic inside
compressed data is no member and is given back to the member that it lies in. Where such a false candidate is the first
of a range, its bytes are stitched to the member that the range before left open.

Spark's text sink and source carry the bytes, so archives can stand in any file system that Spark reads: the sink ends
each row with a NUL, which is the last byte of every gzip member here (the size's high byte), hence not written twice.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscope.llm.common import only, released, scratch_path, tune, written

MAGIC = b"\x1f\x8b\x08"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the namespace of URLs


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def member(record: bytes) -> bytes:
    """A gzip member that ends in NUL; a record of 16 MB or more, whose size does not, gets an empty member behind it."""

    def gz(data: bytes) -> bytes:
        c = zlib.compressobj(6, zlib.DEFLATED, 31)
        return c.compress(data) + c.flush()

    out = gz(record)
    return out if out.endswith(b"\0") else out + gz(b"")


def _value(x: object) -> str:
    """A header's value on one line."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", str(x))


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'page:{page_id}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response, or where refers_to is given a revisit: the same HTTP header without the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_value(url)}")
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page-ID: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_warc(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", html: str = "html", least: int = 0) -> None:
    """Write a record per row. Of rows with equal payloads of at least `least` bytes the smallest key is the response.

    A null html is an empty payload and as such equal to other empty ones; null urls are left out; rows of null key are
    responses; rows that repeat the smallest key are responses too. An empty table writes an archive without pages.
    """
    base = pages.select(F.col(f"`{key}`").cast("bigint").alias("id"), F.col(f"`{url}`").alias("url"), F.coalesce(F.col(f"`{html}`"), F.lit("")).alias("html"))
    base = base.withColumn("sha", F.sha1(F.col("html").cast("binary")))
    tune(pages.sparkSession)
    shared = base.where((F.octet_length("html") >= least) & F.col("id").isNotNull()).groupBy("sha").agg(F.min("id").alias("first"), F.count("*").alias("m")).where("m > 1")
    shared = written(shared.select("sha", "first"), "warc-shared")
    rows = base.join(shared, "sha", "left")
    rows = rows.select("id", "url", "html", "sha", F.when(F.col("id") > F.col("first"), F.col("first")).alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        info = b"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: " + record_id(None).encode() + f"\r\nWARC-Date: {DATE}\r\nContent-Type: application/warc-fields\r\nContent-Length: 18\r\n\r\n".encode() + b"format: WARC/1.1\r\n\r\n\r\n"
        yield pa.RecordBatch.from_arrays([pa.array([member(info)[:-1]], pa.binary())], names=["member"])
        for b in batches:
            out = []
            for i, u, h, s, r in zip(*(b.column(c) for c in ("id", "url", "html", "sha", "refers_to")), strict=True):
                digest = base64.b32encode(bytes.fromhex(s.as_py())).decode()
                out.append(member(record(i.as_py(), u.as_py(), h.as_py().encode("utf-8", "surrogatepass"), digest, r.as_py()))[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["member"])

    rows.mapInArrow(released(run), "member binary").select(F.col("member").cast("string").alias("value")).write.option("lineSep", "\0").text(path)


def parse(raw: bytes) -> dict | None:
    """Fields of a record's bytes; None for other kinds than response and revisit."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    if not head.startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:] if ": " in line)
    kind = fields.get("WARC-Type")
    if kind not in ("response", "revisit"):
        return None
    block = rest[: int(fields["Content-Length"])]
    if len(block) < int(fields["Content-Length"]):
        raise ValueError("record cut short")
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = fields.get("WARC-Payload-Digest", "").removeprefix("sha1:")
    if kind == "response":
        size = len(payload)
        if (own := base32_sha1(payload)) != digest:
            raise ValueError(f"payload digest {own} is not {digest}")
    else:
        m = re.search(rb"(?im)^content-length: *(\d+)", http)
        size = int(m[1]) if m else None
    number = lambda k: int(fields[k]) if k in fields else None
    return {"page_id": number("X-Page-ID"), "url": fields.get("WARC-Target-URI"), "record_type": kind, "payload_bytes": size, "payload_digest": digest, "refers_to": number("X-Refers-To-Page-ID"), "payload": payload if kind == "response" else None}


_RECORD = "page_id bigint, url string, record_type string, payload_bytes bigint, payload_digest string, refers_to bigint, payload binary"
_COLUMNS = [c.split()[0] for c in _RECORD.split(", ")]
_KINDS = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]


class MemberScan:
    """Members of one byte range, from the stretches between its gzip magics in order."""

    def __init__(self) -> None:
        self.open = None
        self.begin = b""
        self.parts: list[bytes] = []
        self.raw: list[bytes] = []

    def _go_on(self, data: bytes) -> bool:
        """Inflate data into the open member; False if it is none."""
        try:
            self.parts.append(self.open.decompress(data))
        except zlib.error:
            return False
        self.raw.append(data)
        if len(self.begin) < 5:
            self.begin = (self.begin + self.parts[-1][:5])[:5]
        return b"WARC/".startswith(self.begin)

    def feed(self, stretch: bytes) -> list[tuple[bytes | None, bytes | None]]:
        """(a whole record's bytes, None) and (None, bytes that no member of this range owns) that the stretch settles."""
        data = MAGIC + stretch
        out: list[tuple[bytes | None, bytes | None]] = []
        if self.open is not None and not self._go_on(data):  # what was open is no member: this stretch may begin one
            out = [(None, x) for x in self.raw if x is not data]
            self.open = None
        elif self.open is None:
            pass
        else:
            return self._ended()
        self.open, self.begin, self.parts, self.raw = zlib.decompressobj(31), b"", [], []
        if not self._go_on(data):
            self.open = None
            return [*out, (None, data)]
        return out + self._ended()

    def _ended(self) -> list[tuple[bytes | None, bytes | None]]:
        if not self.open.eof:
            return []
        self.open = None
        return [(b"".join(self.parts), None)]

    def rest(self) -> bytes | None:
        """The bytes of a member that the range leaves open."""
        return b"".join(self.raw) if self.open is not None else None


def _record_batch(found: list[tuple[str, int, int, dict | None, bytes | None]], payloads: bool) -> pa.RecordBatch:
    rows = [r or {} for _, _, _, r, _ in found]
    columns = [pa.array([x.get(c) if payloads or c != "payload" else None for x in rows], k) for c, k in zip(_COLUMNS, _KINDS, strict=True)]
    own = [pa.array([x[i] for x in found], k) for i, k in ((0, pa.string()), (1, pa.int64()), (2, pa.int64()), (4, pa.binary()))]
    return pa.RecordBatch.from_arrays(columns + own, names=[*_COLUMNS, "path", "at", "seq", "piece"])


def read_warc(spark, path: str, payloads: bool = True, split_bytes: int | None = None) -> DataFrame:
    """Response and revisit records of the archives below path.

    Raises on a record whose digest does not fit its payload, and on bytes that belong to no record. split_bytes sets
    the range that a task reads (the session's maxPartitionBytes by default).
    """
    tune(spark)
    reader = spark.read.option("encoding", "ISO-8859-1").option("lineSep", MAGIC.decode("latin-1"))
    own = spark.conf.get("spark.sql.files.maxPartitionBytes")
    lines = reader.text(path).select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple[str, int] | None = None
        scan, seq = MemberScan(), 0
        for b in batches:
            found = []
            for v, p, a in zip(b.column("value"), b.column("path").to_pylist(), b.column("at").to_pylist(), strict=True):
                if (p, a) != now:
                    if now and (tail := scan.rest()) is not None:
                        found.append((*now, 1 << 40, None, tail))
                    scan, seq, now = MemberScan(), 0, (p, a)
                    if a == 0 and v.as_py() == b"":  # before a file's first magic
                        continue
                for whole, stray in scan.feed(v.as_py()):
                    seq += 1
                    if whole and (r := parse(whole)):
                        found.append((p, a, seq, r, None))
                    if stray is not None:
                        found.append((p, a, seq, None, stray))
            yield _record_batch(found, payloads)
        if now and (tail := scan.rest()) is not None:
            yield _record_batch([(*now, 1 << 40, None, tail)], payloads)

    def stitch(pdf: pd.DataFrame) -> pd.DataFrame:
        """Open members and strays of one file, in order of place: what no range could finish alone."""
        out, scan = [], MemberScan()
        for x in pdf.sort_values(["at", "seq"])["piece"]:
            for stretch in bytes(x).split(MAGIC)[1:]:
                for whole, stray in scan.feed(stretch):
                    if stray is not None:
                        raise ValueError("bytes that belong to no record")
                    if whole and (r := parse(whole)):
                        out.append({c: r[c] for c in _COLUMNS if payloads or c != "payload"})
        if scan.rest() is not None:
            raise ValueError("an archive ends inside a record")
        return pd.DataFrame(out, columns=_COLUMNS).astype({c: "Int64" for c in ("page_id", "payload_bytes", "refers_to")})

    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split_bytes) if split_bytes else own)
    try:
        found = written(lines.mapInArrow(released(run), f"{_RECORD}, path string, at bigint, seq bigint, piece binary"), "warc-read")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", own)
    stitched = found.where("piece is not null").groupBy("path").applyInPandas(stitch, _RECORD)
    return found.where("piece is null").select(*_COLUMNS).unionByName(stitched)


def warc_query(spark, sf_dir: str) -> DataFrame:
    """op9: per page its record, read back from the archives."""
    path = scratch_path(spark, "warc")
    write_warc(only(spark.read.parquet(f"{sf_dir}/pages.parquet"), "page_id", "url", "html"), path)
    return read_warc(spark, path, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def expected(rows: list[tuple[int, str | None]]) -> np.ndarray:
    """Brute force for tests: (page_id, bytes, digest, type, refers_to) of (page_id, html)."""
    first: dict[bytes, int] = {}
    for i, h in sorted(rows):
        first.setdefault((h or "").encode(), i)
    out = [(i, len(p := (h or "").encode()), base32_sha1(p), "response" if first[p] == i else "revisit", None if first[p] == i else first[p]) for i, h in rows]
    return np.array(out, dtype=object)
