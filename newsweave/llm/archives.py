"""Legacy archives (ARC) to WARC, with revisit records for repeated payloads, and readers for both.

An ARC file starts with a version block: a ``filedesc://`` line, a line ``version reserved origin`` and a
line that names the fields of every record header. The two versions differ in that line:

* 1: ``URL IP-address Archive-date Content-type Archive-length``
* 2: ``URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length``

Each record is a header line of those fields, then as many bytes as its length declares, then a line
break. The converter takes the field names from the file itself, reads by declared lengths (payloads may
hold anything, header-like lines too), and makes up what WARC wants: an identifier that depends only
on the record (so a repeated run writes the same archive), the ISO form of the 14-digit date, the
record type from the scheme of the URL and the content type, and digests of block and payload.

A damaged file is no reason to lose the others, nor its own other records: each gzip member that can't be inflated, and each
record that can't be read, gives one row with ``error`` set, and reading goes on at the next member (a file that
is not compressed has no other place to go on from). Null payloads count as empty, null URLs as the empty URL. Repeated rows are
separate records with identifiers of their own. Very long payloads make an archive by themselves. Empty tables make no archive; further
columns, also such with the names used here, are not looked at.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsweave.llm.common import cells, map_batches

#: Header fields by ARC version, as fixed by the format.
FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
#: Bytes of an archive (one record at least); payloads from this size on may become revisits.
ARCHIVE_BYTES, REVISIT_BYTES = 32_000_000, 1000
#: An empty gzip member: what Spark's text writer puts behind each archive, so that the file stays a sequence of members.
EMPTY_MEMBER = gzip.compress(b"", mtime=0)
#: How a gzip member starts, and how much of a file is inflated at once.
MEMBER, CHUNK = b"\x1f\x8b\x08", 65536
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORD = ("record_id string, record_type string, target_uri string, ip string, date string, content_type string, "
          "payload_bytes long, payload_digest string, refers_to string, refers_to_uri string, source string, error string")


# ---------------------------------------------------------------- ARC

def arc_head(name: str, version: int, date: str = "20240101000000") -> bytes:
    """The version block of an ARC file."""
    body = f"{version} 0 newsweave\n{' '.join(FIELDS[version])}\n".encode()
    values = {"URL": f"filedesc://{name}", "IP-address": "0.0.0.0", "Archive-date": date, "Content-type": "text/plain", "Result-code": "200",
              "Archive-length": str(len(body))}
    return " ".join(values.get(f, "-") for f in FIELDS[version]).encode() + b"\n" + body + b"\n"


def arc_record(version: int, url: str, payload: bytes, date: str = "20240101000000", kind: str = "text/html", ip: str = "0.0.0.0") -> bytes:
    """One ARC record. White space in a URL is escaped, since a space ends the field."""
    safe = "".join(f"%{ord(c):02X}" if c in " \t\n\r\v\f" else c for c in url) or "-"
    values = {"URL": safe, "IP-address": ip, "Archive-date": date, "Content-type": kind, "Result-code": "200", "Archive-length": str(len(payload))}
    return " ".join(values.get(f, "-") for f in FIELDS[version]).encode("utf-8", "replace") + b"\n" + payload + b"\n"


def members(data: bytes) -> Iterator[tuple[bytes, str | None]]:
    """(content, error) of the gzip members of a file, one by one; a file that is not compressed is one. Behind a damaged member, or bytes
    that are none, reading goes on at the next member that is whole."""
    if data[:2] != MEMBER[:2]:
        yield data, None
        return
    at, lost, size = 0, False, len(data)
    while at < size:
        start = data.find(MEMBER, at)
        if start != at and data[at:start if start >= 0 else size].strip(b"\0") and not lost:
            yield b"", f"no gzip member at byte {at}"
            lost = True
        if start < 0:
            return
        reader, out, fed = zlib.decompressobj(31), [], start
        try:
            while fed < size and not reader.eof:
                out.append(reader.decompress(data[fed:fed + CHUNK]))
                fed = min(fed + CHUNK, size)
        except zlib.error:
            pass
        if reader.eof:
            yield b"".join(out), None
            at, lost = fed - len(reader.unused_data), False
        else:
            if not lost:
                yield b"", f"gzip member at byte {start} is damaged"
            at, lost = start + 1, True


def pieces(data: bytes) -> Iterator[tuple[bytes, list[int], str | None]]:
    """(content, starts, error): whole members that follow each other joined, with the places where they start; or what was lost."""
    joined, starts, size = [], [], 0
    for content, error in members(data):
        if error is None:
            starts.append(size)
            joined.append(content)
            size += len(content)
            continue
        if joined:
            yield b"".join(joined), starts, None
        yield b"", [], error
        joined, starts, size = [], [], 0
    if joined:
        yield b"".join(joined), starts, None


def recovered(data: bytes, read: Callable) -> Iterator[tuple[dict[str, str] | None, bytes | str]]:
    """(header, payload) of each record of a file and (None, error) for each part that can't be read. ``read`` gives the records of a
    stretch from a place on; behind a record that can't be read it goes on at the next member."""
    for content, starts, error in pieces(data):
        at = 0
        if error:
            yield None, error
            continue
        while at is not None:
            try:
                yield from read(content, at)
                at = None
            except BadRecord as e:
                yield None, str(e)
                at = next((s for s in starts if s > e.at), None)


class BadRecord(ValueError):
    """A record that can't be read, and where it starts."""

    def __init__(self, text: str, at: int):
        super().__init__(text)
        self.at = at


class ArcReader:
    """Records of ARC content. The field line of the version block holds for the rest of the file."""

    def __init__(self):
        self.fields: list[str] | None = None

    def __call__(self, data: bytes, at: int) -> Iterator[tuple[dict[str, str], bytes]]:
        while at < len(data):
            if data[at:at + 1] in b"\r\n":
                at += 1
                continue
            end = data.find(b"\n", at)
            line = data[at:end if end >= 0 else len(data)].decode("utf-8", "replace").rstrip("\r")
            names = self.fields or FIELDS[1 if len(line.split(" ")) <= len(FIELDS[1]) else 2]
            # a content type may hold spaces: what is too much belongs to it
            values = line.split(" ")
            more = len(values) - len(names)
            if more > 0:
                kind = names.index("Content-type") if "Content-type" in names else len(names) - 2
                values[kind:kind + 1 + more] = [" ".join(values[kind:kind + 1 + more])]
            header = dict(zip(names, values))
            if end < 0 or len(values) != len(names) or not header["Archive-length"].isdigit():
                raise BadRecord(f"no record header at byte {at}", at)
            size = int(header["Archive-length"])
            payload = data[end + 1:end + 1 + size]
            if len(payload) < size:
                raise BadRecord(f"record at byte {at} is cut off", at)
            start, at = at, end + 1 + size
            if not header["URL"].startswith("filedesc:"):
                if self.fields is None:
                    raise BadRecord("no version block", start)
                yield {**header, "offset": str(start)}, payload
                continue
            lines = payload.decode("utf-8", "replace").split("\n")
            self.fields = lines[1].split() if len(lines) > 1 and "Archive-length" in lines[1] else None
            if not self.fields:
                self.fields = FIELDS.get(int(lines[0].split()[0]) if lines[0][:1].isdigit() else 1, FIELDS[1])


def arc_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header by field name, payload) of each record; ValueError where the file can't be read on."""
    for header, payload in recovered(data, ArcReader()):
        if header is None:
            raise ValueError(payload)
        yield header, payload


# ---------------------------------------------------------------- WARC

def iso_date(date: str) -> str:
    """14 digits (fewer: the earliest such time) as an ISO time; anything else as the start of the epoch."""
    digits = date if date.isdigit() and 4 <= len(date) <= 14 else "19700101000000"
    digits += "00000101000000"[len(digits):]
    return f"{digits[:4]}-{digits[4:6]}-{digits[6:8]}T{digits[8:10]}:{digits[10:12]}:{digits[12:14]}Z"


def converted(header: dict[str, str], payload: bytes, source: str = "") -> dict:
    """The WARC fields of an ARC record. Its identifier depends on the archive and the place in it, so equal records are told apart and
    a repeated run gives the same."""
    url, kind = header["URL"], header.get("Content-type", "-")
    url = "" if url == "-" else url
    digest = hashlib.sha1(payload)
    name = "\n".join([url, header.get("Archive-date", "-"), digest.hexdigest(), source, header.get("offset", "")])
    scheme = url.split(":", 1)[0].lower()
    record_type = "response" if scheme in ("http", "https") or "://" not in url and scheme != "dns" else "resource"
    return {"record_id": f"<{uuid.uuid5(uuid.NAMESPACE_URL, name).urn}>", "record_type": record_type, "target_uri": url, "ip": header.get("IP-address", "-"),
            "date": iso_date(header.get("Archive-date", "")), "content_type": kind, "payload_bytes": len(payload), "payload_digest": digest.hexdigest()}


def base32(digest: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()


def warc_record(r: dict, payload: bytes) -> bytes:
    """A record as a gzip member. A revisit has no payload, but says which record has it and how long it is."""
    revisit = r["record_type"] == "revisit"
    body = b"" if revisit else payload
    lines = {"WARC-Type": r["record_type"], "WARC-Record-ID": r["record_id"], "WARC-Date": r["date"], "WARC-Target-URI": r["target_uri"],
             "WARC-IP-Address": r["ip"], "WARC-Payload-Digest": base32(r["payload_digest"]),
             "WARC-Block-Digest": base32(hashlib.sha1(body).hexdigest() if revisit else r["payload_digest"]),
             "WARC-Refers-To": r["refers_to"] or "", "WARC-Refers-To-Target-URI": r["refers_to_uri"] or "",
             "WARC-Profile": PROFILE if revisit else "", "X-Payload-Length": str(r["payload_bytes"]),
             "Content-Type": r["content_type"], "Content-Length": str(len(body))}
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines.items() if v not in ("", "-")) + "\r\n"
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(head.encode("utf-8", "replace") + body + b"\r\n\r\n") + packer.flush()


def warc_stretch(data: bytes, at: int) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records of WARC content from a place on, by declared lengths."""
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8", "replace").split("\r\n") if end >= 0 else [""]
        header = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = header.get("content-length", "")
        if not lines[0].startswith("WARC/") or not size.isdigit() or end + 4 + int(size) > len(data):
            raise BadRecord(f"no record at byte {at}", at)
        yield header, data[end + 4:end + 4 + int(size)]
        at = end + 4 + int(size)
        while data[at:at + 1] in (b"\r", b"\n"):
            at += 1


def warc_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header by lower-case field name, block) of each record; ValueError where the file can't be read on."""
    for header, block in recovered(data, warc_stretch):
        if header is None:
            raise ValueError(block)
        yield header, block


def warc_info(date: str) -> bytes:
    """The record that starts an archive: what wrote it, and in which format."""
    body = b"software: newsweave\r\nformat: WARC File Format 1.1\r\n"
    head = (f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <{uuid.uuid5(uuid.NAMESPACE_URL, date).urn}>\r\nWARC-Date: {date}\r\n"
            f"Content-Type: application/warc-fields\r\nContent-Length: {len(body)}\r\n\r\n")
    return gzip.compress(head.encode() + body + b"\r\n\r\n", 1, mtime=0)


# ---------------------------------------------------------------- tables of archives

def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(path, content): one row per archive file, read by Spark from any store. A file is read whole by its task."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def to_arc(rows: DataFrame, url: str, payload: str, key: str | None = None, version: int = 1, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Rows as ARC archives (path, content) of bounded size. With ``key`` each URL gets a fragment that holds it, so that a record can
    be told from others of the same URL."""
    def run(batches):
        parts, size, number = [], 0, 0

        def archive():
            name = f"{TaskContext.get().partitionId():06d}-{number:06d}.arc"
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([arc_head(name, version) + b"".join(parts)], pa.binary())], ["path", "content"])
        for b in batches:
            for k, u, p in zip(cells(b, "_key"), cells(b, "_url"), cells(b, "_payload")):
                parts.append(arc_record(version, KEY_MARK.join([u or "", k]) if key else u or "", p or b""))
                size += len(parts[-1])
                if size >= archive_bytes:
                    yield archive()
                    parts, size, number = [], 0, number + 1
        if parts:
            yield archive()
    named = rows.select((F.coalesce(F.col(key).cast("string"), F.lit("")) if key else F.lit("")).alias("_key"), F.col(url).cast("string").alias("_url"),
                        F.col(payload).cast("binary").alias("_payload"))
    return map_batches(named, run, "path string, content binary")


#: Between a URL and the key that ``to_arc`` hangs on it.
KEY_MARK = "#record="


def arc_table(archives: DataFrame) -> DataFrame:
    """The converter: a row for each record of ARC archives (path, content), with its WARC fields and ``payload``."""
    def run(batches):
        for b in batches:
            for path, content in zip(cells(b, "path"), cells(b, "content")):
                rows = [{"source": path, "error": payload} if header is None else {**converted(header, payload, path or ""), "source": path, "payload": payload}
                        for header, payload in recovered(content or b"", ArcReader())]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, ARC_SCHEMA)
    return map_batches(archives, run, RECORD + ", payload binary")


STRINGS = ["record_id", "record_type", "target_uri", "ip", "date", "content_type"]
RECORD_FIELDS = [*((n, pa.string()) for n in STRINGS), ("payload_bytes", pa.int64()), *((n, pa.string()) for n in ("payload_digest", "refers_to", "refers_to_uri", "source", "error"))]
ARC_SCHEMA = pa.schema([*RECORD_FIELDS, ("payload", pa.binary())])


def revisits(records: DataFrame, rank: Column, least: int = REVISIT_BYTES) -> DataFrame:
    """(record_id, first) of the records that repeat a payload of at least ``least`` bytes: of equal ones that with the largest
    ``rank`` (then the largest id) keeps it. Only ids and digests are moved; the maximum is combined in the tasks first."""
    large = records.where(F.col("payload_bytes") >= least).select(
        "record_id", "payload_digest", F.struct(rank.alias("rank"), F.col("record_id").alias("id"), F.col("target_uri").alias("uri")).alias("place"))
    first = large.groupBy("payload_digest").agg(F.max("place").alias("first"), F.count("*").alias("n")).where("n > 1").select("payload_digest", "first")
    return large.join(first, "payload_digest").where("record_id <> first.id").groupBy("record_id").agg(F.max("first").alias("first"))


def with_revisits(records: DataFrame, rank: Column, least: int = REVISIT_BYTES) -> DataFrame:
    """``records`` with type, ``refers_to`` and ``refers_to_uri`` of those that repeat a payload."""
    found = revisits(records.drop("payload"), rank, least).withColumnRenamed("record_id", "_id")
    return records.join(found, records["record_id"] == found["_id"], "left").withColumns({
        "record_type": F.when(F.col("first").isNotNull(), "revisit").otherwise(F.col("record_type")),
        "refers_to": F.col("first.id"), "refers_to_uri": F.col("first.uri")}).drop("_id", "first")


def write_warc(records: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write records as files of gzip members (one per record) into the folder ``path``, through Spark's own writer, so into any store.
    A file holds one archive of bounded size, whatever the size of a partition."""
    def run(batches):
        parts, size = [], 0
        for b in batches:
            for r in b.to_pylist():
                if r["record_id"] is None:
                    continue
                if not parts:
                    parts.append(warc_info(r["date"]))
                parts.append(warc_record(r, r["payload"] or b""))
                size += len(parts[-1])
                if size >= archive_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(parts)], pa.binary())], ["content"])
                    parts, size = [], 0
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(parts)], pa.binary())], ["content"])
    archives = map_batches(records.select(*STRINGS, "payload_bytes", "payload_digest", "refers_to", "refers_to_uri", "payload"), run, "content binary")
    # the text writer writes the bytes of a string as they are
    (archives.select(F.col("content").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).option("encoding", "ISO-8859-1")
     .option("lineSep", EMPTY_MEMBER.decode("latin-1")).text(path))


def warc_table(archives: DataFrame, payloads: bool = False, info: bool = False) -> DataFrame:
    """A row for each record of WARC archives (path, content), with ``info`` also for those that describe the archive itself. Digest and length are those of the block that was read; for a revisit
    those that its header declares. A block that doesn't fit its digest sets ``error``."""
    def run(batches):
        for b in batches:
            for path, content in zip(cells(b, "path"), cells(b, "content")):
                rows = []
                for h, block in recovered(content or b"", warc_stretch):
                    if h is None:
                        rows.append({"source": path, "error": block})
                        continue
                    declared, kind = h.get("warc-payload-digest", ""), h.get("warc-type", "")
                    if kind == "warcinfo" and not info:
                        continue
                    digest = hashlib.sha1(block).hexdigest()
                    size, error = len(block), None
                    if kind == "revisit":
                        digest = base64.b32decode(declared.removeprefix("sha1:")).hex()
                        size = int(h.get("x-payload-length", "0"))
                    elif declared and base32(digest) != declared:
                        error = "digest"
                    rows.append({"record_id": h.get("warc-record-id"), "record_type": kind, "target_uri": h.get("warc-target-uri", ""), "ip": h.get("warc-ip-address"),
                                 "date": h.get("warc-date"), "content_type": h.get("content-type"), "payload_bytes": size, "payload_digest": digest,
                                 "refers_to": h.get("warc-refers-to"), "refers_to_uri": h.get("warc-refers-to-target-uri"), "source": path, "error": error, **({"payload": block} if payloads else {})})
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, ARC_SCHEMA if payloads else pa.schema(RECORD_FIELDS))
    return map_batches(archives, run, RECORD + (", payload binary" if payloads else ""))


def key_of(uri: Column) -> Column:
    """The key that ``to_arc`` hung on a URL."""
    return F.regexp_extract(uri, f"{KEY_MARK}([^#]*)$", 1)
