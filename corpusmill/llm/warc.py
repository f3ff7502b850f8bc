"""WARC derivative builder: response records become a linked metadata record and a plain-text
conversion record each, which refer to the response's id and keep its date, target and digests.
The source's own record headers and its HTTP headers go along (WARC-Source-*, HTTP-*). Payloads are
un-chunked, un-zipped and decoded by the charset of the HTTP header, a byte order mark or the page
itself, UTF-8 where none is named.

Record ids are name-based (from target, date and payload digest): captures that agree in these
share their id, and a task that is run again writes the same records. A response whose payload is
not HTML keeps its metadata record and has no conversion. Files are read record by record, gzip
files in byte ranges (a range has the members that begin in it), so that memory follows the
largest record and not the file; a record cut short by the end of its file keeps what is there and
is marked WARC-Truncated. Null payloads are empty; null or empty targets are kept as empty headers;
pages with a null id or repeated ids are derived each; an empty table gives no records. Other
columns, whatever their names, are not read."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from html import unescape
from urllib.parse import urljoin

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.common import SLICE_BYTES, map_batches

VERSION = "WARC/1.0"
MAGIC, PROBE, CHUNK, RANGE = b"\x1f\x8b\x08", 1024, 1 << 20, 64 << 20
DATE = "2024-01-01T00:00:00Z"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
RECORD = "record_id string, warc_type string, refers_to string, target_uri string, warc_date string, content_type string, block_digest string, payload_digest string, headers map<string,string>, content_length long, block binary"
NAMES = [c.split()[0] for c in RECORD.split(", ")]
_DROP = re.compile(r"<!--.*?-->|<(script|style|noscript|template)\b.*?(?:</\1\s*>|\Z)", re.I | re.S)
_BREAK = re.compile(r"</?(?:p|div|li|ul|ol|tr|table|h[1-6]|br|article|section|header|footer|nav|title|blockquote|pre)\b[^>]*>", re.I)
_TAG = re.compile(r"<[a-zA-Z/!?][^>]*>")
_HREF = re.compile(r"<a\b[^>]*?\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_CHARSET = re.compile(r"charset\s*=\s*[\"']?\s*([\w.:-]+)", re.I)
_TITLE = re.compile(r"<title[^>]*>(.*?)</title", re.I | re.S)


def sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, ' '.join(parts))}>"


def plain_text(html: str) -> str:
    """Visible text, a line per block element, blanks within lines collapsed."""
    text = unescape(_TAG.sub("", _BREAK.sub("\n", _DROP.sub("", html))))
    lines = (" ".join(line.split()) for line in text.split("\n"))
    return "\n".join(line for line in lines if line)


def links(html: str, base: str) -> list[str]:
    out = []
    for match in _HREF.finditer(_DROP.sub("", html)):
        href = unescape(next(g for g in match.groups() if g is not None)).strip()
        if href and not href.startswith(("#", "javascript:", "mailto:")):
            try:
                out.append(urljoin(base, href))
            except ValueError:
                continue
    return list(dict.fromkeys(out))


def _record(kind: str, refers_to: str | None, uri: str, date: str, content_type: str, block: bytes, payload_digest: str | None, extra: dict[str, str] | None = None, own_id: str | None = None) -> dict:
    return {
        "record_id": own_id or record_id(kind, refers_to or uri, date, sha1(block)), "warc_type": kind, "refers_to": refers_to, "target_uri": uri, "warc_date": date, "content_type": content_type,
        "block_digest": sha1(block), "payload_digest": payload_digest, "headers": list((extra or {}).items()), "content_length": len(block), "block": block,
    }


def response(uri: str | None, body: str | None, date: str = DATE) -> dict:
    payload = (body or "").encode("utf-8", "surrogatepass")
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    digest = sha1(payload)
    return _record("response", None, uri or "", date, "application/http; msgtype=response", head + payload, digest, own_id=record_id("response", uri or "", date, digest))


def split_http(block: bytes) -> tuple[dict[str, str], bytes]:
    head, _, payload = block.partition(b"\r\n\r\n")
    lines = head.decode("latin-1").split("\r\n")
    return {k.strip(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:]) if k.strip()}, payload


def unchunked(data: bytes) -> bytes:
    """The body of a chunked transfer; what does not follow the form stays as it is."""
    out, at = [], 0
    while True:
        end = data.find(b"\r\n", at)
        try:
            size = int(data[at:end].split(b";")[0], 16) if end >= 0 else -1
        except ValueError:
            size = -1
        if size < 0:
            return data if not out else b"".join(out)
        if size == 0:
            return b"".join(out)
        out.append(data[end + 2 : end + 2 + size])
        at = end + 4 + size


def unzipped(data: bytes, encoding: str) -> bytes:
    for name in reversed([x.strip().lower() for x in encoding.split(",")]):
        if name in ("gzip", "x-gzip", "deflate"):
            for bits in (47, -15):  # with a header of either kind, or none
                try:
                    data = zlib.decompressobj(bits).decompress(data)
                    break
                except zlib.error:
                    continue
    return data


def decoded(data: bytes, content_type: str) -> str:
    named = _CHARSET.search(content_type) or _CHARSET.search(data[:2048].decode("latin-1"))
    for mark, charset in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if data.startswith(mark):
            return data.decode(charset, "replace")
    try:
        return data.decode(named.group(1) if named else "utf-8", "replace")
    except LookupError:
        return data.decode("utf-8", "replace")


def derive(source: dict) -> list[dict]:
    """The metadata and, of HTML, the conversion record of one response."""
    http, payload = split_http(source["block"])
    lower = {k.lower(): v for k, v in http.items()}
    uri, date, rid = source["target_uri"] or "", source["warc_date"] or DATE, source["record_id"]
    content_type = lower.get("content-type", "text/html")
    body = unchunked(payload) if "chunked" in lower.get("transfer-encoding", "").lower() else payload
    body = unzipped(body, lower.get("content-encoding", ""))
    html = decoded(body, content_type) if "html" in content_type.lower() else None
    title = _TITLE.search(html or "")
    own = dict(source["headers"] or {})
    digests = {"payload-digest": source["payload_digest"] or sha1(payload), "block-digest": source["block_digest"] or sha1(source["block"])}
    meta = {"source-record-id": rid, **digests, "source-content-type": source["content_type"], "source-headers": own, "http-headers": http, "title": plain_text(title.group(1)) if title else None, "links": links(html or "", uri)}
    kept = {f"WARC-Source-{k}": v for k, v in {**own, "Content-Type": source["content_type"], "Payload-Digest": digests["payload-digest"], "Block-Digest": digests["block-digest"]}.items() if v is not None}
    kept |= {f"HTTP-{k}": v for k, v in http.items()}
    block = json.dumps(meta, ensure_ascii=False, sort_keys=True).encode("utf-8", "surrogatepass")
    out = [_record("metadata", rid, uri, date, "application/json", block, None, kept)]
    if html is not None:
        text = plain_text(html).encode("utf-8", "surrogatepass")
        out.append(_record("conversion", rid, uri, date, "text/plain; charset=utf-8", text, None, kept))
    return out


def _batch(rows: list[dict]) -> pa.RecordBatch:
    s, m = pa.string(), pa.map_(pa.string(), pa.string())
    kinds = [s] * 8 + [m, pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(NAMES, kinds)], names=NAMES)


def responses(pages: DataFrame, url_col: str = "url", html_col: str = "html", date: str = DATE) -> DataFrame:
    """Response records of a table of pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _batch([response(u, h, date) for u, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())])

    return map_batches(pages.select(F.col(url_col), F.col(html_col)), run, RECORD)


def derivatives(records: DataFrame) -> DataFrame:
    """Metadata and conversion records of the response records; others are passed over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [d for r in batch.to_pylist() for d in derive({**r, "block": r["block"] or b""})]
            if rows:
                yield _batch(rows)

    return map_batches(records.filter("warc_type = 'response'").select(*NAMES), run, RECORD)


def with_source(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = DATE) -> DataFrame:
    """Each page's response and its derivatives in one narrow pass, beside the page's id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = [], []
            for page, url, html in zip(*(c.to_pylist() for c in batch.columns)):
                first = response(url, html, date)
                family = [first, *derive(first)]
                ids += [page] * len(family)
                rows += family
            if rows:
                made = _batch(rows)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *made.columns], names=[id_col, *NAMES])

    return map_batches(pages.select(F.col(id_col).cast("long").alias(id_col), F.col(url_col), F.col(html_col)), run, f"{id_col} long, {RECORD}")


def to_bytes(r: dict) -> bytes:
    """One record in its file form."""
    head = [("WARC-Type", r["warc_type"]), ("WARC-Record-ID", r["record_id"]), ("WARC-Date", r["warc_date"]), ("WARC-Target-URI", r["target_uri"]), ("WARC-Refers-To", r["refers_to"]), ("WARC-Block-Digest", r["block_digest"]), ("WARC-Payload-Digest", r["payload_digest"]), ("Content-Type", r["content_type"]), *dict(r["headers"] or {}).items(), ("Content-Length", str(len(r["block"])))]
    lines = "".join(f"{k}: {v}\r\n" for k, v in head if v is not None)
    return f"{VERSION}\r\n{lines}\r\n".encode("utf-8", "surrogatepass") + r["block"] + b"\r\n\r\n"


_OWN = {"warc-type": "warc_type", "warc-record-id": "record_id", "warc-date": "warc_date", "warc-target-uri": "target_uri", "warc-refers-to": "refers_to", "warc-block-digest": "block_digest", "warc-payload-digest": "payload_digest", "content-type": "content_type"}


def records_of(stream) -> Iterator[dict]:
    """The records that a stream of readline and read holds."""
    while line := stream.readline():
        if not line.strip():
            continue
        r: dict = dict.fromkeys(NAMES) | {"headers": []}
        size = 0
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            k, _, v = line.decode("utf-8", "surrogatepass" if b"\xed" in line else "replace").partition(":")
            k, v = k.strip(), v.strip()
            if k.lower() == "content-length":
                size = int(v) if v.isdigit() else 0
            elif k.lower() in _OWN:
                r[_OWN[k.lower()]] = v
            else:
                r["headers"].append((k, v))
        r["block"], r["content_length"] = stream.read(size), size
        if len(r["block"]) < size or not line:
            r["headers"].append(("WARC-Truncated", "unspecified"))
        yield r


class _Member:
    """One gzip member of a file, inflated as it is read; end is where the next member begins."""

    def __init__(self, file, start: int) -> None:
        file.seek(start)
        self.file, self.inflate, self.buffer, self.end = file, zlib.decompressobj(31), b"", start

    def _more(self) -> bool:
        if self.inflate.eof:
            return False
        data = self.file.read(CHUNK)
        try:
            self.buffer += self.inflate.decompress(data)
        except zlib.error:  # broken from here on
            data = b""
        self.end += len(data) - len(self.inflate.unused_data)
        if not data:
            self.inflate = zlib.decompressobj(31)
            self.end = 1 << 62
            return False
        return True

    def readline(self) -> bytes:
        while b"\n" not in self.buffer and self._more():
            pass
        n = self.buffer.find(b"\n") + 1 or len(self.buffer)
        line, self.buffer = self.buffer[:n], self.buffer[n:]
        return line

    def read(self, size: int) -> bytes:
        parts, have = [self.buffer], len(self.buffer)
        self.buffer = b""
        while have < size and self._more():
            parts.append(self.buffer)
            have, self.buffer = have + len(self.buffer), b""
        data = b"".join(parts)
        self.buffer = data[size:]
        return data[:size]


def _next_member(file, start: int, end: int) -> int | None:
    """Where the first member begins at or after start and before end."""
    tail = b""
    file.seek(start)
    while start < end:
        data = tail + file.read(CHUNK)
        if len(data) == len(tail):
            return None
        at = data.find(MAGIC)
        while at >= 0:
            if start + at >= end:
                return None
            if at + PROBE > len(data) and (more := file.read(PROBE)):
                data += more
            try:
                if zlib.decompressobj(31).decompress(data[at : at + PROBE], 5) == b"WARC/":
                    return start + at
            except zlib.error:
                pass
            at = data.find(MAGIC, at + 1)
        tail = data[-len(MAGIC) + 1 :]
        start += len(data) - len(tail)
    return None


def read_range(file, start: int, end: int) -> Iterator[dict]:
    """The records of the gzip members that begin in [start, end); of a plain file all at 0."""
    file.seek(0)
    if file.read(2) != MAGIC[:2]:
        if start == 0:
            file.seek(0)
            yield from records_of(file if isinstance(file, io.BytesIO) else io.BufferedReader(file, CHUNK))
        return
    at = _next_member(file, start, end)
    while at is not None and at < end:
        member = _Member(file, at)
        yield from records_of(member)
        while member._more():  # what is left of the member behind its last record
            member.buffer = b""
        at = member.end if member.end < end else None
        if at is not None:
            at = _next_member(file, at, end)


def from_bytes(data: bytes) -> Iterator[dict]:
    """The records of a file, gzip members or plain."""
    yield from read_range(io.BytesIO(data), 0, max(1, len(data)))


def write_files(records: DataFrame, path: str) -> DataFrame:
    """(path, record_id) of records written as Parquet rows of gzip members: each row's member is a
    whole record, so the members of any rows, joined, are a valid file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([gzip.compress(to_bytes(r), mtime=0) for r in rows], pa.binary())], names=["record_id", "member"])

    map_batches(records.select(*NAMES), run, "record_id string, member binary").write.parquet(path)
    return records.sparkSession.read.parquet(path)


def read_members(members: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r for m in batch.column(0).to_pylist() if m for r in from_bytes(m)]
            if rows:
                yield _batch(rows)

    return map_batches(members.select("member"), run, RECORD)


def write_warc(records: DataFrame, path: str) -> DataFrame:
    """(file, n_records): the records as .warc.gz files in the folder path (a URI that all executors
    reach), one a partition, a gzip member a record. A task writes under a name of its attempt and
    renames at its end, so that a task that is run again replaces its file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        store, root = fs.FileSystem.from_uri(path)
        store.create_dir(root)
        name, n = f"{root}/part-{task.partitionId():05d}.warc.gz", 0
        with store.open_output_stream(f"{name}.{task.taskAttemptId()}", compression=None) as out:
            for batch in batches:
                for r in batch.to_pylist():
                    out.write(gzip.compress(to_bytes(r), mtime=0))
                    n += 1
        store.move(f"{name}.{task.taskAttemptId()}", name)
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], names=["file", "n_records"])

    return map_batches(records.select(*NAMES), run, "file string, n_records long")


def read_files(spark: SparkSession, path: str, range_bytes: int = RANGE) -> DataFrame:
    """The records of WARC files, read in byte ranges."""
    files = spark.read.format("binaryFile").load(path).select("path", "length")
    at = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(range_bytes).cast("long")))
    ranges = files.select("path", at.alias("at"))
    ranges = ranges.repartition(max(1, ranges.count()), "path", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, start in zip(*(c.to_pylist() for c in batch.columns)):
                store, inside = fs.FileSystem.from_uri(name)
                with store.open_input_file(inside) as file:
                    rows, size = [], 0
                    for r in read_range(file, start, start + range_bytes):
                        rows.append(r)
                        size += len(r["block"])
                        if size > SLICE_BYTES:
                            yield _batch(rows)
                            rows, size = [], 0
                    if rows:
                        yield _batch(rows)

    return map_batches(ranges, run, RECORD)


def text_of(block: Column) -> Column:
    return block.cast("string")
