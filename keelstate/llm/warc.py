"""WARC derivatives: metadata and plain-text conversion records of response records.

A record is one row: its type, id, the id that it refers to, target, date, headers and block. A
response's block is an HTTP message; its conversion is the plain text of the body, and its metadata
names the source's headers, title, links and sizes. Both refer to the response by
WARC-Refers-To and keep its target and date; its digests stand in the conversion's WARC-Source- fields
and in the metadata, as a record's own digests are of its own payload and block. Ids are derived from the source's id and the
block, so a rerun, or a task run again elsewhere, gives the same records.

Defined results: a response with a null block has an empty message; a null id is derived from the
block and target; repeated responses are converted one by one and yield equal records; an empty
table gives no rows. Only the columns of SCHEMA are read, so other columns may have any name.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelstate.llm import common

VERSION = "WARC/1.1"
#: The date of records made from pages that carry none.
NO_DATE = "1970-01-01T00:00:00Z"

SCHEMA = (
    "warc_type string, record_id string, refers_to string, target_uri string, warc_date string, "
    "content_type string, payload_digest string, block_digest string, content_length long, "
    "headers map<string,string>, block binary"
)
_MAP = pa.map_(pa.string(), pa.string())
_FIELDS = pa.schema(
    [
        *((name, pa.string()) for name in ("warc_type", "record_id", "refers_to", "target_uri", "warc_date")),
        *((name, pa.string()) for name in ("content_type", "payload_digest", "block_digest")),
        ("content_length", pa.int64()),
        ("headers", _MAP),
        ("block", pa.binary()),
    ]
)

#: Elements without text of the page, and those that begin or end a line of it.
_SILENT = {name: re.compile(rf"</{name}\s*>", re.I) for name in ("script", "style", "noscript", "template")}
_BREAKS = frozenset(
    "p div br li ul ol tr table h1 h2 h3 h4 h5 h6 section article header footer blockquote pre title head body nav td th".split()
)
_NAME = re.compile(r"</?([A-Za-z]\w*)")
_TITLE_END = re.compile(r"</title\s*>", re.I)
_HREF = re.compile(r"\bhref\s*=\s*", re.I)
_BARE = re.compile(r"[^\s>]+")
_BLANKS = re.compile(r"[^\S\n]+")
_LINES = re.compile(r"\s*\n\s*")
#: Bytes of a WARC file that are unpacked at once.
CHUNK = 1 << 20
_CHARSET = re.compile(rb"charset\s*=\s*[\"']?([A-Za-z0-9_-]+)", re.I)


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(10).join(parts))}>"


def read_page(page: str) -> tuple[str, str, list[str]]:
    """Text, title and link targets of an HTML page, in one pass over it.

    The text has a line for each block, without scripts, styles and comments. What a search doesn't
    find behind one place it isn't asked for behind later ones, so no page takes more than linear time.
    """
    parts: list[str] = []
    links: list[str] = []
    title, at, missing = None, 0, set()

    def find(mark: str, start: int) -> int:
        if mark in missing or (found := page.find(mark, start)) < 0:
            missing.add(mark)
            return -1
        return found

    while (start := find("<", at)) >= 0:
        parts.append(page[at:start])
        if page.startswith("<!--", start):
            end = find("-->", start + 4)
            parts.append(" ")
            at = end + 3 if end >= 0 else len(page)
            continue
        named = _NAME.match(page, start)
        end = find(">", start + 1) if named or page[start + 1 : start + 2] in ("/", "!", "?") else -1
        if end < 0:  # no tag
            parts.append("<")
            at = start + 1
            continue
        at = end + 1
        name = named[1].lower() if named else ""
        opens = page[start + 1] != "/"
        if opens and name in _SILENT:
            shut = _SILENT[name].search(page, at)
            parts.append(" ")
            at = shut.end() if shut else len(page)
        elif name in _BREAKS:
            parts.append("\n")
        if opens and name == "title" and title is None:
            shut = _TITLE_END.search(page, at)
            title = page[at : shut.start()] if shut else ""
        if opens and name == "a" and (href := _HREF.search(page, named.end(), end)):
            first = href.end()
            if (quote := page[first : first + 1]) in ("'", '"') and (last := find(quote, first + 1)) >= 0:
                links.append(page[first + 1 : last])
            elif quote not in ("'", '"') and (bare := _BARE.match(page, first)):
                links.append(bare[0])
    parts.append(page[at:])
    return _tidy("".join(parts)), _tidy(title or ""), [html.unescape(link) for link in links]


def _tidy(text: str) -> str:
    return _LINES.sub("\n", _BLANKS.sub(" ", html.unescape(text))).strip()


def plain_text(page: str) -> str:
    return read_page(page)[0]


def split_message(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """Status line, headers in order and body of an HTTP message; a block without a head is all body."""
    if not block.startswith(b"HTTP/"):
        return "", [], block
    head, _, body = block.partition(b"\r\n\r\n")
    status, *lines = head.decode("latin-1").split("\r\n")
    headers = []
    for line in lines:
        name, colon, value = line.partition(":")
        if line[:1] in (" ", "\t") and headers:  # a folded line goes on with the one before
            headers[-1] = (headers[-1][0], f"{headers[-1][1]} {line.strip()}".strip())
        elif colon:
            headers.append((name.strip(), value.strip()))
    return status, headers, body


def joined(pairs: list[tuple[str, str]]) -> dict[str, str]:
    """Pairs as a map: the values of a repeated name in order, one a line."""
    held: dict[str, str] = {}
    for name, value in pairs:
        held[name] = f"{held[name]}\n{value}" if name in held else value
    return held


def unchunked(body: bytes) -> bytes:
    """A chunked body put together; one that isn't chunked, as in many archives, stays as it is."""
    out, at = [], 0
    while (end := body.find(b"\r\n", at)) >= 0:
        size = body[at:end].split(b";")[0].strip()
        if not re.fullmatch(rb"[0-9A-Fa-f]{1,15}", size):
            return body if not out else b"".join(out)
        if not int(size, 16):
            return b"".join(out)
        at = end + 2 + int(size, 16)
        out.append(body[end + 2 : at])
        at += 2
    return b"".join(out) if out else body


def unpacked(body: bytes, headers: list[tuple[str, str]]) -> tuple[bytes, str]:
    """The body without transfer and content encodings, and the one that can't be undone."""

    def named(name: str) -> list[str]:
        return [c.strip().lower() for k, v in headers if k.lower() == name for c in v.split(",") if c.strip()]

    for coding in (named("content-encoding") + named("transfer-encoding"))[::-1]:
        if coding == "chunked":
            body = unchunked(body)
        elif coding in ("gzip", "x-gzip", "deflate"):
            out = []
            rest = body
            wrapped = rest[:2] == b"\x1f\x8b" or (rest[:1] and rest[0] & 15 == 8 and int.from_bytes(rest[:2]) % 31 == 0)
            if coding != "deflate" and not wrapped:
                continue  # already undone by the crawler
            try:
                while rest:
                    tool = zlib.decompressobj(47 if wrapped else -15)
                    out.append(tool.decompress(rest))
                    rest = tool.unused_data if tool.unused_data[:2] == b"\x1f\x8b" else b""
            except zlib.error:
                if not out:
                    return b"", coding
            body = b"".join(out)
        elif coding != "identity":
            return b"", coding
    return body, ""


def decoded(body: bytes, content_type: str) -> str:
    named = _CHARSET.search(content_type.encode()) or _CHARSET.search(body[:1024])
    try:
        return body.decode(named[1].decode() if named else "utf-8", "replace")
    except LookupError:
        return body.decode("utf-8", "replace")


def _row(kind: str, source: dict, content_type: str, block: bytes, headers: dict[str, str]) -> dict:
    return {
        "warc_type": kind,
        "record_id": record_id(kind, source["record_id"], digest(block)),
        "refers_to": source["record_id"],
        "target_uri": source["target_uri"],
        "warc_date": source["warc_date"],
        "content_type": content_type,
        "payload_digest": digest(block),
        "block_digest": digest(block),
        "content_length": len(block),
        "headers": headers,
        "block": block,
    }


def derivatives(source: dict) -> Iterator[dict]:
    """The metadata and the conversion record of one response row."""
    block = source["block"] or b""
    status, headers, body = split_message(block)
    kept = {k.lower(): v for k, v in headers}
    own = [(k, v) for k, values in (source.get("headers") or {}).items() for v in values.split("\n")]
    source = dict(source)
    source["payload_digest"] = source["payload_digest"] or digest(body)
    source["record_id"] = source["record_id"] or record_id("response", source["target_uri"] or "", digest(block))
    plain, stuck = unpacked(body, headers)
    page = decoded(plain, kept.get("content-type", ""))
    text, title, links = read_page(page)
    text = text.encode("utf-8", "replace")
    digests = [("WARC-Source-WARC-Payload-Digest", source["payload_digest"]), ("WARC-Source-WARC-Block-Digest", source["block_digest"] or digest(block))]
    carried = [(f"WARC-Source-{k}", v) for k, v in own + headers]
    conversion = _row("conversion", source, "text/plain; charset=utf-8", text, joined(digests + carried))
    fields = [("status", status)] if status else []
    fields += [(f"warc-{k}", v) for k, v in own] + [(f"header-{k}", v) for k, v in headers]
    fields += [("not-decoded", stuck)] if stuck else []
    fields += [
        ("title", title),
        ("conversion", conversion["record_id"]),
        ("source-payload-digest", source["payload_digest"]),
        ("source-block-digest", source["block_digest"] or digest(block)),
        ("source-length", str(len(block))),
        ("text-length", str(len(text))),
        *(("outlink", link) for link in links),
    ]
    lines = "".join(f"{k}: {' '.join(v.split())}\r\n" for k, v in fields)
    yield _row("metadata", source, "application/warc-fields", lines.encode(), {"WARC-Concurrent-To": conversion["record_id"]})
    yield conversion


def derive(responses: DataFrame) -> DataFrame:
    """Two linked records for each response row; rows of other types yield none. No shuffle."""
    common.prepare(responses.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for source in batch.to_pylist():
                source["headers"] = dict(source["headers"] or ())
                rows += derivatives(source)
            yield pa.RecordBatch.from_pylist([row | {"headers": list(row["headers"].items())} for row in rows], _FIELDS)

    names = [field.name for field in _FIELDS]
    return responses.filter("warc_type = 'response'").select(*names).mapInArrow(run, SCHEMA)


def responses(pages: DataFrame, date: str = NO_DATE) -> DataFrame:
    """Response records of a page table (url, html): each page as the body of an HTTP message."""
    common.prepare(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for url, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                body = page or b""
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n"
                block = head.encode() + body
                rows.append(
                    {
                        "warc_type": "response",
                        "record_id": record_id("response", url or "", digest(block)),
                        "refers_to": None,
                        "target_uri": url,
                        "warc_date": date,
                        "content_type": "application/http; msgtype=response",
                        "payload_digest": digest(body),
                        "block_digest": digest(block),
                        "content_length": len(block),
                        "headers": [],
                        "block": block,
                    }
                )
            yield pa.RecordBatch.from_pylist(rows, _FIELDS)

    return pages.select(F.col("url").cast("string"), F.col("html").cast("binary")).mapInArrow(run, SCHEMA)


def serialise(row: dict) -> bytes:
    """One record as a gzip member, as WARC files hold them one after another."""
    lines = [VERSION, f"WARC-Type: {row['warc_type']}", f"WARC-Record-ID: {row['record_id']}"]
    for name, key in (
        ("WARC-Refers-To", "refers_to"),
        ("WARC-Target-URI", "target_uri"),
        ("WARC-Date", "warc_date"),
        ("WARC-Payload-Digest", "payload_digest"),
        ("WARC-Block-Digest", "block_digest"),
        ("Content-Type", "content_type"),
    ):
        if row[key] is not None:
            lines.append(f"{name}: {row[key]}")
    lines += [f"{k}: {v}" for k, values in dict(row["headers"] or ()).items() for v in values.split("\n")]
    block = row["block"] or b""
    lines.append(f"Content-Length: {len(block)}")
    return gzip.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 6, mtime=0)


def _chunks(content: bytes) -> Iterator[bytes]:
    """The bytes of a WARC file, unpacked member by member; of a cut or damaged member what can be had."""
    view, at = memoryview(content), 0
    if content[:2] != b"\x1f\x8b":
        for at in range(0, len(view), CHUNK):
            yield bytes(view[at : at + CHUNK])
        return
    while at < len(view):
        tool = zlib.decompressobj(31)
        while not tool.eof:
            piece = tool.unconsumed_tail or view[at : at + CHUNK]
            at += 0 if tool.unconsumed_tail else len(piece)
            if not len(piece):
                return
            try:
                out = tool.decompress(piece, CHUNK)
            except zlib.error:
                return
            if out:
                yield out
        at -= len(tool.unused_data)
        while at < len(view) and view[at] == 0:  # padding between members
            at += 1


def parse(content: bytes) -> Iterator[dict]:
    """The records of one WARC file, gzipped or not, one at a time; a cut-off last record is left out."""
    chunks, held = _chunks(content), bytearray()

    def found(mark: bytes, start: int = 0) -> int:
        """Where a mark stands, reading on until it is there; -1 if it never is."""
        while (place := held.find(mark, start)) < 0:
            start = max(start, len(held) - len(mark) + 1)
            if not (more := next(chunks, b"")):
                return -1
            held.extend(more)
        return place

    while (start := found(b"WARC/")) >= 0:
        del held[:start]
        if (end := found(b"\r\n\r\n")) < 0:
            return
        fields: dict[str, list[tuple[str, str]]] = {}
        for line in held[:end].decode("utf-8", "replace").split("\r\n")[1:]:
            name, colon, value = line.partition(":")
            if colon:
                fields.setdefault(name.strip().lower(), []).append((name.strip(), value.strip()))

        def take(name: str) -> str | None:
            return fields.pop(name, [(None, None)])[-1][1]  # noqa: B023

        stated = take("content-length") or "0"
        length = int(stated) if stated.isascii() and stated.isdigit() else 0
        while len(held) < end + 4 + length:
            if not (more := next(chunks, b"")):
                return
            held.extend(more)
        block = bytes(held[end + 4 : end + 4 + length])
        del held[: end + 4 + length]
        row = {
            "warc_type": take("warc-type"),
            "record_id": take("warc-record-id"),
            "refers_to": take("warc-refers-to"),
            "target_uri": take("warc-target-uri"),
            "warc_date": take("warc-date"),
            "content_type": take("content-type"),
            "payload_digest": take("warc-payload-digest"),
            "block_digest": take("warc-block-digest"),
        }
        yield row | {"content_length": length, "headers": joined([p for pairs in fields.values() for p in pairs]), "block": block}


def read(files: DataFrame) -> DataFrame:
    """Record rows of WARC files, read as spark.read.format("binaryFile") gives them.

    A task holds one packed file, and of its records those of one batch.
    """
    common.prepare(files.sparkSession)
    rows_most, bytes_most = common.BATCH_ROWS, common.BATCH_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows, held = [], 0
                for row in parse(content.as_py() or b""):
                    rows.append(row | {"headers": list(row["headers"].items())})
                    held += row["content_length"]
                    if len(rows) == rows_most or held >= bytes_most:
                        yield pa.RecordBatch.from_pylist(rows, _FIELDS)
                        rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, _FIELDS)

    return files.select("content").mapInArrow(run, SCHEMA)


def gzipped(records: DataFrame) -> DataFrame:
    """Each record row as a gzip member in column member; members of a file are simply joined."""
    common.prepare(records.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            yield pa.RecordBatch.from_arrays(
                [pa.array([r["record_id"] for r in rows], pa.string()), pa.array([serialise(r) for r in rows], pa.binary())],
                ["record_id", "member"],
            )

    return records.select(*(f.name for f in _FIELDS)).mapInArrow(run, "record_id string, member binary")
