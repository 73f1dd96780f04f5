"""WARC derivatives: linked metadata and plain-text conversion records from response records.

For each response record two records are made: a conversion record with the page's text
and a metadata record with what was known of the source.  Both refer to the response by
its record id, name its target and date, and carry its digests and HTTP headers; the
metadata record also names the conversion record.  Record ids are name-based UUIDs of the
source's id, so a rerun or a lost executor makes the same records again.

Header names are compared without regard to case, as the format has it, and a header that
comes several times is kept with all its values, in the source's order.

Defined results: a null page is an empty payload, with an empty conversion record; a null
address gives no WARC-Target-URI; a record that cannot be parsed or is no response gives
one metadata record that says so and no conversion; a page of any length is converted
whole; rows are independent, so there are no ties; a record id names the page's id, address
and content, so equal rows are one record twice, with equal derivatives, and different
pages never share one; further columns are ignored, whatever their names; an empty table
gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

VERSION = "WARC/1.1"
DATE = "1970-01-01T00:00:00Z"
_SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:agentlake:warc")
_TAG = re.compile(r"<(?:(!--)|(/?)([a-zA-Z][a-zA-Z0-9]*))")
_SKIPPED = {n: re.compile(f"</{n}", re.I) for n in ("script", "style", "noscript", "template")}
_INLINE = frozenset("a abbr b bdi bdo cite code data dfn em i img kbd label mark q s samp small span strong sub sup time u var wbr font".split())


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, chr(31).join(parts))}>"


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def serialize(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {_one_line(v)}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    return f"{VERSION}\r\n{head}\r\n".encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def _one_line(value: str) -> str:
    return value.replace("\r", " ").replace("\n", " ")


class Headers(list):
    """(name, value) pairs in order; looked up by name in any case, the first of several."""

    def get(self, name: str, default: str | None = None) -> str | None:
        return next((v for k, v in self if k.lower() == name.lower()), default)

    def __getitem__(self, name):
        if not isinstance(name, str):
            return super().__getitem__(name)
        if (found := self.get(name)) is None:
            raise KeyError(name)
        return found


def pairs(lines: list[str], strict: bool) -> Headers:
    """Header lines as pairs; a line that begins with white space goes on with the one before."""
    out = Headers()
    for line in lines:
        name, colon, value = line.partition(":")
        if line[:1] in (" ", "\t") and out:
            out[-1] = (out[-1][0], f"{out[-1][1]} {line.strip()}".strip())
        elif colon:
            out.append((name.strip(), value.strip()))
        elif strict:
            raise ValueError("header line without a colon")
    return out


def parse(record: bytes) -> tuple[Headers, bytes]:
    """(headers, block) of a record; ValueError if it is none."""
    head, found, rest = record.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not found or not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = pairs(lines[1:], strict=True)
    size = int(headers.get("Content-Length", ""))
    if size < 0 or len(rest) < size:
        raise ValueError("block shorter than Content-Length")
    return headers, rest[:size]


def response(page_id: object, url: str | None, page: str | None, date: str = DATE) -> bytes:
    """A response record of a page as an HTTP message."""
    payload = (page or "").encode("utf-8", "surrogatepass")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload
    headers = [("WARC-Type", "response"), ("WARC-Record-ID", record_id("response", str(page_id), url or "", digest(payload))), ("WARC-Date", date)]
    headers += [("WARC-Target-URI", url)] * (url is not None)
    headers += [("WARC-Block-Digest", digest(http)), ("WARC-Payload-Digest", digest(payload)), ("Content-Type", "application/http; msgtype=response")]
    return serialize(headers, http)


def to_text(page: str) -> str:
    """The page's text: one line for each run of inline content, in one pass from left to right."""
    out, pos = [], 0
    while (i := page.find("<", pos)) >= 0:
        tag = _TAG.match(page, i)
        if tag is None and not page.startswith(("<!", "<?"), i):
            out.append(page[pos : i + 1])  # a sign, not a tag
            pos = i + 1
            continue
        out.append(page[pos:i])
        stop = page.find("-->", i + 4) + 3 if tag and tag[1] else page.find(">", i) + 1
        pos = stop if stop > i else len(page)
        if tag and tag[3]:
            name = tag[3].lower()
            if not tag[2] and name in _SKIPPED:
                close = _SKIPPED[name].search(page, pos)
                end = page.find(">", close.end()) + 1 if close else 0
                pos = end or len(page)
            if name not in _INLINE:
                out.append("\n")
    else:
        out.append(page[pos:])
    lines = (" ".join(x.split()) for x in html.unescape("".join(out)).split("\n"))
    return "\n".join(x for x in lines if x)


def derive(record: bytes | None) -> list[dict]:
    """The derivative records of one record."""
    try:
        headers, block = parse(record or b"")
        source = headers.get("WARC-Record-ID", "")
        if (headers.get("WARC-Type") or "").lower() != "response":
            raise ValueError(f"no response but {headers.get('WARC-Type') or 'untyped'}")
    except ValueError as e:
        source = record_id("unparsed", hashlib.sha256(record or b"").hexdigest())
        return [_made("metadata", source, None, None, None, f"error: {e}\r\n", "application/warc-fields", [])]
    head, _, payload = block.partition(b"\r\n\r\n")
    status, *lines = head.decode("iso-8859-1").split("\r\n")
    http = pairs(lines, strict=False)
    kind = http.get("Content-Type", "")
    charset = re.search(r"charset=[\"']?([\w.:-]+)", kind, re.I)
    try:
        page = payload.decode(charset[1] if charset else "utf-8", "replace")
    except LookupError:
        page = payload.decode("utf-8", "replace")
    text = to_text(page)
    url, date = headers.get("WARC-Target-URI"), headers.get("WARC-Date")
    payload_digest = headers.get("WARC-Payload-Digest") or digest(payload)
    conversion = record_id("conversion", source)
    known = [("Source-Block-Digest", headers.get("WARC-Block-Digest") or digest(block)), ("Source-Payload-Digest", payload_digest)]
    fields = [("source-record-id", source), *((f"source-{k.lower()}", v) for k, v in headers), ("http-status", status), *((f"http-{k.lower()}", v) for k, v in http), ("conversion-record-id", conversion), ("text-digest", digest(text.encode("utf-8", "surrogatepass")))]
    body = "".join(f"{k}: {_one_line(v)}\r\n" for k, v in fields)
    return [
        _made("metadata", source, url, date, payload_digest, body, "application/warc-fields", [*known, ("WARC-Concurrent-To", conversion)]),
        _made("conversion", source, url, date, payload_digest, text, "text/plain; charset=utf-8", known),
    ]


def _made(kind: str, source: str, url: str | None, date: str | None, payload_digest: str | None, block: str, content_type: str, more: list[tuple[str, str]]) -> dict:
    data = block.encode("utf-8", "surrogatepass")
    own = record_id(kind, source)
    headers = [("WARC-Type", kind), ("WARC-Record-ID", own), ("WARC-Refers-To", source), *([("WARC-Target-URI", url)] if url else []), ("WARC-Date", date or DATE), ("WARC-Block-Digest", digest(data)), ("Content-Type", content_type), *more]
    return {"warc_type": kind, "record_id": own, "refers_to": source, "target_uri": url, "source_payload_digest": payload_digest, "block_digest": digest(data), "content_length": len(data), "block": data.decode("utf-8", "replace"), "record": serialize(headers, data)}


_DERIVED = {"warc_type": pa.string(), "record_id": pa.string(), "refers_to": pa.string(), "target_uri": pa.string(), "source_payload_digest": pa.string(), "block_digest": pa.string(), "content_length": pa.int64(), "block": pa.string(), "record": pa.binary()}


def responses(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, record): pages as WARC response records."""
    common.ship(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, urls, texts = (batch.column(k).to_pylist() for k in range(3))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([response(*x) for x in zip(ids, urls, texts, strict=True)], pa.binary())], names=[id_col, "record"])

    return pages.select(id_col, url_col, html_col).mapInArrow(run, f"`{id_col}` {pages.schema[id_col].dataType.simpleString()}, record binary")


def derivatives(records: DataFrame, id_col: str = "page_id", record_col: str = "record") -> DataFrame:
    """Two rows for each response: id, the derivative's main headers, its block and the whole record."""
    common.ship(records.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):  # bounded output batches
                part = batch.slice(at, 256)
                place, rows = [], []
                for k, record in enumerate(part.column(1).to_pylist()):
                    made = derive(record)
                    rows += made
                    place += [k] * len(made)
                columns = [part.column(0).take(pa.array(place, pa.int64())), *(pa.array([r[c] for r in rows], t) for c, t in _DERIVED.items())]
                yield pa.RecordBatch.from_arrays(columns, names=[id_col, *_DERIVED])

    schema = f"`{id_col}` {records.schema[id_col].dataType.simpleString()}, warc_type string, record_id string, refers_to string, target_uri string, source_payload_digest string, block_digest string, content_length long, block string, record binary"
    return records.select(id_col, record_col).mapInArrow(run, schema)
