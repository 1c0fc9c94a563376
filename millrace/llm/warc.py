"""WARC derivatives: metadata and plain-text conversion records linked to the responses they were made from."""

from __future__ import annotations

import base64
import functools
import hashlib
import html as html_entities
import json
import re
import string
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VERSION, EPOCH = "WARC/1.1", "1970-01-01T00:00:00Z"
#: Elements whose content isn't text, and tags that begin or end a line.
SKIPPED = frozenset("script style noscript template".split())
BREAKS = frozenset(
    "address article aside blockquote br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr li main nav ol p pre "
    "section table tbody td tfoot th thead title tr ul".split()
)
NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)")
CLOSING = {name: re.compile(rf"</{name}(?![\w-])", re.I) for name in (*SKIPPED, "title")}
LEADS = frozenset(string.ascii_letters + "/!?")
HREF = re.compile(r"\shref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
CHARSET = re.compile(r"charset\s*=\s*[\"']?([\w.:-]+)", re.I)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


@functools.lru_cache(4096)
def tag_of(tag: str) -> tuple[bool, str]:
    """Whether a tag breaks the line, and its name if it opens an element that needs more than that."""
    name = m[1].lower() if (m := NAME.match(tag, 1)) else ""
    return name in BREAKS, name if tag[1] != "/" and (name == "a" or name in CLOSING) else ""


def scan(page: str) -> tuple[str, str | None, list[str]]:
    """The page's text, its title and the targets of its links, in one pass from tag to tag.

    Comments and the content of SKIPPED go; a line begins and ends at each tag of BREAKS; other tags go without a trace.
    Entities are resolved, white space is closed up. What is opened and never closed runs to the page's end, but an
    unclosed tag is text. Every search that fails is made once, so time grows with the page's length.
    """
    out, links, title, at, unclosed = [], [], None, 0, set()
    while (start := page.find("<", at)) >= 0:
        out.append(page[at:start])
        lead = page[start + 1 : start + 2]
        if lead == "!" and page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = len(page) if end < 0 else end + 3
            continue
        if lead not in LEADS:
            out.append("<")
            at = start + 1
            continue
        end = page.find(">", start)
        if end < 0:
            at = start
            break
        tag, at = page[start : end + 1], end + 1
        breaks, name = tag_of(tag) if len(tag) < 64 else tag_of.__wrapped__(tag)
        if breaks:
            out.append("\n")
        if not name or name in unclosed:
            continue
        if name == "a" and (m := HREF.search(tag)):
            links.append(html_entities.unescape(m[1] or m[2] or m[3] or ""))
        elif name != "a":
            close = CLOSING[name].search(page, at)
            if name in SKIPPED:
                at = close.start() if close else len(page)
            elif not close:
                unclosed.add(name)
            elif title is None:
                title = " ".join(html_entities.unescape(page[at : close.start()]).split())
    out.append(page[at:])
    lines = (" ".join(x.split()) for x in html_entities.unescape("".join(out)).split("\n"))
    return "\n".join(x for x in lines if x), title, [x for x in links if x]


def plain_text(page: str) -> str:
    return scan(page)[0]


def record(kind: str, record_id: str, date: str, content_type: str, block: bytes, **headers: str | None) -> bytes:
    """One record; headers with the value None are left out."""
    lines = [VERSION, f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id}", f"WARC-Date: {date}"]
    lines += [f"WARC-{k.replace('_', '-')}: {v}" for k, v in headers.items() if v is not None]
    lines += [f"WARC-Block-Digest: {digest(block)}", f"Content-Type: {content_type}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block


def header_pairs(lines: Iterable[str]) -> list[tuple[str, str]]:
    """(name, value) of header lines; one that begins with white space goes on with the one before, one without a colon is left out."""
    out: list[tuple[str, str]] = []
    for line in lines:
        name, colon, value = line.partition(":")
        if line[:1] in (" ", "\t") and out:
            out[-1] = (out[-1][0], f"{out[-1][1]} {line.strip()}")
        elif colon and name.strip():
            out.append((name.strip(), value.strip()))
    return out


def by_name(pairs: list[tuple[str, str]]) -> dict[str, str | list[str]]:
    """Headers by name; a repeated name has the list of its values."""
    out: dict = {}
    for name, value in pairs:
        out[name] = value if name not in out else [*(out[name] if isinstance(out[name], list) else [out[name]]), value]
    return out


def first(pairs: list[tuple[str, str]], name: str) -> str | None:
    """The first value of a header, whatever its name's case."""
    return next((v for k, v in pairs if k.lower() == name.lower()), None)


def records(data: bytes) -> Iterator[tuple[list[tuple[str, str]], bytes]]:
    """(headers, block) of each record of a file. What stands between records is passed over.

    A block without a sound length, or shorter than it, runs to the end of the data.
    """
    at = 0
    while (at := data.find(b"WARC/", at)) >= 0:
        end = data.find(b"\r\n\r\n", at)
        head = data[at : end if end >= 0 else len(data)]
        pairs = header_pairs(head.decode("utf-8", "replace").split("\r\n")[1:])
        start = end + 4 if end >= 0 else len(data)
        size = first(pairs, "Content-Length") or ""
        at = min(len(data), start + int(size)) if size.isascii() and size.isdigit() else len(data)
        yield pairs, data[start:at]


def parse(data: bytes) -> list[tuple[dict, bytes]]:
    return [(by_name(pairs), block) for pairs, block in records(data)]


def _dechunked(body: bytes) -> bytes:
    out, at = [], 0
    while (end := body.find(b"\r\n", at)) >= 0:
        size = int(body[at:end].split(b";")[0], 16)
        out.append(body[end + 2 : end + 2 + size])
        at = end + 4 + size
        if not size:
            break
    return b"".join(out)


def page_text(http: list[tuple[str, str]], body: bytes) -> str:
    """The page of a response's body: chunks joined, gzip and deflate undone, decoded by the charset that headers or page name, else UTF-8.

    What can't be undone stays as it is; bytes that can't be decoded become U+FFFD.
    """
    try:
        if (first(http, "Transfer-Encoding") or "").lower() == "chunked":
            body = _dechunked(body)
        kind = (first(http, "Content-Encoding") or "").lower()
        if kind in ("gzip", "x-gzip", "deflate"):
            body = zlib.decompress(body, 47 if "gzip" in kind else 15)
    except (ValueError, zlib.error):
        pass
    m = CHARSET.search(first(http, "Content-Type") or "") or CHARSET.search(body[:1024].decode("latin-1"))
    try:
        return body.decode(m[1] if m else "utf-8", "replace")
    except (LookupError, UnicodeError):
        return body.decode("utf-8", "replace")


def _id(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, json.dumps(parts))}>"


def response(page_id: object, url: str | None, page: str | None, date: str) -> bytes:
    """A response record of a page; a null page has an empty payload, a null URL no target."""
    payload = (page or "").encode()
    url = None if url is None else re.sub(r"[\r\n]+", " ", url)
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload
    return record("response", _id(page_id, url, digest(payload)), date, "application/http; msgtype=response", block, Target_URI=url, Payload_Digest=digest(payload))


def derive(source: bytes) -> Iterator[tuple[list[tuple[str, str]], bytes, bytes]]:
    """(headers, metadata record, conversion record) of each response record in the source; other records yield none."""
    for pairs, block in records(source):
        if (first(pairs, "WARC-Type") or "").lower() != "response":
            continue
        head, _, payload = block.partition(b"\r\n\r\n")
        status, *lines = head.decode("utf-8", "replace").split("\r\n")
        http = header_pairs(lines)
        text, title, links = scan(page_text(http, payload))
        own, date, url = (first(pairs, f"WARC-{n}") for n in ("Record-ID", "Date", "Target-URI"))
        own = own or _id("unnamed", digest(block))
        about = {"source": by_name(pairs), "status": status, "http": by_name(http), "title": title, "links": links}
        linked = {"Refers_To": own, "Refers_To_Date": date, "Refers_To_Target_URI": url, "Target_URI": url}
        data = json.dumps(about, ensure_ascii=False, sort_keys=True).encode("utf-8", "replace")
        yield (
            pairs,
            record("metadata", _id(own, "metadata"), date or EPOCH, "application/json", data, **linked),
            record("conversion", _id(own, "conversion"), date or EPOCH, "text/plain; charset=utf-8", text.encode("utf-8", "replace"), **linked, Source_Payload_Digest=first(pairs, "WARC-Payload-Digest")),
        )


def responses(pages: DataFrame, date: str = EPOCH) -> DataFrame:
    """(page_id, record binary): a response record of each page (page_id, url, html). Repeated rows give equal records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [response(*row, date) for row in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], ["page_id", "record"])

    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {dict(pages.dtypes)['page_id']}, record binary")


def derivatives(sources: DataFrame, id_col: str = "page_id") -> DataFrame:
    """Two rows for each response record in `record`: its metadata and its conversion, with parts of their headers and the whole record.

    A record column that holds several WARC records yields two rows for each response among them, one that is null none.
    """
    names = [id_col, "record_type", "record_id", "refers_to", "target_uri", "source_digest", "block_digest", "content_length", "record"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, source in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for pairs, *made in derive(source.as_py() or b""):
                    payload = first(pairs, "WARC-Payload-Digest")
                    for one in made:
                        ((h, _),) = records(one)
                        columns = [first(h, n) for n in ("WARC-Type", "WARC-Record-ID", "WARC-Refers-To", "WARC-Target-URI")]
                        rows.append((key, *columns, payload, first(h, "WARC-Block-Digest"), int(first(h, "Content-Length")), one.decode()))
            kinds = [batch.schema.field(0).type, *[pa.string()] * 6, pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    return sources.select(id_col, "record").mapInArrow(run, f"`{id_col}` {dict(sources.dtypes)[id_col]}, record_type string, record_id string, refers_to string, target_uri string, source_digest string, block_digest string, content_length bigint, record string")


def write_files(records: DataFrame, path: str) -> None:
    """The records as WARC files; each record is followed by two line breaks."""
    records.select(F.col("record").cast("string")).write.option("lineSep", "\r\n\r\n").text(path)


def read_files(records_path: str, spark) -> DataFrame:
    """(headers map, block string) of every record of the files of a folder; of a repeated header the first. A file must fit a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                rows = list(records(data.as_py()))
                yield pa.RecordBatch.from_arrays([pa.array([[*dict(reversed(h)).items()] for h, _ in rows], pa.map_(pa.string(), pa.string())), pa.array([b.decode("utf-8", "replace") for _, b in rows], pa.string())], ["headers", "block"])

    return spark.read.format("binaryFile").load(records_path).select("content").mapInArrow(run, "headers map<string,string>, block string")
