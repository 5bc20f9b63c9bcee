"""WARC derivatives: metadata and plain-text conversion records linked to the responses they come from.

`read_warc` walks WARC/1.0 and 1.1 files (gzip too, as Spark's text reader streams them) record by record; `responses` makes response
records from (page_id, url, html) rows; `derive` turns each response into a metadata and a conversion record that refer
to it by WARC-Refers-To, keep its target URI, date and payload digest, and carry digests of their own blocks;
`to_warc` gives their bytes in WARC/1.0 form. All steps but read_warc work row by row, so nothing is shuffled; it deals
the pieces of a file to one task, in order, since only the records before say where a record starts.

Chunked, gzip and deflate bodies are decoded for the conversion; a body in another coding has none, and the metadata
say so (source-undecoded). The metadata carry all HTTP headers (source-http-...) and, where records have headers, those
of the source record (source-record-...); its payload digest is kept as it is.

Defined results: a null url gives a record without target URI, a null html an empty payload; identifiers are made from
page id, url and payload, so reruns agree and rows that repeat get equal identifiers; a record without an id gives
records that refer to nothing, with identifiers made from its page id, URI and payload; a response without an HTTP
header has its whole block as payload; charsets that are unknown or can't decode the payload count as UTF-8, and what
can't be written as UTF-8 becomes a question mark; records of other types, where record_type is there, and records that
are cut short, where complete is there, are left out; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid
import zlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, table

#: What a response made from a page row says of its capture.
DATE = "1970-01-01T00:00:00Z"
SPACE_ID = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
BLOCK_TAG = re.compile(r"</?(?:p|div|br|li|ul|ol|h[1-6]|tr|table|article|section|header|footer|nav|title|blockquote|pre|hr)\b", re.I)
HIDDEN_START = re.compile(r"<!--|<(script|style|noscript|template)\b", re.I)
CLOSING = {name: re.compile(rf"</{name}\s*>", re.I) for name in ("script", "style", "noscript", "template", "title")}
TITLE_START, HTML_START, LINK_START = re.compile(r"<title\b", re.I), re.compile(r"<html\b", re.I), re.compile(r"<a\b", re.I)
LANG = re.compile(r"\blang\s*=\s*[\"']?([A-Za-z-]+)", re.I)
HREF_START = re.compile(r"\bhref\s*=", re.I)
HREF = re.compile(r"\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
#: Bytes that a compressed body may become; beyond, it counts as a coding that could not be undone.
MOST_INFLATED = 1 << 28
CHARSET = re.compile(rb"charset\s*=\s*[\"']?([\w-]+)", re.I)
FIELDS = (
    "page_id long, record_type string, record_id string, refers_to string, target_uri string, date string, content_type string, "
    "block_digest string, payload_digest string, content_length long, block string"
)


def digest(raw: bytes) -> str:
    """sha1 in base 32, as WARC writes it."""
    return "sha1:" + base64.b32encode(hashlib.sha1(raw).digest()).decode()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE_ID, chr(0).join(parts))}>"


# What follows reads markup forwards, by find() from one mark to the next: where a mark's end isn't found, no later one of
# its kind has an end either, so nothing is searched twice and time grows with the page's length alone.


def without_hidden(page: str) -> str:
    """Comments and elements that are not shown, each as a blank; those that are never closed stay."""
    out, at, search, dead = [], 0, 0, set()
    while found := HIDDEN_START.search(page, search):
        name = (found[1] or "").lower()
        search = found.end()
        if name in dead:
            continue
        if name:
            close = CLOSING[name].search(page, search)
            end = close.end() if close else -1
        else:
            end = page.find("-->", search)
            end = end + 3 if end >= 0 else -1
        if end < 0:
            dead.add(name)
            if len(dead) == 5:
                break
            continue
        out += page[at : found.start()], " "
        at = search = end
    out.append(page[at:])
    return "".join(out)


def without_tags(page: str) -> str:
    """Tags of blocks as line feeds, then without all others; what a tag's end is missing for stays."""
    out, at = [], 0
    while found := BLOCK_TAG.search(page, at):
        if (end := page.find(">", found.end())) < 0:
            break
        out += page[at : found.start()], "\n"
        at = end + 1
    out.append(page[at:])
    page, out, at = "".join(out), [], 0
    while (start := page.find("<", at)) >= 0 and (end := page.find(">", start)) >= 0:
        out.append(page[at:start])
        at = end + 1
    out.append(page[at:])
    return "".join(out)


def title_of(page: str) -> str:
    found = TITLE_START.search(page)
    start = page.find(">", found.end()) if found else -1
    close = CLOSING["title"].search(page, start + 1) if start >= 0 else None
    return " ".join(html.unescape(page[start + 1 : close.start()]).split()) if close else ""


def language_of(page: str) -> str:
    """The last lang of the first html tag that has one."""
    at = 0
    while found := HTML_START.search(page, at):
        end = page.find(">", found.end())
        stop = end if end >= 0 else len(page)
        if every := LANG.findall(page, found.end(), stop):
            return every[-1].lower()
        at = stop  # tags that begin before this end have no more than this one
    return ""


def links_of(page: str) -> list[str]:
    """The last href of each link's tag."""
    out, at = [], 0
    while found := LINK_START.search(page, at):
        end = page.find(">", found.end())
        stop = end if end >= 0 else len(page)
        starts = [m.start() for m in HREF_START.finditer(page, found.end(), stop)]
        value = next((v for s in reversed(starts) if (v := HREF.match(page, s))), None)
        at = value.end() if value else max(stop, found.end())
        if value:
            out.append(html.unescape(value[1] or value[2] or value[3] or ""))
    return out


def text_of(page: str) -> str:
    """The page's text: a line for each block, no markup, scripts, styles or comments."""
    lines = (" ".join(x.split()) for x in html.unescape(without_tags(without_hidden(page))).split("\n"))
    return "\n".join(x for x in lines if x)


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """(header, payload) of an HTTP response; no header if it doesn't start like one."""
    if not block.startswith(b"HTTP/"):
        return b"", block
    head, gap, body = block.partition(b"\r\n\r\n")
    return head + gap, body


def header_lines(head: bytes) -> list[tuple[str, str]]:
    """(name in small letters, value) of header lines; lines that begin with white space go on with the one before."""
    out: list[tuple[str, str]] = []
    for line in head.decode("utf-8", "replace").split("\r\n"):
        if line[:1] in (" ", "\t") and out:
            out[-1] = out[-1][0], f"{out[-1][1]} {line.strip()}".strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            out.append((name.strip().lower(), value.strip()))
    return out


def unchunked(body: bytes) -> bytes:
    """The chunks joined; the body itself if it isn't chunked, as archives that store decoded bodies have it."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        size = body[at:end].split(b";")[0].strip() if end >= 0 else b""
        if not re.fullmatch(rb"[0-9A-Fa-f]+", size):
            return b"".join(out) if out else body
        n = int(size, 16)
        if not n:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + n])
        at = end + 2 + n + 2


def inflated(body: bytes, coding: str, most: int = MOST_INFLATED) -> bytes | None:
    """The body decoded, members one after another; as it is if it isn't so coded; None if it would be longer than most."""
    out, held = [], 0
    try:
        while body:
            wide = 31 if coding.endswith("gzip") else 15 if body[0] & 15 == 8 and int.from_bytes(body[:2]) % 31 == 0 else -15
            one = zlib.decompressobj(wide)
            out.append(one.decompress(body, most - held + 1))
            held += len(out[-1])
            if held > most:
                return None
            body = one.unused_data
    except zlib.error:
        pass  # what follows a sound member is padding
    return b"".join(out) if out else body


def decoded(header: bytes, payload: bytes) -> tuple[bytes, str]:
    """(payload without transfer and content codings, the coding that could not be undone)."""
    fields = header_lines(header)
    for name in ("transfer-encoding", "content-encoding"):
        codings = [c.strip().lower() for k, v in fields if k == name for c in v.split(",")]
        for coding in reversed(codings):
            if coding == "chunked":
                payload = unchunked(payload)
            elif coding in ("gzip", "x-gzip", "deflate"):
                if (payload := inflated(payload, coding)) is None:
                    return b"", f"{coding} of over {MOST_INFLATED} bytes"
            elif coding not in ("", "identity"):
                return b"", coding
    return payload, ""


def decode(header: bytes, payload: bytes) -> str:
    named = CHARSET.search(header) or CHARSET.search(payload[:2048])
    try:
        text = payload.decode(named[1].decode() if named else "utf-8", "replace")
    except (LookupError, ValueError):  # not a charset of texts, or one that knows no replacing
        text = payload.decode("utf-8", "replace")
    return text.encode("utf-8", "replace").decode() if named else text  # some charsets can give half characters


def responses(pages: DataFrame, date: str = DATE) -> DataFrame:
    """page_id, record_id, target_uri, date, block: a response record for each page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, blocks = [], []
            for page, url, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                payload = (body or "").encode()
                ids.append(record_id("response", str(page), url or "", hashlib.sha1(payload).hexdigest()))
                blocks.append(b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload)
            yield pa.record_batch(
                [batch.column(0), pa.array(ids, pa.string()), batch.column(1), pa.array([date] * len(ids), pa.string()), pa.array(blocks, pa.binary())],
                names=["page_id", "record_id", "target_uri", "date", "block"],
            )

    bounded_batches(pages.sparkSession)
    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(run, "page_id long, record_id string, target_uri string, date string, block binary")


def derived(page: int | None, source: str | None, uri: str | None, date: str | None, block: bytes, headers: str | None = None) -> list[tuple]:
    """The two records of one response, as rows of FIELDS; headers are the WARC header lines of the source."""
    header, payload = split_http(block)
    record = header_lines((headers or "").encode())
    of_payload = dict(record).get("warc-payload-digest") or digest(payload)
    body, undecoded = decoded(header, payload)
    text = decode(header, body)
    plain = text_of(text)
    facts = {
        "source-content-type": next((x.partition(":")[2].strip() for x in header.decode("latin-1").split("\r\n") if x.lower().startswith("content-type:")), ""),
        "source-status": header.split(b"\r\n", 1)[0].decode("latin-1"),
        "source-length": str(len(payload)),
        "title": title_of(text),
        "languages": language_of(text),
        "text-length": str(len(plain)),
    }
    if undecoded:
        facts["source-undecoded"] = undecoded
    carried = [f"source-http-{k}: {v}" for k, v in header_lines(header.partition(b"\r\n")[2])] + [f"source-record-{k}: {v}" for k, v in record]
    links = ["outlink: " + link for link in links_of(without_hidden(text))]
    out = []
    for kind, mime, body in (("metadata", "application/warc-fields", "".join(f"{k}: {v}\r\n" for k, v in facts.items()) + "".join(f"{x}\r\n" for x in carried + links)), ("conversion", "text/plain", plain)):
        raw = body.encode()
        out.append((page, kind, record_id(kind, source or f"{page} {uri} {digest(payload)}"), source, uri, date, mime, digest(raw), of_payload, len(raw), body))
    return out


def derive(records: DataFrame) -> DataFrame:
    """Two rows of FIELDS for each response: page_id, record_id, target_uri, date, block; headers, record_type, complete if there."""
    if "record_type" in records.columns:
        records = records.where(F.lower("record_type") == "response")
    if "complete" in records.columns:
        records = records.where("complete")
    headers = F.col("headers") if "headers" in records.columns else F.lit(None).cast("string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in FIELDS.split(", ")]
        kinds = [pa.int64() if f.endswith("long") else pa.string() for f in FIELDS.split(", ")]
        for batch in batches:
            for at in range(0, len(batch), 500):
                rows = [x for r in zip(*(c.to_pylist() for c in batch.slice(at, 500).columns), strict=True) for x in derived(*r)]
                yield pa.record_batch([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    return records.select("page_id", "record_id", "target_uri", "date", F.coalesce("block", F.lit(b"")).alias("block"), headers.alias("headers")).mapInArrow(run, FIELDS)


def to_warc() -> Column:
    """The bytes of a derived record."""
    optional = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(name + ": "), value, F.lit("\r\n"))).otherwise("")
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: "), F.col("record_type"), F.lit("\r\nWARC-Record-ID: "), F.col("record_id"), F.lit("\r\n"), optional("WARC-Refers-To", F.col("refers_to")),
        optional("WARC-Target-URI", F.col("target_uri")), optional("WARC-Date", F.col("date")),
        F.lit("WARC-Block-Digest: "), F.col("block_digest"), F.lit("\r\nWARC-Payload-Digest: "), F.col("payload_digest"),
        F.lit("\r\nContent-Type: "), F.col("content_type"), F.lit("\r\nContent-Length: "), F.col("content_length").cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(head.cast("binary"), F.col("block").cast("binary"), F.lit(b"\r\n\r\n"))


VERSION = b"WARC/1."
START = re.compile(rb"WARC/1\.[01]\r\n")
NAMES = ("warc-record-id", "warc-type", "warc-refers-to", "warc-target-uri", "warc-date")


def walk(pieces: Iterator[bytes]) -> Iterator[tuple]:
    """(names' values, headers, block, complete) of a file's records from the pieces between its version marks.

    Pieces are joined until a record has its Content-Length, so marks in headers or payloads cut nothing. A record
    without a length, or for which the file is too short, is given as its own piece and not complete; the walk then
    goes on with the piece after it.
    """
    waiting: list[bytes] = []
    source, ended = iter(pieces), False
    while True:
        if not waiting:
            if ended or (first := next(source, None)) is None:
                return
            waiting.append(first)
        used, whole, need, at = 1, bytearray(VERSION + waiting[0]), None, -1
        if START.match(whole):
            while True:
                if at < 0 and (at := whole.find(b"\r\n\r\n")) >= 0:
                    fields = dict(reversed(header_lines(bytes(whole[:at]).partition(b"\r\n")[2])))
                    size = fields.get("content-length", "")
                    if not re.fullmatch("[0-9]+", size):
                        break
                    need = at + 4 + int(size)
                if need is not None and len(whole) >= need:
                    break
                if used == len(waiting):
                    if (more := next(source, None)) is None:
                        ended = True
                        break
                    waiting.append(more)
                whole += VERSION + waiting[used]
                used += 1
        complete = need is not None and len(whole) >= need
        if not complete:
            used, whole = 1, bytearray(VERSION + waiting[0])
            at = whole.find(b"\r\n\r\n")
            need = len(whole)
        head = bytes(whole[:at] if at >= 0 else b"").partition(b"\r\n")[2]
        fields = dict(reversed(header_lines(head)))
        if complete or at >= 0:
            yield (*(fields.get(n) for n in NAMES), head.decode("utf-8", "replace"), bytes(whole[at + 4 : need]), complete)
        del waiting[:used]


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """page_id (null), record_id, record_type, refers_to, target_uri, date, headers, block, complete of the records of WARC files."""
    cut = spark.read.option("lineSep", VERSION.decode()).text(path)
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("n")]
    raw = cut.select(*place, F.col("value").cast("binary").alias("raw")).repartition("file").sortWithinPartitions("file", "start", "n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((f, x) for batch in batches for f, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        names = ["record_id", "record_type", "refers_to", "target_uri", "date", "headers", "block", "complete"]
        kinds = [pa.string()] * 6 + [pa.binary(), pa.bool_()]
        ready = lambda out: pa.record_batch([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=names)
        out, held = [], 0
        for _, group in groupby(rows, key=lambda r: r[0]):
            next(group)  # what stands before the first mark
            for record in walk(x for _, x in group):
                out.append(record)
                held += len(record[-2])
                if held > 1 << 24 or len(out) >= 1000:
                    yield ready(out)
                    out, held = [], 0
        yield ready(out)

    fields = "record_id string, record_type string, refers_to string, target_uri string, date string, headers string, block binary, complete boolean"
    return raw.select("file", "raw").mapInArrow(run, fields).withColumn("page_id", F.lit(None).cast("long"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(responses(table(spark, sf_dir, "pages")))
