"""WARC derivatives: responses into linked metadata and plain-text conversion records.

Every response yields a metadata record (its HTTP status and headers, title, links and counts as
application/warc-fields) and a conversion record (its text as text/plain). Both name the response in WARC-Refers-To, keep its
target URI and date, and carry its digests next to their own; the metadata record also names the conversion. Record ids are
derived from the response's, so a task that runs again writes the same records.
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionscope.llm.markup import blocks

DERIVED = "record_type string, record_id string, refers_to string, target_uri string, warc_date string, content_type string, block_digest string, payload_digest string, source_block_digest string, source_payload_digest string, n_bytes long, n_chars long, headers string, block string"
_ARROW = pa.schema([(c.split()[0], pa.int64() if c.endswith("long") else pa.string()) for c in DERIVED.split(", ")])
_LINK = re.compile(r"""<a\s[^>]*?href\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_TITLE = re.compile(r"<title[^>]*>(.*?)</title", re.I | re.S)
#: Ends a record; also the line separator of a WARC file read or written as text.
RECORD_END = "\r\n\r\n"


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def derived_id(record_id: str, kind: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{record_id}#{kind}')}>"


def http_parts(block: str) -> tuple[str, list[tuple[str, str]], str]:
    """(status line, headers, payload) of a response block; a block without an HTTP head is all payload."""
    head, gap, payload = block.partition(RECORD_END)
    if not gap or not head.startswith("HTTP/"):
        return "", [], block
    status, *lines = head.split("\r\n")
    return status, [(name.strip(), value.strip()) for name, colon, value in (line.partition(":") for line in lines) if colon], payload


def _line(value: str) -> str:
    return " ".join(value.split())


def _record(kind: str, content_type: str, block: str, source: dict, links: list[tuple[str, str]]) -> dict:
    data = block.encode()
    out = {"record_type": kind, "record_id": derived_id(source["record_id"], kind), "refers_to": source["record_id"], "target_uri": source["target_uri"], "warc_date": source["warc_date"],
           "content_type": content_type, "block_digest": digest(data), "payload_digest": digest(data), "source_block_digest": source["block_digest"],
           "source_payload_digest": source["payload_digest"], "n_bytes": len(data), "n_chars": len(block), "block": block}
    fields = [("WARC-Type", kind), ("WARC-Record-ID", out["record_id"]), ("WARC-Refers-To", out["refers_to"]), ("WARC-Target-URI", out["target_uri"]), ("WARC-Date", out["warc_date"]), *links,
              ("WARC-Block-Digest", out["block_digest"]), ("WARC-Payload-Digest", out["payload_digest"]), ("Content-Type", content_type), ("Content-Length", str(len(data)))]
    out["headers"] = "WARC/1.1\r\n" + "".join(f"{k}: {_line(v)}\r\n" for k, v in fields if v is not None)
    return out


def recorded_headers(text: str | None) -> list[tuple[str, str]]:
    """(name, value) of a record's own WARC headers, in order; a version line and lines without a colon are no headers."""
    return [(name.strip(), value.strip()) for name, colon, value in (line.partition(":") for line in (text or "").splitlines()) if colon and name.strip()]


def derive(record_id: str, target_uri: str | None, warc_date: str | None, block: str | None, recorded: str | None = None) -> list[dict]:
    """The metadata and the conversion record of one response. Of ``recorded``, its WARC headers as text, the digests are the source
    digests as they stand, whatever their algorithm; only missing ones are computed. All of them are kept in the metadata."""
    block = block or ""
    status, http_headers, payload = http_parts(block)
    own = recorded_headers(recorded)
    known = {name.lower(): value for name, value in reversed(own)}
    source = {"record_id": record_id, "target_uri": target_uri, "warc_date": warc_date, "block_digest": known.get("warc-block-digest") or digest(block.encode()),
              "payload_digest": known.get("warc-payload-digest") or digest(payload.encode())}
    text = "\n".join(t for t, _ in blocks(payload))
    title = _TITLE.search(payload)
    fields = [("httpStatus", status), *[(f"sourceHeader-{k}", v) for k, v in http_headers], *[(f"sourceRecord-{k}", v) for k, v in own], ("title", html.unescape(title[1]) if title else ""),
              ("sourceBlockDigest", source["block_digest"]), ("sourcePayloadDigest", source["payload_digest"]), ("payloadLength", str(len(payload.encode()))), ("textLength", str(len(text)))]
    fields += [("outlink", html.unescape(x.strip("\"'"))) for x in _LINK.findall(payload)]
    body = "".join(f"{k}: {_line(v)}\r\n" for k, v in fields if _line(v))
    return [_record("metadata", "application/warc-fields", body, source, [("WARC-Concurrent-To", derived_id(record_id, "conversion"))]),
            _record("conversion", "text/plain; charset=utf-8", text, source, [])]


def build_derivatives(records: DataFrame, record_id: str = "record_id", record_type: str = "record_type", target_uri: str = "target_uri", warc_date: str = "warc_date", block: str = "block", recorded: str | None = None) -> DataFrame:
    """Two rows (columns of DERIVED) for every response of ``records``, without a shuffle. ``recorded`` names a column with the
    WARC headers of the source records as text, if there is one: their digests become the source digests unchanged, and every header is kept
    in the metadata record (``sourceRecord-<name>``).

    Nulls and edges: rows of another or no type, and responses without a record id (nothing could refer to them), yield
    nothing; a null or empty block gives an empty conversion and the digests of empty data; a null URI or date leaves out that header; without
    recorded headers, or where they hold no digest, the source digest is the SHA-1 of the block or payload as UTF-8;
    a repeated response yields its records again, with the same ids; other columns are ignored.
    """
    rows = records.where((records[record_type] == "response") & records[record_id].isNotNull()).select(records[record_id].cast("string").alias("i"), records[target_uri].cast("string").alias("u"), records[warc_date].cast("string").alias("d"), records[block].cast("string").alias("b"),
        (F.lit(None) if recorded is None else records[recorded]).cast("string").alias("h"))

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                out = [r for row in whole.slice(at, 256).to_pylist() for r in derive(row["i"], row["u"], row["d"], row["b"], row["h"])]
                yield pa.RecordBatch.from_pylist(out, schema=_ARROW)
    return rows.mapInArrow(run, DERIVED)


def write_warc(derived: DataFrame, path: str, compression: str = "gzip") -> None:
    """Write records as WARC/1.1 files through Spark's text writer: a record ends with two line ends, which serve as separator."""
    (derived.select(F.concat("headers", F.lit("\r\n"), "block").alias("value")).write.option("lineSep", RECORD_END).option("compression", compression).text(path))


def responses_from_pages(pages: DataFrame) -> DataFrame:
    """Response records that follow from a table of pages: id from page id and URL, fetch time from the page id, the html as payload."""
    key = F.md5(F.concat(F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit("|"), F.coalesce("url", F.lit(""))))
    dashed = F.concat_ws("-", *[F.substring(key, i, n) for i, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    payload = F.coalesce("html", F.lit(""))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(payload).cast("string"), F.lit(RECORD_END))
    seconds = F.lit(1704067200) + F.coalesce(F.col("page_id"), F.lit(0)) * 61 % 31536000
    return pages.select("page_id", F.lit("response").alias("record_type"), F.concat(F.lit("<urn:uuid:"), dashed, F.lit(">")).alias("record_id"), F.col("url").alias("target_uri"),
                        F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("warc_date"), F.concat(head, payload).alias("block"))
