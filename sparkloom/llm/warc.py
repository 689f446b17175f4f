"""WARC archives: a writer, and a sequential reader that trusts nothing.

Every record is a gzip member of its own.  The reader takes the file in small
pieces through an incremental zlib decompressor, frames a record by its
Content-Length, and checks block and payload digests, so memory holds one
record and damage is reported where it is.

Of records with equal payloads of at least ``least`` bytes the one with the
largest page_id is a response and the others are revisits that refer to it.
Defined cases: a null html is the empty payload; a null page_id sorts below
all others, so it revisits an equal page that has an id; equal rows that tie on
the largest page_id are all responses; payloads of any length are written
whole; repeated rows are written each; an empty table writes no archive and
reads back as no rows; columns beyond page_id, url and html are not read.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import storage
from sparkloom.runtime import materialize, shared_path, ship

PIECE = 1 << 16
FILE_BYTES = 256 << 20
VERSION = b"WARC/1.1"
SALTS = 16


class WarcError(ValueError):
    pass


def _b32(digest: bytes) -> str:
    return "sha1:" + base64.b32encode(digest).decode()


def record(fields: list[tuple[str, str]], block: bytes, level: int = 6) -> bytes:
    """One record as a gzip member."""
    head = VERSION + b"\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in fields)
    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
    return pack.compress(head + f"Content-Length: {len(block)}\r\n\r\n".encode()) + pack.compress(block + b"\r\n\r\n") + pack.flush()


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, is_revisit: bool, level: int = 6) -> bytes:
    name = lambda i: f"<urn:page:{'null' if i is None else i}>"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http if is_revisit else http + payload
    target = (url or "about:blank").translate({10: "%0A", 13: "%0D"})
    fields = [
        ("WARC-Type", "revisit" if is_revisit else "response"),
        ("WARC-Record-ID", name(page_id)),
        ("WARC-Target-URI", target),
        ("WARC-Date", "2024-01-01T00:00:00Z"),
        ("Content-Type", "application/http;msgtype=response"),
        ("WARC-Block-Digest", _b32(hashlib.sha1(block).digest())),
        ("WARC-Payload-Digest", _b32(hashlib.sha1(payload).digest())),
        ("X-Payload-Length", str(len(payload))),
    ]
    if is_revisit:
        fields += [("WARC-Refers-To", name(refers_to)), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    return record(fields, block, level)


def read_records(stream, piece: int = PIECE) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of each member, in file order."""
    waiting = b""
    while True:
        waiting = waiting or stream.read(piece)
        if not waiting:
            return
        inflate = zlib.decompressobj(31)
        data, fields, start, size = bytearray(), None, 0, 0
        while not inflate.eof:
            if not waiting:
                waiting = stream.read(piece)
                if not waiting:
                    raise WarcError("the archive ends within a record")
            try:  # a piece at most comes out, however well it was packed
                data += inflate.decompress(waiting, piece)
            except zlib.error as bad:
                raise WarcError(f"damaged member: {bad}") from bad
            waiting = inflate.unconsumed_tail
            if fields is None and (start := data.find(b"\r\n\r\n") + 4) >= 4:
                lines = bytes(data[: start - 4]).split(b"\r\n")
                if lines[0] != VERSION:
                    raise WarcError("not a WARC record")
                try:
                    fields = {k.strip().lower(): v.strip() for k, _, v in (x.decode().partition(":") for x in lines[1:])}
                    size = int(fields["content-length"])
                except (KeyError, ValueError) as bad:
                    raise WarcError(f"damaged header: {bad}") from bad
                if size < 0:
                    raise WarcError("damaged header: negative length")
            if fields is not None and len(data) > start + size + 4:
                raise WarcError("a record is longer than its Content-Length")
        waiting = inflate.unused_data
        if fields is None or len(data) != start + size + 4 or data[-4:] != b"\r\n\r\n":
            raise WarcError("a record is shorter than its Content-Length")
        block = bytes(data[start : start + size])
        if "warc-block-digest" in fields and fields["warc-block-digest"] != _b32(hashlib.sha1(block).digest()):
            raise WarcError("block digest differs")
        yield fields, block


def parse_page(fields: dict[str, str], block: bytes) -> dict:
    """The page of a response or revisit record; a response's payload is verified."""
    try:
        return _page(fields, block)
    except WarcError:
        raise
    except (KeyError, ValueError) as bad:
        raise WarcError(f"damaged header: {bad}") from bad


def _page(fields: dict[str, str], block: bytes) -> dict:
    number = lambda s: None if s == "<urn:page:null>" else int(s.removeprefix("<urn:page:").rstrip(">"))
    payload = block[block.index(b"\r\n\r\n") + 4 :]
    digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:"))
    kind = fields["warc-type"]
    if kind == "response" and (hashlib.sha1(payload).digest() != digest or len(payload) != int(fields["x-payload-length"])):
        raise WarcError("payload digest differs")
    return {
        "page_id": number(fields["warc-record-id"]),
        "payload_bytes": int(fields["x-payload-length"]),
        "payload_digest": digest.hex(),
        "record_type": kind,
        "refers_to": number(fields["warc-refers-to"]) if kind == "revisit" else None,
        "payload": payload if kind == "response" else None,
    }


_FILES = pa.schema([("uri", pa.string()), ("n_records", pa.int64())])


def write_archives(pages: DataFrame, least: int = 1000, level: int = 6) -> DataFrame:
    """Writes ``pages(page_id, url, html)``; the list (uri, n_records) is stored.

    Digests are compared as narrow rows; the pages are read a second time to
    meet the page they refer to.  Only payloads that may be revisits are looked
    up, and a payload that very many pages share does not gather them in a task.
    """
    spark = pages.sparkSession
    ship(spark)
    folder = shared_path(spark, "warc")
    base = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    base = base.withColumn("_digest", F.sha1(F.col("html").cast("binary"))).withColumn("_bytes", F.octet_length("html"))
    large = F.col("_bytes") >= least
    firsts = base.where(large).groupBy("_digest").agg(F.max("page_id").alias("_first"), F.count("*").alias("n"))
    firsts = materialize(firsts.where("n > 1"), "warc-firsts")
    shared = firsts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # A small page has a key of its own, so it meets nothing and gathers nowhere.
    key = F.when(large, F.col("_digest")).otherwise(F.concat(F.lit("-"), F.xxhash64("page_id", "url")))
    looked = base.withColumn("_key", key).withColumn("_salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)))
    bound = max(1000, shared // 100_000)
    spread = firsts.where(F.col("n") <= bound).select(F.col("_digest").alias("_key"), "_first", F.explode(F.array(*map(F.lit, range(SALTS)))).alias("_salt"))
    hot = firsts.where(F.col("n") > bound).select(F.col("_digest").alias("_key"), F.col("_first").alias("_hot"))
    # Under 100,000 rows, as their counts add up to all rows that share a payload.
    looked = looked.join(spread, ["_key", "_salt"], "left").join(F.broadcast(hot), "_key", "left")
    first = F.coalesce("_hot", "_first")
    older = first.isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") != first))
    joined = looked.select("page_id", "url", "html", first.alias("_first"), older.alias("is_revisit"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, uri, n, size, done = None, None, 0, 0, []
        for batch in batches:
            for page_id, url, html, first, revisit in zip(*(batch.column(c) for c in ("page_id", "url", "html", "_first", "is_revisit")), strict=True):
                if out is None:
                    uri, out = storage.create(folder, "pages", ".warc.gz")
                    out.write(record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:file:{uri[-40:-8]}>"), ("WARC-Date", "2024-01-01T00:00:00Z"), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))
                member = page_record(page_id.as_py(), url.as_py(), html.as_py().encode(), first.as_py(), revisit.as_py(), level)
                out.write(member)
                n, size = n + 1, size + len(member)
                if size >= FILE_BYTES:
                    out.close()
                    done.append({"uri": uri, "n_records": n})
                    out, n, size = None, 0, 0
        if out is not None:
            out.close()
            done.append({"uri": uri, "n_records": n})
        yield pa.RecordBatch.from_pylist(done, schema=_FILES)

    return materialize(joined.mapInArrow(write, "uri string, n_records long"), "warc-list")


_PAGES = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
PAGES_DDL = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def read_archives(files: DataFrame, with_payload: bool = True, batch_bytes: int = 8 << 20) -> DataFrame:
    """One row for each page record; ``with_payload=False`` leaves payloads null."""
    ship(files.sparkSession)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                with storage.read(row["uri"]) as stream:
                    out, held, seen = [], 0, 0
                    for fields, block in read_records(stream):
                        if fields["warc-type"] not in ("response", "revisit"):
                            continue
                        page = parse_page(fields, block)
                        if not with_payload:
                            page["payload"] = None
                        out.append(page)
                        seen, held = seen + 1, held + 200 + len(page["payload"] or b"")
                        if held >= batch_bytes:
                            yield pa.RecordBatch.from_pylist(out, schema=_PAGES)
                            out, held = [], 0
                    if seen != row["n_records"]:
                        raise WarcError("records are missing")
                    yield pa.RecordBatch.from_pylist(out, schema=_PAGES)

    n = max(1, files.count())
    return files.repartition(n, "uri").mapInArrow(scan, PAGES_DDL)
