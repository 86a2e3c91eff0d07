"""WARC archives: writing with segmentation, reading with reassembly.

A payload longer than a segment is cut: the first record carries the HTTP head
and the first bytes, ``continuation`` records the rest, each with
WARC-Segment-Origin-ID and WARC-Segment-Number, the last with
WARC-Segment-Total-Length. Bodies are sent in HTTP chunks. Every record is a
gzip member of its own, and archives are closed at a bounded size. Reading parses
archives independently, groups what is segmented by its origin's identifier,
orders by segment number, holds the sum against the total length, and decodes the chunks;
whole records take no shuffle. A group is one payload, never more.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.filestore import write_bytes
from ..plans.materialize import cut, shared_dir

#: Payload bytes that one record carries; bytes after which an archive is closed; bytes of an HTTP chunk.
SEGMENT, ARCHIVE, CHUNK = 16 << 10, 8 << 20, 4 << 10
#: Compressed bytes given to the decompressor at a time.
FEED = 16 << 10
#: Payloads of at least so many bytes are written once.
LEAST_DUPLICATE = 0
DATE = "2024-01-01T00:00:00Z"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def payload_digest(payload: bytes) -> str:
    """SHA-1 in base32, upper case, without a label."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(*key: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, '|'.join(map(str, key)))}>"


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    """HTTP/1.1 chunked transfer framing."""
    parts = []
    for i in range(0, len(payload), size):
        piece = payload[i : i + size]
        parts += [b"%x\r\n" % len(piece), piece, b"\r\n"]
    return b"".join([*parts, b"0\r\n\r\n"])


def dechunked(body: bytes) -> bytes:
    """Undo the framing; extensions and trailers are passed over."""
    parts, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if size == 0:
            return b"".join(parts)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk is shorter than it says")
        parts.append(body[at : at + size])
        at += size + 2


def record(kind: str, name: str, block: bytes, **fields: object) -> bytes:
    """One record as a gzip member. Field names take dashes for underscores."""
    head = {"WARC-Type": kind, "WARC-Record-ID": name, "WARC-Date": DATE}
    head |= {k.replace("_", "-"): v for k, v in fields.items() if v is not None}
    head["Content-Length"] = len(block)
    lines = "".join(f"{k}: {str(v).replace(chr(13), ' ').replace(chr(10), ' ')}\r\n" for k, v in head.items())
    return gzip.compress(b"WARC/1.1\r\n" + lines.encode("utf-8", "replace") + b"\r\n" + block + b"\r\n\r\n", 6, mtime=0)


def response_records(name: str, url: str | None, payload: bytes, page: str, segment: int = SEGMENT) -> Iterator[bytes]:
    """A response, in as many records as it needs."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    block = http + chunked(payload)
    fields = {"WARC_Target_URI": url or "urn:none", "WARC_Payload_Digest": f"sha1:{payload_digest(payload)}", "X_Page": page, "Content_Type": "application/http;msgtype=response"}
    if len(block) <= segment:
        yield record("response", name, block, **fields)
        return
    yield record("response", name, block[:segment], **fields, WARC_Segment_Number=1)
    n = -(-len(block) // segment)
    for k in range(2, n + 1):
        yield record(
            "continuation", record_id(name, k), block[(k - 1) * segment : k * segment],
            WARC_Target_URI=url or "urn:none", WARC_Segment_Origin_ID=name, WARC_Segment_Number=k,
            WARC_Segment_Total_Length=len(block) if k == n else None,
        )


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of an archive, plain or with a gzip member for each."""
    if data[:2] != b"\x1f\x8b":
        yield from _plain(data)
        return
    at, parts, d = 0, [], zlib.decompressobj(wbits=31)
    while at < len(data):
        piece = data[at : at + FEED]
        parts.append(d.decompress(piece))
        at += len(piece) - len(d.unused_data)
        if d.eof:
            yield from _plain(b"".join(parts))
            parts, d = [], zlib.decompressobj(wbits=31)
    if parts:
        raise ValueError("an archive ends within a record")


def _plain(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:end].decode("utf-8", "replace").split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError("not a WARC record")
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        size = int(head["content-length"])
        block = data[end + 4 : end + 4 + size]
        if len(block) != size or data[end + 4 + size : end + 8 + size] != b"\r\n\r\n":
            raise ValueError("a record is shorter than it says")
        yield head, block
        at = end + 8 + size


def _payload(block: bytes) -> bytes:
    head, _, body = block.partition(b"\r\n\r\n")
    return dechunked(body) if b"transfer-encoding: chunked" in head.lower() else body


def _writer(out: str, what: str, segment: int = SEGMENT):
    """Rows to archives of bounded size, each with its own warcinfo; yields one row an archive."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, seq, size, held = TaskContext.get().partitionId(), 0, 0, []

        def close() -> pd.DataFrame:
            nonlocal seq, size, held
            path = f"{out}/{what}-{part:06d}-{seq:05d}.warc.gz"
            info = record("warcinfo", record_id(what, part, seq), b"software: pointloom\r\nformat: WARC File Format 1.1\r\n", Content_Type="application/warc-fields")
            write_bytes(path, [info, *held])
            row = pd.DataFrame([(path, size)], columns=["path", "bytes"])
            seq, size, held = seq + 1, 0, []
            return row

        for df in batches:
            for r in df.itertuples(index=False):
                if what == "revisit":
                    new = [
                        record(
                            "revisit", r.name, b"HTTP/1.1 200 OK\r\n\r\n", WARC_Target_URI=r.url or "urn:none", WARC_Refers_To=r.refers,
                            WARC_Payload_Digest=f"sha1:{r.digest}", X_Page=r.page,
                            WARC_Profile="http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                        )
                    ]
                else:
                    new = response_records(r.name, r.url, (r.html or "").encode("utf-8", "replace"), r.page, segment)
                for x in new:
                    if size and size + len(x) > ARCHIVE:
                        yield close()
                    held.append(x)
                    size += len(x)
        if held:
            yield close()

    return run


def write_archives(pages: DataFrame, out: str, least: int = LEAST_DUPLICATE, segment: int = SEGMENT) -> DataFrame:
    """Write all ``pages`` under ``out``; return ``(path, bytes)`` an archive.

    Equal payloads of at least ``least`` bytes are written once, as the response
    of the largest page_id; the others revisit it. Only digests and ids are
    shuffled by payload; a page's text moves once, by its own hash, so any number
    of equal pages is spread evenly.
    """

    @F.pandas_udf("string")
    def digest(s: pd.Series) -> pd.Series:
        return pd.Series([payload_digest((t or "").encode("utf-8", "replace")) for t in s], dtype="object")

    @F.pandas_udf("string")
    def name(page: pd.Series, url: pd.Series, sha: pd.Series, copy: pd.Series) -> pd.Series:
        return pd.Series([record_id(*k) for k in zip(page, url, sha, copy, strict=True)], dtype="object")

    page = F.coalesce(F.col("page_id").cast("string"), F.lit("null"))
    url = F.coalesce("url", F.lit(""))
    size = F.coalesce(F.octet_length("html"), F.lit(0))
    marked = pages.select("page_id", page.alias("page"), url.alias("url"), "html", digest("html").alias("digest"), size.alias("n"))
    # repeated rows are told apart by a running number
    rows = (
        marked.groupBy("page_id", "url", "digest", "n")
        .agg(F.count(F.lit(1)).alias("copies"))
        .withColumn("copy", F.explode(F.expr("sequence(1L, copies)")))
        .drop("copies")
    )
    # names and pages as text follow from the other columns and are not stored with them
    rows = cut(rows).withColumn("page", page)
    named = lambda df: df.withColumn("name", name("page", "url", "digest", F.col("copy").cast("string")))
    best = rows.where(F.col("n") >= least).groupBy("digest").agg(F.max(F.struct("page_id", "url", "copy")).alias("best"))
    told = rows.join(best, "digest", "left").withColumn(
        "response",
        F.col("best").isNull() | (F.struct("page_id", "url", "copy").eqNullSafe(F.col("best"))),
    )
    first = named(told.where("response").select("digest", "page", "url", "copy"))
    revisits = named(told.where("NOT response")).alias("r").join(
        first.select("digest", F.col("name").alias("refers")).alias("f"), "digest"
    )
    # a response takes its text from a row with the same page, url and digest; of repeated ones the writer needs as many as there are responses
    texts = marked.select("page", "url", "digest", "html").withColumn(
        "copy", F.row_number().over(_repeats())
    )
    # the number is tested behind the join, which so keeps the window's partitions and moves no text again
    numbered = first.withColumnRenamed("copy", "which")
    responses = texts.join(numbered, ["page", "url", "digest"]).where("copy - which = 0").select("name", "url", "page", "html")
    schema = "path string, bytes bigint"
    return cut(
        responses.mapInPandas(_writer(out, "response", segment), schema).unionByName(
            revisits.select("name", "url", "page", "digest", "refers").mapInPandas(_writer(out, "revisit"), schema)
        )
    )


def _repeats():
    from pyspark.sql.window import Window

    return Window.partitionBy("page", "url", "digest").orderBy(F.lit(1))


def read_archives(archives: DataFrame) -> DataFrame:
    """``(page, record_type, name, refers, stated_digest, payload_bytes,
    payload_digest)`` for each response and revisit in the archives of
    ``archives`` (column path). A revisit's bytes and digest are its response's.
    Fails on a missing segment, a wrong total length, or a digest that is not the stated one."""
    from ..plans.filestore import read_bytes

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            for path in df["path"]:
                rows = []
                for head, block in parse(read_bytes(path)):
                    kind = head["warc-type"]
                    if kind not in ("response", "revisit", "continuation"):
                        continue
                    sha = head.get("warc-payload-digest", "").removeprefix("sha1:")
                    number = int(head.get("warc-segment-number", 0))
                    size = found = None
                    if kind == "response" and not number:
                        payload = _payload(block)
                        size, found = len(payload), payload_digest(payload)
                        if found != sha:
                            raise ValueError(f"{path}: {head['warc-record-id']} has another payload than it states")
                    total = head.get("warc-segment-total-length")
                    rows.append(
                        (
                            head.get("warc-segment-origin-id", head["warc-record-id"]), kind, head.get("x-page"), head.get("warc-refers-to"), sha if found is None else None,
                            number, None if total is None else int(total), block if number else None, size, found,
                        )
                    )
                yield pd.DataFrame(rows, columns=["name", "kind", "page", "refers", "sha", "number", "total", "block", "size", "found"]).astype(
                    {"total": "Int64", "size": "Int64"}
                )

    schema = "name string, kind string, page string, refers string, sha string, number int, total bigint, block binary, size bigint, found string"
    # parsed once; blocks are held for segmented records alone, digests once
    parts = cut(archives.select("path").mapInPandas(split, schema))

    @F.pandas_udf("struct<size: bigint, found: string>")
    def joined(segments: pd.Series, totals: pd.Series, sha: pd.Series) -> pd.DataFrame:
        out = []
        for s, total, d in zip(segments, totals, sha, strict=True):
            s = sorted(s, key=lambda x: x["number"])
            if [x["number"] for x in s] != list(range(1, len(s) + 1)):
                raise ValueError(f"segments {[x['number'] for x in s]} of a record")
            block = b"".join(bytes(x["block"]) for x in s)
            if pd.isna(total) or len(block) != total:
                raise ValueError(f"segments hold {len(block)} bytes, not {total}")
            payload = _payload(block)
            if payload_digest(payload) != d:
                raise ValueError("a reassembled record has another payload than it states")
            out.append((len(payload), payload_digest(payload)))
        return pd.DataFrame(out, columns=["size", "found"])

    whole = parts.where("number = 0 AND kind = 'response'").select("name", "page", "size", "found")
    grouped = (
        parts.where("number > 0")
        .groupBy("name")
        .agg(
            F.collect_list(F.struct("number", "block")).alias("s"),
            F.max("total").alias("total"),
            F.max("page").alias("page"),
            F.max(F.when(F.col("kind") == "response", F.col("sha"))).alias("sha"),
        )
        .withColumn("got", joined("s", "total", "sha"))
        .select("name", "page", "got.size", "got.found")
    )
    responses = cut(whole.unionByName(grouped))
    revisits = (
        parts.where("kind = 'revisit'")
        .select(F.col("name").alias("own"), F.col("page").alias("own_page"), "refers", "sha")
        .join(responses.withColumnRenamed("name", "refers"), "refers", "left")
    )
    revisits = revisits.select(
        F.col("own_page").alias("page"), F.lit("revisit").alias("record_type"), F.col("size").alias("payload_bytes"),
        F.when(F.col("found") == F.col("sha"), F.col("found")).otherwise(F.raise_error(F.lit("a revisit's response is missing or differs"))).alias("payload_digest"),
        F.col("page").alias("refers_to"),
    )
    own = responses.select(
        "page", F.lit("response").alias("record_type"), F.col("size").alias("payload_bytes"), F.col("found").alias("payload_digest"),
        F.lit(None).cast("string").alias("refers_to"),
    )
    return own.unionByName(revisits)


def round_trip(pages: DataFrame, least: int = LEAST_DUPLICATE, segment: int = SEGMENT) -> DataFrame:
    """``(page_id, payload_bytes, payload_digest, record_type, refers_to)`` from
    the archives written of ``pages`` and read back.

    Defined cases: a null html is an empty payload; a null url is ``urn:none``;
    a null page_id comes back null and is the least of all ids; of repeated rows the one
    numbered last is the response and the others revisit its page_id; an empty table gives none;
    other columns are ignored.
    """
    out = f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    kind = pages.schema["page_id"].dataType
    back = read_archives(write_archives(pages, out, least, segment))
    number = lambda c: F.when(F.col(c) != "null", F.col(c)).cast(kind)
    return back.select(number("page").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))
