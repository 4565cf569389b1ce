"""WARC archives: a writer of gzip members and a splittable reader.

Writer: each task writes archives of its rows, one gzip member a record, under a name of its own
attempt, so a task that is run again can't harm another's file; the manifest of finished archives is a
table in the shared folder.

Reader: an archive is cut into byte ranges. A task looks for gzip magic in its range; a candidate
counts only if it decodes to a WARC version line and complete headers. The task owns the records that
start inside its range and reads past its end to finish the last. After a record it goes on at that
record's end, so magic bytes inside a member are not taken for one.

Equal payloads of at least `least` bytes: the record of the smallest page id is the response, the
others are revisits without a body that name its record and its page. Which they are is decided on ids and
digests; pages whose payload surely stands alone don't shuffle.

Sizes and digests of responses are those of the payload as it was read, and `damaged` says where they
aren't those that the headers promise; a revisit has no payload, so its headers' are taken.

Cases: null html is an empty payload; null url is written as an empty target; line breaks in a url
are percent-coded; rows that repeat a page id with the same payload are all responses if theirs is the
smallest id; a null page id is never chosen if its group has another. An empty table gives no rows.
Only the named columns are read.
"""

from __future__ import annotations

import hashlib
import posixpath
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanveil.llm.common import bounded_batches, fresh_path, join_hot, shared_dir, stage, with_filter

LEAST_BYTES = 100
#: An archive is closed beyond so many compressed bytes.
ARCHIVE_BYTES = 64 << 20
RANGE_BYTES = 4 << 20
MAGIC = b"\x1f\x8b\x08"
READ_AHEAD = 1 << 18
PAGE, SIZE, REFERS = "WARC-X-Page-Id", "WARC-X-Payload-Length", "WARC-X-Refers-To-Page-Id"


def open_fs(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI; a bare path is local."""
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else "file://" + path)


def record_types(pages: DataFrame, id_col: str, html_col: str, url_col: str, least: int) -> DataFrame:
    """_id, _url, _html, _digest, _refers and _refers_url (page id and url of the response; null for responses)."""
    rows = pages.select(F.col(id_col).alias("_id"), F.coalesce(F.col(url_col), F.lit("")).alias("_url"), F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8").alias("_html"))
    keys = stage(rows.select("_id", "_url", F.sha2("_html", 256).alias("_digest"), F.length("_html").alias("_len")), "warc-digests")
    first = F.min(F.when(F.col("_id").isNotNull(), F.struct("_id", "_url"))).alias("_first")
    groups = stage(keys.filter(F.col("_len") >= least).groupBy("_digest").agg(first, F.count("*").alias("_n")).filter("_n > 1 and _first is not null"), "warc-groups")
    probed = with_filter(rows.withColumn("_digest", F.sha2("_html", 256)), groups, ["_digest"])
    none = [F.lit(None).cast(rows.schema["_id"].dataType).alias("_refers"), F.lit(None).cast("string").alias("_refers_url")]
    alone = probed.filter("not _maybe").select("_id", "_url", "_html", "_digest", *none)
    joined = join_hot(probed.filter("_maybe").drop("_maybe"), groups, "_digest", "_n", keys.count(), "_id", "left")
    other = F.col("_first").isNotNull() & ~F.col("_id").eqNullSafe(F.col("_first._id"))
    return alone.unionByName(joined.select("_id", "_url", "_html", "_digest", F.when(other, F.col("_first._id")).alias("_refers"), F.when(other, F.col("_first._url")).alias("_refers_url")))


def record_id(page_id: object, url: str, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{"" if page_id is None else page_id} {digest} {url}')}>"


def _line(url: str) -> str:
    return url.replace("\r", "%0D").replace("\n", "%0A")


def record_bytes(page_id: object, url: str, payload: bytes, digest: str, refers: object, refers_url: str | None = None) -> bytes:
    """One WARC record, uncompressed."""
    body = b"" if refers is not None else b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id, url, digest)}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {_line(url)}",
        f"WARC-Payload-Digest: sha256:{digest}", f"{PAGE}: {'' if page_id is None else page_id}", f"{SIZE}: {len(payload)}", "Content-Type: application/http; msgtype=response",
    ]
    if refers is not None:
        target = refers_url or ""
        head += [f"WARC-Refers-To: {record_id(refers, target, digest)}", f"WARC-Refers-To-Target-URI: {_line(target)}", "WARC-Refers-To-Date: 1970-01-01T00:00:00Z", f"{REFERS}: {refers}"]
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join([*head, f"Content-Length: {len(body)}", "", ""]).encode() + body + b"\r\n\r\n"


def member(record: bytes) -> bytes:
    z = zlib.compressobj(5, zlib.DEFLATED, 31)
    return z.compress(record) + z.flush()


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """records: see record_types. Returns the manifest: path, bytes, records."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = open_fs(folder)
        fs.create_dir(base, recursive=True)
        out, name, size, n = None, "", 0, 0
        for batch in batches:
            for page_id, url, html, digest, refers, refers_url in zip(*(batch[c] for c in ("_id", "_url", "_html", "_digest", "_refers", "_refers_url")), strict=True):
                if out is None:
                    name, size, n = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = fs.open_output_stream(posixpath.join(base, name), compression=None)
                data = member(record_bytes(page_id, url, bytes(html), digest, refers, refers_url))
                out.write(data)
                size, n = size + len(data), n + 1
                if size >= ARCHIVE_BYTES:
                    out.close()
                    out = None
                    yield pd.DataFrame({"path": [f"{folder}/{name}"], "bytes": [size], "records": [n]})
        if out is not None:
            out.close()
            yield pd.DataFrame({"path": [f"{folder}/{name}"], "bytes": [size], "records": [n]})

    as_text = records.select(F.col("_id").cast("string"), "_url", "_html", "_digest", F.col("_refers").cast("string"), "_refers_url")
    return stage(as_text.mapInPandas(write, "path string, bytes long, records long"), "warc-manifest")


def decode_headers(data: bytes) -> tuple[dict[str, str], int] | None:
    """Headers and where they end, or None if data doesn't start a WARC record."""
    if not data.startswith(b"WARC/1."):
        return None
    end = data.find(b"\r\n\r\n")
    if end < 0:
        return None
    lines = data[:end].decode("utf-8", "replace").split("\r\n")[1:]
    return {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}, end + 4


class Window:
    """Bytes of a file by absolute offset, read ahead as asked."""

    def __init__(self, file: object, start: int, size: int) -> None:
        self.file, self.base, self.size, self.data = file, start, size, b""

    def at(self, offset: int, n: int) -> bytes:
        if offset < self.base or offset + n > self.base + len(self.data):
            self.file.seek(offset)
            self.base, self.data = offset, self.file.read(min(max(n, READ_AHEAD), self.size - offset))
        return self.data[offset - self.base : offset - self.base + n]


def read_member(window: Window, start: int) -> tuple[bytes, int] | None:
    """The decoded member at start and the offset of its end; None if it isn't a whole gzip member of a WARC record."""
    z, out, at, seen = zlib.decompressobj(31), [], start, False
    while not z.eof:
        if at >= window.size:
            return None
        part = window.at(at, min(READ_AHEAD, window.size - at))
        try:
            got = z.decompress(part)
        except zlib.error:
            return None
        out.append(got)
        at += len(part) - len(z.unused_data)
        if not seen and (head := b"".join(out)[:7]) and not b"WARC/1.".startswith(head[:7]):
            return None
        seen = seen or sum(map(len, out)) >= 7
    return b"".join(out), at


def records_in_range(file: object, size: int, start: int, end: int) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, headers, block) of the records that start in [start, end)."""
    window, at = Window(file, start, size), start
    while at < end:
        part = window.at(at, min(READ_AHEAD, size - at))
        hit = part.find(MAGIC)
        if hit < 0:
            at += max(1, len(part) - len(MAGIC) + 1)
            continue
        at += hit
        if at >= end:
            return
        found = read_member(window, at)
        head = decode_headers(found[0]) if found else None
        if head is None:
            at += 1
            continue
        headers, body = head
        length = int(headers.get("content-length", "0"))
        yield at, headers, found[0][body : body + length]
        at = found[1]


def read_record(headers: dict[str, str], block: bytes) -> tuple[str, str | None, str | None, str, str | None, int, str, bool, str, bytes]:
    """record_type, page_id, refers_to, record_id, refers_record, payload_bytes, payload_digest, damaged, url, payload."""
    kind, payload = headers["warc-type"], block.partition(b"\r\n\r\n")[2]
    size, digest = int(headers[SIZE.lower()]), headers["warc-payload-digest"].removeprefix("sha256:")
    # A block that ends before its promised length is damaged, too.
    damaged = len(block) != int(headers["content-length"])
    if kind == "response":
        damaged |= (len(payload), hashlib.sha256(payload).hexdigest()) != (size, digest)
        size, digest = len(payload), hashlib.sha256(payload).hexdigest()
    return kind, headers[PAGE.lower()] or None, headers.get(REFERS.lower()), headers["warc-record-id"], headers.get("warc-refers-to"), size, digest, damaged, headers.get("warc-target-uri", ""), payload


def read_archives(manifest: DataFrame, range_bytes: int = RANGE_BYTES, payload: bool = True) -> DataFrame:
    """path, offset, record_type, page_id (string), refers_to (string), record_id, refers_record, payload_bytes, payload_digest, damaged, url, payload (binary; null if not asked for)."""
    ranges = manifest.select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(range_bytes).cast("long"))).alias("start"))
    ranges = ranges.repartition(max(1, min(10_000, ranges.count())), "path", "start")
    schema = "path string, offset long, record_type string, page_id string, refers_to string, record_id string, refers_record string, payload_bytes long, payload_digest string, damaged boolean, url string, payload binary"
    names = [x.split()[0] for x in schema.split(", ")]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, size, start in zip(batch["path"], batch["bytes"], batch["start"], strict=True):
                fs, name = open_fs(path)
                with fs.open_input_file(name) as file:
                    rows, held = [], 0
                    for offset, h, block in records_in_range(file, size, start, min(start + range_bytes, size)):
                        *found, body = read_record(h, block)
                        rows.append((path, offset, *found, body if payload else None))
                        held += 200 + (len(body) if payload else 0)
                        if held > 4 << 20:
                            yield pd.DataFrame(rows, columns=names)
                            rows, held = [], 0
                    if rows:
                        yield pd.DataFrame(rows, columns=names)

    return ranges.mapInPandas(read, schema)


def archive_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST_BYTES, payload: bool = True) -> DataFrame:
    """Writes pages and reads them back: see read_archives."""
    bounded_batches(pages.sparkSession)
    folder = fresh_path(pages.sparkSession, "warc")
    assert folder.startswith(shared_dir(pages.sparkSession))
    return read_archives(write_archives(record_types(pages, id_col, html_col, url_col, least), folder), payload=payload)
