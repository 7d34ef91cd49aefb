"""WARC archives: written by tasks, one gzip member a record, and read back in byte ranges.

Writing.  Rows are grouped by the SHA-256 of their payload; the row of the largest
id is a ``response``, the others ``revisit`` it.  Each task writes archives of its own
and gives their names; only those of tasks that succeeded are in the table of
files, so a lost or repeated task leaves at most a file that nobody reads.

Reading.  Files are cut into byte ranges, a task each.  A task looks for gzip magic
in its range, and takes a place for the start of a member only if it inflates, to
its end and checksum, to records with WARC headers of the right lengths.  It owns
the members that start inside its range and reads on past the end of the last one;
the rest of a member that began before is passed over, as nothing in it inflates.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.ragged import release, row_slices
from tessera.llm.shared import shared_dir, stored

#: Payloads from this size on are written once.
LEAST_BYTES = 0
#: Compressed bytes after which a task begins another archive.
FILE_BYTES = 1 << 30
#: Bytes of an archive that one task searches.
SPLIT_BYTES = 32 << 20
#: Groups of equal payloads with more than 1 / HOT of all rows are joined by broadcast: fewer than HOT rows.
HOT = 1000
LEVEL = 6
DATE = "2024-01-01T00:00:00Z"
MAGIC = b"\x1f\x8b\x08"
_CHUNK = 1 << 20
_BATCH_BYTES = 4 << 20
_LINE = b"\r\n"


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """File system of a path or URI, and the path in it."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record(kind: str, record_id: str, block: bytes, content_type: str, more: dict[str, str]) -> bytes:
    fields = {"WARC-Type": kind, "WARC-Record-ID": f"<{record_id}>", **more, "Content-Type": content_type, "Content-Length": str(len(block))}
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()) + "\r\n"
    return head.encode() + block + 2 * _LINE


def _member(data: bytes, level: int) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _page_id(number: int | None, digest: str) -> str:
    return f"urn:tessera:page:{'null' if number is None else number}:{digest}"


def _page_record(number: int | None, url: str | None, payload: bytes, original: int | None, date: str) -> bytes:
    digest = digest_of(payload)
    more = {"WARC-Date": date, "WARC-Target-URI": quote(url, safe="%/:=&?~#+!$,;'@()*[]") if url else "about:blank",
            "WARC-Payload-Digest": f"sha1:{digest}"}
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if original is None:
        return _record("response", _page_id(number, digest), head + payload, "application/http;msgtype=response", more)
    more |= {"WARC-Refers-To": f"<{_page_id(original, digest)}>",
             "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"}
    return _record("revisit", _page_id(number, digest), head, "application/http;msgtype=response", more)


def _write(folder: str, level: int, file_bytes: int, date: str):
    def run(batches):
        files, base = file_system(folder)
        out = path = None
        written = records = 0

        def closed():
            out.close()
            return pa.RecordBatch.from_pydict({"path": [path], "bytes": [written], "records": [records]},
                                              pa.schema([("path", pa.string()), ("bytes", pa.int64()), ("records", pa.int64())]))

        for batch in row_slices(batches, "payload", _BATCH_BYTES):
            for number, url, payload, original in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "original"))):
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    files.create_dir(base, recursive=True)
                    path = f"{folder.rstrip('/')}/{name}"
                    out = files.open_output_stream(f"{base.rstrip('/')}/{name}", compression=None)
                    info = _record("warcinfo", f"urn:uuid:{uuid.uuid4()}", b"software: tessera\r\nformat: WARC File Format 1.1\r\n",
                                   "application/warc-fields", {"WARC-Date": date, "WARC-Filename": name})
                    records, written = 0, out.write(_member(info, level))
                written += out.write(_member(_page_record(number, url, payload, original, date), level))
                records += 1
                if written >= file_bytes:
                    yield closed()
                    out = None
        if out is not None:
            yield closed()

    return run


def with_originals(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """``original``: the largest id of the rows with the same payload, where that is another; else null.

    ``pages`` has ``page_id, payload``.  Payloads are compared by SHA-256 and length.  Only groups
    of two rows at least are joined back, the few of more than 1 / HOT of all rows by broadcast, so
    that no task gets a large group.
    """
    key = F.when(F.octet_length("payload") >= least_bytes, F.concat(F.sha2("payload", 256), F.octet_length("payload").cast("string")))
    keyed = pages.withColumn("key", key)
    groups = keyed.where("key IS NOT NULL").groupBy("key").agg(F.max("page_id").alias("top"), F.count("*").alias("n"))
    groups = stored(groups.where("n > 1 AND top IS NOT NULL"), "payload_groups")
    total = groups.agg(F.sum("n")).first()[0] or 0
    hot = groups.where(F.col("n") > total / HOT).select("key", F.col("top").alias("hot_top"))
    rest = groups.where(F.col("n") <= total / HOT).select(F.col("key").alias("rest_key"), "top")
    out = keyed.join(F.broadcast(hot), "key", "left")
    # rows that are settled, or take no part, meet no row of ``rest``, wherever they go
    meets = F.when(F.col("hot_top").isNull() & F.col("key").isNotNull(), F.col("key")).otherwise(
        F.concat(F.lit("-"), F.xxhash64("page_id", F.col("url")).cast("string")))
    out = out.withColumn("meets", meets).join(rest, F.col("meets") == F.col("rest_key"), "left")
    top = F.coalesce("hot_top", "top")
    return out.select(*[F.col(c) for c in pages.columns], F.when(~F.col("page_id").eqNullSafe(top), top).alias("original"))


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
               least_bytes: int = LEAST_BYTES, level: int = LEVEL, file_bytes: int = FILE_BYTES, date: str = DATE) -> DataFrame:
    """Write one record a row to archives in the folder ``path`` (shared by all executors); ``path, bytes, records`` of each.

    The payload is the text in UTF-8, or bytes as they are; null is empty.  Of the records
    with equal payloads of at least ``least_bytes`` bytes that with the largest id is a response, the
    others revisit it; rows that repeat the largest id with the same payload are all responses,
    and a row without an id is smaller than any with one (without one among them all are
    responses).  A null or empty address is ``about:blank``; control and non-ASCII characters in
    addresses are percent-encoded.  An empty table writes no archive.
    """
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"),
                        F.coalesce(F.col(f"`{payload_col}`").cast("binary"), F.lit(b"")).alias("payload"))
    rows = with_originals(rows, least_bytes)
    return stored(rows.mapInArrow(_write(path, level, file_bytes, date), "path string, bytes long, records long"), "warc_files")


class _Window:
    """Bytes of a file from ``base`` on, read as needed; ``size`` is the file's."""

    def __init__(self, file, size: int, base: int):
        self.file, self.size, self.base = file, size, base
        self.data = bytearray()

    def more(self) -> bool:
        at = self.base + len(self.data)
        if at >= self.size:
            return False
        self.file.seek(at)
        got = self.file.read(min(_CHUNK, self.size - at))
        self.data += got
        return bool(got)

    def drop(self, upto: int) -> None:
        """Let go of what is before ``upto``, once it is much."""
        gone = min(upto - self.base, len(self.data))
        if gone >= _CHUNK:
            del self.data[:gone]
            self.base += gone

    def find(self, at: int, stop: int) -> int:
        """First place of gzip magic in [at, stop); -1 if there is none."""
        last = stop + len(MAGIC) - 1
        while True:
            found = self.data.find(MAGIC, at - self.base, last - self.base)
            if found >= 0:
                return self.base + found
            have = self.base + len(self.data)
            at = max(at, have - len(MAGIC) + 1)
            self.drop(at)
            if have >= last or not self.more():
                return -1

    def inflate(self, at: int) -> tuple[bytes, int] | None:
        """What the gzip member at ``at`` holds, and where it ends; None if it is none that begins like a record."""
        self.drop(at)
        z, out, head, place, step = zlib.decompressobj(31), [], b"", at - self.base, 1 << 13
        try:
            while not z.eof:
                if place >= len(self.data) and not self.more():
                    return None
                piece = self.data[place:place + step]
                got = z.decompress(piece)
                place += len(piece) - len(z.unused_data)
                out.append(got)
                if len(head) < 5:
                    head += got[:5]
                    if not b"WARC/".startswith(head[:5]):
                        return None
                step = min(2 * step, _CHUNK)
        except zlib.error:
            return None
        return b"".join(out), self.base + place


def _fields(lines: list[bytes]) -> dict[str, str]:
    out = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        if not colon:
            raise ValueError("a header line without a colon")
        out[name.strip().decode("latin-1").lower()] = value.strip().decode("utf-8", "replace")
    return out


def parse_records(data: bytes) -> list[tuple[dict[str, str], bytes]] | None:
    """Headers (names in lower case) and block of each record in a member; None if it does not hold whole records."""
    out, at = [], 0
    while at < len(data):
        stop = data.find(2 * _LINE, at)
        if stop < 0 or data[at:at + 5] != b"WARC/":
            return None
        try:
            fields = _fields(data[at:stop].split(_LINE)[1:])
            size = int(fields["content-length"])
        except (ValueError, KeyError):
            return None
        block = data[stop + 4:stop + 4 + size]
        at = stop + 4 + size + 4
        if size < 0 or "warc-type" not in fields or data[at - 4:at] != 2 * _LINE:
            return None
        out.append((fields, block))
    return out or None


def _in_range(file, size: int, start: int, stop: int) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """Offset and length of the member, headers and block of the records that start in [start, stop)."""
    window = _Window(file, size, start)
    at = start
    while at < stop and (at := window.find(at, stop)) >= 0:
        member = window.inflate(at)
        records = parse_records(member[0]) if member else None
        if records is None:
            at += 1
            continue
        for fields, block in records:
            yield at, member[1] - at, fields, block
        at = member[1]
        window.drop(at)


RECORDS = ("path string, offset long, bytes long, warc_type string, record_id string, target_uri string, date string, refers_to string, "
           "payload_digest string, payload_bytes long, intact boolean, payload binary")


def _bare(value: str | None, prefix: str = "", suffix: str = "") -> str | None:
    return None if value is None else value.removeprefix(prefix).removesuffix(suffix)


def _described(path: str, offset: int, length: int, fields: dict[str, str], block: bytes, payloads: bool) -> tuple:
    kind = fields["warc-type"]
    payload, size = block, len(block)
    if fields.get("content-type", "").startswith("application/http"):
        head, _, payload = block.partition(2 * _LINE)
        size = len(payload)
        if kind == "revisit":  # the payload is elsewhere, its length in the headers kept
            try:
                size = int(_fields(head.split(_LINE)[1:]).get("content-length", ""))
            except ValueError:
                size = None
    digest = _bare(fields.get("warc-payload-digest"), "sha1:")
    intact = None
    if kind == "revisit":
        payload = None
    else:
        own = digest_of(payload)
        intact = None if digest is None else digest == own
        digest = own
    return (path, offset, length, kind, _bare(fields.get("warc-record-id"), "<", ">"), fields.get("warc-target-uri"), fields.get("warc-date"),
            _bare(fields.get("warc-refers-to"), "<", ">"), digest, size, intact, payload if payloads else None)


def _read(payloads: bool):
    names = [c.split()[0] for c in RECORDS.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
    schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in RECORDS.split(", ")])

    def batch_of(rows):
        return pa.RecordBatch.from_pydict({c: list(v) for c, v in zip(names, zip(*rows))}, schema)

    def run(batches):
        for batch in batches:
            for path, size, start, stop in zip(*(batch.column(c).to_pylist() for c in ("path", "bytes", "start", "stop"))):
                files, inner = file_system(path)
                rows, held = [], 0
                with files.open_input_file(inner) as file:
                    for offset, length, fields, block in _in_range(file, size, start, stop):
                        rows.append(_described(path, offset, length, fields, block, payloads))
                        held += (len(block) if payloads else 0) + 500
                        if held >= _BATCH_BYTES:
                            yield batch_of(rows)
                            rows, held = [], 0
                if rows:
                    yield batch_of(rows)
                release()

    return run


def list_warc(spark: SparkSession, path: str) -> DataFrame:
    """``path, bytes`` of the archives in a folder that others have written."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(path)
    return files.select("path", F.col("length").alias("bytes"))


def read_warc(files: DataFrame, split_bytes: int = SPLIT_BYTES, payloads: bool = True) -> DataFrame:
    """Records of the archives in ``files`` (``path, bytes``), whatever the ranges they are read in.

    ``offset`` and ``bytes`` are the place and length of the record's gzip member.  For a response
    ``payload`` is what follows the HTTP headers, ``payload_digest`` the bare base32 SHA-1 of it as read
    and ``intact`` whether the header says the same (null without one); a revisit has the digest
    of its header, the payload's length from the HTTP headers it keeps, and null in ``payload``
    and ``intact``.  ``payloads=False`` leaves payloads out.  A null path or an empty table gives no records.
    Where a member holds another whole one as it is (an archive stored within an archive), a range that
    begins inside gives the inner records as well; :func:`outermost` takes them out.
    """
    ranges = files.where("path IS NOT NULL AND bytes > 0").select("path", "bytes", F.explode(F.expr(f"sequence(0L, bytes - 1, {int(split_bytes)}L)")).alias("start"))
    ranges = stored(ranges.withColumn("stop", F.least(F.col("start") + int(split_bytes), F.col("bytes"))), "warc_ranges")
    n = ranges.count()
    return ranges.repartition(max(n, 1), "path", "start").mapInArrow(_read(payloads), RECORDS)


def outermost(records: DataFrame) -> DataFrame:
    """Records without those whose member lies inside another one of the same file."""
    before = Window.partitionBy("path").orderBy("offset").rangeBetween(Window.unboundedPreceding, -1)
    reached = F.max(F.col("offset") + F.col("bytes")).over(before)
    return records.withColumn("_reached", reached).where(F.coalesce(F.col("_reached") <= F.col("offset"), F.lit(True))).drop("_reached")


def page_records(files: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of the records :func:`write_warc` wrote, read from the archives."""
    records = read_warc(files, split_bytes, payloads=False).where(F.col("warc_type").isin("response", "revisit"))
    digest = F.when(F.col("intact") == F.lit(False), F.raise_error(F.concat(F.lit("payload and digest differ: "), "record_id"))).otherwise(F.col("payload_digest"))

    def number(column: str):
        return F.split(column, ":")[3].try_cast("long")

    return records.select(number("record_id").alias("page_id"), "payload_bytes", digest.alias("payload_digest"),
                          F.col("warc_type").alias("record_type"), number("refers_to").alias("refers_to"))


def round_trip(pages: DataFrame) -> DataFrame:
    """Write every page to archives in the shared folder and describe what is read back; see :func:`write_warc`."""
    files = write_warc(pages, f"{shared_dir(pages.sparkSession)}/warc")
    return page_records(files)


ORACLE_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS top FROM pages),
q AS (SELECT page_id, top, strlen(h)::BIGINT AS payload_bytes, sha1(h) AS x FROM p)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(8), lambda i: array_to_string(list_transform([15, 10, 5, 0], lambda k:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(x, (i * 5 + 1)::INT, 5))::BIGINT >> k::INT) & 31) + 1)::INT, 1)), '')), '') AS payload_digest,
  CASE WHEN top IS NULL OR page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to
FROM q
"""
