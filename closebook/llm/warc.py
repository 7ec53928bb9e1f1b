"""WARC files as a Spark data source, and pages as deduplicated archives.

Format `warc` reads and writes WARC/1.1 files, plain or with one gzip member per record.

Reading. The driver lists files and plans byte ranges of them; a task looks for the first
member that starts in its range (gzip magic and a header that inflates to `WARC/`). Plain
files are one range each. Of every record the header block is parsed first; a record that
fails a pushed predicate, or whose payload nobody wants (`payload=false`), is passed over:
by the skip lengths this writer leaves in the gzip header ("sl" extra field), else by
inflating without keeping anything. Pushed down are equality, null-safe equality, IN,
prefixes, null tests, and their negations, on all header columns.

Writing. A task writes files of about `file_bytes` under names of its own attempt, the
driver's commit lists the files that count in `_files-<id>`. Readers of a folder with such
lists take only what they name, so files of lost or repeated tasks never show.

Paths are those pyarrow's file systems take (a plain path, file:, hdfs:, s3:, ...). One
record at a time is held in memory, whatever its length.

`archive_records` makes records of pages: of pages with equal payloads of at least
`least_bytes` bytes the one with the smallest page_id is a response, the others are
revisits without a payload. Null html is the empty payload. Rows that repeat the smallest
id are responses too; rows without an id are revisits if any row of their payload has one,
else responses. An empty table makes an archive without records. Control characters of a
header value are written as %XX. Other columns of the table are not read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
import zlib

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualNullSafe,
    EqualTo,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    Not,
    StringStartsWith,
    WriterCommitMessage,
)

from closebook.llm.common import query, table, whole, written
from closebook.session import scratch_path

#: Columns taken from named headers; every header is in `headers` too, names in lower case.
NAMED = {
    "record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "date": "warc-date",
    "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to",
}
SCHEMA = ", ".join(f"{c} string" for c in NAMED) + (
    ", payload_length bigint, content_length bigint, headers map<string,string>, payload binary, intact boolean")
ARROW = pa.schema(
    [(c, pa.string()) for c in NAMED]
    + [("payload_length", pa.int64()), ("content_length", pa.int64()), ("headers", pa.map_(pa.string(), pa.string())),
       ("payload", pa.binary()), ("intact", pa.bool_())])
FILE_BYTES, SPLIT_BYTES, CHUNK, FEED = 256 << 20, 64 << 20, 1 << 16, 1 << 13
BATCH_ROWS, BATCH_PAYLOAD = 1024, 8 << 20
#: An extension header: revisits have no payload, this is the length of the one they refer to.
LENGTH = "payload-length"
MAGIC = b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def filesystem(path: str):
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def digest(payload: bytes) -> str:
    """Base32 SHA-1, the digest of the format."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# --- reading ----------------------------------------------------------------------------


class Bytes:
    """A file read front to back, with a position that can jump."""

    def __init__(self, file):
        self.file, self.buffer, self.at = file, b"", 0  # `at`: offset of the buffer in the file

    def need(self, n: int) -> bytes:
        """At least n bytes from here, fewer at the end of the file; they are not consumed."""
        while len(self.buffer) < n:
            more = self.file.read(max(CHUNK, n - len(self.buffer)))
            if not more:
                break
            self.buffer += more
        return self.buffer

    def skip(self, n: int) -> None:
        if n <= len(self.buffer):
            self.buffer = self.buffer[n:]
        else:
            self.file.seek(self.at + n)
            self.buffer = b""
        self.at += n


class Member:
    """The inflated bytes of one gzip member, or the plain bytes of a file."""

    def __init__(self, raw: Bytes, gzipped: bool):
        self.raw, self.gzipped, self.start = raw, gzipped, raw.at
        self.inflate = zlib.decompressobj(31) if gzipped else None
        self.held = b""

    def more(self) -> bool:
        data = self.raw.need(1)[:FEED]
        if not data or (self.gzipped and self.inflate.eof):
            return False
        self.held += self.inflate.decompress(data) if self.gzipped else data
        self.raw.skip(len(data) - (len(self.inflate.unused_data) if self.gzipped else 0))
        return True

    def until(self, mark: bytes) -> bytes | None:
        at = self.held.find(mark)
        while at < 0:
            seen = max(0, len(self.held) - len(mark))
            if not self.more():
                return None
            at = self.held.find(mark, seen)
        out, self.held = self.held[:at], self.held[at + len(mark):]
        return out

    def take(self, n: int) -> bytes:
        parts, have = [], 0
        while have < n:
            if not self.held and not self.more():
                break
            part = self.held[:n - have]
            parts.append(part)
            have += len(part)
            self.held = self.held[len(part):]
        return b"".join(parts)

    def drop(self, n: int) -> None:
        while n > 0 and (self.held or self.more()):
            part = min(n, len(self.held))
            self.held, n = self.held[part:], n - part


def _skip_length(head: bytes) -> int:
    """Compressed length of a member from its "sl" field, 0 where it has none."""
    if len(head) < 24 or not head[3] & 4:
        return 0
    end, at = 12 + int.from_bytes(head[10:12], "little"), 12
    while at + 4 <= min(end, len(head)):
        n = int.from_bytes(head[at + 2:at + 4], "little")
        if head[at:at + 2] == b"sl" and n == 8:
            return int.from_bytes(head[at + 4:at + 8], "little")
        at += 4 + n
    return 0


def _first_member(raw: Bytes, end: int) -> bool:
    """Go to the first member that starts before `end`; False if there is none."""
    while raw.at < end:
        data = raw.need(CHUNK)
        if not data:
            return False
        found = data.find(MAGIC)
        if found < 0:
            raw.skip(max(1, len(data) - len(MAGIC) + 1))
            continue
        raw.skip(found)
        try:
            if raw.at < end and zlib.decompressobj(31).decompress(raw.need(512)[:512], 5) == b"WARC/":
                return True
        except zlib.error:
            pass
        raw.skip(1)
    return False


def parse_headers(block: bytes) -> dict[str, str]:
    """Header fields by lower-case name; folded lines join the one before."""
    lines: list[str] = []
    for line in block.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and lines:
            lines[-1] += " " + line.strip()
        else:
            lines.append(line)
    pairs = (line.partition(":") for line in lines if ":" in line)
    return {name.strip().lower(): value.strip() for name, _, value in pairs}


def _row(headers: dict) -> dict:
    out = {c: headers.get(name) for c, name in NAMED.items()}
    if out["payload_digest"]:
        out["payload_digest"] = out["payload_digest"].removeprefix("sha1:")
    for c in ("refers_to", "record_id"):
        out[c] = out[c].removeprefix("<").removesuffix(">") if out[c] else out[c]
    length = headers.get(LENGTH)
    out["payload_length"] = int(length) if length and length.isdigit() else None
    length = headers.get("content-length")
    out["content_length"] = int(length) if length and length.isdigit() else None
    return out


def holds(row: dict, f) -> bool | None:
    """A pushed predicate on header columns; null as in SQL."""
    if isinstance(f, Not):
        inner = holds(row, f.child)
        return None if inner is None else not inner
    value = row[f.attribute[0]]
    if isinstance(f, IsNull):
        return value is None
    if isinstance(f, IsNotNull):
        return value is not None
    if isinstance(f, EqualNullSafe):
        return value == f.value
    if value is None:
        return None
    if isinstance(f, EqualTo):
        return value == f.value
    if isinstance(f, In):
        return True if value in f.value else (None if None in f.value else False)
    return value.startswith(f.value)


def can_push(f) -> bool:
    if isinstance(f, Not):
        return can_push(f.child)
    known = (EqualTo, EqualNullSafe, In, IsNull, IsNotNull, StringStartsWith)
    return isinstance(f, known) and len(f.attribute) == 1 and f.attribute[0] in {*NAMED, "payload_length", "content_length"}


def records(file, start: int, end: int, gzipped: bool, filters=(), payload: bool = True):
    """Rows of the records that start in bytes [start, end) and meet the filters."""
    raw = Bytes(file)
    if start:
        raw.skip(start)
    if gzipped and not _first_member(raw, end):
        return
    stream = None if gzipped else Member(raw, False)
    while True:
        if gzipped:
            if raw.at >= end or not raw.need(1):
                return
            skip = _skip_length(raw.need(CHUNK)[:CHUNK])
            stream = Member(raw, True)
        begin = raw.at
        block = stream.until(b"\r\n\r\n")
        if block is None:
            if gzipped and _first_member(raw, end):  # padding or damage between members
                continue
            return
        headers = parse_headers(block.lstrip(b"\r\n"))
        row = _row(headers)
        size = row["content_length"] or 0
        wanted = all(holds(row, f) is True for f in filters)
        row |= {"headers": list(headers.items()), "payload": None, "intact": None}
        if wanted and payload and row["record_type"] != "revisit":
            body = stream.take(size)
            if headers.get("content-type", "").replace(" ", "").startswith("application/http;msgtype=response"):
                body = body.partition(b"\r\n\r\n")[2]
            row["payload"] = body
            row["intact"] = None if row["payload_digest"] is None else digest(body) == row["payload_digest"]
        elif not gzipped:
            stream.drop(size)
        if wanted:
            yield row
        if gzipped and skip:  # behind this member, read or not
            back = begin + skip - raw.at
            if back >= 0:
                raw.skip(back)
                continue
        if gzipped:
            while stream.more():
                stream.held = b""
        else:
            while stream.held[:1] in (b"\r", b"\n") or (not stream.held and stream.more()):
                stream.held = stream.held.lstrip(b"\r\n")


class Range(InputPartition):
    def __init__(self, path, start, end):
        super().__init__(None)
        self.path, self.start, self.end = path, start, end


class WarcReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.payload = options.get("payload", "true").lower() == "true"
        self.split_bytes = int(options.get("split_bytes", SPLIT_BYTES))
        self.filters = []

    def pushFilters(self, filters):
        for f in filters:
            if can_push(f):
                self.filters.append(f)
            else:
                yield f

    def partitions(self):
        out = []
        for path, size in committed(self.path):
            step = self.split_bytes if path.endswith(".gz") else max(size, 1)
            out += [Range(path, at, min(at + step, size)) for at in range(0, size, step)]
        return out or [Range(None, 0, 0)]

    def read(self, partition):
        if partition.path is None:
            return
        system, _ = filesystem(self.path)
        with system.open_input_file(partition.path) as file:
            rows, held = [], 0
            found = records(file, partition.start, partition.end, partition.path.endswith(".gz"), self.filters, self.payload)
            for row in found:
                rows.append(row)
                held += len(row["payload"] or b"")
                if len(rows) >= BATCH_ROWS or held >= BATCH_PAYLOAD:
                    yield pa.RecordBatch.from_pylist(rows, schema=ARROW)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=ARROW)


def committed(path: str) -> list[tuple[str, int]]:
    """Files of a folder that count, with their sizes; a path of a file is that file."""
    system, at = filesystem(path)
    info = system.get_file_info(at)
    if info.type == pafs.FileType.File:
        return [(at, info.size)]
    files = [f for f in system.get_file_info(pafs.FileSelector(at, allow_not_found=True)) if f.type == pafs.FileType.File]
    lists = [f for f in files if f.base_name.startswith("_files-")]
    named = set()
    for f in lists:
        with system.open_input_stream(f.path) as file:
            named |= set(file.read().decode().split())
    archives = [f for f in files if f.base_name.endswith((".warc", ".warc.gz"))]
    return sorted((f.path, f.size) for f in archives if not lists or f.base_name in named)


# --- writing ----------------------------------------------------------------------------


def _value(text: str) -> str:
    """A header value on one line."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in text)


def member(record: bytes) -> bytes:
    """One gzip member with its own lengths in an "sl" field, where they fit."""
    deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = deflate.compress(record) + deflate.flush()
    tail = struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)
    whole_length = 10 + 2 + 12 + len(body) + 8
    if whole_length >= 1 << 32 or len(record) >= 1 << 32:
        return MAGIC + b"\x00" + bytes(4) + b"\x00\xff" + body + tail
    extra = b"sl" + struct.pack("<HII", 8, whole_length, len(record))
    return MAGIC + b"\x04" + bytes(4) + b"\x00\xff" + struct.pack("<H", len(extra)) + extra + body + tail


def record_bytes(row: dict) -> bytes:
    """One record of the columns of the schema; `payload` null writes an empty block."""
    headers = {
        "WARC-Type": row["record_type"], "WARC-Record-ID": f"<{row['record_id']}>", "WARC-Date": row["date"],
        "WARC-Target-URI": row["target_uri"],
        "WARC-Payload-Digest": row["payload_digest"] and f"sha1:{row['payload_digest']}",
        "WARC-Refers-To": row["refers_to"] and f"<{row['refers_to']}>",
        "Payload-Length": None if row["payload_length"] is None else str(row["payload_length"]),
    }
    block = row["payload"] or b""
    if row["record_type"] == "response":
        headers["Content-Type"] = "application/http; msgtype=response"
        block = (
            b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + f"Content-Length: {len(block)}\r\n\r\n".encode() + block)
    elif row["record_type"] == "revisit":
        headers["WARC-Profile"] = PROFILE
    headers |= dict(row["headers"] or ())
    headers["Content-Length"] = str(len(block))
    lines = [f"{name}: {_value(value)}" for name, value in headers.items() if value is not None]
    return ("WARC/1.1\r\n" + "\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


class Written(WriterCommitMessage):
    def __init__(self, names):
        self.names = names


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options, overwrite):
        self.path, self.overwrite = options["path"], overwrite
        self.file_bytes = int(options.get("file_bytes", FILE_BYTES))
        self.gzipped = options.get("gzip", "true").lower() == "true"

    def write(self, iterator):
        system, at = filesystem(self.path)
        system.create_dir(at, recursive=True)
        names, file, size = [], None, 0
        try:
            for batch in iterator:
                columns = [batch.column(batch.schema.get_field_index(c)) for c in ARROW.names[:-1]]
                for i in range(batch.num_rows):
                    record = record_bytes(dict(zip(ARROW.names, (c[i].as_py() for c in columns), strict=False)))
                    if file is None:
                        names.append(f"{uuid.uuid4().hex}.warc" + (".gz" if self.gzipped else ""))
                        file, size = system.open_output_stream(f"{at}/{names[-1]}", compression=None), 0
                    data = member(record) if self.gzipped else record
                    file.write(data)
                    size += len(data)
                    if size >= self.file_bytes:
                        file.close()
                        file = None
        finally:
            if file is not None:
                file.close()
        return Written(names)

    def commit(self, messages):
        system, at = filesystem(self.path)
        system.create_dir(at, recursive=True)
        before = [f for f in system.get_file_info(pafs.FileSelector(at)) if f.base_name.startswith("_files-")]
        with system.open_output_stream(f"{at}/_files-{uuid.uuid4().hex}") as file:
            file.write("\n".join(n for m in messages if m for n in m.names).encode())
        for f in before if self.overwrite else []:
            system.delete_file(f.path)

    def abort(self, messages):
        system, at = filesystem(self.path)
        for name in (n for m in messages if m for n in m.names):
            system.delete_file(f"{at}/{name}")


class Warc(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Make format `warc` known to a session, with its predicates pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Warc)


# --- pages ------------------------------------------------------------------------------

ID = "tag:closebook,2026:page/"


def _base32(hexadecimal):
    """Base32 of 40 hexadecimal digits: four letters for every five of them."""
    letters = []
    for at in range(0, 40, 5):
        number = F.conv(F.substring(hexadecimal, at + 1, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            letter = F.shiftright(number, shift).bitwiseAND(F.lit(31))
            letters.append(F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), letter + 1, F.lit(1)))
    return F.concat(*letters)


def archive_records(pages: DataFrame, least_bytes: int = 0, date: str = "2026-01-01T00:00:00Z") -> DataFrame:
    """Records of pages (page_id, url, html) in the columns of the data source.

    Equal payloads meet by digest. The pages are read twice: once for the least id of each
    digest, once for the records. Only digests with more than one page are looked up, and
    one that is hot is dealt over `SALTS` keys on both sides, so the copies of one payload
    never meet in one task.
    """
    payload = F.encode(whole("html"), "UTF-8")
    rows = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("size", F.octet_length("payload").cast("bigint")).withColumn("hex", F.sha1("payload"))
    copies = rows.where(F.col("size") >= least_bytes).groupBy("hex").agg(
        F.count("*").alias("n"), F.min("page_id").alias("first")).where("n > 1 AND first IS NOT NULL")
    # Written, so that Spark knows their sizes when it picks the joins: where few pages are
    # copies nothing is shuffled.
    copies = written(copies, "copies")
    hot = written(copies.where(F.col("n") > HOT).select("hex", F.lit(True).alias("hot")), "hot")
    several = copies.select(
        "hex", "first", F.explode(F.sequence(F.lit(0), F.when(F.col("n") > HOT, SALTS - 1).otherwise(0))).alias("salt"))
    salted = rows.join(hot, "hex", "left").withColumn(
        "salt", F.when(F.col("hot"), F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).otherwise(0))
    joined = salted.join(several, ["hex", "salt"], "left")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select(
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.concat(F.lit(ID), F.coalesce(F.col("page_id").cast("string"), F.lit(""))).alias("record_id"),
        F.col("url").alias("target_uri"), F.lit(date).alias("date"), _base32(F.col("hex")).alias("payload_digest"),
        F.when(again, F.concat(F.lit(ID), F.col("first").cast("string"))).alias("refers_to"),
        F.col("size").alias("payload_length"), F.lit(None).cast("bigint").alias("content_length"),
        F.lit(None).cast("map<string,string>").alias("headers"), F.when(~again, F.col("payload")).alias("payload"),
        F.lit(None).cast("boolean").alias("intact"),
    )


#: Copies from which a digest is dealt over several keys, and how many.
HOT, SALTS = 1000, 64


def write_pages(pages: DataFrame, path: str, least_bytes: int = 0) -> None:
    register(pages.sparkSession)
    archive_records(pages, least_bytes).write.format("warc").mode("append").save(path)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Pages of an archive: responses measured by their payloads, revisits by their headers.

    A response whose payload does not have the digest of its header fails the query.
    """
    register(spark)
    source = spark.read.format("warc")
    responses = source.load(path).where("record_type = 'response'").select(
        "record_id", F.octet_length("payload").cast("bigint").alias("payload_bytes"),
        F.when(F.col("intact"), F.col("payload_digest")).otherwise(F.raise_error(F.lit("a payload differs from its digest")))
        .alias("payload_digest"), "record_type", "refers_to", F.col("target_uri").alias("url"))
    revisits = source.option("payload", "false").load(path).where("record_type = 'revisit'").select(
        "record_id", F.col("payload_length").alias("payload_bytes"), "payload_digest", "record_type", "refers_to",
        F.col("target_uri").alias("url"))
    number = "try_cast(substring({}, " + str(len(ID) + 1) + ") AS bigint)"
    return responses.unionByName(revisits).select(
        F.expr(number.format("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.expr(number.format("refers_to")).alias("refers_to"))


SQL = """
WITH bodies AS (SELECT page_id, COALESCE(html, '') AS body, sha1(COALESCE(html, '')) AS hex FROM pages),
firsts AS (SELECT page_id, body, hex, min(page_id) OVER (PARTITION BY body) AS first FROM bodies),
digits AS (SELECT unnest(range(0, 8)) AS five),
letters AS (
    SELECT hex, five, k, substring('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        CAST(CAST('0x' || substring(hex, CAST(five * 5 + 1 AS INTEGER), 5) AS INTEGER) // (CASE k WHEN 0 THEN 32768 WHEN 1 THEN 1024 WHEN 2 THEN 32 ELSE 1 END) % 32 + 1 AS INTEGER), 1) AS letter
    FROM (SELECT DISTINCT hex FROM bodies), digits, (SELECT unnest(range(0, 4)) AS k)),
digests AS (SELECT hex, string_agg(letter, '' ORDER BY five, k) AS digest FROM letters GROUP BY hex)
SELECT page_id, CAST(octet_length(encode(body)) AS BIGINT) AS payload_bytes, digest AS payload_digest,
    CASE WHEN first IS NULL OR page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN first IS NULL OR page_id = first THEN NULL ELSE first END AS refers_to
FROM firsts JOIN digests USING (hex)"""


@query("op12_warc_archive", SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written to an archive, copies as revisits, and read back."""
    path = scratch_path(spark, "warc")
    write_pages(table(spark, sf_dir, "pages"), path)
    return read_pages(spark, path)
