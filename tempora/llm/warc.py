"""Operator 9: WARC archives as a Spark data source.

Writing: each task writes record-at-a-time gzip members (with the `sl` skip lengths of the WARC
standard's annex) to files of its own in a shared folder; the driver publishes only the files of
tasks that committed, so a lost or repeated task leaves nothing double. Reading: files are dealt out as
partitions; predicates on the record type and on headers are pushed down; of each record the headers
are parsed first, and an unwanted record's payload is skipped by its length without being decoded.
Plain and foreign gzip files without skip lengths are read too, at the price of inflating what is skipped.

Paths are local or shared mounts (file:), or any store that pyarrow.fs opens.

Defined results of `archive`: a null html has the empty payload; a null page_id is smaller than all
others, and if all of a group are null each is a response; rows repeated with the largest page_id of
their group are each a response; an empty table gives an empty archive; further columns are ignored.
"""

from __future__ import annotations

import base64
import struct
import urllib.parse
import uuid
import zlib
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, WriterCommitMessage

from . import common

SCHEMA = "record_type string, record_id string, target_uri string, page_id long, refers_to long, payload_digest string, payload_bytes long, payload binary"
FILE_BYTES = 1 << 30
REVISIT_BYTES = 1000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: The header behind each column that can be tested before a payload is decoded.
HEADERS = {"record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "page_id": "x-page-id", "refers_to": "x-refers-to-page", "payload_digest": "warc-payload-digest"}
DATE = "2000-01-01T00:00:00Z"


def store_of(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), urllib.parse.urlparse(path).path
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def record(row: dict) -> bytes:
    """One record, uncompressed."""
    payload = (row["html"] or "").encode()
    head = [("WARC-Type", row["record_type"]), ("WARC-Record-ID", record_id(row["page_id"])), ("WARC-Date", DATE)]
    if row["url"] is not None:
        head.append(("WARC-Target-URI", urllib.parse.quote(row["url"], safe=":/?#[]@!$&'()*+,;=%~-._")))
    if row["page_id"] is not None:
        head.append(("X-Page-Id", row["page_id"]))
    head += [("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(row["digest"])).decode()), ("X-Payload-Length", len(payload))]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if row["record_type"] == "revisit":
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(row["refers_to"])), ("X-Refers-To-Page", row["refers_to"])]
        block = http
    else:
        block = http + payload
    head += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", len(block))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 6) -> bytes:
    """A gzip member whose extra field tells how far to skip."""
    c = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = c.compress(data) + c.flush()
    extra = struct.pack("<2sHII", b"sl", 8, 12 + 12 + len(body) + 8 & 0xFFFFFFFF, len(data) & 0xFFFFFFFF)
    return struct.pack("<BBBBIBBH", 31, 139, 8, 4, 0, 0, 255, len(extra)) + extra + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


@dataclass
class Committed(WriterCommitMessage):
    files: list[str]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator):
        store, base = store_of(self.path)
        files, out = [], None
        for batch in iterator:
            for row in batch.to_pylist():
                if out is None or out.tell() > FILE_BYTES:
                    if out:
                        out.close()
                    name = f"part-{uuid.uuid4().hex}.warc.gz"
                    files.append(name)
                    store.create_dir(f"{base}/_pending", recursive=True)
                    out = store.open_output_stream(f"{base}/_pending/{name}", compression=None)
                out.write(member(record(row)))
        if out:
            out.close()
        return Committed(files)

    def commit(self, messages):
        store, base = store_of(self.path)
        store.create_dir(base, recursive=True)
        for m in messages:
            for name in m.files if m else ():
                store.move(f"{base}/_pending/{name}", f"{base}/{name}")

    def abort(self, messages):
        store, base = store_of(self.path)
        for m in messages:
            for name in m.files if m else ():
                store.delete_file(f"{base}/_pending/{name}")


class Stream:
    """A file, read forward; hands out records whose head is parsed and whose block is still raw."""

    def __init__(self, raw):
        self.raw, self.held = raw, b""

    def need(self, n: int) -> bytes:
        while len(self.held) < n and (more := self.raw.read(max(1 << 16, n - len(self.held)))):
            self.held += more
        return self.held[:n]

    def drop(self, n: int) -> None:
        if n > len(self.held):
            self.raw.seek(self.raw.tell() + n - len(self.held))
            self.held = b""
        else:
            self.held = self.held[n:]

    def records(self, wanted):
        """(headers, block) of each record that `wanted` accepts by its headers."""
        while len(start := self.need(2)) == 2:
            if start == b"\x1f\x8b":
                yield from self._gzip(wanted)
            else:
                yield from self._plain(wanted)

    def _plain(self, wanted):
        n, end = 4096, -1
        while (end := self.need(n).find(b"\r\n\r\n")) < 0 and len(self.held) >= n:
            n *= 2
        if end < 0:
            self.held = b""
            return
        head = parse(self.held[:end])
        self.drop(end + 4)
        size = int(head.get("content-length", 0))
        if wanted(head):
            yield head, self.need(size)
        self.drop(size + 4)

    def _gzip(self, wanted):
        fixed = self.need(12)
        flags, size = fixed[3], 0
        if flags & 4:
            (xlen,) = struct.unpack("<H", fixed[10:12])
            extra = self.need(12 + xlen)[12:]
            if extra[:2] == b"sl":
                size = struct.unpack("<I", extra[4:8])[0]
        if size:
            d = zlib.decompressobj(31)
            data = d.decompress(self.need(min(size, 4096)), 1 << 14)
            while b"\r\n\r\n" not in data and not d.eof:
                self.need(size)
                data += d.decompress(d.unconsumed_tail or self.held[4096:size], 1 << 16)
            end = data.find(b"\r\n\r\n")
            head = parse(data[:end])
            if wanted(head):
                whole = zlib.decompress(self.need(size), 31)
                yield head, whole[end + 4 : end + 4 + int(head.get("content-length", 0))]
            self.drop(size)
            return
        d, parts = zlib.decompressobj(31), []
        while not d.eof and (piece := self.need(1 << 16)):
            self.held = self.held[len(piece) :]
            parts.append(d.decompress(piece))
        self.held = d.unused_data + self.held
        data = b"".join(parts)
        while (end := data.find(b"\r\n\r\n")) >= 0:
            head = parse(data[:end])
            size = int(head.get("content-length", 0))
            if wanted(head):
                yield head, data[end + 4 : end + 4 + size]
            data = data[end + 8 + size :]


def parse(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


@dataclass
class FilePart(InputPartition):
    path: str


def digest_text(value: str) -> str:
    """A digest header as it is compared and returned: bare lower-case hex."""
    return base64.b32decode(value.removeprefix("sha1:")).hex() if value.startswith("sha1:") and len(value) == 37 else value.removeprefix("sha1:").lower()


class WarcReader(DataSourceReader):
    def __init__(self, path: str, payload: bool):
        self.path, self.payload, self.tests = path, payload, []

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, EqualTo | In) and len(f.attribute) == 1 and f.attribute[0] in HEADERS:
                self.tests.append((f.attribute[0], {str(v) for v in (f.value if isinstance(f, In) else [f.value])}))
            else:
                yield f

    def partitions(self):
        store, base = store_of(self.path)
        infos = store.get_file_info(pafs.FileSelector(base, allow_not_found=True))
        return [FilePart(i.path) for i in infos if i.is_file and i.base_name.endswith((".warc", ".warc.gz"))]

    def wanted(self, head: dict[str, str]) -> bool:
        for column, values in self.tests:
            v = head.get(HEADERS[column])
            if v is None or (digest_text(v) if column == "payload_digest" else v) not in values:
                return False
        return True

    def read(self, partition):
        if partition is None:  # no files, no partitions
            return
        store, _ = store_of(self.path)
        rows, held = [], 0
        with store.open_input_file(partition.path) as f:
            for head, block in Stream(f).records(self.wanted):
                whole = lambda k: int(head[k]) if k in head else None  # noqa: B023, E731
                kind, payload, size = head.get("warc-type"), None, whole("x-payload-length")
                if self.payload and kind != "revisit":
                    payload = block.partition(b"\r\n\r\n")[2] if head.get("content-type", "").startswith("application/http") else block
                    size = len(payload)
                digest = head.get("warc-payload-digest")
                rows.append((kind, head.get("warc-record-id"), head.get("warc-target-uri"), whole("x-page-id"), whole("x-refers-to-page"), digest and digest_text(digest), size, payload))
                held += len(payload or b"")
                if held > 4_000_000 or len(rows) >= 5000:
                    yield batch_of(rows)
                    rows, held = [], 0
        if rows:
            yield batch_of(rows)


ARROW = pa.schema([("record_type", pa.string()), ("record_id", pa.string()), ("target_uri", pa.string()), ("page_id", pa.int64()), ("refers_to", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())])


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), ARROW, strict=True)], schema=ARROW)


class WarcSource(DataSource):
    """format("warc"): option `payload` = "none" leaves payloads undecoded."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options["path"], self.options.get("payload") != "none")

    def writer(self, schema, overwrite):
        return WarcWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


#: Pages of equal payload beyond which their group is known to all tasks.
HOT_PAGES = 1000


def archive(pages: DataFrame, path: str, least: int = REVISIT_BYTES) -> None:
    """Writes a record for each page: equal payloads of at least `least` bytes are revisits of the one with the largest page_id."""
    register(pages.sparkSession)
    rows = pages.select("page_id", "url", "html", F.sha1(F.coalesce("html", F.lit("")).cast("binary")).alias("digest"), F.coalesce(F.octet_length("html"), F.lit(0)).alias("size"))
    # digests only are shuffled to find the groups; a group of any size becomes one row
    found = rows.where(F.col("size") >= least).groupBy(F.col("digest").alias("g_digest")).agg(F.max("page_id").alias("keeper"), F.count("*").alias("k")).where("k > 1")
    groups = common.stored(found, "digests")
    # the payloads of a large group's pages are not brought together: such groups are few (each has over HOT_PAGES pages) and go to all tasks
    hot = groups.where(F.col("k") > HOT_PAGES).select(F.col("g_digest").alias("h_digest"), F.col("keeper").alias("h_keeper"))
    hot = F.broadcast(hot) if hot.count() <= common.BROADCAST_IDS else hot
    shared = F.col("size") >= least
    rows = rows.join(hot, shared & (F.col("digest") == F.col("h_digest")), "left")
    # other pages meet their group by digest; those that need none are spread by their own key
    alone = F.concat_ws("#", F.lit("page"), F.xxhash64("page_id", "url"))
    rows = rows.withColumn("key", F.when(shared & F.col("h_keeper").isNull(), F.col("digest")).otherwise(alone))
    groups = groups.where(F.col("k") <= HOT_PAGES).drop("k")
    revisit = F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper"))
    marked = rows.join(groups, F.col("key") == F.col("g_digest"), "left").withColumn("keeper", F.coalesce("h_keeper", "keeper"))
    marked.select("page_id", "url", "html", "digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("keeper")).alias("refers_to")).write.format("warc").mode("append").save(path)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{common.shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    archive(common.documents(spark, sf_dir, "pages"), path)
    read = lambda payload, kind: spark.read.format("warc").option("payload", payload).load(path).where(F.col("record_type") == kind)
    full = read("all", "response").select("page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"), "record_type", "refers_to")
    return full.unionByName(read("none", "revisit").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))
