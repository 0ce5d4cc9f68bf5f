"""WARC archives as a Spark data source: ``spark.read.format("warc")`` and ``df.write.format("warc")``.

Reading plans partitions over files. Equality and ``IN`` filters on the record type and on header columns are pushed into
the reader, which inflates and parses a record's headers first: a record that the filters refuse, or any record when
``payload`` is false, is left by a seek. Records are gzip members of their own; each member's header has an ``SL`` extra
field with its whole length, so leaving a record costs no inflation. Members without that field and plain ``.warc`` files are read too.

Columns: ``record_type, record_id, target_uri, warc_date, content_type, payload_digest, refers_to, content_length, headers,
http_headers, payload, file, offset``. A record without HTTP headers has its whole block as payload. Header names are lower-cased in the maps.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, In, InputPartition, WriterCommitMessage

from . import _common as C

SCHEMA = (
    "record_type string, record_id string, target_uri string, warc_date string, content_type string, payload_digest string, refers_to string, "
    "content_length long, headers map<string,string>, http_headers map<string,string>, payload binary, file string, offset long"
)
_HEADER = {"record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "warc_date": "warc-date", "content_type": "content-type", "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to"}
_BLANK = b"\r\n\r\n"


def _clean(value) -> str:
    """A header value on one line."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", str(value))


def record_bytes(row: dict) -> bytes:
    """One record: WARC headers, HTTP headers and, but for a revisit, the payload."""
    payload = bytes(row.get("payload") or b"")
    kind = row.get("record_type") or "resource"
    http = kind in ("response", "revisit")
    block = b""
    if http:
        size = row.get("payload_length")
        block = f"HTTP/1.1 200 OK\r\nContent-Type: {_clean(row.get('content_type') or 'text/html; charset=utf-8')}\r\nContent-Length: {len(payload) if size is None else size}\r\n\r\n".encode()
    if kind != "revisit":
        block += payload
    head = ["WARC/1.1", f"WARC-Type: {_clean(kind)}", f"WARC-Record-ID: {_clean(row.get('record_id') or f'<urn:uuid:{uuid.uuid4()}>')}"]
    head.append(f"WARC-Date: {_clean(row.get('warc_date') or '1970-01-01T00:00:00Z')}")
    for column, name in (("target_uri", "WARC-Target-URI"), ("payload_digest", "WARC-Payload-Digest"), ("refers_to", "WARC-Refers-To")):
        if row.get(column) is not None:
            head.append(f"{name}: {_clean(row[column])}")
    if kind == "revisit":
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    head.append(f"Content-Type: {'application/http; msgtype=response' if http else _clean(row.get('content_type') or 'application/octet-stream')}")
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + _BLANK + block + _BLANK


def member(data: bytes, level: int = 4) -> bytes:
    """A gzip member whose extra field ``SL`` has the member's length and the length of its content."""
    c = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = c.compress(data) + c.flush()
    extra = b"SL" + struct.pack("<HII", 8, 24 + len(body) + 8, len(data))
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def _headers(data: bytes) -> dict[str, str]:
    out = {}
    for line in data.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        out[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "surrogatepass").strip()
    return out


class _Part(InputPartition):
    def __init__(self, files: list[str]):
        self.files = files


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.payload = options["path"], options.get("payload", "true").lower() != "false"
        self.split, self.wanted = int(options.get("splitbytes", 64 << 20)), {}

    def pushFilters(self, filters) -> Iterator:
        for f in filters:
            column = f.attribute[0] if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 else None
            if column in _HEADER:
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted[column] = self.wanted.get(column, values) & values
            else:
                yield f

    def partitions(self) -> list[_Part]:
        from pyarrow import fs

        files, path = fs.FileSystem.from_uri(self.path)
        info = files.get_file_info(fs.FileSelector(path, recursive=True))
        found = sorted((x.path, x.size) for x in info if x.is_file and re.search(r"\.warc(\.gz)?$", x.path) and not x.base_name.startswith(("_", ".")))
        parts, own, held = [], [], 0
        for name, size in found:
            if own and held + size > self.split:
                parts.append(_Part(own))
                own, held = [], 0
            own.append(name)
            held += size
        return [*parts, *([_Part(own)] if own else [])]

    def _refused(self, headers: dict[str, str]) -> bool:
        return any(headers.get(_HEADER[c]) not in v for c, v in self.wanted.items())

    def _gz(self, f, size: int) -> Iterator[tuple[int, dict, bytes | None]]:
        at = 0
        while at < size:
            f.seek(at)
            first = f.read(4096)
            length = struct.unpack_from("<I", first, 16)[0] if first[3] == 4 and first[12:16] == b"SL\x08\x00" else 0
            z, out = zlib.decompressobj(31), b""
            fed, data = at + len(first), first
            while True:
                out += z.decompress(data)
                if _BLANK in out or z.eof:
                    break
                data = f.read(4096)
                fed += len(data)
                if not data:
                    raise ValueError("a WARC record ends early")
            head, _, block = out.partition(_BLANK)
            headers = _headers(head)
            keep = not self._refused(headers)
            if not length or (keep and self.payload):
                rest = [block]
                while not z.eof:
                    data = f.read(1 << 16)
                    fed += len(data)
                    if not data:
                        raise ValueError("a WARC record ends early")
                    piece = z.decompress(data)
                    if keep and self.payload:
                        rest.append(piece)
                block = b"".join(rest)
                length = length or fed - at - len(z.unused_data)
            elif keep:  # the HTTP headers only
                while _BLANK not in block and not z.eof and (data := f.read(4096)):
                    block += z.decompress(data)
            if keep:
                yield at, headers, block[: int(headers.get("content-length", 0))]
            at += length

    def _plain(self, f, size: int) -> Iterator[tuple[int, dict, bytes]]:
        at = 0
        while at < size:
            f.seek(at)
            head = b""
            while _BLANK not in head:
                data = f.read(4096)
                if not data:
                    raise ValueError("a WARC record ends early")
                head += data
            head, _, block = head.partition(_BLANK)
            headers = _headers(head)
            n = int(headers.get("content-length", 0))
            if not self._refused(headers):
                if self.payload and len(block) < n:
                    block += f.read(n - len(block))
                yield at, headers, block[:n]
            at += len(head) + 4 + n + 4

    def read(self, partition: _Part) -> Iterator:
        import pyarrow as pa
        from pyarrow import fs

        files, _ = fs.FileSystem.from_uri(self.path)
        text, pairs = pa.string(), pa.map_(pa.string(), pa.string())
        types = [text] * 7 + [pa.int64(), pairs, pairs, pa.binary(), text, pa.int64()]
        names = [x.split()[0] for x in SCHEMA.split(", ")]

        def batch(rows: list[tuple]):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

        for name in partition.files if partition else []:  # none without a file
            rows, held = [], 0
            size = files.get_file_info(name).size
            with files.open_input_file(name) as f:
                for at, headers, block in (self._gz if name.endswith(".gz") else self._plain)(f, size):
                    http = {}
                    if headers.get("content-type", "").startswith("application/http"):
                        head, _, block = block.partition(_BLANK)
                        http = _headers(head)
                    payload = block if self.payload and headers.get("warc-type") != "revisit" else None
                    own = [headers.get(h) for h in _HEADER.values()]
                    rows.append((*own, int(headers.get("content-length", 0)), list(headers.items()), list(http.items()), payload, name, at))
                    held += len(payload or b"")
                    if held > 8 << 20 or len(rows) >= 5_000:
                        yield batch(rows)
                        rows, held = [], 0
            if rows:
                yield batch(rows)


class _Written(WriterCommitMessage):
    def __init__(self, files: list[tuple[str, str]]):
        self.files = files


class WarcWriter(DataSourceWriter):
    """Each task writes files of about ``filebytes`` under a hidden name; the commit renames those of the tasks that count."""

    def __init__(self, options: dict, columns: list[str], overwrite: bool):
        self.path, self.columns, self.limit = options["path"], columns, int(options.get("filebytes", 64 << 20))
        self.gzip, self.overwrite = options.get("compression", "gzip") == "gzip", overwrite

    def write(self, rows: Iterator) -> _Written:
        from pyarrow import fs

        files, path = fs.FileSystem.from_uri(self.path)
        files.create_dir(path, recursive=True)
        done, f, held = [], None, 0
        for row in rows:
            data = record_bytes({c: row[k] for k, c in enumerate(self.columns)})
            data = member(data) if self.gzip else data
            if f is None or held + len(data) > self.limit:
                if f is not None:
                    f.close()
                name = f"part-{uuid.uuid4().hex}.warc" + ".gz" * self.gzip
                done.append((f"{path}/.{name}", f"{path}/{name}"))
                f, held = files.open_output_stream(done[-1][0], compression=None), 0
            f.write(data)
            held += len(data)
        if f is not None:
            f.close()
        return _Written(done)

    def commit(self, messages) -> None:
        from pyarrow import fs

        files, path = fs.FileSystem.from_uri(self.path)
        files.create_dir(path, recursive=True)
        if self.overwrite:
            for x in files.get_file_info(fs.FileSelector(path)):
                if x.is_file and not x.base_name.startswith("."):
                    files.delete_file(x.path)
        for m in messages:
            for hidden, name in m.files if m else []:
                files.move(hidden, name)

    def abort(self, messages) -> None:
        from pyarrow import fs

        files, _ = fs.FileSystem.from_uri(self.path)
        for m in messages:
            for hidden, _ in m.files if m else []:
                files.delete_file(hidden)


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader({k.lower(): v for k, v in self.options.items()})

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter({k.lower(): v for k, v in self.options.items()}, [f.name for f in schema.fields], overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known to the session and let it take filters."""
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def write_pages(pages: DataFrame, path: str, least_bytes: int = 1000, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """A record for each row: a response, or a revisit of the row with the largest id among equal payloads of ``least_bytes`` or more.

    A null payload is empty. Rows that share that largest id are all responses. A row with a null id revisits the largest
    id; where all ids of equal payloads are null, all are responses. Other columns are not read.
    """
    register(pages.sparkSession)
    payload = F.coalesce(F.col(html_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("target_uri"), payload.alias("payload"))
    rows = rows.withColumns({"sha1": F.sha1("payload"), "payload_length": F.octet_length("payload").cast("long")})
    most = rows.where(F.col("payload_length") >= least_bytes).groupBy("sha1").agg(F.max("id").alias("first"), F.count(F.lit(1)).alias("n"))
    copied = C.written(most.where("n > 1"), "copied-digests")
    # fewer than 2,000 digests have more than a 2,000th of the copies: these are broadcast, so no task has all rows of a common page
    least = max(100, (copied.agg(F.sum("n")).first()[0] or 0) // 2_000)
    common = F.broadcast(copied.where(F.col("n") > least).select("sha1", F.col("first").alias("common")))
    rows = rows.join(common, "sha1", "left")
    # short payloads and common ones have nothing to find, and are dealt by their id
    alone = F.concat(F.lit("-"), F.xxhash64("id", "target_uri").cast("string"))
    rows = rows.withColumn("key", F.when((F.col("payload_length") >= least_bytes) & F.col("common").isNull(), F.col("sha1")).otherwise(alone))
    rest = copied.where(F.col("n") <= least).select(F.col("sha1").alias("key"), F.col("first").alias("seldom"))
    rows = rows.join(rest, "key", "left").withColumn("first", F.coalesce("common", "seldom"))
    again = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")), F.lit(">"))
    rows.select(
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        urn("id").alias("record_id"),
        "target_uri",
        F.when(~again, F.col("payload")).alias("payload"),
        "payload_length",
        F.concat(F.lit("sha1:"), "sha1").alias("payload_digest"),
        F.when(again, urn("first")).alias("refers_to"),
    ).write.format("warc").mode("append").save(path)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to, url``: responses from their payloads, revisits from headers alone."""
    register(spark)
    number = lambda c: F.regexp_extract(c, r"urn:page:(-?\d+)", 1)
    page = lambda c: F.when(number(c) != "", number(c).cast("long"))
    rest = ["record_type", page("refers_to").alias("refers_to"), F.col("target_uri").alias("url")]
    full = spark.read.format("warc").load(path).where(F.col("record_type") == "response")
    full = full.select(page("record_id").alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"), *rest)
    bare = spark.read.format("warc").option("payload", "false").load(path).where(F.col("record_type") == "revisit")
    bare = bare.select(page("record_id").alias("page_id"), F.col("http_headers")["content-length"].cast("long").alias("payload_bytes"), F.regexp_replace("payload_digest", "^sha1:", "").alias("payload_digest"), *rest)
    return full.unionByName(bare)


def op1_warc(spark, sf_dir: str) -> DataFrame:
    """Every row of ``pages`` as its record tells; a null html is an empty payload, and null ids are kept."""
    path = C.new_folder(spark, "warc")
    write_pages(C.read(spark, sf_dir, "pages"), path)
    return read_pages(spark, path).drop("url")


OP1_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages), q AS (
  SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, sha1(html) AS payload_digest, max(page_id) OVER (PARTITION BY html) AS first FROM p
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> first THEN first END AS refers_to
FROM q
"""
