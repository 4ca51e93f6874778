"""WARC archives as a PySpark Python data source, with revisit records for repeated payloads.

Reading plans one partition per archive (writing rolls archives over at a size, so partitions are bounded). Equality
and IN predicates on header columns are pushed down. A record's header is parsed first; if no predicate wants
it, or the payload isn't asked for, its block is skipped: by a seek where the gzip member tells its own length in an
extra field (as this writer's do), else by inflating and discarding in blocks.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, In, InputPartition, WriterCommitMessage

from .common import HEAVY_KEYS, shared_dir, table

#: Columns from headers, in order, and the payload. All header columns can be pushed down.
HEADERS = {
    "record_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI", "payload_digest": "WARC-Payload-Digest",
    "refers_to": "WARC-Refers-To", "date": "WARC-Date", "key": "X-Row-Key", "refers_to_key": "X-Refers-To-Row-Key", "payload_bytes": "X-Payload-Length",
}
SCHEMA = ", ".join(f"{c} {'long' if c in ('key', 'refers_to_key', 'payload_bytes') else 'string'}" for c in HEADERS) + ", payload binary"
LONGS = {"key", "refers_to_key", "payload_bytes"}
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ROLL = 64 << 20
EXTRA = b"LN"  # of the gzip extra field: the member's length
CHUNK = 1 << 16


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# ---------------------------------------------------------------- format
def member(data: bytes, level: int = 3) -> bytes:
    """A gzip member that holds its own length in an extra field."""
    coder = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = coder.compress(data) + coder.flush()
    total = 10 + 2 + 8 + len(body) + 8
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", 8) + EXTRA + struct.pack("<HI", 4, total)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def record(headers: dict[str, str], block: bytes) -> bytes:
    lines = [b"WARC/1.1"] + [f"{k}: {_clean(v)}".encode() for k, v in headers.items() if v is not None]
    return b"\r\n".join([*lines, b"Content-Length: %d" % len(block), b"", b""]) + block + b"\r\n\r\n"


def _clean(value: str) -> str:
    return "".join(f"%{ord(c):02X}" if c < " " or c == "\x7f" else c for c in str(value))


class Source:
    """Bytes of one archive, plain or of gzip members, record by record."""

    def __init__(self, file) -> None:
        self.file, self.gz = file, file.read(2) == b"\x1f\x8b"
        file.seek(0)
        self.buffer, self.inflate, self.next = b"", None, None

    def fill(self) -> bool:
        """One more block of inflated bytes; False at the end of the member (or file)."""
        if not self.gz:
            got = self.file.read(CHUNK)
            self.buffer += got
            return bool(got)
        if self.inflate is None:
            head = self.file.read(20)
            if not head:
                return False
            start = self.file.tell() - len(head)
            tells = len(head) == 20 and head[3] & 4 and head[12:14] == EXTRA
            self.next = start + struct.unpack("<I", head[16:20])[0] if tells else None
            self.inflate, raw = zlib.decompressobj(31), head
        else:
            raw = b""
        while True:
            raw = raw or self.file.read(CHUNK if self.next is None else min(CHUNK, max(4096, self.next - self.file.tell())))
            if not raw:
                return False
            got = self.inflate.decompress(raw)
            if self.inflate.eof:
                self.file.seek(self.file.tell() - len(self.inflate.unused_data))
                self.inflate = None
                self.buffer += got
                return bool(got) or self.fill()
            if got:
                self.buffer += got
                return True
            raw = b""

    def header(self) -> dict[str, str] | None:
        while True:
            self.buffer = self.buffer.lstrip(b"\r\n")
            if (end := self.buffer.find(b"\r\n\r\n")) >= 0:
                break
            if not self.fill():
                return None
        lines, self.buffer = self.buffer[:end].decode("utf-8", "replace").split("\r\n"), self.buffer[end + 4 :]
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
        return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}

    def block(self, length: int) -> bytes:
        parts, have = [self.buffer], len(self.buffer)
        self.buffer = b""
        while have < length and self.fill():
            parts.append(self.buffer)
            have += len(self.buffer)
            self.buffer = b""
        data = b"".join(parts)
        if len(data) < length:
            raise ValueError("the archive ends inside a record")
        self.buffer = data[length:]
        return data[:length]

    def skip(self, length: int) -> None:
        if self.gz and self.next is not None:
            self.file.seek(self.next)
            self.buffer, self.inflate = b"", None
            return
        if not self.gz and length > len(self.buffer):
            self.file.seek(length - len(self.buffer), 1)
            self.buffer = b""
            return
        while length > len(self.buffer):
            length -= len(self.buffer)
            self.buffer = b""
            if not self.fill():
                raise ValueError("the archive ends inside a record")
        self.buffer = self.buffer[length:]


def rows(file, wanted: dict[str, set], payload: bool) -> Iterator[tuple]:
    """Tuples in the order of SCHEMA. wanted: values of header columns."""
    source = Source(file)
    while (head := source.header()) is not None:
        length = int(head.get("content-length", 0))
        found = {c: head.get(h.lower()) for c, h in HEADERS.items()}
        found |= {c: None if found[c] is None else int(found[c]) for c in LONGS}
        if found["payload_digest"]:
            found["payload_digest"] = found["payload_digest"].rpartition(":")[2]
        if any(found[c] not in v for c, v in wanted.items()):
            source.skip(length)
            continue
        body = None
        if payload and found["record_type"] != "revisit":
            body = source.block(length)
            if head.get("content-type", "").startswith("application/http"):
                body = body.partition(b"\r\n\r\n")[2]
            own = digest(body)
            if found["payload_digest"] not in (None, own):
                raise ValueError(f"payload of {found['record_id']} doesn't match its digest")
            found |= {"payload_digest": own, "payload_bytes": len(body)}
        else:
            source.skip(length)
        yield (*found.values(), body)


# ---------------------------------------------------------------- data source
class Archive(InputPartition):
    def __init__(self, uri: str) -> None:
        self.uri = uri


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.payload, self.wanted = options["path"], options.get("payload", "true") == "true", {}
        self.declared = {c: set(v) for c, v in json.loads(options.get("where", "{}")).items()}

    def pushFilters(self, filters):
        # Spark keeps what a scan pushed down for all later scans of the same relation, even those without a filter, so
        # only what the relation was opened for is taken; any other predicate is left to Spark, which filters rows.
        for f in filters:
            column = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if column in HEADERS and isinstance(f, (EqualTo, EqualNullSafe, In)):
                values = set(f.value if isinstance(f, In) else [f.value])
                if values == self.declared.get(column):
                    self.wanted[column] = values
                    continue
            yield f

    def partitions(self):
        where, path = fs.FileSystem.from_uri(self.path)
        manifest = f"{path}/_manifest.json"
        if where.get_file_info(manifest).type == fs.FileType.File:
            names = json.loads(where.open_input_stream(manifest).read())
        else:
            found = where.get_file_info(fs.FileSelector(path))
            names = sorted(f.base_name for f in found if f.base_name.endswith((".warc", ".warc.gz")))
        return [Archive(f"{self.path}/{n}") for n in names] or [Archive("")]

    def read(self, partition):
        if not partition.uri:
            return
        schema = pa.schema([(c, pa.int64() if c in LONGS else pa.string()) for c in HEADERS] + [("payload", pa.binary())])
        where, path = fs.FileSystem.from_uri(partition.uri)
        with where.open_input_file(path) as file:
            held, size = [], 0
            for row in rows(file, self.wanted, self.payload):
                held.append(row)
                size += 200 + len(row[-1] or b"")
                if size > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held), schema)], schema=schema)
                    held, size = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held), schema)], schema=schema)


class Written(WriterCommitMessage):
    def __init__(self, names: list[str]) -> None:
        self.names = names


class WarcWriter(DataSourceArrowWriter):
    """Takes (key long, target_uri string, record_type string, refers_to_key long, payload binary)."""

    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.roll = options["path"], int(options.get("roll", ROLL))

    def write(self, iterator):
        where, path = fs.FileSystem.from_uri(self.path)
        where.create_dir(path, recursive=True)
        # each attempt writes names of its own; only those of committed tasks get into the manifest
        names, out = [], None
        for batch in iterator:
            for row in batch.to_pylist():
                if out is None:
                    names.append(f"{uuid.uuid4().hex}.warc.gz")
                    out = where.open_output_stream(f"{path}/{names[-1]}", compression=None)
                    out.write(member(record({"WARC-Type": "warcinfo", "WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>", "Content-Type": "application/warc-fields"}, b"format: WARC File Format 1.1\r\n")))
                out.write(member(self.one(row)))
                if out.tell() > self.roll:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        return Written(names)

    @staticmethod
    def one(row: dict) -> bytes:
        payload, revisit = row["payload"] or b"", row["record_type"] == "revisit"
        http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
        headers = {
            "WARC-Type": row["record_type"], "WARC-Record-ID": f"<urn:row:{row['key']}>", "WARC-Date": "1970-01-01T00:00:00Z", "WARC-Target-URI": row["target_uri"],
            "WARC-Payload-Digest": f"sha1:{digest(payload)}", "X-Row-Key": row["key"], "X-Payload-Length": len(payload), "Content-Type": "application/http; msgtype=response",
        }
        if revisit:
            headers |= {"WARC-Profile": REVISIT, "WARC-Refers-To": f"<urn:row:{row['refers_to_key']}>", "X-Refers-To-Row-Key": row["refers_to_key"]}
        return record(headers, http if revisit else http + payload)

    def commit(self, messages):
        where, path = fs.FileSystem.from_uri(self.path)
        where.create_dir(path, recursive=True)
        with where.open_output_stream(f"{path}/_manifest.json") as f:
            f.write(json.dumps(sorted(n for m in messages if m for n in m.names)).encode())

    def abort(self, messages):
        where, path = fs.FileSystem.from_uri(self.path)
        for m in messages:
            for n in m.names if m else []:
                where.delete_file(f"{path}/{n}")


class WarcDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite):
        return WarcWriter(dict(self.options))


def read_warc(spark: SparkSession, path: str, payload: bool = True, where: dict[str, list] | None = None) -> DataFrame:
    """Records of the archives in a folder; ``where`` gives the wanted values of header columns and is pushed down.
    Without ``payload`` no block is decoded."""
    where = where or {}
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)
    found = spark.read.format("warc").option("payload", str(payload).lower()).option("where", json.dumps(where)).load(path)
    for column, values in where.items():
        found = found.filter(F.col(column) == values[0] if len(values) == 1 else F.col(column).isin(values))
    return found


def write_warc(df: DataFrame, path: str) -> None:
    """``df``: key, target_uri, record_type, refers_to_key, payload; to a new folder."""
    df.sparkSession.dataSource.register(WarcDataSource)
    df.select("key", "target_uri", "record_type", "refers_to_key", "payload").write.format("warc").mode("append").save(path)


def revisits(pages: DataFrame, least_bytes: int = 0, id_col: str = "page_id", uri_col: str = "url", html_col: str = "html") -> DataFrame:
    """(key, target_uri, record_type, refers_to_key, payload): of rows with equal payloads of at least
    ``least_bytes`` bytes the one with the smallest id is a response and the others revisit it.

    Null html is the empty payload. A null id is never the smallest unless the group has no other; rows that
    repeat the smallest id are responses too.
    """
    payload = F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8")
    all_rows = pages.select(F.col(id_col).alias("key"), F.col(uri_col).alias("target_uri"), payload.alias("payload")).withColumn("_same", F.unhex(F.sha2("payload", 256)))
    counted = table(all_rows.groupBy("_same").agg(F.min("key").alias("_first"), F.count(F.lit(1)).alias("_n")))
    total = counted.agg(F.sum("_n")).first()[0] or 0
    # Most payloads occur once and stay where they are. Those in over 1/HEAVY_KEYS of the rows are at most so many; the
    # others are sent out if Spark finds them under its broadcast threshold, and else joined by a shuffle.
    repeated, least = counted.filter("_n > 1"), max(64, total // HEAVY_KEYS)
    heavy, light = repeated.filter(F.col("_n") >= least).drop("_n"), repeated.filter(F.col("_n") < least).drop("_n")
    rest = all_rows.join(F.broadcast(heavy.select("_same")), "_same", "left_anti").join(light.withColumn("_again", F.lit(True)), "_same", "left")
    joined = all_rows.join(F.broadcast(heavy), "_same").withColumn("_again", F.lit(True)).unionByName(rest)
    response = F.col("_again").isNull() | F.col("key").eqNullSafe(F.col("_first")) | (F.octet_length("payload") < least_bytes)
    return joined.select(
        "key", "target_uri", F.when(response, "response").otherwise("revisit").alias("record_type"),
        F.when(~response, F.col("_first")).alias("refers_to_key"), "payload",
    )


def archive(pages: DataFrame, least_bytes: int = 0, id_col: str = "page_id", uri_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes ``pages`` to archives in the shared folder and reads them back: id, payload_bytes, payload_digest,
    record_type, refers_to. Responses are read with their payload, which is measured and digested anew; of
    revisits only headers are read. Null ids and null URLs are written as none; repeated rows are records each (see
    ``revisits``). An empty table gives an empty result. Other columns are not read."""
    spark = pages.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    write_warc(revisits(pages, least_bytes, id_col, uri_col, html_col), path)
    found = read_warc(spark, path, where={"record_type": ["response"]}).unionByName(read_warc(spark, path, payload=False, where={"record_type": ["revisit"]}))
    return found.select(F.col("key").alias(id_col), "payload_bytes", "payload_digest", "record_type", F.col("refers_to_key").alias("refers_to"))
