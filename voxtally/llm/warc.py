"""WARC archives as a Spark data source: ``spark.read.format("warc")`` and ``df.write.format("warc")``.

Reading plans partitions of whole files. The header of a record is parsed first; pushed predicates on the record type and other header fields
decide whether its block is looked at, and a read without the column ``payload`` looks at none. A block that isn't wanted is skipped without decoding: by
seeking in plain files, and in compressed ones by the length that the writer leaves in each gzip member (files of other writers are inflated and passed over).

Writing gives one file a task, one gzip member a record. Files count once the manifest names them, which is written after all tasks
have ended: what a lost or repeated task has left is never read.

Load once for each query (``records`` does): Spark 4.1 keeps the predicates that a query has pushed with the loaded frame, and a later query on the same
frame that pushes none, or a union of two filters on it, would read under them.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull,
    LessThan, LessThanOrEqual, Not, StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage)
from pyspark.sql.types import StructType

from voxtally.llm.tables import drop, reachable, store
from voxtally.session import new_folder

#: What a read returns; ``.schema`` may name fewer of these, and without ``payload`` no block is decoded.
SCHEMA = "file string, place long, record_id string, record_type string, target_uri string, date string, content_type string, payload_digest string, payload_length long, refers_to string, headers map<string,string>, payload binary"
#: Bytes of files that make up a partition, by default.
PARTITION_BYTES = 32 << 20
#: Records with shorter payloads are never stored as revisits.
LEAST = 1000
#: Records and payload bytes of a batch that a read passes on.
BATCH_RECORDS, BATCH_BYTES = 1_000, 8 << 20
MANIFEST = "_manifest.json"
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_FIELDS = {"record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "date": "warc-date", "content_type": "content-type", "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to"}
_PUSHED = (*_FIELDS, "file", "place")
_FAILED = "malformed record at {} of {}"


# --- one record -----------------------------------------------------------------------------------------------------------------


def _clean(value: str) -> str:
    """White space and control characters, which would end a header line, in percent form."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def _head(fields: list[tuple[str, str | None]]) -> bytes:
    return "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None).encode()


def record_bytes(record: dict) -> bytes:
    """One record as it stands in an archive. ``payload`` is the full one; a revisit keeps its HTTP header, length and digest only."""
    payload = record["payload"] or b""
    kind = record["record_type"]
    http = b"HTTP/1.1 200 OK\r\n" + _head([("Content-Type", record.get("content_type")), ("Content-Length", str(len(payload)))]) + b"\r\n"
    is_http = kind in ("response", "revisit")
    block = http + (payload if kind == "response" else b"") if is_http else payload
    refers = record.get("refers_to")
    head = _head([
        ("WARC-Type", kind), ("WARC-Record-ID", f"<{_clean(record['record_id'])}>"), ("WARC-Date", record.get("date") or DATE),
        ("WARC-Target-URI", None if record.get("target_uri") is None else _clean(record["target_uri"])),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()),
        ("WARC-Profile", PROFILE if kind == "revisit" else None), ("WARC-Refers-To", None if refers is None else f"<{_clean(refers)}>"),
        ("Content-Type", "application/http;msgtype=response" if is_http else record.get("content_type")), ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 1) -> bytes:
    """A gzip member whose extra field ``sl`` tells its own length and that of the data, so that a reader can pass over it."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    extra = b"sl" + struct.pack("<HII", 8, 12 + 12 + len(body) + 8, len(data))
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(data), len(data))


def parse_head(head: bytes) -> dict[str, str]:
    """The fields of a header by their lower-case names; a line that begins with a blank goes on with the one before."""
    lines = re.sub(rb"\r?\n[ \t]+", b" ", head).decode("utf-8", "replace").splitlines()[1:]
    return {k.strip().lower(): v.strip() for k, found, v in (line.partition(":") for line in lines) if found}


def digest_hex(value: str | None) -> str | None:
    """The bare lower-case hex of a labelled digest, which may be in base 32."""
    if value is None:
        return None
    bare = value.rpartition(":")[2]
    if re.fullmatch("[A-Za-z2-7]{32}", bare):
        return base64.b32decode(bare.upper()).hex()
    return bare.lower()


def columns_of(fields: dict[str, str], file: str, place: int) -> dict:
    """The columns that the header alone gives."""
    row = {c: fields.get(name) for c, name in _FIELDS.items()}
    for c in ("record_id", "refers_to", "target_uri"):
        row[c] = row[c][1:-1] if row[c] and row[c][0] == "<" and row[c][-1] == ">" else row[c]
    return row | {"payload_digest": digest_hex(row["payload_digest"]), "file": file, "place": place, "headers": fields}


def add_block(row: dict, block: bytes) -> dict:
    """``payload`` and ``payload_length`` from a record's block: of an HTTP message the body, else all of it. A revisit has no payload, but the
    length that its HTTP header tells."""
    if not (row["content_type"] or "").lower().startswith("application/http"):
        return row | {"payload": block, "payload_length": len(block)}
    head, _, body = block.partition(b"\r\n\r\n")
    if row["record_type"] != "revisit":
        return row | {"payload": body, "payload_length": len(body)}
    told = parse_head(head).get("content-length", "")
    return row | {"payload": None, "payload_length": int(told) if told.isascii() and told.isdigit() else None}


# --- one file -------------------------------------------------------------------------------------------------------------------


def _from_members(f, file: str, wanted, blocks: bool) -> Iterator[dict]:
    """Records of members that tell their length. Ends before the first that does not, with the file placed there."""
    while True:
        start = f.tell()
        head = f.read(24)
        if len(head) < 24 or head[:4] != b"\x1f\x8b\x08\x04" or head[10:16] != b"\x0c\0sl\x08\0":
            f.seek(start)
            return
        size, full = struct.unpack("<II", head[16:24])
        inflate, left, data = zlib.decompressobj(-15), size - 24 - 8, b""
        while (end := data.find(b"\r\n\r\n")) < 0:
            piece = f.read(min(left, 2_048))
            if not piece:
                raise ValueError(_FAILED.format(start, file))
            left -= len(piece)
            data += inflate.decompress(piece)
        row = columns_of(parse_head(data[:end]), file, start)
        if wanted(row):
            if blocks:
                data += inflate.decompress(f.read(left)) + inflate.flush()
                if struct.unpack("<II", f.read(8)) != (zlib.crc32(data), full & 0xFFFFFFFF):
                    raise ValueError(_FAILED.format(start, file))
                row = add_block(row, data[end + 4: end + 4 + int(row["headers"]["content-length"])])
            yield row
        f.seek(start + size)


def _from_stream(f, file: str, wanted, blocks: bool) -> Iterator[dict]:
    """Records of a plain file, where unwanted blocks are seeked over, or of an inflated stream."""
    while True:
        start = f.tell()
        line = f.readline()
        if not line:
            return
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(_FAILED.format(start, file))
        head = [line]
        while (line := f.readline()).strip():
            head.append(line)
        row = columns_of(parse_head(b"".join(head)), file, start)
        length = int(row["headers"].get("content-length", "-1"))
        if length < 0:
            raise ValueError(_FAILED.format(start, file))
        if wanted(row) and blocks:
            block = f.read(length)
            if len(block) < length:
                raise ValueError(_FAILED.format(start, file))
            yield add_block(row, block)
        else:
            f.seek(length, 1)
            if wanted(row):
                yield row


def file_records(f, file: str, wanted=lambda row: True, blocks: bool = True) -> Iterator[dict]:
    """The records of an open archive, plain or compressed by record or as a whole, for whose header columns ``wanted`` holds."""
    magic = f.read(2)
    f.seek(0)
    if magic != b"\x1f\x8b":
        yield from _from_stream(f, file, wanted, blocks)
        return
    yield from _from_members(f, file, wanted, blocks)
    if f.read(1):
        f.seek(-1, 1)
        yield from _from_stream(gzip.GzipFile(fileobj=f), file, wanted, blocks)


# --- the data source ------------------------------------------------------------------------------------------------------------


def holds(condition: Filter, row: dict) -> bool | None:
    """A pushed predicate on header columns, with SQL's treatment of nulls."""
    if isinstance(condition, Not):
        inner = holds(condition.child, row)
        return None if inner is None else not inner
    value = row[condition.attribute[0]]
    if isinstance(condition, IsNull):
        return value is None
    if isinstance(condition, IsNotNull):
        return value is not None
    if isinstance(condition, EqualNullSafe):
        return value == condition.value
    if value is None:
        return None
    match condition:
        case In():
            return True if value in condition.value else None if None in condition.value else False
        case EqualTo():
            return value == condition.value
        case GreaterThan():
            return value > condition.value
        case GreaterThanOrEqual():
            return value >= condition.value
        case LessThan():
            return value < condition.value
        case LessThanOrEqual():
            return value <= condition.value
        case StringStartsWith():
            return value.startswith(condition.value)
        case StringEndsWith():
            return value.endswith(condition.value)
        case StringContains():
            return condition.value in value
    raise TypeError(type(condition))


_KNOWN = (EqualNullSafe, EqualTo, GreaterThan, GreaterThanOrEqual, In, IsNotNull, IsNull, LessThan, LessThanOrEqual, StringContains, StringEndsWith, StringStartsWith)


def can_push(condition: Filter) -> bool:
    if isinstance(condition, Not):
        return can_push(condition.child)
    return isinstance(condition, _KNOWN) and len(condition.attribute) == 1 and condition.attribute[0] in _PUSHED


def _place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub("^file:/(?!/)", "file:///", path))


def archive_files(path: str) -> list[tuple[str, int]]:
    """(name, bytes) of the archives of a folder: those in its manifest, or, without one, all with a usual name; of a file: itself."""
    system, folder = _place(path)
    told = system.get_file_info(folder)
    if told.type == fs.FileType.File:
        return [(folder, told.size)]
    if told.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    manifest = f"{folder}/{MANIFEST}"
    if system.get_file_info(manifest).type == fs.FileType.File:
        with system.open_input_stream(manifest) as f:
            return [(f"{folder}/{x['file']}", x["bytes"]) for x in json.loads(f.read())]
    every = system.get_file_info(fs.FileSelector(folder, recursive=True))
    return sorted((x.path, x.size) for x in every if x.type == fs.FileType.File and re.search(r"\.warc(\.gz)?$", x.path) and not re.search(r"(^|/)[_.][^/]*$", x.path))


@dataclass
class Files(InputPartition):
    names: list[str]


class WarcReader(DataSourceReader):
    def __init__(self, options, schema: StructType):
        self.path, self.columns = options["path"], schema.names
        self.size = int(options.get("partition_bytes", PARTITION_BYTES))
        self.conditions: list[Filter] = []
        unknown = set(self.columns) - {x.split()[0] for x in SCHEMA.split(", ")}
        if unknown:
            raise ValueError(f"no such columns in an archive: {sorted(unknown)}")

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for condition in filters:
            if can_push(condition):
                self.conditions.append(condition)
            else:
                yield condition

    def partitions(self) -> list[Files]:
        groups, total = [[]], 0
        for name, size in archive_files(self.path):
            if groups[-1] and total + size > self.size:
                groups.append([])
                total = 0
            groups[-1].append(name)
            total += size
        return [Files(names) for names in groups]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system, _ = _place(self.path)
        blocks = bool({"payload", "payload_length"} & set(self.columns))
        kinds = [(c, _ARROW[c]) for c in self.columns]
        rows: list[dict] = []
        held = 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([list(r[c].items()) if c == "headers" else r.get(c) for r in rows], t) for c, t in kinds], [c for c, _ in kinds])

        for name in partition.names:
            with system.open_input_file(name) as raw:
                for row in file_records(io.BufferedReader(raw, 1 << 16), name, lambda row: all(holds(x, row) for x in self.conditions), blocks):
                    rows.append(row)
                    held += len(row.get("payload") or b"")
                    if len(rows) >= BATCH_RECORDS or held >= BATCH_BYTES:
                        yield batch()
                        rows.clear()
                        held = 0
        if rows:
            yield batch()


_ARROW = {c: {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}.get(t, pa.map_(pa.string(), pa.string())) for c, t in (x.split(" ", 1) for x in SCHEMA.split(", "))}


@dataclass
class Written(WriterCommitMessage):
    file: str
    records: int
    bytes: int


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, folder = _place(self.path)
        system.create_dir(folder, recursive=True)
        name = f"part-{uuid.uuid4().hex}.warc.gz"
        records = size = 0
        info = {"record_id": f"urn:uuid:{uuid.uuid4()}", "record_type": "warcinfo", "content_type": "application/warc-fields", "payload": b"format: WARC File Format 1.1\r\n"}
        with system.open_output_stream(f"{folder}/{name}", compression=None) as out:
            size += out.write(member(record_bytes(info)))
            for batch in iterator:
                for record in batch.to_pylist():
                    size += out.write(member(record_bytes(record)))
                    records += 1
        return Written(name, records, size)

    def commit(self, messages: list[Written | None]) -> None:
        system, folder = _place(self.path)
        system.create_dir(folder, recursive=True)
        manifest = f"{folder}/{MANIFEST}"
        before = [] if self.overwrite or system.get_file_info(manifest).type != fs.FileType.File else json.loads(system.open_input_stream(manifest).read())
        now = [{"file": m.file, "records": m.records, "bytes": m.bytes} for m in messages if m]
        draft = f"{folder}/_draft-{uuid.uuid4().hex}"
        with system.open_output_stream(draft) as out:
            out.write(json.dumps(before + now).encode())
        system.move(draft, manifest)

    def abort(self, messages: list[Written | None]) -> None:
        system, folder = _place(self.path)
        for m in messages:
            if m:
                system.delete_file(f"{folder}/{m.file}")


class WarcSource(DataSource):
    """Options: ``path``; reading also ``partition_bytes``. Writing takes the columns ``record_id, record_type, target_uri, date, content_type, refers_to, payload``
    (any but the first two may be absent or null) in mode append or overwrite."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(self.options, schema)

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options, overwrite)


def register(spark: SparkSession) -> SparkSession:
    """Make ``format("warc")`` known to the session, with filters pushed down."""
    reachable(spark).dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark


def records(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """The records of an archive, freshly loaded, with all columns or the named ones; without ``payload`` and ``payload_length`` no block is decoded.

    Records without a field have null there, a revisit has no payload; an archive without records gives no rows; records that repeat are repeated rows.
    A damaged record is an error.
    """
    reader = register(spark).read.format("warc")
    if columns is not None:
        reader = reader.schema(", ".join(x for x in SCHEMA.split(", ") if x.split()[0] in columns))
    return reader.load(path)


# --- archives of pages ----------------------------------------------------------------------------------------------------------


def revisits(payloads: DataFrame, least: int = LEAST) -> DataFrame:
    """``row, digest, kept_id, kept_row`` of the rows whose payload of at least ``least`` bytes another row holds as well, without the row that is kept.

    Kept is the row with the largest ``id`` (nulls are smaller than any; of equal ids the largest ``row``). ``payloads`` is ``row, id, digest, bytes``. A digest with very many
    rows is reduced before the shuffle, and the join that follows is one that adaptive execution can split.
    """
    long = payloads.where(F.col("bytes") >= least)
    best = F.max(F.struct(F.col("id").isNotNull().alias("known"), "id", "row")).alias("best")
    groups = store(long.groupBy("digest", "bytes").agg(best, F.count(F.lit(1)).alias("n")).where("n > 1"), "equal-payloads")
    return long.join(groups, ["digest", "bytes"]).where(F.col("row") != F.col("best.row")).select("row", "digest", F.col("best.id").alias("kept_id"), F.col("best.row").alias("kept_row"))


def _urn(number: str, row: str) -> Column:
    return F.concat(F.lit("urn:page:"), F.coalesce(F.col(number).cast("string"), F.lit("")), F.lit(":"), F.col(row).cast("string"))


def archive(pages: DataFrame, path: str, least: int = LEAST) -> None:
    """Write a record for each row of ``page_id, url, html`` to the folder ``path``; payload is the html in UTF-8.

    Of equal payloads of at least ``least`` bytes that with the largest page_id is a ``response``, the others are ``revisit`` records that refer to it; smaller ones are all responses.
    A null html is an empty payload; a null url gives no target; white space in a url is written in percent form; null ids stay null; repeated rows are records of
    their own, one of which is the response; an empty table gives an empty archive; other columns are ignored.
    The pages are staged once, so that both passes see the same rows; the payloads are shuffled only if there are too many revisits for a broadcast.
    """
    register(pages.sparkSession)
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.monotonically_increasing_id().alias("row"), F.col("page_id").cast("long").alias("id"), "url", payload.alias("payload"), F.sha1(payload).alias("digest"))
    rows = store(rows, "pages")
    found = store(revisits(rows.select("row", "id", "digest", F.length("payload").alias("bytes")), least), "revisits")
    joined = rows.join(found.drop("digest"), "row", "left")
    records = joined.select(
        _urn("id", "row").alias("record_id"), F.when(F.col("kept_row").isNull(), "response").otherwise("revisit").alias("record_type"), F.col("url").alias("target_uri"),
        F.lit("text/html; charset=utf-8").alias("content_type"), F.when(F.col("kept_row").isNotNull(), _urn("kept_id", "kept_row")).alias("refers_to"), "payload")
    records.write.format("warc").mode("append").save(path)
    drop(rows)


def page_records(spark: SparkSession, path: str) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to, intact`` of an archive of pages, as read back.

    Length and digest of a response are those of the payload that was read, ``intact`` tells whether its header says the same; those of a
    revisit come from its headers.
    """
    read = records(spark, path).where(F.col("record_type").isin("response", "revisit"))
    here = F.col("record_type") == "response"
    digest = F.when(here, F.sha1("payload")).otherwise(F.col("payload_digest"))
    number = lambda urn: F.split_part(F.col(urn), F.lit(":"), F.lit(3)).try_cast("long")
    return read.select(
        number("record_id").alias("page_id"), F.when(here, F.length("payload").cast("long")).otherwise(F.col("payload_length")).alias("payload_bytes"),
        digest.alias("payload_digest"), "record_type", number("refers_to").alias("refers_to"), digest.eqNullSafe(F.col("payload_digest")).alias("intact"))


def archived(pages: DataFrame) -> DataFrame:
    """The pages written to an archive in the shared folder and read back."""
    path = new_folder(pages.sparkSession, "archive")
    archive(pages, path)
    return page_records(pages.sparkSession, path)
