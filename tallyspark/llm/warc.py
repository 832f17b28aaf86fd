"""WARC archives of pages, and a two-level index of their captures.

Each page is one record: a response with its payload, or a revisit that refers to the response with the same payload.
Every record is a gzip member of its own, so that it can be read by offset and length alone. Archives are written and
read by Spark, so they may lie in any store.

The capture index sorts the captures by URL with the host reversed (com,example)/path, packs neighbouring lines into
compressed blocks, and keeps a directory with the first key of each block. A lookup searches the directory, then the
one or few blocks, and reads the byte ranges it finds.

Defined cases: a null html is an empty payload, a null url is written as an empty target. Of equal payloads of at
least ``least`` bytes the record with the smallest page_id that is not null is the response; rows that tie on it are
all responses, as are all rows of a group that has null ids only. Repeated rows give a record each. Other columns are
not written.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm.shared import settled
from tallyspark.session import work_dir

LINE_END = "\r\n"
#: A gzip member ends with the length of its content, most significant byte last: 0 below this size.
_MEMBER = (1 << 24) - 1
_STEP = 1 << 14
_DATE = "1970-01-01T00:00:00Z"
_SPLIT = re.compile(rb"\r\n\r\n")


@dataclass(frozen=True)
class Settings:
    """``least`` bytes of a payload for a revisit; an archive file has at most ``archive_records``; ``block``
    lines make a block of the index, ``level`` is that of the compression."""

    least: int = 100
    archive_records: int = 20_000
    block: int = 1000
    level: int = 3


def _member(data: bytes, level: int) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _head(page_id: int | None, url: str, digest: str, size: int, refers_to: int | None, length: int) -> bytes:
    target = url.replace("\r", "%0D").replace("\n", "%0A")
    name = "null" if page_id is None else page_id
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{name}>",
             f"WARC-Date: {_DATE}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha256:{digest}", f"Payload-Length: {size}"]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {length}"]
    return LINE_END.join([*lines, "", ""]).encode()


def _members(level: int):
    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part, out = batch.slice(first, 256), []
                for page_id, url, html, digest, refers_to in zip(*(part.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "refers_to"))):
                    payload = (html or "").encode()
                    body = b"" if refers_to is not None else payload
                    record = _head(page_id, url or "", digest, len(payload), refers_to, len(body)) + body + b"\r\n\r\n"
                    # a record above the member size is several members
                    whole = b"".join(_member(record[at : at + _MEMBER], level) for at in range(0, len(record), _MEMBER))
                    out.append(whole[:-1])  # the last byte, a zero, is the line separator of the writer
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["member"])

    return members


def write(pages: DataFrame, folder: str, settings: Settings = Settings()) -> None:
    """Write the archives (``part-*.txt``, whose content is that of a .warc.gz) under ``folder``."""
    payload = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", "html", F.sha2(payload.cast("binary"), 256).alias("digest"), F.octet_length(payload).alias("size"))
    first = (
        rows.where(F.col("size") >= settings.least).groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count("*").alias("copies")).where("copies > 1").select("digest", "first")
    )
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to")
    records = rows.join(first, "digest", "left").select("page_id", "url", "html", "digest", refers)
    (
        records.mapInArrow(_members(settings.level), "member binary")
        .select(F.col("member").cast("string").alias("value"))
        .write.option("lineSep", "\0").option("maxRecordsPerFile", settings.archive_records).text(folder)
    )


def records_in(content: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """Offset, length, header and payload of each record of an archive."""
    at = 0
    view = memoryview(content)
    while at < len(content):
        begin, data = at, b""
        while True:
            unpacker = zlib.decompressobj(31)
            while not unpacker.eof:
                step = view[at : at + _STEP]
                if not step:
                    raise ValueError("the archive ends inside a record")
                data += unpacker.decompress(step)
                at += len(step)
            at -= len(unpacker.unused_data)
            head = _SPLIT.search(data)
            if head:
                fields = dict(line.split(": ", 1) for line in data[: head.start()].decode().split(LINE_END)[1:] if ": " in line)
                fields.setdefault("WARC-Target-URI", "")
                size = int(fields["Content-Length"])
                if len(data) >= head.end() + size + 4:
                    break
        yield begin, at - begin, fields, data[head.end() : head.end() + size]


_CAPTURES = (
    "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, "
    "file string, offset long, length long"
)


def captures(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each record of the archives, read back. A response's payload is digested anew and compared with its
    header; an archive that does not agree fails the job."""
    import hashlib

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _CAPTURES.split(", ")]
        types = [pa.int64() if x.split()[1] == "long" else pa.string() for x in _CAPTURES.split(", ")]
        for batch in batches:
            for k in range(batch.num_rows):
                path, content = batch.column("path")[k].as_py(), batch.column("content")[k].as_py()
                rows = []
                for offset, length, fields, payload in records_in(content):
                    number = fields["WARC-Record-ID"][10:-1]
                    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
                    to = fields.get("WARC-Refers-To")
                    if to is None and hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError(f"{path} at {offset}: the payload does not agree with its digest")
                    rows.append((None if number == "null" else int(number), fields["WARC-Target-URI"], int(fields["Payload-Length"]), digest,
                                 fields["WARC-Type"], int(to[10:-1]) if to else None, path, offset, length))
                    if len(rows) == 4096:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder)
    return files.select("path", "content").mapInArrow(read, _CAPTURES)


def url_key(url: str) -> str:
    """The URL with its host reversed, so that captures of a site and its parts are neighbours."""
    try:
        parts = urlsplit(url)
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return url
    path = parts.path + (f"?{parts.query}" if parts.query else "")
    return ",".join(reversed(host.split("."))) + (f":{port}" if port else "") + ")" + (path or "/")


_FIELDS = ["url", "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "file", "offset", "length"]


def _escape(value: object) -> str:
    return "-" if value is None else "%2D" if value == "-" else str(value).replace("%", "%25").replace(" ", "%20").replace("\n", "%0A").replace("\t", "%09")


def _blocks(size: int, level: int):
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[str] = []
        lines: list[str] = []

        def block() -> pa.RecordBatch:
            packed = zlib.compress("\n".join(lines).encode("utf-8", "surrogatepass"), level)
            out = pa.RecordBatch.from_arrays(
                [pa.array([keys[0]]), pa.array([keys[-1]]), pa.array([len(lines)], pa.int32()), pa.array([packed], pa.binary())],
                ["first_key", "last_key", "lines", "block"],
            )
            keys.clear()
            lines.clear()
            return out

        for batch in batches:
            for key, *values in zip(*(batch.column(c).to_pylist() for c in ["url_key", *_FIELDS])):
                keys.append(key)
                lines.append("\t".join(_escape(v) for v in (key, *values)))
                if len(lines) == size:
                    yield block()
        if lines:
            yield block()

    return blocks


def index(found: DataFrame, folder: str, settings: Settings = Settings()) -> None:
    """Write the blocks of the index under ``folder``, sorted by key, and next to them the sparse directory (without the
    blocks). Equal keys may span blocks and parts; ties are ordered by page_id, so hot URLs are dealt over several parts."""

    @F.arrow_udf("string")
    def keyed(urls: pa.Array) -> pa.Array:
        return pa.array([url_key(u or "") for u in urls.to_pylist()], pa.string())

    order = ["url_key", "page_id", "file", "offset"]
    blocks = (
        settled(found.withColumn("url_key", keyed("url"))).repartitionByRange(*order).sortWithinPartitions(*order)
        .mapInArrow(_blocks(settings.block, settings.level), "first_key string, last_key string, lines int, block binary")
    )
    blocks.withColumn("block_id", F.monotonically_increasing_id()).write.parquet(f"{folder}/blocks")
    written = found.sparkSession.read.parquet(f"{folder}/blocks")
    written.select("first_key", "last_key", "lines", "block_id").write.parquet(f"{folder}/directory")


def _lines(block: bytes) -> list[list[str]]:
    return [line.split("\t") for line in zlib.decompress(block).decode("utf-8", "surrogatepass").split("\n")]


def _value(text: str) -> str | None:
    return None if text == "-" else text.replace("%09", "\t").replace("%0A", "\n").replace("%20", " ").replace("%2D", "-").replace("%25", "%")


def entries(spark: SparkSession, folder: str) -> DataFrame:
    """All captures, out of the compressed blocks of the index."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = {"page_id", "payload_bytes", "refers_to", "offset", "length"}
        for batch in batches:
            for block in batch.column("block").to_pylist():
                columns = list(zip(*_lines(block)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([_value(x) for x in column], pa.string()).cast(pa.int64() if name in numbers else pa.string())
                     for name, column in zip(["url_key", *_FIELDS], columns)],
                    ["url_key", *_FIELDS],
                )

    schema = "url_key string, url string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, file string, offset long, length long"
    return spark.read.parquet(f"{folder}/blocks").select("block").mapInArrow(unpack, schema)


def lookup(spark: SparkSession, folder: str, urls: DataFrame) -> DataFrame:
    """The captures of each distinct URL of ``urls``: the directory tells the blocks whose keys may enclose it, and a
    binary search finds its lines inside them.

    The directory is searched by ranges: a sample of its first keys (``spark.sql.shuffle.partitions`` of them) cuts the
    keys into ranges, and wanted keys meet only the directory lines of their range.
    """

    @F.arrow_udf("string")
    def keyed(values: pa.Array) -> pa.Array:
        return pa.array([url_key(u or "") for u in values.to_pylist()], pa.string())

    wanted = urls.select(F.coalesce("url", F.lit("")).alias("wanted")).distinct().withColumn("key", keyed("wanted"))
    directory = spark.read.parquet(f"{folder}/directory")
    cuts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = sorted({r[0] for r in directory.select("first_key").orderBy(F.xxhash64("first_key")).limit(cuts).collect()})

    @F.arrow_udf("int")
    def place(keys: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(np.array(bounds, object), np.array(keys.to_pylist(), object), side="right").astype(np.int32))

    ranges = F.sequence(place("first_key"), place("last_key"))
    met = (
        directory.withColumn("range", F.explode(ranges))
        .join(wanted.withColumn("range", place("key")), "range")
        .where((F.col("key") >= F.col("first_key")) & (F.col("key") <= F.col("last_key")))
        .groupBy("block_id").agg(F.collect_set(F.struct("key", "wanted")).alias("asked"))
    )
    blocks = spark.read.parquet(f"{folder}/blocks").select("block_id", "block")

    @F.arrow_udf("array<struct<url:string,page_id:long,file:string,offset:long,length:long>>")
    def search(packed: pa.Array, asked: pa.Array) -> pa.Array:
        out = []
        for block, wants in zip(packed.to_pylist(), asked.to_pylist()):
            lines = _lines(block)
            keys = [_value(x[0]) for x in lines]
            hits = []
            for want in wants:
                low, high = np.searchsorted(keys, want["key"], "left"), np.searchsorted(keys, want["key"], "right")
                for line in lines[low:high]:
                    url, page_id, *_, file, offset, length = (_value(x) for x in line[1:])
                    if url == want["wanted"]:
                        hits.append({"url": url, "page_id": None if page_id is None else int(page_id), "file": file, "offset": int(offset), "length": int(length)})
            out.append(hits)
        return pa.array(out, pa.list_(pa.struct([("url", pa.string()), ("page_id", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])))

    return blocks.join(met, "block_id").select(F.explode(search("block", "asked")).alias("c")).select("c.*")


def read_record(spark: SparkSession, file: str, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """Header and payload of one record, from its byte range alone, through the store's own client."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(file)
    stream = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(path)
    try:
        stream.seek(offset)
        content = bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(jvm.org.apache.commons.io.input.BoundedInputStream(stream, length)))
    finally:
        stream.close()
    _, _, fields, payload = next(records_in(content))
    return fields, payload


def archive(pages: DataFrame, settings: Settings = Settings()) -> tuple[str, DataFrame]:
    """Write archives and index into a new shared folder; its path, and all captures read back through the index."""
    spark = pages.sparkSession
    folder = work_dir(spark, "warc")
    write(pages, f"{folder}/archives", settings)
    index(captures(spark, f"{folder}/archives"), f"{folder}/index", settings)
    return folder, entries(spark, f"{folder}/index")
