"""WARC archives: a Python data source and a writer.

Archives are .warc.gz files with one gzip member per record, after ISO 28500. The writer puts the `sl` extra field
into each member's header (its compressed and uncompressed length), and next to each archive an index of split
points. The reader plans byte ranges between split points, takes record-type and header predicates from Spark,
inflates the first bytes of a member until its headers end, and passes over members that the predicates reject
or whose payload nobody asked for, without inflating them. Plain .warc files and members without `sl` can be read
too, each file as one range.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition, IsNotNull
from pyspark.sql.types import StructType

from wardcraft.llm.text import as_batch, table
from wardcraft.plans.files import Window, files_in, writer
from wardcraft.plans.shared import materialise, new_folder, remove

SCHEMA = "record_id string, record_type string, page_id long, url string, payload_digest string, payload_bytes long, refers_to long, payload binary"
#: Columns that are headers, and the header of each.
HEADERS = {"record_id": "WARC-Record-ID", "record_type": "WARC-Type", "page_id": "X-Page-ID", "url": "WARC-Target-URI", "payload_digest": "WARC-Payload-Digest", "payload_bytes": "X-Payload-Length", "refers_to": "X-Refers-To-Page-ID"}
LONGS = ("page_id", "payload_bytes", "refers_to")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LEAST_SHARED, SPLIT, HEAD, PLACES = 100, 8 << 20, 2048, 26
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: the URL namespace of RFC 4122


def _clean(value) -> str:
    """A header value has no line ends or other control characters."""
    return re.sub(r"[\x00-\x1f\x7f]+", " ", str(value)).strip()


def record(kind: str, page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One record, uncompressed. A revisit has the HTTP headers, not the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    urn = lambda p: f"<urn:uuid:{uuid.uuid5(_SPACE, f'page:{p}:{digest}')}>"
    head = {"WARC-Type": kind, "WARC-Record-ID": urn(page_id), "WARC-Date": date, "Content-Type": "application/http;msgtype=response", "WARC-Payload-Digest": f"sha256:{digest}", "X-Payload-Length": len(payload), "Content-Length": len(block)}
    if url is not None:
        head["WARC-Target-URI"] = _clean(url)
    if page_id is not None:
        head["X-Page-ID"] = page_id
    if kind == "revisit":
        head |= {"WARC-Profile": PROFILE, "WARC-Refers-To": urn(refers_to), "X-Refers-To-Page-ID": refers_to}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def member(raw: bytes, level: int = 6) -> bytes:
    """A gzip member with the lengths in an `sl` extra field."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(raw) + deflate.flush()
    size = 10 + 2 + 12 + len(body) + 8
    extra = struct.pack("<2sHII", b"sl", 8, size & 0xFFFFFFFF, len(raw) & 0xFFFFFFFF)
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(raw), len(raw) & 0xFFFFFFFF)


def parse_headers(raw: bytes) -> dict[str, str]:
    """Header names in lower case with their values."""
    lines = raw.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if ":" in x)}


class Record:
    """Headers of a record, and its payload if asked for."""

    def __init__(self, headers: dict[str, str], block):
        self.headers, self._block = headers, block

    def payload(self) -> bytes | None:
        """The payload of a response or another record with one; None for a revisit."""
        if self.headers.get("warc-type") == "revisit":
            return None
        block = self._block()
        return block.partition(b"\r\n\r\n")[2] if self.headers.get("content-type", "").startswith("application/http") else block


def _gzip_records(file: Window, at: int, end: int, stats: dict) -> Iterator[Record]:
    while at < end:
        start = file.read(at, 24)
        size = None
        if start[:4] == b"\x1f\x8b\x08\x04" and start[12:14] == b"sl":
            size = struct.unpack_from("<I", start, 16)[0] or None
        inflate, used, raw = zlib.decompressobj(31), 0, b""
        while b"\r\n\r\n" not in raw:
            more = inflate.unconsumed_tail
            if not more:
                more = file.read(at + used, min(HEAD, file.size - at - used))
                used += len(more)
            got = inflate.decompress(more, HEAD)
            if not got and (inflate.eof or not more):
                raise ValueError(f"a record without headers at {at}")
            raw += got
        head, _, rest = raw.partition(b"\r\n\r\n")
        headers = parse_headers(head)
        state = {"used": used, "done": False}

        def block(inflate=inflate, rest=rest, headers=headers, state=state, at=at, size=size):
            parts = [rest]
            while not inflate.eof:
                more = inflate.unconsumed_tail
                if not more:
                    n = min(1 << 20, file.size - at - state["used"]) if size is None else size - state["used"]
                    more = file.read(at + state["used"], max(0, n))
                    state["used"] += len(more)
                    if not more:
                        raise ValueError("a record is cut off")
                parts.append(inflate.decompress(more))
            state["done"] = True
            stats["inflated"] = stats.get("inflated", 0) + 1
            return b"".join(parts)[: int(headers.get("content-length", 0))]

        yield Record(headers, block)
        if size is None:
            if not state["done"]:
                block()
            at += state["used"] - len(inflate.unused_data)
        else:
            at += size


def _plain_records(file: Window, at: int, end: int, stats: dict) -> Iterator[Record]:
    while at < end:
        n = HEAD
        while b"\r\n\r\n" not in (raw := file.read(at, min(n, file.size - at))):
            if n > file.size - at:
                return
            n *= 2
        head = raw.partition(b"\r\n\r\n")[0]
        headers = parse_headers(head.lstrip(b"\r\n"))
        body, size = at + len(head) + 4, int(headers.get("content-length", 0))
        yield Record(headers, lambda body=body, size=size: file.read(body, size))
        at = body + size + 4


def records(uri: str, start: int = 0, end: int | None = None, stats: dict | None = None) -> Iterator[Record]:
    """The records of a byte range of an archive."""
    file = Window(uri)
    end = file.size if end is None else end
    kind = _gzip_records if file.size and file.read(0, 2) == b"\x1f\x8b" else _plain_records
    yield from kind(file, start, end, stats if stats is not None else {})
    file.close()


class Range(InputPartition):
    def __init__(self, uri: str, start: int, end: int):
        self.uri, self.start, self.end = uri, start, end


class WarcReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.columns, self.path, self.wanted = schema.names, options["path"], []
        self.split = int(options.get("splitbytes", SPLIT))

    def pushFilters(self, filters):
        """Equality and membership on header columns are decided here, before a payload is inflated; the rest goes back to Spark."""
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name in HEADERS and isinstance(f, EqualTo):
                self.wanted.append((name, frozenset([f.value])))
            elif name in HEADERS and isinstance(f, In):
                self.wanted.append((name, frozenset(f.value)))
            elif name in HEADERS and isinstance(f, IsNotNull):
                self.wanted.append((name, None))
            else:
                yield f

    def partitions(self):
        out = []
        for uri, size in [*files_in(self.path, ".warc.gz"), *files_in(self.path, ".warc")]:
            cuts = [0]
            for index, n in files_in(f"{uri}.idx", ".idx"):
                file = Window(index)
                for (at,) in struct.iter_unpack("<Q", file.read(0, n)):
                    if at - cuts[-1] >= self.split:
                        cuts.append(at)
                file.close()
            out += [Range(uri, a, b) for a, b in zip(cuts, [*cuts[1:], size], strict=True) if b > a]
        return out or [Range("", 0, 0)]

    def value(self, headers: dict[str, str], name: str):
        x = headers.get(HEADERS[name].lower())
        if x is None:
            return None
        if name in LONGS:
            return int(x) if re.fullmatch(r"-?\d+", x) else None
        return x.removeprefix("sha256:") if name == "payload_digest" else x

    def read(self, partition):
        if not partition.uri:
            return
        for r in records(partition.uri, partition.start, partition.end):
            if all((x := self.value(r.headers, name)) is not None and (among is None or x in among) for name, among in self.wanted):
                yield tuple(r.payload() if c == "payload" else self.value(r.headers, c) for c in self.columns)


class WarcSource(DataSource):
    """spark.read.format("warc").load(folder or file); a schema with some of the columns reads no others."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        if unknown := set(schema.names) - {*HEADERS, "payload"}:
            raise ValueError(f"no such columns in a WARC record: {sorted(unknown)}")
        return WarcReader(schema, self.options)


def read_warc(spark: SparkSession, path: str, columns: str = SCHEMA) -> DataFrame:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").schema(columns).load(path)


def _marked(held: Broadcast, place: pa.Array) -> pa.Array:
    """Which places have their bit set."""
    k = place.to_numpy(zero_copy_only=False)
    return pa.array(held.value[k >> 6] >> (k & 63).astype(np.uint64) & np.uint64(1) == 1)


def _shared(held: Broadcast):
    """Rows whose digest may be one of several records'."""

    def run(batches):
        for batch in batches:
            yield batch.filter(_marked(held, batch.column("place")))

    return run


def _write(folder: str, date: str, level: int, held: Broadcast | None = None):
    """Rows -> archives. held: rows without a mark are written, as responses, and the others left for later."""

    def run(batches):
        path, out, at, n, cuts = f"{folder}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz", None, 0, 0, []
        for batch in batches:
            if held:
                batch = batch.filter(pc.invert(_marked(held, batch.column("place"))))
            cols = [batch.column(k).to_pylist() for k in ("page_id", "url", "payload", "digest")]
            cols += [["response"] * batch.num_rows, [None] * batch.num_rows] if held else [batch.column(k).to_pylist() for k in ("record_type", "refers_to")]
            for page_id, url, payload, digest, kind, refers_to in zip(*cols, strict=True):
                out = out or writer(path)
                cuts.append(at)
                found = member(record(kind, page_id, url, payload, digest, refers_to, date), level)
                out.write(found)
                at, n = at + len(found), n + 1
        if out:
            out.close()
            with writer(f"{path}.idx") as index:
                index.write(struct.pack(f"<{len(cuts)}Q", *cuts))
            yield as_batch(["path", "records", "bytes"], [pa.string(), pa.int64(), pa.int64()], [[path], [n], [at]])

    return run


def _marks(spark: SparkSession, places: DataFrame) -> Broadcast:
    """A table of 2 ** PLACES bits, with those of `places` set: 8 MB, whatever the number of rows."""
    words = places.groupBy(F.expr("shiftright(place, 6)").alias("k")).agg(F.bit_or(F.expr("shiftleft(1L, cast(place & 63 as int))")).alias("v")).toPandas()
    bits = np.zeros(1 << PLACES - 6, np.uint64)
    bits[words["k"].to_numpy(np.int64)] = words["v"].to_numpy(np.int64).view(np.uint64)
    return spark.sparkContext.broadcast(bits)


def write_warc(spark: SparkSession, pages: DataFrame, folder: str | None = None, date: str = "1970-01-01T00:00:00Z", level: int = 6, least: int = LEAST_SHARED) -> str:
    """Write a record per row of pages(page_id, url, html) and return the folder of the finished archives.

    The payload is the html in UTF-8, empty where null. Of rows with equal payloads of `least` bytes or more, those
    with the smallest page_id are responses and the others revisits of it; rows without a page_id are revisits
    where another row has one, else responses. Repeated rows give repeated records. An archive of a task that was
    run again is not listed in manifest.parquet; such files are removed before the folder is returned. Only payloads that stand in
    several rows are shuffled (and those that share one of the 2 ** PLACES marks with one).
    """
    folder = folder or new_folder(spark, "warc")
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    p = p.withColumn("digest", F.sha2("payload", 256))
    place = F.pmod(F.xxhash64("digest"), F.lit(1 << PLACES)).alias("place")
    first = p.where(F.octet_length("payload") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null").select("digest", "first")
    first = materialise(spark, first, "repeated")
    # payloads that stand alone are written where they are read; the others, and those that share a mark with them, meet by digest
    held = _marks(spark, first.select(place))
    p = p.select("page_id", "url", "payload", "digest", place)
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    shared = p.mapInArrow(_shared(held), p.schema).join(first, "digest", "left").select("page_id", "url", "payload", "digest", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("first")).alias("refers_to"))
    listed = "path string, records long, bytes long"
    p.mapInArrow(_write(folder, date, level, held), listed).union(shared.mapInArrow(_write(folder, date, level), listed)).write.parquet(f"{folder}/manifest.parquet")
    remove(spark, first)
    good = {r.path for r in spark.read.parquet(f"{folder}/manifest.parquet").select("path").collect()}  # a row per file
    from wardcraft.plans.files import filesystem

    for uri, _ in files_in(folder, ".warc.gz"):
        if uri.rpartition("/")[2] not in {x.rpartition("/")[2] for x in good}:
            store, path = filesystem(uri)
            store.delete_file(path)
    return folder


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = write_warc(spark, table(spark, sf_dir, "pages"))
    responses = read_warc(spark, folder, "record_type string, page_id long, payload binary").where("record_type = 'response'")
    revisits = read_warc(spark, folder, "record_type string, page_id long, payload_bytes long, payload_digest string, refers_to long").where("record_type = 'revisit'")
    full = responses.select("page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"))
    return full.unionByName(revisits.select(full.columns))


OP2_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""
