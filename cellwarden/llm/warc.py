"""WARC archives with a two-level capture index.

``write`` stores one record per page in WARC files; equal payloads of at least
``REVISIT_BYTES`` are stored once and revisited by the others. ``build_index``
reads the archives back, sorts one line per capture by its reversed-host URL
key into compressed blocks and keeps the first key of every block in a sparse
directory. ``lookup`` binary-searches directory and blocks for captures;
``read_ranges`` opens the archives at their offsets and reads just their bytes.

Archives are written by Spark as plain WARC 1.1 text: payloads are UTF-8 and
every record ends in two line breaks, which is the writer's line separator.
Tasks open them through Arrow's file systems (files, HDFS, S3, GCS, ABFS);
the folder that all executors share has to be in one of those.
"""

from __future__ import annotations

import bisect
import hashlib
import urllib.parse
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellwarden.llm.common import shared_folder, small, stored

REVISIT_BYTES = 1000
BLOCK_LINES = 1000  # captures in a compressed block
TOP = 1024  # entries of the directory's own directory, at most about
SALTS = 8  # tasks that share one segment of the directory
# Payloads up to so many bytes, and how many of them go to one file: no file beyond 512 MB.
_CLASSES = ((1 << 16, 8000), (1 << 21, 250), (1 << 31, 1))
_END = "\r\n\r\n"
HEAD_BYTES = 64 << 10  # read at once while walking from head to head
OUT_BYTES = 4 << 20  # payloads in one batch of results; a longer one is a batch of its own
SPAN = 32 << 20  # ranges of one file within so many bytes go to one task


def surt(url: Column) -> Column:
    """Reversed-host key: ``http://www.a.example.com/x`` becomes ``com,example,a)/x``; no host: the url itself.

    Scheme, user, port, a leading ``www.`` and the fragment are dropped; letters of the host are lowered.
    """
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    host = F.regexp_replace(host, r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)", 1), r"^$", "/")
    key = F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), path)
    return F.coalesce(F.when(host != "", key).otherwise(url), F.lit(""))


def decided(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """page_id, url, html, payload_bytes, payload_digest, record_type, refers_to for each page.

    Of equal payloads of at least ``least`` bytes the largest page_id is the
    response. Payloads are compared by SHA-1 and length.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        html.alias("html"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("html").cast("long"),
                             "payload_digest": F.sha1(F.col("html").cast("binary"))})
    groups = (rows.filter(F.col("payload_bytes") >= least).groupBy("payload_digest", "payload_bytes")
              .agg(F.max("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n"))
    rows = rows.join(small(stored(groups, "copies")), ["payload_digest", "payload_bytes"], "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return rows.select("page_id", "url", "html", "payload_bytes", "payload_digest",
                       F.when(revisit, "revisit").otherwise("response").alias("record_type"),
                       F.when(revisit, F.col("first")).alias("refers_to"))


def _record(p: DataFrame) -> Column:
    line = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))
    named = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    url = F.regexp_replace(F.col("url"), r"[\r\n]", "%0A")
    response = F.col("record_type") == "response"
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    F.col("payload_bytes").cast("string"), F.lit("\r\n\r\n"))
    block = F.when(response, F.concat(http, F.col("html"))).otherwise(http)
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.col("record_type"), F.lit("\r\n"),
        line("WARC-Target-URI", url), F.lit("WARC-Date: 1970-01-01T00:00:00Z\r\n"),
        line("WARC-Record-ID", named(F.col("page_id"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        F.when(~response, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n")).otherwise(""),
        line("WARC-Refers-To", named(F.col("refers_to"))),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "),
        F.octet_length(block).cast("string"), F.lit("\r\n\r\n"))
    return F.concat(head, block)


def write(pages: DataFrame, folder: str) -> None:
    """One record per page, in files of bounded size under ``folder``."""
    rows, least = decided(pages), -1
    for i, (most, per_file) in enumerate(_CLASSES):
        part = rows.filter((F.col("payload_bytes") > least) & (F.col("payload_bytes") <= most))
        (part.select(_record(part).alias("value")).write.option("lineSep", _END)
         .option("maxRecordsPerFile", per_file).text(f"{folder}/size-{i}"))
        least = most


def opened(path: str):
    """A file that can be read at any offset, from a path as Spark names it."""
    if path.startswith("file:"):
        return fs.LocalFileSystem().open_input_file("/" + path[5:].lstrip("/"))
    system, name = fs.FileSystem.from_uri(urllib.parse.quote(path, safe="/:@"))
    return system.open_input_file(urllib.parse.unquote(name))


def _head(data: bytes, at: int = 0) -> tuple[dict[bytes, bytes], int]:
    """Header fields of the record at ``at`` and where its block starts."""
    end = data.index(b"\r\n\r\n", at)
    fields = dict(x.split(b": ", 1) for x in data[at:end].split(b"\r\n")[1:])
    return fields, end + 4


def _heads(source) -> Iterator[tuple[dict[bytes, bytes], int, int]]:
    """(fields, offset, length) of every record; blocks are skipped, so little more than the heads is read."""
    size, at, base, data = source.size(), 0, 0, b""
    while at < size:
        more = HEAD_BYTES
        while not base <= at < base + len(data) or data.find(b"\r\n\r\n", at - base) < 0:
            if at == base and base + len(data) >= size:
                raise ValueError(f"a record without an end of its head at byte {at}")
            base, data = at, source.read_at(more, at)
            more *= 2
        fields, start = _head(data, at - base)
        end = base + start + int(fields[b"Content-Length"])
        yield fields, at, end - at
        at = end + len(_END)


def _page(value: bytes | None) -> int | None:
    return int(value[len(b"<urn:page:"):-1]) if value else None


def captures(folder: str, spark) -> DataFrame:
    """(url, page_id, path, offset, length) of every record, from a walk over the archives' heads."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(path, found):
            urls = [f.get(b"WARC-Target-URI") for f, _, _ in found]
            return pa.RecordBatch.from_arrays(
                [pa.array([None if u is None else u.decode("utf-8", "replace") for u in urls], pa.string()),
                 pa.array([_page(f.get(b"WARC-Record-ID")) for f, _, _ in found], pa.int64()),
                 pa.array([path] * len(found), pa.string()), pa.array([x[1] for x in found], pa.int64()),
                 pa.array([x[2] for x in found], pa.int64())],
                names=["url", "page_id", "path", "offset", "length"])

        for batch in batches:
            for path in batch.column("path").to_pylist():
                found = []
                with opened(path) as source:
                    for x in _heads(source):
                        found.append(x)
                        if len(found) == 1000:
                            yield rows(path, found)
                            found = []
                yield rows(path, found)

    return archives(folder, spark).mapInArrow(run, "url string, page_id long, path string, offset long, length long")


def archives(folder: str, spark) -> DataFrame:
    """(path): the archives that hold anything; their contents are not read."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*")
            .load(folder).filter("length > 0").select("path"))


def sort_key(url: Column, page_id: Column) -> Column:
    """Keys sort by reversed host and path, then by page."""
    return F.concat(surt(url), F.lit("\t"), F.coalesce(F.lpad(page_id.cast("string"), 20, "0"), F.lit("")))


def build_index(found: DataFrame) -> DataFrame:
    """Stored blocks (block, first_key, lines): keys in order, zlib-compressed ``key path offset length`` lines."""
    keyed = found.select(sort_key(F.col("url"), F.col("page_id")).alias("key"), "path", "offset", "length")
    keyed = keyed.repartitionByRange("key", "path", "offset").sortWithinPartitions("key", "path", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines: list[str] = []

        def block():
            part, lines[:] = lines[:BLOCK_LINES], lines[BLOCK_LINES:]
            data = "\n".join(part).encode("utf-8", "surrogatepass")
            return pa.RecordBatch.from_arrays(
                [pa.array([part[0].split("\x00", 1)[0]]), pa.array([zlib.compress(data)], pa.binary())], names=["first_key", "lines"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                lines.append("\x00".join(map(str, row)).replace("\n", "%0A"))
            while len(lines) >= BLOCK_LINES:
                yield block()
        while lines:
            yield block()

    blocks = keyed.mapInArrow(run, "first_key string, lines binary")
    return stored(blocks.withColumn("block", F.monotonically_increasing_id()), "blocks")


def _routed(keys: DataFrame, blocks: DataFrame) -> DataFrame:
    """(block, key): the last block that starts before each key, and those that start with it.

    The directory is cut into segments at every so-many-th first key; keys are
    routed to a segment by binary search over those, then to a block inside it.
    """
    directory = blocks.select("first_key", "block")
    n = directory.count()
    # Every so-many-th first key: a bounded top level, held by the driver.
    step = max(1, n // TOP)
    top = sorted(r[0] for r in directory.filter(F.pmod(F.xxhash64("first_key"), F.lit(step)) == 0).select("first_key").distinct().collect())

    known = set(top)

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, kinds = batch.column("key").to_pylist(), batch.column("kind").to_pylist()
            at = [bisect.bisect_right(top, k) for k in keys]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int64())], names=["key", "kind", "block", "salt", "segment"])
            # Captures of a key that starts a segment may begin in the block before.
            both = [i for i, (k, kind) in enumerate(zip(keys, kinds, strict=True)) if kind == 1 and k in known]
            part = batch.take(pa.array(both, pa.int64()))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array([at[i] - 1 for i in both], pa.int64())],
                                             names=["key", "kind", "block", "salt", "segment"])

    shape = "key string, kind int, block long, salt int, segment long"
    entry = directory.select(F.col("first_key").alias("key"), F.lit(0).alias("kind"), "block")
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    asked = keys.select("key", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("block"),
                        F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int").alias("salt"))
    rows = entry.select("*", salts).union(asked).mapInArrow(segments, shape)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where = last = pending = None
        for batch in batches:
            keys_out, blocks_out = [], []
            for key, kind, block, salt, segment in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if where != (segment, salt):
                    where, last, pending = (segment, salt), None, None
                found = None
                if kind == 1:
                    pending, found = key, last
                else:
                    last = block
                    if key == pending:
                        found = block
                if found is not None:
                    keys_out.append(pending)
                    blocks_out.append(found)
            yield pa.RecordBatch.from_arrays([pa.array(blocks_out, pa.int64()), pa.array(keys_out, pa.string())], names=["block", "key"])

    # Questions come before the entries of an equal key.
    ordered = rows.repartition("segment", "salt").sortWithinPartitions("segment", "salt", "key", F.desc("kind"), "block")
    return ordered.mapInArrow(fill, "block long, key string")


def lookup(keys: DataFrame, blocks: DataFrame) -> DataFrame:
    """(key, path, offset, length) of the captures of ``keys``(key); keys without a capture give no row."""
    asked = _routed(keys.select("key").distinct(), blocks)
    rows = blocks.select("block", F.lit(None).cast("string").alias("key"), "lines").union(
        asked.select("block", "key", F.lit(None).cast("binary")))
    rows = rows.repartition("block").sortWithinPartitions("block", F.col("key").asc_nulls_first())

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines: list[str] = []
        for batch in batches:
            out = []
            for _, key, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if data is not None:
                    lines = zlib.decompress(data).decode("utf-8", "surrogatepass").split("\n")
                    continue
                plain = key.replace("\n", "%0A") + "\x00"
                at = bisect.bisect_left(lines, plain)
                while at < len(lines) and lines[at].startswith(plain):
                    out.append((key, *lines[at].split("\x00")[1:]))
                    at += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in out], pa.string()), pa.array([r[1] for r in out], pa.string()),
                 pa.array([int(r[2]) for r in out], pa.int64()), pa.array([int(r[3]) for r in out], pa.int64())],
                names=["key", "path", "offset", "length"])

    return rows.mapInArrow(search, "key string, path string, offset long, length long")


def read_ranges(places: DataFrame) -> DataFrame:
    """page_id, url, record_type, refers_to, digest (as recorded), payload_bytes and payload of the records at ``places``.

    Ranges near one another in a file go to one task in the order of their
    offsets; every range is one read, and no other byte is.
    """
    near = places.select("path", "offset", "length").distinct().withColumn("span", F.floor(F.col("offset") / SPAN))
    rows = near.repartition("path", "span").sortWithinPartitions("path", "offset").select("path", "offset", "length")
    types = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary())
    names = ["page_id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes", "payload"]

    def row(record: bytes) -> tuple:
        fields, start = _head(record)
        http_end = record.index(b"\r\n\r\n", start) + 4
        size = int(record[start:http_end].rsplit(b"Content-Length: ", 1)[1])
        url, kind = fields.get(b"WARC-Target-URI"), fields[b"WARC-Type"].decode()
        payload, digest = record[http_end:], fields[b"WARC-Payload-Digest"][5:].decode()
        if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
            raise ValueError(f"payload of {fields} differs from its digest")
        return (_page(fields.get(b"WARC-Record-ID")), None if url is None else url.decode("utf-8", "replace"), kind,
                _page(fields.get(b"WARC-Refers-To")), digest, size, payload if kind == "response" else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flush = lambda out: pa.RecordBatch.from_arrays(
            [pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names=names)
        path, source = None, None
        for batch in batches:
            out, held = [], 0
            for name, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if name != path:
                    if source is not None:
                        source.close()
                    path, source = name, opened(name)
                out.append(row(source.read_at(length, offset)))
                held += length
                if held >= OUT_BYTES:
                    yield flush(out)
                    out, held = [], 0
            yield flush(out)
        if source is not None:
            source.close()

    return rows.mapInArrow(
        run, "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary")


def round_trip(pages: DataFrame) -> DataFrame:
    """Pages written to archives, indexed, looked up by key and read back by range: one row per page.

    * A null html is the empty payload; a null url has the empty key and no URI field.
    * Repeated rows are written as often as they come; of a repeated largest
      page_id every row is a response. A null page_id is never referred to,
      unless all its copies lack one: then all are responses.
    * An empty table gives empty archives and an empty result.
    """
    folder = shared_folder(pages.sparkSession, "warc")
    write(pages, folder)
    found = captures(folder, pages.sparkSession)
    blocks = build_index(found)
    keys = pages.select(sort_key(F.regexp_replace(F.col("url").cast("string"), r"[\r\n]", "%0A"),
                                 F.col("page_id").cast("long")).alias("key"))
    return read_ranges(lookup(keys, blocks))
