"""WARC archives with a two-level capture index.

Archives are WARC/1.1 files of plain records, written by Spark's own text
writer: a record is a row, and the writer's line separator is the blank lines
that end a record. So every store that Spark writes to will do, and a lost task
is simply written again. Archives are cut by bytes. The index sorts captures by
their URL key with the host reversed, in blocks of zlib-compressed lines; a
sparse directory holds each block's first key and its byte range, and a short
list the first and last key of each part of the directory. A lookup searches
the list, reads the directory of a part, searches that, reads the range of one
block, and then the range of the record itself. A reading of everything goes
the same way: the directory's blocks by their ranges, and the records of the
captures in them by theirs, in the order of their places.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import re
import zlib
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hadoop_path, new_path, partitions, stage, table

MIN_REVISIT = 1000
END = "\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FILE_BYTES = 16 << 20
BLOCK_LINES = 1000
#: Blocks of an index file; bytes that are read at once.
SEGMENT, READ_BYTES = 1024, 8 << 20
#: Largest table of payloads with copies that is broadcast, and what a row of it takes; beyond it the pages are joined by shuffle.
BROADCAST_BYTES, COPY_BYTES = 64 << 20, 128


def plan_records(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """page_id, place, url, html, payload_bytes, digest (hex SHA-1), refers_to, refers_place.

    Of rows with equal payloads of at least min_revisit bytes, that with the
    largest page_id is the response and the others revisit it; where the
    largest page_id itself repeats, each of its rows is a response, and the one
    of the largest place is referred to. A null html is empty. A row without
    page_id is a response. place numbers the rows of the table as it is read,
    so that records of one page_id have names of their own. Other columns are
    ignored.
    """
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", F.monotonically_increasing_id().alias("place"), "url", html.alias("html"), F.octet_length(html).cast("long").alias("payload_bytes"), F.sha1(html.cast("binary")).alias("digest"))
    copies = rows.where(F.col("payload_bytes") >= min_revisit).groupBy("digest").agg(F.max(F.struct("page_id", "place")).alias("keeper"), F.count("*").alias("n")).where("n > 1").select("digest", F.col("keeper.page_id").alias("keeper"), F.col("keeper.place").alias("keeper_place"))
    # Staged: where it is joined by shuffle, a payload in a third of all pages is a plain exchange that adaptive execution splits.
    copies = stage(copies, "copies")
    small = copies.count() * COPY_BYTES <= BROADCAST_BYTES
    out = rows.join(F.broadcast(copies) if small else copies.hint("merge"), "digest", "left")
    revisits = (F.col("page_id") < F.col("keeper")) & (F.col("payload_bytes") >= min_revisit)
    return out.select("page_id", "place", "url", "html", "payload_bytes", "digest", F.when(revisits, F.col("keeper")).alias("refers_to"), F.when(revisits, F.col("keeper_place")).alias("refers_place"))


def _urn(page_id, place):
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(":"), place.cast("string"), F.lit(">"))


def record():
    """One WARC record of plan_records() without its closing blank lines, as a Column."""
    refers_to, page_id, url, html, payload_bytes, digest, place, refers_place = map(F.col, ("refers_to", "page_id", "url", "html", "payload_bytes", "digest", "place", "refers_place"))
    revisit = refers_to.isNotNull()
    block = F.when(revisit, F.lit("")).otherwise(html)
    line = lambda key, value: F.concat(F.lit(f"{key}: "), value, F.lit("\r\n"))
    target = F.regexp_replace(url, "[\\x00-\\x20\\x7F]", "")
    return F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", _urn(page_id, place)),
        line("WARC-Date", F.lit(DATE)),
        F.when(url.isNull(), "").otherwise(line("WARC-Target-URI", target)),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest)),
        line("WARC-Payload-Length", payload_bytes.cast("string")),
        F.when(revisit, F.concat(line("WARC-Refers-To", _urn(refers_to, refers_place)), line("WARC-Profile", F.lit(PROFILE)))).otherwise(""),
        F.lit("Content-Type: text/html; charset=utf-8\r\n"),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
        block,
    )


def write_warc(pages: DataFrame, path: str, min_revisit: int = MIN_REVISIT, file_bytes: int = FILE_BYTES) -> str:
    """Writes archives of at most file_bytes each and one record more, whatever the pages' sizes."""
    text = plan_records(pages, min_revisit).select(record().alias("value"))

    def cut(batches):
        at = 0
        for batch in batches:
            values = batch.column("value")
            offsets = np.frombuffer(values.buffers()[1], dtype="i4")[values.offset : values.offset + len(values) + 1].astype("i8")
            sizes = np.diff(offsets) + len(END)
            begin = at + np.cumsum(sizes) - sizes
            at += int(sizes.sum())
            yield pa.RecordBatch.from_arrays([values, pa.array(begin // file_bytes)], names=["value", "piece"])

    # each task numbers its files by the bytes before them
    text.mapInArrow(cut, "value string, piece long").write.partitionBy("piece").option("lineSep", END).text(path)
    return path


def parse(data: bytes | memoryview):
    """(offset, length, headers, payload) of each record."""
    at = 0
    while at < len(data):
        size, end = 2048, -1
        while end < 0:  # a head is short, but for a long URL
            lead = bytes(data[at : at + size])
            end = lead.find(b"\r\n\r\n")
            if end < 0 and at + size >= len(data):
                raise ValueError(f"broken record at {at}")
            size *= 4
        head = dict(x.split(": ", 1) for x in lead[:end].decode().split("\r\n")[1:])
        end += at
        n = int(head["Content-Length"])
        payload = bytes(data[end + 4 : end + 4 + n])
        if len(payload) != n or data[end + 4 + n : end + 8 + n] != b"\r\n\r\n":
            raise ValueError(f"broken record at {at}")
        yield at, end + 8 + n - at, head, payload
        at = end + 8 + n


def _page(urn: str | None) -> int | None:
    number = urn[10:-1].split(":")[0] if urn else "none"
    return None if number == "none" else int(number)


_CAPTURE = "file string, offset long, length long, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
_KINDS = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
_NAMES = ["file", "offset", "length", "page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "html"]


def _row(file: str, at: int, n: int, head: dict, payload: bytes, html: bool) -> tuple:
    """A record as a capture: of a response size and digest are those of the payload read, of a revisit what it says of the payload it stands for."""
    if head["WARC-Type"] == "response":
        digest, size = hashlib.sha1(payload).hexdigest(), len(payload)
        if f"sha1:{digest}" != head["WARC-Payload-Digest"]:
            raise ValueError(f"digest differs in {file} at {at}")
    else:
        digest, size = head["WARC-Payload-Digest"][5:], int(head["WARC-Payload-Length"])
    return (file, at, n, _page(head["WARC-Record-ID"]), head.get("WARC-Target-URI"), size, digest, head["WARC-Type"], _page(head.get("WARC-Refers-To")), *([payload.decode()] if html else []))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), _KINDS)], names=_NAMES[: len(rows[0])])


def read_warc(spark: SparkSession, path: str, html: bool = False) -> DataFrame:
    """Every record of the archives, by reading them from end to end: file, offset, length, page_id, url, payload_bytes, payload_digest, record_type, refers_to (and html)."""

    def run(batches):
        for batch in batches:
            for file, content in zip(batch.column("path"), batch.column("content")):
                data, file, rows, held = memoryview(content.as_buffer()), file.as_py(), [], 0
                for at, n, head, payload in parse(data):
                    rows.append(_row(file, at, n, head, payload, html))
                    held += n if html else 200
                    if held > READ_BYTES:
                        yield _batch(rows)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path)
    return files.select("path", "content").mapInArrow(run, _CAPTURE + ", html string" * html)


_HOST = re.compile(r"^www\d*\.")


def url_key(url: str | None) -> str:
    """Sort key: the host's labels reversed and comma-joined, then ')', the path and the query, in lower case without fragment and default port. No host: the URL as it is."""
    url = (url or "").strip()
    try:
        parts = urlsplit(url)
        host, port = (parts.hostname or "").lower(), parts.port
    except ValueError:
        return url.lower()
    if not host:
        return url.lower()
    labels = _HOST.sub("", host).split(".")
    own = f":{port}" if port not in (None, 80, 443) else ""
    return (",".join(reversed(labels)) + own + ")" + (parts.path or "/") + ("?" + parts.query if parts.query else "")).lower()


_DIRECTORY = "segment long, number long, first_key string, offset long, length long, part long"


def write_index(captures: DataFrame, path: str, block_lines: int = BLOCK_LINES) -> str:
    """Index of rows of read_warc(): ``path/blocks``, ``path/directory`` and ``path/parts``.

    Captures go to ranges of (key, page_id), are sorted, and become blocks of
    block_lines lines, compressed and base64-coded so that the text writer can
    write each as a line. Key ranges of one hot URL are split by page_id and
    place. The directory has one row a block: part, segment (its file), number,
    first key, offset, length; parts has the first and last key of each part.
    """
    spark = captures.sparkSession

    @F.pandas_udf("string")
    def keyed(urls):
        return urls.map(url_key, na_action=None)

    rows = captures.select(keyed("url").alias("url_key"), F.coalesce("page_id", F.lit(-1)).alias("page"), "file", "offset", F.to_json(F.struct("url", "page_id", "record_type", "refers_to", "payload_digest", "file", "offset", "length")).alias("line"))
    order = ["url_key", "page", "file", "offset"]
    rows = stage(rows, "captures").repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).select("url_key", "line")

    def run(batches):
        held: list[tuple[str, str]] = []
        number = at = 0

        def block():
            nonlocal number, at
            data = base64.b64encode(zlib.compress("".join(f"{k} {x}\n" for k, x in held).encode())).decode()
            at = 0 if number % SEGMENT == 0 else at
            row = (number // SEGMENT, number, held[0][0], held[-1][0], at, len(data), data)
            number, at = number + 1, at + len(data) + 1
            held.clear()
            return row

        for batch in batches:
            out = []
            for k, x in zip(batch.column("url_key").to_pylist(), batch.column("line").to_pylist()):
                held.append((k.replace(" ", "%20").replace("\n", "%0A"), x))
                if len(held) == block_lines:
                    out.append(block())
            if out:
                yield _blocks(out)
        if held:
            yield _blocks([block()])

    blocks = rows.mapInArrow(run, "segment long, number long, first_key string, last_key string, offset long, length long, data string")
    blocks = stage(blocks.select(F.spark_partition_id().cast("long").alias("part"), "*"), "blocks")
    lines = blocks.select("part", "segment", "number", F.col("data").alias("value")).repartition(partitions(spark), "part", "segment").sortWithinPartitions("part", "segment", "number")
    lines.select("part", "segment", "value").write.partitionBy("part", "segment").text(f"{path}/blocks")
    directory = blocks.drop("data", "last_key")
    directory.repartition(partitions(spark), "part").sortWithinPartitions("part", "number").write.partitionBy("part").parquet(f"{path}/directory")
    blocks.groupBy("part").agg(F.min("first_key").alias("first_key"), F.max("last_key").alias("last_key")).coalesce(1).write.parquet(f"{path}/parts")
    return path


def _blocks(rows: list) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["segment", "number", "first_key", "last_key", "offset", "length", "data"])


def _block_lines(data: bytes) -> list[str]:
    return zlib.decompress(base64.b64decode(data)).decode().split("\n")[:-1]


def _open(uri: str):
    """A file of the shared folder, opened by a Python worker; ranges of it are read, not the whole. The stores are those of pyarrow: file, hdfs, s3, gs, abfs."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", re.sub(r"^file:/+", "file:///", uri)))
    return store.open_input_file(path)


class _Ranges:
    """Byte ranges of files, in ascending order in each; of neighbours up to READ_BYTES are read at once."""

    def __init__(self):
        self.name = self.file = None

    def read(self, wanted: list[tuple[str, int, int]]):
        """Yields the bytes of each (file, offset, length)."""
        i = 0
        while i < len(wanted):
            name, at, n = wanted[i]
            j, end = i + 1, at + n
            while j < len(wanted) and wanted[j][:2] == (name, end) and end - at < READ_BYTES:
                end += wanted[j][2]
                j += 1
            if name != self.name:
                self.name, self.file = name, _open(name)
            self.file.seek(at)
            data = memoryview(self.file.read(end - at))
            for _, x, m in wanted[i:j]:
                yield data[x - at : x - at + m]
            i = j


def index_captures(spark: SparkSession, path: str) -> DataFrame:
    """Every capture of an index, by walking its directory: url, page_id, record_type, refers_to, payload_digest, file, offset, length."""
    place = lambda name: F.regexp_extract("path", f"/{name}=([0-9]+)/", 1).cast("long").alias(name)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").option("recursiveFileLookup", "true").load(f"{path}/blocks").select("path", place("part"), place("segment"))
    order = ["part", "segment", "offset"]
    blocks = spark.read.schema(_DIRECTORY).parquet(f"{path}/directory").select(*order, "length").join(files, ["part", "segment"])
    # little to shuffle and much to read: a stated number of partitions isn't coalesced
    blocks = blocks.repartition(partitions(spark), "part", "segment").sortWithinPartitions(*order).select("path", "offset", "length")

    def run(batches):
        ranges = _Ranges()
        for batch in batches:
            for data in ranges.read(list(zip(*(batch.column(c).to_pylist() for c in ("path", "offset", "length"))))):
                yield pa.RecordBatch.from_arrays([pa.array([x.split(" ", 1)[1] for x in _block_lines(data)], pa.string())], names=["line"])

    line = F.from_json("line", "url string, page_id long, record_type string, refers_to long, payload_digest string, file string, offset long, length long")
    return blocks.mapInArrow(run, "line string").select(line.alias("x")).select("x.*")


def fetch_records(captures: DataFrame, html: bool = False) -> DataFrame:
    """The records of captures (file, offset, length), read by their ranges: the columns of read_warc(). A file's ranges go to one task, in order; files are bounded."""

    def run(batches):
        ranges = _Ranges()
        for batch in batches:
            wanted, rows, held = list(zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length")))), [], 0
            for (file, at, n), data in zip(wanted, ranges.read(wanted)):
                _, length, head, payload = next(parse(data))
                if length != n:
                    raise ValueError(f"no record of {n} bytes in {file} at {at}")
                rows.append(_row(file, at, n, head, payload, html))
                held += n if html else 200
                if held > READ_BYTES:
                    yield _batch(rows)
                    rows, held = [], 0
            if rows:
                yield _batch(rows)

    order = captures.select("file", "offset", "length").repartition(partitions(captures.sparkSession), "file").sortWithinPartitions("file", "offset")
    return order.mapInArrow(run, _CAPTURE + ", html string" * html)


class CaptureIndex:
    """Lookups by URL. Holds the first and last key of each part, and the directories of parts that were searched."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.parts = spark.read.parquet(f"{path}/parts").orderBy("first_key", "part").collect()  # one row a partition
        self.firsts = [r.first_key for r in self.parts]
        self.known: dict[int, tuple[list, list]] = {}
        self.files: dict[tuple[int, int], str] = {}

    def _range(self, path: str, offset: int, length: int) -> bytes:
        fs, p = hadoop_path(self.spark, path)
        stream = fs.open(p)
        try:
            stream.seek(offset)
            return bytes(stream.readNBytes(length))
        finally:
            stream.close()

    def _file(self, part: int, segment: int) -> str:
        if (part, segment) not in self.files:
            fs, p = hadoop_path(self.spark, f"{self.path}/blocks/part={part}/segment={segment}")
            self.files[part, segment] = next(str(x.getPath().toString()) for x in fs.listStatus(p) if x.getPath().getName().startswith("part-"))
        return self.files[part, segment]

    def _directory(self, part: int) -> tuple[list, list]:
        """The blocks of one part, and their first keys; only that part's file is read."""
        if part not in self.known:
            rows = sorted(self.spark.read.schema(_DIRECTORY).parquet(f"{self.path}/directory").where(F.col("part") == part).collect(), key=lambda r: r.number)
            self.known[part] = rows, [r.first_key for r in rows]
        return self.known[part]

    def lookup(self, url: str) -> list[dict]:
        """All captures of a URL's key, in order of page_id."""
        key = url_key(url).replace(" ", "%20").replace("\n", "%0A")
        found = []
        for p in self.parts[: bisect.bisect_right(self.firsts, key)]:
            if p.last_key < key:
                continue
            rows, firsts = self._directory(p.part)
            for r in rows[max(0, bisect.bisect_left(firsts, key) - 1) : bisect.bisect_right(firsts, key)]:
                lines = _block_lines(self._range(self._file(p.part, r.segment), r.offset, r.length))
                found += [json.loads(x.split(" ", 1)[1]) for x in lines if x.split(" ", 1)[0] == key]
        return found

    def fetch(self, capture: dict) -> bytes:
        """The payload of a response, or of the response that a revisit stands for if its capture is given instead."""
        return next(parse(self._range(capture["file"], capture["offset"], capture["length"])))[3]


def op7_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures = read_warc(spark, write_warc(table(spark, sf_dir, "pages"), new_path(spark, "warc")))
    index = write_index(captures, new_path(spark, "index"))
    # The answer is read by way of the index: blocks by the directory's ranges, records by their captures'.
    out = fetch_records(index_captures(spark, index))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP7_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
k AS (SELECT payload_digest, max(page_id) AS keeper FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT p.page_id, payload_bytes, p.payload_digest, CASE WHEN page_id < keeper THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < keeper THEN keeper END AS refers_to
FROM p LEFT JOIN k ON k.payload_digest = p.payload_digest AND payload_bytes >= 1000
"""

