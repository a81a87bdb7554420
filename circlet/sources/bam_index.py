"""Region reads of sorted BAM files by their BAI index: only the chunks that a region's bins name are read.

``fetch_indexed`` takes the regions as a DataFrame: the index is read into a
table, regions are joined with it by bin, and tasks read chunks by ranges of
place, so neither regions nor chunks pass through the driver. ``BamSource`` is
the same as a data source (``spark.read.format("bam")``) whose splits are planned
from what a filter on chrom, start and stop leaves.

Places in a blocked file are virtual offsets: the block's place times 65,536 plus
the place in the inflated block.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from . import alignments
from .alignments import SCHEMA, SPLIT_BYTES, _batches, _head, _record, _Stream

#: Levels of the binning scheme (fixed values of the format): number of a level's first bin, and the bits that its bins hold.
LEVELS = [(0, 29), (1, 26), (9, 23), (73, 20), (585, 17), (4681, 14)]
WINDOW_BITS, NO_BIN, LONGEST = 14, 37_450, 1 << 29
INDEX = "path string, ref int, bin int, begin long, end long"


def parse_index(data: bytes):
    """(ref, bin, begin, end) of each chunk, and (ref, None, number of the window, first place of reads over it) of the linear index."""
    if data[:4] != b"BAI\1":
        raise ValueError("not a BAI index")
    (n_ref,) = struct.unpack_from("<i", data, 4)
    at = 8
    for ref in range(n_ref):
        (n_bin,) = struct.unpack_from("<i", data, at)
        at += 4
        for _ in range(n_bin):
            b, n = struct.unpack_from("<Ii", data, at)
            at += 8
            for i in range(n if b < NO_BIN else 0):
                yield ref, b, *struct.unpack_from("<QQ", data, at + 16 * i)
            at += 16 * n
        (n,) = struct.unpack_from("<i", data, at)
        at += 4
        for window, (first,) in enumerate(struct.iter_unpack("<Q", data[at : at + 8 * n])):
            yield ref, None, window, first
        at += 8 * n


def bins_over(start: int, stop: int) -> list[range]:
    """The bins that may hold reads over a region, level by level."""
    return [range(first + (start >> bits), first + (stop - 1 >> bits) + 1) for first, bits in LEVELS]


def joined(chunks: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Chunks in order; those that overlap are one."""
    out: list[tuple[int, int]] = []
    for begin, end in sorted(chunks):
        if out and begin < out[-1][1]:
            out[-1] = out[-1][0], max(end, out[-1][1])
        else:
            out.append((begin, end))
    return out


def decode_chunk(file, size: int, begin: int, end: int, chroms: list[str]):
    """Rows of SCHEMA of the records from one place up to another; the first must be where a record begins."""
    stream = _Stream(file, begin >> 16, size)
    stream.take(begin & 0xFFFF)
    while stream.place() < end and len(head := stream.take(4)) == 4:
        yield _record(stream.take(struct.unpack("<i", head)[0]), chroms)


# --- regions as a table ------------------------------------------------------


def _files(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    """path, length of the files that end so, in a folder or by a pattern or name."""
    return spark.read.format("binaryFile").load(path).where(F.col("path").endswith(suffix)).select("path", "length")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The BAI files at a path (x.bam.bai or x.bai) as a table with the rows of parse_index(); path is that of the BAM file."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                held = [(name, *row) for row in parse_index(content.as_py())]
                for i in range(0, len(held), 100_000):
                    columns = zip(*held[i : i + 100_000])
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64()))], names=[c.split()[0] for c in INDEX.split(", ")])

    files = spark.read.format("binaryFile").load(path).where(F.col("path").endswith(".bai"))
    bam = F.concat(F.regexp_replace("path", "(\\.bam)?\\.bai$", ""), F.lit(".bam"))
    return files.select(bam.alias("path"), "content").mapInArrow(run, INDEX)


def read_sizes_of(spark: SparkSession, path: str) -> DataFrame:
    """path, ref, chrom, length of the chromosomes in the headers of BAM files; a task reads a header and no more."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for uri, size in zip(batch.column("path").to_pylist(), batch.column("length").to_pylist()):
                with alignments._open(uri) as file:
                    lengths: list[int] = []
                    chroms = _head(_Stream(file, 0, size), lengths)
                n = len(chroms)
                yield pa.RecordBatch.from_arrays([pa.array([uri] * n, pa.string()), pa.array([size] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(chroms, pa.string()), pa.array(lengths, pa.int64())], names=["path", "size", "ref", "chrom", "length"])

    return _files(spark, path, ".bam").mapInArrow(run, "path string, size long, ref int, chrom string, length long")


def plan_chunks(spark: SparkSession, path: str, regions: DataFrame) -> DataFrame:
    """path, size, begin, end: the chunks that may hold reads over a region (chrom, start, stop), each once, those that overlap as one.

    Regions are cut at the ends of their chromosome; empty ones and those on
    chromosomes that a file hasn't name no chunks.
    """
    index = read_index(spark, path)
    start, stop = F.greatest("start", F.lit(0)), F.least("stop", "length", F.lit(LONGEST))
    asked = regions.select("chrom", "start", "stop").join(read_sizes_of(spark, path), "chrom").select("path", "size", "ref", start.alias("start"), stop.alias("stop")).where("start < stop").distinct()
    bits = lambda c, n: F.shiftright(c, n)
    over = F.concat(*[F.sequence(first + bits(F.col("start"), n), first + bits(F.col("stop") - 1, n)) for first, n in LEVELS])
    first = index.where("bin is null").select("path", "ref", F.col("begin").alias("_window"), F.col("end").alias("_first"))
    rows = asked.withColumn("_window", bits(F.col("start"), WINDOW_BITS)).join(first, ["path", "ref", "_window"], "left")
    rows = rows.select("path", "size", "ref", F.coalesce("_first", F.lit(0)).alias("_first"), F.explode(over.cast("array<int>")).alias("bin"))
    met = rows.join(index.where("bin is not null"), ["path", "ref", "bin"]).where("end > _first").select("path", "size", "ref", F.greatest("begin", "_first").alias("begin"), "end").distinct()
    # a chromosome's chunks are in order in a sorted file, so those of two chromosomes never overlap
    w = Window.partitionBy("path", "ref").orderBy("begin", "end")
    far = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    runs = met.withColumn("_new", F.when(far.isNull() | (F.col("begin") >= far), 1).otherwise(0)).withColumn("_run", F.sum("_new").over(w))
    return runs.groupBy("path", "size", "ref", "_run").agg(F.min("begin").alias("begin"), F.max("end").alias("end")).select("path", "size", "begin", "end")


def fetch_indexed(spark: SparkSession, path: str, regions: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Reads of indexed BAM files that overlap a region: only chunks that the index names are read, each by one task."""
    chunks = plan_chunks(spark, path, regions)
    total = chunks.agg(F.sum(F.shiftright("end", 16) - F.shiftright("begin", 16) + 65_536)).first()[0] or 0

    def run(batches):
        names: dict[str, list[str]] = {}
        for batch in batches:
            for uri, size, begin, end in zip(*(batch.column(c).to_pylist() for c in ("path", "size", "begin", "end"))):
                with alignments._open(uri) as file:
                    if uri not in names:
                        names[uri] = _head(_Stream(file, 0, size))
                    yield from _batches(decode_chunk(file, size, begin, end, names[uri]))

    n = int(min(max(1, -(-total // split_bytes)), 100_000))
    read = chunks.repartitionByRange(n, "path", "begin").sortWithinPartitions("path", "begin").mapInArrow(run, SCHEMA)
    return alignments.fetch(read, regions)


# --- regions as pushed filters -----------------------------------------------


@dataclass
class Split(InputPartition):
    """What one task reads: chunks of a file, or (chunks None) the records that begin in a range of bytes."""

    path: str
    size: int
    chunks: list[tuple[int, int]] | None
    begin: int = 0
    end: int = 0


class BamReader(DataSourceReader):
    def __init__(self, path: str, split_bytes: int):
        self.path, self.split_bytes = path, split_bytes
        self.chroms: set[str] | None = None
        self.start, self.stop = 0, LONGEST  # a read may overlap the region only if it begins before stop and ends behind start

    def pushFilters(self, filters):
        """Notes what the filters say of chrom, start and stop; Spark still evaluates all of them, as chunks hold other reads, too."""
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column == "chrom" and isinstance(f, (EqualTo, In)):
                names = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.chroms = names if self.chroms is None else self.chroms & names
            elif column in ("start", "stop") and isinstance(f, (EqualTo, LessThan, LessThanOrEqual, GreaterThan, GreaterThanOrEqual)):
                # start < x: reads over what lies before x; stop > x: over what lies behind it. A read's start is at least that of the region, too.
                x = int(f.value)
                if column == "start" and isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    self.stop = min(self.stop, x + (not isinstance(f, LessThan)))
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.start = max(self.start, x - (column == "stop" and not isinstance(f, GreaterThan)))
            yield f

    def _listed(self) -> list[tuple[str, int]]:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(alignments._uri(self.path))
        info = store.get_file_info(path)
        found = store.get_file_info(fs.FileSelector(path)) if info.type == fs.FileType.Directory else [info]
        scheme = alignments._uri(self.path)[: -len(path)] if alignments._uri(self.path).endswith(path) else "file://"
        return sorted((scheme + f.path, f.size) for f in found if f.is_file and f.path.endswith(".bam"))

    def partitions(self):
        out = []
        for path, size in self._listed():
            chunks = None if self.chroms is None else self._chunks(path, size)
            if chunks is None:
                out += [Split(path, size, None, at, at + self.split_bytes) for at in range(0, max(size, 1), self.split_bytes)]
                continue
            held: list[tuple[int, int]] = []
            for c in chunks:
                if held and (c[1] >> 16) - (held[0][0] >> 16) > self.split_bytes:
                    out.append(Split(path, size, held))
                    held = []
                held.append(c)
            if held:
                out.append(Split(path, size, held))
        return out

    def _chunks(self, path: str, size: int) -> list[tuple[int, int]] | None:
        """The chunks of a file that the filters leave; None: it has no index."""
        for name in (f"{path}.bai", f"{path[:-4]}.bai"):
            try:
                with alignments._open(name) as file:
                    data = bytes(file.read())
                break
            except FileNotFoundError:
                continue
        else:
            return None
        with alignments._open(path) as file:
            refs = {i for i, c in enumerate(_head(_Stream(file, 0, size))) if c in self.chroms}
        start, stop = max(0, self.start), min(self.stop, LONGEST)
        if start >= stop:
            return []
        bins, window = bins_over(start, stop), start >> WINDOW_BITS
        first: dict[int, int] = {}
        found = []
        for ref, b, begin, end in parse_index(data):
            if ref in refs:
                if b is None and begin == window:
                    first[ref] = end
                elif b is not None and any(b in r for r in bins):
                    found.append((ref, begin, end))
        return joined([(max(begin, first.get(ref, 0)), end) for ref, begin, end in found if end > first.get(ref, 0)])

    def read(self, split: Split | None):
        if split is None:  # what Spark makes of no splits
            return
        with alignments._open(split.path) as file:
            if split.chunks is None:
                yield from _batches(alignments.decode_split(file, split.begin, split.end, split.size))
            else:
                chroms = _head(_Stream(file, 0, split.size))
                yield from _batches(row for begin, end in split.chunks for row in decode_chunk(file, split.size, begin, end, chroms))


class BamSource(DataSource):
    """``spark.read.format("bam").load(path)``: BAM files with the columns of alignments.SCHEMA; option split_bytes.

    Filters on chrom, start and stop choose chunks by the index beside a file;
    files without an index are read by splits.
    """

    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BamReader:
        return BamReader(self.options["path"], int(self.options.get("split_bytes", SPLIT_BYTES)))


def register(spark: SparkSession) -> None:
    """Makes ``format("bam")`` known to a session, and lets it push filters to Python sources, without which Spark refuses one that takes them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(BamSource)
