"""Alignment files: SAM text and BAM, decoded to one schema."""

from __future__ import annotations

import io
import re
import struct
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "qname string, flag int, chrom string, start long, stop long, mapq int, cigar string, mate_chrom string, mate_start long, tlen int, seq string, nm int, sa string, cb string"
_NAMES = [x.split()[0] for x in SCHEMA.split(", ")]
_TYPES = [{"string": pa.string(), "int": pa.int32(), "long": pa.int64()}[x.split()[1]] for x in SCHEMA.split(", ")]
_OPS, _BASES = "MIDNSHP=X", "=ACMGRSVTWYHKDBN"
#: Bytes of a split, and of a read ahead.
SPLIT_BYTES, READ_BYTES = 64 << 20, 4 << 20
_SIZES = {"A": 1, "c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4}


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """SAM text; header lines are skipped, positions become 0-based and half-open."""
    from circlet.functions.text import cigar_length

    rows = spark.read.text(path).where(~F.col("value").startswith("@")).select(F.split("value", "\t").alias("f")).where(F.size("f") >= 11)
    f = lambda i: F.get("f", F.lit(i))
    tag = lambda name: F.try_element_at(F.transform(F.filter("f", lambda x: x.startswith(name + ":")), lambda x: F.regexp_replace(x, "^..:.:", "")), F.lit(1))
    start = f(3).cast("long") - 1
    mate = F.when(f(6) == "=", f(2)).when(f(6) == "*", None).otherwise(f(6))
    return rows.select(
        f(0).alias("qname"), f(1).cast("int").alias("flag"), F.when(f(2) != "*", f(2)).alias("chrom"), start.alias("start"), (start + F.when(f(5) == "*", 0).otherwise(cigar_length(f(5)))).alias("stop"), f(4).cast("int").alias("mapq"), f(5).alias("cigar"),
        mate.alias("mate_chrom"), (f(7).cast("long") - 1).alias("mate_start"), f(8).cast("int").alias("tlen"), f(9).alias("seq"), tag("NM").cast("int").alias("nm"), tag("SA").alias("sa"), tag("CB").alias("cb"),
    )


def _tags(data: bytes) -> dict[str, object]:
    out, at = {}, 0
    while at + 3 <= len(data):
        name, kind = data[at : at + 2].decode(), chr(data[at + 2])
        at += 3
        if kind in "ZH":
            end = data.index(b"\0", at)
            out[name], at = data[at:end].decode(), end + 1
        elif kind == "B":
            n = struct.unpack_from("<I", data, at + 1)[0]
            at += 5 + n * _SIZES[chr(data[at])]
        else:
            out[name] = struct.unpack_from("<" + {"A": "c", "c": "b", "C": "B", "s": "h", "S": "H"}.get(kind, kind), data, at)[0]
            at += _SIZES[kind]
    return out


def _record(r: bytes, chroms: list[str]) -> tuple:
    """A row of SCHEMA from a record's bytes."""
    name = lambda i: chroms[i] if i >= 0 else None
    ref, pos, l_name, mapq, _, n_ops, flag, l_seq, mate, mate_pos, tlen = struct.unpack_from("<iiBBHHHiiii", r)
    at = 32
    qname = r[at : at + l_name - 1].decode()
    at += l_name
    ops = struct.unpack_from(f"<{n_ops}I", r, at)
    at += 4 * n_ops
    seq = "".join(_BASES[b >> 4] + _BASES[b & 15] for b in r[at : at + (l_seq + 1) // 2])[:l_seq]
    at += (l_seq + 1) // 2 + l_seq
    t = _tags(r[at:])
    span = sum(x >> 4 for x in ops if _OPS[x & 15] in "MDN=X")
    return qname, flag, name(ref), pos, pos + span, mapq, "".join(f"{x >> 4}{_OPS[x & 15]}" for x in ops) or "*", name(mate), mate_pos, tlen, seq or "*", t.get("NM"), t.get("SA"), t.get("CB")


class _Stream:
    """The inflated bytes of a blocked gzip file from one of its blocks on, read as they are needed; knows in which block each byte is."""

    def __init__(self, file, at: int, size: int):
        self.file, self.at, self.size = file, at, size  # at: the next block
        self.raw, self.raw_at = b"", at
        self.held, self.begins = bytearray(), []  # begins: (place in held, block) of the blocks held
        self.done = at >= size

    def _bytes(self, at: int, n: int) -> bytes:
        """n bytes of the file at a place, read ahead."""
        if at < self.raw_at or at + n > self.raw_at + len(self.raw):
            self.file.seek(at)
            self.raw, self.raw_at = bytes(self.file.read(max(n, READ_BYTES))), at
        return self.raw[at - self.raw_at : at - self.raw_at + n]

    def more(self) -> bool:
        """Inflates one block more; False at the end of the file."""
        if self.at >= self.size:
            self.done = True
            return False
        head = self._bytes(self.at, 18)
        n = _block_size(head)
        if n is None:  # a plain gzip member: inflated to its end
            d, at = zlib.decompressobj(31), self.at
            self.begins.append((len(self.held), self.at))
            while not d.eof and at < self.size:
                part = self._bytes(at, min(1 << 16, self.size - at))
                self.held += d.decompress(part)
                at += len(part) - len(d.unused_data)
            self.at = at
            return True
        block = self._bytes(self.at, n)
        self.begins.append((len(self.held), self.at))
        self.held += zlib.decompress(block[12 + struct.unpack_from("<H", head, 10)[0] : -8], -15)
        self.at += n
        return True

    def take(self, n: int) -> bytes:
        """The next n bytes, fewer at the end of the file."""
        while len(self.held) < n and self.more():
            pass
        part = bytes(self.held[:n])
        del self.held[:n]
        kept = [(at - len(part), block) for at, block in self.begins]
        first = max((i for i, (at, _) in enumerate(kept) if at <= 0), default=0)
        self.begins = kept[first:]
        return part

    def block(self) -> int:
        """The block of the next byte."""
        while not self.held and self.more():
            pass
        return self.begins[0][1] if self.held else self.size

    def place(self) -> int:
        """The virtual offset of the next byte: its block's place times 65,536, and its place in the inflated block."""
        block = self.block()
        return block << 16 | (-self.begins[0][0] if self.held else 0)


def _block_size(head: bytes) -> int | None:
    """Bytes of the block that begins with head; None if it isn't a block of a blocked file."""
    if len(head) < 18 or head[:4] != b"\x1f\x8b\x08\x04" or head[12:16] != b"BC\x02\x00":
        return None
    return struct.unpack_from("<H", head, 16)[0] + 1


def _first_block(file, at: int, size: int) -> int:
    """The first block at or behind a place: a block's head is followed by another's, or by the end."""
    file.seek(at)
    data = bytes(file.read((1 << 17) + 64))
    i = data.find(b"\x1f\x8b\x08\x04")
    while i >= 0:
        n = _block_size(data[i : i + 18])
        if n and (at + i + n == size or _block_size(data[i + n : i + n + 18]) is not None):
            return at + i
        i = data.find(b"\x1f\x8b\x08\x04", i + 1)
    return size


def _record_end(data: bytes, at: int, n_ref: int) -> int | None:
    """Where the record at a place ends, or None if none can begin there."""
    if at + 36 > len(data):
        return None
    n, ref, pos, l_name, _, _, n_ops, flag, l_seq, mate, mate_pos, _ = struct.unpack_from("<iiiBBHHHiiii", data, at)
    sizes = 32 + l_name + 4 * n_ops + (l_seq + 1) // 2 + l_seq
    if not (-1 <= ref < n_ref and -1 <= mate < n_ref and pos >= -1 and mate_pos >= -1 and l_name > 0 and l_seq >= 0 and sizes <= n < 1 << 28 and flag < 1 << 12):
        return None
    name = data[at + 36 : at + 36 + l_name]
    if len(name) == l_name and (name[-1] or any(not 33 <= c <= 126 for c in name[:-1])):
        return None
    return at + 4 + n


def _first_record(data: bytes, n_ref: int, whole: bool) -> int | None:
    """The first place from which records follow one another: eight, or three at least as far as the bytes go, or those up to the end of the file (whole)."""
    for at in range(len(data)):
        x, k = at, 0
        while k < 8 and x is not None and x + 36 <= len(data):
            x, k = _record_end(data, x, n_ref), k + 1
        if x is not None and (k == 8 or k >= 3 and x + 36 > len(data) or whole and k and x == len(data)):
            return at
    return None


def _head(stream: _Stream, lengths: list[int] | None = None) -> list[str]:
    """The names of the chromosomes (lengths takes their lengths); the stream is then at the first record."""
    if stream.take(4) != b"BAM\1":
        raise ValueError("not a BAM file")
    stream.take(struct.unpack("<i", stream.take(4))[0])
    chroms = []
    for _ in range(struct.unpack("<i", stream.take(4))[0]):
        chroms.append(stream.take(struct.unpack("<i", stream.take(4))[0])[:-1].decode())
        (length,) = struct.unpack("<i", stream.take(4))
        if lengths is not None:
            lengths.append(length)
    return chroms


def decode_split(file, begin: int, end: int, size: int):
    """Rows of SCHEMA of the records that begin in the blocks from begin up to end of a BAM file, whatever blocks they go on in."""
    stream = _Stream(file, 0, size)
    if _block_size(stream._bytes(0, 18)) is None:  # no blocks to split at: the first split reads all
        if begin > 0:
            return
        end = size + 1
    chroms = _head(stream)
    if begin > 0:
        stream = _Stream(file, _first_block(file, begin, size), size)
        if stream.at >= min(end, size):
            return
        place = None
        while place is None:
            if not stream.more():
                place = _first_record(bytes(stream.held), len(chroms), True)
                if place is None:
                    return  # the end of a record that began before, and nothing after it
                break
            if len(stream.held) >= 1 << 18 or stream.at >= size:
                place = _first_record(bytes(stream.held), len(chroms), stream.at >= size)
        stream.take(place)
    while stream.block() < end and len(head := stream.take(4)) == 4:
        yield _record(stream.take(struct.unpack("<i", head)[0]), chroms)


def decode_bam(data: bytes):
    """Rows of SCHEMA from a whole BAM file's bytes."""
    yield from decode_split(io.BytesIO(data), 0, len(data) + 1, len(data))


def _uri(path: str) -> str:
    """A path as pyarrow names it."""
    uri = re.sub(r"^s3[an]:", "s3:", re.sub(r"^file:/+", "file:///", path))
    return uri if re.match(r"^\w+:/", uri) else f"file://{uri}"


def _open(uri: str):
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(_uri(uri))
    return store.open_input_file(path)


def _batches(rows):
    held = []
    for row in rows:
        held.append(row)
        if len(held) == 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), _TYPES)], names=_NAMES)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), _TYPES)], names=_NAMES)


def read_bam(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """BAM files in splits of split_bytes, each a task that reads its own range of the file.

    A split owns the records that begin in its blocks; where the first begins is
    found by what a record must look like, eight in a row. The stores are those
    of pyarrow (file, hdfs, s3, gs, abfs); a file in another store is read whole
    by Spark, by one task.
    """
    files = spark.read.format("binaryFile").load(path)
    known = F.col("path").rlike("^(file|hdfs|viewfs|s3|s3a|s3n|gs|abfs|abfss):")
    step = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(split_bytes).cast("long"))
    splits = files.where(known).select("path", "length", F.explode(step).alias("begin"))
    n = files.where(known).agg(F.sum(F.size(step))).first()[0] or 1

    def run(batches):
        for batch in batches:
            for uri, size, begin in zip(*(batch.column(c).to_pylist() for c in ("path", "length", "begin"))):
                with _open(uri) as file:
                    yield from _batches(decode_split(file, begin, begin + split_bytes, size))

    def whole(batches):
        for batch in batches:
            for content in batch.column("content"):
                yield from _batches(decode_bam(content.as_py()))

    out = splits.repartition(min(n, 100_000), "path", "begin").mapInArrow(run, SCHEMA)
    rest = files.where(~known)
    return out if rest.isEmpty() else out.union(rest.select("content").mapInArrow(whole, SCHEMA))


def fetch(reads: DataFrame, regions: DataFrame) -> DataFrame:
    """Reads that overlap a region."""
    from circlet.operators.intervals import overlap_join

    return overlap_join(reads, regions, how="left_semi")
