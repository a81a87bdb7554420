"""Region reads by index: equal to a full scan, and only the region's chunks are read."""

import struct
import zlib

import numpy as np
import pytest

from circlet.sources import alignments, bam_index

CHROMS = [("chr1", 40_000_000), ("chr2", 5_000_000), ("chr3", 1_000)]


def reg2bin(start, stop):
    """The smallest bin that holds a read, as the format defines it."""
    stop -= 1
    for bits, first in ((14, 4681), (17, 585), (20, 73), (23, 9), (26, 1)):
        if start >> bits == stop >> bits:
            return first + (start >> bits)
    return 0


def record(name, ref, pos, span):
    label = name.encode() + b"\0"
    body = struct.pack("<iiBBHHHiiii", ref, pos, len(label), 60, reg2bin(pos, pos + span), 1, 99, 4, -1, -1, 0) + label + struct.pack("<I", span << 4) + bytes(2) + bytes(4)
    return struct.pack("<i", len(body)) + body


def block(part):
    c = zlib.compressobj(1, zlib.DEFLATED, -15)
    data = c.compress(part) + c.flush()
    return b"\x1f\x8b\x08\x04" + bytes(5) + b"\xff\x06\x00BC\x02\x00" + struct.pack("<H", len(data) + 25) + data + struct.pack("<II", zlib.crc32(part), len(part))


def write(path, reads, block_bytes):
    """A sorted BAM file of reads (name, ref, pos, span), whose records go on over blocks, and its index."""
    head = b"BAM\1" + struct.pack("<i", 0) + struct.pack("<i", len(CHROMS)) + b"".join(struct.pack("<i", len(c) + 1) + c.encode() + b"\0" + struct.pack("<i", n) for c, n in CHROMS)
    raw, begins = head, []
    for r in reads:
        begins.append(len(raw))
        raw += record(*r)
    out, starts = b"", []
    for at in range(0, len(raw), block_bytes):
        starts.append(len(out))
        out += block(raw[at : at + block_bytes])
    starts.append(len(out))
    out += block(b"")
    virtual = lambda at: starts[at // block_bytes] << 16 | at % block_bytes
    bins, linear = [{} for _ in CHROMS], [{} for _ in CHROMS]
    for (_, ref, pos, span), begin, end in zip(reads, begins, [*begins[1:], len(raw)]):
        if ref < 0:
            continue
        chunks = bins[ref].setdefault(reg2bin(pos, pos + span), [])
        a, b = virtual(begin), virtual(end)
        if chunks and chunks[-1][1] == a:
            chunks[-1] = chunks[-1][0], b
        else:
            chunks.append((a, b))
        for w in range(pos >> 14, (pos + span - 1 >> 14) + 1):
            linear[ref].setdefault(w, a)
    index = b"BAI\1" + struct.pack("<i", len(CHROMS))
    for chunks, first in zip(bins, linear):
        index += struct.pack("<i", len(chunks) + 1) + struct.pack("<Ii", bam_index.NO_BIN, 2) + struct.pack("<4Q", 0, 9, 0, 9)
        for b, cs in chunks.items():
            index += struct.pack("<Ii", b, len(cs)) + b"".join(struct.pack("<QQ", *c) for c in cs)
        n, last = max(first, default=-1) + 1, 0
        index += struct.pack("<i", n)
        for w in range(n):
            last = first.get(w, last)
            index += struct.pack("<Q", last)
    path.write_bytes(out)
    path.with_name(path.name + ".bai").write_bytes(index)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at, rng = tmp_path_factory.mktemp("bam"), np.random.default_rng(3)
    for name, n, block_bytes in (("a", 20_000, 60_000), ("b", 3_000, 700)):
        rows = [(int(rng.integers(0, 2)), 0) for _ in range(n)]
        rows = sorted((ref, int(rng.integers(0, CHROMS[ref][1] - 400))) for ref, _ in rows)
        reads = [(f"{name}{i}", ref, pos, int(rng.integers(1, 300)) if i % 500 else 399 + 20_000 * (ref == 0 and pos < 39_000_000)) for i, (ref, pos) in enumerate(rows)]
        write(at / f"{name}.bam", [*reads, (f"{name}-none", -1, -1, 0)], block_bytes)
    return at


REGIONS = [("chr1", 1_000_000, 1_000_500), ("chr1", 16_383, 16_385), ("chr2", -5, 40_000), ("chr2", 4_990_000, 9_000_000), ("chr3", 0, 1_000), ("chrX", 0, 10), ("chr1", 30_000_000, 30_000_000), ("chr1", 1_000_100, 1_200_000)]


def names(df):
    return sorted(r.qname for r in df.select("qname").collect())


def test_equals_a_full_scan(spark, folder):
    regions = spark.createDataFrame(REGIONS, "chrom string, start long, stop long")
    every = alignments.read_bam(spark, f"{folder}/*.bam")
    want = names(alignments.fetch(every, regions))
    assert len(want) > 100
    assert names(bam_index.fetch_indexed(spark, str(folder), regions)) == want
    assert names(bam_index.fetch_indexed(spark, str(folder), regions, split_bytes=2_000)) == want
    assert names(bam_index.fetch_indexed(spark, str(folder), regions.limit(0))) == []


def test_one_region_reads_its_chunks_alone(spark, folder):
    one = spark.createDataFrame([("chr1", 20_000_000, 20_001_000)], "chrom string, start long, stop long")
    chunks = bam_index.plan_chunks(spark, f"{folder}", one).collect()
    spans = {}
    for c in chunks:
        spans[c.path] = spans.get(c.path, 0) + (c.end >> 16) - (c.begin >> 16)
    size = {f"file:{p}": p.stat().st_size for p in folder.glob("*.bam")}
    assert set(spans) <= set(size) and all(spans[p] < 0.2 * size[p] for p in spans)

    class Counted:
        """A file that counts the bytes read from it."""

        def __init__(self, file):
            self.file, self.n = file, 0

        def seek(self, at):
            self.file.seek(at)

        def read(self, n):
            data = self.file.read(n)
            self.n += len(data)
            return data

    old, alignments.READ_BYTES = alignments.READ_BYTES, 4_096
    try:
        for path in size:
            with open(path[5:], "rb") as f:
                counted = Counted(f)
                for c in chunks:
                    if c.path == path:
                        list(bam_index.decode_chunk(counted, size[path], c.begin, c.end, [n for n, _ in CHROMS]))
                mine = [c for c in chunks if c.path == path]
                assert counted.n <= sum((c.end >> 16) - (c.begin >> 16) + 2 * 65_536 for c in mine) and counted.n < size[path] // 2
    finally:
        alignments.READ_BYTES = old


def test_index_as_a_table(spark, folder):
    rows = bam_index.read_index(spark, str(folder))
    assert {r.path.rsplit("/")[-1] for r in rows.select("path").distinct().collect()} == {"a.bam", "b.bam"}
    assert rows.where(f"bin >= {bam_index.NO_BIN}").count() == 0
    sizes = bam_index.read_sizes_of(spark, str(folder))
    assert {(r.chrom, r.length) for r in sizes.collect()} == set(CHROMS)
    with pytest.raises(ValueError):
        list(bam_index.parse_index(b"BAM\1"))


def test_data_source(spark, folder):
    bam_index.register(spark)
    every = alignments.read_bam(spark, f"{folder}/*.bam")
    for cond in ("chrom = 'chr1' and start < 1200000 and stop > 1000000", "chrom in ('chr2', 'chrX') and start >= 4990000", "chrom = 'chr1' and start = 16383", "chrom = 'chr1' and start < 5 and stop > 9", "chrom = 'chr1' and stop = 1200000", "chrom is null", "chrom = 'chr1' and stop <= 40000", "chrom = 'chr2' and chrom = 'chr1'"):
        assert names(spark.read.format("bam").load(str(folder)).where(cond)) == names(every.where(cond)), cond
    assert names(spark.read.format("bam").option("split_bytes", 9_000).load(str(folder / "a.bam"))) == names(every.where("qname like 'a%'"))


def test_pushed_filters_plan_fewer_bytes(folder):
    reader = bam_index.BamReader(str(folder), 1 << 26)
    whole = sum(min(p.end, p.size) - p.begin for p in reader.partitions())
    asked = bam_index.BamReader(str(folder), 1 << 26)
    filters = [bam_index.EqualTo(("chrom",), "chr1"), bam_index.LessThan(("start",), 20_001_000), bam_index.GreaterThan(("stop",), 20_000_000)]
    assert list(asked.pushFilters(filters)) == filters
    chunks = [c for p in asked.partitions() for c in p.chunks]
    assert chunks and sum((e >> 16) - (b >> 16) for b, e in chunks) < 0.1 * whole
