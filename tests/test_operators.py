"""Small cases of operators beyond SQL."""

import gzip
import struct
import zlib

import itertools

import numpy as np
import pytest

from circlet.functions import text
from circlet.operators import bins, breakpoints, cells, copynumber, graph, intervals, reads, segmentation
from circlet.sources import alignments, sinks, tables
from pyspark.sql import functions as F


def test_empty_intervals_meet_nothing(spark):
    a = spark.createDataFrame([("c", 5, 5, 1), ("c", 0, 10, 2), ("d", 0, 10, 3)], "chrom string, start long, stop long, k int")
    b = spark.createDataFrame([("c", 4, 6), ("c", 10, 12)], "chrom string, start long, stop long")
    assert [r.k for r in intervals.overlap_join(a, b).collect()] == [2]
    assert sorted(r.k for r in intervals.clear_of(a, b, ["k"]).collect()) == [1, 3]


def test_long_interval_meets_once(spark):
    a = spark.createDataFrame([("c", 0, 9_000_000)], "chrom string, start long, stop long")
    assert intervals.overlap_join(a, a).count() == 1


@pytest.mark.parametrize("gap,n", [(199_999, 1), (200_000, 2)])
def test_merge_distance(spark, gap, n):
    a = spark.createDataFrame([("c", 0, 10), ("c", 10 + gap, 20 + gap)], "chrom string, start long, stop long")
    assert intervals.merge_bed(a).count() == n


def test_clips_of_both_ends(spark):
    df = spark.createDataFrame([("c", 10, 20, True, True), ("c", 1, 2, False, False)], "chrom string, start long, stop long, clip_l boolean, clip_r boolean")
    assert sorted((r.coord, r.clip) for r in reads.clip_sites(df).collect()) == [(10, "L"), (19, "R")]


def test_missing_edit_distance_counts_as_zero(spark):
    df = spark.createDataFrame([(30, None, False), (30, 4, False), (19, 0, False), (30, 0, True)], "mapq int, nm int, dup boolean")
    assert reads.passing(df).count() == 1


def test_interpolation(spark):
    df = spark.createDataFrame([("c", i, v) for i, v in enumerate([None, 1.0, None, None, 4.0, None])], "chrom string, coord long, n double")
    assert [r.filled for r in bins.fill_linear(df).orderBy("coord").collect()] == [None, 1.0, 2.0, 3.0, 4.0, 4.0]


def test_cbs_finds_a_step():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 0.2, 60), rng.normal(3, 0.2, 40), rng.normal(0, 0.2, 60)])
    cuts = [a for a, _ in segmentation.cbs(x)][1:]
    assert any(abs(c - 60) <= 2 for c in cuts) and any(abs(c - 100) <= 2 for c in cuts)
    assert segmentation.cbs(np.array([])) == [] and segmentation.cbs(np.ones(3)) == [(0, 3)]


def test_alternating_ring_and_line():
    ring = [(1, 2, "inner"), (2, 3, "outer"), (3, 4, "inner"), (1, 4, "outer")]
    assert graph.alternating_paths(ring) == ([("ring", [1, 2, 3, 4])], False)
    assert graph.alternating_paths(ring[:3]) == ([("line", [1, 2, 3, 4])], False)
    assert graph.alternating_paths([(1, 2, "inner"), (1, 2, "outer")]) == ([("ring", [1, 2])], False)


def plain_paths(edges):
    """All alternating rings and longest lines, by trying every order of nodes."""
    has = {(a, b, k) for a, b, k in edges} | {(b, a, k) for a, b, k in edges}
    nodes = sorted({x for a, b, _ in edges for x in (a, b)})
    out = lambda x, path: any((x, y, "outer") in has for y in nodes if y not in path)
    rings, lines = set(), set()
    for n in range(2, len(nodes) + 1, 2):
        for p in itertools.permutations(nodes, n):
            if all((a, b, "outer" if i % 2 else "inner") in has for i, (a, b) in enumerate(itertools.pairwise(p))):
                if (p[-1], p[0], "outer") in has:
                    if p[0] == min(p):
                        rings.add(min(p, (p[0], *reversed(p[1:]))))
                elif p[0] < p[-1] and not out(p[0], p) and not out(p[-1], p):
                    lines.add(p)
    return [("ring", list(x)) for x in sorted(rings)] + [("line", list(x)) for x in sorted(lines)]


def test_paths_equal_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(150):
        n = int(rng.integers(2, 7))
        edges = [(a, b, k) for a in range(n) for b in range(a + 1, n) for k in ("inner", "outer") if rng.random() < 0.4]
        assert graph.alternating_paths(edges) == (plain_paths(edges), False), edges


def test_dense_graphs_end_and_say_so():
    edges = [(a, b, k) for a in range(60) for b in range(a + 1, 60) for k in ("inner", "outer")]
    found, cut = graph.alternating_paths(edges, max_steps=200_000)
    assert cut and found and all(len(set(p)) == len(p) for _, p in found)
    chain = [(i, i + 1, "outer" if i % 2 else "inner") for i in range(400)]
    assert graph.alternating_paths(chain, max_nodes=200)[1]


@pytest.mark.parametrize("kind", ["long", "string"])
def test_components_of_long_chains(spark, kind):
    ids = np.random.default_rng(1).permutation(400).tolist()
    name = (lambda i: f"r{i:03d}") if kind == "string" else int
    links = [(name(a), name(b)) for a, b in zip(ids[:199], ids[1:200])] + [(name(a), name(b)) for a, b in zip(ids[200:399], ids[201:])]
    got = {r.node: r.component for r in graph.label_components(spark.createDataFrame(links, f"a {kind}, b {kind}")).collect()}
    want = {name(i): name(min(part)) for part in (ids[:200], ids[200:]) for i in part}
    assert got == want


def test_depth_equals_counting(spark):
    rng = np.random.default_rng(3)
    reads_ = [("a", int(s), int(s) + int(rng.integers(0, 300))) for s in rng.integers(0, 3_000_000, 400)] + [("a", 999_900, 1_000_100)] * 500 + [("b", 5, 4_000_000)]
    sites = [("a", int(x), c, 1) for x in rng.integers(0, 3_100_000, 200) for c in "LR"] + [("a", 1_000_000, "L", 9), ("a", 999_900, "L", 9), ("a", 1_000_100, "R", 9), ("b", 3_500_000, "L", 1), ("c", 1, "L", 1)]
    got = {(r.chrom, r.coord, r.clip): r.inside for r in reads.depth_at(spark.createDataFrame(sites, "chrom string, coord long, clip string, n long"), spark.createDataFrame(reads_, "chrom string, start long, stop long")).collect()}
    assert got == {(c, x, k): sum(a <= x < b for d, a, b in reads_ if d == c) for c, x, k, _ in sites}


def test_overlap_threshold_is_a_filter(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(120):
        a, n = int(rng.integers(0, 400)), int(rng.integers(900, 1000))
        rows += [(f"r{i:03d}", "c", 10 * a, 10 * a + n), (f"r{i:03d}", "c", 50_000, 50_000 + n)]
    rings = spark.createDataFrame(rows + [("one", "d", 5, 5)], "ring string, chrom string, start long, stop long")
    every = intervals.reciprocal_overlap(rings).where("overlap > 0.95").collect()
    assert every and sorted(map(tuple, every)) == sorted(map(tuple, intervals.reciprocal_overlap(rings, 0.95).collect()))


def test_ring_choice_is_not_transitive(spark):
    scores = spark.createDataFrame([("a", 3.0), ("b", 2.0), ("c", 1.0), ("d", 0.5)], "ring string, score double")
    over = spark.createDataFrame([("a", "b", 0.99), ("b", "c", 0.99)], "ring string, other string, overlap double")
    assert {r.ring: r.chosen for r in graph.pick_rings(scores, over).collect()} == {"a": "a", "b": "a", "c": "c", "d": "d"}


def test_ambiguous_snap_stays(spark):
    schema = "chrom1 string, coord1 long, clip1 string, chrom2 string, coord2 long, clip2 string, "
    edge = spark.createDataFrame([("a", 100, "L", "b", 100, "R", 5)], schema + "support long")
    one = [("a", 150, "L", "b", 90, "R", 3), ("b", 110, "R", "a", 80, "L", 3)]
    out = breakpoints.snap_two_ended(edge, spark.createDataFrame(one, schema + "n long")).first()
    assert not out.snapped and out.to1 == 100
    out = breakpoints.snap_two_ended(edge, spark.createDataFrame([one[0], one[1][:6] + (4,)], schema + "n long")).first()
    assert out.snapped and (out.to1, out.to2) == (80, 110)


def test_concordance_threshold(spark):
    refs = spark.createDataFrame([("x", 1), ("x", 2)], "circle string, junction int")
    out = cells.concordance(refs, spark.createDataFrame([("x", 1, 5), ("x", 2, 4)], "circle string, junction int, n int")).first()
    assert out.jcs == 0.5 and out.detected and out.support == 5


def test_negative_binomial_recovers(spark):
    rng = np.random.default_rng(1)
    gc = rng.uniform(0, 1, 400)
    rows = [("c", i, float(g), int(rng.poisson(np.exp(2 + 1.5 * g)))) for i, g in enumerate(gc)]
    beta = copynumber.fit_negative_binomial(spark.createDataFrame(rows, "chrom string, coord long, gc double, n long"), ["gc"], alpha=0.0)
    assert abs(beta[0] - 2) < 0.1 and abs(beta[1] - 1.5) < 0.15


def test_sequence_functions(spark):
    df = spark.createDataFrame([("ACGTxn", "5S10M2D3I4N6H", "chr1,11,+,5M,60,0;bad,1;")], "s string, c string, t string")
    r = df.select(text.reverse_complement(F.col("s")).alias("rc"), text.cigar_length(F.col("c")).alias("n"), text.cigar_clip(F.col("c")).alias("side"), text.parse_sa(F.col("t")).alias("sa"), text.repeat_share(F.lit("ababab")).alias("rep")).first()
    assert r.rc == "nNACGT" and r.n == 16 and r.side == "R" and [x.pos for x in r.sa] == [10] and r.rep == 1.0


def test_semi_global_distance(spark):
    df = spark.createDataFrame([("abc", "abcdef"), ("abc", "xabc"), ("", "x"), ("abc", "")], "a string, b string")
    assert [round(r[0], 3) for r in df.select(text.semi_global_distance("a", "b")).collect()] == [0.0, 0.333, 0.0, 1.0]


def _bam() -> bytes:
    name, cigar, seq = b"r1\0", struct.pack("<2I", (3 << 4) | 4, (5 << 4) | 0), bytes([0x12, 0x48, 0x12, 0x48])
    tags = b"NMC\x02" + b"CBZcell\0" + b"SAZchr1,9,+,3S5M,60,0;\0"
    body = struct.pack("<iiBBHHHiiii", 0, 100, len(name), 60, 0, 2, 99, 8, 0, 300, 208) + name + cigar + seq + b"\xff" * 8 + tags
    raw = b"BAM\1" + struct.pack("<i", 0) + struct.pack("<i", 1) + struct.pack("<i", 5) + b"chr1\0" + struct.pack("<i", 1000) + struct.pack("<i", len(body)) + body
    return gzip.compress(raw[:40]) + gzip.compress(raw[40:])


def test_bam(spark, tmp_path):
    (tmp_path / "x.bam").write_bytes(_bam())
    r = alignments.read_bam(spark, str(tmp_path / "x.bam")).first()
    assert (r.qname, r.chrom, r.start, r.stop, r.cigar, r.nm, r.cb, r.seq) == ("r1", "chr1", 100, 105, "3S5M", 2, "cell", "ACGTACGT")


def _blocked(raw: bytes, cuts: list[int]) -> bytes:
    """A blocked gzip file of raw, cut at places, with the empty block that ends it."""
    out = b""
    for a, b in zip([0, *cuts], [*cuts, len(raw)]):
        for part in ([raw[a:b]] if b > a else []) + ([b""] if b == len(raw) else []):
            c = zlib.compressobj(6, zlib.DEFLATED, -15)
            data = c.compress(part) + c.flush()
            out += b"\x1f\x8b\x08\x04" + bytes(5) + b"\xff\x06\x00BC\x02\x00" + struct.pack("<H", len(data) + 25) + data + struct.pack("<II", zlib.crc32(part), len(part))
    return out


@pytest.mark.parametrize("split_bytes", [700, 5_000, 1 << 26])
def test_bam_splits_own_each_record_once(spark, tmp_path, split_bytes):
    rng = np.random.default_rng(5)
    chroms = [f"chr{i}" for i in range(1, 25)]
    head = b"@HD\tVN:1.6\n" * 40
    raw = b"BAM\1" + struct.pack("<i", len(head)) + head + struct.pack("<i", len(chroms)) + b"".join(struct.pack("<i", len(c) + 1) + c.encode() + b"\0" + struct.pack("<i", 10**8) for c in chroms)
    want = []
    for i in range(1500):
        n, name = int(rng.integers(1, 400)) if i % 300 else 20_000, f"read{i}:x".encode() + b"\0"
        pos, ref = int(rng.integers(0, 10**6)), int(rng.integers(-1, 24))
        body = struct.pack("<iiBBHHHiiii", ref, pos, len(name), 60, 0, 1, 99, n, -1, -1, 0) + name + struct.pack("<I", n << 4) + bytes(rng.integers(0, 256, (n + 1) // 2, dtype="u1")) + bytes(rng.integers(0, 40, n, dtype="u1"))
        raw += struct.pack("<i", len(body)) + body
        want.append((f"read{i}:x", None if ref < 0 else chroms[ref], pos, pos + n))
    (tmp_path / "x.bam").write_bytes(_blocked(raw, sorted(rng.choice(np.arange(1, len(raw)), 300, replace=False).tolist())))
    (tmp_path / "y.bam").write_bytes(_blocked(raw[: raw.index(struct.pack("<i", 24)) + 4 + sum(len(c) + 9 for c in chroms)], []))  # no records
    got = alignments.read_bam(spark, str(tmp_path), split_bytes)
    assert sorted((r.qname, r.chrom, r.start, r.stop) for r in got.collect()) == sorted(want, key=lambda x: (x[0], x[1] or ""))


def test_sam_and_fetch(spark, tmp_path):
    (tmp_path / "x.sam").write_text("@HD\tVN:1.6\nr1\t99\tchr1\t101\t60\t3S5M\t=\t301\t208\tACGTACGT\t*\tNM:i:2\tCB:Z:cell\nr2\t4\t*\t0\t0\t*\t*\t0\t0\tA\t*\n")
    df = alignments.read_sam(spark, str(tmp_path / "x.sam"))
    r = df.where("qname = 'r1'").first()
    assert (r.start, r.stop, r.mate_chrom, r.nm, r.cb) == (100, 105, "chr1", 2, "cell")
    region = spark.createDataFrame([("chr1", 104, 105)], "chrom string, start long, stop long")
    assert [x.qname for x in alignments.fetch(df, region).collect()] == ["r1"]


def test_tables(spark, tmp_path):
    (tmp_path / "a.bed").write_text("track x\nchr1 1 5 n\nchr2\t2\t9\n\nbad\n")
    assert [(r.chrom, r.start, r.stop) for r in tables.read_bed(spark, str(tmp_path / "a.bed")).collect()] == [("chr1", 1, 5), ("chr2", 2, 9)]
    (tmp_path / "f.tsv").write_text("# c\nchr1\t1\t9\tAA\t3\nchr1\t2\t9\tBB\nchr1\tx\t9\tCC\t1\n")
    assert sorted((r.barcode, r.n) for r in tables.read_fragments(spark, str(tmp_path / "f.tsv")).collect()) == [("AA", 3), ("BB", 1)]
    df = spark.createDataFrame([("['A', None, \"b\"]",)], "x string").select(tables.list_cell(F.col("x")).alias("x"))
    assert df.first().x == ["A", None, "b"]
    with pytest.raises(ValueError):
        tables.require_columns(df, ["y"])


def test_stage_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "x int, y string")
    assert sinks.read_stage(spark, sinks.write_stage(df, str(tmp_path / "s"))).collect() == df.collect()
    assert sinks.run_stats(a=df, b=df).first().asDict() == {"a": 1, "b": 1}
    sinks.write_table(df, str(tmp_path / "t"), single=True)
    assert tables.read_table(spark, str(tmp_path / "t"), "x int, y string").collect() == df.collect()


def test_stream_equals_batch(spark, tmp_path):
    from circlet.streaming import events

    df = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    df.repartition(2).write.parquet(str(tmp_path / "in"))
    q = events.windowed_counts(events.event_stream(spark, str(tmp_path / "in"), df.schema), late="1000 days").writeStream.format("memory").queryName("w").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(spark.table("w").collect()) == sorted(events.windowed_counts(df).collect())
