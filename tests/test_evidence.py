"""Evidence of reads for junctions: blocks, the cascade, and cells without any."""

import pytest
from pyspark.sql import functions as F

from circlet.operators import breakpoints, evidence

READS = "qname string, chrom string, start long, stop long, cigar string, nm int, sa string, cb string"


@pytest.mark.parametrize(
    "cigar, want",
    [
        ("100M", [(10, 110)]), ("5S10M", [(10, 20)]), ("10M5D10M", [(10, 20), (25, 35)]), ("10M100N10M5S", [(10, 20), (120, 130)]),
        ("10M3I10M", [(10, 20), (20, 30)]), ("4=1X5M", [(10, 20)]), ("*", []), ("10S", []), ("3H7M2D1I4M", [(10, 17), (19, 23)]),
    ],
)
def test_aligned_blocks(spark, cigar, want):
    row = spark.createDataFrame([(10, cigar)], "start long, cigar string").select(evidence.aligned_blocks(F.col("start"), F.col("cigar")).alias("x")).first()
    assert [tuple(r) for r in row.x] == want


def test_cascade(spark):
    junctions = spark.createDataFrame([("j", "c1", 1000, "R", "c2", 5000, "L")], "junction string, chrom1 string, coord1 long, clip1 string, chrom2 string, coord2 long, clip2 string")
    rows = [
        ("split", "c1", 921, 1001, "80M20S", 0, "c2,5001,+,80S20M,60,0;", "A"), ("split", "c2", 5000, 5020, "80H20M", 0, None, None),
        ("turned", "c1", 921, 1001, "80M20S", 0, "c2,4900,-,20M80S,60,0;", None),  # the second alignment stops near the other end
        ("far", "c1", 921, 1001, "80M20S", 0, "c2,9000,+,80S20M,60,0;", None), ("clip", "c2", 5003, 5083, "20S80M", 0, None, "B"),
        ("wrong side", "c1", 1000, 1080, "20S80M", 0, None, "B"), ("over", "c1", 950, 1050, "100M", 1, None, "B"), ("edits", "c1", 950, 1050, "100M", 2, None, "C"),
        ("gap", "c1", 930, 1070, "68M40D32M", 0, None, "C"), ("short", "c1", 997, 1097, "100M", 0, None, "C"),
    ]
    df = spark.createDataFrame(rows, READS)
    got = {r.qname: (r.kind, r.bc) for r in evidence.junction_evidence(df, junctions).collect()}
    assert got == {"split": ("split_SA", "A"), "turned": ("split_SA", None), "far": ("single_clip", None), "clip": ("single_clip", "B"), "over": ("normal_spanning", "B")}
    loose = {r.qname for r in evidence.junction_evidence(df, junctions, strict=False).collect()}
    assert loose == {*got, "edits"}
    matrix = {(r.junction, r.cell): (r.split_SA, r.single_clip, r.normal_spanning) for r in evidence.evidence_matrix(evidence.junction_evidence(df, junctions)).collect()}
    assert matrix == {("j", "A"): (1, 0, 0), ("j", "B"): (0, 1, 1)}


def test_cells_without_evidence_have_zeros(spark):
    spans = "ring string, seg long, chrom string, start long, stop long"
    segments = spark.createDataFrame([("r", 1, "c", 0, 100), ("s", 2, "d", 0, 100)], spans)
    frags = spark.createDataFrame([("x", "c", 10, 20, 3), ("y", "e", 10, 20, 1)], "cell string, chrom string, start long, stop long, n long")
    cells = frags.groupBy("cell").agg(F.sum("n").alias("total"))
    seen = spark.createDataFrame([("r", "x", "q", "split_SA"), ("r", "y", "p", "single_clip"), ("r", "y", "p", "normal_spanning")], "ring string, cell string, qname string, kind string")
    got = {(r.cell, r.ring): (r.direct, r.weak, r.rate > 0, r.covered, r.call) for r in evidence.assign_cells(frags, segments, segments.limit(0), cells, seen).collect()}
    assert got == {("x", "r"): (1, 0.0, True, 1.0, "high"), ("y", "r"): (0, 0.3, False, 0.0, "probable"), ("x", "s"): (0, 0.0, False, 0.0, "none"), ("y", "s"): (0, 0.0, False, 0.0, "none")}


PAIRS = "chrom1 string, coord1 long, clip1 string, chrom2 string, coord2 long, clip2 string, n long, offset int, seq string, pe boolean, source string, reads array<struct<rid:bigint,bc:string>>"


def test_merge_pairs(spark):
    first = spark.createDataFrame([("a", 1, "L", "b", 2, "R", 5, 3, "ACG", False, "split", [(1, None), (2, "None"), (2, "x")]), ("a", 1, "L", "b", 2, "R", 9, 4, "TTT", None, "split", [])], PAIRS)
    then = spark.createDataFrame([("b", 2, "R", "a", 1, "L", 100, 0, "", True, "pe", [(1, " y "), (2, "z"), (3, "")]), ("c", 1, "L", "c", 9, "R", 2, 0, "", True, "ds", []), ("c", 9, "R", "c", 1, "L", 4, 0, "", None, "ds", [])], PAIRS)
    got = {r.chrom1: r for r in breakpoints.merge_pairs(first, then).collect()}
    a, c = got["a"], got["c"]
    assert (a.n, a.offset, a.seq, a.pe, a.source, [tuple(r) for r in a.reads]) == (3, 4, "TTT", True, "split", [(1, "y"), (2, "x"), (3, None)])
    assert (c.coord1, c.n, c.pe, c.reads) == (1, 6, True, [])
    lists = breakpoints.merge_pairs(first, then).select("chrom1", breakpoints.barcodes_of(F.col("reads")).alias("b")).collect()
    assert {r.chrom1: r.b for r in lists} == {"a": ["y", "x", None], "c": []}
    assert breakpoints.merge_pairs(first.limit(0)).count() == 0


def test_paired_ends(spark):
    sites = spark.createDataFrame([("a", 1000, "R"), ("b", 5000, "L"), ("a", 1300, "L"), ("c", 10, "R")], "chrom string, coord long, clip string")
    rows = [("p", "a", 900, 1), ("p", "a", 950, 1), ("p", "b", 5100, 1), ("q", "b", 5100, 1), ("s", "a", 800, 3), ("s", "b", 5100, 3), ("r", "a", 1400, 1), ("r", "a", 700, 1), ("r", "a", 1500, 1)]
    reads = spark.createDataFrame([(q, c, at, at + 50, f, None) for q, c, at, f in rows], "qname string, chrom string, start long, stop long, flag int, cb string")
    (one,) = breakpoints.paired_ends(sites, reads).collect()  # p twice at its first site; s is a proper pair; the two sites of a are too close
    assert (one.chrom1, one.coord1, one.chrom2, one.coord2, one.n, len(one.reads)) == ("a", 1000, "b", 5000, 2, 1)
