"""A de novo run and a targeted search on a made-up ring, and kernels of the later operators."""

import dataclasses
import re
import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from circlet import cli
from circlet.operators import boundaries, graph, segmentation, splitreads
from circlet.plans import run
from circlet.sources import tables
from circlet.sources.alignments import SCHEMA

LEFT, RIGHT = ("".join(np.random.default_rng(k).choice(list("ACGT"), 50)) for k in (1, 2))  # no short repeats, which the filter of pairs takes out
PAIRS = "chrom1 string, coord1 long, clip1 string, chrom2 string, coord2 long, clip2 string, n long, rids array<long>"


@pytest.fixture(scope="module")
def ring(spark):
    """chr1 400000-700000 at ten copies, its ends joined by split reads."""
    rng = np.random.default_rng(0)
    rows = []

    def read(name, start, cigar="100M", sa=None, flag=0, seq="A" * 100):
        span = sum(int(x) for x in re.findall("([0-9]+)M", cigar))
        rows.append((name, flag, "chr1", int(start), int(start) + span, 60, cigar, None, -1, 0, seq, 0, sa, "cell1"))

    for b in range(0, 2_000_000, 10_000):
        for i in range(int(rng.poisson(60 if 400_000 <= b < 700_000 else 6))):
            read(f"r{b}_{i}", b + rng.integers(0, 9_900))
    for i in range(8):
        read(f"s{i}", 699_950, "50M50S", "chr1,400001,+,50S50M,60,0;", seq=LEFT)
        read(f"s{i}", 400_000, "50S50M", "chr1,699951,+,50M50S,60,0;", 2048, RIGHT)
    return spark.createDataFrame(rows, SCHEMA).withColumn("dup", F.lit(False))


def test_de_novo(spark, ring, tmp_path):
    found = run.de_novo(ring, str(tmp_path))
    amp = found["amplified"].collect()
    assert any(abs(r.start - 400_000) <= 20_000 and abs(r.stop - 700_000) <= 20_000 for r in amp)
    (pair,) = found["pairs"].collect()
    assert (pair.coord1, pair.clip1, pair.coord2, pair.clip2, pair.n, pair.offset) == (400_000, "L", 699_999, "R", 8, 0)
    assert pair.seq == LEFT + RIGHT and pair.source == "split"
    rings = found["rings"].collect()
    assert [(r.start, r.stop) for r in rings] == [(400_000, 699_999)] and found["scores"].first().score > 0
    assert found["picked"].first().role == "chosen" and found["stats"].first().rings == 1


GENOME = {c: "".join(np.random.default_rng(10 + i).choice(list("ACGT"), 2_000_000)) for i, c in enumerate(("chr1", "chr2", "chr3"))}
DEEP = {"chr1": (400_000, 700_000), "chr2": (1_000_000, 1_300_000), "chr3": (200_000, 400_000)}
LISTED = [("chr3", 150_000, 450_000)]


def planted_rows():
    """A ring of chr1 400000-700000 and chr2 1000000-1300000 at ten copies over a random genome. Split reads join them at one side; clips on both ends, which no second alignment explains, at the other, and read pairs at both. A listed region of chr3 is as deep."""
    rng = np.random.default_rng(1)
    rows = []

    def read(name, chrom, start, cigar="100M", sa=None, flag=0, seq=None, mate=None, tlen=0):
        span = sum(int(x) for x in re.findall("([0-9]+)M", cigar))
        rows.append((name, flag, chrom, int(start), int(start) + span, 60, cigar, mate and mate[0], mate[1] if mate else -1, tlen, seq or GENOME[chrom][int(start) : int(start) + 100], 0, sa, "cell1"))

    for chrom, (a, b) in DEEP.items():
        for at in range(0, 2_000_000, 10_000):
            for i in range(int(rng.poisson(60 if a <= at < b else 6))):
                read(f"r{chrom}{at}_{i}", chrom, at + rng.integers(0, 9_900))
    one, two = GENOME["chr1"], GENOME["chr2"]
    for i in range(9):  # the end of chr1's segment goes on at the start of chr2's
        read(f"s{i}", "chr1", 699_950, "50M50S", "chr2,1000001,+,50S50M,60,0;", seq=one[699_950:700_000])
        read(f"s{i}", "chr2", 1_000_000, "50S50M", "chr1,699951,+,50M50S,60,0;", 2048, two[1_000_000:1_000_050])
    for i in range(7):  # the end of chr2's segment and the start of chr1's
        read(f"c{i}", "chr1", 400_000, "40S60M", seq=two[1_299_960:1_300_000] + one[400_000:400_060])
        read(f"d{i}", "chr2", 1_299_940, "60M40S", seq=two[1_299_940:1_300_000] + one[400_000:400_040])
        x, y = 1_299_700 + 10 * i, 400_020 + 10 * i
        read(f"p{i}", "chr2", x, flag=1 + 32 + 64, mate=("chr1", y))
        read(f"p{i}", "chr1", y, flag=1 + 16 + 128, mate=("chr2", x))
    for i in range(50):  # sound pairs with inserts of 290 to 310
        read(f"i{i}", "chr3", 1_000_000 + 200 * i, flag=1 + 2 + 32 + 64, mate=("chr3", 1_000_200 + 200 * i), tlen=290 + i % 21)
    return rows


@pytest.fixture(scope="module")
def planted(spark):
    return spark.createDataFrame(planted_rows(), SCHEMA).withColumn("dup", F.lit(False))


def spans(df):
    return sorted((r.chrom, r.start, r.stop) for r in df.collect())


PARAMETERS = run.Parameters(edge_gap=1000, snap=600)
RING = [("chr1", 400_000, 699_999), ("chr2", 1_000_000, 1_299_999)]


@pytest.fixture(scope="module")
def found(spark, planted, tmp_path_factory):
    listed = spark.createDataFrame(LISTED, "chrom string, start long, stop long")
    genes = spark.createDataFrame([("chr1", 500_000, 510_000, "g1"), ("chr2", 1_100_000, 1_110_000, "g2")], "chrom string, start long, stop long, name string")
    at = str(tmp_path_factory.mktemp("run"))
    return at, listed, genes, run.de_novo(planted, at, PARAMETERS, listed=listed, genes=genes)


def test_planted_ring_is_found(found):
    out = found[3]
    assert spans(out["amplified"]) == RING  # not the listed region; ends are where the clips are
    (edge,) = out["discordant"].collect()
    assert {(edge.chrom1, edge.clip1), (edge.chrom2, edge.clip2)} == {("chr1", "L"), ("chr2", "R")} and edge.support == 7
    pairs = {((r.chrom1, r.coord1, r.clip1), (r.chrom2, r.coord2, r.clip2)): r for r in out["pairs"].collect()}
    assert set(pairs) == {(("chr1", 699_999, "R"), ("chr2", 1_000_000, "L")), (("chr1", 400_000, "L"), ("chr2", 1_299_999, "R"))}
    split, seq = pairs[("chr1", 699_999, "R"), ("chr2", 1_000_000, "L")], pairs[("chr1", 400_000, "L"), ("chr2", 1_299_999, "R")]
    assert (split.n, split.offset, split.pe, split.source) == (9, 0, True, "split")  # each read once
    assert (seq.n, seq.offset, seq.pe, seq.source) == (21, 0, True, "split")  # seven clips at each end found by sequence, and seven read pairs
    assert {r.bc for r in split.reads} == {"cell1"}
    assert spans(out["rings"]) == RING and {r.truncated for r in out["rings"].collect()} == {False}
    (score,) = out["scores"].collect()
    assert score.segments == 2 and score.score >= 4 and score.genes_num == 2
    assert {r.genes for r in out["annotated"].collect()} == {"g1", "g2"}
    stats = out["stats"].first()
    assert (stats.rings, stats.pairs, stats.truncated) == (2, 2, 0)
    assert [r.role for r in out["picked"].collect()] == ["chosen"]


def test_stages_are_read_only_if_nothing_changed(spark, planted, found, tmp_path):
    first, listed, genes, out = found
    at = str(shutil.copytree(first, tmp_path / "copy"))
    made = lambda **kw: {r.step for r in run.de_novo(kw.pop("rows", planted), at, kw.pop("p", PARAMETERS), listed=kw.pop("listed", listed), genes=genes)["made"].collect()}
    assert {r.step for r in out["made"].collect()} >= {"reads", "bins", "called", "pairs", "rings", "scores"}
    assert made() == set()
    assert made(p=dataclasses.replace(PARAMETERS, least_score=3.0)) == {"scores", "picked", "annotated"}
    assert made(p=dataclasses.replace(PARAMETERS, least_score=3.0), rows=planted.repartition(3)) == set()  # the same rows in another order
    changed = made(p=dataclasses.replace(PARAMETERS, least_score=3.0), rows=planted.where("qname <> 's0'"))
    assert {"reads", "bins_raw", "junctions", "pairs", "rings", "scores"} <= changed


def without(spark, rows, tmp_path, **kw):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("dup", F.lit(False))
    return run.de_novo(df, str(tmp_path / "run"), kw.pop("p", PARAMETERS), **kw)


@pytest.mark.parametrize("gone", ["split reads", "pairs by sequence"])
def test_each_kind_of_evidence_is_needed(spark, tmp_path, monkeypatch, gone):
    """Without one of its junctions the ring doesn't close."""
    rows = planted_rows()
    if gone == "split reads":
        rows = [r for r in rows if not r[0].startswith("s")]
    else:  # neither clips matched by sequence nor read pairs
        rows = [r for r in rows if not r[0].startswith("p")]
        monkeypatch.setattr(run.pairing, "pairs_by_sequence", lambda sites, reads, known, **kw: spark.createDataFrame([], "chrom1 string, coord1 long, clip1 string, chrom2 string, coord2 long, clip2 string, n long, offset int, seq string, reads array<string>"))
    out = without(spark, rows, tmp_path, listed=spark.createDataFrame(LISTED, "chrom string, start long, stop long"))
    assert out["rings"].count() == 0
    assert out["lines"].count() > 0  # what is left is a line


@pytest.mark.parametrize("step", ["clean sites", "score floor", "interior"])
def test_each_filter_has_an_effect(planted, found, step):
    """On the stages of the first run, of which only those behind the filter are made again."""
    at, listed, genes, _ = found
    kw = {"clean sites": {"clean_share": 1.1}, "score floor": {"least_score": 1e9}, "interior": {"interior_share": 1.1}}[step]
    out = run.de_novo(planted, at, dataclasses.replace(PARAMETERS, **kw), listed=listed, genes=genes)
    assert "reads" not in {r.step for r in out["made"].collect()}
    if step == "score floor":
        assert out["rings"].count() == 2 and out["scores"].count() == 0
    elif step == "clean sites":
        assert out["sites"].count() == 0
        assert {r.source for r in out["pairs"].collect()} == {"split", "pe"}  # nothing is found by sequence
    else:
        assert out["segments"].count() == 0 and out["rings"].count() == 0


def test_targeted_run_falls_back_on_known_segments(spark, ring, tmp_path):
    known = spark.createDataFrame([("x", 1, "chr9", 100_000, 150_000, "+")], "ring string, idx int, chrom string, start long, stop long, strand string")
    found = run.targeted_amplicons(known, ring, str(tmp_path))
    assert [(r.chrom, r.start, r.stop, r.cn) for r in found["segments"].collect()] == [("chr9", 100_000, 150_000, 2.0)]
    assert [(r.circle, r.detected) for r in found["concordance"].collect()] == [("x", False)]


def test_targeted(spark, ring):
    known = spark.createDataFrame([("k", 1, "chr1", 400_050, 699_950, "+"), ("x", 1, "chr1", 100_000, 150_000, "+")], "ring string, idx int, chrom string, start long, stop long, strand string")
    got = {r.circle: (r.jcs, r.detected) for r in run.targeted(known, ring).collect()}
    assert got == {"k": (1.0, True), "x": (0.0, False)}


def test_command_line(spark, ring, tmp_path):
    ring.drop("dup").write.parquet(str(tmp_path / "reads"))
    (tmp_path / "genes.bed").write_text("chr1\t500000\t510000\tg1\n")
    (tmp_path / "known.tsv").write_text("AmpliconID\tChrom\tStart\tEnd\tStrand\nk\tchr1\t400050\t699950\t+\n")
    (tmp_path / "regions.bed").write_text("chr1\t390000\t710000\n")
    cli.main(["denovo", "--input", str(tmp_path / "reads"), "--output", str(tmp_path / "out"), "--genes", str(tmp_path / "genes.bed"), "--least-score", "0"])
    picture = next((tmp_path / "out" / "alignments").glob("*.txt")).read_text().splitlines()
    assert picture[0] == ">chr1\t400000\tL\tchr1\t699999\tR" and len(picture) == 2 + 16 + 1 and picture[-1] == ""  # both alignments of eight reads
    track = "".join(f.read_text() for f in sorted((tmp_path / "out" / "clips.bedgraph").glob("*.csv"))).splitlines()
    assert track == ["chr1\t400000\t400001\t-8", "chr1\t699999\t700000\t8"]
    assert "g1" in (next((tmp_path / "out" / "annotated").glob("*.csv"))).read_text()
    for command, table in (("search", "concordance"), ("extract", "junctions"), ("evidence", "evidence"), ("classify", "concordance")):
        cli.main([command, "--input", f"{tmp_path / 'reads'}", "--known", str(tmp_path / "known.tsv"), "--output", str(tmp_path / command)])
        text = next((tmp_path / command / table).glob("*.csv")).read_text().splitlines()
        assert len(text) == 2 and (table != "concordance" or text[1].startswith("k\t"))


def test_region_option(spark, ring, tmp_path):
    ring.drop("dup").write.parquet(str(tmp_path / "reads.parquet"))
    (tmp_path / "regions.bed").write_text("chr1\t699990\t700000\n")
    got = cli.read_alignments(spark, str(tmp_path / "reads.parquet"), str(tmp_path / "regions.bed"))
    assert got.count() == ring.where("start < 700000 and stop > 699990").count() > 0


def test_overlap_and_gap_of_split_reads(spark):
    rows = [
        ("o", "a", 0, 60, False, "60M40S", "A" * 60, None), ("o", "b", 500, 550, False, "50S50M", "C" * 50, None),
        ("g", "a", 0, 40, False, "40M60S", "A" * 40, None), ("g", "b", 500, 550, True, "50M50S", "C" * 50, None),
        ("n", "a", 0, 40, False, "40M", "A" * 40, None),
    ]
    df = spark.createDataFrame(rows, "qname string, chrom string, start long, stop long, reverse boolean, cigar string, seq string, bc string")
    got = {r.qname: r for r in splitreads.split_junctions(df).collect()}
    assert set(got) == {"o", "g"}
    assert got["o"].offset == 10 and got["o"].seq == "A" * 60 + "C" * 40 and (got["o"].a.coord, got["o"].a.clip, got["o"].b.coord, got["o"].b.clip) == (59, "R", 500, "L")
    assert got["g"].offset == -10 and got["g"].seq == "A" * 40 + "-" * 10 + "G" * 50 and (got["g"].b.coord, got["g"].b.clip) == (549, "R")


def test_merge_close_pairs(spark):
    rows = [("a", 1, "L", "b", x, "R", n, [x]) for x, n in ((100, 5), (190, 2), (370, 1), (1000, 1), (1050, 4))]
    got = splitreads.merge_close_pairs(spark.createDataFrame(rows, PAIRS), reach=100).orderBy("coord2").collect()
    assert [(r.coord2, r.n, r.rids) for r in got] == [(100, 7, [100, 190]), (370, 1, [370]), (1050, 5, [1050, 1000])]


def test_rings_that_stand_for_others():
    # of length 4 the best has rank 1; [1, 2, 3, 5] shares three quarters of its nodes with it and goes, [1, 2, 7, 8] stays for the next turn
    ranked = [([1, 2, 3, 5], 2, False), ([1, 2, 3, 4], 1, False), ([6, 9], 1, False), ([1, 2, 7, 8], 3, False), ([1, 2, 3, 4, 10, 11], 1, False)]
    assert graph.standing_for(ranked) == [[6, 9], [1, 2, 3, 4], [1, 2, 3, 4, 10, 11], [1, 2, 7, 8]]
    assert graph.standing_for([(p, r, r == 2) for p, r, _ in ranked]) == [[6, 9], [1, 2, 3, 4], [1, 2, 3, 5], [1, 2, 3, 4, 10, 11], [1, 2, 7, 8]]  # at home: taken in the first turn
    assert graph.standing_for([]) == []
    assert graph.disjoint_lines([([1, 2, 3, 4], 1.0), ([3, 4, 5, 6], 2.0), ([7, 8], 1.0)]) == [[3, 4, 5, 6], [7, 8]]


def test_representatives_compete(spark):
    """Two rings over the same four vertices: placed before unplaced, then the better supported; both if they are on one chromosome; and whether the search was cut goes with them."""
    paths = spark.createDataFrame([(1, "ring", [1, 2, 3, 4], True), (1, "ring", [1, 2, 4, 3], True)], "component long, kind string, path array<long>, truncated boolean")
    edges = spark.createDataFrame([(1, 2, "inner", 9.0), (3, 4, "inner", 9.0), (2, 3, "outer", 5.0), (1, 4, "outer", 1.0), (2, 4, "outer", 4.0), (1, 3, "outer", 4.0)], "a long, b long, kind string, weight double")
    for chroms, want in ((["chr1", "chr2"], {(1, 2, 4, 3)}), (["chr1", "chr1"], {(1, 2, 3, 4), (1, 2, 4, 3)}), (["chrUn_1", "chrUn_1"], {(1, 2, 3, 4), (1, 2, 4, 3)})):
        v = spark.createDataFrame([(i, chroms[i > 2], i * 10, "L") for i in range(1, 5)], "id long, chrom string, coord long, clip string")
        got = graph.representatives(paths, edges, v).collect()
        assert {tuple(r.path) for r in got} == want and all(r.truncated for r in got)


def test_rescue_takes_no_overlap(spark):
    ends = spark.createDataFrame([("c", "L", 100, 9), ("c", "L", 150, 5), ("c", "R", 300, 4), ("c", "R", 500, 4)], "chrom string, clip string, coord long, support long")
    none = spark.createDataFrame([], "chrom string, start long, stop long")
    bins = spark.createDataFrame([("c", x, 8.0) for x in range(100, 500, 50)], "chrom string, coord long, cn double")
    assert [(r.start, r.stop) for r in boundaries.rescue_segments(ends, none, bins).collect()] == [(100, 300)]


def test_rows_of_plots(spark):
    df = spark.createDataFrame([("c", 0, 10, "a"), ("c", 5, 15, "b"), ("c", 10, 20, "d")], "chrom string, start long, stop long, name string")
    assert {r.name: r.row for r in boundaries.pack_rows(df).collect()} == {"a": 0, "b": 1, "d": 0}


def test_new_circles(spark):
    schema = "ring string, idx int, chrom string, start long, stop long, strand string"
    a = spark.createDataFrame([("x", 1, "c", 1, 2, "+"), ("y", 1, "c", 1, 3, "+")], schema)
    assert {r.ring for r in graph.new_circles(a, a.where("ring = 'x'")).collect()} == {"y"}


@pytest.mark.parametrize(
    "held, want",
    [
        ({5: 10}, None),  # ten pairs are too few to say
        ({1: 3000, 2: 300, 3: 60, 4: 20, 7: 9, 30: 5}, 5.0),  # the tail begins behind 4, whose 20 pairs are under a hundredth of all up to 7: 7; fewer than 300 pairs of at most 5,000 are left: no more than 5
        ({1: 6000, 2: 600, 3: 120, 4: 40, 7: 18, 30: 10}, 7.0),  # the same among more pairs, for which there is no such limit
        ({1: 2000, 2: 50}, 3.0),  # two kinds have no tail: the first; 300 pairs and more are left of over 1,000: no less than 3
        ({1: 12_000, 2: 50}, 20.0),  # over 1,000 are left of over 10,000: no less than 20
        ({1: 40_000, 50: 1500}, 50.0),  # over 30,000 are left: as many as the 1,200th has
        ({4: 12}, 4.0),  # one kind alone
    ],
)
def test_support_threshold(spark, held, want):
    rows = spark.createDataFrame(list(held.items()), "n int, k int").selectExpr("n", "explode(sequence(1, k))").select("n")
    got = segmentation.support_threshold(rows)
    assert got is None if want is None else got == pytest.approx(want, rel=2e-3)


def test_structures(spark, tmp_path):
    (tmp_path / "h.tsv").write_text("AmpliconID\tChrom\tStart\tEnd\tStrand\na\tchr1\t1\t9\t+\na\tchr2\t2\t8\t-\n")
    (tmp_path / "n.tsv").write_text("chr1\t1\t9\t+\t0.5\ta\nchr2\t2\t8\t-\t0.5\ta\n")
    (tmp_path / "bad.tsv").write_text("chr1\t1\t9\n")
    for name in ("h.tsv", "n.tsv"):
        got = tables.read_structures(spark, str(tmp_path / name)).orderBy("idx").collect()
        assert [(r.AmpliconID, r.Chrom, r.Start, r.End, r.Strand) for r in got] == [("a", "chr1", 1, 9, "+"), ("a", "chr2", 2, 8, "-")]
    with pytest.raises(ValueError):
        tables.read_structures(spark, str(tmp_path / "bad.tsv"))
    assert tables.first_existing(spark, str(tmp_path / "no"), str(tmp_path / "h.tsv")) == str(tmp_path / "h.tsv")
