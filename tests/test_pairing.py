"""Pairs by sequence against plain Python: assembly, seeds, common parts, offsets and support, with errors, every orientation and offsets of both signs."""

import collections
import difflib
import itertools
import os
import random

import pytest

from circlet.functions.text import place_in
from circlet.operators import pairing, splitreads
from circlet.plans import more
from circlet.plans.adapters import load

SF = "/root/testdata/sf0.001"
TURN = str.maketrans("ACGT", "TGCA")


def rc(s):
    return "".join(c if c in "ACGT" else "N" for c in s)[::-1].translate(TURN)


def most(letters):
    n = collections.Counter(letters)
    return min(n, key=lambda c: (-n[c], c)) if n else "-"


def plain_assembly(reads, length):
    """(consensus of bases inside, consensus of clips), both from the break on, by site; reads: (coord, clip, cigar letters clipped, seq, start)."""
    clips, names = collections.defaultdict(list), collections.defaultdict(list)
    inside = {}
    for r in reads:
        n = int(r.cigar.split("S")[0]) if r.clip == "L" else int(r.cigar[:-1].split("M")[1])
        clip, bases = (r.seq[:n][::-1], r.seq[n:]) if r.clip == "L" else (r.seq[len(r.seq) - n :], r.seq[: len(r.seq) - n])
        clips[r.chrom, r.coord, r.clip].append(clip)
        names[r.chrom, r.coord, r.clip].append((r.qname, clip))
        for i, c in enumerate(bases):
            inside.setdefault((r.chrom, r.start + i), []).append(c)
    out = {}
    for (chrom, coord, side), cs in clips.items():
        step = 1 if side == "L" else -1
        body = "".join(most(inside.get((chrom, coord + step * k), [])) for k in range(length))
        out[chrom, coord, side] = body, "".join(most([c[k] for c in cs if len(c) > k]) for k in range(max(map(len, cs))))
    return out, names


def edits(x, y):
    last = list(range(len(y) + 1))
    for i, c in enumerate(x, 1):
        now = [i]
        for j, d in enumerate(y, 1):
            now.append(min(last[j] + 1, now[-1] + 1, last[j - 1] + (c != d)))
        last = now
    return min(last)


def plain_pairs(reads, length=50, seed=5, least=5, far=200):
    sites, clips = plain_assembly(reads, length)
    wide, _ = plain_assembly(reads, far)
    out = []
    form = {}
    for (chrom, coord, side), (body, clip) in sites.items():
        own = clip[::-1] + body if side == "L" else body[::-1] + clip
        form[chrom, coord, side] = own
    for x, y in itertools.combinations(sorted(sites), 2):
        kind = x[2] + y[2]
        a, b = (form[y], form[x]) if kind == "RL" else (form[x], form[y])
        a, b = (rc(a), b) if kind == "RR" else (a, rc(b)) if kind == "LL" else (a, b)
        word = b[length - seed : length + seed]
        if len(word) < 2 * seed or "-" in word or word not in a:
            continue
        m = difflib.SequenceMatcher(None, a, b, autojunk=False).find_longest_match(0, len(a), 0, len(b))
        if not (m.b <= length - least and m.b + m.size - 1 >= length + least):
            continue
        offset = len(a) - m.a - 2 * length + m.b
        support = []
        for one, other in ((x, y), (y, x)):
            seen = set()
            for name, clip in clips[one]:
                # outward letters of one end are the inner letters of the other, complemented if both are of one side
                read = clip.translate(TURN) if one[2] == other[2] else clip
                read, body = read[max(offset, 0) :], wide[other][0][max(-offset, 0) :]
                if len(clip) >= 2 and read and edits(read, body) <= 0.1 * len(read):
                    seen.add(name)
            support.append(seen)
        if support[0] and support[1]:
            seq = b[: m.b].lower() + b[m.b : m.b + m.size] + a[m.a + m.size :].lower()
            out.append((*x, *y, len(support[0]) + len(support[1]), offset, seq, len(support[0] | support[1])))
    return sorted(out)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_query_equals_plain_python(spark):
    genes = load(spark, SF, "genes")
    reads = more.junction_reads(genes).collect()
    got = sorted(tuple(r) for r in more.catalog_query("sequence_pairs")(spark, SF).collect())
    want = plain_pairs(reads)
    assert got == want
    found = {(r.gid, r.sides, r.o) for r in genes.selectExpr("gid", "element_at(array('LR','RL','LL','RR'), int(gid % 4) + 1) as sides", "int(gid % 7 - 3) as o").collect()}
    assert {(p[2] + p[5], p[7]) for p in got} == {(s, o) for _, s, o in found}  # every orientation with every offset
    assert 0.5 * len(found) < len(got) <= len(found)


def cross(spark, o=0, wrong=False, sides="LR"):
    """Two ends of made-up sequence with two clipped reads each; wrong: the clips of the second read on elsewhere."""
    body = {1: "ACGGTCATTGCAAGCTTGACCGATAGCTAGGCTTAACGGATCTCGATTCA", 2: "TTGACCATGCCGTATAGGCATCCGATTAGCGGATTTACGCCTAGATCAGG"}
    rows = []
    for e, side, coord in ((1, sides[0], 1000), (2, sides[1], 5000)):
        other = body[3 - e][:20]
        clip = other.translate(TURN) if sides[0] == sides[1] else other
        clip = "GATTACAGATTACAGATTAC" if wrong and e == 2 else clip
        for r in range(2):
            seq = clip[::-1] + body[e] if side == "L" else body[e][::-1] + clip
            cigar = "20S50M" if side == "L" else "50M20S"
            start = coord if side == "L" else coord - 49
            rows.append(("chr1", start, start + 50, coord, side, f"{e}/{r}", None, cigar, seq))
    return spark.createDataFrame(rows, "chrom string, start long, stop long, coord long, clip string, qname string, cb string, cigar string, seq string")


def none(spark):
    return spark.createDataFrame([], "chrom1 string, coord1 long, clip1 string, chrom2 string, coord2 long, clip2 string")


@pytest.mark.parametrize("sides", ["LR", "RL", "LL", "RR"])
@pytest.mark.parametrize("method", ["fuzzy", "perfect", "partial"])
def test_orientations_and_methods(spark, sides, method):
    reads = cross(spark, sides=sides)
    sites = reads.select("chrom", "coord", "clip")
    (got,) = pairing.pairs_by_sequence(sites, reads, none(spark), method=method).collect()
    assert (got.coord1, got.clip1, got.coord2, got.clip2, got.n, got.offset) == (1000, sides[0], 5000, sides[1], 4, 0)
    known = spark.createDataFrame([("chr1", 5000, sides[1], "chr1", 1000, sides[0])], none(spark).schema)
    assert pairing.pairs_by_sequence(sites, reads, known, method=method).count() == 0


def test_misfits_are_no_support(spark):
    reads = cross(spark, wrong=True)
    pairs = spark.createDataFrame([("chr1", 1000, "L", "chr1", 5000, "R", 7, 0)], "chrom1 string, coord1 long, clip1 string, chrom2 string, coord2 long, clip2 string, n long, offset int")
    ends = splitreads.breakend_consensus(reads.select("chrom", "coord", "clip").distinct(), reads, 50)
    r = splitreads.joined_support(pairs, splitreads.soft_clips(reads), ends).first()
    assert (r.n12, r.n21) == (2, 0)
    counted = pairs.selectExpr("chrom1", "coord1", "clip1", "chrom2", "coord2", "clip2", "'1/0' as qname")
    r = splitreads.joined_support(pairs, splitreads.soft_clips(reads), ends, counted).first()
    assert (r.n12, r.n21) == (2, 1)  # 1/0 on both sides, and 1/1
    assert splitreads.assembled(splitreads.joined_support(pairs, splitreads.soft_clips(reads), ends)).count() == 0


def test_starts_must_agree(spark):
    joined = spark.createDataFrame([(1, 2, 3, 0, 0), (1, 2, 3, 0, 4), (9, 2, 3, 5, 5)], "n long, n12 long, n21 long, start12 int, start21 int")
    assert sorted(r.n for r in splitreads.assembled(joined).collect()) == [5, 9]


def test_recount_and_merge(spark):
    reads = cross(spark)
    known = spark.createDataFrame([("chr1", 1000, "L", "chr1", 5000, "R", 1, 0, "", [("1/0",)]), ("chr1", 1001, "L", "chr1", 5000, "R", 3, 0, "x", [("z",), ("y",)])], "chrom1 string, coord1 long, clip1 string, chrom2 string, coord2 long, clip2 string, n long, offset int, seq string, reads array<struct<qname:string>>")
    got = {r.coord1: (r.n, r.reads) for r in pairing.recount(known, reads).collect()}
    assert got == {1000: (5, ["1/0", "1/1", "2/0", "2/1"]), 1001: (6, ["2/0", "2/1", "y", "z"])}  # reads counted before count for both sides; a letter aside the clips of the other end still fit
    (one,) = pairing.merged(pairing.recount(known, reads)).collect()
    assert (one.coord1, one.n, len(one.rids), one.offset, one.seq) == (1001, 11, 8, 0, "x")


def plain_place(read, template):
    """(start, stop, edits) of the read in the template by a whole table: fewest edits, then the first stop, then the last start."""
    table = [[(0, -j) for j in range(len(template) + 1)]]
    for i, c in enumerate(read, 1):
        row = [(i, 0)]
        for j, d in enumerate(template, 1):
            ways = (table[-1][j][0] + 1, table[-1][j][1]), (row[-1][0] + 1, row[-1][1]), (table[-1][j - 1][0] + (c != d), table[-1][j - 1][1])
            row.append(min(ways))
        table.append(row)
    stop = min(range(len(template) + 1), key=lambda j: (table[-1][j][0], j))
    return -table[-1][stop][1], stop, table[-1][stop][0]


def test_placing_reads(spark):
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    rows = [("", "ACG"), ("ACG", ""), ("A", "T"), ("ACGT", "ACGT"), ("ACGT", "TTACGTTT"), ("ACGT", "ACT"), ("AAAA", "AATAATAA")]
    for _ in range(60):
        t = word(rng.randrange(1, 40))
        a = rng.randrange(len(t))
        r = list(t[a : a + rng.randrange(1, 25)])
        for _ in range(rng.randrange(4)):
            k = rng.randrange(len(r) + 1)
            r[k : k + rng.randrange(2)] = word(rng.randrange(3))
        rows.append(("".join(r), t))
    got = [tuple(r.p) for r in spark.createDataFrame(rows, "a string, b string").select(place_in("a", "b").alias("p")).collect()]
    assert got == [plain_place(a, b) if a and b else (0, 0, len(a)) for a, b in rows]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_alignments_equal_plain_python(spark):
    reads = more.junction_reads(load(spark, SF, "genes")).collect()
    sites, _ = plain_assembly(reads, 50)
    got = {tuple(r)[:6]: r.lines.split("\n") for r in more.catalog_query("junction_alignments")(spark, SF).collect()}
    offsets = {p[:6]: p[7] for p in plain_pairs(reads)}
    assert set(offsets) <= set(got)
    for pair, offset in offsets.items():
        one, two = sites[pair[:3]][0], sites[pair[3:]][0]  # from the break inward
        first = one[::-1] if pair[2] == "R" else rc(one)
        second = two if pair[5] == "L" else rc(two[::-1])
        template = first + "N" * max(offset, 0) + second[max(-offset, 0) :]
        lines = []
        for r in reads:
            for k, side in ((0, "R"), (3, "L")):
                if (r.chrom, r.coord, r.clip) == pair[k : k + 3]:
                    seq = r.seq if r.clip == side else rc(r.seq)
                    at, _, edits = plain_place(seq, template)
                    lines.append((at, r.qname, seq, f"{' ' * at}{seq}  {r.qname} {edits}"))
        assert got[pair] == [template, *(x[-1] for x in sorted(set(lines)))]


def test_equal_reads_are_counted_once_and_weighed(spark):
    """Alignments and clips of the same letters are one row with a weight: the letters are exploded in one place, and every read is still counted and named."""
    data = [("c1", 100, 110, f"r{k}", None, "4S10M", "ACGT" + ("AAAAACCCCC" if k < 3 else "GAAAACCCCC")) for k in range(5)]
    reads = spark.createDataFrame(data, "chrom string, start long, stop long, qname string, cb string, cigar string, seq string")
    sites = spark.createDataFrame([("c1", 100, "L"), ("c1", 500, "L")], "chrom string, coord long, clip string")
    ends = splitreads.breakend_consensus(sites, reads, 12)
    assert ends._jdf.queryExecution().executedPlan().toString().count("Generate posexplode") == 1
    assert {r.coord: r.seq for r in ends.collect()} == {100: "AAAAACCCCC--", 500: "-" * 12}
    key = "chrom1 string, coord1 long, clip1 string, chrom2 string, coord2 long, clip2 string, offset int, n long"
    pairs = spark.createDataFrame([("c1", 100, "L", "c1", 500, "L", 0, 0)], key)
    far = spark.createDataFrame([("c1", 100, "L", "AAAA"), ("c1", 500, "L", "ACGTACGT")], "chrom string, coord long, clip string, seq string")
    r = splitreads.joined_support(pairs, splitreads.soft_clips(reads), far, method="perfect").first()
    assert (r.n12, r.start12, r.reads12, r.n21) == (5, 0, ["r0", "r1", "r2", "r3", "r4"], 0)
