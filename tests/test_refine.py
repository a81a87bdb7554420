"""Refinement of boundaries against plain Python, a case for each pass, and segments of the graph."""

import os
import statistics

import pytest

from circlet.operators import boundaries, segmentation
from circlet.plans import more
from circlet.plans.adapters import load
from circlet.plans.catalog import bins_of

SF = "/root/testdata/sf0.001"
SEGMENTS = "seg long, chrom string, start long, stop long, cn double, clip_left long, clip_right long"
EDGES = "chrom1 string, coord1 long, clip1 string, chrom2 string, coord2 long, clip2 string, support long"
BINS = "chrom string, coord long, n long, cn double"
SIDES = {"L": "start", "R": "stop"}


def plain(segments, edges, bins, reach=30_000, least=2, anchor=10_000, merge=150, min_cn=4.5, shortest=100, longest=100_000_000, width=10_000, weak=1, weak_reach=10_000, weak_least=5, candidates=5):
    """segments as dicts, edges as (end, end, support); returns both after refinement."""
    out = [s | {"disc": {"L": 0, "R": 0}, "partner": {"L": None, "R": None}, "source": "clip"} for s in segments]
    ends = [(*x, n, y) for a, b, n in edges for x, y in ((a, b), (b, a)) if n >= least]

    def median(chrom, a, b):
        some = [v for x, v in bins.get(chrom, []) if x < b and x + width > a]
        return statistics.median(some) if some else float("-inf")

    def anchored(partner, window, marks, but=None):
        return any(abs(x - partner[1]) <= window for seg, c, k, x in marks if (c, k) == (partner[0], partner[2]) and seg != but)

    def marks():
        return [(s["seg"], s["chrom"], k, s[col]) for s in out for k, col in SIDES.items()]

    def go(s, k, best):
        _, n, x, partner = best
        s[SIDES[k]], s["disc"][k], s["partner"][k], s["source"] = x, -n, partner, "PE_boundary"

    before = marks()
    for s in out:
        for k, col in SIDES.items():
            near = [(abs(x - s[col]), -n, x, p) for c, x, side, n, p in ends if (c, side) == (s["chrom"], k) and abs(x - s[col]) <= reach and anchored(p, anchor, before, s["seg"])]
            if s["clip"][k] == 0 and near:
                best = min(near)
                if best[2] < s["stop"] if k == "L" else best[2] > s["start"]:
                    go(s, k, best)
    before = marks()
    for s in out:
        if max(s["clip"].values()) > weak:
            continue
        for k, col in SIDES.items():
            if not 0 < s["clip"][k] <= weak:
                continue
            near = []
            for c, x, side, n, p in ends:
                away = s[col] - x if k == "L" else x - s[col]
                size = s["stop"] - x if k == "L" else x - s["start"]
                if (c, side) == (s["chrom"], k) and n >= weak_least and 0 < away <= weak_reach and shortest <= size <= longest and anchored(p, merge, before, s["seg"]) and median(c, *sorted((x, s[col]))) >= min_cn:
                    near.append((away, -n, x, p))
            if near:
                go(s, k, min(near))
                s["clip"][k] = 0
    after = marks()
    lost = {}
    for c, x, k, n, p in ends:
        if not any((c, k) == (d, j) and abs(x - y) <= anchor for _, d, j, y in after) and anchored(p, anchor, after):
            lost.setdefault((c, k), set()).add((x, n, p))
    one = {}
    for where, rows in lost.items():
        groups = []
        for r in sorted(rows):
            if groups and r[0] - groups[-1][-1][0] <= merge:
                groups[-1].append(r)
            else:
                groups.append([r])
        one[where] = [max(g, key=lambda r: (r[1], -r[0], r[2])) for g in groups]
    for chrom in {c for c, _ in one}:
        rights, used = one.get((chrom, "R"), []), set()
        held = [(s["start"], s["stop"]) for s in out if s["chrom"] == chrom]
        for a, n, p in one.get((chrom, "L"), []):
            behind = [r for r in rights if r[0] >= a + shortest][:candidates]
            for b, m, q in behind:
                if b not in used and b - a <= longest and not any(a < y and b > x for x, y in held) and median(chrom, a, b) >= min_cn:
                    out.append({"chrom": chrom, "start": a, "stop": b, "cn": median(chrom, a, b), "clip": {"L": 0, "R": 0}, "disc": {"L": n, "R": m}, "partner": {"L": p, "R": q}, "source": "PE_seg"})
                    held.append((a, b))
                    used.add(b)
                    break

    def snapped(end):
        near = [(abs(s[SIDES[end[2]]] - end[1]), -s[SIDES[end[2]]]) for s in out if s["chrom"] == end[0] and abs(s[SIDES[end[2]]] - end[1]) <= merge]
        return (end[0], -min(near)[1], end[2]) if near else end

    return out, sorted((*snapped(a), *snapped(b), n) for a, b, n in edges)


def shown(s):
    name = lambda p: ":".join(map(str, p)) if p else ""
    return s["chrom"], s["start"], s["stop"], round(s["cn"], 6), s["clip"]["L"], s["clip"]["R"], s["disc"]["L"], s["disc"]["R"], name(s["partner"]["L"]), name(s["partner"]["R"]), s["source"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_queries_equal_plain_python(spark):
    segments, sites, links, reads = (load(spark, SF, t) for t in ("segments", "sites", "links", "reads"))
    own = [{"seg": r.seg, "chrom": r.chrom, "start": r.start, "stop": r.stop, "cn": r.cn, "clip": {"L": r.clip_left, "R": r.clip_right}} for r in more.clipped_segments(segments, sites).collect()]
    edges = [((r.chrom1, r.coord1, r.clip1), (r.chrom2, r.coord2, r.clip2), r.support) for r in more.wide_edges(links).collect()]
    bins = {}
    for r in bins_of(reads).collect():
        bins.setdefault(r.chrom, []).append((r.coord, r.cn))
    want, moved = plain(own, edges, bins, 30_000, 1, 20_000, 5_000, 1.5, weak_least=1, weak_reach=20_000)
    assert sorted(tuple(r) for r in more.catalog_query("refined_boundaries")(spark, SF).collect()) == sorted(map(shown, want))
    assert sorted(tuple(r) for r in more.catalog_query("snapped_edges")(spark, SF).collect()) == moved
    assert {s["source"] for s in want} == {"clip", "PE_boundary", "PE_seg"} and moved != sorted((*a, *b, n) for a, b, n in edges)


def refine(spark, segments, edges, bins=()):
    out, moved = boundaries.refine_boundaries(spark.createDataFrame(segments, SEGMENTS), spark.createDataFrame(edges, EDGES), spark.createDataFrame(list(bins), BINS))
    return {r.seg: r for r in out.collect()}, sorted(tuple(r) for r in moved.collect())


OTHER = (2, "c2", 500_000, 600_000, 9.0, 5, 5)


def test_boundary_without_clips(spark):
    edges = [("c1", 120_000, "L", "c2", 595_000, "R", 3), ("c1", 110_000, "L", "c2", 300_000, "R", 9), ("c1", 118_000, "L", "c1", 190_000, "R", 9)]
    got, _ = refine(spark, [(1, "c1", 100_000, 200_000, 9.0, 0, 4), OTHER], edges)
    r = got[1]  # the nearer end has a partner near no boundary, the other only one of the segment itself
    assert (r.start, r.stop, r.disc_left, r.disc_right, tuple(r.partner_left), r.partner_right, r.source) == (120_000, 200_000, 3, 0, ("c2", 595_000, "R"), None, "PE_boundary")
    assert got[2].source == "clip" and (got[2].start, got[2].stop) == (500_000, 600_000)


def test_weak_boundary_goes_outward_through_amplified_sequence(spark):
    one, edge = (1, "c1", 100_000, 200_000, 9.0, 1, 1), ("c1", 95_000, "L", "c2", 600_100, "R", 5)
    high, low = [("c1", 90_000, 1, 6.0)], [("c1", 90_000, 1, 2.0)]
    got, edges = refine(spark, [one, OTHER], [edge], high)
    assert (got[1].start, got[1].clip_left, got[1].clip_right, got[1].disc_left) == (95_000, 0, 1, 5)
    assert edges == [("c1", 95_000, "L", "c2", 600_000, "R", 5)]  # the edge's other end goes to the boundary beside it
    assert refine(spark, [one, OTHER], [edge], low)[0][1].start == 100_000
    assert refine(spark, [one, OTHER], [(*edge[:6], 4)], high)[0][1].start == 100_000  # too little support
    assert refine(spark, [one, OTHER], [("c1", 105_000, "L", "c2", 600_100, "R", 5)], high)[0][1].start == 100_000  # inward
    assert refine(spark, [(*one[:5], 1, 2), OTHER], [edge], high)[0][1].start == 100_000  # the other boundary is strong


def test_orphans_make_segments(spark):
    edges = [("c1", 1_000_000, "L", "c2", 600_000, "R", 4), ("c1", 1_050_000, "R", "c2", 500_000, "L", 3), ("c1", 1_050_100, "R", "c2", 500_000, "L", 2), ("c1", 1_080_000, "R", "c2", 700_000, "L", 9)]
    bins = [("c1", x, 7, 6.0) for x in range(1_000_000, 1_100_000, 10_000)]
    got, _ = refine(spark, [OTHER], edges, bins)
    (new,) = [r for r in got.values() if r.source == "PE_seg"]
    assert (new.chrom, new.start, new.stop, new.cn, new.disc_left, new.disc_right, tuple(new.partner_right)) == ("c1", 1_000_000, 1_050_000, 6.0, 4, 3, ("c2", 500_000, "L"))
    assert len(refine(spark, [OTHER], edges, [(c, x, n, 2.0) for c, x, n, _ in bins])[0]) == 1
    assert len(refine(spark, [OTHER, (3, "c1", 1_020_000, 1_030_000, 9.0, 5, 5)], edges, bins)[0]) == 2  # it would overlap a segment


def test_segments_of_the_graph_inside_pairs(spark):
    """An end for which a pair suggests a segment isn't paired by depth, but others may be paired with it."""
    regions = spark.createDataFrame([("c", 0, 100_000)], "chrom string, start long, stop long")
    ends = spark.createDataFrame([("c", 10_000, "L", 5), ("c", 30_000, "R", 9), ("c", 60_000, "L", 7), ("c", 90_000, "R", 3)], "chrom string, coord long, clip string, n long")
    pairs = spark.createDataFrame([("c", 30_000, "R", "c", 60_000, "L", 4, "split")], "chrom1 string, coord1 long, clip1 string, chrom2 string, coord2 long, clip2 string, n long, source string")
    spans = lambda **kw: {(r.start, r.stop) for r in segmentation.graph_segments(ends, pairs, regions, **kw).collect()}
    assert spans(within=False) == {(0, 100_000), (10_000, 30_000), (60_000, 90_000)}
    assert spans() >= {(0, 100_000), (10_000, 30_000), (60_000, 90_000)}
    assert spans(within=False, shortest=25_000) == {(0, 100_000), (60_000, 90_000)}
    outside = spark.createDataFrame([("c", 0, 12_000)], "chrom string, start long, stop long")
    assert {(r.start, r.stop) for r in segmentation.graph_segments(ends, pairs, outside, within=False).collect()} == {(0, 12_000)}  # too little of it is amplified
    loop = pairs.limit(0).unionByName(spark.createDataFrame([("c", 10_000, "L", "c", 90_000, "R", 4, s) for s in ("split", "pe")], pairs.schema))
    for source, want in (("split", True), ("pe", False)):
        got = {(r.start, r.stop) for r in segmentation.graph_segments(ends, loop.where(f"source = '{source}'"), regions, within=False).collect()}
        assert ((10_000, 90_000) in got) == want


def test_edges_and_bins_are_read_once(spark, tmp_path):
    """refine_boundaries() makes its inputs once, however many steps read them."""
    seen = {n: spark.sparkContext.accumulator(0) for n in ("edges", "bins", "segments")}

    def counted(df, name):
        def add(batches):
            for b in batches:
                seen[name].add(b.num_rows)
                yield b

        return df.mapInArrow(add, df.schema)

    segments = counted(spark.createDataFrame([(1, "c", 1000, 9000, 5.0, 0, 0), (2, "c", 50_000, 90_000, 5.0, 1, 0)], "seg long, chrom string, start long, stop long, cn double, clip_left long, clip_right long"), "segments")
    edges = counted(spark.createDataFrame([("c", 1100, "L", "c", 90_100, "R", 7)], "chrom1 string, coord1 long, clip1 string, chrom2 string, coord2 long, clip2 string, support long"), "edges")
    bins = counted(spark.createDataFrame([("c", 10_000 * i, 5.0, 9) for i in range(12)], "chrom string, coord long, cn double, n long"), "bins")
    out, moved = boundaries.refine_boundaries(segments, edges, bins)
    assert {(r.seg, r.start, r.stop) for r in out.collect()} == {(1, 1100, 9000), (2, 50_000, 90_100)}
    assert [tuple(r) for r in moved.collect()] == [("c", 1100, "L", "c", 90_100, "R", 7)]
    assert {n: a.value for n, a in seen.items()} == {"edges": 1, "bins": 12, "segments": 2}
