"""Findings of round 3: what is the same is worked out once."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from circlet.operators import breakpoints, cells, evidence, graph, intervals, singlecell, splitreads, velocity
from circlet.plans import more

SPANS = "seg long, chrom string, start long, stop long"


def rows_of_plan(df, node):
    """The most rows that a kind of node of an executed plan gave out."""
    df.collect()
    plan, most = df._jdf.queryExecution().executedPlan(), []

    def walk(p):
        if p.nodeName().startswith("AdaptiveSparkPlan"):
            return walk(p.executedPlan())
        if "QueryStage" in p.nodeName():
            return walk(p.plan())
        if node in p.nodeName():
            most.append(p.metrics().apply("numOutputRows").value())
        for i in range(p.children().size()):
            walk(p.children().apply(i))

    walk(plan)
    return max(most)


def copies(spark, n=200):
    """n segments of one place with as many of another, and as many genes of the first place."""
    segments = spark.createDataFrame([(i + k * n, "c", 1000 * k, 1000 * k + 50) for i in range(n) for k in (0, 1)], SPANS)
    genes = spark.createDataFrame([(i, "c", 10, 20, f"g{i:03}") for i in range(n)], "gid long, chrom string, start long, stop long, name string")
    return segments, genes


def test_copies_of_intervals_make_no_pairs(spark):
    segments, genes = copies(spark)
    for f, want in ((lambda: intervals.map_first(segments, genes, ["seg"], "name", "gid"), "g000"), (lambda: intervals.map_all(segments, genes, ["seg"], "name", ","), ",".join(f"g{i:03}" for i in range(200)))):
        got = f()
        assert {r.seg: r.name for r in got.collect()} == {i: want for i in range(200)}
        assert rows_of_plan(f(), "Join") <= 400
    listed = genes.withColumn("brand", F.lit("b"))
    own = segments.withColumn("brand", F.when(F.col("seg") == 3, "b").otherwise("a"))
    assert sorted(r.seg for r in intervals.unlike(own, listed, "brand").collect()) == [i for i in range(200) if i != 3]
    assert rows_of_plan(intervals.unlike(own, listed, "brand"), "Join") <= 400
    assert intervals.clear_of(segments, genes, ["seg"]).agg(F.min("seg"), F.count("*")).first() == (200, 200)
    assert rows_of_plan(intervals.clear_of(segments, genes, ["seg"]), "Join") <= 400
    reads = genes.select("chrom", "start", "stop", (F.col("gid") % 7).alias("rid"))
    assert {(r.seg, r.reads) for r in cells.interval_reads(segments, reads).collect()} == {(i, 7) for i in range(200)}
    assert rows_of_plan(cells.interval_reads(segments, reads), "Join") <= 400
    assert [(r.start, r.stop) for r in intervals.intersections(segments, genes).collect()] == [(10, 20)]
    assert rows_of_plan(intervals.intersections(segments, genes), "Join") <= 400


def test_covered_is_disjoint(spark):
    df = spark.createDataFrame([("c", 0, 10), ("c", 10, 15), ("c", 5, 8), ("c", 20, 25), ("c", 249_990, 250_010), ("d", 5, 5)], "chrom string, start long, stop long")
    assert sorted((r.start, r.stop) for r in intervals.covered(df).collect()) == [(0, 15), (20, 25), (249_990, 250_000), (250_000, 250_010)]


def test_clear_of_is_padded_at_both_sides(spark):
    a = spark.createDataFrame([(1, "c", 0, 10), (2, "c", 0, 11), (3, "d", 0, 11)], SPANS)
    b = spark.createDataFrame([(0, "c", 14, 20)], SPANS)
    assert sorted(r.seg for r in intervals.clear_of(a, b, ["seg"], pad=2).collect()) == [1, 3]
    assert [r.seg for r in intervals.overlapping(a, b, ["seg"], pad=2).collect()] == [2]


def test_segments_of_several_intervals_are_classes(spark):
    segments = spark.createDataFrame([(1, "c", 0, 10), (1, "c", 20, 30), (2, "c", 20, 30), (2, "c", 0, 10), (3, "c", 0, 10)], SPANS)
    frags = spark.createDataFrame([(7, "c", 5, 25, 2), (7, "c", 1, 2, 1), (8, "c", 50, 60, 1)], "cell int, chrom string, start long, stop long, n long")
    assert {tuple(r) for r in cells.fragment_counts(frags, segments).collect()} == {(7, 1, 5), (7, 2, 5), (7, 3, 3)}
    rings = segments.withColumn("ring", F.when(F.col("seg") == 3, "b").otherwise("a"))
    flank = spark.createDataFrame([("a", "c", 22, 24), ("a", "c", 22, 24)], "ring string, chrom string, start long, stop long")
    inside, outside = cells.ring_counts(frags, rings, flank)
    assert {tuple(r) for r in inside.collect()} == {(7, "a", 10, 2), (7, "b", 3, 1)}
    assert [tuple(r) for r in outside.collect()] == [(7, "a", 4)]
    counts, _ = cells.class_counts(frags, segments)
    plain = cells.fragment_counts(frags, segments)
    own = lambda c: [(r.cell, round(r.cosine, 9)) for r in cells.profile_cosine(c, c.groupBy("seg").agg(F.sum("n").alias("n"))).collect()]
    assert own(counts) == own(plain)


def test_copies_of_segments_are_counted_once_by_cell(spark):
    segments, genes = copies(spark)
    frags = genes.select((F.col("gid") % 2).alias("cell"), "chrom", "start", "stop", F.lit(1).cast("long").alias("n"))
    assert cells.fragment_counts(frags, segments).count() == 400
    counts, _ = cells.class_counts(frags, segments)
    assert rows_of_plan(counts, "Join") <= 400


def test_components_share_a_batch(spark):
    """Many small components are one call of Python, not one each; big ones go over batches."""
    edges = spark.range(500).select(F.explode(F.array(*[F.struct((F.col("id") * 10 + a).alias("a"), (F.col("id") * 10 + b).alias("b"), F.lit(k).alias("kind"), F.lit(1.0).alias("weight")) for a, b, k in ((0, 1, "inner"), (1, 2, "outer"), (2, 3, "inner"), (0, 3, "outer"))])).alias("e")).select("e.*")
    components = spark.range(5000).select(F.col("id").alias("node"), (F.floor(F.col("id") / 10) * 10).alias("component"))
    paths = graph.find_paths(edges, components)
    assert "FlatMapGroupsInPandas" not in paths._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.component, r.kind, tuple(r.path), r.truncated) for r in paths.where("kind = 'ring'").collect()) == [(10 * i, "ring", (10 * i, 10 * i + 1, 10 * i + 2, 10 * i + 3), False) for i in range(500)]
    vertices = spark.range(5000).select("id", F.lit("c").alias("chrom"))
    chosen = graph.representatives(paths, edges, vertices)
    assert chosen.where("kind = 'ring'").count() == 500 and "FlatMapGroupsInPandas" not in chosen._jdf.queryExecution().executedPlan().toString()


def test_labels_take_few_rounds(spark, monkeypatch):
    """Rounds grow with the logarithm of a ring or chain, whatever the order of its nodes."""
    rounds = []
    plain = graph.stage
    monkeypatch.setattr(graph, "stage", lambda df, name: rounds.append(name) or plain(df, name))
    for name, node in (("mixed", lambda x: F.pmod(x * 7919 + 13, F.lit(64))), ("sorted", lambda x: x)):
        rounds.clear()
        edges = spark.range(64).select(node(F.col("id")).alias("a"), node(F.pmod(F.col("id") + 1, F.lit(64))).alias("b")).union(spark.createDataFrame([(100, 100)], "a long, b long"))
        got = {r.node: r.component for r in graph.label_components(edges).collect()}
        assert got == dict.fromkeys(range(64), 0) | {100: 100}
        assert len(rounds) <= 9, name
    line = spark.range(64).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    rounds.clear()
    assert graph.label_components(line).where("component <> 0").isEmpty() and len(rounds) <= 10


def test_vectors_meet_in_blocks(spark, monkeypatch):
    """No row is made for a pair of vectors before the nearest are chosen; ties go by id; slices and blocks change nothing."""
    monkeypatch.setattr(velocity, "QUERY_BYTES", 200)
    monkeypatch.setattr(velocity, "QUERIES", 3)
    monkeypatch.setattr(velocity, "POINTS", 7)
    rows = [(i, [float(i % 5), float(i % 3)]) for i in range(60)] + [(60, None), (61, [1.0, None]), (62, [float("nan"), 0.0])]
    p = spark.createDataFrame(rows, "id long, vec array<double>")
    near = velocity.nearest(p.where("id < 9"), p, k=4)
    got = sorted((r.q, r["rank"], r.id, r.d) for r in near.collect())
    want = []
    for q in range(9):
        d = sorted(((sum((x - y) ** 2 for x, y in zip(rows[q][1], v))), i) for i, v in rows[:60] if i != q)[:4]
        want += [(q, k + 1, i, x) for k, (x, i) in enumerate(d)]
    assert got == want
    assert rows_of_plan(near, "Join") <= 300


def test_ranks_of_all_pairs_equal_those_of_listed_ones(spark):
    rows = [(i, [float((i * k) % 7) for k in range(1, 6)], [float((i + k * k) % 4) for k in range(1, 6)]) for i in range(30)]
    cells_ = spark.createDataFrame(rows, "id long, e array<double>, v array<double>")
    asked = cells_.where("id % 10 = 0")
    pairs = asked.select(F.col("id").alias("a")).crossJoin(cells_.select(F.col("id").alias("b")))
    one = lambda df: sorted((r.a, r.b, None if r.r is None else round(r.r, 9)) for r in df.collect())
    assert one(velocity.rank_correlation(asked, cells_)) == one(velocity.delta_correlation(cells_, pairs, "rank"))


def test_junctions_of_the_same_ends_are_shown_once(spark):
    """Copies of a junction and reads of it make no pairs until members are joined."""
    junctions = spark.createDataFrame([(f"j{i:03}", "c", 100, "R", "d", 500, "L") for i in range(200)] + [("k", "c", 100, "R", "d", 9000, "L")], "junction string, chrom1 string, coord1 long, clip1 string, chrom2 string, coord2 long, clip2 string")
    reads = spark.createDataFrame([(f"q{i}", "c", 21, 101, "80M20S", 0, "d,501,+,20S80M,60,0;", str(i % 4)) for i in range(200)] + [("s", "c", 50, 150, "100M", 0, None, "0")], "qname string, chrom string, start long, stop long, cigar string, nm int, sa string, cb string")
    got = evidence.junction_matrix(reads, junctions)
    assert {(r.junction, r.cell): (r.split_SA, r.single_clip, r.normal_spanning) for r in got.collect()} == {(f"j{i:03}", c): (50, 0, int(c == "0")) for i in range(200) for c in "0123"} | {("k", c): (0, 50, int(c == "0")) for c in "0123"}
    assert rows_of_plan(evidence.junction_matrix(reads, junctions), "Join") <= 1000
    assert {r.kind: (r.reads, r.junctions) for r in evidence.kinds_shown(reads, junctions).collect()} == {"split_SA": (40_000, 200), "single_clip": (200, 1), "normal_spanning": (201, 201)}
    assert rows_of_plan(evidence.kinds_shown(reads, junctions), "Join") <= 1000
    assert evidence.junction_evidence(reads, junctions).count() == 201 * 201


def test_a_junction_of_several_rows_is_one(spark):
    junctions = spark.createDataFrame([("a", "c", 100, "R", None, None, None), ("a", "c", 900, "R", "d", 500, "L"), ("b", "c", 900, "R", "d", 500, "L")], "junction string, chrom1 string, coord1 long, clip1 string, chrom2 string, coord2 long, clip2 string")
    reads = spark.createDataFrame([("q", "c", 21, 101, "80M20S", 0, None, "x"), ("q", "c", 821, 901, "80M20S", 0, "d,501,+,20S80M,60,0;", "w")], "qname string, chrom string, start long, stop long, cigar string, nm int, sa string, cb string")
    assert sorted(tuple(r) for r in evidence.junction_evidence(reads, junctions).collect()) == [("a", "q", "w", "split_SA"), ("b", "q", "w", "split_SA")]


def test_junctions_of_the_same_ends_match_once(spark):
    ends = "chrom1 string, coord1 long, clip1 string, chrom2 string, coord2 long, clip2 string"
    junctions = spark.createDataFrame([(f"r{i}", "c", 100, "R", "d", 500, "L") for i in range(200)] * 2, "ring string, " + ends)
    pairs = spark.createDataFrame([("c", 100 + i, "R", "d", 500, "L", i) for i in range(50)] + [("d", 500, "L", "c", 100, "R", 9)], ends + ", n long")
    found = breakpoints.match_known(junctions, pairs, 20)
    assert sorted((r.ring, r.p_coord1, r.p_n) for r in found.collect()) == sorted((f"r{i}", 100 + k, n) for i in range(200) for k, n in [(j, j) for j in range(21)] + [(0, 9)])
    assert rows_of_plan(found, "Join") == 200 * 22  # the result itself, as members are joined


def test_copies_of_rings_are_picked_by_their_best(spark, monkeypatch):
    """Rings of the same segments make no pairs, and go where pick_rings() sends each."""
    rows = [(f"r{k}{i:02}", "c", 10_000 * (k // 3) + k % 3, 10_000 * (k // 3) + 1000 + 30 * (k % 3)) for k in range(9) for i in range(20)]
    rings = spark.createDataFrame(rows, "ring string, chrom string, start long, stop long")
    scores = spark.createDataFrame([(r[0], float(n * 7919 % 7) if n % 9 else None) for n, r in enumerate(rows)] + [("lone", 1.0)], "ring string, score double")
    want = sorted(map(str, graph.pick_rings(scores, intervals.reciprocal_overlap(rings, 0.95)).collect()))
    seen = []
    plain = graph.pick_rings
    monkeypatch.setattr(graph, "pick_rings", lambda s, overlaps, above: seen.append(overlaps.count()) or plain(s, overlaps, above))
    got = graph.pick_distinct(scores, rings)
    assert sorted(map(str, got.select("ring", "score", "chosen", "role").collect())) == want
    assert seen[0] <= 9


def test_chains_of_pairs_share_a_batch(spark):
    """Chains of close pairs are read in order, and go on from batch to batch."""
    ends = "chrom1 string, coord1 long, clip1 string, chrom2 string, coord2 long, clip2 string, n long, rids array<long>"
    pairs = spark.createDataFrame([("c", i, "L", "d", k, "R", n, [i + k]) for i in range(300) for k, n in ((0, 1), (90, 3), (180, 2), (270, 1), (900, 5))], ends)
    merged = splitreads.merge_close_pairs(pairs)
    assert "FlatMapGroupsInPandas" not in merged._jdf.queryExecution().executedPlan().toString()
    want = sorted(("c", i, "L", "d", k, "R", n, r) for i in range(300) for k, n, r in ((90, 7, [i, i + 90, i + 180, i + 270]), (900, 5, [i + 900])))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert sorted((*r[:7], sorted(r.rids)) for r in merged.collect()) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_weak_hits_of_the_same_ends_are_found_once(spark):
    junctions = spark.createDataFrame([(f"r{i:03}", 1, "c", 100, "R", "d", 500, "L") for i in range(200)], "ring string, junction long, chrom1 string, coord1 long, clip1 string, chrom2 string, coord2 long, clip2 string")
    reads = spark.createDataFrame([("c", 20, 100, "80M20S", "d,501,+,20S80M,60,0;", 0, "c", 5, f"q{i}", str(i % 2), 60, 1) for i in range(50)], "chrom string, start long, stop long, cigar string, sa string, flag int, mate_chrom string, mate_start long, qname string, cb string, mapq int, nh int")
    found = singlecell.weak_hits(reads, junctions)
    assert {tuple(r) for r in found.collect()} == {(str(i % 2), f"r{k:03}", 1, f"q{i}", "split") for i in range(50) for k in range(200)}
    assert rows_of_plan(found.groupBy("kind").count(), "Generate") <= 200


def test_rings_that_share_bases_meet_in_a_task(spark, monkeypatch):
    """Pairs of rings are summed where they meet and never shuffled, also rings over several chromosomes."""
    draw = random.Random(3)
    rows = [(f"r{draw.randrange(40)}", f"c{draw.randrange(3)}", a, a + draw.randrange(1, 90)) for a in (draw.randrange(-100, 1900) for _ in range(300))]
    held = {}
    for ring, chrom, a, b in rows:
        held.setdefault(ring, set()).update((chrom, x) for x in range(a, b + 1))
    want = sorted((p, q, len(held[p] & held[q]), len(held[p]), len(held[q])) for p in held for q in held if p < q and held[p] & held[q])
    schema = "ring string, chrom string, start long, stop long"
    found = intervals.reciprocal_overlap(spark.createDataFrame([*rows, (None, "c0", 1, 9)], schema))
    assert sorted(tuple(r)[:5] for r in found.collect()) == want
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString().split("FlatMapGroupsInArrow")[0]
    assert intervals.reciprocal_overlap(spark.createDataFrame([], schema)).count() == 0
    # in small portions of whole rings the same
    merged = [("a", "c", 0, 10, 10, True), ("b", "c", 5, 30, 30, True), ("b", "d", 0, 5, 30, True), ("e", "d", 3, 9, 6, True), ("e", "c", 9, 10, 6, True)]
    batch = pa.table(dict(zip(["ring", "chrom", "start", "stop", "total", "_left"], map(pa.array, zip(*merged))))).to_batches()
    for portion in (1, 1000):
        monkeypatch.setattr(intervals, "AT_ONCE", portion)
        got = [tuple(r.values()) for chrom in ("c", "d") for b in intervals._block_pairs((pa.scalar(chrom), pa.scalar(0), pa.scalar(0)), iter(batch)) for r in b.to_pylist()]
        assert sorted(got) == [("a", "b", 10, 30, 5), ("a", "e", 10, 6, 1), ("b", "e", 30, 6, 3)]


def test_pairs_get_names_where_their_ends_are_dealt(spark, monkeypatch):
    """Names of rings aren't shuffled with pairs; segments may lie over several stretches, and ends in none."""
    monkeypatch.setattr(singlecell, "STRETCH", 1000)
    draw = random.Random(5)
    end = lambda: (f"c{draw.randrange(2)}", draw.randrange(4000), draw.choice("LR"))
    pairs = [(*end(), *end(), draw.randrange(1, 9)) for _ in range(200)] + [("c0", 5, "L", None, None, "R", 4), ("x", 5, "L", "c0", 7, "R", 4)]
    rings = [(f"r{draw.randrange(12)}", f"c{draw.randrange(2)}", a, a + draw.randrange(1500)) for a in (draw.randrange(4000) for _ in range(25))] + [(None, "c0", 0, 4000), ("r1", "c0", 9, 3)]
    of = lambda c, x: sorted({r for r, k, a, b in rings if r and x is not None and k == c and a <= x <= b})
    want = {}
    for *ends, n in pairs:
        a, b = sorted([tuple(ends[:3]), tuple(ends[3:])], key=lambda e: (e[0] is not None, e[0] or "", e[1] or 0, e[2]))
        m, k = want.get((*a, *b), (0, 0))
        want[(*a, *b)] = (max(m, n), k + 1)
    want = {e: (n, k, ";".join(of(*e[:2])), ";".join(of(*e[3:5])), ";".join(sorted({*of(*e[:2])} & {*of(*e[3:5])})), bool(of(*e[:2]) and of(*e[3:5]))) for e, (n, k) in want.items() if n >= 3}
    schema = "chrom1 string, coord1 long, clip1 string, chrom2 string, coord2 long, clip2 string, n long"
    found = singlecell.annotate_pairs(spark.createDataFrame(pairs, schema), spark.createDataFrame(rings, "ring string, chrom string, start long, stop long"), 3)
    assert {tuple(r)[1:7]: tuple(r)[7:] for r in found.collect()} == want
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString().split("FlatMapGroupsInArrow")[0]
    points, spans = [0, 5, 9], ([0, 4, 5, 5], [9, 5, 5, 7], [1, 0, 1, 2])
    for portion in (1, 1000):
        monkeypatch.setattr(singlecell, "AT_ONCE", portion)
        first, names = singlecell._holding(np.array(points), *map(np.array, spans))
        assert [names[a:b].tolist() for a, b in zip(first, first[1:])] == [[1], [0, 1, 2], [1]]


ENDED = "chrom1 string, coord1 long, clip1 string, chrom2 string, coord2 long, clip2 string"


def test_turned_links_are_read_once(spark):
    links = spark.createDataFrame([("c", 1, "L", "d", 2, "R", 7), ("c", 1, "L", "c", 1, "L", 8), (None, 1, "L", None, 1, "L", 9), (None, 1, "L", "c", 1, "L", 3)], ENDED + ", n long")
    turned = breakpoints._turned(links)
    assert turned.columns == links.columns and "Union" not in turned._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(str, map(tuple, turned.collect()))) == sorted(map(str, [("c", 1, "L", "d", 2, "R", 7), ("d", 2, "R", "c", 1, "L", 7), ("c", 1, "L", "c", 1, "L", 8), (None, 1, "L", None, 1, "L", 9), (None, 1, "L", "c", 1, "L", 3), ("c", 1, "L", None, 1, "L", 3)]))


def test_best_known_is_the_most_of_match_known(spark):
    """Pairs far from a junction's second end aren't met, and what is met is summed up before it is shuffled."""
    draw = random.Random(7)
    end = lambda: (draw.choice("cd"), draw.randrange(-300, 900), draw.choice("LR"))
    junctions = spark.createDataFrame([(f"r{i % 50}", *end(), *end()) for i in range(80)] * 2 + [("n", "c", None, "L", "c", 5, "R")], "ring string, " + ENDED)
    pairs = spark.createDataFrame([(*end(), *end(), draw.randrange(9)) for _ in range(200)], ENDED + ", n long")
    want = breakpoints.match_known(junctions, pairs, 90).groupBy(*junctions.columns).agg(F.max("p_n").alias("n"))
    got = sorted(map(tuple, breakpoints.best_known(junctions, pairs, 90).collect()))
    assert got == sorted(map(tuple, want.collect())) and got
    one = spark.createDataFrame([("r", "c", 0, "R", "c", 0, "L")], "ring string, " + ENDED)
    column = spark.createDataFrame([("c", 0, "R", "c", 1000 * i, "L", i) for i in range(300)], ENDED + ", n long")
    far = breakpoints.best_known(one, column, 90)
    assert [r.n for r in far.collect()] == [0] and "_band2" in far._jdf.queryExecution().executedPlan().toString()


def test_cells_of_reads_are_joined_before_junctions(spark):
    """Reads get their cells once, however many junctions have their ends."""
    junctions = spark.createDataFrame([(f"r{i}", i, "c", 100, "R", "d", 500, "L") for i in range(100)], "ring string, junction long, " + ENDED)
    pairs = spark.createDataFrame([("d", 500, "L", "c", 100, "R", [("q", "1"), ("p", "2")])], ENDED + ", reads array<struct<qname:string,bc:string>>")
    found = singlecell.junction_reads(junctions, pairs, spark.createDataFrame([("q", "x"), ("q", "y")], "qname string, cell string"))
    want = {(f"r{i}", i, *t) for i in range(100) for t in (("q", "1", "x"), ("q", "1", "y"), ("p", "2", "2"))}
    assert {tuple(r) for r in found.collect()} == want
    joins = [x for x in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in x]
    assert "Inner" in joins[0] and "LeftOuter" in joins[1]  # the outermost is with the junctions


def test_every_vector_is_asked(spark, monkeypatch):
    """Queries as many as points: these are broadcast, in slices too; tasks keep only the nearest, whatever copies there are."""
    monkeypatch.setattr(velocity, "QUERIES", 3)
    monkeypatch.setattr(velocity, "POINTS", 7)
    rng = random.Random(4)
    rows = [(i, [float(rng.randrange(4)) for _ in range(3)]) for i in range(60)] + [(60, None), (61, [1.0, None, 2.0])]
    p = spark.createDataFrame(rows, "id long, vec array<double>")
    want = {}
    for q, v in rows[:60]:
        far = sorted((sum((x - y) ** 2 for x, y in zip(v, w)), i) for i, w in rows[:60] if i != q)[:4]
        want |= {(q, k + 1): (i, d) for k, (d, i) in enumerate(far)}
    for kept, bytes_ in ((1 << 20, 1 << 26), (20, 1 << 26), (1 << 20, 1_000)):
        monkeypatch.setattr(velocity, "KEPT", kept)
        monkeypatch.setattr(velocity, "QUERY_BYTES", bytes_)
        near = velocity.nearest(p, p, k=4).collect()
        assert {(r.q, r["rank"]): (r.id, r.d) for r in near} == want and len(near) == len(want)


def test_queries_of_vectors_leave_none_out(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, [rng.random() for _ in range(64)]) for i in range(23)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    for name, key in (("embedding_knn", "q"), ("correlation_knn", "q"), ("delta_projection", "a"), ("transition_prob", "a")):
        got = [r[key] for r in more.QUERIES[name](spark, str(tmp_path)).collect()]
        assert sorted(got) == sorted(list(range(23)) * 10), name


def test_evidence_is_dealt_once_by_class(spark):
    """Reads of junctions are shuffled once after they met, by the class's number; what follows from an interval is not shuffled."""
    junctions = spark.createDataFrame([("a", "c", 100, "R", "d", 500, "L"), ("b", "c", 100, "R", "d", 500, "L"), ("k", "c", 100, "R", None, None, None)], "junction string, chrom1 string, coord1 long, clip1 string, chrom2 string, coord2 long, clip2 string")
    reads = spark.createDataFrame([("q", "c", 21, 101, "80M20S", 0, "d,501,+,20S80M,60,0;", "x")], "qname string, chrom string, start long, stop long, cigar string, nm int, sa string, cb string")
    for made in (evidence.kinds_shown(reads, junctions), evidence.junction_matrix(reads, junctions), evidence.junction_evidence(reads, junctions)):
        plan = made._jdf.queryExecution().executedPlan().toString()
        dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning(" in line]
        assert not [line for line in dealt if "qname" in line.split("hashpartitioning(")[1].split(")")[0]]
        assert "_from#" not in plan and "_s#" not in plan
    assert sorted(tuple(r) for r in made.collect()) == [("a", "q", "x", "split_SA"), ("b", "q", "x", "split_SA"), ("k", "q", "x", "single_clip")]


def test_segments_go_to_few_blocks_of_pairs(spark, monkeypatch):
    """A segment isn't sent to each pair of stretches, and rings of one segment send it once."""
    monkeypatch.setattr(singlecell, "STRETCH", 100)
    pairs = [("c", 100 * i, "L", "c", 100 * k + 50, "R", 5) for i in range(20) for k in range(i, 20)]
    rings = [(f"r{i:02}", "c", 0, 1999) for i in range(30)]
    found = singlecell.annotate_pairs(spark.createDataFrame(pairs, ENDED + ", n long"), spark.createDataFrame(rings, "ring string, chrom string, start long, stop long"), 3)
    names = ";".join(r[0] for r in rings)
    assert {(r.rings1, r.rings2, r.shared, r.both) for r in found.collect()} == {(names, names, names, True)}
    assert rows_of_plan(found, "Join") <= 600 and rows_of_plan(found, "Generate") <= 600


def test_pairs_are_made_distinct_before_they_match(spark):
    """What junctions and pairs make is distinct already: it is shuffled by the junction's ends alone."""
    junctions = spark.createDataFrame([("r", "c", 100, "R", "d", 500, "L"), ("r", "c", 100, "R", "d", 500, "L"), ("s", "c", 130, "R", "d", 500, "L")], "ring string, " + ENDED)
    pairs = spark.createDataFrame([("c", 101, "R", "d", 500, "L", 3), ("d", 500, "L", "c", 101, "R", 3), ("c", 101, "R", "d", 500, "L", 4)], ENDED + ", n long")
    found = breakpoints.match_known(junctions, pairs, 20)
    plan = found._jdf.queryExecution().executedPlan().toString()
    dealt = [line.split("hashpartitioning(")[1].split(")")[0] for line in plan.splitlines() if "Exchange hashpartitioning(" in line]
    assert not [d for d in dealt if "p_n#" in d or "ring#" in d]
    assert sorted((r.ring, r.p_coord1, r.p_n) for r in found.collect()) == [("r", 101, 3), ("r", 101, 4)]


def test_an_edge_is_one_row_of_labels_and_steps_have_no_paths(spark, monkeypatch):
    rows, plain = {}, graph.stage
    monkeypatch.setattr(graph, "stage", lambda df, name: rows.setdefault(f"{name}{len(rows)}", plain(df, name)))
    monkeypatch.setattr(graph, "drop_stage", lambda *_: None)
    edges = spark.createDataFrame([(i, (i + 1) % 6) for i in range(6)] + [(1, 0), (9, 9)], "a long, b long")
    assert {r.node: r.component for r in graph.label_components(edges).collect()} == dict.fromkeys(range(6), 0) | {9: 9}
    assert rows["links0"].count() == 7
    paths = spark.createDataFrame([(1, "ring", [1, 2, 3, 4], False), (1, "line", [5, 6], False)], "component long, kind string, path array<long>, truncated boolean")
    outer = spark.createDataFrame([(2, 3, "outer", 5.0), (1, 4, "outer", 2.0)], "a long, b long, kind string, weight double")
    v = spark.createDataFrame([(i, "c" if i < 6 else "chrUn_1") for i in range(1, 7)], "id long, chrom string")
    got = graph.path_support(paths, outer, v)
    assert {(r.kind, tuple(r.path), r.support, r.unplaced, r.whole) for r in got.collect()} == {("ring", (1, 2, 3, 4), 7.0, False, True), ("line", (5, 6), 0.0, True, False)}
    assert any(name.startswith("paths") for name in rows)
