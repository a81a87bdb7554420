"""Breakpoint candidates, pairs of breakpoints and discordant edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

NEAR = 150


def band(points: DataFrame, width: int, col: str = "coord") -> DataFrame:
    """points with _band: the cell of width, and the cells beside it, so that points within width share one."""
    return points.withColumn("_band", F.explode(F.array(*[F.floor(F.col(col) / width) + k for k in (-1, 0, 1)])))


def rescue_near_edge(sites: DataFrame, ends: DataFrame, least: int = 3, reach: int = NEAR, support: int = 2) -> DataFrame:
    """Sites with enough clips, and weaker ones within reach of an edge's end (chrom, clip, coord, support) of their side."""
    strong = sites.where(F.col("n") >= least)
    weak = sites.where((F.col("n") >= 1) & (F.col("n") < least)).withColumn("_band", F.floor(F.col("coord") / (reach + 1)))
    good = band(ends.where(F.col("support") >= support), reach + 1).select("chrom", "clip", F.col("coord").alias("_at"), "_band")
    near = weak.join(good, ["chrom", "clip", "_band"]).where(F.abs(F.col("coord") - F.col("_at")) <= reach)
    return strong.unionByName(near.select(*sites.columns).distinct())


def top_n(sites: DataFrame, n: int) -> DataFrame:
    """For each side, sites with a count above that of the n-th; ties with it are left out. With fewer than n sites all stay."""
    # The n-th count is found on the histogram of counts, which is as long as there are different ones.
    held = sites.groupBy("clip", "n").agg(F.count("*").alias("_k"))
    upto = held.withColumn("_upto", F.sum("_k").over(Window.partitionBy("clip").orderBy(F.desc("n"))))
    cut = upto.where(F.col("_upto") >= n).groupBy("clip").agg(F.max("n").alias("_cut"))
    return sites.join(F.broadcast(cut), "clip", "left").where(F.col("_cut").isNull() | (F.col("n") > F.col("_cut"))).drop("_cut")


def top_n_per_chrom(sites: DataFrame, n: int) -> DataFrame:
    w = Window.partitionBy("chrom", "clip").orderBy(F.desc("n"), "coord")
    return sites.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def refine_counts(links: DataFrame, sites: DataFrame) -> DataFrame:
    """For each end of a pair the larger of what its pairs count and what its clips count (above one)."""
    ends = links.select(F.col("chrom1").alias("chrom"), F.col("coord1").alias("coord"), F.col("clip1").alias("clip"), "n").unionAll(links.select("chrom2", "coord2", "clip2", "n"))
    ends = ends.groupBy("chrom", "coord", "clip").agg(F.sum("n").alias("pairs"))
    clips = sites.where(F.col("n") > 1).select("chrom", "coord", "clip", F.col("n").alias("clips"))
    return ends.join(clips, ["chrom", "coord", "clip"], "left").select("chrom", "coord", "clip", F.greatest("pairs", F.coalesce("clips", F.lit(0))).alias("n"))


def count_links(links: DataFrame) -> DataFrame:
    """Links by unordered pair of ends: support and the sorted ids of their reads. Each end is (chrom, coord, clip)."""
    a, b = (F.struct(F.col(f"chrom{k}").alias("chrom"), F.col(f"coord{k}").alias("coord"), F.col(f"clip{k}").alias("clip")) for k in (1, 2))
    low, high = F.least(a, b), F.greatest(a, b)
    out = links.select(low.alias("a"), high.alias("b"), "rid").groupBy("a", "b").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("rid")).alias("rids"))
    return out.select(*[F.col(f"{s}.{c}").alias(f"{c}{k}") for k, s in ((1, "a"), (2, "b")) for c in ("chrom", "coord", "clip")], "n", "rids")


def shared_reads(ends: DataFrame, least: int = 2) -> DataFrame:
    """Pairs of ends (end, rid) that at least ``least`` reads share. Ends meet by read; a pair has its smaller end first."""
    other = ends.select(F.col("end").alias("other"), "rid")
    return ends.join(other, "rid").where("end < other").groupBy("end", "other").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def combinations(sites: DataFrame, known: DataFrame, by: list[str]) -> DataFrame:
    """All pairs of sites inside a group, without the pairs known. The groups are of the top sites and thus bounded."""
    a = sites.select(*by, F.struct("chrom", "coord", "clip").alias("a"))
    b = sites.select(*by, F.struct("chrom", "coord", "clip").alias("b"))
    pairs = a.join(b, by).where("a < b")
    done = known.select(F.struct(F.col("chrom1").alias("chrom"), F.col("coord1").alias("coord"), F.col("clip1").alias("clip")).alias("x"), F.struct(F.col("chrom2").alias("chrom"), F.col("coord2").alias("coord"), F.col("clip2").alias("clip")).alias("y"))
    done = done.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    out = pairs.join(done, ["a", "b"], "left_anti")
    return out.select(*by, *[F.col(f"{s}.{c}").alias(f"{c}{k}") for k, s in ((1, "a"), (2, "b")) for c in ("chrom", "coord", "clip")])


def cluster_links(links: DataFrame, gap: int = 350, least: int = 2) -> DataFrame:
    """Discordant clusters: links of the same chromosomes and strands in chains of their first coordinate with steps under gap.

    A cluster's ends are the largest coordinate on the + side (clip R) and the smallest on the - side.
    """
    by = ["chrom1", "clip1", "chrom2", "clip2"]
    w = Window.partitionBy(*by).orderBy("coord1", "coord2", "rid")
    new = F.when(F.col("coord1") - F.lag("coord1").over(w) < gap, 0).otherwise(1)
    rows = links.withColumn("_new", new).withColumn("_cluster", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    end = lambda k: F.when(F.first(f"clip{k}") == "R", F.max(f"coord{k}")).otherwise(F.min(f"coord{k}")).alias(f"coord{k}")
    out = rows.groupBy(*by, "_cluster").agg(end(1), end(2), F.count("*").alias("support")).where(F.col("support") >= least)
    return out.select("chrom1", "coord1", "clip1", "chrom2", "coord2", "clip2", "support")


def collapse_ends(ends: DataFrame, reach: int = NEAR) -> DataFrame:
    """Ends (chrom, clip, coord, support) in chains of steps within reach: the strongest stays, the smallest coordinate of equals."""
    w = Window.partitionBy("chrom", "clip").orderBy("coord")
    rows = ends.withColumn("_new", F.when(F.col("coord") - F.lag("coord").over(w) <= reach, 0).otherwise(1)).withColumn("_g", F.sum("_new").over(w))
    return rows.groupBy("chrom", "clip", "_g").agg(F.max_by("coord", F.struct("support", -F.col("coord"))).alias("coord"), F.max("support").alias("support")).drop("_g")


def _turned(links: DataFrame) -> DataFrame:
    """Links in both directions, read once; one that is its own turn is there once."""
    ends = ["chrom", "coord", "clip"]
    same = F.col("chrom1").eqNullSafe(F.col("chrom2")) & F.col("coord1").eqNullSafe(F.col("coord2")) & F.col("clip1").eqNullSafe(F.col("clip2"))
    back = F.struct(*[F.col(f"{c[:-1]}{3 - int(c[-1])}").alias(c) if c[:-1] in ends else F.col(c) for c in links.columns])
    there = F.struct(*links.columns)
    return links.select(F.explode(F.when(same, F.array(there)).otherwise(F.array(there, back))).alias("_l")).select("_l.*")


def snap_two_ended(edges: DataFrame, pairs: DataFrame, reach: int = NEAR) -> DataFrame:
    """Edges moved to the strongest pair within reach of both ends, in either direction; without a single strongest they stay.

    edges: chrom1..clip2, support, each once; pairs: chrom1..clip2, n. Returns the edges with to1, to2 and snapped.
    """
    key = ["chrom1", "coord1", "clip1", "chrom2", "coord2", "clip2"]
    near = _turned(pairs.select(*key, "n")).select("chrom1", "clip1", "chrom2", "clip2", F.col("coord1").alias("to1"), F.col("coord2").alias("to2"), "n")
    # edges take the three cells: they are fewer than pairs read in both directions
    near = near.withColumn("_band", F.floor(F.col("to1") / (reach + 1))).withColumnsRenamed({c: f"_{c}" for c in ("chrom1", "clip1", "chrom2", "clip2", "_band")})
    rows = edges.withColumn("_k", F.explode(F.array(*map(F.lit, (-1, 0, 1))))).withColumn("_band", F.floor(F.col("coord1") / (reach + 1)) + F.col("_k"))
    on = [F.col(c) == F.col(f"_{c}") for c in ("chrom1", "clip1", "chrom2", "clip2", "_band")]
    met = rows.join(near, [*on, F.abs(F.col("coord1") - F.col("to1")) <= reach, F.abs(F.col("coord2") - F.col("to2")) <= reach], "left")
    # The strongest is the only one if it is both the first and the last of the strongest by place. An edge that meets none is there with nulls.
    some = F.col("n").isNotNull()
    met = met.where(some | (F.col("_k") == 0))  # of an edge's cells that meet none its own is enough
    best = met.groupBy(*edges.columns).agg(F.max(F.when(some, F.struct("n", "to1", "to2"))).alias("_last"), F.max(F.when(some, F.struct("n", (-F.col("to1")).alias("to1"), (-F.col("to2")).alias("to2")))).alias("_first"))
    one = F.coalesce((F.col("_last.to1") == -F.col("_first.to1")) & (F.col("_last.to2") == -F.col("_first.to2")), F.lit(False))
    return best.select(*edges.columns, F.when(one, F.col("_last.to1")).otherwise(F.col("coord1")).alias("to1"), F.when(one, F.col("_last.to2")).otherwise(F.col("coord2")).alias("to2"), one.alias("snapped"))


def match_known(junctions: DataFrame, pairs: DataFrame, window: int = 200) -> DataFrame:
    """Junctions (id, chrom1..clip2) with the pairs that match both ends within the window, direct or turned."""
    near = _turned(pairs.select(*PAIR, "n")).select(*[F.col(c).alias(f"p_{c}") for c in (*PAIR, "n")])
    # each once where they are dealt to meet, so that what they make is distinct and isn't shuffled for it
    near = near.withColumn("_band", F.floor(F.col("p_coord1") / (window + 1))).repartition("_band", *[f"p_{c}{k}" for k in (1, 2) for c in ("chrom", "clip")]).distinct()
    # junctions of the same ends match once
    rows = band(junctions.select(*PAIR).distinct(), window + 1, "coord1")
    on = " and ".join(f"{c}{k} = p_{c}{k}" for k in (1, 2) for c in ("chrom", "clip"))
    met = rows.join(near, (rows["_band"] == near["_band"]) & F.expr(on))
    met = met.where((F.abs(F.col("coord1") - F.col("p_coord1")) <= window) & (F.abs(F.col("coord2") - F.col("p_coord2")) <= window)).select(*PAIR, "p_coord1", "p_coord2", "p_n")
    return junctions.repartition(*PAIR).distinct().join(met, PAIR).select(*junctions.columns, "p_coord1", "p_coord2", "p_n")


def best_known(junctions: DataFrame, pairs: DataFrame, window: int = 200) -> DataFrame:
    """Junctions (id, chrom1..clip2) that match_known() finds a pair for, each once with n, the most of its pairs.

    Both ends are keys, so that only what is close at both meets; the most is
    kept where pairs meet, so their number doesn't leave the join.
    """
    sides = ["chrom1", "clip1", "chrom2", "clip2"]
    cell = lambda k: F.floor(F.col(f"coord{k}") / (window + 1))
    near = _turned(pairs.select(*PAIR, "n")).join(F.broadcast(junctions.select(*sides).distinct()), sides, "left_semi")
    for k in (1, 2):
        near = band(near, window + 1, f"coord{k}").withColumnsRenamed({"_band": f"_band{k}", f"coord{k}": f"_at{k}"})
    rows = junctions.select(*PAIR).distinct().withColumns({"_band1": cell(1), "_band2": cell(2)})
    met = rows.join(near, [*sides, "_band1", "_band2"]).where((F.abs(F.col("coord1") - F.col("_at1")) <= window) & (F.abs(F.col("coord2") - F.col("_at2")) <= window))
    return junctions.distinct().join(met.groupBy(*PAIR).agg(F.max("n").alias("n")), PAIR).select(*junctions.columns, "n")


def filter_pairs(pairs: DataFrame, least: int = 2, shortest: int = 500, segments: DataFrame | None = None, pad: int = 10_000) -> DataFrame:
    """Pairs of enough support that aren't short, and whose ends both lie in merged segments widened by pad."""
    rows = pairs.where((F.col("n") >= least) & ((F.col("chrom1") != F.col("chrom2")) | (F.abs(F.col("coord1") - F.col("coord2")) >= shortest)))
    if segments is None:
        return rows
    from .intervals import padded_membership

    for k in (1, 2):
        points = rows.select(F.col(f"chrom{k}").alias("chrom"), F.col(f"coord{k}").alias("coord")).distinct()
        inside = padded_membership(points, segments, pad).select(F.col("chrom").alias(f"chrom{k}"), F.col("coord").alias(f"coord{k}"))
        rows = rows.join(inside, [f"chrom{k}", f"coord{k}"], "left_semi")
    return rows.select(*pairs.columns)


def sound_pairs(pairs: DataFrame, least: int = 5, shortest: int = 200, segments: DataFrame | None = None, sites: DataFrame | None = None, pad: int = 10_000, overlap: int = 20, gap: int = 1000, repeats: float = 0.7, match: int = 5) -> DataFrame:
    """The whole filter of pairs (chrom1..clip2, n, offset, seq, source, pe): source is split, pe or ds; pe says that read pairs support it too.

    Enough support; not short on one chromosome; read bases that both ends claim
    at most ``overlap``, bases between them at most ``gap``. Split pairs that no
    read pair supports need a match (the upper-case run of seq) of enough
    letters, of which short repeats take no more than a share. Both ends lie in
    merged segments widened by pad, and one end of a ds pair is among the sites
    (chrom, coord, clip). Missing segments or sites aren't asked for.
    """
    from circlet.functions.text import first_upper_run, repeat_share

    by_sequence = (F.col("source") == "split") & ~F.coalesce(F.col("pe"), F.lit(False))
    run = F.coalesce(first_upper_run(F.col("seq")), F.lit(""))
    offset = F.coalesce(F.col("offset"), F.lit(0))
    rows = filter_pairs(pairs.where((offset <= overlap) & (offset >= -gap)), least, shortest, segments, pad)
    rows = rows.where(~by_sequence | ((F.length(run) >= match) & (repeat_share(run) <= repeats)))
    if sites is None:
        return rows
    known = sites.select("chrom", "coord", "clip").distinct().withColumn("_k", F.lit(True))
    for k in (1, 2):
        rows = rows.join(known.toDF(f"chrom{k}", f"coord{k}", f"clip{k}", f"_k{k}"), [f"chrom{k}", f"coord{k}", f"clip{k}"], "left")
    rows = rows.where((F.col("source") != "ds") | F.col("_k1").isNotNull() | F.col("_k2").isNotNull())
    return rows.select(*pairs.columns)


def discordant_links(reads: DataFrame, max_insert: int = 450, min_mapq: int = 5) -> DataFrame:
    """Links (chrom1..clip2, rid, bc) of the read pairs that discordant() finds, each pair once: a mate on + points right of its end (clip R), one on - left of its start.

    A read says where its mate begins but not where it stops, so a mate's end is taken at the read's own length.
    """
    from .reads import discordant

    bit = lambda n: F.col("flag").bitwiseAND(n) != 0
    length = F.col("stop") - F.col("start")
    end = lambda chrom, start, back: F.struct(chrom.alias("chrom"), F.when(back, start).otherwise(start + length - 1).alias("coord"), F.when(back, "L").otherwise("R").alias("clip"))
    rows = discordant(reads, max_insert, min_mapq).select(F.xxhash64("qname").alias("rid"), F.col("cb").alias("bc"), end(F.col("chrom"), F.col("start"), bit(16)).alias("x"), end(F.col("mate_chrom"), F.col("mate_start"), bit(32)).alias("y"))
    both = rows.select("rid", "bc", F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
    once = both.groupBy("rid").agg(F.min(F.struct("x", "y", "bc")).alias("l"))
    return once.select(*[F.col(f"l.{s}.{c}").alias(f"{c}{k}") for k, s in ((1, "x"), (2, "y")) for c in ("chrom", "coord", "clip")], "rid", "l.bc")


def nearest_strong_clip(boundaries: DataFrame, sites: DataFrame, reach: int = 10_000) -> DataFrame:
    """For each boundary (chrom, coord, clip) the site of its side with most clips within reach; nearest, then smallest, of equals."""
    near = sites.select("chrom", "clip", F.col("coord").alias("at"), "n").withColumn("_band", F.floor(F.col("at") / (reach + 1)))
    met = band(boundaries, reach + 1).join(near, ["chrom", "clip", "_band"]).where(F.abs(F.col("coord") - F.col("at")) <= reach)
    return met.groupBy("chrom", "coord", "clip").agg(F.max_by("at", F.struct("n", -F.abs(F.col("coord") - F.col("at")), -F.col("at"))).alias("at"), F.max("n").alias("n"))


def merge_evidence(rows: DataFrame) -> DataFrame:
    """Evidence of several sources for each junction: distinct reads, the first barcode of each, the best source's strongest row.

    rows: junction, source (smaller is better), n, rid, bc. Count is the number of distinct reads.
    """
    reads = rows.where("rid is not null").groupBy("junction", "rid").agg(F.min_by(F.col("bc"), F.struct(F.col("bc").isNull(), "source", "bc")).alias("bc"))
    reads = reads.groupBy("junction").agg(F.count("*").alias("reads"), F.count_distinct("bc").alias("barcodes"))
    best = rows.groupBy("junction").agg(F.max_by("source", F.struct(-F.col("source"), "n")).alias("source"), F.max_by("n", F.struct(-F.col("source"), "n")).alias("top"), F.sum("n").alias("total"))
    return best.join(reads, "junction", "left").select("junction", "source", "top", F.coalesce("reads", "total").alias("n"), F.coalesce("barcodes", F.lit(0)).alias("barcodes"))


PAIR = ["chrom1", "coord1", "clip1", "chrom2", "coord2", "clip2"]


def merge_pairs(*sources: DataFrame) -> DataFrame:
    """Pairs of several sources, the first the most trusted, as one row for each two ends in ascending order: n, offset, seq, pe, source, reads.

    sources: chrom1..clip2, n, offset, seq, pe (read pairs support it), source,
    reads (array of structs rid, bc). Reads are counted once each, with their
    first barcode in order of the sources; a pair of which no source names a read
    counts the sum of n. offset, seq and source are those of the strongest row of
    its first source; pe is true if it is anywhere. Reads are merged one by one
    before they are gathered, so what is gathered are the reads of a pair, each once.
    """
    rows = None
    for k, df in enumerate(sources):
        own = df.select(*PAIR, F.col("n").cast("long").alias("n"), F.col("offset").cast("long").alias("offset"), "seq", "pe", "source", "reads", F.lit(k).alias("_p"))
        rows = own if rows is None else rows.unionByName(own)
    a, b = (F.struct(*[F.col(f"{c}{k}").alias(c) for c in ("chrom", "coord", "clip")]) for k in (1, 2))
    rows = rows.select(F.least(a, b).alias("_a"), F.greatest(a, b).alias("_b"), "n", "offset", "seq", "pe", "source", "reads", "_p")
    key = ["_a", "_b"]
    each = rows.select(*key, "_p", "n", F.explode("reads").alias("r")).select(*key, "_p", "n", "r.rid", F.when(~F.trim("r.bc").isin("", "None", "nan"), F.trim("r.bc")).alias("bc")).where("rid is not null")
    one = each.groupBy(*key, "rid").agg(F.min_by("bc", F.struct(F.col("bc").isNull(), "_p", -F.col("n"), "bc")).alias("bc"))
    held = one.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("rid", "bc"))).alias("reads"))
    best = F.max_by(F.struct("offset", "seq", "source"), F.struct(-F.col("_p"), "n", -F.col("offset"), "seq"))
    known = rows.groupBy(*key).agg(best.alias("_m"), F.sum("n").alias("_n"), F.bool_or(F.coalesce("pe", F.lit(False))).alias("pe"))
    out = known.join(held, key, "left")
    empty = F.array().cast(held.schema["reads"].dataType)
    return out.select(*[F.col(f"{k}.{c}").alias(f"{c}{n}") for n, k in ((1, "_a"), (2, "_b")) for c in ("chrom", "coord", "clip")], F.coalesce(F.size("reads").cast("long"), "_n").alias("n"), "_m.offset", "_m.seq", "pe", "_m.source", F.coalesce("reads", empty).alias("reads"))


def barcodes_of(reads):
    """The barcodes of a pair's reads in their order, nulls among them; an empty array if no read has one."""
    return F.when(F.exists(reads, lambda r: r["bc"].isNotNull()), F.transform(reads, lambda r: r["bc"])).otherwise(F.array().cast("array<string>"))


def paired_ends(sites: DataFrame, reads: DataFrame, length: int = 500, least: int = 2) -> DataFrame:
    """Pairs of sites (chrom1..clip2, n, reads) that reads of no proper pair share: such reads (chrom, start, stop, qname, cb, flag) lie in the ``length`` bases inside each site.

    n counts the first site's alignments whose name the second site has too, so a
    name that is there twice counts twice. Sites closer than length on one
    chromosome, or with fewer than ``least`` alignments, have no pairs.
    """
    from .intervals import overlap_join

    site = F.struct("chrom", "coord", "clip")
    left = F.col("clip") == "L"
    spans = sites.select("chrom", F.when(left, F.col("coord")).otherwise(F.greatest(F.col("coord") - length, F.lit(0))).alias("start"), F.when(left, F.col("coord") + length).otherwise(F.col("coord")).alias("stop"), site.alias("site")).distinct()
    improper = reads.where(F.col("flag").bitwiseAND(2) == 0).select("chrom", "start", "stop", "qname", "cb")
    met = overlap_join(spans, improper).select("site", F.col("r_qname").alias("qname"), F.col("r_cb").alias("bc"))
    many = met.groupBy("site").agg(F.count("*").alias("_k")).where(F.col("_k") >= least).select("site")
    met = met.join(many, "site", "left_semi")
    other = met.groupBy("site", "qname").agg(F.max("bc").alias("_bc")).select(F.col("site").alias("other"), "qname", "_bc")
    far = (F.col("site.chrom") != F.col("other.chrom")) | (F.abs(F.col("site.coord") - F.col("other.coord")) >= length)
    both = met.join(other, "qname").where((F.col("site") < F.col("other")) & far)
    out = both.groupBy("site", "other").agg(F.count("*").alias("n"), F.array_sort(F.collect_set(F.struct(F.xxhash64("qname").alias("rid"), F.coalesce("bc", "_bc").alias("bc")))).alias("reads")).where(F.col("n") >= least)
    return out.select(*[F.col(f"{k}.{c}").alias(f"{c}{n}") for n, k in ((1, "site"), (2, "other")) for c in ("chrom", "coord", "clip")], "n", "reads")


def drop_listed(sites: DataFrame, listed: DataFrame, pad: int = 100) -> DataFrame:
    """Sites (chrom, coord, clip) away from the listed intervals by more than pad."""
    from .intervals import clear_of

    rows = sites.withColumns({"start": F.col("coord"), "stop": F.col("coord") + 1})
    wide = listed.select("chrom", (F.col("start") - pad).alias("start"), (F.col("stop") + pad).alias("stop"))
    return clear_of(rows, wide, ["chrom", "coord", "clip"]).select(*sites.columns)


def pairs_by_end(pairs: DataFrame, regions: DataFrame, pad: int = 0, keep: bool = True) -> DataFrame:
    """Pairs of which either end lies in a region widened by pad (keep), or neither."""
    from .intervals import overlap_join

    wide = regions.select("chrom", (F.col("start") - pad).alias("start"), (F.col("stop") + pad).alias("stop"))
    ends = pairs.select(F.col("chrom1").alias("chrom"), F.col("coord1").alias("coord")).union(pairs.select("chrom2", "coord2")).distinct()
    hit = overlap_join(ends.withColumns({"start": F.col("coord"), "stop": F.col("coord") + 1}), wide).select("chrom", "coord").distinct().withColumn("_hit", F.lit(True))
    out = pairs
    for k in (1, 2):
        out = out.join(hit.toDF(f"chrom{k}", f"coord{k}", f"_hit{k}"), [f"chrom{k}", f"coord{k}"], "left")
    either = F.coalesce("_hit1", F.lit(False)) | F.coalesce("_hit2", F.lit(False))
    return out.where(either if keep else ~either).select(*pairs.columns)


def stratified_sample(sites: DataFrame, value: str, strata: int, each: int, seed: int = 1) -> DataFrame:
    """At most ``each`` rows of every one of ``strata`` equal parts of the order of value, by hash. For tables of top sites, whose size is bounded."""
    part = F.ntile(strata).over(Window.orderBy(value, "chrom", "coord", "clip"))
    name = F.md5(F.concat_ws(":", F.lit(str(seed)), "chrom", F.col("coord").cast("string"), "clip"))
    rank = F.row_number().over(Window.partitionBy("_part").orderBy(name))
    return sites.withColumn("_part", part).withColumn("_rn", rank).where(F.col("_rn") <= each).drop("_part", "_rn")
