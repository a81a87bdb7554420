"""The de novo run and the targeted search, composed of the operators; each step is a stage on disk."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from circlet.operators import bins, boundaries, breakpoints, cells, copynumber, graph, intervals, pairing, reads, refine, segmentation, singlecell, splitreads
from circlet.sources.sinks import Stages, run_stats
from circlet.sources.staging import stage


@dataclass(frozen=True)
class Parameters:
    width: int = 10_000
    min_mapq: int = 20
    max_nm: int = 3
    least_cn: float = 5.0
    least_clips: int = 3
    top_sites: int = 500
    clean_share: float = 0.2
    least_pairs: int = 2
    estimate_from: int = 500
    shortest: int = 500
    max_insert: int = 0
    edge_gap: int = 350
    edge_support: int = 2
    snap: int = 150
    merge: int = 2
    match: str = "fuzzy"
    seed: int = 5
    knn: int = 3
    interior_share: float = 0.5
    most_nodes: int = 400
    second_share: float = 0.85
    least_score: float = 4.0
    copy_overlap: float = 0.95
    junction_window: int = 200
    junction_reads: int = 5
    jcs: float = 0.5


#: Upper bound of an insert where no proper pair shows it: 300 and three deviations of 50.
USUAL_INSERT = 450
PAIR = ["chrom1", "coord1", "clip1", "chrom2", "coord2", "clip2"]
WHERE = ["chrom", "coord", "clip"]


def _copy_number(counts: DataFrame, bias: DataFrame | None, p: Parameters) -> DataFrame:
    """Copy number of bins, against their bias (chrom, start, gc, mappability) where that is given."""
    if bias is None:
        return bins.copy_number(counts)
    known = counts.join(bins.mean_bias(bias, p.width), ["chrom", "coord"])
    return copynumber.normalise(known, ["gc", "mappability"]).select("chrom", "coord", "n", "cn")


def _most_insert(good: DataFrame, p: Parameters) -> DataFrame:
    """One row, upper: the longest insert of a sound pair, as given or from the proper pairs."""
    if p.max_insert:
        return good.sparkSession.createDataFrame([(float(p.max_insert),)], "upper double")
    bit = lambda n: F.col("flag").bitwiseAND(n) != 0
    proper = good.where(bit(2) & ~bit(16) & (F.col("tlen") > 0) & (F.col("tlen") < 10_000))
    return reads.insert_size(proper, "qname", 5_000).select(F.coalesce(F.col("upper"), F.lit(float(USUAL_INSERT))).alias("upper"))


def _amplified(cn: DataFrame, sites: DataFrame, p: Parameters) -> DataFrame:
    """Amplified segments (seg, chrom, start, stop, cn, clip_left, clip_right): segmented, filtered by size, ends at the strongest clip nearby."""
    smooth = bins.smooth_outliers(cn.withColumn("x", F.log2(F.col("cn") / 2))).withColumn("x", F.col("smooth"))
    cbs = segmentation.cbs_segments(smooth.select("chrom", "coord", "n", "x"), p.width)
    amp = cbs.withColumn("cn", 2 * F.pow(F.lit(2.0), F.col("x"))).where(F.col("cn") >= p.least_cn).select("chrom", "start", "stop", "cn")
    amp = stage(intervals.drop_small_rois(amp, p.width).withColumn("seg", F.xxhash64("chrom", "start")), "amplified")
    ends = amp.select("chrom", F.col("start").alias("coord"), F.lit("L").alias("clip")).union(amp.select("chrom", "stop", F.lit("R")))
    near = breakpoints.nearest_strong_clip(ends, sites, p.width)
    for clip, col, name in boundaries.SIDES:
        to = near.where(F.col("clip") == clip).select("chrom", F.col("coord").alias(col), F.col("at").alias("_at"), F.col("n").alias(f"clip_{name}"))
        amp = amp.join(to, ["chrom", col], "left").withColumn(col, F.coalesce("_at", col)).withColumn(f"clip_{name}", F.coalesce(f"clip_{name}", F.lit(0))).drop("_at")
    return amp.where("start < stop").select("seg", "chrom", "start", "stop", "cn", "clip_left", "clip_right")


def _near_amplified(sites: DataFrame, amp: DataFrame, p: Parameters) -> DataFrame:
    """Sites inside amplified sequence, or within a bin of it."""
    return sites.join(intervals.padded_membership(sites.select(*WHERE), amp, p.width).select(*WHERE), WHERE, "left_semi")


def _clean(sites: DataFrame, good: DataFrame, p: Parameters) -> DataFrame:
    """Sites of whose depth clips are a share, with that depth."""
    return reads.depth_at(sites, good, p.clean_share).where("clean")


def _pairs(junctions: DataFrame, sites: DataFrame, edges: DataFrame, amp: DataFrame, good: DataFrame, p: Parameters) -> DataFrame:
    """Pairs (chrom1..clip2, n, offset, seq, pe, source, reads) of all evidence, each two ends once: split reads and what sequence shows among the sites (split), read pairs that boundaries of amplified sequence share (pe), and discordant edges (ds).

    Clips of both ends add to what split reads count, and close pairs are one.
    Edges go to the strongest pair beside them and mark it. A pair counts the
    reads of all its evidence, each once.
    """
    split = pairing.recount(junctions.select(*PAIR, "n", "offset", "seq", "reads"), good, method=p.match)
    by_seq = pairing.pairs_by_sequence(sites.select(*WHERE), good, junctions, seed=p.seed, method=p.match)
    both = stage(split.unionByName(by_seq), "matched")
    found = stage(pairing.merged(both, p.merge), "merged")
    code = good.where("cb is not null").groupBy(F.xxhash64("qname").alias("rid")).agg(F.min("cb").alias("bc"))
    named = found.select(*PAIR, F.explode("rids").alias("rid")).distinct().join(code, "rid", "left").groupBy(*PAIR).agg(F.collect_list(F.struct("rid", "bc")).alias("reads"))
    own = found.drop("rids").join(named, PAIR).withColumns({"pe": F.lit(False), "source": F.lit("split")})
    ends = amp.select("chrom", F.col("start").alias("coord"), F.lit("L").alias("clip")).union(amp.select("chrom", "stop", F.lit("R")))
    said = {"offset": F.lit(0), "seq": F.lit(""), "pe": F.lit(True)}
    shared = breakpoints.paired_ends(ends, good, p.shortest, p.least_pairs).withColumns(said | {"source": F.lit("pe")})
    to = breakpoints.snap_two_ended(edges, found.select(*PAIR, "n"), p.snap)
    snapped = to.select(F.col("chrom1"), F.col("to1").alias("coord1"), "clip1", "chrom2", F.col("to2").alias("coord2"), "clip2", F.col("support").alias("n"))
    alone = snapped.withColumns(said | {"source": F.lit("ds"), "reads": F.array().cast(shared.schema["reads"].dataType)})
    return breakpoints.merge_pairs(own, shared, alone)


def _segments(v: DataFrame, pairs: DataFrame, amp: DataFrame, cn: DataFrame, sites: DataFrame, p: Parameters) -> DataFrame:
    """Segments of the graph with their copy number, those whose inside isn't amplified left out."""
    regions = intervals.merge_bed(amp).select("chrom", "start", "stop")
    ends = v.select(*WHERE).join(sites.select(*WHERE, "n"), WHERE, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    found = segmentation.graph_segments(ends, pairs, regions, p.knn).withColumn("seg", F.xxhash64("chrom", "start", "stop")).withColumn("cn", F.lit(None).cast("double"))
    counted = segmentation.add_cn(found, amp, cn, p.width, p.width)
    return refine.interior_filter(counted, cn, p.least_cn, p.interior_share).select("chrom", "start", "stop", "cn")


def _find(v: DataFrame, pairs: DataFrame, segments: DataFrame, p: Parameters) -> DataFrame:
    """Segments of the rings and lines that stand for the others in the graph of these vertices, pairs and segments.

    Whether the pairs are pruned depends on two counts, which are taken while the plan is made.
    """
    edges = graph.graph_edges(v, pairs, segments)
    if v.count() > p.most_nodes and pairs.count() > p.most_nodes:
        edges = graph.prune_neighbours(edges)
    edges = stage(edges, "edges")
    paths = stage(graph.find_paths(edges, graph.label_components(edges)), "paths")
    chosen = stage(graph.representatives(paths, edges, v), "chosen")
    return stage(graph.path_segments(chosen, v, edges), "path-segments")


def de_novo(alignments: DataFrame, path: str, p: Parameters = Parameters(), bias: DataFrame | None = None, listed: DataFrame | None = None, genes: DataFrame | None = None) -> dict[str, DataFrame]:
    """Amplified segments, breakpoint pairs, rings and lines and the rings' scores from alignments (the schema of sources.alignments, with dup).

    bias: chrom, start, gc, mappability; listed: chrom, start, stop of regions
    that aren't trusted; genes: chrom, start, stop, name. Each is optional. A
    step is read if it was made from the same input with the same parameters.
    """
    st = Stages(alignments.sparkSession, path, {"alignments": alignments, "bias": bias, "listed": listed, "genes": genes}, asdict(p))
    good = st.step("reads", lambda: reads.passing(alignments, p.min_mapq, p.max_nm), ("input:alignments",), ("min_mapq", "max_nm"))
    insert = st.step("insert", lambda: _most_insert(good, p), ("reads",), ("max_insert",))

    def discordant() -> DataFrame:
        upper = int(insert.first().upper)
        return breakpoints.cluster_links(breakpoints.discordant_links(alignments.where("not dup"), upper), p.edge_gap, p.edge_support)

    edges = st.step("discordant", discordant, ("input:alignments", "insert"), ("edge_gap", "edge_support"))
    raw = st.step("bins_raw", lambda: _copy_number(bins.bin_counts(good, p.width), bias, p), ("reads", "input:bias"), ("width",))

    def trusted() -> DataFrame:
        if listed is None:
            return raw
        keep = refine.protected_bins(raw, edges, listed).withColumn("_keep", F.lit(True))
        both = bins.reset_bins(raw, listed, p.width).withColumnRenamed("cn", "_reset").join(raw.select("chrom", "coord", "cn"), ["chrom", "coord"]).join(keep, ["chrom", "coord"], "left")
        return both.withColumn("cn", F.when(F.col("_keep"), F.col("cn")).otherwise(F.col("_reset"))).drop("_reset", "_keep")

    cn = st.step("bins", trusted, ("bins_raw", "discordant", "input:listed"), ("width",))

    def clipped() -> DataFrame:
        ends = good.withColumns({"clip_l": F.col("cigar").rlike("^[0-9]+[SH]"), "clip_r": F.col("cigar").rlike("[0-9]+[SH]$")})
        counts = reads.clip_counts(reads.clip_sites(ends))
        one = lambda k: edges.select(F.col(f"chrom{k}").alias("chrom"), F.col(f"coord{k}").alias("coord"), F.col(f"clip{k}").alias("clip"), "support")
        rows = breakpoints.rescue_near_edge(counts, one(1).union(one(2)), p.least_clips, p.snap, p.edge_support)
        return rows if listed is None else breakpoints.drop_listed(rows, listed)

    clips = st.step("clips", clipped, ("reads", "discordant", "input:listed"), ("least_clips", "snap", "edge_support"))
    called = st.step("called", lambda: _amplified(cn, clips, p), ("bins", "clips"), ("width", "least_cn"))

    def mended() -> DataFrame:
        out, moved = boundaries.refine_boundaries(called, edges, cn, 3 * p.width, p.edge_support, merge=p.snap, width=p.width)
        edge = moved.select(F.lit(False).alias("segment"), *boundaries.EDGE, "support")
        return out.withColumn("segment", F.lit(True)).unionByName(edge, allowMissingColumns=True)

    both = st.step("mended", mended, ("called", "discordant", "bins"), ("width", "edge_support", "snap"))
    amp = both.where("segment").drop("segment", *boundaries.EDGE, "support")
    edges = both.where("not segment").select(*boundaries.EDGE, "support")
    sites = st.step("sites", lambda: _clean(breakpoints.top_n(_near_amplified(clips, amp, p), p.top_sites), good, p), ("clips", "mended", "reads"), ("width", "top_sites", "clean_share"))

    def junctions() -> DataFrame:
        split = good.where("sa is not null").withColumns({"reverse": F.col("flag").bitwiseAND(16) != 0, "bc": F.col("cb")})
        found = splitreads.count_junctions(splitreads.split_junctions(split))
        found = found if listed is None else breakpoints.pairs_by_end(found, listed, keep=False)
        return breakpoints.pairs_by_end(found, amp, p.width)

    split = st.step("junctions", junctions, ("reads", "mended", "input:listed"), ("width",))

    def paired() -> DataFrame:
        rows = _pairs(split, sites, edges, amp, good, p).withColumn("id", F.xxhash64(*PAIR))
        return refine.snap_ds_pairs(rows, amp, cn, clips).drop("id")

    pairs = st.step("pairs", paired, ("junctions", "sites", "mended", "clips", "reads", "bins"), ("match", "seed", "merge", "snap", "shortest", "least_pairs"))

    def kept_pairs() -> DataFrame:
        level = segmentation.support_threshold(pairs.where("source <> 'ds'")) if pairs.count() >= p.estimate_from else None
        known = sites.select(*WHERE).union(split.select(*[F.col(f"{c}1").alias(c) for c in WHERE])).union(split.select(*[F.col(f"{c}2").alias(c) for c in WHERE])).union(amp.select("chrom", "start", F.lit("L"))).union(amp.select("chrom", "stop", F.lit("R")))
        rows = breakpoints.sound_pairs(pairs, round(level or p.least_pairs), p.shortest, amp, known.distinct())
        return rows if listed is None else breakpoints.pairs_by_end(rows, listed, keep=False)

    kept = st.step("pairs_kept", kept_pairs, ("pairs", "sites", "junctions", "mended", "input:listed"), ("estimate_from", "least_pairs", "shortest"))
    v = st.step("vertices", lambda: boundaries.vertex_table(amp, kept, p.least_cn), ("mended", "pairs_kept"), ("least_cn",))
    segments = st.step("segments", lambda: _segments(v, kept, amp, cn, clips, p), ("vertices", "pairs_kept", "mended", "bins", "clips"), ("knn", "least_cn", "interior_share", "width"))
    paths = st.step("paths", lambda: _find(v, kept, segments, p), ("vertices", "pairs_kept", "segments"), ("most_nodes",))
    rings = _rings(paths.where("kind = 'ring'"))
    score = lambda found: graph.score_rings(graph.segment_contrast(segmentation.add_cn(found.withColumn("seg", F.xxhash64("ring", "idx")), amp, cn, p.width, p.width).drop("seg"), cn, p.width))
    first = st.step("scores_first", lambda: score(rings), ("paths", "mended", "bins"), ("width",))

    def second() -> DataFrame:
        """Rings that are found on the chromosomes of the best ones alone, if they are new."""
        there = graph.second_search_chroms(rings, first, p.second_share)
        on = lambda df, col: df.join(there.withColumnRenamed("chrom", col), col, "left_semi").select(*df.columns)
        again = _rings(_find(on(v, "chrom"), on(on(kept, "chrom1"), "chrom2"), on(segments, "chrom"), p).where("kind = 'ring'"))
        return rings.unionByName(graph.new_circles(again, rings).withColumn("ring", F.concat("ring", F.lit("b"))))

    every = st.step("rings", second, ("paths", "scores_first", "vertices", "pairs_kept", "segments"), ("second_share", "most_nodes"))

    def scored() -> DataFrame:
        cut = every.groupBy("ring").agg(F.max("truncated").alias("truncated"))
        out = score(every).where(F.col("score") >= p.least_score).join(cut, "ring")
        if genes is None:
            return out
        named = _with_genes(every, genes, ["ring", "idx"]).withColumn("genes", F.when(F.col("genes") != "", F.col("genes")))
        return out.join(singlecell.gene_numbers(named, ["genes"]), "ring", "left")

    scores = st.step("scores", scored, ("rings", "mended", "bins", "input:genes"), ("width", "least_score"))
    sound = every.join(scores.select("ring"), "ring", "left_semi")
    picked = st.step("picked", lambda: graph.pick_distinct(scores, sound, p.copy_overlap), ("rings", "scores"), ("copy_overlap",))
    lines = _rings(paths.where("kind = 'line'")).withColumnRenamed("ring", "line")
    out = {"amplified": amp, "sites": sites, "discordant": edges, "pairs": kept, "segments": segments, "rings": every, "lines": lines, "scores": scores, "picked": picked}
    if genes is not None:
        out["annotated"] = st.step("annotated", lambda: _with_genes(sound, genes, ["ring", "idx"]), ("rings", "scores", "input:genes"))
        out["lines"] = st.step("lines_annotated", lambda: _with_genes(lines, genes, ["line", "idx"]), ("paths", "input:genes"))
    out["track"] = reads.bedgraph(clips)
    out["alignments"] = pairing.junction_alignments(kept.where("source = 'split'"), good)
    stats = run_stats(reads=good, amplified=amp, sites=sites, pairs=kept, rings=every, lines=lines, truncated=every.where("truncated"))
    return out | singlecell.dedup_audit(picked, every) | {"stats": stats, "made": alignments.sparkSession.createDataFrame([(name,) for name in st.made], "step string")}


def _with_genes(segments: DataFrame, genes: DataFrame, key: list[str]) -> DataFrame:
    """segments with the names of the genes on them, an empty list where there are none."""
    names = intervals.map_all(segments, genes, key, "name").withColumnRenamed("name", "genes")
    return segments.join(names, key, "left").withColumn("genes", F.coalesce("genes", F.lit("")))


def _rings(segments: DataFrame) -> DataFrame:
    return segments.select(F.concat(F.lit("ring"), F.hex(F.xxhash64("path"))).alias("ring"), F.col("at").alias("idx"), "chrom", "start", "stop", "strand", F.coalesce("splits", F.lit(0.0)).alias("splits"), "cn", "truncated")


def targeted(known: DataFrame, alignments: DataFrame, p: Parameters = Parameters()) -> DataFrame:
    """Junction concordance of known rings (ring, idx, chrom, start, stop, strand) in alignments."""
    return classify(extract(known), evidence(alignments, p), p)


def extract(known: DataFrame) -> DataFrame:
    """The junctions of known rings."""
    return cells.ring_junctions(known).drop("single")


def evidence(alignments: DataFrame, p: Parameters = Parameters()) -> DataFrame:
    """Pairs of split reads with their reads."""
    good = singlecell.distinct_reads(reads.passing(alignments, p.min_mapq, p.max_nm))
    split = good.where("sa is not null").withColumns({"reverse": F.col("flag").bitwiseAND(16) != 0, "bc": F.col("cb")})
    return splitreads.count_junctions(splitreads.split_junctions(split))


def classify(junctions: DataFrame, pairs: DataFrame, p: Parameters = Parameters()) -> DataFrame:
    """Which rings have enough of their junctions among the pairs."""
    matched = breakpoints.best_known(junctions, pairs.select(*PAIR, "n"), p.junction_window)
    return cells.concordance(junctions.select(F.col("ring").alias("circle"), F.col("idx").alias("junction")), matched.select(F.col("ring").alias("circle"), F.col("idx").alias("junction"), "n"), p.junction_reads, p.jcs)


def targeted_amplicons(known: DataFrame, alignments: DataFrame, path: str, p: Parameters = Parameters()) -> dict[str, DataFrame]:
    """The de novo run on the chromosomes of known rings: its segments or, where it calls none, the known ones with their copy number and clips; and the concordance of the rings."""
    there = known.select("chrom").distinct()
    own = alignments.join(there, "chrom", "left_semi")
    found = de_novo(own, path, p)
    called = found["amplified"].select("chrom", "start", "stop", "cn", F.col("clip_left").cast("long").alias("clip_left"), F.col("clip_right").cast("long").alias("clip_right"))
    segments = singlecell.called_or_known(called, known, targeted_bins(own, known, p), found["sites"])
    return found | {"segments": segments, "concordance": targeted(known, own, p)}


def targeted_bins(alignments: DataFrame, known: DataFrame, p: Parameters = Parameters()) -> DataFrame:
    """Copy number of bins against those outside the known segments."""
    return bins.targeted_copy_number(bins.bin_counts(reads.passing(alignments, p.min_mapq, p.max_nm), p.width), known.select("chrom", "start", "stop").distinct(), p.width)
