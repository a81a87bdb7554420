"""Single cells and targeted search: support matrices, rules and junction concordance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .intervals import classes, clear_of, overlap_join


def concordance(refs: DataFrame, matched: DataFrame, least: int = 5, threshold: float = 0.5) -> DataFrame:
    """Junction concordance of each circle: junctions (circle, junction) and their support (circle, junction, n)."""
    best = matched.groupBy("circle", "junction").agg(F.max("n").alias("n"))
    rows = refs.distinct().join(best, ["circle", "junction"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    ok = F.col("n") >= least
    out = rows.groupBy("circle").agg(F.count_distinct("junction").alias("total"), F.sum(F.when(ok, 1).otherwise(0)).alias("validated"), F.sum(F.when(ok, F.col("n")).otherwise(0)).alias("support"))
    return out.withColumn("jcs", F.col("validated") / F.col("total")).withColumn("detected", F.col("jcs") >= threshold)


def ring_junctions(rings: DataFrame) -> DataFrame:
    """Junctions between each segment and the next, the last one's next being the first.

    A segment is left at its stop (clip R) on +, at its start (L) on -; the next is entered at its start (L) on +, its stop (R) on -.
    """
    w = Window.partitionBy("ring").orderBy("idx")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    plus = F.col("strand") == "+"
    rows = rings.withColumn("_in", F.struct("chrom", F.when(plus, F.col("start")).otherwise(F.col("stop")).alias("coord"), F.when(plus, "L").otherwise("R").alias("clip")))
    rows = rows.withColumn("_next", F.coalesce(F.lead("_in").over(w), F.first("_in").over(whole)))
    out = F.when(plus, F.col("stop")).otherwise(F.col("start"))
    return rows.select("ring", "idx", F.col("chrom").alias("chrom1"), out.alias("coord1"), F.when(plus, "R").otherwise("L").alias("clip1"), F.col("_next.chrom").alias("chrom2"), F.col("_next.coord").alias("coord2"), F.col("_next.clip").alias("clip2"), (F.count("*").over(whole) == 1).alias("single"))


def segment_summary(rings: DataFrame) -> DataFrame:
    """Copy number of each ring's segments; a lone segment has deviation 0."""
    return rings.groupBy("ring").agg(F.count("*").alias("segments"), F.sum("cn").alias("cn_sum"), F.avg("cn").alias("cn_mean"), F.median("cn").alias("cn_median"), F.coalesce(F.stddev_samp("cn"), F.lit(0.0)).alias("cn_sd"), F.min("cn").alias("cn_min"), F.max("cn").alias("cn_max"))


def weighted_cn(segments: DataFrame, bins: DataFrame, width: int = 10_000) -> DataFrame:
    """Copy number of segments from the bins they cover, weighted by shared bases."""
    rows = bins.select("chrom", F.col("coord").alias("start"), (F.col("coord") + width).alias("stop"), F.col("cn").alias("bin_cn"))
    met = overlap_join(segments, rows)
    share = F.least("stop", "r_stop") - F.greatest("start", "r_start")
    return met.groupBy("seg").agg((F.sum(share * F.col("r_bin_cn")) / F.sum(share)).alias("cn"), F.count("*").alias("bins"))


def support_matrix(rows: DataFrame, row: str, column: str, value: str, names: list[str]) -> DataFrame:
    """Wide table of sums, zero where there is none; names fixes the columns, so nothing is collected to find them."""
    return rows.groupBy(row).pivot(column, names).agg(F.sum(value)).na.fill(0)


def allele_ratio(support: DataFrame, normal: DataFrame) -> DataFrame:
    """support and distinct normal reads by (cell, junction), and support / (support + normal + 1)."""
    a = support.groupBy("cell", "junction").agg(F.count_distinct("rid").alias("a"))
    b = normal.groupBy("cell", "junction").agg(F.count_distinct("rid").alias("b"))
    out = a.join(b, ["cell", "junction"], "full").na.fill(0, ["a", "b"])
    return out.withColumn("ratio", F.col("a") / (F.col("a") + F.col("b") + 1))


def ring_quartile(cells: DataFrame, value: str = "rate") -> DataFrame:
    """cells with q1: the lower quartile of value over cells with direct reads, by ring; null where a ring has none."""
    q = cells.where(F.col("direct") >= 1).groupBy("ring").agg(F.percentile(value, 0.25).alias("q1"))
    return cells.join(q, "ring", "left")


def assign(cells: DataFrame) -> DataFrame:
    """high: direct reads; probable: weak evidence, or a covered profile above the quartile; else none."""
    covered = (F.col("rate") >= F.col("q1")) & (F.col("enrichment") >= 2) & (F.col("cosine") >= 0.96) & (F.col("covered") >= 1)
    return cells.withColumn("call", F.when(F.col("direct") >= 1, "high").when(F.col("weak") >= 0.3, "probable").when(covered, "probable").otherwise("none"))


def weakest_path(evidence: DataFrame) -> DataFrame:
    """The strongest kind of evidence of each read for a junction: split 1, discordant 0.7, clip 0.3; summed by cell."""
    weight = F.when(F.col("kind") == "split", 1.0).when(F.col("kind") == "discordant", 0.7).when(F.col("kind") == "clip", 0.3).otherwise(0.0)
    best = evidence.groupBy("cell", "junction", "rid").agg(F.max(weight).alias("w"))
    return best.groupBy("cell", "junction").agg(F.sum("w").alias("weak"), F.count("*").alias("reads"))


def flanks(rings: DataFrame) -> DataFrame:
    """Intervals of each segment's own length at both sides that overlap no ring segment."""
    n = F.col("stop") - F.col("start")
    left = rings.select("ring", "idx", F.lit("left").alias("side"), "chrom", F.greatest(F.lit(0), F.col("start") - n).alias("start"), F.col("start").alias("stop"))
    right = rings.select("ring", "idx", F.lit("right").alias("side"), "chrom", F.col("stop").alias("start"), (F.col("stop") + n).alias("stop"))
    both = left.unionByName(right).where("start < stop")
    return clear_of(both, rings.select("chrom", "start", "stop"), ["ring", "idx", "side"])


def class_counts(frags: DataFrame, segments: DataFrame, key: list[str] = ("seg",)) -> tuple[DataFrame, DataFrame]:
    """Fragments by cell and class of segments: cell, seg (the struct of the class's smallest key), times (its number of keys), n; and its members (key, _rep)."""
    rows, members = classes(segments, list(key))
    met = overlap_join(frags.select("cell", "chrom", "start", "stop", "n"), rows)
    return met.groupBy("cell", F.col("r__rep").alias("seg"), F.col("r__times").alias("times")).agg(F.sum("n").alias("n")), members


def fragment_counts(frags: DataFrame, segments: DataFrame, key: list[str] = ("seg",)) -> DataFrame:
    """Fragments by cell and segment."""
    counts, members = class_counts(frags, segments, key)
    return counts.select("cell", F.col("seg").alias("_rep"), "n").join(members, "_rep").select("cell", *key, "n")


def profile_cosine(counts: DataFrame, anchor: DataFrame) -> DataFrame:
    """Cosine of each cell's counts (cell, seg, n) to the anchor's (seg, n). With times in counts a seg stands for so many of the same counts."""
    times = F.col("times") if "times" in counts.columns else F.lit(1)
    # a seg's times are the same in every cell
    weighed = anchor.join(counts.groupBy("seg").agg(F.max(times).alias("_k")), "seg", "left").withColumn("_k", F.coalesce("_k", F.lit(1)))
    size = weighed.agg(F.sqrt(F.sum(F.col("n") * F.col("n") * F.col("_k"))).alias("_a"))
    own = counts.groupBy("cell").agg(F.sqrt(F.sum(F.col("n") * F.col("n") * times)).alias("_c"))
    dot = counts.join(anchor.select("seg", F.col("n").alias("_n")), "seg").groupBy("cell").agg(F.sum(F.col("n") * F.col("_n") * times).alias("_d"))
    return own.join(dot, "cell", "left").crossJoin(F.broadcast(size)).select("cell", F.coalesce(F.try_divide("_d", F.col("_a") * F.col("_c")), F.lit(0.0)).alias("cosine"))


def ratio_index(cells: DataFrame) -> DataFrame:
    """Ratio s / max(s + n, 1) held to [0, 1], and its colour of 100."""
    ratio = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("s") / F.greatest(F.col("s") + F.col("n"), F.lit(1))))
    return cells.withColumn("ratio", ratio).withColumn("colour", (F.bround(99 * F.col("ratio")) + 1).cast("long"))


def interval_reads(segments: DataFrame, reads: DataFrame) -> DataFrame:
    """Distinct reads of each segment, and for each thousand bases."""
    rows, members = classes(segments, ["seg", "start", "stop"])
    found = overlap_join(rows, reads.select("chrom", "start", "stop", "rid").distinct()).groupBy("_rep").agg(F.count_distinct("r_rid").alias("reads"))
    out = members.join(found, "_rep")
    return out.select("seg", "reads", (F.col("reads") * 1000.0 / (F.col("stop") - F.col("start"))).alias("per_kb"))


def annotate_cells(support: DataFrame, strong: int = 2) -> DataFrame:
    """Distinct reads and junctions of each cell, with a status."""
    out = support.groupBy("cell").agg(F.count_distinct("rid").alias("reads"), F.count_distinct("junction").alias("junctions"))
    return out.withColumn("status", F.when(F.col("reads") >= strong, "supported").when(F.col("reads") >= 1, "weak").otherwise("none"))


def ring_counts(frags: DataFrame, segments: DataFrame, flank: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fragments by cell and ring on its segments (_in, and _hit, how many segments have some) and on its flanks (_out). Equal intervals are counted once and weighed by how often a ring has them."""
    counts, members = class_counts(frags, segments, ["ring", "seg"])
    own = members.groupBy("ring", "_rep").agg(F.count("*").alias("_k"))
    met = counts.select("cell", F.col("seg").alias("_rep"), "n").join(own, "_rep")
    inside = met.groupBy("cell", "ring").agg(F.sum(F.col("n") * F.col("_k")).alias("_in"), F.sum("_k").alias("_hit"))
    span = ["chrom", "start", "stop"]
    around = flank.where("start < stop").groupBy("ring", *span).agg(F.count("*").alias("_k"))
    spans = overlap_join(frags.select("cell", *span, "n"), around.select(*span).distinct()).groupBy("cell", *[F.col(f"r_{c}").alias(c) for c in span]).agg(F.sum("n").alias("n"))
    return inside, spans.join(around, span).groupBy("cell", "ring").agg(F.sum(F.col("n") * F.col("_k")).alias("_out"))


def cell_features(frags: DataFrame, segments: DataFrame, flank: DataFrame, cells_: DataFrame) -> DataFrame:
    """Coverage of each cell on a ring's segments: rate per million and kilobase, enrichment over flanks, share covered.

    cells_: cell, total (all fragments of the cell). segments and flank: ring, seg, chrom, start, stop.
    """
    size = segments.groupBy("ring").agg(F.sum(F.col("stop") - F.col("start")).alias("_len"), F.count("*").alias("_k"))
    out_size = flank.groupBy("ring").agg(F.sum(F.col("stop") - F.col("start")).alias("_out_len"))
    inside, outside = ring_counts(frags, segments, flank)
    rows = inside.join(outside, ["cell", "ring"], "left").join(cells_, "cell").join(size, "ring").join(out_size, "ring", "left")
    per = lambda n, length: F.coalesce(F.try_divide(n * 1e9, F.col("total") * length), F.lit(0.0))
    rate, around = per(F.col("_in"), F.col("_len")), per(F.coalesce("_out", F.lit(0)), F.coalesce("_out_len", F.lit(0)))
    return rows.select("cell", "ring", rate.alias("rate"), (F.log1p(rate) - F.log1p(around)).alias("enrichment"), (F.col("_hit") / F.col("_k")).alias("covered"))
