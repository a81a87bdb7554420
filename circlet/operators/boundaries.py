"""Boundaries of amplified segments from discordant ends, and data of plots."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from circlet.sources.staging import stage

from .breakpoints import band
from .intervals import islands, overlap_join


def boundary_support(segments: DataFrame, ends: DataFrame, reach: int = 10_000, weak: int = 1) -> DataFrame:
    """segments (seg, chrom, start, stop, clip_left, clip_right) with each weak boundary moved to the strongest end (chrom, clip, coord, support) within reach."""
    out = segments
    for side, col in (("L", "start"), ("R", "stop")):
        name = "left" if side == "L" else "right"
        near = band(ends.where(F.col("clip") == side).select("chrom", F.col("coord").alias("_at"), "support"), reach + 1, "_at")
        points = segments.where(F.col(f"clip_{name}") <= weak).select("seg", "chrom", F.col(col).alias("_x")).withColumn("_band", F.floor(F.col("_x") / (reach + 1)))
        met = points.join(near, ["chrom", "_band"]).where(F.abs(F.col("_x") - F.col("_at")) <= reach)
        best = met.groupBy("seg").agg(F.max_by("_at", F.struct("support", -F.abs(F.col("_x") - F.col("_at")), -F.col("_at"))).alias(f"disc_{name}"))
        out = out.join(best, "seg", "left")
    return out.withColumns({"start": F.coalesce("disc_left", "start"), "stop": F.coalesce("disc_right", "stop")})


def rescue_segments(ends: DataFrame, segments: DataFrame, bins: DataFrame, candidates: int = 5, least_cn: float = 4.5) -> DataFrame:
    """Segments from left and right ends that no segment holds.

    For each left end by descending support the next right ends are tried; the
    first whose bins have a median copy number of at least least_cn and that
    overlaps no segment chosen before is taken. Candidates and their copy number
    are native; the choice goes through one chromosome at a time.
    """
    rows = ends.withColumns({"start": F.col("coord"), "stop": F.col("coord") + 1})
    free = ends.join(overlap_join(rows, segments.select("chrom", "start", "stop")).select("chrom", "clip", "coord").distinct(), ["chrom", "clip", "coord"], "left_anti")
    order = Window.partitionBy("chrom").orderBy("coord")
    rights = free.where("clip = 'R'").withColumn("_rn", F.row_number().over(order)).select("chrom", "_rn", F.col("coord").alias("stop"))
    seen = F.sum(F.when(F.col("clip") == "R", 1).otherwise(0)).over(Window.partitionBy("chrom").orderBy("coord", F.desc("clip")).rowsBetween(Window.unboundedPreceding, 0))
    lefts = free.withColumn("_seen", seen).where("clip = 'L'").select("chrom", F.col("coord").alias("start"), "support", F.explode(F.sequence(F.col("_seen") + 1, F.col("_seen") + candidates)).alias("_rn"))
    pairs = lefts.join(rights, ["chrom", "_rn"]).where("stop > start")
    at = bins.select("chrom", F.col("coord").alias("start"), (F.col("coord") + 1).alias("stop"), "cn")
    cn = overlap_join(pairs.select("chrom", "start", "stop"), at).groupBy("chrom", "start", "stop").agg(F.median("r_cn").alias("cn")).where(F.col("cn") >= least_cn)
    sound = pairs.join(cn, ["chrom", "start", "stop"])

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        taken: list[tuple[int, int]] = []
        out = []
        done = set()
        for r in rows.sort_values(["support", "start", "stop"], ascending=[False, True, True]).itertuples():
            if r.start not in done and all(r.stop <= a or r.start >= b for a, b in taken):
                taken.append((r.start, r.stop))
                done.add(r.start)
                out.append((r.chrom, r.start, r.stop, r.cn))
        return pd.DataFrame(out, columns=["chrom", "start", "stop", "cn"])

    return sound.groupBy("chrom").applyInPandas(run, "chrom string, start long, stop long, cn double")


SIDES = (("L", "start", "left"), ("R", "stop", "right"))
EDGE = ["chrom1", "coord1", "clip1", "chrom2", "coord2", "clip2"]


def _ends(edges: DataFrame, least: int) -> DataFrame:
    """Both ends of each edge of enough support, each with its partner: chrom, coord, clip, support, partner."""
    one = lambda k: F.struct(F.col(f"chrom{k}").alias("chrom"), F.col(f"coord{k}").alias("coord"), F.col(f"clip{k}").alias("clip"))
    both = F.explode(F.array(F.struct(one(1).alias("own"), one(2).alias("partner")), F.struct(one(2).alias("own"), one(1).alias("partner"))))
    return edges.where(F.col("support") >= least).select("support", both.alias("e")).select("e.own.*", "support", "e.partner").distinct()


def _boundaries(segments: DataFrame) -> DataFrame:
    """seg, chrom, clip, at: the two boundaries of each segment."""
    return segments.select("seg", "chrom", F.explode(F.array(*[F.struct(F.lit(clip).alias("clip"), F.col(col).alias("at")) for clip, col, _ in SIDES])).alias("b")).select("seg", "chrom", "b.clip", "b.at")


def _anchored(ends: DataFrame, segments: DataFrame, window: int) -> DataFrame:
    """Ends whose partner is within window of a boundary of its side, with the first and last segment (_first, _last) that has one."""
    near = band(_boundaries(segments), window + 1, "at").select("seg", F.col("chrom").alias("_c"), F.col("clip").alias("_k"), "at", "_band")
    rows = ends.withColumn("_band", F.floor(F.col("partner.coord") / (window + 1)))
    met = rows.join(near, (F.col("partner.chrom") == F.col("_c")) & (F.col("partner.clip") == F.col("_k")) & (rows["_band"] == near["_band"]) & (F.abs(F.col("partner.coord") - F.col("at")) <= window))
    return met.groupBy(*ends.columns).agg(F.min("seg").alias("_first"), F.max("seg").alias("_last"))


def _median_cn(spans: DataFrame, bins: DataFrame, width: int) -> DataFrame:
    """chrom, start, stop of spans with cn, the median copy number of the bins that they touch, and count, the mean of these bins' counts."""
    at = bins.select("chrom", F.col("coord").alias("start"), (F.col("coord") + width).alias("stop"), "cn", "n")
    return overlap_join(spans.select("chrom", "start", "stop").distinct(), at).groupBy("chrom", "start", "stop").agg(F.median("r_cn").alias("_cn"), F.avg("r_n").alias("_count"))


def _move(segments: DataFrame, candidates: DataFrame, name: str, col: str, valid) -> DataFrame:
    """segments with a boundary at its nearest candidate (seg, coord, support, partner, distance), the best supported of equals, if that is valid."""
    best = candidates.groupBy("seg").agg(F.min(F.struct("distance", (-F.col("support")).alias("s"), "coord", "partner")).alias("_b"))
    out = segments.join(best, "seg", "left")
    go = F.col("_b").isNotNull() & valid(F.col("_b.coord"))
    return out.withColumns({
        col: F.when(go, F.col("_b.coord")).otherwise(F.col(col)), f"disc_{name}": F.when(go, -F.col("_b.s")).otherwise(F.col(f"disc_{name}")),
        f"partner_{name}": F.when(go, F.col("_b.partner")).otherwise(F.col(f"partner_{name}")), "source": F.when(go, "PE_boundary").otherwise(F.col("source")), "_moved": go,
    }).drop("_b")


def _near_boundary(ends: DataFrame, segments: DataFrame, clip: str, col: str, of, reach: int) -> DataFrame:
    """Anchored ends of a side within reach of that boundary of a segment that ``of`` picks, anchored by another segment."""
    points = segments.where(of).select("seg", "chrom", "start", "stop", F.col(col).alias("_x")).withColumn("_band", F.floor(F.col(col) / (reach + 1)))
    near = band(ends.where(F.col("clip") == clip), reach + 1).drop("clip")
    met = points.join(near, ["chrom", "_band"]).withColumn("distance", F.abs(F.col("coord") - F.col("_x")))
    return met.where((F.col("distance") <= reach) & ((F.col("_first") != F.col("seg")) | (F.col("_last") != F.col("seg")))).drop("_band")


def refine_boundaries(segments: DataFrame, edges: DataFrame, bins: DataFrame, reach: int = 30_000, least: int = 2, anchor: int = 10_000, merge: int = 150, min_cn: float = 4.5, shortest: int = 100, longest: int = 100_000_000, width: int = 10_000, weak: int = 1, weak_reach: int = 10_000, weak_least: int = 5, candidates: int = 5) -> tuple[DataFrame, DataFrame]:
    """Amplified segments and discordant edges after each has mended the other.

    segments: seg (whole number), chrom, start, stop, cn, clip_left, clip_right;
    edges: chrom1..clip2, support. An end of an edge counts if its partner is
    anchored: near a boundary of the partner's side of another segment. In order:

    1. A boundary without clips goes to the nearest such end within reach.
    2. Where both boundaries have at most ``weak`` clips, one with some goes
       outward to the nearest end of weak_least support within weak_reach, its
       partner within ``merge`` of the boundaries that step 1 left, if what is
       added has a median copy number of min_cn. Its clips are then none.
    3. Ends far from every boundary whose partners are near one make segments:
       each left end in order takes the first of the next ``candidates`` right
       ends that no other took, if the segment overlaps none and has the copy number.
    4. Ends within ``merge`` of a boundary of their side go there.

    Segments have disc_left, disc_right (support of the edge), partner_left,
    partner_right, and source: clip, PE_boundary (steps 1, 2) or PE_seg (3).
    """
    place = "struct<chrom:string,coord:bigint,clip:string>"
    # each step reads these again
    edges, bins = stage(edges, "edges"), stage(bins, "bins")
    ends = stage(_ends(edges, least), "ends")
    out = segments.select("seg", "chrom", "start", "stop", "cn", "clip_left", "clip_right").withColumns({f"{n}_{s}": F.lit(0).cast("long") if n == "disc" else F.lit(None).cast(place) for n in ("disc", "partner") for s in ("left", "right")} | {"source": F.lit("clip")})
    out = stage(out, "given")
    far = {"L": lambda x: x < F.col("stop"), "R": lambda x: x > F.col("start")}
    held = stage(_anchored(ends, out, anchor), "anchored")
    for clip, col, name in SIDES:
        out = _move(out, _near_boundary(held, out, clip, col, F.col(f"clip_{name}") == 0, reach), name, col, far[clip]).drop("_moved")
    out = stage(out, "first")
    strict = stage(_anchored(ends.where(F.col("support") >= weak_least), out, merge), "anchored")
    both_weak = (F.col("clip_left") <= weak) & (F.col("clip_right") <= weak)
    out = out.withColumn("_weak", both_weak)
    for clip, col, name in SIDES:
        near = _near_boundary(strict, out, clip, col, F.col("_weak") & (F.col(f"clip_{name}") > 0) & (F.col(f"clip_{name}") <= weak), weak_reach)
        size = F.col("stop") - F.col("coord") if clip == "L" else F.col("coord") - F.col("start")
        near = near.where((F.col("coord") < F.col("_x") if clip == "L" else F.col("coord") > F.col("_x")) & (size >= shortest) & (size <= longest))
        span = near.drop("start", "stop").withColumns({"start": F.least("coord", "_x"), "stop": F.greatest("coord", "_x")})
        sound = span.join(_median_cn(span, bins, width), ["chrom", "start", "stop"]).where(F.col("_cn") >= min_cn)
        out = _move(out, sound, name, col, lambda x: F.lit(True))
        out = out.withColumn(f"clip_{name}", F.when(F.col("_moved"), 0).otherwise(F.col(f"clip_{name}"))).drop("_moved")
    out = stage(out.drop("_weak"), "second")
    found = _rescued(ends, out, bins, anchor, merge, min_cn, shortest, longest, width, candidates)
    out = stage(out.unionByName(found), "refined")
    return out, snap_ends(edges, out, merge)


def _rescued(ends: DataFrame, segments: DataFrame, bins: DataFrame, anchor: int, merge: int, min_cn: float, shortest: int, longest: int, width: int, candidates: int) -> DataFrame:
    """Step 3 of refine_boundaries(). Candidates, their copy number and what they overlap are found natively; the choice goes through islands of candidates that overlap one another."""
    near = band(_boundaries(segments), anchor + 1, "at").select("chrom", "clip", "at", "_band").distinct()
    own = ends.withColumn("_band", F.floor(F.col("coord") / (anchor + 1))).join(near, ["chrom", "clip", "_band"]).where(F.abs(F.col("coord") - F.col("at")) <= anchor).select(*ends.columns)
    lost = _anchored(ends, segments, anchor).drop("_first", "_last").join(own.select("chrom", "coord", "clip").distinct(), ["chrom", "coord", "clip"], "left_anti")
    order = Window.partitionBy("chrom", "clip").orderBy("coord")
    chain = lost.withColumn("_new", F.when(F.col("coord") - F.lag("coord").over(order) <= merge, 0).otherwise(1)).withColumn("_g", F.sum("_new").over(order))
    one = chain.groupBy("chrom", "clip", "_g").agg(F.max(F.struct("support", (-F.col("coord")).alias("c"), "partner")).alias("_b")).select("chrom", "clip", (-F.col("_b.c")).alias("coord"), F.col("_b.support").alias("support"), F.col("_b.partner").alias("partner"))
    rights = one.where("clip = 'R'").withColumn("_rn", F.row_number().over(Window.partitionBy("chrom").orderBy("coord")))
    # a left end's candidates begin with the first right end that is far enough behind it
    at = one.withColumn("_x", F.when(F.col("clip") == "L", F.col("coord") + shortest).otherwise(F.col("coord")))
    seen = F.coalesce(F.sum(F.when(F.col("clip") == "R", 1).otherwise(0)).over(Window.partitionBy("chrom").orderBy("_x").rangeBetween(Window.unboundedPreceding, -1)), F.lit(0))
    lefts = at.withColumn("_seen", seen).where("clip = 'L'").select("chrom", F.col("coord").alias("start"), F.col("support").alias("disc_left"), F.col("partner").alias("partner_left"), F.explode(F.sequence(F.col("_seen") + 1, F.col("_seen") + candidates)).alias("_rn"))
    pairs = lefts.join(rights.select("chrom", "_rn", F.col("coord").alias("stop"), F.col("support").alias("disc_right"), F.col("partner").alias("partner_right")), ["chrom", "_rn"]).where(F.col("stop") - F.col("start") <= longest)
    free = pairs.join(overlap_join(pairs.select("chrom", "start", "stop").distinct(), segments.select("chrom", "start", "stop")).select("chrom", "start", "stop").distinct(), ["chrom", "start", "stop"], "left_anti")
    sound = free.join(_median_cn(free, bins, width), ["chrom", "start", "stop"]).where(F.col("_cn") >= min_cn)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        taken, used, done, kept = [], set(), set(), []
        for i, start, stop in rows.sort_values(["start", "stop"])[["start", "stop"]].itertuples():
            if start not in done and stop not in used and all(stop <= a or start >= b for a, b in taken):
                taken.append((start, stop))
                used.add(stop)
                done.add(start)
                kept.append(i)
        return rows.loc[kept, ["chrom", "start", "stop"]]

    chosen = islands(sound, 0, ["chrom"]).groupBy("chrom", "island").applyInPandas(run, "chrom string, start long, stop long")
    rows = sound.join(chosen, ["chrom", "start", "stop"])
    return rows.select(
        F.xxhash64(F.lit("rescued"), "chrom", "start", "stop").alias("seg"), "chrom", "start", "stop", F.col("_cn").cast(segments.schema["cn"].dataType).alias("cn"), *[F.lit(0).cast(segments.schema[f"clip_{n}"].dataType).alias(f"clip_{n}") for n in ("left", "right")],
        *[F.col(f"disc_{n}").cast("long").alias(f"disc_{n}") for n in ("left", "right")], "partner_left", "partner_right", F.lit("PE_seg").alias("source"),
    )


def snap_ends(edges: DataFrame, segments: DataFrame, reach: int = 150) -> DataFrame:
    """edges with each end at the nearest boundary of its side within reach, the one behind it of two as near."""
    near = band(_boundaries(segments).select("chrom", "clip", "at").distinct(), reach + 1, "at")
    points = edges.select(F.explode(F.array(*[F.struct(F.col(f"chrom{k}").alias("chrom"), F.col(f"coord{k}").alias("coord"), F.col(f"clip{k}").alias("clip")) for k in (1, 2)])).alias("e")).select("e.*").distinct()
    met = points.withColumn("_band", F.floor(F.col("coord") / (reach + 1))).join(near, ["chrom", "clip", "_band"]).where(F.abs(F.col("coord") - F.col("at")) <= reach)
    to = met.groupBy("chrom", "coord", "clip").agg(F.min_by("at", F.struct(F.abs(F.col("coord") - F.col("at")), -F.col("at"))).alias("_to"))
    out = edges
    for k in (1, 2):
        out = out.join(to.toDF(f"chrom{k}", f"coord{k}", f"clip{k}", "_to"), [f"chrom{k}", f"coord{k}", f"clip{k}"], "left").withColumn(f"coord{k}", F.coalesce("_to", f"coord{k}")).drop("_to")
    return out.select(*edges.columns)


def vertex_table(segments: DataFrame, pairs: DataFrame, least: float = 5.0) -> DataFrame:
    """Breakpoints of the graph: the ends of segments whose copy number rounds (half to even) to at least ``least``, and the ends of pairs."""
    high = segments.where(F.bround("cn") >= least)
    ends = [high.select("chrom", F.col("start").alias("coord"), F.lit("L").alias("clip")), high.select("chrom", F.col("stop").alias("coord"), F.lit("R").alias("clip"))]
    ends += [pairs.select(F.col(f"chrom{k}").alias("chrom"), F.col(f"coord{k}").alias("coord"), F.col(f"clip{k}").alias("clip")) for k in (1, 2)]
    out = ends[0].union(ends[1]).union(ends[2]).union(ends[3]).distinct()
    return out.withColumn("id", F.xxhash64("chrom", "coord", "clip"))


def remap_axis(points: DataFrame, regions: DataFrame) -> DataFrame:
    """Points (chrom, coord) with their place on regions laid end to end in the order of idx."""
    laid = regions.withColumn("offset", F.sum(F.col("stop") - F.col("start")).over(Window.orderBy("idx")) - (F.col("stop") - F.col("start")))
    rows = points.withColumns({"start": F.col("coord"), "stop": F.col("coord") + 1})
    met = overlap_join(rows, laid)
    return met.select(*points.columns, (F.col("coord") - F.col("r_start") + F.col("r_offset")).alias("x"))


def pack_rows(features: DataFrame, gap: int = 0) -> DataFrame:
    """features (chrom, start, stop, name) with the first row in which they overlap none before. Where all rows are free again a new group begins."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["start", "stop", "name"])
        ends: list[int] = []
        placed = []
        for a, b in zip(rows.start, rows.stop):
            k = next((i for i, e in enumerate(ends) if e + gap <= a), len(ends))
            ends[k : k + 1] = [b]
            placed.append(k)
        return rows.assign(row=placed)

    apart = islands(features.select("chrom", "start", "stop", "name"), gap, ["chrom"])
    return apart.groupBy("chrom", "island").applyInPandas(lambda rows: run(rows.drop(columns="island")), "chrom string, start long, stop long, name string, row long")


def merge_rois(rois: DataFrame, width: int = 10_000, share: float = 0.3) -> DataFrame:
    """Regions widened by their own share or ten bins, whichever is more, merged while they overlap as they grow; the largest score stays."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out: list[list] = []
        for a, b, score in rows.sort_values(["start", "stop"])[["start", "stop", "score"]].itertuples(index=False):
            pad = max(int(share * (b - a)), 10 * width)
            if out:
                last = out[-1]
                reach = max(int(share * (last[1] - last[0])), 10 * width)
                if a - pad <= last[1] + reach:
                    last[1], last[2] = max(last[1], b), max(last[2], score)
                    continue
            out.append([a, b, score])
        wide = [(rows.chrom.iloc[0], max(0, a - max(int(share * (b - a)), 10 * width)), b + max(int(share * (b - a)), 10 * width), s) for a, b, s in out]
        return pd.DataFrame(wide, columns=["chrom", "start", "stop", "score"])

    return rois.select("chrom", "start", "stop", "score").groupBy("chrom").applyInPandas(run, "chrom string, start long, stop long, score double")
