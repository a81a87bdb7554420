"""Segmentation of binned copy number, and segments of breakpoints."""

from __future__ import annotations

from functools import lru_cache
from itertools import accumulate, islice, pairwise
from math import exp

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .intervals import overlap_join

#: Parameters of circular binary segmentation: window and overlap in bins, permutations, level, least statistic.
WINDOW, OVERLAP, PERMUTATIONS, LEVEL, LEAST_T = 1000, 100, 1000, 0.01, 1.5


def _t(inner, total, k, n):
    """Statistic of a part of k of n values against the rest, at unit variance."""
    return np.abs(inner / k - (total - inner) / (n - k)) / np.sqrt(1 / k + 1 / (n - k))


class _Orders:
    """The orders of n values after each shuffle: shuffle k starts from seed k and from the order that the last one left. Made in blocks, and the same for all values."""

    def __init__(self, n: int, block: int = 50):
        self.n, self.block, self.blocks = n, block, []

    def __iter__(self):
        for k in range(PERMUTATIONS // self.block):
            if k == len(self.blocks):
                order = self.blocks[-1][-1].astype("i8") if self.blocks else np.arange(self.n)
                made = np.empty((self.block, self.n), dtype="i4")
                for row in range(self.block):
                    np.random.seed(k * self.block + row)
                    np.random.shuffle(order)
                    made[row] = order
                self.blocks.append(made)
            yield self.blocks[k]


_orders = lru_cache(maxsize=24)(_Orders)


def _significant(x: np.ndarray, t: float, i: int, j: int | None) -> bool:
    """Whether shuffles reach t at the same places no more often than the level allows."""
    if t < LEAST_T:
        return False
    reached, n = 0, len(x)
    for orders in _orders(n):
        s = np.cumsum(x[orders], axis=1)
        inner, k = (s[:, i], i + 1) if j is None else (s[:, j] - s[:, i], j - i)
        reached += int((_t(inner, s[:, -1], k, n) >= t).sum())
        if reached > PERMUTATIONS * LEVEL:
            return False
    return True


def _best_arc(x: np.ndarray) -> tuple[int, int, float]:
    """The places i, j (1 <= i, i + 2 <= j) where the part after i up to j stands out most; the first of equals by i, then j."""
    s, n = np.cumsum(x), len(x)
    best = (0, 0, -1.0)
    for i in range(1, n - 2):
        j = np.arange(i + 2, n)
        t = _t(s[j] - s[i], s[-1], j - i, n)
        at = int(np.argmax(t))
        if t[at] > best[2]:
            best = (i, int(j[at]), float(t[at]))
    return best


def _split(x: np.ndarray, start: int, end: int) -> list[tuple[int, int]]:
    done, ahead = [], [(start, end, True)]
    while ahead:
        a, b, open_ = ahead.pop()
        if not open_ or b - a <= 3:
            done.append((a, b))
            continue
        i, j, t = _best_arc(x[a:b])
        if not _significant(x[a:b], t, i, j):
            done.append((a, b))
            continue
        i, j = i + a, j + a
        parts = [(a, i + 1, i - a >= 2), (i + 1, j + 1, j - i >= 3)]
        if b - j > 1:
            parts.append((j + 1, b, b - j >= 4))
        ahead.extend(reversed(parts))
    return done


def _window_count(n):
    """How many windows n bins have, as a number or a Column: the last is part of the one before where it would be shorter than half a window."""
    if isinstance(n, int):
        full = max(1, -(-n // WINDOW))
        return full - (full > 1 and n - (full - 1) * WINDOW < WINDOW // 2)
    full = F.greatest(F.lit(1), F.ceil(n / WINDOW))
    return full - F.when((full > 1) & (n - (full - 1) * WINDOW < WINDOW // 2), 1).otherwise(0)


def recheck(x: np.ndarray, cuts: list[int]) -> list[tuple[int, int]]:
    """Segments [start, end) between those cuts that stand out from the last one kept to the next."""
    kept = [0]
    for at, end in pairwise([*cuts[1:], len(x)] if len(cuts) > 1 else []):
        part = x[kept[-1] : end]
        s, i = np.cumsum(part), at - kept[-1] - 1
        if _significant(part, float(_t(s[i], s[-1], i + 1, len(part))), i, None):
            kept.append(at)
    return list(pairwise([*kept, len(x)]))


def cbs(x: np.ndarray) -> list[tuple[int, int]]:
    """Segments [start, end) of one chromosome's values: arcs in overlapping windows, then a recheck of every boundary."""
    n = len(x)
    if not n:
        return []
    w = _window_count(n)
    parts = [(max(0, k * WINDOW - OVERLAP), n if k == w - 1 else (k + 1) * WINDOW + OVERLAP) for k in range(w)]
    return recheck(x, sorted({a for part in parts for a, _ in _split(x, *part)}))


def cbs_segments(bins: DataFrame, width: int = 10_000) -> DataFrame:
    """Segments of each chromosome's bins (chrom, coord, n, x).

    The overlapping windows of a chromosome are independent, so each is a group
    of its own; only the recheck of the boundaries that they find reads a
    chromosome's bins, one number each, in one task.
    """
    rows = bins.where("x is not null").select("chrom", "coord", "n", "x")
    order = Window.partitionBy("chrom").orderBy("coord")
    rows = rows.withColumns({"_i": F.row_number().over(order) - 1, "_w": _window_count(F.count("*").over(Window.partitionBy("chrom")))})
    first = F.greatest(F.lit(0), F.ceil((F.col("_i") - (WINDOW + OVERLAP - 1)) / WINDOW))
    spread = F.sequence(F.least(first, F.col("_w") - 1), F.least(F.floor((F.col("_i") + OVERLAP) / WINDOW), F.col("_w") - 1))

    def arcs(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_i")
        x, base = rows.x.to_numpy("f8"), int(rows._i.iloc[0])
        return pd.DataFrame({"chrom": rows.chrom.iloc[0], "_i": [base + a for a, _ in _split(x, 0, len(x))]})

    # Few bytes, but much work: a stated number of partitions isn't coalesced by adaptive execution.
    n = int(bins.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = rows.select("chrom", "_i", "x", F.explode(spread).alias("window")).repartition(n, "chrom", "window").groupBy("chrom", "window").applyInPandas(arcs, "chrom string, _i int").distinct().withColumn("_cut", F.lit(True))

    def whole(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_i")
        x, coord, n = rows.x.to_numpy("f8"), rows.coord.to_numpy(), rows.n.to_numpy("f8")
        found = recheck(x, np.flatnonzero(rows._cut.notna()).tolist())
        out = [(rows.chrom.iloc[0], coord[a], coord[b - 1] + width, b - a, n[a:b].mean(), x[a:b].mean()) for a, b in found]
        return pd.DataFrame(out, columns=["chrom", "start", "stop", "bins", "n", "x"])

    return rows.drop("_w").join(cuts, ["chrom", "_i"], "left").repartition(n, "chrom").groupBy("chrom").applyInPandas(whole, "chrom string, start long, stop long, bins long, n double, x double")


def add_cn(segments: DataFrame, calls: DataFrame, bins: DataFrame, pad: int = 10_000, width: int = 10_000) -> DataFrame:
    """Copy number of segments: the largest of overlapping calls, rounded half to even, else the mean of bins within pad."""
    top = overlap_join(segments.select("seg", "chrom", "start", "stop"), calls.select("chrom", "start", "stop", "cn")).groupBy("seg").agg(F.bround(F.max("r_cn")).alias("_top"))
    rows = bins.select("chrom", F.col("coord").alias("start"), (F.col("coord") + 1).alias("stop"), "cn")
    wide = segments.select("seg", "chrom", (F.col("start") - pad).alias("start"), (F.col("stop") + pad).alias("stop"))
    mean = overlap_join(wide, rows).groupBy("seg").agg(F.avg("r_cn").alias("_mean"))
    return segments.drop("cn").join(top, "seg", "left").join(mean, "seg", "left").withColumn("cn", F.coalesce("_top", "_mean")).drop("_top", "_mean")


def interior_cn(segments: DataFrame, bins: DataFrame, high: float = 4.5) -> DataFrame:
    """Mean copy number of the bins that start inside a segment, their number and the share of high ones."""
    rows = bins.select("chrom", F.col("coord").alias("start"), (F.col("coord") + 1).alias("stop"), "cn")
    met = overlap_join(segments.select("seg", "chrom", "start", "stop"), rows).groupBy("seg")
    return met.agg(F.avg("r_cn").alias("mean_cn"), F.count("*").alias("bins"), F.avg(F.when(F.col("r_cn") >= high, 1.0).otherwise(0.0)).alias("high_share"))


def pair_ends(sites: DataFrame, knn: int = 5, shortest: int = 100, longest: int = 50_000_000) -> DataFrame:
    """Each left end with the deepest of its knn nearest right ends behind it, nearest of equals."""
    # Right ends are numbered, so the next knn are an equi-join and not a join of all ends with all.
    both = sites.select("chrom", "coord", "clip", "n")
    rights = both.where("clip = 'R'").withColumn("_rn", F.row_number().over(Window.partitionBy("chrom").orderBy("coord")))
    count = both.withColumn("_seen", F.sum(F.when(F.col("clip") == "R", 1).otherwise(0)).over(Window.partitionBy("chrom").orderBy("coord", F.desc("clip")).rowsBetween(Window.unboundedPreceding, 0)))
    near = count.where("clip = 'L'").select("chrom", F.col("coord").alias("start"), F.explode(F.sequence(F.col("_seen") + 1, F.col("_seen") + knn)).alias("_rn"))
    met = near.join(rights.select("chrom", "_rn", F.col("coord").alias("stop"), "n"), ["chrom", "_rn"]).where((F.col("stop") - F.col("start") >= shortest) & (F.col("stop") - F.col("start") <= longest))
    return met.groupBy("chrom", "start").agg(F.max_by("stop", F.struct("n", -F.col("stop"))).alias("stop"), F.max("n").alias("n"))


def _paired_inside(ends: DataFrame, knn: int) -> DataFrame:
    """chrom, start, stop: each end (component, chrom, coord, clip, n) that isn't _done with the deepest of the ``knn`` nearest ends of the other side that face it in its component, the nearest of equals."""
    place = Window.partitionBy("chrom", "component").orderBy("coord")
    before = place.rangeBetween(Window.unboundedPreceding, -1)
    upto = place.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    is_ = lambda side: F.when(F.col("clip") == side, 1).otherwise(0)
    rows = ends.withColumns({
        "_lefts": F.coalesce(F.sum(is_("L")).over(before), F.lit(0)), "_rights": F.sum(is_("R")).over(upto),
        "_k": F.row_number().over(Window.partitionBy("chrom", "component", "clip").orderBy("coord")),
    })
    # a left end's partners are the right ends with the next numbers, a right end's the left ends with the last ones
    asked = F.when(F.col("clip") == "L", F.sequence(F.col("_rights") + 1, F.col("_rights") + knn)).otherwise(F.sequence(F.greatest(F.lit(0), F.col("_lefts") - knn + 1), F.col("_lefts")))
    left = rows.where(~F.coalesce("_done", F.lit(False))).select("chrom", "component", "coord", "clip", F.explode(asked).alias("_k"), F.when(F.col("clip") == "L", "R").otherwise("L").alias("_side"))
    right = rows.select("chrom", "component", F.col("coord").alias("_to"), F.col("clip").alias("_side"), "_k", "n")
    met = left.join(right, ["chrom", "component", "_side", "_k"])
    best = met.groupBy("chrom", "coord", "clip").agg(F.max_by("_to", F.struct("n", -F.abs(F.col("_to") - F.col("coord")))).alias("_to"))
    return best.select("chrom", F.least("coord", "_to").alias("start"), F.greatest("coord", "_to").alias("stop"))


def graph_segments(ends: DataFrame, pairs: DataFrame, regions: DataFrame, knn: int = 3, within: bool = True, shortest: int = 100, longest: int = 50_000_000, share: float = 0.5, reach: int = 20_000) -> DataFrame:
    """chrom, start, stop: the amplified regions and the segments that breakpoints make of them.

    ends: chrom, coord, clip, n (depth of clips), each once; pairs: chrom1..clip2,
    n, source; regions: merged amplified sequence, apart from each other. An end
    belongs to the region that holds it, else to the nearest within reach.
    Inside a region's ends each one is paired with the deepest of the ``knn``
    next that face it; but not an end for which pairs suggest segments (within:
    knn_segments()). Pairs that lead from an end back to one before it are
    segments, too; of those that read pairs alone show only a region as it is.
    Segments of a sound length stay if regions cover a share of them.
    """
    from .intervals import component_of
    from .refine import knn_segments

    where = ["chrom", "coord", "clip"]
    known = ends.select(*where).distinct()
    for k in (1, 2):
        pairs = pairs.join(known.toDF(f"chrom{k}", f"coord{k}", f"clip{k}"), [f"chrom{k}", f"coord{k}", f"clip{k}"], "left_semi")
    left, found = ends.withColumn("_done", F.lit(False)), []
    if within:
        sub = knn_segments(regions, pairs, knn, named=True)
        found.append(sub.select("chrom", "start", "stop"))
        done = sub.select("chrom", F.when(F.col("clip") == "L", F.col("start")).otherwise(F.col("stop")).alias("coord"), "clip").distinct()
        left = ends.join(done.withColumn("_done", F.lit(True)), where, "left")
    inside = left.join(component_of(known, regions.select("chrom", "start", "stop"), where, reach).select(*where, F.col("component_start").alias("component")), where)
    # an end that is done is still a partner of others
    found.append(_paired_inside(inside, knn))
    loop = F.when((F.col("clip1") == "L") & (F.col("clip2") == "R") & (F.col("coord1") < F.col("coord2")), True).otherwise((F.col("clip1") == "R") & (F.col("clip2") == "L") & (F.col("coord1") > F.col("coord2")))
    loops = pairs.where((F.col("chrom1") == F.col("chrom2")) & loop).select(F.col("chrom1").alias("chrom"), F.least("coord1", "coord2").alias("start"), F.greatest("coord1", "coord2").alias("stop"), "source")
    own = regions.select("chrom", "start", "stop").distinct()
    found.append(loops.where("source <> 'pe'").select("chrom", "start", "stop"))
    found.append(loops.where("source = 'pe'").select("chrom", "start", "stop").join(own, ["chrom", "start", "stop"], "left_semi"))
    new = found[0]
    for more in found[1:]:
        new = new.union(more)
    size = F.col("stop") - F.col("start")
    new = new.distinct().where((size >= shortest) & (size <= longest))
    cover = overlap_join(new, own).groupBy("chrom", "start", "stop").agg(F.sum(F.least("stop", "r_stop") - F.greatest("start", "r_start")).alias("_in"))
    return own.union(cover.where(F.col("_in") >= share * size).select("chrom", "start", "stop")).distinct()


def snap_to_boundary(points: DataFrame, boundaries: DataFrame, reach: int = 30_000) -> DataFrame:
    """Points (id, chrom, coord) with the nearest boundary (chrom, at) within reach; none if two are equally near."""
    near = boundaries.withColumn("_band", F.explode(F.array(*[F.floor(F.col("at") / (reach + 1)) + k for k in (-1, 0, 1)])))
    met = points.withColumn("_band", F.floor(F.col("coord") / (reach + 1))).join(near, ["chrom", "_band"]).withColumn("_far", F.abs(F.col("coord") - F.col("at"))).where(F.col("_far") <= reach)
    best = met.groupBy("id").agg(F.min("_far").alias("_least"))
    one = met.join(best, "id").where("_far = _least").groupBy("id").agg(F.count("*").alias("_k"), F.min("at").alias("to")).where("_k = 1").drop("_k")
    return points.join(one, "id", "left")


#: Limits of the least support of a pair (fixed values). A bin of the histogram begins the tail if it holds at most a share of the pairs up to the next occupied bin: STRICT, or LOOSE where the strict tail begins after LATE bins; up to so many pairs, that one begins after at most so many bins (EARLIEST).
STRICT, LOOSE, LATE, EARLIEST = 0.01, 0.05, 9, {2_000: 5, 4_000: 7, 10_000: 11}
#: No threshold for at most FEW_PAIRS; no tail in at most FEW_BINS; where more than MOST pairs would be kept, the count of the pair of rank RANK is the threshold.
FEW_PAIRS, FEW_BINS, MOST, RANK = 10, 5, 30_000, 1_201
#: The threshold isn't below the last number where there are more pairs than the first and more are kept than the second; nor above CEILING's last where there are at most as many pairs and fewer are kept.
FLOORS, CEILING = ((10_000, 1_000, 20.0), (1_000, 299, 3.0)), (5_000, 300, 5.0)


def _tail(sizes: list[int], pairs: int) -> int:
    """The occupied bin that follows the last one before the tail."""
    if len(sizes) <= FEW_BINS:
        return 0
    shares = [c / upto for c, upto in zip(sizes, islice(accumulate(sizes), 1, None))]
    begins = {limit: 1 + next((i for i, x in enumerate(shares) if x <= limit), 0) for limit in (STRICT, LOOSE)}
    earliest = min((bins for most, bins in EARLIEST.items() if pairs <= most), default=None)
    late = begins[STRICT] > LATE and earliest is not None
    return min(begins[LOOSE], earliest) if late else begins[STRICT]


def support_threshold(counts: DataFrame, value: str = "n", bins: int = 1000) -> float | None:
    """Least support of a pair, from the histogram of the log of all pairs' counts; None for at most FEW_PAIRS pairs.

    It is the middle of the first bin that holds as many pairs as the first bin
    of the tail, within the limits above. The driver gets the occupied bins, of
    which there are at most ``bins``, and for very many pairs one count.
    """
    x = counts.select(F.log(value).alias("x"), value)
    lo, hi, pairs = x.agg(F.min("x"), F.max("x"), F.count("x")).first()
    if pairs <= FEW_PAIRS:
        return None
    if lo == hi:  # one count alone has a bin of its own
        lo, hi = lo - 0.5, hi + 0.5
    bin_of = F.least(F.lit(bins - 1), F.floor((F.col("x") - lo) * (bins / (hi - lo))).cast("int"))
    held = dict(sorted(tuple(r) for r in x.groupBy(bin_of.alias("bin")).agg(F.count("*").alias("c")).collect()))
    sizes = list(held.values())
    alike = sizes[_tail(sizes, pairs)]
    level = exp(lo + (min(b for b, c in held.items() if c == alike) + 0.5) * (hi - lo) / bins)
    kept = x.where(F.col(value) >= round(level)).count()
    if kept > MOST:
        level = float(x.select(value).orderBy(F.desc(value)).limit(RANK).agg(F.min(value)).first()[0])
    least = max((to for over, keeps, to in FLOORS if pairs > over and kept > keeps), default=0.0)
    most = CEILING[2] if pairs <= CEILING[0] and kept < CEILING[1] else level
    return max(least, min(most, level))
