"""Interval algebra: half-open intervals (chrom, start, stop)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET = 250_000
#: rings of a chromosome meet by pairs of so many blocks, and so many pairs of intervals at once
BLOCKS, AT_ONCE = 8, 1 << 21


def _bucketed(df: DataFrame, start: Column, stop: Column, bucket: int, name: str = "_bucket") -> DataFrame:
    first = F.floor(start / bucket)
    return df.withColumn(name, F.explode(F.sequence(first, F.greatest(first, F.floor((stop - 1) / bucket)))))


def overlap_join(left: DataFrame, right: DataFrame, pad: int = 0, bucket: int = BUCKET, how: str = "inner") -> DataFrame:
    """Pairs of overlapping intervals, the right side's columns with the prefix r_.

    Both sides are dealt by chromosome and bucket, so that a long chromosome
    isn't one hot key; a pair that shares buckets is kept in the first of them.
    Empty intervals meet nothing. Both sides are widened by pad.
    """
    # what follows from an interval is worked out where pairs meet, so that it isn't shuffled
    s, e, r_s, r_e = F.col("start") - pad, F.col("stop") + pad, F.col("r_start") - pad, F.col("r_stop") + pad
    a = _bucketed(left.where("start < stop"), s, e, bucket)
    b = _bucketed(right.where("start < stop").select(*[F.col(c).alias(f"r_{c}") for c in right.columns]), r_s, r_e, bucket, "r__bucket")
    on = (F.col("chrom") == F.col("r_chrom")) & (F.col("_bucket") == F.col("r__bucket")) & (s < r_e) & (r_s < e)
    if how == "left_semi":
        return a.join(b, on, "left_semi").select(*left.columns).distinct()
    met = a.join(b, on).where(F.col("_bucket") == F.floor(F.greatest(s, r_s) / bucket))
    return met.select(*left.columns, *[f"r_{c}" for c in right.columns])


def covered(df: DataFrame, by: list[str] = (), bucket: int = BUCKET) -> DataFrame:
    """What the intervals cover (for each key of by), as disjoint pieces cut at buckets. However many lie above each other, a base is in one piece."""
    rows = _bucketed(df.where("start < stop").select(*by, "chrom", "start", "stop").distinct(), F.col("start"), F.col("stop"), bucket)
    low, high = F.col("_bucket") * bucket, (F.col("_bucket") + 1) * bucket
    rows = rows.select(*by, "chrom", "_bucket", F.greatest("start", low).alias("start"), F.least("stop", high).alias("stop")).distinct()
    key = [*by, "chrom", "_bucket"]
    return islands(rows, 0, key, touching=True).groupBy(*key, "island").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("_bucket", "island")


def classes(df: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """Keys whose rows are the same intervals are one class, and what overlaps one of them overlaps all.

    Returns the intervals of each class once (_rep, the struct of its smallest
    key, _times, how many keys it has, chrom, start, stop), and its members (key, _rep).
    """
    shapes = df.where("start < stop").groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("chrom", "start", "stop"))).alias("_shape"))
    reps = shapes.groupBy("_shape").agg(F.min(F.struct(*key)).alias("_rep"), F.count("*").alias("_times"))
    rows = reps.select("_rep", "_times", F.explode("_shape").alias("_i")).select("_rep", "_times", "_i.*")
    return rows, shapes.join(reps, "_shape").select(*key, "_rep")


def _meeting(left: DataFrame, right: DataFrame, pad: int) -> DataFrame:
    """The distinct intervals of left that overlap a row of right, both sides widened by pad."""
    wide = right.where("start < stop").select("chrom", (F.col("start") - 2 * pad).alias("start"), (F.col("stop") + 2 * pad).alias("stop"))
    return overlap_join(left.select("chrom", "start", "stop").distinct(), covered(wide), how="left_semi")


def overlapping(left: DataFrame, right: DataFrame, key: list[str], pad: int = 0) -> DataFrame:
    """Rows of left that overlap a row of right; key names each row of left."""
    return left.join(_meeting(left, right, pad), ["chrom", "start", "stop"], "left_semi").select(*left.columns)


def clear_of(left: DataFrame, right: DataFrame, key: list[str], pad: int = 0) -> DataFrame:
    """Rows of left that overlap no row of right; key names each row of left."""
    return left.join(_meeting(left, right, pad), ["chrom", "start", "stop"], "left_anti").select(*left.columns)


def unlike(left: DataFrame, right: DataFrame, value: str) -> DataFrame:
    """Rows of left that overlap a row of right with another value."""
    span = ["chrom", "start", "stop"]
    held = right.where("start < stop").groupBy(*span).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    met = overlap_join(left.select(*span).distinct(), held).groupBy(*span).agg(F.min("r__lo").alias("_lo"), F.max("r__hi").alias("_hi"))
    return left.join(met, span).where((F.col("_lo") != F.col(value)) | (F.col("_hi") != F.col(value))).select(*left.columns)


def map_first(left: DataFrame, right: DataFrame, key: list[str], value: str, order: str) -> DataFrame:
    """The value of the first overlapping row of right by order, for each key."""
    rows, members = classes(left, key)
    held = right.where("start < stop").groupBy("chrom", "start", "stop").agg(F.min_by(value, order).alias("_v"), F.min(order).alias("_o"))
    best = overlap_join(rows, held).groupBy("_rep").agg(F.min_by("r__v", "r__o").alias("_v"))
    return members.join(best, "_rep").select(*key, F.col("_v").alias(value))


def map_all(left: DataFrame, right: DataFrame, key: list[str], value: str, sep: str = "; ") -> DataFrame:
    """All distinct values of overlapping rows, sorted and joined."""
    rows, members = classes(left, key)
    held = right.where("start < stop").groupBy("chrom", "start", "stop").agg(F.collect_set(value).alias("_v"))
    values = F.array_sort(F.array_distinct(F.flatten(F.collect_list("r__v"))))
    named = overlap_join(rows, held).groupBy("_rep").agg(F.array_join(values, sep).alias("_v"))
    return members.join(named, "_rep").select(*key, F.col("_v").alias(value))


def islands(df: DataFrame, gap: Column | int, by: list[str], start: str = "start", stop: str = "stop", touching: bool = False) -> DataFrame:
    """df with island, the running number of merged intervals by key: a new one starts where start is beyond the furthest stop so far by gap or more (touching: by more than gap)."""
    w = Window.partitionBy(*by).orderBy(start, stop)
    far = F.max(stop).over(w.rowsBetween(Window.unboundedPreceding, -1))
    beyond = F.col(start) > far + gap if touching else F.col(start) >= far + gap
    return df.withColumn("_new", F.when(far.isNull() | beyond, 1).otherwise(0)).withColumn("island", F.sum("_new").over(w)).drop("_new")


def merge_bed(df: DataFrame, gap: int = 100_000) -> DataFrame:
    """Merged intervals; both sides are widened by gap before they are compared."""
    return islands(df, 2 * gap, ["chrom"]).groupBy("chrom", "island").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.count("*").alias("n")).drop("island")


def padded_membership(points: DataFrame, df: DataFrame, pad: int = 10_000, gap: int = 100_000) -> DataFrame:
    """Points (chrom, coord, ...) inside a merged interval widened by pad."""
    merged = merge_bed(df, gap).select("chrom", (F.col("start") - pad).alias("start"), (F.col("stop") + pad).alias("stop"))
    rows = points.withColumns({"start": F.col("coord"), "stop": F.col("coord") + 1})
    return overlap_join(rows, merged).select(*points.columns).distinct()


def drop_small_rois(df: DataFrame, min_length: int, gap: int = 100_000) -> DataFrame:
    """Drops the rows whose own coordinates are a merged region shorter than min_length."""
    small = merge_bed(df, gap).where(F.col("stop") - F.col("start") < min_length).select("chrom", "start", "stop")
    return df.join(small, ["chrom", "start", "stop"], "left_anti")


def supported_boundaries(segments: DataFrame, gap: int = 30_000, min_cn: float = 4.5) -> DataFrame:
    """Components of amplified segments, with the ends of each."""
    return islands(segments.where(F.col("cn") >= min_cn), gap, ["chrom"], touching=True).groupBy("chrom", "island").agg(F.min("start").alias("left_end"), F.max("stop").alias("right_end"), F.count("*").alias("n")).drop("island")


def component_of(points: DataFrame, components: DataFrame, key: list[str], reach: int = 20_000) -> DataFrame:
    """For each point (chrom, coord) the component that holds it, else the nearest within reach; the one before wins ties."""
    rows = points.withColumns({"start": F.col("coord"), "stop": F.col("coord") + 1})
    near = overlap_join(rows, components, pad=reach // 2 + 1)
    far = F.greatest(F.col("r_start") - F.col("coord"), F.col("coord") - F.col("r_stop"), F.lit(0))
    near = near.withColumn("_far", far).where(F.col("_far") <= reach)
    return near.groupBy(*key).agg(F.min_by(F.struct("r_start", "r_stop"), F.struct("_far", "r_start")).alias("_c"), F.min("_far").alias("distance")).select(*key, F.col("_c.r_start").alias("component_start"), F.col("_c.r_stop").alias("component_stop"), "distance")


def reciprocal_overlap(rings: DataFrame, above: float = 0.0) -> DataFrame:
    """Pairs of rings (ring, chrom, start, stop) that share bases: each one's merged length and their common length, ends inclusive.

    above: only pairs that share more than this part of the longer one. Their
    lengths then differ by that factor at most, so only rings of neighbouring
    classes of length meet.
    """
    # Everything before the join goes by ring: one shuffle, and the totals come along.
    merged = islands(rings.select("ring", "chrom", "start", "stop").repartition("ring"), 1, ["ring", "chrom"], touching=True).groupBy("ring", "chrom", "island").agg(F.min("start").alias("start"), (F.max("stop") + 1).alias("stop")).drop("island")
    merged = merged.withColumn("total", F.sum(F.col("stop") - F.col("start")).over(Window.partitionBy("ring")))
    if above <= 0:
        out = _shared_bases(merged)
    else:
        merged = merged.withColumn("_class", F.floor(F.log(F.col("total").cast("double")) / math.log(1 / above)))
        # the chromosome carries the class, so that the join's key does; a class meets itself and its neighbours
        left = merged.withColumn("chrom", F.concat_ws("|", "chrom", F.col("_class").cast("string")))
        right = merged.withColumn("_class", F.explode(F.array(*[F.col("_class") + k for k in (-1, 0, 1)]))).withColumn("chrom", F.concat_ws("|", "chrom", F.col("_class").cast("string")))
        met = overlap_join(left.select("ring", "chrom", "start", "stop", "total"), right.select("ring", "chrom", "start", "stop", "total"), bucket=100_000).where("ring < r_ring")
        out = met.groupBy("ring", F.col("r_ring").alias("other"), "total", F.col("r_total").alias("other_total")).agg(F.sum(F.least("stop", "r_stop") - F.greatest("start", "r_start")).alias("common"))
    out = out.select("ring", "other", "common", "total", "other_total", (F.col("common") / F.greatest("total", "other_total")).alias("overlap"))
    return out.where(F.col("overlap") > above)


def ranges(first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of ranges that begin at first and are size long: for each member the number of its range, and itself."""
    of = np.repeat(np.arange(len(first)), size)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first, size)


def _shared_bases(merged: DataFrame) -> DataFrame:
    """ring, other, total, other_total, common of every two rings that share bases (ring, chrom, start, stop, total; a ring's intervals are disjoint).

    What is shuffled are intervals, never pairs: a ring goes, with all it has, to
    the pairs of blocks of each of its chromosomes, and two rings are summed
    where their first common chromosome is dealt. A task holds two blocks.
    """
    of, k = F.pmod(F.xxhash64("ring"), F.lit(BLOCKS)), F.lit(BLOCKS)
    own = merged.where("start < stop and ring is not null and chrom is not null").withColumn("_chroms", F.collect_set("chrom").over(Window.partitionBy("ring")))
    dealt = own.withColumn("_of", of).select("*", F.explode("_chroms").alias("_at")).select("_at", "ring", "chrom", "start", "stop", "total", "_of", F.explode(F.sequence(F.lit(0), k - 1)).alias("_with"))
    dealt = dealt.select("_at", F.least("_of", "_with").alias("_i"), F.greatest("_of", "_with").alias("_j"), "ring", "chrom", "start", "stop", "total", (F.col("_of") <= F.col("_with")).alias("_left"))
    schema = f"ring {merged.schema['ring'].dataType.simpleString()}, other {merged.schema['ring'].dataType.simpleString()}, total long, other_total long, common long"
    # by a number of its own: the work is in the pairs, which the size of the intervals does not tell
    parts = int(merged.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(parts, "_at", "_i", "_j").groupBy("_at", "_i", "_j").applyInArrow(_block_pairs, schema)


def _block_pairs(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs of two blocks' rings, or of one block's own, whose first common place is on the key's chromosome."""
    rows = pa.Table.from_batches(list(batches))
    at, i, j = (x.as_py() for x in key)
    coded = {c: rows[c].combine_chunks().dictionary_encode() for c in ("ring", "chrom")}
    names, ring, chrom = {}, None, None
    for c, x in coded.items():
        order = pa.compute.sort_indices(x.dictionary)
        rank = np.empty(len(order), "i8")
        rank[order.to_numpy()] = np.arange(len(order))
        names[c] = x.dictionary.take(order)
        coded[c] = rank[x.indices.to_numpy()]
    ring, chrom = coded["ring"], coded["chrom"]
    here = names["chrom"].to_pylist().index(at)
    start, stop, total = (rows[c].to_numpy() for c in ("start", "stop", "total"))
    size_of = np.zeros(len(names["ring"]), "i8")
    size_of[ring] = total
    low = start.min()
    shift = chrom * (stop.max() - low + 1) - low
    start, stop = start + shift, stop + shift
    left = rows["_left"].to_numpy(zero_copy_only=False)
    a = np.flatnonzero(left)
    b = np.arange(len(ring)) if i == j else np.flatnonzero(~left)
    b = b[np.argsort(start[b], kind="stable")]
    b_start, b_stop = start[b], np.sort(stop[b])
    # an interval meets those that begin in it, and those that hold its beginning behind their own
    begins = np.searchsorted(b_start, start[a]), np.searchsorted(b_start, stop[a])
    meets = begins[1] - np.searchsorted(b_stop, start[a], "right")
    a = a[np.argsort(ring[a], kind="stable")] if len(a) else a
    work = np.zeros(len(start), "i8")
    work[np.flatnonzero(left)] = meets
    # whole rings together, so many that their pairs are few enough
    done = np.cumsum(work[a])
    ends = np.append(np.flatnonzero(np.diff(ring[a])) + 1, len(a)) if len(a) else np.array([], "i8")
    begin = 0
    while begin < len(a):
        upto = ends[max(np.searchsorted(done[ends - 1], (done[begin - 1] if begin else 0) + AT_ONCE, "right") - 1, np.searchsorted(ends, begin, "right"))]
        own = a[begin:upto]
        begin = upto
        own = own[np.argsort(start[own], kind="stable")]
        first = np.searchsorted(b_start, start[own])
        x, y = ranges(first, np.searchsorted(b_start, stop[own]) - first)
        first = np.searchsorted(start[own], b_start, "right")
        v, u = ranges(first, np.maximum(np.searchsorted(start[own], stop[b]) - first, 0))
        x, y = own[np.concatenate([x, u])], b[np.concatenate([y, v])]
        if i == j:
            x, y = x[ring[x] < ring[y]], y[ring[x] < ring[y]]
        if not len(x):
            continue
        common = np.minimum(stop[x], stop[y]) - np.maximum(start[x], start[y])
        pair = np.minimum(ring[x], ring[y]) * len(size_of) + np.maximum(ring[x], ring[y])
        order = np.argsort(pair, kind="stable")
        pair = pair[order]
        new = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
        mine = np.minimum.reduceat(chrom[x][order], new) == here
        p, q = np.divmod(pair[new][mine], len(size_of))
        common = np.add.reduceat(common[order], new)[mine]
        yield pa.RecordBatch.from_arrays([names["ring"].take(pa.array(p)), names["ring"].take(pa.array(q)), pa.array(size_of[p]), pa.array(size_of[q]), pa.array(common)], ["ring", "other", "total", "other_total", "common"])


def linear_positions(points: DataFrame, sizes: DataFrame) -> DataFrame:
    """Points with their position on the concatenated genome; sizes: chrom, length, in the order of chrom."""
    before = sizes.select("chrom", (F.sum("length").over(Window.orderBy("chrom")) - F.col("length")).alias("offset"))
    return points.join(F.broadcast(before), "chrom").withColumn("position", F.col("coord") + F.col("offset")).drop("offset")


def intersections(left: DataFrame, right: DataFrame) -> DataFrame:
    """Common parts of two sets of closed ranges (chrom, start, stop); parts that touch are one, and a shared end is a part of no length."""
    closed = lambda df: df.select("chrom", "start", (F.col("stop") + 1).alias("stop"))
    met = overlap_join(closed(left).distinct(), closed(right).distinct()).select("chrom", F.greatest("start", "r_start").alias("start"), (F.least("stop", "r_stop") - 1).alias("stop")).distinct()
    return islands(met, 0, ["chrom"], touching=True).groupBy("chrom", "island").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("island")
