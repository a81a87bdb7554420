"""Genomic bins, copy number and smoothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .intervals import overlap_join


#: What rounding may leave of a difference that is none.
ROUNDING = 1e-9


def bin_start(col, width: int):
    return F.floor(col / width).cast("long") * width


def bin_counts(reads: DataFrame, width: int = 10_000, by: tuple[str, ...] = ()) -> DataFrame:
    """Reads by start bin, occupied bins only; by: of each sample apart."""
    return reads.groupBy(*by, "chrom", bin_start(F.col("start"), width).alias("coord")).agg(F.count("*").alias("n"))


def copy_number(bins: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Twice the count over the mean count of occupied bins; the mean is one row, which is broadcast, or one a sample, which is joined."""
    mean = bins.groupBy(*by).agg(F.avg("n").alias("_mean"))
    met = bins.join(mean, list(by)) if by else bins.crossJoin(F.broadcast(mean))
    return met.withColumn("cn", 2 * F.col("n") / F.col("_mean")).drop("_mean")


def targeted_copy_number(bins: DataFrame, known: DataFrame, width: int = 10_000, least: int = 10) -> DataFrame:
    """Copy number against the bins outside known intervals, if at least ``least`` are left, else against all."""
    rows = bins.withColumns({"start": F.col("coord"), "stop": F.col("coord") + width})
    inside = overlap_join(rows, known).select("chrom", "coord").distinct().withColumn("_in", F.lit(1))
    marked = bins.join(inside, ["chrom", "coord"], "left")
    means = marked.agg(F.avg(F.when(F.col("_in").isNull(), F.col("n"))).alias("_out"), F.count(F.when(F.col("_in").isNull(), 1)).alias("_k"), F.avg("n").alias("_all"))
    mean = F.when(F.col("_k") >= least, F.col("_out")).otherwise(F.col("_all"))
    return marked.crossJoin(F.broadcast(means)).withColumn("cn", 2 * F.col("n") / mean).drop("_in", "_out", "_k", "_all")


def robust_bins(sub: DataFrame, width: int = 10_000, q: float = 0.8) -> DataFrame:
    """The q-quantile of sub-bin counts in each bin, by linear interpolation; masked sub-bins are null."""
    return sub.groupBy("chrom", bin_start(F.col("coord"), width).alias("coord")).agg(F.percentile("n", q).alias("n"))


def mean_bias(bias: DataFrame, width: int = 10_000) -> DataFrame:
    """Mean covariates (gc, mappability) of each bin."""
    return bias.groupBy("chrom", bin_start(F.col("start"), width).alias("coord")).agg(F.avg("gc").alias("gc"), F.avg("mappability").alias("mappability"))


def reset_bins(bins: DataFrame, black: DataFrame, width: int = 10_000) -> DataFrame:
    """Copy number 2 in every bin that a listed interval touches; counts stay."""
    hit = black.select("chrom", F.explode(F.sequence(bin_start(F.col("start"), width), bin_start(F.col("stop"), width), F.lit(width).cast("long"))).alias("coord")).distinct().withColumn("_hit", F.lit(True))
    return bins.join(hit, ["chrom", "coord"], "left").withColumn("cn", F.when(F.col("_hit"), 2.0).otherwise(F.col("cn"))).drop("_hit")


def along(by: tuple[str, ...] = ()):
    """The bins of a chromosome (of a sample) in order."""
    return Window.partitionBy(*by, "chrom").orderBy("coord")


def neighbours(df: DataFrame, value: str = "x", reach: int = 10, by: tuple[str, ...] = ()) -> DataFrame:
    """Count, mean and sample deviation of the rows within reach, without the row itself."""
    w, x = along(by).rowsBetween(-reach, reach), F.col(value)
    n = F.count(value).over(w) - F.when(x.isNull(), 0).otherwise(1)
    own = F.coalesce(x, F.lit(0.0))
    s, q = F.sum(value).over(w) - own, F.sum(x * x).over(w) - own * own
    df = df.withColumns({"near_n": n, "_s": s, "_q": q})
    df = df.withColumn("near_mean", F.try_divide("_s", "near_n"))
    var = F.try_divide(F.col("_q") - F.col("near_n") * F.col("near_mean") * F.col("near_mean"), F.col("near_n") - 1)
    return df.withColumn("near_sd", F.when(F.col("near_n") > 1, F.sqrt(F.greatest(var, F.lit(0.0))))).drop("_s", "_q")


def smooth_outliers(df: DataFrame, value: str = "x", reach: int = 10, far: float = 5.0, by: tuple[str, ...] = ()) -> DataFrame:
    """Values beyond far deviations of their neighbours become the triangularly weighted mean of these."""
    df = neighbours(df, value, reach, by)
    order = along(by)
    top = bottom = F.lit(0.0)
    for k in range(1, reach + 1):
        for x in (F.lag(value, k).over(order), F.lead(value, k).over(order)):
            top = top + F.coalesce(x * (reach + 1 - k), F.lit(0.0))
            bottom = bottom + F.when(x.isNull(), 0).otherwise(reach + 1 - k)
    out = F.abs(F.col(value) - F.col("near_mean")) > far * F.col("near_sd") + ROUNDING
    return df.withColumn("smooth", F.when(out, F.try_divide(top, bottom)).otherwise(F.col(value)))


def mask_upper(df: DataFrame, value: str = "n", reach: int = 10, far: float = 2.0, passes: int = 1, by: tuple[str, ...] = ()) -> DataFrame:
    """Nulls in place of values above the mean of their neighbours by far deviations, in passes over what is left."""
    df = df.withColumn(value, F.col(value).cast("double"))
    for _ in range(passes):
        df = neighbours(df, value, reach, by)
        df = df.withColumn(value, F.when(F.col(value) > F.col("near_mean") + far * F.col("near_sd") + ROUNDING, None).otherwise(F.col(value))).drop("near_n", "near_mean", "near_sd")
    return df


def fill_linear(df: DataFrame, value: str = "n", by: tuple[str, ...] = ()) -> DataFrame:
    """Linear interpolation of nulls by row in each chromosome; leading nulls stay, trailing ones take the last value."""
    w = along(by)
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    df = df.withColumn("_i", F.row_number().over(w)).withColumn("_k", F.when(F.col(value).isNotNull(), F.col("_i")))
    df = df.withColumns({"_a": F.last(value, True).over(back), "_ai": F.last("_k", True).over(back), "_b": F.first(value, True).over(ahead), "_bi": F.first("_k", True).over(ahead)})
    line = F.col("_a") + (F.col("_b") - F.col("_a")) * F.try_divide(F.col("_i") - F.col("_ai"), F.col("_bi") - F.col("_ai"))
    return df.withColumn("filled", F.coalesce(value, F.when(F.col("_a").isNull(), None).otherwise(F.coalesce(line, F.col("_a"))))).drop("_i", "_k", "_a", "_ai", "_b", "_bi")


def robust_copy_number(reads: DataFrame, width: int = 10_000, sub: int = 100, q: float = 0.5, reach: int = 10, passes: int = 10, by: tuple[str, ...] = ()) -> DataFrame:
    """chrom, coord, n, cn of bins that spikes don't lift: counts of sub-bins, the outliers among these masked in passes, the q-quantile of each bin's sub-bins, and bins without any filled between their neighbours; cn is twice n over its mean."""
    counts = mask_upper(bin_counts(reads, sub, by), reach=reach, passes=passes, by=by)
    held = counts.groupBy(*by, "chrom", bin_start(F.col("coord"), width).alias("coord")).agg(F.percentile("n", q).alias("n"))
    return copy_number(fill_linear(held, by=by).select(*by, "chrom", "coord", F.col("filled").alias("n")), by)


def runs_above(bins: DataFrame, cut: float, width: int = 10_000, bridge: int = 0, drop_single: bool = False, by: tuple[str, ...] = ()) -> DataFrame:
    """Runs of bins with cn above the cut, over gaps of at most bridge bins."""
    w = along(by)
    high = bins.where(F.col("cn") > cut).withColumn("_new", F.when(F.col("coord") - F.lag("coord").over(w) <= width * (1 + bridge), 0).otherwise(1))
    runs = high.withColumn("run", F.sum("_new").over(w)).groupBy(*by, "chrom", "run").agg(F.min("coord").alias("start"), (F.max("coord") + width).alias("stop"), F.count("*").alias("bins"), F.avg("cn").alias("cn"))
    return (runs.where("bins > 1") if drop_single else runs).drop("run")


def coverage_windows(windows: DataFrame, reads: DataFrame, read_length: int = 100, width: int = 10_000) -> DataFrame:
    """Depth of each window, and its median, mean and deviation over sound windows in one row. The median is the upper middle value."""
    hit = overlap_join(windows, reads.select("chrom", "start", "stop")).groupBy("chrom", "start").agg(F.count("*").alias("k"))
    depth = hit.select((F.col("k") * read_length / F.lit(width + 1)).alias("depth"))
    # The upper middle of the counts, from their histogram: as long as there are different ones, however many windows.
    held = hit.groupBy("k").agg(F.count("*").alias("_c")).withColumn("_upto", F.sum("_c").over(Window.orderBy("k")))
    middle = held.crossJoin(F.broadcast(held.agg(F.max("_upto").alias("_all")))).where(F.col("_upto") > F.floor(F.col("_all") / 2)).agg((F.min("k") * read_length / F.lit(width + 1)).alias("median"))
    sound = depth.crossJoin(F.broadcast(middle)).where("depth > 0 and depth < 5 * median")
    return sound.agg(F.max("median").alias("median"), F.avg("depth").alias("mean"), F.stddev_pop("depth").alias("sd"), F.count("*").alias("windows"))
