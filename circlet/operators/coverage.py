"""Coverage from a sample of windows, and whether reads are to be thinned out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bins import coverage_windows
from .intervals import overlap_join

#: Digits of a hash that make a number between 0 and 1.
DIGITS = 12


def draw(seed: int, number):
    """A number in [0, 1) from a seed and a row's number: the same whatever the partitions."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), number.cast("string"))), 1, DIGITS), 16, 10).cast("double") / float(16**DIGITS)


def draw_windows(sizes: DataFrame, n: int = 1_000, width: int = 10_000, seed: int = 1, listed: DataFrame | None = None, tries: int = 4) -> DataFrame:
    """At most n windows (chrom, start, stop) drawn evenly from the genome: by length of the chromosomes (chrom, length), in the order of chrom.

    A place is the first of its window; places in a chromosome's first width, and
    windows that go over its end or come within width of a listed interval, are
    passed over. Windows are numbered, and the first n sound ones of
    ``tries * n`` draws count. The chromosomes are one array: a genome has few.
    """
    spark = sizes.sparkSession
    ordered = sizes.agg(F.array_sort(F.collect_list(F.struct("chrom", "length"))).alias("c"), F.sum("length").alias("total"))
    draws = spark.range(tries * n).select(F.col("id").alias("i"), draw(seed, F.col("id")).alias("_u")).crossJoin(F.broadcast(ordered))
    # how much of the genome lies before each chromosome
    before = F.transform("c", lambda x, k: F.struct(x["chrom"].alias("chrom"), x["length"].alias("length"), F.aggregate(F.slice("c", F.lit(1), k), F.lit(0).cast("long"), lambda acc, y: acc + y["length"]).alias("before")))
    place = F.floor(F.col("_u") * F.col("total"))
    held = draws.select("i", place.alias("_x"), F.explode(before).alias("x")).where((F.col("x.before") <= F.col("_x")) & (F.col("_x") < F.col("x.before") + F.col("x.length")))
    start = F.col("_x") - F.col("x.before")
    rows = held.select("i", "x.chrom", start.alias("start"), (start + width).alias("stop"), "x.length").where((F.col("start") >= width) & (F.col("stop") <= F.col("length"))).drop("length")
    if listed is not None:
        hit = overlap_join(rows.withColumns({"start": F.col("start") - width, "stop": F.col("stop") + width}), listed.select("chrom", "start", "stop"))
        rows = rows.join(hit.select("i").distinct(), "i", "left_anti")
    return rows.orderBy("i").limit(n).select("chrom", "start", "stop").distinct()


def sampled_coverage(reads: DataFrame, windows: DataFrame, width: int = 10_000, longest: int = 10_000) -> DataFrame:
    """One row: read_length, insert_size and insert_sd, proper (the share of reads in proper pairs), and the median, mean and sd of depth over the sampled windows.

    reads: chrom, start, stop, length (of the whole read), flag, tlen. Inserts are
    those of proper pairs' forward reads below ``longest``. Reads over a window
    are met once, and lengths and inserts come from the same rows.
    """
    bit = lambda n: F.col("r_flag").bitwiseAND(n) != 0
    met = overlap_join(windows, reads.select("chrom", "start", "stop", "length", "flag", "tlen"))
    insert = F.when(bit(2) & ~bit(16) & (F.col("r_tlen") > 0) & (F.col("r_tlen") < longest), F.col("r_tlen"))
    one = met.agg(F.avg("r_length").alias("read_length"), F.avg(insert).alias("insert_size"), F.stddev_pop(insert).alias("insert_sd"), (2 * F.count(insert) / F.count("*")).alias("proper"))
    depth = coverage_windows(windows, reads, 1, width).select("median", "mean", "sd", "windows")
    both = one.crossJoin(F.broadcast(depth))
    return both.withColumns({c: F.col(c) * F.col("read_length") for c in ("median", "mean", "sd")})


def thinning(stats: DataFrame, size_gb: float, target: float = 10.0, most_gb: float = 50.0, most: float = 0.4) -> DataFrame:
    """stats with keep: the share of reads to keep. Files below most_gb are kept whole; of larger ones what brings the median to target, at most ``most``."""
    share = F.least(F.lit(most), F.coalesce(F.try_divide(F.lit(target), F.col("median")), F.lit(most)))
    return stats.withColumn("keep", F.lit(1.0) if size_gb < most_gb else share)
