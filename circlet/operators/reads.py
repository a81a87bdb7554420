"""Operators over aligned reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def passing(reads: DataFrame, min_mapq: int = 20, max_nm: int = 3) -> DataFrame:
    """Reads of enough quality that aren't duplicates; a missing edit distance counts as 0."""
    return reads.where((F.col("mapq") >= min_mapq) & (F.coalesce("nm", F.lit(0)) <= max_nm) & ~F.col("dup"))


def clip_sites(reads: DataFrame) -> DataFrame:
    """One row for each clipped end: the left end at start, the right end at stop - 1; a read may have both."""
    ends = F.array(
        F.when(F.col("clip_l"), F.struct(F.col("start").alias("coord"), F.lit("L").alias("clip"))),
        F.when(F.col("clip_r"), F.struct((F.col("stop") - 1).alias("coord"), F.lit("R").alias("clip"))),
    )
    return reads.withColumn("_end", F.explode(F.filter(ends, lambda x: x.isNotNull()))).select("*", "_end.coord", "_end.clip").drop("_end")


def clip_counts(sites: DataFrame) -> DataFrame:
    return sites.groupBy("chrom", "coord", "clip").agg(F.count("*").alias("n"))


def bedgraph(counts: DataFrame, min_count: int = 2) -> DataFrame:
    """Clip track: left counts are negative."""
    return counts.where(F.col("n") >= min_count).select("chrom", F.col("coord").alias("start"), (F.col("coord") + 1).alias("stop"), F.when(F.col("clip") == "L", -F.col("n")).otherwise(F.col("n")).alias("value"))


def first_barcode(*tags: Column) -> Column:
    """The first tag that says something; blanks, 'None' and 'nan' don't."""
    clean = [F.when(~F.lower(F.trim(t)).isin("", "none", "nan"), F.trim(t)) for t in tags]
    return F.coalesce(*clean)


def downsample(reads: DataFrame, key: str, ratio: float) -> DataFrame:
    """A fixed share of names, so that mates stay together."""
    return reads.where(F.crc32(F.col(key).cast("string").cast("binary")) < int(ratio * 2**32))


def discordant(reads: DataFrame, max_insert: int = 450, min_mapq: int = 5) -> DataFrame:
    """Pairs that a proper insert doesn't explain (flag bits of the alignment format)."""
    bit = lambda n: F.col("flag").bitwiseAND(n) != 0
    near = (F.col("chrom") == F.col("mate_chrom")) & (bit(16) != bit(32)) & (F.abs(F.col("start") - F.col("mate_start")) < max_insert)
    return reads.where(bit(1) & ~bit(2) & ~bit(8) & ~bit(256) & ~bit(1024) & ~bit(2048) & (F.col("mapq") > min_mapq) & ~near)


def insert_size(pairs: DataFrame, order: str, n: int = 100_000) -> DataFrame:
    """Mean, population deviation and upper bound of the first n proper pairs."""
    first = pairs.orderBy(order).limit(n)
    return first.agg(F.avg("tlen").alias("mean"), F.stddev_pop("tlen").alias("sd")).select("mean", "sd", (F.col("mean") + 3 * F.col("sd")).alias("upper"))


def depth_at(sites: DataFrame, reads: DataFrame, share: float = 0.2, bucket: int = 1_000_000) -> DataFrame:
    """Depth of passing reads over each site (chrom, coord, clip, n), what lies outside the clips, and whether the site is clean.

    The depth at x is the reads that begin up to x less those that stop up to
    x: no read is joined with a site. Begins and stops are counted by place
    before the shuffle; running sums are taken inside buckets, and what is open
    where a bucket begins is one row for each bucket of the genome.
    """
    ends = F.explode(F.array(F.struct(F.col("start").alias("coord"), F.lit(1).alias("d")), F.struct(F.col("stop").alias("coord"), F.lit(-1).alias("d"))))
    steps = reads.where("start < stop").select("chrom", ends.alias("e")).groupBy("chrom", "e.coord").agg(F.sum("e.d").alias("_d"))
    cell = F.floor(F.col("coord") / bucket).alias("_bucket")
    steps = steps.select("chrom", cell, "coord", "_d")
    open_ = steps.groupBy("chrom", "_bucket").agg(F.sum("_d").alias("_d"))
    asked = sites.select("chrom", cell).distinct()
    # buckets with sites but without steps have something open, too
    both = open_.withColumn("_own", F.lit(1)).unionByName(asked.withColumns({"_d": F.lit(0).cast("long"), "_own": F.lit(0)}))
    both = both.groupBy("chrom", "_bucket").agg(F.sum("_d").alias("_d"))
    before = both.withColumn("_open", F.sum("_d").over(Window.partitionBy("chrom").orderBy("_bucket")) - F.col("_d")).drop("_d")
    rows = sites.select("chrom", cell, "coord", F.struct("clip", "n").alias("_site"), F.lit(0).cast("long").alias("_d")).unionByName(steps.withColumn("_site", F.lit(None).cast(T.StructType([sites.schema["clip"], sites.schema["n"]]))))
    rows = rows.withColumn("_d", F.sum("_d").over(Window.partitionBy("chrom", "_bucket").orderBy("coord"))).where("_site is not null")
    inside = F.col("_d") + F.col("_open")
    out = rows.join(before, ["chrom", "_bucket"]).select("chrom", "coord", "_site.clip", "_site.n", inside.alias("inside"))
    return out.select("chrom", "coord", "clip", "n", "inside", (F.col("inside") - F.col("n")).alias("outside"), F.coalesce(F.try_divide("n", "inside") >= share, F.lit(False)).alias("clean"))


def keep_first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")
