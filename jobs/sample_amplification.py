"""Copy number and amplified regions of each sample, with the genes on them.

    PYTHONPATH=. spark-submit jobs/sample_amplification.py --reads PATH --genes PATH --output PATH [--config FILE] [--samples A,B]

Reads that pass are counted in bins of ``width`` for each sample; the copy number
of a bin is twice its count over the mean of its own sample's occupied bins. Runs
of bins above ``least_cn``, over gaps of at most ``bridge`` bins, are the amplified
regions. The config says, as SQL expressions, how the columns of reads and genes
are read; rows without a sample are those of ``unknown``.

Output, partitioned by sample: ``bins`` (chrom, coord, n, cn) and ``amplified``
(chrom, start, stop, bins, cn, genes; a sample without regions has one row
without a chromosome, so that it is known to have been run). A run replaces the partitions of the
samples that it computes, and no others, so some samples can be run again
(--samples) and a run that failed is simply repeated.
"""

from __future__ import annotations

import argparse
import json
import logging
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from circlet.operators import bins, intervals, reads

log = logging.getLogger(__name__)
CONFIG = os.path.join(os.path.dirname(os.path.abspath(__file__)), "sample_amplification.json")
SAMPLE = ("sample",)
BINS = "chrom string, coord long, n long, cn double, sample string"
AMPLIFIED = "chrom string, start long, stop long, bins long, cn double, genes string, sample string"


def named(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """df in the columns that a config names, as SQL expressions."""
    return df.select(*[F.expr(text).alias(name) for name, text in columns.items()])


def binned(alignments: DataFrame, config: dict) -> DataFrame:
    """Copy number by sample and bin."""
    rows = reads.passing(alignments, config["min_mapq"], config["max_nm"]).where("chrom is not null and start is not null")
    return bins.copy_number(bins.bin_counts(rows, config["width"], SAMPLE), SAMPLE)


def amplified(cn: DataFrame, genes: DataFrame, config: dict) -> DataFrame:
    """Runs of high bins with the names of the genes that they overlap."""
    runs = bins.runs_above(cn, config["least_cn"], config["width"], config["bridge"], by=SAMPLE)
    key = ["sample", "chrom", "start"]
    names = intervals.map_all(runs, genes, key, "name").withColumnRenamed("name", "genes")
    return runs.join(names, key, "left").withColumn("genes", F.coalesce("genes", F.lit("")))


def replace(df: DataFrame, path: str, schema: str) -> DataFrame:
    """Writes the partitions of df's samples and returns all that is there."""
    spark = df.sparkSession
    columns = [c.split()[0] for c in schema.split(", ")]
    df.select(*columns).repartition("sample", "chrom").sortWithinPartitions("sample", "chrom", columns[1]).write.partitionBy("sample").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)
    out = spark.read.schema(schema).parquet(path)
    log.info("%s now has %s rows", path, out.count())
    return out


def run(spark: SparkSession, reads_path: str, genes_path: str, output: str, config: dict, samples: list[str] | None = None) -> DataFrame:
    """Runs all samples, or those that are listed, and returns the amplified regions as they then stand.

    Of a sample without regions an empty partition can't be written: its former regions go if it has any bins.
    """
    rows = named(spark.read.parquet(reads_path), config["reads"]).withColumn("sample", F.coalesce(F.nullif(F.col("sample").cast("string"), F.lit("")), F.lit("unknown")))
    if samples is not None:
        rows = rows.where(F.col("sample").isin(samples))
    genes = named(spark.read.parquet(genes_path), config["genes"])
    log.info("reads of %s, genes of %s, samples %s", reads_path, genes_path, "all" if samples is None else samples)
    replace(binned(rows, config), f"{output}/bins", BINS)
    cn = spark.read.schema(BINS).parquet(f"{output}/bins")
    if samples is not None:
        cn = cn.where(F.col("sample").isin(samples))
    for r in cn.groupBy("sample").agg(F.sum("n").alias("reads"), F.count("*").alias("bins")).orderBy("sample").limit(1_000).collect():
        log.info("sample %s: %s sound reads in %s bins", r.sample, r.reads, r.bins)
    regions = amplified(cn, genes, config)
    # A sample that has bins and no regions keeps its place with a row without a chromosome, so that what an earlier run wrote there goes.
    none = cn.select("sample").distinct().join(regions, "sample", "left_anti")
    replace(regions.unionByName(none, allowMissingColumns=True), f"{output}/amplified", AMPLIFIED)
    return spark.read.schema(AMPLIFIED).parquet(f"{output}/amplified").where("chrom is not null")


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    for name in ("--reads", "--genes", "--output"):
        p.add_argument(name, required=True)
    p.add_argument("--config", default=CONFIG)
    p.add_argument("--samples", help="comma-separated; the others stay as they are")
    a = p.parse_args(args)
    logging.basicConfig(level=logging.INFO)
    with open(a.config) as f:
        config = json.load(f)
    spark = SparkSession.builder.appName("sample_amplification").getOrCreate()
    try:
        run(spark, a.reads, a.genes, a.output.rstrip("/"), config, a.samples.split(",") if a.samples else None)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
