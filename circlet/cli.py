"""Command line: de novo runs and searches for known rings."""

from __future__ import annotations

import argparse
import dataclasses

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from circlet.plans.run import Parameters, classify, de_novo, evidence, extract, targeted, targeted_amplicons
from circlet.sources import alignments, bam_index, sinks, tables

#: Tables that a command writes, as far as the run has them.
WRITTEN = ("amplified", "pairs", "segments", "rings", "annotated", "lines", "scores", "picked", "concordance", "stats")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="circlet")
    p.add_argument("command", choices=["denovo", "search", "extract", "evidence", "classify", "all"], help="denovo: find rings; search: the concordance of known ones; extract, evidence, classify: its steps; all: these and the de novo run on the known rings' chromosomes")
    p.add_argument("--input", help="BAM, SAM or Parquet of alignments; a folder of BAM files with --regions")
    p.add_argument("--output", required=True)
    p.add_argument("--known", help="known rings: a structure table, headered or not (all but denovo)")
    p.add_argument("--regions", help="BED of regions; of indexed BAM files nothing else is read")
    p.add_argument("--bias", help="tab-separated chrom, start, stop, gc, mappability with a header (denovo)")
    p.add_argument("--listed", help="BED of regions that aren't trusted (denovo)")
    p.add_argument("--genes", help="BED of genes (denovo)")
    for f in dataclasses.fields(Parameters):
        p.add_argument(f"--{f.name.replace('_', '-')}", type=type(f.default), default=f.default)
    return p


def read_alignments(spark: SparkSession, path: str, regions: str | None = None) -> DataFrame:
    if regions:
        asked = tables.read_bed(spark, regions).select("chrom", "start", "stop")
        indexed = path.endswith(".bam") or not path.endswith((".sam", ".parquet"))
        df = bam_index.fetch_indexed(spark, f"{path}*" if path.endswith(".bam") else path, asked) if indexed else alignments.fetch(read_alignments(spark, path), asked)
    else:
        df = alignments.read_bam(spark, path) if path.endswith(".bam") else alignments.read_sam(spark, path) if path.endswith(".sam") else spark.read.parquet(path)
    return df.withColumn("dup", F.col("flag").bitwiseAND(1024) != 0)


def main(args: list[str] | None = None) -> None:
    a = parser().parse_args(args)
    spark = SparkSession.builder.appName("circlet").getOrCreate()
    p = Parameters(**{f.name: getattr(a, f.name) for f in dataclasses.fields(Parameters)})
    known = tables.known_rings(spark, a.known) if a.known else None
    rows = read_alignments(spark, a.input, a.regions) if a.input else None
    write = lambda df, name: sinks.write_table(df, f"{a.output}/{name}", single=True)
    if a.command == "denovo":
        bias = tables.read_bias(spark, a.bias) if a.bias else None
        listed = tables.read_bed(spark, a.listed).select("chrom", "start", "stop") if a.listed else None
        found = de_novo(rows, f"{a.output}/stages", p, bias, listed, tables.read_genes(spark, a.genes) if a.genes else None)
    elif a.command == "all":
        found = targeted_amplicons(known, rows, f"{a.output}/stages", p)
    elif a.command == "extract":
        found = {"junctions": extract(known)}
    elif a.command == "evidence":
        found = {"evidence": evidence(rows, p)}
    else:
        pairs = evidence(rows, p)
        found = {"concordance": targeted(known, rows, p) if a.command == "search" else classify(extract(known), pairs, p)}
    if "alignments" in found:
        sinks.write_pictures(found["alignments"], f"{a.output}/alignments")
        sinks.write_bedgraph(found["track"], f"{a.output}/clips.bedgraph")
    for name in (*WRITTEN, "junctions", "evidence"):
        if name in found:
            write(found[name], name)


if __name__ == "__main__":
    main()
