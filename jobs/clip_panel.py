"""Panel of recurrent clip sequences, kept up to date as files of reads arrive.

Sequences that many reads of many samples share are artefacts of mapping or of
the library, not breakpoints; a search for breakpoints leaves them out. Each run
takes only files that no earlier run took: the stream's checkpoint says which.

    PYTHONPATH=. spark-submit jobs/clip_panel.py --input PATH --output PATH [--config FILE]

Input: Parquet with the columns that the config names (sample, sequence text of
one or more lines). Lines are cut into pieces of ``width`` letters, in upper
case; a piece of A, C, G, T and N alone counts as what sorts first of it and its
reverse complement. Pieces shorter than ``least_length`` don't count, nor do null texts.

Output: ``counts`` holds, by batch of the stream, how many rows and pieces of
each sample have a sequence; a batch that is repeated after a failure replaces
its own partition. ``panel``, partitioned by sample, is written anew from all
counts: sample, sequence, n_rows, n_pieces, and of all samples samples and
all_rows, for sequences that at least ``least_rows`` rows have. ``checkpoint`` is
the stream's. A run that finds nothing new leaves the same panel. An empty
sample is a null one.
"""

from __future__ import annotations

import argparse
import json
import logging
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from circlet.functions.text import reverse_complement

log = logging.getLogger(__name__)
CONFIG = os.path.join(os.path.dirname(os.path.abspath(__file__)), "clip_panel.json")
PANEL = "sequence string, n_rows long, n_pieces long, samples long, all_rows long, sample string"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def canonical(s: Column) -> Column:
    """A sequence as read from the strand that sorts first; what isn't one stays as it is."""
    return F.when(s.rlike("^[ACGTN]+$"), F.least(s, reverse_complement(s))).otherwise(s)


def pieces(rows: DataFrame, config: dict) -> DataFrame:
    """sample, sequence, first (no equal piece of its row is before it): one row for each piece."""
    cut = F.regexp_extract_all(F.translate(F.col(config["text"]), LOWER, LOWER.upper()), F.lit(f"[^\\n]{{1,{config['width']}}}"), F.lit(0))
    said = F.transform(F.filter(cut, lambda s: F.length(s) >= config["least_length"]), canonical)
    whole = rows.select(F.nullif(F.col(config["sample"]).cast("string"), F.lit("")).alias("sample"), F.sort_array(said).alias("_p"))
    marked = F.transform("_p", lambda s, i: F.struct(s.alias("sequence"), (~s.eqNullSafe(F.get("_p", i - 1))).alias("first")))
    return whole.select("sample", F.explode(marked).alias("p")).select("sample", "p.*")


def counted(rows: DataFrame, config: dict) -> DataFrame:
    """Rows and pieces of each sample by sequence: a row's equal pieces are known in the row, so pieces are shuffled once."""
    return pieces(rows, config).groupBy("sample", "sequence").agg(F.sum(F.col("first").cast("long")).alias("n_rows"), F.count("*").alias("n_pieces"))


def panel(counts: DataFrame, least_rows: int) -> DataFrame:
    """The panel from the counts of all batches. Most sequences are rare: hashes, which are short, tell which may be in it, and only these are summed whole."""
    hashed = counts.withColumn("_h", F.xxhash64("sequence"))
    often = hashed.groupBy("_h").agg(F.sum("n_rows").alias("_k")).where(F.col("_k") >= least_rows).select("_h")
    own = hashed.join(often, "_h", "left_semi").groupBy("sample", "sequence").agg(F.sum("n_rows").alias("n_rows"), F.sum("n_pieces").alias("n_pieces"))
    every = own.groupBy("sequence").agg(F.count("*").alias("samples"), F.sum("n_rows").alias("all_rows")).where(F.col("all_rows") >= least_rows)
    return own.join(every, "sequence").select("sequence", "n_rows", "n_pieces", "samples", "all_rows", "sample")


def pattern(path: str) -> str:
    """A path as a pattern that matches it alone: a stream's source takes folders and patterns, but no single file."""
    return path if any(c in path for c in "*?[{") else f"{path[:-1]}[{path[-1]}]"


def run(spark: SparkSession, source: str, output: str, config: dict) -> DataFrame:
    """Takes what is new at source into output, and returns the panel as it then stands."""
    counts_at, panel_at = f"{output}/counts", f"{output}/panel"

    def take(batch: DataFrame, number: int) -> None:
        rows = counted(batch, config).withColumn("batch", F.lit(number))
        rows.write.partitionBy("batch").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(counts_at)

    arriving = spark.readStream.schema(spark.read.parquet(source).schema).option("maxFilesPerTrigger", config["files_per_batch"]).parquet(pattern(source))
    stream = arriving.writeStream.foreachBatch(take).option("checkpointLocation", f"{output}/checkpoint").trigger(availableNow=True).start()
    stream.awaitTermination()
    for p in stream.recentProgress:
        log.info("batch %s: read %s rows of %s", p["batchId"], p["numInputRows"], source)
    held = spark.read.schema("sample string, sequence string, n_rows long, n_pieces long, batch long").parquet(counts_at)
    # by ranges of sample and sequence: one that holds most rows is many files, a small one is one
    panel(held, config["least_rows"]).repartitionByRange("sample", "sequence").write.partitionBy("sample").mode("overwrite").parquet(panel_at)
    out = spark.read.schema(PANEL).parquet(panel_at)
    log.info("wrote %s rows to %s", out.count(), panel_at)
    return out


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    p.add_argument("--input", required=True)
    p.add_argument("--output", required=True)
    p.add_argument("--config", default=CONFIG)
    a = p.parse_args(args)
    logging.basicConfig(level=logging.INFO)
    with open(a.config) as f:
        config = json.load(f)
    spark = SparkSession.builder.appName("clip_panel").getOrCreate()
    try:
        run(spark, a.input, a.output.rstrip("/"), config)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
