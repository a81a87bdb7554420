"""Readers of annotation and table files, with fixed schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FRAGMENTS = "chrom string, start string, stop string, barcode string, n string"


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """BED of three or more fields, plain or gzip, split at white space: chrom, start, stop, extra array."""
    rows = spark.read.text(path).select(F.split(F.trim("value"), "\\s+").alias("f")).where((F.size("f") >= 3) & ~F.col("f")[0].startswith("#") & ~F.col("f")[0].isin("track", "browser"))
    number = lambda i: F.col("f")[i].try_cast("long")
    return rows.select(F.col("f")[0].alias("chrom"), number(1).alias("start"), number(2).alias("stop"), F.slice("f", 4, F.greatest(F.lit(0), F.size("f") - 3)).alias("extra")).where("start is not null and stop is not null")


def read_bed12(spark: SparkSession, path: str) -> DataFrame:
    """BED12 with its blocks as arrays."""
    rows = spark.read.text(path).select(F.split("value", "\t").alias("f")).where((F.size("f") >= 12) & ~F.col("f")[0].startswith("#"))
    ints = lambda i: F.transform(F.filter(F.split(F.col("f")[i], ","), lambda x: x != ""), lambda x: x.cast("long"))
    return rows.select(F.col("f")[0].alias("chrom"), F.col("f")[1].cast("long").alias("start"), F.col("f")[2].cast("long").alias("stop"), F.col("f")[3].alias("name"), F.col("f")[5].alias("strand"), ints(10).alias("block_sizes"), ints(11).alias("block_starts"))


def read_or_empty(spark: SparkSession, path: str | None) -> DataFrame:
    """A BED, or no rows where there is no path."""
    return read_bed(spark, path) if path else spark.createDataFrame([], "chrom string, start long, stop long, extra array<string>")


def read_sizes(spark: SparkSession, path: str) -> DataFrame:
    """Chromosome sizes from the first two fields."""
    f = F.split("value", "\\s+")
    return spark.read.text(path).select(f[0].alias("chrom"), f[1].try_cast("long").alias("length")).where("length is not null")


def read_bias(spark: SparkSession, path: str) -> DataFrame:
    """Five tab-separated columns whose header is replaced: chrom, start, stop, gc, mappability."""
    return spark.read.csv(path, sep="\t", header=True, enforceSchema=True, schema="chrom string, start long, stop long, gc double, mappability double")


def read_first_words(spark: SparkSession, path: str) -> DataFrame:
    """First word of each line below the header."""
    lines = spark.read.csv(path, header=True, sep="\x01", schema="line string")
    return lines.select(F.split(F.trim("line"), "\\s+")[0].alias("name")).where("name <> ''")


def read_table(spark: SparkSession, path: str, schema: str, sep: str = "\t") -> DataFrame:
    """A headered table; unreadable rows fail."""
    return spark.read.csv(path, sep=sep, header=True, schema=schema, enforceSchema=False, mode="FAILFAST")


def read_samples(spark: SparkSession, paths: dict[str, str], schema: str) -> DataFrame:
    """Tables of several samples with the sample and the circle's id in it."""
    out = None
    for sample, path in sorted(paths.items()):
        part = read_table(spark, path, schema).withColumn("sample", F.lit(sample)).withColumn("circle", F.concat_ws("_", "AmpliconID", F.lit(sample)))
        out = part if out is None else out.unionByName(part)
    return out


def read_fragments(spark: SparkSession, path: str) -> DataFrame:
    """Fragments: # lines and rows without whole numbers are skipped, a missing count is 1."""
    rows = spark.read.csv(path, sep="\t", comment="#", schema=FRAGMENTS)
    number = lambda c: F.col(c).try_cast("long")
    return rows.select("chrom", number("start").alias("start"), number("stop").alias("stop"), "barcode", F.when(F.col("n").isNull(), 1).otherwise(number("n")).alias("n")).where("start is not null and stop is not null and n is not null and barcode is not null")


def read_barcodes(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """ReadID and Barcode from a file or a folder, with the file."""
    return spark.read.csv(path, header=True, sep=sep, schema="ReadID string, Barcode string").withColumn("file", F.input_file_name())


def list_cell(col):
    """A cell like ['A', None] as an array; None and nan are null."""
    parts = F.regexp_extract_all(col, F.lit("'([^']*)'|\"([^\"]*)\"|([^\\[\\],\\s'\"]+)"), F.lit(0))
    clean = F.transform(parts, lambda x: F.regexp_replace(x, "^['\"]|['\"]$", ""))
    return F.transform(clean, lambda x: F.when(x.isin("None", "nan", "null", ""), None).otherwise(x))


def require_columns(df: DataFrame, names: list[str]) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


#: Columns of a structure table without header, in their order (fixed format).
HEADERLESS = ["Chrom", "Start", "End", "Strand", "Score", "AmpliconID", "Gene", "CancerGene", "SegmentEdge"]


def read_structures(spark: SparkSession, path: str) -> DataFrame:
    """Known structures: a headered table with AmpliconID, Chrom, Start, End and Strand, or six columns and more without a header. idx is the row's place in the file.

    A table of structures is read as one text, so that places are those of the file.
    """
    first = spark.read.text(path).limit(1).collect()
    if not first:
        raise ValueError(f"{path} is empty")
    fields = first[0].value.split("\t")
    headered = {"AmpliconID", "Chrom", "Start", "End", "Strand"} <= set(fields)
    if not headered and len(fields) < 6:
        raise ValueError(f"{path}: neither the named columns nor six columns")
    names = fields if headered else [*HEADERLESS[: len(fields)], *[f"Extra{i}" for i in range(len(fields) - len(HEADERLESS))]]
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("at", "line")).where((F.trim("line") != "") & (F.col("at") >= int(headered)))
    rows = lines.select((F.col("at") - int(headered)).cast("long").alias("idx"), F.split("line", "\t").alias("f"))
    rows = rows.select(*[F.nullif(F.get("f", F.lit(i)), F.lit("")).alias(n) for i, n in enumerate(names)], "idx")
    return rows.withColumns({"Start": F.col("Start").cast("long"), "End": F.col("End").cast("long")})


def known_rings(spark: SparkSession, path: str) -> DataFrame:
    """read_structures() as rings: ring, idx (from 1, in the order of the file), chrom, start, stop, strand."""
    rows = read_structures(spark, path)
    place = F.row_number().over(Window.partitionBy("AmpliconID").orderBy("idx"))
    return rows.select(F.col("AmpliconID").alias("ring"), place.alias("idx"), F.col("Chrom").alias("chrom"), F.col("Start").alias("start"), F.col("End").alias("stop"), F.col("Strand").alias("strand"))


def read_genes(spark: SparkSession, path: str) -> DataFrame:
    """A BED of genes: chrom, start, stop, name (the fourth field)."""
    return read_bed(spark, path).select("chrom", "start", "stop", F.get("extra", F.lit(0)).alias("name")).where("name is not null")


def first_existing(spark: SparkSession, *paths: str) -> str | None:
    """The first path that exists in its store."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            return path
    return None
