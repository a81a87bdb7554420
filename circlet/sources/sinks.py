"""Writers: tables, tracks, stages and summaries."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .staging import hadoop_path

STAGE_VERSION = 1


def write_table(df: DataFrame, path: str, sep: str = "\t", header: bool = True, single: bool = False) -> str:
    """Delimited text; single puts a small result in one file. The fields of a struct are joined by colons, those of an array by commas."""
    said = lambda f: F.concat_ws(":", *[F.col(f"`{f.name}`.{x}").cast("string") for x in f.dataType.names]) if f.dataType.typeName() == "struct" else F.concat_ws(",", F.col(f"`{f.name}`").cast("array<string>"))
    df = df.withColumns({f.name: said(f) for f in df.schema if f.dataType.typeName() in ("struct", "array")})
    (df.coalesce(1) if single else df).write.mode("overwrite").csv(path, sep=sep, header=header)
    return path


def write_pictures(drawn: DataFrame, path: str) -> str:
    """The lines of each picture (ends, lines) as text, below a line that names its ends."""
    names = [c for c in drawn.columns if c != "lines"]
    head = F.concat(F.lit(">"), F.concat_ws("\t", *[F.col(c).cast("string") for c in names]))
    rows = drawn.select(*names, F.posexplode(F.concat(F.array(head), "lines", F.array(F.lit("")))).alias("at", "line"))
    rows.orderBy(*names, "at").select("line").coalesce(1).write.mode("overwrite").text(path)
    return path


def write_bedgraph(track: DataFrame, path: str) -> str:
    return write_table(track.select("chrom", "start", "stop", "value").orderBy("chrom", "start"), path, header=False)


def write_stage(df: DataFrame, path: str) -> str:
    """A stage of a run as Parquet with its schema version."""
    df.withColumn("_schema_version", F.lit(STAGE_VERSION)).write.mode("overwrite").parquet(path)
    return path


def read_stage(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.parquet(path)
    if not df.where(F.col("_schema_version") != STAGE_VERSION).isEmpty():
        raise ValueError(f"{path} has another schema version")
    return df.drop("_schema_version")


def content_digest(df: DataFrame | None) -> str:
    """What a table holds, whatever its order and partitions: a count and two sums of hashes, in one pass."""
    if df is None:
        return "none"
    row = F.to_json(F.struct(*[df[f"`{c}`"] for c in sorted(df.columns)]))
    n, a, b = df.agg(F.count("*"), F.sum(F.xxhash64(row).cast("decimal(38,0)")), F.sum(F.xxhash64(F.lit(1), row).cast("decimal(38,0)"))).first()
    return f"{','.join(sorted(df.columns))}:{n}:{a}:{b}"


class Stages:
    """Steps of a run by name under a folder. A step that is there is read only if it was made from the same input by the same code and parameters; else it is made again, and so is all that needs it.

    Beside each step is a manifest with its digest: of its name, its version, the
    parameters it uses, and the digests of what it needs. The manifest is taken
    away before a step is written and comes back after it, so a step that was cut
    short is made again.
    """

    def __init__(self, spark: SparkSession, path: str, inputs: dict[str, DataFrame | None], parameters: dict):
        self.spark, self.path, self.parameters = spark, path.rstrip("/"), parameters
        self.digests = {f"input:{name}": content_digest(df) for name, df in inputs.items()}
        self.made: list[str] = []

    def _manifest(self, name: str) -> str:
        return f"{self.path}/manifests/{name}"

    def _known(self, name: str) -> str | None:
        fs, at = hadoop_path(self.spark, f"{self._manifest(name)}/_SUCCESS")
        if not fs.exists(at):
            return None
        row = self.spark.read.schema("digest string").json(self._manifest(name)).first()
        return row.digest if row else None

    def step(self, name: str, make, needs: tuple[str, ...] = (), uses: tuple[str, ...] = (), version: int = 1) -> DataFrame:
        """The table of a step; needs: names of steps and inputs (input:...) that it reads, uses: names of parameters, version: of its code."""
        said = [name, STAGE_VERSION, version, {u: self.parameters[u] for u in sorted(uses)}, {n: self.digests[n] for n in sorted(needs)}]
        digest = self.digests[name] = hashlib.sha256(json.dumps(said).encode()).hexdigest()
        at = f"{self.path}/{name}"
        if self._known(name) != digest:
            fs, old = hadoop_path(self.spark, self._manifest(name))
            fs.delete(old, True)
            write_stage(make(), at)
            self.spark.createDataFrame([(digest,)], "digest string").coalesce(1).write.mode("overwrite").json(self._manifest(name))
            self.made.append(name)
        return read_stage(self.spark, at)


def write_sorted_reads(reads: DataFrame, path: str, files: int = 64) -> str:
    """Reads as Parquet in ranges of position, so that region filters prune files and row groups."""
    reads.repartitionByRange(files, "chrom", "start").sortWithinPartitions("chrom", "start").write.mode("overwrite").parquet(path)
    return path


def run_stats(**tables: DataFrame) -> DataFrame:
    """One row: the number of rows of each table."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias(name))
        out = one if out is None else out.crossJoin(one)
    return out


def write_json(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").json(path)
    return path
