"""Helpers of the corpus operators, and connected components; staging is that of the library."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from circlet.sources.staging import drop_stage, hadoop_path, new_path, release, shared_root, stage  # noqa: F401

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: bytes.translate table that lower-cases A-Z and nothing else.
LOWER_AZ = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc_mod(doc_id, n: int):
    """crc32(doc_id as text) mod n as a Column (null id: the text is empty)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def crc_mod_py(doc_id, n: int) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % n


def lower_az(col):
    """Lower-cases A-Z only; text of ASCII alone takes the fast way."""
    return F.when(F.octet_length(col) == F.char_length(col), F.lower(col)).otherwise(F.translate(col, UPPER, UPPER.lower()))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the corpus. Rows hold whole texts, so batches between the JVM and Python are of few rows."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def aside(docs: DataFrame, *names: str) -> tuple[DataFrame, dict[str, str]]:
    """docs with the columns renamed that clash with an operator's own names, and how to name them back (withColumnsRenamed)."""
    own = {n.lower() for n in names}
    back = {f"its own {c}": c for c in docs.columns if c.lower() in own}
    return docs.withColumnsRenamed({c: new for new, c in back.items()}), back


def components(links: DataFrame) -> DataFrame:
    """Connected components by alternating large-star and small-star steps.

    links: columns u, v of one orderable type; rows with a null or u = v are
    skipped. Returns one row (node, root) for each node of a link, root being
    the component's smallest node. No links: no rows. Each half step takes the
    minimum around each node with map-side combining, stages it, and joins it
    back; hubs are thus summed before the shuffle and split in the join. Steps
    are taken until nothing changes, of the order of the logarithm of the
    longest chain; each one's tables are deleted when the next are written.
    """
    spark = links.sparkSession
    edges = stage(
        links.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(),
        "edges",
    )
    state = None
    while True:
        both = edges.union(edges.select("v", "u"))
        near = stage(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "large")
        large = both.join(near, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = stage(large, "edges")
        drop_stage(edges, near)
        least = stage(large.groupBy("u").agg(F.min("v").alias("m")), "small")
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", "m")).distinct()
        edges = stage(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
        drop_stage(large, least)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())

