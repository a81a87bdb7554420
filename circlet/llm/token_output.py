"""Token-id output as ORC: run-length encoded ids, row indexes and Bloom filters on document ids.

Spark's ORC writer packs the integer lists with run-length encoding v2, keeps
minima and maxima for each stripe and each ``stride`` rows, and a Bloom filter
on ``doc_id``. Files are shards in ascending doc_id order, so a lookup by id
skips whole files, stripes and row groups, and readers split files by stripe.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_path, partitions, table
from .tokens import encoder, groups

END_ID = 2
FILE = "shard int, doc_id long, shard_start long, n_tokens int, tokens array<int>"


def _list_array(parts: list[bytes]) -> pa.Array:
    sizes = np.array([len(p) // 4 for p in parts], dtype="i8")
    values = np.frombuffer(b"".join(parts), dtype="<i4")
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype("i4")), pa.array(values))


def encode(docs: DataFrame, tokenizer: str, end_id: int = END_ID, shards: int | None = None) -> DataFrame:
    """docs (doc_id, text) as shard int, doc_id, shard_start long (ids before the document within its shard), n_tokens int, tokens array<int>.

    Shards are ranges of doc_id in ascending order, null ids first; rows of the
    same doc_id, which may span shards, stay in the order in which they are
    read. Null and empty texts give the end id alone. Every row of the input is
    one document, repeated rows included. Other columns are ignored.
    """
    shards = shards or partitions(docs.sparkSession)
    # the row's place makes every key of the range one of its own, so no doc_id is hot
    placed = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("place"))
    rows = placed.repartitionByRange(shards, "doc_id", "place").sortWithinPartitions("doc_id", "place").select(F.spark_partition_id().alias("shard"), "doc_id", "text")
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches):
        enc, at = encoder(tokenizer, False), 0
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in groups(texts):
                ids = [x + end for x in enc(texts[a:b])]
                n = np.array([len(x) // 4 for x in ids], dtype="i8")
                starts = at + np.cumsum(n) - n
                at += int(n.sum())
                yield pa.RecordBatch.from_arrays([batch.column("shard").slice(a, b - a), batch.column("doc_id").slice(a, b - a), pa.array(starts), pa.array(n.astype("i4")), _list_array(ids)], names=[c.split()[0] for c in FILE.split(", ")])

    return rows.mapInArrow(run, FILE)


def write_orc(encoded: DataFrame, path: str, stripe_bytes: int = 64 << 20, stride: int = 10_000, bloom_fpp: float = 0.01) -> str:
    (
        encoded.write.option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", str(bloom_fpp))
        .option("orc.create.index", "true")
        .option("orc.row.index.stride", str(stride))
        .option("orc.stripe.size", str(stripe_bytes))
        .option("orc.compress", "ZSTD")
        .orc(path)
    )
    return path


def read_orc(spark: SparkSession, path: str) -> DataFrame:
    """The files' rows with start: the ids of all documents before this one.

    Adds up what each shard holds, from two columns without the ids; the table
    of shards has one row for each file.
    """
    rows = spark.read.schema(FILE).orc(path)
    held = rows.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = held.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("base"))
    return rows.join(F.broadcast(before), "shard").select("doc_id", (F.col("base") + F.col("shard_start")).alias("start"), "tokens")


def find(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """Documents by id; the filter reaches the file, stripe and row-group statistics and the Bloom filters."""
    return spark.read.schema(FILE).orc(path).where(F.col("doc_id").isin(doc_ids)).select("doc_id", "tokens")


def digest(rows: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 from rows of read_orc()."""

    def run(batches):
        for batch in batches:
            lists = batch.column("tokens")
            ids = np.asarray(lists.values, dtype="<u4")
            at = np.asarray(lists.offsets)
            crc = [zlib.crc32(ids[a:b]) for a, b in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), pa.array(np.diff(at).astype("i8")), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op1_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = write_orc(encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")), new_path(spark, "orc"))
    return digest(read_orc(spark, path))
