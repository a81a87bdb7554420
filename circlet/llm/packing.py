"""Best-fit packing of token sequences by large-item matching.

Only lengths matter to a packing, and there are at most ``capacity`` of them.
So the packing is made on the histogram of lengths, which every size of input
sums up to the same few thousand rows: pieces above one third of the capacity
are matched greedily, the largest left with the largest that still fits it, at
most two to a sequence; smaller pieces then go, in descending order, to the
tightest gap that holds them. The outcome is a list of runs of equally filled
sequences. Each piece finds its place from its length and its rank among the
pieces of that length, which is counted by task, so no length is ever gathered.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stage, table
from .tokens import encoder, groups

CAPACITY, END_ID = 4096, 1


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """Runs (sequences, [(length, pieces of it in each sequence), ...]) that hold every piece of the histogram."""
    left = {n: c for n, c in sorted(histogram.items()) if c > 0}
    if left and (min(left) < 1 or max(left) > capacity):
        raise ValueError("lengths must be from 1 to the capacity")
    runs: dict[int, list[tuple[int, list[tuple[int, int]]]]] = {}  # by what is free

    def put(times: int, items: list[tuple[int, int]], gap: int) -> None:
        if gap not in runs:
            runs[gap] = []
            if gap:
                insort(gaps, gap)
        runs[gap].append((times, items))

    gaps: list[int] = []
    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        a = large[-1]
        at = bisect_left(large, capacity - a + 1) - 1
        if at < 0:
            put(left[a], [(a, 1)], capacity - a)
            large.pop()
            continue
        b = large[at]
        if a == b:
            if left[a] > 1:
                put(left[a] // 2, [(a, 2)], capacity - 2 * a)
            left[a] %= 2
            if left[a] and at:
                b = large[at - 1]
            elif left[a]:
                put(1, [(a, 1)], capacity - a)
                left[a] = 0
        if left[a] and a != b:
            times = min(left[a], left[b])
            put(times, [(a, 1), (b, 1)], capacity - a - b)
            left[a] -= times
            left[b] -= times
        large = [n for n in large if left[n]]
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        rest = left[n]
        while rest:
            at = bisect_left(gaps, n)
            if at == len(gaps):
                each = capacity // n
                if times := rest // each:
                    put(times, [(n, each)], capacity - each * n)
                if more := rest % each:
                    put(1, [(n, more)], capacity - more * n)
                break
            gap = gaps[at]
            times, items = runs[gap].pop()
            if not runs[gap]:
                del runs[gap], gaps[at]
            each = min(gap // n, rest)
            full = min(times, rest // each)
            put(full, [*items, (n, each)], gap - each * n)
            if times > full:
                put(times - full, items, gap)
            rest -= full * each
    return [run for group in runs.values() for run in group]


def places(runs: list[tuple[int, list[tuple[int, int]]]]) -> dict[str, np.ndarray]:
    """By (length, first rank) in ascending order: the run's first sequence, pieces in each, and the offset of the first."""
    rank: dict[int, int] = {}
    rows, sequence = [], 0
    for times, items in runs:
        at = 0
        for n, each in items:
            rows.append((n, rank.get(n, 0), sequence, each, at))
            rank[n] = rank.get(n, 0) + times * each
            at += n * each
        sequence += times
    rows.sort()
    return {k: np.array([r[i] for r in rows], dtype="i8") for i, k in enumerate(("length", "rank", "sequence", "each", "offset"))}


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, ids: bool = False) -> DataFrame:
    """Pieces of each document with the task and the rank among the task's pieces of that length.

    A document is its ids and the end id; null and empty texts give the end id
    alone. Longer ones than the capacity are cut into pieces of the capacity,
    the last may be shorter. ids: also return the piece's tokens.
    """
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches):
        enc, seen = encoder(tokenizer, True), np.zeros(capacity + 1, dtype="i8")
        for batch in batches:
            texts, keys = batch.column("text").to_pylist(), batch.column("doc_id").to_pylist()
            for a, b in groups(texts):
                rows = []
                for key, data in zip(keys[a:b], enc(texts[a:b])):
                    data += end
                    for start in range(0, len(data), 4 * capacity):
                        part = data[start : start + 4 * capacity]
                        n = len(part) // 4
                        rows.append((key, start // (4 * capacity), start // 4, n, zlib.crc32(part), int(seen[n]), part))
                        seen[n] += 1
                cols = list(zip(*rows))
                arrays = [pa.array(c, t) for c, t in zip(cols[:6], (pa.int64(), pa.int32(), *[pa.int64()] * 4))]
                if ids:
                    arrays.append(pa.array(cols[6], pa.binary()))
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "piece", "start", "length", "ids_crc32", "task_rank", "ids"][: len(arrays)])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, task_rank long" + ", ids binary" * ids
    return docs.select("doc_id", "text").mapInArrow(run, schema).withColumn("task", F.spark_partition_id())


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids): one row for each piece.

    Each row of docs is a document; repeated rows and null doc_ids are packed
    like any other. An empty table gives no rows. Other columns are ignored.
    Pieces of equal length are alike to a packing: which of them comes first is
    left open. What reaches the driver is one count for each length.
    """
    spark = docs.sparkSession
    # The ranks are those of one run of the tasks: staged, a lost executor can't deal them anew.
    cut = stage(pieces(docs, tokenizer, capacity, end_id, ids), "pieces")
    counts = stage(cut.groupBy("length", "task").agg(F.count("*").alias("n")), "counts")
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    place = spark.sparkContext.broadcast(places(plan(histogram, capacity)))
    before = stage(counts.select("length", "task", (F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")).alias("before")), "before")
    ranked = cut.join(before.hint("merge"), ["length", "task"])
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] + ["ids"] * ids

    def run(batches):
        p = place.value
        key = p["length"] << 48 | p["rank"]
        for batch in batches:
            n = np.asarray(batch.column("length"))
            rank = np.asarray(batch.column("before")) + np.asarray(batch.column("task_rank"))
            at = np.searchsorted(key, n << 48 | rank, "right") - 1
            up = rank - p["rank"][at]
            out = {c: batch.column(c) for c in columns if c in batch.schema.names}
            out |= {"sequence_id": pa.array(p["sequence"][at] + up // p["each"][at]), "offset": pa.array(p["offset"][at] + up % p["each"][at] * n)}
            yield pa.RecordBatch.from_arrays([out[c] for c in columns], names=columns)

    return ranked.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long" + ", ids binary" * ids)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
