"""Embedding near-dedup by collision-counting projections.

A window of one sorted projection that keeps a link at the threshold holds
nearly half of all vectors, whatever their number (two deviations of 0.32 to
each side, of projections with deviation one), so windows of single projections
can't say which pairs to count without visiting nearly every pair. Which pairs
meet is therefore decided by several projections at once; collisions are
counted and calibrated for those.

Every distinct vector is projected on many random directions, scaled so that a
link at the threshold moves each projection by a known normal deviate. Tables
of a few projections each sort the vectors into cells; the number of tables
makes a link meet in one of them with probability ``RECALL``. Inside a cell the
query-centred windows of ``COUNTED`` further projections are counted for each
pair, and a pair is verified in double precision if it passes the count that a
link at the threshold reaches with probability ``RECALL``. A pair that meets in
several tables counts in the first. Cells over ``BLOCK`` vectors are split into
units of two chunks, so every pair of a hot cell still meets once and no task
holds the cell. Units give degrees and spanning forests, never pairs.
"""

from __future__ import annotations

from math import ceil, comb, log, log2, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import components, partitions, stage, table

COSINE, RECALL = 0.95, 0.999
WIDTH, COUNTED, BLOCK = 2.0, 24, 1024
SEED = 20_240_601


def design(n: int, cosine: float = COSINE, recall: float = RECALL) -> dict:
    """Projections a table, tables, window and count for n vectors.

    Projections are scaled to unit variance for a random unit vector; a link at
    the threshold differs by a normal deviate of deviation sqrt(2 - 2 cosine).
    """
    sigma = sqrt(2 - 2 * cosine)
    each = max(6, ceil(log2(max(n, 1) / 2000)))
    same = (1 - sigma * sqrt(2 / pi) / WIDTH) ** each
    tables = ceil(log(1 - recall) / log(1 - same))
    inside = 0.9545  # two deviations
    tail, count = 0.0, COUNTED
    while count > 0:
        tail += comb(COUNTED, count) * inside**count * (1 - inside) ** (COUNTED - count)
        if tail >= recall:
            break
        count -= 1
    return {"each": each, "tables": tables, "window": 2 * sigma, "count": count}


_drawn: dict = {}


def _directions(d: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    if (d, k) not in _drawn:
        rng = np.random.default_rng([SEED, d])
        a = rng.standard_normal((k, d))
        _drawn[d, k] = (sqrt(d) * a / np.linalg.norm(a, axis=1, keepdims=True)).T.copy(), np.random.default_rng([SEED, d, 1]).uniform(0, WIDTH, k)
    return _drawn[d, k]


def _unit_rows(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # the square of a large component must not overflow
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _cells(x: np.ndarray, plan: dict) -> np.ndarray:
    """(n, tables) hashes of the cells of unit rows."""
    k = plan["each"] * plan["tables"]
    a, shift = _directions(x.shape[1], k + COUNTED)
    grid = np.floor((x @ a[:, :k] + shift[:k]) / WIDTH).astype("i8").view("u8").reshape(len(x), plan["tables"], plan["each"])
    h = np.full(grid.shape[:2], x.shape[1] << 32, dtype="u8") ^ np.arange(plan["tables"], dtype="u8")
    h *= np.uint64(0x9E3779B97F4A7C15)  # spread first: small coordinates must not turn one table's cell into another's
    h ^= h >> np.uint64(29)
    for j in range(plan["each"]):
        h = (h ^ grid[:, :, j]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h.view("i8")


def _by_length(lists: pa.Array):
    """(rows, matrix) for each length of list."""
    offsets = np.asarray(lists.offsets)
    values, sizes = np.asarray(lists.values, dtype="f8"), np.diff(offsets)
    for d in np.unique(sizes):
        rows = np.flatnonzero(sizes == d)
        yield rows, values[offsets[rows][:, None] + np.arange(d)]


def _give_cells(plan: dict):
    def run(batches):
        for batch in batches:
            for rows, x in _by_length(batch.column("vec")):
                cells = _cells(_unit_rows(x), plan)
                keys = batch.column("key").take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([pa.array(cells.ravel()), pa.array(np.tile(np.arange(plan["tables"], dtype="i4"), len(rows))), keys.take(pa.array(np.repeat(np.arange(len(rows)), plan["tables"])))], names=["cell", "tab", "key"])

    return run


def _unite(root: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
    """Joins the components of u and v; root names each item's smallest member."""
    while True:
        a, b = root[u], root[v]
        apart = a != b
        if not apart.any():
            return
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:
            jump = root[root]
            if (jump == root).all():
                break
            root[:] = jump


def _meet(plan: dict, cosine: float):
    """Over rows sorted by unit: degrees (u, null, n) and links (u, v, 0) of each unit."""
    wide, k = np.float32(plan["window"]), plan["each"] * plan["tables"]

    def unit(keys, chunk, times, tab, x):
        x = _unit_rows(x)
        cells = _cells(x, plan)[:, :tab]
        p = (x @ _directions(x.shape[1], k + COUNTED)[0][:, k:]).astype("f4").T.copy()
        n, degree = len(x), np.zeros(len(x), dtype="i8")
        left, right = [], []
        cross = chunk.min() != chunk.max()
        for s in range(0, n, 256):
            e = min(s + 256, n)
            count = np.zeros((e - s, n - s), dtype="u1")
            for q in p:
                count += np.abs(q[s:e, None] - q[None, s:]) <= wide
            i, j = np.nonzero(count >= plan["count"])
            i, j = i + s, j + s
            ok = i < j
            if cross:
                ok &= chunk[i] != chunk[j]
            i, j = i[ok], j[ok]
            for a in range(0, len(i), 65536):
                u, v = i[a : a + 65536], j[a : a + 65536]
                ok = np.einsum("ij,ij->i", x[u], x[v]) >= cosine
                u, v = u[ok], v[ok]
                ok = ~(cells[u] == cells[v]).any(axis=1)
                np.add.at(degree, u[ok], times[v[ok]])
                np.add.at(degree, v[ok], times[u[ok]])
                left.append(u)
                right.append(v)
        yield from ((keys[i], None, int(degree[i])) for i in np.flatnonzero(degree))
        root = np.arange(n)
        for u, v in zip(left, right):
            _unite(root, u, v)
        yield from ((keys[i], keys[root[i]], 0) for i in np.flatnonzero(root != np.arange(n)))  # each component as a star

    def flush(held: pa.Table):
        lists = held.column("vec").combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        unit_ids = held.column("unit").to_numpy()
        at = np.flatnonzero(np.concatenate(([True], unit_ids[1:] != unit_ids[:-1], [True])))
        keys, chunk, times, tab = held.column("key").to_pylist(), held.column("chunk").to_numpy(), held.column("times").to_numpy(), held.column("tab").to_numpy()
        offsets, values = np.asarray(lists.offsets), np.asarray(lists.values, dtype="f8")
        rows = []
        for a, b in zip(at[:-1], at[1:]):
            if b - a > 1 and len(set(np.diff(offsets[a : b + 1]))) == 1:
                rows += unit(keys[a:b], chunk[a:b], times[a:b], tab[a], values[offsets[a] : offsets[b]].reshape(b - a, -1))
        cols = list(zip(*rows)) or [[], [], []]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int64()))], names=["u", "v", "n"])

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column("unit").to_numpy()
            last = int(np.searchsorted(ids, ids[-1]))
            if held and held[-1].column("unit")[0].as_py() != ids[0]:
                yield flush(pa.Table.from_batches(held))
                held = []
            if last:
                yield flush(pa.Table.from_batches([*held, batch.slice(0, last)]))
                held = []
            held.append(batch.slice(last))
        if held:
            yield flush(pa.Table.from_batches(held))

    return run


def near_vectors(vectors: DataFrame, cosine: float = COSINE, recall: float = RECALL) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row for each row of vectors (vec_id, embedding).

    Vectors that are null, empty, zero, or hold a null or a component that
    isn't finite link with nothing, and are components of their own. Equal
    vectors (by 128 bits of hashes) are one item that is counted as often as it
    occurs; vectors of different lengths never link. A null vec_id counts as a
    vector but names no component. Ties need no rule: a link is a link.

    A unit of two chunks holds the vectors themselves, in each table: candidate
    pairs are verified where they meet and never leave it, since a group of
    near copies has as many as its square.
    """
    spark = vectors.sparkSession
    # single precision stays so until it is computed with: half the bytes in each table's shuffle
    kind = vectors.schema["embedding"].dataType
    narrow = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)
    e = F.col("embedding").cast("array<float>" if narrow else "array<double>")
    sound = F.coalesce(F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0), F.lit(False))
    wide = e.cast("array<double>")
    key = F.when(sound, F.concat(F.hex(F.xxhash64(wide)), F.hex(F.xxhash64(F.lit(1), wide))))
    rows = vectors.select("vec_id", key.alias("key"), e.alias("vec"))
    items = stage(rows.where("key is not null").groupBy("key").agg(F.min("vec_id").alias("least"), F.count("*").alias("times"), F.first("vec").alias("vec")), "items")
    plan = design(items.count(), cosine, recall)
    n = partitions(spark)
    cells = stage(items.select("key", "vec").mapInArrow(_give_cells(plan), "cell long, tab int, key string"), "cells")
    held = stage(cells.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1").select("cell", F.ceil(F.col("n") / BLOCK).cast("int").alias("chunks")), "held")
    met = cells.join(held.hint("merge"), "cell").withColumn("chunk", F.pmod(F.xxhash64("key"), F.col("chunks")).cast("int"))
    met = met.select("cell", "tab", "key", "chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
    met = met.select(F.xxhash64("cell", F.least("chunk", "other"), F.greatest("chunk", "other")).alias("unit"), "tab", "chunk", "key")
    met = met.join(items.select("key", "times", "vec").hint("merge"), "key")
    found = stage(met.repartition(n, "unit").sortWithinPartitions("unit").mapInArrow(_meet(plan, cosine), "u string, v string, n long"), "found")
    degree = found.where("v is null").groupBy(F.col("u").alias("key")).agg(F.sum("n").alias("n"))
    roots = stage(components(found.where("v is not null").select("u", "v")), "roots")
    named = items.select("key", "least", "times").join(roots.hint("merge"), F.col("key") == F.col("node"), "left").select("key", "least", "times", F.coalesce("root", "key").alias("root"))
    named = stage(named.join(degree.hint("merge"), "key", "left").select("key", "least", "root", (F.col("times") - 1 + F.coalesce("n", F.lit(0))).alias("n_links")), "named")
    least = stage(named.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    named = stage(named.join(least.hint("merge"), "root").select("key", "n_links", "component_id"), "named")
    out = rows.select("vec_id", "key").join(named.hint("merge"), "key", "left")
    component = F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def op6_embedding_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


OP6_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
r AS (SELECT vec_id AS node, vec_id AS reach FROM embeddings UNION SELECT r.node, l.b FROM r JOIN l ON l.a = r.reach),
c AS (SELECT node AS vec_id, min(reach) AS component_id FROM r GROUP BY node),
n AS (SELECT a AS vec_id, count(*)::BIGINT AS n_links FROM l GROUP BY a)
SELECT c.vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, component_id = c.vec_id AS kept FROM c LEFT JOIN n USING (vec_id)
"""
