"""State velocities of cells on an embedding."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from circlet.sources.staging import stage


#: Bytes of queries, or of points where these are no more, that are broadcast at a time.
QUERY_BYTES = 64 << 20


#: Rows of a block of points, and of queries: what a task compares at a time.
POINTS, QUERIES = 8_192, 512
#: Rows of what a task found that are kept before all but the nearest are dropped.
KEPT = 1 << 20


def _blocks(df: DataFrame, columns: list[str], rows: int, prefix: str) -> DataFrame:
    """df (id and arrays of numbers) in blocks: ids as an array, and each column as one run of doubles. Rows of other lengths are blocks of their own; rows with nulls in them are left out."""
    ids = df.schema["id"].dataType.simpleString()

    def pack(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            groups: dict = {}
            for row in zip(batch.column(0).to_pylist(), *[c.to_pylist() for c in batch.columns[1:]]):
                if all(v is not None and None not in v for v in row[1:]):
                    groups.setdefault(tuple(map(len, row[1:])), []).append(row)
            for held in groups.values():
                for i in range(0, len(held), rows):
                    part = held[i : i + rows]
                    data = [[np.array([r[k + 1] for r in part], "f8").tobytes()] for k in range(len(columns))]
                    arrays = [pa.array([[r[0] for r in part]], pa.list_(batch.column(0).type)), *[pa.array(d, pa.binary()) for d in data]]
                    yield pa.RecordBatch.from_arrays(arrays, names=[f"{prefix}id", *[f"{prefix}{c}" for c in columns]])

    return df.select("id", *[F.col(c).cast("array<double>") for c in columns]).mapInArrow(pack, ", ".join([f"{prefix}id array<{ids}>", *[f"{prefix}{c} binary" for c in columns]]))


def _bytes(df: DataFrame, columns: list[str]) -> int:
    return df.agg(F.sum(sum(8 * F.size(c) for c in columns) + 32)).first()[0] or 0


def _slices(df: DataFrame, bytes_: int) -> list[DataFrame]:
    """df in parts of about QUERY_BYTES."""
    n = max(1, -(-bytes_ // QUERY_BYTES))
    return [df if n == 1 else df.where(F.pmod(F.xxhash64("id"), F.lit(n)) == i) for i in range(n)]


def _compared(queries: DataFrame, points: DataFrame, query_columns: list[str], point_columns: list[str], run, schema: str, nearest: int | None = None, digits: int | None = None) -> DataFrame:
    """What run(query ids, their matrices, point ids, their matrices) gives as columns for each block of points with each of queries.

    queries is the smaller side: it is measured, and broadcast in slices of at most QUERY_BYTES.
    With ``nearest`` queries may be as many as points: then these are broadcast,
    queries are dealt, and a task keeps so many of the least (d to digits, id) of each q.
    """
    bytes_ = _bytes(queries, query_columns)
    many = nearest is not None and bytes_ >= (held := _bytes(points, point_columns))

    def pairs(batches):
        import numpy as np

        for batch in batches:
            rows = batch.to_pydict()
            for k in range(batch.num_rows):
                p, q = rows["_p_id"][k], rows["_q_id"][k]
                matrix = lambda name, ids: np.frombuffer(rows[name][k], "f8").reshape(len(ids), -1)
                qs, ps = [matrix(f"_q_{c}", q) for c in query_columns], [matrix(f"_p_{c}", p) for c in point_columns]
                for i in range(0, len(q), QUERIES):
                    yield from run(q[i : i + QUERIES], [m[i : i + QUERIES] for m in qs], p, ps)

    def named(arrays):
        import pyarrow as pa

        return pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], names=[c.split()[0] for c in schema.split(", ")])

    def each(batches):
        yield from map(named, pairs(batches))

    def least(found):
        import numpy as np

        q, p, d = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((p, d if digits is None else d.round(digits), q))
        q, p, d = q[order], p[order], d[order]
        best = np.arange(len(q)) - np.searchsorted(q, q) < nearest
        return q[best], p[best], d[best]

    def each_least(batches):
        found, rows, limit = [], 0, KEPT
        for arrays in pairs(batches):
            found.append(arrays)
            rows += len(arrays[0])
            if rows > limit:
                found = [least(found)]
                rows = len(found[0][0])
                limit = rows + KEPT
        if found:
            yield named(least(found))

    near = None
    if many:
        n = min(int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-queries.count() // QUERIES))
        dealt = _blocks(queries.repartition(max(1, n), "id"), query_columns, POINTS, "_q_")
        slices = _slices(points, held)
        for p in slices:
            met = dealt.crossJoin(F.broadcast(_blocks(p, point_columns, POINTS, "_p_"))).mapInArrow(each_least, schema)
            if len(slices) > 1:  # one slice is broadcast at a time
                met = stage(met, "nearest")
            near = met if near is None else near.union(met)
        return near
    for q in _slices(queries, bytes_):
        met = _blocks(points, point_columns, POINTS, "_p_").crossJoin(F.broadcast(_blocks(q, query_columns, QUERIES, "_q_")))
        near = met if near is None else near.union(met)
    return near.mapInArrow(each, schema)


def nearest(queries: DataFrame, points: DataFrame, k: int = 10, metric: str = "euclidean") -> DataFrame:
    """The k nearest points (id, vec) of each query (id, vec), smaller ids first of equals. d: squared Euclidean distance, or one less the correlation.

    Blocks of points meet blocks of queries. A product of matrices says which
    points may be among the k nearest, their distances are then taken from the
    differences; of each block, or where all points are asked of each task, the
    k best go on. Vectors with nulls, or without a finite distance, are near
    nothing. Correlations that agree to nine digits count as equal.
    """
    digits = 9 if metric == "correlation" else None

    def run(q, qs, p, ps):
        import numpy as np

        a, b = qs[0], ps[0]
        if a.shape[1] != b.shape[1]:
            return
        with np.errstate(all="ignore"):
            if metric == "correlation":  # less the mean, at unit length: half the squared distance is one less the correlation
                a, b = (x - x.mean(1, keepdims=True) for x in (a, b))
                a, b = (x / np.sqrt((x * x).sum(1, keepdims=True)) for x in (a, b))
            aa, bb = (a * a).sum(1), (b * b).sum(1)
            about = aa[:, None] + bb - 2 * (a @ b.T)
            slack = 1e-11 * (aa[:, None] + bb) + (2e-9 if metric == "correlation" else 0)
        q_ids, p_ids = np.array(q), np.array(p)
        about[q_ids[:, None] == p_ids] = np.nan
        about[~np.isfinite(about)] = np.inf
        reach = np.sort(np.partition(about + slack, k - 1, axis=1)[:, :k], axis=1)[:, -1] if k < len(p) else np.full(len(q), np.inf)
        i, j = np.nonzero((about - slack <= reach[:, None]) & np.isfinite(about))
        gap = a[i] - b[j]
        d = (gap * gap).sum(1) / (2 if metric == "correlation" else 1)
        order = np.lexsort((p_ids[j], d if digits is None else d.round(digits), i))
        i, j, d = i[order], j[order], d[order]
        first = np.searchsorted(i, i)
        best = np.arange(len(i)) - first < k
        yield q_ids[i[best]], p_ids[j[best]], d[best]

    types = [df.schema["id"].dataType.simpleString() for df in (queries, points)]
    near = _compared(queries, points, ["vec"], ["vec"], run, f"q {types[0]}, id {types[1]}, d double", k, digits)
    w = Window.partitionBy("q").orderBy("d" if digits is None else F.round("d", digits), "id")
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def transition(similar: DataFrame, sigma: float = 0.1) -> DataFrame:
    """Transition probabilities (a, b, p) from similarities (a, b, r): exp(r / sigma), normalised by column; missing is 0."""
    e = F.coalesce(F.exp(F.col("r") / sigma), F.lit(0.0))
    return similar.select("a", "b", e.alias("_e")).withColumn("p", F.coalesce(F.try_divide("_e", F.sum("_e").over(Window.partitionBy("b"))), F.lit(0.0))).drop("_e")


def grid_flow(arrows: DataFrame, n: int = 10, width: float = 0.5, least_mass: float = 1.0, least_length: float = 0.0) -> DataFrame:
    """Gaussian-weighted mean of arrows (x, y, dx, dy) on an n by n grid over their span."""
    span = arrows.agg(F.min("x").alias("_x0"), F.max("x").alias("_x1"), F.min("y").alias("_y0"), F.max("y").alias("_y1"))
    steps = F.sequence(F.lit(0), F.lit(n - 1))
    grid = span.withColumn("i", F.explode(steps)).withColumn("j", F.explode(steps))
    grid = grid.select("i", "j", (F.col("_x0") + F.col("i") * (F.col("_x1") - F.col("_x0")) / (n - 1)).alias("gx"), (F.col("_y0") + F.col("j") * (F.col("_y1") - F.col("_y0")) / (n - 1)).alias("gy"))
    met = arrows.crossJoin(F.broadcast(grid))  # the grid has n * n rows
    d2 = (F.col("x") - F.col("gx")) * (F.col("x") - F.col("gx")) + (F.col("y") - F.col("gy")) * (F.col("y") - F.col("gy"))
    w = F.exp(-d2 / (2 * width * width))
    out = met.groupBy("i", "j").agg(F.sum(w).alias("mass"), F.sum(w * F.col("dx")).alias("_x"), F.sum(w * F.col("dy")).alias("_y"))
    mass = F.greatest(F.lit(1.0), F.col("mass"))
    out = out.select("i", "j", "mass", (F.col("_x") / mass).alias("dx"), (F.col("_y") / mass).alias("dy"))
    return out.where((F.col("mass") >= least_mass) & (F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")) >= least_length))


def squash(x, kind: str):
    """Transform of a shift: log (sign * log10(|x| + 1)), sqrt (sign * sqrt(|x|)) or linear; ranks are of a whole vector, see ranked()."""
    return F.signum(x) * F.log10(F.abs(x) + 1) if kind == "log" else F.signum(x) * F.sqrt(F.abs(x)) if kind == "sqrt" else x


def ranked(v):
    """Ranks of a vector's components, the mean rank of equals."""
    return F.transform(v, lambda x: F.size(F.filter(v, lambda y: y < x)) + (F.size(F.filter(v, lambda y: y == x)) + 1) / 2.0)


def delta_correlation(cells: DataFrame, pairs: DataFrame, kind: str = "log") -> DataFrame:
    """Correlation r of the shift from cell a to b with the velocity of a, both squashed or (kind rank) ranked; a cell with itself has 0.

    cells: id, e (state) and v (velocity) as arrays of one length; pairs: a, b.
    """
    left = cells.select(F.col("id").alias("a"), F.col("e").alias("_ea"), F.col("v").alias("_va"))
    right = cells.select(F.col("id").alias("b"), F.col("e").alias("_eb"))
    shift = F.zip_with("_eb", "_ea", lambda x, y: squash(x - y, kind))
    rows = pairs.join(left, "a").join(right, "b").select("a", "b", shift.alias("_x"), F.transform("_va", lambda x: squash(x, kind)).alias("_y"))
    if kind == "rank":
        rows = rows.select("a", "b", ranked(F.col("_x")).alias("_x"), ranked(F.col("_y")).alias("_y"))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda acc, x: acc + x)
    product = lambda c, d: F.zip_with(c, d, lambda x, y: x * y)
    rows = rows.select("a", "b", F.size("_x").alias("n"), total("_x").alias("x"), total("_y").alias("y"), total(product("_x", "_x")).alias("xx"), total(product("_y", "_y")).alias("yy"), total(product("_x", "_y")).alias("xy"))
    n, x, y = F.col("n"), F.col("x"), F.col("y")
    r = F.try_divide(n * F.col("xy") - x * y, F.sqrt((n * F.col("xx") - x * x) * (n * F.col("yy") - y * y)))
    return rows.select("a", "b", F.when(F.col("a") == F.col("b"), 0.0).otherwise(r).alias("r"))


def rank_correlation(queries: DataFrame, cells: DataFrame) -> DataFrame:
    """a, b, r of each query (id, e, v) with every cell (id, e): delta_correlation() of kind rank for all pairs, which no table of pairs is made for."""

    def ranks(m):
        import numpy as np

        order = m.argsort(1, kind="stable")
        held = np.take_along_axis(m, order, 1)
        place = np.broadcast_to(np.arange(m.shape[1]), m.shape)
        new = np.concatenate([np.ones((len(m), 1), bool), held[:, 1:] != held[:, :-1]], 1)
        last = np.concatenate([new[:, 1:], np.ones((len(m), 1), bool)], 1)
        low = np.maximum.accumulate(np.where(new, place, 0), 1)
        high = np.minimum.accumulate(np.where(last, place, m.shape[1])[:, ::-1], 1)[:, ::-1]
        out = np.empty(m.shape)
        np.put_along_axis(out, order, (low + high) / 2 + 1, 1)
        return out

    def run(q, qs, p, ps):
        import numpy as np
        import pyarrow as pa

        e, v, other = *qs, ps[0]
        if not e.shape[1] == v.shape[1] == other.shape[1]:
            return
        n, p_ids, speed = e.shape[1], np.array(p), ranks(v)
        for i, a in enumerate(q):
            x, y = ranks(other - e[i]), speed[i]
            sx, sy = x.sum(1), y.sum()
            with np.errstate(all="ignore"):
                r = (n * (x @ y) - sx * sy) / np.sqrt((n * (x * x).sum(1) - sx * sx) * (n * (y @ y) - sy * sy))
            r[p_ids == a] = 0.0
            yield np.full(len(p), a), p_ids, pa.array(r, mask=np.isnan(r))

    types = [df.schema["id"].dataType.simpleString() for df in (queries, cells)]
    return _compared(queries, cells, ["e", "v"], ["e"], run, f"a {types[0]}, b {types[1]}, r double")
