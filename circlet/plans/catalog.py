"""Registered queries of the core engine and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from circlet.functions import text
from circlet.operators import bins, boundaries, breakpoints, cells, copynumber, graph, intervals, reads, segmentation, splitreads, velocity
from circlet.plans.adapters import ctes, load
from circlet.sources.staging import stage
from circlet.streaming import events as streams

FLAGSHIP = "amplified_genes"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

PASS = "mapq >= 20 and nm <= 3 and not dup"
BIN = "cast(floor(start / 10000.0) as bigint) * 10000"
BINS = f"b0 AS (SELECT chrom, {BIN} AS coord, count(*) AS n FROM reads WHERE {PASS} GROUP BY ALL),\nbins AS (SELECT chrom, coord, n, 2.0 * n / (SELECT avg(n) FROM b0) AS cn FROM b0)"


def query(name: str, *tables: str, sql: str | None = None, also: str = ""):
    """Registers a function of the named tables."""

    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(*[load(spark, sf_dir, t) for t in tables])
        if sql is not None:
            own = [t for t in tables if t in ("reads", "sites", "genes", "segments", "links", "rings", "frags", "strings")]
            head = ctes(*own) if own else ""
            if also:
                head = f"{head},\n{also}" if head else f"WITH {also}"
            if "UNION ALL SELECT" in also:  # a recursive part
                head = head.replace("WITH ", "WITH RECURSIVE ", 1)
            ORACLE_SQL[name] = f"{head}\n{sql}"
        return f

    return add


def r6(*names: str) -> dict:
    return {n: F.round(F.col(n), 6) for n in names}


def bins_of(df: DataFrame) -> DataFrame:
    return bins.copy_number(bins.bin_counts(reads.passing(df)))


# --- reads -----------------------------------------------------------------


@query("read_filter", "reads", sql=f"SELECT rid, line, pk, sk, chrom, start, stop, mapq, nm FROM reads WHERE {PASS}")
def _(df):
    return reads.passing(df).select("rid", "line", "pk", "sk", "chrom", "start", "stop", "mapq", "nm")


@query("clip_project", "reads", sql="SELECT rid, line, chrom, start AS coord, 'L' AS clip FROM reads WHERE clip_l UNION ALL SELECT rid, line, chrom, stop - 1, 'R' FROM reads WHERE clip_r")
def _(df):
    return reads.clip_sites(df).select("rid", "line", "chrom", "coord", "clip")


@query("barcode_coalesce", "reads", sql="SELECT rid, line, pk, sk, coalesce(CASE WHEN bc % 3 <> 0 THEN cast(bc AS varchar) END, CASE WHEN bc % 5 <> 0 THEN cast(pk AS varchar) END) AS barcode FROM reads")
def _(df):
    cb = F.when(F.col("bc") % 3 == 0, F.lit(" none ")).otherwise(F.concat(F.lit(" "), F.col("bc").cast("string")))
    cr = F.when(F.col("bc") % 5 == 0, F.lit("")).otherwise(F.col("pk").cast("string"))
    return df.select("rid", "line", "pk", "sk", reads.first_barcode(cb, cr).alias("barcode"))


@query("clip_counts", "reads", sql="SELECT chrom, coord, clip, count(*) AS n FROM (SELECT chrom, start AS coord, 'L' AS clip FROM reads WHERE clip_l UNION ALL SELECT chrom, stop - 1, 'R' FROM reads WHERE clip_r) GROUP BY ALL")
def _(df):
    return reads.clip_counts(reads.clip_sites(df))


@query("clip_bedgraph", "sites", sql="SELECT chrom, coord AS start, coord + 1 AS stop, CASE WHEN clip = 'L' THEN -n ELSE n END AS value FROM sites WHERE n >= 2")
def _(df):
    return reads.bedgraph(df)


@query("downsample_crc32", "reads")
def _(df):
    return reads.downsample(df, "rid", 0.4).select("rid", "line", "chrom", "start")


@query("discordant_reads", "reads", sql="SELECT rid, line, pk, sk, start, m FROM (SELECT *, CASE WHEN dup THEN 1025 ELSE CASE WHEN clip_l THEN 17 ELSE 1 END END AS flag, start + pk % 900 AS m FROM reads) WHERE (flag & 1024) = 0 AND mapq > 5 AND NOT ((flag & 16) <> 0 AND abs(start - m) < 450)")
def _(df):
    df = df.withColumns({"flag": F.when(F.col("dup"), 1025).otherwise(F.when(F.col("clip_l"), 17).otherwise(1)), "mate_chrom": F.col("chrom"), "mate_start": F.col("start") + F.col("pk") % 900})
    return reads.discordant(df).select("rid", "line", "pk", "sk", "start", F.col("mate_start").alias("m"))


@query("insert_size", "reads", sql="SELECT round(avg(t), 6) AS mean, round(stddev_pop(t), 6) AS sd, round(avg(t) + 3 * stddev_pop(t), 6) AS upper FROM (SELECT pk % 500 AS t FROM reads ORDER BY rid, line, pk, sk, start LIMIT 100000)")
def _(df):
    ordered = df.withColumns({"tlen": F.col("pk") % 500, "o": F.struct("rid", "line", "pk", "sk", "start")})
    return reads.insert_size(ordered, "o").withColumns(r6("mean", "sd", "upper"))


@query("breakpoint_depth", "sites", "reads", sql=f"SELECT chrom, coord, clip, n, k AS inside, k - n AS outside, coalesce(n * 1.0 / nullif(k, 0) >= 0.2, false) AS clean FROM (SELECT s.chrom, s.coord, s.clip, s.n, count(r.chrom) AS k FROM sites s LEFT JOIN (SELECT chrom, start, stop FROM reads WHERE {PASS}) r ON s.chrom = r.chrom AND r.start <= s.coord AND r.stop > s.coord GROUP BY s.chrom, s.coord, s.clip, s.n)")
def _(sites, df):
    return reads.depth_at(sites, reads.passing(df))


# --- bins ------------------------------------------------------------------


@query("bin_cn", "reads", also=BINS, sql="SELECT chrom, coord, n, round(cn, 6) AS cn FROM bins")
def _(df):
    return bins_of(df).withColumns(r6("cn"))


@query("robust_bin_quantile", "reads", also=f"s AS (SELECT chrom, cast(floor(start / 1000.0) as bigint) * 1000 AS coord, count(*) AS n FROM reads WHERE {PASS} GROUP BY ALL)", sql="SELECT chrom, cast(floor(coord / 10000.0) as bigint) * 10000 AS coord, round(quantile_cont(n::DOUBLE, 0.8), 6) AS n FROM s GROUP BY ALL")
def _(df):
    return bins.robust_bins(bins.bin_counts(reads.passing(df), 1000)).withColumns(r6("n"))


@query("targeted_bin_cn", "reads", "genes", also=BINS + ",\nm AS (SELECT b.*, EXISTS (SELECT 1 FROM genes g WHERE g.chrom = b.chrom AND g.start < b.coord + 10000 AND g.stop > b.coord AND g.start < g.stop) AS i FROM bins b)", sql="SELECT chrom, coord, n, round(2.0 * n / (SELECT CASE WHEN count(*) FILTER (NOT i) >= 10 THEN avg(n) FILTER (NOT i) ELSE avg(n) END FROM m), 6) AS cn FROM m")
def _(df, genes):
    return bins.targeted_copy_number(bins.bin_counts(reads.passing(df)), genes).withColumns(r6("cn"))


@query("bias_per_bin", "genes", sql="SELECT chrom, cast(floor(start / 10000.0) as bigint) * 10000 AS coord, round(avg((gid % 100) / 100.0), 6) AS gc, round(avg((gid % 37) / 37.0), 6) AS mappability FROM genes GROUP BY ALL")
def _(genes):
    bias = genes.select("chrom", "start", ((F.col("gid") % 100) / 100.0).alias("gc"), ((F.col("gid") % 37) / 37.0).alias("mappability"))
    return bins.mean_bias(bias).withColumns(r6("gc", "mappability"))


@query("blacklist_reset", "reads", "genes", also=BINS, sql="SELECT chrom, coord, n, round(CASE WHEN EXISTS (SELECT 1 FROM genes g WHERE g.chrom = b.chrom AND b.coord BETWEEN floor(g.start / 10000.0) * 10000 AND floor(g.stop / 10000.0) * 10000) THEN 2 ELSE cn END, 6) AS cn FROM bins b")
def _(df, genes):
    return bins.reset_bins(bins_of(df), genes).withColumns(r6("cn"))


NEAR_W = "OVER (PARTITION BY chrom ORDER BY coord ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING EXCLUDE CURRENT ROW)"


@query("smooth_outlier", "reads", also=BINS + f",\nx AS (SELECT *, log2(cn / 2) AS x FROM bins),\ne AS (SELECT *, avg(x) {NEAR_W} AS m, stddev_samp(x) {NEAR_W} AS s FROM x)", sql="SELECT chrom, coord, round(x, 4) AS x, round(m, 4) AS near_mean, round(s, 4) AS near_sd FROM e")
def _(df):
    x = bins_of(df).withColumn("x", F.log2(F.col("cn") / 2))
    return bins.smooth_outliers(x).select("chrom", "coord", F.round("x", 4).alias("x"), F.round("near_mean", 4).alias("near_mean"), F.round("near_sd", 4).alias("near_sd"))


def around_sql(k: int, weigh: str) -> str:
    return " + ".join(f"coalesce({weigh.format(x=f'{f}(x, {i}) OVER o', w=k + 1 - i)}, 0)" for i in range(1, k + 1) for f in ("lag", "lead"))


@query("smoothed_cn", "reads", also=BINS + f",\nx AS (SELECT *, log2(cn / 2) AS x FROM bins),\ne AS (SELECT *, avg(x) {NEAR_W} AS m, stddev_samp(x) {NEAR_W} AS s, {around_sql(10, '{x} * {w}')} AS t, {around_sql(10, 'CASE WHEN {x} IS NOT NULL THEN {w} END')} AS b FROM x WINDOW o AS (PARTITION BY chrom ORDER BY coord))", sql="SELECT chrom, coord, round(CASE WHEN abs(x - m) > 2 * s + 1e-9 THEN t / nullif(b, 0) ELSE x END, 6) AS smooth FROM e")
def _(df):
    x = bins_of(df).withColumn("x", F.log2(F.col("cn") / 2))
    return bins.smooth_outliers(x, far=2.0).select("chrom", "coord", F.round("smooth", 6).alias("smooth"))


@query("mask_upper_outlier", "reads", also=BINS + f",\ne AS (SELECT *, avg(n) {NEAR_W} AS m, stddev_samp(n) {NEAR_W} AS s FROM bins)", sql="SELECT chrom, coord, CASE WHEN n > m + 2 * s + 1e-9 THEN NULL ELSE n::DOUBLE END AS n FROM e")
def _(df):
    return bins.mask_upper(bins.bin_counts(reads.passing(df)), passes=1).select("chrom", "coord", "n")


TEN = BINS + ",\nm0 AS (SELECT chrom, coord, n::DOUBLE AS n FROM bins)" + "".join(f",\nm{k} AS (SELECT chrom, coord, CASE WHEN n > avg(n) {NEAR_W} + 2 * stddev_samp(n) {NEAR_W} + 1e-9 THEN NULL ELSE n END AS n FROM m{k - 1})" for k in range(1, 11))


@query("mask_ten_passes", "reads", also=TEN, sql="SELECT chrom, coord, n FROM m10")
def _(df):
    return bins.mask_upper(bins.bin_counts(reads.passing(df)), passes=10).select("chrom", "coord", "n")


@query("interpolate_gaps", "reads", also=BINS + """,
g AS (SELECT chrom, coord, row_number() OVER (PARTITION BY chrom ORDER BY coord) AS i, CASE WHEN n % 3 = 0 THEN NULL ELSE n::DOUBLE END AS n FROM bins),
k AS (SELECT *, CASE WHEN n IS NOT NULL THEN i END AS k FROM g),
f AS (SELECT chrom, coord, i, n, last_value(n IGNORE NULLS) OVER a AS a, last_value(k IGNORE NULLS) OVER a AS ai, first_value(n IGNORE NULLS) OVER b AS b, first_value(k IGNORE NULLS) OVER b AS bi FROM k
 WINDOW a AS (PARTITION BY chrom ORDER BY coord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (PARTITION BY chrom ORDER BY coord ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))""", sql="SELECT chrom, coord, round(coalesce(n, CASE WHEN a IS NULL THEN NULL WHEN b IS NULL THEN a ELSE a + (b - a) * (i - ai) * 1.0 / nullif(bi - ai, 0) END), 6) AS filled FROM f")
def _(df):
    x = bins.bin_counts(reads.passing(df)).withColumn("n", F.when(F.col("n") % 3 == 0, None).otherwise(F.col("n").cast("double")))
    return bins.fill_linear(x).select("chrom", "coord", F.round("filled", 6).alias("filled"))


ROBUST = f"m0 AS (SELECT chrom, cast(floor(start / 2000.0) as bigint) * 2000 AS coord, count(*)::DOUBLE AS n FROM reads WHERE {PASS} GROUP BY ALL)" + "".join(f",\nm{k} AS (SELECT chrom, coord, CASE WHEN n > avg(n) {NEAR_W} + 2 * stddev_samp(n) {NEAR_W} + 1e-9 THEN NULL ELSE n END AS n FROM m{k - 1})" for k in (1, 2)) + """,
h AS (SELECT chrom, cast(floor(coord / 20000.0) as bigint) * 20000 AS coord, quantile_cont(n, 0.7) AS n FROM m2 GROUP BY ALL),
k AS (SELECT *, CASE WHEN n IS NOT NULL THEN i END AS k FROM (SELECT *, row_number() OVER (PARTITION BY chrom ORDER BY coord) AS i FROM h) x),
f AS (SELECT chrom, coord, i, n, last_value(n IGNORE NULLS) OVER a AS a, last_value(k IGNORE NULLS) OVER a AS ai, first_value(n IGNORE NULLS) OVER b AS b, first_value(k IGNORE NULLS) OVER b AS bi FROM k
 WINDOW a AS (PARTITION BY chrom ORDER BY coord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (PARTITION BY chrom ORDER BY coord ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
y AS (SELECT chrom, coord, coalesce(n, CASE WHEN a IS NULL THEN NULL WHEN b IS NULL THEN a ELSE a + (b - a) * (i - ai) * 1.0 / nullif(bi - ai, 0) END) AS n FROM f)"""


@query("robust_copy_number", "reads", also=ROBUST, sql="SELECT chrom, coord, round(n, 6) AS n, round(2 * n / (SELECT avg(n) FROM y), 6) AS cn FROM y")
def _(df):
    return bins.robust_copy_number(reads.passing(df), 20_000, 2_000, 0.7, passes=2).withColumns(r6("n", "cn"))


@query("runs_above", "reads", also=BINS + ",\nh AS (SELECT *, CASE WHEN coord - lag(coord) OVER (PARTITION BY chrom ORDER BY coord) <= 30000 THEN 0 ELSE 1 END AS k FROM bins WHERE cn > 3),\ng AS (SELECT *, sum(k) OVER (PARTITION BY chrom ORDER BY coord) AS g FROM h)", sql="SELECT chrom, min(coord) AS start, max(coord) + 10000 AS stop, count(*) AS bins, round(avg(cn), 6) AS cn FROM g GROUP BY chrom, g HAVING count(*) > 1")
def _(df):
    return bins.runs_above(bins_of(df), 3.0, bridge=2, drop_single=True).withColumns(r6("cn"))


AMPLIFIED = BINS + ",\nh AS (SELECT *, CASE WHEN coord - lag(coord) OVER (PARTITION BY chrom ORDER BY coord) <= 20000 THEN 0 ELSE 1 END AS k FROM bins WHERE cn > 2.99),\ng AS (SELECT *, sum(k) OVER (PARTITION BY chrom ORDER BY coord) AS g FROM h),\namp AS (SELECT chrom, min(coord) AS start, max(coord) + 10000 AS stop, count(*) AS bins, avg(cn) AS cn FROM g GROUP BY chrom, g)"


def amplified(df):
    return bins.runs_above(bins_of(df), 2.99, bridge=1)


@query("amplified_genes", "reads", "genes", also=AMPLIFIED, sql="SELECT a.chrom, a.start, a.stop, a.bins, round(a.cn, 6) AS cn, coalesce(string_agg(DISTINCT g.name, '; ' ORDER BY g.name), '') AS genes FROM amp a LEFT JOIN genes g ON g.chrom = a.chrom AND g.start < a.stop AND a.start < g.stop AND g.start < g.stop GROUP BY ALL")
def _(df, genes):
    amp = amplified(df)
    named = intervals.map_all(amp, genes, ["chrom", "start", "stop"], "name")
    return amp.join(named, ["chrom", "start", "stop"], "left").withColumns(r6("cn")).withColumn("genes", F.coalesce("name", F.lit(""))).drop("name")


@query("coverage_stats", "reads", "genes", also=f"w AS (SELECT DISTINCT chrom, start, start + 10000 AS stop FROM genes),\nd AS (SELECT count(*) * 100 / 10001.0 AS d FROM w JOIN (SELECT * FROM reads WHERE {PASS}) r ON r.chrom = w.chrom AND r.start < w.stop AND w.start < r.stop GROUP BY w.chrom, w.start),\nm AS (SELECT list_sort(list(d))[cast(floor(count(*) / 2.0) as bigint) + 1] AS m FROM d)", sql="SELECT round(max(m), 6) AS median, round(avg(d), 6) AS mean, round(stddev_pop(d), 6) AS sd, count(*) AS windows FROM d, m WHERE d > 0 AND d < 5 * m")
def _(df, genes):
    windows = genes.select("chrom", "start", (F.col("start") + 10000).alias("stop")).distinct()
    return bins.coverage_windows(windows, reads.passing(df)).withColumns(r6("median", "mean", "sd"))


# --- intervals -------------------------------------------------------------

OVER = "g.chrom = s.chrom AND g.start < s.stop AND s.start < g.stop AND g.start < g.stop AND s.start < s.stop"


@query("interval_semi", "segments", "genes", sql=f"SELECT seg, chrom, start, stop FROM segments s WHERE EXISTS (SELECT 1 FROM genes g WHERE {OVER} AND g.brand <> s.brand)")
def _(segments, genes):
    return intervals.unlike(segments, genes, "brand").select("seg", "chrom", "start", "stop")


@query("interval_anti", "segments", "reads", sql="SELECT seg, chrom, start, stop FROM segments s WHERE NOT EXISTS (SELECT 1 FROM reads g WHERE g.mapq = 50 AND g.chrom = s.chrom AND g.start < s.stop AND s.start < g.stop)")
def _(segments, df):
    return intervals.clear_of(segments, df.where("mapq = 50"), ["seg"]).select("seg", "chrom", "start", "stop")


@query("interval_map_first", "segments", "genes", sql=f"SELECT seg, arg_min(g.name, g.gid) AS name FROM segments s JOIN genes g ON {OVER} GROUP BY seg")
def _(segments, genes):
    return intervals.map_first(segments, genes, ["seg"], "name", "gid")


@query("interval_map_all", "segments", "genes", sql=f"SELECT seg, string_agg(DISTINCT g.name, '; ' ORDER BY g.name) AS name FROM segments s JOIN genes g ON {OVER} GROUP BY seg")
def _(segments, genes):
    return intervals.map_all(segments, genes, ["seg"], "name")


@query("cancer_gene_intersect", "segments", "genes", sql=f"SELECT seg, string_agg(DISTINCT g.name, '; ' ORDER BY g.name) AS cancer FROM segments s JOIN genes g ON {OVER} AND g.kind = 'PROMO' GROUP BY seg")
def _(segments, genes):
    listed = genes.where("kind = 'PROMO'").select("name").distinct()
    return intervals.map_all(segments, genes.join(listed, "name", "left_semi"), ["seg"], "name").withColumnRenamed("name", "cancer")


ISLANDS = "i0 AS (SELECT *, CASE WHEN start >= max(stop) OVER (PARTITION BY chrom ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + {gap} OR row_number() OVER (PARTITION BY chrom ORDER BY start, stop) = 1 THEN 1 ELSE 0 END AS k FROM {t}),\ni1 AS (SELECT *, sum(k) OVER (PARTITION BY chrom ORDER BY start, stop) AS g FROM i0),\nmerged AS (SELECT chrom, min(start) AS start, max(stop) AS stop, count(*) AS n FROM i1 GROUP BY chrom, g)"


@query("merge_bed", "segments", also=ISLANDS.format(gap=200000, t="segments"), sql="SELECT * FROM merged")
def _(segments):
    return intervals.merge_bed(segments)


@query("padded_membership", "sites", "segments", also=ISLANDS.format(gap=200000, t="segments"), sql="SELECT DISTINCT p.chrom, coord, clip, p.n FROM sites p JOIN merged m ON p.chrom = m.chrom AND coord < m.stop + 10000 AND coord >= m.start - 10000")
def _(sites, segments):
    return intervals.padded_membership(sites, segments)


@query("size_filter", "segments", also=ISLANDS.format(gap=200000, t="segments"), sql="SELECT seg, chrom, start, stop FROM segments s WHERE NOT EXISTS (SELECT 1 FROM merged m WHERE m.chrom = s.chrom AND m.start = s.start AND m.stop = s.stop AND m.stop - m.start < 30000)")
def _(segments):
    return intervals.drop_small_rois(segments, 30_000).select("seg", "chrom", "start", "stop")


@query("component_boundaries", "segments", also=ISLANDS.replace("start >= max", "start > max").format(gap=30000, t="(SELECT * FROM segments WHERE cn >= 4.5)"), sql="SELECT chrom, start AS left_end, stop AS right_end, n FROM merged")
def _(segments):
    return intervals.supported_boundaries(segments)


@query("component_membership", "sites", "segments", also="c AS (SELECT chrom, start, stop FROM segments WHERE start < stop),\nd AS (SELECT p.chrom, coord, clip, c.start, c.stop, greatest(c.start - coord, coord - c.stop, 0) AS far FROM sites p JOIN c ON c.chrom = p.chrom AND c.start - coord <= 20000 AND coord - c.stop <= 20000)", sql="SELECT chrom, coord, clip, min(far) AS distance FROM d GROUP BY ALL")
def _(sites, segments):
    return intervals.component_of(sites, segments.select("chrom", "start", "stop"), ["chrom", "coord", "clip"]).select("chrom", "coord", "clip", "distance")


@query("reciprocal_overlap", "rings", also="""q AS (SELECT * FROM rings),
i0 AS (SELECT ring, chrom, start, stop, CASE WHEN start > max(stop) OVER (PARTITION BY ring, chrom ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 OR row_number() OVER (PARTITION BY ring, chrom ORDER BY start, stop) = 1 THEN 1 ELSE 0 END AS k FROM q),
i1 AS (SELECT *, sum(k) OVER (PARTITION BY ring, chrom ORDER BY start, stop) AS g FROM i0),
m AS (SELECT ring, chrom, min(start) AS start, max(stop) + 1 AS stop FROM i1 GROUP BY ring, chrom, g),
t AS (SELECT ring, sum(stop - start)::BIGINT AS total FROM m GROUP BY ring),
c AS (SELECT a.ring, b.ring AS other, sum(least(a.stop, b.stop) - greatest(a.start, b.start))::BIGINT AS common FROM m a JOIN m b ON a.chrom = b.chrom AND a.ring < b.ring AND a.start < b.stop AND b.start < a.stop GROUP BY ALL)""", sql="SELECT c.ring, other, common, t.total, u.total AS other_total, round(common * 1.0 / greatest(t.total, u.total), 6) AS overlap FROM c JOIN t USING (ring) JOIN t u ON u.ring = other")
def _(rings):
    return intervals.reciprocal_overlap(rings).withColumns(r6("overlap"))


@query("linear_positions", "sites", also="z AS (SELECT chrom, max(coord) + 1 AS length FROM sites GROUP BY chrom),\no AS (SELECT chrom, sum(length) OVER (ORDER BY chrom) - length AS o FROM z)", sql="SELECT chrom, coord, clip, (coord + o)::BIGINT AS position FROM sites JOIN o USING (chrom)")
def _(sites):
    sizes = sites.groupBy("chrom").agg((F.max("coord") + 1).alias("length"))
    return intervals.linear_positions(sites, sizes).select("chrom", "coord", "clip", "position")


# --- breakpoints -----------------------------------------------------------

EDGES = "ln AS (SELECT CASE WHEN (chrom1, coord1, clip1) <= (chrom2, coord2, clip2) THEN row(chrom1, coord1, clip1) ELSE row(chrom2, coord2, clip2) END AS a, CASE WHEN (chrom1, coord1, clip1) <= (chrom2, coord2, clip2) THEN row(chrom2, coord2, clip2) ELSE row(chrom1, coord1, clip1) END AS b, rid FROM links),\npairs AS (SELECT a[1] AS chrom1, a[2] AS coord1, a[3] AS clip1, b[1] AS chrom2, b[2] AS coord2, b[3] AS clip2, count(*) AS n, min(rid) AS first_rid, count(DISTINCT rid) AS rids FROM ln GROUP BY a, b)"


@query("nearest_clip_boundary", "segments", "sites", also="e AS (SELECT DISTINCT chrom, start AS coord, 'L' AS clip FROM segments)", sql="SELECT e.chrom, e.coord, e.clip, arg_max(s.coord, (s.n, -abs(e.coord - s.coord), -s.coord)) AS at, max(s.n) AS n FROM e JOIN sites s ON s.chrom = e.chrom AND s.clip = e.clip AND abs(e.coord - s.coord) <= 10000 GROUP BY ALL")
def _(segments, sites):
    ends = segments.select("chrom", F.col("start").alias("coord"), F.lit("L").alias("clip")).distinct()
    return breakpoints.nearest_strong_clip(ends, sites)


@query("rescue_near_edge", "sites", "links", also="e AS (SELECT chrom1 AS chrom, coord1 AS coord, clip1 AS clip, count(*) AS support FROM links GROUP BY ALL)", sql="SELECT chrom, coord, clip, n FROM sites s WHERE n >= 3 OR EXISTS (SELECT 1 FROM e WHERE e.support >= 2 AND e.chrom = s.chrom AND e.clip = s.clip AND abs(e.coord - s.coord) <= 150)")
def _(sites, links):
    ends = links.groupBy(F.col("chrom1").alias("chrom"), F.col("coord1").alias("coord"), F.col("clip1").alias("clip")).agg(F.count("*").alias("support"))
    return breakpoints.rescue_near_edge(sites, ends)


@query("topn_ties_dropped", "sites", also="r AS (SELECT *, row_number() OVER (PARTITION BY clip ORDER BY n DESC, chrom, coord) AS k FROM sites),\nc AS (SELECT clip, n AS cut FROM r WHERE k = 500)", sql="SELECT chrom, coord, s.clip, n FROM sites s LEFT JOIN c ON c.clip = s.clip WHERE cut IS NULL OR n > cut")
def _(sites):
    return breakpoints.top_n(sites, 500).select("chrom", "coord", "clip", "n")


@query("topn_per_chrom", "sites", sql="SELECT * FROM (SELECT chrom, coord, clip, n, row_number() OVER (PARTITION BY chrom, clip ORDER BY n DESC, coord) AS rank FROM sites) WHERE rank <= 20")
def _(sites):
    return breakpoints.top_n_per_chrom(sites, 20).withColumn("rank", F.col("rank").cast("long"))


@query("collapse_edges", "links", also=EDGES, sql="SELECT chrom1, coord1, clip1, chrom2, coord2, clip2, n, first_rid, rids FROM pairs")
def _(links):
    out = breakpoints.count_links(links)
    return out.select("chrom1", "coord1", "clip1", "chrom2", "coord2", "clip2", "n", F.element_at("rids", 1).alias("first_rid"), F.size("rids").cast("long").alias("rids"))


@query("refine_counts", "links", "sites", also=EDGES + ",\ne AS (SELECT chrom1 AS chrom, coord1 AS coord, clip1 AS clip, n FROM pairs UNION ALL SELECT chrom2, coord2, clip2, n FROM pairs),\ng AS (SELECT chrom, coord, clip, sum(n)::BIGINT AS p FROM e GROUP BY ALL)", sql="SELECT g.chrom, g.coord, g.clip, greatest(p, coalesce(s.n, 0)) AS n FROM g LEFT JOIN sites s ON s.chrom = g.chrom AND s.coord = g.coord AND s.clip = g.clip AND s.n > 1")
def _(links, sites):
    return breakpoints.refine_counts(breakpoints.count_links(links), sites)


@query("pe_pairs", "links", also="e AS (SELECT DISTINCT chrom1 || ':' || (coord1 // 100000) AS e, rid FROM links)", sql="SELECT a.e AS \"end\", b.e AS other, count(*) AS n FROM e a JOIN e b ON a.rid = b.rid AND a.e < b.e GROUP BY ALL HAVING count(*) >= 2")
def _(links):
    ends = links.select(F.concat_ws(":", "chrom1", F.floor(F.col("coord1") / 100000)).alias("end"), "rid").distinct()
    return breakpoints.shared_reads(ends)


@query("pair_combinations", "sites", "links", also="t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chrom, clip ORDER BY n DESC, coord) AS k FROM sites) WHERE k <= 20)", sql="SELECT a.chrom AS grp, a.chrom AS chrom1, a.coord AS coord1, a.clip AS clip1, b.chrom AS chrom2, b.coord AS coord2, b.clip AS clip2 FROM t a JOIN t b ON a.chrom = b.chrom AND (a.coord, a.clip) < (b.coord, b.clip) WHERE NOT EXISTS (SELECT 1 FROM links l WHERE (l.chrom1 = a.chrom AND l.coord1 = a.coord AND l.clip1 = a.clip AND l.chrom2 = b.chrom AND l.coord2 = b.coord AND l.clip2 = b.clip) OR (l.chrom2 = a.chrom AND l.coord2 = a.coord AND l.clip2 = a.clip AND l.chrom1 = b.chrom AND l.coord1 = b.coord AND l.clip1 = b.clip))")
def _(sites, links):
    top = breakpoints.top_n_per_chrom(sites, 20).withColumn("grp", F.col("chrom"))
    return breakpoints.combinations(top, links, ["grp"])


@query("discordant_clusters", "links", also="w0 AS (SELECT *, CASE WHEN coord1 - lag(coord1) OVER (PARTITION BY chrom1, clip1, chrom2, clip2 ORDER BY coord1, coord2, rid) < 3500 THEN 0 ELSE 1 END AS k FROM links),\nw1 AS (SELECT *, sum(k) OVER (PARTITION BY chrom1, clip1, chrom2, clip2 ORDER BY coord1, coord2, rid ROWS UNBOUNDED PRECEDING) AS g FROM w0)", sql="SELECT chrom1, CASE WHEN clip1 = 'R' THEN max(coord1) ELSE min(coord1) END AS coord1, clip1, chrom2, CASE WHEN clip2 = 'R' THEN max(coord2) ELSE min(coord2) END AS coord2, clip2, count(*) AS support FROM w1 GROUP BY chrom1, clip1, chrom2, clip2, g HAVING count(*) >= 2")
def _(links):
    return breakpoints.cluster_links(links, gap=3500)


@query("endpoint_collapse", "sites", also="w0 AS (SELECT *, CASE WHEN coord - lag(coord) OVER (PARTITION BY chrom, clip ORDER BY coord) <= 1000 THEN 0 ELSE 1 END AS k FROM sites),\nw1 AS (SELECT *, sum(k) OVER (PARTITION BY chrom, clip ORDER BY coord) AS g FROM w0)", sql="SELECT chrom, clip, arg_max(coord, (n, -coord)) AS coord, max(n) AS support FROM w1 GROUP BY chrom, clip, g")
def _(sites):
    return breakpoints.collapse_ends(sites.withColumnRenamed("n", "support"), reach=1000)


SNAP = EDGES + ",\ned AS (SELECT chrom1, coord1 + 700 AS coord1, clip1, chrom2, coord2 - 300 AS coord2, clip2, n AS support FROM pairs),\nbth AS (SELECT chrom1, coord1, clip1, chrom2, coord2, clip2, n FROM pairs UNION SELECT chrom2, coord2, clip2, chrom1, coord1, clip1, n FROM pairs),\nm AS (SELECT e.*, p.coord1 AS t1, p.coord2 AS t2, p.n FROM ed e JOIN bth p ON p.chrom1 = e.chrom1 AND p.clip1 = e.clip1 AND p.chrom2 = e.chrom2 AND p.clip2 = e.clip2 AND abs(p.coord1 - e.coord1) <= 2000 AND abs(p.coord2 - e.coord2) <= 2000),\nt AS (SELECT *, max(n) OVER (PARTITION BY chrom1, coord1, clip1, chrom2, coord2, clip2) AS top FROM m),\nbst AS (SELECT chrom1, coord1, clip1, chrom2, coord2, clip2, min(t1) AS t1, min(t2) AS t2 FROM t WHERE n = top GROUP BY ALL HAVING count(*) = 1)"


@query("two_ended_snap", "links", also=SNAP, sql="SELECT chrom1, coord1, clip1, chrom2, coord2, clip2, support, coalesce(t1, coord1) AS to1, coalesce(t2, coord2) AS to2, t1 IS NOT NULL AS snapped FROM ed LEFT JOIN bst USING (chrom1, coord1, clip1, chrom2, coord2, clip2)")
def _(links):
    pairs = stage(breakpoints.count_links(links).drop("rids"), "pairs")
    edges = pairs.select("chrom1", (F.col("coord1") + 700).alias("coord1"), "clip1", "chrom2", (F.col("coord2") - 300).alias("coord2"), "clip2", F.col("n").alias("support"))
    return breakpoints.snap_two_ended(edges, pairs, reach=2000)


JUNCTIONS = "jx AS (SELECT *, count(*) OVER (PARTITION BY ring) AS k, first_value(row(chrom, CASE WHEN strand = '+' THEN start ELSE stop END, CASE WHEN strand = '+' THEN 'L' ELSE 'R' END)) OVER (PARTITION BY ring ORDER BY idx) AS f, lead(row(chrom, CASE WHEN strand = '+' THEN start ELSE stop END, CASE WHEN strand = '+' THEN 'L' ELSE 'R' END)) OVER (PARTITION BY ring ORDER BY idx) AS l FROM rings),\njunctions AS (SELECT ring, idx, chrom AS chrom1, CASE WHEN strand = '+' THEN stop ELSE start END AS coord1, CASE WHEN strand = '+' THEN 'R' ELSE 'L' END AS clip1, coalesce(l, f)[1] AS chrom2, coalesce(l, f)[2] AS coord2, coalesce(l, f)[3] AS clip2, k = 1 AS single FROM jx)"


@query("junction_inference", "rings", also=JUNCTIONS, sql="SELECT ring, idx, chrom1, coord1, clip1, chrom2, coord2, clip2, single FROM junctions")
def _(rings):
    return cells.ring_junctions(rings).withColumn("idx", F.col("idx").cast("long"))


@query("known_junction_match", "rings", "links", also=JUNCTIONS + ",\n" + EDGES + ",\nbth AS (SELECT chrom1, coord1, clip1, chrom2, coord2, clip2, n FROM pairs UNION SELECT chrom2, coord2, clip2, chrom1, coord1, clip1, n FROM pairs)", sql="SELECT DISTINCT j.ring, j.idx, j.chrom1, j.coord1, j.clip1, j.chrom2, j.coord2, j.clip2, p.coord1 AS p_coord1, p.coord2 AS p_coord2, p.n AS p_n FROM junctions j JOIN bth p ON p.chrom1 = j.chrom1 AND p.clip1 = j.clip1 AND p.chrom2 = j.chrom2 AND p.clip2 = j.clip2 AND abs(p.coord1 - j.coord1) <= 400000 AND abs(p.coord2 - j.coord2) <= 400000")
def _(rings, links):
    junctions = cells.ring_junctions(rings).withColumn("idx", F.col("idx").cast("long")).drop("single")
    return breakpoints.match_known(junctions, breakpoints.count_links(links).drop("rids"), window=400_000)


@query("evidence_merge", "links", also="e AS (SELECT chrom1 || '-' || chrom2 AS junction, CASE WHEN clip1 = 'L' THEN 0 ELSE 1 END AS source, rid % 7 AS n, CASE WHEN rid % 5 = 0 THEN NULL ELSE rid END AS rid, CASE WHEN bc % 4 = 0 THEN NULL ELSE bc END AS bc FROM links),\nr AS (SELECT junction, rid, arg_min(coalesce(bc, -1), (bc IS NULL, source, coalesce(bc, -1))) AS bc FROM e WHERE rid IS NOT NULL GROUP BY ALL),\ng AS (SELECT junction, count(*) AS reads, count(DISTINCT nullif(bc, -1)) AS barcodes FROM r GROUP BY ALL),\nb AS (SELECT junction, arg_max(source, (-source, n)) AS source, arg_max(n, (-source, n)) AS top, sum(n)::BIGINT AS total FROM e GROUP BY ALL)", sql="SELECT junction, source, top, coalesce(reads, total) AS n, coalesce(barcodes, 0) AS barcodes FROM b LEFT JOIN g USING (junction)")
def _(links):
    rows = links.select(F.concat_ws("-", "chrom1", "chrom2").alias("junction"), F.when(F.col("clip1") == "L", 0).otherwise(1).alias("source"), (F.col("rid") % 7).alias("n"), F.when(F.col("rid") % 5 != 0, F.col("rid")).alias("rid"), F.when(F.col("bc") % 4 != 0, F.col("bc")).alias("bc"))
    return breakpoints.merge_evidence(rows)


@query("pair_filter_basic", "links", "segments", also=EDGES + ",\n" + ISLANDS.format(gap=200000, t="segments"), sql="SELECT chrom1, coord1, clip1, chrom2, coord2, clip2, n FROM pairs p WHERE n >= 1 AND (chrom1 <> chrom2 OR abs(coord1 - coord2) >= 500) AND EXISTS (SELECT 1 FROM merged m WHERE m.chrom = p.chrom1 AND coord1 < m.stop + 10000 AND coord1 >= m.start - 10000) AND EXISTS (SELECT 1 FROM merged m WHERE m.chrom = p.chrom2 AND coord2 < m.stop + 10000 AND coord2 >= m.start - 10000)")
def _(links, segments):
    return breakpoints.filter_pairs(breakpoints.count_links(links).drop("rids"), 1, 500, segments)


# --- text ------------------------------------------------------------------


@query("revcomp", "strings", sql="SELECT doc_id, piece, reverse(translate(regexp_replace(a, '[^ACGTNacgtn]', 'N', 'g'), 'ACGTacgt', 'TGCAtgca')) AS rc FROM strings")
def _(df):
    return df.select("doc_id", "piece", text.reverse_complement(F.col("a")).alias("rc"))


@query("norm_levenshtein", "strings", sql="SELECT doc_id, piece, round(levenshtein(translate(a, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), translate(b, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')) * 1.0 / greatest(length(a), length(b), 1), 6) AS d FROM (SELECT doc_id, piece, regexp_replace(a, '[^ -~]', '?', 'g') AS a, regexp_replace(b, '[^ -~]', '?', 'g') AS b FROM strings)")
def _(df):
    plain = lambda c: F.regexp_replace(c, "[^ -~]", "?")
    return df.select("doc_id", "piece", F.round(text.normalised_distance(plain("a"), plain("b")), 6).alias("d"))


@query("first_upper_run", "documents", sql="SELECT doc_id, coalesce(regexp_extract(text, '([A-Z]+)', 1), '') AS run FROM documents")
def _(df):
    return df.select("doc_id", F.coalesce(text.first_upper_run(F.col("text")), F.lit("")).alias("run"))


CIGAR = "cast(pk % 30 as varchar) || 'S' || cast(sk % 90 + 1 as varchar) || 'M' || cast(line as varchar) || 'D' || cast(mapq as varchar) || 'I' || cast(rid % 40 as varchar) || 'H'"


@query("cigar_ref_len", "reads", sql="SELECT rid, line, pk, sk, cast(sk % 90 + 1 + line as bigint) AS length, CASE WHEN pk % 30 = 0 AND rid % 40 = 0 THEN NULL WHEN pk % 30 >= rid % 40 THEN 'L' ELSE 'R' END AS side FROM reads")
def _(df):
    cigar = F.expr(CIGAR.replace("varchar", "string"))
    return df.select("rid", "line", "pk", "sk", text.cigar_length(cigar).alias("length"), text.cigar_clip(cigar).alias("side"))


@query("sa_parse", "reads", sql="SELECT rid, line, pk, sk, chrom, start AS pos, mapq, nm FROM reads")
def _(df):
    tag = F.concat_ws(",", "chrom", F.col("start") + 1, F.lit("+"), F.lit("100M"), "mapq", "nm")
    rows = df.select("rid", "line", "pk", "sk", F.explode(text.parse_sa(F.concat(tag, F.lit(";chr1,5;")))).alias("x"))
    return rows.select("rid", "line", "pk", "sk", "x.chrom", "x.pos", "x.mapq", "x.nm")


@query("junction_ids", "links", sql="SELECT rid, coord1, coord2, least(a, b) || '|' || greatest(a, b) AS id FROM (SELECT *, chrom1 || ':' || coord1 || ':' || clip1 AS a, chrom2 || ':' || coord2 || ':' || clip2 AS b FROM links)")
def _(df):
    return df.select("rid", "coord1", "coord2", text.junction_id(*[F.col(c).cast("string") for c in ("chrom1", "coord1", "clip1", "chrom2", "coord2", "clip2")]).alias("id"))


@query("consensus_bases", "strings", also="ch AS (SELECT doc_id % 50 AS g, p AS pos, substr(a, p::BIGINT, 1) AS base FROM strings, range(1, 61) t(p) WHERE p <= length(a) AND substr(a, p::BIGINT, 1) BETWEEN 'a' AND 'z'),\nc AS (SELECT g, pos, base, count(*) AS n FROM ch GROUP BY ALL),\nb AS (SELECT g, pos, arg_max(base, (n, -ascii(base))) AS base FROM c GROUP BY ALL)", sql="SELECT g, string_agg(base, '' ORDER BY pos) AS consensus FROM b GROUP BY g")
def _(df):
    rows = df.select((F.col("doc_id") % 50).alias("g"), F.posexplode(F.split("a", "")).alias("pos", "base")).where("base between 'a' and 'z'")
    return text.consensus(rows, by=["g"])


@query("short_repeat_filter", "strings")
def _(df):
    return df.select("doc_id", "piece", F.round(text.repeat_share(F.col("a")), 6).alias("share"))


@query("semi_global_distance", "strings")
def _(df):
    return df.select("doc_id", "piece", F.round(text.semi_global_distance("b", "a"), 6).alias("d"))


@query("common_substring", "strings")
def _(df):
    return df.select("doc_id", "piece", text.common_substring("a", "b").alias("x")).select("doc_id", "piece", "x.*")


@query("fuzzy_clip_match", "strings")
def _(df):
    clips = df.select("doc_id", "piece", "a", "b", F.explode(F.array(*map(F.lit, range(3)))).alias("clip"))
    return clips.select("doc_id", "piece", "clip", text.fuzzy_find(F.substring(F.col("b"), 20 * F.col("clip") + 1, F.lit(20)), "a").alias("at"))


# --- segments, graph and score ---------------------------------------------


@query("segment_pairing_knn", "sites", also="r AS (SELECT * FROM sites WHERE clip = 'R'), l AS (SELECT DISTINCT chrom, coord FROM sites WHERE clip = 'L'),\nm AS (SELECT l.chrom, l.coord AS start, r.coord AS stop, r.n, row_number() OVER (PARTITION BY l.chrom, l.coord ORDER BY r.coord) AS k FROM l JOIN r ON r.chrom = l.chrom AND r.coord > l.coord)", sql="SELECT chrom, start, arg_max(stop, (n, -stop)) AS stop, max(n) AS n FROM m WHERE k <= 5 AND stop - start BETWEEN 100 AND 50000000 GROUP BY ALL")
def _(sites):
    return segmentation.pair_ends(sites)


@query("interior_cn_fraction", "segments", "reads", also=BINS, sql="SELECT seg, round(avg(b.cn), 6) AS mean_cn, count(*) AS bins, round(avg(CASE WHEN b.cn >= 4.5 THEN 1.0 ELSE 0.0 END), 6) AS high_share FROM segments s JOIN bins b ON b.chrom = s.chrom AND b.coord >= s.start AND b.coord < s.stop GROUP BY seg")
def _(segments, df):
    return segmentation.interior_cn(segments, bins_of(df)).withColumns(r6("mean_cn", "high_share"))


@query("add_cn", "segments", "genes", "reads", also=BINS + ",\nt AS (SELECT s.seg, round_even(max(g.cn), 0) AS top FROM segments s JOIN (SELECT chrom, start, stop, (gid % 11) / 2.0 AS cn FROM genes WHERE kind = 'LARGE') g ON g.chrom = s.chrom AND g.start < s.stop AND s.start < g.stop GROUP BY s.seg),\nm AS (SELECT seg, avg(b.cn) AS mean FROM segments s JOIN bins b ON b.chrom = s.chrom AND b.coord >= s.start - 10000 AND b.coord < s.stop + 10000 GROUP BY seg)", sql="SELECT s.seg, round(coalesce(top, mean), 6) AS cn FROM segments s LEFT JOIN t USING (seg) LEFT JOIN m USING (seg)")
def _(segments, genes, df):
    calls = genes.where("kind = 'LARGE'").select("chrom", "start", "stop", ((F.col("gid") % 11) / 2.0).alias("cn"))
    return segmentation.add_cn(segments, calls, bins_of(df)).select("seg", F.round("cn", 6).alias("cn"))


@query("snap_to_boundary", "sites", "segments", also="b AS (SELECT DISTINCT chrom, start AS at FROM segments),\nd AS (SELECT s.chrom, s.coord, s.clip, b.at, abs(s.coord - b.at) AS far FROM sites s JOIN b ON b.chrom = s.chrom AND abs(s.coord - b.at) <= 30000),\nt AS (SELECT *, min(far) OVER (PARTITION BY chrom, coord, clip) AS nearest FROM d),\no AS (SELECT chrom, coord, clip, min(t.at) AS \"to\" FROM t WHERE far = nearest GROUP BY ALL HAVING count(*) = 1)", sql="SELECT s.chrom, s.coord, s.clip, o.\"to\" FROM sites s LEFT JOIN o USING (chrom, coord, clip)")
def _(sites, segments):
    points = sites.select(F.struct("chrom", "coord", "clip").alias("id"), "chrom", "coord", "clip")
    return segmentation.snap_to_boundary(points, segments.select("chrom", F.col("start").alias("at")).distinct()).select("chrom", "coord", "clip", "to")


@query("graph_edges", "segments", "links", also=EDGES + ",\nv AS (SELECT row_number() OVER (ORDER BY chrom, coord, clip) AS id, chrom, coord, clip FROM (SELECT chrom1 AS chrom, coord1 AS coord, clip1 AS clip FROM pairs UNION SELECT chrom2, coord2, clip2 FROM pairs UNION SELECT chrom, start, 'L' FROM segments UNION SELECT chrom, stop, 'R' FROM segments)),\ne AS (SELECT least(a.id, b.id) AS a, greatest(a.id, b.id) AS b, 'outer' AS kind, n::DOUBLE AS weight FROM pairs p JOIN v a ON a.chrom = chrom1 AND a.coord = coord1 AND a.clip = clip1 JOIN v b ON b.chrom = chrom2 AND b.coord = coord2 AND b.clip = clip2 UNION ALL SELECT least(a.id, b.id), greatest(a.id, b.id), 'inner', s.cn FROM segments s JOIN v a ON a.chrom = s.chrom AND a.coord = s.start AND a.clip = 'L' JOIN v b ON b.chrom = s.chrom AND b.coord = s.stop AND b.clip = 'R')", sql="SELECT va.chrom || ':' || va.coord || va.clip AS a, vb.chrom || ':' || vb.coord || vb.clip AS b, kind, max(weight) AS weight FROM e JOIN v va ON va.id = a JOIN v vb ON vb.id = b GROUP BY ALL")
def _(segments, links):
    pairs = breakpoints.count_links(links).drop("rids")
    v = pairs.select(F.col("chrom1").alias("chrom"), F.col("coord1").alias("coord"), F.col("clip1").alias("clip")).union(pairs.select("chrom2", "coord2", "clip2")).union(segments.select("chrom", "start", F.lit("L"))).union(segments.select("chrom", "stop", F.lit("R"))).distinct()
    # a vertex is its own id, which orders as its number would
    edges = graph.graph_edges(v.withColumn("id", F.struct("chrom", "coord", "clip")), pairs, segments)
    name = lambda k: F.concat(F.col(f"{k}.chrom"), F.lit(":"), F.col(f"{k}.coord").cast("string"), F.col(f"{k}.clip")).alias(k)
    return edges.select(name("a"), name("b"), "kind", "weight")


def ring_graph(rings: DataFrame):
    """The rings' own graph: two vertices a segment, and the junctions between segments. Made once, as it is read several times."""
    rings = stage(rings.select("ring", "idx", "chrom", "start", "stop", "cn", "splits"), "rings")
    v = rings.select("ring", "idx", F.explode(F.array(F.struct(F.lit("L").alias("clip"), F.col("start").alias("coord")), F.struct(F.lit("R").alias("clip"), F.col("stop").alias("coord")))).alias("x"), "chrom", "cn", "splits")
    v = v.select(F.xxhash64("ring", "idx", "x.clip").alias("id"), "ring", "idx", "chrom", "x.coord", "x.clip", "cn", "splits")
    end = lambda idx, clip: F.xxhash64("ring", idx, clip)
    w = Window.partitionBy("ring").orderBy("idx")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    j = rings.select("ring", "idx", "splits", F.coalesce(F.lead("idx").over(w), F.first("idx").over(whole)).alias("nxt"))
    outer = j.select(end("idx", F.lit("R")).alias("x"), end("nxt", F.lit("L")).alias("y"), F.lit("outer").alias("kind"), F.col("splits").cast("double").alias("weight"))
    inner = rings.select(end("idx", F.lit("L")).alias("x"), end("idx", F.lit("R")).alias("y"), F.lit("inner").alias("kind"), F.col("cn").alias("weight"))
    return v, stage(outer.unionByName(inner).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "kind", "weight"), "edges")


@query("ring_paths", "rings", sql="SELECT chrom, count(*) AS rings, sum(k)::BIGINT AS nodes FROM (SELECT ring, chrom, 2 * count(*) AS k FROM rings GROUP BY ALL) GROUP BY chrom")
def _(rings):
    v, edges = ring_graph(rings)
    paths = graph.find_paths(edges, graph.label_components(edges)).where("kind = 'ring'")
    return paths.select(F.element_at("path", 1).alias("id"), F.size("path").alias("k")).join(v.select("id", "chrom"), "id").groupBy("chrom").agg(F.count("*").alias("rings"), F.sum("k").cast("long").alias("nodes"))


@query("circle_table", "rings", sql="SELECT chrom, start, stop, round(cn, 6) AS cn, count(*) AS n FROM rings GROUP BY ALL")
def _(rings):
    v, edges = ring_graph(rings)
    paths = graph.find_paths(edges, graph.label_components(edges)).where("kind = 'ring'")
    return graph.path_segments(paths, v, edges).groupBy("chrom", "start", "stop", F.round("cn", 6).alias("cn")).agg(F.count("*").alias("n"))


CONTRAST = BINS + """,
r AS (SELECT *, lag(chrom) OVER w AS pc, lag(stop) OVER w AS ps, lead(chrom) OVER w AS nc, lead(start) OVER w AS ns FROM rings WINDOW w AS (PARTITION BY ring ORDER BY idx)),
f AS (SELECT *, CASE WHEN pc IS NULL OR pc <> chrom THEN start - 100000 WHEN start - ps <= 10000 THEN ps - 10000 ELSE ps END AS la, CASE WHEN pc IS NULL OR pc <> chrom THEN start - 10000 WHEN start - ps <= 10000 THEN start + 10000 ELSE start END AS lb,
  CASE WHEN nc IS NULL OR nc <> chrom THEN stop + 10000 WHEN ns - stop <= 10000 THEN stop - 10000 ELSE stop END AS ra, CASE WHEN nc IS NULL OR nc <> chrom THEN stop + 100000 WHEN ns - stop <= 10000 THEN ns + 10000 ELSE ns END AS rb FROM r),
o AS (SELECT ring, idx, avg(b.cn) AS m, CASE WHEN count(*) = 1 THEN -1 ELSE stddev_samp(b.cn) END AS d FROM f JOIN bins b ON b.chrom = f.chrom AND b.coord >= f.start AND b.coord <= f.stop GROUP BY ALL),
fl AS (SELECT ring, idx, avg(b.cn) AS m FROM f JOIN bins b ON b.chrom = f.chrom AND b.coord > least(la, lb) AND b.coord < greatest(la, lb) GROUP BY ALL),
fr AS (SELECT ring, idx, avg(b.cn) AS m FROM f JOIN bins b ON b.chrom = f.chrom AND b.coord > least(ra, rb) AND b.coord < greatest(ra, rb) GROUP BY ALL),
g AS (SELECT f.*, CASE WHEN stop - start <= 10000 THEN cn ELSE o.m END AS sm, CASE WHEN stop - start <= 10000 THEN -1 ELSE o.d END AS sd, fl.m AS lm, fr.m AS rm FROM f LEFT JOIN o USING (ring, idx) LEFT JOIN fl USING (ring, idx) LEFT JOIN fr USING (ring, idx)),
c AS (SELECT ring, idx, start, stop, splits, cn, abs(log2(CASE WHEN sm < 0 THEN 2 WHEN sm = 0 THEN 0.01 ELSE sm END / CASE WHEN lm = 0 THEN 0.01 ELSE lm END)) AS x, abs(log2(CASE WHEN sm < 0 THEN 2 WHEN sm = 0 THEN 0.01 ELSE sm END / CASE WHEN rm = 0 THEN 0.01 ELSE rm END)) AS y,
  CASE WHEN sm < 0 THEN 2 WHEN sm = 0 THEN 0.01 ELSE sm END / CASE WHEN sd = 0 THEN 0.01 ELSE sd END AS iv FROM g),
st AS (SELECT *, ln(CASE WHEN iv < 0 THEN abs(iv) / 100 ELSE iv END + 1) AS z FROM c)"""


@query("segment_contrast", "rings", "reads", also=CONTRAST, sql="SELECT ring, idx, round(x, 6) AS fc_left, round(y, 6) AS fc_right, round(z, 6) AS steady FROM st")
def _(rings, df):
    return graph.segment_contrast(rings, bins_of(df)).select("ring", F.col("idx").cast("long").alias("idx"), *[F.round(n, 6).alias(n) for n in ("fc_left", "fc_right", "steady")])


SCORE = CONTRAST + """,
a AS (SELECT ring, count(*) AS segments, sum(stop - start)::BIGINT AS length, sum(splits)::BIGINT AS split_sum, avg(splits) AS split_mean, coalesce(stddev_samp(splits), -1) AS ssd, avg(cn) AS cn_mean, coalesce(stddev_samp(cn), -1) AS csd, coalesce(sum(x), 0) / count(*) AS l, coalesce(sum(y), 0) / count(*) AS r, coalesce(avg(z), -1) AS steady FROM st GROUP BY ring),
b AS (SELECT *, split_mean / CASE WHEN ssd = 0 THEN 0.2 ELSE ssd END AS iv, CASE WHEN csd = -1 THEN 1 ELSE csd END AS cn_sd FROM a),
d AS (SELECT *, ln(CASE WHEN iv < 0 THEN abs(iv) / 100 ELSE iv END + 1) AS split_steady, greatest(l, r) AS top, CASE WHEN l + r > 0 THEN 2 * l * r / (l + r) ELSE 0 END AS h FROM b)"""


@query("circle_stats_score", "rings", "reads", also=SCORE, sql="SELECT ring, segments, length, split_sum, round(split_mean, 5) AS split_mean, round(cn_mean, 5) AS cn_mean, round(cn_sd, 5) AS cn_sd, round(l, 5) AS \"left\", round(r, 5) AS \"right\", round(steady, 5) AS steady, round(split_steady, 5) AS split_steady, round((l + r + steady + split_steady - CASE WHEN top > 0 THEN abs(l - r) * (1 - h / top) * top ELSE 0 END) * (1 - least(CASE WHEN steady < 0.5 THEN 1 - steady ELSE 0 END + 0.6 / (1 + exp(-0.02 * (cn_sd - 200))) / (1 + exp(-0.1 * (cn_sd - 50))), 0.6)), 5) AS score FROM d")
def _(rings, df):
    out = graph.score_rings(graph.segment_contrast(rings, bins_of(df)))
    return out.withColumns({n: F.round(n, 5) for n, t in out.dtypes if t == "double"})


@query("circle_dedup", "rings", "reads")
def _(rings, df):
    scores = graph.score_rings(graph.segment_contrast(rings, bins_of(df)))
    return graph.pick_distinct(scores, rings, 0.95).withColumns(r6("score"))


@query("cbs_segments", "reads")
def _(df):
    x = bins_of(df).withColumn("x", F.log2(F.col("cn") / 2))
    return segmentation.cbs_segments(x).withColumns(r6("n", "x"))


@query("glm_norm", "reads", "genes")
def _(df, genes):
    bias = bins.mean_bias(genes.select("chrom", "start", ((F.col("gid") % 100) / 100.0).alias("gc"), ((F.col("gid") % 37) / 37.0).alias("mappability")))
    x = bins.bin_counts(reads.passing(df)).join(bias, ["chrom", "coord"])
    return copynumber.normalise(x, ["gc", "mappability"]).select("chrom", "coord", "n", F.round("n_norm", 4).alias("n_norm"), F.round("cn", 4).alias("cn"))


@query("kde_mode", "reads", also=BINS + ",\ns AS (SELECT stddev_samp(n) * pow(count(*), -0.2) AS h, quantile_cont(n::DOUBLE, 0.99) AS top FROM bins),\ng AS (SELECT i * top / 499 AS g, h FROM s, range(0, 500) t(i)),\nc AS (SELECT n, count(*) AS k FROM bins GROUP BY n),\nd AS (SELECT g, sum(k * exp(-0.5 * pow((g - n) / h, 2))) AS d FROM g, c GROUP BY g)", sql="SELECT round(arg_max(g, (d, -g)), 4) AS mode FROM d")
def _(df):
    return copynumber.mode(bins.bin_counts(reads.passing(df)), "n").select(F.round("mode", 4).alias("mode"))


@query("threshold_estimate", "links")
def _(links):
    level = segmentation.support_threshold(links.groupBy("chrom1", "chrom2", "bc").agg(F.count("*").alias("n")))
    return links.select(F.lit(level).cast("double").alias("threshold")).limit(1).withColumns(r6("threshold"))


# --- cells and targets -----------------------------------------------------

JCS = JUNCTIONS + ",\n" + EDGES + """,
bth AS (SELECT chrom1, coord1, clip1, chrom2, coord2, clip2, n FROM pairs UNION SELECT chrom2, coord2, clip2, chrom1, coord1, clip1, n FROM pairs),
m AS (SELECT j.ring AS circle, j.idx AS junction, max(p.n) AS n FROM junctions j JOIN bth p ON p.chrom1 = j.chrom1 AND p.clip1 = j.clip1 AND p.chrom2 = j.chrom2 AND p.clip2 = j.clip2 AND abs(p.coord1 - j.coord1) <= 400000 AND abs(p.coord2 - j.coord2) <= 400000 GROUP BY ALL),
j AS (SELECT ring AS circle, idx AS junction, coalesce(n, 0) AS n FROM junctions LEFT JOIN m ON m.circle = ring AND m.junction = idx)"""


@query("jcs", "rings", "links", also=JCS, sql="SELECT circle, count(DISTINCT junction) AS total, count(*) FILTER (n >= 1) AS validated, coalesce(sum(n) FILTER (n >= 1), 0)::BIGINT AS support, round(count(*) FILTER (n >= 1) * 1.0 / count(DISTINCT junction), 6) AS jcs, count(*) FILTER (n >= 1) * 1.0 / count(DISTINCT junction) >= 0.5 AS detected FROM j GROUP BY circle")
def _(rings, links):
    junctions = stage(cells.ring_junctions(rings).drop("single"), "junctions")
    matched = breakpoints.best_known(junctions, breakpoints.count_links(links).drop("rids"), window=400_000)
    one = lambda df, *more: df.select(F.col("ring").alias("circle"), F.col("idx").alias("junction"), *more)
    out = cells.concordance(one(junctions), one(matched, "n"), least=1)
    return out.select("circle", "total", F.col("validated").cast("long").alias("validated"), F.col("support").cast("long").alias("support"), F.round("jcs", 6).alias("jcs"), "detected")


@query("segment_cn_summary", "rings", sql="SELECT ring, count(*) AS segments, round(sum(cn), 10) AS cn_sum, round(avg(cn), 10) AS cn_mean, round(median(cn), 10) AS cn_median, round(coalesce(stddev_samp(cn), 0), 10) AS cn_sd, round(min(cn), 10) AS cn_min, round(max(cn), 10) AS cn_max FROM rings GROUP BY ring")
def _(rings):
    out = cells.segment_summary(rings)
    return out.withColumns({n: F.round(n, 10) for n in ("cn_sum", "cn_mean", "cn_median", "cn_sd", "cn_min", "cn_max")})


@query("weighted_cn", "segments", "reads", also=BINS, sql="SELECT seg, round(sum((least(s.stop, b.coord + 10000) - greatest(s.start, b.coord)) * b.cn) / sum(least(s.stop, b.coord + 10000) - greatest(s.start, b.coord)), 6) AS cn, count(*) AS bins FROM segments s JOIN bins b ON b.chrom = s.chrom AND b.coord < s.stop AND s.start < b.coord + 10000 GROUP BY seg")
def _(segments, df):
    return cells.weighted_cn(segments, bins_of(df)).withColumns(r6("cn"))


@query("cell_support_matrix", "reads", sql="SELECT bc, " + ", ".join(f"count(*) FILTER (chrom = 'chr{k}') AS chr{k}" for k in range(1, 25)) + " FROM reads GROUP BY bc")
def _(df):
    rows = df.select("bc", "chrom", F.lit(1).cast("long").alias("n"))
    return cells.support_matrix(rows, "bc", "chrom", "n", [f"chr{k}" for k in range(1, 25)])


@query("all_matrix_ratio", "reads", also="a AS (SELECT bc AS cell, chrom AS junction, count(DISTINCT rid) AS a FROM reads WHERE clip_l GROUP BY ALL),\nb AS (SELECT bc AS cell, chrom AS junction, count(DISTINCT rid) AS b FROM reads WHERE NOT clip_l AND NOT clip_r GROUP BY ALL)", sql="SELECT cell, junction, coalesce(a, 0) AS a, coalesce(b, 0) AS b, round(coalesce(a, 0) * 1.0 / (coalesce(a, 0) + coalesce(b, 0) + 1), 6) AS ratio FROM a FULL JOIN b USING (cell, junction)")
def _(df):
    rows = df.select(F.col("bc").alias("cell"), F.col("chrom").alias("junction"), "rid", "clip_l", "clip_r")
    return cells.allele_ratio(rows.where("clip_l"), rows.where("not clip_l and not clip_r")).withColumns(r6("ratio"))


CELLS = "f AS (SELECT cell, 'ring' || (cell % 5) AS ring, count(*) * 1.0 AS rate, count(*) FILTER (kind = 'purchase') AS direct, count(*) FILTER (kind = 'click') / 40.0 AS weak, count(DISTINCT chrom) / 8.0 AS enrichment FROM frags GROUP BY cell)"


def cell_features(frags):
    return frags.groupBy("cell").agg((F.count("*") * 1.0).cast("double").alias("rate"), F.count(F.when(F.col("kind") == "purchase", 1)).alias("direct"), (F.count(F.when(F.col("kind") == "click", 1)) / 40.0).alias("weak"), (F.count_distinct("chrom") / 8.0).alias("enrichment")).withColumn("ring", F.concat(F.lit("ring"), (F.col("cell") % 5).cast("string")))


@query("ring_q1", "frags", also=CELLS, sql="SELECT cell, ring, round(rate, 6) AS rate, direct, round(q1, 6) AS q1 FROM f LEFT JOIN (SELECT ring, quantile_cont(rate::DOUBLE, 0.25) AS q1 FROM f WHERE direct >= 1 GROUP BY ring) USING (ring)")
def _(frags):
    return cells.ring_quartile(cell_features(frags)).select("cell", "ring", F.round("rate", 6).alias("rate"), "direct", F.round("q1", 6).alias("q1"))


PROFILE = CELLS + """,
k AS (SELECT cell, kind, sum(n)::DOUBLE AS n FROM frags GROUP BY ALL),
w AS (SELECT kind, sum(n) AS n FROM k GROUP BY kind),
c AS (SELECT cell, sum(k.n * w.n) / (sqrt(sum(k.n * k.n)) * (SELECT sqrt(sum(n * n)) FROM w)) AS cosine, count(*) * 1.0 / (SELECT count(*) FROM w) AS covered FROM k JOIN w USING (kind) GROUP BY cell),
q AS (SELECT ring, quantile_cont(rate::DOUBLE, 0.25) AS q1 FROM f WHERE direct >= 3 GROUP BY ring)"""


@query("cell_rules", "frags", also=PROFILE, sql="SELECT cell, CASE WHEN direct >= 3 THEN 'high' WHEN weak >= 0.3 THEN 'probable' WHEN rate >= q1 AND enrichment >= 2 AND cosine >= 0.96 AND covered >= 1 THEN 'probable' ELSE 'none' END AS call FROM f JOIN c USING (cell) LEFT JOIN q USING (ring)")
def _(frags):
    f = cell_features(frags).withColumn("direct", F.when(F.col("direct") >= 3, F.col("direct")).otherwise(0))
    counts = frags.groupBy("cell", F.col("kind").alias("seg")).agg(F.sum("n").alias("n"))
    anchor = counts.groupBy("seg").agg(F.sum("n").alias("n"))
    kinds = anchor.agg(F.count("*").alias("_all"))
    covered = counts.groupBy("cell").agg(F.count("*").alias("_k")).crossJoin(F.broadcast(kinds)).select("cell", (F.col("_k") / F.col("_all")).alias("covered"))
    f = f.join(cells.profile_cosine(counts, anchor), "cell").join(covered, "cell")
    return cells.assign(cells.ring_quartile(f)).select("cell", "call")


@query("weak_evidence_max", "frags", also="e AS (SELECT cell, chrom AS junction, start % 997 AS rid, CASE kind WHEN 'purchase' THEN 1.0 WHEN 'click' THEN 0.7 WHEN 'view' THEN 0.3 ELSE 0.0 END AS w FROM frags),\nb AS (SELECT cell, junction, rid, max(w) AS w FROM e GROUP BY ALL)", sql="SELECT cell, junction, round(sum(w), 6)::DOUBLE AS weak, count(*) AS reads FROM b GROUP BY ALL")
def _(frags):
    kind = F.when(F.col("kind") == "purchase", "split").when(F.col("kind") == "click", "discordant").when(F.col("kind") == "view", "clip").otherwise("other")
    rows = frags.select("cell", F.col("chrom").alias("junction"), (F.col("start") % 997).alias("rid"), kind.alias("kind"))
    return cells.weakest_path(rows).withColumns(r6("weak"))


@query("flank_intervals", "rings", also="r AS (SELECT * FROM rings),\nf AS (SELECT ring, idx, 'left' AS side, chrom, greatest(0, start - (stop - start)) AS start, start AS stop FROM r UNION ALL SELECT ring, idx, 'right', chrom, stop, stop + (stop - start) FROM r)", sql="SELECT ring, idx, side, chrom, start, stop FROM f WHERE start < stop AND NOT EXISTS (SELECT 1 FROM r WHERE r.chrom = f.chrom AND r.start < f.stop AND f.start < r.stop)")
def _(rings):
    return cells.flanks(rings).withColumn("idx", F.col("idx").cast("long"))


@query("fragment_counts", "frags", "segments", sql="SELECT cell, seg, sum(n)::BIGINT AS n FROM frags f JOIN segments s ON s.chrom = f.chrom AND f.start < s.stop AND s.start < f.stop AND s.start < s.stop GROUP BY ALL")
def _(frags, segments):
    return cells.fragment_counts(frags, segments)


@query("profile_cosine", "frags", "segments", also="c AS (SELECT cell, seg, sum(n)::DOUBLE AS n FROM frags f JOIN segments s ON s.chrom = f.chrom AND f.start < s.stop AND s.start < f.stop GROUP BY ALL),\na AS (SELECT seg, sum(n) AS n FROM c GROUP BY seg)", sql="SELECT cell, round(sum(c.n * a.n) / (sqrt(sum(c.n * c.n)) * (SELECT sqrt(sum(n * n)) FROM a)), 6) AS cosine FROM c JOIN a USING (seg) GROUP BY cell")
def _(frags, segments):
    counts, _ = cells.class_counts(frags, segments)
    return cells.profile_cosine(counts, counts.groupBy("seg").agg(F.sum("n").alias("n"))).withColumns(r6("cosine"))


@query("ecdna_ratio", "frags", also="c AS (SELECT cell, count(*) FILTER (kind = 'click') AS s, count(*) FILTER (kind <> 'click') AS n FROM frags GROUP BY cell),\nr AS (SELECT *, least(1.0, greatest(0.0, s / greatest(s + n, 1))) AS ratio FROM c)", sql="SELECT cell, s, n, round(ratio, 6) AS ratio, cast(round_even(99 * ratio, 0) AS bigint) + 1 AS colour FROM r")
def _(frags):
    c = frags.groupBy("cell").agg(F.count(F.when(F.col("kind") == "click", 1)).alias("s"), F.count(F.when(F.col("kind") != "click", 1)).alias("n"))
    return cells.ratio_index(c).withColumns(r6("ratio"))


# --- embedding flow --------------------------------------------------------

KNN = "p AS (SELECT vec_id AS id, embedding AS vec FROM embeddings),\nd AS (SELECT q.id AS q, p.id, pow(list_distance(q.vec::DOUBLE[], p.vec::DOUBLE[]), 2) AS d FROM p q JOIN p ON p.id <> q.id),\nk AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY d, id) AS rank FROM d)"


@query("embedding_knn", "embeddings", also=KNN, sql="SELECT q, id, round(d, 4) AS d, rank FROM k WHERE rank <= 10")
def _(df):
    p = df.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"))
    return velocity.nearest(p, p).select("q", "id", F.round("d", 4).alias("d"), F.col("rank").cast("long").alias("rank"))


@query("transition_prob", "embeddings", also=KNN + ",\ne AS (SELECT q AS a, id AS b, exp((1 - d / 10) / 0.1) AS e FROM k WHERE rank <= 10)", sql="SELECT a, b, round(e / sum(e) OVER (PARTITION BY b), 6) AS p FROM e")
def _(df):
    p = df.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"))
    near = velocity.nearest(p, p).select(F.col("q").alias("a"), F.col("id").alias("b"), (1 - F.col("d") / 10).alias("r"))
    return velocity.transition(near).withColumns(r6("p"))


@query("grid_flow", "embeddings", also="a AS (SELECT embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS dx, embedding[4]::DOUBLE AS dy FROM embeddings),\ns AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM a),\ng AS (SELECT i, j, x0 + i * (x1 - x0) / 9 AS gx, y0 + j * (y1 - y0) / 9 AS gy FROM s, range(0, 10) t(i), range(0, 10) u(j)),\nw AS (SELECT i, j, exp(-(pow(x - gx, 2) + pow(y - gy, 2)) / 0.02) AS w, dx, dy FROM a, g),\no AS (SELECT i, j, sum(w) AS mass, sum(w * dx) / greatest(1, sum(w)) AS dx, sum(w * dy) / greatest(1, sum(w)) AS dy FROM w GROUP BY ALL)", sql="SELECT i, j, round(mass, 4) AS mass, round(dx, 4) + 0.0 AS dx, round(dy, 4) + 0.0 AS dy FROM o WHERE mass >= 1")
def _(df):
    e = lambda k: F.element_at("embedding", k).cast("double")
    out = velocity.grid_flow(df.select(e(1).alias("x"), e(2).alias("y"), e(3).alias("dx"), e(4).alias("dy")), width=0.1)
    return out.select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.round("mass", 4).alias("mass"), (F.round("dx", 4) + 0.0).alias("dx"), (F.round("dy", 4) + 0.0).alias("dy"))


# --- streams in batch form -------------------------------------------------


@query("event_sessions", "events", also="w0 AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS k FROM events),\nw1 AS (SELECT *, sum(k) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g FROM w0)", sql="SELECT user_id, count(*) AS n FROM w1 GROUP BY user_id, g")
def _(df):
    return streams.sessions(df).select("user_id", "n")


# --- split reads, boundaries and plots -------------------------------------




def alignments_of(df):
    w = Window.partitionBy("rid").orderBy("line", "pk", "sk", "start")
    rows = df.withColumns({"k": F.row_number().over(w), "reverse": F.col("start") % 2 == 0})
    lead, own = (F.col("pk") % 40 + F.col("k") * 100).cast("string"), (F.col("nm") + 50).cast("string")
    tail = (F.col("k") * 0 + 900).cast("string")
    plus = F.concat(lead, F.lit("S"), own, F.lit("M"), tail, F.lit("H"))
    minus = F.concat(tail, F.lit("H"), own, F.lit("M"), lead, F.lit("S"))
    return rows.select(F.col("rid").cast("string").alias("qname"), "chrom", "start", "stop", "reverse", F.when(F.col("reverse"), minus).otherwise(plus).alias("cigar"), F.repeat(F.lit("A"), (F.col("nm") + 50).cast("int")).alias("seq"), F.col("bc").cast("string").alias("bc"))


@query("split_junctions", "reads", also="""a0 AS (SELECT rid, chrom, start, stop, start % 2 = 0 AS rev, pk % 40 + 100 * row_number() OVER (PARTITION BY rid ORDER BY line, pk, sk, start) AS q, nm + 50 AS own FROM reads),
a1 AS (SELECT *, lead(chrom) OVER w AS c2, lead(CASE WHEN rev THEN stop - 1 ELSE start END) OVER w AS x2, lead(CASE WHEN rev THEN 'R' ELSE 'L' END) OVER w AS k2, lead(q) OVER w AS q2 FROM a0 WINDOW w AS (PARTITION BY rid ORDER BY q))""", sql="SELECT rid::VARCHAR AS qname, chrom AS chrom1, CASE WHEN rev THEN start ELSE stop - 1 END AS coord1, CASE WHEN rev THEN 'L' ELSE 'R' END AS clip1, c2 AS chrom2, x2 AS coord2, k2 AS clip2, q + own - q2 AS \"offset\" FROM a1 WHERE c2 IS NOT NULL")
def _(df):
    out = splitreads.split_junctions(alignments_of(df))
    return out.select("qname", *[F.col(f"{s}.{c}").alias(f"{c}{k}") for k, s in ((1, "a"), (2, "b")) for c in ("chrom", "coord", "clip")], F.col("offset").cast("long").alias("offset"))


SPLIT = """a0 AS (SELECT rid, chrom, start, stop, start % 2 = 0 AS rev, pk % 40 + 100 * row_number() OVER (PARTITION BY rid ORDER BY line, pk, sk, start) AS q, nm + 50 AS own FROM reads),
a1 AS (SELECT row(chrom, CASE WHEN rev THEN start ELSE stop - 1 END, CASE WHEN rev THEN 'L' ELSE 'R' END) AS a, lead(row(chrom, CASE WHEN rev THEN stop - 1 ELSE start END, CASE WHEN rev THEN 'R' ELSE 'L' END)) OVER w AS b, q + own - lead(q) OVER w AS o FROM a0 WINDOW w AS (PARTITION BY rid ORDER BY q)),
a2 AS (SELECT CASE WHEN a <= b THEN a ELSE b END AS lo, CASE WHEN a <= b THEN b ELSE a END AS hi, o FROM a1 WHERE b IS NOT NULL)"""


@query("junction_support", "reads", also=SPLIT, sql="SELECT lo[1] AS chrom1, lo[2] AS coord1, lo[3] AS clip1, hi[1] AS chrom2, hi[2] AS coord2, hi[3] AS clip2, count(*) AS n, min(o)::BIGINT AS \"offset\" FROM a2 GROUP BY lo, hi")
def _(df):
    return splitreads.count_junctions(splitreads.split_junctions(alignments_of(df))).select("chrom1", "coord1", "clip1", "chrom2", "coord2", "clip2", "n", F.col("offset").cast("long").alias("offset"))


@query("read_groups", "reads", sql="SELECT rid::VARCHAR AS qname, count(*) FILTER (line % 5 = 1) AS read1, count(*) FILTER (line % 5 = 3) AS read1_s, count(*) FILTER (line % 5 = 2) AS read2, count(*) FILTER (line % 5 = 4) AS read2_s, count(*) FILTER (line % 5 = 0) AS single FROM reads GROUP BY rid")
def _(df):
    k = F.col("line") % 5
    flag = F.when(k == 1, 65).when(k == 3, 65 + 2048).when(k == 2, 129).when(k == 4, 129 + 2048).otherwise(0)
    out = splitreads.group_by_read(df.select(F.col("rid").cast("string").alias("qname"), "chrom", "start", F.lit("50M").alias("cigar"), flag.alias("flag")))
    return out.select("qname", *[F.size(c).cast("long").alias(c) for c in ("read1", "read1_s", "read2", "read2_s", "single")])


@query("normal_spanning", "sites", "reads", also=f"g AS (SELECT DISTINCT chrom, start, stop, rid FROM reads WHERE nm <= 1 AND NOT clip_l AND NOT clip_r)", sql="SELECT s.chrom || ':' || s.coord || s.clip AS site, g.rid::VARCHAR AS qname FROM sites s JOIN g ON g.chrom = s.chrom AND g.start <= s.coord - 5 AND g.stop > s.coord + 5 GROUP BY ALL")
def _(sites, df):
    rows = df.select("chrom", "start", "stop", F.col("rid").cast("string").alias("qname"), "nm", F.lit(None).cast("string").alias("sa"), F.when(F.col("clip_l") | F.col("clip_r"), "3S50M").otherwise("50M").alias("cigar"))
    return splitreads.spans_normally(rows, sites.withColumn("site", F.concat(F.concat_ws(":", "chrom", "coord"), F.col("clip"))))


@query("best_evidence", "reads", sql="SELECT chrom AS junction, rid::VARCHAR AS qname, CASE min(CASE WHEN line = 1 THEN 0 WHEN line = 2 THEN 1 ELSE 2 END) WHEN 0 THEN 'split_SA' WHEN 1 THEN 'single_clip' ELSE 'normal_spanning' END AS kind FROM reads GROUP BY ALL")
def _(df):
    kind = F.when(F.col("line") == 1, "split_SA").when(F.col("line") == 2, "single_clip").otherwise("normal_spanning")
    return splitreads.best_evidence(df.select(F.col("chrom").alias("junction"), F.col("rid").cast("string").alias("qname"), kind.alias("kind")))


@query("target_gene_filter", "rings", sql="SELECT ring, idx FROM rings WHERE ring IN (SELECT ring FROM rings WHERE splits IN (3, 7))")
def _(rings):
    rows = rings.select(F.col("ring").alias("circle"), "idx", F.concat(F.lit("x; g"), F.col("splits").cast("string")).alias("gene"))
    return splitreads.any_gene(rows, ["g3", "g7"]).select(F.col("circle").alias("ring"), F.col("idx").cast("long").alias("idx"))


@query("fragment_builder", "reads", sql="SELECT chrom, start + 4 AS start, start + 4 + t - 9 AS stop, bc::VARCHAR AS barcode, count(*) AS n FROM (SELECT *, pk % 6000 AS t FROM reads) WHERE NOT dup AND mapq >= 20 AND t > 0 AND t - 9 BETWEEN 10 AND 5000 GROUP BY ALL")
def _(df):
    rows = df.select("chrom", "start", "mapq", F.when(F.col("dup"), 1026).otherwise(2).alias("flag"), (F.col("pk") % 6000).alias("tlen"), F.col("bc").cast("string").alias("cb"))
    return splitreads.fragments_of(rows)


MERGED_PAIRS = EDGES + """,
p AS (SELECT *, row_number() OVER (PARTITION BY chrom1, coord1, clip1 ORDER BY coord2, chrom2, clip2) AS i FROM pairs),
r AS (SELECT chrom1, coord1, clip1, i, 1 AS g, chrom2, coord2, clip2, n, 20000 AS wide FROM p WHERE i = 1
 UNION ALL SELECT chrom1, coord1, clip1, i, g + CASE WHEN hit THEN 0 ELSE 1 END, CASE WHEN hit AND kn >= n THEN k2 ELSE chrom2 END, CASE WHEN hit AND kn >= n THEN kc ELSE coord2 END, CASE WHEN hit AND kn >= n THEN kp ELSE clip2 END, CASE WHEN hit THEN n + kn ELSE n END, CASE WHEN hit AND kn >= n THEN 20000 + coord2 - kc ELSE 20000 END
 FROM (SELECT p.*, r.g, r.chrom2 AS k2, r.coord2 AS kc, r.clip2 AS kp, r.n AS kn, p.coord2 - r.coord2 <= greatest(20000, r.wide) AS hit FROM r JOIN p ON p.chrom1 = r.chrom1 AND p.coord1 = r.coord1 AND p.clip1 = r.clip1 AND p.i = r.i + 1)),
z AS (SELECT *, row_number() OVER (PARTITION BY chrom1, coord1, clip1, g ORDER BY i DESC) AS k FROM r)"""


@query("merge_close_pairs", "links", also=MERGED_PAIRS, sql="SELECT chrom1, coord1, clip1, chrom2, coord2, clip2, n FROM z WHERE k = 1")
def _(links):
    return splitreads.merge_close_pairs(breakpoints.count_links(links), reach=20_000).select("chrom1", "coord1", "clip1", "chrom2", "coord2", "clip2", "n")


@query("boundary_support", "segments", "sites", also="l AS (SELECT seg, arg_max(coord, (n, -abs(start - coord), -coord)) AS x FROM segments s JOIN sites e ON e.chrom = s.chrom AND e.clip = 'L' AND abs(e.coord - s.start) <= 10000 WHERE seg % 3 <= 1 GROUP BY seg),\nr AS (SELECT seg, arg_max(coord, (n, -abs(stop - coord), -coord)) AS x FROM segments s JOIN sites e ON e.chrom = s.chrom AND e.clip = 'R' AND abs(e.coord - s.stop) <= 10000 WHERE seg % 2 <= 1 GROUP BY seg)", sql="SELECT seg, chrom, coalesce(l.x, start) AS start, coalesce(r.x, stop) AS stop FROM segments LEFT JOIN l USING (seg) LEFT JOIN r USING (seg)")
def _(segments, sites):
    rows = segments.withColumns({"clip_left": F.col("seg") % 3, "clip_right": F.col("seg") % 2})
    return boundaries.boundary_support(rows, sites.withColumnRenamed("n", "support")).select("seg", "chrom", "start", "stop")


@query("rescue_segments", "sites", "segments", "reads")
def _(sites, segments, df):
    return boundaries.rescue_segments(sites.withColumnRenamed("n", "support"), segments, bins_of(df), least_cn=2.0).withColumns(r6("cn"))


@query("plot_axis", "sites", "segments", also="g AS (SELECT chrom, start, stop, sum(stop - start) OVER (ORDER BY seg) - (stop - start) AS o FROM segments)", sql="SELECT s.chrom, coord, clip, (coord - g.start + g.o)::BIGINT AS x FROM sites s JOIN g ON g.chrom = s.chrom AND coord >= g.start AND coord < g.stop")
def _(sites, segments):
    return boundaries.remap_axis(sites, segments.withColumnRenamed("seg", "idx")).select("chrom", "coord", "clip", "x")


@query("plot_rows", "genes")
def _(genes):
    return boundaries.pack_rows(genes)


ROIS = """p AS (SELECT chrom, start, stop, cn, row_number() OVER (PARTITION BY chrom ORDER BY start, stop) AS i FROM segments),
r AS (SELECT chrom, i, 1 AS g, start AS a, stop AS b, cn AS s FROM p WHERE i = 1
 UNION ALL SELECT chrom, i, g + CASE WHEN hit THEN 0 ELSE 1 END, CASE WHEN hit THEN a ELSE start END, CASE WHEN hit THEN greatest(b, stop) ELSE stop END, CASE WHEN hit THEN greatest(s, cn) ELSE cn END
 FROM (SELECT p.*, r.g, r.a, r.b, r.s, p.start - greatest(trunc(0.3::DOUBLE * (p.stop - p.start)), 100000) <= r.b + greatest(trunc(0.3::DOUBLE * (r.b - r.a)), 100000) AS hit FROM r JOIN p ON p.chrom = r.chrom AND p.i = r.i + 1)),
z AS (SELECT *, row_number() OVER (PARTITION BY chrom, g ORDER BY i DESC) AS k, greatest(trunc(0.3::DOUBLE * (b - a)), 100000)::BIGINT AS w FROM r)"""


@query("plot_rois", "segments", also=ROIS, sql="SELECT chrom, greatest(0, a - w) AS start, b + w AS stop, s AS score FROM z WHERE k = 1")
def _(segments):
    return boundaries.merge_rois(segments.withColumnRenamed("cn", "score"))


@query("prune_neighbours", "links", also=EDGES + ",\ne AS (SELECT CASE WHEN chrom1 <= chrom2 THEN chrom1 ELSE chrom2 END AS a, CASE WHEN chrom1 <= chrom2 THEN chrom2 ELSE chrom1 END AS b, sum(n)::DOUBLE AS weight FROM pairs GROUP BY ALL),\nd AS (SELECT a AS v, * FROM e UNION ALL SELECT b AS v, * FROM e),\nr AS (SELECT *, row_number() OVER (PARTITION BY v ORDER BY weight DESC, a, b) AS k FROM d)", sql="SELECT a, b, max(weight) AS weight FROM r WHERE k <= 4 GROUP BY a, b HAVING count(*) = 2 OR a = b")
def _(links):
    pairs = breakpoints.count_links(links)
    edges = pairs.groupBy(F.least("chrom1", "chrom2").alias("a"), F.greatest("chrom1", "chrom2").alias("b")).agg(F.sum("n").cast("double").alias("weight")).withColumn("kind", F.lit("outer"))
    return graph.prune_neighbours(edges).select("a", "b", "weight")


@query("interval_counts", "segments", "reads", sql="SELECT seg, count(DISTINCT rid) AS reads, round(count(DISTINCT rid) * 1000.0 / (s.stop - s.start), 6) AS per_kb FROM segments s JOIN reads r ON r.chrom = s.chrom AND r.start < s.stop AND s.start < r.stop AND s.start < s.stop GROUP BY seg, s.start, s.stop")
def _(segments, df):
    return cells.interval_reads(segments, df).withColumns(r6("per_kb"))


@query("cell_annotation", "reads", sql="SELECT bc AS cell, count(DISTINCT rid) AS reads, count(DISTINCT chrom) AS junctions, CASE WHEN count(DISTINCT rid) >= 20 THEN 'supported' WHEN count(DISTINCT rid) >= 1 THEN 'weak' ELSE 'none' END AS status FROM reads WHERE clip_l GROUP BY bc")
def _(df):
    return cells.annotate_cells(df.where("clip_l").select(F.col("bc").alias("cell"), F.col("chrom").alias("junction"), "rid"), strong=20)


# --- filters by interval, and projections ----------------------------------


@query("drop_listed_sites", "sites", "genes", sql="SELECT chrom, coord, clip, n FROM sites s WHERE NOT EXISTS (SELECT 1 FROM genes g WHERE g.chrom = s.chrom AND g.start - 100 <= coord AND coord < g.stop + 100)")
def _(sites, genes):
    return breakpoints.drop_listed(sites, genes)


NEAR_END = "EXISTS (SELECT 1 FROM segments g WHERE g.chrom = p.chrom{k} AND g.start - 20000 <= coord{k} AND coord{k} < g.stop + 20000)"


@query("pairs_near_segments", "links", "segments", also=EDGES, sql=f"SELECT chrom1, coord1, clip1, chrom2, coord2, clip2, n FROM pairs p WHERE {NEAR_END.format(k=1)} OR {NEAR_END.format(k=2)}")
def _(links, segments):
    return breakpoints.pairs_by_end(breakpoints.count_links(links).drop("rids"), segments, 20_000)


@query("pairs_off_listed", "links", "segments", also=EDGES, sql=f"SELECT chrom1, coord1, clip1, chrom2, coord2, clip2, n FROM pairs p WHERE NOT ({NEAR_END.format(k=1)} OR {NEAR_END.format(k=2)})")
def _(links, segments):
    return breakpoints.pairs_by_end(breakpoints.count_links(links).drop("rids"), segments, 20_000, keep=False)


STRATA = "t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chrom, clip ORDER BY n DESC, coord) AS k FROM sites) WHERE k <= 50),\nu AS (SELECT *, ntile(10) OVER (ORDER BY n, chrom, coord, clip) AS part FROM t),\nv AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY md5('1:' || chrom || ':' || coord || ':' || clip)) AS j FROM u)"


@query("stratified_sites", "sites", also=STRATA, sql="SELECT chrom, coord, clip, n FROM v WHERE j <= 20")
def _(sites):
    return breakpoints.stratified_sample(breakpoints.top_n_per_chrom(sites, 50).drop("rank"), "n", 10, 20)


@query("range_intersections", "segments", "genes", also="m AS (SELECT s.chrom, greatest(s.start, g.start) AS start, least(s.stop, g.stop) AS stop FROM segments s JOIN (SELECT * FROM genes WHERE kind IN ('SMALL', 'ECONOMY')) g ON g.chrom = s.chrom AND g.start <= s.stop AND s.start <= g.stop),\n" + ISLANDS.replace("start >= max", "start > max").format(gap=0, t="m"), sql="SELECT chrom, start, stop FROM merged")
def _(segments, genes):
    return intervals.intersections(segments, genes.where("kind in ('SMALL', 'ECONOMY')"))


@query("delta_projection", "embeddings", also=KNN + ",\ng AS (SELECT k.q, k.id, unnest(range(1, 33)) AS i FROM k WHERE rank <= 10),\nx AS (SELECT g.q, g.id, b.vec[i]::DOUBLE - a.vec[i]::DOUBLE AS d, a.vec[i + 32]::DOUBLE AS v FROM g JOIN p a ON a.id = g.q JOIN p b ON b.id = g.id)", sql="SELECT q AS a, id AS b, round(corr(sign(d) * log10(abs(d) + 1), sign(v) * log10(abs(v) + 1)), 5) AS r FROM x GROUP BY q, id")
def _(df):
    p = df.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"))
    state = p.select("id", F.slice("vec", 1, 32).alias("e"), F.slice("vec", 33, 32).alias("v"))
    near = velocity.nearest(p, p).select(F.col("q").alias("a"), F.col("id").alias("b"))
    return velocity.delta_correlation(state, near, "log").withColumn("r", F.round("r", 5))
