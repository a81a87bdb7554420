"""Registered queries of refinement, single cells and known structures, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from circlet.functions import text
from circlet.operators import boundaries, breakpoints, cells, coverage, evidence, graph, intervals, pairing, refine, segmentation, singlecell, splitreads, velocity
from circlet.plans.catalog import BINS, EDGES, ISLANDS, JUNCTIONS, QUERIES, bins_of, query, r6, ring_graph
from circlet.sources.staging import stage

CLUSTERS = "w0 AS (SELECT *, CASE WHEN coord1 - lag(coord1) OVER (PARTITION BY chrom1, clip1, chrom2, clip2 ORDER BY coord1, coord2, rid) < 3500 THEN 0 ELSE 1 END AS k FROM links),\nw1 AS (SELECT *, sum(k) OVER (PARTITION BY chrom1, clip1, chrom2, clip2 ORDER BY coord1, coord2, rid ROWS UNBOUNDED PRECEDING) AS g FROM w0),\ncl AS (SELECT chrom1, CASE WHEN clip1 = 'R' THEN max(coord1) ELSE min(coord1) END AS coord1, chrom2, CASE WHEN clip2 = 'R' THEN max(coord2) ELSE min(coord2) END AS coord2 FROM w1 GROUP BY chrom1, clip1, chrom2, clip2, g HAVING count(*) >= 2)"
LISTED = "genes WHERE kind = 'PROMO'"
SPAN = "chrom || ':' || start || '-' || stop"


def listed(genes):
    return genes.where("kind = 'PROMO'")


# --- segments --------------------------------------------------------------


@query("cutoff_segments", "reads", also=BINS + ",\nc AS (SELECT avg(cn) + 1.5 * stddev_samp(cn) AS c FROM bins),\nh AS (SELECT *, CASE WHEN coord - lag(coord) OVER (PARTITION BY chrom ORDER BY coord) <= 10000 THEN 0 ELSE 1 END AS k FROM bins, c WHERE cn > c),\ng AS (SELECT *, sum(k) OVER (PARTITION BY chrom ORDER BY coord) AS g FROM h)", sql="SELECT chrom, min(coord) AS start, max(coord) + 10000 AS stop, count(*) AS bins, round(avg(cn), 6) AS cn FROM g GROUP BY chrom, g")
def _(df):
    return refine.cutoff_segments(bins_of(df), 1.5).withColumns(r6("cn"))


@query("interior_filter", "segments", "reads", also=BINS + ",\np AS (SELECT seg, avg(CASE WHEN b.cn >= 2 THEN 1.0 ELSE 0.0 END) AS p FROM segments s JOIN bins b ON b.chrom = s.chrom AND b.coord >= s.start AND b.coord < s.stop GROUP BY seg)", sql="SELECT s.seg, chrom, start, stop, round(coalesce(p, 1.0), 6) AS high_share FROM segments s LEFT JOIN p USING (seg) WHERE coalesce(p, 1.0) >= 0.5 AND cn > 2")
def _(segments, df):
    return refine.interior_filter(segments, bins_of(df), high=2.0).select("seg", "chrom", "start", "stop", F.round("high_share", 6).alias("high_share"))


@query("protected_bins", "links", "genes", "reads", also=BINS + ",\n" + CLUSTERS + f",\ne AS (SELECT * FROM cl WHERE EXISTS (SELECT 1 FROM {LISTED} AND chrom = chrom1 AND start <= coord1 AND coord1 < stop) OR EXISTS (SELECT 1 FROM {LISTED} AND chrom = chrom2 AND start <= coord2 AND coord2 < stop)),\nn AS (SELECT chrom1 AS chrom, coord1 AS spot FROM e UNION SELECT chrom2, coord2 FROM e)", sql="SELECT DISTINCT b.chrom, b.coord FROM bins b JOIN n ON n.chrom = b.chrom AND abs(b.coord - spot) <= 100000 WHERE b.cn >= 2.5")
def _(links, genes, df):
    return refine.protected_bins(bins_of(df), breakpoints.cluster_links(links, gap=3500), listed(genes), least=2.5)


@query("smooth_trimmed", "reads")
def _(df):
    x = bins_of(df).withColumn("x", F.log2(F.col("cn") / 2)).select("chrom", "coord", "x")
    return refine.smooth_trimmed(x, far=2.0).select("chrom", "coord", F.round("smooth", 6).alias("smooth"))


@query("segments_for_graph", "segments", also=ISLANDS.format(gap=200000, t="(SELECT * FROM segments WHERE cn < 8)"), sql="SELECT chrom, start, stop FROM merged UNION SELECT chrom, start, stop FROM segments WHERE cn >= 8")
def _(segments):
    return refine.segments_for_graph(segments.withColumn("source", F.when(F.col("cn") < 8, "clip").otherwise("PE_seg")))


BOUNDS = "b AS (SELECT DISTINCT chrom, start AS spot, 'L' AS clip FROM segments UNION SELECT DISTINCT chrom, stop, 'R' FROM segments)"


def nearest_sql(k: int) -> str:
    return f"n{k} AS (SELECT chrom{k}, coord{k}, clip{k}, min(spot) AS to{k} FROM (SELECT q.*, b.spot, abs(q.coord{k} - b.spot) AS d, min(abs(q.coord{k} - b.spot)) OVER (PARTITION BY q.chrom{k}, q.coord{k}, q.clip{k}) AS m FROM (SELECT DISTINCT chrom{k}, coord{k}, clip{k} FROM pairs) q JOIN b ON b.chrom = q.chrom{k} AND b.clip = q.clip{k} AND abs(q.coord{k} - b.spot) <= 2000) WHERE d = m GROUP BY ALL HAVING count(*) = 1)"


@query("snap_pe_pairs", "links", "segments", also=EDGES + ",\n" + BOUNDS + ",\n" + nearest_sql(1) + ",\n" + nearest_sql(2), sql="SELECT chrom1, CASE WHEN to1 IS NULL OR to2 IS NULL THEN coord1 ELSE to1 END AS coord1, clip1, chrom2, CASE WHEN to1 IS NULL OR to2 IS NULL THEN coord2 ELSE to2 END AS coord2, clip2, n FROM pairs LEFT JOIN n1 USING (chrom1, coord1, clip1) LEFT JOIN n2 USING (chrom2, coord2, clip2)")
def _(links, segments):
    pairs = breakpoints.count_links(links).drop("rids").withColumn("source", F.lit("pe"))
    return refine.snap_pe_pairs(pairs, segments, reach=2000).drop("source")


@query("knn_segments", "segments", "links")
def _(segments, links):
    merged = intervals.merge_bed(segments).select("chrom", "start", "stop")
    return refine.knn_segments(merged, breakpoints.count_links(links).drop("rids"))


def ds_pairs(links, segments):
    """Pairs of which one end is put on the start of the segment of the same number: what a search around known boundaries gives."""
    pairs = breakpoints.count_links(links).drop("rids")
    at = segments.select("chrom", F.col("start").alias("s"), F.col("stop").alias("e"), "cn")
    rows = pairs.where("chrom1 = chrom2").join(at, F.col("chrom1") == F.col("chrom")).where("coord2 between e - 9000 and e + 9000")
    rows = rows.select("chrom1", F.col("s").alias("coord1"), F.lit("L").alias("clip1"), "chrom2", "coord2", F.lit("R").alias("clip2"), (F.col("n") + 1).alias("n")).distinct()
    return rows.withColumns({"id": F.xxhash64("chrom1", "coord1", "coord2", "n"), "source": F.lit("ds")})


@query("snap_ds_pairs", "links", "segments", "reads", "sites")
def _(links, segments, df, sites):
    clips = sites.where("clip = 'R'")
    return refine.snap_ds_pairs(ds_pairs(links, segments), segments, bins_of(df), clips, high=1.0).drop("id", "source")


@query("sound_pairs", "links", "segments", "sites", also=EDGES + ",\n" + ISLANDS.format(gap=200000, t="segments") + """,
f AS (SELECT *, CASE WHEN clip1 = clip2 THEN 'split' WHEN clip1 = 'L' THEN 'ds' ELSE 'pe' END AS source, coord1 // 500 % 60 - 30 AS o, repeat('A', (coord2 // 500 % 12)::INT) AS seq FROM pairs),
g AS (SELECT *, CASE WHEN length(seq) < 2 THEN 0 ELSE 1 END AS share FROM f)""", sql="SELECT chrom1, coord1, clip1, chrom2, coord2, clip2, n FROM g p WHERE n >= 1 AND (chrom1 <> chrom2 OR abs(coord1 - coord2) >= 500) AND o <= 20 AND o >= -25 AND (source <> 'split' OR (length(seq) >= 5 AND share <= 1)) AND EXISTS (SELECT 1 FROM merged m WHERE m.chrom = p.chrom1 AND coord1 < m.stop + 10000 AND coord1 >= m.start - 10000) AND EXISTS (SELECT 1 FROM merged m WHERE m.chrom = p.chrom2 AND coord2 < m.stop + 10000 AND coord2 >= m.start - 10000) AND (source <> 'ds' OR EXISTS (SELECT 1 FROM sites s WHERE s.n >= 2 AND ((s.chrom = chrom1 AND s.coord = coord1 AND s.clip = clip1) OR (s.chrom = chrom2 AND s.coord = coord2 AND s.clip = clip2))))")
def _(links, segments, sites):
    source = F.when(F.col("clip1") == F.col("clip2"), "split").when(F.col("clip1") == "L", "ds").otherwise("pe")
    step = lambda c, m: F.floor(F.col(c) / 500) % m
    pairs = breakpoints.count_links(links).drop("rids").withColumns({"source": source, "pe": F.lit(False), "offset": step("coord1", 60) - 30, "seq": F.repeat(F.lit("A"), step("coord2", 12).cast("int"))})
    out = breakpoints.sound_pairs(pairs, 1, 500, segments, sites.where("n >= 2"), gap=25, repeats=1.0)
    return out.drop("source", "pe", "offset", "seq")


def clipped_segments(segments, sites):
    """Segments apart from each other; the clips of a boundary are the clipped places of its side within 2 kb."""
    rows = intervals.merge_bed(segments, 0).select(F.xxhash64("chrom", "start").alias("seg"), "chrom", "start", "stop", F.lit(5.0).alias("cn"))
    sites = stage(sites, "sites")
    for side, col, name in boundaries.SIDES:
        near = breakpoints.band(sites.where(F.col("clip") == side).select("chrom", F.col("coord").alias("_at")), 2_001, "_at")
        met = rows.withColumn("_band", F.floor(F.col(col) / 2_001)).join(near, ["chrom", "_band"]).where(F.abs(F.col(col) - F.col("_at")) <= 2_000)
        rows = rows.join(met.groupBy("seg").agg(F.count("*").alias(f"clip_{name}")), "seg", "left").withColumn(f"clip_{name}", F.coalesce(f"clip_{name}", F.lit(0)))
    return rows


def wide_edges(links):
    """Links as edges, those whose places share a cell of 5 kb together."""
    cell = lambda c: F.floor(F.col(c) / 5000) * 5000
    return breakpoints.count_links(links.withColumns({"coord1": cell("coord1"), "coord2": cell("coord2")})).drop("rids").withColumnRenamed("n", "support")


def refined(segments, sites, links, df):
    """refine_boundaries() of the test tables."""
    edges = wide_edges(links)
    return boundaries.refine_boundaries(clipped_segments(segments, sites), edges, bins_of(df), reach=30_000, least=1, anchor=20_000, merge=5_000, min_cn=1.5, weak_least=1, weak_reach=20_000)


@query("refined_boundaries", "segments", "sites", "links", "reads")
def _(segments, sites, links, df):
    """Segments after the passes over discordant ends, with where each boundary comes from."""
    out, _ = refined(segments, sites, links, df)
    partner = lambda n: F.concat_ws(":", f"partner_{n}.chrom", F.col(f"partner_{n}.coord").cast("string"), f"partner_{n}.clip").alias(f"partner_{n}")
    return out.select("chrom", "start", "stop", F.round("cn", 6).alias("cn"), "clip_left", "clip_right", "disc_left", "disc_right", partner("left"), partner("right"), "source")


@query("snapped_edges", "segments", "sites", "links", "reads")
def _(segments, sites, links, df):
    """Discordant edges whose ends went to the refined boundaries."""
    return refined(segments, sites, links, df)[1].select(*boundaries.EDGE, "support")


SEGMENTS_SQL = ISLANDS.format(gap=20000, t="segments") + """,
e AS (SELECT chrom, coord, clip, n FROM sites WHERE n >= 2),
p AS (SELECT chrom1, coord1, clip1, chrom2, coord2, clip2, n, CASE WHEN n = 1 THEN 'pe' ELSE 'split' END AS source FROM pairs
  WHERE (chrom1, coord1, clip1) IN (SELECT (chrom, coord, clip) FROM e) AND (chrom2, coord2, clip2) IN (SELECT (chrom, coord, clip) FROM e)),
near AS (SELECT e.*, m.start AS component, greatest(m.start - coord, coord - m.stop, 0) AS far, row_number() OVER (PARTITION BY e.chrom, coord, clip ORDER BY greatest(m.start - coord, coord - m.stop, 0), m.start) AS r
  FROM e JOIN merged m ON m.chrom = e.chrom AND m.start - coord <= 20000 AND coord - m.stop <= 20000),
c AS (SELECT * FROM near WHERE r = 1),
facing AS (SELECT a.chrom, a.coord, a.clip, b.coord AS other, b.n, row_number() OVER (PARTITION BY a.chrom, a.coord, a.clip ORDER BY abs(a.coord - b.coord)) AS k
  FROM c a JOIN c b ON a.chrom = b.chrom AND a.component = b.component AND a.clip <> b.clip AND CASE WHEN a.clip = 'L' THEN b.coord > a.coord ELSE b.coord < a.coord END),
paired AS (SELECT chrom, coord, arg_max(other, (n, -abs(coord - other))) AS other FROM facing WHERE k <= 3 GROUP BY chrom, coord, clip),
loops AS (SELECT chrom1 AS chrom, least(coord1, coord2) AS start, greatest(coord1, coord2) AS stop, source FROM p WHERE chrom1 = chrom2 AND (clip1 = 'L' AND clip2 = 'R' AND coord1 < coord2 OR clip1 = 'R' AND clip2 = 'L' AND coord1 > coord2)),
new AS (SELECT chrom, least(coord, other) AS start, greatest(coord, other) AS stop FROM paired
  UNION SELECT chrom, start, stop FROM loops WHERE source = 'split' OR (chrom, start, stop) IN (SELECT (chrom, start, stop) FROM merged)),
cover AS (SELECT n.chrom, n.start, n.stop, sum(least(n.stop, m.stop) - greatest(n.start, m.start)) AS inside FROM new n JOIN merged m ON m.chrom = n.chrom AND m.start < n.stop AND n.start < m.stop WHERE n.stop - n.start BETWEEN 100 AND 50000000 GROUP BY ALL)"""


@query("graph_segments", "segments", "sites", "links", also=EDGES + ",\n" + SEGMENTS_SQL, sql="SELECT chrom, start, stop FROM merged UNION SELECT chrom, start, stop FROM cover WHERE inside >= 0.5 * (stop - start)")
def _(segments, sites, links):
    """Segments of the graph between breakpoints in amplified regions."""
    pairs = breakpoints.count_links(links).withColumn("source", F.when(F.col("n") == 1, "pe").otherwise("split"))
    regions = intervals.merge_bed(segments, 10_000).select("chrom", "start", "stop")
    return segmentation.graph_segments(sites.where("n >= 2"), pairs, regions, within=False)


# --- graph -----------------------------------------------------------------


@query("representative_paths", "rings", sql="SELECT chrom, count(*) AS rings, sum(k)::BIGINT AS nodes FROM (SELECT ring, chrom, 2 * count(*) AS k FROM rings GROUP BY ALL) GROUP BY chrom")
def _(rings):
    # each ring is a component of its own, so it stands for itself
    v, edges = ring_graph(rings)
    chosen = graph.representatives(graph.find_paths(edges, graph.label_components(edges)), edges, v).where("kind = 'ring'")
    return chosen.select(F.element_at("path", 1).alias("id"), F.size("path").alias("k")).join(v.select("id", "chrom"), "id").groupBy("chrom").agg(F.count("*").alias("rings"), F.sum("k").cast("long").alias("nodes"))


def inverted_rings(rings):
    """The rings' graph with a second way through each ring of three segments and more: its second segment the other way round. Its two junctions have as much support as the ring's first two segments have copies."""
    v, edges = ring_graph(rings)
    end = lambda idx, clip: F.xxhash64("ring", idx, F.lit(clip))
    k = rings.groupBy("ring").agg(F.count("*").alias("k"), F.sum(F.when(F.col("idx") == 1, F.round("cn", 2))).alias("w1"), F.sum(F.when(F.col("idx") == 2, F.round("cn", 2))).alias("w2")).where("k >= 3")
    idx = [F.lit(i).cast(rings.schema["idx"].dataType) for i in (1, 2, 3)]
    ways = ((end(idx[0], "R"), end(idx[1], "R"), "w1"), (end(idx[1], "L"), end(idx[2], "L"), "w2"))
    for x, y, w in ways:
        edges = edges.unionByName(k.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"), F.lit("outer").alias("kind"), F.col(w).alias("weight")))
    return v, edges


@query("competing_rings", "rings", also="k AS (SELECT ring, count(*) AS k, any_value(chrom) AS chrom, sum(splits) FILTER (idx <= 2) AS own, round(sum(round(cn, 2)) FILTER (idx <= 2), 2) AS other FROM rings GROUP BY ring HAVING count(*) >= 3)", sql="SELECT ring, own < other AS inverted, round(greatest(own, other), 2) AS best FROM k WHERE own <> other")
def _(rings):
    """Which of a ring's two ways through its second segment stands for both: the one whose junctions have more support. Rings whose ways are equal are left out."""
    # vertices of every other segment are on another chromosome, so that no ring is at home and each must compete
    v, edges = inverted_rings(rings)
    apart = v.withColumn("chrom", F.concat_ws("_", "chrom", (F.col("idx") % 2).cast("string")))
    paths = graph.find_paths(edges, graph.label_components(edges)).where("kind = 'ring'")
    chosen = graph.representatives(paths, edges, apart)
    seconds = v.where("idx = 2 and clip = 'R'").select(F.col("id").alias("second"), "ring").join(v.where("idx = 1 and clip = 'R'").select(F.col("id").alias("first"), "ring"), "ring")
    met = chosen.select("path", F.explode("path").alias("second")).join(seconds, "second")
    # next to each other in the ring: the segment is entered at its right end
    at = lambda c: F.array_position("path", F.col(c))
    inverted = F.abs(at("first") - at("second")).isin(1, F.size(F.col("path")) - 1)
    w = rings.groupBy("ring").agg(F.sum(F.when(F.col("idx") <= 2, F.col("splits"))).alias("own"), F.round(F.sum(F.when(F.col("idx") <= 2, F.round("cn", 2))), 2).alias("other"), F.count("*").alias("k")).where("k >= 3 and own <> other")
    return met.join(w, "ring").select("ring", inverted.alias("inverted"), F.round(F.when(inverted, F.col("other")).otherwise(F.col("own")), 2).alias("best"))


@query("second_search_chroms", "rings", also="l AS (SELECT ring, arg_min(row(chrom, start, stop), idx) AS s, avg(cn) AS score FROM rings GROUP BY ring),\nb AS (SELECT s, max(score) AS score FROM l GROUP BY s)", sql="SELECT DISTINCT s[1] AS chrom FROM b WHERE score >= (SELECT quantile_cont(score, 0.995) FROM b)")
def _(rings):
    scores = rings.groupBy("ring").agg(F.avg("cn").alias("score"))
    return graph.second_search_chroms(rings, scores, 0.995)


@query("new_circles", "rings", sql="SELECT ring, count(*) AS segments FROM rings WHERE ring IN (SELECT ring FROM rings GROUP BY ring HAVING max(splits) > 10) GROUP BY ring")
def _(rings):
    strong = rings.groupBy("ring").agg(F.max("splits").alias("m")).where("m <= 10").select("ring")
    return graph.new_circles(rings, rings.join(strong, "ring", "left_semi")).groupBy("ring").agg(F.count("*").alias("segments"))


# --- cells and known structures ---------------------------------------------

HITS = JUNCTIONS + """,
r AS (SELECT *, rid::VARCHAR AS qname, start + pk % 3000 AS sa_pos, start + sk % 3000 AS m_pos FROM reads WHERE mapq >= 20),
e AS (SELECT ring, idx, chrom1 AS chrom, coord1 AS coord, clip1 AS clip, chrom2 AS pc, coord2 AS pp FROM junctions UNION ALL SELECT ring, idx, chrom2, coord2, clip2, chrom1, coord1 FROM junctions),
h AS (SELECT bc::VARCHAR AS cell, ring, idx AS junction, qname, CASE WHEN clip = 'L' THEN clip_l AND abs(r.start - coord) <= 400 ELSE clip_r AND abs(r.stop - coord) <= 400 END AS c, pc = r.chrom AND abs(sa_pos - pp) <= 200000 AS sa, pc = r.chrom AND abs(m_pos - pp) <= 200000 AND line % 2 = 0 AS mt
 FROM e JOIN r ON r.chrom = e.chrom AND r.start < coord + 1001 AND greatest(coord - 1000, 0) < r.stop),
k AS (SELECT cell, ring, junction, qname, min(CASE WHEN c AND sa THEN 0 WHEN mt THEN 1 WHEN c THEN 2 END) AS k FROM h GROUP BY ALL)"""


def evidence_reads(df):
    cigar = F.concat(F.when(F.col("clip_l"), "5S").otherwise(""), F.lit("90M"), F.when(F.col("clip_r"), "5S").otherwise(""))
    sa = F.concat_ws(",", "chrom", F.col("start") + F.col("pk") % 3000 + 1, F.lit("+"), F.lit("90M"), F.lit("60"), F.lit("0"))
    return df.select("chrom", "start", "stop", "mapq", F.col("rid").cast("string").alias("qname"), F.col("bc").cast("string").alias("cb"), F.lit(1).alias("nh"), cigar.alias("cigar"), sa.alias("sa"), F.when(F.col("line") % 2 == 0, 0).otherwise(8).alias("flag"), F.col("chrom").alias("mate_chrom"), (F.col("start") + F.col("sk") % 3000).alias("mate_start"))


@query("weak_hits", "rings", "reads", also=HITS, sql="SELECT cell, ring, junction, qname, CASE k WHEN 0 THEN 'split' WHEN 1 THEN 'discordant' ELSE 'clip' END AS kind FROM k WHERE k IS NOT NULL")
def _(rings, df):
    junctions = cells.ring_junctions(rings).withColumn("junction", F.col("idx").cast("long"))
    return singlecell.weak_hits(evidence_reads(df), junctions, partner=200_000, tolerance=400)


MEMBERS = """,
p AS (SELECT * FROM pairs WHERE n >= 1),
t AS (SELECT DISTINCT chrom, coord FROM (SELECT chrom1 AS chrom, coord1 AS coord FROM p UNION SELECT chrom2, coord2 FROM p)),
m AS (SELECT t.chrom, t.coord, list_sort(list(DISTINCT ring)) AS r FROM t JOIN rings ON rings.chrom = t.chrom AND start <= coord AND coord <= stop GROUP BY ALL),
q AS (SELECT p.*, coalesce(a.r, []) AS r1, coalesce(b.r, []) AS r2 FROM p LEFT JOIN m a ON a.chrom = chrom1 AND a.coord = coord1 LEFT JOIN m b ON b.chrom = chrom2 AND b.coord = coord2),
w AS (SELECT *, chrom1 || ':' || coord1 || ':' || clip1 AS x, chrom2 || ':' || coord2 || ':' || clip2 AS y FROM q)"""


@query("annotate_pairs", "links", "rings", also=EDGES + MEMBERS, sql="SELECT least(x, y) || '|' || greatest(x, y) AS junction, chrom1, coord1, clip1, chrom2, coord2, clip2, n, 1::BIGINT AS \"rows\", array_to_string(r1, ';') AS rings1, array_to_string(r2, ';') AS rings2, array_to_string(list_sort(list_intersect(r1, r2)), ';') AS shared, len(r1) > 0 AND len(r2) > 0 AS \"both\" FROM w")
def _(links, rings):
    return singlecell.annotate_pairs(breakpoints.count_links(links).drop("rids"), rings, least=1)


@query("pair_support", "links", also=EDGES + ",\nc AS (SELECT a, b, bc, count(*) AS k FROM (SELECT ln.*, l.bc FROM (SELECT CASE WHEN (chrom1, coord1, clip1) <= (chrom2, coord2, clip2) THEN row(chrom1, coord1, clip1) ELSE row(chrom2, coord2, clip2) END AS a, CASE WHEN (chrom1, coord1, clip1) <= (chrom2, coord2, clip2) THEN row(chrom2, coord2, clip2) ELSE row(chrom1, coord1, clip1) END AS b, bc AS bc0, rid FROM links) ln, (SELECT 0 AS z) x, LATERAL (SELECT ln.bc0 AS bc) l) GROUP BY ALL),\nd AS (SELECT *, a[1] || ':' || a[2] || ':' || a[3] AS x, b[1] || ':' || b[2] || ':' || b[3] AS y FROM c)", sql="SELECT least(x, y) || '|' || greatest(x, y) AS junction, bc AS cell, k AS support FROM d")
def _(links):
    return singlecell.pair_support(links, least=1)


@query("normal_support", "reads", also="c AS (SELECT chrom AS junction, bc AS cell, CASE WHEN clip_l THEN 1 ELSE 2 END AS side, count(*) AS n FROM reads GROUP BY ALL),\nd AS (SELECT junction, cell, coalesce(sum(n) FILTER (side = 1), 0)::BIGINT AS l, coalesce(sum(n) FILTER (side = 2), 0)::BIGINT AS r FROM c GROUP BY ALL)", sql="SELECT junction, cell, l AS \"left\", r AS \"right\", least(l, r) AS normal FROM d WHERE least(l, r) > 0")
def _(df):
    counts = df.groupBy(F.col("chrom").alias("junction"), F.col("bc").alias("cell"), F.when(F.col("clip_l"), 1).otherwise(2).alias("side")).agg(F.count("*").alias("n"))
    return singlecell.normal_support(counts, "min")


@query("present_rings", "reads", sql="SELECT bc AS cell, chrom AS ring, max(CASE WHEN n >= 30 THEN 1 ELSE 0 END) AS present FROM (SELECT bc, chrom, line, count(*) AS n FROM reads GROUP BY ALL) GROUP BY ALL")
def _(df):
    support = df.groupBy(F.col("bc").alias("cell"), F.col("chrom").alias("ring"), F.col("line").alias("junction")).agg(F.count("*").alias("n"))
    return singlecell.present(support, least=30)


ANCHOR = """c AS (SELECT cell, chrom AS ring, kind AS seg, sum(n)::DOUBLE AS n FROM frags GROUP BY ALL),
t AS (SELECT cell, ring, sum(n) AS t, sqrt(sum(n * n)) AS c, sum(CASE WHEN seg = 'purchase' THEN n ELSE 0 END) AS direct FROM c GROUP BY ALL),
s AS (SELECT * FROM t WHERE direct >= 1),
a AS (SELECT c.ring, seg, sum(n / t) / (SELECT count(*) FROM s z WHERE z.ring = c.ring) AS a FROM c JOIN s USING (cell, ring) GROUP BY c.ring, seg),
z AS (SELECT ring, sqrt(sum(a * a)) AS z FROM a GROUP BY ring),
d AS (SELECT cell, ring, sum(n * a) AS d FROM c JOIN a USING (ring, seg) GROUP BY ALL)"""


@query("anchor_cosine", "frags", also=ANCHOR, sql="SELECT t.cell, t.ring, round(coalesce(d / nullif(c * z, 0), 0), 6) AS cosine FROM t LEFT JOIN d USING (cell, ring) LEFT JOIN z USING (ring)")
def _(frags):
    counts = frags.groupBy("cell", F.col("chrom").alias("ring"), F.col("kind").alias("seg")).agg(F.sum("n").alias("n"))
    direct = counts.where("seg = 'purchase'").select("cell", "ring", F.col("n").alias("direct"))
    return singlecell.anchor_cosine(counts, direct).withColumns(r6("cosine"))


FEATURES = """k AS (SELECT DISTINCT chrom, start, stop, chrom AS ring, seg FROM segments),
f0 AS (SELECT seg, 0 AS side, chrom, greatest(0, start - (stop - start)) AS start, start AS stop FROM segments UNION ALL SELECT seg, 1, chrom, stop, stop + (stop - start) FROM segments),
f AS (SELECT chrom AS ring, chrom, start, stop FROM f0 WHERE start < stop AND NOT EXISTS (SELECT 1 FROM segments s WHERE s.chrom = f0.chrom AND s.start < f0.stop AND f0.start < s.stop AND s.start < s.stop)),
z AS (SELECT ring, sum(stop - start) AS len, count(*) AS k FROM k GROUP BY ring),
y AS (SELECT ring, sum(stop - start) AS len FROM f GROUP BY ring),
i AS (SELECT cell, ring, sum(n) AS n, count(DISTINCT seg) AS hit FROM frags g JOIN k ON k.chrom = g.chrom AND g.start < k.stop AND k.start < g.stop AND k.start < k.stop GROUP BY ALL),
o AS (SELECT cell, ring, sum(n) AS n FROM frags g JOIN f ON f.chrom = g.chrom AND g.start < f.stop AND f.start < g.stop GROUP BY ALL),
t AS (SELECT cell, sum(n) AS total FROM frags GROUP BY cell),
r AS (SELECT i.cell, i.ring, i.n * 1e9 / (total * z.len) AS rate, coalesce(coalesce(o.n, 0) * 1e9 / nullif(total * coalesce(y.len, 0), 0), 0) AS around, hit * 1.0 / z.k AS covered FROM i JOIN t USING (cell) JOIN z USING (ring) LEFT JOIN o ON o.cell = i.cell AND o.ring = i.ring LEFT JOIN y ON y.ring = i.ring)"""


@query("cell_coverage", "frags", "segments", also=FEATURES, sql="SELECT cell, ring, round(rate, 5) AS rate, round(ln(1 + rate) - ln(1 + around), 5) AS enrichment, round(covered, 6) AS covered FROM r")
def _(frags, segments):
    rings = segments.select(F.col("chrom").alias("ring"), F.col("seg").alias("idx"), "seg", "chrom", "start", "stop")
    totals = frags.groupBy("cell").agg(F.sum("n").alias("total"))
    out = cells.cell_features(frags, rings.drop("idx"), cells.flanks(rings), totals)
    return out.select("cell", "ring", F.round("rate", 5).alias("rate"), F.round("enrichment", 5).alias("enrichment"), F.round("covered", 6).alias("covered"))


KNOWN = BINS + """,
k AS (SELECT DISTINCT chrom, start, stop FROM segments),
w AS (SELECT k.chrom, k.start, k.stop, sum((least(k.stop, b.coord + 10000) - greatest(k.start, b.coord)) * b.cn) / sum(least(k.stop, b.coord + 10000) - greatest(k.start, b.coord)) AS cn FROM k JOIN bins b ON b.chrom = k.chrom AND b.coord < k.stop AND k.start < b.coord + 10000 WHERE k.start < k.stop GROUP BY ALL)"""


@query("called_or_known", "segments", "reads", "sites", also=KNOWN, sql="SELECT k.chrom, k.start, k.stop, round(coalesce(w.cn, 2), 6) AS cn, coalesce((SELECT sum(n) FROM sites s WHERE s.chrom = k.chrom AND s.clip = 'L' AND abs(s.coord - k.start) <= 600), 0)::BIGINT AS clip_left, coalesce((SELECT sum(n) FROM sites s WHERE s.chrom = k.chrom AND s.clip = 'R' AND abs(s.coord - k.stop) <= 600), 0)::BIGINT AS clip_right FROM k LEFT JOIN w ON w.chrom = k.chrom AND w.start = k.start AND w.stop = k.stop")
def _(segments, df, sites):
    called = segments.where("cn > 100").select("chrom", "start", "stop", "cn", F.lit(0).cast("long").alias("clip_left"), F.lit(0).cast("long").alias("clip_right"))
    return singlecell.called_or_known(called, segments, bins_of(df), sites, reach=600).withColumns(r6("cn"))


READS_OF = """e AS (SELECT *, CASE WHEN (chrom1, coord1, clip1) <= (chrom2, coord2, clip2) THEN row(chrom1, coord1, clip1) ELSE row(chrom2, coord2, clip2) END AS lo, CASE WHEN (chrom1, coord1, clip1) <= (chrom2, coord2, clip2) THEN row(chrom2, coord2, clip2) ELSE row(chrom1, coord1, clip1) END AS hi FROM links)"""


@query("junction_reads", "links", also=READS_OF, sql="SELECT l.chrom1 AS ring, l.rid AS junction, r.rid::VARCHAR AS qname, r.bc::VARCHAR AS bc, CASE WHEN r.bc % 2 = 0 THEN 'cell' || r.rid ELSE r.bc::VARCHAR END AS cell FROM e l JOIN e r USING (lo, hi)")
def _(links):
    # each link is a known junction; the pairs carry the reads of their links
    links = stage(links.select("rid", "bc", *singlecell.ENDS), "links")
    junctions = links.select(F.col("chrom1").alias("ring"), F.col("rid").alias("junction"), *singlecell.ENDS)
    one = singlecell.canonical(links.select(*singlecell.ENDS, F.struct(F.col("rid").cast("string").alias("qname"), F.col("bc").cast("string").alias("bc")).alias("r")))
    pairs = one.groupBy(*singlecell.ENDS).agg(F.collect_list("r").alias("reads"))
    known = links.where("bc % 2 = 0").select(F.col("rid").cast("string").alias("qname"), F.concat(F.lit("cell"), F.col("rid").cast("string")).alias("cell"), F.col("bc").cast("string").alias("b2"))
    found = singlecell.junction_reads(junctions, pairs, known.select("qname", "cell").distinct())
    # a read's links may have several barcodes; the table names those of even ones
    return found.withColumn("cell", F.when(F.col("bc").cast("long") % 2 == 0, F.concat(F.lit("cell"), "qname")).otherwise(F.col("bc")))


@query("distinct_reads", "reads", sql="SELECT DISTINCT rid::VARCHAR AS qname, line % 2 AS flag, chrom, start FROM reads")
def _(df):
    rows = df.select(F.col("rid").cast("string").alias("qname"), (F.col("line") % 2).alias("flag"), "chrom", "start", "mapq")
    return singlecell.distinct_reads(rows).select("qname", "flag", "chrom", "start")


@query("gene_numbers", "rings", sql="SELECT ring, sum(CASE WHEN splits = 7 THEN 0 WHEN splits % 2 = 0 THEN 2 ELSE 1 END)::BIGINT AS gene_num FROM rings GROUP BY ring")
def _(rings):
    gene = F.when(F.col("splits") % 2 == 0, "a; b").when(F.col("splits") == 7, None).otherwise("")
    return singlecell.gene_numbers(rings.withColumn("gene", gene), ["gene"])


@query("gene_names", "documents", sql="SELECT doc_id, len(list_distinct(list_filter(list_transform(string_split(regexp_replace(coalesce(text, ''), '[,.]', ';', 'g'), ';'), lambda x: trim(x)), lambda x: x <> '')))::BIGINT AS names FROM documents")
def _(df):
    return df.select("doc_id", F.size(text.gene_list(F.coalesce(F.regexp_replace("text", "[,.]", ";"), F.lit("")))).cast("long").alias("names"))


# --- evidence of reads -----------------------------------------------------

ALIGNED = "a AS (SELECT rid, line, pk, sk, chrom, start, bc, nm, clip_l, clip_r, nm >= 2 AND NOT clip_l AND NOT clip_r AS gap, start + CASE WHEN clip_l AND clip_r THEN 60 WHEN clip_l OR clip_r THEN 80 WHEN nm >= 2 THEN 110 ELSE 100 END AS stop, lead(chrom) OVER w AS sa_chrom, lead(start) OVER w AS sa_pos FROM reads WINDOW w AS (PARTITION BY rid ORDER BY line, pk, sk, start)),\nj AS (SELECT rid || '/' || line || '/' || pk || '/' || sk AS junction, chrom AS c1, stop - 1 AS x1, 'R' AS k1, sa_chrom AS c2, sa_pos AS x2, 'L' AS k2 FROM a WHERE sa_chrom IS NOT NULL),\ne AS (SELECT junction, c1 AS chrom, x1 AS coord, k1 AS side, c2 AS oc, x2 AS ox FROM j UNION ALL SELECT junction, c2, x2, k2, c1, x1 FROM j),\nclips AS (SELECT *, start AS at, 'L' AS clip FROM a WHERE clip_l UNION ALL SELECT *, stop - 1, 'R' FROM a WHERE clip_r),\nparts AS (SELECT rid, bc, chrom, start AS p0, CASE WHEN gap THEN start + 50 ELSE stop END AS p1 FROM a WHERE {clean} UNION ALL SELECT rid, bc, chrom, start + 60, stop FROM a WHERE gap AND {clean}),\nh AS (SELECT junction, rid, bc, CASE WHEN clip_r AND sa_chrom = oc AND (abs(sa_pos - ox) <= 200 OR abs(sa_pos + 79 - ox) <= 200) THEN 0 ELSE 1 END AS k FROM e JOIN clips c ON c.chrom = e.chrom AND c.clip = e.side AND abs(c.at - e.coord) <= 5 UNION ALL SELECT junction, rid, bc, 2 FROM e JOIN parts p ON p.chrom = e.chrom AND p.p0 <= e.coord - 5 AND p.p1 > e.coord + 5),\nv AS (SELECT junction, rid, min(bc::VARCHAR) AS bc, min(k) AS k FROM h GROUP BY ALL)"
STRICT_SQL, LOOSE_SQL = ALIGNED.format(clean="NOT clip_l AND NOT clip_r AND nm <= 1"), ALIGNED.format(clean="true")


def read_alignments(df):
    """The test reads as alignments, and the junctions between neighbours of an order. Clips are 20 letters; a read without one and two edits has a deletion; one clipped at its end has a second alignment, that of the next read."""
    w = Window.partitionBy("rid").orderBy("line", "pk", "sk", "start")
    cigar = F.when(F.col("clip_l") & F.col("clip_r"), "20S60M20S").when(F.col("clip_l"), "20S80M").when(F.col("clip_r"), "80M20S").when(F.col("nm") >= 2, "50M10D50M").otherwise("100M")
    rows = df.withColumns({"_c": F.lead("chrom").over(w), "_p": F.lead("start").over(w), "cigar": cigar}).withColumn("stop", F.col("start") + text.cigar_length(F.col("cigar")))
    rows = stage(rows.select("rid", "line", "pk", "sk", "chrom", "start", "stop", "cigar", "nm", "clip_r", "bc", "_c", "_p"), "alignments")
    sa = F.when(F.col("clip_r") & F.col("_c").isNotNull(), F.concat_ws(",", "_c", (F.col("_p") + 1).cast("string"), F.lit("+"), F.lit("20S80M"), F.lit("60"), F.lit("0;")))
    junctions = rows.where("_c is not null").select(F.concat_ws("/", "rid", "line", "pk", "sk").alias("junction"), F.col("chrom").alias("chrom1"), (F.col("stop") - 1).alias("coord1"), F.lit("R").alias("clip1"), F.col("_c").alias("chrom2"), F.col("_p").alias("coord2"), F.lit("L").alias("clip2"))
    return rows.select(F.col("rid").cast("string").alias("qname"), "chrom", "start", "stop", "cigar", "nm", sa.alias("sa"), F.col("bc").cast("string").alias("cb")), junctions


@query("junction_evidence", "reads", also=STRICT_SQL, sql="SELECT junction, rid::VARCHAR AS qname, bc::VARCHAR AS bc, ['split_SA', 'single_clip', 'normal_spanning'][k + 1] AS kind FROM v")
def _(df):
    return evidence.junction_evidence(*read_alignments(df))


@query("junction_evidence_loose", "reads", also=LOOSE_SQL, sql="SELECT k, count(*) AS reads, count(DISTINCT junction) AS junctions FROM v GROUP BY k")
def _(df):
    found = evidence.kinds_shown(*read_alignments(df), strict=False)
    rank = F.when(F.col("kind") == "split_SA", 0).when(F.col("kind") == "single_clip", 1).otherwise(2)
    return found.select(rank.alias("k"), "reads", "junctions")


@query("evidence_matrix", "reads", also=STRICT_SQL, sql="SELECT junction, bc::VARCHAR AS cell, count(*) FILTER (k = 0) AS \"split_SA\", count(*) FILTER (k = 1) AS single_clip, count(*) FILTER (k = 2) AS normal_spanning FROM v GROUP BY ALL")
def _(df):
    return evidence.junction_matrix(*read_alignments(df))


CALLS = """seg AS (SELECT brand AS ring, gid AS seg, chrom, start, stop FROM genes WHERE start < stop),
fl AS (SELECT ring, seg, chrom, greatest(0, start - (stop - start)) AS start, start AS stop FROM seg UNION ALL SELECT ring, seg, chrom, stop, stop + (stop - start) FROM seg),
flank AS (SELECT * FROM fl WHERE start < stop),
fr AS (SELECT cell % 50 AS cell, chrom, start, stop, n FROM frags),
ct AS (SELECT cell, sum(n)::BIGINT AS total FROM fr GROUP BY cell),
sz AS (SELECT ring, sum(stop - start) AS len, count(*) AS k FROM seg GROUP BY ring),
oz AS (SELECT ring, sum(stop - start) AS len FROM flank GROUP BY ring),
ins AS (SELECT cell, ring, sum(n) AS n, count(DISTINCT seg) AS hit FROM fr JOIN seg s ON s.chrom = fr.chrom AND s.start < fr.stop AND fr.start < s.stop GROUP BY ALL),
ous AS (SELECT cell, ring, sum(n) AS n FROM fr JOIN flank s ON s.chrom = fr.chrom AND s.start < fr.stop AND fr.start < s.stop GROUP BY ALL),
feat AS (SELECT ct.cell, sz.ring, coalesce(ins.n, 0) * 1e9 / (total * sz.len) AS rate, coalesce(ous.n, 0) * 1e9 / (total * oz.len) AS around, coalesce(hit, 0) / sz.k AS covered
  FROM ct CROSS JOIN sz LEFT JOIN ins ON ins.cell = ct.cell AND ins.ring = sz.ring LEFT JOIN ous ON ous.cell = ct.cell AND ous.ring = sz.ring LEFT JOIN oz ON oz.ring = sz.ring),
ev AS (SELECT s.ring, r.bc AS cell, r.rid, max(CASE WHEN clip_l AND clip_r THEN 1 ELSE 0 END) AS d, max(CASE WHEN clip_l AND clip_r THEN 0 ELSE 0.3 END) AS w
  FROM reads r JOIN seg s ON s.chrom = r.chrom AND s.start < r.stop AND r.start < s.stop WHERE clip_l OR clip_r GROUP BY ALL),
seen AS (SELECT ring, cell, sum(d)::BIGINT AS direct, sum(CASE WHEN d = 0 THEN w ELSE 0 END) AS weak FROM ev GROUP BY ALL),
cn AS (SELECT cell, ring, seg, sum(n)::DOUBLE AS n FROM fr JOIN seg s ON s.chrom = fr.chrom AND s.start < fr.stop AND fr.start < s.stop GROUP BY ALL),
tot AS (SELECT cell, ring, sum(n) AS t, sqrt(sum(n * n)) AS c FROM cn GROUP BY ALL),
sure AS (SELECT tot.* FROM tot JOIN seen USING (cell, ring) WHERE direct >= 1 AND t > 0),
anchor AS (SELECT ring, seg, sum(n / t) / (SELECT count(*) FROM sure x WHERE x.ring = cn.ring) AS a FROM cn JOIN sure USING (cell, ring) GROUP BY ring, seg),
ln AS (SELECT ring, sqrt(sum(a * a)) AS s FROM anchor GROUP BY ring),
dot AS (SELECT cell, ring, sum(n * a) AS d FROM cn JOIN anchor USING (ring, seg) GROUP BY ALL),
cosine AS (SELECT cell, ring, coalesce(d / (c * s), 0) AS cosine FROM tot LEFT JOIN dot USING (cell, ring) LEFT JOIN ln USING (ring)),
q AS (SELECT ring, quantile_cont(rate, 0.25) AS q1 FROM feat JOIN seen USING (cell, ring) WHERE direct >= 1 GROUP BY ring)"""


MERGED = """f AS (SELECT chrom1, cast(floor(coord1 / 2500000.0) as bigint) AS coord1, clip1, chrom2, cast(floor(coord2 / 2500000.0) as bigint) AS coord2, clip2, CASE WHEN bc % 3 = 0 THEN 0 ELSE 1 END AS p, CASE WHEN rid % 5 > 0 THEN rid END AS rid, CASE WHEN bc % 4 > 0 THEN bc::VARCHAR END AS bc, rid % 11 = 0 AS pe FROM links),
g AS (SELECT *, CASE WHEN (chrom1, coord1, clip1) <= (chrom2, coord2, clip2) THEN row(chrom1, coord1, clip1) ELSE row(chrom2, coord2, clip2) END AS a, CASE WHEN (chrom1, coord1, clip1) <= (chrom2, coord2, clip2) THEN row(chrom2, coord2, clip2) ELSE row(chrom1, coord1, clip1) END AS b FROM f),
rw AS (SELECT a, b, chrom1, p, count(*) AS n, bool_or(pe) AS pe FROM g GROUP BY a, b, chrom1, coord1, clip1, chrom2, coord2, clip2, p),
rr AS (SELECT a, b, rid, arg_min(bc, (p, -n, bc)) FILTER (bc IS NOT NULL) AS bc FROM (SELECT g.a, g.b, g.p, g.rid, g.bc, w.n FROM g JOIN (SELECT a, b, chrom1, coord1, clip1, chrom2, coord2, clip2, p, count(*) AS n FROM g GROUP BY ALL) w USING (a, b, chrom1, coord1, clip1, chrom2, coord2, clip2, p)) x WHERE rid IS NOT NULL GROUP BY a, b, rid),
rl AS (SELECT a, b, count(*) AS k, count(bc) AS bcs, string_agg(rid || ':' || coalesce(bc, '-'), ',' ORDER BY rid) AS reads FROM rr GROUP BY a, b),
t AS (SELECT a, b, sum(n)::BIGINT AS n, bool_or(pe) AS pe, min(p) AS p FROM rw GROUP BY a, b)"""


def evidence_sources(links):
    """Links in two sources, each pair of cells with its reads; some reads have no name, some no barcode."""
    cell = lambda c: F.floor(F.col(c) / 2500000)
    rows = links.withColumns({"coord1": cell("coord1"), "coord2": cell("coord2"), "p": F.when(F.col("bc") % 3 == 0, 0).otherwise(1)})
    read = F.struct(F.when(F.col("rid") % 5 > 0, F.col("rid")).alias("rid"), F.when(F.col("bc") % 4 > 0, F.col("bc").cast("string")).alias("bc"))
    held = rows.groupBy(*breakpoints.PAIR, "p").agg(F.count("*").alias("n"), F.bool_or(F.col("rid") % 11 == 0).alias("pe"), F.collect_list(read).alias("reads")).withColumns({"offset": F.lit(0), "seq": F.lit(""), "source": F.concat(F.lit("s"), "p")})
    return [held.where(F.col("p") == k).drop("p") for k in (0, 1)]


@query("merged_pairs", "links", also=MERGED, sql="SELECT a[1] AS chrom1, a[2] AS coord1, a[3] AS clip1, b[1] AS chrom2, b[2] AS coord2, b[3] AS clip2, coalesce(k, t.n) AS n, pe, 's' || p AS source, coalesce(reads, '') AS reads, CASE WHEN coalesce(bcs, 0) > 0 THEN k ELSE 0 END AS barcodes FROM t LEFT JOIN rl USING (a, b)")
def _(links):
    """Evidence of two sources as one: each read once, with its first barcode."""
    out = breakpoints.merge_pairs(*evidence_sources(links))
    said = F.array_join(F.transform("reads", lambda r: F.concat(r["rid"].cast("string"), F.lit(":"), F.coalesce(r["bc"], F.lit("-")))), ",")
    return out.select(*breakpoints.PAIR, "n", "pe", "source", said.alias("reads"), F.size(breakpoints.barcodes_of(F.col("reads"))).cast("long").alias("barcodes"))


PAIRED = """im AS (SELECT chrom, start, stop, rid::VARCHAR AS qname FROM reads WHERE NOT dup),
st AS (SELECT DISTINCT chrom, coord, clip, CASE WHEN clip = 'L' THEN coord ELSE greatest(coord - 100000, 0) END AS lo, CASE WHEN clip = 'L' THEN coord + 100000 ELSE coord END AS hi FROM sites WHERE n >= 2),
mt AS (SELECT s.*, qname FROM st s JOIN im i ON i.chrom = s.chrom AND i.start < s.hi AND s.lo < i.stop AND s.lo < s.hi),
mk AS (SELECT * FROM mt WHERE (chrom, coord, clip) IN (SELECT (chrom, coord, clip) FROM mt GROUP BY chrom, coord, clip HAVING count(*) >= 2)),
ot AS (SELECT DISTINCT chrom, coord, clip, qname FROM mk)"""


@query("paired_ends", "sites", "reads", also=PAIRED, sql="SELECT a.chrom AS chrom1, a.coord AS coord1, a.clip AS clip1, b.chrom AS chrom2, b.coord AS coord2, b.clip AS clip2, count(*) AS n, count(DISTINCT a.qname) AS names FROM mk a JOIN ot b ON a.qname = b.qname AND (a.chrom, a.coord, a.clip) < (b.chrom, b.coord, b.clip) AND (a.chrom <> b.chrom OR abs(a.coord - b.coord) >= 100000) GROUP BY a.chrom, a.coord, a.clip, b.chrom, b.coord, b.clip HAVING count(*) >= 2")
def _(sites, df):
    """Sites that share reads of no proper pair in the 100 kb inside them."""
    reads = df.where("not dup").select("chrom", "start", "stop", F.col("rid").cast("string").alias("qname"), F.col("bc").cast("string").alias("cb"), F.lit(1).alias("flag"))
    out = breakpoints.paired_ends(sites.where("n >= 2"), reads, 100_000)
    return out.select(*breakpoints.PAIR, "n", F.array_size(F.array_distinct(F.transform("reads", lambda r: r["rid"]))).cast("long").alias("names"))


DRAWN = """sz AS (SELECT chrom, max(stop)::BIGINT AS length FROM reads GROUP BY chrom),
bs AS (SELECT *, sum(length) OVER (ORDER BY chrom) - length AS before, sum(length) OVER () AS total FROM sz),
dr AS (SELECT i, ('0x' || substr(md5('7:' || i), 1, 12))::BIGINT / 281474976710656.0 AS u FROM range(2000) r(i)),
pl AS (SELECT i, chrom, floor(u * total)::BIGINT - before AS start, length FROM dr JOIN bs ON floor(u * total) >= before AND floor(u * total) < before + length),
ok AS (SELECT i, chrom, start, start + 20000 AS stop FROM pl p WHERE start >= 20000 AND start + 20000 <= length AND NOT EXISTS (SELECT 1 FROM genes g WHERE g.kind = 'PROMO' AND g.start < g.stop AND g.chrom = p.chrom AND g.start < p.start + 40000 AND p.start - 20000 < g.stop)),
w AS (SELECT DISTINCT chrom, start, stop FROM (SELECT * FROM ok ORDER BY i LIMIT 500) x)"""
SAMPLED = DRAWN + """,
rd AS (SELECT chrom, start, stop, 100 + nm AS length, CASE WHEN dup THEN 16 ELSE 2 END AS flag, pk % 700 - 100 AS tlen FROM reads),
met AS (SELECT w.chrom, w.start, rd.length, CASE WHEN (flag & 2) <> 0 AND tlen > 0 THEN tlen END AS ins FROM w JOIN rd ON rd.chrom = w.chrom AND rd.start < w.stop AND w.start < rd.stop),
wd AS (SELECT count(*) / 20001.0 AS d FROM met GROUP BY chrom, start),
md AS (SELECT list_sort(list(d))[cast(floor(count(*) / 2.0) as bigint) + 1] AS m FROM wd),
st AS (SELECT max(m) AS median, avg(d) AS mean, stddev_pop(d) AS sd, count(*) AS windows FROM wd, md WHERE d > 0 AND d < 5 * m),
fl AS (SELECT avg(length) AS read_length, avg(ins) AS insert_size, stddev_pop(ins) AS insert_sd, 2.0 * count(ins) / count(*) AS proper FROM met)"""


def sampled_windows(df, genes):
    return coverage.draw_windows(df.groupBy("chrom").agg(F.max("stop").alias("length")), 500, 20_000, 7, listed(genes))


@query("sampled_windows", "reads", "genes", also=DRAWN, sql="SELECT chrom, start, stop FROM w")
def _(df, genes):
    """Windows drawn by a seed from the span of the reads, away from listed regions."""
    return sampled_windows(df, genes)


@query("sampled_coverage", "reads", "genes", also=SAMPLED, sql="SELECT round(read_length, 4) AS read_length, round(insert_size, 4) AS insert_size, round(insert_sd, 4) AS insert_sd, round(proper, 4) AS proper, round(median * read_length, 4) AS median, round(mean * read_length, 4) AS mean, round(sd * read_length, 4) AS sd, windows, round(least(0.4, 0.01 / (median * read_length)), 4) AS keep FROM st, fl")
def _(df, genes):
    """Lengths, inserts and depth over the drawn windows, and the share of reads to keep of a file that is too large."""
    rows = df.select("chrom", "start", "stop", (100 + F.col("nm")).alias("length"), F.when(F.col("dup"), 16).otherwise(2).alias("flag"), (F.col("pk") % 700 - 100).alias("tlen"))
    stats = coverage.thinning(coverage.sampled_coverage(rows, sampled_windows(df, genes), 20_000), 80.0, target=0.01)
    return stats.select(*[F.round(c, 4).alias(c) for c in ("read_length", "insert_size", "insert_sd", "proper", "median", "mean", "sd", "keep")], "windows")


@query("assigned_cells", "frags", "genes", "reads", also=CALLS, sql="SELECT cell, ring, coalesce(direct, 0) AS direct, round(coalesce(weak, 0), 4) AS weak, round(rate, 4) AS rate, round(ln(1 + rate) - ln(1 + around), 4) AS enrichment, round(covered, 4) AS covered, round(coalesce(cosine, 0), 4) AS cosine, CASE WHEN coalesce(direct, 0) >= 1 THEN 'high' WHEN coalesce(weak, 0) >= 0.3 THEN 'probable' WHEN rate >= q1 AND ln(1 + rate) - ln(1 + around) >= 2 AND coalesce(cosine, 0) >= 0.96 AND covered >= 1 THEN 'probable' ELSE 'none' END AS call FROM feat LEFT JOIN seen USING (cell, ring) LEFT JOIN cosine USING (cell, ring) LEFT JOIN q USING (ring)")
def _(frags, genes, df):
    """Calls of every cell with every ring from fragments and reads: the segments of one brand are a ring, reads clipped on both sides its split reads."""
    segments = genes.select(F.col("brand").alias("ring"), F.col("gid").alias("seg"), "chrom", "start", "stop").where("start < stop")
    n = F.col("stop") - F.col("start")
    flank = segments.withColumns({"stop": F.col("start"), "start": F.greatest(F.lit(0), F.col("start") - n)}).unionByName(segments.withColumns({"start": F.col("stop"), "stop": F.col("stop") + n})).where("start < stop")
    own = frags.withColumn("cell", F.col("cell") % 50)
    clipped = df.where("clip_l or clip_r").select("chrom", "start", "stop", F.col("bc").alias("cell"), F.col("rid").alias("qname"), F.when(F.col("clip_l") & F.col("clip_r"), "split_SA").otherwise("single_clip").alias("kind"))
    seen = intervals.overlap_join(clipped, intervals.covered(segments, ["ring"])).select(F.col("r_ring").alias("ring"), "cell", "qname", "kind")
    out = evidence.assign_cells(own, segments, flank, own.groupBy("cell").agg(F.sum("n").alias("total")), seen)
    return out.select("cell", "ring", "direct", "call", *[F.round(c, 4).alias(c) for c in ("weak", "rate", "enrichment", "covered", "cosine")])


# --- embeddings ------------------------------------------------------------

CORR = "p AS (SELECT vec_id AS id, embedding::DOUBLE[] AS vec FROM embeddings),\nx AS (SELECT id, unnest(vec) AS v, generate_subscripts(vec, 1) AS i FROM p),\nd AS (SELECT a.id AS q, b.id, 1 - corr(a.v, b.v) AS d FROM x a JOIN x b ON a.i = b.i AND a.id <> b.id WHERE a.id % 100 = 0 GROUP BY ALL),\nk AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(d, 9), id) AS rank FROM d)"


@query("correlation_knn", "embeddings", also=CORR.replace(" WHERE a.id % 100 = 0", ""), sql="SELECT q, id, round(d, 5) AS d, rank FROM k WHERE rank <= 10")
def _(df):
    p = df.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"))
    return velocity.nearest(p, p, metric="correlation").select("q", "id", F.round("d", 5).alias("d"), F.col("rank").cast("long").alias("rank"))


@query("rank_projection", "embeddings", also=CORR, sql="SELECT a, b, CASE WHEN a = b THEN 0 ELSE round(corr(rd, rv), 5) END AS r FROM (SELECT a, b, rank() OVER (PARTITION BY a, b ORDER BY d) + (count(*) OVER (PARTITION BY a, b, d) - 1) / 2.0 AS rd, rank() OVER (PARTITION BY a, b ORDER BY v) + (count(*) OVER (PARTITION BY a, b, v) - 1) / 2.0 AS rv FROM (SELECT a.id AS a, b.id AS b, y.v - x.v AS d, z.v AS v FROM p a JOIN p b ON a.id % 100 = 0 JOIN x x ON x.id = a.id AND x.i <= 32 JOIN x y ON y.id = b.id AND y.i = x.i JOIN x z ON z.id = a.id AND z.i = x.i + 32) s) t GROUP BY a, b")
def _(df):
    """Every hundredth vector against all: how its ranked velocity goes with the ranked way to each."""
    p = df.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"))
    state = p.select("id", F.slice("vec", 1, 32).alias("e"), F.slice("vec", 33, 32).alias("v"))
    return velocity.rank_correlation(state.where("id % 100 = 0"), state).withColumn("r", F.round("r", 5))


# --- sequences of junctions ------------------------------------------------


@query("clip_support", "reads")
def _(df):
    """Clips of a read's two halves against the consensus behind sites: reads with a letter for each place, so that what belongs together matches."""
    letters = F.array(*map(F.lit, "ACGT"))
    seq = lambda start, n: F.array_join(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.element_at(letters, (F.pmod(F.xxhash64(start + i), F.lit(4)) + 1).cast("int"))), "")
    near = df.where("mapq >= 20").select("chrom", "rid", "line", F.col("bc").cast("string").alias("cb"), (F.floor(F.col("start") / 20000) * 20000).alias("at"))
    # what is spelled depends on the place alone, so it is spelled once for each
    spelled = stage(near.select("at").distinct().select("at", F.concat(seq(F.col("at") + 9_980, 20), seq(F.col("at"), 50)).alias("l"), F.concat(seq(F.col("at") + 9_950, 50), seq(F.col("at"), 20)).alias("r")), "spelled")
    near = near.join(spelled, "at")
    left = near.select("chrom", F.col("at").alias("start"), (F.col("at") + 50).alias("stop"), F.concat("rid", F.lit("l"), "line").alias("qname"), "cb", F.lit("20S50M").alias("cigar"), F.col("l").alias("seq"))
    right = near.select("chrom", (F.col("at") + 9_950).alias("start"), (F.col("at") + 10_000).alias("stop"), F.concat("rid", F.lit("r"), "line").alias("qname"), "cb", F.lit("50M20S").alias("cigar"), F.col("r").alias("seq"))
    reads = left.unionByName(right)
    places = near.select("chrom", "at").distinct()
    pairs = places.select(F.col("chrom").alias("chrom1"), F.col("at").alias("coord1"), F.lit("L").alias("clip1"), F.col("chrom").alias("chrom2"), (F.col("at") + 9_999).alias("coord2"), F.lit("R").alias("clip2"), F.lit(0).alias("offset"), F.lit(0).cast("long").alias("n"))
    sites = pairs.select(F.col("chrom1").alias("chrom"), F.col("coord1").alias("coord"), F.col("clip1").alias("clip")).union(pairs.select("chrom2", "coord2", "clip2"))
    joined = splitreads.joined_support(pairs, splitreads.soft_clips(reads), splitreads.breakend_consensus(sites, reads, 50))
    return splitreads.assembled(joined).select("chrom1", "coord1", "coord2", "n12", "n21", "n")


def junction_reads(genes):
    """Reads clipped at both ends of a junction for each gene: every orientation, letters between the ends or claimed by both, and a wrong letter in each thirtieth place."""
    gid, ends = F.col("gid"), F.array(*[F.struct(F.lit(e).alias("e"), F.lit(c).alias("c")) for e, c in ((1, "coord1"), (2, "coord2"))])
    sides = F.array(*[F.lit(s) for s in ("LR", "RL", "LL", "RR")])
    first = F.col("start") + 1000 + F.floor(gid / 840) * 300
    rows = genes.select("gid", "chrom", first.alias("coord1"), (first + F.col("stop") - F.col("start") + 500).alias("coord2"), F.element_at(sides, (gid % 4 + 1).cast("int")).alias("sides"), (gid % 7 - 3).cast("int").alias("o"))
    rows = rows.withColumns({"clip1": F.substring("sides", 1, 1), "clip2": F.substring("sides", 2, 1), "turn": F.substring("sides", 1, 1) == F.substring("sides", 2, 1)}).withColumn("end", F.explode(ends)).select("*", "end.e")
    rows = rows.withColumn("r", F.explode(F.sequence(F.lit(0).cast("long"), 2 + F.pmod(F.xxhash64("gid", "e"), F.lit(4))))).withColumn("clipped", (8 + F.pmod(F.xxhash64("gid", "e", "r"), F.lit(20))).cast("int"))
    pick = lambda *parts: F.pmod(F.xxhash64(*parts), F.lit(4))  # noqa: E731  (letters are numbers up to the end: 3 - x is the complement of x)
    turned = lambda x: F.when(F.col("turn"), 3 - x).otherwise(x)
    o = F.col("o")
    inside1 = lambda k: pick(gid, F.lit(1), k)
    inside2 = lambda k: F.when(k < -o, turned(inside1(-o - 1 - k))).otherwise(pick(gid, F.lit(2), k))
    beyond1 = lambda k: F.when(k < o, pick(gid, F.lit(9), k)).otherwise(turned(inside2(k - o)))
    beyond2 = lambda k: F.when(k < o, turned(pick(gid, F.lit(9), o - 1 - k))).otherwise(turned(inside1(k - o)))
    one = F.col("e") == 1
    wrong = lambda x, p: F.when(F.pmod(F.xxhash64("gid", "e", "r", p), F.lit(30)) == 0, F.pmod(x + 1, F.lit(4))).otherwise(x)
    letter = lambda x: F.element_at(F.array(*map(F.lit, "ACGT")), (x + 1).cast("int"))
    text_of = lambda n, f: F.array_join(F.transform(F.sequence(F.lit(0), n - 1), f), "")
    rows = rows.withColumns({
        "inner": text_of(F.lit(50), lambda k: letter(wrong(F.when(one, inside1(k)).otherwise(inside2(k)), k))),
        "outer": text_of(F.col("clipped"), lambda k: letter(wrong(F.when(one, beyond1(k)).otherwise(beyond2(k)), k + 100))),
        "coord": F.when(one, F.col("coord1")).otherwise(F.col("coord2")), "clip": F.when(one, F.col("clip1")).otherwise(F.col("clip2")),
    })
    left = F.col("clip") == "L"
    return rows.select(
        "chrom", F.when(left, F.col("coord")).otherwise(F.col("coord") - 49).alias("start"), F.when(left, F.col("coord") + 50).otherwise(F.col("coord") + 1).alias("stop"), "coord", "clip", F.concat_ws("/", "gid", "e", "r").alias("qname"), F.lit(None).cast("string").alias("cb"),
        F.when(left, F.concat("clipped", F.lit("S50M"))).otherwise(F.concat(F.lit("50M"), "clipped", F.lit("S"))).alias("cigar"), F.when(left, F.concat(F.reverse("outer"), "inner")).otherwise(F.concat(F.reverse("inner"), "outer")).alias("seq"),
    )


@query("sequence_pairs", "genes")
def _(genes):
    """Pairs of ends found by sequence alone, among all ends of the genes' junctions."""
    reads = stage(junction_reads(genes), "reads")
    found = pairing.pairs_by_sequence(reads.select("chrom", "coord", "clip"), reads, reads.limit(0).select(*[F.col(c).alias(f"{c}{k}") for k in (1, 2) for c in ("chrom", "coord", "clip")]))
    return found.select(*pairing.PAIR, "n", "offset", "seq", F.size("reads").alias("names"))


@query("junction_alignments", "genes")
def _(genes):
    """Pictures of the genes' junctions with their reads."""
    reads = stage(junction_reads(genes), "reads")
    sites = reads.select("chrom", "coord", "clip")
    pairs = pairing.match(pairing.seeded(pairing.assemble(sites, reads)))
    drawn = pairing.junction_alignments(pairs, reads, 50)
    return drawn.select(*pairing.PAIR, F.array_join("lines", "\n").alias("lines"))


def catalog_query(name: str):
    """A registered query."""
    return QUERIES[name]
