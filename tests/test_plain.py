"""Queries that SQL doesn't express, against plain Python on their whole tables."""

import collections
import math
import pathlib
import os
import re
import zlib

import numpy as np
import pytest

from circlet.operators import segmentation
from circlet.plans import catalog, more  # noqa: F401
from circlet.plans.adapters import load

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def data(spark):
    known = {}

    def get(name):
        if name not in known:
            known[name] = (catalog.QUERIES[name](spark, SF) if name in catalog.QUERIES else load(spark, SF, name)).toPandas()
        return known[name]

    return get


def same(got, want, digits=5):
    """Rows equal, numbers nearly."""
    show = lambda rows: sorted([tuple(round(float(x), digits) + 0.0 if isinstance(x, (float, np.floating)) else x for x in r) for r in rows], key=repr)
    a, b = show(got), show(want)
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert x == y or all(u == v or isinstance(u, float) and math.isclose(u, v, rel_tol=1e-4, abs_tol=2 * 10**-digits) for u, v in zip(x, y)), (x, y)


def rows(frame, *columns):
    return [tuple(r) for r in frame[list(columns)].itertuples(index=False, name=None)]


def test_covered():
    """Every query without SQL has a test in one of these files."""
    here = "".join(f.read_text() for f in pathlib.Path(__file__).parent.glob("test_*.py"))
    assert [n for n in catalog.QUERIES if n not in catalog.ORACLE_SQL and f'"{n}"' not in here] == []


def test_downsample(data):
    want = [r for r in rows(data("reads"), "rid", "line", "chrom", "start") if zlib.crc32(str(r[0]).encode()) < int(0.4 * 2**32)]
    same(rows(data("downsample_crc32"), "rid", "line", "chrom", "start"), want)


def test_repeats(data):
    share = lambda s: sum(len(m[0]) for m in re.finditer(r"(.+?)\1+", s) if len(m[0]) >= 4) / len(s) if s else 0.0
    same(rows(data("short_repeat_filter"), "doc_id", "piece", "share"), [(i, k, share(a or "")) for i, k, a in rows(data("strings"), "doc_id", "piece", "a")])


def semi_global(x, y):
    if x is None or y is None:
        return None
    last = list(range(len(y) + 1))
    for i, c in enumerate(x, 1):
        now = [i]
        for j, d in enumerate(y, 1):
            now.append(min(last[j] + 1, now[-1] + 1, last[j - 1] + (c != d)))
        last = now
    return min(last) / len(x) if x else 0.0


def test_semi_global(data):
    some = [r for r in rows(data("strings"), "doc_id", "piece", "a", "b")]
    got = {(i, k): d for i, k, d in rows(data("semi_global_distance"), "doc_id", "piece", "d")}
    assert len(got) == len(some)
    for i, k, a, b in some[::5]:
        want = semi_global(b, a)
        assert want is None and math.isnan(got[i, k]) or abs(got[i, k] - want) < 1e-5


def test_common_substring(data):
    def longest(a, b):
        best, last = (0, 0, 0), [0] * (len(b) + 1)  # -size, then the first place in a, then in b
        for i, c in enumerate(a):
            now = [0]
            for j, d in enumerate(b):
                n = last[j] + 1 if c == d else 0
                now.append(n)
                if n:
                    best = min(best, (-n, i - n + 1, j - n + 1))
            last = now
        return best[1], best[2], -best[0]

    got = {(r[0], r[1]): r[2:] for r in rows(data("common_substring"), "doc_id", "piece", "a_at", "b_at", "size")}
    for i, k, a, b in rows(data("strings"), "doc_id", "piece", "a", "b")[::5]:
        assert got[i, k] == longest(a or "", b or "")


def test_fuzzy_find(data):
    def find(x, y):
        if not x or not y:
            return -1
        return next((i for i in range(len(y) - len(x) + 1) if sum(u != v for u, v in zip(x, y[i:])) <= 0.1 * len(x)), -1)

    want = [(i, k, c, find((b or "")[20 * c : 20 * c + 20], a)) for i, k, a, b in rows(data("strings"), "doc_id", "piece", "a", "b") for c in range(3)]
    same(rows(data("fuzzy_clip_match"), "doc_id", "piece", "clip", "at"), want)


def merged(spans):
    out = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b + 1) for a, b in out]


def test_circle_dedup(data):
    spans = collections.defaultdict(lambda: collections.defaultdict(list))
    for ring, chrom, a, b in rows(data("rings"), "ring", "chrom", "start", "stop"):
        spans[ring][chrom].append((a, b))
    spans = {r: {c: merged(x) for c, x in m.items()} for r, m in spans.items()}
    total = {r: sum(b - a for x in m.values() for a, b in x) for r, m in spans.items()}

    def overlap(r, s):
        both = sum(max(0, min(b, d) - max(a, c)) for k in spans[r].keys() & spans[s].keys() for a, b in spans[r][k] for c, d in spans[s][k])
        return both / max(total[r], total[s])

    scores = dict(rows(data("circle_dedup"), "ring", "score"))
    same(list(scores.items()), rows(data("circle_stats_score"), "ring", "score"), 4)
    chosen, want = [], []
    for ring in sorted(scores, key=lambda r: (-scores[r], r)):
        mine = next((c for c in chosen if overlap(ring, c) > 0.95), None)
        if mine is None:
            chosen.append(ring)
        want.append((ring, mine or ring, "chosen" if mine is None else "copy"))
    assert sorted(rows(data("circle_dedup"), "ring", "chosen", "role")) == sorted(want)


def bins_frame(data):
    return data("bin_cn").sort_values(["chrom", "coord"])


def test_cbs(data):
    want = []
    counts = {(c, x): n for c, x, n in rows(data("bin_cn"), "chrom", "coord", "n")}
    mean = np.mean(list(counts.values()))
    for chrom, part in bins_frame(data).groupby("chrom"):
        coord, n = part.coord.to_numpy(), part.n.to_numpy("f8")
        x = np.log2(2 * n / mean / 2)
        want += [(chrom, coord[a], coord[b - 1] + 10_000, b - a, n[a:b].mean(), x[a:b].mean()) for a, b in segmentation.cbs(x)]
    same(rows(data("cbs_segments"), "chrom", "start", "stop", "bins", "n", "x"), want)


def test_shuffles_are_those_of_the_seeds():
    """The test of a split, by shuffling the values themselves a thousand times."""
    rng = np.random.default_rng(3)
    for _ in range(60):
        x = rng.normal(0, 1, int(rng.integers(6, 60)))
        i = int(rng.integers(1, len(x) - 3))
        j = int(rng.integers(i + 2, len(x)))
        x[i:j] += rng.choice([0, 0.7, 1.2])
        for end in (j, None):
            s = np.cumsum(x)
            t = segmentation._t(s[i] if end is None else s[end] - s[i], s[-1], i + 1 if end is None else end - i, len(x))
            y, reached = x.copy(), 0
            for seed in range(1000):
                np.random.seed(seed)
                np.random.shuffle(y)
                s = np.cumsum(y)
                reached += segmentation._t(s[i] if end is None else s[end] - s[i], s[-1], i + 1 if end is None else end - i, len(x)) >= t
            assert segmentation._significant(x, float(t), i, end) == (t >= 1.5 and reached <= 10)


def test_glm(data):
    genes = data("genes")
    genes = genes.assign(coord=genes.start // 10_000 * 10_000, gc=genes.gid % 100 / 100, mappability=genes.gid % 37 / 37)
    bias = genes.groupby(["chrom", "coord"])[["gc", "mappability"]].mean().reset_index()
    x = data("bin_cn").merge(bias, on=["chrom", "coord"])
    a, n = np.column_stack([np.ones(len(x)), x.gc, x.mappability]), x.n.to_numpy("f8")
    beta = np.array([math.log(n.mean()), 0, 0])
    for _ in range(200):
        mu = np.exp(a @ beta)
        w = mu / (1 + mu)
        beta = np.linalg.solve((a * w[:, None]).T @ a, (a * w[:, None]).T @ (a @ beta + (n - mu) / mu))
    fitted = np.exp(a @ beta)
    norm = np.round(n / np.clip(fitted / np.median(fitted), 0.2, 5), 4) + 1
    grid = np.linspace(0, np.percentile(norm, 99), 500)
    h = norm.std(ddof=1) * len(norm) ** -0.2
    top = grid[np.exp(-0.5 * ((grid[:, None] - norm) / h) ** 2).sum(1).argmax()] or norm.mean()
    same(rows(data("glm_norm"), "chrom", "coord", "n", "n_norm", "cn"), list(zip(x.chrom, x.coord, x.n, norm, 2 * norm / top)), 3)


def test_threshold(data):
    """The level is one of the counts that pairs have, to half a bin, or one of the limits; the limits themselves are tested on small histograms in test_run.py."""
    counts = data("links").groupby(["chrom1", "chrom2", "bc"]).size()
    ((level,),) = rows(data("threshold_estimate"), "threshold")
    half = math.log(counts.max() / counts.min()) / 2000
    assert any(abs(math.log(level / x)) <= half + 1e-6 for x in {*counts, 3, 5, 20})


def test_rescue(data):
    cn = data("bin_cn")
    sites, segments = data("sites"), data("segments")
    want = []
    for chrom, part in sites.groupby("chrom"):
        held = [(a, b) for c, a, b in rows(segments, "chrom", "start", "stop") if c == chrom]
        free = [(c, k, n) for c, k, n in rows(part, "coord", "clip", "n") if not any(a <= c < b for a, b in held)]
        rights, own = sorted(c for c, k, _ in free if k == "R"), cn[cn.chrom == chrom]
        tries = []
        for a, k, n in free:
            if k == "L":
                for b in [r for r in rights if r >= a][:6]:
                    tries.append((a, b, n))
        # the candidates are the next five right ends by number, those at the same place counted before
        tries = [(a, b, n) for a, b, n in tries if b > a and rights.index(b) < sum(r <= a for r in rights) + 5]
        sound = [(a, b, n, own[(own.coord >= a) & (own.coord < b)].cn.median()) for a, b, n in tries]
        taken, done = [], set()
        for a, b, n, m in sorted((t for t in sound if t[3] >= 2.0), key=lambda t: (-t[2], t[0], t[1])):
            if a not in done and all(b <= x or a >= y for x, y in taken):
                taken.append((a, b))
                done.add(a)
                want.append((chrom, a, b, m))
    same(rows(data("rescue_segments"), "chrom", "start", "stop", "cn"), want, 4)


def test_plot_rows(data):
    want = []
    for chrom, part in data("genes").groupby("chrom"):
        ends = []
        for a, b, name in sorted(rows(part, "start", "stop", "name")):
            k = next((i for i, e in enumerate(ends) if e <= a), len(ends))
            ends[k : k + 1] = [b]
            want.append((chrom, a, b, name, k))
    same(rows(data("plot_rows"), "chrom", "start", "stop", "name", "row"), want)


def test_smooth_trimmed(data):
    mean, want = data("bin_cn").n.mean(), []
    for chrom, part in bins_frame(data).groupby("chrom"):
        x = np.log2(part.n.to_numpy("f8") / mean)
        for i, (coord, v) in enumerate(zip(part.coord, x)):
            near = [(x[j], 11 - abs(i - j)) for j in range(max(0, i - 10), min(len(x), i + 11)) if j != i]
            low, high = np.quantile([z for z, _ in near], [0.1, 0.9])
            near = [(z, w) for z, w in near if low <= z <= high]
            z = np.array([z for z, _ in near])
            odd = len(z) > 1 and abs(v - z.mean()) > 2 * z.std(ddof=1)
            want.append((chrom, coord, np.average(z, weights=[w for _, w in near]) if odd else v))
    same(rows(data("smooth_trimmed"), "chrom", "coord", "smooth"), want)


def pairs_of(data):
    return [r for r in rows(data("collapse_edges"), "chrom1", "coord1", "clip1", "chrom2", "coord2", "clip2", "n")]


def test_knn_segments(data):
    regions = [(c, a, b) for c, a, b in rows(data("merge_bed"), "chrom", "start", "stop")]
    pairs, want = [p for p in pairs_of(data) if p[0] == p[3]], set()
    for chrom, lo, hi in regions:
        inside = lambda x: lo <= x <= hi
        own = [p for p in pairs if p[0] == chrom and (inside(p[1]) or inside(p[4]))]
        across = [p for p in own if (p[2], p[5]) == ("R", "L")]
        for at, clip in {(x, k) for p in own for x, k in ((p[1], p[2]), (p[4], p[5])) if inside(x)}:
            if clip == "L":
                some = sorted((p for p in across if inside(p[1]) and p[1] > at), key=lambda p: (p[4], p[1]))[:3]
                there = [p[1] for p in some]
            else:
                some = sorted((p for p in across if inside(p[4]) and p[4] < at), key=lambda p: (-p[1], -p[4]))[:3]
                there = [p[4] for p in some]
            if some:
                n = [p[6] for p in some]
                best = n.index(max(n))
                for x in {there[best]} | ({there[0]} if 0 < (n[best] - n[0]) / n[best] <= 0.5 else set()):
                    want.add((chrom, at, x) if clip == "L" else (chrom, x, at))
    same(rows(data("knn_segments"), "chrom", "start", "stop"), list(want))


def test_snap_ds(data, spark):
    segments = [r for r in rows(data("segments"), "chrom", "start", "stop", "cn") if r[3] >= 1.0]
    rows_in = rows(more.ds_pairs(load_pairs(spark), load(spark, SF, "segments")).toPandas(), "chrom1", "coord1", "clip1", "chrom2", "coord2", "clip2", "n", "id")
    high = {(c, x): v for c, x, v in rows(data("bin_cn"), "chrom", "coord", "cn")}
    clips = {(c, x, k) for c, x, k in rows(data("sites"), "chrom", "coord", "clip") if k == "R"}
    parts = collections.defaultdict(list)  # by chromosome: [lo, hi, boundaries]
    for chrom, a, b, _ in sorted(segments):
        held = parts[chrom]
        if not held or a > held[-1][1] + 30_000:
            held.append([a, b, set()])
        held[-1][1] = max(held[-1][1], b)
        held[-1][2] |= {(a, "L"), (b, "R")}
    by_chrom = collections.defaultdict(list)
    for (c, x), v in high.items():
        by_chrom[c].append((x, v))
    want, moved = [], 0
    for c1, x1, k1, c2, x2, k2, n, _ in rows_in:
        found = []
        for moves, (ax, ak), (ox, ok) in ((2, (x1, k1), (x2, k2)), (1, (x2, k2), (x1, k1))):
            for lo, hi, edges in parts[c1]:
                if n >= 2 and (ax, ak) in edges and lo - 30_000 <= ox <= hi + 30_000 and (c1, ox, ok) not in clips:
                    near = sorted((abs(ox - x), x) for x, k in edges if k == ok and abs(ox - x) <= 30_000)
                    if near and (len(near) == 1 or near[0][0] < near[1][0]):
                        to = near[0][1]
                        between = [v for x, v in by_chrom[c1] if min(ax, to) <= x <= max(ax, to)]
                        if between and min(between) >= 1.0:
                            found.append((near[0][0], moves, to))
        found.sort()
        if found and (len(found) == 1 or found[0][0] < found[1][0]):
            moved += 1
            x1, x2 = (found[0][2], x2) if found[0][1] == 1 else (x1, found[0][2])
        want.append((c1, x1, k1, c2, x2, k2, n))
    assert moved
    same(rows(data("snap_ds_pairs"), "chrom1", "coord1", "clip1", "chrom2", "coord2", "clip2", "n"), want)


def load_pairs(spark):
    return load(spark, SF, "links")


def test_gene_names(data):
    names = lambda t: len({x for x in (y.strip(" ") for y in re.split("[,.;]", t or "")) if x})
    same(rows(data("gene_names"), "doc_id", "names"), [(i, names(t)) for i, t in rows(data("documents"), "doc_id", "text")])


def test_clip_support(data):
    reads = data("reads")
    n = collections.Counter((c, s // 20_000 * 20_000) for c, s, m in rows(reads, "chrom", "start", "mapq") if m >= 20)
    same(rows(data("clip_support"), "chrom1", "coord1", "coord2", "n12", "n21", "n"), [(c, at, at + 9_999, k, k, 2 * k) for (c, at), k in n.items()])  # the clips of both ends together
