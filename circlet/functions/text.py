"""Sequence functions as Columns, and kernels for what no built-in function says."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def reverse_complement(s: Column) -> Column:
    """Unknown letters become N; the case stays."""
    return F.reverse(F.translate(F.regexp_replace(s, "[^ACGTNacgtn]", "N"), "ACGTacgt", "TGCAtgca"))


def normalised_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance in upper case over the longer length."""
    return edit_distance(F.upper(a), F.upper(b)) / F.greatest(F.length(a), F.length(b), F.lit(1))


def first_upper_run(s: Column) -> Column:
    return F.regexp_extract(s, "([A-Z]+)", 1)


def repeat_share(s: Column, least: int = 4) -> Column:
    """Share of the sequence in immediate repeats of at least ``least`` letters."""
    runs = F.regexp_extract_all(s, F.lit("(.+?)\\1+"), F.lit(0))
    held = F.aggregate(F.filter(runs, lambda x: F.length(x) >= least), F.lit(0), lambda acc, x: acc + F.length(x))
    return F.coalesce(F.try_divide(held, F.length(s)), F.lit(0.0))


def cigar_length(cigar: Column) -> Column:
    """Reference bases of a CIGAR: operations M, D, N, = and X."""
    parts = F.regexp_extract_all(cigar, F.lit("([0-9]+)[MDN=X]"), F.lit(1))
    return F.aggregate(parts, F.lit(0).cast("long"), lambda acc, x: acc + x.cast("long"))


def cigar_clip(cigar: Column) -> Column:
    """L, R or null: the side of the longer clip, L of equals."""
    left = F.coalesce(F.nullif(F.regexp_extract(cigar, "^([0-9]+)[SH]", 1), F.lit("")).cast("int"), F.lit(0))
    right = F.coalesce(F.nullif(F.regexp_extract(cigar, "([0-9]+)[SH]$", 1), F.lit("")).cast("int"), F.lit(0))
    return F.when((left == 0) & (right == 0), None).when(left >= right, "L").otherwise("R")


def parse_sa(tag: Column) -> Column:
    """Entries of an SA tag with 0-based positions; entries of fewer than six fields are skipped."""
    entries = F.filter(F.transform(F.split(tag, ";"), lambda x: F.split(x, ",")), lambda x: F.size(x) >= 6)
    return F.transform(entries, lambda x: F.struct(x[0].alias("chrom"), (x[1].cast("long") - 1).alias("pos"), x[2].alias("strand"), x[3].alias("cigar"), x[4].cast("int").alias("mapq"), x[5].cast("int").alias("nm")))


def gene_list(s: Column) -> Column:
    """Distinct names of a ;-separated list, sorted."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.split(s, ";"), lambda x: F.trim(x)), lambda x: x != "")))


def junction_id(chrom1: Column, coord1: Column, clip1: Column, chrom2: Column, coord2: Column, clip2: Column) -> Column:
    """Both ends as chrom:coord:clip, the smaller text first, joined by a pipe."""
    a, b = F.concat_ws(":", chrom1, coord1, clip1), F.concat_ws(":", chrom2, coord2, clip2)
    return F.concat_ws("|", F.least(a, b), F.greatest(a, b))


def turn_clip(s: Column, turn: Column) -> Column:
    """A clip read in the frame of the other side: L2R and R2L reverse, L2L and R2R complement the reversed."""
    return F.when(turn.isin("L2R", "R2L"), F.reverse(s)).otherwise(reverse_complement(s))


#: Sequences up to this length are compared many pairs at a time, as matrices of letters; longer ones pair by pair.
LENGTH = 1024
#: Letters in a matrix, so that it stays in a core's cache.
LETTERS = 400_000
#: No letter.
_NONE = 0xFFFFFFFF


def _letters(texts):
    """Texts as rows of letters, filled up with what equals none; and their lengths."""
    import numpy as np

    size = np.fromiter(map(len, texts), "i8", len(texts))
    wide = max(int(size.max()), 1)
    rows = np.array(texts, f"U{wide}").view("u4").reshape(len(texts), wide)
    rows[np.arange(wide) >= size[:, None]] = _NONE
    return rows, size


def _blocks(a: pd.Series, b: pd.Series, steps, widest: int = LENGTH):
    """Places of pairs of texts, neither null nor empty, in blocks by falling length of the side named by steps, the smaller first of equals by the other; then the places of those that are too long. a is at most ``widest``."""
    import numpy as np

    texts = [a.to_numpy(object), b.to_numpy(object)]
    size = [np.fromiter((len(x) if isinstance(x, str) else 0 for x in t), "i8", len(t)) for t in texts]
    some = np.flatnonzero((size[0] > 0) & (size[1] > 0))
    fit = (size[0][some] <= widest) & (size[1][some] <= LENGTH)
    good = some[fit]
    good = good[np.lexsort((size[1 - steps][good], -size[steps][good]))]
    found, at = [], 0
    while at < len(good):
        upto = at + max(1, LETTERS // int(max(size[0][good[at]], size[1][good[at]], 64)))
        # a row of another length class may be much wider: the block is as wide as its widest
        part = good[at:upto]
        wide = int(max(size[0][part].max(), size[1][part].max()))
        part = part[: max(1, LETTERS // max(wide, 64))]
        found.append(part)
        at += len(part)
    return texts, found, some[~fit]


def _edit_steps(x, y):
    """Edits of each x (at most 64 letters) to the beginnings of its y, bit-parallel: the fewest of all beginnings, and those to the whole of y. Rows come by falling length of y."""
    import numpy as np

    (p, m), (t, n) = _letters(x), _letters(y)
    p = np.pad(p, ((0, 0), (0, 64 - p.shape[1])), constant_values=_NONE)
    up, down = np.full(len(p), 2**64 - 1, "u8"), np.zeros(len(p), "u8")
    score, top, one = m.copy(), (m - 1).astype("u8"), np.uint64(1)
    least = score.copy()
    for j in range(t.shape[1]):
        k = int(np.searchsorted(-n, -j, "left"))  # rows that have this letter
        same = np.packbits(p[:k] == t[:k, j, None], axis=1, bitorder="little").view("u8")[:, 0]
        pv, mv = up[:k], down[:k]
        xv = same | mv
        xh = (((same & pv) + pv) ^ pv) | same
        ph, mh = mv | ~(xh | pv), pv & xh
        score[:k] += ((ph >> top[:k]) & one).astype("i8") - ((mh >> top[:k]) & one).astype("i8")
        np.minimum(least[:k], score[:k], out=least[:k])
        ph, mh = (ph << one) | one, mh << one
        up[:k], down[:k] = mh | ~(xv | ph), ph & xv
    return least, score


@F.pandas_udf(T.IntegerType())
def edit_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    """Levenshtein distance; null with a null."""
    import numpy as np

    out = np.array([np.nan if x is None or y is None else max(len(x), len(y)) for x, y in zip(a, b)], "f8")
    texts, blocks, rest = _blocks(a, b, 1, 64)
    for at in blocks:
        out[at] = _edit_steps(texts[0][at].tolist(), texts[1][at].tolist())[1]
    for at in rest:
        out[at] = _last_row(texts[0][at], texts[1][at])[-1]
    return pd.Series(out).astype("Int32")


def _last_row(x, y):
    """Edits of x to each beginning of y."""
    import numpy as np

    letters, steps = np.frombuffer(y.encode("utf-32-le", "surrogatepass"), "u4"), np.arange(len(y) + 1)
    last = steps
    for i, c in enumerate(np.frombuffer(x.encode("utf-32-le", "surrogatepass"), "u4"), 1):
        row = np.empty_like(last)
        row[0] = i
        row[1:] = np.minimum(last[1:] + 1, last[:-1] + (letters != c))
        last = np.minimum.accumulate(row - steps) + steps  # insertions from the left
    return last


@F.pandas_udf(T.DoubleType())
def semi_global_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    """Fewest edits of a against any part of b that begins at b's start, over the length of a: the minimum of the last row."""
    import numpy as np

    out = np.array([np.nan if x is None or y is None else float(len(x) > 0) for x, y in zip(a, b)], "f8")
    texts, blocks, rest = _blocks(a, b, 1, 64)
    for at in blocks:
        x = texts[0][at].tolist()
        out[at] = _edit_steps(x, texts[1][at].tolist())[0] / np.array([len(t) for t in x])
    for at in rest:
        out[at] = _last_row(texts[0][at], texts[1][at]).min() / len(texts[0][at])
    return pd.Series(out, dtype="float64")


@F.pandas_udf(T.StructType([T.StructField(n, T.IntegerType()) for n in ("a_at", "b_at", "size")]))
def common_substring(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """The longest common substring: its places and size. Of equals the first in a, then in b; of nothing in common (0, 0, 0)."""
    import numpy as np

    out = np.zeros((len(a), 3), "i4")
    texts, blocks, rest = _blocks(a, b, 0)
    for at in [*blocks, *([k] for k in rest)]:
        (x, m), (y, _) = _letters(texts[0][at].tolist()), _letters(texts[1][at].tolist())
        # runs of the letters before, each one place on
        runs, best = np.zeros((len(x), y.shape[1] + 1), "i2" if y.shape[1] < 2**15 else "i4"), np.zeros((len(x), 3), "i4")
        for i in range(x.shape[1]):
            k = int(np.searchsorted(-m, -i, "left"))  # rows that have this letter
            runs[:k, 1:] = (runs[:k, :-1] + 1) * (y[:k] == x[:k, i, None])
            longest = runs[:k].max(1)
            # one that ends later is first only if it is longer
            more = np.flatnonzero(longest > best[:k, 2])
            if len(more):
                n = longest[more]
                best[more] = np.stack((i - n + 1, runs[more].argmax(1) - n, n), 1)
        out[at] = best
    return pd.DataFrame(out, columns=["a_at", "b_at", "size"])


@F.pandas_udf(T.StructType([T.StructField(n, T.IntegerType()) for n in ("at", "stop", "edits")]))
def place_in(read: pd.Series, template: pd.Series) -> pd.DataFrame:
    """Where a read lies in a template with the fewest edits, both ends of the template being free: from at up to stop. Of equals the first stop, then the last start."""
    import numpy as np

    out = np.array([(0, 0, len(x or "")) for x in read], "i4").reshape(-1, 3)
    texts, blocks, rest = _blocks(read, template, 0)
    for at in [*blocks, *([k] for k in rest)]:
        (x, m), (y, n) = _letters(texts[0][at].tolist()), _letters(texts[1][at].tolist())
        steps, twice = np.arange(y.shape[1] + 1), 2 * (y.shape[1] + 1)
        cost, start = np.zeros((len(x), len(steps)), "i8"), np.tile(steps, (len(x), 1))
        for i in range(x.shape[1]):
            k = int(np.searchsorted(-m, -i, "left"))  # rows that have this letter
            # cost and start as one number, the least of which has the latest start: the letter stands alone, or beside one of the template
            key = (cost[:k] + 1 - steps) * twice - start[:k]
            side = (cost[:k, :-1] + (y[:k] != x[:k, i, None]) - steps[1:]) * twice - start[:k, :-1]
            np.minimum(key[:, 1:], side, out=key[:, 1:])
            # letters of the template left out: the best before each place
            best = np.minimum.accumulate(key, axis=1)
            origin = -best % twice
            cost[:k], start[:k] = (best + origin) // twice + steps, origin
        cost[steps > n[:, None]] = np.iinfo("i8").max
        stop, row = cost.argmin(1), np.arange(len(x))
        out[at] = np.stack((start[row, stop], stop, cost[row, stop]), 1)
    return pd.DataFrame(out, columns=["at", "stop", "edits"])


@F.pandas_udf(T.IntegerType())
def fuzzy_find(clip: pd.Series, seq: pd.Series) -> pd.Series:
    """First place in seq where clip matches with at most a tenth of its letters changed; -1: none."""
    import numpy as np

    out = np.full(len(clip), -1, "i4")
    texts, blocks, rest = _blocks(clip, seq, 0)
    for at in [*blocks, *([k] for k in rest)]:
        (x, m), (y, n) = _letters(texts[0][at].tolist()), _letters(texts[1][at].tolist())
        wrong = np.zeros((len(x), y.shape[1]), "i4")
        for i in range(min(x.shape[1], y.shape[1])):
            k = int(np.searchsorted(-m, -i, "left"))  # rows that have this letter
            wrong[:k, : y.shape[1] - i] += y[:k, i:] != x[:k, i, None]
        ok = (wrong <= 0.1 * m[:, None]) & (np.arange(y.shape[1]) <= (n - m)[:, None])
        out[at] = np.where(ok.any(1), ok.argmax(1), -1)
    return pd.Series(out)


def consensus(bases, pos: str = "pos", base: str = "base", by: list[str] = (), times: Column | None = None):
    """Consensus of rows (by, pos, base): the most frequent base at each place, A before C, G and T of equals. times: how often a row counts; rows of none stand behind all others."""
    counts = bases.groupBy(*by, pos, base).agg((F.count("*") if times is None else F.sum(times)).alias("_n"))
    best = counts.groupBy(*by, pos).agg(F.max_by(base, F.struct("_n", -F.ascii(base))).alias("_b"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(pos, "_b"))), lambda x: x["_b"]), "")
    return best.groupBy(*by).agg(joined.alias("consensus"))
