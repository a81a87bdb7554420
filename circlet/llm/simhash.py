"""SimHash near-dedup with Golay-code fuzzy keys.

A 64-bit fingerprint is cut into segments of 23, 23 and 18 bits. A 23-bit
segment's keys are the indices of all codewords of the perfect (23,12) Golay
code within distance four of it: one codeword where the nearest is at most two
bits away, else six. Segments that differ in at most two bits share such a key.

Up to four differing bits, let e1, e2, e3 be those of the three segments:

* e1 >= 3: e2 + e3 <= 1, so segment 2 and two of the three 6-bit blocks of
  segment 3 are equal, or the Golay key of 2 and segment 3 are;
* e2 >= 3: likewise with segments 1 and 3;
* else both Golay keys are shared; with e3 <= 2 one of the blocks of segment 3
  is equal too; with e3 >= 3, e1 + e2 <= 1, so segment 1 and the Golay key of 2
  are equal, or segment 2 and the Golay key of 1.

Every link thus shares one of these composite keys, of 30 bits or more and about
113 a fingerprint. Equal fingerprints are one item throughout. Documents meet by
key; each bucket is verified and gives a spanning forest of its links, never all
pairs. A bucket over ``LIMIT`` takes another exact way: its fingerprints list
all points within half the bits, and whoever shares such a point is a link.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER_AZ, aside, components, partitions, stage, table

BITS, SHINGLE, SEED = 4, 4, 42
LIMIT = 4096
#: Generator polynomial of the binary Golay code, x^11+x^10+x^6+x^5+x^4+x^2+1 (fixed value).
GENERATOR = 0xC75
_WHITE = b" \t\n\x0b\x0c\r"


def _chunks(data: bytes, size: int = 1 << 20):
    """Lists of words, so that a very long text's words are never all in memory."""
    at = 0
    while at < len(data):
        end = min(at + size, len(data))
        while end < len(data) and data[end] not in _WHITE:
            end += 1
        yield data[at:end].split()
        at = end


def _shingles(text: str | None, shingle: int):
    """Arrays of the hashes of all shingles of a whole text; a text of fewer words is one shingle, one without words none."""
    data, tail, some = (text or "").encode("utf-8", "surrogatepass").translate(LOWER_AZ), [], False
    for words in _chunks(data):
        words = tail + words
        hashes = [xxhash.xxh64_intdigest(b" ".join(words[k : k + shingle]), SEED) for k in range(len(words) - shingle + 1)]
        tail = words[len(hashes) :] if hashes else words
        if hashes:
            some = True
            yield np.array(hashes, dtype="<u8")
    if tail and not some:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(tail), SEED)], dtype="<u8")


def _ones(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype="i8")


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """SimHash of a whole text; no words: zero. A bit is set if it is set in over half the shingles' hashes."""
    ones, n = np.zeros(64, dtype="i8"), 0
    for hashes in _shingles(text, shingle):
        n += len(hashes)
        ones += _ones(hashes)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp: the fingerprint's 64 bits as a signed long, one row for each row of docs."""

    def run(batches):
        for batch in batches:
            fps = np.fromiter((fingerprint(x, shingle) for x in batch.column("text").to_pylist()), dtype="u8", count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps.view("i8"))], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def _golay() -> tuple[np.ndarray, np.ndarray]:
    """Remainders of the 4,096 messages, and by syndrome the error patterns that lead to all codewords within four bits."""
    rest = np.arange(1 << 12, dtype="u4") << 11
    for bit in range(22, 10, -1):
        rest = np.where(rest >> bit & 1, rest ^ (GENERATOR << bit - 11), rest)
    found: list[list[int]] = [[] for _ in range(2048)]
    for weight in range(5):
        for spots in combinations(range(23), weight):
            e = sum(1 << s for s in spots)
            syndrome = int(rest[e >> 11]) ^ (e & 0x7FF)
            if weight < 4 or len(found[syndrome]) and found[syndrome][0].bit_count() == 3:
                found[syndrome].append(e)
    table = np.full((2048, 6), -1, dtype="i8")
    for s, patterns in enumerate(found):
        table[s, : len(patterns)] = patterns
    return rest.astype("i8"), table


_tables: list[np.ndarray] = []


def golay_keys(segments: np.ndarray) -> np.ndarray:
    """(n, 6) codeword indices of 23-bit segments; -1 where there is none."""
    if not _tables:
        _tables.extend(_golay())
    rest, patterns = _tables
    errors = patterns[rest[segments >> 11] ^ (segments & 0x7FF)]
    return np.where(errors < 0, -1, (segments[:, None] ^ errors) >> 11)


def keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, keys): the composite keys of each fingerprint."""
    s1, s2, s3 = ((fps >> np.uint64(41)).astype("i8"), (fps >> np.uint64(18) & np.uint64(0x7FFFFF)).astype("i8"), (fps & np.uint64(0x3FFFF)).astype("i8"))
    g1, g2 = golay_keys(s1), golay_keys(s2)
    row = np.arange(len(fps))
    rows, out = [], []

    def add(family: int, ids: np.ndarray, key: np.ndarray, ok: np.ndarray | None = None) -> None:
        rows.append(ids if ok is None else ids[ok])
        out.append((key if ok is None else key[ok]) | family << 50)

    blocks = [s3 >> 6, s3 & 0x3F03F, s3 & 0xFFF]  # two of three each

    for i in range(6):
        for j in range(6):
            if (ok := (g1[:, i] >= 0) & (g2[:, j] >= 0)).any():
                both = g1[ok, i] << 24 | g2[ok, j] << 12
                for k in range(3):
                    add(k, row[ok], both | (s3[ok] >> 6 * k & 63))
        add(3, row, g2[:, i] << 18 | s3, g2[:, i] >= 0)
        add(4, row, g1[:, i] << 18 | s3, g1[:, i] >= 0)
        add(5, row, s1 << 12 | g2[:, i], g2[:, i] >= 0)
        add(6, row, s2 << 12 | g1[:, i], g1[:, i] >= 0)
    for k, two in enumerate(blocks):
        add(7 + k, row, s2 << 18 | two)
        add(10 + k, row, s1 << 18 | two)
    return np.concatenate(rows), np.concatenate(out)


def forest(fps: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that span the components of a few thousand fingerprints."""
    left, right, rest = [], [], np.arange(len(fps))
    while len(rest):
        ahead, rest = [rest[0]], rest[1:]
        while ahead and len(rest):
            j = ahead.pop()
            near = np.bitwise_count(fps[rest] ^ fps[j]) <= bits
            if near.any():
                new = rest[near]
                left.append(np.full(len(new), fps[j]))
                right.append(fps[new])
                ahead.extend(new)
                rest = rest[~near]
    empty = np.zeros(0, dtype="u8")
    return (np.concatenate(left), np.concatenate(right)) if left else (empty, empty)


_LINK = "u long, v long"


def _link_batch(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(u.view("i8")), pa.array(v.view("i8"))], names=["u", "v"])


def _meet(bits: int, limit: int):
    """Over rows sorted by key: verified links of each bucket; of a bucket over the limit each member as a link to itself."""

    def run(batches):
        k, f, hot = np.zeros(0, dtype="i8"), np.zeros(0, dtype="u8"), None

        def buckets(k, f):
            at = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1], [True])))
            size = np.diff(at)
            two = at[:-1][size == 2]
            ok = np.bitwise_count(f[two] ^ f[two + 1]) <= bits
            u, v = [f[two][ok]], [f[two + 1][ok]]
            for s, n in zip(at[:-1][size > 2], size[size > 2]):
                a, b = forest(f[s : s + n], bits) if n <= limit else (f[s : s + n],) * 2
                u.append(a)
                v.append(b)
            return _link_batch(np.concatenate(u), np.concatenate(v))

        for batch in batches:
            k = np.concatenate((k, np.asarray(batch.column("key"))))
            f = np.concatenate((f, np.asarray(batch.column("fp")).view("u8")))
            if hot is not None and len(k):
                n = np.searchsorted(k, hot, "right")
                if n:
                    yield _link_batch(f[:n], f[:n])
                    k, f = k[n:], f[n:]
                hot = hot if not len(k) else None
            if not len(k):
                continue
            last = np.searchsorted(k, k[-1])
            if last:
                yield buckets(k[:last], f[:last])
                k, f = k[last:], f[last:]
            if len(k) > limit:
                yield _link_batch(f, f)
                hot, k, f = k[-1], k[:0], f[:0]
        if len(k):
            yield buckets(k, f)

    return run


def _points(bits: int):
    """All points within half the bits of each fingerprint; far: those that are within the larger half alone, if the bits are odd."""
    near = [sum(1 << x for x in spots) for n in range(bits // 2 + 1) for spots in combinations(range(64), n)]
    beyond = [sum(1 << x for x in spots) for spots in combinations(range(64), bits // 2 + 1)] if bits % 2 else []
    masks, far = np.array(near + beyond, dtype="u8"), np.arange(len(near) + len(beyond)) >= len(near)

    def run(batches):
        for batch in batches:
            fps = np.asarray(batch.column("fp")).view("u8")
            for s in range(0, len(fps), 64):
                part = fps[s : s + 64]
                yield pa.RecordBatch.from_arrays([pa.array((part[:, None] ^ masks).ravel().view("i8")), pa.array(np.tile(far, len(part))), pa.array(np.repeat(part, len(masks)).view("i8"))], names=["key", "far", "fp"])

    return run


def _stars(batches):
    """Over rows sorted by point, near ones first: links to the point's first fingerprint, if one is near."""
    key = first = far = None
    for batch in batches:
        k, f, away = np.asarray(batch.column("key")), np.asarray(batch.column("fp")), np.asarray(batch.column("far"))
        if not len(k):
            continue
        at = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
        size = np.diff(np.append(at, len(k)))
        head, none = np.repeat(f[at], size), np.repeat(away[at], size)
        if key is not None and k[0] == key:
            n = at[1] if len(at) > 1 else len(k)
            head[:n], none[:n] = first, far
        key, first, far = k[-1], head[-1], none[-1]
        ok = (f != head) & ~none
        yield _link_batch(f[ok], head[ok])


def links(distinct: DataFrame, bits: int = BITS, limit: int = LIMIT) -> DataFrame:
    """distinct (fp long) -> u, v: links of at most ``bits`` bits (up to four) that span every component."""
    if bits > 4:
        raise ValueError("the keys are complete up to four bits")
    n = partitions(distinct.sparkSession)

    def give(batches):
        for batch in batches:
            fps = np.asarray(batch.column("fp")).view("u8")
            for s in range(0, len(fps), 1024):
                rows, key = keys(fps[s : s + 1024])
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fps[s : s + 1024][rows].view("i8"))], names=["key", "fp"])

    met = distinct.select("fp").mapInArrow(give, "key long, fp long").repartition(n, "key").sortWithinPartitions("key").mapInArrow(_meet(bits, limit), _LINK)
    met = stage(met.distinct(), "met")
    hot = met.where("u = v").select(F.col("u").alias("fp")).distinct()
    if hot.isEmpty():
        return met
    near = hot.mapInArrow(_points(bits), "key long, far boolean, fp long").repartition(n, "key").sortWithinPartitions("key", "far", "fp").mapInArrow(_stars, _LINK)
    return met.where("u <> v").union(near.distinct())


def near_groups(docs: DataFrame, shingle: int = SHINGLE, bits: int = BITS, limit: int = LIMIT) -> DataFrame:
    """One row for each row of docs: doc_id, fp, component_id.

    component_id is the smallest doc_id in reach over links of at most ``bits``
    bits (null doc_ids are not counted; null if there is no other). Null and
    empty texts have the fingerprint zero and link like any other. Repeated
    rows share a fingerprint. Other columns are ignored.
    """
    fps = stage(fingerprints(docs, shingle), "fps")
    distinct = stage(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(links(distinct, bits, limit))
    rooted = distinct.join(stage(roots, "roots").hint("merge"), F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = stage(rooted, "rooted")
    least = stage(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    named = stage(rooted.join(least.hint("merge"), "root").select("fp", "component_id"), "named")
    return fps.join(named.hint("merge"), "fp").select("doc_id", "fp", "component_id")


#: Near copies by similarity: 64-bit words of a print, bands of least hashes that propose a pair, hashes of a band.
WORDS, BANDS, ROWS = 2, 32, 4
#: Two texts are near copies if their sets of shingles have a Jaccard similarity of ALIKE[0] / ALIKE[1] or more.
ALIKE = (4, 5)
#: Differing bits of 128 up to which a pair is proposed: at a similarity of 0.8 the two sets' cosine is 0.889 and a bit differs with probability 0.152, 19.4 of 128 with a deviation of 4.
LOOSE = 40
#: Nodes of a chunk; groups of more are compared as pairs of chunks.
CHUNK = 256
#: Rows of a bucket beyond which all its nodes are proposed with its first one, so that no task holds it.
BUCKET = 1 << 18
#: Places of the map that says which texts' shingles are needed; one map a task and 16 at the driver.
PLACES = 1 << 23


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """The sorted distinct hashes of a whole text's shingles."""
    found = list(_shingles(text, shingle))
    return np.unique(np.concatenate(found)) if found else np.zeros(0, dtype="<u8")


def set_id(hashes: np.ndarray) -> bytes:
    """16 bytes that name a set of shingles: texts of equal sets are one node."""
    return xxhash.xxh3_128_digest(hashes.tobytes())


def long_print(hashes: np.ndarray) -> np.ndarray:
    """SimHash of WORDS * 64 bits of distinct shingles: further hashes of a shingle are mixed from its first. No words: all zero."""
    ones = np.zeros((WORDS, 64), dtype="i8")
    for s in range(0, len(hashes), 1 << 16):
        for k in range(WORDS):
            z = hashes[s : s + (1 << 16)] + np.uint64(0x9E3779B97F4A7C15 * (k + 1) % 2**64)  # the public splitmix64 mixer
            z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            ones[k] += _ones(z ^ (z >> np.uint64(31)))
    return np.packbits(2 * ones > len(hashes), axis=1, bitorder="little").view("<u8").ravel()


def _mixers() -> np.ndarray:
    return np.random.default_rng(11).integers(0, 2**63, BANDS * ROWS, dtype="u8") << np.uint64(1) | np.uint64(1)


def band_keys(hashes: np.ndarray, mixers: np.ndarray) -> np.ndarray:
    """BANDS keys of a set that isn't empty, each of the least of the set under ROWS orders: sets of similarity s share a given one with probability s ** ROWS, so at 0.8 all but one pair in 20 million share one."""
    least = np.full(len(mixers), 2**64 - 1, dtype="u8")
    for s in range(0, len(hashes), 4096):
        np.minimum(least, (hashes[s : s + 4096, None] * mixers).min(0), out=least)
    key = np.arange(BANDS, dtype="u8")
    for x in least.reshape(BANDS, ROWS).T:
        key = (key ^ x) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key


_KEYED = ("key", "n0", "n1", "size", "p0", "p1")


def _near(bits: np.ndarray, size: np.ndarray, i: int, j: np.ndarray) -> np.ndarray:
    """Of j those that few enough bits part from i, and whose sizes let the sets be alike."""
    low, high = ALIKE
    return j[(np.bitwise_count(bits[i] ^ bits[j]).sum(-1) <= LOOSE) & (high * np.minimum(size[i], size[j]) >= low * np.maximum(size[i], size[j]))]


def _proposals(batches):
    """Over rows of _KEYED sorted by key and node: links that span, in each bucket, what may be near copies."""

    def buckets(x):
        k, node, size = x["key"], np.stack([x["n0"], x["n1"]], axis=1), x["size"]
        bits = np.stack([x["p0"], x["p1"]], axis=1).view("u8")
        at = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1], [True])))
        us, vs = [node[:0]], [node[:0]]
        for s, e in zip(at[:-1], at[1:]):
            rest = np.arange(s, e)
            while len(rest) > 1:
                ahead, rest = [rest[0]], rest[1:]
                while ahead and len(rest):
                    j = ahead.pop()
                    new = _near(bits, size, j, rest)
                    if len(new):
                        us.append(np.repeat(node[j : j + 1], len(new), axis=0))
                        vs.append(node[new])
                        ahead.extend(new)
                        rest = np.setdiff1d(rest, new, assume_unique=True)
        text = lambda m: pa.array([r.tobytes() for r in m.astype(">i8")], pa.binary())
        both = np.unique(np.concatenate([np.concatenate(us), np.concatenate(vs)], axis=1), axis=0)
        return pa.RecordBatch.from_arrays([text(both[:, :2]), text(both[:, 2:])], names=["u", "v"])

    def star(node, first):
        text = lambda m: pa.array([r.tobytes() for r in m.astype(">i8")], pa.binary())
        return pa.RecordBatch.from_arrays([text(np.repeat(first[None], len(node), axis=0)), text(node)], names=["u", "v"])

    held, rows, hot = [], 0, None
    for batch in batches:
        x = {c: np.asarray(batch.column(c)) for c in _KEYED}
        if hot is not None and (n := int(np.searchsorted(x["key"], hot[0], "right"))):
            yield star(np.stack([x["n0"][:n], x["n1"][:n]], axis=1), hot[1])
            x = {c: y[n:] for c, y in x.items()}
        if not len(x["key"]):
            continue
        hot = None
        held.append(x)
        rows += len(x["key"])
        if rows <= 20_000 or len(held) > 1 and held[0]["key"][0] == x["key"][-1] and rows <= BUCKET:
            continue
        x = {c: np.concatenate([h[c] for h in held]) for c in _KEYED}
        last = int(np.searchsorted(x["key"], x["key"][-1]))
        if last:
            yield buckets({c: y[:last] for c, y in x.items()})
            x = {c: y[last:] for c, y in x.items()}
        held, rows = [x], len(x["key"])
        if rows > BUCKET:
            node = np.stack([x["n0"], x["n1"]], axis=1)
            yield star(node, node[0])
            held, rows, hot = [], 0, (x["key"][0], node[0])
    if rows:
        yield buckets({c: np.concatenate([h[c] for h in held]) for c in _KEYED})


def _place(node: bytes) -> int:
    return int.from_bytes(node[:8], "big") % PLACES


def _needed(pairs: DataFrame) -> np.ndarray:
    """A map of PLACES bits with those of the pairs' nodes set: all of them, and few others."""

    def mark(batches):
        found = np.zeros(PLACES // 8, dtype="u1")
        for batch in batches:
            for c in ("u", "v"):
                at = np.array([_place(x) for x in batch.column(c).to_pylist()], dtype="i8")
                np.bitwise_or.at(found, at >> 3, (1 << (at & 7)).astype("u1"))
        yield pa.RecordBatch.from_arrays([pa.array([found.tobytes()], pa.binary())], names=["m"])

    def join(batches):
        found = np.zeros(PLACES // 8, dtype="u1")
        for batch in batches:
            for x in batch.column("m").to_pylist():
                found |= np.frombuffer(x, dtype="u1")
        yield pa.RecordBatch.from_arrays([pa.array([found.tobytes()], pa.binary())], names=["m"])

    found = np.zeros(PLACES // 8, dtype="u1")
    for r in pairs.mapInArrow(mark, "m binary").repartition(16).mapInArrow(join, "m binary").collect():  # 16 maps of 1 MB
        found |= np.frombuffer(r.m, dtype="u1")
    return found


def shingle_sets(docs: DataFrame, pairs: DataFrame, shingle: int) -> DataFrame:
    """node, hashes: the shingles of each node of pairs, made anew from the texts."""
    shared = docs.sparkSession.sparkContext.broadcast(_needed(pairs))

    def run(batches):
        needed, seen = shared.value, set()
        for batch in batches:
            nodes, sets, held = [], [], 0
            for text in batch.column("text").to_pylist():
                hashes = shingle_set(text, shingle)
                node = set_id(hashes)
                at = _place(node)
                if node not in seen and needed[at >> 3] >> (at & 7) & 1:
                    seen.add(node)
                    nodes.append(node)
                    sets.append(hashes.tobytes())
                    held += len(sets[-1])
                if held > 1 << 22:
                    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(sets, pa.binary())], names=["node", "hashes"])
                    nodes, sets, held = [], [], 0
            if nodes:
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(sets, pa.binary())], names=["node", "hashes"])

    return docs.select("text").mapInArrow(run, "node binary, hashes binary").dropDuplicates(["node"])


def alike(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sorted sets have a Jaccard similarity of ALIKE or more, counted exactly; empty sets are alike."""
    both = len(x) + len(y) - len(np.union1d(x, y))
    return both * ALIKE[1] >= ALIKE[0] * (len(x) + len(y) - both)


def _verified(batches):
    """Over rows (root, c, d, node, chunk, hashes) sorted by root, c, d: links of alike sets that span what is alike in a chunk, or between two."""

    def links(c, d, nodes, chunks, sets):
        size = np.array([len(x) for x in sets])
        bits, chunk = np.array([long_print(x) for x in sets]), np.array(chunks)
        root, us, vs = np.arange(len(nodes)), [], []
        for i in range(len(nodes)):
            j = np.arange(i + 1, len(nodes))
            if c != d:
                j = j[chunk[j] != chunk[i]]
            for x in _near(bits, size, i, j):
                if root[i] != root[x] and alike(sets[i], sets[x]):
                    root[root == root[x]] = root[i]
                    us.append(nodes[i])
                    vs.append(nodes[x])
        return pa.RecordBatch.from_arrays([pa.array(us, pa.binary()), pa.array(vs, pa.binary())], names=["u", "v"])

    at, held = None, ([], [], [])
    for batch in batches:
        hashes = batch.column("hashes")
        for i, (*key, node, chunk) in enumerate(zip(*(batch.column(n).to_pylist() for n in ("root", "c", "d", "node", "chunk")))):
            if key != at:
                if len(held[0]) > 1:
                    yield links(at[1], at[2], *held)
                at, held = key, ([], [], [])
            for x, y in zip(held, (node, chunk, np.frombuffer(hashes[i].as_py(), dtype="<u8"))):
                x.append(y)
    if len(held[0]) > 1:
        yield links(at[1], at[2], *held)


def verified(loose: DataFrame, sets: DataFrame) -> DataFrame:
    """Links u, v of alike sets that span every group: all nodes (node, root) of a loose group are compared, in pairs of chunks."""
    spark = loose.sparkSession
    count = stage(loose.groupBy("root").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("k")), "count")
    chunk = F.pmod(F.xxhash64("node"), F.col("k")).cast("int")
    dealt = loose.join(count.hint("merge"), "root").withColumn("chunk", chunk).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    dealt = dealt.select("root", F.least("chunk", "o").alias("c"), F.greatest("chunk", "o").alias("d"), "node", "chunk")
    full = stage(dealt, "dealt").join(sets.hint("merge"), "node").select("root", "c", "d", "node", "chunk", "hashes")
    return full.repartition(partitions(spark), "root", "c", "d").sortWithinPartitions("root", "c", "d").mapInArrow(_verified, "u binary, v binary")


def fuzzy_pairs(named: DataFrame) -> DataFrame:
    """named (fp long, node) -> u, v: nodes whose fingerprints Golay keys link within BITS bits, as links that span every group; equal fingerprints are linked too."""
    held = stage(named.distinct(), "named")
    one = stage(held.groupBy("fp").agg(F.min("node").alias("node")), "firsts")
    first = lambda c: one.select(F.col("fp").alias(c), F.col("node").alias(f"node_{c}")).hint("merge")
    apart = links(one).join(first("u"), "u").join(first("v"), "v").select(F.col("node_u").alias("u"), F.col("node_v").alias("v"))
    same = held.join(one.select("fp", F.col("node").alias("first")).hint("merge"), "fp").where("node <> first").select(F.col("first").alias("u"), F.col("node").alias("v"))
    return apart.union(same)


def similar_least(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """doc_id, mark: of each group of near copies the row of the smallest doc_id, mark being the hash of its text (of several the smallest).

    Groups are closed over links of a Jaccard similarity of 0.8 or more between
    the distinct shingles of two texts. Golay keys of the SimHash prints propose
    groups, and bands of least hashes what lies beyond the keys' reach; every
    link is verified on the shingles themselves. Null doc_ids are not counted.
    Null and empty texts are copies of each other.
    """
    names = ["n0", "n1", "size", "p0", "p1"]

    def run(batches):
        mixers = _mixers()
        for batch in batches:
            rows, keys = np.zeros((batch.num_rows, len(names)), dtype="i8"), []
            for i, text in enumerate(batch.column("text").to_pylist()):
                hashes = shingle_set(text, shingle)
                rows[i, :2] = np.frombuffer(set_id(hashes), dtype=">i8")
                rows[i, 2] = len(hashes)
                rows[i, 3:] = long_print(hashes).view("i8")
                keys.append(band_keys(hashes, mixers).tobytes() if len(hashes) else b"")  # texts without words are one node already
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("mark"), *[pa.array(np.ascontiguousarray(x)) for x in rows.T], pa.array(keys, pa.binary())], names=["doc_id", "mark", *names, "keys"])

    def give(batches):
        for batch in batches:
            keys = batch.column("keys").to_pylist()
            rows = np.repeat(np.arange(len(keys)), [len(x) // 8 for x in keys])
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(keys), dtype="i8")), *[pa.array(np.asarray(batch.column(c))[rows]) for c in names]], names=["key", *names])

    marked = docs.select("doc_id", "text", F.xxhash64("text").alias("mark"))
    prints = stage(marked.mapInArrow(run, "doc_id long, mark long, " + ", ".join(f"{n} long" for n in names) + ", keys binary"), "prints")
    n = partitions(docs.sparkSession)
    node = F.unhex(F.concat(F.lpad(F.hex("n0"), 16, "0"), F.lpad(F.hex("n1"), 16, "0")))

    keyed = prints.select(*names, "keys").dropDuplicates(["n0", "n1"]).mapInArrow(give, ", ".join(f"{c} long" for c in _KEYED))
    met = keyed.repartition(n, "key").sortWithinPartitions("key", "n0", "n1").mapInArrow(_proposals, "u binary, v binary")
    met = fuzzy_pairs(prints.select(F.col("p0").alias("fp"), node.alias("node"))).union(met)
    met = stage(met.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "met")
    sets = stage(shingle_sets(docs, met, shingle), "sets")
    roots = stage(components(stage(verified(stage(components(met), "loose"), sets), "links")), "roots")
    nodes = stage(prints.groupBy(node.alias("node")).agg(F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "mark"))).alias("least")), "nodes")
    least = nodes.join(roots.hint("merge"), "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("least").alias("least"))
    return least.where("least is not null").select("least.doc_id", "least.mark")


def near_dedup(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """docs without the rows of a group of near copies but one: that of the smallest doc_id, and of its several texts in the group that of the smallest hash; of rows that repeat it, one stays. Texts of one doc_id that are no near copies are groups of their own. Rows without doc_id name no document: one of each text stays."""
    kept = stage(similar_least(docs, shingle).withColumnRenamed("mark", "hash of text"), "kept")
    held, back = aside(docs, "hash of text")
    marked = held.withColumn("hash of text", F.xxhash64("text"))
    out = marked.join(kept.hint("merge"), ["doc_id", "hash of text"], "left_semi").dropDuplicates(["doc_id", "hash of text"])
    out = out.drop("hash of text").withColumnsRenamed(back).select(*docs.columns)
    lone = docs.where("doc_id is null")
    return out if lone.isEmpty() else out.union(lone.dropDuplicates(["text"]))


def op5_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_groups(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
