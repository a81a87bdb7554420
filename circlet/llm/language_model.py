"""Scores of whole documents under a gated recurrent language model in numpy.

Words are counted over all training documents. The most frequent words and the
end form classes of their own softmax; every other word belongs to a class of
its ending, inside which its share is that of its count. So
P(word | past) = P(class | state) * P(word | class, state) for frequent words,
and P(class | state) * (c + 1) / (N_class + V_class + 1) for the others, an
unseen word having c = 0. The state comes from a gated recurrent unit.

Each text is read once into ids of two bytes a token, which training and
scoring share. Training is truncated backpropagation through windows of
``STEPS`` tokens over lanes of whole documents, the state being carried across
windows from a document's first token to its last. Every training document is dealt by a hash to one shard of one round
and is trained on in the order of that hash; a round's shards begin with the
same weights, which are then averaged in the order of shards. So the weights
don't depend on how the table is cut into tasks. Scoring carries the state from
a document's first token to its last.

The ``HEAD`` most frequent words with their counts are broadcast; counts of all
other words are joined by shuffle on (word, document) pairs, so the vocabulary
is never gathered, and no word of the join is hot.
"""

from __future__ import annotations

from heapq import heapify, heapreplace
from math import log10
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER_AZ, crc_mod, lower_az, partitions, stage, table

FOLDS, HELD_OUT = 7, 2
#: Words whose counts every task holds, none of more than WORD_BYTES; of these, INPUT are read as themselves, and SOFT are scored by the inner softmax, in CLASSES classes. Others are in ENDINGS classes.
HEAD, WORD_BYTES, INPUT, SOFT, CLASSES, ENDINGS = 131_072, 64, 4_095, 2_047, 48, 16
HIDDEN, STEPS, LANES, TRAIN_LANES = 16, 32, 1024, 512
#: Rounds of training; tokens of a shard, of which there are at most SHARDS a round; the least updates that a small shard is cut for. A shard is large enough for its lanes to be longer than most documents.
ROUNDS, SHARD_TOKENS, SHARDS, UPDATES, RATE = 2, 6_000_000, 16_384, 100, 0.02
#: Tokens that are laid out in lanes at a time, bytes of a batch, and rows of one doc_id and text from which they are dealt by place.
GROUP, BATCH_BYTES, HOT = 8_000_000, 4 << 20, 10_000
WHITE = "[ \\t\\n\\x0B\\f\\r]+"
_WHITE = b" \t\n\x0b\x0c\r"
LN10 = float(np.log(10.0))


def word_counts(docs: DataFrame) -> DataFrame:
    """word, c over the whole texts of docs. Lower-casing follows a first count, so it runs once for each distinct spelling of a task."""
    words = docs.where("text is not null").select(F.explode_outer(F.split("text", WHITE, -1)).alias("raw")).where("raw <> ''")
    return words.groupBy("raw").agg(F.count("*").alias("c")).groupBy(lower_az(F.col("raw")).alias("word")).agg(F.sum("c").alias("c"))


def ending(word):
    return F.crc32(F.right(word, F.lit(2)).cast("binary")) % ENDINGS


def _ending(word: bytes) -> int:
    """ending() of a word's bytes: what its last two characters say."""
    tail = word[-2:]
    return crc32(tail if tail.isascii() else word[-8:].decode("utf-8", "ignore")[-2:].encode()) % ENDINGS


class Vocabulary:
    """The head of the vocabulary, the classes and their counts.

    Ids: 0 is the end, then INPUT words by rank, then the ENDINGS of other words, then what is read before a first token.
    """

    def __init__(self, head: list[tuple[str, int]], ends: int, endings: dict[int, tuple[int, int]], total: int, distinct: int):
        """endings: by class, (N, V) over all words that aren't in the inner softmax."""
        self.total, self.distinct, self.ends = total, distinct, ends
        soft = [(None, ends), *head[:SOFT]]
        self.size = -(-len(soft) // CLASSES)
        self.n_soft = len(soft)
        self.n_in = 1 + min(len(head), INPUT)
        self.first = self.n_in + ENDINGS
        self.soft_counts = np.array([c for _, c in soft], dtype="f8")
        words = [w.encode("utf-8", "surrogatepass") for w, _ in head]
        self.words = pa.array([w for w, _ in head], pa.string())
        rare = np.array([_ending(w) for w in words], dtype="i4")
        ranks = np.arange(len(words), dtype="i4")
        self.ids = np.where(ranks + 1 < self.n_in, ranks + 1, self.n_in + rare).astype("u2")
        self.rare = rare
        #: What is scored when an id is read: a word of the inner softmax, or an ending.
        self.target = np.concatenate([np.arange(self.n_soft), self.n_soft + rare[self.n_soft - 1 : self.n_in - 1], self.n_soft + np.arange(ENDINGS)]).astype("i4")
        self.log_c = np.array([log10(c + 1) for _, c in head])
        self.rare_z = np.array([log10(n + v + 1) for n, v in (endings.get(r, (0, 0)) for r in range(ENDINGS))])
        self.rare_counts = np.array([endings.get(r, (0, 0))[0] for r in range(ENDINGS)], dtype="f8")
        self.base_z = log10(total + distinct + 1)

    def read(self, pieces: list[bytes], owner: np.ndarray, texts: int):
        """What the lower-cased pieces of texts hold, owner naming each piece's text in ascending order.

        Returns the ids and how many each text has; by text the known tokens, the
        sum of log10(c + 1), and the sum of what endings take off; and the words
        beyond the head, each once a text: (words, text, place of the word, times).
        """
        split = pc.ascii_split_whitespace(pa.array(pieces, pa.string()))
        words = split.values
        who = np.repeat(owner, np.diff(np.asarray(split.offsets)))
        some = np.asarray(pc.not_equal(pc.binary_length(words), 0))  # a piece may begin or end with white space
        if not some.all():
            words, who = words.filter(pa.array(some)), who[some]
        codes = np.asarray(pc.fill_null(pc.index_in(words, value_set=self.words), -1)).astype("i8")
        known = codes >= 0
        held, whose = codes[known], who[known]
        add = lambda at, x: np.bincount(at, x, texts).astype("f8")  # noqa: E731  (of nothing it counts in integers)
        ids = np.empty(len(words), dtype="u2")
        ids[known] = self.ids[held]
        log_c = self.log_c[held]
        rare = held >= self.n_soft - 1
        own = add(whose[rare], log_c[rare] - self.rare_z[self.rare[held[rare]]])
        coded = words.filter(pa.array(~known)).dictionary_encode()
        distinct, which, at = coded.dictionary, np.asarray(coded.indices).astype("i8"), who[~known]
        tails = np.array([_ending(w) for w in distinct.cast(pa.binary()).to_pylist()], dtype="i8")[which] if len(which) else which
        ids[~known] = self.n_in + tails
        own -= add(at, self.rare_z[tails])
        pair, times = np.unique(at * max(1, len(distinct)) + which, return_counts=True)
        beyond = distinct, pair // max(1, len(distinct)), pair % max(1, len(distinct)), times
        return ids, np.bincount(who, minlength=texts), np.bincount(whose, minlength=texts), add(whose, log_c), own, beyond


def vocabulary(counts: DataFrame, ends: int) -> tuple[Vocabulary, DataFrame]:
    """The vocabulary and the words beyond its head, from staged counts."""
    # The head is all words of a count or more: found on the histogram of counts, so no task merges long lists of words.
    short = F.octet_length("word") <= WORD_BYTES
    least, words = None, 0
    for r in counts.where(short).groupBy("c").agg(F.count("*").alias("k")).orderBy(F.desc("c")).limit(HEAD + 1).collect():
        words += r.k
        if words > HEAD:
            break
        least = r.c
    else:
        least = 0
    head = [] if least is None else [(r.word, r.c) for r in counts.where(short & (F.col("c") >= least)).collect()]  # at most HEAD * WORD_BYTES
    head.sort(key=lambda x: (-x[1], x[0]))
    sums = {r.e: (r.n, r.v) for r in counts.groupBy(ending(F.col("word")).alias("e")).agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()}
    total, distinct = sum(n for n, _ in sums.values()) + ends, sum(v for _, v in sums.values()) + (ends > 0)
    for w, c in head[:SOFT]:
        e = crc32(w[-2:].encode()) % ENDINGS
        sums[e] = (sums[e][0] - c, sums[e][1] - 1)
    beyond = counts if least is None else counts.where(~short | (F.col("c") < least))
    return Vocabulary(head, ends, sums, total, distinct), beyond


def start_weights(v: Vocabulary, seed: int = 7) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    h, c = HIDDEN, CLASSES + ENDINGS
    mass = np.array([v.soft_counts[i * v.size : (i + 1) * v.size].sum() for i in range(CLASSES)])
    inner = np.full((CLASSES, v.size), -1e4)
    inner.ravel()[: v.n_soft] = np.log(v.soft_counts + 1) - np.log(v.total + 1)
    w = {
        "e": rng.normal(0, 0.3, (3, v.first + 1, h)),  # of the update gate, the reset gate and the candidate
        "u": rng.normal(0, 1 / np.sqrt(h), (3, h, h)),
        "b": np.stack([np.full(h, 1.0), np.zeros(h), np.zeros(h)]),  # the update gate begins by keeping the state
        "wc": rng.normal(0, 0.05, (h, c)),
        "bc": np.log(np.concatenate([mass, v.rare_counts]) + 1) - np.log(v.total + c),
        "wi": rng.normal(0, 0.02, (CLASSES, h, v.size)),
        "bi": inner,
    }
    return {k: x.astype("f4") for k, x in w.items()}


class Network:
    def __init__(self, w: dict[str, np.ndarray], n_soft: int):
        self.w, self.n_soft = w, n_soft
        self.size = w["bi"].shape[1]

    def states(self, inp, reset, h, keep: bool = False):
        """Hidden states [steps, lanes, hidden] of input ids [steps, lanes]; where reset, the state begins at zero. keep: with what backpropagation needs, by step."""
        w = self.w
        gx = w["e"][:, inp]
        gx += w["b"][:, None, None, :]
        out = np.empty((*inp.shape, HIDDEN), dtype=h.dtype)
        tape = [np.empty_like(out) for _ in range(5)] if keep else None
        with np.errstate(over="ignore"):  # of an exponential, whose inverse is then zero
            for t in range(len(inp)):
                if reset[t].any():
                    h = h * ~reset[t][:, None]
                g = np.matmul(h, w["u"])
                zr = g[:2]
                zr += gx[:2, t]
                np.negative(zr, out=zr)
                np.exp(zr, out=zr)
                zr += 1
                np.reciprocal(zr, out=zr)
                cand = zr[1] * g[2]
                cand += gx[2, t]
                np.tanh(cand, out=cand)
                if keep:
                    for held, x in zip(tape, (h, zr[0], zr[1], cand, g[2])):
                        held[t] = x
                h = np.subtract(h, cand, out=out[t])
                h *= zr[0]
                h += cand
        return out, h, tape

    def outputs(self, h, tgt, keep: bool = True):
        """Natural log probabilities of targets [n] after states [n, hidden]; keep: with what backpropagation needs."""
        w, s = self.w, self.n_soft
        cls = np.where(tgt < s, tgt // self.size, CLASSES + tgt - s)
        rows = np.arange(len(tgt))
        # a bias is a factor of the exponential; states are bounded, so only large weights could make that infinite
        steep = max(float(np.abs(w["wc"]).sum(0).max()), float(np.abs(w["wi"]).sum(1).max())) > 80
        z = h @ w["wc"]
        if steep:
            np.minimum(z, 80, out=z)
        logp = z[rows, cls] + w["bc"][cls]
        p = np.exp(z, out=z)
        each = np.exp(w["bc"])
        sums = p @ each + 1e-30
        logp -= np.log(sums)
        if keep:
            p *= each
            p /= sums[:, None]
        soft = np.flatnonzero(tgt < s)
        soft = soft[np.argsort(cls[soft].astype("u2"), kind="stable")]
        cuts = np.flatnonzero(np.diff(cls[soft], prepend=-1))
        inner, hs, places = [], h[soft], tgt[soft] % self.size
        each, found = np.exp(w["bi"]), np.empty(len(soft), dtype=h.dtype)
        for a, b in zip(cuts, [*cuts[1:], len(soft)]):
            c, k = cls[soft[a]], places[a:b]
            y = hs[a:b] @ w["wi"][c]
            if steep:
                np.minimum(y, 80, out=y)
            at = rows[: b - a]
            found[a:b] = y[at, k] + w["bi"][c][k]
            q = np.exp(y, out=y)
            sums = q @ each[c] + 1e-30
            found[a:b] -= np.log(sums)
            if keep:
                q *= each[c]
                q /= sums[:, None]
                inner.append((c, soft[a:b], k, q))
        logp[soft] += found
        return logp, (cls, p, inner)

    def gradients(self, inp, tgt, reset, mask, h):
        """Mean loss, its gradients through the window, and the state after it."""
        w, n = self.w, HIDDEN
        g = {k: np.zeros_like(x) for k, x in w.items()}
        hs, after, tape = self.states(inp, reset, h, True)
        flat = hs.reshape(-1, n)
        live = np.flatnonzero(mask.ravel())
        ours = flat if len(live) == len(flat) else flat[live]
        logp, (cls, p, inner) = self.outputs(ours, tgt.ravel()[live])
        k = len(live)
        p[np.arange(k), cls] -= 1
        g["wc"], g["bc"] = ours.T @ p, np.ones(k, dtype=p.dtype) @ p
        dh_live = p @ w["wc"].T
        for c, at, target, q in inner:
            q[np.arange(len(at)), target] -= 1
            g["wi"][c] += ours[at].T @ q
            g["bi"][c] += np.ones(len(at), dtype=q.dtype) @ q
            dh_live[at] += q @ w["wi"][c].T
        for x in (dh_live, g["wc"], g["bc"], g["wi"], g["bi"]):  # the loss is a mean
            x /= k
        if k == len(flat):
            dh_out = dh_live.reshape(hs.shape)
        else:
            dh_out = np.zeros_like(flat)
            dh_out[live] = dh_live
            dh_out = dh_out.reshape(hs.shape)
        prev, z, r, cand, gc = tape
        # what each gate's gradient is a multiple of, for all steps at once
        by_c = (1 - z) * (1 - cand * cand)
        cand -= prev
        cand *= z * z - z
        by_z = cand
        gc *= r - r * r
        by_r = gc
        dgx, dcr, back = np.empty((3, *inp.shape, n), dtype=h.dtype), np.empty((*inp.shape, n), dtype=h.dtype), np.zeros_like(h)
        to_z, to_r, to_c = w["u"].transpose(0, 2, 1).copy()
        for t in range(len(inp) - 1, -1, -1):
            d = back
            d += dh_out[t]
            dz, dr, dc = dgx[:, t]
            np.multiply(d, by_z[t], out=dz)
            np.multiply(d, by_c[t], out=dc)
            np.multiply(dc, by_r[t], out=dr)
            np.multiply(dc, r[t], out=dcr[t])
            d *= z[t]
            d += dz @ to_z
            d += dr @ to_r
            d += dcr[t] @ to_c
            if reset[t].any():
                d *= ~reset[t][:, None]
            back = d
        rows, before = dgx.reshape(3, -1, n), prev.reshape(-1, n).T
        for k, x in enumerate((rows[0], rows[1], dcr.reshape(-1, n))):
            g["u"][k] = before @ x
        ones = np.ones(rows.shape[1], dtype=rows.dtype)
        g["b"] = np.stack([ones @ x for x in rows])
        ids = inp.ravel()
        order = np.argsort(ids, kind="stable")
        cuts = np.flatnonzero(np.diff(ids[order].astype("i4"), prepend=-1))
        g["e"][:, ids[order][cuts]] = np.add.reduceat(rows[:, order], cuts, axis=1)
        return -float(logp.mean()), g, after


def lanes(ids: list[np.ndarray], v: Vocabulary, most: int):
    """Windows over texts side by side: each lane reads one text after another, and the lanes are of nearly equal length.

    ids: of each text. Yields (inputs, targets, resets, numbers), each [steps,
    lanes], of the lanes that aren't at their end, the longest first; number is
    the text's place in ids, -1 padding.
    """
    sizes = np.array([len(x) for x in ids], dtype="i8")
    load = [(0, k) for k in range(max(1, min(most, len(ids))))]
    dealt: list[list[int]] = [[] for _ in load]
    heapify(load)
    for i in np.argsort(-sizes, kind="stable").tolist():  # the longest left goes to the lane with least
        held, k = load[0]
        dealt[k].append(i)
        heapreplace(load, (held + int(sizes[i]), k))
    total = sorted(((n, k) for n, k in load if n), key=lambda x: (-x[0], x[1]))
    if not total:
        return
    order = [i for _, k in total for i in dealt[k]]
    stream = np.concatenate([ids[i] for i in order])
    number = np.repeat(np.array(order, dtype="i4"), sizes[order])
    begins = np.concatenate(([0], np.cumsum(sizes[order])[:-1]))[sizes[order] > 0]
    reset = np.zeros(len(stream), dtype=bool)
    reset[begins] = True
    before = np.concatenate((stream[:1], stream[:-1]))
    before[begins] = v.first
    long = np.array([n for n, _ in total], dtype="i8")
    at = np.cumsum(long) - long
    steps = np.arange(STEPS)[:, None]
    for t in range(0, int(long[0]), STEPS):
        k = int(np.searchsorted(-long, -t))  # lanes with more than t tokens
        place = at[:k] + t + steps
        there = t + steps < long[:k]
        place = np.where(there, place, at[:k])
        yield before[place], v.target[stream[place]], reset[place] & there, np.where(there, number[place], -1)


def _chunks(text: str | None, size: int = 1 << 18):
    """A text's lower-cased bytes in pieces that end between words."""
    data, at = (text or "").encode("utf-8", "surrogatepass").translate(LOWER_AZ), 0
    while at < len(data):
        end = min(at + size, len(data))
        while end < len(data) and data[end] not in _WHITE:
            end += 1
        yield data[at:end]
        at = end


_READ = "row long, doc_id long, key long, n_tokens long, n_known long, log_c double, own double, ids binary, words array<string>, times array<long>"


def read_texts(docs: DataFrame, v: Vocabulary) -> DataFrame:
    """Each text's ids (two bytes a token) and sums, and apart from them, by row, its words beyond the head with how often they occur."""
    shared = docs.sparkSession.sparkContext.broadcast(v)
    names = ["row", "doc_id", "key", "n_tokens", "n_known", "log_c", "own", "ids", "words", "times"]

    def run(batches):
        v, base, end = shared.value, TaskContext.get().partitionId() << 40, np.zeros(1, dtype="u2")

        def out(first, keys, pieces, owner):
            """The rows of the texts from number first on."""
            n = len(keys)
            ids, sizes, known, log_c, own, (distinct, text, word, times) = v.read(pieces, np.array(owner, dtype="i8"), n)
            cuts = np.concatenate(([0], np.cumsum(sizes)))
            rows = pa.array((base | first) + np.arange(n, dtype="i8"))
            texts = pa.array([np.concatenate((ids[a:b], end)).tobytes() for a, b in zip(cuts[:-1], cuts[1:])], pa.binary())
            none = lambda t, k: pa.nulls(k, t)
            strings, counts = pa.list_(pa.string()), pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [rows, pa.array([k for k, _ in keys], pa.int64()), pa.array([k for _, k in keys], pa.int64()), pa.array(sizes + 1), pa.array(known + int(v.ends > 0)), pa.array(log_c + log10(v.ends + 1)), pa.array(own), texts, none(strings, n), none(counts, n)], names=names
            )
            if len(text):
                at = np.flatnonzero(np.diff(text, prepend=-1))
                offsets = pa.array(np.append(at, len(text)).astype("i4"))
                words = pa.ListArray.from_arrays(offsets, distinct.take(pa.array(word)))
                k = len(at)
                yield pa.RecordBatch.from_arrays(
                    [pa.array((base | first) + text[at]), *[none(pa.int64(), k) for _ in range(4)], none(pa.float64(), k), none(pa.float64(), k), none(pa.binary(), k), words, pa.ListArray.from_arrays(offsets, pa.array(times.astype("i8")))], names=names
                )

        first, keys, pieces, owner, held = 0, [], [], [], 0
        for batch in batches:
            for doc, key, text in zip(batch.column("doc_id").to_pylist(), batch.column("key").to_pylist(), batch.column("text")):
                for piece in _chunks(text.as_py()):
                    pieces.append(piece)
                    owner.append(len(keys))
                    held += len(piece)
                keys.append((doc, key))
                if held > BATCH_BYTES:
                    yield from out(first, keys, pieces, owner)
                    first, keys, pieces, owner, held = first + len(keys), [], [], [], 0
        if keys:
            yield from out(first, keys, pieces, owner)

    return docs.select("doc_id", "text", F.xxhash64(F.lit("lm"), "doc_id", "text").alias("key")).mapInArrow(run, _READ)


def _ids(array) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), dtype="u2") for x in array]


def dealt(read: DataFrame, shards: int, rounds: int = ROUNDS) -> DataFrame:
    """round, shard, key, ids: every row of read in one shard of one round, by the hash of its doc_id and text; more than HOT rows that share it, by their place."""
    hot = read.groupBy("key").agg(F.count("*").alias("k")).where(F.col("k") > HOT).select("key").withColumn("hot", F.lit(True))
    rows = read.select("row", "key", "ids")
    if not hot.isEmpty():
        rows = rows.join(F.broadcast(hot), "key", "left").withColumn("key", F.when(F.col("hot"), F.xxhash64("key", "row")).otherwise(F.col("key")))  # at most rows / HOT keys, of 8 bytes
    spread = F.xxhash64(F.lit("deal"), "key")
    return rows.select(F.pmod(spread, F.lit(rounds)).cast("int").alias("round"), F.pmod(F.floor(spread / rounds), F.lit(shards)).cast("int").alias("shard"), "key", "ids")


def _train_shard(v: Vocabulary, begin: dict[str, np.ndarray], groups, tokens: float) -> tuple[dict[str, np.ndarray], int]:
    """Weights after the texts of groups (lists of ids), and how many tokens these had. tokens: of a usual shard."""
    own = {n: x.copy() for n, x in begin.items()}
    net, m, s = Network(own, v.n_soft), {n: np.zeros_like(x) for n, x in own.items()}, {n: np.zeros_like(x) for n, x in own.items()}
    most = int(min(TRAIN_LANES, max(8, tokens // (STEPS * UPDATES))))
    steps = seen = 0
    for texts in groups:
        h = np.zeros((most, HIDDEN), dtype="f4")
        for inp, tgt, reset, number in lanes(texts, v, most):
            mask = number >= 0
            _, g, h = net.gradients(inp, tgt, reset, mask, h[: inp.shape[1]])
            steps += 1
            n = int(mask.sum())
            seen += n
            live = n / (most * STEPS)  # a window in part padding takes a smaller step, so no long document outweighs the others
            size = np.sqrt(sum(float(np.vdot(x, x)) for x in g.values()))
            rate, c1, c2 = -RATE * live, 1 / (1 - 0.9**steps), 1 / (1 - 0.99**steps)
            for k, x in g.items():  # Adam, the gradient's size held to one
                x *= min(1.0, 1.0 / (size + 1e-9))
                m[k] += 0.1 * (x - m[k])
                x *= x
                s[k] += 0.01 * (x - s[k])
                np.sqrt(np.multiply(s[k], c2, out=x), out=x)
                x += 1e-8
                np.divide(m[k], x, out=x)
                x *= rate * c1
                own[k] += x
    return own, seen


_WEIGHTS = "shard int, n double, w binary"


def _packed(shard: int, n: float, flat: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([float(n)]), pa.array([flat.tobytes()], pa.binary())], names=["shard", "n", "w"])


def _mean(batches):
    """Over rows sorted by shard: the mean of each sixteen shards, weighed by their tokens."""
    at, total, n = None, None, 0.0
    for batch in batches:
        for shard, k, x in zip(batch.column("shard").to_pylist(), batch.column("n").to_pylist(), batch.column("w")):
            x = k * np.frombuffer(x.as_buffer(), dtype="f4").astype("f8")
            if at is not None and shard // 16 != at:
                yield _packed(at, n, (total / n).astype("f4"))
                total, n = None, 0.0
            at, total, n = shard // 16, x if total is None else total + x, n + k
    if at is not None:
        yield _packed(at, n, (total / n).astype("f4"))


def train(read: DataFrame, v: Vocabulary, rounds: int = ROUNDS, shard_tokens: int = SHARD_TOKENS) -> dict[str, np.ndarray]:
    """Weights from all rows of read_texts(); what reaches the driver are the means of at most 16 groups of shards a round."""
    spark = read.sparkSession
    shards = int(max(1, min(SHARDS, -(-v.total // (rounds * shard_tokens)))))
    w, words = start_weights(v), spark.sparkContext.broadcast(v)
    rows = dealt(read, shards, rounds)
    tokens = v.total / (rounds * shards)
    for k in range(rounds):
        begin = spark.sparkContext.broadcast(w)

        def run(batches):
            v, left = words.value, iter(batches)
            texts = ((s, x) for b in left for s, x in zip(b.column("shard").to_pylist(), _ids(b.column("ids"))))
            ahead = next(texts, None)

            def groups(shard):
                nonlocal ahead
                while ahead and ahead[0] == shard:
                    held, n = [], 0
                    while ahead and ahead[0] == shard and n < GROUP:
                        held.append(ahead[1])
                        n += len(ahead[1])
                        ahead = next(texts, None)
                    yield held

            while ahead:
                shard = ahead[0]
                own, seen = _train_shard(v, begin.value, groups(shard), tokens)
                yield _packed(shard, seen, np.concatenate([own[n].ravel() for n in sorted(own)]))

        part = rows.where(F.col("round") == k).select("shard", "key", "ids")
        part = part.repartitionByRange(max(shards, 1), "shard").sortWithinPartitions("shard", "key")
        found, left = stage(part.mapInArrow(run, _WEIGHTS), "weights"), shards
        while left > 16:
            found = stage(found.repartitionByRange(min(partitions(spark), -(-left // 16)), F.floor(F.col("shard") / 16)).sortWithinPartitions("shard").mapInArrow(_mean, _WEIGHTS), "weights")
            left = -(-left // 16)
        sums = sorted(found.collect(), key=lambda r: r.shard)
        if sums:
            flat = sum(r.n * np.frombuffer(r.w, dtype="f4").astype("f8") for r in sums) / sum(r.n for r in sums)
            at = 0
            for n in sorted(w):
                w[n] = flat[at : at + w[n].size].reshape(w[n].shape).astype("f4")
                at += w[n].size
        begin.unpersist()
    return w


def log_probabilities(texts: list[np.ndarray], v: Vocabulary, net: Network) -> np.ndarray:
    """The network's log10 probability of each text (ids), read from its first token to its last with one state."""
    found = np.zeros(len(texts))
    h = np.zeros((LANES, HIDDEN), dtype="f4")
    for inp, tgt, reset, number in lanes(texts, v, LANES):
        hs, h, _ = net.states(inp, reset, h[: inp.shape[1]])
        who = number.ravel()
        live = np.flatnonzero(who >= 0)
        hs = hs.reshape(-1, HIDDEN)
        logp, _ = net.outputs(hs if len(live) == len(hs) else hs[live], tgt.ravel()[live], False)
        found += np.bincount(who[live], logp.astype("f8"), len(texts))
    return found / LN10


def score_texts(read: DataFrame, v: Vocabulary, w: dict[str, np.ndarray], beyond: DataFrame) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score: one row for each text of read_texts()."""
    shared = read.sparkSession.sparkContext.broadcast((v, w))
    names = ["row", "doc_id", "n_tokens", "n_known", "log_c", "own"]

    def run(batches):
        v, w = shared.value
        net = Network(w, v.n_soft)

        def done(held):
            texts = [x for b in held for x in _ids(b.column("ids"))]
            scores = log_probabilities(texts, v, net)
            columns = [pa.concat_arrays([b.column(c) for b in held]) for c in names]
            columns[-1] = pa.array(np.asarray(columns[-1]) + scores)
            return pa.RecordBatch.from_arrays(columns, names=names)

        held, n = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                n += sum(len(x.as_buffer()) for x in batch.column("ids")) // 2
            if n > GROUP:
                yield done(held)
                held, n = [], 0
        if held:
            yield done(held)

    rows = stage(read.where("words is null").select(*names, "ids").mapInArrow(run, "row long, doc_id long, n_tokens long, n_known long, log_c double, own double"), "scored")
    found = read.where("words is not null").select("row", F.explode(F.arrays_zip("words", "times")).alias("x")).select("row", F.col("x.words").alias("word"), F.col("x.times").alias("times"))
    found = found.join(beyond.hint("merge"), "word").groupBy("row").agg(F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("log_more"))
    done = rows.join(stage(found, "found").hint("merge"), "row", "left")
    more = F.coalesce("log_more", F.lit(0.0))
    return done.select("doc_id", "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"), (F.col("log_c") + more - F.col("n_tokens") * v.base_z).alias("base_score"), (F.col("own") + more).alias("score"))


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row for each row of docs.

    Learns from rows whose crc32(doc_id as text) mod 7 is not 2 and scores all.
    Null and empty texts are one end token. Repeated rows are scored, and
    counted, each. Without training rows every token's base is log10 of one.
    Words of one count are ordered by their letters, so ties change nothing.
    Other columns are ignored.
    """
    docs = docs.select("doc_id", "text")
    learns = crc_mod(F.col("doc_id"), FOLDS) != HELD_OUT
    counts = stage(word_counts(docs.where(learns)), "words")
    v, beyond = vocabulary(counts, docs.where(learns).count())
    read = stage(read_texts(docs, v), "read")
    w = train(read.where("words is null").where(learns), v)
    out = score_texts(read, v, w, beyond)
    return out.select("doc_id", (crc_mod(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "n_tokens", "n_known", F.lit(v.total).cast("long").alias("train_tokens"), "base_score", "score")


def op9_gated_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))
