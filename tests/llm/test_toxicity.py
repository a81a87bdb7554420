"""Toxicity against plain Python: all readings of a token by enumeration, and the whole query row by row."""

import collections
import itertools
import math
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from circlet.llm import toxicity

DOCS = "doc_id long, text string"


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], DOCS)


def toxic_rows(n=600):
    rng = np.random.default_rng(4)
    plain = ["".join(rng.choice(["an", "er", "th", "in", "on", "le"], 3)) for _ in range(80)]
    bad = ["idiot", "moron", "pathetic"]
    rows, labels = [], []
    for i in range(n):
        words = list(rng.choice(plain, 30))
        y = int(rng.random() < 0.3)
        if y:
            words[int(rng.integers(30))] = bad[int(rng.integers(3))]
        rows.append((i, " ".join(words)))
        labels.append((i, y))
    return rows, labels


def test_toxicity(spark):
    rows, labels = toxic_rows()
    hidden = ["an 1d10t here", "an i d i o t here", "the m.o.r.o.n", "idiooooot", "p@thet1c"]
    rows += [(10_000 + i, t) for i, t in enumerate(hidden)] + [(20_000, None), (20_001, ""), (20_002, "plain words then"), (None, "moron")]
    docs = spark.createDataFrame(rows, DOCS).withColumn("score", F.lit("clash"))
    lab = spark.createDataFrame([*labels, (None, 1), (1, None)], "doc_id long, toxic int").withColumn("quality", F.lit(0))
    got = toxicity.score(docs, toxicity.train(docs, lab)).collect()
    assert len(got) == len(rows)
    p = {r.doc_id: r.predicted for r in got}
    y = dict(labels)
    held = [i for i in y if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([p[i] == y[i] for i in held]) > 0.97
    assert [p[10_000 + i] for i in range(len(hidden))] == [1] * len(hidden)
    assert p[20_000] == p[20_001] == p[20_002] == 0 and p[None] == 1
    kept = toxicity.drop_toxic(docs, lab)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, x in p.items() if not x}


def test_long_and_doubled_disguises(spark):
    rows, labels = toxic_rows()
    rows += [(i + 5_000, f"an ass {t}") for i, (_, t) in enumerate(rows[:200])]
    labels += [(i + 5_000, 1) for i in range(200)]
    words = [w for w in rows[1][1].split() if w not in ("idiot", "moron", "pathetic")][:8]
    out = lambda *w: " ".join("".join(w))
    hidden = ["idio" + "o" * 40 + "t", "iddiott", "@$$", out(words[0], "idiot", words[1]), out(*words, "moron", *words), "m" + "." * 50 + "oron"]
    clean = [out(*words), "1000 455 2024", "leth" + "e" * 60 + "r"]
    rows += [(10_000 + i, t) for i, t in enumerate(hidden)] + [(20_000 + i, t) for i, t in enumerate(clean)]
    docs = spark.createDataFrame(rows, DOCS)
    got = toxicity.score(docs, toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))).where("doc_id >= 10000").collect()
    p = {r.doc_id: r.predicted for r in got}
    assert [p[10_000 + i] for i in range(len(hidden))] == [1] * len(hidden)
    assert [p[20_000 + i] for i in range(len(clean))] == [0] * len(clean)


def test_toxicity_without_labels(spark):
    docs = docs_of(spark, ["a", None])
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.predicted for r in toxicity.score(docs, toxicity.train(docs, none)).collect()} <= {0, 1}
    empty = spark.createDataFrame([], DOCS)
    assert toxicity.score(empty, toxicity.train(empty, none)).count() == 0


def plain_model(texts):
    """The character model from the definition: trigrams back off to bigrams and letters."""
    n = np.zeros((toxicity.K,) * 3)
    for t in texts:
        if t:
            x = [0, *(toxicity._CLASS.get(c, 0) for c in t.lower()), 0]
            for a, b, c in zip(x, x[1:], x[2:]):
                n[a, b, c] += 1
    return n


def all_readings(token, model):
    """Every reading of a token with its score, by enumeration."""
    found = {}

    def walk(at, a, b, score, text):
        if at == len(token):
            found[text] = max(found.get(text, -1e30), score + float(model[a, b, 0]))
            return
        ch = token[at]
        letter = ch in toxicity._CLASS
        options = [(ch, 0.0)] if letter else [(x, toxicity.SIGN_COST) for x in toxicity.SIGNS.get(ch, "")]
        for x, cost in options:
            c = toxicity._CLASS[x]
            walk(at + 1, b, c, score + float(model[a, b, c]) - cost, text + x)
        if letter and b == toxicity._CLASS[ch]:
            walk(at + 1, a, b, score - toxicity.REPEAT_COST, text)
        if not letter and (ch not in toxicity.SIGNS or ch in "!|+(%"):
            walk(at + 1, a, b, score - toxicity.DROP_COST, text)

    walk(0, 0, 0, 0.0, "")
    return found


def test_viterbi_finds_the_best_of_all_readings():
    rng = np.random.default_rng(8)
    model = np.log(rng.dirichlet(np.ones(toxicity.K), (toxicity.K, toxicity.K))).astype("f4")
    letters = "abils13!|6.-$é%"
    for _ in range(400):
        token = "".join(rng.choice(list(letters), rng.integers(1, 10)))
        token = re.sub(r"(.)\1{2,}", r"\1\1", token)
        every = all_readings(token, model)
        if every:
            got = toxicity.decode(token, model)
            assert got in every and every[got] >= max(every.values()) - 1e-4, token


def test_query_equals_plain_python(spark):
    """Counts, odds and scores of the whole table, made row by row; nulls, repeats and ties among the rows."""
    rows, labels = toxic_rows()
    rows = rows[:400] + [(9_000, None), (9_001, ""), (9_002, "an 1d10t here"), (9_003, "pathetic"), (9_003, "pathetic"), (9_004, "pathetic moron idiot")]
    labels = labels[:400] + [(9_001, 1), (9_001, 0)]
    docs = spark.createDataFrame(rows, DOCS)
    trained = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = sorted((r.doc_id, r.score, r.predicted) for r in toxicity.score(docs, trained).collect())
    learn = lambda i: zlib.crc32(str(i).encode()) % 5 != 0
    n = plain_model([t for i, t in rows if learn(i)])
    one = (n.sum((0, 1)) + 1) / (n.sum() + toxicity.K)
    two = (n.sum(0) + 5 * one) / (n.sum(0).sum(1, keepdims=True) + 5)
    # texts meet at two blanks in the operator, at their own ends here: a boundary more or less
    assert np.allclose(np.exp(trained["model"])[1:, 1:, 1:], ((n + 5 * two) / (n.sum(2, keepdims=True) + 5))[1:, 1:, 1:], rtol=0.2, atol=0.02)
    toxic = {}
    for i, y in labels:
        toxic[i] = max(toxic.get(i, 0), y)
    words = lambda t: {w for k in toxicity.tokens_of(t) for w in (toxicity.spaced(k[1:], trained["model"]) if k[0] == "\x00" else toxicity.readings(k, trained["model"]))}
    parts = lambda w: ["=" + w, *(w[:k] for k in range(3, 7) if len(w) > k)]
    bad = good = 0
    seen = collections.Counter()
    for i, t in rows:
        if i in toxic and learn(i):
            bad, good = bad + toxic[i], good + 1 - toxic[i]
            seen.update({(f, toxic[i]) for w in words(t) for f in parts(w)})
    weights = {f: math.log((k + 0.1) / (bad + 1)) - math.log((seen[f, 0] + 0.5) / (good + 1)) for (f, y), k in seen.items() if y and k >= toxicity.SUPPORT}
    weights = {f: w for f, w in weights.items() if w > toxicity.LEAST}
    assert weights.keys() == trained["weights"].keys() and all(math.isclose(w, trained["weights"][f]) for f, w in weights.items())

    def top(t):
        each = sorted((max([0.0, *(weights.get(f, 0.0) for w in (toxicity.readings(k, trained["model"]) if k[0] != "\x00" else {k[1:], *toxicity.spaced(k[1:], trained["model"])}) for f in parts(w))]) for k in toxicity.tokens_of(t)), reverse=True)
        return (*each, 0.0, 0.0)[:2]

    a, b, c = trained["curve"]
    want = []
    for i, t in rows:
        x, y = top(t)
        p = 1 / (1 + math.exp(-(a * x + b * y + c)))
        want.append((i, p, int(p >= 0.5)))
    for x, y in zip(got, sorted(want)):
        assert x[0] == y[0] and x[2] == y[2] and math.isclose(x[1], y[1], rel_tol=1e-9, abs_tol=1e-12)


def test_very_long_disguises_and_texts(spark):
    rows, labels = toxic_rows()
    hidden = ["m" + "o" * 1_000 + "ron", "i" + "." * 1_000 + "diot", " ".join("idiot") + " " + " ".join("word" * 400), "plain words " * 100_000 + "moron", "x" * 200_000 + " idiot"]
    docs = spark.createDataFrame(rows + [(10_000 + i, t) for i, t in enumerate(hidden)] + [(20_000, "plain words " * 100_000), (20_001, "x1" * 100_000)], DOCS)
    got = toxicity.score(docs, toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))).where("doc_id >= 10000").collect()
    p = {r.doc_id: r.predicted for r in got}
    assert [p[10_000 + i] for i in range(len(hidden))] == [1] * len(hidden) and p[20_000] == p[20_001] == 0
