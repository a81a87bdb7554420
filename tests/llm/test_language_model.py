"""The gated language model: gradients, lanes, counts and scores against plain Python, and independence of partitions."""

import collections
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from circlet.llm import language_model
from circlet.llm.common import stage

DOCS = "doc_id long, text string"


def docs_of(spark, texts, extra=False):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], DOCS)
    return df.withColumns({c: F.lit(1) for c in ("key", "row", "ids", "words", "score", "n_tokens")}) if extra else df


def vocabulary_of(n=200, count=300):
    return language_model.Vocabulary([(f"w{i}", count - i) for i in range(n)], 5, {}, 50_000, n + 1)


def test_gradients():
    v = vocabulary_of()
    w = {k: x.astype("f8") for k, x in language_model.start_weights(v).items()}
    net = language_model.Network(w, v.n_soft)
    rng = np.random.default_rng(0)
    shape, n = (5, 3), v.n_soft + language_model.ENDINGS
    inp, tgt, reset, mask = rng.integers(0, v.first + 1, shape), rng.integers(0, n, shape), rng.random(shape) < 0.2, rng.random(shape) < 0.9
    h = rng.normal(size=(3, language_model.HIDDEN))

    def loss():
        hs, _, _ = net.states(inp, reset, h)
        return -net.outputs(hs.reshape(-1, language_model.HIDDEN)[mask.ravel()], tgt.ravel()[mask.ravel()])[0].mean()

    _, g, _ = net.gradients(inp, tgt, reset, mask, h)
    for k, x in w.items():
        for i in np.argsort(-np.abs(g[k]).ravel())[:3]:
            flat, old = x.ravel(), x.ravel()[i]
            flat[i] = old + 1e-4
            up = loss()
            flat[i] = old - 1e-4
            down = loss()
            flat[i] = old
            assert abs((up - down) / 2e-4 - g[k].ravel()[i]) < 1e-6, k


@pytest.mark.parametrize("most", [1, 2, 50])
def test_lanes_read_every_token_once(most):
    v = vocabulary_of(20)
    texts = [np.arange(1, 1 + n, dtype="u2") % 20 for n in [1, 70, 5, 200, 33, 2, 0]]
    seen = collections.defaultdict(list)
    state: dict[int, int] = {}
    for inp, tgt, reset, number in language_model.lanes(texts, v, most):
        for k in range(inp.shape[1]):
            for t in range(inp.shape[0]):
                if (i := number[t, k]) >= 0:
                    assert reset[t, k] == (not seen[i]) and inp[t, k] == (texts[i][len(seen[i]) - 1] if seen[i] else v.first)
                    assert state.setdefault(i, k) == k  # a text stays in its lane, whose state is carried
                    seen[i].append(tgt[t, k])
    assert {i: list(x) for i, x in enumerate(texts) if len(x)} == dict(seen)


def plain_score(ids, v, w):
    """log10 probability of a text by the recurrence, one token at a time, in double precision."""
    w = {k: x.astype("f8") for k, x in w.items()}
    h, last, total = np.zeros(language_model.HIDDEN), v.first, 0.0
    softmax = lambda x: np.exp(x - x.max()) / np.exp(x - x.max()).sum()
    for i in ids:
        x = w["e"][:, last] + w["b"]
        z, r = (1 / (1 + np.exp(-(x[g] + h @ w["u"][g]))) for g in (0, 1))
        cand = np.tanh(x[2] + r * (h @ w["u"][2]))
        h = (1 - z) * cand + z * h
        t, size = v.target[i], w["bi"].shape[1]
        c = t // size if t < v.n_soft else language_model.CLASSES + t - v.n_soft
        total += math.log10(softmax(h @ w["wc"] + w["bc"])[c])
        if t < v.n_soft:
            total += math.log10(softmax(h @ w["wi"][c] + w["bi"][c])[t % size])
        last = i
    return total


def test_scores_equal_a_plain_recurrence():
    v = language_model.Vocabulary([(f"w{i}", 9000 - i) for i in range(6000)], 50, {e: (40, 7) for e in range(16)}, 10_000_000, 7000)
    rng = np.random.default_rng(3)
    w = {k: (x + rng.normal(0, 0.3, x.shape) * (np.abs(x) < 1e3)).astype("f4") for k, x in language_model.start_weights(v).items()}
    texts = [rng.integers(0, v.first, n).astype("u2") for n in (1, 5, 200, 33, 64, 2)]
    got = language_model.log_probabilities(texts, v, language_model.Network(w, v.n_soft))
    assert np.allclose(got, [plain_score(x.tolist(), v, w) for x in texts], rtol=1e-5)


def two_kinds(n=400, seed=6):
    rng = np.random.default_rng(seed)
    vocab = [[f"{p}{i}" for i in range(30)] for p in "ab"]
    return [" ".join(rng.choice(vocab[i % 2], 40)) for i in range(n)]


@pytest.mark.parametrize("head", [language_model.HEAD, 30])
def test_query_equals_plain_counts(spark, monkeypatch, head):
    """Nulls, empty and long texts, unseen and overlong words, clashing columns."""
    monkeypatch.setattr(language_model, "HEAD", head)
    texts = two_kinds() + [None, "", "A0\x0bunseen word", "a1 " * 3000, "x" * 500 + " a1", "x" * 500, "\ud7ff\x00 a\u00e9 \u65e5"]
    got = {r.doc_id: r for r in language_model.score_documents(docs_of(spark, texts, True)).collect()}
    split = {i: (t or "").encode().translate(language_model.LOWER_AZ).split() for i, t in enumerate(texts)}
    counts, ends = collections.Counter(), 0
    for i, w in split.items():
        if zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update(w)
            ends += 1
    total, distinct = sum(counts.values()) + ends, len(counts) + 1
    for i, w in split.items():
        r = got[i]
        base = sum(math.log10((counts[x] + 1) / (total + distinct + 1)) for x in w) + math.log10((ends + 1) / (total + distinct + 1))
        assert math.isclose(r.base_score, base, rel_tol=1e-9, abs_tol=1e-9) and r.n_known == sum(x in counts for x in w) + 1
        assert (r.n_tokens, r.train_tokens, r.held_out) == (len(w) + 1, total, zlib.crc32(str(i).encode()) % 7 == 2)
        assert math.isfinite(r.score) and r.score <= 0
    held = [r for i, r in got.items() if r.held_out and i < 400]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_score_is_the_models_probability(spark):
    """The query's score of whole documents, by the plain recurrence and the shares of words beyond the inner softmax."""
    texts = two_kinds(300) + ["unseen a1 unseen", "b2"]
    docs = docs_of(spark, texts)
    learn = docs.where(language_model.crc_mod(F.col("doc_id"), 7) != 2)
    v, beyond = language_model.vocabulary(stage(language_model.word_counts(learn), "words"), learn.count())
    read = stage(language_model.read_texts(docs, v), "read")
    w = language_model.train(read.where("words is null").where(language_model.crc_mod(F.col("doc_id"), 7) != 2), v)
    again = {r.doc_id: r.score for r in language_model.score_documents(docs.repartition(5, "text")).collect()}
    for r in read.where("words is null").collect():
        if r.doc_id % 20 == 0 or r.doc_id >= 300:
            want = plain_score(np.frombuffer(r.ids, "u2").tolist(), v, w) - sum(v.rare_z[language_model._ending(x.encode())] for x in texts[r.doc_id].split() if x not in set(v.words.to_pylist()))
            assert math.isclose(again[r.doc_id], want, rel_tol=1e-4), r.doc_id


def test_scores_do_not_depend_on_partitions(spark):
    docs = docs_of(spark, two_kinds(500) + [None, "", "a1 a1", "a1 a1"])
    one, many = ({r.doc_id: r.score for r in language_model.score_documents(df).collect()} for df in (docs.coalesce(1), docs.repartition(8)))
    assert one.keys() == many.keys() and all(math.isclose(one[i], many[i], rel_tol=1e-6) for i in one)


@pytest.mark.parametrize("shards, hot", [(1, 10_000), (40, 10_000), (40, 3)])
def test_training_reads_every_document_once(spark, monkeypatch, shards, hot):
    monkeypatch.setattr(language_model, "HOT", hot)
    v = vocabulary_of(50)
    docs = spark.createDataFrame([(i, f"w{i % 60} x") for i in range(300)] + [(7, "hot w1")] * 200 + [(None, None), (3, "")], DOCS)
    read = stage(language_model.read_texts(docs, v), "read").where("words is null")
    dealt = language_model.dealt(read, shards, 2).collect()
    assert sorted(r.ids for r in dealt) == sorted(r.ids for r in read.collect())
    assert {r.round for r in dealt} == {0, 1} and len({r.shard for r in dealt}) <= shards
    if hot == 3:  # copies of one row are spread
        most = collections.Counter((r.round, r.shard) for r in dealt).most_common(1)[0][1]
        assert most < 60
    v.total = 1502
    w = language_model.train(read, v, 2, max(1, 1502 // shards // 2))  # 40 shards are averaged in two steps
    assert all(np.isfinite(x).all() for x in w.values())


def test_language_model_of_no_documents(spark):
    assert language_model.score_documents(spark.createDataFrame([], DOCS)).count() == 0
    only = spark.createDataFrame([(i, "x y") for i in range(40) if zlib.crc32(str(i).encode()) % 7 == 2], DOCS)
    assert all(r.train_tokens == 0 and r.base_score == 0 for r in language_model.score_documents(only).collect())


def test_training_reads_documents_as_they_are(monkeypatch):
    """In training only a document's first token follows the start symbol and an empty state, however long it is; a window after another has the state that this left."""
    v = vocabulary_of(3)
    texts = [np.array([1 + (i * i) % 3 for i in range(n)] + [0], dtype="u2") for n in (5 * language_model.STEPS * 100, 7)]
    seen = []
    real = language_model.Network.gradients

    def watched(self, inp, tgt, reset, mask, h):
        loss, g, after = real(self, inp, tgt, reset, mask, h)
        seen.append((int(reset.sum()), int(((inp == v.first) & mask).sum()), h.copy(), after.copy()))
        return loss, g, after

    monkeypatch.setattr(language_model.Network, "gradients", watched)
    language_model._train_shard(v, language_model.start_weights(v), [texts], sum(map(len, texts)))
    assert sum(r for r, *_ in seen) == sum(s for _, s, *_ in seen) == len(texts)
    for (_, _, _, after), (_, _, before, _) in zip(seen, seen[1:]):
        assert np.array_equal(after[: before.shape[0]], before)
