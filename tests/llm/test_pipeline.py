"""The pipeline against a brute-force version of each stage, and its edge cases."""

import collections
import os
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from circlet.llm import toxicity

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def fold(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def plain_lines(docs):
    key = lambda x: fold(x.strip(" \t\n\x0b\x0c\r"))
    held = collections.defaultdict(set)
    for i, t in docs:
        for x in (t or "").split("\n"):
            if i is not None and len(key(x)) >= 40:
                held[key(x)].add(i)
    lost = lambda i, x: i is not None and len(held[key(x)]) >= 5 and i != max(held[key(x)])
    return [(i, t if not any(lost(i, x) for x in (t or "").split("\n")) else "\n".join(x for x in t.split("\n") if not lost(i, x))) for i, t in docs]


def plain_near(docs):
    """Of each group that is closed over a similarity of 0.8 the smallest doc_id's row; a doc_id's several texts are documents."""
    def shingles(t):
        w = re.findall("[^\\x20\\x09-\\x0D]+", fold(t))
        return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) or frozenset([tuple(w)] if w else [])

    sets = [shingles(t) for _, t in docs]
    root = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            if root[i] != root[j]:
                both = len(sets[i] & sets[j])
                if sets[i] == sets[j] or 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both) and both:
                    a, b = sorted((root[i], root[j]))
                    root = [a if r == b else r for r in root]
    best = {}
    for r, (i, t) in zip(root, docs):
        if i is not None and (r not in best or i < best[r][0]):
            best[r] = (i, t)
    return {i for i, _ in best.values()}


def plain_clean(docs, items):
    words = lambda t: re.findall("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", fold(t))
    windows = collections.defaultdict(set)
    for t in items:
        w = words(t)
        n = min(10, len(w))
        for k in range(len(w) - n + 1) if n else ():
            windows[n].add(tuple(w[k : k + n]))
    hit = lambda w: any(tuple(w[k : k + n]) in held for n, held in windows.items() for k in range(len(w) - n + 1))
    return [(i, t) for i, t in docs if not hit(words(t))]


def rows(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_stages_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    stages = [step for _, step in corpus_pipeline.STAGES]
    one = stages[0](spark, docs, SF)
    toxic = {r.doc_id for r in toxicity.score(docs, toxicity.train(docs, labels)).where("predicted = 1").collect()}
    assert {r.doc_id for r in one.collect()} == {r.doc_id for r in docs.collect()} - toxic
    two = stages[1](spark, one, SF)
    assert sorted(rows(two)) == sorted(plain_lines(rows(one)))
    three = stages[2](spark, two, SF)
    assert {i for i, _ in rows(three)} == plain_near(sorted(rows(two)))
    four = stages[3](spark, three, SF)
    assert sorted(rows(four)) == sorted(plain_clean(rows(three), items))
    five = stages[4](spark, four, SF).toPandas()
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    t.encode_special_tokens = True
    want = []
    for i, x in rows(four):
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(i, k, 4096 * k, len(ids[4096 * k : 4096 * k + 4096]), zlib.crc32(ids[4096 * k : 4096 * k + 4096].tobytes())) for k in range(-(-len(ids) // 4096))]
    assert sorted(five[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None)) == sorted(want)
    for _, g in five.sort_values("offset").groupby("sequence_id"):
        assert (g.offset.to_numpy() == np.concatenate(([0], g.length.cumsum()[:-1]))).all() and g.length.sum() <= 4096
    whole = corpus_pipeline.run(spark, SF).toPandas()
    assert sorted(whole[["doc_id", "piece", "ids_crc32"]].itertuples(index=False, name=None)) == sorted((i, k, c) for i, k, _, _, c in want)


def test_odd_rows_pass_every_stage(spark):
    """Nulls in any column, empty and very long texts, repeated rows and doc_ids, clashing names."""
    texts = ["plain words of a short text", None, "", "word " * 60_000, "line one of many lines\n" * 3000]
    data = [(i, t, "en", "s", 1) for i, t in enumerate(texts)] + [(0, texts[0], "en", "s", 1), (0, "another text of this number", None, None, None), (None, "no number", None, "s", None), (None, None, None, None, None)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
    clash = ["score", "predicted", "t1", "t2", "places", "lines", "n_lines", "keeper", "mark", "hash of text", "fp", "key", "h", "at"]
    docs = docs.withColumns({c: F.lit("own") for c in clash})
    for name, step in corpus_pipeline.STAGES[:-1]:
        out = step(spark, docs, SF)
        assert out.columns == docs.columns, name
        kept = out.collect()
        assert all(r[c] == "own" for r in kept for c in clash), name
        texts_left = collections.Counter(r.text for r in kept)
        assert texts_left[texts[3]] == texts_left[texts[4]] == 1 and texts_left["no number"] == 1, name
        assert step(spark, docs.where("false"), SF).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).where("length = 0").count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs.where("false"), SF).count() == 0
