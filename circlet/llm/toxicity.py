"""Toxicity of texts behind disguises: a noisy-channel decoder, then a classifier.

A character trigram model is counted over all training documents. A token that
hides letters (digits and signs for letters, separators between letters,
letters repeated, letters spaced out) becomes a lattice of readings; Viterbi
decoding under the model picks the likeliest, and the restored word is scored.
The classifier weighs words and their beginnings by smoothed log odds learned
from a bounded sample of labelled training documents, and a logistic curve over
a document's two weightiest words gives the score.
"""

from __future__ import annotations

import re
from collections import Counter
from math import exp, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_mod, stage, table
from .tokens import groups

FOLDS = 5
#: Most labelled rows that the classifier learns from; if there are more, those of the smallest hashes of doc_id.
SAMPLE = 20_000
#: A feature is in at least SUPPORT toxic documents of the sample, and its odds are at least e to 1; so there are at most a fifth as many as the sample's toxic documents have words and beginnings.
SUPPORT, LEAST = 5, 1.0
#: Letters of the character model: all others are boundaries (class 0).
LETTERS = "abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïñòóôõöøùúûüýÿœ"
K = len(LETTERS) + 1
_CLASS = {c: i + 1 for i, c in enumerate(LETTERS)}
#: What a sign may stand for (fixed values).
SIGNS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i", "%": "x"}
EDGE = ".,;:!?\"'()[]{}<>|*#&%$@~^_=+-/\\`«»“”„…"
SIGN_COST, DROP_COST, REPEAT_COST = 1.0, 0.6, 0.4
_REPEATED = re.compile(r"(.)\1")
_RUNS = re.compile(r"(.)\1{2,}")
_SPACED = re.compile(r"(?<!\S)(?:[^\s\w]?\w[^\s\w]?[ \t]+){2,}[^\s\w]?\w[^\s\w]?(?!\S)")


def count_trigrams(docs: DataFrame) -> DataFrame:
    """code, n: counts of character trigrams over whole texts, whose number is bounded by the alphabet."""
    known = np.zeros(0x180, dtype="i8")
    for c, i in _CLASS.items():
        known[ord(c)] = i

    def run(batches):
        total = np.zeros(K**3, dtype="i8")
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in groups(texts, 1 << 20):
                text = "  ".join(x for x in texts[a:b] if x).lower()
                for s in range(0, len(text), 1 << 20):
                    cp = np.frombuffer(f" {text[max(0, s - 1) : s + (1 << 20)]} ".encode("utf-32-le", "surrogatepass"), dtype="<u4")
                    x = np.where(cp < 0x180, known[np.minimum(cp, 0x17F)], 0)
                    total += np.bincount((x[:-2] * K + x[1:-1]) * K + x[2:], minlength=K**3)
        code = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(total[code])], names=["code", "n"])

    return docs.select("text").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def char_model(counts: list[tuple[int, int]]) -> np.ndarray:
    """Log probabilities [a, b, c] of c after a, b; trigrams back off to bigrams and letters."""
    n = np.zeros(K**3)
    for code, times in counts:
        n[code] = times
    n = n.reshape(K, K, K)
    one = (n.sum((0, 1)) + 1) / (n.sum() + K)
    two = (n.sum(0) + 5 * one) / (n.sum(0).sum(1, keepdims=True) + 5)
    return np.log((n + 5 * two) / (n.sum(2, keepdims=True) + 5)).astype("f4")


def decode(token: str, model: np.ndarray, bounds: bool = False) -> str:
    """The likeliest reading of a disguised token, by Viterbi over pairs of letters.

    At each place the letter itself is read, a sign is read as a letter it may
    stand for, a sign is dropped, or a letter repeating the one before it is
    dropped. Runs of three or more of a letter enter as two. With bounds a word
    may also end at each place, which is read as a blank.
    """
    token = _RUNS.sub(r"\1\1", token)
    # a reading is kept as (reading before, letter), so a long token is not copied at each letter
    paths: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    for ch in token:
        after: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        readings = [(ch, 0.0)] if ch in _CLASS else [(x, SIGN_COST) for x in SIGNS.get(ch, "")]
        for (a, b), (score, text) in paths.items():
            for letter, cost in readings:
                c = _CLASS[letter]
                new = score + float(model[a, b, c]) - cost
                if new > after.get((b, c), (-1e30,))[0]:
                    after[b, c] = (new, (text, letter))
            drop = REPEAT_COST if ch in _CLASS and b == _CLASS[ch] else DROP_COST if ch not in _CLASS else None
            if drop is not None or not readings:
                new = score - (drop if drop is not None else DROP_COST)
                if ch not in SIGNS or ch in "!|+(%" or ch in _CLASS:
                    if new > after.get((a, b), (-1e30,))[0]:
                        after[a, b] = (new, text)
        if bounds:
            for (a, b), (score, text) in list(after.items()):
                new = score + float(model[a, b, 0])
                if b and new > after.get((b, 0), (-1e30,))[0]:
                    after[b, 0] = (new, (text, " "))
        paths = after or paths
    text, found = max(((score + float(model[a, b, 0]), text) for (a, b), (score, text) in paths.items()), key=lambda x: x[0])[1], []
    while text:
        text, letter = text
        found.append(letter)
    return "".join(reversed(found))


def disguised(core: str) -> bool:
    """Whether a token may hide letters: doubled letters, signs among letters, or signs alone. Digits alone are a number."""
    core = _RUNS.sub(r"\1\1", core)
    if len(core) < 3:
        return False
    if core.isalpha():
        return bool(_REPEATED.search(core))
    letters = sum(c.isalpha() for c in core)
    return letters >= 2 or sum(c in SIGNS for c in core) + letters == len(core) and not core.isdigit()


def spaced(joined: str, model: np.ndarray) -> set[str]:
    """The readings of a run of spaced-out letters: as one word, and as the words of a phrase."""
    return {decode(joined, model), *(w for w in decode(joined, model, True).split() if len(w) > 2)}


def readings(token: str, model: np.ndarray) -> tuple[str, ...]:
    """The plain form of a token and, if it is disguised, the restored one."""
    core = token.strip(EDGE)
    found = (core,) if core.isalpha() else ()
    # a sign at the edge may belong to the word
    whole = token if len(token) > len(core) and any(c in SIGNS for c in token) and any(c.isdigit() or c in "@$!|" for c in token[:1]) else core
    for x in {core, whole}:
        if x and disguised(x):
            word = decode(x, model)
            if len(word) > 2 and word not in found:
                found += (word,)
    return found


def features(word: str) -> list[str]:
    """The word and its beginnings of 3 to 6 letters."""
    return ["=" + word, *(word[:k] for k in range(3, 7) if len(word) > k)]


def tokens_of(text: str | None) -> set[str]:
    """Distinct tokens of a whole text, and runs of spaced-out single letters joined."""
    text = (text or "").lower()
    found = set(text.split())
    if len(text) > 4:
        for m in _SPACED.finditer(text):
            found.add("\x00" + "".join(m[0].split()))
    return found


class Scorer:
    """Weights of tokens, with a bounded cache; one for each task."""

    def __init__(self, model: np.ndarray, weights: dict[str, float], cache: int = 300_000):
        self.model, self.weights, self.limit, self.known = model, weights, cache, {}

    def weigh(self, token: str) -> float:
        get, best = self.weights.get, 0.0
        if token[0] == "\x00":
            token = token[1:]
            words = {token, *spaced(token, self.model)}
        else:
            words = readings(token, self.model)
        for word in words:
            for f in features(word):
                best = max(best, get(f, 0.0))
        return best

    def top(self, text: str | None) -> tuple[float, float]:
        """Weights of the two weightiest tokens; texts without one have 0."""
        known, first, second = self.known, 0.0, 0.0
        if len(known) > self.limit:
            known.clear()
        for t in tokens_of(text):
            w = known.get(t)
            if w is None:
                w = known[t] = self.weigh(t)
            if w > second:
                first, second = (w, first) if w > first else (first, w)
        return first, second


def _fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression with a little ridge, by Newton steps."""
    a = np.column_stack([x, np.ones(len(x))])
    w, ridge = np.zeros(a.shape[1]), np.diag([0.1] * x.shape[1] + [1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge, a.T @ (p - y) + ridge @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(docs: DataFrame, labels: DataFrame) -> dict:
    """The character model over all training documents, and the classifier from the labelled sample.

    Rows whose crc32(doc_id as text) mod 5 is 0 are never read for either.
    Labels without doc_id or toxic are skipped; of several for a document the
    largest counts. Without both kinds of labels every text scores the smoothed
    share of toxic ones.
    """
    spark = docs.sparkSession
    part = docs.where(crc_mod(F.col("doc_id"), FOLDS) != 0)
    model = char_model([(r.code, r.n) for r in count_trigrams(part).collect()])  # at most K**3 rows
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(crc_mod(F.col("doc_id"), FOLDS) != 0)
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    sample = stage(part.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("text", F.col("toxic").cast("int").alias("toxic")), "labelled")
    shared = spark.sparkContext.broadcast(model)

    def count(batches):
        held: Counter = Counter()
        rows = lambda: pa.RecordBatch.from_arrays([pa.array([k for k, _ in held]), pa.array([y for _, y in held], pa.int32()), pa.array(list(held.values()), pa.int64())], names=["feature", "toxic", "n"])
        for batch in batches:
            for text, y in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                words = set()
                for t in tokens_of(text):
                    words.update(spaced(t[1:], shared.value) if t[0] == "\x00" else readings(t, shared.value))
                held.update({(f, y) for w in words for f in features(w)})
                if len(held) > 300_000:
                    yield rows()
                    held.clear()
        if held:
            yield rows()

    totals = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    bad, good = totals.get(1, 0), totals.get(0, 0)
    base = log((bad + 0.5) / (good + 0.5))
    if not bad or not good:
        return {"model": model, "weights": {}, "curve": (0.0, 0.0, base)}
    n = sample.mapInArrow(count, "feature string, toxic int, n long").groupBy("feature").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("t"), F.sum(F.when(F.col("toxic") == 1, 0).otherwise(F.col("n"))).alias("c"))
    odds = F.log((F.col("t") + 0.1) / (bad + 1)) - F.log((F.col("c") + 0.5) / (good + 1))
    best = n.where(F.col("t") >= SUPPORT).select("feature", odds.alias("w")).where(F.col("w") > LEAST).collect()  # bounded by the sample
    weights = {r.feature: r.w for r in best}
    held = spark.sparkContext.broadcast(weights)

    def tops(batches):
        scorer = Scorer(shared.value, held.value)
        for batch in batches:
            top = [scorer.top(x) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in top], pa.float64()), pa.array([b for _, b in top], pa.float64()), batch.column("toxic")], names=["first", "second", "toxic"])

    rows = np.array([tuple(r) for r in sample.mapInArrow(tops, "first double, second double, toxic int").collect()], dtype="f8")  # at most SAMPLE rows
    return {"model": model, "weights": weights, "curve": tuple(_fit(rows[:, :2], rows[:, 2]))}


def score(docs: DataFrame, trained: dict) -> DataFrame:
    """docs and score double, predicted int, which replace columns of these names: one row for each row.

    Null and empty texts score as texts without weighty words. Equal texts have
    equal scores, whatever their doc_id; repeated rows stay rows, and a score of
    exactly one half is predicted 1. A token's reading, and so a score, depends
    on its text alone; of readings of equal probability the one met first counts.
    """
    docs = docs.drop("score", "predicted")
    shared = docs.sparkSession.sparkContext.broadcast(trained)
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches):
        t = shared.value
        scorer, (a, b, c) = Scorer(t["model"], t["weights"]), t["curve"]
        for batch in batches:
            p = [1 / (1 + exp(-max(-30.0, min(30.0, a * x + b * y + c)))) for x, y in map(scorer.top, batch.column("text").to_pylist())]
            arrays = [*batch.columns, pa.array(p, pa.float64()), pa.array([int(x >= 0.5) for x in p], pa.int32())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names, "score", "predicted"])

    return docs.mapInArrow(run, schema)


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the documents predicted toxic."""
    aside = {c: f"its own {c}" for c in docs.columns if c.lower() in ("score", "predicted")}
    kept = score(docs.withColumnsRenamed(aside), train(docs, labels)).where("predicted = 0").drop("score", "predicted")
    return kept.withColumnsRenamed({new: old for old, new in aside.items()})


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(docs, train(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic")))
    return out.select("doc_id", (crc_mod(F.col("doc_id"), FOLDS) == 0).alias("held_out"), "score", "predicted")
