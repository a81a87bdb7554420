"""Language of whole texts by cross-parsing entropy.

A language's model is the suffix automaton of a bounded sample of its labelled
texts. A text is parsed against each automaton into phrases, each the longest
match from where it begins (or one byte that the sample hasn't). The language
that needs the fewest phrases, normalised to bits per byte as
``phrases * log2(sample bytes + 1) / text bytes``, wins; ties go to the
language that sorts first.

Texts are lower-cased and read as UTF-8 bytes, ASCII that isn't a letter being a
blank, and runs of blanks one. Every text is read whole, in stretches of
``STRETCH`` bytes at each of which a phrase begins; the stretches of many texts
are walked through the automata side by side, a byte a step, in numpy.

The sample is of pieces of training texts by hash: of each language ``TEXTS``
distinct texts, and pieces of these up to ``SAMPLE`` bytes of all languages
together and ``LANGUAGE`` of one. So what is broadcast doesn't grow with the table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import aside, crc_mod, table

FOLDS, HELD_OUT = 4, 2
#: Distinct training texts of a language, characters of a piece, bytes of samples of one language and of all.
TEXTS, PIECE, LANGUAGE, SAMPLE = 512, 256, 96_000, 512_000
STRETCH, GROUP_BYTES, SPAN = 1_024, 8 << 20, 32
UNKNOWN = "und"

#: Codes of bytes: 0 blank, then letters and bytes of other scripts. BREAK stands between pieces and never in a text.
BREAK = 256
_BLANK = np.array([not (97 <= b <= 122 or b >= 128) for b in range(256)])


def sample(train: DataFrame) -> list[tuple[str, list[str]]]:
    """Pieces of texts by language, in order of language and hash. train: lang and text, neither null. Copies of a text count once."""
    best = lambda df, by, most, *within: df.withColumn("_rank", F.row_number().over(Window.partitionBy("lang", *within).orderBy(*by))).where(F.col("_rank") <= most).drop("_rank")
    keyed = train.select("lang", "text", F.xxhash64("text").alias("h"))
    # first inside parts of a language, so that no task takes more than TEXTS rows from each part
    keys = best(best(keyed.select("lang", "h", F.pmod("h", F.lit(TEXTS)).alias("_part")).distinct(), ["h"], TEXTS, "_part"), ["h"], TEXTS).drop("_part")
    texts = keyed.join(F.broadcast(keys), ["lang", "h"]).groupBy("lang", "h").agg(F.min("text").alias("text"))
    pieces = texts.select("lang", "h", F.posexplode(F.regexp_extract_all(F.lower("text"), F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))).alias("at", "piece")).where(F.col("piece").rlike("\\p{L}"))
    rows = best(pieces, [F.xxhash64("h", "at"), "h", "at"], LANGUAGE // PIECE).collect()  # at most LANGUAGE characters of each language
    by_lang: dict[str, list[str]] = {}
    for r in rows:
        by_lang.setdefault(r.lang, []).append(r.piece)
    most = max(PIECE, SAMPLE // max(1, len(by_lang)))
    return [(lang, by_lang[lang][: max(1, most // PIECE)]) for lang in sorted(by_lang)]


def as_codes(raw: np.ndarray) -> np.ndarray:
    """Bytes with blanks as 0, of a run of blanks the first alone."""
    blank = _BLANK[raw]
    codes = np.where(blank, 0, raw)
    keep = ~blank
    keep[:1] = True
    keep[1:] |= ~blank[:-1]
    return codes[keep]


class Automaton:
    """Suffix automaton of a sequence of codes: ``next[state]`` by code."""

    def __init__(self, codes):
        self.next: list[dict[int, int]] = [{}]
        length, link, last = [0], [-1], 0
        for c in codes:
            own, p = len(self.next), last
            self.next.append({})
            length.append(length[last] + 1)
            link.append(0)
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = own
                p = link[p]
            if p >= 0:
                q = self.next[p][c]
                if length[q] != length[p] + 1:
                    twin = len(self.next)
                    self.next.append(dict(self.next[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and self.next[p].get(c) == q:
                        self.next[p][c] = twin
                        p = link[p]
                    link[q] = twin
                    q = twin
                link[own] = q
            last = own


class Parser:
    """Counts the phrases of many texts against the automata of all languages at once."""

    def __init__(self, samples: list[tuple[str, list[str]]]):
        self.langs = [lang for lang, _ in samples]
        trained = []
        for _, pieces in samples:
            codes = []
            for p in pieces:
                codes += [*as_codes(np.frombuffer(p.encode("utf-8", "replace"), "u1")).tolist(), BREAK]
            trained.append(codes)
        self.bits = np.log2([len(c) + 1 for c in trained])
        known = sorted({c for codes in trained for c in codes} - {BREAK})
        self.width = len(known) + 1  # the last column is that of bytes that no sample has
        self.column = np.full(256, len(known), "i4")
        self.column[known] = np.arange(len(known))
        tables, self.start, at = [], [], 0
        for codes in trained:
            t = self._table(Automaton(codes).next, at)
            self.start.append(at)
            tables.append(t)
            at += t.size
        self.table = np.concatenate(tables) if tables else np.empty(0, "i4")

    def _table(self, moves: list[dict[int, int]], at: int) -> np.ndarray:
        """Transitions as offsets of rows; where there is none, ~ the offset at which the byte begins a new phrase."""
        width, column = self.width, self.column.tolist()
        t = np.full((len(moves) + 1, width), -1, "i4")
        state, code, to = [], [], []
        for s, m in enumerate(moves):
            for c, target in m.items():
                if c != BREAK:
                    state.append(s)
                    code.append(column[c])
                    to.append(target)
        t[state, code] = to
        lone = len(moves)  # after a byte that the sample hasn't, which is a phrase
        fresh = np.where(t[0] < 0, lone, t[0])
        t = np.where(t < 0, ~(at + fresh * width), at + t * width)
        t[0] = at + fresh * width
        return t.astype("i4").ravel()

    def phrases(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Phrases [language, text] and the bytes that each text has when runs of blanks are one."""
        coded = [as_codes(np.frombuffer(x, "u1")) for x in texts]
        sizes = np.array([len(c) for c in coded], "i8")
        codes = self.column[np.concatenate(coded)] if len(coded) else np.empty(0, "i4")
        first = np.cumsum(sizes) - sizes
        n = -(-sizes // STRETCH)
        owner = np.repeat(np.arange(len(texts)), n)
        place = (np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)) * STRETCH
        length = np.minimum(sizes[owner] - place, STRETCH)
        begin = first[owner] + place
        order = np.argsort(-length, kind="stable")
        owner, length, begin = owner[order], length[order], begin[order]
        state = np.repeat(np.array(self.start, "i8")[:, None], len(owner), 1)
        ended = np.zeros(state.shape, "i8")
        longer = np.searchsorted(-length, -np.arange(int(length.max(initial=0))), "left")  # lanes that have a byte at each step
        for t, k in enumerate(longer.tolist()):
            to = self.table.take(state[:, :k] + codes[begin[:k] + t])
            sign = to >> 31
            ended[:, :k] -= sign
            state[:, :k] = to ^ sign
        return np.stack([np.bincount(owner, e + 1, len(texts)) for e in ended]) if len(self.langs) else np.zeros((0, len(texts))), sizes

    def __call__(self, texts: list[bytes]) -> tuple[list[str], list[float]]:
        """Language and score of each text; of none if there are no languages."""
        if not self.langs:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        found, sizes = self.phrases(texts)
        cost = found * self.bits[:, None] / np.maximum(sizes, 1)
        best = cost.argmin(0)
        odds = np.exp2(-(cost - cost.min(0)) * np.minimum(sizes, SPAN))
        return [self.langs[i] for i in best], (1 / odds.sum(0)).tolist()


_parsers: dict[int, Parser] = {}


def _parser(shared) -> Parser:
    """One per Python worker and model."""
    if shared.value[0] not in _parsers:
        _parsers.clear()
        _parsers[shared.value[0]] = Parser(shared.value[1])
    return _parsers[shared.value[0]]


def identify(docs: DataFrame, samples: list[tuple[str, list[str]]]) -> DataFrame:
    """docs with lang_pred and score: the language whose automaton parses the text into the fewest bits, and its share of 2^-bits over all languages, taken over at most SPAN bytes.

    A text that is null or has no letter is ``und`` with score 0, and so is every
    text if there is no language. Copies of a text have the same result.
    """
    spark = docs.sparkSession
    own, back = aside(docs, "lang_pred", "score")
    shared = spark.sparkContext.broadcast((hash(str(samples)), samples))
    kept = own.columns
    schema = own.schema.add("lang_pred", "string").add("score", "double")

    def parsed(batches):
        parse = _parser(shared)
        for b in batches:
            texts = b.column(b.num_columns - 1).to_pylist()
            langs, scores, at = [UNKNOWN] * len(texts), [0.0] * len(texts), 0
            while at < len(texts):
                some, size = [], 0
                while at < len(texts) and size < GROUP_BYTES:
                    if texts[at] is not None:
                        some.append(at)
                        size += len(texts[at])
                    at += 1
                for i, lang, score in zip(some, *parse([texts[i] for i in some])):
                    langs[i], scores[i] = lang, score
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*b.schema.names[:-1], "lang_pred", "score"])

    lower = F.when(F.col("text").rlike("\\p{L}"), F.lower("text").cast("binary"))
    return own.select(*kept, lower.alias("its lower-cased bytes")).mapInArrow(parsed, schema).withColumnsRenamed(back)


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole text of documents, learned from the labels outside the held-out fold.

    Repeated rows are rows; a null lang is never learned; an empty table has no
    rows; other columns are ignored.
    """
    docs = table(spark, sf_dir, "documents")
    fold = crc_mod(F.col("doc_id"), FOLDS)
    samples = sample(docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold != HELD_OUT)).select("lang", "text"))
    rows = docs.select("doc_id", (fold == HELD_OUT).alias("held_out"), "text")
    return identify(rows, samples).drop("text")
