"""Language identification against a plain parse by substring search, and held-out accuracy."""

import math
import os
import re
import zlib

import pytest

from circlet.llm import language_id as m

SF = "/root/testdata/sf0.001"


def plain_codes(text: str) -> bytes:
    raw = bytes(b if 97 <= b <= 122 or b >= 128 else 0 for b in text.lower().encode())
    return re.sub(b"\0+", b"\0", raw)


def plain_phrases(text: bytes, pieces: list[bytes]) -> int:
    count = 0
    for at in range(0, len(text), m.STRETCH):
        block = text[at : at + m.STRETCH]
        i = 0
        while i < len(block):
            n = 1
            while i + n <= len(block) and any(block[i : i + n] in p for p in pieces):
                n += 1
            i += max(1, n - 1)
            count += 1
    return count


def plain_language(text: str | None, samples):
    if not any(c.isalpha() for c in text or ""):
        return "und", 0.0
    codes = plain_codes(text)
    cost = []
    for lang, pieces in samples:
        known = [plain_codes(p) for p in pieces]
        cost.append((plain_phrases(codes, known) * math.log2(sum(len(k) + 1 for k in known) + 1) / len(codes), lang))
    low, lang = min(cost)
    return lang, 1 / sum(2 ** -((c - low) * min(len(codes), m.SPAN)) for c, _ in cost)


TEXTS = [
    "the cat sat on the mat", "die Katze sitzt", "", None, "12 34 !?", "Ünïcödé ß ÉTÉ", "é", "語 漢字", "q" * 50, "  the\n\n cat  ", "z",
    "the cat and the hat on the mat. " * 90, "x" * 3000, "😀 the", "The Katze the Katze",
]
SAMPLES = [("de", ["die katze sitzt auf der matte und", "der hund ist gro"]), ("en", ["the cat sat on the mat and the hat", "of the house"]), ("fr", ["été le chat est"])]


def test_against_plain_parse(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)] + [(0, TEXTS[0])], "doc_id long, text string").selectExpr("*", "'own' as Score")
    got = sorted((r[0], r.lang_pred, r[4]) for r in m.identify(docs, SAMPLES).collect())
    want = sorted((i, *plain_language(t, SAMPLES)) for i, t in [*enumerate(TEXTS), (0, TEXTS[0])])
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert [g[2] for g in got] == pytest.approx([w[2] for w in want])
    assert {r[2] for r in m.identify(docs, SAMPLES).collect()} == {"own"}


def test_automaton_has_all_substrings_and_no_others():
    codes = list(b"abracadabra abra")
    moves = m.Automaton(codes).next

    def walks(x):
        s = 0
        for c in x:
            if c not in moves[s]:
                return False
            s = moves[s][c]
        return True

    for i in range(len(codes)):
        for j in range(i + 1, len(codes) + 1):
            assert walks(codes[i:j])
    assert not any(walks(x) for x in (b"aa", b"abrab", b"dabrac", b" abrac"))


def test_no_labels_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "some text"), (None, None)], "doc_id long, text string")
    assert m.sample(docs.limit(0).selectExpr("'x' as lang", "text")) == []
    assert {(r.doc_id, r.lang_pred, r.score) for r in m.identify(docs, []).collect()} == {(1, "und", 0.0), (None, "und", 0.0)}
    assert m.identify(docs.limit(0), SAMPLES).count() == 0


def test_sample_is_bounded_and_doesnt_depend_on_partitions(spark):
    train = spark.range(3_000).selectExpr("if(id % 3 = 0, 'a', 'b') as lang", "repeat(concat('text ', id % 900, ' '), 50) as text")
    one = m.sample(train.repartition(1))
    assert one == m.sample(train.repartition(7))
    assert [lang for lang, _ in one] == ["a", "b"]
    assert all(sum(map(len, p)) <= m.LANGUAGE for _, p in one)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_held_out_accuracy(spark):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    rows = m.op12_language_id(spark, SF).collect()
    assert len(rows) == len(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.97 * len(held)
