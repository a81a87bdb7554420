"""Sequences that are compared many at a time, and texts cut in one pass."""

import random

import pandas as pd

from circlet.functions import text
from circlet.plans import adapters


def edits(x, y):
    """The last row of the table of edits, letter by letter."""
    last = list(range(len(y) + 1))
    for i, c in enumerate(x, 1):
        row = [i]
        for j, d in enumerate(y, 1):
            row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (c != d)))
        last = row
    return last


def common(x, y):
    best = (0, 0, 0)
    for n in range(min(len(x), len(y)), 0, -1):
        for i in range(len(x) - n + 1):
            j = y.find(x[i : i + n])
            if j >= 0:
                return i, j, n
    return best


def first_place(x, y):
    for i in range(len(y) - len(x) + 1 if x and y else 0):
        if sum(c != d for c, d in zip(x, y[i:])) <= 0.1 * len(x):
            return i
    return -1


def some_pairs():
    draw = random.Random(5)
    made = lambda letters: "".join(draw.choice(letters) for _ in range(draw.choice((1, 2, 9, 30, 63, 64, 65, 70))))
    pairs = [(made(a), made(a)) for a in ("AC", "ACGT", "Aé😀\0") for _ in range(25)]
    pairs += [(y[5:25], y) for _, y in pairs] + [("", "A"), ("A", ""), ("", ""), ("AC" * 600, "CAC"), ("CAC", "AC" * 600)]
    return pd.Series([x for x, _ in pairs]), pd.Series([y for _, y in pairs])


def test_blocks_equal_pairs():
    a, b = some_pairs()
    want = [edits(x, y) for x, y in zip(a, b)]
    assert text.edit_distance.func(a, b).tolist() == [w[-1] for w in want]
    assert text.semi_global_distance.func(a, b).tolist() == [min(w) / len(x) if x else 0.0 for x, w in zip(a, want)]
    assert [tuple(r) for r in text.common_substring.func(a, b).itertuples(index=False)] == [common(x, y) for x, y in zip(a, b)]
    assert text.fuzzy_find.func(a, b).tolist() == [first_place(x, y) for x, y in zip(a, b)]


def test_nulls_stay():
    a, b = pd.Series([None, "A", None], dtype=object), pd.Series(["A", None, None], dtype=object)
    assert text.edit_distance.func(a, b).isna().all() and text.semi_global_distance.func(a, b).isna().all()
    assert text.fuzzy_find.func(a, b).tolist() == [-1] * 3 and text.common_substring.func(a, b)["size"].tolist() == [0] * 3
    assert [tuple(r) for r in text.place_in.func(a, b).itertuples(index=False)] == [(0, 0, 0), (0, 0, 1), (0, 0, 0)]


def test_work_of_a_batch_is_in_blocks(monkeypatch):
    """A batch of short pairs is a few blocks, and none goes pair by pair."""
    seen = []
    plain = text._letters
    monkeypatch.setattr(text, "_letters", lambda texts: seen.append(len(texts)) or plain(texts))
    monkeypatch.setattr(text, "_last_row", None)
    a = pd.Series(["ACGTACGTAC" * 6] * 2000)
    for f in (text.edit_distance, text.semi_global_distance, text.common_substring, text.fuzzy_find, text.place_in):
        seen.clear()
        f.func(a, a)
        assert sum(seen) == 4000 and len(seen) <= 8


def test_pieces_are_those_of_the_table(spark):
    rows = [(1, None), (2, ""), (3, "x" * 60), (4, "é😀\n" * 41), (5, "y" * 79), (6, "z" * 81), (7, "\r\n q" * 300)]
    documents = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, adapters._strings(documents).collect()), key=str)
    want = [(i, k, t and t[60 * k : 60 * k + 60], t and t[60 * k + 19 : 60 * k + 79]) for i, t in rows for k in range(max(1, -(-len(t or "") // 60)))]
    assert got == sorted(want, key=str)


def test_a_long_text_is_cut_in_one_pass(spark):
    """The text does not go with its pieces."""
    documents = spark.createDataFrame([(1, "ab" * 10)], "doc_id long, text string")
    plan = adapters._strings(documents)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode(transform" in plan and "substr(text" not in plan
