"""Repair of conversations against SQL and a plain search over all edits."""

import hashlib
import itertools
import os
import re
import zlib

import duckdb
import pytest

from circlet.llm import conversations as c

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string"
GRAMMAR = re.compile(r"(s?(ua)+)?")


def plain(rows):
    """The report of one conversation's rows (turn, role, text) after damage, by exhaustive search."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    white = " \t\n\x0b\f\r"
    seen, faults = set(), []
    for _, role, text in rows:
        faults.append("blank" if not text.strip(white) else "duplicate" if (role, text) in seen else "truncated" if text.strip(white)[-1] not in ".!?" else None)
        seen.add((role, text))
    initials = [r[1][:1] for r in rows]
    turns = [r[0] for r in rows if r[0] is not None]
    best = None
    options = []
    for (_, role, text), fault in zip(rows, faults):
        more = 3 * (fault == "truncated")
        own = [("D", 4, None)]
        if fault not in ("blank", "duplicate"):
            own += [("K", more, (role, text)), ("R", 3 + more, ("user", text)), ("R", 3 + more, ("assistant", text))]
        options.append(own)
    inserts = [[()], [(("I", 3, (r, "")),) for r in ("user", "assistant")], [tuple(("I", 3, (r, "")) for r in two) for two in (("user", "assistant"), ("assistant", "user"))]]
    gaps_ = list(itertools.chain.from_iterable(inserts))
    for picked in itertools.product(*options):
        for added in itertools.product(gaps_, repeat=len(rows) + 1):
            edits = list(added[0])
            for e, more in zip(picked, added[1:]):
                edits += [e, *more]
            said = [e[2] for e in edits if e[2] is not None]
            if all(r[:1] in "sua" and r for r, _ in said) and GRAMMAR.fullmatch("".join(r[:1] for r, _ in said)):
                way = sum(e[1] for e in edits), "".join(e[0] for e in edits), "\n".join(f"{r}:{t}" for r, t in said)
                best = way if best is None or way < best else best
    pairs = [a + b for a, b in zip(initials, initials[1:])]
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), sum(p not in ("su", "ua", "au") for p in pairs), best[0], best[1], hashlib.sha256(best[2].encode()).hexdigest())


def damaged(rows):
    out = {}
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        k = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        out.setdefault(conv, []).extend([(turn, "user" if k == 4 else role, text)] * (0 if k == 0 else 2 if k == 3 else 1))
    return out


def reported(df):
    return {r[0]: tuple(r[1:]) for r in df.collect()}


CASES = [
    (1, 0, "user", "Hi."), (1, 1, "assistant", "Yes."), (1, 2, "user", "And"),
    (2, 0, "system", "Be."), (2, 1, "assistant", "No."),
    (3, None, "user", "A."), (3, None, "user", "A."), (3, 4, None, "B."),
    (4, 0, "tool", "x."), (4, 0, "", "y!"), (4, 9, "assistant", None),
    (5, 0, "user", ""), (5, 1, "user", " \n"),
    (None, 0, "user", "q?"), (None, 1, "assistant", "a "),
    (6, 3, "assistant", "z."), (6, 1, "assistant", "z."), (6, -2, "user", "😀."),
]


@pytest.mark.parametrize("long", [1_000, 1])
def test_against_exhaustive_search(spark, long):
    rows = spark.createDataFrame(CASES, SCHEMA).selectExpr("*", "'x' as part", "1 as times")
    got = reported(c.report(c.repair(c.damage(rows), long)))
    assert got == {conv: plain(turns) for conv, turns in damaged(CASES).items()}


def test_conversation_without_rows_and_empty_table(spark):
    gone = next(t for t in range(1000) if zlib.crc32(f"7:{t}".encode()) % 20 == 0)
    rows = spark.createDataFrame([(7, gone, "user", "Hi.")], SCHEMA)
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert reported(c.report(c.repair(c.damage(rows)))) == {7: nothing}
    assert reported(c.report(c.repair(c.damage(rows), 0))) == {7: nothing}
    assert reported(c.report(c.repair(c.damage(rows.limit(0))))) == {}


def test_long_conversation_in_stretches(spark):
    """One conversation with thousands of turns, repeats and null turns: both ways give the same report."""
    rows = spark.range(6_000).selectExpr("9L as conv_id", "if(id % 50 = 0, null, id % 4000) as turn", "element_at(array('user', 'assistant', 'user', 'tool', 'system'), cast(id * 7 % 5 + 1 as int)) as role", "concat('t', id % 997, if(id % 3 = 0, '.', '')) as text")
    assert reported(c.report(c.repair(c.damage(rows), 100))) == reported(c.report(c.repair(c.damage(rows), 100_000)))


def test_edits_are_the_real_output(spark):
    rows = spark.createDataFrame([(1, 0, "assistant", "Hi."), (1, 1, "user", "no"), (1, 2, "user", "no")], SCHEMA).selectExpr("*", "1L as times", "false as gone")
    got = [(r.edit, r.fault, r.turn, r.was, r.role, r.text) for r in c.repair(rows).orderBy("part", "at").collect()]
    assert got == [("I", None, None, None, "user", ""), ("K", None, 0, "assistant", "assistant", "Hi."), ("D", "truncated", 1, "user", None, None), ("D", "duplicate", 2, "user", None, None)]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_against_sql(spark):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    got = c.op11_conversation_repair(spark, SF).toPandas().sort_values("conv_id").values.tolist()
    assert got == duck.execute(c.OP11_SQL).df().sort_values("conv_id").values.tolist()
