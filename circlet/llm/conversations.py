"""Repair of a conversation's structure by the cheapest edits.

A conversation is sound if the initials of its roles read ``(s?(ua)+)?`` and no
turn is blank or a duplicate. Edits and their costs are in ``KEEP`` to
``TRUNCATED``; of equally cheap repairs the one whose edits' initials (the
audit) come first in ASCII is taken. The search is Dijkstra's on the implicit
lattice of (turn index, grammar state) with the priority (cost, audit), and ends
at the first end node popped in a state that may end. Two ways to one node never
have equal costs and audits of which one begins the other (the rest would be
insertions, which cost), so the least audit stays the least however it goes on.

For the same reason the least ways through a stretch of turns, from each grammar
state to each, can be put together in order. Conversations of more than ``LONG``
turns or ``LONG_BYTES`` go that way: their turns are dealt by range, each
task finds the ways through its stretch, these are put together, and each
stretch then writes the edits of the one way that the whole conversation takes.
Its audit and hash, a row of the result, are read off the edits in order as a
stream, as SHA-256 allows nothing else.

Turns are taken by turn (nulls first), ties by role and text. Null roles and
texts are one space. A role whose initial is not s, u or a can't be kept. A
null conv_id is a conversation of its own.
"""

from __future__ import annotations

import hashlib
from heapq import heappop, heappush
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import partitions, stage, table

#: Costs of the edits, and what an undeleted truncated turn adds.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Turns and bytes beyond which a conversation is searched in stretches, and turns of one search.
LONG, LONG_BYTES, SEARCH = 1_000, 16 << 20, 500
#: Grammar states: 0 nothing yet, 1 after system, 2 after user, 3 after assistant. What each turns to by a kept initial, and by the only role that may be set.
AFTER = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
SET = [("user", 2), ("user", 2), ("assistant", 3), ("user", 2)]
ENDS = (0, 3)
WHITE = " \t\n\x0b\f\r"
LEGAL = ("su", "ua", "au")


def cheapest(turns: list[tuple[str, int, bool, bool]], start: int = 0, whole: bool = True) -> dict[int, tuple[int, str]]:
    """By grammar state at the end, the least (cost, audit) through turns from a state; whole: of the first end popped alone.

    A turn: initial of the role, times it stands there, whether it has to go, whether it is truncated.
    """
    n, heap, done, found = len(turns), [(0, "", 0, start)], set(), {}
    while heap:
        cost, audit, i, s = heappop(heap)
        if (i, s) in done:
            continue
        done.add((i, s))
        if i == n and (not whole or s in ENDS):
            found[s] = cost, audit
            if whole or len(found) == 4:
                break
        heappush(heap, (cost + INSERT, audit + "I", i, SET[s][1]))
        if i == n:
            continue
        initial, times, bad, cut = turns[i]
        heappush(heap, (cost + DELETE * times, audit + "D" * times, i + 1, s))
        if bad:
            continue
        gone = "D" * (times - 1)  # what repeats a turn in its place is a duplicate of it
        cost += DELETE * (times - 1) + TRUNCATED * cut
        heappush(heap, (cost + REROLE, f"{audit}R{gone}", i + 1, SET[s][1]))
        if (s, initial) in AFTER:
            heappush(heap, (cost, f"{audit}K{gone}", i + 1, AFTER[s, initial]))
    return found


def ways(turns: list, starts=range(4)) -> dict[tuple[int, int], tuple[int, str]]:
    """The least (cost, audit) through a stretch of turns, by state before and after it."""
    total = {(s, s): (0, "") for s in starts}
    for at in range(0, len(turns), SEARCH):
        block = turns[at : at + SEARCH]
        total = joined(total, {(s, e): way for s in {e for _, e in total} for e, way in cheapest(block, s, False).items()})
    return total


def joined(first: dict, then: dict) -> dict:
    """Ways through two stretches, one after the other."""
    out: dict = {}
    for (s, m), (c1, a1) in first.items():
        for (m2, e), (c2, a2) in then.items():
            if m == m2:
                way = c1 + c2, a1 + a2
                if (s, e) not in out or way < out[s, e]:
                    out[s, e] = way
    return out


def damage(conversations: DataFrame) -> DataFrame:
    """Known damage by crc32(``conv_id:turn``) % 20, as test data for repair(): 0 takes a row away (gone), 1 empties the text, 2 removes its ``[.!?]``, 3 makes it stand there twice, 4 sets role user."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    k = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), k.alias("k"))
    return rows.select(
        "conv_id",
        "turn",
        F.when(F.col("k") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("k") == 3, 2).otherwise(1).cast("long").alias("times"),
        (F.col("k") == 0).alias("gone"),
    )


def _flagged(rows: DataFrame) -> DataFrame:
    kept = F.rtrim("text", F.lit(WHITE))
    return rows.withColumns({"blank": kept == "", "cut": ~F.right(kept, F.lit(1)).isin(".", "!", "?")})


EDITS = "part int, at long, edit string, fault string, turn long, was string, role string, text string"


def repair(rows: DataFrame, long: int = LONG) -> DataFrame:
    """The edits of each conversation in order: conv_id, part, at (place in the part), edit (K, R, D or I), fault (blank, duplicate, truncated or null), turn and was (role before), role and text after.

    rows: conv_id, turn (whole number), role, text, times (copies of the row in
    its place), gone (true: the row only names its conversation). Deleted turns
    have no role; inserted ones no turn. A conversation without turns has one row
    without an edit.
    """
    spark = rows.sparkSession
    rows = rows.withColumns({"role": F.coalesce("role", F.lit(" ")), "text": F.coalesce("text", F.lit(" "))})
    sizes = rows.groupBy("conv_id").agg(F.sum("times").alias("_n"), F.sum(F.octet_length("text")).alias("_bytes"))
    large = stage(sizes.where((F.col("_n") > long) | (F.col("_bytes") > LONG_BYTES)).select("conv_id"), "long-conversations")
    schema = StructType([rows.schema["conv_id"], *StructType.fromDDL(EDITS).fields])
    order = ["conv_id", F.asc_nulls_first("turn"), "role", "text"]
    n = partitions(spark)
    short, found = rows, None
    if not large.isEmpty():
        is_long = rows.conv_id.eqNullSafe(large.conv_id)
        short = rows.join(large, is_long, "left_anti")
        found = _long_edits(rows.join(large, is_long, "left_semi"), schema, n)
    whole = _flagged(short).withColumns({"again": F.lit(None).cast("boolean"), "part": F.lit(0), "begin": F.lit(0), "end": F.lit(None).cast("int")})
    whole = whole.repartition(n, "conv_id").sortWithinPartitions(*order)
    out = whole.mapInArrow(_edits(schema), schema)
    return out if found is None else out.union(found)


def _long_edits(rows: DataFrame, schema: StructType, n: int) -> DataFrame:
    """repair() of conversations of any length."""
    void = lambda c, kind: F.when(~F.col("gone"), F.col(c)).otherwise(F.lit(None).cast(kind)).alias(c)
    one = rows.select("conv_id", "gone", void("turn", "long"), void("role", "string"), void("text", "string"), "times").groupBy("conv_id", "gone", "turn", "role", "text").agg(F.sum("times").alias("times"))
    one = stage(one.withColumns({"_place": F.struct(F.col("turn").isNotNull().alias("known"), "turn"), "_key": F.struct("conv_id", "role", F.md5(F.col("text").cast("binary")))}), "long-turns")
    # structs compare nulls as equal, so one key serves null ids too
    first = one.groupBy("_key").agg(F.min("_place").alias("_first"))
    seen = one.join(first, "_key").withColumn("again", F.col("_place") > F.col("_first")).drop("_key", "_place", "_first")
    order = ["conv_id", F.asc_nulls_first("turn"), "role", "text"]
    parts = stage(_flagged(seen).repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()), "long-parts")
    dealt = lambda df: df.repartition(n, "conv_id", "part").sortWithinPartitions("conv_id", "part", *order[1:])
    by_part = StructType([schema["conv_id"], *StructType.fromDDL("part int, begin int, end int, cost long, audit string").fields])
    found = stage(dealt(parts.withColumns({"begin": F.lit(0), "end": F.lit(None).cast("int")})).mapInArrow(_ways(by_part), by_part), "long-ways")
    taken = found.repartition(n, "conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(_taken(by_part), by_part).select(F.col("conv_id").alias("_id"), F.col("part").alias("_part"), "begin", "end")
    taken = stage(taken, "long-taken")
    told = parts.join(taken, F.col("conv_id").eqNullSafe(F.col("_id")) & (F.col("part") == F.col("_part"))).drop("_id", "_part")
    edits = stage(dealt(told).mapInArrow(_edits(schema), schema), "long-edits")
    return edits.repartition(n, "conv_id").sortWithinPartitions("conv_id", "part", "at")


def _groups(batches, *names: str):
    """(values of names, rows as an iterator of dicts) of adjacent rows; rows are read batch by batch."""
    rows = (r for b in batches for r in b.to_pylist())
    return groupby(rows, key=lambda r: tuple(r[n] for n in names))


def _emit(rows, schema: StructType, most: int = 4 << 20):
    """Record batches of rows (tuples in schema's order), cut by number and by length of the last column."""
    kind, held, size = to_arrow_schema(schema), [], 0
    batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), kind)], schema=kind)
    for r in rows:
        held.append(r)
        size += len(r[-1] or "")
        if len(held) == 2_000 or size > most:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def _turns(rows: list[dict]) -> list[tuple[str, int, bool, bool]]:
    """What the search needs to know of turns; sets again where it isn't known yet."""
    seen = set()
    for r in rows:
        if r["again"] is None:
            key = r["role"], r["text"]
            r["again"] = key in seen
            seen.add(key)
    return [(r["role"][:1], r["times"], r["blank"] or r["again"], r["cut"]) for r in rows]


def _ways(schema: StructType):
    def found(batches):
        for (conv, part), rows in _groups(batches, "conv_id", "part"):
            # of a stretch only what the search needs is kept
            turns = _turns([{**r, "text": None} for r in rows if not r["gone"]])
            yield from ((conv, part, s, e, cost, audit) for (s, e), (cost, audit) in ways(turns).items())

    return lambda batches: _emit(found(batches), schema)


def _taken(schema: StructType):
    """Puts the ways of a conversation's parts together: the states before and after each part."""

    def found(batches):
        for (conv,), rows in _groups(batches, "conv_id"):
            best, back = {0: (0, "")}, []
            for part, table_ in groupby(rows, key=lambda r: r["part"]):
                then, came = {}, {}
                for r in table_:
                    if r["begin"] in best:
                        cost, audit = best[r["begin"]]
                        way = cost + r["cost"], audit + r["audit"]
                        if r["end"] not in then or way < then[r["end"]]:
                            then[r["end"]], came[r["end"]] = way, r["begin"]
                best = then
                back.append((part, came))
            s = min((way, s) for s, way in best.items() if s in ENDS)[1]
            for part, came in reversed(back):
                yield conv, part, came[s], s, None, None
                s = came[s]

    return lambda batches: _emit(found(batches), schema)


def _edits(schema: StructType):
    """The edits of conversations, or of parts of which the states before and after are known."""

    def found(batches):
        for (conv, part), rows in _groups(batches, "conv_id", "part"):
            rows = list(rows)
            begin, end = rows[0]["begin"], rows[0]["end"]
            rows = [r for r in rows if not r["gone"]]
            turns = _turns(rows)
            audit = (cheapest(turns) if end is None else {end: ways(turns, [begin])[begin, end]}).popitem()[1][1]
            if not rows and not audit:
                yield conv, part, -1, None, None, None, None, None, None
            s, i, copy = begin, 0, 0
            for at, edit in enumerate(audit):
                if edit == "I":
                    role, s = SET[s]
                    yield conv, part, at, edit, None, None, None, role, ""
                    continue
                r = rows[i]
                role = None
                if edit == "K":
                    role, s = r["role"], AFTER[s, r["role"][:1]]
                elif edit == "R":
                    role, s = SET[s]
                fault = "blank" if r["blank"] else "duplicate" if r["again"] or copy else "truncated" if r["cut"] else None
                yield conv, part, at, edit, fault, r["turn"], r["role"], role, r["text"] if role is not None else None
                copy += 1
                if copy == r["times"]:
                    i, copy = i + 1, 0

    return lambda batches: _emit(found(batches), schema)


REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def report(edits: DataFrame) -> DataFrame:
    """One row a conversation from its edits in order, as repair() gives them: faults, cost, audit and the hash of the repaired ``role:text`` lines. Read as a stream."""
    schema = StructType([edits.schema["conv_id"], *StructType.fromDDL(REPORT).fields])

    def rows(batches):
        for (conv,), found in _groups(batches, "conv_id"):
            faults, cost, audit, illegal, turns = dict.fromkeys(("blank", "duplicate", "truncated"), 0), 0, [], 0, 0
            digest, lines, before, first, last = hashlib.sha256(), 0, None, None, None
            for r in found:
                edit = r["edit"]
                if edit is None:
                    continue
                audit.append(edit)
                if edit != "I":
                    initial = r["was"][:1]
                    illegal += before is not None and before + initial not in LEGAL
                    before = initial
                    if r["turn"] is not None and r["turn"] != last:
                        first, last, turns = r["turn"] if first is None else first, r["turn"], turns + 1
                    if r["fault"]:
                        faults[r["fault"]] += 1
                cost += {"K": 0, "R": REROLE, "D": DELETE, "I": INSERT}[edit] + (TRUNCATED if r["fault"] == "truncated" and edit != "D" else 0)
                if r["role"] is not None:
                    digest.update(f"{chr(10) if lines else ''}{r['role']}:{r['text']}".encode("utf-8", "surrogatepass"))
                    lines += 1
            yield conv, 0 if first is None else last - first + 1 - turns, *faults.values(), illegal, cost, "".join(audit), digest.hexdigest()

    return edits.mapInArrow(lambda batches: _emit(rows(batches), schema), schema)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repairs conversations after known damage: one row for each conv_id.

    Conversations that lost all rows have zeros, an empty audit and the hash of
    nothing. Repeated rows are rows (the later ones duplicates); extra columns
    are ignored; an empty table has no rows.
    """
    return report(repair(damage(table(spark, sf_dir, "conversations"))))


OP11_SQL = r"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    list_transform(string_split(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '), ''), lambda c: unicode(c)::bigint) AS codes
  FROM conversations),
damaged AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295::bigint, codes), lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::bigint) ELSE x // 2 END)), 4294967295::bigint) % 20 AS k
  FROM keyed),
turns AS (
  SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM damaged WHERE k <> 0
  UNION ALL SELECT conv_id, turn, role, text FROM damaged WHERE k = 3),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, left(role, 1) AS initial,
    rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS kept
  FROM turns),
faulty AS (
  SELECT *, CASE WHEN kept = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN right(kept, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS before
  FROM placed),
counted AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (before || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faulty GROUP BY conv_id),
edits(s, edit, initial, e, price) AS (
  SELECT s, 'D', NULL::varchar, s, 4 FROM range(4) r(s)
  UNION ALL SELECT s, 'R', NULL::varchar, CASE s WHEN 2 THEN 3 ELSE 2 END, 3 FROM range(4) r(s)
  UNION ALL VALUES (0, 'K', 's', 1, 0), (0, 'K', 'u', 2, 0), (1, 'K', 'u', 2, 0), (2, 'K', 'a', 3, 0), (3, 'K', 'u', 2, 0)),
inserts(s, e, price, added) AS (
  SELECT s, s, 0, '' FROM range(4) r(s)
  UNION ALL VALUES (0, 2, 3, 'I'), (1, 2, 3, 'I'), (2, 3, 3, 'I'), (3, 2, 3, 'I'), (0, 3, 6, 'II'), (1, 3, 6, 'II')),
best AS (
  SELECT conv_id, 0::bigint AS i, e AS s, {'cost': price::bigint, 'audit': added} AS way FROM counted, inserts WHERE s = 0
  UNION ALL
  SELECT conv_id, i, s, min(way) FROM (
    SELECT f.conv_id, f.i, n.e AS s, {'cost': b.way.cost + x.price + n.price + CASE WHEN f.fault = 'truncated' AND x.edit <> 'D' THEN 3 ELSE 0 END, 'audit': b.way.audit || x.edit || n.added} AS way
    FROM best b JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM b.conv_id AND f.i = b.i + 1
    JOIN edits x ON x.s = b.s AND (x.initial IS NULL OR x.initial = f.initial) AND (x.edit = 'D' OR f.fault NOT IN ('blank', 'duplicate'))
    JOIN inserts n ON n.s = x.e) g
  GROUP BY conv_id, i, s),
chosen AS (
  SELECT c.conv_id, min(b.way) AS way FROM counted c JOIN best b ON b.conv_id IS NOT DISTINCT FROM c.conv_id AND b.i = c.n WHERE b.s IN (0, 3) GROUP BY c.conv_id),
letters AS (
  SELECT conv_id, unnest(range(1, length(way.audit) + 1)) AS j, way.audit AS audit FROM chosen),
marked AS (
  SELECT conv_id, j, audit[j] AS edit, length(replace(left(audit, j), 'I', '')) AS i FROM letters),
lined AS (
  SELECT m.conv_id, m.j, m.edit, f.role, coalesce(f.text, '') AS text, f.initial, row_number() OVER (PARTITION BY m.conv_id ORDER BY m.j) AS place,
    first_value(m.edit = 'K' AND f.initial = 's') OVER (PARTITION BY m.conv_id ORDER BY m.j) AS system
  FROM marked m LEFT JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM m.conv_id AND f.i = m.i AND m.edit <> 'I' WHERE m.edit <> 'D'),
repaired AS (
  SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (place - CASE WHEN system THEN 1 ELSE 0 END) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY j) AS body
  FROM lined GROUP BY conv_id)
SELECT a.conv_id, coalesce(c.gaps, 0) AS gaps, coalesce(c.blank, 0) AS blank, coalesce(c.duplicate, 0) AS duplicate, coalesce(c.truncated, 0) AS truncated,
  coalesce(c.illegal, 0) AS illegal, coalesce(h.way.cost, 0) AS cost, coalesce(h.way.audit, '') AS audit, sha256(coalesce(r.body, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a
LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM a.conv_id
LEFT JOIN chosen h ON h.conv_id IS NOT DISTINCT FROM a.conv_id
LEFT JOIN repaired r ON r.conv_id IS NOT DISTINCT FROM a.conv_id
"""
