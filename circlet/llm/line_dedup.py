"""Line dedup with DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import aside, lower_az, stage, table

SPACE = " \t\n\x0b\x0c\r"
MIN_CHARS, MIN_DOCS = 40, 5


def line_key(line):
    """The line without white space [\\x20\\x09-\\x0D] at both ends, A-Z lower-cased."""
    return lower_az(F.btrim(line, F.lit(SPACE)))


def line_hash(line):
    """128 bits of the key as two independently seeded 64-bit hashes."""
    key = line_key(line)
    return F.struct(F.xxhash64(key).alias("a"), F.xxhash64(F.lit(1), key).alias("b"))


def lines_of(text):
    """Null and empty texts have one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def long_line(line, min_chars: int):
    return F.char_length(F.btrim(line, F.lit(SPACE))) >= min_chars


def text_name(text):
    """128 bits that name a text: rows of one doc_id may differ in it."""
    return F.struct(F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(2), text).alias("t2"))


def dropped_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, t1, t2, places: the lines, by place from 0, that the text t1, t2 of this document loses.

    Keys of at least min_chars code points in at least min_docs distinct
    doc_ids; the largest doc_id keeps its lines. A null doc_id holds no line.
    """
    known = docs.where("doc_id is not null and text is not null").select("doc_id", text_name(F.col("text")).alias("t"), F.posexplode(F.split("text", "\n", -1)).alias("place", "line"))
    long = known.where(long_line(F.col("line"), min_chars)).select("doc_id", "t.t1", "t.t2", "place", line_hash(F.col("line")).alias("h"))
    # Written once, as lines are hashed from whole texts; both uses read numbers.
    held = stage(long.select("doc_id", "t1", "t2", "place", "h.a", "h.b"), "held")
    # countDistinct groups by key and document first, so one line in a third of all documents is spread before it is counted.
    common = stage(held.groupBy("a", "b").agg(F.count_distinct("doc_id").alias("n"), F.max("doc_id").alias("keeper")).where(F.col("n") >= min_docs), "lines")
    lost = held.join(common.hint("merge"), ["a", "b"]).where("doc_id < keeper")
    return lost.groupBy("doc_id", "t1", "t2").agg(F.collect_set("place").alias("places"))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """docs with text reassembled by position, and n_lines and n_dropped, which replace columns of these names.

    All other columns stay. Repeated rows of one doc_id count as one document
    and lose the same lines. Null and empty texts are one empty line and stay
    as they are. If every line goes, the text is empty. No rows: no rows. A
    text costs time in proportion to its length, however many lines it has and
    loses.
    """
    # the lost places of a text are bounded by its own lines
    lost = stage(dropped_lines(docs, min_chars, min_docs), "lost").withColumnsRenamed({"doc_id": "lost_by", "t1": "lost_1", "t2": "lost_2"})
    columns = [c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")]
    held, back = aside(docs.select(*columns), "lost_by", "lost_1", "lost_2", "places", "t1", "t2", "lines", "stay")
    # hashes and lines are columns, so that neither a sort nor the transform below makes them again
    held = held.withColumn("t", text_name(F.col("text"))).withColumns({"t1": F.col("t.t1"), "t2": F.col("t.t2")}).drop("t")
    held = held.join(lost.hint("merge"), (F.col("doc_id") == F.col("lost_by")) & (F.col("t1") == F.col("lost_1")) & (F.col("t2") == F.col("lost_2")), "left")
    held = held.withColumn("lines", lines_of(F.col("text")))
    # array_except looks places up in a hash set; a line is then taken by its place
    stay = F.transform(F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "places"), lambda i: F.get("lines", i))
    names = {c: new for new, c in back.items()}
    text = F.when(F.col("places").isNull(), F.col("text")).otherwise(F.array_join(stay, "\n"))
    n_dropped = F.when(F.col("places").isNull(), F.lit(0)).otherwise(F.size("places"))
    return held.select(*[(text if c == "text" else F.col(f"`{names.get(c, c)}`")).alias(c) for c in columns], F.size("lines").cast("long").alias("n_lines"), n_dropped.cast("long").alias("n_dropped"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256).alias("kept_sha256"))


OP2_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.*, c.keeper IS NOT NULL AND k.doc_id <> c.keeper AS lost FROM k LEFT JOIN c USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (lost)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT lost), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
