"""Domain tables made from the test tables: one text, read by Spark and by the oracle."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

#: name -> SQL over test tables and earlier names, in braces.
ADAPTERS = {
    "reads": """
select l_orderkey as rid, concat('chr', cast(l_suppkey % 24 + 1 as string)) as chrom,
  cast(round(l_extendedprice * 100) as bigint) as start, cast(round(l_extendedprice * 100) as bigint) + 100 as stop,
  cast(l_quantity as int) as mapq, l_linenumber - 1 as nm, l_returnflag = 'R' as dup,
  l_linestatus = 'O' as clip_l, l_discount > 0.05 as clip_r, l_partkey % 50 as bc, l_linenumber as line, l_partkey as pk, l_suppkey as sk
from {lineitem}""",
    "sites": """
select chrom, cast(floor(coord / 500.0) as bigint) * 500 as coord, clip, count(*) as n from (
  select chrom, start as coord, 'L' as clip from {reads} where clip_l and mapq >= 20 and not dup
  union all select chrom, stop - 1 as coord, 'R' as clip from {reads} where clip_r and mapq >= 20 and not dup) c
group by chrom, cast(floor(coord / 500.0) as bigint) * 500, clip""",
    "genes": """
select concat('chr', cast(p_partkey % 24 + 1 as string)) as chrom, (p_partkey * 50000) % 10500000 as start,
  (p_partkey * 50000) % 10500000 + p_size * 1000 as stop, concat('g', cast(p_partkey as string)) as name, p_partkey as gid, p_brand as brand, p_type as kind
from {part}""",
    "segments": """
select chrom, start, stop, gid as seg, cast(gid % 9 as double) + 1.5 as cn, brand from {genes}""",
    "links": """
select * from (select rid, bc, chrom as chrom1, cast(floor(start / 500.0) as bigint) * 500 as coord1, case when clip_l then 'L' else 'R' end as clip1,
  lead(chrom) over (partition by rid order by line, pk, sk, start) as chrom2,
  lead(cast(floor(start / 500.0) as bigint) * 500) over (partition by rid order by line, pk, sk, start) as coord2,
  lead(case when clip_r then 'R' else 'L' end) over (partition by rid order by line, pk, sk, start) as clip2
from {reads}) x where chrom2 is not null""",
    "rings": """
select concat('c', cast(o_custkey as string)) as ring, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as idx,
  concat('chr', cast(o_custkey % 24 + 1 as string)) as chrom, cast(o_orderkey % 4000 as bigint) * 2500 as start,
  cast(o_orderkey % 4000 as bigint) * 2500 + 5000 + cast(floor(o_totalprice / 10.0) as bigint) as stop,
  case when o_orderkey % 3 = 0 then '-' else '+' end as strand, cast(o_orderkey % 17 as bigint) + 2 as splits, o_totalprice / 50000.0 as cn
from {orders}""",
    "frags": """
select user_id as cell, concat('chr', cast(event_id % 24 + 1 as string)) as chrom, (event_id * 7919) % 10500000 as start,
  (event_id * 7919) % 10500000 + 200 as stop, cast(1 as bigint) as n, event_type as kind from {events}""",
    # whole texts in pieces of 60 letters, each with the 60 that begin 19 letters later
    "strings": """
select doc_id, piece, substr(text, cast(60 * piece + 1 as int), 60) as a, substr(text, cast(60 * piece + 20 as int), 60) as b
from (select doc_id, text, {pieces:floor((length(text) + 59) / 60.0)} as piece from {documents}) p""",
}
#: One row for each whole number below a count: what the two dialects say differently.
_PIECES = re.compile(r"\{pieces:(.*)\} as")
_SPARK, _ORACLE = r"explode(sequence(0L, cast(greatest(\1, 1) as bigint) - 1)) as", r"unnest(range(0, cast(greatest(\1, 1) as bigint))) as"


def _strings(documents: DataFrame) -> DataFrame:
    """The rows of strings: a text is cut in one pass, where substr of each piece would read it from its beginning again."""
    cut = F.when(F.length("text") > 0, F.regexp_extract_all("text", F.lit("(?s).{1,60}"), F.lit(0))).otherwise(F.array("text"))
    after = lambda i: F.coalesce(F.substring(F.get("_p", i + 1), 1, 19), F.lit(""))
    piece = F.transform("_p", lambda x, i: F.struct(i.cast("long").alias("piece"), x.alias("a"), F.concat(F.substring(x, 20, 41), after(i)).alias("b")))
    return documents.select("doc_id", cut.alias("_p")).select("doc_id", F.explode(piece).alias("s")).select("doc_id", "s.*")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table or a domain table."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name == "strings":
        return _strings(load(spark, sf_dir, "documents"))
    text = _PIECES.sub(_SPARK, ADAPTERS[name])
    needs = {x: load(spark, sf_dir, x) for x in (*TABLES, *ADAPTERS) if "{" + x + "}" in text}
    return spark.sql(text, **needs)


def ctes(*names: str) -> str:
    """The domain tables as common table expressions for the oracle."""
    found: dict[str, str] = {}

    def add(name: str) -> None:
        text = _PIECES.sub(_ORACLE, ADAPTERS[name])
        for x in ADAPTERS:
            if "{" + x + "}" in text:
                add(x)
        for x in (*TABLES, *ADAPTERS):
            text = text.replace("{" + x + "}", x)
        found.setdefault(name, text.strip())

    for name in names:
        add(name)
    return "WITH " + ",\n".join(f"{n} AS ({t})" for n, t in found.items())
