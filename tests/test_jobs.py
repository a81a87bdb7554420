"""The two jobs: growing input, reruns, samples apart, command lines."""

import json
import os
import uuid

import duckdb
import pytest

from jobs import clip_panel, queries, sample_amplification
from tests.test_queries import rows

SF = "/root/testdata/sf0.001"
PANEL = {"sample": "sample", "text": "seq", "width": 10, "least_length": 5, "least_rows": 2, "files_per_batch": 1}
READS = "sample string, chrom string, start long, stop long, mapq int, nm int, dup boolean"
AMP = {"reads": {c.split()[0]: c.split()[0] for c in READS.split(", ")}, "genes": {c: c for c in ("chrom", "start", "stop", "name")}, "width": 10, "min_mapq": 20, "max_nm": 3, "least_cn": 2.5, "bridge": 1}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_registered_jobs(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "lineitem", "part"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    settings = {r.key: r.value for r in spark.sql("SET").collect()}
    got = queries.QUERIES[name](spark, SF).toPandas()
    assert {r.key: r.value for r in spark.sql("SET").collect()} == settings
    assert rows(got) == rows(duck.execute(queries.ORACLE_SQL[name]).df()) and len(got)


def turned(s):
    if set(s) <= set("ACGTN"):
        return min(s, s[::-1].translate(str.maketrans("ACGT", "TGCA")))
    return s


def plain_panel(data):
    """(sample, sequence) -> (n_rows, n_pieces, samples, all_rows) of (sample, seq) rows."""
    own = {}
    for sample, seq in data:
        said = [turned(line.upper()[i : i + 10]) for line in (seq or "").split("\n") for i in range(0, len(line), 10) if len(line[i : i + 10]) >= 5]
        for s in set(said):
            n = own.setdefault((sample or None, s), [0, 0])
            n[0] += 1
            n[1] += said.count(s)
    out = {}
    for (sample, s), (n, k) in own.items():
        same = [v[0] for (_, other), v in own.items() if other == s]
        if sum(same) >= 2:
            out[sample, s] = (n, k, len(same), sum(same))
    return out


def panel_rows(df):
    return {(r.sample, r.sequence): (r.n_rows, r.n_pieces, r.samples, r.all_rows) for r in df.collect()}


FIRST = [("a", "ACGTTTGACC\nacgtttgacc\nACGT"), ("b", "GGTCAAACGT"), ("a", None), ("", "hello world!"), (None, "HELLO WORLD!"), ("12", "")]
THEN = [("b", "acgtttgacc"), ("c", "hello worl"), ("c", "only here once")]


def test_panel_over_growing_input(spark, tmp_path):
    source, out = f"{tmp_path}/in", f"{tmp_path}/out"
    write = lambda data: spark.createDataFrame(data, "sample string, seq string").coalesce(1).write.mode("append").parquet(source)
    write(FIRST)
    assert panel_rows(clip_panel.run(spark, source, out, PANEL)) == plain_panel(FIRST)
    again = clip_panel.run(spark, source, out, PANEL)  # nothing new
    assert panel_rows(again) == plain_panel(FIRST) and spark.read.parquet(f"{out}/counts").select("batch").distinct().count() == 1
    write(THEN)
    want = plain_panel(FIRST + THEN)
    assert panel_rows(clip_panel.run(spark, source, out, PANEL)) == want and want != plain_panel(FIRST)
    assert spark.read.parquet(f"{out}/counts").select("batch").distinct().count() == 2  # the first file wasn't read again
    assert {f for f in os.listdir(f"{out}/panel") if "=" in f} == {"sample=__HIVE_DEFAULT_PARTITION__", "sample=a", "sample=b", "sample=c"}
    whole = clip_panel.run(spark, source, f"{tmp_path}/whole", {**PANEL, "files_per_batch": 100})
    assert panel_rows(whole) == want


def test_panel_repeats_a_batch_that_failed(spark, tmp_path, monkeypatch):
    """The counts of a batch are written, then the run dies before its checkpoint is: the next run replaces them."""
    source, out = f"{tmp_path}/in", f"{tmp_path}/out"
    spark.createDataFrame(FIRST, "sample string, seq string").coalesce(1).write.parquet(source)
    real, calls = clip_panel.counted, []

    def half(batch, config):
        if calls:
            return real(batch, config)
        calls.append(1)
        real(batch, config).withColumn("batch", clip_panel.F.lit(0)).write.partitionBy("batch").parquet(f"{out}/counts")
        raise RuntimeError("executor lost")

    monkeypatch.setattr(clip_panel, "counted", half)
    with pytest.raises(Exception, match="executor lost"):
        clip_panel.run(spark, source, out, PANEL)
    assert panel_rows(clip_panel.run(spark, source, out, PANEL)) == plain_panel(FIRST)


def test_panel_of_one_file_and_of_no_rows(spark, tmp_path):
    spark.createDataFrame(FIRST, "sample string, seq string").limit(0).coalesce(1).write.parquet(f"{tmp_path}/in")
    assert clip_panel.run(spark, f"{tmp_path}/in", f"{tmp_path}/out", PANEL).count() == 0


def tables(spark, tmp_path, data):
    at = f"{tmp_path}/{uuid.uuid4().hex}"
    spark.createDataFrame(data, READS).write.parquet(f"{at}/reads")
    spark.createDataFrame([("chr1", 0, 15, "G1"), ("chr1", 12, 30, "G2"), ("chr2", 0, 5, "G3")], "chrom string, start long, stop long, name string").write.parquet(f"{at}/genes")
    return f"{at}/reads", f"{at}/genes"


def sample_reads(sample, high):
    one = [(sample, "chr1", at, at + 5, 60, 0, False) for at in range(0, 100, 10)]
    return one + [(sample, "chr1", high + i % 10, high + 20, 60, None, False) for i in range(20)] + [(sample, "chr1", 95, 99, 0, 0, False), (sample, "chr1", 95, 99, 60, 0, True)] * 30


def found(df):
    return sorted((r.sample, r.chrom, r.start, r.stop, r.bins, round(r.cn, 6), r.genes) for r in df.collect())


def test_samples_of_one_table_equal_runs_of_each(spark, tmp_path):
    a, b = sample_reads("a", 10), sample_reads("b", 50) + [("b", "chr2", 1, 4, 60, 0, False)]
    both = found(sample_amplification.run(spark, *tables(spark, tmp_path, a + b), f"{tmp_path}/both", AMP))
    apart = [r for part in (a, b) for r in found(sample_amplification.run(spark, *tables(spark, tmp_path, part), f"{tmp_path}/{uuid.uuid4().hex}", AMP))]
    assert both == sorted(apart)
    assert both == [("a", "chr1", 10, 20, 1, 14.0, "G1; G2"), ("b", "chr1", 50, 60, 1, round(2 * 21 / (31 / 11), 6), "")]


def test_rerun_replaces_only_its_samples(spark, tmp_path):
    out = f"{tmp_path}/out"
    first = found(sample_amplification.run(spark, *tables(spark, tmp_path, sample_reads("a", 10) + sample_reads("b", 50)), out, AMP))
    assert found(sample_amplification.run(spark, *tables(spark, tmp_path, sample_reads("a", 10) + sample_reads("b", 50)), out, AMP)) == first
    moved = tables(spark, tmp_path, sample_reads("a", 90) + sample_reads("b", 20))
    got = found(sample_amplification.run(spark, *moved, out, AMP, ["a"]))
    assert [r[:3] for r in got] == [("a", "chr1", 90), ("b", "chr1", 50)]
    flat = tables(spark, tmp_path, [(s, "chr1", at, at + 5, 60, 0, False) for s in ("a", None) for at in range(0, 100, 10)])
    assert [r[0] for r in found(sample_amplification.run(spark, *flat, out, AMP))] == ["b"]  # a's regions go, b has no new reads


@pytest.mark.parametrize("job", [clip_panel, sample_amplification])
def test_command_line(job, tmp_path, spark, monkeypatch):
    """The command line starts a session, runs and stops it; here it gets the test's session, which must outlive it."""
    monkeypatch.setattr(type(spark), "stop", lambda self: None)
    (tmp_path / "config.json").write_text(json.dumps(PANEL if job is clip_panel else AMP))
    if job is clip_panel:
        spark.createDataFrame(FIRST, "sample string, seq string").write.parquet(f"{tmp_path}/in")
        args = ["--input", f"{tmp_path}/in"]
    else:
        reads, genes = tables(spark, tmp_path, sample_reads("a", 10))
        args = ["--reads", reads, "--genes", genes]
    job.main([*args, "--output", f"{tmp_path}/out", "--config", f"{tmp_path}/config.json"])
    assert spark.read.parquet(f"{tmp_path}/out/{'panel' if job is clip_panel else 'amplified'}").count()


def test_pieces_are_counted_in_their_row_and_hashes_go_first(spark):
    """Pieces are shuffled once to be counted; whole sequences of the panel only if their hash is frequent enough."""
    df = spark.createDataFrame(FIRST + THEN, "sample string, seq string")
    plan = lambda x: x._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    counts = clip_panel.counted(df, PANEL)
    assert plan(counts).count("Exchange hashpartitioning") == 1
    assert {(r.sample, r.sequence): (r.n_rows, r.n_pieces) for r in counts.where("sequence = 'ACGTTTGACC'").collect()} == {("a", "ACGTTTGACC"): (1, 2), ("b", "ACGTTTGACC"): (2, 2)}
    assert panel_rows(clip_panel.panel(counts, 2)) == plain_panel(FIRST + THEN)
    assert "LeftSemi" in plan(clip_panel.panel(counts, 2))
