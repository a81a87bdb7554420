"""Operators on vectors and pages, the registered queries, and the pipeline."""

import glob
import hashlib
import os
import re

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from circlet.llm import embeddings, html_text, queries, warc
from circlet.llm.common import new_path

SF = "/root/testdata/sf0.001"
VEC = "vec_id long, embedding array<double>"


def clusters(seed=0, n=250, d=16):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    for i in range(n // 2, n):
        x[i] = x[rng.integers(n // 4)] + rng.normal(size=d) * rng.choice([0.02, 0.1, 0.25])
    return x


def plain_links(x, cosine=0.95):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= cosine
    np.fill_diagonal(near, False)
    root = np.arange(len(x))
    for _ in range(len(x)):
        new = np.array([min(root[i], root[near[i]].min(initial=root[i])) for i in range(len(x))])
        if (new == root).all():
            break
        root = new
    return near.sum(1), root


@pytest.mark.parametrize("block", [1024, 16])
def test_vectors_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(embeddings, "BLOCK", block)
    x = clusters()
    got = {r.vec_id: r for r in embeddings.near_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], VEC).withColumn("key", F.lit(1))).collect()}
    n, root = plain_links(x)
    found = np.array([got[i].n_links for i in range(len(x))])
    assert (found <= n).all() and found.sum() >= 0.98 * n.sum()
    if (found == n).all():
        assert [got[i].component_id for i in range(len(x))] == root.tolist()
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_odd_vectors(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(5, v), (3, v), (3, v), (9, [2.0, 4.0, 6.0]), (1, None), (2, []), (4, [0.0] * 3), (6, [1.0, None, 2.0]), (7, [float("nan"), 1.0, 1.0]), (8, [float("inf"), 1.0, 1.0]), (10, v + [1e300]), (11, [3e200, 6e200, 9e200]), (None, v)]
    got = embeddings.near_vectors(spark.createDataFrame(rows, VEC)).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.vec_id, []).append(r)
    for i in (1, 2, 4, 6, 7, 8, 10):
        assert [(r.n_links, r.component_id, r.kept) for r in by[i]] == [(0, i, True)]
    for i in (3, 5, 9, 11, None):
        assert all((r.n_links, r.component_id) == (5, 3) for r in by[i]), by[i]
    assert embeddings.near_vectors(spark.createDataFrame([], VEC)).count() == 0


def test_design_grows_with_the_logarithm():
    a, b = embeddings.design(10_000), embeddings.design(10**9)
    assert a["each"] == 6 and b["each"] == 19 and a["count"] <= embeddings.COUNTED


PAGES = "page_id long, url string, html string"


def test_warc(spark):
    big, small = "é\r\n\r\nWARC/1.1\r\nx" * 100, "small"
    rows = [(1, "http://www.a.com/x?b=1", big), (9, "https://A.com:443/x?b=1", big), (4, None, big), (2, "http://b.org/", small), (3, "http://b.org/", small), (5, "not a url", None), (6, "http://[bad", ""), (9, "http://c.net/", big), (None, "http://d.net/", big), (12, "http://long.example/", "y" * 300_000)]
    df = spark.createDataFrame(rows, PAGES).withColumn("digest", F.lit("clash"))
    path = warc.write_warc(df, new_path(spark, "warc"))
    got = warc.read_warc(spark, path).collect()
    assert len(got) == len(rows)
    assert {(r.page_id, r.record_type) for r in got if r.record_type == "revisit"} == {(1, "revisit"), (4, "revisit")}
    for r in got:
        if r.page_id in (1, 4, 9):
            assert r.payload_digest == hashlib.sha1(big.encode()).hexdigest() and r.payload_bytes == len(big.encode())
    index = warc.CaptureIndex(spark, warc.write_index(warc.read_warc(spark, path), new_path(spark, "index"), block_lines=2))
    assert sorted(c["page_id"] for c in index.lookup("http://a.com/x?b=1")) == [1, 9]
    assert [c["page_id"] for c in index.lookup("http://b.org")] == [2, 3] and index.lookup("http://nowhere.example/") == []
    (c,) = index.lookup("http://long.example")
    assert index.fetch(c) == b"y" * 300_000
    assert spark.read.parquet(f"{index.path}/directory").count() > 3
    ids = [x for r in spark.read.text(path, wholetext=True).collect() for x in re.findall("WARC-Record-ID: (\\S+)", r.value)]
    assert len(ids) == len(set(ids)) == len(rows)  # page_id 9 is there twice


@pytest.mark.parametrize("segment, read_bytes", [(1024, 8 << 20), (2, 100)])
def test_records_by_way_of_the_index(spark, monkeypatch, segment, read_bytes):
    """A third of the pages are one URL and one payload; sizes are skewed; archives are cut by bytes."""
    monkeypatch.setattr(warc, "SEGMENT", segment)
    monkeypatch.setattr(warc, "READ_BYTES", read_bytes)
    rng = np.random.default_rng(4)
    rows = [(i, "http://hot.example/", "the same page " * 100) for i in range(100)]
    rows += [(100 + i, f"http://site{i % 9}.org/{i}", "x" * int(rng.pareto(0.7) * 50)) for i in range(200)] + [(7, None, None), (None, "", "é" * 3000)]
    path = warc.write_warc(spark.createDataFrame(rows, PAGES).repartition(3), new_path(spark, "warc"), file_bytes=20_000)
    for f in glob.glob(path.removeprefix("file://") + "/**/*.txt", recursive=True):
        assert os.path.getsize(f) <= 20_000 + max(len((h or "").encode()) for _, _, h in rows) + 1000
    plain = warc.read_warc(spark, path, html=True)
    index = warc.write_index(warc.read_warc(spark, path), new_path(spark, "index"), block_lines=7)
    by_index = warc.fetch_records(warc.index_captures(spark, index), html=True)
    assert sorted(map(tuple, plain.collect()), key=repr) == sorted(map(tuple, by_index.collect()), key=repr)
    assert by_index.count() == len(rows) and by_index.where("record_type = 'revisit'").count() == 99
    look = warc.CaptureIndex(spark, index)
    assert [c["page_id"] for c in look.lookup("http://hot.example")] == list(range(100))
    found = look.lookup("http://site3.org/12")
    assert [c["page_id"] for c in found] == [112] and look.fetch(found[0]).decode() == rows[112][2]


def test_warc_of_no_pages(spark):
    path = warc.write_warc(spark.createDataFrame([], PAGES), new_path(spark, "warc"))
    captures = warc.read_warc(spark, path)
    assert captures.count() == 0
    assert warc.fetch_records(warc.index_captures(spark, warc.write_index(captures, new_path(spark, "index")))).count() == 0


@pytest.mark.parametrize(
    "url,key",
    [("http://www.Example.com:80/A?x=1#f", "com,example)/a?x=1"), ("https://a.b.co:8443", "co,b,a:8443)/"), (None, ""), ("mailto:x", "mailto:x")],
)
def test_url_key(url, key):
    assert warc.url_key(url) == key


@pytest.mark.parametrize(
    "source,text",
    [
        (None, ""),
        ("", ""),
        ("plain &amp; simple", "plain & simple"),
        ("<p>One <b>two</b>\n three<p>four", "One two three\n\nfour"),
        ("<head><title>t</title><style>p{}</style></head><script>var a='</p>'</script>x", "x"),
        ("<ul><li>a<li>b<ol start=3><li>x</ol></ul>", "- a\n- b\n  3. x"),
        ("<table><tr><td>aa<td>b<tr><td>c<td>dddd</table>", "aa  b\nc   dddd"),
        ("<pre> x\n  y</pre>", " x\n  y"),
        ("<div hidden>no</div><div style='display: none'>no</div><span aria-hidden=true>no</span>yes<!-- no -->", "yes"),
        ("a<br>b", "a\nb"),
        ("<td>stray</td></p></b>end", None),
        ("x < y and <unclosed", "x < y and <unclosed"),
        ("<textarea>a<b></textarea>", "a<b>"),
        ("<div>" * 5000 + "deep", "deep"),
        ("<noscript>no</noscript><![CDATA[raw]]>", "raw"),
    ],
)
def test_html(source, text):
    got = html_text.visible_text(source)
    assert isinstance(got, str) and (text is None or got == text)


@pytest.mark.parametrize(
    "source, text",
    [
        ("<table><colgroup><col><tr><td>x</td></tr></table>", "x"),
        ("<table><colgroup><col><td>x</table>", "x"),
        ("<table><caption>c<tr><td>x</td></tr></table>", "c\nx"),
        ("<table><colgroup><p>stray</p><col></colgroup><tr><td>x</table>", "stray\n\nx"),
        ("<p>a <math><mi>x</mi><mo>+</mo><mn>1</mn><annotation>tex</annotation></math> b", "a x+1 b"),
        ("<svg><defs/><desc>no</desc><g/><text>one</text><text>two</text><style>no</style></svg>", "one\ntwo"),
        ("<div>" * 250 + "<div hidden><div>no</div>no<b>no</b></div>yes", "yes"),
        ("<div>" * 250 + "<script>no</script><div style='display:none'>" + "<div>" * 9 + "no" + "</div>" * 9 + "no</div>yes", "yes"),
    ],
)
def test_html_loses_and_leaks_nothing(source, text):
    assert html_text.visible_text(source) == text


def test_html_rows(spark):
    rows = [(1, None), (1, "<p>a</p>"), (None, "b"), (2, "<p>" + "w " * 200_000)]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, html string").withColumn("text", F.lit(1))).collect()
    assert sorted((r.page_id or 0, r.text[:3], r.n_lines) for r in got) == [(0, "b", 1), (1, "", 0), (1, "a", 1), (2, "w w", 1)]
    assert html_text.extract(spark.createDataFrame([], "page_id long, html string")).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "pages", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, SF).toPandas(), c.execute(queries.ORACLE_SQL[name]).df()
    rows = lambda f: sorted(str([None if x is pd.NA or x != x else x for x in r]) for r in f[sorted(f.columns)].astype(object).itertuples(index=False, name=None))
    assert rows(got) == rows(want)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_every_query_covers_its_table(spark):
    tables = {"op6": "embeddings", "op7": "pages", "op10": "pages", "op11": "conversations"}
    for name, f in queries.QUERIES.items():
        rows = spark.read.parquet(f"{SF}/{tables.get(name.split('_')[0], 'documents')}.parquet")
        n = rows.select("conv_id").distinct().count() if "conv_id" in rows.columns else rows.count()
        assert f(spark, SF).count() >= n


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [k for k, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "simhash near-dedup", "benchmark decontamination", "best-fit packing"]
    for _, step in corpus_pipeline.STAGES[:-1]:
        out = step(spark, docs, SF)
        assert out.columns == docs.columns
        ids = out.select("doc_id").distinct()
        assert ids.join(docs, "doc_id", "left_anti").isEmpty() and ids.count() > 0.5 * docs.count()
        docs = out
    assert corpus_pipeline.run(spark, SF).select("doc_id").distinct().count() == docs.count()
