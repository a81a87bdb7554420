"""Operators on documents against plain Python, and their edge cases."""

import collections
import glob
import hashlib
import math
import re
import time
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from circlet.llm import decontam, line_dedup, packing, simhash, token_output
from circlet.llm.common import components, new_path
from circlet.llm.tokens import Encoder

BYTE, WORD = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")
DOCS = "doc_id long, text string"
ODD = [
    "don't 'the 'S 'Re x'LL I'D", "  a  b \n\n c\t d ", "a b\x85c", "½²3 4a4 ³", "œuvre Œ ŉ İx ſ ŉ", "日本 語 е́", "<|endoftext|> x <|startoftext|>", "", "a\x1cb", "!!a ??.,b  ", "é é", None, "x" * 5000, "word " * 9000, "\x00", "😀 a😀b",
]


def docs_of(spark, texts, extra=False):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], DOCS)
    return df.withColumns({c: F.lit(1) for c in ("h", "a", "b", "n", "line", "score", "predicted", "row", "hashes", "stay", "keeper", "fp", "n_lines")}) if extra else df


@pytest.mark.parametrize("path,words", [(BYTE, False), (WORD, True)])
def test_encoder_equals_tokenizer(path, words):
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    got = Encoder(path, words, cache=50)(ODD)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [t.encode(x or "", add_special_tokens=False).ids for x in ODD]


def test_orc_round_trip(spark):
    rows = [(7, "b c"), (3, None), (3, "x"), (None, "null id"), (9, "")] + [(100 + i, "some words here") for i in range(50)]
    df = spark.createDataFrame(rows, DOCS).withColumn("shard", F.lit("clash"))
    path = token_output.write_orc(token_output.encode(df, BYTE, shards=4), new_path(spark, "orc"))
    got = token_output.digest(token_output.read_orc(spark, path)).collect()
    assert len(got) == len(rows)
    got.sort(key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda x: (x is not None, x or 0))
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1]]
    t = Tokenizer.from_file(BYTE)
    want = sorted(zlib.crc32(np.array(t.encode(x or "", add_special_tokens=False).ids + [2], "<u4").tobytes()) for _, x in rows)
    assert sorted(r.ids_crc32 for r in got) == want
    assert [r.doc_id for r in token_output.find(spark, path, [7]).collect()] == [7]


def test_orc_splits_a_hot_doc_id(spark):
    rows = [(None, f"text {i}") for i in range(300)] + [(5, "same")] * 300 + [(9, "last")]
    df = token_output.encode(spark.createDataFrame(rows, DOCS).repartition(4), BYTE, shards=8)
    sizes = [r["count"] for r in df.groupBy("shard").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 200
    got = token_output.digest(token_output.read_orc(spark, token_output.write_orc(df, new_path(spark, "orc")))).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None] * 300 + [5] * 300 + [9]
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1]]


def test_orc_files_hold_stripes_indexes_and_bloom_filters(spark):
    """Read from the files' own footers, and from what a lookup reads."""
    from pyarrow import orc

    df = spark.createDataFrame([(i, f"some words of document {i} " * 4) for i in range(0, 60_000, 2)], DOCS)
    path = token_output.write_orc(token_output.encode(df, BYTE, shards=2), new_path(spark, "orc"), stripe_bytes=1 << 16, stride=1000)
    files = glob.glob(path.removeprefix("file://") + "/*.orc")
    held = [orc.ORCFile(f) for f in files]
    assert len(files) == 2 and max(f.nstripes for f in held) > 1 and all(f.compression == "ZSTD" and f.row_index_stride == 1000 for f in held)
    spans = sorted((t["doc_id"][0].as_py(), t["doc_id"][-1].as_py()) for f in held for t in [pa.Table.from_batches([f.read_stripe(k)]) for k in range(f.nstripes)])
    assert all(a <= b for a, b in spans) and all(x[1] < y[0] for x, y in zip(spans, spans[1:]))  # stripes in order: their minima and maxima prune
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    reader = jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(files[0]), jvm.org.apache.orc.OrcFile.readerOptions(conf))
    rows = reader.rows()
    include = spark.sparkContext._gateway.new_array(jvm.boolean, reader.getSchema().getMaximumId() + 1)
    include[2] = True  # doc_id
    index = rows.readRowIndex(0, include, include)
    assert index.getBloomFilterIndex()[2].getBloomFilterCount() >= 1
    rows.close()
    assert [r.doc_id for r in token_output.find(spark, path, [10, 11]).collect()] == [10]
    assert "In(doc_id, [10,11])" in token_output.find(spark, path, [10, 11])._jdf.queryExecution().toString()


def test_orc_of_no_documents(spark):
    path = token_output.write_orc(token_output.encode(spark.createDataFrame([], DOCS), BYTE), new_path(spark, "orc"))
    assert token_output.digest(token_output.read_orc(spark, path)).count() == 0


LINE = "This is a long line that many documents share"


def test_line_dedup(spark):
    texts = [f"{LINE}\nown {i}\n \t{LINE.upper()}\r" for i in range(6)] + [None, "", "\n\n", LINE[:39], "x" * 39 + "\n" + "x" * 39] + [f"É{LINE}" if i % 2 else f"é{LINE}" for i in range(6)]
    got = {r.doc_id: r for r in line_dedup.dedup_lines(docs_of(spark, texts, True)).collect()}
    for i in range(5):
        assert got[i].text == f"own {i}" and got[i].n_dropped == 2 and got[i].n_lines == 3
    assert got[5].text == texts[5] and got[5].n_dropped == 0
    assert got[6].text is None and got[6].n_lines == 1 and got[8].n_lines == 3
    assert all(got[i].n_dropped == 0 for i in range(6, 17))
    assert got[0].row == 1 and got[0].hashes == 1


def test_line_dedup_counts_documents_not_rows(spark):
    rows = [(1, LINE)] * 5 + [(2, LINE), (3, LINE), (4, LINE), (None, LINE)]
    assert line_dedup.dedup_lines(spark.createDataFrame(rows, DOCS)).agg(F.sum("n_dropped")).first()[0] == 0
    got = line_dedup.dedup_lines(spark.createDataFrame([*rows, (5, LINE)], DOCS)).collect()
    assert sorted(r.doc_id for r in got if r.n_dropped) == [1] * 5 + [2, 3, 4]
    assert line_dedup.dedup_lines(spark.createDataFrame([], DOCS)).count() == 0


def test_line_dedup_equals_plain_python(spark):
    """The query's columns on texts of thousands of lines, half of them one line, with repeated doc_ids, nulls and clashing columns."""
    rng = np.random.default_rng(9)
    lines = [f"Line number {i} of a kind that is long enough to count" for i in range(30)] + ["short", "", "  ", "\u00c9" * 41]
    hot = "the one line that half of all documents hold many times over"
    texts = ["\n".join(rng.choice(lines, rng.integers(1, 12))) for _ in range(150)] + [f"{hot}\n\t{hot.upper()} \nx{i}" for i in range(150)]
    texts += [None, "", "\n" * 5000, "\n".join([hot, *map(str, range(20_000)), hot]), "\n".join(lines * 300)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (3, hot + "\nother"), (None, hot)]
    keys = lambda t: [re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r")) for x in (t or "").split("\n")]
    held = collections.defaultdict(set)
    for i, t in rows:
        for k in keys(t):
            if i is not None and len(k) >= 40:
                held[k].add(i)
    want = []
    for i, t in rows:
        kept = [x for x, k in zip((t or "").split("\n"), keys(t)) if not (i is not None and len(held[k]) >= 5 and i != max(held[k]))]
        want.append((i, len(keys(t)), len(keys(t)) - len(kept), "\n".join(kept)))
    df = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("own") for c in ("places", "t1", "lines", "n_lines", "lost_by")})
    got = line_dedup.dedup_lines(df)
    assert got.columns == ["doc_id", "text", "places", "t1", "lines", "lost_by", "n_lines", "n_dropped"]
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text or "") for r in got.collect()), key=repr) == sorted(want, key=repr)
    assert {r.lost_by for r in got.collect()} == {"own"}


def test_packing_plan():
    rng = np.random.default_rng(0)
    for _ in range(300):
        size = int(rng.integers(1, 60))
        histogram = {int(a): int(rng.integers(0, 9)) for a in rng.integers(1, size + 1, 12)}
        got = collections.Counter()
        for times, items in packing.plan(histogram, size):
            assert times > 0 and sum(n * k for n, k in items) <= size
            assert sum(k for n, k in items if 3 * n > size) <= 2
            for n, k in items:
                got[n] += times * k
        assert got == {n: c for n, c in histogram.items() if c}
    assert packing.plan({}) == []
    with pytest.raises(ValueError):
        packing.plan({5: 1}, 4)


def test_packing_rows(spark):
    texts = ["a b c " * (i % 60) for i in range(200)] + [None, "", "word " * 200]
    df = docs_of(spark, texts, True).union(docs_of(spark, texts, True).limit(3))
    got = packing.pack(df, WORD, capacity=128).toPandas()
    t = Tokenizer.from_file(WORD)
    assert got.length.sum() == sum(len(t.encode(x or "", add_special_tokens=False).ids) + 1 for x in [*texts, *texts[:3]])
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert (g.offset.to_numpy() == np.concatenate(([0], g.length.cumsum()[:-1]))).all() and g.length.sum() <= 128
    assert got.sequence_id.nunique() <= math.ceil(got.length.sum() / 128) * 1.05 + 1
    # each piece against the plain tokenizer: where it starts, its length and its tokens
    want = []
    for i, x in [*enumerate(texts), *enumerate(texts[:3])]:
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(i, k, 128 * k, len(ids[128 * k : 128 * k + 128]), zlib.crc32(ids[128 * k : 128 * k + 128].tobytes())) for k in range(-(-len(ids) // 128))]
    assert sorted(got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None)) == sorted(want)
    assert packing.pack(spark.createDataFrame([], DOCS), WORD).count() == 0


def plain_fingerprint(text, k=4):
    w = (text or "").encode().translate(simhash.LOWER_AZ).split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + k]), 42) for i in range(len(w) - k + 1)] or [xxhash.xxh64_intdigest(b" ".join(w), 42)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprint(monkeypatch):
    texts = [None, "", " \t\n", "a", "A b", "a b c d", "a b c d e a b c d e", "É é x y z w", "word other third " * 700]
    assert [simhash.fingerprint(t) for t in texts] == [plain_fingerprint(t) for t in texts]
    chunks = simhash._chunks
    monkeypatch.setattr(simhash, "_chunks", lambda data: chunks(data, 7))
    assert [simhash.fingerprint(t) for t in texts] == [plain_fingerprint(t) for t in texts]


def test_golay_keys_are_complete():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 2**64, 1500, dtype="u8")
    for spans in ((0, 64), (41, 64), (18, 41), (0, 18)):
        b = a.copy()
        for k in range(4):
            lo, hi = spans if k < 3 else (0, 64)
            b ^= np.uint64(1) << rng.integers(lo, hi, len(a)).astype("u8")
        own = [collections.defaultdict(set), collections.defaultdict(set)]
        for held, fps in zip(own, (a, b)):
            for r, k in zip(*simhash.keys(fps)):
                held[r].add(k)
        assert all(own[0][i] & own[1][i] for i in range(len(a)))


def plain_components(fps, bits=4):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= bits:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


@pytest.mark.parametrize("limit, bits", [(4096, 4), (1, 4), (1, 3), (1, 2), (4096, 3), (1, 0)])
def test_links_equal_brute_force(spark, limit, bits):
    rng = np.random.default_rng(5)
    fps = rng.integers(0, 2**64, 40, dtype="u8")
    for _ in range(160):
        x = fps[rng.integers(len(fps))]
        for _ in range(rng.integers(1, 6)):
            x ^= np.uint64(1) << np.uint64(rng.integers(64))
        fps = np.append(fps, x)
    fps = np.unique(fps)
    found = simhash.links(spark.createDataFrame([(int(x),) for x in fps.view("i8")], "fp long"), bits, limit)
    roots = {r.node: r.root for r in components(found).collect()}
    groups = collections.defaultdict(set)
    for x in fps.view("i8").tolist():
        groups[roots.get(x, x)].add(x)
    want = collections.defaultdict(set)
    for x, g in zip(fps.view("i8").tolist(), plain_components(fps.tolist(), bits)):
        want[g].add(x)
    assert {frozenset(g) for g in groups.values()} == {frozenset(g) for g in want.values()}


def test_near_groups(spark):
    same = "one two three four five six seven"
    rows = [(5, same), (3, same.upper()), (3, same), (None, same), (8, None), (9, ""), (1, "quite another text than these others"), (None, "a lone text with no id at all")]
    got = simhash.near_groups(spark.createDataFrame(rows, DOCS).withColumn("fp", F.lit("x"))).collect()
    assert sorted((r.doc_id or 0, r.component_id) for r in got if r.component_id is not None) == [(0, 3), (1, 1), (3, 3), (3, 3), (5, 3), (8, 8), (9, 8)]
    kept = simhash.near_dedup(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == [1, 3, 8]
    assert simhash.near_groups(spark.createDataFrame([], DOCS)).count() == 0


def test_near_copies_equal_exact_similarity(spark, monkeypatch):
    """Groups are those of exact Jaccard similarity: also where one phrase is repeated, at the edge of 0.8, and in buckets of many."""
    rng = np.random.default_rng(9)
    word = lambda: f"w{rng.integers(10**9)}"
    texts = ["the " * 400 + " ".join(word() for _ in range(30)) for _ in range(4)]
    for _ in range(4):
        base = [word() for _ in range(104)]
        texts.append(" ".join(base))
        for _ in range(25):
            w = list(base)
            for k in rng.choice(104, rng.integers(1, 6), replace=False):
                w[k] = word()
            texts.append(" ".join(w))
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (t.split() for t in texts)]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) and root[i] != root[j]:
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if r == old else r for r in root]
    want = sorted(set(root))
    assert {0, 1, 2, 3} < set(want) and len(want) < 100
    for chunk, bucket in ((256, 1 << 18), (10, 1 << 18), (10, 3)):  # small chunks and buckets: one group is many tasks' work
        monkeypatch.setattr(simhash, "CHUNK", chunk)
        monkeypatch.setattr(simhash, "BUCKET", bucket)
        assert sorted(r.doc_id for r in simhash.near_dedup(docs_of(spark, texts)).collect()) == want


def test_near_dedup_goes_by_golay_keys(spark, monkeypatch):
    """Near copies are found by Golay keys of the SimHash prints alone, where no bands propose any; sets of one print are compared too."""
    rng = np.random.default_rng(3)
    base = [f"w{rng.integers(10**9)}" for _ in range(1500)]
    texts = [" ".join(base), " ".join(base[:700] + ["changed"] + base[701:]), " ".join(f"w{rng.integers(10**9)}" for _ in range(1500))]

    def nothing(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([], pa.binary())] * 2, names=["u", "v"])

    monkeypatch.setattr(simhash, "_proposals", nothing)
    assert sorted(r.doc_id for r in simhash.near_dedup(docs_of(spark, texts)).collect()) == [0, 2]
    named = spark.createDataFrame([(7, b"a"), (7, b"b"), (15, b"c"), (15, b"c"), (-1, b"d")], "fp long, node binary")
    assert {frozenset((bytes(r.u), bytes(r.v))) for r in simhash.fuzzy_pairs(named).collect()} == {frozenset((b"a", b"b")), frozenset((b"a", b"c"))}


def test_near_dedup_of_texts_that_share_a_doc_id(spark):
    one, two = ("one two three four five six seven", "quite another text than these others here")
    rows = [(5, one), (5, two), (5, two.upper()), (3, one), (3, one), (7, None), (7, two + " " + one)]
    for part in (1, 7):
        kept = simhash.near_dedup(spark.createDataFrame(rows, DOCS).repartition(part)).collect()
        got = collections.Counter((r.doc_id, (r.text or "").lower()) for r in kept)
        assert got == {(3, one): 1, (5, two): 1, (7, ""): 1, (7, two + " " + one): 1}
        upper = [r.text for r in kept if r.doc_id == 5][0]
        assert part == 1 or upper == first
        first = upper


def test_components_of_a_long_chain(spark):
    rng = np.random.default_rng(2)
    ids = rng.permutation(300).tolist()
    links = spark.createDataFrame([*zip(ids[:-1], ids[1:]), (5, 5), (None, 3), (ids[0], ids[1])], "u long, v long")
    got = {r.node: r.root for r in components(links).collect()}
    assert len(got) == 300 and set(got.values()) == {0}
    assert components(links.where("false")).count() == 0


def plain_hits(text, items, n=10):
    import re

    words = lambda t: re.findall("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
    w, hit, found = words(text), set(), set()
    for item, t in items:
        b = words(t)
        k = min(n, len(b))
        for i in range(len(b) - k + 1) if k else ():
            for j in range(len(w) - k + 1):
                if w[j : j + k] == b[i : i + k]:
                    hit |= set(range(j, j + k))
                    found.add(str(item))
    return len(w), len(hit), ",".join(sorted(found))


def test_decontamination(spark):
    letters = "alpha beta gamma delta eps zeta eta theta iota kappa lam mu nu xi".split()
    bench = [(1, " ".join(letters)), (2, "Short Item"), (10, "É one"), (3, None), (4, "..."), (None, "alpha"), (2, "short item"), (11, " ".join(letters[:10]))]
    texts = [" ".join(letters), "x " + ", ".join(letters[1:12]).upper(), "short-item short", "é one É one", None, "", "clean text", " ".join(letters[:9]), "a short item " * 300]
    b = spark.createDataFrame(bench, "item_id long, text string").withColumn("h", F.lit(1))
    known = [x for x in bench if x[0] is not None]
    for limit in (decontam.BROADCAST_BYTES, 0):
        old, decontam.BROADCAST_BYTES = decontam.BROADCAST_BYTES, limit
        try:
            got = {r.doc_id: r for r in decontam.contamination(docs_of(spark, texts, True), b).collect()}
        finally:
            decontam.BROADCAST_BYTES = old
        for i, t in enumerate(texts):
            n, hit, items = plain_hits(t, known)
            r = got[i]
            assert (r.n_words, r.n_hit, ",".join(r["items"]), r.contaminated, r.n_items) == (n, hit, items, hit > 0, len(items.split(",")) if items else 0), (i, r)
    # rows of one doc_id have hits of their own; a window may be in half of all texts, some of it repeated
    rows = [(1, texts[0]), (1, None), (1, "alpha beta"), (None, texts[0]), (2, "x"), (2, "x")] + [(i % 3, f"{texts[0]} tail {i % 40}") for i in range(200)]
    for limit in (decontam.BROADCAST_BYTES, 2000, 0):
        old, decontam.BROADCAST_BYTES = decontam.BROADCAST_BYTES, limit
        try:
            got = [(r.doc_id, r.n_words, r.n_hit) for r in decontam.contamination(spark.createDataFrame(rows, DOCS), b).collect()]
        finally:
            decontam.BROADCAST_BYTES = old
        assert sorted(got, key=repr) == sorted(((i, *plain_hits(t, known)[:2]) for i, t in rows), key=repr)
    kept = decontam.decontaminate(docs_of(spark, texts, True).withColumn("t1", F.lit("own")), b)
    assert {r.t1 for r in kept.collect()} == {"own"}
    assert sorted(r.doc_id for r in kept.collect()) == [4, 5, 6, 7] and "stay" in kept.columns
    assert decontam.contamination(docs_of(spark, texts), b.where("false")).where("contaminated").count() == 0
    assert decontam.contamination(spark.createDataFrame([], DOCS), b).count() == 0


def test_line_hash_is_what_sha_compares(spark):
    df = docs_of(spark, ["a\nb"]).select(F.sha2(F.col("text").cast("binary"), 256).alias("x"))
    assert df.first().x == hashlib.sha256(b"a\nb").hexdigest()


def test_long_text_with_windows_of_several_sizes_takes_linear_time(spark):
    """Three sizes of windows over one text of 400,000 words: seconds, where copies of the words beside each window take minutes."""
    words = [f"w{i * 7919 % 5003}" for i in range(400_000)]
    words[1000:1003] = ["alpha", "beta", "gamma"]
    words[399_990:] = [f"x{i}" for i in range(10)]
    benchmark = spark.createDataFrame([(1, "Alpha beta, gamma"), (2, "a b c d e f g"), (3, " ".join(f"x{i}" for i in range(10)))], "item_id long, text string")
    docs = spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")
    began = time.time()
    (got,) = decontam.contamination(docs, benchmark).collect()
    assert (got.n_words, got.n_hit, list(got["items"])) == (400_000, 13, ["1", "3"])
    assert time.time() - began < 60


def test_decontamination_moves_no_texts(spark, monkeypatch):
    """The few texts that go are broadcast, the others are neither shuffled nor sorted; beyond the limit it is a join of both sides, with the same rows."""
    item = "one two three four five six seven eight nine ten"
    b = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = docs_of(spark, ["before " + item + " after", "clean words", None, ""])
    for limit, joins in ((decontam.BROADCAST_BYTES, "BroadcastHashJoin"), (0, "SortMergeJoin")):
        monkeypatch.setattr(decontam, "BROADCAST_BYTES", limit)
        kept = decontam.decontaminate(docs, b)
        plan = kept._jdf.queryExecution().executedPlan().toString()
        assert joins in plan and ("Exchange hashpartitioning" in plan) == (limit == 0)
        assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 3]
