"""Benchmark decontamination with DataFrame functions alone.

Windows of ``WINDOW`` consecutive words of the benchmark are a set of 64-bit
hashes with the words beside them. Each document's words are scanned window by
window, all sizes in one pass; a hit on the hash is verified on the words. The
set is broadcast where its measured size allows (``BROADCAST_BYTES``). Beyond
it, its hashes alone are broadcast as long as they fit, so that only windows
that may be hits are shuffled; beyond that too, windows are joined by shuffle.
Hits belong to texts, by 128 bits of hashes, not to doc_ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import aside, lower_az, stage, table

WINDOW = 10
BROADCAST_BYTES = 64 << 20
#: Whatever isn't in [^\x00-\x2F\x3A-\x60\x7B-\x7F] once A-Z is lower-cased.
NO_WORD = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def words_of(text):
    """Words of a text; null and empty texts have none."""
    return F.array_remove(F.split(lower_az(F.coalesce(text, F.lit(""))), NO_WORD, -1), "")


def with_window_hashes(rows: DataFrame, sizes: list[int]) -> DataFrame:
    """rows (w, ...) with h<n> for each n of sizes: hashes of all windows of n words, by place.

    A window's hash is made from those of its halves, so each costs as many
    steps as its size has binary digits. Each column is used twice and is
    therefore a projection of its own, which is evaluated once.
    """
    need, ahead = {1}, list(sizes)
    while ahead:
        n = ahead.pop()
        if n not in need:
            need.add(n)
            ahead += [1 << (n - 1).bit_length() - 1, n - (1 << (n - 1).bit_length() - 1)]
    rows = rows.withColumn("h1", F.transform("w", lambda x: F.xxhash64(x)))
    for n in sorted(need - {1}):
        half = 1 << (n - 1).bit_length() - 1
        count = F.greatest(F.lit(0), F.size("w") - (n - 1))
        rows = rows.withColumn(f"h{n}", F.zip_with(F.slice(f"h{half}", 1, count), F.slice(f"h{n - half}", F.lit(half + 1), count), lambda x, y: F.xxhash64(x, y)))
    return rows


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """h, size, words, items (distinct item_ids that hold this window): one row for each distinct window.

    An item of fewer words than the window, but not none, is one window of its
    own size. Items without item_id or words are left out.
    """
    w = benchmark.where("item_id is not null").select("item_id", words_of(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - (window - 1)))
    each = w.select("item_id", "w", F.explode(starts).alias("at")).select("item_id", F.slice("w", F.col("at"), window).alias("w"))
    each = with_window_hashes(each.groupBy("w").agg(F.collect_set("item_id").alias("items")), list(range(1, window + 1)))
    h = F.coalesce(*[F.when(F.size("w") == n, F.try_element_at(f"h{n}", F.lit(1))) for n in range(1, window + 1)])
    return each.select(h.alias("h"), F.size("w").alias("size"), F.col("w").alias("words"), "items")


HASH_BYTES = 64  # of one hash in a broadcast table


def text_name():
    """128 bits that name a text."""
    return F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(2), "text").alias("t2")


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """t1, t2, n_hit, items: of texts with hits, the words inside any occurring window and the distinct items, sorted as strings.

    A text's hits are bounded by its own words, since a window that occurs at
    a place is one row whatever number of items hold it; copies of a text, and
    a window that many documents share, are summed up before the shuffle.
    """
    set_ = stage(benchmark_windows(benchmark, window), "windows")
    sizes, size_bytes, count = [], 0, 0
    for r in set_.groupBy("size").agg(F.count("*").alias("n"), F.sum(F.lit(64) + F.octet_length(F.array_join("words", " ")) + 24 * F.size("words") + 8 * F.size("items")).alias("b")).collect():  # at most ``window`` rows
        sizes.append(r["size"])
        count += r.n
        size_bytes += r.b
    if not sizes:
        return docs.select(*text_name()).where("false").select("t1", "t2", F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<string>").alias("items"))
    set_ = set_.withColumnsRenamed({"words": "_words", "size": "_size"})
    held = with_window_hashes(docs.select(*text_name(), words_of(F.col("text")).alias("w")), sizes)
    # Hashes alone are exploded, the place saying which size's they are: rows of structs would each carry a copy of the words.
    # "outer": else the optimiser filters on the size of the array, which it then makes twice
    at = held.select("t1", "t2", "w", F.posexplode_outer(F.concat(*[F.col(f"h{n}") for n in sizes])).alias("at", "h"))
    size, place, before = F.lit(sizes[0]), F.col("at"), F.lit(0)
    for n, then in zip(sizes, sizes[1:]):
        before = before + F.greatest(F.lit(0), F.size("w") - (n - 1))
        size, place = F.when(F.col("at") >= before, then).otherwise(size), F.when(F.col("at") >= before, F.col("at") - before).otherwise(place)
    at = at.select("t1", "t2", "w", "h", size.alias("size"), place.alias("at"))
    own = F.slice("w", F.col("at") + 1, F.col("size"))
    if size_bytes <= BROADCAST_BYTES:
        met = at.join(F.broadcast(set_), "h").where((F.col("size") == F.col("_size")) & (own == F.col("_words")))
    else:
        if count * HASH_BYTES <= BROADCAST_BYTES:
            at = at.join(F.broadcast(set_.select("h").distinct()), "h", "left_semi")
        # staged, so that a window in many documents is split in the join
        maybe = stage(at.select("t1", "t2", "at", "size", "h", own.alias("_w")).where("h is not null"), "maybe")
        met = maybe.join(set_.hint("merge"), "h").where((F.col("size") == F.col("_size")) & (F.col("_w") == F.col("_words")))
    inside = F.array_distinct(F.flatten(F.collect_set(F.sequence("at", F.col("at") + F.col("size") - 1))))
    items = F.array_sort(F.transform(F.array_distinct(F.flatten(F.collect_set("items"))), lambda x: x.cast("string")))
    return met.select("t1", "t2", "at", "size", "items").groupBy("t1", "t2").agg(F.size(inside).cast("long").alias("n_hit"), items.alias("items"))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items, contaminated: one row for each row of docs.

    Each row's figures are those of its own text, whether doc_ids repeat or are
    null. Null and empty texts have no words. Without benchmark items nothing
    is hit. Other columns are ignored.
    """
    held = docs.select("doc_id", F.size(words_of(F.col("text"))).cast("long").alias("n_words"), *text_name())
    hit = stage(hits(docs, benchmark, window), "hits")
    none = F.array().cast("array<string>")
    return held.join(hit.hint("merge"), ["t1", "t2"], "left").select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"), F.coalesce("items", none).alias("items"), F.col("n_hit").isNotNull().alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs without the rows whose text holds a window of the benchmark; all columns stay as they are."""
    hit = stage(hits(docs, benchmark, window).select("t1", "t2"), "hits")
    # texts are not shuffled and sorted for the few that go, unless these are too many to broadcast
    hit = F.broadcast(hit) if hit.count() * HASH_BYTES <= BROADCAST_BYTES else hit.hint("merge")
    held, back = aside(docs, "t1", "t2")
    return held.select("*", *text_name()).join(hit, ["t1", "t2"], "left_anti").drop("t1", "t2").withColumnsRenamed(back).select(*docs.columns)


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


OP8_SQL = r"""
WITH dw AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
bw AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
bg AS (SELECT DISTINCT item_id, array_to_string(w[i:least(i + 9, len(w))], ' ') AS g, least(10, len(w)) AS n
       FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 8))) AS i FROM bw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bg),
dg AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, sizes WHERE len(w) >= n)),
h AS (SELECT doc_id, i, dg.n, item_id FROM dg JOIN bg USING (g, n)),
pos AS (SELECT doc_id, count(DISTINCT p)::BIGINT AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM h)) GROUP BY doc_id),
it AS (SELECT doc_id, count(*)::BIGINT AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
SELECT dw.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM dw LEFT JOIN pos USING (doc_id) LEFT JOIN it USING (doc_id)
"""
