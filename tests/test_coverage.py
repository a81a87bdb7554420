"""Sampled coverage: windows depend on the seed alone, and large files alone are thinned out."""

from circlet.operators import coverage

SIZES = [("a", 100_000), ("b", 15_000), ("c", 400_000)]


def windows(spark, **kw):
    sizes = spark.createDataFrame(SIZES, "chrom string, length long")
    return [(r.chrom, r.start, r.stop) for r in coverage.draw_windows(sizes, 200, 10_000, **kw).orderBy("chrom", "start").collect()]


def test_windows_depend_on_the_seed_alone(spark):
    one = windows(spark)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        assert windows(spark) == one
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert windows(spark, seed=2) != one
    assert 150 < len(one) <= 200
    assert {c for c, _, _ in one} == {"a", "c"}  # b is too short for a window behind its first width
    length = dict(SIZES)
    assert all(start >= 10_000 and stop == start + 10_000 and stop <= length[c] for c, start, stop in one)
    assert sum(c == "c" for c, _, _ in one) > 3 * sum(c == "a" for c, _, _ in one)


def test_windows_keep_away_from_listed_regions(spark):
    listed = spark.createDataFrame([("c", 0, 200_000)], "chrom string, start long, stop long")
    got = windows(spark, listed=listed)
    assert got and all(c != "c" or start >= 210_000 for c, start, _ in got)


def test_lengths_inserts_and_thinning(spark):
    reads = spark.createDataFrame([("a", 20_000, 20_100, 100, 2, 300), ("a", 20_010, 20_110, 100, 2 + 16, -300), ("a", 20_020, 20_100, 80, 2, 20_000), ("a", 90_000, 90_100, 500, 2, 9)], "chrom string, start long, stop long, length int, flag int, tlen int")
    at = spark.createDataFrame([("a", 15_000, 25_000)], "chrom string, start long, stop long")
    r = coverage.sampled_coverage(reads, at).first()
    assert (round(r.read_length, 6), r.insert_size, round(r.proper, 6), r.windows) == (round(280 / 3, 6), 300.0, round(2 / 3, 6), 1)
    assert round(r.median, 6) == round(3 * 280 / 3 / 10_001, 6)
    stats = spark.createDataFrame([(40.0,), (12.0,), (None,)], "median double")
    assert [x.keep for x in coverage.thinning(stats, 49.0).collect()] == [1.0, 1.0, 1.0]
    assert [x.keep for x in coverage.thinning(stats, 60.0).collect()] == [0.25, 0.4, 0.4]
