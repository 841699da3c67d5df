import hashlib

from helixframe.llm.common import new_path
from helixframe.llm.warc import _bounds, read_warc, write_warc

BIG, OTHER = "é" * 600, "y" * 999


def pages(spark):
    rows = [(1, "u1", BIG), (2, "u\r\nEvil: 1", BIG), (9, None, BIG), (3, "u3", OTHER), (4, "u4", OTHER), (5, "u5", None), (6, "u6", ""), (7, "u7", "z\r\n\r\nWARC/1.1" * 300), (10**12, "far", BIG)]
    return spark.createDataFrame([(*r, "s") for r in rows], "page_id long, url string, html string, shard string"), rows


def test_round_trip(spark):
    df, rows = pages(spark)
    path = new_path(spark, "t")
    manifest = sorted(write_warc(df, path, roll_bytes=800, shard_bytes=3000).collect())
    assert len(manifest) > 2 and sum(r.records for r in manifest) == len(rows) and len({r.shard for r in manifest}) > 1
    got = {r.page_id: r for r in read_warc(spark, path).collect()}
    for page, url, html in rows:
        body = (html or "").encode()
        r = got[page]
        revisit = html == BIG and page != 10**12
        assert (r.record_type, r.refers_to) == (("revisit", 10**12) if revisit else ("response", None))
        assert (r.payload_bytes, r.payload_digest) == (len(body), hashlib.sha1(body).hexdigest())
        assert r.payload is None if revisit else bytes(r.payload) == body
    again = write_warc(df.repartition(3), new_path(spark, "t"), roll_bytes=800, shard_bytes=3000)
    assert sorted(again.collect()) == manifest


def test_repeats_and_empty_table(spark):
    df, _ = pages(spark)
    one = df.filter("page_id = 1000000000000")
    path = new_path(spark, "t")
    write_warc(one.union(one), path)
    assert [r.record_type for r in read_warc(spark, path).collect()] == ["response"] * 2
    path = new_path(spark, "t")
    assert write_warc(df.limit(0), path).count() == 0
    assert read_warc(spark, path).count() == 0


def test_bounds_take_as_many_jobs_for_any_ids(spark):
    tracker = spark.sparkContext.statusTracker()

    def jobs(ids, name):
        spark.sparkContext.setJobGroup(name, name)
        df = spark.createDataFrame([(i, "x" * 1000) for i in ids], "page_id long, html string")
        bounds = _bounds(df, 10_000)
        spark.sparkContext.setJobGroup(None, None)
        assert len(bounds) == 12 and bounds[0] == min(ids)
        return len(tracker.getJobIdsForGroup(name))

    assert jobs(range(100), "even") == jobs([i**7 for i in range(100)], "heavy")  # most of the second lie close together


def test_very_long_page(spark):
    path = new_path(spark, "t")
    write_warc(spark.createDataFrame([(1, "u", "é" * 3_000_000), (2, "v", "é" * 3_000_000)], "page_id long, url string, html string"), path)
    assert sorted((r.page_id, r.record_type, r.payload_bytes) for r in read_warc(spark, path).collect()) == [(1, "revisit", 6_000_000), (2, "response", 6_000_000)]
