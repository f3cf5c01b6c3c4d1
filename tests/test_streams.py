"""Recorded listings and stateful record streams."""

import random

import pytest
from pyspark.sql import functions as F

from folioforge.sources import recorded
from folioforge.streaming import records, watch


def _pages(spark, n, version=1):
    return spark.createDataFrame([(f"s{i % 3}", f"p{i}", version * 1000 + i, f"u{i}", "b" * i) for i in range(n)], "space string, source_id string, version long, url string, body string")


def test_recorded_pages_are_read_in_batch(spark, tmp_path):
    recorded.record(_pages(spark, 90), str(tmp_path), 1, per_response=4)
    recorded.record(_pages(spark, 10, 2), f"file://{tmp_path}", 2)
    read = recorded.registered(spark).read.format("recorded").option("path", f"file://{tmp_path}").load()
    assert sorted(map(tuple, read.collect())) == sorted([tuple(r) for r in _pages(spark, 90).collect()] + [tuple(r) for r in _pages(spark, 10, 2).collect()])
    assert read.rdd.getNumPartitions() > 3  # a space's responses are dealt over tasks


def test_a_broken_listing_is_neither_read_nor_skipped(spark, tmp_path):
    root, out, checkpoint = (f"{tmp_path}/{n}" for n in ("root", "out", "checkpoint"))
    recorded.registered(spark)

    def start():
        stream = spark.readStream.format("recorded").option("path", root).load()
        watch.published(stream, lambda rows, n: rows.write.mode("append").parquet(out), checkpoint).awaitTermination()
        return spark.read.schema(recorded.SCHEMA).parquet(out)

    recorded.record(_pages(spark, 60), root, 1, per_response=5)
    assert start().count() == 60
    recorded.record(_pages(spark, 60, 2), root, 2, per_response=5)
    listing = f"{root}/run=2/listing"
    rows = [tuple(r) for r in spark.read.parquet(listing).collect()]
    schema = "space string, cursor long, next string, n long, newest long"
    end = next(r for r in rows if r[0] == "s1" and r[2] is None)
    spark.createDataFrame([r for r in rows if r != end], schema).write.mode("overwrite").parquet(listing)
    recorded.record(_pages(spark, 30, 3), root, 3, per_response=5)
    found = start()
    assert {(r.space, r.n) for r in found.groupBy("space").agg(F.count("*").alias("n")).collect()} == {("s0", 50), ("s1", 20), ("s2", 50)}
    assert start().count() == 120
    spark.createDataFrame([end], schema).write.mode("append").parquet(listing)
    found = start()
    assert found.count() == 150 == found.dropDuplicates(["source_id", "version"]).count()


def test_links_stay_on_their_origin():
    base = "https://wiki.invalid"
    assert recorded.next_cursor(None, base) is None and recorded.next_cursor("/rest?cursor=4", base) == 4
    assert recorded.next_cursor("https://wiki.invalid/rest?x=1&cursor=7", base) == 7
    for link in ("https://other.invalid/rest?cursor=4", "http://wiki.invalid/rest?cursor=4", "//other.invalid/?cursor=1"):
        with pytest.raises(recorded.ForeignLink):
            recorded.next_cursor(link, base)


def _expected(events, in_flight, stale_ms):
    """States after all events; ``events`` are ``key, number, ms, state`` in order of time."""
    end, out = max(e[2] for e in events), {}
    for key, number, ms, state in events:
        _, old, due, requeued = out.get(key, (None, None, None, 0))
        requeued += due is not None and ms > due
        out[key] = (number, state, ms + stale_ms if state in in_flight else None, requeued)
    return {k: (n, records.REQUEUED, r + 1) if due is not None and due <= end else (n, s, r) for k, (n, s, due, r) in out.items()}


@pytest.mark.parametrize("cuts", [[], [40], [13, 14, 150, 151]])
def test_states_do_not_depend_on_batches(spark, tmp_path, cuts):
    rng = random.Random(7)
    ms, events = 1_700_000_000_000, []
    for n in range(200):
        ms += rng.choice([1, 500, 5000, 20_000])
        events.append((rng.randrange(9), n, ms, rng.choice(["fetching", "parsing", "done", "failed"])))
    schema = "key long, number long, ms long, state string"
    for low, high in zip([0, *cuts], [*cuts, 200], strict=True):
        part = spark.createDataFrame(events[low:high], schema).withColumn("at", F.timestamp_millis("ms")).drop("ms").repartition(2)
        part.write.mode("append").parquet(f"{tmp_path}/events")
        stream = spark.readStream.schema(part.schema).parquet(f"{tmp_path}/events")
        records.run(spark, records.states(stream, ("fetching", "parsing"), 30_000), f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    got = {r.key: (r.number, r.state, r.requeued) for r in records.latest(spark, f"{tmp_path}/out").collect()}
    assert got == _expected(events, ("fetching", "parsing"), 30_000) and any(s == records.REQUEUED for _, s, _ in got.values())
