"""Registered queries of recorded listings and of stateful streams, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.plans import fixtures as fx
from folioforge.plans.registry import Registry
from folioforge.plans.scratch import new_dir
from folioforge.sources import recorded
from folioforge.streaming import records, watch

query = Registry()
QUERIES, SQL = query.QUERIES, query.SQL


def _recorded(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("page_id")
    return fx.table(spark, sf_dir, "pages").select(F.concat(F.lit("s"), i % 3).alias("space"), i.cast("string").alias("source_id"), (i * 10).alias("version"), "url", F.col("html").alias("body"))


@query("SELECT 's' || (page_id % 3) AS space, page_id, md5(html) AS body, 1 AS n_read, CASE WHEN page_id % 2 = 0 THEN 0 WHEN page_id % 3 <> 1 THEN 1 ELSE 2 END AS batch FROM pages")
def src07_recorded_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-07: pages listed in two runs, read as a stream that is started three times: in its second run the listing of
    one space has broken off, so that space waits for the third start; every page is read once."""
    recorded.registered(spark)
    root, out, checkpoint = (new_dir(spark, n) for n in ("recorded", "read", "checkpoint"))
    pages = _recorded(spark, sf_dir)
    starts = 0

    def started() -> None:
        nonlocal starts
        stream = spark.readStream.format("recorded").option("path", root).load()
        write = lambda rows, _, n=starts: rows.withColumn("batch", F.lit(n)).write.mode("append").parquet(out)
        watch.published(stream, write, checkpoint).awaitTermination()
        starts += 1

    recorded.record(pages.where("cast(source_id as long) % 2 = 0"), root, 1)
    started()
    late = pages.where("cast(source_id as long) % 2 = 1")
    recorded.record(late, root, 2)
    # The listing's last lines of a space are still to come.
    listing = spark.read.schema("space string, cursor long, next string, n long, newest long").parquet(f"{root}/run=2/listing")
    last = listing.where("space = 's1' and next is null")
    held = new_dir(spark, "held")
    last.write.parquet(held)
    whole = new_dir(spark, "listing")
    listing.join(last.select("space", "cursor"), ["space", "cursor"], "left_anti").write.parquet(whole)
    spark.read.parquet(whole).write.mode("overwrite").parquet(f"{root}/run=2/listing")
    started()
    spark.read.parquet(held).write.mode("append").parquet(f"{root}/run=2/listing")
    started()
    rows = spark.read.parquet(out).groupBy("space", "source_id", "batch").agg(F.max(F.md5("body")).alias("body"), F.count(F.lit(1)).alias("n_read"))
    return rows.select("space", F.col("source_id").cast("long").alias("page_id"), "body", "n_read", "batch")


@query("SELECT 's' || (page_id % 3) AS space, count(*) AS n, max(page_id * 10) AS newest, sum(strlen(html))::BIGINT AS bytes FROM pages GROUP BY 1")
def src07_recorded_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-07, SRC-08: the same source in batch, and the newest version of each space."""
    root = new_dir(spark, "recorded")
    recorded.record(_recorded(spark, sf_dir), root, 1)
    read = recorded.registered(spark).read.format("recorded").option("path", root).load()
    return read.groupBy("space").agg(F.count(F.lit(1)).alias("n"), F.max("version").alias("newest"), F.sum(F.octet_length("body")).alias("bytes"))


@query("""WITH e AS (SELECT user_id, event_id, event_type, epoch_ms(ts) AS ms, lead(epoch_ms(ts)) OVER (PARTITION BY user_id ORDER BY event_id) AS after FROM events),
s AS (SELECT *, event_type IN ('view', 'error') AND coalesce(after > ms + 3600000, ms + 3600000 <= (SELECT max(ms) FROM e)) AS stuck FROM e)
SELECT user_id AS key, max(event_id) AS number, CASE WHEN arg_max(stuck, event_id) THEN 'pending' ELSE arg_max(event_type, event_id) END AS state, count(*) FILTER (stuck) AS requeued FROM s GROUP BY 1""")
def lif14_requeue_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LIF-02, LIF-14, STR-02: events in three parts, with a restart between them; records in flight for over an hour are put back by a timer."""
    e = fx.table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("number"), F.col("ts").alias("at"), F.col("event_type").alias("state"))
    source, out, checkpoint = (new_dir(spark, n) for n in ("events", "states", "checkpoint"))
    most = e.agg(F.coalesce(F.max("number"), F.lit(0))).first()[0]
    for low, high in ((-1, most // 3), (most // 3, most // 2), (most // 2, most)):
        e.where((F.col("number") > low) & (F.col("number") <= high)).write.mode("append").parquet(source)
        stream = spark.readStream.schema(e.schema).parquet(source)
        records.run(spark, records.states(stream, ("view", "error"), 3_600_000), out, checkpoint)
    return records.latest(spark, out)
