"""Sentences by the ends of parts alone, against the rule on whole parts."""

import random

from pyspark.sql import functions as F

from folioforge.functions import text as X
from folioforge.plans import detail_queries


def test_the_end_of_a_part_tells_what_the_whole_part_tells(spark):
    rng = random.Random(5)
    bits = ["dr", "e.g", "approx", "x", ".", "..", "........", " ", "(", "word", "éa", "longerword", "\n", "9", "Ltd", "?", "!\"", ".”", " ", "\r\n"]
    parts = ["", ".", "a." * 30, "." * 30, *("".join(rng.choice(bits) for _ in range(rng.randrange(12))) + rng.choice([".", "!", ".)", ". ", "", ". ", ".\r\n", ".\"\n"]) for _ in range(20_000))]
    rows = spark.createDataFrame([(p,) for p in parts], "p string").repartition(4)
    told = rows.select("p", X.goes_on(F.col("p")).alias("got"), F.rlike("p", F.lit(X.GOES_ON)).alias("want"))
    counts = {r.want: (r.n, r.same) for r in told.groupBy("want").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("got") == F.col("want")).alias("same")).collect()}
    assert counts[True][0] > 1000 and counts[False][0] > 1000 and all(n == same for n, same in counts.values())


def test_a_text_is_cut_once(spark, tmp_path):
    texts = ["One. Two.", "", None, " \n\u0001 ", "\u0001", "x", "Dr. A is here. Yes."]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    query = detail_queries.QUERIES["chk02_sentences"](spark, str(tmp_path))
    assert {r.doc_id: r.n for r in query.collect()} == {0: 2, 5: 1, 6: 2}
    filters = [line for line in query._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Filter" in line]
    assert filters and not any("aggregate(" in line for line in filters)
