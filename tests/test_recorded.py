"""What a task of the recorded source holds is bounded by row groups."""

import random

import pyarrow.dataset as ds
from pyspark.sql import functions as F

from folioforge.sources import recorded


def test_responses_are_written_in_small_row_groups(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(recorded, "GROUP_BYTES", 1 << 18)
    rng = random.Random(3)
    rows = [("s", str(i), i, "u", "".join(rng.choices("abcdefghijklmnop", k=2000))) for i in range(3000)]
    recorded.record(spark.createDataFrame(rows, recorded.SCHEMA).coalesce(1), f"file://{tmp_path}/r", 1, per_response=2)
    sizes = [g.total_byte_size for f in ds.dataset(f"{tmp_path}/r/run=1/responses").get_fragments() for g in f.row_groups]
    assert len(sizes) >= 6 and max(sizes) < 2_000_000
    read = recorded.registered(spark).read.format("recorded").option("path", f"file://{tmp_path}/r").load()
    assert read.agg(F.count(F.lit(1)), F.countDistinct("source_id"), F.sum(F.length("body"))).first()[:] == (3000, 3000, 6_000_000)
