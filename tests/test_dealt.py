"""Work that grows with a small table is dealt over all cores."""

import pytest

from folioforge.plans import detail_queries, parser_queries


@pytest.mark.parametrize("name", ["prs09_mail", "prs13_members", "prs05_word", "prs14_statuses"])
def test_bodies_are_written_and_read_by_all_cores(spark, name):
    query = parser_queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert query.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_rows_made_for_suppliers_are_dealt(spark):
    made = detail_queries.QUERIES["chk10_breadcrumb"](spark, "/root/testdata/sf0.001")
    assert made.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_members_of_many_archives_leave_a_task_together(spark, monkeypatch):
    import io
    import zipfile

    import pandas as pd

    from folioforge.operators import parsing

    def archive(n):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for i in range(n):
                z.writestr(f"{i}.txt", "x" * 100)
        return out.getvalue()

    class Rows:
        """Stands for a table, and gives the function that a task runs."""

        schema = spark.createDataFrame([], "document_id long, content binary").schema

        def select(self, *names):
            return self

        def mapInPandas(self, run, schema):  # noqa: N802
            return run

    frames = [pd.DataFrame({"document_id": range(k, k + 50), "content": [archive(i % 4) if i % 5 else b"no" for i in range(k, k + 50)]}) for k in (0, 50)]
    want = [(i, f"{j}.txt", b"x" * 100, None) if i % 5 else (i, "", b"", "not an archive") for i in range(100) for j in range(i % 4 if i % 5 else 1)]
    made = list(parsing.expanded(Rows())(iter(frames)))
    assert len(made) == 1 and [tuple(r) for r in made[0].itertuples(index=False)] == want
    monkeypatch.setattr(parsing, "FRAME_BYTES", 1000)
    parts = list(parsing.expanded(Rows())(iter(frames)))
    assert len(parts) > 5 and [tuple(r) for f in parts for r in f.itertuples(index=False)] == want
