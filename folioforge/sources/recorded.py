"""Recorded listings of a wiki as a data source, in batch and as a stream.

A run of a connector lists each space by following ``next`` links from response to response. What it
got is kept as two Parquet tables below ``run=N``: ``responses`` (``space, cursor, payload``, the JSON
as it came) and ``listing`` (``space, cursor, next, n, newest``), a line for each response. The source
reads listings on the driver, which are small, and deals responses over partitions, some of a space
to each, so a large space is read by many tasks.

A space's listing counts once its chain ends, in a response without ``next``. The stream's offset is
the last run of each space up to which all listings are complete, so a run that broke off is neither
read nor skipped: it is read when it has been completed, and a restart goes on from its checkpoint. A
link to another origin than the listing's own is refused.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from urllib.parse import parse_qs, urlsplit

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "space string, source_id string, version long, url string, body string"
#: Responses that a task reads.
PER_TASK = 8
#: Bytes of a row group of responses: a task decodes whole groups, so these and not a file's size bound what it holds.
GROUP_BYTES = 4 << 20


class ForeignLink(ValueError):
    """A ``next`` link that leads to another origin."""


def next_cursor(link: str | None, base: str) -> int | None:
    """The cursor of a ``next`` link, null at the end of a listing."""
    if not link:
        return None
    at, own = urlsplit(link), urlsplit(base)
    if (at.scheme, at.netloc) not in (("", ""), (own.scheme, own.netloc)):
        raise ForeignLink(link)
    return int(parse_qs(at.query)["cursor"][0])


def record(rows: DataFrame, root: str, run: int, base: str = "https://wiki.invalid", per_response: int = 100) -> None:
    """Put ``space, source_id, version, url, body`` down as the listings of one run."""
    counts = rows.groupBy("space").agg(F.ceil(F.count(F.lit(1)) / per_response).alias("__n"))
    dealt = rows.join(counts, "space").withColumn("cursor", F.pmod(F.xxhash64("source_id"), "__n"))
    results = dealt.groupBy("space", "cursor").agg(F.collect_list(F.struct("source_id", "version", "url", "body")).alias("results"), F.count(F.lit(1)).alias("n"), F.max("version").alias("newest"))
    after = F.lead("cursor").over(Window.partitionBy("space").orderBy("cursor"))
    link = F.when(after.isNotNull(), F.concat(F.lit(f"{base}/rest?cursor="), after))
    results.select("space", "cursor", F.to_json(F.struct("results")).alias("payload")).repartitionByRange("space", "cursor").sortWithinPartitions("space", "cursor").write.option("parquet.block.size", GROUP_BYTES).parquet(f"{root}/run={run}/responses")
    results.select("space", "cursor", link.alias("next"), "n", "newest").write.mode("append").parquet(f"{root}/run={run}/listing")


def _folder(root: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(root if "://" in root else f"file://{root}")


def runs_of(root: str) -> list[int]:
    from pyarrow import fs

    files, path = _folder(root)
    found = files.get_file_info(fs.FileSelector(path, allow_not_found=True))
    return sorted(int(f.base_name[4:]) for f in found if f.base_name.startswith("run="))


def chains(root: str, run: int, base: str) -> dict[str, tuple[list[int], bool]]:
    """For each space of a run the cursors in the order of its links, and whether they come to an end."""
    import pyarrow.dataset as ds

    files, path = _folder(root)
    rows = ds.dataset(f"{path}/run={run}/listing", filesystem=files).to_table(columns=["space", "cursor", "next"]).to_pylist()
    after = {(r["space"], r["cursor"]): r["next"] for r in rows}
    out: dict[str, tuple[list[int], bool]] = {}
    for space in sorted({r["space"] for r in rows}):
        at, found = min(r["cursor"] for r in rows if r["space"] == space), []
        while at is not None and (space, at) in after and at not in found:
            found.append(at)
            at = next_cursor(after[space, at], base)
        out[space] = found, at is None
    return out


class _Responses(InputPartition):
    def __init__(self, run: int, space: str, cursors: list[int]):
        self.run, self.space, self.cursors = run, space, cursors


class _Reading:
    def __init__(self, options: dict[str, str]):
        self.root, self.base = options["path"], options.get("base", "https://wiki.invalid")

    def split(self, run: int, wanted: set[str] | None = None) -> list[_Responses]:
        found = chains(self.root, run, self.base)
        return [_Responses(run, s, c[i : i + PER_TASK]) for s, (c, whole) in found.items() if whole and (wanted is None or s in wanted) for i in range(0, len(c), PER_TASK)]

    def rows(self, part: _Responses) -> Iterator[tuple]:
        import pyarrow.dataset as ds

        files, path = _folder(self.root)
        wanted = (ds.field("space") == part.space) & ds.field("cursor").isin(part.cursors)
        for batch in ds.dataset(f"{path}/run={part.run}/responses", filesystem=files).to_batches(columns=["payload"], filter=wanted, batch_size=16, batch_readahead=1, fragment_readahead=1, use_threads=False):
            for payload in batch.column(0).to_pylist():
                for r in json.loads(payload)["results"]:
                    yield part.space, r["source_id"], r.get("version"), r.get("url"), r.get("body")


class RecordedReader(_Reading, DataSourceReader):
    """All complete listings of all runs."""

    def partitions(self) -> list[_Responses]:
        return [p for run in runs_of(self.root) for p in self.split(run)]

    def read(self, partition: _Responses) -> Iterator[tuple]:
        return self.rows(partition)


class RecordedStream(_Reading, DataSourceStreamReader):
    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        """The last run of each space before the first that is not complete."""
        done: dict[str, int] = {}
        broken: set[str] = set()
        for run in runs_of(self.root):
            for space, (_, whole) in chains(self.root, run, self.base).items():
                if not whole:
                    broken.add(space)
                elif space not in broken:
                    done[space] = run
        return done

    def partitions(self, start: dict, end: dict) -> list[_Responses]:
        runs = [r for r in runs_of(self.root) if any(start.get(s, -1) < r <= last for s, last in end.items())]
        return [p for r in runs for p in self.split(r, {s for s, last in end.items() if start.get(s, -1) < r <= last})]

    def read(self, partition: _Responses) -> Iterator[tuple]:
        return self.rows(partition)

    def commit(self, end: dict) -> None:
        """Nothing is kept outside the stream's checkpoint."""


class RecordedPages(DataSource):
    """``spark.read.format("recorded").option("path", root)``, or ``readStream``."""

    @classmethod
    def name(cls) -> str:
        return "recorded"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> RecordedReader:
        return RecordedReader(dict(self.options))

    def streamReader(self, schema: StructType) -> RecordedStream:  # noqa: N802
        return RecordedStream(dict(self.options))


def registered(spark: SparkSession) -> SparkSession:
    spark.dataSource.register(RecordedPages)
    return spark
