"""A store of vectors by what they were made of, bucketed so that only new rows are shuffled.

A row is an identity (a digest of the embedding's fingerprint and of the text that goes in) and its
vector. The table is bucketed and sorted by identity: looking up the identities of a new state of the
corpus sends those rows to the buckets and leaves the stored ones where they are, and so does adding
what was missing.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.operators.embedding import embedded
from folioforge.plans.scratch import written


@dataclass(frozen=True)
class VectorStore:
    spark: SparkSession
    #: Name in the session's catalog, folder of the files, and number of buckets, which stays.
    name: str
    path: str
    buckets: int = 64

    def table(self) -> DataFrame:
        """``identity, vector``."""
        return self.spark.table(self.name)

    def add(self, rows: DataFrame) -> None:
        """Append ``identity, vector`` whose identities aren't in the store yet."""
        dealt = rows.select("identity", "vector").repartition(self.buckets, "identity")
        dealt.write.bucketBy(self.buckets, "identity").sortBy("identity").format("parquet").option("path", self.path).mode("append").saveAsTable(self.name)

    def found(self, chunks: DataFrame) -> DataFrame:
        """``chunks`` (with ``identity``) and their ``vector``, null where the store has none."""
        return chunks.repartition(self.buckets, "identity").join(self.table().hint("merge"), "identity", "left")

    def embed_or_reuse(self, chunks: DataFrame, embed: Callable[[list[str]], np.ndarray]) -> DataFrame:
        """``chunk_id, vector, origin`` of ``chunk_id, identity, embed_text``: from the store, or else made, once per
        identity, and added to it. An input that can't be embedded stays without a vector."""
        looked = written(self.found(chunks), "looked-up")
        wanted = looked.where("vector is null").groupBy("identity").agg(F.first("embed_text").alias("embed_text"))
        new = written(embedded(wanted.withColumn("chunk_id", F.col("identity")), embed).select("identity", "vector").where("vector is not null"), "embedded")
        self.add(new)
        made = looked.where("vector is null").drop("vector").join(new, "identity", "left").withColumn("origin", F.lit("embedded"))
        kept = looked.where("vector is not null").withColumn("origin", F.lit("reused"))
        return kept.unionByName(made).select("chunk_id", "vector", "origin")


def create(spark: SparkSession, name: str, path: str, buckets: int = 64) -> VectorStore:
    """A store with no rows, at a folder that must be new."""
    store = VectorStore(spark, name, path, buckets)
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    store.add(spark.createDataFrame([], "identity string, vector array<float>"))
    return store
