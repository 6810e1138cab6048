"""Tables in versions, changed by key: only the buckets that a change touches are written again.

Below the root lie data/v=<number>/bucket=<b>, what a version wrote, and manifest/v=<number>, which says for each bucket the version that
holds it.  The manifest is written last, so readers see a version as a whole or not at all, and older versions stay readable.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.session import settle


class VersionedTable:
    """Rows of a schema below a folder that all executors see, dealt into buckets by a hash of key."""

    def __init__(self, spark: SparkSession, root: str, schema: str, key: str, buckets: int = 64):
        self.spark, self.root, self.schema, self.key, self.buckets = spark, root, schema, key, buckets

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _exists(self, path: str) -> bool:
        """Asked of the file system of the path, whichever that is."""
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def last(self) -> int:
        """The newest version, or -1 if there is none."""
        if not self._exists(f"{self.root}/manifest"):
            return -1
        newest = self.spark.read.schema("v int, bucket int, held int").parquet(f"{self.root}/manifest").agg(F.max("v")).first()[0]
        return -1 if newest is None else newest

    def manifest(self, version: int) -> dict[int, int]:
        """Bucket to the version that wrote it; there are no more entries than buckets."""
        if version < 0:
            return {}
        rows = self.spark.read.schema("v int, bucket int, held int").parquet(f"{self.root}/manifest").where(F.col("v") == version)
        return {r["bucket"]: r["held"] for r in rows.collect()}

    def read(self, version: int | None = None, only: list[int] | None = None) -> DataFrame:
        """The rows of a version, the newest if none is named; only those of some buckets if they are named."""
        held = defaultdict(list)
        for bucket, at in self.manifest(self.last() if version is None else version).items():
            if only is None or bucket in only:
                held[at].append(bucket)
        if not held:
            return self.spark.createDataFrame([], self.schema)
        parts = [self.spark.read.schema(f"{self.schema}, bucket int").parquet(f"{self.root}/data/v={at}").where(F.col("bucket").isin(*sorted(b))).drop("bucket") for at, b in sorted(held.items())]
        return reduce(DataFrame.unionByName, parts)

    def commit(self, changes: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame], number: int | None = None) -> int:
        """A new version with merge(rows of the touched buckets, changes) in place of those buckets; its number.

        changes has the key and whatever merge wants.  Without changes nothing is written and the newest version is returned.
        With a number given, the version is built on the newest one before it, so to commit that number twice gives the same rows.
        """
        base = self.last() if number is None else min(self.last(), number - 1)
        changes = settle(changes)
        touched = sorted(r["b"] for r in changes.select(self._bucket().alias("b")).distinct().collect())  # at most as many as buckets
        if not touched:
            return self.last()
        number = base + 1 if number is None else number
        rows = merge(self.read(base, touched), changes).withColumn("bucket", self._bucket())
        rows.repartition(min(len(touched), 1 + int(self.spark.conf.get("spark.sql.shuffle.partitions"))), "bucket").write.partitionBy("bucket").mode("overwrite").parquet(f"{self.root}/data/v={number}")
        self._publish(number, self.manifest(base) | dict.fromkeys(touched, number))
        return number

    def _publish(self, number: int, held: dict[int, int]) -> None:
        self.spark.createDataFrame(sorted(held.items()), "bucket int, held int").coalesce(1).write.mode("overwrite").parquet(f"{self.root}/manifest/v={number}")

    def compact(self) -> int:
        """The newest version written anew into one place, as one more version; its number."""
        newest = self.last()
        if newest < 0:
            return newest
        rows = self.read(newest).withColumn("bucket", self._bucket())
        rows.repartition("bucket").write.partitionBy("bucket").mode("overwrite").parquet(f"{self.root}/data/v={newest + 1}")
        self._publish(newest + 1, dict.fromkeys(self.manifest(newest), newest + 1))
        return newest + 1
