"""Which keys of a batch are new, without reading the keys of all batches before.

Keys lie in hash buckets; every batch adds one file of keys to each bucket it touches, with a Bloom filter of that
file.  A lookup joins the batch with the filters of its buckets, opens only the files whose filter lets a key pass, and
settles those keys by an exact anti join.  A filter never misses a key, so the answer is exact; with 12 bits a key and
four bits set, about one new key in 400 makes a file be opened in vain.

Filters are words of 64 bits, built by ``bit_or`` and read by ``getbit``: plain column programs.  A bucket's lookups grow
with the number of its files; ``compact`` merges the files of the buckets that have more than ``most``."""
from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from .buckets import END, Folder, VersionConflict

BITS, MARKS = 12, 4
FILTERS = "segment string, bucket int, n long, words array<long>"


def _bit(key: Column, words: Column, i: int) -> Column:
    """The i-th bit of a key in a filter of so many words."""
    return F.pmod(F.xxhash64(key, F.lit(i)), words * 64)


class KeyIndex:
    def __init__(self, spark: SparkSession, path: str, key: str = "row_hash", buckets: int = 64):
        self.spark, self.folder, self.key, self.buckets = spark, Folder(spark, path), key, buckets
        self.opened: list[str] = []  # files that the last lookup opened

    # ---------------------------------------------------------------------------------------------------- versions
    def segments(self) -> list[dict]:
        """Segments of the latest complete version: {"segment", "folder"}; a batch is a segment."""
        for name in reversed(self.folder.names("versions")):
            text = self.folder.text(f"versions/{name}")
            if text.endswith(END):
                return json.loads(text.removesuffix(END))
        return []

    def _commit(self, segments: list[dict]) -> None:
        taken = self.folder.names("versions")
        number = int(taken[-1]) + 1 if taken else 1
        if not self.folder.create(f"versions/{number:012d}", json.dumps(segments) + END):
            raise VersionConflict(f"version {number} exists")

    # ----------------------------------------------------------------------------------------------------- writing
    def _placed(self, keys: DataFrame) -> DataFrame:
        return keys.select(F.col(self.key).alias("key")).filter("key is not null").distinct().withColumn(
            "bucket", F.pmod(F.xxhash64("key"), F.lit(self.buckets)).cast("int"))

    def _write(self, placed: DataFrame, segment: str) -> dict:
        folder = f"segments/{uuid.uuid4().hex}"
        path = f"{self.folder.path}/{folder}"
        placed.repartition("bucket").write.partitionBy("bucket").parquet(f"{path}/keys")
        held = self.spark.read.schema("key string, bucket int").parquet(f"{path}/keys")
        size = held.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).withColumn(
            "n_words", F.greatest(F.lit(1), F.ceil(F.col("n") * BITS / 64)).cast("int"))
        bits = held.join(F.broadcast(size), "bucket").select("bucket", "n", "n_words", F.explode(F.array(*[
            _bit(F.col("key"), F.col("n_words"), i) for i in range(MARKS)])).alias("bit"))  # one row a bucket is sent
        words = bits.groupBy("bucket", "n", "n_words", F.floor(F.col("bit") / 64).cast("int").alias("at")).agg(
            F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("word"))
        known = words.groupBy("bucket", "n", "n_words").agg(F.map_from_entries(F.collect_list(F.struct("at", "word"))).alias("known"))
        filters = known.select(F.lit(segment).alias("segment"), "bucket", "n", F.transform(
            F.sequence(F.lit(0), F.col("n_words") - 1), lambda i: F.coalesce(F.col("known")[i], F.lit(0).cast("long"))).alias("words"))
        filters.write.partitionBy("bucket").parquet(f"{path}/filters")
        return {"segment": segment, "folder": folder}

    def add(self, keys: DataFrame, segment: str) -> None:
        """Add the keys of a batch.  A batch that is written again replaces what it wrote before."""
        placed = cut_lineage(self._placed(keys))
        others = [s for s in self.segments() if s["segment"] != segment]
        self._commit(others + [self._write(placed, segment)])

    def compact(self, most: int = 8) -> int:
        """Merge all segments into one if there are more than ``most``; returns the number of segments.

        Batches that have been merged can no longer be replaced one by one."""
        now = self.segments()
        if len(now) > most:
            paths = [f"{self.folder.path}/{s['folder']}/keys" for s in now]
            parts = [self.spark.read.schema("key string, bucket int").parquet(p) for p in paths]
            every = parts[0]
            for p in parts[1:]:
                every = every.unionByName(p)
            self._commit([self._write(every, f"merged-{uuid.uuid4().hex}")])
        return len(self.segments())

    # ----------------------------------------------------------------------------------------------------- reading
    def filters(self, besides: str | None = None) -> DataFrame:
        rows = self.spark.createDataFrame([], FILTERS)
        for s in self.segments():
            if s["segment"] != besides:
                rows = rows.unionByName(self.spark.read.schema(FILTERS).parquet(f"{self.folder.path}/{s['folder']}/filters"))
        return rows

    def unseen(self, rows: DataFrame, besides: str | None = None) -> DataFrame:
        """``rows`` whose key no segment holds, but for the segment ``besides``; rows without a key count as unseen."""
        keys = cut_lineage(self._placed(rows))
        words = F.size("words")
        passed = None
        for i in range(MARKS):
            bit = _bit(F.col("key"), words, i)
            one = F.getbit(F.get("words", F.floor(bit / 64).cast("int")), F.pmod(bit, F.lit(64)).cast("int")) == 1
            passed = one if passed is None else passed & one
        suspects = keys.join(self.filters(besides), "bucket").filter(passed).select("key", "segment", "bucket")
        suspects = cut_lineage(suspects)
        folders = {s["segment"]: s["folder"] for s in self.segments()}
        hit = suspects.select("segment", "bucket").distinct().collect()  # at most segments times buckets
        self.opened = sorted(f"{self.folder.path}/{folders[r['segment']]}/keys/bucket={r['bucket']}" for r in hit)
        if not self.opened:
            return rows
        held = self.spark.read.schema("key string").parquet(*self.opened)
        seen = suspects.select("key").distinct().join(held, "key", "left_semi").select(F.col("key").alias(self.key))
        return rows.join(seen, self.key, "left_anti")
