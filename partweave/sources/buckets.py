"""A Parquet table in hash buckets whose upserts rewrite only the buckets they touch.

Every bucket is a folder of Parquet files that is written once.  A version of the table is a small file that names the
folder of each bucket; an upsert writes new folders for the touched buckets and then creates the next version file.
That creation is the switch: a job that dies before it leaves the version before it in place, and of two jobs that start
from the same version one creates the file and the other gets an error.  A version file ends with a mark, so one that was
cut off is passed over.

The driver holds the version file: one entry a bucket, ``MAX_BUCKETS`` at most."""
from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_BUCKETS = 200_000
END = "\nend\n"


class VersionConflict(RuntimeError):
    """Another job has written the version that this one was about to write."""


class Folder:
    """The few file operations that Spark's writers do not offer, on whatever file system the path names."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.path = spark.sparkContext._jvm, path.rstrip("/")
        self.fs = self.jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, name: str) -> list[str]:
        if not self.fs.exists(self.at(name)):
            return []
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.at(name)))

    def create(self, name: str, text: str) -> bool:
        """Create a file that must not exist; False if it does."""
        self.fs.mkdirs(self.at(name).getParent())
        if self.fs.exists(self.at(name)):
            return False
        try:
            out = self.fs.create(self.at(name), False)
        except Exception as error:  # the other writer was between the two calls
            if "FileAlreadyExists" in str(error):
                return False
            raise
        out.write(bytearray(text.encode()))
        out.close()
        return True

    def text(self, name: str) -> str:
        size = self.fs.getFileStatus(self.at(name)).getLen()
        stream = self.fs.open(self.at(name))
        data = self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream, size)
        stream.close()
        return bytes(data).decode()


class BucketedTable:
    """``place`` gives the bucket of a row (int column); the default hashes ``key`` into ``buckets``.

    ``facts`` are aggregates kept for every bucket in the version file (numbers, texts or lists of them, bounded by the
    caller); they are computed over the buckets an upsert writes."""

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = 64, place: Column | None = None,
                 facts: dict[str, Column] | None = None):
        if buckets > MAX_BUCKETS:
            raise ValueError(f"more than {MAX_BUCKETS} buckets")
        self.spark, self.folder, self.key, self.facts = spark, Folder(spark, path), key, facts or {}
        self.place = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int") if place is None else place.cast("int")

    # ------------------------------------------------------------------------------------------------- versions
    def version(self) -> int:
        """The latest complete version; 0 if there is none."""
        for name in reversed(self.folder.names("versions")):
            if self.folder.text(f"versions/{name}").endswith(END):
                return int(name)
        return 0

    def state(self, version: int | None = None) -> dict:
        """{schema, meta, buckets: {bucket: {"folder": ..., "facts": ...}}} of a version (the latest by default)."""
        version = self.version() if version is None else version
        if version == 0:
            return {"version": 0, "schema": None, "meta": {}, "buckets": {}}
        text = self.folder.text(f"versions/{version:012d}")
        return json.loads(text.removesuffix(END)) | {"version": version}

    def commit(self, state: dict, base: int) -> int:
        taken = self.folder.names("versions")
        if self.version() != base:
            raise VersionConflict(f"version {base} is no longer the latest")
        number = int(taken[-1]) + 1 if taken else 1  # past a file that was cut off
        if not self.folder.create(f"versions/{number:012d}", json.dumps({k: v for k, v in state.items() if k != "version"}) + END):
            raise VersionConflict(f"version {number} exists")
        return number

    # ---------------------------------------------------------------------------------------------------- reading
    def read(self, version: int | None = None, only=None) -> DataFrame | None:
        """The table, or the buckets in ``only``; None before the first write."""
        return self._rows(self.state(version), only)

    def _rows(self, state: dict, only=None) -> DataFrame | None:
        if state["schema"] is None:
            return None
        schema = T.StructType.fromJson(state["schema"])
        wanted = [f"{self.folder.path}/{b['folder']}" for n, b in state["buckets"].items() if only is None or int(n) in only]
        if not wanted:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*wanted)

    # ---------------------------------------------------------------------------------------------------- writing
    def upsert(self, incoming: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame] | None = None,
               meta: dict | None = None, dealt: bool = False) -> int:
        """Write the rows of ``incoming`` over those with the same key and return the new version.

        ``merge(old, incoming)`` decides what the touched buckets hold afterwards; by default incoming rows replace old
        ones.  It sees whole touched buckets and must keep rows in their buckets.  Only touched buckets are read.  A column that is
        new is null in the rows before.  With ``dealt`` the rows of ``merge`` lie by bucket already and are not shuffled again."""
        state = self.state()
        mark = next(n for n in ("bucket", *(f"bucket_{i}" for i in range(99))) if n not in incoming.columns)
        touched = sorted(r[0] for r in incoming.select(self.place.alias(mark)).distinct().collect())
        old = self._rows(state, set(touched))
        if old is None:
            rows = incoming
        elif merge is not None:
            rows = merge(old, incoming)
        else:
            rows = old.join(incoming.select(self.key), self.key, "left_anti").unionByName(incoming, allowMissingColumns=True)
        name = f"data/{uuid.uuid4().hex}"
        # Rows of a bucket come from one shuffle of the touched rows, so a bucket is one file a task.
        rows = rows.withColumn(mark, self.place)
        (rows if dealt and old is not None and merge is not None else rows.repartition(mark)).write.partitionBy(mark).parquet(f"{self.folder.path}/{name}")
        written = [n.split("=")[1] for n in self.folder.names(name) if n.startswith(f"{mark}=")]
        buckets = {n: b for n, b in state["buckets"].items() if int(n) not in set(touched)}
        buckets |= {n: {"folder": f"{name}/{mark}={n}"} for n in written}
        new = {"schema": json.loads(rows.drop(mark).schema.json()), "meta": meta if meta is not None else state["meta"], "buckets": buckets}
        if self.facts and written:
            found = self._rows(new, {int(n) for n in written}).groupBy(self.place.alias(mark)).agg(
                *[c.alias(n) for n, c in self.facts.items()])
            for r in found.toLocalIterator():  # one row a written bucket
                buckets[str(r[mark])]["facts"] = {n: r[n] for n in self.facts}
        return self.commit(new, state["version"])

    def files(self) -> dict[int, list[str]]:
        """The files of each bucket in the latest version."""
        return {int(n): [f for f in self.folder.names(b["folder"]) if f.endswith(".parquet")]
                for n, b in self.state()["buckets"].items()}

    def vacuum(self, keep: int = 2) -> list[str]:
        """Remove the data folders that none of the last ``keep`` versions names; returns their names."""
        numbers = [int(n) for n in self.folder.names("versions")]
        whole = [n for n in numbers if self.folder.text(f"versions/{n:012d}").endswith(END)]
        used = {b["folder"] for n in whole[-keep:] for b in self.state(n)["buckets"].values()}
        gone = []
        for job in self.folder.names("data"):
            for part in self.folder.names(f"data/{job}"):
                name = f"data/{job}/{part}"
                if "=" in part and name not in used:
                    self.folder.fs.delete(self.folder.at(name), True)
                    gone.append(name)
        return gone
