"""A table of one row per key that batches are merged into, with snapshots.

Rows lie in buckets by a hash of their key. A merge reads the live version of the buckets that a batch touches, keeps the
first row of every key in a given order, writes new versions of those buckets beside the old ones, and then commits a list of
all live versions by renaming one small file into place. Until then readers see the commit before; afterwards the new one.
A batch that is already committed is left out, and one that stopped half-way is done again from the same
versions, so a restart at any step changes nothing. Readers open the listed versions only: what a read costs depends
on the rows, not on the number of batches. `vacuum` removes versions that no recent commit lists.

A bucket of more than TASK_ROWS rows is written by several tasks, each a file of its own, so the number of buckets, fixed when
the table is made, does not bound how large it may grow. A key that a batch repeats any number of times costs one row per task,
as only the first in order is kept before the shuffle.
"""

from __future__ import annotations

import json
import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 64
#: Rows that a task writes; a larger bucket is written by more tasks.
TASK_ROWS = 250_000


class KeyedTable:
    """root: the table's folder; keys: columns of a row's key; order: which row of a key stays (the first)."""

    def __init__(
        self, spark: SparkSession, root: str, schema: T.StructType, keys: list[str], order: list[Column], buckets: int = BUCKETS
    ):
        self.spark, self.root, self.schema, self.keys, self.order = spark, root.rstrip("/"), schema, keys, order
        self.buckets = buckets
        self._jvm = spark._jvm.org.apache.hadoop.fs

    # ---- commits

    def _path(self, name: str):
        path = self._jvm.Path(f"{self.root}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _commits(self) -> list[int]:
        path, fs = self._path("commits")
        names = [f.getPath().getName() for f in fs.listStatus(path)] if fs.exists(path) else []
        return sorted(int(n) for n in names if n.isdigit())

    def live(self, batch: int | None = None) -> dict[str, str]:
        """Bucket to folder, as of a commit (the last one by default)."""
        commits = self._commits()
        if batch is None and not commits:
            return {}
        path, _ = self._path(f"commits/{commits[-1] if batch is None else batch:020d}")
        # One line of at most `buckets` short names.
        state = json.loads(self.spark.read.text(path.toString()).first()[0])
        if state["buckets"] != self.buckets:
            raise ValueError(f"the table has {state['buckets']} buckets, not {self.buckets}")
        return state["live"]

    def _commit(self, batch: int, live: dict[str, str]) -> None:
        draft, fs = self._path(f"drafts/{uuid.uuid4().hex}")
        out = fs.create(draft)
        out.write(bytearray(json.dumps({"buckets": self.buckets, "live": live}).encode()))
        out.close()
        final, _ = self._path(f"commits/{batch:020d}")
        fs.mkdirs(final.getParent())
        if not fs.rename(draft, final):
            raise RuntimeError(f"batch {batch} is committed already")

    # ---- rows

    def _hash(self) -> Column:
        return F.xxhash64(*(F.col(f"`{k}`") for k in self.keys))

    def _bucketed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("_bucket", F.pmod(self._hash(), F.lit(self.buckets)).cast("int"))

    def _spread(self, rows: DataFrame, touched: list[int], most: int) -> DataFrame:
        """Each touched bucket in partitions of its own, of about TASK_ROWS rows; most: rows there can be in all."""
        parts = max(1, math.ceil(most / len(touched) / TASK_ROWS))
        # The upper half of the hash: the bucket has used the remainder.
        part = F.pmod(F.shiftright(self._hash(), 32), F.lit(parts))
        place = F.array_position(F.array(*(F.lit(b) for b in touched)), F.col("_bucket")) - 1
        return rows.repartitionById(len(touched) * parts, (place * parts + part).cast("int"))

    def _read(self, live: dict[str, str]) -> DataFrame:
        if not live:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.root}/data/{folder}" for folder in sorted(live.values())))

    def read(self, batch: int | None = None) -> DataFrame:
        """One snapshot; batch: as of that commit."""
        return self._read(self.live(batch))

    def merge(self, rows: DataFrame, batch: int) -> None:
        """Merges a batch; rows have the table's columns."""
        commits = self._commits()
        if commits and batch <= commits[-1]:
            return
        live = self.live()
        names = [f"`{f.name}`" for f in self.schema.fields]
        rows = self._bucketed(rows.select(*names))
        counted = {str(r[0]): r[1] for r in rows.groupBy("_bucket").count().collect()}
        touched = counted.keys()
        if not touched:
            self._commit(batch, live)
            return
        old = self._read({b: live[b] for b in touched if b in live})
        most = old.count() + sum(counted.values())
        old = self._bucketed(old)
        first = W.partitionBy(*(F.col(f"`{k}`") for k in self.keys)).orderBy(*self.order)
        kept = old.unionByName(rows).withColumn("_row", F.row_number().over(first)).filter("_row <= 1").drop("_row")
        folder = f"{batch:020d}-{uuid.uuid4().hex[:8]}"
        self._spread(kept, sorted(int(b) for b in touched), most).write.partitionBy("_bucket").parquet(f"{self.root}/data/{folder}")
        self._commit(batch, live | {b: f"{folder}/_bucket={b}" for b in touched})

    def vacuum(self, keep: int = 2) -> int:
        """Removes all but the last `keep` commits and every version that none of those lists; how many versions went."""
        commits = self._commits()
        wanted = {folder for c in commits[-keep:] for folder in self.live(c).values()}
        data, fs = self._path("data")
        gone = 0
        for batch in fs.listStatus(data) if fs.exists(data) else []:
            for bucket in fs.listStatus(batch.getPath()):
                name = f"{batch.getPath().getName()}/{bucket.getPath().getName()}"
                if bucket.isDirectory() and name not in wanted:
                    fs.delete(bucket.getPath(), True)
                    gone += 1
        for c in commits[:-keep]:
            path, _ = self._path(f"commits/{c:020d}")
            fs.delete(path, False)
        return gone
