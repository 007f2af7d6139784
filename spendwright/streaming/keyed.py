"""A table with one row per key that micro-batches update in place.

Rows are hashed by their key into a fixed number of buckets, each a folder of
Parquet files. A micro-batch rewrites only the buckets that it has keys of, so
its cost follows the batch and not the table. A manifest per version names the
version that holds each bucket; it is published by one rename once its files
are complete, so a reader or a restarted driver sees a version whole or not at
all. Both the manifest and the list of touched buckets are bounded by the
number of buckets, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendwright.sources.session import children, delete, move

VERSION, BUCKET = "_version", "_bucket"
BUCKETS = 64
_MANIFEST = "_bucket int, _version long, _buckets int"


class KeyedTable:
    """The table at ``path``; state lives in that folder only.

    Keys compare null-safe: the rows of a null key are one key. A micro-batch
    holds a key at most once. ``buckets`` is fixed by the first version; size
    it so that a bucket of the final table is a few hundred MB.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, keys: Sequence[str], buckets: int = BUCKETS):
        missing = [k for k in keys if k not in schema.names]
        if not keys or missing:
            raise ValueError(f"the table needs key columns of its schema, not {list(keys)}")
        if {VERSION, BUCKET} & set(schema.names):
            raise ValueError(f"{VERSION} and {BUCKET} are names of the table's folders")
        self.spark, self.path, self.schema, self.keys = spark, path.rstrip("/"), schema, list(keys)
        newest = self.manifest()
        self.buckets = newest[1] if newest else buckets

    # ------------------------------------------------------------ versions

    def versions(self) -> list[int]:
        """Published versions, oldest first."""
        names = children(self.spark, f"{self.path}/manifest")
        return sorted(int(n.partition("=")[2]) for n in names if n.startswith(f"{VERSION}="))

    def manifest(self, before: int | None = None) -> tuple[dict[int, int], int] | None:
        """The version of every bucket and the bucket count, of the newest version (below ``before``)."""
        published = [v for v in self.versions() if before is None or v < before]
        if not published:
            return None
        # The name of the version's folder is not read as a column.
        rows = self.spark.read.schema(_MANIFEST).json(f"{self.path}/manifest/{VERSION}={published[-1]}/*").collect()
        return {r[BUCKET]: r[VERSION] for r in rows}, rows[0]["_buckets"]

    def _publish(self, version: int, held: dict[int, int]) -> None:
        draft = f"{self.path}/draft/{VERSION}={version}"
        rows = [(b, v, self.buckets) for b, v in sorted(held.items())]
        self.spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.mode("overwrite").json(draft)
        delete(self.spark, f"{self.path}/manifest/{VERSION}={version}")
        if not move(self.spark, draft, f"{self.path}/manifest/{VERSION}={version}"):
            raise RuntimeError(f"version {version} of {self.path} could not be published")

    # ------------------------------------------------------------ rows

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _folders(self, held: dict[int, int]) -> list[str]:
        return [f"{self.path}/rows/{VERSION}={v}/{BUCKET}={b}" for b, v in sorted(held.items())]

    def _read(self, held: dict[int, int]) -> DataFrame:
        if not held:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*self._folders(held))

    def _write(self, rows: DataFrame, folder: str) -> None:
        """One folder per bucket; a bucket's rows in few files, a big bucket split."""
        rows = rows.withColumn(BUCKET, self._bucket()).hint("rebalance", BUCKET)
        rows.write.mode("overwrite").partitionBy(BUCKET).parquet(folder)

    def merge(self, batch: DataFrame, version: int) -> list[int]:
        """Replace or add the batch's keys as the given version; the buckets that were rewritten.

        A version that is merged again after a failure starts from the version
        before it and gives the same table. Files that neither this version
        nor the one before it holds are deleted.
        """
        incoming, target = f"{self.path}/incoming/{VERSION}={version}", f"{self.path}/rows/{VERSION}={version}"
        self._write(batch.select(*self.schema.names), incoming)
        touched = sorted(int(n.partition("=")[2]) for n in children(self.spark, incoming) if n.startswith(f"{BUCKET}="))
        if touched:
            earlier = self.manifest(before=version)
            held = earlier[0] if earlier else {}
            new = self.spark.read.schema(self.schema).parquet(*[f"{incoming}/{BUCKET}={b}" for b in touched])
            old = {b: v for b, v in held.items() if b in set(touched)}
            if old:
                keys = new.select(*[F.col(k).alias(f"_new_{k}") for k in self.keys])
                same = [F.col(k).eqNullSafe(F.col(f"_new_{k}")) for k in self.keys]
                rows = self._read(old).join(keys, reduce(Column.__and__, same), "left_anti").unionByName(new)
            else:
                rows = new
            self._write(rows, target)
            self._publish(version, held | dict.fromkeys(touched, version))
            self._forget()
        delete(self.spark, incoming)
        return touched

    def _forget(self) -> None:
        """Drop what the last two versions do not hold."""
        published = self.versions()
        kept = set()
        for version in published[-2:]:
            kept |= set(self.manifest(before=version + 1)[0].items())
        for version in published[:-2]:
            delete(self.spark, f"{self.path}/manifest/{VERSION}={version}")
        for folder in children(self.spark, f"{self.path}/rows"):
            version = int(folder.partition("=")[2])
            names = [n for n in children(self.spark, f"{self.path}/rows/{folder}") if n.startswith(f"{BUCKET}=")]
            gone = [n for n in names if (int(n.partition("=")[2]), version) not in kept]
            if len(gone) == len(names):
                delete(self.spark, f"{self.path}/rows/{folder}")
            else:
                for name in gone:
                    delete(self.spark, f"{self.path}/rows/{folder}/{name}")

    def absorb(self, stream: DataFrame, checkpoint: str) -> None:
        """Process all available input of an update-mode stream; continues after a restart with the same checkpoint."""

        def land(batch: DataFrame, batch_id: int) -> None:
            self.merge(batch, batch_id)

        writer = stream.writeStream.outputMode("update").foreachBatch(land).option("checkpointLocation", checkpoint)
        writer.trigger(availableNow=True).start().awaitTermination()

    def rows(self) -> DataFrame:
        """The newest version of the whole table."""
        newest = self.manifest()
        return self._read(newest[0] if newest else {})

    def lookup(self, ids: DataFrame) -> DataFrame:
        """One row per distinct key of ``ids``; keys without a row get nulls.

        Only the buckets of these keys are read.
        """
        wanted = ids.select(*[F.col(k).cast(self.schema[k].dataType).alias(k) for k in self.keys]).distinct()
        newest = self.manifest()
        held = newest[0] if newest else {}
        # At most one row per bucket reaches the driver.
        hit = {r[0] for r in wanted.select(self._bucket()).distinct().collect()}
        found = self._read({b: v for b, v in held.items() if b in hit})
        found = found.select(*[F.col(c).alias(f"_key_{c}" if c in self.keys else c) for c in self.schema.names])
        same = [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in self.keys]
        joined = wanted.join(found, reduce(Column.__and__, same), "left")
        return joined.select(*self.schema.names)
