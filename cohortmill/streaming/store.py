"""A table dealt by key into parts whose number grows with the rows, written batch by batch.

Streams that look up the history of a few keys read the parts of these keys and nothing else. Parts follow linear
hashing: a key's part is its hash modulo the next power of two, or modulo the one before where that part does not stand yet. With
each ``part_rows`` more rows one part is split, so parts keep their size and a batch moves about as many rows as it brings. Parts in
more than ``max_files`` folders are written anew as one.

Every batch writes a folder of its own, and last a list of the folders that hold each part. A batch that failed finds the list of the
batch before and writes its own folder again. Old lists and folders stay until :meth:`KeyedStore.drop_old`.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

LISTED = "parts long, part long, folder string, rows long"


def part_of(key: str, parts: int) -> Column:
    """Part of a key among ``parts``, by linear hashing."""
    low = 1 << (max(parts, 1).bit_length() - 1)
    h = F.xxhash64(key)
    wide = F.pmod(h, F.lit(2 * low))
    return F.when(wide < parts, wide).otherwise(F.pmod(h, F.lit(low)))


def sources_of(old: int, new: int) -> set[int]:
    """Parts below ``old`` that lose keys when there are ``new`` parts."""
    found = set()
    for part in range(old, new):
        while part >= old:
            part -= 1 << (part.bit_length() - 1)
        found.add(part)
    return found


@dataclass(frozen=True)
class KeyedStore:
    """Rows of ``schema`` below ``path``, looked up by ``key``."""

    spark: SparkSession
    path: str
    schema: StructType
    key: str
    part_rows: int = 1_000_000
    max_files: int = 8

    def _list_path(self, version: int) -> str:
        return f"{self.path}/lists/{version}"

    def _folder(self, version: int, kind: str) -> str:
        return f"{self.path}/rows/{version}/{kind}"

    def listed(self, version: int) -> DataFrame:
        """Folders and rows of each part after a batch; nothing before the first one."""
        if version < 0:
            return self.spark.createDataFrame([], LISTED)
        return self.spark.read.schema(LISTED).parquet(self._list_path(version))

    def _size(self, version: int) -> tuple[int, int]:
        """Number of parts and rows after a batch."""
        row = self.listed(version).agg(F.max("parts"), F.sum("rows")).first()
        return row[0] or 1, row[1] or 0

    def _write(self, rows: DataFrame, folder: str, parts: int) -> DataFrame:
        """Write rows by part and list them."""
        named = rows.select(*self.schema.names, part_of(self.key, parts).alias("_part"))
        # adaptive execution deals a part with a hot key to several tasks
        named.hint("rebalance", "_part").write.mode("overwrite").partitionBy("_part").parquet(folder)
        written = StructType([*self.schema.fields]).add("_part", "long")
        counts = self.spark.read.schema(written).parquet(folder).groupBy("_part").agg(F.count(F.lit(1)).alias("rows"))
        return counts.select(F.lit(parts).cast("long").alias("parts"), F.col("_part").alias("part"), F.lit(folder).alias("folder"), "rows")

    def _read(self, listed: DataFrame) -> DataFrame:
        """Rows of the listed folders of parts."""
        found = listed.select("folder", "part").collect()
        if not found:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{r.folder}/_part={r.part}" for r in found))

    def commit(self, version: int, rows: DataFrame) -> None:
        """Add the rows of a batch; batches count from 0, and a repeated one replaces itself."""
        parts, size = self._size(version - 1)
        grown = max(parts, math.ceil((size + rows.count()) / self.part_rows))
        listed = self.listed(version - 1).unionByName(self._write(rows, self._folder(version, "new"), grown))
        crowded = listed.groupBy("part").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > self.max_files)
        # bounded by the parts that this batch splits or touches
        moved = sources_of(parts, grown) | {r.part for r in crowded.collect()}
        if moved:
            at = F.col("part").isin(*moved)
            again = self._write(self._read(listed.where(at)), self._folder(version, "moved"), grown)
            listed = listed.where(~at).unionByName(again)
        listed.withColumn("parts", F.lit(grown).cast("long")).coalesce(1).write.mode("overwrite").parquet(self._list_path(version))

    def touched(self, version: int, keys: DataFrame) -> DataFrame:
        """List of the folders that may hold any of the keys."""
        parts, _ = self._size(version)
        wanted = keys.select(part_of(self.key, parts).alias("part")).distinct()
        return self.listed(version).join(wanted, "part", "left_semi")

    def opened(self, version: int, keys: DataFrame) -> DataFrame:
        """All rows after a batch of the parts that may hold any of the keys."""
        return self._read(self.touched(version, keys))

    def read(self, version: int, keys: DataFrame | None = None) -> DataFrame:
        """All rows after a batch, or those of the given keys; only the parts of these keys are opened."""
        if keys is None:
            return self._read(self.listed(version))
        return self.opened(version, keys).join(keys.select(self.key).distinct(), self.key, "left_semi")

    def drop_old(self, version: int) -> int:
        """Delete row folders of earlier batches that no part uses any more; returns how many."""
        used = {r.folder for r in self.listed(version).select("folder").distinct().collect()}
        jvm = self.spark._jvm.org.apache.hadoop.fs
        dropped = 0
        for k in range(version):
            for kind in ("new", "moved"):
                folder = self._folder(k, kind)
                path = jvm.Path(folder)
                system = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
                if folder not in used and system.exists(path):
                    system.delete(path, True)
                    dropped += 1
        return dropped
