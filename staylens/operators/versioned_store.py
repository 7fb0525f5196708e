"""A vector store that is upserted without being rewritten (V-5, V-6): merge-on-read versions.

A store is a folder of Parquet tables and small manifests. A manifest is one version: the ordered list of its tables, each
either rows or deleted ids. An upsert writes its own rows and the next manifest; a delete writes ids. Reading a version takes the rows of
all its tables except those whose id a later table holds: the later tables' ids, not their rows, meet the earlier rows,
broadcast while they are few and salted beyond (``join_group_stats``). ``compact`` writes a version of one table.

A manifest is written aside and moved to its numbered name, which fails if that version exists, so of two writers that started from one
version the second gets an error and may try again. Tables are never changed, so a reader keeps the version it opened
until ``vacuum`` removes tables that no kept version lists. Null ids match nothing and are only ever added.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from staylens.functions.semantics import join_group_stats

ROWS, DELETED = "rows", "deleted"


class VersionConflict(RuntimeError):
    """Another writer published this version first."""


class VersionedStore:
    def __init__(self, spark: SparkSession, path: str, id_col: str = "id"):
        self.spark, self.path, self.id_col = spark, path, id_col
        self._paths = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._paths(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        folder = self._paths(f"{self.path}/manifests")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def exists(self) -> bool:
        """V-6: whether a version was ever published."""
        return bool(self.versions())

    def manifest(self, version: int | None = None) -> dict:
        known = self.versions()
        if not known:
            return {"version": 0, "tables": []}
        version = known[-1] if version is None else version
        text = self.spark.read.text(f"{self.path}/manifests/{version:012d}.json", wholetext=True).first()[0]
        return json.loads(text)

    def _publish(self, version: int, tables: list[dict]) -> int:
        aside = self._paths(f"{self.path}/manifests/.{uuid.uuid4().hex}")
        stream = self._fs.create(aside, False)
        stream.write(bytearray(json.dumps({"version": version, "tables": tables}).encode()))
        stream.close()
        final = self._paths(f"{self.path}/manifests/{version:012d}.json")
        if self._fs.exists(final) or not self._fs.rename(aside, final):
            self._fs.delete(aside, False)
            raise VersionConflict(f"version {version} of {self.path} was published by another writer")
        return version

    def _write(self, df: DataFrame, kind: str) -> dict:
        name = f"{kind}-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{name}")
        return {"name": name, "kind": kind}

    def _table(self, entry: dict) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{entry['name']}")

    def upsert(self, new: DataFrame, order_col: str | None = None, base: int | None = None) -> int:
        """V-5: publish a version in which ``new`` replaces rows of the same id. Of several new rows with an id the one with
        the greatest ``order_col`` stays (equal or no order: the greatest row). Only the new rows are written. ``base`` is the version
        that the caller started from (the last one by default)."""
        at = self.manifest(base)
        row = F.struct(*[F.col(f"`{c}`") for c in new.columns])
        order = F.struct(F.col(order_col), row) if order_col else row
        named = new.where(F.col(self.id_col).isNotNull()).groupBy(F.col(self.id_col).alias("_id")).agg(F.max_by(row, order).alias("_r")).select(
            *[F.col(f"_r.`{c}`").alias(c) for c in new.columns])
        last = named.unionByName(new.where(F.col(self.id_col).isNull()))
        return self._publish(at["version"] + 1, [*at["tables"], self._write(last, ROWS)])

    def delete(self, ids: DataFrame, base: int | None = None) -> int:
        at = self.manifest(base)
        gone = ids.select(F.col(self.id_col)).where(F.col(self.id_col).isNotNull()).distinct()
        return self._publish(at["version"] + 1, [*at["tables"], self._write(gone, DELETED)])

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version (the last one by default)."""
        tables = self.manifest(version)["tables"]
        rows = [(k, self._table(t)) for k, t in enumerate(tables) if t["kind"] == ROWS]
        if not rows:
            raise ValueError(f"{self.path} holds no rows")
        later = [self._table(t).select(F.col(self.id_col).alias("_id"), F.lit(k).alias("_k")) for k, t in enumerate(tables) if k]
        every = None
        for k, df in rows:
            part = df.withColumn("_of", F.lit(k))
            every = part if every is None else every.unionByName(part, allowMissingColumns=True)
        if not later:
            return every.drop("_of")
        ids = later[0]
        for df in later[1:]:
            ids = ids.unionByName(df)
        newest = ids.where(F.col("_id").isNotNull()).groupBy("_id").agg(F.max("_k").alias("_k"))
        met = join_group_stats(every.withColumn("_id", F.col(self.id_col)), newest, ["_id"], "left")
        return met.where(F.col("_k").isNull() | (F.col("_k") <= F.col("_of"))).drop("_id", "_k", "_of")

    def count(self, version: int | None = None) -> int:
        return self.read(version).count()

    def compact(self) -> int:
        """Publish a version of one table with the rows of the last."""
        at = self.manifest()
        return self._publish(at["version"] + 1, [self._write(self.read(at["version"]), ROWS)])

    def vacuum(self, keep: int = 1) -> list[str]:
        """Remove the manifests before the last ``keep`` versions and the tables that only these list."""
        known = self.versions()
        kept = known[-keep:]
        listed = {t["name"] for v in kept for t in self.manifest(v)["tables"]}
        dropped = {t["name"] for v in known[:-keep] for t in self.manifest(v)["tables"]} - listed
        for v in known[:-keep]:
            self._fs.delete(self._paths(f"{self.path}/manifests/{v:012d}.json"), False)
        for name in dropped:
            self._fs.delete(self._paths(f"{self.path}/{name}"), True)
        return sorted(dropped)
