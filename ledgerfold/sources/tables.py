"""Versioned Parquet tables with one manifest: many tables committed at once, with the
log positions that they cover.

A table lies in buckets, each a folder of one version. A commit writes new versions of the
buckets it touches and then publishes the next manifest, a record that only one writer can
create (records.py). Readers take the highest manifest first and so see one version of all
tables. The manifest holds the epoch that owns each shard; a writer of another one is refused.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .records import Records


class OwnershipLost(Exception):
    """Another epoch owns the tables, or a shard of theirs."""


class Tables:
    """buckets: into how many a bucketed table is dealt; a commit rewrites those it touches.
    history: whether the tables take event batches, too."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 16, history: bool = True):
        self.spark, self.folder, self.buckets, self.history = spark, folder.rstrip("/"), buckets, history
        self._records = Records(spark, f"{self.folder}/manifests")

    def manifest(self) -> dict:
        at = self._records.last()
        return self._records.read(at) if at else {"version": 0, "epochs": {}, "applied": {}, "tables": {}, "schemas": {}}

    def owner(self, shard: int | None = None, held: dict | None = None) -> int:
        """The epoch that owns a shard: its own, or that of all shards if higher."""
        epochs = (held or self.manifest())["epochs"]
        return max(epochs.get("all", 0), epochs.get(str(shard), 0))

    def fence(self, epoch: int, shard: int | None = None) -> None:
        """Claims a shard, or all; an equal epoch again does nothing, a lower one is refused."""
        if epoch < 1:
            raise ValueError("epoch 0 owns nothing")
        name = "all" if shard is None else str(shard)
        while True:
            held = self.manifest()
            owner = max([0, *held["epochs"].values()]) if shard is None else self.owner(shard, held)
            if owner > epoch:
                raise OwnershipLost(f"fenced at epoch {owner}, cannot fence at {epoch}")
            if held["epochs"].get(name, 0) == epoch or self._publish(held, epochs=held["epochs"] | {name: epoch}):
                return

    def _publish(self, held: dict, **new) -> bool:
        version = held["version"] + 1
        return self._records.publish(version, held | new | {"version": version})

    def bucket(self, *columns: str) -> Column:
        return F.pmod(F.xxhash64(*columns), F.lit(self.buckets)).cast("int")

    def read(self, name: str, buckets: list[int] | None = None, held: dict | None = None) -> DataFrame | None:
        """A table without its bucket column, or some of its buckets; None if there is none."""
        held = held or self.manifest()
        if name not in held["tables"]:
            return None
        schema = StructType.fromJson(held["schemas"][name])
        paths = [path for b, path in held["tables"][name].items() if buckets is None or b == "all" or int(b) in buckets]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.folder}/{p}" for p in paths))

    def commit(self, epoch: int, tables: dict, applied: dict[str, int], batch: int, held: dict | None = None) -> bool:
        """Writes tables and moves positions. A table is a DataFrame, which replaces all of
        it, or (DataFrame with a column `bucket`, the buckets that it replaces). held: the
        manifest that the tables were made from. False if `batch` (or a later one) is
        committed already, so a batch may safely be tried again."""
        held = held or self.manifest()
        for shard in applied or [None]:
            if self.owner(shard, held) != epoch:
                raise OwnershipLost(f"fenced at epoch {self.owner(shard, held)}, cannot commit at {epoch}")
        if held.get("batch", -1) >= batch:
            return False
        version, names, schemas = f"v={held['version'] + 1}-{uuid.uuid4().hex[:8]}", dict(held["tables"]), dict(held["schemas"])
        fs = self._records._fs
        for name, made in tables.items():
            folder = f"{name}/{version}"
            schemas[name] = (made if isinstance(made, DataFrame) else made[0].drop("bucket")).schema.jsonValue()
            if isinstance(made, DataFrame):
                made.write.parquet(f"{self.folder}/{folder}")
                names[name] = {"all": folder}
                continue
            df, touched = made
            df.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.folder}/{folder}")
            kept = {b: path for b, path in names.get(name, {}).items() if b != "all" and int(b) not in touched}
            there = [b for b in touched if fs.exists(self._records._path(f"{self.folder}/{folder}/bucket={b}"))]
            names[name] = kept | {str(b): f"{folder}/bucket={b}" for b in there}
        if not self._publish(held, batch=batch, applied=held["applied"] | applied, tables=names, schemas=schemas):
            raise OwnershipLost("the manifest moved during the commit")
        return True
