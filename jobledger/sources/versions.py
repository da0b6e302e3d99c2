"""Tables of which only touched partitions are rewritten, and of which readers see one whole version or another."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class VersionedTable:
    """A table under ``path``: a folder of data for each write, and a manifest for each version that says which folder holds each partition.

    A version is published by its manifest, the last thing that is written, and only if no other writer has taken its number. What a failed write leaves behind is read by nobody. Partitions are
    the values of ``by``; manifests list them, so there should be thousands of them, not millions.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, by: str) -> None:
        self.spark, self.path, self.schema, self.by = spark, path.rstrip("/"), schema, by

    def _fs(self, path: str):
        there = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return there.getFileSystem(self.spark._jsc.hadoopConfiguration()), there

    def _manifest(self, version: int) -> dict[str, str]:
        if version == 0:
            return {}
        return json.loads(self.spark.read.text(f"{self.path}/versions/{version:08d}.json", wholetext=True).first()[0])

    def version(self) -> int:
        """The newest published version, 0 before the first."""
        fs, there = self._fs(f"{self.path}/versions")
        if not fs.exists(there):
            return 0
        return max((int(s.getPath().getName()[:8]) for s in fs.listStatus(there) if s.getPath().getName().endswith(".json")), default=0)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version (default: the newest); later writes don't change them."""
        return self._rows(self._manifest(self.version() if version is None else version))

    def _rows(self, parts: dict[str, str]) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        paths = [f"{self.path}/data/_write={folder}/_part={name}" for name, folder in sorted(parts.items())]
        return self.spark.read.schema(self.schema).option("basePath", f"{self.path}/data").parquet(*paths).select(*[f.split()[0] for f in self.schema.split(", ")])

    def _name(self):
        """Of the partition: hexadecimal, so that any value makes a folder name; a null one is a partition of its own."""
        value = F.col(self.by).cast("string")
        return F.when(value.isNull(), "null").otherwise(F.concat(F.lit("x"), F.hex(F.encode(value, "utf-8"))))

    def upsert(self, rows: DataFrame, key: list[str], gone: DataFrame | None = None, touched: DataFrame | None = None) -> int:
        """Publish a version in which ``rows`` replace those of equal ``key`` and rows whose key is in ``gone`` are dropped. Its number.

        Only partitions that hold a new or dropped row are rewritten; ``touched(by)`` names others in which old rows of those keys stand, for rows that move from one to another.
        Keys are without nulls.
        """
        base = self.version()
        parts = self._manifest(base)
        named = [x.select(self._name().alias("n")) for x in (rows, gone, touched) if x is not None]
        union = named[0]
        for x in named[1:]:
            union = union.union(x)
        names = {r.n for r in union.distinct().collect()}  # a row for each touched partition
        if not names:
            return base
        old = self._rows({n: parts[n] for n in names if n in parts})
        kept = old.join(rows.select(*key), key, "left_anti")
        if gone is not None:
            kept = kept.join(gone.select(*key), key, "left_anti")
        return self.publish(kept.select(*rows.columns).unionByName(rows), names, base)

    def publish(self, rows: DataFrame, names: set[str], base: int) -> int:
        """Write the new rows of the partitions ``names``, then the manifest of version ``base`` + 1."""
        folder = uuid.uuid4().hex
        rows.withColumn("_part", self._name()).repartition("_part", F.pmod(F.xxhash64(*rows.columns), F.lit(8))).write.partitionBy("_part").parquet(f"{self.path}/data/_write={folder}")
        fs, data = self._fs(f"{self.path}/data/_write={folder}")
        written = {s.getPath().getName().removeprefix("_part=") for s in fs.listStatus(data) if s.isDirectory()}
        parts = {n: f for n, f in self._manifest(base).items() if n not in names} | {n: folder for n in written}
        self._announce(base + 1, parts)
        return base + 1

    def _announce(self, version: int, parts: dict[str, str]) -> None:
        fs, there = self._fs(f"{self.path}/versions/{version:08d}.json")
        fs.mkdirs(there.getParent())
        _, draft = self._fs(f"{self.path}/versions/.{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps(parts, sort_keys=True).encode()))
        out.close()
        if fs.exists(there) or not fs.rename(draft, there):
            raise RuntimeError(f"version {version} of {self.path} was published by another writer")
