"""A partitioned Parquet table whose state is one small file.

A write puts new files for the partitions it touches into a generation folder of its own, and
then a manifest that names, for every partition, the generation that holds it.  The manifest's number
is taken by a rename that fails where another writer was first, so a reader sees the
table before or after a write, never between, and a writer that died leaves nothing that is read.
The manifest lists partitions, not rows: it stays small, and only it passes through the driver.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Conflict(Exception):
    """Another writer took the manifest number."""


class ManifestTable:
    """Rows partitioned by the columns ``keys`` (integers or strings, never null)."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str]):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), keys
        self.root = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest")
        self.fs = self.root.getFileSystem(spark._jsc.hadoopConfiguration())

    # Manifests

    def version(self) -> int:
        """The number of the newest manifest, 0 where there is none."""
        if not self.fs.exists(self.root):
            return 0
        return max((int(f.getPath().getName()) for f in self.fs.listStatus(self.root) if f.getPath().getName().isdigit()), default=0)

    def manifest(self, version: int | None = None) -> dict:
        """schema (JSON) and parts: generation of every partition, by the JSON list of its key."""
        version = self.version() if version is None else version
        if not version:
            return {"schema": None, "parts": {}}
        stream = self.fs.open(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest/{version:012d}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def commit(self, seen: int, manifest: dict) -> int:
        """Put a manifest after the one that was ``seen``; ``Conflict`` if it is not the newest any more."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path
        self.fs.mkdirs(self.root)
        draft, final = path(f"{self.path}/manifest/.{uuid.uuid4().hex}"), path(f"{self.path}/manifest/{seen + 1:012d}")
        out = self.fs.create(draft, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(draft, final, options)
        except Exception as e:
            self.fs.delete(draft, False)
            if self.version() > seen:
                raise Conflict(f"manifest {seen + 1} is taken") from e
            raise
        return seen + 1

    # Reading

    def folder(self, generation: str, key: str) -> str:
        name = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName  # as Spark writes it
        return f"{self.path}/{generation}/" + "/".join(f"{k}={name(str(v))}" for k, v in zip(self.keys, json.loads(key), strict=True))

    def read(self, version: int | None = None, only: set[str] | None = None) -> DataFrame:
        """The table as one manifest has it; ``only`` keeps some partitions, others are not listed."""
        manifest = self.manifest(version)
        if manifest["schema"] is None:
            raise LookupError("the table has no rows yet")
        schema = StructType.fromJson(manifest["schema"])
        frames = []
        for generation in sorted(set(manifest["parts"].values())):
            folders = [self.folder(generation, key) for key, g in manifest["parts"].items() if g == generation and (only is None or key in only)]
            if folders:
                frames.append(self.spark.read.schema(schema).option("basePath", f"{self.path}/{generation}").parquet(*folders).select(*schema.names))
        if not frames:
            return self.spark.createDataFrame([], schema)
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f)
        return out

    def keys_of(self, rows: DataFrame) -> set[str]:
        """The partitions of rows: as many values as partitions, not as rows."""
        return {json.dumps(list(r)) for r in rows.select(*self.keys).distinct().collect()}

    # Writing

    def replace(self, rows: DataFrame, touched: set[str] | None = None, seen: int | None = None) -> int:
        """Put ``rows`` in place of the partitions ``touched`` (those of the rows, if none are named).

        A partition that is touched and gets no rows goes.  A partition of any size is written by
        many tasks: Spark splits large ones when it rebalances them.
        """
        seen = self.version() if seen is None else seen
        before = self.manifest(seen)
        generation = f"generation-{uuid.uuid4().hex}"
        rows.hint("rebalance", *[F.col(k) for k in self.keys]).write.partitionBy(*self.keys).parquet(f"{self.path}/{generation}")
        schema = rows.schema.jsonValue() if before["schema"] is None else before["schema"]
        written = self.spark.read.schema(StructType.fromJson(schema)).parquet(f"{self.path}/{generation}")
        new = dict.fromkeys(self.keys_of(written), generation)
        kept = {k: g for k, g in before["parts"].items() if k not in new and k not in (touched or ())}
        return self.commit(seen, {"schema": schema, "parts": kept | new})

    def upsert(self, new: DataFrame, version_col: str) -> int:
        """Rows of the versions that come take the place of those versions' rows: doing it twice changes nothing.

        The keys must follow from the version, so that a version's old rows are in the
        partitions of its new ones; only these are read and rewritten.
        """
        seen = self.version()
        touched = self.keys_of(new)
        if not seen:
            return self.replace(new, touched, seen)
        old = self.read(seen, touched)
        kept = old.join(new.select(F.col(version_col).alias("__gone")).distinct(), F.expr(f"{version_col} <=> __gone"), "left_anti")
        return self.replace(kept.unionByName(new.select(*old.columns)), touched, seen)

    def delete(self, gone: DataFrame, column: str) -> int:
        """Rows whose ``column`` is in ``gone`` (the same column and the keys) go; only its partitions are rewritten."""
        seen = self.version()
        touched = self.keys_of(gone) & set(self.manifest(seen)["parts"])
        if not touched:
            return seen
        kept = self.read(seen, touched).join(gone.select(F.col(column).alias("__gone")).distinct(), F.expr(f"{column} = __gone"), "left_anti")
        return self.replace(kept, touched, seen)

    def vacuum(self, keep: int = 2) -> None:
        """Remove generations that none of the last ``keep`` manifests names, and older manifests."""
        newest = self.version()
        used = {g for v in range(max(1, newest - keep + 1), newest + 1) for g in self.manifest(v)["parts"].values()}
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        for f in self.fs.listStatus(path(self.path)):
            name = f.getPath().getName()
            if name.startswith("generation-") and name not in used:
                self.fs.delete(f.getPath(), True)
        for v in range(1, newest - keep + 1):
            self.fs.delete(path(f"{self.path}/manifest/{v:012d}"), False)
