"""Object store over Hadoop paths: tenant-prefixed keys under one root."""

from __future__ import annotations

import posixpath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def safe_key(key: str) -> str:
    """The key, normalised; ValueError where it would leave the root."""
    path = posixpath.normpath(key)
    if path.startswith(("/", "..")) or path == ".":
        raise ValueError(f"key leaves the store: {key}")
    return path


class ObjectStore:
    """put / get / delete / exists on ``root``, any file system that Spark knows.

    ``options`` are the file system's own, for this store alone: what is put with
    ``fs.s3a.encryption.algorithm`` = ``AES256`` is encrypted by the server.
    """

    def __init__(self, spark: SparkSession, root: str, options: dict[str, str] | None = None):
        self.spark, self.root = spark, root.rstrip("/")
        self.conf = spark._jvm.org.apache.hadoop.conf.Configuration(spark._jsc.hadoopConfiguration())
        for k, v in (options or {}).items():
            self.conf.set(k, v)
        top = spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/")
        # A file system of its own where it has options: Hadoop's cache goes by address alone.
        self.fs = spark._jvm.org.apache.hadoop.fs.FileSystem.newInstance(top.toUri(), self.conf) if options else top.getFileSystem(self.conf)

    def _path(self, key: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{safe_key(key)}"), self.fs

    def put(self, key: str, data: bytes) -> None:
        path, fs = self._path(key)
        out = fs.create(path, True)
        try:
            out.write(bytearray(data))
        finally:
            out.close()

    def exists(self, key: str) -> bool:
        path, fs = self._path(key)
        return fs.exists(path)

    def delete(self, key: str) -> None:
        """Deleting what is not there is no error."""
        path, fs = self._path(key)
        fs.delete(path, False)

    def get(self, key: str) -> bytes:
        if not self.exists(key):
            raise LookupError("NOT_FOUND")
        return bytes(self.scan(key).first()["content"])

    def scan(self, pattern: str) -> DataFrame:
        """Objects under a key pattern as rows (path, length, content): a distributed read."""
        return self.spark.read.format("binaryFile").load(f"{self.root}/{pattern}")


def object_key(tenant: Column, document: Column, version: Column, filename: Column) -> Column:
    return F.concat_ws("/", F.lit("tenants"), tenant.cast("string"), F.lit("documents"), document.cast("string"), version.cast("string"), filename)


def cache_key(prefix: str, tenant: Column, namespace: str, key: Column) -> Column:
    return F.concat_ws(":", F.lit(prefix), tenant.cast("string"), F.lit(namespace), key.cast("string"))


def checked_uploads(files: DataFrame, max_mb: int = 50) -> DataFrame:
    """Uploaded files (path, length, content) with sha256 and the reason of a rejection."""
    reason = (
        F.when(~F.lower("path").endswith(".pdf"), "type")
        .when(F.col("length") == 0, "empty")
        .when(F.col("length") > max_mb * 1024 * 1024, "too_big")
        .when(F.substring("content", 1, 4) != F.encode(F.lit("%PDF"), "UTF-8"), "magic")
    )
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"), reason.alias("rejected"))
