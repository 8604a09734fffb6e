"""Stateful streaming deduplication of exact copies, in DataFrame functions only.

Three steps, each a job over tables that survive a lost executor:

1. ``digest_log``: a stateless stream reads the documents and appends one small
   row each: identifier, SHA-256 of the normalised text, and a content locator
   (file and row in it).
2. ``dedup_state``: a stream over that log keeps keyed state, without expiry, in
   RocksDB on the executors' disks (changelog in the shared folder): per digest
   the identifier and locator to keep and the number of copies.  Map-side partial
   aggregation means a text with a billion copies sends one row per input task.
3. ``confirm_bytes``: for digests that were hit more than once the texts are read
   again by locator and grouped by (digest, whole text).  A digest with two texts
   is a collision; its documents are then classed by text, not by digest.

Defined results.  Null text counts as empty; empty texts are copies of one
another.  Of equal texts the largest identifier stays; rows that repeat that very
identifier are told apart by locator, so one row stays.  A null identifier loses to
any other.  An empty table gives an empty result.  Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillstone.llm.rows import free_names
from quillstone.sources.workspace import fresh_path, materialise, settings

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOG_SCHEMA = "doc_id bigint, file string, row bigint, loc bigint, digest string"
#: State on the executors' disks.  Without fallocate a small store takes what it holds; with it
#: each store of each partition sets megabytes aside.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def fold_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else; null becomes empty.

    ``lower`` does that, fast, to a text that is all ASCII; ``translate`` to others.
    """
    text = F.coalesce(text, F.lit(""))
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def sha256_hex(text: Column) -> Column:
    return F.sha2(text, 256)


def place(docs: DataFrame) -> tuple[Column, Column]:
    """File and row of a table read from files, also where a column is called _metadata."""
    hidden = docs.metadataColumn("_metadata")
    return hidden["file_path"], hidden["row_index"]


def two_columns(docs: DataFrame, id_col: str, text_col: str) -> StructType:
    return StructType([docs.schema[c] for c in dict.fromkeys((id_col, text_col))])


def located(docs: DataFrame, id_col: str) -> DataFrame:
    """``docs`` with file, row and a 64-bit hash of both; batch or stream over files."""
    file, row = place(docs)
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), "norm", file.alias("file"), row.alias("row"), F.xxhash64(file, row).alias("loc")
    )


def digest_log(spark: SparkSession, path: str, schema, id_col: str, text_col: str, digest: Callable[[Column], Column], out: str) -> None:
    """Stream the Parquet documents at ``path`` that it has not met yet into the log of digests at ``out``."""
    # A pattern, as the stream source takes a folder or a pattern but not one file's path.
    plain = re.sub(r"([\\{}\[\]*?])", r"\\\1", path.rstrip("/"))
    pattern = f"{plain[:-1]}[{plain[-1]}]"
    stream = spark.readStream.schema(schema).parquet(pattern).withColumn("norm", fold_ascii(F.col(text_col)))
    rows = located(stream, id_col).withColumn("digest", digest(F.col("norm"))).drop("norm")
    query = (
        rows.writeStream.format("parquet")
        .option("checkpointLocation", f"{out}-checkpoint")
        .trigger(availableNow=True)
        .start(out)
    )
    query.awaitTermination()


def dedup_state(spark: SparkSession, log_path: str, out: str) -> DataFrame:
    """Keyed state over the digest log: keep (id, file, row) and group_size per digest; its changes are kept at ``out``."""
    state = (
        spark.readStream.schema(LOG_SCHEMA)
        .parquet(log_path)
        .groupBy("digest")
        .agg(F.max(F.struct("doc_id", "file", "row")).alias("keep"), F.count("*").alias("group_size"))
    )
    spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in state.schema]).write.mode("overwrite").parquet(f"{out}/batch=-1")

    def publish(changed: DataFrame, batch: int) -> None:
        # Overwriting the batch's own folder makes a replay after a failure harmless.
        changed.write.mode("overwrite").parquet(f"{out}/batch={batch}")

    with settings(spark, STATE_STORE):
        query = (
            state.writeStream.outputMode("update")
            .option("checkpointLocation", f"{out}-checkpoint")
            .trigger(availableNow=True)
            .foreachBatch(publish)
            .start()
        )
        query.awaitTermination()
    changes = spark.read.schema(state.schema).parquet(out)
    # Both grow from batch to batch, so the latest row of a digest has the largest of each.
    return changes.groupBy("digest").agg(F.max("keep").alias("keep"), F.max("group_size").alias("group_size"))


def confirm_bytes(spark: SparkSession, docs: DataFrame, classed: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Whole texts of all hits, grouped: digest, norm, keep, group_size."""
    hits = classed.filter(F.col("group_size") > 1).select("loc", "file", "row", "digest")
    texts = located(docs.withColumn("norm", fold_ascii(F.col(text_col))), id_col)
    return (
        texts.join(hits, ["loc", "file", "row"])
        .groupBy("digest", "norm")
        .agg(F.max(F.struct("doc_id", "file", "row")).alias("keep"), F.count("*").alias("group_size"))
    )


#: The filter that spares most texts the shuffle has at most this many bits, whatever the input.
BLOOM = {
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0",
    "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "1t",
}


def dedup_exact(
    spark: SparkSession,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    digest: Callable[[Column], Column] = sha256_hex,
    state_dir: str | None = None,
) -> DataFrame:
    """One row per document of the Parquet table at ``path``:
    doc_id, keep_id, group_size, kept, digest, file, row.

    ``digest`` maps a normalised text to a string; a weak one costs time, not rightness.
    With a ``state_dir`` log and state stay there: a later call streams only files that came to
    ``path`` since, and holds them against all that earlier calls have met.
    """
    whole = spark.read.parquet(path)
    docs = spark.read.schema(two_columns(whole, id_col, text_col)).parquet(path)
    top = state_dir or fresh_path(spark, "dedup")
    log_path = f"{top}/log"
    digest_log(spark, path, docs.schema, id_col, text_col, digest, log_path)
    log = spark.read.schema(LOG_SCHEMA).parquet(log_path)
    state = dedup_state(spark, log_path, f"{top}/state")
    classed = materialise(log.join(state, "digest"), "dedup-classed")
    with settings(spark, BLOOM):
        texts = materialise(confirm_bytes(spark, docs, classed, id_col, text_col).select("digest", F.sha2("norm", 512).alias("text_512"), "keep", "group_size"), "dedup-bytes")
    collided = texts.groupBy("digest").agg(F.count("*").alias("n_texts")).filter("n_texts > 1").select("digest")
    if not collided.isEmpty():
        # Members of a digest that has several texts: classed by whole text instead.
        member = located(docs.withColumn("norm", fold_ascii(F.col(text_col))), id_col)
        member = member.withColumn("text_512", F.sha2("norm", 512)).withColumn("digest", digest(F.col("norm"))).drop("norm", "loc")
        by_text = member.join(collided, "digest").join(texts, ["digest", "text_512"])
        columns = ["doc_id", "file", "row", "digest", "keep", "group_size"]
        classed = classed.join(collided, "digest", "left_anti").select(*columns).unionByName(by_text.select(*columns))
    return classed.select(
        "doc_id",
        F.col("keep.doc_id").alias("keep_id"),
        "group_size",
        F.expr("doc_id <=> keep.doc_id AND file = keep.file AND row = keep.row").alias("kept"),
        "digest",
        "file",
        "row",
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` (any DataFrame, all its columns) without the rows whose text another row keeps."""
    spark = docs.sparkSession
    path = fresh_path(spark, "dedup-input")
    docs.write.parquet(path)
    dropped = dedup_exact(spark, path, id_col, text_col).filter(~F.col("kept"))
    file, row, at_file, at_row = free_names(docs, "file", "row", "at_file", "at_row")
    dropped = dropped.select(F.col("file").alias(file), F.col("row").alias(row))
    rows = spark.read.schema(docs.schema).parquet(path)
    own_file, own_row = place(rows)
    rows = rows.select("*", own_file.alias(at_file), own_row.alias(at_row))
    return rows.join(dropped, F.expr(f"`{at_file}` = `{file}` AND `{at_row}` = `{row}`"), "left_anti").drop(at_file, at_row)
