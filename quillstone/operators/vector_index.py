"""A vector index of coarse cells: k-means cells over a bounded sample, every vector in one.

The layout is a manifest table partitioned by (tenant, cell): a search reads its tenant's
cells that the queries probe, other files are not opened.  Probing all cells is the exact search.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.operators.retrieval import QUERY_BLOCK, VECTOR_BLOCK, nearest
from quillstone.sources.manifest import ManifestTable

#: Vectors that the cells are fitted on, at most: the first by a hash of their ids.
SAMPLE = 20_000
#: Cells, at most; about the root of the number of vectors.
MAX_CELLS = 4096
ROUNDS = 12
#: Fields that payload filters name; kept beside the vector.
PAYLOAD = ("document_id", "version_id", "contract_type", "section", "clause", "chunk_type", "page")


def units(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def fit_cells(vectors: DataFrame) -> np.ndarray:
    """Centres of spherical k-means over a bounded sample of (id, vector)."""
    n = vectors.count()
    rows = vectors.filter("vector IS NOT NULL").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()
    x = units(np.array([r["vector"] for r in rows], dtype=np.float64))
    rng = np.random.default_rng(0)
    k = max(1, min(MAX_CELLS, len(x), round(math.sqrt(n))))
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(ROUNDS):
        own = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        empty = np.linalg.norm(sums, axis=1) == 0
        centres = np.where(empty[:, None], centres, units(sums))
    return centres


def nearest_cells(vectors: DataFrame, centres: np.ndarray, n: int) -> DataFrame:
    """vectors with place and cell: one row for each of the ``n`` nearest cells, the nearest at place 0."""
    shared = vectors.sparkSession.sparkContext.broadcast(centres)  # MAX_CELLS rows at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column("vector").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            s = flat.reshape(len(batch), -1) @ shared.value.T
            cells = np.argsort(-s, axis=1, kind="stable")[:, :n].astype(np.int32)
            yield batch.append_column("cells", pa.ListArray.from_arrays(np.arange(0, cells.size + 1, cells.shape[1], dtype=np.int32), cells.ravel()))

    known = vectors.filter("vector IS NOT NULL")
    found = known.mapInArrow(run, ", ".join(f"{c} {t}" for c, t in [*known.dtypes, ("cells", "array<int>")]))
    return found.select(*vectors.columns, F.posexplode("cells").alias("place", "cell"))


class VectorIndex:
    """Vectors (tenant, id, vector and payload fields) by tenant and cell."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.table = ManifestTable(spark, path, ["tenant", "cell"])
        self.centres: np.ndarray | None = None

    def ensure(self, vectors: DataFrame) -> VectorIndex:
        """Build the index unless it is there: calling it again changes nothing."""
        if self.table.version():
            rows = self.spark.read.parquet(f"{self.table.path}/centres").orderBy("cell").collect()
            self.centres = np.array([r["centre"] for r in rows])
            return self
        self.centres = fit_cells(vectors)
        rows = [(i, c.tolist()) for i, c in enumerate(self.centres)]
        self.spark.createDataFrame(rows, "cell int, centre array<double>").write.mode("overwrite").parquet(f"{self.table.path}/centres")
        kept = ["tenant", "id", "vector", *[c for c in PAYLOAD if c in vectors.columns]]
        self.table.replace(nearest_cells(vectors.select(*kept), self.centres, 1).drop("place"))
        return self

    def search(self, queries: DataFrame, k: int, tenant=None, probes: int | None = None, same_ids: bool = True) -> DataFrame:
        """query, id, similarity (9 decimals), rank of queries (id, vector): the k best in the ``probes``
        nearest cells of each, of one tenant or of all; without ``probes`` in all cells, which is exact."""
        asked = nearest_cells(queries.select("id", "vector"), self.centres, probes or len(self.centres))
        wanted = {r["cell"] for r in asked.select("cell").distinct().collect()}  # MAX_CELLS at most
        parts = [json.loads(key) for key in self.table.manifest()["parts"]]
        only = {json.dumps(p) for p in parts if p[1] in wanted and (tenant is None or p[0] == tenant)}
        own = self.table.read(only=only)
        pairs = packed(own, VECTOR_BLOCK, "own").join(packed(asked, QUERY_BLOCK, "asked"), "cell").select("asked", "own")
        return nearest(pairs, k, same_ids)

    def scanned(self, queries: DataFrame, probes: int) -> float:
        """The mean share of the vectors that a query's probed cells hold."""
        sizes = self.table.read().groupBy("cell").agg(F.count("*").alias("n"))
        asked = nearest_cells(queries.select("id", "vector"), self.centres, probes).join(sizes, "cell").groupBy("id").agg(F.sum("n").alias("n"))
        return asked.agg(F.avg("n")).first()[0] / self.table.read().count()

    def probes_for(self, queries: DataFrame, k: int, recall: float) -> int:
        """The least number of probes that finds that share of a stated query set's true neighbours.

        One exact search tells at which place of a query's cells each neighbour's cell stands.
        """
        true = self.search(queries, k).select("query", "id")
        homes = self.table.read().select("id", "cell")
        places = nearest_cells(queries.select(F.col("id").alias("query"), "vector"), self.centres, len(self.centres)).select("query", "cell", "place")
        counted = true.join(homes, "id").join(places, ["query", "cell"]).groupBy("place").agg(F.count("*").alias("n")).orderBy("place").collect()  # MAX_CELLS at most
        total, so_far = sum(r["n"] for r in counted), 0
        for r in counted:
            so_far += r["n"]
            if so_far >= recall * total:
                return r["place"] + 1
        return len(self.centres)


def packed(rows: DataFrame, size: int, name: str) -> DataFrame:
    """Rows (cell, id, vector) in blocks of about ``size`` within their cell: (cell, array)."""
    sizes = rows.groupBy("cell").agg(F.ceil(F.count("*") / size).alias("blocks"))
    dealt = rows.join(F.broadcast(sizes), "cell")  # MAX_CELLS rows at most
    blocks = dealt.groupBy("cell", F.pmod(F.xxhash64("id"), "blocks").alias("block"))
    return blocks.agg(F.collect_list(F.struct("id", "vector")).alias(name)).select("cell", name)
