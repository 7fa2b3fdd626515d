"""Nearest neighbours over array columns: exact, and approximate by an inverted file.

One query is a top-k of distances, all within Catalyst. A table of queries is
asked in blocks of QUERY_BLOCK, whose size bounds what is broadcast: each block is
a matrix product over batches of rows, every batch keeps the best k a query, and
what is left is ranked by distances worked out anew in doubles.

The inverted file is stored: rows lie in a folder for each cell, as vectors and as
8-bit codes, so a search reads the folders of its cells only. It takes further
rows, deletes by key, filters, and is rewritten by ``vacuum``.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tessera.dialect import distance
from tessera.folders import shared
from tessera.shipping import ship

OPERATORS = {"l2": "<->", "cosine": "<=>", "dot": "<#>"}
#: Queries of one pass, which are broadcast (4 MB at 1,000 dimensions), and rows of a batch that meet them.
QUERY_BLOCK = 512
#: Deleted keys are broadcast up to so many.
BROADCAST_KEYS = 100_000


def doubles(column: str) -> Column:
    return F.transform(column, lambda x: x.cast("double"))


def measure(metric: str, a: str, b: str) -> Column:
    """Distance of two columns of double arrays. For the inner product smaller is farther: it is negated for ranking."""
    value = F.expr(distance(OPERATORS[metric], a, b))
    return -value if metric == "dot" else value


def nearest(df: DataFrame, query: list[float], k: int, vector: str = "embedding", key: str = "vec_id", metric: str = "l2", where: str | None = None) -> DataFrame:
    """The k rows nearest to one vector, ties by key; rows whose distance is null don't count."""
    df = df.where(where) if where else df
    of = df.select(key, doubles(vector).alias("v"), F.array(*[F.lit(float(x)) for x in query]).alias("q"))
    return of.select(key, measure(metric, "v", "q").alias("distance")).where("distance IS NOT NULL").orderBy("distance", key).limit(k)


def _best(rows: np.ndarray, asked: np.ndarray, k: int, metric: str) -> np.ndarray:
    """Whether a row may be among the k best of each query, by a matrix product: queries by rows. What lies
    within rounding of the k-th best is kept too."""
    dot = asked @ rows.T
    if metric == "l2":
        far = (asked**2).sum(1)[:, None] + (rows**2).sum(1)[None, :] - 2 * dot
    elif metric == "cosine":
        with np.errstate(invalid="ignore", divide="ignore"):
            far = -dot / (np.sqrt((asked**2).sum(1))[:, None] * np.sqrt((rows**2).sum(1))[None, :])
        far = np.where(np.isfinite(far), far, np.inf)
    else:
        far = -dot
    if k >= far.shape[1]:
        return np.ones(far.shape, bool)
    last = np.partition(far, k - 1, axis=1)[:, k - 1 : k]
    scale = np.abs(np.where(np.isfinite(far), far, 0)).max(initial=0) + (np.abs(dot).max(initial=0) if metric == "l2" else 0)
    return far <= last + 1e-9 * (scale + 1)


def _block(rows: DataFrame, block: list, k: int, key: str, query_key: str, kind: T.DataType, metric: str, cells: dict | None = None) -> DataFrame:
    """(query_key, key, distance) of each query of the block and the rows that may be its k best in their batch.
    cells: by cell, the places of the queries that look there; the rows have a column ``cell`` then."""
    spark = rows.sparkSession
    asked = np.array([q for _, q in block], float)
    held = spark.sparkContext.broadcast((asked, cells))

    def run(batches):
        asked, cells = held.value
        dims = asked.shape[1]
        for batch in batches:
            lists, keys = batch.column(1), batch.column(0)
            fit = np.flatnonzero(np.array([x is not None and len(x) == dims and None not in x for x in lists.to_pylist()]))
            if not len(fit):
                continue
            taken = lists.take(pa.array(fit))
            values = taken.flatten().to_numpy(zero_copy_only=False).reshape(len(fit), dims).astype(float)
            if cells is None:
                places = [(np.arange(len(asked)), np.arange(len(fit)))]
            else:
                of = np.array(batch.column(2).to_pylist())[fit]
                places = [(np.array(cells[c]), np.flatnonzero(of == c)) for c in np.unique(of).tolist() if c in cells]
            for which, these in places:
                q, r = np.nonzero(_best(values[these], asked[which], k, metric))
                if len(q):
                    yield pa.RecordBatch.from_arrays([pa.array(which[q], pa.int32()), keys.take(pa.array(fit[these[r]])), taken.take(pa.array(these[r]))], names=["tessera_q", key, "v"])

    ship(spark)
    columns = [key, "v"] + (["cell"] if cells is not None else [])
    schema = T.StructType([T.StructField("tessera_q", T.IntegerType()), rows.schema[key], T.StructField("v", T.ArrayType(T.DoubleType()))])
    near = rows.select(*columns).mapInArrow(run, schema)
    queries = spark.createDataFrame([(n, i, [float(x) for x in q]) for n, (i, q) in enumerate(block)], T.StructType([T.StructField("tessera_q", T.IntegerType()), T.StructField(query_key, kind), T.StructField("q", T.ArrayType(T.DoubleType()))]))
    pairs = near.join(F.broadcast(queries), "tessera_q")
    return pairs.select(query_key, key, measure(metric, "v", "q").alias("distance")).where("distance IS NOT NULL")


def _in_blocks(rows: DataFrame, queries: DataFrame, k: int, vector: str, key: str, query_key: str, metric: str, cells_of=None) -> DataFrame:
    """(query_key, key, distance, rank). One block of queries is in the driver at a time; the answers of all
    but a single block are written to the shared folder, one block after the other."""
    spark, kind = rows.sparkSession, queries.schema[query_key].dataType
    found, path, block, dims = None, None, [], None
    order = Window.partitionBy(query_key).orderBy("distance", key)  # each partition keeps k rows a query before the shuffle

    def ask() -> None:
        nonlocal found, path
        if found is not None:
            path = path or shared(spark, "nearest")
            found.write.mode("append").parquet(path)
        some, cells = rows, None
        if cells_of is not None:
            cells = cells_of(np.array([q for _, q in block], float))
            some = rows.where(F.col("cell").isin(sorted(cells)))
        near = _block(some, list(block), k, key, query_key, kind, metric, cells)
        found = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(query_key, key, "distance", "rank")

    asked = queries.select(query_key, doubles(vector).alias("q")).where("q IS NOT NULL AND NOT exists(q, x -> x IS NULL)")
    for i, q in asked.withColumn("n", F.size("q")).orderBy("n").select(query_key, "q").toLocalIterator():
        if block and (len(block) == QUERY_BLOCK or len(q) != dims):
            ask()
            block = []
        dims = len(q)
        block.append((i, list(q)))
    if block:
        ask()
    if found is None:
        return queries.select(query_key).limit(0).select(query_key, F.lit(None).cast(rows.schema[key].dataType).alias(key), F.lit(0.0).alias("distance"), F.lit(1).alias("rank"))
    if path:
        found.write.mode("append").parquet(path)
        return spark.read.schema(found.schema).parquet(path)
    return found


def nearest_all(df: DataFrame, queries: DataFrame, k: int, vector: str = "embedding", key: str = "vec_id", query_key: str = "query_id", metric: str = "l2") -> DataFrame:
    """(query_key, key, distance, rank) for each query vector; ties by key. The rows are scanned once for each
    block of queries. Null vectors, and rows of another dimension than the query, don't count."""
    return _in_blocks(df.select(key, doubles(vector).alias("v")), queries, k, vector, key, query_key, metric)


@dataclass
class InvertedFile:
    """Approximate search over a stored index: rows lie in the cell of their nearest centre, and a query reads the
    nearest cells only. Rows carry the number of the batch that they came with; a deletion holds for the
    rows of its key in earlier batches, so a key that is deleted may come back."""

    spark: object
    path: str
    centres: np.ndarray
    key: str
    metric: str
    batches: int = 0

    @classmethod
    def build(cls, df: DataFrame, path: str | None = None, n_cells: int = 64, sample: int = 10_000, vector: str = "embedding", key: str = "vec_id", metric: str = "l2", seed: int = 7) -> "InvertedFile":
        """Centres come from at most ``sample`` rows; every row with a vector is indexed below ``path``, or
        in the folder that the cluster shares. The vector's column is ``v`` there; all other columns are kept, for filters."""
        points = np.array([r[0] for r in df.select(doubles(vector).alias("v")).where("v IS NOT NULL").limit(sample).collect()])
        if len(points) and metric == "cosine":
            points = points / np.maximum(np.sqrt((points**2).sum(1, keepdims=True)), 1e-30)
        rng = np.random.default_rng(seed)
        centres = points[rng.choice(len(points), min(n_cells, len(points)), replace=False)] if len(points) else np.zeros((0, 0))
        for _ in range(15 if len(points) else 0):
            near = ((points**2).sum(1)[:, None] + (centres**2).sum(1)[None] - 2 * points @ centres.T).argmin(1)
            centres = np.array([points[near == c].mean(0) if (near == c).any() else centres[c] for c in range(len(centres))])
        path = path or shared(df.sparkSession, "cells")
        index = cls(df.sparkSession, f"{path.rstrip('/')}/{uuid.uuid4().hex}", centres, key, metric)
        index.insert(df, vector)
        return index

    def _celled(self, df: DataFrame) -> DataFrame:
        """Adds the cell of each vector ``v``."""
        centres, unit = self.centres, self.metric == "cosine"
        at = df.columns.index("v")

        def run(batches):
            for batch in batches:
                rows = batch.column(at).to_pylist()
                cell = np.zeros(len(rows), np.int32)
                if len(centres):
                    fit = [k for k, x in enumerate(rows) if x is not None and len(x) == centres.shape[1] and None not in x]
                    values = np.array([rows[k] for k in fit], float).reshape(len(fit), centres.shape[1])
                    if unit:
                        values = values / np.maximum(np.sqrt((values**2).sum(1, keepdims=True)), 1e-30)
                    cell[fit] = ((centres**2).sum(1)[None] - 2 * values @ centres.T).argmin(1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], names=[*batch.schema.names, "cell"])

        ship(self.spark)
        return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("cell", T.IntegerType())]))

    def insert(self, df: DataFrame, vector: str = "embedding") -> None:
        """Adds rows. Keys that are there already are to be deleted first."""
        rows = df.withColumn("v", doubles(vector)).drop(*([vector] if vector != "v" else [])).where("v IS NOT NULL")
        coded = quantised(self._celled(rows).withColumn("batch", F.lit(self.batches)), "v")
        coded.withColumn("codes", F.col("codes").cast("array<smallint>")).write.partitionBy("cell").mode("append").parquet(f"{self.path}/rows")
        self.batches += 1

    def delete(self, keys: DataFrame) -> None:
        """Deletes the rows of all keys (one column) that are there by now."""
        gone = keys.toDF(self.key).distinct().withColumn("before", F.lit(self.batches))
        gone.write.mode("append").parquet(f"{self.path}/deleted")
        self.batches += 1

    def rows(self, where: str | None = None) -> DataFrame:
        """The live rows; a filter reaches the scan."""
        found = self.spark.read.parquet(f"{self.path}/rows")
        found = found.where(where) if where else found
        try:
            gone = self.spark.read.parquet(f"{self.path}/deleted").groupBy(F.col(self.key).alias("tessera_gone")).agg(F.max("before").alias("tessera_before"))
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return found
        gone = F.broadcast(gone) if gone.count() <= BROADCAST_KEYS else gone
        return found.join(gone, (F.col(self.key) == F.col("tessera_gone")) & (F.col("batch") < F.col("tessera_before")), "left_anti")

    def vacuum(self) -> None:
        """Rewrites the index without deleted rows, one folder a cell."""
        fresh = f"{self.path.rsplit('/', 1)[0]}/{uuid.uuid4().hex}"
        self.rows().repartition("cell").write.partitionBy("cell").parquet(f"{fresh}/rows")
        old, self.path = self.path, fresh
        at = self.spark._jvm.org.apache.hadoop.fs.Path(old)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def probes(self, asked: np.ndarray, probe: int) -> np.ndarray:
        """The cells that each query looks at, the most promising first, by the index's own metric."""
        if self.metric == "dot":
            far = -(asked @ self.centres.T)
        else:
            if self.metric == "cosine":
                asked = asked / np.maximum(np.sqrt((asked**2).sum(1, keepdims=True)), 1e-30)
            far = (self.centres**2).sum(1)[None] - 2 * asked @ self.centres.T
        return far.argsort(1, kind="stable")[:, :probe]

    def search(self, query: list[float], k: int, probe: int = 40, where: str | None = None) -> DataFrame:
        """The k nearest live rows in the nearest cells that pass the filter."""
        cells = self.probes(np.array([query], float), probe)[0]
        return nearest(self.rows(where).where(F.col("cell").isin([int(c) for c in cells])), query, k, "v", self.key, self.metric)

    def search_codes(self, query: list[float], k: int, probe: int = 40, more: int = 4, where: str | None = None) -> DataFrame:
        """As search, but the cells are scanned by their 8-bit codes alone; the best ``more`` times k are ranked
        anew by their vectors."""
        cells = [int(c) for c in self.probes(np.array([query], float), probe)[0]]
        rows = self.rows(where).where(F.col("cell").isin(cells))
        coded = nearest(rows.select(self.key, restored().alias("v")), query, k * more, "v", self.key, self.metric).select(F.col(self.key).alias("tessera_near"))
        return nearest(rows.join(F.broadcast(coded), F.col(self.key) == F.col("tessera_near"), "left_semi"), query, k, "v", self.key, self.metric)

    def search_all(self, queries: DataFrame, k: int, probe: int = 40, vector: str = "embedding", query_key: str = "query_id", where: str | None = None) -> DataFrame:
        """(query_key, key, distance, rank) for each query vector, in blocks; a block reads the cells of its queries once."""

        def cells_of(asked: np.ndarray) -> dict:
            out: dict[int, list[int]] = {}
            for n, cells in enumerate(self.probes(asked, probe).tolist()):
                for c in cells:
                    out.setdefault(c, []).append(n)
            return out

        return _in_blocks(self.rows(where), queries, k, vector, self.key, query_key, self.metric, cells_of)


def quantised(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """Adds ``codes`` (0 to 255 for each component), ``low`` and ``step`` of each vector."""
    v = doubles(vector)
    df = df.withColumn("low", F.array_min(v)).withColumn("step", (F.array_max(v) - F.array_min(v)) / 255)
    return df.withColumn("codes", F.transform(v, lambda x: F.when(F.col("step") > 0, F.round((x - F.col("low")) / F.col("step"))).otherwise(0).cast("int")))


def restored(codes: str = "codes") -> Column:
    return F.transform(codes, lambda c: F.col("low") + c * F.col("step"))
