"""An approximate index of vectors: cells around centres, of which a search reads the nearest few."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ravelin.shipping import shipped
from ravelin.storage import exists, removed

#: Vectors that the first centres are fitted on, at most, and for each of these, its own; rounds of fitting.
SAMPLE, OWN_SAMPLE, ROUNDS = 20_000, 2_000, 12
#: Fewest and most cells: the most bound what is sent to every task.
CELLS = (16, 1 << 16)
#: Queries and vectors of a cell that meet at a time.
QUERY_BLOCK, VECTOR_BLOCK = 256, 2048
#: A search reads as many cells as hold this share of the nearest vectors of a few of the sample.
RECALL, NEAREST, ASKED = 0.98, 10, 256


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def fitted(vectors: np.ndarray, cells: int, rounds: int = ROUNDS, seed: int = 3) -> np.ndarray:
    """Centres of unit length, by spherical k-means; cells without vectors keep their centre."""
    x = _unit(vectors.astype(np.float64))
    centres = x[np.random.default_rng(seed).permutation(len(x))[: min(cells, len(x))]]
    for _ in range(rounds):
        nearest = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, x)
        filled = np.bincount(nearest, minlength=len(centres)) > 0
        centres = np.where(filled[:, None], _unit(sums), centres)
    return centres


def cells_for(rows: int) -> int:
    """About the square root of the rows, as a power of two."""
    return int(np.clip(1 << max(0, int(np.ceil(np.log2(max(rows, 1)) / 2))), *CELLS))


def probes_for(vectors: np.ndarray, centres: np.ndarray, recall: float = RECALL, k: int = NEAREST, asked: int = ASKED) -> int:
    """How many cells hold that share of the k nearest vectors of some of the vectors."""
    x = _unit(vectors.astype(np.float64))
    q = x[:asked]
    near = np.argsort(-(q @ x.T), axis=1, kind="stable")[:, :k]
    place = np.empty((len(q), len(centres)), np.int64)
    order = np.argsort(-(q @ centres.T), axis=1, kind="stable")
    np.put_along_axis(place, order, np.arange(len(centres))[None].repeat(len(q), 0), axis=1)
    own = (x @ centres.T).argmax(axis=1)
    return int(np.ceil(np.quantile(np.take_along_axis(place, own[near], axis=1) + 1, recall)))


class VectorIndex:
    """Vectors (vec_id, embedding) in folders by their nearest centre, below a path. Centres come in two levels: a few over
    all vectors, and under each of these its own, fitted side by side."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def create(self, vectors: DataFrame, cells: int | None = None, sample: int = SAMPLE) -> VectorIndex:
        """Fit the centres on bounded samples, the vectors whose hashes are least, and index every vector. The number of
        cells follows the number of vectors unless it is given."""
        removed(self.spark, self.path)
        cells = cells or cells_for(vectors.count())
        some = vectors.select("vec_id", "embedding").orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toPandas()
        sampled = np.stack(some["embedding"].to_numpy()) if len(some) else np.zeros((0, 1))
        centres = self._centres(vectors, sampled, cells) if len(some) else sampled
        probes = probes_for(sampled, centres) if len(some) else 1
        rows = [(k, [float(v) for v in c], probes) for k, c in enumerate(centres)]
        self._put(vectors, centres)
        self.spark.createDataFrame(rows, "cell int, centre array<double>, probes int").coalesce(1).write.parquet(f"{self.path}/centres")
        return self

    def _centres(self, vectors: DataFrame, sampled: np.ndarray, cells: int) -> np.ndarray:
        """Few cells are fitted on the sample at once; many as groups of their own under the first ones."""
        if cells <= CELLS[0] * 16:
            return fitted(sampled, cells)
        first = fitted(sampled, int(np.sqrt(cells)))
        own = -(-cells // len(first))

        def fit(frame: pd.DataFrame) -> pd.DataFrame:
            got = fitted(np.stack(frame["embedding"].to_numpy()), own)
            return pd.DataFrame({"cell": frame["cell"].iloc[0], "centre": [c.tolist() for c in got]})

        dealt = self._dealt(vectors.select("vec_id", "embedding"), first, 1).withColumn("cell", F.get("cells", F.lit(0)))
        place = F.row_number().over(W.partitionBy("cell").orderBy(F.xxhash64("vec_id"), "vec_id"))  # the rank limit holds before the shuffle
        few = dealt.withColumn("__n", place).filter(F.col("__n") <= OWN_SAMPLE).select("cell", "embedding")
        got = few.groupBy("cell").applyInPandas(fit, "cell int, centre array<double>").toPandas()  # as many as cells
        return np.stack(got.sort_values(["cell", "centre"], key=lambda c: c if c.name == "cell" else c.map(tuple))["centre"].to_numpy())

    def _put(self, vectors: DataFrame, centres: np.ndarray) -> None:
        told = self._dealt(vectors, centres, 1).withColumn("cell", F.get("cells", F.lit(0))).drop("cells")
        told.repartition(F.col("cell"), F.pmod(F.xxhash64("vec_id"), F.lit(4))).write.mode("append").partitionBy("cell").parquet(f"{self.path}/vectors")

    def add(self, vectors: DataFrame) -> VectorIndex:
        """Further vectors, dealt to the cells that are there."""
        self._put(vectors, self.centres()[0])
        return self

    def exists(self) -> bool:
        return exists(self.spark, f"{self.path}/centres/_SUCCESS")

    def centres(self) -> tuple[np.ndarray, int]:
        """The centres, and how many cells a search reads."""
        rows = sorted(self.spark.read.parquet(f"{self.path}/centres").collect())  # as many as cells
        return (np.array([r.centre for r in rows]), rows[0].probes) if rows else (np.zeros((0, 1)), 1)

    def _dealt(self, rows: DataFrame, centres: np.ndarray, n: int) -> DataFrame:
        """rows with the n nearest centres of their embedding (cells)."""
        shipped(self.spark)
        schema = T.StructType([*rows.schema.fields, T.StructField("cells", T.ArrayType(T.IntegerType()))])
        sent = self.spark.sparkContext.broadcast(centres)

        def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for at in range(0, len(frame), 512):
                    part = frame.iloc[at : at + 512]
                    near = np.argsort(-(_unit(np.stack(part["embedding"].to_numpy()).astype(np.float64)) @ sent.value.T), axis=1, kind="stable")[:, :n]
                    yield part.assign(cells=near.astype(np.int32).tolist())

        return rows.mapInPandas(deal, schema)

    def search(self, queries: DataFrame, k: int, probes: int | None = None) -> DataFrame:
        """queries (query_id, embedding) -> (query_id, vec_id, score): the k best of the cells nearest to each query.

        Both sides are packed into blocks by cell, which meet by a merged join whatever their number; a pair of blocks is
        one product of matrices, of which a query's k best go on. Vectors of length 0 have no score."""
        centres, usual = self.centres()
        asked = self._dealt(queries.select("query_id", "embedding"), centres, probes or usual).select("query_id", "embedding", F.explode("cells").alias("cell"))
        asked = _blocks(asked.repartition("cell").sortWithinPartitions("cell"), "query_id", QUERY_BLOCK, "q")
        held = _blocks(self.spark.read.parquet(f"{self.path}/vectors"), "vec_id", VECTOR_BLOCK, "v")
        pairs = held.join(asked.hint("merge"), F.col("v_cell") == F.col("q_cell"))

        def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                for v_ids, v, q_ids, q in zip(f["v_ids"], f["v_data"], f["q_ids"], f["q_data"], strict=True):
                    scores = np.frombuffer(q).reshape(len(q_ids), -1) @ np.frombuffer(v).reshape(len(v_ids), -1).T
                    if len(v_ids) > k:
                        # ties at the k-th score all go on: the final rank decides between them by id
                        at = np.nonzero(scores >= -np.partition(-np.nan_to_num(scores, nan=-2.0), k - 1, axis=1)[:, k - 1 : k])
                    else:
                        at = np.nonzero(~np.isnan(scores))
                    yield pd.DataFrame({"query_id": np.asarray(q_ids)[at[0]], "vec_id": np.asarray(v_ids)[at[1]], "score": scores[at]})

        w = W.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
        scored = pairs.select("v_ids", "v_data", "q_ids", "q_data").mapInPandas(score, "query_id long, vec_id long, score double")
        return scored.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= k).drop("__n")


def _blocks(rows: DataFrame, key: str, size: int, name: str) -> DataFrame:
    """Rows (key, embedding, cell), those of a cell next to each other, as blocks of up to ``size`` vectors of unit length:
    the cell, ids, and the vectors end to end."""
    shipped(rows.sparkSession)

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cell, ids, held = None, [], []
        for f in frames:
            for c, i, v in zip(f["cell"], f[key], f["embedding"], strict=True):
                if ids and (c != cell or len(ids) == size):
                    yield block(cell, ids, held)
                    ids, held = [], []
                cell = c
                ids.append(i)
                held.append(v)
        if ids:
            yield block(cell, ids, held)

    def block(cell: int, ids: list, held: list) -> pd.DataFrame:
        x = np.stack(held).astype("float64")
        with np.errstate(invalid="ignore", divide="ignore"):
            unit = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
        return pd.DataFrame({f"{name}_cell": [cell], f"{name}_ids": [ids], f"{name}_data": [unit.tobytes()]})

    return rows.select("cell", key, "embedding").mapInPandas(pack, f"{name}_cell int, {name}_ids array<long>, {name}_data binary")
