"""Approximate neighbours above the exact search's range: vectors in cells around centres, a query looks at a few cells.

The centres are fitted on a bounded sample (SAMPLE vectors by least hash); every vector is in the index, in the
cell of its nearest centre. How many cells a query looks at is measured on the sample: as many as bring the share
of true neighbours to GOAL there. With `probes` of all cells the search is exact. A stored index (`stored`) has its
vectors in folders by cell: a search reads the folders of the cells that its queries look at, and no others."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import ship_package
from . import vectors as V

SAMPLE, MOST_CELLS, TURNS, SEED = 20_000, 1024, 8, 7
GOAL, ASKED, NEAR = 0.97, 256, 10


@dataclass
class CellIndex:
    centres: np.ndarray  # cells x dimensions, of length one: at most MOST_CELLS rows
    vectors: DataFrame  # block_uid, note_path, embedding, row (its cell), part (of its cell)
    parts: DataFrame | None  # row, n_parts: cells of more than VECTOR_BLOCK vectors come in parts; None: counted for each search
    probes: int = 1  # cells that a query looks at
    kept: DataFrame | None = None  # cached for this index

    def close(self) -> None:
        if self.kept is not None:
            self.kept.unpersist()


def fit_centres(sample: np.ndarray, cells: int) -> np.ndarray:
    """Spherical k-means: centres of length one."""
    rng = np.random.default_rng(SEED)
    centres = sample[rng.choice(len(sample), size=min(cells, len(sample)), replace=False)]
    for _ in range(TURNS):
        near = np.argmax(sample @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        norm = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        centres = np.where(norm > 0, sums / np.where(norm == 0, 1, norm), centres)
    return centres


def _nearest(held, take: int, names: list[str]):
    def run(batches):
        centres = held.value
        for batch in batches:
            if not batch.num_rows:
                continue
            scores = V._unit(batch.column(batch.schema.get_field_index("embedding"))) @ centres.T
            best = np.argsort(-scores, axis=1, kind="stable")[:, :take].astype(np.int32)
            cells = pa.ListArray.from_arrays(pa.array(np.arange(len(best) + 1, dtype=np.int32) * best.shape[1]), pa.array(best.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in names), cells], names=[*names, "cells"])

    return run


def _cells(df: DataFrame, held, take: int) -> DataFrame:
    schema = T.StructType([*df.schema.fields, T.StructField("cells", T.ArrayType(T.IntegerType()))])
    return df.mapInArrow(_nearest(held, take, df.columns), schema)


def probes_for(sample: np.ndarray, centres: np.ndarray) -> int:
    """The fewest cells with which ASKED vectors of the sample find GOAL of their NEAR nearest others in it."""
    asked = sample[:: max(1, len(sample) // ASKED)][:ASKED]
    home = np.argmax(sample @ centres.T, axis=1)
    order = np.argsort(-(asked @ centres.T), axis=1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(order.shape[1])[None, :], axis=1)
    near = np.argsort(-(asked @ sample.T), axis=1, kind="stable")[:, 1 : NEAR + 1]
    needed = np.sort(np.take_along_axis(place, home[near], axis=1).ravel())
    return int(needed[min(len(needed) - 1, int(np.ceil(GOAL * len(needed))))]) + 1 if len(needed) else len(centres)


def centres_of(vectors: DataFrame, cells: int | None = None) -> tuple[np.ndarray, int]:
    """Centres for vectors(embedding), none where there is no vector, and how many cells a query should look at.

    The sample's rows are chosen by a rate first, so that no task sends many rows to the driver."""
    ship_package(vectors.sparkSession)
    own = vectors.filter("size(embedding) > 0").select("embedding", F.xxhash64("embedding").alias("h"))
    n = own.count()
    if not n:
        return np.zeros((0, 1)), 1
    upto = int(min(1.0, 2 * SAMPLE / n) * (1 << 30))
    picked = own.filter(F.pmod("h", F.lit(1 << 30)) < upto).orderBy("h").limit(SAMPLE).select("embedding").toArrow()
    sample = V._unit(picked["embedding"].combine_chunks())
    centres = fit_centres(sample, cells or max(1, min(MOST_CELLS, math.isqrt(n))))
    return centres, probes_for(sample, centres)


def _placed(held):
    def run(batches):
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("embedding"))
            real = np.asarray(pc.fill_null(pc.greater(pc.list_value_length(column), 0), False))
            cell = np.full(batch.num_rows, -1, dtype=np.int32)
            if real.any() and len(held.value):
                cell[real] = np.argmax(V._unit(column.filter(pa.array(real))) @ held.value.T, axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], names=[*batch.schema.names, "cell"])

    return run


def place(vectors: DataFrame, centres: np.ndarray) -> DataFrame:
    """vectors(block_uid, note_path, embedding) with their cell; -1 for null and empty ones, and without centres. Each
    row is computed once, as an embedding may be dear."""
    held = vectors.sparkSession.sparkContext.broadcast(centres)
    return vectors.mapInArrow(_placed(held), T.StructType([*vectors.schema.fields, T.StructField("cell", T.IntegerType())]))


def _in_parts(vectors: DataFrame, parts: DataFrame) -> DataFrame:
    """vectors(block_uid, row) with the part of their cell; parts has at most MOST_CELLS rows."""
    return vectors.join(F.broadcast(parts), "row").withColumn("part", F.pmod(F.xxhash64("block_uid"), "n_parts").cast("int")).drop("n_parts")


def _parts(vectors: DataFrame) -> DataFrame:
    return vectors.groupBy("row").agg(F.ceil(F.count(F.lit(1)) / V.VECTOR_BLOCK).cast("int").alias("n_parts"))


def build(vectors: DataFrame, cells: int | None = None) -> CellIndex:
    """vectors(block_uid, note_path, embedding); null and empty embeddings take no part."""
    own = vectors.filter("size(embedding) > 0").select("block_uid", "note_path", "embedding")
    centres, probes = centres_of(own, cells)
    placed = place(own, centres).withColumnRenamed("cell", "row").persist()
    parts = _parts(placed)
    return CellIndex(centres, _in_parts(placed, parts), parts, probes, placed)


def stored(centres: np.ndarray, vectors: DataFrame, probes: int) -> CellIndex:
    """The index of vectors(block_uid, note_path, embedding, row) that lie in folders by row, their cell."""
    return CellIndex(centres, vectors, None, probes)


def search(index: CellIndex, queries: DataFrame, k: int, probes: int | None = None) -> DataFrame:
    """queries(query_id, embedding, exclude_note) -> query_id, block_uid, note_path, semantic_score, sem_rank. probes:
    instead of the index's own."""
    spark = queries.sparkSession
    asked = queries.filter("size(embedding) > 0").select("query_id", "embedding", "exclude_note")
    schema = T.StructType([asked.schema["query_id"], index.vectors.schema["block_uid"], T.StructField("note_path", T.StringType()), T.StructField("semantic_score", T.DoubleType())])
    if not len(index.centres):
        return spark.createDataFrame([], schema).withColumn("sem_rank", F.lit(0))
    near = _cells(asked, spark.sparkContext.broadcast(index.centres), min(probes or index.probes, len(index.centres)))
    near = near.withColumn("row", F.explode("cells")).drop("cells")
    if index.parts is None:
        # at most MOST_CELLS cells: the join prunes the folders of all others before anything is read
        looked = F.broadcast(near.select("row").filter("row >= 0").distinct())
        index = CellIndex(index.centres, index.vectors.join(looked, "row", "left_semi"), _parts(index.vectors.join(looked, "row", "left_semi")))
        index.vectors = _in_parts(index.vectors, index.parts)
    near = near.join(F.broadcast(index.parts), "row").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("n_parts") - 1))).drop("n_parts")
    # many queries of one cell meet its vectors in blocks
    block = F.pmod(F.xxhash64("query_id"), F.lit(max(1, -(-queries.count() // V.QUERY_BLOCK)))).cast("int")
    blocks = near.withColumn("block", block)
    own = index.vectors.join(blocks.select("row", "part", F.col("block").alias("of")).distinct(), ["row", "part"])
    found = own.groupBy("row", "part", "of").cogroup(blocks.groupBy("row", "part", "block")).applyInArrow(V._cell(k), schema)
    ranked = found.withColumn("sem_rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("semantic_score"), "block_uid")))
    return ranked.filter(F.col("sem_rank") <= k)


def recall(found: DataFrame, exact: DataFrame) -> float:
    """The share of the exact neighbours that were found."""
    hits = exact.select("query_id", "block_uid").join(found.select("query_id", "block_uid"), ["query_id", "block_uid"], "left_semi").count()
    return hits / max(1, exact.count())
