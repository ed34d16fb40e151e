"""Exact nearest neighbours: Arrow blocks of vectors against blocks of queries."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import ship_package

#: Queries and vectors of one cell: with 1024 dimensions 8 and 128 MB of numbers, and 128 MB of scores.
QUERY_BLOCK, VECTOR_BLOCK = 1024, 16384
#: Query vectors are sent to all tasks while they are at most so many bytes, else they are read by block.
BROADCAST_BYTES = 64 << 20


def _unit(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    m = flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)
    norm = np.sqrt((m * m).sum(axis=1))
    return m / np.where(norm == 0, 1.0, norm)[:, None]


def _best(ids, notes, unit, query_ids, excluded, queries, k):
    scores = np.round(unit @ queries.T, 6)
    out = []
    for q in range(queries.shape[0]):
        s = scores[:, q]
        ok = np.flatnonzero(notes != excluded[q]) if excluded[q] is not None else np.arange(len(s))
        if len(ok) > k:
            kth = np.partition(s[ok], len(ok) - k)[len(ok) - k]
            ok = ok[s[ok] >= kth]
        out.append((np.full(len(ok), q), ok, s[ok]))
    q, i, s = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, int),) * 3
    return query_ids[q], ids[i], notes[i], s


def _cell(k: int):
    def run(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        lists = [t["embedding"].combine_chunks() if t.num_rows else None for t in (vectors, queries)]
        if lists[0] is None or lists[1] is None:
            names = {"query_id": queries.schema.field("query_id").type, "block_uid": vectors.schema.field("block_uid").type, "note_path": pa.string(), "semantic_score": pa.float64()}
            return pa.schema(list(names.items())).empty_table()
        ids, notes, query_ids = (np.array(c.to_pylist(), dtype=object) for c in (vectors["block_uid"], vectors["note_path"], queries["query_id"]))
        q, i, n, s = _best(ids, notes, _unit(lists[0]), query_ids, queries["exclude_note"].to_pylist(), _unit(lists[1]), k)
        return pa.table({"query_id": pa.array(q.tolist(), queries.schema.field("query_id").type), "block_uid": pa.array(i.tolist(), vectors.schema.field("block_uid").type), "note_path": pa.array(n.tolist(), pa.string()), "semantic_score": s})

    return run


def cosine_top(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """vectors(block_uid, note_path, embedding), queries(query_id, embedding, exclude_note) -> query_id,
    block_uid, note_path, semantic_score, sem_rank. Null and empty embeddings take no part."""
    spark = vectors.sparkSession
    ship_package(spark)
    vectors = vectors.filter("size(embedding) > 0").select("block_uid", "note_path", "embedding")
    queries = queries.filter("size(embedding) > 0").select("query_id", "embedding", "exclude_note")
    uid, qid = vectors.schema["block_uid"].dataType, queries.schema["query_id"].dataType
    size = queries.agg(F.sum(F.size("embedding") * F.lit(8))).first()[0] or 0
    schema = T.StructType([T.StructField("query_id", qid), T.StructField("block_uid", uid), T.StructField("note_path", T.StringType()), T.StructField("semantic_score", T.DoubleType())])
    if size <= BROADCAST_BYTES:
        table = queries.toArrow().combine_chunks()
        held = spark.sparkContext.broadcast((np.array(table["query_id"].to_pylist(), dtype=object), table["exclude_note"].to_pylist(), _unit(table["embedding"].combine_chunks())))

        def run(batches):
            query_ids, excluded, unit = held.value
            for batch in batches:
                notes = np.array(batch.column(1).to_pylist(), dtype=object)
                ids = np.array(batch.column(0).to_pylist(), dtype=object)
                own = _unit(batch.column(2))
                for lo in range(0, len(query_ids), QUERY_BLOCK):
                    q, i, n, s = _best(ids, notes, own, query_ids[lo : lo + QUERY_BLOCK], excluded[lo : lo + QUERY_BLOCK], unit[lo : lo + QUERY_BLOCK], k)
                    yield pa.RecordBatch.from_pydict({"query_id": q.tolist(), "block_uid": i.tolist(), "note_path": n.tolist(), "semantic_score": s}, schema=out_schema)

        from pyspark.sql.pandas.types import to_arrow_schema

        out_schema = to_arrow_schema(schema)
        found = vectors.mapInArrow(run, schema)
    else:
        # cells of at most about VECTOR_BLOCK vectors and QUERY_BLOCK queries; each keeps the k best of a query
        rows, asked = max(1, -(-vectors.count() // VECTOR_BLOCK)), max(1, -(-queries.count() // QUERY_BLOCK))
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        own = vectors.withColumn("row", F.pmod(F.xxhash64("block_uid"), F.lit(rows)).cast("int")).withColumn("part", every(asked))
        each = queries.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(asked)).cast("int")).withColumn("row", every(rows))
        found = own.groupBy("row", "part").cogroup(each.groupBy("row", "part")).applyInArrow(_cell(k), schema)
    ranked = found.withColumn("sem_rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("semantic_score"), "block_uid")))
    return ranked.filter(F.col("sem_rank") <= k)
