"""Op 12: k-means over whole-number vectors, each distinct vector once with its multiplicity.

Components become integers (`quantised`), equal vectors become one row with a weight, and Lloyd's rounds run
over these rows only: a task assigns its rows by exact integer distances and returns for each centroid the sums
of weight times component, as whole numbers, so neither partitions nor order change a result. Between rounds
k x dimensions sums reach the driver, whatever the table's size. At the end the assignments are joined back to
all rows.

Defined results: vectors of another length, or with a null, NaN or infinite component, and null vectors take no
part; an empty table gives an empty result; fewer than k vectors give that many centroids; a centroid without
vectors stays where it is; at equal distances the smaller number wins. Rows that repeat are each counted, and
each is returned. A null key takes part; where keys repeat or are null, starts of equal hash go by components,
and null keys come last. Components beyond +-2**27 are cut to that, so that a distance always fits a long; other
columns are not read.
"""

from __future__ import annotations

import hashlib
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, read_table

CLUSTERS, ROUNDS, DIMS, SCALE, SEED = 40, 5, 64, 256, "2"
LARGEST = 1 << 27
#: Rows of which the distances are held at a time.
BLOCK = 8192


def quantised(column: Column) -> Column:
    """floor(SCALE * x) of each component, as int."""
    return F.transform(column, lambda x: F.floor(F.greatest(F.least(x.cast("double") * SCALE, F.lit(float(LARGEST))), F.lit(-float(LARGEST)))).cast("int"))


def finite(column: Column) -> Column:
    """Whether the vector and all its components are there and are numbers; false for a null vector."""
    return F.coalesce(F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))


def nearest(values: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid and the squared distance to it, exact: in floats where all numbers stay
    below 2**53, else in 64-bit integers."""
    top = max(int(np.abs(values).max(initial=0)), int(np.abs(centroids).max(initial=0)))
    kind = np.float64 if 4 * top * top * values.shape[1] < 1 << 53 else np.int64
    v, c = values.astype(kind), centroids.astype(kind)
    squares = (v * v).sum(axis=1)[:, None] - 2 * (v @ c.T) + (c * c).sum(axis=1)[None, :]
    best = np.argmin(squares, axis=1)
    return best, squares[np.arange(len(best)), best].astype(np.int64)


def _vectors(batch: pa.RecordBatch) -> np.ndarray:
    flat = batch.column(batch.schema.get_field_index("q")).flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(batch.num_rows, -1).astype(np.int64)


def _sums(held):
    def run(batches):
        centroids = held.value
        totals = np.zeros(centroids.shape, dtype=object)
        counts = [0] * len(centroids)
        for batch in batches:
            values, weights = _vectors(batch) if batch.num_rows else None, batch.column(batch.schema.get_field_index("weight")).to_numpy()
            for lo in range(0, batch.num_rows, BLOCK):
                v, w = values[lo : lo + BLOCK], weights[lo : lo + BLOCK]
                near, _ = nearest(v, centroids)
                # whole numbers of any size where 64 bits could overflow
                small = int(np.abs(v).max(initial=0)) * sum(map(int, w)) < 1 << 62
                order = np.argsort(near, kind="stable")
                cuts = np.searchsorted(near[order], np.arange(len(centroids) + 1))
                weighted = (v * w[:, None] if small else v.astype(object) * w.astype(object)[:, None])[order]
                for c, (a, b) in enumerate(pairwise(cuts)):
                    if b > a:
                        totals[c] += weighted[a:b].sum(axis=0).astype(object)
                        counts[c] += sum(map(int, w[order[a:b]]))
        rows = [(c, j, str(x)) for c, n in enumerate(counts) if n for j, x in enumerate([*totals[c], n])]
        yield pa.RecordBatch.from_pydict({k: [r[i] for r in rows] for i, k in enumerate(("cluster", "place", "total"))}, schema=pa.schema([("cluster", pa.int32()), ("place", pa.int32()), ("total", pa.string())]))

    return run


def _assigned(held):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                values = _vectors(batch)
                found = [nearest(values[lo : lo + BLOCK], held.value) for lo in range(0, len(values), BLOCK)]
                cluster, distance = (np.concatenate(x) for x in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cluster.astype(np.int32)), pa.array(distance)], names=[*batch.schema.names, "cluster", "distance"])

    return run


def cluster_vectors(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", k: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS, seed: str = SEED) -> DataFrame:
    """(key, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector with `dims` numbers.

    The first centroids are the k vectors whose `seed:key` has the least SHA-256."""
    spark = vectors.sparkSession
    kept = vectors.select(F.col(key).alias("__key"), F.col(column).alias("v")).filter((F.size("v") == dims) & finite(F.col("v"))).select("__key", quantised(F.col("v")).alias("q"))
    distinct = materialise(kept.groupBy("q").agg(F.count(F.lit(1)).alias("weight")), "vectors-distinct")
    hashed = kept.withColumn("hash", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("__key").cast("string")), 256))
    starts = hashed.orderBy(F.col("hash").asc_nulls_last(), "q").select("q").limit(k).collect()  # k rows
    names = f"{key} {kept.schema['__key'].dataType.simpleString()}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not starts:
        return spark.createDataFrame([], names)
    centroids = np.array([r.q for r in starts], dtype=np.int64)
    for _ in range(rounds):
        held = spark.sparkContext.broadcast(centroids)
        parts = distinct.mapInArrow(_sums(held), "cluster int, place int, total string")
        sums = {(r.cluster, r.place): int(r.total) for r in parts.groupBy("cluster", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()}
        centroids = centroids.copy()
        for c in {c for c, _ in sums}:
            centroids[c] = [sums[c, j] // sums[c, dims] for j in range(dims)]
        held.destroy()
    assigned = materialise(distinct.mapInArrow(_assigned(spark.sparkContext.broadcast(centroids)), "q array<int>, weight long, cluster int, distance long"), "vectors-assigned")
    inertia = {r.cluster: int(r.s) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)") * F.col("weight")).alias("s")).collect()}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    stated = spark.createDataFrame([(c, s, sum(inertia.values()), digest[c]) for c, s in inertia.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    # a vector that many rows share goes to several tasks, with a copy of its assignment for each
    limit = max(256, assigned.agg(F.coalesce(F.sum("weight"), F.lit(0))).first()[0] // (4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    hot = F.broadcast(assigned.filter(F.col("weight") > limit).select("q", F.ceil(F.col("weight") / limit).cast("int").alias("salts")))
    salts = F.coalesce("salts", F.lit(1))
    dealt = kept.withColumn("nth", F.monotonically_increasing_id()).join(hot, "q", "left").select("__key", "q", F.pmod("nth", salts).cast("int").alias("salt"))
    copied = assigned.select("q", "cluster", "distance", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("weight") / limit).cast("int"), F.lit(1)) - 1)).alias("salt"))
    return dealt.join(copied, ["q", "salt"]).join(F.broadcast(stated), "cluster").select(F.col("__key").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_centroid_clustering(spark, sf_dir) -> DataFrame:
    return cluster_vectors(read_table(spark, sf_dir, "embeddings"))


def _sql() -> str:
    square = "list_sum(list_transform(list_zip(v.q, c.q), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    near = lambda i: f"SELECT v.vec_id, any_value(v.q) AS q, min({{'d': CAST({square} AS BIGINT), 'c': c.c}}) AS b FROM kept v CROSS JOIN c{i} c GROUP BY v.vec_id"
    steps = [
        f"kept AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMS})",
        f"c0 AS (SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id)) - 1 AS c, q FROM kept QUALIFY c < {CLUSTERS})",
    ]
    for i in range(ROUNDS):
        steps += [
            f"a{i} AS ({near(i)})",
            f"p{i} AS (SELECT b.c AS c, j, CAST(sum(q[j]) AS BIGINT) AS s, count(*) AS n FROM a{i} CROSS JOIN range(1, {DIMS + 1}) t(j) GROUP BY b.c, j)",
            f"m{i} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY j) AS q FROM p{i} GROUP BY c)",
            f"c{i + 1} AS (SELECT o.c, coalesce(m.q, o.q) AS q FROM c{i} o LEFT JOIN m{i} m ON o.c = m.c)",
        ]
    steps.append(f"last AS ({near(ROUNDS)})")
    return (
        f"WITH {', '.join(steps)} SELECT l.vec_id, CAST(l.b.c AS INTEGER) AS cluster, l.b.d AS distance, CAST(sum(l.b.d) OVER (PARTITION BY l.b.c) AS BIGINT) AS cluster_inertia, "
        f"CAST(sum(l.b.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.q, ',')) AS centroid_sha256 FROM last l JOIN c{ROUNDS} c ON c.c = l.b.c"
    )


SQL = _sql()
