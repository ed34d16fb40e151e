"""Pieces that the hashed n-gram classifiers share: features and bounded training samples."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SAMPLE_TEXT_BYTES, SAMPLE_BYTES, MAX_LABELS = 64 << 10, 96 << 20, 256
_SPREAD = np.uint32(2654435761)


def gram_buckets(data: np.ndarray, n: int, bits: int) -> np.ndarray:
    """The bucket of the n bytes (at most 4) that begin at each position but the last n - 1."""
    size = max(0, len(data) - n + 1)
    g = data[:size].astype(np.uint32)
    for j in range(1, n):
        g |= data[j : j + size].astype(np.uint32) << np.uint32(8 * j)
    g ^= np.uint32(0x9E3779B9 * n & 0xFFFFFFFF)
    g ^= g >> np.uint32(15)
    g *= _SPREAD
    g ^= g >> np.uint32(13)
    g *= np.uint32(0x85EBCA6B)
    return g >> np.uint32(32 - bits)


def inside_mask(offs: np.ndarray, n: int, size: int) -> np.ndarray:
    """Which of the first `size` positions begin n bytes that lie in one text."""
    ok = np.ones(size + n, dtype=bool)
    for j in range(1, n):
        at = offs[1:] - j
        ok[at[(at >= 0) & (at < size)]] = False
    return ok[:size]


def range_sums(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Sums of values[begin:end], along the first axis."""
    total = np.zeros((len(values) + 1, *values.shape[1:]), dtype=np.float64)
    np.cumsum(values, axis=0, out=total[1:])
    return total[end] - total[begin]


def bounded_sample(rows: DataFrame, key: str, label: str, per_label: int, max_labels: int = MAX_LABELS) -> pa.Table:
    """At most `per_label` distinct rows of each of the `max_labels` most frequent labels, those of least hash.

    The hash is of the whole row, so rows that share a key are drawn one by one, and rows that repeat count once. A
    rate that leaves about four times as many goes first; what is left is numbered inside its label, so the bound is
    hard. With texts, those of more than SAMPLE_TEXT_BYTES are not drawn, and a label's texts end at its share of
    SAMPLE_BYTES."""
    texts = "text" in rows.columns
    if texts:
        rows = rows.filter(F.octet_length("text") <= SAMPLE_TEXT_BYTES)
    columns = rows.columns
    rows = rows.withColumn("__h", F.xxhash64(*columns))
    counts = rows.groupBy(label).agg(F.count(F.lit(1)).alias("rows"), F.approx_count_distinct("__h").alias("distinct")).orderBy(F.desc("rows"), label).limit(max_labels).collect()
    if not counts:
        return rows.select(*columns).limit(0).toArrow()
    kind = rows.schema[label].dataType.simpleString()
    rates = rows.sparkSession.createDataFrame([(r[0], int(min(1.0, 4 * per_label / r["distinct"]) * (1 << 30))) for r in counts], f"{label} {kind}, __upto long")
    picked = rows.join(F.broadcast(rates), label).filter(F.pmod("__h", F.lit(1 << 30)) < F.col("__upto")).drop("__upto").dropDuplicates(["__h"])
    order = Window.partitionBy(label).orderBy("__h")
    picked = picked.withColumn("__nth", F.row_number().over(order)).filter(F.col("__nth") <= per_label)
    if texts:
        picked = picked.withColumn("__sum", F.sum(F.octet_length("text")).over(order)).filter((F.col("__nth") == 1) | (F.col("__sum") <= SAMPLE_BYTES // len(counts)))
    return picked.select(*columns, "__h").toArrow().sort_by([(key, "ascending"), ("__h", "ascending")]).drop_columns(["__h"])
