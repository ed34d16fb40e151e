"""Op 9: token sequences materialised in training order as fixed-stride shards.

The tokens are given as an array of ids (op 1's token_ids, with the ids of end mark and padding), or are the
bytes of a text's UTF-8 form with 256 and 257. A row's tokens and one end mark are cut into sequences of
`seq_len` ids; the last is padded. A keyed Feistel network over the next power
of four, walked along its cycle until it falls below the number of sequences, sends the i-th sequence to
its slot: a permutation, so every slot is filled once. Shard k holds slots k*S to (k+1)*S - 1 in order,
one row each of exactly `seq_len` little-endian ids of `width` bytes (2 or 4). A shard is one Parquet file of
rows of one length, sorted by slot, because executors can write any shared store through Spark only; a reader
resumes at any slot by folder (shard) and by the slot statistics of row groups, not by byte offset.

Sequences are numbered by input partition and place in it; the counts of a first pass (one number per
partition) give each partition its offset, and the second pass fails if it meets another number. The rows are
written once before, unless `stored` says that docs comes straight from files, so that both passes see the
same partitions behind any shuffle.

Defined results: null and empty texts (or ids) give one sequence, the end mark and padding; repeated rows are
separate sequences; an empty table gives no shard; null keys are kept; an id that `width` cannot hold fails the
job; other columns are not read.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship_package
from .common import forget, materialise, read_table, shared_dir
from .text_kernel import mix

SEQ_LEN, SHARD_SEQUENCES, SEED, ROUNDS = 2048, 1 << 14, 20240229, 6
END, PAD = 256, 257


def feistel_slots(index: np.ndarray, n: int, seed: int = SEED, rounds: int = ROUNDS) -> np.ndarray:
    """The slots in [0, n) of the sequences with these numbers in [0, n)."""
    half = max(1, -(-max(1, (n - 1).bit_length()) // 2))
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    keys = mix(np.arange(1, rounds + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> shift, out[todo] & mask
        for k in keys:
            left, right = right, left ^ (mix(right + k) & mask)
        out[todo] = (left << shift) | right
        todo = todo[out[todo] >= np.uint64(n)]
    return out.astype(np.int64)


def sequence_count(tokens, seq_len: int):
    """Sequences of a text of that many tokens and one end mark."""
    return F.floor(tokens / F.lit(seq_len)) + 1


def _packed(width: int):
    """(key, ids) -> (key, the ids as little-endian bytes)."""

    def run(batches):
        for batch in batches:
            out = []
            for ids in batch.column(1):
                held = np.array(ids.values.to_numpy(zero_copy_only=False) if ids.is_valid else [], dtype=np.int64)
                if len(held) and (held.min() < 0 or held.max() >= 1 << 8 * width):
                    raise ValueError(f"a token id needs more than {width} bytes")
                out.append(held.astype(f"<u{width}").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["key", "ids"])

    return run


def _cutter(item: int, offsets: dict[int, tuple[int, int]], total: int, seq_len: int, per_shard: int, seed: int, schema: pa.Schema):
    def cut(batches):
        pid = TaskContext.get().partitionId()
        first, count = offsets.get(pid, (0, 0))
        done = 0
        for batch in batches:
            for row, value in zip(batch.column(0), batch.column(1), strict=True):
                ids = np.frombuffer(value.as_py() or b"", dtype=f"<u{item}")
                n = len(ids) // seq_len + 1
                for lo in range(0, n, 4096):
                    hi = min(n, lo + 4096)
                    if done + hi - lo > count:
                        raise RuntimeError(f"partition {pid} has more than the {count} sequences of the first pass")
                    slots = feistel_slots(np.arange(first + done, first + done + hi - lo), total, seed)
                    parts = [ids[j * seq_len : (j + 1) * seq_len].tobytes() for j in range(lo, hi)]
                    yield slots, row.as_py(), np.arange(lo, hi), parts, n
                    done += hi - lo
        if done != count:
            raise RuntimeError(f"partition {pid} has {done} sequences, {count} in the first pass")

    def gather(batches):
        held, size = [], 0
        for item in cut(batches):
            held.append(item)
            size += sum(map(len, item[3])) + 64 * len(item[3])
            if size > 4 << 20:
                yield flush(held)
                held, size = [], 0
        if held:
            yield flush(held)

    def flush(held):
        slots = np.concatenate([x[0] for x in held])
        return pa.RecordBatch.from_arrays([pa.array(slots // per_shard, pa.int32()), pa.array(slots), pa.array([x[1] for x in held for _ in x[3]], schema.field(2).type), pa.array(np.concatenate([x[2] for x in held])), pa.array([p for x in held for p in x[3]], pa.binary())], schema=schema)

    return gather


def _expand(seq_len: int, item: int, width: int, end: int, pad: int):
    def run(batches):
        for batch in batches:
            out = np.full((batch.num_rows, seq_len), pad, dtype=f"<u{width}")
            lens = np.empty(batch.num_rows, dtype=np.int32)
            for i, value in enumerate(batch.column(4)):
                ids = np.frombuffer(value.as_py(), dtype=f"<u{item}")
                out[i, : len(ids)] = ids
                lens[i] = len(ids)
                if len(ids) < seq_len:
                    out[i, len(ids)] = end
                    lens[i] += 1
            tokens = pa.Array.from_buffers(pa.large_binary(), batch.num_rows, [None, pa.py_buffer(np.arange(batch.num_rows + 1, dtype=np.int64) * width * seq_len), pa.py_buffer(out)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.array(lens), tokens], names=["shard", "slot", "key", "seq_no", "n_tokens", "tokens"])

    return run


def write_training_order(docs: DataFrame, key: str, text: str | None, path: str, ids: str | None = None, end: int = END, pad: int = PAD, width: int = 2, seq_len: int = SEQ_LEN, per_shard: int = SHARD_SEQUENCES, seed: int = SEED, stored: bool = False) -> int:
    """Write the shards of docs[ids] (or of the bytes of docs[text]) under path; returns the number of sequences."""
    if width not in (2, 4) or max(end, pad) >= 1 << 8 * width:
        raise ValueError("width must be 2 or 4 bytes and hold the end mark and the padding")
    ship_package(docs.sparkSession)
    item = 1 if ids is None else width
    if ids is None:
        rows = docs.select(F.col(key).cast("long").alias("key"), F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8").alias("ids"))
    else:
        rows = docs.select(F.col(key).cast("long").alias("key"), F.col(ids).cast("array<long>").alias("ids")).mapInArrow(_packed(width), "key long, ids binary")
    held = rows if stored and ids is None else materialise(rows, "order-rows")
    # both columns are read in either pass, so that both see the same partitions
    counted = held.groupBy(F.spark_partition_id().alias("p")).agg(F.sum(sequence_count(F.octet_length("ids") / item, seq_len)).alias("n"), F.max("key")).collect()
    counts = sorted((r.p, r.n) for r in counted)
    total, offsets = 0, {}
    for p, n in counts:
        offsets[p] = (total, n)
        total += n
    shards = max(1, -(-total // per_shard))
    made = pa.schema([("shard", pa.int32()), ("slot", pa.int64()), ("key", pa.int64()), ("seq_no", pa.int64()), ("ids", pa.binary())])
    cut = held.mapInArrow(_cutter(item, offsets, total, seq_len, per_shard, seed, made), "shard int, slot long, key long, seq_no long, ids binary")
    dealt = cut.repartitionById(shards, F.col("shard")).sortWithinPartitions("slot")
    wide = dealt.mapInArrow(_expand(seq_len, item, width, end, pad), "shard int, slot long, key long, seq_no long, n_tokens int, tokens binary")
    # the writer asks for rows by shard; naming the slot, too, keeps the order in a file
    wide.sortWithinPartitions("shard", "slot").write.option("compression", "zstd").partitionBy("shard").parquet(path)
    if held is not rows:
        forget(held)
    return total


def read_from(spark: SparkSession, path: str, slot: int = 0, per_shard: int = SHARD_SEQUENCES) -> DataFrame:
    """Sequences from a slot on: whole earlier shards are never opened."""
    return spark.read.schema("slot long, key long, seq_no long, n_tokens int, tokens binary, shard int").parquet(path).filter((F.col("shard") >= slot // per_shard) & (F.col("slot") >= slot))


def op9_training_order(spark, sf_dir) -> DataFrame:
    path = f"{shared_dir(spark)}/training-order-{uuid.uuid4().hex}"
    write_training_order(read_table(spark, sf_dir, "documents"), "doc_id", "text", path, stored=True)
    return read_from(spark, path).select("slot", F.col("shard").cast("long").alias("shard"), F.col("key").alias("doc_id"), "seq_no", F.col("n_tokens").cast("long").alias("n_tokens"), F.sha2("tokens", 256).alias("tokens_sha256"))
