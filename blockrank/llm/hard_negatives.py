"""Op 13: hard negatives by product quantisation with rigorous bounds.

Vectors become integers and are cut into pairs of components; each pair is written as one of at most CODES
codewords (integers, fitted on a bounded sample), and the length of what the codewords leave of a vector, its
residual, is stored with the codes. The inner product with an anchor is the sum of table entries, one for each
code, plus the anchor's product with the residual, which is at most the product of both lengths. So a lookup score
plus (minus) that bound is never below (above) the exact score: rows whose bounds cannot enter an anchor's best
rows, or its window, are left out, and all others get their exact integer score. No result depends on the
codewords or on partitions.

The stored index is swept twice: first for each anchor's nearest rows of its own label, then for the rows of other
labels in the window that each of these positives gives. A task keeps the best rows of each anchor over all its
batches, so what it returns does not grow with its input. Anchors are sent to all tasks while they are at
most BROADCAST_BYTES, else cells of rows and of anchors meet.

Defined results: rows with a null label, a null vector or a null, NaN or infinite component take no part. A vector
shorter than the longest one counts as filled up with zeros. Rows that repeat or share a vec_id are rows of
their own (any of them is one of the others' "other rows"); a null vec_id is no anchor and is last among equal
scores; after vec_id, ties go by the row's place in the index. Anchors without a positive, and positives without
a row in their window (a negative positive_score has none), give no rows. An empty table gives an empty
result. Components beyond +-2**22 after scaling are cut to that, so that scores fit a long up to 2**19 components;
labels are whole numbers; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .centroids import SCALE, finite
from .common import least_by_hash, materialise, read_table

ANCHOR_EVERY, LABEL_EVERY, LABELS = 50, 7, 10
POSITIVES, NEGATIVES, LOW, HIGH = 5, 3, 50, 95
PART, CODES, SAMPLE, TURNS = 2, 256, 8192, 8
LARGEST = 1 << 22
BROADCAST_BYTES = 32 << 20
#: Anchors whose scores are held at a time, and the sizes of cells beyond the broadcast.
ANCHOR_BLOCK, ROW_CELL, ANCHOR_CELL = 64, 16384, 4096
NO_ID = np.iinfo(np.int64).max


def codewords(sample: np.ndarray) -> list[np.ndarray]:
    """For each PART components the codewords, as integers: k-means of the sample's distinct values."""
    books = []
    rng = np.random.default_rng(SCALE)
    for lo in range(0, sample.shape[1], PART):
        values, times = np.unique(sample[:, lo : lo + PART], axis=0, return_counts=True)
        words = values[rng.permutation(len(values))[:CODES]].astype(np.float64)
        for _ in range(TURNS):
            near = _code(values, words)
            n = np.bincount(near, weights=times, minlength=len(words))
            sums = np.stack([np.bincount(near, weights=times * values[:, j], minlength=len(words)) for j in range(values.shape[1])], axis=1)
            words = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], words)
        books.append(np.rint(words))
    return books


def _code(values: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The nearest codeword of each row."""
    out = np.empty(len(values), dtype=np.uint8)
    for lo in range(0, len(values), 4096):
        v = values[lo : lo + 4096].astype(np.float64)
        out[lo : lo + 4096] = np.argmin((words * words).sum(axis=1)[None, :] - 2 * (v @ words.T), axis=1)
    return out


def encode(values: np.ndarray, books: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Codes (rows x parts) and the residuals' lengths, rounded up."""
    codes = np.stack([_code(values[:, PART * m : PART * m + PART], b) for m, b in enumerate(books)], axis=1) if books else np.zeros((len(values), 0), np.uint8)
    left = np.zeros(len(values))
    for m, b in enumerate(books):
        d = values[:, PART * m : PART * m + PART] - b[codes[:, m]]
        left += (d * d).sum(axis=1)
    return codes, np.sqrt(left) * (1 + 1e-9)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if len(flat) == len(column) * dims:
        return flat.reshape(-1, dims)
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), dims), dtype=np.int64)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[np.repeat(np.arange(len(column)), sizes), at] = flat
    return out


def _encoding(held, dims: int):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                values = _matrix(batch.column(batch.schema.get_field_index("q")), dims)
                codes, left = encode(values, held.value)
                packed = pa.Array.from_buffers(pa.binary(), len(codes), [None, pa.py_buffer((np.arange(len(codes) + 1) * codes.shape[1]).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(codes))])
                q = pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * dims), pa.array(values.astype(np.int32).ravel()))
                yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in ("id", "label")), q, packed, pa.array(left)], names=["id", "label", "q", "codes", "left"])

    return run


class Rows:
    """A batch of the stored index as arrays."""

    def __init__(self, table, dims: int, parts: int):
        def take(name):
            column = table.column(name)
            return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column

        self.row, self.label = take("row").to_numpy(), take("label").to_numpy()
        self.id = take("id").fill_null(NO_ID).to_numpy()
        self.q = _matrix(take("q"), dims)
        codes = take("codes")
        self.codes = np.frombuffer(codes.buffers()[2], dtype=np.uint8)[codes.offset * parts : (codes.offset + len(codes)) * parts].reshape(len(codes), parts).T if len(codes) and parts else np.zeros((parts, len(codes)), np.uint8)
        self.left = take("left").to_numpy()
        self.longest = float(np.sqrt((self.q.astype(np.float64) ** 2).sum(axis=1)).max(initial=0))


class Anchors:
    """Anchors in the order of their labels; least and most, if there, are the windows of each anchor's positives."""

    def __init__(self, table, dims: int, books: list[np.ndarray]):
        table = table.sort_by([("label", "ascending"), ("row", "ascending")])
        self.row, self.label = table["row"].to_numpy(), table["label"].to_numpy()
        self.q = _matrix(table["q"].combine_chunks(), dims) if table.num_rows else np.zeros((0, dims), np.int64)
        # a millionth of a millionth of both lengths covers what floats round away
        self.length = np.sqrt((self.q.astype(np.float64) ** 2).sum(axis=1)) * (1 + 1e-9)
        self.books = books
        spans = [table[c].combine_chunks().to_pylist() for c in ("least", "most")] if "least" in table.column_names else []
        slots = max((len(x) for x in spans[0]), default=0) if spans else 0
        fill = lambda rows, none: np.array([[*r, *[none] * (slots - len(r))] for r in rows], dtype=np.float64).reshape(len(rows), slots)
        self.least, self.most = (fill(spans[0], np.inf), fill(spans[1], -np.inf)) if spans else (None, None)

    def blocks(self):
        """Slices of at most ANCHOR_BLOCK anchors of one label."""
        for label in np.unique(self.label):
            lo, hi = np.searchsorted(self.label, [label, label + 1])
            for at in range(lo, hi, ANCHOR_BLOCK):
                yield label, np.arange(at, min(hi, at + ANCHOR_BLOCK))

    def bounds(self, which: np.ndarray, rows: Rows, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest possible scores of these anchors with these rows, from the tables alone."""
        score = np.zeros((len(which), len(of)))
        for m, book in enumerate(self.books):
            table = self.q[which, PART * m : PART * m + PART].astype(np.float64) @ book.T
            score += table[:, rows.codes[m, of]]
        slack = self.length[which][:, None] * (rows.left[of][None, :] + 1e-12 * rows.longest)
        return score - slack, score + slack


def _exact(anchors: Anchors, a: np.ndarray, rows: Rows, r: np.ndarray) -> np.ndarray:
    out = np.empty(len(a), dtype=np.int64)
    for lo in range(0, len(a), 1 << 16):
        s = slice(lo, lo + (1 << 16))
        out[s] = np.einsum("ij,ij->i", anchors.q[a[s]], rows.q[r[s]])
    return out


def _kth(values: np.ndarray, k: int) -> np.ndarray:
    """The k-th greatest of each row, or less than anything where there are fewer."""
    if values.shape[1] < k:
        return np.full(len(values), -np.inf)
    return np.partition(values, values.shape[1] - k, axis=1)[:, values.shape[1] - k]


class Best:
    """The k best (score, id, row) of each slot, over all batches of a task."""

    def __init__(self, slots: int, k: int):
        self.k, self.slots = k, slots
        self.kept = [np.zeros(0, dtype=np.int64) for _ in range(4)]
        self.floor = np.full(slots, -np.inf)

    def add(self, met: list[tuple]) -> None:
        """met: arrays of slot, score, id and row, each."""
        slot, score, ids, row = (np.concatenate(x) for x in zip(self.kept, *met, strict=True))
        order = np.lexsort((row, ids, -score, slot))
        slot = slot[order]
        nth = np.arange(len(slot)) - np.searchsorted(slot, slot, side="left")
        keep = nth < self.k
        self.kept = [slot[keep], *(x[order][keep] for x in (score, ids, row))]
        full = nth[keep] == self.k - 1
        self.floor[self.kept[0][full]] = self.kept[1][full]


def positives_in(anchors: Anchors, rows: Rows, best: Best) -> None:
    """Add the rows that may be among the best of the anchors' own label."""
    met = []
    for label, which in anchors.blocks():
        of = np.flatnonzero(rows.label == label)
        if not len(of):
            continue
        low, high = anchors.bounds(which, rows, of)
        own = anchors.row[which][:, None] == rows.row[of][None, :]
        low[own], high[own] = -np.inf, -np.inf
        a, r = np.nonzero((high >= np.maximum(_kth(low, best.k), best.floor[which])[:, None]) & ~own)
        a, r = which[a], of[r]
        met.append((a, _exact(anchors, a, rows, r), rows.id[r], rows.row[r]))
    best.add(met)


def negatives_in(anchors: Anchors, rows: Rows, best: Best) -> None:
    """Add the rows of other labels that may be among the best of a positive's window. A slot is anchor x positives + place."""
    n, met = anchors.least.shape[1], []
    for label, which in anchors.blocks():
        of = np.flatnonzero(rows.label != label)
        if not len(of) or not n:
            continue
        low, high = anchors.bounds(which, rows, of)
        maybe = np.zeros(low.shape, dtype=bool)
        for p in range(n):
            least, most = anchors.least[which, p][:, None], anchors.most[which, p][:, None]
            sure = np.where((low >= least) & (high <= most), low, -np.inf)
            floor = np.maximum(np.maximum(_kth(sure, best.k), best.floor[which * n + p])[:, None], least)
            maybe |= (high >= floor) & (low <= most)
        a, r = np.nonzero(maybe)
        a, r = which[a], of[r]
        score = _exact(anchors, a, rows, r)
        for p in range(n):
            slot = a * n + p
            ok = (score >= anchors.least[a, p]) & (score <= anchors.most[a, p]) & (score >= best.floor[slot])
            met.append((slot[ok], score[ok], rows.id[r[ok]], rows.row[r[ok]]))
    best.add(met)


FOUND = pa.schema([("anchor", pa.int64()), ("place", pa.int32()), ("score", pa.int64()), ("id", pa.int64()), ("row", pa.int64())])


def _found(anchors: Anchors, best: Best, places: int) -> pa.Table:
    slot, score, ids, row = best.kept
    return pa.table({"anchor": anchors.row[slot // places], "place": (slot % places).astype(np.int32), "score": score, "id": pa.array(ids, mask=ids == NO_ID), "row": row}, schema=FOUND)


def _sweep(index: DataFrame, asked: DataFrame, books: list[np.ndarray], dims: int, k: int, step) -> DataFrame:
    """(anchor, place, score, id, row): for each anchor (and place of its windows) the k best rows of each task or cell."""
    spark = index.sparkSession

    def start(table: pa.Table):
        anchors = Anchors(table, dims, books)
        places = 1 if anchors.least is None else anchors.least.shape[1]
        return anchors, Best(len(anchors.row) * max(1, places), k), max(1, places)

    schema = "anchor long, place int, score long, id long, row long"
    n_asked = asked.count()
    if n_asked * dims * 8 <= BROADCAST_BYTES:
        held = spark.sparkContext.broadcast(asked.toArrow())

        def run(batches):
            anchors, best, places = start(held.value)
            for batch in batches:
                if batch.num_rows and len(anchors.row):
                    step(anchors, Rows(batch, dims, len(books)), best)
            yield from _found(anchors, best, places).to_batches()

        return index.mapInArrow(run, schema)
    n_rows = index.count()
    cells, groups = max(1, -(-n_rows // ROW_CELL)), max(1, -(-n_asked // ANCHOR_CELL))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = index.withColumn("cell", F.pmod(F.xxhash64("row"), F.lit(cells)).cast("int")).withColumn("part", every(groups))
    each = asked.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(groups)).cast("int")).withColumn("cell", every(cells))

    def meet(rows: pa.Table, table: pa.Table) -> pa.Table:
        if not rows.num_rows or not table.num_rows:
            return FOUND.empty_table()
        anchors, best, places = start(table)
        step(anchors, Rows(rows, dims, len(books)), best)
        return _found(anchors, best, places)

    return own.groupBy("cell", "part").cogroup(each.groupBy("cell", "part")).applyInArrow(meet, schema)


def build_index(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", label: str = "label") -> tuple[DataFrame, list[np.ndarray], int]:
    """The stored index (row, id, label, q, codes, left), its codewords and the number of components."""
    spark = vectors.sparkSession
    named = vectors.select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(column).alias("v")).filter(F.col("label").isNotNull() & finite(F.col("v")))
    scaled = F.transform("v", lambda x: F.floor(F.greatest(F.least(x.cast("double") * SCALE, F.lit(float(LARGEST))), F.lit(-float(LARGEST)))).cast("int"))
    moved = F.when(F.col("id") % LABEL_EVERY == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label"))
    rows = named.select("id", moved.alias("label"), scaled.alias("q"))
    dims = rows.agg(F.coalesce(F.max(F.size("q")), F.lit(0))).first()[0]
    picked = least_by_hash(rows.select("q"), SAMPLE, "q").toArrow()  # SAMPLE rows; codewords change speed only
    books = codewords(_matrix(picked["q"].combine_chunks(), dims)) if picked.num_rows else []
    coded = rows.mapInArrow(_encoding(spark.sparkContext.broadcast(books), dims), "id long, label long, q array<int>, codes binary, left double")
    return materialise(coded.withColumn("row", F.monotonically_increasing_id()), "negatives-index"), books, dims


def hard_negatives(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", label: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    index, books, dims = build_index(vectors, key, column, label)
    anchors = materialise(index.filter(F.col("id") % ANCHOR_EVERY == 0).select("row", "id", "label", "q"), "negatives-anchors")
    asked = anchors.drop("id")
    last = lambda *per: W.partitionBy(*per).orderBy(F.desc("score"), F.col("id").asc_nulls_last(), "row")
    near = _sweep(index, asked, books, dims, POSITIVES, positives_in)
    chosen = near.withColumn("nth", F.row_number().over(last("anchor"))).filter(F.col("nth") <= POSITIVES)
    least, most = F.call_function("div", F.col("score") * LOW + 99, F.lit(100)), F.call_function("div", F.col("score") * HIGH, F.lit(100))
    positives = materialise(chosen.filter("score >= 0").select("anchor", (F.col("nth") - 1).alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), least.alias("least"), most.alias("most")), "negatives-positives")
    # at most POSITIVES windows for each anchor; as scores fall with the place, places run from 0 without a gap
    spans = positives.groupBy(F.col("anchor").alias("row")).agg(F.array_sort(F.collect_list(F.struct("place", "least", "most"))).alias("w")).select("row", F.col("w.least").alias("least"), F.col("w.most").alias("most"))
    windows = materialise(asked.join(spans, "row"), "negatives-windows")
    far = _sweep(index, windows, books, dims, NEGATIVES, negatives_in)
    ranked = far.withColumn("rank", F.row_number().over(last("anchor", "place"))).filter(F.col("rank") <= NEGATIVES)
    ids = anchors.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"))
    out = ranked.select("anchor", "place", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")).join(positives, ["anchor", "place"]).join(ids, "anchor")
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def op13_hard_negatives(spark, sf_dir) -> DataFrame:
    return hard_negatives(read_table(spark, sf_dir, "embeddings"))


SQL = f"""
WITH r AS (SELECT vec_id, CASE WHEN vec_id % {LABEL_EVERY} = 0 THEN (label + 1) % {LABELS} ELSE label END AS label, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score FROM r a JOIN r b ON a.vec_id % {ANCHOR_EVERY} = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= {POSITIVES}),
n AS (SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id) AS INTEGER) AS rank, other_id AS negative_id, positive_score, score AS negative_score
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND {LOW} * positive_score <= 100 * score AND 100 * score <= {HIGH} * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= {NEGATIVES}"""
