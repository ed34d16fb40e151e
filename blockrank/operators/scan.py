"""BM25 over the words of texts as they are read: no posting is written anywhere.

Queries are few numbers each (hashes of their terms), texts are many: the queries go to every task, and a task reads its
texts once, in slices. Of a slice it has the lists of the asked terms, adds up each query's scores, and keeps the best k
texts of a query among all that it has read. So what leaves a task is k rows of a query at most, however many
texts have its terms; the work is that of the hits, and nothing grows with them."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import ship_package

#: Words of the texts that are looked at together, and texts whose words one task holds at most (about).
SLICE_WORDS, TASK_TEXTS = 1_000_000, 65_536
#: Of one pass over the texts: tokens of its queries, and places in their lists of best texts.
PASS_TOKENS, PASS_PLACES = 4_000_000, 3_000_000
#: Rows that leave a pass; with more, fewer tasks read more texts each.
PASS_ROWS = 8_000_000
_TF_BITS = 24


@dataclass
class Terms:
    """Which terms are looked for: term i < parts is the word whose hash stands for it, the others are phrases of such."""

    hashes: np.ndarray  # sorted; of words
    part: np.ndarray  # the part that a word stands for
    parts: int
    phrases: list[np.ndarray]  # the parts of term parts + i


@dataclass
class Queries:
    starts: np.ndarray  # of each query's terms in `terms`
    terms: np.ndarray  # a term that a query has twice counts twice
    idf: np.ndarray  # by term
    token_starts: np.ndarray | None = None  # of each query's tokens (parts) in `tokens`, for what is covered
    tokens: np.ndarray | None = None
    weight: np.ndarray | None = None  # by part


def _distinct(terms: Terms, words: np.ndarray, ends: np.ndarray, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc, term, tf of a slice's texts, by doc, then term; ends: where each text's words end. wanted: the parts that count."""
    n = len(ends)
    at = np.searchsorted(terms.hashes, words)
    at[at == len(terms.hashes)] = 0
    place = np.flatnonzero(terms.hashes[at] == words) if len(terms.hashes) else np.zeros(0, np.int64)
    part, doc, total = terms.part[at[place]], np.repeat(np.arange(n), np.diff(ends, prepend=0))[place], terms.parts + len(terms.phrases)
    del at
    keys = [doc * total + part if wanted is None else (doc * total + part)[wanted[part]]]
    if terms.phrases:
        # places with a gap between texts; a phrase begins where all of its parts follow each other
        place = place + doc
        order = np.argsort(part, kind="stable")
        upto = np.concatenate([[0], np.cumsum(np.bincount(part, minlength=terms.parts))])
        of = lambda p: order[upto[p] : upto[p + 1]]
        for i, phrase in enumerate(terms.phrases):
            own = of(phrase[0])
            for k, p in enumerate(phrase[1:], 1):
                own = own[np.isin(place[own] + k, place[of(p)], assume_unique=True)] if len(own) else own
            keys.append(doc[own] * total + terms.parts + i)
    key = np.concatenate(keys) if len(keys) > 1 else keys[0]
    del keys, part, doc, place
    key.sort()
    first = np.flatnonzero(np.diff(key, prepend=-1))
    tf = np.diff(first, append=len(key))
    return key[first] // total, key[first] % total, tf


def _slices(batch: pa.RecordBatch):
    """(first row, rows, words, ends of each text's words) of about SLICE_WORDS words each."""
    column = batch.column(batch.schema.get_field_index("words"))
    offsets = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False)
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + SLICE_WORDS, side="right")) - 1)
        hi = min(hi, batch.num_rows)
        yield lo, hi - lo, flat[offsets[lo] : offsets[hi]], (offsets[lo + 1 : hi + 1] - offsets[lo]).astype(np.int64)
        lo = hi


def _top(score: np.ndarray, row: np.ndarray, uid: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best; of equal scores the least ids."""
    if len(score) <= k:
        return np.arange(len(score))
    kth = np.partition(score, len(score) - k)[len(score) - k]
    above, equal = np.flatnonzero(score > kth), np.flatnonzero(score == kth)
    need = k - len(above)
    if len(equal) > need:
        equal = equal[np.argsort(uid[row[equal]], kind="stable")[:need]]
    return np.concatenate([above, equal])


def _counting(held):
    def run(batches):
        terms = held.value
        df = np.zeros(terms.parts + len(terms.phrases), np.int64)
        for batch in batches:
            for _, _, words, ends in _slices(batch):
                df += np.bincount(_distinct(terms, words, ends)[1], minlength=len(df))
        had = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(had), pa.array(df[had])], names=["id", "df"])

    return run


def _covered(asked: Queries, q: int, rows: np.ndarray, starts: np.ndarray, ids: np.ndarray, mark: np.ndarray) -> np.ndarray:
    """The weight of a query's tokens in each of these texts."""
    own = asked.tokens[asked.token_starts[q] : asked.token_starts[q + 1]]
    mark[own] = asked.weight[own]
    rows = rows.astype(np.int64)
    size = starts[rows + 1] - starts[rows]
    at = np.arange(size.sum()) + np.repeat(starts[rows] - np.concatenate([[0], np.cumsum(size)[:-1]]), size)
    out = np.bincount(np.repeat(np.arange(len(rows)), size), mark[ids[at]], len(rows))
    mark[own] = 0
    return np.round(out, 10)


def _scoring(held, k: int, k1: float, b: float, avgdl: float, out: pa.Schema):
    def run(batches):
        terms, asked, query_ids = held.value
        n_queries, total = len(asked.starts) - 1, terms.parts + len(terms.phrases)
        scored = np.zeros(total, bool)
        scored[asked.terms] = True
        cover = asked.tokens is not None
        best: list = [None] * n_queries
        low = np.full(n_queries, np.finfo(float).tiny)
        uids, notes, base, uid = [], [], 0, None
        kept_ids, kept_sizes = [], []
        for batch in batches:
            names = batch.schema.get_field_index
            uids.append(batch.column(names("block_uid")))
            notes.append(batch.column(names("note_path")))
            fresh = uids[-1].to_numpy(zero_copy_only=False)
            fresh = fresh if fresh.dtype.kind in "iu" else fresh.astype(str)
            uid = fresh if uid is None else np.concatenate([uid, fresh])
            lengths = batch.column(names("dl")).to_numpy(zero_copy_only=False).astype(np.float64)
            for first, n, words, ends in _slices(batch):
                doc, term, tf = _distinct(terms, words, ends, None if cover else scored[: terms.parts])
                if cover:
                    kept_ids.append(term.astype(np.int32))
                    kept_sizes.append(np.bincount(doc, minlength=n))
                counts = scored[term]
                # by term, then text
                packed = (term[counts] * n + doc[counts]) << _TF_BITS | tf[counts]
                packed.sort()
                tf, cell = (packed & ((1 << _TF_BITS) - 1)).astype(np.float64), packed >> _TF_BITS
                term, doc = cell // n, cell % n
                del packed, cell, counts
                upto = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=total))])
                dl = lengths[first : first + n][doc]
                part = asked.idf[term] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))
                del term, tf, dl
                begin, end = upto[asked.terms].tolist(), upto[asked.terms + 1].tolist()
                for q in range(n_queries):
                    lists = [(begin[t], end[t]) for t in range(asked.starts[q], asked.starts[q + 1]) if begin[t] < end[t]]
                    if not lists:
                        continue
                    sums = np.bincount(np.concatenate([doc[i:j] for i, j in lists]), np.concatenate([part[i:j] for i, j in lists]), n)
                    found = np.flatnonzero(sums >= low[q])
                    if not len(found):
                        continue
                    score, row = np.round(sums[found], 10), (found + (base + first)).astype(np.int32)
                    if best[q] is not None:
                        score, row = np.concatenate([best[q][0], score]), np.concatenate([best[q][1], row])
                    keep = _top(score, row, uid, k)
                    best[q] = score[keep], row[keep]
                    if len(keep) == k:
                        low[q] = max(low[q], best[q][0].min() - 1e-10)  # sums are not rounded
            base += batch.num_rows
            pa.default_memory_pool().release_unused()
        if not base:
            return
        if cover:
            ids, starts = np.concatenate(kept_ids), np.concatenate([[0], np.cumsum(np.concatenate(kept_sizes))])
            kept_ids.clear()
            mark = np.zeros(total)
        uids, notes = pa.chunked_array(uids).combine_chunks(), pa.chunked_array(notes).combine_chunks()
        ready, size = [], 0
        for q in range(n_queries + 1):
            if q < n_queries and best[q] is not None:
                ready.append((q, *best[q], _covered(asked, q, best[q][1], starts, ids, mark) if cover else np.zeros(len(best[q][0]))))
                size, best[q] = size + len(ready[-1][1]), None
            if ready and (size > 65_536 or q == n_queries):
                at = np.repeat([x[0] for x in ready], [len(x[1]) for x in ready])
                row = np.concatenate([x[2] for x in ready])
                columns = [query_ids.take(pa.array(at)), uids.take(pa.array(row)), notes.take(pa.array(row)), pa.array(np.concatenate([x[1] for x in ready])), pa.array(np.concatenate([x[3] for x in ready]))]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, out, strict=True)], schema=out)
                ready, size = [], 0

    return run


def _hashed(words: DataFrame) -> DataFrame:
    return words.select("block_uid", "note_path", "dl", F.transform("words", lambda w: F.xxhash64(w)).alias("words"))


def counts(words: DataFrame, terms: Terms) -> np.ndarray:
    """In how many texts each term is."""
    spark = words.sparkSession
    ship_package(spark)
    held = spark.sparkContext.broadcast(terms)
    rows = _hashed(words).select("words").mapInArrow(_counting(held), "id long, df long").groupBy("id").agg(F.sum("df").alias("df")).toArrow()
    df = np.zeros(terms.parts + len(terms.phrases), np.int64)
    df[rows["id"].to_numpy()] = rows["df"].to_numpy()
    return df


def best(words: DataFrame, terms: Terms, asked: Queries, query_ids: pa.Array, qid: T.DataType, n_docs: int, avgdl: float, k: int, k1: float, b: float) -> DataFrame:
    """words(block_uid, note_path, dl, words) -> query_id, block_uid, note_path, bm25, covered: at least each query's k best
    texts that have one of its terms, k of each task at most. covered is 0 where asked has no tokens."""
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = words.sparkSession
    ship_package(spark)
    schema = T.StructType([T.StructField("query_id", qid), T.StructField("block_uid", words.schema["block_uid"].dataType), T.StructField("note_path", T.StringType()), T.StructField("bm25", T.DoubleType()), T.StructField("covered", T.DoubleType())])
    held = spark.sparkContext.broadcast((terms, asked, query_ids))
    tasks = max(2 * spark.sparkContext.defaultParallelism, -(-n_docs // TASK_TEXTS), PASS_ROWS // max(1, len(query_ids) * k))
    return _hashed(words).coalesce(tasks).mapInArrow(_scoring(held, k, k1, b, avgdl, to_arrow_schema(schema)), schema)
