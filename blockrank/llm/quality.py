"""Op 7: quality rules on whole texts and a calibrated classifier.

The base counts (words, characters of words, symbols, repeated lines, words in repeated 3-word windows)
are exact up to 64-bit hash equality inside one text. The verdict comes from a logistic regression on
hashed words and hashed runs of 4 bytes, each averaged over the text, trained in numpy on a bounded
sample (`per_label` texts of each label, a documented parameter) of the rows labelled with `quality`,
and calibrated by Platt's method on a quarter of that sample. A text is kept if no base rule fails and
its probability of good quality reaches the fixed threshold.

Defined results: null text has no words, so its base fails; an empty text likewise; a document labelled
more than once counts with its lowest label; null labels teach nothing; with no or only one label the
base rules alone decide; an empty table gives an empty result; repeated rows are judged alike.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship_package
from .classify import SAMPLE_TEXT_BYTES, bounded_sample, gram_buckets, inside_mask, range_sums
from .common import read_table
from .text_kernel import line_offsets, shingles, span_hashes, text_chunks, word_spans

BITS, GRAM, SCALE = 18, 4, 40.0
PER_LABEL, STEPS, RATE, DECAY = 1500, 60, 0.3, 1e-5
THRESHOLD, MIN_WORDS, MAX_REPEAT_PERCENT = 0.5, 50, 50
SYMBOL = np.zeros(256, dtype=bool)
SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


@dataclass
class QualityModel:
    words: np.ndarray
    grams: np.ndarray
    bias: float
    slope: float  # Platt's line
    shift: float


def _sums(mask: np.ndarray, offs: np.ndarray) -> np.ndarray:
    total = np.zeros(len(mask) + 1, dtype=np.int64)
    np.cumsum(mask, out=total[1:])
    return total[offs[1:]] - total[offs[:-1]]


def _repeats(keys: np.ndarray, group: np.ndarray) -> np.ndarray:
    """True where the key occurs at least twice in its group; and where it came before."""
    tagged = keys ^ (group.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(tagged, kind="stable")
    same = tagged[order][1:] == tagged[order][:-1]
    twice = np.zeros(len(keys), dtype=bool)
    again = np.zeros(len(keys), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    again[order[1:][same]] = True
    return twice, again


def base_counts(data: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    starts, ends, first = word_spans(data, offs)
    hashes = span_hashes(data, starts, ends)
    n_words = np.diff(first)
    inside = np.zeros(len(data) + 1, dtype=np.int8)
    inside[starts] = 1
    inside[ends] -= 1
    inside = np.cumsum(inside[:-1]).astype(bool) if len(data) else np.zeros(0, bool)
    lines, line_first = line_offsets(data, offs)
    stops = lines[1:].copy()
    feed = (stops > lines[:-1]) & (data[np.maximum(stops - 1, 0)] == 10 if len(data) else False)
    stops[feed] -= 1
    full = np.searchsorted(starts, lines[:-1]) < np.searchsorted(starts, lines[1:])
    of_line = np.repeat(np.arange(len(offs) - 1), np.diff(line_first))
    _, again = _repeats(span_hashes(data, lines[:-1][full], stops[full]), of_line[full])
    grams, begin = shingles(hashes, first, 3)
    twice, _ = _repeats(grams, np.repeat(np.arange(len(offs) - 1), np.diff(begin)))
    at = np.repeat(first[:-1] - begin[:-1], np.diff(begin))[twice] + np.flatnonzero(twice)
    covered = np.zeros(len(starts) + 2, dtype=bool)
    for j in range(3):
        covered[at + j] = True
    return {
        "hashes": hashes,
        "first": first,
        "n_words": n_words,
        "word_chars": _sums(inside & ((data & 0xC0) != 0x80), offs),
        "n_symbols": _sums(SYMBOL[data], offs),
        "n_dup_lines": np.bincount(of_line[full][again], minlength=len(offs) - 1),
        "n_repeat_words": _sums(covered[: len(starts)], first),
    }


def _word_buckets(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BITS)).astype(np.int64)


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def train(texts: pa.Table, seed: int = 7, steps: int = STEPS) -> QualityModel | None:
    """texts(text, quality) -> model; None unless both labels are there."""
    y = np.array(texts["quality"].to_pylist(), dtype=np.float64)
    if len(set(y)) < 2:
        return None
    idx, val, of, row = [], [], [], 0
    for batch in texts.select(["text"]).to_batches():
        for _, _, data, offs in text_chunks(batch, "text"):
            starts, ends, first = word_spans(data, offs)
            words = _word_buckets(span_hashes(data, starts, ends))
            grams = gram_buckets(data, GRAM, BITS).astype(np.int64) + (1 << BITS)
            ok = inside_mask(offs, GRAM, len(grams))
            for i in range(len(offs) - 1):
                for got in (words[first[i] : first[i + 1]], grams[offs[i] : offs[i + 1]][ok[offs[i] : offs[i + 1]]]):
                    u, c = np.unique(got, return_counts=True)
                    idx.append(u)
                    val.append((SCALE * c / max(1, len(got))).astype(np.float32))
                    of.append(np.full(len(u), row, dtype=np.int32))
                row += 1
    idx, val, of = np.concatenate(idx), np.concatenate(val), np.concatenate(of)
    rng = np.random.default_rng(seed)
    held = rng.random(row) < 0.25
    if len(set(y[held])) < 2 or len(set(y[~held])) < 2:
        held = np.zeros(row, dtype=bool)
    weight = np.where(held, 0.0, np.where(y > 0.5, 0.5 / max(1, (y[~held] > 0.5).sum()), 0.5 / max(1, (y[~held] <= 0.5).sum())))
    w, bias = np.zeros(2 << BITS), 0.0
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        z = np.bincount(of, weights=w[idx] * val, minlength=row) + bias
        g = (_sigmoid(z) - y) * weight
        slope = np.bincount(idx, weights=g[of] * val, minlength=len(w)) + DECAY * w
        m = 0.9 * m + 0.1 * slope
        v = 0.99 * v + 0.01 * slope**2
        w -= RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        bias -= RATE * g.sum()
    z = np.bincount(of, weights=w[idx] * val, minlength=row) + bias
    use = held if held.any() else np.ones(row, dtype=bool)
    good, bad = (y[use] > 0.5).sum(), (y[use] <= 0.5).sum()
    target = np.where(y[use] > 0.5, (good + 1) / (good + 2), 1 / (bad + 2))
    a, b = 1.0, 0.0
    for _ in range(100):
        p = _sigmoid(a * z[use] + b)
        grad = np.array([((p - target) * z[use]).sum(), (p - target).sum()])
        s = np.maximum(p * (1 - p), 1e-9)
        hess = np.array([[(s * z[use] ** 2).sum() + 1e-6, (s * z[use]).sum()], [(s * z[use]).sum(), s.sum() + 1e-6]])
        move = np.linalg.solve(hess, grad)
        move *= min(1.0, 2.0 / max(1e-9, np.abs(move).max()))
        a, b = max(1e-3, a - move[0]), b - move[1]
        if np.abs(move).max() < 1e-6:
            break
    return QualityModel(w[: 1 << BITS].astype(np.float32), w[1 << BITS :].astype(np.float32), float(bias), float(a), float(b))


def predict_chunk(model: QualityModel, hashes, first, data, offs) -> np.ndarray:
    words = range_sums(model.words[_word_buckets(hashes)], first[:-1], first[1:]) / np.maximum(np.diff(first), 1)
    b = gram_buckets(data, GRAM, BITS)
    values = model.grams[b]
    values[~inside_mask(offs, GRAM, len(b))] = 0
    grams = range_sums(values, np.minimum(offs[:-1], len(b)), np.minimum(offs[1:], len(b))) / np.maximum(np.diff(offs) - GRAM + 1, 1)
    return _sigmoid(model.slope * (SCALE * (words + grams) + model.bias) + model.shift)


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judge(docs: DataFrame, model: QualityModel | None, threshold: float = THRESHOLD) -> DataFrame:
    """docs(doc_id, text) -> doc_id, the base counts, base_failed, kept, quality (null without a model)."""
    ship_package(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = held.value
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("doc_id"))
            for lo, hi, data, offs in text_chunks(batch, "text"):
                c = base_counts(data, offs)
                failed = (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > MAX_REPEAT_PERCENT * c["n_words"])
                p = predict_chunk(m, c["hashes"], c["first"], data, offs) if m else np.full(hi - lo, np.nan)
                kept = ~failed & ((p >= threshold) if m else True)
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), *(pa.array(c[k].astype(np.int64)) for k in COUNTS), pa.array(failed), pa.array(kept), pa.array(p, from_pandas=True)], names=["doc_id", *COUNTS, "base_failed", "kept", "quality"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {', '.join(f'{k} long' for k in COUNTS)}, base_failed boolean, kept boolean, quality double")


def fit(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> QualityModel | None:
    """Choose the labelled ids first, then fetch only their texts: one for each id (the least, where rows share an id),
    of at most SAMPLE_TEXT_BYTES."""
    once = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    ids = bounded_sample(once, "doc_id", "quality", per_label)
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    wanted = spark.createDataFrame([(i, int(q)) for i, q in zip(ids["doc_id"].to_pylist(), ids["quality"].to_pylist(), strict=True)], f"doc_id {kind}, quality int")
    known = docs.select("doc_id", "text").filter(F.octet_length("text") <= SAMPLE_TEXT_BYTES).join(F.broadcast(wanted), "doc_id")
    texts = known.groupBy("doc_id", "quality").agg(F.min("text").alias("text")).select("doc_id", "text", "quality").toArrow()
    return train(texts.sort_by([("doc_id", "ascending")]))


def op7_quality(spark, sf_dir) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return judge(docs, fit(docs, read_table(spark, sf_dir, "labels")))
