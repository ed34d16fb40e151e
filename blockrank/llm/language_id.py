"""Op 4: language identification by averaged hashed subword embeddings and a linear softmax.

A text is lower-cased (A-Z); every run of 2, 3 and 4 bytes of it is hashed to one of 2**16 embeddings, and
their mean goes through a linear layer and a softmax. Embeddings and layer are trained together by
stochastic gradient descent in numpy on a bounded sample (`per_lang` texts of each language, a documented
parameter) of the rows given for learning. Each fifth of the sample is scored by a model of the other four
(the last of these models serves), and the scores of all fifths fit the softmax's temperature and the rejection
threshold: the greatest score under which no more than `reject_rate` of the rightly labelled texts fall, at
every size (of fewer than one in `reject_rate` texts, their least score). For prediction the two layers are multiplied out, so a text's score is
a mean of rows of one small table.

Defined results: a null text, or one without a letter, is `und` with score 0 and is rejected; a text with
fewer than two bytes gets the bias alone; rows with a null label teach nothing; with nothing to learn
every text is `und`; repeated rows are judged alike; an empty table gives an empty result; other columns
pass through in `identify` (new columns replace equal names).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import ship_package
from .classify import bounded_sample, gram_buckets, inside_mask, range_sums
from .common import crc_mod, pipeline_stage, read_table
from .text_kernel import LOWER, text_chunks

BITS, DIM, GRAMS = 16, 16, (2, 3, 4)
PER_LANG, EPOCHS, MIN_STEPS, BATCH, RATE, REJECT_RATE, FOLDS = 600, 8, 240, 32, 4.0, 0.001, 5
#: Texts of so many bytes are predicted at once.
PREDICT_BYTES = 1 << 20
#: Gram values that are summed at once.
PIECE_VALUES = 1 << 20
LETTER = np.zeros(256, dtype=bool)
LETTER[65:91] = LETTER[97:123] = True


@dataclass
class LanguageModel:
    langs: list[str]
    table: np.ndarray  # buckets x langs
    bias: np.ndarray
    temperature: float
    threshold: float


def features(data: np.ndarray, offs: np.ndarray):
    """(buckets, text of each) over all grams of a chunk."""
    low = LOWER[data]
    for n in GRAMS:
        b = gram_buckets(low, n, BITS)
        yield n, b, inside_mask(offs, n, len(b))


def _rows(texts: pa.Table):
    """Per text its distinct buckets and their shares."""
    out = []
    for batch in texts.select(["text"]).to_batches():
        for _, _, data, offs in text_chunks(batch, "text"):
            each: list[list[np.ndarray]] = [[] for _ in range(len(offs) - 1)]
            for _, b, ok in features(data, offs):
                for i, (lo, hi) in enumerate(zip(offs[:-1], offs[1:], strict=True)):
                    each[i].append(b[lo:hi][ok[lo:hi]])
            for parts in each:
                all_ = np.concatenate(parts)
                u, c = np.unique(all_, return_counts=True)
                out.append((u.astype(np.int64), (c / max(1, len(all_))).astype(np.float32)))
    return out


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _descend(rows, y: np.ndarray, learn: np.ndarray, n: int, seed: int, epochs: int) -> tuple[np.ndarray, np.ndarray]:
    """Table (buckets x langs) and bias after descent over the rows `learn`."""
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 0.1, (1 << BITS, DIM)).astype(np.float32)
    layer = rng.normal(0, 0.1, (DIM, n)).astype(np.float32)
    bias = np.zeros(n, dtype=np.float32)
    # a small sample is passed over more often
    epochs = max(epochs, -(-MIN_STEPS // max(1, -(-len(learn) // BATCH))))
    steps = max(1, epochs * -(-len(learn) // BATCH))
    done = 0
    for _ in range(epochs):
        order = rng.permutation(learn)
        for lo in range(0, len(order), BATCH):
            ids = order[lo : lo + BATCH]
            rate = RATE * (1 - done / steps)
            done += 1
            idx = np.concatenate([rows[i][0] for i in ids])
            w = np.concatenate([rows[i][1] for i in ids])
            sizes = np.array([len(rows[i][0]) for i in ids])
            of = np.repeat(np.arange(len(ids)), sizes)
            mean = range_sums(emb[idx] * w[:, None], np.cumsum(sizes) - sizes, np.cumsum(sizes)).astype(np.float32)
            slope = _softmax(mean @ layer + bias).astype(np.float32)
            slope[np.arange(len(ids)), y[ids]] -= 1
            back = slope @ layer.T
            layer -= rate / len(ids) * (mean.T @ slope)
            bias -= rate / len(ids) * slope.sum(axis=0)
            # a bucket's share is small, so its embedding takes a step without the mean over the batch
            # (numpy is fast at this for flat places only)
            np.add.at(emb.reshape(-1), (idx[:, None] * DIM + np.arange(DIM)).ravel(), (-rate * back[of] * w[:, None]).astype(np.float32).ravel())
    return emb @ layer, bias


def rejection_threshold(right: np.ndarray, reject_rate: float) -> float:
    """The greatest score under which no more than reject_rate of these scores fall."""
    return float(np.sort(right)[int(len(right) * reject_rate)]) if len(right) else 0.0


def _fold(rows, y: np.ndarray, fold: np.ndarray, f: int, n: int, seed: int, epochs: int) -> tuple[np.ndarray, np.ndarray]:
    """Table and bias learned from the other folds (all rows for -1), and the logits of the fold's own rows."""
    table, bias = _descend(rows, y, np.flatnonzero(fold != f) if f >= 0 else np.arange(len(y)), n, seed, epochs)
    own = np.flatnonzero(fold == f)
    logits = np.array([(table[rows[i][0]] * rows[i][1][:, None]).sum(axis=0) + bias for i in own]).reshape(len(own), n)
    return np.vstack([table, bias[None, :]]), logits


def _folds_as_tasks(spark, rows, y, fold, folds, n, seed, epochs) -> dict:
    """_fold of each f, one task for each; only the table that learned from all rows comes back."""
    held = spark.sparkContext.broadcast((rows, y, fold))

    def run(batches):
        for batch in batches:
            for f in batch.column(0).to_pylist():
                table, logits = _fold(*held.value, f, n, seed, epochs)
                yield pa.RecordBatch.from_pydict({"f": [f], "kept": [table.astype("<f8").tobytes() if f < 0 or len(folds) == 1 else b""], "logits": [logits.astype("<f8").tobytes()]})

    ids = spark.createDataFrame([(f,) for f in folds], "f long").repartitionByRange(len(folds), "f")
    found = ids.mapInArrow(run, "f long, kept binary, logits binary").collect()  # FOLDS + 1 rows
    held.unpersist()
    return {r.f: tuple(np.frombuffer(x, dtype="<f8").reshape(-1, n) for x in (r.kept, r.logits)) for r in found}


def train(texts: pa.Table, label: str = "lang", seed: int = 5, epochs: int = EPOCHS, reject_rate: float = REJECT_RATE, spark=None) -> LanguageModel | None:
    """texts(text, label) -> model; None where no label is known. With spark, each fold is learned in a task."""
    texts = texts.filter(pa.compute.is_valid(texts[label]))
    texts = texts.filter(pa.compute.is_valid(texts["text"]))
    langs = sorted(set(texts[label].to_pylist()))
    if not langs:
        return None
    y = np.array([langs.index(v) for v in texts[label].to_pylist()])
    rows = _rows(texts)
    # each text is scored by a model that has not seen it, so the whole sample serves for the quantile
    fold = np.random.default_rng(seed).permutation(len(y)) % FOLDS if len(y) >= 20 else np.full(len(y), -1)
    folds = sorted({-1, *fold.tolist()})
    found = _folds_as_tasks(spark, rows, y, fold, folds, len(langs), seed, epochs) if spark else {f: _fold(rows, y, fold, f, len(langs), seed, epochs) for f in folds}
    logits = np.empty((len(y), len(langs)))
    for f in folds:
        logits[fold == f] = found[f][1]
    table, bias = found[-1][0][:-1], found[-1][0][-1]
    grid = np.geomspace(0.05, 20, 60)
    loss = [-np.log(np.maximum(_softmax(logits / t)[np.arange(len(y)), y], 1e-12)).mean() for t in grid]
    temperature = float(grid[int(np.argmin(loss))])
    p = _softmax(logits / temperature)
    right = p.max(axis=1)[p.argmax(axis=1) == y]
    return LanguageModel(langs, table.astype(np.float32), bias, temperature, rejection_threshold(right, reject_rate))


def predict_chunk(model: LanguageModel, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Probabilities, texts x langs. Grams are summed piece by piece, so that memory depends on neither the longest
    text nor the number of langs."""
    total = np.zeros((len(offs) - 1, len(model.langs)))
    count = np.zeros(len(offs) - 1)
    for n in GRAMS:
        count += np.maximum(0, np.diff(offs) - n + 1)
    piece = max(4096, PIECE_VALUES // max(1, len(model.langs)))
    for lo in range(0, len(data), piece):
        hi = min(len(data), lo + piece)
        a, z = int(np.searchsorted(offs, lo, side="right")) - 1, int(np.searchsorted(offs, hi, side="left"))
        for _, b, ok in features(data[lo : hi + max(GRAMS) - 1], offs[a : z + 1] - lo):
            b, ok = b[: hi - lo], ok[: hi - lo]
            values = model.table[b]
            values[~ok] = 0
            total[a:z] += range_sums(values, np.clip(offs[a:z] - lo, 0, len(b)), np.clip(offs[a + 1 : z + 1] - lo, 0, len(b)))
    return _softmax((total / np.maximum(count, 1)[:, None] + model.bias) / model.temperature)


def has_letter(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    def any_of(flags):
        out, full = np.zeros(len(offs) - 1, dtype=bool), np.flatnonzero(np.diff(offs))
        if len(full):
            out[full] = np.logical_or.reduceat(flags, offs[full])
        return out

    seen, wide = any_of(LETTER[data]), any_of(data > 127)
    for i in np.flatnonzero(wide & ~seen):
        seen[i] = any(c.isalpha() for c in data[offs[i] : offs[i + 1]].tobytes().decode("utf-8", "replace"))
    return seen


def identify(docs: DataFrame, model: LanguageModel | None, new=("lang_pred", "score", "accepted")) -> DataFrame:
    """docs with lang_pred, score and accepted, or these under other names."""
    docs = docs.drop(*new)
    if model is None:
        return docs.withColumns(dict(zip(new, (F.lit("und"), F.lit(0.0), F.lit(False)), strict=True)))
    ship_package(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = held.value
        for batch in batches:
            pred, score = [], []
            for _, _, data, offs in text_chunks(batch, "text", PREDICT_BYTES):
                p = predict_chunk(m, data, offs)
                ok = has_letter(data, offs)
                best = p.argmax(axis=1)
                pred += [m.langs[b] if k else "und" for b, k in zip(best, ok, strict=True)]
                score.append(np.where(ok, p.max(axis=1), 0.0))
            s = np.concatenate(score) if score else np.zeros(0)
            arrays = [*batch.columns, pa.array(pred, pa.string()), pa.array(s), pa.array((s >= m.threshold) & (s > 0))]
            yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names, *new])

    schema = T.StructType([*docs.schema.fields, *(T.StructField(k, t) for k, t in zip(new, (T.StringType(), T.DoubleType(), T.BooleanType()), strict=True))])
    return docs.mapInArrow(run, schema)


def fit(docs: DataFrame, per_lang: int = PER_LANG) -> LanguageModel | None:
    """Train on the rows whose crc32(doc_id) mod 4 is not 2: a bounded sample of at most classify.MAX_LABELS labels."""
    learn = docs.filter((crc_mod("doc_id", 4) != 2) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    return train(bounded_sample(learn, "doc_id", "lang", per_lang), spark=docs.sparkSession)


def op4_language_id(spark, sf_dir) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs)
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False))).alias("held_out"), "lang_pred", "score", "accepted")


@pipeline_stage
def language_stage(spark, docs: DataFrame, sf_dir) -> DataFrame:
    """Pipeline stage: documents that are rejected go."""
    return identify(docs, fit(docs), ("__lang", "__score", "__accepted")).filter("__accepted").select(*docs.columns)
