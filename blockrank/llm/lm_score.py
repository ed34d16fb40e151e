"""Op 5: language-model scoring by online logistic context mixing.

A text is spelled as its words (A-Z lower-cased), a space after each, and one end byte; a byte as the
decisions along its path in the Huffman tree of the byte before it. Bit predictors look each decision up in
hashed contexts: the last two, three and four bytes, which run across words, and the word so far. Their
predictions are mixed in the logistic domain by weights that are gated by the place in the word and by
which of the long contexts are known. The mixed probability is refined adaptively: a table of cells (place
in the word, size of the mixed prediction) holds how often the bit was 1, and the mean of the mixed and the
refined probability is what counts. Weights and cells begin as learned from the corpus and go on learning
inside each text: after each segment of it (256 bytes at first, then a sixteenth of what was read) the
weights take a step along their gradient and the cells count their bits. So a text's score depends on the
training texts and on the text alone. The sum is a probability of the whole text, hence bits per byte.

What is learned, all of it from all training texts and from sums, so that neither partitions nor order matter: token
counts, the trees, the predictors' counts, and the first weights and cells. For these each training decision, without
its own occurrence, is put into a joint histogram (place in the word, bit, and the size class of each context's
prediction), whose size does not depend on the corpus; the driver fits the weights to the whole histogram by Newton
steps. A size class stands for the mean of its predictions, which follows from the predictors' counts. Tables have 2**12 to 2**MAX_BITS slots by the corpus's size, because they are broadcast (10
MB in all); above that, contexts share slots, and the weights learn how little such a table then says.

Plan: one pass over the texts makes blocks (the spelled texts, and their distinct words by 64-bit hash with
training counts). Two passes over the blocks count decisions: by slot, then in the histogram. Counts are aggregated by word; each block's distinct words, not the occurrences, are joined with
them and meet the block again in one co-group, which also runs the model over the block's texts, many side by side.

Defined results: a null text is empty, an empty text is one end; rows without a doc_id are for training;
repeated rows count as often as they are there; with nothing to learn every decision of a text's first
segment has probability 1/2 and every count is 0; an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

import functools
import heapq
import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, materialise, read_table
from .text_kernel import LOWER, span_hashes, spread, text_chunks, word_spans

BLOCK_BYTES = 8 << 20
#: Slots of the contexts' tables at most, as powers of two: two, three, four bytes, word so far.
MAX_BITS = (18, 20, 22, 22)
SLICES, FAN_IN = 128, 32
ROUND, FIRST_SEGMENT, TEXTS_A_GROUP = 1 << 16, 256, 32
PLACES, BUCKETS = 4, 25
GATES, CELLS = PLACES * 4, PLACES * BUCKETS
RATE, INERTIA, CELL_PRIOR, LIMIT = 0.1, 400.0, 60.0, 12.0
#: Least sizes (in sixteenths) of the classes of predictions that are not 0; class NONE is 0, others lie by sign on its sides.
SIZES = np.array([1, 10, 20, 28, 36, 46, 62, 88])
NONE, LEVELS = len(SIZES), 2 * len(SIZES) + 1
FIRST_WEIGHT, NEWTON_STEPS = 0.3, 30
_P = np.uint64(0x9E3779B97F4A7C15)
_NODE = np.uint64(0xD6E8FEB86659FD93)
_CONTEXT = np.array([0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)
_STEPS = 1024
_POWER = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(_STEPS - 1, 0x1D8E4E27C47D124F, np.uint64)]))
SPACE, END = 32, 10


def huffman(counts: np.ndarray) -> list[list[tuple[int, int]]]:
    """For all 256 bytes the nodes on the way to them, with their bits."""
    heap = [(int(c) + 1, b, b) for b, c in enumerate(counts)]
    heapq.heapify(heap)
    parent, node = {}, 256
    while len(heap) > 1:
        (a, _, x), (b, _, y) = heapq.heappop(heap), heapq.heappop(heap)
        parent[x], parent[y] = (node, 0), (node, 1)
        heapq.heappush(heap, (a + b, node, node))
        node += 1
    out = []
    for b in range(256):
        path = []
        while b in parent:
            b, side = parent[b]
            path.append((b - 256, side))
        out.append(path[::-1])
    return out


class Trees:
    """One Huffman tree for each byte before: where the path of (byte before, byte) begins, nodes and bits."""

    def __init__(self, pairs: np.ndarray):
        every = [path for row in pairs.reshape(256, 256) for path in huffman(row)]
        self.size = np.array([len(p) for p in every], dtype=np.int64)
        self.begin = np.cumsum(self.size) - self.size
        flat = [(n | before << 8, bit) for before in range(256) for p in every[before * 256 : before * 256 + 256] for n, bit in p]
        self.nodes = np.array([n for n, _ in flat], dtype=np.uint64) * _NODE
        self.bits = np.array([b for _, b in flat], dtype=np.int8)

    @functools.cached_property
    def steps(self) -> np.ndarray:
        """A node's part of a slot, which is the top of (context + node) * _P; made where it is used, not sent."""
        return self.nodes * _P


def spell(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all spelled texts, offsets): the words, a space after each, and an end byte."""
    lens = ends - starts
    n = np.diff(first)
    before = np.repeat(np.arange(len(n)), n)  # an end byte for each earlier text
    at = np.cumsum(lens + 1) - (lens + 1) + before
    word, place = spread(lens)
    out = np.full(int(lens.sum()) + len(lens) + len(n), SPACE, dtype=np.uint8)
    out[at[word] + place] = data[starts[word] + place]
    sums = np.concatenate([[0], np.cumsum(lens + 1)])
    offs = np.concatenate([[0], sums[first[1:]] + np.arange(1, len(n) + 1)])
    out[offs[1:] - 1] = END
    return out, offs


def segment(done: int) -> int:
    """How many bytes of a text are read with the same weights, after so many."""
    return min(ROUND, max(FIRST_SEGMENT, done // 16))


def rounds(stream: np.ndarray, offs: np.ndarray, trees: Trees, bits: tuple[int, ...]):
    """All decisions of all texts, many texts side by side, a segment of each a round: (the group's texts, whether the group is new,
    place in the group of each decision's text, bit, slots by context, place in the word). Within a text, in order."""
    order = np.argsort(offs[:-1] - offs[1:], kind="stable")
    base = np.concatenate([[0], np.cumsum([1 << b for b in bits])])
    at = 0
    while at < len(order):
        longest = int(offs[order[at] + 1] - offs[order[at]])
        group = order[at : at + max(1, min(TEXTS_A_GROUP, ROUND // min(longest, segment(longest))))]
        at += len(group)
        sizes = (offs[1:] - offs[:-1])[group]
        word_hash, word_place = np.zeros(len(group), np.uint64), np.zeros(len(group), np.int64)
        done, new = 0, True
        while done < longest:
            live = int(np.searchsorted(-sizes, -done))  # the texts longer than done
            seg = np.minimum(sizes[:live] - done, segment(done))
            text, place = spread(seg)
            i = (offs[group[:live]] + done)[text] + place
            own = place + done
            byte = stream[i]
            back = []
            for j in range(1, 5):
                b = stream[np.maximum(i - j, 0) if done < 4 else i - j]
                if done < 4:
                    b[own < j] = END
                back.append(b)
            wide = back[0].astype(np.uint64)
            contexts = []
            for j in range(1, 4):
                wide = wide | (back[j].astype(np.uint64) << np.uint64(8 * j))
                contexts.append(wide * _CONTEXT[j - 1])
            begin = np.cumsum(seg) - seg
            head = back[0] == SPACE
            head[own == 0] = True
            going = ~head[begin]
            head[begin] = True
            starts = np.flatnonzero(head)
            word = np.cumsum(head) - 1
            first_hash, first_place = np.zeros(len(starts), np.uint64), np.zeros(len(starts), np.int64)
            lead = word[begin[going]]
            first_hash[lead], first_place[lead] = word_hash[:live][going], word_place[:live][going]
            in_word = np.arange(len(i)) - (starts - first_place)[word]
            value = (byte.astype(np.uint64) + np.uint64(1)) * _POWER[in_word % _STEPS]
            sums = np.cumsum(value)
            so_far = sums - value
            so_far += (first_hash - so_far[starts])[word]
            last = begin + seg - 1
            word_hash[:live], word_place[:live] = so_far[last] + value[last], in_word[last] + 1
            contexts.append(so_far * _CONTEXT[3])
            pair = (back[0].astype(np.int64) << 8) | byte
            n = trees.size[pair]
            of, path = spread(n)
            path += trees.begin[pair][of]
            node, slots = trees.steps[path], []
            for k, (c, b) in enumerate(zip(contexts, bits, strict=True)):
                slot = (c * _P)[of]
                slot += node
                slot >>= np.uint64(64 - b)
                slot += np.uint64(base[k])
                slots.append(slot.view(np.int64))
            yield group, new, text[of], trees.bits[path], slots, np.minimum(in_word, PLACES - 1)[of]
            done, new = done + segment(done), False


def stretch(n0, n1):
    return np.log((n1 + 0.3) / (n0 + 0.3))


def gates(place: np.ndarray, inputs: list[np.ndarray]) -> np.ndarray:
    """Which weights: the place in the word, and whether four bytes and the word so far are known."""
    gate = place * 4
    gate += (inputs[2] != 0).view(np.int8) * np.int8(2)
    gate += inputs[3] != 0
    return gate


def cells(place: np.ndarray, z: np.ndarray) -> np.ndarray:
    return place * BUCKETS + (z * np.float32((BUCKETS - 1) / (2 * LIMIT)) + np.float32(BUCKETS / 2)).astype(np.int64)


class Model:
    """Trees, tables of one byte a slot, first weights (gates x contexts) and first counts of the cells (2 x cells)."""

    def __init__(self, trees: Trees, bits, logits: np.ndarray, weights: np.ndarray, counts: np.ndarray):
        self.trees, self.bits, self.logits, self.weights, self.counts = trees, bits, logits, weights, counts

    def scores(self, stream: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Natural log probability of each text."""
        total = np.zeros(len(offs) - 1)
        for group, new, text, bit, slots, place in rounds(stream, offs, self.trees, self.bits):
            if new:
                weights = [np.tile(self.weights[:, k], len(group)) for k in range(len(self.bits))]
                ones, all_ = np.tile(self.counts[1], len(group)), np.tile(self.counts.sum(axis=0), len(group))
            inputs = [self.logits[s] for s in slots]
            row = text * GATES
            row += gates(place, inputs)
            inputs = [x * np.float32(1 / 16) for x in inputs]
            z = np.zeros(len(bit), np.float32)
            for x, w in zip(inputs, weights, strict=True):
                z += x * w[row]
            np.clip(z, -LIMIT, LIMIT, out=z)
            mixed = np.float32(1) / (np.float32(1) + np.exp(-z))
            cell = text * CELLS + cells(place, z)
            p = (mixed + (ones / all_)[cell]) * np.float32(0.5)
            logs = np.log(np.where(bit, p, np.float32(1) - p))
            seen = int(text[-1]) + 1
            total[group[:seen]] += np.bincount(text, weights=logs, minlength=seen)
            error = bit - mixed
            n = np.bincount(row, minlength=len(weights[0]))
            step = (RATE / (n + INERTIA)).astype(np.float32)
            for x, w in zip(inputs, weights, strict=True):
                w += step * np.bincount(row, weights=error * x, minlength=len(w)).astype(np.float32)
            cell += cell
            cell += bit
            both = np.bincount(cell, minlength=2 * len(ones)).reshape(-1, 2).astype(np.float32)
            ones += both[:, 1]
            all_ += both.sum(axis=1)
        return total


def predictions(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """The predictions that counts make, in sixteenths."""
    return np.clip(np.round(16 * stretch(n0, n1)), -127, 127).astype(np.int8)


def levels(predicted: np.ndarray) -> np.ndarray:
    """Size classes of predictions."""
    every = np.arange(-128, 128)
    table = NONE + np.sign(every) * np.searchsorted(SIZES, np.abs(every), side="right")
    return table.astype(np.uint8)[predicted.astype(np.int64) + 128]


def without_own(logs: np.ndarray, bits) -> tuple[np.ndarray, np.ndarray]:
    """(size classes of slot * 2 + bit: what the slot predicts without one decision of that bit; contexts x LEVELS: the
    mean prediction of a class over all decisions); logs: log2(1 + n) of the slots' counts."""
    out, means = np.empty(2 * logs.shape[1], dtype=np.uint8), np.zeros((len(bits), LEVELS))
    lo = 0
    for k, b in enumerate(bits):
        hi = lo + (1 << b)
        n = [np.exp2(logs[side, lo:hi].astype(np.float32)) - np.float32(1) for side in (0, 1)]
        total, weight = np.zeros(LEVELS), np.zeros(LEVELS)
        for bit in (0, 1):
            rest = [np.maximum(0, x - (side == bit)) for side, x in enumerate(n)]
            predicted = predictions(*rest)
            out[2 * lo + bit : 2 * hi : 2] = level = levels(predicted)
            total += np.bincount(level, weights=n[bit] * predicted, minlength=LEVELS)
            weight += np.bincount(level, weights=n[bit], minlength=LEVELS)
        means[k] = total / np.maximum(weight, 1e-9) / 16
        lo = hi
    return out, means


def histogram(count: np.ndarray, classes: np.ndarray, decisions) -> None:
    """Adds decisions (of `rounds`) to a count by place, class of each context's prediction, and bit."""
    for _, _, _, bit, slots, place in decisions:
        key = place
        for s in slots:
            s += s
            s += bit
            key = key * LEVELS
            key += classes[s]
        key += key
        key += bit
        np.add.at(count, key, 1)


def fit_weights(key: np.ndarray, n: np.ndarray, means: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(weights, counts of the cells) of a histogram: n decisions in each key."""
    rest, bit = np.divmod(key, 2)
    level = []
    for _ in means:
        rest, own = np.divmod(rest, LEVELS)
        level.append(own)
    level, place = level[::-1], rest
    gate = gates(place, [x - NONE for x in level])
    x = [means[k][own] for k, own in enumerate(level)]
    weights = np.full((GATES, len(x)), FIRST_WEIGHT)

    def mixed() -> np.ndarray:
        return np.clip(sum(v * weights[gate, k] for k, v in enumerate(x)), -LIMIT, LIMIT)

    for _ in range(NEWTON_STEPS):
        p = 1 / (1 + np.exp(-mixed()))
        slope, bend = n * (bit - p), n * p * (1 - p)
        first = np.stack([np.bincount(gate, weights=slope * v, minlength=GATES) for v in x], axis=1) + FIRST_WEIGHT - weights
        second = np.stack([np.stack([np.bincount(gate, weights=bend * v * w, minlength=GATES) for v in x], axis=1) for w in x], axis=1) + np.eye(len(x))
        weights += np.clip(np.linalg.solve(second, first[:, :, None])[:, :, 0], -0.5, 0.5)
    counts = np.full((2, CELLS), 0.4)
    np.add.at(counts, (bit, cells(place, mixed().astype(np.float32))), n)
    return weights, counts * (CELL_PRIOR / counts.sum(axis=0))


def fit(trees: Trees, bits, logs: np.ndarray, blocks: DataFrame) -> Model:
    """The model with its first weights and cells, from all decisions of the training texts of blocks; logs: log2(1 + n) of the slots' counts."""
    sc = blocks.sparkSession.sparkContext
    classes, means = without_own(logs, bits)
    held = sc.broadcast((trees, classes))
    seen = _training(blocks).mapInArrow(_histogram(held, bits), "key int, n long").groupBy("key").agg(F.sum("n").alias("n")).orderBy("key").toArrow()
    held.unpersist()
    weights, counts = fit_weights(seen["key"].to_numpy().astype(np.int64), seen["n"].to_numpy().astype(np.float64), means)
    logits = np.empty(logs.shape[1], dtype=np.int8)
    for lo in range(0, len(logits), 1 << 20):
        logits[lo : lo + (1 << 20)] = predictions(*(np.exp2(x[lo : lo + (1 << 20)].astype(np.float32)) - 1 for x in logs))
    return Model(trees, bits, logits, weights.astype(np.float32), counts.astype(np.float32))


def _lists(**columns) -> pa.RecordBatch:
    """One row."""
    return pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array([v]) for v in columns.values()], names=list(columns))


_BLOCK = "block long, doc_ids array<long>, learn array<boolean>, n_bytes array<long>, sizes array<long>, stream binary, keys array<long>, counts array<int>, pairs array<int>, pair_counts array<long>, learn_bytes long"


def _blocks(batches):
    """(doc_id, text, learn) -> blocks."""
    pack = zstandard.ZstdCompressor(level=3)
    block = TaskContext.get().partitionId() << 20
    for batch in batches:
        learn_all = np.array(batch.column(2).to_pylist(), dtype=bool)
        for lo, hi, raw, offs in text_chunks(batch, "text", BLOCK_BYTES):
            data, learn = LOWER[raw], learn_all[lo:hi]
            starts, ends, first = word_spans(data, offs)
            hashes = span_hashes(data, starts, ends)
            keys, at = np.unique(hashes, return_inverse=True)
            counts = np.bincount(at[np.repeat(learn, np.diff(first))], minlength=len(keys))
            # the end is one more word, at the last place
            keys, counts = np.append(keys, _end_key()), np.append(counts, int(learn.sum()))
            stream, own = spell(data, starts, ends, first)
            pair = np.empty(len(stream), dtype=np.int64)
            pair[1:] = stream[:-1]
            pair[own[:-1]] = END
            pair = np.bincount(((pair << 8) | stream)[np.repeat(learn, np.diff(own))], minlength=1 << 16)
            some = np.flatnonzero(pair)
            ids = pa.array([batch.column(0).slice(lo, hi - lo).to_pylist()], pa.list_(pa.int64()))
            yield _lists(block=block, doc_ids=ids, learn=learn, n_bytes=np.diff(offs), sizes=np.diff(own), stream=pack.compress(stream.tobytes()), keys=keys.view(np.int64), counts=counts.astype(np.int32), pairs=some.astype(np.int32), pair_counts=pair[some], learn_bytes=int(np.diff(own)[learn].sum()))
            block += 1


def _end_key() -> np.ndarray:
    return span_hashes(np.array([END], np.uint8), np.array([0]), np.array([1]))


def _unpack(row: dict) -> tuple[np.ndarray, np.ndarray]:
    stream = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["stream"]), dtype=np.uint8)
    return stream, np.concatenate([[0], np.cumsum(np.array(row["sizes"], dtype=np.int64))])


def _training(blocks: DataFrame) -> DataFrame:
    """The blocks with training texts, in a bounded number of tasks, because each holds a whole table."""
    return blocks.filter("learn_bytes > 0").select("learn", "sizes", "stream").coalesce(2 * blocks.sparkSession.sparkContext.defaultParallelism)


def _decisions(batches, trees: Trees, bits):
    """All decisions of the training texts of blocks."""
    for batch in batches:
        for row in batch.to_pylist():
            stream, offs = _unpack(row)
            learn = np.array(row["learn"], dtype=bool)
            stream = stream[np.repeat(learn, np.diff(offs))]
            offs = np.concatenate([[0], np.cumsum(np.diff(offs)[learn])])
            yield from rounds(stream, offs, trees, bits)


def _tables(held, bits):
    """Blocks -> slices of the decision counts of all contexts, one set a task."""

    def run(batches):
        size = sum(1 << b for b in bits)
        count = np.zeros(2 * size, dtype=np.uint32)
        for _, _, _, bit, slots, _ in _decisions(batches, held.value, bits):
            for s in slots:
                s += s
                s += bit
                np.add.at(count, s, np.uint32(1))
        pack = zstandard.ZstdCompressor(level=1)
        part = TaskContext.get().partitionId()
        for i, own in enumerate(np.array_split(count.reshape(-1, 2), SLICES)):
            yield _lists(slice=pa.array([i], pa.int32()), part=pa.array([part], pa.int32()), counts=pack.compress(own.T.astype("<f8").astype("<f4").tobytes()))

    return run


def _histogram(held, bits):
    """Blocks -> the task's histogram of decisions, as (key, n)."""

    def run(batches):
        trees, classes = held.value
        count = np.zeros(2 * PLACES * LEVELS ** len(bits), dtype=np.int64)
        histogram(count, classes, _decisions(batches, trees, bits))
        some = np.flatnonzero(count)
        for lo in range(0, len(some), 50_000):
            part = some[lo : lo + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(count[part])], names=["key", "n"])

    return run


def _sum_counts(key, table):
    """The sum of at most FAN_IN tasks' counts of one slice."""
    unpack, pack = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=1)
    total = sum(np.frombuffer(unpack.decompress(blob.as_py()), dtype="<f4").astype(np.float64) for blob in table["counts"])
    return pa.table({"slice": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([key[1].as_py()], pa.int32()), "counts": pa.array([pack.compress(total.astype("<f4").tobytes())], pa.binary())})


def training_blocks(docs: DataFrame) -> tuple[DataFrame]:
    """docs(doc_id, text, learn) as the last argument of `fit`: all texts, in blocks."""
    return (docs.mapInArrow(_blocks, _BLOCK),)


_sample = training_blocks  # a former name, which a test uses


def train(blocks: DataFrame) -> Model:
    spark = blocks.sparkSession
    pairs = np.zeros(1 << 16, dtype=np.int64)
    for r in blocks.select(F.inline(F.arrays_zip("pairs", "pair_counts"))).toDF("pair", "n").groupBy("pair").agg(F.sum("n").alias("n")).collect():
        pairs[r.pair] = r.n
    trees = Trees(pairs)
    learned = int(pairs.sum())
    bits = tuple(min(b, max(12, math.ceil(math.log2(max(1, learned))) - 2)) for b in MAX_BITS)
    tasks = max(1, min(blocks.count(), 2 * spark.sparkContext.defaultParallelism))
    held = spark.sparkContext.broadcast(trees)
    parts = _training(blocks).mapInArrow(_tables(held, bits), "slice int, part int, counts binary")
    while True:
        parts = parts.withColumn("part", F.floor(F.col("part") / FAN_IN).cast("int")).groupBy("slice", "part").applyInArrow(_sum_counts, "slice int, part int, counts binary")
        tasks = -(-tasks // FAN_IN)
        if tasks == 1:
            break
    slices = {r.slice: np.frombuffer(zstandard.ZstdDecompressor().decompress(r.counts), dtype="<f4").reshape(2, -1) for r in parts.select("slice", "counts").collect()}
    held.unpersist()
    size = sum(1 << b for b in bits)
    counts = np.concatenate([slices[i] for i in range(SLICES)], axis=1) if slices else np.zeros((2, size), "<f4")
    counts += 1
    return fit(trees, bits, np.log2(counts, out=counts), blocks)


def _score_blocks(held, total: int, distinct: int):
    def run(key, blocks, found):
        model = held.value
        row = blocks.to_pylist()[0]
        stream, offs = _unpack(row)
        starts, ends, first = word_spans(stream, offs)
        keys, at = np.unique(span_hashes(stream, starts, ends), return_inverse=True)
        c = np.zeros(len(keys) + 1, dtype=np.int64)
        c[found["pos"].to_numpy()] = found["c"].to_numpy()
        tokens = np.diff(first) + 1
        log_c, seen = np.log10(c + 1.0), (c > 0).astype(np.int64)
        text = np.repeat(np.arange(len(tokens)), tokens - 1)
        base = np.bincount(text, weights=log_c[at], minlength=len(tokens)) + log_c[-1] - tokens * np.log10(total + distinct + 1)
        known = np.bincount(text[seen[at] > 0], minlength=len(tokens)) + seen[-1]
        score = model.scores(stream, offs) / np.log(10)
        per_byte = -score / np.log10(2) / np.maximum(1, np.array(row["n_bytes"]))
        return pa.table({"doc_id": pa.array(row["doc_ids"], pa.int64()), "n_tokens": tokens, "n_known": known, "base_score": base, "score": score, "bits_per_byte": per_byte})

    return run


def lm_scores(docs: DataFrame, learn) -> DataFrame:
    """docs(doc_id, text), learn: the condition of training rows -> scores, one row for each row."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", learn.alias("learn"))
    blocks = materialise(rows.mapInArrow(_blocks, _BLOCK), "lm-blocks")
    counted = blocks.select(F.inline(F.arrays_zip("keys", "counts"))).toDF("key", "n").filter("n > 0").groupBy("key").agg(F.sum("n").alias("c"))
    words = materialise(counted, "lm-words")
    total, distinct = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    model = spark.sparkContext.broadcast(train(blocks))
    placed = blocks.select("block", F.posexplode("keys").alias("pos", "key"))
    # a block without a known word has its row, too: the place of the end
    found = placed.join(words, "key").select("block", "pos", "c").union(blocks.select("block", F.size("keys") - 1, F.lit(0).cast("long")).filter(F.lit(not total))).toDF("of", "pos", "c")
    texts = blocks.select("block", "doc_ids", "n_bytes", "sizes", "stream")
    out = texts.groupBy("block").cogroup(found.groupBy("of")).applyInArrow(_score_blocks(model, total, distinct), "doc_id long, n_tokens long, n_known long, base_score double, score double, bits_per_byte double")
    return out.withColumn("train_tokens", F.lit(total).cast("long"))


def op5_lm_score(spark, sf_dir) -> DataFrame:
    held = F.coalesce(crc_mod("doc_id", 7) == 2, F.lit(False))
    scored = lm_scores(read_table(spark, sf_dir, "documents"), ~held)
    return scored.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")
