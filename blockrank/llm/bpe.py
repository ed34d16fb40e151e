"""Op 1: byte-level BPE encoding and decoding by Spark higher-order functions.

Texts are split by the tokenizer's pattern in Arrow batches. Each chunk of texts (about `chunk_bytes`, or
one longer text) becomes one row: the byte arrays of its distinct words, as the fold's first states, and its texts
as places in that list. Higher-order functions then fold the merges over each distinct word: the state holds one long per
piece, `rank with the next piece | first byte | token`, so the array's minimum is the leftmost merge of
least rank; a fold of n - 1 steps ends with no merge left. Ranks of pairs are looked up in a literal table of
all pairs whose joint bytes are a token (a scalar subquery, so it is sent once and never printed in plans), in
which each left token's row lies at a place of its own, so that one look finds a pair; a word that is itself a
token is looked up first, as public BPE coders do.
Nothing is shuffled, and memory depends on the chunk only. Decoding concatenates the tokens' bytes.

Words that occur at least twice in the first SAMPLE_TEXTS texts of at most SAMPLE_BYTES are folded once ahead and sent along with
the ranks, so that the chunks fold only what is rarer. This is a cache of bounded size, of arrays, whose words are
found by hash and compared by their bytes: what it holds changes the time, never an id.

A word of more than LONG_WORD bytes would make the fold quadratic; its merges run over a heap in the
splitting step, by the same ranks.

Defined results: null and empty texts give no ids and decode to no bytes; equal rows are encoded alike,
each on its own; an empty table gives an empty result; an unknown id fails the decoding job; other
columns pass through (a column named like the result is replaced).
"""

from __future__ import annotations

import base64
import heapq
from array import array
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import ship_package
from .common import give_back, pipeline_stage, read_table
from .text_kernel import span_hashes, spread, text_chunks

CHUNK_BYTES, LONG_WORD, SAMPLE_TEXTS, SAMPLE_BYTES, KNOWN_WORDS = 4 << 20, 400, 32768, 16 << 10, 1 << 18
NO_MERGE, EMPTY = 1 << 20, 1 << 62
_LABEL, _RANK = 20, 40


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: base64 bytes and rank, one token a line. A driver-side parameter, not input data."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def pair_table(ranks: dict[bytes, int]) -> np.ndarray:
    """For each token the place of its row, and behind these the rows, interleaved: at the row's place + right token
    stands left << 20 | rank, and EMPTY where there is no pair."""
    rows: defaultdict[int, dict[int, int]] = defaultdict(dict)
    for token, r in ranks.items():
        for cut in range(1, len(token)):
            a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
            if a is not None and b is not None:
                rows[a][b] = r
    n = max(ranks.values()) + 1
    begin, out = np.full(n, n, dtype=np.int64), np.full(8 * n, EMPTY, dtype=np.int64)
    at, size = 2 * n, 0
    order = sorted(rows.items(), key=lambda x: (-len(x[1]), x[0]))
    for a, row in order:
        if len(row) == 1:
            break
        right = np.fromiter(row, np.int64, len(row))
        if len(row) != size and len(row) < 16:
            at, size = 2 * n, len(row)
        while True:  # the first place where all of the row's slots are empty, from that of the row before on; rows of one size of less than 16 begin anew
            if at + 4096 + n > len(out):
                out = np.concatenate([out, np.full(len(out), EMPTY, dtype=np.int64)])
            free = np.flatnonzero(out[at : at + 2048] == EMPTY) + at - right[0]
            for b in right[1:]:
                if not len(free):
                    break
                free = free[out[free + b] == EMPTY]
            if len(free):
                break
            at += 2048
        begin[a] = free[0]
        at = int(free[0] + right[0])
        out[free[0] + right] = np.fromiter(row.values(), np.int64, len(row)) | (a << 20)
    one = [(a, b, r) for a, row in order if len(row) == 1 for b, r in row.items()]
    if one:
        left, right, rank = np.array(one, dtype=np.int64).T
        out = np.concatenate([out, np.full(len(one), EMPTY, dtype=np.int64)])
        slot = np.flatnonzero(out[2 * n :] == EMPTY)[: len(one)] + 2 * n
        begin[left] = slot - right
        out[slot] = rank | (left << 20)
    out[:n] = begin
    return np.concatenate([out, np.full(n + 1, EMPTY, dtype=np.int64)])[: begin.max() + n + 1]


class Tokenizer:
    """Ranks and pattern, with the literal tables for a session."""

    def __init__(self, spark: SparkSession, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, pattern
        n = max(ranks.values()) + 1
        pieces: list[bytes | None] = [None] * n
        for token, r in ranks.items():
            pieces[r] = token
        pairs = pair_table(ranks)
        single = [ranks[bytes([b])] for b in range(256)]
        table = pa.table({"pairs": pa.array([pairs], pa.list_(pa.int64())), "pieces": pa.array([pieces], pa.list_(pa.binary()))})
        self.single = np.array(single, dtype=np.int64)
        self.couples = np.full((256, 256), NO_MERGE, dtype=np.int64)
        for a in range(256):
            for b in range(256):
                self.couples[a, b] = ranks.get(bytes([a, b]), NO_MERGE)
        self._frame = spark.createDataFrame(table)
        del pieces, pairs, table
        give_back()

    def literal(self, name: str) -> Column:
        held = F.col(name).cast("array<string>") if name == "pieces" else F.col(name)
        return self._frame.select(held.alias(name)).scalar()


def _let(value: Column, body) -> Column:
    """body(value) with value evaluated once."""
    return F.transform(F.array(value), body)[0]


def begin_states(data: np.ndarray, offs: np.ndarray, single: np.ndarray, couples: np.ndarray, block: int = 1 << 18) -> np.ndarray:
    """The fold's first states of words laid end to end: a long for each byte, made a block of words at a time."""
    out = np.empty(len(data), dtype=np.int64)
    word = 0
    while word < len(offs) - 1:
        last = max(word + 1, int(np.searchsorted(offs, offs[word] + block, side="right")) - 1)
        begin, end = int(offs[word]), int(offs[last])
        if end > begin:
            own, heads = data[begin:end], offs[word : last + 1].astype(np.int64) - begin
            sizes = np.diff(heads)
            rank = np.full(len(own), NO_MERGE, dtype=np.int64)
            rank[:-1] = couples[own[:-1], own[1:]]
            rank[heads[1:][sizes > 0] - 1] = NO_MERGE
            place = np.arange(len(own)) - np.repeat(heads[:-1], sizes)
            out[begin:end] = (rank << _RANK) | (place << _LABEL) | single[own]
        word = last
    return out


def fold_merges(word: Column, pairs: Column) -> Column:
    """Token ids of one word given by its first states."""
    low = F.lit((1 << _LABEL) - 1).cast("long")
    none = F.lit(NO_MERGE).cast("long")

    def rank_of(a: Column, b: Column) -> Column:
        # an entry of the same pair leaves its rank, any other leaves more than NO_MERGE
        return F.least(F.get(pairs, F.get(pairs, a) + b).bitwiseXOR(F.shiftleft(a, 20)), none)

    def token(e: Column) -> Column:
        return e.bitwiseAND(low)

    keep = F.lit((1 << _RANK) - 1).cast("long")
    labels = F.lit(((1 << (_RANK - _LABEL)) - 1) << _LABEL).cast("long")

    def merge(s: Column, e: Column) -> Column:
        merged = F.shiftright(e, _RANK)

        def at(p: Column) -> Column:
            # the piece at p (from 1) takes in the next one, and the piece before has a new neighbour; states differ by
            # their first bytes, so that removing a state removes one piece
            after, before = F.get(s, p + 1), F.get(s, p - 2)
            rank = F.when(after.isNull(), none).otherwise(rank_of(merged, token(after)))
            joined = F.shiftleft(rank, _RANK).bitwiseOR(e.bitwiseAND(labels)).bitwiseOR(merged)
            rest = F.array_insert(F.array_remove(F.array_remove(s, e), F.get(s, p)), p, joined)
            left = F.shiftleft(rank_of(token(before), merged), _RANK).bitwiseOR(before.bitwiseAND(keep))
            return F.when(p > 1, F.array_insert(F.array_remove(rest, before), p - 1, left)).otherwise(rest)

        return _let(F.array_position(s, e).cast("int"), at)

    def step(s: Column, _: Column) -> Column:
        return _let(F.array_min(s), lambda e: F.when(F.shiftright(e, _RANK) >= NO_MERGE, s).otherwise(merge(s, e)))

    turns = F.when(F.size(word) > 1, F.sequence(F.lit(2), F.size(word))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(turns, word, step, lambda s: F.transform(s, lambda e: token(e).cast("int")))


def heap_merges(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges for a long word, in n log n."""
    n = len(word)
    size, prev, nxt = [1] * n, list(range(-1, n - 1)), [*range(1, n), -1]
    heap = [(ranks[word[i : i + 2]], i, 2) for i in range(n - 1) if word[i : i + 2] in ranks]
    heapq.heapify(heap)
    while heap:
        _, i, long = heapq.heappop(heap)
        j = nxt[i] if size[i] else -1
        if j < 0 or size[i] + size[j] != long:
            continue
        size[i], size[j], nxt[i] = long, 0, nxt[j]
        if nxt[i] >= 0:
            prev[nxt[i]] = i
        for a in (prev[i], i):
            b = nxt[a] if a >= 0 else -1
            if b >= 0 and (r := ranks.get(word[a : b + size[b]])) is not None:
                heapq.heappush(heap, (r, a, size[a] + size[b]))
    return [ranks[word[i : i + size[i]]] for i in range(n) if size[i]]


def _laid_out(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The words' bytes end to end, and their offsets."""
    return np.frombuffer(b"".join(words), dtype=np.uint8), np.concatenate([[0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))])


def _buffers(words: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """The same of an Arrow array."""
    offs = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64) if len(words) else np.zeros(1, np.int64)
    data = np.frombuffer(words.buffers()[2], np.uint8)[offs[0] : offs[-1]] if len(words) else np.zeros(0, np.uint8)
    return data, offs - offs[0]


def _states(data: np.ndarray, offs: np.ndarray, tok_single: np.ndarray, couples: np.ndarray) -> pa.ListArray:
    offs = offs.astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offs), pa.array(begin_states(data, offs, tok_single, couples)))


class KnownWords:
    """Words with their ids, as arrays sorted by the words' hashes; a word is known only if its bytes are equal, too."""

    def __init__(self, words: list[bytes] | tuple[np.ndarray, np.ndarray], ids: np.ndarray, id_offs: np.ndarray):
        data, offs = _laid_out(words) if isinstance(words, list) else words
        self.hashes, order = np.unique(span_hashes(data, offs[:-1], offs[1:]), return_index=True)
        self.offs, self.data = self._taken(order, data, offs)
        self.id_offs, self.ids = self._taken(order, ids, id_offs)

    @staticmethod
    def _taken(order: np.ndarray, flat: np.ndarray, offs: np.ndarray, block: int = 1 << 14) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, members) of the lists numbered in order, taken a block of lists at a time."""
        size = np.diff(offs)[order]
        heads = np.concatenate([[0], np.cumsum(size)])
        out = np.empty(heads[-1], dtype=flat.dtype)
        for lo in range(0, len(order), block):
            own = order[lo : lo + block]
            of, at = spread(size[lo : lo + block])
            out[heads[lo] : heads[lo + len(own)]] = flat[offs[own][of] + at]
        return heads, out

    def places(self, data: np.ndarray, offs: np.ndarray, block: int = 1 << 14) -> np.ndarray:
        """The place of each word, or -1, made a block of words at a time."""
        out = np.full(len(offs) - 1, -1)
        for lo in range(0, len(out) if len(self.hashes) else 0, block):
            heads = offs[lo : lo + block + 1]
            hashes = span_hashes(data, heads[:-1], heads[1:])
            place = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            size = np.diff(heads)
            may = np.flatnonzero((self.hashes[place] == hashes) & (self.offs[place + 1] - self.offs[place] == size))
            of, at = spread(size[may])
            unlike = np.bincount(of[data[heads[may][of] + at] != self.data[self.offs[place[may]][of] + at]], minlength=len(may)) > 0
            may = may[~unlike]
            out[lo + may] = place[may]
        return out

    def ids_of(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids) of words by their places."""
        return self._taken(places, self.ids, self.id_offs)


def _word_counts(pattern: str, text: str):
    """The words of a task's texts with their counts, the most frequent KNOWN_WORDS of them."""

    def run(batches):
        find, seen = regex.compile(pattern).findall, Counter()
        for batch in batches:
            for t in batch.column(text):
                seen.update(find(t.as_py()))
        top = seen.most_common(KNOWN_WORDS)
        for lo in range(0, len(top), 10_000):
            words, counts = zip(*top[lo : lo + 10_000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(counts, pa.int64())], names=["word", "n"])

    return run


def known_words(docs: DataFrame, tok: Tokenizer, text: str) -> KnownWords:
    """The tokens, and the folded frequent words of a sample of about SAMPLE_TEXTS texts, counted in tasks; at most
    KNOWN_WORDS words reach the driver."""
    total = docs.count()
    sample = docs.select(F.col(text).alias("t")).filter(F.octet_length("t") <= SAMPLE_BYTES)
    if total > 2 * SAMPLE_TEXTS:
        sample = sample.sample(SAMPLE_TEXTS / total, seed=7)
    counted = sample.mapInArrow(_word_counts(tok.pattern, "t"), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    top = counted.filter("n > 1").orderBy(F.desc("n"), "word").limit(KNOWN_WORDS).select("word").toArrow()
    tokens = _laid_out([*tok.ranks])
    own = np.fromiter(tok.ranks.values(), np.int32, len(tok.ranks))
    known = KnownWords(tokens, own, np.arange(len(own) + 1))
    words = top["word"].cast(pa.binary()).combine_chunks()
    data, offs = _buffers(words)
    words = words.filter(pa.array((known.places(data, offs) < 0) & (np.diff(offs) <= LONG_WORD)))
    if not len(words):
        return known
    del known, top
    give_back()
    spark = docs.sparkSession
    deal = max(1, min(len(words) // 1000, 2 * spark.sparkContext.defaultParallelism))
    data, offs = _buffers(words.take(pa.array(np.argsort(np.arange(len(words)) % deal, kind="stable"))))
    rows = np.concatenate([[0], np.cumsum(np.bincount(np.arange(len(words)) % deal))])
    states = pa.ListArray.from_arrays(pa.array(rows.astype(np.int32)), _states(data, offs, tok.single, tok.couples))
    table = pa.table({"no": pa.array(range(deal), pa.int64()), "words": states})
    folded = spark.createDataFrame(table).repartition(deal).select("no", F.col("words"), tok.literal("pairs").alias("pairs")).select("no", F.transform("words", lambda w: fold_merges(w, F.col("pairs"))).alias("ids"))
    ids = folded.toArrow().sort_by("no")["ids"].combine_chunks().flatten()
    sizes = np.concatenate([np.ones(len(own), np.int64), pc.list_value_length(ids).to_numpy()])
    ids = np.concatenate([own, ids.flatten().to_numpy().astype(np.int32)])
    every = np.concatenate([tokens[0], data]), np.concatenate([tokens[1], tokens[1][-1] + offs[1:]])
    return KnownWords(every, ids, np.concatenate([[0], np.cumsum(sizes)]))


def _dictionary(words: list[bytes], ranks: dict[bytes, int], known: KnownWords, single: np.ndarray, couples: np.ndarray) -> pa.StructArray:
    """For each word its ids, where they are known or the word is too long for the fold, or else the fold's first states."""
    data, offs = _laid_out(words)
    size, place = np.diff(offs), known.places(data, offs)
    long = {i: heap_merges(words[i], ranks) for i in np.flatnonzero((place < 0) & (size > LONG_WORD)).tolist()}
    have = np.flatnonzero(place >= 0)
    sizes, ready = np.zeros(len(words), np.int64), place >= 0
    own_offs, own = known.ids_of(place[have])
    sizes[have] = np.diff(own_offs)
    for i, ids in long.items():
        sizes[i], ready[i] = len(ids), True
    id_offs = np.concatenate([[0], np.cumsum(sizes)])
    flat = np.empty(id_offs[-1], dtype=np.int32)
    of, at = spread(sizes[have])
    flat[id_offs[have][of] + at] = own
    for i, ids in long.items():
        flat[id_offs[i] : id_offs[i + 1]] = ids
    states = _states(data[np.repeat(~ready, size)], np.concatenate([[0], np.cumsum(np.where(ready, 0, size))]), single, couples)
    return pa.StructArray.from_arrays([states, pa.ListArray.from_arrays(pa.array(id_offs.astype(np.int32)), pa.array(flat), mask=pa.array(~ready))], names=["states", "ready"])


def _splitter(ranks_held, pattern: str, text: str, keep: list[str], chunk_bytes: int):
    def run(batches):
        find = regex.compile(pattern).findall
        ranks, single, couples, known = ranks_held.value
        give_back()
        for batch in batches:
            for lo, hi, data, offs in text_chunks(batch, text, chunk_bytes):
                places: defaultdict[str, int] = defaultdict()
                places.default_factory = places.__len__
                ids, sizes = array("i"), [0]
                for s, e in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True):
                    ids.extend(map(places.__getitem__, find(data[s:e].tobytes().decode("utf-8", "replace"))))
                    sizes.append(len(ids))
                words = [w.encode() for w in places]
                del places
                dictionary = _dictionary(words, ranks, known, single, couples)
                del words
                at = pa.ListArray.from_arrays(pa.array(np.array(sizes, dtype=np.int32)), pa.array(np.frombuffer(ids, dtype=np.int32)))
                rows = pa.StructArray.from_arrays([*(batch.column(batch.schema.get_field_index(k)).slice(lo, hi - lo) for k in keep), at], names=[*keep, "__at"])
                one = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
                yield pa.RecordBatch.from_arrays([one(dictionary), one(rows)], names=["words", "texts"])
                del dictionary, at, rows, ids
                give_back()

    return run


def encode(docs: DataFrame, tok: Tokenizer, text: str = "text", out: str = "token_ids", keep: list[str] | None = None, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """docs (or only its columns in keep) with the array of token ids of docs[text]."""
    ship_package(docs.sparkSession)
    docs = docs.drop(out) if text != out else docs
    keep = docs.columns if keep is None else keep
    held = docs.sparkSession.sparkContext.broadcast((tok.ranks, tok.single, tok.couples, known_words(docs, tok, text)))
    row = T.StructType([*(docs.schema[k] for k in keep), T.StructField("__at", T.ArrayType(T.IntegerType()))])
    schema = T.StructType([T.StructField("words", T.ArrayType(T.StructType([T.StructField("states", T.ArrayType(T.LongType())), T.StructField("ready", T.ArrayType(T.IntegerType()))]))), T.StructField("texts", T.ArrayType(row))])
    blocks = docs.mapInArrow(_splitter(held, tok.pattern, text, keep, chunk_bytes), schema)
    blocks = blocks.select("*", tok.literal("pairs").alias("pairs"))
    ids = F.transform("words", lambda w: F.when(w["ready"].isNotNull(), w["ready"]).otherwise(fold_merges(w["states"], F.col("pairs"))))

    def spell(known: Column) -> Column:
        return F.transform("texts", lambda t: F.struct(*(t[k].alias(k) for k in keep), F.flatten(F.transform(t["__at"], lambda i: F.get(known, i))).alias(out)))

    return blocks.select(F.inline(_let(ids, spell)))


def decode(tokens: DataFrame, tok: Tokenizer, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """tokens with the bytes of tokens[ids]."""
    keep = [c for c in tokens.columns if c != out]
    piece = lambda i: F.element_at("__pieces", i + 1)  # noqa: E731  fails for an id out of range
    wide = tokens.withColumn("__pieces", tok.literal("pieces"))
    return wide.select(*keep, F.array_join(F.transform(F.coalesce(ids, F.array().cast("array<int>")), piece), "").cast("binary").alias(out))


def public_tokenizer(spark: SparkSession, name: str = "byte_bpe_multi_50k.tiktoken") -> Tokenizer:
    import public_tokenizers

    return Tokenizer(spark, read_ranks(public_tokenizers.path(name)), public_tokenizers.PATTERN)


def op1_byte_bpe(spark, sf_dir) -> DataFrame:
    tok = public_tokenizer(spark)
    done = decode(encode(read_table(spark, sf_dir, "documents").select("doc_id", "text"), tok, keep=["doc_id"]), tok)
    return done.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@pipeline_stage
def encode_stage(spark, docs: DataFrame, sf_dir) -> DataFrame:
    """Pipeline stage: all columns and token_ids."""
    return encode(docs, public_tokenizer(spark))
