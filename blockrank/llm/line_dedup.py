"""Op 2: near-duplicate lines by an exact set-similarity join.

A line's tokens are its words, as a set of 64-bit hashes; lines are `\\n`-split, lines without a word take
no part and stay. A line is removed when an earlier line, in the order of (doc_id, line number), has tokens
with Jaccard similarity of at least 0.8: every line is judged against all earlier ones, removed or not, so
the result depends on no order of work.

1. Token frequencies of all lines, in 2**22 hashed counters: a table of fixed size, which orders tokens by
   rarity; a shared counter costs time, never a match.
2. Equal token sets become one row with their first place and the rarest tokens (the prefix): a set of n
   tokens reaches 0.8 with one of at most its length only if they share one of its n - ceil(0.8 n) + 1
   rarest, which is among the shorter one's n - ceil(8 n / 9) + 1 rarest (its index part). A token that
   occurs once in the corpus is shared with no line and left out.
3. Posting lists: the sets of one prefix token meet in a task, sorted by length. A pair is passed over by
   its lengths, by its positions (what is left behind the shared places can't reach the overlap), or by a
   128-bit map of each set (bits that differ in an odd number of tokens are at least so many different
   tokens). What is left are sets that have a possible partner, not pairs. A token of more than LIST sets is
   split by length, and each length class into tiles of about LIST / 2 sets that meet two by two.
4. The tokens of these sets are read again from the texts. In each posting list they are compared exactly,
   in the order of their first places; a set is done at its first match.
5. Documents are rebuilt from the lines that stay.

Defined results: null and empty texts stay as they are; rows of one doc_id are ordered by a hash of
their texts, and equal rows keep the same lines; a null doc_id comes first in the order; an empty table
gives an empty result; other columns pass through.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import ship_package
from .common import forget, in_bitmap, key_bitmap, materialise, pipeline_stage, read_table
from .text_kernel import line_offsets, mix, order_within, span_hashes, spread, text_chunks, word_spans

SIMILARITY, COUNTER_BITS, SLICES, LIST, PAIRS = 0.8, 22, 32, 4096, 1 << 20
BROADCAST_HOT = 100_000
#: Tasks whose counters meet at once, and levels of the tree: up to FAN_IN ** ROUNDS tasks.
FAN_IN, ROUNDS = 128, 3
#: The counter's size class of a token that occurs once.
_ONCE, _PLACE_BITS = 8, 14


def line_tokens(data: np.ndarray, offs: np.ndarray):
    """(text of each line, first line of each text, tokens, line of each token): all lines of a chunk, tokens in order."""
    lines, first = line_offsets(data, offs)
    starts, ends, _ = word_spans(data, offs)
    line = np.repeat(np.arange(len(lines) - 1), np.diff(np.searchsorted(starts, lines)))
    return np.repeat(np.arange(len(offs) - 1), np.diff(first)), first, span_hashes(data, starts, ends), line


def _frequencies(batches):
    """Counters of one task as packed slices; part is the task's number."""
    count = np.zeros(1 << COUNTER_BITS, dtype=np.int64)
    held, size = [], 0
    for batch in batches:
        for _, _, data, offs in text_chunks(batch, "text"):
            held.append((line_tokens(data, offs)[2] >> np.uint64(64 - COUNTER_BITS)).astype(np.int32))
            size += len(held[-1])
            if size > 1 << COUNTER_BITS:
                count += np.bincount(np.concatenate(held), minlength=len(count))
                held, size = [], 0
    if held:
        count += np.bincount(np.concatenate(held), minlength=len(count))
    pack, task = zstandard.ZstdCompressor(level=1), TaskContext.get().partitionId()
    for i, part in enumerate(np.split(count, SLICES)):
        yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([task], pa.int32()), pa.array([pack.compress(part.astype("<u8").tobytes())], pa.binary())], names=["slice", "part", "counts"])


def _sum_counts(key, table):
    """The sum of one slice of at most FAN_IN tasks."""
    unpack, total = zstandard.ZstdDecompressor(), np.zeros((1 << COUNTER_BITS) // SLICES, dtype=np.uint64)
    for blob in table["counts"]:
        total += np.frombuffer(unpack.decompress(blob.as_py()), dtype="<u8")
    return pa.table({"slice": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([key[1].as_py()], pa.int32()), "counts": pa.array([zstandard.ZstdCompressor(level=1).compress(total.tobytes())], pa.binary())})


def token_classes(texts: DataFrame) -> np.ndarray:
    """How often the tokens of each counter occur, as size classes of one byte: eight for each doubling.

    The tasks' counters are added up by a tree, so that no task gets those of more than FAN_IN others."""
    parts = texts.mapInArrow(_frequencies, "slice int, part int, counts binary")
    for _ in range(ROUNDS):
        parts = parts.withColumn("part", F.floor(F.col("part") / FAN_IN).cast("int")).groupBy("slice", "part").applyInArrow(_sum_counts, "slice int, part int, counts binary")
    slices: list[list[bytes]] = [[] for _ in range(SLICES)]
    for r in parts.collect():  # a row for each slice
        slices[r.slice].append(r.counts)
    out = np.zeros((SLICES, (1 << COUNTER_BITS) // SLICES), dtype=np.uint8)
    for own, blobs in zip(out, slices, strict=True):  # one slice at a time: the driver never holds the counters of all
        total = np.zeros(len(own), dtype=np.uint64)
        for blob in blobs:
            total += np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype="<u8")
        own[:] = np.minimum(255, np.log2(total.astype(np.float64) + 1) * 8)
    return out.ravel()


def prefix_size(n: np.ndarray) -> np.ndarray:
    return n - np.ceil(SIMILARITY * n - 1e-9).astype(np.int64) + 1


def index_size(n: np.ndarray) -> np.ndarray:
    """How many of a set's rarest tokens it must share one of with any similar set that is not shorter."""
    return n - np.ceil(2 * SIMILARITY / (1 + SIMILARITY) * n - 1e-9).astype(np.int64) + 1


def overlap_needed(m, n):
    return np.ceil(SIMILARITY / (1 + SIMILARITY) * (m + n) - 1e-9)


def bit_maps(tokens: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two words of 64 bits for each set: each token flips one bit."""
    bit = np.uint64(1) << (tokens & np.uint64(63))
    high = (tokens >> np.uint64(6)) & np.uint64(1)
    zero = np.zeros(1, np.uint64)
    return tuple(np.bitwise_xor.reduceat(np.where(high == side, bit, zero), begin[:-1]) for side in (0, 1))


def token_sets(data: np.ndarray, offs: np.ndarray):
    """The lines with tokens as sets: (text of each line, first line of each text, line, tokens, begin of each
    set, set key). The key is a sum over the set, whatever its order."""
    of_text, first, grams, line = line_tokens(data, offs)
    if not len(grams):
        return of_text, first, np.zeros(0, np.int64), grams, np.zeros(1, np.int64), np.zeros(0, np.uint64)
    order = order_within(grams, line)
    g, at = grams[order], line[order]
    new = np.concatenate([[True], (g[1:] != g[:-1]) | (at[1:] != at[:-1])])
    g, at = g[new], at[new]
    begin = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    key = mix(np.add.reduceat(mix(g ^ np.uint64(0xA0761D6478BD642F)), begin))
    return of_text, first, at[begin], g, np.append(begin, len(g)), key


def by_rarity(tokens: np.ndarray, begin: np.ndarray, frequency: np.ndarray) -> np.ndarray:
    """The tokens of each set, rarest first: by the counter's size class, then the hash."""
    rank = frequency[(tokens >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)].astype(np.uint64) << np.uint64(56) | tokens >> np.uint64(8)
    return tokens[order_within(rank, np.repeat(np.arange(len(begin) - 1), np.diff(begin)))]


def _lines(frequency):
    """(doc, hash, text) -> one row for each set and chunk: key, first place, size, bit maps, prefix. A prefix
    entry is token << 15 | place << 1 | in the index part, and negative if the token may be in more than LIST sets."""
    filled = int(math.log2(LIST + 1) * 8)  # the least size class of a counter over LIST

    def run(batches):
        for batch in batches:
            ids, hashes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for lo, _, data, offs in text_chunks(batch, "text"):
                of_text, first, line, tokens, begin, key = token_sets(data, offs)
                if not len(key):
                    continue
                doc, same = ids[lo + of_text[line]], hashes[lo + of_text[line]]
                number = line - first[of_text[line]]
                place = np.lexsort((number, same, doc, key))
                keep = place[np.concatenate([[True], key[place][1:] != key[place][:-1]])]
                size = np.diff(begin)[keep]
                own, at = spread(size)
                tokens = tokens[begin[keep][own] + at]
                begin = np.concatenate([[0], np.cumsum(size)])
                maps = bit_maps(tokens, begin)
                tokens = by_rarity(tokens, begin, frequency.value)
                # only tokens that occur twice or more are shared
                seen = frequency.value[(tokens >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)]
                use, often = (at < prefix_size(size)[own]) & (seen > _ONCE), seen >= filled
                entry = (often[use].astype(np.uint64) << np.uint64(63)) | (tokens[use] >> np.uint64(16)) << np.uint64(_PLACE_BITS + 1) | (np.minimum(at[use], (1 << _PLACE_BITS) - 1) << 1 | (at[use] < index_size(size)[own[use]])).astype(np.uint64)
                ends = np.concatenate([[0], np.cumsum(np.bincount(own[use], minlength=len(size)))])
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(entry.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(key[keep].view(np.int64)), pa.array(doc[keep]), pa.array(same[keep]), pa.array(number[keep].astype(np.int32)), pa.array(size.astype(np.int32)), *(pa.array(x.view(np.int64)) for x in maps), lists], names=["key", "doc", "hash", "line", "n", "b0", "b1", "prefix"])

    return run


def _whole_groups(batches):
    """Rows sorted by their first column -> tables of whole groups."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        group = batch.column(0).to_numpy()
        if held and held[0].column(0)[0].as_py() != group[0]:
            yield pa.Table.from_batches(held)
            held = []
        cut = int(np.searchsorted(group, group[-1]))
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def _possible(batches):
    """Posting lists (group, n, entry, key, b0, b1), sorted by group and n -> (group, key) of the sets that may have a similar one there."""
    for table in _whole_groups(batches):
        group, n, entry, key, *maps = (table[k].to_numpy() for k in ("group", "n", "entry", "key", "b0", "b1"))
        maps = [x.view(np.uint64) for x in maps]
        n, place, index = n.astype(np.int64), (entry >> 1) & ((1 << _PLACE_BITS) - 1), entry & 1 == 1
        # the sets behind i in its list up to a quarter longer
        number = np.cumsum(np.concatenate([[False], group[1:] != group[:-1]]))
        wide = int(n.max()) * 2 + 2
        end = np.searchsorted(number * wide + n, number * wide + np.floor(n / SIMILARITY + 1e-9).astype(np.int64), side="right")
        shorter = np.flatnonzero(index & (end > np.arange(len(n)) + 1))
        count = end[shorter] - shorter - 1
        alive = np.zeros(len(n), dtype=bool)
        lo, sums = 0, np.concatenate([[0], np.cumsum(count)])
        while lo < len(shorter):
            hi = max(lo + 1, int(np.searchsorted(sums, sums[lo] + PAIRS, side="right")) - 1)
            own, step = spread(count[lo:hi])
            i = shorter[lo:hi][own]
            j = i + 1 + step
            need = overlap_needed(n[i], n[j])
            may = 1 + np.minimum(n[i] - place[i], n[j] - place[j]) - 1 >= need
            i, j, need = i[may], j[may], need[may]
            apart = sum(np.bitwise_count(x[i] ^ x[j]).astype(np.int64) for x in maps)
            may = n[i] + n[j] - apart >= 2 * need
            alive[i[may]] = True
            alive[j[may]] = True
            lo = hi
        yield pa.RecordBatch.from_arrays([pa.array(group[alive]), pa.array(key[alive])], names=["group", "key"])


def _line_keys(wanted):
    """(text) -> (key, tokens) of the sets that may be wanted."""

    def run(batches):
        bits = wanted.value
        for batch in batches:
            for _, _, data, offs in text_chunks(batch, "text"):
                _, _, _, tokens, begin, key = token_sets(data, offs)
                may = np.flatnonzero(in_bitmap(bits, key))
                _, one = np.unique(key[may], return_index=True)
                may = may[one]
                size = np.diff(begin)[may]
                own, at = spread(size)
                tokens = tokens[begin[may][own] + at]
                begin = np.concatenate([[0], np.cumsum(size)])
                yield pa.RecordBatch.from_arrays([pa.array(key[may].view(np.int64)), pa.array([tokens[x:y].tobytes() for x, y in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)], pa.binary())], names=["key", "tokens"])

    return run


def _matched(batches):
    """(group, key, tokens), sorted by group and first place -> keys of the sets that have an earlier similar one."""
    for table in _whole_groups(batches):
        group, keys, held = table["group"].to_numpy(), table["key"].to_numpy(), table["tokens"].combine_chunks()
        begin = np.frombuffer(held.buffers()[1], np.int32)[held.offset : held.offset + len(held) + 1].astype(np.int64)
        tokens = np.frombuffer(held.buffers()[2], np.uint64, count=int(begin[-1] - begin[0]) // 8, offset=int(begin[0]))
        begin = (begin - begin[0]) // 8
        n, maps = np.diff(begin), bit_maps(tokens, begin)
        new = np.concatenate([[True], group[1:] != group[:-1]])
        head = np.maximum.accumulate(np.where(new, np.arange(len(n)), 0))
        # each set with all earlier ones of its list, PAIRS / 4 at a time
        count = np.arange(len(n)) - head
        sums, gone, whole = np.concatenate([[0], np.cumsum(count)]), np.zeros(len(n), dtype=bool), {}
        lo = 0
        while lo < len(n):
            hi = max(lo + 1, int(np.searchsorted(sums, sums[lo] + PAIRS // 4, side="right")) - 1)
            own, step = spread(count[lo:hi])
            j = own + lo
            i = head[j] + step
            apart = sum(np.bitwise_count(x[i] ^ x[j]).astype(np.int64) for x in maps)
            may = np.flatnonzero(n[i] + n[j] - apart >= 2 * overlap_needed(n[i], n[j]))
            for a, b in zip(i[may].tolist(), j[may].tolist(), strict=True):
                if gone[b]:
                    continue
                for x in (a, b):
                    if x not in whole:
                        whole[x] = frozenset(tokens[begin[x] : begin[x + 1]].tolist())
                common = len(whole[a] & whole[b])
                gone[b] = common >= SIMILARITY * (len(whole[a]) + len(whole[b]) - common) - 1e-9
            lo = hi
        yield pa.RecordBatch.from_arrays([pa.array(keys[gone])], names=["key"])


def _rebuild(keep: list[str], text: str, new):
    """Texts from the lines that stay: those listed, and those without a word."""

    def run(batches):
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            lines = batch.column(batch.schema.get_field_index("__lines")).to_pylist()
            out, total, removed = [], [], []
            for value, listed in zip(column.to_pylist(), lines, strict=True):
                parts = (value or "").split("\n")
                stay = set(listed or ())
                left = [x for i, x in enumerate(parts) if i in stay or not x.strip(" \t\n\x0b\x0c\r")]
                out.append(None if value is None else value if len(left) == len(parts) else "\n".join(left))
                total.append(len(parts))
                removed.append(len(parts) - len(left))
            arrays = [pa.array(out, column.type) if k == text else batch.column(batch.schema.get_field_index(k)) for k in keep]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(total, pa.int64()), pa.array(removed, pa.int64())], names=[*keep, *new])

    return run


def _postings(sets: DataFrame) -> DataFrame:
    """The posting lists (group, n, entry, key, b0, b1) of all prefix tokens, in partitions of whole groups."""
    posted = sets.select("key", "n", "b0", "b1", F.explode("prefix").alias("entry")).withColumn("group", F.shiftright("entry", _PLACE_BITS + 1))
    columns = ["group", "n", "entry", "key", "b0", "b1"]
    count = sets.select(F.explode(F.filter("prefix", lambda e: e < 0)).alias("entry")).groupBy(F.shiftright("entry", _PLACE_BITS + 1).alias("group")).agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > LIST)
    hot = materialise(count.select("group"), "line-hot")
    if not hot.limit(1).count():
        return posted.select(columns).repartition("group").sortWithinPartitions("group", "n")
    # each hot token fills a list, so at most one entry in LIST makes a row here; broadcast only if few
    hot = F.broadcast(hot) if hot.count() <= BROADCAST_HOT else hot
    few = posted.join(hot, "group", "left_anti").select(columns)
    size = F.floor(F.log("n") / math.log(1 / SIMILARITY)).cast("int")
    cells = posted.join(hot, "group", "left_semi").withColumn("cell", F.explode(F.array(size, size - 1)))
    tiles = cells.groupBy("group", "cell").agg(F.ceil(F.count(F.lit(1)) * 2 / LIST).cast("int").alias("tiles"))
    tiles = F.broadcast(materialise(tiles, "line-tiles")) if hot.count() <= BROADCAST_HOT else tiles
    dealt = cells.join(tiles, ["group", "cell"]).withColumn("tile", F.pmod(F.xxhash64("key"), "tiles").cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    dealt = dealt.withColumn("group", F.xxhash64("group", "cell", F.least("tile", "with"), F.greatest("tile", "with")))
    return few.union(dealt.select(columns)).repartition("group").sortWithinPartitions("group", "n")


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", new=("n_lines", "n_removed")) -> DataFrame:
    """docs with the lines that have an earlier similar line taken out of text, and n_lines, n_removed, or
    these under other names."""
    ship_package(docs.sparkSession)
    sc = docs.sparkSession.sparkContext
    docs = docs.drop(*new)
    doc, same = F.coalesce(F.col(key).cast("long"), F.lit(-(2**63))), F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    rows = docs.select(doc.alias("doc"), same.alias("hash"), F.col(text).alias("text"))
    classes = token_classes(rows.select("text"))
    frequency = sc.broadcast(classes)
    held = rows.mapInArrow(_lines(frequency), "key long, doc long, hash long, line int, n int, b0 long, b1 long, prefix array<long>")
    one = F.min(F.struct("doc", "hash", "line", "n", "b0", "b1", "prefix")).alias("at")
    first = materialise(held.groupBy("key").agg(one).select("key", "at.*"), "line-sets")
    alive = materialise(_postings(first).mapInArrow(_possible, "group long, key long"), "line-possible")
    wanted = sc.broadcast(key_bitmap(alive.select("key").distinct()))
    tokens = rows.select("text").mapInArrow(_line_keys(wanted), "key long, tokens binary").join(alive.select("key").distinct(), "key", "left_semi").dropDuplicates(["key"])
    placed = alive.join(tokens.join(first.select("key", "doc", "hash", "line"), "key"), "key")
    placed = placed.repartition("group").sortWithinPartitions("group", "doc", "hash", "line").select("group", "key", "tokens")
    gone = materialise(placed.mapInArrow(_matched, "key long").distinct(), "line-gone")
    forget(alive)
    frequency.unpersist()
    wanted.unpersist()
    stay = first.join(gone, "key", "left_anti").groupBy("doc", "hash").agg(F.collect_list("line").alias("__lines"))
    joined = docs.withColumns({"__doc": doc, "__hash": same}).join(stay.toDF("__doc", "__hash", "__lines"), ["__doc", "__hash"], "left").select(*docs.columns, "__lines")
    schema = T.StructType([*docs.schema.fields, *(T.StructField(k, T.LongType()) for k in new)])
    return joined.mapInArrow(_rebuild(docs.columns, text, new), schema)


def op2_line_dedup(spark, sf_dir) -> DataFrame:
    out = dedup_lines(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", "text")


@pipeline_stage
def line_stage(spark, docs: DataFrame, sf_dir) -> DataFrame:
    """Pipeline stage: the texts without their repeated lines."""
    return dedup_lines(docs, new=("__n_lines", "__n_removed")).select(*docs.columns)
