"""Op 10: near-duplicate classes by Order MinHash, verified by banded alignment.

Texts with equal bytes form one representative first (128-bit digest). A representative's k-mers are its
runs of k words, each labelled with its occurrence number in the text, so repeats count. For each sketch the least
few k-mers under a hash function are taken and kept in the order of the text; their sequence is one band.
Two texts that align by 0.8 share 0.8 of their labelled single words, however the changes lie, so bands of
seven single words agree with a chance of about 0.2 each whether words were replaced, put in or taken out, scattered or
evenly; runs of five words (a few bands) are all broken where a change comes each fourth word. SCHEMES has the
bands by a text's number of words; their ranges overlap, so that two texts that may be similar have one in common.
(README: measured shares of pairs found.)

A pair is verified by aligning its two sequences of words within the band of diagonals that a similarity
of 0.8 allows (bit-parallel longest common subsequence); the similarity is matched / (m + n - matched).
Before that it must pass its parity maps: each word, labelled with its occurrence number, flips one of
MAP_BITS bits, so two maps differ in no more bits than the texts have unshared words. This loses no pair.

1. Every text of a bucket (the texts that share a band) is aligned with the bucket's least text: one row
   for each text and band at most, whatever the bucket's size. Components of the verified pairs are classes.
2. A bucket whose texts are all in one class is done. In the others each pair of texts of different classes
   is tried by lengths and parity maps: a bucket is cut by length (a text meets only those whose length
   allows 0.8) and then into tiles of about TILE texts that meet two by two in a task. Only pairs that may
   be similar leave it, each from the least bucket that its texts share, and are aligned once; texts that merely share
   a passage are passed over by their maps. Buckets of the same texts count once.
3. Classes are the components of all links; a class is named by its least doc_id.

Defined results: null counts as empty, and empty texts are equal texts like others; texts without a word
have no other likeness than equal bytes; a text of fewer than k words has one k-mer, all its words, and one of fewer
k-mers than a band takes has bands of all of them; repeated rows of one doc_id give a row each. Texts, not ids, are compared: rows may share a doc_id or have none (a
class without any has a null class_id, and unlike texts of one doc_id may give two classes the same name).
An empty table gives an empty result; other columns are not read by `near_classes`, and kept by the
pipeline stage.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, in_bitmap, key_bitmap, materialise, pipeline_stage, read_table, text_digest
from .components import connected_components, hot_join, hot_keys
from .text_kernel import mix, occurrence, shingles, span_hashes, spread, text_chunks, word_spans

SIMILARITY = 0.8
#: Words from, words up to (not included), k, sketches, k-mers of a sketch. The least length of one is at most 0.8 of
#: the greatest of the one before.
SCHEMES = ((1, 15, 1, 12, 2), (10, 100, 1, 20, 5), (80, 1 << 62, 1, 32, 7), (40, 1 << 62, 5, 8, 2))
MAP_BITS, TILE = 2048, 8192
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)


def words_of(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and for each text the index of its first (one more at the end)."""
    starts, ends, first = word_spans(data, offs)
    return span_hashes(data, starts, ends), first


def labelled_kmers(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-mers with their occurrence numbers, and for each text the index of its first."""
    grams, begin = shingles(words, first, k)
    of = np.repeat(np.arange(len(first) - 1), np.diff(begin))
    return mix(grams + occurrence(grams, of).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), begin


def order_sketches(words: np.ndarray, first: np.ndarray, k: int, sketches: int, per_sketch: int) -> np.ndarray:
    """Bands, texts x sketches; those of a text without a word are 0.

    The least k-mers of a sketch are picked among those under a value that a few more than per_sketch of a text are
    expected to lie under; a text where fewer do is looked at whole."""
    labelled, begin = labelled_kmers(words, first, k)
    n = np.diff(begin)
    bands = np.zeros((len(n), sketches), dtype=np.uint64)
    full = np.flatnonzero(n)
    if not len(full):
        return bands
    n, heads = n[full], begin[full]
    of = np.repeat(np.arange(len(full)), n)
    take = np.minimum(n, per_sketch)
    share = (per_sketch + 4 * np.sqrt(per_sketch) + 4) / n
    under = np.where(share >= 1, _TOP, (np.minimum(share, 0.999) * 2.0**64).astype(np.uint64))[of]
    seeds = mix(np.arange(1, sketches + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F) + np.uint64(1000 * per_sketch + k))
    ends = np.cumsum(take)
    place = np.arange(ends[-1]) - np.repeat(ends - take, take)
    for s, seed in enumerate(seeds):
        h = (labelled ^ seed) * np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(32)
        at = np.flatnonzero(h <= under)
        lacking = np.flatnonzero(np.bincount(of[at], minlength=len(full)) < take)
        if len(lacking):
            at = np.union1d(at, np.concatenate([np.arange(heads[i], heads[i] + n[i]) for i in lacking]))
        own = of[at]
        order = np.lexsort((h[at], own))
        nth = np.arange(len(own)) - np.searchsorted(own, own)
        chosen = np.sort(at[order[nth < per_sketch]])  # in the order of the text
        kmers = np.zeros((len(full), per_sketch), dtype=np.uint64)
        kmers[of[chosen], place] = labelled[chosen]
        band = np.full(len(full), seed)
        for p in range(per_sketch):
            band = np.where(p < take, mix(band * np.uint64(0x8EBC6AF09C88C6E3) + kmers[:, p]), band)
        bands[full, s] = band
    return bands


def banded_matches(a: list, b: list, width: int) -> int:
    """Length of the longest common subsequence of which no two places lie more than width apart. Bits of the places of
    a that the band has left behind are counted and dropped, so numbers are as long as the band, not as a."""
    size, matched, base, top, state = len(a), 0, 0, 0, 0
    step, band = max(512, 2 * width), (1 << (2 * width + 1)) - 1
    for c in range(0, len(b), step):
        low, high = min(size, max(0, c - width)), min(size, c + step + width)
        drop = low - base
        matched += drop - (state & ((1 << drop) - 1)).bit_count()
        state >>= drop
        state |= (1 << (high - low)) - (1 << (top - low))
        base, top = low, high
        every = (1 << (high - low)) - 1
        places: dict = {}
        for i, x in enumerate(a[low:high]):
            places[x] = places.get(x, 0) | (1 << i)
        for j, y in enumerate(b[c : c + step], c - width - low):
            hits = places.get(y, 0)
            if hits:
                u = state & hits & (band << j if j >= 0 else band >> -j)
                if u:
                    state = ((state + u) | (state - u)) & every
    return matched + (top - base) - state.bit_count()


def aligned_similarity(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """matched / (m + n - matched) of an alignment within the band: of the first of three bands, each wider, that
    reaches least, or else of the best one; 0.0 where lengths alone rule least out."""
    m, n = len(a), len(b)
    if not m or not n or min(m, n) < least * max(m, n):
        return 0.0
    # matched >= need, so at most max(m, n) - need places of either may go unmatched
    need = int(np.ceil(least / (1 + least) * (m + n) - 1e-9))
    width = max(m, n) - need
    short = min(m, n)
    differ = np.flatnonzero(a[:short] != b[:short])
    head = int(differ[0]) if len(differ) else short
    differ = np.flatnonzero(a[::-1][: short - head] != b[::-1][: short - head])
    tail = int(differ[0]) if len(differ) else short - head
    a, b, matched = a[head : m - tail].tolist(), b[head : n - tail].tolist(), head + tail
    if a and b:
        for w in dict.fromkeys(min(width, x) for x in (64, 1024, width)):
            found = matched + banded_matches(a, b, w)
            if found >= need:
                break
        matched = found
    return matched / (m + n - matched)


def bands_of(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All bands of each text, by SCHEMES, and for each text the index of its first; none without a word."""
    n = np.diff(first)
    size = np.zeros(len(n), dtype=np.int64)
    for low, high, _, sketches, _ in SCHEMES:
        size += np.where((n >= low) & (n < high), sketches, 0)
    begin = np.concatenate([[0], np.cumsum(size)])
    flat, at = np.empty(begin[-1], dtype=np.uint64), begin[:-1].copy()
    for low, high, k, sketches, per_sketch in SCHEMES:
        own = np.flatnonzero((n >= low) & (n < high))
        if len(own):
            inside = np.repeat((n >= low) & (n < high), n)
            flat[at[own][:, None] + np.arange(sketches)] = order_sketches(words[inside], np.concatenate([[0], np.cumsum(n[own])]), k, sketches, per_sketch)
            at[own] += sketches
    return flat, begin


def _sketch(batches):
    """(id, digest, text) -> (id, digest, number of words, bands)."""
    for batch in batches:
        for lo, hi, data, offs in text_chunks(batch, "text"):
            words, first = words_of(data, offs)
            flat, begin = bands_of(words, first)
            lists = pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(flat.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(np.diff(first).astype(np.int64)), lists], names=["id", "digest", "n", "bands"])


def parity_maps(words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Texts x MAP_BITS / 64 words of 64 bits: each labelled word flips one bit."""
    labelled, begin = labelled_kmers(words, first, 1)
    text = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    out = np.empty((len(begin) - 1, MAP_BITS // 64), dtype=np.uint64)
    for lo in range(0, len(out), 1024):
        hi = min(len(out), lo + 1024)
        bit = (text[begin[lo] : begin[hi]] - lo) * MAP_BITS + (labelled[begin[lo] : begin[hi]] >> np.uint64(64 - MAP_BITS.bit_length() + 1)).astype(np.int64)
        odd = np.bincount(bit, minlength=(hi - lo) * MAP_BITS) & 1
        out[lo:hi] = np.packbits(odd.astype(bool).reshape(hi - lo, MAP_BITS), axis=1).view(np.uint64)
    return out


def may_be_similar(m, n, apart) -> np.ndarray:
    """Whether texts of m and n words, of which at least `apart` are not shared, can reach SIMILARITY."""
    return (np.minimum(m, n) >= SIMILARITY * np.maximum(m, n)) & (m + n - apart >= 2 * SIMILARITY / (1 + SIMILARITY) * (m + n) - 1e-9)


def _mapped(wanted):
    """(id, key, text, digest) -> (id, digest, text, parity map) of the keys that may be wanted."""

    def run(batches):
        for batch in batches:
            keys = batch.column(1).to_numpy()
            one = np.sort(np.unique(keys, return_index=True)[1])  # equal rows once
            batch = batch.take(pa.array(one[in_bitmap(wanted.value, keys[one])]))
            for lo, hi, data, offs in text_chunks(batch, "text"):
                maps = parity_maps(*words_of(data, offs))
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(lo, hi - lo) for i in (0, 3, 2)), pa.array([x.tobytes() for x in maps], pa.binary())], names=["id", "digest", "text", "map"])

    return run


def _sequences(texts: pa.Array) -> list[np.ndarray]:
    """The words of each text, as hashes."""
    out = []
    for _, _, data, offs in text_chunks(pa.RecordBatch.from_arrays([texts], names=["text"]), "text"):
        words, first = words_of(data, offs)
        out += [words[s:e] for s, e in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
    return out


def _maps(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint64).reshape(len(column), MAP_BITS // 64)


def _verify_pairs(batches):
    """(a, b, text_a, n_a, map_a, text_b, n_b, map_b) -> the pairs (a, b) that are similar."""
    for batch in batches:
        col = {k: batch.column(i) for i, k in enumerate(batch.schema.names)}
        if not batch.num_rows:
            continue
        apart = np.bitwise_count(_maps(col["map_a"]) ^ _maps(col["map_b"])).sum(axis=1, dtype=np.int64)
        may = may_be_similar(col["n_a"].to_numpy(), col["n_b"].to_numpy(), apart)
        for lo in range(0, batch.num_rows, 256):
            part = np.flatnonzero(may[lo : lo + 256]) + lo
            one, two = (_sequences(col[k].take(pa.array(part))) for k in ("text_a", "text_b"))
            part = pa.array(part[np.array([aligned_similarity(x, y) >= SIMILARITY for x, y in zip(one, two, strict=True)], dtype=bool)], pa.int64())
            yield pa.RecordBatch.from_arrays([col["a"].take(part), col["b"].take(part)], names=["a", "b"])


def _possible_pairs(key, table):
    """Pairs (a, b) of a pair of tiles that are of different classes and may be similar, and have no lesser open bucket in
    common: they meet in that one, too."""
    band, cell, one, two = (k.as_py() for k in key)
    table = table.combine_chunks()
    ids, tile, own, cls, size = (table[k].to_numpy() for k in ("id", "tile", "own", "class", "n"))
    order = np.argsort(size, kind="stable")
    ids, tile, own, cls, size = (x[order] for x in (ids, tile, own, cls, size))
    maps = np.concatenate([_maps(part) for part in table["map"].chunks])[order]
    # the open buckets before this one
    flat = np.concatenate([part.flatten().to_numpy() for part in table["bands"].chunks])
    of = np.repeat(np.arange(len(ids)), pc.list_value_length(table["bands"]).to_numpy())[flat < band]
    flat, lesser = flat[flat < band], np.bincount(of, minlength=len(ids))
    begin, lesser = (np.cumsum(lesser) - lesser)[order], lesser[order]
    longest = np.searchsorted(size, np.floor(size / SIMILARITY + 1e-9), side="right")
    found = []
    for i in range(len(ids)):
        other = np.arange(i + 1, longest[i])
        other = other[cls[other] != cls[i]]
        if one != two:
            other = other[tile[other] != tile[i]]
        if own[i] != cell:
            other = other[own[other] == cell]
        if len(other):
            apart = np.bitwise_count(maps[other] ^ maps[i]).sum(axis=1, dtype=np.int64)
            other = other[may_be_similar(size[i], size[other], apart)]
            pair, at = spread(lesser[other])
            common = np.isin(flat[begin[other][pair] + at], flat[begin[i] : begin[i] + lesser[i]])
            other = other[np.bincount(pair[common], minlength=len(other)) == 0]
            found.append(np.stack([np.minimum(ids[i], ids[other]), np.maximum(ids[i], ids[other])]))
    a, b = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
    return pa.table({"a": a, "b": b})


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The similar ones of pairs(a, b), a written table."""
    sides = [texts.select(F.col("id").alias(k), *(F.col(c).alias(f"{c}_{k}") for c in ("text", "n", "map"))) for k in "ab"]
    both = hot_join(pairs, sides[0], "a").join(sides[1], "b").select("a", "b", "text_a", "n_a", "map_a", "text_b", "n_b", "map_b")
    return materialise(both.mapInArrow(_verify_pairs, "a long, b long"), "near-links")


def _links_within(posted: DataFrame, buckets: DataFrame, texts: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b): links between texts of different classes in one bucket; buckets of two were judged before."""
    placed = posted.join(classes.select("id", "class"), "id", "left").withColumn("class", F.coalesce("class", "id"))
    open_ = placed.groupBy("band").agg(F.min("class").alias("c"), F.max("class").alias("z")).filter("c <> z")
    open_ = buckets.filter("size > 2").join(open_, "band").groupBy("a", "size", "sign").agg(F.min("band").alias("band")).select("band")
    members = materialise(hot_join(placed, open_, "band", hot=hot_keys(posted, "band")), "near-open")
    own = F.floor(F.log("n") / math.log(1 / SIMILARITY)).cast("int")
    # a text is at home in the cell of its length, and a guest in the one below where any text is at home there
    home = members.select("band", "id", "n", "class", own.alias("own"), own.alias("cell"))
    guest = home.withColumn("cell", F.col("own") - 1).join(home.select("band", "cell").distinct(), ["band", "cell"], "left_semi").select(*home.columns)
    cells = materialise(home.union(guest).withColumn("group", F.xxhash64("band", "cell")), "near-cells")
    # a cell of one class has nothing to compare
    worth = (F.col("rows") > 1) & (F.col("c") != F.col("z"))
    tiles = cells.groupBy("group").agg(F.count(F.lit(1)).alias("rows"), F.min("class").alias("c"), F.max("class").alias("z"), F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("tiles")).filter(worth).select("group", "tiles")
    dealt = hot_join(cells, tiles, "group").withColumn("tile", F.pmod(F.xxhash64("id"), "tiles").cast("int"))
    dealt = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select("band", "cell", F.least("tile", "with").alias("one"), F.greatest("tile", "with").alias("two"), "tile", "own", "id", "n", "class")
    of_text = members.groupBy("id").agg(F.collect_list("band").alias("bands"))
    dealt = dealt.join(texts.select("id", "map").join(of_text, "id"), "id")
    pairs = materialise(dealt.groupBy("band", "cell", "one", "two").applyInArrow(_possible_pairs, "a long, b long"), "near-pairs")
    links = _verified(pairs, texts)
    forget(members, cells, pairs)
    return links


def _texts_and_rows(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(node, digest, id, copies, class) of every distinct text with its least id, and (id, digest) of every row."""
    rows = docs.select(F.col(key).cast("long").alias("id"), text_digest(F.col(text)).alias("digest"), F.col(text).alias("text"))
    sketched = rows.mapInArrow(_sketch, "id long, digest binary, n long, bands array<long>")
    sketched = materialise(sketched, "near-sketches")
    reps = sketched.groupBy("digest").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    # numbers of texts, not their ids, which may be null or shared; written, so that they stay
    reps = materialise(reps.select(F.monotonically_increasing_id().alias("node"), "*"), "near-texts")
    posted = materialise(reps.filter("n > 0").select(F.col("node").alias("id"), "n", F.explode("bands").alias("band")), "near-bands")
    # sign tells buckets of the same texts
    buckets = posted.groupBy("band").agg(F.min("id").alias("a"), F.count(F.lit(1)).alias("size"), F.bit_xor(F.xxhash64("id")).alias("sign")).filter("size > 1")
    buckets = materialise(buckets, "near-buckets")
    stars = materialise(hot_join(posted, buckets.select("band", "a"), "band").filter("id <> a").select("a", F.col("id").alias("b")).distinct(), "near-stars")
    nodes = stars.select(F.col("a").alias("node")).union(stars.select("b")).distinct()
    nodes = materialise(nodes.join(reps.select("node", "digest", "n", F.col("id").alias("own")), "node"), "near-nodes")
    wanted = docs.sparkSession.sparkContext.broadcast(key_bitmap(nodes.select(F.xxhash64("digest", "own").alias("key"))))
    found = rows.select("id", F.xxhash64("digest", "id").alias("key"), "text", "digest").mapInArrow(_mapped(wanted), "id long, digest binary, text string, map binary")
    same = (nodes["digest"] == found["digest"]) & nodes["own"].eqNullSafe(found["id"])
    texts = materialise(nodes.join(found, same).select(F.col("node").alias("id"), "n", "text", "map").dropDuplicates(["id"]), "near-wanted")
    wanted.unpersist()
    links = _verified(stars, texts)
    classes = connected_components(links)
    more = _links_within(posted, buckets, texts, classes)
    if more.limit(1).count():
        first, classes = classes, connected_components(links.union(more))
        forget(first)
    forget(posted, buckets, stars, nodes, texts, links, more)
    classes = classes.withColumnRenamed("id", "node")
    linked = reps.select("node", "digest", "id", "copies").join(classes, "node", "left").withColumn("class", F.coalesce("class", "node"))
    return linked, sketched.select("id", "digest")


def near_classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, class_id, copies) of every row: the class, and how many rows have the same text."""
    texts, rows = _texts_and_rows(docs, key, text)
    named = texts.join(texts.groupBy("class").agg(F.min("id").alias("class_id")), "class")
    return hot_join(rows, named.select("digest", "class_id", "copies"), "digest").select("id", "class_id", "copies")


def op10_near_dedup(spark, sf_dir) -> DataFrame:
    return near_classes(read_table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "class_id", "copies")


@pipeline_stage
def near_stage(spark, docs: DataFrame, sf_dir) -> DataFrame:
    """Pipeline stage: of each class one row stays, that of the least id (null last), then the least digest."""
    texts, _ = _texts_and_rows(docs, "doc_id", "text")
    first = texts.groupBy("class").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "digest")).alias("k")).select(F.col("k.id").alias("__id"), F.col("k.digest").alias("__kept"))
    rows = docs.withColumn("__digest", text_digest(F.col("text")))
    kept = rows.join(first, F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.col("__digest") == F.col("__kept")), "left_semi")
    return kept.dropDuplicates(["doc_id", "__digest"]).select(*docs.columns)
