"""Op 8: benchmark decontamination by SimHash of item-sized windows (DataFrame functions only).

Words are runs of letters and digits, lower-cased; shingles are runs of five words (all words of a
shorter item), weighted by their count in a window. A document's window is as long as the benchmark item
it is held against. Windows that share no shingle with any item cannot reach the similarity, so only the
places of a document whose shingle passes a fixed-size bitmap of the items' shingles are looked at, and
an exact join on the shingle gives the starts of windows, (item length, first word). Where these differ (words
were inserted, deleted or moved), every start between two neighbours is tried too. Windows with too few such
places for the similarity are left out; all others are judged, equal windows once.

Each distinct window gets a 64-bit SimHash of its weighted shingles. The fingerprint is cut into BLOCKS
blocks; two fingerprints within RADIUS bits agree in some block up to RADIUS // BLOCKS bits, so the items
are listed under every value of each block that near to theirs, and an equality join on (words of the item,
block, value) meets all items of the window's own length within the radius. Candidates are verified by exact weighted Jaccard similarity of the
shingles, min over max of counts, at least 0.8. The radius lies far outside the distances that such a
similarity gives (a window at 0.8 lies beyond it with a chance below 1e-3).

Defined results: null and empty texts have no windows and no hits; an item without words meets nothing; an
item of fewer than five words meets windows of exactly its words; repeated rows are each judged and give
one result each; empty tables give an empty result; other columns are not read by `contaminated`.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, pipeline_stage, read_table, text_digest

K, SIMILARITY, BLOCKS, RADIUS, BITMAP_BITS = 5, 0.8, 5, 19, 19
#: Items are broadcast while their shingles are at most so many; beyond that, the joins shuffle.
BROADCAST_SHINGLES = 200_000
_CUTS = tuple((round(64 * b / BLOCKS), round(64 * (b + 1) / BLOCKS)) for b in range(BLOCKS))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def shingles_of(words: Column, k: int = K) -> Column:
    """Hashes of the k-word shingles in order; of all words where there are fewer, none of none."""
    n = F.size(words)
    many = F.transform(F.sequence(F.lit(0), F.greatest(n - k, F.lit(0))), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(k)]))
    return F.when(n >= k, many).when(n > 0, F.array(F.xxhash64(words))).otherwise(F.array().cast("array<bigint>"))


def simhash(shingles: Column) -> Column:
    """One bit for each bit position: whether more shingles have it than not."""
    n = F.size(shingles)
    bits = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda b: F.when(2 * F.aggregate(shingles, F.lit(0), lambda a, h: a + F.getbit(h, b).cast("int")) > n, F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))


def block_values(fingerprint: Column) -> Column:
    """array<struct<block, value>> of a fingerprint's own blocks."""
    return F.array(*[F.struct(F.lit(i).alias("block"), F.shiftrightunsigned(fingerprint, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1).cast("long")).alias("value")) for i, (lo, hi) in enumerate(_CUTS)])


def near_values(items: DataFrame) -> DataFrame:
    """Every item under all values of each block within RADIUS // BLOCKS bits of its own."""
    spark = items.sparkSession
    masks = []
    for i, (lo, hi) in enumerate(_CUTS):
        for r in range(RADIUS // BLOCKS + 1):
            masks += [(i, sum(1 << b for b in c)) for c in combinations(range(hi - lo), r)]
    flips = F.broadcast(spark.createDataFrame(masks, "block int, flip long"))
    own = items.select("item_id", "n", "print", F.explode(block_values(F.col("print"))).alias("b")).select("item_id", "n", "print", "b.block", "b.value")
    return own.join(flips, "block").select("item_id", "n", F.col("print").alias("item_print"), "block", F.col("value").bitwiseXOR(F.col("flip")).alias("value"))


def met_in_blocks(prints: DataFrame, items: DataFrame) -> DataFrame:
    """prints(id, n, print), items(item_id, n, print): a row for each block in which a window's print comes near that
    of an item of its own length n."""
    blocks = prints.select("id", "n", "print", F.inline(block_values(F.col("print"))))
    return blocks.join(near_values(items), ["n", "block", "value"])


def weighted_jaccard(a: Column, b: Column) -> Column:
    """Sum of least counts over sum of greatest counts of two arrays of shingles."""
    both = F.array_distinct(F.array_intersect(a, b))
    times = lambda s, h: F.size(F.filter(s, lambda x: x == h))
    common = F.aggregate(both, F.lit(0), lambda acc, h: acc + F.least(times(a, h), times(b, h)))
    return common / (F.size(a) + F.size(b) - common)


def prepare_items(benchmark: DataFrame) -> DataFrame:
    """(item_id, n words, shingles, print) of every item with a word."""
    items = benchmark.select("item_id", words_of(F.col("text")).alias("words")).withColumn("n", F.size("words")).filter("n > 0")
    return items.withColumn("shingles", shingles_of(F.col("words"))).withColumn("print", simhash(F.col("shingles"))).drop("words")


def _slots(h: Column) -> list[Column]:
    """The two bits of a shingle's hash in the bitmap."""
    mask = F.lit((1 << BITMAP_BITS) - 1).cast("long")
    return [h.bitwiseAND(mask), F.shiftrightunsigned(h, 32).bitwiseAND(mask)]


def _bitmap(keys: DataFrame) -> DataFrame:
    """One row: a bitmap of BITMAP_BITS bits, as an array of longs. Its size does not depend on the keys."""
    words = 1 << (BITMAP_BITS - 6)
    set_ = keys.select(F.explode(F.array(*_slots(F.col("h")))).alias("slot")).distinct().select(F.shiftright("slot", 6).cast("int").alias("w"), F.col("slot").bitwiseAND(F.lit(63).cast("long")).cast("int").alias("b"))
    filled = set_.groupBy("w").agg(F.bit_or(F.expr("shiftleft(1L, b)")).alias("bits"))
    every = keys.sparkSession.range(words).select(F.col("id").cast("int").alias("w")).join(filled, "w", "left").select("w", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))
    return every.agg(F.transform(F.array_sort(F.collect_list(F.struct("w", "bits"))), lambda x: x["bits"]).alias("bitmap"))


def _starts(hits: DataFrame) -> DataFrame:
    """hits(row, size, n, at, first): a place in a row of that size and where an item of n words would begin
    -> (row, n, first, through): every start whose window can reach the similarity, and a place in it.

    A window that begins before (after) all the starts of its own places doesn't lose by moving right (left).
    So the best one lies at a start or between two neighbours; these are within two windows of each other. The
    common shingles of a window are at most its places."""
    grams = lambda words: F.greatest(words - (K - 1), F.lit(1))
    inside = F.greatest(F.lit(0), F.least("first", F.col("size") - F.col("n")))
    own = Window.partitionBy("row", "n")
    begins = hits.select("row", "n", "size", inside.alias("first")).distinct().withColumn("next", F.lead("first").over(own.orderBy("first")))
    upto = F.when(F.col("next") - F.col("first") <= 2 * grams(F.col("n")), F.col("next") - 1).otherwise(F.col("first"))
    tried = begins.select("row", "n", F.explode(F.sequence("first", upto)).alias("first"), grams(F.least("n", "size")).alias("held"))
    # each start asks for the places before its window and those up to its last shingle
    asked = tried.select("row", "n", F.explode(F.array(*[F.struct((F.col("first") - 1 + held).alias("pos"), F.lit(1).alias("ask"), "first", "held", F.lit(side).alias("side")) for side, held in ((-1, F.lit(0)), (1, F.col("held")))])).alias("a")).select("row", "n", "a.*")
    seen = hits.select("row", "n", F.col("at").alias("pos")).distinct().select("row", "n", "pos", F.lit(0).alias("ask"), *(F.lit(None).cast("int").alias(c) for c in ("first", "held", "side")))
    past = own.orderBy("pos", "ask").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = asked.unionByName(seen).withColumns({"upto": F.sum(1 - F.col("ask")).over(past), "last": F.max(F.when(F.col("ask") == 0, F.col("pos"))).over(past)}).filter("ask = 1")
    counted = both.groupBy("row", "n", "first", "held").agg(F.sum(F.col("side") * F.coalesce("upto", F.lit(0))).alias("common"), F.max("last").alias("through"))
    return counted.filter(F.col("common") * (1 + SIMILARITY) >= SIMILARITY * (grams(F.col("n")) + F.col("held")) - 1e-9).select("row", "n", "first", "through")


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, item_id, first_word, similarity, distance): one row for each row of docs and each item in it,
    with the best window."""
    items = materialise(prepare_items(benchmark), "bench-items")
    known = items.select("item_id", "n", F.posexplode("shingles").alias("at", "h"))
    starts = materialise(known.select("n", "at", "h").distinct(), "bench-shingles")
    few = starts.count() <= BROADCAST_SHINGLES
    small = F.broadcast if few else (lambda x: x)
    longest = items.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    if not longest:
        return docs.select(key).limit(0).select(F.col(key), F.lit(0).cast("long").alias("item_id"), F.lit(0).alias("first_word"), F.lit(0.0).alias("similarity"), F.lit(0).alias("distance"))
    bitmap = materialise(_bitmap(starts.select("h")), "bench-bitmap")
    short = [r.n for r in items.filter(F.col("n") < K).select("n").distinct().collect()]  # at most four lengths

    held = docs.select(F.col(key).alias("key"), words_of(F.col(text)).alias("words"), F.monotonically_increasing_id().alias("row"))
    held = held.withColumn("bitmap", bitmap.scalar())
    last = F.size("words")
    # (hash, place) of every run of five words and, where items are shorter, of their lengths
    runs = F.transform(F.sequence(F.lit(0), F.greatest(last - K, F.lit(0))), lambda i: F.struct(F.xxhash64(*[F.get("words", i + j) for j in range(K)]).alias("h"), i.alias("at")))
    runs = F.when(last >= K, runs).otherwise(F.array().cast("array<struct<h:bigint,at:int>>"))
    def whole_runs(n: int) -> Column:
        own = F.transform(F.sequence(F.lit(0), F.greatest(last - n, F.lit(0))), lambda i: F.struct(F.xxhash64(F.slice("words", i + 1, F.lit(n))).alias("h"), i.alias("at")))
        return F.when(last >= n, own).otherwise(F.array().cast("array<struct<h:bigint,at:int>>"))

    for n in short:
        runs = F.concat(runs, whole_runs(n))
    bit = lambda slot: F.getbit(F.get("bitmap", F.shiftright(slot, 6).cast("int")), slot.bitwiseAND(F.lit(63).cast("long")).cast("int")) == 1

    def seen(r):
        one, two = _slots(r["h"])
        return bit(one) & bit(two)

    near = held.select("key", "row", "words", F.filter(runs, seen).alias("runs"))
    # places in tiles of a document; a tile keeps the words that any window through its places can hold
    tile = lambda r: F.floor(r["at"] / F.lit(longest)).cast("int")
    begin = lambda t: F.greatest((t - 1) * longest, F.lit(0))
    around = F.transform("runs", lambda r: F.struct(r["h"].alias("h"), r["at"].alias("at"), tile(r).alias("tile"), F.slice("words", begin(tile(r)) + 1, F.lit(3 * longest + K)).alias("near"), F.size("words").alias("size")))
    places = near.select("key", "row", F.inline(around))
    met = places.join(small(starts.withColumnRenamed("at", "item_at")), "h")
    tiles = met.groupBy("row", "tile").agg(F.first("key").alias("key"), F.first("size").alias("size"), F.first("near").alias("near"), F.collect_set(F.struct("n", "at", (F.col("at") - F.col("item_at")).alias("first"))).alias("hits"))
    tiles = materialise(tiles, "bench-tiles")
    hits = tiles.select("row", "size", F.inline("hits"))
    chosen = _starts(hits).withColumn("tile", F.floor(F.col("through") / F.lit(longest)).cast("int"))
    found = chosen.join(tiles.select("row", "tile", "key", "near"), ["row", "tile"]).withColumn("window", F.slice("near", F.col("first") - begin(F.col("tile")) + 1, F.col("n")))
    windows = materialise(found.select("row", "first", "n", "key", F.xxhash64("window", "n").alias("id"), "window"), "bench-windows")
    distinct = windows.groupBy("id").agg(F.first("window").alias("window"), F.first("n").alias("n"))
    printed = distinct.select("id", "n", shingles_of(F.col("window")).alias("shingles")).withColumn("print", simhash(F.col("shingles")))
    printed = materialise(printed, "bench-prints")
    close = met_in_blocks(printed, items).withColumn("distance", F.bit_count(F.col("print").bitwiseXOR(F.col("item_print")))).filter(F.col("distance") <= RADIUS).groupBy("id", "item_id").agg(F.min("distance").alias("distance"))
    judged = close.join(printed.select("id", "shingles"), "id").join(small(items.select("item_id", F.col("shingles").alias("item_shingles"))), "item_id")
    judged = judged.withColumn("similarity", weighted_jaccard(F.col("shingles"), F.col("item_shingles"))).filter(F.col("similarity") >= SIMILARITY)
    hits = windows.select("id", "row", "key", "first").join(judged.select("id", "item_id", "similarity", "distance"), "id")
    best = hits.groupBy("row", "item_id").agg(F.first("key").alias("key"), F.max(F.struct("similarity", (-F.col("first")).alias("f"), (-F.col("distance")).alias("d"))).alias("b"))
    return best.select(F.col("key").alias(key), "item_id", (-F.col("b.f")).alias("first_word"), F.col("b.similarity").alias("similarity"), (-F.col("b.d")).alias("distance"))


def op8_decontamination(spark, sf_dir) -> DataFrame:
    found = contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", F.col("first_word").cast("long").alias("first_word"), "similarity", F.col("distance").cast("long").alias("distance"))


@pipeline_stage
def decontaminate_stage(spark, docs: DataFrame, sf_dir) -> DataFrame:
    """Pipeline stage: rows that hold a benchmark item go, told apart by doc_id (which may be null) and text."""
    rows = docs.withColumn("__row", F.struct("doc_id", text_digest(F.col("text")).alias("digest")))
    found = contaminated(rows, read_table(spark, sf_dir, "benchmark"), "__row").select(F.col("__row.doc_id").alias("__id"), F.col("__row.digest").alias("__hit")).distinct()
    return rows.join(found, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__row.digest") == F.col("__hit")), "left_anti").select(*docs.columns)
