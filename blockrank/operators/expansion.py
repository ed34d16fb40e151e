"""Query expansion and the merging of several candidate lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T


def expand_queries(queries: DataFrame, enabled: bool = True, max_variants: int = 4, min_token_length: int = 2) -> DataFrame:
    """queries(query_id, text) -> query_id, variant_idx, text, source, weight; blank texts give no row."""
    plain = T.squeeze(F.col("text"))
    base = queries.select("query_id", plain.alias("plain")).filter("plain <> ''").withColumn("tokens", T.all_matches(F.col("plain"), T.TOKEN))
    # each token once, in its first form and order; one pass over the tokens, whatever a query's length
    flat = base.select("query_id", F.posexplode("tokens").alias("pos", "token")).repartition("query_id").withColumn("low", F.lower("token"))
    once = flat.filter(F.length("token") >= min_token_length).groupBy("query_id", "low").agg(F.min(F.struct("pos", "token")).alias("first"))

    def keep(stop):
        kept = F.collect_list(F.when(~F.col("low").isin(stop), F.col("first")))
        return F.array_join(F.transform(F.array_sort(kept), lambda t: t["token"]), " ")

    texts = once.groupBy("query_id").agg(keep(T.EXPANSION_STOP + T.KEYWORD_STOP).alias("keyword"), keep(T.EXPANSION_STOP + T.COMPACT_STOP).alias("compact"))
    base = base.join(texts, "query_id", "left").fillna("", ["keyword", "compact"])
    first_word = F.lower(F.coalesce(F.get("tokens", F.lit(0)), F.lit("")))
    long_ = F.col("plain").contains("?") | (F.size("tokens") >= 7) | first_word.isin(T.QUESTION_WORDS)
    variants = [F.struct(F.lit(0).alias("i"), F.col("plain").alias("text"), F.lit("original").alias("source"), F.lit(1.0).alias("weight"))]
    if enabled:
        variants.append(F.struct(F.lit(1).alias("i"), F.col("keyword").alias("text"), F.lit("keyword").alias("source"), F.lit(0.85).alias("weight")))
        variants.append(F.struct(F.lit(2).alias("i"), F.when(long_, F.col("compact")).otherwise("").alias("text"), F.lit("compact").alias("source"), F.lit(0.7).alias("weight")))
    rows = base.select("query_id", F.inline(F.array(*variants))).filter("text <> ''")
    each = rows.withColumn("n", F.row_number().over(W.partitionBy("query_id", F.lower("text")).orderBy("i"))).filter("n = 1")
    order = F.row_number().over(W.partitionBy("query_id").orderBy("i"))
    return each.withColumn("variant_idx", order - 1).filter(F.col("variant_idx") < max(1, max_variants)).select("query_id", "variant_idx", "text", "source", "weight")


def merge_candidates(lists: DataFrame) -> DataFrame:
    """lists(query_id, list_idx, item_idx, block_uid) -> query_id, block_uid, hits, ord: more hits first, then
    the earlier list and place."""
    merged = lists.groupBy("query_id", "block_uid").agg(F.count(F.lit(1)).alias("hits"), F.min(F.struct("list_idx", "item_idx")).alias("at"))
    order = W.partitionBy("query_id").orderBy(F.desc("hits"), "at.list_idx", "at.item_idx")
    return merged.withColumn("ord", F.row_number().over(order)).select("query_id", "block_uid", "hits", "ord")


def merge_scored(lists: DataFrame, score: str) -> DataFrame:
    """The same order, each with the note and score of its best scored row (the first of equals)."""
    best = F.max_by(F.struct("note_path", score), F.struct(F.col(score), -F.col("list_idx"), -F.col("item_idx")))
    merged = lists.groupBy("query_id", "block_uid").agg(F.count(F.lit(1)).alias("hits"), F.min(F.struct("list_idx", "item_idx")).alias("at"), best.alias("best"))
    order = W.partitionBy("query_id").orderBy(F.desc("hits"), "at.list_idx", "at.item_idx")
    return merged.select("query_id", "block_uid", F.col("best.note_path").alias("note_path"), F.col(f"best.{score}").alias(score), F.row_number().over(order).alias("ord"))
