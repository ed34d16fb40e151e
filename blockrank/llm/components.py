"""Connected components of an edge list, without bringing edges to the driver, and joins on keys that may be hot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, materialise


def hot_keys(rows: DataFrame, key: str) -> DataFrame | None:
    """(key, __salts) of the keys that hold more than a quarter of a partition's even share of rows (256 at
    least), or None. There are at most four for each partition, whatever the table's size, so they may be
    broadcast. rows is a written table."""
    spark = rows.sparkSession
    limit = max(256, rows.count() // (4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    found = rows.groupBy(key).count().filter(F.col("count") > limit).select(key, F.ceil(F.col("count") / limit).cast("int").alias("__salts")).collect()
    return spark.createDataFrame(found, f"{key} {rows.schema[key].dataType.simpleString()}, __salts int") if found else None


def hot_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner", hot: DataFrame | None | bool = False) -> DataFrame:
    """left join right on key; right has each key once. The rows of a hot key are dealt out by a hash of the
    whole row, and the key's row of right goes to each of these parts."""
    hot = hot_keys(left, key) if hot is False else hot
    if hot is None:
        return left.join(right, key, how)
    salts = F.coalesce("__salts", F.lit(1))
    dealt = left.join(F.broadcast(hot), key, "left").withColumn("__salt", F.pmod(F.xxhash64(*left.columns), salts).cast("int")).drop("__salts")
    copied = right.join(F.broadcast(hot), key, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("__salts")
    return dealt.join(copied, [key, "__salt"], how).drop("__salt")


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges(a, b) -> (id, class): the least id of each component, for every id that has an edge.

    Each round takes the least class among a node and its neighbours, then the class of that class, so a
    long chain halves; rounds are written to the shared folder and end when no class changes. Nodes of many
    edges and classes of many nodes are split."""
    both = materialise(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).filter("a <> b").distinct(), "graph-edges")
    state = materialise(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("least")).select("id", F.least("id", "least").alias("class")), "graph-classes")
    hubs = hot_keys(both, "b")
    for _ in range(max_rounds):
        near = hot_join(both, state.select(F.col("id").alias("b"), "class"), "b", hot=hubs).groupBy(F.col("a").alias("id")).agg(F.min("class").alias("near"))
        moved = materialise(state.join(near, "id").select("id", F.col("class").alias("was"), F.least("class", "near").alias("class")), "graph-moved")
        if moved.filter("was <> class").limit(1).count() == 0:
            forget(both, moved)
            return state
        jump = moved.select(F.col("id").alias("class"), F.col("class").alias("next"))
        last, state = state, materialise(hot_join(moved.drop("was"), jump, "class", "left").select("id", F.coalesce("next", "class").alias("class")), "graph-classes")
        forget(last, moved)
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
