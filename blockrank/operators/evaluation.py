"""Evaluation of retrieval against the links that notes have: references, data set, predictions, metrics, grid, report."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import links as K

TOP = 10


def note_references(notes: DataFrame) -> DataFrame:
    """notes(path, body) -> for every note under `cs/`: targets (sorted), internal and external links (raw, resolved), ignored
    ones (raw, reason), each in the note's order."""
    own = notes.filter(F.col("path").startswith("cs/")).select("path", "body")
    raw = K.raw_targets(own, place=True)
    found = raw.join(K.resolve_targets(raw.select("path", "raw").distinct(), notes), ["path", "raw"])
    inside, outside = F.col("status") == "resolved_internal", F.col("status") == "resolved_external"
    link = F.struct("no", "raw", F.col("resolved"))
    ignored = F.struct("no", "raw", F.col("status").alias("reason"))
    in_order = lambda when, what, names: F.transform(F.array_sort(F.collect_list(F.when(when, what))), lambda x: F.struct(*(x[n].alias(n) for n in names)))
    per = found.groupBy("path").agg(
        F.array_sort(F.collect_set(F.when(inside & (F.col("resolved") != F.col("path")), F.col("resolved")))).alias("targets"),
        in_order(inside, link, ("raw", "resolved")).alias("internal"),
        in_order(outside, link, ("raw", "resolved")).alias("external"),
        in_order(~inside & ~outside, ignored, ("raw", "reason")).alias("ignored"),
    )
    out = own.select("path").join(per, "path", "left")
    empty = {"targets": "array<string>", "internal": "array<struct<raw:string,resolved:string>>", "external": "array<struct<raw:string,resolved:string>>", "ignored": "array<struct<raw:string,reason:string>>"}
    return out.select("path", *(F.coalesce(c, F.array().cast(kind)).alias(c) for c, kind in empty.items()))


def data_set(notes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped): kept notes with all of note_references and their body without note links; dropped ones refer to a
    note outside `cs/`. Kept notes with targets are the ones to evaluate."""
    found = note_references(notes)
    alone = F.size("external") == 0
    kept = found.filter(alone).drop("external").join(K.strip_link_column(notes.select("path", "body")), "path")
    return kept, found.filter(~alone).select("path", "external")


def prediction_table(predictions: DataFrame, truth: DataFrame, *by: str) -> DataFrame:
    """predictions(query_id, target, rank), truth(query_id, target) -> for each query with truth: targets, predicted (in
    order), hits_5, hits_10, misses_10, false_positives_10. by: further columns of predictions that tell runs apart."""
    want = truth.groupBy("query_id").agg(F.array_sort(F.collect_set("target")).alias("targets"))
    ranked = predictions.groupBy(*by, "query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "target"))), lambda x: x["target"]).alias("predicted"))
    each = want.crossJoin(F.broadcast(predictions.select(*by).distinct())) if by else want
    none = F.array().cast(ranked.schema["predicted"].dataType)
    t = each.join(ranked, [*by, "query_id"], "left").withColumn("predicted", F.coalesce("predicted", none))
    top = lambda k: F.slice("predicted", 1, k)
    sets = {"hits_5": F.array_intersect("targets", top(5)), "hits_10": F.array_intersect("targets", top(TOP)), "misses_10": F.array_except("targets", top(TOP)), "false_positives_10": F.array_except(top(TOP), F.col("targets"))}
    return t.select(*by, "query_id", "targets", "predicted", *(F.array_sort(v).alias(k) for k, v in sets.items()))


def table_metrics(table: DataFrame, *by: str) -> DataFrame:
    """One row (for each run) of averages over the queries of a prediction table."""
    n = lambda c: F.size(c).cast("double")
    first = lambda c: F.greatest(F.lit(1), F.least(F.size("predicted"), F.lit(c)))
    ranks = F.filter(F.transform("predicted", lambda x, i: F.when(F.array_contains(F.col("targets"), x), i + 1)), lambda i: i.isNotNull())
    x = table.withColumn("first", F.get(ranks, F.lit(0)))
    mean = lambda c, name: F.round(F.avg(c), 6).alias(name)
    yes = lambda c: (F.size(c) > 0).cast("double")
    averages = x.groupBy(*by).agg(
        F.count(F.lit(1)).alias("dataset_note_count"),
        mean(n("targets"), "avg_gt_links_per_note"),
        mean(yes("hits_5"), "hit_at_5"),
        mean(yes("hits_10"), "hit_at_10"),
        mean(n("hits_5") / n("targets"), "recall_at_5"),
        mean(n("hits_10") / n("targets"), "recall_at_10"),
        mean(n("hits_5") / first(5), "precision_at_5"),
        mean(n("hits_10") / first(TOP), "precision_at_10"),
        mean(F.coalesce(1 / F.col("first"), F.lit(0.0)), "mrr"),
        mean(yes("hits_10"), "coverage"),
    )
    candidates = table.select(*by, F.explode("predicted").alias("p")).distinct().groupBy(*by).agg(F.count(F.lit(1)).alias("candidate_note_count"))
    joined = averages.join(candidates, list(by), "left") if by else averages.crossJoin(candidates)
    return joined.withColumn("candidate_note_count", F.coalesce("candidate_note_count", F.lit(0).cast("long")))


def worst_misses(table: DataFrame, n: int = TOP) -> DataFrame:
    """The n queries with fewest hits, then most misses (a report)."""
    return table.orderBy(F.size("hits_10"), F.desc(F.size("misses_10")), "query_id").limit(n)


def worst_false_positives(table: DataFrame, n: int = TOP) -> DataFrame:
    return table.orderBy(F.desc(F.size("false_positives_10")), "query_id").limit(n)


def grid(run, settings: dict, truth: DataFrame) -> DataFrame:
    """run(settings) -> predictions. One row of metrics for each named setting, all settings in one plan."""
    every = None
    for name, one in settings.items():
        own = run(one).select("query_id", "target", "rank").withColumn("run", F.lit(name))
        every = own if every is None else every.unionByName(own)
    return table_metrics(prediction_table(every, truth, "run"), "run")


def report_text(metrics: dict, misses: list, wrong: list) -> str:
    lines = ["# Reference evaluation", "", *(f"- {k}: {v:.4f}" if isinstance(v, float) else f"- {k}: {v}" for k, v in metrics.items())]
    lines += ["", "## Worst misses", *(f"- {r.query_id}: hits_10={len(r.hits_10)}, misses_10={','.join(map(str, r.misses_10[:5]))}" for r in misses)]
    lines += ["", "## Worst false positives", *(f"- {r.query_id}: false_positives_10={','.join(map(str, r.false_positives_10[:5]))}" for r in wrong)]
    return "\n".join(lines) + "\n"


def write_report(table: DataFrame, path: str) -> dict:
    """The prediction table as JSON rows, the metrics as one JSON row and a short text, under path; the metrics."""
    spark = table.sparkSession
    table.write.mode("overwrite").json(f"{path}/predictions")
    stored = spark.read.schema(table.schema).json(f"{path}/predictions")
    metrics = table_metrics(stored).first().asDict()
    text = report_text(metrics, worst_misses(stored).collect(), worst_false_positives(stored).collect())
    for name, body in (("metrics", json.dumps(metrics)), ("report", text)):
        spark.createDataFrame([(body,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/{name}")
    return metrics
