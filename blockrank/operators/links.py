"""Links of notes: extraction, resolution, the evaluation set, and its metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T

WIKI = r"(!)?\[\[([^\]]+)\]\]"
INLINE = r"\[([^\]]+)\]\(([^)]+)\)"
ANY_INLINE = r"!\[([^\]]*)\]\(([^)]+)\)|\[([^\]]+)\]\(([^)]+)\)"


def extract_links(notes: DataFrame) -> DataFrame:
    """notes(path, body) -> src_note_path, kind ('wiki' before 'md'), no, link_type, link_text, dst_note_path,
    dst_heading, dst_block_id."""
    wiki = notes.select("path", F.lit("wiki").alias("kind"), F.posexplode(T.all_matches(F.col("body"), WIKI)).alias("no", "m"))
    inner = F.regexp_extract("m", WIKI, 2)
    wiki = wiki.select("path", "kind", "no", F.when(F.col("m").startswith("!"), "embed").otherwise("wikilink").alias("link_type"), F.substring_index(inner, "|", 1).alias("raw"), F.when(F.instr(inner, "|") > 0, T.squeeze_ends(F.expr(r"substring(regexp_extract(m, '(!)?\\[\\[([^\\]]+)\\]\\]', 2), instr(regexp_extract(m, '(!)?\\[\\[([^\\]]+)\\]\\]', 2), '|') + 1)"))).alias("link_text"))
    md = notes.select("path", F.lit("md").alias("kind"), F.posexplode(T.all_matches(F.col("body"), INLINE)).alias("no", "m"))
    md = md.select("path", "kind", "no", F.lit("mdlink").alias("link_type"), F.regexp_extract("m", INLINE, 2).alias("raw"), F.regexp_extract("m", INLINE, 1).alias("link_text")).filter(~F.col("raw").rlike("^https?://"))
    target = T.link_target(F.col("raw"))
    both = wiki.unionByName(md).withColumn("t", target)
    return both.select(F.col("path").alias("src_note_path"), "kind", "no", "link_type", "link_text", F.col("t.path").alias("dst_note_path"), F.col("t.heading").alias("dst_heading"), F.col("t.block").alias("dst_block_id"))


def raw_targets(notes: DataFrame, place: bool = False) -> DataFrame:
    """path, raw (and no, its place): what every wikilink and inline link (images too) points at."""
    wiki = F.transform(T.all_matches(F.col("body"), WIKI), lambda m: T.squeeze_ends(F.substring_index(F.regexp_extract(m, WIKI, 2), "|", 1)))
    inline = F.transform(T.all_matches(F.col("body"), ANY_INLINE), lambda m: T.squeeze_ends(F.concat(F.regexp_extract(m, ANY_INLINE, 2), F.regexp_extract(m, ANY_INLINE, 4))))
    found = notes.select("path", F.posexplode(F.concat(wiki, inline)).alias("no", "raw")).filter("raw <> ''")
    return found if place else found.drop("no")


def resolve_targets(targets: DataFrame, notes: DataFrame) -> DataFrame:
    """targets(path, raw), notes(path) -> path, raw, status, resolved: the source's folder first, then `cs/`,
    then the target as it is; else a basename that only one note has."""
    t = targets.withColumn("kind", T.classify_target(F.col("raw"))).withColumn("norm", T.note_path(F.col("raw"), F.col("kind")))
    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    beside = F.when(folder == "", F.col("norm")).otherwise(F.concat_ws("/", folder, "norm"))
    options = F.when(F.col("norm").startswith("cs/"), F.array("norm")).otherwise(F.array(beside, F.concat(F.lit("cs/"), F.col("norm")), F.col("norm")))
    keyed = t.withColumn("options", options)
    paths = notes.select(F.col("path").alias("option"), F.lit(True).alias("known")).distinct()
    found = keyed.filter("norm is not null").select("path", "raw", F.posexplode("options").alias("n", "option")).join(paths, "option")
    first = found.groupBy("path", "raw").agg(F.min_by("option", "n").alias("direct"))
    base = lambda c: F.element_at(F.split(F.col(c), "/"), -1)
    names = notes.select("path").distinct().select(base("path").alias("base"), F.col("path").alias("only")).groupBy("base").agg(F.count(F.lit(1)).alias("same"), F.min("only").alias("only"))
    out = keyed.join(first, ["path", "raw"], "left").withColumn("base", base("norm")).join(names, "base", "left")
    resolved = F.coalesce("direct", F.when(F.col("same") == 1, F.col("only")))
    status = F.when(F.col("norm").isNull(), F.col("kind")).when(resolved.startswith("cs/"), "resolved_internal").when(resolved.isNotNull(), "resolved_external").when(F.col("same") > 1, "ambiguous_note_target").otherwise("unresolved_note_target")
    return out.select("path", "raw", status.alias("status"), resolved.alias("resolved"))


def evaluation_set(notes: DataFrame) -> DataFrame:
    """notes(path, body) -> path, target: the ground truth of the notes under `cs/` that refer to nothing outside."""
    own = notes.filter(F.col("path").startswith("cs/"))
    refs = resolve_targets(raw_targets(own).distinct(), notes)
    outside = refs.filter("status = 'resolved_external'").select("path").distinct()
    kept = refs.filter("status = 'resolved_internal' and resolved <> path").join(outside, "path", "left_anti")
    return kept.select("path", F.col("resolved").alias("target")).distinct()


def _replace_each(body: Column, pattern: str, new) -> Column:
    """body with every match m of pattern replaced by new(m): the parts between the matches, and the matches, in turn."""
    between, found = F.split(body, pattern, -1), T.all_matches(body, pattern)
    tails = F.zip_with(found, F.slice(between, 2, F.size(found)), lambda m, after: F.concat(new(m), after))
    return F.concat(F.get(between, F.lit(0)), F.array_join(tails, ""))


def strip_links(body: Column) -> Column:
    """Note links become their visible text: the label, or what the target is called; other links stay."""

    def name_of(target: Column) -> Column:
        bare = T.strip_anchor(target)
        last = F.element_at(F.split(F.regexp_replace(bare, "/+$", ""), "/"), -1)
        return F.coalesce(F.nullif(F.substring(last, F.lit(1), F.length(last) - F.length(T.path_suffix(bare))), F.lit("")), bare)

    def is_note(target: Column) -> Column:
        return T.classify_target(target) == "markdown_note_target"

    def wiki(m: Column) -> Column:
        inner = T.squeeze_ends(F.regexp_extract(m, WIKI, 2))
        target = T.squeeze_ends(F.substring_index(inner, "|", 1))
        label = T.squeeze_ends(F.regexp_replace(inner, r"(?s)^[^|]*\|", ""))
        return F.when(~is_note(target), m).when(inner.contains("|"), label).otherwise(name_of(target))

    def inline(m: Column) -> Column:
        part = lambda a, b: T.squeeze_ends(F.concat(F.regexp_extract(m, ANY_INLINE, a), F.regexp_extract(m, ANY_INLINE, b)))
        label, target = part(1, 3), part(2, 4)
        return F.when(~is_note(target), m).when(label != "", label).otherwise(name_of(target))

    return _replace_each(_replace_each(body, WIKI, wiki), ANY_INLINE, inline)


def strip_link_column(notes: DataFrame) -> DataFrame:
    return notes.withColumn("body", strip_links(F.col("body")))


def metrics(predictions: DataFrame, truth: DataFrame) -> DataFrame:
    """predictions(query_id, target, rank), truth(query_id, target) -> one row of averages over truth's queries."""
    wanted = truth.distinct()
    sizes = wanted.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_true"))
    seen = predictions.join(wanted.withColumn("hit", F.lit(1)), ["query_id", "target"], "left").withColumn("hit", F.coalesce("hit", F.lit(0)))
    at = lambda k, c: F.sum(F.when(F.col("rank") <= k, c).otherwise(0))
    per = seen.groupBy("query_id").agg(at(5, F.col("hit")).alias("h5"), at(10, F.col("hit")).alias("h10"), at(5, F.lit(1)).alias("r5"), at(10, F.lit(1)).alias("r10"), F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first"))
    j = sizes.join(per, "query_id", "left").fillna(0, ["h5", "h10", "r5", "r10"])
    mean = lambda x, name: F.round(F.avg(x), 6).alias(name)
    one = lambda n: F.greatest(F.lit(1), F.col(n))
    return j.agg(
        mean((F.col("h5") > 0).cast("double"), "hit_at_5"), mean((F.col("h10") > 0).cast("double"), "hit_at_10"),
        mean(F.col("h5") / F.col("n_true"), "recall_at_5"), mean(F.col("h10") / F.col("n_true"), "recall_at_10"),
        mean(F.col("h5") / one("r5"), "precision_at_5"), mean(F.col("h10") / one("r10"), "precision_at_10"),
        mean(F.coalesce(1 / F.col("first"), F.lit(0.0)), "mrr"), mean((F.col("h10") > 0).cast("double"), "coverage"), mean(F.col("n_true").cast("double"), "avg_truth"),
    )


def worst(predictions: DataFrame, truth: DataFrame, n: int = 10) -> DataFrame:
    """The n queries with the most missed targets among their first ten (a report)."""
    top = predictions.filter("rank <= 10").select("query_id", "target")
    missed = truth.join(top, ["query_id", "target"], "left_anti").groupBy("query_id").agg(F.count(F.lit(1)).alias("missed"))
    return missed.orderBy(F.desc("missed"), "query_id").limit(n)


def order_rank(hits: DataFrame, by: str = "query_id") -> DataFrame:
    return hits.withColumn("rank", F.row_number().over(W.partitionBy(by).orderBy("ord")))
