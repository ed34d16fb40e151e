"""Notes into blocks: lines, headings, paragraphs, merging, slicing, embedding inputs."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..shipping import ship_package

_ENDS = "\\n\\r\\x0B\\x0C\\x1c-\\x1e\\x85\\u2028\\u2029"
LINE = rf"[^{_ENDS}]*(?:\r\n|[{_ENDS}])|[^{_ENDS}]+"


def note_lines(notes: DataFrame) -> DataFrame:
    """notes(path, body) -> path, no, line (with its end), start (characters before it)."""
    lines = notes.select("path", F.posexplode(T.all_matches(F.col("body"), LINE)).alias("no", "line"))
    before = F.sum(F.length("line")).over(W.partitionBy("path").orderBy("no").rowsBetween(W.unboundedPreceding, -1))
    return lines.withColumn("start", F.coalesce(before, F.lit(0)))


def split_blocks(notes: DataFrame) -> DataFrame:
    """notes(path, body) -> raw blocks in order: paragraphs between blank lines and headings."""
    bare = T.squeeze_ends(F.col("line"))
    marks = T.squeeze_ends(F.regexp_extract(bare, r"(?U)^(#{1,6})\s+(.*)$", 2))
    level = F.length(F.regexp_extract(bare, r"(?U)^(#{1,6})\s+(.*)$", 1))
    lines = note_lines(notes).withColumns({"level": level, "title": marks, "cut": (bare == "") | (level > 0)})
    order = W.partitionBy("path").orderBy("no")
    upto = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    islands = lines.withColumn("island", F.sum(F.col("cut").cast("int")).over(upto))
    # the stack at a line: of each level the last title, unless a heading of a lower level came after it
    at = {n: F.last(F.when(F.col("level") == n, F.struct("no", "title")), ignorenulls=True).over(upto) for n in range(1, 7)}
    above = {n: F.coalesce(F.max(F.when((F.col("level") > 0) & (F.col("level") < n), F.col("no"))).over(upto), F.lit(-1)) for n in range(1, 7)}
    live = F.array(*(F.when(at[n]["no"] > above[n], at[n]["title"]) for n in range(1, 7)))
    stacked = islands.withColumn("heading_path", F.filter(live, lambda t: t.isNotNull()))
    # a block ends where the line that ends it begins, or at the end of the note
    stacked = stacked.withColumn("stop", F.col("start") + F.when(F.col("cut"), 0).otherwise(F.length("line")))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("no", "line"))), lambda x: x["line"]), "")
    grouped = stacked.filter(~F.col("cut")).groupBy("path", "island").agg(body.alias("text"), F.min("start").alias("char_start"), F.max("stop").alias("char_end"), F.first("heading_path").alias("heading_path"))
    raw = grouped.withColumn("raw_text", F.regexp_replace("text", r"^[\n]+|[\n]+$", "")).withColumn("clean_text", T.clean_text(F.col("raw_text"))).filter("clean_text <> ''")
    seq = F.row_number().over(W.partitionBy("path").orderBy("island"))
    last = T.squeeze_ends(F.element_at(F.split("raw_text", "\n"), -1))
    alone = F.regexp_extract(last, r"^\^([A-Za-z0-9\-_]+)$", 1)
    tail = F.regexp_extract("raw_text", r"(?U)\s\^([A-Za-z0-9\-_]+)\s*$", 1)
    named = raw.withColumn("ord", seq).withColumn("block_id", F.coalesce(F.nullif(alone, F.lit("")), F.nullif(tail, F.lit("")), F.format_string("auto-%05d", F.col("ord"))))
    return named.select(F.concat_ws(":", "path", "block_id").alias("block_uid"), F.col("path").alias("note_path"), "ord", "block_id", F.coalesce("heading_path", F.array().cast("array<string>")).alias("heading_path"), "raw_text", "clean_text", F.col("char_start").cast("int").alias("char_start"), F.col("char_end").cast("int").alias("char_end"))


def merge_short(blocks: DataFrame, min_chars: int = 80) -> DataFrame:
    """Blocks shorter than min_chars go to the block before; a note's first block never does."""
    order = W.partitionBy("note_path").orderBy("ord")
    opens = (F.length("clean_text") >= min_chars) | (F.row_number().over(order) == 1)
    grouped = blocks.withColumn("opens", opens).withColumn("grp", F.sum(F.col("opens").cast("int")).over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    first = lambda c: F.min_by(c, "ord").alias(c)
    raw = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "raw_text"))), lambda x: x["raw_text"]), "\n")
    merged = grouped.groupBy("note_path", "grp").agg(first("block_uid"), F.min("ord").alias("ord0"), first("block_id"), first("heading_path"), raw.alias("raw_text"), first("char_start"), F.max_by("char_end", "ord").alias("char_end"))
    return merged.withColumns({"ord": F.col("ord0"), "clean_text": T.clean_text(F.col("raw_text"))}).drop("grp", "ord0")


def split_long(blocks: DataFrame, max_chars: int = 1200) -> DataFrame:
    """Fixed slices of clean_text, in order; a short block stays as it is."""
    n = F.ceil(F.length("clean_text") / max_chars).cast("int")
    parts = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.substring("clean_text", i * max_chars + 1, F.lit(max_chars)))
    return _numbered(blocks.withColumn("parts", parts).select("*", F.posexplode("parts").alias("part", "slice"), F.size("parts").alias("n_parts")).drop("parts"))


def _numbered(out: DataFrame) -> DataFrame:
    """Ids of the parts of a block; a block of one part keeps its own."""
    many = F.col("n_parts") > 1
    number = (F.col("part") + 1).cast("string")
    return out.withColumns({"block_uid": F.when(many, F.concat("block_uid", F.lit(":part"), number)).otherwise(F.col("block_uid").cast("string")), "block_id": F.when(many, F.concat("block_id", F.lit("-part"), number)).otherwise(F.col("block_id")), "clean_text": F.col("slice")}).drop("slice", "n_parts")


#: A sentence with its end marks and the space behind them, or the rest of the text.
SENTENCE = "[^.!?。！？]*[.!?。！？]+ *|[^.!?。！？]+"


def _overlapping(max_chars: int, overlap: int):
    """The parts of a text, by sums of its pieces' lengths: the end of a part and the begin of the next are looked up in
    them, so the work is that of the text, however many parts it has."""
    sentences = re.compile(SENTENCE)

    def parts(text: str | None) -> list[str] | None:
        if text is None or len(text) <= max_chars:
            return text if text is None else [text.strip(" ")]
        ends = [0]
        for m in sentences.finditer(text):
            ends.extend(range(ends[-1] + max_chars, m.end(), max_chars))
            ends.append(m.end())
        out, at = [], 0
        while True:
            to = bisect_right(ends, ends[at] + max_chars) - 1
            out.append(text[ends[at] : ends[to]].strip(" "))
            if to == len(ends) - 1:
                return out
            at = bisect_left(ends, max(ends[to] - overlap, ends[to + 1] - max_chars), at + 1, to)

    return lambda texts: texts.map(parts, na_action=None)


def split_overlapping(blocks: DataFrame, max_chars: int = 1200, overlap: int = 120) -> DataFrame:
    """Long blocks in parts of whole sentences: a part takes sentences as long as it has at most max_chars characters,
    and the next one begins with the last sentences of it that have at most overlap characters together (fewer, if its
    first new sentence would not fit). A sentence of more than max_chars comes in slices of that length. A short
    block stays as it is, with its ids. Python gets the texts only, once each."""
    ship_package(blocks.sparkSession)
    cut = _overlapping(max_chars, overlap)

    @F.pandas_udf("array<string>")
    def parts(texts: pd.Series) -> pd.Series:
        return cut(texts)

    return _numbered(blocks.withColumn("parts", parts("clean_text")).select(*blocks.columns, F.posexplode("parts").alias("part", "slice"), F.size("parts").alias("n_parts")))


def finish(blocks: DataFrame) -> DataFrame:
    return blocks.withColumns({"block_hash": F.sha1("clean_text"), "token_count_est": T.token_estimate(F.col("clean_text"))})


def note_blocks(notes: DataFrame, min_chars: int = 80, max_chars: int = 1200) -> DataFrame:
    return finish(split_long(merge_short(split_blocks(notes), min_chars), max_chars))


def sliding_inputs(blocks: DataFrame, neighbors: int = 1, most: int = 2400) -> DataFrame:
    """blocks(note_path, ord, heading_path, clean_text) with embed_input: the block among its neighbours."""
    frame = W.partitionBy("note_path").orderBy("ord").rowsBetween(-max(0, neighbors), max(0, neighbors))
    near = F.transform(F.col("near"), lambda x: F.concat(F.when(x["ord"] == F.col("ord"), F.lit("Current: ")).otherwise(F.lit("Neighbor: ")), x["clean_text"]))
    head = T.heading_line(F.col("heading_path"))
    parts = F.concat(F.when(head == "", F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("Heading: "), head))), near)
    return blocks.withColumn("near", F.collect_list(F.struct("ord", "clean_text")).over(frame)).withColumn("embed_input", F.substring(F.array_join(parts, "\n"), 1, most)).drop("near")
