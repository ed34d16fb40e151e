"""Op 3: multi-party perspective rotation of conversations (DataFrame functions only).

For every participant of a conversation the dialogue is rendered with that speaker as `assistant` and
every other speaker as a named `user`; `spans` holds the character ranges of the text that the
perspective's speaker wrote (and its end mark), the rest is masked out of training.

A dialogue is rendered in parts: part b.c holds the messages of the b-th run of `part_turns` turn
numbers, cut again after each `part_turns` messages where turn numbers repeat. With a `part_turns` of at least
the longest dialogue, each dialogue is one part. A long dialogue's runs are tasks of their own; messages that
share a run of turn numbers (all those with a null turn, too) are numbered in one task, which sorts on disk
where they are many. Nothing is dropped.

Defined results: messages are ordered by turn (null turns last, as block 2**62), then role, then
text; repeated rows are repeated messages; a null or empty role is the speaker `unknown`, who is a named
user but no perspective; `system` messages stay system messages and are no perspective; null text is
empty; a conversation whose only speakers are system or unknown has no perspective, hence no row; null
conv_ids make one conversation; marks inside a text are escaped. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import read_table

PART_TURNS = 64
NULL_BLOCK = 2**62


def rotate(conversations: DataFrame, part_turns: int = PART_TURNS) -> DataFrame:
    """(conv_id, block, cut, perspective, n_messages, text, spans array<struct<start, end>>)."""
    role = F.when(F.coalesce(F.col("role"), F.lit("")) == "", F.lit("unknown")).otherwise(F.col("role"))
    text = F.replace(F.coalesce(F.col("text"), F.lit("")), F.lit("<|im_"), F.lit("<\\|im_"))
    said = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    said = said.withColumn("block", F.coalesce(F.floor(F.col("turn") / part_turns), F.lit(NULL_BLOCK)))
    order = W.partitionBy("conv_id", "block").orderBy(F.col("turn").asc_nulls_last(), "role", "text")
    said = said.withColumn("n", F.row_number().over(order)).withColumn("cut", F.floor((F.col("n") - 1) / part_turns).cast("int"))
    parts = said.groupBy("conv_id", "block", "cut").agg(F.array_sort(F.collect_list(F.struct("n", "role", "text"))).alias("messages"))
    people = conversations.select("conv_id", role.alias("perspective")).distinct().filter("perspective not in ('system', 'unknown')")
    both = parts.join(people, parts.conv_id.eqNullSafe(people.conv_id)).select(parts.conv_id, "block", "cut", "perspective", "messages")

    def head(m):
        mine = F.when(m["role"] == F.col("perspective"), F.lit("assistant")).when(m["role"] == "system", F.lit("system")).otherwise(F.concat(F.lit("user name="), m["role"]))
        return F.concat(F.lit("<|im_start|>"), mine, F.lit("\n"))

    pieces = both.withColumn("pieces", F.transform("messages", lambda m: F.struct(head(m).alias("head"), F.concat(m["text"], F.lit("<|im_end|>\n")).alias("body"), (m["role"] == F.col("perspective")).alias("mine"))))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(a, p):
        start = a["at"] + F.length(p["head"])
        end = start + F.length(p["body"])
        return F.struct(end.alias("at"), F.when(p["mine"], F.concat(a["spans"], F.array(F.struct(start.alias("start"), (end - 1).alias("end"))))).otherwise(a["spans"]).alias("spans"))

    return pieces.select("conv_id", "block", "cut", "perspective", F.size("messages").alias("n_messages"), F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"])), "").alias("text"), F.aggregate("pieces", begin, step)["spans"].alias("spans"))


def op3_chat_rotation(spark, sf_dir) -> DataFrame:
    spans = F.array_join(F.transform("spans", lambda s: F.concat(s["start"], F.lit(":"), s["end"])), ";")
    return rotate(read_table(spark, sf_dir, "conversations")).select("conv_id", "block", "cut", "perspective", F.col("n_messages").cast("long").alias("n_messages"), F.sha2("text", 256).alias("text_sha256"), spans.alias("spans"))


SQL = """
with said as (
  select conv_id, turn, case when coalesce(role, '') = '' then 'unknown' else role end as role,
    replace(coalesce(text, ''), '<|im_', '<\\|im_') as text,
    coalesce(cast(floor(turn / 64) as bigint), 4611686018427387904) as block from conversations),
numbered as (select *, row_number() over (partition by conv_id, block order by turn nulls last, role, text) as n from said),
people as (select distinct conv_id, role as perspective from said where role not in ('system', 'unknown')),
pieces as (
  select m.conv_id, block, cast(floor((n - 1) / 64) as integer) as cut, perspective, n, role = perspective as mine,
    '<|im_start|>' || case when role = perspective then 'assistant' when role = 'system' then 'system' else 'user name=' || role end || chr(10) as head,
    text || '<|im_end|>' || chr(10) as body
  from numbered m join people p on m.conv_id is not distinct from p.conv_id),
placed as (select *, coalesce(sum(length(head) + length(body)) over (partition by conv_id, block, cut, perspective order by n rows between unbounded preceding and 1 preceding), 0) as pos from pieces)
select conv_id, block, cut, perspective, count(*) as n_messages, sha256(string_agg(head || body, '' order by n)) as text_sha256,
  coalesce(string_agg(case when mine then cast(pos + length(head) as bigint) || ':' || cast(pos + length(head) + length(body) - 1 as bigint) end, ';' order by n), '') as spans
from placed group by conv_id, block, cut, perspective
"""
