"""Lexical search by scans of the texts: results against brute force, and how much it shuffles."""

import collections
import math
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from blockrank.functions import porter
from blockrank.operators import blocks as B
from blockrank.operators import lexical as L
from blockrank.operators import scan


def _written(spark) -> int:
    """Bytes that this session has shuffled so far."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    return spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()


@pytest.fixture
def large(spark):
    """Tables are joined as large ones are: by shuffles."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def _texts(n: int, groups: int = 5, words: int = 20) -> list[str]:
    """Texts of five groups, each with words of its own that all of its texts have."""
    rng = random.Random(n)
    return [" ".join([*(f"g{i % groups}w{j}" for j in range(words)), *(f"own{rng.randrange(n)}" for _ in range(8))]) for i in range(n)]


def _frame(spark, texts):
    return spark.createDataFrame([(i, f"n{i % 3}", t) for i, t in enumerate(texts)], "block_uid long, note_path string, clean_text string")


def test_a_search_shuffles_no_row_for_each_hit(spark, large):
    """Each query has 16 words that a fifth of the texts have: 0.8 million hits, of which 4 * 5 of a query are kept."""
    blocks = _frame(spark, _texts(500))
    before = _written(spark)
    index = L.build_index(blocks)
    found = L.lexical_search(blocks.select(F.col("block_uid").alias("query_id"), F.col("clean_text").alias("text")), index, 5)
    assert found.count() == 2500
    index.close()
    assert _written(spark) - before < 2_500_000


def test_bm25_equals_brute_force_in_slices_and_passes(spark, monkeypatch):
    texts = [*_texts(150), *_texts(150)[:20], "", "own1 own1 own1 g0w1 own2"]
    words = [re.findall(r"[0-9a-z_]+", t) for t in texts]
    df = collections.Counter(w for ws in words for w in set(ws))
    mean = sum(map(len, words)) / len(words)
    queries = {100 + i: sorted(set(ws))[::3] for i, ws in enumerate(words[:40])}
    want = {}
    for q, ws in queries.items():
        scores = []
        for i, own in enumerate(words):
            tf = collections.Counter(own)
            parts = [max(1e-6, math.log((len(words) - df[w] + 0.5) / (df[w] + 0.5))) * tf[w] * 2.2 / (tf[w] + 1.2 * (0.25 + 0.75 * len(own) / mean)) for w in ws if tf[w]]
            scores += [(-round(sum(parts), 10), i)] if parts else []
        want |= {(q, i): (n, -s) for n, (s, i) in enumerate(sorted(scores)[:7], 1)}
    rows = [(q, w, w, df[w]) for q, ws in queries.items() for w in ws]
    for slice_words, tokens, places in ((2_000_000, 4_000_000, 4_000_000), (100, 60, 70)):
        monkeypatch.setattr(scan, "SLICE_WORDS", slice_words)
        monkeypatch.setattr(scan, "PASS_TOKENS", tokens)
        monkeypatch.setattr(scan, "PASS_PLACES", places)
        tokens_of = spark.createDataFrame(rows, "query_id long, token string, term string, df long")
        for uid in ("long", "string"):
            name = F.format_string("%05d", "block_uid") if uid == "string" else F.col("block_uid")
            index = L.build_index(_frame(spark, texts).withColumn("block_uid", name).repartition(3))
            got = {(r.query_id, int(r.block_uid)): (r.rn, r.bm25) for r in L.bm25_top(tokens_of, index, 7).collect()}
            assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 2e-10 for k in want)
    assert L.bm25_top(tokens_of.limit(0), index, 7).count() == 0


def test_equal_queries_are_searched_once_and_all_answered(spark):
    blocks = _frame(spark, _texts(60))
    index = L.build_index(blocks)
    asked = spark.createDataFrame([(1, "own1 g0w1 own7"), (2, "g1w3 own4"), (3, "own1 g0w1  own7 of"), (4, "own7 g0w1 own1"), (5, ""), (6, "nothing")], "query_id long, text string")
    same = {r.query_id: r.same for r in L._same_queries(L.query_terms(asked).withColumn("nth", F.col("pos"))).collect()}
    assert same == {1: 1, 2: 2, 3: 1, 4: 4, 6: 6}
    hits = {q: [] for q in range(7)}
    for r in L.lexical_search(asked, index, 4).orderBy("query_id", "lex_rank").collect():
        hits[r.query_id].append((r.block_uid, r.lex_score))
    assert hits[1] and hits[1] == hits[3] and hits[2] and not hits[5] and not hits[6]


def _long_words(n):
    """Texts whose words each occur twice, and stems as often as words."""
    return [" ".join(f"{a}{b}ing {a}{b}ed" for a in "bcdfghjk" for b in ("ola", "uni", "ano", "eri", "uta", "omi")) for _ in range(n)]


def test_phrases_are_found_without_postings_of_all_words(spark, large):
    blocks = _frame(spark, [*_long_words(800), "x y z", "y x x y", "x y x_y"])
    asked = spark.createDataFrame([(1, "xxx y_x x_y"), (2, "bolaing_bolaed")], "query_id long, text string")
    before = _written(spark)
    tokens, index = L.with_phrases(L.query_terms(asked), L.positional_index(blocks))
    known = L.token_df(tokens, index).persist()
    assert {r.token: r.df for r in known.collect()} == {"xxx": 0, "y_x": 2, "x_y": 3, "bolaing_bolaed": 800}
    found = {(r.query_id, r.block_uid) for r in L.bm25_top(known, index, 5).collect()}
    assert found == {(1, 800), (1, 801), (1, 802), (2, 0), (2, 1), (2, 2), (2, 3), (2, 4)}
    known.unpersist()
    assert _written(spark) - before < 300_000


def test_stems_are_found_without_postings_of_all_words(spark, large):
    blocks = _frame(spark, [*_long_words(800), "hopeful hoping hopes", "hope"])
    asked = spark.createDataFrame([(1, "hoped"), (2, "bola"), (3, "none such_thing")], "query_id long, text string")
    before = _written(spark)
    index = porter.stemmed_index(blocks)
    tokens, index = L.with_phrases(L.query_terms(asked), index)
    known = L.token_df(tokens, index).persist()
    assert {r.token: r.df for r in known.collect()} == {"hoped": 2, "bola": 800, "none": 0, "such_thing": 0}
    assert {(r.query_id, r.block_uid) for r in L.bm25_top(known, index, 2).collect()} == {(1, 800), (1, 801), (2, 0), (2, 1)}
    known.unpersist()
    assert _written(spark) - before < 300_000


def test_a_text_of_many_sentences_is_cut_in_time(spark):
    """The fold over a text's sentences carried all cuts and lengths along: its work grew with the square of a text."""
    texts = [" ".join(f"s{i % 97} w{i % 11}." for i in range(20_000)) for _ in range(4)]
    blocks = spark.createDataFrame([(f"n:{i}", str(i), t) for i, t in enumerate(texts)], "block_uid string, block_id string, clean_text string")
    B.split_overlapping(blocks.limit(1)).count()
    began = time.time()
    parts = B.split_overlapping(blocks).select("block_uid", F.length("clean_text").alias("n")).collect()
    assert time.time() - began < 4 and all(0 < r.n <= 1200 for r in parts) and len(parts) > 4 * 140
