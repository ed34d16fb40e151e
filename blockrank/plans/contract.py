"""Registered queries of the retrieval engine and the SQL that they are compared with.

The corpus of the hybrid queries: a block is a row of documents, its note is the source, its vector is the
row of embeddings with its id; the queries are the documents whose id is divisible by 50."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import DEFAULT
from ..functions import text as T
from ..operators import ann as A
from ..operators import blocks as B
from ..operators import evaluation as E
from ..operators import expansion as X
from ..operators import lexical as L
from ..operators import links as K
from ..operators import near as N
from ..operators import ranking as R
from ..operators import vectors as V
from ..sources import store as S
from ..sources import vault
from . import engine
from .oracle import SQL

EVERY = 50
LOW = replace(DEFAULT, threshold=0.05)
#: Notes of each document, with its id in place of %; the text of the document is the note `cs/x/dup`.
LINK_NOTES = [
    ("cs/a%.md", "See [[b%#Part one|the b]] and ![[img%.png]] [x](https://e.org/q) [y](c%.md#^k1) #tag/one [[32.4 x%]]"),
    ("cs/b%.md", "![pic](d%.md) [[ other% ]] [mail](mailto:q@e.org) [[#here]] a#no #yes"),
    ("cs/sub/c%.md", "[[../a%]] [[a%]] [[zz%]] [t]( b%.md ) [[dup%]]"),
    ("cs/x/dup%.md", None),
    ("cs/y/dup%.md", "[[cs/a%.md]] ![[b%#^id9|B]]"),
    ("other%.md", "[[cs/b%]] [[a%|]]"),
]
RAW_TARGETS = ["b%", " b%.md ", "", "https://e.org/%", "mailto:a@b%", "#top%", "#^k%", "pic%.PNG", "32.4 x%", "a%/b.md#h", "n%#^q", "x%.MD", ".hidden%", "/abs/note%", "t%."]
CLEAN = ["a <!-- x\ny --> b", "[[A|Bee]] and [[Cee]]", "![alt](p.png) [ lab ](u) [ ](v) ![](w)", "see https://e.org/x) end", "```\ncode\n``` tail", "  many \t spaces   here\n", "[[ A ]] x", "中文 [[甲|乙]] 文"]
PATHS = ["a%.md", ".trash/x%.md", ".trash-x/y%.md", "draft/z%.md", "draft2/z%.md", "n/private/q%.md", "t/_tmp%.md"]
#: The first note begins with a line of the document's text.
NOTES = [("n%.md", "\n# A\none\n\n## B\ntwo\nmore ^id1\n### C\n\n  \nthree\n## D\n^solo\n"), ("m%.md", "# T\r\n\r\nx <!-- gone -->\r\n\r\n<!-- only -->\r\n\r\ny\r\n"), ("o%.md", "")]


def _read(spark, d, name) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _blocks(spark, d) -> DataFrame:
    return _read(spark, d, "documents").select(F.col("doc_id").alias("block_uid"), F.col("source").alias("note_path"), F.array().cast("array<string>").alias("heading_path"), F.col("text").alias("raw_text"), F.col("text").alias("clean_text"))


def _vectors(spark, d) -> DataFrame:
    docs = _read(spark, d, "documents").select("doc_id", "source")
    return _read(spark, d, "embeddings").join(docs, F.col("vec_id") == F.col("doc_id")).select(F.col("vec_id").alias("block_uid"), F.col("source").alias("note_path"), "embedding")


def _links(spark, d) -> DataFrame:
    n = F.regexp_extract("source", r"(\d+)", 1).cast("int")
    return _read(spark, d, "documents").select("source").distinct().select(F.col("source").alias("src_note_path"), F.concat(F.lit("src"), (F.pmod(n + 1, F.lit(20))).cast("string")).alias("dst_note_path"))


def _corpus(spark, d) -> engine.Corpus:
    return engine.Corpus(_blocks(spark, d), _vectors(spark, d), _links(spark, d)).ready()


def _doc_queries(spark, d) -> DataFrame:
    own = _blocks(spark, d).filter(F.col("block_uid") % EVERY == 0).select(F.col("block_uid").alias("query_id"), "note_path", "heading_path", "clean_text", F.col("clean_text").alias("text"))
    return own.join(_read(spark, d, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding"), "query_id", "left")


def _bench_queries(spark, d) -> DataFrame:
    return _read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _cases(spark, values, name="text") -> DataFrame:
    return spark.createDataFrame(list(enumerate(values)), f"id long, {name} string")


def _long(df: DataFrame, *names) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("long") for n in names})


def scan_inventory(spark, d):
    return _read(spark, d, "documents").groupBy(F.col("source").alias("note_path")).agg(F.count(F.lit(1)).alias("blocks"), F.sum(F.length("text").cast("long")).alias("chars"))


def content_hash(spark, d):
    return _read(spark, d, "documents").select("doc_id", F.sha1("text").alias("content_hash"), T.token_estimate(F.col("text")).cast("long").alias("token_count_est"))


def _of_documents(spark, d, values, name="text", keep=()) -> DataFrame:
    """Each value for each document, with its id in place of %: doc_id, k, the value, and columns to keep."""
    rows = F.array(*(F.struct(F.lit(k).cast("long").alias("k"), F.lit(v).alias(name)) for k, v in enumerate(values)))
    return _read(spark, d, "documents").select("doc_id", *keep, F.inline(rows)).withColumn(name, F.replace(name, F.lit("%"), F.col("doc_id").cast("string")))


def path_exclude(spark, d):
    return _of_documents(spark, d, PATHS, "path").select("path", vault.excluded(F.col("path"), ["**/.trash/**", "_*.md"], ["draft", "n/private"]).alias("excluded"))


def _notes(spark, d) -> DataFrame:
    paths = _of_documents(spark, d, [p for p, _ in LINK_NOTES], "path", ["text"])
    bodies = F.create_map(*(F.lit(x) for k, (_, b) in enumerate(LINK_NOTES) if b is not None for x in (k, b)))
    body = F.replace(F.get(F.map_values(F.map_filter(bodies, lambda k, _: k == F.col("k"))), F.lit(0)), F.lit("%"), F.col("doc_id").cast("string"))
    return paths.select("path", F.coalesce(body, F.col("text")).alias("body"))


def link_extract(spark, d):
    return K.extract_links(_notes(spark, d)).select("src_note_path", "kind", F.col("no").cast("long").alias("no"), "link_type", "link_text", "dst_note_path", "dst_heading", "dst_block_id")


def link_target_parse(spark, d):
    return _of_documents(spark, d, RAW_TARGETS, "raw").select("doc_id", "k", "raw", T.link_target(F.col("raw")).alias("t")).select("doc_id", "k", F.col("t.path").alias("path"), F.col("t.heading").alias("heading"), F.col("t.block").alias("block"))


def target_classify(spark, d):
    return _of_documents(spark, d, RAW_TARGETS, "raw").select("doc_id", "k", T.classify_target(F.col("raw")).alias("status"), T.normal_target(F.col("raw")).alias("normalized"))


def link_resolve(spark, d):
    notes = _notes(spark, d)
    return K.resolve_targets(K.raw_targets(notes).distinct(), notes)


def eval_dataset(spark, d):
    return K.evaluation_set(_notes(spark, d))


def clean_text_fixture(spark, d):
    rows = _of_documents(spark, d, CLEAN)
    return rows.select("doc_id", "k", T.clean_text(F.concat("text", F.lit(" n"), F.col("doc_id").cast("string"))).alias("clean_text"))


def clean_text_pages(spark, d):
    return _read(spark, d, "pages").select("page_id", F.sha1(T.clean_text(F.col("html"))).alias("clean_sha1"), F.length(T.clean_text(F.col("html"))).cast("long").alias("n"))


def tag_extract(spark, d):
    return _read(spark, d, "documents").select("doc_id", F.array_join(T.inline_tags(F.col("text")), ",").alias("tags"))


def token_extract(spark, d):
    return _read(spark, d, "documents").select("doc_id", F.sha1(F.array_join(T.query_tokens(F.col("text")), " ")).alias("tokens_sha1"), F.size(T.query_tokens(F.col("text"))).cast("long").alias("n_tokens"))


def highlight_tokens(spark, d):
    a, b = _read(spark, d, "benchmark"), _read(spark, d, "documents").select("doc_id", F.col("text").alias("other"))
    return a.join(b, F.col("item_id") == F.col("doc_id")).select("item_id", F.array_join(T.highlight_tokens(F.col("text"), F.col("other")), " ").alias("tokens"))


def heading_stack_blocks(spark, d):
    rows = _of_documents(spark, d, [p for p, _ in NOTES], "path", ["text"])
    first = F.trim(F.concat(F.lit("intro "), F.trim(F.regexp_replace(F.substring("text", 1, 60), "[^a-zA-Z]+", " "))))
    body = F.when(F.col("k") == 0, F.concat(first, F.lit(NOTES[0][1]))).when(F.col("k") == 1, NOTES[1][1]).otherwise("")
    out = B.split_blocks(rows.select("path", body.alias("body")))
    return _long(out, "ord", "char_start", "char_end").select("block_uid", "note_path", "ord", F.array_join("heading_path", "/").alias("heading_path"), "raw_text", "clean_text", "char_start", "char_end")


def _turns(spark, d):
    return _read(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("note_path"), F.col("turn").alias("ord"), F.concat_ws(":", "conv_id", "turn").alias("block_uid"), F.col("turn").cast("string").alias("block_id"), F.array(F.col("role")).alias("heading_path"), F.col("text").alias("raw_text"), F.trim(F.regexp_replace("text", r"\s+", " ")).alias("clean_text"), F.col("turn").alias("char_start"), F.col("turn").alias("char_end"))


def block_merge_short(spark, d):
    return B.merge_short(_turns(spark, d), 80).select("block_uid", "note_path", F.sha1("raw_text").alias("raw_sha1"), F.sha1("clean_text").alias("block_hash"), "char_start", "char_end")


def block_split_fixed(spark, d):
    b = _blocks(spark, d).withColumns({"block_id": F.col("block_uid").cast("string"), "ord": F.lit(0)})
    return B.split_long(b, 1200).select("block_uid", "block_id", F.col("part").cast("long").alias("part"), F.sha1("clean_text").alias("block_hash"))


def block_split_overlap(spark, d):
    b = _blocks(spark, d).withColumns({"block_id": F.col("block_uid").cast("string"), "ord": F.lit(0), "clean_text": T.squeeze(F.col("clean_text"))})
    return B.split_overlapping(b).select("block_uid", F.col("part").cast("long").alias("part"), F.length("clean_text").cast("long").alias("n_chars"), F.sha1("clean_text").alias("block_hash"))


def embed_input_heading(spark, d):
    return _turns(spark, d).select("block_uid", F.sha1(T.embedding_input(F.col("heading_path"), F.col("clean_text"))).alias("input_sha1"))


def embed_input_sliding(spark, d):
    return B.sliding_inputs(_turns(spark, d), 1).select("block_uid", F.sha1("embed_input").alias("input_sha1"))


def pseudo_embedding(spark, d):
    v = _read(spark, d, "documents").select("doc_id", T.pseudo_embedding(F.col("text"), 64).alias("v"))
    return v.select("doc_id", *(F.round(F.get("v", F.lit(i)), 6).alias(f"v{i}") for i in range(4)), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x), 6).alias("norm"))


def token_df(spark, d):
    idx = L.build_index(_blocks(spark, d))
    return L.token_df(L.query_terms(_bench_queries(spark, d)), idx).select("query_id", "token", "df", "n")


def informative_tokens(spark, d):
    idx = L.build_index(_blocks(spark, d))
    return L.informative(L.query_terms(_bench_queries(spark, d)), idx).select("query_id", "token", "df", F.round("weight", 6).alias("weight"))


def bm25_topk(spark, d):
    idx = L.build_index(_blocks(spark, d))
    return _long(L.bm25_top(L.informative(L.query_terms(_bench_queries(spark, d)), idx), idx, 20), "rn").select("query_id", "block_uid", "bm25", "rn")


def lexical_search(spark, d):
    idx = L.build_index(_blocks(spark, d))
    return _long(L.lexical_search(_bench_queries(spark, d), idx, 10), "lex_rank")


def like_fallback(spark, d):
    q = spark.createDataFrame([(1, "事务处理 zzzq"), (2, "式事务 数据 snake"), (3, "the"), (4, "qqq 布式")], "query_id long, text string")
    return _long(L.like_fallback(q, L.build_index(_mixed(spark, d)), 10), "lex_rank")


def _mixed(spark, d) -> DataFrame:
    """The documents, two of three with CJK words behind their text."""
    more = F.when(F.col("block_uid") % 3 == 0, " 分布式事务处理 数据库").when(F.col("block_uid") % 3 == 1, " 分布式 snake_case")
    return _blocks(spark, d).withColumn("clean_text", F.concat("clean_text", F.coalesce(more, F.lit(""))))


def lexical_search_cjk(spark, d):
    asked = _bench_queries(spark, d).withColumn("text", F.concat("text", F.when(F.col("query_id") % 2 == 0, " 分布式事务 snake").otherwise(" 分布式 snake_case")))
    only = _cases(spark, ["事务处理", "snake 式事务 zzzq", "数据", "布式"]).select((F.col("id") + 1_000_000).alias("query_id"), "text")
    return _long(L.lexical_search(asked.unionByName(only), L.build_index(_mixed(spark, d)), 10), "lex_rank")


def fts_porter_topk(spark, d):
    from ..functions.porter import stemmed_index

    idx = stemmed_index(_blocks(spark, d))
    return _long(L.bm25_top(L.informative(L.query_terms(_bench_queries(spark, d)), idx), idx, 10), "rn").select("query_id", "block_uid", "bm25", "rn")


def _phrase_queries(spark, d) -> DataFrame:
    """Phrases of two and three words of each item, joined by underscores, and a word."""
    w = F.regexp_extract_all(F.lower("text"), F.lit("[0-9a-z]+"), F.lit(0))
    run = lambda a, b: F.array_join(F.slice("w", a + 1, b - a), "_")
    return _read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), w.alias("w")).select("query_id", F.concat_ws(" ", run(0, 2), run(3, 6), run(8, 10), run(12, 13)).alias("text"))


def phrase_topk(spark, d):
    tokens, idx = L.with_phrases(L.query_terms(_phrase_queries(spark, d)), L.positional_index(_blocks(spark, d)))
    return _long(L.bm25_top(L.informative(tokens, idx), idx, 20), "rn").select("query_id", "block_uid", "bm25", "rn")


def _vector_queries(spark, d, exclude):
    e = _read(spark, d, "embeddings").filter(F.col("vec_id") % EVERY == 0)
    return e.select(F.col("vec_id").alias("query_id"), "embedding", (F.col("label").cast("string") if exclude else F.lit(None).cast("string")).alias("exclude_note"))


def _labelled(spark, d):
    return _read(spark, d, "embeddings").select(F.col("vec_id").alias("block_uid"), F.col("label").cast("string").alias("note_path"), "embedding")


def cosine_topk(spark, d):
    return _long(V.cosine_top(_labelled(spark, d), _vector_queries(spark, d, False), 10), "sem_rank")


def cosine_topk_exclude(spark, d):
    return _long(V.cosine_top(_labelled(spark, d), _vector_queries(spark, d, True), 10), "sem_rank")


def ann_topk(spark, d):
    return _long(A.search(A.build(_labelled(spark, d)), _vector_queries(spark, d, False), 10), "sem_rank")


def _with_copies(spark, d) -> DataFrame:
    """The vectors, and of each fifth one a copy whose first component is moved by up to 0.35."""
    own = _labelled(spark, d)
    moved = F.transform(F.col("embedding").cast("array<double>"), lambda x, i: x + F.when(i == 0, F.lit(0.05) * (F.col("block_uid") % 8)).otherwise(0.0))
    copies = own.filter("block_uid % 5 = 0").select((F.col("block_uid") + 1_000_000).alias("block_uid"), "note_path", moved.alias("embedding"))
    return own.withColumn("embedding", F.col("embedding").cast("array<double>")).unionByName(copies)


def near_vector_pairs(spark, d):
    return N.near_pairs(_with_copies(spark, d))


def _copy_hits(spark, d, k: int = 10) -> DataFrame:
    top = V.cosine_top(_with_copies(spark, d), _vector_queries(spark, d, False), k)
    return top.select("query_id", "block_uid", F.col("sem_rank").alias("ord"))


def near_hit_removal(spark, d):
    return _long(N.without_near_hits(_copy_hits(spark, d), N.near_pairs(_with_copies(spark, d))), "ord")


def hit_clusters(spark, d):
    return _long(N.cluster_hits(_copy_hits(spark, d), _with_copies(spark, d), 0.6), "ord", "cluster").select("query_id", "block_uid", "ord", "cluster", "leader")


def query_expand(spark, d):
    asked = ["How do I safely cut a cake?", "cake", " Cake  CAKE cake ", "如何 解释 分布式", "what is it", "one two three four five six seven", ""]
    q = _bench_queries(spark, d).unionByName(_cases(spark, asked).select((F.col("id") + 1_000_000).alias("query_id"), "text"))
    return _long(X.expand_queries(q), "variant_idx")


def _three_lists(spark, d):
    """Three lists of each query vector's neighbours, by three of its roundings."""
    top = V.cosine_top(_labelled(spark, d), _vector_queries(spark, d, False), 12)
    parts = F.array(*[F.struct(F.lit(i).alias("list_idx"), F.lit(m).alias("m")) for i, m in enumerate((2, 3, 1))])
    rows = top.select("*", F.inline(parts)).filter(F.col("sem_rank") % F.col("m") == 0)
    return rows.select("query_id", "list_idx", F.col("sem_rank").alias("item_idx"), "block_uid", "note_path", F.round(F.col("semantic_score") / (F.col("list_idx") + 1), 6).alias("score"))


def merge_candidates(spark, d):
    return _long(X.merge_candidates(_three_lists(spark, d)), "ord")


def merge_scored_hits(spark, d):
    return _long(X.merge_scored(_three_lists(spark, d), "score"), "ord")


def graph_boost(spark, d):
    q = _doc_queries(spark, d).select("query_id", F.col("note_path").alias("src_note"), "embedding", F.lit(None).cast("string").alias("exclude_note"))
    top = V.cosine_top(_vectors(spark, d), q, 10).join(q.select("query_id", "src_note"), "query_id")
    return R.graph_boost(top, _links(spark, d)).select("query_id", "block_uid", "graph_boost")


def _fused(spark, d):
    c = _corpus(spark, d)
    q = _doc_queries(spark, d)
    sem = V.cosine_top(c.vectors, q.select("query_id", "embedding", F.lit(None).cast("string").alias("exclude_note")), 20)
    lex = L.lexical_search(q.select("query_id", "text"), c.index, 20)
    boosts = engine._boosts(sem, lex, q.withColumnRenamed("note_path", "src_note"), c)
    return R.fuse(sem, lex, DEFAULT, boosts), q, c


def fuse_scores(spark, d):
    f = _fused(spark, d)[0]
    return f.select("query_id", "block_uid", "note_path", "semantic", "lexical", "graph_boost", F.round("lexical_effective", 6).alias("lexical_effective"), F.round("synergy", 6).alias("synergy"), "final_score", "ord")


def threshold_relax(spark, d):
    return R.relaxed_threshold(_fused(spark, d)[0], 0.95).select("query_id", "block_uid", "final_score", "ord")


def _varied(spark, d):
    f, q, c = _fused(spark, d)
    return R.diversify(f, 2, 0.08, 10), q, c


def note_diversity(spark, d):
    return _long(_varied(spark, d)[0], "ord").select("query_id", "block_uid", "note_path", "final_score", "ord")


def anchor_rerank(spark, d):
    v, q, c = _varied(spark, d)
    return _long(R.anchor_rerank(v, q, c.blocks, DEFAULT, 10), "ord").select("query_id", "block_uid", "content_anchor", "final_score", "ord")


def dedup_hits(spark, d):
    flat = _fused(spark, d)[0].select("note_path", "block_uid", "final_score", (F.col("query_id") * 10_000_000 + F.col("ord")).alias("ord"))
    return R.dedup(flat)


def group_by_note(spark, d):
    return _long(R.group_by_note(_fused(spark, d)[0]), "note_rank", "block_rank")


def enrich_hits(spark, d):
    v, q, c = _varied(spark, d)
    return R.enrich(v, c.blocks).select("query_id", "block_uid", "snippet", "n_chars")


def search_e2e(spark, d):
    hits = engine.search(_doc_queries(spark, d), _corpus(spark, d))
    return _long(hits, "ord").select("query_id", "block_uid", "note_path", "content_anchor", "final_score", "ord", "snippet")


def search_tags_any(spark, d):
    """The search with a filter on tags: notes of one source in three have the tag."""
    notes = _read(spark, d, "documents").select(F.col("source").alias("path")).distinct()
    tags = notes.withColumn("tags", F.array(F.lit("all"), F.concat(F.lit("t"), F.pmod(F.regexp_extract("path", r"(\d+)", 1).cast("int"), F.lit(3)).cast("string"))))
    hits = engine.search(_doc_queries(spark, d), engine.filtered(_corpus(spark, d), tags, ["t1", "t7"]))
    return _long(hits, "ord").select("query_id", "block_uid", "note_path", "content_anchor", "final_score", "ord", "snippet")


def query_block_e2e(spark, d):
    c = _corpus(spark, d)
    hits = R.enrich(engine.query_blocks(_doc_queries(spark, d), c, LOW, top_k=40), c.blocks)
    return _long(hits, "ord").select("query_id", "block_uid", "note_path", "graph_boost", "content_anchor", "final_score", "ord", "snippet")


def query_note_e2e(spark, d):
    asked = _doc_queries(spark, d)
    asked = asked.withColumn("ord", F.row_number().over(W.partitionBy("note_path").orderBy("query_id")))
    out = engine.query_notes(asked, _corpus(spark, d), LOW)
    return _long(out, "note_rank", "block_rank").withColumnRenamed("query_id", "of_note")


def _states(spark, d):
    docs = _read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), "doc_id", F.sha1("text").alias("content_hash"))
    old = docs.filter("doc_id % 5 <> 0")
    new = docs.filter("doc_id % 7 <> 0").withColumn("content_hash", F.when(F.col("doc_id") % 11 == 0, F.sha1(F.concat("content_hash", F.lit("x")))).otherwise(F.col("content_hash")))
    return old.drop("doc_id"), new.drop("doc_id")


def file_diff(spark, d):
    return S.file_diff(*_states(spark, d))


def delete_note_cascade(spark, d):
    gone = spark.createDataFrame([("src3",), ("src7",)], "path string")
    left = S.delete_notes({"blocks": _blocks(spark, d), "links": _links(spark, d)}, gone)
    return left["blocks"].groupBy("note_path").agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit("block")).unionByName(left["links"].groupBy(F.col("src_note_path").alias("note_path")).agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit("link")))


def blocks_by_note(spark, d):
    b = _blocks(spark, d).withColumn("char_start", F.length("raw_text"))
    return _long(S.blocks_by_note(b), "place").select("note_path", "block_uid", "place")


def _log(spark, d):
    docs = _read(spark, d, "documents")
    return docs.select(F.floor(F.col("doc_id") / 3).alias("id"), F.col("doc_id").alias("seq"), F.when(F.col("doc_id") % 3 == 2, "success").otherwise("running").alias("status"), F.col("source").alias("detail"))


def job_latest(spark, d):
    return S.job_latest(_log(spark, d))


def index_status(spark, d):
    notes = _read(spark, d, "documents").select("source").distinct()
    return S.index_status(notes, _blocks(spark, d), _links(spark, d), _log(spark, d))


def _eval_frames(spark, d):
    top = V.cosine_top(_labelled(spark, d), _vector_queries(spark, d, False), 20)
    e = _read(spark, d, "embeddings").select("vec_id", "label")
    truth = e.filter(F.col("vec_id") % EVERY == 0).withColumnRenamed("vec_id", "query_id").join(e.withColumnRenamed("vec_id", "target"), "label").filter("query_id <> target").select("query_id", "target")
    return top.select("query_id", F.col("block_uid").alias("target"), F.col("sem_rank").alias("rank")), truth


def eval_metrics(spark, d):
    return K.metrics(*_eval_frames(spark, d))


def eval_worst(spark, d):
    return K.worst(*_eval_frames(spark, d))


def _predictions(spark, d):
    return E.prediction_table(*_eval_frames(spark, d))


def _flat(table, *keep):
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return table.select(*keep, "query_id", F.size("targets").cast("long").alias("n_targets"), text("predicted"), text("hits_5"), text("hits_10"), F.size("misses_10").cast("long").alias("n_misses"), text("false_positives_10"))


def eval_predictions(spark, d):
    return _flat(_predictions(spark, d))


def eval_false_positives(spark, d):
    return _flat(E.worst_false_positives(_predictions(spark, d))).select("query_id", "false_positives_10")


def eval_misses(spark, d):
    return _flat(E.worst_misses(_predictions(spark, d))).select("query_id", "hits_10", "n_misses")


def eval_grid(spark, d):
    pred, truth = _eval_frames(spark, d)
    out = E.grid(lambda depth: pred.filter(F.col("rank") <= depth), {"three": 3, "seven": 7, "all": 20}, truth)
    return out.select("run", "dataset_note_count", "candidate_note_count", "avg_gt_links_per_note", "hit_at_5", "recall_at_10", "precision_at_5", "precision_at_10", "mrr")


def _linked(spark, d) -> DataFrame:
    """A note for each document, with links to others, to notes that are not there and to the web."""
    i = F.col("doc_id")
    folder = F.when(i % 5 == 4, "out").otherwise("cs")
    links = F.concat(F.lit(" [[n"), i + 5, F.lit("]] and [see](n"), i + 10, F.lit(".md#top) [[gone"), i, F.lit("|G]] [site](https://e.org/"), i, F.lit(")"), F.when(i % 10 == 0, F.concat(F.lit(" [[n"), i + 4, F.lit("]]"))).otherwise(""))
    return _read(spark, d, "documents").select(F.concat(folder, F.lit("/n"), i, F.lit(".md")).alias("path"), F.concat("text", links).alias("body"))


def eval_notes(spark, d):
    kept, _ = E.data_set(_linked(spark, d))
    return kept.select("path", F.array_join("targets", ",").alias("targets"), F.size("internal").cast("long").alias("n_internal"), F.size("ignored").cast("long").alias("n_ignored"), F.sha1("body").alias("body_sha1"))


def eval_dropped_notes(spark, d):
    _, dropped = E.data_set(_linked(spark, d))
    return dropped.select("path", F.array_join(F.transform("external", lambda x: F.concat(x["raw"], F.lit(">"), x["resolved"])), ",").alias("external"))


NAMES = """scan_inventory content_hash path_exclude link_extract link_target_parse target_classify link_resolve eval_dataset
clean_text_fixture clean_text_pages tag_extract token_extract highlight_tokens heading_stack_blocks block_merge_short
block_split_fixed block_split_overlap embed_input_heading embed_input_sliding pseudo_embedding token_df informative_tokens bm25_topk lexical_search
like_fallback lexical_search_cjk phrase_topk fts_porter_topk cosine_topk cosine_topk_exclude ann_topk near_vector_pairs near_hit_removal hit_clusters query_expand merge_candidates merge_scored_hits graph_boost
fuse_scores threshold_relax note_diversity anchor_rerank dedup_hits group_by_note enrich_hits search_e2e search_tags_any query_block_e2e
query_note_e2e file_diff delete_note_cascade blocks_by_note job_latest index_status eval_metrics eval_worst eval_predictions
eval_false_positives eval_misses eval_grid eval_notes eval_dropped_notes""".split()


def queries():
    return {name: globals()[name] for name in NAMES}


def oracle_sql():
    return dict(SQL)
