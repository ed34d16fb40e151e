"""The stored index: what an update writes, that it equals a rebuild, kept counts, and vectors by cell."""

import contextlib
import io
import random

import pytest
from pyspark.sql import functions as F

from blockrank.config import DEFAULT
from blockrank.operators import ann as A
from blockrank.operators import vectors as V
from blockrank.sources import store as S
from blockrank.sync import Indexer, index_tables

NOTES = "path string, title string, aliases array<string>, tags array<string>, frontmatter string, body string, content_hash string, mtime double"


def rows_of(df):
    cols = sorted(c for c in df.columns if c != "mtime")
    return sorted(map(repr, df.select(*cols).collect()))


def bodies(spark, found: dict):
    return spark.createDataFrame([(p, p, [], [], "{}", b, str(hash(b)), 0.0) for p, b in found.items()], NOTES)


def recount(store):
    return {r.term: r.df for r in store.read()["postings"].groupBy("term").agg(F.countDistinct("block_uid").alias("df")).collect()}


def plan_of(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_an_update_of_one_note_among_many_writes_little(spark, tmp_path):
    number = F.col("id")
    word = lambda k: F.element_at(F.split(F.lit("boat sail harbour crew repair net rope storm wave tide"), " "), F.pmod(number * k + F.floor(number / k), F.lit(10)).cast("int") + 1)
    body = F.concat_ws(" ", *[word(k) for k in (1, 3, 7, 11, 13)], F.concat(F.lit("w"), number), F.concat(F.lit("[[n"), number % 100, F.lit("]]")))
    notes = spark.range(10_000).select(F.concat(F.lit("n"), number, F.lit(".md")).alias("path"), F.lit("t").alias("title"), *[F.array().cast("array<string>").alias(c) for c in ("aliases", "tags")], F.lit("{}").alias("frontmatter"), body.alias("body"), F.sha1(body).alias("content_hash"), F.lit(0.0).alias("mtime"))
    store = S.Store(spark, str(tmp_path / "a"))
    store.write(index_tables(notes, DEFAULT))
    whole = store.manifest()["segments"][0]["bytes"]
    changed = bodies(spark, {"n77.md": "quite other words about gardens [[n5]]"})
    assert store.apply(index_tables(changed, DEFAULT), ["n77.md"]) == 2
    first, second = store.manifest()["segments"]
    assert first["bytes"] == whole and second["bytes"] < 0.01 * whole
    other = S.Store(spark, str(tmp_path / "b"))
    other.write(index_tables(notes.filter("path <> 'n77.md'").unionByName(changed), DEFAULT))
    for t in S.TABLES:
        x, y = (s.read()[t].withColumn("all", F.struct("*")).agg(F.count("all").alias("n"), F.sum(F.xxhash64(F.to_json("all")).cast("decimal(38,0)")).alias("s")).first() for s in (store, other))
        assert x == y, t
    # a read of one note looks into one folder
    plan = plan_of(store.note("n77.md"))
    assert "PartitionFilters: [isnotnull(bucket" in plan or "bucket#" in plan.split("PartitionFilters")[1][:80]
    assert [r.clean_text for r in store.blocks_of("n77.md").collect()] == ["quite other words about gardens n5"]


def test_any_order_of_updates_equals_a_rebuild(spark, tmp_path, monkeypatch):
    rng = random.Random(12)
    words = "alpha beta gamma delta eps zeta eta theta iota kappa".split()
    make = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(3, 12))) + f" [[n{rng.randrange(12)}]]"
    now = {f"n{i}.md": make() for i in range(12)}
    store = S.Store(spark, str(tmp_path / "a"))
    store.write(index_tables(bodies(spark, now), DEFAULT))
    links = {p: b for p, b in now.items()}
    dead: set = set()
    for step in range(4):
        some = rng.sample(sorted(now), 2)
        gone = [rng.choice(sorted(set(now) - set(some)))] if step % 2 else []
        for p in some:
            now[p] = make()
        new = f"x{step}.md"
        now[new] = make()
        for p in gone:
            del now[p]
        fresh = index_tables(bodies(spark, {p: now[p] for p in (*some, new)}), DEFAULT)
        if step == 3:  # as tables rather than lists
            store.apply(fresh, spark.createDataFrame([(p,) for p in (*some, new)], "path string"), spark.createDataFrame([(p,) for p in gone], "path string"))
        else:
            store.apply(fresh, [*some, new], gone)
        links |= {p: now[p] for p in (*some, new)}
        for p in gone:
            links.pop(p)
            dead |= {(src, p) for src in links if f"[[{p[:-3]}]]" in links[src]}
        dead -= {(src, d) for src, d in dead if src in (*some, new) and not gone or src in (*some, new)}
        if gone:
            dead |= {(src, p) for p in gone for src in links if f"[[{p[:-3]}]]" in links[src]}
    other = S.Store(spark, str(tmp_path / "b"))
    other.write(index_tables(bodies(spark, now), DEFAULT))

    def same():
        mine, theirs = store.read(), other.read()
        for t in ("notes", "blocks", "vectors", "postings"):
            assert rows_of(mine[t]) == rows_of(theirs[t]), t
        got = {(r.src_note_path, r.dst_note_path) for r in mine["links"].collect()}
        want = {(r.src_note_path, r.dst_note_path) for r in theirs["links"].collect()}
        assert got == want - dead
        assert {r.term: r.df for r in store.terms().collect()} == recount(store)
        t = store.totals().first()
        b = mine["blocks"].agg(F.count("*").alias("n"), F.avg("dl").alias("a")).first()
        assert t.n == b.n and abs(t.avgdl - b.a) < 1e-12

    same()
    sizes = [s["bytes"] for s in store.manifest()["segments"]]
    assert all(a >= S.RATIO * sum(sizes[i + 1 :]) for i, a in enumerate(sizes[:-1]))
    version = store.compact()
    assert version == 6 and len(store.manifest()["segments"]) == 1
    same()
    assert len(store.vacuum()) >= 4
    same()


def test_two_writers_do_not_overwrite_each_other(spark, tmp_path):
    store = S.Store(spark, str(tmp_path / "a"))
    store.write(index_tables(bodies(spark, {"a.md": "one two"}), DEFAULT))
    old = store.manifest()
    store.apply(index_tables(bodies(spark, {"b.md": "three"}), DEFAULT), ["b.md"])
    with pytest.raises(RuntimeError):
        store._publish(old | {"version": 2})
    assert store.read()["notes"].count() == 2


def test_stored_vectors_are_found_after_churn(spark, tmp_path):
    """A fifth of the vectors replaced or deleted: recall against the exact search, and only probed cells are read."""
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    path = F.concat(F.lit("v"), F.col("vec_id"), F.lit(".md"))
    rows = e.select(F.col("vec_id").cast("string").alias("block_uid"), path.alias("note_path"), F.col("embedding").cast("array<double>").alias("embedding"))
    store = S.Store(spark, str(tmp_path / "a"))
    none = index_tables(bodies(spark, {}), DEFAULT)
    store.write(none | {"vectors": rows})
    turned = rows.filter("block_uid % 10 = 3").withColumn("embedding", F.reverse("embedding"))
    store.apply(none | {"vectors": turned}, turned.select(F.col("note_path").alias("path")), rows.filter("block_uid % 10 = 4").select(F.col("note_path").alias("path")))
    now = rows.filter("block_uid % 10 not in (3, 4)").unionByName(turned)
    assert rows_of(store.read()["vectors"]) == rows_of(now)
    asked = now.filter("block_uid % 100 = 0").select(F.col("block_uid").cast("long").alias("query_id"), "embedding", F.lit(None).cast("string").alias("exclude_note"))
    exact = V.cosine_top(now, asked, 10).persist()
    index = store.cells()
    found = A.search(index, asked, 10)
    assert A.recall(found, exact) >= 0.9
    assert "dynamicpruning" in plan_of(found).lower() or "dynamicpruning" in plan_of(A.search(index, asked.limit(1), 10, probes=2)).lower()
    every = A.search(index, asked, 10, probes=len(index.centres))
    assert sorted(map(tuple, every.select("query_id", "block_uid").collect())) == sorted(map(tuple, exact.select("query_id", "block_uid").collect()))


def test_only_changed_blocks_are_embedded_again(spark, tmp_path):
    """Blocks put in, moved, changed and dropped: the embedder sees new inputs only, and vectors equal a rebuild's."""
    import pandas as pd

    calls = spark.sparkContext.accumulator(0)

    @F.pandas_udf("array<double>")
    def embed(texts: pd.Series) -> pd.Series:
        calls.add(len(texts))
        return texts.map(lambda t: [float(len(t)), float(sum(map(ord, t)) % 97), 1.0])

    root = tmp_path / "vault"
    root.mkdir()
    block = lambda i: f"This is the block of number {i}, " + f"word{i} " * 15
    note = lambda *ids: "\n\n".join(block(i) for i in ids) + "\n"
    (root / "a.md").write_text(note(*range(8)))
    (root / "b.md").write_text(note(20, 21))
    ix = Indexer(spark, str(root), str(tmp_path / "s"), cfg=DEFAULT, embed=embed)
    ix.rebuild()
    assert calls.value == 10
    calls.value = 0
    (root / "a.md").write_text(note(0, 50, 1, 2, 7, 4, 5, 60))  # two new, three and six gone, seven moved
    assert ix.sync()["modified"] == 1
    assert calls.value == 2  # the two new blocks
    calls.value = 0
    ix.index_file("a.md")
    assert calls.value == 0
    other = Indexer(spark, str(root), str(tmp_path / "t"), cfg=DEFAULT, embed=embed)
    other.rebuild()
    assert rows_of(ix.store.read()["vectors"]) == rows_of(other.store.read()["vectors"])
