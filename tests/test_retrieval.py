"""Golden cases and properties of the retrieval operators."""

import random
import sqlite3

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockrank.config import DEFAULT, check_request
from blockrank.functions import porter
from blockrank.functions import text as T
from blockrank.operators import blocks as B
from blockrank.operators import links as K
from blockrank.operators import ranking as R
from blockrank.sources import store as S
from blockrank.sync import Indexer


def greedy(hits, cap, penalty, k):
    left, out, seen = list(hits), [], {}
    while left and len(out) < k:
        ok = [h for h in left if cap <= 0 or seen.get(h[1], 0) < cap]
        if not ok:
            break
        best = max(ok, key=lambda h: (round(h[2] - penalty * seen.get(h[1], 0), 6), h[2], -h[3]))
        out.append(best[0])
        seen[best[1]] = seen.get(best[1], 0) + 1
        left.remove(best)
    return out


def test_diversity_equals_the_greedy_loop(spark):
    rng = random.Random(3)
    rows = [(q, f"b{i}", f"n{rng.randrange(4)}", round(rng.random(), 2), i) for q in range(12) for i in range(15)]
    df = spark.createDataFrame(rows, "query_id long, block_uid string, note_path string, final_score double, ord long")
    for cap, penalty in ((2, 0.08), (0, 0.1), (1, 0.0)):
        got = {}
        for r in R.diversify(df, cap, penalty, 6).orderBy("query_id", "ord").collect():
            got.setdefault(r.query_id, []).append(r.block_uid)
        for q in range(12):
            assert got[q] == greedy([r[1:] for r in rows if r[0] == q], cap, penalty, 6)


def test_porter_agrees_with_sqlite():
    words = "relational conditional rational valenci digitizer operator feudalism decisiveness hopefulness formaliti sensibiliti triplicate formative electriciti hopeful goodness revival allowance inference airliner adjustable irritant replacement adjustment dependent adoption homologou communism activate effective bowdlerize probate rate cease controll roll happy sky caresses ponies cats feed agreed plastered motoring sing conflated troubled sized hopping tanned falling hissing fizzed failing filing".split()
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table t using fts5(x, tokenize='porter')")
    con.execute("create virtual table v using fts5vocab(t, 'row')")
    for w in words:
        con.execute("delete from t")
        con.execute("insert into t values (?)", (w,))
        assert con.execute("select term from v").fetchone()[0] == porter.stem(w), w


def test_long_blocks_keep_their_text(spark):
    df = spark.createDataFrame([("n", 0, "n:a", "a", "x" * 2500), ("n", 1, "n:b", "b", "short")], "note_path string, ord int, block_uid string, block_id string, clean_text string")
    got = [(r.block_uid, len(r.clean_text)) for r in B.split_long(df, 1200).orderBy("ord", "part").collect()]
    assert got == [("n:a:part1", 1200), ("n:a:part2", 1200), ("n:a:part3", 100), ("n:b", 5)]


def test_overlapping_parts_hold_whole_sentences(spark):
    import re

    rng = random.Random(19)
    texts = ["short one.", "", "x" * 130 + ".", " ".join(f"s{i} " + "word " * rng.randint(1, 9) + rng.choice((".", "!", "。", "?!")) for i in range(60)), "no end " * 40]
    texts = [" ".join(t.split()) for t in texts]
    blocks = spark.createDataFrame([(f"n:{i}", str(i), t) for i, t in enumerate(texts)], "block_uid string, block_id string, clean_text string")
    got = {}
    for r in B.split_overlapping(blocks, 100, 30).orderBy("part").collect():
        got.setdefault(r.block_uid.split(":part")[0], []).append(r.clean_text)
    for i, t in enumerate(texts):
        pieces = [t] if len(t) <= 100 else [s[k : k + 100] for s in re.findall(B.SENTENCE, t) for k in range(0, len(s), 100)]
        want, own = [], []
        for p in pieces:
            if own and len("".join(own)) + len(p) > 100:
                want.append("".join(own).strip(" "))
                while own and (len("".join(own)) > 30 or len("".join(own)) + len(p) > 100):
                    own = own[1:]
            own = own + [p]
        want.append("".join(own).strip(" "))
        assert got[f"n:{i}"] == want, i
        assert all(len(x) <= 100 for x in want)


def test_links_are_stripped_to_visible_text(spark):
    cases = {
        "a [[b|Bee]] [[c#x]] ![p](d.md) [q](https://e.org) [[32.4 x]]": "a Bee c p [q](https://e.org) [[32.4 x]]",
        "[[x/y/n.md]][[b| ]]end [ ](sub/k.md#t) ![](z.png) [[#here]]": "nend k ![](z.png) [[#here]]",
        "no links": "no links",
        "": "",
        "[[one]]": "one",
    }
    df = spark.createDataFrame([(k, v) for k, v in cases.items()], "body string, want string")
    for r in df.select("want", K.strip_links(F.col("body")).alias("got")).collect():
        assert r.got == r.want
    assert spark.createDataFrame([(None,)], "body string").select(K.strip_links(F.col("body")).alias("b")).first().b is None


def test_requests_are_checked():
    for bad in ((0, None), (201, None), (None, 1.5)):
        try:
            check_request(*bad, most=200)
        except ValueError:
            continue
        raise AssertionError(bad)


def test_penalty_must_not_be_negative(spark):
    df = spark.createDataFrame([(1, "b", "n", 0.5, 1)], "query_id long, block_uid string, note_path string, final_score double, ord long")
    try:
        R.diversify(df, 2, -0.1, 3)
    except ValueError:
        return
    raise AssertionError


def test_threshold_keeps_equal_scores_and_relaxes(spark):
    df = spark.createDataFrame([(1, "a", 0.55), (1, "b", 0.54), (2, "c", 0.1)], "query_id long, block_uid string, final_score double")
    assert {r.block_uid for r in R.relaxed_threshold(df, DEFAULT.threshold).collect()} == {"a", "c"}
    assert {r.block_uid for r in R.relaxed_threshold(df, DEFAULT.threshold, False).collect()} == {"a"}


def test_sync_equals_rebuild(spark, tmp_path):
    vault, a, b = tmp_path / "vault", str(tmp_path / "a"), str(tmp_path / "b")
    vault.mkdir()
    (vault / "one.md").write_text("---\ntags: [x, y]\naliases: solo\n---\n# H\n\nSome text #z with [[two|link]].\n")
    (vault / "two.md").write_text("Other text.\n\n[[one]]\n")
    (vault / "three.md").write_text("goes away [[two]]")
    one = Indexer(spark, str(vault), a, cfg=DEFAULT)
    one.rebuild()
    (vault / "two.md").write_text("Changed text.\n")
    (vault / "three.md").unlink()
    (vault / "four.md").write_text("new [[one]]")
    done = one.sync()
    assert {k: done[k] for k in ("added", "modified", "deleted")} == {"added": 1, "modified": 1, "deleted": 1}
    two = Indexer(spark, str(vault), b, cfg=DEFAULT)
    two.rebuild()
    for t in S.TABLES:
        x, y = one.store.read()[t], two.store.read()[t]
        cols = [c for c in x.columns if c != "mtime"]
        assert sorted(map(repr, x.select(*cols).collect())) == sorted(map(repr, y.select(*cols).collect())), t
    note = one.store.read()["notes"].filter("path = 'one.md'").first()
    assert (note.title, note.aliases, note.tags) == ("one", ["solo"], ["x", "y", "z"])
    again = one.sync(9)
    assert (again["version"], again["indexed_files"], again["status"]) == (2, 0, "success")
    assert S.job_latest(one.store.jobs()).filter("id = 2").first().status == "success"
    assert one.clear()["notes"] == 3 and one.store.read()["notes"].count() == 0


def test_highlight_and_terms(spark):
    r = spark.sql("select 'Get the API data 数据库 ab' as a, 'api DATA 数据库' as b").select(T.highlight_tokens(F.col("a"), F.col("b")).alias("h"), T.anchor_terms(F.col("a")).alias("t"), T.query_tokens(F.col("a")).alias("q")).first()
    assert r.h == ["API", "data", "数据库"] and r.q == ["get", "the", "api", "data", "数据库"] and r.t == ["get", "the", "data", "数据库"]


def _vault(tmp_path, **files):
    root = tmp_path / "vault"
    root.mkdir(exist_ok=True)
    for name, text in files.items():
        (root / f"{name}.md").write_bytes(text if isinstance(text, bytes) else text.encode())
    return root


def test_broken_notes_do_not_stop_a_job(spark, tmp_path):
    root = _vault(tmp_path, good="fine text of a note", bad=b"\xff\xfe not text", yaml="---\na: [1\n---\nbody", twice=f"{'one ' * 30}^k1\n\n{'two ' * 30}^k1\n")
    ix = Indexer(spark, str(root), str(tmp_path / "s"), cfg=DEFAULT)
    done = ix.rebuild()
    assert done["status"] == "partial_success" and (done["total_files"], done["indexed_files"], done["failed_files"]) == (4, 2, 3)
    assert [f["path"] for f in done["failures"]] == ["bad.md", "twice.md", "yaml.md"] and done["elapsed_ms"] >= 0
    assert sorted(r.path for r in ix.store.read()["notes"].collect()) == ["good.md", "twice.md"]
    # a note that can't be read any more stays as it was
    (root / "good.md").write_bytes(b"\xff")
    assert ix.sync()["failed_files"] >= 1
    assert ix.store.note("good.md").first().body == "fine text of a note"


def test_one_file_is_indexed_or_skipped(spark, tmp_path):
    root = _vault(tmp_path, a="first [[b]]", b="second")
    ix = Indexer(spark, str(root), str(tmp_path / "s"), globs=["draft*"], cfg=DEFAULT)
    ix.rebuild()
    _vault(tmp_path, a="changed words", draft="no")
    assert ix.index_file("draft.md") == {"skipped": "draft.md", "reason": "excluded"}
    assert ix.index_file("a.md")["indexed"] == "a.md"
    assert [r.clean_text for r in ix.store.blocks_of("a.md").collect()] == ["changed words"]
    assert ix.store.links_from("a.md").count() == 0 and ix.store.note("b.md").count() == 1
    assert {r.term for r in ix.store.read()["postings"].filter("note_path = 'a.md'").collect()} == {"chang", "word"}
    assert ix.store.dashboard().first().notes == 2
    from blockrank.sources import vault

    both = ix.store.dashboard(vault.scan(spark, str(root))).first()
    assert (both.notes, both.vault_files, both.not_indexed) == (2, 3, 1)


def test_a_failed_write_leaves_the_store_usable(spark, tmp_path):
    root = _vault(tmp_path, a="first", b="second")
    ix = Indexer(spark, str(root), str(tmp_path / "s"), cfg=DEFAULT)
    ix.rebuild()
    broken = dict(ix.store.read())
    broken["vectors"] = broken["vectors"].withColumn("embedding", F.raise_error(F.lit("no")))
    try:
        ix.store.write(broken)
        raise AssertionError
    except Exception as e:
        assert "no" in str(e)
    assert ix.store.version() == 1 and ix.store.read()["notes"].count() == 2
    assert ix.rebuild(5)["version"] == 2 and len(ix.store.vacuum()) == 2 and ix.store.read()["notes"].count() == 2


def test_stored_search_is_stemmed_and_embeds_each_variant(spark, tmp_path):
    from blockrank.plans import engine

    root = _vault(tmp_path, a="# Boats\n\nSailing boats were repaired by the harbour crews.", b="Cooking recipes and nothing else.", c="A boat repair manual.")
    ix = Indexer(spark, str(root), str(tmp_path / "s"), cfg=DEFAULT)
    ix.rebuild()
    asked = spark.createDataFrame([(1, "repairing boat"), (2, "zzzq")], "query_id long, text string")
    corpus = engine.stored_corpus(ix.store)
    hits = engine.search(asked, corpus, embed=T.pseudo_embedding).collect()
    best = sorted((r for r in hits if r.query_id == 1), key=lambda r: r.ord)
    from blockrank.operators import lexical as L

    assert {r.note_path for r in L.lexical_search(asked, corpus.index, 5).collect()} == {"a.md", "c.md"}
    assert best[0].block_text and {r.note_path: r.heading_path for r in best}["a.md"] == ["Boats"]
    assert all(len(r.matches) for r in R.explain(engine.search(asked, corpus, embed=T.pseudo_embedding)).collect())


def test_cells_give_the_same_neighbours(spark, monkeypatch):
    from blockrank.operators import vectors as V

    rng = random.Random(8)
    rows = [(i, f"n{i % 5}", [rng.gauss(0, 1) for _ in range(6)]) for i in range(200)] + [(500, "n0", None), (501, "n1", [])]
    own = spark.createDataFrame(rows, "block_uid long, note_path string, embedding array<double>")
    asked = own.filter("block_uid % 7 = 0").select(F.col("block_uid").alias("query_id"), "embedding", F.when(F.col("block_uid") % 2 == 0, F.col("note_path")).alias("exclude_note"))
    want = sorted(map(tuple, V.cosine_top(own, asked, 5).collect()))
    monkeypatch.setattr(V, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(V, "QUERY_BLOCK", 8)
    monkeypatch.setattr(V, "VECTOR_BLOCK", 32)
    assert sorted(map(tuple, V.cosine_top(own, asked, 5).collect())) == want


def test_fts_search_agrees_with_sqlite(spark):
    """Stemmed BM25, coverage and fallback against SQLite's FTS5."""
    import math
    import re

    from blockrank.operators import lexical as L

    rng = random.Random(11)
    vocabulary = "boat boats sailing sail repaired repair crews crew harbour cooking recipe recipes manual nothing connected connection relational".split()
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(3, 20))) for _ in range(40)] + ["分布式事务 boat", "数据库 sail"]
    blocks = spark.createDataFrame([(i, f"n{i}", t) for i, t in enumerate(texts)], "block_uid long, note_path string, clean_text string")
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table t using fts5(id unindexed, x, tokenize='porter')")
    con.executemany("insert into t values (?, ?)", list(enumerate(texts)))
    questions = ["repairing boats crew", "connections recipe", "relation sailing", "事务"]
    got = {}
    for r in L.lexical_search(spark.createDataFrame(list(enumerate(questions)), "query_id long, text string"), porter.stemmed_index(blocks), 50).collect():
        got.setdefault(r.query_id, {})[r.block_uid] = r.lex_score
    for q, text in enumerate(questions[:3]):
        tokens = re.findall("[a-z]+", text)
        df = {t: con.execute("select count(*) from t where t match ?", (f'"{t}"',)).fetchone()[0] for t in tokens}
        keep = [t for t in tokens if not (df[t] >= 12 and df[t] / len(texts) >= 0.25)] or [min(tokens, key=df.get)]
        weight = {t: math.log((len(texts) + 1) / (df[t] + 1)) + 1 for t in keep}
        rows = con.execute("select id, x, bm25(t) from t where t match ? order by 3", (" OR ".join(f'"{t}"' for t in keep),)).fetchall()
        low, high = min(r[2] for r in rows), max(r[2] for r in rows)
        for i, x, score in rows:
            covered = sum(w for t, w in weight.items() if t in x.split())
            want = 0.7 * (1 - (score - low) / ((high - low) or 1)) + 0.3 * covered / sum(weight.values())
            assert abs(got[q][i] - want) < 1e-4, (text, x)
        assert len(got[q]) == len(rows)
    assert got[3] == {40: 1.0}


def test_a_token_with_underscores_is_a_phrase_as_in_sqlite(spark):
    """BM25, rows and df of `foo_bar` tokens against FTS5's phrases; repeated words, gaps, three parts."""
    from blockrank.operators import lexical as L

    rng = random.Random(31)
    texts = [" ".join(rng.choice(("foo", "bar", "baz", "foos", "qux", "foo_bar", "Foo-bar")) for _ in range(rng.randint(2, 15))) for _ in range(60)] + ["nothing", "foo foo foo", "bar foo"]
    blocks = spark.createDataFrame([(i, f"n{i}", t) for i, t in enumerate(texts)], "block_uid long, note_path string, clean_text string")
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table t using fts5(id unindexed, x, tokenize='porter')")
    con.executemany("insert into t values (?, ?)", list(enumerate(texts)))
    asked = ["foo_bar", "foo_foo", "bar_foo_baz", "_qux_", "foo_quux", "foo_bar_foo_bar"]
    index = porter.stemmed_index(blocks)
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id long, text string")
    tokens, index = L.with_phrases(L.query_terms(queries), index)
    known = L.token_df(tokens, index)
    for r in known.collect():
        assert r.df == con.execute("select count(*) from t where t match ?", (f'"{r.token}"',)).fetchone()[0], r.token
    got = {}
    for r in L.bm25_top(known, index, 100).collect():
        got.setdefault(r.query_id, {})[r.block_uid] = r.bm25
    for q, token in enumerate(asked):
        want = dict(con.execute("select id, -bm25(t) from t where t match ?", (f'"{token}"',)).fetchall())
        assert got.get(q, {}).keys() == want.keys()
        assert all(abs(got[q][i] - max(v, 0)) < 1e-4 for i, v in want.items()), token
    found = {r.block_uid for r in L.lexical_search(queries.filter("query_id = 0"), porter.stemmed_index(blocks), 100).collect()}
    assert found == set(dict(con.execute("select id, 0 from t where t match '\"foo_bar\"'").fetchall()))


def test_an_underscore_belongs_to_the_word(spark):
    """The rule of whole words: neither side may be a letter, a digit or an underscore."""
    import re

    texts = ["snake_case", "snake case", "a snake", "_snake", "snakes", "snake", "x-snake-y", "case snake_", "分布式snake", "Snake.case"]
    rows = spark.createDataFrame([(t.lower(), w) for t in texts for w in ("snake", "snake_case", "case", "式")], "low string, token string")
    from blockrank.operators import lexical as L

    for r in rows.select("low", "token", L.token_in_text(F.col("token"), F.col("low")).alias("got"), F.array_contains(T.word_keys(F.col("low")), F.col("token")).alias("key")).collect():
        plain = re.fullmatch("[0-9A-Za-z_]+", r.token) is not None
        want = bool(re.search(rf"(?<![0-9A-Za-z_]){re.escape(r.token)}(?![0-9A-Za-z_])", r.low)) if plain else r.token in r.low
        assert r.got == want and (not plain or r.key == want), r


def test_a_filtered_search_equals_a_search_over_the_filtered_corpus(spark):
    from blockrank.plans import engine

    rng = random.Random(17)
    words = "boat sail crew harbour recipe cook salt storm rope tide".split()
    rows = [(i, f"n{i % 9}", [], "", " ".join(rng.choice(words) for _ in range(12)), [rng.gauss(0, 1) for _ in range(4)]) for i in range(90)]
    blocks = spark.createDataFrame([r[:5] for r in rows], "block_uid long, note_path string, heading_path array<string>, raw_text string, clean_text string")
    vectors = spark.createDataFrame([(r[0], r[1], r[5]) for r in rows], "block_uid long, note_path string, embedding array<double>")
    notes = spark.createDataFrame([(f"n{i}", ["x"] if i % 2 else ["y", "z"] if i % 3 else None) for i in range(9)], "path string, tags array<string>")
    asked = spark.createDataFrame([(1, "boat storm", [1.0, 0.0, 0.5, 0.0]), (2, "cook salt", [0.0, 1.0, 0.0, -1.0])], "query_id long, text string, embedding array<double>")
    allowed = {f"n{i}" for i in range(9) if i % 2 == 0 and i % 3}
    only = lambda df: df.filter(F.col("note_path").isin(sorted(allowed)))
    got = engine.search(asked, engine.filtered(engine.Corpus(blocks, vectors), notes, ["z", "none"]))
    want = engine.search(asked, engine.Corpus(only(blocks), only(vectors)))
    cols = ["query_id", "block_uid", "final_score", "ord"]
    rows_of = lambda df: sorted(map(tuple, df.select(*cols).collect()))
    assert rows_of(got) == rows_of(want) and {r.note_path for r in got.collect()} <= allowed


def test_nothing_stays_cached_after_a_search_is_closed(spark):
    from blockrank.plans import engine

    spark.catalog.clearCache()
    blocks = spark.createDataFrame([(i, f"n{i}", [], "", f"boat number{i} storm") for i in range(20)], "block_uid long, note_path string, heading_path array<string>, raw_text string, clean_text string")
    corpus = engine.Corpus(blocks, spark.createDataFrame([(1, "n1", [1.0])], "block_uid long, note_path string, embedding array<double>"))
    asked = spark.createDataFrame([(1, "boat storm", [1.0])], "query_id long, text string, embedding array<double>")
    manager = spark._jsparkSession.sharedState().cacheManager()
    assert engine.search(asked, corpus).count() and not manager.isEmpty()
    corpus.close()
    assert manager.isEmpty()


def test_cell_index_finds_nearly_all_neighbours(spark, monkeypatch):
    from blockrank.operators import ann as A
    from blockrank.operators import vectors as V

    e = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    own = e.select(F.col("vec_id").alias("block_uid"), F.col("label").cast("string").alias("note_path"), "embedding")
    asked = e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding", F.lit(None).cast("string").alias("exclude_note"))
    exact = V.cosine_top(own, asked, 10).persist()
    assert A.recall(A.search(A.build(own), asked, 10), exact) >= 0.9
    # all cells: the exact search; cells in parts, queries in blocks
    monkeypatch.setattr(V, "VECTOR_BLOCK", 40)
    monkeypatch.setattr(V, "QUERY_BLOCK", 7)
    every = A.search(A.build(own, 8), asked, 10, probes=8)
    assert sorted(map(tuple, every.collect())) == sorted(map(tuple, exact.collect()))
    none = A.search(A.build(own.limit(0)), asked, 5)
    assert none.count() == 0


def test_new_notes_come_as_a_stream(spark, tmp_path):
    from blockrank.streaming.watch import watch

    root, seen = _vault(tmp_path, a="first note"), []
    handle = lambda notes, batch: seen.append(sorted(r.path for r in notes.collect()))
    watch(spark, str(root), str(tmp_path / "c"), handle).awaitTermination(60)
    _vault(tmp_path, b="second note")
    watch(spark, str(root), str(tmp_path / "c"), handle).awaitTermination(60)
    assert [x for x in seen if x] == [["a.md"], ["b.md"]]


def test_requests_are_counted_and_timed(spark, tmp_path):
    from blockrank.metrics import Metrics

    m = Metrics(spark, str(tmp_path / "m"))
    df = spark.createDataFrame([(1, 0.5), (1, 0.7), (2, 0.1)], "query_id long, final_score double")
    assert len(m.run("search", df)) == 3 and m.run("search", df.filter("query_id = 1"), best=F.max("final_score"))[0].query_id == 1
    assert m.last == {"rows": 2, "best": 0.7, "queries": 1}
    m.run("blocks", df.select("final_score"), action=DataFrame.count)
    try:
        m.run("search", df.select(F.raise_error(F.lit("no"))))
        raise AssertionError
    except Exception as e:
        assert "no" in str(e)
    assert {(r.kind, r.status): (r.requests, r["rows"]) for r in m.counts().collect()} == {("search", "success"): (2, 5), ("blocks", "success"): (1, 3), ("search", "failed"): (1, None)}
    rows = {(r.kind, r.le): r.requests for r in m.latencies().collect()}
    assert rows["search", float("inf")] == 3 and rows["blocks", float("inf")] == 1
    assert all(rows["search", a] <= rows["search", b] for a, b in zip((0.1, 1.0, 60.0), (0.25, 5.0, float("inf")), strict=True))


def test_a_note_is_indexed_once_it_is_quiet(spark, tmp_path):
    """Three quick edits of one note and one of another: one index call for each."""
    import time

    from blockrank.streaming.watch import index_quiet_notes

    held = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    calls, inbox = [], tmp_path / "inbox"
    inbox.mkdir()

    class Recorder:
        def index_file(self, path, job_id):
            calls.append(path)

    changes = spark.readStream.schema("path string, seen timestamp").json(str(inbox))
    query = index_quiet_notes(changes, Recorder(), str(tmp_path / "c"), quiet_seconds=6.0)
    try:
        for i, path in enumerate(("a.md", "a.md", "b.md", "a.md")):
            (tmp_path / "one").write_text(f'{{"path": "{path}", "seen": "2024-01-01T00:00:0{i}Z"}}')
            (tmp_path / "one").rename(inbox / f"{i}.json")
            time.sleep(0.5)
        end = time.time() + 120
        while len(calls) < 2 and time.time() < end:
            time.sleep(0.5)
        time.sleep(4)
    finally:
        query.stop()
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", held) if held else spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert sorted(calls) == ["a.md", "b.md"]


def test_exclude_dirs_are_resolved_against_the_vault(spark, tmp_path):
    from blockrank.sources import vault

    root = str(tmp_path / "vault")
    cases = {"a": "a", "a/": "a", "./a/b": "a/b", "a/../c": "c", "../out": None, "a/../../out": None, f"{root}/x/y": "x/y", "/elsewhere": None, "": None, ".": "", f"file://{root}/z": "z", root: "", f"{root}2/q": None}
    for given, want in cases.items():
        assert vault.normal_dirs([given], root) == ([] if want is None else [want]), given
    (tmp_path / "vault" / "a" / "b").mkdir(parents=True)
    (tmp_path / "vault" / "ab").mkdir()
    for p in ("a/one.md", "a/b/two.md", "ab/three.md", "four.md"):
        (tmp_path / "vault" / p).write_text("x")
    paths = lambda **kw: sorted(r.path for r in vault.scan(spark, root, **kw).select("path").collect())
    assert paths(dirs=[f"{root}/a/b", "../vault2"]) == ["a/one.md", "ab/three.md", "four.md"]
    assert paths(dirs=["ab/../a"]) == ["ab/three.md", "four.md"] and paths(dirs=["."]) == []
    copy = vault.copy_subset(spark, root, "a", str(tmp_path / "copy"))
    assert sorted(r.path for r in vault.read_notes(copy).collect()) == ["a/b/two.md", "a/one.md"]


def test_evaluation_report_is_written(spark, tmp_path):
    from blockrank.operators import evaluation as E

    pred = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (2, 20, 1)], "query_id long, target long, rank int")
    truth = spark.createDataFrame([(1, 10), (1, 12), (2, 21)], "query_id long, target long")
    metrics = E.write_report(E.prediction_table(pred, truth), str(tmp_path / "r"))
    assert metrics["hit_at_5"] == 0.5 and metrics["mrr"] == 0.5
    text = "\n".join(r.value for r in spark.read.text(str(tmp_path / "r" / "report")).collect())
    assert "Worst misses" in text and "- mrr: 0.5000" in text
    assert spark.read.json(str(tmp_path / "r" / "predictions")).count() == 2
    assert spark.read.json(str(tmp_path / "r" / "metrics")).first().mrr == 0.5
