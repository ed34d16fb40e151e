"""The pipeline's stages on the smallest tables, each held against its own input, and against brute force on a small one."""

import base64
import random
import re

import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from blockrank.llm import bpe, language_id, registry
from blockrank.llm.common import materialise

from .test_operators import ODD, docs, leaks_brute, lines_brute, near_brute, prose

DIR = "/root/testdata/sf0.001"


def test_stages(spark):
    table = spark.read.parquet(f"{DIR}/documents.parquet")
    columns = table.columns
    kept = {"start": {r.doc_id: r.text for r in table.collect()}}
    before = "start"
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        table = materialise(stage(spark, table, DIR), f"test-{name}")
        kept[name] = {r.doc_id: r.text for r in table.collect()}
        assert set(kept[name]) <= set(kept[before])
        assert table.columns == columns + ["token_ids"] * (i == len(corpus_pipeline.STAGES) - 1)
        before = name
    assert len(kept["language_id"]) >= 0.98 * len(kept["start"])
    assert set(kept["line_dedup"]) == set(kept["language_id"])
    texts = list(kept["near_dedup"].values())
    assert len(set(texts)) == len(texts)
    bench = [r.text for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    flat = lambda t: " ".join(re.findall(r"[^\W_]+", t.lower()))
    left = [flat(t) for t in kept["decontamination"].values()]
    assert not any(flat(b) in t for b in bench for t in left)
    assert kept["byte_bpe"] == kept["decontamination"]


def test_each_stage_equals_brute_force(spark, tmp_path):
    """Every stage but the first on what its predecessor kept; the first rejects what `identify` scores under its threshold."""
    rng = random.Random(21)
    shared = [prose(rng, 25), prose(rng, 12)]
    items = [prose(rng, 30), prose(rng, 22)]
    texts = [t for t in ODD if len(t or "") < 4000]
    for i in range(30):
        lines = [prose(rng, rng.randint(10, 40)) for _ in range(3)]
        if i % 4 == 0:
            w = rng.choice(shared).split()
            w[rng.randrange(len(w))] = prose(rng, 1)
            lines.insert(rng.randrange(3), " ".join(w))
        if i % 7 == 3:
            lines.append(f"so {rng.choice(items)} then")
        texts.append("\n".join(lines))
    for t in texts[-8:-2]:
        w = t.split(" ")
        for _ in range(2):
            w[rng.randrange(len(w))] = prose(rng, 1)
        texts.append(" ".join(w))
    table = docs(spark, texts, {i: ("xx", "yy")[i % 2] for i in range(len(texts))})
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stages = dict(corpus_pipeline.STAGES)
    run = lambda name, df: {r.doc_id: r for r in materialise(stages[name](spark, df, str(tmp_path)), "brute").orderBy("doc_id").collect()}
    again = lambda kept: docs(spark, []).union(spark.createDataFrame(list(kept.values()), table.schema)) if kept else docs(spark, [])

    seen = run("language_id", table)
    judged = language_id.identify(table, language_id.fit(table)).collect()
    assert set(seen) == {r.doc_id for r in judged if r.accepted} and all(seen[i].text == texts[i] for i in seen)
    # later stages are tried on the whole table, so that odd texts reach them, too
    own = {r.doc_id: r for r in table.collect()}
    lined = run("line_dedup", again(own))
    want = lines_brute([own[i].text for i in sorted(own)])
    assert {i: lined[i].text for i in own} == {i: None if own[i].text is None else "\n".join(want[i]) for i in own}
    ids = sorted(lined)
    root = near_brute([lined[i].text for i in ids])
    near = run("near_dedup", again(lined))
    assert sorted(near) == sorted({ids[r] for r in root}) and len(near) < len(lined)
    ids = sorted(near)
    leaked = {ids[i] for i, _ in leaks_brute([near[i].text for i in ids], items)}
    clean = run("decontamination", again(near))
    assert set(clean) == set(near) - leaked and leaked
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    last = stages["byte_bpe"](spark, again(clean), str(tmp_path))
    decoded = bpe.decode(last, bpe.public_tokenizer(spark)).collect()
    assert {r.doc_id for r in decoded} == set(clean)
    for r in decoded:
        assert list(r.token_ids) == enc.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode()


def test_registry_has_every_operator():
    names = registry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))


def test_columns_with_names_of_results_pass_through(spark):
    table = spark.read.parquet(f"{DIR}/documents.parquet")
    clash = {k: F.lit(f"own {k}") for k in ("score", "accepted", "lang_pred", "n_lines", "n_removed", "words", "key", "id", "item_id", "similarity", "class_id")}
    table = table.withColumns(clash)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, table, DIR)
        row = out.first()
        assert all(row[k] == f"own {k}" for k in clash)
