"""Each operator on small tables: brute-force versions, round trips, and awkward rows."""

import base64
import collections
import hashlib
import math
import random
import re
import tracemalloc
import types
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet
import pytest
import tiktoken
from pyspark.sql import functions as F

from blockrank.llm import bpe, chat_format, decontaminate, language_id, line_dedup, lm_score, near_dedup, quality, training_order, url_filter
from blockrank.llm.common import crc_mod, give_back

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, text_sha string"


def docs(spark, texts, langs=None):
    return spark.createDataFrame([(i, t, (langs or {}).get(i, "en"), "s", None if t is None else len(t), None) for i, t in enumerate(texts)], DOCS)


def prose(rng, n, syllables=("ta", "ko", "mi", "re", "lu", "sha", "von", "pe", "dri", "nost")):
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(n))


ODD = [None, "", " ", "\n\n", "a", "é", "日本語 テキスト", "x" * 3000, "||||" * 200, "a b c", "a b c", "word " * 5000, "tab\tnew\x0bline\x0c end", "🙂 emoji 🙂", "don't they're I'LL 123 456abc", "  lead and trail  \n"]


@pytest.fixture(scope="module")
def tok(spark):
    return bpe.public_tokenizer(spark)


def test_bpe_equals_the_library(spark, tok):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [*ODD, prose(random.Random(1), 300), "qwrtzpsdfg" * 300, "<|endoftext|>"]
    out = bpe.decode(bpe.encode(docs(spark, texts), tok, chunk_bytes=2000), tok).collect()
    assert len(out) == len(texts)
    for r in out:
        want = texts[r.doc_id] or ""
        assert list(r.token_ids) == enc.encode_ordinary(want), r.doc_id
        assert bytes(r.decoded) == want.encode()
    assert bpe.encode(docs(spark, []), tok).count() == 0
    assert bpe.heap_merges(b" international", ranks) == enc.encode_ordinary(" international")


def lines_brute(texts):
    first, all_ = {}, []
    for i, t in enumerate(texts):
        for k, line in enumerate((t or "").split("\n")):
            w = WORD.findall(line)
            s = frozenset(w) if w else None
            all_.append((i, k, s, line))
            if s:
                first[s] = min(first.get(s, (i, k)), (i, k))
    gone = {a for a in first for b in first if first[b] < first[a] and len(a & b) / len(a | b) >= 0.8 - 1e-12}
    out = collections.defaultdict(list)
    for i, k, s, line in all_:
        if s is None or (first[s] == (i, k) and s not in gone):
            out[i].append(line)
    return out


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(2)
    base = [prose(rng, n) for n in (3, 5, 8, 40, 60)]
    texts = [*ODD]
    for _ in range(60):
        lines = []
        for _ in range(rng.randint(1, 4)):
            w = rng.choice(base).split()
            if rng.random() < 0.6:
                w[rng.randrange(len(w))] = prose(rng, 1)
            lines.append(" ".join(w))
        texts.append("\n".join(lines))
    got = {r.doc_id: r for r in line_dedup.dedup_lines(docs(spark, texts)).collect()}
    want = lines_brute(texts)
    for i, t in enumerate(texts):
        assert got[i].text == (None if t is None else "\n".join(want[i])), i
    assert sum(r.n_removed for r in got.values()) > 20
    twice = docs(spark, ["one line of some words here"]).union(docs(spark, ["one line of some words here"]))
    assert [r.n_removed for r in line_dedup.dedup_lines(twice).collect()] == [0, 0]
    assert line_dedup.dedup_lines(docs(spark, [])).count() == 0


@pytest.mark.parametrize("longest_list", [4096, 8])
def test_line_dedup_finds_edited_lines_of_any_length(spark, monkeypatch, longest_list):
    """Lines of 8 to 30 words with one or more words changed, dropped or added; short posting lists, too."""
    monkeypatch.setattr(line_dedup, "LIST", longest_list)
    rng = random.Random(longest_list)
    common = ["the", "of", "and", "to", "in", "a"]
    texts = []
    for _ in range(40):
        base = [rng.choice(common) if rng.random() < 0.4 else prose(rng, 1) for _ in range(rng.randint(8, 30))]
        for _ in range(rng.randint(1, 6)):
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                at = rng.randrange(len(w))
                w[at : at + rng.randint(0, 1)] = [prose(rng, 1)] * rng.randint(0, 1)
            texts.append(" ".join(w) + "\nof the and " + " ".join(rng.sample(common, rng.randint(1, 4))))
    texts.append(" ".join(f"w{i}" for i in range(2000)) + "\n" + " ".join(f"w{i}" for i in range(150, 2100)))
    rng.shuffle(texts)
    got = {r.doc_id: r for r in line_dedup.dedup_lines(docs(spark, texts)).collect()}
    want = lines_brute(texts)
    for i in range(len(texts)):
        assert got[i].text == "\n".join(want[i]), i
    assert sum(r.n_removed for r in got.values()) > 100


def word_similarity(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last, row = row, [0]
        for j, y in enumerate(b):
            row.append(last[j] + 1 if x == y else max(row[j], last[j + 1]))
    return row[-1] / (len(a) + len(b) - row[-1])


def near_brute(texts):
    words = [tuple(WORD.findall(t or "")) for t in texts]
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            m, n = len(words[i]), len(words[j])
            same = (texts[i] or "") == (texts[j] or "")
            if same or (min(m, n) and min(m, n) >= 0.8 * max(m, n) and len(set(words[i]) & set(words[j])) and word_similarity(words[i], words[j]) >= 0.8):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(texts))]


def test_near_classes_equal_brute_force(spark):
    rng = random.Random(4)
    texts = [*ODD]
    for _ in range(12):
        base = prose(rng, rng.choice((9, 30, 120))).split()
        for edits in (0, 0, 1, 2, 6, 15):
            w = list(base)
            for _ in range(min(edits, len(w) - 1)):
                w[rng.randrange(len(w))] = prose(rng, 1)
            texts.append(" ".join(w))
    got = {r.id: r.class_id for r in near_dedup.near_classes(docs(spark, texts)).collect()}
    want = near_brute(texts)
    assert [got[i] for i in range(len(texts))] == want
    stage = near_dedup.near_stage(spark, docs(spark, texts), "")
    assert sorted(r.doc_id for r in stage.collect()) == sorted(set(want))


@pytest.mark.parametrize("share", [0.04, 0.05])
def test_near_copies_with_scattered_edits_are_caught(spark, share):
    rng = random.Random(int(share * 100))
    texts = []
    for _ in range(100):
        w = prose(rng, 300).split()
        texts.append(" ".join(w))
        for i in rng.sample(range(300), int(300 * share)):
            w[i] = prose(rng, 1)
        texts.append(" ".join(w))
    got = {r.id: r.class_id for r in near_dedup.near_classes(docs(spark, texts)).collect()}
    assert all(got[2 * i] == got[2 * i + 1] == 2 * i for i in range(100))


def test_links_within_a_bucket_are_not_lost_and_groups_may_be_large(spark, monkeypatch):
    """Texts that share a passage but not their class, with chains among them; tiles of 8 texts."""
    monkeypatch.setattr(near_dedup, "TILE", 8)
    rng = random.Random(7)
    passage = prose(rng, 60).split()
    texts = []
    for _ in range(12):
        w = passage + prose(rng, 40).split()
        for _ in range(5):
            texts.append(" ".join(w))
            w = list(w)
            for i in rng.sample(range(60, 100), 8):
                w[i] = prose(rng, 1)
    hub = prose(rng, 50).split()
    texts += [" ".join(hub[:49] + [f"x{i}"]) for i in range(600)]
    got = {r.id: r.class_id for r in near_dedup.near_classes(docs(spark, texts)).collect()}
    assert [got[i] for i in range(60)] == near_brute(texts[:60])
    assert {got[i] for i in range(60, 660)} == {60}


def test_near_classes_with_shared_ids_do_not_depend_on_partitions(spark):
    rng = random.Random(9)
    a, b = prose(rng, 100), prose(rng, 100)
    rows = [(0, a), (0, b), (5, a + " more"), (6, b + " more"), (None, a), (None, prose(rng, 50))]
    table = spark.createDataFrame([(i, t, "en", "s", None, None) for i, t in rows], DOCS)
    found = [sorted((repr(r.id), repr(r.class_id), r.copies) for r in near_dedup.near_classes(table.repartition(n)).collect()) for n in (1, 2, 4)]
    assert found[0] == found[1] == found[2]
    assert ("5", "0", 1) in found[0] and ("6", "0", 1) in found[0] and ("None", "None", 1) in found[0]


def test_stages_tell_rows_by_text_where_ids_are_null_or_shared(spark, tmp_path):
    rng = random.Random(15)
    a, b, c, d, item = (prose(rng, 80) for _ in range(5))
    near = lambda t: f"{t} more"
    rows = [(1, a), (1, b), (2, b), (3, near(b)), (4, near(a)), (None, c), (None, near(c)), (None, d), (None, a), (1, a)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    left = [(r.doc_id, r.text) for r in near_dedup.near_stage(spark, table, "").collect()]
    assert len(left) == 4 and {(1, a), (1, b), (None, d)} < set(left) and {(None, c), (None, near(c))} & set(left)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, f"{a} {item}"), (None, b), (5, item), (5, c), (6, None), (None, None)]
    left = decontaminate.decontaminate_stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path)).collect()
    assert {(r.doc_id, r.text) for r in left} == {(None, b), (5, c), (6, None), (None, None)}


def test_alignment_keeps_to_the_order():
    a = np.arange(100, dtype=np.uint64)
    b = a.copy()
    b[50] = 1000
    assert near_dedup.aligned_similarity(a, a) == 1.0
    assert near_dedup.aligned_similarity(a, b) == pytest.approx(99 / 101)
    assert near_dedup.aligned_similarity(a, np.concatenate([a[50:], a[:50]])) < 0.8
    assert near_dedup.aligned_similarity(a, a[:70]) == 0.0


def leaks_brute(texts, items):
    """(text, item) where a window of the item's length has 0.8 of its five-word runs."""
    split = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    grams = lambda w: collections.Counter(tuple(w[j : j + 5]) for j in range(len(w) - 4)) if len(w) >= 5 else collections.Counter([tuple(w)])
    out = set()
    for i, t in enumerate(texts):
        for k, item in enumerate(items):
            v, x = split(item), split(t)
            if v and x and any(sum((grams(x[s : s + len(v)]) & grams(v)).values()) / sum((grams(x[s : s + len(v)]) | grams(v)).values()) >= 0.8 for s in range(max(1, len(x) - len(v) + 1))):
                out.add((i, k))
    return out


def _edited(rng, words, kind, similarity, even):
    """words with single changes of one kind, so that the alignment has about the given similarity."""
    n = len(words)
    share = {"replace": 1 - 2 * similarity / (1 + similarity), "insert": 1 / similarity - 1, "delete": 1 - similarity}[kind]
    places = [int((i + 0.5) / share) for i in range(int(n * share))] if even else rng.sample(range(n), int(n * share))
    out = list(words)
    for p in sorted(places, reverse=True):
        out[p : p + (kind != "insert")] = [rng.choice(words) if rng.random() < 0.5 else prose(rng, 1)] * (kind != "delete")
    return out


@pytest.mark.parametrize("kind", ["replace", "insert", "delete"])
def test_near_copies_share_a_band_however_the_changes_lie(kind):
    """Of pairs that align by 0.80 to 0.85: scattered and even changes, texts of 12, 60 and 300 words."""
    rng = random.Random(hash_seed := len(kind))
    vocabulary = [prose(rng, 1) for _ in range(1500)]
    weights = [1 / (i + 4) for i in range(1500)]
    for n in (12, 60, 300):
        for even in (False, True):
            for similarity in (0.81, 0.85):
                texts = []
                for _ in range(120):
                    w = rng.choices(vocabulary, weights, k=n)
                    texts += [" ".join(w), " ".join(_edited(rng, w, kind, similarity, even))]
                column = pyarrow.array(texts)
                words = near_dedup._sequences(column)
                first = np.concatenate([[0], np.cumsum([len(w) for w in words])])
                flat, begin = near_dedup.bands_of(np.concatenate(words), first)
                met = [len(np.intersect1d(flat[begin[i] : begin[i + 1]], flat[begin[i + 1] : begin[i + 2]])) > 0 for i in range(0, len(texts), 2) if near_dedup.aligned_similarity(words[i], words[i + 1]) >= 0.8]
                assert len(met) > 20 and np.mean(met) >= 0.93, (n, even, similarity, np.mean(met), hash_seed)


def test_bands_take_the_least_kmers_in_text_order():
    rng = random.Random(9)
    words = np.array([rng.getrandbits(63) for _ in range(400)], dtype=np.uint64)
    first = np.array([0, 1, 3, 3, 40, 400])
    got = near_dedup.order_sketches(words, first, 1, 5, 7)
    labelled, begin = near_dedup.labelled_kmers(words, first, 1)
    for s in range(5):
        seed = near_dedup.mix(np.arange(1, 6, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F) + np.uint64(7001))[s]
        for t in range(5):
            own = labelled[begin[t] : begin[t + 1]]
            if not len(own):
                assert got[t, s] == 0
                continue
            h = (own ^ seed) * np.uint64(0xFF51AFD7ED558CCD)
            h ^= h >> np.uint64(32)
            band = np.array([seed])
            for x in own[np.sort(np.argsort(h, kind="stable")[:7])]:
                band = near_dedup.mix(band * np.uint64(0x8EBC6AF09C88C6E3) + np.array([x]))
            assert got[t, s] == band[0]


def test_banded_matches_equal_the_table():
    rng = random.Random(10)
    for _ in range(60):
        a = [rng.randrange(6) for _ in range(rng.randint(1, 60))]
        b = [x if rng.random() < 0.8 else rng.randrange(6) for x in a][: rng.randint(1, 60)]
        for width in (0, 3, 100):
            best = np.zeros((len(a) + 1, len(b) + 1), dtype=int)
            for i, x in enumerate(a):
                for j, y in enumerate(b):
                    best[i + 1, j + 1] = max(best[i, j + 1], best[i + 1, j], best[i, j] + (x == y and abs(i - j) <= width))
            assert near_dedup.banded_matches(a, b, width) == best[-1, -1]
    long = [rng.randrange(5000) for _ in range(9000)]
    cut = [x for i, x in enumerate(long) if i % 9]
    assert near_dedup.banded_matches(long, cut, 1100) == len(cut)


def test_decontamination_of_items_that_hold_each_other(spark):
    """Items of many lengths, nested and overlapping: each is met by windows of its own length only."""
    rng = random.Random(21)
    base = prose(rng, 200).split()
    spans = [(0, 20), (0, 24), (0, 30), (4, 24), (10, 60), (15, 55), (12, 62), (40, 44), (41, 44), (60, 180), (60, 160), (100, 112), (99, 112), (100, 113)]
    items = [" ".join(base[a:b]) for a, b in spans]
    texts = []
    for a, b in spans:
        w = base[a:b]
        texts += [" ".join(w), f"{prose(rng, 40)} {' '.join(w)} {prose(rng, 40)}"]
        at = rng.randrange(len(w))
        texts.append(" ".join([*prose(rng, 9).split(), *w[:at], *prose(rng, 1).split(), *w[at:], *prose(rng, 9).split()]))
        texts.append(" ".join([*prose(rng, 9).split(), *w[:at], *w[at + 1 :], *prose(rng, 9).split()]))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs(spark, texts), bench).collect()}
    want = leaks_brute(texts, items)
    assert got == want and len(want) > 40


def test_blocks_meet_few_pairs_of_windows_and_items(spark):
    rng = random.Random(22)
    rows = [(i, prose(rng, 12 + i % 20)) for i in range(400)]
    items = decontaminate.prepare_items(spark.createDataFrame(rows, "item_id long, text string"))
    other = decontaminate.prepare_items(spark.createDataFrame([(i, prose(rng, 12 + i % 20)) for i in range(400)], "item_id long, text string"))
    assert decontaminate.met_in_blocks(other.withColumnRenamed("item_id", "id"), items).count() < 0.05 * 400 * 400
    assert decontaminate.met_in_blocks(items.withColumnRenamed("item_id", "id"), items).filter("id = item_id").select("id").distinct().count() == 400


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(5)
    items = [prose(rng, n) for n in (20, 35, 50)] + ["just three words", "", None]
    texts = [*ODD, items[0], f"{prose(rng, 30)} {items[1]}, {prose(rng, 9)}", f"{prose(rng, 5)}\n{items[2].upper()}", f"x just three words y {items[0]} {items[2]}"]
    w = items[2].split()
    texts += [" ".join([*prose(rng, 8).split(), *w[:1], *w[2:], *prose(rng, 4).split()]), " ".join(w[:30]), prose(rng, 200)]
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id long, text string")
    want = leaks_brute(texts, items)
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs(spark, texts), bench).collect()}
    assert got == want and len(want) >= 6
    assert decontaminate.contaminated(docs(spark, texts), bench.limit(0)).count() == 0
    assert decontaminate.contaminated(docs(spark, []), bench).count() == 0


def test_decontamination_tries_all_starts(spark):
    rng = random.Random(13)
    items = [prose(rng, 59), prose(rng, 120), prose(rng, 40), prose(rng, 7), "one two three"]
    texts = []
    for item in items[:4]:
        w = item.split()
        n = len(w)
        odd = lambda k: [f"odd{rng.randrange(10**9)}" for _ in range(k)]
        for insert, lead, tail in ((2, 30, 30), (4, 200, 0), (2, 0, 200), (6, 3, 3), (1, 0, 0)):
            for ends in (1, 2, 3):
                inner = w[ends : n - ends]
                for changed in (inner[: n // 2] + odd(insert) + inner[n // 2 :], inner[: n // 3] + inner[n // 3 + insert :], inner[n // 2 :] + inner[: n // 2]):
                    texts.append(" ".join([*odd(lead), *odd(ends), *changed, *odd(ends), *odd(tail)]))
        for turn in (0, n // 3, n // 2):
            texts.append(" ".join([*odd(9), *w[turn:], *w[:turn], *odd(9)]))
        texts += [" ".join(w[: n - 2]), " ".join(w * 3)]
    split = lambda t: re.findall(r"[^\W_]+", t.lower())
    grams = lambda w: collections.Counter(tuple(w[j : j + 5]) for j in range(len(w) - 4)) if len(w) >= 5 else collections.Counter([tuple(w)])
    want = {}
    for i, t in enumerate(texts):
        for k, item in enumerate(items):
            v, x = split(item), split(t)
            g = grams(v)
            best = max(sum((h & g).values()) / sum((h | g).values()) for s in range(max(1, len(x) - len(v) + 1)) for h in [grams(x[s : s + len(v)])])
            if best >= 0.8:
                want[i, k] = pytest.approx(best)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.contaminated(docs(spark, texts), bench).collect()}
    assert got == want and len(want) >= 40


def lm_brute(texts, learn):
    """Scores by a loop over decisions: counts of contexts in a dict, one text after the other."""
    m = lm_score
    spelled = [b"".join(w.encode().lower() + b" " for w in WORD.findall(t or "")) + b"\n" for t in texts]  # bytes: only A-Z
    pairs = np.zeros(1 << 16, dtype=np.int64)
    for s, on in zip(spelled, learn, strict=True):
        for i, b in enumerate(s if on else b""):
            pairs[(s[i - 1] if i else 10) << 8 | b] += 1
    trees = m.Trees(pairs)
    bits = tuple(min(b, max(12, math.ceil(math.log2(max(1, int(pairs.sum())))) - 2)) for b in m.MAX_BITS)
    base, full = [sum(1 << b for b in bits[:k]) for k in range(4)], (1 << 64) - 1

    def decisions(s):
        start = 0
        for i, b in enumerate(s):
            back = [s[i - j] if i >= j else 10 for j in range(1, 5)]
            if i and s[i - 1] == 32:
                start = i
            wide, ctx = back[0], []
            for j in range(1, 4):
                wide |= back[j] << 8 * j
                ctx.append(wide * int(m._CONTEXT[j - 1]))
            ctx.append(sum((x + 1) * int(m._POWER[q % m._STEPS]) for q, x in enumerate(s[start:i])) * int(m._CONTEXT[3]))
            pair = back[0] << 8 | b
            for at in range(int(trees.begin[pair]), int(trees.begin[pair] + trees.size[pair])):
                slots = [(((c + int(trees.nodes[at])) * int(m._P) & full) >> 64 - n) + base[k] for k, (c, n) in enumerate(zip(ctx, bits, strict=True))]
                yield i, int(trees.bits[at]), slots, min(i - start, m.PLACES - 1)

    counts = np.zeros((2, sum(1 << b for b in bits)))
    for s, on in zip(spelled, learn, strict=True):
        for _, bit, slots, _ in decisions(s) if on else ():
            for x in slots:
                counts[bit, x] += 1
    return spelled, trees, bits, counts, decisions


def lm_brute_scores(spelled, model, decisions):
    m, out = lm_score, []
    for s in spelled:
        weights = model.weights.astype(float)
        ones, all_ = model.counts[1].astype(float), model.counts.sum(axis=0).astype(float)
        total, stop, held = 0.0, m.segment(0), []
        for i, bit, slots, place in [*decisions(s), (len(s), None, None, None)]:
            if i >= stop or bit is None:
                grads, n = np.zeros_like(weights), np.zeros(len(weights))
                for g, err, x, c, y in held:
                    grads[g] += err * x
                    n[g] += 1
                    ones[c] += y
                    all_[c] += 1
                weights += (m.RATE / (n + m.INERTIA))[:, None] * grads
                stop, held = stop + m.segment(stop), []
            if bit is None:
                break
            x = np.array([model.logits[q] / 16 for q in slots])
            g = place * 4 + (x[2] != 0) * 2 + (x[3] != 0)
            z = float(np.clip((x * weights[g]).sum(), -m.LIMIT, m.LIMIT))
            mixed = 1 / (1 + math.exp(-z))
            c = place * m.BUCKETS + int(np.float32(z) * np.float32((m.BUCKETS - 1) / (2 * m.LIMIT)) + np.float32(m.BUCKETS / 2))
            p = (mixed + ones[c] / all_[c]) / 2
            total += math.log10(p if bit else 1 - p)
            held.append((g, bit - mixed, x, c, bit))
        out.append(total)
    return out


def test_language_model_equals_brute_force_on_any_partitions(spark):
    rng = random.Random(5)
    texts = [*(t for t in ODD if len(t or "") < 4000), "Ab" * 1500, prose(rng, 900), *(prose(rng, rng.randint(1, 60)) for _ in range(40)), "Tako MIRE tako", "a b c"]
    while zlib.crc32(str(len(texts)).encode()) % 7 != 2:
        texts.append("a b c")
    texts.append("".join(rng.choice("0123456789abcdef") for _ in range(3000)))
    table = docs(spark, texts)
    learn = [zlib.crc32(str(i).encode()) % 7 != 2 for i in range(len(texts))]
    spelled, trees, bits, counts, decisions = lm_brute(texts, learn)
    rows = table.select("doc_id", "text", F.array(*map(F.lit, learn))[F.col("doc_id").cast("int")].alias("learn"))
    model = lm_score.fit(trees, bits, np.log2(1 + counts.astype(np.float32)), *lm_score._sample(rows))
    want = lm_brute_scores(spelled, model, decisions)
    held = ~F.coalesce(crc_mod("doc_id", 7) == 2, F.lit(False))
    found = [{r.doc_id: r for r in lm_score.lm_scores(table.repartition(n), held).collect()} for n in (1, 8)]
    assert [found[0][i].score for i in range(len(texts))] == pytest.approx(want, rel=1e-4)
    assert [found[1][i].score for i in range(len(texts))] == pytest.approx([found[0][i].score for i in range(len(texts))], rel=1e-12)
    assert found[0][len(texts) - 1].bits_per_byte > 3  # an unseen word of 3000 bytes costs all of its decisions
    tokens = [[*(w.translate({x: x + 32 for x in range(65, 91)}) for w in WORD.findall(t or "")), None] for t in texts]
    count = collections.Counter(w for t, on in zip(tokens, learn, strict=True) if on for w in t)
    n, v = sum(count.values()), len(count)
    for i, t in enumerate(tokens):
        r = found[1][i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t), sum(count[w] > 0 for w in t), n)
        assert r.base_score == pytest.approx(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in t), rel=1e-9)


def test_language_model_edges(spark):
    assert lm_score.lm_scores(docs(spark, []), F.lit(True)).count() == 0
    r = lm_score.lm_scores(docs(spark, ["ab", None]), F.lit(False)).orderBy("doc_id").collect()
    assert [x.train_tokens for x in r] == [0, 0] and [x.n_known for x in r] == [0, 0] and [x.n_tokens for x in r] == [2, 1]
    # nothing learned: every decision has probability 1/2
    assert all(abs(x.score / math.log10(2) - round(x.score / math.log10(2))) < 1e-5 for x in r)
    rng = random.Random(6)
    texts = [prose(rng, rng.randint(5, 80)) for _ in range(120)]
    held = [x.bits_per_byte for x in lm_score.lm_scores(docs(spark, texts), F.col("doc_id") < 100).filter("doc_id >= 100").collect()]
    assert sum(held) / len(held) < 3.2  # far under the 8 bits of a byte, and under the 3.5 that the letters' frequencies alone give here
    twice = spark.createDataFrame([(7, "same text", "en", "s", None, None)] * 2 + [(None, "other", None, None, None, None)], DOCS)
    assert lm_score.lm_scores(twice, F.lit(True)).filter("doc_id = 7").select("score").distinct().count() == 1


def test_quality_base_equals_brute_force(spark):
    texts = [*ODD, "l one\nl two\nl one\n\nl one", "a b c a b c x", "#*$%&|<> <", prose(random.Random(7), 60)]
    for r in quality.judge(docs(spark, texts), None).collect():
        t = texts[r.doc_id] or ""
        w = WORD.findall(t)
        seen, dup = set(), 0
        for line in t.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        runs = collections.Counter(zip(w, w[1:], w[2:], strict=False))
        cover = {i + j for i in range(len(w) - 2) if runs[tuple(w[i : i + 3])] > 1 for j in range(3)}
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(cover)), r.doc_id
        assert r.kept == (not r.base_failed) == (len(w) >= 50 and 100 * len(cover) <= 50 * len(w))


def test_quality_model_on_held_out_rows(spark):
    rng = random.Random(8)
    good = [prose(rng, 80) for _ in range(80)]
    bad = [" ".join(w.upper() + "!!" for w in prose(rng, 80).split()) for _ in range(40)]
    table = docs(spark, good + bad)
    labels = spark.createDataFrame([(i, int(i < 80)) for i in range(120) if i % 2], "doc_id long, quality int").union(spark.createDataFrame([(1, 1), (3, None)], "doc_id long, quality int"))
    out = quality.judge(table, quality.fit(table, labels)).collect()
    assert all(r.kept == (r.doc_id < 80) for r in out if r.doc_id % 2 == 0)
    assert quality.fit(table, labels.limit(0)) is None


def test_language_id(spark):
    rng = random.Random(9)
    sets = {"aa": ("ta", "ko", "mi", "re"), "bb": ("zu", "gri", "vek", "osh"), "cc": ("él", "ñu", "ça", "ôm")}
    texts, langs = list(ODD), dict.fromkeys(range(len(ODD)))
    for i in range(240):
        lang = list(sets)[i % 3]
        langs[len(texts)] = lang
        texts.append(prose(rng, 40, sets[lang]))
    table = docs(spark, texts, langs)
    model = language_id.fit(table)
    got = {r.doc_id: r for r in language_id.identify(table, model).collect()}
    held = [i for i in range(len(ODD), len(texts)) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum(got[i].lang_pred == langs[i] and got[i].accepted for i in held) >= 0.97 * len(held)
    for i in (0, 1, 2, 3, 8):
        assert (got[i].lang_pred, got[i].score, got[i].accepted) == ("und", 0.0, False)
    assert all(0 <= r.score <= 1 for r in got.values()) and got[5].lang_pred in sets
    assert {r.lang_pred for r in language_id.identify(table, None).collect()} == {"und"}
    assert language_id.language_stage(spark, table, "").columns == table.columns


def test_language_id_rejects_unlearned_languages(spark):
    scores = np.random.default_rng(1).random(480)
    for n in (1, 480):
        assert language_id.rejection_threshold(scores[:n], 0.001) == scores[:n].min()
    assert (scores < language_id.rejection_threshold(scores, 0.01)).sum() == 4
    rng = random.Random(14)
    sets = {"aa": ("ta", "ko", "mi", "re"), "bb": ("zu", "gri", "vek", "osh"), "cc": ("él", "ñu", "ça", "ôm"), "dd": ("lun", "dap", "ist", "oe")}
    texts = [prose(rng, 40, sets[lang]) for lang in sets for _ in range(60)]
    other = [prose(rng, 60, ("hy", "qa", "xo", "wp")) for _ in range(40)] + ["привет мир как дела " * 5]
    table = docs(spark, texts + other, {i: list(sets)[i // 60] for i in range(240)} | dict.fromkeys(range(240, 300)))
    got = {r.doc_id: r for r in language_id.identify(table, language_id.fit(table)).collect()}
    assert sum(got[i].accepted for i in range(240)) >= 0.97 * 240
    assert not any(got[i].accepted for i in range(240, 240 + len(other)))


def test_training_order_is_a_permutation_and_resumes(spark, tmp_path):
    for n in (1, 2, 5, 64, 1000):
        assert sorted(training_order.feistel_slots(np.arange(n), n)) == list(range(n))
    texts = [t for t in ODD]
    path = str(tmp_path / "shards")
    total = training_order.write_training_order(docs(spark, texts), "doc_id", "text", path, seq_len=64, per_shard=10)
    rows = sorted(training_order.read_from(spark, path, 0, 10).collect(), key=lambda r: r.slot)
    assert [r.slot for r in rows] == list(range(total)) and all(r.shard == r.slot // 10 and len(r.tokens) == 128 for r in rows)
    back = collections.defaultdict(dict)
    for r in rows:
        back[r.key][r.seq_no] = list(np.frombuffer(bytes(r.tokens), "<u2")[: r.n_tokens])
    for i, t in enumerate(texts):
        ids = [x for k in sorted(back[i]) for x in back[i][k]]
        assert ids == [*(t or "").encode(), training_order.END]
    assert [r.slot for r in sorted(training_order.read_from(spark, path, 37, 10).collect(), key=lambda r: r.slot)] == list(range(37, total))


def test_training_order_of_token_ids_behind_a_shuffle(spark, tok, tmp_path):
    texts = [None, "", *("word " * n + "é 日本" for n in range(1, 60))]
    encoded = bpe.encode(docs(spark, texts), tok).repartition(4)
    end, pad = len(tok.ranks), len(tok.ranks) + 1
    path = str(tmp_path / "ids")
    total = training_order.write_training_order(encoded, "doc_id", None, path, ids="token_ids", end=end, pad=pad, width=4, seq_len=16, per_shard=8)
    got = training_order.read_from(spark, path, per_shard=8).orderBy("slot").collect()
    assert [r.slot for r in got] == list(range(total)) and all(len(r.tokens) == 64 and r.shard == r.slot // 8 for r in got)
    want = {r.doc_id: list(r.token_ids) for r in encoded.collect()}
    for i in range(len(texts)):
        own = sorted((r.seq_no, r.tokens, r.n_tokens) for r in got if r.key == i)
        ids = [int(x) for _, b, n in own for x in np.frombuffer(b, "<u4")[:n]]
        assert ids == [*want[i], end]
    # a seek by slot opens no earlier shard, and files are in order of slots
    late = training_order.read_from(spark, path, slot=21, per_shard=8)
    assert [r.slot for r in late.orderBy("slot").collect()] == list(range(21, total))
    import pyarrow.dataset

    for f in pyarrow.dataset.dataset(path, format="parquet", exclude_invalid_files=True).files:
        slots = pyarrow.parquet.read_table(f, columns=["slot"], partitioning=None)["slot"].to_pylist()
        assert slots == sorted(slots)
    shuffled = docs(spark, texts).repartition(4)
    assert training_order.write_training_order(shuffled, "doc_id", "text", str(tmp_path / "text"), seq_len=16, per_shard=8) > len(texts)
    with pytest.raises(Exception, match="more than 2 bytes"):
        training_order.write_training_order(spark.createDataFrame([(1, [70000])], "doc_id long, token_ids array<int>"), "doc_id", None, str(tmp_path / "no"), ids="token_ids")


def test_urls_rules_and_links(spark):
    urls = [None, "", "no scheme", "HTTP://A.Example.COM/en/7x?q", "http://example.com/en/1", "https://b.net/de/9", "https://x.example.net/de/8#t", "ftp://org", "http://evilcom/en/", "http://com/en/", "http://o.org/es/", "http://h.org?x=/es/", "http://t.org/", "http://bad.com/en/2", "http://friend.net/x"]
    html = {12: '<a href="http://a.example.com/z">x</a>', 14: "<a class=q href='//bad.com/q'>y</a>"}
    pages = spark.createDataFrame([(i, u, html.get(i)) for i, u in enumerate(urls)], "page_id long, url string, html string")
    got = {r.page_id: r for r in url_filter.filter_urls(pages).collect()}
    want = {0: None, 1: None, 2: None, 3: "example.com/en/7", 4: "com/en/", 5: "net/de/", 6: "example.net/de/8", 7: None, 8: None, 9: "com/en/", 10: "org/es/", 11: None}
    assert {i: got[i].rule for i in want} == want
    assert (got[3].host, got[3].path, got[3].verdict) == ("a.example.com", "/en/7x", "allow")
    assert (got[6].path, got[6].verdict, got[11].host, got[11].path, got[2].host) == ("/de/8", "block", "h.org", "", "")
    # friend.net links to a host whose pages are all blocked, and has no rule
    assert got[14].distrust > 0 and got[14].verdict == "block" and got[12].verdict == "allow"
    assert url_filter.filter_urls(pages.limit(0)).count() == 0


def test_propagation_equals_dense_page_rank(spark):
    rng = random.Random(31)
    n = 14
    names = [f"h{i}.example" for i in range(n)]
    pairs = {(i, j) for i in range(n) for j in range(n) if i != j and rng.random() < 0.25} | {(0, j) for j in range(1, n)}
    weight = np.zeros((n, n))
    for i, j in pairs:
        weight[i, j] = 1
    weight /= np.maximum(1, weight.sum(axis=1, keepdims=True))
    hosts = [(names[i], 4, rng.randint(0, 2), rng.randint(0, 2)) for i in range(n)]
    edges = spark.createDataFrame([(names[i], names[j], float(weight[i, j])) for i, j in pairs], "src string, dst string, weight double")
    got = {r.host: r for r in url_filter.judge_hosts(spark.createDataFrame(hosts, "host string, n long, allowed long, blocked long"), edges, rounds=60).collect()}

    def rank(seed, w):
        r = 0.15 * seed
        for _ in range(200):
            r = 0.15 * seed + 0.85 * w.T @ r
        return r

    good = np.array([a / m if a > b else 0 for _, m, a, b in hosts])
    bad = np.array([b / m if b > a else 0 for _, m, a, b in hosts])
    back = weight.T / np.maximum(1e-12, weight.sum(axis=0))[:, None]
    for i, (trust, distrust) in enumerate(zip(rank(good, weight), rank(bad, back), strict=True)):
        r = got[names[i]]
        assert (r.trust, r.distrust) == (pytest.approx(trust, abs=1e-4), pytest.approx(distrust, abs=1e-4))
        assert r.verdict == ("block" if r.distrust >= url_filter.THRESHOLD and r.distrust > r.trust else "allow")
    assert {r.verdict for r in got.values()} == {"allow", "block"}


def test_perspectives_cover_all_text(spark):
    rows = [(1, t, r, f"m{t}") for t, r in enumerate(["system", "ann", "bob", "ann", "cy", None])] + [(1, 2, "bob", "m2")] + [(2, t, "u" if t % 2 else "v", f"x{t}") for t in range(150)] + [(3, None, "ann", None), (3, 1, "bob", "<|im_end|>"), (None, 0, "z", "q"), (4, 0, "system", "alone")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat_format.rotate(table).collect()
    assert sorted((r.perspective, r.n_messages) for r in out if r.conv_id == 1) == [("ann", 7), ("bob", 7), ("cy", 7)]
    assert sorted(r.n_messages for r in out if r.conv_id == 2) == [22, 22, 64, 64, 64, 64]
    assert not [r for r in out if r.conv_id == 4] and len([r for r in out if r.conv_id is None]) == 1
    for r in out:
        mine = "".join(r.text[s.start : s.end] for s in r.spans)
        assert mine.count("<|im_end|>") == len(r.spans) == r.text.count("<|im_start|>assistant\n")
    ann = next(r for r in out if r.conv_id == 1 and r.perspective == "ann")
    assert [ann.text[s.start : s.end] for s in ann.spans] == ["m1<|im_end|>", "m3<|im_end|>"] and "<|im_start|>user name=unknown\nm5" in ann.text
    assert chat_format.rotate(table.limit(0)).count() == 0


def test_hashes_of_the_text_kernel_tell_words_apart():
    from blockrank.llm.text_kernel import span_hashes, word_spans

    words = [hashlib.md5(str(i).encode()).hexdigest()[: 1 + i % 9] for i in range(4000)]
    data = np.frombuffer(" ".join(words).encode(), dtype=np.uint8)
    starts, ends, _ = word_spans(data, np.array([0, len(data)]))
    h = span_hashes(data, starts, ends)
    assert len(set(h.tolist())) == len(set(words)) and len(h) == len(words)


def test_sample_is_bounded_and_fair_where_rows_share_an_id(spark):
    from blockrank.llm import classify

    many = spark.range(6000).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("lang"))
    same = spark.range(3000).select(F.lit(9).cast("long").alias("doc_id"), F.lit("one text").alias("text"), F.lit("c").alias("lang"))
    got = classify.bounded_sample(many.unionByName(same), "doc_id", "lang", 500).to_pylist()
    count = collections.Counter(r["lang"] for r in got)
    assert count == {"a": 500, "b": 500, "c": 1}
    again = classify.bounded_sample(many.unionByName(same).repartition(5), "doc_id", "lang", 500).to_pylist()
    assert again == got
    large = spark.range(400).select("id", F.concat(F.col("id"), F.repeat(F.lit("x"), 60_000)).alias("text"), F.lit("a").alias("lang")).withColumnRenamed("id", "doc_id")
    held = classify.SAMPLE_BYTES
    classify.SAMPLE_BYTES = 1_000_000
    try:
        few = classify.bounded_sample(large, "doc_id", "lang", 300).to_pylist()
    finally:
        classify.SAMPLE_BYTES = held
    assert 10 <= len(few) and sum(len(r["text"]) for r in few) <= 1_000_000
    learned = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 4 != 2)
    assert language_id.fit(many.withColumn("doc_id", F.lit(learned).cast("long")), 50).langs == ["a", "b"]


def test_language_prediction_equals_brute_force(monkeypatch):
    """Mean of the grams' rows of the table, softmax: gram by gram, for pieces of any size."""
    from blockrank.llm.text_kernel import LOWER

    rng = np.random.default_rng(3)
    model = language_id.LanguageModel(["a", "b", "c"], rng.normal(0, 1, (1 << language_id.BITS, 3)).astype(np.float32), rng.normal(0, 1, 3), 0.7, 0.4)
    texts = [(t or "").encode() for t in ODD]
    want = []
    for t in texts:
        low = LOWER[np.frombuffer(t, dtype=np.uint8)]
        rows = [model.table[language_id.gram_buckets(low[i : i + n], n, language_id.BITS)[0]] for n in language_id.GRAMS for i in range(len(low) - n + 1)]
        z = (np.sum(rows, axis=0, dtype=float) / len(rows) if rows else np.zeros(3)) + model.bias
        e = np.exp(z / model.temperature - max(z / model.temperature))
        want.append(e / e.sum())
    data, offs = np.frombuffer(b"".join(texts), dtype=np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    for values in (1 << 20, 3 * 4096):
        monkeypatch.setattr(language_id, "PIECE_VALUES", values)
        assert np.allclose(language_id.predict_chunk(model, data, offs), want, atol=1e-5)
    assert language_id.has_letter(data, offs).tolist() == [any(c.isalpha() for c in t or "") for t in ODD]


def test_memory_of_one_long_text_stays_small():
    import tracemalloc

    model = language_id.LanguageModel(["a", "b"], np.zeros((1 << language_id.BITS, 2), np.float32), np.zeros(2), 1.0, 0.0)
    data, offs = np.full(16 << 20, 97, dtype=np.uint8), np.array([0, 16 << 20])
    tracemalloc.start()
    language_id.predict_chunk(model, data, offs)
    language_id.has_letter(data, offs)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 6 * len(data)


def test_empty_tables_give_empty_results(spark):
    none = docs(spark, [])
    assert language_id.fit(none) is None and language_id.identify(none, None).count() == 0
    assert quality.judge(none, None).count() == 0
    assert near_dedup.near_classes(none).count() == 0 and near_dedup.near_stage(spark, none, "").columns == none.columns
    assert training_order.op9_training_order is not None and line_dedup.dedup_lines(none).count() == 0
    some = docs(spark, [None, "", "a"])
    assert language_id.identify(some, language_id.fit(some.filter("text is null"))).count() == 3


def test_token_counts_are_added_by_a_tree(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "FAN_IN", 2)
    rng = random.Random(15)
    texts = [prose(rng, rng.randint(0, 50)) for _ in range(40)]
    got = line_dedup.token_classes(docs(spark, texts).select("text").repartition(7))
    count = collections.Counter()
    column = pyarrow.array(texts)
    for words in near_dedup._sequences(column):
        count.update((words >> np.uint64(64 - line_dedup.COUNTER_BITS)).tolist())
    assert all(got[k] == min(255, int(math.log2(v + 1) * 8)) for k, v in count.items()) and (got > 0).sum() == len(count)


def test_release_leaves_nothing_but_what_is_kept(spark):
    from blockrank.llm import common

    common.release(spark)
    found = line_dedup.dedup_lines(docs(spark, ["a b c\na b c", "a b c", None])).select("doc_id", "n_removed").collect()
    assert sum(r.n_removed for r in found) == 2
    kept, mine = common.materialise(spark.range(3).toDF("id"), "kept"), common.written(spark)
    assert common.release(spark, keep=(kept,)) == len(mine) - 1 > 0 and kept.count() == 3
    there = lambda path: (p := spark._jvm.org.apache.hadoop.fs.Path(path)).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
    assert [p for p in mine if there(p)] == [kept._written_at] and common.release(spark) == 1 and not there(kept._written_at)


def test_first_weights_come_from_all_training_texts(spark):
    """A training text of more than 2 MB once fell out of the sample that the weights were fitted on; repeats counted once."""
    rng = random.Random(8)
    part = prose(rng, 3000) + " "
    held = F.lit(True).alias("learn")
    one, long = ([part, prose(rng, 50)], [part * 130, prose(rng, 50)])
    assert len(long[0]) > 2 << 20
    models = []
    for texts in ([], one, long, [*one, *one]):
        blocks = docs(spark, texts).select("doc_id", "text", held).mapInArrow(lm_score._blocks, lm_score._BLOCK)
        models.append(lm_score.train(blocks))
    none, single, large, twice = models
    assert np.allclose(none.weights, lm_score.FIRST_WEIGHT)
    assert all(np.abs(x.weights - lm_score.FIRST_WEIGHT).max() > 0.1 for x in (single, large, twice))
    # the histogram holds each decision of each training text once, repeats too
    blocks = docs(spark, [*one, *one]).select("doc_id", "text", held).mapInArrow(lm_score._blocks, lm_score._BLOCK)
    sc = spark.sparkContext
    classes = np.full(2 * sum(1 << b for b in twice.bits), lm_score.NONE, np.uint8)
    seen = lm_score._training(blocks).mapInArrow(lm_score._histogram(sc.broadcast((twice.trees, classes)), twice.bits), "key int, n long").groupBy().sum("n").first()[0]
    spelled, trees, _, _, decisions = lm_brute([*one, *one], [True] * 4)
    assert seen == sum(1 for s in spelled for _ in decisions(s))


def test_a_pair_leaves_the_least_of_its_common_buckets_only():
    """Texts 1 and 2 share the buckets -3, 4 and 9, texts 1 and 3 only 9, and 2 and 3 only 9 with another order of rows."""
    bands = {1: [9, -3, 4], 2: [4, 9, -3], 3: [9, 5]}
    empty = bytes(near_dedup.MAP_BITS // 8)

    def leave(band, ids):
        table = pa.table({"id": ids, "tile": [0] * len(ids), "own": [7] * len(ids), "class": ids, "n": [10] * len(ids), "map": [empty] * len(ids), "bands": pa.array([bands[i] for i in ids], pa.list_(pa.int64()))})
        found = near_dedup._possible_pairs([pa.scalar(x) for x in (band, 7, 0, 0)], pa.concat_tables([table.slice(0, 1), table.slice(1)]))
        return sorted(zip(found["a"].to_pylist(), found["b"].to_pylist(), strict=True))

    assert leave(-3, [2, 1]) == [(1, 2)]
    assert leave(4, [1, 2]) == []
    assert leave(9, [3, 1, 2]) == [(1, 3), (2, 3)]


def test_known_words_are_told_apart_by_their_bytes():
    words = [b" a", b"tako", b"", b"x" * 500, "é".encode()]
    known = bpe.KnownWords(words, np.arange(9, dtype=np.int32), np.array([0, 1, 3, 3, 5, 9]))
    asked = [b"tako", b"tak", b" a", "é".encode(), b"b", b"x" * 500, b"", b"takoa"]
    place = known.places(*bpe._laid_out(asked))
    assert [p >= 0 for p in place] == [True, False, True, True, False, True, True, False]
    offs, ids = known.ids_of(place[place >= 0])
    assert [ids[s:e].tolist() for s, e in zip(offs[:-1], offs[1:], strict=True)] == [[1, 2], [0], [5, 6, 7, 8], [3, 4], []]
    # a word of an equal hash and other bytes is not known
    known.data = known.data.copy()
    known.data[:] ^= 1
    assert (known.places(*bpe._laid_out([b"tako", b" a"])) < 0).all()
    assert (bpe.KnownWords([], np.zeros(0, np.int32), np.zeros(1, np.int64)).places(*bpe._laid_out([b"a"])) < 0).all()


def test_the_driver_never_holds_the_counters_of_all_slices(spark):
    texts = docs(spark, [prose(random.Random(3), 2000), "a b a"]).select("text")
    tracemalloc.start()
    found = line_dedup.token_classes(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found.dtype == np.uint8 and len(found) == 1 << line_dedup.COUNTER_BITS and found.any()
    assert peak < 24 << 20  # eight bytes for each counter alone are 32 MB


def test_pairs_are_found_by_one_look(tok):
    table = bpe.pair_table(tok.ranks)
    n, rnd = max(tok.ranks.values()) + 1, random.Random(4)
    words = {r: t for t, r in tok.ranks.items()}
    known = [(t[:c], t[c:]) for t in rnd.sample(sorted(tok.ranks), 2000) for c in range(1, len(t))]
    asked = [(tok.ranks[a], tok.ranks[b]) for a, b in known if a in tok.ranks and b in tok.ranks] + [(rnd.choice([*words]), rnd.choice([*words])) for _ in range(5000)]
    for a, b in asked:
        found = int(table[table[a] + b]) ^ (a << 20)
        assert (found if found < bpe.NO_MERGE else None) == tok.ranks.get(words[a] + words[b])
    assert len(table) < 16 * n


def test_the_cache_of_words_reaches_the_driver_as_arrays(spark, tok):
    # 50,000 words that are no tokens, each twice: as objects of Python their list alone takes over 5 MB more
    words = ["".join(random.Random(i).choices("bcdfghjklmnpqrstvwxz", k=9)) for i in range(50_000)]
    texts = docs(spark, [" ".join(words[i::50]) for i in range(50)] * 2)
    tracemalloc.start()
    known = bpe.known_words(texts, tok, "text")
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(known.hashes) > len(tok.ranks) + 45_000 and peak < 48 << 20
    data, offs = bpe._laid_out([(" " + w).encode() for w in words[:500]])
    place = known.places(data, offs)
    heads, ids = known.ids_of(place[place >= 0])
    want = [bpe.heap_merges((" " + w).encode(), tok.ranks) for w, p in zip(words[:500], place, strict=True) if p >= 0]
    assert len(want) > 400 and [ids[s:e].tolist() for s, e in zip(heads[:-1], heads[1:], strict=True)] == want


def test_only_tokens_that_may_fill_a_list_are_counted_again():
    lines = ["common"] * 5000 + ["rare", "now and then"] * 50 + [f"w{i}" for i in range(50)]
    batch = pa.RecordBatch.from_arrays([pa.array([0]), pa.array([0]), pa.array(["\n".join(lines)])], names=["doc", "hash", "text"])
    data, offs = bpe._laid_out([x.encode() for x in lines])
    tokens = line_dedup.line_tokens(data, offs)[2]
    count = np.bincount((tokens >> np.uint64(64 - line_dedup.COUNTER_BITS)).astype(np.int64), minlength=1 << line_dedup.COUNTER_BITS)
    held = types.SimpleNamespace(value=np.minimum(255, np.log2(count + 1.0) * 8).astype(np.uint8))
    entries = np.concatenate([r.as_py() for b in line_dedup._lines(held)([batch]) for r in b.column("prefix") if len(r)])
    of = (entries.view(np.uint64) >> np.uint64(15)) & np.uint64((1 << 48) - 1)
    by = {int(t >> np.uint64(16)): int(count[t >> np.uint64(64 - line_dedup.COUNTER_BITS)]) for t in tokens}
    assert sorted((by[t], bool(e < 0)) for e, t in zip(entries, of.tolist(), strict=True)) == [(50, False), (50, False), (5000, True)]


def test_matches_in_lists_equal_all_pairs():
    rnd = random.Random(8)
    rows = []
    for g in range(300):
        base = [rnd.getrandbits(64) for _ in range(rnd.randint(1, 30))]
        for _ in range(rnd.choice([1, 2, 2, 5, 40])):
            rows.append((g, len(rows), frozenset(rnd.sample(base, max(1, len(base) - rnd.randint(0, 4))))))
    table = pa.table({"group": [r[0] for r in rows], "key": [r[1] for r in rows], "tokens": pa.array([np.array(sorted(r[2]), dtype=np.uint64).tobytes() for r in rows], pa.binary())})
    for size in (7, 1000, 10_000):
        found = sorted(k for b in line_dedup._matched(iter(table.to_batches(max_chunksize=size))) for k in b.column("key").to_pylist())
        assert found == [k for g, k, s in rows if any(h == g and i < k and len(s & t) >= 0.8 * len(s | t) - 1e-9 for h, i, t in rows[max(0, k - 40) : k])]


def test_keys_that_differ_in_their_last_bits_are_in_order():
    keys = np.array([5, 4, 5, 4, 1 << 63, 7, 6, 6], dtype=np.uint64)
    groups = np.array([0, 0, 0, 0, 1, 99_999, 99_999, 99_999])
    order = line_dedup.order_within(keys, groups)
    assert [(int(g), int(k)) for g, k in zip(groups[order], keys[order], strict=True)] == sorted(zip(groups.tolist(), keys.tolist(), strict=True))
    assert line_dedup.order_within(keys[:0], groups[:0]).tolist() == []


def test_freed_memory_is_given_back():
    held = lambda: int(open("/proc/self/statm").read().split()[1]) >> 8  # noqa: E731  MB
    blocks = [bytes(4000) for _ in range(40_000)]
    last, before = blocks[-1], held()
    del blocks  # the last block keeps the heap from shrinking by itself
    give_back()
    assert before - held() > 80 and len(last) == 4000
