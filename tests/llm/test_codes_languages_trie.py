"""Vector codes, language mixtures and conversation tries: brute force, held-out rows and the defined edge cases."""

import hashlib
import math
import os
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallywright.llm import conversation_trie as trie
from tallywright.llm import languages, vector_codes

VECTORS = "vec_id long, embedding array<float>, label int, code string"


def codes_by_hand(rows, rounds=2):
    """Ids, codes, errors and codebooks of (id, vector), every part against every entry."""
    kept = [(i, v) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = -(-max(len(v) for _, v in kept) // 16) * 16
    whole = [(i, [math.floor(256 * x) for x in v] + [0] * (width - len(v))) for i, v in kept]
    whole.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    cut = lambda v: [v[p * width // 16 : (p + 1) * width // 16] for p in range(16)]
    parts = [cut(v) for _, v in whole]
    books = [[row[p] for row in parts[:64]] for p in range(16)]
    for r in range(rounds + 1):
        found = [[min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(books[p])) for p, x in enumerate(row)] for row in parts]
        if r < rounds:
            for p in range(16):
                mine = defaultdict(list)
                for row, got in zip(parts, found):
                    mine[got[p][1]].append(row[p])
                for e, xs in mine.items():
                    books[p][e] = [sum(c) // len(xs) for c in zip(*xs)]
    told = sorted((i, "".join(f"{k:02x}" for _, k in got), sum(d for d, _ in got)) for (i, _), got in zip(whole, found))
    return told, hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


def vectors(n, seed=3, width=32):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(np.float32(x)) for x in rng.standard_normal(width) * 0.2]) for i in range(n)]
    # Hot copies, ties (components of 1/256 steps), and what is left out.
    rows += [(n + i, rows[5][1]) for i in range(n // 3)]
    rows += [(2 * n + i, [float(x) / 256 for x in rng.integers(-2, 3, width)]) for i in range(n // 3)]
    return rows


def test_codes_against_brute_force(spark, tmp_path):
    rows = vectors(120) + [(900, None), (901, [None] * 32), (902, [float("nan")] * 32), (903, [float("inf")] * 32), (904, [0.5] * 20), (905, []), (3, [0.25] * 32)]
    spark.createDataFrame([(i, v, (i % 3) or None, "x") for i, v in rows], VECTORS).repartition(5).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = vector_codes.op11_vector_codes(spark, str(tmp_path)).collect()
    want, digest = codes_by_hand(rows)
    assert sorted((r.vec_id, r.code, r.error) for r in got) == want
    assert {r.codebooks_sha256 for r in got} == {digest}
    by_label = Counter()
    for i, _, e in want:
        by_label[i % 3] += e
    assert all(r.label_error == by_label[r.vec_id % 3] for r in got)


def test_codes_of_few_vectors_and_of_extremes(spark):
    rows = [(1, [1e30] * 4), (2, [-1e30] * 4), (2, [-1e30] * 4), (3, [0.0] * 4), (None, [0.1] * 4)]
    got, books = vector_codes.compressed(spark.createDataFrame([(i, v, None, "x") for i, v in rows], VECTORS))
    assert books.shape == (16, 5, 1) and abs(books).max() <= vector_codes.LARGEST
    got = got.collect()
    assert len(got) == 5 and {r.error for r in got} == {0} and len({r.code for r in got if r.vec_id == 2}) == 1


def test_cells_change_no_result():
    rng = np.random.default_rng(1)
    for spread in (1, 30, 5000):
        book = rng.integers(-spread, spread + 1, (64, 4))
        book[10] = book[3]  # a tie everywhere
        parts = rng.integers(-3 * spread, 3 * spread + 1, (3000, 4))
        d = ((parts[:, None] - book[None]) ** 2).sum(axis=2)
        grid = vector_codes.Grid(book)
        for room in (10**9, 0):
            code, error = grid.nearest(parts, room)
            assert (code == d.argmin(axis=1)).all() and (error == d.min(axis=1)).all()
        for bits in (0, 3, 8):
            grid = vector_codes.Grid(book)
            grid.bits = bits
            assert (grid.nearest(parts, 10**9)[0] == d.argmin(axis=1)).all()


def test_cells_save_work():
    rng = np.random.default_rng(2)
    grid = vector_codes.Grid(np.floor(rng.standard_normal((64, 4)) * 32).astype(np.int64))
    grid.nearest(np.floor(rng.standard_normal((20_000, 4)) * 32).astype(np.int64), 10**9)
    assert grid.evaluated < 0.25 * 64 * 20_000


# Languages

#: Two made-up vocabularies that share letters, and a third one of other letters.
VOCABULARY = {
    "aa": "the tion and shing other erth stand whent ouring thend".split(),
    "bb": "ich sche keiten verung zuein geber lichen pfund achung unden".split(),
    "cc": "что она были которые после время людей только".split(),
}


def sentence(rng, lang, n):
    return " ".join(rng.choice(VOCABULARY[lang]) + rng.choice(["", "", ",", "."]) for _ in range(n))


@pytest.fixture(scope="module")
def guesses(spark, tmp_path_factory):
    rng, root = random.Random(5), tmp_path_factory.mktemp("languages")
    rows = []
    for i in range(600):
        lang = rng.choice("aa aa aa bb cc".split())
        rows.append((i, sentence(rng, lang, rng.randint(5, 60)), lang if i % 7 else None, 0.5))
    rows += [(1000, None, "aa", 0.5), (1001, "", "bb", 0.5), (1002, "12 345 !!! ½", "bb", 0.5), (1003, None, None, 0.5)]
    rows += [(1004, sentence(rng, "aa", 60) + " " + sentence(rng, "bb", 40), None, 0.5), (1005, "Я" * 200_000, None, 0.5)]
    rows += [(1006, " ".join(f"the{i}tion" for i in range(150_000)), None, 0.5), (None, rows[1][1], None, 0.5), (1, rows[1][1], rows[1][2], 0.5)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, score double").write.parquet(f"{root}/documents.parquet")
    return rows, languages.op12_languages(spark, str(root)).collect()


def test_languages_held_out(guesses):
    rows, got = guesses
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    lang = {i: l for i, _, l, _ in rows if l and i is not None and i < 1000}
    held = [r for r in got if r.held_out and r.doc_id in lang]
    assert len(held) > 80 and sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.98 * len(held)


def test_languages_edges(guesses):
    by = {r.doc_id: r for r in guesses[1]}
    assert [(by[i].lang_pred, by[i].score) for i in (1000, 1001, 1002, 1003)] == [("und", 0.0)] * 4
    assert by[1004].languages == ["aa", "bb"] and 0.5 < by[1004].score < 0.7
    assert by[1005].lang_pred == "cc" and by[1006].lang_pred == "aa"
    assert by[None].lang_pred == by[1].lang_pred and by[None].score == by[1].score


def test_languages_nothing_learned_and_clashing_names(spark):
    docs = spark.createDataFrame([(1, "some words", "kept", 3.0)], "doc_id long, text string, lang string, `lang_pred` double")
    got = languages.predicted(docs, languages.train(docs.where("false"))).collect()
    assert [(r.doc_id, r.lang, r.lang_pred, r.score) for r in got] == [(1, "kept", "und", 0.0)]
    one = languages.predicted(docs.withColumn("a.b", F.lit(1)), languages.train(docs)).first()
    assert (one.lang_pred, one.score, one["a.b"]) == ("kept", 1.0, 1)


def test_words_learned_together_are_as_one_by_one():
    """The likelihood of every word is the product over its n-grams, however words are cut, mixed or repeated."""
    rng = random.Random(3)
    counts: dict = {}
    for k, lang in enumerate(VOCABULARY):
        for w in VOCABULARY[lang]:
            for g in languages.grams(w):
                for i in range(len(g)):
                    counts.setdefault(g[i:], np.zeros(3))[k] += 1
    guesser = languages.Guesser(languages.Model(list(VOCABULARY), counts))
    guesser.step = 7
    words = ["the", "t", "l'été", "12", "...", "a1b2c", "--x--", "\U0001d4d0b", "что-то", "e\u0301a", "x" * 40, "%%%$", "ab.cd..ef"]
    words += ["".join(rng.choice("abeiч1-é") for _ in range(rng.randint(1, 12))) for _ in range(200)]
    words = list(dict.fromkeys(words))
    guesser.learn(words)
    for w in words:
        found = languages.grams(w)
        at = guesser.known[w]
        assert guesser.lettered[at] == bool(found)
        assert np.allclose(guesser.logs[at], sum((np.log(guesser.chance(g)) for g in found), np.zeros(3)))


def test_mixtures_against_exhaustive_search():
    """Whatever is skipped by the slope's bound, or dropped, no single language and no pair is much better."""
    rng = np.random.default_rng(4)
    for _ in range(30):
        n = int(rng.integers(3, 80))
        logs, counts = -rng.exponential(4, (n, 3)), rng.integers(1, 4, n).astype(float)
        share = languages.selected(np.zeros(n, dtype=int), logs, counts)[0]
        fit = lambda s: float((np.log((np.exp(logs) * s).sum(axis=1)) * counts).sum())
        price = float(languages.penalty(counts.sum()))
        worth = lambda s: fit(s) - price * (s > 0).sum()
        steps = [np.array([a, b, 100 - a - b]) / 100 for a in range(0, 101, 5) for b in range(0, 101 - a, 5)]
        assert abs(share.sum() - 1) < 1e-9
        # One language at a time is taken out, so only supersets and one smaller set are weighed for certain.
        best_here = max(worth(s) for s in steps if ((s > 0) == (share > 0)).all())
        assert worth(share) > best_here - 0.05
        single = max(range(3), key=lambda k: fit(np.eye(3)[k]))
        slope = max((np.exp(np.minimum(logs[:, k] - logs[:, single], 500)) * counts).sum() - counts.sum() for k in range(3))
        if slope <= price:
            assert share.max() == 1.0 and share.argmax() == single


# Tries


def trie_by_hand(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
            convs[c].append((turn is not None, turn or 0, digest, role, text))
    turns = {c: [(r, t) for *_, r, t in sorted(x)] for c, x in convs.items()}
    built = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = turns.get(c - c % 5, [])[:h] + own[h:]
    nodes = defaultdict(list)
    for c, x in built.items():
        for d in range(len(x) + 1):
            nodes[tuple(x[:d])].append(c)
    children = Counter(k[:-1] for k in nodes if k)
    leaves, saved = Counter(), Counter()
    for k, members in nodes.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += children[k] == 0
            saved[k[:d]] += (len(members) - 1) * len(k[-1][1].encode()) if k else 0
    return sorted(
        (
            min(m), len(k), min(nodes[k[:-1]]) if k else None, len(m), children[k], leaves[k], saved[k],
            hashlib.sha256(",".join(str(c) for c in sorted(m) if len(built[c]) == len(k)).encode()).hexdigest(),
        )
        for k, m in nodes.items()
    )


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SAID = "conv_id long, turn long, role string, text string, depth string, s1 string"


def said(seed, convs=150):
    rng, rows = random.Random(seed), []
    for c in rng.sample(range(1000), convs):
        for t in range(rng.randint(1, 12)):
            rows.append((c, t, rng.choice(["user", "assistant", None]), rng.choice(["a", "b", "é", "", None])))
    # A hot conversation, a copy of it, copies of a short one, ties and null turns.
    for c in (2000, 2005):
        rows += [(c, t, "user", f"turn {t % 3}") for t in range(300)]
    rows += [(c, t, "user", "same") for c in range(3000, 3100) for t in range(10)]
    rows += [(77, None, "user", "first"), (77, 1, "user", "tie"), (77, 1, "user", "tie"), (77, 1, "user", "other"), (None, 1, "user", "lost")]
    return rows


def whole_trie(spark, rows, **how):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SAID).repartition(6)
    paths = trie.paths_of(trie.rebuilt(trie.turns_of(df)))
    return sorted(tuple(r) for r in trie.trie(paths, **how).select(COLUMNS).collect())


@pytest.mark.parametrize(("shard", "queue", "block"), [(50_000, 100_000, 1024), (40, 2, 7)])
def test_trie_against_brute_force(spark, monkeypatch, shard, queue, block):
    """With small shards and queues there is a trunk, many shards, and queues that spill."""
    rows = said(shard)
    monkeypatch.setattr(trie, "BLOCK", block)
    monkeypatch.setattr(trie, "TRUNK", 1000 if shard == 40 else 1)
    assert whole_trie(spark, rows, shard=shard, queue=queue) == trie_by_hand(rows)


def test_trie_edges(spark):
    assert whole_trie(spark, []) == []
    assert whole_trie(spark, [(None, 1, "user", "x")]) == []
    one = [(4, 1, None, None)]
    assert whole_trie(spark, one) == trie_by_hand(one)
    long = [(10, t, "user", "x" * 300_000) for t in range(4)] + [(11, t, "user", "x" * 300_000) for t in range(12)]
    assert whole_trie(spark, long) == trie_by_hand(long)


def test_queue_spills_and_keeps_order():
    rng, queue = random.Random(1), trie.SpillingQueue(10)
    sent = [((rng.randint(0, 40), 0), (i,)) for i in range(2000)]
    for k, v in sent:
        queue.push(k, v)
    assert len(queue.heap) <= 10 and len(queue.files) > 100
    for key in range(41):
        assert sorted(queue.pop((key, 0))) == sorted(v for k, v in sent if k == (key, 0))
    assert not queue and all(f.closed for f in queue.files)


def test_long_lists_of_ids(spark, monkeypatch):
    monkeypatch.setattr(trie, "IDS", 7)
    ids = list(range(-5, 996))
    ends = spark.createDataFrame([(1, 2, 3, i) for i in ids] + [(1, 2, 4, 9)], "depth long, s1 long, s2 long, conv_id long").repartition(5)
    got = {r.s2: r.ends_sha256 for r in trie.digests(ends).collect()}
    assert got == {3: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), 4: hashlib.sha256(b"9").hexdigest()}
