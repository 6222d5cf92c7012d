"""The ten operators on small tables: brute force, exact round trips and the defined edge cases."""

import hashlib
import os
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallywright.llm import fingerprints, jaccard, license_rules, licenses, mixing, neighbours, packing, privacy, toxicity, urls, warc, workers
from tallywright.llm.components import components
from tallywright.llm.queries import QUERIES

LONG = " ".join(f"word{i % 700}" for i in range(20_000))
TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog near the river bank today"),
    (2, None),
    (3, ""),
    (4, " \n\t "),
    (5, "The quick brown fox jumps over the lazy dog near the river bank today"),
    (5, "The quick brown fox jumps over the lazy dog near the river bank today"),
    (6, LONG),
    (7, "mail a.b@mail.example.com and +1 (555) 555-0100 or 10.0.0.256 10.0.0.1 card 4111 1111 1111 1111"),
    (8, "Released under the GNU General Public License, version 3. MIT License"),
    (9, "one"),
    (10, "ünï 你好 🎉 emoji"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, component_id long, pos long, piece int, host string, labels string"


@pytest.fixture(scope="module")
def edge(spark, tmp_path_factory):
    """A folder of edge-case tables with extra, clashing columns."""
    root = tmp_path_factory.mktemp("edge")
    rows = [(i, t, None, f"s{i % 3}" if i % 4 else None, len(t or ""), 0.5, 9, 9, 9, "h", "l") for i, t in TEXTS]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(1, 0, 0), (7, 1, 1), (8, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    pages = [
        (1, "http://a.Example.com/en/71?x#y", "x" * 2000),
        (2, None, "x" * 2000),
        (3, "no scheme", None),
        (4, "http://org/es/", ""),
        (5, "x://com", "é\r\n\r\nWARC/1.1\r\n" * 100),
        (5, "x://com", "é\r\n\r\nWARC/1.1\r\n" * 100),
        (6, "http://b.example.net/de/8\n#", "x" * 2000),
    ]
    spark.createDataFrame([(*p, "b") for p in pages], "page_id long, url string, html string, best string").write.parquet(f"{root}/pages.parquet")
    rng = np.random.default_rng(1)
    vectors = [(i, [float(x) for x in rng.standard_normal(4)], 0) for i in range(200)]
    vectors += [(200 + i, [1.0, 2.0, 0.0, -1.0], 0) for i in range(70)]
    vectors += [(300, None, 0), (320, [0.0] * 4, 0), (340, [1.0, None, 0.0, 0.0], 0), (360, [float("nan"), 1.0, 1.0, 1.0], 0), (380, [1.0], 0)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{root}/embeddings.parquet")
    said = [(7, None, "user", "a", 1), (7, 1, None, "b", 2), (7, 2, "user", None, 3), (5, 1, "user", "x", 4), (None, 1, "user", "lost", 5)]
    spark.createDataFrame(said, "conv_id long, turn long, role string, text string, depth int").write.parquet(f"{root}/conversations.parquet")
    return str(root)


@pytest.fixture(scope="module")
def empty(spark, edge, tmp_path_factory):
    root = tmp_path_factory.mktemp("empty")
    for name in ("documents", "labels", "pages", "embeddings", "conversations"):
        spark.read.parquet(f"{edge}/{name}.parquet").limit(0).write.parquet(f"{root}/{name}.parquet")
    return str(root)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, empty, name):
    assert QUERIES[name](spark, empty).count() == 0


def test_toxicity_edges(spark, edge):
    rows = QUERIES["op1_toxicity"](spark, edge).collect()
    assert len(rows) == len(TEXTS) and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == int(r.score >= 0.3) for r in rows)
    assert len({r.score for r in rows if r.doc_id in (2, 3, 4)}) == 1


def test_toxicity_held_out(spark):
    """Rows whose labels training never saw: nearly all toxic ones are found, nearly no clean one is."""
    folder = "/root/testdata/sf0.1"
    if not os.path.isdir(folder):
        pytest.skip("the driver's tables are not here")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect() if r.toxic is not None}
    rows = [(labels[r.doc_id], r.predicted) for r in QUERIES["op1_toxicity"](spark, folder).collect() if r.held_out and r.doc_id in labels]
    found, wrong = [p for y, p in rows if y], [p for y, p in rows if not y]
    assert len(found) >= 100 and sum(found) >= 0.9 * len(found) and sum(wrong) <= 0.01 * len(wrong)


def test_workers_hold_one_store(spark):
    """A store is dropped when another owner begins, and emptied beyond its bytes."""
    workers._HELD.clear()
    jaccard.shingle_set("some words here", 2)
    assert [k[0] for k in workers._HELD] == ["shingles"]
    packing.word_ids(packing.tokenizer_path()).ids(["some words here"])
    assert [k[0] for k in workers._HELD] == ["ids"]
    fingerprints.sampler()
    assert [k[0] for k in workers._HELD] == ["samples"]
    workers.release()
    assert not workers._HELD
    store = workers.WordStore(limit=1000)
    store.learn({f"w{i}": b"12345" for i in range(10)})
    assert store.room() and not store.words and not store.room()
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * 10, None, "b" * 50, "c", "d"])], names=["t"])
    assert [b.num_rows for b in workers.slices(batch, "t", 20, 2)] == [2, 1, 2]


def test_toxicity_counterfactual(spark):
    """A term that goes along with toxic labels does not condemn a neutral mention."""
    rng = np.random.default_rng(3)
    filler = [f"plain{i}" for i in range(40)]
    docs, labels = [], []
    for i in range(240):
        bad = i % 3 == 0
        group = "muslims" if bad or i % 12 == 1 else "people"
        words = [*rng.choice(filler, 6), group, *(["moronish"] if bad and i % 2 else ["vilely"] if bad else [])]
        docs.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    y = spark.createDataFrame(labels, "doc_id long, label int")
    neutral = spark.createDataFrame([(0, "muslims live here"), (1, "christians live here"), (2, "moronish muslims")], "doc_id long, text string")
    plain, fair = (
        {r.doc_id: r.score for r in toxicity.score(neutral, toxicity.train(d, y, lam=lam)).collect()} for lam in (0.0, 4.0)
    )
    assert abs(fair[0] - fair[1]) < abs(plain[0] - plain[1])
    assert fair[0] < 0.3 < fair[2]
    assert toxicity.counterfactuals("Women, rest.")[0] == "men, rest."
    assert toxicity.counterfactuals("nothing here") == []


def test_neighbours_against_brute_force(spark, edge):
    rows = QUERIES["op2_neighbours"](spark, edge).collect()
    table = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{edge}/embeddings.parquet").collect() if r.vec_id < 300]
    ids, x = np.array([i for i, _ in table]), np.array([v for _, v in table], dtype=float)
    got = defaultdict(list)
    for r in rows:
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    assert set(got) == {i for i in ids.tolist() if i % 20 == 0}
    hit = 0
    for q, found in got.items():
        found.sort()
        scores = x @ x[ids.tolist().index(q)]
        want = [i for i in ids[np.lexsort((ids, -scores.round(12)))].tolist() if i != q][:20]
        assert [f[0] for f in found] == list(range(1, 21))
        hit += len({f[1] for f in found} & set(want))
        if q >= 200:  # copies of one vector: ties go to the smaller ids
            assert [f[1] for f in found if abs(f[2] - 6.0) < 1e-9] == [f[1] for f in found if abs(f[2] - 6.0) < 1e-9 and f[1] != q]
    assert hit >= 0.95 * 20 * len(got)


def vectors_of(spark, x):
    return spark.createDataFrame(pa.table({"vec_id": pa.array(range(len(x))), "embedding": pa.array(x.tolist(), pa.list_(pa.float32()))}))


def recall_of(rows, x, step):
    got = defaultdict(set)
    for r in rows:
        got[r.query_id].add(r.vec_id)
    scores = x.astype(np.float64)[::step] @ x.astype(np.float64).T
    scores[np.arange(len(scores)), np.arange(0, len(x), step)] = -np.inf
    want = np.argsort(-scores, axis=1)[:, :20]
    assert set(got) == set(range(0, len(x), step)) and all(len(v) == 20 for v in got.values())
    return sum(len(got[i * step] & set(w.tolist())) for i, w in enumerate(want)) / want.size


def plan_of(spark, x):
    """The plan of vectors that all differ, and how often their index holds a query and a pair of a query and a row."""
    classes = spark.createDataFrame(
        pa.table({"cid": pa.array(range(len(x))), "vec": pa.array(x.tolist(), pa.list_(pa.float32())), "asks": pa.array([i % 20 == 0 for i in range(len(x))])})
    )
    projections, shifts = neighbours._directions(x.shape[1])
    mean, spread, top, n, asks = neighbours._moments(classes, projections)
    curves, plan = neighbours.fit(classes, neighbours.Curves(projections, shifts, mean, spread, top), 20, n, asks, 4 * x.shape[1])
    slots = {(r.slot, r.asks): r["count"] for r in neighbours.index(classes, curves, plan, "float").groupBy("slot", "asks").count().collect()}
    looks = sum(c for (_, asked), c in slots.items() if asked)
    pairs = sum(c * slots.get((slot, False), 0) for (slot, asked), c in slots.items() if asked)
    return plan, looks / asks, pairs / (asks * n)


def test_neighbours_isotropic_work(spark):
    """Where no ordering helps, no pair is compared twice, and a query goes to as many blocks in a larger table."""
    x = np.random.default_rng(4).standard_normal((80_000, 64)).astype(np.float32)
    for rows in (40_000, 80_000):
        plan, looks, pairs = plan_of(spark, x[:rows])
        assert plan.curves == 1 and looks <= 24 and pairs <= 1.001


def test_neighbours_of_clusters(spark, monkeypatch):
    """Clustered vectors are compared with few others on several curves, and nearly all neighbours are found."""
    monkeypatch.setattr(neighbours, "ROW_COST", 0)
    rng = np.random.default_rng(6)
    x = rng.standard_normal((1000, 16))[rng.integers(0, 1000, 30_000)] + 0.05 * rng.standard_normal((30_000, 16))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    plan, _, pairs = plan_of(spark, x)
    assert plan.curves > 1 and pairs < 0.5
    assert recall_of(neighbours.nearest(vectors_of(spark, x), 20, F.col("vec_id") % 20 == 0).collect(), x, 20) >= 0.97


def test_neighbours_recall(spark):
    """Blocks of isotropic vectors, none of which sees all rows."""
    x = np.random.default_rng(8).standard_normal((12_000, 64)).astype(np.float32)
    assert recall_of(neighbours.nearest(vectors_of(spark, x), 20, F.col("vec_id") % 100 == 0).collect(), x, 100) >= 0.98


def test_neighbours_without_queries(spark, edge):
    vectors = spark.read.parquet(f"{edge}/embeddings.parquet")
    assert neighbours.nearest(vectors, 20, F.col("vec_id") == -1).count() == 0


@pytest.mark.parametrize("kind", ["plain", "close", "long", "double"])
def test_neighbours_of_a_block(kind):
    """Single precision leaves no row out, with rows closer than its rounding, one row longer than all and huge numbers."""
    rng = np.random.default_rng(9)
    x = rng.standard_normal((9_000, 24)).astype(np.float32)
    if kind == "close":
        x = (x[:1] + 1e-6 * x).astype(np.float32)
    elif kind == "long":
        x[17] *= np.float32(1e12)
    elif kind == "double":
        x = x.astype(np.float64) * 1e60
    ids, q = rng.permutation(len(x)), x[:700].astype(np.float64)
    found = neighbours.Block(ids, x).nearest(np.arange(len(q)), q, 21)
    query, back, other = (np.concatenate(c) for c in zip(*found, strict=True))
    for i in range(0, len(q), 35):
        scores = neighbours.exact_scores(q[i], x.astype(np.float64))
        best = np.lexsort((ids, -scores))[:21]
        assert other[query == i].tolist() == ids[best].tolist() and (-back[query == i] == scores[best]).all()


def test_hilbert_is_a_curve():
    """Neighbours along the curve are neighbouring cells, and no two cells share a key."""
    cells = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), axis=-1).reshape(-1, 3)
    keys = neighbours.hilbert_keys(cells, 3)
    assert sorted(keys.tolist()) == list(range(512))
    along = cells[np.argsort(keys)]
    assert (np.abs(np.diff(along, axis=0)).sum(axis=1) == 1).all()


def test_url_edges(spark, edge):
    rows = {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in QUERIES["op3_urls"](spark, edge).collect()}
    assert rows == {
        (1, "a.example.com", "/en/71", "example.com/en/7", "allow"),
        (2, "", "", None, "allow"),
        (3, "", "", None, "allow"),
        (4, "org", "/es/", "org/es/", "block"),
        (5, "com", "", None, "allow"),
        (6, "b.example.net", "/de/8\n", "example.net/de/8", "block"),
    }
    pages = spark.read.parquet(f"{edge}/pages.parquet")
    out = urls.filter_urls(pages, urls.rules_table(spark, urls.RULES).limit(0))
    assert out.count() == 7 and {"best", "html"} <= set(out.columns)
    assert urls.filter_urls(pages, urls.rules_table(spark, urls.RULES)).count() == 7


def test_url_rules_are_the_contracts(spark, tmp_path):
    """Every rule gives its own verdict, net/de/ allow with example.net/de/8 blocked inside it."""
    contract = "block com/en/, allow example.com/en/7, allow net/de/, block example.net/de/8, block org/es/"
    told = [(*r.split(" "),) for r in contract.split(", ")]
    spark.createDataFrame([(i, f"http://{rule}") for i, (_, rule) in enumerate(told)], "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: (r.verdict, r.rule) for r in QUERIES["op3_urls"](spark, str(tmp_path)).collect()}
    assert got == dict(enumerate(told))


BASE = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def luhn(digits):
    return sum(int(c) if k % 2 == 0 else int(c) * 2 - 9 * (c > "4") for k, c in enumerate(reversed(digits))) % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in BASE:
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            fits = {
                "email": lambda: True,
                "ip": lambda m=m: all(int(x) <= 255 for x in m[0].split(".")),
                "card": lambda d=d: 13 <= len(d) <= 19 and luhn(d),
                "phone": lambda d=d: 9 <= len(d) <= 15,
            }[kind]()
            out += [f"{kind}:{m.start()}:{m.end()}"] * fits
    return out


def test_privacy_base_spans(spark, tmp_path):
    texts = [t for _, t in TEXTS] + [
        "a@b.c_d@e.f", "x@@y.z a@b.c.d. aa@-.-", "1.2.3.4.5.6.7.8.9 300.1.1.1 001.02.3.0000", "+1((((((2", "🎉a@b.co🎉 x",
        "9" * 5000, "a" * 30_000, "a@" + "b." * 20_000 + "c", "1 " * 20_000, "%%a@b..c", "+1 555 +44 20 7946 0958--",
    ]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = QUERIES["op4_privacy"](spark, str(tmp_path)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = base_spans(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), texts[r.doc_id][:60]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(w.startswith(k) for w in want) for k, _ in BASE]
        assert r.spans.split(",")[: len(want)] == want or not want


def test_privacy_disclosing_terms(spark):
    """A word that stands beside one address in different sentences, and nowhere else, gives it away."""
    docs = [(i, f"filler{i} some ordinary sentence about weather number{i}") for i in range(60)]
    docs += [(100, "colonel mustard writes from x.y@mail.example.com today"), (101, "reach colonel Mustard, x.y@mail.example.com soon")]
    docs += [(102, "ordinary sentence with z@mail.example.com in it"), (103, "ordinary sentence with z@mail.example.com in it")]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n_chars", F.length("text").cast("long"))
    rows = {r.doc_id: [d2 for d2 in (r.terms or [])] for r in privacy.marked(d).collect()}
    text = dict(docs)
    assert [text[100][t.start : t.end] for t in rows[100]] == ["colonel", "mustard"]
    assert [text[101][t.start : t.end] for t in rows[101]] == ["colonel", "Mustard"]
    assert not rows[102] and not rows[0]  # copies of one context are no evidence
    clean = {r.doc_id: r for r in privacy.sanitised(d).collect()}
    assert clean[100].text == "  writes from [EMAIL] today" and clean[100].n_chars == len(clean[100].text)
    assert clean[0].text == text[0] and len(clean) == len(docs)


def test_privacy_terms_far_from_the_mention(spark):
    """What gives an address away goes from the whole text, wherever it stands."""
    docs = [(i, f"filler{i} some ordinary sentence about weather number{i}") for i in range(60)]
    far = " some ordinary sentence about weather" * 5
    docs += [(100, f"colonel mustard writes from x.y@mail.example.com today{far} Mustard, mustards"), (101, f"reach colonel Mustard, x.y@mail.example.com soon{far}")]
    docs += [(110, f"Owner Plum.{far} a.b@mail.example.com{far} plum"), (111, f"thanks, plum.{far} a.b@mail.example.com"), (112, f"ordinary{far}")]
    docs += [(i, f"scarlet.{far} c.d@mail.example.com") for i in (120, 121)]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n_chars", F.length("text").cast("long"))
    clean = {r.doc_id: r.text for r in privacy.sanitised(d).collect()}
    assert clean[100] == f"  writes from [EMAIL] today{far} , mustards" and clean[101] == f"reach  , [EMAIL] soon{far}"
    assert clean[110] == f"Owner .{far} [EMAIL]{far} " and clean[111] == f"thanks, .{far} [EMAIL]"
    assert clean[120] == f"scarlet.{far} [EMAIL]"  # copies of one text are no evidence
    assert clean[112] == dict(docs)[112] and len(clean) == len(docs)


def brute_components(texts, size, num, den):
    sets = {i: frozenset(jaccard.shingle_set(t, size).tolist()) for i, t in texts.items()}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(s), root(i)) for i, s in sets.items()}


@pytest.mark.parametrize(("size", "num"), [(3, 90), (5, 80), (1, 50)])
def test_jaccard_against_brute_force(spark, monkeypatch, size, num):
    monkeypatch.setattr(jaccard, "LEAF", 8)  # so that clusters do split by pivots
    monkeypatch.setattr(jaccard, "REGION_BLOCK", 10)  # and regions into blocks
    monkeypatch.setattr(jaccard, "CLUSTER_BLOCK", 1500)
    rng = np.random.default_rng(size)
    texts = {1: None, 2: "", 3: " ", 4: "one two", 5: "one two", 6: "One  two\x0b", 7: "one two three"}
    base = [" ".join(f"w{x}" for x in rng.integers(0, 400, 60)) for _ in range(4)]
    for k in range(160):
        words = base[k % 4].split()
        for _ in range(int(rng.integers(0, 8))):
            words[int(rng.integers(0, len(words)))] = f"new{int(rng.integers(0, 50))}"
        texts[10 + k] = " ".join(words)
    d = spark.createDataFrame(list(texts.items()) + [(10, texts[10])], "doc_id long, text string")
    rows = jaccard.jaccard_join(d, size, (num, 100)).collect()
    assert len(rows) == len(texts) + 1
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == brute_components(texts, size, num, 100)


def test_jaccard_rows_of_one_id_are_one_document(spark):
    """Ids with several texts are linked by any of them; an id without words among them stays its own."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(5, a), (5, b), (3, b), (9, a), (9, None), (12, c), (12, ""), (7, None), (None, a), (20, c + " more"), (20, c + " more")]
    got = sorted(tuple(r) for r in jaccard.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), 5, (80, 100)).collect() if r.doc_id is not None)
    assert got == sorted([(5, 26, 3), (5, 26, 3), (3, 26, 3), (9, 26, 3), (9, 0, 3), (12, 26, 12), (12, 0, 12), (7, 0, 7), (20, 27, 12), (20, 27, 12)])


def test_components_of_a_chain(spark):
    n = 300
    links = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001), (5000, 5000)], "a long, b long")
    got = {r.id: r.component_id for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(n + 1)}, 1000: 1000, 1001: 1000}


def test_warc_round_trip(spark, edge):
    rows = sorted(tuple(r) for r in QUERIES["op6_warc"](spark, edge).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect())
    want = []
    for p in spark.read.parquet(f"{edge}/pages.parquet").collect():
        raw = (p.html or "").encode()
        top = {2000: 6, 1700: 5}.get(len(raw))
        revisit = top is not None and p.page_id != top
        want.append((p.page_id, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", top if revisit else None))
    assert rows == sorted(want)


def test_warc_large_payloads_and_equal_rows(spark, tmp_path):
    """Sizes of all classes, one of 50 MB; equal rows have identifiers of their own and revisits name a response."""
    big = "0123456789abcdef" * (50 * 2**16)
    texts = [(1, big), (2, big), (3, "y" * 2**19), (4, "z" * 5000), (4, "z" * 5000), (9, "z" * 5000), (9, "z" * 5000), (None, "w" * 3000)]
    pages = spark.createDataFrame([(i, "http://a/", h) for i, h in texts], "page_id long, url string, html string")
    warc.write_arc(pages, f"{tmp_path}/arc", 2)
    for size, (_, most) in enumerate(warc.SIZES):
        warc.convert(spark, f"{tmp_path}/arc/size={size}", f"{tmp_path}/warc/size={size}", most)
    records = warc.read_warc(spark, f"{tmp_path}/warc/size=*")
    rows = records.collect()
    assert len({r.record_id for r in rows}) == len(texts)
    responses = {r.record_id: r.page_id for r in rows if r.record_type == "response"}
    assert sorted((r.page_id, responses[r.refers_to]) for r in rows if r.refers_to) == [(1, 2), (4, 9), (4, 9)]
    assert sorted((r.page_id, r.refers_to) for r in warc.resolved(records).collect() if r.refers_to) == [(1, 2), (4, 9), (4, 9)]
    files = [r.path for r in warc._files(spark, f"{tmp_path}/arc/size=2").collect()]
    assert len(files) == 2


def test_arc_header_lines():
    one = b"filedesc://a.arc 0.0.0.0 20240101000000 text/plain 76\n1 0 origin\nURL IP-address Archive-date Content-type Archive-length\n\n"
    head = len(b"1 0 origin\nURL IP-address Archive-date Content-type Archive-length\n")
    one = one.replace(b" 76\n", b" %d\n" % head)
    body = b"HTTP/1.1 200 OK\r\n\r\nhello\n\nhttp://fake 0.0.0.0 20240101000000 text/html 3\n"
    data = one + b"http://x y/ 1.2.3.4 20240506070809 text/html %d\n" % len(body) + body + b"\n\n"
    assert list(warc.arc_records(data)) == [("http://x y/", "20240506070809", body)]
    with pytest.raises(ValueError, match="shorter"):
        list(warc.arc_records(data[:-20]))


@pytest.mark.parametrize(
    "weights",
    [
        {"a": 1 / 3, "b": 1 / 3, "c": 1 / 3},
        {"a": 1 / 7, "b": 2 / 7, None: 4 / 7},
        {"a": 0.9, "b": 0.0999, "c": 0.0001},
        {f"s{i}": float(i + 1) ** -0.5 for i in range(60)},
        {"hot": 1000.0, **{f"s{i}": 1.0 + i % 3 for i in range(3000)}},
        {f"s{i}": 1.0 for i in range(3000)},
    ],
)
def test_mixing_is_less_than_a_block_off(spark, weights):
    """Against the unrounded target weights, at every slot; few sources stay within two documents."""
    slots, total = 6000 if len(weights) < 1000 else 1500, sum(weights.values())
    rows = [r for r in mixing.schedule(spark, mixing.whole_weights(weights), slots).collect() if r.slot < slots]
    rows.sort(key=lambda r: r.slot)
    assert [r.slot for r in rows] == list(range(slots))
    share = {s: w / total for s, w in weights.items()}
    had, worst = dict.fromkeys(weights, 0), 0.0
    for t, r in enumerate(rows):
        assert r.number == had[r.source]
        worst = max(worst, abs(had[r.source] - share[r.source] * t))
        had[r.source] += 1
        worst = max(worst, abs(had[r.source] - share[r.source] * (t + 1)))
        assert r.release <= t < r.due
    worst = max(worst, *(abs(had[s] - share[s] * slots) for s in weights))
    assert worst < (mixing.BLOCK if len(weights) > 1000 else 2)


def test_mixing_edges(spark, edge):
    rows = QUERIES["op7_mixing"](spark, edge).collect()
    assert sorted(r.place for r in rows) == list(range(len(TEXTS)))
    docs = spark.read.parquet(f"{edge}/documents.parquet")
    out = mixing.in_mixed_order(docs)
    assert sorted(map(str, out.collect())) == sorted(map(str, docs.collect()))
    late = mixing.mixed(docs, {"s1": 1.0}).collect()
    assert {r.source for r in late if r.slot is not None} == {"s1"} and len(late) == len(TEXTS)
    assert mixing.whole_weights({"a": 1, "b": 1, "c": 1}, 10) == {"a": 4, "b": 3, "c": 3}
    assert mixing.whole_weights({"a": 1.0, "b": 1e-30}) == {"a": mixing.WHOLE - 1, "b": 1}


def test_mixing_many_small_sources(spark):
    """Sources without a whole share of an epoch take part; only the rest of the last one follows unmixed."""
    docs = [(i, "hot" if i < 1500 else f"s{i % 750}", "x") for i in range(3000)]
    d = spark.createDataFrame(docs, "doc_id long, source string, text string")
    rows = mixing.mixed(d, {"hot": 0.5, **{f"s{i}": 0.5 / 750 for i in range(750)}}).collect()
    assert sorted(r.place for r in rows) == list(range(3000)) and len({r.doc_id for r in rows}) == 3000
    hot = [r.place for r in rows if r.source == "hot" and r.place < 2000]
    assert abs(len(hot) - 1000) < 8 and all(r.source == "hot" for r in rows if r.slot is None)


def test_fingerprints_estimate_the_similarity(spark, edge, tmp_path):
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{x}" for x in rng.zipf(1.5, 300) % 500) for _ in range(60)] + ["", "a b c d", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r for r in QUERIES["op8_fingerprints"](spark, str(tmp_path)).collect()}
    assert sorted(rows) == list(range(len(texts)))
    errors = []
    for i, t in enumerate(texts):
        t, nxt = t or "", texts[(i + 1) % len(texts)] or ""
        cut = len(t) // 4
        edited = t[: len(t) - cut] + nxt[:cut]
        assert rows[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and rows[i].n_chars == len(t)
        errors += [rows[i].near_edited - fingerprints.generalised_jaccard(t, edited), rows[i].near_next - fingerprints.generalised_jaccard(t, nxt)]
    assert np.sqrt(np.mean(np.square(errors))) < 0.06 and abs(np.mean(errors)) < 0.015
    edges = QUERIES["op8_fingerprints"](spark, edge).collect()
    assert len(edges) == len(TEXTS) and len({r.fingerprint for r in edges if r.doc_id in (1, 5)}) == 1


def test_packing_round_trip(spark, edge):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(packing.tokenizer_path())
    rows = QUERIES["op9_packing"](spark, edge).collect()
    want = []
    for i, t in TEXTS:
        ids = np.array(whole.encode(t or "", add_special_tokens=False).ids + [0], dtype="<u4")
        want += [(i, k, a, len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048].tobytes())) for k, a in enumerate(range(0, len(ids), 2048))]
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    held = defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for spans in held.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048


def test_packing_words_and_odd_characters():
    from tokenizers import Tokenizer

    whole, words = Tokenizer.from_file(packing.tokenizer_path()), packing.WordIds(packing.tokenizer_path())
    odd = ["a\x1cb c", "Hello<|endoftext|>. World", "İstanbul ΑΣ. x", "é Å!", "a\x85b c　d", "<|STARTOFTEXT|> 12.5,don't. it's!", "ﬁ½²x?", "a​b", "x́.", "1.2.3. ٣.", "ⅷ. x⃝.", "ŉ ſ ß ª µ ǰ."]
    for text, ids in zip(odd, words.ids(odd), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == [*whole.encode(text, add_special_tokens=False).ids, 0], text


@pytest.mark.parametrize("seed", range(5))
def test_best_fit_runs(seed):
    rng = np.random.default_rng(seed)
    lengths = dict(zip(*[x.tolist() for x in np.unique(rng.integers(1, 100 + 1, 3000) if seed else [100] * 7, return_counts=True)], strict=True))
    runs = packing.best_fit_runs(lengths, 100)
    given, held = defaultdict(list), defaultdict(list)
    for n, first, last, sequence, offset in runs:
        for rank in range(first, last + 1):
            given[n].append(rank)
            held[sequence + rank - first].append((offset, n))
    assert {n: sorted(r) for n, r in given.items()} == {n: list(range(c)) for n, c in lengths.items()}
    for spans in held.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert at <= 100
    assert len(held) <= 1.02 * sum(n * c for n, c in lengths.items()) / 100 + 2


def brute_licenses(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    at, labels = [], set()
    for phrase, label in licenses.PHRASES:
        want = phrase.split()
        for i in range(len(words) - len(want) + 1):
            if words[i : i + len(want)] == want:
                at.append(i)
                labels.add(label)
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def test_licenses_against_brute_force(spark, tmp_path):
    texts = [t for _, t in TEXTS] + [
        "MIT License mit license, the MIT-License.", "cc by cc by-nc 4.0 CC\tBY", "éapache license", "Apache License, Version 2.0 " * 300,
        "mitlicense; gnu general public licenses", "gnu general public license apache license",
    ]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = QUERIES["op10_licenses"](spark, str(tmp_path)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_licenses(texts[r.doc_id]), texts[r.doc_id]
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    by_text = {texts[r.doc_id]: r.labels for r in rows}
    assert by_text["cc by cc by-nc 4.0 CC\tBY"] == "cc-by,cc-by-nc-4.0"
    assert by_text[TEXTS[8][1]] == "gpl,gpl-3.0,mit"
    assert len(license_rules.RULES) >= 200 and len({r.regex for r in license_rules.RULES}) == len(license_rules.RULES)


def shortest(regex):
    """A text that fits ``regex``: first branches, optional parts left out."""
    from re import _parser

    def told(items):
        out = ""
        for op, arg in items:
            match str(op):
                case "LITERAL":
                    out += chr(arg)
                case "NOT_LITERAL":
                    out += "x"
                case "IN":
                    out += "x" if str(arg[0][0]) == "NEGATE" else chr(arg[0][1])
                case "BRANCH":
                    out += told(arg[1][0])
                case "SUBPATTERN":
                    out += told(arg[-1])
                case "MAX_REPEAT":
                    out += told(arg[2]) * arg[0]
                case "ASSERT":
                    pass
                case _:
                    raise ValueError(op)
        return out

    return told(_parser.parse(regex))


def test_licenses_every_rule_alone(spark):
    """Each rule gives its label to a text that only it fits, in other cases and with other separators too."""
    sets = []
    for r in license_rules.RULES:
        text = shortest(r.regex)
        assert any(k in f" {text} " for k in r.keywords), r
        sets += [(r.label, text), (r.label, text.upper().replace(" ", "\n -"))]
    sets += [
        ("cc-by-4.0", "Creative Commons Attribution 4.0 International"), ("cc0-1.0", "CC0 1.0"), ("bsd-2-clause", "FreeBSD"), ("ms-pl", "(Ms-PL)"),
        ("cc-by-sa-3.0", "creative commons attribution ShareAlike 3.0"), ("proprietary", "All rights\nreserved"), ("gfdl-1.3", "GFDL 1.3"),
        ("public-domain", "put into the public\ndomain"), ("wtfpl", "do what the heck you want to public licence"), ("wtfpl", "WTFPL"),
        ("cddl-1.0", "CDDL 1.0"), ("eupl-1.2", "EUPL-1.2"), ("osl-3.0", "OSL 3.0"), ("afl-3.0", "AFL 3.0"), ("artistic-2.0", "Artistic 2.0"),
        ("odbl-1.0", "ODbL 1.0"), ("ofl-1.1", "OFL 1.1"), ("zpl-2.1", "ZPL 2.1"), ("psf-2.0", "PSF-2.0"), ("bsl-1.0", "Boost BSL 1.0"),
        ("ms-pl", "MS-PL 1.0"), ("odc-by-1.0", "ODC-BY 1.0"), ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\")"),
        ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
        ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided"),
        ("gpl-2.0-or-later", "the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
        ("lgpl-2.1", "GNU Lesser General Public License v2.1"), ("mpl-2.0", "MPL-2.0"), ("gpl-3.0", "GPLv3"), ("agpl-3.0-only", "AGPL-3.0-only"),
    ]
    d = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(sets)], "doc_id long, text string").repartition(8)
    rows = licenses.scan_licenses(d).select("doc_id", "labels").collect()
    assert len(rows) == len(sets)
    wrong = [(sets[r.doc_id], r.labels) for r in rows if sets[r.doc_id][0] not in r.labels.split(",")]
    assert not wrong


#: What a reader of SPDX's list expects of each text, written apart from the rules: all labels and no other.
IDENTIFIERS = """
GPL-1.0-only: gpl-1.0-only
GPL-1.0-or-later: gpl-1.0-or-later
GPL-2.0: gpl-2.0
GPL-2.0+: gpl-2.0-or-later
GPL-2.0-only: gpl-2.0-only
GPL-2.0-or-later: gpl-2.0-or-later
GPL-3.0: gpl-3.0
GPL-3.0+: gpl-3.0-or-later
GPL-3.0-only: gpl-3.0-only
GPL-3.0-or-later: gpl-3.0-or-later
LGPL-2.0-only: lgpl-2.0-only
LGPL-2.0-or-later: lgpl-2.0-or-later
LGPL-2.1: lgpl-2.1
LGPL-2.1+: lgpl-2.1-or-later
LGPL-2.1-only: lgpl-2.1-only
LGPL-2.1-or-later: lgpl-2.1-or-later
LGPL-3.0-only: lgpl-3.0-only
LGPL-3.0-or-later: lgpl-3.0-or-later
LGPL-3.0+: lgpl-3.0-or-later
AGPL-1.0-only: agpl-1.0-only
AGPL-1.0-or-later: agpl-1.0-or-later
AGPL-3.0: agpl-3.0
AGPL-3.0-only: agpl-3.0-only
AGPL-3.0-or-later: agpl-3.0-or-later
GFDL-1.1-only: gfdl-1.1-only
GFDL-1.1-or-later: gfdl-1.1-or-later
GFDL-1.2-only: gfdl-1.2-only
GFDL-1.3: gfdl-1.3
GFDL-1.3-or-later: gfdl-1.3-or-later
Apache-2.0: apache-2.0
Apache-1.1: apache-1.1
Apache-1.0: apache-1.0
MIT: mit
MIT-0: mit-0
ISC: isc
Zlib: zlib
0BSD: 0bsd
BSD-2-Clause: bsd-2-clause
BSD-2-Clause-Patent: bsd-2-clause-patent
BSD-3-Clause: bsd-3-clause
BSD-3-Clause-Clear: bsd-3-clause-clear
BSD-4-Clause: bsd-4-clause
MPL-1.1: mpl-1.1
MPL-2.0: mpl-2.0
EPL-1.0: epl-1.0
EPL-2.0: epl-2.0
CDDL-1.0: cddl-1.0
EUPL-1.2: eupl-1.2
BSL-1.0: bsl-1.0
BUSL-1.1: busl-1.1
CC0-1.0: cc0-1.0
CC-BY-SA-4.0: cc-by,cc-by-sa-4.0
CC-BY-NC-ND-4.0: cc-by,cc-by-nc-nd-4.0
OFL-1.1: ofl-1.1
Unlicense: unlicense
WTFPL: wtfpl
SSPL-1.0: sspl-1.0
Elastic-2.0: elastic-2.0
PostgreSQL: postgresql
X11: x11
NCSA: ncsa
Artistic-2.0: artistic-2.0
Ruby: ruby
MulanPSL-2.0: mulanpsl-2.0
Python-2.0: python-2.0
Apache-2.0 OR MIT: apache-2.0,mit
(MIT OR Apache-2.0): apache-2.0,mit
MIT OR GPL-2.0-or-later: gpl-2.0-or-later,mit
GPL-2.0-only OR MIT: gpl-2.0-only,mit
BSD-3-Clause AND MIT: bsd-3-clause,mit
(GPL-2.0+ OR MIT): gpl-2.0-or-later,mit
LGPL-2.1-only OR BSD-3-Clause: bsd-3-clause,lgpl-2.1-only
LGPL-2.1-or-later AND GPL-3.0-only: gpl-3.0-only,lgpl-2.1-or-later
GPL-2.0-only WITH Classpath-exception-2.0: classpath-exception-2.0,gpl-2.0-only
GPL-2.0+ WITH Bison-exception-2.2: bison-exception-2.2,gpl-2.0-or-later
GPL-3.0-or-later WITH GCC-exception-3.1: gcc-exception-3.1,gpl-3.0-or-later
GPL-2.0 WITH Linux-syscall-note: gpl-2.0,linux-syscall-note
Apache-2.0 WITH LLVM-exception: apache-2.0,llvm-exception
MIT OR ISC: isc,mit
"""
#: The same for running text.
SENTENCES = [
    ("GPLv2+", "gpl-2.0-or-later"), ("GPL v3+", "gpl-3.0-or-later"), ("LGPLv2.1+", "lgpl-2.1-or-later"), ("GPL version 2+", "gpl-2.0-or-later"),
    ("GPLv2 only", "gpl-2.0-only"), ("GPLv3 or later", "gpl-3.0-or-later"), ("GPL-2.0 plus 2+2", "gpl-2.0"), ("MIT/Apache-2.0", "apache-2.0,mit"),
    ("the GNU General Public License, version 2", "gpl,gpl-2.0"), ("GNU General Public License v3.0 only", "gpl,gpl-3.0-only"),
    ("GNU General Public License version 2 or (at your option) any later version", "gpl,gpl-2.0-or-later"),
    ("GNU Lesser General Public License version 2.1 or later", "lgpl-2.1-or-later"), ("GNU Affero General Public License v3", "agpl-3.0"),
    ("GNU Library General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version", "lgpl-2.0-or-later"),
    ("under the terms of the GNU Free Documentation License, Version 1.3 or any later version published by the Free Software Foundation", "gfdl-1.3-or-later"),
    ("Server Side Public License", "sspl"), ("Server Side Public License, version 1", "sspl-1.0"), ("students of Harvard or MIT or Yale", ""),
    ("GNU GPL", "gpl"), ("1 or later, 2 only, 3+", ""), ("the exception 2.0 of a rule", ""),
]


def test_licenses_identifiers(spark):
    """Every identifier and expression behind its tag, and GNU ones bare too, gives just its own labels."""
    told = [line.rsplit(": ", 1) for line in IDENTIFIERS.strip().splitlines()]
    assert len(told) >= 60
    cases = [(f"// SPDX-License-Identifier: {text}\n", labels) for text, labels in told] + SENTENCES
    cases += [(f"see {text}, there", labels) for text, labels in told if "GPL" in text or "GFDL" in text]
    d = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string").repartition(8)
    rows = licenses.scan_licenses(d).select("doc_id", "labels", "n_words", "text").collect()
    # A phrase of the contract keeps its own label.
    assert not [(cases[r.doc_id], r.labels) for r in rows if r.labels != cases[r.doc_id][1]]
    assert all(r.n_words == len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", r.text.lower())) for r in rows)


def test_licenses_no_false_labels(spark):
    clean = [
        "This license: an artistic view, apache helicopter, epl season", "limited permit, odd artistically", None, "", "the mit campus and bsd people",
        "a boost of 1.0 in the mozilla fox", "gpl", "cc me in the mail, by 4.0 at the latest", "they rest later or 3 years later under the sea",
        "apache 2 helicopters", "public opinion in the domain", "the licence plate of the car", "afl game 3", "permission is granted by the office",
    ]
    d = spark.createDataFrame(list(enumerate(clean)), "doc_id long, text string")
    rows = {clean[r.doc_id]: (r.labels, r.score) for r in licenses.scan_licenses(d).collect()}
    assert rows == dict.fromkeys(clean, ("", 0.0))


def test_licenses_overlaps(spark):
    """A detection inside a longer one is suppressed, places of a long text all count."""
    long = "MIT License; " * 3000 + "licensed under the Apache License, Version 2.0"
    d = spark.createDataFrame([(0, long), (1, "CC BY-NC-SA 4.0"), (2, "GNU Lesser General Public License 3.0")], "doc_id long, text string")
    rows = {r.doc_id: r for r in licenses.scan_licenses(d.withColumn("labels", F.lit("x"))).collect()}
    assert rows[0].labels == "apache,apache-2.0,mit" and rows[0].n_base == 3001 and len(rows[0].detections) == 3001
    assert rows[0].detections[-1].start == 6000 and -rows[0].detections[-1].back == 6008
    assert rows[1].labels == "cc-by,cc-by-nc-sa-4.0" and rows[2].labels == "lgpl-3.0"
