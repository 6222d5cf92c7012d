"""The stages of the pipeline against brute-force versions on a small table."""

import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from tallywright.llm import jaccard, packing, privacy  # noqa: E402


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("corpus")
    rng = np.random.default_rng(11)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 5))
    docs, labels = [], []
    for i in range(120):
        words = [word() for _ in range(40)]
        toxic = i % 6 == 0
        if toxic:
            words[7] = "moronic"
        if i % 10 == 3:
            words[9] = f"x{i}@mail.example.com"
        docs.append((i, " ".join(words), "en", f"src{i % 3}"))
        labels.append((i, 1, int(toxic)))
    for i in range(5):
        docs.append((200 + i, docs[20 + i][1] + " tail", "en", "src0"))
        docs.append((300 + i, docs[20 + i][1], "en", "src1"))
    docs.append((400, None, "en", None))
    rows = [(i, t, a, s, len(t or "")) for i, t, a, s in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    return str(root)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        seen.append((name, docs.collect(), out.collect(), out.columns))
        docs = corpus_pipeline.stored(out, name)
    assert [s[0] for s in seen] == ["toxicity", "near_duplicates", "privacy", "mixing", "packing"]
    assert all(s[3] == columns for s in seen[:-1])
    _, before, after, _ = seen[0]
    assert {r.doc_id for r in after} == {r.doc_id for r in before if "moronic" not in (r.text or "")}
    _, before, after, _ = seen[1]
    kept = {r.doc_id for r in after}
    sets = {r.doc_id: frozenset(jaccard.shingle_set(r.text, 5).tolist()) for r in before}
    want = set()
    for i in sorted(sets):  # copies here link with their originals only
        if not any(sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) for j in want):
            want.add(i)
    assert kept == want
    _, before, after, _ = seen[2]
    assert {r.doc_id for r in after} == {r.doc_id for r in before}
    assert all("@" not in (r.text or "") for r in after) and sum("[EMAIL]" in (r.text or "") for r in after) > 5
    _, before, after, _ = seen[3]
    assert sorted(map(str, after)) == sorted(map(str, before))
    _, before, after, _ = seen[4]
    ids = packing.WordIds(packing.tokenizer_path())
    assert sum(r.length for r in after) == sum(len(ids.ids([r.text or ""])[0]) // 4 for r in before)


def test_run_equals_its_stages(spark, folder):
    rows = corpus_pipeline.run(spark, folder).collect()
    assert rows and {r.offset + r.length <= 2048 for r in rows} == {True}
    assert privacy.KINDS == ("email", "ip", "card", "phone")


def test_sequences_follow_the_mix(spark, tmp_path):
    """Sources take turns along ``sequence_id`` as the weights have them, until one runs out."""
    rng = np.random.default_rng(5)
    docs = [(i, " ".join(["word"] * int(rng.integers(300, 1500))), "hot" if i < 1500 else "small", 0) for i in range(2000)]
    spark.createDataFrame(docs, "doc_id long, text string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    mixed = corpus_pipeline.stored(corpus_pipeline.in_mixed_order(spark.read.parquet(f"{tmp_path}/documents.parquet"), {"hot": 0.5, "small": 0.5}), "mix")
    place = {r.doc_id: r.place for r in packing.in_file_order(mixed, "place").select("doc_id", "place").collect()}
    assert sorted(place.values()) == list(range(2000))
    assert abs(sum(i >= 1500 for i, p in place.items() if p < 1000) - 500) <= 8  # one block
    source = {i: s for i, _, s, _ in docs}
    for rows in (
        corpus_pipeline.packing(spark, mixed, str(tmp_path)).collect(),
        packing.pack_in_order(packing.in_file_order(mixed, "place"), packing.tokenizer_path(), "place", parts=8, least=100).collect(),
    ):
        opening = [source[r.doc_id] for r in sorted(rows, key=lambda r: r.sequence_id) if r.offset == 0]
        assert len(opening) == 1 + max(r.sequence_id for r in rows)
        early, late = opening[: len(opening) // 3], opening[-len(opening) // 3 :]
        assert 0.4 < early.count("small") / len(early) < 0.6 and late.count("small") <= 0.05 * len(late)
    early = [r for r in rows if r.sequence_id < len(opening) * 0.45]
    assert 0.4 < sum(r.length for r in early if source[r.doc_id] == "small") / sum(r.length for r in early) < 0.6
    filled = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == filled.get(r.sequence_id, 0)
        filled[r.sequence_id] = r.offset + r.length
    assert sorted(r.doc_id for r in rows) == sorted(source) and max(filled.values()) <= 2048


#: Columns of a caller's that clash with what operators might call their own.
CLASHING = ["_id", "_key", "_row", "_file", "_masked", "_place", "_tie", "_given", "_of", "_offset", "_metadata", "score", "place", "a.b"]
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def edge_rows():
    """Nulls in any column, empty and very long texts, repeated rows and ids, a page of 20,000 addresses and a copy of it."""
    page = " ".join(f"write to person{i}@mail{i % 97}.example.com for office {'abcdefgh'[i % 8]}room now" for i in range(20_000))
    long = " ".join(f"word{i * 7919 % 6007}" for i in range(150_000))
    rows = [
        (1, None, None, None), (2, "", "en", "s"), (3, " \n ", "en", ""), (4, "one", None, "s"), (5, page, "en", "s"), (6, page + " tail", "en", "s"),
        (7, long, "en", "t"), (8, "same text of a few words here", "en", "t"), (8, "same text of a few words here", "en", "t"),
        (8, "another text under the same id as before", "en", "t"), (None, "mail to lost@mail.example.com please", "en", "t"), (None, None, None, None),
        (9, "mail to lost@mail.example.com please", "en", None),
    ]
    return [(i, t, a, s, None if t is None else len(t)) for i, t, a, s in rows]


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage_edges(spark, tmp_path, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    rows = edge_rows()
    schema = DOCUMENTS + "".join(f", `{c}` string" for c in CLASHING)
    spark.createDataFrame([(*r, *[f"{c} of {k}" for c in CLASHING]) for k, r in enumerate(rows)], schema).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(9)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.schema(schema).parquet(f"{tmp_path}/documents.parquet")
    out = stage(spark, docs, str(tmp_path))
    if name == "packing":
        ids = [r.doc_id for r in out.where("piece = 0").select("doc_id").collect()]
        assert sorted(ids, key=str) == sorted((r[0] for r in rows), key=str)
        return
    assert out.columns == docs.columns
    got = out.collect()
    # Clashing columns come back as they were, each beside its own row.
    known = {f"{CLASHING[0]} of {k}": (r[0], k) for k, r in enumerate(rows)}
    for r in got:
        doc, k = known[r["_id"]]
        assert r.doc_id == doc and all(r[c] == f"{c} of {k}" for c in CLASHING)
    kept = sorted(known[r["_id"]][1] for r in got)
    if name == "near_duplicates":
        assert kept == [k for k in range(len(rows)) if rows[k][0] != 6]  # the copy of the page goes
    else:
        assert kept == list(range(len(rows)))
    if name == "privacy":
        texts = {known[r["_id"]][1]: r for r in got}
        assert texts[0].text is None and texts[1].text == "" and texts[6].text == rows[6][1]
        assert "@" not in texts[4].text and texts[4].text.count("[EMAIL]") == 20_000
        assert texts[4].n_chars == len(texts[4].text) and texts[10].text.count("[EMAIL]") == 1


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage_of_an_empty_table(spark, tmp_path, name):
    spark.createDataFrame([], DOCUMENTS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.schema(DOCUMENTS).parquet(f"{tmp_path}/documents.parquet")
    out = dict(corpus_pipeline.STAGES)[name](spark, docs, str(tmp_path))
    assert out.count() == 0 and (name == "packing" or out.columns == docs.columns)


def test_classes_of_terms_against_all_pairs(spark):
    """What classes tell about a document's own entities is what counting every entity and term tells."""
    import math
    from collections import defaultdict

    rng = np.random.default_rng(8)
    names = [f"p{i}@mail.example.com" for i in range(12)]
    words = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(30)]
    beside = {e: "".join(rng.choice(list("pqrstuvw"), 6)) for e in names}  # mostly mentioned with its name

    def text():
        mine = rng.choice(names, rng.integers(0, 3))
        return " ".join([*rng.choice(words, 6), *mine, *[beside[e] for e in mine if rng.random() < 0.8], *rng.choice(words, 3)])

    rows = [(i % 70, text()) for i in range(80)]
    rows += rows[:5]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.key, r.term): r.share for r in privacy.document_terms(privacy.spans_of(docs, words=True), privacy.frequency_of(docs)).withColumn("key", privacy.F.col("text_key")).collect()}
    keyed = [(i, t, {w for w in t.split() if "@" in w}, {w for x in t.replace("@", " ").replace(".", " ").split() for w in [x.strip("0123456789")] if len(w) >= 3 and x.isalpha()}) for i, t in rows]
    n, df_t = len(rows), defaultdict(int)
    for *_, ts in keyed:
        for w in ts:
            df_t[w] += 1
    distinct = {(i, t): (es, ts) for i, t, es, ts in keyed}
    df_e, co, support = defaultdict(int), defaultdict(int), defaultdict(set)
    for (_, t), (es, ts) in distinct.items():
        for e in es:
            df_e[e] += 1
            for w in ts:
                co[e, w] += 1
                support[e, w].add(t)
    share = {k: math.log2(n * c / (max(df_t[k[1]], c) * df_e[k[0]])) / math.log2(n / df_e[k[0]]) for k, c in co.items() if len(support[k]) >= privacy.SUPPORT}
    want = {}
    for (i, t), (es, ts) in distinct.items():
        told = {w: max((share[e, w] for e in es if (e, w) in share), default=0) for w in ts}
        want |= {(i, t, w): s for w, s in told.items() if s >= privacy.GENERALISE}
    assert len(got) == len(want) > 0
    assert sorted((i, w, round(s, 9)) for (i, _, w), s in got.items()) == sorted((i, w, round(s, 9)) for (i, _, w), s in want.items())


def test_near_duplicates_broadcast_nothing(spark, folder):
    """Small tables of ids meet by merge: what is broadcast is held by the driver, several times over, in every step."""
    store = spark._jsparkSession.sharedState().statusStore()
    begun = store.executionsCount()
    found = jaccard.jaccard_join(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text"), 5, (80, 100))
    steps = {r.doc_id: r.component_id for r in found.where("doc_id < 400").collect()}
    assert steps[300] == steps[200] == 20 and steps[1] == 1
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    plans = [store.executionsList().apply(k).physicalPlanDescription() for k in range(begun, store.executionsCount())]
    assert len(plans) > 5
    # The one join with whole texts is left to Spark: a few members' ids may go to where the texts are.
    assert [p.count("BroadcastExchange") for p in plans if "BroadcastExchange" in p and "text_key" not in p] == []
