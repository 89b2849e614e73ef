import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tabsift.llm import embedding_dedup, jaccard_join
from tabsift.llm.components import components, forest
from tabsift.llm.shingles import shingles


def closure(n, pairs):
    parent = list(range(n))

    def top(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in pairs:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    return [top(v) for v in range(n)]


def test_components_equal_closure(spark):
    r = random.Random(1)
    for n, m in ((60, 30), (60, 55), (40, 0), (200, 190)):
        pairs = [(r.randrange(n), r.randrange(n)) for _ in range(m)] + ([(i, i + 1) for i in range(n // 2)] if m == 190 else [])
        want = closure(n, pairs)
        got = {x.id: x.component for x in components(spark.createDataFrame([*pairs, (None, 3)], "a long, b long")).collect()}
        linked = {v for a, b in pairs if a != b for v in (a, b)}
        assert got == {v: want[v] for v in linked}
        edges = forest(np.array([p[0] for p in pairs], int), np.array([p[1] for p in pairs], int), n)
        assert closure(n, edges) == want


def words_of(text):
    return re.findall("[^\x20\x09-\x0d]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def shingle_set(text, width=4):
    w = words_of(text)
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def test_shingles_equal_brute_force():
    r = random.Random(3)
    some = ["".join(r.choice(["a", "B", "é", " ", "\n", "\x0b", "\x1c", " ", "ab", "ba"]) for _ in range(r.randint(0, 30))) for _ in range(500)] + [None, "", "a b a b a b a b"]
    for width in (1, 4, 5):
        sets, off = shingles(pa.array(some), width)
        assert np.diff(off).tolist() == [len(shingle_set(t, width)) for t in some]
        seen = {}
        for t, a, b in zip(some, off, off[1:]):
            key = frozenset(shingle_set(t, width))
            assert seen.setdefault(key, sets[a:b].tolist()) == sets[a:b].tolist()
        assert len({tuple(v) for v in seen.values()}) == len(seen)


def near_texts(seed, bases, copies, size):
    """Bases, edited copies of various distance, exact copies, and a line that many share."""
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(4000)]
    line = [r.choice(vocabulary) for _ in range(9)]
    out = []
    for _ in range(bases):
        base = [r.choice(vocabulary) for _ in range(r.randint(*size))]
        out.append(base)
        for _ in range(r.randint(0, copies)):
            t = list(base)
            for _ in range(r.randint(0, max(1, len(t) // 40))):
                t[r.randrange(len(t))] = r.choice(vocabulary)
            out.append(t)
        if r.random() < 0.3:
            out.append(list(base))
    out = [line + t if r.random() < 0.4 else t for t in out]
    r.shuffle(out)
    return [" ".join(t) for t in out]


def jaccard_components(texts, percent, width=4):
    sets = [shingle_set(t, width) for t in texts]
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    return closure(len(sets), pairs), [len(s) for s in sets]


@pytest.mark.parametrize(("seed", "bases", "copies", "size", "percent"), [(1, 25, 6, (5, 120), 85), (2, 3, 60, (60, 90), 85), (3, 10, 12, (1, 12), 60)])
def test_join_equals_brute_force(spark, seed, bases, copies, size, percent, monkeypatch):
    monkeypatch.setattr(jaccard_join, "CROSSING", 20)  # so that some families are compared in blocks
    monkeypatch.setattr(jaccard_join, "SALTED", 2)
    texts = [*near_texts(seed, bases, copies, size), "", None, "  \n", "one two", "ONE  two", "one two three"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("component_id", F.lit("clash")).repartition(3)
    got = {r.doc_id: r for r in jaccard_join.join(docs, percent=percent).collect()}
    want, sizes = jaccard_components(texts, percent)
    assert [got[i].component_id for i in range(len(texts))] == want
    assert [got[i].n_shingles for i in range(len(texts))] == sizes


def test_join_edges(spark):
    assert jaccard_join.join(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = [(None, "a b c d e"), (4, "a b c d e"), (4, "a b c d e"), (9, "a b c d e")]
    got = jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id or -1), r.component_id or -1) for r in got) == [(-1, -1), (4, 4), (4, 4), (9, 4)]


def test_lone_group_unlinked_to_its_first(spark):
    head, body, other = [1, 2, 3], list(range(10, 26)), list(range(30, 46))  # 20 shingles each, one of them shared with none
    rows = [(0, 20, head + other)] + [(i, 20, head + body) for i in range(1, 60)]
    sets = spark.createDataFrame(rows, "id long, n long, shared array<long>")
    assert 59 * 60 / 2 > jaccard_join.CROSSING
    assert {r.id: r.component for r in jaccard_join.link_classes(sets, 85).collect()} == dict.fromkeys(range(1, 60), 1)


def test_overlaps_in_blocks():
    r = np.random.default_rng(2)
    sets = [r.choice(9000, r.integers(0, 3000), replace=False) for _ in range(12)]
    flat, size = np.concatenate(sets), np.array([len(s) for s in sets])
    assert jaccard_join.overlaps(flat, size, flat, size).tolist() == [[len(set(a) & set(b)) for b in sets] for a in sets]


def brute_links(rows, cosine=0.93):
    x = {}
    for k, (_, v, label) in enumerate(rows):
        if label is not None and v and None not in v and np.isfinite(v).all() and np.any(np.array(v) != 0):
            a = np.array(v, float)
            x[k] = a / np.abs(a).max() / np.linalg.norm(a / np.abs(a).max())
    return [(i, j) for i in x for j in x if j < i and rows[i][2] == rows[j][2] and len(x[i]) == len(x[j]) and x[i] @ x[j] >= cosine]


def test_embeddings_equal_brute_force(spark):
    r = np.random.default_rng(4)
    rows = []
    for _ in range(40):
        base, label = r.normal(size=16), int(r.integers(0, 3))
        for _ in range(int(r.integers(1, 9))):
            rows.append((len(rows), (base + r.normal(size=16) * r.uniform(0, 0.35)).tolist(), label))
    rows += [(1000, None, 1), (1001, [0.0] * 16, 1), (1002, [float("nan")] * 16, 1), (1003, [1.0, None], 1), (1004, [1.0] * 16, None), (1005, [], 1), (1006, [1e300] * 16, 1), (1007, [1.0] * 16, 1), (1008, [1.0] * 16, 1)]
    rows += [(1009, [2.0] * 16, 2), (1010, [1.0, 1.0], 2)]
    data = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("n_links", F.lit(0))
    got = {x.vec_id: x for x in embedding_dedup.near_duplicates(data).collect()}
    pairs = brute_links(rows)
    links = np.bincount(np.array(pairs).ravel(), minlength=len(rows))
    want = closure(len(rows), pairs)
    hit = sum(got[rows[k][0]].n_links for k in range(len(rows)))
    assert 0.97 * links.sum() <= hit <= links.sum()
    if hit == links.sum():
        assert [got[rows[k][0]].component_id for k in range(len(rows))] == [rows[c][0] for c in want]
    assert all(x.kept == (x.vec_id == x.component_id) for x in got.values())
    assert embedding_dedup.near_duplicates(data.where("false")).count() == 0


def test_recall_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 32)
    monkeypatch.setattr(embedding_dedup, "SALTED", 3)
    r = np.random.default_rng(7)
    x = r.normal(size=(600, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    side = r.normal(size=x.shape)
    side -= (side * x).sum(1, keepdims=True) * x
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    y = 0.9301 * x + np.sqrt(1 - 0.9301**2) * side
    rows = [(i, v.tolist(), [1.2, 1.7][i % 2]) for i, v in enumerate(x)] + [(1000 + i, v.tolist(), [1.2, 1.7][(i + (i > 500)) % 2]) for i, v in enumerate(y)]
    got = {v.vec_id: v.n_links for v in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label double")).collect()}
    links = np.bincount(np.array(brute_links(rows)).ravel(), minlength=len(rows))
    assert links.sum() >= 1000 and 0.99 * links.sum() <= sum(got.values()) <= links.sum()
    assert all(got[i] <= n for (i, *_), n in zip(rows, links))


def test_collisions_are_counted():
    r = np.random.default_rng(5)
    q, v = r.normal(size=(20, 7)), r.normal(size=(30, 7))
    order = np.argsort(v, axis=0)
    got = embedding_dedup.collisions(q, np.take_along_axis(v, order, 0), order, 0.5)
    assert (got == (np.abs(q[:, None] - v[None]) <= 0.5).sum(2)).all()


def test_recall_at_the_threshold():
    r = np.random.default_rng(6)
    x = r.normal(size=(600, 48))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    side = r.normal(size=x.shape)
    side -= (side * x).sum(1, keepdims=True) * x
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    y = 0.9301 * x + np.sqrt(1 - 0.9301**2) * side
    i, j = embedding_dedup.linked(x, y, 0.93, False)
    assert (i == j).sum() >= 0.98 * len(x)


# the pipeline


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    r = random.Random(12)
    vocabulary = {"en": ["the", "thing", "other", "with", "that"], "de": ["der", "nicht", "schön", "und", "auch"]}
    rows, labels = [], []
    for i in range(240):
        lang = ("en", "de")[i % 2]
        bad = ["idiot", "trash"] if i % 12 == 0 else []
        t = " ".join(r.choice(vocabulary[lang] + [f"{lang}{r.randrange(400)}"] * 2 + bad * 3) for _ in range(60))
        rows.append((i, t, lang, "src", len(t)))
        labels.append((i, 1, int(bool(bad))))
    rows += [(300, rows[3][1] + " more", "en", "s", 1), (301, rows[3][1], "en", "s", 1), (302, None, "en", "s", 0), (303, "12 34 !!", "en", "s", 8), (304, rows[5][1] + " mail jo@ex.com now", "de", "s", 1), (None, rows[7][1], "de", None, None)]
    rows.append(rows[9])
    folder = tmp_path_factory.mktemp("corpus")
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("score", F.lit(3))
    docs.write.parquet(str(folder / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(folder / "labels.parquet"))
    return str(folder)


def test_pipeline_equals_plain_stages(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    columns, state = docs.columns, docs
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        state = stage(spark, state, corpus).persist()
        out[name] = state.collect()
        if name != "tokens":
            assert state.columns == columns
    texts = lambda name: sorted(str(r.text) for r in out[name])
    every = [r for r in docs.collect()]
    assert texts("language") == sorted(r.text for r in every if r.text and r.text != "12 34 !!")
    kept = [r for r in every if r.text and r.text != "12 34 !!"]
    group, _ = jaccard_components([r.text for r in kept], corpus_pipeline.SIMILARITY, corpus_pipeline.SHINGLE)
    least = {}
    for r, g in zip(kept, group):
        least[g] = min(least.get(g, (True, 0)), (r.doc_id is None, r.doc_id or 0))
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in out["near duplicates"]) == sorted(least.values())
    assert not any("jo@ex.com" in r.text for r in out["personal data"]) and len(out["personal data"]) == len(out["near duplicates"])
    assert all(r.n_chars == len(r.text) for r in out["personal data"])
    mixed = {r.doc_id for r in out["mixture"]}
    clean = {r.doc_id for r in out["personal data"] if "idiot" not in r.text and "trash" not in r.text}
    assert clean <= mixed and len(mixed - clean) < 20
    assert sorted(r.doc_id for r in out["tokens"] if r.doc_id is not None) == sorted(r.doc_id for r in out["mixture"] if r.doc_id is not None)
    assert sorted(map(str, out["tokens"])) == sorted(map(str, corpus_pipeline.run(spark, corpus).collect()))


def test_mixture_meets_token_shares(spark, tmp_path):
    r = random.Random(3)
    kinds = (["good", "fine", "clear"], ["spam", "click", "buy"], ["awful", "idiot", "trash"])
    kind = [r.choices(range(3), (77, 11, 12))[0] for _ in range(4000)]
    docs = spark.createDataFrame([(i, " ".join(r.choice(kinds[k] + ["the", "a", "of"]) for _ in range(30))) for i, k in enumerate(kind)], "doc_id long, text string")
    spark.createDataFrame([(i, int(k != 1), int(k == 2)) for i, k in enumerate(kind)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    kept = [kind[x.doc_id] for x in corpus_pipeline.mix(spark, docs, str(tmp_path)).collect()]
    assert np.bincount(kept, minlength=3) / len(kept) == pytest.approx([0.93, 0.04, 0.03], abs=0.012)


def test_rows_are_numbered_by_their_files(spark, corpus, tmp_path):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    docs.repartition(3, "doc_id").write.parquet(str(tmp_path / "many"))
    for frame in (spark.read.parquet(str(tmp_path / "many")), docs.persist()):
        rows = [tuple(r) for r in corpus_pipeline.numbered(frame).orderBy(corpus_pipeline.ROW).collect()]
        assert len({r[-1] for r in rows}) == len(rows) == docs.count()
        assert rows == [tuple(r) for r in corpus_pipeline.numbered(frame).orderBy(corpus_pipeline.ROW).collect()]
        assert sorted(str(r[:-1]) for r in rows) == sorted(str(tuple(r)) for r in docs.collect())


def test_short_texts_of_a_language_stay(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    short = spark.createDataFrame([(900, "the new thing", "en", "s", 13, 3), (901, "und schön", "de", "s", 9, 3)], docs.schema)
    assert {r.doc_id for r in corpus_pipeline.keep_languages(spark, docs.union(short), corpus).collect()} >= {900, 901}


def test_stages_take_empty_tables(spark, corpus):
    none = spark.read.parquet(f"{corpus}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, corpus).count() == 0
