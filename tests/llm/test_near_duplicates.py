"""The n-gram join and the cap filters against brute force."""

import random
import re

import numpy as np

from lakeweave.llm import cap_filters, ngram_join


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


class Union:
    def __init__(self, ids):
        self.up = {i: i for i in ids}

    def root(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)


def expected(texts):
    sets, u, ids = {k: shingles(t) for k, t in texts.items()}, Union(texts), list(texts)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                u.join(a, b)
    return {k: (len(sets[k]), u.root(k)) for k in texts}


def edited(rng, text, n):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
    return " ".join(w)


def corpus(prose):
    rng, texts = random.Random(2), {}

    def add(t):
        texts[len(texts) * 7 % 10_007] = t

    base, passage = prose(150, 5000), prose(60, 5000)
    for _ in range(90):  # near copies of one text, most of them no link of one another: frequent shingles
        add(edited(rng, base, rng.randint(1, 6)))
    for _ in range(50):  # a passage that many documents share
        add(f"{prose(rng.randint(5, 80), 5000)} {passage} {prose(rng.randint(0, 20), 5000)}")
    for n in (5, 6, 9, 12, 15, 16, 17, 30, 64, 70, 300):  # small sets, and sets at the edges of size classes
        t = prose(n, 5000)
        for k in (0, 0, 1, 2):
            add(edited(rng, t, k).upper() if k == 0 else edited(rng, t, k))
        add(t + " " + prose(max(1, n // 4), 5000))
    small = prose(12, 5000)
    for _ in range(45):  # many near copies of a small text: frequent tokens alone
        add(edited(rng, small, 1) if rng.random() < 0.8 else small + f" t{rng.randrange(99)}")
    for t in (None, "", " \n", "a b", "A  b", "a b c d", "x " * 500):
        add(t)
    return texts


def test_join_is_brute_force(spark, prose):
    texts = corpus(prose)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.similar(docs).collect()}
    want = expected(texts)
    assert found == want and len({c for _, c in want.values()}) < len(texts) - 80


def test_join_cases(spark, odd_docs):
    found = sorted(ngram_join.similar(odd_docs).collect(), key=str)
    assert len(found) == 9
    by = {r["doc_id"]: r for r in found}
    assert [by[k]["n_shingles"] for k in (1, 2, 3, 4, 5, 6)] == [0, 0, 0, 1, 1, 1] and all(by[k]["component_id"] == k for k in range(1, 8))
    assert by[None]["component_id"] is None and by[None]["n_shingles"] == 3
    assert ngram_join.similar(odd_docs.limit(0)).count() == 0
    kept = ngram_join.representatives(odd_docs)
    assert kept.columns == odd_docs.columns and kept.count() == 9


def test_representatives(spark):
    docs = spark.createDataFrame([(9, "a b c d e f", "x"), (3, "A b c d e f", "y"), (5, "other words in this one here", "z"), (None, "a b c d e f", "n")], "doc_id long, text string, _gone string")
    assert sorted(map(str, (r["doc_id"] for r in ngram_join.representatives(docs.withColumnRenamed("_gone", "more")).collect()))) == ["3", "5", "None"]


def clustered(seed=4, dims=24):
    rng, rows = np.random.default_rng(seed), []
    for _ in range(25):
        centre = rng.standard_normal(dims)
        for _ in range(rng.integers(1, 14)):
            v = centre / np.linalg.norm(centre) + rng.standard_normal(dims) * rng.choice([0.02, 0.05, 0.08]) * rng.uniform(0.5, 1.5)
            rows.append((len(rows), (v * rng.uniform(0.1, 9)).astype(np.float32).tolist(), int(rng.integers(0, 2))))
    rows += [(len(rows) + k, rows[0][1], rows[0][2]) for k in range(40)]
    return rows


def test_cap_filters_are_brute_force(spark):
    rows = clustered()
    found = {r["vec_id"]: r for r in cap_filters.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    v = np.array([x for _, x, _ in rows], np.float64)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    label = np.array([y for _, _, y in rows])
    link = (v @ v.T >= 0.93) & (label[:, None] == label[None, :])
    np.fill_diagonal(link, False)
    u = Union(range(len(rows)))
    for a, b in zip(*np.nonzero(link), strict=True):
        u.join(int(a), int(b))
    total = sum(found[k]["n_links"] for k in range(len(rows)))
    assert all(found[k]["n_links"] <= link[k].sum() for k in range(len(rows)))
    assert total >= 0.995 * link.sum() > 1000
    wrong = [k for k in range(len(rows)) if found[k]["component_id"] != u.root(k)]
    assert len(wrong) <= 2 and all(found[k]["kept"] == (found[k]["component_id"] == k) for k in range(len(rows)))


def test_large_filters_are_cut_into_cells(spark, monkeypatch):
    rows = clustered(9)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    whole = sorted(map(tuple, cap_filters.near_duplicates(df).collect()))
    monkeypatch.setattr(cap_filters, "CHUNK", 3)
    assert sorted(map(tuple, cap_filters.near_duplicates(df).collect())) == whole


def test_cap_filter_cases(spark):
    one = [1.0, 0.0, 0.0, 0.0]
    rows = [(1, one, 0), (2, one, 0), (2, one, 0), (3, one, None), (4, None, 0), (5, [0.0] * 4, 0), (6, [float("nan"), 1.0, 0.0, 0.0], 0), (7, [None, 1.0, 0.0, 0.0], 0), (8, [1.0, 0.0], 0), (None, one, 0), (9, [], 0), (10, [-1.0, 0.0, 0.0, 0.0], 0), (11, [2.0, 0.1, 0.0, 0.0], 0), (12, [1.0, 0.0], 0), (13, [float("inf"), 0.0, 0.0, 0.0], 0), (14, [3.0], 0), (15, [2.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "'z' AS vector", "'z' AS print")
    found = cap_filters.near_duplicates(df).collect()
    assert len(found) == len(rows)
    by = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in found}
    assert by[1] == (2, 1, True) and by[2] == (2, 1, False) and by[11] == (2, 1, False) and by[8] == (1, 8, True) and by[12] == (1, 8, False)
    assert by[14] == (1, 14, True) and all(by[k] == (0, k, True) for k in (3, 4, 5, 6, 7, 9, 10, 13)) and by[None] == (0, None, False)
    assert cap_filters.near_duplicates(df.limit(0)).count() == 0
