import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from lakeweave.llm import components as c
from lakeweave.llm import text as t


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB \n\tçZ1|", max_size=30)), max_size=8))
def test_words_are_those_of_the_pattern(texts):
    data, offsets = t.string_buffers(pa.array(texts, pa.string()))
    words = t.words_of(data, offsets, t.WHITE)
    own = data[offsets[0] : offsets[-1]].tobytes()
    found = [[own[a:b].decode() for a, b, r in zip(words.starts, words.ends, words.row, strict=True) if r == k] for k in range(len(texts))]
    assert found == [re.findall(r"[^\x20\x09-\x0D]+", x or "") for x in texts]
    low = lambda w: "".join(chr(ord(ch) + 32) if "A" <= ch <= "Z" else ch for ch in w)
    same = {}
    for w, h in zip((w for x in found for w in x), words.hashes.tolist(), strict=True):
        assert same.setdefault(low(w), h) == h
    assert len(set(same.values())) == len(same)


def test_shingles_of_short_texts_and_repeats():
    data, offsets = t.string_buffers(pa.array(["a b c", "a b c", "a b", "", None, "a b c d e", "a b c d e a b c d e a b c d e"]))
    sets = list(t.shingle_sets(t.words_of(data, offsets, t.WHITE), 5))
    assert [len(s) for s in sets] == [1, 1, 1, 0, 0, 1, 5]
    assert sets[0] == sets[1] != sets[2] and sets[5][0] in sets[6]


def test_slices_cover_all_rows():
    offsets = np.array([0, 5, 5, 30, 31, 32, 32])
    assert list(t.slices(offsets, 10)) == [(0, 2), (2, 3), (3, 6)]


def test_components(spark):
    path = [(k, k + 1) for k in range(40)]
    given = [*path, (100, 7), (7, 100), (200, 201), (300, 300), (None, 1)] + [(500, k) for k in range(501, 560)]
    found = {r["node"]: r["component"] for r in c.components(spark.createDataFrame(given, "a long, b long")).collect()}
    assert {found[k] for k in [*range(41), 100]} == {0} and found[201] == 200 and {found[k] for k in range(500, 560)} == {500} and 300 not in found
    assert c.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_joined_joins_what_links_join():
    rng = np.random.default_rng(3)
    for n, m in ((0, 1), (5, 4), (400, 300), (3000, 900), (5000, 60)):
        a, b = rng.integers(0, m, n), rng.integers(0, m, n)
        x, y = c.joined(a, b)
        parent = list(range(m))

        def root(k, parent=parent):
            while parent[k] != k:
                k = parent[k]
            return k

        for p, q in zip(a.tolist(), b.tolist(), strict=True):
            p, q = sorted((root(p), root(q)))
            parent[q] = p
        assert len(x) <= max(0, m - 1) and sorted(zip(x.tolist(), y.tolist(), strict=True)) == sorted((root(k), k) for k in range(m) if root(k) != k)
    line = np.arange(5000)
    x, y = c.joined(line[1:], line[:-1])
    assert (x == 0).all() and len(y) == 4999
