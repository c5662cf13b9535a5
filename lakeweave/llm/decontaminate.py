"""Benchmark decontamination by a distributed positional inverted index.

build_index() stores the training tokens as postings: each task turns slices of documents into index shards, that is,
for every term (hash of a word) of the slice the sorted positions at which it stands there. The stored lists are first
asked how often each term of the benchmark occurs in the corpus; a window with a term that never occurs is done with,
and each other window is filed under its rarest term. In a shard only windows are looked at whose rarest term has a list
there: that list is shifted by the term's offset in the window and intersected with the other terms' shifted lists, from
the rarer to the more frequent. Shards follow the documents, so nothing is shuffled, a hot source or term adds shards
rather than a long list in one task, and a lost executor only costs the shards it held. The stored index can be
searched for any benchmark; the function that carries documents along indexes their slices in passing instead.

The benchmark (not the corpus) goes to the tasks: in blocks of at most BLOCK_BYTES of windows, as many blocks as it
needs. A task holds one block at a time, and searches a group of shards for it before it loads the next.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeweave.llm.common import carried, with_texts, written
from lakeweave.llm.text import NOT_WORD, slices, string_buffers, word_hashes, words_of

WINDOW = 10
BLOCK_BYTES = 64 << 20  # of one broadcast block of windows
SHARD_BYTES = 2 << 20  # of the texts of a shard, or one text
GROUP_WORDS = 8 << 20  # of the shards that a task searches for one block before the next, where there are several
INDEX = "doc_ids array<long>, first binary, terms binary, counts binary, positions binary"

DIGEST = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
MATCHES = "doc_id long, item_id string, start_word long, n_words long, exact boolean"


@dataclass
class Phrases:
    """Windows by length, each filed under its rarest term, with the item of each."""

    terms: np.ndarray  # sorted hashes of all terms of the block
    windows: list[tuple[np.ndarray, np.ndarray, np.ndarray]]  # (windows x length of term numbers, item numbers, key terms), sorted by key term
    items: list[str]

    def filed(self, counts: np.ndarray) -> Phrases:
        """Under the rarest term by these counts of a corpus, less the windows with a term that it doesn't have."""
        out = []
        for windows, owner, _ in self.windows:
            of_terms = counts[windows]
            alive = np.flatnonzero(of_terms.min(axis=1) > 0)
            if len(alive):
                key = windows[alive, of_terms[alive].argmin(axis=1)]
                order = np.argsort(key, kind="stable")
                out.append((windows[alive][order], owner[alive][order], key[order]))
        return Phrases(self.terms, out, self.items)


def phrases(rows: list[tuple[str, str]], window: int) -> Phrases:
    """The windows of some items, filed under the term that is rarest among them."""
    names = sorted({i for i, _ in rows})
    number = {x: k for k, x in enumerate(names)}
    by_length: dict[int, list[np.ndarray]] = {}
    owner: dict[int, list[int]] = {}
    for item, text in rows:
        h = word_hashes(text, NOT_WORD)
        if len(h):
            size = min(window, len(h))
            views = np.lib.stride_tricks.sliding_window_view(h, size)
            by_length.setdefault(size, []).append(views)
            owner.setdefault(size, []).extend([number[item]] * len(views))
    terms, windows, counts = np.zeros(0, np.uint64), [], np.zeros(0, np.int64)
    if by_length:
        terms, counts = np.unique(np.concatenate([v.ravel() for x in by_length.values() for v in x]), return_counts=True)
    for size, views in sorted(by_length.items()):
        numbers = np.searchsorted(terms, np.concatenate(views)).astype(np.int32)
        both = np.unique(np.column_stack([numbers, np.array(owner[size], np.int32)]), axis=0)
        windows.append((both[:, :-1], both[:, -1], both[:, 0]))
    return Phrases(terms, windows, names).filed(counts)


@dataclass
class Lists:
    """Postings of a shard: its documents, the first word of each (and the end), and by term the positions of its words."""

    ids: pa.Array
    first: np.ndarray
    terms: np.ndarray
    counts: np.ndarray
    positions: np.ndarray


class Shard:
    """The lists of a shard for the terms of a block of phrases."""

    def __init__(self, lists: Lists, terms: np.ndarray):
        self.row = np.repeat(np.arange(len(lists.ids)), np.diff(lists.first))
        self.postings, self.term = lists.positions, np.full(len(lists.positions), -1, np.int32)
        self.counts, self.begin = np.zeros(len(terms), np.int64), np.zeros(len(terms), np.int64)
        self.held = np.zeros(0, np.int64)  # the numbers of the terms that have a list here
        if len(terms) and len(lists.terms):
            at = np.searchsorted(lists.terms, terms)
            at[at == len(lists.terms)] = 0
            held = self.held = np.flatnonzero(lists.terms[at] == terms)
            starts = np.cumsum(lists.counts) - lists.counts
            self.counts[held], self.begin[held] = lists.counts[at[held]], starts[at[held]]
            many = self.counts[held]
            into = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
            self.term[self.postings[np.repeat(self.begin[held], many) + into]] = np.repeat(held, many)

    def find(self, windows: np.ndarray, keys: np.ndarray, slop: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(window number, start) of all occurrences; with slop, each term may stand up to so many words off its place."""
        size, total = windows.shape[1], len(self.term)
        begin, end = np.searchsorted(keys, self.held), np.searchsorted(keys, self.held, "right")
        many = end - begin
        looked = np.repeat(begin, many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
        counts = self.counts[windows[looked]]
        some = np.flatnonzero(counts.min(axis=1) > 0) if len(looked) else np.zeros(0, np.int64)
        alive, counts = looked[some], counts[some]
        order = np.argsort(counts, axis=1, kind="stable")
        rarest = order[:, 0] if len(alive) else np.zeros(0, np.int64)
        term = windows[alive, rarest]
        many = self.counts[term]
        which = np.repeat(np.arange(len(alive)), many)
        into = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
        start = self.postings[np.repeat(self.begin[term], many) + into] - rarest[which]
        ok = (start >= 0) & (start + size <= total)
        which, start = which[ok], start[ok]
        same = self.row[start] == self.row[start + size - 1]
        which, start = which[same], start[same]
        for k in range(1, size):
            if not len(start):
                break
            offset = order[which, k]
            want, place = windows[alive[which], offset], start + offset
            hit = self.term[place] == want
            for d in range(1, slop + 1):
                for near in (place - d, place + d):
                    inside = np.clip(near, 0, total - 1)
                    hit |= (near == inside) & (self.term[inside] == want) & (self.row[inside] == self.row[start])
            which, start = which[hit], start[hit]
        return alive[which], start


def item_blocks(items: DataFrame, id_col: str, text_col: str, window: int, block_bytes: int) -> Iterator[Phrases]:
    """Blocks of phrases of bounded size, read from the items a few rows at a time."""
    rows, held, most = [], 0, max(1, block_bytes // (2 * window))
    selected = items.select(items[id_col].cast("string").alias("i"), items[text_col].cast("string").alias("t"))
    for r in selected.dropna().toLocalIterator():
        for piece in pieces(r["t"], window, most):
            rows.append((r["i"], piece))
            held += len(piece) * 2 * window  # about a word each five bytes, and 8 bytes for each word of its window
            if held >= block_bytes:
                yield phrases(rows, window)
                rows, held = [], 0
    yield phrases(rows, window)


def pieces(text: str, window: int, most: int) -> Iterator[str]:
    """An item's text, or, if it has more than `most` characters, pieces of about that size which have every window between them."""
    if len(text) <= most:
        yield text
        return
    words = re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)
    own: deque[tuple[int, int]] = deque()
    new = 0
    for w in words:
        own.append(w.span())
        new += 1
        if own[-1][1] - own[0][0] >= most and len(own) >= window:
            yield text[own[0][0] : own[-1][1]]
            while len(own) > window - 1:
                own.popleft()
            new = 0
    if new:
        yield text[own[0][0] : own[-1][1]]


def _indexed(batch: pa.RecordBatch) -> Iterator[Lists]:
    """The shards of a batch of documents."""
    data, offsets = string_buffers(batch.column(1))
    for i, j in slices(offsets, SHARD_BYTES):
        words = words_of(data, offsets[i : j + 1], NOT_WORD)
        positions = np.argsort(words.hashes, kind="stable")
        sorted_hashes = words.hashes[positions]
        new = np.flatnonzero(np.concatenate(([True], sorted_hashes[1:] != sorted_hashes[:-1]))) if len(positions) else np.zeros(0, np.int64)
        yield Lists(batch.column(0).slice(i, j - i), words.first, sorted_hashes[new], np.diff(np.append(new, len(positions))), positions)


def _stored(batch: pa.RecordBatch) -> Iterator[Lists]:
    """The shards of a batch of stored rows."""
    for k in range(len(batch)):
        ids, (first, terms, counts, positions) = batch.column(0)[k].values, (np.frombuffer(batch.column(c)[k].as_py(), t) for c, t in ((1, np.int64), (2, np.uint64), (3, np.uint32), (4, np.uint32)))
        yield Lists(ids, first, terms, counts.astype(np.int64), positions.astype(np.int64))


def build_index(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """The positional index of all words of all documents, a row for each shard, written to the shared folder. Null texts have no words."""

    def run(batches):
        for batch in batches:
            for x in _indexed(batch):
                blobs = [v.astype(t).tobytes() for v, t in ((x.first, np.int64), (x.terms, np.uint64), (x.counts, np.uint32), (x.positions, np.uint32))]
                yield pa.RecordBatch.from_arrays([pa.array([x.ids.to_pylist()], pa.list_(pa.int64())), *(pa.array([b], pa.binary()) for b in blobs)], names=[f.split()[0] for f in INDEX.split(", ")])

    return written(with_texts(docs, id_col, text_col).mapInArrow(run, INDEX), "index")


def _loaded(blocks) -> Iterator[Phrases]:
    """The blocks one after another; where there are several, each is let go before the next is loaded."""
    for block in blocks:
        yield block.value
        if len(blocks) > 1:
            vars(block).pop("_value", None)


def _groups(blocks, shards, batches) -> Iterator[list[Lists]]:
    """Shards in groups to be searched for one block after another: one at a time for a single block, else some GROUP_WORDS words at a time."""
    group, held = [], 0
    for batch in batches:
        for lists in shards(batch):
            group.append(lists)
            held += len(lists.positions)
            if len(blocks) == 1 or held >= GROUP_WORDS:
                yield group
                group, held = [], 0
    if group:
        yield group


def _digest(blocks, shards, batches):
    for group in _groups(blocks, shards, batches):
        edges = [np.zeros(len(lists.positions) + 1, np.int64) for lists in group]
        found: list[dict[int, set[str]]] = [{} for _ in group]
        for p in _loaded(blocks):
            for k, lists in enumerate(group):
                shard = Shard(lists, p.terms)
                for windows, owner, keys in p.windows:
                    which, start = shard.find(windows, keys)
                    np.add.at(edges[k], start, 1)
                    np.add.at(edges[k], start + windows.shape[1], -1)
                    pairs = np.unique(np.column_stack([shard.row[start], owner[which]]), axis=0)
                    for r, item in pairs.tolist():
                        found[k].setdefault(r, set()).add(p.items[item])
        for lists, edge, own in zip(group, edges, found, strict=True):
            n = len(lists.ids)
            row = np.repeat(np.arange(n), np.diff(lists.first))
            n_hit = np.bincount(row[np.cumsum(edge[:-1]) > 0], minlength=n)
            names = [",".join(sorted(own.get(r, ()))) for r in range(n)]
            yield pa.RecordBatch.from_arrays(
                [
                    lists.ids,
                    pa.array(np.diff(lists.first), pa.int64()),
                    pa.array(n_hit, pa.int64()),
                    pa.array([len(own.get(r, ())) for r in range(n)], pa.int64()),
                    pa.array([hashlib.sha256(x.encode()).hexdigest() for x in names]),
                    pa.array(n_hit > 0),
                ],
                names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
            )


def _matches(blocks, shards, slop, batches):
    for group in _groups(blocks, shards, batches):
        for p in _loaded(blocks):
            for lists in group:
                shard = Shard(lists, p.terms)
                for windows, owner, keys in p.windows:
                    which, start = shard.find(windows, keys, slop)
                    if not len(start):
                        continue
                    exact = (shard.term[start[:, None] + np.arange(windows.shape[1])] == windows[which]).all(axis=1)
                    row = shard.row[start]
                    yield pa.RecordBatch.from_arrays(
                        [lists.ids.take(pa.array(row)), pa.array([p.items[k] for k in owner[which].tolist()]), pa.array(start - lists.first[row], pa.int64()), pa.array(np.full(len(start), windows.shape[1]), pa.int64()), pa.array(exact)],
                        names=["doc_id", "item_id", "start_word", "n_words", "exact"],
                    )


def _corpus_counts(index: DataFrame, block) -> np.ndarray:
    """How often each term of a block stands in the corpus, from the index's lists; so many numbers as the block has terms come to the driver."""

    def run(batches):
        terms = block.value.terms
        total = np.zeros(len(terms), np.int64)
        for batch in batches:
            for own, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own, counts = np.frombuffer(own, np.uint64), np.frombuffer(counts, np.uint32)
                if len(own) and len(terms):
                    at = np.searchsorted(own, terms)
                    at[at == len(own)] = 0
                    held = own[at] == terms
                    total[held] += counts[at[held]]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["term", "n"])

    out = np.zeros(len(block.value.terms), np.int64)
    for r in index.select("terms", "counts").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        out[r["term"]] = r["n"]
    return out


def _blocks(df: DataFrame, items: DataFrame, item_col, item_text_col, window, block_bytes, index: DataFrame | None = None) -> list:
    """The benchmark's blocks, broadcast; with an index, filed by the rarest term of the corpus."""
    sc = df.sparkSession.sparkContext
    out = []
    for p in item_blocks(items, item_col, item_text_col, window, block_bytes):
        block = sc.broadcast(p)
        if index is not None:
            filed = p.filed(_corpus_counts(index, block))
            block.unpersist()
            block = sc.broadcast(filed)
        out.append(block)
    return out


def contamination(docs: DataFrame, items: DataFrame, id_col="doc_id", text_col="text", item_col="item_id", item_text_col="text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: how many of its words lie inside an occurrence of any window of an item.

    A window is `window` consecutive item words; an item of fewer words is one window, one without words has none.
    Defined cases: a null or empty text has no words; an item whose id or text is null is ignored; repeated items and
    repeated documents count as they stand, items once by id; a null id stays null; no items or no documents: nothing
    is contaminated, no rows. Other columns are not read.
    """
    index = build_index(docs, id_col, text_col)
    blocks = _blocks(docs, items, item_col, item_text_col, window, block_bytes, index)
    return index.mapInArrow(lambda batches: _digest(blocks, _stored, batches), DIGEST)


def clean(docs: DataFrame, items: DataFrame, text_col="text", item_col="item_id", item_text_col="text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents that contamination() finds clean, with all their columns; cases as there."""
    blocks = _blocks(docs, items, item_col, item_text_col, window, block_bytes)
    return carried(docs, [docs[text_col].cast("string")], lambda batches: _digest(blocks, _indexed, batches), lambda own, found: own.filter(pc.invert(found["contaminated"])))


def matches(index: DataFrame, items: DataFrame, slop: int = 0, item_col="item_id", item_text_col="text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Every occurrence in an index of build_index() as (document, item, first word, words, exact).

    With slop > 0 proximity matches come too: the terms other than the rarest may each stand up to `slop` words off
    their place; `exact` tells the phrases from these. Items as in contamination().
    """
    blocks = _blocks(index, items, item_col, item_text_col, window, block_bytes, index)
    return index.mapInArrow(lambda batches: _matches(blocks, _stored, slop, batches), MATCHES)
