"""Near-duplicates among embeddings of equal label by spherical-cap filters.

A filter is a direction on the sphere, and a vector belongs to every filter whose direction it exceeds a threshold
with. The directions form a random product code: the space, turned at random, is cut into two blocks, each with CODEWORDS random
unit vectors, and each pair of codewords is a direction. So the CODEWORDS**2 directions need not be tried one by one: a
vector's filters are list-decoded from its scores with the two codebooks. Vectors of one label and filter are compared
by cosine in double precision; a pair found by several filters counts at the first of them.

Equal vectors of a label are one class from the start. A filter with many vectors is cut into chunks of bounded size, and
each pair of chunks is a cell of its own, so that a group of near-copies of any size is spread over the tasks; its pairs
are compared block by block. A cell puts out counts by vector and links that join its components, never its pairs.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeweave.llm.common import drop, release, shuffle_parts, written
from lakeweave.llm.components import components, joined

LEAST = 0.93
CODEWORDS = 128
THRESHOLD = 2.8  # standard deviations of a random direction's score
HIGHEST = 0.85  # the threshold as a cosine at most, for spaces of few dimensions
FEWEST = 24  # filters of a vector that exceeds fewer: its best ones
SEED = 93
CHUNK = 256
LARGEST = 1 << 15  # vectors of a chunk at most
BLOCK = 1024  # rows and columns of a product
PAIRS_AT_ONCE = 20_000
LINKS_AT_ONCE = 1 << 18

FEW_DIMENSIONS = 8
FEW_DIRECTIONS = 512

_books: dict[tuple[int, int, int], tuple[np.ndarray, np.ndarray]] = {}


def codebooks(dimensions: int, codewords: int = CODEWORDS, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """The codewords of the two blocks, each turned by the same random rotation and as vectors of the whole space.

    A space of few dimensions has no use for a product: its code is one block of FEW_DIRECTIONS directions, and the
    other block has a single word, zero.
    """
    key = (dimensions, codewords, seed)
    if key not in _books:
        rng = np.random.default_rng([seed, dimensions])
        if dimensions < FEW_DIMENSIONS:
            book = rng.standard_normal((FEW_DIRECTIONS, dimensions))
            _books[key] = np.zeros((1, dimensions)), math.sqrt(2) * book / np.linalg.norm(book, axis=1, keepdims=True)
        else:
            turn, books = np.linalg.qr(rng.standard_normal((dimensions, dimensions)))[0], []
            for block in np.array_split(np.arange(dimensions), 2):
                book = rng.standard_normal((codewords, len(block)))
                books.append((book / np.linalg.norm(book, axis=1, keepdims=True)) @ turn[block])
            _books[key] = books[0], books[1]
    return _books[key]


def filters_of(unit: np.ndarray, threshold: float = THRESHOLD, codewords: int = CODEWORDS, seed: int = SEED) -> list[np.ndarray]:
    """Of each unit vector the sorted numbers of the filters that it exceeds, or of its FEWEST best."""
    first, second = codebooks(unit.shape[1], codewords, seed)
    least = math.sqrt(2) * min(threshold / math.sqrt(unit.shape[1]), HIGHEST)
    out = []
    for s, t in zip(unit @ first.T, unit @ second.T, strict=True):
        some = np.flatnonzero(s >= least - t.max())
        i, j = np.nonzero(s[some][:, None] + t[None, :] >= least)
        found = some[i] * len(t) + j
        if len(found) < FEWEST:
            found = np.sort(np.argpartition(-(s[:, None] + t[None, :]).ravel(), FEWEST)[:FEWEST])
        out.append(found.astype(np.int32))
    return out


def _members(width, batches):
    """(vec_id, label, print, vector): the vector's bytes and a digest of it and its label, both null if it can't link."""
    for batch in batches:
        lists = batch.column(1)
        offsets = np.frombuffer(lists.buffers()[1], np.int32)[lists.offset : lists.offset + len(lists) + 1] if len(lists) else np.zeros(1, np.int32)
        values = lists.values
        data = values.to_numpy(zero_copy_only=False).astype(width) + width(0)  # a null component is NaN, and -0 is 0
        bad = np.concatenate(([0], np.cumsum(~np.isfinite(data))))
        some = np.concatenate(([0], np.cumsum(data != 0)))
        begin, end = offsets[:-1], offsets[1:]
        ok = (bad[end] == bad[begin]) & (some[end] > some[begin])
        for column in batch.columns:
            ok &= column.is_valid().to_numpy(zero_copy_only=False)
        prints: list[bytes | None] = [None] * len(batch)
        vectors: list[bytes | None] = [None] * len(batch)
        labels = batch.column(2).to_pylist()
        for r in np.flatnonzero(ok).tolist():
            vectors[r] = raw = data[begin[r] : end[r]].tobytes()
            prints[r] = hashlib.blake2b(raw + b"|" + labels[r].encode(), digest_size=16).digest()
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(prints, pa.binary()), pa.array(vectors, pa.binary())], names=["vec_id", "label", "print", "vector"])


def _units(raw: list[bytes], width) -> np.ndarray:
    """Vectors of length one in double precision; shorter ones end in zeros, which no product sees."""
    n = np.array([len(x) for x in raw]) // np.dtype(width).itemsize
    out = np.zeros((len(raw), int(n.max())))
    out[np.arange(out.shape[1]) < n[:, None]] = np.frombuffer(b"".join(raw), width)
    out /= np.abs(out).max(axis=1, keepdims=True)
    out /= np.linalg.norm(out, axis=1, keepdims=True)
    return out


def _decoded(width, threshold, batches):
    for batch in batches:
        raw = batch.column(3).to_pylist()
        size = np.array([len(x) for x in raw])
        found: list = [None] * len(raw)
        for n in np.unique(size).tolist():
            rows = np.flatnonzero(size == n)
            for r, f in zip(rows.tolist(), filters_of(_units([raw[r] for r in rows], width), threshold), strict=True):
                found[r] = f
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(size, pa.int32()), pa.array(found, pa.list_(pa.int32()))], names=["label", "first", "copies", "vector", "size", "filters"])


FOUND = "kind int, a long, b long"


def _cells(width, least, batches):
    """Rows sorted by cell; a cell may go on in the next batch."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if rest is not None:
            table = pa.concat_tables([rest, table])
        cell = table["cell"].to_numpy()
        last = np.flatnonzero(cell[1:] != cell[:-1])
        cut = int(last[-1]) + 1 if len(last) else 0
        rest = table.slice(cut)
        if cut:
            yield from _cell_rows(table.slice(0, cut), width, least)
        if rest.num_rows:
            rest = rest.combine_chunks()
    if rest is not None and rest.num_rows:
        yield from _cell_rows(rest, width, least)


def _filter_bits(lists: pa.Array) -> np.ndarray:
    """Sets of filters as packed bits, a row each; made a few rows at a time."""
    out = np.zeros((len(lists), CODEWORDS * CODEWORDS // 8), np.uint8)
    for k in range(0, len(lists), BLOCK):
        part = lists.slice(k, BLOCK)
        bits = np.zeros((len(part), CODEWORDS * CODEWORDS), bool)
        bits[np.repeat(np.arange(len(part)), np.asarray(part.value_lengths())), part.flatten().to_numpy()] = True
        out[k : k + len(part)] = np.packbits(bits, axis=1)
    return out


def _first_here(bits: np.ndarray, p: np.ndarray, q: np.ndarray, here: np.ndarray) -> np.ndarray:
    """Of pairs of rows, which have the filter that they were found by as the first that they share."""
    first = np.zeros(len(p), bool)
    for k in range(0, len(p), PAIRS_AT_ONCE):
        common = bits[p[k : k + PAIRS_AT_ONCE]] & bits[q[k : k + PAIRS_AT_ONCE]]
        byte = (common != 0).argmax(axis=1)
        lowest = byte * 8 + 8 - np.ceil(np.log2(common[np.arange(len(byte)), byte] + 1.0)).astype(np.int64)
        first[k : k + PAIRS_AT_ONCE] = lowest == here[k : k + PAIRS_AT_ONCE]
    return first


def _cell_rows(table: pa.Table, width, least):
    """Counts and links of whole cells. The products of a large cell are made block by block, and the links of a block thinned before the next."""
    cell, ids, copies = table["cell"].to_numpy(), table["first"].to_numpy(), table["copies"].to_numpy()
    chunk, i, j, here = (table[c].to_numpy() for c in ("chunk", "i", "j", "filter"))
    ends = np.flatnonzero(np.concatenate((cell[1:] != cell[:-1], [True]))) + 1
    begins = np.concatenate(([0], ends[:-1]))
    unit = _units(table["vector"].to_pylist(), width)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    totals, links = np.zeros(len(ids), np.int64), [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    n_found = 0

    def settle():
        """Count the pairs found so far whose first common filter is this one, and thin their links."""
        if not found:
            return
        left, right = (np.concatenate([x[k] for x in found]) for k in (0, 1))
        found.clear()
        used, place = np.unique(np.concatenate([left, right]), return_inverse=True)
        bits = _filter_bits(table["filters"].combine_chunks().take(pa.array(used)))
        first = _first_here(bits, place[: len(left)], place[len(left) :], here[left])
        left, right = left[first], right[first]
        np.add.at(totals, left, copies[right])
        np.add.at(totals, right, copies[left])
        links.append(joined(ids[left], ids[right]))

    for a, b in zip(begins.tolist(), ends.tolist(), strict=True):
        if b - a < 2:
            continue
        same = i[a] == j[a]
        x = np.arange(a, b) if same else a + np.flatnonzero(chunk[a:b] == i[a])
        y = x if same else a + np.flatnonzero(chunk[a:b] == j[a])
        for u in range(0, len(x), BLOCK):
            for v in range(u if same else 0, len(y), BLOCK):
                p, q = np.nonzero(unit[x[u : u + BLOCK]] @ unit[y[v : v + BLOCK]].T >= least)
                p, q = x[p + u], y[q + v]
                ok = p < q if same else p != q
                if ok.any():
                    found.append((p[ok], q[ok]))
                    n_found += int(ok.sum())
                if n_found >= LINKS_AT_ONCE:
                    settle()
                    n_found = 0
    settle()
    some = np.flatnonzero(totals)
    if not len(some):
        return
    vertices, at = np.unique(ids[some], return_inverse=True)
    sums = np.bincount(at, weights=totals[some]).astype(np.int64)
    left, right = joined(np.concatenate([x for x, _ in links]), np.concatenate([x for _, x in links]))
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(np.repeat(np.array([0, 1], np.int32), [len(vertices), len(left)])),
            pa.array(np.concatenate([vertices, left])),
            pa.array(np.concatenate([sums, right])),
        ],
        names=["kind", "a", "b"],
    )


def near_duplicates(vectors: DataFrame, id_col="vec_id", vector_col="embedding", label_col="label", least: float = LEAST, threshold: float = THRESHOLD) -> DataFrame:
    """One row per vector: how many others it links with, the smallest vector that links lead to, and whether it is that.

    Defined cases: a vector that is null, empty or zero or holds a null or non-finite component, or whose label is
    null, links with nothing; nor do vectors of different length; equal vectors of a label link; a null id links with
    nothing and is not kept; a row that is repeated is one vector and comes out as often; no rows give none. Other
    columns are not read.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[vector_col].dataType
    single = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)
    width = np.float32 if single else np.float64
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<float>" if single else "array<double>").alias("v"), F.col(label_col).cast("string").alias("label"))
    members = written(rows.mapInArrow(lambda batches: _members(width, batches), "vec_id long, label string, print binary, vector binary"), "members")
    linkable = members.where("print is not null").distinct()
    classes = written(linkable.groupBy("print").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("vector").alias("vector")), "classes")
    decoded = classes.select("label", "first", "copies", "vector").mapInArrow(lambda batches: _decoded(width, threshold, batches), "label string, first long, copies long, vector binary, size int, filters array<int>")
    decoded = written(decoded, "decoded")
    parts = shuffle_parts(spark)
    postings = decoded.select("*", F.explode("filters").alias("filter"))
    # As many chunks as spread a filter over all tasks, and more where a chunk would hold over LARGEST vectors.
    spread = F.least(F.lit(math.ceil(math.sqrt(8 * parts))), F.ceil(F.col("n") / CHUNK))
    chunks = F.greatest(spread, F.ceil(F.col("n") / LARGEST)).cast("int")
    large = written(postings.groupBy("label", "size", "filter").agg(F.count("*").alias("n")).where(F.col("n") > CHUNK).select("label", "size", "filter", chunks.alias("chunks")), "large")
    cells = (
        postings.join(large, ["label", "size", "filter"], "left")
        .withColumn("chunks", F.coalesce("chunks", F.lit(1)))
        .withColumn("chunk", F.pmod(F.xxhash64("first"), "chunks").cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .withColumns({"i": F.least("chunk", "other"), "j": F.greatest("chunk", "other")})
        .withColumn("cell", F.xxhash64("label", "size", "filter", "i", "j"))
        .select("cell", "filter", "chunk", "i", "j", "first", "copies", "vector", "filters")
        .repartition(parts, "cell")
        .sortWithinPartitions("cell")
    )
    found = written(cells.mapInArrow(lambda batches: _cells(width, least, batches), FOUND), "found")
    drop(decoded, large)
    release(spark)
    groups = components(found.where("kind = 1").select("a", "b"))
    counts = found.where("kind = 0").groupBy("a").agg(F.sum("b").alias("others"))
    labelled = written(
        classes.select("print", "first", "copies")
        .join(counts.withColumnRenamed("a", "first"), "first", "left")
        .join(groups.withColumnRenamed("node", "first"), "first", "left")
        .select("print", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "first").alias("component_id")),
        "labelled",
    )
    drop(found, classes, groups)
    alone = members.where("print is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = members.where("print is not null").join(labelled, "print").select("vec_id", "n_links", "component_id").unionByName(alone)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
