"""Self-join of documents on the Jaccard similarity of their word shingles, by token-combination prefixes.

A token is a shingle's 64-bit hash. Tokens are ordered: the rare by hash, then the frequent by hash. A set of n tokens
must share at least a = ceil(3n/4) of them with any partner, so two partners share a token among the first n - a + 1 of
each, and k of them among the first n - a + k.

* If the first token that they share is rare, it is in both short prefixes: every rare token there is indexed alone.
  All that they share up to the end of the prefix that ends first lies in both, so the number of tokens found in common
  and the length of the rest bound what they can share; pairs that this bound rules out are not verified.
* If it is frequent, all that they share is frequent, and 1 + C of these lie in prefixes longer by C. The frequent
  tokens fall into C classes by hash, so some class has two of them: every pair of frequent tokens of a class in the
  longer prefix is indexed. C follows the size class of the set (sets near the edge of a class are indexed for both).

Pairs left by rare tokens are verified over their texts. Sets found by combinations of frequent tokens have all their
rare tokens in the short prefix, and share none; so what they share is counted on their frequent tokens alone, exactly,
as a matrix product. Such sets are first grouped (those that share a combination), a group is cut into chunks, and each
pair of chunks is one cell: a group of any size is spread over the tasks, and only links that join components leave a
block of a cell, never all pairs. A combination that many sets share is posted once a batch, with links of the sets
there, so no hot combination comes to one task.

Equal sets are one class from the start. Frequencies are counted over all tokens of all classes; "frequent" is what
more than 32 classes hold, or, where that were over MOST_FREQUENT tokens, the next power of two that keeps them below
it: this table alone is sent to all tasks. Any order gives the same result.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeweave.llm.common import bucketed, drop, dropped, release, shuffle_parts, with_texts, written
from lakeweave.llm.components import components, joined
from lakeweave.llm.text import U64, WHITE, mix, shingle_sets, slices, string_buffers, words_of

WORDS = 5
FREQUENT = 32
MOST_FREQUENT = 1 << 20
SINGLE_CLASSES = 4  # sets of less than 2**4 tokens index frequent tokens alone too
CHUNK = 64
LARGEST = 1 << 14  # sets of a chunk at most
LOW32 = U64(0xFFFFFFFF)


def sets_of(column: pa.Array, k: int = WORDS):
    """The sorted distinct shingle hashes of each row."""
    data, offsets = string_buffers(column)
    for i, j in slices(offsets):
        yield from shingle_sets(words_of(data, offsets[i : j + 1], WHITE), k)


def linked(shared, n_a, n_b):
    """Jaccard of 0.75 or more, in integers: 100 * shared >= 75 * (n_a + n_b - shared)."""
    return 7 * shared >= 3 * (n_a + n_b)


def placed(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Hashes as bucket in the high and place within it in the low 32 bits; the order stays."""
    m = U64(buckets)
    return (hashes >> U64(32)) * m + (((hashes & LOW32) * m) >> U64(32))


def _fingerprints(batches):
    for batch in batches:
        n, prints = [], []
        for s in sets_of(batch.column(1)):
            n.append(len(s))
            prints.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(prints, pa.binary())], names=["doc_id", "n_shingles", "print"])


def _counted(buckets, batches):
    """Of each batch and bucket the distinct tokens, as compressed gaps, and how many sets hold those of several."""
    codec = pa.Codec("zstd", compression_level=1)
    for batch in batches:
        held = list(sets_of(batch.column(1)))
        if not held:
            continue
        tokens = np.sort(placed(np.concatenate(held), buckets))
        del held
        new = np.flatnonzero(np.concatenate(([True], tokens[1:] != tokens[:-1]))) if len(tokens) else np.zeros(0, np.int64)
        counts = np.diff(np.append(new, len(tokens)))
        tokens = tokens[new]
        bucket = (tokens >> U64(32)).astype(np.int64)
        begin = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(tokens) else np.zeros(0, np.int64)
        rows = []
        for a, b in zip(begin.tolist(), [*begin[1:].tolist(), len(tokens)], strict=True) if len(tokens) else ():
            place = (tokens[a:b] & LOW32).astype(np.uint32)
            gaps = np.diff(place, prepend=np.uint32(0)).astype(np.uint32)
            planes = np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, 4).T)
            many = np.flatnonzero(counts[a:b] > 1)
            more = np.column_stack([many, counts[a:b][many]]).astype(np.uint32)
            rows.append((int(bucket[a]), b - a, codec.compress(planes.tobytes(), asbytes=True), more.tobytes()))
        columns = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.binary()), pa.array(columns[3], pa.binary())], names=["bucket", "n", "gaps", "more"])


def _frequent(least, table: pa.Table) -> pa.Table:
    codec = pa.Codec("zstd")
    tokens, counts = [], []
    for n, gaps, more in zip(table["n"].to_pylist(), table["gaps"].to_pylist(), table["more"].to_pylist(), strict=True):
        planes = np.frombuffer(codec.decompress(gaps, decompressed_size=4 * n), np.uint8).reshape(4, n)
        tokens.append(np.cumsum(np.ascontiguousarray(planes.T).view(np.uint32).ravel(), dtype=np.uint32))
        count = np.ones(n, np.int64)
        pairs = np.frombuffer(more, np.uint32).reshape(-1, 2)
        count[pairs[:, 0]] = pairs[:, 1]
        counts.append(count)
    token, count = np.concatenate(tokens), np.concatenate(counts)
    order = np.argsort(token, kind="stable")
    token, count = token[order], count[order]
    begin = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
    total = np.add.reduceat(count, begin)
    keep = total > least
    bucket = table["bucket"][0].as_py()
    return pa.table({"token": pa.array((token[begin][keep].astype(np.int64)) + (bucket << 32), pa.int64()), "n": pa.array(total[keep], pa.int64())})


def least_shared(n):
    """What a set of n tokens shares with any partner at least: ceil(3n/4)."""
    return (3 * n + 3) // 4


def size_class(n: int) -> int:
    return n.bit_length() - 1


def index_keys(tokens: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a sorted set with a mask of its frequent tokens: keys of rare tokens, keys of frequent ones, and these tokens if there are any of the latter."""
    n = len(tokens)
    prefix = n - least_shared(n) + 1
    rare = tokens[~frequent]
    single = rare[:prefix]
    if len(rare) >= prefix or n == 0:
        return single, tokens[:0], tokens[:0]
    many = tokens[frequent]
    keys = []
    for c in {size_class(n), size_class(4 * n // 3)}:
        salt = U64((c + 1) * 0xA24BAED4963EE407 % (1 << 64))
        if c < SINGLE_CLASSES:
            keys.append(mix(many[: prefix - len(rare)] ^ salt))
            continue
        classes = 1 << (c - 3)
        own = many[: prefix - len(rare) + classes]
        group = (own >> U64(9)) % U64(classes)
        order = np.argsort(group, kind="stable")
        own, group = own[order], group[order]
        for d in range(1, len(own)):
            same = group[d:] == group[:-d]
            if not same.any():
                break
            keys.append(mix(own[:-d][same] * U64(0x9FB21C651E98DF25) + own[d:][same] ^ salt))
    return single, np.concatenate(keys) if keys else tokens[:0], many


POSTED = "bucket int, kind int, ids binary, sizes binary, counts binary, keys binary"


def _thinned(row: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the keys of a batch's sets each once, with the first row that has it, and links of rows that share keys: fewer than rows. So a key that most sets have is one posting a batch."""
    order = np.argsort(keys, kind="stable")
    keys, row = keys[order], row[order]
    new = np.concatenate(([True], keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, bool)
    first = row[new][np.cumsum(new) - 1] if len(keys) else row
    other = first != row
    pairs = np.unique(np.column_stack([first[other], row[other]]), axis=0)
    a, b = joined(pairs[:, 0], pairs[:, 1])
    return row[new], keys[new], a, b


def _packed(kind, bucket, docs, sizes, row, keys):
    """One row per bucket: each document once, with its set's size (twice, and one more if frequent tokens are in its prefix) and its number of keys."""
    order = np.lexsort((row, bucket))
    bucket, row, keys = bucket[order], row[order], keys[order]
    begin = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))).tolist() if len(bucket) else []
    for a, b in zip(begin, [*begin[1:], len(bucket)], strict=True) if begin else ():
        own = row[a:b]
        new = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        which = own[new]
        yield int(bucket[a]), kind, docs[which].tobytes(), sizes[which].astype(np.uint32).tobytes(), np.diff(np.append(new, b - a)).astype(np.uint32).tobytes(), keys[a:b].tobytes()


def _posted(buckets, held, batches):
    """Keys of rare tokens (kind 0), keys of frequent ones (1), the frequent tokens of the sets that have such keys (2), and links of sets that share such keys in a batch (3)."""
    frequent = held.value
    for batch in batches:
        docs = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        sets = list(sets_of(batch.column(1)))
        sizes = np.array([len(s) for s in sets], np.int64)
        if not sizes.sum():
            continue
        tokens = np.concatenate(sets)
        del sets
        if len(frequent):
            place = placed(tokens, buckets)
            at = np.searchsorted(frequent, place)
            at[at == len(frequent)] = 0
            mask = frequent[at] == place
            del place, at
        else:
            mask = np.zeros(len(tokens), bool)
        found: tuple[list, list, list] = ([], [], [])
        begin = 0
        for r, n in enumerate(sizes.tolist()):
            for kind, keys in enumerate(index_keys(tokens[begin : begin + n], mask[begin : begin + n])):
                if len(keys):
                    found[kind].append((r, keys))
            begin += n
        del tokens, mask
        sizes *= 2
        sizes[[r for r, _ in found[2]]] += 1
        rows = []
        for kind, own in enumerate(found):
            if own:
                row = np.repeat([r for r, _ in own], [len(k) for _, k in own])
                keys = np.concatenate([k for _, k in own])
                if kind == 1:
                    row, keys, a, b = _thinned(row, keys)
                    a, b = docs[a], docs[b].astype(np.uint64)
                    rows += _packed(3, (mix(a.astype(U64)) % U64(buckets)).astype(np.int64), a, np.zeros(len(a), np.int64), np.arange(len(a)), b)
                if kind < 2:
                    place = placed(keys, buckets)
                    rows += _packed(kind, (place >> U64(32)).astype(np.int64), docs, sizes, row, (place & LOW32).astype(np.uint32))
                else:
                    rows += _packed(kind, (mix(docs[row].astype(U64)) % U64(buckets)).astype(np.int64), docs, sizes, row, keys)
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int32()] * 2 + [pa.binary()] * 4, strict=True)], names=[f.split()[0] for f in POSTED.split(", ")])


def _unpacked(table: pa.Table, kind: int, width) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    own = table.filter(pa.compute.equal(table["kind"], kind))
    join = lambda name, t: np.frombuffer(b"".join(own[name].to_pylist()), t)
    counts = join("counts", np.uint32)
    return np.repeat(join("ids", np.int64), counts), np.repeat(join("sizes", np.uint32), counts).astype(np.int64), join("keys", width)


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    begin = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    length = np.diff(np.append(begin, len(keys)))
    return order, begin[length > 1], length[length > 1]


FOUND = "kind int, a long, b long, n long, least long, tokens binary"


def _found(table: pa.Table) -> pa.Table:
    """Pairs that share rare keys, with how many here and how many they must share in all (kind 0), links to the first set with the same key of frequent tokens (1), and sets with their frequent tokens (2)."""
    ids, sizes, keys = _unpacked(table, 0, np.uint32)
    order, begin, length = _runs(keys)
    some = []
    for m in np.unique(length).tolist():
        runs = begin[length == m]
        for k in range(1, m):
            for part in np.array_split(runs, max(1, len(runs) * (m - k) // 200_000)):
                x = (part[:, None] + np.arange(m - k)).ravel()
                p, q = order[x], order[x + k]
                n, o = sizes[p] >> 1, sizes[q] >> 1
                ok = (ids[p] != ids[q]) & (4 * np.minimum(n, o) >= 3 * np.maximum(n, o))
                p, q, n, o = p[ok], q[ok], n[ok], o[ok]
                least = -(-3 * (n + o) // 7) - np.maximum(least_shared(n), least_shared(o)) + 1
                least = np.where(sizes[p] & sizes[q] & 1, 1, np.maximum(least, 1))
                p, q = ids[p], ids[q]
                some.append(np.column_stack([np.minimum(p, q), np.maximum(p, q), least]))
    pairs, many = np.unique(np.concatenate(some), axis=0, return_counts=True) if some else (np.zeros((0, 3), np.int64), np.zeros(0, np.int64))
    ids, sizes, keys = _unpacked(table, 1, np.uint32)
    order, begin, length = _runs(keys)
    near = np.zeros((0, 2), np.int64)
    if len(begin):
        first = np.repeat(begin, length - 1)
        rest = np.arange(len(first)) - np.repeat(np.cumsum(length - 1) - (length - 1), length - 1) + first + 1
        both = np.unique(np.column_stack([ids[order[first]], ids[order[rest]]]), axis=0)
        near = np.column_stack(joined(both[:, 0], both[:, 1]))
    ids, _, keys = _unpacked(table, 3, np.uint64)
    near = np.concatenate([near, np.column_stack([ids, keys.astype(np.int64)])])
    ids, sizes, keys = _unpacked(table, 2, np.uint64)
    new = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1]))) if len(ids) else np.zeros(0, np.int64)
    ends = [*new[1:].tolist(), len(ids)] if len(new) else []
    blobs = [keys[a:b].tobytes() for a, b in zip(new.tolist(), ends, strict=True)]
    kind = np.repeat(np.array([0, 1, 2], np.int32), [len(pairs), len(near), len(new)])
    return pa.table(
        {
            "kind": pa.array(kind),
            "a": pa.array(np.concatenate([pairs[:, 0], near[:, 0], ids[new]]), pa.int64()),
            "b": pa.array(np.concatenate([pairs[:, 1], near[:, 1], ids[new]]), pa.int64()),
            "n": pa.array(np.concatenate([many, np.zeros(len(near), np.int64), sizes[new] >> 1]), pa.int64()),
            "least": pa.array(np.concatenate([pairs[:, 2], np.zeros(len(near) + len(new), np.int64)]), pa.int64()),
            "tokens": pa.array([None] * (len(pairs) + len(near)) + blobs, pa.binary()),
        }
    )


LINKS = "a long, b long"


def _cell(table: pa.Table) -> pa.Table:
    """The links between two chunks of a group (or within one), thinned to those that join components."""
    i, j = table["i"][0].as_py(), table["j"][0].as_py()
    ids, n, chunk = table["doc_id"].to_numpy(), table["n"].to_numpy(), table["chunk"].to_numpy()
    tokens = [np.frombuffer(x, np.uint64) for x in table["tokens"].to_pylist()]
    sides = [np.flatnonzero(chunk == i), np.flatnonzero(chunk == j)]
    distinct, column = np.unique(np.concatenate(tokens), return_inverse=True)
    row = np.repeat(np.arange(len(tokens)), [len(t) for t in tokens])
    shared_columns = np.flatnonzero(np.bincount(column, minlength=len(distinct)) > 1)
    number = np.full(len(distinct), -1)
    number[shared_columns] = np.arange(len(shared_columns))
    column = number[column]
    a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for x in np.array_split(sides[0], -(-len(sides[0]) // 1024) or 1):
        for y in np.array_split(sides[1], -(-len(sides[1]) // 1024) or 1):
            shared = np.zeros((len(x), len(y)), np.float32)
            place_x, place_y = np.full(len(tokens), -1), np.full(len(tokens), -1)
            place_x[x], place_y[y] = np.arange(len(x)), np.arange(len(y))
            for k in range(0, len(shared_columns), 4096):
                inside = (column >= k) & (column < k + 4096)
                left, right = inside & (place_x[row] >= 0), inside & (place_y[row] >= 0)
                width = min(4096, len(shared_columns) - k)
                m, o = np.zeros((len(x), width), np.float32), np.zeros((len(y), width), np.float32)
                m[place_x[row[left]], column[left] - k] = 1
                o[place_y[row[right]], column[right] - k] = 1
                shared += m @ o.T
            p, q = np.nonzero(linked(shared.astype(np.int64), n[x][:, None], n[y][None, :]))
            p, q = x[p], y[q]
            ok = ids[p] < ids[q] if i == j else ids[p] != ids[q]
            a, b = joined(np.concatenate([a, ids[p[ok]]]), np.concatenate([b, ids[q[ok]]]))
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _verified(k, batches):
    for batch in batches:
        a, b = [], []
        for x, y, s, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), sets_of(batch.column(2), k), sets_of(batch.column(3), k), strict=True):
            if linked(len(np.intersect1d(s, t, assume_unique=True)), len(s), len(t)):
                a.append(x)
                b.append(y)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def class_links(texts: DataFrame) -> DataFrame:
    """Links between documents of different sets (doc_id, text; one document of each set), enough of them to join all that are connected; those by rare tokens are all there."""
    spark = texts.sparkSession
    parts = shuffle_parts(spark)
    buckets = min(4 * parts, 1 << 16)
    counted = texts.mapInArrow(lambda batches: _counted(buckets, batches), "bucket int, n int, gaps binary, more binary")
    totals = written(counted.groupBy("bucket").applyInArrow(lambda table: _frequent(FREQUENT, table), "token long, n long"), "frequent")
    release(spark)
    steps = [FREQUENT << k for k in range(40)]
    above = totals.agg(*(F.count_if(F.col("n") > s).alias(f"s{k}") for k, s in enumerate(steps))).first()
    bound = next(s for k, s in enumerate(steps) if above[f"s{k}"] <= MOST_FREQUENT)
    frequent = np.sort(np.array([r["token"] for r in totals.where(F.col("n") > bound).select("token").toLocalIterator()], np.int64)).astype(U64)
    held = spark.sparkContext.broadcast(frequent)
    posted = texts.mapInArrow(lambda batches: _posted(buckets, held, batches), POSTED)
    found = written(posted.groupBy("bucket").applyInArrow(_found, FOUND), "found")
    release(spark)

    groups = components(found.where("kind = 1").select("a", "b"))
    most = math.ceil(math.sqrt(8 * parts))
    spread = F.least(F.lit(most), F.ceil(F.count("*") / CHUNK))  # over all tasks, and so that no chunk holds over LARGEST sets
    sizes = written(groups.groupBy("component").agg(F.greatest(spread, F.ceil(F.count("*") / LARGEST)).cast("int").alias("chunks")), "sizes")
    sets = written(found.where("kind = 2").select(F.col("a").alias("node"), "n", "tokens").join(groups, "node"), "sets")
    cells = (
        sets.join(sizes, "component")
        .select("component", F.col("node").alias("doc_id"), "n", "tokens", F.pmod(F.xxhash64("node"), "chunks").cast("int").alias("chunk"), "chunks")
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .select("component", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "chunk", "doc_id", "n", "tokens")
    )
    by_frequent = written(cells.groupBy("component", "i", "j").applyInArrow(_cell, LINKS), "links")

    pairs = written(found.where("kind = 0").groupBy("a", "b").agg(F.sum("n").alias("n"), F.max("least").alias("least")).where("n >= least").select("a", "b"), "pairs")
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b").select("a", "b", "text_a", "text_b")
    by_rare = written(both.mapInArrow(lambda batches: _verified(WORDS, batches), LINKS), "links")
    drop(totals, found, groups, sizes, sets, pairs)
    release(spark)
    return by_frequent.unionByName(by_rare)


def similar(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """One row per document: the size of its shingle set and the smallest id of those that links lead to.

    Words are runs of anything but space and \\x09-\\x0D, A-Z as a-z; shingles are of five words, a text of fewer words
    is one shingle. Defined cases: a null, empty or blank text has an empty set and links with nothing, not even its
    like; equal sets link; a null id links with nothing and has a null component; repeated rows come out as often as
    they go in; no rows give none. Other columns are not read.
    """
    documents = with_texts(docs, id_col, text_col)
    members = written(documents.mapInArrow(_fingerprints, "doc_id long, n_shingles long, print binary"), "members")
    classes = written(members.where("print is not null and doc_id is not null").groupBy("print").agg(F.min("doc_id").alias("first")), "classes")
    firsts = classes.select(F.col("first").alias("doc_id"))
    texts, name = bucketed(documents.where("doc_id is not null").join(firsts.hint("merge"), "doc_id", "left_semi"), "doc_id")
    try:
        release(docs.sparkSession)
        links = class_links(texts)
    finally:
        dropped(docs.sparkSession, name)
    found = components(links)
    labelled = written(classes.join(found.withColumnRenamed("node", "first"), "first", "left").select("print", F.coalesce("component", "first").alias("component_id")), "labelled")
    none = members.where("print is null or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return members.where("print is not null and doc_id is not null").join(labelled, "print").select("doc_id", "n_shingles", "component_id").unionByName(none)


def representatives(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """The documents that stay if one of each group of linked ones does: the one of smallest id. All columns stay; those with a null id stay too."""
    gone = similar(docs, id_col, text_col).where("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs[id_col].cast("long") == F.col("_gone"), "left_anti")
