"""Quality classifier by co-training of two views.

The text view sees what stands in a document: shares of kinds of bytes and words, repetition, and its hashed words. The
metadata view sees its columns: hashed categories, numbers by their order of magnitude. Each view has a logistic
regression, fitted first on a labelled sample: LABELLED documents, those of least hash of their id, which is a random
choice that doesn't depend on the partitions. Then, in each round, both views score all documents on the cluster, and
each labels for the other those that it is sure of, however many these are. The pseudo-labelled documents stay where
they are: their loss goes into the next fit as its slope and curvature at the present weights, summed as integers, so
a round costs one pass and the driver gets a few thousand numbers. At last both views are calibrated on a quarter of the
labelled sample, whose labels neither has learned from, and the weights with which their calibrated log-odds combine are
fitted there too. All documents are scored in one pass.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeweave.llm.common import carried, quoted
from lakeweave.llm.text import U64, WHITE, slices, string_buffers, words_of

LABELLED = 6_000
ROUNDS = 3
CONFIDENT = 0.95
PSEUDO = 0.5  # the weight of a class's pseudo-labels beside that of its labels
NEAR = 0.05  # curvature added to a pseudo-loss, which is known near the present weights only
GRID = 1 << 24  # sums over documents are of multiples of its inverse
CALIBRATE = 4  # one labelled document in so many is for calibration
WORD_BUCKETS = 2048
META_BUCKETS = 512
THRESHOLD = 0.2  # of good quality: a document goes only if the views are 80 % sure that it is bad
STEPS = 150
FARTHEST = 4.0  # standard deviations; what lies farther off counts as that far, so that no single odd feature decides
KINDS = np.zeros((5, 256), bool)  # upper case, digits, marks, table bars, ends of sentences
KINDS[0, 65:91] = KINDS[1, 48:58] = True
KINDS[2, [35, 36, 37, 38, 42, 33, 64, 94, 126]] = True
KINDS[3, 124] = True
KINDS[4, [44, 46, 59, 58, 63]] = True
KIND_OF = (KINDS * np.arange(1, 6)[:, None]).sum(axis=0).astype(np.int64)
SCORED = "doc_id long, text_prob double, meta_prob double, score double, keep boolean"


def text_features(column: pa.Array):
    """Of each row of a slice its dense features, and its hashed words as (row, bucket), distinct."""
    data, offsets = string_buffers(column)
    for i, j in slices(offsets):
        words, n = words_of(data, offsets[i : j + 1], WHITE), j - i
        own, size = data[offsets[i] : offsets[j]], np.diff(offsets[i : j + 1])
        row = np.repeat(np.arange(n), size)
        kinds = np.bincount(row * 6 + KIND_OF[own], minlength=6 * n).reshape(n, 6)[:, 1:]
        breaks = np.bincount(row[own == 10], minlength=n)
        count = np.diff(words.first)
        per = np.maximum(count, 1).astype(np.float64)
        h = words.hashes
        pairs = np.zeros(0, np.int64)
        same = np.zeros(n)
        if len(h):
            key = words.row.astype(U64) * U64(0x9E3779B97F4A7C15) + h
            distinct, first = np.unique(key, return_index=True)
            kinds_of_words = np.bincount(words.row[first], minlength=n)
            again = (h[1:] == h[:-1]) & (words.row[1:] == words.row[:-1])
            same = np.bincount(words.row[1:][again], minlength=n)
            last = own[words.ends - 1]
            marked = np.bincount(words.row[KINDS[2][last]], minlength=n)
            upper = np.bincount(words.row[KINDS[0][own[words.starts]] & KINDS[0][own[np.minimum(words.starts + 1, words.ends - 1)]] & (words.ends - words.starts > 1)], minlength=n)
            bars = np.bincount(words.row[KINDS[3][last]], minlength=n)
            mean = np.bincount(words.row, weights=words.ends - words.starts, minlength=n)
            bucket = (h[first] >> U64(48)).astype(np.int64) % WORD_BUCKETS
            pairs = np.unique(words.row[first].astype(np.int64) * WORD_BUCKETS + bucket)
        else:
            kinds_of_words = marked = upper = bars = mean = np.zeros(n)
        long = np.maximum(size, 1).astype(np.float64)
        share = kinds / long[:, None]
        dense = np.column_stack([
            np.ones(n), np.log1p(count), np.log1p(size), share, breaks / per, kinds_of_words / per, np.log(np.maximum(kinds_of_words, 1) / per),
            same / per, marked / per, upper / per, bars / per, mean / per / 10, count == 0,
        ])
        yield i, j, dense, pairs


@dataclass
class View:
    """A fitted logistic regression: dense weights on scaled features, and weights of hashed ones."""

    centre: np.ndarray
    scale: np.ndarray
    dense: np.ndarray
    hashed: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def margin(self, dense: np.ndarray, row: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        n = len(dense)
        counts = np.bincount(row, minlength=n)
        total = np.bincount(row, weights=self.hashed[bucket], minlength=n) / np.sqrt(np.maximum(counts, 1))
        return scaled(dense, self.centre, self.scale) @ self.dense + total

    def calibrated(self, margin: np.ndarray) -> np.ndarray:
        return self.slope * margin + self.shift


def scaled(dense: np.ndarray, centre: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return np.clip((dense - centre) / scale, -FARTHEST, FARTHEST)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Slope:
    """A pseudo-labelled loss near some weights: its slope there, and its curvature, whole for dense weights and by weight for hashed ones."""

    at: np.ndarray
    slope: np.ndarray
    dense: np.ndarray
    hashed: np.ndarray

    def gradient(self, w: np.ndarray) -> np.ndarray:
        move = w - self.at
        n = len(self.dense)
        return self.slope + np.concatenate([self.dense @ move[:n], self.hashed * move[n:]]) + NEAR * move


def fit_view(dense, row, bucket, buckets, y, weight, steps: int = STEPS, view: View | None = None, pseudo: Slope | None = None) -> View:
    """Weighted logistic regression by Adam, with weight decay, from the weights of a view if given; a pseudo-labelled loss comes on top."""
    n = len(y)
    if view is None:
        centre, scale = dense.mean(axis=0), dense.std(axis=0)
        centre[scale < 1e-9], scale[scale < 1e-9] = 0, 1
        w = np.zeros(dense.shape[1] + buckets)
    else:
        centre, scale, w = view.centre, view.scale, np.concatenate([view.dense, view.hashed])
    x = scaled(dense, centre, scale)
    root = 1 / np.sqrt(np.maximum(np.bincount(row, minlength=n), 1))
    m, v = np.zeros_like(w), np.zeros_like(w)
    weight = weight / weight.sum()
    for t in range(1, steps + 1):
        margin = x @ w[: x.shape[1]] + np.bincount(row, weights=w[x.shape[1] :][bucket], minlength=n) * root
        error = (sigmoid(margin) - y) * weight
        grad = np.concatenate([x.T @ error, np.bincount(bucket, weights=(error * root)[row], minlength=buckets)]) + 1e-4 * w
        if pseudo is not None:
            grad += pseudo.gradient(w)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w = w - 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return View(centre, scale, w[: x.shape[1]], w[x.shape[1] :])


def fit_line(x: np.ndarray, y: np.ndarray, steps: int = 50) -> np.ndarray:
    """Logistic regression on a few columns by Newton steps with a ridge that keeps separable data finite."""
    x = np.column_stack([x, np.ones(len(y))])
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], 1e-2)
    for _ in range(steps):
        p = sigmoid(x @ w)
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        w = w - np.linalg.solve(h, x.T @ (p - y) + ridge * w)
    return w


@dataclass
class Model:
    text: View
    meta: View
    combine: np.ndarray  # weights of the calibrated log-odds, and a constant
    rounds: list[tuple[int, int]]  # pseudo-labels that each view gave in each round

    def scores(self, text_margin, meta_margin):
        a, b = self.text.calibrated(text_margin), self.meta.calibrated(meta_margin)
        return sigmoid(a), sigmoid(b), sigmoid(self.combine[0] * a + self.combine[1] * b + self.combine[2])


def take(features, rows: np.ndarray):
    """The chosen rows of (dense, row, bucket)."""
    dense, row, bucket = features
    place = np.full(len(dense), -1)
    place[rows] = np.arange(len(rows))
    keep = place[row] >= 0
    return dense[rows], place[row[keep]], bucket[keep]


def balanced(y: np.ndarray) -> np.ndarray:
    """Weights with which both classes count alike."""
    return np.where(y == 1, 1 / max(1, int((y == 1).sum())), 1 / max(1, int((y == 0).sum())))


def sums_of(view: View, dense, row, bucket, buckets, y: np.ndarray) -> np.ndarray:
    """Of each class of pseudo-labelled documents (y; -1 for none) their number, and the sums of slope, dense and hashed curvature, as whole numbers of 1 / GRID."""
    n, d = len(dense), dense.shape[1]
    x = scaled(dense, view.centre, view.scale)
    count = np.bincount(row, minlength=n)
    root = 1 / np.sqrt(np.maximum(count, 1))
    p = sigmoid(view.margin(dense, row, bucket))
    out = []
    for label in (0, 1):
        own = y == label
        error, curve = np.where(own, p - label, 0), np.where(own, p * (1 - p), 0)
        whole = lambda z: np.rint(z * GRID)
        pairs = (x[:, :, None] * x[:, None, :]).reshape(n, d * d)
        out.append(np.concatenate([
            [float(own.sum())], whole(x * error[:, None]).sum(axis=0), np.bincount(bucket, weights=whole(error * root)[row], minlength=buckets),
            whole(pairs * curve[:, None]).sum(axis=0), np.bincount(bucket, weights=whole(curve * root * root)[row], minlength=buckets),
        ]))
    return np.array(out).astype(np.int64)


def slope_of(view: View, sums: np.ndarray) -> Slope | None:
    """The loss of the pseudo-labelled documents, each class with the weight PSEUDO / 2; none without any."""
    if not sums[:, 0].any():
        return None
    d = len(view.dense)
    mean = PSEUDO / 2 * sum(s[1:] / GRID / s[0] for s in sums.astype(np.float64) if s[0])
    buckets = len(view.hashed)
    slope, pairs, hashed = mean[: d + buckets], mean[d + buckets : d + buckets + d * d], mean[d + buckets + d * d :]
    return Slope(np.concatenate([view.dense, view.hashed]), slope, pairs.reshape(d, d), hashed)


def co_train(text, meta, y: np.ndarray, exchange, rounds: int = ROUNDS) -> Model | None:
    """A model from the features and labels (0 or 1) of a sample. exchange(text view, meta view) gives the sums_of() of both views over all documents. Without both classes there is no model."""
    if len(np.unique(y)) < 2:
        return None
    every = np.arange(len(y))
    held = every[::CALIBRATE] if len(np.unique(y[::CALIBRATE])) == 2 and len(y) >= 40 else every
    base = np.setdiff1d(every, held) if len(held) < len(every) else every
    if len(np.unique(y[base])) < 2:
        base = held = every
    own = y[base].astype(np.float64)
    parts = ((text, WORD_BUCKETS), (meta, META_BUCKETS))
    views = [fit_view(*take(features, base), buckets, own, balanced(own)) for features, buckets in parts]
    given = []
    for _ in range(rounds):
        sums = exchange(*views)
        given.append((int(sums[1][:, 0].sum()), int(sums[0][:, 0].sum())))
        views = [fit_view(*take(features, base), buckets, own, balanced(own), STEPS, view, slope_of(view, s)) for (features, buckets), view, s in zip(parts, views, sums, strict=True)]
    odds = []
    for view, features in zip(views, (text, meta), strict=True):
        margin = view.margin(*take(features, held))
        view.slope, view.shift = fit_line(margin[:, None], y[held].astype(np.float64))
        odds.append(view.calibrated(margin))
    return Model(views[0], views[1], fit_line(np.column_stack(odds), y[held].astype(np.float64)), given)


def meta_buckets(columns: list[str], types: dict[str, str]):
    """An array column with a bucket for each metadata column: of its value, or of a number's order of magnitude."""
    out = []
    for c in columns:
        numeric = types[c] in ("tinyint", "smallint", "int", "bigint", "float", "double") or types[c].startswith("decimal")
        column = quoted(c)
        value = F.floor(2 * F.log2(F.abs(column.cast("double")) + 1)).cast("string") if numeric else column.cast("string")
        out.append(F.pmod(F.xxhash64(F.lit(c), F.coalesce(value, F.lit("\0null"))), F.lit(META_BUCKETS)).cast("int"))
    return F.array(*out) if out else F.array().cast("array<int>")


def _sampled(batches):
    for batch in batches:
        for i, j, dense, pairs in text_features(batch.column(1)):
            row = pairs // WORD_BUCKETS
            ends = np.searchsorted(row, np.arange(j - i + 1))
            buckets = (pairs % WORD_BUCKETS).astype(np.int16)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(i, j - i), pa.array([x.tobytes() for x in dense]), pa.array([buckets[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]), batch.column(2).slice(i, j - i), batch.column(3).slice(i, j - i)],
                names=["doc_id", "dense", "words", "meta", "y"],
            )


def _meta_of(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The metadata view's features of n rows of bucket lists: a constant, and the hashed values."""
    meta = np.array(column.to_pylist(), np.int64).reshape(n, -1)
    return np.ones((n, 1)), np.repeat(np.arange(n), meta.shape[1]), meta.ravel()


def _exchanged(held, batches):
    """The sums of a task's documents: those of the text view under the labels that the metadata view is sure of, and the other way."""
    text, meta = held.value
    total = [0, 0]
    for batch in batches:
        for i, j, dense, pairs in text_features(batch.column(0)):
            n = j - i
            words = dense, pairs // WORD_BUCKETS, pairs % WORD_BUCKETS
            columns = _meta_of(batch.column(1).slice(i, n), n)
            sure = []
            for view, features in ((text, words), (meta, columns)):
                p = sigmoid(view.margin(*features))
                sure.append(np.where(p >= CONFIDENT, 1, np.where(p <= 1 - CONFIDENT, 0, -1)))
            total[0] = total[0] + sums_of(text, *words, WORD_BUCKETS, sure[1])
            total[1] = total[1] + sums_of(meta, *columns, META_BUCKETS, sure[0])
    found = [(k, t.tobytes()) for k, t in enumerate(total) if not isinstance(t, int)]
    yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.int32()), pa.array([t for _, t in found], pa.binary())], names=["view", "sums"])


def _added(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x, np.int64) for x in table["sums"].to_pylist())
    return pa.table({"view": pa.array([table["view"][0].as_py()], pa.int32()), "sums": pa.array([total.tobytes()], pa.binary())})


def train(docs: DataFrame, labels: DataFrame, meta_cols: list[str], id_col="doc_id", text_col="text", label_id_col="doc_id", label_col="quality", labelled: int = LABELLED, rounds: int = ROUNDS) -> Model | None:
    """The model from a bounded sample of labelled documents and all documents. Conflicting labels of an id count as none; of rows with the same id one is in the sample."""
    known = labels.where(F.col(label_id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(label_id_col).cast("long").alias("doc_id"))
    known = known.agg(F.min(F.col(label_col).cast("int")).alias("y"), F.max(F.col(label_col).cast("int")).alias("z")).where("y = z and y in (0, 1)").select("doc_id", "y")
    ids = docs.select(F.col(id_col).cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    some = ids.join(known, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled).collect()
    if len({r["y"] for r in some}) < 2:
        return None
    spark = docs.sparkSession
    chosen = spark.createDataFrame([(r["doc_id"], r["y"]) for r in some], "doc_id long, y int")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), meta_buckets(meta_cols, dict(docs.dtypes)).alias("meta"))
    sample = rows.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "meta", "y").mapInArrow(_sampled, "doc_id long, dense binary, words binary, meta array<int>, y int")
    found = [r["one"] for r in sample.groupBy("doc_id").agg(F.min(F.struct("doc_id", "words", "dense", "meta", "y")).alias("one")).collect()]
    found.sort(key=lambda r: r["doc_id"])
    dense = np.array([np.frombuffer(r["dense"], np.float64) for r in found])
    words = [np.frombuffer(r["words"], np.int16).astype(np.int64) for r in found]
    number = np.arange(len(found))
    text = dense, np.repeat(number, [len(w) for w in words]), np.concatenate(words)
    meta = np.ones((len(found), 1)), np.repeat(number, len(meta_cols)), np.array([r["meta"] for r in found], np.int64).reshape(-1)

    def exchange(text_view, meta_view):
        held = spark.sparkContext.broadcast((text_view, meta_view))
        out = [np.zeros((2, 1 + d + b + d * d + b), np.int64) for d, b in ((dense.shape[1], WORD_BUCKETS), (1, META_BUCKETS))]
        for r in rows.select("text", "meta").mapInArrow(lambda batches: _exchanged(held, batches), "view int, sums binary").groupBy("view").applyInArrow(_added, "view int, sums binary").collect():
            out[r["view"]] = np.frombuffer(r["sums"], np.int64).reshape(2, -1)
        held.unpersist()
        return out

    return co_train(text, meta, np.array([r["y"] for r in found]), exchange, rounds)


def _scored(held, threshold, batches):
    model = held.value
    for batch in batches:
        for i, j, dense, pairs in text_features(batch.column(1)):
            n = j - i
            if model is None:
                one = [np.ones(n)] * 3
            else:
                a = model.text.margin(dense, pairs // WORD_BUCKETS, pairs % WORD_BUCKETS)
                b = model.meta.margin(*_meta_of(batch.column(2).slice(i, n), n))
                one = [np.round(x, 6) for x in model.scores(a, b)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, n), *(pa.array(x) for x in one), pa.array(one[2] >= threshold)], names=["doc_id", "text_prob", "meta_prob", "score", "keep"])


def classify(docs: DataFrame, labels: DataFrame, meta_cols: list[str] | None = None, id_col="doc_id", text_col="text", label_id_col="doc_id", label_col="quality", threshold: float = THRESHOLD, **sizes) -> DataFrame:
    """One row per document: the calibrated probability of good quality by each view and by both, and whether it stays.

    Metadata columns default to all but the id and the text. Defined cases: a null text is as an empty one, a null in
    the metadata a value of its own; labels other than 0 and 1, null or conflicting are ignored; without labels of both
    classes every probability is 1 and all documents stay; a null id is scored like any other, but its label is not known;
    repeated documents are scored each; no rows give none.
    """
    columns = meta_cols if meta_cols is not None else [c for c in docs.columns if c not in (id_col, text_col)]
    model = train(docs, labels, columns, id_col, text_col, label_id_col, label_col, **sizes)
    held = docs.sparkSession.sparkContext.broadcast(model)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), meta_buckets(columns, dict(docs.dtypes)).alias("meta"))
    return rows.mapInArrow(lambda batches: _scored(held, threshold, batches), SCORED)


def keep_good(docs: DataFrame, labels: DataFrame, meta_cols: list[str] | None = None, id_col="doc_id", text_col="text", label_id_col="doc_id", label_col="quality", threshold: float = THRESHOLD, **sizes) -> DataFrame:
    """The documents that classify() keeps, with all their columns; cases as there."""
    columns = meta_cols if meta_cols is not None else [c for c in docs.columns if c not in (id_col, text_col)]
    held = docs.sparkSession.sparkContext.broadcast(train(docs, labels, columns, id_col, text_col, label_id_col, label_col, **sizes))
    inputs = [F.col(text_col).cast("string"), meta_buckets(columns, dict(docs.dtypes))]
    return carried(docs, inputs, lambda batches: _scored(held, threshold, batches), lambda own, found: own.filter(found["keep"]))
