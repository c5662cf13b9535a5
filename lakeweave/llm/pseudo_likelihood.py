"""LM scoring by masked pseudo-likelihood: a window network in numpy predicts every token from both sides.

Tokens. The vocabulary is half the square root of the words of the corpus. Half of its tokens are the most frequent
words, the other half are hash classes of all other words, so that every word has a token of its own or shares it with
few. The network sums one vector for each of the SIDE words before and after the masked one (a table by place and
token), then tanh and a softmax in two levels, over classes of tokens and over the tokens of a class, so that a
prediction costs the square root of the vocabulary. A document's score is the sum of log P(token | both sides).

Training. The tokens are written once. Passages of documents are dealt to streams by a hash of id and content; how many
streams there are follows from the number of words. A stream is trained by AdaGrad in the order of the hashes; the
parameters of a round's streams are averaged as integers, weighted by positions. So the network depends on the documents
alone: not on partitions, executors or retries. An epoch goes over every position of all documents in ROUNDS rounds;
epochs go on until a round lowers the loss on held-out passages by less than LEAST_GAIN of it, and the network of the
lowest loss stays. Held-out passages train last.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeweave.llm.common import drop, shuffle_parts, with_texts, written
from lakeweave.llm.text import U64, WHITE, mix, slices, string_buffers, words_of

SIDE = 2
HIDDEN = 16
ROUNDS = 4  # averagings in an epoch
EPOCHS = 4  # at most
LEAST_GAIN = 0.005  # of the held-out loss by an epoch's last round, for another epoch
HELD_OUT = 64  # one passage in so many
PASSAGE = 1 << 15  # tokens of a document that train together
STREAM = 256  # positions of a stream for each token of the vocabulary
LEAST_STREAM = 1 << 17
BATCH = 128  # positions of a step for each class
FARTHEST = 40  # from 0, of a score
CACHED = 1024  # rows of a product whose results stay in the cache
RATE = 0.15
UNIT = 1 << 20
BLOCK = 1 << 14  # parameters in a row on their way to the average
SEED = 5
AT_ONCE = 1 << 16
SCORED = "doc_id long, n_tokens long, log_prob double, mean_log_prob double"
PASSAGES = "doc_id long, first boolean, stream long, key long, lead int, n int, tokens binary"


@dataclass(frozen=True)
class Shape:
    """The sizes of a network: classes x members tokens, and an edge beside them."""

    side: int

    @property
    def tokens(self) -> int:
        return self.side * self.side

    @property
    def size(self) -> int:
        return sum(math.prod(s) for s in self.shapes())

    def shapes(self) -> list[tuple[int, ...]]:
        """Tables by place, hidden bias, class weights and biases, member weights and biases, and the squares that AdaGrad sums: of table rows, hidden bias, classes and members."""
        v, c = self.tokens + 1, self.side
        return [(2 * SIDE, v, HIDDEN), (HIDDEN,), (HIDDEN, c), (c,), (c, HIDDEN, c), (c, c), (2 * SIDE, v), (1,), (c,), (c, c)]

    def views(self, p: np.ndarray) -> list[np.ndarray]:
        out, at = [], 0
        for s in self.shapes():
            n = math.prod(s)
            out.append(p[at : at + n].reshape(s))
            at += n
        return out

    @property
    def number(self):
        """The type of a token number."""
        return np.uint16 if self.tokens < 1 << 16 else np.uint32


def shape_of(words: int) -> Shape:
    """A vocabulary of about half the square root of the words of the corpus, 256 tokens at least."""
    return Shape(max(16, math.ceil((max(words, 1) / 4) ** 0.25)))


def start(shape: Shape, counts: np.ndarray | None = None, seed: int = SEED) -> np.ndarray:
    """An untrained network, which gives every token the share that it has of the corpus."""
    rng = np.random.default_rng(seed)
    p = np.zeros(shape.size, np.float32)
    table, _, out, bias, inner, inner_bias, *squares = shape.views(p)
    table[:] = rng.normal(0, 0.1, table.shape)
    out[:] = rng.normal(0, 0.1, out.shape)
    inner[:] = rng.normal(0, 0.1, inner.shape)
    if counts is not None:
        known = counts.reshape(shape.side, shape.side) + 0.5
        bias[:] = np.log(known.sum(axis=1) / known.sum())
        inner_bias[:] = np.log(known / known.sum(axis=1, keepdims=True))
    for s in squares:
        s[:] = 1e-3
    return p


def _logits(own: np.ndarray, weights: np.ndarray, bias: np.ndarray, within: bool) -> tuple[np.ndarray, np.ndarray]:
    """Scores of each row, and the factors that their exponentials still lack.

    Scores count within FARTHEST of 0, so nothing overflows and no share is a denormal number. Where none can leave that
    range they are given without their bias, which enters as the factor exp(bias) of a column.
    """
    x = own @ weights
    if within:
        return x, np.exp(bias)
    x += bias
    return np.clip(x, -FARTHEST, FARTHEST, out=x), np.ones_like(bias)


def _within(weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Whether all scores of a softmax are within FARTHEST of 0 whatever the hidden units are, as these are within 1."""
    return (np.abs(weights).sum(axis=-2) + np.abs(bias)).max(axis=-1) < FARTHEST


def _log_share(own: np.ndarray, weights: np.ndarray, bias: np.ndarray, within: bool, at: np.ndarray) -> np.ndarray:
    """The log of the softmax of each row at one place."""
    x, factor = _logits(own, weights, bias, within)
    score = x.take(np.arange(0, x.size, x.shape[1]) + at)
    np.exp(x, out=x)
    return score + np.log(factor[at] / (x @ factor))


def _slope(own: np.ndarray, weights: np.ndarray, bias: np.ndarray, within: bool, at: np.ndarray):
    """Gradients of the summed loss of a softmax, whose rows are of the classes `at`: of the rows, weights and biases.

    Shares are not divided by their sums one by one: the rows that they are multiplied by are.
    """
    x, factor = _logits(own, weights, bias, within)
    np.exp(x, out=x)
    total = x @ factor
    x.reshape(-1)[np.arange(0, x.size, x.shape[1]) + at] -= total / factor[at]
    share = 1 / total
    back = x @ (weights * factor).T
    back *= share[:, None]
    return back, (own * share[:, None]).T @ x * factor, share @ x * factor


def _segments(shape: Shape, target: np.ndarray):
    """The class of each row and its place in it, rows in the order of their target's class, and (class, begin, end) of each, CACHED rows at most."""
    cls = (target // shape.side).astype(shape.number)
    order = np.argsort(cls, kind="stable")
    ends = np.cumsum(np.bincount(cls, minlength=shape.side)).tolist()
    return cls, target - cls * shape.side, order, [(c, k, min(k + CACHED, b)) for c, (a, b) in enumerate(zip([0, *ends], ends, strict=False)) for k in range(a, b, CACHED)]


def hidden_of(shape: Shape, p: np.ndarray, context: np.ndarray) -> np.ndarray:
    table, bias, *_ = shape.views(p)
    hidden = table[0].take(context[:, 0], axis=0)
    for k in range(1, 2 * SIDE):
        hidden += table[k].take(context[:, k], axis=0)
    hidden += bias
    return np.tanh(hidden, out=hidden)


def log_probs(shape: Shape, p: np.ndarray, context: np.ndarray, target: np.ndarray) -> np.ndarray:
    """log P(target | context) of each row."""
    hidden = hidden_of(shape, p, context)
    _, _, out, out_bias, inner, inner_bias, *_ = shape.views(p)
    cls, member, order, segments = _segments(shape, target)
    found, within = np.empty(len(target)), _within(out, out_bias)
    for k in range(0, len(target), CACHED):
        found[k : k + CACHED] = _log_share(hidden[k : k + CACHED], out, out_bias, within, cls[k : k + CACHED])
    hidden, member, logs = hidden.take(order, axis=0), member[order], np.empty(len(target))
    within = _within(inner, inner_bias)
    for c, a, b in segments:
        logs[a:b] = _log_share(hidden[a:b], inner[c], inner_bias[c], within[c], member[a:b])
    found[order] += logs
    return found


def gradient(shape: Shape, p: np.ndarray, context: np.ndarray, target: np.ndarray):
    """Gradients of the summed loss: an order of the rows and, in that order, of the hidden layer's input; of the class level; of the members of classes."""
    hidden = hidden_of(shape, p, context)
    _, _, out, out_bias, inner, inner_bias, *_ = shape.views(p)
    cls, member, order, segments = _segments(shape, target)
    hidden, cls, member = hidden.take(order, axis=0), cls[order], member[order]
    back, d_out, d_bias = np.empty_like(hidden), np.zeros_like(out), np.zeros_like(out_bias)
    within = _within(out, out_bias)
    for k in range(0, len(target), CACHED):
        back[k : k + CACHED], weights, biases = _slope(hidden[k : k + CACHED], out, out_bias, within, cls[k : k + CACHED])
        d_out += weights
        d_bias += biases
    d_inner, d_inner_bias = np.zeros_like(inner), np.zeros_like(inner_bias)
    within = _within(inner, inner_bias)
    for c, a, b in segments:
        own, weights, biases = _slope(hidden[a:b], inner[c], inner_bias[c], within[c], member[a:b])
        back[a:b] += own
        d_inner[c] += weights
        d_inner_bias[c] += biases
    back *= 1 - hidden * hidden
    return order, back, d_out, d_bias, [(slice(None), d_inner, d_inner_bias)]


def learn(shape: Shape, p: np.ndarray, context: np.ndarray, target: np.ndarray, rate: float = RATE) -> None:
    """One step of AdaGrad, in place; a table row, and a column of output weights with its bias, has one rate."""
    by_class, back, d_out, d_bias, members = gradient(shape, p, context, target)
    table, bias, out, out_bias, inner, inner_bias, table_squares, bias_square, out_squares, inner_squares = shape.views(p)
    for k in range(2 * SIDE):
        own = context[:, k].take(by_class)
        order = np.argsort(own, kind="stable")
        token = own.take(order)
        begin = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
        pairs = back.take(order, axis=0).view(np.result_type(back, np.complex64))  # sums of two columns at once
        rows, change = token[begin], np.add.reduceat(pairs, begin, axis=0).view(back.dtype)
        table_squares[k][rows] += (change * change).mean(axis=1)
        table[k][rows] -= change * (rate / np.sqrt(table_squares[k][rows]))[:, None]
    change = back.sum(axis=0)
    bias_square += (change * change).mean()
    bias -= change * (rate / np.sqrt(bias_square))
    out_squares += (d_out * d_out).mean(axis=0) + d_bias * d_bias
    out -= d_out * (rate / np.sqrt(out_squares))
    out_bias -= d_bias * (rate / np.sqrt(out_squares))
    for c, weights, biases in members:
        inner_squares[c] += (weights * weights).mean(axis=-2) + biases * biases
        step = rate / np.sqrt(inner_squares[c])
        inner[c] -= weights * step[..., None, :]
        inner_bias[c] -= biases * step


def windows(shape: Shape, token: np.ndarray, lead: int, n: int) -> np.ndarray:
    """The tokens around the n ones after the first `lead`; beyond the ends, the edge."""
    padded = np.full(len(token) + 2 * SIDE, shape.tokens, shape.number)
    padded[SIDE : SIDE + len(token)] = token
    return np.stack([padded[lead + SIDE + d : lead + SIDE + d + n] for d in (*range(-SIDE, 0), *range(1, SIDE + 1))]).T


def _slices(batch):
    data, offsets = string_buffers(batch.column(1))
    for i, j in slices(offsets):
        yield i, j, words_of(data, offsets[i : j + 1], WHITE)


def _counts(buckets, batches):
    for batch in batches:
        hashes = [w.hashes for _, _, w in _slices(batch)]
        distinct, counts = np.unique(np.concatenate([np.zeros(0, U64), *hashes]), return_counts=True)
        bucket = (distinct >> U64(40)).astype(np.int64) % buckets
        order = np.argsort(bucket, kind="stable")
        distinct, counts, bucket = distinct[order], counts[order], bucket[order]
        ends = np.searchsorted(bucket, np.arange(buckets + 1))
        rows = [(k, b - a, int(counts[a:b].sum()), distinct[a:b].tobytes(), counts[a:b].astype(np.uint32).tobytes()) for k, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)) if b > a]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["bucket", "n", "total", "words", "counts"])


def _totals(table: pa.Table) -> pa.Table:
    words = np.frombuffer(b"".join(table["words"].to_pylist()), U64)
    counts = np.frombuffer(b"".join(table["counts"].to_pylist()), np.uint32)
    distinct, at = np.unique(words, return_inverse=True)
    total = np.bincount(at, weights=counts).astype(np.int64)
    return pa.table({"word": pa.array(distinct.astype(np.int64)), "n": pa.array(total, pa.int64())})


def vocabulary(docs: DataFrame) -> tuple[Shape, np.ndarray]:
    """The shape for a corpus, and the hashes of its most frequent words, the most frequent first. Docs have doc_id and text.

    Words are counted in the tasks and by bucket of their hash; the least frequent of a bucket are dropped only where
    others of it fill the vocabulary already. So many rows come to the driver as the vocabulary has words.
    """
    buckets = min(4 * shuffle_parts(docs.sparkSession), 1 << 14)
    counted = written(docs.mapInArrow(lambda batches: _counts(buckets, batches), "bucket int, n long, total long, words binary, counts binary"), "counted")
    shape = shape_of(counted.agg(F.sum("total")).first()[0] or 0)
    most = counted.groupBy("bucket").applyInArrow(_totals, "word long, n long").orderBy(F.desc("n"), "word").limit(shape.tokens // 2).collect()
    drop(counted)
    return shape, np.array([r["word"] for r in most], np.int64).astype(U64)


def tokens_of(shape: Shape, words, known: np.ndarray) -> np.ndarray:
    """Token numbers of the words of a slice: the rank of a frequent word, else one of the hash classes."""
    h = words.hashes
    token = (h % U64(shape.tokens - shape.tokens // 2)).astype(shape.number)
    token += shape.number(shape.tokens // 2)
    shift = U64(60 - len(known).bit_length())  # sixteen slots or more for a known word, by the first bits of its hash
    slot, slots, left = h >> shift, known >> shift, np.arange(len(known))
    while len(left):  # one word of each slot, then another of those that hold two, and so on
        at = np.zeros(1 << (64 - int(shift)), shape.number)
        at[slots[left]] = left
        rank = at.take(slot.view(np.int64))
        token = np.where(known.take(rank) == h, rank, token)
        left = left[at[slots[left]] != left]
    return token


def _passages(held, streams, batches):
    """Documents as passages of tokens, with SIDE more on either side: the stream and the hash that orders it, -1 for held-out ones."""
    shape, known = held.value
    places = mix(np.arange(PASSAGE, dtype=U64))
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        for i, j, words in _slices(batch):
            token = tokens_of(shape, words, known)
            rows = []
            for r in range(j - i):
                a, b = int(words.first[r]), int(words.first[r + 1])
                own = -1 if np.isnan(ids[i + r]) else int(ids[i + r])
                for k in range(a, max(b, a + 1), PASSAGE):
                    e = min(b, k + PASSAGE)
                    lead = min(SIDE, k - a)
                    text = words.hashes[k:e]
                    seed = U64((own * 0x9E3779B97F4A7C15 + k - a + 1) % (1 << 64))
                    key = int(mix(np.array([(text * places[: len(text)]).sum(dtype=U64) ^ seed], U64))[0])
                    stream = -1 if key % HELD_OUT == 0 else key // HELD_OUT % streams
                    rows.append((None if own == -1 else own, k == a, stream, key - (1 << 63), lead, e - k, token[k - lead : min(b, e + SIDE)].tobytes()))
            columns = list(zip(*rows, strict=True))
            kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[f.split()[0] for f in PASSAGES.split(", ")])


def _of_batch(shape, batch):
    """(row, tokens, lead, n) of a batch of passages."""
    names = batch.schema.names
    blobs, leads, sizes = (batch.column(names.index(c)).to_pylist() for c in ("tokens", "lead", "n"))
    for r, (blob, lead, n) in enumerate(zip(blobs, leads, sizes, strict=True)):
        yield r, np.frombuffer(blob, shape.number), lead, n


def _counted_tokens(shape, batches):
    total = np.zeros(shape.tokens, np.int64)
    for batch in batches:
        for _, token, lead, n in _of_batch(shape, batch):
            total += np.bincount(token[lead : lead + n], minlength=shape.tokens)
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["token", "n"])


def _trained(held, batches):
    """The rows of one stream after another, in order; of each stream the parameters, in blocks."""
    shape, first = held.value
    p, current, n, context, target, held_rows = None, None, 0, [], [], 0
    batch_size = BATCH * shape.side

    def put():
        values = np.clip(np.round(p.astype(np.float64) * UNIT), -(1 << 31) + 1, (1 << 31) - 1).astype(np.int32)
        parts = [values[k : k + BLOCK].tobytes() for k in range(0, len(values), BLOCK)]
        return pa.RecordBatch.from_arrays([pa.array(np.arange(len(parts), dtype=np.int32)), pa.array(np.full(len(parts), n, np.int64)), pa.array(parts, pa.binary())], names=["block", "n", "params"])

    def steps(all_rows):
        nonlocal held_rows
        if held_rows < batch_size and not (all_rows and held_rows):
            return
        c, t = np.concatenate(context), np.concatenate(target)
        done = len(t) if all_rows else len(t) // batch_size * batch_size
        for k in range(0, done, batch_size):
            learn(shape, p, c[k : min(k + batch_size, done)], t[k : min(k + batch_size, done)])
        context[:], target[:] = [c[done:]], [t[done:]]
        held_rows = len(t) - done

    for batch in batches:
        streams = batch.column(batch.schema.names.index("stream")).to_pylist()
        for r, token, lead, size in _of_batch(shape, batch):
            if streams[r] != current:
                if p is not None and n:
                    steps(True)
                    yield put()
                p, current, n, held_rows = first.copy(), streams[r], 0, 0
                context.clear()
                target.clear()
            if size:
                context.append(windows(shape, token, lead, size))
                target.append(token[lead : lead + size])
                n += size
                held_rows += size
                steps(False)
    if p is not None and n:
        steps(True)
        yield put()


def _averaged(table: pa.Table) -> pa.Table:
    total = None
    for n, blob in zip(table["n"].to_pylist(), table["params"].to_pylist(), strict=True):
        own = np.frombuffer(blob, np.int32).astype(np.float64) * n
        total = own if total is None else total + own
    weight = sum(table["n"].to_pylist())
    return pa.table({"block": pa.array([table["block"][0].as_py()], pa.int32()), "n": pa.array([weight], pa.int64()), "params": pa.array([(total / weight / UNIT).astype(np.float32).tobytes()], pa.binary())})


def _logs(shape, p, token, lead, n):
    out = np.zeros(n)
    for k in range(0, n, AT_ONCE):
        m = min(AT_ONCE, n - k)
        out[k : k + m] = log_probs(shape, p, windows(shape, token, lead + k, m), token[lead + k : lead + k + m])
    return out


def _round(passages: DataFrame, streams: int, shape: Shape, p: np.ndarray) -> tuple[np.ndarray, int]:
    """The average of the parameters of all streams of some passages, each trained from p, and their positions. Rows that are repeated in id and content train once."""
    held = passages.sparkSession.sparkContext.broadcast((shape, p))
    once = passages.where("n > 0").select("stream", "key", "lead", "n", "tokens").dropDuplicates(["stream", "key"])
    dealt = once.repartitionById(streams, F.pmod("stream", F.lit(streams)).cast("int")).sortWithinPartitions("stream", "key")
    blocks = dealt.mapInArrow(lambda batches: _trained(held, batches), "block int, n long, params binary").groupBy("block").applyInArrow(_averaged, "block int, n long, params binary").orderBy("block").collect()
    held.unpersist()
    if not blocks:
        return p, 0
    return np.concatenate([np.frombuffer(r["params"], np.float32) for r in blocks]), blocks[0]["n"]


def _loss(passages: DataFrame, shape: Shape, p: np.ndarray) -> float | None:
    """The mean loss of a position of some passages; none without any."""
    held = passages.sparkSession.sparkContext.broadcast((shape, p))

    def run(batches):
        own, q = held.value
        for batch in batches:
            sums = [(int(round(float(-_logs(own, q, token, lead, n).sum()) * 1000)), n) for _, token, lead, n in _of_batch(own, batch)]
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in sums], pa.int64()), pa.array([n for _, n in sums], pa.int64())], names=["s", "n"])

    found = passages.select("lead", "n", "tokens").mapInArrow(run, "s long, n long").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).first()
    held.unpersist()
    return found["s"] / 1000 / found["n"] if found["n"] else None


@dataclass
class Model:
    shape: Shape
    known: np.ndarray
    params: np.ndarray
    losses: list[float]  # on the held-out passages: of the corpus's shares alone, then after each round


def fit(docs: DataFrame, rounds: int = ROUNDS, epochs: int = EPOCHS, least_gain: float = LEAST_GAIN, seed: int = SEED) -> tuple[Model, DataFrame]:
    """The network of a corpus (doc_id, text), and its written passages."""
    spark = docs.sparkSession
    shape, known = vocabulary(docs)
    held = spark.sparkContext.broadcast((shape, known))
    streams = 1 << 20
    passages = written(docs.mapInArrow(lambda batches: _passages(held, streams, batches), PASSAGES), "passages")
    counts = np.zeros(shape.tokens, np.int64)
    for r in passages.select("lead", "n", "tokens").mapInArrow(lambda batches: _counted_tokens(shape, batches), "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).collect():
        counts[r["token"]] = r["n"]
    p = start(shape, counts, seed)
    total = int(counts.sum())
    streams = max(1, math.ceil(total / max(LEAST_STREAM, STREAM * shape.tokens)))
    rounds = min(rounds, streams)
    learning = passages.where("stream >= 0").withColumn("stream", F.col("stream") % streams)
    aside = passages.where("stream < 0")
    checked = aside if total and not aside.where("n > 0").isEmpty() else passages
    losses = [] if not total else [_loss(checked, shape, p)]
    q, best = p, losses[0] if losses else None
    for _ in range(epochs if total else 0):
        for r in range(rounds):
            of_round = learning.where(F.col("stream") % rounds == r).withColumn("stream", F.floor(F.col("stream") / rounds))
            q, _n = _round(of_round, max(1, -(-(streams - r) // rounds)), shape, q)
            losses.append(_loss(checked, shape, q))
            if losses[-1] < best:
                p, best = q, losses[-1]
        if losses[-1] > (1 - least_gain) * losses[-2]:
            break
    if checked is aside:
        last, n = _round(aside.withColumn("stream", F.lit(0).cast("long")), 1, shape, p)
        p = (p.astype(np.float64) * (total - n) / total + last.astype(np.float64) * n / total).astype(np.float32)
    return Model(shape, known, p, losses), passages


def score(docs: DataFrame, id_col="doc_id", text_col="text", **options) -> DataFrame:
    """One row per document: its tokens and the summed and mean log-probability of each given both sides.

    Defined cases: a null, empty or blank text has no tokens, a sum of 0 and a null mean; without any text the network
    is the untrained one; a row that is repeated in id and text trains once and is scored each time; no rows give none.
    Other columns are not read.
    """
    rows = with_texts(docs, id_col, text_col)
    model, passages = fit(rows, **options)
    drop(passages)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = held.value
        for batch in batches:
            for i, j, words in _slices(batch):
                token = tokens_of(m.shape, words, m.known)
                n = np.diff(words.first)
                padded = np.full(len(token) + 2 * SIDE * (j - i + 1), m.shape.tokens, m.shape.number)
                at = np.arange(len(token)) + 2 * SIDE * (words.row + 1)
                padded[at] = token
                found = np.zeros(len(token))
                for k in range(0, len(token), AT_ONCE):
                    here = at[k : k + AT_ONCE]
                    context = np.stack([padded.take(here + d) for d in (*range(-SIDE, 0), *range(1, SIDE + 1))]).T
                    found[k : k + AT_ONCE] = log_probs(m.shape, m.params, context, token[k : k + AT_ONCE])
                sums = np.round(np.bincount(words.row, weights=found, minlength=j - i), 3) if len(token) else np.zeros(j - i)
                mean = np.round(sums / np.maximum(n, 1), 6)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(n, pa.int64()), pa.array(sums + 0.0), pa.array(mean, pa.float64(), mask=n == 0)], names=["doc_id", "n_tokens", "log_prob", "mean_log_prob"])

    return rows.mapInArrow(run, SCORED)
