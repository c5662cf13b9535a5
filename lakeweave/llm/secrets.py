"""Secret scans: fixed patterns, and two character Markov models compared by log-likelihood ratio.

Both models are trained from labelled samples (string, is_secret): one on random strings, one on ordinary
identifiers. A candidate run is a secret if the mean log-likelihood ratio per transition is above a threshold in it or
in a part of it of the least length between separators, so that a name glued to a secret doesn't hide it. The
samples default to a seeded generator for the random class and, for the ordinary class, generated identifiers and
long words of a bounded sample of the documents themselves.
"""

from __future__ import annotations

import hashlib
import random
import re
import string

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeweave.llm.common import carried, with_texts

KINDS = ("assign", "access", "hex", "markov")
# Fixed patterns of the contract; hex runs and access keys of the least length are the runs of it that pass.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_WORDS = re.compile(r"pass|secret|token|api", re.IGNORECASE | re.ASCII)
ASSIGN_LEAST = 12

LEAST = 20
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=-]{{{LEAST},}}")
ALPHABET = string.ascii_letters + string.digits + "+/_=-"
SEPARATORS = ALPHABET.index("+")  # the code of the first; those after it are separators too
CODE = np.full(128, len(ALPHABET), np.int64)
CODE[[ord(c) for c in ALPHABET]] = np.arange(len(ALPHABET))
LEFT = 10
THRESHOLD = 0.35  # nats a transition
SAMPLE_DOCS = 2_000  # documents (those of least hash of their id) whose long words may train the ordinary class
SAMPLE_STRINGS = 4_000  # strings of each class
SCANNED = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_markov long, redacted string"
WORD_PARTS = "get set user name file path list index count value node type data key map table query request response handler config option default error message buffer stream reader writer thread task job event time date parse format print load store cache update delete insert select create remove find match token group order item page total size length width height left right start stop begin end open close send receive connect client server session account customer address number string object class method field column record version status result state process manager service factory builder provider".split()


def random_strings(n: int, seed: int = 7) -> list[str]:
    """Secrets of the usual alphabets: letters and digits, base64, URL-safe base64, upper case with digits, hex."""
    rng = random.Random(seed)
    alphabets = [string.ascii_letters + string.digits, ALPHABET[:64], string.ascii_letters + string.digits + "-_", string.ascii_uppercase + string.digits, "0123456789abcdef"]
    return ["".join(rng.choice(alphabets[k % len(alphabets)]) for _ in range(rng.randint(20, 48))) for k in range(n)]


def identifiers(n: int, seed: int = 11) -> list[str]:
    """Ordinary names: words joined in the styles of source code, paths and dates."""
    rng = random.Random(seed)
    out = []
    for k in range(n):
        words = [rng.choice(WORD_PARTS) for _ in range(rng.randint(3, 6))]
        style = k % 6
        if style == 0:
            out.append("_".join(words))
        elif style == 1:
            out.append(words[0] + "".join(w.capitalize() for w in words[1:]))
        elif style == 2:
            out.append("-".join(words))
        elif style == 3:
            out.append("/".join(words))
        elif style == 4:
            out.append("_".join(w.upper() for w in words) + f"_{rng.randint(0, 99)}")
        else:
            out.append("=" * rng.randint(3, 30) + "-" * rng.randint(3, 30))
    return out


def fit_model(strings: list[str], pseudo: float = 0.5) -> np.ndarray:
    """log P(next character | character), with a start state; unknown characters share one symbol."""
    size = len(ALPHABET) + 1
    counts = np.full((size + 1, size), pseudo)
    for s in strings:
        codes = encode(s)
        if len(codes):
            np.add.at(counts, (np.concatenate(([size], codes[:-1])), codes), 1)
    return np.log(counts / counts.sum(axis=1, keepdims=True))


def encode(s: str) -> np.ndarray:
    points = np.frombuffer(s.encode("utf-32-le"), np.uint32)
    return CODE[np.where(points < 128, points, 0)]


def fit_ratio(samples: list[tuple[str, bool]]) -> np.ndarray:
    """The table of log-likelihood ratios of the two classes, random over ordinary."""
    return fit_model([s for s, y in samples if y]) - fit_model([s for s, y in samples if not y])


def ratio(table: np.ndarray, s: str) -> float:
    """The mean log-likelihood ratio of a string's transitions; of an empty one, 0."""
    codes = encode(s)
    return float(table[np.concatenate(([len(ALPHABET) + 1], codes[:-1])), codes].mean()) if len(codes) else 0.0


def best_part(table: np.ndarray, s: str, threshold: float, least: int = LEAST) -> float:
    """The greatest sum of the ratios above the threshold, over the run and its parts between separators of the least length."""
    codes, start = encode(s), len(ALPHABET) + 1
    if len(codes) < least:
        return -np.inf
    total = np.concatenate(([0.0], np.cumsum(table[np.concatenate(([start], codes[:-1])), codes] - threshold)))
    cut = codes >= SEPARATORS
    begins = np.flatnonzero(np.concatenate(([True], cut[:-1])))
    ends = np.flatnonzero(np.concatenate((cut, [True]))[least:]) + least
    before = np.maximum.accumulate(table[start, codes[begins]] - threshold - total[begins + 1])
    return float((total[ends] + before[np.searchsorted(begins, ends - least, "right") - 1]).max())


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, in code points."""
    out = []
    if ASSIGN_WORDS.search(text):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def outside(begin: int, end: int, base: list[tuple[int, int, int]], at: int) -> tuple[list[tuple[int, int]], int]:
    """The parts of a run that no base span covers, and the first base span that may reach beyond it. Base spans are in order; all before `at` end before the run."""
    parts, here, k = [], begin, at
    while k < len(base) and base[k][0] < end:
        if base[k][0] > here:
            parts.append((here, base[k][0]))
        here = max(here, base[k][2])
        k += 1
    if here < end:
        parts.append((here, end))
    while at < len(base) and base[at][2] <= end:
        at += 1
    return parts, at


def markov_spans(text: str, base: list[tuple[int, int, int]], table: np.ndarray, threshold: float) -> list[tuple[int, int, int]]:
    """Candidate runs, or what base spans leave of them, that look random as a whole or in a part.

    What is left of a run beside a base span is judged from LEFT characters on, as it need not be a whole secret.
    """
    out, at = [], 0
    for m in CANDIDATE.finditer(text):
        while at < len(base) and base[at][2] <= m.start():
            at += 1
        parts, at = outside(m.start(), m.end(), base, at)
        least = LEAST if parts == [m.span()] else LEFT
        out += [(a, 3, b) for a, b in parts if best_part(table, text[a:b], threshold, least) > 0]
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each union of overlapping spans replaced by a mark."""
    out, at = [], 0
    for a, _, b in spans:
        if a >= at:
            out += [text[at:a], "[secret]"]
        at = max(at, b)
    return "".join([*out, text[at:]]) if spans else text


def default_samples(docs: DataFrame, id_col="doc_id", text_col="text", sample_docs: int = SAMPLE_DOCS, sample_strings: int = SAMPLE_STRINGS) -> list[tuple[str, bool]]:
    """Labelled samples: generated secrets; generated identifiers and long words, outside base spans, of a bounded sample of documents."""
    d = with_texts(docs, id_col, text_col)
    ids = d.where("doc_id is not null").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)
    rows = d.where(F.col("doc_id").isin([r["doc_id"] for r in ids.collect()]) & F.col("text").isNotNull())

    def words(batches):
        for batch in batches:
            found = []
            for t in batch.column(0).to_pylist():
                base = base_spans(t)
                found += [m[0] for m in re.finditer(r"[A-Za-z0-9+/_=-]{10,60}", t) if not any(c.isdigit() for c in m[0]) and not any(a < m.end() and b > m.start() for a, _, b in base)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], names=["w"])

    longest = rows.select("text").mapInArrow(words, "w string").distinct().orderBy(F.xxhash64("w"), "w").limit(sample_strings)
    ordinary = [r["w"] for r in longest.collect()] + identifiers(sample_strings)
    return [(s, True) for s in random_strings(sample_strings)] + [(s, False) for s in ordinary]


def _scanned(held, threshold, batches):
    table = held.value
    for batch in batches:
        for k in range(0, len(batch), 512):
            part = batch.slice(k, 512)
            rows = []
            for text in part.column(1).to_pylist():
                own = text or ""
                base = base_spans(own)
                spans = sorted(base + markov_spans(own, base, table, threshold))
                n = [sum(s[1] == kind for s in spans) for kind in range(4)]
                rows.append((n[0], n[1], n[2], hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), n[3], None if text is None else redact(own, spans)))
            cols = list(zip(*rows, strict=True))
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names=[f.split()[0] for f in SCANNED.split(", ")])


def scan(docs: DataFrame, samples: list[tuple[str, bool]] | None = None, threshold: float = THRESHOLD, id_col="doc_id", text_col="text") -> DataFrame:
    """One row per document: counts, spans in code points and the redacted text.

    Defined cases: a null or empty text has no spans, and its redacted text is null or empty; repeated documents are
    scanned each; spans that overlap are all listed and redacted as one; no rows give none. Other columns are not read.
    """
    held = docs.sparkSession.sparkContext.broadcast(fit_ratio(samples if samples is not None else default_samples(docs, id_col, text_col)))

    return with_texts(docs, id_col, text_col).mapInArrow(lambda batches: _scanned(held, threshold, batches), SCANNED)


def redacted(docs: DataFrame, samples: list[tuple[str, bool]] | None = None, threshold: float = THRESHOLD, id_col="doc_id", text_col="text", length_col: str | None = None) -> DataFrame:
    """The documents with their secrets masked and all their other columns; length_col, if given, follows a changed text."""
    held = docs.sparkSession.sparkContext.broadcast(fit_ratio(samples if samples is not None else default_samples(docs, id_col, text_col)))
    names = docs.columns

    def combine(own, found):
        changed = pc.not_equal(found["spans"], "")
        text = found["redacted"].cast(own.schema.field(text_col).type)
        if length_col:
            length = pc.utf8_length(found["redacted"]).cast(own.schema.field(length_col).type)
            own = own.set_column(names.index(length_col), length_col, pc.if_else(changed, length, own[length_col]))
        return own.set_column(names.index(text_col), text_col, pc.if_else(changed, text, own[text_col]))

    return carried(docs, [docs[text_col].cast("string")], lambda batches: _scanned(held, threshold, batches), combine)
