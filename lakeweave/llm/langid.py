"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1 (seeded by its code point). A trigram is the product of its letters'
vectors, the first permuted twice and the second once, so that order counts. A text's vector is the bundle (sum) of
its trigrams, a language's prototype the bundle of its learning texts, and the nearest prototype by cosine wins.

Prototypes are summed in the tasks and then by Spark, one row for each dimension, so what reaches the driver is the
number of languages times the dimensions, whatever the corpus. Sums are of integers and don't depend on task order.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMENSIONS = 1024
SEED = 20
CACHED_GRAMS = 20_000
ROWS = 96
UNKNOWN = "und"
PREDICTED = "doc_id long, held_out boolean, lang_pred string, score double"

_alpha: dict[str, np.ndarray] = {}


def alphabetic() -> np.ndarray:
    """Which code points are letters."""
    if "t" not in _alpha:
        _alpha["t"] = np.array([chr(i).isalpha() for i in range(0x110000)])
    return _alpha["t"]


class Space:
    """Letter and trigram vectors; of trigrams a bounded number is kept."""

    def __init__(self, dimensions: int = DIMENSIONS, seed: int = SEED):
        self.dimensions, self.seed = dimensions, seed
        self.letters: dict[int, np.ndarray] = {}
        self.clear()

    def clear(self) -> None:
        self.grams = np.zeros(0, np.int64)
        self.vectors = np.zeros((0, self.dimensions), np.int8)

    def letter(self, code: int) -> np.ndarray:
        v = self.letters.get(code)
        if v is None:
            v = (np.random.default_rng([self.seed, code]).integers(0, 2, self.dimensions, dtype=np.int8) * 2 - 1).astype(np.int8)
            if len(self.letters) > CACHED_GRAMS:
                self.letters.clear()
            self.letters[code] = v
        return v

    def bind(self, gram: int) -> np.ndarray:
        a, b, c = gram >> 42, gram >> 21 & 0x1FFFFF, gram & 0x1FFFFF
        return np.roll(self.letter(a), 2) * np.roll(self.letter(b), 1) * self.letter(c)

    def of(self, grams: np.ndarray) -> np.ndarray:
        """Vectors of sorted distinct trigrams."""
        at = np.searchsorted(self.grams, grams)
        known = at < len(self.grams)
        known[known] = self.grams[at[known]] == grams[known]
        if not known.all():
            new = grams[~known]
            if len(self.grams) + len(new) > CACHED_GRAMS:
                self.clear()
                if len(new) < len(grams):
                    return self.of(grams)
            vectors = np.array([self.bind(g) for g in new.tolist()], np.int8)
            if len(new) > CACHED_GRAMS:
                return vectors
            order = np.argsort(np.concatenate([self.grams, new]), kind="stable")
            self.grams = np.concatenate([self.grams, new])[order]
            self.vectors = np.concatenate([self.vectors, vectors])[order]
            at = np.searchsorted(self.grams, grams)
        return self.vectors[at]


_spaces: dict[tuple[int, int], Space] = {}


def space(dimensions: int, seed: int) -> Space:
    """This process's space."""
    return _spaces.setdefault((dimensions, seed), Space(dimensions, seed))


def text_grams(text: str | None) -> np.ndarray:
    """The letter trigrams of a text in order; runs of anything else count as one gap, as do both ends."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    letter = alphabetic()[codes] if len(codes) else np.zeros(0, bool)
    if not letter.any():
        return np.zeros(0, np.int64)
    codes = np.where(letter, codes, 0)
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    padded = np.concatenate(([0], codes[keep], [0]))
    if padded[1] == 0:
        padded = padded[1:]
    if padded[-2] == 0:
        padded = padded[:-1]
    return (padded[:-2] << 42) | (padded[1:-1] << 21) | padded[2:]


def _parts(texts: list[str | None]):
    """Runs of rows of about equal text."""
    begin, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t or "")
        if i + 1 - begin >= ROWS or held > 1 << 20:
            yield begin, i + 1
            begin, held = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def fit(docs: DataFrame, learn: Column, text_col="text", lang_col="lang", dimensions: int = DIMENSIONS, seed: int = SEED) -> dict[str, np.ndarray]:
    """The prototype of each non-null language over all rows for which `learn` holds."""

    def run(batches):
        own, sums = space(dimensions, seed), {}
        for batch in batches:
            texts, langs = batch.column(0), batch.column(1).to_pylist()
            for i in range(0, len(langs), 512):
                part, held = texts.slice(i, 512).to_pylist(), {}
                for k, t in enumerate(part):
                    held.setdefault(langs[i + k], []).append(text_grams(t))
                for lang, grams in held.items():
                    distinct, counts = np.unique(np.concatenate(grams), return_counts=True)
                    total = sums.setdefault(lang, np.zeros(dimensions, np.int64))
                    for k in range(0, len(distinct), 4096):
                        total += counts[k : k + 4096] @ own.of(distinct[k : k + 4096]).astype(np.int64)
        for lang, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * dimensions), pa.array(np.arange(dimensions, dtype=np.int32)), pa.array(total)], names=["lang", "i", "v"])

    rows = docs.where(learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    out: dict[str, np.ndarray] = {}
    for r in rows.mapInArrow(run, "lang string, i int, v long").groupBy("lang", "i").agg(F.sum("v").alias("v")).toLocalIterator():
        out.setdefault(r["lang"], np.zeros(dimensions))[r["i"]] = r["v"]
    return {k: v for k, v in sorted(out.items()) if np.any(v)}


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], held_out: Column, id_col="doc_id", text_col="text", dimensions: int = DIMENSIONS, seed: int = SEED) -> DataFrame:
    """One row per document: the nearest prototype's language and its cosine, negative ones as 0.

    Defined cases: a null text, or one without a letter, is `und` with 0, as is every text if nothing was learned;
    ties go to the language first in order; repeated documents are judged each. Other columns are not read.
    """
    names = sorted(prototypes)
    unit = np.array([prototypes[k] / np.linalg.norm(prototypes[k]) for k in names]).reshape(len(names), dimensions)
    held = docs.sparkSession.sparkContext.broadcast(unit)

    def run(batches):
        own, unit = space(dimensions, seed), held.value
        for batch in batches:
            texts = batch.column(1)
            for begin in range(0, len(texts), 1024):
                some = texts.slice(begin, 1024).to_pylist()
                for i, j in _parts(some):
                    parts = [np.unique(text_grams(t), return_counts=True) for t in some[i:j]]
                    distinct = np.unique(np.concatenate([g for g, _ in parts]))
                    vectors = np.zeros((j - i, dimensions))  # products of a block are exact in single precision below 2**24 trigrams of a text
                    for k in range(0, len(distinct), 8192):
                        block = distinct[k : k + 8192]
                        counts = np.zeros((j - i, len(block)), np.float32)
                        for r, (g, c) in enumerate(parts):
                            inside = slice(*np.searchsorted(g, [block[0], block[-1] + 1]))
                            counts[r, np.searchsorted(block, g[inside])] = c[inside]
                        vectors += counts @ own.of(block).astype(np.float32)
                    length = np.linalg.norm(vectors, axis=1)
                    cosines = (vectors @ unit.T) / np.maximum(length, 1e-9)[:, None] if names else np.zeros((j - i, 1))
                    best = cosines.argmax(axis=1)
                    some_letter = np.array([len(g) > 0 for g, _ in parts]) & bool(names)
                    score = np.where(some_letter, np.clip(cosines[np.arange(j - i), best], 0, 1), 0.0)
                    at = begin + i
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(at, j - i), batch.column(2).slice(at, j - i), pa.array([names[b] if ok else UNKNOWN for b, ok in zip(best, some_letter, strict=True)]), pa.array(np.round(score.astype(np.float64), 6))],
                        names=["doc_id", "held_out", "lang_pred", "score"],
                    )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), held_out.alias("held_out"))
    return rows.mapInArrow(run, PREDICTED)


def split_by_crc(id_col="doc_id") -> Column:
    """True for the held-out quarter: crc32 of the id as text modulo 4 is 2; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, id_col="doc_id", text_col="text", lang_col="lang", dimensions: int = DIMENSIONS, seed: int = SEED) -> DataFrame:
    """Learn from the rows that aren't held out and predict all of them; cases as in fit() and predict()."""
    held_out = split_by_crc(id_col)
    return predict(docs, fit(docs, ~held_out, text_col, lang_col, dimensions, seed), held_out, id_col, text_col, dimensions, seed)
