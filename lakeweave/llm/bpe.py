"""BPE encoding and decoding with content-defined chunk reuse.

A text is cut where a rolling hash of its last bytes says so, so that passages shared by documents give the same
chunks wherever they stand. Each distinct chunk is encoded once and kept in a bounded cache of the worker process,
which outlives its tasks. A cut may fall inside a word, so each join is repaired: from the last boundary in the left
chunk to the first one in the right chunk at which the two encodings must agree with the whole text's (places at which
a new pre-token always begins, see boundaries()), the seam is encoded again; where the chunks' tokens don't end exactly
there, the seam grows to the next such boundary, until they do. A text without any boundary is one chunk.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lakeweave.llm.common import with_texts
from lakeweave.llm.text import FOLDED, mix, powers, slices, string_buffers

ROLL = 24  # bytes of the rolling hash
MASK = (1 << 9) - 1  # cuts at one position in 512
CACHE_BYTES = 48 << 20
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # fixed: the vocabulary's public pre-tokenizer
SPECIAL = {b"<|endoftext|>": 50256}  # fixed: the vocabulary's special tokens
ENCODED = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
SPLIT = b"<|endoftext|>"
# Kinds of ASCII characters whose runs are pre-tokens: letters 1, digits 2, marks 3, a space 4; others are in no boundary.
_KIND = np.zeros(256, np.uint8)
_KIND[0x21:0x7F] = 3
_KIND[0x30:0x3A] = 2
_KIND[0x41:0x5B] = _KIND[0x61:0x7B] = 1
_KIND[0x20] = 4
_STARTS = np.zeros((5, 5), bool)  # where a kind follows another, a pre-token starts: at a space after anything else, and between other kinds
_STARTS[1:4, 4] = True
_STARTS[1:4, 1:4] = ~np.eye(3, dtype=bool)
_IDEOGRAPH = np.zeros(256, bool)
_IDEOGRAPH[0xE5:0xE9] = True  # first bytes of U+5000 to U+8FFF, all of them letters


def default_vocabulary() -> str:
    """The path of the public byte-level vocabulary as ranks, on this machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class Codec:
    """Encoder and decoder over one vocabulary, with the chunk cache."""

    def __init__(self, path: str, cache_bytes: int = CACHE_BYTES):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        pieces = [b""] * (max(max(ranks.values()), *SPECIAL.values()) + 1)
        for piece, rank in [*ranks.items(), *SPECIAL.items()]:
            pieces[rank] = piece
        self.pieces = pieces
        self.lengths = np.array([len(p) for p in pieces], np.int64)
        self.cache: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}
        self.cache_bytes, self.held = cache_bytes, 0
        self.encoded = self.reused = 0

    def plain(self, piece: bytes) -> np.ndarray:
        """Ids of whole characters; cuts and seams never part one."""
        return np.array(self.encoding.encode_ordinary(piece.decode()), np.uint32)

    def chunk(self, piece: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a chunk and the byte offsets at which they end; encoded once for as long as the cache holds it."""
        found = self.cache.get(piece)
        if found is None:
            ids = self.plain(piece)
            found = ids, np.cumsum(self.lengths[ids])
            self.encoded += 1
            cost = len(piece) + 12 * len(ids) + 300
            if self.held + cost > self.cache_bytes:
                self.cache.clear()
                self.held = 0
            self.cache[piece] = found
            self.held += cost
        else:
            self.reused += 1
        return found

    def encode(self, data: np.ndarray) -> np.ndarray:
        """The ids of a text, given as its UTF-8 bytes."""
        raw = data.tobytes()
        if SPLIT not in raw:
            return self._encode(raw, data)
        out, at = [], 0
        while (k := raw.find(SPLIT, at)) >= 0:
            out += [self._encode(raw[at:k], data[at:k]), np.array([SPECIAL[SPLIT]], np.uint32)]
            at = k + len(SPLIT)
        return np.concatenate([*out, self._encode(raw[at:], data[at:])])

    def _encode(self, raw: bytes, data: np.ndarray) -> np.ndarray:
        n = len(raw)
        if n == 0:
            return np.zeros(0, np.uint32)
        cuts = cut_points(data)
        if not len(cuts):
            return self.chunk(raw)[0]
        safe = boundaries(data)
        if not len(safe):
            return self.chunk(raw)[0]
        bounds = [0, *cuts.tolist(), n]
        chunks = [self.chunk(raw[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        inner = np.searchsorted(safe, cuts, "right")
        out: list[np.ndarray] = []
        trusted, current = 0, 0  # the text is encoded up to `trusted`, which lies in chunk `current`
        for k in range(len(cuts)):
            left = int(safe[inner[k] - 1]) if inner[k] else 0
            if left <= trusted and k > current or left < trusted:
                continue  # the seam before reaches over this cut
            a, (ids, ends) = bounds[k], chunks[k]
            lo = 0 if trusted == a else int(np.searchsorted(ends, trusted - a)) + 1
            hi = 0 if left <= a else int(np.searchsorted(ends, left - a)) + 1
            if left > a and ends[hi - 1] != left - a or left < a:
                left, hi = trusted, lo  # no agreement in the left chunk: all of it belongs to the seam
            if left > trusted:
                out.append(ids[lo:hi])
            j, right, at = inner[k], n, len(chunks)
            while j < len(safe):
                right = int(safe[j])
                at = int(np.searchsorted(cuts, right, "right"))
                ends = chunks[at][1]
                if right == bounds[at] or ends[np.searchsorted(ends, right - bounds[at])] == right - bounds[at]:
                    break
                j += 1
                right, at = n, len(chunks)
            if right > left:
                out.append(self.plain(raw[left:right]))
            trusted, current = right, at
        if trusted < n:
            a, (ids, ends) = bounds[-2], chunks[-1]
            out.append(ids[0 if trusted == a else int(np.searchsorted(ends, trusted - a)) + 1 :])
        return np.concatenate(out)

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids.tolist()))

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


def boundaries(data: np.ndarray) -> np.ndarray:
    """Places at which a new pre-token begins whatever stands before or behind.

    That is where ASCII characters of different kinds meet, but for what follows a space, which goes with it, or an
    apostrophe, which may be one of a contraction; and an ideographic comma or full stop after an ideograph.
    """
    kind = _KIND[data]
    found = _STARTS[kind[:-1], kind[1:]] & (data[:-1] != 0x27)
    if len(data) > 5 and (data >= 0xE5).any():
        first = data[3:-2]
        stop = (first == 0xE3) & (data[4:-1] == 0x80) & ((data[5:] == 0x81) | (data[5:] == 0x82)) | (first == 0xEF) & (data[4:-1] == 0xBC) & (data[5:] == 0x8C)
        found[2:-2] |= stop & _IDEOGRAPH[data[:-5]]
    return np.flatnonzero(found) + 1


def cut_points(data: np.ndarray) -> np.ndarray:
    """Content-defined cuts: where the hash of the last ROLL bytes, plain case folded, has its low bits zero; never inside a character."""
    n = len(data)
    if n <= ROLL:
        return np.zeros(0, np.int64)
    up, down = powers(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(FOLDED[data] * up[:n], out=total[1:])
    rolled = mix((total[ROLL:n] - total[: n - ROLL]) * down[: n - ROLL])
    cuts = np.flatnonzero((rolled & np.uint64(MASK)) == 0) + ROLL
    return cuts[(data[cuts] & 0xC0) != 0x80]


_codecs: dict[tuple[str, int], Codec] = {}


def codec(path: str, cache_bytes: int = CACHE_BYTES) -> Codec:
    """This process's codec for a vocabulary."""
    key = (path, cache_bytes)
    if key not in _codecs:
        _codecs[key] = Codec(path, cache_bytes)
    return _codecs[key]


def _encoded(path, cache_bytes, keep_ids, batches):
    own = codec(path, cache_bytes)
    for batch in batches:
        data, offsets = string_buffers(batch.column(1))
        for i, j in slices(offsets):
            rows = []
            for r in range(i, j):
                text = data[offsets[r] : offsets[r + 1]]
                ids = own.encode(text)
                decoded = own.decode_bytes(ids)
                rows.append((len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(decoded).hexdigest(), ids.astype(np.int32) if keep_ids else None))
            columns = [batch.column(0).slice(i, j - i), pa.array([x[0] for x in rows], pa.int64()), pa.array([x[1] for x in rows]), pa.array([x[2] for x in rows])]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                columns.append(pa.array([x[3] for x in rows], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)


def encode(docs: DataFrame, vocabulary: str | None = None, keep_ids: bool = False, id_col="doc_id", text_col="text", cache_bytes: int = CACHE_BYTES) -> DataFrame:
    """One row per document: the number and digest of its token ids, and the digest of what they decode to.

    `vocabulary` is a path that every machine has. With keep_ids the ids come too. Defined cases: a null text is as an
    empty one, with no tokens; a special token's string in a text is that token; repeated documents are encoded each;
    no rows give none. Other columns are not read.
    """
    path = vocabulary or default_vocabulary()
    schema = ENCODED + (", ids array<int>" if keep_ids else "")
    return with_texts(docs, id_col, text_col).mapInArrow(lambda batches: _encoded(path, cache_bytes, keep_ids, batches), schema)


def decode(encoded: DataFrame, vocabulary: str | None = None, id_col="doc_id", ids_col="ids") -> DataFrame:
    """Texts from token ids: (doc_id, text). A null list decodes to null, an empty one to the empty text."""
    path = vocabulary or default_vocabulary()

    def run(batches):
        own = codec(path)
        for batch in batches:
            texts = [None if x is None else own.decode(np.array(x, np.int64)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(encoded[id_col].alias("doc_id"), encoded[ids_col].alias("ids")).mapInArrow(run, "doc_id long, text string")
