"""Language profiles and pre-token boundaries against plain versions."""

import random
import re

import numpy as np
import public_tokenizers
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lakeweave.llm import bpe, langid


def plain_vector(text, dimensions, seed):
    """The bundle of a text's trigrams, letter by letter."""
    letter = lambda c: np.random.default_rng([seed, ord(c) if c != " " else 0]).integers(0, 2, dimensions, dtype=np.int8).astype(int) * 2 - 1
    runs = "".join(c if c.isalpha() else " " for c in text.lower())
    runs = re.sub(" +", " ", f" {runs} ")
    total = np.zeros(dimensions, np.int64)
    for k in range(len(runs) - 2):
        a, b, c = (letter(x) for x in runs[k : k + 3])
        total += np.roll(a, 2) * np.roll(b, 1) * c
    return total


def test_profiles_are_bundles_of_bound_and_permuted_letters(spark):
    rng, dimensions = random.Random(3), 64
    texts = [" ".join("".join(rng.choice("abcçdé") for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(1, 12))) + rng.choice(["", ".", " 12", "!x"]) for _ in range(40)]
    docs = spark.createDataFrame([(k, t, "ab"[k % 2]) for k, t in enumerate(texts)], "doc_id long, text string, lang string")
    learn = ~langid.split_by_crc()
    held = {r["doc_id"] for r in docs.where(langid.split_by_crc()).collect()}
    found = langid.fit(docs, learn, dimensions=dimensions)
    want = {lang: sum(plain_vector(t, dimensions, langid.SEED) for k, t in enumerate(texts) if "ab"[k % 2] == lang and k not in held) for lang in "ab"}
    assert all((found[lang] == want[lang]).all() for lang in "ab")
    for r in langid.predict(docs, found, langid.split_by_crc(), dimensions=dimensions).collect():
        own = plain_vector(texts[r["doc_id"]], dimensions, langid.SEED)
        cosines = {lang: own @ v / np.linalg.norm(own) / np.linalg.norm(v) for lang, v in want.items()}
        best = max(cosines, key=cosines.get)
        assert abs(r["score"] - max(0, cosines[best])) < 1e-5 and (r["lang_pred"] == best or abs(cosines["a"] - cosines["b"]) < 1e-6)


PIECES = st.lists(st.sampled_from(["a", "B", "7", "²", "'", "'s", "'ll", "!", "<|", " ", "  ", "\n", "\t", "　", "é", "漢", "字", "か", "、", "。", "，", "😀", "\u0085", "_", "\x1c"]), max_size=60).map("".join)


@settings(max_examples=400, deadline=None)
@given(PIECES)
def test_a_pre_token_starts_at_every_boundary(text):
    data = np.frombuffer(text.encode(), np.uint8)
    starts = {len(text[: m.start()].encode()) for m in regex.finditer(bpe.PATTERN, text)}
    assert set(bpe.boundaries(data).tolist() if len(data) > 1 else []) <= starts


def test_long_ideographic_texts_are_encoded_once():
    library, rng = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), random.Random(4)
    sentence = lambda: "".join(chr(rng.randrange(0x5000, 0x8FFF)) for _ in range(rng.randint(5, 40))) + rng.choice("。，、")
    shared = "".join(sentence() for _ in range(500))
    own = bpe.Codec(bpe.default_vocabulary())
    for text in (shared, "始" + shared, shared.replace("。", "").replace("，", "").replace("、", "")):
        assert own.encode(np.frombuffer(text.encode(), np.uint8)).tolist() == library.encode(text, add_special_tokens=False).ids
    assert own.reused > 0.8 * len(bpe.cut_points(np.frombuffer(shared.encode(), np.uint8)))
