"""Piece encoding: against a whole-text search, streamed commits, and exact round trips."""

import random

import numpy as np
import pytest

from liftline.llm import pieces
from liftline.llm.queries import PIECE_MODEL
from liftline.llm.shared import prepare

TEXTS = [
    "Hello  world\n\nfoo", "  a", " été\n", " ", "\n", "ﬁ x\t", "a​b", "▁ ▁x", "日本語テキスト 😀", "<0x41> <s> </s>",
    "a" * 3000, "ab" * 900 + " " * 200, "word " * 300, "\0\0", "e" + "́" * 50,
]


def whole(text, vocabulary):
    """Every segmentation's best sum, with the whole text at hand: (sum, ids)."""
    best = [(0.0, [])]
    for end in range(1, len(text) + 1):
        raw = text[end - 1].encode()
        top = (best[-1][0] + vocabulary.byte_score, best[-1][1] + [vocabulary.bytes_at + b for b in raw])
        for n in range(1, min(vocabulary.longest, end) + 1):
            found = vocabulary.ids.get(text[end - n : end])
            if found is not None and best[end - n][0] + found[1] >= top[0]:
                top = (best[end - n][0] + found[1], best[end - n][1] + [found[0]])
        best.append(top)
    return best[-1][1]


@pytest.fixture(scope="module")
def real():
    return pieces.load(PIECE_MODEL)


def small(extra=()):
    letters = [(c, -9.0, True) for c in "abc "] + [("ab", -7.5, True), ("bca", -8.0, True), ("aa", -6.0, True), ("aaaa", -9.0, True)]
    rows = [(f"<0x{b:02X}>", 0.0, False) for b in range(256)] + letters + list(extra)
    return pieces.Vocabulary.of(rows, 0)


def test_same_as_whole_text_search(real):
    random.seed(1)
    own = small([(" a b", -10.0, True)])
    for _ in range(60):
        text = "".join(random.choice("aabc x") for _ in range(random.randint(0, 400)))
        assert list(pieces.viterbi(text, own)) == whole(text, own)
    encoder = pieces.Encoder(real)
    for text in TEXTS[:10]:
        assert encoder.encode(text).tolist() == whole(" " + text, real)


def test_ids_are_given_out_early():
    seen = []

    class Watched(str):
        def __getitem__(self, key):
            if isinstance(key, slice):
                seen.append(key.start)
            return str.__getitem__(self, key)

    stream = pieces.viterbi(Watched("ab c" * 5000), small())
    next(stream)
    assert max(seen) < 3 * pieces.OPEN_POSITIONS


def test_round_trip(real):
    encoder, random_ids = pieces.Encoder(real), random.Random(2)
    for _ in range(300):
        TEXTS.append("".join(chr(random_ids.choice([32, 10, 97, 98, 0x2581, 233, 0x4E2D, 0x1F600])) for _ in range(40)))
    for text in TEXTS:
        ids = encoder.encode(text)
        assert encoder.decode(ids) == text and ids.dtype == np.int32
    # A vocabulary whose pieces reach over spaces is searched text by text.
    assert not small([(" a b", -1.0, True)]).own_words
    assert pieces.Encoder(real).encode("").tolist() == []


def test_rows(spark, real):
    prepare(spark)
    rows = [(i, t, 5) for i, t in enumerate(TEXTS[:15])] + [(50, None, 1), (51, "", 1), (51, "twice", 1), (None, "x", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids long")
    encoded = pieces.encode_rows(docs, real)
    got = encoded.collect()
    assert len(got) == len(rows) and all(r.exact and r.n_ids == len(r.ids) for r in got)
    back = sorted((-1 if r.doc_id is None else r.doc_id, r.text) for r in pieces.decode_rows(encoded, real).collect())
    assert back == sorted((d if d is not None else -1, t or "") for d, t, _ in rows)
    assert pieces.encode_rows(docs.limit(0), real).collect() == []
