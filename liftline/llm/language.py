"""Language identification as a mixture of languages, fitted per document by EM.

Each language has smoothed likelihoods of byte trigrams around letters, hashed into a
fixed number of cells and counted over every labelled text. A document is a mixture of
languages; expectation-maximisation estimates its proportions. Starting from all
languages with a share that counts, the smallest one is dropped and the rest fitted again,
and the set with the best likelihood less a penalty per language is taken.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from liftline.llm import text as T

CELL_BITS = 14
SMOOTHING = 0.5
FIRST_ROUNDS, MORE_ROUNDS = 10, 6
# A language that is expected to have written fewer trigrams of a text is left out.
LEAST_TRIGRAMS = 1.0
UNKNOWN = "und"

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_SHOWN = np.where(_LETTER, T.FOLD, 32).astype(np.uint32)
_FACTORS = [np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D)]
_KEYS = [(_SHOWN + np.uint32(1)) * factor for factor in _FACTORS]
_EDGE = [np.uint32((33 * int(factor)) & 0xFFFFFFFF) for factor in _FACTORS]


def trigram_cells(piece: T.Slice) -> tuple[np.ndarray, np.ndarray]:
    """Text number and cell of every trigram whose middle byte is part of a letter."""
    data = piece.data
    if len(data) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    left, right = np.empty(len(data), np.uint32), np.empty(len(data), np.uint32)
    left[1:], right[:-1] = _KEYS[0][data[:-1]], _KEYS[2][data[1:]]
    starts = piece.offsets[:-1][np.diff(piece.offsets) > 0]
    left[starts] = _EDGE[0]
    right[piece.offsets[1:][np.diff(piece.offsets) > 0] - 1] = _EDGE[2]
    code = left + _KEYS[1][data] + right
    code ^= code >> np.uint32(15)
    code *= np.uint32(0x2C1B3C6D)
    middle = _LETTER[data]
    owner = np.repeat(np.arange(piece.n), np.diff(piece.offsets))
    return owner[middle], (code[middle] >> np.uint32(32 - CELL_BITS)).astype(np.int64)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = np.array(batch.column("lang").to_pylist(), object)
        for piece in T.slices(batch.column("text")):
            owner, cell = trigram_cells(piece)
            names, group = np.unique(langs[piece.first : piece.first + piece.n], return_inverse=True)
            both = np.bincount((group[owner] << CELL_BITS) | cell, minlength=len(names) << CELL_BITS)
            for name, row in zip(names, both.reshape(len(names), -1), strict=True):
                totals[name] = totals.get(name, 0) + row
    for name, row in totals.items():
        cells = np.flatnonzero(row)
        columns = [pa.array([name] * len(cells)), pa.array(cells), pa.array(row[cells])]
        yield pa.RecordBatch.from_arrays(columns, ["lang", "cell", "n"])


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    likelihood: np.ndarray  # cells x languages


def train(docs: DataFrame) -> LanguageModel:
    """Counts over every row of ``docs`` (``text``, ``lang``) with a language.

    The counts are summed on the cluster; the driver gets one number per cell and
    language, at most ``2 ** CELL_BITS`` per language.
    """
    rows = docs.where("lang is not null").select("text", "lang")
    counts = rows.mapInArrow(_counts, "lang string, cell long, n long")
    summed = counts.groupBy("lang", "cell").agg(F.sum("n").alias("n")).toArrow()
    known = rows.select("lang").distinct().toArrow().column("lang").to_pylist()
    languages = sorted(known, key=lambda name: name.encode())
    table = np.full((1 << CELL_BITS, len(languages)), SMOOTHING)
    where = {name: i for i, name in enumerate(languages)}
    column = np.array([where[name] for name in summed.column("lang").to_pylist()], np.int64)
    np.add.at(table, (summed.column("cell").to_numpy(), column), summed.column("n").to_numpy())
    return LanguageModel(languages, (table / table.sum(axis=0, keepdims=True)).astype(np.float32))


def _fit(p: np.ndarray, n: np.ndarray, owner: np.ndarray, w: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """EM: shares ``w`` per text and the log-likelihood. ``p``: rows x languages."""
    docs, langs = w.shape
    total = np.maximum(np.bincount(owner, n, docs), 1)[:, None]
    for step in range(rounds + 1):
        joint = p * w[owner]
        sums = np.maximum(joint.sum(axis=1), 1e-30)
        if step == rounds:
            return w, np.bincount(owner, n * np.log(sums), docs)
        ratio = (n / sums)[:, None] * joint
        w = np.column_stack([np.bincount(owner, ratio[:, k], docs) for k in range(langs)]) / total
    raise AssertionError


def mixtures(piece: T.Slice, likelihood: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per text the shares of all languages (a row of zeros without letters), and the size of the set."""
    langs = likelihood.shape[1]
    shares, size = np.zeros((piece.n, langs)), np.zeros(piece.n, np.int64)
    owner, cell = trigram_cells(piece)
    if len(owner) == 0 or langs == 0:
        return shares, size
    key, n = np.unique((owner << CELL_BITS) | cell, return_counts=True)
    owner, cell = key >> CELL_BITS, key & ((1 << CELL_BITS) - 1)
    n = n.astype(float)
    p = likelihood[cell]
    some = np.bincount(owner, n, piece.n)
    w = np.full((piece.n, langs), 1.0 / langs)
    w, _ = _fit(p, n, owner, w, FIRST_ROUNDS)
    first = w.argmax(axis=1)
    w = np.where(w * some[:, None] >= LEAST_TRIGRAMS, w, 0.0)
    w[np.arange(piece.n), first] += (w.sum(axis=1) == 0).astype(float)
    # As many columns as the text with most languages has; the others' shares are 0 there.
    present = (w > 0).sum(axis=1)
    keep = int(present.max())
    top = np.argsort(-w, axis=1, kind="stable")[:, :keep]
    w = np.take_along_axis(w, top, 1)
    p = np.take_along_axis(p, top[owner], 1)
    w /= w.sum(axis=1, keepdims=True)
    w, ll = _fit(p, n, owner, w, MORE_ROUNDS)
    penalty = 0.5 * np.log(np.maximum(some, 2))
    best, best_w, best_size = ll - penalty * (present - 1), w, present.copy()
    for left in range(keep - 1, 0, -1):
        # A share of 0 stays 0 through EM, so dropping a language is clearing its share.
        more = present > left
        w, before = w.copy(), w
        w[more, np.where(w > 0, w, np.inf).argmin(axis=1)[more]] = 0
        w = np.where(w.sum(axis=1, keepdims=True) > 0, w, before)
        w /= np.maximum(w.sum(axis=1, keepdims=True), 1e-30)
        w, ll = _fit(p, n, owner, w, MORE_ROUNDS if left > 1 else 0)
        better = more & (ll - penalty * (left - 1) > best)
        best = np.where(better, ll - penalty * (left - 1), best)
        best_w = np.where(better[:, None], w, best_w)
        best_size = np.where(better, left, best_size)
    np.put_along_axis(shares, top, best_w, 1)
    shares[some == 0] = 0
    size[:] = np.where(some > 0, best_size, 0)
    return shares, size


def _has_letter(data: np.ndarray) -> bool:
    ascii_part = data[data < 128]
    if _LETTER[ascii_part].any():
        return True
    return len(ascii_part) < len(data) and any(map(str.isalpha, data.tobytes().decode("utf-8", "replace")))


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``doc_id``, ``lang_pred``, ``score``, ``n_langs`` for every row of ``docs``.

    ``lang_pred`` has the largest share of the whole text, ``score`` is that share and
    ``n_langs`` the number of languages taken. Null texts, texts without a letter, and
    any text if no language was learned are ``und`` with score 0. Equal shares go to the
    first language by code point. Rows that repeat a doc_id are judged one by one.
    """
    likelihood, languages = model.likelihood, [*model.languages, UNKNOWN]

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores, sizes = [], [], []
            for piece in T.slices(batch.column("text")):
                shares, size = mixtures(piece, likelihood)
                for i in np.flatnonzero(size > 0):
                    # Bytes of other scripts and signs are letters to the trigrams.
                    own = piece.data[piece.offsets[i] : piece.offsets[i + 1]]
                    if not _has_letter(own[:64]) and not _has_letter(own):
                        size[i] = 0
                if shares.shape[1] == 0:
                    shares = np.zeros((piece.n, 1))
                best = np.where(size > 0, shares.argmax(axis=1), len(languages) - 1)
                names += [languages[i] for i in best]
                scores.append(np.where(size > 0, np.clip(shares.max(axis=1), 0, 1), 0.0))
                sizes.append(size)
            columns = [
                batch.column("doc_id"), pa.array(names, pa.string()),
                pa.array(np.concatenate([*scores, np.zeros(0)])),
                pa.array(np.concatenate([*sizes, np.zeros(0, np.int64)])),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "lang_pred", "score", "n_langs"])

    schema = "doc_id long, lang_pred string, score double, n_langs long"
    return docs.select("doc_id", "text").mapInArrow(judged, schema)
