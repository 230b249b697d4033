"""SentencePiece encoding and decoding with a streaming Viterbi search.

The best segmentation is the one with the largest sum of piece scores. The search keeps
the nodes of the last ``longest piece`` positions only; when the paths of all of them run
through one boundary, the ids before it are final and are given out. So memory stays
bounded for a text of any length, spaces or not.

No piece holds a space after another character or, in most vocabularies, a line feed.
Where that is so, every path has a boundary there: the pieces of a word do not depend on
its neighbours and are remembered in a table of bounded size.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# Words whose ids a worker remembers before it starts over.
REMEMBERED = 500_000
# The search looks for a common boundary whenever so many positions are open.
OPEN_POSITIONS = 64
_UNKNOWN_LOSS = 10.0


@dataclass(frozen=True)
class Vocabulary:
    """Pieces with their scores; ``bytes_at`` is the id of the piece of byte 0."""

    pieces: list[str]
    ids: dict[str, tuple[int, float]]
    tree: dict  # the pieces by their characters; a piece's (id, score) under ""
    bytes_at: int
    byte_score: float
    longest: int
    own_words: bool = field(default=False)

    @classmethod
    def of(cls, pieces: list[tuple[str, float, bool]], bytes_at: int) -> Vocabulary:
        """From (piece, score, usable) in the order of ids; spaces are plain spaces."""
        ids: dict[str, tuple[int, float]] = {}
        for i, (piece, score, usable) in enumerate(pieces):
            if usable and piece:
                ids.setdefault(piece, (i, score))
        least = min((score for _, score in ids.values()), default=0.0)
        inner = any(" " in p.lstrip(" ") or "\n" in p for p in ids)
        longest = max(map(len, ids), default=1)
        texts = [piece for piece, _, _ in pieces]
        tree: dict = {}
        for piece, found in ids.items():
            node = tree
            for letter in piece:
                node = node.setdefault(letter, {})
            node[""] = found
        return cls(texts, ids, tree, bytes_at, least - _UNKNOWN_LOSS, longest, not inner)


def load(path: str) -> Vocabulary:
    """Reads a SentencePiece model with byte fallback; it is fixed-size and never trained."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    rows, bytes_at = [], -1
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if piece == "<0x00>":
            bytes_at = i
        special = model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)
        rows.append((piece.replace("▁", " "), model.get_score(i), not special))
    if bytes_at < 0:
        raise ValueError("The model has no byte pieces; texts could not be restored.")
    return Vocabulary.of(rows, bytes_at)


def viterbi(text: str, vocabulary: Vocabulary) -> Iterator[int]:
    """Ids of the best segmentation of ``text``, given out as soon as they are final.

    Equal sums go to the path whose last piece is longer. A character that is no piece
    costs a fixed score and gives the pieces of its UTF-8 bytes.
    """
    longest, size = vocabulary.longest, len(text)
    loss, none = vocabulary.byte_score, float("-inf")
    # Per position from ``base`` on: best sum, start of the last piece, its id (-1: bytes).
    base = 0
    sums, starts, last = [none] * (longest + 1), [0] * (longest + 1), [0] * (longest + 1)
    sums[0] = 0.0

    def path(to: int) -> list[int]:
        out, at = [], to
        while at > base:
            i = last[at - base]
            if i >= 0:
                out.append(i)
            else:
                raw = text[at - 1].encode("utf-8", "surrogatepass")
                out += [vocabulary.bytes_at + b for b in reversed(raw)]
            at = starts[at - base]
        out.reverse()
        return out

    for start in range(size):
        at = start - base
        so_far = sums[at]
        sums.append(none)
        starts.append(0)
        last.append(0)
        if so_far == none:
            continue
        if so_far + loss > sums[at + 1]:
            sums[at + 1], starts[at + 1], last[at + 1] = so_far + loss, start, -1
        node, to = vocabulary.tree, at
        for letter in text[start : start + longest]:
            node = node.get(letter)
            if node is None:
                break
            to += 1
            found = node.get("")
            if found is not None:
                total = so_far + found[1]
                # Longer pieces come first at any end; a piece is better than bytes.
                if total > sums[to] or (total == sums[to] and last[to] < 0):
                    sums[to], starts[to], last[to] = total, start, found[0]
        if at >= OPEN_POSITIONS and start % (OPEN_POSITIONS // 2) == 0:
            end = min(start + longest, size)
            open_nodes = {p for p in range(start + 1, end + 1) if sums[p - base] > none}
            while len(open_nodes) > 1:
                top = max(open_nodes)
                open_nodes.remove(top)
                open_nodes.add(starts[top - base])
            common = open_nodes.pop()
            if base < common <= start:
                yield from path(common)
                cut, base = common - base, common
                sums, starts, last = sums[cut:], starts[cut:], last[cut:]
    yield from path(size)


_UNITS = re.compile(r"\n| *[^ \n]+| +")


class _Remembered(dict):
    """Ids of words, as bytes of 32-bit numbers."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, unit: str) -> bytes:
        found = array("i", viterbi(unit, self.vocabulary)).tobytes()
        if len(unit) <= OPEN_POSITIONS:
            self[unit] = found
        return found


class Encoder:
    """Encodes and decodes texts; a text starts with one space that decoding drops."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary, self.known = vocabulary, _Remembered(vocabulary)
        first = vocabulary.bytes_at
        self.raw = [piece.encode("utf-8", "surrogatepass") for piece in vocabulary.pieces]
        self.raw[first : first + 256] = [bytes([b]) for b in range(256)]

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int32)
        if not self.vocabulary.own_words:
            return np.fromiter(viterbi(" " + text, self.vocabulary), np.int32)
        if len(self.known) > REMEMBERED:
            self.known.clear()
        units = _UNITS.findall(" " + text)
        return np.frombuffer(b"".join(map(self.known.__getitem__, units)), np.int32)

    def decode(self, ids: np.ndarray) -> str:
        raw = b"".join(map(self.raw.__getitem__, ids.tolist()))
        return raw.decode("utf-8", "surrogatepass")[1:]


_ENCODERS: dict[str, Encoder] = {}


def _encoder(shared) -> Encoder:
    """The encoder of this worker, which keeps its remembered words from task to task."""
    name = str(shared.value.bytes_at) + str(hash(tuple(shared.value.pieces)))
    if name not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[name] = Encoder(shared.value)
    return _ENCODERS[name]


def encode_rows(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``doc_id``, ``ids``, ``n_ids``, ``exact`` for every row of ``docs``.

    ``exact`` says that decoding ``ids`` gives back the text. A null or empty text has no
    ids and is exact as the empty text. Rows that repeat a doc_id are encoded one by one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # one vocabulary file

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared)
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                ids, exact = [], []
                for text in part.column("text").to_pylist():
                    ids.append(encoder.encode(text or ""))
                    exact.append(encoder.decode(ids[-1]) == (text or ""))
                sizes = np.array([len(x) for x in ids], np.int64)
                offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
                lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([*ids, np.zeros(0, np.int32)])))
                columns = [part.column("doc_id"), lists, pa.array(sizes), pa.array(exact)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "n_ids", "exact"])

    schema = "doc_id long, ids array<int>, n_ids long, exact boolean"
    return docs.select("doc_id", "text").mapInArrow(encoded, schema)


def decode_rows(rows: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``doc_id``, ``text`` from ``doc_id``, ``ids``; null ids give a null text."""
    shared = rows.sparkSession.sparkContext.broadcast(vocabulary)

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared)
        for batch in batches:
            lists = batch.column("ids").to_pylist()
            texts = [None if x is None else encoder.decode(np.array(x, np.int32)) for x in lists]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(decoded, "doc_id long, text string")
