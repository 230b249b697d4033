"""Suffix-array dedup: a distributed merge sort of suffixes that knows common prefixes.

A byte goes if a string of ``LENGTH`` bytes around it also starts in a document with a
smaller doc_id. To find these strings, suffixes of all documents are sorted:

1. Each string of ``LENGTH`` bytes picks an anchor, its ``GRAM``-byte string of least hash,
   so equal strings pick the same one and only anchors need a place in the suffix array.
   Anchors whose gram is in one document only are left out (`fingerprints`).
2. A task sorts its suffixes, from the anchor on, into a run; equal ones are settled on the
   spot but for those of the smallest document. Runs are front-coded (length of the prefix
   shared with the predecessor, and the rest), cut at sampled splitters and exchanged.
3. The runs of a range are merged by a loser tree whose nodes hold the length of the prefix
   shared with the last winner, so a known prefix is never compared again. The lengths it
   gives out are the common prefixes of neighbours in the suffix array.
4. From these and the bytes to the left of the anchors follows, for every string, the
   smallest document that has it.

A gram that alone fills a range, as one of a licence line in many documents does, would
meet in one task. Its strings are dealt out by a 128-bit hash of their bytes instead,
reduced to those of the smallest document before they are sent.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from liftline.llm import text as T
from liftline.llm.fingerprints import pack, repeated_fingerprints, total_bytes, unpack
from liftline.llm.shared import settle

LENGTH, GRAM = 50, 16
_OFFSETS = LENGTH - GRAM + 1  # places of an anchor in a string
_RIGHT, _LEFT = 56, 40  # bytes kept right and left of an anchor, in whole words
# A run is sorted when it has so many suffixes; a range is expected to hold so many.
RUN_SUFFIXES, RANGE_SUFFIXES = 400_000, 200_000
# Documents that are expected to give splitters; they only even out the ranges.
SPLITTER_DOCS, SPLITTERS_EACH = 2000, 32
# Suffixes of frequent grams that are turned to strings at a time; pieces they are dealt to
# for each range that such a gram fills.
HOT_SUFFIXES, HOT_PIECES = 50_000, 8

_NULL = -(2**63)


class Anchors:
    """Anchors of a slice: ``at``, ``text``, first and last string start, gram hash."""

    def __init__(self, piece: T.Slice) -> None:
        data, n = piece.data, len(piece.data)
        padded = np.concatenate([data, np.zeros(LENGTH + 8, np.uint8)])
        eight = np.lib.stride_tricks.sliding_window_view(padded, 8)[: n + GRAM].copy().view(np.uint64).ravel()
        h = T.mix(eight[:n] * T._PLACES[0] + eight[8 : n + 8] * T._PLACES[1])
        low = np.uint64((1 << max(1, n.bit_length())) - 1)
        # The place in the low bits: of equal hashes the leftmost is least.
        least, span = (h & ~low) | np.arange(n, dtype=np.uint64), 1
        while 2 * span <= _OFFSETS:
            least, span = np.minimum(least[:-span], least[span:]), 2 * span
        if span < _OFFSETS:
            least = np.minimum(least[: span - _OFFSETS], least[_OFFSETS - span :])
        strings = np.maximum(np.diff(piece.offsets) - LENGTH + 1, 0)
        start = T.gather(np.arange(n), piece.offsets[:-1], strings)
        owner = np.repeat(np.arange(piece.n), strings)
        at = (least[start] & low).astype(np.int64)
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1]) | (owner[1:] != owner[:-1])
        first = np.flatnonzero(new)
        self.at, self.text, self.first = at[first], owner[first], start[first]
        self.last = start[np.append(first[1:], len(start)) - 1] if len(first) else first
        self.hash = h[self.at]
        self.begin = np.searchsorted(self.text, np.arange(piece.n + 1))


def _grams(piece: T.Slice) -> tuple[np.ndarray, np.ndarray]:
    if len(piece.data) < LENGTH:
        return np.zeros(0, np.uint64), np.zeros(piece.n + 1, np.int64)
    anchors = Anchors(piece)
    return anchors.hash, anchors.begin


def _bytes_at(data: np.ndarray, at: np.ndarray, step: int, width: int, lengths: np.ndarray) -> np.ndarray:
    place = at[:, None] + step * np.arange(width)
    inside = np.arange(width) < lengths[:, None]
    return np.where(inside, data[np.clip(place, 0, len(data) - 1)], 0).astype(np.uint8)


def _words(rows: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(rows).view(">u8").astype(np.uint64)


_SENT = pa.schema(
    [("grp", pa.int64()), ("shape", pa.binary()), ("rest", pa.binary()), ("left", pa.binary()),
     ("where", pa.binary()), ("part", pa.int64()), ("found", pa.binary())]
)
_FOUND = pa.schema([("part", pa.int64()), ("found", pa.binary())])


def _answers(doc: np.ndarray, row: np.ndarray, start: np.ndarray, end: np.ndarray, parts: int) -> Iterator[dict]:
    """Ranges of string starts, joined where they touch, in one blob per part of the texts."""
    if len(doc) == 0:
        return
    order = np.lexsort((start, row, doc))
    doc, row, start, end = doc[order], row[order], start[order], end[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (row[1:] != row[:-1])
    # String starts of a text are far below 2^40, so later texts lie above earlier ones.
    lift = (np.cumsum(new) - 1) << 40
    reach = np.maximum.accumulate(end + lift) - lift
    cut = new.copy()
    cut[1:] |= start[1:] > reach[:-1] + 1
    begin = np.flatnonzero(cut)
    stop = np.append(begin[1:], len(doc)) - 1
    ranges = np.stack([doc[begin], row[begin], start[begin], reach[stop]])
    part = (T.mix(ranges[1].astype(np.uint64)) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    which, first = np.unique(part[order], return_index=True)
    for p, own in zip(which.tolist(), np.split(order, first[1:]), strict=True):
        yield {"part": p, "found": pack(ranges[:, own].ravel())}


def _by_text(table: pa.Table) -> pa.Table:
    """One row per text of a part, with all its ranges."""
    found = [unpack(blob).astype(np.int64).reshape(4, -1) for blob in table.column("found").to_pylist()]
    doc, row, first, last = np.concatenate(found, axis=1)
    order = np.lexsort((first, row, doc))
    doc, row, first, last = doc[order], row[order], first[order], last[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (row[1:] != row[:-1])
    begin = np.flatnonzero(new)
    blobs = [pa.array([pack(x) for x in np.split(values, begin[1:])], pa.binary()) for values in (first, last)]
    return pa.Table.from_arrays([pa.array(doc[begin]), pa.array(row[begin]), *blobs], ["doc", "row", "first", "last"])


def _string_codes(rights: np.ndarray, lefts: np.ndarray, factor: int) -> np.ndarray:
    """A hash of the string at each offset (rows) left of each anchor (columns)."""
    codes = np.zeros((_OFFSETS, len(rights)), np.uint64)
    times = np.uint64(factor)
    code = np.zeros(len(rights), np.uint64)
    for i in range(LENGTH):
        code = T.mix(code + (rights[:, i] + np.uint64(1)) * times)
        if i >= GRAM - 1:
            codes[LENGTH - 1 - i] = code
    code = np.zeros(len(rights), np.uint64)
    for offset in range(_OFFSETS):
        if offset:
            code = T.mix(code + (lefts[:, offset - 1] + np.uint64(1)) * times)
        codes[offset] = T.mix(codes[offset] + T.mix(code + np.uint64(offset)))
    return codes


def _later(codes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Whether an earlier document has the same string, by both rows of ``codes``."""
    order = np.lexsort((doc, codes[1], codes[0]))
    sorted_codes, docs = codes[:, order], doc[order]
    new = np.ones(len(doc), bool)
    new[1:] = (sorted_codes[:, 1:] != sorted_codes[:, :-1]).any(axis=0)
    smallest = docs[np.flatnonzero(new)][np.cumsum(new) - 1]
    later = np.zeros(len(doc), bool)
    later[order] = docs > smallest
    return later


def _hot_sent(suffixes: tuple[np.ndarray, ...], pieces: int, parts: int) -> Iterator[dict]:
    """The strings of suffixes of frequent grams, one block per piece, and what is settled here."""
    for begin in range(0, len(suffixes[0]), HOT_SUFFIXES):
        rights, right, lefts, left, doc, row, at = (x[begin : begin + HOT_SUFFIXES] for x in suffixes)
        offset = np.arange(_OFFSETS)[:, None]
        which, own = np.nonzero((right >= LENGTH - offset) & (left >= offset))
        codes = np.stack([_string_codes(rights, lefts, f)[which, own] for f in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)])
        doc, row, start = doc[own], row[own], at[own] - which
        gone = _later(codes, doc)
        for answer in _answers(doc[gone], row[gone], start[gone], start[gone], parts):
            yield answer | {"grp": -1 - answer["part"]}
        codes, doc, row, start = codes[:, ~gone], doc[~gone], row[~gone], start[~gone]
        piece = (codes[0] % np.uint64(pieces)).astype(np.int64)
        order = np.argsort(piece, kind="stable")
        found, first = np.unique(piece[order], return_index=True)
        for p, mine in zip(found.tolist(), np.split(order, first[1:]), strict=True):
            columns = [codes[0][mine], codes[1][mine], *[x[mine].astype(np.uint64) for x in (doc, row, start)]]
            yield {"grp": parts + p, "where": pack(np.concatenate(columns))}


def _hot_merged(blobs: list[bytes], parts: int) -> pa.Table:
    """What of the strings of a piece an earlier document has."""
    columns = np.concatenate([unpack(blob).reshape(5, -1) for blob in blobs], axis=1)
    doc, row, start = columns[2:].astype(np.int64)
    gone = _later(columns[:2], doc)
    return pa.Table.from_pylist(list(_answers(doc[gone], row[gone], start[gone], start[gone], parts)), schema=_FOUND)


class _Run:
    """Suffixes of a task, until there are enough to sort."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def add(self, piece: T.Slice, anchors: Anchors, picked: np.ndarray, doc: np.ndarray, row: np.ndarray) -> None:
        at, first, last = anchors.at[picked], anchors.first[picked], anchors.last[picked]
        text = anchors.text[picked]
        right = last + LENGTH - at
        base = piece.offsets[text]
        rights = _bytes_at(piece.data, at, 1, _RIGHT, right)
        lefts = _bytes_at(piece.data, at - 1, -1, _LEFT, at - first)
        self.parts.append((rights, right, lefts, at - first, doc[text], row[text], at - base))
        self.size += len(at)

    def sent(self, splitters: np.ndarray, hot: np.ndarray, pieces: int) -> Iterator[dict]:
        """Front-coded blocks, one per range, and what is settled here, one blob per part."""
        if self.size == 0:
            return
        rights, right, lefts, left, doc, row, at = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        words, other = _words(rights), _words(lefts)
        extra = left.astype(np.uint64)
        for k in range(other.shape[1]):
            extra = T.mix(extra + other[:, k])
        order = np.lexsort((doc, extra, right, *words.T[::-1]))
        rights, right, lefts, left, doc, row, at = (x[order] for x in (rights, right, lefts, left, doc, row, at))
        words, extra = words[order], extra[order]
        new = np.ones(len(doc), bool)
        new[1:] = (words[1:] != words[:-1]).any(axis=1) | (right[1:] != right[:-1]) | (extra[1:] != extra[:-1])
        smallest = doc[np.flatnonzero(new)][np.cumsum(new) - 1]
        # A string that a smaller document of this run has is settled here.
        gone = doc > smallest
        settled = _answers(doc[gone], row[gone], (at - left)[gone], (at + right - LENGTH)[gone], len(splitters) + 1)
        for answer in settled:
            yield answer | {"grp": -1 - answer["part"]}
        keep = ~gone
        frequent = keep & np.isin(np.ascontiguousarray(rights[:, :GRAM]).view(f"S{GRAM}").ravel(), hot)
        yield from _hot_sent(tuple(x[frequent] for x in (rights, right, lefts, left, doc, row, at)), pieces, len(splitters) + 1)
        keep &= ~frequent
        rights, right, lefts, left, doc, row, at = (x[keep] for x in (rights, right, lefts, left, doc, row, at))
        if len(doc) == 0:
            return
        # A block is front-coded from its own first suffix on.
        heads = np.ascontiguousarray(rights[:, :GRAM]).view(f"S{GRAM}").ravel()
        group = np.searchsorted(splitters, heads, "right")
        edge = np.ones(len(group), bool)
        edge[1:] = group[1:] != group[:-1]
        differ = np.ones((len(right), _RIGHT + 1), bool)
        differ[1:, :_RIGHT] = rights[1:] != rights[:-1]
        shared = differ.argmax(axis=1)
        shared[1:] = np.minimum(shared[1:], np.minimum(right[1:], right[:-1]))
        shared[edge] = 0
        column = np.arange(_RIGHT)
        rest = (column >= shared[:, None]) & (column < right[:, None])
        kept_left = np.arange(_LEFT) < left[:, None]
        bounds = np.append(np.flatnonzero(edge), len(group))
        for a, b in zip(bounds, bounds[1:], strict=False):
            shape = np.stack([shared[a:b], right[a:b], left[a:b]]).astype(np.uint64).ravel()
            texts, own = np.unique(np.stack([doc[a:b], row[a:b]]), axis=1, return_inverse=True)
            where = np.concatenate([[texts.shape[1]], texts.ravel(), own.ravel(), at[a:b]])
            yield {
                "grp": int(group[a]), "shape": pack(shape), "rest": _bytes(rights[a:b][rest[a:b]]),
                "left": _bytes(lefts[a:b][kept_left[a:b]]), "where": pack(where),
            }


def _bytes(values: np.ndarray) -> bytes:
    whole = np.frombuffer(values.tobytes() + bytes(-len(values) % 8), "<u8")
    return pack(np.concatenate([np.array([len(values)], np.uint64), whole]))


def _from_bytes(blob: bytes) -> np.ndarray:
    raw = unpack(blob)
    return raw[1:].view(np.uint8)[: int(raw[0])]


class LoserTree:
    """Merges sorted runs of byte strings, given with the prefixes shared by neighbours.

    ``shared[r]`` is what the head of run ``r`` shares with the string given out last. Of
    two heads, the one that shares more is smaller; only if they share the same are they
    compared, from there on, which tells how much the loser shares with the winner.
    """

    def __init__(self, runs: list[tuple[list[bytes], list[int]]]) -> None:
        self.runs = runs
        self.size = 1
        while self.size < len(runs):
            self.size *= 2
        self.head = [r[0][0] if r[0] else b"" for r in runs] + [b""] * (self.size - len(runs))
        self.shared = [0 if r[0] else -1 for r in runs] + [-1] * (self.size - len(runs))
        self.next = [1] * self.size
        self.loser = [0] * self.size
        self.winner = self._build(1) if self.size > 1 else 0

    def _build(self, node: int) -> int:
        if node >= self.size:
            return node - self.size
        winner, self.loser[node] = self._play(self._build(2 * node), self._build(2 * node + 1))
        return winner

    def _play(self, a: int, b: int) -> tuple[int, int]:
        """(winner, loser); a run that has ended shares -1 and loses."""
        n, m = self.shared[a], self.shared[b]
        if n != m or n < 0:
            return (a, b) if n >= m else (b, a)
        x, y = self.head[a], self.head[b]
        if n:
            x, y = x[n:], y[n:]
        size = min(len(x), len(y))
        odd = int.from_bytes(x[:size]) ^ int.from_bytes(y[:size])
        n += size - (odd.bit_length() + 7) // 8
        if x < y or (x == y and a < b):
            self.shared[b] = n
            return a, b
        self.shared[a] = n
        return b, a

    def __iter__(self) -> Iterator[tuple[int, int]]:
        """(run, prefix shared with the string before) in sorted order."""
        head, shared, following, loser, runs = self.head, self.shared, self.next, self.loser, self.runs
        winner, size = self.winner, self.size
        while shared[winner] >= 0:
            yield winner, shared[winner]
            strings, prefixes = runs[winner]
            at = following[winner]
            if at < len(strings):
                head[winner], shared[winner] = strings[at], prefixes[at]
                following[winner] = at + 1
            else:
                head[winner], shared[winner] = b"", -1
            node = (winner + size) // 2
            while node:
                other = loser[node]
                n, m = shared[winner], shared[other]
                if n < m:
                    winner, loser[node] = other, winner
                elif n == m and n >= 0:
                    winner, loser[node] = self._play(winner, other)
                node //= 2


def _decoded(shape: bytes, rest: bytes, left: bytes, where: bytes) -> tuple:
    shared, right, lefts = unpack(shape).astype(np.int64).reshape(3, -1)
    tail = _from_bytes(rest).tobytes()
    strings, last, at = [], b"", 0
    for n, size in zip(shared.tolist(), right.tolist(), strict=True):
        last = last[:n] + tail[at : at + size - n]
        at += size - n
        strings.append(last)
    flat = _from_bytes(left)
    matrix = np.zeros((len(strings), _LEFT), np.uint8)
    matrix[np.arange(_LEFT) < lefts[:, None]] = flat
    numbers = unpack(where).astype(np.int64)
    n, count = int(numbers[0]), len(strings)
    own = numbers[1 + 2 * n : 1 + 2 * n + count]
    doc, row = numbers[1 : 1 + n][own], numbers[1 + n : 1 + 2 * n][own]
    return strings, shared.tolist(), right, matrix, lefts, doc, row, numbers[1 + 2 * n + count :]


def _merge(table: pa.Table, parts: int) -> pa.Table:
    if table.column("grp")[0].as_py() < 0:  # settled inside a run
        return table.select(_FOUND.names)
    if table.column("grp")[0].as_py() >= parts:
        return _hot_merged(table.column("where").to_pylist(), parts)
    blocks = [_decoded(*x) for x in zip(*[table.column(c).to_pylist() for c in ("shape", "rest", "left", "where")], strict=True)]
    base = np.cumsum([0, *[len(b[0]) for b in blocks]])
    following = base[:-1].tolist()
    order, shared = np.zeros(base[-1], np.int64), np.zeros(base[-1], np.int64)
    for k, (run, n) in enumerate(LoserTree([(b[0], b[1]) for b in blocks])):
        order[k], shared[k] = following[run], n
        following[run] += 1
    right, matrix, left, doc, row, at = (np.concatenate([b[i] for b in blocks])[order] for i in range(2, 8))
    found = []
    code = np.zeros(len(order), np.uint64)
    for offset in range(_OFFSETS):
        # Strings that start ``offset`` bytes left of their anchor: equal if they share
        # the rest to the right and ``offset`` bytes to the left.
        if offset:
            code = T.mix(code + matrix[:, offset - 1] + np.uint64(1))
        depth = LENGTH - offset
        has = np.flatnonzero((right >= depth) & (left >= offset))
        if len(has) < 2:
            continue
        group = np.cumsum(shared < depth)[has].astype(np.uint64)
        key = T.mix(code[has] + T.mix(group))
        sort = np.argsort(key, kind="stable")
        key = key[sort]
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        begin = np.flatnonzero(new)
        docs = doc[has[sort]]
        smallest = np.minimum.reduceat(docs, begin)[np.cumsum(new) - 1]
        gone = has[sort[docs > smallest]]
        found.append((doc[gone], row[gone], at[gone] - offset))
    rows: list[dict] = []
    if found:
        docs, texts, start = (np.concatenate(x) for x in zip(*found, strict=True))
        rows = list(_answers(docs, texts, start, start, parts))
    return pa.Table.from_pylist(rows, schema=_FOUND)


def _sorted_runs(texts: DataFrame, splitters: np.ndarray, hot: np.ndarray, pieces: int) -> DataFrame:
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = _Run()

        def out() -> Iterator[pa.RecordBatch]:
            yield pa.RecordBatch.from_pylist(list(run.sent(splitters, hot, pieces)), schema=_SENT)

        for batch in batches:
            ids, rows = batch.column("doc").to_numpy(), batch.column("row").to_numpy()
            seen = batch.column("seen").to_pylist()
            for piece in T.slices(batch.column("text")):
                if len(piece.data) < LENGTH:
                    continue
                anchors = Anchors(piece)
                hit = np.zeros(len(anchors.at), bool)
                grams = anchors.hash >> np.uint64(16)
                for i in range(piece.n):
                    a, b = anchors.begin[i], anchors.begin[i + 1]
                    if b > a:
                        known = np.concatenate([unpack(blob) for blob in seen[piece.first + i]])
                        hit[a:b] = np.isin(grams[a:b], known)
                own = slice(piece.first, piece.first + piece.n)
                run.add(piece, anchors, np.flatnonzero(hit), ids[own], rows[own])
                if run.size >= RUN_SUFFIXES:
                    yield from out()
                    run = _Run()
        yield from out()

    schema = "grp long, shape binary, rest binary, `left` binary, `where` binary, part long, found binary"
    return texts.mapInArrow(send, schema)


def _splitters(texts: DataFrame, ranges: int, rows: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Grams that cut the suffixes into about equal ranges, from a bounded sample.

    Then those that fill a range by themselves, and the pieces for their strings.
    """
    parts = max(1, rows // SPLITTER_DOCS)

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in T.slices(batch.column("text")):
                if len(piece.data) >= LENGTH:
                    at = Anchors(piece)
                    picked = np.concatenate([np.arange(a, b, max(1, (b - a) // SPLITTERS_EACH)) for a, b in zip(at.begin, at.begin[1:], strict=False)])
                    rights = _bytes_at(piece.data, at.at[picked], 1, GRAM, np.full(len(picked), GRAM))
                    yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in rights], pa.binary())], ["head"])

    # Rows that are repeated count once: in a run they are one.
    some = texts.where(F.pmod("row", F.lit(parts)) == 0).dropDuplicates(["row"]).select("text")
    found = some.mapInArrow(heads, "head binary").toArrow().column("head").to_pylist()
    ordered = np.sort(np.array(found, f"S{GRAM}"))
    if len(ordered) == 0:
        return ordered, ordered, 1
    cuts, times = np.unique(ordered[np.unique(np.arange(1, ranges) * len(ordered) // ranges)], return_counts=True)
    return cuts, cuts[times > 1], max(1, HOT_PIECES * int((times - 1).sum()))


def repeated_bytes(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` and ``spans``.

    One row per row of ``doc_id``, ``text``; ``spans`` has the removed runs as byte ranges
    ``[start, end)``. Null counts as empty; a text below 50 bytes loses nothing. Rows that
    repeat a doc_id take nothing from each other. A null doc_id is below all others. More
    columns are ignored; an empty table gives an empty result.
    """
    texts = docs.select(F.coalesce("doc_id", F.lit(_NULL)).alias("doc"), F.coalesce("text", F.lit("")).alias("text"))
    # Rows are told by doc_id and text, so many null or repeated ids make no large group.
    texts = texts.withColumn("row", F.xxhash64("doc", "text"))
    size, rows = total_bytes(texts), texts.count()
    seen = settle(repeated_fingerprints(texts.select(F.col("row").alias("doc"), "text"), _grams, size, with_values=True), "grams")
    total = seen.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    splitters, hot, pieces = _splitters(texts, max(1, -(-total // RANGE_SUFFIXES)), rows)
    # Of equal rows all blocks give the same values.
    per_row = seen.groupBy(F.col("doc").alias("row")).agg(F.collect_set("vals").alias("seen"))
    sent = _sorted_runs(texts.join(per_row, "row"), splitters, hot, pieces)
    parts = len(splitters) + 1
    found = sent.groupBy("grp").applyInArrow(lambda table: _merge(table, parts), "part long, found binary")
    answers = found.groupBy("part").applyInArrow(_by_text, "doc long, row long, first binary, last binary")
    ranges = answers.groupBy("row").agg(F.collect_list(F.struct("doc", "first", "last")).alias("found"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, ids = batch.column("found").to_pylist(), batch.column("doc").to_pylist()
            out: list[tuple] = []
            for piece in T.slices(batch.column("text")):
                for i in range(piece.n):
                    data = piece.data[piece.offsets[i] : piece.offsets[i + 1]]
                    own = [x for x in found[piece.first + i] or [] if x["doc"] == ids[piece.first + i]]
                    out.append(_cut(data, own))
            columns = [batch.column("doc"), *[pa.array([r[k] for r in out], t) for k, t in enumerate(_CUT)]]
            yield pa.RecordBatch.from_arrays(columns, ["doc", *_CUT_NAMES])

    schema = "doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<long>"
    # On the key of the join above, so that texts are shuffled once.
    result = texts.join(ranges, "row", "left").mapInArrow(cut, schema)
    pairs = F.transform(
        F.sequence(F.lit(0), F.size("spans") - 2, F.lit(2)),
        lambda i: F.struct(F.get("spans", i).alias("start"), F.get("spans", i + 1).alias("end")),
    )
    spans = F.when(F.size("spans") > 0, pairs).otherwise(F.array().cast("array<struct<start:bigint,end:bigint>>"))
    doc = F.when(F.col("doc") > _NULL, F.col("doc")).alias("doc_id")
    return result.select(doc, "n_bytes", "n_removed", "n_spans", "kept_sha256", spans.alias("spans"))


_CUT = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64())]
_CUT_NAMES = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"]


def _cut(data: np.ndarray, found: list[dict]) -> tuple:
    if not found:
        return len(data), 0, 0, hashlib.sha256(data.tobytes()).hexdigest(), []
    first = np.concatenate([unpack(x["first"]) for x in found]).astype(np.int64)
    end = np.concatenate([unpack(x["last"]) for x in found]).astype(np.int64) + LENGTH
    order = np.argsort(first)
    first, end = first[order], np.maximum.accumulate(end[order])
    new = np.append(True, first[1:] > end[:-1])
    starts, ends = first[new], end[np.append(np.flatnonzero(new)[1:], len(first)) - 1]
    gone = np.zeros(len(data) + 1, np.int8)
    gone[starts], gone[ends] = 1, -1
    kept = data[np.cumsum(gone[:-1]) == 0]
    spans = np.column_stack([starts, ends]).ravel().tolist()
    return len(data), len(data) - len(kept), len(starts), hashlib.sha256(kept.tobytes()).hexdigest(), spans
