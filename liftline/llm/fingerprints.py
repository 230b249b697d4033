"""Which fingerprints of a text also occur in another text, at a few bytes for each.

A task gathers the fingerprints of many texts, sorts them and sends each range of values
as one front-coded block: differences of sorted values, byte planes, compressed. A range
meets in one group, which sorts its parts of blocks and answers each block; the answers
to a block are put together into one row per text. A fingerprint is sent
once per block however many of its texts hold it, so a very frequent one reaches a group
once per block and not once per text.

Only 48 bits are kept. A chance match of two values can name a fingerprint as repeated
that is not; one that is repeated is always named. Callers check exactly afterwards.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from liftline.llm import text as T

# A block holds at most so many fingerprints and texts; a group is expected to hold those
# of so many bytes of text.
BLOCK_VALUES, BLOCK_TEXTS = 2_000_000, 60_000
GROUP_BYTES = 16 << 20
_MANY = 0xFFFF
_LOW = np.uint64(0xFFFF)
_16 = np.uint64(16)


_SMALL = 16
_ZIP, _UNZIP = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def pack(values: np.ndarray) -> bytes:
    """Compresses integers by planes of equal significance; a few are left as they are."""
    wide = np.ascontiguousarray(values.astype("<u8"))
    if len(wide) < _SMALL:
        return b"=" + wide.tobytes()
    return b"z" + _ZIP.compress(np.ascontiguousarray(wide.view(np.uint8).reshape(-1, 8).T).tobytes())


def unpack(blob: bytes) -> np.ndarray:
    if blob[:1] == b"=":
        return np.frombuffer(blob, "<u8", offset=1)
    planes = np.frombuffer(_UNZIP.decompress(blob[1:]), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").ravel()


class _Block:
    """Fingerprints of the texts gathered so far."""

    def __init__(self) -> None:
        self.docs: list[np.ndarray] = []
        self.values: list[np.ndarray] = []
        self.texts = self.size = 0

    def add(self, docs: np.ndarray, values: np.ndarray, begin: np.ndarray) -> None:
        owner = np.repeat(np.arange(self.texts, self.texts + len(docs), dtype=np.uint64), np.diff(begin))
        self.docs.append(docs)
        self.values.append((values & ~_LOW) | owner)
        self.texts += len(docs)
        self.size += len(values)

    def rows(self, groups: int, with_values: bool) -> Iterator[dict]:
        """Parts of the block, one per group, and the answer found inside."""
        if self.size == 0:
            return
        docs = np.concatenate(self.docs)
        packed = np.sort(np.concatenate(self.values))
        keep = np.ones(len(packed), bool)
        keep[1:] = packed[1:] != packed[:-1]
        packed = packed[keep]
        value, owner = packed >> _16, (packed & _LOW).astype(np.int64)
        same = np.zeros(len(value) + 1, bool)
        same[1:-1] = value[1:] == value[:-1]
        inside = same[:-1] | same[1:]
        # Blocks have different first values or texts; a task that runs again makes the same.
        number = int(T.mix(packed[:1] + T.mix(docs[:1].astype(np.uint64) + np.uint64(len(docs))))[0].astype(np.int64))
        if inside.any():
            own = _answer(docs, owner[inside], value[inside], with_values)
            yield {"grp": -1 - number % groups, "block": number} | own
        # A value of several texts goes on once, for the others to learn of it.
        first = ~same[:-1]
        value, owner = value[first], np.where(same[1:], _MANY, owner)[first]
        group = (value.astype(np.float64) * (groups / 2.0**48)).astype(np.int64)
        bounds = np.searchsorted(group, np.arange(groups + 1))
        for g in np.flatnonzero(np.diff(bounds)):
            part, own = value[bounds[g] : bounds[g + 1]], owner[bounds[g] : bounds[g + 1]]
            used = np.unique(own[own != _MANY])
            ids = docs[used]
            order = np.argsort(ids, kind="stable")
            rank = np.empty(len(used), np.int64)
            rank[order] = np.arange(len(used))
            short = np.where(own == _MANY, 0, 1 + rank[np.minimum(np.searchsorted(used, own), max(len(used) - 1, 0))]) if len(used) else np.zeros(len(own), np.int64)
            yield {
                "grp": int(g), "block": number, "docs": pack(_steps(ids[order])), "vals": pack(_steps(part)),
                "owners": pack(short),
            }


def _steps(values: np.ndarray) -> np.ndarray:
    return np.diff(values.astype(np.uint64), prepend=np.uint64(0))


def _answer(docs: np.ndarray, owner: np.ndarray, value: np.ndarray, with_values: bool) -> dict:
    """Texts with their numbers of values, and the values text by text."""
    order = np.argsort(owner, kind="stable")
    which, n = np.unique(owner[order], return_counts=True)
    values = pack(value[order]) if with_values else None
    return {"docs": pack(_steps(docs[which])), "owners": pack(n), "vals": values}


_PARTS = pa.schema([("grp", pa.int64()), ("block", pa.int64()), ("docs", pa.binary()), ("vals", pa.binary()), ("owners", pa.binary())])
_ANSWERS = pa.schema([("block", pa.int64()), ("docs", pa.binary()), ("vals", pa.binary()), ("owners", pa.binary())])
_TOTALS = pa.schema([("doc", pa.int64()), ("n", pa.int64()), ("vals", pa.binary())])


def repeated_fingerprints(
    docs: DataFrame,
    fingerprints: Callable[[T.Slice], tuple[np.ndarray, np.ndarray]],
    text_bytes: int,
    with_values: bool = False,
    group_bytes: int = GROUP_BYTES,
) -> DataFrame:
    """``doc``, ``n`` and ``vals``: how many and which fingerprints are in another text.

    ``docs`` has ``doc`` (long) and ``text``; ``fingerprints`` gives the 64-bit values of
    a slice and per text the index of its first. A text may have several rows, whose
    numbers add up; one without repeated fingerprints has none. ``vals`` holds the upper
    48 bits, packed, if asked for. Rows that share ``doc`` count as different texts.
    """
    groups = max(1, -(-text_bytes // group_bytes))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = _Block()

        def out() -> Iterator[pa.RecordBatch]:
            rows = list(block.rows(groups, with_values))
            yield pa.RecordBatch.from_pylist(rows, schema=_PARTS)

        for batch in batches:
            ids = batch.column("doc").to_numpy()
            for piece in T.slices(batch.column("text")):
                values, begin = fingerprints(piece)
                if block.size and (block.size + len(values) > BLOCK_VALUES or block.texts + piece.n > BLOCK_TEXTS):
                    yield from out()
                    block = _Block()
                for start in range(0, piece.n, BLOCK_TEXTS):
                    end = min(start + BLOCK_TEXTS, piece.n)
                    if block.texts + end - start > BLOCK_TEXTS:
                        yield from out()
                        block = _Block()
                    own = slice(piece.first + start, piece.first + end)
                    block.add(ids[own], values[begin[start] : begin[end]], begin[start : end + 1] - begin[start])
        yield from out()

    def answer(table: pa.Table) -> pa.Table:
        if table.column("grp")[0].as_py() < 0:  # answers found inside blocks
            return table.select(_ANSWERS.names)
        parts = [
            (row["block"], np.cumsum(unpack(row["docs"])), np.cumsum(unpack(row["vals"])), unpack(row["owners"]).astype(np.int64))
            for row in table.to_pylist()
        ]
        values = np.sort(np.concatenate([p[2] for p in parts]))
        twice = np.unique(values[1:][values[1:] == values[:-1]])
        rows = []
        for block, ids, value, owner in parts:
            if len(twice):
                at = np.minimum(np.searchsorted(twice, value), len(twice) - 1)
                hit = (twice[at] == value) & (owner > 0)
                if hit.any():
                    rows.append({"block": block} | _answer(ids.astype(np.int64), owner[hit] - 1, value[hit], with_values))
        return pa.Table.from_pylist(rows, schema=_ANSWERS)

    def total(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        docs = np.concatenate([np.cumsum(unpack(r["docs"])).astype(np.int64) for r in rows])
        n = np.concatenate([unpack(r["owners"]) for r in rows]).astype(np.int64)
        ids, own = np.unique(docs, return_inverse=True)
        sums = np.bincount(own, n, len(ids)).astype(np.int64)
        blobs = [None] * len(ids)
        if with_values:
            values = np.concatenate([unpack(r["vals"]) for r in rows])
            owner = np.repeat(own, n)
            order = np.lexsort((values, owner))
            values, owner = values[order], owner[order]
            # Texts that share ``doc`` in a block give their values once.
            new = np.ones(len(values), bool)
            new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
            values, owner = values[new], owner[new]
            blobs = [pack(part) for part in np.split(values, np.searchsorted(owner, np.arange(1, len(ids))))]
        return pa.Table.from_arrays([pa.array(ids), pa.array(sums), pa.array(blobs, pa.binary())], schema=_TOTALS)

    schema = "grp long, block long, docs binary, vals binary, owners binary"
    answers = "block long, docs binary, vals binary, owners binary"
    sent = docs.select("doc", "text").mapInArrow(send, schema)
    found = sent.groupBy("grp").applyInArrow(answer, answers)
    return found.groupBy("block").applyInArrow(total, "doc long, n long, vals binary")


def total_bytes(docs: DataFrame) -> int:
    return docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
