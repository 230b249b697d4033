"""Embedding near-dedup with spherical-cap filters from random product codes.

A filter is a direction, and its cap holds the vectors that it is one of the nearest
directions of. Directions are products: one code word per block of coordinates, so that the
nearest ones of a vector are listed from the nearest words of each block, without trying
every direction. Of few dimensions a vector is in all caps whose inner product exceeds a
threshold, listed by extending partial words whose best completion still exceeds it.

Caps go through one exchange as sorted numbers, a few bytes each, which tells the caps that
two vectors share. Directions are so many that vectors share one by chance seldom. What
caps connect is brought together, each vector once, and compared by exact cosine; a
component that is too large for that is compared cap by cap.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from statistics import NormalDist

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from liftline.llm import text as T
from liftline.llm.fingerprints import _steps, pack, unpack
from liftline.llm.shared import components, contracted, settle

COSINE = 0.98
# A vector is in about so many caps; for a cosine of 0.98 two vectors share most of them.
CAPS = 16
# How far below the nearest direction the threshold lies at least, as CAPS is for an
# average vector: some standard deviations of the change to a vector at cosine 0.98.
MARGIN = 0.6
# There are directions enough for about so many vectors of a group in one cap.
CAP_VECTORS = 32
LEAST_DIRECTIONS = 4096
MOST_WORDS = 512
# From so many dimensions on, a vector takes its nearest directions of each of several codes. In
# a simulation with six of each, one pair of 40,000 at a cosine of 0.98 shared none. There are
# so many directions per vector, as far as words and dimensions allow.
LEAST_DIM = 12
CODES, NEAREST = 5, 7
DIRECTIONS_PER_VECTOR = 2000
# A cell with more vectors is compared in pieces of this size, every two of them once.
PIECE = 1024
# A component of more pieces is compared cap by cap.
MOST_PIECES = 16
# Caps that a task sends at once, and that meet in a group of the exchange.
BLOCK_CAPS, GROUP_CAPS = 2_000_000, 1_000_000
# A group of cells is expected to have about so many vectors; there are so many tasks at most.
GROUP_ROWS, MOST_TASKS = 8192, 10_000


@dataclass(frozen=True)
class ProductCode:
    """``blocks`` blocks with ``words`` code words each; fixed by its numbers alone."""

    blocks: int
    words: int
    threshold: float  # of the inner product with a unit direction, times sqrt(dimension)

    @classmethod
    def for_size(cls, vectors: int, caps: int = CAPS) -> ProductCode:
        wanted = max(LEAST_DIRECTIONS, vectors * caps // CAP_VECTORS)
        blocks = max(2, math.ceil(math.log(wanted) / math.log(MOST_WORDS)))
        words = math.ceil(wanted ** (1 / blocks))
        return cls(blocks, words, NormalDist().inv_cdf(1 - caps / words**blocks))

    @cache  # noqa: B019 - codes are few and live as long as the worker
    def directions(self, dim: int) -> list[tuple[slice, np.ndarray]]:
        """Coordinates and code words of each block, after a rotation of all of them."""
        rng = np.random.default_rng([dim, self.blocks, self.words])
        rotation = np.linalg.qr(rng.normal(size=(dim, dim)))[0]
        blocks = min(self.blocks, dim)
        out = []
        for part in np.array_split(np.arange(dim), blocks):
            word = rng.normal(size=(self.words, len(part)))
            word /= np.linalg.norm(word, axis=1, keepdims=True)
            out.append((rotation[:, part[0] : part[-1] + 1], word / math.sqrt(blocks)))
        return out

    def caps_of(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers and filter numbers of all caps of the unit vectors, in order."""
        dim = unit.shape[1]
        products = [(unit @ rotation) @ word.T for rotation, word in self.directions(dim)]
        best = [p.max(axis=1) for p in products]
        # A vector far from all directions takes those about as near as its nearest one.
        needed = np.minimum(self.threshold, sum(best) * math.sqrt(dim) - MARGIN) / math.sqrt(dim)
        row, word, score = np.arange(len(unit)), np.zeros(len(unit), np.int64), np.zeros(len(unit))
        for k, p in enumerate(products):
            rest = sum((b[row] for b in best[k + 1 :]), start=np.zeros(len(row)))
            total = score[:, None] + p[row]
            at, next_word = np.nonzero(total + rest[:, None] >= needed[row, None])
            row, word, score = row[at], word[at] * self.words + next_word, total[at, next_word]
        order = np.lexsort((word, row))
        return row[order], word[order]


@dataclass(frozen=True)
class NearestCode:
    """``codes`` product codes of ``words`` words a block; a vector takes the ``nearest`` directions of each."""

    words: int
    blocks: int = 3
    codes: int = CODES
    nearest: int = NEAREST

    @classmethod
    def for_size(cls, vectors: int, dim: int) -> NearestCode:
        wanted = max(LEAST_DIRECTIONS, vectors * DIRECTIONS_PER_VECTOR)
        blocks = 3 if wanted <= (2 * MOST_WORDS) ** 3 else 4
        words = min(math.ceil(wanted ** (1 / blocks)), 2 * MOST_WORDS, dim * dim // 4)
        return cls(words, blocks)

    @cache  # noqa: B019 - codes are few and live as long as the worker
    def directions(self, dim: int, code: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Rotated coordinates and code words of each block."""
        rng = np.random.default_rng([dim, self.blocks, self.words, code])
        rotation = np.linalg.qr(rng.normal(size=(dim, dim)))[0]
        out = []
        for part in np.array_split(np.arange(dim), self.blocks):
            word = rng.normal(size=(self.words, len(part)))
            out.append((rotation[:, part], (word / np.linalg.norm(word, axis=1, keepdims=True)).T))
        return out

    @cache  # noqa: B019
    def places(self) -> np.ndarray:
        """Ranks of words in their blocks that one of the nearest directions can have."""
        ranks = np.indices((self.nearest,) * self.blocks).reshape(self.blocks, -1).T
        # All products of words at least as near are at least as near.
        return ranks[(ranks + 1).prod(axis=1) <= self.nearest]

    def caps_of(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers and filter numbers of the caps of the unit vectors, in order of rows."""
        places, found = self.places(), []
        for code in range(self.codes):
            score = np.zeros((len(unit), len(places)))
            number = np.full((len(unit), len(places)), code, np.int64)
            for k, (rotation, word) in enumerate(self.directions(unit.shape[1], code)):
                p = (unit @ rotation) @ word
                best = np.argpartition(-p, self.nearest - 1, axis=1)[:, : self.nearest]
                value = np.take_along_axis(p, best, 1)
                order = np.argsort(-value, axis=1, kind="stable")
                best, value = np.take_along_axis(best, order, 1), np.take_along_axis(value, order, 1)
                score += value[:, places[:, k]]
                number = number * self.words + best[:, places[:, k]]
            nearest = np.argpartition(-score, self.nearest - 1, axis=1)[:, : self.nearest]
            found.append(np.take_along_axis(number, nearest, 1))
        caps = np.concatenate(found, axis=1)
        return np.repeat(np.arange(len(unit)), caps.shape[1]), caps.ravel()


def _units(lists: pa.ListArray, dim: int) -> np.ndarray:
    x = lists.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


_SENT = pa.schema([("grp", pa.int64()), ("caps", pa.binary()), ("cls", pa.binary())])
_SHARED = pa.schema([("cls", pa.int64()), ("cap", pa.int64()), ("least", pa.int64())])


def _caps(batch: pa.RecordBatch, vectors: int, caps: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Classes and 48-bit numbers of caps; those of different labels or dimensions differ."""
    dims = pc.list_value_length(batch.column("vector")).to_numpy()
    cls, salt = (batch.column(name).to_numpy() for name in ("cls", "salt"))
    for dim in np.unique(dims).tolist():
        code = ProductCode.for_size(vectors, caps) if dim < LEAST_DIM else NearestCode.for_size(vectors, dim)
        same = np.flatnonzero(dims == dim)
        for start in range(0, len(same), 256):
            picked = same[start : start + 256]
            row, cap = code.caps_of(_units(batch.column("vector").take(pa.array(picked)), dim))
            own = T.mix(salt[picked].astype(np.uint64) + np.uint64(dim))
            yield cls[picked][row], T.mix(cap.astype(np.uint64) + own[row]) >> np.uint64(16)


def _sent(vectors: int, caps: int, groups: int):
    """Caps of a task's vectors, sorted: one row per range of their numbers."""

    def rows(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        cls, cap = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(cap, kind="stable")
        cls, cap = cls[order], cap[order]
        group = (cap.astype(np.float64) * (groups / 2.0**48)).astype(np.int64)
        bounds = np.searchsorted(group, np.arange(groups + 1))
        some = np.flatnonzero(np.diff(bounds))
        each = [(int(g), pack(_steps(cap[bounds[g] : bounds[g + 1]])), cls[bounds[g] : bounds[g + 1]].tobytes()) for g in some]
        return pa.RecordBatch.from_pylist([dict(zip(_SENT.names, x, strict=True)) for x in each], schema=_SENT)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for batch in batches:
            for part in _caps(batch, vectors, caps):
                parts.append(part)
                size += len(part[0])
                if size >= BLOCK_CAPS:
                    yield rows(parts)
                    parts, size = [], 0
        if parts:
            yield rows(parts)

    return send


def _met(table: pa.Table) -> pa.Table:
    """Of a range of caps those that two classes share, with the least class of each."""
    cap = np.concatenate([np.cumsum(unpack(x)) for x in table.column("caps").to_pylist()]).astype(np.int64)
    cls = np.concatenate([np.frombuffer(x, np.int64) for x in table.column("cls").to_pylist()])
    order = np.lexsort((cls, cap))
    cls, cap = cls[order], cap[order]
    new = np.ones(len(cap), bool)
    new[1:] = (cls[1:] != cls[:-1]) | (cap[1:] != cap[:-1])
    cls, cap = cls[new], cap[new]
    first = np.ones(len(cap), bool)
    first[1:] = cap[1:] != cap[:-1]
    run = np.cumsum(first) - 1
    shared = np.bincount(run)[run] > 1
    least = cls[first][run]
    return pa.Table.from_arrays([pa.array(x[shared]) for x in (cls, cap, least)], schema=_SHARED)


def _forest(linked: np.ndarray) -> Iterator[tuple[int, int]]:
    """Links that connect whatever ``linked`` (square, symmetric) connects."""
    open_rows = linked.any(axis=1)
    while open_rows.any():
        first = int(np.flatnonzero(open_rows)[0])
        open_rows[first] = False
        stack = [first]
        while stack:
            at = stack.pop()
            for other in np.flatnonzero(linked[at] & open_rows).tolist():
                open_rows[other] = False
                stack.append(other)
                yield at, other


_FOUND = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])


def _compared(cosine: float):
    """Links of the cells of a group: piece ``left`` of a cap against ``right``, or within one."""

    def compare(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        names = ["label", "dim", "cap", "left", "right"]
        order = pc.sort_indices(table, [(name, "ascending") for name in names])
        table = table.take(order).combine_chunks()
        new = np.zeros(len(table), bool)
        new[0] = True
        for name in names:
            values = table.column(name).to_numpy()
            new[1:] |= values[1:] != values[:-1]
        begin = np.flatnonzero(new)
        cells = zip(begin, np.append(begin[1:], len(table)), strict=True)
        return pa.concat_tables([compare_cell(table.slice(a, b - a)) for a, b in cells])

    def compare_cell(table: pa.Table) -> pa.Table:
        cap = table.column("cap")[0].as_py()
        lists = table.column("vector").combine_chunks()
        unit = _units(lists, len(lists[0]))
        cls, copies = table.column("cls").to_numpy(), table.column("copies").to_numpy()
        piece = table.column("piece").to_numpy()
        left, right = table.column("left")[0].as_py(), table.column("right")[0].as_py()
        linked = unit @ unit.T >= cosine
        if left == right:
            np.fill_diagonal(linked, False)
        else:
            linked &= (piece == left)[:, None] != (piece == left)[None, :]
        # A link is counted in the first cap that both ends share.
        caps = table.column("caps").combine_chunks()
        flat, sizes = caps.flatten().to_numpy(), pc.list_value_length(caps).to_numpy()
        owner = np.repeat(np.arange(len(cls)), sizes)[flat < cap]
        number = np.unique(flat[flat < cap], return_inverse=True)[1]
        counted = linked.copy()
        for start in range(0, int(number.max(initial=-1)) + 1, PIECE):
            here = (number >= start) & (number < start + PIECE)
            member = np.zeros((len(cls), PIECE), np.float32)
            member[owner[here], number[here] - start] = 1
            counted &= member @ member.T == 0
        n = counted @ copies
        some = np.flatnonzero(n)
        edges = list(_forest(linked))
        a = np.concatenate([cls[some], cls[[e[0] for e in edges]]]) if edges else cls[some]
        b = np.concatenate([cls[some], cls[[e[1] for e in edges]]]) if edges else cls[some]
        count = np.concatenate([n[some], np.zeros(len(edges), np.int64)])
        return pa.Table.from_arrays([pa.array(x, pa.int64()) for x in (a, b, count)], schema=_FOUND)

    return compare


def _usable(vector: Column, label: Column) -> Column:
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(label.isNotNull() & ~odd & F.exists(vector, lambda x: x != 0), F.lit(False))


def group_count(crowd: DataFrame, piece: int) -> int:
    """Groups for about ``GROUP_ROWS`` rows each; every one of the ``n`` vectors of a cell is a row per piece."""
    rows = crowd.select(F.sum(F.col("n") * F.ceil(F.col("n") / piece))).first()[0] or 0
    return max(1, -(-rows // GROUP_ROWS))


def embedding_components(
    vectors: DataFrame, cosine: float = COSINE, caps: int = CAPS, piece: int = PIECE
) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id``, ``kept`` per row of ``vec_id``, ``embedding``, ``label``.

    Vectors of one label and dimension link at a cosine of ``cosine`` or more, in double
    precision. ``n_links`` counts other vectors linked directly, equal ones included, and
    ``component_id`` is the least vec_id reachable. Null labels and vectors that are null,
    empty, zero or hold a null or non-finite component link with nothing. Rows that repeat
    a vec_id count one by one; a null vec_id is no component_id unless it stands alone.
    More columns are ignored; an empty table gives an empty result.

    Every link that is reported is exact. Two vectors meet if caps connect them, which for
    a cosine near 1 nearly all do; the tests measure the recall. The code grows with the
    number of vectors, so that caps do not; a crowd of near copies is compared
    in pieces, its vectors spread over many tasks.
    """
    ok = _usable(F.col("embedding"), F.col("label"))
    cls = F.when(ok, F.xxhash64("label", "embedding"))
    rows = vectors.select("vec_id", "label", "embedding", cls.alias("cls"))
    good = rows.where("cls is not null")
    distinct = settle(good.groupBy("cls").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least")), "classes")
    n = distinct.count()
    groups = max(1, -(-n * CODES * NEAREST // GROUP_CAPS))
    sent = good.select("cls", F.xxhash64("label").alias("salt"), F.col("embedding").alias("vector"))
    sent = sent.mapInArrow(_sent(n, caps, groups), "grp long, caps binary, cls binary")
    shared = settle(sent.groupBy("grp").applyInArrow(_met, "cls long, cap long, least long"), "caps")
    near = shared.where("cls <> least").select(F.col("cls").alias("a"), F.col("least").alias("b")).distinct()
    near = components(contracted(near), "near").withColumnRenamed("node", "cls")
    sizes = near.groupBy("component").agg(F.count("*").alias("n"))
    few = F.col("n") <= piece * MOST_PIECES
    near = near.join(sizes, "component")
    whole = near.where(few).select("cls", F.col("component").alias("cap"), F.array().cast("array<long>").alias("caps"))
    # Of a large component every vector goes to each of its shared caps.
    apart = shared.join(near.where(~few), "cls", "left_semi").select("cls", "cap")
    own = apart.groupBy("cls").agg(F.collect_list("cap").alias("caps"))
    met = settle(whole.unionByName(apart.join(own, "cls")), "cells")
    # Vectors that share no cap go no further; equal ones are one before they are shuffled.
    found = good.groupBy("cls").agg(
        F.first("label").alias("label"), F.first("embedding").alias("vector"), F.count("*").alias("copies")
    )
    key = ["label", "dim", "cap"]
    listed = found.join(met.select("cls").distinct(), "cls", "left_semi").withColumn("dim", F.size("vector"))
    listed = settle(listed, "vectors")
    crowd = listed.select("cls", "label", "dim").join(met.select("cls", "cap"), "cls")
    crowd = settle(crowd.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1"), "crowd")
    pieces = F.ceil(F.col("n") / piece).cast("int")
    place = F.pmod(F.xxhash64("cls"), pieces).cast("int")
    # Piece i goes to the cells (i, j) and (j, i) of every piece j.
    cells = F.transform(
        F.sequence(F.lit(0), F.col("pieces") - 1),
        lambda j: F.struct(F.least("piece", j).alias("left"), F.greatest("piece", j).alias("right")),
    )
    placed = (
        listed.join(met, "cls")
        .join(crowd, key)
        .withColumn("pieces", pieces).withColumn("piece", place)
        .withColumn("cell", F.explode(cells))
        .select(*key, "cls", "vector", "copies", "caps", "piece", "cell.left", "cell.right")
    )
    # Cells are many and mostly small, so several go into a group.
    groups = group_count(crowd, piece)
    placed = placed.withColumn("grp", F.pmod(F.xxhash64(*key, "left", "right"), F.lit(groups)))
    # A group is much work for few bytes, by which Spark would put several into one task.
    placed = placed.repartition(min(groups, MOST_TASKS), "grp")
    found = settle(
        placed.groupBy("grp").applyInArrow(_compared(cosine), "a long, b long, n long"), "links"
    )
    links = found.where("a = b").groupBy("a").agg(F.sum("n").alias("links")).withColumnRenamed("a", "cls")
    tied = components(found.where("a <> b"), "linked").withColumnRenamed("node", "cls")
    known = distinct.select("cls", "copies", "least").join(links, "cls", "left").join(tied, "cls", "left")
    known = known.withColumn("component", F.coalesce("component", "cls"))
    whole = known.groupBy("component").agg(F.min("least").alias("component_id"))
    known = known.join(whole, "component").select(
        "cls", "component_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")
    )
    one = good.select("vec_id", "cls").join(known, "cls").select("vec_id", "n_links", "component_id")
    other = rows.where("cls is null").select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    return one.union(other).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
