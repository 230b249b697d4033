"""Prefix trie of conversations by range minima over sorted LCPs.

Every turn is 16 bytes of a hash of its role and text, a conversation the bytes of its
turns in sequence. Different sequences are sorted and cut into ranges; in each range the
lengths of the common prefixes of neighbours (LCPs) go into a sparse table of minima. Each
candidate prefix, a row and a depth, binary-searches the table to its left and to its right
for the rows that share it; candidates with the same extent and depth are one node, and sums
over its rows are differences of running sums. There is no stack and no tree walk.

A node whose rows go on beyond a range is open there. Its sums are additive, so the parts
are put together by the hash of the prefix; only prefixes at the two ends of a range are
open. Copies of a sequence are counted before any of this and enter once.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from liftline.llm.shared import settle
from liftline.operators.keyed import skew_safe_join

# Bytes per turn, and turns a range is expected to hold.
DIGEST = 16
RANGE_TURNS = 500_000

_NONE = hashlib.sha256(b"").hexdigest()


def turn_paths(conversations: DataFrame) -> DataFrame:
    """``conv_id``, ``path`` (hashes of its turns in sequence), ``sizes`` (bytes of the texts).

    Turns stand in the order of ``turn`` (null first), role and text; a null role or text is
    an empty one. Rows without conv_id belong to no conversation. Texts go through one
    shuffle and are then dropped: what is kept of a turn are 16 bytes and a number.
    """
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn",
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text"))
    whole = F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text")
    digest = F.substring(F.sha2(whole, 256), 1, 2 * DIGEST)
    each = turns.withColumn("place", place).select("conv_id", "place", digest.alias("digest"), F.octet_length("text").cast("long").alias("bytes"))
    listed = each.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("place", "digest", "bytes"))).alias("turns"))
    return listed.select("conv_id", F.unhex(F.array_join("turns.digest", "")).alias("path"), F.col("turns.bytes").alias("sizes"))


def with_shared_heads(paths: DataFrame, family: int = 5, most: int = 8) -> DataFrame:
    """The first h turns are those of conversation c - c % ``family``, h = crc32(c) % (``most`` + 1).

    All of them if it has fewer, none if it is absent; the own turns after the first h
    follow. At most ``most`` turns of a conversation are looked up.
    """
    own = paths.withColumns(
        {
            "_head": F.col("conv_id") - F.col("conv_id") % family,
            "_h": (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1)).cast("int"),
        }
    )
    heads = paths.where(F.col("conv_id") % family == 0).select(
        F.col("conv_id").alias("_head"), F.substring("path", 1, most * DIGEST).alias("_path"), F.slice("sizes", 1, most).alias("_sizes")
    )
    none, no_sizes = F.lit(b""), F.array().cast("array<bigint>")
    joined = own.join(heads, "_head", "left")
    path = F.concat(
        F.substring(F.coalesce("_path", none), F.lit(1), F.col("_h") * DIGEST),
        F.substring("path", F.col("_h") * DIGEST + 1, F.octet_length("path")),
    )
    sizes = F.concat(F.slice(F.coalesce("_sizes", no_sizes), F.lit(1), F.col("_h")), F.slice("sizes", F.col("_h") + 1, F.size("sizes")))
    return joined.select("conv_id", path.alias("path"), sizes.alias("sizes"))


def _listed_ids(members: DataFrame) -> DataFrame:
    """``seq``, ``n``, ``conv``, ``ends`` (hash of the sorted ids) per ``seq``.

    A hash has to read its list in order. The ids of a sequence are sorted by many tasks,
    which write them out in pieces; only these are read in one task, as a stream of which
    nothing but the state of the hash is kept.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, at, rows = batch.column("conv_id").to_pylist(), 0, []
            for seq, run in itertools.groupby(batch.column("seq").to_pylist()):
                n = sum(1 for _ in run)
                rows.append((seq, ids[at], n, ",".join(map(str, ids[at : at + n]))))
                at += n
            columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.binary(), pa.int64(), pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, ["seq", "first", "n", "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq, done = None, []

        def out() -> pa.RecordBatch:
            columns = [pa.array([r[k] for r in done], t) for k, t in enumerate((pa.binary(), pa.int64(), pa.int64(), pa.string()))]
            return pa.RecordBatch.from_arrays(columns, ["seq", "n", "conv", "ends"])

        for batch in batches:
            parts = (batch.column(c).to_pylist() for c in ("seq", "first", "n", "ids"))
            for own, first, n, ids in zip(*parts, strict=True):
                if own != seq:
                    if seq is not None:
                        done.append((seq, total, least, state.hexdigest()))
                    seq, least, total, state = own, first, 0, hashlib.sha256()
                else:
                    state.update(b",")
                total += n
                state.update(ids.encode())
            yield out()
            done = []
        if seq is not None:
            done.append((seq, total, least, state.hexdigest()))
            yield out()

    order = ["seq", "conv_id"]
    written = members.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
        pieces, "seq binary, first long, n long, ids string"
    )
    sent = written.repartition("seq").sortWithinPartitions("seq", "first")
    return sent.mapInArrow(hashed, "seq binary, n long, conv long, ends string")


def _shared(a: bytes, b: bytes) -> int:
    """Turns that two paths have in common at their beginning."""
    n = 0
    while n < min(len(a), len(b)) and a[n : n + DIGEST] == b[n : n + DIGEST]:
        n += DIGEST
    return n // DIGEST


class SparseTable:
    """Minima of all runs of 1, 2, 4, ... values."""

    def __init__(self, values: np.ndarray) -> None:
        self.levels = [values]
        while 2 << (len(self.levels) - 1) <= len(values):
            below, half = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(below[:-half], below[half:]))

    def right(self, at: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Last place from ``at`` on up to which all values after ``at`` reach ``least``."""
        at = at.copy()
        for k in reversed(range(len(self.levels))):
            level = self.levels[k]
            on = (at + 1 < len(level)) & (level[np.minimum(at + 1, len(level) - 1)] >= least)
            at[on] += 1 << k
        return at

    def left(self, at: np.ndarray, least: np.ndarray) -> np.ndarray:
        """First place before ``at`` from which all values after it, up to ``at``, reach ``least``."""
        at = at.copy()
        for k in reversed(range(len(self.levels))):
            from_ = at - (1 << k)
            on = (from_ >= 0) & (self.levels[k][np.maximum(from_ + 1, 0).clip(max=len(self.levels[k]) - 1)] >= least)
            at[on] = from_[on]
        return at

    def least(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Minimum from ``first`` to ``last``, both included, by two runs that overlap."""
        out = np.empty(len(first), self.levels[0].dtype)
        level = np.frexp((last - first + 1).astype(np.float64))[1] - 1
        for k in np.unique(level):
            own = level == k
            out[own] = np.minimum(self.levels[k][first[own]], self.levels[k][last[own] - (1 << k) + 1])
        return out


def _common(paths: list[bytes], sizes: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """LCP of every row with the row before; 0 for the first row."""
    n = len(paths)
    turns = np.frombuffer(b"".join(paths), "<u8").reshape(-1, DIGEST // 8)
    row = np.repeat(np.arange(n), sizes)
    depth = np.arange(len(turns)) - begin[row]
    before = np.maximum(row - 1, 0)
    inside = (row > 0) & (depth < sizes[before])
    other = np.where(inside, begin[before] + depth, 0)
    differs = ~inside | (turns != turns[other]).any(axis=1) if len(turns) else np.zeros(0, bool)
    found = sizes.copy()
    np.minimum.at(found, row[differs], depth[differs])
    found[0] = 0
    return found


_NODES = "key binary, up binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends string"


def _nodes(table: pa.Table) -> pa.Table:
    """Nodes of one range; ``key`` is given for open nodes, ``up`` where the parent is open."""
    side = table.column("side").to_pylist()
    path = table.column("path").to_pylist()
    before = next((p for s, p in zip(side, path, strict=True) if s < 0), None)
    after = next((p for s, p in zip(side, path, strict=True) if s > 0), None)
    order = sorted((i for i, s in enumerate(side) if s == 0), key=path.__getitem__)
    own, paths, n = table.take(order), [path[i] for i in order], len(order)
    sizes = np.array([len(p) // DIGEST for p in paths], np.int64)
    begin = np.concatenate([[0], np.cumsum(sizes)])
    bytes_ = np.concatenate([[0], np.cumsum(np.array(list(itertools.chain.from_iterable(own.column("sizes").to_pylist())), np.int64))])
    copies, convs = own.column("n").to_numpy(), own.column("conv").to_numpy()

    lcp = _common(paths, sizes, begin)
    first = _shared(before, paths[0]) if before is not None else -1
    last = _shared(paths[-1], after) if after is not None else -1
    table_ = SparseTable(lcp)
    # Every row with every depth, 0 included.
    row = np.repeat(np.arange(n), sizes + 1)
    start = begin[:-1] + np.arange(n)
    depth = np.arange(len(row)) - start[row]
    left, right = table_.left(row, depth), table_.right(row, depth)
    _, at, node = np.unique(left * (sizes.max() + 1) + depth, return_index=True, return_inverse=True)
    left, right, depth = left[at], right[at], depth[at]

    open_left = (left == 0) & (first >= depth)
    open_ = open_left | ((right == n - 1) & (last >= depth))
    sums = lambda x: np.concatenate([[0], np.cumsum(x)])
    total = bytes_[begin[1:]] - bytes_[begin[:-1]]
    # Bytes that a row adds to the tree: those after what it shares with the row before.
    shared = lcp.copy()
    shared[0] = max(first, 0)
    added = total - (bytes_[begin[:-1] + shared] - bytes_[begin[:-1]])
    over = bytes_[begin[left] + np.maximum(depth - 1, 0)] - bytes_[begin[left]]
    members = sums(copies)[right + 1] - sums(copies)[left]
    texts = sums(copies * total)[right + 1] - sums(copies * total)[left] - members * over
    tree = sums(added)[right + 1] - sums(added)[left + 1] + np.where(open_left, added[0], total[left] - over)
    leaf = np.append(lcp[1:], last) < sizes
    leaves = sums(leaf)[right + 1] - sums(leaf)[left]
    # A row begins a child of the node that it shares with the row before, and of its own ones.
    fork = node[start[1:] + lcp[1:]]
    if first >= 0:
        fork = np.append(fork, node[first])
    children = np.bincount(fork, minlength=len(left)) + (~open_left & (sizes[left] > depth))

    keys = {}
    for edge, reach, which in ((0, first, open_left), (n - 1, last, open_ & ~open_left)):
        state, wanted = hashlib.sha256(), {int(depth[i]): i for i in np.flatnonzero(which)}
        for d in range(reach + 1):
            if d:
                state.update(paths[edge][(d - 1) * DIGEST : d * DIGEST])
            if d in wanted:
                keys[wanted[d]] = state.digest()
    parent = node[start[left] + np.maximum(depth - 1, 0)]
    least = SparseTable(convs).least(left, right)
    under = depth > 0
    ends = own.column("ends").to_pylist()
    whole = (sizes[left] == depth) & ~open_left
    columns = [
        pa.array([keys.get(i) for i in range(len(left))], pa.binary()),
        pa.array([keys.get(p) if u else None for p, u in zip(parent.tolist(), under.tolist(), strict=True)], pa.binary()),
        pa.array(least), pa.array(depth),
        pa.array(least[parent], mask=~under | open_[parent]),
        pa.array(members), pa.array(children.astype(np.int64)), pa.array(leaves.astype(np.int64)), pa.array(texts - tree),
        pa.array([ends[i] if w else None for i, w in zip(left.tolist(), whole.tolist(), strict=True)], pa.string()),
    ]
    return pa.Table.from_arrays(columns, [c.split()[0] for c in _NODES.split(", ")])


def prefix_trie(paths: DataFrame, range_turns: int = RANGE_TURNS) -> DataFrame:
    """One row per node of the trie of ``conv_id``, ``path``, ``sizes`` (one row per conv_id).

    A node is a sequence of first turns, from the root of none; its members are the
    conversations that begin with it. ``conv_id`` is the smallest member, ``depth`` the number
    of turns, ``parent_conv_id`` the smallest member of the parent (null for the root),
    ``n_convs`` the members, ``n_children`` the nodes right below, ``n_leaves`` the nodes
    without children in the subtree, ``saved_tokens`` the sum over the subtree of (members
    - 1) times the bytes of the last text, ``ends_sha256`` the SHA-256 of the ids of the members
    that end here, sorted and comma-joined. A subtree includes its top.

    Conversations without turns are members of the root alone; equal ones end in one node.
    Without conversations there is no node. A conversation's turns, 24 bytes each, meet in
    one row; nothing else is gathered per conversation, prefix or group of copies.
    """
    paths = settle(paths.withColumn("seq", F.unhex(F.sha2("path", 256))), "paths")
    turns = paths.groupBy("seq").agg(F.first("path").alias("path"), F.first("sizes").alias("sizes"))
    rows = settle(turns.join(_listed_ids(paths), "seq").drop("seq"), "different")
    volume = rows.agg(F.coalesce(F.sum(F.size("sizes") + 1), F.lit(0))).first()[0]
    ranges = max(1, -(-volume // range_turns))
    sorted_ = settle(rows.repartitionByRange(ranges, "path").withColumn("part", F.spark_partition_id()), "ranges")
    # One row per range: what stands at its ends, for the ranges beside it.
    ends = sorted_.groupBy("part").agg(F.min("path").alias("low"), F.max("path").alias("high"))
    beside = Window.orderBy("part")
    ends = ends.select("part", F.lag("high").over(beside).alias("before"), F.lead("low").over(beside).alias("after"))
    sides = ends.select("part", F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(c).alias("path")) for s, c in ((-1, "before"), (1, "after"))])).alias("s"))
    sides = sides.select("part", "s.side", "s.path").where("path is not null")
    given = sorted_.withColumn("side", F.lit(0)).unionByName(sides, allowMissingColumns=True)
    found = settle(given.groupBy("part").applyInArrow(_nodes, _NODES), "nodes")

    parts = found.where("key is not null").groupBy("key").agg(
        F.max("up").alias("up"), F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
        F.max("ends").alias("ends"),
    )
    parts = settle(parts, "open-nodes")
    parents = parts.select(F.col("key").alias("up"), F.col("conv_id").alias("parent_conv_id"))
    below = found.where("key is null and up is not null").drop("key", "parent_conv_id").unionByName(parts.drop("key"))
    below = skew_safe_join(below, parents, ["up"], "left").drop("up")
    nodes = found.where("key is null and up is null").drop("key", "up").unionByName(below)
    return nodes.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends", F.lit(_NONE)).alias("ends_sha256"),
    )
