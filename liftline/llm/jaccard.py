"""N-gram Jaccard join: T-occurrence search over inverted lists with DivideSkip.

Two sets with Jaccard similarity of at least s share at least T = s * size of the items
of either, so a document is found by merging its inverted lists and keeping those that
occur T times. Its longest lists are set aside: the short ones are merged by counting, and
the long ones are probed, list by list, for the values that can still reach T.

On the way there, in this order: equal sets become one; sets with too few shingles that
occur anywhere else drop out; the shingles that must be shared, the rarest ones, tell
which sets could ever meet, and only those are brought together. Such a group is cut
into chunks of bounded size. Chunks are searched one by one; then sets outside the
largest component of a group are searched for in its other chunks. Sets that are already
connected are not compared again, so a group of near copies is not taken to all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, GroupedData, Window
from pyspark.sql import functions as F

from liftline.llm import text as T
from liftline.llm.fingerprints import repeated_fingerprints, total_bytes
from liftline.llm.shared import components, settle

# A chunk is expected to hold about so many shingles, and so many sets.
CHUNK_SHINGLES, CHUNK_SETS = 40_000, 400
# Chunks that are searched at once for the sets of others, and sets of a label that look first.
WIDE, BRIDGES = 10, 4
# A list is probed rather than merged if it holds at least this part of the sets, and so many at a time.
LONG_PART, PROBED_AT_ONCE = 8, 64
# Chunks in a task, and tasks at most.
CELLS_A_TASK, MOST_TASKS = 8, 10_000


def _sets(piece: T.Slice, k: int) -> Iterator[np.ndarray]:
    starts, ends, first = T.words(piece)
    h, begin = T.shingle_hashes(T.span_hashes(piece.data, starts, ends), first, k)
    for i in range(piece.n):
        yield np.unique(h[begin[i] : begin[i + 1]])


def _set_key(items: np.ndarray) -> int:
    """64 bits that tell sets apart, as a signed number."""
    with np.errstate(over="ignore"):
        total = T.mix(items + np.uint64(len(items))).sum(dtype=np.uint64) if len(items) else np.uint64(0)
    return int(np.int64(np.uint64(total).astype(np.int64)))


def shingle_sets(docs: DataFrame, k: int) -> DataFrame:
    """``doc``, ``n``, ``key`` (of the set) per row of ``doc``, ``text``."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [s for piece in T.slices(batch.column("text")) for s in map(_summary, _sets(piece, k))]
            n, key = [s[0] for s in sets], [s[1] for s in sets]
            columns = [batch.column("doc"), pa.array(n, pa.int64()), pa.array(key, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc", "n", "key"])

    return docs.select("doc", "text").mapInArrow(counted, "doc long, n long, key long")


def _summary(items: np.ndarray) -> tuple[int, int]:
    return len(items), _set_key(items)


class Lists:
    """Inverted lists over sets ``0 .. n - 1``, and T-occurrence search in them.

    All lists are one array, so that merging and probing are a few array operations per
    search. Lists that hold a good part of the sets are kept as rows of flags as well.
    """

    def __init__(self, sets: list[np.ndarray], percent: int) -> None:
        self.percent, self.n = percent, len(sets)
        self.sizes = np.array([len(s) for s in sets], np.int64)
        # The least size from each set on.
        self.least = np.minimum.accumulate(self.sizes[::-1])[::-1]
        items = np.concatenate([*sets, np.zeros(0, np.int64)])
        owner = np.repeat(np.arange(self.n), self.sizes)
        order = np.argsort(items, kind="stable")
        items, self.owners = items[order], owner[order]
        self.values, at = np.unique(items, return_index=True)
        self.ends = np.append(at[1:], len(items))
        length = np.diff(np.append(at, len(items)))
        self.places = np.repeat(np.arange(len(at)), length) * self.n + self.owners
        wide = length * LONG_PART >= self.n
        self.row = np.where(wide, np.cumsum(wide) - 1, -1)
        self.flags = np.zeros((int(wide.sum()), self.n), bool)
        inside = np.repeat(wide, length)
        self.flags[np.repeat(self.row, length)[inside], self.owners[inside]] = True

    def search(self, items: np.ndarray, first: int, known) -> Iterator[int]:
        """Sets from ``first`` on that are similar to ``items``; ``known(sets)`` skips some."""
        if first >= self.n or not len(items) or not len(self.values):
            return
        # A similar set has at least so many items, so at least so many are shared.
        least = max(-(-self.percent * len(items) // 100), int(self.least[first]))
        need = -(-self.percent * (len(items) + least) // (100 + self.percent))
        at = np.minimum(np.searchsorted(self.values, items), len(self.values) - 1)
        lists = at[self.values[at] == items]
        start = np.searchsorted(self.places, lists * self.n + first)
        length = self.ends[lists] - start
        some = length > 0
        lists, start, length = lists[some], start[some], length[some]
        if len(lists) < need:
            return
        # The longest lists are probed, as long as a set has to be in one of the others too.
        order = np.argsort(-length, kind="stable")
        long = order[: need - 1]
        long = long[self.row[lists[long]] >= 0]
        merged = np.ones(len(lists), bool)
        merged[long] = False
        found = np.bincount(T.gather(self.owners, start[merged], length[merged]), minlength=self.n)
        sets = np.flatnonzero(found >= need - len(long))
        sets = sets[~np.broadcast_to(known(sets), sets.shape)]
        found, left = found[sets], len(long)
        # 100 o >= p (a + b - o), solved for the overlap o
        needs = -(-self.percent * (len(items) + self.sizes[sets]) // (100 + self.percent))
        for begin in range(0, len(long), PROBED_AT_ONCE):
            if not len(sets):
                return
            rows = self.row[lists[long[begin : begin + PROBED_AT_ONCE]]]
            found = found + np.count_nonzero(self.flags[rows][:, sets], axis=0)
            left -= len(rows)
            able = found + left >= needs
            sets, found, needs = sets[able], found[able], needs[able]
        yield from sets[found >= needs].tolist()


_EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _decoded(table: pa.Table) -> tuple[list[int], list[np.ndarray]]:
    lists = table.column("items").combine_chunks()
    flat, offsets = lists.flatten().to_numpy(), np.cumsum([0, *pc.list_value_length(lists).to_pylist()])
    return table.column("key").to_pylist(), [flat[a:b] for a, b in zip(offsets, offsets[1:], strict=False)]


def _as_edges(pairs: list[tuple[int, int]]) -> pa.Table:
    return pa.Table.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], schema=_EDGES)


def _within(percent: int):
    """Joins the sets of one chunk: links that connect what belongs together."""

    def join(table: pa.Table) -> pa.Table:
        keys, sets = _decoded(table)
        index, label, pairs = Lists(sets, percent), np.arange(len(keys)), []
        for i, items in enumerate(sets):
            for j in index.search(items, i + 1, lambda j, i=i: label[j] == label[i]):
                if label[j] != label[i]:
                    label[label == label[j]] = label[i]
                    pairs.append((keys[i], keys[j]))
        return _as_edges(pairs)

    return join


def _across(percent: int):
    """Searches the sets with ``query`` among the other sets of the group."""

    def join(table: pa.Table) -> pa.Table:
        asks = np.array(table.column("query").to_pylist(), bool)
        keys, sets = _decoded(table)
        # Labels that a link has met are one from then on, so none is met twice.
        label = np.unique(table.column("label").to_numpy(), return_inverse=True)[1]
        there = np.flatnonzero(~asks)
        index, pairs = Lists([sets[i] for i in there], percent), []
        for q in np.flatnonzero(asks).tolist():
            for j in index.search(sets[q], 0, lambda j, q=q: label[there[j]] == label[q]):
                to = int(there[j])
                if label[to] != label[q]:
                    label[label == label[to]] = label[q]
                    pairs.append((keys[q], keys[to]))
        return _as_edges(pairs)

    return join


def _candidates(docs: DataFrame, rows: DataFrame, k: int, percent: int) -> DataFrame:
    """``key``, ``n``, ``items`` of the sets that could be similar to another one."""

    def shingles(piece: T.Slice) -> tuple[np.ndarray, np.ndarray]:
        starts, ends, first = T.words(piece)
        return T.shingle_hashes(T.span_hashes(piece.data, starts, ends), first, k)

    seen = repeated_fingerprints(docs, shingles, total_bytes(docs))
    counts = seen.groupBy("doc").agg(F.sum("n").alias("seen"))
    able = rows.where("n > 0").join(counts, "doc").where(100 * F.col("seen") >= percent * F.col("n"))
    one = able.groupBy("key").agg(F.min("doc").alias("doc")).withColumnRenamed("key", "want")

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            want, keys, items = batch.column("want").to_pylist(), [], []
            for piece in T.slices(batch.column("text")):
                for i, s in enumerate(_sets(piece, k)):
                    # A doc_id that is repeated with another text has another key.
                    if _set_key(s) == want[piece.first + i]:
                        keys.append(want[piece.first + i])
                        items.append(s.view(np.int64))
            sizes = np.cumsum([0, *map(len, items)]).astype(np.int32)
            flat = pa.array(np.concatenate([*items, np.zeros(0, np.int64)]))
            columns = [pa.array(keys, pa.int64()), pa.ListArray.from_arrays(pa.array(sizes), flat)]
            yield pa.RecordBatch.from_arrays(columns, ["key", "items"])

    joined = docs.join(one, "doc").select("want", "text")
    sets = joined.mapInArrow(kept, "key long, items array<long>")
    return settle(sets.dropDuplicates(["key"]).withColumn("n", F.size("items")), "sets")


def _meeting(sets: DataFrame, percent: int) -> DataFrame:
    """``a``, ``b``: every set with the least set that has one of its rarest shingles."""
    each = sets.select("key", "n", F.explode("items").alias("item"))
    spread = each.groupBy("item").agg(F.count("*").alias("df"))
    # Of n shingles at least ceil(s n) are shared, so one of the n - ceil(s n) + 1 rarest is.
    rank = F.row_number().over(Window.partitionBy("key").orderBy("df", "item"))
    rarest = each.join(spread, "item").withColumn("rank", rank)
    must = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    rarest = rarest.where((F.col("rank") <= must) & (F.col("df") > 1)).select("key", "item")
    least = rarest.groupBy("item").agg(F.min("key").alias("b"))
    return rarest.join(least, "item").select(F.col("key").alias("a"), "b").distinct()


def _dealt(cells: DataFrame, keys: list[str], tasks: int) -> GroupedData:
    """Cells by ``keys``. They are much work for few bytes, by which Spark would put them into one task."""
    return cells.repartition(max(1, min(tasks, MOST_TASKS)), *keys).groupBy(*keys)


def similar_sets(
    sets: DataFrame, meeting: DataFrame, percent: int, chunk_shingles: int = CHUNK_SHINGLES
) -> DataFrame:
    """``a``, ``b``: links that connect all similar sets of ``key``, ``n``, ``items``.

    ``meeting`` has edges ``a``, ``b`` that join at least all sets that are similar; sets
    it does not join are never compared.
    """
    meeting = components(meeting, "meeting").withColumnRenamed("node", "key")
    grouped = sets.join(meeting, "key")
    # A set counts as an even share of a chunk at least: short sets are many to compare.
    share = F.greatest("n", F.lit(chunk_shingles // CHUNK_SETS))
    volume = grouped.groupBy("component").agg(F.sum(share).alias("volume"))
    volume = settle(volume.withColumn("chunks", F.ceil(F.col("volume") / chunk_shingles).cast("int")), "volume")
    small, cells, most = volume.agg(
        F.coalesce(F.sum(F.when(F.col("chunks") == 1, F.col("volume"))), F.lit(0)),
        F.coalesce(F.sum(F.when(F.col("chunks") > 1, F.col("chunks"))), F.lit(0)),
        F.coalesce(F.max("chunks"), F.lit(0)),
    ).first()
    packs = max(1, -(-small // chunk_shingles))
    cut = grouped.join(volume.select("component", "chunks"), "component")
    alone = F.col("chunks") == 1
    placed = settle(
        cut.select(
            "key", "items", "n", "chunks",
            F.when(alone, F.pmod(F.xxhash64("component"), F.lit(packs))).otherwise(F.col("component")).alias("grp"),
            F.when(alone, -1).otherwise(F.pmod(F.xxhash64("key"), F.col("chunks"))).cast("int").alias("chunk"),
        ),
        "chunks",
    )
    edge = "a long, b long"
    near = _dealt(placed, ["grp", "chunk"], -(-(packs + cells) // CELLS_A_TASK))
    links = settle(near.applyInArrow(_within(percent), edge), "links")
    if most < 2:
        return links
    # Whole chunks of several sets each are searched for next, by a few sets of each; where
    # they are linked, most of a group is one component before all others are searched for.
    for few in [True, False] if most > WIDE else [False]:
        labels = components(links, "labels").withColumnRenamed("node", "key").withColumnRenamed("component", "label")
        big = placed.where(F.col("chunk") >= 0).join(labels, "key", "left")
        big = settle(big.withColumn("label", F.coalesce("label", "key")), "labelled")
        if few:
            big = big.where(F.col("chunks") > WIDE)
        links = settle(links.union(_bridges(big, percent, share, chunk_shingles, few)), "links")
    return links


def _bridges(big: DataFrame, percent: int, share: Column, chunk_shingles: int, few: bool) -> DataFrame:
    """Links of the sets outside the largest label of their group with any set of the group.

    ``few`` searches for some sets of each label of several only.
    """
    weight = big.groupBy("grp", "label").agg(F.sum("n").alias("volume"), F.count("*").alias("members"))
    main = weight.groupBy("grp").agg(F.max(F.struct("volume", "label")).alias("main"))
    main = main.select("grp", F.col("main.label").alias("main"))
    rest = big.join(main, "grp").where("label <> main")
    if few:
        place = F.row_number().over(Window.partitionBy("grp", "label").orderBy(F.xxhash64("key"), "key"))
        several = weight.where("members > 1").select("grp", "label")
        rest = rest.join(several, ["grp", "label"]).withColumn("place", place).where(F.col("place") <= BRIDGES)
    # A search takes the sets of several chunks at once, so that they are repeated less.
    turns = rest.groupBy("grp").agg(F.ceil(F.sum(share) / (chunk_shingles * WIDE)).cast("int").alias("turns"))
    chunks = F.ceil(F.col("chunks") / WIDE).cast("int")
    wide = F.floor(F.col("chunk") / WIDE).cast("int").alias("chunk")
    sizes = big.groupBy("grp").agg(F.first(chunks).alias("chunks"))
    cells = sizes.join(turns, "grp").agg(F.coalesce(F.sum(F.col("chunks") * F.col("turns")), F.lit(0))).first()[0]
    ask = rest.join(turns, "grp").select(
        "grp", "key", "items", "label", F.lit(True).alias("query"),
        F.explode(F.sequence(F.lit(0), chunks - 1)).alias("chunk"),
        F.pmod(F.xxhash64(F.col("key"), F.lit(1)), F.col("turns")).cast("int").alias("turn"),
    )
    there = big.join(turns, "grp").select(
        "grp", "key", "items", "label", F.lit(False).alias("query"), wide,
        F.explode(F.sequence(F.lit(0), F.col("turns") - 1)).alias("turn"),
    )
    far = _dealt(ask.unionByName(there), ["grp", "chunk", "turn"], cells)
    return far.applyInArrow(_across(percent), "a long, b long")


def jaccard_components(
    docs: DataFrame, k: int = 5, percent: int = 80, chunk_shingles: int = CHUNK_SHINGLES
) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` per row of ``doc_id``, ``text``.

    A document's set holds its different runs of ``k`` words, words cut at ASCII white
    space and A-Z lower-cased; with fewer words the whole sequence is one run. Two
    documents link when 100 * shared >= ``percent`` * united. ``component_id`` is the
    least doc_id reachable by links. A text without words, or null, has no shingles and
    links with nothing; equal sets link, copies and repeated rows included. Rows that
    repeat a doc_id are judged one by one. A null doc_id links, but is no component_id
    unless it stands alone. More columns are ignored; an empty table gives none.
    """
    # One number stands for null, as a shuffle key.
    texts = docs.select(F.coalesce("doc_id", F.lit(-(2**63))).alias("doc"), "text")
    rows = settle(shingle_sets(texts, k), "shingles")
    sets = _candidates(texts, rows, k, percent)
    links = similar_sets(sets, _meeting(sets, percent), percent, chunk_shingles)
    found = components(links, "linked")
    least = rows.where("n > 0").groupBy("key").agg(F.min(F.when(F.col("doc") > -(2**63), F.col("doc"))).alias("least"))
    tied = least.join(found.withColumnRenamed("node", "key"), "key", "left")
    tied = tied.withColumn("component", F.coalesce("component", "key"))
    whole = tied.groupBy("component").agg(F.min("least").alias("component_id"))
    ids = tied.join(whole, "component").select("key", "component_id")
    real = F.when(F.col("doc") > -(2**63), F.col("doc")).alias("doc_id")
    some = rows.where("n > 0").join(ids, "key").select(real, F.col("n").alias("n_shingles"), "component_id")
    none = rows.where("n = 0").select(real, F.col("n").alias("n_shingles"), real.alias("component_id"))
    return some.union(none)
