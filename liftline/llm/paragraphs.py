"""Substring dedup by paragraphs: MinHash bands, exact Jaccard, removal by components.

A paragraph is a line of at least ``LEAST_WORDS`` words; shorter lines repeat by chance
and stay. Equal paragraphs (words, A-Z lower-cased) are one from the start. Different ones
collide if all minima of a band agree; the number of bands follows from the recall wanted
at the threshold. Paragraphs joined by collisions are compared by exact Jaccard, linked
ones form components, and of each component only the first occurrence stays.

What is left is compared without regard to lines, so that wrapped text, lists and passages
inside longer lines count too: of every ``WINDOW`` runs of ``LEAST_WORDS`` words in
sequence the one of least hash is a unit, and the first and last run of a text are. These
runs cover every word of a text that is not shorter than one of them. Equal units are
found wherever they stand; all but the first occurrence are cut out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from liftline.llm import text as T
from liftline.llm.jaccard import CHUNK_SHINGLES, similar_sets
from liftline.llm.shared import components, contracted, settle

WORDS, PERCENT, LEAST_WORDS = 5, 80, 20
BAND_ROWS, RECALL = 3, 0.999
# Not above LEAST_WORDS, or words between two units would belong to none. Texts that share
# LEAST_WORDS + WINDOW - 1 words in sequence share a unit.
WINDOW = 20

_NULL = -(2**63)


def bands_for(percent: int, rows: int = BAND_ROWS, recall: float = RECALL) -> int:
    """Bands with which a pair at the threshold collides with a chance of ``recall``."""
    return math.ceil(math.log(1 - recall) / math.log(1 - (percent / 100) ** rows))


def lines_of(piece: T.Slice) -> tuple[T.Slice, np.ndarray]:
    """The lines of a slice as texts of their own, and per text the number of its first.

    A line feed ends a line; after the last one of a text nothing follows.
    """
    inner = np.setdiff1d(np.flatnonzero(piece.data == 10) + 1, piece.offsets)
    starts = np.sort(np.concatenate([inner, piece.offsets[:-1]]))
    first = np.arange(piece.n + 1) + np.searchsorted(inner, piece.offsets)
    return T.Slice(piece.first, piece.data, np.concatenate([starts, piece.offsets[-1:]])), first


class Paragraphs:
    """The paragraphs of a slice: text, line number in it, key and shingle hashes."""

    def __init__(self, piece: T.Slice, least: int) -> None:
        lines, self.first = lines_of(piece)
        starts, ends, word = T.words(lines)
        h = T.span_hashes(lines.data, starts, ends)
        values, begin = T.shingle_hashes(h, word, WORDS)
        long = np.flatnonzero(np.diff(word) >= max(least, 1))
        self.text = np.searchsorted(self.first, long, "right") - 1
        self.bytes = np.diff(lines.offsets)[long] - (lines.data[lines.offsets[long + 1] - 1] == 10 if len(long) else 0)
        self.line = long - self.first[self.text]
        place = np.arange(len(h)) - np.repeat(word[:-1], np.diff(word))
        sums = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(h * (T.mix(place.astype(np.uint64) + np.uint64(1)) | np.uint64(1)), out=sums[1:])
        self.key = T.mix(sums[word[long + 1]] - sums[word[long]]).view(np.int64)
        size = np.diff(begin)[long]
        self.values = T.gather(values, begin[long], size)
        self.begin = np.concatenate([[0], np.cumsum(size)])
        # Rows that share a doc_id are told apart by their whole text.
        self.row = T.span_hashes(piece.data, piece.offsets[:-1], piece.offsets[1:], fold=False).view(np.int64)

    def bands(self, count: int) -> np.ndarray:
        """One row of band values per paragraph."""
        rng = np.random.default_rng(count)
        out = np.zeros((len(self.key), count), np.uint64)
        if len(self.key):
            for band in range(count):
                for _ in range(BAND_ROWS):
                    a, b = rng.integers(1, 2**63, 2, dtype=np.uint64)
                    least = np.minimum.reduceat(self.values * (a | np.uint64(1)) + b, self.begin[:-1])
                    out[:, band] = T.mix(out[:, band] + least)
                out[:, band] += np.uint64(band)
        return T.mix(out).view(np.int64)


def _listed(rows: np.ndarray) -> pa.ListArray:
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.ravel()))


def _found(docs: DataFrame, least: int, count: int) -> DataFrame:
    """A row per paragraph, and one with null ``key`` per text with its number of lines and bytes."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc", "row", "line", "bytes", "key", "bands"]
        for batch in batches:
            ids = batch.column("doc").to_numpy()
            for piece in T.slices(batch.column("text")):
                p = Paragraphs(piece, least)
                own = ids[piece.first : piece.first + piece.n]
                arrays = [own[p.text], p.row[p.text], p.line, p.bytes, p.key]
                yield pa.RecordBatch.from_arrays([*map(pa.array, arrays), _listed(p.bands(count))], names)
                none = pa.nulls(piece.n, pa.int64())
                arrays = [pa.array(own), pa.array(p.row), pa.array(np.diff(p.first)), pa.array(np.diff(piece.offsets)), none]
                yield pa.RecordBatch.from_arrays([*arrays, pa.nulls(piece.n, pa.list_(pa.int64()))], names)

    schema = "doc long, row long, line long, bytes long, key long, bands array<long>"
    return docs.select("doc", "text").mapInArrow(found, schema)


def _sets(docs: DataFrame, least: int) -> DataFrame:
    """``key``, ``items`` of the paragraphs on the lines that ``wanted`` names."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column("wanted").to_pylist()
            for piece in T.slices(batch.column("text")):
                p = Paragraphs(piece, least)
                keys, items = [], []
                for i, (text, key) in enumerate(zip(p.text.tolist(), p.key.tolist(), strict=True)):
                    if key in wanted[piece.first + text]:
                        keys.append(key)
                        items.append(np.unique(p.values[p.begin[i] : p.begin[i + 1]]).view(np.int64))
                offsets = pa.array(np.cumsum([0, *map(len, items)]).astype(np.int32))
                flat = pa.array(np.concatenate([*items, np.zeros(0, np.int64)]))
                columns = [pa.array(keys, pa.int64()), pa.ListArray.from_arrays(offsets, flat)]
                yield pa.RecordBatch.from_arrays(columns, ["key", "items"])

    return docs.select("text", "wanted").mapInArrow(sets, "key long, items array<long>")


def unit_runs(h: np.ndarray, word: np.ndarray, length: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and hash of the runs of ``length`` words that are units, in order.

    ``h`` has the hash of every word, ``word`` per text the index of its first one.
    """
    place = np.arange(len(h) - length + 1)
    if len(place) <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    value = np.zeros(len(place), np.uint64)
    for j in range(length):
        value += h[j : j + len(place)] * (T.mix(np.uint64([j + 1])) | np.uint64(1))
    value = T.mix(value)
    fits = np.diff(word) >= length
    ends = np.repeat(word[1:], np.diff(word))[: len(place)]
    inside = place + length <= ends
    rank = np.where(inside, value, np.uint64(2**64 - 1))
    picked = np.zeros(len(place), bool)
    if len(place) >= window:
        view = np.lib.stride_tricks.sliding_window_view(rank, window)
        for start in range(0, len(view), 1 << 16):
            part = view[start : start + (1 << 16)]
            picked[start + np.arange(len(part)) + part.argmin(axis=1)] = True
    else:
        picked[:] = True
    at = np.flatnonzero(picked & inside)
    # Repeats of a short period have many least runs; one in half a window is enough.
    same = np.zeros(len(at), bool)
    same[1:] = (value[at[1:]] == value[at[:-1]]) & (np.diff(at) <= window // 2)
    begin = at[np.maximum.accumulate(np.where(same, 0, np.arange(len(at))))] if len(at) else at
    turn = (at - begin) // max(1, window // 2)
    thin = same.copy()
    thin[1:] &= turn[1:] == turn[:-1]
    edges = np.concatenate([word[:-1][fits], word[1:][fits] - length])
    at = np.union1d(at[~thin], edges).astype(np.int64)
    return at, value[at].view(np.int64)


def _units(docs: DataFrame, length: int, window: int) -> DataFrame:
    """A row per unit: its hash, its bytes in the text, its first and last line."""

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc").to_numpy()
            for piece in T.slices(batch.column("text")):
                starts, ends, word = T.words(piece)
                at, value = unit_runs(T.span_hashes(piece.data, starts, ends), word, length, window)
                text = np.searchsorted(word, at, "right") - 1
                row = T.span_hashes(piece.data, piece.offsets[:-1], piece.offsets[1:], fold=False).view(np.int64)
                feeds = np.flatnonzero(piece.data == 10)
                ahead = np.searchsorted(feeds, piece.offsets[text])
                first, last = starts[at], ends[at + length - 1]
                arrays = [
                    ids[piece.first + text], row[text], first - piece.offsets[text], last - piece.offsets[text],
                    np.searchsorted(feeds, first) - ahead, np.searchsorted(feeds, last) - ahead, value,
                ]
                names = ["doc", "row", "start", "end", "line", "last", "unit"]
                yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in arrays], names)

    schema = "doc long, row long, start long, end long, line long, last long, unit long"
    return docs.select("doc", "text").mapInArrow(units, schema)


def _repeated_spans(texts: DataFrame, removed: DataFrame, length: int, window: int) -> DataFrame:
    """``doc``, ``row``, ``spans``: bytes of units that stand at an earlier place too.

    Units on a line that ``removed`` (``doc``, ``row``, ``line``) names neither go nor let
    others go. A unit that overlaps its own first occurrence stays.
    """
    units = settle(_units(texts, length, window), "units")
    often = units.groupBy("unit").agg(F.count("*").alias("n")).where("n > 1").select("unit")
    again = settle(units.join(often, "unit"), "repeated-units")
    lines = removed.groupBy("doc", "row").agg(F.collect_set("line").alias("lines"))
    goes = F.array_contains("lines", F.col("line")) | F.array_contains("lines", F.col("last"))
    again = again.join(lines, ["doc", "row"], "left").where(~F.coalesce(goes, F.lit(False))).drop("lines")
    again = settle(again, "left-units")
    keep = again.groupBy("unit").agg(
        F.min(F.struct("doc", "row", "start", "end")).alias("keep"), F.count("*").alias("n")
    )
    text, own = F.struct("doc", "row"), F.struct("keep.doc", "keep.row")
    later = (text > own) | (F.col("start") >= F.col("keep.end"))
    gone = again.join(keep.where("n > 1"), "unit").where(later).select("doc", "row", "start", "end").distinct()
    # Spans that touch are one.
    here = Window.partitionBy("doc", "row").orderBy("start", "end")
    so_far = here.rowsBetween(Window.unboundedPreceding, -1)
    apart = gone.withColumn("new", F.coalesce(F.col("start") > F.max("end").over(so_far), F.lit(True)).cast("int"))
    spans = apart.withColumn("span", F.sum("new").over(here)).groupBy("doc", "row", "span").agg(
        F.min("start").alias("start"), F.max("end").alias("end")
    )
    return spans.groupBy("doc", "row").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))


def repeated_paragraphs(
    docs: DataFrame,
    percent: int = PERCENT,
    least_words: int = LEAST_WORDS,
    chunk_shingles: int = CHUNK_SHINGLES,
    window: int = WINDOW,
) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_removed``, ``n_lines``, ``removed``, ``n_cut``, ``spans`` per row of ``doc_id``, ``text``.

    ``n_removed`` of the ``n_bytes`` bytes go: those of removed lines, without their line feeds,
    and those of spans. ``removed`` has the numbers, from 0, of the lines that go: paragraphs that equal or
    resemble (Jaccard of five-word shingles, ``percent`` or more, also by way of others)
    one at an earlier (doc_id, line). ``spans`` has what goes besides, the bytes ``start`` to
    ``end`` of the UTF-8 text in which it repeats an earlier one over lines or inside of
    them, and ``n_cut`` their number of bytes; spans do not touch removed lines. Texts of
    fewer than ``least_words`` words stay. Null and empty texts have one empty line. Rows that
    repeat a doc_id and its text count as one place, so neither loses a line to the other;
    with another text they are separate rows. A null doc_id comes before all others. More
    columns are ignored; an empty table gives an empty result.
    """
    texts = docs.select(F.coalesce("doc_id", F.lit(_NULL)).alias("doc"), "text")
    found = settle(_found(texts, least_words, bands_for(percent)), "paragraphs")
    places = found.where("key is not null")
    place = F.struct("doc", "line", "row")
    distinct = settle(
        places.groupBy("key").agg(
            F.min(place).alias("place"), F.min("bands").alias("bands"), F.count("*").alias("n")
        ),
        "distinct",
    )
    # A star from the least key of a band reaches all that collide in it.
    banded = distinct.select("key", F.explode("bands").alias("band"))
    least = banded.groupBy("band").agg(F.min("key").alias("least"), F.count("*").alias("n")).where("n > 1")
    star = banded.join(least, "band").select(F.col("key").alias("a"), F.col("least").alias("b"))
    meeting = settle(star.where("a <> b").distinct(), "meeting")
    met = meeting.select(F.col("a").alias("key")).union(meeting.select("b")).distinct()
    # The same words stand on one line of a text at least: the first place of each key.
    wanted = distinct.join(met, "key").groupBy(F.col("place.doc").alias("doc")).agg(
        F.collect_list("key").alias("wanted")
    )
    sets = _sets(texts.join(wanted, "doc"), least_words).dropDuplicates(["key"])
    sets = settle(sets.withColumn("n", F.size("items")), "sets")
    # Links come as chains; a few tasks leave hardly anything but stars of them.
    linked = components(contracted(similar_sets(sets, meeting, percent, chunk_shingles)), "linked")
    tied = distinct.join(linked.withColumnRenamed("node", "key"), "key", "left")
    tied = tied.select("key", "place", "n", F.coalesce("component", "key").alias("component"))
    first = tied.groupBy("component").agg(F.min("place").alias("keep"), F.sum("n").alias("places"))
    gone = tied.join(first.where("places > 1"), "component").select("key", "keep")
    removed = settle(
        places.drop("bands").join(gone, "key").where(place != F.col("keep")).select("doc", "row", "line", "bytes"), "removed"
    )
    # Rows that repeat a doc_id and its text have the same lines.
    lists = removed.distinct().groupBy("doc", "row").agg(F.array_sort(F.collect_list("line")).alias("removed"), F.sum("bytes").alias("gone"))
    spans = _repeated_spans(texts, removed, least_words, window)
    rows = found.where("key is null").select("doc", "row", F.col("line").alias("n_lines"), F.col("bytes").alias("n_bytes"))
    none, uncut = F.array().cast("array<bigint>"), F.array().cast("array<struct<start:bigint,end:bigint>>")
    n_cut = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return rows.join(lists, ["doc", "row"], "left").join(spans, ["doc", "row"], "left").select(
        F.when(F.col("doc") > _NULL, F.col("doc")).alias("doc_id"),
        "n_bytes",
        (F.coalesce("gone", F.lit(0)) + F.coalesce(n_cut, F.lit(0))).cast("long").alias("n_removed"),
        "n_lines",
        F.coalesce("removed", none).alias("removed"),
        F.coalesce(n_cut, F.lit(0)).cast("long").alias("n_cut"),
        F.coalesce("spans", uncut).alias("spans"),
    )


def without_lines(docs: DataFrame, removed: DataFrame) -> DataFrame:
    """``docs`` without the lines that ``removed`` names per doc_id (one row per doc_id)."""
    wanted = removed.where("size(removed) > 0").select(F.col("doc_id").alias("_doc"), F.col("removed").alias("_gone"))
    lines = F.split("text", "\n")
    kept = F.filter(lines, lambda _, i: ~F.array_contains("_gone", i.cast("long")))
    joined = docs.join(wanted, F.col("doc_id").eqNullSafe(F.col("_doc")), "left")
    text = F.when(F.col("_gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    return joined.withColumn("text", text).select(*[f"`{c}`" for c in docs.columns])


def without_repeats(docs: DataFrame, removed: DataFrame) -> DataFrame:
    """``without_lines``, and without the ``spans`` of ``removed``; line feeds inside of them stay."""
    wanted = removed.where("n_cut > 0").select(F.col("doc_id").alias("_doc"), F.col("spans").alias("_spans"))
    raw, spans = F.col("text").cast("binary"), F.col("_spans")

    def between(start: Column, end: Column) -> Column:
        return F.substring(raw, (start + 1).cast("int"), (end - start).cast("int")).cast("string")

    def part(span: Column, i: Column) -> Column:
        before = F.when(i == 0, F.lit(0)).otherwise(F.get(spans, (i - 1).cast("int"))["end"])
        feeds = F.regexp_replace(between(span["start"], span["end"]), "[^\n]", "")
        return F.concat(between(before, span["start"]), feeds)

    rest = between(F.element_at(spans, -1)["end"], F.octet_length("text").cast("long"))
    cut = F.concat(F.array_join(F.transform(spans, part), ""), rest)
    joined = docs.join(wanted, F.col("doc_id").eqNullSafe(F.col("_doc")), "left")
    text = F.when(spans.isNull(), F.col("text")).otherwise(cut)
    return without_lines(joined.withColumn("text", text).select(*[f"`{c}`" for c in docs.columns]), removed)
